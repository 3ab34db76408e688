import itertools
import random
import zlib

import numpy as np
import pytest
from fixtures import documents, odd_texts

from tariffloom.llm.toxicity import FEATURES, WORD, Lexicon, _all_words, context_score, features, fit_toxicity, op5_toxicity, read_words, score_toxicity

SF1 = "/root/testdata/sf0.1"


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_automaton_against_edit_distance():
    rng = random.Random(1)
    terms = {"".join(rng.choice("abc") for _ in range(n)): 1.0 + n / 10 for n in (2, 4, 5, 6, 7, 9, 12, 13) for _ in range(3)}
    lexicon = Lexicon(terms)
    for _ in range(3000):
        word = "".join(rng.choice("abc") for _ in range(rng.randrange(1, 15)))
        best = min(((distance(word, t), -w, t) for t, w in terms.items() if distance(word, t) <= Lexicon.allowance(t)), default=None)
        assert lexicon.find(word) == (None if best is None else (best[2], best[0]))
    assert Lexicon({}).find("abc") is None


def test_context_separates_quotation_from_abuse():
    def score(text):
        words = [(m.start(), m.end(), m.group().lower()) for m in WORD.finditer(text)]
        return context_score(text, words, [w for _, _, w in words].index("idiot"), 1.0, 0)[0]

    assert score("you are an idiot today") > score("there is an idiot today") > score('he used "idiot" there') == score("they said idiot there")


def test_signs_inside_a_word_are_misspellings():
    lexicon = Lexicon({"stupid": 1.0, "idiot": 1.0})
    words = [m.group() for m in WORD.finditer("a st*pid id1ot*** _x 12ab3cd4 x")]
    assert words == ["a", "st*pid", "id1ot", "x", "ab3cd", "x"]
    assert [lexicon.find(w) for w in words[1:3]] == [("stupid", 1), ("idiot", 1)]


def test_features_count_hits():
    lexicon = Lexicon({"idiot": 2.0, "stupid": 1.0})
    text = "Idiot! stupiid, idiot and fine"
    hits = {w: lexicon.find(w) for w in ("idiot", "stupiid")}
    assert hits["stupiid"] == ("stupid", 1)
    x = features(text, hits, lexicon)
    assert len(x) == FEATURES and features("fine", {}, lexicon) == [0.0] * FEATURES
    assert list(itertools.compress(x, [1, 1, 0, 0, 0, 0, 1])) == pytest.approx(np.log1p([2, 1, 2]))


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF1}/labels.parquet").collect()}
    rows = op5_toxicity(spark, SF1).collect()
    assert len(rows) == spark.read.parquet(f"{SF1}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    toxic = [r for r in held if truth[r.doc_id] == 1]
    found = sum(r.predicted for r in toxic)
    wrong = sum(r.predicted for r in held if truth[r.doc_id] == 0)
    print(len(held), len(toxic), found, wrong)
    assert found > 0.9 * len(toxic) and wrong < 0.02 * len(held)


def test_odd_rows(spark):
    docs = documents(spark, odd_texts())
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, toxic int")
    out = score_toxicity(docs, fit_toxicity(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r.score <= 1 for r in out)
    empty = documents(spark, [])
    assert score_toxicity(empty, fit_toxicity(empty, labels)).collect() == []


def test_terms_of_nine_letters_tolerate_two_edits():
    lexicon = Lexicon({"worthless": 1.0, "disgusting": 1.0})
    assert [lexicon.find(w) for w in ("wortlhess", "disgsutting", "wrothles")] == [("worthless", 2), ("disgusting", 2), None]
    assert [Lexicon.allowance("x" * n) for n in (4, 5, 8, 9, 11, 12)] == [0, 1, 1, 2, 2, 2]


def test_parts_of_joined_words_are_looked_up():
    lexicon = Lexicon({"idiot": 1.0, "stupid": 1.0})
    text = "you_stupid_id1ot and st*pid, idiot2day"
    hits = {w: lexicon.find(w) for w in _all_words(text) if lexicon.find(w)}
    words = [w for _, _, w in read_words(text, hits)]
    assert words == ["you", "stupid", "id1ot", "and", "st*pid", "idiot", "day"]
    assert all(text[a:b] == w for a, b, w in read_words(text, hits))
    assert features("you_idiot", {"idiot": ("idiot", 0)}, lexicon) == features("you idiot", {"idiot": ("idiot", 0)}, lexicon)
