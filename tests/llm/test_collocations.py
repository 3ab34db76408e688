import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
from fixtures import SF, SF2, documents, odd_texts

from tariffloom.llm.collocations import OP12_SQL, Text, collocations, distinct, frequent_phrases, op12_phrase_collocations

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least=30, percent=80, top=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            words = re.findall("[^ \t]+", piece)
            total[lang] += len(words)
            for size in range(1, 5):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = set()
    for lang, counts in f.items():
        frequent = {p: n for p, n in counts.items() if n >= least}
        kept, longest = [], Counter()
        for q, n in frequent.items():
            for part in {q[i:j] for i in range(len(q)) for j in range(i + 2, len(q) + 1)} - {q}:
                longest[part] = max(longest[part], n)
        for p, a in frequent.items():
            if len(p) == 1 or 100 * longest[p] >= percent * a:
                continue
            score, _, le, r = min((2000000 * a // (counts[p[:k]] + counts[p[k:]]), k, counts[p[:k]], counts[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), le, r))
        for rank, (score, a, phrase, le, r) in enumerate(sorted(kept)[:top], 1):
            out.add((lang, rank, phrase.decode(), -a, le, r, total[lang], -score))
    return out


def test_query_against_sql(spark):
    for sf in (SF, SF2):
        con = duckdb.connect()
        con.execute(f"create view documents as from '{sf}/documents.parquet'")
        got = sorted(map(tuple, op12_phrase_collocations(spark, sf).collect()))
        assert got and got == sorted(con.execute(OP12_SQL).fetchall())


def test_query_against_brute_force(spark):
    rows = [(r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()]
    assert {tuple(r) for r in op12_phrase_collocations(spark, SF).collect()} == brute(rows)


def test_few_words_many_ties(spark):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["a", "b", "c", "É", "la", "la", "x\x00y", "\u0085"], k=rng.randint(0, 40))).replace("c a", rng.choice(["c, a", "c\x0ba", "c  \t a", "C A"])) for _ in range(300)]
    docs = documents(spark, texts + odd_texts())
    rows = [(r.lang, r.text) for r in docs.collect()]
    for least, percent, top in ((30, 80, 2000), (2, 50, 7), (9, 101, 100)):
        assert {tuple(r) for r in collocations(docs, least, percent, top).collect()} == brute(rows, least, percent, top)


def test_large_group_of_copies(spark):
    text = "one two three four five, one two three. " * 20
    docs = documents(spark, [text] * 400 + ["one two"] * 30)
    assert {tuple(r) for r in collocations(docs).collect()} == brute([(r.lang, r.text) for r in docs.collect()])


def test_empty_tables(spark):
    assert collocations(documents(spark, [])).collect() == []
    assert collocations(documents(spark, [None, "", " . ,"])).collect() == []
    found, totals = frequent_phrases(documents(spark, ["only one"]), 1)
    assert {(r.phrase, r.n) for r in found.collect()} == {("only", 1), ("one", 1), ("only one", 1)} and [r.n for r in totals.collect()] == [2]


def test_distinct_rows_are_told_apart_by_their_columns():
    a, b = np.array([1, 1, 2, 1, -1]), np.array([5, 5, 5, 6, 5])
    keep, n = distinct([a, b], np.array([1, 2, 3, 4, 5]))
    assert sorted((a[k], b[k], w) for k, w in zip(keep, n, strict=True)) == [(-1, 5, 5), (1, 5, 3), (1, 6, 4), (2, 5, 3)]


def test_words_of_a_slice():
    text = Text(pa.array(["Ab, c d\tÉ", None, "", "d\re"]), pa.array(["x", "x", "y", "y"]))
    v = text.vocabulary
    assert [v.words[int(v.word_of[k])].as_py() for k in v.ids] == ["ab", "c", "d", "É", "d", "e"]
    assert text.follows.tolist() == [False, False, True, True, False, False]
