import hashlib
import re

from fixtures import SF, documents, odd_texts

from tariffloom.llm.substring_dedup import dedup_substrings, doubled_lengths, longest_repeats, op7_substring_dedup


def brute(rows, n=13):
    words = {i: re.findall(r"[^\x20\x09-\x0D]+", t or "") for i, t in rows}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - n + 1):
            first.setdefault(tuple(words[i][k : k + n]), i)
    out = set()
    for i, w in words.items():
        gone = {j for k in range(len(w) - n + 1) if first[tuple(w[k : k + n])] < i for j in range(k, k + n)}
        out.add((i, len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


def test_against_brute_force_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = {tuple(r) for r in op7_substring_dedup(spark, SF).collect()}
    assert got == {(a, b, c, hashlib.sha256(d.encode()).hexdigest()) for a, b, c, d in brute(rows)}


def test_odd_rows(spark):
    docs = documents(spark, odd_texts())
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    for window in (13, 8, 2, 50, 30):
        got = {tuple(r) for r in dedup_substrings(docs, window).where("doc_id is not null").collect()}
        assert got == brute(rows, window)
    assert dedup_substrings(docs).count() == docs.count()


def test_empty_table(spark):
    assert dedup_substrings(documents(spark, [])).collect() == []


def test_levels():
    assert [doubled_lengths(n) for n in (2, 8, 13, 50)] == [[1, 2], [4, 8], [6, 13], [6, 12, 25, 50]]


def test_longest_repeats(spark):
    texts = [" ".join(f"{c}{k}" for k in range(a, b)) for c, a, b in (("a", 0, 60), ("a", 30, 90), ("b", 0, 20), ("b", 5, 40), ("c", 0, 300), ("d", 0, 12))]
    docs = documents(spark, texts + [texts[4], texts[5], "x " + texts[4], None, "", "no id"])
    got = {r.doc_id: r.n_words for r in longest_repeats(docs).collect()}
    assert got == {0: 26, 1: 26, 2: 13, 3: 13, 4: 208, 6: 208, 8: 208}
    assert longest_repeats(documents(spark, [])).collect() == [] and longest_repeats(docs, 400).collect() == []


def test_rows_that_share_an_id(spark):
    a, b = (" ".join(f"{c}{k}" for k in range(30)) for c in "ab")
    docs = spark.createDataFrame([(1, a), (2, a), (2, b), (3, b), (3, a)], "doc_id long, text string")
    assert sorted(tuple(r)[:3] for r in dedup_substrings(docs).collect()) == [(1, 30, 0), (2, 30, 0), (2, 30, 30), (3, 30, 30), (3, 30, 30)]
