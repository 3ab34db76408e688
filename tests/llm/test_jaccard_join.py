import random
import re

import numpy as np
from fixtures import SF, documents, odd_texts

import tariffloom.llm.jaccard_join as module
from tariffloom.llm.graph import components
from tariffloom.llm.jaccard_join import jaccard_classes, keep_one_per_class, least_matches, op3_ngram_jaccard_join, overlaps
from tariffloom.llm.shared import join_groups
from pyspark.sql import functions as F


def brute(rows, n=5, t=0.8):
    """doc_id: (text_id, class_id, n_links)"""
    sets = {}
    for i, text in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        sets[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    text_id = {i: min(j for j in sets if sets[j] == s) if s else i for i, s in sets.items()}
    reps = sorted({text_id[i] for i in sets if sets[i]})
    links = {i: set() for i in sets}
    for x, a in enumerate(reps):
        for b in reps[x + 1 :]:
            if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]):
                links[a].add(b)
                links[b].add(a)
    root = {}
    for r in sorted(sets):
        todo = [r]
        while todo:
            x = todo.pop()
            if x not in root:
                root[x] = r
                todo += links[x]
    return {i: (text_id[i], root[text_id[i]] if sets[i] else i, len(links[text_id[i]])) for i in sets}


def result(frame):
    return {r.doc_id: (r.text_id, r.class_id, r.n_links) for r in frame.collect()}


def test_against_brute_force_on_the_table(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert result(op3_ngram_jaccard_join(spark, SF)) == brute(rows)


def near_copies(many):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(150)]
    out = []
    for _ in range(many):
        w = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 3, 4])):
            w[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_large_group_over_several_blocks(spark):
    docs = documents(spark, near_copies(160) + odd_texts())
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    got = result(jaccard_classes(docs, block=32))
    assert {k: v for k, v in got.items() if k is not None} == brute(rows)
    assert {r.doc_id for r in keep_one_per_class(docs).where("doc_id is not null").collect()} == {i for i, v in brute(rows).items() if v[1] == i}


def test_empty_table(spark):
    assert jaccard_classes(documents(spark, [])).collect() == []


def test_pruning_keeps_pairs_at_the_threshold():
    need = least_matches(0.8, 1e-4)
    assert sorted(need) == [16, 32, 48, 64] and need[64] < 45


def test_overlaps_by_product_and_by_merge():
    rng = np.random.default_rng(0)
    lists = [np.unique(rng.integers(0, 300, 100)) for _ in range(9)]
    i, j = np.triu_indices(9, 1)
    assert (overlaps(lists, i, j) == [len(set(lists[a]) & set(lists[b])) for a, b in zip(i, j, strict=True)]).all()
    assert overlaps(lists, i[:3], j[:3]).tolist() == overlaps(lists, i, j)[:3].tolist()


def test_components_of_a_long_path(spark):
    edges = spark.range(1, 40).selectExpr("id as u", "id - 1 as v").union(spark.createDataFrame([(100, 101)], "u long, v long"))
    assert {r.node: r.root for r in components(edges, "u", "v").collect()} == {i: 0 for i in range(40)} | {100: 100, 101: 100}


def test_joins_of_large_groups(spark):
    rows = spark.createDataFrame([(k, 7 if k % 3 else k) for k in range(9000)] + [(9000, None)], "doc_id long, k long")
    groups = rows.where("k is not null").groupBy("k").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("k != 6")
    got = {r.doc_id: r["first"] for r in join_groups(rows, groups, ["k"], "first").collect()}
    assert got == {k: 1 if k % 3 else k for k in range(9000) if k != 6}


def test_blocks_are_bounded_by_shingles(spark):
    base = [f"w{k}" for k in range(3000)]
    texts = [" ".join([*base[:2990], *[f"v{i}x{k}" for k in range(10)]]) for i in range(30)]
    docs = documents(spark, texts)
    want = sorted(map(tuple, jaccard_classes(docs).collect()))
    module.BLOCK_SHINGLES, old = 20_000, module.BLOCK_SHINGLES
    assert sorted(map(tuple, jaccard_classes(docs).collect())) == want and {r[3] for r in want} == {29}
    module.BLOCK_SHINGLES = old
