import math
import zlib

import numpy as np
import pyarrow as pa
from fixtures import SF2, documents, odd_texts

from tariffloom.llm.quality_model import FEATURES, _best, _tree, fit_additive, fit_quality, measure, op4_quality_classifier, score_quality


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF2}/labels.parquet").collect()}
    rows = op4_quality_classifier(spark, SF2).collect()
    assert len(rows) == spark.read.parquet(f"{SF2}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) > 0.95 * len(held)


def test_pairs_learn_what_single_features_cannot():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(4000, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0)).astype(float)
    assert ((fit_additive(x, y).score(x) > 0.5) == y).mean() > 0.95
    assert ((fit_additive(x, y, pairs=0).score(x) > 0.5) == y).mean() < 0.7


def test_odd_rows(spark):
    docs = documents(spark, odd_texts())
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")
    out = score_quality(docs, fit_quality(docs, labels)).collect()
    assert len(out) == docs.count() and all(0 <= r["__score"] <= 1 for r in out)
    empty = documents(spark, [])
    model = fit_quality(empty, labels)
    assert len(model.tables) == len(FEATURES) and score_quality(empty, model).collect() == []


def walked(model, values):
    """One document's score by going through the bounds of each table one by one."""

    def place(cuts, v):
        k = 0
        while k < len(cuts) and cuts[k] <= v:
            k += 1
        return k

    total = model.bias + sum(t[place(c, v)] for c, t, v in zip(model.cuts, model.tables, values, strict=True))
    for (a, b), (ca, cb), t in zip(model.pairs, model.pair_cuts, model.pair_tables, strict=True):
        total += t[place(ca, values[a])][place(cb, values[b])]
    return 1 / (1 + math.exp(-max(-30, min(30, total))))


def test_scores_against_tables_walked_one_document_at_a_time(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "text")
    model = fit_quality(docs, spark.read.parquet(f"{SF2}/labels.parquet"))
    rows = docs.collect()
    features = [measure(pa.array([r.text], pa.string()))[0] for r in rows]
    want = {r.doc_id: walked(model, x.tolist()) for r, x in zip(rows, features, strict=True)}
    got = {r.doc_id: r["__score"] for r in score_quality(docs, model).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - v) < 1e-9 for k, v in want.items())
    assert len(model.pairs) == 6 and len({round(v, 6) for v in want.values()}) > 50


def test_a_tree_against_all_splits():
    """The first split of a tree gains as much as the best of all."""
    rng = np.random.default_rng(1)
    for _ in range(50):
        g, h = rng.normal(size=9), rng.random(9) + 0.1
        gains = [g[:k].sum() ** 2 / (h[:k].sum() + 1) + g[k:].sum() ** 2 / (h[k:].sum() + 1) - g.sum() ** 2 / (h.sum() + 1) for k in range(1, 9)]
        gain, k = _best(g, h)
        assert abs(gain - max(gains)) < 1e-9 and k == int(np.argmax(gains)) + 1
        values = _tree(g, h)
        assert sum(values[i] != values[i - 1] for i in range(1, 9)) <= 3
