import zlib

import numpy as np
from fixtures import SF2, documents, odd_texts
from pyspark.sql import functions as F

from tariffloom.llm import language
from tariffloom.llm.language import LanguageModel, fit, gradients, identify, op9_language_id, train


def random_model(hidden, labels, seed=1):
    rng = np.random.default_rng(seed)
    model = LanguageModel(list(labels), rng.normal(size=(2, 3 * hidden, 256)), rng.normal(size=(2, 3 * hidden, hidden)), rng.normal(size=(2, len(labels), hidden)), rng.normal(size=len(labels)))
    model.x[:, : 2 * hidden] = model.x[:, : 2 * hidden] * 0.2 + 0.5
    return model


def test_gradients_against_differences():
    rng = np.random.default_rng(2)
    model = random_model(3, "ab")
    windows, target = rng.integers(0, 4, size=(5, 6)).astype(np.uint8), np.array([0, 1, 1, 0, 1])
    for q, g in zip(model.parameters, gradients(model, windows, target), strict=True):
        spots = np.argwhere(np.abs(g) > 1e-4)
        for spot in map(tuple, spots[rng.permutation(len(spots))[:8]]):
            q0, e = q[spot], 1e-5
            q[spot] = q0 + e
            up = gradients(model, windows, target, loss=True)
            q[spot] = q0 - e
            down = gradients(model, windows, target, loss=True)
            q[spot] = q0
            assert abs((up - down) / (2 * e) - g[spot]) < 1e-3 * max(1, abs(g[spot])) + 1e-5


def brute(model, text):
    """The network over one text, position by position, in plain loops."""
    hidden = model.u.shape[2]
    states = []
    for way, bytes_ in ((0, text), (1, text[::-1])):
        h, found = np.zeros(hidden), []
        for byte in bytes_:
            x, s = model.x[way][:, byte], model.u[way] @ h
            r = np.clip(x[:hidden] + s[:hidden], 0, 1)
            z = np.clip(x[hidden : 2 * hidden] + s[hidden : 2 * hidden], 0, 1)
            c = np.tanh(x[2 * hidden :] + r * s[2 * hidden :])
            h = z * h + (1 - z) * c
            found.append(h)
        states.append(found if way == 0 else found[::-1])
    total = np.zeros(len(model.labels))
    for f, b in zip(*states, strict=True):
        logits = model.out[0] @ f + model.out[1] @ b + model.bias
        p = np.exp(logits - logits.max())
        total += p / p.sum()
    return total / max(1, len(text))


def test_whole_texts_against_plain_loops():
    rng = np.random.default_rng(3)
    model = random_model(4, "abc")
    texts = [rng.integers(0, 256, size=n).astype(np.uint8).tobytes() for n in (0, 1, 2, 31, 32, 33, 64, 100, 700, 5, 5, 0)]
    got = model.pooled(texts)
    for text, row in zip(texts, got, strict=True):
        assert np.allclose(row, brute(model, text), atol=1e-9)
    assert (model.pooled([b"", b""]) == 0).all() and model.pooled([]).shape == (0, 3)


def test_held_out_accuracy(spark):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "lang").collect()}
    rows = op9_language_id(spark, SF2).collect()
    assert len(rows) == len(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) > 0.97 * len(held)


def test_odd_rows(spark, monkeypatch):
    docs = documents(spark, ["the cat and the dog"] * 3 + odd_texts() + ["12 34 ... !", "é"])
    windows = np.array([list(t) for t in (b"the cat ", b"and then", b"und der ", b"der hund")], dtype=np.uint8)
    model = train(windows, ["en", "en", "de", "de"], epochs=120)
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    assert identify(docs, model).count() == docs.count()
    assert [got[i].lang_pred for i in (3, 4, 5, 18)] == ["und"] * 4 and got[0].lang_pred == "en" and got[19].lang_pred != "und"
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(abs(r.score - model.pooled([texts[i].encode()]).max()) < 1e-4 for i, r in got.items() if r.lang_pred != "und")
    empty = documents(spark, [])
    assert identify(empty, fit(empty, F.lit(True))).collect() == []


def test_runs_of_rows_keep_every_row():
    import pyarrow as pa

    batches = [pa.record_batch({"text": [None, "a" * 9, "", "b" * 30]}), pa.record_batch({"text": pa.array([], pa.string())}), pa.record_batch({"text": ["c", "d" * 11, "e"]})]
    parts = list(language._gathered(iter(batches), 10))
    assert [x for p in parts for x in p.column("text").to_pylist()] == [x for b in batches for x in b.column("text").to_pylist()] and len(parts) == 3


def test_wide_runs_are_those_of_each_text(monkeypatch):
    rng = np.random.default_rng(4)
    model = random_model(3, "abc")
    texts = [rng.integers(0, 256, size=n % 90).astype(np.uint8).tobytes() for n in range(150)]
    monkeypatch.setattr(language, "WIDE", 70)
    assert np.allclose(model.pooled(texts), [brute(model, t) for t in texts], atol=1e-9)
