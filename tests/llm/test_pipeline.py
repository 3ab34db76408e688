import re

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_jaccard_join import brute as near_classes
from test_pii import brute as base_spans
from tokenizers import Tokenizer

from tariffloom.llm.quality_model import fit_quality, score_quality

SF2 = "/root/testdata/sf0.01"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF2}/documents.parquet")
    columns, rows = docs.columns, {r.doc_id: r for r in docs.collect()}
    steps = dict(corpus_pipeline.STAGES)
    assert list(steps) == ["quality", "near_duplicates", "decontamination", "pii", "packing"]

    model = fit_quality(docs, spark.read.parquet(f"{SF2}/labels.parquet"))
    good = {r.doc_id for r in score_quality(docs, model).collect() if r["__score"] >= 0.3}
    out = steps["quality"](spark, docs, SF2)
    assert out.columns == columns and {r.doc_id for r in out.collect()} == good and len(good) > 0.7 * len(rows)

    left = docs.where(docs.doc_id.isin(sorted(good)))
    out = steps["near_duplicates"](spark, left, SF2)
    classes = near_classes([(i, rows[i].text) for i in good])
    kept = {i for i, c in classes.items() if c[1] == i}
    assert out.columns == columns and {r.doc_id for r in out.collect()} == kept

    left = docs.where(docs.doc_id.isin(sorted(kept)))
    out = steps["decontamination"](spark, left, SF2)
    runs = set()
    for r in spark.read.parquet(f"{SF2}/benchmark.parquet").collect():
        w = re.findall(r"\w+", r.text.lower())
        runs |= {tuple(w[k : k + 13]) for k in range(len(w) - 12)}
    words = {i: re.findall(r"\w+", (rows[i].text or "").lower()) for i in kept}
    clean = {i for i, w in words.items() if not any(tuple(w[k : k + 13]) in runs for k in range(len(w) - 12))}
    assert out.columns == columns and {r.doc_id for r in out.collect()} == clean

    left = docs.where(docs.doc_id.isin(sorted(clean)))
    out = steps["pii"](spark, left, SF2)
    texts = {r.doc_id: r for r in out.collect()}
    assert out.columns == columns and set(texts) == clean
    for i, r in texts.items():
        assert r.n_chars == len(r.text) and (r.text == rows[i].text or "<" in r.text)
        assert not base_spans(re.sub("<[A-Z_]+>", "", r.text)) and len(re.findall("<(EMAIL|IP|CARD|PHONE)>", r.text)) >= min(1, len(base_spans(rows[i].text)))

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = {}
    for r in corpus_pipeline.run(spark, SF2).collect():
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == clean
    for i, own in pieces.items():
        ids = [x for r in sorted(own, key=lambda r: r.start) for x in np.frombuffer(r.ids, "<u4").tolist()]
        assert ids == [*tokenizer.encode(texts[i].text, add_special_tokens=False).ids, 1]
