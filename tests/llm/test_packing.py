import public_tokenizers
from fixtures import SF, documents, odd_texts
from tokenizers import Tokenizer

from tariffloom.llm.packing import Windows, op2_packing, pack_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, docs, size=2048):
    import numpy as np

    t = Tokenizer.from_file(PATH)
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in docs}
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(ids)
    for i, own in by_doc.items():
        own.sort(key=lambda r: r.start)
        got = [x for r in own for x in np.frombuffer(r.ids, "<u4").tolist()]
        assert got == ids[i] and all(r.doc_tokens == len(ids[i]) and r.length == len(r.ids) // 4 for r in own)
        assert [r.start for r in own] == [sum(p.length for p in own[:k]) for k in range(len(own))]
    padding = 0
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(p.length for p in own[:k]) for k in range(len(own))]
        total = sum(r.length for r in own)
        assert total <= size and all(r.sequence_length == total for r in own)
        padding += 0 if total & (total - 1) == 0 else size - total
    return padding


def test_round_trip_on_the_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    padding = check(pack_documents(docs, PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert padding < 0.01 * sum(r.length for r in op2_packing(spark, SF).collect())


def test_odd_rows(spark):
    docs = documents(spark, [t for t in odd_texts() if t != "no id"] + ["It's 12,5 €", "ÉCOLE ǅ İ ﬁ é ͅa x́", "<|endoftext|> a<|startoftext|>b", "a\x1cb\x85c\u00a0d\u2028e \x00\x07 f", "ΑΣ ΣΑΣ. We'LL don'T 12km", "e\u0301cole \u1e9e \U0001d4b3 \u01c5"])
    check(pack_documents(docs.repartition(3), PATH, windows=2).collect(), [(r.doc_id, r.text) for r in docs.collect()])


def test_empty_table(spark):
    assert pack_documents(documents(spark, []), PATH).collect() == []


def test_windows_prefer_the_best_fit():
    w = Windows(16, 2, 2)
    assert not list(w.add((0, 0, 8))) and not list(w.add((1, 0, 13)))
    assert list(w.add((2, 0, 3))) == [[(1, 0, 13), (2, 0, 3)]]
    assert [sum(p[2] for p in own) for own in w.merge()] == [8]
