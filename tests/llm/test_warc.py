import hashlib
import os

import zstandard
from fixtures import SF, SF2

from tariffloom.llm.warc import fetch, op13_warc, parse_record, read_bundles, read_seek_table, write_bundles

SCHEMA = "page_id long, url string, html string, payload string, n int, owner int"


def pages(spark, htmls):
    return spark.createDataFrame([(None if h == "no id" * 30 and k % 2 else k, None if k % 4 else f"http://h{k}/\r\n x", h, "clash", 1, 2) for k, h in enumerate(htmls)], SCHEMA)


def brute(rows):
    out, owner = [], {}
    for page_id, html in rows:
        data = (html or "").encode()
        if len(data) >= 100 and page_id is not None:
            owner[data] = min(owner.get(data, page_id), page_id)
    for page_id, html in rows:
        data = (html or "").encode()
        to = owner.get(data)
        to = None if to == page_id else to
        out.append((page_id, len(data), hashlib.sha256(data).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def test_query_round_trip(spark):
    for sf in (SF, SF2):
        rows = [(r.page_id, r.html) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()]
        assert sorted(map(tuple, op13_warc(spark, sf).collect()), key=str) == brute(rows)


def odd_pages():
    return [None, "", "é" * 49, "é" * 50, "é" * 50, "x" * 99, "x" * 99, "a\r\n\r\nWARC/1.1\r\n\r\n" * 20, "big " * 900000, "big " * 900000, "no id" * 30, "no id" * 30, "no id" * 30, "copy of many " * 20] + ["copy of many " * 20] * 50


def test_odd_pages(spark):
    frame = pages(spark, odd_pages())
    frame = frame.unionByName(frame.limit(5))
    rows = [(r.page_id, r.html) for r in frame.collect()]
    index = write_bundles(frame)
    got = read_bundles(spark, index)
    assert sorted([(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got.collect()], key=str) == brute(rows)
    stored = {r.payload_digest: bytes(r.payload) for r in got.where("record_type = 'response'").collect()}
    assert set(stored.values()) == {(h or "").encode() for _, h in rows} and all(hashlib.sha256(v).hexdigest() == k for k, v in stored.items())


def test_rows_without_any_id_are_stored(spark):
    frame = spark.createDataFrame([(None, "u", "z" * 200)] * 3, "page_id long, url string, html string")
    assert [r.record_type for r in read_bundles(spark, write_bundles(frame)).collect()] == ["response"] * 3


def test_empty_table(spark):
    index = write_bundles(pages(spark, []))
    assert index.collect() == [] and read_bundles(spark, index).collect() == []


def test_bundles_are_plain_zstandard_with_a_seek_table(spark, tmp_path):
    index = write_bundles(pages(spark, odd_pages()), f"file://{tmp_path}/out").collect()
    for path in {r.bundle for r in index}:
        data = open(path.removeprefix("file://"), "rb").read()
        table = read_seek_table(path)
        whole = b"".join(zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() for _ in range(1))
        assert len(whole) == sum(full for _, _, full in table)
        own = [r for r in index if r.bundle == path]
        for r in own:
            at, packed, full = table[r.frame]
            assert (r.frame_at, r.frame_bytes) == (at, packed)
            frame = zstandard.ZstdDecompressor().decompress(data[at : at + packed])
            fields, _, end = parse_record(frame, r.offset)
            assert len(frame) == full and end - r.offset == r.length and fields["warc-record-id"] == f"<{r.record_id}>"
    assert len(os.listdir(tmp_path / "out")) == len({r.bundle for r in index})


def test_fetch_reads_single_records(spark):
    frame = pages(spark, odd_pages())
    index = write_bundles(frame)
    got = fetch(index, spark.createDataFrame([(0,), (3,), (8,), (9,), (777,)], "page_id long")).collect()
    want = {r.page_id: (r.html or "").encode() for r in frame.collect() if r.page_id in (0, 3, 8)}
    assert {r.page_id: bytes(r.payload) for r in got if r.payload is not None} == want
    assert [(r.page_id, r.refers_to) for r in got if r.payload is None] == [(9, 8)]
    one = index.limit(1)
    assert fetch(index, one, "record_id").count() == 1
