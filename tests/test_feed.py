"""The change feed as a streaming source: restarts, bounds, tombstones and drafts, expiry."""

import json

import pytest

from tariffloom.sources.feed import Subscription, expire, publish
from tariffloom.storage import fresh_path

SCHEMA = "seq long, body string"


def changes(spark, first, last):
    return spark.createDataFrame([(k, f"m{k}", k % 7 == 0, k % 5 == 0) for k in range(first, last + 1)], "seq long, body string, deleted boolean, draft boolean")


def wanted(*spans):
    return [k for a, b in spans for k in range(a, b + 1) if k % 7 and k % 5]


def seqs(subscription):
    return sorted(r.seq for r in subscription.messages().collect())


def feed(spark, last):
    folder = fresh_path(spark, "feed")
    publish(changes(spark, 1, last), "seq", folder, chunk=40)
    return folder


def test_starts_at_the_latest_and_resumes(spark):
    folder = feed(spark, 100)
    s = Subscription(spark, folder, SCHEMA, page=10, pages=3)
    s.prime()
    assert seqs(s) == []
    publish(changes(spark, 101, 230), "seq", folder, chunk=40)
    assert s.poll() == 130 and seqs(s) == wanted((101, 130))  # the bound of a poll
    s.drain()
    assert seqs(s) == wanted((101, 230)) and s.poll() == 230
    assert {r.seq: r.body for r in s.messages().collect()} == {k: f"m{k}" for k in wanted((101, 230))}


def test_many_restarts_equal_one_run(spark):
    folder = feed(spark, 150)
    one, many = Subscription(spark, folder, SCHEMA, start=0), Subscription(spark, folder, SCHEMA, start=0, page=5, pages=10)
    one.poll()
    many.drain()
    assert seqs(one) == seqs(many) == wanted((1, 150))


def test_expired_cursor_starts_again_at_the_latest(spark):
    folder = feed(spark, 50)
    s = Subscription(spark, folder, SCHEMA, start=0)
    s.poll()
    publish(changes(spark, 51, 120), "seq", folder, chunk=40)
    expire(folder, 90)
    assert s.poll() == 120 and seqs(s) == wanted((1, 50))
    publish(changes(spark, 121, 140), "seq", folder, chunk=40)
    s.drain()
    assert seqs(s) == wanted((1, 50), (121, 140))


def test_a_batch_that_failed_is_read_again(spark, tmp_path):
    folder = feed(spark, 90)
    s = Subscription(spark, folder, SCHEMA, start=0, page=10, pages=3)

    def fail(batch, n):
        raise ValueError("the sink is away")

    from tariffloom.sources.feed import feed_stream

    stream = feed_stream(spark, folder, SCHEMA, s.cursor, **s.options)
    with pytest.raises(Exception, match="the sink is away"):
        stream.writeStream.foreachBatch(fail).option("checkpointLocation", s.checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert json.load(open(s.cursor)) == {"start": 0, "at": 30}
    got = []
    for _ in range(4):
        stream = feed_stream(spark, folder, SCHEMA, s.cursor, **s.options)
        stream.writeStream.foreachBatch(lambda batch, n: got.extend(r.seq for r in batch.collect())).option("checkpointLocation", s.checkpoint).trigger(availableNow=True).start().awaitTermination()
    assert sorted(got) == wanted((1, 90))


def test_a_gap_and_an_empty_feed(spark):
    folder = fresh_path(spark, "feed")
    publish(changes(spark, 1, 0), "seq", folder, chunk=10)
    s = Subscription(spark, folder, SCHEMA)
    assert s.poll() == 0
    publish(changes(spark, 35, 38).unionByName(changes(spark, 71, 72)), "seq", folder, chunk=10)
    s.drain()
    assert seqs(s) == wanted((35, 38), (71, 72))
