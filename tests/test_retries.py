"""Retries by timers against a plain walk through each message's time line."""

import os
import random
from datetime import datetime, timedelta, timezone

import pandas as pd

from tariffloom import streaming
from tariffloom.plans import feeds
from tariffloom.streaming.retries import backoff, retried

SF = "/root/testdata/sf0.001"
HOUR = 3_600_000
KINDS = {"signup": "received", "error": "failed", "view": "failed", "purchase": "done"}


def walk(rows, base, patience, end):
    """rows: (key, ms, seq, kind); ``end``: the last watermark. Looks for the next thing that happens, row or due time, until there is none."""
    out = []
    for key in {r[0] for r in rows}:
        todo = sorted((ms, seq, kind) for k, ms, seq, kind in rows if k == key)
        n, due, waiting = 0, None, False
        while True:
            limit = todo[0][0] if todo else end
            if due is not None and due <= limit:
                if waiting:
                    n += 1
                    out.append((key, due, "try", n))
                    due, waiting = due + patience, False
                else:
                    out.append((key, due, "timed_out", n))
                    n, due = 0, None
                continue
            if not todo:
                break
            ms, _, kind = todo.pop(0)
            if kind == "received" and n == 0:
                n, due, waiting = 1, ms + patience, False
                out.append((key, ms, "try", 1))
            elif kind == "done" and n:
                out.append((key, ms, "done", n))
                n, due, waiting = 0, None, False
            elif kind == "failed" and n == 5 and not waiting:
                out.append((key, ms, "gave_up", 5))
                n, due = 0, None
            elif kind == "failed" and n and not waiting:
                due, waiting = ms + base * min(2**n, 32), True
    return sorted(out)


def told(frame):
    return sorted(tuple(r) for r in frame.select("key", "at", "action", "attempt").collect())


def millis(ts):
    return int(ts.replace(tzinfo=timezone.utc).timestamp() * 1000 + 0.5)


def test_over_the_fixture(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").collect()
    rows = [(e.user_id, int(e.ts.replace(tzinfo=timezone.utc).timestamp() * 1_000_000 + 0.5) // 1000, e.event_id, KINDS.get(e.event_type)) for e in events]
    want = walk(rows, 2 * HOUR, 120 * HOUR, max(r[1] for r in rows) - 600_000)
    got = told(feeds.stream_retried(spark, SF))
    assert sorted(set(got) ^ set(want))[:6] == []
    assert got == want and {r[2] for r in got} >= {"try", "done"}


def test_batches_give_up_and_leave_no_state(spark, tmp_path):
    rng, start, rows = random.Random(9), datetime(2026, 1, 1), []
    for key in range(40):
        at = start + timedelta(minutes=key)
        rows.append((key, at, 0, "received"))
        for k in range(1, 12):
            at += timedelta(hours=rng.choice([0.2, 9, 20, 20, 20, 70]))
            rows.append((key, at, k, rng.choice(["failed"] * 12 + ["done", "received", None])))
    rows.append((99, start + timedelta(days=400), 0, "received"))  # moves the watermark past all that is due
    rows.sort(key=lambda r: (r[1], r[0]))
    cuts = [0, 150, 151, 300, len(rows) - 1, len(rows)]
    (tmp_path / "in").mkdir()
    for n, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        frame = pd.DataFrame(rows[a:b], columns=["key", "ts", "seq", "kind"]).astype({"ts": "datetime64[us]"})
        frame.to_parquet(tmp_path / "in" / f"{n}.parquet")
        os.utime(tmp_path / "in" / f"{n}.parquet", (1_700_000_000 + n * 60,) * 2)
    with streaming.with_timers(spark):
        stream = streaming.source(spark, str(tmp_path / "in"), "key long, ts timestamp_ntz, seq long, kind string", 1).selectExpr("key", "cast(ts as timestamp) AS ts", "seq", "kind")
        got = told(streaming.drained(retried(stream, HOUR, 60 * HOUR), "retried-batches"))
    plain = [(k, millis(t), s, kind) for k, t, s, kind in rows]
    want = walk(plain, HOUR, 60 * HOUR, max(r[1] for r in plain) - 600_000)
    assert got == want and {"gave_up", "timed_out", "done"} <= {r[2] for r in got}
    ended, tries = sum(r[2] != "try" for r in got), sum(r[2:] == ("try", 1) for r in got)
    assert tries - ended == 1  # only the last message is still in the store


def test_backoff():
    assert [backoff(10, n) for n in (1, 2, 5, 9)] == [20, 40, 320, 320]
