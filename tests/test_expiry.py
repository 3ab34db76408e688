"""Identifiers that expire, over batches and a restart, against a plain walk."""

import os
import random
from datetime import datetime, timedelta

import pandas as pd

from tariffloom import streaming
from tariffloom.streaming.expiry import attached

DAY = 86_400_000


def walk(rows, lifetime):
    owner, out = {}, {}
    for user, event, ts, identifier in sorted(rows, key=lambda r: (r[2], r[1])):
        job, seen = owner.get((user, identifier), (event, ts))
        if lifetime is not None and ts - seen > timedelta(milliseconds=lifetime):
            job = event
        owner[user, identifier] = job, ts
        out[event] = (user, job)
    return out


def write(folder, batches):
    folder.mkdir(exist_ok=True)
    for n, rows in batches:
        frame = pd.DataFrame(rows, columns=["user_id", "event_id", "ts", "identifier"]).astype({"user_id": "Int64", "event_id": "Int64", "ts": "datetime64[us]"})
        frame.to_parquet(folder / f"{n}.parquet")
        os.utime(folder / f"{n}.parquet", (1_700_000_000 + n * 60,) * 2)


def run(spark, folder, out, lifetime):
    """Reads what is there with the checkpoint beside ``out``, one file a batch."""
    with streaming.with_timers(spark):
        stream = streaming.source(spark, str(folder), "user_id long, event_id long, ts timestamp_ntz, identifier string", 1).selectExpr("user_id", "event_id", "cast(ts AS timestamp) AS ts", "identifier")
        writer = attached(stream, lifetime).writeStream.option("checkpointLocation", f"{out}-checkpoint").trigger(availableNow=True)
        writer.format("parquet").option("path", str(out)).start().awaitTermination()
    return {r.event_id: (r.user_id, r.job) for r in spark.read.schema("user_id long, event_id long, job long").parquet(str(out)).collect()}


def made():
    rng, at, rows = random.Random(5), datetime(2026, 1, 1), []
    for event in range(600):
        at += timedelta(hours=rng.choice([0, 0.1, 1, 3, 30]))
        rows.append((rng.randint(0, 3), event, at, rng.choice(["a", "b", "c", None])))
    return rows


def test_restart_equals_one_walk_and_state_is_let_go(spark, tmp_path):
    rows, cuts = made(), [0, 80, 81, 300, 600]
    late = [(9, 1000, rows[-1][2] + timedelta(days=400), "z")]  # moves the watermark on, and the next batch lets timers run
    last = [(9, 1001, late[0][2] + timedelta(days=1), "z")]
    batches = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)] + [late, last]
    for lifetime in (2 * DAY, None):
        folder, out = tmp_path / f"in-{lifetime}", tmp_path / f"out-{lifetime}"
        write(folder, list(enumerate(batches))[:2])
        run(spark, folder, out, lifetime)
        write(folder, list(enumerate(batches))[2:])
        assert run(spark, folder, out, lifetime) == walk([r for b in batches for r in b], lifetime)
        with streaming.with_timers(spark):
            kept = spark.read.format("statestore").option("stateVarName", "owners").load(f"{out}-checkpoint").count()
        assert kept == (1 if lifetime else len({(r[0], r[3]) for b in batches for r in b}))


def test_odd_rows(spark, tmp_path):
    t = datetime(2026, 1, 1)
    write(tmp_path / "in", [(0, [(1, 5, t, "a"), (1, 5, t, "a"), (None, 6, t, "a"), (1, None, t, "a"), (1, 7, None, "a"), (1, 8, t, None), (1, 9, t, "")])])
    assert run(spark, tmp_path / "in", tmp_path / "out", DAY) == {5: (1, 5), 8: (1, 8), 9: (1, 8)}


def test_what_expires_within_a_batch_is_never_stored():
    from tariffloom.streaming.expiry import _Owners

    stored = []

    class Store:
        def exists(self):
            return False

        def updateValue(self, one, value):  # noqa: N802
            stored.append(one)

    owners = _Owners(DAY, 600_000)
    owners.owners = Store()
    owners.handle = type("Handle", (), {"listTimers": lambda self: iter([1])})()
    at = [n * DAY * 1000 // 4 for n in range(40)]
    batch = pd.DataFrame({"user_id": 1, "identifier": [f"i{n}" for n in range(40)], "at": at, "event_id": range(40)})
    out = pd.concat(owners.handleInputRows((0,), iter([batch]), None))
    assert list(out.job) == list(range(40))
    assert stored == [(1, f"i{n}") for n in range(35, 40)]  # all 40 before
