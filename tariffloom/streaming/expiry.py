"""Messages that follow their identifier to its job, and identifiers that expire.

State is one small row for each user and identifier, kept in a fixed number of
buckets by hash: a batch reads and writes only its own identifiers, a busy user is
spread over all buckets, and a bucket is one call of Python. Timers sweep a bucket
eight times a lifetime at most. What is decided depends on the messages' own times,
never on when a timer happens to run, so a restart or other batches give the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

SCHEMA = "user_id long, event_id long, job long"


class _Owners(StatefulProcessor):
    """By user and identifier: the owning job and when the identifier was last heard of, in microseconds."""

    def __init__(self, lifetime: int | None, delay: int):
        self.lifetime, self.delay = lifetime, delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.owners = handle, handle.getMapState("owners", "user_id long, identifier string", "job long, seen long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch, jobs, held = pd.concat(list(rows)).sort_values(["at", "event_id"]), [], {}
        some = self.owners.exists()  # each call of the store is a round trip: one here saves one for each identifier of a first batch
        for user, identifier, at, event in zip(batch["user_id"], batch["identifier"], batch["at"], batch["event_id"], strict=True):
            one = (int(user), identifier)
            if one not in held:
                kept = self.owners.getValue(one) if some else None
                held[one] = tuple(kept) if kept else (int(event), int(at))
            job, seen = held[one]
            if self.lifetime is not None and at - seen > self.lifetime * 1000:
                job = int(event)
            held[one] = job, max(seen, int(at))
            jobs.append(job)
        if self.lifetime is not None:  # the next batch has no message older than the watermark, so none that these could still take
            past = int(batch["at"].max()) - (self.lifetime + self.delay + 1) * 1000
            held = {one: owner for one, owner in held.items() if owner[1] >= past}
        for one, owner in held.items():
            self.owners.updateValue(one, owner)
        if self.lifetime is not None and not any(True for _ in self.handle.listTimers()):
            self.wake(min(seen for _, seen in held.values()))
        yield pd.DataFrame({"user_id": batch["user_id"], "event_id": batch["event_id"], "job": jobs}).astype("int64")

    def wake(self, seen: int) -> None:
        """A timer for the end of the eighth of a lifetime in which what was last heard of then expires."""
        step = max(self.lifetime // 8, 1)
        self.handle.registerTimer((seen // 1000 + self.lifetime + 1) // step * step + step)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        past = (int(timerValues.getCurrentWatermarkInMs()) - self.lifetime) * 1000
        held = [(tuple(one), owner[1]) for one, owner in self.owners.iterator()]
        for one, seen in held:
            if seen < past:
                self.owners.removeKey(one)
        left = [seen for _, seen in held if seen >= past]
        if left:
            self.wake(min(left))
        yield pd.DataFrame({"user_id": [], "event_id": [], "job": []}).astype("int64")

    def close(self) -> None:
        pass


def attached(messages: DataFrame, lifetime_ms: int | None = None, delay: str = "10 minutes", buckets: int = 256) -> DataFrame:
    """(user_id, event_id, job): a message goes to the job of its identifier, else it opens one that bears its own number.

    messages: a stream of user_id, event_id, ts, identifier; rows without a user,
    event or time are left out, those without an identifier share one a user. An
    identifier expires when it is not heard of for longer than its lifetime, by
    the messages' own times; the next message with it opens a job. Without a
    lifetime none expires. A batch is taken by time; a message older than what
    its identifier has seen joins its present job. State without a lifetime
    grows with the identifiers, with one it holds those of the last lifetime, an
    eighth of it, and ``delay``; what has expired within its own batch is never
    stored. The number of buckets stays with a checkpoint.
    Needs the state store with timers, see ``with_timers``.
    """
    rows = messages.where("user_id IS NOT NULL AND event_id IS NOT NULL AND ts IS NOT NULL")
    marked = rows.selectExpr("user_id", "event_id", "ts", "unix_micros(ts) AS at", "coalesce(cast(identifier AS STRING), '') AS identifier").withWatermark("ts", delay)
    dealt = marked.selectExpr("*", f"cast(pmod(xxhash64(user_id, identifier), {buckets}) AS INT) AS bucket")
    return dealt.groupBy("bucket").transformWithStateInPandas(_Owners(lifetime_ms, int(pd.Timedelta(delay).total_seconds() * 1000)), SCHEMA, "Append", "EventTime")
