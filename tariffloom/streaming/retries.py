"""Messages that are tried again after failures: attempts and the next due time in the state store, moved on by timers.

A message's state is two numbers and one timer. It goes when the message is done,
given up after MOST attempts, or without any outcome for the patience, so the store
holds no more than the messages that are under way.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

#: Attempts before a message is given up, and the longest back-off in base units.
MOST, LONGEST = 5, 32
SCHEMA = "key long, at long, action string, attempt int"
STATE = "attempts int, until long, waits boolean"


def backoff(base: int, failures: int) -> int:
    """Milliseconds until the next attempt after so many failures."""
    return base * min(2**failures, LONGEST)


class Attempts:
    """One message: attempts so far, and until when it waits for its next attempt or for an outcome; what happens goes to ``out``."""

    def __init__(self, base: int, patience: int, state: tuple | None):
        self.base, self.patience, self.out = base, patience, []
        self.attempts, self.until, self.waits = state or (0, None, False)

    def pass_time(self, now: int) -> None:
        """What is due up to ``now``."""
        while self.until is not None and self.until <= now:
            if self.waits:
                self.start(self.until)
            else:
                self.end(self.until, "timed_out")

    def start(self, at: int) -> None:
        self.attempts += 1
        self.out.append((at, "try", self.attempts))
        self.until, self.waits = at + self.patience, False

    def end(self, at: int, action: str) -> None:
        self.out.append((at, action, self.attempts))
        self.attempts, self.until, self.waits = 0, None, False

    def on(self, at: int, kind: str | None) -> None:
        self.pass_time(at)
        if kind == "received" and not self.attempts:
            self.start(at)
        elif kind == "done" and self.attempts:
            self.end(at, "done")
        elif kind == "failed" and self.attempts and not self.waits:
            if self.attempts >= MOST:
                self.end(at, "gave_up")
            else:
                self.until, self.waits = at + backoff(self.base, self.attempts), True


class _Retrier(StatefulProcessor):
    def __init__(self, base: int, patience: int):
        self.base, self.patience = base, patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("attempts", STATE)

    def _load(self) -> Attempts:
        return Attempts(self.base, self.patience, tuple(self.state.get()) if self.state.exists() else None)

    def _store(self, key: tuple, one: Attempts) -> Iterator[pd.DataFrame]:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if one.attempts:
            self.state.update((one.attempts, one.until, one.waits))
            self.handle.registerTimer(one.until)
        elif self.state.exists():
            self.state.clear()
        yield pd.DataFrame([(key[0], *row) for row in one.out], columns=["key", "at", "action", "attempt"]).astype({"key": "int64", "at": "int64", "attempt": "int32"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        one, batch = self._load(), pd.concat(list(rows)).sort_values(["at", "seq"])
        for at, kind in zip(batch["at"], batch["kind"], strict=True):
            one.on(int(at), kind)
        yield from self._store(key, one)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        one = self._load()
        one.pass_time(int(timerValues.getCurrentWatermarkInMs()))
        yield from self._store(key, one)

    def close(self) -> None:
        pass


def retried(messages: DataFrame, base_ms: int, patience_ms: int, delay: str = "10 minutes") -> DataFrame:
    """(key, at, action, attempt) as they fall due: try, done, gave_up and timed_out; ``at`` in milliseconds.

    messages: a stream of key, ts, seq, kind (received, failed, done; others and
    nulls change nothing). Event time counts: what is due before a row's time
    happens before the row, and without rows when the watermark passes it. A
    message's rows of one batch are taken by time; rows older than the watermark
    still count, as far as the state then allows. Needs the state store with
    timers, see ``with_timers``.
    """
    rows = messages.where("key is not null and ts is not null").withColumn("at", F.unix_millis("ts")).withWatermark("ts", delay)
    return rows.groupBy("key").transformWithStateInPandas(_Retrier(base_ms, patience_ms), SCHEMA, "Append", "EventTime")
