"""Structured Streaming: sources, keyed state and sinks that survive restarts."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.matching import NEEDED, STRONG, WEIGHTS
from ..storage import fresh_path

_STORE = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files as a stream; offsets live in the query's checkpoint, so nothing is read twice."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def drained(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over all that is there and returns what it wrote.

    Append goes to a Parquet sink, whose log makes each batch count once. Complete
    results replace the table batch by batch; for update results see ``merged_updates``.
    """
    if mode not in ("append", "complete"):
        raise ValueError(f"no such mode here: {mode}")
    spark = stream.sparkSession
    target, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", target).start()
    else:
        query = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(target)).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(target)


def unique(stream: DataFrame, keys: list[str], at: str, delay: str) -> DataFrame:
    """The first of each key within the watermark; replays of a message are dropped."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(keys)


def tumbling(stream: DataFrame, at: str, delay: str, width: str, *keys: str) -> DataFrame:
    """Counts by window, each sent once the watermark has passed its end."""
    counted = stream.withWatermark(at, delay).groupBy(F.window(at, width), *keys).agg(F.count("*").alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n")


def merged_updates(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Runs a stream in update mode over all that is there and returns the latest row of each key.

    A batch overwrites the folder of its own number, so one that is run again
    after a failure counts once.
    """
    spark = stream.sparkSession
    target, checkpoint = fresh_path(spark, name), fresh_path(spark, f"{name}-checkpoint")
    writer = stream.writeStream.option("checkpointLocation", checkpoint).outputMode("update").trigger(availableNow=True)
    writer.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{target}/batch={n}")).start().awaitTermination()
    rows = spark.read.schema(f"{_ddl(stream)}, batch long").option("basePath", target).parquet(target)
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("r")).select(*keys, "r.*")


def _ddl(frame: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)


class _Matcher(StatefulProcessor):
    """Who owns each identifier of a company, as a map in the state store: a batch reads and writes each of its own identifiers once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.owners = handle.getMapState("owners", "company long, identifier string", "job long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        batch = pd.concat(list(rows)).sort_values(["ts", "message"])
        known, new, some = {}, {}, self.owners.exists()

        def owner(one: tuple[int | None, str]) -> int | None:
            if one not in known:
                value = self.owners.getValue(one) if some else None
                known[one] = value and value[0]
            return known[one]

        out = []
        for company, message, ids, n in zip(batch.company, batch.message, batch.identifiers, batch.recognised, strict=True):
            company = None if pd.isna(company) else int(company)
            held = {i: owner((company, i)) for i in sorted(set(ids))}
            outcome, job, score = self._decided(message, held, n)
            if outcome in ("created", "attached"):
                fresh = {(company, i): job for i, was in held.items() if was is None}  # the first job keeps an identifier
                known.update(fresh)
                new.update(fresh)
            out.append((company, message, outcome, job, score))
        for one, job in new.items():
            self.owners.updateValue(one, (job,))
        made = pd.DataFrame(out, columns=["company", "message", "outcome", "job", "score"])
        yield made.astype({"company": "Int64", "job": "Int64"})

    @staticmethod
    def _decided(message: int, held: dict[str, int | None], recognised: int) -> tuple[str, int | None, int]:
        kinds = {i.split(":", 1)[0] for i in held}
        score: dict[int, int] = {}
        threads = set()
        for i, job in held.items():
            if job is not None:
                kind = i.split(":", 1)[0]
                score[job] = score.get(job, 0) + WEIGHTS[kind]
                if kind == "conversation":
                    threads.add(job)
        top = max(score.values(), default=0)
        best = [j for j, s in score.items() if s == top]
        if top >= NEEDED and len(best) > 1:
            return "ambiguous", None, top
        job = best[0] if top >= NEEDED else threads.pop() if len(threads) == 1 and not kinds & set(STRONG) else None
        if job is None and not recognised:
            return "skipped", None, top
        return ("created", int(message), top) if job is None else ("attached", job, top)

    def close(self) -> None:
        pass


def matched(stream: DataFrame, name: str, buckets: int = 256) -> DataFrame:
    """(company, message, outcome, job, score): each message scored against the identifiers that earlier messages of its company gave to jobs, oldest first.

    stream: company, message, ts, identifiers (array of kind:value), recognised
    (number of known documents). One job that reaches the threshold takes the
    message, several of the same score make it ambiguous, a thread alone decides
    without a strong identifier; what fits no job opens one if it has a known
    document. Messages of a later batch see all of an earlier one. The order
    within a company is part of the meaning, so a company's batch is in one task;
    ``source`` bounds it by the files of a trigger. Companies share a fixed
    number of buckets by hash, each one call of Python, which stays with a
    checkpoint.
    """
    none = F.array().cast("array<string>")
    bucket = F.pmod(F.xxhash64("company"), F.lit(buckets)).cast("int").alias("bucket")
    keyed = stream.select(bucket, "company", "message", "ts", F.array_compact(F.coalesce("identifiers", none)).alias("identifiers"), F.coalesce("recognised", F.lit(0)).alias("recognised")).groupBy("bucket")
    with with_timers(stream.sparkSession):
        return drained(keyed.transformWithStateInPandas(_Matcher(), "company long, message long, outcome string, job long, score long", "Append", "None"), name)


@contextmanager
def with_timers(spark: SparkSession) -> Iterator[None]:
    """The state store that keeps maps and timers, while streams start; the session's own setting comes back."""
    before = spark.conf.get(_STORE, None)
    spark.conf.set(_STORE, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_STORE)
        else:
            spark.conf.set(_STORE, before)


def job_facts(stream: DataFrame) -> DataFrame:
    """(job, codes, stage_rank) for update mode: the codes of a job's documents united, its stage the furthest seen; late documents add and never take back.

    stream: job, codes (array), stage_rank.
    """
    each = stream.select("job", "stage_rank", F.explode_outer("codes").alias("code"))
    return each.groupBy("job").agg(F.array_sort(F.collect_set("code")).alias("codes"), F.max("stage_rank").alias("stage_rank"))
