"""A change feed as a streaming source: cursors as offsets, a first start at the latest change, bounded polls, expired cursors.

``publish`` puts changes into a feed: a folder of chunks by sequence number, and a
small file that says how far the feed goes and from where on it is kept. The source
``changefeed`` reads it: the driver plans ranges of numbers, tasks read the chunks.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from ..ship import ship
from ..storage import fresh_path

CHUNK = 1000
#: Messages of a page, pages of a poll.
PAGE, PAGES = 25, 50


def _opened(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))


def _read(path: str) -> dict:
    system, name = _opened(path)
    if system.get_file_info(name).type.name == "NotFound":
        return {}
    with system.open_input_stream(name, compression=None) as file:
        return json.loads(file.read())


def _write(path: str, content: dict) -> None:
    """By way of another name, so that a reader never meets half a file."""
    system, name = _opened(path)
    system.create_dir(name.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(f"{name}.new", compression=None) as file:
        file.write(json.dumps(content).encode())
    system.move(f"{name}.new", name)


def publish(changes: DataFrame, seq: str, folder: str, chunk: int = CHUNK) -> None:
    """Adds changes (``seq`` from 1 on, deleted, draft, ...) to the feed in ``folder``."""
    state = _read(f"{folder}/feed.json")
    rows = changes.withColumn("chunk", F.expr(f"{seq} div {chunk}"))
    rows.repartition("chunk").sortWithinPartitions("chunk", seq).write.mode("append").partitionBy("chunk").parquet(f"{folder}/changes")
    latest = changes.agg(F.max(seq)).first()[0] or 0
    _write(f"{folder}/feed.json", {"oldest": 1} | state | {"seq": seq, "chunk": chunk, "latest": max(latest, state.get("latest", 0))})


def expire(folder: str, oldest: int) -> None:
    """From now on the feed gives no change before ``oldest``."""
    _write(f"{folder}/feed.json", _read(f"{folder}/feed.json") | {"oldest": oldest})


class Range(InputPartition):
    """Changes after ``after`` up to ``last`` of one chunk."""

    def __init__(self, chunk: int, after: int, last: int):
        self.chunk, self.after, self.last = chunk, after, last


class ChangeFeed(DataSource):
    """Options: path, schema (DDL), cursor (path of a file); page and pages bound what a poll reads; start: ``latest`` or a number."""

    @classmethod
    def name(cls) -> str:
        return "changefeed"

    def schema(self) -> str:
        return self.options["schema"]

    def streamReader(self, schema) -> ChangeFeedReader:  # noqa: N802
        return ChangeFeedReader(schema, self.options)


class ChangeFeedReader(DataSourceStreamReader):
    """Offsets are sequence numbers.

    Spark keeps them in the query's checkpoint, so a batch that failed is planned
    again with the same bounds. It doesn't tell a reader where a restarted query
    stands, though, and that is needed to bound a poll; so the end of each planned
    batch is put into the cursor file. The file is never ahead of the offset log,
    as offsets are logged first, and where it lags a batch, the end of that batch
    is the end that it would plan again.

    A cursor before the oldest change that is kept has expired: the feed starts
    again at its latest change, and what came in between is lost by design.
    """

    def __init__(self, schema, options: dict):
        self.schema, self.path, self.cursor, self.start = schema, options["path"], options["cursor"], options.get("start", "latest")
        self.most = int(options.get("page", PAGE)) * int(options.get("pages", PAGES))

    def _feed(self) -> dict:
        return _read(f"{self.path}/feed.json")

    def _state(self) -> dict:
        """Where the first batch started, which stays as it is, and where the last planned one ends."""
        state = _read(self.cursor)
        if not state:
            start = self._feed().get("latest", 0) if self.start == "latest" else int(self.start)
            state = {"start": start, "at": start}
            _write(self.cursor, state)
        return state

    def initialOffset(self) -> dict:  # noqa: N802
        return {"at": self._state()["start"]}

    def latestOffset(self) -> dict:  # noqa: N802
        feed, at = self._feed(), self._state()["at"]
        latest = max(at, feed.get("latest", 0))
        return {"at": latest if at < feed.get("oldest", 1) - 1 else min(at + self.most, latest)}

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        feed, after, last = self._feed(), start["at"], end["at"]
        state = self._state()
        if last > state["at"]:
            _write(self.cursor, state | {"at": last})
        if after >= last or after < feed["oldest"] - 1:
            return []
        size = feed["chunk"]
        return [Range(c, max(after, c * size - 1), min(last, (c + 1) * size - 1)) for c in range((after + 1) // size, last // size + 1)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds
        from pyspark.sql.pandas.types import to_arrow_schema

        system, name = _opened(f"{self.path}/changes/chunk={partition.chunk}")
        if system.get_file_info(name).type.name == "NotFound":
            return
        seq, wanted = self._feed()["seq"], to_arrow_schema(self.schema)
        at = ds.field(seq)
        inside = (at > partition.after) & (at <= partition.last) & ~ds.field("deleted") & ~ds.field("draft")
        found = ds.dataset(name, filesystem=system, format="parquet").to_table(filter=inside).sort_by(seq)
        yield from found.select(wanted.names).cast(wanted).to_batches()


def feed_stream(spark: SparkSession, folder: str, schema: str, cursor: str, **options) -> DataFrame:
    """The feed as a stream, without tombstones and drafts; ``cursor`` belongs to one query, as its checkpoint does."""
    ship(spark).dataSource.register(ChangeFeed)
    reader = spark.readStream.format("changefeed").option("path", folder).option("schema", schema).option("cursor", cursor)
    return reader.options(**options).load()


def poll(stream: DataFrame, target: str, checkpoint: str) -> None:
    """One poll: a batch of at most page * pages changes, written to ``target`` once."""
    stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class Subscription:
    """What one reader of a feed keeps: cursor, checkpoint and the messages it got. Each poll is a query of its own, so it resumes from what is stored."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, **options):
        self.spark, self.folder, self.schema, self.options = spark, folder, schema, options
        base = fresh_path(spark, "subscription")
        self.cursor, self.checkpoint, self.target = f"{base}/cursor.json", f"{base}/checkpoint", f"{base}/messages"

    def prime(self) -> None:
        """Puts the cursor at the feed's latest change without reading any."""
        self.poll()

    def poll(self) -> int:
        """Reads on; returns where the cursor stands."""
        poll(feed_stream(self.spark, self.folder, self.schema, self.cursor, **self.options), self.target, self.checkpoint)
        return _read(self.cursor)["at"]

    def drain(self) -> None:
        """Polls until the feed has no more; each poll resumes after the one before it."""
        at = self.poll()
        while (then := self.poll()) > at:
            at = then

    def messages(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.target)
