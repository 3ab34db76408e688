"""Small helpers on the session: the folder that all executors share, and lineage cuts through it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import ship
from ..storage import fresh_path, shared_folder

BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def cut(frame: DataFrame) -> DataFrame:
    """Checkpoints reliably, so that later uses neither recompute nor depend on one executor."""
    shared_folder(frame.sparkSession)
    return frame.checkpoint()


def written(frame: DataFrame, name: str) -> DataFrame:
    """Writes a Parquet table to the shared folder and reads it back."""
    path = fresh_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.parquet(path)


HOT = 2000


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], value: str, deal: str = "doc_id", total: int | None = None, outer: bool = False) -> DataFrame:
    """``rows`` with the ``value`` of their group, where ``groups`` has a row (keys, n, value) for each group of n rows; rows without a group go, or with ``outer`` have a null.

    Groups with more than one in HOT of all grouped rows, HOT of them at most,
    are broadcast; their rows meet them where they are and are dealt by ``deal`` in
    the shuffle that joins the other groups, so no task gets a large group.
    ``total`` is the sum of n, if known.
    """
    if total is None:
        groups = cut(groups)
        total = groups.agg(F.sum("n")).first()[0] or 0
    hot = groups.where(F.col("n") * HOT > total).select(*keys, F.col(value).alias("of_hot"))
    cold = groups.where(F.col("n") * HOT <= total).select(*[F.col(k).alias(f"of_{k}") for k in keys], value)
    met = rows.join(F.broadcast(hot), keys, "left")
    dealt = [F.when(F.col("of_hot").isNotNull(), F.xxhash64(deal)).otherwise(F.col(k)).alias(f"to_{k}") for k in keys]
    met = met.select(*rows.columns, "of_hot", *dealt)
    same = F.col("of_hot").isNull()
    for k in keys:
        same = (F.col(f"to_{k}") == F.col(f"of_{k}")) & same
    out = met.join(cold, same, "left").select(*rows.columns, F.coalesce("of_hot", value).alias(value))
    return out if outer else out.where(F.col(value).isNotNull())


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Reads an input table; the package goes along to the executors.

    Texts can be long, so batches to Python are kept to ``BATCH_BYTES`` and
    ``BATCH_ROWS``, which bounds what a task holds on both sides.
    """
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)
    return spread(ship(spark).read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(frame: DataFrame) -> DataFrame:
    """Deals the rows of a table that has fewer splits than there are cores, so that a small file doesn't run on one of them."""
    cores = frame.sparkSession.sparkContext.defaultParallelism
    return frame if frame.rdd.getNumPartitions() >= cores else frame.repartition(cores)
