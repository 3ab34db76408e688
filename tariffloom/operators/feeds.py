"""Change feeds by cursor: pages of changes, starting at the latest, expired cursors, and appends to logs and indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def delta(changes: DataFrame, cursors: DataFrame, key: str, seq: str, page: int = 25, pages: int = 50) -> tuple[DataFrame, DataFrame]:
    """(messages, cursors): each key's changes after its cursor, ``page * pages`` of them at most, without tombstones and drafts.

    If more are left the cursor stays as it was, so nothing is skipped; else it
    moves to the last change. changes: deleted, draft; cursors: key, cursor.
    """
    w = Window.partitionBy(key).orderBy(seq)
    after = changes.join(cursors, key).where(F.col(seq) > F.col("cursor")).withColumn("__k", F.row_number().over(w))
    read = after.where(F.col("__k") <= page * pages)
    moved = after.groupBy(key).agg(F.max(seq).alias("last"), F.count("*").alias("n"))
    joined = cursors.join(moved, key, "left")
    cursor = F.when(F.col("n") <= page * pages, F.col("last")).otherwise(F.col("cursor"))
    return read.where("NOT deleted AND NOT draft").drop("__k", "cursor"), joined.select(key, cursor.alias("cursor"), (F.coalesce("n", F.lit(0)) <= page * pages).alias("complete"))


def primed(changes: DataFrame, key: str, seq: str) -> DataFrame:
    """(key, cursor) at each key's latest change, so that a first poll reads no history."""
    return changes.groupBy(key).agg(F.max(seq).alias("cursor"))


def resumed(cursors: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    """(key, cursor, primed): a cursor before the oldest change that is kept (key, oldest, latest) has expired and starts again at the latest; what came in between is lost by design."""
    joined = cursors.join(kept, key, "left")
    expired = F.coalesce(F.col("cursor") < F.col("oldest") - 1, F.lit(False))
    return joined.select(key, F.when(expired, F.col("latest")).otherwise(F.col("cursor")).alias("cursor"), expired.alias("primed"))


def appended(index: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """An index after an append: rows whose key it has are left out, so a repeated append adds nothing. On storage, append only ``new``'s share."""
    fresh = new.join(index.select(*keys), keys, "left_anti")
    return index.withColumn("is_new", F.lit(False)).unionByName(fresh.dropDuplicates(keys).withColumn("is_new", F.lit(True)))
