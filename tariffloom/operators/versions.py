"""Sinks as joins: upserts, snapshots, versions, tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_new(target: DataFrame, rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """target and those rows whose key it lacks, the first of equals."""
    w = Window.partitionBy(*keys).orderBy(*order)
    first = rows.withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    return target.unionByName(first.join(target.select(*keys), keys, "left_anti"))


def replace_rows(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows, and what of target has another key."""
    return rows.unionByName(target.join(rows.select(*keys), keys, "left_anti"))


def snapshot(current: DataFrame, incoming: DataFrame, key: str, values: list[str]) -> DataFrame:
    """Current rows after an import: incoming ones are active with their values, those it lacks are retired, not deleted; with the action for each."""
    a, b = current.alias("a"), incoming.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full")
    gone = F.col(f"b.{key}").isNull()
    action = F.when(gone, "retired").when(F.col(f"a.{key}").isNull(), "inserted").otherwise("updated")
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), *[F.when(gone, F.col(f"a.{v}")).otherwise(F.col(f"b.{v}")).alias(v) for v in values], (~gone).alias("is_active"), action.alias("action"))


def next_versions(drafts: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """new with the version after the latest of its key, from one on."""
    latest = drafts.groupBy(key).agg(F.max("version").alias("__latest"))
    return new.join(latest, key, "left").withColumn("version", F.coalesce("__latest", F.lit(0)) + 1).drop("__latest")


def without(rows: DataFrame, deleted: DataFrame, key: str) -> DataFrame:
    return rows.join(deleted.select(key), key, "left_anti")


def set_or_clear(matrix: DataFrame, edits: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Cells of a matrix after edits: a value is set, a null clears the cell."""
    return edits.where(F.col(value).isNotNull()).unionByName(matrix.join(edits.select(*keys), keys, "left_anti"))


def unique_names(files: DataFrame, name: str, *order: Column) -> DataFrame:
    """Repeated names get -2, -3 ... before their extension, in the stated order."""
    w = Window.partitionBy(name).orderBy(*order)
    k = F.row_number().over(w)
    dot = F.regexp_extract(name, r"(\.[^.]*)$", 1)
    stem = F.substring(F.col(name), F.lit(1), F.length(name) - F.length(dot))
    return files.withColumn("__k", k).withColumn("unique_name", F.when(F.col("__k") == 1, F.col(name)).otherwise(F.concat(stem, F.lit("-"), F.col("__k").cast("string"), dot))).drop("__k")


def tenant_view(rows: DataFrame, company: str | int | None, column: str = "company_id", admin: bool = False) -> DataFrame:
    """What a tenant may see: its own rows, an administrator all, nobody in particular nothing."""
    return rows if admin else rows.where(F.lit(False)) if company is None else rows.where(F.col(column) == company)


def path_tenant(path: Column) -> Column:
    """The first segment of a storage path."""
    return F.get(F.split(path, "/"), 0)
