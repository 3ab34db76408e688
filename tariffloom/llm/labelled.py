"""Bounded samples of labelled documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(parts: int, rest: int) -> Column:
    """Whether crc32 of doc_id as text leaves ``rest`` modulo ``parts``; a null doc_id isn't held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % parts == rest, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, trains: Column, most: int) -> DataFrame:
    """(doc_id, text, label) of at most ``most`` labelled documents, those of least hash; only this bounded list of ids is broadcast."""
    usable = labels.where(trains & F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    picked = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    return docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
