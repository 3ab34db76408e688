"""Exact nearest vectors, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _packed(size: int):
    """Rows (ids, embeddings) of up to ``size`` vectors, one after another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, size):
                part = batch.slice(start, size)
                flat = np.array(part.column(1).to_pylist(), dtype=np.float64).ravel()
                yield pa.record_batch([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([flat], pa.list_(pa.float64()))], names=["ids", "embeddings"])

    return run


def _scores(k: int):
    """Per pair of a query block and a row block the k best rows for each query; equal scores go by the row's id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                query_ids, queries, ids, rows = (c[i].values.to_numpy(zero_copy_only=False) for c in batch.columns)
                score = np.round(queries.reshape(len(query_ids), -1) @ rows.reshape(len(ids), -1).T, 6)
                best = np.lexsort((np.broadcast_to(ids, score.shape), -score), axis=1)[:, :k]
                n = best.shape[1]
                yield pa.record_batch([pa.array(np.repeat(query_ids, n)), pa.array(ids[best].ravel()), pa.array(np.take_along_axis(score, best, axis=1).ravel())], names=["query_id", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int, block: int = 256) -> DataFrame:
    """(query_id, vec_id, score, place): the k rows of largest dot product for each query, against all rows.

    Blocks of queries meet blocks of rows on Spark, so any number of queries is
    answered and none goes through the driver. A pair of blocks sends on k rows
    per query at most.
    """
    packed = "ids array<long>, embeddings array<double>"
    asked = queries.select("query_id", "embedding").repartition("query_id").mapInArrow(_packed(block), packed).toDF("query_ids", "queries")
    rows = vectors.select("vec_id", "embedding").mapInArrow(_packed(16 * block), packed)
    found = asked.crossJoin(rows).mapInArrow(_scores(k), "query_id long, vec_id long, score double")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
