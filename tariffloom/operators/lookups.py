"""Lookups in stages: the first stage that knows an answer gives it."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import fresh_path, stored

def staged(asked: DataFrame, key: str, *stages: DataFrame) -> DataFrame:
    """asked with stage and answer; each stage is a frame (key, answer) of candidates, and counts only if it has just one answer for the key.

    The stages' candidates meet in one aggregation, so a lookup of many stages
    is one shuffle and not a chain of joins.
    """
    every = None
    for n, stage in enumerate(stages, 1):
        one = stage.select(key, "answer", F.lit(n).alias("stage"))
        every = one if every is None else every.unionByName(one)
    single = every.groupBy(key, "stage").agg(F.count_distinct("answer").alias("n"), F.min("answer").alias("answer")).where("n = 1")
    best = single.groupBy(key).agg(F.min(F.struct("stage", "answer")).alias("b")).select(key, "b.stage", "b.answer")
    return asked.join(best, key, "left")


def single(master: DataFrame, key: str) -> DataFrame:
    """(key, answer) of the master's keys with just one answer: a stage that meets it by equality needs no others, and a code that many rows share brings none together."""
    return master.groupBy(key).agg(F.min("answer").alias("answer"), F.max("answer").alias("__last")).where("answer = __last").drop("__last")


def by_priority(frames: list[DataFrame], key: str, columns: list[str]) -> DataFrame:
    """Rows of several sources of the same data: of each key the row of the first source that has it."""
    every = None
    for n, frame in enumerate(frames):
        one = frame.select(key, *columns, F.lit(n).alias("source"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy(key).agg(F.min(F.struct("source", *columns)).alias("r")).select(key, "r.*")


def reached(edges: DataFrame, parent: str, child: str, roots: DataFrame, root: str) -> DataFrame:
    """(node, depth) of all that is reached from the roots; each node once, at its least depth.

    A level is one join with what is new; the walk ends when a level brings
    nothing new, so cycles do no harm and no depth is too deep. Levels are stored
    once, as parts of one table, so a level costs no more for those before it, and
    Spark knows how small it is. (A recursive common table expression keeps no
    visited set, so a cycle in it never ends, and it has a bound on its rows.)
    """
    spark = edges.sparkSession
    links, folder = stored(edges.select(F.col(parent).alias("__parent"), F.col(child).alias("__child"))), fresh_path(spark, "levels")
    level = roots.select(F.col(root).alias("node"))
    for depth in count(1):
        path = f"{folder}/depth={depth - 1}"
        level.write.parquet(path)
        level, seen = spark.read.parquet(path), spark.read.parquet(folder)
        if level.isEmpty():
            return seen.select("node", "depth")
        step = level.join(links, F.col("node") == F.col("__parent")).select(F.col("__child").alias("node")).distinct()
        level = step.join(seen.select("node"), "node", "left_anti")


def natural_key(x: Column) -> list[Column]:
    """Sort keys by which numbers at the end of a name count as numbers."""
    return [F.regexp_replace(x, "[0-9]+$", ""), F.regexp_extract(x, "([0-9]+)$", 1).try_cast("decimal(38,0)"), x]


def modal(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key, the least of equals."""
    counts = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min_by(value, F.struct(-F.col("n"), value)).alias(value), F.max("n").alias("n"))


def instruction_spans(texts: DataFrame, key: str, text: str, mark: str) -> DataFrame:
    """(key, k, part): the pieces of a text from one mark to the next."""
    starts = F.filter(F.split(text, f"(?={mark})"), lambda p: p.rlike(f"^{mark}"))
    return texts.select(key, F.posexplode(starts).alias("k", "part")).select(key, "k", F.trim("part").alias("part"))


