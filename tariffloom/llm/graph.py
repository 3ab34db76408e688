"""Connected components by alternating large and small stars, for edges that stay distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, join_groups


def _pairs(frame: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """A row (u, v) for each named pair of columns of each row."""
    both = F.explode(F.array(*[F.struct(F.col(a).alias("u"), F.col(b).alias("v")) for a, b in pairs])).alias("e")
    return frame.select(both).select("e.u", "e.v")


def _star(edges: DataFrame, large: bool, n: int) -> DataFrame:
    """One star step on the n edges (u, v) with u > v; least neighbours are found by a map-side combined min, and a node with many edges doesn't take them all into one task."""
    if large:
        both = _pairs(edges, ("u", "v"), ("v", "u"))
    else:
        both = edges
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    joined = join_groups(both, least, ["u"], "m", deal="v", total=2 * n if large else n)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = _pairs(joined, ("v", "m"), ("u", "m"))
    return out.where("u != v").distinct()


def components(edges: DataFrame, a: str, b: str, limit: int = 60) -> DataFrame:
    """(node, root) for each node on an edge; root is the least node of the component.

    Stars alternate until the edges no longer change, which takes a number of
    rounds in the order of the logarithm of a component's size. ``limit`` only
    guards against an endless loop and raises when reached.
    """
    now = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u != v").distinct())
    seen = None
    for _ in range(limit):
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("s")).first()
        if state == seen or not state["n"]:
            return _pairs(now, ("u", "v"), ("v", "v")).toDF("node", "root").distinct()
        seen = state
        now = cut(_star(_star(now, True, state["n"]), False, state["n"]))
    raise RuntimeError(f"components did not settle in {limit} rounds")
