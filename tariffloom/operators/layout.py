"""Tables from boxes: rows by the gaps between them, columns by the most common layout, cells by the middle of their boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import prose


def rows_by_gaps(boxes: DataFrame, key: str, gap: float = 0.0) -> DataFrame:
    """boxes (key, x0, x1, y0, y1, text) with ``row`` from 0: from the top, a row ends where the next box begins more than ``gap`` below all before it.

    Both windows share one shuffle and one sort, and stream through a table, however long.
    """
    w = Window.partitionBy(key).orderBy("y0", "x0", "x1", "y1", "text")
    below = F.max("y1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = boxes.withColumn("__new", F.coalesce((F.col("y0") - below > gap).cast("int"), F.lit(0)))
    return marked.withColumn("row", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def column_bounds(boxes: DataFrame, key: str) -> DataFrame:
    """(key, bounds): the layout, an array of (x0, x1) to one place, that most rows of a table have; of equal ones that which comes first."""
    cell = F.struct(F.round("x0", 1).alias("x0"), F.round("x1", 1).alias("x1"))
    layouts = boxes.groupBy(key, "row").agg(F.array_sort(F.collect_list(cell)).alias("bounds"))
    counted = layouts.groupBy(key, "bounds").agg(F.count("*").alias("n"), F.min("row").alias("first"))
    return counted.groupBy(key).agg(F.max_by("bounds", F.struct("n", -F.col("first"))).alias("bounds"))


def column_of(bounds: Column, middle: Column) -> Column:
    """The first column that holds the middle; outside all, that whose middle is nearest, the first of equal ones. bounds: (x0, x1, middle)."""
    away = lambda b: F.when(middle.between(b["x0"], b["x1"]), -1.0).otherwise(F.abs(b["middle"] - middle))
    return F.array_min(F.transform(bounds, lambda b, i: F.struct(away(b).alias("away"), i.alias("i"))))["i"]


def logical_rows(boxes: DataFrame, key: str, gap: float = 0.0) -> DataFrame:
    """(key, row, cells): the text of each column of each row, empty where it has none; texts that share a cell are joined in the order of their boxes.

    Boxes without a table or without a place are left out; so are a table's
    boxes without text, except that they shape layouts. A row holds one cell a
    box at most, so its arrays are bounded by a row of the table. Boxes are dealt
    once, by table, and all that follows streams through windows in the same task:
    boxes become rows, then a table's rows are sorted by layout, counted, and meet
    the commonest one without a join.
    """
    text = F.coalesce("text", F.lit(""))
    placed = boxes.where(" AND ".join(f"{c} IS NOT NULL" for c in (key, "x0", "x1", "y0", "y1"))).select(key, "x0", "x1", "y0", "y1", F.when(text.rlike("[^!-~]"), prose(text)).otherwise(text).alias("text"))
    at = Window.partitionBy(key, "row").orderBy("x0", "x1", "y0", "text")
    x0, x1 = _tenth("x0"), _tenth("x1")
    # a hash of one number tells all numbers apart, and arrays of them sort without being rewritten at each comparison, as those of doubles are
    box = F.struct(x0.alias("x0"), x1.alias("x1"), ((x0 + x1) / 2).alias("middle"), F.xxhash64(x0).alias("h0"), F.xxhash64(x1).alias("h1"), ((F.col("x0") + F.col("x1")) / 2).alias("at"), "text")
    every = F.collect_list(box).over(at.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    listed = rows_by_gaps(placed, key, gap).select(key, "row", F.row_number().over(at).alias("__k"), every.alias("boxes")).where("__k = 1")
    shape = F.sort_array("boxes")
    shaped = listed.select(key, "row", "boxes", shape["h0"].alias("h0"), shape["h1"].alias("h1"))
    same = Window.partitionBy(key, "h0", "h1")
    counted = shaped.select(key, "row", "boxes", F.count("*").over(same).alias("n"), F.min("row").over(same).alias("first"))
    bounds = F.transform(shape, lambda b: F.struct(b["x0"].alias("x0"), b["x1"].alias("x1"), b["middle"].alias("middle")))
    # columns that hold their own middle and no other's
    apart = F.forall(F.zip_with(bounds, F.slice(bounds, 2, F.size("boxes")), lambda b, after: b["middle"].between(b["x0"], b["x1"]) & F.coalesce(b["x1"] < after["x0"], F.lit(True))), lambda x: x)
    layout = F.max(F.when(F.col("row") == F.col("first"), F.struct("n", (-F.col("first")).alias("first"), bounds.alias("bounds"), apart.alias("apart")))).over(Window.partitionBy(key))
    met = counted.select(key, "row", "boxes", layout.alias("layout")).select(key, "row", "boxes", "layout.bounds", "layout.apart")
    placed_texts = F.transform(F.filter("boxes", lambda b: b["text"] != ""), lambda b: F.struct(column_of(F.col("bounds"), b["at"]).alias("i"), b["text"].alias("text")))
    cell = lambda texts, i: F.array_join(F.filter(texts, lambda t: t["i"] == i)["text"], " ")
    # the array of one holds the texts' columns, else they would be found again for each cell
    cells = F.transform(F.array(placed_texts), lambda texts: F.transform(F.sequence(F.lit(0), F.size("bounds") - 1), lambda i: cell(texts, i)))[0]
    regular = F.col("apart") & (F.col("boxes.at") == F.col("bounds.middle"))
    return met.select(key, "row", F.when(regular, F.col("boxes.text")).otherwise(cells).alias("cells"))


def _tenth(column: str) -> Column:
    """Rounded to one place; whole numbers are as they are, without a decimal made of each."""
    x = F.col(column)
    return F.when(x == F.floor(x), x).otherwise(F.round(x, 1))
