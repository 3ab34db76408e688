"""Tables drawn from the words of documents, and read back from their boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import layout as L
from .fixture import table


#: Bytes of a file of documents that a task takes: as boxes they are about a hundred times as much, and are sorted in memory.
TASK_BYTES = 2 << 20


def _documents(spark, sf_dir: str) -> DataFrame:
    """Documents dealt by id, so that their words need not be dealt as boxes; in tasks of the same size, however many documents there are."""
    d = table(spark, sf_dir, "documents")
    size = d._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    return d.select("doc_id", "text").repartition(max(spark.sparkContext.defaultParallelism, int(size) // TASK_BYTES), "doc_id")


def _boxes(spark, sf_dir: str) -> DataFrame:
    """Each document's words, three a row, as boxes; every seventh row is cut into slivers, in every fifth the boxes stand lower, and every ninth has its last box outside the table."""
    d = _documents(spark, sf_dir).select("doc_id", F.posexplode(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), " ")).alias("i", "word"))
    r, c = (F.col("i") / 3).cast("int"), F.col("i") % 3
    at = d.select("doc_id", r.alias("r"), c.alias("c"), "word", (F.col("doc_id") + r).alias("s"))
    x, y = F.col("c") * 100.0, F.col("r") * 12.0 + F.when(F.col("s") % 5 == 0, F.col("c") * 2.0).otherwise(0.0)
    cut = (F.col("s") % 7 == 0) & (F.length("word") > 3)
    whole = F.array(F.struct((x + F.when((F.col("s") % 9 == 0) & (F.col("c") == 2), 150.0).otherwise(0.0)).alias("x0"), F.col("word").alias("text"), F.lit(90.0).alias("w")))
    halves = F.array(F.struct(x.alias("x0"), F.substring("word", 1, 3).alias("text"), F.lit(30.0).alias("w")), F.struct((x + 40.0).alias("x0"), F.expr("substring(word, 4)").alias("text"), F.lit(50.0).alias("w")))
    out = at.withColumn("y0", y).select("doc_id", "y0", F.explode(F.when(cut, halves).otherwise(whole)).alias("b"))
    return out.select("doc_id", F.col("b.x0").alias("x0"), (F.col("b.x0") + F.col("b.w")).alias("x1"), "y0", (F.col("y0") + 7.5).alias("y1"), F.col("b.text").alias("text"))


def table_rows(spark, sf_dir: str) -> DataFrame:
    """Rows of each table with the text of their cells."""
    rows = L.logical_rows(_boxes(spark, sf_dir), "doc_id")
    return rows.select("doc_id", F.col("row").cast("int").alias("row"), F.size("cells").alias("n"), F.array_join("cells", "|").alias("cells"))


def table_bounds(spark, sf_dir: str) -> DataFrame:
    """The columns of each table."""
    bounds = L.column_bounds(L.rows_by_gaps(_boxes(spark, sf_dir), "doc_id"), "doc_id")
    return bounds.select("doc_id", F.posexplode("bounds").alias("k", "b")).select("doc_id", "k", "b.x0", "b.x1")


_PLACED = r"""WITH w AS (SELECT doc_id, unnest(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')) AS word, unnest(range(len(string_split(trim(regexp_replace(text, '\s+', ' ', 'g')), ' ')))) AS i FROM documents),
a AS (SELECT doc_id, word, i // 3 AS r, i % 3 AS c, doc_id + i // 3 AS s FROM w),
b AS (SELECT doc_id, r, c * 100.0::DOUBLE + CASE WHEN s % 9 = 0 AND c = 2 THEN 150 ELSE 0 END AS x0, c * 100.0::DOUBLE + CASE WHEN s % 9 = 0 AND c = 2 THEN 240 ELSE 90 END AS x1, word AS t FROM a WHERE NOT (s % 7 = 0 AND length(word) > 3)
  UNION ALL SELECT doc_id, r, c * 100.0::DOUBLE, c * 100.0::DOUBLE + 30, left(word, 3) FROM a WHERE s % 7 = 0 AND length(word) > 3
  UNION ALL SELECT doc_id, r, c * 100.0::DOUBLE + 40, c * 100.0::DOUBLE + 90, substring(word, 4) FROM a WHERE s % 7 = 0 AND length(word) > 3),
l AS (SELECT doc_id, r, list([x0, x1] ORDER BY x0, x1) AS bounds FROM b GROUP BY ALL),
n AS (SELECT doc_id, bounds, count(*) AS n, min(r) AS f FROM l GROUP BY ALL),
g AS (SELECT doc_id, bounds FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, f) = 1),
m AS (SELECT doc_id, unnest(range(len(bounds))) AS k, unnest(bounds) AS p FROM g),
z AS (SELECT b.doc_id, b.r, b.x0, b.x1, b.t, m.k FROM b JOIN m USING (doc_id) QUALIFY row_number() OVER (PARTITION BY b.doc_id, b.r, b.x0, b.x1 ORDER BY NOT ((b.x0 + b.x1) / 2 BETWEEN p[1] AND p[2]), CASE WHEN (b.x0 + b.x1) / 2 BETWEEN p[1] AND p[2] THEN 0 ELSE abs((p[1] + p[2]) / 2 - (b.x0 + b.x1) / 2) END, m.k) = 1),
t AS (SELECT doc_id, r, k, string_agg(t, ' ' ORDER BY x0, x1) AS t FROM z GROUP BY ALL)"""
QUERIES = {f.__name__: f for f in (table_rows, table_bounds)}
SQL = {
    "table_rows": f"{_PLACED} SELECT q.doc_id, q.r::INT AS row, count(*)::INT AS n, string_agg(coalesce(t.t, ''), '|' ORDER BY q.k) AS cells FROM (SELECT DISTINCT b.doc_id, b.r, m.k FROM b JOIN m USING (doc_id)) q LEFT JOIN t USING (doc_id, r, k) GROUP BY 1, 2",
    "table_bounds": f"{_PLACED} SELECT doc_id, k::INT AS k, p[1] AS x0, p[2] AS x1 FROM m",
}
