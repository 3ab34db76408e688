"""Upserts, snapshots, versions, tombstones, tenants and vector search over the fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import versions as V
from ..operators.retrieval import nearest
from .fixture import table


def _stored(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").where("c_custkey % 3 > 0").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("value"))


def _incoming(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'").select(F.col("o_custkey").alias("key"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("value"), "o_orderkey")


def insert_new(spark, sf_dir: str) -> DataFrame:
    rows = _incoming(spark, sf_dir)
    return V.insert_new(_stored(spark, sf_dir).withColumn("o_orderkey", F.lit(-1).cast("long")), rows, ["key"], F.col("o_orderkey")).select("key", "value")


def replace_rows(spark, sf_dir: str) -> DataFrame:
    rows = _incoming(spark, sf_dir).groupBy("key").agg(F.max_by("value", "o_orderkey").alias("value"))
    return V.replace_rows(_stored(spark, sf_dir), rows, ["key"])


def snapshot_import(spark, sf_dir: str) -> DataFrame:
    rows = _incoming(spark, sf_dir).groupBy("key").agg(F.max_by("value", "o_orderkey").alias("value"))
    return V.snapshot(_stored(spark, sf_dir), rows, "key", ["value"])


def import_metrics(spark, sf_dir: str) -> DataFrame:
    done = snapshot_import(spark, sf_dir)
    return done.agg(*[F.count_if(F.col("action") == a).alias(a) for a in ("inserted", "updated", "retired")], F.array_join(F.sort_array(F.collect_set(F.when(F.col("action") == "retired", F.col("value")))), ",").alias("retired_values"))


def next_versions(spark, sf_dir: str) -> DataFrame:
    drafts = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("version"))
    new = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return V.next_versions(drafts, new, "l_orderkey").select("l_orderkey", F.col("version").cast("int").alias("version"))


def tombstones(spark, sf_dir: str) -> DataFrame:
    """What a deleted order leaves: the counts of its children."""
    deleted = table(spark, sf_dir, "orders").where("o_orderkey % 40 = 7").select("o_orderkey")
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("items"), F.count_if(F.col("l_returnflag") == "R").alias("returns"))
    return deleted.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("items", F.lit(0)).alias("items"), F.coalesce("returns", F.lit(0)).alias("returns"))


def after_deletion(spark, sf_dir: str) -> DataFrame:
    deleted = table(spark, sf_dir, "orders").where("o_orderkey % 40 = 7").select(F.col("o_orderkey").alias("l_orderkey"))
    return V.without(table(spark, sf_dir, "lineitem"), deleted, "l_orderkey").groupBy("l_returnflag").agg(F.count("*").alias("n"))


def edited_matrix(spark, sf_dir: str) -> DataFrame:
    matrix = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("line"), F.col("n_regionkey").alias("rate"))
    edits = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("line"), F.when(F.col("n_nationkey") % 4 == 0, F.col("n_regionkey") + 100).alias("rate"))
    return V.set_or_clear(matrix, edits, ["line"], "rate")


def unique_file_names(spark, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, "invoice.pdf").when(F.col("s_suppkey") % 3 == 1, "scan").otherwise("bl.v2.xlsx").alias("name"))
    return V.unique_names(files, "name", F.col("s_suppkey")).select("s_suppkey", "unique_name")


def guarded_status(spark, sf_dir: str) -> DataFrame:
    """A status moves on only from those it may be left from."""
    o = table(spark, sf_dir, "orders")
    moved = F.when((F.col("o_orderkey") % 2 == 0) & F.col("o_orderstatus").isin("O", "P"), "F").otherwise(F.col("o_orderstatus"))
    return o.groupBy("o_orderstatus", moved.alias("status")).agg(F.count("*").alias("n"))


def tenant_rows(spark, sf_dir: str) -> DataFrame:
    """Rows of a tenant, of an administrator and of nobody, counted."""
    c = table(spark, sf_dir, "customer")
    views = [("tenant", V.tenant_view(c, 3, "c_nationkey")), ("admin", V.tenant_view(c, None, "c_nationkey", admin=True)), ("nobody", V.tenant_view(c, None, "c_nationkey"))]
    counts = [v.agg(F.count("*").alias("n")).select(F.lit(name).alias("who"), "n") for name, v in views]
    return counts[0].unionByName(counts[1]).unionByName(counts[2])


def path_tenants(spark, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", V.path_tenant(F.regexp_replace("url", "^https?://", "")).alias("host"))
    return p.groupBy("host").agg(F.count("*").alias("n"))


def rule_violations(spark, sf_dir: str) -> DataFrame:
    """Rows that break a rule of their table, by rule."""
    c = table(spark, sf_dir, "customer")
    rules = [("name", ~F.col("c_name").rlike("^Customer#[0-9]{9}$")), ("segment", ~F.col("c_mktsegment").isin("AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY")), ("credit", (F.col("c_acctbal") < 0) & (F.col("c_nationkey") < 5))]
    broken = F.explode(F.array_compact(F.array(*[F.when(bad, name) for name, bad in rules]))).alias("rule")
    return c.select("c_custkey", broken)


def vector_topk(spark, sf_dir: str) -> DataFrame:
    """The six nearest vectors of every hundredth one, itself among them."""
    e = table(spark, sf_dir, "embeddings")
    queries = e.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return nearest(e, queries, 6).select("query_id", "vec_id", "place", F.round("score", 4).alias("score"))


_S = "s AS (SELECT c_custkey AS key, c_mktsegment AS value FROM customer WHERE c_custkey % 3 > 0), i AS (SELECT o_custkey AS key, strftime(o_orderdate, '%Y-%m-%d') AS value, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'), l AS (SELECT key, arg_max(value, o_orderkey) AS value FROM i GROUP BY key)"
_SNAP = f"WITH {_S}, x AS (SELECT coalesce(s.key, l.key) AS key, CASE WHEN l.key IS NULL THEN s.value ELSE l.value END AS value, l.key IS NOT NULL AS is_active, CASE WHEN l.key IS NULL THEN 'retired' WHEN s.key IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM s FULL JOIN l ON s.key = l.key)"
QUERIES = {f.__name__: f for f in (insert_new, replace_rows, snapshot_import, import_metrics, next_versions, tombstones, after_deletion, edited_matrix, unique_file_names, guarded_status, tenant_rows, path_tenants, rule_violations, vector_topk)}
SQL = {
    "insert_new": f"WITH {_S} SELECT key, value FROM s UNION ALL SELECT key, arg_min(value, o_orderkey) FROM i WHERE key NOT IN (SELECT key FROM s) GROUP BY key",
    "replace_rows": f"WITH {_S} SELECT key, value FROM l UNION ALL SELECT key, value FROM s WHERE key NOT IN (SELECT key FROM l)",
    "snapshot_import": f"{_SNAP} SELECT * FROM x",
    "import_metrics": f"{_SNAP} SELECT count(*) FILTER (action = 'inserted') AS inserted, count(*) FILTER (action = 'updated') AS updated, count(*) FILTER (action = 'retired') AS retired, array_to_string(list_sort(list(DISTINCT value) FILTER (action = 'retired')), ',') AS retired_values FROM x",
    "next_versions": "SELECT o_orderkey AS l_orderkey, (coalesce(max(l_linenumber), 0) + 1)::INT AS version FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
    "tombstones": "SELECT o_orderkey, count(l_orderkey) AS items, count(*) FILTER (l_returnflag = 'R') AS returns FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey WHERE o_orderkey % 40 = 7 GROUP BY o_orderkey",
    "after_deletion": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 40 = 7) GROUP BY 1",
    "edited_matrix": "SELECT n_nationkey AS line, CASE WHEN n_nationkey % 4 = 0 THEN n_regionkey + 100 ELSE n_regionkey END AS rate FROM nation WHERE n_nationkey % 2 = 1 OR n_nationkey % 4 = 0",
    "unique_file_names": """WITH f AS (SELECT s_suppkey, s_suppkey % 3 AS m, row_number() OVER (PARTITION BY s_suppkey % 3 ORDER BY s_suppkey) AS k FROM supplier)
SELECT s_suppkey, (['invoice', 'scan', 'bl.v2'])[(m + 1)::INT] || CASE WHEN k > 1 THEN '-' || k ELSE '' END || (['.pdf', '', '.xlsx'])[(m + 1)::INT] AS unique_name FROM f""",
    "guarded_status": "SELECT o_orderstatus, CASE WHEN o_orderkey % 2 = 0 AND o_orderstatus IN ('O', 'P') THEN 'F' ELSE o_orderstatus END AS status, count(*) AS n FROM orders GROUP BY ALL",
    "tenant_rows": "SELECT 'tenant' AS who, count(*) AS n FROM customer WHERE c_nationkey = 3 UNION ALL SELECT 'admin', count(*) FROM customer UNION ALL SELECT 'nobody', 0",
    "path_tenants": "SELECT string_split(regexp_replace(url, '^https?://', ''), '/')[1] AS host, count(*) AS n FROM pages GROUP BY 1",
    "rule_violations": """SELECT c_custkey, 'name' AS rule FROM customer WHERE NOT regexp_matches(c_name, '^Customer#[0-9]{9}$') UNION ALL SELECT c_custkey, 'segment' FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY') UNION ALL SELECT c_custkey, 'credit' FROM customer WHERE c_acctbal < 0 AND c_nationkey < 5""",
    "vector_topk": """WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS place, round(score, 4) AS score FROM s QUALIFY place <= 6""",
}
