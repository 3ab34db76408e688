"""Merging documents into drafts, export sheets with their issues, learning from approved ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import line_off
from ..functions.text import trade_description
from ..operators import reconcile as R
from .fixture import HS_SQL, ITEMS_SQL, hs, items, table

TERMS = ["FOB", "CIF", "EXW", "CFR", "UNKNOWN"]


def _documents(spark, sf_dir: str) -> DataFrame:
    """Line items as documents of an order: each states some fields; precedence by supplier."""
    li = table(spark, sf_dir, "lineitem")
    order = F.concat_ws("/", *[F.lpad(F.col(c).cast("string"), 9, "0") for c in ("l_suppkey", "l_partkey", "l_linenumber")], F.lpad((F.col("l_extendedprice") * 100).cast("long").cast("string"), 12, "0"))
    return li.select(
        F.col("l_orderkey").alias("job"), order.alias("o"), F.when(F.col("l_quantity") > 10, F.col("l_quantity").cast("decimal(12,2)")).alias("weight"), F.when(F.col("l_tax") > 0.04, F.col("l_returnflag")).alias("seller"),
        F.when(F.col("l_partkey") % 2 == 0, hs("l_partkey")).alias("hs"), F.element_at(F.array(*map(F.lit, TERMS)), (F.col("l_suppkey") % 5 + 1).cast("int")).alias("terms"),
    )


def merged_fields(spark, sf_dir: str) -> DataFrame:
    return R.first_stated(_documents(spark, sf_dir), "job", "o", ["weight", "seller", "hs"])


def merge_conflicts(spark, sf_dir: str) -> DataFrame:
    found = R.conflicts(_documents(spark, sf_dir), "job", "o", "weight")
    return found.select("job", "chosen", F.size("others").alias("n"), F.array_join(F.transform("others", lambda v: v.cast("string")), ",").alias("others"))


def draft_flags(spark, sf_dir: str) -> DataFrame:
    """A row for each flag of each order's draft."""
    d = _documents(spark, sf_dir)
    merged = R.first_stated(d, "job", "o", ["weight", "seller", "hs", "terms"]).join(d.groupBy("job").agg(F.count_distinct(F.substring("hs", 1, 6)).alias("codes"), F.count("*").alias("n")), "job")
    charges = F.col("job") % 3 == 0
    declared = R.terms_of_invoice(F.col("terms"), charges)
    out = R.flags(
        merged,
        ("error", "", "no_seller", F.col("seller").isNull()),
        ("warning", "shipment.weight", "no_weight", F.col("weight").isNull()),
        ("warning", "invoice.terms", "terms_unclear", F.col("terms") == "UNKNOWN"),
        ("info", "invoice.terms", "terms_changed", (declared != F.col("terms")) & (F.col("terms") != "UNKNOWN")),
        ("warning", "items.0.hs", "codes_differ", F.col("codes") > 1),
    )
    return out.select("job", F.posexplode("flags").alias("k", "f")).select("job", "k", "f.severity", "f.path", "f.code")


def export_items_sheet(spark, sf_dir: str) -> DataFrame:
    """The items sheet as text cells, for orders without a blocking issue; serials by order."""
    i = items(spark, sf_dir)
    blocked = _issues(spark, sf_dir).where("severity = 'blocker'").select("invoice").distinct()
    text = lambda c, t: F.col(c).cast(t).cast("string").alias(c)
    return i.join(blocked, "invoice", "left_anti").select("invoice", F.col("sl_no").cast("string").alias("sl_no"), "hs", text("quantity", "decimal(18,6)"), text("unit_price", "decimal(18,5)"), F.coalesce(F.col("cess_rate").cast("decimal(8,2)").cast("string"), F.lit("")).alias("cess_rate"))


def _issues(spark, sf_dir: str) -> DataFrame:
    i = items(spark, sf_dir).withColumn("amount", (F.col("quantity") * F.col("unit_price") + F.when(F.col("part") % 31 == 0, F.col("unit_price")).otherwise(0)).cast("decimal(24,4)"))
    rules = [
        ("blocker", "amount", line_off(F.col("quantity"), F.col("unit_price"), F.col("amount"))),
        ("warning", "exempt", F.col("exempt_percent").isNotNull() & (F.col("bcd_rate") == 0)),
        ("blocker", "hs", F.col("hs").startswith("99")),
    ]
    made = F.explode(F.array_compact(F.array(*[F.when(c, F.struct(F.lit(s).alias("severity"), F.lit(p).alias("path"))) for s, p, c in rules]))).alias("x")
    return i.select("invoice", "sl_no", made).select("invoice", "sl_no", "x.severity", "x.path")


def export_issues(spark, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir)


def exportable(spark, sf_dir: str) -> DataFrame:
    """Per order: how many issues of each severity; a blocker holds up the whole order."""
    n = _issues(spark, sf_dir).groupBy("invoice").agg(F.count_if(F.col("severity") == "blocker").alias("blockers"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice"))
    return o.join(n, "invoice", "left").select("invoice", F.coalesce("blockers", F.lit(0)).alias("blockers"), F.coalesce("warnings", F.lit(0)).alias("warnings"), (F.coalesce("blockers", F.lit(0)) == 0).alias("ok"))


def learned_products(spark, sf_dir: str) -> DataFrame:
    """What is remembered of each part and importer group: the code of its latest item."""
    i = items(spark, sf_dir).join(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("invoice"), (F.col("o_custkey") % 10).alias("importer")), "invoice")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("part"), F.substring(F.upper(trade_description(F.col("p_name"))), 1, 40).alias("description"))
    w = Window.partitionBy("importer", "description").orderBy(F.desc("invoice"), F.desc("sl_no"))
    return i.join(p, "part").withColumn("k", F.row_number().over(w)).where("k = 1").select("importer", "description", "hs", "invoice")


_O = "concat_ws('/', lpad(l_suppkey::VARCHAR, 9, '0'), lpad(l_partkey::VARCHAR, 9, '0'), lpad(l_linenumber::VARCHAR, 9, '0'), lpad(trunc(l_extendedprice * 100)::BIGINT::VARCHAR, 12, '0'))"
_DOCS = f"""docs AS (SELECT l_orderkey AS job, {_O} AS o, CASE WHEN l_quantity > 10 THEN l_quantity::DECIMAL(12,2) END AS weight, CASE WHEN l_tax > 0.04 THEN l_returnflag END AS seller, CASE WHEN l_partkey % 2 = 0 THEN {HS_SQL.format('l_partkey')} END AS hs, (['FOB','CIF','EXW','CFR','UNKNOWN'])[(l_suppkey % 5 + 1)::INT] AS terms FROM lineitem)"""
_FIRST = "arg_min({0}, o) FILTER ({0} IS NOT NULL) AS {0}"
_ISSUES = f"""WITH {ITEMS_SQL}, a AS (SELECT *, quantity * unit_price + CASE WHEN part % 31 = 0 THEN unit_price ELSE 0 END AS amount FROM items),
issues AS (SELECT invoice, sl_no, 'blocker' AS severity, 'amount' AS path FROM a WHERE amount > 0 AND abs(quantity * unit_price - amount) > 0.005 * amount
  UNION ALL SELECT invoice, sl_no, 'warning', 'exempt' FROM a WHERE exempt_percent IS NOT NULL AND bcd_rate = 0 UNION ALL SELECT invoice, sl_no, 'blocker', 'hs' FROM a WHERE starts_with(hs, '99'))"""
QUERIES = {f.__name__: f for f in (merged_fields, merge_conflicts, draft_flags, export_items_sheet, export_issues, exportable, learned_products)}
SQL = {
    "merged_fields": f"WITH {_DOCS} SELECT job, {', '.join(_FIRST.format(f) for f in ('weight', 'seller', 'hs'))} FROM docs GROUP BY job",
    "merge_conflicts": f"""WITH {_DOCS}, c AS (SELECT job, {_FIRST.format('weight').replace('AS weight', 'AS chosen')} FROM docs GROUP BY job)
SELECT job, chosen, count(*)::INT AS n, string_agg(weight::VARCHAR, ',' ORDER BY o, weight) AS others FROM docs JOIN c USING (job) WHERE abs(weight - chosen) > 0.02::DECIMAL(4,2) * greatest(weight, chosen) GROUP BY job, chosen""",
    "draft_flags": f"""WITH {_DOCS}, m AS (SELECT job, {', '.join(_FIRST.format(f) for f in ('weight', 'seller', 'hs', 'terms'))}, count(DISTINCT left(hs, 6)) AS codes FROM docs GROUP BY job),
f AS (SELECT job, 0 AS r, 'error' AS severity, '' AS path, 'no_seller' AS code FROM m WHERE seller IS NULL UNION ALL SELECT job, 1, 'warning', 'shipment.weight', 'no_weight' FROM m WHERE weight IS NULL UNION ALL SELECT job, 2, 'warning', 'invoice.terms', 'terms_unclear' FROM m WHERE terms = 'UNKNOWN'
  UNION ALL SELECT job, 3, 'info', 'invoice.terms', 'terms_changed' FROM m WHERE terms IN ('CFR', 'EXW') OR (terms = 'FOB' AND job % 3 = 0) UNION ALL SELECT job, 4, 'warning', 'items.0.hs', 'codes_differ' FROM m WHERE codes > 1)
SELECT job, (row_number() OVER (PARTITION BY job ORDER BY r) - 1)::INT AS k, severity, path, code FROM f""",
    "export_items_sheet": f"{_ISSUES} SELECT invoice, sl_no::VARCHAR AS sl_no, hs, quantity::DECIMAL(18,6)::VARCHAR AS quantity, unit_price::DECIMAL(18,5)::VARCHAR AS unit_price, coalesce(cess_rate::DECIMAL(8,2)::VARCHAR, '') AS cess_rate FROM items WHERE invoice NOT IN (SELECT invoice FROM issues WHERE severity = 'blocker')",
    "export_issues": f"{_ISSUES} SELECT * FROM issues",
    "exportable": f"{_ISSUES} SELECT o_orderkey AS invoice, count(*) FILTER (severity = 'blocker') AS blockers, count(*) FILTER (severity = 'warning') AS warnings, count(*) FILTER (severity = 'blocker') = 0 AS ok FROM orders LEFT JOIN issues ON invoice = o_orderkey GROUP BY o_orderkey",
    "learned_products": f"WITH {ITEMS_SQL} SELECT o_custkey % 10 AS importer, left(upper(p_name), 40) AS description, hs, invoice FROM items JOIN orders ON invoice = o_orderkey JOIN part ON part = p_partkey QUALIFY row_number() OVER (PARTITION BY o_custkey % 10, left(upper(p_name), 40) ORDER BY invoice DESC, sl_no DESC) = 1",
}
