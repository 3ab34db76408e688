"""Rate schedules by longest prefix, exemptions in force, compliance rules by prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import hs_code
from ..operators import joins as J
from .fixture import AS_OF, HS_SQL, hs, table


def schedule(spark, sf_dir: str) -> DataFrame:
    """Every third part makes an entry: one or two prefixes of 4 or 6 digits, some exclusions, a rate; entry 0 is the residual one."""
    p = table(spark, sf_dir, "part").where("p_partkey % 3 = 1").select("p_partkey", hs("p_partkey").alias("h"))
    two = F.when(F.col("p_partkey") % 4 == 0, F.array(F.substring("h", 1, 6), F.substring("h", 1, 4))).when(F.col("p_partkey") % 2 == 0, F.array(F.substring("h", 1, 6))).otherwise(F.array(F.substring("h", 1, 4)))
    none = F.array().cast("array<string>")
    rate = F.element_at(F.array(*[F.lit(v).cast("decimal(6,2)") for v in ("5", "12", "28", "3")]), (F.col("p_partkey") % 4 + 1).cast("int"))
    entries = p.select(
        F.col("p_partkey").alias("pos"), two.alias("include"), F.when(F.col("p_partkey") % 5 == 0, F.array("h")).otherwise(none).alias("exclude"), F.lit(False).alias("any_chapter"),
        rate.alias("rate"), F.when(F.col("p_partkey") % 7 > 0, F.date_add(F.lit("1997-01-01").cast("date"), (F.col("p_partkey") % 800).cast("int"))).alias("valid_until"), (F.col("p_partkey") % 8 == 1).alias("stale"),
    )
    residual = spark.range(1).select((F.col("id") - 1).alias("pos"), none.alias("include"), none.alias("exclude"), F.lit(True).alias("any_chapter"), F.lit("18").cast("decimal(6,2)").alias("rate"), F.lit(None).cast("date").alias("valid_until"), F.lit(False).alias("stale"))
    return entries.unionByName(residual)


def _codes(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(hs("p_partkey").alias("hs")).distinct()


def schedule_matches(spark, sf_dir: str) -> DataFrame:
    """All entries for each code, with the length of the longest prefix."""
    return J.prefix_join(_codes(spark, sf_dir), "hs", schedule(spark, sf_dir)).select("hs", "pos", "len")


def rate_of_code(spark, sf_dir: str) -> DataFrame:
    """The most specific entry's rate, whether it is the residual one, and the other rates of the best length."""
    entries = schedule(spark, sf_dir).select("pos", "rate")
    matches = J.prefix_join(_codes(spark, sf_dir), "hs", schedule(spark, sf_dir)).join(entries, "pos")
    w = Window.partitionBy("hs").orderBy(F.desc("len"), "pos")
    ranked = matches.withColumn("k", F.row_number().over(w)).withColumn("top", F.max("len").over(Window.partitionBy("hs"))).withColumn("chosen", F.first("rate").over(w))
    others = F.sort_array(F.collect_set(F.when((F.col("len") == F.col("top")) & (F.col("rate") != F.col("chosen")), F.col("rate"))))
    return ranked.groupBy("hs").agg(F.min_by("pos", "k").alias("pos"), F.first("chosen").alias("rate"), (F.max("len") == 0).alias("residual"), F.concat_ws(",", F.transform(others, lambda r: r.cast("string"))).alias("alternatives"))


def rate_of_items(spark, sf_dir: str) -> DataFrame:
    """Items with the rate of their code; the schedule is searched for distinct codes only."""
    best = J.most_specific(J.prefix_join(_codes(spark, sf_dir), "hs", schedule(spark, sf_dir)), "hs").join(schedule(spark, sf_dir).select("pos", "rate"), "pos").select("hs", "rate")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", hs("l_partkey").alias("hs"))
    return li.join(best, "hs").groupBy("rate").agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(30,2)").alias("amount"))


def exemptions_in_force(spark, sf_dir: str) -> DataFrame:
    """Per code the first three named entries in force, and how many have lapsed; stale ones are marked."""
    named = J.prefix_join(_codes(spark, sf_dir), "hs", schedule(spark, sf_dir)).where("len > 0").join(schedule(spark, sf_dir).select("pos", "valid_until", "stale"), "pos")
    force = F.col("valid_until").isNull() | (F.col("valid_until") >= F.lit(AS_OF).cast("date"))
    w = Window.partitionBy("hs", "in_force").orderBy(F.desc("len"), "pos")
    ranked = named.withColumn("in_force", force).withColumn("k", F.row_number().over(w))
    listed = lambda c: F.array_sort(F.collect_list(F.when(F.col("in_force") & (F.col("k") <= 3), F.struct("k", c))))
    return ranked.groupBy("hs").agg(F.concat_ws(",", F.transform(listed("pos"), lambda x: x["pos"].cast("string"))).alias("candidates"), F.count_if(~F.col("in_force")).alias("lapsed"), F.count_if(F.col("in_force") & F.col("stale")).alias("stale"))


def tariff_unique_prefix(spark, sf_dir: str) -> DataFrame:
    """Codes of three to eight digits completed from the tariff if just one row begins so; none below four digits."""
    asked = table(spark, sf_dir, "part").select("p_partkey", F.substring(hs("p_partkey"), F.lit(1), (F.col("p_partkey") % 6 + 3).cast("int")).alias("code"))
    tariff = table(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(hs("p_partkey").alias("cth"))
    return J.unique_prefix(asked, "code", tariff, "cth").select("p_partkey", "code", "cth")


def compliance_by_prefix(spark, sf_dir: str) -> DataFrame:
    """Rules whose code is a prefix of an item's code, less those waived."""
    rules = table(spark, sf_dir, "part").where("p_partkey % 4 = 0").select(F.col("p_partkey").alias("rule"), F.substring(hs("p_partkey"), F.lit(1), (F.col("p_partkey") % 4 + 2 + F.col("p_partkey") % 5).cast("int")).alias("prefix"))
    waived = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("rule"))
    items = table(spark, sf_dir, "part").select("p_partkey", hs_code(hs("p_partkey")).alias("code")).where("code IS NOT NULL")
    found = J.all_of_prefixes(items, "p_partkey", "code", rules.join(waived, "rule", "left_anti"), "rule", "prefix")
    return found.select("p_partkey", F.col("n").alias("n_rules"), F.array_join(F.col("rules").cast("array<string>"), ",").alias("rules"))


_SCHEDULE = f"""part_h AS (SELECT p_partkey, {HS_SQL.format('p_partkey')} AS h FROM part),
entries AS (
  SELECT p_partkey AS pos, CASE WHEN p_partkey % 4 = 0 THEN [left(h, 6), left(h, 4)] WHEN p_partkey % 2 = 0 THEN [left(h, 6)] ELSE [left(h, 4)] END AS include,
         CASE WHEN p_partkey % 5 = 0 THEN [h] ELSE [] END AS exclude, false AS any_chapter, ([5, 12, 28, 3]::DECIMAL(6,2)[])[(p_partkey % 4 + 1)::INT] AS rate,
         CASE WHEN p_partkey % 7 > 0 THEN '1997-01-01'::DATE + (p_partkey % 800)::INT END AS valid_until, p_partkey % 8 = 1 AS stale
  FROM part_h WHERE p_partkey % 3 = 1
  UNION ALL SELECT -1, []::VARCHAR[], []::VARCHAR[], true, 18::DECIMAL(6,2), NULL, false),
codes AS (SELECT DISTINCT h AS hs FROM part_h),
hits AS (
  SELECT hs, pos, max(length(p)) AS len FROM (SELECT pos, unnest(include) AS p FROM entries) JOIN codes ON starts_with(hs, p) GROUP BY hs, pos
  UNION ALL SELECT hs, pos, 0 FROM codes, entries WHERE any_chapter),
matches AS (SELECT hs, pos, len::INT AS len FROM hits JOIN entries e USING (pos) WHERE NOT list_bool_or(list_concat([false], list_transform(e.exclude, lambda x: starts_with(hs, x)))))"""
_RANKED = f"WITH {_SCHEDULE}, r AS (SELECT m.*, e.* EXCLUDE (pos), row_number() OVER (PARTITION BY hs ORDER BY len DESC, m.pos) AS k, max(len) OVER (PARTITION BY hs) AS top, first_value(rate) OVER (PARTITION BY hs ORDER BY len DESC, m.pos) AS chosen FROM matches m JOIN entries e USING (pos))"
QUERIES = {f.__name__: f for f in (schedule_matches, rate_of_code, rate_of_items, exemptions_in_force, tariff_unique_prefix, compliance_by_prefix)}
SQL = {
    "schedule_matches": f"WITH {_SCHEDULE} SELECT hs, pos, len FROM matches",
    "rate_of_code": f"{_RANKED} SELECT hs, min(pos) FILTER (k = 1) AS pos, min(chosen) AS rate, max(len) = 0 AS residual, coalesce(array_to_string(list_sort(list_distinct(list(rate) FILTER (len = top AND rate <> chosen))), ','), '') AS alternatives FROM r GROUP BY hs",
    "rate_of_items": f"{_RANKED} SELECT rate, count(*) AS n, sum(l_extendedprice::DECIMAL(18,2))::DECIMAL(30,2) AS amount FROM lineitem JOIN r ON k = 1 AND r.hs = {HS_SQL.format('l_partkey')} GROUP BY rate",
    "exemptions_in_force": f"""WITH {_SCHEDULE}, n AS (SELECT m.*, e.stale, valid_until IS NULL OR valid_until >= '{AS_OF}' AS in_force FROM matches m JOIN entries e USING (pos) WHERE len > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY hs, in_force ORDER BY len DESC, pos) AS k FROM n)
SELECT hs, coalesce(string_agg(pos::VARCHAR, ',' ORDER BY k) FILTER (in_force AND k <= 3), '') AS candidates, count(*) FILTER (NOT in_force) AS lapsed, count(*) FILTER (in_force AND stale) AS stale FROM r GROUP BY hs""",
    "tariff_unique_prefix": f"""WITH a AS (SELECT p_partkey, left({HS_SQL.format('p_partkey')}, (p_partkey % 6 + 3)::INT) AS code FROM part), t AS (SELECT {HS_SQL.format('p_partkey')} AS cth FROM part WHERE p_partkey % 2 = 0)
SELECT p_partkey, code, CASE WHEN count(cth) = 1 THEN min(cth) END AS cth FROM a LEFT JOIN t ON starts_with(cth, code) AND length(code) >= 4 GROUP BY p_partkey, code""",
    "compliance_by_prefix": f"""WITH r AS (SELECT p_partkey AS rule, left({HS_SQL.format('p_partkey')}, (p_partkey % 4 + 2 + p_partkey % 5)::INT) AS prefix FROM part WHERE p_partkey % 4 = 0 AND p_partkey NOT IN (SELECT s_suppkey FROM supplier)),
i AS (SELECT p_partkey, {HS_SQL.format('p_partkey')} AS hs FROM part)
SELECT p_partkey, count(*) AS n_rules, array_to_string(list_sort(list(DISTINCT rule)), ',') AS rules FROM i JOIN r ON starts_with(hs, prefix) GROUP BY p_partkey""",
}
