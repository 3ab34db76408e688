"""Orders as amending notifications whose lines are instructions on parts: from their text to the entries they leave."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import amendments as A
from .fixture import table

_ORDER = ["l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
#: What an instruction says, by ``m``, a number of its kind, for serial ``p``, in words that both engines read; years and rates as ``y`` and ``r``.
KIND = "(l_partkey + CAST(l_quantity AS BIGINT)) % 9"
SERIAL = "CAST(CASE WHEN l_suppkey % 19 = 3 THEN l_partkey + 7000000 ELSE l_partkey END AS STRING)"
_AGAINST = "'against S. No. ' || p || ', '"
_RATE = "'in column (4), for the entry “' || CAST(r AS STRING) || '%”' || CASE WHEN r % 2 = 0 THEN ', at both the places' ELSE '' END || ', the entry “' || CAST(r + 1 AS STRING) || '%” shall be substituted'"
TEXT = f"""CASE m WHEN 0 THEN {_AGAINST} || 'in column (3), in the proviso, for the figures, letters and word “31st March, ' || CAST(y AS STRING) || '”, the figures, letters and word “31st March, ' || CAST(y + 1 AS STRING) || '” shall be substituted;'
 WHEN 1 THEN {_AGAINST} || {_RATE} || ';' WHEN 2 THEN {_AGAINST} || {_RATE} || ';'
 WHEN 3 THEN 'S. No. ' || p || ' and the entries relating thereto shall be omitted;' WHEN 4 THEN 'after S. No. ' || p || ' and the entries relating thereto, the following shall be inserted'
 WHEN 5 THEN 'against S. No. ' || p || ',-  (a) ' || {_RATE} || '; (b) in column (6), for the figure “3”, the figure “4”;' WHEN 6 THEN 'in the LISTS appended to TABLE I, in List ' || CAST(r + 30 AS STRING) || ', after item 4'
 WHEN 7 THEN {_AGAINST} || 'in column (3), for the words “goods”, the words “all goods”;' ELSE 'in the opening paragraph, for the word “may”, the word “shall”;' END"""
#: An entry's text, by part key.
DESCRIPTION = "'Goods of ' || p_name || ' Provided that nothing in this entry applies after the 31st March, ' || CAST(2020 + p_partkey % 3 AS STRING)"
RATE_TEXT = "CASE p_partkey % 4 WHEN 0 THEN 'Nil' WHEN 1 THEN CAST(p_partkey % 3 + 5 AS STRING) || '%' ELSE CAST(p_partkey % 3 + 5 AS STRING) || '% ' || CAST(p_partkey % 3 + 5 AS STRING) || '%' END"


def notices(spark, sf_dir: str) -> DataFrame:
    """An order's instructions, numbered from 1, or from 2 in every eleventh order; every seventh order has them on several lines."""
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(w).alias("n"), F.expr(KIND).alias("m"), F.expr(SERIAL).alias("p"), (F.lit(2020) + F.col("l_linenumber") % 4).alias("y"), (F.col("l_suppkey") % 4 + 5).alias("r"))
    first = F.when(F.col("l_orderkey") % 11 == 0, F.col("n") + 1).otherwise(F.col("n"))
    part = F.concat(F.lit("("), first.cast("string"), F.when(F.col("l_orderkey") % 7 == 0, ")\n  ").otherwise(") "), F.expr(TEXT))
    texts = li.select("l_orderkey", F.struct("n", part.alias("t")).alias("x")).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["t"]), " ").alias("text"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("day"))
    return o.join(texts, F.col("o_orderkey") == F.col("l_orderkey")).select(F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("notification"), "day", F.concat(F.lit("G.S.R. (E). In the said notification, "), "text").alias("text"))


def entries(spark, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("serial"), F.lit("I").alias("table"), F.expr(DESCRIPTION).alias("description"), F.expr(RATE_TEXT).alias("rate_text"))


def amendments_replayed(spark, sf_dir: str) -> DataFrame:
    """Entries after all notifications."""
    out = A.amend(entries(spark, sf_dir), notices(spark, sf_dir))[0]
    return out.select("serial", "description", "rate_text", "omitted_by", F.array_join("amended_by", ",").alias("amended_by"), F.array_join("stale_by", ",").alias("stale_by"))


def amendments_rejected(spark, sf_dir: str) -> DataFrame:
    """What couldn't be applied, and why."""
    return A.amend(entries(spark, sf_dir), notices(spark, sf_dir))[1]


_LINES = f"""lines AS (
  SELECT lpad(l_orderkey::VARCHAR, 9, '0') AS notification, o_orderdate::DATE AS day, l_orderkey % 11 = 0 AS bad, row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(_ORDER)}) AS position, {KIND} AS m, {SERIAL} AS serial, 2020 + l_linenumber % 4 AS y, l_suppkey % 4 + 5 AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
edits AS (
  SELECT *, 0 AS k, CASE m WHEN 0 THEN 'sunset' WHEN 1 THEN 'rate' WHEN 2 THEN 'rate' WHEN 3 THEN 'omit' WHEN 4 THEN 'insert' WHEN 5 THEN 'rate' WHEN 6 THEN 'list' WHEN 7 THEN 'column3' END AS kind FROM lines WHERE NOT bad
  UNION ALL SELECT *, 1, 'condition' FROM lines WHERE NOT bad AND m = 5),
entries AS (SELECT p_partkey::VARCHAR AS serial, {DESCRIPTION} AS description, {RATE_TEXT} AS rate_text FROM part),
steps AS (SELECT e.*, row_number() OVER (PARTITION BY e.serial ORDER BY day, notification, position, k) AS i FROM edits e JOIN entries USING (serial) WHERE kind <> 'list')"""
#: One step of every entry in each round of the recursion.
_FOLD = """fold AS (
  SELECT serial, 0::BIGINT AS i, description, rate_text, NULL::VARCHAR AS omitted_by, []::VARCHAR[] AS amended_by, []::VARCHAR[] AS stale_by, NULL::VARCHAR AS failed, 0::BIGINT AS at_position, 0 AS at_k FROM entries
  UNION ALL
  SELECT f.serial, s.i, CASE WHEN kind = 'sunset' THEN replace(description, '31st March, ' || y, '31st March, ' || (y + 1)) ELSE description END,
    CASE WHEN kind = 'rate' AND contains(rate_text, r || '%') THEN CASE WHEN r % 2 = 0 THEN replace(rate_text, r || '%', (r + 1) || '%') ELSE left(rate_text, strpos(rate_text, r || '%') - 1) || (r + 1) || '%' || substr(rate_text, strpos(rate_text, r || '%') + length(r || '%')) END ELSE rate_text END,
    CASE WHEN kind = 'omit' THEN notification ELSE omitted_by END,
    CASE WHEN (kind = 'sunset' AND contains(description, '31st March, ' || y)) OR (kind = 'rate' AND contains(rate_text, r || '%')) THEN list_append(amended_by, notification || ' (' || kind || ')') ELSE amended_by END,
    CASE WHEN kind NOT IN ('sunset', 'rate', 'omit') THEN list_append(stale_by, notification || ' (' || kind || ')') ELSE stale_by END,
    CASE WHEN (kind = 'sunset' AND NOT contains(description, '31st March, ' || y)) OR (kind = 'rate' AND NOT contains(rate_text, r || '%')) THEN notification END, s.position, s.k
  FROM fold f JOIN steps s ON s.serial = f.serial AND s.i = f.i + 1)"""
_WITH = f"WITH RECURSIVE {_LINES}, {_FOLD}"
QUERIES = {f.__name__: f for f in (amendments_replayed, amendments_rejected)}
SQL = {
    "amendments_replayed": f"{_WITH} SELECT serial, description, rate_text, omitted_by, array_to_string(amended_by, ',') AS amended_by, array_to_string(stale_by, ',') AS stale_by FROM fold QUALIFY row_number() OVER (PARTITION BY serial ORDER BY i DESC) = 1",
    "amendments_rejected": f"""{_WITH} SELECT notification, NULL::INT AS position, NULL::INT AS k, 'misnumbered' AS reason FROM lines WHERE bad GROUP BY notification
 UNION ALL SELECT notification, position::INT, 0, 'no_form' FROM lines WHERE NOT bad AND m = 8 UNION ALL SELECT notification, position::INT, k, 'unknown_serial' FROM edits WHERE kind IN ('sunset', 'rate', 'omit') AND serial NOT IN (SELECT serial FROM entries)
 UNION ALL SELECT failed, at_position::INT, at_k, 'old_absent' FROM fold WHERE failed IS NOT NULL""",
}
