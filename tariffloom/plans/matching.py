"""Scoring of identifiers against jobs, decisions, party resolution, message decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import party_key
from ..operators import matching as M
from .fixture import table

_KINDS = ["container", "bl", "awb", "invoice", "conversation", "po"]


def _kind(key: str):
    return F.element_at(F.array(*map(F.lit, _KINDS)), (F.col(key) % 6 + 1).cast("int"))


def known_identifiers(spark, sf_dir: str) -> DataFrame:
    """(job, kind, value) of what jobs are known by, from parts ordered."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("job"), _kind("l_suppkey").alias("kind"), F.concat(F.lit("V"), F.col("l_partkey").cast("string")).alias("value")).distinct()


def message_identifiers(spark, sf_dir: str) -> DataFrame:
    """(message, kind, value) from orders, with repeats."""
    o = table(spark, sf_dir, "orders")
    values = F.array("o_custkey", "o_orderkey", "o_orderkey")
    made = o.select(F.col("o_orderkey").alias("message"), F.posexplode(values).alias("p", "v"))
    return made.select("message", F.element_at(F.array(*map(F.lit, _KINDS)), ((F.col("message") + F.col("p")) % 6 + 1).cast("int")).alias("kind"), F.concat(F.lit("V"), F.col("v").cast("string")).alias("value"))


def match_scores(spark, sf_dir: str) -> DataFrame:
    return M.scores(message_identifiers(spark, sf_dir), known_identifiers(spark, sf_dir)).select("message", "job", "score", "matched")


def match_decisions(spark, sf_dir: str) -> DataFrame:
    messages = message_identifiers(spark, sf_dir)
    return M.decisions(messages, M.scores(messages, known_identifiers(spark, sf_dir)))


def identifier_join(spark, sf_dir: str) -> DataFrame:
    """How many jobs share each message's identifiers."""
    joined = message_identifiers(spark, sf_dir).distinct().join(known_identifiers(spark, sf_dir), ["kind", "value"])
    return joined.groupBy("kind", "value").agg(F.count_distinct("message").alias("messages"), F.count_distinct("job").alias("jobs"))


def first_identifiers(spark, sf_dir: str) -> DataFrame:
    """The first mention of each of a message's identifiers."""
    o = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]{9,}"), F.lit(0)))).alias("value"))
    return o.groupBy("conv_id", "value").agg(F.min("turn").alias("turn"))


def party_resolution(spark, sf_dir: str) -> DataFrame:
    """Stated names against the master by name key: one exact hit, several, or the one similar enough."""
    master = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("party"), F.concat(F.lit("M/S. Customer "), (F.col("c_custkey") % 400).cast("string"), F.when(F.col("c_custkey") % 2 == 0, " Pvt. Ltd.").otherwise(" Trading")).alias("name"))
    stated = table(spark, sf_dir, "supplier").select("s_suppkey", F.concat(F.lit("CUSTOMER "), F.col("s_suppkey").cast("string"), F.when(F.col("s_suppkey") % 3 == 0, " LIMITED").when(F.col("s_suppkey") % 3 == 1, " TRADING").otherwise(" TRADINGS LLC")).alias("name"))
    return M.resolve_parties(stated.withColumn("key", party_key(F.col("name"))), "s_suppkey", master.withColumn("key", party_key(F.col("name"))), "party")


def attachment_skips(spark, sf_dir: str) -> DataFrame:
    """Why attachments are skipped, the first reason that holds; at most 15 of a message count."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_shipdate", "l_tax", "l_discount")).alias("n"), "l_partkey", "l_quantity")
    reason = F.when(F.col("l_partkey") % 11 == 0, "not_a_file").when(F.col("l_partkey") % 7 == 0, "inline").when(F.col("l_quantity") > 45, "too_large").when(F.col("l_partkey") % 5 == 0, "unsupported_type")
    return li.where("n <= 15").select(reason.alias("skip_reason")).groupBy("skip_reason").agg(F.count("*").alias("n"))


_KIND_SQL = "(['container','bl','awb','invoice','conversation','po'])[({} % 6 + 1)::INT]"
_BASE = f"""known AS (SELECT DISTINCT l_orderkey AS job, {_KIND_SQL.format('l_suppkey')} AS kind, 'V' || l_partkey AS value FROM lineitem),
raw AS (SELECT o_orderkey AS message, unnest([o_custkey, o_orderkey, o_orderkey]) AS v, unnest([0, 1, 2]) AS p FROM orders),
ids AS (SELECT DISTINCT message, {_KIND_SQL.format('(message + p)')} AS kind, 'V' || v AS value FROM raw),
scores AS (SELECT message, job, sum(CASE kind WHEN 'container' THEN 5 WHEN 'bl' THEN 5 WHEN 'awb' THEN 5 WHEN 'invoice' THEN 4 WHEN 'conversation' THEN 3 ELSE 2 END)::BIGINT AS score, count(*) AS matched, bool_or(kind = 'conversation') AS thread
  FROM ids JOIN known USING (kind, value) GROUP BY message, job)"""
_PARTY = r"trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(upper({0}), '^\s*(?:M/S|MESSRS)\b[.\s]*', ''), '&', ' AND '), '[^A-Z0-9]+', ' ', 'g'), '\b(?:PRIVATE|LIMITED|PVT|LTD|LLC)\b', ' ', 'g'), '\s+', ' ', 'g'))"
_GRAMS = "list_distinct(list_transform(range(1, length('  ' || {0} || ' ') - 1), lambda i: substring('  ' || {0} || ' ', i, 3)))"
QUERIES = {f.__name__: f for f in (match_scores, match_decisions, identifier_join, first_identifiers, party_resolution, attachment_skips)}
SQL = {
    "match_scores": f"WITH {_BASE} SELECT message, job, score, matched FROM scores",
    "match_decisions": f"""WITH {_BASE}, m AS (SELECT message, bool_or(kind IN ('container', 'bl', 'awb', 'invoice')) AS strong FROM ids GROUP BY message),
t AS (SELECT message, max(score) AS top, count(*) FILTER (score = mx) AS n, min(job) FILTER (score = mx) AS job, count(*) FILTER (thread) AS threads, min(job) FILTER (thread) AS thread_job FROM (SELECT *, max(score) OVER (PARTITION BY message) AS mx FROM scores) GROUP BY message)
SELECT message, CASE WHEN top >= 4 THEN CASE WHEN n > 1 THEN 'ambiguous' ELSE 'attach' END WHEN NOT strong AND threads = 1 THEN 'attach' ELSE 'none' END AS decision, CASE WHEN top >= 4 AND n = 1 THEN job WHEN coalesce(top, 0) < 4 AND NOT strong AND threads = 1 THEN thread_job END AS job, coalesce(top, 0) AS score FROM m LEFT JOIN t USING (message)""",
    "identifier_join": f"WITH {_BASE} SELECT kind, value, count(DISTINCT message) AS messages, count(DISTINCT job) AS jobs FROM ids JOIN known USING (kind, value) GROUP BY kind, value",
    "first_identifiers": "SELECT conv_id, value, min(turn) AS turn FROM (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z]{9,}')) AS value FROM conversations) GROUP BY conv_id, value",
    "party_resolution": f"""WITH m AS (SELECT c_custkey AS party, {_PARTY.format("('M/S. Customer ' || (c_custkey % 400) || CASE WHEN c_custkey % 2 = 0 THEN ' Pvt. Ltd.' ELSE ' Trading' END)")} AS key FROM customer),
s AS (SELECT s_suppkey, {_PARTY.format("('CUSTOMER ' || s_suppkey || CASE WHEN s_suppkey % 3 = 0 THEN ' LIMITED' WHEN s_suppkey % 3 = 1 THEN ' TRADING' ELSE ' TRADINGS LLC' END)")} AS key FROM supplier),
k AS (SELECT key, min(party) AS party, count(*) AS n FROM m GROUP BY key), x AS (SELECT s_suppkey, s.key AS sk, k.key AS mk, party, n, {_GRAMS.format('s.key')} AS g, {_GRAMS.format('k.key')} AS h FROM s, k),
y AS (SELECT *, floor(len(list_intersect(g, h)) * 10000 / (len(g) + len(h) - len(list_intersect(g, h))))::BIGINT AS sim FROM x),
z AS (SELECT s_suppkey, sum(n) FILTER (sk = mk) AS exact, min(party) FILTER (sk = mk) AS exact_party, max(sim) FILTER (sim > 0) AS best FROM y GROUP BY s_suppkey),
w AS (SELECT z.*, (SELECT sum(n) FROM y WHERE y.s_suppkey = z.s_suppkey AND sim >= best - 10) AS close, (SELECT min(party) FROM y WHERE y.s_suppkey = z.s_suppkey AND sim >= best - 10) AS fuzzy_party FROM z)
SELECT s_suppkey, CASE WHEN exact = 1 THEN 'exact' WHEN exact > 1 THEN 'ambiguous' WHEN coalesce(best, 0) < 5500 THEN 'none' WHEN close = 1 THEN 'fuzzy' ELSE 'ambiguous' END AS status, CASE WHEN exact = 1 THEN exact_party WHEN exact IS NULL AND best >= 5500 AND close = 1 THEN fuzzy_party END AS party FROM w""",
    "attachment_skips": "SELECT CASE WHEN l_partkey % 11 = 0 THEN 'not_a_file' WHEN l_partkey % 7 = 0 THEN 'inline' WHEN l_quantity > 45 THEN 'too_large' WHEN l_partkey % 5 = 0 THEN 'unsupported_type' END AS skip_reason, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_extendedprice, l_quantity, l_shipdate, l_tax, l_discount) AS rn FROM lineitem) WHERE rn <= 15 GROUP BY 1",
}
