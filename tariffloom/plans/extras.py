"""Cells of fixed places, deposits, custom houses, archives, recipients, SQL functions and checked amendments over the fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sql
from ..functions.dates import relative_time
from ..functions.numbers import to_fixed
from ..functions.text import memory_keys
from ..operators import joins as J
from ..operators import parsing as P
from ..operators import versions as V
from ..operators.masters import custom_house_master
from ..sources import tenant_table
from .fixture import AS_OF, table
from .masters import _case, _pick


def fixed_prices(spark, sf_dir: str) -> DataFrame:
    """A seventh of each price to the places of money, weights, percents, rates and quantities."""
    x = (F.col("l_extendedprice") / 7.0).alias("x")
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", x).distinct()
    return li.select("l_orderkey", "l_partkey", "l_suppkey", *[to_fixed(n)(F.col("x")).alias(f"places_{n}") for n in (2, 3, 4, 5, 6)])


def deposit_prices(spark, sf_dir: str) -> DataFrame:
    """Deposits of an order's containers: paid ones stay; a line with a security in force asks none; others the rate of mode and size, else of any size."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_suppkey") % 25).alias("line"), F.when(F.col("l_partkey") % 3 == 0, "40").otherwise("20").alias("size"), F.when(F.col("l_partkey") % 5 == 0, F.col("l_quantity").cast("decimal(14,2)")).alias("paid"))
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("line"))
    rates = n.select("line", F.explode(F.array(F.lit("40"), F.lit("*"))).alias("size")).where("NOT (size = '*' AND line % 4 = 0)").withColumn("rate", (F.col("line") * 10 + F.length("size")).cast("decimal(14,2)"))
    securities = n.where("line % 3 = 0").select("line", F.date_add(F.lit(AS_OF).cast("date"), (F.col("line") - 12).cast("int")).alias("valid_to"))
    covered = securities.where(F.col("valid_to") >= F.lit(AS_OF).cast("date")).select("line", F.lit(True).alias("covered"))
    priced = J.with_fallback(li, rates, ["line", "size"], "size", "*", "rate").join(covered, "line", "left")
    amount = F.coalesce("paid", F.when(F.col("covered").isNull(), F.col("rate")))
    status = F.when(F.col("paid").isNotNull(), "paid").when(amount.isNull(), "not_applicable").otherwise("pending")
    return priced.groupBy("l_orderkey", status.alias("status")).agg(F.count("*").alias("n"), F.coalesce(F.sum(amount), F.lit(0)).cast("decimal(18,2)").alias("expected"))


def custom_houses(spark, sf_dir: str) -> DataFrame:
    """Custom houses from rows with codes that repeat, lack a place or stand in small letters, and names of all modes."""
    k = F.col("c_custkey")
    code = F.concat(F.when(k % 2 == 0, "IN").otherwise(" in"), F.lpad((k % 4000).cast("string"), 3, "a"), F.when(k % 7 > 0, "4").otherwise(""))
    place = _pick("c_custkey", "Sahar  Air Sea", "Air Cargo Complex", "ICD Sea Port", "Harbor of", "JNPT Dock", "Petrapole LCS", "Kandla SEZ", "Airoli", "", "CFS Airways Land")
    rows = table(spark, sf_dir, "customer").select("c_custkey", code.alias("unece"), F.concat(F.lit("e"), F.substring("c_mktsegment", 1, 2)).alias("edi"), place.alias("name"), F.when(k % 3 > 0, F.concat(F.lit("Desk@"), "c_name")).alias("email"))
    return custom_house_master(rows, "c_custkey")


def zip_entries(spark, sf_dir: str) -> DataFrame:
    """Documents of a source as archive entries: unique names, sizes and checksums."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.coalesce("text", F.lit("")).alias("text"), F.concat(F.coalesce("lang", F.lit("xx")), F.lit(".txt")).alias("file"))
    named = d.withColumn("name", F.concat_ws("/", "source", "file"))
    return V.unique_names(named, "name", F.col("doc_id")).select("doc_id", F.col("unique_name").alias("name"), F.octet_length("text").alias("bytes"), F.crc32("text").alias("crc32"))


def plan_recipients(spark, sf_dir: str) -> DataFrame:
    """Who is told of a plan: all staff of the station with an address, else the station's contact."""
    stations = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("station"), F.when(F.col("n_nationkey") % 5 > 0, F.concat(F.lit("desk@"), F.lower("n_name"))).alias("contact"))
    staff = table(spark, sf_dir, "customer").where("c_nationkey % 3 = 0 AND c_custkey IS NOT NULL").select(F.col("c_nationkey").alias("station"), F.concat(F.lit("u"), F.col("c_custkey").cast("string"), F.lit("@x")).alias("mail"))
    plans = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("station"))
    told = J.spread_join(plans, staff, "station").select("s_suppkey", F.col("mail").alias("recipient"))
    rest = plans.join(staff.select("station").distinct(), "station", "left_anti").join(stations, "station")
    return told.unionByName(rest.where("contact IS NOT NULL").select("s_suppkey", F.col("contact").alias("recipient")))


def relative_times(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.pow(F.lit(1.7), F.col("o_orderkey") % 30).cast("long").alias("seconds"))
    return o.select("o_orderkey", relative_time(F.col("seconds")).alias("shown"))


def remembered_keys(spark, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    importer, description = memory_keys(F.concat(F.lit("Ms. "), "c_name", F.lit(" Pvt Ltd")), F.concat(F.lit("Poly-"), F.lower("c_mktsegment"), F.lit("  (grade), a very long description of goods")))
    return c.select("c_custkey", importer.alias("importer"), description.alias("description"))


def tenant_columns(spark, sf_dir: str) -> DataFrame:
    """One tenant's customers; filter and columns reach the scan."""
    return tenant_table(spark, f"{sf_dir}/customer.parquet", 3, "c_custkey", "c_mktsegment", key="c_nationkey")


def sql_functions(spark, sf_dir: str) -> DataFrame:
    """The registered SQL functions, called from SQL."""
    sql.register(spark)
    table(spark, sf_dir, "part").createOrReplaceTempView("tariffloom_part")
    return spark.sql("""SELECT p_partkey, alnum(p_name) AS bare, pad8(left(cast(p_partkey * 7919 AS STRING), 5)) AS padded, hs_code(cast(p_partkey * 7919 AS STRING)) AS hs, duty_percent(cast(p_size AS DECIMAL(20,8)), cast(7.5 AS DECIMAL(8,4))) AS duty,
      alert_level(cast(p_partkey % 9 - 4 AS INT), 2) AS level FROM tariffloom_part""")


def sql_chunks(spark, sf_dir: str) -> DataFrame:
    """The table function over benchmark texts."""
    sql.register(spark)
    table(spark, sf_dir, "benchmark").createOrReplaceTempView("tariffloom_benchmark")
    return spark.sql("SELECT item_id, chunk, md5(part) AS part FROM tariffloom_benchmark, LATERAL text_chunks(text, 60, 10)")


def checked_amendments(spark, sf_dir: str) -> DataFrame:
    """Entries whose amendments name the old rate that the entry has at that point; others are rejected, not applied."""
    entries, changes = _amendments(spark, sf_dir)
    return P.asserted(entries, changes, "p_partkey")[0]


def rejected_amendments(spark, sf_dir: str) -> DataFrame:
    entries, changes = _amendments(spark, sf_dir)
    return P.asserted(entries, changes, "p_partkey")[1]


def _amendments(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = table(spark, sf_dir, "part")
    entries = p.select("p_partkey", (F.col("p_partkey") % 5).cast("string").alias("rate"))
    step = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("seq")
    changes = p.select("p_partkey", step).select("p_partkey", "seq", F.when((F.col("p_partkey") + F.col("seq")) % 4 == 0, "wrong").otherwise(((F.col("p_partkey") + F.col("seq") - 1) % 5).cast("string")).alias("old"), ((F.col("p_partkey") + F.col("seq")) % 5).cast("string").alias("new"))
    return entries, changes


def do_headers(spark, sf_dir: str) -> DataFrame:
    """Orders with their containers nested, one entry an item, in the order of parts."""
    li = table(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_partkey", "l_suppkey"))).alias("boxes"))
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    out = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return out.select("o_orderkey", "c_name", F.coalesce(F.size("boxes"), F.lit(0)).alias("n"), F.coalesce(F.array_join(F.transform("boxes", lambda b: F.concat_ws("/", b["l_partkey"], b["l_suppkey"])), ","), F.lit("")).alias("boxes"))


_AM = """c AS (SELECT p_partkey, s AS seq, CASE WHEN (p_partkey + s) % 4 = 0 THEN 'wrong' ELSE ((p_partkey + s - 1) % 5)::VARCHAR END AS old, ((p_partkey + s) % 5)::VARCHAR AS new FROM part, (VALUES (1), (2), (3)) t(s)),
r0 AS (SELECT p_partkey, (p_partkey % 5)::VARCHAR AS r FROM part),
r1 AS (SELECT r0.p_partkey, CASE WHEN old = r THEN new ELSE r END AS r, old <> r AS bad FROM r0 JOIN c ON c.p_partkey = r0.p_partkey AND seq = 1),
r2 AS (SELECT r1.p_partkey, CASE WHEN old = r THEN new ELSE r END AS r, old <> r AS bad FROM r1 JOIN c ON c.p_partkey = r1.p_partkey AND seq = 2),
r3 AS (SELECT r2.p_partkey, CASE WHEN old = r THEN new ELSE r END AS r, old <> r AS bad FROM r2 JOIN c ON c.p_partkey = r2.p_partkey AND seq = 3)"""
_FN = (fixed_prices, deposit_prices, custom_houses, zip_entries, plan_recipients, relative_times, remembered_keys, tenant_columns, sql_functions, sql_chunks, checked_amendments, rejected_amendments, do_headers)
QUERIES = {f.__name__: f for f in _FN}
SQL = {
    "fixed_prices": "SELECT l_orderkey, l_partkey, l_suppkey, " + ", ".join(f"printf('%.{n}f', x) AS places_{n}" for n in (2, 3, 4, 5, 6)) + " FROM (SELECT DISTINCT l_orderkey, l_partkey, l_suppkey, l_extendedprice / 7.0::DOUBLE AS x FROM lineitem)",
    "deposit_prices": f"""WITH l AS (SELECT l_orderkey, l_suppkey % 25 AS line, l_partkey % 3 = 0 AS big, CASE WHEN l_partkey % 5 = 0 THEN l_quantity::DECIMAL(14,2) END AS paid FROM lineitem),
p AS (SELECT l_orderkey, paid, CASE WHEN line % 3 = 0 AND line >= 12 THEN NULL WHEN big THEN line * 10 + 2 WHEN line % 4 <> 0 THEN line * 10 + 1 END AS rate FROM l)
SELECT l_orderkey, CASE WHEN paid IS NOT NULL THEN 'paid' WHEN rate IS NULL THEN 'not_applicable' ELSE 'pending' END AS status, count(*) AS n, coalesce(sum(coalesce(paid, rate)), 0)::DECIMAL(18,2) AS expected FROM p GROUP BY 1, 2""",
    "custom_houses": """WITH r AS (SELECT c_custkey AS k, 'IN' || CASE WHEN c_custkey % 4000 < 1000 THEN lpad((c_custkey % 4000)::VARCHAR, 3, 'A') ELSE left((c_custkey % 4000)::VARCHAR, 3) END || CASE WHEN c_custkey % 7 > 0 THEN '4' ELSE '' END AS code, upper('e' || left(c_mktsegment, 2)) AS edi_code, lower('desk@' || c_name) AS mail FROM customer)
SELECT code, arg_min(edi_code, k) AS edi_code, (['Sahar Air Sea', 'Air Cargo Complex', 'ICD Sea Port', 'Harbor of', 'JNPT Dock', 'Petrapole LCS', 'Kandla SEZ', 'Airoli', '', 'CFS Airways Land'])[(min(k) % 10 + 1)::INT] AS name,
 (['air', 'air', 'icd', 'sea', 'sea', 'land', 'sez', NULL, NULL, 'icd'])[(min(k) % 10 + 1)::INT] AS mode, CASE WHEN min(k) % 3 > 0 THEN arg_min(mail, k) ELSE '' END AS email FROM r WHERE length(code) = 6 AND k % 10 <> 8 GROUP BY code""",
    "plan_recipients": """SELECT s_suppkey, CASE WHEN s_nationkey % 3 = 0 AND c_custkey IS NOT NULL THEN 'u' || c_custkey || '@x' ELSE 'desk@' || lower(n_name) END AS recipient FROM supplier LEFT JOIN customer ON c_nationkey = s_nationkey AND s_nationkey % 3 = 0 LEFT JOIN nation ON n_nationkey = s_nationkey
WHERE c_custkey IS NOT NULL OR n_nationkey % 5 > 0""",
    "relative_times": """WITH o AS (SELECT o_orderkey, trunc(pow(1.7, o_orderkey % 30))::BIGINT AS s FROM orders)
SELECT o_orderkey, CASE WHEN s < 60 THEN 'just now' WHEN s < 3600 THEN (s // 60) || ' min ago' WHEN s < 86400 THEN (s // 3600) || ' h ago' WHEN s < 604800 THEN (s // 86400) || ' d ago' ELSE 'earlier' END AS shown FROM o""",
    "remembered_keys": "SELECT c_custkey, upper(replace(c_name, '#', ' ')) AS importer, left('POLY ' || c_mktsegment || ' GRADE A VERY LONG DESCRIPTION OF GOODS', 40) AS description FROM customer",
    "tenant_columns": "SELECT c_custkey, c_mktsegment FROM customer WHERE c_nationkey = 3",
    "sql_functions": """WITH p AS (SELECT p_partkey, p_name, p_size, (p_partkey * 7919)::VARCHAR AS v FROM part) SELECT p_partkey, regexp_replace(upper(p_name), '[^A-Z0-9]', '', 'g') AS bare, rpad(left(v, 5), 8, '0') AS padded, CASE WHEN length(v) >= 4 THEN left(v, 8) END AS hs, (p_size * 0.075)::DECIMAL(28,10) AS duty,
 CASE WHEN p_partkey % 9 - 4 < 0 THEN 'overdue' WHEN p_partkey % 9 - 4 <= 2 THEN 'due' ELSE 'soon' END AS level FROM p""",
    "sql_chunks": "SELECT item_id, k::INT AS chunk, md5(substring(text, k * 50 + 1, 60)) AS part FROM (SELECT item_id, text, unnest(range(greatest(1, ceil((length(text) - 10) / 50.0)::INT))) AS k FROM benchmark)",
    "checked_amendments": f"WITH {_AM} SELECT p_partkey, r AS rate FROM r3",
    "rejected_amendments": f"WITH {_AM} SELECT p_partkey, 1 AS seq FROM r1 WHERE bad UNION ALL SELECT p_partkey, 2 FROM r2 WHERE bad UNION ALL SELECT p_partkey, 3 FROM r3 WHERE bad",
    "do_headers": "SELECT o_orderkey, c_name, count(l_partkey)::INT AS n, coalesce(string_agg(l_partkey || '/' || l_suppkey, ',' ORDER BY l_partkey, l_suppkey), '') AS boxes FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_quantity > 40 LEFT JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2",
}
