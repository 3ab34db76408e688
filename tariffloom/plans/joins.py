"""Lookup, semi-, anti-, interval and containment joins over the fixture."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import match_key
from ..operators import containment as C
from ..operators import joins as J
from ..operators.matching import similar_keys
from .fixture import AS_OF, HS_SQL, hs, table


def overlay_masters(spark, sf_dir: str) -> DataFrame:
    """Customers as seed, suppliers as overlay on the same key."""
    seed = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.lit("seed").alias("origin"))
    over = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.lit("overlay").alias("origin"))
    return J.overlay(over, seed, ["key"])


def merged_ports(spark, sf_dir: str) -> DataFrame:
    """Curated and generated masters by key, aliases united."""
    curated = table(spark, sf_dir, "supplier").where("s_suppkey % 2 = 0").select(F.col("s_suppkey").alias("code"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("S-"), F.col("s_suppkey").cast("string"))).alias("aliases"))
    generated = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("code"), F.col("c_name").alias("name"), F.array(F.concat(F.lit("C-"), F.col("c_custkey").cast("string"))).alias("aliases"))
    return J.merged_masters(curated, generated, "code")


def semi_pending(spark, sf_dir: str) -> DataFrame:
    """Orders with a returned item."""
    pending = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select("l_orderkey")
    o = table(spark, sf_dir, "orders")
    return o.join(pending, o.o_orderkey == pending.l_orderkey, "left_semi").select("o_orderkey", "o_orderstatus")


def anti_new_docs(spark, sf_dir: str) -> DataFrame:
    """Documents by digest: the first of equals in the batch, without those stored before (even ids)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"))
    stored = docs.where("doc_id % 2 = 0").select("sha256").distinct()
    batch = docs.where("doc_id % 2 = 1").groupBy("sha256").agg(F.min("doc_id").alias("doc_id"))
    return batch.join(stored, "sha256", "left_anti").select("doc_id", "sha256")


def batch_is_known(spark, sf_dir: str) -> DataFrame:
    """Per source: whether all digests of its odd documents are stored by even ones."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", F.sha2("text", 256).alias("sha256"))
    stored = docs.where("doc_id % 2 = 0").select("sha256", F.lit(1).alias("seen")).distinct()
    batch = docs.where("doc_id % 2 = 1").select("source", "sha256").distinct().join(stored, "sha256", "left")
    return batch.groupBy("source").agg(F.count("*").alias("digests"), F.count("seen").alias("seen")).withColumn("known", F.col("digests") == F.col("seen"))


def lookup_with_default(spark, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").where("n_nationkey % 3 > 0")
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", F.coalesce("n_name", F.lit("—")).alias("nation"))


def _securities(spark, sf_dir: str) -> DataFrame:
    """Importers' securities by segment: some inactive, some with open ends, some past or to come."""
    c = table(spark, sf_dir, "customer")
    start = F.when(F.col("c_custkey") % 4 > 0, F.date_add(F.lit("1997-01-01").cast("date"), (F.col("c_custkey") % 500).cast("int")))
    end = F.when(F.col("c_custkey") % 3 > 0, F.date_add(F.lit("1997-06-01").cast("date"), (F.col("c_custkey") % 700).cast("int")))
    return c.select(F.col("c_custkey").alias("pos"), F.col("c_nationkey").alias("line"), (F.col("c_custkey") % 7 > 0).alias("active"), start.alias("valid_from"), end.alias("valid_to"), F.when(F.col("c_custkey") % 5 > 0, "FCL").otherwise("LCL").alias("mode"))


def validity_join(spark, sf_dir: str) -> DataFrame:
    """Why a supplier's line has cover or not: the first active security of its line decides, whatever its dates."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 9 > 0, F.col("s_nationkey")).alias("line"))
    first = J.first_match(_securities(spark, sf_dir).where("active"), ["line"], F.col("pos"))
    day = F.lit(AS_OF).cast("date")
    status = F.when(F.col("line").isNull(), "unknown").when(F.col("pos").isNull(), "none").when(F.col("valid_to") < day, "expired").when(F.col("valid_from") > day, "not_yet_valid").when(F.col("mode") != "FCL", "mode").otherwise("covered")
    return s.join(first, "line", "left").select("s_suppkey", "pos", status.alias("status"))


def rate_fallback(spark, sf_dir: str) -> DataFrame:
    """Deposit rates by line and size, else by line and any size."""
    n = table(spark, sf_dir, "nation")
    sizes = F.explode(F.array(F.lit("20"), F.lit("*"))).alias("size")
    rates = n.select(F.col("n_nationkey").alias("line"), sizes).where("NOT (size = '20' AND line % 2 = 0) AND NOT (size = '*' AND line % 5 = 0)").withColumn("rate", (F.col("line") * 100 + F.length("size")).cast("bigint"))
    boxes = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("line"), F.when(F.col("s_suppkey") % 2 == 0, "20").otherwise("40").alias("size"))
    return J.with_fallback(boxes, rates, ["line", "size"], "size", "*", "rate").select("s_suppkey", "line", "size", "rate")


def chapter_rule(spark, sf_dir: str) -> DataFrame:
    """The first rule whose chapter range holds the part's chapter."""
    rules = spark.createDataFrame([(1, 1, 24, "food"), (2, 20, 40, "chemical"), (3, 84, 85, "machine"), (4, 28, 38, "never first")], "rule int, lo int, hi int, agency string")
    p = table(spark, sf_dir, "part").select("p_partkey", F.substring(hs("p_partkey"), 1, 2).cast("int").alias("chapter"))
    pairs = p.join(rules, F.col("chapter").between(F.col("lo"), F.col("hi")))
    return J.first_match(pairs, ["p_partkey"], F.col("rule")).select("p_partkey", "chapter", "rule", "agency")


def alias_join(spark, sf_dir: str) -> DataFrame:
    """Names or aliases by match key; the first master row of equals."""
    masters = table(spark, sf_dir, "supplier").select("s_suppkey", F.array("s_name", F.concat(F.lit("Old "), F.regexp_replace("s_name", "[^0-9]", ""), F.lit(" Pvt. Ltd."))).alias("names"))
    keys = masters.select("s_suppkey", F.explode("names").alias("n")).select(match_key(F.col("n")).alias("k"), "s_suppkey").groupBy("k").agg(F.min("s_suppkey").alias("s_suppkey"))
    asked = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("OLD "), F.regexp_replace("c_name", "[^0-9]", ""), F.when(F.col("c_custkey") % 2 == 0, " PRIVATE LIMITED").otherwise(" GmbH.")).alias("asked"))
    return asked.withColumn("k", match_key(F.col("asked"))).join(keys, "k").select("c_custkey", "asked", "s_suppkey")


def containment_join(spark, sf_dir: str) -> DataFrame:
    """The first nation whose name holds, or is held by, a stated text."""
    asked = table(spark, sf_dir, "region").select("r_regionkey", F.concat(F.lit("PORT OF NATION_"), F.col("r_regionkey").cast("string")).alias("asked"))
    pairs = C.containing(asked, "asked", table(spark, sf_dir, "nation"), "n_name")
    return J.first_match(pairs, ["r_regionkey"], F.col("n_nationkey")).select("r_regionkey", "asked", "n_name")


def loose_port(spark, sf_dir: str) -> DataFrame:
    """The longest master name that stands in a text at word bounds."""
    ports = table(spark, sf_dir, "nation").select(F.regexp_replace("n_name", "_", " ").alias("port"))
    texts = table(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("vessel at nation "), (F.col("c_custkey") % 30).cast("string"), F.lit(" / india")).alias("place"))
    words = texts.withColumn("words", F.trim(F.regexp_replace(F.upper("place"), "[^A-Z0-9]+", " ")))
    pairs = C.with_words(words, "words", ports, "port")
    return J.first_match(pairs, ["c_custkey"], -F.length("port"), F.col("port")).select("c_custkey", "place", "port")


def memory_recall(spark, sf_dir: str) -> DataFrame:
    """What is known of a product: by importer and description, else by importer where the first twenty characters of one begin the other."""
    memory = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pos"), (F.col("p_partkey") % 10).alias("importer"), F.substring("p_name", 1, 40).alias("known"), hs("p_partkey").alias("ritc"))
    asked = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_partkey") % 10).alias("importer"), F.when(F.col("p_partkey") % 3 == 0, F.col("p_name")).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" grade"))).otherwise(F.substring("p_name", 1, 12)).alias("asked"))
    return J.recalled(asked, "p_partkey", "asked", memory, "known", "pos").select("p_partkey", "asked", "stage", "pos", "ritc")


def conditions_in_order(spark, sf_dir: str) -> DataFrame:
    """Cited conditions looked up, in the order of citation."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.array(F.col("o_orderkey") % 25, F.col("o_orderkey") % 7, F.col("o_orderkey") % 40).alias("cited"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    cited = o.select("o_orderkey", F.posexplode("cited").alias("pos", "no")).join(n, F.col("no") == F.col("n_nationkey"))
    ordered = cited.groupBy("o_orderkey").agg(F.array_sort(F.collect_list(F.struct("pos", "n_name"))).alias("c"))
    return ordered.select("o_orderkey", F.array_join(F.transform("c", lambda x: x["n_name"]), ",").alias("names"))


def star_summary(spark, sf_dir: str) -> DataFrame:
    """Each order with its customer, its number of items and of open ones; children are filtered and counted before the join."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_items"), F.count_if(F.col("l_linestatus") == "O").alias("n_open"))
    o = table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    joined = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(c, F.col("o_custkey") == F.col("c_custkey"), "left")
    return joined.select("o_orderkey", F.coalesce("c_name", F.lit("Untitled")).alias("title"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_open", F.lit(0)).alias("n_open"))


def party_trigrams(spark, sf_dir: str) -> DataFrame:
    """For each asked name the three most similar ones of the master, by shared 3-grams."""
    p = table(spark, sf_dir, "part")
    names = p.groupBy(F.col("p_name").alias("key")).agg(F.min("p_partkey").alias("p_partkey"))
    asked = p.groupBy(F.concat("p_name", F.lit(" co")).alias("key")).agg(F.max("p_partkey").alias("asked"))
    near = similar_keys(asked, "asked", names, "p_partkey", 5000)
    w = Window.partitionBy("asked").orderBy(F.desc("sim"), "p_partkey")
    return near.withColumn("k", F.row_number().over(w)).where("k <= 3").select("asked", "p_partkey", F.col("sim").alias("score"))


_LONG = "regexp_replace({}, '[^0-9]', '', 'g')"
_MK = r"regexp_replace(regexp_replace(upper({}), '\b(?:PVT|PRIVATE|LTD|LIMITED|LLP|INC|CO|COMPANY|FZE|FZCO|GMBH)\b', '', 'g'), '[^A-Z0-9]', '', 'g')"
_GRAMS = "list_distinct(list_transform(range(1, length('  ' || {0} || ' ') - 1), lambda i: substring('  ' || {0} || ' ', i, 3)))"
QUERIES = {f.__name__: f for f in (overlay_masters, merged_ports, semi_pending, anti_new_docs, batch_is_known, lookup_with_default, validity_join, rate_fallback, chapter_rule, alias_join, containment_join, loose_port, memory_recall, conditions_in_order, star_summary, party_trigrams)}
SQL = {
    "overlay_masters": "SELECT s_suppkey AS key, s_name AS name, 'overlay' AS origin FROM supplier UNION ALL SELECT c_custkey, c_name, 'seed' FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)",
    "merged_ports": """WITH a AS (SELECT s_suppkey AS code, s_name AS name, ['S-' || s_suppkey] AS aliases FROM supplier WHERE s_suppkey % 2 = 0), b AS (SELECT c_custkey AS code, c_name AS name, ['C-' || c_custkey] AS aliases FROM customer)
SELECT coalesce(a.code, b.code) AS code, coalesce(a.name, b.name) AS name,
  list_sort(list_distinct(list_concat(coalesce(a.aliases, []), coalesce(b.aliases, []), CASE WHEN a.name <> b.name THEN [b.name] ELSE [] END))) AS aliases FROM a FULL JOIN b ON a.code = b.code""",
    "semi_pending": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')",
    "anti_new_docs": "SELECT min(doc_id) AS doc_id, sha256(text) AS sha256 FROM documents WHERE doc_id % 2 = 1 AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE doc_id % 2 = 0) GROUP BY sha256(text)",
    "batch_is_known": """WITH d AS (SELECT DISTINCT source, text FROM documents WHERE doc_id % 2 = 1), s AS (SELECT DISTINCT text FROM documents WHERE doc_id % 2 = 0)
SELECT source, count(*) AS digests, count(s.text) AS seen, count(*) = count(s.text) AS known FROM d LEFT JOIN s ON d.text = s.text GROUP BY source""",
    "lookup_with_default": "SELECT c_custkey, coalesce(n_name, '—') AS nation FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_nationkey % 3 > 0) ON c_nationkey = n_nationkey",
    "validity_join": f"""WITH sec AS (SELECT c_custkey AS pos, c_nationkey AS line,
    CASE WHEN c_custkey % 4 > 0 THEN '1997-01-01'::DATE + (c_custkey % 500)::INT END AS valid_from, CASE WHEN c_custkey % 3 > 0 THEN '1997-06-01'::DATE + (c_custkey % 700)::INT END AS valid_to, c_custkey % 5 = 0 AS lcl
  FROM customer WHERE c_custkey % 7 > 0 QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1),
s AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 > 0 THEN s_nationkey END AS line FROM supplier)
SELECT s_suppkey, pos, CASE WHEN s.line IS NULL THEN 'unknown' WHEN pos IS NULL THEN 'none' WHEN valid_to < '{AS_OF}' THEN 'expired' WHEN valid_from > '{AS_OF}' THEN 'not_yet_valid' WHEN lcl THEN 'mode' ELSE 'covered' END AS status
FROM s LEFT JOIN sec USING (line)""",
    "rate_fallback": """WITH r AS (SELECT n_nationkey AS line, size, (n_nationkey * 100 + length(size))::BIGINT AS rate FROM nation, (VALUES ('20'), ('*')) v(size) WHERE NOT (size = '20' AND n_nationkey % 2 = 0) AND NOT (size = '*' AND n_nationkey % 5 = 0)),
b AS (SELECT s_suppkey, s_nationkey AS line, CASE WHEN s_suppkey % 2 = 0 THEN '20' ELSE '40' END AS size FROM supplier)
SELECT s_suppkey, b.line, b.size, coalesce(x.rate, g.rate) AS rate FROM b LEFT JOIN r x ON b.line = x.line AND b.size = x.size AND x.size <> '*' LEFT JOIN r g ON b.line = g.line AND g.size = '*'""",
    "chapter_rule": f"""SELECT p_partkey, chapter, rule, agency FROM (SELECT p_partkey, left({HS_SQL.format('p_partkey')}, 2)::INT AS chapter FROM part)
JOIN (VALUES (1, 1, 24, 'food'), (2, 20, 40, 'chemical'), (3, 84, 85, 'machine'), (4, 28, 38, 'never first')) r(rule, lo, hi, agency) ON chapter BETWEEN lo AND hi QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY rule) = 1""",
    "alias_join": f"""WITH k AS (SELECT {_MK.format('n')} AS k, min(s_suppkey) AS s_suppkey FROM (SELECT s_suppkey, unnest([s_name, 'Old ' || {_LONG.format('s_name')} || ' Pvt. Ltd.']) AS n FROM supplier) GROUP BY 1),
a AS (SELECT c_custkey, 'OLD ' || {_LONG.format('c_name')} || CASE WHEN c_custkey % 2 = 0 THEN ' PRIVATE LIMITED' ELSE ' GmbH.' END AS asked FROM customer)
SELECT c_custkey, asked, s_suppkey FROM a JOIN k ON k.k = {_MK.format('asked')}""",
    "containment_join": "SELECT r_regionkey, asked, n_name FROM (SELECT r_regionkey, 'PORT OF NATION_' || r_regionkey AS asked FROM region) JOIN nation ON contains(asked, n_name) OR contains(n_name, asked) QUALIFY row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) = 1",
    "loose_port": r"""WITH t AS (SELECT c_custkey, 'vessel at nation ' || (c_custkey % 30) || ' / india' AS place FROM customer), p AS (SELECT replace(n_name, '_', ' ') AS port FROM nation)
SELECT c_custkey, place, port FROM t JOIN p ON contains(' ' || regexp_replace(upper(place), '[^A-Z0-9]+', ' ', 'g') || ' ', ' ' || port || ' ') QUALIFY row_number() OVER (PARTITION BY c_custkey ORDER BY length(port) DESC, port) = 1""",
    "memory_recall": f"""WITH m AS (SELECT p_partkey AS pos, p_partkey % 10 AS importer, left(p_name, 40) AS known, {HS_SQL.format('p_partkey')} AS ritc FROM part),
a AS (SELECT p_partkey, p_partkey % 10 AS importer, CASE p_partkey % 3 WHEN 0 THEN p_name WHEN 1 THEN p_name || ' grade' ELSE left(p_name, 12) END AS asked FROM part),
x AS (SELECT p_partkey, asked, CASE WHEN asked = known THEN 1 ELSE 2 END AS stage, pos, ritc FROM a JOIN m USING (importer) WHERE asked = known OR starts_with(asked, left(known, 20)) OR starts_with(known, left(asked, 20)))
SELECT p_partkey, asked, stage, pos, ritc FROM x QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY stage, pos) = 1""",
    "conditions_in_order": "SELECT o_orderkey, string_agg(n_name, ',' ORDER BY pos) AS names FROM (SELECT o_orderkey, unnest([o_orderkey % 25, o_orderkey % 7, o_orderkey % 40]) AS no, unnest([0, 1, 2]) AS pos FROM orders) JOIN nation ON no = n_nationkey GROUP BY o_orderkey",
    "star_summary": """SELECT o_orderkey, coalesce(c_name, 'Untitled') AS title, coalesce(n_items, 0) AS n_items, coalesce(n_open, 0) AS n_open FROM orders
LEFT JOIN (SELECT l_orderkey, count(*) AS n_items, count(*) FILTER (l_linestatus = 'O') AS n_open FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey LEFT JOIN customer ON o_custkey = c_custkey""",
    "party_trigrams": f"""WITH s AS (SELECT max(p_partkey) AS asked, {_GRAMS.format("(p_name || ' co')")} AS g FROM part GROUP BY p_name), c AS (SELECT min(p_partkey) AS p_partkey, {_GRAMS.format('p_name')} AS h FROM part GROUP BY p_name),
x AS (SELECT asked, p_partkey, floor(len(list_intersect(g, h)) * 10000 / (len(g) + len(h) - len(list_intersect(g, h))))::BIGINT AS score FROM s, c)
SELECT asked, p_partkey, score FROM x WHERE score >= 5000 QUALIFY row_number() OVER (PARTITION BY asked ORDER BY score DESC, p_partkey) <= 3""",
}
