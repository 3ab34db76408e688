"""Boards, alerts and states over the fixture; the day of reference is fixed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import level_rank
from ..operators import workflow as W
from .fixture import AS_OF, table

STAGES = ["new", "documents_received", "scrutiny", "exported", "closed"]
MOVES = {("open", "signup"): "documents", ("documents", "view"): "invoice", ("documents", "click"): "payment", ("invoice", "click"): "payment", ("payment", "purchase"): "delivered", ("delivered", "error"): "payment", ("delivered", "view"): "closed"}


def _as_of():
    return F.lit(AS_OF).cast("date")


def stage_counts(spark, sf_dir: str) -> DataFrame:
    """Open jobs among the latest 500 by stage, each stage listed."""
    o = table(spark, sf_dir, "orders")
    latest = o.orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(500)
    stage = F.element_at(F.array(*map(F.lit, STAGES)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    counts = latest.where("o_orderstatus <> 'F'").groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))
    dim = spark.createDataFrame([(k, s) for k, s in enumerate(STAGES)], "ordinal int, stage string")
    return dim.join(counts, "stage", "left").select("ordinal", "stage", F.coalesce("n", F.lit(0)).alias("n"))


def documents_per_job(spark, sf_dir: str) -> DataFrame:
    counts = table(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return table(spark, sf_dir, "orders").join(counts, F.col("o_orderkey") == F.col("l_orderkey"), "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"))


def latest_draft(spark, sf_dir: str) -> DataFrame:
    """The latest version per order; version numbers follow the ship date."""
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(F.max(F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_linenumber")).alias("v"), F.count("*").alias("versions")).select("l_orderkey", F.to_date("v.l_shipdate").alias("day"), F.col("v.l_partkey").alias("part"), "versions")


def latest_event(spark, sf_dir: str) -> DataFrame:
    """Per user and type the latest event, with a typed field of its payload."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id", "event_type").agg(F.max_by(F.struct("event_id", "props"), F.struct("ts", "event_id")).alias("x")).select("user_id", "event_type", "x.event_id", F.get_json_object("x.props", "$.k").try_cast("int").alias("k"))


def job_states(spark, sf_dir: str) -> DataFrame:
    return W.replayed(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", "event_type", "open", MOVES)


def _jobs(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    pick = lambda n, m: F.col("o_orderkey") % n == m
    return o.select(
        "o_orderkey", F.when(~pick(11, 0), day).alias("eta"), pick(3, 0).alias("scrutinised"), F.when(pick(10, 0), "closed").otherwise("open").alias("status"), F.when(pick(4, 0), day).alias("returned_on"),
        F.when(~pick(5, 0), (F.col("o_orderkey") % 14).cast("int")).alias("free_days"), F.when(pick(2, 0), F.date_add(day, 2)).alias("free_from"), F.when(pick(3, 1), F.date_add(day, 5)).alias("delivered_at"),
        (F.col("o_orderkey") % 3).cast("int").alias("deposits_open"), F.when(pick(2, 1), F.date_add(day, 20)).alias("valid_until"),
    )


def delivery_alerts(spark, sf_dir: str) -> DataFrame:
    return W.delivery_alerts(_jobs(spark, sf_dir), "o_orderkey", _as_of())


def alert_board(spark, sf_dir: str) -> DataFrame:
    """The worst level of each job that has alerts."""
    return W.worst_level(delivery_alerts(spark, sf_dir), "o_orderkey")


def _clearances(spark, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.to_date("o_orderdate")
    pick = lambda n, m: F.col("o_orderkey") % n == m
    return o.select("o_orderkey", pick(7, 0).alias("variance_open"), F.when(pick(3, 0), F.date_sub(_as_of(), (F.col("o_orderkey") % 8).cast("int"))).alias("query_opened"), (F.col("o_orderkey") % 2).cast("int").alias("pending_nocs"), F.when(pick(5, 1), "out_of_charge").otherwise("passing").alias("status"), F.when(pick(4, 0), day).alias("planned_for"), F.when(pick(5, 1) | pick(5, 2), day).alias("out_of_charge_on"), pick(2, 0).alias("duty_paid"))


def clearance_alerts(spark, sf_dir: str) -> DataFrame:
    return W.clearance_alerts(_clearances(spark, sf_dir), "o_orderkey", _as_of())


def settled(spark, sf_dir: str) -> DataFrame:
    """Per order: whether all returned items are settled (true of none), whether there are any and all are final, whether one is."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_returnflag") == "R").alias("n"), F.count_if((F.col("l_returnflag") == "R") & (F.col("l_linestatus") == "F")).alias("f"))
    return li.select("l_orderkey", (F.col("n") == F.col("f")).alias("every"), ((F.col("n") > 0) & (F.col("n") == F.col("f"))).alias("some_and_every"), (F.col("f") > 0).alias("any"))


def deposit_expected(spark, sf_dir: str) -> DataFrame:
    """What deposits come to: paid amounts stay, covered ones count nothing, others the rate of their line and size."""
    li = table(spark, sf_dir, "lineitem")
    paid = F.when(F.col("l_partkey") % 5 == 0, F.col("l_quantity").cast("decimal(14,2)"))
    amount = F.when(F.col("l_suppkey") % 4 == 0, F.lit(0).cast("decimal(14,2)")).otherwise(F.coalesce(paid, F.when(F.col("l_suppkey") % 3 > 0, F.lit(100).cast("decimal(14,2)")), F.lit(150).cast("decimal(14,2)")))
    return li.groupBy("l_orderkey").agg(F.sum(amount).cast("decimal(18,2)").alias("expected"), F.count_if(F.col("l_suppkey") % 4 == 0).alias("covered"))


def plan_queue(spark, sf_dir: str) -> DataFrame:
    """Orders as delivery plans of their customer's nation, decided some minutes before the day of reference, many on the very edge of the last day."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    now = F.lit(f"{AS_OF} 00:00:00").cast("timestamp_ntz")
    k = F.col("o_orderkey")
    minutes = F.make_dt_interval(mins=(k % 97 * 30).cast("int"))
    plans = o.select(
        k.alias("plan"), (k - k % 2).alias("job"), F.when(k % 13 > 0, F.col("c_nationkey")).alias("station"), F.to_date("o_orderdate").alias("planned_for"), F.when(F.col("o_orderstatus") == "P", "pending").when(F.col("o_orderstatus") == "F", "accepted").otherwise("rejected").alias("status"),
        F.when(F.col("o_orderstatus") != "P", now - minutes).alias("decided_at"), F.when(k % 5 == 0, F.col("o_orderpriority")).alias("note"), F.when(k % 3 == 0, now).alias("notified_at"),
    )
    jobs = o.where("o_orderkey % 2 = 0").select(k.alias("job"), F.when(k % 3 > 0, F.concat(F.lit("J"), k.cast("string"))).alias("number"), F.when(k % 9 > 0, F.concat(F.lit("Goods of "), "c_name")).alias("title"), F.when(k % 4 == 0, F.col("c_name")).alias("importer"))
    stations = table(spark, sf_dir, "nation").where("n_nationkey % 6 > 0").select(F.col("n_nationkey").alias("station"), F.col("n_name").alias("name"))
    return W.plan_queue(plans, jobs, stations, now)


def poll_counters(spark, sf_dir: str) -> DataFrame:
    """Events by user and outcome, as columns."""
    e = table(spark, sf_dir, "events")
    return e.groupBy("user_id").agg(F.count("*").alias("seen"), *[F.count_if(F.col("event_type") == t).alias(t) for t in ("signup", "purchase", "error", "view", "click")])


def pending_messages(spark, sf_dir: str) -> DataFrame:
    """Per user the oldest 25 events still to do, with fewer than five attempts."""
    e = table(spark, sf_dir, "events").where((F.col("event_type") == "error") | (F.col("event_id") % 2 == 0)).where("event_id % 7 < 5")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return e.withColumn("k", F.row_number().over(w)).where("k <= 25").select("user_id", "event_id", "k")


def claim(spark, sf_dir: str) -> DataFrame:
    """The connection due longest: active, not locked or with a stale lock."""
    c = table(spark, sf_dir, "customer").where((F.col("c_mktsegment") == "BUILDING") & ((F.col("c_custkey") % 3 > 0) | (F.col("c_acctbal") < 0)))
    return c.orderBy("c_acctbal", "c_custkey").limit(1).select("c_custkey", "c_acctbal")


def urgent(spark, sf_dir: str) -> DataFrame:
    """Alerts in the order of days left, then of level, numbered."""
    w = Window.orderBy("days_left", F.desc(level_rank(F.col("level"))), "o_orderkey", "kind")
    top = delivery_alerts(spark, sf_dir).orderBy("days_left", F.desc(level_rank(F.col("level"))), "o_orderkey", "kind").limit(50)
    return top.withColumn("place", F.row_number().over(w)).select("place", "o_orderkey", "kind", "days_left")


def board(spark, sf_dir: str) -> DataFrame:
    """The dashboard: open jobs among the latest 500 by stage, and those with each kind of alert, with the fewest days left."""
    latest = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(500).where("o_orderstatus <> 'F'")
    stage = F.element_at(F.array(*map(F.lit, STAGES)), (F.col("o_orderkey") % 4 + 1).cast("int"))
    mine = latest.select("o_orderkey", stage.alias("line"), F.lit(None).cast("int").alias("days_left"))
    ours = lambda jobs: jobs.join(mine.select("o_orderkey"), "o_orderkey", "left_semi")
    late = W.delivery_alerts(ours(_jobs(spark, sf_dir)), "o_orderkey", _as_of()).where("kind IN ('free_time', 'deposit_refund')")
    held = W.clearance_alerts(ours(_clearances(spark, sf_dir)), "o_orderkey", _as_of()).where("kind IN ('duty_variance', 'awaiting_cfs', 'query_open')")
    lines = reduce(DataFrame.unionByName, [mine, *(a.select("o_orderkey", F.col("kind").alias("line"), "days_left") for a in (late, held))])
    return lines.groupBy("line").agg(F.count("*").alias("n"), F.min("days_left").alias("days_left"))


def board_rows(spark, sf_dir: str) -> DataFrame:
    """Alerts of the open jobs among the latest 500, line by line, the soonest first."""
    latest = table(spark, sf_dir, "orders").orderBy(F.desc("o_orderdate"), F.desc("o_orderkey")).limit(500).where("o_orderstatus <> 'F'")
    named = latest.join(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"), "left")
    jobs = named.select("o_orderkey", F.when(F.col("o_orderkey") % 3 > 0, F.concat(F.lit("J"), F.col("o_orderkey").cast("string"))).otherwise("Untitled job").alias("label"), F.col("c_name").alias("importer"), (-F.unix_date(F.to_date("o_orderdate"))).alias("at"))
    late = W.delivery_alerts(_jobs(spark, sf_dir), "o_orderkey", _as_of()).where("kind IN ('free_time', 'deposit_refund')")
    held = W.clearance_alerts(_clearances(spark, sf_dir), "o_orderkey", _as_of()).where("kind IN ('duty_variance', 'awaiting_cfs', 'query_open')")
    return W.board_rows(late.select("o_orderkey", "kind", "days_left").unionByName(held.select("o_orderkey", "kind", "days_left")), jobs, "o_orderkey", "at")


def cited_requests(spark, sf_dir: str) -> DataFrame:
    """Line items as missing documents that cite a requirement; an order knows ten of them, and some requests are stored."""
    k, code = F.col("l_orderkey"), lambda c: F.concat(F.lit("C"), c.cast("string"))
    at = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    missing = table(spark, sf_dir, "lineitem").select(k.alias("job"), F.concat(F.lit("Document "), (F.col("l_partkey") % 9).cast("string")).alias("name"), F.col("l_linestatus").alias("reason"), F.when(F.col("l_suppkey") % 4 > 0, code(F.col("l_suppkey") % 20)).alias("code"), at.alias("at"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"))
    known = o.select("job", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("j")).select("job", code((F.col("job") + F.col("j") % 10) % 20).alias("code"))
    stored = o.where("job % 5 = 0").select("job", F.concat(F.lit("Document "), (F.col("job") % 9).cast("string")).alias("name"))
    return W.requested(missing, known, stored, "at")


_JOBS = f"""jobs AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN o_orderdate::DATE END AS eta, o_orderkey % 3 = 0 AS scrutinised, CASE WHEN o_orderkey % 10 = 0 THEN 'closed' ELSE 'open' END AS status, CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate::DATE END AS returned_on,
  CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 14)::INT END AS free_days, CASE WHEN o_orderkey % 2 = 0 THEN o_orderdate::DATE + 2 END AS free_from, CASE WHEN o_orderkey % 3 = 1 THEN o_orderdate::DATE + 5 END AS delivered_at, (o_orderkey % 3)::INT AS deposits_open, CASE WHEN o_orderkey % 2 = 1 THEN o_orderdate::DATE + 20 END AS valid_until
  FROM orders),
due AS (SELECT o_orderkey, 'invoice_call' AS kind, eta - 1 AS due_on, 1 AS within, 3 AS ahead FROM jobs WHERE NOT scrutinised AND status <> 'closed'
  UNION ALL SELECT o_orderkey, 'free_time', coalesce(free_from, eta) + free_days, 3, 3 FROM jobs WHERE returned_on IS NULL
  UNION ALL SELECT o_orderkey, 'deposit_refund', delivered_at + 15, 3, 15 FROM jobs WHERE deposits_open > 0
  UNION ALL SELECT o_orderkey, 'do_expiry', valid_until, 3, 3 FROM jobs WHERE delivered_at IS NULL),
alerts AS (SELECT o_orderkey, kind, due_on, (due_on - '{AS_OF}'::DATE)::INT AS days_left, CASE WHEN due_on < '{AS_OF}' THEN 'overdue' WHEN due_on - '{AS_OF}'::DATE <= within THEN 'due' ELSE 'soon' END AS level FROM due WHERE due_on - '{AS_OF}'::DATE <= ahead)"""
_RANK = "CASE level WHEN 'overdue' THEN 3 WHEN 'due' THEN 2 ELSE 1 END"
_STEP = " ".join(f"WHEN '{s}>{e}' THEN '{t}'" for (s, e), t in MOVES.items())
QUERIES = {f.__name__: f for f in (stage_counts, documents_per_job, latest_draft, latest_event, job_states, delivery_alerts, alert_board, clearance_alerts, settled, deposit_expected, plan_queue, poll_counters, pending_messages, claim, urgent, board, board_rows, cited_requests)}
SQL = {
    "stage_counts": """WITH l AS (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500), c AS (SELECT (['new','documents_received','scrutiny','exported'])[(o_orderkey % 4 + 1)::INT] AS stage, count(*) AS n FROM l WHERE o_orderstatus <> 'F' GROUP BY 1)
SELECT ordinal, d.stage, coalesce(n, 0) AS n FROM (VALUES (0, 'new'), (1, 'documents_received'), (2, 'scrutiny'), (3, 'exported'), (4, 'closed')) d(ordinal, stage) LEFT JOIN c ON c.stage = d.stage""",
    "documents_per_job": "SELECT o_orderkey, count(l_orderkey) AS n FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_returnflag = 'A' GROUP BY o_orderkey",
    "latest_draft": "SELECT l_orderkey, l_shipdate::DATE AS day, l_partkey AS part, versions FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey) AS versions, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_linenumber DESC) AS k FROM lineitem) WHERE k = 1",
    "latest_event": "SELECT user_id, event_type, event_id, try_cast(json_extract_string(props, '$.k') AS INT) AS k FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1",
    "job_states": f"""WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events),
r AS (SELECT user_id, 0::BIGINT AS k, n, 'open' AS state FROM e WHERE k = 1 UNION ALL SELECT r.user_id, r.k + 1, r.n, CASE r.state || '>' || e.event_type {_STEP} ELSE r.state END FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1)
SELECT user_id, state, n::INT AS n_events FROM r WHERE k = n""",
    "delivery_alerts": f"WITH {_JOBS} SELECT o_orderkey, kind, due_on, days_left, level FROM alerts",
    "alert_board": f"WITH {_JOBS} SELECT o_orderkey, (['soon','due','overdue'])[max({_RANK})] AS worst, count(*) AS n_alerts, min(days_left) AS days_left FROM alerts GROUP BY o_orderkey",
    "clearance_alerts": f"""WITH j AS (SELECT o_orderkey, o_orderdate::DATE AS day, o_orderkey % 5 = 1 AS held, o_orderkey % 5 IN (1, 2) AS gone, '{AS_OF}'::DATE AS today FROM orders)
SELECT o_orderkey, 'duty_variance' AS kind, 'overdue' AS level, NULL::DATE AS due_on, -1 AS days_left FROM j WHERE o_orderkey % 7 = 0
UNION ALL SELECT o_orderkey, 'query_open', CASE WHEN o_orderkey % 8 >= 4 THEN 'overdue' ELSE 'due' END, today - (o_orderkey % 8)::INT, (-(o_orderkey % 8))::INT FROM j WHERE o_orderkey % 3 = 0 AND o_orderkey % 8 >= 2
UNION ALL SELECT o_orderkey, 'noc_pending', CASE WHEN held THEN 'due' ELSE 'soon' END, NULL, 0 FROM j WHERE o_orderkey % 2 = 1 AND NOT gone
UNION ALL SELECT o_orderkey, 'awaiting_cfs', CASE WHEN day < today THEN 'overdue' WHEN day - today <= 1 THEN 'due' ELSE 'soon' END, day, (day - today)::INT FROM j WHERE o_orderkey % 4 = 0
UNION ALL SELECT o_orderkey, 'ooc_without_duty', 'overdue', day, (day - today)::INT FROM j WHERE gone AND o_orderkey % 2 = 1""",
    "settled": """WITH s AS (SELECT l_orderkey, count(*) FILTER (l_returnflag = 'R') AS n, count(*) FILTER (l_returnflag = 'R' AND l_linestatus = 'F') AS f FROM lineitem GROUP BY 1) SELECT l_orderkey, n = f AS every, n > 0 AND n = f AS some_and_every, f > 0 AS "any" FROM s""",
    "deposit_expected": "SELECT l_orderkey, sum(CASE WHEN l_suppkey % 4 = 0 THEN 0 WHEN l_partkey % 5 = 0 THEN l_quantity::DECIMAL(14,2) WHEN l_suppkey % 3 > 0 THEN 100 ELSE 150 END)::DECIMAL(18,2) AS expected, count(*) FILTER (l_suppkey % 4 = 0) AS covered FROM lineitem GROUP BY 1",
    "plan_queue": f"""WITH o AS (SELECT * FROM orders JOIN customer ON o_custkey = c_custkey),
q AS (SELECT o_orderkey AS plan, o_orderkey // 2 * 2 AS job, CASE WHEN o_orderkey % 13 > 0 THEN c_nationkey END AS station, o_orderdate::DATE AS planned_for, o_orderstatus = 'P' AS p, o_orderkey % 97 AS halves, CASE o_orderstatus WHEN 'P' THEN 'pending' WHEN 'F' THEN 'accepted' ELSE 'rejected' END AS status,
  CASE WHEN o_orderkey % 5 = 0 THEN o_orderpriority END AS note, o_orderkey % 3 = 0 AS notified FROM o WHERE o_orderstatus = 'P' OR o_orderkey % 97 <= 48),
j AS (SELECT o_orderkey AS job, CASE WHEN o_orderkey % 3 > 0 THEN 'J' || o_orderkey END AS number, CASE WHEN o_orderkey % 9 > 0 THEN 'Goods of ' || c_name END AS title, CASE WHEN o_orderkey % 4 = 0 THEN c_name END AS importer FROM o WHERE o_orderkey % 2 = 0)
SELECT station, CASE WHEN p THEN 'pending' ELSE 'decided' END AS queue, (row_number() OVER (PARTITION BY station, p ORDER BY CASE WHEN p THEN planned_for END, CASE WHEN NOT p THEN halves END, plan))::INT AS place, plan, job, planned_for,
 CASE WHEN station % 6 > 0 THEN n_name ELSE '—' END AS station_name, coalesce(number, title, 'Untitled job') AS label, importer, status, note, notified FROM q LEFT JOIN j USING (job) LEFT JOIN nation ON n_nationkey = station""",
    "poll_counters": "SELECT user_id, count(*) AS seen, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("signup", "purchase", "error", "view", "click")) + " FROM events GROUP BY user_id",
    "pending_messages": "SELECT user_id, event_id, k::INT AS k FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events WHERE (event_type = 'error' OR event_id % 2 = 0) AND event_id % 7 < 5) WHERE k <= 25",
    "claim": "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'BUILDING' AND (c_custkey % 3 > 0 OR c_acctbal < 0) ORDER BY c_acctbal, c_custkey LIMIT 1",
    "urgent": f"WITH {_JOBS} SELECT (row_number() OVER (ORDER BY days_left, {_RANK} DESC, o_orderkey, kind))::INT AS place, o_orderkey, kind, days_left FROM alerts QUALIFY place <= 50",
}
SQL["board"] = f"""WITH mine AS (SELECT * FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500) WHERE o_orderstatus <> 'F'),
a AS (SELECT o_orderkey, kind, days_left FROM ({SQL['delivery_alerts']}) WHERE kind IN ('free_time', 'deposit_refund') UNION ALL SELECT o_orderkey, kind, days_left FROM ({SQL['clearance_alerts']}) WHERE kind IN ('duty_variance', 'awaiting_cfs', 'query_open'))
SELECT (['new','documents_received','scrutiny','exported'])[(o_orderkey % 4 + 1)::INT] AS line, count(*) AS n, NULL::INT AS days_left FROM mine GROUP BY 1 UNION ALL SELECT kind, count(*), min(days_left) FROM a WHERE o_orderkey IN (SELECT o_orderkey FROM mine) GROUP BY kind"""
SQL["board_rows"] = f"""WITH mine AS (SELECT * FROM (SELECT * FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 500) LEFT JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'),
a AS (SELECT o_orderkey, kind, days_left FROM ({SQL['delivery_alerts']}) WHERE kind IN ('free_time', 'deposit_refund') UNION ALL SELECT o_orderkey, kind, days_left FROM ({SQL['clearance_alerts']}) WHERE kind IN ('duty_variance', 'awaiting_cfs', 'query_open'))
SELECT kind, (row_number() OVER (PARTITION BY kind ORDER BY days_left, o_orderdate::DATE DESC, o_orderkey))::INT AS place, o_orderkey, CASE WHEN o_orderkey % 3 > 0 THEN 'J' || o_orderkey ELSE 'Untitled job' END AS label, c_name AS importer, days_left FROM a JOIN mine USING (o_orderkey)"""
SQL["cited_requests"] = """WITH m AS (SELECT l_orderkey AS job, l_partkey % 9 AS d, l_linestatus AS reason, l_suppkey, row_number() OVER (PARTITION BY l_orderkey, l_partkey % 9 ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS k FROM lineitem)
SELECT job, 'Document ' || d AS name, reason, CASE WHEN l_suppkey % 4 > 0 AND (l_suppkey % 20 - job % 20 + 20) % 20 < 10 AND EXISTS (FROM orders WHERE o_orderkey = job) THEN 'C' || l_suppkey % 20 END AS code FROM m WHERE k = 1 AND NOT (job % 5 = 0 AND d = job % 9 AND EXISTS (FROM orders WHERE o_orderkey = job))"""
