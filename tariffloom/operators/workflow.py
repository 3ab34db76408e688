"""Deadlines, alerts, ordered states and boards."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import days_left, level, level_rank

#: Days ahead within which alerts are raised, and within which they are due.
AHEAD, CALL_DUE, FREE_DUE, REFUND_DAYS, REFUND_DUE = 3, 1, 3, 15, 3


def _alert(frame: DataFrame, key: str, kind: str, due: Column, as_of: Column, within: int, ahead: int, *wanted: Column) -> DataFrame:
    left = days_left(due, as_of)
    rows = frame.where(reduce(lambda a, b: a & b, wanted, due.isNotNull() & (left <= ahead)))
    return rows.select(key, F.lit(kind).alias("kind"), due.alias("due_on"), left.cast("int").alias("days_left"), level(left, within).alias("level"))


def delivery_alerts(jobs: DataFrame, key: str, as_of: Column) -> DataFrame:
    """The four kinds of alert of a delivery order.

    jobs: eta, scrutinised, status, returned_on, free_days, free_from,
    delivered_at, deposits_open, valid_until.
    """
    j = F.col
    return reduce(
        DataFrame.unionByName,
        [
            _alert(jobs, key, "invoice_call", F.date_sub("eta", 1), as_of, CALL_DUE, AHEAD, ~j("scrutinised"), j("status") != "closed"),
            _alert(jobs, key, "free_time", F.date_add(F.coalesce("free_from", "eta"), j("free_days")), as_of, FREE_DUE, AHEAD, j("returned_on").isNull()),
            _alert(jobs, key, "deposit_refund", F.date_add("delivered_at", REFUND_DAYS), as_of, REFUND_DUE, REFUND_DAYS, j("deposits_open") > 0),
            _alert(jobs, key, "do_expiry", j("valid_until"), as_of, FREE_DUE, AHEAD, j("delivered_at").isNull()),
        ],
    )


def worst_level(alerts: DataFrame, key: str) -> DataFrame:
    """The worst level of each key's alerts."""
    worst = F.max(level_rank(F.col("level")))
    return alerts.groupBy(key).agg(F.element_at(F.array(F.lit("soon"), F.lit("due"), F.lit("overdue")), worst).alias("worst"), F.count("*").alias("n_alerts"), F.min("days_left").alias("days_left"))


def clearance_alerts(jobs: DataFrame, key: str, as_of: Column) -> DataFrame:
    """(key, kind, level, due_on, days_left) of the five kinds: open duty variance, old queries, pending certificates before goods are out, delivery plans, goods out without paid duty.

    jobs: variance_open, query_opened, pending_nocs, status, planned_for,
    out_of_charge_on, duty_paid. What has no day of its own counts -1 (variance)
    or 0 (certificates) days.
    """
    j = F.col
    none = F.lit(None).cast("date")
    age = F.datediff(as_of, j("query_opened"))
    plan, out = days_left(j("planned_for"), as_of), j("out_of_charge_on").isNotNull()
    kinds = [
        ("duty_variance", F.when(j("variance_open"), "overdue"), none, F.lit(-1)),
        ("query_open", F.when(age >= 4, "overdue").when(age >= 2, "due"), j("query_opened"), -age),
        ("noc_pending", F.when((j("pending_nocs") > 0) & ~out, F.when(j("status") == "out_of_charge", "due").otherwise("soon")), none, F.lit(0)),
        ("awaiting_cfs", F.when(plan < 0, "overdue").when(plan <= 1, "due").when(plan.isNotNull(), "soon"), j("planned_for"), plan),
        ("ooc_without_duty", F.when(out & ~j("duty_paid"), "overdue"), j("out_of_charge_on"), days_left(j("out_of_charge_on"), as_of)),
    ]
    each = [F.when(v.isNotNull(), F.struct(F.lit(k).alias("kind"), v.alias("level"), d.alias("due_on"), n.cast("int").alias("days_left"))) for k, v, d, n in kinds]
    return jobs.select(key, F.explode(F.array_compact(F.array(*each))).alias("a")).select(key, "a.*")


def replayed(events: DataFrame, key: str, at: str, tie: str, event: str, start: str, moves: dict[tuple[str, str], str]) -> DataFrame:
    """The state of each key after its events in order; a move applies only from its own state, so states never go back unless a move says so.

    A key's events meet in one array, bounded by what one job goes through.
    """
    step = F.create_map(*[x for (state, e), to in moves.items() for x in (F.lit(f"{state}>{e}"), F.lit(to))])
    ordered = F.array_sort(F.collect_list(F.struct(at, tie, event)))
    final = F.aggregate("events", F.lit(start), lambda state, e: F.coalesce(F.try_element_at(step, F.concat(state, F.lit(">"), e[event])), state))
    return events.groupBy(key).agg(ordered.alias("events")).select(key, final.alias("state"), F.size("events").alias("n_events"))


def plan_queue(plans: DataFrame, jobs: DataFrame, stations: DataFrame, now: Column, hours: int = 24) -> DataFrame:
    """Each station's delivery plans: pending ones in the order of their day, and those decided in the last hours, the latest first, with ``place`` from 1.

    plans: plan, job, station, planned_for, status, decided_at, note,
    notified_at; jobs: job, number, title, importer; stations: station, name.
    Places are counted by station and queue, so no task sees all plans; plans
    without a station are counted together. Ties go by plan.
    """
    pending = F.col("status") == "pending"
    recent = F.col("decided_at") >= now - F.make_dt_interval(hours=F.lit(hours))
    queue = F.when(pending, "pending").when(~pending & recent, "decided")
    listed = plans.withColumn("queue", queue).where("queue IS NOT NULL")
    w = Window.partitionBy("station", "queue").orderBy(F.when(F.col("queue") == "pending", F.col("planned_for")).asc_nulls_last(), F.when(F.col("queue") == "decided", F.col("decided_at")).desc(), "plan")
    named = listed.withColumn("place", F.row_number().over(w)).join(jobs, "job", "left").join(stations, "station", "left")
    return named.select(
        "station", "queue", "place", "plan", "job", "planned_for", F.coalesce("name", F.lit("—")).alias("station_name"), F.coalesce("number", "title", F.lit("Untitled job")).alias("label"),
        "importer", "status", "note", F.col("notified_at").isNotNull().alias("notified"),
    )


def board_rows(alerts: DataFrame, jobs: DataFrame, key: str, order: str) -> DataFrame:
    """The board's lines in order: (kind, place, key, label, importer, days_left) of alerts (key, kind, days_left) of jobs (key, label, importer, order), by days left, then by the jobs' order.

    Places are counted by kind, over the jobs that a board shows.
    """
    w = Window.partitionBy("kind").orderBy("days_left", order, key)
    return alerts.select(key, "kind", "days_left").join(jobs, key).withColumn("place", F.row_number().over(w)).select("kind", "place", key, "label", "importer", "days_left")


def requested(missing: DataFrame, known: DataFrame, stored: DataFrame, at: str) -> DataFrame:
    """New requests (job, name, reason, code) of missing documents (job, name, reason, code and their order ``at``): the first of a job's equal names, none that is stored, and a code only if it is among those known of the job."""
    first = missing.groupBy("job", "name").agg(F.min_by(F.struct("reason", "code"), at).alias("m"))
    # joins by sorting: the sizes of filtered or exploded rows are guessed far too small, so Spark would broadcast what grows with the jobs
    new = first.join(stored.select("job", "name").hint("merge"), ["job", "name"], "left_anti")
    supplied = known.groupBy("job").agg(F.collect_set("code").alias("__known"))  # bounded by the codes of a job
    cited = F.when(F.array_contains("__known", F.col("m.code")), F.col("m.code"))
    return new.join(supplied.hint("merge"), "job", "left").select("job", "name", "m.reason", cited.alias("code"))
