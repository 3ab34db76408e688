"""The machines of a job, its delivery order and its clearance, moved by events under guards on what is known so far.

One fold goes through a job's events in order. An event first adds to the facts
(documents known, deposits and objections open, variance, duty paid), then each
machine moves if a rule for the event has its present state and its guard holds. A
move of the clearance may move the job: a variance takes it back to scrutiny, its
resolution forward again, and delivery closes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values: (event, states it may be entered from, state) of each machine; guards are in ``GUARDS``.
DELIVERY_ORDER = [
    ("proforma_checked", ("documents", "invoice"), "payment"),
    ("payment_proof", ("documents", "invoice", "payment"), "awaiting_do"),
    ("do_number", ("documents", "invoice", "payment", "awaiting_do"), "do_received"),
    ("goods_collected", ("do_received",), "delivered"),
    ("do_closed", ("delivered",), "closed"),
]
CLEARANCE = [
    ("noted_facilitated", ("noting",), "duty_payment"),
    ("noted", ("noting",), "passing"),
    ("duty_matches", ("passing", "duty_variance"), "duty_payment"),
    ("duty_differs", ("passing", "duty_payment"), "duty_variance"),
    ("variance_resolved", ("duty_variance",), "duty_payment"),
    ("duty_paid", ("passing", "duty_payment"), "goods_registration"),
    ("goods_registered", ("goods_registration",), "examination"),
    ("goods_examined", ("goods_registration", "examination"), "out_of_charge"),
    ("out_of_charge", ("goods_registration", "examination", "out_of_charge"), "delivery_planning"),
    ("delivered", ("delivery_planning",), "delivered"),
]
JOB = [
    ("documents_attached", ("new", "documents_received"), "documents_received"),
    ("exported", ("new", "documents_received"), "exported"),
    ("checklist_uploaded", ("new", "documents_received", "exported", "checklist_revision"), "scrutiny"),
    ("request_sent", ("scrutiny", "awaiting_shipper"), "awaiting_shipper"),
    ("revision_asked", ("scrutiny", "awaiting_shipper"), "checklist_revision"),
    ("notice_sent", ("scrutiny", "awaiting_shipper"), "noting"),
]
#: Moves of the clearance that move the job: state entered by which event, the job's state, its next one.
COUPLED = [("duty_differs", "noting", "scrutiny"), ("variance_resolved", "scrutiny", "noting"), ("delivered", "noting", "closed")]
#: Events that set a fact for good, and those that count something up and down.
FLAGS = {"bill_surrendered": "bill", "mode_known": "mode", "free_days_known": "free_days", "plan_approved": "plan", "final_invoice_paid": "invoice_paid"}
COUNTS = {"document_asked": ("pending", 1), "document_done": ("pending", -1), "deposit_made": ("deposits", 1), "deposit_settled": ("deposits", -1), "objection_raised": ("objections", 1), "objection_cleared": ("objections", -1)}
STARTS = {"job": "new", "delivery_order": "open", "clearance": "noting"}
LEAST_NOTE = 3
STATE = (
    "struct<job:string,delivery_order:string,clearance:string,bill:boolean,mode:boolean,free_days:boolean,plan:boolean,invoice_paid:boolean,"
    "variance:boolean,paid:boolean,pending:int,deposits:int,objections:int,documents:int,refused:int>"
)


def initial() -> Column:
    facts = [F.lit(False).alias(n) for n in (*FLAGS.values(), "variance", "paid")]
    counts = [F.lit(0).alias(n) for n in ("pending", "deposits", "objections", "documents", "refused")]
    return F.struct(*[F.lit(v).alias(n) for n, v in STARTS.items()], *facts, *counts).cast(STATE)


def _facts(acc: Column, e: Column) -> dict[str, Column]:
    kind, out = e["kind"], {}
    for event, name in FLAGS.items():
        out[name] = acc[name] | (kind == event)
    for name in dict.fromkeys(n for n, _ in COUNTS.values()):
        change = sum((F.when(kind == event, by).otherwise(0) for event, (n, by) in COUNTS.items() if n == name), F.lit(0))
        out[name] = F.greatest(acc[name] + change, F.lit(0))
    out["documents"] = acc["documents"] + (kind == "document_asked").cast("int")
    resolved = (kind == "variance_resolved") & (F.length(e["note"]) >= LEAST_NOTE) | (kind == "duty_matches")
    out["variance"] = F.when(kind == "duty_differs", True).when(resolved, False).otherwise(acc["variance"])
    out["paid"] = acc["paid"] | ((kind == "duty_paid") & ~acc["variance"])
    return out


def _guards(facts: dict[str, Column], e: Column) -> dict[str, Column]:
    """What an event's move needs beyond the state it starts from."""
    return {
        "do_closed": facts["invoice_paid"] & (facts["deposits"] == 0),
        "variance_resolved": F.length(e["note"]) >= LEAST_NOTE,
        "duty_paid": ~facts["variance"],
        "out_of_charge": facts["paid"] & (facts["objections"] == 0),
        "delivered": facts["plan"],
    }


def _moved(state: Column, rules: list, kind: Column, guards: dict[str, Column]) -> Column:
    """The state after the event, null if no rule moves it."""
    moves = [F.when((kind == event) & state.isin(*sources) & F.coalesce(guards.get(event, F.lit(True)), F.lit(False)), to) for event, sources, to in rules]
    return F.coalesce(*moves)


def _step(acc: Column, e: Column) -> Column:
    kind, facts = e["kind"], _facts(acc, e)
    guards = _guards(facts, e)
    known = facts["bill"] & facts["mode"] & facts["free_days"]
    opened = F.when((acc["delivery_order"] == "open") & known, "documents").otherwise(acc["delivery_order"])
    asked = kind.isin("document_asked", "document_done")
    invoiced = F.when((opened == "documents") & asked & (facts["documents"] > 0) & (facts["pending"] == 0), "invoice").otherwise(opened)
    order, clear, job = _moved(invoiced, DELIVERY_ORDER, kind, guards), _moved(acc["clearance"], CLEARANCE, kind, guards), _moved(acc["job"], JOB, kind, guards)
    pulled = F.coalesce(*[F.when((kind == event) & clear.isNotNull() & (acc["job"] == at), to) for event, at, to in COUPLED])
    wish = kind.isin(*[event for rules in (DELIVERY_ORDER, CLEARANCE, JOB) for event, _, _ in rules])
    refused = wish & order.isNull() & clear.isNull() & job.isNull()
    made = {"job": F.coalesce(pulled, job, acc["job"]), "delivery_order": F.coalesce(order, invoiced), "clearance": F.coalesce(clear, acc["clearance"]), "refused": acc["refused"] + refused.cast("int")} | facts
    names = ("job", "delivery_order", "clearance", *FLAGS.values(), "variance", "paid", "pending", "deposits", "objections", "documents", "refused")
    return F.struct(*[made[n].alias(n) for n in names]).cast(STATE)


def folded(events: DataFrame, states: DataFrame | None = None) -> DataFrame:
    """(key, state) after the events in order, from the states given (key, state) or from the beginning.

    events: key, at, seq, kind, note. An event of an unknown kind changes nothing.
    Folding one part of the events and then the rest from its states is the same
    as folding them all, so batches of a stream can go one after another. A job's
    events meet in one array, bounded by what one job goes through.
    """
    listed = F.array_sort(F.collect_list(F.struct("at", "seq", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("note", F.lit("")).alias("note"))))
    rows = events.groupBy("key").agg(listed.alias("events"))
    if states is None:
        rows = rows.withColumn("start", initial())
    else:
        old = states.select(F.col("key").alias("old_key"), F.col("state").alias("old"))
        rows = rows.join(old, F.col("key").eqNullSafe(F.col("old_key")), "full").withColumn("key", F.coalesce("key", "old_key"))
        rows = rows.withColumn("start", F.coalesce("old", initial()))
    none = F.array().cast(rows.schema["events"].dataType)
    return rows.select("key", F.aggregate(F.coalesce("events", none), F.col("start"), _step).alias("state"))
