"""Coupled machines against the transition table spelled out, row by row and over the fixture."""

import itertools
import random

import pytest

from tariffloom.operators import machines as M
from tariffloom.plans import machines as P

SF = "/root/testdata/sf0.001"
SCHEMA = "key long, at long, seq long, kind string, note string"


class Job:
    """The same meaning in plain Python, written from the table of moves."""

    def __init__(self):
        self.job, self.order, self.clear = "new", "open", "noting"
        self.known, self.pending, self.documents, self.deposits, self.objections = set(), 0, 0, 0, 0
        self.variance = self.paid = False
        self.refused = 0

    def go(self, name, sources, to):
        if getattr(self, name) in sources:
            setattr(self, name, to)
            return True
        return False

    def on(self, kind, note):
        steps = {"document_asked": ("pending", 1), "document_done": ("pending", -1), "deposit_made": ("deposits", 1), "deposit_settled": ("deposits", -1), "objection_raised": ("objections", 1), "objection_cleared": ("objections", -1)}
        if kind in steps:
            name, by = steps[kind]
            setattr(self, name, max(0, getattr(self, name) + by))
        self.documents += kind == "document_asked"
        self.known.add(kind)
        if self.order == "open" and {"bill_surrendered", "mode_known", "free_days_known"} <= self.known:
            self.order = "documents"
        if self.order == "documents" and kind in ("document_asked", "document_done") and self.documents and not self.pending:
            self.order = "invoice"
        done = True
        if kind == "proforma_checked":
            done = self.go("order", ("documents", "invoice"), "payment")
        elif kind == "payment_proof":
            done = self.go("order", ("documents", "invoice", "payment"), "awaiting_do")
        elif kind == "do_number":
            done = self.go("order", ("documents", "invoice", "payment", "awaiting_do"), "do_received")
        elif kind == "goods_collected":
            done = self.go("order", ("do_received",), "delivered")
        elif kind == "do_closed":
            done = "final_invoice_paid" in self.known and not self.deposits and self.go("order", ("delivered",), "closed")
        elif kind == "noted_facilitated":
            done = self.go("clear", ("noting",), "duty_payment")
        elif kind == "noted":
            done = self.go("clear", ("noting",), "passing")
        elif kind == "duty_matches":
            self.variance = False
            done = self.go("clear", ("passing", "duty_variance"), "duty_payment")
        elif kind == "duty_differs":
            self.variance = True
            done = self.go("clear", ("passing", "duty_payment"), "duty_variance")
            if done and self.job == "noting":
                self.job = "scrutiny"
        elif kind == "variance_resolved":
            done = False
            if len(note) >= 3:
                self.variance = False
                done = self.go("clear", ("duty_variance",), "duty_payment")
                if done and self.job == "scrutiny":
                    self.job = "noting"
        elif kind == "duty_paid":
            self.paid |= not self.variance
            done = not self.variance and self.go("clear", ("passing", "duty_payment"), "goods_registration")
        elif kind == "goods_registered":
            done = self.go("clear", ("goods_registration",), "examination")
        elif kind == "goods_examined":
            done = self.go("clear", ("goods_registration", "examination"), "out_of_charge")
        elif kind == "out_of_charge":
            done = self.paid and not self.objections and self.go("clear", ("goods_registration", "examination", "out_of_charge"), "delivery_planning")
        elif kind == "delivered":
            done = "plan_approved" in self.known and self.go("clear", ("delivery_planning",), "delivered")
            if done and self.job == "noting":
                self.job = "closed"
        elif kind == "documents_attached":
            done = self.go("job", ("new", "documents_received"), "documents_received")
        elif kind == "exported":
            done = self.go("job", ("new", "documents_received"), "exported")
        elif kind == "checklist_uploaded":
            done = self.go("job", ("new", "documents_received", "exported", "checklist_revision"), "scrutiny")
        elif kind == "request_sent":
            done = self.go("job", ("scrutiny", "awaiting_shipper"), "awaiting_shipper")
        elif kind == "revision_asked":
            done = self.go("job", ("scrutiny", "awaiting_shipper"), "checklist_revision")
        elif kind == "notice_sent":
            done = self.go("job", ("scrutiny", "awaiting_shipper"), "noting")
        self.refused += not done

    def state(self):
        return self.job, self.order, self.clear, self.variance, self.paid, self.pending, self.deposits, self.objections, self.documents, self.refused


def brute(rows):
    out = {}
    for key, group in itertools.groupby(sorted(rows, key=lambda r: (r[0], r[1], r[2])), key=lambda r: r[0]):
        job = Job()
        for _, _, _, kind, note in group:
            job.on(kind or "", note or "")
        out[key] = job.state()
    return out


def told(frame, key="key"):
    s = "state." if key == "key" else ""
    names = ("job", "delivery_order", "clearance", "variance", "paid", "pending", "deposits", "objections", "documents", "refused")
    return {r[0]: tuple(r[1:]) for r in frame.select(key, *[f"{s}{n}" for n in names]).collect()}


@pytest.fixture(scope="module")
def walks():
    rng, rows = random.Random(4), []
    for key in range(400):
        for k in range(rng.randint(1, 60)):
            kind = rng.choice(P.ORDER[: k // 2 + 3]) if rng.random() < 0.7 else rng.choice([*P.KINDS, None, "unheard of"])
            rows.append((key, k, rng.randint(0, 3), kind, rng.choice(["", "no", "agreed", None])))
    rows = list({r[:3]: r for r in rows}.values())
    straight = [(1000, k, 0, kind, "agreed") for k, kind in enumerate(P.ORDER)]
    return rows + straight


def test_any_order_of_events(spark, walks):
    got = told(M.folded(spark.createDataFrame(walks, SCHEMA)))
    want = brute(walks)
    assert got == want and want[1000][:3] == ("closed", "closed", "delivered")
    assert {s for v in want.values() for s in v[:3]} >= {"scrutiny", "noting", "duty_variance", "duty_payment", "goods_registration", "payment", "do_received", "checklist_revision"}


def test_each_state_and_event(spark):
    """Every event in every state of its machine, by a fold that starts there."""
    rows, want, key = [], {}, 0
    for machine, rules in (("job", M.JOB), ("delivery_order", M.DELIVERY_ORDER), ("clearance", M.CLEARANCE)):
        states = {M.STARTS[machine], *(to for _, _, to in rules), *(s for _, sources, _ in rules for s in sources)}
        for state, (event, sources, to) in itertools.product(sorted(states), rules):
            rows.append((key, machine, state, event))
            want[key] = to if state in sources else None if any(e == event and state in s for e, s, _ in rules) else state
            key += 1
    start = spark.createDataFrame([(k, m, s) for k, m, s, _ in rows], "key long, machine string, at_state string")
    facts = "named_struct('job', if(machine = 'job', at_state, 'exported'), 'delivery_order', if(machine = 'delivery_order', at_state, 'closed'), 'clearance', if(machine = 'clearance', at_state, 'delivered'), 'bill', true, 'mode', true, 'free_days', false, 'plan', true, 'invoice_paid', true, 'variance', false, 'paid', true, 'pending', 0, 'deposits', 0, 'objections', 0, 'documents', 0, 'refused', 0)"
    states = start.selectExpr("key", f"cast({facts} as {M.STATE}) AS state")
    events = spark.createDataFrame([(k, 0, 0, e, "agreed") for k, _, _, e in rows], SCHEMA)
    got = {r.key: r.state for r in M.folded(events, states).collect()}
    for k, machine, _, _ in rows:
        if want[k] is not None:
            assert got[k][machine] == want[k]


def test_in_parts_as_at_once(spark, walks):
    frame = spark.createDataFrame(walks, SCHEMA)
    first = M.folded(frame.where("at < 9"))
    assert told(M.folded(frame.where("at >= 9"), first)) == told(M.folded(frame))
    assert told(M.folded(frame.limit(0), first)) == told(first) and M.folded(frame.limit(0)).collect() == []


def test_stream_equals_batch(spark):
    rows = [tuple(r) for r in P.as_events(spark.read.parquet(f"{SF}/events.parquet")).collect()]
    want = brute(rows)
    assert told(P.coupled_machines(spark, SF), "job_key") == want == told(P.coupled_machines_stream(spark, SF), "job_key")
