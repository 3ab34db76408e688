"""Checked model calls against a plain loop over the same client."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tariffloom.operators import calls as M
from tariffloom.plans.calls import QUERIES
from tariffloom.ship import ship

FIELDS = {"index": ("bigint", True), "rate": ("double", False), "ok": ("boolean", False), "reason": ("string", False)}
GOOD = {"index": 1, "rate": 2.5, "ok": True, "reason": "r"}


def scripted(folder):
    """A client for which prompts are lists of replies, one an attempt; each call leaves a line in the folder. Made here, as workers can't import tests."""

    class Scripted:
        def reply(self, model, prompts, attempt):
            with open(f"{folder}/{os.getpid()}", "a") as out:
                out.writelines(f"{attempt} {model} {p}\n" for p in prompts)
            return [json.loads(p)[attempt - 1] for p in prompts]

    return Scripted()


def script(*replies):
    return json.dumps([r if r is None or isinstance(r, str) else json.dumps(r) for r in replies])


CASES = {
    "first": (script(GOOD), 1, None),
    "nulls": (script(GOOD | {"index": None}), 1, None),
    "whole rate": (script(GOOD | {"rate": 3}), 1, None),
    "retry": (script("{", GOOD), 2, None),
    "larger": (script(None, "[1]", GOOD), 3, None),
    "text for number": (script(*[GOOD | {"index": "1"}] * 3), None, "field index"),
    "number for text": (script(*[GOOD | {"reason": 7}] * 3), None, "field reason"),
    "null": (script(*[GOOD | {"ok": None}] * 3), None, "field ok"),
    "missing": (script(*[{"index": 1, "ok": True, "reason": "r"}] * 3), None, "field rate"),
    "prose": (script(*["I think so"] * 3), None, "no JSON"),
    "list": (script(*["[1]"] * 3), None, "no object"),
    "silent": (script(None, None, None), None, "no reply"),
    "rule": (script(*[GOOD | {"index": 5}] * 3), None, "index"),
    "last reason counts": (script("{", None, GOOD | {"index": 9}), None, "index"),
    "no prompt": (None, None, "no prompt"),
}


def test_retry_escalation_rejects(spark, tmp_path):
    ship(spark)
    rows = [(f"{name}/{n}", prompt, n) for name, (prompt, _, _) in CASES.items() for n in range(3)]  # equal prompts thrice
    asked = spark.createDataFrame(rows, "k string, p string, model_row int")
    inside = F.col("answer.index").isNull() | (F.col("answer.index") < 3)
    answers, rejects = M.answered(asked, "k", "p", scripted(str(tmp_path)), FIELDS, ("index", inside), size=4)
    for _ in range(2):  # a second action repeats no call
        got = {r.k: (r.attempt, r.model) for r in answers.collect()}
        lost = {r.k: r.reason for r in rejects.collect()}
    assert got == {f"{n}/{i}": (a, M.ATTEMPTS[a - 1]) for n, (_, a, _) in CASES.items() if a for i in range(3)}
    assert lost == {f"{n}/{i}": why for n, (_, _, why) in CASES.items() if why for i in range(3)}
    first = answers.where("k = 'whole rate/0'").first()
    assert (first.answer.rate, first.answer["index"], first.model_row) == (3.0, 1, 0)
    calls = [line for f in tmp_path.iterdir() for line in f.read_text().splitlines()]
    want = {n: 1 if a == 1 else 2 if a == 2 else 3 for n, (p, a, _) in CASES.items() if p}
    assert len(calls) == len(set(calls)) == sum(want.values())


def test_empty_and_one_attempt(spark, tmp_path):
    none = spark.createDataFrame([], "k string, p string")
    answers, rejects = M.answered(none, "k", "p", scripted(str(tmp_path)), FIELDS)
    assert answers.count() == rejects.count() == 0
    one = spark.createDataFrame([("a", script("{", GOOD))], "k string, p string")
    answers, rejects = M.answered(one, "k", "p", scripted(str(tmp_path)), FIELDS, attempts=("standard",))
    assert answers.count() == 0 and [r.reason for r in rejects.collect()] == ["no JSON"]


def test_wrong_number_of_replies(spark):
    class Short(M.WordChoice):
        def reply(self, model, prompts, attempt):
            return []

    with pytest.raises(Exception, match="0 replies to 1 prompts"):
        M.answered(spark.createDataFrame([("a", "x")], "k string, p string"), "k", "p", Short(), FIELDS)


def test_choices_settle_most(spark):
    sf = "/root/testdata/sf0.001"
    answers, rejects = QUERIES["choices_called"](spark, sf).collect(), QUERIES["choices_rejected"](spark, sf).collect()
    assert {r.attempt for r in answers} == {1, 2, 3} and {r.reason for r in rejects} == {"no JSON", "unknown entry"}
    assert any(r.pos is None for r in answers) and any(r.pos is not None for r in answers)
    assert not {r.hs for r in answers} & {r.hs for r in rejects}
