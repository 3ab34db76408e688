"""Texts inside texts against comparing all pairs; no plan compares all pairs."""

import random
import re

import pytest

from tariffloom.operators import containment as C
from tariffloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sides():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefgh", k=rng.randint(1, 6)))
    names = [" ".join(word() for _ in range(rng.randint(1, 3))) for _ in range(10_000)]
    asked = [" ".join(word() for _ in range(rng.randint(1, 4))) for _ in range(200)] + ["", "a", "bc", None, names[0], names[0]]
    return asked, [*names, "", None, "é", names[5]]


def frames(spark, sides):
    asked, names = sides
    return spark.createDataFrame(list(enumerate(asked)), "k int, t string"), spark.createDataFrame(list(enumerate(names)), "pos int, name string")


def pairs(frame):
    return sorted((r.k, r.pos) for r in frame.select("k", "pos").collect())


def brute(sides, test):
    return sorted((k, p) for k, t in enumerate(sides[0]) for p, n in enumerate(sides[1]) if t and n and test(t, n))


def test_both_ways(spark, sides):
    asked, names = frames(spark, sides)
    assert pairs(C.containing(asked, "t", names, "name")) == brute(sides, lambda t, n: t in n or n in t)
    assert pairs(C.held_by(asked, "t", names, "name")) == brute(sides, lambda t, n: t in n)
    assert pairs(C.holding(asked, "t", names, "name")) == brute(sides, lambda t, n: n in t)


def test_whole_words(spark, sides):
    asked, names = frames(spark, sides)
    assert pairs(C.with_words(asked, "t", names, "name")) == brute(sides, lambda t, n: f" {n} " in f" {t} ")


def test_empty_sides(spark, sides):
    asked, names = frames(spark, sides)
    assert C.containing(asked.limit(0), "t", names, "name").count() == C.containing(asked, "t", names.limit(0), "name").count() == 0


@pytest.mark.parametrize("name", ["containment_join", "loose_port", "custom_house_lookup", "foreign_port_stages", "custom_house_stages", "airline_stages"])
def test_no_plan_compares_all_pairs(spark, name):
    plan = QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString() + QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_airlines_by_every_step_of_their_lookup(spark):
    rows = QUERIES["airline_lookup"](spark, SF).collect()
    letters = lambda k: "".join("ABCDEFGHIJ"[int(d)] for d in f"{k % 1000:03d}")
    carriers = [(r.s_suppkey, f"{r.s_suppkey % 1000:03d}", f"A{r.s_suppkey % 10}", letters(r.s_suppkey) if r.s_suppkey % 61 else None, r.s_name.upper()) for r in spark.read.parquet(f"{SF}/supplier.parquet").orderBy("s_suppkey").collect()]

    def looked_up(text):
        up = text.strip().upper()
        prefix = re.match(r"(\d{3})\b", up)
        steps = [lambda c: prefix and c[1] == prefix[1], lambda c: re.fullmatch("[0-9A-Z]{2}", up) and c[2] == up, lambda c: re.fullmatch("[A-Z]{3}", up) and c[3] == up, lambda c: c[4] == up, lambda c: c[4] in up or up in c[4]]
        for n, step in enumerate(steps if up else [], 1):
            found = [c[0] for c in carriers if step(c)]
            if len(found) == 1 or found and n < 5:
                return n, found[0]
        return None, None

    assert [(r.stage, r.answer) for r in rows] == [looked_up(r.raw) for r in rows]
    assert {r.stage for r in rows} == {None, 1, 2, 3, 4, 5}
    assert any(r.stage == 5 and " " in r.raw for r in rows) and any(r.stage == 5 and " " not in r.raw for r in rows)  # held by the text, holding it
