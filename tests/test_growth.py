"""Steps whose cost must grow no faster than their input."""

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tariffloom.operators import containment as C
from tariffloom.operators import joins as J
from tariffloom.operators import lookups as L
from tariffloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def plan(frame: DataFrame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


def test_requests_are_never_broadcast(spark):
    assert "BroadcastHashJoin" not in plan(QUERIES["cited_requests"](spark, SF))


def test_tables_are_dealt_as_texts_and_once(spark):
    text = plan(QUERIES["table_rows"](spark, SF))
    assert text.count("Exchange") == 1 and "Join" not in text and "Aggregate" not in text  # boxes were dealt twice, gathered twice and joined before
    assert text.index("Exchange") > text.rindex("posexplode")  # what is dealt lies below: texts


def most_rows(frame: DataFrame) -> int:
    """The most rows that a step of the plan gave, after it has run."""
    frame.collect()

    def rows(node) -> int:
        name = node.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            return rows(node.executedPlan())
        if name.endswith("QueryStageExec"):
            return rows(node.plan())
        own = node.metrics().get("numOutputRows")
        below = node.children()
        return max([own.get().value() if own.isDefined() else 0, *(rows(below.apply(i)) for i in range(below.size()))])

    return rows(frame._jdf.queryExecution().executedPlan())


def test_shared_codes_and_texts_do_not_multiply(spark):
    asked = spark.range(400).selectExpr("id AS k", "CASE WHEN id % 2 = 0 THEN 'a1' ELSE 'air x' END AS t")
    carriers = spark.range(400).selectExpr("id AS answer", "id AS pos", "'001' AS prefix", "'A1' AS iata", "'ABC' AS icao", "'The air x lines' AS name")
    found = C.airlines(asked, "k", "t", carriers)
    assert most_rows(found) <= 2000
    assert {(r.t, r.stage, r.answer) for r in found.collect()} == {("a1", 2, 0), ("air x", None, None)}
    one = found.sparkSession.range(1).selectExpr("7L AS answer", "7L AS pos", "'001' AS prefix", "'B1' AS iata", "'ABC' AS icao", "'The air x lines' AS name")
    assert {(r.t, r.stage, r.answer) for r in C.airlines(asked, "k", "t", one).collect()} == {("a1", None, None), ("air x", 5, 7)}
    houses = carriers.selectExpr("answer", "pos", "'A1' AS code", "CAST(NULL AS STRING) AS edi", "name")
    assert most_rows(C.custom_houses(asked, "k", "t", houses)) <= 2000
    ports = carriers.selectExpr("answer", "pos", "'A1' AS code", "'air x' AS name", "array('a1') AS aliases")
    assert most_rows(C.foreign_ports(asked, "k", "t", ports)) <= 2000


def test_only_codes_of_one_answer_are_joined(spark):
    master = spark.createDataFrame([(1, "A"), (2, "A"), (3, "B"), (3, "B"), (4, None)], "answer int, code string")
    assert [(r.code, r.answer) for r in L.single(master, "code").where("code IS NOT NULL").collect()] == [("B", 3)]
    plain = QUERIES["airline_lookup"](spark, SF)
    assert most_rows(plain) <= 6 * 150


def test_shared_prefixes_keep_the_entries_that_can_count(spark):
    rng = random.Random(5)
    codes = spark.createDataFrame([(f"{rng.randrange(40):02d}{rng.randrange(3):02d}{i % 100:02d}",) for i in range(300)], "hs string")
    rows = [(i, rng.sample(["01", "0100", "02", "0201", "03", "010102"], rng.randint(1, 3)), [f"01{rng.randrange(3):02d}"] if i % 2 else [], i == 7) for i in range(120)]
    schedule = spark.createDataFrame(rows, "pos int, include array<string>, exclude array<string>, any_chapter boolean")
    best, seen = J.best_prefixes(codes, "hs", schedule, 3), {}
    for r in sorted(J.prefix_join(codes, "hs", schedule).where("len > 0").collect(), key=lambda r: (r.hs, -r.len, r.pos)):
        seen.setdefault(r.hs, []).append((r.pos, r.len))
    assert sorted((r.hs, r.k, r.pos, r.len) for r in best.collect()) == sorted((c, k, *x) for c, xs in seen.items() for k, x in enumerate(xs[:3], 1))
    same = spark.range(500).selectExpr("id AS pos", "array('01') AS include", "CASE WHEN id = 0 THEN array('010203') ELSE CAST(array() AS array<string>) END AS exclude", "false AS any_chapter")
    many = spark.range(500).selectExpr("concat('0102', lpad(id, 4, '0')) AS hs")
    assert most_rows(J.best_prefixes(many, "hs", same, 3)) <= 5000


def test_check_character_is_computed_once(spark):
    # the plan holds each use of an expression: the sum once for each of its uses in the character, again in gstin and in its check
    text = QUERIES["gstin_check"](spark, SF)._jdf.queryExecution().optimizedPlan().toString().lower()
    assert text.count("aggregate(") <= 3  # 11 before


def test_schedules_are_summed_by_prefix(spark):
    from decimal import Decimal

    from tariffloom.operators import draft as D

    rng = random.Random(7)
    schema = "pos int, serial string, rate decimal(8,4), valid_until date, include array<string>, exclude array<string>, any_chapter boolean"
    every = ["01", "0100", "0101", "02", "0201", "03", "010102", "030"]
    rows = [(i, f"s{i}", rng.choice([None, Decimal(5), Decimal(12)]), None, rng.sample(every, rng.randint(0, 3)), [f"02{rng.randrange(3):02d}"] if i % 5 == 0 else [], i % 17 == 3) for i in range(90)]
    codes = sorted({f"{rng.randrange(5):02d}{rng.randrange(3):02d}{rng.randrange(4):02d}" for _ in range(80)} | {"0101"})
    schedule, asked = spark.createDataFrame(rows, schema), spark.createDataFrame([(c,) for c in codes], "ritc string")
    want, counts = {}, {}
    for c in codes:
        met = []
        for pos, serial, rate, _, include, exclude, anywhere in rows:
            own = [len(p) for p in include if len(p) in (2, 4, 6, 8) and c.startswith(p)] + [0] * anywhere
            if own and not any(c.startswith(p) for p in exclude):
                met.append((-max(own), pos, serial, rate))
        if met:
            first = min(met, key=lambda x: x[:2])
            want[c] = (first[2], first[3], first[0] == 0, sum(x[0] == first[0] and x[3] != first[3] for x in met))
        if n := sum(x[0] < 0 for x in met):
            counts[c] = (n, 0)
    got = D._scheduled(asked, schedule, "e").collect()
    assert len(got) == len(want) and {r.ritc: (r.e.serial, r.e.rate, r.e.residual, r.e.others) for r in got} == want
    today = spark.sql("SELECT 1").select(F.lit("2026-01-01").cast("date")).first()[0]
    assert {r.ritc: (r.in_force, r.lapsed) for r in D._exempted(asked, schedule, F.lit(today)).collect()} == counts
    same = spark.range(400).selectExpr("CAST(id AS INT) AS pos", "'s' AS serial", "CAST(id % 2 AS DECIMAL(8,4)) AS rate", "array('0102') AS include", "CAST(array() AS array<string>) AS exclude", "false AS any_chapter")
    many = spark.range(400).selectExpr("concat('0102', lpad(id, 4, '0')) AS ritc")
    assert most_rows(D._scheduled(many, same, "e")) <= 4000  # 160,000 before


def test_draft_sections_keep_no_copies_of_whole_drafts(spark):
    from tariffloom.plans import merged as M

    flat = plan(M.draft_shipments(spark, SF))
    assert "items" not in flat.split("ReadSchema", 1)[1] and "Exchange hashpartitioning" not in flat
    assert "flags" not in plan(M.draft_items(spark, SF))


def test_alternatives_are_counted_by_prefix(spark):
    rng = random.Random(9)
    schema = "pos int, text string, include array<string>, exclude array<string>, any_chapter boolean"
    rows = [(i, rng.choice("abc"), rng.sample(["01", "0100", "02", "0201", "010102"], rng.randint(1, 3)), rng.sample(["0100", "010102", "02"], 1) if i % 3 == 0 else [], False) for i in range(60)]
    codes = sorted({f"0{rng.randrange(4)}{rng.randrange(3):02d}{rng.randrange(4):02d}" for _ in range(60)})
    want = {}
    for c in codes:
        met = [(-max(len(p) for p in own), pos, text) for pos, text, include, exclude, _ in rows if (own := [p for p in include if c.startswith(p)]) and not any(c.startswith(p) for p in exclude)]
        if met:
            first = min(met)
            want[c] = (first[1], -first[0], first[2], sum(x[0] == first[0] and x[2] != first[2] for x in met))
    got = J.best_and_others(spark.createDataFrame([(c,) for c in codes], "hs string"), "hs", spark.createDataFrame(rows, schema), "text").collect()
    assert len(got) == len(want) and {r.hs: (r.pos, r.len, r.text, r.alternatives) for r in got} == want
    # each of 300 codes met each of 300 entries before
    same = spark.range(300).selectExpr("id AS pos", "CAST(id % 2 AS STRING) AS text", "array('0102') AS include", "CAST(array() AS array<string>) AS exclude", "false AS any_chapter")
    assert most_rows(J.best_and_others(spark.range(300).selectExpr("concat('0102', lpad(id, 4, '0')) AS hs"), "hs", same, "text")) <= 3000


def test_a_station_of_many_plans_and_staff_is_many_tasks(spark):
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    try:
        rows = QUERIES["plan_recipients"](spark, SF).withColumn("p", F.spark_partition_id()).collect()
    finally:
        spark.conf.unset(key)
    told = [r for r in rows if r.recipient.startswith("u")]
    assert len({r.p for r in told if r.s_suppkey == told[0].s_suppkey}) > 1  # one before


def test_rules_meet_items_as_arrays(spark):
    rng = random.Random(11)
    code = lambda n: "".join(rng.choice("01") for _ in range(n))
    items, rules = [(i, code(rng.randint(4, 8))) for i in range(200)], [(i, code(rng.randint(1, 8))) for i in range(90)]
    asked, known = spark.createDataFrame(items, "k long, hs string"), spark.createDataFrame(rules, "rule long, prefix string")
    want = {k: own for k, c in items if (own := [r for r, p in rules if len(p) > 1 and c.startswith(p)])}
    got = J.all_of_prefixes(asked, "k", "hs", known, "rule", "prefix").collect()
    assert len(got) == len(want) and {r.k: r.rules for r in got} == want and all(r.n == len(r.rules) for r in got)
    few = J.all_of_prefixes(asked, "k", "hs", known.where("length(prefix) > 5"), "rule", "prefix").collect()
    assert {r.k: r.rules for r in few} == {k: own for k, c in items if (own := [r for r, p in rules if len(p) > 5 and c.startswith(p)])}
    many = spark.range(300).selectExpr("id AS k", "concat('0102', lpad(id, 4, '0')) AS hs")
    assert most_rows(J.all_of_prefixes(many, "k", "hs", spark.range(300).selectExpr("id AS rule", "'0102' AS prefix"), "rule", "prefix")) <= 3000  # 90,000 pairs before


def test_notices_are_read_once(spark):
    assert "rlike" not in plan(QUERIES["amendments_rejected"](spark, SF)).lower()  # each kind of reject read all texts before
    assert "rlike" not in plan(QUERIES["amendments_replayed"](spark, SF)).lower()


def test_levels_are_one_table(spark):
    found = QUERIES["content_tree"](spark, SF)
    assert plan(found).count("Scan") == 1 and found.count() == 199  # a scan for each level before


def test_bills_are_sorted_by_what_their_issues_tell(spark):
    assert "l_shipdate" not in plan(QUERIES["container_issues"](spark, SF))  # ten columns of whole items before


def test_shared_grams_bring_a_pair_together_once(spark):
    from tariffloom.operators import matching as M

    rng = random.Random(13)
    key = lambda: "CUSTOMER " + "".join(rng.choice("123") for _ in range(rng.randint(0, 6))) + rng.choice([" TRADING", "", " ÉTÉ 𝒳"])
    asked, master = sorted({key() for _ in range(150)}), sorted({key() for _ in range(120)})
    grams = lambda k: {f"  {k} "[i : i + 3] for i in range(len(k) + 1)}
    sims = {(a, b): len(grams(a) & grams(b)) * 10000 // len(grams(a) | grams(b)) for a in asked for b in master}
    left, right = spark.createDataFrame([(a, a) for a in asked], "a string, key string"), spark.createDataFrame([(b, b, len(b)) for b in master], "b string, key string, n int")
    found = M.similar_keys(left, "a", right, "b", 5490, ("n",))
    got = [(r.a, r.b, r.n, r.sim) for r in found.collect()]
    assert sorted(got) == sorted((a, b, len(b), s) for (a, b), s in sims.items() if s >= 5490)
    many = spark.range(300).selectExpr("CAST(id AS STRING) AS a", "concat('CUSTOMER ', lpad(id, 3, '0'), ' TRADING') AS key")
    near = M.similar_keys(many, "a", many.withColumnRenamed("a", "b"), "b", 5490)
    assert near.count() == 300 * 300 and most_rows(near) <= 150_000  # each pair met at several grams before


def test_parties_meet_names_as_they_are_compared(spark):
    text = plan(QUERIES["party_resolution"](spark, SF))
    assert text.count("REPARTITION_BY_NUM") == 2 and "array_intersect" in text  # one task for a gram that names share before
