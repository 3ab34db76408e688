"""Matching of messages to jobs by identifiers and of stated names to a party master."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trigram_codes

#: What an identifier of each kind counts, and what a match needs.
WEIGHTS = {"container": 5, "bl": 5, "awb": 5, "invoice": 4, "conversation": 3, "po": 2}
STRONG = ("container", "bl", "awb", "invoice")
NEEDED = 4
DEALT, TASKS = 4096, 64  # asked keys of one gram that are compared by one task; tasks of a comparison, whose input is much smaller than its pairs


def scores(ids: DataFrame, known: DataFrame) -> DataFrame:
    """(message, job, score, matched, thread) over distinct identifiers that a message and a job share."""
    weight = F.element_at(F.create_map(*[F.lit(x) for kv in WEIGHTS.items() for x in kv]), F.col("kind"))
    shared = ids.select("message", "kind", "value").distinct().join(known.select("job", "kind", "value").distinct(), ["kind", "value"])
    return shared.groupBy("message", "job").agg(F.sum(weight).cast("long").alias("score"), F.count("*").alias("matched"), F.bool_or(F.col("kind") == "conversation").alias("thread"))


def decisions(ids: DataFrame, scored: DataFrame) -> DataFrame:
    """(message, decision, job, score): attach to the one best job that reaches the threshold; ambiguous if several tie; by thread alone only without a strong identifier and if one job has it."""
    messages = ids.groupBy("message").agg(F.bool_or(F.col("kind").isin(*STRONG)).alias("strong"))
    ties = scored.groupBy("message", "score").agg(F.count("*").alias("n"), F.min("job").alias("best"), F.count_if("thread").alias("t"), F.min(F.when(F.col("thread"), F.col("job"))).alias("tj"))
    top = ties.groupBy("message").agg(F.max("score").alias("top"), F.max_by("n", "score").alias("n"), F.max_by("best", "score").alias("best"), F.sum("t").alias("threads"), F.min("tj").alias("thread_job"))
    joined = messages.join(top, "message", "left")
    reached = F.coalesce(F.col("top"), F.lit(0)) >= NEEDED
    thread = ~reached & ~F.col("strong") & (F.col("threads") == 1)
    decision = F.when(reached & (F.col("n") > 1), "ambiguous").when(reached | thread, "attach").otherwise("none")
    job = F.when(reached & (F.col("n") == 1), F.col("best")).when(thread, F.col("thread_job"))
    return joined.select("message", decision.alias("decision"), job.alias("job"), F.coalesce("top", F.lit(0)).cast("long").alias("score"))


def similar_keys(asked: DataFrame, asked_id: str, master: DataFrame, master_id: str, least: int, carried: tuple[str, ...] = ()) -> DataFrame:
    """(asked_id, master_id, sim) of the pairs of keys whose 3-gram sets have a Jaccard similarity, in ten thousandths, of ``least`` or more; with the ``carried`` columns of the master.

    Two such sets share one of their rarest grams: of n grams the rarest
    n - least * n + 1 are enough. Only these meet in the join, and a pair counts
    where it meets at the rarest gram that both have, so no pair is stored,
    sorted or made distinct. Asked keys that share a gram are dealt to parts of
    about DEALT, so no gram is one task. Ids are unique on either side.
    """
    sides = [f.select(F.struct(F.col(i).alias("__id"), *more).alias("own"), F.explode(trigram_codes(F.col("key"))).alias("t")) for f, i, more in ((asked, asked_id, ()), (master, master_id, carried))]
    often = sides[1].groupBy("t").agg(F.count("*").alias("n"))  # bounded by the number of different grams
    enough = F.size("s") - F.ceil(F.size("s") * least / 10000).cast("int") + 1
    rare = []
    for f in sides:
        sorted_ = f.join(often, "t", "left").groupBy("own").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t"))).alias("s"))
        ranked = sorted_.select("own", F.col("s.t").alias("grams"), F.posexplode(F.slice("s", F.lit(1), enough)).alias("i", "x")).where("x.n > 0")
        rare.append(ranked.select("own", "grams", "x.t", F.when(F.col("i") > 0, F.get("grams", F.col("i") - 1)).alias("rarer")))
    dealt = rare[0].groupBy("t").agg(F.ceil(F.count("*") / DEALT).cast("int").alias("parts"))  # bounded as above
    left = rare[0].join(dealt, "t").select("t", F.pmod(F.xxhash64("own"), F.col("parts")).cast("int").alias("part"), F.col("own").alias("a"), F.col("grams").alias("g"), F.col("rarer").alias("before"))
    right = rare[1].join(dealt, "t").select("t", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("own").alias("b"), F.col("grams").alias("h"), "rarer")
    alike = (F.size("h") * 10000 >= F.size("g") * least) & (F.size("g") * 10000 >= F.size("h") * least)
    first = ~F.coalesce(F.col("before") == F.col("rarer"), F.lit(False))  # else they met there; tested before all of the grams are
    met = left.repartition(TASKS, "t", "part").join(right.repartition(TASKS, "t", "part"), ["t", "part"]).where(alike & first)
    shared = met.select("*", F.explode(F.array(F.array_intersect("g", "h"))).alias("both")).where(F.element_at("both", 1) == F.col("t"))  # exploded to be computed once
    both = F.size("both")
    sim = F.floor(both * 10000 / (F.size("g") + F.size("h") - both)).cast("bigint")
    return shared.withColumn("sim", sim).where(F.col("sim") >= least).select(F.col("a.__id").alias(asked_id), F.col("b.__id").alias(master_id), *[F.col("b")[c].alias(c) for c in carried], "sim")


def resolve_parties(stated: DataFrame, stated_id: str, master: DataFrame, master_id: str, least: int = 5500, margin: int = 10) -> DataFrame:
    """(stated_id, status, master_id) by name key: exact if one party has it, ambiguous if more; else the one of 3-gram similarity (in ten thousandths) ``least`` or more without another within ``margin``.

    Candidates come from ``similar_keys`` over distinct keys and are summed up
    by similarity as they are found, of which a name has few different ones.
    """
    keys = master.groupBy("key").agg(F.min(master_id).alias(master_id), F.count("*").alias("n"))
    asked = stated.select(stated_id, "key")
    exact = asked.join(keys, "key").select(stated_id, F.col("n").alias("exact"), F.col(master_id).alias("exact_party"))
    names = asked.select("key").distinct().withColumn("asked_key", F.col("key"))
    near = similar_keys(names, "asked_key", keys.withColumn("other", F.col("key")), "other", least - margin, (master_id, "n"))
    steps = near.groupBy(F.col("asked_key").alias("key"), "sim").agg(F.sum("n").alias("n"), F.min(master_id).alias("party"))
    listed = steps.groupBy("key").agg(F.max("sim").alias("best"), F.collect_list(F.struct("sim", "n", "party")).alias("steps"))
    top = listed.select("key", "best", F.filter("steps", lambda x: x["sim"] >= F.col("best") - margin).alias("top"))
    close = top.select("key", "best", F.aggregate("top.n", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("close"), F.array_min("top.party").alias("fuzzy_party"))
    joined = asked.join(exact, stated_id, "left").join(close, "key", "left")
    similar = F.coalesce(F.col("best"), F.lit(0)) >= least
    status = F.when(F.col("exact") == 1, "exact").when(F.col("exact") > 1, "ambiguous").when(~similar, "none").when(F.col("close") == 1, "fuzzy").otherwise("ambiguous")
    party = F.when(F.col("exact") == 1, F.col("exact_party")).when(F.col("exact").isNull() & similar & (F.col("close") == 1), F.col("fuzzy_party"))
    return joined.select(stated_id, status.alias("status"), party.alias(master_id))
