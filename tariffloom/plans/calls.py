"""Choices between entries of a schedule by checked model calls; the client is a rule with stated faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calls as M
from ..operators import joins as J
from ..ship import ship
from .fixture import HS_SQL, hs, table

CANDIDATES = 8  # entries offered to the model: fixed value
FIELDS = {"index": ("bigint", True), "reason": ("string", False)}


class FaultyChoice(M.WordChoice):
    """Faults by the last digit of the code: 0 and 2 give the standard model's broken JSON and an index as text, 1 prose and 3 an unknown index by any model, 4 no reply at first, 5 no reason by the standard model."""

    def reply(self, model: str, prompts: list[str], attempt: int) -> list[str | None]:
        return [self.spoilt(p, model == "standard", attempt) for p in prompts]

    def spoilt(self, prompt: str, small: bool, attempt: int) -> str | None:
        good, digit = self.choice(prompt), prompt.partition("\n")[0][-1]
        if digit == "4" and attempt == 1:
            return None
        always = {"1": "I would choose the first", "3": '{"index": 99, "reason": "made up"}'}
        first = {"0": good[:-3], "2": good.replace('"index": ', '"index": "').replace(', "reason"', '", "reason"'), "5": good.partition(",")[0] + "}"}
        return always.get(digit) or (first.get(digit, good) if small else good)


def _entries(part: DataFrame) -> DataFrame:
    """Each part as an entry under the heading of the first of its three, every other one under the subheading; every fifth excludes that code."""
    first = part.select("p_partkey", "p_name", "p_size", (F.col("p_partkey") - F.col("p_partkey") % 3).alias("first")).withColumn("h", hs("first"))
    prefix = F.array(F.substring("h", F.lit(1), F.when(F.col("p_partkey") % 2 == 0, 6).otherwise(4)))
    none = F.array().cast("array<string>")
    return first.select(F.col("p_partkey").alias("pos"), prefix.alias("include"), F.when(F.col("p_partkey") % 5 == 0, F.array("h")).otherwise(none).alias("exclude"), F.lit(False).alias("any_chapter"), (F.col("p_size") % 30).alias("rate"), "p_name")


def _requests(spark, sf_dir: str) -> DataFrame:
    """Codes with two named entries or more: the best eight, as a prompt."""
    part = table(ship(spark), sf_dir, "part")
    goods = part.groupBy(hs("p_partkey").alias("hs")).agg(F.min("p_name").alias("goods"))
    entries = _entries(part)
    named = J.best_prefixes(goods.select("hs"), "hs", entries.drop("rate", "p_name"), CANDIDATES).join(entries.select("pos", "rate", "p_name"), "pos")
    offered = named.groupBy("hs").agg(F.array_sort(F.collect_list(F.struct("k", "pos", "rate", "p_name"))).alias("c")).where(F.size("c") > 1)
    listed = F.transform("c", lambda x: F.concat(F.lit("["), (x["k"] - 1).cast("string"), F.lit("] "), x["rate"].cast("string"), F.lit(": "), x["p_name"]))
    return offered.join(goods, "hs").select("hs", "c", F.concat_ws("\n", F.concat(F.lit("Code "), "hs"), F.concat(F.lit("Goods "), "goods"), F.array_join(listed, "\n")).alias("prompt"))


def _called(spark, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    known = F.col("answer.index").isNull() | F.col("answer.index").between(0, F.regexp_count("prompt", F.lit(r"(?m)^\[")) - 1)
    return M.answered(_requests(spark, sf_dir), "hs", "prompt", FaultyChoice(), FIELDS, ("unknown entry", known))


def choices_called(spark, sf_dir: str) -> DataFrame:
    """The entry that the model chose for each code with several, null where it found none, with the model and attempt that answered."""
    answers = _called(spark, sf_dir)[0]
    return answers.select("hs", F.get("c", F.col("answer.index").cast("int"))["pos"].alias("pos"), "model", "attempt", F.col("answer.reason").alias("reason"))


def choices_rejected(spark, sf_dir: str) -> DataFrame:
    """Codes that no attempt settled, with the last reason; their rates stay what the schedule says."""
    return _called(spark, sf_dir)[1].select("hs", "reason")


_OFFERED = f"""WITH code AS (SELECT {HS_SQL.format('p_partkey')} AS hs, min(p_name) AS goods FROM part GROUP BY 1),
i AS (SELECT p_partkey AS pos, p_name, {HS_SQL.format('(p_partkey - p_partkey % 3)')} AS h, left(h, CASE WHEN p_partkey % 2 = 0 THEN 6 ELSE 4 END) AS prefix FROM part),
m AS (SELECT hs, goods, pos, p_name, length(prefix) AS len FROM code JOIN i ON left(hs, length(prefix)) = prefix WHERE NOT (pos % 5 = 0 AND hs = h)),
r AS (SELECT *, row_number() OVER (PARTITION BY hs ORDER BY len DESC, pos) AS k FROM m QUALIFY k <= 8),
s AS (SELECT *, len(list_intersect(list_distinct(string_split(goods, ' ')), list_distinct(string_split(p_name, ' ')))) AS shared FROM r),
b AS (SELECT hs, right(hs, 1) AS digit, max(shared) AS shared, arg_min(pos, k) FILTER (shared = mx) AS pos FROM (SELECT *, max(shared) OVER (PARTITION BY hs) AS mx FROM s) GROUP BY hs HAVING count(*) > 1)"""
QUERIES = {f.__name__: f for f in (choices_called, choices_rejected)}
SQL = {
    "choices_called": f"""{_OFFERED} SELECT hs, CASE WHEN shared > 0 THEN pos END AS pos, CASE WHEN digit IN ('0', '2', '5') THEN 'larger' ELSE 'standard' END AS model,
 CASE WHEN digit IN ('0', '2', '5') THEN 3 WHEN digit = '4' THEN 2 ELSE 1 END AS attempt, shared || ' words shared' AS reason FROM b WHERE digit NOT IN ('1', '3')""",
    "choices_rejected": f"{_OFFERED} SELECT hs, CASE digit WHEN '1' THEN 'no JSON' ELSE 'unknown entry' END AS reason FROM b WHERE digit IN ('1', '3')",
}
