"""Fields from several documents: the first one that is stated wins, differing ones are reported."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import nearly_equal


def first_stated(documents: DataFrame, job: str, order: str, fields: list[str]) -> DataFrame:
    """Per job each field's first stated value in the documents' order of precedence."""
    return documents.groupBy(job).agg(*[F.min_by(f, F.when(F.col(f).isNotNull(), F.col(order))).alias(f) for f in fields])


def conflicts(documents: DataFrame, job: str, order: str, field: str) -> DataFrame:
    """(job, chosen, others): values of a measure that aren't nearly equal to the chosen first one."""
    values = F.array_sort(F.collect_list(F.when(F.col(field).isNotNull(), F.struct(F.col(order).alias("o"), F.col(field).alias("v")))))
    listed = documents.groupBy(job).agg(values.alias("x")).where(F.size("x") > 0)
    chosen = F.get("x", F.lit(0))["v"]
    others = F.filter("x", lambda e: ~nearly_equal(e["v"], chosen))
    return listed.withColumn("others", F.transform(others, lambda e: e["v"])).withColumn("chosen", chosen).where(F.size("others") > 0).select(job, "chosen", "others")


def flags(frame: DataFrame, *rules: tuple[str, str, str, Column]) -> DataFrame:
    """frame with ``flags``: array<struct<severity, path, code>> of the rules (severity, path, code, condition) that hold, in order."""
    made = [F.when(condition, F.struct(F.lit(severity).alias("severity"), F.lit(path).alias("path"), F.lit(code).alias("code"))) for severity, path, code, condition in rules]
    return frame.withColumn("flags", F.array_compact(F.array(*made)))


def terms_of_invoice(stated: Column, has_charges: Column) -> Column:
    """Terms as declared: carriage-paid and unclear ones count as cost and freight, ex-works and free-on-board too if charges are billed."""
    cost = stated.isin("CFR", "CPT", "UNKNOWN") | (stated.isin("EXW", "FOB") & has_charges)
    return F.when(cost, "C&F").when(stated == "EXW", "FOB").otherwise(stated)
