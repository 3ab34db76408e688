"""Rounding, comparisons and unit arithmetic."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def money(x: Column, scale: int = 2) -> Column:
    """Half up, away from zero."""
    return F.round(x, scale).cast(f"decimal(18,{scale})")


def half_up_to_plus_infinity(x: Column) -> Column:
    return F.floor(x + F.lit(0.5).cast("decimal(2,1)")).cast("long")


def nearly_equal(a: Column, b: Column, tolerance: str = "0.02") -> Column:
    return F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b)) * F.lit(tolerance).cast("decimal(6,4)")


def line_off(quantity: Column, price: Column, amount: Column) -> Column:
    """Whether quantity times price misses the amount by more than half a percent."""
    return (amount > 0) & (F.abs(quantity * price - amount) > amount * F.lit("0.005").cast("decimal(4,3)"))


def variance(checklist: Column, assessed: Column) -> Column:
    """assessed less checklist, to two places; null if either is unknown."""
    return (assessed - checklist).cast("decimal(18,2)")


def varies(checklist: Column, assessed: Column, tolerance: int = 1) -> Column:
    """Whether they differ by more than ``tolerance`` units; null if either is unknown."""
    return F.abs(variance(checklist, assessed)) > tolerance


def rate_of_cell(cell: Column) -> Column:
    """The one rate that a cell states: ``Nil`` is 0; none for ``-``, for different stacked ones and for bare numbers."""
    tokens = F.filter(F.split(cell, " "), lambda t: t != "")
    values = F.array_distinct(F.transform(tokens, lambda t: F.lower(F.regexp_replace(t, "%+$", ""))))
    only = F.get(values, F.lit(0))
    stated = F.get(tokens, F.lit(0)).endswith("%") & only.rlike("^[0-9]+([.][0-9]+)?$")
    return F.when(F.size(values) != 1, None).when(only == "nil", F.lit(0).cast("decimal(8,3)")).when(stated, only.try_cast("decimal(8,3)"))


def to_kilograms(quantity: Column, price: Column, unit: Column) -> tuple[Column, Column]:
    """Metric tons become kilograms; the price follows."""
    tons = F.regexp_replace(F.upper(unit), "[^A-Z]", "").rlike("^(MT|MTS|MTON.*|TON.*)$")
    return F.when(tons, quantity * 1000).otherwise(quantity), F.when(tons, price / 1000).otherwise(price)


def rupees(x: Column) -> Column:
    """Indian grouping: the last three digits, then pairs."""
    digits = F.abs(x).cast("long").cast("string")
    head = F.when(F.length(digits) > 3, F.substring(digits, F.lit(1), F.length(digits) - 3))
    odd = F.when(F.length(head) % 2 == 1, F.concat(F.lit("0"), head)).otherwise(head)
    grouped = F.regexp_replace(F.regexp_replace(odd, "([0-9]{2})", "$1,"), "^0", "")
    return F.concat(F.when(x < 0, "-").otherwise(""), F.lit("₹"), F.coalesce(grouped, F.lit("")), F.when(F.length(digits) > 3, F.substring(digits, F.length(digits) - 2, F.lit(3))).otherwise(digits))


def backoff(base: Column, failures: Column) -> Column:
    """base times two to the number of failures, 32 times at most; null from ten failures on."""
    return F.when(failures < 10, base * F.least(F.pow(F.lit(2), failures), F.lit(32.0)).cast("long"))


@lru_cache(maxsize=16)
def to_fixed(places: int) -> Callable[[Column], Column]:
    """Text with ``places`` of the double's exact binary value, half up: what no built-in function gives, so it runs on Arrow batches."""
    unit = Decimal(1).scaleb(-places)

    @F.pandas_udf("string")
    def cells(x: pd.Series) -> pd.Series:
        known = x.notna()
        return pd.Series([format(Decimal(v).quantize(unit, ROUND_HALF_UP), "f") for v in x[known].tolist()], index=x.index[known], dtype=object).reindex(x.index)

    return cells
