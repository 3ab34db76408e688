"""Valuation and duty in exact decimals: products before the one division, rounding at the edge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import money

D18_4 = "decimal(18,4)"


def percent(amount: Column, rate: Column) -> Column:
    """amount times rate over a hundred, kept to ten places."""
    share = rate.cast("decimal(8,4)") * F.lit("0.01").cast("decimal(3,2)")  # short decimals first: one wide product instead of two
    return (amount.cast("decimal(20,8)") * share).cast("decimal(28,10)")


#: The additions to an invoice's goods value: what is added, and what is taken off.
ADDED, OFF = ("freight", "misc", "loading"), ("discount",)
#: Terms of invoice that leave insurance to the importer.
UNINSURED = ("FOB", "C&F")
#: The heads of duty in the order of the cascade.
HEADS = ("bcd", "aidc", "health_cess", "sws", "igst", "cess")


def charges_home(invoices: DataFrame) -> DataFrame:
    """Adds ``charges_home``: freight, misc and loading less discount, and ``insurance_home``, each at the rate ``<charge>_fx`` of its own currency; a null charge counts as none."""
    home = lambda c: (F.coalesce(F.col(c), F.lit(0)).cast("decimal(12,2)") * F.col(f"{c}_fx").cast("decimal(8,4)")).cast("decimal(20,6)")
    total = sum((home(c) for c in ADDED[1:]), home(ADDED[0])) - home(OFF[0])
    insurance = (F.col("insurance_amount").cast("decimal(12,2)") * F.col("insurance_fx").cast("decimal(8,4)")).cast("decimal(20,6)")
    return invoices.withColumn("charges_home", total.cast("decimal(20,8)")).withColumn("insurance_home", insurance)


def with_open_policy(invoices: DataFrame) -> DataFrame:
    """Insurance by the importer's open policy where terms leave it out and none is stated; adds ``by_policy``, so that duty is computed anew on it.

    invoices: terms, insurance_percent, insurance_amount, policy_rate. Without
    any insurance the percentage is nil.
    """
    unstated = F.col("insurance_percent").isNull() & F.col("insurance_amount").isNull()
    applies = F.coalesce(unstated & F.col("terms").isin(*UNINSURED) & (F.col("policy_rate") > 0), F.lit(False))
    percentage = F.when(applies, F.col("policy_rate")).when(unstated, F.lit(0)).otherwise(F.col("insurance_percent"))
    return invoices.withColumn("by_policy", applies).withColumn("insurance_percent", percentage.cast("decimal(8,4)"))


def valued(items: DataFrame, invoices: DataFrame) -> DataFrame:
    """Items with their assessable value.

    items: invoice, sl_no, quantity, unit_price, rates; invoices: invoice, fx,
    charges_home, insurance_percent, insurance_home (null if by percent). Goods
    value in home currency plus charges and insurance, which are dealt to items
    in proportion to their value; insurance by percent is of goods and charges.
    Invoices without goods value give null.
    """
    joined = items.join(invoices, "invoice")
    per = Window.partitionBy("invoice")
    value = (F.col("quantity").cast("decimal(12,2)") * F.col("unit_price").cast("decimal(14,2)")).cast("decimal(20,4)")
    joined = joined.withColumn("value", value).withColumn("goods", F.sum("value").over(per).cast("decimal(20,4)"))
    home = (F.col("goods") * F.col("fx").cast("decimal(8,4)")).cast("decimal(26,8)")
    insurance = F.coalesce(F.col("insurance_home").cast("decimal(26,8)"), percent((home + F.col("charges_home")).cast("decimal(20,8)"), F.col("insurance_percent")).cast("decimal(26,8)"))
    additions = (F.col("charges_home") + insurance).cast("decimal(20,8)")
    share = F.when(F.col("goods") > 0, F.round(F.col("value").cast("decimal(20,4)") / F.col("goods"), 14).cast("decimal(16,14)"))
    joined = joined.withColumn("additions", additions).withColumn("share", share)
    own = (F.col("value") * F.col("fx").cast("decimal(8,4)")).cast("decimal(26,8)")
    dealt = (F.col("additions").cast("decimal(18,6)") * F.col("share")).cast("decimal(28,8)")
    return joined.withColumn("assessable", (own + dealt).cast("decimal(24,8)"))


def item_duty(items: DataFrame) -> DataFrame:
    """The cascade on the assessable value, unrounded: basic duty less exemption, agricultural and health cess on the value, surcharge on the basic duty (10 % unless stated), then integrated tax and compensation cess on the sum."""
    av = F.col("assessable").cast("decimal(20,8)")
    rate = lambda c, default=0: F.coalesce(F.col(c), F.lit(default))
    of = lambda amount, r: percent(amount, r).cast("decimal(24,8)")
    kept = (F.lit(100).cast("decimal(5,2)") - F.coalesce(F.col("exempt_percent"), F.lit(0)).cast("decimal(5,2)")).cast("decimal(5,2)")
    out = items.withColumn("bcd", of(percent(av, F.col("bcd_rate")), kept)).withColumn("aidc", of(av, rate("aidc_rate"))).withColumn("health_cess", of(av, rate("health_cess_rate")))
    out = out.withColumn("sws", of(F.col("bcd"), rate("sws_rate", 10)))
    out = out.withColumn("base", sum((F.col(c) for c in HEADS[:4]), F.col("assessable")).cast("decimal(24,8)"))
    return out.withColumn("igst", of(F.col("base"), F.col("igst_rate"))).withColumn("cess", of(F.col("base"), rate("cess_rate")))


def rounded_items(duty: DataFrame, *keep: str) -> DataFrame:
    """Each amount to two places; the item's total is the sum of the rounded amounts."""
    out = duty.select("invoice", "sl_no", *keep, money(F.col("assessable")).alias("assessable"), *[money(F.col(p)).alias(p) for p in HEADS])
    return out.withColumn("total", sum((F.col(p) for p in HEADS[1:]), F.col(HEADS[0])).cast("decimal(18,2)"))


def by_invoice(duty: DataFrame, *keys: str) -> DataFrame:
    """Sums of unrounded amounts, then rounded: to two places, the payable duty and the tax base to whole units."""
    total = lambda c: F.sum(F.col(c).cast("decimal(24,8)"))
    payable = sum((total(c) for c in HEADS[1:]), total(HEADS[0])).cast("decimal(30,8)")
    return duty.groupBy(*(keys or ("invoice",))).agg(
        F.count("*").alias("n_items"),
        *[money(total(c)).alias(c) for c in ("assessable", *HEADS)],
        F.round(total("base"), 0).cast("bigint").alias("igst_base"),
        F.round(payable, 0).cast("bigint").alias("payable"),
    )
