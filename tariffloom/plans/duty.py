"""Valuation, duty and exchange-rate queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import rupees_in_words
from ..operators import duty as D
from ..operators.joins import asof, asof_map
from .fixture import CHARGE_FX_SQL, CHARGES, FX_SQL, INVOICE_FX_SQL, INVOICES_SQL, ITEMS_SQL, exchange_rates, invoices, items, table
from .words_sql import words_sql


def fx_asof(spark, sf_dir: str) -> DataFrame:
    """The exchange rate of each invoice's day."""
    return asof(invoices(spark, sf_dir), "day", exchange_rates(spark), "since", ["currency"], ["fx"]).select("invoice", "day", "currency", "fx")


def _priced(spark, sf_dir: str, made: DataFrame | None = None) -> DataFrame:
    charges = [*CHARGES, "insurance"]
    rated = asof_map(invoices(spark, sf_dir) if made is None else made, "day", exchange_rates(spark), "since", "currency", "fx", ["currency", *(f"{c}_currency" for c in charges)], "rates")
    rate = lambda c: F.try_element_at("rates", F.col(c))
    return D.charges_home(rated.select("*", rate("currency").alias("fx"), *[rate(f"{c}_currency").alias(f"{c}_fx") for c in charges]).drop("rates"))


def _valued(spark, sf_dir: str) -> DataFrame:
    return D.valued(items(spark, sf_dir), _priced(spark, sf_dir))


def item_valuation(spark, sf_dir: str) -> DataFrame:
    return _valued(spark, sf_dir).select("invoice", "sl_no", D.money(F.col("value")).alias("value"), D.money(F.col("additions")).alias("additions"), D.money(F.col("assessable")).alias("assessable"))


def item_duty(spark, sf_dir: str) -> DataFrame:
    return D.rounded_items(D.item_duty(_valued(spark, sf_dir)), "hs")


def duty_by_order(spark, sf_dir: str) -> DataFrame:
    return D.by_invoice(D.item_duty(_valued(spark, sf_dir)))


def duty_totals_by_nation(spark, sf_dir: str) -> DataFrame:
    """Payable duty by the importer's nation."""
    nations = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("importer"), F.col("n_name").alias("nation"))
    return D.by_invoice(D.item_duty(_valued(spark, sf_dir)).join(nations, "importer"), "nation")


def duty_in_words(spark, sf_dir: str) -> DataFrame:
    return duty_by_order(spark, sf_dir).select("invoice", "payable", rupees_in_words(F.col("payable")).alias("words"))


def recomputed_duty(spark, sf_dir: str) -> DataFrame:
    """Duty of each order after its importer's open policy insures what has no insurance."""
    unstated = F.col("invoice") % 3 == 0
    inv = invoices(spark, sf_dir)
    bare = inv.select(*[F.when(~unstated, F.col(c)).alias(c) if c in ("insurance_percent", "insurance_amount") else c for c in inv.columns], F.element_at(F.array(*map(F.lit, ("FOB", "C&F", "CIF"))), (F.col("invoice") % 5 % 3 + 1).cast("int")).alias("terms"))
    rates = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("importer"), F.when(F.col("c_custkey") % 4 > 0, (F.col("c_custkey") % 7 * F.lit("0.25").cast("decimal(3,2)")).cast("decimal(8,4)")).alias("policy_rate"))
    insured = D.with_open_policy(bare.join(rates, "importer", "left"))
    return D.by_invoice(D.item_duty(D.valued(items(spark, sf_dir), _priced(spark, sf_dir, insured))), "invoice", "by_policy")


def duty_failures(spark, sf_dir: str) -> DataFrame:
    """Invoices whose duty can't be computed, with the reason; one without goods, or with charges in a third currency that its table lacks."""
    inv = invoices(spark, sf_dir).withColumn("charge_currency", F.when(F.col("invoice") % 13 == 0, "CHF").otherwise(F.col("currency")))
    goods = items(spark, sf_dir).groupBy("invoice").agg(F.sum(F.col("quantity") * F.col("unit_price")).alias("goods"))
    known = exchange_rates(spark).select(F.col("currency").alias("charge_currency")).distinct().withColumn("known", F.lit(True))
    joined = inv.join(goods, "invoice", "left").join(known, "charge_currency", "left")
    reason = F.when(F.coalesce("goods", F.lit(0).cast("decimal(38,4)")) == 0, "no goods value").when(F.col("known").isNull(), "no exchange rate")
    return joined.select("invoice", reason.alias("reason")).where("reason IS NOT NULL")


VALUED_SQL = f"""WITH {INVOICES_SQL}, {ITEMS_SQL}, {FX_SQL}, {INVOICE_FX_SQL}, {CHARGE_FX_SQL},
joined AS (
  SELECT i.*, v.importer, v.fx, v.insurance_percent, (v.insurance_amount * v.insurance_fx)::DECIMAL(20,6) AS insurance_home,
         (v.freight * v.freight_fx + v.misc * v.misc_fx + v.loading * v.loading_fx - v.discount * v.discount_fx)::DECIMAL(20,8) AS charges_home,
         (quantity * unit_price)::DECIMAL(20,4) AS value
  FROM items i JOIN charge_fx v USING (invoice)),
goods AS (SELECT *, (sum(value) OVER (PARTITION BY invoice))::DECIMAL(20,4) AS goods FROM joined),
added AS (
  SELECT *, (charges_home + coalesce(insurance_home::DECIMAL(26,8),
     (((goods::DECIMAL(18,4) * fx)::DECIMAL(26,8) + charges_home)::DECIMAL(20,8)::DECIMAL(26,8) * insurance_percent::DECIMAL(8,4) * 0.01::DECIMAL(3,2))::DECIMAL(28,10)::DECIMAL(26,8)))::DECIMAL(20,8) AS additions,
     CASE WHEN goods > 0 THEN round(value / goods, 14)::DECIMAL(16,14) END AS share
  FROM goods),
valued AS (
  SELECT *, ((value::DECIMAL(18,4) * fx)::DECIMAL(26,8) + (additions::DECIMAL(18,6) * share)::DECIMAL(28,8))::DECIMAL(24,8) AS assessable FROM added)"""
_PCT = "({}::DECIMAL(20,8) * {}::DECIMAL(8,4) * 0.01::DECIMAL(3,2))::DECIMAL(28,10)"
DUTY_SQL = f"""{VALUED_SQL},
d1 AS (SELECT *, {_PCT.format(_PCT.format('assessable', 'bcd_rate'), '(100 - coalesce(exempt_percent, 0))')}::DECIMAL(24,8) AS bcd FROM valued),
d2 AS (SELECT *, {_PCT.format('assessable', 'coalesce(aidc_rate, 0)')}::DECIMAL(24,8) AS aidc, {_PCT.format('assessable', 'coalesce(health_cess_rate, 0)')}::DECIMAL(24,8) AS health_cess,
  {_PCT.format('bcd', 'coalesce(sws_rate, 10)')}::DECIMAL(24,8) AS sws FROM d1),
d3 AS (SELECT *, (assessable + bcd + aidc + health_cess + sws)::DECIMAL(24,8) AS base FROM d2),
duty AS (SELECT *, {_PCT.format('base', 'igst_rate')}::DECIMAL(24,8) AS igst, {_PCT.format('base', 'coalesce(cess_rate, 0)')}::DECIMAL(24,8) AS cess FROM d3)"""
_PAYABLE = "sum(bcd) + sum(aidc) + sum(health_cess) + sum(sws) + sum(igst) + sum(cess)"
_AMOUNTS = "assessable bcd aidc health_cess sws igst cess".split()
_SUMS = f"""count(*) AS n_items, {', '.join(f'round(sum({c}), 2)::DECIMAL(18,2) AS {c}' for c in _AMOUNTS)}, round(sum(base), 0)::BIGINT AS igst_base,
  round({_PAYABLE}, 0)::BIGINT AS payable"""
_R = "round({0}, 2)::DECIMAL(18,2)"

_POLICY = "o_orderkey % 3 = 0 AND o_orderkey % 5 % 3 < 2 AND o_custkey % 4 > 0 AND o_custkey % 7 > 0"
_POLICY_SQL = DUTY_SQL.replace(INVOICES_SQL, f"""base_{INVOICES_SQL}, invoices AS (SELECT b.* REPLACE ((CASE WHEN {_POLICY} THEN (o_custkey % 7) * 0.25 WHEN o_orderkey % 3 = 0 THEN 0 ELSE insurance_percent END)::DECIMAL(8,4) AS insurance_percent,
  CASE WHEN o_orderkey % 3 > 0 THEN insurance_amount END AS insurance_amount) FROM base_invoices b JOIN orders ON invoice = o_orderkey)""")

QUERIES = {f.__name__: f for f in (fx_asof, item_valuation, item_duty, duty_by_order, duty_totals_by_nation, duty_in_words, recomputed_duty, duty_failures)}
SQL = {
    "duty_in_words": f"{DUTY_SQL}, p AS (SELECT invoice, round({_PAYABLE}, 0)::BIGINT AS payable FROM duty GROUP BY invoice) SELECT invoice, payable, 'Rs. ' || {words_sql('payable')} || ' Only' AS words FROM p",
    "fx_asof": f"WITH {INVOICES_SQL}, {FX_SQL}, {INVOICE_FX_SQL} SELECT invoice, day, currency, fx FROM invoice_fx",
    "item_valuation": f"{VALUED_SQL} SELECT invoice, sl_no, {_R.format('value')} AS value, {_R.format('additions')} AS additions, {_R.format('assessable')} AS assessable FROM valued",
    "item_duty": f"{DUTY_SQL}, r AS (SELECT invoice, sl_no, hs, {', '.join(f'{_R.format(c)} AS {c}' for c in _AMOUNTS)} FROM duty) SELECT *, (bcd + aidc + health_cess + sws + igst + cess)::DECIMAL(18,2) AS total FROM r",
    "duty_by_order": f"{DUTY_SQL} SELECT invoice, {_SUMS} FROM duty GROUP BY invoice",
    "recomputed_duty": f"{_POLICY_SQL} SELECT invoice, {_POLICY} AS by_policy, {_SUMS} FROM duty JOIN orders ON invoice = o_orderkey GROUP BY ALL",
    "duty_totals_by_nation": f"{DUTY_SQL} SELECT n_name AS nation, {_SUMS} FROM duty JOIN customer ON importer = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name",
    "duty_failures": f"""WITH {INVOICES_SQL}, {ITEMS_SQL}, {FX_SQL}, g AS (SELECT invoice, sum(quantity * unit_price) AS goods FROM items GROUP BY invoice)
SELECT invoice, CASE WHEN coalesce(goods, 0) = 0 THEN 'no goods value' ELSE 'no exchange rate' END AS reason
FROM invoices LEFT JOIN g USING (invoice)
WHERE coalesce(goods, 0) = 0 OR (CASE WHEN invoice % 13 = 0 THEN 'CHF' ELSE currency END) NOT IN (SELECT currency FROM fx_tables)""",
}
