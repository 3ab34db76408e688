"""The domain as deterministic projections of the fixture tables, in Spark and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..ship import ship

AS_OF = "1998-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def hs(column: str) -> Column:
    return F.lpad(((F.col(column) * 7919 + 1010000) % 100000000).cast("string"), 8, "0")


HS_SQL = "lpad((({} * 7919 + 1010000) % 100000000)::VARCHAR, 8, '0')"
CURRENCIES = ("USD", "EUR", "JPY", "INR")
#: Charge: modulus of the order key, unit, and how far its currency is from the customer's.
CHARGES = {"freight": (7, "10.25", 1), "misc": (4, "2.40", 3), "loading": (3, "1.75", 0), "discount": (6, "0.85", 2)}


def currency(key: str) -> Column:
    return F.element_at(F.array(*map(F.lit, CURRENCIES)), (F.col(key) % 4 + 1).cast("int"))


def currency_sql(key: str) -> str:
    return f"(['USD','EUR','JPY','INR'])[({key} % 4 + 1)::INT]"


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as invoices: charges each in a currency of its own, every other one insured by percent."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("invoice"),
        F.to_date("o_orderdate").alias("day"),
        F.col("o_custkey").alias("importer"),
        currency("o_custkey").alias("currency"),
        *[((F.col("o_orderkey") % n) * F.lit(unit).cast("decimal(4,2)")).cast("decimal(12,2)").alias(c) for c, (n, unit, _) in CHARGES.items()],
        *[F.element_at(F.array(*map(F.lit, CURRENCIES)), ((F.col("o_custkey") + k) % 4 + 1).cast("int")).alias(f"{c}_currency") for c, k in [*((c, k) for c, (_, _, k) in CHARGES.items()), ("insurance", 2)]],
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("1.125").cast("decimal(8,4)")).alias("insurance_percent"),
        F.when(F.col("o_orderkey") % 2 == 1, ((F.col("o_orderkey") % 5) * F.lit("3.50").cast("decimal(3,2)")).cast("decimal(12,2)")).alias("insurance_amount"),
    )


INVOICES_SQL = f"""invoices AS (
  SELECT o_orderkey AS invoice, o_orderdate::DATE AS day, o_custkey AS importer, {currency_sql('o_custkey')} AS currency,
         ((o_orderkey % 7) * 10.25::DECIMAL(4,2))::DECIMAL(12,2) AS freight, ((o_orderkey % 4) * 2.40::DECIMAL(4,2))::DECIMAL(12,2) AS misc,
         ((o_orderkey % 3) * 1.75::DECIMAL(4,2))::DECIMAL(12,2) AS loading, ((o_orderkey % 6) * 0.85::DECIMAL(4,2))::DECIMAL(12,2) AS discount,
         (['USD','EUR','JPY','INR'])[((o_custkey + 1) % 4 + 1)::INT] AS freight_currency, (['USD','EUR','JPY','INR'])[((o_custkey + 3) % 4 + 1)::INT] AS misc_currency,
         (['USD','EUR','JPY','INR'])[(o_custkey % 4 + 1)::INT] AS loading_currency, (['USD','EUR','JPY','INR'])[((o_custkey + 2) % 4 + 1)::INT] AS discount_currency,
         (['USD','EUR','JPY','INR'])[((o_custkey + 2) % 4 + 1)::INT] AS insurance_currency,
         CASE WHEN o_orderkey % 2 = 0 THEN 1.125::DECIMAL(8,4) END AS insurance_percent,
         CASE WHEN o_orderkey % 2 = 1 THEN ((o_orderkey % 5) * 3.50::DECIMAL(3,2))::DECIMAL(12,2) END AS insurance_amount
  FROM orders)"""

ITEM_ORDER = ("l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items numbered within their invoice; rates by part key."""
    w = Window.partitionBy("l_orderkey").orderBy(*ITEM_ORDER)
    rate = lambda values: F.element_at(F.array(*[F.lit(v).cast("decimal(8,4)") for v in values]), (F.col("l_partkey") % len(values) + 1).cast("int"))
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("invoice"),
        F.row_number().over(w).alias("sl_no"),
        F.col("l_partkey").alias("part"),
        hs("l_partkey").alias("hs"),
        F.col("l_quantity").cast("decimal(12,2)").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(14,2)").alias("unit_price"),
        rate(["7.5", "10", "25", "0"]).alias("bcd_rate"),
        F.when(F.col("l_partkey") % 5 == 0, F.lit("100").cast("decimal(5,2)")).alias("exempt_percent"),
        F.when(F.col("l_partkey") % 13 == 0, F.lit("5").cast("decimal(8,4)")).alias("aidc_rate"),
        F.when(F.col("l_partkey") % 9 == 0, F.lit("1.5").cast("decimal(8,4)")).alias("health_cess_rate"),
        F.when(F.col("l_partkey") % 6 == 0, F.lit("5").cast("decimal(8,4)")).alias("sws_rate"),
        rate(["18", "5", "28", "12", "0.25"]).alias("igst_rate"),
        F.when(F.col("l_partkey") % 11 == 0, F.lit("12").cast("decimal(8,4)")).alias("cess_rate"),
    )


ITEMS_SQL = f"""items AS (
  SELECT l_orderkey AS invoice, (row_number() OVER (PARTITION BY l_orderkey ORDER BY {', '.join(ITEM_ORDER)}))::INT AS sl_no, l_partkey AS part,
         {HS_SQL.format('l_partkey')} AS hs, l_quantity::DECIMAL(12,2) AS quantity, l_extendedprice::DECIMAL(14,2) AS unit_price,
         ([7.5, 10, 25, 0]::DECIMAL(8,4)[])[(l_partkey % 4 + 1)::INT] AS bcd_rate,
         CASE WHEN l_partkey % 5 = 0 THEN 100::DECIMAL(5,2) END AS exempt_percent,
         CASE WHEN l_partkey % 13 = 0 THEN 5::DECIMAL(8,4) END AS aidc_rate, CASE WHEN l_partkey % 9 = 0 THEN 1.5::DECIMAL(8,4) END AS health_cess_rate,
         CASE WHEN l_partkey % 6 = 0 THEN 5::DECIMAL(8,4) END AS sws_rate,
         ([18, 5, 28, 12, 0.25]::DECIMAL(8,4)[])[(l_partkey % 5 + 1)::INT] AS igst_rate,
         CASE WHEN l_partkey % 11 = 0 THEN 12::DECIMAL(8,4) END AS cess_rate
  FROM lineitem)"""


def exchange_rates(spark: SparkSession) -> DataFrame:
    """Quarterly tables from July 1995 on, so that earlier days fall back to the first one."""
    quarters = spark.range(24).select(F.col("id").cast("int").alias("q"))
    codes = F.explode(F.array(*[F.struct(F.lit(c).alias("currency"), F.lit(k).alias("k")) for k, c in enumerate(CURRENCIES)])).alias("c")
    rate = F.when(F.col("c.currency") == "INR", F.lit(1).cast("decimal(8,4)")).otherwise(((F.lit(4000) + F.col("c.k") * 1000 + F.col("q") * 37) * F.lit("0.0100").cast("decimal(5,4)")).cast("decimal(8,4)"))
    return quarters.select("q", codes).select("c.currency", F.add_months(F.lit("1995-07-01").cast("date"), F.col("q") * 3).alias("since"), rate.alias("fx"))


FX_SQL = """fx_tables AS (
  SELECT currency, ('1995-07-01'::DATE + to_months((q * 3)::INT))::DATE AS since,
         CASE WHEN currency = 'INR' THEN 1::DECIMAL(8,4) ELSE ((4000 + k * 1000 + q * 37) * 0.01::DECIMAL(5,4))::DECIMAL(8,4) END AS fx
  FROM range(24) t(q), (VALUES ('USD', 0), ('EUR', 1), ('JPY', 2), ('INR', 3)) c(currency, k))"""

#: Latest table at or before the day, else the earliest one.
def _fx_step(source: str, name: str, column: str, fx: str) -> str:
    return f"""{name} AS (
  SELECT i.*, coalesce(a.fx, b.fx) AS {fx} FROM {source} i
  ASOF LEFT JOIN fx_tables a ON i.{column} = a.currency AND i.day >= a.since
  LEFT JOIN (SELECT currency, arg_min(fx, since) AS fx FROM fx_tables GROUP BY currency) b ON i.{column} = b.currency)"""


INVOICE_FX_SQL = _fx_step("invoices", "invoice_fx", "currency", "fx")
#: The rate of each charge's currency beside that of the invoice.
CHARGE_FX_SQL = ",\n".join([_fx_step(a, b, f"{c}_currency", f"{c}_fx") for a, b, c in (("invoice_fx", "fx1", "freight"), ("fx1", "fx2", "misc"), ("fx2", "fx3", "loading"), ("fx3", "fx4", "discount"), ("fx4", "charge_fx", "insurance"))])
