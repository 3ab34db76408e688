"""The functions that SQL can call: temporary SQL functions, which Catalyst inlines, and one table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

SQL_FUNCTIONS = {
    "alnum": ("x STRING", "STRING", "regexp_replace(upper(x), '[^A-Z0-9]', '')"),
    "airway_bill": ("x STRING", "STRING", "CASE WHEN length(regexp_replace(x, '[^0-9]', '')) = 11 THEN regexp_replace(x, '[^0-9]', '') END"),
    "pad8": ("x STRING", "STRING", "CASE WHEN length(regexp_replace(x, '[^0-9]', '')) BETWEEN 1 AND 8 THEN rpad(regexp_replace(x, '[^0-9]', ''), 8, '0') END"),
    "hs_code": ("x STRING", "STRING", "CASE WHEN length(regexp_replace(x, '[^0-9]', '')) >= 4 THEN left(regexp_replace(x, '[^0-9]', ''), 8) END"),
    "duty_percent": ("amount DECIMAL(20,8), rate DECIMAL(8,4)", "DECIMAL(28,10)", "CAST(amount * CAST(rate * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(12,6)) AS DECIMAL(28,10))"),
    "alert_level": ("days INT, within INT", "STRING", "CASE WHEN days < 0 THEN 'overdue' WHEN days <= within THEN 'due' ELSE 'soon' END"),
}


class Chunks:
    """Windows of ``size`` characters over a text, each ``overlap`` into the one before."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str]]:
        for k, start in enumerate(range(0, max(1, len(text or "") - overlap), size - overlap)):
            yield k, (text or "")[start : start + size]


def register(spark: SparkSession) -> SparkSession:
    for name, (arguments, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURNS {kind} RETURN {body}")
    spark.udtf.register("text_chunks", F.udtf(Chunks, returnType="chunk int, part string"))
    return spark
