"""Readers that keep what they can't read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.errors import AnalysisException


def csv_rows(lines: DataFrame, line: str, schema: str, *rules: tuple[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of CSV lines: quotes and doubled quotes as in RFC 4180; a reject has its line and the first rule that it breaks."""
    parsed = lines.select("*", F.from_csv(F.col(line), schema, {"quote": '"', "escape": '"', "mode": "PERMISSIVE"}).alias("__r")).select("*", "__r.*").drop("__r")
    reason = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules])
    marked = parsed.withColumn("reason", reason)
    return marked.where("reason IS NULL").drop("reason"), marked.where("reason IS NOT NULL").select(*lines.columns, "reason")


def csv_records(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, fields) of whole CSV texts, one row a file: quoted fields may hold commas, line breaks and doubled quotes, an open quote goes on to the end, lines end in LF, CR or both; records without any text are left out, and the others numbered from 1.

    A file is read by one task, as a quote can only be told open from its start.
    """
    records = F.regexp_extract_all(text, F.lit(r'((?:[^"\r\n]++|"[^"]*+(?:"|\z))*+)(?:\r\n|\r|\n|\z)'), F.lit(1))
    bare = lambda x: F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r'"((?:[^"]++|"")*+)(?:"|\z)', "$1"), '""', '"'), r"(?U)^[\s\x{FEFF}]+|[\s\x{FEFF}]+$", "")
    fields = lambda r: F.transform(F.regexp_extract_all(r, F.lit(r'((?:[^",]++|"[^"]*+(?:"|\z))*+)(?:,|\z)'), F.lit(1)), bare)
    kept = F.filter(F.transform(records, fields), lambda r: F.exists(r, lambda x: x != ""))
    return files.select(key, F.posexplode(kept).alias("line", "fields")).withColumn("line", F.col("line") + 1)


def requirement_rows(files: DataFrame, key: str, text: str) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of files ``hs_code,code,title,requirement_text``: a first record that reads like a heading is skipped, codes keep their digits, a missing title is the code; rejects have line, what stood as the code, and the first reason."""
    cell = lambda i: F.coalesce(F.get("fields", F.lit(i)), F.lit(""))
    read = csv_records(files, key, text).select(key, "line", cell(0).alias("raw"), cell(1).alias("code"), cell(2).alias("title"), cell(3).alias("requirement"))
    body = read.where(~((F.col("line") == 1) & F.col("raw").rlike("(?i)^hs") & F.col("code").rlike("(?i)code"))).withColumn("hs", F.regexp_replace("raw", "[^0-9]", ""))
    reason = F.when(~F.length("hs").between(2, 8), "not an HS code").when(F.col("code") == "", "no requirement code").when(F.col("requirement") == "", "no requirement text")
    marked = body.withColumn("reason", reason)
    good = marked.where("reason IS NULL").select(key, "line", "hs", "code", F.when(F.col("title") == "", F.col("code")).otherwise(F.col("title")).alias("title"), "requirement")
    return good, marked.where("reason IS NOT NULL").select(key, "line", "raw", "reason")


def read_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """CSV files with a header; quoted fields may hold line breaks."""
    return spark.read.schema(schema).options(header=True, multiLine=True, quote='"', escape='"').csv(path)


def read_json_or_empty(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """JSON documents; an empty table if there are none, without those that are no JSON."""
    try:
        rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
        rows.limit(1).count()
        return rows
    except AnalysisException:
        return spark.createDataFrame([], schema)


def tenant_table(spark: SparkSession, path: str, company: str | int, *columns: str, key: str = "company_id") -> DataFrame:
    """A tenant's rows of a table; the filter and the columns reach the scan."""
    rows = spark.read.parquet(path).where(F.col(key) == company)
    return rows.select(*columns) if columns else rows
