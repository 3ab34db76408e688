"""Export sheets: one DataFrame of text cells for each sheet, issues beside them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import codes as C

#: The columns of the sheets.
CONTAINERS = ("IGM Sr.No", "Container No", "Seal No", "FCL_LCL", "ContainerTypeCode", "ContainerSize", "Truck Number", "EmptyContainerLocation", "PackagesStuffed", "GrWt")
EXCHANGE_RATE = ("CURRENCY_CODE", "EXCHANGE_RATE", "BANK_NAME", "BANK_CERTIFICATE", "BANK_CERTIFICATE_DATE")
STATEMENT = ("Inv_SrNo", "Item_SrNo", "StatementType", "StatementCode", "StatementRemarks")
SW_ADDL_INFO = ("Inv_SrNo", "Item_SrNo", "Info_Type", "info_Qualifier", "Info_Code_Description", "Information", "Measure", "Measure_Unit")
SW_PRODUCTION = ("Inv_SrNo", "Item_SrNo", "Prod_Batch_ID", "Prod_Batch_Quantity", "Prod_Batch_Unit", "Prod_Manufacturer_Date", "Prod_Expiry_Date", "Prod_Best_before_Date")
#: Standing declarations and what each is about.
DECLARATIONS = {"CUG00": "job", "CUG01": "job", "CUV01": "invoice", "CUV02": "invoice", "CUV03": "invoice", "PC002": "item"}


def sheet(rows: DataFrame, columns: tuple[str, ...], cells: dict[str, Column], *keys: str) -> DataFrame:
    """The cells as text under the sheet's columns, blanks where none is given; a cell of an unknown column raises."""
    unknown = set(cells) - set(columns)
    if unknown:
        raise ValueError(f"no such columns: {sorted(unknown)}")
    return rows.select(*keys, *[F.coalesce(cells[c].cast("string"), F.lit("")).alias(c) if c in cells else F.lit("").alias(c) for c in columns])


def issue(rows: DataFrame, key: str, severity: str, path: Column | str, condition: Column) -> DataFrame:
    return rows.where(condition).select(key, F.lit(severity).alias("severity"), (F.lit(path) if isinstance(path, str) else path).alias("path"))


def containers(rows: DataFrame, key: str) -> DataFrame:
    """rows: number, seal, size_type, packages, weight, k (place on the bill, from 0)."""
    size, kind = C.container_size_type(F.col("size_type"))
    made = rows.withColumn("size", size).withColumn("type", kind)
    n = F.col
    cells = {"IGM Sr.No": n("k") + 1, "Container No": n("number"), "Seal No": n("seal"), "FCL_LCL": F.lit("FCL"), "ContainerTypeCode": C.iso_container_code(n("size"), n("type")), "ContainerSize": n("size"), "PackagesStuffed": F.coalesce(n("packages"), F.lit(0)), "GrWt": F.coalesce(n("weight"), F.lit(0)).cast("decimal(18,3)")}
    return sheet(made, CONTAINERS, cells, key)


def container_issues(rows: DataFrame, jobs: DataFrame, key: str) -> DataFrame:
    """Warnings: a sea shipment without containers, numbers given by place, unread sizes, missing seals."""
    size, _ = C.container_size_type(F.col("size_type"))
    at = lambda field: F.concat(F.lit("CONTAINERS["), F.col("k").cast("string"), F.lit(f"].{field}"))
    have = rows.select(key).distinct()
    parts = [
        issue(jobs.join(have, key, "left_anti"), key, "warning", "CONTAINERS", F.col("transport") == "Sea"),
        issue(have, key, "warning", "CONTAINERS.IGM Sr.No", F.lit(True)),
        issue(rows, key, "warning", at("ContainerSize"), (F.coalesce("size_type", F.lit("")) != "") & size.isNull()),
        issue(rows, key, "warning", at("Seal No"), F.coalesce("seal", F.lit("")) == ""),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def exchange_rates(jobs: DataFrame, key: str) -> DataFrame:
    """A row for the rupee and one for the invoice's currency, if it is another; none without a rate, which is a blocker."""
    rows = jobs.where(F.col("fx") > 0).select(key, F.explode(F.when(F.col("currency") == "INR", F.array(F.struct(F.lit("INR").alias("c"), F.lit(1).cast("decimal(18,6)").alias("r")))).otherwise(
        F.array(F.struct(F.lit("INR").alias("c"), F.lit(1).cast("decimal(18,6)").alias("r")), F.struct(F.col("currency").alias("c"), F.col("fx").cast("decimal(18,6)").alias("r")))
    )).alias("x"))
    return sheet(rows, EXCHANGE_RATE, {"CURRENCY_CODE": F.col("x.c"), "EXCHANGE_RATE": F.col("x.r")}, key)


def statements(items: DataFrame, key: str, serial: str) -> DataFrame:
    """Declarations of the job at (0, 0), of its invoice at (1, 0), of each item at (1, serial)."""
    of = lambda scope: F.array(*[F.lit(c) for c, s in DECLARATIONS.items() if s == scope])
    jobs = items.select(key).distinct()
    rows = [jobs.select(key, F.lit(0).alias("i"), F.lit(0).alias("s"), F.explode(of("job")).alias("c")), jobs.select(key, F.lit(1).alias("i"), F.lit(0).alias("s"), F.explode(of("invoice")).alias("c")), items.select(key, F.lit(1).alias("i"), F.col(serial).cast("int").alias("s"), F.explode(of("item")).alias("c"))]
    return sheet(rows[0].unionByName(rows[1]).unionByName(rows[2]), STATEMENT, {"Inv_SrNo": F.col("i"), "Item_SrNo": F.col("s"), "StatementType": F.lit("DEC"), "StatementCode": F.col("c")}, key)


def product_information(rows: DataFrame, key: str, serial: str) -> tuple[DataFrame, DataFrame]:
    """The sheet of additional product information, and a warning for each row whose labels have no code, which is left out.

    rows: info_type, qualifier, code, information, measurement, unit.
    """
    coded = rows.withColumn("t", C.code_of(F.col("info_type"), C.INFO_TYPE_CODES, passing=True)).withColumn("q", C.code_of(F.col("qualifier"), C.QUALIFIER_CODES, passing=True))
    known = F.col("t").isNotNull() & F.col("q").isNotNull()
    cells = {"Inv_SrNo": F.lit(1), "Item_SrNo": F.col(serial), "Info_Type": F.col("t"), "info_Qualifier": F.col("q"), "Info_Code_Description": F.col("code"), "Information": F.col("information"), "Measure": F.coalesce("measurement", F.lit(0)).cast("decimal(18,6)"), "Measure_Unit": F.col("unit")}
    return sheet(coded.where(known), SW_ADDL_INFO, cells, key), issue(coded, key, "warning", "SW_ADDL_INFO", ~known)


def production(rows: DataFrame, key: str, serial: str) -> tuple[DataFrame, DataFrame]:
    """The sheet of batches, and a warning for each batch without both dates, which is left out; the best-before day is the day of expiry.

    rows: batch, batch_quantity, unit, made, expires; one for each item that has a batch.
    """
    whole = F.col("made").isNotNull() & F.col("expires").isNotNull()
    unit = F.when(F.col("batch_quantity").isNotNull(), F.col("unit"))
    cells = {"Inv_SrNo": F.lit(1), "Item_SrNo": F.col(serial), "Prod_Batch_ID": F.col("batch"), "Prod_Batch_Quantity": F.col("batch_quantity").cast("decimal(18,6)"), "Prod_Batch_Unit": unit, "Prod_Manufacturer_Date": F.col("made").cast("date"), "Prod_Expiry_Date": F.col("expires").cast("date"), "Prod_Best_before_Date": F.col("expires").cast("date")}
    return sheet(rows.where(whole), SW_PRODUCTION, cells, key), issue(rows, key, "warning", "SW_PRODUCTION", ~whole)


def unblocked(rows: DataFrame, issues: DataFrame, key: str) -> DataFrame:
    """Rows of keys without a blocker: one holds up the whole job."""
    return rows.join(issues.where("severity = 'blocker'").select(key).distinct(), key, "left_anti")
