"""Lookups in masters of countries, parties and products, and the parsing of a party master."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codes import state_stem
from ..functions.text import branch_for_export, cell_value, clean, party_cell, party_key, plain_key, trigrams

def country_codes(rows: DataFrame, text: str, countries: DataFrame) -> DataFrame:
    """rows with ``iso2`` of the country that ``text`` names or codes; null if none.

    countries: iso2, iso3, name, aliases. Tried in order: a code of two letters,
    which is final, a code of three, the name or an alias, the same without a
    leading article, the name without the form of the state. All ways become
    (rank, key) rows of one equi-join; the first hit counts.
    """
    index = countries.select("iso2", F.explode(F.array(F.struct(F.lit("2").alias("how"), F.col("iso2").alias("key")), F.struct(F.lit("3").alias("how"), F.col("iso3").alias("key")))).alias("k")).unionByName(
        countries.select("iso2", F.explode(F.transform(F.concat(F.array("name"), F.coalesce("aliases", F.array().cast("array<string>"))), lambda n: F.struct(F.lit("n").alias("how"), plain_key(n).alias("key")))).alias("k"))
    )
    index = index.select("k.how", "k.key", "iso2").where("key is not null").groupBy("how", "key").agg(F.min("iso2").alias("iso2"))
    asked = rows.select(text).distinct()
    raw, key = F.trim(text), plain_key(F.col(text))
    bare = F.regexp_replace(key, "^THE ", "")
    two = raw.rlike("^[A-Za-z]{2}$")
    ways = [(0, "2", F.when(two, F.upper(raw))), (1, "3", F.when(raw.rlike("^[A-Za-z]{3}$"), F.upper(raw))), (2, "n", F.when(~two, key)), (3, "n", F.when(~two, bare)), (4, "n", F.when(~two, state_stem(bare)))]
    tried = asked.select(text, F.explode(F.array(*[F.struct(F.lit(r).alias("rank"), F.lit(h).alias("how"), k.alias("key")) for r, h, k in ways])).alias("w")).select(text, "w.*").where("key != ''")
    found = tried.join(index, ["how", "key"]).groupBy(text).agg(F.min_by("iso2", "rank").alias("iso2"))
    return rows.join(found, text, "left")


def country_of_address(rows: DataFrame, key: str, address: str, countries: DataFrame) -> DataFrame:
    """rows with ``iso2`` of the last part of the address, by comma or line, that names a country."""
    parts = rows.select(key, F.posexplode(F.split(address, "[,\n]")).alias("pos", "part")).where(F.trim("part") != "")
    found = country_codes(parts, "part", countries).where("iso2 is not null").groupBy(key).agg(F.max_by("iso2", "pos").alias("iso2"))
    return rows.join(found, key, "left")


def party_search(parties: DataFrame, query: str | None, role: str | None = None, limit: int | None = None, least: float = 0.3) -> DataFrame:
    """Active parties that resemble or contain the query, of one role if stated, the most similar first; at most ``limit`` (20 unless stated, 1 to 200).

    A blank query lets all pass. Scores are column expressions over one scan; the
    limit is a top-k in each task.
    """
    asked = (query or "").strip()
    grams = trigrams(F.lower("name"))
    wanted = trigrams(F.lit(asked.lower()))
    both = F.size(F.array_intersect(grams, wanted))
    sim = F.floor(both * 10000 / (F.size(grams) + F.size(wanted) - both)).cast("bigint") if asked else F.lit(0).cast("bigint")
    fits = (F.col("sim") >= int(least * 10000)) | F.lower("name").contains(asked.lower()) | F.col("name_key").contains(asked.upper()) if asked else F.lit(True)
    out = parties.where("is_active").withColumn("sim", sim)
    out = out.where(fits if role is None else fits & F.col(f"is_{role}"))
    return out.orderBy(F.desc("sim"), "name", "branch").limit(max(1, min(20 if limit is None else limit, 200)))


def merged_duplicates(rows: DataFrame, key: str, order: str, flags: list[str], values: list[str], raw: str) -> DataFrame:
    """One row a key: flags that any row has, the first value that isn't null by ``order``, maps united with the first row's entries winning."""
    first = [F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in values]
    maps = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order), F.map_entries(raw).alias("e")))), lambda x: F.map_from_entries(x["e"]))
    united = F.aggregate(maps, F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")), lambda acc, m: F.map_concat(acc, F.map_filter(m, lambda k, v: ~F.map_contains_key(acc, k))))
    return rows.groupBy(key).agg(F.count("*").alias("n_rows"), *[F.bool_or(f).alias(f) for f in flags], *first, united.alias(raw))


def party_rows(cells: DataFrame, order: str, countries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of a party master's cells name, branch, country, gstin: names without quotes, placeholders null, countries coded; rows without a name are rejected, repeated (name, branch) merged."""
    read = cells.select(order, party_cell(F.col("name")).alias("name"), branch_for_export(F.col("branch")).alias("branch"), cell_value(F.col("country")).alias("country"), cell_value(F.col("gstin")).alias("gstin"), F.create_map(F.lit("name"), F.col("name"), F.lit("branch"), F.col("branch")).alias("raw"))
    rejects = read.where("name is null").select(order, F.lit("no name").alias("reason"))
    coded = country_codes(read.where("name is not null"), "country", countries)
    keyed = coded.withColumn("name_key", party_key(F.col("name"))).withColumn("key", F.concat_ws("|", "name_key", F.coalesce(F.upper("branch"), F.lit(""))))
    return merged_duplicates(keyed, "key", order, [], ["name", "branch", "country", "iso2", "gstin", "name_key"], "raw"), rejects


def certificate_products(items: DataFrame, products: DataFrame, key: list[str], order: str) -> DataFrame:
    """Items of a job with the first product of its certificates that has their batch, or code or description in their description, or their first 25 characters in its own."""
    joined = items.join(products, "job")
    code = F.upper(F.coalesce("product_code", "product_description"))
    text = F.upper("description")
    fits = F.coalesce(F.col("batch") == F.col("product_batch"), F.lit(False)) | F.contains(text, code) | F.contains(F.upper("product_description"), F.substring(text, 1, 25))
    return joined.where(fits).withColumn("__k", F.row_number().over(Window.partitionBy("job", *key).orderBy(order))).where("__k = 1").drop("__k")


def with_needs(entries: DataFrame, conditions: DataFrame, key: str, kind: str = "igcr") -> DataFrame:
    """(key, needs): whether any condition that an entry cites (array ``cited``) is of the kind."""
    cited = entries.select(key, F.explode("cited").alias("no"))
    hit = cited.join(conditions.where(F.array_contains("kinds", kind)).select("no"), "no", "left_semi").select(key).distinct()
    return entries.select(key).join(hit.withColumn("needs", F.lit(True)), key, "left").select(key, F.coalesce("needs", F.lit(False)).alias("needs"))


#: What the name of a custom house tells of its mode; the first that fits counts.
MODES = [
    ("air", r"\bACC\b|AIR CARGO|\bAIRPORT\b|\bAIR\b"),
    ("icd", r"\bICD\b|\bCFS\b|\bDRY PORT\b|\bINLAND\b"),
    ("sea", r"\bSEA\b|\bPORT\b|\bHARBOU?R\b|\bDOCK\b|\bJETTY\b|\bWHARF\b"),
    ("land", r"\bLCS\b|\bLAND\b|\bBORDER\b|\bRAIL\b"),
    ("sez", r"\bSEZ\b|\bEPZ\b|\bFTZ\b"),
]


def custom_house_master(rows: DataFrame, order: str) -> DataFrame:
    """(code, edi_code, name, mode, email) of rows (name, unece, edi, email): those with a name and a code of six letters or digits, the first of each code in the stated order; mode is null if the name tells none."""
    tidy = lambda c: clean(F.coalesce(c, F.lit("")))
    read = rows.select(F.upper(tidy("unece")).alias("code"), F.upper(tidy("edi")).alias("edi_code"), tidy("name").alias("name"), F.lower(tidy("email")).alias("email"), F.col(order).alias("__at"))
    first = read.where("name <> '' AND code RLIKE '^[A-Z0-9]{6}$'").groupBy("code").agg(F.min_by(F.struct("edi_code", "name", "email"), "__at").alias("h"))
    mode = F.coalesce(*[F.when(F.upper("h.name").rlike(pattern), kind) for kind, pattern in MODES])
    return first.select("code", "h.edi_code", "h.name", mode.alias("mode"), "h.email")
