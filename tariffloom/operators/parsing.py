"""Line-oriented and mini-language parsing, with Spark's string and array functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line), pos from 0."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("pos", "line"))


def triples(rows: DataFrame, key: str, code: str) -> DataFrame:
    """Three lines in a row of which the second is a code: (key, pos, name, code, place); after a hit the search goes on behind its three lines.

    The hits of a text meet in one array, which its own length bounds.
    """
    w = Window.partitionBy(key).orderBy("pos")
    seen = rows.withColumn("second", F.lead("line", 1).over(w)).withColumn("third", F.lead("line", 2).over(w))
    hits = seen.where(F.col("second").rlike(code) & F.col("third").isNotNull()).select(key, F.struct("pos", F.col("line").alias("name"), F.col("second").alias("code"), F.col("third").alias("place")).alias("h"))
    listed = hits.groupBy(key).agg(F.array_sort(F.collect_list("h")).alias("h")).withColumn("none", F.slice("h", 1, 0))
    apart = F.aggregate("h", F.col("none"), lambda acc, h: F.when((F.size(acc) == 0) | (h["pos"] >= F.element_at(acc, -1)["pos"] + 3), F.array_append(acc, h)).otherwise(acc))
    return listed.select(key, F.explode(apart).alias("h")).select(key, "h.*")


def folded(rows: DataFrame, key: str, starts: Column) -> DataFrame:
    """Rows that start an entry with the rows that continue it: (key, entry, pos, text, n)."""
    w = Window.partitionBy(key).orderBy("pos")
    grouped = rows.withColumn("entry", F.sum(starts.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where("entry > 0")
    joined = grouped.groupBy(key, "entry").agg(F.min("pos").alias("pos"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("x"), F.count("*").alias("n"))
    return joined.select(key, F.col("entry").cast("int").alias("entry"), "pos", F.array_join(F.transform("x", lambda r: r["line"]), " ").alias("text"), "n")


def under_headings(rows: DataFrame, key: str, is_heading: Column) -> DataFrame:
    """Rows that are no heading, with the last heading above."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("heading", F.last(F.when(is_heading, F.col("line")), ignorenulls=True).over(w)).where(~is_heading)


def serial_gaps(rows: DataFrame, key: str, serial: str) -> DataFrame:
    """(key, serial, problem): serials missing between one and the largest, and repeated ones."""
    counts = rows.groupBy(key, serial).agg(F.count("*").alias("n"))
    want = rows.groupBy(key).agg(F.max(serial).alias("top")).select(key, F.explode(F.sequence(F.lit(1).cast("long"), F.col("top").cast("long"))).alias(serial))
    missing = want.join(counts, [key, serial], "left_anti").select(key, serial, F.lit("missing").alias("problem"))
    return missing.unionByName(counts.where("n > 1").select(key, serial, F.lit("repeated").alias("problem")))


def _codes(text: Column) -> tuple[Column, Column]:
    """The codes of a list separated by commas, ``or`` and ``and``, ranges expanded; and the tokens that can't be read."""
    marked = F.regexp_replace(text, r"(?i)(?<![a-z])(?:or|and)(?![a-z])", ",")
    tokens = F.filter(F.transform(F.split(marked, ","), lambda t: F.regexp_replace(F.trim(t), r"^[.;:]+|[.;:]+$", "")), lambda t: t != "")

    def read(t: Column) -> Column:
        digits = F.regexp_replace(t, " ", "")
        low = F.regexp_replace(F.regexp_extract(t, r"^([0-9][0-9 ]*?)\s*(?i:to)\s*[0-9][0-9 ]*$", 1), " ", "")
        high = F.regexp_replace(F.regexp_extract(t, r"^[0-9][0-9 ]*?\s*(?i:to)\s*([0-9][0-9 ]*)$", 1), " ", "")
        span = (F.length(low) == F.length(high)) & F.length(low).isin(4, 6) & (low <= high)
        between = F.when(span, F.transform(F.sequence(low.try_cast("int"), high.try_cast("int")), lambda i: F.lpad(i.cast("string"), F.length(low), F.lit("0"))))
        whole = t.rlike("^[0-9 ]+$") & F.length(digits).isin(2, 4, 6, 8)
        glued = t.rlike("^[0-9 ]+$") & (F.length(digits) > 8) & (F.length(digits) % 8 == 0)
        return F.when(span, between).when(whole, F.array(digits)).when(glued, F.regexp_extract_all(digits, F.lit("([0-9]{8})"), F.lit(1)))

    return F.flatten(F.array_compact(F.transform(tokens, read))), F.filter(tokens, lambda t: read(t).isNull())


#: How a description of codes excludes some, and names any chapter.
EXCLUSION = r"(?i)[\[(]\s*(?:other than|except)\s*([^\])]*)(?:[\])]|$)"
ANY_CHAPTER = r"(?i)\bany\s+(?:other\s+)?chapter\b"


def tariff_spec(specs: DataFrame, spec: str) -> DataFrame:
    """specs with include, exclude, any_chapter and unread of a specification in the schedule's mini-language."""
    body = F.regexp_replace(spec, EXCLUSION, " ")
    out = specs.withColumn("__out", F.array_join(F.regexp_extract_all(spec, F.lit(EXCLUSION), F.lit(1)), ",")).withColumn("any_chapter", body.rlike(ANY_CHAPTER))
    out = out.withColumn("__in", F.regexp_replace(F.regexp_replace(F.regexp_replace(body, ANY_CHAPTER, " "), r"(?i)\bchapters?\b", " "), r"[\[(].*?[\])]", " "))
    include, unread = _codes(F.col("__in"))
    exclude, bad = _codes(F.col("__out"))
    return out.withColumn("include", F.array_distinct(include)).withColumn("exclude", F.array_distinct(exclude)).withColumn("unread", F.concat(bad, unread)).drop("__in", "__out")


#: Kinds of condition and what their texts say, in order; a text may be of several.
CONDITIONS = [
    ("igcr", r"Import of Goods at Concessional Rate of Duty"),
    ("bond", r"execution of (?:a )?bond|bond, in such form|binds himself"),
    ("bank-guarantee", r"bank guarantee|fixed deposit receipt"),
    ("certificate", r"furnishes? (?:in all cases )?a certificate|produces? (?:a )?certificate|certificate (?:is )?(?:issued|from|to the effect)|certified by"),
    ("registration", r"registered with|is an establishment registered|registration certificate"),
    ("export-obligation", r"are exported by the importer within|export obligation|re-export"),
    ("end-use-declaration", r"gives? (?:a )?(?:declaration|an undertaking)|declares? that|undertaking to (?:the effect|pay)"),
    ("importer-type", r"imported into India by the Ministry|by the Defence|imported by a|imported by the Government|by a sports person|by an? (?:exporter|operator|hospital|institution)"),
    ("quantity-value-cap", r"shall not exceed|quantity of import does not exceed"),
    ("contract-registration", r"contracts? registered"),
    ("time-limit", r"within (?:six|three|nine|twelve|one|two)\s+(?:months?|years?)|within \d+ (?:days|months|years)"),
    ("payment-mode", r"convertible foreign currency"),
    ("direct-shipment", r"directly shipped from the country"),
]


def condition_kinds(text: Column) -> Column:
    found = F.array_compact(F.array(*[F.when(text.rlike(f"(?i){p}"), k) for k, p in CONDITIONS]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("other")))


def cited(cell: Column) -> Column:
    """Numbers in a cell, in order, each once."""
    return F.array_distinct(F.regexp_extract_all(cell, F.lit("([0-9]+)"), F.lit(1)))


def amended(entries: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Entries after their amendments in the order of issue.

    changes: key, seq, action (omit, rate, sunset or other), value. ``omit``
    deletes, ``rate`` and ``sunset`` set a value; others only mark the entry as
    stale. An entry's changes meet in one array, bounded by how often it was
    amended.
    """
    ordered = changes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "action", "value"))).alias("c"))
    start = F.struct(F.col("rate").cast("string").alias("rate"), F.lit(None).cast("string").alias("until"), F.lit(False).alias("omitted"), F.lit(False).alias("stale"))
    step = lambda acc, c: F.struct(
        F.when(c["action"] == "rate", c["value"]).otherwise(acc["rate"]).alias("rate"),
        F.when(c["action"] == "sunset", c["value"]).otherwise(acc["until"]).alias("until"),
        (acc["omitted"] | (c["action"] == "omit")).alias("omitted"),
        (acc["stale"] | ~c["action"].isin("omit", "rate", "sunset")).alias("stale"),
    )
    joined = entries.join(ordered, key, "left").withColumn("s", F.when(F.col("c").isNull(), start).otherwise(F.aggregate("c", start, step)))
    return joined.where(~F.col("s.omitted")).select(key, F.col("s.rate").alias("rate"), F.col("s.until").alias("until"), F.col("s.stale").alias("stale"))


def asserted(entries: DataFrame, changes: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) after changes (key, seq, old, new) in order: each applies only if the entry's rate is ``old`` at that point; others are rejects (key, seq).

    An entry's changes meet in one array, bounded by how often it was amended.
    """
    ordered = changes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", "old", "new"))).alias("c"))
    start = F.struct(F.col("rate").alias("rate"), F.array().cast("array<int>").alias("bad"))
    step = lambda acc, c: F.struct(F.when(acc["rate"] == c["old"], c["new"]).otherwise(acc["rate"]).alias("rate"), F.when(acc["rate"] == c["old"], acc["bad"]).otherwise(F.array_append(acc["bad"], c["seq"])).alias("bad"))
    done = entries.join(ordered, key, "left").withColumn("s", F.when(F.col("c").isNull(), start).otherwise(F.aggregate("c", start, step)))
    return done.select(key, F.col("s.rate").alias("rate")), done.select(key, F.explode("s.bad").alias("seq"))


def chunked(docs: DataFrame, key: str, text: str, size: int = 3500, overlap: int = 200, least: int = 40) -> DataFrame:
    """(key, chunk, text): windows over text with white space collapsed; the last one reaches the end; short texts have none."""
    flat = docs.select(key, F.trim(F.regexp_replace(text, r"\s+", " ")).alias("t")).where(F.length("t") >= least)
    step = size - overlap
    count = F.greatest(F.lit(1), F.ceil((F.length("t") - overlap) / step)).cast("int")
    return flat.select(key, "t", F.explode(F.sequence(F.lit(0), count - 1)).alias("chunk")).select(key, "chunk", F.substring(F.col("t"), F.col("chunk") * step + 1, F.lit(size)).alias("text"))
