"""Amending notifications, from their text to the entries they leave: numbered instructions, clauses, forms, and a replay in the order of issue.

An edit is applied only where the words that it replaces stand at that moment; what
can't be applied is a reject, and what only a person can read marks its entry stale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import squeezed
from ..storage import stored
from .decisions import classified, clauses

#: How a numbered instruction begins, where the text of a notification without numbers begins, and forms that are applied.
MARKER = r"\(([0-9]{1,3})\)\s+(?=against|S\. ?No|in |after|for )"
OPENING = "G.S.R"
APPLIED = ("sunset", "omit", "rate")
#: The table that all amendments so far edit.
TABLE = "I"


def numbered(notices: DataFrame) -> DataFrame:
    """(notification, day, position, text): the instructions of notices (notification, day, text).

    An instruction reaches from its marker to the next one; a notification without
    markers is one instruction from its opening on. Markers must count 1..n,
    else one may have been read as part of its neighbour: the whole notification
    is one row without position and text then. A null or empty text has no instruction.
    """
    flat = notices.select("notification", "day", squeezed(F.coalesce("text", F.lit(""))).alias("t"))
    marks = F.transform(F.regexp_extract_all("t", F.lit(MARKER), F.lit(1)), lambda n: n.cast("int"))
    own = F.filter(F.split("t", f"(?={MARKER})"), lambda p: p.rlike(f"^{MARKER}"))
    opening = F.when(F.instr("t", OPENING) > 0, F.substring(F.col("t"), F.instr("t", OPENING), F.length("t"))).otherwise(F.col("t"))
    cut = flat.withColumn("marks", marks).withColumn("parts", F.when(F.size("marks") > 0, own).when(F.col("t") != "", F.array(opening)).otherwise(F.array().cast("array<string>")))
    in_order = (F.size("marks") == 0) | (F.col("marks") == F.sequence(F.lit(1), F.greatest(F.size("marks"), F.lit(1))))
    parts = cut.select("notification", "day", F.posexplode(F.when(in_order, F.col("parts")).otherwise(F.array(F.lit(None).cast("string")))).alias("p", "text"))
    return parts.select("notification", "day", F.when(F.col("text").isNotNull(), F.col("p") + 1).alias("position"), F.trim("text").alias("text"))


def read(notices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edits, rejects): each lettered clause of each instruction by its form, with named parts; a clause of no known form is a reject.

    Texts are read once: what they hold is stored, and edits and rejects are taken from there.
    """
    keyed = numbered(notices).withColumn("key", F.struct("notification", "day", "position"))
    found = stored(classified(clauses(keyed, "key", "text").select("key.*", "k", "clause"), "clause").drop("clause"))
    misread = F.col("position").isNull()
    bad = found.where("kind IS NULL").select("notification", "position", F.when(~misread, F.col("k")).alias("k"), F.when(misread, "misnumbered").otherwise("no_form").alias("reason"))
    return found.where("kind IS NOT NULL"), bad


def _replaced(text: Column, old: Column, new: Column, every: Column) -> Column:
    at = F.instr(text, old)
    first = F.concat(F.substring(text, F.lit(1), at - 1), new, F.substring(text, at + F.length(old), F.length(text)))
    return F.when(every, F.replace(text, old, new)).otherwise(first)


def replayed(entries: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) after the edits in the order of day, notification, position and clause.

    entries: serial, description, rate_text. A sunset replaces its words wherever
    the description has them, a rate its first occurrence or, at both places, all;
    both fail if the words aren't there. An omitted entry stays, with what omitted
    it, and later edits still meet it. Other kinds with a serial make the entry
    stale; lists and pages name no serial and touch none. An applied kind whose
    serial has no entry is a reject. The edits of an entry meet in one array,
    bounded by how often it was amended.
    """
    named = edits.where("serial is not null")
    step_fields = ["day", "notification", "position", "k", "kind", "old", "new", "both"]
    ordered = named.groupBy("serial").agg(F.array_sort(F.collect_list(F.struct(*step_fields))).alias("steps"))
    none = F.array().cast("array<string>")
    no_bad = F.array().cast("array<struct<notification:string,position:int,k:int>>")
    start = F.struct(F.col("description").alias("description"), F.col("rate_text").alias("rate_text"), F.lit(None).cast("string").alias("omitted_by"), none.alias("amended_by"), none.alias("stale_by"), no_bad.alias("bad"))

    def step(acc: Column, e: Column) -> Column:
        kind = e["kind"]
        there = F.when(kind == "sunset", F.contains(acc["description"], e["old"])).when(kind == "rate", F.contains(acc["rate_text"], e["old"])).otherwise(True)
        there = F.coalesce(there, F.lit(False))
        name = F.concat(e["notification"], F.lit(" ("), kind, F.lit(")"))
        edit = kind.isin("sunset", "rate")
        return F.struct(
            F.when((kind == "sunset") & there, F.replace(acc["description"], e["old"], e["new"])).otherwise(acc["description"]).alias("description"),
            F.when((kind == "rate") & there, _replaced(acc["rate_text"], e["old"], e["new"], e["both"])).otherwise(acc["rate_text"]).alias("rate_text"),
            F.when(kind == "omit", e["notification"]).otherwise(acc["omitted_by"]).alias("omitted_by"),
            F.when(edit & there, F.array_append(acc["amended_by"], name)).otherwise(acc["amended_by"]).alias("amended_by"),
            F.when(~kind.isin(*APPLIED), F.array_append(acc["stale_by"], name)).otherwise(acc["stale_by"]).alias("stale_by"),
            F.when(edit & ~there, F.array_append(acc["bad"], F.struct(e["notification"].alias("notification"), e["position"].alias("position"), e["k"].alias("k")))).otherwise(acc["bad"]).alias("bad"),
        )

    done = entries.join(ordered, "serial", "left").withColumn("s", F.when(F.col("steps").isNull(), start).otherwise(F.aggregate("steps", start, step)))
    kept = [c for c in entries.columns if c not in ("serial", "description", "rate_text")]
    out = done.select("serial", *kept, *[F.col(f"s.{c}").alias(c) for c in ("description", "rate_text", "omitted_by", "amended_by", "stale_by")])
    absent = done.select(F.explode("s.bad").alias("b")).select("b.*", F.lit("old_absent").alias("reason"))
    lost = named.where(F.col("kind").isin(*APPLIED)).join(entries.select("serial"), "serial", "left_anti").select("notification", "position", "k", F.lit("unknown_serial").alias("reason"))
    return out, absent.unionByName(lost)


def amend(entries: DataFrame, notices: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) from the text of the notices; entries of other tables (column ``table``) stay as they are."""
    edits, unread = read(notices)
    out, failed = replayed(entries.where(F.col("table") == TABLE), edits)
    others = entries.where(F.col("table") != TABLE)
    for c, kind in (("omitted_by", "string"), ("amended_by", "array<string>"), ("stale_by", "array<string>")):
        others = others.withColumn(c, F.array().cast(kind) if kind != "string" else F.lit(None).cast(kind))
    return out.unionByName(others), unread.unionByName(failed)
