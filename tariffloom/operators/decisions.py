"""State machines, decision tables for messages and uploads, flags, and readings of amendment texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Each status and those it may be entered from.
DELIVERY_ORDER = {
    "documents": ("open",),
    "invoice": ("documents",),
    "payment": ("documents", "invoice"),
    "awaiting_do": ("documents", "invoice", "payment"),
    "do_received": ("documents", "invoice", "payment", "awaiting_do"),
    "delivered": ("do_received",),
    "closed": ("delivered",),
}
CLEARANCE = {
    "passing": ("noting",),
    "duty_payment": ("noting", "passing", "duty_variance"),
    "duty_variance": ("passing", "duty_payment"),
    "goods_registration": ("passing", "duty_payment"),
    "examination": ("goods_registration",),
    "out_of_charge": ("goods_registration", "examination"),
    "delivery_planning": ("goods_registration", "examination", "out_of_charge"),
    "delivered": ("delivery_planning",),
}
JOB = {
    "documents_received": ("new", "documents_received"),
    "exported": ("new", "documents_received"),
    "scrutiny": ("new", "documents_received", "exported", "checklist_revision", "noting"),
    "awaiting_shipper": ("scrutiny", "awaiting_shipper"),
    "checklist_revision": ("scrutiny", "awaiting_shipper"),
    "noting": ("scrutiny", "awaiting_shipper"),
    "closed": ("noting",),
}


def moves(machine: dict[str, tuple[str, ...]]) -> dict[tuple[str, str], str]:
    """(state, wanted status) to the status; other wishes change nothing."""
    return {(state, to): to for to, states in machine.items() for state in states}


def guarded(status: Column, to: str, machine: dict[str, tuple[str, ...]]) -> Column:
    """One guarded update: the new status where the present one allows it."""
    return F.when(status.isin(*machine[to]), F.lit(to)).otherwise(status)


def message_outcomes(messages: DataFrame) -> DataFrame:
    """Adds outcome, skip_reason and target to messages with n_attachments, n_recognised, decision and job: an ambiguous match goes to a person, one without match opens a job only for recognised documents."""
    n = F.col
    reason = (
        F.when(n("n_attachments") == 0, "no_attachments")
        .when(n("decision") == "ambiguous", "ambiguous_match")
        .when((n("decision") == "none") & (n("n_recognised") == 0), "no_recognised_documents")
    )
    outcome = F.when(reason.isNotNull(), "skipped").when(n("job").isNotNull(), "attached").otherwise("created")
    return messages.withColumn("skip_reason", reason).withColumn("outcome", outcome).withColumn("target", F.when(outcome == "attached", n("job")))


def upload_outcomes(uploads: DataFrame, stored: DataFrame) -> DataFrame:
    """(upload, outcome, target) of uploads (upload, decision, job, digests): matched ones attach; else, if all digests are stored, they go to the one job that owns them, or are ambiguous if several do; else a job is created.

    stored: (digest, owner). Digests meet owners in one equi-join.
    """
    owned = uploads.select("upload", F.explode(F.array_distinct("digests")).alias("digest")).join(stored.dropDuplicates(["digest"]), "digest", "left")
    known = owned.groupBy("upload").agg((F.count("*") == F.count("owner")).alias("all"), F.count_distinct("owner").alias("owners"), F.min("owner").alias("owner"))
    joined = uploads.join(known, "upload", "left")
    again = F.col("job").isNull() & F.coalesce("all", F.lit(False))
    outcome = (
        F.when(F.coalesce(F.size("digests"), F.lit(0)) == 0, "empty")
        .when(F.col("decision") == "ambiguous", "ambiguous")
        .when(F.col("job").isNotNull() | (again & (F.col("owners") == 1)), "attached")
        .when(again, "ambiguous")
        .otherwise("created")
    )
    return joined.select("upload", outcome.alias("outcome"), F.when(outcome == "attached", F.coalesce("job", F.when(again, F.col("owner")))).alias("target"))


def without_path(flags: Column, path: Column, severity: str | None = None) -> Column:
    """Flags without those of a path, and of a severity if stated."""
    hit = lambda f: (f["path"] == path) & (F.lit(True) if severity is None else f["severity"] == severity)
    return F.filter(flags, lambda f: ~hit(f))


def with_flag(flags: Column, severity: str, path: Column, code: str) -> Column:
    return F.array_append(flags, F.struct(F.lit(severity).alias("severity"), path.alias("path"), F.lit(code).alias("code")))


def proposed(items: DataFrame, proposals: DataFrame, key: str) -> DataFrame:
    """Items with a blocking flag on their code take a proposal: a missing code if the proposed one has eight digits, a rate where it is 0; the error becomes a warning. Others stay."""
    joined = items.join(proposals.select(key, "proposed_code", "proposed_rate"), key, "left")
    path = F.lit("ritc")
    use = F.exists("flags", lambda f: (f["severity"] == "error") & (f["path"] == path)) & F.col("proposed_code").isNotNull()
    code = F.when(use & (F.coalesce("ritc", F.lit("")) == "") & (F.length("proposed_code") == 8), F.col("proposed_code")).otherwise(F.col("ritc"))
    rate = F.when(use & (F.col("bcd_rate") == 0) & F.col("proposed_rate").isNotNull(), F.col("proposed_rate")).otherwise(F.col("bcd_rate"))
    flags = F.when(use, with_flag(without_path(F.col("flags"), path, "error"), "warning", path, "library_proposal")).otherwise(F.col("flags"))
    return joined.select(key, code.alias("ritc"), rate.alias("bcd_rate"), flags.alias("flags"))


def general_description(stated: Column, general: Column, proposal: Column, most: int = 80) -> Column:
    """A proposed description if it is short, no longer than the stated one, and says something new."""
    good = (proposal != "") & (F.length(proposal) <= most) & (F.length(proposal) <= F.length(stated)) & (proposal != stated) & ~proposal.eqNullSafe(general)
    return F.when(F.coalesce(good, F.lit(False)), proposal).otherwise(general)


#: Rates, conditions and labels of stacked end uses.
RATES = r"(?i)(Nil|Free|[0-9]+(?:\.[0-9]+)?%)"
SLOTS = r"([0-9]+(?:\s+and\s+[0-9]+)*|-)"
LABELS = r"(?i)\((i|ii|iii|iv|v|vi|vii|viii|ix|x)\)\s*"


def sub_entries(entries: DataFrame, key: str) -> DataFrame:
    """(key, k, label, text, rate, conditions) of entries that stack several end uses; none if rates, labels and conditions don't tally.

    entries: description, rate_text, condition_cell. A dash is a use without
    condition; what follows a proviso isn't of the last use.
    """
    described = F.get(F.split("description", r"\bProvided that\b"), F.lit(0))
    rates, slots = F.regexp_extract_all(F.coalesce("rate_text", F.lit("")), F.lit(RATES), F.lit(1)), F.regexp_extract_all(F.coalesce("condition_cell", F.lit("")), F.lit(SLOTS), F.lit(1))
    labels = F.transform(F.regexp_extract_all(described, F.lit(LABELS), F.lit(1)), lambda x: F.lower(x))
    texts = F.transform(F.slice(F.split(described, LABELS), 2, 1000), lambda x: F.regexp_replace(x, r"^[ ;.\-]+|[ ;.\-]+$", ""))
    cut = entries.select(key, rates.alias("rates"), slots.alias("slots"), labels.alias("labels"), texts.alias("texts"))
    tally = (F.size("rates") >= 2) & (F.size("labels") == F.size("rates")) & ((F.size("slots") == 0) | (F.size("slots") == F.size("rates")))
    rows = cut.where(tally).select(key, "slots", F.posexplode(F.arrays_zip("labels", "texts", "rates")).alias("k", "x"))
    value = F.when(F.lower("x.rates").isin("nil", "free"), F.lit("0")).otherwise(F.regexp_replace("x.rates", "%", "")).try_cast("decimal(8,3)")
    cited = F.coalesce(F.regexp_extract_all(F.get("slots", F.col("k")), F.lit("([0-9]+)"), F.lit(1)), F.array().cast("array<string>"))
    return rows.select(key, "k", F.col("x.labels").alias("label"), F.col("x.texts").alias("text"), value.alias("rate"), cited.alias("conditions"))


#: Forms of amending instructions, in the order in which they are tried, with the names of their groups.
INSTRUCTIONS = [
    (
        "sunset",
        r"against S\. ?No\. ([0-9]+[A-Z]?), in column \(3\), in the proviso, for the figures, letters and word\s*[“\"‘']([^”\"’']+)[”\"’'], the figures, letters and word\s*[“\"‘']([^”\"’']+)[”\"’']",
        ("serial", "old", "new"),
    ),
    ("omit", r"S\. ?No\. ([0-9]+[A-Z]?) and the entries relating thereto shall be omitted", ("serial",)),
    (
        "rate",
        r"against S\. ?No\. ([0-9]+[A-Z]?), in column \(4\), for the entry\s*[“\"‘']([^”\"’']+)[”\"’'](, at both the places)?, the entry\s*[“\"‘']([^”\"’']+)[”\"’']",
        ("serial", "old", "both", "new"),
    ),
    ("insert", r"after S\. ?No\. ([0-9]+[A-Z]?) and the entries relating thereto, the following", ("serial",)),
    ("replace", r"for S\. ?No\. ([0-9]+[A-Z]?) and the entries relating thereto, the following", ("serial",)),
    ("column3", r"against S\. ?No\. ([0-9]+[A-Z]?), in column \(3\),(?! in the proviso)", ("serial",)),
    ("condition", r"against S\. ?No\. ([0-9]+[A-Z]?), in column \((?:5|6|7)\)", ("serial",)),
    ("list", r"in the LISTS appended to TABLE\s*(\w+), in List ([0-9]+)", ("table", "list")),
    ("page", r"at page ([0-9]+),?\s*-?\s*in lines? ([0-9 and,]+)", ("page", "lines")),
]
#: Names of the parts that a form can have; ``both`` is whether an edit is of both places.
PARTS = ("serial", "old", "new", "table", "list", "page", "lines")
#: An instruction with lettered clauses.
COMPOUND = r"S\. ?No\. ([0-9]+[A-Z]?),\s*-\s*(?=\(a\))"


def clauses(instructions: DataFrame, key: str, text: str) -> DataFrame:
    """(key, k, clause): an instruction, or each of its lettered clauses restated with its serial."""
    head = F.regexp_extract(text, COMPOUND, 1)
    tail = F.get(F.split(text, COMPOUND, 2), F.lit(1))
    parts = F.filter(F.transform(F.split(tail, r"\([a-z]\)\s+"), lambda p: F.trim(p)), lambda p: p != "")
    each = F.when(head != "", F.transform(parts, lambda p: F.concat(F.lit("against S. No. "), head, F.lit(", "), p))).otherwise(F.array(F.col(text)))
    return instructions.select(key, F.posexplode(each).alias("k", "clause"))


def classified(rows: DataFrame, text: str) -> DataFrame:
    """rows with kind and the named parts of the first form that the text has, null where a form has none; a null kind is for a person."""
    kind = F.coalesce(*[F.when(F.col(text).rlike(f"(?i){p}"), k) for k, p, _ in INSTRUCTIONS])
    out = rows.withColumn("kind", kind)

    def part(name: str) -> Column:
        found = [F.when(F.col("kind") == k, F.regexp_extract(text, f"(?i){p}", names.index(name) + 1)) for k, p, names in INSTRUCTIONS if name in names]
        return F.nullif(F.coalesce(*found), F.lit(""))

    out = out.withColumns({name: part(name) for name in PARTS} | {"both": F.coalesce(part("both").isNotNull(), F.lit(False))})
    return out.withColumn("lines", F.regexp_replace("lines", "[, ]+$", ""))


def united_codes(rows: DataFrame, key: str, order: str, codes: str) -> DataFrame:
    """(key, codes): all codes of a key's rows, each once, in the order of first mention; rows only ever add codes."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(codes).alias("c"))))
    return rows.groupBy(key).agg(F.array_distinct(F.flatten(F.transform(listed, lambda x: x["c"]))).alias("codes"))
