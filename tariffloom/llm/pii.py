"""Personal data in texts, with DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards,
modulo 97 for IBANs), and words in the context before a span adjust its score;
spans below the least score are dropped. A span's place comes from the pieces
that ``split`` leaves between the matches, so no Python sees a text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import table

LOCAL = r"[A-Za-z0-9._%+-]"
CONTEXT = 48  # code points before a span in which context words count
LEAST = 0.5


def _always(_: Column) -> Column:
    return F.lit(True)


def _octets(span: Column) -> Column:
    part = r"0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[0-9]{1,2})"
    return span.rlike(rf"^{part}(?:\.{part}){{3}}$")


def luhn(span: Column) -> Column:
    """16 to 19 digits whose Luhn sum is a multiple of ten."""
    digits = F.reverse(F.regexp_replace(span, r"[^0-9]", ""))
    size = F.length(digits)
    doubled = lambda i: F.substring(digits, i, F.lit(1)).cast("int") * (2 - i % 2)
    total = F.aggregate(F.sequence(F.lit(1), size), F.lit(0), lambda acc, i: acc + doubled(i) - F.when(doubled(i) > 9, 9).otherwise(0))
    return F.when(size.between(16, 19), total % 10 == 0).otherwise(False)


def _phone(span: Column) -> Column:
    return F.length(F.regexp_replace(span, r"[^0-9]", "")).between(8, 15)


def mod97(span: Column) -> Column:
    """An IBAN's check: the first four characters go last, letters count 10 to 35, the number modulo 97 is 1."""
    bare = F.regexp_replace(span, " ", "")
    turned = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    left = F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), lambda acc, i: (acc * F.when(value(F.substring(turned, i, F.lit(1))) > 9, 100).otherwise(10) + value(F.substring(turned, i, F.lit(1)))) % 97)
    return F.length(bare).between(15, 34) & (left == 1)


@dataclass(frozen=True)
class Kind:
    """A kind of personal data. ``hint`` is a cheap test that a text can hold one; quantifiers are possessive, so scans stay linear."""

    name: str
    pattern: str
    confirm: Callable[[Column], Column] = _always
    score: float = 0.6
    context: str = ""
    bonus: float = 0.3
    hint: str = ""


#: In the order in which spans are listed. The first four stay whatever their context; the others need their check or a context word.
KINDS = (
    Kind("email", rf"(?:\G|(?<!{LOCAL})){LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", hint="@", context=r"mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", _octets, hint=".", context=r"\bip\b|address|host|server"),
    Kind("card", r"[0-9]++(?:[\x20-][0-9]++)*+", luhn, context=r"card|visa|master|amex|carte|karte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]", _phone, hint="+", context=r"phone|tel|call|mobile|fax"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", mod97, score=0.5, context=r"iban|account|konto|compte|cuenta"),
    Kind("local_phone", r"(?<![0-9+)(.-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.-])[0-9]{3}[.-][0-9]{4}(?![0-9-])", score=0.3, context=r"phone|tel|call|mobile|fax"),
    Kind("secret", r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}+={0,2}(?![A-Za-z0-9+/_=-])", lambda s: s.rlike("[0-9]") & s.rlike("[A-Za-z]"), score=0.3, context=r"token|secret|passw|api.?key|bearer|credential"),
)


SPANS = "array<struct<kind:string,start:int,end:int,text:string,score:double>>"


def _accepted(k: Kind, least: float) -> Column:
    """The spans of one kind that its check confirms and whose score, with the context, is high enough.

    Matches are taken in order with the pieces between them, which gives their
    places; only accepted spans are kept on the way, so numbers that are no
    card cost nothing but their own check. Ends are exclusive; both in code points.
    """
    pieces, matches = F.col(f"p_{k.name}"), F.col(f"m_{k.name}")
    zero = F.struct(F.lit(0).alias("at"), F.array().cast(SPANS).alias("spans"))

    def add(acc: Column, i: Column) -> Column:
        match = F.get(matches, i)
        start = acc["at"] + F.length(F.get(pieces, i))
        before = F.substring(F.col("t"), F.greatest(start - CONTEXT, F.lit(0)) + 1, F.least(start, F.lit(CONTEXT)))
        score = F.when(F.lower(before).rlike(k.context), k.score + k.bonus).otherwise(F.lit(k.score)).cast("double")
        span = F.struct(F.lit(k.name).alias("kind"), start.alias("start"), (start + F.length(match)).alias("end"), match.alias("text"), score.alias("score"))
        good = k.confirm(match) & (score >= least) if k.score < least else k.confirm(match)
        return F.struct((start + F.length(match)).alias("at"), F.when(good, F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(F.sequence(F.lit(0), F.size(matches) - 1), zero, add)["spans"]


def _framed(docs: DataFrame) -> DataFrame:
    """(row, t): all columns in one struct, so no name can clash, and the text."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), F.coalesce(docs["text"], F.lit("")).alias("t"))


def _found(docs: DataFrame, kinds: tuple[Kind, ...], least: float) -> DataFrame:
    """(row, t, pii)."""
    out = _framed(docs)
    for k in kinds:
        hit = F.col("t").contains(k.hint) if k.hint else F.lit(True)
        out = out.withColumn(f"m_{k.name}", F.when(hit, F.regexp_extract_all("t", F.lit(k.pattern), F.lit(0))))
    for k in kinds:
        some = F.size(F.coalesce(f"m_{k.name}", F.array().cast("array<string>"))) > 0
        out = out.withColumn(f"p_{k.name}", F.when(some, F.split("t", k.pattern, -1)))
    each = [F.when(F.col(f"p_{k.name}").isNotNull(), _accepted(k, least)).otherwise(F.array().cast(SPANS)) for k in kinds]
    return out.select("row", "t", F.concat(*each).alias("pii"))


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, least: float = LEAST) -> DataFrame:
    """docs with a column ``pii``: array<struct<kind, start, end, text, score>> by kind as listed, then start.

    A null text counts as empty and has no spans; whole texts are read. Rows are
    judged alone, so repeated rows are harmless; an empty table gives no rows.
    Other columns pass through, whatever their names, except ``pii``, which is
    replaced. Time grows with the square of the spans kept in one text, not of
    the matches tried.
    """
    found = _found(docs, kinds, least)
    return found.select(*[F.col("row")[c].alias(c) for c in docs.columns if c != "pii"], "pii")


def redact(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS) -> DataFrame:
    """docs with every span of ``find_pii`` replaced by its kind in angle brackets.

    Of overlapping spans the one that starts first is taken, at equal starts the
    longer one; the rest of a cut span goes with it. A null text stays null;
    other columns stay as they are, whatever their names.
    """
    order = F.array_sort(F.transform("pii", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        end = -s["back"]
        piece = F.concat(F.substring(F.col("t"), acc["at"] + 1, s["start"] - acc["at"]), F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.when(s["start"] >= acc["at"], F.array_append(acc["out"], piece)).otherwise(acc["out"]).alias("out"))

    rest = lambda acc: F.concat(F.array_join(acc["out"], ""), F.substring(F.col("t"), acc["at"] + 1, F.length("t")))
    clean = F.when(F.col("row")["text"].isNull() | (F.size("pii") == 0), F.col("row")["text"]).otherwise(F.aggregate("spans", zero, step, rest))
    found = _found(docs, kinds, LEAST).withColumn("spans", order)
    return found.select(*[clean.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


def _listed(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))


def op1_pii(spark, sf_dir: str) -> DataFrame:
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = [k.name for k in KINDS[:4]]
    count = lambda kind: F.size(F.filter("pii", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    sha = F.sha2(_listed(F.filter("pii", lambda s: s["kind"].isin(base))), 256)
    return found.select("doc_id", *[count(k) for k in base], sha.alias("base_sha256"), _listed(F.col("pii")).alias("spans"))
