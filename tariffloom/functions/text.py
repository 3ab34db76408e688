"""Identifiers, names and other text."""

from __future__ import annotations

import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Legal forms dropped from a party's name key.
PARTY_SUFFIXES = [
    "PRIVATE", "LIMITED", "CORPORATION", "COMPANY", "INCORPORATED", "PVT", "LTD", "LLP", "LLC", "INC", "CORP", "CO", "GMBH", "SPA",
    "SRL", "PTE", "SDN", "BHD", "FZE", "FZCO", "FZC", "DMCC", "BV", "NV", "SA", "AG", "KG", "OY",
    "AB", "AS",
]
#: Words dropped from an importer's name, and from a master's match key.
IMPORTER_SUFFIXES = [
    "MS", "PVT", "PRIVATE", "LTD", "LIMITED", "LLP", "CO", "COMPANY", "INC",
]
MATCH_SUFFIXES = [
    "PVT", "PRIVATE", "LTD", "LIMITED", "LLP", "INC", "CO", "COMPANY", "FZE", "FZCO", "GMBH",
]
#: Cells that stand for no value.
NULLISH = ("", "NULL", ".", "..", "-", "--", "NA", "N/A", "NIL")
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BASE36 = "0123456789" + LETTERS
#: Letter values of container numbers: from 10 on, without multiples of 11.
CONTAINER_VALUES = [10, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 23, 24, 25, 26, 27, 28, 29, 30, 31, 32, 34, 35, 36, 37, 38]


def _words(names: list[str]) -> str:
    return rf"\b(?:{'|'.join(names)})\b"


def squeezed(x: Column) -> Column:
    return F.trim(F.regexp_replace(x, r"\s+", " "))


def alnum(x: Column) -> Column:
    return F.regexp_replace(F.upper(x), "[^A-Z0-9]", "")


def at_least(x: Column, n: int) -> Column:
    """The bare identifier if it has n characters or more."""
    return F.when(F.length(alnum(x)) >= n, alnum(x))


def airway_bill(x: Column) -> Column:
    digits = F.regexp_replace(x, "[^0-9]", "")
    return F.when(F.length(digits) == 11, digits)


def container_valid(x: Column) -> Column:
    """Four letters, six digits and the check digit: values times powers of two, modulo 11, modulo 10."""
    bare = alnum(x)
    table = F.array(*[F.lit(v) for v in [*range(10), *CONTAINER_VALUES]])
    value = lambda i: F.element_at(table, F.instr(F.lit(BASE36), F.substring(bare, i + 1, F.lit(1))))
    total = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0), lambda acc, i: acc + value(i) * F.pow(F.lit(2), i).cast("int"))
    return F.when(bare.rlike("^[A-Z]{4}[0-9]{7}$"), (total % 11 % 10) == F.substring(bare, 11, 1).cast("int")).otherwise(F.lit(False))


def identifier(kind: Column, raw: Column) -> Column:
    """The normal form of an identifier of a kind, null if it isn't one."""
    return (
        F.when(kind == "container", F.when(container_valid(raw), alnum(raw)))
        .when(kind == "bl", at_least(raw, 6))
        .when(kind == "awb", airway_bill(raw))
        .when(kind.isin("invoice", "po"), at_least(raw, 5))
        .when(kind == "conversation", F.when(F.trim(raw) != "", F.trim(raw)))
    )


def party_key(x: Column) -> Column:
    """A party's name without honorific, legal forms and punctuation."""
    bare = F.regexp_replace(F.upper(x), r"^\s*(?:M/S|MESSRS)\b[.\s]*", "")
    bare = F.regexp_replace(F.regexp_replace(bare, "&", " AND "), "[^A-Z0-9]+", " ")
    return squeezed(F.regexp_replace(bare, _words(PARTY_SUFFIXES), " "))


def importer_key(x: Column) -> Column:
    return squeezed(F.regexp_replace(F.regexp_replace(F.upper(x), "[^A-Z0-9 ]", " "), _words(IMPORTER_SUFFIXES), ""))


def match_key(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.upper(x), _words(MATCH_SUFFIXES), ""), "[^A-Z0-9]", "")


def cell_value(x: Column) -> Column:
    """White space collapsed; placeholders mean null."""
    text = squeezed(x)
    return F.when(~F.upper(text).isin(*NULLISH), text)


def party_cell(x: Column) -> Column:
    return cell_value(F.regexp_replace(cell_value(x), "^['\"]+|['\"]+$", ""))


def placeholder_branch(x: Column) -> Column:
    return F.coalesce(cell_value(x).isNull() | (cell_value(x) == "0"), F.lit(True))


def branch_for_export(x: Column) -> Column:
    """A branch name, null where it means nothing."""
    return F.when(~placeholder_branch(x), F.trim(x))


def memory_keys(importer: Column, description: Column) -> tuple[Column, Column]:
    return importer_key(importer), F.substring(squeezed(F.regexp_replace(F.upper(description), "[^A-Z0-9 ]", " ")), 1, 40)


def trigrams(x: Column) -> Column:
    """The set of 3-grams of the whole string, padded with two blanks in front and one behind."""
    padded = F.concat(F.lit("  "), x, F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(padded) - 2), lambda i: F.substring(padded, i, F.lit(3))))


def trigram_codes(x: Column) -> Column:
    """``trigrams``, each as the one number that its three code points make."""
    point = lambda g, i: F.ascii(F.substring(g, i, 1)).cast("bigint")
    return F.transform(trigrams(x), lambda g: F.shiftleft(point(g, 1), 42) + F.shiftleft(point(g, 2), 21) + point(g, 3))


def trigram_similarity(a: Column, b: Column) -> Column:
    both = F.size(F.array_intersect(a, b))
    return both / (F.size(a) + F.size(b) - both)


def is_grade_code(word: Column) -> Column:
    bare = F.regexp_replace(word, r"[()\[\],.]", "")
    return bare.rlike(r"^[0-9]{4,}$") | (bare.rlike("[A-Za-z]") & bare.rlike("[0-9]"))


def trade_description(x: Column) -> Column:
    """The description without trailing grade codes; two words stay in any case."""
    words = F.split(squeezed(x), " ")
    plain = F.aggregate(F.sequence(F.lit(1), F.size(words)), F.lit(0), lambda acc, i: F.when(is_grade_code(F.element_at(words, i)), acc).otherwise(i))
    return F.array_join(F.slice(words, F.lit(1), F.greatest(plain, F.least(F.size(words), F.lit(2)))), " ")


def _once(x: Column, f) -> Column:
    """f of x where x is computed once a row, however often f uses it; plain columns are put in for each use."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def gstin_check(first14: Column) -> Column:
    """The modulo-36 check character: factors one and two in turn, quotient and remainder by 36 summed."""

    def check(x: Column) -> Column:
        values = F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: (F.instr(F.lit(BASE36), F.substring(x, i, F.lit(1))) - 1) * (2 - i % 2))
        return _once(F.aggregate(values, F.lit(0), lambda acc, p: acc + (p / 36).cast("int") + p % 36), lambda total: F.substring(F.lit(BASE36), (36 - total % 36) % 36 + 1, F.lit(1)))

    return _once(first14, check)


GSTIN = "^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]$"


def gstin_problems(gstin: Column, pan: Column, state: Column) -> Column:
    """What is wrong with a GSTIN, in order: format, check character, embedded PAN, state code."""

    def found(bare: Column) -> Column:
        right = bare.rlike(GSTIN)
        return F.array(
            F.when(~right, "format"),
            F.when(right & (gstin_check(F.substring(bare, 1, 14)) != F.substring(bare, 15, 1)), "check"),
            F.when(right & pan.isNotNull() & (F.substring(bare, 3, 10) != F.upper(F.trim(pan))), "pan"),
            F.when(right & state.isNotNull() & (F.substring(bare, 1, 2) != state), "state"),
        )

    return F.array_compact(_once(F.upper(F.trim(gstin)), found))


def _decomposed() -> tuple[str, str]:
    """Latin letters that canonical decomposition takes apart, and the letters left of them."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))]
    kept = [(x, d[0]) for x, d in pairs if len(d) > 1 and d[0].isascii() and d[0].isalpha()]
    return "".join(x for x, _ in kept), "".join(d for _, d in kept)


ACCENTED, PLAIN = _decomposed()


def plain_key(x: Column) -> Column:
    """Accents off, upper case, other characters as single blanks."""
    bare = F.regexp_replace(F.translate(x, ACCENTED, PLAIN), r"\p{M}+", "")
    return F.trim(F.regexp_replace(F.upper(bare), "[^A-Z0-9]+", " "))


def pad8(x: Column) -> Column:
    digits = F.regexp_replace(x, "[^0-9]", "")
    return F.when(F.length(digits).between(1, 8), F.rpad(digits, 8, "0"))


def hs_code(x: Column) -> Column:
    digits = F.substring(F.regexp_replace(x, "[^0-9]", ""), 1, 8)
    return F.when(F.length(digits) >= 4, digits)


def hs_prefixes(code: Column, least: int = 2) -> Column:
    """All prefixes of a code, longest first."""
    return F.transform(F.sequence(F.length(code), F.lit(least), F.lit(-1)), lambda n: F.substring(code, F.lit(1), n))


def hs_lookup_keys(codes: Column, least: int = 2) -> Column:
    """All prefixes of all codes of an array, each once, in the order of the codes."""
    return F.array_distinct(F.flatten(F.transform(F.filter(codes, lambda c: hs_code(c).isNotNull()), lambda c: hs_prefixes(hs_code(c), least))))


def hs_matches_prefix(code: Column, prefix: Column, least: int = 2) -> Column:
    bare = F.regexp_replace(prefix, "[^0-9]", "")
    return F.coalesce((F.length(bare) >= least) & hs_code(code).startswith(bare), F.lit(False))


def voyage(x: Column) -> Column:
    """What follows the first slash, else a last token that looks like a voyage number."""
    text = F.trim(x)
    tail = F.trim(F.substring(text, F.instr(text, "/") + 1, F.length(text)))
    tokens = F.split(text, r"\s+")
    last = F.element_at(tokens, -1)
    shaped = (F.size(tokens) > 1) & last.rlike("[0-9]") & last.rlike(r"^[A-Za-z0-9.\-]{2,10}$")
    return F.when(F.instr(text, "/") > 0, F.when(tail != "", tail)).when(shaped, F.regexp_replace(last, "^[Vv][.]", ""))


def vessel_name(vessel: Column, number: Column) -> Column:
    """The vessel without its voyage number at the end."""
    text = F.trim(vessel)
    ends = F.upper(F.substring(text, F.length(text) - F.length(number) + 1, F.length(number))) == F.upper(number)
    return F.when(number.isNotNull() & ends, F.trim(F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - F.length(number)), r"[\s/]+$|(?i)\s+V\.?$", ""))).otherwise(text)


def safe_name(x: Column, fallback: str = "document") -> Column:
    """A file name of letters, digits, dots, dashes and underscores."""
    bare = F.regexp_replace(F.regexp_replace(F.trim(x), r"[^A-Za-z0-9._-]+", "-"), "^[-.]+|[-.]+$", "")
    return F.when(bare != "", F.substring(bare, 1, 120)).otherwise(F.lit(fallback))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.translate(x, ACCENTED, PLAIN)), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def safe_part(x: Column) -> Column:
    """A part of a file name: other characters than letters, digits, dots, dashes and underscores become underscores."""
    return F.regexp_replace(x, "[^A-Za-z0-9._-]+", "_")


def storage_path(company: Column, job: Column, digest: Column, name: Column) -> Column:
    """Where a document is stored: company, job, the digest's first characters and the safe name."""
    return F.concat_ws("/", company, job, F.concat(F.substring(digest, 1, 12), F.lit("-"), safe_name(name)))


def job_title(transport: Column, invoice: Column, fallback: Column) -> Column:
    """By transport document, else by invoice, else the subject's first 120 characters."""
    stated = lambda label, x: F.when(F.trim(x) != "", F.concat(F.lit(label), F.trim(x)))
    return F.coalesce(stated("B/L ", transport), stated("Invoice ", invoice), F.when(F.trim(fallback) != "", F.substring(F.trim(fallback), 1, 120)), F.lit("Untitled job"))


def tidy_code(x: Column, most: int = 16) -> Column:
    """Upper case, other characters as single dashes, at most ``most`` characters without a dash at the end."""
    dashed = F.regexp_replace(F.regexp_replace(F.upper(x), "[^A-Z0-9]+", "-"), "^-+|-+$", "")
    cut = F.regexp_replace(F.substring(dashed, 1, most), "-+$", "")
    return F.when(cut != "", cut).otherwise("CCR")


def first_clause(x: Column, most: int = 72) -> Column:
    """The first sentence or clause without its end mark, cut at a word to ``most`` characters."""
    first = F.regexp_replace(F.trim(F.get(F.split(x, r"(?<=[.;])\s"), F.lit(0))), "[.;]+$", "")
    cut = F.substring(first, 1, most)
    word = F.regexp_extract(cut, r"(?s)^(.+) [^ ]*$", 1)
    return F.when(F.length(first) <= most, first).when(word != "", word).otherwise(cut)


def foreign_port(name: Column, code: Column) -> Column:
    return F.concat(name, F.lit("("), code, F.lit(")"))


def unlocode(x: Column, loose: Column) -> Column:
    """The code in parentheses at the end, else the text if it is five letters, else ``loose``."""
    text = F.trim(x)
    inside = F.regexp_extract(text, r"\(([A-Za-z]{5})\)\s*$", 1)
    return F.when(inside != "", F.upper(inside)).when(text.rlike("^[A-Za-z]{5}$"), F.upper(text)).otherwise(loose)


#: Typographic signs and what they are written as.
PUNCTUATION = {"\u2018": "'", "\u2019": "'", "\u201c": '"', "\u201d": '"', "\u2013": "-", "\u2014": "-", "\u00a0": " "}
LIGATURES = {"\ufb00": "ff", "\ufb01": "fi", "\ufb02": "fl", "\ufb03": "ffi", "\ufb04": "ffl"}
ALLOWED = "ôéèíáãçüöäñåæøÅÉÈÍÁÃÇÜÖÄÑ"


def _replaced(x: Column, pairs: dict[str, str]) -> Column:
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs.items(), x)


def prose(x: Column) -> Column:
    return squeezed(_replaced(F.coalesce(x, F.lit("")), PUNCTUATION))


def clean(x: Column) -> Column:
    """Ligatures taken apart, white space collapsed; a character outside ASCII that isn't known raises."""
    text = squeezed(_replaced(x, LIGATURES))
    odd = F.regexp_extract(text, f"([^\\x00-\\x7e{ALLOWED}])", 1)
    return F.when(odd == "", text).otherwise(F.raise_error(F.concat(F.lit("unknown character "), odd, F.lit(" in "), text)).cast("string"))


def column_number(cell: Column) -> Column:
    """The number of a cell reference's column: A1 is 1, AB7 is 28."""
    letters = F.regexp_extract(F.upper(cell), "^([A-Z]+)[0-9]*$", 1)
    number = F.aggregate(F.split(letters, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).otherwise(acc * 26 + F.instr(F.lit(LETTERS), c)))
    return F.when(letters != "", number)


def escape_xml(x: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;"))
    return reduce(lambda acc, p: F.replace(acc, F.lit(p[0]), F.lit(p[1])), pairs, x)


def column_letter(n: Column) -> Column:
    """1 is A, 27 is AA; up to three letters."""
    one = lambda k: F.substring(F.lit(LETTERS), (k % 26).cast("int") + 1, F.lit(1))
    first, second = F.floor((n - 1) / 26), F.floor((n - 27) / 676)
    return F.concat(F.when(n > 702, one(second - 1 + 26)).otherwise(""), F.when(n > 26, one(first - 1)).otherwise(""), one(n - 1))


ONES = [
    "Zero", "One", "Two", "Three", "Four", "Five", "Six", "Seven", "Eight", "Nine", "Ten", "Eleven", "Twelve", "Thirteen",
    "Fourteen", "Fifteen", "Sixteen", "Seventeen", "Eighteen", "Nineteen",
]
TENS = [
    "Zero", "Ten", "Twenty", "Thirty", "Forty", "Fifty", "Sixty", "Seventy", "Eighty", "Ninety",
]


def _below_hundred(n: Column) -> Column:
    ones, tens = F.array(*map(F.lit, ONES)), F.array(*map(F.lit, TENS))
    small = F.get(ones, n.cast("int"))
    large = F.concat(F.get(tens, F.floor(n / 10).cast("int")), F.when(n % 10 > 0, F.concat(F.lit(" "), F.get(ones, (n % 10).cast("int")))).otherwise(""))
    return F.when(n == 0, "").when(n < 20, small).otherwise(large)


def _below_crore(n: Column) -> Column:
    part = lambda k, name: F.when(k > 0, F.concat(_below_hundred(k), F.lit(f" {name}")))
    return F.concat_ws(" ", part(F.floor(n / 100_000), "Lakh"), part(F.floor(n % 100_000 / 1000), "Thousand"), part(F.floor(n % 1000 / 100), "Hundred"), F.nullif(_below_hundred(n % 100), F.lit("")))


def indian_words(n: Column) -> Column:
    """A whole number below 10**14 in words, by crore, lakh, thousand and hundred; a negative one raises."""
    n = F.when(n < 0, F.raise_error(F.lit("no words for a negative number")).cast("long")).otherwise(F.floor(n).cast("long"))
    crore = F.floor(n / 10_000_000)
    upper = F.when(crore > 0, F.concat(_below_crore(crore), F.lit(" Crore")))
    return F.when(n == 0, "Zero").otherwise(F.concat_ws(" ", upper, F.nullif(_below_crore(n % 10_000_000), F.lit(""))))


def rupees_in_words(n: Column) -> Column:
    return F.concat(F.lit("Rs. "), indian_words(n), F.lit(" Only"))
