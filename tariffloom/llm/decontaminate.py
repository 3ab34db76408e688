"""Finds documents that hold benchmark items, also with other numbers, names or units in them.

Texts become templates: a number, a name (a capitalised word inside a sentence)
and a unit after a number turn into typed placeholders, the other tokens into
their lower-case hash. Windows of template tokens of documents and items meet in
a hash join; the hash also holds which of a window's slots are equal, so slots
agree inside a window if the hashes do. Over all windows that a document shares
with an item, one map of slot values must hold: each value of the item stays or
goes to the value that most windows give it, and the other way round, and windows
that say otherwise don't count. A capitalised word that opens a sentence may be a name
or not, so windows with such words have a second template. Besides, the own
tokens of items and documents meet exactly, which finds verbatim copies with few
literal tokens and of short items.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import table
from .textops import Words, mix, signed, slices, text_bytes

#: Unit spellings that make a slot after a number.
UNITS = "mm cm m km in ft yd mi mg g kg t lb oz ml l s sec min h hr hrs hour hours day days week weeks month months year years % percent usd eur gbp dollars euros pounds cents meters metres miles feet inches grams kilograms liters litres seconds minutes degrees mph kmh".split()
NUMBER, NAME, UNIT, EXACT = (mix(np.array([k], dtype=np.uint64))[0] for k in (101, 102, 103, 104))
_LETTER = np.zeros(256, dtype=bool)
_LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), ord("%")]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = np.zeros(256, dtype=bool)
_STOP[[ord(c) for c in ".!?\n:|"]] = True
#: Lead bytes of scripts without spaces and their punctuation, whose characters are tokens of their own.
_UNSPACED = np.zeros(256, dtype=bool)
_UNSPACED[[0xE0, 0xE1, *range(0xE3, 0xEA), 0xEF, 0xF0]] = True
_CHARACTER = r"([\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}])"
_MARKS = r"[\x{3000}-\x{3004}\x{3008}-\x{3020}\x{3030}\x{FF01}-\x{FF0F}\x{FF1A}-\x{FF20}]"


def _spaced(column: pa.Array) -> pa.Array:
    """The texts with spaces around each character of a script that writes none."""
    if not _UNSPACED[text_bytes(column)[0]].any():
        return column
    return pc.replace_substring_regex(pc.replace_substring_regex(column, _CHARACTER, r" \1 "), _MARKS, " ")


def _words(raw: np.ndarray, offsets: np.ndarray) -> Words:
    out = Words.__new__(Words)
    out.split(raw, offsets)
    return out


def _unit_hashes() -> np.ndarray:
    raw = np.frombuffer(" ".join(UNITS).encode(), np.uint8)
    return np.unique(_words(raw, np.array([0, len(raw)])).hash)


class Template:
    """Template tokens of a slice of texts: template hash, own hash, whether literal, and the words they are."""

    def __init__(self, column: pa.Array):
        raw, offsets = text_bytes(_spaced(column))
        upper = (raw >= 65) & (raw <= 90)
        low = _LOWER[raw]
        accent = np.zeros(len(raw), dtype=bool)
        accent[1:] = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
        low = np.where(accent, low + 32, low).astype(np.uint8)
        capital = upper.copy()
        capital[:-1] |= accent[1:]
        words = _words(np.where(_LETTER[raw], low, 32).astype(np.uint8), offsets)
        n = len(words.hash)
        sums = np.concatenate([[0], np.cumsum((raw >= 48) & (raw <= 57))])
        number = sums[words.end] > sums[words.start]
        stops = np.concatenate([[0], np.cumsum(_STOP[raw])])
        previous = np.concatenate([[0], words.end[:-1]]) if n else np.zeros(0, np.int64)
        opens = np.ones(n, dtype=bool)
        if n:
            opens[1:] = (words.doc[1:] != words.doc[:-1]) | (stops[words.start[1:]] > stops[previous[1:]])
        uppers = np.concatenate([[0], np.cumsum(upper)])
        shout = (uppers[words.end] - uppers[words.start]) > 1
        capitalised = capital[words.start] & ~number & ~shout if n else np.zeros(0, bool)
        name = capitalised & ~opens
        after = np.zeros(n, dtype=bool)
        after[1:] = number[:-1] & ~opens[1:]
        unit = after & np.isin(words.hash, _UNITS) & ~number
        self.own = words.hash
        self.hash = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, words.hash)))
        self.literal = ~(number | unit | name)
        self.opening = capitalised & opens
        self.number = number
        self.words = words

    def _hashes(self, tokens: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
        self.words.hash = tokens
        return self.words.windows(n)[starts] if len(starts) else np.zeros(0, np.uint64)

    def windows(self, n: int, least_literal: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
        """Starts, hashes, literal tokens and False for the windows with enough of them; again with names at sentence starts; and, by their own tokens, all, with True and all but numbers as literal."""
        whole = self.words.whole(n)
        count = lambda flags: (lambda sums: sums[whole + n] - sums[whole])(np.concatenate([[0], np.cumsum(flags)]))
        if n >= MIN_TOKENS:
            starts = whole[count(self.literal) >= least_literal]
            yield starts, self._hashes(self.hash, starts, n), self.literal, False
            literal = self.literal & ~self.opening
            starts = whole[(count(self.opening) > 0) & (count(literal) >= least_literal)]
            yield starts, self._hashes(np.where(self.opening, NAME, self.hash), starts, n), literal, False
        yield whole, mix(self._hashes(self.own, whole, n) + EXACT), ~self.number, True

    def slots(self, starts: np.ndarray, n: int, literal: np.ndarray) -> tuple[np.ndarray, pa.Array]:
        """For each window a hash of which of its slots are equal, and the own hashes of the slots, in order."""
        at = starts[:, None] + np.arange(n)[None, :]
        open_ = ~literal[at]
        own = self.own[at]
        pattern = np.zeros(len(starts), dtype=np.uint64)
        for j in range(n):
            first = np.full(len(starts), j, dtype=np.uint64)
            for i in range(j - 1, -1, -1):
                first[open_[:, i] & (own[:, i] == own[:, j])] = i
            pattern = np.where(open_[:, j], mix(pattern + first + np.uint64(1)), pattern)
        values = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(open_.sum(axis=1))]), pa.int32()), pa.array(signed(own)[open_]))
        return pattern, values

    def places(self, starts: np.ndarray, n: int) -> np.ndarray:
        """One number for each window by its place in the text, its length and its own tokens."""
        offsets = (starts - self.words.first[self.words.doc[starts]]).astype(np.uint64)
        return signed(mix(self._hashes(self.own, starts, n) ^ mix(offsets)))


_UNITS = _unit_hashes()
WINDOW_SCHEMA = "id long, t long, h long, size int, slots array<long>, place long"


def _windows(key: str, n: int, only: np.ndarray | None, sizes: tuple[int, ...], whole_short: bool):
    """Rows (id, t, h, size, slots, place) of the windows of n tokens; of items also shorter ones as wholes; of documents windows of those sizes too.

    t is the hash of the template, h that of the template and its equal slots;
    ``only`` holds the sorted t of the items where they are few.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                template = Template(part.column("text"))
                ids = part.column(key).to_numpy(zero_copy_only=False)
                counts = np.diff(template.words.first)
                for size in sorted({n, *sizes, *(int(c) for c in counts if whole_short and 0 < c < n)}):
                    for starts, hashes, literal, exact in template.windows(size, max(3, (size + 1) // 2)):
                        rows = template.words.doc[starts]
                        if whole_short and size < n:
                            keep = counts[rows] == size
                        elif only is not None:
                            keep = only[np.minimum(np.searchsorted(only, signed(hashes)), len(only) - 1)] == signed(hashes) if len(only) else np.zeros(len(hashes), bool)
                        else:
                            keep = np.ones(len(starts), dtype=bool)
                        starts, hashes, rows = starts[keep], hashes[keep], rows[keep]
                        if len(starts):
                            pattern, values = template.slots(starts, size, literal)
                            columns = [pa.array(ids[rows]), pa.array(signed(hashes)), pa.array(signed(hashes if exact else mix(hashes ^ pattern))), pa.array(np.full(len(rows), size, np.int32)), values, pa.array(template.places(starts, size))]
                            yield pa.record_batch(columns, names=["id", "t", "h", "size", "slots", "place"])

    return run


MIN_TOKENS = 6


def _consistent(met: DataFrame) -> DataFrame:
    """Windows (id, item_id, place) of ``met`` whose pairs of slot values fit the one map of their document and item."""
    key = ["id", "item_id"]
    met = met.repartition(*key)  # what follows needs no other shuffle
    pairs = met.select(*key, "place", F.explode_outer(F.array_distinct(F.arrays_zip("item_slots", "slots"))).alias("p")).select(*key, "place", F.col("p.item_slots").alias("a"), F.col("p.slots").alias("b")).distinct()
    votes = pairs.groupBy(*key, "a", "b").agg(F.count("*").alias("n"), F.min("place").alias("at"))
    best = [F.desc(F.col("a") == F.col("b")), F.desc("n"), "at"]  # of equals the window of least number, for all its pairs
    first = lambda one: F.row_number().over(Window.partitionBy(*key, one).orderBy(*best)) == 1
    fits = votes.withColumn("there", first("a")).withColumn("back", first("b")).select(*key, "a", "b", (F.col("a").isNull() | (F.col("there") & F.col("back"))).alias("fits"))
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"f.{c}")) if c in ("a", "b") else F.col(f"p.{c}") == F.col(f"f.{c}") for c in (*key, "a", "b")]
    joined = pairs.alias("p").join(fits.alias("f"), same).select(*[F.col(f"p.{c}").alias(c) for c in (*key, "place")], "fits")
    return joined.groupBy(*key, "place").agg(F.bool_and("fits").alias("fits")).where("fits").select(*key, "place")


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = 13, broadcast_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, item_ids (sorted array), n_windows (matching windows of the document) for documents that hold benchmark passages.

    Of items that share a window the least item_id stands for all of them in
    that window, so a document isn't multiplied by the items of a common
    template. An item of fewer than ``n`` tokens is matched as a whole. A
    template window needs a majority of literal tokens, and ``MIN_TOKENS`` in
    all, as numbers alone make no question; the others match by their own tokens
    only, and so does even an item of one word. If the benchmark's texts are
    within ``broadcast_bytes`` (checked), its windows go to the tasks, which then
    keep only matching windows; beyond it all windows are sent, with the same
    result. Whole texts are read. Null or empty texts match nothing; rows with a
    null doc_id or item_id are left out; repeated items and documents are
    harmless; rows that share a doc_id are taken together; an empty table on
    either side gives no rows; columns other than the id and text aren't read.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    of_items = items.mapInArrow(_windows("item_id", n, None, (), True), WINDOW_SCHEMA)
    small = (items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) <= broadcast_bytes
    sizes = tuple(r[0] for r in of_items.select("size").distinct().collect())  # n and shorter sizes: at most n numbers
    only = np.unique(np.array([r[0] for r in of_items.select("t").distinct().collect()], dtype=np.int64)) if small else None
    of_docs = texts.mapInArrow(_windows("doc_id", n, only, sizes, False), WINDOW_SCHEMA).drop("t", "size")
    wanted = of_items.groupBy("h").agg(F.min(F.struct(F.col("id").alias("item_id"), F.col("slots").alias("item_slots"))).alias("i")).select("h", "i.item_id", "i.item_slots")
    met = of_docs.join(F.broadcast(wanted) if small else wanted, "h").select("id", "item_id", "place", "slots", "item_slots")
    per_item = _consistent(met).groupBy("id", "item_id").agg(F.count("*").alias("c"))
    return per_item.groupBy(F.col("id").alias("doc_id")).agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.sum("c").cast("long").alias("n_windows"))


def flag_contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """doc_id, contaminated, item_ids and n_windows for every row of docs."""
    found = find_contamination(docs, benchmark, **options)
    return docs.select("doc_id").join(found, "doc_id", "left").select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"), F.coalesce("n_windows", F.lit(0)).cast("long").alias("n_windows"))


def without_contamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of docs, with all their columns, whose doc_id ``find_contamination`` doesn't return; rows with a null doc_id stay."""
    return docs.join(find_contamination(docs, benchmark, **options).select("doc_id"), "doc_id", "left_anti").select(docs.columns)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    return flag_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
