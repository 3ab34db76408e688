"""Collocations of two to four words, mined by pivot partitioning.

First all words and, by hash, all pairs of neighbours are counted. What is rare
there breaks the texts: no frequent phrase holds a word or a pair that is rare.
Then each phrase is routed by its pivot, its rarest word (of equal ones the
first): every occurrence of a word sends the window of at most three words on
either side that are more frequent than it, cut at breaks, to the word's partition.
Equal windows are one row with a weight before they are sent. There phrases
that hold the pivot are counted, and those only, so each occurrence of a phrase is
counted at one place. Pivots with many windows are dealt over several partitions.

Tasks know the ranks of words and the frequent pairs from two tables of a fixed
size (RANKS bytes, PAIRS bits) by hash. Words that share an entry take its highest
rank, and pairs that share a bit are all kept, which costs time but no result: the
order of words only needs to be the same everywhere, and counts are of the
words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import table, written
from .textops import BYTE_BASE, mix, powers, text_bytes

LEAST, LONGEST, COVERED, TOP = 30, 4, 80, 2000
RANKS, PAIRS = 1 << 22, 1 << 24
GATHER_BYTES, SALT_ROWS = 2 << 20, 100_000
_U = np.uint64
#: Bytes that end a piece, and those that end a word only.
BREAKS, GAPS = b".,;:!?\n\x0b\x0c\r", b" \t"
_BREAK, _GAP = np.zeros(256, bool), np.zeros(256, bool)
_BREAK[list(BREAKS)] = True
_GAP[list(BREAKS + GAPS)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def gathered(batches: Iterator[pa.RecordBatch], column: str, limit: int = GATHER_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches joined until their texts reach ``limit``, so that equal words meet early."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += (pc.sum(pc.binary_length(batch.column(column))).as_py() or 0) + 8 * batch.num_rows
        if size >= limit:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if size:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def string_hashes(column: pa.Array) -> np.ndarray:
    """64-bit hash of each string."""
    raw, at = text_bytes(column)
    up, down = powers(BYTE_BASE, len(raw) + 1)
    sums = np.zeros(len(raw) + 1, dtype=_U)
    np.cumsum((raw.astype(_U) + _U(1)) * up[: len(raw)], out=sums[1:])
    return mix((sums[at[1:]] - sums[at[:-1]]) * down[at[:-1]] + np.diff(at).astype(_U))


class Vocabulary:
    """Words of texts with their languages: ``ids`` counts the pairs of language and word; each id has a hash."""

    def __init__(self, words: pa.Array, langs: pa.Array, of: np.ndarray):
        """``of``: for each word the place of its language in ``langs``."""
        w, g = words.dictionary_encode(), langs.dictionary_encode()
        self.words, self.langs = w.dictionary, g.dictionary
        code = w.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lang = g.indices.to_numpy(zero_copy_only=False).astype(np.int64)[of]
        key, n = lang * len(self.words) + code, len(self.words) * len(self.langs)
        if n > 1 << 24:
            table, self.ids = np.unique(key, return_inverse=True)
        else:
            table, self.ids = np.arange(n), key
        self.word_of, self.lang_of = table % max(1, len(self.words)), table // max(1, len(self.words))
        self.hashes = key_hashes(string_hashes(self.words)[self.word_of], string_hashes(self.langs)[self.lang_of])


def key_hashes(word: np.ndarray, lang: np.ndarray) -> np.ndarray:
    return mix(word + mix(lang) * _U(3))


class Text:
    """The words of a slice of texts: vocabulary, and for each word whether it follows the one before it in a piece."""

    def __init__(self, texts: pa.Array, langs: pa.Array):
        raw, offsets = text_bytes(texts)
        raw = _LOWER[raw]
        solid, n = ~_GAP[raw], len(raw)
        edge = np.zeros(n + 1, dtype=bool)
        edge[offsets] = True
        before, after = np.zeros(n, dtype=bool), np.zeros(n, dtype=bool)
        before[1:], after[:-1] = solid[:-1], solid[1:]
        start = np.flatnonzero(solid & (~before | edge[:n]))
        end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        at = np.zeros(len(start) + 1, dtype=np.int32)
        np.cumsum(end - start, out=at[1:])
        words = pa.StringArray.from_buffers(len(start), pa.py_buffer(at), pa.py_buffer(raw[solid]))
        doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(start, offsets)))
        piece = np.cumsum(_BREAK[raw], dtype=np.int32)[start] if n else np.zeros(0, np.int32)
        self.follows = np.zeros(len(start), dtype=bool)
        self.follows[1:] = (piece[1:] == piece[:-1]) & (doc[1:] == doc[:-1])
        self.vocabulary = Vocabulary(words, langs, doc)
        self.doc = doc

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Where a word follows another, and the slot of the two."""
        v = self.vocabulary
        second = np.flatnonzero(self.follows)
        h = v.hashes
        return second, (mix(h[v.ids[second - 1]] * _U(5) + h[v.ids[second]]) & _U(PAIRS - 1)).astype(np.int64)


COUNTS = "lang string, word string, slot long, n long"
_COUNTS = pa.schema([("lang", pa.string()), ("word", pa.string()), ("slot", pa.int64()), ("n", pa.int64())])
#: Slot of a row with the number of all words of a language.
ALL = -1


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = np.zeros(PAIRS, dtype=np.int32)
    for batch in gathered(batches, "text"):
        text = Text(batch.column("text"), batch.column("lang"))
        v = text.vocabulary
        found = np.bincount(v.ids, minlength=len(v.hashes))
        there = np.flatnonzero(found)
        total = np.bincount(v.lang_of[there], found[there], minlength=len(v.langs)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([v.langs.take(pa.array(v.lang_of[there])), v.words.take(pa.array(v.word_of[there])), pa.nulls(len(there), pa.int64()), pa.array(found[there])], schema=_COUNTS)
        yield pa.RecordBatch.from_arrays([v.langs, pa.nulls(len(total), pa.string()), pa.array(np.full(len(total), ALL)), pa.array(total)], schema=_COUNTS)
        np.add.at(pairs, text.pairs()[1], np.int32(1))
    for at in range(0, PAIRS, 1 << 20):
        slot = np.flatnonzero(pairs[at : at + (1 << 20)]) + at
        if len(slot):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(slot), pa.string()), pa.nulls(len(slot), pa.string()), pa.array(slot), pa.array(pairs[slot].astype(np.int64))], schema=_COUNTS)


def word_counts(docs: DataFrame, least: int = LEAST) -> DataFrame:
    """Words of a language (lang, word), slots of pairs (slot) with n of at least ``least``, and all words of each language (lang, slot ALL)."""
    found = docs.mapInArrow(_count, COUNTS).groupBy("lang", "word", "slot").agg(F.sum("n").alias("n"))
    return found.where((F.col("n") >= least) | (F.col("slot") == ALL))


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h = key_hashes(string_hashes(batch.column("word")), string_hashes(batch.column("lang")))
        level = np.minimum(255, 1 + (4 * np.log2(batch.column("n").to_numpy().astype(float))).astype(np.int64))
        yield pa.RecordBatch.from_pydict({"slot": (h & _U(RANKS - 1)).astype(np.int64), "value": level})


def _packed(rows: DataFrame, size: int) -> np.ndarray:
    """An array of ``size`` bytes from rows (slot, value), one of each slot: packed in tasks, so the driver gets ``size`` bytes at most."""
    chunk = size >> 7

    def pack(part: pa.Table) -> pa.Table:
        out = np.zeros(chunk, dtype=np.uint8)
        slot = part.column("slot").to_numpy()
        out[slot % chunk] = part.column("value").to_numpy()
        return pa.table({"at": pa.array([int(slot[0]) // chunk], pa.int64()), "packed": pa.array([out.tobytes()], pa.binary())})

    out = np.zeros(size, dtype=np.uint8)
    for at, packed in rows.groupBy(F.expr(f"slot div {chunk}").alias("chunk")).applyInArrow(pack, "at long, packed binary").collect():
        out[at * chunk : (at + 1) * chunk] = np.frombuffer(packed, np.uint8)
    return out


def tables_of(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Rank of each word slot (0: rare), and the bits of frequent pairs; RANKS and PAIRS / 8 bytes."""
    ranks = counts.where("word is not null").mapInArrow(_levels, "slot long, value long").groupBy("slot").agg(F.max("value").alias("value"))
    pairs = counts.where(f"word is null and slot <> {ALL}").groupBy(F.expr("slot div 8").alias("slot")).agg(F.expr("sum(shiftleft(1, int(slot % 8)))").alias("value"))
    return _packed(ranks, RANKS), _packed(pairs, PAIRS >> 3)


def distinct(columns: list[np.ndarray], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the distinct rows and the sums of their weights; rows are told apart by all columns, not by hash."""
    h = np.zeros(len(weights), dtype=_U)
    for c in columns:
        h = mix(h * _U(7) + c.astype(_U))
    _, first, of = np.unique(h, return_index=True, return_inverse=True)
    same = np.ones(len(h), dtype=bool)
    for c in columns:
        same &= c[first[of]] == c
    sums = np.bincount(of[same], weights[same], minlength=len(first)).astype(np.int64)
    if same.all():
        return first, sums
    other = np.flatnonzero(~same)
    more, rest = distinct([c[other] for c in columns], weights[other])
    return np.concatenate([first, other[more]]), np.concatenate([sums, rest])


def joined(words: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    """Phrases of the words at these places, by single spaces; -1 is no word."""
    parts = [words.take(pa.array(c, mask=c < 0)) for c in columns]
    return pc.binary_join_element_wise(*parts, " ", null_handling="skip")


WINDOW = "lang string, pivot long, salt int, shares int, at int, window string, weight long"
_WINDOW = pa.schema([("lang", pa.string()), ("pivot", pa.int64()), *[(c, pa.int32()) for c in ("salt", "shares", "at")], ("window", pa.string()), ("weight", pa.int64())])


def _windows(batches: Iterator[pa.RecordBatch], ranks: np.ndarray, bits: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in gathered(batches, "text"):
        text = Text(batch.column("text"), batch.column("lang"))
        v = text.vocabulary
        level = ranks[(v.hashes & _U(RANKS - 1)).astype(np.int64)]
        order_of = np.where(level > 0, level.astype(_U) << _U(56) | v.hashes >> _U(8), _U(0))
        order, n = order_of[v.ids], len(v.ids)
        second, slot = text.pairs()
        rim = LONGEST
        linked = np.zeros(n + 2 * rim, dtype=bool)
        linked[rim + second] = (bits[slot >> 3] >> (slot & 7) & 1).astype(bool) & (order[second] > 0) & (order[second - 1] > 0)
        left, right = np.zeros(n, np.int64), np.zeros(n, np.int64)
        back, on = np.ones(n, bool), np.ones(n, bool)
        padded = np.pad(order, rim)
        for j in range(1, LONGEST):
            back &= linked[rim - j + 1 : rim - j + 1 + n] & (padded[rim - j : rim - j + n] > order)
            on &= linked[rim + j : rim + j + n] & (padded[rim + j : rim + j + n] >= order)
            left += back
            right += on
        at = np.flatnonzero(left + right > 0)
        left, right = left[at], right[at]
        ids = np.concatenate([v.ids, np.full(LONGEST, -1)])
        columns = [np.where((-left <= j) & (j <= right), ids[at + j], -1) for j in range(1 - LONGEST, LONGEST)]
        keep, weight = distinct(columns, np.ones(len(at), np.int64))
        columns, at, left = [c[keep] for c in columns], at[keep], left[keep]
        pivot = v.ids[at]
        shares = np.maximum(1, np.exp2(level[pivot] / 4) / SALT_ROWS).astype(np.int64)
        spread = np.zeros(len(at), dtype=_U)
        for c in columns:
            spread = mix(spread + np.where(c < 0, _U(1), v.hashes[c]))
        salt = (spread % shares.astype(_U)).astype(np.int32)
        words = joined(v.words, [np.where(c < 0, -1, v.word_of[c]) for c in columns])
        made = pa.RecordBatch.from_arrays([v.langs.take(pa.array(v.lang_of[pivot])), pa.array(order_of[pivot].view(np.int64)), pa.array(salt), pa.array(shares.astype(np.int32)), pa.array(left.astype(np.int32)), words, pa.array(weight)], schema=_WINDOW)
        for k in range(0, made.num_rows, 50_000):
            yield made.slice(k, 50_000)


_PHRASE = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("n", pa.int64())])


def _pivots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches, sorted by pivot, joined so that none but the pivots of many shares is split."""
    held = None
    for batch in gathered(batches, "window"):
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        pivot = batch.column("pivot").to_numpy()
        start = int(np.searchsorted(pivot, pivot[-1]))  # sorted by pivot first
        if start:
            yield batch.slice(0, start)
        held = batch.slice(start)
        if pc.min(held.column("shares")).as_py() > 1:
            yield held
            held = None
    if held is not None and held.num_rows:
        yield held


def _mine(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[pa.RecordBatch]:
    """Counts of the phrases of each window that hold its pivot; of pivots in one share those of ``least`` only, as their counts are final."""
    for batch in _pivots(batches):
        raw, offsets = text_bytes(batch.column("window"))
        space = raw == 32
        ends = np.flatnonzero(np.concatenate([space, np.zeros(1, bool)]))
        bounds = np.unique(np.concatenate([offsets[1:], ends]))  # the end of each word; a window ends without a space
        first = np.searchsorted(bounds, offsets[:-1], side="right")
        size = np.searchsorted(bounds, offsets[1:], side="left") + 1 - first
        lengths = np.diff(np.concatenate([[0], bounds]))
        lengths[1:] -= np.isin(bounds[:-1], ends, assume_unique=True)
        starts = np.zeros(len(bounds) + 1, dtype=np.int32)
        np.cumsum(lengths, out=starts[1:])
        words = pa.StringArray.from_buffers(len(bounds), pa.py_buffer(starts), pa.py_buffer(raw[~space]))
        v = Vocabulary(words, batch.column("lang"), np.repeat(np.arange(batch.num_rows), size))
        at, weight = batch.column("at").to_numpy().astype(np.int64), batch.column("weight").to_numpy()
        shared = batch.column("shares").to_numpy() > 1
        found, weights = [], []
        for before in range(LONGEST):
            for more in range(LONGEST - before):
                if before + more:
                    rows = np.flatnonzero((at >= before) & (at + more < size))
                    place = first[rows] + at[rows] - before
                    found.append([np.where(k <= before + more, v.ids[np.minimum(place + k, len(v.ids) - 1)], -1) for k in range(LONGEST)] + [shared[rows].astype(np.int64)])
                    weights.append(weight[rows])
        columns, weights = [np.concatenate(c) for c in zip(*found, strict=True)], np.concatenate(weights)
        keep, n = distinct(columns, weights)
        final = (n >= least) | (columns[-1][keep] > 0)
        keep, n = keep[final], n[final]
        columns = [c[keep] for c in columns[:-1]]
        phrases = joined(v.words, [np.where(c < 0, -1, v.word_of[c]) for c in columns])
        made = pa.RecordBatch.from_arrays([v.langs.take(pa.array(v.lang_of[columns[0]])), phrases, pa.array(n)], schema=_PHRASE)
        for k in range(0, made.num_rows, 50_000):
            yield made.slice(k, 50_000)


def frequent_phrases(docs: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Phrases of one to LONGEST words (lang, phrase, size, n) that occur ``least`` times or more, and the number of all words of each language (lang, n).

    Words are maximal runs without space or tab inside the pieces between
    ``.,;:!?`` and line ends; A to Z count as a to z. A null text has no words,
    a null lang is ``und``; occurrences overlap. Copies count as often as they are
    there. A language without words has no row.
    """
    texts = _texts(docs)
    sc = docs.sparkSession.sparkContext
    counts = written(word_counts(texts, least), "word-counts")
    ranks, bits = (sc.broadcast(t) for t in tables_of(counts))
    windows = texts.mapInArrow(lambda batches: _windows(batches, ranks.value, bits.value), WINDOW)
    dealt = windows.repartition("lang", "pivot", "salt").sortWithinPartitions("pivot", "lang")
    local = dealt.mapInArrow(lambda batches: _mine(batches, least), "lang string, phrase string, n long")
    phrases = local.groupBy("lang", "phrase").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    words = counts.where("word is not null").select("lang", F.col("word").alias("phrase"), F.lit(1).alias("size"), "n")
    found = phrases.select("lang", "phrase", F.size(F.split("phrase", " ")).alias("size"), "n").unionByName(words)
    return written(found, "phrases"), counts.where((F.col("slot") == ALL) & (F.col("n") > 0)).select("lang", "n")


def _part(words: str, start, size) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def scored(found: DataFrame) -> DataFrame:
    """Phrases of two words or more with a, l, r and score of their lowest-scoring cut."""
    whole = found.where("size > 1").withColumn("words", F.split("phrase", " "))
    cuts = whole.select("lang", "phrase", "size", F.col("n").alias("a"), "words", F.explode(F.expr("sequence(1, size - 1)")).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part("words", F.lit(1), F.col("k")).alias("head"), _part("words", F.col("k") + 1, F.col("size") - F.col("k")).alias("tail"))
    side = lambda name, n: found.select("lang", F.col("phrase").alias(name), F.col("n").alias(n))
    met = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"])
    wide = "decimal(20,0)"
    score = F.expr(f"(cast(a as {wide}) * 2000000) div (cast(l as {wide}) + cast(r as {wide}))")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("low")
    return met.groupBy("lang", "phrase", "a").agg(lowest).select("lang", "phrase", "a", "low.l", "low.r", "low.score")


def without_covered(candidates: DataFrame, found: DataFrame, percent: int = COVERED) -> DataFrame:
    """Candidates less those inside a longer one that is nearly as frequent."""
    longer = found.where("size > 2").select("lang", "size", "n", F.split("phrase", " ").alias("words"))
    parts = longer.select("lang", "n", "words", "size", F.explode(F.expr("sequence(2, size - 1)")).alias("m"))
    parts = parts.select("lang", "n", "words", "m", F.explode(F.expr("sequence(1, size - m + 1)")).alias("s"))
    most = parts.select("lang", _part("words", F.col("s"), F.col("m")).alias("phrase"), "n").groupBy("lang", "phrase").agg(F.max("n").alias("longest"))
    wide = "decimal(20,0)"
    covered = F.expr(f"cast(longest as {wide}) * 100 >= cast(a as {wide}) * {percent}")
    return candidates.join(most, ["lang", "phrase"], "left").where(F.col("longest").isNull() | ~covered).drop("longest")


def collocations(docs: DataFrame, least: int = LEAST, percent: int = COVERED, top: int = TOP) -> DataFrame:
    """The ``top`` collocations of each language: lang, rank, phrase, a, l, r, n, score.

    Columns of ``docs`` other than lang and text are left aside. See
    ``frequent_phrases`` for nulls and words. Ties of score go to the more frequent
    phrase, then to the lesser one in UTF-8. An empty table, and a language without
    a frequent phrase, give no row. Long texts are read whole. Memory of a task: one
    slice of GATHER_BYTES, or one longer text, and the two tables.
    """
    found, totals = frequent_phrases(docs, least)
    kept = without_covered(scored(found), found, percent)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = kept.withColumn("rank", rank).where(F.col("rank") <= top).join(totals, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collocations of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = r"""
WITH pieces AS (
  SELECT lang, regexp_extract_all(unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')), '[^\x20\x09]+') AS words
  FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)),
totals AS (SELECT lang, sum(len(words)) AS n FROM pieces GROUP BY lang),
grams AS (
  SELECT lang, size, array_to_string(words[i:i + size - 1], ' ') AS phrase
  FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i FROM pieces, range(1, 5) t(size) WHERE len(words) >= size)),
found AS (SELECT lang, phrase, size, count(*) AS n FROM grams GROUP BY lang, phrase, size HAVING count(*) >= 30),
cuts AS (
  SELECT lang, phrase, n AS a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS tail
  FROM (SELECT *, unnest(range(1, size)) AS k FROM found WHERE size > 1)),
scores AS (
  SELECT c.lang, c.phrase, c.a, c.k, h.n AS l, t.n AS r, (2000000::HUGEINT * c.a) // (h.n + t.n) AS score
  FROM cuts c JOIN found h ON h.lang = c.lang AND h.phrase = c.head JOIN found t ON t.lang = c.lang AND t.phrase = c.tail),
lowest AS (SELECT * FROM scores QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
parts AS (
  SELECT lang, array_to_string(string_split(phrase, ' ')[s:s + m - 1], ' ') AS phrase, max(n) AS longest
  FROM (SELECT *, unnest(range(1, size - m + 2)) AS s FROM (SELECT *, unnest(range(2, size)) AS m FROM found WHERE size > 2)) GROUP BY ALL),
kept AS (
  SELECT l.* FROM lowest l LEFT JOIN parts p ON p.lang = l.lang AND p.phrase = l.phrase
  WHERE p.longest IS NULL OR 100::HUGEINT * p.longest < 80::HUGEINT * l.a)
SELECT k.lang, row_number() OVER (PARTITION BY k.lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score
FROM kept k JOIN totals t ON t.lang = k.lang
QUALIFY rank <= 2000
"""
