"""Removal of word windows that repeat across documents, by level-wise doubling.

The first level looks at short windows of FIRST words at most, and of those only
at each longer window's minimizer (its short window of least hash), less than a
quarter of all positions. Windows of one length that repeat in another document
are candidates for twice that length (and a word, where the wanted length is
odd); all others never reach the next level. Levels that get no candidates are
left out as Spark runs, since adaptive execution drops joins with an empty side.
Each level aggregates ``min``/``max`` of doc_id per hash on the map side, so a
passage that every document has costs one row per task, and joins back by key,
where Spark splits skewed keys itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, join_groups, table
from .textkeys import text_keys
from .textops import SLICE_BYTES, Words, signed, slices

#: Half-windows are told apart by 48 bits only, which saves shuffle; a clash makes a needless candidate, no wrong result.
SHORT = np.uint64(16)
FIRST = 8


def _distinct(ids: np.ndarray, hashes: np.ndarray) -> pa.RecordBatch:
    order = np.lexsort((hashes, ids))
    ids, hashes = ids[order], hashes[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (hashes[1:] != hashes[:-1])
    return pa.record_batch([pa.array(signed(hashes[new])), pa.array(ids[new])], names=["h", "doc_id"])


def _half_windows(window: int, half: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                words = Words(part.column("text"))
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                _, at, grams = words.minimizers(window, half)
                yield _distinct(ids[words.doc[at]], grams >> SHORT)

    return run


def _codec() -> pa.Codec:
    return pa.Codec("zstd", compression_level=1)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed for the shuffle, which takes them less room than Spark's own block compression."""
    codec = _codec()
    for batch in batches:
        for part in slices(batch, "text"):
            texts = [t or b"" for t in part.column("text").cast(pa.binary()).to_pylist()]
            yield pa.record_batch([part.column("doc_id"), pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary()), pa.array(list(map(len, texts)), pa.int32())], names=["doc_id", "packed", "bytes"])


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, Words]]:
    """Slices of a batch with the words of their texts."""
    codec = _codec()
    for part in slices(batch, "packed", SLICE_BYTES // 3):
        texts = [codec.decompress(z, n, asbytes=True) if n else b"" for z, n in zip(part.column("packed").to_pylist(), part.column("bytes").to_pylist(), strict=True)]
        yield part, Words(pa.array(texts, pa.binary()))


def _next_windows(short: int, size: int, sampled: bool):
    """Windows of ``size`` words that may repeat by the row's list ``survivors`` of hashes of ``short`` words: those whose minimizer is there (sampled), or whose first and last words are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in _unpacked(batch):
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                lists = part.column("survivors")
                full = words.windows(size)
                if sampled:
                    starts, _, heads = words.minimizers(size, short)
                    heads = tails = heads >> SHORT
                else:
                    starts, parts = words.whole(size), words.windows(short)
                    heads, tails = parts[starts], parts[starts + size - short]
                row = words.doc[starts]
                bounds = np.searchsorted(row, np.arange(part.num_rows + 1))
                keep = np.zeros(len(starts), dtype=bool)
                for r in range(part.num_rows):
                    a, b = bounds[r], bounds[r + 1]
                    if b > a:
                        known = lists[r].values.to_numpy(zero_copy_only=False)
                        keep[a:b] = np.isin(signed(heads[a:b]), known) & (sampled or np.isin(signed(tails[a:b]), known))
                yield _distinct(ids[row[keep]], full[starts[keep]])

    return run


def _removed(window: int):
    """Applies each document's list of removable window hashes; ``copy`` marks a repeat of a whole earlier text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, words in _unpacked(batch):
                full = signed(words.windows(window))
                lists, copies = part.column("remove"), part.column("copy").to_pylist()
                raw, counts, gone, kept = words.raw.tobytes(), [], [], []
                for r in range(part.num_rows):
                    a, b = words.first[r], words.first[r + 1]
                    n = int(b - a)
                    tokens = raw[words.offsets[r] : words.offsets[r + 1]].split()
                    covered = np.zeros(n, dtype=bool)
                    if n >= window and copies[r]:
                        covered[:] = True
                    elif n >= window and lists[r].is_valid:
                        hit = np.isin(full[a : b - window + 1], lists[r].values.to_numpy(zero_copy_only=False))
                        edges = np.zeros(n + 1, dtype=np.int32)
                        edges[: n - window + 1] += hit
                        edges[window : n + 1] -= hit
                        covered = np.cumsum(edges)[:n] > 0
                    if covered.any():
                        tokens = [t for t, c in zip(tokens, covered, strict=True) if not c]
                    counts.append(n)
                    gone.append(int(covered.sum()))
                    kept.append(b" ".join(tokens).decode("utf-8"))
                yield pa.record_batch([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_text"])

    return run




PAIR = "h long, doc_id long"
PACKED = "doc_id long, packed binary, bytes int"


def later_copies(docs: DataFrame) -> DataFrame:
    """doc_ids of one row whose whole text a smaller doc_id already has."""
    keyed = docs.select("doc_id", *text_keys(F.coalesce("text", F.lit(""))))
    groups = keyed.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.count("*").alias("n")).where("first < last").drop("last")
    several = keyed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    later = join_groups(keyed, groups, ["k1", "k2"], "first").where("doc_id > first")
    return later.join(several, "doc_id", "left_anti").select("doc_id", F.lit(True).alias("copy"))


def doubled_lengths(window: int) -> list[int]:
    """The lengths of the levels up to ``window``: halves of it, rounded down, until FIRST or less; at least two."""
    out = [window]
    while len(out) < 2 or out[0] > FIRST:
        out.insert(0, max(1, out[0] // 2))
    return out


def _repeated(pairs: DataFrame) -> DataFrame:
    """(h, lo) of the hashes that two doc_ids or more have, with the least of them."""
    return pairs.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("h", "lo")


def _survivors(pairs: DataFrame) -> DataFrame:
    """doc_id and the list of its repeated hashes, which is bounded by the length of its own text."""
    return pairs.join(_repeated(pairs).select("h"), "h", "left_semi").groupBy("doc_id").agg(F.collect_list("h").alias("survivors"))


def _first_level(known: DataFrame, lengths: list[int], copies: DataFrame) -> DataFrame:
    pairs = known.mapInArrow(_half_windows(lengths[1], lengths[0]), PAIR)
    firsts = pairs.join(_repeated(pairs).select("h"), "h", "left_semi").join(copies, "doc_id", "left_anti")
    return firsts.groupBy("doc_id").agg(F.collect_list("h").alias("survivors"))


def _levels(packed: DataFrame, survivors: DataFrame, lengths: list[int]) -> DataFrame:
    """(h, doc_id) of the windows of the last length that may repeat, level by level."""
    for k, (short, size) in enumerate(zip(lengths[:-1], lengths[1:], strict=True)):
        pairs = packed.join(survivors, "doc_id").mapInArrow(_next_windows(short, size, k == 0), PAIR)
        if size != lengths[-1]:
            survivors = _survivors(pairs)
    return pairs


def dedup_substrings(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words, n_removed, kept_text (kept words joined by one space).

    A word goes if some ``window``-word window over it also starts in a document
    of smaller doc_id. Windows are told apart by 64-bit hashes. Null and empty
    texts, and texts shorter than a window, lose nothing; within one document a
    repeat is no repeat; rows that share a doc_id are judged each alone; a null
    doc_id is smaller or larger than none, so such rows lose nothing. Whole texts
    are read. Only doc_id (a long) and text are read, so extra columns do no
    harm. An empty table gives an empty result.
    """
    docs = docs.select("doc_id", "text")  # no cast: it would keep Spark from seeing that two joins read the same shuffle
    known = docs.where("doc_id is not null")
    copies = later_copies(known)
    # the filter is what an inner join would add; with it the joins below read the same shuffle
    packed = known.mapInArrow(_packed, PACKED).where("doc_id is not null")
    lengths = doubled_lengths(window)
    full = _levels(packed, _first_level(known, lengths, copies), lengths)
    remove = full.join(_repeated(full), "h").where("doc_id > lo").groupBy("doc_id").agg(F.collect_list("h").alias("remove"))
    marks = remove.join(copies, "doc_id", "full_outer")
    marked = packed.join(marks, "doc_id", "left").select("doc_id", "packed", "bytes", "remove", "copy")
    nameless = docs.where("doc_id is null").mapInArrow(_packed, PACKED).select("doc_id", "packed", "bytes", F.lit(None).cast("array<long>").alias("remove"), F.lit(None).cast("boolean").alias("copy"))
    return marked.unionByName(nameless).mapInArrow(_removed(window), "doc_id long, n_words long, n_removed long, kept_text string")


def longest_repeats(docs: DataFrame, window: int = 13) -> DataFrame:
    """doc_id, n_words: the longest of the lengths ``window``, twice it, four times it ... at which the document repeats another one.

    Levels go on until no candidate survives, so their number is the logarithm
    of the longest repeat. Documents without a repeat of ``window`` words, null
    doc_ids and texts don't appear; whole copies count as any repeat.
    """
    known = docs.select("doc_id", "text").where("doc_id is not null")
    packed = known.mapInArrow(_packed, PACKED).where("doc_id is not null")
    lengths, none = doubled_lengths(window), known.select("doc_id").limit(0)
    survivors = cut(_survivors(_levels(packed, _first_level(known, lengths, none), lengths)))
    size, found = window, None
    while not survivors.isEmpty():
        level = survivors.select("doc_id", F.lit(size).alias("n_words"))
        found = level if found is None else found.unionByName(level)
        survivors = cut(_survivors(packed.join(survivors, "doc_id").mapInArrow(_next_windows(size, 2 * size, False), PAIR)))
        size *= 2
    return survivors.select("doc_id", F.lit(size).alias("n_words")) if found is None else found.groupBy("doc_id").agg(F.max("n_words").alias("n_words"))


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return dedup_substrings(docs, 13).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))
