"""Self-join of documents on the Jaccard similarity of their word n-grams, with Bayesian pruning.

1. Documents with equal shingle sets form a class (a map-side combined group on
   a 128-bit key); only the class's least doc_id goes on.
2. MinHash bands put representatives into buckets. A bucket is compared in
   blocks of bounded size, never as a list of pairs.
3. Within a block, MinHash values are compared a few at a time; a pair is
   dropped once the posterior probability that its similarity reaches the
   threshold falls below the tolerance. Survivors give groups (components).
4. Each group is compared once more in blocks, now with the shingle sets: pairs
   that pass the same pruning are verified exactly. A block returns link counts
   and a spanning forest, so its output is linear in its rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components
from .shared import cut, join_groups, table
from .textops import Words, mix, signed, slices

HASHES, ROWS, STEP, BLOCK = 64, 4, 16, 512
BLOCK_SHINGLES = 1 << 18  # two blocks are held at once
_U = np.uint64


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    x = mix(np.arange(1, 2 * HASHES + 1, dtype=_U))
    return (x[:HASHES] | _U(1)).astype(np.uint32), x[HASHES:].astype(np.uint32)


def shingle_sets(column: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all rows, one after another, and each row's bounds.

    A text of fewer than n words is one shingle of all its words; a text without words has none.
    """
    words = Words(column)
    rows = len(column)
    starts = words.whole(n)
    ids, values = words.doc[starts], words.windows(n)[starts]
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        extra = np.array([np.bitwise_xor.reduce(mix(words.hash[words.first[r] : words.first[r + 1]] + np.arange(1, counts[r] + 1, dtype=_U))) for r in short], dtype=_U)
        ids, values = np.concatenate([ids, short]), np.concatenate([values, extra])
    order = np.lexsort((values, ids))
    ids, values = ids[order], values[order]
    new = np.ones(len(ids), dtype=bool)
    new[1:] = (ids[1:] != ids[:-1]) | (values[1:] != values[:-1])
    ids, values = ids[new], values[new]
    return values, np.searchsorted(ids, np.arange(rows + 1))


def signatures(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """MinHash values of the rows that have shingles, as uint32 of shape (rows, HASHES)."""
    starts = bounds[:-1][np.diff(bounds) > 0]
    out = np.zeros((len(starts), HASHES), dtype=np.uint32)
    if len(starts):
        low = (values >> _U(32)).astype(np.uint32)
        for k, (a, b) in enumerate(zip(*_seeds(), strict=True)):
            v = low * a + b
            v ^= v >> np.uint32(15)
            out[:, k] = np.minimum.reduceat(v * np.uint32(0x85EBCA6B), starts)
    return out


def _sketch(n: int):
    """doc_id, 128-bit key of the shingle set, signature, number of shingles; nothing for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, bounds = shingle_sets(part.column("text"), n)
                has = np.flatnonzero(np.diff(bounds) > 0)
                if not len(has):
                    continue
                starts = bounds[:-1][has]
                keys = [signed(np.add.reduceat(mix(values ^ _U(salt)), starts)) for salt in (0x5BD1E995, 0x1B873593)]
                sig = signatures(values, bounds)
                sigs = pa.FixedSizeListArray.from_arrays(pa.array(sig.ravel().view(np.int32)), HASHES).cast(pa.list_(pa.int32()))
                yield pa.record_batch([part.column("doc_id").take(pa.array(has)), pa.array(keys[0]), pa.array(keys[1]), sigs, pa.array(np.diff(bounds)[has])], names=["doc_id", "k1", "k2", "sig", "size"])

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                values, bounds = shingle_sets(part.column("text"), n)
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(signed(values)))
                yield pa.record_batch([part.column("doc_id"), lists], names=["doc_id", "shingles"])

    return run


@lru_cache(maxsize=8)
def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For each number of compared values, the fewest matches with P(similarity >= threshold) >= tolerance under a uniform prior."""
    x = (np.arange(20_000) + 0.5) / 20_000
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        for m in range(n + 1):
            log = m * np.log(x) + (n - m) * np.log1p(-x)
            p = np.exp(log - log.max())
            if p[x >= threshold].sum() / p.sum() >= tolerance:
                out[n] = m
                break
    return out


def surviving(a: np.ndarray, b: np.ndarray, threshold: float, tolerance: float, upper: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs of two signature blocks that pass every pruning step; upper: i < j only."""
    need = least_matches(threshold, tolerance)
    same = np.zeros((len(a), len(b)), dtype=np.uint8)
    for k in range(STEP):
        same += a[:, k, None] == b[None, :, k]
    alive = same >= need[STEP]
    if upper:
        alive &= np.arange(len(a))[:, None] < np.arange(len(b))[None, :]
    i, j = np.nonzero(alive)
    got = same[i, j].astype(np.int32)
    for n in range(2 * STEP, HASHES + 1, STEP):
        got = got + (a[i, n - STEP : n] == b[j, n - STEP : n]).sum(axis=1)
        ok = got >= need[n]
        i, j, got = i[ok], j[ok], got[ok]
    return i, j


def _incidence(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) entries of the shingles that two rows or more have, columns numbered from 0."""
    rows = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    _, column, count = np.unique(np.concatenate(lists), return_inverse=True, return_counts=True)
    new = np.cumsum(count > 1) - 1
    keep = count[column] > 1
    return rows[keep], new[column[keep]]


def overlaps(lists: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of sets i and j, pair by pair; for many pairs by blocks of a 0/1 product."""
    if len(i) <= 4 * len(lists):
        return np.array([len(np.intersect1d(lists[x], lists[y], assume_unique=True)) for x, y in zip(i, j, strict=True)], dtype=np.int64)
    rows, columns = _incidence(lists)
    total = np.zeros(len(i), dtype=np.int64)
    width = 2048
    order = np.argsort(columns, kind="stable")
    rows, columns = rows[order], columns[order]
    for c in range(0, int(columns[-1]) + 1 if len(columns) else 0, width):
        a, b = np.searchsorted(columns, [c, c + width])
        block = np.zeros((len(lists), width), dtype=np.float32)
        block[rows[a:b], columns[a:b] - c] = 1
        total += (block @ block.T)[i, j].astype(np.int64)
    return total


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Least index of each of n nodes' component under the edges (i, j)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of the rows of one key, from batches sorted by it."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.flatnonzero(np.any([c[1:] != c[:-1] for c in columns], axis=0)) + 1
        cuts = [0, *change.tolist(), batch.num_rows]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            key = tuple(c[a] for c in columns)
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return column.combine_chunks().values.to_numpy(zero_copy_only=False).reshape(-1, HASHES)


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """Row numbers of the two blocks that meet in this group; one block against itself gives the same rows twice."""
    i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
    own = table.column("own").to_numpy()
    return np.flatnonzero(own == i), np.flatnonzero(own == j), i == j


def _candidates(threshold: float, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, ["g", "i", "j"]):
            ids, sig = group.column("doc_id").to_numpy(), _matrix(group.column("sig"))
            a, b, alone = _sides(group)
            i, j = surviving(sig[a], sig[b], threshold, tolerance, alone)
            label = forest(len(ids), a[i], b[j])
            move = np.flatnonzero(label != np.arange(len(ids)))
            if len(move):
                yield pa.record_batch([pa.array(ids[move]), pa.array(ids[label[move]])], names=["u", "v"])

    return run


def _verified(threshold: float, tolerance: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _runs(batches, ["g", "i", "j"]):
            ids, sig = group.column("doc_id").to_numpy(), _matrix(group.column("sig"))
            lists = [x.values.to_numpy(zero_copy_only=False) for x in group.column("shingles")]
            size = np.array([len(x) for x in lists])
            a, b, alone = _sides(group)
            i, j = surviving(sig[a], sig[b], threshold, tolerance, alone)
            i, j = a[i], b[j]
            fits = np.minimum(size[i], size[j]) >= threshold * np.maximum(size[i], size[j]) - 1e-9
            i, j = i[fits], j[fits]
            if not len(i):
                continue
            both = overlaps(lists, i, j)
            linked = both >= threshold * (size[i] + size[j] - both) - 1e-9
            i, j = i[linked], j[linked]
            links = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
            label = forest(len(ids), i, j)
            some = np.flatnonzero(links)
            yield pa.record_batch([pa.array(ids[some]), pa.array(ids[label[some]]), pa.array(links[some].astype(np.int64))], names=["u", "v", "links"])

    return run


def _blocked(members: DataFrame, block: int) -> DataFrame:
    """Members (g, doc_id, n, weight) of groups of n rows, dealt to pairs of blocks (i, j) with i <= j; a block holds about ``block`` rows, and BLOCK_SHINGLES of the group's ``weight``."""
    dealt = members.withColumn("blocks", F.greatest(F.ceil(F.col("n") / block), F.ceil(F.col("weight") / BLOCK_SHINGLES)).cast("int")).withColumn("own", F.expr("cast(pmod(xxhash64(doc_id, 11), blocks) as int)"))
    return dealt.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)"))).select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id")


def _grouped(frame: DataFrame) -> DataFrame:
    return frame.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j", "doc_id")


def jaccard_classes(docs: DataFrame, n: int = 5, threshold: float = 0.8, tolerance: float = 1e-4, block: int = BLOCK) -> DataFrame:
    """doc_id, text_id, class_id, n_links for each row of docs.

    text_id is the least doc_id with the same shingle set, class_id the least
    doc_id of the connected group of links, n_links the number of other text_ids
    with a similarity of ``threshold`` or more to this one. A null text counts as
    empty; texts without words have no shingles, link to nothing and are their
    own class. Texts of fewer than n words are compared as one shingle, so they
    link only if equal word by word. Only doc_id and text are read; rows with a
    null doc_id are returned with null ids and no links; rows that share a doc_id
    share the least of their text_ids. Whole texts are read; an empty table gives
    no rows.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    known = docs.where("doc_id is not null")
    sketch = cut(known.mapInArrow(_sketch(n), "doc_id long, k1 long, k2 long, sig array<int>, size long"))
    first = sketch.groupBy("k1", "k2").agg(F.min("doc_id").alias("text_id"), F.count("*").alias("n"))
    texts = cut(join_groups(sketch.select("doc_id", "k1", "k2"), first, ["k1", "k2"], "text_id").select("doc_id", "text_id"))
    kept = sketch.join(texts.where("doc_id = text_id"), "doc_id", "left_semi").select("doc_id", "sig", "size").dropDuplicates(["doc_id"])
    bands = F.array(*[F.xxhash64(F.lit(b), *[F.get("sig", F.lit(b * ROWS + r)) for r in range(ROWS)]) for b in range(HASHES // ROWS)])
    in_bands = kept.select("doc_id", F.explode(bands).alias("g"))
    shared = in_bands.groupBy("g").agg(F.count("*").alias("n")).where("n > 1")
    members = _blocked(in_bands.join(shared, "g").withColumn("weight", F.lit(0)), block).join(kept.drop("size"), "doc_id")  # signatures have one size
    near = components(_grouped(members).mapInArrow(_candidates(threshold, tolerance), "u long, v long"), "u", "v")
    groups = cut(near.withColumnRenamed("root", "g").withColumnRenamed("node", "doc_id"))
    sizes = groups.join(kept.select("doc_id", "size"), "doc_id").groupBy("g").agg(F.count("*").alias("n"), F.sum("size").alias("weight"))
    shingles = known.join(groups.select("doc_id"), "doc_id", "left_semi").mapInArrow(_sets(n), "doc_id long, shingles array<long>").dropDuplicates(["doc_id"])
    pairs = _blocked(groups.join(sizes, "g"), block).join(kept.drop("size").join(shingles, "doc_id"), "doc_id")
    found = cut(_grouped(pairs).mapInArrow(_verified(threshold, tolerance), "u long, v long, links long"))
    roots = components(found.select("u", "v"), "u", "v").select(F.col("node").alias("text_id"), "root")
    links = found.groupBy(F.col("u").alias("text_id")).agg(F.sum("links").alias("links"))
    whole = texts.groupBy("doc_id").agg(F.min("text_id").alias("text_id")).join(links, "text_id", "left").join(roots, "text_id", "left").select("doc_id", "text_id", F.coalesce("root", "text_id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))
    return docs.select("doc_id").join(whole, "doc_id", "left").select("doc_id", F.coalesce("text_id", "doc_id").alias("text_id"), F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def keep_one_per_class(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs without later members of a class: the least doc_id of each stays, and every row without words."""
    later = jaccard_classes(docs, **options).where("doc_id != class_id").select("doc_id")
    return docs.join(later, "doc_id", "left_anti")


def op3_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))
