"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees, boosted in turn over the features, sum up to one lookup table per
feature over its bins; the strongest pairs get tables over two features. A
score is the sum of table entries at a document's bins, for many at once.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .labelled import held_out, labelled_sample
from .shared import table
from .textops import SPACE, Words, mix, powers, slices

FEATURES = (
    "log_words", "word_bytes", "upper", "digits", "symbols", "stops", "shouts", "bars", "not_ascii", "symbol_ends", "capital_words",
    "next_equal", "distinct", "top_word", "repeated_threes", "equal_lines", "words_a_line", "words_a_stop", "longest_word", "short_words",
)


def _class(chars: str) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    out[[ord(c) for c in chars]] = True
    return out


_UPPER, _DIGIT, _SYMBOL, _STOP, _SHOUT, _BAR = map(_class, ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "#*$%&|<>", ".,;:!?", "!", "|"))
_HIGH = np.arange(256) >= 128


def _by_key(doc: np.ndarray, hashes: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row: how many different hashes, and the largest number of equal ones."""
    distinct, most = np.zeros(rows), np.zeros(rows)
    if len(doc):
        _, at, count = np.unique(mix(hashes + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True, return_counts=True)
        distinct = np.bincount(doc[at], minlength=rows).astype(float)
        np.maximum.at(most, doc[at], count)
    return distinct, most


def _lines(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Row and hash of each line that isn't blank."""
    raw, n = words.raw, len(words.raw)
    ends = np.flatnonzero(raw == 10)
    cuts = np.unique(np.concatenate([words.offsets, ends, ends + 1]))
    a, b = cuts[:-1], cuts[1:]
    solid = np.concatenate([[0], np.cumsum(~SPACE[raw])])
    keep = solid[b] > solid[a]
    a, b = a[keep], b[keep]
    up, down = powers(0x9E3779B97F4A7C15 | 1, n + 1)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n], out=sums[1:])
    return np.searchsorted(words.offsets, a, side="right") - 1, mix((sums[b] - sums[a]) * down[a])


def measure(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text; a null or empty text has zeros."""
    words, rows = Words(column), len(column)
    n = np.diff(words.first).astype(float)
    size = np.diff(words.offsets).astype(float)
    one, word_one = np.maximum(size, 1), np.maximum(n, 1)

    def share(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[words.raw])])
        return np.diff(sums[words.offsets]) / one

    def word_share(flags: np.ndarray) -> np.ndarray:
        return np.bincount(words.doc[flags], minlength=rows) / word_one

    length = words.end - words.start
    first, last = (words.raw[words.start], words.raw[words.end - 1]) if len(length) else (np.zeros(0, np.uint8),) * 2
    equal = np.zeros(len(length), dtype=bool)
    equal[1:] = (words.hash[1:] == words.hash[:-1]) & (words.doc[1:] == words.doc[:-1])
    distinct, top = _by_key(words.doc, words.hash, rows)
    threes = words.whole(3)
    three_distinct, _ = _by_key(words.doc[threes], words.windows(3)[threes] if len(threes) else np.zeros(0, np.uint64), rows)
    line_doc, line_hash = _lines(words)
    lines = np.bincount(line_doc, minlength=rows).astype(float)
    line_distinct, _ = _by_key(line_doc, line_hash, rows)
    longest = np.zeros(rows)
    np.maximum.at(longest, words.doc, length)
    stops = share(_STOP) * one
    three = np.maximum(n - 2, 0)
    return np.column_stack([
        np.log1p(n), np.bincount(words.doc, weights=length, minlength=rows) / word_one, share(_UPPER), share(_DIGIT), share(_SYMBOL), stops / one, share(_SHOUT), share(_BAR), share(_HIGH),
        word_share(_SYMBOL[last]), word_share(_UPPER[first] & (length > 1) & _UPPER[words.raw[np.minimum(words.start + 1, max(len(words.raw) - 1, 0))]]) if len(length) else np.zeros(rows),
        word_share(equal), distinct / word_one, top / word_one, np.where(three > 0, 1 - three_distinct / np.maximum(three, 1), 0), np.where(lines > 0, 1 - line_distinct / np.maximum(lines, 1), 0),
        n / np.maximum(lines, 1), n / (stops + 1), longest, word_share(length <= 2),
    ])


@dataclass
class AdditiveModel:
    cuts: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int]]
    pair_cuts: list[tuple[np.ndarray, np.ndarray]]
    pair_tables: list[np.ndarray]
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for j, (cuts, t) in enumerate(zip(self.cuts, self.tables, strict=True)):
            total += t[np.searchsorted(cuts, x[:, j], side="right")]
        for (a, b), (ca, cb), t in zip(self.pairs, self.pair_cuts, self.pair_tables, strict=True):
            total += t[np.searchsorted(ca, x[:, a], side="right"), np.searchsorted(cb, x[:, b], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _cuts(x: np.ndarray, most: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, most + 1)[1:-1], method="higher"))


def _best(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best split of bins in two."""
    a, b, l2 = np.cumsum(g)[:-1], np.cumsum(h)[:-1], 1.0
    if not len(a):
        return 0.0, 0
    gain = a * a / (b + l2) + (g.sum() - a) ** 2 / (h.sum() - b + l2) - g.sum() ** 2 / (h.sum() + l2)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The values of a tree of depth two over bins."""
    out = np.zeros(len(g))
    _, k = _best(g, h)
    for side in ((0, k), (k, len(g))):
        a, b = side
        if a == b:
            continue
        gain, m = _best(g[a:b], h[a:b])
        for lo, hi in ((a, a + m), (a + m, b)) if gain > 0 else ((a, b),):
            if hi > lo:
                out[lo:hi] = -g[lo:hi].sum() / (h[lo:hi].sum() + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Splits the first feature, then the second one in each half; the gain and the values."""
    best, out = 0.0, np.zeros_like(g)
    base = g.sum() ** 2 / (h.sum() + 1.0)
    for k in range(1, g.shape[0]):
        gain, values = -base, np.zeros_like(g)
        for half in (slice(0, k), slice(k, None)):
            gg, hh = g[half].sum(axis=0), h[half].sum(axis=0)
            more, m = _best(gg, hh)
            gain += more + gg.sum() ** 2 / (hh.sum() + 1.0)
            for part in (slice(0, m), slice(m, None)):
                values[half, part] = -gg[part].sum() / (hh[part].sum() + 1.0)
        if gain > best:
            best, out = gain, values
    return best, out


def fit_additive(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, bins: int = 48, pair_bins: int = 8, pairs: int = 6, rate: float = 0.15) -> AdditiveModel:
    """Boosts the log loss cyclically over single features, then over the pairs that promise most on what is left."""
    mean = np.clip(y.mean() if len(y) else 0.5, 1e-3, 1 - 1e-3)
    bias = float(np.log(mean / (1 - mean)))
    if len(y) == 0 or y.min() == y.max():
        n = x.shape[1] if x.ndim == 2 else len(FEATURES)
        return AdditiveModel([np.zeros(0)] * n, [np.zeros(1)] * n, [], [], [], bias)
    total = np.full(len(y), bias)
    cuts = [_cuts(x[:, j], bins) for j in range(x.shape[1])]
    places = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(cuts)]
    tables = [np.zeros(len(c) + 1) for c in cuts]

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return p - y, np.maximum(p * (1 - p), 1e-6)

    for _ in range(rounds):
        for j, place in enumerate(places):
            g, h = slopes()
            step = rate * _tree(np.bincount(place, g, len(tables[j])), np.bincount(place, h, len(tables[j])))
            tables[j] += step
            total += step[place]
    coarse = [_cuts(x[:, j], pair_bins) for j in range(x.shape[1])]
    small = [np.searchsorted(c, x[:, j], side="right") for j, c in enumerate(coarse)]

    def histogram(a: int, b: int, w: np.ndarray) -> np.ndarray:
        na, nb = len(coarse[a]) + 1, len(coarse[b]) + 1
        return np.bincount(small[a] * nb + small[b], w, na * nb).reshape(na, nb)

    g, h = slopes()
    gains = sorted(((_pair_tree(histogram(a, b, g), histogram(a, b, h))[0], a, b) for a in range(x.shape[1]) for b in range(a)), reverse=True)
    chosen = [(a, b) for gain, a, b in gains[:pairs] if gain > 0]
    pair_tables = [np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1)) for a, b in chosen]
    for _ in range(pair_rounds):
        for t, (a, b) in zip(pair_tables, chosen, strict=True):
            g, h = slopes()
            step = rate * _pair_tree(histogram(a, b, g), histogram(a, b, h))[1]
            t += step
            total += step[small[a], small[b]]
    return AdditiveModel(cuts, tables, chosen, [(coarse[a], coarse[b]) for a, b in chosen], pair_tables, bias)


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text"):
            x = measure(part.column("text"))
            yield pa.record_batch([part.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), x.shape[1]).cast(pa.list_(pa.float64()))], names=["label", "x"])


def fit_quality(docs: DataFrame, labels: DataFrame, most: int = 20_000, **options) -> AdditiveModel:
    """Fits on at most ``most`` documents with a quality label that aren't held out."""
    sample = labelled_sample(docs, labels, "quality", ~held_out(5, 0), most)
    rows = sample.select(F.col("label"), "text").mapInArrow(_measured, "label int, x array<double>").collect()
    rows.sort(key=lambda r: (r.label, r.x))
    x = np.array([r.x for r in rows], dtype=float).reshape(-1, len(FEATURES))
    return fit_additive(x, np.array([r.label for r in rows], dtype=float), **options)


def _scored(model: AdditiveModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                score = model.score(measure(part.column("text")))
                yield pa.record_batch([*part.columns, pa.array(score)], names=[*part.schema.names, "__score"])

    return run


def score_quality(docs: DataFrame, model: AdditiveModel) -> DataFrame:
    """docs with a column ``__score`` from 0 to 1, higher for better texts; from the text alone.

    Rows are judged alone, so ties, repeated rows and nulls in other columns are
    harmless; a null text scores as an empty one; texts are measured whole; an
    empty table gives no rows. Other columns pass as they are, but one named
    ``__score`` is replaced.
    """
    docs = docs.drop("__score")
    schema = T.StructType([*docs.schema.fields, T.StructField("__score", T.DoubleType())])
    return docs.mapInArrow(_scored(model), schema)


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, fit_quality(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), F.col("__score").alias("score"), (F.col("__score") >= 0.3).cast("int").alias("predicted"))
