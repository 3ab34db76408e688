"""Vectorised words, word hashes and window hashes over Arrow string columns.

A word is a maximal run of bytes outside ``\\x20\\x09-\\x0D``. All white space
is ASCII, so UTF-8 bytes can be scanned as they are. Texts are processed in
slices of about ``SLICE_BYTES``, which bounds a task's memory whatever the size
of the Arrow batch; a single longer text makes a slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, dtype=bool)
SPACE[[32, *range(9, 14)]] = True
BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
_U = np.uint64


@lru_cache(maxsize=8)
def _powers(base: int, log2: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base and of its inverse modulo 2**64."""
    out = []
    for b in (base, pow(base, -1, 1 << 64)):
        p = np.full(1 << log2, b, dtype=_U)
        p[0] = 1
        out.append(np.multiply.accumulate(p))
    return out[0], out[1]


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(base, max(16, int(n).bit_length()))
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(sizes), 0
    while start < batch.num_rows:
        base = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, base + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The column's bytes and its offsets into them; a null counts as an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, at - at[0]


class Words:
    """The words of a slice of texts: byte bounds, row of each word, first word of each row, 64-bit hashes."""

    def __init__(self, column: pa.Array):
        self.split(*text_bytes(column))

    def split(self, raw: np.ndarray, offsets: np.ndarray) -> None:
        self.raw, self.offsets = raw, offsets
        n = len(raw)
        solid = ~SPACE[self.raw]
        edge = np.zeros(n + 1, dtype=bool)
        edge[self.offsets] = True
        before = np.zeros(n, dtype=bool)
        before[1:] = solid[:-1]
        after = np.zeros(n, dtype=bool)
        after[:-1] = solid[1:]
        self.start = np.flatnonzero(solid & (~before | edge[:n]))
        self.end = np.flatnonzero(solid & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, self.offsets)
        self.doc = np.repeat(np.arange(len(offsets) - 1), np.diff(self.first))
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        n = len(self.raw)
        up, down = powers(BYTE_BASE, n + 1)
        sums = np.zeros(n + 1, dtype=_U)
        np.cumsum((self.raw.astype(_U) + _U(1)) * up[:n], out=sums[1:])
        return mix((sums[self.end] - sums[self.start]) * down[self.start])

    def windows(self, n: int) -> np.ndarray:
        """Hash of the n words from each position on; positions whose window crosses a row hold junk."""
        m = len(self.hash)
        if m < n:
            return np.zeros(0, dtype=_U)
        up, down = powers(WORD_BASE, m + 1)
        sums = np.zeros(m + 1, dtype=_U)
        np.cumsum(self.hash * up[:m], out=sums[1:])
        return mix((sums[n:] - sums[:-n]) * down[: m - n + 1] + _U(n))

    def whole(self, n: int) -> np.ndarray:
        """Positions whose n words are of one row."""
        if len(self.doc) < n:
            return np.zeros(0, dtype=np.int64)
        return np.flatnonzero(self.doc[n - 1 :] == self.doc[: len(self.doc) - n + 1])

    def minimizers(self, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each whole n-word window: its start, where its k-gram of least hash starts, and that hash.

        Equal windows have equal minimizers, so a window can repeat only if its minimizer does.
        """
        grams = self.windows(k)
        count = len(self.hash) - n + 1
        if count <= 0:
            none = np.zeros(0, dtype=np.int64)
            return none, none, np.zeros(0, dtype=_U)
        best, at = grams[:count].copy(), np.zeros(count, dtype=np.int64)
        for j in range(1, n - k + 1):
            less = grams[j : j + count] < best
            np.copyto(best, grams[j : j + count], where=less)
            at[less] = j
        starts = self.whole(n)
        return starts, starts + at[starts], best[starts]


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)
