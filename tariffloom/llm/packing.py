"""Packing of tokenised documents into fixed-length sequences, online and in bounded space.

Each partition keeps a fixed number of open windows. Whole blocks of a document
are sequences of their own; what remains of it goes best-fit into the open
windows. When none fits, the fullest window is topped up with the head of the
piece and emitted, and the rest is placed again. At the end of a partition the
open windows are merged: their pieces are dealt anew to full sequences, and the
last, partly filled one is cut at powers of two. No row leaves its partition, so
there is neither a shuffle nor anything to collect.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import table
from .textops import slices

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, sequence_length long"
VOCABULARY = 700_000


def _byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself if printable, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Letters(dict):
    """For ``str.translate``: each character as the stand-ins of its UTF-8 bytes."""

    BYTES = _byte_letters()

    def __missing__(self, char: int) -> str:
        self[char] = out = "".join(self.BYTES[b] for b in chr(char).encode())
        return out


class Ragged:
    """A growing list of id lists, stored flat."""

    def __init__(self):
        self.flat, self.at, self.n = np.zeros(1 << 12, dtype=np.uint16), np.zeros(1 << 12, dtype=np.int64), 0

    def extend(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        ends = self.at[self.n] + np.cumsum(sizes)
        while self.n + len(sizes) + 1 > len(self.at):
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        while len(ends) and ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.at[self.n] : self.at[self.n] + len(ids)] = ids
        self.at[self.n + 1 : self.n + 1 + len(sizes)] = ends
        self.n += len(sizes)

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists of these numbers one after another, and their sizes."""
        first, sizes = self.at[which], self.at[which + 1] - self.at[which]
        ends = np.cumsum(sizes)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - ends + sizes, sizes)], sizes


class WordCache:
    """Token ids of texts, by way of their distinct words and those words' distinct pieces.

    The tokenizer drops white space and cuts the rest, normalised, into pieces
    by a pattern; its model then works on each piece alone. So a word's ids don't
    depend on its neighbours, and each distinct piece is given to the model
    once while it stays in the cache. The cache starts anew beyond ``VOCABULARY``
    words, so its memory is bounded. Texts with spellings of special tokens, or
    with separators on which Python's and the tokenizer's idea of white space
    differ, go to the tokenizer whole.
    """

    PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+|\n"
    ODD = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pieces = regex.compile(self.PIECES)
        self.letters = _Letters()
        self.clear()

    def clear(self) -> None:
        self.words: dict[str, int] = {}
        self.word_ids = Ragged()
        self.parts: dict[str, int] = {"\n": 0}
        self.part_ids = Ragged()
        self.part_ids.extend(np.zeros(0, np.uint16), np.zeros(1, np.int64))

    def _learn(self, words: list[str]) -> None:
        joined = "\n".join([*words, ""])
        if not joined.isascii():
            joined = unicodedata.normalize("NFC", joined).replace("\u03a3", "\u03c3")
        cut = self.pieces.findall(joined.lower())
        new = [p for p in dict.fromkeys(cut) if p not in self.parts]
        ids = [[t.id for t in self.model.tokenize(p.translate(self.letters))] for p in new]
        self.part_ids.extend(np.fromiter(chain.from_iterable(ids), np.uint16), np.fromiter(map(len, ids), np.int64, len(ids)))
        self.parts.update(zip(new, range(len(self.parts), len(self.parts) + len(new)), strict=True))
        which = np.fromiter(map(self.parts.__getitem__, cut), np.int64, len(cut))
        flat, sizes = self.part_ids.take(which)
        self.word_ids.extend(flat, np.diff(np.cumsum(sizes)[which == 0], prepend=0))
        self.words.update(zip(words, range(len(self.words), len(self.words) + len(words)), strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        odd = {k for k, t in enumerate(texts) if any(x in t for x in self.ODD)}
        split = [[] if k in odd else t.split() for k, t in enumerate(texts)]
        words = list(chain.from_iterable(split))
        flat, sizes = [np.zeros(0, dtype=np.uint16)], [np.zeros(0, dtype=np.int64)]
        for k in range(0, len(words), VOCABULARY // 2):
            part = words[k : k + VOCABULARY // 2]
            which = np.fromiter(map(self.words.get, part, repeat(-1)), np.int64, len(part))
            missing = np.flatnonzero(which < 0).tolist()
            if missing:
                new = list(dict.fromkeys([part[i] for i in missing]))
                if len(self.words) + len(new) > VOCABULARY:
                    self.clear()
                    new, missing = list(dict.fromkeys(part)), range(len(part))
                self._learn(new)
                which[missing] = [self.words[part[i]] for i in missing]
            ids, size = self.word_ids.take(which)
            flat.append(ids)
            sizes.append(size)
        bounds = np.concatenate([[0], np.cumsum(np.concatenate(sizes))])[np.cumsum([0, *map(len, split)])]
        every = np.concatenate(flat)
        out = [every[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        for k in odd:
            out[k] = np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, dtype=np.uint16)
        return out


@lru_cache(maxsize=1)
def word_cache(path: str) -> WordCache:
    """One cache for each worker process, so that later tasks find what earlier ones learned."""
    return WordCache(path)


class Windows:
    """The open windows of one partition. A piece is (document number, start, length)."""

    def __init__(self, size: int, most: int, least_cut: int):
        self.size, self.most, self.least_cut = size, most, least_cut
        self.open: list[tuple[int, list]] = []

    def add(self, piece: tuple[int, int, int]) -> Iterator[list]:
        """Places a piece shorter than a window; yields the windows that this closes."""
        doc, start, length = piece
        while length:
            fits = [k for k, (used, _) in enumerate(self.open) if used + length <= self.size]
            if fits:
                k = max(fits, key=lambda k: self.open[k][0])
                used, pieces = self.open[k]
                pieces.append((doc, start, length))
                self.open[k] = (used + length, pieces)
                if used + length == self.size:
                    yield self.open.pop(k)[1]
                return
            if len(self.open) < self.most:
                self.open.append((length, [(doc, start, length)]))
                return
            k = max(range(len(self.open)), key=lambda k: self.open[k][0])
            used, pieces = self.open.pop(k)
            room = self.size - used
            if room >= self.least_cut:
                pieces.append((doc, start, room))
                start, length = start + room, length - room
            yield pieces

    def merge(self) -> Iterator[list]:
        """Deals the pieces of all open windows anew, fullest window first: full windows, then sizes that are powers of two."""
        pieces = [p for _, own in sorted(self.open, key=lambda w: -w[0]) for p in own]
        left = sum(p[2] for p in pieces)
        self.open = []
        target, used, now = 0, 0, []
        for doc, start, length in pieces:
            while length:
                if not used:
                    target = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                take = min(length, target - used)
                now.append((doc, start, take))
                start, length, used, left = start + take, length - take, used + take, left - take
                if used == target:
                    yield now
                    used, now = 0, []


def _pack(path: str, size: int, most: int, least_cut: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, windows = word_cache(path), Windows(size, most, least_cut)
        sequence = TaskContext.get().partitionId() << 33
        kept: dict[int, list] = {}  # documents with pieces in open windows: id, ids, pieces left there
        out: list[list] = [[] for _ in range(8)]
        number = held = 0

        def emit(pieces: list) -> None:
            nonlocal sequence, held
            offset, total = 0, sum(p[2] for p in pieces)
            for doc, start, length in pieces:
                doc_id, ids, first, count = kept[doc]
                raw = ids[start - first : start - first + length].astype("<u4").tobytes()
                for column, value in zip(out, (doc_id, start, length, raw, count, sequence, offset, total), strict=True):
                    column.append(value)
                offset += length
                held += length
            sequence += 1

        def flush() -> pa.RecordBatch:
            nonlocal out, held
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
            made = pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])
            out, held = [[] for _ in range(8)], 0
            return made

        for batch in batches:
            for part in slices(batch, "text"):
                encoded = cache.encode([t or "" for t in part.column("text").to_pylist()])
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoded, strict=True):
                    ids = np.append(ids, np.uint16(end_id))
                    kept[number] = [doc_id, ids, 0, len(ids)]
                    full = len(ids) // size * size
                    for start in range(0, full, size):
                        emit([(number, start, size)])
                    if full < len(ids):
                        kept[number] = [doc_id, ids[full:].copy(), full, len(ids)]
                        for closed in windows.add((number, full, len(ids) - full)):
                            emit(closed)
                    number += 1
                    if held > 1 << 19:
                        yield flush()
                live = {p[0] for _, own in windows.open for p in own}
                kept = {d: v for d, v in kept.items() if d in live}
        for closed in windows.merge():
            emit(closed)
        yield flush()

    return run


def pack_documents(docs: DataFrame, tokenizer: str, size: int = 2048, windows: int = 64, least_cut: int = 16, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, start, length, ids (little-endian uint32), doc_tokens, sequence_id, offset, sequence_length.

    A document's ids are the tokenizer's for its text (none for a null or empty
    one) and ``end_id``. Every id is in exactly one piece. Sequences hold ``size``
    ids but for fewer than ``least_cut`` at the end of some, and but for a
    partition's last ones, whose lengths are powers of two. Rows that share a
    doc_id are packed each as a document; a null doc_id stays null; only doc_id
    and text are read; an empty table gives no rows. A retried task reads the
    same rows and so repeats the same sequences.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_pack(tokenizer, size, windows, least_cut, end_id), SCHEMA)


def op2_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    packed = pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
