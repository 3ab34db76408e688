"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time, on windows of
labelled texts. It reads a whole text byte by byte in both directions, its state
running from the first byte to the last, and labels every position; a document's
probabilities are the mean over all its positions. Many texts are read side by
side, the longest first, so each step is a few products of matrices. The gates
use a clipped line in place of the logistic function, which takes a tenth of the
time; the candidate state uses the hyperbolic tangent.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .labelled import held_out
from .shared import table

READ_BYTES = 12 << 20  # texts read side by side; a longer text is read alone
STEPS = 32  # steps whose labels are computed at once
WIDE, NARROW = 512, 64  # texts that go through these steps together; of fewer, all steps' inputs are read at once
_F = np.float32


def _gate(a: np.ndarray) -> None:
    """The clipped line, in place."""
    np.maximum(a, 0, out=a)
    np.minimum(a, 1, out=a)


@dataclass
class LanguageModel:
    """Parameters of both directions, forward first; gates in the order reset, update, candidate."""

    labels: list[str]
    x: np.ndarray  # (2, 3 * hidden, 256): gate inputs by byte
    u: np.ndarray  # (2, 3 * hidden, hidden): recurrent weights
    out: np.ndarray  # (2, labels, hidden)
    bias: np.ndarray  # (labels,)

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.x, self.u, self.out, self.bias]

    def run(self, codes: np.ndarray, h: np.ndarray) -> np.ndarray:
        """The states after each of the bytes ``codes`` of shape (steps, 2, rows): what ``step`` gives, without new arrays in each step."""
        hidden, (steps, _, rows) = self.u.shape[2], codes.shape
        states = np.empty((steps, 2, hidden, rows), dtype=self.x.dtype)
        recurrent, gates, c = np.empty((2, 3 * hidden, rows), dtype=h.dtype), np.empty((2, 2 * hidden, rows), dtype=h.dtype), np.empty_like(states[0])
        of_gates, of_c, r, z = recurrent[:, : 2 * hidden], recurrent[:, 2 * hidden :], gates[:, :hidden], gates[:, hidden:]
        at_once = steps if rows < NARROW else 1  # of few texts the inputs of all steps are read at once
        for t in range(steps):
            if t % at_once == 0:
                inputs = np.stack([self.x[way].take(codes[t : t + at_once, way], axis=1, mode="clip") for way in (0, 1)]).transpose(2, 0, 1, 3)
                in_gates, in_c = inputs[:, :, : 2 * hidden], inputs[:, :, 2 * hidden :]
            new = states[t]
            np.matmul(self.u, h, out=recurrent)
            np.add(of_gates, in_gates[t % at_once], out=gates)
            _gate(gates)
            np.multiply(r, of_c, out=c)
            np.add(c, in_c[t % at_once], out=c)
            np.tanh(c, out=c)
            np.subtract(h, c, out=new)
            np.multiply(new, z, out=new)
            h = np.add(new, c, out=new)
        return states

    def step(self, codes: np.ndarray, h: np.ndarray, trace: list) -> np.ndarray:
        """The next states, (2, hidden, rows), after the bytes ``codes`` of shape (2, rows); ``trace`` keeps what ``back`` needs."""
        hidden = self.u.shape[2]
        a = np.empty((2, 3 * hidden, codes.shape[1]), dtype=self.x.dtype)
        for way in (0, 1):
            self.x[way].take(codes[way], axis=1, out=a[way], mode="clip")
        recurrent = np.matmul(self.u, h)
        gates = a[:, : 2 * hidden]
        gates += recurrent[:, : 2 * hidden]
        _gate(gates)
        r, z, hc = a[:, :hidden], a[:, hidden : 2 * hidden], recurrent[:, 2 * hidden :]
        c = r * hc
        c += a[:, 2 * hidden :]
        np.tanh(c, out=c)
        new = h - c
        new *= z
        new += c
        trace.append((h, r, z, c, hc))
        return new

    def back(self, codes: np.ndarray, trace: list, grads: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Gradients of x and u, given those of the states, (steps, 2, hidden, rows)."""
        steps, _, hidden, rows = grads.shape
        du, dh = np.zeros_like(self.u), np.zeros_like(grads[0])
        gates = np.empty((steps, 2, 3 * hidden, rows), dtype=grads.dtype)
        for t in range(steps - 1, -1, -1):
            h, r, z, c, hc = trace[t]
            dh = dh + grads[t]
            dc = dh * (1 - z) * (1 - c * c)
            g = gates[t]
            g[:, :hidden] = dc * hc * ((r > 0) & (r < 1))
            g[:, hidden : 2 * hidden] = dh * (h - c) * ((z > 0) & (z < 1))
            g[:, 2 * hidden :] = dc
            recurrent = g.copy()
            recurrent[:, 2 * hidden :] *= r
            du += recurrent @ h.transpose(0, 2, 1)
            dh = dh * z + self.u.transpose(0, 2, 1) @ recurrent
        dx = np.empty_like(self.x)
        for way in (0, 1):
            which = codes[:, way].ravel()
            for k in range(3 * hidden):
                dx[way, k] = np.bincount(which, gates[:, way, k].ravel(), 256)
        return dx, du

    def pooled(self, texts: list[bytes]) -> np.ndarray:
        """Per text the mean of its positions' label probabilities; zeros for an empty one.

        Both directions' label scores are kept step by step, 8 bytes a label for
        each byte of the texts, and meet position by position at the end. Steps go
        through WIDE texts at a time, whose states stay in the processor's cache.
        """
        size, kinds = np.fromiter(map(len, texts), np.int64, len(texts)), len(self.labels)
        order = np.argsort(-size, kind="stable")
        order = order[: int((size > 0).sum())]
        total = np.zeros((len(texts), kinds))
        if not len(order):
            return total
        raw = np.frombuffer(b"".join([texts[k] for k in order]), np.uint8)
        size = size[order]
        first, last = np.cumsum(size) - size, np.cumsum(size) - 1
        blocks, k, m, rows, row = [], 0, len(order), 0, np.zeros(size[0], dtype=np.int64)  # row: where each step's scores start
        while m:
            steps = min(STEPS, int(size[0]) - k)
            blocks.append((k, steps, m, rows))
            row[k : k + steps] = rows + m * np.arange(steps)
            rows, k = rows + steps * m, k + steps
            m = int(np.searchsorted(-size, -k, side="left"))
        ahead, behind = np.empty((2, kinds, rows), dtype=self.x.dtype)
        h = np.zeros((2, self.u.shape[2], len(order)), dtype=self.x.dtype)
        for k, steps, m, start in blocks:
            later = np.arange(k, k + steps)[:, None]
            for i in range(0, m, WIDE):
                of = slice(i, min(i + WIDE, m))
                places = np.stack([np.minimum(first[of] + later, len(raw) - 1), np.maximum(last[of] - later, 0)], axis=1)
                states = self.run(raw[places].astype(np.intp), np.ascontiguousarray(h[:, :, of]))
                h[:, :, of] = states[-1]
                scores = np.matmul(self.out, states).transpose(1, 2, 0, 3)
                for way, kept in enumerate((ahead, behind)):
                    kept[:, start : start + steps * m].reshape(kinds, steps, m)[:, :, of] = scores[way]
        pooled = np.zeros((len(order), kinds))
        for k, steps, m, start in blocks:
            scores = ahead[:, start : start + steps * m].reshape(kinds, steps, m)
            back = size[:m] - 1 - np.arange(k, k + steps)[:, None]  # the backward step at each position
            scores += behind.take(row[np.maximum(back, 0)] + np.arange(m), axis=1, mode="clip")
            scores += self.bias[:, None, None]
            scores -= scores.max(axis=0)
            np.exp(scores, out=scores)
            scores *= (back >= 0) / scores.sum(axis=0)
            pooled[:m] += scores.sum(axis=1, dtype=np.float64).T
        total[order] = pooled / size[:, None]
        return total


def train(windows: np.ndarray, labels: list[str], hidden: int = 12, epochs: int = 6, batch: int = 256, rate: float = 0.02, seed: int = 5) -> LanguageModel:
    """Adam on the cross entropy of every position of the windows, a matrix of bytes."""
    rng = np.random.default_rng(seed)
    names = sorted(set(labels))
    target = np.array([names.index(x) for x in labels])
    scale = lambda *shape: (rng.normal(size=shape) * 0.3).astype(_F)
    model = LanguageModel(names, scale(2, 3 * hidden, 256), scale(2, 3 * hidden, hidden), scale(2, len(names), hidden), np.zeros(len(names), dtype=_F))
    model.x[:, : 2 * hidden] += _F(0.5)
    first, second = [np.zeros_like(p) for p in model.parameters], [np.zeros_like(p) for p in model.parameters]
    step, total = 0, epochs * -(-len(windows) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for k in range(0, len(order), batch):
            which = order[k : k + batch]
            grads = gradients(model, windows[which], target[which])
            step += 1
            lr = rate * (1 - step / (total + 1))
            for q, g, m, v in zip(model.parameters, grads, first, second, strict=True):
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                q -= (lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(_F)
    return model


def gradients(model: LanguageModel, windows: np.ndarray, target: np.ndarray, loss: bool = False):
    """Gradients of the mean cross entropy over all positions of the windows; or that mean."""
    rows, steps = windows.shape
    codes = np.stack([windows.T, windows.T[::-1]], axis=1).astype(np.intp)
    h = np.zeros((2, model.u.shape[2], rows), dtype=model.x.dtype)
    trace: list = []
    states = np.empty((steps, *h.shape), dtype=h.dtype)
    for t in range(steps):
        h = states[t] = model.step(codes[t], h, trace)
    both = np.stack([states[:, 0], states[::-1, 1]], axis=1)
    logits = np.matmul(model.out, both).sum(axis=1) + model.bias[:, None]
    logits -= logits.max(axis=1, keepdims=True)
    d = np.exp(logits)
    d /= d.sum(axis=1, keepdims=True)
    if loss:
        return -np.log(d[:, target, np.arange(rows)]).mean()
    d[:, target, np.arange(rows)] -= 1
    d /= rows * steps
    dout = np.einsum("tlb,twhb->wlh", d, both)
    dboth = np.einsum("wlh,tlb->twhb", model.out, d)
    dstates = np.stack([dboth[:, 0], dboth[::-1, 1]], axis=1)
    return [*model.back(codes, trace, dstates), dout, d.sum(axis=(0, 2))]


def training_windows(docs: DataFrame, trains: Column, most_docs: int, each: int, size: int) -> DataFrame:
    """(lang, piece): of each language about ``most_docs`` labelled documents, drawn by hash, and ``each`` stretches of ``size`` letters from anywhere in each."""
    labelled = docs.where(trains & F.col("lang").isNotNull() & (F.length("text") > 0))
    counts = labelled.groupBy("lang").count().collect()  # a row for each language
    share = F.lit(0)
    for r in counts:
        share = F.when(F.col("lang") == r["lang"], int(1_000_000 * min(1.0, most_docs / r["count"]))).otherwise(share)
    drawn = labelled.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < share)
    place = F.pmod(F.xxhash64("doc_id", "k"), F.greatest(F.length("text") - size + 1, F.lit(1))).cast("int") + 1
    return drawn.select("doc_id", "lang", "text", F.explode(F.sequence(F.lit(1), F.lit(each))).alias("k")).select("lang", F.substring(F.col("text"), place, F.lit(size)).alias("piece"))


def fit(docs: DataFrame, trains: Column, most_docs: int = 400, each: int = 8, size: int = 64, **options) -> LanguageModel:
    """Fits on a bounded sample: about ``most_docs`` labelled documents of each language, ``each`` windows of ``size`` bytes from each of them."""
    rows = sorted((r.lang, r.piece) for r in training_windows(docs, trains, most_docs, each, size).collect())
    if not rows:
        return train(np.full((1, size), 32, np.uint8), ["und"], epochs=1)
    windows = np.frombuffer(b"".join(piece.encode()[:size].ljust(size) for _, piece in rows), np.uint8).reshape(-1, size)
    return train(windows, [lang for lang, _ in rows], **options)


def _gathered(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Runs of rows with about ``limit`` bytes of text; a longer text is alone or last."""
    held, size = [], 0
    for batch in batches:
        start = 0
        for k, n in enumerate(pc.binary_length(batch.column("text")).fill_null(0).to_pylist()):
            size += n
            if size >= limit:
                held.append(batch.slice(start, k + 1 - start))
                yield pa.Table.from_batches(held)
                held, size, start = [], 0, k + 1
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held)


def _predict(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _gathered(batches, READ_BYTES):
            part = part.combine_chunks()
            if not part.num_rows:
                continue
            pooled = model.pooled(part.column("text").fill_null("").cast(pa.binary()).to_pylist())
            letters = part.column("letters").to_numpy()
            score = np.where(letters, pooled.max(axis=1, initial=0), 0.0)
            names = [model.labels[b] if ok else "und" for b, ok in zip(pooled.argmax(axis=1), letters, strict=True)]
            ids = part.column("doc_id").combine_chunks()
            yield pa.record_batch([ids, pa.array(names, pa.string()), pa.array(np.clip(score, 0, 1))], names=["doc_id", "lang_pred", "score"])

    return run


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for each row; ``und`` with score 0 if a text is null or has no letter.

    Rows are judged alone, so repeated rows and ids are harmless; only doc_id and
    text are read, so extra columns do no harm; an empty table gives no rows. A
    task holds about READ_BYTES of texts at a time, and of a longer text that
    text.
    """
    letters = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("letters")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", letters).mapInArrow(_predict(model), "doc_id long, lang_pred string, score double")


def op9_language_id(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, ~held_out(4, 2))
    return identify(docs, model).select("doc_id", held_out(4, 2).alias("held_out"), "lang_pred", "score")
