"""Toxicity by a lexicon that tolerates misspellings, with scores from each hit's context.

The lexicon is learned from labelled documents. Words run through the
intersection of the Levenshtein automaton of each term with the trie of all
terms; its states are built when first met. A hit's score depends on its
context window: quotation marks and reporting words lower it, words of address
and further hits raise it. A logistic model over a document's hit scores gives
the document's score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, labelled_sample
from .shared import cut, table
from .textops import slices

#: From letter to letter; digits and a few signs inside may stand for letters and count as misspellings.
WORD = re.compile(r"[^\W\d_](?:[\w@$*]*[^\W\d_])?")
LETTERS = re.compile(r"[^\W\d_]+")
UNJOINED = re.compile(r"[^_]+")
CACHE = 400_000
STATES = 50_000
FEATURES = 8
#: Words that report what others said, and words of address, in English, German, French and Spanish.
REPORTING = frozenset("said says say quoted quote quotes wrote called calls term word slur sagte sagt schrieb nannte wort dit disait cite mot terme dijo dice cita palabra".split())
ADDRESS = frozenset("you your youre yourself du dich dir dein ihr euch tu te toi vous votre usted ustedes tú tus".split())
QUOTES = frozenset("\"'“”„«»‘’`")


class Lexicon:
    """Terms with weights; ``find`` gives the best term within a word's edit allowance."""

    def __init__(self, terms: dict[str, float]):
        self.terms = terms
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[str | None] = [None]
        self.below: list[int] = [0]  # the largest allowance of any term below a node
        for term in terms:
            node = 0
            self.below[0] = max(self.below[0], self.allowance(term))
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.below.append(0)
                node = self.children[node][c]
                self.below[node] = max(self.below[node], self.allowance(term))
            self.ends[node] = term
        self._clear()

    @staticmethod
    def allowance(term: str) -> int:
        """Edits that a term tolerates: none below five letters, one below nine, else two."""
        return 0 if len(term) < 5 else 1 if len(term) < 9 else 2

    def _clear(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.states: list[frozenset] = []
        self.steps: list[dict[str, int]] = []
        self.start = self._state({(0, 0)})

    def _state(self, pairs: set[tuple[int, int]]) -> int:
        """The number of a set of (trie node, edits so far), with letters of the terms left out added; -1 if nothing can match any more."""
        least: dict[int, int] = {}
        todo = list(pairs)
        while todo:
            node, e = todo.pop()
            if e > self.below[node] or least.get(node, 9) <= e:
                continue
            least[node] = e
            todo += [(child, e + 1) for child in self.children[node].values()]
        if not least:
            return -1
        key = frozenset(least.items())
        if key not in self.number:
            self.number[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        return self.number[key]

    def _step(self, state: int, c: str) -> int:
        to = set()
        for node, e in self.states[state]:
            if c in self.children[node]:
                to.add((self.children[node][c], e))
            to.add((node, e + 1))
            to.update((child, e + 1) for child in self.children[node].values())
        return self._state(to)

    def find(self, word: str) -> tuple[str, int] | None:
        if len(self.states) > STATES:
            self._clear()
        state = self.start
        for c in word:
            step = self.steps[state]
            if c not in step:
                step[c] = self._step(state, c)
            state = step[c]
            if state < 0:
                return None
        hits = [(e, -self.terms[self.ends[n]], self.ends[n]) for n, e in self.states[state] if self.ends[n] is not None and e <= self.allowance(self.ends[n])]
        return (lambda h: (h[2], h[0]))(min(hits)) if hits else None


@lru_cache(maxsize=1)
def _worker(terms: tuple[tuple[str, float], ...]) -> tuple[Lexicon, dict]:
    """A lexicon and what it found for words so far; a worker process keeps them for its later tasks."""
    return Lexicon(dict(terms)), {}


def context_score(text: str, words: list[tuple[int, int, str]], k: int, weight: float, others: int, reach: int = 6) -> tuple[float, bool, bool]:
    """The score of the hit at word k, whether it is quoted and whether somebody is addressed."""
    start, end, _ = words[k]
    near = {w for _, _, w in words[max(0, k - reach) : k + reach + 1]}
    quoted = (any(c in QUOTES for c in text[max(0, start - 2) : start]) and any(c in QUOTES for c in text[end : end + 2])) or bool(near & REPORTING)
    addressed = bool(near & ADDRESS)
    return weight * (0.4 if quoted else 1.0) * (1.2 if addressed else 1.0) * (1 + 0.1 * min(others, 3)), quoted, addressed


def readings(word: str) -> list[list[tuple[int, int, str]]]:
    """A joined word as a whole, as its parts between '_' and as its runs of letters, with places inside it."""
    parts = [(m.start() + w.start(), m.start() + w.end(), w.group()) for m in UNJOINED.finditer(word) for w in WORD.finditer(m.group())]
    return [[(0, len(word), word)], parts, [(m.start(), m.end(), m.group()) for m in LETTERS.finditer(word)]]


def read_words(text: str, hits: dict[str, tuple[str, int]]) -> list[tuple[int, int, str]]:
    """The words of a text with their places; a joined one by the reading with the hit of fewest edits, the coarser if equal, or by its runs of letters if none hits."""
    words = []
    for m in WORD.finditer(text):
        word = m.group().lower()
        if word.isalpha():
            words.append((m.start(), m.end(), word))
            continue
        ways = readings(m.group())
        edits = [min((hits[w.lower()][1] for _, _, w in way if hits.get(w.lower())), default=9) for way in ways]
        best = ways[edits.index(min(edits)) if min(edits) < 9 else -1]
        words += [(m.start() + start, m.start() + end, w.lower()) for start, end, w in best]
    return words


def features(text: str, hits: dict[str, tuple[str, int]], lexicon: Lexicon) -> list[float]:
    """What the logistic model sees of a text with hits; hits maps its words that match to term and edits."""
    words = read_words(text, hits)
    at = [k for k, w in enumerate(words) if w[2] in hits]
    if not at:
        return [0.0] * FEATURES
    scores, exact, fuzzy, quoted, addressed = [], 0, 0, 0, 0
    low = 0
    for j, k in enumerate(at):
        while at[low] < k - 6:
            low += 1
        high = j
        while high + 1 < len(at) and high < j + 3 and at[high + 1] <= k + 6:
            high += 1
        term, edits = hits[words[k][2]]
        score, q, a = context_score(text, words, k, lexicon.terms[term], high - low)
        scores.append(score * 0.6**edits)
        exact, fuzzy = exact + (edits == 0), fuzzy + (edits > 0)
        quoted, addressed = quoted + q, addressed + a
    total = sum(scores)
    kinds = len({hits[words[k][2]][0] for k in at})
    return [np.log1p(exact), np.log1p(fuzzy), np.log1p(total), max(scores), total / np.sqrt(len(words)), quoted / len(at), np.log1p(kinds), total / len(words)]


@dataclass
class ToxicityModel:
    terms: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the bias

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.column_stack([(x - self.mean) / self.scale, np.ones(len(x))]) @ self.weights
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_logistic(x: np.ndarray, y: np.ndarray, terms: dict[str, float], penalty: float = 1.0) -> ToxicityModel:
    """Newton's method on the penalised log loss."""
    mean, scale = (x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)) if len(x) else (np.zeros(FEATURES), np.ones(FEATURES))
    w = np.zeros(FEATURES + 1)
    if not len(x) or y.min() == y.max():
        w[-1] = 4.0 if len(y) and y.min() == 1 else -4.0
        return ToxicityModel(terms, mean, scale, w)
    z = np.column_stack([(x - mean) / scale, np.ones(len(x))])
    ridge = np.diag([penalty] * FEATURES + [1e-6])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge, z.T @ (p - y) + ridge @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return ToxicityModel(terms, mean, scale, w)


def _all_words(text: str) -> list[str]:
    """A text's words and all parts of the joined ones."""
    words = WORD.findall(text.lower())
    joined = [w for w in set(words) if not w.isalpha()]
    return words + [part for w in joined for way in readings(w)[1:] for _, _, part in way]


def _featured(terms: dict[str, float], model: ToxicityModel | None):
    """Rows (doc_id, label, x) for training, or (doc_id, score)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon, known = _worker(tuple(terms.items()))
        for batch in batches:
            for part in slices(batch, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                x = np.zeros((len(texts), FEATURES))
                split = [_all_words(t) for t in texts]
                new = set(chain.from_iterable(split)).difference(known)
                if len(known) + len(new) > CACHE:
                    known.clear()
                    new = set(chain.from_iterable(split))
                known.update((w, lexicon.find(w)) for w in new)
                for k, words in enumerate(split):
                    if any(map(known.get, words, repeat(None))):
                        x[k] = features(texts[k], {w: known[w] for w in set(words) if known[w]}, lexicon)
                ids = part.column("doc_id")
                if model is None:
                    yield pa.record_batch([ids, part.column("label"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), FEATURES).cast(pa.list_(pa.float64()))], names=["doc_id", "label", "x"])
                else:
                    yield pa.record_batch([ids, pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def learn_lexicon(sample: DataFrame, most_terms: int = 400, least_docs: int = 4) -> dict[str, float]:
    """Words whose log odds of a toxic document are surely above one: lower bound of the odds, and the document counts, by class."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    counted = sample.select("label", F.explode(words).alias("word")).groupBy("word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).where(F.col("a") >= least_docs)
    totals = sample.agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b")).first()
    n1, n0 = totals["a"] or 0, totals["b"] or 0
    odds = F.log((F.col("a") + 0.5) / (n1 + 1)) - F.log((F.col("b") + 0.5) / (n0 + 1))
    lower = odds - 1.5 * F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    rows = counted.select("word", lower.alias("weight")).where("weight > 1").orderBy(F.desc("weight"), "word").limit(most_terms).collect()
    return {r.word: float(r.weight) for r in rows}


def fit_toxicity(docs: DataFrame, labels: DataFrame, most: int = 20_000, **options) -> ToxicityModel:
    """Fits lexicon and model on at most ``most`` documents with a toxicity label that aren't held out."""
    sample = cut(labelled_sample(docs, labels, "toxic", ~held_out(5, 0), most))  # read three times
    terms = learn_lexicon(sample, **options)
    rows = sample.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "label").mapInArrow(_featured(terms, None), "doc_id long, label int, x array<double>").collect()
    rows.sort(key=lambda r: (r.doc_id, r.label, r.x))
    x = np.array([r.x for r in rows], dtype=float).reshape(-1, FEATURES)
    return fit_logistic(x, np.array([r.label for r in rows], dtype=float), terms)


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """doc_id and score (0 to 1) of each row, from its whole text alone.

    A null or empty text scores as one without hits. Texts are read whole, in
    slices of rows, so a long one costs its own length. Rows are judged alone, so
    ties and repeats are harmless; only doc_id and text are read, so other
    columns do no harm; an empty table gives no rows.
    """
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_featured(model.terms, model), "doc_id long, score double")


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(5, 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
