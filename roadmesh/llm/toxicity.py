"""Toxicity by a classifier chain.

Categories (label columns) stand in an order; each has a linear (logistic) model over the
presence of words and word stems, and the models of later categories also see the probabilities of the
earlier ones. In training these are out-of-fold predictions, so a later model learns from
probabilities as uncertain as those it will meet; in scoring the full models feed the chain.

The models are fitted on the driver, on at most LABELLED labelled rows chosen by a hash;
their words are those in at least MIN_DOCS of these, at most WORDS, whose share in some
category stands DEVIATION standard errors from its rate. Scoring reads every
word of every text where it lies; nothing is shuffled.

Edge cases: null and empty texts have no words and get the models' base rate. A label that
is null leaves its row out of that category's fit only. A category with one class only, or
no labels, has its smoothed base rate for every text. Repeated labels of an id: the
highest counts. Repeated rows are scored each; an empty table gives none. Very long texts are
read whole, in memory linear in them. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_TABLE

LABELLED = 6_000
STEMS = (4, 5, 6, 7)
MIN_DOCS, WORDS, FOLDS, ROUNDS = 4, 30_000, 3, 200
#: Words stay if for some category they stand in its texts so many standard errors more or
#: less often than its rate says; else chance would fill the models.
DEVIATION = 6.0
#: ASCII letters in lower case and all bytes of other scripts stay; the rest parts words.
_PART = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in LOWER_TABLE)


def words_of(text: str | None) -> set[bytes]:
    """The words of a text and their first STEMS bytes, which stand for the inflected forms."""
    words = set((text or "").encode().translate(_PART).split())
    return words.union(*({w[:n] for w in words if len(w) > n} for n in STEMS))


class Logistic:
    """L2-regularised logistic regression on sparse presence rows, by Adagrad."""

    def fit(self, rows: np.ndarray, cols: np.ndarray, n_cols: int, dense: np.ndarray, y: np.ndarray) -> Logistic:
        """rows, cols: the places that are 1; dense: further columns, one row per text."""
        n, rate = len(y), (y.sum() + 1) / (len(y) + 2)
        self.w, self.v, self.b = np.zeros(n_cols), np.zeros(dense.shape[1]), float(np.log(rate / (1 - rate)))
        if not n or y.min() == y.max():
            return self
        weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
        self.b = 0.0
        sums = [np.full(n_cols, 1e-8), np.full(dense.shape[1], 1e-8), 1e-8]
        for _ in range(ROUNDS):
            g = weight * (self._prob(np.bincount(rows, self.w[cols], n) + dense @ self.v) - y) / n
            grads = [np.bincount(cols, g[rows], n_cols) + 1e-5 * self.w, dense.T @ g + 1e-5 * self.v, g.sum()]
            sums = [s + x * x for s, x in zip(sums, grads)]
            self.w -= 0.5 * grads[0] / np.sqrt(sums[0])
            self.v -= 0.5 * grads[1] / np.sqrt(sums[1])
            self.b -= 0.5 * grads[2] / np.sqrt(sums[2])
        return self

    def _prob(self, margin: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(margin + self.b, -30, 30)))

    def prob(self, rows: np.ndarray, cols: np.ndarray, n: int, dense: np.ndarray) -> np.ndarray:
        return self._prob(np.bincount(rows, self.w[cols], n) + dense @ self.v)


class Chain:
    def __init__(self, texts: Iterable[set[bytes]], labels: np.ndarray, seed: int = 7):
        """labels: a column per category, NaN where unknown. Texts are read once and held as
        numbers of their words, so that no word is in memory more than once."""
        number: dict[bytes, int] = {}
        held = [np.fromiter((number.setdefault(w, len(number)) for w in t), np.int32, len(t)) for t in texts]
        n, rows = len(held), np.repeat(np.arange(len(held), dtype=np.int32), [len(h) for h in held])
        cols = np.concatenate([np.zeros(0, np.int32), *held])
        found = np.bincount(cols, minlength=len(number))
        common = sorted((w for w, i in number.items() if found[i] >= MIN_DOCS), key=lambda w: (-found[number[w]], w))
        rows, cols = self._renumbered(rows, cols, number, common)
        far = np.zeros(len(common))
        for y in labels.T:
            known = ~np.isnan(y)[rows]
            seen, rate = np.bincount(cols[known], minlength=len(common)), (np.nansum(y) + 1) / (np.sum(~np.isnan(y)) + 2)
            hits = np.bincount(cols[known], y[rows[known]], len(common))
            far = np.maximum(far, np.abs(hits - seen * rate) / np.sqrt(np.maximum(seen * rate * (1 - rate), 1e-9)))
        telling = [w for w, z in zip(common, far) if z >= DEVIATION][:WORDS]
        rows, cols = self._renumbered(rows, cols, {w: i for i, w in enumerate(common)}, telling)
        self.index = {w: i for i, w in enumerate(telling)}
        fold = np.random.default_rng(seed).permutation(n) % FOLDS
        self.models, fed = [], np.zeros((n, 0))
        for y in labels.T:
            known = ~np.isnan(y)
            self.models.append(self._fit(rows, cols, fed, y, known))
            out = np.zeros(n)
            for k in range(FOLDS):
                part = self._fit(rows, cols, fed, y, known & (fold != k)).prob(rows, cols, n, fed)
                out[fold == k] = part[fold == k]
            fed = np.column_stack([fed, out])
        self.out_of_fold = fed

    @staticmethod
    def _renumbered(rows: np.ndarray, cols: np.ndarray, number: dict[bytes, int], words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The places of words, which are numbered by their order; sorted by text and word."""
        to = np.full(len(number), -1, np.int32)
        to[[number[w] for w in words]] = np.arange(len(words))
        new = to[cols]
        rows, new = rows[new >= 0], new[new >= 0]
        order = np.lexsort((new, rows))
        return rows[order], new[order]

    def _fit(self, rows, cols, dense, y, use) -> Logistic:
        at = np.cumsum(use) - 1
        mine = use[rows]
        return Logistic().fit(at[rows[mine]], cols[mine], len(self.index), dense[use], y[use])

    def places(self, texts: list[set[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        found = [[i for w in t if (i := self.index.get(w)) is not None] for t in texts]
        return np.repeat(np.arange(len(texts)), [len(f) for f in found]), np.array([i for f in found for i in f], np.int64)

    def probs(self, texts: list[set[bytes]]) -> np.ndarray:
        """A column per category."""
        rows, cols = self.places(texts)
        fed = np.zeros((len(texts), 0))
        for m in self.models:
            fed = np.column_stack([fed, m.prob(rows, cols, len(texts), fed)])
        return fed


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], key: str = "doc_id", text: str = "text", labelled: int = LABELLED, seed: int = 7) -> Chain:
    """labels: key and a 0/1 column per category."""
    known = labels.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(*[F.max(F.col(c).cast("double")).alias(f"y{i}") for i, c in enumerate(categories)])
    sample = known.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(labelled).collect()
    marks = {r[0]: r[1:] for r in sample}
    shared = docs.sparkSession.sparkContext.broadcast(set(marks))

    def chosen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = shared.value
        for b in batches:
            got = [(i, b" ".join(sorted(words_of(t.as_py())))) for i, t in zip(b.column(0).to_pylist(), b.column(1)) if i in ids]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.binary())], ["id", "words"])

    got = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("t")).mapInArrow(chosen, "id long, words binary").groupBy("id").agg(F.min("words").alias("words")).toArrow().sort_by("id")
    ids = got.column("id").to_pylist()
    y = np.array([[np.nan if v is None else v for v in marks[i]] for i in ids], float).reshape(len(ids), len(categories))
    return Chain((set(w.as_py().split()) for w in got.column("words")), y, seed)


def toxicity(docs: DataFrame, labels: DataFrame, categories: list[str], key: str = "doc_id", text: str = "text", bar: float = 0.5, seed: int = 7) -> DataFrame:
    """doc_id, p_<category> of each category and toxic: whether the last one reaches bar."""
    shared = docs.sparkSession.sparkContext.broadcast(fit_chain(docs, labels, categories, key, text, seed=seed))
    names = ["doc_id", *(f"p_{c}" for c in categories), "toxic"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain = shared.value
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                p = chain.probs([words_of(t.as_py()) for t in part.column(1)])
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), *(pa.array(c) for c in p.T), pa.array(p[:, -1] >= bar)], names)

    return docs.select(key, text).mapInArrow(run, ", ".join(["doc_id long", *(f"`p_{c}` double" for c in categories), "toxic boolean"]))
