"""Quality by importance resampling.

Two generative models over hashed n-grams (words and runs of signs, and pairs of
neighbours) are counted: one of the target, labelled text of good quality, and one of the
raw text, all documents. A document's log weight is the sum of log(target / raw) over its
n-grams. Documents are drawn without replacement by Gumbel top-k: the k highest sums of
log weight and seeded Gumbel noise stay, which draws in proportion to the weights.

k is the number of documents whose mean log weight (the sum over n-grams, by their number +
SHRINK, so that few n-grams say little) is at least a bar that the half of the labelled
sample that trained no model fixes: the bar that errs least on it, errors on good text
counting GOOD_COST times. Log weights grow with a text's length and so would favour long
texts; the draw therefore takes the mean, less the bar, times TEMPER: the log weight of a
text of TEMPER n-grams. A document that far from the bar that the noise of a Gumbel draw
can't bridge it (about 5 / TEMPER) stays or goes surely, others by chance.

Counts cover all documents; only labels are a bounded sample (LABELLED rows, by hash). The
models have BUCKETS counts each. The k-th key is found by narrowing histograms, so nothing
is sorted or gathered in one task. Rows whose keys tie with the k-th all stay.

Edge cases: null and empty texts have no n-grams and mean weight 0; their noise decides
like any other's. Without labels of both kinds everything is kept. Repeated rows are drawn
each for itself; labels of repeated ids count once, the highest of them, with the mean of
the rows' weights. Very long texts are counted whole, in memory linear in them. An empty
table gives no rows. ``keep_good`` keeps all columns, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, lean, stored

BUCKETS = 1 << 16
LABELLED = 20_000
GOOD_COST = 8.0
TEMPER = 20.0
SHRINK, PRIOR = 32, 2.0
_TOKEN = re.compile(r"\w+|[^\w\s]+")
_CACHED = 200_000


class Hasher:
    """n-gram buckets of a text, as a list of numbers; remembers the words it has seen."""

    def __init__(self, buckets: int = BUCKETS):
        self.buckets, self.known = buckets, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = _TOKEN.findall(text.lower()) if text else []
        if not words:
            return np.zeros(0, np.int64)
        known = self.known
        if len(known) > _CACHED:
            known.clear()
        for w in set(words).difference(known):
            known[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        one = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        same = one[:-1] == one[1:]  # a word said twice is one n-gram, whatever the word
        two = (one[:-1] * np.uint64(0x9E3779B1) ^ one[1:] * np.uint64(0x85EBCA77)) >> np.uint64(7)
        two[same] = 1
        return (np.concatenate([one, two]) % np.uint64(self.buckets)).astype(np.int64)


def _counter(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, hasher = shared.value, Hasher()
        raw, target = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                found = np.bincount(hasher(text.as_py()), minlength=BUCKETS)
                raw += found
                if doc_id in good:
                    target += found
        at = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(raw[at]), pa.array(target[at])], ["bucket", "raw", "target"])

    return run


def _weigher(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, hasher = shared.value, Hasher()
        for b in batches:
            n, total = [], []
            for text in b.column(2):
                found = hasher(text.as_py())
                n.append(len(found)), total.append(float(ratio[found].sum()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(total, pa.float64())], ["row", "id", "n_grams", "log_weight"])

    return run


def uniform(*cols: Column) -> Column:
    """A number in (0, 1) from a hash of cols."""
    return (F.shiftrightunsigned(F.xxhash64(*cols), 11) + 0.5) / float(1 << 53)


def _kth(scored: DataFrame, col: str, k: int) -> float:
    """The k-th highest value of col: histograms of 1024 bins, each inside one bin of the
    one before."""
    low, high = scored.agg(F.min(col), F.max(col)).first()
    above = 0
    while high > low:
        step = (high - low) / 1024
        if low + step <= low or high - step >= high:
            break
        bin_ = F.least(F.floor((F.col(col) - low) / step), F.lit(1023)).alias("bin")
        part = scored.where(F.col(col).between(low, high)).groupBy(bin_).agg(F.count("*").alias("n"), F.min(col).alias("a"), F.max(col).alias("b"))
        for _, n, a, b in sorted(part.collect(), reverse=True):
            if above + n >= k:
                low, high = a, b
                break
            above += n
    return low


def log_ratio(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """log(target / raw) of each bucket. Observed and expected counts of the target are both
    raised by PRIOR, so a bucket says only as much as the target's size can tell of it."""
    expected = raw * (target.sum() / max(raw.sum(), 1.0))
    return np.log((target + PRIOR) / (expected + PRIOR))


def _bar(good: np.ndarray, bad: np.ndarray) -> float:
    """The bar that errs least: values below it are taken for bad."""
    values = np.unique(np.concatenate([good, bad]))
    good, bad = np.sort(good), np.sort(bad)
    errors = GOOD_COST * np.searchsorted(good, values) / len(good) + (1 - np.searchsorted(bad, values) / len(bad))
    at = int(errors.argmin())
    return float(values[at] + (values[at - 1] if at else values[at])) / 2


def importance_weights(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", seed: int = 7, labelled: int = LABELLED, row: str | None = None) -> DataFrame:
    """row, id, n_grams, log_weight (sum), mean_weight, draw_key and kept of each row of docs;
    row is its number in reading order, or the value of the column named by row."""
    spark = docs.sparkSession
    known = labels.select(F.col(key).alias("id"), F.col(label).alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    sample = known.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(labelled).collect()
    # one half tells what good text is like, the other where the bar lies: on the first half
    # the model would look better than it is
    good = {r[0] for r in sample[::2] if r[1] > 0}
    counts = docs.select(key, text).mapInArrow(lean(_counter(spark.sparkContext.broadcast(good))), "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).toArrow()
    at = counts.column("bucket").to_numpy()
    raw, target = np.zeros(BUCKETS), np.zeros(BUCKETS)
    raw[at], target[at] = counts.column("raw").to_numpy(), counts.column("target").to_numpy()
    ratio = log_ratio(raw, target)
    numbered = docs.select((F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    scored = stored(numbered.mapInArrow(lean(_weigher(spark.sparkContext.broadcast(ratio))), "row long, id long, n_grams long, log_weight double"))
    scored = scored.withColumn("mean_weight", F.col("log_weight") / (F.col("n_grams") + SHRINK))
    marks = spark.createDataFrame([(r[0], float(r[1])) for r in sample[1::2]] or [(None, None)], "id long, y double")
    told = scored.join(marks, "id").groupBy("id").agg(F.avg("mean_weight").alias("mean_weight"), F.max("y").alias("y")).toArrow()  # a row for each id of the sample
    y, x = told.column("y").to_numpy() > 0, told.column("mean_weight").to_numpy()
    if not y.any() or y.all():
        return scored.withColumn("draw_key", F.lit(0.0)).withColumn("kept", F.lit(True))
    bar = _bar(x[y], x[~y])
    gumbel = -F.log(-F.log(uniform(F.lit(seed), F.col("row"), F.col("id"))))
    scored = scored.withColumn("draw_key", (F.col("mean_weight") - bar) * TEMPER + gumbel)
    k = scored.where(F.col("mean_weight") >= bar).count()
    least = _kth(scored, "draw_key", k) if k else float("inf")
    return scored.withColumn("kept", F.col("draw_key") >= least)


def keep_good(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", seed: int = 7) -> DataFrame:
    """The rows of docs that the draw keeps, with all their columns."""
    mark = free_name(docs.columns, "row")
    numbered = stored(docs.withColumn(mark, F.monotonically_increasing_id()))
    drawn = importance_weights(numbered, labels, key, text, label, seed, row=mark)
    gone = drawn.where("not kept").select(F.col("row").alias(mark))
    return numbered.join(gone, mark, "left_anti").drop(mark)
