"""Hard negatives by lists that the anchors of a cluster share (MAXIMUS style).

Anchors are clustered by direction. Let u be an anchor of a cluster with centre c and widest
angle w, and r a row: the angle between u and r is at least angle(c, r) - w, so

    u . r <= |u| * |r| * cos(max(0, angle(c, r) - w)) = |u| * bound(r).

A cluster sorts the rows by bound(r) once; each of its anchors walks the same list and stops
at the first row whose bound proves that no later row can enter its answer. Two walks:

- positives: the best rows of the anchor's label; a walk ends below the k-th score so far;
- negatives: for each positive the best rows of other labels with scores in the window from
  ``low`` percent of the positive's score up to that score; a walk ends below all windows, or
  below the k-th score of those that are full.

Distribution: rows are dealt to cells by the nearest of a bounded number of centres and, in a
cell, to pieces of about ``piece_rows`` rows by a hash; anchors to blocks of whole clusters. A
cell is known by its widest angle and longest row, so a cell that can't hold an answer for any
cluster of a block isn't sent to it. For the positives each cluster first meets one piece of
the cell it lies in: its worst k-th score there is the floor that other cells have to exceed.
Lists are sorted per cluster and piece; each piece gives at most k rows an anchor (and
positive), and the best of them are kept. No pairs are made but those that a walk scores.

Centres come from at most SAMPLE anchors (by a hash of their ids), the rest is computed over
all rows. What goes to all tasks are the centres and the cells' figures, at most CENTRES rows.

Edge cases: rows with a null id, label or vector, or null or non-finite components, take no
part; nor do vectors of another length than the first sampled anchor's. Rows with the id of
an anchor are not candidates for it; anchors that repeat an id have a list each. A vector of
zeros has angle 0 to every centre and score 0. Ties go to the smaller id; rows that repeat an
id are candidates each. Positives with scores of zero or less have windows that hold
at most the score 0 (low <= 100). An empty table gives no rows. Extra columns are ignored,
whatever their names. Scores are exact: components are whole numbers, and products that could
pass 2^53 are taken in 64-bit whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import lean, stored

#: Anchors that centres are fitted on, and centres, at most.
SAMPLE, CENTRES = 4096, 1024
_FIRST, _STEP = 256, 2048
_PI = float(np.pi)


def _matrix(lists: pa.Array) -> np.ndarray:
    """An array of lists of equal lengths as whole numbers, one row each."""
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    return flat.reshape(len(lists), len(flat) // max(len(lists), 1))


def _unit(rows: np.ndarray) -> np.ndarray:
    norm = np.sqrt((rows**2).sum(1, keepdims=True))
    return rows / np.where(norm > 0, norm, 1)


def _centres(rows: np.ndarray, k: int) -> np.ndarray:
    """k directions: spherical k-means from evenly spaced rows, a few rounds."""
    unit = _unit(rows.astype(np.float64))
    centres = unit[np.linspace(0, len(unit) - 1, k).astype(int)]
    for _ in range(4):
        near = (unit @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, unit)
        centres = np.where((sums**2).sum(1, keepdims=True) > 0, _unit(sums), centres)
    return centres


def _angle(rows: np.ndarray, centre: np.ndarray) -> np.ndarray:
    """The angle of each row (not zero) to a direction, 0 for zeros."""
    norm = np.sqrt((rows**2).sum(1))
    return np.where(norm > 0, np.arccos(np.clip(rows @ centre / np.where(norm > 0, norm, 1), -1, 1)), 0.0)


def _dealt(centres):
    """Adds each row's nearest centre, its angle to it and its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near_to = centres.value
        for b in batches:
            if not b.num_rows:
                continue
            rows = _matrix(b.column(3)).astype(np.float64)
            norm = np.sqrt((rows**2).sum(1))
            cosine = rows @ near_to.T / np.where(norm > 0, norm, 1)[:, None]
            near = cosine.argmax(1)
            angle = np.where(norm > 0, np.arccos(np.clip(cosine[np.arange(len(rows)), near], -1, 1)), 0.0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32)), pa.array(angle), pa.array(norm)], [*b.schema.names, "centre", "angle", "norm"])

    return run


class _Shared:
    """The rows of a piece, and their products with anchors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        self.ids, self.labels, self.rows = ids, labels, rows
        self.wide = rows.astype(np.float64)
        self.norm = np.sqrt((self.wide**2).sum(1))

    def sorted_for(self, centre: np.ndarray, widest: float) -> tuple[np.ndarray, np.ndarray]:
        """The cluster's list: rows by falling bound, and the bounds."""
        bound = self.norm * np.cos(np.maximum(0.0, _angle(self.wide, centre) - widest)) * (1 + 1e-9) + 1e-6
        order = np.argsort(-bound, kind="stable")
        return order, bound[order]

    def scores(self, at: np.ndarray, anchors: np.ndarray) -> np.ndarray:
        """Exact products of rows and anchors (whole numbers)."""
        if len(at) and float(np.abs(anchors).max(initial=0)) * self.norm.max() * anchors.shape[1] < 2.0**52:
            return (self.wide[at] @ anchors.T.astype(np.float64)).astype(np.int64)
        return self.rows[at] @ anchors.T


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties by smaller id."""
    if len(score) > 4 * k:
        keep = score >= np.partition(score, len(score) - k)[len(score) - k]
        score, ids = score[keep], ids[keep]
    order = np.lexsort((ids, -score))[:k]
    return score[order], ids[order]


def _walk(shared: _Shared, anchors: np.ndarray, centre: np.ndarray, widest: float, wanted) -> None:
    """Walks the cluster's list with all anchors that still need it. wanted: ``bar(i)``, the
    score that an anchor's next row must reach, and ``take(i, scores, places)``."""
    order, bound = shared.sorted_for(centre, widest)
    length = np.sqrt((anchors.astype(np.float64) ** 2).sum(1))
    live, a, step = np.arange(len(anchors)), 0, _FIRST
    while a < len(order):
        # certified: no later row scores above length * bound
        live = live[length[live] * bound[a] * (1 + 1e-9) + 1e-3 >= np.array([wanted.bar(i) for i in live])]
        if not len(live):
            return
        at = order[a : a + step]
        scores = shared.scores(at, anchors[live])
        for column, i in enumerate(live):
            wanted.take(i, scores[:, column], at)
        a, step = a + step, _STEP


class _Positives:
    def __init__(self, shared, ids, labels, floors, k):
        self.shared, self.ids, self.labels, self.floors, self.k = shared, ids, labels, floors, k
        self.found = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ids]

    def bar(self, i: int) -> float:
        score = self.found[i][0]
        return max(self.floors[i], score[-1]) if len(score) == self.k else self.floors[i]

    def take(self, i: int, scores: np.ndarray, at: np.ndarray) -> None:
        fits = np.flatnonzero((self.shared.labels[at] == self.labels[i]) & (scores >= self.bar(i)))
        fits = fits[self.shared.ids[at[fits]] != self.ids[i]]
        if len(fits):
            score, ids = self.found[i]
            self.found[i] = _best(np.r_[score, scores[fits]], np.r_[ids, self.shared.ids[at[fits]]], self.k)


class _Negatives:
    def __init__(self, shared, labels, windows, k):
        """windows: for each anchor its positives' (lowest, highest) scores."""
        self.shared, self.labels, self.k = shared, labels, k
        self.windows = windows
        self.low = np.array([min((w[0] for w in ws), default=np.inf) for ws in windows], float)
        self.high = np.array([max((w[1] for w in ws), default=-np.inf) for ws in windows], float)
        self.found = [[(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in ws] for ws in windows]

    def _need(self, i: int, p: int) -> float:
        score, low = self.found[i][p][0], self.windows[i][p][0]
        return max(low, score[-1]) if len(score) == self.k else low

    def bar(self, i: int) -> float:
        return min((self._need(i, p) for p in range(len(self.windows[i]))), default=np.inf)

    def take(self, i: int, scores: np.ndarray, at: np.ndarray) -> None:
        fits = np.flatnonzero((scores >= self.bar(i)) & (scores <= self.high[i]) & (self.shared.labels[at] != self.labels[i]))
        if not len(fits):
            return
        some, ids = scores[fits], self.shared.ids[at[fits]]
        for p, (_, high) in enumerate(self.windows[i]):
            mine = (some >= self._need(i, p)) & (some <= high)
            if mine.any():
                score, known = self.found[i][p]
                self.found[i][p] = _best(np.r_[score, some[mine]], np.r_[known, ids[mine]], self.k)


_MEET = ["cell", "piece", "block", "number", "id", "label", "v", "centre", "widest", "floor", "windows"]


def _search(centres, k: int, low: int | None):
    """One piece of a cell with one block of anchors: their best positives, or (low) negatives."""

    def run(part: pa.Table) -> pa.Table:
        part = part.combine_chunks()
        number = part.column("number").combine_chunks()
        is_row = number.is_null().to_numpy(zero_copy_only=False)
        rows, asked = part.filter(pa.array(is_row)), part.filter(pa.array(~is_row))
        out: dict[str, list] = {"number": [], "positive": [], "score": [], "id": []}
        if rows.num_rows and asked.num_rows:
            column = lambda t, c: t.column(c).combine_chunks()
            shared = _Shared(column(rows, "id").to_numpy(), column(rows, "label").to_numpy(), _matrix(column(rows, "v")))
            ids, labels, v = column(asked, "id").to_numpy(), column(asked, "label").to_numpy(), _matrix(column(asked, "v"))
            numbers, cluster = column(asked, "number").to_numpy(), column(asked, "centre").to_numpy()
            widest, floors = column(asked, "widest").to_numpy(), column(asked, "floor").to_numpy()
            windows = None if low is None else column(asked, "windows").to_pylist()
            for c in np.unique(cluster):
                mine = np.flatnonzero(cluster == c)
                if low is None:
                    wanted = _Positives(shared, ids[mine], labels[mine], floors[mine], k)
                else:
                    spans = [[(-(-low * s // 100), s) for s in windows[i]] for i in mine]
                    wanted = _Negatives(shared, labels[mine], spans, k)
                _walk(shared, v[mine], centres.value[c], widest[mine[0]], wanted)
                for i, found in zip(mine, wanted.found):
                    for p, (score, got) in enumerate([found] if low is None else found):
                        out["number"] += [numbers[i]] * len(got)
                        out["positive"] += [p] * len(got)
                        out["score"] += score.tolist()
                        out["id"] += got.tolist()
        return pa.table({"number": pa.array(out["number"], pa.int64()), "positive": pa.array(out["positive"], pa.int32()), "score": pa.array(out["score"], pa.int64()), "id": pa.array(out["id"], pa.int64())})

    return run


_FOUND = "number long, positive int, score long, id long"


def _reachable(cells, centres, seed: bool):
    """For each cluster (with its block, widest angle, longest anchor and floor): the pieces of
    the cells that may hold a row above the floor; with seed, one piece of its own cell only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, directions = cells.value, centres.value
        number, angle, norm, pieces = (known[c] for c in ("centre", "angle", "norm", "pieces"))
        for b in batches:
            out = []
            for block, c, widest, longest, floor in zip(*(b.column(i).to_pylist() for i in range(5))):
                if seed:
                    near = int(np.argmax(directions[number] @ directions[c])) if len(number) else None
                    out += [] if near is None else [(block, int(number[near]), 0)]
                    continue
                between = np.arccos(np.clip(directions[number] @ directions[c], -1, 1))
                most = longest * norm * np.cos(np.clip(between - angle - widest, 0, _PI)) * (1 + 1e-9) + 1e-3
                for j in np.flatnonzero(most >= floor):
                    out += [(block, int(number[j]), p) for p in range(int(pieces[j]))]
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int32())], ["block", "cell", "piece"])

    return run


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, piece_rows: int = 8192, block_anchors: int = 1024, cluster_anchors: int = 32) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score: for each anchor
    and each of its first positives the first negatives in the window from low percent of the
    positive's score up to it. rows, anchors: id, label (whole numbers), v (array<long>)."""
    spark = rows.sparkSession
    known = lambda df: df.where("id is not null and label is not null and v is not null").select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), F.col("v").cast("array<long>").alias("v"))
    sample = known(anchors).orderBy(F.xxhash64("id", "v")).limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    as_row = known(rows).withColumn("number", F.lit(None).cast("long"))
    every = as_row.unionByName(known(anchors).withColumn("number", F.monotonically_increasing_id())).select("number", "id", "label", "v")
    fitted = _matrix(sample.column("v").combine_chunks())
    k = int(min(CENTRES, -(-sample.num_rows // cluster_anchors)))
    every = every.where(F.size("v") == fitted.shape[1]).withColumn("row", F.monotonically_increasing_id())
    centres = spark.sparkContext.broadcast(_centres(fitted, k))
    schema = "number long, id long, label long, v array<long>, row long, centre int, angle double, norm double"
    dealt = stored(every.mapInArrow(lean(_dealt(centres)), schema))

    # at most CENTRES rows for the cells and as many for the clusters
    figures = dealt.groupBy("centre", F.col("number").isNull().alias("row")).agg(F.count("*").alias("n"), F.max("angle").alias("angle"), F.max("norm").alias("norm")).collect()
    cell = sorted((r["centre"], r["angle"], r["norm"], -(-r["n"] // piece_rows)) for r in figures if r["row"])
    cells = spark.sparkContext.broadcast({c: np.array([r[i] for r in cell], t) for i, (c, t) in enumerate((("centre", int), ("angle", float), ("norm", float), ("pieces", int)))})
    block, room, blocks = -1, 0, []  # whole clusters fill blocks, large ones have several of their own
    for r in sorted((r for r in figures if not r["row"]), key=lambda r: r["centre"]):
        share = max(1, -(-r["n"] // block_anchors))
        if share > 1 or r["n"] > room:
            block, room = block + 1, block_anchors
        blocks.append((r["centre"], block, share, r["angle"], r["norm"]))
        block, room = block + share - 1, room - r["n"] if share == 1 else 0
    blocks = F.broadcast(spark.createDataFrame(blocks, "centre int, block int, share int, widest double, longest double"))
    pieces = F.broadcast(spark.createDataFrame([(r[0], r[3]) for r in cell], "centre int, pieces int"))

    placed = dealt.where("number is null").join(pieces, "centre").select(F.col("centre").alias("cell"), F.pmod(F.xxhash64("row"), "pieces").cast("int").alias("piece"), "id", "label", "v")
    asked = dealt.where("number is not null").join(blocks, "centre").withColumn("block", (F.col("block") + F.pmod(F.xxhash64("number"), "share")).cast("int"))
    asked = asked.select("number", "id", "label", "v", "centre", "block", "widest", "longest")
    no_windows = F.lit(None).cast("array<long>")

    def met(asked: DataFrame, low: int | None, k: int, seed: bool = False) -> DataFrame:
        """asked has floor and windows; the best k rows of each (number, positive)."""
        clusters = asked.groupBy("block", "centre").agg(F.max("widest").alias("widest"), F.max("longest").alias("longest"), F.min("floor").alias("floor"))
        meet = clusters.mapInArrow(_reachable(cells, centres, seed), "block int, cell int, piece int").distinct()
        left = placed.join(meet, ["cell", "piece"]).select("cell", "piece", "block", F.lit(None).cast("long").alias("number"), "id", "label", "v", F.lit(0).alias("centre"), F.lit(0.0).alias("widest"), F.lit(0.0).alias("floor"), no_windows.alias("windows"))
        right = asked.join(meet, "block").select(_MEET)
        found = left.unionByName(right).groupBy("cell", "piece", "block").applyInArrow(_search(centres, k, low), _FOUND)
        place = F.row_number().over(W.partitionBy("number", "positive").orderBy(F.desc("score"), "id"))
        return found.withColumn("rank", place).where(F.col("rank") <= k)

    none = F.lit(float("-inf"))
    first = met(asked.withColumn("floor", none).withColumn("windows", no_windows), None, positives, seed=True)
    floors = first.groupBy("number").agg(F.count("*").alias("n"), F.min("score").cast("double").alias("least")).where(F.col("n") >= positives)
    floored = asked.join(floors.select("number", "least"), "number", "left").withColumn("floor", F.coalesce("least", none)).withColumn("windows", no_windows)
    best = stored(met(floored, None, positives).select("number", "rank", F.col("id").alias("positive_id"), F.col("score").alias("positive_score")))

    # a positive with a score below zero has an empty window
    own = best.where("positive_score >= 0").groupBy("number").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_score"))).alias("p"))
    windowed = asked.join(own, "number").withColumn("windows", F.col("p.positive_score")).withColumn("floor", F.array_min("windows") * F.lit(low / 100.0) - 1e-6)
    taken = met(windowed, low, negatives).withColumn("at", F.col("positive") + 1)
    names = asked.select("number", F.col("id").alias("anchor_id"))
    good = best.join(names, "number").withColumnRenamed("rank", "at")
    return taken.select("number", "at", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score")).join(good, ["number", "at"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
