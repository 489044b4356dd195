"""Exact attribution of forests: the Shapley values of all features of every row.

A leaf asks the features on its path to lie in intervals. With a set S of a row's features known,
a tree expects the sum over its leaves of value * product over the path's features, where a
feature in S counts 1 inside its interval and 0 outside, and any other counts the share of the
training rows that went that way. Shapley values of such a product are integrals over t in [0, 1]
of products of t * inside + (1 - t) * share: polynomials, so that half as many Gauss-Legendre points
as a path has features give them exactly. A row meets a leaf only by which features are outside their
intervals, so each leaf has a table of these patterns, and rows look their values up."""

from __future__ import annotations

import functools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.regression import RandomForestRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .forests import ahead, node_table
from .models import MODELS, assembled
from .order import cut

#: So many cells of rows x conditions, or of tables, are held at once.
CELLS = 1 << 20
#: Leaves with so many features on their paths at most have tables of their patterns.
WIDE = 12
#: Rows of a block and trees of a group that meet in one task.
ROWS, GROUP = 8192, 25
#: So many forests are grown or held at a time.
SIDE_BY_SIDE = 2


def conditions(nodes: dict[str, np.ndarray], tree: int, features: int) -> dict[str, np.ndarray]:
    """The tree's leaves as conditions in order of leaves: leaf, feature, low, high (low < x <= high),
    share; start (of each leaf that has conditions), value (of those leaves) and base, what the
    tree expects of an unknown row."""
    first = nodes["first"][tree]
    end = nodes["first"][tree + 1] if tree + 1 < len(nodes["first"]) else len(nodes["left"])
    left, right, by, at, cover, value = (nodes[c][first:end] for c in ("left", "right", "feature", "threshold", "cover", "value"))
    left, right, n = left - first, right - first, end - first
    low, high, share = np.full((n, features), -np.inf), np.full((n, features), np.inf), np.ones((n, features))
    level = np.zeros(1, np.int64)
    while len(level := level[left[level] != level]):
        f, t = by[level], at[level]
        for child, upper in ((left[level], True), (right[level], False)):
            low[child], high[child], share[child] = low[level], high[level], share[level]
            share[child, f] *= cover[child] / cover[level]
            if upper:
                high[child, f] = np.minimum(high[child, f], t)
            else:
                low[child, f] = np.maximum(low[child, f], t)
        level = np.r_[left[level], right[level]]
    leaves = np.flatnonzero(left == np.arange(n))
    leaf, feature = np.nonzero(np.isfinite(low[leaves]) | np.isfinite(high[leaves]))
    start = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]]) if len(leaf) else np.zeros(0, np.int64)
    pick = lambda a: a[leaves[leaf], feature]
    return {"leaf": leaf, "feature": feature, "low": pick(low), "high": pick(high), "share": pick(share), "start": start, "value": value[leaves], "base": float((value[leaves] * share[leaves].prod(1)).sum())}


def tree_values(c: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """The Shapley values, rows x features, that one tree's conditions give the rows x."""
    out = np.zeros(x.shape)
    if not len(c["leaf"]):
        return out
    most = int(np.diff(np.r_[c["start"], len(c["leaf"])]).max())
    points, weights = np.polynomial.legendre.leggauss((most + 1) // 2)
    order = np.argsort(c["feature"], kind="stable")
    sorted_ = c["feature"][order]
    edges = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]])
    step = max(CELLS // len(order), 1)
    for a in range(0, len(x), step):
        v = x[a : a + step, c["feature"]]
        inside = (~(v <= c["low"]) & ((v <= c["high"]) | np.isposinf(c["high"]))).astype(float)
        total = np.zeros_like(inside)
        for t, w in zip((points + 1) / 2, weights / 2):
            z = t * inside + (1 - t) * c["share"]
            total += w * np.multiply.reduceat(z, c["start"], axis=1)[:, c["leaf"]] / z
        total *= (inside - c["share"]) * c["value"][c["leaf"]]
        out[a : a + step, sorted_[edges]] += np.add.reduceat(total[:, order], edges, axis=1)
    return out


def path_tables(shares: np.ndarray, values: np.ndarray) -> np.ndarray:
    """leaves x features on the path x patterns: the Shapley values that leaves of so many features on
    their paths give. Bit k of a pattern is 1 if feature k is outside its interval."""
    n, d = shares.shape
    points, weights = np.polynomial.legendre.leggauss((d + 1) // 2)
    out = np.zeros((n, d, 1 << d))
    for t, w in zip((points + 1) / 2, weights / 2):
        within, without = t + (1 - t) * shares, (1 - t) * shares
        product = w * values[:, None]
        for k in range(d):
            product = np.concatenate([product * within[:, k, None], product * without[:, k, None]], axis=1)
        for k in range(d):
            sides, to = product.reshape(n, -1, 2, 1 << k), out[:, k].reshape(n, -1, 2, 1 << k)
            to[:, :, 0] += sides[:, :, 0] * ((1 - shares[:, k]) / within[:, k])[:, None, None]
            to[:, :, 1] -= sides[:, :, 1] * (shares[:, k] / without[:, k])[:, None, None]
    return out


def tabled_values(nodes: dict[str, np.ndarray], tree: int, x: np.ndarray, out: np.ndarray) -> float:
    """Adds the Shapley values of one tree to out, features x rows, and returns what it expects of an
    unknown row. A leaf's values depend on a row only by which of its path's features are outside: they are
    looked up in a table of these patterns, made once for all rows. Leaves with more than WIDE
    features go by tree_values()."""
    first = nodes["first"][tree]
    end = nodes["first"][tree + 1] if tree + 1 < len(nodes["first"]) else len(nodes["left"])
    left, right, by, at, cover, value = (nodes[c][first:end] for c in ("left", "right", "feature", "threshold", "cover", "value"))
    left, right, n = left - first, right - first, end - first
    # place: of each feature among those of a node's path, share: of the rows that it sends on
    place, share, used = np.full((n, x.shape[1]), -1, np.int8), np.ones((n, x.shape[1])), np.zeros(n, np.int64)
    level, outside, leaves, patterns, columns = np.zeros(1, np.int64), np.zeros((1, len(x)), np.uint16), [], [], np.ascontiguousarray(x.T)
    while len(level):
        inner = left[level] != level
        leaves.append(level[~inner]), patterns.append(outside[~inner])
        level, outside = level[inner], outside[inner]
        f = by[level]
        new = place[level, f] < 0
        k = np.where(new, used[level], place[level, f])
        bit = np.where(k < 16, 1 << np.minimum(k, 15), 0).astype(np.uint16)[:, None]
        goes = columns[f] <= at[level][:, None]
        sides = []
        for child, other in ((left[level], ~goes), (right[level], goes)):
            place[child], share[child], used[child] = place[level], share[level], used[level] + new
            place[child, f] = k
            share[child, f] *= cover[child] / cover[level]
            sides.append(outside | other * bit)
        level, outside = np.r_[left[level], right[level]], np.concatenate(sides)
    leaves, patterns = np.concatenate(leaves), np.concatenate(patterns)
    for d in np.unique(used[leaves]):
        here = np.flatnonzero(used[leaves] == d)
        if not d:
            continue
        if d > WIDE:
            out += tree_values(_only(conditions(nodes, tree, x.shape[1]), d), x).T
            continue
        features = np.argsort(np.where(place[leaves[here]] < 0, x.shape[1], place[leaves[here]]), axis=1, kind="stable")[:, :d]
        step = max(CELLS // (d << d), 1)
        for a in range(0, len(here), step):
            some, of = here[a : a + step], features[a : a + step]
            tables = path_tables(np.take_along_axis(share[leaves[some]], of, 1), value[leaves[some]])
            for table, fs, row in zip(tables, of, some):
                pattern = patterns[row].astype(np.intp)
                for k, f in enumerate(fs):
                    out[f] += table[k].take(pattern)
    return float((value[leaves] * share[leaves].prod(1)).sum())


def _only(c: dict[str, np.ndarray], d: int) -> dict[str, np.ndarray]:
    """conditions() of the leaves with d of them."""
    sizes = np.bincount(c["leaf"], minlength=len(c["value"]))
    keep = sizes[c["leaf"]] == d
    leaf = c["leaf"][keep]
    number = np.cumsum(np.r_[True, leaf[1:] != leaf[:-1]]) - 1
    start = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1]])
    return {"leaf": number, **{k: c[k][keep] for k in ("feature", "low", "high", "share")}, "start": start, "value": c["value"][leaf[start]]}


def _values(shared, features: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task holds one block of rows for one group of a forest's trees."""
        batches = [b for b in batches if b.num_rows]
        if not batches:
            return
        nodes = shared.value
        t = pa.Table.from_batches(batches).combine_chunks()
        x = np.column_stack([t.column(3 + k).to_numpy().astype(float) for k in range(features)])
        found, base, trees = np.zeros((features, len(x))), 0.0, len(nodes["first"])
        for tree in _group(trees, t.column(2)[0].as_py()):
            one = np.zeros_like(found)
            base += tabled_values(nodes, tree, x, one) / trees
            found += one / trees
        columns = [c.combine_chunks() for c in t.columns[:2]]
        yield from pa.table([*columns, pa.array(np.full(len(x), base)), *(pa.array(v) for v in found)], names=["id", "key", "base", *(f"v{k}" for k in range(features))]).to_batches()

    return run


def _group(trees: int, group: int) -> range:
    return range(group * GROUP, min((group + 1) * GROUP, trees))


def forest_attribution(df: DataFrame, models: Iterable[RandomForestRegressionModel], cols: list[str], key: str = "row_id") -> DataFrame:
    """key, base and a column for each of cols: exact Shapley values, the mean over the models (of
    the folds). base and a row's values add up to the models' mean prediction. A null feature goes right at
    each split, as NaN does; rows with equal or null keys are rows of their own; no rows give none. Models
    follow each other: the nodes of one go to every task, as they do when a model is applied, and what it gives
    the rows is written before the next. Blocks of rows meet groups of trees, one pair a task, and what the
    groups of all models give a row is added up."""
    session, kind = df.sparkSession, dict(df.dtypes)[key]
    names = [f"v{k}" for k in range(len(cols))]
    rows = cut(df.select(F.monotonically_increasing_id().alias("id"), F.col(key).alias("key"), *(F.col(c).cast("double").alias(v) for c, v in zip(cols, names))))
    blocks, parts = 1 + rows.count() // ROWS, []
    for nodes in map(node_table, models):
        groups = -(-len(nodes["first"]) // GROUP)
        shared = session.sparkContext.broadcast(nodes)
        dealt = rows.select("id", "key", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))).alias("group"), *names)
        dealt = dealt.repartitionById(blocks * groups, (F.pmod(F.xxhash64("id"), F.lit(blocks)) * groups + F.col("group")).cast("int"))
        parts.append(cut(dealt.mapInArrow(_values(shared, len(cols)), ", ".join(["id long", f"key {kind}", "base double", *(f"{v} double" for v in names)]))))
        shared.unpersist()
    added = functools.reduce(DataFrame.unionByName, parts).groupBy("id", "key").agg(*((F.sum(c) / len(parts)).alias(c) for c in ("base", *names)))
    return added.select(F.col("key").alias(key), "base", *(F.col(v).alias(c) for c, v in zip(cols, names)))


def fold_forests(df: DataFrame, cols: list[str], y: str = "y", fold: str = "fold", folds: int = 7, model: str = "RF") -> Iterator[RandomForestRegressionModel]:
    """A forest for each fold, grown on the rows of the others; SIDE_BY_SIDE of them are grown or held at a time, as
    the driver holds a model's nodes."""
    a = assembled(df, cols).select("features", y, fold).persist()
    try:
        yield from ahead(lambda k: MODELS[model]().setLabelCol(y).fit(a.where(F.col(fold) != k)), range(folds), SIDE_BY_SIDE)
    finally:
        a.unpersist()


def mean_absolute(found: DataFrame, cols: list[str]) -> DataFrame:
    """feature, importance, rank: the mean absolute attribution, the greatest first, ties by name."""
    one = found.agg(*(F.avg(F.abs(c)).alias(c) for c in cols)).unpivot([], cols, "feature", "importance")
    places = F.array_sort(F.collect_list(F.struct((-F.col("importance")).alias("down"), "feature")))
    ranked = one.agg(places.alias("s")).select(F.posexplode("s").alias("at", "s"))  # a row for each feature
    return ranked.select(F.col("s.feature").alias("feature"), (-F.col("s.down")).alias("importance"), (F.col("at") + 1).cast("long").alias("rank"))
