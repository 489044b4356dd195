"""Exact attribution against all subsets of features, walked down the trees one row at a time."""

from itertools import combinations
from math import factorial

import numpy as np
import pytest
from pyspark.ml.regression import RandomForestRegressor

from roadmesh.operators import attribution, forests, models

COLS = ["a", "b", "c", "d"]


@pytest.fixture(scope="module")
def grown(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(120, 4)).round(1)
    rows = [(k, *map(float, r), float(r[0] * r[1] + (r[2] > 0) * 3 - r[3] + rng.normal() * 0.1), k % 2) for k, r in enumerate(x)]
    d = spark.createDataFrame(rows, "row_id long, a double, b double, c double, d double, y double, fold int")
    fit = lambda k: RandomForestRegressor(labelCol="y", numTrees=3, maxDepth=6, seed=k).fit(models.assembled(d.where(f"fold <> {k}"), COLS))
    return x, d, [fit(0), fit(1)]


def expected(n, at, x, known):
    """What a tree expects below the node at, if only the features known of x are told."""
    if n["left"][at] == at:
        return n["value"][at]
    f, l, r = n["feature"][at], n["left"][at], n["right"][at]
    if f in known:
        return expected(n, l if x[f] <= n["threshold"][at] else r, x, known)
    return sum(expected(n, c, x, known) * n["cover"][c] for c in (l, r)) / n["cover"][at]


def by_subsets(n, root, x):
    m, out = len(x), np.zeros(len(x))
    for f in range(m):
        rest = [g for g in range(m) if g != f]
        for size in range(m):
            w = factorial(size) * factorial(m - 1 - size) / factorial(m)
            out[f] += sum(w * (expected(n, root, x, {*s, f}) - expected(n, root, x, set(s))) for s in combinations(rest, size))
    return out


def test_equals_all_subsets(grown):
    x, d, fitted = grown
    tables = [forests.node_table(m) for m in fitted]
    got = {r["row_id"]: r for r in attribution.forest_attribution(d.repartition(3), fitted, COLS).collect()}
    assert len(got) == 120
    for k in (0, 7, 55, 119):
        want = np.mean([np.mean([by_subsets(n, root, x[k]) for root in n["first"]], axis=0) for n in tables], axis=0)
        assert np.allclose([got[k][c] for c in COLS], want, atol=1e-9)


def test_values_add_up_to_the_prediction(grown):
    _, d, fitted = grown
    a = models.assembled(d, COLS)
    want = np.mean([[r["prediction"] for r in m.transform(a).orderBy("row_id").collect()] for m in fitted], axis=0)
    got = [r["base"] + sum(r[c] for c in COLS) for r in attribution.forest_attribution(d, fitted, COLS).orderBy("row_id").collect()]
    assert np.allclose(got, want)


def test_odd_rows(spark, grown):
    """Nulls go right as NaN does, equal and null keys stay, columns of any name, no rows, a tree without splits."""
    _, d, fitted = grown
    odd = spark.createDataFrame([(1, None, 0.5, 0.1, 2.0), (1, 1.0, None, 0.1, 2.0), (None, 1.0, 0.5, 0.1, 2.0)], "key long, base double, v0 double, c double, v1 double")
    got = attribution.forest_attribution(odd.withColumnRenamed("base", "left"), fitted, ["left", "v0", "c", "v1"], "key").collect()
    assert sorted((r["key"] is None, r["key"]) for r in got) == [(False, 1), (False, 1), (True, None)]
    nodes, x = forests.node_table(fitted[0]), np.array([[np.nan, 0.5, 0.1, 2.0]])
    per = [(attribution.conditions(nodes, k, 4), w) for k, w in enumerate(forests.walk(nodes, x, [6]))]
    assert all(np.isclose(c["base"] + attribution.tree_values(c, x).sum(), w[0][0]) for c, w in per)
    assert attribution.forest_attribution(d.limit(0), fitted, COLS).count() == 0
    flat = RandomForestRegressor(labelCol="y", numTrees=2, maxDepth=0, seed=1).fit(models.assembled(d, COLS))
    one = attribution.forest_attribution(d, [flat], COLS).first()
    assert [one[c] for c in COLS] == [0.0] * 4 and abs(one["base"]) > 0


def test_ranks_by_mean_absolute_value(grown):
    _, d, fitted = grown
    found = attribution.forest_attribution(d, fitted, COLS)
    rows = found.collect()
    want = sorted(((np.mean([abs(r[c]) for r in rows]), c) for c in COLS), reverse=True)
    got = sorted(attribution.mean_absolute(found, COLS).collect(), key=lambda r: r["rank"])
    assert [r["feature"] for r in got] == [c for _, c in want] and np.allclose([r["importance"] for r in got], [v for v, _ in want])


@pytest.mark.parametrize("wide", [12, 2])
def test_tables_of_patterns_equal_the_quadrature(grown, monkeypatch, wide):
    """F8: leaves are looked up in tables, those with more than WIDE features on their paths are not; rows with NaN too."""
    monkeypatch.setattr(attribution, "WIDE", wide)
    x, _, fitted = grown
    x = np.where(np.arange(x.size).reshape(x.shape) % 7 == 0, np.nan, x)
    for n in map(forests.node_table, fitted):
        for tree in range(len(n["first"])):
            c, out = attribution.conditions(n, tree, 4), np.zeros((4, len(x)))
            assert np.isclose(attribution.tabled_values(n, tree, x, out), c["base"])
            assert np.allclose(out.T, attribution.tree_values(c, x), atol=1e-12)


def test_blocks_of_rows_meet_groups_of_trees(grown, monkeypatch):
    """F8: any dealing gives the same values, one row for each of the input, with equal and null keys."""
    _, d, fitted = grown
    d = d.selectExpr("nullif(row_id % 50, 0) as row_id", *COLS)
    look = lambda: sorted(map(str, attribution.forest_attribution(d, fitted, COLS).selectExpr("row_id", *(f"round({c}, 9) + 0.0 as {c}" for c in COLS)).collect()))
    whole = look()
    monkeypatch.setattr(attribution, "ROWS", 50), monkeypatch.setattr(attribution, "GROUP", 4)
    assert look() == whole and len(whole) == 120


def test_forests_are_not_all_held(spark, grown, monkeypatch):
    """a forest is grown, attributed and let go; at most SIDE_BY_SIDE are begun and not yet done with."""
    _, d, fitted = grown
    began, done, most = [], [], []

    class Counted:
        def setLabelCol(self, y):
            return self

        def fit(self, rows):
            began.append(rows)
            most.append(len(began) - len(done))
            return fitted[0]

    table = attribution.node_table
    monkeypatch.setitem(attribution.MODELS, "counted", Counted)
    monkeypatch.setattr(attribution, "node_table", lambda m: (done.append(m), table(m))[1])
    got = attribution.forest_attribution(d, attribution.fold_forests(d, COLS, folds=7, model="counted"), COLS)
    one = attribution.forest_attribution(d, [fitted[0]], COLS)
    look = lambda x: sorted(map(str, x.selectExpr("row_id", *(f"round({c}, 9) + 0.0 as {c}" for c in COLS)).collect()))
    assert len(began) == 7 and max(most) <= attribution.SIDE_BY_SIDE and look(got) == look(one)
