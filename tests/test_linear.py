"""Grouped linear models against plain fits."""

import numpy as np
import pytest

from roadmesh.operators import linear, splits

XS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(1)
    out = []
    for g, n in (("p", 60), ("q", 35), ("r", 8)):
        x = rng.normal(size=(n, 3)) * [1, 5, 0.2]
        y = x @ [2, -1, 3] + rng.normal(size=n)
        out += [(g, i % 5, *map(float, x[i]), float(y[i])) for i in range(n)]
    return out


def plain(train, test, alpha):
    x, y = train[:, :3], train[:, 3]
    mean, sd = x.mean(0), x.std(0)
    z = (x - mean) / sd
    beta = np.linalg.solve(z.T @ z + alpha * np.eye(3), z.T @ (y - y.mean()))
    p = y.mean() + (test[:, :3] - mean) / sd @ beta
    return beta, 1 - ((test[:, 3] - p) ** 2).sum() / ((test[:, 3] - test[:, 3].mean()) ** 2).sum()


def test_folds_equal_fits_one_by_one(spark, rows):
    d = spark.createDataFrame([*rows, ("p", 0, None, 1.0, 1.0, 1.0), ("p", 0, 1.0, 1.0, 1.0, None)], "g string, fold int, a double, b double, c double, y double").repartition(3)
    got = {(r["g"], r["fold"], r["alpha"]): r for r in linear.fit_folds(d, ["g"], "fold", XS, "y", [0.0, 2.0]).collect()}
    assert {k[0] for k in got} == {"p", "q"} and len(got) == 20  # the folds of r are too small
    for (g, fold, alpha), r in got.items():
        mine = np.array([x[2:] for x in rows if x[0] == g and x[1] != fold]), np.array([x[2:] for x in rows if x[0] == g and x[1] == fold])
        beta, r2 = plain(*mine, alpha)
        assert np.allclose(r["scaled"], beta) and np.isclose(r["r2"], r2) and (r["n_train"], r["n_test"]) == tuple(map(len, mine))


def test_lasso_meets_its_conditions(spark, rows):
    d = spark.createDataFrame(rows, "g string, fold int, a double, b double, c double, y double").where("g = 'p'")
    for r in linear.fit_folds(d, ["g"], "fold", XS, "y", [0.5], lasso=True).collect():
        t = np.array([x[2:] for x in rows if x[0] == "p" and x[1] != r["fold"]])
        z, y = (t[:, :3] - t[:, :3].mean(0)) / t[:, :3].std(0), t[:, 3] - t[:, 3].mean()
        beta = np.array(r["scaled"])
        slope = z.T @ (y - z @ beta) / len(y)
        assert all(np.isclose(s, 0.5 * np.sign(b)) if b else abs(s) <= 0.5 + 1e-9 for s, b in zip(slope, beta))


def test_no_rows_constant_columns_and_folds_within(spark, rows):
    d = spark.createDataFrame(rows, "g string, fold int, a double, b double, c double, y double")
    assert linear.fit_folds(d.where("false"), ["g"], "fold", XS, "y", [1.0]).count() == 0
    one = linear.fit_folds(d.selectExpr("g", "fold", "a", "1.0D as b", "c", "y"), ["g"], "fold", XS, "y", [0.0]).first()
    assert one["scaled"][1] == 0.0
    f = splits.contiguous_folds_within(d.selectExpr("g", "monotonically_increasing_id() as id"), ["g"], "id", 7).groupBy("g", "fold").count().collect()
    assert sorted(r["count"] for r in f if r["g"] == "p") == [8, 8, 8, 9, 9, 9, 9] and sorted(r["count"] for r in f if r["g"] == "r") == [1] * 6 + [2]


def test_strips_within_equal_strips_of_each_group(spark):
    rng = np.random.default_rng(5)
    rows = [(g, int(x), int(x) + 1) for g, n in (("p", 9), ("q", 4), ("r", 1)) for x in rng.choice(12, n, replace=False)]
    d = spark.createDataFrame(rows, "g string, w int, e int")
    got = sorted(map(tuple, splits.strips_within(d, ["g"], "w", "e", 3).collect()))
    want = []
    for g in "pqr":
        want += [tuple(r) for r in splits.strips(d.where(f"g = '{g}'"), "w", "e", 3).collect()]
    assert got == sorted(want) and got
