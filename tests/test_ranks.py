"""Distributed places, sums, quantiles and rank statistics against plain versions."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadmesh.operators import ranks


def test_inversions_equal_a_count_of_pairs():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 17, 120):
        v, part = rng.integers(0, 12, n), rng.integers(0, 4, n)
        assert ranks.inversions(v) == sum(v[i] > v[j] for i in range(n) for j in range(i + 1, n))
        assert ranks.inversions(v, part) == sum(v[i] > v[j] and part[i] == part[j] for i in range(n) for j in range(i + 1, n))


def test_running_sums_and_followers_cross_ranges(spark):
    rng = np.random.default_rng(2)
    rows = [(g, int(v), int(n)) for g, size in (("a", 400), (None, 30), ("c", 1), ("d", 9)) for v, n in zip(rng.permutation(size), rng.integers(0, 5, size))]
    d = spark.createDataFrame([(*r, "x") for r in rows], "g string, v long, n long, place string").drop("place").repartition(5)
    got = sorted(map(tuple, ranks.running(d, ["g"], ["v"], ["n"], following="v").collect()), key=repr)
    want = []
    for g in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == g) if g else sorted((r for r in rows if r[0] is None), key=lambda r: r[1])
        total = 0
        for k, (_, v, n) in enumerate(mine):
            total += n
            want.append((g, v, n, k, total, mine[k + 1][1] if k + 1 < len(mine) else None))
    assert got == sorted(want, key=repr)
    assert ranks.running(d.where("false"), ["g"], ["v"], ["n"], following="v").count() == 0


@pytest.fixture(scope="module")
def matrix(spark):
    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, 220) * 1.0
    rows = [(i, float(x[i]), float(rng.normal()), float(round(x[i] + rng.normal())), 1.0 if i % 3 else 0.0) for i in range(220)]
    rows += [(300, None, 1.0, 2.0, 3.0), (301, 1.0, None, 2.0, 3.0), (302, 5.0, 0.5, 2.0, 1.0)]
    return rows, spark.createDataFrame(rows, "id long, f double, g double, h double, k double")


@pytest.mark.parametrize("block", [7, 40, 10_000])
def test_kendall_equals_all_pairs(matrix, block):
    rows, d = matrix
    got = {(r["a"], r["b"]): r["tau"] for r in ranks.kendall(d, ["f", "g", "h", "k"], block).collect()}
    cols = {"f": 1, "g": 2, "h": 3, "k": 4}
    assert len(got) == 6
    for a, b in combinations(cols, 2):
        v = [(r[cols[a]], r[cols[b]]) for r in rows if r[cols[a]] is not None and r[cols[b]] is not None]
        sign = lambda t: (t > 0) - (t < 0)
        s = [(sign(p[0] - q[0]), sign(p[1] - q[1])) for p, q in combinations(v, 2)]
        want = sum(x * y for x, y in s) / math.sqrt(sum(x * x for x, _ in s) * sum(y * y for _, y in s))
        assert math.isclose(got[a, b], want, abs_tol=1e-12)


def test_kendall_of_no_rows_and_of_a_constant(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert [r["tau"] for r in ranks.kendall(d, ["a", "b"]).collect()] == [None]
    assert ranks.kendall(d.where("false"), ["a", "b"]).count() == 0


def test_quantiles_and_average_ranks(matrix):
    rows, d = matrix
    got = {(r["k"], r["q"]): r["h"] for r in ranks.quantiles(d, ["k"], "h", [0.0, 0.25, 0.5, 0.9, 1.0]).collect()}
    for k in {r[4] for r in rows}:
        v = [r[3] for r in rows if r[4] == k]
        for q in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert math.isclose(got[k, q], float(np.quantile(v, q)), abs_tol=1e-12)
    f = sorted(r[1] for r in rows if r[1] is not None)
    got = {r["f"]: r["rank"] for r in ranks.average_ranks(d.where("f is not null").withColumn("one", F.lit(1)), ["one"], "f").collect()}
    assert got == {v: sum(i + 1 for i, x in enumerate(f) if x == v) / f.count(v) for v in set(f)}


def test_wasserstein_of_shifted_samples(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=90).round(1), rng.normal(size=90).round(1) + 1
    d = spark.createDataFrame([("a", float(x)) for x in a] + [("b", float(x)) for x in b] + [("c", 2.0), (None, 1.0), ("c", None)], "k string, x double").repartition(4)
    got = {(r["a"], r["b"]): r["distance"] for r in ranks.wasserstein(d, "k", "x").collect()}
    assert set(got) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert math.isclose(got["a", "b"], float(np.abs(np.sort(a) - np.sort(b)).mean()), abs_tol=1e-12) and math.isclose(got["a", "c"], float(np.abs(a - 2).mean()), abs_tol=1e-12)
