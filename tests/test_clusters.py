"""Clusters by warping distance against plain versions."""

import math

import numpy as np
import pytest

from roadmesh.operators import clusters


def plain(a, b):
    d = np.full((len(a) + 1, len(b) + 1), np.inf)
    d[0, 0] = 0
    for i in range(len(a)):
        for j in range(len(b)):
            d[i + 1, j + 1] = abs(a[i] - b[j]) + min(d[i, j], d[i, j + 1], d[i + 1, j])
    return d[-1, -1]


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(3)
    shapes = [np.sin(np.arange(10) / 2), np.linspace(-1, 1, 10), -np.linspace(-1, 1, 10)]
    rows = [(f"s{i:02}", [float(x) for x in shapes[i % 3][: 10 - i % 2] + rng.normal(size=10 - i % 2) * 0.02]) for i in range(15)]
    return rows, spark.createDataFrame([*rows, (None, [1.0]), ("zz", None)], "k string, values array<double>")


def test_pairs_and_clusters(table):
    rows, d = table
    pairs = {(r["a"], r["b"]): r["distance"] for r in clusters.warping_pairs(d, "k").collect()}
    values = dict(rows)
    assert len(pairs) == 105 and all(math.isclose(x, plain(values[a], values[b]), abs_tol=1e-12) for (a, b), x in pairs.items())
    both = clusters.both_ways(clusters.warping_pairs(d, "k"))
    got = clusters.medoids(both, 3)
    of = {r["a"]: r["medoid"] for r in got.collect()}
    assert len(set(of.values())) == 3 and all((of[a] == of[b]) == (int(a[1:]) % 3 == int(b[1:]) % 3) for a in of for b in of)
    full = lambda a, b: 0.0 if a == b else pairs[min(a, b), max(a, b)]
    for m in set(of.values()):
        mine = [a for a in of if of[a] == m]
        assert m == min(mine, key=lambda a: (sum(full(a, b) for b in mine), a))
    q = clusters.quality(both, got).first()
    sil = []
    for a in of:
        mean = {m: np.mean([full(a, b) for b in of if of[b] == m and b != a]) for m in set(of.values())}
        own, near = mean[of[a]], min(v for m, v in mean.items() if m != of[a])
        sil.append((near - own) / max(near, own))
    assert math.isclose(q["silhouette"], np.mean(sil)) and math.isclose(q["inertia"], sum(full(a, m) for a, m in of.items()))
    med = {r["medoid"]: r for r in clusters.medians(got, d, "k").collect()}
    assert {r["size"] for r in med.values()} == {5} and all(np.allclose(r["medians"][0], np.median([values[a][0] for a in of if of[a] == m])) for m, r in med.items())


def test_few_and_too_many(spark, table, monkeypatch):
    one = spark.createDataFrame([("a", [1.0]), ("b", [1.0])], "k string, values array<double>")
    got = clusters.medoids(clusters.both_ways(clusters.warping_pairs(one, "k")), 5).collect()
    assert {(r["a"], r["medoid"], r["distance"]) for r in got} == {("a", "a", 0.0), ("b", "a", 0.0)}  # equal series share a cluster
    monkeypatch.setattr(clusters, "MOST", 3)
    with pytest.raises(ValueError, match="at most 3"):
        clusters.warping_pairs(table[1], "k")
