"""Clusters of series by warping distance: a table of pairs, and medoids on it.

The keys are series of a report (a city's feature over its scales), at most MOST of them; more
raise an error, as pairs grow with the square."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import cut

MOST = 5000


def warped(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Dynamic time warping of each row of a with the same row of b, steps cost |difference|."""
    before = np.full((len(a), b.shape[1] + 1), np.inf)
    before[:, 0] = 0.0
    for i in range(a.shape[1]):
        row = np.full_like(before, np.inf)
        for j in range(b.shape[1]):
            row[:, j + 1] = np.abs(a[:, i] - b[:, j]) + np.minimum(np.minimum(row[:, j], before[:, j]), before[:, j + 1])
        before = row
    return before[:, -1]


def _warp(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        va, vb = (batch.column(batch.schema.get_field_index(c)) for c in ("va", "vb"))
        la, lb = (v.value_lengths().to_numpy() for v in (va, vb))
        out = np.zeros(batch.num_rows)
        for m, n in set(zip(la.tolist(), lb.tolist())):
            mine = np.flatnonzero((la == m) & (lb == n))
            rows = [np.array(v.take(pa.array(mine)).to_pylist(), float).reshape(len(mine), k) for v, k in ((va, m), (vb, n))]
            out[mine] = warped(*rows) if m and n else (0.0 if m == n else np.inf)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], ["a", "b", "distance"])


def warping_pairs(series: DataFrame, key: str, values: str = "values") -> DataFrame:
    """a < b, distance of every two series (arrays of numbers without nulls)."""
    s = cut(series.select(F.col(key).alias("k"), F.col(values).cast("array<double>").alias("v")).where("k is not null and v is not null"))
    if (n := s.count()) > MOST:
        raise ValueError(f"{n} series, at most {MOST}")
    a, b = s.select(F.col("k").alias("a"), F.col("v").alias("va")), s.select(F.col("k").alias("b"), F.col("v").alias("vb"))
    kind = dict(s.dtypes)["k"]
    return a.join(b, F.col("a") < F.col("b")).select("a", "b", "va", "vb").mapInArrow(_warp, f"a {kind}, b {kind}, distance double")


def both_ways(pairs: DataFrame) -> DataFrame:
    """a, b, distance in both directions, and each key with itself."""
    keys = pairs.select(F.explode(F.array("a", "b")).alias("a")).distinct()
    return cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "distance")).unionByName(keys.select("a", F.col("a").alias("b"), F.lit(0.0).alias("distance"))))


def medoids(table: DataFrame, k: int, rounds: int = 50) -> DataFrame:
    """a, medoid, distance over both_ways(): from the key nearest to all and then the farthest ones,
    keys join their nearest medoid and each cluster's most central key becomes its medoid, until
    nothing moves. Ties go to the lesser key, so equal series share a cluster and fewer than k may come out. The driver holds the k medoids only."""
    first = table.groupBy("a").agg(F.sum("distance").alias("d")).orderBy("d", "a").first()
    chosen = [first["a"]] if first else []
    nearest = lambda: table.where(F.col("b").isin(chosen)).groupBy("a").agg(F.min(F.struct("distance", "b")).alias("m")).select("a", F.col("m.b").alias("medoid"), F.col("m.distance").alias("distance"))
    while chosen and len(chosen) < k:
        far = nearest().where(~F.col("a").isin(chosen)).orderBy(F.desc("distance"), "a").first()
        if not far:
            break
        chosen.append(far["a"])
    for _ in range(rounds):
        now = cut(nearest())
        inner = table.join(now.select("a", "medoid"), "a").join(now.select(F.col("a").alias("b"), F.col("medoid").alias("other")), "b").where("medoid = other")
        cost = inner.groupBy("medoid", "a").agg(F.sum("distance").alias("d"))
        new = [r["a"] for r in cost.groupBy("medoid").agg(F.min(F.struct("d", "a")).alias("m")).select("m.a").collect()]
        if sorted(new) == sorted(chosen):
            return now
        chosen = new
    raise RuntimeError(f"medoids still move after {rounds} rounds")


def quality(table: DataFrame, clusters: DataFrame) -> DataFrame:
    """inertia (sum of distances to the medoids) and mean silhouette, both of pairs' distances.
    A key alone in its cluster counts 0."""
    other = clusters.select(F.col("a").alias("b"), F.col("medoid").alias("of"))
    means = table.where("a <> b").join(other, "b").groupBy("a", "of").agg(F.avg("distance").alias("d")).join(clusters.select("a", "medoid"), "a")
    own, near = F.max(F.when(F.col("of") == F.col("medoid"), F.col("d"))), F.min(F.when(F.col("of") != F.col("medoid"), F.col("d")))
    each = means.groupBy("a").agg(own.alias("own"), near.alias("near"))
    value = F.when(F.col("own").isNull() | F.col("near").isNull(), 0.0).otherwise(F.coalesce(F.try_divide(F.col("near") - F.col("own"), F.greatest("near", "own")), F.lit(0.0)))
    return each.agg(F.avg(value).alias("silhouette")).join(clusters.agg(F.sum("distance").alias("inertia")))


def medians(clusters: DataFrame, series: DataFrame, key: str, values: str = "values") -> DataFrame:
    """medoid, size, medians: each cluster's number of series and their median by position."""
    j = clusters.join(series.select(F.col(key).alias("a"), F.posexplode(values).alias("at", "v")), "a")
    per = j.groupBy("medoid", "at").agg(F.median("v").alias("v"))  # at most MOST values
    sizes = clusters.groupBy("medoid").agg(F.count("*").alias("size"))
    return per.groupBy("medoid").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "v"))), lambda s: s["v"]).alias("medians")).join(sizes, "medoid").select("medoid", "size", "medians")
