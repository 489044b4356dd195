"""Linear models of many groups and folds at once, from sums.

One aggregation gives each (group, fold) its count, sums and sums of products. The rows that a
fold trains on are its group's sums less its own, so no row is read again: scaling, fits for
every alpha, and scores on the fold all come from these sums, one small row per (group, fold).
Columns with large offsets should be centred first; sums of squares lose digits otherwise."""

from __future__ import annotations

from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

def gram(df: DataFrame, key: list[str], xs: list[str], y: str) -> DataFrame:
    """key, n and the sums s (of xs), p (of products a <= b), sxy, sy, syy. Rows with a null are left out."""
    d = df.select(*key, *(F.col(x).cast("double").alias(x) for x in xs), F.col(y).cast("double").alias("_y")).dropna(subset=[*xs, "_y"])
    arrays = {"s": [F.col(x) for x in xs], "p": [F.col(a) * F.col(b) for a, b in combinations_with_replacement(xs, 2)], "sxy": [F.col(x) * F.col("_y") for x in xs]}
    flat = d.groupBy(*key).agg(F.count("*").alias("n"), F.sum("_y").alias("sy"), F.sum(F.col("_y") * F.col("_y")).alias("syy"), *(F.sum(c).alias(f"_{name}{i}") for name, cols in arrays.items() for i, c in enumerate(cols)))
    return flat.select(*key, "n", "sy", "syy", *(F.array(*(f"_{name}{i}" for i in range(len(cols)))).alias(name) for name, cols in arrays.items()))


def _square(flat: np.ndarray, d: int) -> np.ndarray:
    full = np.zeros((len(flat), d, d))
    a, b = np.triu_indices(d)
    full[:, a, b] = flat
    full[:, b, a] = flat
    return full


def _solver(d: int, alphas: list[float], keep: list[str], lasso: bool, least: int):
    def run(folds: pa.Table) -> pa.Table:
        """All folds of a group."""
        folds = folds.combine_chunks()
        one = lambda c: folds.column(c).to_numpy().astype(float)
        many = lambda c: folds.column(c).combine_chunks().flatten().to_numpy().reshape(folds.num_rows, -1)
        test = {**{c: one(c) for c in ("n", "sy", "syy")}, **{c: many(c) for c in ("s", "p", "sxy")}}
        train = {c: x.sum(0, keepdims=True) - x for c, x in test.items()}
        fine = (test["n"] >= least) & (train["n"] >= least)
        test, train, folds = {c: x[fine] for c, x in test.items()}, {c: x[fine] for c, x in train.items()}, folds.filter(pa.array(fine))
        n = train["n"]
        mean, my = train["s"] / n[:, None], train["sy"] / n
        cov = _square(train["p"], d) / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
        sd = np.sqrt(np.maximum(np.diagonal(cov, axis1=1, axis2=2), 0))
        sd[sd == 0] = 1.0
        g = cov / (sd[:, :, None] * sd[:, None, :])  # of the scaled columns, a mean
        c = (train["sxy"] / n[:, None] - mean * my[:, None]) / sd
        m, sy = test["n"], test["sy"]
        sst = test["syy"] - sy**2 / m
        out = []
        for alpha in alphas:
            beta = _lasso(g, c, alpha) if lasso else np.einsum("kij,kj->ki", np.linalg.pinv(g + alpha / n[:, None, None] * np.eye(d), hermitian=True), c)
            w = beta / sd
            w0 = my - (w * mean).sum(1)
            sse = test["syy"] - 2 * (w0 * sy + (w * test["sxy"]).sum(1)) + m * w0**2 + 2 * w0 * (w * test["s"]).sum(1) + np.einsum("ki,kij,kj->k", w, _square(test["p"], d), w)
            r2 = pa.array(1 - sse / np.where(sst > 0, sst, 1), mask=~(sst > 0))
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, d, dtype=np.int32)), pa.array(x.ravel()))
            found = {"alpha": pa.array(np.full(len(n), alpha)), "n_train": pa.array(n.astype(np.int64)), "n_test": pa.array(m.astype(np.int64)), "intercept": pa.array(w0), "coef": lists(w), "scaled": lists(beta), "r2": r2, "mse": pa.array(sse / m)}
            out.append(pa.table({**{k: folds.column(k) for k in keep}, **found}))
        return pa.concat_tables(out)

    return run


def _lasso(g: np.ndarray, c: np.ndarray, alpha: float, rounds: int = 20_000, eps: float = 1e-12) -> np.ndarray:
    """Coordinate descent on all rows' normal equations: minimises b'gb/2 - c'b + alpha |b|."""
    beta = np.zeros_like(c)
    scale = np.maximum(np.diagonal(g, axis1=1, axis2=2), 1e-300)
    for _ in range(rounds):
        moved = 0.0
        for j in range(c.shape[1]):
            rest = c[:, j] - (g[:, j] * beta).sum(1) + g[:, j, j] * beta[:, j]
            new = np.sign(rest) * np.maximum(np.abs(rest) - alpha, 0) / scale[:, j]
            moved = max(moved, float(np.abs(new - beta[:, j]).max(initial=0)))
            beta[:, j] = new
        if moved < eps:
            return beta
    raise RuntimeError(f"coordinates still move by {moved} after {rounds} rounds")


def fit_folds(df: DataFrame, group: list[str], fold: str, xs: list[str], y: str, alphas: list[float], lasso: bool = False, least: int = 5) -> DataFrame:
    """group, fold, alpha, n_train, n_test, intercept, coef, scaled, r2, mse: for each fold of each
    group and each alpha the model fitted on the group's other folds, scored on the fold. Columns
    are scaled by the training rows' mean and population std; coef is for raw columns, scaled for
    scaled ones. alpha 0: least squares; alpha: ridge (added to the sums) or lasso (over means).
    Folds go where they or the rest have fewer rows than least. A group's folds meet in one task."""
    types = dict(df.dtypes)
    schema = ", ".join([*(f"`{k}` {types[k]}" for k in (*group, fold)), "alpha double, n_train long, n_test long, intercept double, coef array<double>, scaled array<double>, r2 double, mse double"])
    return gram(df, [*group, fold], xs, y).groupBy(*group).applyInArrow(_solver(len(xs), alphas, [*group, fold], lasso, least), schema)


def ridge_choice(fits: DataFrame, group: list[str], xs: list[str]) -> DataFrame:
    """group, alpha, feature, importance: of fit_folds over several alphas that with the highest mean
    r2 over the folds (ties: the least), and the mean absolute scaled coefficients of its fits."""
    mean = fits.groupBy(*group, "alpha").agg(F.avg("r2").alias("r2"), *(F.avg(F.abs(F.get("scaled", F.lit(i)))).alias(x) for i, x in enumerate(xs)))
    best = mean.groupBy(*group).agg(F.max_by(F.struct("alpha", *xs), F.struct("r2", (-F.col("alpha")).alias("less"))).alias("b")).select(*group, "b.*")
    return best.unpivot([*group, "alpha"], xs, "feature", "importance")
