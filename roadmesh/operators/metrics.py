"""Distribution distances, correlations, thresholds and scores."""

from __future__ import annotations

from itertools import combinations_with_replacement

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import ranked_columns


def corr_matrix(df: DataFrame, cols: list[str], method: str = "pearson") -> DataFrame:
    """a, b, r for all pairs (a <= b) in one aggregation. Spearman takes average ranks first."""
    if method == "spearman":
        df = ranked_columns(df, cols)
    pairs = list(combinations_with_replacement(cols, 2))
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    long = one.unpivot([], list(one.columns), "pair", "r")
    return long.select(F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "r")


def histogram(df: DataFrame, col: str, bins: int, low: float, high: float, group: list[str] | None = None) -> DataFrame:
    """Counts in equal bins over [low, high]; the last bin is closed."""
    step = (high - low) / bins
    b = F.least(F.floor((F.col(col) - low) / step), F.lit(bins - 1))
    return df.where(F.col(col).between(low, high)).groupBy(*(group or []), b.alias("bin")).agg(F.count("*").alias("n"))


def histogram_step(df: DataFrame, col: str, step: float = 0.3, last: int = 36) -> DataFrame:
    """Counts in steps; values past the last whole step fall out."""
    b = F.floor(F.col(col) / step)
    return df.where((F.col(col) >= 0) & (b < last)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def otsu(df: DataFrame, col: str, bins: int, low: float, high: float) -> DataFrame:
    """The bin whose upper edge parts the values with the greatest variance between."""
    h = histogram(df, col, bins, low, high)
    w = W.partitionBy(F.lit(0)).orderBy("bin")
    up, all_ = w.rowsBetween(W.unboundedPreceding, 0), W.partitionBy(F.lit(0))
    h = h.withColumns({"c": F.sum("n").over(up), "m": F.sum(F.col("n") * F.col("bin")).over(up), "nc": F.sum("n").over(all_), "nm": F.sum(F.col("n") * F.col("bin")).over(all_)}).where("c < nc")
    between = F.col("c") * (F.col("nc") - F.col("c")) * F.pow(F.col("m") / F.col("c") - (F.col("nm") - F.col("m")) / (F.col("nc") - F.col("c")), 2)
    best = h.withColumn("v", F.round(between, 3)).agg(F.min(F.struct((-F.col("v")).alias("v"), "bin"))["bin"].alias("bin"))
    return best.select("bin", (low + (F.col("bin") + 1) * ((high - low) / bins)).alias("threshold"))


def key_pairs(df: DataFrame, key: str) -> DataFrame:
    """a < b: every two keys. For few keys, such as cities."""
    keys = df.select(key).where(F.col(key).isNotNull()).distinct()
    return keys.select(F.col(key).alias("a")).join(keys.select(F.col(key).alias("b")), F.col("a") < F.col("b"))


def js_distance(df: DataFrame, key: str, value: str, bins: int, low: float, high: float) -> DataFrame:
    """a < b, distance: Jensen-Shannon (natural log) of the keys' histograms on shared bins."""
    h = histogram(df, value, bins, low, high, [key])
    h = h.withColumn("p", F.col("n") / F.sum("n").over(W.partitionBy(key))).select(F.col(key).alias("k"), "bin", "p")
    pairs = key_pairs(h, "k")
    both = pairs.join(h.withColumnRenamed("k", "a"), "a").select("a", "b", "bin", F.col("p").alias("pa"), F.lit(0.0).alias("pb")).unionByName(pairs.join(h.withColumnRenamed("k", "b"), "b").select("a", "b", "bin", F.lit(0.0).alias("pa"), F.col("p").alias("pb")))
    m = both.groupBy("a", "b", "bin").agg(F.sum("pa").alias("pa"), F.sum("pb").alias("pb")).withColumn("m", (F.col("pa") + F.col("pb")) / 2)
    kl = lambda c: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / F.col("m"))).otherwise(0.0)
    return m.groupBy("a", "b").agg(F.sqrt(F.greatest(F.sum(kl("pa") + kl("pb")) / 2, F.lit(0.0))).alias("distance"))


def moments(df: DataFrame, key: list[str], cols: list[str], epsilon: float = 0.0) -> DataFrame:
    """Means and sample covariances per key, long; epsilon is added to the variances."""
    one = df.groupBy(*key).agg(*[F.avg(c).alias(f"{c}|") for c in cols], *[(F.covar_samp(a, b) + (epsilon if a == b else 0.0)).alias(f"{a}|{b}") for a, b in combinations_with_replacement(cols, 2)])
    long = one.unpivot(key, [c for c in one.columns if c not in key], "pair", "value")
    return long.select(*key, F.split_part("pair", F.lit("|"), F.lit(1)).alias("a"), F.split_part("pair", F.lit("|"), F.lit(2)).alias("b"), "value")


def scores(df: DataFrame, key: list[str], y: str = "y", p: str = "p") -> DataFrame:
    """R2, MSE and explained variance per key."""
    err = F.col(y) - F.col(p)
    return df.groupBy(*key).agg((1 - F.try_divide(F.avg(err * err), F.var_pop(y))).alias("r2"), F.avg(err * err).alias("mse"), (1 - F.try_divide(F.var_pop(err), F.var_pop(y))).alias("explained"))


def weighted_kappa(df: DataFrame, a: str = "a", p: str = "p") -> DataFrame:
    """Quadratic weighted kappa of values cut to integers; weights go by the position of a
    label in the sorted union of labels."""
    d = df.select(F.col(a).cast("int").alias("a"), F.col(p).cast("int").alias("p"))
    cells = d.groupBy("a", "p").agg(F.count("*").alias("o"))
    labels = cells.select(F.explode(F.array("a", "p")).alias("l")).distinct()
    labels = labels.withColumn("at", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("l")))
    rows = cells.groupBy("a").agg(F.sum("o").alias("ra")).join(labels, F.col("a") == F.col("l")).select("a", "ra", F.col("at").alias("i"))
    cols = cells.groupBy("p").agg(F.sum("o").alias("cp")).join(labels, F.col("p") == F.col("l")).select("p", "cp", F.col("at").alias("j"))
    # sum of w * e over all label pairs, from the marginals' moments: no pairs are made
    e = rows.agg(F.sum("ra").alias("n"), F.sum(F.col("ra") * F.col("i")).alias("s1"), F.sum(F.col("ra") * F.col("i") * F.col("i")).alias("s2"))
    f = cols.agg(F.sum(F.col("cp") * F.col("j")).alias("t1"), F.sum(F.col("cp") * F.col("j") * F.col("j")).alias("t2"))
    o = cells.join(rows.select("a", "i"), "a").join(cols.select("p", "j"), "p").agg(F.sum(F.col("o") * F.pow(F.col("i") - F.col("j"), 2)).alias("wo"))
    expected = (F.col("n") * F.col("s2") + F.col("n") * F.col("t2") - 2 * F.col("s1") * F.col("t1")) / F.col("n")
    return e.join(f).join(o).select((1 - F.try_divide(F.col("wo"), expected)).alias("kappa"))


def sensitivity_ratio(df: DataFrame, key: list[str], attribution: str, x: str) -> DataFrame:
    """Difference of the mean attributions above and below zero, over the difference of the
    mean inputs there; all 0 where a side is empty."""
    part = lambda c, up: F.avg(F.when(F.col(attribution) > 0 if up else F.col(attribution) < 0, F.col(c)))
    d = df.groupBy(*key).agg((part(attribution, True) - part(attribution, False)).alias("num"), (part(x, True) - part(x, False)).alias("den"))
    one_sided = F.col("num").isNull()
    return d.select(*key, F.when(one_sided, 0.0).otherwise(F.try_divide("num", "den")).alias("ratio"), F.coalesce("num", F.lit(0.0)).alias("num"), F.coalesce("den", F.lit(0.0)).alias("den"))


def jf_against_ratio(jf: DataFrame, free_flow: DataFrame, speed: DataFrame, key: list[str]) -> DataFrame:
    """jf(nid, key, jf) with the free-flow speed ff of its segment over the speed sp of its
    sample, cut to 0 to 10."""
    ratio = F.greatest(F.least(F.try_divide("ff", "sp"), F.lit(10.0)), F.lit(0.0))
    return jf.join(free_flow.select("nid", "ff"), "nid").join(speed.select("nid", *key, "sp"), ["nid", *key]).withColumn("ratio", ratio)


def score_table(scored: DataFrame, fold: str, folds: int, value: str = "r2", key: list[str] | None = None) -> DataFrame:
    """Mean and population std of a score over the folds, and the score of each fold."""
    return scored.groupBy(*(key or [])).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), *[F.max(F.when(F.col(fold) == k, F.col(value))).alias(f"fold{k}") for k in range(folds)])
