"""Projections, masks, pivots, normalisation and ranking of report tables."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ranks import quantiles


def select_features(df: DataFrame, wanted: list[str]) -> DataFrame:
    return df.select([c for c in wanted if c in df.columns])


def cols_like(df: DataFrame, pattern: str) -> DataFrame:
    return df.select([c for c in df.columns if re.search(pattern, c)])


def drop_features(df: DataFrame, cols: list[str]) -> DataFrame:
    return df.drop(*cols)


def rename_features(df: DataFrame, names: dict[str, str], col: str | None = None) -> DataFrame:
    """Columns renamed, or the values of col; what names doesn't hold stays."""
    if col is None:
        return df.withColumnsRenamed(names)
    known = F.create_map(*[F.lit(x) for kv in names.items() for x in kv])
    return df.withColumn(col, F.coalesce(F.element_at(known, F.col(col)), F.col(col)))


def importance_ranking(df: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """All features of each key by falling mean of the absolute value, to nine digits."""
    m = df.groupBy(*key, "feature").agg(F.avg(F.abs(value)).alias("mean_abs"))
    return m.withColumn("place", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(F.round("mean_abs", 9)), "feature")))


def sorted_values(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    """The values of each key in an array, in order."""
    return df.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]).alias("values"))


def mean_by_position(df: DataFrame, first: int | None = None, values: str = "values") -> DataFrame:
    """pos, mean: over all arrays, of which only the first elements count if so asked."""
    v = F.slice(values, 1, first) if first else F.col(values)
    return df.select(F.posexplode(v).alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("mean"))


def drop_null_columns(df: DataFrame) -> DataFrame:
    """df without the columns that hold any null; one pass."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]).first()
    return df.select([c for c in df.columns if not row[c]])


def null_profile(df: DataFrame) -> DataFrame:
    """column, percent of nulls; one pass."""
    one = df.agg(*[(F.avg(F.col(c).isNull().cast("int")) * 100).alias(c) for c in df.columns])
    return one.unpivot([], list(one.columns), "column", "percent").orderBy(F.desc("percent"), "column")


def require_no_null(df: DataFrame, col: str) -> DataFrame:
    """df; a null in col fails the job that reads it."""
    return df.withColumn(col, F.coalesce(F.col(col), F.raise_error(F.lit(f"{col} has a null")).cast(df.schema[col].dataType)))


def clip(c: Column, lo: float, hi: float) -> Column:
    return F.greatest(F.least(c, F.lit(hi)), F.lit(lo))


def pivot_mean(df: DataFrame, index: list[str], columns: str, value: str, values: list) -> DataFrame:
    return df.groupBy(*index).pivot(columns, values).agg(F.avg(value))


def pivot_first(df: DataFrame, index: list[str], columns: str, value: str, values: list, order: str | None = None) -> DataFrame:
    """A pivot of each cell's first value, by order if given."""
    return df.groupBy(*index).pivot(columns, values).agg(F.min_by(value, order) if order else F.first(value))


def mask_where(df: DataFrame, mask: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """value where mask has no row or a null for the key, else null."""
    m = mask.groupBy(*key).agg(F.max(value).alias("_m"))
    return df.join(m, key, "left").withColumn(value, F.when(F.col("_m").isNull(), F.col(value))).drop("_m")


def feature_threshold(df: DataFrame, key: list[str], method: str, value: str = "value") -> DataFrame:
    """Threshold per key: zero, mean+std (sample), quantile (0.75) or fifth (5th largest)."""
    if method == "fifth":
        r = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(value)))
        return df.withColumn("_r", r).where("_r <= 5").groupBy(*key).agg(F.min(value).alias("threshold"))
    if method == "quantile":
        return quantiles(df, key, value, [0.75]).withColumnRenamed(value, "threshold").drop("q")
    agg = {"zero": F.first(F.lit(0.0)), "mean+std": F.avg(value) + F.stddev_samp(value)}[method]
    return df.groupBy(*key).agg(agg.alias("threshold"))


def threshold_mask(df: DataFrame, key: list[str], method: str, value: str = "value") -> DataFrame:
    t = feature_threshold(df, key, method, value)
    return df.join(t, key).withColumn(value, F.when(F.col(value) >= F.col("threshold"), F.col(value))).drop("threshold")


def city_missing_mask(df: DataFrame, least: int = 6, value: str = "value") -> DataFrame:
    """Features to hide in a city: as many of their values are missing."""
    return df.groupBy("feature", "city").agg(F.count_if(F.col(value).isNull()).alias("missing")).where(F.col("missing") >= least)


def tile_area(city: Column, scale: Column) -> Column:
    return F.pow(F.when(city == "Istanbul", 75.0).otherwise(50.0) / scale, 2)


def z_normal(df: DataFrame, key: list[str], value: str) -> DataFrame:
    """(x - mean) / population std per series; series of std 0 go."""
    w = W.partitionBy(*key)
    d = df.withColumns({"_a": F.avg(value).over(w), "_s": F.stddev_pop(value).over(w)}).where("_s > 0")
    return d.withColumn("z", (F.col(value) - F.col("_a")) / F.col("_s")).drop("_a", "_s")


def min_max(df: DataFrame, key: list[str], value: str) -> DataFrame:
    w = W.partitionBy(*key)
    low, high = F.min(value).over(w), F.max(value).over(w)
    return df.withColumn("scaled", F.try_divide(F.col(value) - low, high - low))


def top_features(df: DataFrame, key: list[str], n: int = 3, value: str = "value") -> DataFrame:
    """The n features of the highest |mean| per key."""
    m = df.groupBy(*key, "feature").agg(F.avg(value).alias("mean"))
    r = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(F.abs("mean")), "feature"))
    return m.withColumn("place", r).where(F.col("place") <= n)


def both_ends(df: DataFrame, key: list[str], order: list[str], n: int = 5) -> DataFrame:
    """The n first and n last rows of each key, with their places from either end."""
    up = F.row_number().over(W.partitionBy(*key).orderBy(*order))
    down = F.row_number().over(W.partitionBy(*key).orderBy(*[F.desc(o) for o in order]))
    return df.withColumns({"up": up, "down": down}).where((F.col("up") <= n) | (F.col("down") <= n))


def same_sign(df: DataFrame, key: list[str], scales: int, value: str = "value") -> DataFrame:
    """Keys whose values are positive (or all negative) at that many scales."""
    s = df.groupBy(*key).agg(F.count_if(F.col(value) > 0).alias("pos"), F.count_if(F.col(value) < 0).alias("neg"))
    return s.where((F.col("pos") == scales) | (F.col("neg") == scales)).withColumn("sign", F.when(F.col("pos") == scales, 1).otherwise(-1)).drop("pos", "neg")


def last_wins(df: DataFrame, key: list[str], order: str) -> DataFrame:
    r = F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))
    return df.withColumn("_r", r).where("_r = 1").drop("_r")


def first_last_difference(df: DataFrame, key: list[str], order: str, value: str) -> DataFrame:
    return df.groupBy(*key).agg((F.max_by(value, order) - F.min_by(value, order)).alias("difference"))


def trend_labels(df: DataFrame, by: str = "difference", tie: str = "cluster") -> DataFrame:
    """Clusters in order of their difference: Increasing, Indeterminate, Decreasing."""
    first = [r[0] for r in df.where(F.col(by).isNotNull()).orderBy(by, tie).select(tie).limit(2).collect()]
    named = zip(first, ("Increasing", "Indeterminate"))
    label = F.lit("Decreasing")
    for value, name in named:
        label = F.when(F.col(tie) == F.lit(value), name).otherwise(label)
    return df.withColumn("label", label)


def compare_shifts(a: DataFrame, b: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """The values of two grid shifts side by side."""
    both = a.withColumn("shift", F.lit("a")).unionByName(b.withColumn("shift", F.lit("b")))
    return both.groupBy(*key).pivot("shift", ["a", "b"]).agg(F.avg(value))
