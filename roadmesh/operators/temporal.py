"""Series of jam factors: (nid, ts, jf) rows, positional bins, days and daily profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

HOURS = 24


def jf_to_long(df: DataFrame, id_col: str = "nid") -> DataFrame:
    """One column per timestamp becomes rows (id, ts, jf); NaN becomes null."""
    times = [c for c in df.columns if c != id_col]
    long = df.unpivot(id_col, times, "ts", "jf")
    return long.select(id_col, F.to_timestamp("ts").alias("ts"), F.nanvl("jf", F.lit(None).cast("double")).alias("jf"))


def filter_local_range(df: DataFrame, start: str, end: str, tz: str, ts: str = "ts") -> DataFrame:
    """Rows of start <= ts <= end, both given as the city's wall-clock time."""
    at = lambda s: F.to_utc_timestamp(F.lit(s).cast("timestamp"), tz)
    return df.where(F.col(ts).between(at(start), at(end)))


def resample_mean(df: DataFrame, key: list[str], k: int, value: str = "jf", ts: str | list[str] = "ts", clock: str | None = None) -> DataFrame:
    """Mean of each run of k samples (nulls skipped, a last short run kept), or of each
    clock interval such as '1 hour' if clock is given."""
    if clock:
        return df.groupBy(*key, F.window(ts if isinstance(ts, str) else ts[0], clock)["start"].alias("bin")).agg(F.avg(value).alias(value))
    n = F.row_number().over(W.partitionBy(*key).orderBy(*([ts] if isinstance(ts, str) else ts)))
    return df.withColumn("bin", F.floor((n - 1) / k)).groupBy(*key, "bin").agg(F.avg(value).alias(value))


def to_days(df: DataFrame, key: list[str], first: int = 30) -> DataFrame:
    """Bins as (day, hour): whole days of 24 bins only, at most the first so many."""
    days = df.withColumn("day", F.floor(F.col("bin") / HOURS)).withColumn("hour", F.col("bin") % HOURS)
    full = F.count("*").over(W.partitionBy(*key, "day"))
    return days.withColumn("_n", full).where((F.col("_n") == HOURS) & (F.col("day") < first)).drop("_n", "bin")


def recurrent(df: DataFrame, key: list[str], value: str = "jf") -> DataFrame:
    return df.groupBy(*key, "hour").agg(F.avg(value).alias(value))


def non_recurrent(df: DataFrame, key: list[str], value: str = "jf") -> DataFrame:
    """Over the days of each hour: maximum less median."""
    return df.groupBy(*key, "hour").agg((F.max(value) - F.median(value)).alias(value))


def non_recurrent_mmm(df: DataFrame, key: list[str], value: str = "jf") -> DataFrame:
    """Over the days of each hour: mean of what lies above the median."""
    middle = F.median(value).over(W.partitionBy(*key, "hour"))
    return df.withColumn("_m", middle).groupBy(*key, "hour").agg(F.avg(F.greatest(F.col(value) - F.col("_m"), F.lit(0.0))).alias(value))


#: Congestion types by name.
CONGESTION = {"RECURRENT": recurrent, "NON-RECURRENT": non_recurrent, "NON-RECURRENT-MMM": non_recurrent_mmm}


def day_curves(df: DataFrame, key: list[str], value: str = "jf") -> DataFrame:
    return df.groupBy(*key, "hour").agg(F.avg(value).alias("mean"), F.median(value).alias("median"), F.max(value).alias("max"))


def city_day(df: DataFrame, city: str = "city", value: str = "jf") -> DataFrame:
    return df.groupBy(city, "hour").agg(F.avg(value).alias(value))


def segment_mean(df: DataFrame, key: list[str], value: str = "jf") -> DataFrame:
    return df.groupBy(*key).agg(F.avg(value).alias(value))


def spread(c: Column | str) -> Column:
    """What configurations call variance: the population standard deviation."""
    return F.stddev_pop(c)


AGGREGATES = {"mean": F.avg, "max": F.max, "variance": spread}


def tod_agg(df: DataFrame, key: list[str], hours: list[int], method: str = "mean", value: str = "jf") -> DataFrame:
    """Aggregate over hours[0] <= hour < hours[-1], so the list 1..24 leaves hour 0 out."""
    return df.where((F.col("hour") >= hours[0]) & (F.col("hour") < hours[-1])).groupBy(*key).agg(AGGREGATES[method](value).alias(value))


def tod_pick(df: DataFrame, hour: int) -> DataFrame:
    return df.where(F.col("hour") == hour)


def equal_length(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: how many series there are, and whether all have as many samples."""
    return df.groupBy(*key).count().agg(F.count("*").alias("series"), (F.count_distinct("count") <= 1).alias("equal"))


def every_nth(df: DataFrame, key: list[str], order: str, n: int) -> DataFrame:
    """Every n-th sample of each series, from the first on."""
    at = F.row_number().over(W.partitionBy(*key).orderBy(order)) - 1
    return df.withColumn("_at", at).where(F.col("_at") % n == 0).drop("_at")
