"""Functions on log lines and names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def part(c: Column, n: int, sep: str = "-") -> Column:
    """The n-th part, from 1."""
    return F.split_part(c, F.lit(sep), F.lit(n))


def zero_fill(c: Column, width: int = 3) -> Column:
    """Zeros before shorter texts; longer ones stay whole."""
    s = c.cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def slug(c: Column) -> Column:
    """Lower case, runs of other characters than a-z and 0-9 as one hyphen, none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-|-$", "")


def title(c: Column) -> Column:
    """Lower case with a capital at the start of each word."""
    return F.initcap(F.lower(c))


def squeeze(c: Column) -> Column:
    """Commas to blanks, runs of blanks to one."""
    return F.regexp_replace(F.replace(c, F.lit(","), F.lit(" ")), " +", " ")


def after_colon(c: Column, name: str) -> Column:
    return F.regexp_extract(c, name + r"\s*:\s*([^\s,}]+)", 1)


def lines(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per line: key, line_no from 0, line."""
    return docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line"))


def context(df: DataFrame, match: Column, key: str = "doc_id", before: int = 4, after: int = 2) -> DataFrame:
    """Matching lines with the line so far before them, and the next ones."""
    w = W.partitionBy(key).orderBy("line_no")
    d = df.withColumns({"before": F.lag("line", before).over(w), **{f"after{i}": F.lead("line", i).over(w) for i in range(1, after + 1)}})
    return d.where(match)


def from_first_match(df: DataFrame, match: Column, key: str = "doc_id") -> DataFrame:
    """All lines from the first match on."""
    first = F.min(F.when(match, F.col("line_no"))).over(W.partitionBy(key))
    return df.withColumn("_f", first).where(F.col("line_no") >= F.col("_f")).drop("_f")


def records(df: DataFrame, size: int = 4, key: str = "doc_id") -> DataFrame:
    """Every so many lines as one row f0, f1, ..."""
    g = F.floor(F.col("line_no") / size).alias("record")
    return df.groupBy(key, g).agg(*[F.max(F.when(F.col("line_no") % size == i, F.col("line"))).alias(f"f{i}") for i in range(size)])


def merge_records(a: DataFrame, b: DataFrame, key: list[str], value: str) -> DataFrame:
    """Full outer join with '-' for what is missing."""
    j = a.select(*key, F.col(value).cast("string").alias("a")).join(b.select(*key, F.col(value).cast("string").alias("b")), key, "full")
    return j.fillna("-", ["a", "b"])


def explode_wkt(df: DataFrame, wkt: str = "wkt") -> DataFrame:
    """Pieces (part, piece, x1, y1, x2, y2) of MULTILINESTRING and LINESTRING texts; Z is
    ignored."""
    parts = F.regexp_extract_all(F.col(wkt), F.lit(r"\(([^()]+)\)"), F.lit(1))
    d = df.select("*", F.posexplode(parts).alias("part", "_p"))
    d = d.withColumn("_pts", F.transform(F.split(F.trim("_p"), r"\s*,\s*"), lambda t: F.transform(F.split(t, r"\s+"), lambda v: v.cast("double"))))
    n = F.size("_pts")
    d = d.where(n > 1).withColumn("piece", F.explode(F.sequence(F.lit(0), n - 2)))
    at = lambda k, i: F.element_at(F.element_at("_pts", F.col("piece") + k), i)
    return d.withColumns({"x1": at(1, 1), "y1": at(1, 2), "x2": at(2, 1), "y2": at(2, 2)}).drop("_p", "_pts")
