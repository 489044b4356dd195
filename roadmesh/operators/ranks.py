"""Places, running sums, quantiles and rank statistics of many groups in one distributed sort.

Rows are dealt to ranges of (group, order), so a large group spreads over ranges and many small
ones share one. Within a range places and sums run on in a single pass; what a range begins with
comes from a table of one row per range, what a group begins with from one row per group."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .order import cut

#: Blocks of a series in kendall(): pairs of blocks meet as counts, at most BLOCKS * 2 * BLOCKS of a pair.
BLOCKS, BLOCK_ROWS = 512, 32_768


def running(df: DataFrame, group: list[str], order: list[str], sums: list[str] = [], following: str | None = None) -> DataFrame:
    """df with place (from 0 in its group, by order) and, for each c of sums (whole numbers of
    0 or more), run_c, the sum up to and with the row. following: a column c whose value in the
    group's next row becomes next_c. Ties of order stand in any order."""
    plain = df.columns
    sorted_ = df.repartitionByRange(*group, *order).sortWithinPartitions(*group, *order).withColumn("_part", F.spark_partition_id())
    rows = cut(sorted_)
    added = ["_at", *(f"_run_{c}" for c in sums)]
    fields = [*rows.schema.fields]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), *(f"`{a}` long" for a in added)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, before = 0, [0] * len(sums)
        for b in batches:
            if not b.num_rows:
                continue
            cols = [pa.array(np.arange(at, at + b.num_rows))]
            for k, c in enumerate(sums):
                total = pc.cumulative_sum(pc.fill_null(b.column(b.schema.get_field_index(c)).cast(pa.int64()), 0), start=before[k])
                before[k] = total[-1].as_py()
                cols.append(total)
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], [*b.schema.names, *added])

    counted = cut(rows.mapInArrow(run, schema))
    ranges = counted.groupBy("_part").agg((F.max("_at") + 1).alias("_n"), *(F.max(f"_run_{c}").alias(f"_max_{c}") for c in sums))
    over = W.partitionBy(F.lit(0)).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = ranges.select("_part", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_start"), *(F.coalesce(F.sum(f"_max_{c}").over(over), F.lit(0)).alias(f"_start_{c}") for c in sums))
    out = counted.join(F.broadcast(starts), "_part")  # one row per range
    out = out.withColumns({"_at": F.col("_at") + F.col("_start"), **{f"_run_{c}": F.col(f"_run_{c}") + F.col(f"_start_{c}") for c in sums}})
    names = [f"_k{k}" for k in range(len(group))]
    first = out.groupBy(*(F.col(g).alias(n) for g, n in zip(group, names))).agg(F.min("_at").alias("_first"), *(F.min(F.col(f"_run_{c}") - F.coalesce(F.col(c).cast("long"), F.lit(0))).alias(f"_first_{c}") for c in sums))
    same = [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, names)]
    result = out.join(first, same)
    more = []
    if following:
        # a range knows its rows' followers; that of its last row heads the next range
        follower = F.lead(F.struct(*(F.col(g).alias(n) for g, n in zip(group, names)), F.col(following).alias("v"))).over(W.partitionBy("_part").orderBy("_at"))
        heads = counted.where("_at = 0").select("_part", F.struct(*(F.col(g).alias(n) for g, n in zip(group, names)), F.col(following).alias("v")).alias("_head"))
        heads = heads.select("_part", F.lead("_head").over(W.partitionBy(F.lit(0)).orderBy("_part")).alias("_head"))
        result = result.join(F.broadcast(heads), "_part").withColumn("_next", F.coalesce(follower, "_head"))
        fits = F.lit(True)
        for g, n in zip(group, names):
            fits = fits & F.col(g).eqNullSafe(F.col(f"_next.{n}"))
        more = [F.when(F.col("_next").isNotNull() & fits, F.col("_next.v")).alias(f"next_{following}")]
    return result.select(*plain, (F.col("_at") - F.col("_first")).alias("place"), *((F.col(f"_run_{c}") - F.col(f"_first_{c}")).alias(f"run_{c}") for c in sums), *more)


def tied_places(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, value, n (rows with it), low: the place of the first of them in its group. Equal
    values are counted before the sort, so a common value is one row of it."""
    counts = df.groupBy(*group, value).agg(F.count("*").alias("n"))
    return running(counts, group, [value], ["n"]).select(*group, value, "n", (F.col("run_n") - F.col("n")).alias("low"))


def average_ranks(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """group, value, n, rank: the mean of the places (from 1) of a value's rows."""
    return tied_places(df, group, value).select(*group, value, "n", (F.col("low") + (F.col("n") + 1) / 2).alias("rank"))


def quantiles(df: DataFrame, group: list[str], value: str, at: list[float]) -> DataFrame:
    """group, q, value: exact quantiles, linear between neighbours, nulls left out. Only the
    values at the places asked for leave the sort: no group's values are held in one place."""
    d = df.where(F.col(value).isNotNull())
    places = tied_places(d, group, value)
    sizes = d.groupBy(*group).agg(F.count("*").alias("_n"))
    asked = sizes.withColumn("q", F.explode(F.array(*[F.lit(float(q)) for q in at]))).withColumn("_pos", (F.col("_n") - 1) * F.col("q"))
    names = [f"_k{k}" for k in range(len(group))]
    asked = asked.select(*(F.col(g).alias(n) for g, n in zip(group, names)), "q", "_pos", F.floor("_pos").alias("_a"), F.ceil("_pos").alias("_b"))
    here = lambda p: (F.col("low") <= F.col(p)) & (F.col(p) < F.col("low") + F.col("n"))
    j = places.join(asked, [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, names)]).where(here("_a") | here("_b"))
    got = j.groupBy(*group, "q").agg(F.max(F.when(here("_a"), F.col(value))).alias("_va"), F.max(F.when(here("_b"), F.col(value))).alias("_vb"), F.first(F.col("_pos") - F.col("_a")).alias("_t"))
    return got.select(*group, "q", (F.col("_va") + (F.col("_vb") - F.col("_va")) * F.col("_t")).alias(value))


def long_pairs(df: DataFrame, cols: list[str]) -> DataFrame:
    """a, b, x, y: each row once per pair of columns a < b (in the order given), rows with a null in either left out."""
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in combinations(cols, 2)]))
    return df.select(pairs.alias("p")).select("p.*").where("x is not null and y is not null")


def ranked_columns(df: DataFrame, cols: list[str]) -> DataFrame:
    """cols only, each value replaced by its average rank in its column (null: null). All columns
    are ranked in one sort and meet again by row."""
    numbered = cut(df.select(F.monotonically_increasing_id().alias("_id"), *(F.col(c).cast("double").alias(c) for c in cols)))
    long = numbered.unpivot(["_id"], cols, "col", "v").where("v is not null")
    ranked = long.join(average_ranks(long, ["col"], "v").select("col", "v", "rank"), ["col", "v"])
    return ranked.groupBy("_id").agg(*(F.max(F.when(F.col("col") == c, F.col("rank"))).alias(c) for c in cols)).drop("_id")


def inversions(values: np.ndarray, part: np.ndarray | None = None) -> int:
    """How many pairs i < j (of the same part) have values[i] > values[j]. The values' bits part the
    sequence from the highest down: a 1 before a 0 under the same higher bits is an inversion."""
    if len(values) < 2:
        return 0
    rank = np.unique(values, return_inverse=True)[1].astype(np.int64)
    bits, total = int(rank.max()).bit_length(), 0
    key = rank if part is None else np.unique(part, return_inverse=True)[1].astype(np.int64) << bits | rank
    key = key[np.argsort(key >> bits, kind="stable")]
    for bit in range(bits - 1, -1, -1):
        one = key >> bit & 1
        count = np.cumsum(one)
        first = np.flatnonzero(np.r_[True, np.diff(key >> bit + 1) != 0])
        base = np.repeat(count[first] - one[first], np.diff(np.r_[first, len(key)]))
        total += int((count - base)[one == 0].sum())
        key = key[np.argsort(key >> bit, kind="stable")]
    return total


def _count_inversions(part: pa.Table) -> pa.Table:
    """Of a block: all inversions of y in the order of x. Of a bucket of y: those between blocks."""
    a, b, kind = (part.column(c)[0].as_py() for c in ("a", "b", "kind"))
    at, y, block = (part.column(c).to_numpy() for c in ("at", "yr", "block"))
    order = np.argsort(at, kind="stable")
    found = inversions(y[order])
    if kind == 1:
        found -= inversions(y[order], block[order])
    return pa.table({"a": [a], "b": [b], "d": pa.array([found], pa.int64())})


def kendall(df: DataFrame, cols: list[str], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """a, b, tau: Kendall's tau-b of each pair of columns, without pairs of rows.

    In the order of (x, y) the discordant pairs are the inversions of y. Rows are cut into blocks
    of that order and into buckets of y (a value with more rows than a block has one of its own, in
    which nothing can be inverted). Inversions within a block and within a bucket are counted in
    one task each, at most about a block's rows; those of different blocks and buckets come from
    counts per (block, bucket). Ties come from counts per value."""
    pairs = ["a", "b"]
    rows = cut(long_pairs(df, cols))
    n = rows.groupBy(*pairs).agg(F.count("*").alias("n"))
    size = F.greatest(F.lit(block_rows), F.ceil(F.col("n") / BLOCKS))
    n = n.withColumn("size", size)
    ys = tied_places(rows, pairs, "y").withColumnRenamed("n", "ny").join(n, pairs)
    bucket = 2 * F.floor(F.col("low") / F.col("size")) + F.when(F.col("ny") > F.col("size"), 1).otherwise(0)
    ys = cut(ys.select(*pairs, "y", "ny", F.col("low").alias("yr"), bucket.alias("bucket")))
    placed = running(rows, pairs, ["x", "y"]).join(n, pairs).withColumn("block", F.floor(F.col("place") / F.col("size")))
    dealt = cut(placed.join(ys.select(*pairs, "y", "yr", "bucket"), [*pairs, "y"]).select(*pairs, F.col("place").alias("at"), "yr", "block", "bucket"))

    in_block = dealt.select(*pairs, F.lit(0).alias("kind"), F.col("block").alias("part"), "at", "yr", "block")
    in_bucket = dealt.where("bucket % 2 = 0").select(*pairs, F.lit(1).alias("kind"), F.col("bucket").alias("part"), "at", "yr", "block")
    near = in_block.unionByName(in_bucket).groupBy(*pairs, "kind", "part").applyInArrow(_count_inversions, "a string, b string, d long")

    cells = dealt.groupBy(*pairs, "block", "bucket").agg(F.count("*").alias("c"))
    grid = cells.select(*pairs, "block").distinct().join(cells.select(*pairs, "bucket").distinct(), pairs).join(cells, [*pairs, "block", "bucket"], "left").fillna(0, ["c"])
    earlier = W.partitionBy(*pairs, "bucket").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # at most BLOCKS rows
    grid = grid.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    above = W.partitionBy(*pairs, "block").orderBy("bucket").rowsBetween(1, W.unboundedFollowing)  # at most 2 * BLOCKS rows
    far = grid.withColumn("d", F.col("c") * F.coalesce(F.sum("before").over(above), F.lit(0))).groupBy(*pairs).agg(F.sum("d").alias("d"))

    d = near.unionByName(far).groupBy(*pairs).agg(F.sum("d").cast("double").alias("d"))
    couples = lambda c: F.col(c).cast("double") * (F.col(c) - 1) / 2
    tied = lambda keys, name: rows.groupBy(*pairs, *keys).agg(F.count("*").alias("t")).groupBy(*pairs).agg(F.sum(couples("t")).alias(name))
    out = n.join(d, pairs).join(tied(["x"], "tx"), pairs).join(ys.groupBy(*pairs).agg(F.sum(couples("ny")).alias("ty")), pairs).join(tied(["x", "y"], "txy"), pairs)
    all_ = couples("n")
    top = all_ - F.col("tx") - F.col("ty") + F.col("txy") - 2 * F.col("d")
    return out.select(*pairs, F.try_divide(top, F.sqrt((all_ - F.col("tx")) * (all_ - F.col("ty")))).alias("tau"))


def wasserstein(df: DataFrame, key: str, value: str) -> DataFrame:
    """a < b, distance: Wasserstein-1 of every two keys' empirical distributions. Rows meet as
    counts per distinct value; the running counts of all pairs of keys come from one sort."""
    d = df.where(F.col(key).isNotNull() & F.col(value).isNotNull())
    counts = cut(d.groupBy(F.col(key).alias("k"), F.col(value).alias("v")).agg(F.count("*").alias("n")))
    sizes = counts.groupBy("k").agg(F.sum("n").alias("size"))
    of = lambda side, other: sizes.select(F.col("k").alias(side), F.col("size").alias(f"s{side}"))
    pairs = of("a", "b").join(of("b", "a"), F.col("a") < F.col("b"))
    zero = F.lit(0).cast("long")
    flow = pairs.join(counts, F.col("a") == F.col("k")).select("a", "b", "sa", "sb", "v", F.col("n").alias("na"), zero.alias("nb"))
    flow = flow.unionByName(pairs.join(counts, F.col("b") == F.col("k")).select("a", "b", "sa", "sb", "v", zero.alias("na"), F.col("n").alias("nb")))
    flow = flow.groupBy("a", "b", "sa", "sb", "v").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    r = running(flow, ["a", "b"], ["v"], ["na", "nb"], following="v")
    step = F.abs(F.col("run_na") / F.col("sa") - F.col("run_nb") / F.col("sb")) * (F.col("next_v") - F.col("v"))
    return r.groupBy("a", "b").agg(F.coalesce(F.sum(step), F.lit(0.0)).alias("distance"))
