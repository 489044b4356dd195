"""Mixing sources to target weights by Sainte-Laguë apportionment of equal-token blocks.

A source's words form a line, cut into shards of about ``SHARD`` words and blocks of
``BLOCK`` words. The mix takes whole passes over a source while they fit its target; the
rest is allotted in blocks: to sources, then to the regions of each source (groups of
shards), then to the shards of each region, always by the highest quotients
weight / (2 * seats + 1), so quotas are integers and sum to the whole. In each shard the
blocks with the smallest seeded hashes are taken: a document only needs the last such hash
of its shard.

The highest quotients are found without a loop: a divisor a little too large and one a
little too small bound each seat count, and only the few quotients between are ranked.

Hot sources: a source has as many shards as its size asks for and about as many regions as a
region has shards, so no task ranks more than the square root of a source's shards. Rows are
dealt by a hash of all their columns. Rows that repeat (equal in every column) are spread by
their number if together they exceed a shard. One row per source is ranked in one task.

Edge cases: a null text has size 0 and is never taken; a null source is a source of its
own, last in order; null and repeated ids are rows like others; a table without words gives
taken 0; a text longer than a shard is whole in one. Rows that are equal in every column may
swap their taken words between runs; all else is the same in every run. Extra columns of the
input are kept by ``mix`` if their names don't clash with the result's (theirs go), and by
``mixture`` whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import stored

BLOCK, SHARD = 16, 16 * 2048


def word_count(text: Column) -> Column:
    """How many [^\\x20\\x09-\\x0D]+ runs a text has; 0 for null."""
    plain = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    spaces = F.length(plain) - F.length(F.replace(plain, F.lit(" "), F.lit("")))
    return F.coalesce(F.when(plain == "", 0).otherwise(spaces + 1), F.lit(0)).cast("long")


def seats(df: DataFrame, weight: str, total: Column, groups: list[str], order: list[str]) -> DataFrame:
    """df with `seats`: total seats of each group of rows, apportioned by weight after
    Sainte-Laguë; ties go to the first by order. Rows of weight 0 get none."""
    g = W.partitionBy(*[F.col(c) for c in groups]) if groups else W.partitionBy(F.lit(0))
    df = df.withColumn("_all", F.sum(F.col(weight)).over(g)).withColumn("_n", F.sum((F.col(weight) > 0).cast("long")).over(g)).withColumn("_seats", total.cast("long"))
    quota = F.try_divide(F.col(weight) * 1.0, F.col("_all"))
    low = F.floor(F.greatest(quota * F.greatest(F.col("_seats") - F.col("_n") / 2.0, F.lit(0.0)) + 0.5 - 1e-9, F.lit(0.0)))
    high = F.floor(quota * (F.col("_seats") + F.col("_n") / 2.0) + 0.5 + 1e-9)
    df = df.withColumn("_low", F.when(F.col("_seats") > 0, F.coalesce(low, F.lit(0))).otherwise(0)).withColumn("_high", F.when(F.col("_seats") > 0, F.coalesce(high, F.lit(0))).otherwise(0))
    df = df.withColumn("_left", F.col("_seats") - F.sum("_low").over(g))
    more = df.where("_high > _low and _left > 0").withColumn("_j", F.explode(F.sequence(F.col("_low") + 1, F.col("_high")))).withColumn("_q", F.col(weight) / (2 * F.col("_j") - 1))
    keys = list(dict.fromkeys([*groups, *order]))
    rank = F.row_number().over(g.orderBy(F.desc("_q"), *order, "_j"))
    won = more.withColumn("_r", rank).where("_r <= _left").groupBy(*keys).agg(F.count("*").alias("_won"))
    won = won.select(*[F.col(k).alias(f"_w_{k}") for k in keys], "_won")
    kept = [c for c in df.columns if not c.startswith("_")]
    joined = df.join(won, [F.col(k).eqNullSafe(F.col(f"_w_{k}")) for k in keys], "left")
    return joined.select(*kept, (F.col("_low") + F.coalesce("_won", F.lit(0))).cast("long").alias("seats"))


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0) -> DataFrame:
    """sizes(source, source_size) with target and the source's place: share of all words,
    by weight, no more than limit times a source's size; the excess is shared again."""
    one = W.partitionBy(F.lit(0))
    ranked = sizes.withColumn("place", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod("place", F.lit(len(weights))) + 1).cast("int"))
    ranked = ranked.withColumn("w", w).withColumn("cap", limit * F.col("source_size"))
    # In order of cap / w the capped sources come first. The first source that stays below
    # its cap fixes the common level for all after it.
    by = one.orderBy(F.col("cap") / F.col("w"), "place")
    whole = F.sum("source_size").over(one) * F.lit(float(share))
    before = F.coalesce(F.sum("cap").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    behind = F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing))
    level = (whole - before) / behind
    ranked = ranked.withColumn("level", level).withColumn("nth", F.row_number().over(by)).withColumn("free", F.col("level") * F.col("w") <= F.col("cap"))
    fixed = F.min(F.when(F.col("free"), F.struct("nth", "level"))).over(one)["level"]
    return ranked.withColumn("target", F.least("cap", F.coalesce(fixed * F.col("w"), F.col("cap")))).select("source", "source_size", "place", "target")


def _sized(docs: DataFrame, source: str, text: str, kept: list[Column]) -> DataFrame:
    """kept, row (a number), mark (a hash of all columns), source and size of each row, written
    once: no later step reads a text again to count its words."""
    hashed = [F.col(f"`{f.name}`") for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    return stored(docs.select(*kept, F.monotonically_increasing_id().alias("_row"), F.xxhash64(*hashed).alias("_mark"), F.col(source).alias("_source"), word_count(F.col(text)).alias("_size")))


def taken_words(sized: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: int = 7) -> DataFrame:
    """row, mark, size, source_size, target, taken, place and shard of each row of sized(row, mark,
    source, size)."""
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, limit)
    targets = targets.withColumn("passes", F.coalesce(F.floor(F.try_divide(F.col("target") + 1e-6, F.col("source_size"))), F.lit(0))).withColumn("rest", F.greatest(F.col("target") - F.col("passes") * F.col("source_size"), F.lit(0.0)))
    targets = stored(targets).withColumn("blocks", F.round(F.sum("rest").over(W.partitionBy(F.lit(0))) / BLOCK))
    targets = seats(targets, "rest", F.col("blocks"), [], ["place"]).withColumnRenamed("seats", "source_blocks")
    shards = F.ceil(F.greatest(F.col("source_size"), F.lit(1)) / SHARD)
    t = stored(targets.select(F.col("source").alias("t_source"), "source_size", "target", "passes", "source_blocks", "place", shards.alias("shards"), F.ceil(F.sqrt(shards)).alias("regions")))
    many = sized.groupBy("mark").agg(F.count("*").alias("n"), F.sum("size").alias("words")).where((F.col("n") > 1) & (F.col("words") > SHARD))
    spread = many.select("mark", F.ceil(F.col("words") / SHARD).alias("spread"))
    placed = sized.join(t, F.col("source").eqNullSafe(F.col("t_source")))
    full = placed.where("size > 0").join(spread, "mark", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row"), "spread"), F.lit(0)))
    full = full.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "mark", "salt"), F.col("shards"))).withColumn("region", F.pmod("shard", "regions"))
    full = stored(full.select("row", "mark", "place", "region", "shard", "size", "source_size", "target", "passes"))
    cells = stored(full.groupBy("place", "region", "shard").agg(F.sum("size").alias("cell_size")))
    regions = cells.groupBy("place", "region").agg(F.sum("cell_size").alias("region_size")).join(t.select("place", "source_blocks"), "place")
    regions = stored(seats(regions, "region_size", F.col("source_blocks"), ["place"], ["place", "region"]).select("place", "region", F.col("seats").alias("region_blocks")))
    cells = seats(cells.join(regions, ["place", "region"]), "cell_size", F.col("region_blocks"), ["place", "region"], ["place", "region", "shard"])
    count = F.ceil(F.col("cell_size") / BLOCK)
    ranked = lambda b: F.struct(F.xxhash64(F.lit(seed + 2), "place", "shard", b).alias("h"), b.alias("b"))
    drawn = F.array_sort(F.transform(F.sequence(F.lit(0).cast("long"), count - 1), ranked))
    bars = stored(cells.where("seats > 0").select("place", "shard", F.element_at(drawn, F.least("seats", count).cast("int")).alias("bar")))
    line = W.partitionBy("place", "shard").orderBy(F.xxhash64(F.lit(seed + 1), "mark"), "mark", "row").rowsBetween(W.unboundedPreceding, 0)
    lined = full.withColumn("end", F.sum("size").over(line)).withColumn("start", F.col("end") - F.col("size")).join(bars, ["place", "shard"], "left")
    nearest = F.sequence(F.floor(F.col("start") / BLOCK), F.floor((F.col("end") - 1) / BLOCK))
    inside = lambda b: F.least(F.col("end"), (b + 1) * BLOCK) - F.greatest(F.col("start"), b * BLOCK)
    part = F.aggregate(nearest, F.lit(0).cast("long"), lambda acc, b: acc + F.when(ranked(b) <= F.col("bar"), inside(b)).otherwise(F.lit(0).cast("long")))
    out = lined.withColumn("taken", (F.col("passes") * F.col("size") + F.when(F.col("bar").isNull(), 0).otherwise(part)).cast("long"))
    names = ["row", "mark", "size", "source_size", "target", "taken", "place", "shard"]
    bare = placed.where("size = 0").select("row", "mark", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"), "place", F.lit(-1).cast("long").alias("shard"))
    return out.select(names).unionByName(bare)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: int = 7, source: str = "source", text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs with size, source_size, target and taken (words the mix takes, repeats counted).
    keep: the columns to keep beside these; all by default."""
    mine = ["size", "source_size", "target", "taken"]
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() not in mine]
    sized = _sized(docs, source, text, [F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_kept")])
    taken = taken_words(sized.select(F.col("_row").alias("row"), F.col("_mark").alias("mark"), F.col("_source").alias("source"), F.col("_size").alias("size")), weights, share, limit, seed)
    return sized.select("_row", "_kept").join(taken, F.col("_row") == F.col("row")).select("_kept.*", *mine)


def mixture(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, limit: float = 2.0, seed: int = 7, source: str = "source", text: str = "text") -> DataFrame:
    """The rows of docs, whole, as often as the mix takes them. Of a row's taken words the whole
    passes give a copy each. What is left over is carried along the rows of its shard, from the
    shortest to the longest text, and gives a copy whenever it has grown by one: so a source's
    words meet its target within about one text a shard."""
    kept = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_kept")]
    sized = _sized(docs, source, text, kept)
    taken = taken_words(sized.select(F.col("_row").alias("row"), F.col("_mark").alias("mark"), F.col("_source").alias("source"), F.col("_size").alias("size")), weights, share, limit, seed).where("taken > 0")
    by = W.partitionBy("place", "shard").orderBy("size", "mark", "row")
    share_ = F.col("taken") / F.col("size")
    begin = (F.shiftrightunsigned(F.xxhash64(F.lit(seed + 3), "place", "shard"), 11)) / float(1 << 53)
    upto = taken.withColumn("upto", begin + F.sum(share_ - F.floor(share_)).over(by.rowsBetween(W.unboundedPreceding, 0)))
    copies = F.floor(share_) + F.floor("upto") - F.floor(F.coalesce(F.lag("upto").over(by), begin))
    drawn = upto.select("row", copies.cast("int").alias("copies")).where("copies > 0")
    return sized.select("_row", "_kept").join(drawn, F.col("_row") == F.col("row")).withColumn("copy", F.explode(F.array_repeat(F.lit(1), F.col("copies")))).select("_kept.*")
