"""URL rules by a sort-merge range join with a sweep.

Canonical key: the host's labels in reverse order, a \\x01, then the path. A rule's key is a
prefix of the key of every url it fits (for one of the url's host suffixes), so it covers
an interval of sorted keys, and two rules' intervals are nested or apart. Keys and rules are
dealt to ranges of keys, sorted, and swept once with a stack of the rules now open.

Hot keys: a key that fills several ranges is spread over them by a hash of the row; a rule
goes to every range its interval meets. Work is linear in urls times the few host depths
that rules have. Nothing is broadcast but at most ``ranges`` splitters.

Edge cases: a null url or one without ``://`` has the empty host and path and fits no rule.
Repeated rows each get their result. Empty tables give empty results. Of rules with the
same key the last verdict by code point holds. Very long urls are keys like others. Extra
columns of the input are not kept, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, UPPER

PARTS = r"^(?s)(?:.*?)://([^/?#]*)([^?#]*)"
_END = "\x01"


def host_of(url: Column) -> Column:
    """Text between the first :// and / ? # or end, A-Z lower-cased; empty if there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """Text after the host up to ? or # or end; empty if there is no host part."""
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def canonical_key(host: Column, path: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(_END), path)


def _sweep(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows sorted by range and key, rules before urls of the same key; the stack goes on
    from batch to batch."""
    at, stack = None, []
    for part in parts:
        rules = []
        for bucket, key, is_rule, rule in zip(part["bucket"], part["key"], part["kind"] == 0, part["rule"]):
            if bucket != at:
                at, stack = bucket, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if is_rule:
                stack.append((key, rule))
                rules.append(None)
            else:
                rules.append(stack[-1][1] if stack else None)
        part["rule"] = rules
        yield part.loc[part["kind"] == 1, ["page_id", "host", "path", "first", "rule"]]


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", key: str = "page_id", url: str = "url", ranges: int = 0, seed: int = 7) -> DataFrame:
    """page_id, host, path, rule, verdict of every row of pages.

    rules: rule_host, rule_path, verdict. A rule fits its host and all subdomains if the
    path starts with the rule's; the longest host plus path wins (then the longer host).
    ranges: how many key ranges to sweep; 0 for the session's shuffle partitions."""
    spark = pages.sparkSession
    n = ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rules = rules.where("rule_host is not null and rule_path is not null").groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    depths = sorted(r[0] for r in rules.select(F.size(F.split("rule_host", r"\.", -1)).alias("d")).distinct().collect())
    urls = pages.select(F.col(key).alias("page_id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    labels = F.split("host", r"\.", -1)
    suffixes = [F.when(F.size(labels) > d, F.array_join(F.slice(labels, F.greatest(F.size(labels) - d + 1, F.lit(1)), d), ".")) for d in depths]
    entries = urls.withColumn("suffix", F.explode(F.array_compact(F.array(F.col("host"), *suffixes))))
    entries = entries.withColumn("first", (F.col("suffix") == F.col("host")).cast("int")).withColumn("key", canonical_key(F.col("suffix"), F.col("path"))).drop("suffix")
    # Splitters: quantiles of a sample of about 40 keys a range, at most 40 * n + n rows.
    total = urls.count()
    share = min(1.0, 40.0 * n / max(total, 1))
    sample = sorted(r[0] for r in entries.select("key").sample(share, seed).limit(80 * n).collect())
    cuts = [sample[i * len(sample) // n] for i in range(1, n)] if sample else []
    splitters = F.array(*[F.lit(c) for c in cuts]) if cuts else F.expr("cast(array() as array<string>)")

    def below(c: Column) -> Column:
        return F.size(F.filter(splitters, lambda s: s < c))

    def upto(c: Column) -> Column:
        return F.size(F.filter(splitters, lambda s: s <= c))

    low, high = below(F.col("key")), upto(F.col("key"))
    dealt = entries.withColumn("bucket", low + F.pmod(F.xxhash64("page_id", "host", "path"), high - low + 1).cast("int"))
    named = rules.select(canonical_key(F.col("rule_host"), F.col("rule_path")).alias("key"), F.struct((F.length("rule_host") + F.length("rule_path")).alias("n"), F.length("rule_host").alias("m"), F.concat("rule_host", "rule_path").alias("name"), "verdict").alias("rule"))
    # a rule's keys end before the ranges whose splitter is behind the rule's key and does not begin with it
    inside = F.size(F.filter(splitters, lambda s: (s <= F.col("key")) | s.startswith(F.col("key"))))
    spread = named.withColumn("bucket", F.explode(F.sequence(below(F.col("key")), inside)))
    nothing = F.lit(None)
    both = dealt.select("bucket", "key", F.lit(1).alias("kind"), "page_id", "host", "path", "first", nothing.cast("string").alias("rule")).unionByName(
        spread.select("bucket", "key", F.lit(0).alias("kind"), nothing.cast("long").alias("page_id"), nothing.cast("string").alias("host"), nothing.cast("string").alias("path"), nothing.cast("int").alias("first"), F.to_json("rule").alias("rule"))
    )
    swept = both.repartition(n, "bucket").sortWithinPartitions("bucket", "key", "kind").mapInPandas(_sweep, "page_id long, host string, path string, first int, rule string")
    best = F.max(F.from_json("rule", "n int, m int, name string, verdict string")).alias("best")
    found = swept.groupBy("page_id", "host", "path").agg(best, F.sum("first").alias("copies"))
    return found.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("page_id", "host", "path", F.col("best.name").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
