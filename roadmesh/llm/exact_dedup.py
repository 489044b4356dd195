"""Exact duplicates by distributed MSD radix partitioning.

Texts are split by successive bytes: a round takes the next bytes of every document whose
group still has several members, and groups by (group, those bytes, whether the text ends
there). Groups of one are done, and so are groups whose members ended: they are equal, byte
for byte; no digest decides. A round takes four times the bytes of the round before, so a
corpus needs about log4(longest text) rounds, and a document's bytes move only as long as
it shares them with another one.

The first rounds look at the HEAD bytes that are kept beside each row's facts, so no second
copy of the corpus is written. Only texts that share all of these with another text are read
again, whole. They are picked by a hash of the head, which may pick some too many (their
rounds tell them apart) but never too few.

Hot groups: each round counts with partial sums and names a group by its least row; the
counts are written before they are joined back, so Spark can split a hot group's rows. Both
sides of the joins on rows and groups grow with the corpus, so merge joins are asked for at
every size.

Edge cases: a null text counts as empty, and all empty texts are equal. Repeated rows,
also with the same id, are members of one group each. An empty table gives no rows. Very
long texts take more rounds, of at most MOST bytes each. Extra columns are kept by
``dedup``, whatever their names, and ignored by ``duplicate_groups``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_name, stored

FIRST, GROW, MOST, HEAD = 64, 4, 1 << 24, 64 + 256


def normalized(text: Column) -> Column:
    """text without the characters of [\\x20\\x09-\\x0D]; null is empty."""
    return F.coalesce(F.translate(text, SPACES, ""), F.lit(""))


def _rounds(work: DataFrame, step: int, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(row, grp) of the rows of work(row, body, bytes) that have equals, grp being the least
    row of the group; and of those that still share all of the first limit bytes. bytes: how
    long the text is, which is more than its body if that is only the text's head."""
    active, found, offset = None, [], 0
    while True:
        end = offset + step
        part = work.select("row", F.substring("body", offset + 1, step).alias("chunk"), (F.col("bytes") <= end).alias("ended"))
        if active is None:
            part = part.withColumn("grp", F.lit(0).cast("long"))
        else:
            part = stored(part.join(active.hint("merge"), "row"))
        groups = stored(part.groupBy("grp", "chunk", "ended").agg(F.min("row").alias("next"), F.count("*").alias("n")).where("n > 1").drop("n"))
        split = stored(part.join(groups.hint("merge"), ["grp", "chunk", "ended"]).select("row", F.col("next").alias("grp"), "ended"))
        found.append(split.where("ended").select("row", "grp"))
        active = split.where("not ended").select("row", "grp")
        if end == limit or active.isEmpty():
            break
        offset, step = end, min(step * GROW, MOST)
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out, active


def _told(facts: DataFrame, groups: DataFrame) -> DataFrame:
    """facts with keep_id, keep_row and group_size, from the groups of those that have equals."""
    members = stored(groups.join(facts.select("row", "id", "points").hint("merge"), "row"))
    best = F.min(F.struct((-F.col("points")).alias("a"), F.col("id").isNull().alias("b"), F.col("id").alias("c"), F.col("row").alias("d"))).alias("m")
    keep = stored(members.groupBy("grp").agg(best, F.count("*").alias("group_size")).select("grp", F.col("m.c").alias("keep_id"), F.col("m.d").alias("keep_row"), "group_size"))
    told = members.join(keep.hint("merge"), "grp").select("row", "keep_id", "keep_row", "group_size")
    out = facts.join(told.hint("merge"), "row", "left")
    return out.withColumns({"keep_id": F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")), "keep_row": F.coalesce("keep_row", "row"), "group_size": F.coalesce("group_size", F.lit(1))})


def duplicate_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", digest: bool = True, row: str | None = None) -> DataFrame:
    """One row per row of docs: row (the column that row names, which must not repeat, else a
    number that means nothing outside), doc_id, keep_id, keep_row, group_size, kept and, if
    asked for, text_sha256. Of equal texts the one with the most code points before
    normalising stays, then the smallest id, then the first row."""
    columns = [
        (F.col(row) if row else F.monotonically_increasing_id()).alias("row"), F.col(key).cast("long").alias("id"), F.coalesce(F.length(text), F.lit(0)).alias("points"),
        normalized(F.col(text)).cast("binary").alias("raw"),
    ]
    head = F.substring("raw", 1, HEAD)
    sha = [F.sha2("raw", 256).alias("text_sha256")] if digest else []
    texts = docs.select(*columns).select("row", "id", "points", "raw", F.octet_length("raw").alias("bytes"), F.xxhash64(head).alias("slot"), *sha)
    own = ["row", "id", "points", *(["text_sha256"] if digest else [])]
    facts = stored(texts.withColumn("body", head).drop("raw"))
    ended, shared = _rounds(facts.select("row", "body", "bytes"), FIRST, HEAD)
    slots = stored(facts.join(shared.select("row").hint("merge"), "row", "left_semi").select("slot").distinct())
    longer = F.col("bytes") > HEAD
    alone = facts.where(longer).join(slots.hint("merge"), "slot", "left_anti").select(own).unionByName(facts.where(~longer).select(own))
    out = _told(alone, ended)
    if not slots.isEmpty():
        whole = stored(texts.where(longer).join(slots, "slot", "left_semi").withColumnRenamed("raw", "body"))
        out = out.unionByName(_told(whole.select(own), _rounds(whole.select("row", "body", "bytes"), HEAD * GROW)[0]))
    return out.select("row", F.col("id").alias("doc_id"), "keep_id", "keep_row", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), *own[3:])


def dedup(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs without the copies: of equal texts one row stays, with all its columns."""
    mark = free_name(docs.columns, "row")
    numbered = stored(docs.withColumn(mark, F.monotonically_increasing_id()))
    gone = duplicate_groups(numbered, key, text, digest=False, row=mark).where("not kept").select(F.col("row").alias(mark))
    return numbered.join(gone, mark, "left_anti").drop(mark)
