"""Runs of the near-duplicate index: counted before they are made, and dealt without losing a link."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadmesh.llm import simhash
from roadmesh.llm.common import lean

NAMES = [f"s{i}" for i in range(simhash.LANES)]


@pytest.fixture(scope="module")
def signed(spark):
    """Signatures and texts of twenty families of ten near copies, whose sketches and segments meet."""
    rng = np.random.default_rng(4)
    rows = []
    for f in range(20):
        words = [f"f{f}w{i}" for i in range(120)]
        for j in range(10):
            t = list(words)
            t[int(rng.integers(0, 120))] = f"f{f}x{j}"
            rows.append((f * 10 + j, " ".join(t)))
    sig = spark.createDataFrame([(i, *simhash.signature(t).view(np.int64).tolist()) for i, t in rows], ", ".join(["id long", *(f"{n} long" for n in NAMES)]))
    return sig, spark.createDataFrame(rows, "id long, t string")


def slots_of(sig):
    classes = sig.select(F.col("id").alias("rep"), *NAMES)
    return classes, classes.select("rep", *NAMES[: simhash.INDEXED + 1]).mapInArrow(lean(simhash._wide_variants), "run long, sketch long, id long")


def test_sizes_are_those_of_the_runs(signed):
    classes, slots = slots_of(signed[0])
    want = Counter(r["run"] for r in slots.collect())
    assert {r["run"]: r["n"] for r in simhash._run_sizes(classes).collect()} == want and max(want.values()) > 8


@pytest.mark.parametrize("most", [4, 8])
def test_every_pair_of_a_run_meets(signed, most):
    """After dealing, pairs that share a run are those that shared one before, in smaller runs."""

    def pairs(rows):
        runs = {}
        for r in rows:
            runs.setdefault(r["run"], []).append(r["id"])
        return {(a, b) for ids in runs.values() for a in ids for b in ids if a < b}, max(map(len, runs.values()))

    classes, slots = slots_of(signed[0])
    (before, longest), (after, dealt) = pairs(slots.collect()), pairs(simhash._dealt(slots, classes, most).collect())
    assert before == after and dealt <= longest
    assert simhash._dealt(slots, classes, longest) is slots


def test_components_stay(signed):
    sig, texts = signed
    got = [{r["id"]: r["component"] for r in simhash.signed_groups(sig, texts, 5, 0.8, run=run).collect()} for run in (4, 8, simhash.RUN)]
    assert got[0] == got[1] == got[2] == {i: i - i % 10 for i in range(200)}


def test_no_signatures(signed):
    sig, texts = signed
    assert simhash.signed_groups(sig.limit(0), texts.limit(0), 5, 0.8, run=4).count() == 0


def test_links_of_a_family_are_gathered(spark):
    """One family of 600 near copies shares many runs: each run is a star, and the links that reach the components
    are about one a member, not one for each run that a member is in; what they connect stays."""
    rng = np.random.default_rng(6)
    base, rows = [f"w{i}" for i in range(150)], []
    for j in range(600):
        t = list(base)
        t[int(rng.integers(0, 150))] = f"x{j}"
        rows.append((j, *simhash.signature(" ".join(t)).view(np.int64).tolist()))
    classes, slots = slots_of(spark.createDataFrame(rows, ", ".join(["id long", *(f"{n} long" for n in NAMES)])))
    apart = simhash.bits_apart(0.8, 64) + 6
    found = slots.repartition("run").sortWithinPartitions("run", "id").mapInArrow(lean(simhash._wide_linker(apart)), "a long, b long, dense boolean")
    found = simhash.stored(found)
    assert found.where("dense and a >= b").isEmpty()
    links = found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    few = simhash.gathered(simhash.gathered(links))
    assert links.count() > 5 * 600 and few.count() < 2 * 600

    def parts(d):
        return {(r["node"], r["label"]) for r in simhash.components(d).collect()}

    assert parts(few) == parts(links) == {(r["node"], r["label"]) for r in simhash.gathered_components(links.selectExpr("b as a", "a as b")).collect()}


def test_cells_become_the_same_runs_with_fewer_rows_shuffled(signed):
    classes, slots = slots_of(signed[0])
    cells = simhash._cells(classes)
    row = lambda r: (r["run"], r["sketch"], r["id"])
    assert Counter(map(row, simhash._runs(cells).collect())) == Counter(map(row, slots.collect()))
    assert 8 * cells.count() == slots.count()
    # all of a run is in one task, as the cells of each of its rows are dealt alike
    runs = simhash._runs(cells.repartition(7, simhash._held())).select("run", F.spark_partition_id().alias("p")).distinct()
    assert runs.count() == runs.select("run").distinct().count()


def test_texts_without_links_are_not_shuffled(spark, signed):
    """One family of near copies among texts that are like no other: only its texts, and few by chance, travel."""
    sig, texts = signed
    alone = spark.range(1000, 3000).select(F.col("id"), F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.concat(F.lit("z"), F.col("id").cast("string"), F.lit("y"), k.cast("string")))).alias("t"))
    docs = texts.unionByName(alone).select(F.col("id").alias("doc_id"), F.col("t").alias("text"), F.lit(1).alias("hit"), F.lit(2).alias("bits"))
    for threshold in (-1, 10 << 20):  # as if tables were too large to be broadcast
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        got = simhash.dedup(docs)
        assert got.columns == docs.columns
        assert sorted(r["doc_id"] for r in got.collect()) == [*range(0, 200, 10), *range(1000, 3000)]
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    hits = simhash.marked(docs, "doc_id", texts.select(F.col("id").alias("doc_id"))).where("_hit")
    assert hits.where("doc_id < 200").count() == 200 and hits.count() < 220
