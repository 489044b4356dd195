"""Large families part into smaller ones before their members are compared, and no link is lost."""

import numpy as np

from roadmesh.llm import simhash

NAMES = [f"s{i}" for i in range(simhash.LANES)]


def family(spark, clusters=30, size=8, lone=120):
    """One family: all texts share a passage; clusters have near copies, and others only the passage."""
    rng = np.random.default_rng(5)
    passage, rows = [f"p{i}" for i in range(40)], []
    for c in range(clusters):
        own = [f"c{c}w{i}" for i in range(60)]
        for j in range(size):
            t = list(own)
            for _ in range(int(rng.integers(1, 4))):
                t[int(rng.integers(0, 60))] = f"c{c}x{j}"
            rows.append(" ".join(passage + t))
    rows += [" ".join([*passage, *(f"l{k}w{i}" for i in range(60))]) for k in range(lone)]
    rows = [rows[i] for i in rng.permutation(len(rows))]
    members = [(7, i, *simhash.signature(t).view(np.int64).tolist(), t) for i, t in enumerate(rows)]
    return rows, spark.createDataFrame(members, ", ".join(["family long", "rep long", *(f"{n} long" for n in NAMES), "t string"]))


def pairs(rows):
    sets = [simhash.shingles(t) for t in rows]
    return [(i, j) for i in range(len(sets)) for j in np.flatnonzero(simhash.jaccard(sets[i], sets) >= 0.8).tolist() if i < j]


def test_a_family_parts_where_nothing_links(spark):
    """Linked members stay together; those that only share the passage part or go."""
    rows, members = family(spark)
    got = {r["rep"]: r["family"] for r in simhash.split_families(members, 5, 0.8, block=16).collect()}
    linked = pairs(rows)
    assert len(linked) > 100 and all(got[i] == got[j] for i, j in linked)
    sizes = np.unique(list(got.values()), return_counts=True)[1]
    assert sizes.max() <= 16 and len(got) < 300


def test_compared_rows_grow_with_the_family_not_its_square(spark, monkeypatch):
    """Rows that are compared in blocks: each member about once, where every block met every other one before."""
    rows, members = family(spark)
    made, keep = [], simhash.stored

    def spy(df):
        out = keep(df)
        if df.columns == ["node", "label"]:
            made.append(out.count())
        return out

    monkeypatch.setattr(simhash, "stored", spy)
    got = {r["node"]: r["label"] for r in simhash.family_labels(members, 64 * simhash.LANES, 5, 0.8, block=16).collect()}
    label = list(range(len(rows)))
    for _ in range(10):
        for i, j in pairs(rows):
            label[i] = label[j] = min(label[i], label[j])
    assert [got.get(i, i) for i in range(len(rows))] == label
    assert sum(made) <= 2 * len(rows)


def test_texts_without_words_and_an_empty_family(spark):
    rows, members = family(spark, 1, 4, 0)
    none = members.selectExpr("family", "rep + 100 as rep", *NAMES, "'' as t").unionByName(members)
    assert {r["rep"] for r in simhash.split_families(none, 5, 0.8, block=2).collect() if r["rep"] < 100} >= {i for p in pairs(rows) for i in p}
    assert simhash.split_families(members.limit(0), 5, 0.8, block=2).count() == 0
