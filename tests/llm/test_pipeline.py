"""The stages one after the other, against what each of them promises."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from roadmesh.llm import exact_dedup, mixing, piece_bpe, simhash, stages
from roadmesh.llm.common import stored, table
from roadmesh.llm.queries import model_path

SF = "/root/testdata/sf0.001"


def test_mixing_meets_each_source_target(spark):
    """A hot source is cut below its size, small ones are repeated: words kept are near the targets."""
    n = {"a": 300, "b": 3000, "c": 900}
    rows = [(i * 10 + k, " ".join(["w"] * (150 + i % 200)), s, i) for k, (s, m) in enumerate(n.items()) for i in range(m)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, row int")
    want = {r["source"]: (r["target"], r["source_size"]) for r in mixing.mix(docs).groupBy("source").agg(F.first("target").alias("target"), F.first("source_size").alias("source_size")).collect()}
    kept = stages.mixture(spark, docs, "")
    assert kept.columns == docs.columns
    got = {r["source"]: r["n"] for r in kept.groupBy("source").agg(F.sum(mixing.word_count(F.col("text"))).alias("n")).collect()}
    assert any(abs(t / size - round(t / size)) > 0.2 for t, size in want.values())
    assert all(abs(got[s] - t) <= 0.02 * t for s, (t, _) in want.items()), (got, want)


def test_stages_on_a_table_with_extra_columns(spark):
    docs = table(spark, SF, "documents").withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in ("row", "gone", "keep", "ids", "size", "copy")})
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stored(stage(spark, docs, SF))
        assert after.columns == docs.columns, name
        assert after.exceptAll(docs).select("doc_id").distinct().count() == 0 or name == "mixing"
        assert after.where(F.col("gone") != F.concat(F.lit("gone"), F.col("doc_id").cast("string"))).isEmpty()
        kept.append((docs, after))
        docs = after
    ids = lambda d: {r[0] for r in d.select("doc_id").collect()}
    labels = {r["doc_id"]: r["quality"] for r in table(spark, SF, "labels").collect()}
    good = {i for i, q in labels.items() if q}
    assert len(good & ids(kept[0][1])) >= 0.98 * len(good & ids(kept[0][0]))
    norm = lambda d: {r[0] for r in d.select(exact_dedup.normalized(F.col("text"))).collect()}
    assert norm(kept[1][0]) == norm(kept[1][1]) and kept[1][1].count() == len(norm(kept[1][1]))
    before, after = kept[2]
    sets = {r["doc_id"]: simhash.shingles(r["text"]) for r in before.collect()}
    left = ids(after)
    for i in sorted(set(sets) - left):  # what went has a like one
        assert any(j != i and len(x) and simhash.jaccard(x, [sets[i]])[0] >= 0.8 for j, x in sets.items() if len(sets[i]))
    coded = corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()
    bpe = piece_bpe.load(model_path())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(coded) == docs.count() and all(r["n_tokens"] == len(r["ids"]) and r["ids"] == bpe.encode([texts[r["doc_id"]]])[0] for r in coded)


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_an_empty_table(spark, name):
    docs = table(spark, SF, "documents").where("false")
    assert dict(corpus_pipeline.STAGES)[name](spark, docs, SF).count() == 0


def test_run_gives_tokens(spark):
    got = corpus_pipeline.run(spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids"] and got.count() > 50
