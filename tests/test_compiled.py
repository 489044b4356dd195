"""Joins of segments with tiles run in compiled code, and rasters sort only the pieces that may win a cell."""

import pytest
from pyspark.sql import functions as F

from roadmesh.operators import cities, splits, tiles


@pytest.fixture(scope="module")
def pieces(spark):
    at = lambda k, m: F.pmod(F.xxhash64("id", F.lit(k)), F.lit(m)) / m
    return spark.range(40).select((F.col("id") % 7).alias("nid"), F.col("id").alias("v"), *(at(k, 97).alias(c) for k, c in enumerate(("x1", "y1", "x2", "y2"))))


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tile_joins_have_no_lambdas(spark, pieces):
    # functions with lambdas are interpreted, with all that their arguments compute
    grids = spark.createDataFrame([("a", 10, 0.0, 0.0, 0.1, 0.1, 10, 10)], "city string, scale int, w double, s double, dx double, dy double, rows int, cols int")
    for joined in (tiles.join_segments_tiles(pieces, [10, 20]), cities.segments_on_tiles(pieces.withColumn("city", F.lit("a")), grids, ["nid", "v"])):
        assert "lambda" not in plan(joined)


def test_blocks_compute_their_tiles_once(spark, pieces):
    at = lambda c, k: (F.col(c) + k) / F.col("scale")
    t = tiles.join_segments_tiles(pieces, [10]).select(*tiles.KEY).distinct().withColumns({"w": at("col", 0), "e": at("col", 1), "s": at("row", 0), "n": at("row", 1)})
    assert "Generate inline" not in plan(splits.grid_blocks(t, 3))


def test_raster_is_that_of_all_pieces(spark, pieces):
    got = {(r["r"], r["c"]): r["value"] for r in tiles.rasterize(pieces.withColumn("value", F.col("v").cast("double")), 20, "value", ["nid", "v"]).collect()}
    want = {}
    for p in sorted((r.asDict() for r in pieces.collect()), key=lambda p: (p["nid"], p["v"])):
        if all(0 < p[c] < 1 for c in ("x1", "y1", "x2", "y2")):
            r1, r2, c1, c2 = (int(p[c] * 19) for c in ("y1", "y2", "x1", "x2"))
            k = max(abs(r2 - r1), abs(c2 - c1))
            for i in range(k + 1):
                want[int((r1 + (r2 - r1) * i / max(k, 1) + 0.5) // 1), int((c1 + (c2 - c1) * i / max(k, 1) + 0.5) // 1)] = float(p["v"])
    assert got == want


def test_raster_sorts_only_winners(spark, pieces):
    # the pieces that meet the whole order are joined with the cells' winners, written before
    assert "Scan ExistingRDD" in plan(tiles.rasterize(pieces.withColumn("value", F.lit(1.0)), 20, "value", ["nid", "v"]))


def test_values_joined_before_tiles_give_the_same(spark, pieces):
    values = spark.createDataFrame([(0, 1.0), (3, 5.0)], "nid long, jf double")
    after = tiles.tile_jf(tiles.join_segments_tiles(pieces, [10]), values)
    before = tiles.valued_tile_jf(tiles.join_segments_tiles(pieces.join(values, "nid", "left"), [10]))
    key = lambda d: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in d.collect()), key=repr)
    assert key(after) == key(before)
