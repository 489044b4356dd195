"""Pieces are dealt to small tasks before they meet tiles, and pivots are found without sorting all nodes."""

from pyspark.sql import functions as F

from roadmesh.operators import graph, tiles
from roadmesh.plans import cities, more
from roadmesh.plans.inputs import Inputs


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pieces_keep_small_tasks(spark):
    i = Inputs(spark, "/root/testdata/sf0.01")
    n = i.tasks()
    assert n == 1 + i.table("lineitem").count() // 50_000 > 1
    assert "REPARTITION_BY_NUM" in plan(i.pieces()) and "REPARTITION_BY_NUM" in plan(cities.pieces(i))
    assert i.pieces().rdd.getNumPartitions() == n


def test_segments_of_a_tile_are_counted_where_they_are(spark):
    p = plan(cities.j1_g17_city_segments(Inputs(spark, "/root/testdata/sf0.001")))
    assert not [x for x in p.splitlines() if "Exchange hashpartitioning(city" in x and "nid" in x]


def test_speeds_are_not_dealt_by_class(spark):
    e = spark.createDataFrame([(1, 2, "a", "30 mph", 1.0), (1, 3, "a", None, 2.0), (2, 3, None, None, 3.0)], "u long, v long, highway string, maxspeed string, length double")
    got = graph.edge_speeds(e)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as for edges too many to be broadcast
    p = plan(got)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" not in p and p.count("Exchange hashpartitioning(highway") <= 1  # that of the means
    assert {(r["u"], r["v"]): round(r["speed_kph"], 6) for r in got.collect()} == {(1, 2): 48.28032, (1, 3): 48.28032, (2, 3): 48.28032}


def test_least_hashes_are_those_of_all(spark):
    n = spark.range(3000).select((F.col("id") % 3).alias("g"), F.col("id").alias("node_id")).withColumn("size", F.lit(1000))
    rows = lambda spare: sorted(tuple(r) for r in graph.least_hashes(n, ["g"], 20, [42, 43], spare).select("g", "draw", "node_id", "place").collect())
    whole = rows(1e9)
    assert len(whole) == 120 and rows(4.0) == whole and rows(0.9) == whole  # 0.9: too few pass in most groups, which are sorted whole


def test_levels_meet_nodes_with_their_neighbours(spark):
    e = spark.createDataFrame([("a", 1, 2), ("a", 1, 2), ("a", 2, 3), ("a", 2, 2), ("a", 3, 1)], "g string, u long, v long")
    got = {r["node_id"]: r["centrality"] for r in graph.betweenness(e, ["g"]).collect()}
    assert got == {1: 0.5, 2: 0.5, 3: 0.5}


def test_segments_of_a_tile_are_made_different_where_they_are(spark):
    """no sets are merged, and only tiles are a key of a shuffle after the pieces."""
    p = plan(more.j2_segments_per_tile(Inputs(spark, "/root/testdata/sf0.001")))
    assert "collect_set" not in p and not [x for x in p.splitlines() if "Exchange hashpartitioning(scale" in x and "nid" in x.split("ENSURE")[0]]
    joined = spark.createDataFrame([(1, 0, 0, 10), (1, 0, 0, 9), (1, 0, 0, 10), (1, 0, 1, None), (1, 0, 1, 7)], "scale int, row int, col int, nid long")
    assert sorted((r["col"], r["segments"]) for r in tiles.segments_per_tile(joined).collect()) == [(0, [9, 10]), (1, [7])]
