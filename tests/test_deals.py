"""Edges are dealt to tasks of bounded size once, and what groups or joins them needs no further shuffle of them."""

import re

import pytest

from roadmesh.operators import tiles
from roadmesh.plans import catalog
from roadmesh.plans.inputs import Inputs

SF = "/root/testdata/sf0.001"


@pytest.fixture
def plan(spark):
    """The plan of a query as large tables get it: no side of a join is broadcast."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield lambda d: d._jdf.queryExecution().executedPlan().toString()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def shuffles(text):
    return re.findall(r"Exchange (?:hash|range|Single)\w*(?:\([^)]*\))?, \w+", text)


def test_edges_of_tiles_are_shuffled_once(spark, plan):
    """By u only: their groups and the join with nodes are served by it."""
    i = Inputs(spark, SF)
    found = shuffles(plan(catalog.tile_edges(i)))
    assert len([x for x in found if "REPARTITION" in x]) == 1 and not [x for x in found if re.search(r"\bv#|key#", x)]


def test_parallel_edges_of_a_tile(spark):
    """The least key of parallel edges, in each tile of their node; a node that comes twice counts once."""
    n = spark.createDataFrame([(10, 1, 1, 1), (10, 1, 1, 1), (20, 2, 2, 1), (10, None, None, 2)], "scale int, row int, col int, node_id long")
    e = spark.createDataFrame([(1, 2, 5, 1.0), (1, 2, 3, 7.0), (1, 3, 1, 2.0), (2, 1, 1, 4.0)], "u long, v long, key int, length double")
    got = sorted(map(tuple, tiles.tile_edges_out(n, e).collect()))
    assert got == [(10, 1, 1, 1, 2, 3, 7.0), (10, 1, 1, 1, 3, 1, 2.0), (20, 2, 2, 1, 2, 3, 7.0), (20, 2, 2, 1, 3, 1, 2.0)]


def test_either_end_needs_no_shuffle_of_tiles(spark, plan):
    """Rows of edges and tiles are not compared: no exchange or group by the tile's columns."""
    i = Inputs(spark, SF)
    text = plan(catalog.QUERIES["j5_j7_tile_edges_any"](spark, SF))
    assert not [x for x in shuffles(text) if "scale#" in x] and len([x for x in shuffles(text) if "REPARTITION" in x]) == 2
    n = catalog.node_tile(i).select(*tiles.KEY, "node_id")
    e = spark.createDataFrame([(1, 1_000_001, 5), (1, 1_000_001, 5), (1, 1_000_001, 6), (1, -5, 1), (-5, 1, 1), (-5, -6, 1), (2, 2, 1)], "u long, v long, key int")
    at = {}
    for r in n.where("row is not null and node_id in (1, 2, 1000001)").collect():
        at.setdefault(r["node_id"], set()).add((r["scale"], r["row"], r["col"]))
    want = sorted({(*t, *x) for x in map(tuple, e.collect()) for c in x[:2] for t in at.get(c, ())})
    assert sorted(map(tuple, tiles.tile_edges_any(n, e).collect())) == want and want


def test_neighbours_are_shuffled_once_by_node(spark, plan):
    """Edges by u and both ways by node, each in tasks of bounded size; the rest are sums of groups."""
    found = shuffles(plan(catalog.QUERIES["gf30_neighbours"](spark, SF)))
    assert len([x for x in found if "REPARTITION" in x]) == 2 and not [x for x in found if re.search(r"\bb#|key#", x)]


def test_boxes_are_dealt_before_they_become_tiles(spark):
    """Tasks grow with the customers, however few files hold them."""
    i = Inputs(spark, SF)
    assert catalog.dealt_boxes(i, 50).rdd.getNumPartitions() == 1 + i.table("customer").count() // 50 > 1
    assert "REPARTITION" in catalog.QUERIES["g10_grid_in_degrees"](spark, SF)._jdf.queryExecution().executedPlan().toString()
