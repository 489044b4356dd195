"""Micro fixtures with answers by hand, and properties."""

import math

from pyspark.sql import functions as F

from roadmesh.functions import text
from roadmesh.operators import clusters, graph, grid, metrics, models, ranks, splits, temporal, tiles
from roadmesh.sources import tables


def test_positional_bins_and_days(spark):
    rows = [(1, i, None if i in (3, 7) else float(i)) for i in range(50)]
    d = spark.createDataFrame(rows, "nid long, ts int, jf double")
    bins = {r["bin"]: r["jf"] for r in temporal.resample_mean(d, ["nid"], 6).collect()}
    assert len(bins) == 9 and bins[0] == (0 + 1 + 2 + 4 + 5) / 5 and bins[8] == 48.5
    assert temporal.to_days(temporal.resample_mean(d, ["nid"], 2), ["nid"]).count() == 24  # a short day goes


def test_hour_list_leaves_out_hour_0(spark):
    d = spark.createDataFrame([(1, h, 100.0 if h == 0 else 1.0) for h in range(24)], "nid long, hour int, jf double")
    assert temporal.tod_agg(d, ["nid"], [*range(1, 25)], "max").first()["jf"] == 1.0
    assert temporal.tod_agg(d, ["nid"], [0, 24], "variance").first()["jf"] > 0


def pieces(spark):
    return spark.createDataFrame([(1, 0.1, 0.1, 0.4, 0.1), (2, 0.25, 0.75, 0.75, 0.75), (3, 0.5, 0.1, 0.5, 0.3)], "nid long, x1 double, y1 double, x2 double, y2 double")


def test_clipping_in_a_two_by_two_grid(spark):
    got = {(r["nid"], r["row"], r["col"]): r["len"] for r in tiles.clipped_length(tiles.join_segments_tiles(pieces(spark), [2])).collect()}
    want = {(1, 0, 0): 0.3, (2, 1, 0): 0.25, (2, 1, 1): 0.25, (3, 0, 0): 0.2, (3, 0, 1): 0.2}  # the border counts on both sides
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k]) for k in want)


def test_length_weighted_mean_counts_missing_in_weights(spark):
    joined = tiles.join_segments_tiles(pieces(spark), [1])
    v = spark.createDataFrame([(1, 2.0), (2, 4.0)], "nid long, jf double")
    r = tiles.tile_jf(joined, v).first()
    assert math.isclose(r["length_weighted_mean"], (2 * 0.3 + 4 * 0.5) / (0.3 + 0.5 + 0.2)) and r["mean"] == 3.0


def test_node_on_border_is_in_no_tile(spark):
    n = spark.createDataFrame([(1, 0.5, 0.2), (2, 0.2, 0.2)], "node_id long, x double, y double")
    got = {r["node_id"]: (r["row"], r["col"]) for r in tiles.join_nodes_tiles(n, [2]).collect()}
    assert got == {1: (None, None), 2: (0, 0)}


def test_betweenness_path_and_star(spark):
    path = [("p", 1, 2), ("p", 2, 3)]
    star = [("s", a, b) for leaf in (1, 2, 3, 4) for a, b in ((0, leaf), (leaf, 0))]
    e = spark.createDataFrame(path + star, "g string, u long, v long")
    got = {(r["g"], r["node_id"]): r["centrality"] for r in graph.betweenness(e, ["g"]).collect()}
    assert got[("p", 2)] == 0.5 and got[("p", 1)] == 0.0
    assert math.isclose(got[("s", 0)], 1.0) and got[("s", 3)] == 0.0


def test_components_and_contraction(spark):
    two = [(u, v, 1.0) for a, b in ((1, 2), (2, 3), (3, 4)) for u, v in ((a, b), (b, a))]
    e = spark.createDataFrame([("g", *x) for x in two + [(9, 10, 1.0)]], "g string, u long, v long, length double")
    c = {r["node_id"]: r["component"] for r in graph.weak_components(e, ["g"]).collect()}
    assert c == {1: 1, 2: 1, 3: 1, 4: 1, 9: 9, 10: 9}
    assert {r["node_id"] for r in graph.largest_component(e, ["g"]).collect()} == {1, 2, 3, 4}
    got = {(r["u"], r["v"]): r["length"] for r in graph.contract_chains(e, ["g"]).collect()}
    assert got == {(1, 4): 3.0, (4, 1): 3.0, (9, 10): 1.0}


def test_kappa(spark):
    d = spark.createDataFrame([(0.2, 0.9), (1.9, 2.1), (3.5, 3.0)], "a double, p double")
    a, p = [0, 1, 3], [0, 2, 3]
    labels = sorted({*a, *p})
    at = labels.index
    o = sum((at(x) - at(y)) ** 2 for x, y in zip(a, p))
    e = sum((at(x) - at(y)) ** 2 for x in a for y in p) / 3
    assert math.isclose(metrics.weighted_kappa(d).first()["kappa"], 1 - o / e)
    same = d.withColumn("p", F.col("a"))
    assert metrics.weighted_kappa(same).first()["kappa"] == 1.0


def test_wasserstein_and_js(spark):
    d = spark.createDataFrame([("a", 0.0), ("a", 1.0), ("b", 5.0), ("b", 6.0), ("c", 0.0), ("c", 1.0)], "k string, x double")
    w = {(r["a"], r["b"]): r["distance"] for r in ranks.wasserstein(d, "k", "x").collect()}
    assert math.isclose(w[("a", "b")], 5.0) and abs(w[("a", "c")]) < 1e-12
    j = {(r["a"], r["b"]): r["distance"] for r in metrics.js_distance(d, "k", "x", 10, 0.0, 10.0).collect()}
    assert math.isclose(j[("a", "b")], math.sqrt(math.log(2))) and j[("a", "c")] == 0.0


def test_wkt_slug_and_zero_fill(spark):
    d = spark.createDataFrame([(1, "MULTILINESTRING Z ((0 0 5, 1 0 5, 1 2 5), (3 3 0, 4 4 0))")], "nid long, wkt string")
    got = [tuple(r) for r in text.explode_wkt(d).orderBy("part", "piece").select("part", "piece", "x1", "y1", "x2", "y2").collect()]
    assert got == [(0, 0, 0.0, 0.0, 1.0, 0.0), (0, 1, 1.0, 0.0, 1.0, 2.0), (1, 0, 3.0, 3.0, 4.0, 4.0)]
    r = spark.range(1).select(text.slug(F.lit("RC, Cape Town!")).alias("a"), text.zero_fill(F.lit("1234")).alias("b"), text.zero_fill(F.lit("7")).alias("c")).first()
    assert tuple(r) == ("rc-cape-town", "1234", "007")


def test_boxes(spark):
    d = spark.createDataFrame([(0, 45.0, 7.0), (8, 45.0, 7.0)], "code int, lat double, lon double")
    b = grid.square_box(d, 50.0)
    assert all(r["fits"] for r in grid.resize_check(b, 50.0).collect())
    moved = {r["code"]: r["n"] for r in grid.shift_box(b).collect()}
    was = {r["code"]: r["n"] for r in b.collect()}
    assert math.isclose(moved[0], was[0])
    north = {c: moved[c] - was[c] for c in was}  # code 8 goes west: its latitude hardly changes
    assert abs(north[8]) < 1e-4 and math.isclose(grid.SHIFTS[1][0], 2 / 3)
    up = grid.shift_box(b.withColumn("code", F.lit(1))).first()
    assert math.isclose(up["n"] - was[0], math.degrees(2 / 3 / grid.RADIUS_KM), rel_tol=1e-6)


def test_strips_and_folds(spark):
    t = spark.createDataFrame([(r, c, c / 4, (c + 1) / 4, r / 4, (r + 1) / 4) for r in range(4) for c in range(4)], "row int, col int, w double, e double, s double, n double")
    assert splits.grid_blocks(t, 2).select("block").distinct().count() >= 4
    ten = spark.createDataFrame([(0, c, c / 10, (c + 1) / 10, 0.0, 1.0) for c in range(10)], "row int, col int, w double, e double, s double, n double")
    got = {r["col"]: r["strip"] for r in splits.strips(ten, "w", "e", 3).collect()}
    assert got == {c: 0 if c < 3 else 1 if c < 6 else 2 for c in range(10)}  # edges 0, 0.3, 0.6 and 1
    assert splits.strips(ten, "w", "e", 50).select("strip").distinct().count() == 10  # more strips than edges
    n = [r["fold"] for r in splits.contiguous_folds(spark.range(11), "id", 3).orderBy("id").collect()]
    assert n == [0, 0, 0, 0, 1, 1, 1, 1, 2, 2, 2]
    f = splits.shuffled_folds(spark.range(70).withColumnRenamed("id", "k"), "k").groupBy("fold").count().collect()
    assert len(f) == 7 and all(r["count"] == 10 for r in f)


def test_sampled_betweenness_is_the_mean_of_its_repeats(spark):
    """Against a walk from each drawn source on a graph of more nodes than pivots."""
    edges = [("g", a, b) for a in range(12) for b in ((a + 1) % 12, (a * 5 + 2) % 12) if a != b]
    e = spark.createDataFrame(edges, "g string, u long, v long").distinct()
    got = {r["node_id"]: r["centrality"] for r in graph.betweenness(e, ["g"], pivots=4, repeats=3).collect()}
    near = {}
    for _, u, v in set(edges):
        near.setdefault(u, []).append(v)
    weight = {}
    for r in range(3):
        order = [x["id"] for x in spark.range(12).orderBy(F.md5(F.concat(F.col("id").cast("string"), F.lit(f":{42 + r}")))).limit(4).collect()]
        for s in order:
            weight[s] = weight.get(s, 0) + 1 / 3
    want = dict.fromkeys(range(12), 0.0)
    for s, w in weight.items():
        dist, paths, order = {s: 0}, {s: 1.0}, [s]
        for u in order:
            for v in near[u]:
                if v not in dist:
                    dist[v], paths[v] = dist[u] + 1, 0.0
                    order.append(v)
                if dist[v] == dist[u] + 1:
                    paths[v] += paths[u]
        dep = dict.fromkeys(order, 0.0)
        for u in reversed(order):
            for v in near[u]:
                if dist[v] == dist[u] + 1:
                    dep[u] += paths[u] / paths[v] * (1 + dep[v])
        for u in order:
            if u != s:
                want[u] += w * dep[u] * 12 / 4 / (11 * 10)
    assert all(math.isclose(got[u], want[u], abs_tol=1e-9) for u in want)


def test_a_ring_without_ends_goes(spark):
    ring = [("g", a, (a + 1) % 7, 1.0) for a in range(7)] + [("g", (a + 1) % 7, a, 1.0) for a in range(7)]
    e = spark.createDataFrame([*ring, ("g", 20, 21, 2.0)], "g string, u long, v long, length double")
    assert [tuple(r) for r in graph.contract_chains(e, ["g"]).collect()] == [("g", 20, 21, 2.0)]


def test_warping(spark):
    a, b = [1.0, 3.0, 4.0, 9.0], [1.0, 1.0, 3.5, 8.0, 9.0]
    cost = {(-1, -1): 0.0}
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            cost[i, j] = abs(x - y) + min(cost.get(k, math.inf) for k in ((i - 1, j), (i, j - 1), (i - 1, j - 1)))
    got = clusters.warping_pairs(spark.createDataFrame([("a", a), ("b", b)], "k string, values array<double>"), "k").first()
    assert math.isclose(got["distance"], cost[3, 4])


def test_permutations_are_one_to_one_and_a_useless_feature_costs_nothing(spark):
    d = spark.createDataFrame([(i, float(i % 7), float(i % 5), 3.0 * (i % 7)) for i in range(100)], "row_id long, a double, b double, y double")
    m = models.MODELS["LR"]().setLabelCol("y").fit(models.assembled(d, ["a", "b"]))
    got = {r["feature"]: r["importance"] for r in models.permutation_importance(d, m, ["a", "b"], repeats=5).collect()}
    assert got["a"] > 0.5 and abs(got["b"]) < 1e-6


def test_forest_shape_takes_the_greatest_tree(spark):
    d = spark.createDataFrame([(float(i), float(i % 3)) for i in range(60)], "a double, y double")
    m = models.MODELS["RF"]().setNumTrees(3).setLabelCol("y").fit(models.assembled(d, ["a"]))
    t, leaves, depth, all_ = models.forest_shape(m)
    assert (t, depth) == (3, max(x.depth for x in m.trees)) and leaves == max((x.numNodes + 1) / 2 for x in m.trees) and all_ == t * leaves * depth


def test_clipped_edges_and_new_nodes(spark):
    p = spark.createDataFrame([(1, 9, 0.1, 0.1, 0.9, 0.1)], "nid long, v long, x1 double, y1 double, x2 double, y2 double")
    c = tiles.clip_edges(tiles.join_segments_tiles(p, [4]))
    got = {r["col"]: (r["kind"], round(r["xa"], 6), round(r["xb"], 6)) for r in c.collect()}
    assert got == {0: ("head_out", 0.1, 0.25), 1: ("crossing", 0.25, 0.5), 2: ("crossing", 0.5, 0.75), 3: ("tail_out", 0.75, 0.9)}
    assert tiles.synthetic_nodes(c).count() == 6


def test_few_columns_of_a_row_are_tried(spark):
    """Each tile that a piece meets, whatever its slope, by brute force over all tiles."""
    import random

    rng = random.Random(5)
    lines = [(k, *[round(rng.random(), 3) for _ in range(4)]) for k in range(40)] + [(40, 0.2, 0.5, 0.7, 0.5), (41, 0.5, 0.1, 0.5, 0.9), (42, 0.0, 0.0, 1.0, 1.0), (43, 0.1, 0.3, 0.9, 0.3 + 1e-9)]
    d = spark.createDataFrame(lines, "nid long, x1 double, y1 double, x2 double, y2 double")
    got = {(r["nid"], r["row"], r["col"]) for r in tiles.join_segments_tiles(d, [10]).collect()}
    every = d.crossJoin(spark.range(10).select(F.col("id").cast("int").alias("row"))).crossJoin(spark.range(10).select(F.col("id").cast("int").alias("col")))
    t0, t1 = grid.clip(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), F.col("col") / 10, F.col("row") / 10, (F.col("col") + 1) / 10, (F.col("row") + 1) / 10)
    assert got == {(r["nid"], r["row"], r["col"]) for r in every.where(t0 <= t1).collect()}


def test_readers(spark, tmp_path):
    (tmp_path / "seg.csv").write_text('NID,Linestring,x\n1,"LINESTRING (0 0, 1 1)",9\n')
    assert tables.read_segments(spark, str(tmp_path / "seg.csv")).first()["nid"] == 1
    (tmp_path / "jf.csv").write_text("NID,2024-01-01 00:00:00,2024-01-01 00:10:00\n1,2.5,\n")
    long = temporal.jf_to_long(tables.read_jf_wide(spark, str(tmp_path / "jf.csv")))
    assert sorted((r["jf"] is None, r["jf"]) for r in long.collect())[0] == (False, 2.5) and long.count() == 2
    (tmp_path / "gof.log").write_text("RECURRENT  Bogota 25 RF R2 0.5\n")
    assert tables.read_log(spark, str(tmp_path / "*.log"), ["t", "city", "scale", "model", "gof", "value"]).first()["city"] == "Bogota"
    t = tables.cached_table(spark.range(3), str(tmp_path / "c"))
    assert t.count() == 3 and tables.cached_table(spark.range(5), str(tmp_path / "c")).count() == 3
    assert tables.cached_table(spark.range(5), str(tmp_path / "c"), refresh=True).count() == 5
