"""Joins of segments, nodes and edges with the tiles of a regular grid.

Tiles are integer keys (scale, row, col) of an extent (w, s, e, n), so every spatial join is
an equi-join or no join at all: a piece is dealt to the tiles of its span, and the exact
clip test decides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import once, part_between
from .order import cut

KEY = ["scale", "row", "col"]


def with_scales(df: DataFrame, scales: list[int]) -> DataFrame:
    return df.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales])))


def _span(low, high, scale):
    first = F.greatest(F.floor(low * scale - 1e-9), F.lit(0)).cast("int")
    last = F.least(F.floor(high * scale + 1e-9), scale - 1).cast("int")
    return F.when(first <= last, F.sequence(first, last))


def join_segments_tiles(pieces: DataFrame, scales: list[int]) -> DataFrame:
    """pieces(nid, x1, y1, x2, y2) in the unit square with each tile that they meet and the
    length inside it. Spans are closed: a touch counts, with length 0."""
    edge = lambda c, k: (F.col(c) + k).cast("double") / F.col("scale")
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    p = with_scales(pieces, scales)
    p = p.withColumn("row", F.explode(_span(F.least("y1", "y2"), F.greatest("y1", "y2"), F.col("scale"))))
    p = once(p, part_between(F.col("y1"), dy, edge("row", 0), edge("row", 1)), "_y0", "_ye").where("_y0 <= 1 and _ye >= 0 and _y0 <= _ye")
    # only the columns that the piece passes while it is in the row's band; a piece that is
    # nearly level stays in its band for all its columns
    at = lambda t: F.when(F.abs(dy) > 1e-6, F.col("x1") + dx * t)
    a, b = F.coalesce(at(F.greatest("_y0", F.lit(0.0))), F.col("x1")), F.coalesce(at(F.least("_ye", F.lit(1.0))), F.col("x2"))
    p = once(p, (F.least(a, b) - 1e-6, F.greatest(a, b) + 1e-6), "_a", "_b")
    p = p.withColumn("col", F.explode(_span(F.col("_a"), F.col("_b"), F.col("scale")))).drop("_a", "_b")
    x0, xe = part_between(F.col("x1"), dx, edge("col", 0), edge("col", 1))
    p = once(p, (F.greatest(F.lit(0.0), x0, F.col("_y0")), F.least(F.lit(1.0), xe, F.col("_ye"))), "t0", "t1").where("t0 <= t1").drop("_y0", "_ye")
    return p.withColumn("len", (F.col("t1") - F.col("t0")) * F.sqrt(F.pow(dx, 2) + F.pow(dy, 2)))


def clipped_length(joined: DataFrame) -> DataFrame:
    """Length of each segment inside each tile."""
    return joined.groupBy(*KEY, "nid").agg(F.sum("len").alias("len"))


def join_nodes_tiles(nodes: DataFrame, scales: list[int]) -> DataFrame:
    """Left join: the tile that holds a node strictly inside, else null."""
    n = with_scales(nodes, scales).withColumns({"row": F.floor(F.col("y") * F.col("scale")).cast("int"), "col": F.floor(F.col("x") * F.col("scale")).cast("int")})
    edge = lambda c, k: (F.col(c) + k).cast("double") / F.col("scale")
    ok = (F.col("x") > edge("col", 0)) & (F.col("x") < edge("col", 1)) & (F.col("y") > edge("row", 0)) & (F.col("y") < edge("row", 1)) & F.col("row").between(0, F.col("scale") - 1) & F.col("col").between(0, F.col("scale") - 1)
    return n.withColumns({"ok": ok}).withColumns({c: F.when(F.col("ok"), F.col(c)) for c in ("row", "col")}).drop("ok")


def tile_edges_out(node_tile: DataFrame, edges: DataFrame) -> DataFrame:
    """Out-edges of the nodes in each tile; of parallel ones that with the least key."""
    inside = node_tile.where("row is not null").select(*KEY, F.col("node_id").alias("u"))
    best = F.min_by(F.struct(*[c for c in edges.columns if c not in ("u", "v", "key")]), F.col("key"))
    # parallel edges are chosen among before each becomes a row for every tile of its node
    one = edges.groupBy("u", "v").agg(F.min("key").alias("key"), best.alias("e"))
    return inside.distinct().join(one, "u").select(*KEY, "u", "v", "key", "e.*")


def tile_edges_any(node_tile: DataFrame, edges: DataFrame, tasks: int | None = None) -> DataFrame:
    """Edges with either end in the tile; parallel ones stay. Each edge meets the tiles of both ends, one row a node,
    before it becomes a row for each different one, so no rows are compared after that. tasks: for the edges by v."""
    of = node_tile.where("row is not null").groupBy("node_id").agg(F.collect_set(F.struct(*KEY)).alias("_tiles"))
    at = lambda c: of.select(F.col("node_id").alias(c), F.col("_tiles").alias(f"_{c}"))
    e = edges.dropDuplicates(["u", "v", "key"]).join(at("u"), "u", "left")
    e = (e.repartition(tasks, "v") if tasks else e).join(at("v"), "v", "left")
    both = F.coalesce(F.array_union("_u", "_v"), F.col("_u"), F.col("_v"))
    return e.withColumn("_t", F.explode(both)).select("_t.*", *edges.columns)


def tile_edges_induced(node_tile: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges among the nodes in the tile and their successors."""
    inside = node_tile.where("row is not null").select(*KEY, F.col("node_id"))
    heads = inside.join(edges, inside["node_id"] == edges["u"]).select(*KEY, F.col("v").alias("node_id"))
    both = inside.unionByName(heads).distinct()
    out = both.withColumnRenamed("node_id", "u").join(edges, "u")
    return out.join(both.withColumnRenamed("node_id", "v"), [*KEY, "v"], "left_semi")


def tile_jf(seg_tile: DataFrame, values: DataFrame, value: str = "jf") -> DataFrame:
    """Congestion per tile: mean, max, spread and length-weighted mean of the segments' values.
    A segment without value counts in the weights only."""
    return valued_tile_jf(seg_tile.join(values.select("nid", value), "nid", "left"), value)


def valued_tile_jf(j: DataFrame, value: str = "jf") -> DataFrame:
    """tile_jf() of segments that had their values, or null, before they were joined with tiles."""
    top = F.sum(F.coalesce(F.col(value) * F.col("len"), F.lit(0.0)))
    return j.groupBy(*KEY).agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.stddev_pop(value).alias("variance"), F.try_divide(top, F.sum("len")).alias("length_weighted_mean"), F.count("*").alias("segments"))


def training_matrix(features: DataFrame, congestion: DataFrame) -> DataFrame:
    """Features and congestion of the tiles that have both."""
    return features.join(congestion, KEY)


def segments_per_tile(joined: DataFrame) -> DataFrame:
    """The sorted segments of each tile, as an array; for tiles of a map, which hold few. A segment's pieces in a tile
    become one first, where they are if they are dealt by segment: no sets of segments are kept and merged."""
    return joined.select(*KEY, "nid").distinct().groupBy(*KEY).agg(F.sort_array(F.collect_list("nid")).alias("segments"))


def clip_edges(joined: DataFrame) -> DataFrame:
    """Edges cut at their tile's border: kind (inside, tail_out, head_out, crossing) and ends
    (a, xa, ya) and (b, xb, yb). An end outside the tile gives way to a new node on the border,
    named by a hash; its street_count is 3 and its tag missing."""
    at = lambda t: (F.col("x1") + F.col(t) * (F.col("x2") - F.col("x1")), F.col("y1") + F.col(t) * (F.col("y2") - F.col("y1")))
    tail, head = F.col("t0") > 0, F.col("t1") < 1
    kind = F.when(tail & head, "crossing").when(tail, "tail_out").when(head, "head_out").otherwise("inside")
    new = lambda side: F.xxhash64(*KEY, "nid", "v", F.lit(side))
    (xa, ya), (xb, yb) = at("t0"), at("t1")
    return joined.where("len > 0").select(*KEY, "nid", "v", kind.alias("kind"), F.when(tail, new("a")).otherwise(F.col("nid")).alias("a"), F.when(head, new("b")).otherwise(F.col("v")).alias("b"), xa.alias("xa"), ya.alias("ya"), xb.alias("xb"), yb.alias("yb"), "len")


def synthetic_nodes(clipped: DataFrame) -> DataFrame:
    """The new nodes of clip_edges()."""
    ends = [clipped.where(F.col(c) != F.col(old)).select(F.col(c).alias("node_id"), F.col(f"x{c}").alias("x"), F.col(f"y{c}").alias("y")) for c, old in (("a", "nid"), ("b", "v"))]
    return ends[0].unionByName(ends[1]).distinct().withColumns({"street_count": F.lit(3), "highway": F.lit(None).cast("string")})


def near_box(nodes: DataFrame, w: float, s: float, e: float, n: float) -> DataFrame:
    """Nodes in the box widened by a quarter of its sides, upper borders excluded."""
    dx, dy = (e - w) / 4, (n - s) / 4
    return nodes.where((F.col("x") >= w - dx) & (F.col("x") < e + dx) & (F.col("y") >= s - dy) & (F.col("y") < n + dy))


def inside_hull(nodes: DataFrame, boundary: DataFrame) -> DataFrame:
    """Nodes inside the convex hull of the vertices boundary(x, y), a few dozen of them: a pair of
    vertices is an edge of the hull if no vertex lies to its right."""
    v = boundary.select("x", "y").distinct()
    as_ = lambda k: v.select(F.col("x").alias(f"x{k}"), F.col("y").alias(f"y{k}"))
    right = lambda x, y: (F.col("xb") - F.col("xa")) * (y - F.col("ya")) - (F.col("yb") - F.col("ya")) * (x - F.col("xa"))
    pairs = as_("a").crossJoin(as_("b")).where("xa <> xb or ya <> yb").crossJoin(as_("c"))
    edges = pairs.groupBy("xa", "ya", "xb", "yb").agg(F.min(right(F.col("xc"), F.col("yc"))).alias("m")).where("m >= 0").drop("m")
    hull = edges.agg(F.collect_list(F.struct("xa", "ya", "xb", "yb")).alias("_hull"))
    fits = F.forall("_hull", lambda h: (h["xb"] - h["xa"]) * (F.col("y") - h["ya"]) - (h["yb"] - h["ya"]) * (F.col("x") - h["xa"]) >= 0)
    return nodes.join(F.broadcast(hull)).where(fits).drop("_hull")


def extent(nodes: DataFrame) -> DataFrame:
    return nodes.agg(F.min("x").alias("w"), F.max("x").alias("e"), F.min("y").alias("s"), F.max("y").alias("n"))


def rasterize(pieces: DataFrame, size: int, value: str = "value", order: list[str] | None = None, part: list[str] | None = None) -> DataFrame:
    """r, c, value of the cells along each piece of the unit square, in equal steps of at most a
    cell; of several pieces in a cell the last by order wins. Pieces with an end outside go, and
    with part (the columns that name a part) so do the pieces of the part that come after one."""
    inside = lambda c: (F.col(c) > 0) & (F.col(c) < 1)
    cell = lambda c: F.floor(F.col(c) * (size - 1))
    fits = inside("x1") & inside("x2") & inside("y1") & inside("y2")
    if part:
        rest = F.struct(*(c for c in order or ["nid"] if c not in part))
        out = pieces.where(~fits).groupBy(*part).agg(F.min(rest).alias("_out"))
        pieces = pieces.join(out, part, "left").where(F.col("_out").isNull() | (rest < F.col("_out"))).drop("_out")
    d = pieces.where(fits).withColumns({"_r1": cell("y1"), "_r2": cell("y2"), "_c1": cell("x1"), "_c2": cell("x2")})
    d = d.withColumn("_k", F.greatest(F.abs(F.col("_r2") - F.col("_r1")), F.abs(F.col("_c2") - F.col("_c1"))))
    step = lambda a, b: F.floor(F.col(a) + (F.col(b) - F.col(a)) * F.col("_i") / F.greatest(F.col("_k"), F.lit(1)) + 0.5)
    cells = lambda d: d.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_k")))).withColumns({"r": step("_r1", "_r2"), "c": step("_c1", "_c2")})
    # a hash aggregate finds each cell's last by the first column of order, which mustn't be null;
    # only those pieces meet the whole order, whose aggregate sorts its rows
    first, *_ = order = order or ["nid"]
    top = cut(cells(d).groupBy("r", "c").agg(F.max(first).alias("_top")))
    some = cells(d.join(top.select(F.col("_top").alias(first)).distinct(), first, "left_semi"))
    return some.join(top, ["r", "c"]).where(F.col(first) == F.col("_top")).groupBy("r", "c").agg(F.max_by(value, F.struct(*order)).alias("value"))


def tile_centrality(node_tile: DataFrame, centrality: DataFrame, key: list[str] = KEY) -> DataFrame:
    """The mean of the whole graph's centrality over the nodes of each tile."""
    return node_tile.join(centrality.select("node_id", "centrality"), "node_id").groupBy(*key).agg(F.avg("centrality").alias("global_betweenness"))
