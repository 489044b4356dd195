"""More registered queries, of the operators that catalog doesn't show."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import attribution, clusters, forests, graph, metrics, models, order, reshape, splits, temporal, tiles
from .catalog import FEATURES, node_tile, query, rounded, seg_tile, seg_value, walk
from .inputs import Inputs

_MD5 = "('0x' || substr(md5(row_id::varchar || ':42'), 1, 8))::bigint"


@query("select city as place, feature from importance")
def t5_t6_t19_columns(i: Inputs) -> DataFrame:
    d = reshape.drop_features(reshape.cols_like(i.importance(), "^(city|scale|feature)$"), ["scale"])
    return reshape.rename_features(d, {"city": "place"})


@query("select event_id, case feature when 'f1' then 'lanes' when 'f2' then 'nodes' else feature end as feature from importance")
def t19_rename_values(i: Inputs) -> DataFrame:
    return reshape.rename_features(i.importance(), {"f1": "lanes", "f2": "nodes"}, "feature").select("event_id", "feature")


@query("select row_id, y from matrix where y is not null")
def t11_no_missing_target(i: Inputs) -> DataFrame:
    return reshape.require_no_null(i.matrix(), "y").select("row_id", "y")


_KINDS = ["click", "purchase", "signup", "view", "error"]


@query("select nid, " + ", ".join(f"arg_min(jf, event_id) filter (where city='{c}') as {c}" for c in _KINDS) + " from jf group by 1")
def t17_pivot_first(i: Inputs) -> DataFrame:
    return reshape.pivot_first(i.jf(), ["nid"], "city", "jf", _KINDS, "event_id")


@query('select scale, "row", col, 0.0::double as jf from (select distinct scale, "row", col from seg_tile)')
def t24_zero_congestion(i: Inputs) -> DataFrame:
    return seg_tile(i).select(*tiles.KEY).distinct().withColumn("jf", F.lit(0.0))


@query(f"select row_id from matrix where {_MD5} < 100*1.33/(select count(*) from matrix)*4294967296.0")
def t25_subsample(i: Inputs) -> DataFrame:
    d = i.matrix()
    return splits.subsample(d, "row_id", 100, max(d.count(), 1)).select("row_id")


@query("select row_id, f0, y, row_number() over (order by md5(row_id::varchar || ':42'), row_id)-1 as place from matrix")
def t26_shuffle(i: Inputs) -> DataFrame:
    d = i.matrix().withColumn("h", F.md5(F.concat_ws(":", F.col("row_id").cast("string"), F.lit("42"))))
    return order.numbered(d, ["h", "row_id"], "place").select("row_id", "f0", "y", "place")


@query(f"select row_id, {_MD5} < 0.33*4294967296.0 as test from matrix")
def v2_hold_out(i: Inputs) -> DataFrame:
    return splits.hold_out(i.matrix(), "row_id").select("row_id", "test")


@query("select node_id, x, null::double as length from nodes union all select u, null, length from edges")
def s2_outer_union(i: Inputs) -> DataFrame:
    return i.nodes().select("node_id", "x").unionByName(i.edges().select(F.col("u").alias("node_id"), "length"), allowMissingColumns=True)


@query("select not exists (select u from edges except select node_id from nodes) as inside, not exists (select node_id from nodes except select u from edges) as covered")
def s5_subsets(i: Inputs) -> DataFrame:
    nodes, ends = i.nodes().select("node_id").distinct(), i.edges().select(F.col("u").alias("node_id")).distinct()
    none = lambda d, name: d.agg((F.count("*") == 0).alias(name))
    return none(ends.exceptAll(nodes), "inside").join(none(nodes.exceptAll(ends), "covered"))


@query("select city, round(avg(value),6) as mean, round(stddev_samp(value),6) as std, max(value) as max from importance group by 1")
def a22_city_importance(i: Inputs) -> DataFrame:
    return rounded(i.importance().groupBy("city").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.max("value").alias("max")))


@query("select city, round(corr(jf, ratio),6) as r, count(*) as n from (select j.city, j.jf, greatest(least(f.ff/nullif(s.sp,0),10.0),0.0) as ratio from (select *, row_number() over (partition by nid order by event_id)-1 as k from jf) j join (select nid, max(jf)+1 as ff from jf group by 1) f on f.nid=j.nid join (select nid, event_id, 600-jf as sp from jf) s on s.nid=j.nid and s.event_id=j.event_id where k%6=0) group by 1")
def j11_a31_jf_pearson(i: Inputs) -> DataFrame:
    d = temporal.every_nth(i.jf(), ["nid"], "event_id", 6)
    ff, sp = i.jf().groupBy("nid").agg((F.max("jf") + 1).alias("ff")), i.jf().select("nid", "event_id", (600 - F.col("jf")).alias("sp"))
    both = metrics.jf_against_ratio(d, ff, sp, ["event_id"])
    return rounded(both.groupBy("city").agg(F.corr("jf", "ratio").alias("r"), F.count("*").alias("n")))


@query("select j.event_id, j.jf, p.x1, p.y2 from jf j join (select nid, min(x1) as x1, min(y2) as y2 from pieces group by 1) p on p.nid=j.nid")
def j12_with_lines(i: Inputs) -> DataFrame:
    lines = i.pieces().groupBy("nid").agg(F.min("x1").alias("x1"), F.min("y2").alias("y2"))
    return i.jf().join(lines, "nid").drop("nid", "ts", "city")


@query("select highway, variable, round(sum(value),6) as total from (select highway, 'length' as variable, length as value from edges union all select highway, 'maxspeed', maxspeed from edges) group by 1,2")
def a38_melt_sum(i: Inputs) -> DataFrame:
    return rounded(i.edges().unpivot("highway", ["length", "maxspeed"], "variable", "value").groupBy("highway", "variable").agg(F.sum("value").alias("total")))


@query("select city, string_agg(feature, ',' order by feature) as features from (select distinct city, feature from importance) group by 1")
def a39_group_keys(i: Inputs) -> DataFrame:
    return i.importance().groupBy("city").agg(F.array_join(F.array_sort(F.collect_set("feature")), ",").alias("features"))


@query("select doc_id, n//4 as record, " + ", ".join(f"max(case when n%4={k} then line end) as f{k}" for k in range(4)) + " from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1)-1 as n from documents) group by 1,2")
def f8_records(i: Inputs) -> DataFrame:
    return T.records(T.lines(i.table("documents")))


@query("select * from (select doc_id, n as line_no, lag(line, 4) over w as before, lead(line, 1) over w as after1, lead(line, 2) over w as after2, line from (select doc_id, unnest(string_split(text, chr(10))) as line, cast(generate_subscripts(string_split(text, chr(10)), 1)-1 as integer) as n from documents) window w as (partition by doc_id order by n)) where contains(line, 'the')")
def w2_context(i: Inputs) -> DataFrame:
    return T.context(T.lines(i.table("documents")), F.col("line").contains("the"))


@query("select pos, round(avg(jf),6) as mean from (select jf, cast(row_number() over (partition by nid order by hour)-1 as integer) as pos from profile) where pos<12 group by 1")
def f16_f17_arrays(i: Inputs) -> DataFrame:
    p = temporal.recurrent(temporal.to_days(temporal.resample_mean(i.jf(), ["nid"], 2, ts=["ts", "event_id"]), ["nid"]), ["nid"])
    return rounded(reshape.mean_by_position(reshape.sorted_values(p, ["nid"], "hour", "jf"), 12))


@query("select city, feature, round(m,6) as mean_abs, cast(row_number() over (partition by city order by round(m,9) desc, feature) as integer) as place from (select city, feature, avg(abs(value)) as m from importance group by 1,2)")
def w11_a23_ranking(i: Inputs) -> DataFrame:
    return rounded(reshape.importance_ranking(i.importance(), ["city"]))


@query("select feature, round(avg(value) filter (where scale<60),6) as a, round(avg(value) filter (where scale>=60),6) as b from importance group by 1")
def j16_compare_shifts(i: Inputs) -> DataFrame:
    d = i.importance()
    return rounded(reshape.compare_shifts(d.where("scale < 60"), d.where("scale >= 60"), ["feature"]))


@query('select scale, "row", col, array_to_string(list_sort(list(distinct nid)), \',\') as segments from seg_tile group by 1,2,3')
def j2_segments_per_tile(i: Inputs) -> DataFrame:
    return tiles.segments_per_tile(seg_tile(i)).select(*tiles.KEY, F.array_join("segments", ",").alias("segments"))


@query("select node_id from nodes where x>=0.3-0.05 and x<0.5+0.05 and y>=0.2-0.1 and y<0.6+0.1")
def g14_near_box(i: Inputs) -> DataFrame:
    return tiles.near_box(i.nodes(), 0.3, 0.2, 0.5, 0.6).select("node_id")


@query("select min(x) as w, max(x) as e, min(y) as s, max(y) as n from nodes")
def g21_extent(i: Inputs) -> DataFrame:
    return tiles.extent(i.nodes())


_MICRO = lambda x: f"floor(({x})*1e6::double+0.5)/1e6::double"  # noqa: E731  the same in both engines, also where the seventh digit is a 5


@query(f'select scale, "row", col, nid, v, case when t0>0 and t1<1 then \'crossing\' when t0>0 then \'tail_out\' when t1<1 then \'head_out\' else \'inside\' end as kind, {_MICRO("x1+t0*(x2-x1)")} as xa, {_MICRO("y1+t0*(y2-y1)")} as ya, {_MICRO("x1+t1*(x2-x1)")} as xb, {_MICRO("y1+t1*(y2-y1)")} as yb, round(len,6) as len from seg_tile join pieces using (nid, v) where len>0')
def g18_clipped_edges(i: Inputs) -> DataFrame:
    ends = {c: F.floor(F.col(c) * 1e6 + 0.5) / 1e6 for c in ("xa", "ya", "xb", "yb")}
    return tiles.clip_edges(seg_tile(i)).drop("a", "b").withColumns({**ends, "len": F.round("len", 6)})


_CORNERS = "select (n_nationkey*37 % 100)/100.0::double as x, (n_nationkey*91 % 97)/97.0::double as y from nation"


@query(f"select * from (with v as (select distinct x, y from ({_CORNERS})), h as (select a.x as xa, a.y as ya, b.x as xb, b.y as yb from v a, v b, v c where a.x<>b.x or a.y<>b.y group by 1,2,3,4 having min((b.x-a.x)*(c.y-a.y)-(b.y-a.y)*(c.x-a.x))>=0) select node_id from nodes where (select min((xb-xa)*(y-ya)-(yb-ya)*(x-xa)) from h)>=0)")
def g20_inside_hull(i: Inputs) -> DataFrame:
    k = F.col("n_nationkey")
    corners = i.table("nation").select((k * 37 % 100 / 100.0).alias("x"), (k * 91 % 97 / 97.0).alias("y"))
    return tiles.inside_hull(i.nodes(), corners).select("node_id")


_RASTER = """select r, c, (arg_max(nid, nid*10000000+v) % 10)::double as value from (select nid, v, cast(floor(r1+(r2-r1)*i/greatest(k,1)+0.5) as bigint) as r, cast(floor(c1+(c2-c1)*i/greatest(k,1)+0.5) as bigint) as c
  from (select *, unnest(range(cast(k as bigint)+1)) as i from (select *, greatest(abs(r2-r1), abs(c2-c1)) as k from (select nid, v, floor(y1*99) as r1, floor(y2*99) as r2, floor(x1*99) as c1, floor(x2*99) as c2 from (select *, min(case when not (least(x1,x2,y1,y2)>0 and greatest(x1,x2,y1,y2)<1) then v end) over (partition by nid) as stop from pieces) where least(x1,x2,y1,y2)>0 and greatest(x1,x2,y1,y2)<1 and (stop is null or v<stop))))) group by 1,2"""


def raster(i: Inputs) -> DataFrame:
    return tiles.rasterize(i.pieces().withColumn("value", (F.col("nid") % 10).cast("double")), 100, "value", ["nid", "v"], ["nid"])


@query(_RASTER)
def g23_raster(i: Inputs) -> DataFrame:
    return raster(i)


@query(f"select sum(value) as total, count(*) as cells from ({_RASTER})")
def g24_raster_total(i: Inputs) -> DataFrame:
    return raster(i).agg(F.sum("value").alias("total"), F.count("*").alias("cells"))


@query('select t.scale, t."row", t.col, round(avg(d.n),6) as global_betweenness from node_tile t join (select node_id, count(*)::double as n from (select u as node_id from edges union all select v from edges) group by 1) d using (node_id) where t."row" is not null group by 1,2,3')
def j10_tile_centrality(i: Inputs) -> DataFrame:
    """The join, with the degree as centrality."""
    d = graph.degrees(i.edges(), []).select("node_id", F.col("degree").cast("double").alias("centrality"))
    return rounded(tiles.tile_centrality(node_tile(i).where("row is not null"), d))


@query()
def gf20_global_betweenness(i: Inputs) -> DataFrame:
    """Centrality in the whole graph of each city, then its mean over parts of the city."""
    d = graph.betweenness(walk(i), ["city"])
    parts = d.select("city", "node_id", (F.col("node_id") % 10).alias("part"))
    return rounded(parts.join(d, ["city", "node_id"]).groupBy("city", "part").agg(F.avg("centrality").alias("global_betweenness")))


@query("select highway, n, m, round(2.0*m/n,6) as k_avg, round(edge_length_total,6) as edge_length_total, round(streets_per_node_avg,6) as streets_per_node_avg, metered_count from (select highway, count(*) as m, sum(length) as edge_length_total from edges group by 1) a join (select highway, count(*) as n, avg(street_count) as streets_per_node_avg, count(*) filter (where tag='traffic_signals') as metered_count from (select highway, u as node_id from edges union select highway, v from edges) x join (select node_id, highway as tag, street_count from nodes) using (node_id) group by 1) b using (highway)")
def gf29_city_features(i: Inputs) -> DataFrame:
    e = i.edges().withColumnRenamed("highway", "city")
    f = graph.tile_features(e, i.nodes(), key=["city"])
    return rounded(f.select(F.col("city").alias("highway"), "n", "m", "k_avg", "edge_length_total", "streets_per_node_avg", "metered_count"))


@query("select round(avg(r2),6) as mean, round(stddev_pop(r2),6) as std, " + ", ".join(f"round(max(case when fold={k} then r2 end),6) as fold{k}" for k in range(3)) + " from (select fold, 1-avg((y-p)*(y-p))/var_pop(y) as r2 from (select row_id%3 as fold, y, 2*f0-f1 as p from matrix) group by 1)")
def m20_score_table(i: Inputs) -> DataFrame:
    d = i.matrix().withColumns({"fold": F.col("row_id") % 3, "p": 2 * F.col("f0") - F.col("f1")})
    return rounded(metrics.score_table(metrics.scores(d, ["fold"]), "fold", 3))


@query("select row_id, 'f0' as feature, round(avg((f0-a)*b),6) as value from matrix, (select k, avg(f0) as a, regr_slope(y, f0) as b from matrix, (select unnest([0,1,2]) as k) where row_id%3<>k group by 1) group by 1")
def m24_fold_attribution(i: Inputs) -> DataFrame:
    return rounded(models.fold_attribution(i.matrix().withColumn("fold", F.col("row_id") % 3), ["f0"]))


@query()
def m27_warping(i: Inputs) -> DataFrame:
    hours = i.jf().groupBy("city", F.hour("ts").alias("hour")).agg(F.avg("jf").alias("jf"))
    return rounded(clusters.warping_pairs(reshape.sorted_values(hours, ["city"], "hour", "jf"), "city"))


@query()
def m28_choose_k(i: Inputs) -> DataFrame:
    return rounded(models.choose_k(i.matrix(), FEATURES))


@query()
def m8_ridge_choice(i: Inputs) -> DataFrame:
    return rounded(models.ridge_choice(i.matrix(), FEATURES))


@query()
def m12_m13_search(i: Inputs) -> DataFrame:
    """All 28 settings of trees and depth; the random search draws 50, so as many as there are."""
    d = order.cut(splits.shuffled_folds(i.matrix(), "row_id", 3))
    grid = order.cut(forests.search(d, FEATURES))
    drawn = random.Random(42).sample([(t, k) for t in forests.TREES for k in forests.DEPTHS], min(50, len(forests.TREES) * len(forests.DEPTHS)))
    asked = i.spark.createDataFrame(drawn, "trees int, depth int")
    return rounded(grid.withColumn("kind", F.lit("grid")).unionByName(grid.join(asked, ["trees", "depth"]).withColumn("kind", F.lit("random"))))


@query()
def m10_m11_u3_boosted(i: Inputs) -> DataFrame:
    """Out-of-sample scores of the boosted trees named, fitted on the rows not held out."""
    d = splits.hold_out(i.matrix(), "row_id").withColumn("fold", F.col("test").cast("int"))
    out = None
    for name in ("GBM", "Additive"):
        m = models.MODELS[name]().setLabelCol("y").fit(models.assembled(d.where("fold = 0"), FEATURES))
        part = m.transform(models.assembled(d.where("fold = 1"), FEATURES)).select(F.lit(name).alias("model"), "y", F.col("prediction").alias("p"))
        out = part if out is None else out.unionByName(part)
    return rounded(metrics.scores(out, ["model"]))


@query()
def m23_m24_a23_w11_forest_attribution(i: Inputs) -> DataFrame:
    """The exact attribution of every row and feature, the mean over the forests of seven folds,
    with each feature's mean absolute one and its rank."""
    d = order.cut(splits.shuffled_folds(i.matrix(), "row_id", 7))
    found = order.cut(attribution.forest_attribution(d, attribution.fold_forests(d, FEATURES), FEATURES))
    return rounded(found.unpivot(["row_id", "base"], FEATURES, "feature", "value").join(attribution.mean_absolute(found, FEATURES), "feature"))


@query("select event_id, upper(city[1]) || city[2:] as title, replace(city, 'i', '_') as replaced, round_even(jf/4, 0) as half_even from (select event_id, city, floor(jf)::double as jf from jf)")
def f3_f11_title_and_half_even(i: Inputs) -> DataFrame:
    d = i.jf()
    return d.select("event_id", T.title(F.col("city")).alias("title"), F.replace("city", F.lit("i"), F.lit("_")).alias("replaced"), F.bround(F.floor("jf").cast("double") / 4, 0).alias("half_even"))


def importance_series(i: Inputs) -> DataFrame:
    """key (city and feature) and values, its mean importance over the scales, z-normalised."""
    mean = i.importance().groupBy(F.concat_ws("-", "city", "feature").alias("key"), "scale").agg(F.avg("value").alias("value")).where("value is not null")
    return reshape.sorted_values(reshape.z_normal(mean, ["key"], "value"), ["key"], "scale", "z")


@query()
def m26_m27_m29_m30_warped_clusters(i: Inputs) -> DataFrame:
    """Three clusters of the importance series by warping distance: size and median series."""
    s = order.cut(importance_series(i))
    found = clusters.medoids(clusters.both_ways(clusters.warping_pairs(s, "key")), 3)
    return clusters.medians(found, s, "key").select("medoid", "size", F.array_join(F.transform("medians", lambda x: F.round(x, 6).cast("string")), ",").alias("medians"))


@query()
def m28_warped_choice_of_k(i: Inputs) -> DataFrame:
    """Inertia and silhouette of 2 to 10 clusters by warping distance."""
    both, out = clusters.both_ways(clusters.warping_pairs(importance_series(i), "key")), None
    for k in range(2, 11):
        one = clusters.quality(both, clusters.medoids(both, k)).select(F.lit(k).alias("k"), "inertia", "silhouette")
        out = one if out is None else out.unionByName(one)
    return rounded(out)
