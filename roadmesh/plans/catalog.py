"""Registered queries over the given tables, with SQL for those that SQL can express.

A query's name starts with the numbers of the operators that it runs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import graph, grid, metrics, models, order, ranks, reshape, splits, temporal, tiles
from .inputs import Inputs, with_inputs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TIME = ["ts", "event_id"]
SCALES = [10, 20]
FEATURES = [f"f{i}" for i in range(14)]


def query(sql: str | None = None):
    def put(f: Callable[[Inputs], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Inputs(spark, sf_dir))
        if sql:
            ORACLES[f.__name__] = with_inputs(sql)
        return f

    return put


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles to so many decimals; counts as long."""
    kinds = dict(df.dtypes)
    return df.select([F.round(F.col(f"`{c}`"), digits).alias(c) if kinds[c] in ("double", "float") else F.col(f"`{c}`") for c in df.columns])


def days(i: Inputs) -> DataFrame:
    """A day is 24 samples of a segment."""
    return temporal.to_days(temporal.resample_mean(i.jf(), ["nid"], 1, ts=TIME), ["nid"])


def profile(i: Inputs) -> DataFrame:
    return temporal.recurrent(temporal.to_days(temporal.resample_mean(i.jf(), ["nid"], 2, ts=TIME), ["nid"]), ["nid"])


def seg_value(i: Inputs) -> DataFrame:
    return temporal.tod_agg(profile(i), ["nid"], [*range(1, 25)])


def seg_tile(i: Inputs) -> DataFrame:
    return tiles.join_segments_tiles(i.pieces(), SCALES)


def tile_jf(i: Inputs) -> DataFrame:
    """Segments get their values before they are joined with tiles."""
    return tiles.valued_tile_jf(tiles.join_segments_tiles(i.pieces().join(seg_value(i), "nid", "left"), SCALES))


def node_tile(i: Inputs) -> DataFrame:
    return tiles.join_nodes_tiles(i.nodes(), SCALES)


def tile_edges(i: Inputs) -> DataFrame:
    """Edges are dealt by u, which serves their groups and the join with tiles."""
    return tiles.tile_edges_out(node_tile(i).select(*tiles.KEY, "node_id"), i.edges(["u"]).select("u", "v", "key", "length", "lanes", "maxspeed"))


# Flagship: congestion per tile from raw series.


@query('select t.scale, t."row", t.col, round(avg(v.jf),6) as mean, round(max(v.jf),6) as max, round(stddev_pop(v.jf),6) as variance, round(sum(coalesce(v.jf*t.len,0))/nullif(sum(t.len),0),6) as length_weighted_mean, count(*) as segments from seg_tile t left join seg_value v on v.nid=t.nid group by 1,2,3')
def j1_j8_a9_a11_a14_tile_congestion(i: Inputs) -> DataFrame:
    return rounded(tile_jf(i))


# Time


@query("select event_id, ts, jf from jf where ts between timestamp '2024-01-05 05:00:00' and timestamp '2024-01-12 05:00:00'")
def t2_f10_local_range(i: Inputs) -> DataFrame:
    return temporal.filter_local_range(i.jf(), "2024-01-05 00:00:00", "2024-01-12 00:00:00", "America/Bogota").select("event_id", "ts", "jf")


@query("select nid, bin, round(jf,6) as jf from bins")
def w1_a1_resample(i: Inputs) -> DataFrame:
    return rounded(temporal.resample_mean(i.jf(), ["nid"], 6, ts=TIME))


@query("select city, date_trunc('hour', ts) as bin, round(avg(jf),6) as jf from jf group by 1,2")
def a1_resample_clock(i: Inputs) -> DataFrame:
    return rounded(temporal.resample_mean(i.jf(), ["city"], 6, clock="1 hour"))


@query("select nid, day, hour, round(jf,6) as jf from days")
def a2_days(i: Inputs) -> DataFrame:
    return rounded(days(i))


@query("select nid, hour, round(avg(jf),6) as jf from days group by 1,2")
def a3_a7_recurrent(i: Inputs) -> DataFrame:
    return rounded(temporal.CONGESTION["RECURRENT"](days(i), ["nid"]))


@query("select nid%5 as city, hour, round(avg(jf),6) as jf from days group by 1,2")
def a7_city_day(i: Inputs) -> DataFrame:
    """The average day of all segments of a city; a segment belongs to one of five by its number."""
    return rounded(temporal.city_day(days(i).withColumn("city", F.col("nid") % 5)))


@query("select nid, hour, round(max(jf)-median(jf),6) as jf from days group by 1,2")
def a4_u5_non_recurrent(i: Inputs) -> DataFrame:
    return rounded(temporal.CONGESTION["NON-RECURRENT"](days(i), ["nid"]))


@query("select nid, hour, round(avg(greatest(jf-m,0)),6) as jf from (select *, median(jf) over (partition by nid, hour) as m from days) group by 1,2")
def a5_non_recurrent_mmm(i: Inputs) -> DataFrame:
    return rounded(temporal.CONGESTION["NON-RECURRENT-MMM"](days(i), ["nid"]))


@query("select nid, hour, round(avg(jf),6) as mean, round(median(jf),6) as median, round(max(jf),6) as max from days group by 1,2")
def a6_day_curves(i: Inputs) -> DataFrame:
    return rounded(temporal.day_curves(days(i), ["nid"]))


@query("select nid, round(avg(jf),6) as jf from profile group by 1")
def a8_segment_mean(i: Inputs) -> DataFrame:
    return rounded(temporal.segment_mean(profile(i), ["nid"]))


@query("select nid, round(stddev_pop(jf),6) as jf from days where hour>=1 and hour<24 group by 1")
def a9_u2_tod_variance(i: Inputs) -> DataFrame:
    return rounded(temporal.tod_agg(days(i), ["nid"], [*range(1, 25)], "variance"))


@query("select nid, hour, round(jf,6) as jf from profile where hour=8")
def a10_tod_pick(i: Inputs) -> DataFrame:
    return rounded(temporal.tod_pick(profile(i), 8))


@query("select count(*) as series, count(distinct n)<=1 as equal from (select nid, hour, count(*) as n from days group by 1,2)")
def t12_equal_length(i: Inputs) -> DataFrame:
    return temporal.equal_length(days(i), ["nid", "hour"])


# Reshaping


@query("select nid, city, jf from (select nid, city, sum(jf) as jf from jf group by 1,2)")
def t1_t18_unpivot(i: Inputs) -> DataFrame:
    wide = i.jf().groupBy("nid").pivot("city", ["click", "error", "purchase", "signup", "view"]).agg(F.sum("jf"))
    return wide.unpivot("nid", wide.columns[1:], "city", "jf").where("jf is not null")


@query("select name as \"column\", round(p,6) as percent from (select 'city' as name, 100.0*avg(case when city is null then 1.0 else 0 end) as p from importance union all select 'scale', 100.0*avg(case when scale is null then 1.0 else 0 end) from importance union all select 'feature', 100.0*avg(case when feature is null then 1.0 else 0 end) from importance union all select 'value', 100.0*avg(case when value is null then 1.0 else 0 end) from importance)")
def t13_null_profile(i: Inputs) -> DataFrame:
    return rounded(reshape.null_profile(i.importance().drop("event_id")))


@query("select city, scale, feature, event_id from importance")
def t4_t7_columns(i: Inputs) -> DataFrame:
    return reshape.drop_null_columns(reshape.select_features(i.importance(), ["city", "scale", "feature", "value", "event_id", "absent"]))


@query("select event_id, value, greatest(least(value, 10.0), 0.0) as clipped, value / nullif(scale-20,0) as ratio, coalesce(value, 0) as filled from importance where city='click'")
def t3_t8_t14_t15_expressions(i: Inputs) -> DataFrame:
    d = i.importance().where(F.col("city") == "click")
    return d.select("event_id", "value", reshape.clip(F.col("value"), 0.0, 10.0).alias("clipped"), F.try_divide(F.col("value"), F.col("scale") - 20).alias("ratio"), F.coalesce("value", F.lit(0.0)).alias("filled"))


@query("select feature, " + ", ".join(f'round(avg(value) filter (where scale={s}),6) as "{s}"' for s in range(20, 100, 10)) + " from importance group by 1")
def t16_pivot_mean(i: Inputs) -> DataFrame:
    return rounded(reshape.pivot_mean(i.importance(), ["feature"], "scale", "value", list(range(20, 100, 10))))


@query("with t as (select feature, city, quantile_cont(value, 0.75) as threshold from importance group by 1,2) select i.event_id, case when value >= threshold then value end as value from importance i join t on t.feature=i.feature and t.city=i.city".replace("with t as (", "select * from (with t as (") + ")")
def t21_a18_threshold_mask(i: Inputs) -> DataFrame:
    return reshape.threshold_mask(i.importance(), ["feature", "city"], "quantile").select("event_id", "value")


@query("select city, round(avg(value)+stddev_samp(value),6) as threshold from importance group by 1")
def a18_threshold_mean_std(i: Inputs) -> DataFrame:
    return rounded(reshape.feature_threshold(i.importance(), ["city"], "mean+std"))


@query("select event_id, case when value>=0 then value end as value from importance")
def a18_threshold_zero(i: Inputs) -> DataFrame:
    return reshape.threshold_mask(i.importance(), ["feature"], "zero").select("event_id", "value")


@query("select city, min(value) as threshold from (select city, value, row_number() over (partition by city order by value desc nulls last) as r from importance) where r<=5 group by 1")
def a18_threshold_fifth(i: Inputs) -> DataFrame:
    return reshape.feature_threshold(i.importance(), ["city"], "fifth")


@query("select feature, city, count(*) as missing from importance where value is null group by 1,2 having count(*)>=6")
def a20_missing_mask(i: Inputs) -> DataFrame:
    return reshape.city_missing_mask(i.importance())


@query("select a.city, a.scale, a.feature, a.event_id, case when m.f is null then a.value end as value from importance a left join (select feature as f, city as c, max(value) as v from importance where value>400 group by 1,2) m on m.f=a.feature and m.c=a.city")
def t20_mask_where(i: Inputs) -> DataFrame:
    d = i.importance()
    return reshape.mask_where(d, d.where("value > 400").select("feature", "city", "value"), ["feature", "city"])


@query("select distinct city, scale, round(power((case when city='Istanbul' then 75.0 else 50.0 end)/scale, 2),6) as area from importance where scale in (30, 50)")
def t22_t23_tile_area(i: Inputs) -> DataFrame:
    return rounded(i.importance().where(F.col("scale").isin(30, 50)).select("city", "scale", reshape.tile_area(F.col("city"), F.col("scale")).alias("area")).distinct())


# Windows and ranking


@query("select city, event_id, round((value-a)/s,6) as z from (select *, avg(value) over (partition by city) as a, stddev_pop(value) over (partition by city) as s from importance) where s>0")
def w5_z_normal(i: Inputs) -> DataFrame:
    return rounded(reshape.z_normal(i.importance(), ["city"], "value").select("city", "event_id", "z"))


@query("select city, event_id, round((value-a)/nullif(b-a,0),6) as scaled from (select *, min(value) over (partition by city) as a, max(value) over (partition by city) as b from importance)")
def w6_min_max(i: Inputs) -> DataFrame:
    return rounded(reshape.min_max(i.importance(), ["city"], "value").select("city", "event_id", "scaled"))


@query("select city, feature, round(mean,6) as mean, place from (select *, cast(row_number() over (partition by city order by round(abs(mean),9) desc, feature) as integer) as place from (select city, feature, avg(value) as mean from importance group by 1,2)) where place<=3")
def w9_top_features(i: Inputs) -> DataFrame:
    return rounded(reshape.top_features(i.importance(), ["city"]))


@query("select city, event_id, value, cast(up as integer) as up, cast(down as integer) as down from (select *, row_number() over (partition by city order by value, event_id) as up, row_number() over (partition by city order by value desc, event_id desc) as down from importance where value is not null) where up<=5 or down<=5")
def w7_w8_both_ends(i: Inputs) -> DataFrame:
    return reshape.both_ends(i.importance().dropna(subset=["value"]), ["city"], ["value", "event_id"]).select("city", "event_id", "value", "up", "down")


@query("select city, feature, case when p=8 then 1 else -1 end as sign from (select city, feature, sum(case when v>0 then 1 else 0 end) as p, sum(case when v<0 then 1 else 0 end) as q from (select city, feature, scale, avg(value)+case when feature<'f3' then 100 else 0 end as v from importance group by 1,2,3) group by 1,2) where p=8 or q=8")
def w10_f13_same_sign(i: Inputs) -> DataFrame:
    return reshape.same_sign(i.importance().groupBy("city", "feature", "scale").agg((F.avg("value") + F.when(F.col("feature") < "f3", 100).otherwise(0)).alias("value")), ["city", "feature"], 8)


@query("select nid, event_id, jf from (select *, row_number() over (partition by nid order by event_id desc) as r from jf) where r=1")
def w12_last_wins(i: Inputs) -> DataFrame:
    return reshape.last_wins(i.jf(), ["nid"], "event_id").select("nid", "event_id", "jf")


@query("select nid, round(difference,6) as difference, case r when 1 then 'Increasing' when 2 then 'Indeterminate' else 'Decreasing' end as label from (select *, row_number() over (order by difference, nid) as r from (select nid, max_by(jf, event_id) - min_by(jf, event_id) as difference from jf group by 1))")
def w14_w15_trend(i: Inputs) -> DataFrame:
    return rounded(reshape.trend_labels(reshape.first_last_difference(i.jf(), ["nid"], "event_id", "jf"), tie="nid"))


@query("select nid, event_id, round(avg(jf) over (partition by nid order by event_id rows between unbounded preceding and current row),9) as running, jf/max(jf) over (partition by city) as share from jf")
def w4_a40_running_mean(i: Inputs) -> DataFrame:
    w = W.partitionBy("nid").orderBy("event_id").rowsBetween(W.unboundedPreceding, 0)
    return i.jf().select("nid", "event_id", F.round(F.avg("jf").over(w), 9).alias("running"), (F.col("jf") / F.max("jf").over(W.partitionBy("city"))).alias("share"))


# Sets


@query("select node_id from nodes where node_id not in (select u from edges where lanes=1) intersect select v from edges")
def s3_s4_j14_sets(i: Inputs) -> DataFrame:
    one = i.edges().where("lanes = 1").select(F.col("u").alias("node_id"))
    return i.nodes().select("node_id").join(one, "node_id", "left_anti").intersect(i.edges().select(F.col("v").alias("node_id")))


@query("select node_id, count(*) as n from (select u as node_id from edges where lanes=1 union all select v from edges where lanes=2) where node_id in (select node_id from nodes where street_count>2) group by 1")
def s1_j13_union_and_members(i: Inputs) -> DataFrame:
    e = i.edges()
    both = e.where("lanes = 1").select(F.col("u").alias("node_id")).unionByName(e.where("lanes = 2").select(F.col("v").alias("node_id")))
    return both.join(i.nodes().where("street_count > 2"), "node_id", "left_semi").groupBy("node_id").agg(F.count("*").alias("n"))


# Text


@query("select doc_id, count(*) as lines, sum(length(line))::bigint as chars from (select doc_id, unnest(string_split(text, chr(10))) as line from documents) group by 1")
def f5_lines(i: Inputs) -> DataFrame:
    return T.lines(i.table("documents")).groupBy("doc_id").agg(F.count("*").alias("lines"), F.sum(F.length("line")).cast("long").alias("chars"))


@query("select event_id, regexp_replace(regexp_replace(lower(city || ' ' || feature || '--X'), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') as slug, case when length(scale::varchar)>=3 then scale::varchar else lpad(scale::varchar, 3, '0') end as scale3, split_part(city || '-' || feature, '-', 2) as part2, try_cast(substr(feature, 2) as double) as num, sign(value)::double as sign, abs(value) as abs, trunc(value)::integer as cut from importance where value is not null")
def f1_f2_f4_f12_f15_strings(i: Inputs) -> DataFrame:
    d = i.importance().where("value is not null")
    return d.select("event_id", T.slug(F.concat("city", F.lit(" "), "feature", F.lit("--X"))).alias("slug"), T.zero_fill(F.col("scale")).alias("scale3"), T.part(F.concat("city", F.lit("-"), "feature"), 2).alias("part2"), F.substring("feature", 2, 99).try_cast("double").alias("num"), F.signum("value").alias("sign"), F.abs("value").alias("abs"), F.col("value").cast("int").alias("cut"))


@query("select event_id, regexp_extract(props, 'k\"\\s*:\\s*([^\\s,}]+)', 1) as k, regexp_replace(replace(props, ',', ' '), ' +', ' ', 'g') as squeezed from events")
def f6_f7_key_value(i: Inputs) -> DataFrame:
    return i.table("events").select("event_id", T.after_colon(F.col("props"), 'k"').alias("k"), T.squeeze(F.col("props")).alias("squeezed"))


@query("select doc_id, count(*) as n from (select *, min(case when contains(line, 'the') then line_no end) over (partition by doc_id) as f from (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1)-1 as line_no from documents)) where line_no>=f group by 1")
def w13_from_marker(i: Inputs) -> DataFrame:
    return T.from_first_match(T.lines(i.table("documents")), F.col("line").contains("the")).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("select coalesce(a.nid, b.nid) as nid, coalesce(a.v, '-') as a, coalesce(b.v, '-') as b from (select nid, count(*)::varchar as v from jf where city='click' group by 1) a full join (select nid, count(*)::varchar as v from jf where city='view' and jf>50 group by 1) b on a.nid=b.nid")
def f9_merge_records(i: Inputs) -> DataFrame:
    n = lambda d: d.groupBy("nid").agg(F.count("*").alias("v"))
    return T.merge_records(n(i.jf().where("city = 'click'")), n(i.jf().where("city = 'view' and jf > 50")), ["nid"], "v")


# Geometry and tiles


@query("select nid, v, x1, y1, x2, y2, 0 as part, 0 as piece, round(sqrt(pow(x2-x1,2)+pow(y2-y1,2)),6) as length from pieces")
def g15_g16_wkt(i: Inputs) -> DataFrame:
    ends = ["x1", "y1", "x2", "y2"]
    wkt = F.format_string("MULTILINESTRING Z ((%s %s 0, %s %s 0))", *[F.col(c).cast("string") for c in ends])
    d = T.explode_wkt(i.pieces().select("nid", "v", wkt.alias("wkt"))).drop("wkt")
    length = F.round(F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2)), 6)
    return d.select("nid", "v", *ends, "part", "piece", length.alias("length"))


@query('select scale, "row", col, nid, round(sum(len),6) as len from seg_tile group by 1,2,3,4')
def j1_g17_g19_clipped_length(i: Inputs) -> DataFrame:
    return rounded(tiles.clipped_length(seg_tile(i)))


@query('select node_id, scale, coalesce("row", -1) as "row", coalesce(col, -1) as col from node_tile')
def j3_g13_nodes_tiles(i: Inputs) -> DataFrame:
    return node_tile(i).select("node_id", "scale", "row", "col").fillna(-1, ["row", "col"])


@query('select scale, "row", col, u, v, key from tile_edges')
def j4_tile_edges_out(i: Inputs) -> DataFrame:
    return tile_edges(i).select(*tiles.KEY, "u", "v", "key")


@query('select distinct t.scale, t."row", t.col, e.u, e.v, e.key from node_tile t join edges e on t.node_id=e.u or t.node_id=e.v where t."row" is not null')
def j5_j7_tile_edges_any(i: Inputs) -> DataFrame:
    return tiles.tile_edges_any(node_tile(i).select(*tiles.KEY, "node_id"), i.edges(["u"]).select("u", "v", "key"), i.deals())


_INSIDE_AND_HEADS = '(select scale, "row", col, node_id from node_tile where "row" is not null union select t.scale, t."row", t.col, e.v from node_tile t join edges e on e.u=t.node_id where t."row" is not null)'


@query(f'select a.scale, a."row", a.col, count(*) as m from {_INSIDE_AND_HEADS} a join edges e on e.u=a.node_id join {_INSIDE_AND_HEADS} b on b.scale=a.scale and b."row"=a."row" and b.col=a.col and b.node_id=e.v group by 1,2,3')
def j6_tile_edges_induced(i: Inputs) -> DataFrame:
    e = tiles.tile_edges_induced(node_tile(i).select(*tiles.KEY, "node_id"), i.edges().select("u", "v", "key"))
    return e.groupBy(*tiles.KEY).agg(F.count("*").alias("m"))


_PER_NODE = [f"streets_per_node_{kind}_{k}" for k in range(1, 7) for kind in ("count", "proportion")]
counts = ", ".join(f"round({c},6) as {c}" if "proportion" in c else c for c in _PER_NODE)
filters = ", ".join(f"count(*) filter (where street_count={k}) as streets_per_node_count_{k}, count(*) filter (where street_count={k})::double/count(*) as streets_per_node_proportion_{k}" for k in range(1, 7))
_FEATURES_SQL = f"""
select a.scale, a."row", a.col, n, m, round(2.0*m/n,6) as k_avg, round(edge_length_total,6) as edge_length_total, round(street_length_total,6) as street_length_total,
  street_segment_count, round(circuity_avg,6) as circuity_avg, round(self_loop_proportion,6) as self_loop_proportion, round(streets_per_node_avg,6) as streets_per_node_avg,
  metered_count, non_metered_count, round(mean_lanes,6) as mean_lanes, round(maxspeed,6) as maxspeed, round(edge_length_total/m,6) as edge_length_avg, round(street_length_total/street_segment_count,6) as street_length_avg,
  metered_count+non_metered_count as total_crossings, round(mean_lanes,6) as lane_density, {counts}
from (select scale, "row", col, count(*) as m, sum(length) as edge_length_total, avg(case when u=v then 1.0 else 0.0 end) as self_loop_proportion, coalesce(count(lanes)::double/nullif(count(distinct lanes),0), 2) as mean_lanes, count(maxspeed)::double/nullif(count(distinct maxspeed),0) as maxspeed from tile_edges group by 1,2,3) a
join (select scale, "row", col, count(*) as n, avg(street_count) as streets_per_node_avg, count(*) filter (where highway='traffic_signals') as metered_count, count(*) filter (where highway='crossing') as non_metered_count,
        {filters}
      from (select scale, "row", col, u as node_id from tile_edges union select scale, "row", col, v from tile_edges) x join nodes using (node_id) group by 1,2,3) b on a.scale=b.scale and a."row"=b."row" and a.col=b.col
join (select t.scale, t."row", t.col, count(*) as street_segment_count, sum(length) as street_length_total, sum(length)/nullif(sum(sqrt(pow(p.x-q.x,2)+pow(p.y-q.y,2))),0) as circuity_avg
      from (select distinct scale, "row", col, least(u,v) as a, greatest(u,v) as b, length from tile_edges) t join nodes p on p.node_id=t.a join nodes q on q.node_id=t.b group by 1,2,3) c on a.scale=c.scale and a."row"=c."row" and a.col=c.col"""
_FEATURE_COLS = [*tiles.KEY, "edge_length_avg", "street_length_avg", "total_crossings", "lane_density", *_PER_NODE, "n", "m", "k_avg", "edge_length_total", "street_length_total", "street_segment_count", "circuity_avg", "self_loop_proportion", "streets_per_node_avg", "metered_count", "non_metered_count", "mean_lanes", "maxspeed"]


@query(_FEATURES_SQL)
def gf2_gf23_gf28_tile_features(i: Inputs) -> DataFrame:
    return rounded(graph.tile_features(tile_edges(i), i.nodes()).select(_FEATURE_COLS))


@query('select a.scale, a."row", a.col, m, round(j.jf,6) as jf from (select scale, "row", col, count(*) as m from tile_edges group by 1,2,3) a join (select t.scale, t."row", t.col, avg(v.jf) as jf from seg_tile t join seg_value v on v.nid=t.nid group by 1,2,3) j on a.scale=j.scale and a."row"=j."row" and a.col=j.col')
def j9_t10_training_matrix(i: Inputs) -> DataFrame:
    f = tile_edges(i).groupBy(*tiles.KEY).agg(F.count("*").alias("m"))
    jf = tile_jf(i).where("mean is not null").select(*tiles.KEY, F.col("mean").alias("jf"))
    return rounded(tiles.training_matrix(f, jf))


@query("select highway, degree, count(*) as nodes from (select highway, node_id, count(*) as degree from (select highway, u as node_id from edges union all select highway, v from edges) group by 1,2) group by 1,2")
def gf27_a37_degrees(i: Inputs) -> DataFrame:
    return graph.degree_distribution(i.edges(), ["highway"])


@query("select highway, round(sum(h)/count(*),6) as m_per_n, round(avg(k),6) as neighbours from (select highway, a, count(distinct b) as k, count(*)/2.0 as h from (select highway, u as a, v as b from edges union all select highway, v, u from edges) group by 1,2) group by 1")
def gf30_neighbours(i: Inputs) -> DataFrame:
    return rounded(graph.neighbour_average(i.edges(["u"]), ["highway"], i.deals()))


@query("select u, v, key, round(coalesce(k, c, a),6) as speed_kph, round(length/(coalesce(k, c, a)/3.6),6) as travel_time from (select *, avg(k) over (partition by highway) as c, avg(k) over () as a from (select *, case when lanes<>3 then (lanes*10)::double end as k from edges))")
def gf24_gf25_speeds(i: Inputs) -> DataFrame:
    e = i.edges().withColumn("maxspeed", F.when(F.col("lanes") != 3, (F.col("lanes") * 10).cast("string")))
    return rounded(graph.edge_speeds(e).select("u", "v", "key", "speed_kph", "travel_time"))


def walk(i: Inputs) -> DataFrame:
    """Edges between the values of consecutive events of a city."""
    w = W.partitionBy("city").orderBy("event_id")
    v = F.floor(F.col("jf")).cast("long")
    return i.jf().select("city", v.alias("u"), F.lead(v).over(w).alias("v"), F.col("jf").alias("length")).where("v is not null")


@query("select city, component, node_id, size from (with recursive b as (select distinct city, u as a, v as b from walk union select distinct city, v, u from walk), r(city, a, z) as (select city, a, a from b union select r.city, r.a, b.b from r join b on b.city=r.city and b.a=r.z), c as (select city, a as node_id, min(z) as component from r group by 1,2), s as (select city, component, count(*) as size, row_number() over (partition by city order by count(*) desc, component) as k from c group by 1,2) select c.city, c.component, c.node_id, s.size from c join s on s.city=c.city and s.component=c.component and k=1)")
def gf26_components(i: Inputs) -> DataFrame:
    return graph.largest_component(walk(i), ["city"])


@query()
def gf18_gf19_betweenness(i: Inputs) -> DataFrame:
    return rounded(graph.betweenness(walk(i), ["city"]))


@query()
def gf1_contraction(i: Inputs) -> DataFrame:
    return graph.contract_chains(walk(i), ["city"])


def boxes(i: Inputs) -> DataFrame:
    """A box about every customer: the given tables' rows placed over three city extents."""
    at = F.col("c_custkey")
    return i.table("customer").select(at.alias("id"), ((at * 37 % 1200) / 10.0 - 60).alias("lat"), ((at * 91 % 3400) / 10.0 - 170).alias("lon"), (8 + at % 5).cast("int").alias("scale"), (at % 9).cast("int").alias("code"))


def dealt_boxes(i: Inputs, rows: int = 10_000) -> DataFrame:
    """boxes() in tasks of so many, for those that become a row for every tile: few files hold all customers."""
    b = boxes(i)
    return b.repartition(1 + b.count() // rows, "id")


_BOX_SQL = "(select c_custkey as id, (c_custkey*37 % 1200)/10.0::double - 60 as lat, (c_custkey*91 % 3400)/10.0::double - 170 as lon, cast(8+c_custkey%5 as integer) as scale, cast(c_custkey%9 as integer) as code from customer)"


def _dest(lat: str, lon: str, d: str, t: str) -> tuple[str, str]:
    """Latitude and longitude d radians away from a point, at a bearing of t degrees, as SQL."""
    out = f"asin(sin(radians({lat}))*cos({d})+cos(radians({lat}))*sin({d})*cos(radians({t})))"
    return f"degrees({out})", f"degrees(radians({lon})+atan2(sin(radians({t}))*sin({d})*cos(radians({lat})), cos({d})-sin(radians({lat}))*sin({out})))"


def _km(a: str, b: str, c: str, d: str) -> str:
    """Great-circle distance of the points (a, b) and (c, d), as SQL."""
    return f"2*6371.0*asin(sqrt(pow(sin((radians({c})-radians({a}))/2),2)+cos(radians({a}))*cos(radians({c}))*pow(sin(radians({d}-({b}))/2),2)))"


_HALF = "(50/sqrt(2.0::double))/6371.0"
_SQUARE_SQL = "(select *, " + ", ".join(f"{sql} as {c}" for c, sql in zip("nesw", [*_dest("lat", "lon", _HALF, "45.0"), *_dest("lat", "lon", _HALF, "225.0")])) + f" from {_BOX_SQL})"


@query(f"select id, round(n,6) as n, round(e,6) as e, round(s,6) as s, round(w,6) as w from {_SQUARE_SQL}")
def g3_g4_square_box(i: Inputs) -> DataFrame:
    return rounded(grid.square_box(boxes(i), 50.0).select("id", "n", "e", "s", "w"))


@query(f"select id, count(*) as tiles from (select id, unnest(range(cast(floor(1.0/(0.5::double/scale)+1e-9) as integer))) as r, scale from {_BOX_SQL}) x, (select unnest(range(40)) as c) y where c < floor(0.8::double/(0.5::double/scale)+1e-9) group by 1")
def g9_a15_make_grid(i: Inputs) -> DataFrame:
    b = dealt_boxes(i).withColumns({"n": F.lit(1.0), "s": F.lit(0.0), "e": F.lit(0.8), "w": F.lit(0.0), "dy": F.lit(0.5) / F.col("scale"), "dx": F.lit(0.5) / F.col("scale")})
    return grid.make_grid(b).groupBy("id").agg(F.count("*").alias("tiles"))


@query(f"select id, r.r as \"row\", c.c as col, round(lat+r.r*(3.0::double/111.0),6) as tile_s, round(lon+(c.c+1)*(3.0::double/111.0),6) as tile_e from {_BOX_SQL}, (select cast(unnest(range(9)) as integer) as r) r, (select cast(unnest(range(18)) as integer) as c) c where r < floor(0.25::double/(3.0::double/111.0)+1e-9) and c < floor(0.5::double/(3.0::double/111.0)+1e-9)")
def g10_grid_in_degrees(i: Inputs) -> DataFrame:
    b = dealt_boxes(i).withColumns({"n": F.col("lat") + 0.25, "s": F.col("lat"), "e": F.col("lon") + 0.5, "w": F.col("lon")})
    return rounded(grid.make_grid_deg(b, 3.0).select("id", "row", "col", "tile_s", "tile_e"))


@query(f"select id, round(lat+degrees(10.0::double/6371.0),6) as n, round(lon+degrees(10.0::double/(6371.0*cos(radians(lat)))),6) as e from {_BOX_SQL}")
def g11_box_around(i: Inputs) -> DataFrame:
    return rounded(grid.box_around(boxes(i), 10.0).select("id", "n", "e"))


_SIDES = f"({_km('s', 'w', 's', 'e')}+{_km('n', 'w', 'n', 'e')})/2", _km("s", "w", "n", "w")


@query(f"select id, round((n+s)/2,6) as lat, round((e+w)/2,6) as lon, round({_km('s', 'w', 'n', 'e')},6) as diagonal, round({_SIDES[0]},6) as x_km, round({_SIDES[1]},6) as y_km, round(({_SIDES[0]})*({_SIDES[1]}),4) as area_km2 from {_SQUARE_SQL}")
def g1_g2_g25_box_facts(i: Inputs) -> DataFrame:
    d = grid.box_sides(grid.bbox_center(grid.square_box(boxes(i), 50.0))).withColumn("diagonal", grid.haversine_km(F.col("s"), F.col("w"), F.col("n"), F.col("e")))
    return rounded(d.select("id", "lat", "lon", "diagonal", "x_km", "y_km", F.round("area_km2", 4).alias("area_km2")))


_SHIFT = "case when code=0 then 0.0::double when code<5 then 2.0::double/3 else 2.0::double/7 end/6371.0"
_BEARING = "case when code=0 then 0.0::double else [0.0::double,180.0,90.0,270.0][(code-1)%4+1] end"
_MOVED = _dest("clat", "clon", f"({_SHIFT})", f"({_BEARING})")
_SHRUNK_SQL = f"""(select id, scale, y+(n-s)*0.4 as n, y-(n-s)*0.4 as s, x+(e-w)*0.4 as e, x-(e-w)*0.4 as w
  from (select *, {_MOVED[0]} as y, {_MOVED[1]} as x from (select *, (n+s)/2 as clat, (e+w)/2 as clon from {_SQUARE_SQL})))"""


@query(f"select id, round(n,6) as n, round(e,6) as e, round(s,6) as s, round(w,6) as w, round((n-s)/scale,6) as dy, round((e-w)/scale*(({_SIDES[1]})/({_SIDES[0]})),6) as dx, abs({_km('s', 'w', 'n', 'e')}/sqrt(2.0::double)-40.0) <= 0.8 as fits from {_SHRUNK_SQL}")
def g5_g6_g7_g8_boxes(i: Inputs) -> DataFrame:
    d = grid.shift_box(grid.square_box(boxes(i), 50.0))
    return rounded(grid.resize_check(grid.grid_deltas(grid.shrink_box(d, 80.0)), 40.0).select("id", "n", "e", "s", "w", "dy", "dx", "fits"))


@query(f"select id, w<=60 and -60<=e and s<=30 and -10<=n as meets from {_SQUARE_SQL}")
def g12_box_overlap(i: Inputs) -> DataFrame:
    d = grid.square_box(boxes(i), 50.0)
    return d.select("id", grid.boxes_intersect(F.col("w"), F.col("s"), F.col("e"), F.col("n"), *[F.lit(x) for x in (-60.0, -10.0, 60.0, 30.0)]).alias("meets"))


@query('select r, c, count(*) as n from (select cast(trunc(y*499) as integer) as r, cast(trunc(x*499) as integer) as c from nodes where x>0 and x<1 and y>0 and y<1) group by 1,2')
def g22_g24_raster(i: Inputs) -> DataFrame:
    d = grid.to_cell(i.nodes().select(F.col("y").alias("lat"), F.col("x").alias("lon")), 1.0, 1.0, 0.0, 0.0, 500)
    return d.where("inside").groupBy("r", "c").agg(F.count("*").alias("n"))


# Distributions and scores


_PAIRS = [(a, b) for k, a in enumerate(FEATURES) for b in FEATURES[k:]]


def _matrix_sql(table: str) -> str:
    """The correlations of all pairs of columns of table, long."""
    wide = ", ".join(f"corr({a}, {b}) as {a}_{b}" for a, b in _PAIRS)
    return f"select split_part(pair, '_', 1) as a, split_part(pair, '_', 2) as b, round(r,6) as r from (unpivot (select {wide} from {table}) on columns(*) into name pair value r)"


@query(_matrix_sql("matrix"))
def a28_corr(i: Inputs) -> DataFrame:
    return rounded(metrics.corr_matrix(i.matrix(), FEATURES))


@query(_matrix_sql("(select " + ", ".join(f"rank() over (order by {c}) + (count(*) over (partition by {c})-1)/2.0 as {c}" for c in FEATURES) + " from matrix)"))
def a29_w3_spearman(i: Inputs) -> DataFrame:
    return rounded(metrics.corr_matrix(i.matrix(), FEATURES, "spearman"))


def steps(i: Inputs) -> DataFrame:
    """The matrix's features: those with even numbers in steps of a twentieth, so that values tie."""
    return i.matrix().select("row_id", *((F.floor(F.col(c) * 20) if k % 2 == 0 else F.col(c)).alias(c) for k, c in enumerate(FEATURES)))


_STEPS_SQL = "(select " + ", ".join(f"floor({c}*20) as {c}" if k % 2 == 0 else c for k, c in enumerate(FEATURES)) + ", row_id from matrix)"
_SIGNS = ", ".join(f"sum(sign(p.{a}-q.{a})*sign(p.{b}-q.{b}))/sqrt(sum(abs(sign(p.{a}-q.{a})))*sum(abs(sign(p.{b}-q.{b})))) as {a}_{b}" for a, b in _PAIRS if a != b)


@query(f"select split_part(pair, '_', 1) as a, split_part(pair, '_', 2) as b, round(tau,6) as tau from (unpivot (select {_SIGNS} from {_STEPS_SQL} p join {_STEPS_SQL} q on p.row_id<q.row_id) on columns(*) into name pair value tau)")
def a30_kendall(i: Inputs) -> DataFrame:
    return rounded(ranks.kendall(steps(i), FEATURES))


@query("select city, least(cast(floor(jf/10.0::double) as bigint), 49) as bin, count(*) as n from jf where jf between 0 and 500 group by 1,2")
def a26_histogram(i: Inputs) -> DataFrame:
    return metrics.histogram(i.jf(), "jf", 50, 0.0, 500.0, ["city"])


@query("select cast(floor(jf/45/0.3::double) as bigint) as bin, count(*) as n from jf where floor(jf/45/0.3::double)<36 and jf>=0 group by 1")
def a27_histogram_step(i: Inputs) -> DataFrame:
    """The stand-in runs to 490; over 45 it covers the range of jam factors."""
    return metrics.histogram_step(i.jf().withColumn("jf", F.col("jf") / 45), "jf")


@query("select a.city as a, b.city as b, round(sum(abs(f)*(nx-x)),6) as distance from (select distinct city from jf) a join (select distinct city from jf) b on a.city<b.city join lateral (select x, sum(d) over (order by x) as f, lead(x) over (order by x) as nx from (select jf as x, sum(case when city=a.city then 1.0::double/(select count(*) from jf j where j.city=a.city) else -1.0::double/(select count(*) from jf j where j.city=b.city) end) as d from jf where city in (a.city, b.city) group by 1)) on true group by 1,2")
def a33_wasserstein(i: Inputs) -> DataFrame:
    return rounded(ranks.wasserstein(i.jf(), "city", "jf"))


@query("select x.city as a, y.city as b, round(sqrt(greatest(sum((case when p>0 then p*ln(p/((p+q)/2)) else 0 end)+(case when q>0 then q*ln(q/((p+q)/2)) else 0 end))/2,0)),6) as distance from (select distinct city from jf) x join (select distinct city from jf) y on x.city<y.city join (select c.city as c1, d.city as c2, b.bin, coalesce((select count(*) from jf where city=c.city and least(floor(jf/10.0::double),49)=b.bin),0)::double/(select count(*) from jf where city=c.city) as p, coalesce((select count(*) from jf where city=d.city and least(floor(jf/10.0::double),49)=b.bin),0)::double/(select count(*) from jf where city=d.city) as q from (select distinct city from jf) c, (select distinct city from jf) d, (select unnest(range(50)) as bin) b where c.city<d.city) z on z.c1=x.city and z.c2=y.city group by 1,2")
def a34_js_distance(i: Inputs) -> DataFrame:
    return rounded(metrics.js_distance(i.jf(), "city", "jf", 50, 0.0, 500.0))


_MOMENTS = ", ".join([f"covar_samp({a}, {b}){'+0.001' if a == b else ''} as {a}_{b}" for a, b in _PAIRS] + [f"avg({a}) as {a}_" for a in FEATURES])


@query(f"select city, split_part(pair, '_', 1) as a, split_part(pair, '_', 2) as b, round(value,6) as value from (unpivot (select city, {_MOMENTS} from matrix group by city) on columns(* exclude (city)) into name pair value value)")
def a35_moments(i: Inputs) -> DataFrame:
    return rounded(metrics.moments(i.matrix(), ["city"], FEATURES, epsilon=0.001))


@query("select city, round(1-sum((y-p)*(y-p))/sum((y-m)*(y-m)),6) as r2, round(avg((y-p)*(y-p)),6) as mse, round(1-var_pop(y-p)/var_pop(y),6) as explained from (select *, 2*f0-f1 as p, avg(y) over (partition by city) as m from matrix) group by 1")
def m15_m16_m17_scores(i: Inputs) -> DataFrame:
    return rounded(metrics.scores(i.matrix().withColumn("p", 2 * F.col("f0") - F.col("f1")), ["city"]))


@query("with d as (select trunc(jf/50)::integer as a, trunc((jf+(event_id%7)*20)/50)::integer as p from jf), l as (select x, row_number() over (order by x) as k from (select a as x from d union select p from d)), o as (select sum(pow(i.k-j.k,2)) as wo from d join l i on i.x=d.a join l j on j.x=d.p), e as (select sum(r.n*c.n*pow(i.k-j.k,2))/(select count(*) from d) as we from (select a, count(*) as n from d group by 1) r cross join (select p, count(*) as n from d group by 1) c join l i on i.x=r.a join l j on j.x=c.p) select round(1-wo/we,6) as kappa from o, e".replace("with d as (", "select * from (with d as (") + ")")
def m18_u4_kappa(i: Inputs) -> DataFrame:
    return rounded(metrics.weighted_kappa(i.jf().select((F.col("jf") / 50).alias("a"), ((F.col("jf") + F.col("event_id") % 7 * 20) / 50).alias("p"))))


@query("select feature, round(case when num is null then 0.0 else num/nullif(den,0) end,6) as ratio, round(coalesce(num,0),6) as num, round(coalesce(den,0),6) as den from (select feature, avg(case when value>0 then value end)-avg(case when value<0 then value end) as num, avg(case when value>0 then scale end)-avg(case when value<0 then scale end) as den from importance group by 1)")
def a25_sensitivity(i: Inputs) -> DataFrame:
    return rounded(metrics.sensitivity_ratio(i.importance(), ["feature"], "value", "scale"))


@query("select city, feature, round(avg(abs(value)),6) as mean_abs, round(avg(value),6) as mean, round(sum(value),6) as total, round(stddev_samp(value),6) as std, round(median(value),6) as median, max(value) as max from importance group by 1,2")
def a16_a17_a21_a24_importance_stats(i: Inputs) -> DataFrame:
    return rounded(i.importance().groupBy("city", "feature").agg(F.avg(F.abs("value")).alias("mean_abs"), F.avg("value").alias("mean"), F.sum("value").alias("total"), F.stddev_samp("value").alias("std"), F.median("value").alias("median"), F.max("value").alias("max")))


@query("select bin, (bin+1)*(500.0::double/256) as threshold from (select bin, round(c*(nc-c)*pow(m/c-(nm-m)/(nc-c),2),3) as v from (select bin, sum(n) over (order by bin)::double as c, sum(n*bin) over (order by bin)::double as m, sum(n) over ()::double as nc, sum(n*bin) over ()::double as nm from (select least(cast(floor(jf/(500.0::double/256)) as bigint),255) as bin, count(*) as n from jf where jf between 0 and 500 group by 1)) where c<nc) order by v desc, bin limit 1")
def a19_otsu(i: Inputs) -> DataFrame:
    return metrics.otsu(i.jf(), "jf", 256, 0.0, 500.0)


# Splits


@query("select row_id, (row_number() over (order by md5(row_id::varchar || ':42'), row_id)-1) % 7 as fold from matrix")
def v1_folds(i: Inputs) -> DataFrame:
    return splits.shuffled_folds(i.matrix(), "row_id").select("row_id", F.col("fold").cast("long").alias("fold"))


@query("select city, count(*) as test, (select count(*) from matrix)-count(*) as train from matrix group by 1 having count(*)>=5 and (select count(*) from matrix)-count(*)>=5")
def v6_v8_usable_folds(i: Inputs) -> DataFrame:
    return splits.usable_folds(i.matrix(), "city")


@query("select row_id, round((f0-(select avg(f0) from matrix b where b.city<>a.city))/(select stddev_pop(f0) from matrix b where b.city<>a.city),6) as f0 from matrix a")
def v7_m1_scale_on_train(i: Inputs) -> DataFrame:
    return rounded(splits.scale_on_train(i.matrix(), "city", ["f0"]).select("row_id", "f0"))


def _strip_sql(low: str, high: str, pick: str, n: int = 6) -> str:
    """The strip of each tile t: edges by their place among the distinct coordinates."""
    placed = f"select x, row_number() over (order by x)-1 as i, count(*) over () as l from (select {low} as x from t union select {high} from t)"
    edges = f"select x, row_number() over (order by x)-1 as k, lead(x) over (order by x) as y from ({placed}) where (i % greatest(l//{n},1)=0 and i<{n}*greatest(l//{n},1)) or i=l-1"
    return f'(select t.scale, t."row", t.col, {pick}(k) as strip from t join ({edges}) b on {low}>=x and {high}<=y group by 1,2,3)'


@query('select * from (with t as (select distinct scale, "row", col, col/scale::double as w, (col+1)/scale::double as e, "row"/scale::double as s, ("row"+1)/scale::double as n from seg_tile) select a.scale, a."row", a.col, a.strip as lon, b.strip as lat, a.strip*6+b.strip as block from ' + _strip_sql("w", "e", "max") + ' a join ' + _strip_sql("s", "n", "min") + ' b on a.scale=b.scale and a."row"=b."row" and a.col=b.col)')
def v3_v4_v5_blocks(i: Inputs) -> DataFrame:
    at = lambda c, k: ((F.col(c) + k) / F.col("scale"))
    t = seg_tile(i).select(*tiles.KEY).distinct().withColumns({"w": at("col", 0), "e": at("col", 1), "s": at("row", 0), "n": at("row", 1)})
    return splits.grid_blocks(t, 6).select(*tiles.KEY, "lon", "lat", "block")


# Transforms and models


@query("select row_id, round((f0-a)/s,6) as f0, round((f1-c)/(d-c),6) as f1, round(f2/m,6) as f2 from matrix, (select avg(f0) as a, stddev_pop(f0) as s, min(f1) as c, max(f1) as d, max(f2) as m from matrix)")
def m1_m2_m3_scalers(i: Inputs) -> DataFrame:
    d = i.matrix()
    return rounded(models.global_max(models.min_max(models.standard(d, ["f0"]), ["f1"]), ["f2"]).select("row_id", "f0", "f1", "f2"))


@query("select row_id, " + ", ".join(FEATURES) + ", " + ", ".join(f'{a}*{b} as "{a}*{b}"' for a, b in _PAIRS) + " from matrix")
def m4_degree2(i: Inputs) -> DataFrame:
    return models.degree2(i.matrix().select("row_id", *FEATURES), FEATURES)


@query("select row_id, 'f0' as feature, round((f0-(select avg(f0) from matrix))*(select regr_slope(y, f0) from matrix),6) as value from matrix")
def m5_m23_linear_attribution(i: Inputs) -> DataFrame:
    return rounded(models.linear_attribution(i.matrix(), ["f0"]))


@query()
def m9_m14_forest_cv(i: Inputs) -> DataFrame:
    d = order.cut(splits.shuffled_folds(i.matrix(), "row_id", 7))
    return metrics.scores(models.fit_predict(d, FEATURES, "RF", folds=7), ["fold"])


@query()
def m6_m7_linear_cv(i: Inputs) -> DataFrame:
    d = order.cut(splits.contiguous_folds(i.matrix(), "row_id", 7))
    scored = [models.fit_predict(d, FEATURES, m, folds=7).withColumn("model", F.lit(m)) for m in ("LR", "Ridge", "Lasso")]
    return metrics.scores(scored[0].unionByName(scored[1]).unionByName(scored[2]), ["model", "fold"])


@query()
def m22_permutation_importance(i: Inputs) -> DataFrame:
    d = i.matrix()
    return models.permutation_importance(d, models.MODELS["LR"]().setLabelCol("y").fit(models.assembled(d, FEATURES)), FEATURES, repeats=30)


@query()
def m23_sampled_attribution(i: Inputs) -> DataFrame:
    d = i.matrix()
    m = models.MODELS["RF"]().setLabelCol("y").fit(models.assembled(d, FEATURES))
    return models.sampled_attribution(d, m, FEATURES, d.orderBy("row_id").limit(4))


@query()
def m26_m29_m30_clusters(i: Inputs) -> DataFrame:
    return models.cluster_medians(models.cluster_series(i.matrix(), FEATURES), FEATURES)


@query()
def a36_m25_centroids(i: Inputs) -> DataFrame:
    """a < b: the centroids of two cities in component space and their distance."""
    c = models.principal_components(i.matrix(), FEATURES, 2, ["row_id", "city"]).groupBy("city").agg(F.avg("pc0").alias("pc0"), F.avg("pc1").alias("pc1"))
    side = lambda s: c.select(F.col("city").alias(s), F.col("pc0").alias(f"{s}_pc0"), F.col("pc1").alias(f"{s}_pc1"))
    return side("a").join(side("b"), F.col("a") < F.col("b")).withColumn("distance", F.hypot(F.col("a_pc0") - F.col("b_pc0"), F.col("a_pc1") - F.col("b_pc1")))
