"""Registered queries of the readers and writers: what is written from the given tables to a
new folder and read again equals what SQL says of the tables."""

from __future__ import annotations

from datetime import datetime, timedelta
from functools import reduce

from pyspark.ml.regression import LinearRegressionModel
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import models, temporal
from ..sources import tables
from .catalog import TIME, query, rounded
from .inputs import Inputs

CITIES = ["click", "view"]
ALL = ["click", "error", "purchase", "signup", "view"]
_CITIES = "('" + "', '".join(CITIES) + "')"


@query("select nid, v, round(x1,6) as x1, round(y1,6) as y1, round(x2,6) as x2, round(y2,6) as y2 from pieces")
def io1_segments(i: Inputs) -> DataFrame:
    path, p = tables.new_folder(i.spark), i.pieces()
    wkt = F.format_string("LINESTRING (%s %s, %s %s)", *[F.col(c).cast("string") for c in ("x1", "y1", "x2", "y2")])
    tables.write_report(p.select(F.struct("nid", "v").alias("key"), wkt.alias("Linestring")).select(F.col("key.nid").alias("NID"), "Linestring", F.col("key.v").alias("v")), path)
    ends = i.edges().select(F.col("u").alias("nid"), "v").distinct()
    nodes = i.nodes().select(F.col("node_id").alias("v"), F.round("x", 6).alias("x2"), F.round("y", 6).alias("y2"))
    read = rounded(T.explode_wkt(tables.read_segments(i.spark, path))).select("nid", "x1", "y1", "x2", "y2").distinct()
    return read.join(ends.join(nodes, "v"), ["nid", "x2", "y2"]).select("nid", "v", "x1", "y1", "x2", "y2")


@query("select n.nid, timestamp '2024-01-01 00:00:00' + h.h * interval 1 hour as ts, round(b.jf,6) as jf from (select distinct nid from bins) n cross join (select unnest(range((select max(bin)+1 from bins))) as h) h left join bins b on b.nid=n.nid and b.bin=h.h")
def io2_wide_series(i: Inputs) -> DataFrame:
    """All hours of each segment, those without a value included, as a wide table."""
    path, bins = tables.new_folder(i.spark), temporal.resample_mean(i.jf(), ["nid"], 6, ts=TIME)
    last = bins.agg(F.max("bin")).first()[0]
    hours = [str(datetime(2024, 1, 1) + timedelta(hours=h)) for h in range((last or 0) + 1)]
    wide = bins.groupBy(F.col("nid").alias("NID")).agg(*[F.max(F.when(F.col("bin") == h, F.col("jf"))).alias(name) for h, name in enumerate(hours)])
    tables.write_report(wide, path)
    return rounded(temporal.jf_to_long(tables.read_jf_wide(i.spark, path)).select("nid", F.col("ts").cast("timestamp_ntz").alias("ts"), "jf"))


_LOG = "select city, scale::varchar as scale, feature, event_id::varchar as event_id from importance"


@query(f"select 'one' as kind, * from ({_LOG}) where city='click' union all select 'many', * from ({_LOG}) where city in {_CITIES} union all select 'pattern', * from ({_LOG}) where city is not null")
def io3_io4_io5_logs(i: Inputs) -> DataFrame:
    """Log lines of a city each in a folder of its own, read from one, many and by pattern."""
    path, names = tables.new_folder(i.spark), ["city", "scale", "feature", "event_id"]
    line = F.concat_ws("  ", F.lit(""), "city", F.col("scale").cast("string"), "feature", F.col("event_id").cast("string"))
    i.importance().where("city is not null").select(F.col("city").alias("of"), line.alias("value")).write.partitionBy("of").text(path)
    paths = {"one": f"{path}/of=click", "many": [f"{path}/of={c}" for c in CITIES], "pattern": f"{path}/of=*"}
    parts = [tables.read_log(i.spark, p, names).select(F.lit(kind).alias("kind"), *names) for kind, p in paths.items()]
    return reduce(DataFrame.unionByName, parts)


@query("select n.node_id, count(e.u) as streets from nodes n left join edges e on e.u=n.node_id group by 1")
def io6_graph(i: Inputs) -> DataFrame:
    path = tables.new_folder(i.spark)
    i.nodes().write.parquet(f"{path}/nodes"), i.edges().write.parquet(f"{path}/edges")
    nodes, edges = tables.read_graph(i.spark, f"{path}/nodes", f"{path}/edges")
    return nodes.select("node_id").join(edges.select(F.col("u").alias("node_id"), "key"), "node_id", "left").groupBy("node_id").agg(F.count("key").alias("streets"))


@query("""select p.p as place, round(case when p.p in (1, 2) then e else w end, 6) as x, round(case when p.p in (2, 3) then n else s end, 6) as y
  from (select street_count, max(y) as n, max(x) as e, min(y) as s, min(x) as w from nodes group by 1) cross join (select unnest(range(5))::integer as p) p""")
def io7_io13_boundary(i: Inputs) -> DataFrame:
    """The extents of the cities (here one per street count) as GeoJSON, read as vertices."""
    path = tables.new_folder(i.spark)
    boxes = i.nodes().groupBy("street_count").agg(F.max("y").alias("n"), F.max("x").alias("e"), F.min("y").alias("s"), F.min("x").alias("w"))
    features = tables.boxes_to_geojson(boxes).agg(F.array_join(F.collect_list("value"), ",").alias("f"))
    features.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("value")).write.text(path)
    return rounded(tables.read_boundary(i.spark, path))


@query("""select * from (with b as (select row_number() over (order by street_count)-1 as r, max(y) as n, max(x) as e, min(y) as s, min(x) as w from nodes group by street_count),
  a as (select r//2 as feature, r%2 as part, 0 as ring, n, e, s, w from b union all select r//2, r%2, 1, n-(n-s)/4, e-(e-w)/4, s+(n-s)/4, w+(e-w)/4 from b)
  select feature::integer as feature, part::integer as part, ring, p.p as place, round(case when p.p in (1, 2) then e else w end, 6) as x, round(case when p.p in (2, 3) then n else s end, 6) as y from a cross join (select unnest(range(5))::integer as p) p)""")
def io7_rings(i: Inputs) -> DataFrame:
    """Boxes with a hole, two to a MultiPolygon, as GeoJSON, read with all their rings."""
    path = tables.new_folder(i.spark)
    b = i.nodes().groupBy("street_count").agg(F.max("y").alias("n"), F.max("x").alias("e"), F.min("y").alias("s"), F.min("x").alias("w"))
    corner = lambda x, y, dx, dy: F.array(F.col(x) + dx * (F.col("e") - F.col("w")) / 4, F.col(y) + dy * (F.col("n") - F.col("s")) / 4)
    ring = lambda k: F.array(corner("w", "s", k, k), corner("e", "s", -k, k), corner("e", "n", -k, -k), corner("w", "n", k, -k), corner("w", "s", k, k))
    r = F.row_number().over(W.partitionBy(F.lit(0)).orderBy("street_count")) - 1  # a row for each street count
    parts = b.select(r.alias("r"), F.array(ring(0), ring(1)).alias("rings")).groupBy(F.floor(F.col("r") / 2).alias("feature")).agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "rings"))), lambda s: s["rings"]).alias("coordinates"))
    one = F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("MultiPolygon").alias("type"), "coordinates").alias("geometry")))
    features = parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("feature", one.alias("f")))), lambda s: s["f"]), ",").alias("f"))
    features.select(F.concat(F.lit('{"type":"FeatureCollection","features":['), "f", F.lit("]}")).alias("value")).write.text(path)
    return rounded(tables.read_rings(i.spark, path))


_MEAN, _MOST = "select nid, round(avg(jf),6) as jf from jf group by 1", "select nid, round(max(jf),6) as jf from jf group by 1"


@query(f"select 'kept' as kind, * from ({_MEAN}) union all select 'refreshed', * from ({_MOST}) union all select 'unfinished', * from ({_MOST})")
def io8_io9_io10_cached_stage(i: Inputs) -> DataFrame:
    """A stage that is there is kept, unless a refresh is asked or it was never finished."""
    path = tables.new_folder(i.spark)
    mean, most = (i.jf().groupBy("nid").agg(f("jf").alias("jf")) for f in (F.avg, F.max))
    tables.cached_table(mean, f"{path}/kept"), tables.cached_table(mean, f"{path}/refreshed")
    mean.write.option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(f"{path}/unfinished")
    parts = [tables.cached_table(most, f"{path}/{kind}", refresh=kind == "refreshed").withColumn("kind", F.lit(kind)) for kind in ("kept", "refreshed", "unfinished")]
    return rounded(reduce(DataFrame.unionByName, parts))


@query("select city, feature, count(value) as n, round(avg(value),6) as mean from importance group by 1, 2")
def io11_report(i: Inputs) -> DataFrame:
    path = tables.new_folder(i.spark)
    tables.write_report(i.importance().groupBy("city", "feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean")), path)
    return rounded(i.spark.read.option("header", True).schema("city string, feature string, n long, mean double").csv(path))


@query("select scale, count(*) as n from importance where scale <= 50 group by 1 union all select scale, count(*) from importance group by 1")
def io12_append(i: Inputs) -> DataFrame:
    path = tables.new_folder(i.spark)
    for part in (i.importance().where("scale <= 50"), i.importance()):
        tables.append_results(part.groupBy("scale").agg(F.count("*").alias("n")), path)
    return i.spark.read.parquet(path)


@query(f"select city, k.k as kind, nid::varchar || case when k.k='jf' then ',' || event_id::varchar else '' end as value from jf cross join (select unnest(['jf', 'linestring']) as k) k where city is not null")
def io14_routing(i: Inputs) -> DataFrame:
    """Raw files whose names say the city and the kind."""
    path = tables.new_folder(i.spark)
    for city in ALL:
        d = i.jf().where(F.col("city") == city)
        for kind, value in (("jf", F.concat_ws(",", "nid", "event_id")), ("linestring", F.col("nid").cast("string"))):
            d.select(value.alias("value")).write.option("mapreduce.output.basename", f"{city.title()}_{kind}").text(f"{path}/{city}/{kind}")
    return tables.route_raw_files(i.spark, path, ALL).select("city", "kind", "value")


@query("select row_id, round(f0*(select regr_slope(y,f0) from matrix)+(select regr_intercept(y,f0) from matrix),4) as prediction from matrix where f0 is not null and y is not null")
def m21_saved_model(i: Inputs) -> DataFrame:
    path, d = tables.new_folder(i.spark), models.assembled(i.matrix().where("f0 is not null and y is not null"), ["f0"])
    models.save(models.MODELS["LR"]().setLabelCol("y").fit(d), path)
    return rounded(LinearRegressionModel.load(path).transform(d).select("row_id", "prediction"), 4)
