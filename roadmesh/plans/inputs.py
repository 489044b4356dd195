"""Stand-ins for the traffic tables, from the given tables; the same rows in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: A supplier's node is its key plus SUPPLIERS; a part's is its key, which jumps over the band of the suppliers by PARTS.
SUPPLIERS, PARTS = 1_000_000, 1_000_000_000


def part_node(key: str) -> Column:
    k = F.col(key)
    return F.when(k < SUPPLIERS, k).otherwise(k + PARTS)


def is_supplier(node: Column) -> Column:
    return (node >= SUPPLIERS) & (node < PARTS)


class Inputs:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def jf(self) -> DataFrame:
        return self.table("events").select(F.col("user_id").alias("nid"), "ts", "event_id", F.col("value").alias("jf"), F.col("event_type").alias("city"))

    def nodes(self) -> DataFrame:
        def of(name: str, key: str, node: Column, tag: Column) -> DataFrame:
            k = F.col(key)
            return self.table(name).select(node.alias("node_id"), ((k * 37 % 1000) / 1000.0).alias("x"), ((k * 91 % 997) / 997.0).alias("y"), tag.alias("highway"), (1 + k % 6).cast("int").alias("street_count"))

        tag = F.when(F.col("p_type") == "PROMO", "traffic_signals").when(F.col("p_type") == "SMALL", "crossing")
        return of("part", "p_partkey", part_node("p_partkey"), tag).unionByName(of("supplier", "s_suppkey", F.col("s_suppkey") + SUPPLIERS, F.lit(None).cast("string")))

    def edges(self, dealt: list[str] | None = None) -> DataFrame:
        """dealt: columns that name the tasks of the edges, so that groups by them need no shuffle."""
        e = self.table("lineitem").select(part_node("l_partkey").alias("u"), (F.col("l_suppkey") + SUPPLIERS).alias("v"), F.col("l_linenumber").alias("key"), F.col("l_quantity").alias("length"), F.col("l_linenumber").alias("lanes"), F.col("l_tax").alias("maxspeed"), F.col("l_returnflag").alias("highway"))
        return (e.repartition(self.deals(), *dealt) if dealt else e).groupBy("u", "v", "key").agg(F.min("length").alias("length"), F.min("lanes").alias("lanes"), F.min("maxspeed").alias("maxspeed"), F.min("highway").alias("highway"))

    def tasks(self, rows: int = 50_000) -> int:
        """Tasks of so many line items each, for pieces that are dealt to many tiles after their last
        shuffle; the number comes from the files' footers."""
        return 1 + self.table("lineitem").count() // rows

    def deals(self) -> int:
        """Tasks of the edges and pieces where they are grouped and joined: at most 250,000 line items each, as
        memory of a task grows with its rows; fewer than tasks(), as shuffles write a block for every two tasks."""
        n = self.table("lineitem").count()
        return 1 + min(n // 50_000, 15 + n // 250_000)

    def links(self) -> DataFrame:
        """The different u, v of the edges, dealt by v."""
        return self.table("lineitem").select(part_node("l_partkey").alias("u"), (F.col("l_suppkey") + SUPPLIERS).alias("v")).repartition(self.deals(), "v").distinct()

    def pieces(self) -> DataFrame:
        """Joined by u last, so that the pieces of a segment are in one task and groups by segment need no shuffle.
        As each piece becomes a row for every tile that it meets, tasks stay small whatever the size."""
        e = self.links()
        n = self.nodes().select("node_id", "x", "y")
        a = n.select(F.col("node_id").alias("u"), F.col("x").alias("x1"), F.col("y").alias("y1"))
        b = n.select(F.col("node_id").alias("v"), F.col("x").alias("x2"), F.col("y").alias("y2"))
        return e.join(b, "v").repartition(self.tasks(), "u").join(a, "u").select(F.col("u").alias("nid"), "v", "x1", "y1", "x2", "y2")

    def importance(self) -> DataFrame:
        return self.table("events").select(F.col("event_type").alias("city"), (20 + 10 * (F.col("user_id") % 8)).cast("int").alias("scale"), F.concat(F.lit("f"), (F.col("event_id") % 14).cast("string")).alias("feature"), F.when(F.col("event_id") % 11 != 0, F.col("value") - 50).alias("value"), "event_id")

    def matrix(self, n: int = 14) -> DataFrame:
        x = lambda i: F.get("embedding", F.lit(i)).cast("double")
        return self.table("embeddings").select(F.col("vec_id").alias("row_id"), *[x(i).alias(f"f{i}") for i in range(n)], (x(0) * 2 - x(1) + x(2) * x(3) + x(20)).alias("y"), F.col("label").alias("city"))


#: The same as SQL, by name.
SQL = {
    "jf": "select user_id as nid, ts, event_id, value as jf, event_type as city from events",
    "nodes": """select case when p_partkey<1000000 then p_partkey else 1000000000+p_partkey end as node_id, (p_partkey*37 % 1000)/1000.0::double as x, (p_partkey*91 % 997)/997.0::double as y,
      case when p_type='PROMO' then 'traffic_signals' when p_type='SMALL' then 'crossing' end as highway, cast(1 + p_partkey % 6 as integer) as street_count from part
      union all select 1000000+s_suppkey, (s_suppkey*37 % 1000)/1000.0::double, (s_suppkey*91 % 997)/997.0::double, null, cast(1 + s_suppkey % 6 as integer) from supplier""",
    "edges": "select case when l_partkey<1000000 then l_partkey else 1000000000+l_partkey end as u, 1000000+l_suppkey as v, l_linenumber as key, min(l_quantity) as length, min(l_linenumber) as lanes, min(l_tax) as maxspeed, min(l_returnflag) as highway from lineitem group by 1, 2, 3",
    "pieces": "select e.u as nid, e.v, a.x as x1, a.y as y1, b.x as x2, b.y as y2 from (select distinct u, v from edges) e join nodes a on a.node_id=e.u join nodes b on b.node_id=e.v",
    "tiles": "select s.scale, r.r::integer as row, c.c::integer as col, r.r::double/s.scale as s, (r.r+1)::double/s.scale as n, c.c::double/s.scale as w, (c.c+1)::double/s.scale as e from (select unnest([10, 20]) as scale) s, (select unnest(range(20)) as r) r, (select unnest(range(20)) as c) c where r.r < s.scale and c.c < s.scale",
    "importance": "select event_type as city, cast(20+10*(user_id%8) as integer) as scale, 'f' || (event_id%14) as feature, case when event_id%11<>0 then value-50 end as value, event_id from events",
    "matrix": "select vec_id as row_id, " + ", ".join(f"embedding[{i + 1}]::double as f{i}" for i in range(14)) + ", embedding[1]::double*2 - embedding[2]::double + embedding[3]::double*embedding[4]::double + embedding[21]::double as y, label as city from embeddings",
    "bins": "select nid, cast((rn-1)//6 as bigint) as bin, avg(jf) as jf from (select *, row_number() over (partition by nid order by ts, event_id) as rn from jf) group by 1, 2",
    "days": "select * from (select nid, bin//24 as day, bin%24 as hour, jf, count(*) over (partition by nid, bin//24) as n from (select nid, cast(row_number() over (partition by nid order by ts, event_id)-1 as bigint) as bin, jf from jf)) where n=24 and day<30",
    "walk": "select * from (select city, cast(floor(jf) as bigint) as u, lead(cast(floor(jf) as bigint)) over (partition by city order by event_id) as v, jf as length from jf) where v is not null",
    "seg_bins": "select nid, cast((rn-1)//2 as bigint) as bin, avg(jf) as jf from (select *, row_number() over (partition by nid order by ts, event_id) as rn from jf) group by 1, 2",
    "profile": "select nid, hour, avg(jf) as jf from (select nid, bin//24 as day, bin%24 as hour, jf, count(*) over (partition by nid, bin//24) as n from seg_bins) where n=24 and day<30 group by 1, 2",
    "seg_value": "select nid, avg(jf) as jf from profile where hour>=1 and hour<24 group by 1",
    "seg_tile": """select scale, "row", col, nid, v, greatest(0.0, x0, y0) as t0, least(1.0, xe, ye) as t1, (least(1.0, xe, ye) - greatest(0.0, x0, y0)) * sqrt(pow(x2-x1,2)+pow(y2-y1,2)) as len
      from (select *, case when x2-x1=0 then case when x1 between w and e then 0.0 else 2.0 end else least((w-x1)/(x2-x1), (e-x1)/(x2-x1)) end as x0,
                      case when x2-x1=0 then case when x1 between w and e then 1.0 else -1.0 end else greatest((w-x1)/(x2-x1), (e-x1)/(x2-x1)) end as xe,
                      case when y2-y1=0 then case when y1 between s and n then 0.0 else 2.0 end else least((s-y1)/(y2-y1), (n-y1)/(y2-y1)) end as y0,
                      case when y2-y1=0 then case when y1 between s and n then 1.0 else -1.0 end else greatest((s-y1)/(y2-y1), (n-y1)/(y2-y1)) end as ye
            from pieces cross join tiles) p
      where greatest(0.0, x0, y0) <= least(1.0, xe, ye)""",
    "node_tile": "select n.*, s.scale, t.row, t.col from nodes n cross join (select unnest([10, 20]) as scale) s left join tiles t on t.scale=s.scale and n.x>t.w and n.x<t.e and n.y>t.s and n.y<t.n",
    "tile_edges": "select scale, \"row\", col, u, v, key, length, lanes, maxspeed from (select t.scale, t.row, t.col, e.*, row_number() over (partition by t.scale, t.row, t.col, e.u, e.v order by e.key) as rn from node_tile t join edges e on e.u=t.node_id where t.row is not null) where rn=1",
}


def with_inputs(sql: str) -> str:
    """sql with the inputs that it names before it as common tables."""
    import re

    need, out = set(), []

    def add(text: str) -> None:
        for name in SQL:
            if name not in need and re.search(rf"(?:from|join|,)\s+\(?{name}\b", text):
                need.add(name)
                add(SQL[name])
                out.append(name)

    add(sql)
    return f"with {', '.join(f'{n} as {"materialized " if n in ("pieces", "nodes", "tiles") else ""}({SQL[n]})' for n in out)} {sql}" if out else sql
