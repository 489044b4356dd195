"""Readers and writers of the inputs and results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_folder(spark: SparkSession) -> str:
    """A path below the folder that spark.checkpoint.dir names; only local masters, as in
    tests, may do without and get a temporary one."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return f"{base or 'file://' + tempfile.mkdtemp(prefix='spark-')}/files-{uuid.uuid4().hex}"


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col("NID").cast("long").alias("nid"), F.col("Linestring").alias("wkt"))


def read_jf_wide(spark: SparkSession, path: str) -> DataFrame:
    """NID as nid and one double column per timestamp, named as in the header."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(F.col("NID").cast("long").alias("nid"), *[F.col(f"`{c}`").cast("double").alias(c) for c in raw.columns if c != "NID"])


def read_log(spark: SparkSession, paths: str | list[str], names: list[str]) -> DataFrame:
    """White-space separated lines without header, from one path, many or a pattern."""
    cells = F.split(F.trim("value"), r"\s+")
    return spark.read.text(paths).select(*[F.get(cells, F.lit(i)).alias(n) for i, n in enumerate(names)], F.col("_metadata.file_name").alias("file"))


def read_graph(spark: SparkSession, nodes: str, edges: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(nodes), spark.read.parquet(edges)


def read_rings(spark: SparkSession, path: str) -> DataFrame:
    """feature, part, ring, place, x, y: the vertices of all polygons of a GeoJSON collection; part numbers a
    MultiPolygon's polygons, ring 0 is the outer one and others are holes. Features of other kinds or
    without a geometry give no rows."""
    raw = spark.read.schema("features array<struct<geometry: struct<type: string, coordinates: string>>>").option("multiLine", True).json(path)
    f = raw.select(F.posexplode("features").alias("feature", "f")).select("feature", F.col("f.geometry.type").alias("kind"), F.col("f.geometry.coordinates").alias("c"))
    ring = "array<array<array<double>>>"
    one, many = F.when(F.col("kind") == "Polygon", F.array(F.from_json("c", ring))), F.when(F.col("kind") == "MultiPolygon", F.from_json("c", f"array<{ring}>"))
    parts = f.select("feature", F.posexplode(F.coalesce(one, many)).alias("part", "rings"))
    rings = parts.select("feature", "part", F.posexplode("rings").alias("ring", "points"))
    return rings.select("feature", "part", "ring", F.posexplode("points").alias("place", "p")).select("feature", "part", "ring", "place", F.get("p", F.lit(0)).alias("x"), F.get("p", F.lit(1)).alias("y"))


def read_boundary(spark: SparkSession, path: str) -> DataFrame:
    """Vertices (place, x, y) of the outer rings in a GeoJSON collection."""
    return read_rings(spark, path).where("ring = 0").select("place", "x", "y")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


def cached_table(df: DataFrame, path: str, partition: list[str] | None = None, refresh: bool = False) -> DataFrame:
    """The table at path if a finished one is there, else df written there (the committer
    makes that all or nothing) and read again."""
    if refresh or not exists(df.sparkSession, path):
        df.write.mode("overwrite").partitionBy(*(partition or [])).parquet(path)
    return df.sparkSession.read.parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_results(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def boxes_to_geojson(df: DataFrame) -> DataFrame:
    """A GeoJSON feature per box n, e, s, w."""
    corner = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(corner("w", "s"), corner("e", "s"), corner("e", "n"), corner("w", "n"), corner("w", "s"))
    return df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))).alias("value"))


def route_raw_files(spark: SparkSession, root: str, cities: list[str]) -> DataFrame:
    """Lines of all CSV files below root with the city in the file's name and its kind:
    linestring or jf."""
    raw = spark.read.option("recursiveFileLookup", True).text(root).select("value", F.lower("_metadata.file_name").alias("file"))
    city = F.coalesce(*[F.when(F.col("file").contains(c.lower()), F.lit(c)) for c in cities])
    return raw.withColumns({"city": city, "kind": F.when(F.col("file").contains("linestring"), "linestring").when(F.col("file").contains("jf"), "jf")})
