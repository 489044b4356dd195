"""Places in a global order, and cuts of lineage; both without a single task for all rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; only local masters, as in tests, may do without
    and get a temporary one."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        path = spark.conf.get("spark.checkpoint.dir", None)
        if not path and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """A checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """A cut of lineage by a Parquet table in the shared folder: smaller than a checkpoint where keys repeat."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, order: list[str], name: str = "at", total: str = "_total") -> DataFrame:
    """df with name, the row's place in order (from 0), and total, the number of rows. Rows are
    dealt to ranges and numbered there; what a range's places begin with comes from a table of
    one row per range."""
    ranges = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranges = cut(ranges.withColumns({"_part": F.spark_partition_id(), "_id": F.monotonically_increasing_id()}))
    sizes = ranges.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_id").alias("_first"))
    all_ = W.partitionBy(F.lit(0))
    before = F.sum("_n").over(all_.orderBy("_part")) - F.col("_n") - F.col("_first")
    starts = sizes.select("_part", before.alias("_shift"), F.sum("_n").over(all_).alias(total))
    return ranges.join(starts, "_part").withColumn(name, F.col("_id") + F.col("_shift")).drop("_part", "_id", "_shift")
