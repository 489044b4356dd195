"""Helpers shared by the operators: shared-folder tables, row keys and plain-text constants."""

from __future__ import annotations

import ctypes
import functools
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: The white space of every contract here: space and the five controls 9 to 13.
SPACES = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For bytes.translate(): A-Z become a-z, all other bytes stay.
LOWER_TABLE = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def shared_dir(spark: SparkSession) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir, or a
    temporary folder of this machine where that is unset (tests on local masters)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/table-{uuid.uuid4().hex}"


class Scratch:
    """The tables that stored() writes within ``with scratch:``; release() deletes them. For
    callers that have written what they wanted: results that still read the tables fail."""

    open: list[Scratch] = []

    def __init__(self):
        self.paths: list[str] = []

    def __enter__(self) -> Scratch:
        Scratch.open.append(self)
        return self

    def __exit__(self, *error) -> None:
        Scratch.open.remove(self)

    def release(self, spark: SparkSession) -> None:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        while self.paths:
            path = jvm.org.apache.hadoop.fs.Path(self.paths.pop())
            path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and written as a Parquet table in the shared folder: lineage ends
    there, and a lost executor costs no recomputation before it."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession)
    df.write.parquet(path)
    for scratch in Scratch.open[-1:]:
        scratch.paths.append(path)
    return spark.read.schema(df.schema).parquet(path)


def free_name(taken: Sequence[str], wish: str) -> str:
    """wish, or wish with underscores before it, so that no column of the input clashes."""
    low = {t.lower() for t in taken}
    while wish.lower() in low:
        wish = f"_{wish}"
    return wish


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, which at its end gives unused memory back, Arrow's and the C library's: Python
    workers outlive tasks."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return wrapped


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
