"""Tables written to the folder that driver and executors share.

The folder comes from the session's ``spark.checkpoint.dir``.  Only where that
is unset and the master is local (tests) a temporary folder is made and set; on
a cluster that is an error.  A written table
cuts lineage and survives the loss of executors.
"""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="voxelframe-")
        spark.sparkContext.setCheckpointDir(where)
    return where.rstrip("/")


class Scratch:
    """A folder for the tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str) -> None:
        self.spark, self.path = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write the table and return it as read back."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, *names: str) -> None:
        """Delete tables that nothing reads any more."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
            path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def release() -> None:
    """Hand freed memory back to the system: workers live on through later stages, and what they hold counts against the executor."""
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


def lean(run: Callable) -> Callable:
    """A batch function that releases memory when it ends."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release()

    return wrapped


def pack_columns(df: DataFrame, *needed: str) -> DataFrame:
    """Only the columns an operator reads, so that further columns of any name are out of its way."""
    return df.select(*[f"`{c}`" for c in needed])


def numbered(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The rows with columns _0, _1, .. and which of them each column is, so that no name clashes with an operator's own."""
    names = [f"_{i}" for i in range(len(df.columns))]
    return df.toDF(*names), dict(zip(df.columns, names))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows whose doc_id is not among the ids, with all columns; rows with null doc_id stay."""
    rows, column = numbered(docs)
    return rows.join(ids.toDF("gone"), F.col(column["doc_id"]) == F.col("gone"), "left_anti").toDF(*docs.columns)


def small_batches(spark: SparkSession, rows: int = 500) -> None:
    """Limit the rows that go to a Python worker at once, where the session has not set its own number: texts are much longer than the rows that Spark's default is made for."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key) == "10000":
        spark.conf.set(key, str(rows))
