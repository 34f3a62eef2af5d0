"""Results that cut lineage, and connected components of few edges within many graphs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share. Where it is unset a local session (tests) gets a temporary one; on a cluster that is an error."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        where = spark.conf.get("spark.checkpoint.dir", None)
        if not where:
            if not context.master.startswith("local") or context.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            where = "file://" + tempfile.mkdtemp(prefix="voxelframe-")
        context.setCheckpointDir(where)
    return context.getCheckpointDir().rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """Computed once and kept in the shared folder, which cuts lineage and survives the loss of executors."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def merged(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that both grow with the input, by a shuffle: rows of a few numbers pack so well that Spark, judging by the packed size, would build the whole table on the driver to broadcast it."""
    return left.join(right.hint("merge"), on, how)


def bucketed(df: DataFrame, keys: Sequence[str], dealt: bool = False) -> DataFrame:
    """Computed once and kept as a table in buckets of the keys: joins and groupings by them do not shuffle it again.

    ``dealt``: every task of df has the keys of one bucket already (it is the
    result of a join with such a table), so it is written as it is.
    """
    spark = df.sparkSession
    n, name = int(spark.conf.get("spark.sql.shuffle.partitions")), f"buckets_{uuid.uuid4().hex}"
    rows = df if dealt else df.repartition(n, *keys)
    rows.write.bucketBy(n, *keys).format("parquet").option("path", f"{shared_folder(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def components(edges: DataFrame, keys: Sequence[str], a: str = "a", b: str = "b") -> DataFrame:
    """keys, node and root (the least node of its component) of every node with an edge to another; graphs of different keys are apart.

    Alternating stars (Kiveris et al. 2014): larger neighbours move under the
    least one, then smaller ones do, until nothing moves.
    """
    keys = list(keys)
    now = settled(edges.select(*keys, F.greatest(a, b).alias("_u"), F.least(a, b).alias("_v")).where("_u <> _v").distinct())
    before = None
    while True:
        both = now.union(now.select(*keys, "_v", "_u")).toDF(*keys, "_u", "_v")
        least = both.groupBy(*keys, "_u").agg(F.least(F.min("_v"), F.col("_u")).alias("_m"))
        large = merged(both.where("_v > _u"), least, [*keys, "_u"]).select(*keys, F.col("_v").alias("_u"), F.col("_m").alias("_v"))
        hub = large.groupBy(*keys, "_u").agg(F.min("_v").alias("_m"))
        small = merged(large, hub, [*keys, "_u"]).select(*keys, F.col("_v").alias("_u"), F.col("_m").alias("_v"))
        now = settled(small.union(hub.select(*keys, "_u", F.col("_m").alias("_v"))).where("_u <> _v").distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64(*keys, "_u", "_v").cast("decimal(38,0)"))).first())
        if state == before:
            break
        before = state
    return now.select(*keys, F.col("_u").alias("node"), F.col("_v").alias("root")).union(now.select(*keys, "_v", F.col("_v").alias("root")).distinct())


def ranked(df: DataFrame, keys: Sequence[str], place: str, rank: str = "rank", block: int = 1 << 16) -> DataFrame:
    """A column with the rank of each row from 1 by a whole-number place that is unique within the keys.

    Rows are counted by blocks of places; the running sums over blocks and the
    numbers within a block are apart, so that no task orders all rows of a key.
    """
    from pyspark.sql import Window

    keys = list(keys)
    cut = df.withColumn("_block", F.call_function("div", F.col(place), F.lit(block)))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = cut.groupBy(*keys, "_block").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = Window.partitionBy(*keys, "_block").orderBy(place)
    return merged(cut.withColumn("_i", F.row_number().over(inside)), counts, [*keys, "_block"]).withColumn(rank, F.col("_base") + F.col("_i")).drop("_block", "_base", "_i")
