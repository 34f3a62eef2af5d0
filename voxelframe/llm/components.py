"""Connected components of a graph that is too large for one machine.

Alternating large-star and small-star steps (Kiveris et al. 2014): every step
hangs neighbours under the least neighbour known, by a minimum per node
(aggregated before the shuffle) and a join back.  Each step's edges are
written to the shared folder, which cuts lineage.  The edges are counted first:
where there are few (SMALL at most), one task does them all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch, lean

#: Edges that one task can hold.
SMALL = 200_000


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


@lean
def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(a: int) -> int:
        while root.setdefault(a, a) != a:
            root[a] = a = root[root[a]]
        return a

    for batch in batches:
        for u, v in zip(*(c.to_pylist() for c in batch.columns)):
            u, v = find(u), find(v)
            root[max(u, v)] = min(u, v)
    nodes = np.fromiter(root, np.int64, len(root))
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array([find(int(n)) for n in nodes], pa.int64())], ["node", "component"])


def components(edges: DataFrame, scratch: Scratch, name: str = "components") -> DataFrame:
    """node and component (its least node) of every node that has an edge; edges has two columns of one kind."""
    edges = scratch.keep(edges.toDF("u", "v").where("u <> v").distinct(), f"{name}0")
    if edges.count() <= SMALL:
        return edges.coalesce(1).mapInArrow(_in_one_task, "node bigint, component bigint")
    seen, step = None, 0
    while True:
        step += 1
        edges = scratch.keep(_small(_large(edges)), f"{name}{step}")
        scratch.drop(f"{name}{step - 1}")
        state = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == seen:
            break
        seen = state
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
