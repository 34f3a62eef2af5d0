"""Points, tracks and paths as DataFrames.

Points have coordinate columns (t, z, y, x); tracks have N as well; paths have
N and ord.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import graph
from ..axes import parse


def _space(df: DataFrame) -> list[str]:
    return [a for a in "zyx" if a in df.columns]


def select(points: DataFrame, key: str) -> DataFrame:
    """Rows by ``"t=0:2;z=1"``; stops are exclusive and may be open."""
    for name, k in parse(key, {c: None for c in points.columns}).items():
        c = F.col(name)
        if isinstance(k, slice):
            points = points.where((F.lit(True) if k.start is None else c >= k.start) & (F.lit(True) if k.stop is None else c < k.stop))
            if k.step:
                points = points.where((c - (k.start or 0)) % k.step == 0)
        else:
            points = points.where(c.isin(k) if isinstance(k, list) else c == k)
    return points


def filter_stubs(tracks: DataFrame, least: int = 3) -> DataFrame:
    """Tracks with enough points; counts are aggregated before they are joined back."""
    long = tracks.groupBy("N").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("N")
    return tracks.join(long, "N", "left_semi")


def displacements(tracks: DataFrame, most: int = 100, scale: Mapping[str, float] | None = None) -> DataFrame:
    """Squared displacement d2 of each track and pair of times up to ``most`` apart: N, t, lag, d2.

    A point meets the later times of its own track only: it emits the times
    t + 1 ... t + most and joins them by (N, t).
    """
    axes, scale = _space(tracks), dict(scale or {})
    later = tracks.select("N", "t", *[F.col(a).alias(f"_{a}") for a in axes])
    early = tracks.select("N", F.col("t").alias("_t"), *axes, F.explode(F.sequence(F.col("t") + 1, F.col("t") + most)).alias("t"))
    d2 = sum((F.pow((F.col(f"_{a}") - F.col(a)) * float(scale.get(a, 1.0)), 2) for a in axes), F.lit(0.0))
    return early.join(later, ["N", "t"]).select("N", F.col("_t").alias("t"), (F.col("t") - F.col("_t")).alias("lag"), d2.alias("d2"))


def imsd(tracks: DataFrame, most: int = 100, scale: Mapping[str, float] | None = None) -> DataFrame:
    """Mean squared displacement per track and lag."""
    return displacements(tracks, most, scale).groupBy("N", "lag").agg(F.avg("d2").alias("msd"))


msd = imsd


def emsd(tracks: DataFrame, most: int = 100, scale: Mapping[str, float] | None = None) -> DataFrame:
    """Mean squared displacement per lag over all tracks."""
    return displacements(tracks, most, scale).groupBy("lag").agg(F.avg("d2").alias("msd"))


def track_drift(tracks: DataFrame) -> DataFrame:
    """Minus the mean displacement from frame to frame, summed up from 0."""
    axes = _space(tracks)
    w = Window.partitionBy("N").orderBy("t")
    steps = tracks.select("t", *[(F.col(a) - F.lag(a).over(w)).alias(a) for a in axes], (F.col("t") - F.lag("t").over(w)).alias("_dt")).where("_dt = 1")
    mean = steps.groupBy("t").agg(*[F.avg(a).alias(a) for a in axes])
    start = tracks.agg(F.min("t").alias("t")).select("t", *[F.lit(0.0).alias(a) for a in axes])
    up = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, 0)  # a row per frame
    return mean.unionByName(start).select("t", *[(-F.sum(a).over(up)).alias(a) for a in axes])


def path_length(paths: DataFrame) -> DataFrame:
    """Length of each path."""
    axes = _space(paths)
    w = Window.partitionBy("N").orderBy("ord")
    d2 = sum((F.pow(F.col(a) - F.lag(a).over(w), 2) for a in axes), F.lit(0.0))
    return paths.select("N", F.coalesce(F.sqrt(d2), F.lit(0.0)).alias("_d")).groupBy("N").agg(F.sum("_d").alias("length"))


def as_path(tracks: DataFrame) -> DataFrame:
    return tracks.withColumnRenamed("t", "ord")


def project(points: DataFrame, axis: str) -> DataFrame:
    return points.drop(*axis)


def _link_series(frame: pd.DataFrame, axes: list[str], reach: float, memory: int) -> np.ndarray:
    """Track numbers of one series: nearest pairs first, from frame to frame."""
    out = np.full(len(frame), -1, np.int64)
    t, xyz = frame["t"].to_numpy(), frame[axes].to_numpy(float)
    open_: dict[int, tuple[int, np.ndarray]] = {}
    count = 0
    for now in np.unique(t):
        rows = np.flatnonzero(t == now)
        open_ = {k: v for k, v in open_.items() if now - v[0] <= memory + 1}
        keys = list(open_)
        if keys:
            d = np.sqrt(((xyz[rows][:, None] - np.stack([open_[k][1] for k in keys])[None]) ** 2).sum(-1))
            for flat in np.argsort(d, axis=None, kind="stable"):
                i, j = divmod(int(flat), len(keys))
                if d[i, j] > reach:
                    break
                if out[rows[i]] < 0 and keys[j] is not None:
                    out[rows[i]], keys[j] = keys[j], None
        for r in rows:
            if out[r] < 0:
                out[r], count = count, count + 1
            open_[int(out[r])] = (int(now), xyz[r])
    return out


def _candidates(points: DataFrame, axes: list[str], reach: float, memory: int, keys: list[str]) -> DataFrame:
    """Pairs (src, dst, _gap, _d) of points of later frames within reach: a point looks into the cells around its own, one frame after the other."""
    cell = {a: F.floor(F.col(a) / float(reach)).cast("long") for a in axes}
    there = points.select(*keys, F.col("t").alias("_t"), F.col("_id").alias("dst"), *[F.col(a).alias(f"_{a}") for a in axes], *[cell[a].alias(f"_c{a}") for a in axes])
    here = points.select(*keys, "t", F.col("_id").alias("src"), *axes, F.explode(F.sequence(F.lit(1), F.lit(memory + 1))).alias("_gap"), *[cell[a].alias(f"_o{a}") for a in axes])
    for a in axes:
        here = here.withColumn(f"_c{a}", F.explode(F.sequence(F.col(f"_o{a}") - 1, F.col(f"_o{a}") + 1))).drop(f"_o{a}")
    here = here.withColumn("_t", F.col("t") + F.col("_gap"))
    d = F.sqrt(sum((F.pow(F.col(a) - F.col(f"_{a}"), 2) for a in axes), F.lit(0.0)))
    return graph.merged(here, there, [*keys, "_t", *[f"_c{a}" for a in axes]]).select("src", "dst", "_gap", d.alias("_d")).where(F.col("_d") <= float(reach))


def _assigned(pairs: DataFrame) -> DataFrame:
    """src and dst of the pairs that nearest-first assignment from frame to frame takes.

    A point takes the first frame that it can, there the nearest free point; a
    point is taken by its nearest.  A pair that is first on both sides is final,
    and all others of its points go; rounds of this end with the assignment that
    goes through the frames one after the other, as the least pair that is left is
    always first on both sides.
    """
    taken = None
    pairs = graph.settled(pairs)
    while not pairs.isEmpty():
        out = pairs.groupBy("src").agg(F.min(F.struct("_gap", "_d", "dst")).alias("_out"))
        into = pairs.groupBy("dst").agg(F.min(F.struct("_d", "src")).alias("_in"))
        first = graph.merged(out.select("src", F.col("_out.dst").alias("dst")), into.select("dst", F.col("_in.src").alias("src")), ["src", "dst"])
        first = graph.settled(first)
        free = graph.merged(pairs, first.select("src"), "src", "left_anti")
        pairs = graph.settled(graph.merged(free, first.select("dst"), "dst", "left_anti"))
        taken = first if taken is None else taken.union(first)
    return pairs.select("src", "dst") if taken is None else taken


def _roots(ids: DataFrame, links: DataFrame) -> DataFrame:
    """_id and _root, the first point of each one's track: pointers to the point before are doubled until all are at the start."""
    links = graph.settled(links)
    now = graph.settled(graph.merged(ids, links.select(F.col("dst").alias("_id"), F.col("src").alias("_root")), "_id", "left").select("_id", F.coalesce("_root", "_id").alias("_root")))
    while True:
        up = now.select(F.col("_id").alias("_root"), F.col("_root").alias("_next"))
        new = graph.settled(graph.merged(now, up, "_root").select("_id", F.col("_next").alias("_root"), (F.col("_next") != F.col("_root")).alias("_moved")))
        now = new.select("_id", "_root")
        if new.where("_moved").isEmpty():
            return now


def _link_all(points: DataFrame, axes: list[str], reach: float, memory: int) -> DataFrame:
    numbered = graph.settled(points.withColumn("_id", F.monotonically_increasing_id()))
    sound = numbered.where(" and ".join(f"{c} is not null" for c in ("t", *axes)))
    roots = _roots(numbered.select("_id"), _assigned(_candidates(sound, axes, reach, memory, [])))
    placed = graph.merged(numbered, roots, "_id")
    starts = placed.where("_id = _root").select("_root", "t", *axes)
    before = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, -1)  # a row per frame
    frames = starts.groupBy("t").agg(F.count("*").alias("_n")).select(F.col("t").alias("_ft"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = F.row_number().over(Window.partitionBy("t").orderBy(*axes, "_root"))
    numbers = graph.merged(starts.withColumn("_k", within), frames, F.col("t").eqNullSafe(F.col("_ft"))).select("_root", (F.col("_base") + F.col("_k") - 1).cast("long").alias("N"))
    return graph.merged(placed, numbers, "_root").select(*points.columns, "N")


def link(points: DataFrame, reach: float, *, memory: int = 0, least: int = 0, by: list[str] | None = None) -> DataFrame:
    """Tracks from points: N is unique within the series that ``by`` names (all points are one series without it), in the order of first frames and coordinates.

    From frame to frame nearest pairs are taken first (of equal ones any); a
    point that finds none within reach is looked for in ``memory`` more frames.
    Series are handled by a task each and run side by side.  Without series all
    frames are linked at once: candidates come from a join by cells of the
    reach's size, assignment is rounds of mutual first choices, and steps are
    joined to tracks by pointer doubling.
    """
    by, axes = list(by or []), _space(points)
    if not by:
        out = _link_all(points, axes, reach, memory)
    else:
        schema = T.StructType([*points.schema.fields, T.StructField("N", T.LongType())])

        def run(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["t", *axes], kind="stable").reset_index(drop=True)
            pdf["N"] = _link_series(pdf, axes, reach, memory)
            return pdf

        out = points.groupBy(*by).applyInPandas(run, schema)
    if least:
        long = out.groupBy(*by, "N").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).drop("_n")
        out = out.join(long, [*by, "N"], "left_semi")
    return out
