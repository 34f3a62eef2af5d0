"""Joins by time: the last row before, and rows within intervals."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a time bucket, about; no task orders more rows of one key than a bucket holds.
BUCKET_ROWS = 50_000


def _edges(rows: DataFrame, rows_each: int) -> list[float]:
    """Limits of time buckets of about equal numbers of rows; their number goes with the table, not with the keys."""
    n = rows.count()
    parts = min(10_000, math.ceil(n / rows_each))
    if parts < 2:
        return []
    return sorted(set(rows.approxQuantile("_at", [k / parts for k in range(1, parts)], 0.1 / parts)))


def _bucket(edges: Sequence[float]):
    """How many limits are at or before the time, by halving (the list is one literal)."""
    if not edges:
        return F.lit(0)
    table = F.split(F.lit(",".join(repr(float(e)) for e in edges)), ",").cast("array<double>")
    steps = max(1, math.ceil(math.log2(len(edges) + 1)))
    span = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)),
        F.struct(F.lit(0).alias("lo"), F.lit(len(edges)).alias("hi")),
        lambda s, _: F.when(s["lo"] >= s["hi"], s).otherwise(
            F.when(F.get(table, F.call_function("div", s["lo"] + s["hi"], F.lit(2)).cast("int")) <= F.col("_at"), F.struct((F.call_function("div", s["lo"] + s["hi"], F.lit(2)) + 1).cast("int").alias("lo"), s["hi"].alias("hi")))
            .otherwise(F.struct(s["lo"].alias("lo"), F.call_function("div", s["lo"] + s["hi"], F.lit(2)).cast("int").alias("hi")))
        ),
    )
    return span["lo"]


def _seconds(df: DataFrame, at: str):
    """Times as numbers: timestamps and dates in seconds."""
    kind = dict(df.dtypes)[at]
    return F.col(at).cast("timestamp").cast("double") if kind.startswith(("timestamp", "date")) else F.col(at).cast("double")


def as_of_join(left: DataFrame, right: DataFrame, at: str, by: Sequence[str] = (), *, tolerance: float | None = None, strict: bool = False, suffix: str = "_right", rows_each: int | None = None) -> DataFrame:
    """Every left row with the last right row of its keys at or before its time (``strict``: before it).

    Columns of the right get the suffix where the left has them, its time too.
    Without such a row, or if it is more than ``tolerance`` earlier (seconds
    for timestamps), they are null.  Of right rows of one time the greatest by their
    other columns counts.  Null keys and times match nothing; left rows all stay.

    Both sides are cut at common limits of time, so that a key of any size is
    many small groups.  Within a bucket of a key the last right row is carried
    forward; the last rows of buckets, one for each key and bucket, are carried over
    the buckets apart.
    """
    by, columns = list(by), [c for c in right.columns if c not in by]
    order = [at, *sorted(c for c in columns if c != at)]
    payload = F.struct(*[F.col(c) for c in order])
    empty = F.lit(None).cast(right.select(payload.alias("r")).schema["r"].dataType)
    sound = F.lit(True)
    for c in (at, *by):
        sound = sound & F.col(c).isNotNull()
    mine = F.struct(*[F.col(c) for c in left.columns])
    l_rows = left.select(*by, _seconds(left, at).alias("_at"), F.lit(0 if strict else 1).alias("_side"), mine.alias("_l"), empty.alias("_r"), sound.alias("_ok"))
    r_rows = right.where(sound).select(*by, _seconds(right, at).alias("_at"), F.lit(1 if strict else 0).alias("_side"), F.lit(None).cast(l_rows.schema["_l"].dataType).alias("_l"), payload.alias("_r"), F.lit(True).alias("_ok"))
    met = l_rows.where("_ok").union(r_rows)
    edges = _edges(met.select("_at"), rows_each or BUCKET_ROWS)
    met = met.withColumn("_b", _bucket(edges))
    inside = Window.partitionBy(*by, "_b").orderBy("_at", "_side", "_r").rowsBetween(Window.unboundedPreceding, 0)
    own = met.withColumn("_own", F.last("_r", ignorenulls=True).over(inside)).where("_l is not null")
    if edges:
        last = met.where("_r is not null").groupBy(*by, "_b").agg(F.max_by("_r", F.struct("_at", "_r")).alias("_r"))
        need = own.where("_own is null").select(*by, "_b").distinct().withColumn("_r", empty)  # one row for each key and bucket
        before = Window.partitionBy(*by).orderBy("_b", F.col("_r").isNotNull()).rowsBetween(Window.unboundedPreceding, -1)
        carried = need.union(last).withColumn("_carried", F.last("_r", ignorenulls=True).over(before)).where("_r is null").select(*by, "_b", "_carried")
        found = own.join(carried, [*by, "_b"], "left").withColumn("_r", F.coalesce("_own", "_carried"))
    else:
        found = own.withColumn("_r", F.col("_own"))
    found = found.select("_l", "_r", "_at").union(l_rows.where("not _ok").select("_l", "_r", "_at"))
    names = {c: c + suffix if c in left.columns else c for c in columns}
    out = found.select("_l.*", *[F.col(f"_r.{c}").alias(names[c]) for c in columns], "_at")
    if tolerance is not None:
        near = F.col("_at") - _seconds(out, names[at]) <= float(tolerance)
        out = out.select(*left.columns, *[F.when(near, F.col(names[c])).alias(names[c]) for c in columns])
    return out.drop("_at")


def interval_join(points: DataFrame, intervals: DataFrame, at: str, start: str, end: str, by: Sequence[str] = (), *, width: float | None = None) -> DataFrame:
    """Points with every interval of their keys that holds them (start <= at < end); columns of both must differ apart from the keys.

    Times are cut into buckets of one width (the mean length of intervals by
    default); an interval is sent to every bucket that it touches, a point to its
    own.  Null or empty intervals hold nothing.
    """
    by = list(by)
    spans = intervals.withColumn("_s", _seconds(intervals, start)).withColumn("_e", _seconds(intervals, end)).where("_s < _e")
    if width is None:
        mean = spans.agg(F.avg(F.col("_e") - F.col("_s"))).first()[0]
        width = float(mean) if mean else 1.0
    last = F.ceil(F.col("_e") / width).cast("long") - 1
    sent = spans.withColumn("_b", F.explode(F.sequence(F.floor(F.col("_s") / width).cast("long"), last)))
    here = points.withColumn("_at", _seconds(points, at)).withColumn("_b", F.floor(F.col("_at") / width).cast("long"))
    return here.join(sent, [*by, "_b"]).where("_at >= _s and _at < _e").drop("_b", "_at", "_s", "_e")
