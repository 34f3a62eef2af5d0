"""Tracks over all points at once, and joins by time, against one task and brute force."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from voxelframe.operators import points, temporal

rng = np.random.default_rng(8)


def tracks(df):
    return sorted(zip(df["t"], df["y"], df["x"], df["N"]))


@pytest.mark.parametrize("memory", [0, 1, 3])
@pytest.mark.parametrize("size", [6, 25])
def test_all_points_like_one_series(spark, memory, size):
    df = pd.DataFrame({"t": rng.integers(0, 15, 300), "y": rng.random(300) * size, "x": rng.random(300) * size})
    df = spark.createDataFrame(df[df["t"] != 7])  # a frame without points
    got = points.link(df, 2.0, memory=memory).toPandas()
    want = points.link(df.withColumn("k", F.lit(1)), 2.0, memory=memory, by=["k"]).toPandas()
    assert tracks(got) == tracks(want) and got["N"].nunique() < len(got)


def test_planted_tracks(spark):
    """Long chains, three axes, repeated points and points without a place."""
    rows = [(t, 3.0 * k + 0.1 * t, 5.0 + 0.2 * t, 1.0 * k) for k in range(5) for t in range(40)]
    df = spark.createDataFrame([*rows, rows[0], (3, None, 1.0, 1.0), (None, 1.0, 1.0, 1.0)], "t int, z double, y double, x double")
    got = points.link(df, 1.0).toPandas()
    sizes = got.groupby("N").size()
    assert len(got) == len(rows) + 3 and sorted(sizes) == [1, 1, 1, 40, 40, 40, 40, 40]
    assert points.link(df, 1.0, least=2).count() == 200
    assert points.link(df.limit(0), 1.0).count() == 0


def test_candidates_do_not_cross(spark):
    df = spark.range(50).select((F.col("id") % 5).cast("int").alias("t"), F.rand(1).alias("y"), F.rand(2).alias("x"))
    text = points._candidates(df.withColumn("_id", F.monotonically_increasing_id()), ["y", "x"], 0.1, 0, [])._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "NestedLoop" not in text


def as_of(left, right, tolerance=np.inf, strict=False):
    out = []
    for k, t, v in left:
        best = [(u, w) for j, u, w in right if None not in (k, t, j, u) and j == k and (u < t if strict else u <= t)]
        u, w = max(best, default=(None, None))
        out.append((v, w if u is not None and t - u <= tolerance else None))
    return sorted(out)


@pytest.mark.parametrize("rows_each", [None, 300, 9])
def test_as_of(spark, rows_each):
    value = lambda n, top: [None if rng.random() < 0.03 else int(v) for v in rng.integers(0, top, n)]
    left = list(zip(value(700, 3), value(700, 500), range(700)))
    right = list(zip(value(200, 3), value(200, 500), range(200)))
    l_df = spark.createDataFrame(left, "k int, ts int, v int")
    r_df = spark.createDataFrame(right, "k int, ts int, w int")
    for tolerance, strict in ((None, False), (20.0, False), (None, True)):
        got = temporal.as_of_join(l_df, r_df, "ts", ["k"], tolerance=tolerance, strict=strict, rows_each=rows_each)
        assert got.columns == ["k", "ts", "v", "ts_right", "w"]
        assert sorted((r.v, r.w) for r in got.collect()) == as_of(left, right, tolerance or np.inf, strict)
    alone = temporal.as_of_join(l_df.drop("k"), r_df.drop("k"), "ts", rows_each=rows_each)
    assert sorted((r.v, r.w) for r in alone.collect()) == as_of([(0, t, v) for _, t, v in left], [(0, t, w) for _, t, w in right])
    assert temporal.as_of_join(l_df, r_df.limit(0), "ts", ["k"]).where("w is not null").count() == 0
    assert temporal.as_of_join(l_df.limit(0), r_df, "ts", ["k"]).count() == 0


def test_a_frequent_key_is_cut(spark):
    """No group of the window holds much more than a bucket's rows, though all rows have one key."""
    rows = spark.range(20_000).select(F.lit(1).alias("k"), F.col("id").alias("_at"))
    edges = temporal._edges(rows.select(F.col("_at").cast("double")), 1000)
    sizes = [r["count"] for r in rows.withColumn("b", temporal._bucket(edges)).groupBy("b").count().collect()]
    assert len(sizes) == 20 and max(sizes) < 1500
    near = [0.5, 2.0, 2.0 + 1e-9]
    got = spark.createDataFrame([(v,) for v in (0.0, 0.5, 1.0, 2.0, 3.0)], "_at double").withColumn("b", temporal._bucket(near)).collect()
    assert [r.b for r in got] == [0, 1, 1, 2, 3]


def test_intervals(spark):
    at = [(int(k), float(t), i) for i, (k, t) in enumerate(zip(rng.integers(0, 3, 200), rng.random(200) * 100))]
    spans = [(int(k), float(s), float(s + w), i) for i, (k, s, w) in enumerate(zip(rng.integers(0, 3, 60), rng.random(60) * 100, rng.choice([0, 1, 5, 60], 60)))]
    p = spark.createDataFrame([*at, (1, None, -1)], "k int, t double, i int")
    q = spark.createDataFrame([*spans, (1, None, 5.0, -1), (1, 9.0, 3.0, -2)], "k int, a double, b double, j int")
    want = sorted((i, j) for k, t, i in at for m, a, b, j in spans if k == m and a <= t < b)
    for width in (None, 3.0, 500.0):
        assert sorted((r.i, r.j) for r in temporal.interval_join(p, q, "t", "a", "b", ["k"], width=width).collect()) == want
    assert temporal.interval_join(p, q.limit(0), "t", "a", "b", ["k"]).count() == 0
