"""Arrays in chunks equal whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe import ArrayFrame, AxesError, graph
from voxelframe.chunks import Grid

rng = np.random.default_rng(3)


@pytest.fixture(scope="module")
def plane(spark):
    x = rng.normal(size=(1, 512, 512)).round(3)
    return x, ArrayFrame.from_numpy(spark, x, "pyx"), ArrayFrame.from_numpy(spark, x, "pyx").rechunk((200, 130))


def test_grid():
    grid = Grid((10, 7), (4, 7))
    assert grid.count == (3, 1) and grid.size((2, 0)) == (2, 7) and grid.halo((0, 0), (3, 3), False) == [(0, 7), (0, 7)]
    for depth in ((1, 0), (3, 2), (9, 7)):
        for periodic in (False, True):
            seen = np.zeros((3, 40, 40))
            for at in np.ndindex(grid.count):
                for target, box, part in grid.strips(at, depth, periodic):
                    seen[target[0]][tuple(slice(a + 15, b + 15) for a, b in box)] += 1
            for k in range(3):
                want = np.zeros((40, 40))
                want[tuple(slice(a + 15, b + 15) for a, b in grid.halo((k, 0), depth, periodic))] = 1
                want[tuple(slice(a + 15, b + 15) for a, b in grid.region((k, 0)))] = 0
                assert (seen[k] == want).all()


def test_filters_of_a_large_plane(plane):
    x, whole, chunks = plane
    np.testing.assert_allclose(chunks.to_numpy(), x)
    smooth = chunks.apply("gaussian_filter", 2.0, depth=8)
    np.testing.assert_allclose(smooth.to_numpy(), whole.gaussian_filter(2.0).to_numpy())
    np.testing.assert_allclose(smooth.apply("erosion", 1, depth=1).to_numpy(), whole.gaussian_filter(2.0).erosion(1).to_numpy())
    np.testing.assert_allclose(chunks.map(lambda v: v * 2).to_numpy(), x * 2)
    for how in ("otsu", "mean", "70%", 0.25):
        assert (smooth.threshold(how).to_numpy() == whole.gaussian_filter(2.0).threshold(how).to_numpy()).all()


def test_labels_of_a_large_plane(plane):
    _, whole, chunks = plane
    mask, chunked = whole.gaussian_filter(2.0).threshold("60%"), chunks.apply("gaussian_filter", 2.0, depth=8).threshold("60%")
    want = mask.label(connectivity=1).to_numpy()
    assert want.max() > 100 and (chunked.label(1).to_numpy() == want).all()


@pytest.mark.parametrize("shape,cut", [((9, 30), (4, 7)), ((5, 8, 9), (2, 3, 9))])
def test_small_labels(spark, shape, cut):
    """Spirals and equal values through many chunks; several arrays."""
    x = rng.integers(0, 3, (3, *shape))
    x[1] = 1
    x[2] = 0
    axes = "tzyx"[-len(shape) :]
    frame = ArrayFrame.from_numpy(spark, x, "p" + axes)
    for connectivity in (1, None):
        assert (frame.rechunk(cut).label(connectivity).to_numpy() == frame.label(connectivity=connectivity).to_numpy()).all()


def test_only_strips_are_shuffled(spark, plane):
    """The chunks are read from buckets; of joins by their keys only the other side is exchanged, in every further operator."""
    _, _, chunks = plane
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = chunks.apply("gaussian_filter", 1.0, depth=4).apply("median_filter", 1, depth=1)
        text = out.df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    left, right = text.split("SortMergeJoin", 1)[1].split("+- Sort", 1)
    assert "Exchange" not in left and "FileScan" in left and right.count("Exchange") == 1 and "strips(" in right


def test_boundaries(spark):
    x = rng.normal(size=(2, 11, 9))
    chunks = ArrayFrame.from_numpy(spark, x, "pyx").rechunk((4, 5))
    for boundary, mode in (("reflect", "symmetric"), ("nearest", "edge"), ("periodic", "wrap")):
        wide = np.pad(x, [(0, 0), (6, 6), (2, 2)], mode)
        got = chunks.map_overlap(lambda v: v + 2 * np.roll(v, 6, 1) + np.roll(v, -2, 2), (6, 2), boundary).to_numpy()
        np.testing.assert_allclose(got, x + 2 * wide[:, :11, 2:11] + wide[:, 6:17, 4:], err_msg=boundary)
    with pytest.raises(ValueError):
        chunks.map_overlap(lambda v: v, 12)
    with pytest.raises(ValueError):
        chunks.map_overlap(lambda v: v, 1, "mirror")
    with pytest.raises(Exception, match="kernel made"):
        chunks.map_overlap(lambda v: v[:, 1:], 1).to_numpy()


@pytest.mark.parametrize("dtype", [np.float32, np.int16, np.uint8, np.uint16])
def test_tiles(spark, dtype):
    x = (rng.random((20, 24, 21)) * 100).astype(dtype)
    frame = ArrayFrame.from_numpy(spark, x, "zyx")
    tiles, chunks = frame.tiled((10, 9, 8), overlap=6), frame.rechunk((10, 9, 8)).tiled(overlap=6)
    for name, args in (("gaussian_filter", (1.0,)), ("dog_filter", (0.5,)), ("log_filter", (0.8,)), ("median_filter", (1,))):
        a, b = getattr(tiles, name)(*args), getattr(chunks, name)(*args)
        assert a.dtype == b.dtype
        np.testing.assert_allclose(a.to_numpy(), b.to_numpy(), atol=1e-9)
    np.testing.assert_allclose(tiles.gaussian_filter(1.0).to_numpy(), frame.gaussian_filter(1.0).to_numpy(), atol=1e-9)
    assert frame.tiled((10, 9, 8), boundary="none").lowpass_filter(0.2).to_numpy().shape == x.shape
    with pytest.raises(TypeError):
        tiles.pixels()
    with pytest.raises(AttributeError):
        tiles.nothing_of_this_name()


def test_reductions(spark):
    x = rng.normal(size=(2, 13, 7)) + 1e6
    chunks = ArrayFrame.from_numpy(spark, x, "pyx").rechunk(5)
    for how, f in (("mean", np.mean), ("std", np.std), ("var", np.var), ("max", np.max), ("min", np.min), ("sum", np.sum), ("ptp", np.ptp)):
        got = [r.value for r in chunks.reduce(how).orderBy("p").collect()]
        np.testing.assert_allclose(got, f(x, axis=(1, 2)), rtol=1e-9)
    pixels = chunks.pixels().toPandas()
    np.testing.assert_allclose(pixels["value"], x[pixels["p"], pixels["y"], pixels["x"]])
    with pytest.raises(AxesError):
        chunks.map(lambda v: v, "float32").to_frame()["q=1"]


def test_components_and_ranks(spark):
    edges = [("a", i, i + 1) for i in range(40) if i not in (7, 20)] + [("b", 5, 9), ("b", 9, 2), ("b", 3, 3)]
    got = {(r.k, r.node): r.root for r in graph.components(spark.createDataFrame(edges, "k string, a long, b long"), ["k"]).collect()}
    want = {("a", i): 0 if i <= 7 else 8 if i <= 20 else 21 for i in range(41)} | {("b", i): 2 for i in (2, 5, 9)}
    assert got == want
    assert graph.components(spark.createDataFrame([], "k string, a long, b long"), ["k"]).count() == 0
    df = spark.range(500).select((F.col("id") % 3).alias("k"), (F.col("id") * 37).alias("place"))
    rows = graph.ranked(df, ["k"], "place", block=1000).collect()
    for k in range(3):
        own = sorted((r.place, r.rank) for r in rows if r.k == k)
        assert [r for _, r in own] == list(range(1, len(own) + 1))
