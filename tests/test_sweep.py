"""Parameter sweeps, assignment, contractions and sketches against numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelframe import ArrayFrame, AxesError
from voxelframe.operators import sweep

rng = np.random.default_rng(6)


def frame(spark, shape=(3, 2, 5, 6), axes="tcyx", dtype=None):
    x = rng.normal(size=shape).round(3) if dtype is None else rng.integers(0, 200, shape).astype(dtype)
    return x, ArrayFrame.from_numpy(spark, x, axes)


def test_for_params(spark):
    _, a = frame(spark)
    out = a.for_params("gaussian_filter", sigma=[2.0, 0.5, 1.0])
    assert str(out.batch) == "vtc" and out.batch["v"].labels == (2.0, 0.5, 1.0)
    for i, s in enumerate((2.0, 0.5, 1.0)):
        np.testing.assert_allclose(out.isel(v=i).to_numpy(), a.gaussian_filter(s).to_numpy())
    np.testing.assert_allclose(out.sel(v=0.5).to_numpy(), a.gaussian_filter(0.5).to_numpy())
    one = a.for_params("threshold", var={"how": [0.0, 0.5]}, axis="k")
    assert one.dtype == "bool" and "Exchange" not in one.df._jdf.queryExecution().executedPlan().toString().split("Scan")[0]
    for bad in ({}, {"sigma": [1], "dims": ["yx"]}, {"var": {"sigma": [1]}, "sigma": 2}):
        with pytest.raises(ValueError):
            a.for_params("gaussian_filter", **bad)
    with pytest.raises(AxesError):
        a.for_params("gaussian_filter", sigma=[1], axis="t")


def test_for_each_channel(spark):
    _, a = frame(spark)
    out = a.for_each_channel("gaussian_filter", sigma=[0.5, 2.0]).to_numpy()
    for i, s in enumerate((0.5, 2.0)):
        np.testing.assert_allclose(out[:, i], a.isel(c=i).gaussian_filter(s).to_numpy())
    np.testing.assert_allclose(a.for_each_channel("gaussian_filter", "t", sigma=1.0).to_numpy(), a.gaussian_filter(1.0).to_numpy())
    with pytest.raises(ValueError):
        a.for_each_channel("gaussian_filter", sigma=[1.0, 2.0, 3.0])
    with pytest.raises(AxesError):
        a.for_each_channel("gaussian_filter", "z", sigma=1.0)


def test_assign_numbers(spark):
    for dtype in (None, np.uint8):
        x, a = frame(spark, dtype=dtype)
        for key, index in (
            ({"t": 1, "y": slice(1, 4)}, np.s_[1, :, 1:4]), ({"y": slice(None, None, -2), "x": [0, 5]}, np.s_[:, :, ::-2, [0, 5]]),
            ({"t": [0, 2], "x": -1}, np.s_[[0, 2], ..., -1]), ({}, np.s_[:]), ({"t": slice(1, None), "c": 0, "y": 2, "x": 3}, np.s_[1:, 0, 2, 3]), ({"t": slice(None, None, -2)}, np.s_[::-2]),
        ):
            want = x.copy()
            want[index] = 7
            np.testing.assert_allclose(a.assign(key, 7).to_numpy(), want, err_msg=str(key))
    _, a = frame(spark, dtype=np.uint8)
    assert a.assign("t=0", 300).to_numpy()[0].max() == 255 and a.assign("t=0", -3).to_numpy()[0].min() == 0
    with pytest.raises(IndexError):
        a.assign({"y": 9}, 1)
    with pytest.raises(AxesError):
        a.assign({"q": 0}, 1)


def test_assign_frames_and_masks(spark):
    x, a = frame(spark)
    y, b = frame(spark, (2, 3, 6), "cyx")
    want = x.copy()
    want[1:, :, 1:4] = y
    np.testing.assert_allclose(a.assign({"t": slice(1, None), "y": slice(1, 4)}, b).to_numpy(), want)
    z, c = frame(spark, (3, 5), "ty")
    want = x.copy()
    want[:, 1, :, 2] = z
    np.testing.assert_allclose(a.assign({"c": 1, "x": 2}, c).to_numpy(), want)
    mask = a > 0.3
    np.testing.assert_allclose(a.assign(mask, -1).to_numpy(), np.where(x > 0.3, -1, x))
    other, o = frame(spark, (2, 5, 6), "cyx")
    np.testing.assert_allclose(a.assign(mask, o).to_numpy(), np.where(x > 0.3, other[None], x))
    first = a.isel(t=0) < 0
    np.testing.assert_allclose(a.assign(first, 9).to_numpy(), np.where(x[:1] < 0, 9, x))
    before = a + 0
    a["t=2;y=0:2"] = 5.5
    want = x.copy()
    want[2, :, :2] = 5.5
    np.testing.assert_allclose(a.to_numpy(), want)
    np.testing.assert_allclose(before.to_numpy(), x)
    with pytest.raises(AxesError):
        a.assign({"y": slice(0, 2)}, b)
    with pytest.raises(AxesError):
        a.assign({"t": 0}, ArrayFrame.from_numpy(spark, np.zeros((3, 5, 6)), "tyx"))


def test_tensordot(spark):
    x, a = frame(spark, (3, 2, 4, 5), "tcyx")
    y, b = frame(spark, (3, 4, 4, 6), "tpyz")
    out = a.tensordot(ArrayFrame.from_numpy(spark, y, "tpyz", space="yz"), "ty")
    assert str(out.axes) == "cpxz"
    np.testing.assert_allclose(out.to_numpy(), np.tensordot(x, y, ([0, 2], [0, 2])).transpose(0, 2, 1, 3))
    v, w = frame(spark, (5, 4), "yx")
    np.testing.assert_allclose(a.tensordot(ArrayFrame.from_numpy(spark, v, "xz", space="xz"), "x").to_numpy(), np.tensordot(x, v, ([3], [0])))
    full = a.tensordot(a, "tcyx").df.collect()
    np.testing.assert_allclose(full[0]["data"], [(x * x).sum()])
    for bad in ("q", "c"):
        with pytest.raises(AxesError):
            a.tensordot(ArrayFrame.from_numpy(spark, y, "tpyz", space="yz"), bad)
    with pytest.raises(AxesError):
        a.tensordot(a, "t")


def test_corrcoef(spark):
    x, a = frame(spark, (2, 3, 4, 5), "tcyx")
    x[1, 2] = 1.0
    a = ArrayFrame.from_numpy(spark, x, "tcyx")
    for rows in (a.corrcoef("c").collect(), ArrayFrame.from_numpy(spark, x, "tcyx", space="cyx").corrcoef("c").collect()):
        assert len(rows) == 12
        for r in rows:
            u, v = x[r["t"], r["c"]].ravel(), x[r["t"], r["c_2"]].ravel()
            if np.ptp(u) and np.ptp(v):
                np.testing.assert_allclose(r["value"], np.corrcoef(u, v)[0, 1])
            else:
                assert r["value"] is None


def test_sketches(spark):
    x = rng.integers(0, 5000, (6, 64, 64)).astype(float)
    a = ArrayFrame.from_numpy(spark, x, "tyx")
    kept = a.sketches()
    for rows, parts in ((sweep.estimated(kept, (0.1, 0.5, 0.9)).collect(), [x[r] for r in range(6)]), (sweep.estimated(sweep.merged(kept, "t"), (0.1, 0.5, 0.9)).collect(), [x])):
        rows = sorted(rows, key=lambda r: r["t"] if "t" in r.asDict() else 0)
        for r, part in zip(rows, parts, strict=True):
            assert r["n"] == part.size and abs(r["n_distinct"] / len(np.unique(part)) - 1) < 0.08
            for q in (0.1, 0.5, 0.9):
                assert abs((part <= r[f"q{q * 100:g}"]).mean() - q) < 0.03
    assert a.df.select(F.size("data")).first()[0] == 4096
