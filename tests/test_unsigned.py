"""Unsigned arithmetic as numpy does it, and places outside of an axis."""

import warnings

import numpy as np
import pytest

from voxelframe import ArrayFrame, sources

rng = np.random.default_rng(4)


@pytest.mark.parametrize("dtype", [np.uint8, np.uint16])
def test_like_numpy(spark, dtype):
    x = np.concatenate([[0, 1, 2, 200, np.iinfo(dtype).max], rng.integers(0, np.iinfo(dtype).max, 19)]).astype(dtype).reshape(4, 6)
    a = ArrayFrame.from_numpy(spark, x, "yx")
    with np.errstate(all="ignore"):
        for got, want in (
            (a**2, x**2), (-a, -x), (a // 3, x // 3), (a % 7, x % 7), (a - dtype(5), x - dtype(5)), (a + np.uint8(9), x + np.uint8(9)),
            (a // 2.5, x // np.float32(2.5)), (a % 2.5, x % np.float32(2.5)), (a * 0.5, x * np.float32(0.5)), (a**0.5, x ** np.float32(0.5)),
            (250 // (a + 1), 250 // (x + dtype(1))), (250 % (a * 2 + 1), 250 % (x * dtype(2) + dtype(1))), (3 - a, dtype(3) - x),
        ):
            assert got.dtype == ("float32" if want.dtype.kind == "f" else str(x.dtype)), got
            want = np.where(np.isfinite(want), want, 0)
            np.testing.assert_allclose(got.to_numpy(), want, rtol=1e-4)
    small = ArrayFrame.from_numpy(spark, np.arange(8, dtype=np.uint8).reshape(2, 4), "yx")
    np.testing.assert_array_equal((2**small).to_numpy(), 2 ** np.arange(8).reshape(2, 4))
    np.testing.assert_allclose((2.5 % small).to_numpy(), np.where(np.arange(8) == 0, 0, 2.5 % np.maximum(np.arange(8), 1)).reshape(2, 4))


def test_places_outside(spark, tmp_path):
    x = rng.random((3, 2, 4, 5))
    a = ArrayFrame.from_numpy(spark, x, "tcyx")
    for frame in (a, a + 1, a.gaussian_filter(1.0), a["t=0:3"], sources.zeros(spark, (3, 2, 4, 5), "tcyx")):
        for bad in ({"t": 3}, {"t": [0, 3]}, {"t": -4}, {"c": 2}):
            with pytest.raises(IndexError):
                frame.isel(**bad)
    with pytest.raises(IndexError):
        a["t=9"]
    assert a["t=1:3"].known == {"t": 2, "c": 2} and a.isel(t=[2, 0]).known == {"t": 2, "c": 2} and a["t=0"].known == {"c": 2}
    with pytest.raises(IndexError):
        a["t=1:3"].isel(t=2)
    sources.imsave(a, f"{tmp_path}/a")
    with pytest.raises(IndexError):
        sources.imread(spark, f"{tmp_path}/a").isel(t=3)
    np.testing.assert_allclose(sources.imread(spark, f"{tmp_path}/a").isel(t=-1).to_numpy(), x[2])


def test_missing_arrays_are_told(spark):
    a = ArrayFrame.from_numpy(spark, rng.random((3, 2, 2)) + 1, "tyx")
    holes = ArrayFrame(a.df.where("t <> 1"), "t", "yx", (2, 2))
    with pytest.warns(UserWarning, match="1 of 3"):
        assert (holes.to_numpy()[1] == 0).all()
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        a.to_numpy()
