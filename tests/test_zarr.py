"""Chunk stores: round trips, other writers' layouts, and which chunks a slice opens."""

import json
import os
import zlib

import numpy as np
import pytest

from voxelframe import ArrayFrame, AxesError, Axis, sources
from voxelframe.sources import zarr

rng = np.random.default_rng(5)


@pytest.mark.parametrize("dtype", ["float32", "uint8", "uint16", "bool", "float64"])
@pytest.mark.parametrize("compressor", ["zlib", None])
def test_round_trip(spark, tmp_path, dtype, compressor):
    x = (rng.random((2, 3, 11, 14)) * 200).astype({"float64": float}.get(dtype, dtype))
    frame = ArrayFrame.from_numpy(spark, x, "tcyx", dtype=dtype).set_axes([Axis("t", 2.0), Axis("c", 1.0, "", ("r", "g", "b")), Axis("y", 0.5, "um"), Axis("x", 0.25, "um")])
    path = f"{tmp_path}/a.zarr"
    zarr.write(frame, path, (4, 6), compressor=compressor)
    back = sources.big_imread(spark, path)
    assert back.grid.chunks == (4, 6) and back.dtype == dtype and back.to_frame().axes.scale == frame.axes.scale and back.batch["c"].labels == ("r", "g", "b")
    np.testing.assert_array_equal(back.to_numpy(), x)
    assert len(os.listdir(f"{path}/data")) == 2 * 3 * 3 * 3 + 1
    meta = sources.read_meta(spark, path)
    assert meta["shape"] == [2, 3, 11, 14] and meta["axes"][2][:3] == ["y", 0.5, "um"]


def test_slices_open_their_chunks_only(spark, tmp_path):
    x = rng.random((3, 20, 30)).astype(np.float32)
    path = f"{tmp_path}/a.zarr"
    sources.imsave(ArrayFrame.from_numpy(spark, x, "tyx").rechunk((6, 7)), path)
    wanted = {f"1.{i}.{j}" for i in (1, 2) for j in (0, 1)}
    for name in os.listdir(f"{path}/data"):
        if name not in wanted and name != ".zarray":
            with open(f"{path}/data/{name}", "wb") as f:
                f.write(b"not a chunk")
    part = sources.big_imread(spark, path, "t=1;y=8:17;x=0:13")
    np.testing.assert_array_equal(part.to_numpy(), x[1, 8:17, :13])
    aligned = sources.big_imread(spark, path, "t=1;y=6:18;x=0:14")
    assert "Exchange" not in aligned.df._jdf.queryExecution().executedPlan().toString()
    np.testing.assert_array_equal(aligned.to_numpy(), x[1, 6:18, :14])
    np.testing.assert_array_equal(sources.imread(spark, path, "t=1;y=7:9;x=1:3").to_numpy(), x[1, 7:9, 1:3])
    with pytest.raises(Exception):
        sources.big_imread(spark, path).to_numpy()


def test_foreign_layout(spark, tmp_path):
    """An array without a group, several places of a batch axis in a chunk, missing chunks, nested names, gzip."""
    x = np.arange(5 * 6 * 7).reshape(5, 6, 7).astype(">i2")
    path = f"{tmp_path}/b.zarr"
    os.makedirs(path)
    with open(f"{path}/.zarray", "w") as f:
        json.dump({"zarr_format": 2, "shape": [5, 6, 7], "chunks": [2, 4, 7], "dtype": ">i2", "compressor": {"id": "zlib", "level": 3}, "fill_value": -1, "order": "C", "filters": None, "dimension_separator": "/"}, f)
    want = x.astype(float)
    for i in range(3):
        for j in range(2):
            if (i, j) == (1, 1):
                want[2:4, 4:] = -1
                continue
            chunk = np.zeros((2, 4, 7), ">i2")
            part = x[2 * i : 2 * i + 2, 4 * j : 4 * j + 4]
            chunk[: part.shape[0], : part.shape[1]] = part
            os.makedirs(f"{path}/{i}/{j}", exist_ok=True)
            with open(f"{path}/{i}/{j}/0", "wb") as f:
                f.write(zlib.compress(chunk.tobytes()))
    with open(f"{path}/.zattrs", "w") as f:
        json.dump({"axes": "tyx"}, f)
    np.testing.assert_array_equal(sources.imread(spark, path).to_numpy(), want)
    np.testing.assert_array_equal(sources.imread(spark, path, "t=3;y=2:5").to_numpy(), want[3, 2:5])
    np.testing.assert_array_equal(sources.roiread(spark, path, {"y": (1, 6)}).to_numpy(), want[:, 1:])


def test_unfinished_and_existing(spark, tmp_path):
    path = f"{tmp_path}/c.zarr"
    frame = ArrayFrame.from_numpy(spark, rng.random((4, 4)), "yx")
    with pytest.raises(FileNotFoundError):
        sources.read_meta(spark, path)
    sources.imsave(frame, path)
    with pytest.raises(Exception):
        sources.imsave(frame, path, overwrite=False)
    os.remove(f"{path}/data/.zarray")  # as if the tasks were done, but the write is not
    with pytest.raises(FileNotFoundError):
        sources.imread(spark, path)
    with pytest.raises(AxesError):
        zarr.write(frame.rechunk(2).map(lambda v: v, "complex64"), path)


def test_recut(spark):
    x = rng.random((2, 13, 17))
    chunks = ArrayFrame.from_numpy(spark, x, "tyx").rechunk((5, 4))
    other = chunks.rechunk((4, 9))
    assert other.grid.chunks == (4, 9)
    np.testing.assert_array_equal(other.to_numpy(), x)
    np.testing.assert_array_equal(chunks.isel(t=1, y=slice(3, -1), x=slice(8, None)).to_numpy(), x[1, 3:-1, 8:])
    np.testing.assert_array_equal(chunks.isel(t=[1, 0, 1]).to_numpy(), x[[1, 0, 1]])
    for bad in ({"y": 3}, {"y": slice(0, 9, 2)}, {"q": 1}, {"y": slice(5, 5)}):
        with pytest.raises(AxesError):
            chunks.isel(**bad)
