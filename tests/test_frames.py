import math

import numpy as np
import pytest
from pyspark.sql import functions as F

import voxelframe  # noqa: F401
from voxelframe import ArrayFrame, AxesError, sources, slicer
from voxelframe.bind import DataDict, DataList, bound
from voxelframe.operators import correlation, points
from voxelframe.operators.image import concatenate, stack, stack_relaxed
from voxelframe.operators.phase import PhaseFrame

rng = np.random.default_rng(1)


def frame(spark, shape=(2, 3, 6, 8), axes="tcyx", dtype=None):
    x = rng.normal(size=shape).round(3)
    return x, ArrayFrame.from_numpy(spark, x, axes, dtype=dtype)


def test_round_trips(spark, tmp_path):
    x, a = frame(spark)
    np.testing.assert_allclose(a.to_numpy(), x)
    b = ArrayFrame.from_pixels(a.pixels(), "tc", "yx", (6, 8))
    np.testing.assert_allclose(b.to_numpy(), x)
    a = a.set_scale(yx=0.25).set_labels(c=["r", "g", "b"])
    sources.imsave(a, f"{tmp_path}/a", partition_by="t")
    back = sources.imread(spark, f"{tmp_path}/a")
    assert back.axes == a.axes and sources.read_meta(spark, f"{tmp_path}/a")["shape"] == [6, 8]
    np.testing.assert_allclose(back.to_numpy(), x)
    np.testing.assert_allclose(sources.imread(spark, f"{tmp_path}/a", "t=1;y=2:4").to_numpy(), x[1][:, 2:4])
    with pytest.raises(Exception):
        sources.imsave(a, f"{tmp_path}/a", overwrite=False)


@pytest.mark.parametrize("ending", [".npy", ".npz", ".mrc", ".tif"])
def test_array_files(spark, tmp_path, ending):
    x = rng.normal(size=(4, 5, 6)).astype(np.float32)
    a = ArrayFrame.from_numpy(spark, x, "zyx").set_scale(zyx=0.5)
    sources.write_file(a, f"{tmp_path}/f{ending}")
    b = sources.imread(spark, f"{tmp_path}/f{ending}")
    np.testing.assert_allclose(b.to_numpy(), x, rtol=1e-6)
    if ending != ".npy":
        assert b.axes.scale["z"] == pytest.approx(0.5)


def test_file_stacks(spark, tmp_path):
    for t in (2, 10):
        for z in (0, 1):
            np.save(f"{tmp_path}/i_t{t}_z{z}.npy", np.full((3, 4), t * 10 + z))
    a = sources.read_files(spark, f"{tmp_path}/i_t$t_z$z.npy")
    assert a.to_numpy()[:, :, 0, 0].tolist() == [[20, 21], [100, 101]]
    assert sources.read_files(spark, f"{tmp_path}/i_*.npy").sizes()["p"] == 4
    (tmp_path / "i_t2_z0.npy").unlink()
    with pytest.raises(AxesError):
        sources.read_files(spark, f"{tmp_path}/i_t$t_z$z.npy")


def test_slices(spark):
    x, a = frame(spark)
    for key, want in (("t=1", x[1]), ("y=1:5:2;x=N//2:", x[:, :, 1:5:2, 4:]), ("c=2,0", x[:, [2, 0]]), ("x=-1", x[..., -1]), ("c=N-1", x[:, 2])):
        np.testing.assert_allclose(a[key].to_numpy(), want)
    np.testing.assert_allclose(a[slicer.t[0].c[1]].to_numpy(), x[0, 1])
    assert a["y=0:6:2"].axes.scale["y"] == 2
    assert a.set_labels(c=["r", "g", "b"]).sel(c=["b", "r"]).axes["c"].labels == ("b", "r")
    with pytest.raises(AxesError):
        a["q=1"]
    with pytest.raises(IndexError):
        a["y=6"]


def test_arithmetic_and_types(spark):
    x, a = frame(spark)
    y, b = frame(spark, (3, 6, 8), "cyx")
    np.testing.assert_allclose((a + b).to_numpy(), x + y)
    np.testing.assert_allclose((a * 2 - 1).to_numpy(), x * 2 - 1)
    assert ((a > 0) & (a < 1)).to_numpy().sum() == ((x > 0) & (x < 1)).sum()
    with pytest.raises(AxesError):
        b + a
    with pytest.raises(ZeroDivisionError):
        a / 0
    v = ArrayFrame.from_numpy(spark, np.array([[-3.0, 0.5, 254.6, 300.0]]), "yx")
    assert v.as_type("uint8").to_numpy().ravel().tolist() == [0, 1, 255, 255]
    assert v.as_type("uint16").as_type("uint8").to_numpy().ravel().tolist() == [0, 0, 0, 1]


def test_reductions(spark):
    x, a = frame(spark)
    for how in ("mean", "sum", "min", "max", "std", "median"):
        for axis, over in (("t", (0,)), ("yx", (2, 3)), ("cy", (1, 2)), (None, (0, 1, 2, 3))):
            np.testing.assert_allclose(a.reduce(how, axis).to_numpy(), getattr(np, how)(x, axis=over), atol=1e-9)
    m = x[0, 0] > 0
    got = a.reduce("mean", "yx", mask=ArrayFrame.from_numpy(spark, m, "yx")).to_numpy()
    np.testing.assert_allclose(got, x[..., ~m].mean(-1), atol=1e-9)
    with pytest.raises(ValueError):
        a.binning(4)
    assert a.binning(4, check_edges=False).shape == (1, 2)


def test_stacks(spark):
    x, a = frame(spark, (6, 8), "yx")
    s = stack([a, a + 1], "t")
    assert str(s.axes) == "tyx"
    np.testing.assert_allclose(s.to_numpy(), [x, x + 1])
    np.testing.assert_allclose(concatenate([s, s], "t").to_numpy()[2:], [x, x + 1])
    big = stack_relaxed([a, a["y=0:3"]])
    assert big.shape == (6, 8) and big.to_numpy()[1, 3:].sum() == 0
    with pytest.raises(AxesError):
        stack([a, a["y=0:3"]])


def test_volumes_and_dims(spark):
    x, a = frame(spark, (2, 5, 6, 7), "tzyx")
    flat = a.gaussian_filter(1.0, dims=2).to_numpy()
    one = ArrayFrame.from_numpy(spark, x[1, 2], "yx").gaussian_filter(1.0).to_numpy()
    np.testing.assert_allclose(flat[1, 2], one, atol=1e-9)
    assert not np.allclose(a.gaussian_filter(1.0).to_numpy(), flat)
    assert a.median_filter(1).shape == (5, 6, 7)


@pytest.mark.parametrize("name, args", [("gabor_filter", ()), ("doh_filter", ()), ("hessian_angle", ()), ("corner_harris", ()), ("rof_filter", ()), ("wavelet_denoising", ()), ("skeletonize", ()), ("convex_hull", ()), ("area_closing", (4,)), ("diameter_opening", (3,)), ("smooth_mask", ()), ("lbp", ()), ("rotate", (30,)), ("stretch", (1.5,)), ("highpass_filter", ()), ("bandpass_filter", ()), ("lowpass_conv_filter", ()), ("spline_filter", ()), ("remove_large_objects", (1,)), ("remove_fine_objects", (4,)), ("rolling_ball", (3,)), ("edge_grad", ())])
def test_smoke(spark, name, args):
    x = rng.random((2, 12, 12))
    a = ArrayFrame.from_numpy(spark, x, "tyx")
    if name in ("skeletonize", "convex_hull", "smooth_mask", "remove_large_objects", "remove_fine_objects", "area_closing", "diameter_opening"):
        a = a > 0.4
    got = getattr(a, name)(*args).to_numpy()
    assert got.shape == x.shape and np.isfinite(np.asarray(got, float)).all()


def test_objects(spark):
    x = np.zeros((2, 20, 20))
    x[0, 2:6, 2:6], x[0, 10:15, 9:12], x[1, 3:9, 3:9] = 2, 3, 5
    a = ArrayFrame.from_numpy(spark, x, "tyx")
    lab = (a > 0).label()
    rows = {(r["t"], r["N"], r["prop"]): r["value"] for r in a.regionprops(lab, ("area", "intensity_mean", "centroid", "perimeter", "eccentricity", "solidity", "euler_number")).collect()}
    assert rows[0, 0, "area"] == 16 and rows[0, 1, "intensity_mean"] == 3 and rows[1, 0, "centroid-0"] == 5.5
    assert rows[0, 0, "solidity"] == 1 and rows[0, 0, "euler_number"] == 1 and rows[1, 0, "eccentricity"] == 0
    assert lab.unique_labels().to_numpy()[1].max() == 3
    assert sorted(lab.delete_label(1).to_numpy()[0].ravel().tolist())[-1] == 2
    assert a.extract(lab).count() == 3
    assert lab.expand_labels(1).to_numpy()[1].astype(bool).sum() == 60


def test_points(spark):
    y, x = np.mgrid[:30, :30]
    image = sum(np.exp(-0.5 * ((y - a) ** 2 + (x - b) ** 2) / 2) for a, b in ((8, 9), (20, 18)))
    a = ArrayFrame.from_numpy(spark, image[None], "tyx")
    found = sorted((r["y"], r["x"]) for r in a.find_sm(1.5, percentile=90).collect())
    assert found == [(8, 9), (20, 18)]
    pts = spark.createDataFrame([(0, 8, 9), (0, 20, 18)], "t int, y int, x int")
    for r in a.centroid_sm(pts, radius=3).collect():
        assert min(abs(r["y"] - 8), abs(r["y"] - 20)) < 0.05
    v = {(r["y"], r["x"]): r["value"] for r in a.pointprops(spark.createDataFrame([(0, 8.5, 9.25)], "t int, y double, x double")).collect()}
    assert v[8.5, 9.25] == pytest.approx(0.5 * (0.75 * image[8, 9] + 0.25 * image[8, 10]) + 0.5 * (0.75 * image[9, 9] + 0.25 * image[9, 10]))


def test_tracks(spark):
    rows = [(t, float(10 * k + 0.5 * t), float(k)) for t in range(6) for k in range(3) if not (t == 3 and k == 1)]
    pts = spark.createDataFrame(rows, "t int, y double, x double")
    assert points.link(pts, 2).select("N").distinct().count() == 4
    tracks = points.link(pts, 2, memory=1)
    assert tracks.select("N").distinct().count() == 3
    assert points.filter_stubs(tracks, 6).select("N").distinct().count() == 2
    lag = {r["lag"]: r["msd"] for r in points.emsd(tracks, 3).collect()}
    assert lag[1] == pytest.approx(0.25) and lag[2] == pytest.approx(1.0)
    assert points.select(pts, "t=0:2").count() == 6
    drift = points.track_drift(tracks).orderBy("t").collect()
    assert drift[0]["y"] == 0 and drift[1]["y"] == pytest.approx(-0.5)


def test_correlation(spark):
    x, a = frame(spark, (3, 8, 8), "tyx")
    y, b = frame(spark, (3, 8, 8), "tyx")
    got = {r["t"]: r["value"] for r in correlation.zncc(a, b).collect()}
    assert got[1] == pytest.approx(np.corrcoef(x[1].ravel(), y[1].ravel())[0, 1])
    assert all(r["value"] == pytest.approx(1) for r in correlation.fsc(a, a, 0.1).collect())
    assert all(r["value"] == pytest.approx(1) for r in correlation.fourier_zncc(a, a).collect())
    shifted = a.map(lambda v: np.roll(v, (1, 2), (1, 2)))
    assert {(r["d_y"], r["d_x"]) for r in correlation.pcc_maximum(shifted, a, 1).collect()} == {(1.0, 2.0)}


def test_drift(spark):
    base = np.exp(-0.5 * ((np.mgrid[:24, :24] - 12) ** 2).sum(0) / 6)
    x = np.stack([np.roll(base, (t, -t), (0, 1)) for t in range(4)])
    a = ArrayFrame.from_numpy(spark, x, "tyx")
    rows = a.drift("t", upsample=1).orderBy("t").collect()
    assert [(r["d_y"], r["d_x"]) for r in rows] == [(t, -t) for t in range(4)]
    fixed = a.drift_correction("t", zero_average=False, upsample=1).to_numpy()
    np.testing.assert_allclose(fixed[3, 6:18, 6:18], base[6:18, 6:18], atol=1e-6)


def test_phases(spark):
    x = np.array([[3.0, -3.1], [3.1, 3.14]])
    p = PhaseFrame(ArrayFrame.from_numpy(spark, x[None], "tyx"))
    assert ((p + 1).frame.to_numpy() < math.pi).all()
    got = p.regionprops(ArrayFrame.from_numpy(spark, np.ones((1, 2, 2), int), "tyx")).first()
    assert abs(abs(got["phase_mean"]) - math.pi) < 0.15 and got["phase_std"] < 0.3
    assert p.rad2deg().border == (-180, 180)
    with pytest.raises(ValueError):
        p.deg2rad()


def test_bind_and_collections(spark):
    x, a = frame(spark, (2, 4, 4), "tyx")

    def spread(v):
        return v.max() - v.min()

    with bound(spread, kind="property"):
        assert {round(r["value"], 6) for r in a.spread().collect()} == {round(float(v.max() - v.min()), 6) for v in x}
    assert not hasattr(a, "spread")
    with pytest.raises(AttributeError), bound(spread, "median_filter"):
        pass
    both = DataList([a, a + 1]).reduce("max", "tyx")
    assert [float(b.to_numpy().ravel()[0]) for b in both] == pytest.approx([x.max(), x.max() + 1])
    assert set(DataDict(u=a).apply(lambda f: f.shape)) == {"u"}
    with pytest.raises(TypeError):
        DataList([1, "a"])


def test_generators(spark):
    assert sources.ones(spark, (2, 3, 4), "tyx").to_numpy().sum() == 24
    r = sources.random(spark, (3, 4, 5), "tyx", "uint8", seed=5)
    np.testing.assert_array_equal(r.to_numpy(), sources.random(spark, (3, 4, 5), "tyx", "uint8", seed=5).to_numpy())
    assert sources.circular_mask(4, (19, 19)).sum() == 19 * 19 - sources.circular_mask(4, (19, 19), out_value=False).sum()
    assert sources.gaussian_kernel((15, 18), (2, 3)).shape == (15, 18)


def test_streams(spark, tmp_path):
    from voxelframe.streaming import kalman, windowed

    rows = [(k, t, float(t * (k + 1))) for k in range(2) for t in range(5)]
    spark.createDataFrame(rows, "k int, t int, v double").coalesce(1).write.parquet(f"{tmp_path}/in")
    src = spark.readStream.schema("k int, t int, v double").parquet(f"{tmp_path}/in")
    q = kalman(src, "k", "t", "v").writeStream.format("memory").queryName("est").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r["k"], r["t"]): r["estimate"] for r in spark.table("est").collect()}
    est = 0.0
    for t in range(5):
        est = t * 2.0 if t == 0 else 0.8 * est + 0.2 * t * 2 + (t * 2 - est) / (t + 1)
        assert got[1, t] == pytest.approx(est)
    events = spark.createDataFrame([("2024-01-01 00:10:00", 1.0), ("2024-01-01 00:50:00", 3.0), ("2024-01-01 01:10:00", 5.0)], "ts string, v double").withColumn("ts", F.to_timestamp("ts"))
    assert sorted(r["mean"] for r in windowed(events, "ts", "v", []).collect()) == [2.0, 5.0]


def test_large_slices(spark):
    """Slices that keep many values, as the values say and not only the shape."""
    for n in (100, 300):
        x = rng.normal(size=(2, n, n)).round(3)
        a = ArrayFrame.from_numpy(spark, x, "tyx")
        for key, want in (("y=0:80;x=10:90", x[:, :80, 10:90]), ("y=5:N:2;x=1:N:3", x[:, 5::2, 1::3]), ("x=7", x[:, :, 7])):
            np.testing.assert_allclose(a[key].to_numpy(), want)
            assert a[key].pixels().count() == want.size
        np.testing.assert_allclose(a.isel(y=[3, 99, 4, 4], x=slice(None, None, -1)).to_numpy(), x[:, [3, 99, 4, 4], ::-1])
        np.testing.assert_allclose(a.isel(y=slice(0, 80)).reduce("mean").to_numpy(), x[:, :80].mean())
        np.testing.assert_allclose(a.remove_edges(3).to_numpy(), x[:, 3:-3, 3:-3])
    assert a.isel(y=slice(5, 5)).shape == (0, 300)


def test_batch_positions(spark):
    x, a = frame(spark)
    np.testing.assert_allclose(a.isel(t=-1).to_numpy(), x[-1])
    np.testing.assert_allclose(a.isel(c=[-1, 0]).to_numpy(), x[:, [-1, 0]])
    np.testing.assert_allclose(a.isel(c=[0, 2, 2, 1]).to_numpy(), x[:, [0, 2, 2, 1]])
    np.testing.assert_allclose(a.isel(c=slice(None, None, -1)).to_numpy(), x[:, ::-1])
    np.testing.assert_allclose(a.isel(t=slice(-1, None)).to_numpy(), x[-1:])
    for bad in (lambda: a.isel(t=-3), lambda: a.isel(c=[-4]), lambda: a.set_labels(c=["r", "g", "b"]).isel(c=3), lambda: a.isel(t=9, c=9).to_numpy()):
        with pytest.raises(IndexError):
            bad()


def test_more_arithmetic(spark):
    x = np.array([[4.0, 0.0, -7.0], [0.0, 2.0, 5.0]])
    a = ArrayFrame.from_numpy(spark, x, "yx")
    np.testing.assert_allclose((1 - a).to_numpy(), 1 - x)
    np.testing.assert_allclose((2 + a * 3).to_numpy(), 2 + x * 3)
    zero = ArrayFrame.from_numpy(spark, np.array([[0.0, 3.0, 2.0]] * 2), "yx")
    assert (a // zero).to_numpy().tolist() == [[0, 0, -4], [0, 0, 2]] and (a % zero).to_numpy().tolist() == [[0, 0, 1], [0, 2, 1]]
    assert (6 / a).to_numpy()[0].tolist() == [1.5, 0, -6 / 7]
    u = ArrayFrame.from_numpy(spark, np.array([[250, 3]], np.uint8), "yx")
    assert (u + 10).to_numpy().tolist() == [[4, 13]] and (3 - u).to_numpy().tolist() == [[9, 0]] and (u + 10).dtype == "uint8"
    assert (u * 1.5).dtype == "float32" and (u + u.as_type("uint16")).dtype == "uint16"


def test_stack_is_one_by_one(spark):
    """No kernel mixes the arrays of a stack, whatever their levels are."""
    from voxelframe.functions import filters, fourier, objects

    dim, bright = rng.random((24, 24)), 50 + 40 * rng.random((24, 24))
    both, template = np.stack([dim, bright]), rng.random((3, 3))
    kernels = [
        lambda x: filters.template_correlation(x, template), filters.total_variation, filters.rolling_ball, lambda x: filters.enhance_contrast(x), lambda x: objects.threshold(x, "sauvola"),
        *[lambda x, h=h: objects.threshold(x, h) for h in (*objects.THRESHOLDS, "niblack", "local", "30%")], lambda x: fourier.power(x, norm=True), lambda x: fourier.lowpass(x), lambda x: filters.gaussian(x, 1.0),
        lambda x: np.array([len(p) for p in objects.peaks(x)]),
    ]
    for k in kernels:
        np.testing.assert_allclose(k(both), np.concatenate([k(both[:1]), k(both[1:])]))
    a = ArrayFrame.from_numpy(spark, both, "tyx")
    table = np.linspace(0, 1, 40).reshape(10, 4)
    for op in (lambda f: f.ncc_filter(template), lambda f: f.as_rgba(table), lambda f: f.rof_filter(), lambda f: f.local_power_spectra(norm=True, y=(0, 4), x=(0, 4))):
        got = op(a.set_axes("tyx")).to_numpy()
        for t in (0, 1):
            np.testing.assert_allclose(got[t], op(ArrayFrame.from_numpy(spark, both[t], "yx")).to_numpy())
    v = ArrayFrame.from_numpy(spark, np.stack([both, both[::-1]]), "tzyx")
    psf = np.ones((1, 3, 3))
    np.testing.assert_allclose(v.pad_defocus(psf, depth=1, width=2).to_numpy()[0], ArrayFrame.from_numpy(spark, both, "zyx").pad_defocus(psf, depth=1, width=2).to_numpy())


def test_transforms(spark):
    x, a = frame(spark, (2, 6, 8), "tyx")
    y = a.fft(shift=False).to_numpy()
    np.testing.assert_allclose(y[..., 0] + 1j * y[..., 1], np.fft.fft2(x), atol=1e-9)
    np.testing.assert_allclose(a.fft().ifft().to_numpy(), x, atol=1e-9)
    assert a.fft(shape="square").shape == (8, 8, 2) and a.fft().ifft(real=False).shape == (6, 8, 2)
    z = a.local_dft(y=(0, 12), x=(3, 5), upsample=2).to_numpy()
    np.testing.assert_allclose((z[..., 0] + 1j * z[..., 1])[:, ::2, 1], np.fft.fft2(x)[:, :, 2], atol=1e-9)
    np.testing.assert_allclose(a.local_power_spectra(x=(1, 4)).to_numpy(), np.abs(np.fft.fft2(x)[:, :, 1:4]) ** 2, atol=1e-8)
    with pytest.raises(AxesError):
        a.ifft()
    with pytest.raises(AxesError):
        a.local_dft(q=(0, 1))
    with pytest.raises(ValueError):
        a.tile("t", 1, 1)


@pytest.mark.parametrize("kind", ["uint8", "uint16", "float32"])
def test_tiff(spark, tmp_path, kind):
    x = (rng.random((2, 3, 4, 5, 6)) * 200).astype(kind)
    a = ArrayFrame.from_numpy(spark, x, "tzcyx", dtype=kind).set_scale(yx=0.25, z=0.5)
    sources.write_file(a, f"{tmp_path}/one.tif")
    b = sources.imread(spark, f"{tmp_path}/one.tif")
    assert str(b.axes) == "tzcyx" and b.dtype == kind and b.axes.scale["z"] == 0.5 and b.axes.scale["x"] == pytest.approx(0.25)
    np.testing.assert_array_equal(b.to_numpy(), x)
    assert sources.read_meta(spark, f"{tmp_path}/one.tif")["shape"] == [2, 3, 4, 5, 6]
    np.save(f"{tmp_path}/i.npy", x[0, 0, 0]), np.save(f"{tmp_path}/j.npy", x[0, 0])
    found = sources.imread_collection(spark, f"{tmp_path}/*.npy")
    assert {k: v.shape for k, v in found.items()} == {"i": (5, 6), "j": (4, 5, 6)}


def _tiff_bytes(x, order, packed, predictor=1, whole=True):
    """A small file made apart from the library's writer: two strips a page, or one page's fields for all pages."""
    import struct
    import zlib

    out, pages = bytearray(struct.pack(order + "2sHI", b"II" if order == "<" else b"MM", 42, 0)), x if whole else x[:1]
    note, last = f"ImageJ=1\nimages={len(x)}\n".encode() + b"\0", 4
    for page in pages:
        y = np.concatenate([page[:, :1], np.diff(page, axis=1)], 1).astype(x.dtype) if predictor == 2 else page
        parts = [y[:2], y[2:]] if whole else [x]
        strips = [p.astype(x.dtype.newbyteorder(order)).tobytes() for p in parts]
        strips = [zlib.compress(s) if packed == 8 else s for s in strips]
        at = []
        for s in strips:
            at.append(len(out))
            out += s
        lists = len(out)
        out += struct.pack(f"{order}{2 * len(at)}I", *at, *map(len, strips))
        text = len(out)
        out += note + bytes(len(note) % 2)
        two = len(at) > 1
        short = lambda v: struct.pack(order + "HH", v, 0)
        long = lambda v: struct.pack(order + "I", v)
        rows = [(256, 4, 1, long(x.shape[2])), (257, 4, 1, long(x.shape[1])), (258, 3, 1, short(16)), (259, 3, 1, short(packed)), (270, 2, len(note), long(text)), (273, 4, len(at), long(lists if two else at[0])), (279, 4, len(at), long(lists + 4 * len(at) if two else len(strips[0]))), (317, 3, 1, short(predictor))]
        struct.pack_into(order + "I", out, last, len(out))
        out += struct.pack(order + "H", len(rows)) + b"".join(struct.pack(order + "HHI", *r[:3]) + r[3] for r in rows)
        last = len(out)
        out += bytes(4)
    return bytes(out)


@pytest.mark.parametrize("order, packed, predictor, whole", [("<", 1, 1, True), (">", 8, 2, True), (">", 1, 1, False)])
def test_tiff_layouts(order, packed, predictor, whole):
    x = rng.integers(0, 60000, (3, 5, 4)).astype("u2")
    got, axes, _ = sources._READERS[".tif"](_tiff_bytes(x, order, packed, predictor, whole))
    np.testing.assert_array_equal(got, x)
    assert axes == "tyx"
    with pytest.raises(ValueError):
        sources._READERS[".tif"](b"no file at all")


def test_reshape_and_paths(spark):
    x, a = frame(spark, (2, 6, 8), "tyx")
    np.testing.assert_allclose(a.reshape("zyx", (2, 4, 6)).to_numpy(), x.reshape(2, 2, 4, 6))
    with pytest.raises(AxesError):
        a.reshape("yx", (5, 5))
    paths = [[[0, 0], [0, 5]], [[1, 1], [4, 1], [4, 3]]]
    got = {(r["t"], r["N"], r["prop"]): r["value"] for r in a.pathprops(paths, ("mean", np.max)).collect()}
    assert len(got) == 8
    assert got[1, 0, "mean"] == pytest.approx(x[1, 0, :6].mean()) and got[0, 0, "max"] == x[0, 0, :6].max()
    assert got[0, 1, "mean"] == pytest.approx(np.mean([x[0, 1, 1], x[0, 2, 1], x[0, 3, 1], x[0, 4, 1], x[0, 4, 2], x[0, 4, 3]]))


def test_gaussian_fit(spark):
    y, x = np.mgrid[:56, :56]
    true = np.stack([1.5 * np.exp(-0.5 * (((y - m) / 22.1) ** 2 + ((x - 26.3) / 19.6) ** 2)) + 0.2 for m in (30.5, 20.0)])
    a = ArrayFrame.from_numpy(spark, true + rng.normal(0, 0.1, true.shape), "tyx")
    rows = {r["t"]: r for r in a.gaussfit_params().collect()}
    assert rows[0]["mu"] == pytest.approx([30.5, 26.3], abs=1) and rows[1]["mu"][0] == pytest.approx(20, abs=1)
    assert rows[0]["sg"] == pytest.approx([22.1, 19.6], rel=0.1) and rows[0]["a"] == pytest.approx(1.5, rel=0.1) and rows[0]["rmse"] == pytest.approx(0.1, rel=0.1)
    assert np.abs(a.gaussfit(2).to_numpy() - true).max() < 0.1
    flat = ArrayFrame.from_numpy(spark, true, "tyx").gauss_correction(median_radius=0).to_numpy()
    assert flat.std(axis=(1, 2)).max() < 0.2


def test_kalman_pieces(spark, monkeypatch):
    from voxelframe.functions import filters
    from voxelframe.operators import image

    x, a = frame(spark, (3, 5, 6, 8), "ctyx")
    want = np.stack([filters.kalman(i[None], 0.7)[0] for i in x])
    np.testing.assert_allclose(a.kalman_filter(0.7).to_numpy(), want, rtol=1e-12)
    monkeypatch.setattr(image, "SERIES_VALUES", 10)
    np.testing.assert_allclose(a.kalman_filter(0.7).to_numpy(), want, rtol=1e-12)
    along = np.moveaxis(filters.kalman(np.moveaxis(x.reshape(15, 6, 8), 2, 1), 0.7), 1, 2).reshape(x.shape)
    np.testing.assert_allclose(a.kalman_filter(0.7, "x").to_numpy(), along, rtol=1e-12)


def test_masked_correlation(spark):
    x, a = frame(spark, (2, 6, 8), "tyx")
    y, b = frame(spark, (6, 8), "yx")
    for m, mask in (frame(spark, (6, 8), "yx"), frame(spark, (2, 6, 8), "tyx")):
        got = {r["t"]: r["value"] for r in correlation.zncc(a, b, mask > 0).collect()}
        for t in range(2):
            keep = ~((m if m.ndim == 2 else m[t]) > 0)
            assert got[t] == pytest.approx(np.corrcoef(x[t][keep], y[keep])[0, 1])
    line, c = frame(spark, (6,), "y")
    got = {r["t"]: r["value"] for r in correlation.zncc(a, c).collect()}
    assert got[1] == pytest.approx(np.corrcoef(x[1].ravel(), np.repeat(line, 8))[0, 1])


def test_unique_labels_over_all_axes(spark):
    x = rng.integers(0, 4, (3, 2, 5, 2, 2))
    a = ArrayFrame.from_numpy(spark, x, "ptcyx")
    want, offset = x.copy(), 0
    for at in np.ndindex(3, 2, 5):
        want[at] = np.where(x[at] > 0, x[at] + offset, 0)
        offset += x[at].max()
    np.testing.assert_array_equal(a.unique_labels().to_numpy(), want)
