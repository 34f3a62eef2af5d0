"""Labels and regions of interest go with a frame."""

import numpy as np
import pytest

from voxelframe import ArrayFrame, AxesError
from voxelframe.covariates import Annotated, Roi, Rois

LINE = [[3, 4], [6, 10]]


def rois(spark, at, axes):
    return Rois.of(spark, [Roi("line", LINE, dict(zip(axes, at)))], axes, "yx")


def points(r):
    return [(x.points, x.at) for x in r.collect()]


def test_slices_of_a_region(spark):
    r = rois(spark, [2], "t")
    assert points(r.isel(t=2, y=slice(1, 6, 1), x=slice(3, 8, 1))) == [([[2, 1], [5, 7]], {})]
    assert points(r.isel(t=2, y=slice(1, 6, 2), x=slice(12, 3, -1))) == [([[1, 8], [2.5, 2]], {})]
    assert points(r.isel(t=1, y=slice(1, 6, 2))) == []
    assert points(r.isel(t=2, y=1)) == points(r.isel(t=2, x=[1, 2])) == []


def test_places_of_a_region(spark):
    r = rois(spark, [2, 14, 1], "tzc")
    part = {"y": slice(1, 6), "x": slice(3, 8)}
    some = slice(0, 3)
    assert points(r.isel(t=2, z=14, c=1, **part)) == [([[2, 1], [5, 7]], {})]
    assert points(r.isel(t=2, z=14, c=some, **part)) == [([[2, 1], [5, 7]], {"c": 1})]
    assert points(r.isel(t=some, z=14, c=1, **part)) == [([[2, 1], [5, 7]], {"t": 2})]
    assert points(r.isel(t=some, z=slice(10, 20, 2), c=some, **part)) == [([[2, 1], [5, 7]], {"t": 2, "z": 2, "c": 1})]
    assert points(r.isel(t=[5, 2], z=14, c=1)) == [(LINE, {"t": 1})]
    for keys in ({"t": 1}, {"z": 13}, {"c": 3}, {"t": slice(0, 2)}, {"z": slice(0, 20, 4)}, {"t": [1, 3]}):
        assert points(r.isel(**keys)) == []
    assert points(r.drop("t")) == [(LINE, {"z": 14, "c": 1})] and r.drop("c").batch.names == ["t", "z"]
    with pytest.raises(AxesError):
        Rois.of(spark, [Roi("line", LINE, {"q": 1})], "t", "yx")
    with pytest.raises(ValueError):
        Rois.of(spark, [Roi("circle", LINE)], "t", "yx")


def test_regions_of_a_frame(spark):
    frame = ArrayFrame.from_numpy(spark, np.zeros((5, 10, 10)), "tyx")
    a = frame.annotate(rois=[Roi("line", [[1, 1], [2, 3]]), Roi("line", [[4, 6], [2, 3]], {"t": 1})])
    assert points(a["t=1"].rois) == [([[1, 1], [2, 3]], {}), ([[4, 6], [2, 3]], {})]
    assert points(a["t=1;y=2:8"].rois) == [([[-1, 1], [0, 3]], {}), ([[2, 6], [0, 3]], {})]
    assert points(a["t=0;y=3:8"].rois) == [([[-2, 1], [-1, 3]], {})]
    assert points(a.isel(t=-4).rois) == points(a.isel(t=1).rois)
    assert points(a.isel(y=slice(None, None, -1), t=1).rois)[0] == ([[8, 1], [7, 3]], {})
    assert a["y=3"].rois is None and len(points(a.gaussian_filter(1.0).rois)) == 2
    assert points(a.projection("t").rois)[1] == ([[4, 6], [2, 3]], {}) and a.projection("y").rois is None
    np.testing.assert_allclose(points(a.binning(2).rois)[0][0], [[0.25, 0.25], [0.75, 1.25]])
    assert points(a.set_axes("zyx").rois)[1] == ([[4, 6], [2, 3]], {"z": 1})
    assert a.rois.vertices().count() == 4


@pytest.fixture
def labelled(spark):
    x = np.random.default_rng(0).normal(size=(10, 10, 10)).round(2)
    label = np.zeros((10, 10, 10), np.int64)
    label[:4], label[4:6] = 1, 2
    label[:, 3:8] = 3
    return x, label, ArrayFrame.from_numpy(spark, x, "zyx", space="yx"), ArrayFrame.from_numpy(spark, label, "zyx", space="yx"), ArrayFrame.from_numpy(spark, label[0], "yx")


def test_labels_are_kept(labelled):
    _, label, frame, whole, flat = labelled
    for labels, want, axes in ((whole, label, "zyx"), (flat, label[0], "yx")):
        a = frame.annotate(labels)
        for out in (a.gaussian_filter(1.0), a + 1, 1 - a, a + a, -a, a.threshold(0.0)):
            assert isinstance(out, Annotated) and str(out.labels.axes) == axes
            np.testing.assert_array_equal(out.labels.to_numpy(), want)
        assert a.projection("y").labels is None
        assert (a.projection("z").labels is None) == (axes == "zyx")
    np.testing.assert_array_equal(frame.annotate(flat).projection("z").labels.to_numpy(), label[0])


def test_labels_are_sliced(labelled):
    x, label, frame, whole, flat = labelled
    a = frame.annotate(whole)
    np.testing.assert_array_equal(a["z=2:7;y=1:9;x=3:6"].labels.to_numpy(), label[2:7, 1:9, 3:6])
    np.testing.assert_array_equal(a.isel(z=slice(2, 7), y=[0, 2, 4, 6, 9]).labels.to_numpy(), label[2:7, [0, 2, 4, 6, 9]])
    b = frame.annotate(flat)["z=2:7;y=1:9;x=3:6"]
    assert str(b.labels.axes) == "yx"
    np.testing.assert_array_equal(b.labels.to_numpy(), label[0, 1:9, 3:6])
    np.testing.assert_array_equal(b.frame.to_numpy(), x[2:7, 1:9, 3:6])
    half = a.binning(2)
    assert half.labels.shape == half.frame.shape == (5, 5) and half.labels.axes.scale == half.frame.axes.scale
    np.testing.assert_array_equal(half.labels.to_numpy(), label[:, 1::2, 1::2])


def test_wrong_labels(spark, labelled):
    _, _, frame, whole, _ = labelled
    with pytest.raises(ValueError):
        frame.annotate(frame)
    with pytest.raises(TypeError):
        frame.annotate(frame + 1)
    for shape, axes in (((10, 10, 8), "zyx"), ((10, 8), "yx")):
        with pytest.raises(ValueError):
            frame.annotate(ArrayFrame.from_numpy(spark, np.zeros(shape, np.uint8), axes, space="yx"))
    with pytest.raises(AxesError):
        frame.annotate(ArrayFrame.from_numpy(spark, np.zeros((2, 10, 10, 10), np.uint8), "tzyx", space="yx"))
    with pytest.raises(ValueError):
        frame.annotate().regionprops(("area",))


def test_changing_axes(labelled):
    _, _, frame, whole, flat = labelled
    assert str(frame.annotate(whole).set_axes("tyx").labels.axes) == "tyx" and str(frame.annotate(flat).set_axes("tyx").labels.axes) == "yx"
    assert str(frame.annotate(flat).set_axes("zYx").labels.axes) == "Yx"
    a = frame.annotate(whole).set_scale(yx=0.5)
    assert a.labels.axes.scale == a.frame.axes.scale == {"z": 1.0, "y": 0.5, "x": 0.5}


def test_measures_and_files(spark, labelled, tmp_path):
    x, label, frame, whole, flat = labelled
    props = frame.annotate(flat, [Roi("polygon", [[1, 1], [2, 3], [0, 1]], {"z": 2})]).regionprops(("area", "intensity_mean"))
    got = {(r["z"], r["N"]): r["value"] for r in props.where("prop = 'intensity_mean'").collect()}
    assert len(got) == 10 * len(set(label[0].ravel()) - {0})
    for (z, k), v in got.items():
        np.testing.assert_allclose(v, x[z][label[0] == k + 1].mean())
    a = frame.annotate(rois=[Roi("polygon", [[1, 1], [2, 3], [0, 1]], {"z": 2})]).label_threshold("otsu")
    n = a.labels.to_numpy().max()
    more = a.append_label(ArrayFrame.from_numpy(spark, (np.indices((10, 10, 10)).sum(0) == 0), "zyx", space="yx"))
    assert more.labels.to_numpy()[0, 0, 0] == a.labels.to_numpy()[0].max() + 1 and n > 1
    a.save(f"{tmp_path}/a")
    back = Annotated.load(spark, f"{tmp_path}/a")
    np.testing.assert_array_equal(back.labels.to_numpy(), a.labels.to_numpy())
    np.testing.assert_allclose(back.frame.to_numpy(), x)
    assert back.rois.collect() == a.rois.collect()
