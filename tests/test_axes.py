import pytest

from voxelframe.axes import Axes, AxesError, Axis, broadcast, parse, slicer, spatial


def test_unique_and_sorted():
    with pytest.raises(AxesError):
        Axes.of("yy")
    assert str(Axes.of("xqzt").sorted()) == "qtzx"
    assert Axes.of("tzyx").is_sorted() and not Axes.of("ztyx").is_sorted()
    assert str(Axes.default(3)) == "zyx"


def test_scale_and_labels():
    with pytest.raises(ValueError):
        Axis("x", 0)
    a = Axes.of("zyx").scaled(yx=0.5, z=2)
    assert a.scale == {"z": 2.0, "y": 0.5, "x": 0.5}
    with pytest.raises(AxesError):
        a.scaled(t=1)
    c = Axis("c", labels=("r", "g", "b"))
    assert c.index("g") == 1 and c.label_slice(slice("r", "b")) == slice(0, 2, None)
    assert c.sliced(slice(0, 3, 2)).labels == ("r", "b") and c.sliced(slice(0, 3, 2)).scale == 2
    assert c.sliced([2, 0]).labels == ("b", "r") and c.sliced(1) is None
    with pytest.raises(ValueError):
        Axis("c", labels=("r", "r")).index("r")


def test_undefined_axes_differ():
    assert not Axis("#").same(Axis("#"))
    assert len(Axes.of("##")) == 2


@pytest.mark.parametrize("text, want", [("t=4", {"t": 4}), ("y=2:10:2;x=1,3,5", {"y": slice(2, 10, 2), "x": [1, 3, 5]}), ("x=N//2", {"x": 6}), ("y=-1", {"y": -1}), ("x=0:2,5", {"x": [0, 1, 5]}), ("y=ceil(N/3):", {"y": slice(4, None)})])
def test_parse(text, want):
    assert parse(text, {"t": 5, "y": 10, "x": 12}) == want


@pytest.mark.parametrize("text", ["t", "t=", "t=1;t=2", "t=a", "t=1.5", "t=__import__('os')", "t=1:2:3:4"])
def test_parse_errors(text):
    with pytest.raises(ValueError):
        parse(text, {"t": 5})


def test_slicer():
    assert slicer.t[4].y[1:3].keys == {"t": 4, "y": slice(1, 3)}
    with pytest.raises(ValueError):
        slicer.t[1].t
    assert slicer.c[0].formatter("t")(3).keys == {"c": 0, "t": 3}


@pytest.mark.parametrize("a, b, want", [("zyx", "yx", "zyx"), ("yx", "zy", "zyx"), ("z", "x", "zx"), ("tyx", "cyx", "tcyx")])
def test_broadcast(a, b, want):
    assert str(broadcast(Axes.of(a), Axes.of(b))) == want


def test_spatial():
    assert spatial(Axes.of("tzyx"), None) == ["z", "y", "x"] and spatial(Axes.of("tzyx"), 2) == ["y", "x"]
    with pytest.raises(AxesError):
        spatial(Axes.of("t"), None)
