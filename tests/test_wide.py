"""Filters of large footprints and component trees against place-by-place and level-by-level versions."""

import functools
import time

import numpy as np
import pytest

from voxelframe.functions import filters, objects, wide

rng = np.random.default_rng(2)


def images(shape):
    return rng.normal(size=shape), rng.integers(0, 6, shape), np.full(shape, 3.0)


@pytest.mark.parametrize("shape,radius", [((2, 40, 37), 6), ((1, 14, 15, 16), 3), ((2, 30, 9), 5.5), ((1, 9, 9), 12)])
@pytest.mark.parametrize("rank_places", [64, 200])
def test_large_footprints(shape, radius, rank_places, monkeypatch):
    monkeypatch.setattr(wide, "RANK_PLACES", rank_places)
    f = filters.ball(radius, len(shape) - 1)
    assert wide.large(f)
    for x in images(shape):
        for mode, cval in (("reflect", 0.0), ("constant", 1.5), ("nearest", 0.0)):
            many = np.stack([p for _, p in filters.taps(x, f, mode, cval)])
            np.testing.assert_array_equal(filters.minimum(x, f, mode, cval), many.min(0))
            np.testing.assert_array_equal(filters.maximum(x, f, mode, cval), many.max(0))
            np.testing.assert_allclose(filters.mean(x, f, mode, cval), many.mean(0), atol=1e-9)
            np.testing.assert_allclose(filters.deviation(x, f, mode, cval), np.stack([p for _, p in filters.taps(x.astype(float), f, mode, cval)]).std(0), atol=1e-6)
            for rank in (0, len(many) // 2, len(many) - 1):
                np.testing.assert_array_equal(filters.rank_filter(x, f, rank, mode, cval), np.partition(many, rank, 0)[rank])


def test_boxes_and_gaps():
    x = rng.normal(size=(2, 20, 21))
    box = np.ones((9, 11), bool)
    np.testing.assert_array_equal(filters.median(x, box), np.sort(np.stack([p for _, p in filters.taps(x, box)]), 0)[49])
    gaps = np.ones((9, 9), bool)
    gaps[::2, 4] = False  # not made of runs: place by place
    assert not wide.large(gaps)
    np.testing.assert_array_equal(filters.minimum(x, gaps), functools.reduce(np.minimum, (p for _, p in filters.taps(x, gaps))))


def test_cost_hardly_grows_with_the_radius():
    x = rng.normal(size=(1, 256, 256))
    seconds = []
    for radius in (10, 40):
        start = time.perf_counter()
        filters.median(x, filters.ball(radius, 2))
        seconds.append(time.perf_counter() - start)
    assert seconds[1] < 8 * seconds[0]  # place by place it is over 16 times


def by_levels(x, keep):
    out = np.empty(x.shape, x.dtype)
    for i, a in enumerate(x):
        levels = np.unique(a)
        out[i] = levels[0]
        for v in levels[1:]:
            kept = keep((a >= v)[None])[0]
            out[i][kept] = v
    return out


@pytest.mark.parametrize("shape", [(3, 8, 9), (2, 4, 5, 6), (2, 12)])
@pytest.mark.parametrize("connectivity", [1, 2])
def test_trees(shape, connectivity):
    for x in images(shape):
        for least in (1, 2, 5, 10_000):
            want = by_levels(x, lambda m: objects.area_opening(m, least, connectivity))
            np.testing.assert_array_equal(objects.area_opening(x, least, connectivity), want)
            want = by_levels(x, lambda m: objects.diameter_opening(m, least, connectivity))
            np.testing.assert_array_equal(objects.diameter_opening(x, least, connectivity), want)
            np.testing.assert_array_equal(objects.area_closing(x, least, connectivity), -objects.area_opening(-x, least, connectivity))


def test_a_large_plane_is_quick():
    x = filters.gaussian(rng.normal(size=(1, 512, 512)), 1.0)
    start = time.perf_counter()
    out = objects.area_opening(x, 64, 1)
    assert time.perf_counter() - start < 10 and (out <= x).all()  # about a second on a free core
    assert (objects.area_opening(out, 64, 1) == out).all()
