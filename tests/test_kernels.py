import numpy as np
import pytest

from voxelframe.functions import filters, fourier, geometry, objects

rng = np.random.default_rng(0)


def brute(x, foot, f, mode):
    d = x.ndim
    r = [s // 2 for s in foot.shape]
    wide = np.pad(x, [(a, s - 1 - a) for a, s in zip(r, foot.shape)], filters.MODES[mode])
    out = np.empty(x.shape)
    for at in np.ndindex(x.shape):
        out[at] = f(wide[tuple(slice(a, a + s) for a, s in zip(at, foot.shape))][foot])
    return out


@pytest.mark.parametrize("mode", ["reflect", "mirror", "nearest", "wrap"])
@pytest.mark.parametrize("radius", [1, 1.5, 2])
def test_rank_filters(mode, radius):
    x = rng.normal(size=(9, 8))
    foot = filters.ball(radius, 2)
    for kernel, f in ((filters.minimum, np.min), (filters.maximum, np.max), (filters.mean, np.mean), (filters.deviation, np.std), (filters.median, lambda v: np.sort(v)[len(v) // 2])):
        np.testing.assert_allclose(kernel(x[None], foot, mode)[0], brute(x, foot, f, mode), atol=1e-9)


def test_convolution_theorem():
    x, k = rng.normal(size=(1, 8, 8)), rng.normal(size=(3, 3))
    big = np.zeros((8, 8))
    big[:3, :3] = k
    want = np.fft.ifft2(np.fft.fft2(x[0]) * np.fft.fft2(np.roll(big, (-1, -1), (0, 1)))).real
    np.testing.assert_allclose(filters.convolve(x, k, "wrap")[0], want, atol=1e-9)


def test_gaussian_keeps_sums_and_matches_fourier():
    x = np.zeros((1, 41, 41))
    x[0, 20, 20] = 1
    y = filters.gaussian(x, 2)
    assert abs(y.sum() - 1) < 1e-9
    np.testing.assert_allclose(y, fourier.gaussian(x, 2), atol=1e-4)


def test_orientation_and_corners():
    y, x = np.mgrid[:32, :32]
    line = filters.gaussian((y == x).astype(float)[None], 3)
    assert abs(np.rad2deg(filters.hessian_angle(line, 1)[0, 16, 16]) + 45) < 1
    square = np.zeros((1, 20, 20))
    square[0, 5:15, 5:15] = 1
    assert np.unravel_index(filters.harris(square, 1)[0, :10, :10].argmax(), (10, 10))[0] in (4, 5, 6)


def test_interpolation():
    x = np.arange(120, dtype=float).reshape(10, 12)
    where = np.array([[4.5, 4.0, 5.25], [5.5, 5.0, 6.5]])
    for order in (1, 3):
        np.testing.assert_allclose(geometry.sample(x, where, order), where[0] * 12 + where[1], atol=0.1 if order == 3 else 1e-9)
    y = rng.normal(size=(10, 12))
    np.testing.assert_allclose(geometry.sample(y, geometry.grid(y.shape), 3), y, atol=1e-9)
    np.testing.assert_allclose(geometry.rotate(y[None, :10, :10], 90, order=1)[0], np.rot90(y[:, :10], -1), atol=1e-9)
    np.testing.assert_allclose(geometry.shift(y[None], (1, -2), 1)[0, 1:, :-2], y[:-1, 2:], atol=1e-9)


def test_radon_round_trip():
    y, x = np.mgrid[:24, :24]
    image = np.exp(-0.5 * (((y - 10) / 3) ** 2 + ((x - 13) / 4) ** 2))
    degrees = np.linspace(0, 180, 60, endpoint=False)
    back = geometry.inverse_radon(geometry.radon(image[None], degrees, 1), degrees)[0]
    assert np.corrcoef(back.ravel(), image.ravel())[0, 1] > 0.95


def test_phase_correlation():
    x = filters.gaussian(rng.normal(size=(1, 32, 32)), 1)[0]
    np.testing.assert_allclose(fourier.phase_correlation(np.roll(x, (3, -5), (0, 1)), x, 1), [3, -5])
    found, best = fourier.zero_normalised_maximum(x[2:20, 3:21], x[0:18, 2:20], 3, 1)
    np.testing.assert_allclose(found, [-2, -1])
    assert best > 0.99


def test_deconvolution_sharpens():
    psf = np.exp(-0.5 * ((np.mgrid[:33, :33] - 16) ** 2).sum(0) / 4)
    x = np.zeros((1, 33, 33))
    x[0, 10, 20] = 100
    blurred = fourier.weighted(x, fourier.point_spread(psf, (33, 33)))
    for y in (fourier.lucy(blurred, psf, 30), fourier.wiener(blurred, psf, 0.01)):
        assert np.unravel_index(y[0].argmax(), y[0].shape) == (10, 20) and y.max() > 2 * blurred.max()
    with pytest.raises(ValueError):
        fourier.wiener(x, psf[1:], 0.1)


def test_labels():
    x = np.zeros((1, 32, 32), int)
    x[0, 2:8, 2:8] = 1
    x[0, 8:12, 4:9] = 2
    x[0, 20:25, 20:25] = 1
    assert objects.label(x).max() == 3 and objects.label((x > 0).astype(int)).max() == 2
    spiral = np.array([[[1, 1, 1, 1], [0, 0, 0, 1], [1, 1, 0, 1], [1, 0, 0, 1], [1, 1, 1, 1]]])
    assert objects.label(spiral, 1).max() == 1


def test_distance_and_growth():
    m = rng.random((1, 9, 9)) > 0.3
    d = objects.distance_map(m)
    off = np.argwhere(~m[0])
    want = np.array([[0 if not m[0, i, j] else np.sqrt(((off - (i, j)) ** 2).sum(1).min()) for j in range(9)] for i in range(9)])
    np.testing.assert_allclose(d[0], want)
    one = np.zeros((1, 9, 9), int)
    one[0, 4, 4] = 3
    assert (objects.nearest_label(one, 2) == 3).sum() == 13


def test_watershed_and_walker():
    y, x = np.mgrid[:20, :30]
    two = ((y - 10) ** 2 + (x - 9) ** 2 < 50) | ((y - 10) ** 2 + (x - 19) ** 2 < 50)
    d = objects.distance_map(two[None])[0]
    seeds = np.zeros(two.shape, int)
    seeds[10, 9], seeds[10, 19] = 1, 2
    lab = objects.watershed(-d, seeds, two)
    assert lab[10, 5] == 1 and lab[10, 23] == 2 and (lab > 0).sum() == two.sum()
    steps = np.concatenate([np.zeros((6, 5)), np.ones((6, 5))], 1)
    s = np.zeros((6, 10), int)
    s[3, 0], s[3, 9] = 1, 2
    out = objects.random_walker(steps, s)
    assert (out[:, :5] == 1).all() and (out[:, 5:] == 2).all()


@pytest.mark.parametrize("how", ["otsu", "yen", "isodata", "li", "triangle", "mean"])
def test_thresholds_split_two_modes(how):
    x = np.concatenate([rng.normal(50, 5, 3000), rng.normal(150, 5, 1000)]).round().astype(int).reshape(1, 50, 80)
    got = objects.threshold(x, how)
    assert abs(got.sum() - 1000) <= (1500 if how in ("triangle", "yen") else 5)


def test_masks():
    line = np.zeros((1, 9, 9), bool)
    line[0, 3:6, 1:8] = True
    thin = objects.skeleton(line)
    assert thin.sum() < line.sum() and (thin & ~line).sum() == 0 and objects.label(thin.astype(int)).max() == 1
    hull = objects.convex_hull(np.array([[[1, 0, 1], [0, 0, 0], [1, 0, 1]]], bool))
    assert hull.all()
    ring = np.ones((1, 5, 5))
    ring[0, 2, 2] = 0
    assert objects.fill_holes(ring, np.pad(np.ones((1, 3, 3), bool), ((0, 0), (1, 1), (1, 1)))).min() == 1
    np.testing.assert_allclose(objects.inpaint_mean(np.where(np.eye(4) > 0, 99.0, 2.0)[None], np.eye(4, dtype=bool))[0], 2.0)
    ramp = np.add.outer(np.arange(8.0), np.arange(8.0))
    hole = np.zeros((8, 8), bool)
    hole[3:5, 3:5] = True
    np.testing.assert_allclose(objects.inpaint_biharmonic(np.where(hole, 0, ramp)[None], hole)[0], ramp, atol=1e-6)


def test_denoising():
    clean = np.zeros((1, 32, 32))
    clean[0, 8:24, 8:24] = 1
    noisy = clean + rng.normal(0, 0.2, clean.shape)
    assert abs(filters.noise_sigma(noisy)[0] - 0.2) < 0.05
    for y in (filters.total_variation(noisy, 0.2), filters.wavelet_denoise(noisy)):
        assert np.square(y - clean).mean() < np.square(noisy - clean).mean()


def test_texture():
    x = np.array([[0, 1], [1, 0]])
    g = objects.cooccurrence(x, 1, 0, 2)
    assert g.tolist() == [[0, 1], [1, 0]]
    assert objects.cooccurrence_property(g, "contrast") == 1 and objects.cooccurrence_property(g, "energy") == pytest.approx(0.5**0.5)
    assert objects.cooccurrence_property(g, "correlation") == pytest.approx(-1)


def test_walker_equals_dense_solve():
    g = np.random.default_rng(5)
    x, seeds = g.normal(size=(7, 9)), np.zeros((7, 9), int)
    seeds[0, 0], seeds[6, 8], seeds[3, 4] = 1, 2, 5
    n, flat, scale = x.size, np.arange(x.size).reshape(x.shape), 3.0 / (10 * x.std())
    lap = np.zeros((n, n))
    for a, b in [(flat[:-1], flat[1:]), (flat[:, :-1], flat[:, 1:])]:
        for i, j in zip(a.ravel(), b.ravel()):
            w = np.exp(-scale * (x.flat[i] - x.flat[j]) ** 2) + 1e-10
            lap[i, j] -= w
            lap[j, i] -= w
            lap[i, i] += w
            lap[j, j] += w
    s = seeds.ravel()
    free, ids = np.flatnonzero(s == 0), np.array([1, 2, 5])
    fixed = np.flatnonzero(s)
    p = np.linalg.solve(lap[np.ix_(free, free)], -lap[np.ix_(free, fixed)] @ (s[fixed][:, None] == ids))
    want = s.copy()
    want[free] = ids[p.argmax(1)]
    assert (objects.random_walker(x, seeds, 3.0) == want.reshape(x.shape)).all()
    big = objects.random_walker(np.pad(x, 60), np.pad(seeds, 60), 3.0)
    assert set(np.unique(big)) <= {1, 2, 5}
