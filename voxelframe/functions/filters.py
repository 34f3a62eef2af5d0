"""Neighbourhood kernels on stacks of arrays.

A stack has one leading axis of independent arrays and one to three spatial
axes; every kernel works on the whole stack at once.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator, Sequence

import numpy as np

from . import wide

#: Padding names of image filters, as numpy.pad names them.
MODES = {"reflect": "symmetric", "mirror": "reflect", "nearest": "edge", "wrap": "wrap", "constant": "constant"}


def pad(x: np.ndarray, before: Sequence[int], after: Sequence[int], mode: str = "reflect", cval: float = 0.0) -> np.ndarray:
    width = [(0, 0), *zip(before, after)]
    if mode == "constant":
        return np.pad(x, width, "constant", constant_values=cval)
    return np.pad(x, width, MODES[mode])


def ball(radius: float, ndim: int) -> np.ndarray:
    """Footprint on a grid whose half width is a multiple of one half."""
    if ndim == 1:
        return np.ones(2 * int(radius) + 1, bool)
    half = int(2 * radius) / 2
    line = np.arange(-half, half + 1)
    return sum(np.square(g) for g in np.meshgrid(*[line] * ndim, indexing="ij")) <= radius**2


def taps(x: np.ndarray, footprint: np.ndarray, mode: str = "reflect", cval: float = 0.0, centre: Sequence[int] | None = None) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    """For each place set in the footprint, that place and the stack shifted to it."""
    size = footprint.shape
    centre = [s // 2 for s in size] if centre is None else centre
    wide = pad(x, centre, [s - 1 - c for s, c in zip(size, centre)], mode, cval)
    for at in zip(*np.nonzero(footprint)):
        yield tuple(int(a) for a in at), wide[(slice(None), *(slice(a, a + n) for a, n in zip(at, x.shape[1:])))]


def correlate(x: np.ndarray, kernel: np.ndarray, mode: str = "reflect", cval: float = 0.0, centre: Sequence[int] | None = None) -> np.ndarray:
    out = np.zeros(x.shape)
    for at, part in taps(x, kernel != 0, mode, cval, centre):
        out += kernel[at] * part
    return out


def convolve(x: np.ndarray, kernel: np.ndarray, mode: str = "reflect", cval: float = 0.0) -> np.ndarray:
    return correlate(x, kernel[(slice(None, None, -1),) * kernel.ndim], mode, cval, [(s - 1) // 2 for s in kernel.shape])


def _wide(x: np.ndarray, footprint: np.ndarray, mode: str, cval: float) -> np.ndarray:
    """The stack padded by the footprint around its centre."""
    centre = [s // 2 for s in footprint.shape]
    return pad(x, centre, [s - 1 - c for s, c in zip(footprint.shape, centre)], mode, cval)


def minimum(x, footprint, mode="reflect", cval=0.0):
    if wide.large(footprint):
        return wide.extreme(_wide(x, footprint, mode, cval), x.shape[1:], footprint, np.minimum)
    return functools.reduce(np.minimum, (p for _, p in taps(x, footprint, mode, cval)))


def maximum(x, footprint, mode="reflect", cval=0.0):
    if wide.large(footprint):
        return wide.extreme(_wide(x, footprint, mode, cval), x.shape[1:], footprint, np.maximum)
    return functools.reduce(np.maximum, (p for _, p in taps(x, footprint, mode, cval)))


def median(x, footprint, mode="reflect", cval=0.0):
    """The upper median: rank n // 2."""
    return rank_filter(x, footprint, int(footprint.sum()) // 2, mode, cval)


def rank_filter(x, footprint, rank: int, mode="reflect", cval=0.0):
    """The value of a rank, from 0, in the footprint."""
    places = int(footprint.sum())
    if places > wide.PLACES and len(x) > 1:  # a copy of the array for each place: one array at a time
        return np.concatenate([rank_filter(a[None], footprint, rank, mode, cval) for a in x])
    if places > wide.RANK_PLACES and wide.runs(footprint, 0) is not None:
        return np.stack([wide.ranked(a, x.shape[1:], footprint, rank) for a in _wide(x, footprint, mode, cval)]).astype(x.dtype)
    many = np.stack([p for _, p in taps(x, footprint, mode, cval)])
    return np.partition(many, rank, axis=0)[rank]


def _sum(x, footprint, mode, cval):
    if wide.large(footprint):
        return wide.total(_wide(x, footprint, mode, cval).astype(float), x.shape[1:], footprint)
    return sum(p for _, p in taps(x, footprint, mode, cval))


def mean(x, footprint, mode="reflect", cval=0.0):
    return _sum(x, footprint, mode, cval) / footprint.sum()


def deviation(x, footprint, mode="reflect", cval=0.0):
    n, x = footprint.sum(), np.asarray(x, float)
    one, two = _sum(x, footprint, mode, cval), _sum(x * x, footprint, mode, cval * cval)
    return np.sqrt(np.maximum(two / n - (one / n) ** 2, 0))


def variation(x, footprint, mode="reflect", cval=0.0):
    m = mean(x, footprint, mode, cval)
    return np.divide(deviation(x, footprint, mode, cval), m, out=np.zeros(x.shape), where=m != 0)


def along(x: np.ndarray, weights: np.ndarray, axis: int, mode: str = "reflect", cval: float = 0.0) -> np.ndarray:
    """Correlation with weights along one axis."""
    shape = [1] * (x.ndim - 1)
    shape[axis] = len(weights)
    return correlate(x, np.asarray(weights, float).reshape(shape), mode, cval)


@functools.lru_cache(64)
def gaussian_weights(sigma: float, order: int = 0, truncate: float = 4.0) -> np.ndarray:
    r = int(truncate * sigma + 0.5)
    t = np.arange(-r, r + 1)
    g = np.exp(-0.5 * (t / sigma) ** 2)
    g /= g.sum()
    if order == 1:
        g = g * t / sigma**2
    elif order == 2:
        g = g * (t**2 / sigma**4 - 1 / sigma**2)
    return g


def _each(value, ndim: int) -> list[float]:
    return [float(v) for v in (value if np.ndim(value) else [value] * ndim)]


def gaussian(x: np.ndarray, sigma, mode: str = "reflect", cval: float = 0.0) -> np.ndarray:
    for axis, s in enumerate(_each(sigma, x.ndim - 1)):
        if s > 0:
            x = along(x, gaussian_weights(s), axis, mode, cval)
    return x


def difference_of_gaussians(x, low=1.0, high=None):
    lows = _each(low, x.ndim - 1)
    highs = [1.6 * s for s in lows] if high is None else _each(high, x.ndim - 1)
    return gaussian(x, lows) - gaussian(x, highs)


def laplacian_of_gaussian(x, sigma=1.0):
    """Bright spots give positive values."""
    sigmas, out = _each(sigma, x.ndim - 1), 0
    for axis in range(x.ndim - 1):
        y = x
        for other, s in enumerate(sigmas):
            y = along(y, gaussian_weights(s, 2 if other == axis else 0), other)
        out = out - y
    return out


def laplacian(x, mode="reflect"):
    """Minus the second differences, summed over the axes."""
    return sum(along(x, np.array([-1.0, 2.0, -1.0]), a, mode) for a in range(x.ndim - 1))


SMOOTH = {"sobel": np.array([1, 2, 1]) / 4, "prewitt": np.array([1, 1, 1]) / 3, "scharr": np.array([3, 10, 3]) / 16, "farid": np.array([0.0376593171958126, 0.249153396177344, 0.426374573253687, 0.249153396177344, 0.0376593171958126])}
STEP = {"farid": np.array([0.109603762960254, 0.276690988455557, 0, -0.276690988455557, -0.109603762960254])}


def edge_component(x, method="sobel", axis=0):
    step = STEP.get(method, np.array([0.5, 0, -0.5]))
    out = x
    for a in range(x.ndim - 1):
        out = along(out, step if a == axis else SMOOTH[method], a)
    return -out


def edges(x, method="sobel"):
    n = x.ndim - 1
    return np.sqrt(sum(np.square(edge_component(x, method, a)) for a in range(n)) / n)


def edge_angle(x, sigma=1.0, method="sobel"):
    y = gaussian(x, sigma)
    return np.arctan2(-edge_component(y, method, 0), edge_component(y, method, 1))


def hessian(x, sigma=1.0, scale=None):
    """Second derivatives (..., d, d) of the smoothed stack, in units of the scale."""
    d = x.ndim - 1
    scale = [1.0] * d if scale is None else list(scale)
    y = gaussian(x, sigma)
    first = [np.gradient(y, axis=a + 1) for a in range(d)]
    out = np.empty((*x.shape, d, d))
    for i in range(d):
        for j in range(i, d):
            out[..., i, j] = out[..., j, i] = np.gradient(first[i], axis=j + 1) * scale[i] * scale[j]
    return out


def structure_tensor(x, sigma=1.0):
    d = x.ndim - 1
    parts = [edge_component(x, "sobel", a) for a in range(d)]
    out = np.empty((*x.shape, d, d))
    for i in range(d):
        for j in range(i, d):
            out[..., i, j] = out[..., j, i] = gaussian(parts[i] * parts[j], sigma)
    return out


def eigenvalues(t: np.ndarray) -> np.ndarray:
    """Ascending, as leading axis after the stack's."""
    return np.moveaxis(np.linalg.eigvalsh(t), -1, 1)


def eigenvectors(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w, v = np.linalg.eigh(t)
    return np.moveaxis(w, -1, 1), v


def hessian_angle(x, sigma=1.0):
    _, v = np.linalg.eigh(hessian(x, sigma))
    a = -np.arctan2(v[..., 0, -1], v[..., 1, -1])
    return (a + np.pi / 2) % np.pi - np.pi / 2


def hessian_determinant(x, sigma=1.0):
    """Zero where an eigenvalue is positive, so that only bright spots count."""
    w = np.linalg.eigvalsh(hessian(x, sigma))
    return np.abs(np.where(w > 0, 0, w).prod(-1))


def harris(x, sigma=1.0, k=0.05):
    a = structure_tensor(x, sigma)
    return np.linalg.det(a) - k * np.trace(a, axis1=-2, axis2=-1) ** 2


def gabor_kernel(wavelength=5.0, theta=0.0, sigma=2.5, gamma=1.0, phase=0.0) -> np.ndarray:
    n = int(np.ceil(3 * max(abs(sigma * np.cos(theta)), abs(sigma / gamma * np.sin(theta)), 1)))
    m = int(np.ceil(3 * max(abs(sigma / gamma * np.cos(theta)), abs(sigma * np.sin(theta)), 1)))
    y, x = np.mgrid[-m : m + 1, -n : n + 1]
    u, v = x * np.cos(theta) + y * np.sin(theta), -x * np.sin(theta) + y * np.cos(theta)
    g = np.exp(-0.5 * (u**2 + (gamma * v) ** 2) / sigma**2) * gamma / (2 * np.pi * sigma**2)
    return g * np.exp(1j * (2 * np.pi * u / wavelength + phase))


def gabor(x, wavelength=5.0, theta=0.0, sigma=2.5, gamma=1.0, phase=0.0, imaginary=False):
    k = gabor_kernel(wavelength, theta, sigma, gamma, phase)
    return convolve(x, k.imag if imaginary else k.real)


def gabor_angle(x, samples=180, **options):
    thetas = np.linspace(0, np.pi, samples, endpoint=False)
    best, out = np.full(x.shape, -np.inf), np.zeros(x.shape)
    for t in thetas:
        y = gabor(x, theta=t, **options)
        better = y > best
        best[better], out[better] = y[better], t
    return np.pi / 2 - out


def entropy(x, radius=5):
    """Local entropy in bits of grey values 0 to 255."""
    many = np.sort(np.stack([p for _, p in taps(x, ball(radius, x.ndim - 1), "reflect")]), axis=0)
    n, out = len(many), np.zeros(x.shape)
    run = np.ones(x.shape)
    for i in range(1, n + 1):
        ends = np.ones(x.shape, bool) if i == n else many[i] != many[i - 1]
        out -= np.where(ends, run / n * np.log2(run / n), 0)
        run = np.where(ends, 1, run + 1)
    return out


def enhance_contrast(x, radius=1):
    """The local minimum or maximum, whichever is nearer (the maximum on a tie)."""
    f = ball(radius, x.ndim - 1)
    low, high = minimum(x, f), maximum(x, f)
    return np.where(high - x <= x - low, high, low)


def template_correlation(x, template, mode="constant", cval=None):
    """Normalised cross-correlation with a template of odd size.  By default borders hold the array's own mean: a shift of an array changes nothing, so its mean is made 0."""
    if cval is None:
        x, cval = x - x.mean(tuple(range(1, x.ndim)), keepdims=True), 0.0
    n, t = template.size, template - template.mean()
    ones = np.ones(template.shape)
    s1, s2 = correlate(x, ones, mode, cval), correlate(x * x, ones, mode, cval * cval)
    top = correlate(x, t, mode, cval)
    var = (s2 - s1**2 / n) * np.square(t).sum()
    ok = var > np.finfo(np.float32).eps
    return np.where(ok, top / np.sqrt(np.where(ok, var, 1)), 1.0)


def kalman(x: np.ndarray, gain=0.8) -> np.ndarray:
    """Along the second axis (time): a gain that falls as 1 / (t + 1)."""
    out = np.empty(x.shape)
    out[:, 0] = est = x[:, 0].astype(float)
    for t in range(1, x.shape[1]):
        est = gain * est + (1 - gain) * x[:, t] + (x[:, t] - est) / (t + 1)
        out[:, t] = est
    return out


def rolling_ball(x, radius=30.0, prefilter="mean", background=False):
    y = x
    if prefilter:
        box = np.ones((3,) * (x.ndim - 1), bool)
        y = {"mean": mean, "median": median}[prefilter](x, box)
    line = np.arange(-int(radius), int(radius) + 1)
    inside = sum(np.square(g) for g in np.meshgrid(*[line] * (x.ndim - 1), indexing="ij"))
    fits = inside <= radius**2
    height = radius - np.sqrt(np.where(fits, radius**2 - inside, 0))
    floor = np.full(x.shape, np.inf)
    for at, p in taps(y, fits, "constant", np.inf):
        floor = np.minimum(floor, p + height[at])
    return floor if background else x - floor


def _slope(u: np.ndarray) -> np.ndarray:
    """Forward differences along each spatial axis, 0 at its end."""
    out = np.zeros((u.ndim - 1, *u.shape))
    for a in range(1, u.ndim):
        out[a - 1].swapaxes(0, a)[:-1] = np.diff(u.swapaxes(0, a), axis=0)
    return out


def _divergence(p: np.ndarray) -> np.ndarray:
    """The negative adjoint of _slope."""
    out = np.zeros(p.shape[1:])
    for a, q in enumerate(p, 1):
        inner, total = q.swapaxes(0, a)[:-1], out.swapaxes(0, a)
        total[:-1] += inner
        total[1:] -= inner
    return out


def total_variation(x, weight=0.05, tolerance=1e-4, steps=50):
    """Total variation denoising (Chambolle 2004): with u = f - weight div p, the dual field p goes to (p - s grad u) / (1 + s |grad u|), s = 1 / (2 d weight).  Each array stops by itself, when its energy changes by less than ``tolerance`` of the first one."""
    over, out = tuple(range(1, x.ndim)), x.astype(float)
    s = 1 / (2 * (x.ndim - 1) * weight)
    going, p = np.arange(len(x)), np.zeros((x.ndim - 1, *x.shape))
    energies: list[np.ndarray] = []
    for _ in range(steps):
        f = x[going]
        u = f - weight * _divergence(p)
        out[going] = u
        slope = _slope(u)
        size = np.sqrt(np.square(slope).sum(0))
        energies.append(np.square(u - f).mean(over) + weight * size.mean(over))
        p = (p - s * slope) / (1 + s * size)
        if len(energies) > 1:
            open_ = np.abs(energies[-2] - energies[-1]) >= tolerance * energies[0]
            going, p, energies = going[open_], p[:, open_], [e[open_] for e in energies]
            if not len(going):
                break
    return out


def _haar(x: np.ndarray, axis: int) -> tuple[np.ndarray, np.ndarray]:
    even, odd = (x.take(range(i, x.shape[axis], 2), axis) for i in (0, 1))
    return (even + odd) / 2**0.5, (even - odd) / 2**0.5


def noise_sigma(x: np.ndarray) -> np.ndarray:
    """Noise of each array: median absolute diagonal detail of a two-tap wavelet over 0.6745."""
    y = x
    for a in range(1, x.ndim):
        if y.shape[a] % 2:
            y = np.concatenate([y, y.take([-1], a)], a)
        y = _haar(y, a)[1]
    return np.median(np.abs(y.reshape(len(x), -1)), 1) / 0.6744897501960817


def wavelet_denoise(x, sigma=None, levels=None, soft=True):
    """Haar shrinkage by the BayesShrink rule; sizes are padded to what the levels need."""
    size = x.shape[1:]
    levels = max(1, int(np.log2(min(size))) - 3) if levels is None else levels
    step = 2**levels
    y = pad(x, [0] * len(size), [-n % step for n in size], "reflect")
    sigma = noise_sigma(x) if sigma is None else np.full(len(x), float(sigma))
    var = sigma.reshape(-1, *[1] * len(size)) ** 2

    def shrink(d):
        total = np.mean(d**2, axis=tuple(range(1, d.ndim)), keepdims=True)
        signal = np.sqrt(np.maximum(total - var, 1e-12))
        t = var / signal
        return np.sign(d) * np.maximum(np.abs(d) - t, 0) if soft else np.where(np.abs(d) > t, d, 0)

    def run(a, level):
        if not level:
            return a
        bands = {(): a}
        for axis in range(1, a.ndim):
            bands = {(*k, i): part for k, v in bands.items() for i, part in enumerate(_haar(v, axis))}
        bands = {k: shrink(v) if any(k) else run(v, level - 1) for k, v in bands.items()}
        for axis in range(a.ndim - 1, 0, -1):
            joined = {}
            for k in {k[:-1] for k in bands}:
                low, high = bands[(*k, 0)], bands[(*k, 1)]
                pair = np.stack([(low + high) / 2**0.5, (low - high) / 2**0.5], axis + 1)
                joined[k] = pair.reshape(*low.shape[:axis], 2 * low.shape[axis], *low.shape[axis + 1 :])
            bands = joined
        return bands[()]

    return run(y, levels)[(slice(None), *(slice(n) for n in size))]


def local_binary_pattern(x, points=12, radius=1.0, method="default"):
    from .geometry import sample

    n = len(x)
    yy, xx = np.mgrid[: x.shape[1], : x.shape[2]]
    angles = 2 * np.pi * np.arange(points) / points
    bits = []
    for a in angles:
        where = np.stack([yy - round(radius * np.sin(a), 5), xx + round(radius * np.cos(a), 5)])
        bits.append(np.stack([sample(x[i], where, 1, "constant", 0.0) for i in range(n)]) >= x)
    bits = np.stack(bits)
    if method == "default":
        return (bits * (2 ** np.arange(points)).reshape(-1, 1, 1, 1)).sum(0).astype(float)
    if method == "ror":
        codes = np.stack([(np.roll(bits, k, 0) * (2 ** np.arange(points)).reshape(-1, 1, 1, 1)).sum(0) for k in range(points)])
        return codes.min(0).astype(float)
    if method == "uniform":
        changes = (bits != np.roll(bits, 1, 0)).sum(0)
        return np.where(changes <= 2, bits.sum(0), points + 1).astype(float)
    raise ValueError(f"unknown method {method!r}")


# surfaces -----------------------------------------------------------------------


def gaussian_surface(shape, a: float, b: float, mu, sg) -> np.ndarray:
    """a exp(-((r - mu) / sg)^2 / 2) + b on a grid."""
    r = np.indices(shape)
    return a * np.exp(-0.5 * sum(((q - m) / s) ** 2 for q, m, s in zip(r, mu, sg))) + b


def fit_gaussian(x: np.ndarray, step: int = 1, turns: int = 200) -> tuple[float, float, np.ndarray, np.ndarray, float]:
    """Least squares by damped Gauss-Newton steps from the greatest value and the 5th and 95th percentiles: a, b, mu, sg, root mean square error."""
    d, grid = x.ndim, np.indices(x.shape)[(slice(None), *[slice(None, None, step)] * x.ndim)].reshape(x.ndim, -1)
    y = x[(slice(None, None, step),) * d].ravel().astype(float)
    low, high = np.percentile(y, [5, 95])
    p = np.concatenate([[high - low, low], grid[:, y.argmax()], np.array(x.shape, float) / 2])

    def model(p):
        u = (grid - p[2 : 2 + d, None]) / p[2 + d :, None]
        e = np.exp(-0.5 * (u**2).sum(0))
        slopes = np.stack([e, np.ones_like(e), *(p[0] * e * u / p[2 + d :, None]), *(p[0] * e * u**2 / p[2 + d :, None])])
        return p[0] * e + p[1] - y, slopes

    damp, (error, slopes) = 1e-3, model(p)
    for _ in range(turns):
        square = slopes @ slopes.T
        move = np.linalg.lstsq(square + damp * np.diag(np.diag(square) + 1e-12), slopes @ error, rcond=None)[0]
        trial = p - move
        trial[2 + d :] = np.maximum(np.abs(trial[2 + d :]), 1e-3)
        error2, slopes2 = model(trial)
        if (error2**2).sum() < (error**2).sum():
            done = (error**2).sum() - (error2**2).sum() <= 1e-12 * (error**2).sum()
            p, error, slopes, damp = trial, error2, slopes2, damp / 3
            if done:
                break
        else:
            damp *= 4
            if damp > 1e12:
                break
    return float(p[0]), float(p[1]), p[2 : 2 + d], p[2 + d :], float(np.sqrt((error**2).mean()))
