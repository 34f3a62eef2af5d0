"""Morphology, thresholds, labels and regions of stacks."""

from __future__ import annotations

import heapq
import itertools
from collections.abc import Callable, Sequence

import numpy as np

from . import tree
from .filters import ball, maximum, mean, minimum, deviation, pad, taps


def neighbours(ndim: int, connectivity: int | None = None) -> np.ndarray:
    """Footprint of the direct neighbours, without the centre."""
    connectivity = ndim if connectivity is None else connectivity
    d = sum(np.abs(g) for g in np.meshgrid(*[np.arange(-1, 2)] * ndim, indexing="ij"))
    return (d > 0) & (d <= connectivity)


def erosion(x, radius=1.0, mode="reflect", cval=0.0):
    if x.dtype == bool:
        return minimum(x.astype(np.int8), ball(radius, x.ndim - 1), "constant", 1).astype(bool)
    return minimum(x, ball(radius, x.ndim - 1), mode, cval)


def dilation(x, radius=1.0, mode="reflect", cval=0.0):
    if x.dtype == bool:
        return maximum(x.astype(np.int8), ball(radius, x.ndim - 1), "constant", 0).astype(bool)
    return maximum(x, ball(radius, x.ndim - 1), mode, cval)


def opening(x, radius=1.0, mode="reflect", cval=0.0):
    return dilation(erosion(x, radius, mode, cval), radius, mode, cval)


def closing(x, radius=1.0, mode="reflect", cval=0.0):
    return erosion(dilation(x, radius, mode, cval), radius, mode, cval)


def tophat(x, radius=30.0, mode="reflect", cval=0.0):
    return x - opening(x, radius, mode, cval)


def label(x: np.ndarray, connectivity: int | None = None) -> np.ndarray:
    """Components of equal non-zero neighbours, numbered in raster order within each array of the stack."""
    d, size = x.ndim - 1, int(np.prod(x.shape[1:]))
    own = np.where(x != 0, np.arange(1, size + 1).reshape(x.shape[1:]), 0)
    wide = pad(x, [1] * d, [1] * d, "constant", 0)
    f = neighbours(d, connectivity)
    same = [(at, (p == x) & (x != 0)) for at, p in taps(x, f, "constant", 0, [1] * d)]
    del wide
    while True:
        new = own.copy()
        for at, ok in same:
            part = pad(own, [1] * d, [1] * d, "constant", 0)[(slice(None), *(slice(a, a + n) for a, n in zip(at, x.shape[1:])))]
            np.minimum(new, part, out=new, where=ok)
        # jump to the least number known at the place that the number stands for
        flat = np.concatenate([np.zeros((len(x), 1), new.dtype), new.reshape(len(x), -1)], 1)
        new = np.take_along_axis(flat, new.reshape(len(x), -1), 1).reshape(new.shape)
        if (new == own).all():
            break
        own = new
    return renumber(own)


def renumber(x: np.ndarray) -> np.ndarray:
    """Numbers 1, 2, ... in the order of the old ones, per array; 0 stays."""
    out = np.zeros(x.shape, np.int64)
    for i, a in enumerate(x):
        ids, inverse = np.unique(a, return_inverse=True)
        out[i] = (np.cumsum(ids != 0) * (ids != 0))[inverse].reshape(a.shape)
    return out


def area_opening(x, area=64, connectivity=1):
    """Components of True with fewer pixels go; grey images by their component trees."""
    if x.dtype != bool:
        return np.stack([tree.area_opening(a, area, neighbours(a.ndim, connectivity)) for a in x])
    lab = label(x.astype(np.int64), connectivity)
    out = x.copy()
    for i, a in enumerate(lab):
        out[i] &= np.bincount(a.ravel())[a] >= area
    return out


def area_closing(x, area=64, connectivity=1):
    return ~area_opening(~x, area, connectivity) if x.dtype == bool else -area_opening(-x, area, connectivity)


def _extent(lab: np.ndarray) -> np.ndarray:
    """Longest side of the bounding box of each label (index 0 unused)."""
    n = int(lab.max()) + 1
    out = np.zeros(n, int)
    at = np.nonzero(lab)
    ids = lab[at]
    for a in at:
        lo, hi = np.full(n, 10**9), np.full(n, -1)
        np.minimum.at(lo, ids, a)
        np.maximum.at(hi, ids, a)
        out = np.maximum(out, hi - lo + 1)
    return out


def diameter_opening(x, diameter=8, connectivity=1):
    if x.dtype != bool:
        return np.stack([tree.diameter_opening(a, diameter, neighbours(a.ndim, connectivity)) for a in x])
    lab = label(x.astype(np.int64), connectivity)
    out = x.copy()
    for i, a in enumerate(lab):
        out[i] &= _extent(a)[a] >= diameter
    return out


def diameter_closing(x, diameter=8, connectivity=1):
    return ~diameter_opening(~x, diameter, connectivity) if x.dtype == bool else -diameter_opening(-x, diameter, connectivity)


def distance_map(x: np.ndarray) -> np.ndarray:
    """Distance of each True pixel to the nearest False one, axis by axis on squared distances."""
    big = float(sum(n**2 for n in x.shape[1:]) + 1) ** 2
    d = np.where(x, big, 0.0)
    for axis in range(1, x.ndim):
        n = x.shape[axis]
        step = np.square(np.subtract.outer(np.arange(n), np.arange(n))).astype(float)
        m = np.moveaxis(d, axis, -1)
        d = np.moveaxis(np.stack([(m + step[i]).min(-1) for i in range(n)], -1), -1, axis)
    return np.sqrt(np.where(d >= big, np.inf, d))


def nearest_label(lab: np.ndarray, distance: float) -> np.ndarray:
    """Labels grown by at most the distance; the nearest one wins, the least number on a tie."""
    out = lab.copy()
    best = np.where(lab > 0, 0.0, np.inf)
    r = int(distance)
    offsets = sorted(itertools.product(range(-r, r + 1), repeat=lab.ndim - 1), key=lambda o: sum(i * i for i in o))
    wide = pad(lab, [r] * (lab.ndim - 1), [r] * (lab.ndim - 1), "constant", 0)
    for o in offsets:
        d2 = float(sum(i * i for i in o))
        if d2 > distance**2:
            continue
        part = wide[(slice(None), *(slice(r + i, r + i + n) for i, n in zip(o, lab.shape[1:])))]
        better = (part > 0) & ((d2 < best) | ((d2 == best) & (part < out) & (lab == 0)))
        out[better], best[better] = part[better], d2
    return out


def smooth_mask(x, sigma=2.0, radius=2.0, light=False):
    y = ~x if light else x
    y = dilation(y, radius) if radius > 0 else erosion(y, -radius) if radius < 0 else y
    d = distance_map(~y)
    out = np.exp(-0.5 * np.square(np.where(np.isinf(d), 1e9, d)) / sigma**2)
    return 1 - out if light else out


def count_neighbours(x, connectivity=None, mask=True):
    n = sum(p.astype(np.int64) for _, p in taps(x, neighbours(x.ndim - 1, connectivity), "constant", 0, [1] * (x.ndim - 1)))
    return np.where(x, n, 0) if mask else n


def drop_structure(x, structure="tip", connectivity=None):
    n = count_neighbours(x, connectivity)
    bad = {"tip": n == 1, "branch": n > 2, "cross": n > 3}[structure]
    return x & ~bad


def skeleton(x: np.ndarray) -> np.ndarray:
    """Thinning of 2-D masks in two alternating passes until nothing changes."""
    out = x.copy()
    ring = [(-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1)]
    while True:
        before = out.copy()
        for odd in (False, True):
            wide = pad(out, [1, 1], [1, 1], "constant", 0).astype(bool)
            p = [wide[:, 1 + a : 1 + a + x.shape[1], 1 + b : 1 + b + x.shape[2]] for a, b in ring]
            total = sum(q.astype(int) for q in p)
            turns = sum((~p[i] & p[(i + 1) % 8]).astype(int) for i in range(8))
            n, e, s, w = p[0], p[2], p[4], p[6]
            sides = ~(n & e & w) & ~(n & s & w) if odd else ~(n & e & s) & ~(e & s & w)
            out = out & ~((total >= 2) & (total <= 6) & (turns == 1) & sides)
        if (out == before).all():
            return out


def convex_hull(x: np.ndarray) -> np.ndarray:
    """Hull of the True pixels' centres of each 2-D mask, filled."""
    out = np.zeros(x.shape, bool)
    yy, xx = np.mgrid[: x.shape[1], : x.shape[2]]
    for i, a in enumerate(x):
        pts = sorted(zip(*np.nonzero(a)))
        if not pts:
            continue
        hull = []
        for way in (pts, pts[::-1]):
            part: list = []
            for p in way:
                while len(part) > 1 and (part[-1][0] - part[-2][0]) * (p[1] - part[-2][1]) - (part[-1][1] - part[-2][1]) * (p[0] - part[-2][0]) <= 0:
                    part.pop()
                part.append(p)
            hull += part[:-1]
        if len(hull) < 2:
            out[i][pts[0]] = True
            continue
        inside = np.ones(a.shape, bool)
        for (ay, ax), (by, bx) in zip(hull, [*hull[1:], hull[0]]):
            inside &= (by - ay) * (xx - ax) - (bx - ax) * (yy - ay) >= 0
        lo, hi = np.min(hull, 0), np.max(hull, 0)
        out[i] = inside & (yy >= lo[0]) & (yy <= hi[0]) & (xx >= lo[1]) & (xx <= hi[1])
    return out


def fill_holes(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Reconstruction by erosion from a seed that is the maximum inside and the image at the border."""
    d = x.ndim - 1
    seed = np.where(mask, x.reshape(len(x), -1).max(1).reshape(-1, *[1] * d), x)
    cross = neighbours(d, 1)
    while True:
        new = np.maximum(np.minimum(seed, minimum(seed, cross, "nearest")), x)
        if (new == seed).all():
            return new
        seed = new


def inpaint_mean(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Each masked region takes the mean of the pixels around it."""
    out = x.astype(float).copy()
    lab = label(np.broadcast_to(mask, x.shape).astype(np.int64))
    ring = np.ones((3,) * (x.ndim - 1), bool)
    for i, a in enumerate(lab):
        for k in range(1, int(a.max()) + 1):
            region = a == k
            border = maximum(region[None].astype(np.int8), ring, "constant", 0)[0].astype(bool) & (a == 0)
            out[i][region] = x[i][border].mean() if border.any() else 0.0
    return out


def inpaint_biharmonic(x: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Masked pixels solve the discrete biharmonic equation with reflecting ends."""
    from .filters import along

    out = x.astype(float).copy()
    mask = np.broadcast_to(mask, x.shape)
    lap = np.array([1.0, -2.0, 1.0])
    for i in range(len(x)):
        at = np.flatnonzero(mask[i])
        if not len(at):
            continue

        def operate(v):
            for _ in range(2):
                v = sum(along(v, lap, a) for a in range(v.ndim - 1))
            return v.reshape(len(v), -1)[:, at]

        unit = np.zeros((len(at), x[i].size))
        unit[np.arange(len(at)), at] = 1
        known = np.where(mask[i], 0, x[i])
        a = operate(unit.reshape(len(at), *x[i].shape)).T
        out[i].ravel()[at] = np.linalg.lstsq(a, -operate(known[None].astype(float))[0], rcond=None)[0]
    return out


# thresholds ------------------------------------------------------------------


def histogram(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts and bin centres: a bin for each integer, else 256 bins from least to greatest."""
    if v.dtype.kind in "iub":
        lo = int(v.min())
        counts = np.bincount(v.astype(np.int64).ravel() - lo)
        return counts.astype(float), np.arange(len(counts)) + lo
    counts, at = np.histogram(v, 256)
    return counts.astype(float), (at[1:] + at[:-1]) / 2


def otsu(n, c):
    w1, w2 = np.cumsum(n), np.cumsum(n[::-1])[::-1]
    m1 = np.cumsum(n * c) / w1
    m2 = (np.cumsum((n * c)[::-1]) / w2[::-1])[::-1]
    between = w1[:-1] * w2[1:] * (m1[:-1] - m2[1:]) ** 2
    return float(c[np.round(between, 3).argmax()]) if len(between) else float(c[0])


def yen(n, c):
    p = n / n.sum()
    below = np.cumsum(p)
    sq, rest = np.cumsum(p**2), np.cumsum((p**2)[::-1])[::-1]
    with np.errstate(divide="ignore", invalid="ignore"):
        crit = np.log((sq[:-1] * rest[1:]) ** -1 * (below[:-1] * (1 - below[:-1])) ** 2)
    return float(c[np.nan_to_num(crit, nan=-np.inf, posinf=-np.inf).argmax()]) if len(crit) else float(c[0])


def isodata(n, c):
    low, high = np.cumsum(n), np.cumsum(n[::-1])[::-1] - n
    total = np.cumsum(n * c)
    with np.errstate(divide="ignore", invalid="ignore"):
        middle = (total / low + (total[-1] - total) / high) / 2
    gap, width = middle - c, (c[1] - c[0] if len(c) > 1 else 1)
    ok = np.flatnonzero((gap >= 0) & (gap < width))
    return float(c[ok[0]]) if len(ok) else float(c[0])


def li(v, steps=1000):
    x = v.astype(float).ravel()
    low = x.min()
    x = x - low
    gaps = np.diff(np.unique(x))
    tol = (gaps.min() if len(gaps) else 1) / 2
    t, last = x.mean(), -np.inf
    for _ in range(steps):
        if abs(t - last) <= tol:
            break
        last, up = t, x > t
        a, b = x[up].mean() if up.any() else 0.0, x[~up].mean() if (~up).any() else 0.0
        if a <= 0 or b <= 0 or a == b:
            break
        t = (b - a) / (np.log(b) - np.log(a))
    return float(t + low)


def triangle(n, c):
    peak, lo, hi = n.argmax(), np.flatnonzero(n)[0], np.flatnonzero(n)[-1]
    if lo == hi:
        return float(c[lo])
    flip = peak - lo < hi - peak
    if flip:
        n, lo, peak = n[::-1], len(n) - 1 - hi, len(n) - 1 - peak
    width, x = peak - lo, np.arange(peak - lo)
    norm = np.hypot(n[peak], width)
    level = (n[peak] / norm * x - width / norm * n[x + lo]).argmax() + lo
    return float(c[len(n) - 1 - level if flip else level])


def minimum_between_modes(n, c, steps=10000):
    for _ in range(steps):
        peaks = [i for i in range(len(n)) if (i == 0 or n[i] > n[i - 1]) and (i == len(n) - 1 or n[i] >= n[i + 1])]
        if len(peaks) <= 2:
            break
        n = np.convolve(np.pad(n, 1, "symmetric"), np.ones(3) / 3, "valid")
    if len(peaks) != 2:
        raise ValueError("no two modes")
    return float(c[peaks[0] + n[peaks[0] : peaks[1] + 1].argmin()])


#: From counts and bin centres.
OF_HISTOGRAM: dict[str, Callable[[np.ndarray, np.ndarray], float]] = {"otsu": otsu, "yen": yen, "isodata": isodata, "triangle": triangle, "minimum": minimum_between_modes}
THRESHOLDS: dict[str, Callable[[np.ndarray], float]] = {"li": li, "mean": lambda v: float(v.mean()), **{k: (lambda v, f=f: f(*histogram(v))) for k, f in OF_HISTOGRAM.items()}}


def threshold(x: np.ndarray, how: float | str = "otsu", **options) -> np.ndarray:
    """v >= threshold: a number, 'p%' of the percentiles, a histogram method, or a local one (per array of the stack)."""
    if x.dtype == bool:
        return x
    if not isinstance(how, str):
        return x >= how
    if how.endswith("%"):
        q = np.percentile(x.reshape(len(x), -1), float(how[:-1]), axis=1)
        return x >= q.reshape(-1, *[1] * (x.ndim - 1))
    if how in ("niblack", "sauvola", "local"):
        box = np.ones((options.get("size", 15),) * (x.ndim - 1), bool)
        m, s = mean(x.astype(float), box, "mirror"), deviation(x.astype(float), box, "mirror")
        k = options.get("k", 0.2)
        if how == "niblack":
            return x >= m - k * s
        if how == "sauvola":
            half = np.ptp(x, tuple(range(1, x.ndim)), keepdims=True) / 2
            r = options.get("r", np.where(half > 0, half, 1.0))
            return x >= m * (1 + k * (s / r - 1))
        return x >= m - options.get("offset", 0)
    t = np.array([THRESHOLDS[how](a) for a in x])
    return x >= t.reshape(-1, *[1] * (x.ndim - 1))


# seeds and floods ------------------------------------------------------------


def peaks(x: np.ndarray, distance: float = 1.0, level: float | None = None, most: int | None = None, border: bool = True, labels: np.ndarray | None = None, most_per_label: int | None = None) -> list[np.ndarray]:
    """Coordinates of local maxima of each array, brightest first; equal neighbours are thinned in that order."""
    f = ball(distance, x.ndim - 1)
    top = (x == maximum(x, f, "nearest")) & (x > (x.min(tuple(range(1, x.ndim)), keepdims=True) if level is None else level))
    if labels is not None:
        top &= labels > 0
    if border:
        edge = int(distance)
        inner = np.zeros(x.shape[1:], bool)
        inner[tuple(slice(edge, n - edge) for n in x.shape[1:])] = True
        top &= inner
    out = []
    for i in range(len(x)):
        at = np.argwhere(top[i])
        at = at[np.argsort(-x[i][top[i]], kind="stable")]
        kept, per = [], {}
        for p in at:
            if any(((p - q) ** 2).sum() <= distance**2 for q in kept):
                continue
            if labels is not None and most_per_label is not None:
                k = int(labels[i][tuple(p)])
                if per.get(k, 0) >= most_per_label:
                    continue
                per[k] = per.get(k, 0) + 1
            kept.append(p)
        out.append(np.array(kept[:most]).reshape(-1, x.ndim - 1))
    return out


def watershed(x: np.ndarray, markers: np.ndarray, mask: np.ndarray | None = None, connectivity: int = 1) -> np.ndarray:
    """Flooding of one array from its markers, lowest values first, earliest first on ties."""
    out, size = markers.astype(np.int64).copy(), x.shape
    mask = np.ones(size, bool) if mask is None else mask
    steps = [np.array(s) - 1 for s in zip(*np.nonzero(neighbours(x.ndim, connectivity)))]
    heap, count = [], 0
    for p in zip(*np.nonzero(out)):
        heap.append((float(x[p]), count, p))
        count += 1
    heapq.heapify(heap)
    while heap:
        _, _, p = heapq.heappop(heap)
        for s in steps:
            q = tuple(int(v) for v in np.add(p, s))
            if all(0 <= a < n for a, n in zip(q, size)) and mask[q] and out[q] == 0:
                out[q] = out[p]
                count += 1
                heapq.heappush(heap, (float(x[q]), count, q))
    return np.where(mask, out, 0)


def random_walker(x: np.ndarray, seeds: np.ndarray, beta: float = 130.0) -> np.ndarray:
    """Each pixel takes the seed that a random walk on image gradients meets most likely first.

    Conjugate gradients on the grid itself, a seed at a time: memory is a few arrays of x's size.
    """
    scale = beta / (10 * x.std()) if x.std() else beta
    weight = [np.exp(-scale * np.diff(x, axis=a) ** 2) + 1e-10 for a in range(x.ndim)]
    lower = [tuple(slice(None, -1) if i == a else slice(None) for i in range(x.ndim)) for a in range(x.ndim)]
    upper = [tuple(slice(1, None) if i == a else slice(None) for i in range(x.ndim)) for a in range(x.ndim)]
    degree = np.zeros(x.shape)
    for w, lo, hi in zip(weight, lower, upper):
        degree[lo] += w
        degree[hi] += w

    def laplacian(p: np.ndarray) -> np.ndarray:
        out = degree * p
        for w, lo, hi in zip(weight, lower, upper):
            out[lo] -= w * p[hi]
            out[hi] -= w * p[lo]
        return out

    free, ids = seeds == 0, np.unique(seeds[seeds != 0])
    if not len(ids) or not free.any():
        return seeds.copy()
    best, out = np.full(x.shape, -np.inf), seeds.copy()
    for k in ids:
        right = np.where(free, -laplacian((seeds == k).astype(float)), 0)
        p, left = np.zeros(x.shape), right.copy()
        z = left / degree
        way, size = z.copy(), float((left * z).sum())
        goal = size * 1e-20
        for _ in range(2 * int(free.sum())):
            if size <= goal:
                break
            moved = np.where(free, laplacian(way), 0)
            t = size / float((way * moved).sum())
            p += t * way
            left -= t * moved
            z = left / degree
            size, before = float((left * z).sum()), size
            way = z + size / before * way
        nearer = free & (p > best)
        best[nearer], out[nearer] = p[nearer], k
    return out


def flood(x: np.ndarray, seed: Sequence[int], tolerance: float = 0.0, connectivity: int | None = None) -> np.ndarray:
    """Pixels of one array that are joined to the seed through values within the tolerance of its own."""
    near = np.abs(x.astype(float) - float(x[tuple(seed)])) <= tolerance
    lab = label(near[None].astype(np.int64), connectivity)[0]
    return lab == lab[tuple(seed)]


# regions ---------------------------------------------------------------------


def region_properties(lab: np.ndarray, x: np.ndarray | None, names: Sequence[str], scale: Sequence[float] | None = None) -> dict[int, dict[str, float]]:
    """Properties of the labels of one array."""
    out: dict[int, dict[str, float]] = {}
    for k in np.unique(lab[lab > 0]):
        at = np.argwhere(lab == k)
        area, mid = len(at), at.mean(0)
        lo, hi = at.min(0), at.max(0) + 1
        v = x[lab == k].astype(float) if x is not None else None
        values: dict[str, float] = {}
        for name in names:
            if name in ("area", "num_pixels"):
                values[name] = float(area)
            elif name in ("bbox_area", "area_bbox"):
                values[name] = float(np.prod(hi - lo))
            elif name == "extent":
                values[name] = area / float(np.prod(hi - lo))
            elif name == "bbox":
                values |= {f"bbox-{i}": float(b) for i, b in enumerate([*lo, *hi])}
            elif name == "centroid":
                values |= {f"centroid-{i}": float(c) for i, c in enumerate(mid)}
            elif name in ("equivalent_diameter", "equivalent_diameter_area"):
                values[name] = float((4 * area / np.pi) ** 0.5 if lab.ndim == 2 else (6 * area / np.pi) ** (1 / 3))
            elif name in ("mean_intensity", "intensity_mean"):
                values[name] = float(v.mean())
            elif name in ("max_intensity", "intensity_max"):
                values[name] = float(v.max())
            elif name in ("min_intensity", "intensity_min"):
                values[name] = float(v.min())
            elif name == "intensity_std":
                values[name] = float(v.std())
            elif name in ("weighted_centroid", "centroid_weighted"):
                values |= {f"{name}-{i}": float(c) for i, c in enumerate((at * v[:, None]).sum(0) / v.sum())}
            elif name in ("orientation", "major_axis_length", "axis_major_length", "minor_axis_length", "axis_minor_length", "eccentricity", "inertia_tensor_eigvals"):
                d = at - mid
                a, b, c = (d[:, 0] ** 2).mean() + 1 / 12, -(d[:, 0] * d[:, 1]).mean(), (d[:, 1] ** 2).mean() + 1 / 12
                root = np.sqrt(((a - c) / 2) ** 2 + b**2)
                big, small = (a + c) / 2 + root, max(0.0, (a + c) / 2 - root)
                values[name] = float({"orientation": 0.5 * np.arctan2(-2 * b, a - c), "eccentricity": np.sqrt(1 - small / big) if big else 0.0}.get(name, 4 * np.sqrt(big if "major" in name else small)))
            elif name == "perimeter":
                values[name] = perimeter(lab == k)
            elif name == "euler_number":
                values[name] = float(euler_number(lab == k))
            elif name in ("convex_area", "area_convex"):
                values[name] = float(convex_hull((lab == k)[None])[0].sum())
            elif name == "solidity":
                values[name] = area / float(convex_hull((lab == k)[None])[0].sum())
            elif name in ("feret_diameter_max", "feret_diameter"):
                corners = np.concatenate([at + s for s in itertools.product((-0.5, 0.5), repeat=lab.ndim)])
                values[name] = float(np.sqrt(max(((corners - c) ** 2).sum(1).max() for c in corners)))
            else:
                raise ValueError(f"unknown property {name!r}")
        out[int(k)] = values
    return out


def perimeter(mask: np.ndarray) -> float:
    """Length of the 4-connected border line of a 2-D mask, diagonal steps weighing more."""
    m = mask[None]
    inner = minimum(m.astype(np.int8), neighbours(2, 1) | (np.arange(9) == 4).reshape(3, 3), "constant", 0)
    border = m & ~inner.astype(bool)
    kernel = np.array([[10, 2, 10], [2, 1, 2], [10, 2, 10]])
    from .filters import correlate

    code = np.bincount(correlate(border.astype(float), kernel, "constant").astype(int)[border].ravel(), minlength=50)
    straight, diagonal = code[[5, 7, 15, 17, 25, 27]].sum(), code[[21, 33]].sum()
    return float(straight + diagonal * 2**0.5 + code[[13, 23]].sum() * (1 + 2**0.5) / 2)


def euler_number(mask: np.ndarray) -> int:
    """Objects (8-neighbours) minus holes of a 2-D mask."""
    objects = label(mask[None].astype(np.int64), 2).max()
    holes = label(np.pad(~mask, 1, constant_values=True)[None].astype(np.int64), 1).max() - 1
    return int(objects - holes)


def cooccurrence(x: np.ndarray, distance: float, angle: float, levels: int) -> np.ndarray:
    """Counts of grey value pairs at an offset within one array."""
    dy, dx = int(round(np.sin(angle) * distance)), int(round(np.cos(angle) * distance))
    h, w = x.shape
    a = x[max(0, -dy) : h - max(0, dy), max(0, -dx) : w - max(0, dx)]
    b = x[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)]
    return np.bincount(a.ravel() * levels + b.ravel(), minlength=levels * levels).reshape(levels, levels).astype(float)


def cooccurrence_property(g: np.ndarray, name: str) -> float:
    """A texture measure of normalised pair counts."""
    p = g / g.sum() if g.sum() else g
    i, j = np.indices(g.shape)
    mi, mj = (p * i).sum(), (p * j).sum()
    si, sj = np.sqrt((p * (i - mi) ** 2).sum()), np.sqrt((p * (j - mj) ** 2).sum())
    match name:
        case "contrast":
            return float((p * (i - j) ** 2).sum())
        case "dissimilarity":
            return float((p * np.abs(i - j)).sum())
        case "asm":
            return float((p**2).sum())
        case "idm":
            return float((p / (1 + (i - j) ** 2)).sum())
        case "energy":
            return float(np.sqrt((p**2).sum()))
        case "max":
            return float(p.max())
        case "entropy":
            return float(-(p[p > 0] * np.log(p[p > 0])).sum())
        case "correlation":
            return float((p * (i - mi) * (j - mj)).sum() / (si * sj)) if si * sj > 1e-15 else 1.0
        case "mean_ref" | "mean_neighbor":
            return float(mi if name == "mean_ref" else mj)
        case "std_ref" | "std_neighbor":
            return float(si if name == "std_ref" else sj)
    raise ValueError(f"unknown property {name!r}")
