"""Operators on array frames, as methods.

Each takes ``dims``, the spatial axes that the kernel takes together (all of
zyx by default); the others are treated like batch axes.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..axes import AxesError, Axis
from ..frame import ArrayFrame, cast, method
from ..functions import filters, fourier, geometry, objects

SERIES_VALUES = 4096  # values of a plane that one task filters along a series


def over(frame: ArrayFrame, kernel: Callable[[np.ndarray], np.ndarray], dims=None, dtype: str | None = None) -> ArrayFrame:
    """The kernel on the given spatial axes; the result has the same axes (sizes may change)."""
    dims = frame.dims(dims)
    names = frame.space.names
    if dims == names:
        probe = kernel(np.zeros((1, *frame.shape), bool if frame.dtype == "bool" else float)) if kernel.__dict__.get("resizes") else None
        return frame.map(kernel, dtype, shape=probe.shape[1:] if probe is not None else None)
    rest = [a for a in names if a not in dims]
    order = [names.index(a) + 1 for a in [*rest, *dims]]
    back = np.argsort([0, *order])

    def run(x: np.ndarray) -> np.ndarray:
        y = x.transpose(0, *order)
        z = kernel(y.reshape(-1, *y.shape[1 + len(rest) :]))
        return z.reshape(*y.shape[: 1 + len(rest)], *z.shape[1:]).transpose(back)

    return frame.map(run, dtype)


def resizing(kernel: Callable) -> Callable:
    kernel.__dict__["resizes"] = True
    return kernel


def _simple(name: str, kernel: Callable, doc: str, dtype: str | None = None, radius: bool = False) -> None:
    def op(self: ArrayFrame, *args, dims=None, **kwargs) -> ArrayFrame:
        if radius:
            r = args[0] if args else kwargs.pop("radius", 1.0)
            foot = filters.ball(r, len(self.dims(dims)))
            return over(self, lambda x: kernel(x, foot, **kwargs), dims, dtype)
        return over(self, lambda x: kernel(x, *args, **kwargs), dims, dtype)

    op.__name__, op.__doc__ = name, doc
    method(op)


for _name, _kernel, _doc in (
    ("mean_filter", filters.mean, "Mean in a ball."),
    ("min_filter", filters.minimum, "Minimum in a ball."),
    ("max_filter", filters.maximum, "Maximum in a ball."),
    ("median_filter", filters.median, "Upper median in a ball."),
    ("std_filter", filters.deviation, "Standard deviation in a ball."),
    ("coef_filter", filters.variation, "Standard deviation over mean in a ball."),
):
    _simple(_name, _kernel, _doc, radius=True)

for _name, _kernel, _doc, _dtype in (
    ("convolve", filters.convolve, "Convolution with a kernel.", None),
    ("laplacian_filter", filters.laplacian, "Minus the second differences.", None),
    ("edge_filter", filters.edges, "Edge magnitude: sobel, scharr, prewitt or farid.", None),
    ("edge_grad", filters.edge_angle, "Angle of the gradient after smoothing.", "float32"),
    ("log_filter", filters.laplacian_of_gaussian, "Laplacian of Gaussian; bright spots are positive.", None),
    ("doh_filter", filters.hessian_determinant, "Determinant of the Hessian at bright spots.", None),
    ("hessian_angle", filters.hessian_angle, "Orientation of the greatest curvature.", "float32"),
    ("gabor_filter", filters.gabor, "Convolution with a Gabor kernel.", None),
    ("gabor_angle", filters.gabor_angle, "Orientation of the strongest Gabor response.", "float32"),
    ("corner_harris", filters.harris, "Harris corner response.", "float32"),
    ("entropy_filter", filters.entropy, "Local entropy in bits.", "float32"),
    ("enhance_contrast", filters.enhance_contrast, "The local extreme that is nearer.", None),
    ("ncc_filter", filters.template_correlation, "Normalised correlation with a template.", "float32"),
    ("rolling_ball", filters.rolling_ball, "Image minus its rolling-ball background.", None),
    ("rof_filter", filters.total_variation, "Total variation denoising.", None),
    ("wavelet_denoising", filters.wavelet_denoise, "Wavelet shrinkage.", None),
    ("lbp", filters.local_binary_pattern, "Local binary patterns.", "float32"),
    ("erosion", objects.erosion, "Erosion by a ball.", None),
    ("dilation", objects.dilation, "Dilation by a ball.", None),
    ("opening", objects.opening, "Erosion, then dilation.", None),
    ("closing", objects.closing, "Dilation, then erosion.", None),
    ("tophat", objects.tophat, "Image minus its opening.", None),
    ("area_opening", objects.area_opening, "Bright components with fewer pixels go.", None),
    ("area_closing", objects.area_closing, "Dark components with fewer pixels go.", None),
    ("diameter_opening", objects.diameter_opening, "Bright components with a smaller extent go.", None),
    ("diameter_closing", objects.diameter_closing, "Dark components with a smaller extent go.", None),
    ("distance_map", objects.distance_map, "Distance to the background.", "float32"),
    ("smooth_mask", objects.smooth_mask, "A mask with a Gaussian edge.", "float32"),
    ("convex_hull", objects.convex_hull, "Convex hull of each mask.", None),
    ("skeletonize", objects.skeleton, "Thinned masks.", None),
    ("count_neighbors", objects.count_neighbours, "Number of true neighbours.", "int64"),
    ("remove_skeleton_structure", objects.drop_structure, "Tips, branches or crosses go.", None),
    ("threshold", objects.threshold, "Values that reach a threshold: a number, 'p%', or a method.", "bool"),
    ("lowpass_filter", fourier.lowpass, "Butterworth low pass.", None),
    ("highpass_filter", fourier.highpass, "Butterworth high pass.", None),
    ("bandpass_filter", fourier.bandpass, "Butterworth band pass.", None),
    ("wiener", fourier.wiener, "Wiener deconvolution.", None),
    ("lucy", fourier.lucy, "Richardson-Lucy deconvolution.", None),
    ("power_spectra", fourier.power, "Power spectrum.", "float64"),
    ("rotate", geometry.rotate, "Rotation about the centre, in degrees.", None),
    ("stretch", geometry.stretch, "Scaling about the centre.", None),
    ("shift", geometry.shift, "Translation.", None),
):
    _simple(_name, _kernel, _doc, _dtype)


def _paired(y: np.ndarray) -> np.ndarray:
    return np.stack([y.real, y.imag], -1)


@method
def fft(self: ArrayFrame, *, shape=None, shift: bool = True) -> ArrayFrame:
    """The transform over the spatial axes, with real and imaginary parts on a new last axis k.  shape: sizes to pad or crop to, or 'square'."""
    size = fourier.fft(np.zeros((1, *self.shape)), shift, shape).shape[1:]
    return self.map(lambda x: _paired(fourier.fft(x, shift, shape)), "float64", [*self.space, "k"], (*size, 2))


@method
def ifft(self: ArrayFrame, *, shift: bool = True, real: bool = True) -> ArrayFrame:
    """Back from a transform with parts on the last axis k; with real only the real part stays."""
    if self.space.names[-1:] != ["k"] or self.shape[-1] != 2:
        raise AxesError("a transform has its real and imaginary parts on a last axis k")

    def run(x):
        y = fourier.ifft(x[..., 0] + 1j * x[..., 1], shift, real)
        return y if real else _paired(y)

    space, size = (self.space.items[:-1], self.shape[:-1]) if real else (self.space, self.shape)
    return self.map(run, "float64", space, size)


def _window(self: ArrayFrame, upsample: int, ranges: dict) -> list[tuple[int, int]]:
    """The (start, stop) of frequencies k / upsample on each axis; the whole axis by default."""
    if unknown := set(ranges) - set(self.space.names):
        raise AxesError(f"axes {', '.join(sorted(unknown))} are not among {self.space}")
    return [tuple(ranges.get(a, (0, n * upsample))) for a, n in zip(self.space.names, self.shape)]


@method
def local_dft(self: ArrayFrame, *, upsample: int = 1, **ranges) -> ArrayFrame:
    """The transform at frequencies k / upsample for k in each axis' range (start, stop), with parts on a new last axis k."""
    at = _window(self, upsample, ranges)
    return self.map(lambda x: _paired(fourier.local_dft(x, at, upsample)), "float64", [*self.space, "k"], (*[b - a for a, b in at], 2))


@method
def local_power_spectra(self: ArrayFrame, *, upsample: int = 1, norm: bool = False, **ranges) -> ArrayFrame:
    """Power at such frequencies; with norm the greatest of each array is 1."""
    at = _window(self, upsample, ranges)

    def run(x):
        y = np.abs(fourier.local_dft(x, at, upsample)) ** 2
        return y / y.max(tuple(range(1, y.ndim)), keepdims=True) if norm else y

    return self.map(run, "float64", shape=[b - a for a, b in at])


@method
def gaussian_filter(self: ArrayFrame, sigma=1.0, *, fourier_space: bool = False, dims=None) -> ArrayFrame:
    return over(self, lambda x: fourier.gaussian(x, sigma) if fourier_space else filters.gaussian(x, sigma), dims)


@method
def dog_filter(self: ArrayFrame, low_sigma=1.0, high_sigma=None, *, fourier_space: bool = False, dims=None) -> ArrayFrame:
    """Difference of Gaussians; the wider one has 1.6 times the width by default."""

    def run(x):
        if not fourier_space:
            return filters.difference_of_gaussians(x, low_sigma, high_sigma)
        high = 1.6 * np.asarray(low_sigma, float) if high_sigma is None else high_sigma
        return fourier.gaussian(x, low_sigma) - fourier.gaussian(x, high)

    return over(self, run, dims)


@method
def lucy_tv(self: ArrayFrame, psf, steps: int = 50, weight: float = 1e-3, tolerance: float = 1e-3, *, dims=None) -> ArrayFrame:
    return over(self, lambda x: np.concatenate([fourier.lucy(a[None], psf, steps, 1e-5, weight, tolerance) for a in x]), dims)


@method
def lowpass_conv_filter(self: ArrayFrame, cutoff: float = 0.2, order: float = 2, *, dims=None) -> ArrayFrame:
    sizes = [n for a, n in zip(self.space.names, self.shape) if a in self.dims(dims)]
    return over(self, lambda x: filters.convolve(x, fourier.lowpass_kernel(sizes, cutoff, order)), dims)


@method
def kalman_filter(self: ArrayFrame, gain: float = 0.8, along: str = "t") -> ArrayFrame:
    """Recursive filter along an axis, in order.

    Along a batch axis the planes are cut into pieces of SERIES_VALUES values, and each
    task takes the series of one piece; arrays are shuffled, not pixels.
    """
    if along in self.space:
        i = self.space.find(along) + 1
        return self.map(lambda x: np.moveaxis(filters.kalman(np.moveaxis(x, i, 1), gain), 1, i))
    self.axes.find(along)
    rest = [b for b in self.batch.names if b != along]
    pieces = -(-math.prod(self.shape) // SERIES_VALUES)
    cut = F.transform(F.sequence(F.lit(0), F.lit(pieces - 1)), lambda k: F.slice("data", k * SERIES_VALUES + 1, SERIES_VALUES))
    series = self.df.select(*rest, along, F.posexplode(cut).alias("_k", "data"))
    kind = self.dtype

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by(along)
        x = np.stack(table.column("data").to_numpy(zero_copy_only=False))
        y = cast(filters.kalman(x[None], gain)[0], kind).astype(float)
        field = table.schema.field("data")
        return table.set_column(table.schema.get_field_index("data"), field, pa.array(list(y), field.type))

    out = series.groupBy(*rest, "_k").applyInArrow(run, series.schema)
    if pieces > 1:
        parts = F.array_sort(F.collect_list(F.struct("_k", "data")))
        out = out.groupBy(*self.batch.names).agg(F.flatten(F.transform(parts, lambda q: q["data"])).alias("data"))
    return self._with(out.select(*self.batch.names, "data"))


@method
def reshape(self: ArrayFrame, space, shape: Sequence[int]) -> ArrayFrame:
    """Other spatial axes for the same values in the same order; the data are not touched."""
    if math.prod(shape) != math.prod(self.shape):
        raise AxesError(f"{tuple(shape)} does not hold the values of {self.shape}")
    return self._with(self.df, space=space, shape=tuple(shape))


@method
def pathprops(self: ArrayFrame, paths: Sequence, properties: Sequence = ("mean",), *, order: int = 1) -> DataFrame:
    """A row per array, path and property: N (the path's place), prop, value. Paths are point lists; properties are numpy's names or functions of the values along a path."""
    known = {(f if isinstance(f, str) else f.__name__): (getattr(np, f) if isinstance(f, str) else f) for f in properties}
    along = [geometry.polyline(np.asarray(p, float)) for p in paths]
    if any(len(p) != len(self.shape) for p in along):
        raise AxesError(f"paths need a coordinate for each of {self.space}")

    def run(x):
        rows = [(i, n, name, float(f(values))) for i, a in enumerate(x) for n, p in enumerate(along) for values in [geometry.sample(a, p, order)] for name, f in known.items()]
        row, number, prop, value = zip(*rows) if rows else ((), (), (), ())
        return {"row": list(row), "N": list(number), "prop": list(prop), "value": list(value)}

    return self.table(run, "N long, prop string, value double")


@method
def gaussfit_params(self: ArrayFrame, step: int = 1) -> DataFrame:
    """The fit a exp(-((r - mu) / sg)^2 / 2) + b of each array: a, b, mu, sg and its root mean square error. step: only each step-th place along the axes is fitted."""

    def run(x):
        fits = [filters.fit_gaussian(i, step) for i in x]
        return {"a": [f[0] for f in fits], "b": [f[1] for f in fits], "mu": [f[2].tolist() for f in fits], "sg": [f[3].tolist() for f in fits], "rmse": [f[4] for f in fits]}

    return self.table(run, "a double, b double, mu array<double>, sg array<double>, rmse double")


@method
def gaussfit(self: ArrayFrame, step: int = 1) -> ArrayFrame:
    """The fitted Gaussian of each array as an image."""
    return self.map(lambda x: np.stack([filters.gaussian_surface(i.shape, *filters.fit_gaussian(i, step)[:4]) for i in x]), "float32")


@method
def gauss_correction(self: ArrayFrame, ref: ArrayFrame | None = None, *, step: int = 1, median_radius: float = 15) -> ArrayFrame:
    """Uneven light taken out by the Gaussian of the reference (its own by default, after a median filter): x / fit * greatest of the fit - background."""
    ref = self if ref is None else ref

    def run(x, r):
        out = np.empty(x.shape)
        for i, (a, b) in enumerate(zip(x, r)):
            p = filters.fit_gaussian(b, step)
            fit = filters.gaussian_surface(b.shape, *p[:4])
            out[i] = a / np.where(fit == 0, 1, fit) * fit.max() - p[1]
        return out

    return self.map_with(ref.median_filter(median_radius) if median_radius >= 1 else ref, run)


@method
def hessian_eigval(self: ArrayFrame, sigma=1.0, *, dims=None) -> dict[str, ArrayFrame]:
    """Eigenvalues of the scaled Hessian, ascending, by number."""
    d = self.dims(dims)
    scale = [self.space[a].scale for a in d]
    return {str(i): over(self, functools.partial(_eigen, filters.hessian, i, sigma, scale), dims, "float32") for i in range(len(d))}


def _eigen(tensor, i, sigma, scale, x):
    t = tensor(x, sigma, scale) if scale is not None else tensor(x, sigma)
    return filters.eigenvalues(t)[:, i]


def _eigen_table(self: ArrayFrame, tensor: Callable) -> DataFrame:
    d = len(self.shape)
    if self.dims(None) != self.space.names:
        raise AxesError("eigenvectors are taken over all spatial axes")

    def run(x):
        w, v = filters.eigenvectors(tensor(x))
        n = len(x)
        return {"values": w.reshape(n, -1), "vectors": v.reshape(n, -1)}

    del d
    return self.table(run, "values array<double>, vectors array<double>")


@method
def hessian_eig(self: ArrayFrame, sigma=1.0) -> DataFrame:
    """Eigenvalues (value, pixel) and eigenvectors (pixel, component, value) of each array."""
    scale = [a.scale for a in self.space]
    return _eigen_table(self, lambda x: filters.hessian(x, sigma, scale))


@method
def structure_tensor_eigval(self: ArrayFrame, sigma=1.0, *, dims=None) -> dict[str, ArrayFrame]:
    return {str(i): over(self, functools.partial(_eigen, filters.structure_tensor, i, sigma, None), dims, "float32") for i in range(len(self.dims(dims)))}


@method
def structure_tensor_eig(self: ArrayFrame, sigma=1.0) -> DataFrame:
    return _eigen_table(self, lambda x: filters.structure_tensor(x, sigma))


@method
def fill_hole(self: ArrayFrame, how="otsu", *, dims=None) -> ArrayFrame:
    return over(self, lambda x: objects.fill_holes(x, objects.threshold(x, how)), dims)


@method
def inpaint(self: ArrayFrame, mask: np.ndarray, how: str = "biharmonic", *, dims=None) -> ArrayFrame:
    kernel = {"biharmonic": objects.inpaint_biharmonic, "mean": objects.inpaint_mean}[how]
    return over(self, lambda x: kernel(x, np.asarray(mask, bool)), dims)


@method
def remove_large_objects(self: ArrayFrame, radius: float = 5, *, dims=None) -> ArrayFrame:
    return over(self, lambda x: x & ~objects.opening(x, radius), dims, "bool")


@method
def remove_fine_objects(self: ArrayFrame, length: int = 10, *, dims=None) -> ArrayFrame:
    """Long components that an opening removes go; short ones stay as they are."""
    return over(self, lambda x: x & ~(objects.diameter_opening(x, length) & ~objects.opening(x, length // 2)), dims, "bool")


@method
def spline_filter(self: ArrayFrame, order: int = 3, *, dims=None) -> ArrayFrame:
    return self if order < 2 else over(self, lambda x: geometry.spline_prefilter(x, range(1, x.ndim), order), dims, "float32")


@method
def focus_map(self: ArrayFrame, *, dims=2) -> DataFrame:
    """Variance of the Laplacian of each array."""
    return self.laplacian_filter(dims=dims).reduce("var", "".join(self.dims(dims))).pixels("focus")


@method
def estimate_sigma(self: ArrayFrame) -> DataFrame:
    return self.table(lambda x: {"sigma": filters.noise_sigma(x)}, "sigma double")


@method
def log(self: ArrayFrame, eps: float = 1e-8) -> ArrayFrame:
    return self.each(lambda v: F.ln(v + eps), "float32")


# sizes change ------------------------------------------------------------------


@method
def binning(self: ArrayFrame, size: int = 2, how: str = "mean", *, check_edges: bool = True, dims=None) -> ArrayFrame:
    """Blocks of pixels become one; the type stays."""
    names = self.dims(dims)
    if size == 1:
        return self
    if check_edges and any(n % size for a, n in zip(self.space.names, self.shape) if a in names):
        raise ValueError(f"sizes {self.shape} are not multiples of {size}")
    f = getattr(np, how)
    shape = [n // size if a in names else n for a, n in zip(self.space.names, self.shape)]
    cut = tuple(slice(m * size) if a in names else slice(None) for a, m in zip(self.space.names, shape))
    parts = [k for a, m in zip(self.space.names, shape) for k in ((m, size) if a in names else (m, 1))]

    def run(x):
        y = x[(slice(None), *cut)].reshape(len(x), *parts)
        return f(y, axis=tuple(range(2, y.ndim, 2)))

    space = [Axis(a.name, a.scale * size, a.unit) if a.name in names else a for a in self.space]
    return self.map(run, None if how != "sum" else "float64", space, shape)


@method
def fourier_crop(self: ArrayFrame, size: int = 2) -> ArrayFrame:
    space = [Axis(a.name, a.scale * size, a.unit) for a in self.space]
    return self.map(lambda x: fourier.crop(x, size), "float32", space, [n // size for n in self.shape])


@method
def pad(self: ArrayFrame, width, mode: str = "constant", *, dims=None, **options) -> ArrayFrame:
    """numpy.pad over the dims; width: a number or a pair per axis."""
    names = self.dims(dims)
    pairs = [width] * len(names) if np.ndim(width) == 0 else list(width)
    by = {a: (w, w) if np.ndim(w) == 0 else tuple(w) for a, w in zip(names, pairs, strict=True)}
    full = [by.get(a, (0, 0)) for a in self.space.names]
    shape = [n + sum(w) for n, w in zip(self.shape, full)]
    return self.map(lambda x: np.pad(x, [(0, 0), *full], mode, **options), shape=shape)


@method
def pad_defocus(self: ArrayFrame, kernel: np.ndarray, *, depth: int = 3, width: int = 6, background: float | None = None) -> ArrayFrame:
    """Borders in z, y and x filled with the image blurred by a point spread function."""
    def run(x):
        bg = x.min((1, 2, 3), keepdims=True) if background is None else background
        y = np.pad(x - bg, [(0, 0), (depth, depth), (width, width), (width, width)]) + bg
        blur = filters.convolve(np.pad(x, [(0, 0), (depth, depth), (width, width), (width, width)], "edge"), kernel / kernel.sum(), "nearest")
        inner = (slice(None), slice(depth, -depth or None), slice(width, -width or None), slice(width, -width or None))
        out = blur
        out[inner] = y[inner]
        return out

    z, y, x = self.shape
    return self.map(run, shape=(z + 2 * depth, y + 2 * width, x + 2 * width))


@method
def zoom(self: ArrayFrame, factor, order: int = 3, *, same_shape: bool = False) -> ArrayFrame:
    probe = geometry.zoom(np.zeros((1, *self.shape)), factor, 0, same_shape=same_shape)
    factors = np.broadcast_to(np.asarray(factor, float), len(self.shape))
    space = self.space if same_shape else [Axis(a.name, a.scale / f, a.unit) for a, f in zip(self.space, factors)]
    return self.map(lambda x: geometry.zoom(x, factor, order, same_shape=same_shape), None, space, probe.shape[1:])


@method
def affine(self: ArrayFrame, matrix=None, *, order: int = 1, mode: str = "constant", cval: float = 0.0, output_shape=None, dims=None, **parts) -> ArrayFrame:
    """Pulls values: out[o] = in[matrix . o]; parts: scale, rotation, shear, translation."""
    m = geometry.matrix_of(len(self.dims(dims)), **parts) if matrix is None else np.asarray(matrix, float)
    if output_shape is not None:
        return self.map(lambda x: geometry.affine(x, m, order, mode, cval, output_shape), shape=output_shape)
    return over(self, lambda x: geometry.affine(x, m, order, mode, cval), dims)


@method
def map_coordinates(self: ArrayFrame, where: np.ndarray, *, order: int = 3, mode: str = "constant", cval: float = 0.0, axes: str | None = None) -> ArrayFrame:
    """Values at coordinates (d, ...), the same for each array; axes names the result's."""
    where = np.asarray(where, float)
    shape = where.shape[1:]
    names = axes or "abefghij"[: len(shape)]
    return self.map(lambda x: np.stack([geometry.sample(a, where, order, mode, cval) for a in x]), "float32", names, shape)


@method
def reslice(self: ArrayFrame, points, *, how: str = "pack", order: int = 1) -> ArrayFrame:
    """Values along a polyline: axis s."""
    return self.map_coordinates(geometry.polyline(np.asarray(points), how), order=order, axes="s")


@method
def rotated_crop(self: ArrayFrame, origin, first, second, *, order: int = 1) -> ArrayFrame:
    """The parallelogram spanned by two end points from an origin, in unit steps."""
    o, a, b = (np.asarray(p, float) for p in (origin, first, second))
    n, m = (int(np.hypot(*(p - o))) + 1 for p in (a, b))
    s, t = np.meshgrid(np.arange(n) / max(1, n - 1), np.arange(m) / max(1, m - 1), indexing="ij")
    where = np.stack([o[k] + s * (a - o)[k] + t * (b - o)[k] for k in range(2)])
    return self.map(lambda x: np.stack([geometry.sample(i, where, order) for i in x]), None, self.space, (n, m))


@method
def crop_subregion(self: ArrayFrame, centres, shape, angles=0.0, *, order: int = 3) -> list[ArrayFrame]:
    """A rotated box about each centre."""
    angles = np.broadcast_to(np.asarray(angles, float), len(centres))
    g = geometry.grid(shape) - np.array([(n - 1) / 2 for n in shape]).reshape(-1, 1, 1)
    out = []
    for c, a in zip(centres, np.deg2rad(angles)):
        where = np.stack([c[0] + g[0] * np.cos(a) - g[1] * np.sin(a), c[1] + g[0] * np.sin(a) + g[1] * np.cos(a)])
        out.append(self.map(lambda x, w=where: np.stack([geometry.sample(i, w, order) for i in x]), None, self.space, shape))
    return out


@method
def radon(self: ArrayFrame, degrees: Sequence[float], *, order: int = 3) -> ArrayFrame:
    labels = tuple(float(d) for d in degrees)
    return self.map(lambda x: geometry.radon(x, labels, order), "float32", [Axis("d", 1.0, "deg", labels), self.space.items[-1]], (len(labels), self.shape[-1]))


@method
def iradon(self: ArrayFrame, degrees: Sequence[float], *, height: int | None = None, window: str | None = "hamming") -> ArrayFrame:
    size = height or self.shape[-1]
    return self.map(lambda x: geometry.inverse_radon(x, degrees, height, window), "float32", ["y", self.space.items[-1]], (size, self.shape[-1]))


@method
def polar(self: ArrayFrame, radius: float, step: float = 0.1, order: int = 1) -> ArrayFrame:
    probe = geometry.polar(np.zeros((1, *self.shape)), radius, step, 0)
    return self.map(lambda x: geometry.polar(x, radius, step, order), "float32", ["a", "r"], probe.shape[1:])


@method
def crop_center(self: ArrayFrame, scale: float = 0.5, *, dims=2) -> ArrayFrame:
    if not 0 < scale <= 1:
        raise ValueError(f"scale must be in (0, 1], not {scale}")
    names = self.dims(dims)
    return self.isel(**{a: slice(math.ceil((n - 1) / 2 * (1 - scale)), int((n - 1) / 2 * (1 + scale) + 1)) for a, n in zip(self.space.names, self.shape) if a in names})


@method
def crop_kernel(self: ArrayFrame, radius: int = 2) -> ArrayFrame:
    return self.isel(**{a: slice(n // 2 - radius, (n + 1) // 2 + radius) for a, n in zip(self.space.names, self.shape)})


@method
def remove_edges(self: ArrayFrame, pixel: int = 1, *, dims=2) -> ArrayFrame:
    names = self.dims(dims)
    return self.isel(**{a: slice(pixel, n - pixel) for a, n in zip(self.space.names, self.shape) if a in names})


@method
def split_pixel_unit(self: ArrayFrame, order: Sequence[int] = (2, 1, 0, 3)) -> ArrayFrame:
    """The four pixels of each 2x2 cell, aligned by bilinear shifts, on a new axis a; sizes must be even."""
    y, x = self.shape
    if y % 2 or x % 2:
        raise ValueError(f"sizes {self.shape} are not even")

    def run(v):
        parts = [geometry.shift(v[:, i::2, j::2], ((0.5 - (0.5 if i == 0 else 0.0) - 0.25) * 1.0, (0.5 - (0.5 if j == 0 else 0.0) - 0.25) * 1.0), 1, "nearest") for i in (0, 1) for j in (0, 1)]
        return np.stack([parts[k] for k in order], 1)

    return self.map(run, None, ["a", *[Axis(s.name, s.scale * 2, s.unit) for s in self.space]], (4, y // 2, x // 2))


# values over whole arrays --------------------------------------------------------


def _limit(x: np.ndarray, v) -> np.ndarray:
    q = np.percentile(x.reshape(len(x), -1), float(v[:-1]), axis=1) if isinstance(v, str) else np.full(len(x), float(v))
    return q.reshape(-1, *[1] * (x.ndim - 1))


@method
def clip(self: ArrayFrame, low="0%", high="100%") -> ArrayFrame:
    """To numbers or percentiles of each array."""
    if not isinstance(low, str) and not isinstance(high, str) and low >= high:
        raise ValueError(f"{low} is not below {high}")
    return self.map(lambda x: np.clip(x, _limit(x, low), _limit(x, high)))


@method
def rescale_intensity(self: ArrayFrame, low="0%", high="100%", dtype: str = "uint16") -> ArrayFrame:
    top = {"uint8": 255, "uint16": 65535}.get(dtype, 1)

    def run(x):
        a, b = _limit(x, low), _limit(x, high)
        return (np.clip(x, a, b) - a) / np.where(b > a, b - a, 1) * top

    return self.map(run, dtype)


@method
def unmix(self: ArrayFrame, matrix, background=None, along: str = "c") -> ArrayFrame:
    """Linear unmixing of a spatial axis of channels."""
    inverse = np.linalg.inv(np.asarray(matrix, float))
    bg = np.zeros(len(inverse)) if background is None else np.asarray(background, float)
    k = self.space.find(along) + 1

    def run(x):
        y = np.moveaxis(x, k, -1)
        return np.moveaxis((y - bg) @ inverse + bg, -1, k)

    return self.map(run)


@method
def stokes(self: ArrayFrame, along: str = "a") -> dict[str, ArrayFrame]:
    """Degree and angle of linear polarisation from intensities at 0, 45, 90 and 135 degrees."""
    k = self.space.find(along) + 1
    space = self.space.drop(along)
    shape = [n for a, n in zip(self.space.names, self.shape) if a != along]

    def parts(x):
        i = [x.take(j, k) for j in range(4)]
        return sum(i) / 2, i[0] - i[2], i[1] - i[3]

    def degree(x):
        s0, s1, s2 = parts(x)
        return np.divide(np.hypot(s1, s2), s0, out=np.zeros(s0.shape), where=s0 != 0)

    def angle(x):
        _, s1, s2 = parts(x)
        return np.arctan2(s2, s1) / 2

    return {"dolp": self.map(degree, "float32", space, shape), "aop": self.map(angle, "float32", space, shape)}


@method
def as_rgba(self: ArrayFrame, table: np.ndarray, limits: tuple[float, float] | None = None) -> ArrayFrame:
    """Colours of a lookup table (k, 4), on a new last axis c."""
    table = np.asarray(table, float)

    def run(x):
        over = tuple(range(1, x.ndim))
        lo, hi = limits or (x.min(over, keepdims=True), x.max(over, keepdims=True))
        i = np.clip((x - lo) / np.where(hi > lo, hi - lo, 1) * len(table), 0, len(table) - 1).astype(int)
        return table[i]

    return self.map(run, "float32", [*self.space, "c"], (*self.shape, 4))


@method
def radial_profile(self: ArrayFrame, bins: int = 32, centre=None, most: float | None = None, how: str = "mean") -> DataFrame:
    """A statistic by distance from the centre, natively on pixels: columns r (bin) and value."""
    scale = [a.scale for a in self.space]
    centre = [n / 2 for n in self.shape] if centre is None else centre
    d2 = sum((F.pow((F.col(a) - float(c)) * s, 2) for a, c, s in zip(self.space.names, centre, scale)), F.lit(0.0))
    if most is None:
        most = math.sqrt(sum((max(c, n - 1 - c) * s) ** 2 for c, n, s in zip(centre, self.shape, scale))) + 1e-9
    from ..frame import _spark

    px = self.pixels().withColumn("r", F.floor(F.sqrt(d2) * bins / float(most)).cast("int")).where(F.col("r") < bins)
    return px.groupBy(*self.batch.names, "r").agg(_spark(how).cast("double").alias("value"))


@method
def center_of_mass(self: ArrayFrame) -> DataFrame:
    v = F.col("value")
    return self.pixels().groupBy(*self.batch.names).agg(*[(F.sum(F.col(a) * v) / F.sum(v)).alias(a) for a in self.space.names])


@method
def argmax_nd(self: ArrayFrame) -> DataFrame:
    """Coordinates of the greatest value of each array, the first in row-major order."""
    return self._extreme(True)


@method
def _extreme(self: ArrayFrame, most: bool) -> DataFrame:
    sizes = list(zip(self.space.names, self.shape))

    def run(x):
        flat = x.reshape(len(x), -1)
        at = np.unravel_index(flat.argmax(1) if most else flat.argmin(1), x.shape[1:])
        return {**{a: i for (a, _), i in zip(sizes, at)}, "value": (flat.max(1) if most else flat.min(1)).astype(float)}

    return self.table(run, ", ".join([f"{a} bigint" for a, _ in sizes] + ["value double"]))


@method
def hist(self: ArrayFrame, low: float, high: float, bins: int = 256) -> DataFrame:
    """Counts by bin of equal width, over all arrays."""
    b = F.least(F.floor((F.col("value") - low) / ((high - low) / bins)), F.lit(bins - 1))
    return self.pixels().where((F.col("value") >= low) & (F.col("value") <= high)).groupBy(b.cast("int").alias("bin")).agg(F.count("*").alias("n"))


# axes over pixels: diff, cumulative sums and gradients ------------------------------


@method
def along(self: ArrayFrame, axis: str, how: str) -> DataFrame:
    """diff, cumsum, cumprod or gradient along any axis, as pixels; windows run within the other axes."""
    from pyspark.sql import Window

    rest = [a for a in self.axes.names if a != axis]
    w, v = Window.partitionBy(*rest).orderBy(axis), F.col("value")
    px = self.pixels()
    if how == "diff":
        out = px.withColumn("value", v - F.lag(v).over(w)).where("value is not null").withColumn(axis, F.col(axis) - 1)
    elif how == "cumsum":
        out = px.withColumn("value", F.sum(v).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    elif how == "cumprod":
        out = px.withColumn("value", F.product(v).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    elif how == "gradient":
        a, b = F.lag(v).over(w), F.lead(v).over(w)
        out = px.withColumn("value", F.when(a.isNull() & b.isNull(), 0.0).when(a.isNull(), b - v).when(b.isNull(), v - a).otherwise((b - a) / 2))
    else:
        raise ValueError(f"unknown way {how!r}")
    return out.select(*self.axes.names, "value")


@method
def tile(self: ArrayFrame, axis: str, rows: int, columns: int) -> DataFrame:
    """The arrays along a batch axis as a mosaic, as pixels; the axis must fit the grid."""
    h, w = self.shape
    k, n = F.col(axis), self._size(self.batch[axis])
    if n > rows * columns:
        raise ValueError(f"{n} arrays do not fit a grid of {rows} x {columns}")
    px = self.pixels()
    px = px.withColumns({"y": F.col("y") + F.expr(f"{axis} div {columns}") * h, "x": F.col("x") + (k % columns) * w})
    return px.select(*[b for b in self.batch.names if b != axis], F.col("y").cast("int").alias("y"), F.col("x").cast("int").alias("x"), "value")


def stack(frames: Sequence[ArrayFrame], axis: str = "c") -> ArrayFrame:
    """On a new batch axis, at its canonical place if the axes are sorted, else first."""
    first = frames[0]
    if any(f.axes.names != first.axes.names or f.shape != first.shape for f in frames):
        raise AxesError("only arrays with the same axes and shape can be stacked")
    if axis in first.axes:
        raise AxesError(f"axis {axis!r} exists already")
    df = functools.reduce(DataFrame.unionByName, [f.df.withColumn(axis, F.lit(i)) for i, f in enumerate(frames)])
    batch = first.batch.inserted(0, axis)
    if first.axes.is_sorted():
        batch = batch.sorted()
    return ArrayFrame(df, batch, first.space, first.shape, first.dtype)


def concatenate(frames: Sequence[ArrayFrame], axis: str) -> ArrayFrame:
    """One after the other on a batch axis."""
    dfs, at = [], 0
    for f in frames:
        dfs.append(f.df.withColumn(axis, (F.col(axis) + at).cast(f.df.schema[axis].dataType)))
        at += f.sizes()[axis]
    return ArrayFrame(functools.reduce(DataFrame.unionByName, dfs), frames[0].batch, frames[0].space, frames[0].shape, frames[0].dtype)


def stack_relaxed(frames: Sequence[ArrayFrame], axis: str = "p") -> ArrayFrame:
    """Arrays of different sizes, filled up with zeros at the ends."""
    shape = [max(n) for n in zip(*[f.shape for f in frames])]
    grown = [f.pad([(0, m - n) for n, m in zip(f.shape, shape)], dims=f.space.names) for f in frames]
    return stack(grown, axis)


@method
def drift(self: ArrayFrame, along_axis: str = "t", upsample: int = 10, most: float | None = None) -> DataFrame:
    """Cumulative displacement of each array against the first along a batch axis: columns of the axes y, x and d_y, d_x."""
    from pyspark.sql import Window

    rest = [b for b in self.batch.names if b != along_axis]
    before = self.df.withColumn(along_axis, (F.col(along_axis) + 1).cast("int"))
    pairs = ArrayFrame(self.df, self.batch, self.space, self.shape, self.dtype)
    old = ArrayFrame(before, self.batch, self.space, self.shape, self.dtype)
    names = [f"d_{a}" for a in self.space.names]

    def run(now, prev):
        d = np.array([fourier.phase_correlation(b, a, upsample, most) for a, b in zip(now, prev)])
        return {n: -d[:, i] for i, n in enumerate(names)}

    steps = pairs.table(run, ", ".join(f"{n} double" for n in names), old)
    start = self.df.where(F.col(along_axis) == 0).select(*self.batch.names, *[F.lit(0.0).alias(n) for n in names])
    w = Window.partitionBy(*rest).orderBy(along_axis).rowsBetween(Window.unboundedPreceding, 0)
    every = start.unionByName(steps)
    return every.select(*self.batch.names, *[F.sum(n).over(w).alias(n) for n in names])


@method
def drift_correction(self: ArrayFrame, along_axis: str = "t", *, zero_average: bool = True, order: int = 1, **options) -> ArrayFrame:
    from pyspark.sql import Window

    d = self.drift(along_axis, **options)
    names = [f"d_{a}" for a in self.space.names]
    rest = [b for b in self.batch.names if b != along_axis]
    if zero_average:
        w = Window.partitionBy(*rest) if rest else Window.partitionBy(F.lit(0))
        d = d.select(*self.batch.names, *[(F.col(n) - F.avg(n).over(w)).alias(n) for n in names])
    moves = ArrayFrame(d.select(*self.batch.names, F.array(*names).alias("data")), self.batch, "k", (len(names),))
    return self.map_with(moves, lambda x, m: np.concatenate([geometry.shift(a[None], -v, order) for a, v in zip(x, m)]))
