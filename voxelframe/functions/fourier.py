"""Spectra, frequency filters, deconvolution and correlation of stacks."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def _axes(x: np.ndarray) -> tuple[int, ...]:
    return tuple(range(1, x.ndim))


def frequencies(shape: Sequence[int]) -> list[np.ndarray]:
    return np.meshgrid(*[np.fft.fftfreq(n) for n in shape], indexing="ij")


def fft(x, shift=True, shape=None):
    """shape: sizes to pad or crop to, or 'square' for the next power of two of the longest side."""
    if shape == "square":
        shape = [2 ** int(np.ceil(np.log2(max(x.shape[1:]))))] * (x.ndim - 1)
    y = np.fft.fftn(x, shape, _axes(x))
    return np.fft.fftshift(y, _axes(x)) if shift else y


def ifft(x, shift=True, real=True):
    y = np.fft.ifftn(np.fft.ifftshift(x, _axes(x)) if shift else x, axes=_axes(x))
    return y.real if real else y


def power(x, shift=True, norm=False, zero=False):
    y = np.abs(fft(x, shift)) ** 2
    if zero:
        y[(slice(None), *(n // 2 if shift else 0 for n in x.shape[1:]))] = 0
    return y / y.max(_axes(y), keepdims=True) if norm else y


def local_dft(x, ranges: Sequence[tuple[int, int]], upsample: int = 1):
    """The transform at frequencies k / upsample for k in each axis' range (start, stop)."""
    y = x.astype(complex)
    for axis, (lo, hi) in enumerate(ranges, 1):
        n = x.shape[axis]
        e = np.exp(-2j * np.pi * np.outer(np.arange(lo, hi) / (upsample * n), np.arange(n)))
        y = np.moveaxis(np.tensordot(e, y, (1, axis)), 0, axis)
    return y


def butterworth(shape: Sequence[int], cutoff, order: float = 2, high: bool = False) -> np.ndarray:
    cutoff = np.broadcast_to(np.asarray(cutoff, float), len(shape))
    q = sum((f / c) ** 2 for f, c in zip(frequencies(shape), cutoff))
    low = 1 / (1 + q**order)
    return 1 - low if high else low


def weighted(x, weight):
    return np.fft.ifftn(np.fft.fftn(x, axes=_axes(x)) * weight, axes=_axes(x)).real


def lowpass(x, cutoff=0.2, order=2):
    return x if np.all(np.asarray(cutoff) >= 0.5 * (x.ndim - 1) ** 0.5) else weighted(x, butterworth(x.shape[1:], cutoff, order))


def highpass(x, cutoff=0.2, order=2):
    return weighted(x, butterworth(x.shape[1:], cutoff, order, True))


def bandpass(x, low=0.02, high=0.2, order=2):
    return weighted(x, butterworth(x.shape[1:], high, order) * butterworth(x.shape[1:], low, order, True))


def lowpass_kernel(shape, cutoff=0.2, order=2, most=11):
    """The Butterworth response in real space, cut to a small odd box."""
    r = int(min(1 / cutoff, most, *[(n - 1) // 2 for n in shape]))
    k = np.fft.fftshift(np.fft.ifftn(butterworth([4 * r + 1] * len(shape), cutoff, order)).real)
    k = k[tuple(slice(n // 2 - r, n // 2 + r + 1) for n in k.shape)]
    return k / k.sum()


def gaussian(x, sigma):
    sigma = np.broadcast_to(np.asarray(sigma, float), x.ndim - 1)
    return weighted(x, np.exp(-2 * np.pi**2 * sum((s * f) ** 2 for s, f in zip(sigma, frequencies(x.shape[1:])))))


def crop(x, binsize=2):
    """Downsampling by keeping the low frequencies."""
    y = np.fft.fftshift(np.fft.fftn(x, axes=_axes(x)), _axes(x))
    size = [n // binsize for n in x.shape[1:]]
    y = y[(slice(None), *(slice(n // 2 - m // 2, n // 2 - m // 2 + m) for n, m in zip(x.shape[1:], size)))]
    return np.fft.ifftn(np.fft.ifftshift(y, _axes(x)), axes=_axes(x)).real


def point_spread(psf: np.ndarray, shape: Sequence[int]) -> np.ndarray:
    """The transform of a centred point spread function that sums to 1."""
    if psf.shape != tuple(shape):
        raise ValueError(f"the point spread function has shape {psf.shape}, not {tuple(shape)}")
    return np.fft.fftn(np.fft.ifftshift(psf / psf.sum()))


def wiener(x, psf, weight=0.1):
    if weight <= 0:
        raise ValueError("the weight must be positive")
    h = point_spread(psf, x.shape[1:])
    return weighted(x, h.conj() / (np.abs(h) ** 2 + weight))


def lucy(x, psf, steps=50, eps=1e-5, variation=0.0, tolerance=0.0):
    """Richardson-Lucy, with a total variation term where ``variation`` is positive."""
    h = point_spread(psf, x.shape[1:])
    est = weighted(x, h)
    for _ in range(steps):
        blur = weighted(est, h)
        ratio = np.divide(x, blur, out=np.zeros(x.shape), where=blur > eps)
        new = est * weighted(ratio, h.conj())
        if variation:
            g = np.stack(np.gradient(est, axis=_axes(x))) if x.ndim > 2 else np.gradient(est, axis=1)[None]
            g = g / np.maximum(np.sqrt((g**2).sum(0)), eps)
            div = sum(np.gradient(g[a], axis=a + 1) for a in range(x.ndim - 1))
            new = new / np.maximum(1 - variation * div, eps)
            if np.abs(new - est).sum() < tolerance * np.abs(est).sum():
                return new
        est = new
    return est


def shell_correlation(a: np.ndarray, b: np.ndarray, step: float = 0.02) -> tuple[np.ndarray, np.ndarray]:
    """Frequencies and Fourier shell correlation of two arrays; the last shell is dropped."""
    fa, fb = np.fft.fftn(a), np.fft.fftn(b)
    shell = (np.sqrt(sum(f**2 for f in frequencies(a.shape))) / step).astype(int).ravel()
    cross = np.bincount(shell, (fa * fb.conj()).real.ravel())
    pa, pb = (np.bincount(shell, (np.abs(f) ** 2).ravel()) for f in (fa, fb))
    n = len(cross) - 1
    return (np.arange(n) + 0.5) * step, cross[:n] / np.sqrt(pa[:n] * pb[:n])


def phase_correlation(a, b, upsample: int = 10, most: float | None = None) -> np.ndarray:
    """The displacement of b that matches it to a: the peak of the squared cross-correlation, refined by an upsampled transform around it."""
    cross = np.fft.fftn(a) * np.fft.fftn(b).conj()
    p = np.abs(np.fft.ifftn(cross)) ** 2
    shape = np.array(a.shape)
    if most is not None:
        for axis, n in enumerate(a.shape):
            k = np.arange(n)
            far = np.minimum(k, n - k) > most
            index = [slice(None)] * a.ndim
            index[axis] = far
            p[tuple(index)] = 0
    peak = np.array(np.unravel_index(p.argmax(), p.shape), float)
    peak = np.where(peak > shape / 2, peak - shape, peak)
    if upsample > 1:
        width = int(np.ceil(1.5 * upsample))
        lo = np.round(peak * upsample).astype(int) - width // 2
        y = cross.conj()
        for axis in range(a.ndim):
            n = a.shape[axis]
            e = np.exp(-2j * np.pi * np.outer((lo[axis] + np.arange(width)) / upsample, np.fft.fftfreq(n)))
            y = np.moveaxis(np.tensordot(e, y, (1, axis)), 0, axis)
        fine = np.array(np.unravel_index(np.abs(y).argmax(), y.shape))
        peak = (lo + fine) / upsample
        if most is not None:
            peak = np.clip(peak, -most, most)
    return peak


def correlation_landscape(a, b, most: int | None = None) -> np.ndarray:
    """Squared cross-correlation for every displacement, zero in the middle."""
    p = np.fft.fftshift(np.abs(np.fft.ifftn(np.fft.fftn(a) * np.fft.fftn(b).conj())) ** 2)
    if most is None:
        return p
    return p[tuple(slice(max(0, n // 2 - most), n // 2 + most + 1) for n in p.shape)]


def zero_normalised_landscape(a, b, most: int = 3) -> np.ndarray:
    """Pearson correlation of the overlapping parts for each displacement up to ``most``."""
    out = np.zeros((2 * most + 1,) * a.ndim)
    for at in np.ndindex(out.shape):
        d = [i - most for i in at]
        p = a[tuple(slice(max(0, s), n + min(0, s)) for s, n in zip(d, a.shape))]
        q = b[tuple(slice(max(0, -s), n + min(0, -s)) for s, n in zip(d, b.shape))]
        p, q = p - p.mean(), q - q.mean()
        norm = np.sqrt((p**2).sum() * (q**2).sum())
        out[at] = (p * q).sum() / norm if norm > 0 else 0.0
    return out


def zero_normalised_maximum(a, b, most: int = 3, upsample: int = 10) -> tuple[np.ndarray, float]:
    from .geometry import grid, sample

    land = zero_normalised_landscape(a, b, most)
    peak = np.array(np.unravel_index(land.argmax(), land.shape), float)
    best = float(land.max())
    if upsample > 1:
        fine = np.stack([g / upsample for g in grid([2 * upsample + 1] * a.ndim)]) - 1 + peak.reshape(-1, *[1] * a.ndim)
        y = sample(land, fine, 3, "mirror")
        i = np.unravel_index(y.argmax(), y.shape)
        peak, best = fine[(slice(None), *i)], float(y.max())
    return peak - most, best
