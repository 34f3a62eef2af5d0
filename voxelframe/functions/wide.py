"""Neighbourhood filters whose cost grows with a footprint's lines, not with its places.

A footprint is taken as runs along one axis (disks and boxes are).  Extremes
and sums of runs come from tables that all runs share; ranks from histograms
that slide along the axis and change only by the ends of the runs.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np

#: Footprints with fewer places are done place by place; ranks up to the second number, one array at a time, as their histograms cost more.
PLACES, RANK_PLACES = 64, 200


def runs(footprint: np.ndarray, axis: int = -1) -> list[tuple[tuple[int, ...], int, int]] | None:
    """(place on the other axes, start, length) of each line of the footprint; None if a line has gaps."""
    lines = np.moveaxis(footprint, axis, -1)
    out = []
    for at in np.ndindex(lines.shape[:-1]):
        set_ = np.flatnonzero(lines[at])
        if len(set_):
            if set_[-1] - set_[0] + 1 != len(set_):
                return None
            out.append((at, int(set_[0]), len(set_)))
    return out


def large(footprint: np.ndarray) -> bool:
    return int(footprint.sum()) > PLACES and runs(footprint) is not None


def _over_lines(wide: np.ndarray, shape: tuple[int, ...], footprint: np.ndarray, line: Callable[[int, int], np.ndarray], join: Callable) -> np.ndarray:
    """The runs' results, each moved to its line; runs of equal start and length are made once."""
    n, out = shape[-1], None
    for (start, length), group in itertools.groupby(sorted(runs(footprint), key=lambda r: r[1:]), key=lambda r: r[1:]):
        whole = line(start, length)[..., :n]
        for at, _, _ in group:
            part = whole[(slice(None), *(slice(a, a + s) for a, s in zip(at, shape[:-1])))]
            out = part.copy() if out is None else join(out, part, out=out)
    return out


def extreme(wide: np.ndarray, shape: tuple[int, ...], footprint: np.ndarray, join: Callable) -> np.ndarray:
    """np.minimum or np.maximum over the footprint of a stack that is padded by it: a run is two overlapping runs of a power of two."""
    tables = [wide]

    def line(start: int, length: int) -> np.ndarray:
        k = length.bit_length() - 1
        while len(tables) <= k:
            half = 1 << (len(tables) - 1)
            tables.append(join(tables[-1][..., :-half], tables[-1][..., half:]))
        a, b = tables[k][..., start:], tables[k][..., start + length - (1 << k) :]
        n = min(a.shape[-1], b.shape[-1])
        return join(a[..., :n], b[..., :n])

    return _over_lines(wide, shape, footprint, line, join)


def total(wide: np.ndarray, shape: tuple[int, ...], footprint: np.ndarray) -> np.ndarray:
    """Sums over the footprint from running sums of each line, about the line's mean so that they stay small."""
    middle = wide.mean(axis=-1, keepdims=True)
    run = np.concatenate([np.zeros((*wide.shape[:-1], 1)), np.cumsum(wide - middle, axis=-1)], axis=-1)

    def line(start: int, length: int) -> np.ndarray:
        a, b = run[..., start + length :], run[..., start:]
        n = min(a.shape[-1], b.shape[-1])
        return a[..., :n] - b[..., :n] + length * middle

    return _over_lines(wide, shape, footprint, line, np.add)


def ranked(wide: np.ndarray, shape: tuple[int, ...], footprint: np.ndarray, rank: int) -> np.ndarray:
    """The value of a rank (from 0) in the footprint of each place of one padded array.

    All values are ordered once and cut to buckets of equal numbers.  For every
    place a histogram over buckets is kept; one step along the first axis takes
    in the places where runs end and gives up those where they begin.  The
    bucket with the wanted rank is known from it, and the value is found among
    that bucket's few places.
    """
    lines = runs(footprint, 0)
    order = np.argsort(wide, axis=None, kind="stable")
    others = shape[1:]
    columns, fine = int(np.prod(others)), 16
    coarse = int(min(32, max(1, (1 << 25) // max(1, columns) // fine)))
    buckets = coarse * fine
    bucket = np.empty(wide.size, np.int32)
    bucket[order] = np.arange(wide.size) * buckets // wide.size
    bucket = bucket.reshape(wide.shape)
    column, row_of = np.arange(columns), np.zeros((shape[0], columns), np.int32)
    counts, groups = np.zeros((columns, coarse, fine), np.int32), np.zeros((columns, coarse), np.int32)
    flat = counts.reshape(columns, buckets)

    def change(y: int, at: tuple[int, ...], step: int) -> None:
        part = bucket[(y, *(slice(a, a + s) for a, s in zip(at, others)))].ravel()
        flat[column, part] += step
        groups[column, part // fine] += step

    def place(below: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first count that goes over what is wanted, and what is left of it there."""
        k = (below <= wanted[:, None]).sum(axis=1)
        return k, wanted - np.where(k > 0, below[column, np.maximum(k - 1, 0)], 0)

    for at, start, length in lines:
        for y in range(start, start + length):
            change(y, at, 1)
    left = np.empty_like(row_of)
    for row in range(shape[0]):
        if row:
            for at, start, length in lines:
                change(row - 1 + start, at, -1)
                change(row + start + length - 1, at, 1)
        group, rest = place(np.cumsum(groups, axis=1), np.full(columns, rank))
        within, left[row] = place(np.cumsum(counts[column, group], axis=1), rest)
        row_of[row] = group * fine + within
    return _within_buckets(wide, shape, footprint, order, buckets, row_of.ravel(), left.ravel())


def _within_buckets(wide, shape, footprint, order, buckets, found, left) -> np.ndarray:
    """The place of a rank among a bucket's, by a table of which steps between two places are in the footprint."""
    size = tuple(w + n - 1 for w, n in zip(wide.shape, shape))
    table = np.zeros(size, bool)
    table[tuple(slice(n - 1, n - 1 + f) for n, f in zip(shape, footprint.shape))] = footprint
    table, stride = table.ravel(), np.array([int(np.prod(size[i + 1 :])) for i in range(len(size))])
    there = sum(g * s for g, s in zip(np.unravel_index(order, wide.shape), stride)).astype(np.int32 if len(table) < 2**31 else np.int64)
    here = sum((g - n + 1) * s for g, n, s in zip(np.indices(shape), shape, stride)).ravel().astype(there.dtype)
    out, values = np.empty(len(found)), wide.ravel()[order]
    by = np.argsort(found, kind="stable")
    cut = np.searchsorted(found[by], np.arange(buckets + 1))
    for b in range(buckets):
        lo, hi = -(-b * wide.size // buckets), -(-(b + 1) * wide.size // buckets)
        step = max(1, (1 << 19) // max(1, hi - lo))
        for s in range(cut[b], cut[b + 1], step):
            some = by[s : min(s + step, cut[b + 1])]
            inside = table[there[None, lo:hi] - here[some][:, None]]
            which = (np.cumsum(inside, axis=1, dtype=np.int32) > left[some][:, None]).argmax(axis=1)
            out[some] = values[lo + which]
    return out.reshape(shape)
