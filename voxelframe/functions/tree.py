"""Component trees of grey arrays: how the parts above a level join as the level falls.

Places are taken from the highest value down; each joins the components of its
neighbours that have been taken, which become its children (union by pointers
that are halved on the way).  A component's size, or box, is known when its last place is taken.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def component_tree(x: np.ndarray, footprint: np.ndarray, joined: Callable[[int, int], None] | None = None) -> tuple[list[int], list[int], tuple[int, ...]]:
    """The places in the order they are taken, and the parent of each (its own for the root), over the array with a border of one.

    ``joined(p, r)`` is told that the component of r becomes part of p's.
    """
    shape = tuple(n + 2 for n in x.shape)
    inner = np.arange(int(np.prod(shape))).reshape(shape)[(slice(1, -1),) * x.ndim].ravel()
    order = inner[np.argsort(-x.ravel().astype(float), kind="stable")].tolist()
    stride = np.array([int(np.prod(shape[i + 1 :])) for i in range(x.ndim)])
    steps = [int(((np.array(at) - 1) * stride).sum()) for at in np.argwhere(footprint)]
    up, parent = [-1] * int(np.prod(shape)), [-1] * int(np.prod(shape))
    for p in order:
        up[p] = parent[p] = p
        for s in steps:
            r = p + s
            if up[r] < 0:
                continue
            while (a := up[r]) != r:
                up[r] = r = up[a]
            if r != p:
                up[r] = parent[r] = p
                if joined is not None:
                    joined(p, r)
    return order, parent, shape


def area_opening(x: np.ndarray, least: float, footprint: np.ndarray) -> np.ndarray:
    size = [1] * int(np.prod([n + 2 for n in x.shape]))

    def joined(p: int, r: int) -> None:
        size[p] += size[r]

    order, parent, shape = component_tree(x, footprint, joined)
    return _opened(x, order, parent, shape, size, least)


def diameter_opening(x: np.ndarray, least: float, footprint: np.ndarray) -> np.ndarray:
    """By the longest side of a component's box."""
    shape = tuple(n + 2 for n in x.shape)
    low = [g.ravel().tolist() for g in np.indices(shape)]
    high = [list(g) for g in low]
    sides = list(zip(low, high))

    def joined(p: int, r: int) -> None:
        for a, b in sides:
            if a[r] < a[p]:
                a[p] = a[r]
            if b[r] > b[p]:
                b[p] = b[r]

    order, parent, _ = component_tree(x, footprint, joined)
    size = np.max([np.array(b) - np.array(a) for a, b in sides], axis=0) + 1
    return _opened(x, order, parent, shape, size.tolist(), least)


def _opened(x, order, parent, shape, size, least) -> np.ndarray:
    """Every place takes the level of the smallest component around it that is large enough, the lowest level if none is.

    From the root up; places of one level and component stand under the last one taken, whose size counts for all.
    """
    level = np.zeros(shape)
    level[(slice(1, -1),) * x.ndim] = x
    level = level.ravel().tolist()
    out = list(level)
    for p in reversed(order):
        q = parent[p]
        if p != q and (level[p] == level[q] or size[p] < least):
            out[p] = out[q]
    return np.array(out).reshape(shape)[(slice(1, -1),) * x.ndim].astype(x.dtype)
