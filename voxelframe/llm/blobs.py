"""Rows that carry many small records as packed arrays.

A shuffle of single (hash, document, place) rows costs three times their
bytes.  Here a task sorts its records by bucket and sends one row per bucket
with the arrays packed one after the other.  Buckets follow from content
hashes and their number grows with the number of shuffle partitions, so a
bucket stays small at any size of the corpus.
"""

from __future__ import annotations

import numpy as np


def pack(*arrays: np.ndarray) -> bytes:
    """Little-endian arrays behind their lengths and item sizes."""
    head = np.array([[len(a), a.itemsize] for a in arrays], "<u4").tobytes()
    return bytes([len(arrays)]) + head + b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def unpack(blob: bytes, *kinds: str) -> list[np.ndarray]:
    n, at = blob[0], 1 + 8 * blob[0]
    out = []
    for (count, size), kind in zip(np.frombuffer(blob, "<u4", 2 * n, 1).reshape(-1, 2), kinds):
        out.append(np.frombuffer(blob, kind, int(count), at))
        at += int(count) * int(size)
    return out


def by_bucket(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A stable order by bucket, the buckets that occur, and where each begins (with the end)."""
    order = np.argsort(bucket, kind="stable")
    found, first = np.unique(bucket[order], return_index=True)
    return order, found, np.append(first, len(bucket))


def groups(*keys: np.ndarray) -> np.ndarray:
    """For sorted keys, where each group of equal ones begins (with the end)."""
    if not len(keys[0]):
        return np.zeros(1, np.int64)
    new = np.zeros(len(keys[0]), bool)
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    new[0] = True
    return np.append(np.flatnonzero(new), len(new))
