"""Vectorised work on UTF-8 text held in Arrow buffers.

Texts stay byte buffers: words are found, hashed and put into windows with
numpy over a block of many documents at once, so no Python object is made per
word.  Every function takes whole texts; blocks only bound the memory of the
temporary arrays, and one document is never cut.

Hashes are polynomials over the ring of 64-bit integers with random byte
values, finished by a mixer.  They depend on content only, so every executor
and every run gets the same values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text per block; temporary arrays take about 40 times as much.
BLOCK_BYTES = 1 << 19

_rng = np.random.Generator(np.random.PCG64(20240229))
LUT = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
LUT_LOWER = LUT.copy()
LUT_LOWER[65:91] = LUT[97:123]
BASE, STEP = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95)
SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, *range(0x09, 0x0E)]] = True
NEWLINE = np.zeros(256, bool)
NEWLINE[0x0A] = True


class _Powers:
    """Powers of an odd number and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inverse = base, np.uint64(pow(int(base), -1, 2**64))
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, self.base))])
            self.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, self.inverse))])
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(BASE), _Powers(STEP)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit mixer (xor, shift, multiply)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


class Block:
    """Some documents: their bytes, and offsets of n + 1 documents in them."""

    def __init__(self, data: np.ndarray, off: np.ndarray, first: int) -> None:
        self.data, self.off, self.first, self.n = data, off, first, len(off) - 1

    def rows(self) -> slice:
        """Where its documents stand in the batch."""
        return slice(self.first, self.first + self.n)

    def spans(self, separator: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of the maximal runs without a separator, and for each document the first of its runs (n + 1 values)."""
        sep, off = separator[self.data], self.off
        edge = np.ones(len(sep) + 1, bool)
        edge[1:-1] = sep[:-1]
        edge[off] = True
        starts = np.flatnonzero(~sep & edge[:-1])
        edge = np.ones(len(sep) + 1, bool)
        edge[:-1] = np.append(sep[1:], True)
        edge[off[1:][off[1:] > 0] - 1] = True
        ends = np.flatnonzero(~sep & edge[:-1]) + 1
        return starts, ends, np.searchsorted(starts, off)

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.spans(SEPARATOR)

    def hashes(self, starts: np.ndarray, ends: np.ndarray, lut: np.ndarray = LUT) -> np.ndarray:
        """A 64-bit hash of each span of bytes."""
        up, down = _BYTES.get(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum(lut[self.data] * up[:-1], out=total[1:])
        return mix((total[ends] - total[starts]) * down[starts])

    def text(self, i: int) -> bytes:
        return self.data[self.off[i] : self.off[i + 1]].tobytes()


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k values; the last k - 1 places have none.  Runs over a document's end are the caller's to leave out."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.get(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: len(words) - k + 1])


def inside(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Places of the windows of k words that end in the document they start in; first has the first word of each document."""
    ok = np.ones(max(0, n - k + 1), bool)
    cuts = first[1:-1]
    for back in range(1, k):
        at = cuts - back
        ok[at[(at >= 0) & (at < len(ok))]] = False
    return ok


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets is not None and offsets.size else np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), off


def blocks(column: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The documents of a column, in blocks of about limit bytes."""
    data, off = buffers(column)
    at, n = 0, len(off) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield Block(data[off[at] : off[to]], off[at : to + 1] - off[at], at)
        at = to


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sum of the values of each document; first has n + 1 places."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[first[1:]] - total[first[:-1]]


def slices(batches: Iterator[pa.RecordBatch], column: int, limit: int = 3 << 20) -> Iterator[pa.RecordBatch]:
    """The rows of the batches, cut and joined between rows to batches with about limit bytes of text each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        _, off = buffers(batch.column(column))
        at, n = 0, batch.num_rows
        while at < n:
            to = min(n, max(at + 1, int(np.searchsorted(off, off[at] + limit - size, "right")) - 1))
            held.append(batch.slice(at, to - at))
            size += int(off[to] - off[at])
            at = to
            if size >= limit or at < n:
                yield _joined(held)
                held, size = [], 0
    if held:
        yield _joined(held)


def _joined(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    return batches[0] if len(batches) == 1 else pa.Table.from_batches(batches).combine_chunks().to_batches()[0]
