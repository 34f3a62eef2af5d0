"""A set of 64-bit hashes as a bitmap of fixed size.

It has no false negatives, so it may only skip work that an exact join behind
it would have thrown away.  Its size is a constant (2 MB by default) whatever
the size of the set, which makes it safe to send to every executor; a set that
fills it makes it useless, not wrong.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BITS = 24


def bitmap(hashes: DataFrame, column: str = "h", bits: int = BITS) -> np.ndarray:
    """Built from a column of bigint hashes, in at most 2 ** (bits - 6) words from the executors."""
    word = F.shiftrightunsigned(F.col(column), 64 - bits + 6)
    bit = F.shiftrightunsigned(F.col(column), 64 - bits).bitwiseAND(63).cast("int")
    rows = hashes.select(word.alias("w"), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit).alias("v"))
    got = rows.groupBy("w").agg(F.bit_or("v").alias("v")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["w"].to_numpy(np.int64)] = got["v"].to_numpy(np.int64).view(np.uint64)
    return out


def hit(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which of the hashes (uint64) may be in the set."""
    bits = int(len(table)).bit_length() - 1 + 6
    at = h >> np.uint64(64 - bits)
    return ((table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)
