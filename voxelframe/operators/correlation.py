"""Comparison of two array frames over their spatial axes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..frame import ArrayFrame, _few
from ..functions import fourier


def _pairs(a: ArrayFrame, b: ArrayFrame, mask: ArrayFrame | None) -> DataFrame:
    """Pixels of both; where the mask is true they are left out.

    Arrays of one shape are joined as rows and spread afterwards, so pixels
    are not shuffled; fewer spatial axes are met pixel by pixel.
    """
    if not _in_rows(a, b, mask):
        out = a.pixels("u").join(b.pixels("v"), [n for n in a.axes.names if n in b.axes])
        if mask is not None:
            out = out.join(mask.pixels("m"), [n for n in mask.axes.names if n in a.axes], "left").where("coalesce(m, 0) = 0")
        return out
    return _rows(a, b, mask).select(*a.batch.names, F.inline("data"))


def _rows(a: ArrayFrame, b: ArrayFrame, mask: ArrayFrame | None) -> DataFrame:
    """The pixels of both that are not left out as one array per row."""
    keys = a.batch.names
    both = a._joined(b).select(*keys, F.arrays_zip(F.col("data").alias("u"), F.col("_other").alias("v")).alias("data"))
    if mask is None:
        return both
    masks = mask.df.withColumnRenamed("data", "_m")
    on = mask.batch.names
    both = both.join(masks, on, "left") if on else both.join(masks.withColumn("_one", F.lit(1)), F.lit(1) == F.col("_one"), "left")
    kept = F.when(F.col("_m").isNull(), F.col("data")).otherwise(F.filter("data", lambda x, i: F.coalesce(F.get("_m", i), F.lit(0.0)) == 0))
    return both.select(*keys, kept.alias("data"))


def _in_rows(a: ArrayFrame, b: ArrayFrame, mask: ArrayFrame | None) -> bool:
    return _alike(a, b) and (mask is None or _alike(a, mask))


def _alike(a: ArrayFrame, b: ArrayFrame) -> bool:
    return a.space.names == b.space.names and a.shape == b.shape and all(n in a.batch for n in b.batch.names)


def ncc(a: ArrayFrame, b: ArrayFrame, mask: ArrayFrame | None = None) -> DataFrame:
    """Sum of products over the product of deviations and the count; means are not taken off."""
    u, v = F.col("u"), F.col("v")
    return _pairs(a, b, mask).groupBy(*a.batch.names).agg((F.sum(u * v) / (F.stddev_pop(u) * F.stddev_pop(v) * F.count("*"))).alias("value"))


def zncc(a: ArrayFrame, b: ArrayFrame, mask: ArrayFrame | None = None) -> DataFrame:
    """Pearson correlation."""
    return _pairs(a, b, mask).groupBy(*a.batch.names).agg(F.corr("u", "v").alias("value"))


pearson_coloc = zncc


def manders_coloc(a: ArrayFrame, mask: ArrayFrame) -> DataFrame:
    """Share of a's intensity where the mask is true."""
    px = _pairs(a, mask, None).withColumnRenamed("v", "m")
    return px.groupBy(*a.batch.names).agg((F.sum(F.when(F.col("m") != 0, F.col("u")).otherwise(0.0)) / F.sum("u")).alias("value"))


def nmi(a: ArrayFrame, b: ArrayFrame, mask: ArrayFrame | None = None, bins: int = 100) -> DataFrame:
    """Normalised mutual information on a histogram of equal bins per array.

    Arrays of one shape are counted row by row where they have met; only others
    are joined and grouped by pixels.
    """
    if _in_rows(a, b, mask):
        both = _rows(a, b, mask).select(*a.batch.names, *(F.col(f"data.{c}").cast("array<double>").alias(f"_{c}") for c in "uv"))
        return both.where("size(_u) > 0").mapInArrow(_information(len(a.batch), a.shape, bins), a._schema("value double"))
    keys, px = a.batch.names, _pairs(a, b, mask)
    limits = px.groupBy(*keys).agg(F.min("u").alias("u0"), F.max("u").alias("u1"), F.min("v").alias("v0"), F.max("v").alias("v1"), F.count("*").alias("all"))

    def bin_of(c, lo, hi):
        return F.least(F.floor((c - lo) * bins / F.when(hi > lo, hi - lo).otherwise(1.0)), F.lit(bins - 1)).cast("int")

    cells = px.join(limits, keys).withColumns({"i": bin_of(F.col("u"), F.col("u0"), F.col("u1")), "j": bin_of(F.col("v"), F.col("v0"), F.col("v1"))})
    joint = cells.groupBy(*keys, "i", "j", "all").agg(F.count("*").alias("n"))

    def entropy(df: DataFrame, name: str) -> DataFrame:
        p = F.col("n") / F.col("all")
        return df.groupBy(*keys).agg((-F.sum(p * F.ln(p))).alias(name))

    h = entropy(joint, "hxy")
    for c, name in (("i", "hx"), ("j", "hy")):
        h = h.join(entropy(joint.groupBy(*keys, c, "all").agg(F.sum("n").alias("n")), name), keys)
    return h.select(*keys, F.when(F.col("hxy") > 0, (F.col("hx") + F.col("hy")) / F.col("hxy")).otherwise(1.0).alias("value"))


def _information(n: int, shape: tuple[int, ...], bins: int):
    """nmi of each row's two arrays, which are behind n columns."""

    def bins_of(x: np.ndarray, first: np.ndarray, doc: np.ndarray) -> np.ndarray:
        low, high = np.fmin.reduceat(x, first), np.maximum.reduceat(x, first)
        wide = np.where((high > low) | np.isnan(high), high - low, 1.0)
        with np.errstate(invalid="ignore"):
            at = np.floor((x - low[doc]) * bins / wide[doc])
        return np.minimum(np.where(np.isnan(at), 0, at), bins - 1).astype(np.int64)

    def entropy(cells: np.ndarray, each: int, size: np.ndarray) -> np.ndarray:
        cell, count = np.unique(cells, return_counts=True)
        p = count / size[cell // each]
        return -np.bincount(cell // each, p * np.log(p), len(size))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _few(batches, shape):
            if not b.num_rows:
                continue
            size = pc.list_value_length(b.column(n)).to_numpy().astype(np.int64)
            first, doc = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
            i, j = (bins_of(b.column(n + k).flatten().to_numpy(zero_copy_only=False).astype(float), first, doc) for k in (0, 1))
            both = entropy((doc * bins + i) * bins + j, bins * bins, size)
            alone = entropy(doc * bins + i, bins, size) + entropy(doc * bins + j, bins, size)
            value = np.divide(alone, both, out=np.ones(len(size)), where=both > 0)
            yield pa.RecordBatch.from_arrays([*b.columns[:n], pa.array(value)], [*b.schema.names[:n], "value"])

    return run


def _amplitude(a: ArrayFrame) -> ArrayFrame:
    return a.map(lambda x: np.abs(fourier.fft(x)), "float64")


def fourier_ncc(a: ArrayFrame, b: ArrayFrame, mask: ArrayFrame | None = None) -> DataFrame:
    return ncc(_amplitude(a), _amplitude(b), mask)


def fourier_zncc(a: ArrayFrame, b: ArrayFrame, mask: ArrayFrame | None = None) -> DataFrame:
    return zncc(_amplitude(a), _amplitude(b), mask)


def fsc(a: ArrayFrame, b: ArrayFrame, step: float = 0.02) -> DataFrame:
    """Fourier shell correlation: columns freq and value."""

    def run(x, y):
        out = {"row": [], "freq": [], "value": []}
        for i, (p, q) in enumerate(zip(x, y)):
            f, v = fourier.shell_correlation(p, q, step)
            ok = np.isfinite(v)
            out["row"] += [i] * int(ok.sum())
            out["freq"] += f[ok].tolist()
            out["value"] += v[ok].tolist()
        return out

    return a.table(run, "freq double, value double", b)


def _shift_table(a: ArrayFrame, b: ArrayFrame, f) -> DataFrame:
    names = [f"d_{n}" for n in a.space.names]

    def run(x, y):
        found = [f(p, q) for p, q in zip(x, y)]
        return {**{n: [float(s[i]) for s, _ in found] for i, n in enumerate(names)}, "corr": [float(c) for _, c in found]}

    return a.table(run, ", ".join(f"{n} double" for n in names) + ", corr double", b)


def pcc_maximum(a: ArrayFrame, b: ArrayFrame, upsample: int = 10, most: float | None = None) -> DataFrame:
    """The displacement of b that matches a, and the normalised peak."""

    def f(p, q):
        land = np.abs(np.fft.ifftn(np.fft.fftn(p) * np.fft.fftn(q).conj())) ** 2
        norm = (np.abs(p) ** 2).sum() * (np.abs(q) ** 2).sum()
        return fourier.phase_correlation(p, q, upsample, most), land.max() / norm if norm else 0.0

    return _shift_table(a, b, f)


def zncc_maximum(a: ArrayFrame, b: ArrayFrame, most: int = 3, upsample: int = 10) -> DataFrame:
    return _shift_table(a, b, lambda p, q: fourier.zero_normalised_maximum(p, q, most, upsample))


def pcc_landscape(a: ArrayFrame, b: ArrayFrame, most: int | None = None) -> ArrayFrame:
    shape = fourier.correlation_landscape(np.zeros(a.shape), np.zeros(a.shape), most).shape
    return a.map_with(b, lambda x, y: np.stack([fourier.correlation_landscape(p, q, most) for p, q in zip(x, y)]), "float64", shape=shape)


def zncc_landscape(a: ArrayFrame, b: ArrayFrame, most: int = 3) -> ArrayFrame:
    return a.map_with(b, lambda x, y: np.stack([fourier.zero_normalised_landscape(p, q, most) for p, q in zip(x, y)]), "float64", shape=[2 * most + 1] * len(a.shape))


def polar_pcc_maximum(a: ArrayFrame, b: ArrayFrame, step: float = 0.1, upsample: int = 10) -> DataFrame:
    """Rotation (degrees) of b that matches a."""
    radius = min(a.shape) / 2

    def f(p, q):
        from ..functions.geometry import polar

        u, v = (polar(i[None], radius, step)[0] for i in (p, q))
        d = fourier.phase_correlation(u, v, upsample)
        return np.array([np.rad2deg(d[0] * step), 0.0]), 1.0

    names = ["degree", "zero"]

    def run(x, y):
        found = [f(p, q)[0] for p, q in zip(x, y)]
        return {n: [float(s[i]) for s in found] for i, n in enumerate(names)}

    return a.table(run, "degree double, zero double", b).drop("zero")
