"""Labels, regions and points of array frames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..frame import ArrayFrame
from ..functions import filters, objects
from .image import method, over


@method
def label(self: ArrayFrame, *, connectivity: int | None = None, dims=None, unique: bool = False) -> ArrayFrame:
    """Components of equal non-zero neighbours, numbered within each array, or uniquely over all of them."""
    out = over(self, lambda x: objects.label(x.astype(np.int64), connectivity), dims, "int64")
    return unique_labels(out) if unique else out


@method
def unique_labels(self: ArrayFrame) -> ArrayFrame:
    """Numbers of each array moved above those of the arrays before it.

    Running sums in two steps: over blocks of 4096 places in the order of all
    batch axes (few rows), and within each block, so that no task orders all arrays.
    """
    place, sizes = F.lit(0).cast("long"), self.df.agg(*[F.max(b).alias(b) for b in self.batch.names]).first()
    for b in self.batch.names:
        place = place * (int(sizes[b] or 0) + 1) + F.col(b)
    block = F.call_function("div", place, F.lit(4096))
    most = self.df.select(*self.batch.names, F.coalesce(F.array_max("data"), F.lit(0.0)).alias("_n")).withColumn("_b", block)
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = most.groupBy("_b").agg(F.sum("_n").alias("_s")).select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0.0)).alias("_base"))
    inside = Window.partitionBy("_b").orderBy(*self.batch.names).rowsBetween(Window.unboundedPreceding, -1)
    offset = most.withColumn("_i", F.coalesce(F.sum("_n").over(inside), F.lit(0.0))).join(blocks, "_b").select(*self.batch.names, (F.col("_i") + F.col("_base")).alias("_o"))
    df = self.df.join(offset, self.batch.names)
    return ArrayFrame(df.withColumn("data", F.transform("data", lambda v: F.when(v > 0, v + F.col("_o")).otherwise(0.0))), self.batch, self.space, self.shape, "int64")


@method
def label_threshold(self: ArrayFrame, how="otsu", *, dims=None, **options) -> ArrayFrame:
    return self.threshold(how, dims=dims, **options).label(dims=dims)


@method
def relabel(self: ArrayFrame) -> ArrayFrame:
    """Numbers 1, 2, ... in the order of the old ones, for each array."""
    return self.map(objects.renumber, "int64")


@method
def expand_labels(self: ArrayFrame, distance: float = 1, *, dims=None) -> ArrayFrame:
    return over(self, lambda x: objects.nearest_label(x, distance), dims, "int64")


@method
def delete_label(self: ArrayFrame, ids) -> ArrayFrame:
    gone = [ids] if np.ndim(ids) == 0 else list(ids)
    return self.each(lambda v: F.when(v.isin([float(i) for i in gone]), 0.0).otherwise(v))


@method
def add_label(self: ArrayFrame, other: ArrayFrame) -> ArrayFrame:
    """The other labels on top, their numbers moved above the greatest of these."""
    return self.map_with(other, lambda a, b: np.where(b > 0, b + a.reshape(len(a), -1).max(1).reshape(-1, *[1] * (a.ndim - 1)), a), "int64")


@method
def proj_labels(self: ArrayFrame, axis: str, forbid_overlap: bool = False) -> ArrayFrame:
    if forbid_overlap:
        rest = [a for a in self.axes.names if a not in axis]
        if not self.pixels().where("value > 0").groupBy(*rest).count().where("count > 1").isEmpty():
            raise ValueError(f"labels overlap along {axis}")
    return self.reduce("max", axis)


@method
def open_labels(self: ArrayFrame, radius: float = 1) -> ArrayFrame:
    """Pixels that an opening of the foreground removes lose their label; the rest is numbered again."""
    return self.map(lambda x: objects.renumber(np.where(objects.opening(x > 0, radius), x, 0)), "int64")


@method
def watershed(self: ArrayFrame, labels: ArrayFrame, *, distance: float = 2, source: str = "distance", connectivity: int = 1) -> ArrayFrame:
    """Objects split at the peaks of their distance map (or of the image)."""

    def run(x, lab):
        out = np.zeros(lab.shape)
        for i in range(len(x)):
            mask = lab[i] > 0
            height = objects.distance_map(mask[None])[0] if source == "distance" else x[i]
            height = np.where(np.isinf(height), 0, height)
            seeds = np.zeros(mask.shape, np.int64)
            for k, p in enumerate(objects.peaks(height[None], distance, 0.0, border=False, labels=lab[i][None])[0], 1):
                seeds[tuple(p)] = k
            out[i] = objects.watershed(-height, seeds, mask, connectivity)
        return out

    return self.map_with(labels, run, "int64")


@method
def random_walker(self: ArrayFrame, seeds: ArrayFrame, beta: float = 130.0) -> ArrayFrame:
    return self.map_with(seeds, lambda x, s: np.stack([objects.random_walker(a, b, beta) for a, b in zip(x, s)]), "int64")


@method
def flood(self: ArrayFrame, seeds: Sequence[Sequence[int]], *, tolerance: float = 0.0, connectivity: int | None = None) -> ArrayFrame:
    """Label k + 1 for what seed k reaches; a seed in a region that is labelled already adds nothing."""

    def run(x):
        out = np.zeros(x.shape)
        for i, a in enumerate(x):
            k = 0
            for s in seeds:
                if out[i][tuple(s)] == 0:
                    k += 1
                    out[i][objects.flood(a, s, tolerance, connectivity) & (out[i] == 0)] = k
        return out

    return self.map(run, "int64")


@method
def regionprops(self: ArrayFrame, labels: ArrayFrame, properties: Sequence[str] = ("intensity_mean",), extra: dict[str, Callable] | None = None) -> DataFrame:
    """A row per array, label and property: N (from 0), prop, value. extra: functions of a region's mask and values."""
    names, extra = list(properties), dict(extra or {})

    def run(x, lab):
        row, ids, prop, value = [], [], [], []
        for i in range(len(x)):
            found = objects.region_properties(lab[i], x[i], names)
            for k, values in found.items():
                values = dict(values)
                for name, f in extra.items():
                    values[name] = float(f(lab[i] == k, x[i][lab[i] == k]))
                for p, v in values.items():
                    row.append(i), ids.append(k - 1), prop.append(p), value.append(float(v))
        return {"row": row, "N": ids, "prop": prop, "value": value}

    return self.table(run, "N bigint, prop string, value double", labels)


@method
def extract(self: ArrayFrame, labels: ArrayFrame, ids: Sequence[int] | None = None, cval: float = 0.0) -> DataFrame:
    """Each region's bounding box: N, shape and data, values outside of the region replaced."""

    def run(x, lab):
        out = {"row": [], "N": [], "shape": [], "values": []}
        for i in range(len(x)):
            for k in np.unique(lab[i][lab[i] > 0]):
                if ids is None or int(k) in ids:
                    at = np.argwhere(lab[i] == k)
                    box = tuple(slice(a, b) for a, b in zip(at.min(0), at.max(0) + 1))
                    part = np.where(lab[i][box] == k, x[i][box], cval)
                    out["row"].append(i), out["N"].append(int(k)), out["shape"].append(list(part.shape)), out["values"].append(part.ravel().astype(float).tolist())
        return out

    return self.table(run, "N bigint, shape array<int>, values array<double>", labels)


def _points(self: ArrayFrame, found: Callable[[np.ndarray], list[np.ndarray]]) -> DataFrame:
    names = self.space.names

    def run(x):
        out = {"row": [], "value": [], **{a: [] for a in names}}
        for i, at in enumerate(found(x)):
            for p in at:
                out["row"].append(i), out["value"].append(float(x[i][tuple(p)]))
                for a, v in zip(names, p):
                    out[a].append(int(v))
        return out

    return self.table(run, ", ".join(f"{a} bigint" for a in names) + ", value double")


@method
def peak_local_max(self: ArrayFrame, *, distance: float = 1.0, percentile: float | None = None, topn: int | None = None, exclude_border: bool = True) -> DataFrame:
    """Local maxima in a ball: a row per point, brightest first within an array."""

    def run(x):
        out = []
        for a in x:
            level = None if percentile is None else float(np.percentile(a, percentile))
            out += objects.peaks(a[None], distance, level, topn, exclude_border)
        return out

    return _points(self, run)


@method
def find_sm(self: ArrayFrame, sigma: float = 1.5, *, how: str = "dog", cutoff: float | None = None, percentile: float = 95, topn: int | None = None, exclude_border: bool = True) -> DataFrame:
    """Spots: peaks of a band-pass response."""
    response = {"dog": lambda: self.dog_filter(sigma), "doh": lambda: self.doh_filter(sigma), "log": lambda: self.log_filter(sigma), "gaussian": lambda: self.gaussian_filter(sigma)}[how]()
    if cutoff is not None:
        response = response.each(lambda v: F.greatest(v, F.lit(float(cutoff))))
    return response.peak_local_max(distance=2 * sigma, percentile=percentile, topn=topn, exclude_border=exclude_border)


@method
def centroid_sm(self: ArrayFrame, points: DataFrame, *, radius: int = 4) -> DataFrame:
    """Intensity centroid in a box about each point, cut at the borders, natively.

    Points emit the pixels of their box, which join the image by coordinates;
    sums per point follow, so no point meets pixels outside of its box.
    """
    names, keys = self.space.names, [*self.batch.names]
    pts = points.select(*keys, *[F.col(a).alias(f"_{a}") for a in names])
    box = pts
    for a in names:
        box = box.withColumn(a, F.explode(F.sequence((F.round(F.col(f"_{a}")) - radius).cast("int"), (F.round(F.col(f"_{a}")) + radius).cast("int"))))
    v = F.col("value")
    got = box.join(self.pixels(), [*keys, *names]).groupBy(*keys, *[f"_{a}" for a in names])
    return got.agg(*[(F.sum(F.col(a) * v) / F.sum(v)).alias(a) for a in names]).drop(*[f"_{a}" for a in names])


@method
def specify(self: ArrayFrame, points: DataFrame, radius, kind: str = "square") -> ArrayFrame:
    """Labels drawn around points (columns of the axes and ``ord`` from 1); later points win."""
    names, keys = self.space.names, [b for b in self.batch.names if b in points.columns]
    radii = np.broadcast_to(np.asarray(radius, float), len(names))
    box = points.select(*keys, "ord", *[F.col(a).alias(f"_{a}") for a in names])
    inside = F.lit(0.0)
    for a, r, n in zip(names, radii, self.shape):
        lo, hi = F.greatest(F.ceil(F.col(f"_{a}") - float(r)), F.lit(0)).cast("int"), F.least(F.floor(F.col(f"_{a}") + float(r)), F.lit(n - 1)).cast("int")
        box = box.where(lo <= hi).withColumn(a, F.explode(F.sequence(lo, hi)))
        inside = inside + F.pow((F.col(a) - F.col(f"_{a}")) / float(r or 1), 2)
    if kind == "circle":
        box = box.where(inside <= 1)
    drawn = box.groupBy(*keys, *names).agg(F.max("ord").cast("double").alias("value"))
    every = self.df.select(*self.batch.names)
    drawn = every.join(ArrayFrame.from_pixels(drawn, keys, self.space, self.shape).df, keys, "left") if keys else drawn
    size = int(np.prod(self.shape))
    if not keys:
        return ArrayFrame.from_pixels(drawn.withColumn("_k", F.lit(0)), "", self.space, self.shape, dtype="int64")
    return ArrayFrame(drawn.withColumn("data", F.coalesce("data", F.array_repeat(F.lit(0.0), size))), self.batch, self.space, self.shape, "int64")


@method
def voronoi(self: ArrayFrame, points: np.ndarray) -> ArrayFrame:
    """Number (from 1) of the nearest point of a short list; the first wins a tie."""
    pts = np.asarray(points, float)

    def run(x):
        from ..functions.geometry import grid

        g = grid(x.shape[1:])
        d = np.stack([sum((g[i] - p[i]) ** 2 for i in range(len(p))) for p in pts])
        return np.broadcast_to(d.argmin(0) + 1, x.shape)

    return self.map(run, "int64")


@method
def pointprops(self: ArrayFrame, points: DataFrame, *, order: int = 1) -> DataFrame:
    """Interpolated value at each point (order 0 or 1, natively): the points' columns and value.

    Each point emits its up to 2^d corners, which join the pixels by coordinates.
    """
    names, keys = self.space.names, [b for b in self.batch.names if b in points.columns]
    pts = points.withColumn("_id", F.struct(*points.columns))
    for a in names:
        c = F.col(a)
        corners = F.array(F.struct(F.floor(c).cast("int").alias("i"), (F.floor(c) + 1 - c).alias("w")), F.struct((F.floor(c) + 1).cast("int").alias("i"), (c - F.floor(c)).alias("w")))
        if order == 0:
            corners = F.array(F.struct(F.floor(c + 0.5).cast("int").alias("i"), F.lit(1.0).alias("w")))
        pts = pts.withColumn(f"_{a}", F.explode(corners)).where(F.col(f"_{a}.w") > 0)
    corner = pts.select("_id", *[F.col(k) for k in keys], *[F.col(f"_{a}.i").alias(a) for a in names], _product([F.col(f"_{a}.w") for a in names]).alias("_w"))
    got = corner.join(self.pixels("_v"), [*keys, *names], "left").groupBy("_id").agg(F.sum(F.col("_w") * F.coalesce("_v", F.lit(0.0))).alias("value"))
    return got.select("_id.*", "value")


def _product(cols):
    out = cols[0]
    for c in cols[1:]:
        out = out * c
    return out


@method
def glcm_props(self: ArrayFrame, distance: float, angle: float, radius: int, properties: Sequence[str], levels: int) -> dict[str, ArrayFrame]:
    """Texture measures of the pair counts in a window around each pixel (values 0 to levels - 1)."""

    def run(name, x):
        wide = filters.pad(x, [radius] * 2, [radius] * 2, "mirror").astype(np.int64)
        out = np.zeros(x.shape)
        for i in range(len(x)):
            for y in range(x.shape[1]):
                for z in range(x.shape[2]):
                    g = objects.cooccurrence(wide[i, y : y + 2 * radius + 1, z : z + 2 * radius + 1], distance, angle, levels)
                    out[i, y, z] = objects.cooccurrence_property(g, name)
        return out

    return {p: self.map(lambda x, p=p: run(p, x), "float32") for p in properties}


@method
def glcm(self: ArrayFrame, dy: int, dx: int) -> DataFrame:
    """Counts of value pairs at an offset over each whole array, natively: ref, nei, n."""
    px = self.pixels("ref")
    other = self.pixels("nei").withColumns({"y": F.col("y") - dy, "x": F.col("x") - dx})
    return px.join(other, self.axes.names).groupBy(*self.batch.names, "ref", "nei").agg(F.count("*").alias("n"))
