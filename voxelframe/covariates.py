"""Frames with labels and regions of interest that go with them through slices, projections and resampling.

Labels are a frame of whole numbers over some of the last axes of the image.
Regions of interest are rows: a number, a kind, a place on the batch axes (null:
on every place) and vertices over the spatial axes.  Slices select and move
them by the same index as the pixels.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sources
from .axes import Axes, AxesError, Slicer, parse
from .frame import ArrayFrame, method

KINDS = ("point", "line", "polyline", "rectangle", "polygon")


@dataclass(frozen=True)
class Roi:
    """Vertices over the spatial axes, at places of batch axes."""

    kind: str
    points: Sequence[Sequence[float]]
    at: dict[str, int] = field(default_factory=dict)


class Rois:
    """roi, kind, a column for each batch axis (null: everywhere) and points, an array of vertices in the order of the spatial axes."""

    def __init__(self, df: DataFrame, batch: str | Axes, space: str | Axes) -> None:
        self.batch, self.space = Axes.of(batch), Axes.of(space)
        lacking = [b for b in self.batch.names if b not in df.columns]
        own = [F.col(b).cast("int").alias(b) if b not in lacking else F.lit(None).cast("int").alias(b) for b in self.batch.names]
        self.df = df.select("roi", "kind", *own, F.col("points").cast("array<array<double>>").alias("points"))

    @classmethod
    def of(cls, spark: SparkSession, rois: Iterable[Roi], batch: str | Axes, space: str | Axes) -> Rois:
        batch, space = Axes.of(batch), Axes.of(space)
        rows = []
        for i, r in enumerate(rois):
            if r.kind not in KINDS:
                raise ValueError(f"unknown kind {r.kind!r}")
            if any(a not in batch for a in r.at):
                raise AxesError(f"axes {''.join(r.at)} of a region are not all among {batch}")
            if any(len(p) != len(space) for p in r.points):
                raise AxesError(f"a vertex has {len(space)} places")
            rows.append((i, r.kind, *[r.at.get(b) for b in batch.names], [[float(c) for c in p] for p in r.points]))
        fields = ", ".join(["roi bigint", "kind string", *[f"{b} int" for b in batch.names], "points array<array<double>>"])
        return cls(spark.createDataFrame(rows, fields), batch, space)

    def isel(self, **keys) -> Rois:
        """By the keys of a frame's slice.  A region goes if its place is not taken, or with its spatial axes if one of them is indexed by a place or a list."""
        df, batch, space, moves = self.df, [], [], []
        for axis in self.batch:
            k, c = keys.get(axis.name, slice(None)), F.col(axis.name)
            if isinstance(k, slice):
                start, step = k.start or 0, k.step or 1
                if start < 0 or step < 0 or (k.stop or 0) < 0:
                    raise AxesError(f"the slice of axis {axis} counts from its end")
                taken = (c >= start) & ((c - start) % step == 0) & (F.lit(True) if k.stop is None else c < k.stop)
                df = df.where(c.isNull() | taken).withColumn(axis.name, F.call_function("div", c - start, F.lit(step)).cast("int"))
            elif isinstance(k, (list, tuple, range)):
                places = F.array(*[F.lit(int(i)) for i in k])
                df = df.where(c.isNull() | F.array_contains(places, c)).withColumn(axis.name, F.when(c.isNotNull(), F.array_position(places, c).cast("int") - 1))
            else:
                df = df.where(c.isNull() | (c == int(k))).drop(axis.name)
            if (a := axis.sliced(k)) is not None:
                batch.append(a)
        for axis in self.space:
            k = keys.get(axis.name, slice(None))
            if not isinstance(k, slice):
                return Rois(df.limit(0), Axes(tuple(batch)), self.space)
            moves.append((float(k.start or 0), float(k.step or 1)))
            space.append(axis.sliced(k))
        out = Rois(df, Axes(tuple(batch)), Axes(tuple(space)))
        return out.moved([-a / s for a, s in moves], [1 / s for _, s in moves])

    def moved(self, shift: Sequence[float], scale: Sequence[float]) -> Rois:
        """Every coordinate times its axis' scale, plus its shift."""
        if all(v == 0 for v in shift) and all(v == 1 for v in scale):
            return self
        vertex = lambda p: F.array(*[p[i] * s + d for i, (s, d) in enumerate(zip(scale, shift))])
        return Rois(self.df.withColumn("points", F.transform("points", vertex)), self.batch, self.space)

    def drop(self, axis: str) -> Rois:
        """Without batch axes: regions of their places are regions everywhere."""
        return Rois(self.df.drop(*axis), self.batch.drop(list(axis)), self.space)

    def renamed(self, batch: Axes, space: Axes) -> Rois:
        return Rois(self.df.toDF("roi", "kind", *batch.names, "points"), batch, space)

    def vertices(self) -> DataFrame:
        """A row per vertex with a column per spatial axis."""
        df = self.df.select("roi", "kind", *self.batch.names, F.posexplode("points").alias("vertex", "_p"))
        return df.select("roi", "kind", *self.batch.names, "vertex", *[F.col("_p")[i].alias(a) for i, a in enumerate(self.space.names)])

    def collect(self) -> list[Roi]:
        rows = self.df.orderBy("roi", *self.batch.names).collect()
        return [Roi(r["kind"], [list(p) for p in r["points"]], {b: r[b] for b in self.batch.names if r[b] is not None}) for r in rows]


class Annotated:
    """An array frame with labels and regions.  Its methods are the frame's; results of the same axes and sizes keep both."""

    def __init__(self, frame: ArrayFrame, labels: ArrayFrame | None = None, rois: Rois | None = None) -> None:
        if labels is not None:
            if labels is frame:
                raise ValueError("a frame cannot be its own labels")
            if labels.dtype not in ("int64", "uint8", "uint16", "uint32"):
                raise TypeError(f"labels are whole numbers, not {labels.dtype}")
            lacking = [a for a in labels.axes.names if a not in frame.axes]
            size = dict(zip(frame.space.names, frame.shape))
            if lacking:
                raise AxesError(f"axes {''.join(lacking)} of the labels are not among {frame.axes}")
            if any(size.get(a, n) != n for a, n in zip(labels.space.names, labels.shape)) or [a for a in labels.space.names if a in size] != labels.space.names:
                raise ValueError(f"labels {labels!r} do not fit {frame!r}")
        if rois is not None and (rois.space.names != frame.space.names or any(b not in frame.batch for b in rois.batch.names)):
            raise AxesError(f"regions over {rois.batch}|{rois.space} do not fit {frame!r}")
        self.frame, self.labels, self.rois = frame, labels, rois

    def __repr__(self) -> str:
        return f"Annotated({self.frame!r}, labels={self.labels!r}, rois={'yes' if self.rois else 'no'})"

    def _like(self, frame: ArrayFrame) -> Annotated | ArrayFrame:
        same = frame.axes.names == self.frame.axes.names and frame.shape == self.frame.shape
        return Annotated(frame, self.labels, self.rois) if same else frame

    def __getattr__(self, name: str):
        if name.startswith("__"):
            raise AttributeError(name)
        found = getattr(self.frame, name)
        if not callable(found):
            return found

        def call(*args, **options):
            plain = [a.frame if isinstance(a, Annotated) else a for a in args]
            out = found(*plain, **{k: v.frame if isinstance(v, Annotated) else v for k, v in options.items()})
            return self._like(out) if isinstance(out, ArrayFrame) else out

        return call

    # slices ----------------------------------------------------------------------

    def __getitem__(self, key) -> Annotated:
        if isinstance(key, ArrayFrame):
            return self._like(self.frame[key])
        if isinstance(key, Slicer):
            key = key.keys
        return self.isel(**(parse(key, self.frame.sizes(key)) if isinstance(key, str) else key))

    def isel(self, **keys) -> Annotated:
        """Labels are sliced on the axes that they have; regions are selected and moved."""
        sizes = dict(zip(self.frame.space.names, self.frame.shape))
        need = {b: k for b, k in keys.items() if b in self.frame.batch and _from_end(k)}
        if need:
            sizes |= {b: self.frame._size(self.frame.batch[b]) for b in need}
        frame = self.frame.isel(**keys)
        labels = self.labels.isel(**{a: k for a, k in keys.items() if a in self.labels.axes}) if self.labels is not None else None
        if labels is not None and not labels.space.names:
            labels = None
        plain = {a: _plain(k, sizes[a]) if a in sizes else k for a, k in keys.items()}
        rois = self.rois.isel(**plain) if self.rois is not None else None
        if rois is not None and rois.space.names != frame.space.names:
            rois = None
        return Annotated(frame, labels, rois)

    def sel(self, **wanted) -> Annotated:
        keys = {}
        for name, label in wanted.items():
            axis = self.frame.axes[name]
            keys[name] = axis.label_slice(label) if isinstance(label, slice) else [axis.index(x) for x in label] if isinstance(label, list) else axis.index(label)
        return self.isel(**keys)

    # shapes -----------------------------------------------------------------------

    def projection(self, axis: str | None = None, how: str = "mean", mask: ArrayFrame | None = None) -> Annotated:
        """Labels that have an axis that goes, and regions that lose a spatial axis, go with it."""
        frame = self.frame.projection(axis, how, mask)
        gone = [a for a in self.frame.axes.names if a not in frame.axes]
        labels = self.labels if self.labels is not None and not any(a in self.labels.axes for a in gone) else None
        rois = None
        if self.rois is not None and not any(a in self.rois.space for a in gone):
            rois = self.rois.drop("".join(a for a in gone if a in self.rois.batch))
        return Annotated(frame, labels, rois)

    def binning(self, size: int = 2, how: str = "mean", **options) -> Annotated:
        """Labels take the value at the middle of each bin, regions are scaled."""
        frame = self.frame.binning(size, how, **options)
        cut = {a: slice(size // 2, n * size, size) for a, n in zip(frame.space.names, frame.shape)}
        labels = self.labels.isel(**{a: k for a, k in cut.items() if a in self.labels.space}) if self.labels is not None else None
        if labels is not None:
            labels = labels.set_axes(Axes(tuple(frame.axes[a.name] if a.name in frame.axes else a for a in labels.axes)))
        k = len(frame.shape)
        rois = self.rois.moved([(1 / size - 1) / 2] * k, [1 / size] * k) if self.rois is not None else None
        return Annotated(frame, labels, rois)

    def set_axes(self, axes) -> Annotated:
        frame, names = self.frame.set_axes(axes), dict(zip(self.frame.axes.names, Axes.of(axes)))
        labels = self.labels.set_axes(Axes(tuple(names[a] for a in self.labels.axes.names))) if self.labels is not None else None
        rois = self.rois.renamed(Axes(tuple(names[a] for a in self.rois.batch.names)), Axes(tuple(names[a] for a in self.rois.space.names))) if self.rois is not None else None
        return Annotated(frame, labels, rois)

    def set_scale(self, other=None, **scale) -> Annotated:
        return self.set_axes(self.frame.axes.scaled(other, **scale))

    # labels -------------------------------------------------------------------------

    def label_threshold(self, how="otsu", **options) -> Annotated:
        """With the components of a threshold as labels."""
        return Annotated(self.frame, self.frame.label_threshold(how, **options), self.rois)

    def append_label(self, image: ArrayFrame, new: bool = False) -> Annotated:
        """With components of an image (a mask, or numbers) after the labels there are."""
        more = image.label() if image.dtype == "bool" else image.as_type("float32").map(lambda x: x, "int64")
        if self.labels is None or new:
            return Annotated(self.frame, more, self.rois)
        if more.axes.names != self.labels.axes.names or more.shape != self.labels.shape:
            raise ValueError(f"labels {more!r} do not fit {self.labels!r}")
        return Annotated(self.frame, self.labels.add_label(more), self.rois)

    def _whole_labels(self) -> ArrayFrame:
        if self.labels is None:
            raise ValueError("the frame has no labels")
        if self.labels.axes.names == self.frame.axes.names:
            return self.labels
        if self.labels.space.names != self.frame.space.names:
            raise AxesError(f"labels {self.labels!r} do not cover {self.frame!r}")
        keys = self.frame.df.select(*self.frame.batch.names)
        shared = self.labels.batch.names
        df = keys.join(self.labels.df, shared) if shared else keys.crossJoin(self.labels.df)
        return ArrayFrame(df, self.frame.batch, self.frame.space, self.frame.shape, "int64")

    def regionprops(self, properties=("area",), **options) -> DataFrame:
        """Properties of its own labels, which stand for every place on the axes that they lack."""
        return self.frame.regionprops(self._whole_labels(), properties, **options)

    def label_mask(self) -> ArrayFrame:
        return self._whole_labels() > 0

    # files --------------------------------------------------------------------------

    def save(self, path: str, overwrite: bool = True) -> None:
        """Three tables under one folder; what there is is told last."""
        spark = self.frame.df.sparkSession
        sources.imsave(self.frame, f"{path}/image", overwrite=overwrite)
        if self.labels is not None:
            sources.imsave(self.labels, f"{path}/labels", overwrite=overwrite)
        if self.rois is not None:
            self.rois.df.write.mode("overwrite" if overwrite else "errorifexists").parquet(f"{path}/rois")
        parts = {"labels": self.labels is not None, "rois": [self.rois.batch.names, self.rois.space.names] if self.rois else None}
        spark.createDataFrame([(json.dumps(parts),)], "parts string").coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").text(f"{path}/parts")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Annotated:
        parts = json.loads(spark.read.text(f"{path}/parts").first()[0])
        labels = sources.imread(spark, f"{path}/labels") if parts["labels"] else None
        rois = Rois(spark.read.parquet(f"{path}/rois"), *parts["rois"]) if parts["rois"] else None
        return cls(sources.imread(spark, f"{path}/image"), labels, rois)


def _from_end(k) -> bool:
    places = (k.start or 0, k.stop or 0, k.step or 1) if isinstance(k, slice) else tuple(k) if isinstance(k, (list, tuple, range)) else (int(k),)
    return min(places, default=0) < 0


def _plain(k, n: int):
    """The key with places from the start and the first place taken as a slice's start."""
    if isinstance(k, slice):
        start, stop, step = k.indices(n)
        return slice(start, stop if step > 0 else None, step) if step > 0 else slice(start, None, step)
    return [i % n for i in k] if isinstance(k, (list, tuple, range)) else int(k) % n


def _operator(name: str):
    def call(self: Annotated, other=None):
        other = other.frame if isinstance(other, Annotated) else other
        f = getattr(self.frame, name)
        return self._like(f() if other is None else f(other))

    return call


for _name in ("add", "sub", "mul", "truediv", "floordiv", "mod", "pow", "radd", "rsub", "rmul", "rtruediv", "neg", "invert", "gt", "ge", "lt", "le", "and", "or"):
    setattr(Annotated, f"__{_name}__", _operator(f"__{_name}__"))


@method
def annotate(self: ArrayFrame, labels: ArrayFrame | None = None, rois: Rois | Iterable[Roi] | None = None) -> Annotated:
    """The frame with labels and regions of interest that go with it."""
    if rois is not None and not isinstance(rois, Rois):
        rois = Rois.of(self.df.sparkSession, rois, self.batch, self.space)
    return Annotated(self, labels, rois)
