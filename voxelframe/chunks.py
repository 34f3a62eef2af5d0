"""Planes and volumes in chunks: one row per chunk, for arrays that are too large for a row.

A chunked frame has the batch columns, a column ``chunk_<axis>`` for each
spatial axis, and the chunk's values.  Operators with a local support get a
halo: every chunk emits what its neighbours need of it under their keys, and
only these strips are shuffled, as chunks are kept in tables with buckets of
their keys, which the join of chunks and strips reads as they are.
What needs a whole plane (thresholds, labels) is put together from small
summaries: histograms, and equalities of labels along the seams.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .axes import Axes, AxesError
from .frame import ArrayFrame, cast, method
from .functions import objects

BOUNDARIES = {"none": None, "reflect": "symmetric", "nearest": "edge", "periodic": None}


@dataclass(frozen=True)
class Grid:
    """Chunks of one size (smaller at the ends) over an array."""

    shape: tuple[int, ...]
    chunks: tuple[int, ...]

    @property
    def count(self) -> tuple[int, ...]:
        return tuple(-(-n // c) for n, c in zip(self.shape, self.chunks))

    def region(self, index: Sequence[int]) -> list[tuple[int, int]]:
        return [(int(k) * c, min((int(k) + 1) * c, n)) for k, c, n in zip(index, self.chunks, self.shape)]

    def size(self, index: Sequence[int]) -> tuple[int, ...]:
        return tuple(b - a for a, b in self.region(index))

    def halo(self, index: Sequence[int], depth: Sequence[int], periodic: bool) -> list[tuple[int, int]]:
        """The region with its halo; it ends with the array unless that is periodic."""
        return [(a - d, b + d) if periodic else (max(0, a - d), min(n, b + d)) for (a, b), d, n in zip(self.region(index), depth, self.shape)]

    def strips(self, index: Sequence[int], depth: Sequence[int], periodic: bool) -> Iterator[tuple[tuple[int, ...], list[tuple[int, int]], tuple[slice, ...]]]:
        """What a chunk gives to others: their index, the place in the coordinates of their region, and the part of its own values."""
        per_axis = []
        for (a, b), d, c, n, k in zip(self.region(index), depth, self.chunks, self.shape, self.count):
            found = []
            for shift in (-n, 0, n) if periodic else (0,):
                for t in range(max(0, (a + shift - d) // c), min(k - 1, (b + shift - 1 + d) // c) + 1):
                    lo, hi = max(t * c - d, a + shift), min(min((t + 1) * c, n) + d, b + shift)
                    if lo < hi:
                        found.append((t, shift, (lo, hi), slice(lo - shift - a, hi - shift - a)))
            per_axis.append(found)
        for parts in itertools.product(*per_axis):
            target = tuple(p[0] for p in parts)
            if target != tuple(index) or any(p[1] for p in parts):
                yield target, [p[2] for p in parts], tuple(p[3] for p in parts)


def _lists(parts: Sequence[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    cut = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(cut, pa.array(np.concatenate([np.zeros(0), *parts]) if parts else [], kind))


def _row(values: pa.ListArray, i: int) -> np.ndarray:
    return values.values.slice(values.offsets[i].as_py(), values.offsets[i + 1].as_py() - values.offsets[i].as_py()).to_numpy(zero_copy_only=False)


def column_function(f: Callable, kind: str) -> Callable[..., Column]:
    """A function from Arrow arrays to one of the same length, as a column."""
    return F.arrow_udf(f, kind)


STRIP = "array<struct<target: array<int>, box: array<int>, values: array<double>>>"


def _emit(grid: Grid, depth: tuple[int, ...], periodic: bool) -> Callable:
    """A column function from the chunk's index and some arrays over it to its strips, the arrays' values one after the other."""
    k = len(grid.shape)

    def strips(*columns: pa.Array) -> pa.Array:
        index = np.stack([c.to_numpy() for c in columns[:k]], 1)
        targets, boxes, values, count = [], [], [], [0]
        for i, at in enumerate(index):
            arrays = [_row(c, i).reshape(grid.size(at)) for c in columns[k:]]
            for target, box, part in grid.strips(at, depth, periodic):
                targets.append(np.array(target))
                boxes.append(np.array(box).ravel())
                values.append(np.concatenate([a[part].ravel() for a in arrays]))
            count.append(len(targets))
        rows = pa.StructArray.from_arrays([_lists(targets, pa.int32()), _lists(boxes, pa.int32()), _lists(values, pa.float64())], ["target", "box", "values"])
        return pa.ListArray.from_arrays(np.array(count, np.int32), rows)

    return strips


def _assembled(grid: Grid, at: Sequence[int], own: list[np.ndarray], strips: pa.ListArray, i: int, depth: tuple[int, ...], periodic: bool) -> tuple[list[np.ndarray], tuple[slice, ...]]:
    """Each array of a chunk with its halo, and where the chunk is in it."""
    halo, inner = grid.halo(at, depth, periodic), grid.region(at)
    out = [np.zeros([b - a for a, b in halo]) for _ in own]
    inside = tuple(slice(a - c, b - c) for (a, b), (c, _) in zip(inner, halo))
    for whole, values in zip(out, own):
        whole[inside] = values
    if strips[i].is_valid:
        fields = strips.values
        boxes, values = fields.field("box"), fields.field("values")
        for j in range(strips.offsets[i].as_py(), strips.offsets[i + 1].as_py()):
            box = _row(boxes, j).reshape(-1, 2)
            part = tuple(slice(a - c, b - c) for (a, b), (c, _) in zip(box, halo))
            for whole, v in zip(out, np.split(_row(values, j), len(own))):
                whole[part] = v.reshape([b - a for a, b in box])
    return out, inside


class _Local(ArrayFrame):
    """A stack of arrays in a task with the methods of array frames that are kernels only."""

    def __init__(self, values: np.ndarray, space: Axes, dtype: str) -> None:
        self.values, self.space, self.shape, self.dtype, self.batch, self.axes, self.name = values, Axes.of(space), values.shape[1:], dtype, Axes(), Axes.of(space), None

    def map(self, kernel, dtype=None, space=None, shape=None):
        return _Local(cast(kernel(self.values), dtype or self.dtype), space or self.space, dtype or self.dtype)


class _Probe(_Local):
    """Tells the type of a method's result without running its kernel."""

    def map(self, kernel, dtype=None, space=None, shape=None):
        return _Probe(self.values, space or self.space, dtype or self.dtype)


def _kernel(name: str, args: tuple, options: dict, space: Axes, dtype: str) -> tuple[Callable[[np.ndarray], np.ndarray], str]:
    """The method of array frames as a kernel on stacks, and the type of its result."""
    from . import operators  # noqa: F401

    if not hasattr(ArrayFrame, name):
        raise AttributeError(f"array frames have no {name!r}")
    try:
        kind = getattr(_Probe(np.zeros((1,) * (len(space) + 1)), space, dtype), name)(*args, **options).dtype
    except AttributeError as error:
        raise TypeError(f"{name!r} is no kernel on one array") from error

    def run(x: np.ndarray) -> np.ndarray:
        from . import operators  # noqa: F401  (in a task: gives frames their methods)

        return getattr(_Local(x, space, dtype), name)(*args, **options).values

    return run, kind


def _typed(x: np.ndarray, dtype: str) -> np.ndarray:
    return x != 0 if dtype == "bool" else x.astype(np.int64) if dtype.startswith(("int", "uint")) else x


class ChunkedFrame:
    def __init__(self, df: DataFrame, batch, space, shape: Sequence[int], chunks: Sequence[int], dtype: str = "float32", dealt: bool = False) -> None:
        """``dealt``: rows are dealt out by the keys already."""
        self.batch, self.space, self.dtype = Axes.of(batch), Axes.of(space), dtype
        self.grid = Grid(tuple(shape), tuple(chunks))
        self.keys = [*self.batch.names, *[f"chunk_{a}" for a in self.space.names]]
        self.df, self._dealt, self._kept = df.select(*self.keys, "data"), dealt, None

    def __repr__(self) -> str:
        return f"ChunkedFrame({self.batch}|{self.space}, {self.grid.shape} in {self.grid.chunks}, {self.dtype})"

    @property
    def shape(self) -> tuple[int, ...]:
        return self.grid.shape

    @property
    def _index(self) -> list[str]:
        return self.keys[len(self.batch) :]

    def _like(self, df: DataFrame, dtype: str | None = None, dealt: bool = False) -> ChunkedFrame:
        return ChunkedFrame(df, self.batch, self.space, self.grid.shape, self.grid.chunks, dtype or self.dtype, dealt)

    def settled(self) -> DataFrame:
        """The chunks computed once, in a table with buckets of their keys."""
        if self._kept is None:
            self._kept = graph.bucketed(self.df, self.keys, self._dealt)
        return self._kept

    # values ------------------------------------------------------------------

    def pixels(self, value: str = "value") -> DataFrame:
        """A row per value with its place in the whole array."""
        df, stride = self.df.select(*self.keys, F.posexplode("data").alias("_i", value)), F.lit(1)
        cols = []
        for a, n, c in reversed(list(zip(self.space.names, self.grid.shape, self.grid.chunks))):
            width = F.least(F.lit(c), n - F.col(f"chunk_{a}") * c)
            cols.append((F.col(f"chunk_{a}") * c + F.call_function("div", F.col("_i"), stride) % width).cast("int").alias(a))
            stride = stride * width
        return df.select(*self.batch.names, *reversed(cols), value)

    def to_frame(self) -> ArrayFrame:
        """Whole arrays again, one row each."""
        k, grid = len(self.batch), self.grid
        grouped = self.df.groupBy(*self.batch.names).agg(F.collect_list(F.struct(F.array(*self._index).alias("at"), "data")).alias("parts"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                parts = b.column(k)
                at, data = parts.values.field("at"), parts.values.field("data")
                for i in range(b.num_rows):
                    out = np.zeros(grid.shape)
                    for j in range(parts.offsets[i].as_py(), parts.offsets[i + 1].as_py()):
                        index = _row(at, j)
                        out[tuple(slice(*r) for r in grid.region(index))] = _row(data, j).reshape(grid.size(index))
                    yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in b.columns[:k]], _lists([out.ravel()], pa.float64())], [*b.schema.names[:k], "data"])

        fields = ", ".join([*[f"{n} {t}" for n, t in self.df.dtypes[:k]], "data array<double>"])
        return ArrayFrame(grouped.mapInArrow(run, fields), self.batch, self.space, grid.shape, self.dtype)

    def to_numpy(self) -> np.ndarray:
        return self.to_frame().to_numpy()

    def map(self, kernel: Callable[[np.ndarray], np.ndarray], dtype: str | None = None) -> ChunkedFrame:
        """A kernel without a halo on each chunk (1, *chunk); no shuffle."""
        return self.map_overlap(kernel, 0, dtype=dtype)

    def _depth(self, depth) -> tuple[int, ...]:
        out = tuple(int(d) for d in np.broadcast_to(depth, len(self.space)))
        if any(d < 0 or d > n for d, n in zip(out, self.grid.shape)):
            raise ValueError(f"a halo of {out} does not fit arrays of {self.grid.shape}")
        return out

    def _met(self, base: DataFrame, arrays: Sequence[str], depth: tuple[int, ...], periodic: bool) -> DataFrame:
        """The chunks with a column ``strips`` of what others give them."""
        emit = column_function(_emit(self.grid, depth, periodic), STRIP)
        sent = base.select(*self.batch.names, F.explode(emit(*self._index, *arrays)).alias("_strip"))
        target = [F.col("_strip.target")[i].alias(c) for i, c in enumerate(self._index)]
        grouped = sent.select(*self.batch.names, *target, "_strip").groupBy(*self.keys).agg(F.collect_list("_strip").alias("strips"))
        return base.join(grouped, self.keys, "left")

    def map_overlap(self, kernel: Callable[[np.ndarray], np.ndarray], depth, boundary: str = "none", dtype: str | None = None) -> ChunkedFrame:
        """A kernel on each chunk with a halo, which is cut off its result.

        At the ends of the array there is no halo (none: the kernel sees the end
        as in a whole array), or it is filled by the boundary: reflect, nearest
        or periodic.  A halo may reach over several chunks.
        """
        if boundary not in BOUNDARIES:
            raise ValueError(f"unknown boundary {boundary!r}")
        depth, grid, k, kind, own, fill, periodic = self._depth(depth), self.grid, len(self.space), dtype or self.dtype, self.dtype, BOUNDARIES[boundary], boundary == "periodic"
        alone = not any(depth)

        def run(*columns: pa.Array) -> pa.Array:
            out = []
            for i, at in enumerate(np.stack([c.to_numpy() for c in columns[:k]], 1)):
                x, inside = [_row(columns[k], i).reshape(grid.size(at))], tuple(slice(0, n) for n in grid.size(at))
                if not alone:
                    x, inside = _assembled(grid, at, x, columns[k + 1], i, depth, periodic)
                x = x[0]
                if fill:
                    missing = [(d - (r[0] - h[0]), d - (h[1] - r[1])) for d, r, h in zip(depth, grid.region(at), grid.halo(at, depth, False))]
                    x = np.pad(x, missing, fill)
                    inside = tuple(slice(s.start + m[0], s.stop + m[0]) for s, m in zip(inside, missing))
                y = cast(kernel(_typed(x, own)[None])[0], kind)
                if y.shape != x.shape:
                    raise AxesError(f"the kernel made {y.shape} of {x.shape}")
                out.append(np.asarray(y[inside], float).ravel())
            return _lists(out, pa.float64())

        f = column_function(run, "array<double>")
        if alone:
            return self._like(self.df.select(*self.keys, f(*self._index, "data").alias("data")), kind, self._dealt)
        met = self._met(self.settled(), ["data"], depth, periodic)
        return self._like(met.select(*self.keys, f(*self._index, "data", "strips").alias("data")), kind, True)

    def apply(self, name: str, *args, depth, boundary: str = "none", **options) -> ChunkedFrame:
        """A method of array frames that is a kernel, by its name: ``apply("gaussian_filter", 2.0, depth=8)`` equals the filter of the whole array if its reach is within the depth."""
        kernel, kind = _kernel(name, args, options, self.space, self.dtype)
        return self.map_overlap(kernel, depth, boundary, kind)

    # slices ----------------------------------------------------------------------

    def isel(self, **keys) -> ChunkedFrame:
        """Places, lists or slices on batch axes; slices without a step on spatial ones, which leave out chunks before any are opened."""
        batch = {k: keys.pop(k) for k in self.batch.names if k in keys}
        out = self
        if batch:
            rows = ArrayFrame(self.df, [*self.batch, *self._index], "#", (1,)).isel(**batch)
            kept = Axes(tuple(a for a in rows.batch if a.name not in self._index))
            out = ChunkedFrame(rows.df, kept, self.space, self.grid.shape, self.grid.chunks, self.dtype)
        region, space = [], []
        for a, n in zip(self.space, self.grid.shape):
            k = keys.pop(a.name, slice(None))
            if not isinstance(k, slice) or k.step not in (None, 1):
                raise AxesError(f"axis {a} of chunks is sliced without a step")
            region.append((start := k.indices(n)[0], max(start, k.indices(n)[1])))
            space.append(a.sliced(k))
        if keys:
            raise AxesError(f"axes {', '.join(keys)} are not among {self.batch}{self.space}")
        if any(b <= a for a, b in region):
            raise AxesError("a slice of chunks holds one place at least")
        return out._recut(region, self.grid.chunks, space) if region != [(0, n) for n in self.grid.shape] else out

    def rechunk(self, chunks: int | Sequence[int]) -> ChunkedFrame:
        """Chunks of another size, by one shuffle of the parts that they share."""
        sizes = tuple(min(int(c), n) for c, n in zip(np.broadcast_to(chunks, len(self.space)), self.grid.shape))
        return self._recut([(0, n) for n in self.grid.shape], sizes, list(self.space))

    def _recut(self, region: list[tuple[int, int]], chunks: Sequence[int], space: list) -> ChunkedFrame:
        old, new, k = self.grid, Grid(tuple(b - a for a, b in region), tuple(min(c, b - a) for c, (a, b) in zip(chunks, region))), len(self.space)
        df = self.df
        for c, size, (a, b) in zip(self._index, old.chunks, region):
            df = df.where((F.col(c) >= a // size) & (F.col(c) <= (b - 1) // size))

        def parts(*columns: pa.Array) -> pa.Array:
            targets, boxes, values, count = [], [], [], [0]
            for i, at in enumerate(np.stack([c.to_numpy() for c in columns[:k]], 1)):
                x = _row(columns[k], i).reshape(old.size(at))
                spans = [(max(a, lo), min(b, hi), lo) for (lo, hi), (a, b) in zip(old.region(at), region)]
                for target in itertools.product(*[range((s - a) // c, -(-(e - a) // c)) for (s, e, _), (a, _), c in zip(spans, region, new.chunks)]):
                    box = [(max(s - a, t * c), min(e - a, (t + 1) * c)) for (s, e, _), (a, _), c, t in zip(spans, region, new.chunks, target)]
                    targets.append(np.array(target))
                    boxes.append(np.array(box).ravel())
                    values.append(x[tuple(slice(p + a - lo, q + a - lo) for (p, q), (a, _), (_, _, lo) in zip(box, region, spans))].ravel())
                count.append(len(targets))
            rows = pa.StructArray.from_arrays([_lists(targets, pa.int32()), _lists(boxes, pa.int32()), _lists(values, pa.float64())], ["target", "box", "values"])
            return pa.ListArray.from_arrays(np.array(count, np.int32), rows)

        def put(*columns: pa.Array) -> pa.Array:
            out, fields = [], columns[k].values
            boxes, values = fields.field("box"), fields.field("values")
            for i, at in enumerate(np.stack([c.to_numpy() for c in columns[:k]], 1)):
                x, base = np.zeros(new.size(at)), [a for a, _ in new.region(at)]
                for j in range(columns[k].offsets[i].as_py(), columns[k].offsets[i + 1].as_py()):
                    part = tuple(slice(a - c, b - c) for (a, b), c in zip(_row(boxes, j).reshape(-1, 2), base))
                    x[part] = _row(values, j).reshape([s.stop - s.start for s in part])
                out.append(x.ravel())
            return _lists(out, pa.float64())

        sent = df.select(*self.batch.names, F.explode(column_function(parts, STRIP)(*self._index, "data")).alias("_part"))
        target = [F.col("_part.target")[i].alias(c) for i, c in enumerate(self._index)]
        met = sent.select(*self.batch.names, *target, "_part")
        aligned = new.chunks == old.chunks and all(a % c == 0 for (a, _), c in zip(region, old.chunks))
        if aligned:  # every part is a chunk of its own
            out = met.select(*self.keys, F.col("_part.values").alias("data"))
        else:
            grouped = met.groupBy(*self.keys).agg(F.collect_list("_part").alias("_parts"))
            out = grouped.select(*self.keys, column_function(put, "array<double>")(*self._index, "_parts").alias("data"))
        return ChunkedFrame(out, self.batch, space, new.shape, new.chunks, self.dtype)

    # whole arrays ---------------------------------------------------------------

    def _to_chunks(self, table: DataFrame) -> DataFrame:
        """Rows of a table by batch repeated under the keys of all chunks: small rows travel instead of chunks."""
        for a, n in zip(self.space.names, self.grid.count):
            table = table.withColumn(f"chunk_{a}", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return table

    def reduce(self, how: str) -> DataFrame:
        """batch and value: mean, sum, min, max, count, var or std of each whole array, from sums of its chunks."""
        v = F.col("data")
        n, total = F.size(v).cast("double"), F.aggregate(v, F.lit(0.0), lambda a, x: a + x)
        if how in ("var", "std"):  # about the chunks' own means, so that large values lose nothing

            def about_mean(data: pa.Array) -> pa.Array:
                rows = (_row(data, i) for i in range(len(data)))
                return pa.array([float(((x - x.mean()) ** 2).sum()) if len(x) else 0.0 for x in rows], pa.float64())

            part = self.df.select(*self.batch.names, n.alias("n"), total.alias("s"), column_function(about_mean, "double")("data").alias("m2"))
            # three numbers a chunk, in an order of their own so that sums do not depend on how rows are dealt out
            whole = part.groupBy(*self.batch.names).agg(F.sum("n").alias("_n"), F.sort_array(F.collect_list(F.struct("n", "s", "m2"))).alias("_parts"))
            whole = whole.withColumn("_mean", F.aggregate("_parts", F.lit(0.0), lambda a, c: a + c["s"]) / F.col("_n"))
            value = F.aggregate("_parts", F.lit(0.0), lambda a, c: a + c["m2"] + c["n"] * F.pow(c["s"] / c["n"] - F.col("_mean"), 2)) / F.col("_n")
            return whole.select(*self.batch.names, (value if how == "var" else F.sqrt(value)).alias("value"))
        part = self.df.select(*self.batch.names, n.alias("_n"), total.alias("_s"), F.array_min(v).alias("_lo"), F.array_max(v).alias("_hi"), F.size(F.filter(v, lambda x: x != 0)).cast("double").alias("_nz"))
        value = {"mean": F.sum("_s") / F.sum("_n"), "sum": F.sum("_s"), "min": F.min("_lo"), "max": F.max("_hi"), "count": F.sum("_nz"), "ptp": F.max("_hi") - F.min("_lo")}[how]
        return part.groupBy(*self.batch.names).agg(value.alias("value"))

    def levels(self, how: str = "otsu") -> DataFrame:
        """batch and level: the threshold of each whole array by a histogram method, 'mean' or 'p%'."""
        batch = self.batch.names
        if how == "mean":
            return self.reduce("mean").withColumnRenamed("value", "level")
        if how.endswith("%"):
            return self.pixels().groupBy(*batch).agg(F.percentile("value", F.lit(float(how[:-1]) / 100)).alias("level"))
        if how not in objects.OF_HISTOGRAM:
            raise ValueError(f"no threshold {how!r} over chunks")
        whole, base = self.dtype.startswith(("int", "uint", "bool")), self.settled()
        limits = base.select(*batch, F.array_min("data").alias("_lo"), F.array_max("data").alias("_hi")).groupBy(*batch).agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))

        def counted(data: pa.Array, lo: pa.Array, hi: pa.Array) -> pa.Array:
            lo, hi, out = lo.to_numpy(), hi.to_numpy(), []
            for i in range(len(lo)):
                x = _row(data, i)
                out.append(np.bincount(x.astype(np.int64) - int(lo[i]), minlength=int(hi[i] - lo[i]) + 1) if whole else np.histogram(x, 256, (lo[i], hi[i]))[0])
            return _lists(out, pa.float64())

        counts = base.join(self._to_chunks(limits), self.keys).select(*batch, "_lo", "_hi", F.posexplode(column_function(counted, "array<double>")("data", "_lo", "_hi")).alias("bin", "_n"))
        bins = counts.where("_n > 0").groupBy(*batch, "_lo", "_hi", "bin").agg(F.sum("_n").alias("_n"))
        rows = bins.groupBy(*batch, "_lo", "_hi").agg(F.collect_list(F.struct("bin", "_n")).alias("bins"))  # one row per bin that has values

        def level(lo: pa.Array, hi: pa.Array, bins: pa.Array) -> pa.Array:
            out = []
            for a, b, found in zip(lo.to_pylist(), hi.to_pylist(), bins.to_pylist()):
                edges = np.histogram_bin_edges(np.zeros(0), 256, (a, b))
                centers = np.arange(int(b - a) + 1) + int(a) if whole else (edges[1:] + edges[:-1]) / 2
                n = np.zeros(len(centers))
                for f in found:
                    n[f["bin"]] = f["_n"]
                out.append(objects.OF_HISTOGRAM[how](n, centers))
            return pa.array(out, pa.float64())

        return rows.select(*batch, column_function(level, "double")("_lo", "_hi", "bins").alias("level"))

    def threshold(self, how: float | str = "otsu") -> ChunkedFrame:
        """True from the threshold on: a number, or one for each whole array (``levels``)."""
        if not isinstance(how, str):
            return self._like(self.df.withColumn("data", F.transform("data", lambda v: (v >= F.lit(float(how))).cast("double"))), "bool", self._dealt)
        met = self.settled().join(self._to_chunks(self.levels(how)), self.keys)
        return self._like(met.select(*self.keys, F.transform("data", lambda v: (v >= F.col("level")).cast("double")).alias("data")), "bool", True)

    def label(self, connectivity: int | None = None) -> ChunkedFrame:
        """Components of equal non-zero neighbours of each whole array, numbered by their first places as in a whole array.

        Chunks are labelled apart.  Their borders go to the next chunks, which tell
        what labels are one across the seam; components of these equalities join
        the labels.  Only borders and labels are shuffled.
        """
        grid, k, index, batch = self.grid, len(self.space), self._index, self.batch.names
        volume, place = math.prod(grid.chunks) + 1, F.lit(0).cast("long")
        for a, n in zip(index, grid.count):
            place = place * n + F.col(a)
        stride = np.cumprod([1, *grid.shape[:0:-1]])[::-1]

        def local(*columns: pa.Array) -> pa.Array:
            out = []
            for i, at in enumerate(np.stack([c.to_numpy() for c in columns[:k]], 1)):
                lab = objects.label(_row(columns[k], i).reshape(1, *grid.size(at)), connectivity)[0]
                base = int(np.ravel_multi_index(tuple(at), grid.count)) * volume
                out.append(np.where(lab > 0, lab + base, 0).ravel())
            return _lists(out, pa.float64())

        def first(*columns: pa.Array) -> pa.Array:
            """The least place in the whole array of each label of the chunk."""
            out = []
            for i, at in enumerate(np.stack([c.to_numpy() for c in columns[:k]], 1)):
                lab = _row(columns[k], i)
                own = np.indices(grid.size(at)).reshape(k, -1)
                whole = sum((o + r[0]) * s for o, r, s in zip(own, grid.region(at), stride))
                ids, at_first = np.unique(lab, return_index=True)
                out.append(whole[at_first[ids > 0]])
            return _lists(out, pa.int64())

        near = objects.neighbours(k, connectivity)
        steps = [tuple(int(d) - 1 for d in s) for s in np.argwhere(near) if any(d != 1 for d in s)]

        def seams(*columns: pa.Array) -> pa.Array:
            """Pairs of labels on both sides of the chunk's ends."""
            pairs = []
            for i, at in enumerate(np.stack([c.to_numpy() for c in columns[:k]], 1)):
                own = [_row(c, i).reshape(grid.size(at)) for c in columns[k : k + 2]]
                (value, lab), inside = _assembled(grid, at, own, columns[k + 2], i, (1,) * k, False)
                value, lab = (np.pad(v, 1) for v in (value, lab))
                mine = tuple(slice(s.start + 1, s.stop + 1) for s in inside)
                own_base = int(np.ravel_multi_index(tuple(at), grid.count)) * volume
                found = []
                for step in steps:
                    other = tuple(slice(s.start + d, s.stop + d) for s, d in zip(mine, step))
                    same = (value[mine] == value[other]) & (lab[mine] > 0) & (lab[other] > 0) & (lab[other] < own_base)
                    found.append(np.stack([lab[mine][same], lab[other][same]], 1))
                pairs.append(np.unique(np.concatenate(found), axis=0).ravel())
            return _lists(pairs, pa.int64())

        base = graph.bucketed(self.settled().withColumn("lab", column_function(local, "array<double>")(*index, "data")), self.keys, True)
        met = self._met(base, ["data", "lab"], (1,) * k, False)
        flat = met.select(*batch, column_function(seams, "array<bigint>")(*index, "data", "lab", "strips").alias("_pairs"))
        edges = flat.select(*batch, F.posexplode("_pairs").alias("_at", "_a"), "_pairs").where("_at % 2 = 0").select(*batch, "_a", F.get("_pairs", F.col("_at") + 1).alias("_b"))
        joined = graph.components(edges, batch, "_a", "_b")
        known = base.select(*self.keys, F.posexplode(column_function(first, "array<bigint>")(*index, "lab")).alias("_at", "first"))
        known = graph.settled(known.withColumn("node", place * volume + F.col("_at") + 1).join(joined, [*batch, "node"], "left").withColumn("root", F.coalesce("root", "node")))
        roots = graph.ranked(known.groupBy(*batch, "root").agg(F.min("first").alias("first")), batch, "first", "number").drop("first")
        numbers = known.join(roots, [*batch, "root"]).groupBy(*self.keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("_at", "number"))), lambda s: s["number"]).alias("numbers"))

        def renamed(lab: pa.Array, numbers: pa.Array) -> pa.Array:
            out = []
            for i in range(len(lab)):
                x = _row(lab, i)
                ids, at = np.unique(x, return_inverse=True)
                new = np.zeros(len(ids))
                if (ids > 0).any():
                    new[ids > 0] = _row(numbers, i)
                out.append(new[at])
            return _lists(out, pa.float64())

        done = base.join(numbers, self.keys, "left").select(*self.keys, column_function(renamed, "array<double>")("lab", "numbers").alias("data"))
        return self._like(done, "int64", True)


@method
def rechunk(self: ArrayFrame, chunks: int | Sequence[int] = 1024) -> ChunkedFrame:
    """Chunks of whole rows, cut in the tasks that read them."""
    sizes = [min(int(c), n) or 1 for c, n in zip(np.broadcast_to(chunks, len(self.space)), self.shape)]
    if min(sizes, default=1) < 1:
        raise ValueError("a chunk has one place at least")
    grid, k = Grid(self.shape, tuple(sizes)), len(self.batch)
    indices = list(np.ndindex(grid.count))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = _row(b.column(k), i).reshape(grid.shape)
                keys = [pa.array(c, pa.int32()) for c in np.array(indices).T]
                parts = [x[tuple(slice(*r) for r in grid.region(at))].ravel() for at in indices]
                own = [c.take(pa.array([i] * len(indices))) for c in b.columns[:k]]
                yield pa.RecordBatch.from_arrays([*own, *keys, _lists(parts, pa.float64())], [*b.schema.names[:k], *[f"chunk_{a}" for a in space], "data"])

    space = self.space.names
    fields = ", ".join([*[f"{n} {t}" for n, t in self.df.dtypes[:k]], *[f"chunk_{a} int" for a in space], "data array<double>"])
    return ChunkedFrame(self.df.mapInArrow(run, fields), self.batch, self.space, self.shape, sizes, self.dtype)


class Tiled:
    """Methods of a frame that are kernels, tile by tile with an overlap."""

    def __init__(self, frame: ArrayFrame | ChunkedFrame, chunks, overlap, boundary: str) -> None:
        self.frame, self.chunks, self.overlap, self.boundary = frame, chunks, overlap, boundary

    def __getattr__(self, name: str):
        if name.startswith("_"):
            raise AttributeError(name)
        frame = self.frame

        def run(*args, **options):
            if isinstance(frame, ChunkedFrame):
                return frame.apply(name, *args, depth=self.overlap, boundary=self.boundary, **options)
            kernel, kind = _kernel(name, args, options, frame.space, frame.dtype)
            grid = Grid(frame.shape, tuple(min(int(c), n) for c, n in zip(np.broadcast_to(self.chunks, len(frame.space)), frame.shape)))
            depth = tuple(int(d) for d in np.broadcast_to(self.overlap, len(frame.space)))
            mode = {"periodic": "wrap"}.get(self.boundary, BOUNDARIES[self.boundary])

            def tiles(x: np.ndarray) -> np.ndarray:
                out = np.zeros(x.shape)
                wide = np.pad(x, [(0, 0), *[(d, d) for d in depth]], mode) if mode else x
                for at in np.ndindex(grid.count):
                    inner, halo = grid.region(at), grid.halo(at, depth, bool(mode))
                    move = depth if mode else (0,) * len(depth)
                    part = wide[(slice(None), *(slice(a + m, b + m) for (a, b), m in zip(halo, move)))]
                    cut = (slice(None), *(slice(a - c, b - c) for (a, b), (c, _) in zip(inner, halo)))
                    out[(slice(None), *(slice(*r) for r in inner))] = kernel(part)[cut]
                return out

            return frame.map(tiles, kind)

        return run


@method
def tiled(self: ArrayFrame, chunks: int | Sequence[int] = 1024, overlap: int | Sequence[int] = 32, boundary: str = "reflect") -> Tiled:
    """Filters tile by tile: ``frame.tiled((40, 50, 50)).lowpass_filter(0.2)``. Rows hold whole arrays here, so nothing is shuffled; the boundary is none, reflect, nearest or periodic."""
    if boundary not in BOUNDARIES:
        raise ValueError(f"unknown boundary {boundary!r}")
    return Tiled(self, chunks, overlap, boundary)


def _tiled(self: ChunkedFrame, overlap: int | Sequence[int] = 32, boundary: str = "reflect") -> Tiled:
    return Tiled(self, self.grid.chunks, overlap, boundary)


ChunkedFrame.tiled = _tiled
