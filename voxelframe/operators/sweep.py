"""One method with several parameters, assignment to parts, contractions, and mergeable summaries."""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..axes import Axes, AxesError, Axis, Slicer, parse
from ..chunks import _kernel
from ..frame import _LIMITS, DATA, ArrayFrame, _column, _stack, cast
from .image import method

# parameters ---------------------------------------------------------------------


def _by_place(frame: ArrayFrame, axis: str, kernels: Sequence[tuple[Callable, str]]) -> ArrayFrame:
    """Kernel k on the arrays at place k of a batch axis: one call for each place in an Arrow batch."""
    kind = {k for _, k in kernels}
    if len(kind) != 1:
        raise ValueError(f"results have different types: {', '.join(sorted(kind))}")
    kind, n, own, size, at = kind.pop(), len(frame.batch), frame.dtype, frame.shape, frame.batch.find(axis)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            place = b.column(at).to_numpy()
            for k in np.unique(place):
                some = b.take(pa.array(np.flatnonzero(place == k)))
                y = cast(kernels[int(k)][0](_stack(some, n, size, own)), kind)
                if y.shape[1:] != size:
                    raise AxesError(f"the method changes the shape {size} to {y.shape[1:]}")
                yield pa.RecordBatch.from_arrays([*some.columns[:n], _column(y)], b.schema.names)

    return frame._with(frame.df.mapInArrow(run, frame._schema("data array<double>")), dtype=kind)


@method
def for_params(self: ArrayFrame, name: str, var: Mapping[str, Sequence] | None = None, *, axis: str = "v", **options) -> ArrayFrame:
    """A method with every value of one parameter: ``for_params("log_filter", sigma=[1, 2, 3])``.

    Results stand along a new first axis whose labels are the values, in their
    order.  Rows are repeated where they are; nothing is shuffled.
    """
    if var is None:
        if len(options) != 1:
            raise ValueError("one parameter varies: name it by var if others are fixed")
        var, options = options, {}
    (key, values), *more = var.items()
    if more or key in options:
        raise ValueError("one parameter varies, and it is not fixed as well")
    values = list(values)
    if axis in self.axes:
        raise AxesError(f"axis {axis} is there already")
    kernels = [_kernel(name, (), {**options, key: v}, self.space, self.dtype) for v in values]
    if not kernels:
        raise ValueError("no values to try")
    df = self.df.withColumn(axis, F.explode(F.sequence(F.lit(0), F.lit(len(values) - 1))))
    batch = [Axis(axis, labels=tuple(values)), *self.batch]
    return _by_place(ArrayFrame(df, batch, self.space, self.shape, self.dtype, self.name, {**self.known, axis: len(values)}), axis, kernels)


@method
def for_each_channel(self: ArrayFrame, name: str, along: str = "c", **options) -> ArrayFrame:
    """A method with parameters of each channel's own: lists hold one for each place of the axis, anything else holds for all."""
    if along not in self.batch:
        raise AxesError(f"{along} is not among the batch axes {self.batch}")
    n = self._size(self.batch[along])
    for k, v in options.items():
        if isinstance(v, (list, tuple)) and len(v) != n:
            raise ValueError(f"{k} has {len(v)} values for {n} places of axis {along}")
    kernels = [_kernel(name, (), {k: v[i] if isinstance(v, (list, tuple)) else v for k, v in options.items()}, self.space, self.dtype) for i in range(n)]
    return _by_place(self, along, kernels) if n else self


# assignment ------------------------------------------------------------------------


def _stored(v: Column, dtype: str) -> Column:
    """A value as the type holds it: unsigned ones rounded and limited."""
    if dtype in _LIMITS:
        return F.floor(F.least(F.greatest(v.cast("double") + 0.5, F.lit(0.0)), F.lit(float(_LIMITS[dtype])))).cast("double")
    return (v != 0).cast("double") if dtype == "bool" else v.cast("double")


def _taken(c: Column, k, n: int | None) -> tuple[Column, Column | None]:
    """Whether a place is among those of a key, and which of them it is (None for a single one)."""
    if isinstance(k, slice):
        start, stop, step = k.indices(n) if n is not None else (k.start or 0, k.stop, k.step or 1)
        if n is None and (start < 0 or step < 0 or (stop or 0) < 0):
            raise AxesError("the size of an axis sliced from its end must be known")
        low, high = (start, stop) if step > 0 else (None if stop is None else stop + 1, start + 1)
        inside = (F.lit(True) if low is None else c >= low) & (F.lit(True) if high is None else c < high) & ((c - start) % step == 0)
        return inside, F.call_function("div", c - start, F.lit(step)).cast("int")
    if isinstance(k, (list, tuple, range)):
        places = F.array(*[F.lit(int(i) % n if n else int(i)) for i in k])
        return F.array_contains(places, c.cast("int")), F.array_position(places, c.cast("int")).cast("int") - 1
    if n is not None and not -n <= int(k) < n:
        raise IndexError(f"index {k} is outside of an axis with size {n}")
    return c == (int(k) % n if n else int(k)), None


@method
def assign(self: ArrayFrame, key, value) -> ArrayFrame:
    """The frame with other values at a key: a slice as in ``frame[key]``, or a mask.

    The value is a number, or a frame over the axes that the key leaves (with
    all of them, or fewer batch axes), whose values are looked up by place.
    Arrays that the value lacks stay as they are.  Nothing is exploded.
    """
    if isinstance(key, ArrayFrame):
        if key.space.names != self.space.names or key.shape != self.shape:
            raise AxesError(f"mask {key!r} does not fit {self!r}")
        df = self._joined(key).withColumnRenamed("_other", "_mask")
        if not isinstance(value, ArrayFrame):
            new = F.zip_with(DATA, "_mask", lambda v, m: F.when(m != 0, _stored(F.lit(value), self.dtype)).otherwise(v))
            return self._with(df.withColumn(DATA, new))
        if value.space.names != self.space.names or value.shape != self.shape:
            raise AxesError(f"{value!r} does not fit {self!r}")
        inner = ArrayFrame(df.withColumn(DATA, F.arrays_zip(DATA, "_mask")), self.batch, self.space, self.shape, self.dtype)
        both = inner._joined(value)
        new = F.zip_with(DATA, "_other", lambda p, o: F.when(p["_mask"] != 0, _stored(o, self.dtype)).otherwise(p[DATA]))
        return self._with(both.select(*self.batch.names, new.alias(DATA)))
    if isinstance(key, Slicer):
        key = key.keys
    if isinstance(key, str):
        key = parse(key, self.sizes(key))
    keys = dict(key)
    if gone := [a for a in keys if a not in self.axes]:
        raise AxesError(f"axes {', '.join(gone)} are not among {self.axes}")
    df, here, left = self.df, F.lit(True), []
    for axis in self.batch:
        k = keys.get(axis.name, slice(None))
        known = self.known.get(axis.name) or (len(axis.labels) or None)
        inside, at = _taken(F.col(axis.name), k, known)
        here = here & inside
        if at is not None:
            left.append((axis.name, at))
    stride, conditions, places, shape, names = math.prod(self.shape), [], [], [], []
    for axis, n in zip(self.space, self.shape):
        stride //= n
        k = keys.get(axis.name, slice(None))
        whole = k == slice(None)
        place = lambda i, stride=stride, n=n: F.call_function("div", i, F.lit(stride)) % n
        if not whole:
            conditions.append(lambda i, place=place, k=k, n=n: _taken(place(i), k, n)[0])
        if isinstance(k, (slice, list, tuple, range)):
            count = len(range(n)[k]) if isinstance(k, slice) else len(k)
            places.append((lambda i, place=place, k=k, n=n, whole=whole: place(i) if whole else _taken(place(i), k, n)[1], count))
            shape.append(count)
            names.append(axis.name)
    inside = lambda i: _all([c(i) for c in conditions])
    if not isinstance(value, ArrayFrame):
        new = F.transform(DATA, lambda v, i: F.when(inside(i), _stored(F.lit(value), self.dtype)).otherwise(v))
        return self._with(df.withColumn(DATA, F.when(here, new).otherwise(F.col(DATA))))
    if value.space.names != names or list(value.shape) != shape:
        raise AxesError(f"{value!r} does not fit what the key leaves: {''.join(names)} {tuple(shape)}")
    columns = dict(left)
    if lacking := [b for b in value.batch.names if b not in columns]:
        raise AxesError(f"axes {', '.join(lacking)} of the value are not among those that the key leaves")
    its = value.df.select(*[F.col(b).alias(f"_at_{b}") for b in value.batch.names], F.col(DATA).alias("_other"))
    df = df.withColumn("_here", here)
    for b in value.batch.names:
        df = df.withColumn(f"_at_{b}", F.when(F.col("_here"), columns[b]))
    on = [f"_at_{b}" for b in value.batch.names]
    df = df.join(its, on, "left") if on else df.join(its.withColumn("_one", F.lit(1)), F.lit(1) == F.col("_one"), "left")

    def looked_up(v: Column, i: Column) -> Column:
        index = F.lit(0)
        for f, count in places:
            index = index * count + f(i)
        return F.when(inside(i), _stored(F.get(F.col("_other"), index.cast("int")), self.dtype)).otherwise(v)

    new = F.when(F.col("_here") & F.col("_other").isNotNull(), F.transform(DATA, looked_up)).otherwise(F.col(DATA))
    return self._with(df.select(*self.batch.names, new.alias(DATA)))


def _all(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def _set_item(self: ArrayFrame, key, value) -> None:
    """``frame[key] = value``: the frame stands for the assigned rows from now on; frames made of it before do not change."""
    self.df = self.assign(key, value).df


ArrayFrame.__setitem__ = _set_item

# contractions -------------------------------------------------------------------------


@method
def tensordot(self: ArrayFrame, other: ArrayFrame, axes: str) -> ArrayFrame:
    """Sums of products over axes that both have; the other axes of both stay, and must differ.

    Rows are joined by the batch axes that go; a task multiplies their arrays and adds up what
    belongs to one result before anything is shuffled.
    """
    for a in axes:
        if (a in self.batch) != (a in other.batch) or a not in self.axes or a not in other.axes:
            raise AxesError(f"axis {a} must be a batch axis of both or a spatial axis of both")
    joined = [a for a in axes if a in self.batch]
    inner = [a for a in axes if a in self.space]
    if [self.shape[self.space.find(a)] for a in inner] != [other.shape[other.space.find(a)] for a in inner]:
        raise AxesError(f"sizes of {''.join(inner)} differ")
    mine, its = self.batch.drop(list(axes)), other.batch.drop(list(axes))
    space = Axes((*self.space.drop(inner), *other.space.drop(inner)))
    if len({*mine.names, *its.names, *space.names}) < len(mine) + len(its) + len(space):
        raise AxesError(f"axes that stay must differ: {mine}{its}{space}")
    shape = [n for a, n in zip(self.space.names, self.shape) if a not in inner] + [n for a, n in zip(other.space.names, other.shape) if a not in inner]
    right = other.df.withColumnRenamed(DATA, "_other")
    df = self.df.join(right, joined) if joined else self.df.crossJoin(right)
    keys = [*mine.names, *its.names]
    df = df.select(*keys, DATA, "_other")
    k, sizes, over = len(keys), (self.shape, other.shape), ([self.space.find(a) for a in inner], [other.space.find(a) for a in inner])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, np.ndarray] = {}

        def out() -> pa.RecordBatch:
            rows = list(sums)
            columns = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([*columns, _column(np.stack(list(sums.values())))], [*keys, DATA])

        kinds: list = []
        for b in batches:
            kinds = [c.type for c in b.columns[:k]]
            x, y = _stack(b, k, sizes[0], "float64"), _stack(b, k + 1, sizes[1], "float64")
            for i, at in enumerate(zip(*[c.to_pylist() for c in b.columns[:k]]) if k else [()] * b.num_rows):
                part = np.tensordot(x[i], y[i], over).reshape(-1)
                sums[at] = sums[at] + part if at in sums else part
            if sum(v.size for v in sums.values()) > 1 << 22:
                yield out()
                sums.clear()
        if sums:
            yield out()

    fields = ", ".join([*[f"{n} {t}" for n, t in df.dtypes[:k]], "data array<double>"])
    parts = df.mapInArrow(run, fields).groupBy(*keys).agg(F.collect_list(DATA).alias("_parts"))  # a few from each task
    total = F.reduce(F.slice("_parts", 2, F.greatest(F.size("_parts") - 1, F.lit(0))), F.col("_parts")[0], lambda a, b: F.zip_with(a, b, lambda p, q: p + q))
    return ArrayFrame(parts.where(F.size("_parts") > 0).select(*keys, total.alias(DATA)), Axes((*mine, *its)), space, shape, "float64")


@method
def corrcoef(self: ArrayFrame, along: str = "c") -> DataFrame:
    """Pearson correlations between the arrays at all places of an axis: batch coordinates, ``<axis>``, ``<axis>_2`` and value, for ordered pairs of different places; null where an array is constant."""
    if along in self.space:
        order = [self.space.find(along), *[i for i, a in enumerate(self.space.names) if a != along]]
        n = self.shape[order[0]]

        def pairs(x: np.ndarray) -> dict:
            flat = x.transpose(0, *[i + 1 for i in order]).reshape(len(x), n, -1)
            flat = flat - flat.mean(axis=2, keepdims=True)
            gram = flat @ flat.transpose(0, 2, 1)
            size = np.sqrt(np.einsum("ijj->ij", gram))
            i, j = map(np.array, zip(*itertools.permutations(range(n), 2))) if n > 1 else (np.zeros(0, int), np.zeros(0, int))
            with np.errstate(divide="ignore", invalid="ignore"):
                value = gram[:, i, j] / (size[:, i] * size[:, j])
            rows = np.repeat(np.arange(len(x)), len(i))
            return {"row": rows, along: np.tile(i, len(x)), f"{along}_2": np.tile(j, len(x)), "value": [None if v != v else v for v in value.ravel().tolist()]}

        return self.table(pairs, f"{along} int, {along}_2 int, value double")
    rest = [b for b in self.batch.names if b != along]
    mean = F.aggregate(DATA, F.lit(0.0), lambda a, v: a + v) / F.size(DATA)
    rows = self.df.withColumn("_mean", mean).select(*rest, along, F.transform(DATA, lambda v: v - F.col("_mean")).alias("_x"))
    rows = rows.withColumn("_size", F.sqrt(F.aggregate("_x", F.lit(0.0), lambda a, v: a + v * v)))
    right = rows.select(*rest, F.col(along).alias(f"{along}_2"), F.col("_x").alias("_y"), F.col("_size").alias("_size_2"))
    joined = rows.join(right, rest) if rest else rows.crossJoin(right)
    product = F.aggregate(F.zip_with("_x", "_y", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    value = product / F.nullif(F.col("_size") * F.col("_size_2"), F.lit(0.0))
    return joined.where(F.col(along) != F.col(f"{along}_2")).select(*rest, along, f"{along}_2", value.alias("value"))


# mergeable summaries ---------------------------------------------------------------------


@method
def sketches(self: ArrayFrame, precision: int = 12, k: int = 200) -> DataFrame:
    """A row for each array: n, a sketch of distinct values (``distinct``) and one of quantiles (``quantiles``), which can be kept and merged over any axes."""
    px = self.df.select(*self.batch.names, F.explode(DATA).alias("_v"))
    grouped = px.groupBy(*self.batch.names)
    return grouped.agg(F.count("*").alias("n"), F.hll_sketch_agg(F.col("_v").cast("string"), precision).alias("distinct"), F.kll_sketch_agg_double("_v", k).alias("quantiles"))


def merged(sketches: DataFrame, over: str) -> DataFrame:
    """Sketches over all places of the named axes."""
    keys = [c for c in sketches.columns if c not in ("n", "distinct", "quantiles", *over)]
    return sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.hll_union_agg("distinct", True).alias("distinct"), F.kll_merge_agg_double("quantiles").alias("quantiles"))


def estimated(sketches: DataFrame, quantiles: Sequence[float] = (0.5,)) -> DataFrame:
    """n, n_distinct and a column q<percent> for each quantile; at 12 bits distinct counts are within some 3 %, with k of 200 ranks within some 1.5 %."""
    keys = [c for c in sketches.columns if c not in ("n", "distinct", "quantiles")]
    wanted = [F.kll_sketch_get_quantile_double("quantiles", F.lit(float(q))).alias(f"q{q * 100:g}") for q in quantiles]
    return sketches.select(*keys, "n", F.hll_sketch_estimate("distinct").alias("n_distinct"), *wanted)
