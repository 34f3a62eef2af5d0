"""Labelled arrays as DataFrames: one row per array of the batch axes.

An ``ArrayFrame`` has a column for each batch axis and an array column
``data`` with the values over the spatial axes in row-major order.  Kernels
that need whole arrays run on stacks of rows through Arrow, without a shuffle;
anything over batch axes is a relational operation on coordinates.
"""

from __future__ import annotations

import functools
import math
import warnings
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .axes import Axes, AxesError, Axis, Slicer, parse, spatial

DATA = "data"
_LIMITS = {"uint8": 255, "uint16": 65535, "uint32": 2**32 - 1}


def cast(x: np.ndarray, dtype: str) -> np.ndarray:
    """Values of a type: unsigned ones are rounded by adding a half, limited, and cut."""
    if dtype in _LIMITS:
        return np.floor(np.clip(np.asarray(x, float) + 0.5, 0, _LIMITS[dtype] + 0.5))
    if dtype == "bool":
        return np.asarray(x, bool)
    return np.asarray(x, float)


#: Values of the arrays that a kernel gets at once, if one array has not more.
VALUES = 1 << 17


def _few(batches: Iterator[pa.RecordBatch], *shapes: Sequence[int]) -> Iterator[pa.RecordBatch]:
    """The rows in parts of at most VALUES values, so that what a kernel makes of a stack does not grow with a batch."""
    step = max(1, VALUES // max(1, *(math.prod(s) for s in shapes)))
    for b in batches:
        for i in range(0, b.num_rows, step):
            yield b.slice(i, step)


def _stack(batch: pa.RecordBatch, index: int, shape: Sequence[int], dtype: str) -> np.ndarray:
    values = batch.column(index)
    flat = values.flatten().to_numpy(zero_copy_only=False)
    n = batch.num_rows
    if len(flat) != n * math.prod(shape):
        raise ValueError(f"an array does not have {math.prod(shape)} values")
    x = flat.reshape(n, *shape)
    return x != 0 if dtype == "bool" else x.astype(np.int64) if dtype.startswith(("int", "uint")) else x.astype(float)


def _column(x: np.ndarray) -> pa.Array:
    flat = np.ascontiguousarray(x, dtype=np.float64).reshape(len(x), -1)
    return pa.ListArray.from_arrays(np.arange(0, flat.size + 1, flat.shape[1] if flat.shape[1] else 1, dtype=np.int32)[: len(x) + 1] if flat.shape[1] else np.zeros(len(x) + 1, np.int32), flat.ravel())


class ArrayFrame:
    def __init__(self, df: DataFrame, batch: str | Axes, space: str | Axes, shape: Sequence[int], dtype: str = "float32", name: str | None = None, known: Mapping[str, int] | None = None) -> None:
        """known: sizes of batch axes, where they are known without counting rows; indices outside of them are errors."""
        self.batch, self.space, self.shape, self.dtype, self.name = Axes.of(batch), Axes.of(space), tuple(int(n) for n in shape), dtype, name
        if len(self.space) != len(self.shape):
            raise AxesError(f"axes {self.space} do not fit the shape {self.shape}")
        self.axes = Axes((*self.batch, *self.space))
        self.known = {a: n for a, n in (known or {}).items() if a in self.batch}
        self.df = df.select(*self.batch.names, DATA)

    def __repr__(self) -> str:
        return f"ArrayFrame({self.batch}|{self.space}, {self.shape}, {self.dtype})"

    # layouts -----------------------------------------------------------------

    @classmethod
    def from_numpy(cls, spark: SparkSession, array: np.ndarray, axes: str | None = None, space: str | None = None, dtype: str | None = None) -> ArrayFrame:
        """axes: of all dimensions; space: those kept together (default: zyx among them)."""
        array = np.asarray(array)
        axes_ = Axes.of(axes) if axes is not None else Axes.default(array.ndim)
        if len(axes_) != array.ndim:
            raise AxesError(f"axes {axes_} do not fit {array.ndim} dimensions")
        space = space or "".join(a for a in axes_.names if a in "zyx") or axes_.names[-1]
        order = [i for i, a in enumerate(axes_.names) if a not in space] + [axes_.find(a) for a in space]
        array = array.transpose(order)
        k = array.ndim - len(space)
        batch = [axes_.names[i] for i in order[:k]]
        rows = [(*map(int, at), array[at].astype(float).ravel().tolist()) for at in np.ndindex(array.shape[:k])]
        schema = T.StructType([*(T.StructField(b, T.IntegerType(), False) for b in batch), T.StructField(DATA, T.ArrayType(T.DoubleType(), False), False)])
        kind = dtype or {"b": "bool", "u": str(array.dtype), "i": "int64"}.get(array.dtype.kind, "float32")
        return cls(spark.createDataFrame(rows, schema), [axes_[b] for b in batch], [axes_[a] for a in space], array.shape[k:], kind, known=dict(zip(batch, array.shape)))

    def to_numpy(self) -> np.ndarray:
        """All values on the driver, in the order of the axes; for small arrays."""
        rows = self.df.collect()
        if not rows and not self.batch.names:
            raise IndexError("the frame has no array; an index is outside of its axis")
        size = [self.known.get(b, max((r[b] for r in rows), default=-1) + 1) for b in self.batch.names]
        if rows and len(rows) < math.prod(size):
            warnings.warn(f"{math.prod(size) - len(rows)} of {math.prod(size)} arrays are missing and become zeros", stacklevel=2)
        out = np.zeros((*size, *self.shape), bool if self.dtype == "bool" else float)
        for r in rows:
            out[tuple(r[b] for b in self.batch.names)] = np.reshape(r[DATA], self.shape)
        return out

    def pixels(self, value: str = "value") -> DataFrame:
        """A row per value with a column per axis."""
        df = self.df.select(*self.batch.names, F.posexplode(DATA).alias("_i", value))
        stride, cols = 1, {}
        for a, n in reversed(list(zip(self.space.names, self.shape))):
            cols[a] = F.expr(f"cast((_i div {stride}) % {n} as int)")
            stride *= n
        return df.select(*self.batch.names, *[cols[a].alias(a) for a in self.space.names], value)

    @classmethod
    def from_pixels(cls, df: DataFrame, batch: str | Axes, space: str | Axes, shape: Sequence[int], value: str = "value", dtype: str = "float32", fill: float = 0.0) -> ArrayFrame:
        """From a row per value; missing coordinates take the fill value."""
        batch, space = Axes.of(batch), Axes.of(space)
        index = F.lit(0)
        for a, n in zip(space.names, shape):
            index = index * n + F.col(a)
        pixel = F.struct(index.cast("int").alias("i"), F.col(value).cast("double").alias("v"))
        rows = df.groupBy(*batch.names).agg(F.collect_list(pixel).alias("_p"))
        size = math.prod(shape)
        gaps = F.array_except(F.sequence(F.lit(0), F.lit(size - 1)), F.transform("_p", lambda x: x["i"]))
        whole = F.concat("_p", F.transform(gaps, lambda i: F.struct(i.alias("i"), F.lit(float(fill)).alias("v"))))
        data = F.transform(F.sort_array(F.when(F.size("_p") == size, F.col("_p")).otherwise(whole)), lambda x: x["v"])
        return cls(rows.select(*batch.names, data.alias(DATA)), batch, space, shape, dtype)

    # kernels -----------------------------------------------------------------

    def _schema(self, fields: str) -> T.StructType:
        return T.StructType([*self.df.select(*self.batch.names).schema.fields, *T._parse_datatype_string(fields).fields])

    def _with(self, df: DataFrame, space=None, shape=None, dtype: str | None = None, batch=None) -> ArrayFrame:
        return ArrayFrame(df, self.batch if batch is None else batch, self.space if space is None else space, self.shape if shape is None else shape, dtype or self.dtype, self.name, self.known)

    def map(self, kernel: Callable[[np.ndarray], np.ndarray], dtype: str | None = None, space=None, shape=None) -> ArrayFrame:
        """The kernel on stacks (n, *shape); integers come back as integers."""
        n, own, kind, size = len(self.batch), self.dtype, dtype or self.dtype, self.shape

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in _few(batches, size):
                if b.num_rows:
                    y = cast(kernel(_stack(b, n, size, own)), kind)
                    yield pa.RecordBatch.from_arrays([*b.columns[:n], _column(y)], b.schema.names)

        return self._with(self.df.mapInArrow(run, self._schema("data array<double>")), space, shape, kind)

    def map_with(self, other: ArrayFrame, kernel: Callable[[np.ndarray, np.ndarray], np.ndarray], dtype: str | None = None, space=None, shape=None) -> ArrayFrame:
        """The kernel on stacks of rows with the same coordinates on the axes that both have."""
        joined, n = self._joined(other), len(self.batch)
        own, its, kind, size, size2 = self.dtype, other.dtype, dtype or self.dtype, self.shape, other.shape

        def run(batches):
            for b in _few(batches, size, size2):
                if b.num_rows:
                    y = cast(kernel(_stack(b, n, size, own), _stack(b, n + 1, size2, its)), kind)
                    yield pa.RecordBatch.from_arrays([*b.columns[:n], _column(y)], [*b.schema.names[:n], DATA])

        return self._with(joined.mapInArrow(run, self._schema("data array<double>")), space, shape, kind)

    def table(self, kernel: Callable[[np.ndarray], dict[str, Sequence]], fields: str, other: ArrayFrame | None = None) -> DataFrame:
        """Rows with the batch coordinates and the kernel's columns; ``row`` of the result says which array of the stack a row is of (default: one row each)."""
        n, sizes = len(self.batch), [(self.shape, self.dtype)] + ([(other.shape, other.dtype)] if other else [])
        schema, own = self._schema(fields), T._parse_datatype_string(fields)
        kinds, arrow = own.names, _arrow(own)

        def run(batches):
            for b in _few(batches, *(s for s, _ in sizes)):
                if b.num_rows:
                    out = dict(kernel(*[_stack(b, n + i, s, k) for i, (s, k) in enumerate(sizes)]))
                    rows = np.asarray(out.pop("row", np.arange(b.num_rows)), int)
                    index = pa.array(rows)
                    keys = [c.take(index) for c in b.columns[:n]]
                    values = [pa.array(np.asarray(out[k]).tolist() if not isinstance(out[k], list) else out[k], f.type) for k, f in zip(kinds, arrow)]
                    yield pa.RecordBatch.from_arrays([*keys, *values], [*b.schema.names[:n], *kinds])

        return (self._joined(other) if other else self.df).mapInArrow(run, schema)

    def _joined(self, other: ArrayFrame) -> DataFrame:
        shared = [b for b in other.batch.names if b in self.batch]
        if len(shared) < len(other.batch):
            raise AxesError(f"axes {other.batch} are not all among {self.batch}")
        right = other.df.withColumnRenamed(DATA, "_other")
        return self.df.join(right, shared) if shared else self.df.join(right.withColumn("_one", F.lit(1)), F.lit(1) == F.col("_one")).drop("_one")

    # values ------------------------------------------------------------------

    def each(self, f: Callable[[Column], Column], dtype: str | None = None) -> ArrayFrame:
        """A column expression on every value."""
        return self._with(self.df.withColumn(DATA, F.transform(DATA, lambda v: f(v).cast("double"))), dtype=dtype)

    def _binary(self, other, f: Callable[[Column, Column], Column], dtype: str | None = None) -> ArrayFrame:
        if not isinstance(other, ArrayFrame):
            plain = other.item() if isinstance(other, np.generic) else other
            return self.each(lambda v: f(v, F.lit(plain)), dtype)
        if other.space.names != self.space.names or other.shape != self.shape:
            raise AxesError(f"{other!r} does not fit {self!r}")
        df = self._joined(other)
        return self._with(df.select(*self.batch.names, F.zip_with(DATA, "_other", lambda a, b: f(a, b).cast("double")).alias(DATA)), dtype=dtype)

    def _arithmetic(self, other, f: Callable[[Column, Column], Column]) -> ArrayFrame:
        """Unsigned values with whole numbers or their own type wrap around; with a wider unsigned type they take it, with others they become floats."""
        kind = self.dtype
        if kind in _LIMITS:
            its = other.dtype if isinstance(other, ArrayFrame) else kind if isinstance(other, (bool, int, np.integer, np.bool_)) else "float32"
            kind = max(kind, its, key=_LIMITS.get) if its in _LIMITS else kind if its == "bool" else "float32"
        if kind not in _LIMITS:
            return self._binary(other, f, kind)
        return self._binary(other, lambda a, b: F.pmod(f(a.cast("double"), b.cast("double")), F.lit(_LIMITS[kind] + 1.0)), kind)

    def __add__(self, other):
        return self._arithmetic(other, lambda a, b: a + b)

    def __sub__(self, other):
        return self._arithmetic(other, lambda a, b: a - b)

    def __mul__(self, other):
        return self._arithmetic(other, lambda a, b: a * b)

    def __radd__(self, other):
        return self._arithmetic(other, lambda a, b: b + a)

    def __rsub__(self, other):
        return self._arithmetic(other, lambda a, b: b - a)

    def __rmul__(self, other):
        return self._arithmetic(other, lambda a, b: b * a)

    @staticmethod
    def _divisor(other) -> None:
        if not isinstance(other, ArrayFrame) and other == 0:
            raise ZeroDivisionError("division of an array by zero")

    def __truediv__(self, other):
        """Zero where an array divides by zero, as for // and %."""
        self._divisor(other)
        return self._binary(other, lambda a, b: F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0)), "float32")

    def __rtruediv__(self, other):
        return self._binary(other, lambda a, b: F.coalesce(b / F.nullif(a.cast("double"), F.lit(0.0)), F.lit(0.0)), "float32")

    def __floordiv__(self, other):
        self._divisor(other)
        return self._arithmetic(other, _floor_divided)

    def __mod__(self, other):
        self._divisor(other)
        return self._arithmetic(other, _remainder)

    def __pow__(self, power):
        return self._arithmetic(power, lambda a, b: F.pow(a, b))

    def __rfloordiv__(self, other):
        return self._arithmetic(other, lambda a, b: _floor_divided(b, a))

    def __rmod__(self, other):
        return self._arithmetic(other, lambda a, b: _remainder(b, a))

    def __rpow__(self, other):
        return self._arithmetic(other, lambda a, b: F.pow(b, a))

    def __neg__(self):
        if self.dtype in _LIMITS:
            return self.each(lambda v: F.pmod(-v, F.lit(_LIMITS[self.dtype] + 1.0)))
        return self.each(lambda v: -v)

    def __invert__(self):
        return self.each(lambda v: v == 0, "bool")

    def __gt__(self, other):
        return self._binary(other, lambda a, b: a > b, "bool")

    def __ge__(self, other):
        return self._binary(other, lambda a, b: a >= b, "bool")

    def __lt__(self, other):
        return self._binary(other, lambda a, b: a < b, "bool")

    def __le__(self, other):
        return self._binary(other, lambda a, b: a <= b, "bool")

    def equals(self, other):
        return self._binary(other, lambda a, b: a == b, "bool")

    def differs(self, other):
        return self._binary(other, lambda a, b: a != b, "bool")

    def __and__(self, other):
        return self._binary(other, lambda a, b: (a != 0) & (b != 0), "bool")

    def __or__(self, other):
        return self._binary(other, lambda a, b: (a != 0) | (b != 0), "bool")

    def where(self, condition: ArrayFrame, other: float = 0.0) -> ArrayFrame:
        return self._binary(condition, lambda a, b: F.when(b != 0, a).otherwise(F.lit(float(other))))

    def as_type(self, dtype: str) -> ArrayFrame:
        """uint8 and uint16 are scaled by 256 into each other; floats are rounded and limited."""
        if {self.dtype, dtype} == {"uint8", "uint16"}:
            f = (lambda v: F.floor(v / 256)) if dtype == "uint8" else (lambda v: v * 256)
            return self.each(f, dtype)
        if dtype in ("int64", "uint64"):
            raise ValueError(f"an image cannot have the type {dtype}")
        if dtype in _LIMITS:
            return self.each(lambda v: F.floor(F.least(F.greatest(v + 0.5, F.lit(0.0)), F.lit(float(_LIMITS[dtype])))), dtype)
        if dtype == "bool":
            return self.each(lambda v: v != 0, dtype)
        return self._with(self.df, dtype=dtype)

    # slices ------------------------------------------------------------------

    def __getitem__(self, key) -> ArrayFrame:
        """A text like ``"t=4;y=2:10:2"``, a slicer, a dictionary, or a boolean frame (other values become 0)."""
        if isinstance(key, ArrayFrame):
            return self.where(key)
        if isinstance(key, Slicer):
            key = key.keys
        if isinstance(key, str):
            key = parse(key, self.sizes(key))
        return self.isel(**key)

    def sizes(self, only: str | None = None) -> dict[str, int]:
        """Sizes of the axes; batch axes are counted where ``only`` mentions N for them."""
        out = dict(zip(self.space.names, self.shape))
        need = self.batch.names if only is None or "N" in only or "-" in only or "," in only else []
        out |= self.known
        need = [b for b in need if b not in self.known]
        if need:
            row = self.df.agg(*[F.max(b).alias(b) for b in need]).first()
            out |= {b: int(row[b] if row[b] is not None else -1) + 1 for b in need}
        return {**{b: 0 for b in self.batch.names}, **out}

    def _size(self, axis: Axis) -> int:
        """Of a batch axis: its labels', known, or counted."""
        if axis.labels:
            return len(axis.labels)
        if axis.name in self.known:
            return self.known[axis.name]
        last = self.df.agg(F.max(axis.name)).first()[0]
        return 0 if last is None else int(last) + 1

    def _position(self, axis: Axis, k) -> int:
        """A place on a batch axis, from its end if negative; outside of a known size is an error (where none is known and the place is not negative, nothing is counted)."""
        k = int(k)
        if k >= 0 and not axis.labels and axis.name not in self.known:
            return k
        n = self._size(axis)
        if not -n <= k < n:
            raise IndexError(f"index {k} is outside of axis {axis.name} with size {n}")
        return k % n

    def isel(self, **keys) -> ArrayFrame:
        df, batch, space, known = self.df, [], [], {}
        for axis in self.batch:
            k = keys.pop(axis.name, slice(None))
            c = F.col(axis.name)
            if isinstance(k, (list, tuple, range)):
                known[axis.name] = len(k)
            elif isinstance(k, slice) and (axis.name in self.known or axis.labels):
                known[axis.name] = len(range(self._size(axis))[k])
            if isinstance(k, slice):
                start, step = k.start or 0, k.step or 1
                if start < 0 or (k.stop or 0) < 0 or step < 0:
                    df = _rebased(df, axis.name, range(self._size(axis))[k])
                elif k != slice(None):
                    df = df.where((c >= start) & ((c - start) % step == 0) & (F.lit(True) if k.stop is None else c < k.stop))
                    df = df.withColumn(axis.name, F.expr(f"cast(({axis.name} - {start}) div {step} as int)"))
            elif isinstance(k, (list, tuple, range)):
                df = _rebased(df, axis.name, [self._position(axis, i) for i in k])
            else:
                df = df.where(c == self._position(axis, k)).drop(axis.name)
            if (a := axis.sliced(k)) is not None:
                batch.append(a)
        index, shape = [], []
        for axis, n in zip(self.space, self.shape):
            k = keys.pop(axis.name, slice(None))
            if not isinstance(k, (slice, list, tuple, range)) and not -n <= int(k) < n:
                raise IndexError(f"index {k} is outside of axis {axis.name} with size {n}")
            index.append(list(range(n))[k] if isinstance(k, slice) else [i % n for i in k] if isinstance(k, (list, tuple, range)) else [int(k) % n])
            if (a := axis.sliced(k)) is not None:
                space.append(a)
                shape.append(len(index[-1]))
        if keys:
            raise AxesError(f"axes {', '.join(keys)} are not among {self.axes}")
        if any(i != list(range(n)) for i, n in zip(index, self.shape)):
            df = df.withColumn(DATA, _picked(self.shape, index))
        return ArrayFrame(df, Axes(tuple(batch)), Axes(tuple(space)), shape, self.dtype, self.name, known)

    def sel(self, **labels) -> ArrayFrame:
        """By the labels of the axes: one, a list, or a slice with an exclusive stop."""
        keys = {}
        for name, label in labels.items():
            axis = self.axes[name]
            keys[name] = axis.label_slice(label) if isinstance(label, slice) else [axis.index(x) for x in label] if isinstance(label, list) else axis.index(label)
        return self.isel(**keys)

    def set_axes(self, axes: Axes) -> ArrayFrame:
        """New metadata, or new names, for the same axes in the same order."""
        axes = Axes.of(axes)
        if len(axes) != len(self.axes):
            raise AxesError(f"{axes} does not have {len(self.axes)} axes")
        k = len(self.batch)
        known = {new: self.known[old] for new, old in zip(axes.names, self.batch.names) if old in self.known}
        return ArrayFrame(self.df.toDF(*axes.names[:k], DATA), Axes(axes.items[:k]), Axes(axes.items[k:]), self.shape, self.dtype, self.name, known)

    def set_scale(self, other=None, **scale) -> ArrayFrame:
        return self.set_axes(self.axes.scaled(other, **scale))

    def set_labels(self, **labels) -> ArrayFrame:
        return self.set_axes(self.axes.labelled(**labels))

    def transpose(self, space: str) -> ArrayFrame:
        order = [self.space.find(a) for a in space]
        return self.map(lambda x: x.transpose(0, *[i + 1 for i in order]), space=[self.space[a] for a in space], shape=[self.shape[i] for i in order])

    def split(self, axis: str) -> list[ArrayFrame]:
        return [self.isel(**{axis: i}) for i in range(self.sizes()[axis])]

    # reductions --------------------------------------------------------------

    def reduce(self, how: str, axis: str | None = None, mask: ArrayFrame | None = None) -> ArrayFrame:
        """Over the named axes (all by default): mean, sum, min, max, std, var, median, any, all, count, ptp, prod, or 'p%'."""
        gone = list(self.axes.names if axis is None else axis)
        for a in gone:
            self.axes.find(a)
        batch, space = self.batch.drop(gone), self.space.drop(gone)
        shape = [n for a, n in zip(self.space.names, self.shape) if a not in gone]
        if mask is None and not any(a in self.batch for a in gone):
            over = tuple(i + 1 for i, a in enumerate(self.space.names) if a in gone)
            f = _NUMPY.get(how) or functools.partial(np.percentile, q=float(how[:-1]))
            return self.map(lambda x: f(x, axis=over), _reduced(how, self.dtype), space, shape)
        px = self.pixels()
        if mask is not None:
            shared = [a for a in mask.axes.names if a in self.axes]
            px = px.join(mask.pixels("_m"), shared, "left").where("coalesce(_m, 0) = 0")
        keys = [*batch.names, *space.names]
        value = _spark(how)
        out = px.groupBy(*keys).agg(value.cast("double").alias("value")) if keys else px.agg(value.cast("double").alias("value"))
        kind = _reduced(how, self.dtype)
        if kind in _LIMITS:
            out = out.withColumn("value", F.floor(F.least(F.greatest(F.col("value") + 0.5, F.lit(0.0)), F.lit(float(_LIMITS[kind])))).cast("double"))
        if not space.names:
            return ArrayFrame(out.select(*batch.names, F.array("value").alias(DATA)), batch, "", (), kind)
        return ArrayFrame.from_pixels(out, batch, space, shape, dtype=kind)

    def projection(self, axis: str | None = None, how: str = "mean", mask: ArrayFrame | None = None) -> ArrayFrame:
        """Like reduce, over the first of t, z, p, i, a, c by default; the type stays."""
        if axis is None:
            axis = next((a for a in "tzpiac" if a in self.axes), None)
            if axis is None:
                raise AxesError(f"no axis to project among {self.axes}")
        out = self.reduce(how, axis, mask)
        return out if out.dtype == self.dtype or self.dtype not in _LIMITS else out.as_type(self.dtype)

    def dims(self, dims=None) -> list[str]:
        return spatial(self.space, dims)


def method(f: Callable) -> Callable:
    """Make the function a method of array frames; names may not be taken."""
    if hasattr(ArrayFrame, f.__name__):
        raise AttributeError(f"array frames have {f.__name__!r} already")
    setattr(ArrayFrame, f.__name__, f)
    return f


def _floor_divided(a: Column, b: Column) -> Column:
    return F.coalesce(F.floor(a / F.nullif(b.cast("double"), F.lit(0.0))).cast("double"), F.lit(0.0))


def _remainder(a: Column, b: Column) -> Column:
    return F.coalesce(a - F.floor(a / F.nullif(b.cast("double"), F.lit(0.0))) * b, F.lit(0.0))


def _arrow(schema: T.StructType):
    from pyspark.sql.pandas.types import to_arrow_schema

    return list(to_arrow_schema(schema))


def _table(values: Sequence[int]) -> Column:
    """An array of literals, which Catalyst folds to one."""
    return F.array(*[F.lit(int(v)) for v in values])


def _lookup(values: Sequence[int]) -> Callable[[Column], Column]:
    """From a place to its value: a formula where the values are evenly spaced."""
    steps = set(np.diff(values).tolist())
    if len(steps) <= 1:
        step = steps.pop() if steps else 0
        return lambda k: k * step + int(values[0])
    return lambda k: F.get(_table(values), k)


def _picked(shape: Sequence[int], index: Sequence[Sequence[int]]) -> Column:
    """The data at some places of each spatial axis: runs along the last axis, put together."""
    if not all(len(i) for i in index):
        return F.array().cast("array<double>")
    *outer, last = index
    count, stride = math.prod(map(len, outer)), math.prod(shape)
    div = lambda a, b: F.call_function("div", a, F.lit(int(b))).cast("int")

    def start(r: Column) -> Column:
        at, below, size = F.lit(0), count, stride
        for n, i in zip(shape, outer):
            below, size = below // len(i), size // n
            at = at + _lookup(i)(div(r, below) % len(i)) * size
        return at

    def run(data: Column, r: Column) -> Column:
        if len(last) == 1 or set(np.diff(last)) == {1}:
            return F.slice(data, start(r) + int(last[0]) + 1, len(last))
        return F.transform(F.array(start(r)), lambda s: F.transform(F.sequence(F.lit(0), F.lit(len(last) - 1)), lambda j: F.get(data, s + _lookup(last)(j))))[0]

    # the data is bound once: an expression behind the column would be made again for every place
    return F.transform(F.array(F.col(DATA)), lambda data: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda r: run(data, r))))[0]


def _rebased(df: DataFrame, name: str, at: Sequence[int]) -> DataFrame:
    """Rows at the given positions, which become 0, 1, ...; a position may occur twice."""
    at = list(at)
    if not at:
        return df.limit(0)
    c, steps = F.col(name), set(np.diff(at).tolist())
    if len(steps) == 1 and 0 not in steps:  # evenly spaced: a formula
        step = steps.pop()
        near = (c >= min(at)) & (c <= max(at)) & ((c - at[0]) % step == 0)
        return df.where(near).withColumn(name, F.call_function("div", c - at[0], F.lit(step)).cast("int"))
    places = F.filter(F.sequence(F.lit(0), F.lit(len(at) - 1)), lambda j: F.get(_table(at), j) == c)
    return df.where(F.array_contains(_table(at), c.cast("int"))).withColumn(name, F.explode(places))


_NUMPY: dict[str, Callable] = {"mean": np.mean, "sum": np.sum, "min": np.min, "max": np.max, "std": np.std, "var": np.var, "median": np.median, "any": np.any, "all": np.all, "ptp": np.ptp, "prod": np.prod, "count": np.count_nonzero}


def _spark(how: str) -> Column:
    v = F.col("value")
    known = {"mean": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "std": F.stddev_pop, "var": F.var_pop, "median": F.median, "prod": F.product}
    if how in known:
        return known[how](v)
    if how in ("any", "all"):
        return (F.bool_or if how == "any" else F.bool_and)(v != 0).cast("int")
    if how == "count":
        return F.count_if(v != 0)
    if how == "ptp":
        return F.max(v) - F.min(v)
    return F.percentile(v, F.lit(float(how[:-1]) / 100))


def _reduced(how: str, dtype: str) -> str:
    if how in ("any", "all"):
        return "bool"
    if how in ("min", "max") and dtype != "bool":
        return dtype
    return "float64" if how in ("sum", "count", "prod") else "float32"
