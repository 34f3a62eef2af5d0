"""Chunk stores in the public zarr layout (version 2) as a Spark data source.

A group with the attributes of the axes and one array ``data``: a JSON file
with shape, chunks, type and compressor, and a file for each chunk.  Every
chunk is read by the task that needs it; conditions on batch axes and on chunk
columns are pushed into the source, so that a slice opens only its chunks.
Tasks write their chunks themselves, and the array's description is written
last, when all of them are there.
"""

from __future__ import annotations

import gzip
import itertools
import json
import math
import operator
import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import datasource as D
from pyspark.sql import types as T

from ..axes import Axes, AxesError, Axis, parse
from ..chunks import ChunkedFrame, Grid
from ..frame import ArrayFrame

#: Bytes of chunks that one task reads, about.
TASK_BYTES = 64 << 20
TYPES = {"float32": "<f4", "float64": "<f8", "uint8": "|u1", "uint16": "<u2", "uint32": "<u4", "bool": "|b1", "int64": "<i8"}


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub("^file:/+", "/", path)  # file:/a and file:///a alike
    fs, inside = pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)
    return fs, inside.rstrip("/")


def _json(fs: pafs.FileSystem, path: str) -> dict | None:
    if fs.get_file_info(path).type != pafs.FileType.File:
        return None
    with fs.open_input_stream(path) as f:
        return json.loads(f.read())


def _unpacked(data: bytes, compressor: dict | None) -> bytes:
    kind = compressor["id"] if compressor else None
    if kind is None:
        return data
    if kind == "zlib":
        return zlib.decompress(data)
    if kind == "gzip":
        return gzip.decompress(data)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdDecompressor().decompressobj().decompress(data)
    raise ValueError(f"compressor {kind!r} of a chunk store is not known")


def _packed(data: bytes, compressor: dict | None) -> bytes:
    kind = compressor["id"] if compressor else None
    if kind is None:
        return data
    if kind == "zlib":
        return zlib.compress(data, compressor.get("level", 1))
    if kind == "gzip":
        return gzip.compress(data, compressor.get("level", 1), mtime=0)
    if kind == "zstd":
        import zstandard

        return zstandard.ZstdCompressor(level=compressor.get("level", 1)).compress(data)
    raise ValueError(f"compressor {kind!r} of a chunk store is not known")


def meta(path: str) -> dict:
    """Shape, chunks, type and axes; no chunk is opened."""
    fs, top = opened(path)
    inner = f"{top}/data" if fs.get_file_info(f"{top}/data/.zarray").type == pafs.FileType.File else top
    array = _json(fs, f"{inner}/.zarray")
    if array is None:
        raise FileNotFoundError(f"no array in {path}")
    if array.get("order", "C") != "C" or array.get("filters"):
        raise ValueError("only arrays in C order without filters are read")
    own = _json(fs, f"{top}/.zattrs") or {}
    names = own.get("axes") or str(Axes.default(len(array["shape"])))
    scale, labels = own.get("scale") or {}, own.get("labels")
    axes = [[a, float(scale.get(a, 1.0)), own.get("unit") or "", list((own.get("axis_labels") or {}).get(a, labels if a == "c" and labels else []))] for a in names]
    return {"shape": array["shape"], "chunks": array["chunks"], "dtype": array["dtype"], "axes": axes, "compressor": array.get("compressor"), "fill": array.get("fill_value") or 0, "separator": array.get("dimension_separator", "."), "inner": inner[len(top) :], "metadata": own.get("metadata", {})}


_TESTS = {"EqualTo": operator.eq, "EqualNullSafe": operator.eq, "GreaterThan": operator.gt, "GreaterThanOrEqual": operator.ge, "LessThan": operator.lt, "LessThanOrEqual": operator.le, "In": lambda v, many: v in many}


class _Reader(D.DataSourceReader):
    def __init__(self, path: str, found: dict, batch: Sequence[str], space: Sequence[str]) -> None:
        self.path, self.meta, self.batch, self.space, self.tests = path, found, list(batch), list(space), []

    def pushFilters(self, filters):  # noqa: N802
        """Every condition is also left to Spark: a chunk may hold several places of a batch axis."""
        for f in filters:
            if type(f).__name__ in _TESTS:
                self.tests.append((f.attribute[0], type(f).__name__, f.value))
            yield f

    def _keeps(self, column: str, values: range) -> bool:
        return all(any(_TESTS[how](v, wanted) for v in values) for name, how, wanted in self.tests if name == column)

    def partitions(self):
        shape, chunks, names = self.meta["shape"], self.meta["chunks"], [a[0] for a in self.meta["axes"]]
        kept = []
        for name, n, c in zip(names, shape, chunks):
            of_space = name in self.space
            kept.append([k for k in range(-(-n // c)) if self._keeps(f"chunk_{name}" if of_space else name, range(k, k + 1) if of_space else range(k * c, min(n, (k + 1) * c)))])
        size = max(1, math.prod(chunks) * np.dtype(self.meta["dtype"]).itemsize)
        per, every = max(1, TASK_BYTES // size), itertools.product(*kept)
        return [D.InputPartition(part) for part in iter(lambda: list(itertools.islice(every, per)), [])]

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        m = self.meta
        fs, top = opened(self.path)
        names, chunks, shape = [a[0] for a in m["axes"]], m["chunks"], m["shape"]
        order = [names.index(a) for a in (*self.batch, *self.space)]
        k = len(self.batch)
        for at in partition.value:
            file = f"{top}{m['inner']}/{m['separator'].join(map(str, at)) or '0'}"
            if fs.get_file_info(file).type == pafs.FileType.File:
                with fs.open_input_stream(file) as f:
                    x = np.frombuffer(_unpacked(f.read(), m["compressor"]), m["dtype"]).reshape(chunks)
            else:
                x = np.full(chunks, m["fill"], m["dtype"])
            x = x[tuple(slice(0, min(c, n - i * c)) for i, c, n in zip(at, chunks, shape))].transpose(order)
            spots = list(np.ndindex(x.shape[:k]))
            columns = [pa.array([at[order[j]] * chunks[order[j]] + s[j] for s in spots], pa.int32()) for j in range(k)]
            columns += [pa.array([at[order[j]]] * len(spots), pa.int32()) for j in range(k, len(order))]
            values = pa.array(np.ascontiguousarray(x, float).ravel())
            cut = np.arange(len(spots) + 1, dtype=np.int32) * math.prod(x.shape[k:])
            yield pa.RecordBatch.from_arrays([*columns, pa.ListArray.from_arrays(cut, values)], [*self.batch, *[f"chunk_{a}" for a in self.space], "data"])


class _Writer(D.DataSourceArrowWriter):
    def __init__(self, path: str, options: dict) -> None:
        self.path, self.options = path, options

    def write(self, iterator):
        o = self.options
        fs, top = opened(self.path)
        fs.create_dir(f"{top}/data", recursive=True)
        grid, k, n = Grid(tuple(o["shape"]), tuple(o["chunks"])), len(o["batch"]), len(o["shape"])
        most = [-1] * k
        for batch in iterator:
            data = batch.column(k + n)
            keys = [c.to_pylist() for c in batch.columns[: k + n]]
            for i in range(batch.num_rows):
                at = [c[i] for c in keys]
                size, whole = grid.size(at[k:]), np.zeros(grid.chunks)
                start, end = data.offsets[i].as_py(), data.offsets[i + 1].as_py()
                whole[tuple(slice(0, s) for s in size)] = data.values.slice(start, end - start).to_numpy(zero_copy_only=False).reshape(size)
                with fs.open_output_stream(f"{top}/data/{'.'.join(map(str, at)) or '0'}") as f:
                    f.write(_packed(whole.astype(o["dtype"]).tobytes(), o["compressor"]))
                most = [max(m, a) for m, a in zip(most, at)]
        return _Sizes(most)

    def commit(self, messages) -> None:
        o = self.options
        fs, top = opened(self.path)
        batch = [max((m.most[i] for m in messages if m is not None), default=-1) + 1 for i in range(len(o["batch"]))]
        array = {"zarr_format": 2, "shape": [*batch, *o["shape"]], "chunks": [1] * len(batch) + list(o["chunks"]), "dtype": o["dtype"], "compressor": o["compressor"], "fill_value": 0, "order": "C", "filters": None}
        for name, content in ((".zgroup", {"zarr_format": 2}), (".zattrs", o["attributes"]), ("data/.zarray", array)):
            with fs.open_output_stream(f"{top}/{name}") as f:
                f.write(json.dumps(content).encode())

    def abort(self, messages) -> None:
        """Chunks without a description are no array; the next write takes their place."""


class _Sizes(D.WriterCommitMessage):
    def __init__(self, most: list[int]) -> None:
        self.most = most


class ZarrSource(D.DataSource):
    """``spark.read.format("zarr").load(path)``: a row for each chunk and place on the batch axes (all but zyx)."""

    @classmethod
    def name(cls) -> str:
        return "zarr"

    def _meta(self) -> tuple[dict, list[str], list[str]]:
        found = meta(self.options["path"])
        names = [a[0] for a in found["axes"]]
        space = [a for a in names if a in "zyx"]
        return found, [a for a in names if a not in space], space

    def schema(self) -> T.StructType:
        _, batch, space = self._meta()
        keys = [T.StructField(c, T.IntegerType()) for c in (*batch, *[f"chunk_{a}" for a in space])]
        return T.StructType([*keys, T.StructField("data", T.ArrayType(T.DoubleType()))])

    def reader(self, schema):
        return _Reader(self.options["path"], *self._meta())

    def writer(self, schema, overwrite: bool):
        fs, top = opened(self.options["path"])
        if fs.get_file_info(top).type == pafs.FileType.Directory:
            if not overwrite and fs.get_file_info(f"{top}/data/.zarray").type == pafs.FileType.File:
                raise FileExistsError(self.options["path"])
            fs.delete_dir_contents(top)
        return _Writer(self.options["path"], json.loads(self.options["frame"]))


def _known(spark: SparkSession) -> None:
    spark.dataSource.register(ZarrSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, key: str | None = None) -> ChunkedFrame:
    """The array in its own chunks; a key like ``"t=3;y=100:300"`` opens only the chunks of the slice."""
    _known(spark)
    found = meta(path)
    axes = Axes(tuple(Axis(n, s, u, tuple(labels)) for n, s, u, labels in found["axes"]))
    space = [a for a in axes if a.name in "zyx"]
    place = [axes.find(a) for a in space]
    kind = {"f": "float64" if found["dtype"][-1] == "8" else "float32", "b": "bool", "i": "int64"}.get(found["dtype"][1], np.dtype(found["dtype"]).name)
    df = spark.read.format("zarr").load(path)
    frame = ChunkedFrame(df, [a for a in axes if a not in space], space, [found["shape"][i] for i in place], [found["chunks"][i] for i in place], kind)
    if key is None:
        return frame
    sizes = {a.name: n for a, n in zip(axes, found["shape"])}
    return frame.isel(**parse(key, sizes))


def write(frame: ArrayFrame | ChunkedFrame, path: str, chunks: int | Sequence[int] = 1024, *, compressor: str | None = "zlib", overwrite: bool = True, metadata: dict | None = None) -> None:
    """A file for each chunk, written by the tasks; the array's description follows when all chunks are there."""
    spark = frame.df.sparkSession
    _known(spark)
    if isinstance(frame, ArrayFrame):
        frame = frame.rechunk(chunks)
    if frame.dtype not in TYPES:
        raise AxesError(f"values of type {frame.dtype} are not written")
    axes = [*frame.batch, *frame.space]
    attributes = {"axes": "".join(a.name for a in axes), "scale": {a.name: a.scale for a in axes}, "unit": next((a.unit for a in axes if a.unit), ""), "labels": next((list(a.labels) for a in axes if a.name == "c" and a.labels), None), "axis_labels": {a.name: list(a.labels) for a in axes if a.labels}, "metadata": metadata or {}}
    told = {"batch": frame.batch.names, "shape": list(frame.shape), "chunks": list(frame.grid.chunks), "dtype": TYPES[frame.dtype], "compressor": {"id": compressor, "level": 1} if compressor else None, "attributes": attributes}
    frame.df.write.format("zarr").mode("overwrite" if overwrite else "append").option("frame", json.dumps(told)).save(path)
