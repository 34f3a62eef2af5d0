"""Reading and writing array frames.

Parquet is the native format: one row per array, partitioned by batch axes if
wanted, with the axes as metadata of the data column.  Array files (npy, npz,
mrc, tif) are read through Spark's binaryFile source, so any file system that Spark
knows will do; further formats are added with ``mark_reader``.
"""

from __future__ import annotations

import io
import json
import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from ..axes import Axes, AxesError, Axis, parse
from ..bind import DataDict
from ..chunks import ChunkedFrame
from ..frame import ArrayFrame

Reader = Callable[[bytes], tuple[np.ndarray, str | None, dict[str, float]]]
_READERS: dict[str, Reader] = {}
_WRITERS: dict[str, Callable[[np.ndarray, Axes], bytes]] = {}


def mark_reader(*extensions: str) -> Callable[[Reader], Reader]:
    """Register a function from a file's bytes to an array, its axes (or None) and scales."""

    def register(f: Reader) -> Reader:
        _READERS.update(dict.fromkeys(extensions, f))
        return f

    return register


def mark_writer(*extensions: str):
    def register(f):
        _WRITERS.update(dict.fromkeys(extensions, f))
        return f

    return register


def extension(path: str, known: dict) -> str:
    """The longest known ending of a path."""
    name = path.rsplit("/", 1)[-1]
    found = [e for e in known if name.endswith(e)]
    if not found:
        raise ValueError(f"no reader or writer for {name!r}")
    return max(found, key=len)


@mark_reader(".npy")
def _npy(data: bytes):
    return np.load(io.BytesIO(data), allow_pickle=False), None, {}


@mark_reader(".npz")
def _npz(data: bytes):
    with np.load(io.BytesIO(data), allow_pickle=False) as z:
        axes = str(z["axes"]) if "axes" in z else None
        scale = dict(zip(axes, z["scale"].tolist())) if axes and "scale" in z else {}
        return z["data"] if "data" in z else z[z.files[0]], axes, scale


@mark_writer(".npy")
def _to_npy(array: np.ndarray, axes: Axes) -> bytes:
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


@mark_writer(".npz")
def _to_npz(array: np.ndarray, axes: Axes) -> bytes:
    out = io.BytesIO()
    np.savez_compressed(out, data=array, axes=str(axes), scale=np.array([a.scale for a in axes]))
    return out.getvalue()


_MRC = {0: "i1", 1: "<i2", 2: "<f4", 6: "<u2", 12: "<f2"}


@mark_reader(".mrc", ".rec", ".st", ".map", ".mrcs")
def _mrc(data: bytes):
    """The public MRC2014 layout: sizes and type in the first words, cell lengths in angstrom, then the values."""
    nx, ny, nz, mode = struct.unpack_from("<4i", data, 0)
    mx, my, mz = struct.unpack_from("<3i", data, 28)
    cell = struct.unpack_from("<3f", data, 40)
    extra = struct.unpack_from("<i", data, 92)[0]
    if mode not in _MRC:
        raise ValueError(f"unknown MRC mode {mode}")
    x = np.frombuffer(data, _MRC[mode], nx * ny * nz, 1024 + extra).reshape(nz, ny, nx)
    scale = {a: c / m / 10 for a, c, m in zip("xyz", cell, (mx, my, mz)) if m and c > 0}
    return (x[0], "yx", {k: v for k, v in scale.items() if k != "z"}) if nz == 1 else (x, "zyx", scale)


@mark_writer(".mrc")
def _to_mrc(array: np.ndarray, axes: Axes) -> bytes:
    x = np.asarray(array, "<f4").reshape((1,) * (3 - array.ndim) + array.shape)
    head = bytearray(1024)
    nz, ny, nx = x.shape
    struct.pack_into("<4i", head, 0, nx, ny, nz, 2)
    struct.pack_into("<3i", head, 28, nx, ny, nz)
    by = {a.name: a.scale for a in axes}
    struct.pack_into("<3f", head, 40, *[n * by.get(a, 1.0) * 10 for a, n in zip("xyz", (nx, ny, nz))])
    struct.pack_into("<3f", head, 52, 90, 90, 90)
    struct.pack_into("<3i", head, 64, 1, 2, 3)
    head[208:212], head[212:216] = b"MAP ", b"DD\x00\x00"
    return bytes(head) + x.tobytes()


# Fixed values of the public TIFF layout: bytes of each field type, and kinds of samples.
_FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 5: "II", 12: "d", 16: "Q"}
_SAMPLE = {1: "u", 2: "i", 3: "f"}


def _tiff_pages(data: bytes) -> tuple[str, list[dict[int, tuple]]]:
    """Byte order and the fields of each page (classic and 64-bit files)."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("no TIFF file")
    big = struct.unpack_from(order + "H", data, 2)[0] == 43
    word, count, entry = ("Q", "Q", 20) if big else ("I", "H", 12)
    at, pages = struct.unpack_from(order + word, data, 8 if big else 4)[0], []
    while at:
        n = struct.unpack_from(order + count, data, at)[0]
        at += struct.calcsize(count)
        fields = {}
        for i in range(n):
            tag, kind, k = struct.unpack_from(order + "HH" + word, data, at + entry * i)
            if kind not in _FIELD:
                continue
            layout = f"{k}s" if kind == 2 else _FIELD[kind] * k
            inline = at + entry * i + 4 + struct.calcsize(order + word)
            size = struct.calcsize(order + layout)
            where = inline if size <= struct.calcsize(order + word) else struct.unpack_from(order + word, data, inline)[0]
            fields[tag] = struct.unpack_from(order + layout, data, where)
        pages.append(fields)
        at = struct.unpack_from(order + word, data, at + entry * n)[0]
    return order, pages


def _tiff_page(data: bytes, order: str, f: dict[int, tuple]) -> np.ndarray:
    """One page: strips, plain or deflated, with or without horizontal differences."""
    w, h, samples = f[256][0], f[257][0], f.get(277, (1,))[0]
    bits, packed = f.get(258, (1,))[0], f.get(259, (1,))[0]
    if 273 not in f or packed not in (1, 8, 32946) or bits % 8 or f.get(284, (1,))[0] != 1:
        raise ValueError("only TIFF pages in strips of whole bytes, plain or deflated, are read")
    raw = b"".join(data[a : a + n] if packed == 1 else zlib.decompress(data[a : a + n]) for a, n in zip(f[273], f[279]))
    x = np.frombuffer(raw, f"{order}{_SAMPLE[f.get(339, (1,))[0]]}{bits // 8}", h * w * samples).reshape(h, w, samples)
    x = x.astype(x.dtype.newbyteorder("="))
    if f.get(317, (1,))[0] == 2:
        x = np.cumsum(x, 1, dtype=x.dtype)
    return x[..., 0] if samples == 1 else x


@mark_reader(".tif", ".tiff")
def _tiff(data: bytes):
    """Pages as a stack; a description of lines like ``slices=4`` gives frames, slices and channels (tzc), spacing and unit scale."""
    order, pages = _tiff_pages(data)
    head = pages[0]
    text = head.get(270, (b"",))[0].rstrip(b"\0").decode("utf-8", "replace")
    known = dict(line.split("=", 1) for line in text.splitlines() if "=" in line)
    first = _tiff_page(data, order, head)
    n = int(known.get("images", len(pages)))
    if len(pages) < n and head.get(259, (1,))[0] == 1:  # one page's fields, then all pages in a row
        kind = first.dtype.newbyteorder(order)
        x = np.frombuffer(data, kind, n * first.size, head[273][0]).astype(first.dtype).reshape(n, *first.shape)
    else:
        x = np.stack([first, *[_tiff_page(data, order, p) for p in pages[1:]]])
    sizes = {a: int(known.get(k, 1)) for a, k in (("t", "frames"), ("z", "slices"), ("c", "channels"))}
    if np.prod(list(sizes.values())) != len(x):
        sizes = {"t": len(x), "z": 1, "c": 1}
    names = [a for a, k in sizes.items() if k > 1]
    x = x.reshape(*[sizes[a] for a in names], *first.shape)
    colour = "c" if "c" not in names else "s"
    scale = {a: head[tag][1] / head[tag][0] for a, tag in (("x", 282), ("y", 283)) if tag in head and head[tag][0] and known}
    if "z" in names and "spacing" in known:
        scale["z"] = float(known["spacing"])
    return x, "".join(names) + "yx" + (colour if first.ndim == 3 else ""), scale


@mark_writer(".tif", ".tiff")
def _to_tiff(array: np.ndarray, axes: Axes) -> bytes:
    """A page per plane in the order t, z, c, with sizes, spacing and resolution."""
    names = axes.names
    if not {"y", "x"} <= set(names) <= set("tzcyx"):
        raise AxesError(f"a TIFF file holds the axes tzcyx with y and x, not {axes}")
    array = array.astype({"u1": "u1", "u2": "u2", "b1": "u1"}.get(array.dtype.str[1:], "f4"))
    array = array.transpose([names.index(a) for a in "tzcyx" if a in names])
    size, scale = dict(zip([a for a in "tzcyx" if a in names], array.shape)), axes.scale
    pages = array.reshape(-1, *array.shape[-2:])
    text = "\n".join(["ImageJ=1.53", f"images={len(pages)}", f"channels={size.get('c', 1)}", f"slices={size.get('z', 1)}", f"frames={size.get('t', 1)}", "hyperstack=true", f"spacing={scale.get('z', 1.0)!r}", "unit=" + (axes["x"].unit or "pixel")])
    note = text.encode("ascii", "replace") + b"\0"
    bits, kind = array.dtype.itemsize * 8, 3 if array.dtype.kind == "f" else 1
    steps = [(1_000_000, max(1, round(scale[a] * 1_000_000))) for a in "xy"]
    fields, extra = 14, 8 + len(note) + 16
    extra += extra % 2
    ifd = 2 + 12 * fields + 4
    pixels = extra + ifd * len(pages)
    if pixels + array.nbytes >= 2**32:
        raise ValueError("a TIFF file of 4 GB or more is not written")
    out = bytearray(struct.pack("<2sHI", b"II", 42, extra) + note + struct.pack("<4I", *steps[0], *steps[1]))
    out += bytes(extra - len(out))
    h, w = pages.shape[1:]
    for i in range(len(pages)):
        rows = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, 1, bits), (259, 3, 1, 1), (262, 3, 1, 1), (270, 2, len(note), 8), (273, 4, 1, pixels + i * pages[0].nbytes), (277, 3, 1, 1), (278, 4, 1, h), (279, 4, 1, pages[0].nbytes), (282, 5, 1, 8 + len(note)), (283, 5, 1, 16 + len(note)), (296, 3, 1, 1), (339, 3, 1, kind)]
        out += struct.pack("<H", fields) + b"".join(struct.pack("<HHII", *r) for r in rows)
        out += struct.pack("<I", extra + ifd * (i + 1) if i + 1 < len(pages) else 0)
    return bytes(out) + pages.astype(pages.dtype.newbyteorder("<")).tobytes()


# parquet -----------------------------------------------------------------------


def imsave(frame: ArrayFrame, path: str, *, overwrite: bool = True, partition_by: str = "") -> None:
    """As parquet, or as a chunk store (``.zarr``); ``write_file`` writes a small frame as an array file."""
    if path.rstrip("/").endswith(".zarr"):
        from . import zarr

        return zarr.write(frame, path, overwrite=overwrite)
    meta = {"space": str(frame.space), "shape": list(frame.shape), "dtype": frame.dtype, "name": frame.name, "known": frame.known, "axes": [[a.name, a.scale, a.unit, list(a.labels)] for a in frame.axes]}
    df = frame.df.withMetadata("data", {"voxelframe": json.dumps(meta)})
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def read_meta(spark: SparkSession, path: str) -> dict:
    """Axes, shape and type: of a parquet frame from its schema, of a chunk store from its description, of an array file from its bytes."""
    if path.rstrip("/").endswith(".zarr"):
        from . import zarr

        return zarr.meta(path)
    if any(path.rsplit("/", 1)[-1].endswith(e) for e in _READERS):
        rows = spark.read.format("binaryFile").load(path).select("content").limit(1).collect()
        array, axes, scale = _READERS[extension(path, _READERS)](bytes(rows[0]["content"]))
        axes = Axes.of(axes or Axes.default(array.ndim)).scaled(scale)
        return {"shape": list(array.shape), "dtype": str(array.dtype), "axes": [[a.name, a.scale, a.unit, list(a.labels)] for a in axes]}
    field = spark.read.parquet(path).schema["data"]
    return json.loads(field.metadata["voxelframe"])


def imread(spark: SparkSession, path: str, key: str | None = None) -> ArrayFrame:
    """A parquet frame, a chunk store (``.zarr``), or array files by their ending; ``key`` is a slice that is pushed into the scan where it is on batch axes (in a chunk store on all)."""
    if path.rstrip("/").endswith(".zarr"):
        return big_imread(spark, path, key).to_frame()
    try:
        extension(path, _READERS)
    except ValueError:
        df = spark.read.parquet(path)
        meta = json.loads(df.schema["data"].metadata["voxelframe"])
        axes = Axes(tuple(Axis(n, s, u, tuple(labels)) for n, s, u, labels in meta["axes"]))
        k = len(axes) - len(meta["shape"])
        frame = ArrayFrame(df, Axes(axes.items[:k]), Axes(axes.items[k:]), meta["shape"], meta["dtype"], meta["name"], meta.get("known"))
    else:
        frame = read_files(spark, path)
    return frame if key is None else frame.isel(**parse(key, frame.sizes(key)))


def big_imread(spark: SparkSession, path: str, key: str | None = None, chunks: int | tuple[int, ...] = 1024) -> ChunkedFrame:
    """In chunks: those of a chunk store, or whole rows cut in the tasks that read them."""
    if path.rstrip("/").endswith(".zarr"):
        from . import zarr

        return zarr.read(spark, path, key)
    return imread(spark, path, key).rechunk(chunks)


def roiread(spark: SparkSession, path: str, box: dict[str, tuple[int, int]]) -> ArrayFrame:
    """Only a box of spatial axes: ``roiread(spark, path, {"y": (10, 50), "x": (0, 20)})``. Of a chunk store only the chunks in it are opened."""
    return imread(spark, path, ";".join(f"{a}={lo}:{hi}" for a, (lo, hi) in box.items()))


def _file_batches(ending: str, shape: list[int], names: int):
    read = _READERS[ending]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                x = np.asarray(read(b.column(names)[i].as_py())[0], float)
                if list(x.shape) != shape:
                    raise AxesError(f"{b.column(names + 1)[i]} has shape {x.shape}, not {tuple(shape)}")
                yield pa.RecordBatch.from_arrays([*[c.slice(i, 1) for c in b.columns[:names]], pa.array([x.ravel()], pa.list_(pa.float64()))], [*b.schema.names[:names], "data"])

    return run


def read_files(spark: SparkSession, path: str, axes: str | None = None) -> ArrayFrame:
    """Array files of one shape.

    A glob gives a batch axis p; ``$t`` or ``$z`` in the path stand for numbers
    and give batch axes of these names, counted by the order of the numbers.
    Missing combinations or repeated ones are errors.
    """
    names = re.findall(r"\$(\w)", path)
    glob = re.sub(r"\$\w", "*", path)
    ending = extension(path, _READERS)
    files = spark.read.format("binaryFile").load(glob).select("path", "content")
    paths = files.select("path")  # places come from the paths alone; no content is moved for them
    least = paths.agg(F.min("path")).first()[0]
    if least is None:
        raise FileNotFoundError(path)
    first = files.where(F.col("path") == least).limit(1).collect()
    array, own, scale = _READERS[ending](bytes(first[0]["content"]))
    space = Axes.of(axes or own or Axes.default(array.ndim)).scaled(scale)
    if names:
        pattern = re.escape(path.rsplit("/", 1)[-1]).replace(r"\*", ".*")
        for n in names:
            pattern = pattern.replace(rf"\${n}", r"(\d+)", 1)
        for i, n in enumerate(names, 1):
            paths = paths.withColumn(f"{n}_number", F.regexp_extract("path", pattern, i).cast("int"))
            # the distinct numbers of one axis are few; their order gives the position
            rank = (F.row_number().over(Window.orderBy(f"{n}_number")) - 1).cast("int").alias(n)
            paths = paths.join(paths.select(f"{n}_number").distinct().select(f"{n}_number", rank), f"{n}_number")
        size = paths.agg(F.count("*").alias("all"), F.countDistinct(*names).alias("some"), *[(F.max(n) + 1).alias(n) for n in names]).first()
        if size["all"] != size["some"] or size["all"] != int(np.prod([size[n] for n in names])):
            raise AxesError(f"files for {path} are missing or repeated")
    elif "*" in path or "?" in path or "[" in path:
        names = ["p"]
        paths = paths.withColumn("p", (F.row_number().over(Window.orderBy("path")) - 1).cast("int"))
    df = files.join(paths.select("path", *names), "path").select(*names, "content", "path").mapInArrow(_file_batches(ending, list(array.shape), len(names)), ", ".join([f"{n} int" for n in names] + ["data array<double>"]))
    kind = {"b": "bool", "u": str(array.dtype), "i": "int64"}.get(array.dtype.kind, "float32")
    return ArrayFrame(df, names, space, array.shape, kind)


def imread_collection(spark: SparkSession, pattern: str) -> DataDict:
    """A frame for each file of a pattern, by its name without the ending; shapes may differ. Only names come to the driver here, contents stay with the tasks of each frame."""
    ending = extension(pattern, _READERS)
    paths = [r[0] for r in spark.read.format("binaryFile").load(pattern).select("path").orderBy("path").collect()]
    return DataDict({p.rsplit("/", 1)[-1][: -len(ending)]: read_files(spark, p) for p in paths})


def write_file(frame: ArrayFrame, path: str) -> None:
    """A small frame as one array file on the driver's file system."""
    ending = extension(path, _WRITERS)
    array = frame.to_numpy()
    kind = {"float32": np.float32, "uint8": np.uint8, "uint16": np.uint16, "bool": bool, "int64": np.int64}.get(frame.dtype, float)
    with open(path, "wb") as f:
        f.write(_WRITERS[ending](array.astype(kind), frame.axes))


# generators ---------------------------------------------------------------------


def full(spark: SparkSession, shape: tuple[int, ...], value: float, axes: str, dtype: str = "uint16") -> ArrayFrame:
    """A constant frame, made on the executors: spatial axes are zyx among the axes."""
    axes_ = Axes.of(axes)
    if len(axes_) != len(shape):
        raise AxesError(f"axes {axes_} do not fit the shape {shape}")
    space = [a for a in axes_.names if a in "zyx"]
    batch = [a for a in axes_.names if a not in space]
    size = dict(zip(axes_.names, shape))
    n = int(np.prod([size[b] for b in batch])) if batch else 1
    df, stride = spark.range(n), 1
    cols = {}
    for b in reversed(batch):
        cols[b] = F.expr(f"cast((id div {stride}) % {size[b]} as int)")
        stride *= size[b]
    k = int(np.prod([size[a] for a in space]))
    return ArrayFrame(df.select(*[cols[b].alias(b) for b in batch], F.array_repeat(F.lit(float(value)), k).alias("data")), batch, space, [size[a] for a in space], dtype, known=size)


def zeros(spark, shape, axes, dtype="uint16"):
    return full(spark, shape, 0, axes, dtype)


def ones(spark, shape, axes, dtype="uint16"):
    return full(spark, shape, 1, axes, dtype)


def random(spark: SparkSession, shape: tuple[int, ...], axes: str, kind: str = "uniform", seed: int = 0, **options) -> ArrayFrame:
    """uniform, normal, exponential, poisson, uint8 (255 never occurs) or uint16; the same values for a seed, whatever the partitions."""

    def run(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape)
        for i, k in enumerate(at.reshape(len(x), -1)[:, 0]):
            g = np.random.default_rng([seed, int(k)])
            out[i] = {"uniform": lambda: g.random(x.shape[1:]), "normal": lambda: g.normal(options.get("loc", 0.0), options.get("scale", 1.0), x.shape[1:]), "exponential": lambda: g.standard_exponential(x.shape[1:]), "poisson": lambda: g.poisson(options.get("lam", 1.0), x.shape[1:]), "uint8": lambda: g.integers(0, 255, x.shape[1:]), "uint16": lambda: g.integers(0, 65535, x.shape[1:])}[kind]()
        return out

    base = zeros(spark, shape, axes, kind if kind.startswith("uint") else "float32")
    number, stride = F.lit(0), 1
    for b, n in reversed([(a, s) for a, s in zip(Axes.of(axes).names, shape) if a not in "zyx"]):
        number, stride = number + F.col(b) * stride, stride * n
    ids = ArrayFrame(base.df.withColumn("data", F.array(number.cast("double"))), base.batch, "k", (1,), "int64")
    return base.map_with(ids, run)


def gaussian_kernel(shape, sigma=1.0, peak: float = 1.0) -> np.ndarray:
    sigma = np.broadcast_to(np.asarray(sigma, float), len(shape))
    g = np.meshgrid(*[(np.arange(n) - (n - 1) / 2) / s for n, s in zip(shape, sigma)], indexing="ij")
    return peak * np.exp(-0.5 * sum(a**2 for a in g))


def circular_mask(radius, shape, centre=None, soft: bool = False, out_value: bool = True) -> np.ndarray:
    """True outside of the ellipse by default; a soft edge falls off over one pixel."""
    centre = [(n - 1) / 2 for n in shape] if centre is None else centre
    r = np.broadcast_to(np.asarray(radius, float), len(shape))
    d = np.sqrt(sum(((a - c) / q) ** 2 for a, c, q in zip(np.meshgrid(*[np.arange(n) for n in shape], indexing="ij"), centre, r)))
    if soft:
        inside = np.clip((1 - d) * r.mean() + 0.5, 0, 1)
        return 1 - inside if out_value else inside
    return d > 1 if out_value else d <= 1
