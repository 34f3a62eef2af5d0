"""Short codes of vectors: each part of a vector becomes the number of its nearest codebook entry (product quantisation).

Vectors become rows of whole numbers and are dealt to blocks where they are
read, without a shuffle.  Every block has one metric tree for each part
(``anchors``), built once and written with the block.  A round sends the codebooks to
all tasks (parts * entries * width numbers, whatever the number of vectors); a
task walks its trees, where a ball that one entry wholly owns adds its cached
sum and count, and hands over one row per part and entry.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import anchors
from .blobs import pack, unpack
from .shared import Scratch, lean, pack_columns

#: Vectors of a block; a block with its trees is about 600 bytes a vector of 64 numbers.
BLOCK = 4096
#: Scaled components go no further than this, so that squared distances of parts up to 4096 wide are exact in 64 bits.
LARGEST = 1 << 24


def whole(x: np.ndarray, scale: float) -> np.ndarray:
    return np.clip(np.floor(scale * x.astype(float)), -LARGEST, LARGEST).astype(np.int64)


def _blocks(width: int, parts: int, scale: float, names: list[str], kinds: list[pa.DataType]) -> Callable:
    padded = -(-width // parts) * parts

    def block(ids: list, marks: list, x: np.ndarray) -> pa.RecordBatch:
        trees = [pack(*anchors.build(p).arrays()) for p in np.split(x, parts, axis=1)] if padded else [b""] * parts
        columns = [pa.array([ids], pa.list_(kinds[0])), pa.array([marks], pa.list_(kinds[1])), pa.array([x.astype("<i4").tobytes()], pa.binary()), pa.array([trees], pa.list_(pa.binary()))]
        return pa.RecordBatch.from_arrays(columns, ["ids", "marks", "x", "trees"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, marks, rows, n = [], [], [], 0
        for batch in batches:
            x = np.zeros((batch.num_rows, padded), np.int64)
            x[:, :width] = whole(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, width), scale) if width else 0
            ids += batch.column(0).to_pylist()
            marks += batch.column(1).to_pylist()
            rows.append(x)
            n += len(x)
            if n >= BLOCK:
                x = np.concatenate(rows)
                for a in range(0, n - n % BLOCK, BLOCK):
                    yield block(ids[a : a + BLOCK], marks[a : a + BLOCK], x[a : a + BLOCK])
                a = n - n % BLOCK
                ids, marks, rows, n = ids[a:], marks[a:], [x[a:]], n - a
        if n:
            yield block(ids, marks, np.concatenate(rows))

    return run


def _read(row: dict, books: np.ndarray) -> Iterator[tuple[int, anchors.Tree, np.ndarray]]:
    """part, tree and points of each part of a block."""
    parts, _, width = books.shape
    x = np.frombuffer(row["x"], "<i4").reshape(len(row["ids"]), parts, width)
    for p, tree in enumerate(row["trees"]):
        yield p, anchors.Tree.of(unpack(tree, *anchors.Tree.KINDS)), x[:, p].astype(np.int64)


def _sums(books: np.ndarray) -> Callable:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros(books.shape[:2], np.int64), np.zeros(books.shape, np.int64)
        for batch in batches:
            for row in batch.to_pylist():
                for p, tree, x in _read(row, books):
                    anchors.add_up(tree, x, books[p], counts[p], sums[p])
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry]), pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))], ["part", "entry", "n", "s"])

    return run


def _codes(books: np.ndarray, kinds: list[pa.DataType]) -> Callable:
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                n = len(row["ids"])
                code, error = np.zeros((n, len(books)), np.int64), np.zeros(n, np.int64)
                if books.shape[2]:
                    for p, tree, x in _read(row, books):
                        code[:, p] = anchors.labels(tree, x, books[p])
                        error += ((x - books[p][code[:, p]]) ** 2).sum(axis=1)
                text = ["".join(f"{c:02x}" for c in r) for r in code.tolist()]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], kinds[0]), pa.array(row["marks"], kinds[1]), pa.array(text), pa.array(error)], ["vec_id", "label", "code", "error"])

    return run


def finite(vector: str) -> str:
    """SQL condition: the array is not null, and so are all its numbers, which are finite."""
    return f"{vector} is not null and forall({vector}, x -> x is not null and not isnan(x) and abs(x) < double('inf'))"


def vector_codes(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: float = 1024.0, vector: str = "embedding") -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of each vector (vec_id, embedding, label).

    Vectors that are null or hold null or non-finite numbers are dropped, and so are
    those not as long as the kept vector with the smallest vec_id.  Components become floor(scale * x), at most LARGEST in size;
    a length that the parts do not divide is filled up with zeros at the end.
    The codebooks start as the parts of the vectors with the smallest vec_ids (null
    ids last, rows of one id by their vectors, repeated rows count each); with
    fewer vectors than entries there are fewer entries.  Ties go to the lower
    entry, unused entries stay.  An empty table gives no rows.  Further columns
    are not read.
    """
    if entries > 256:
        raise ValueError("an entry's number has two hexadecimal digits")
    spark = vectors.sparkSession
    rows = pack_columns(vectors, "vec_id", "label", vector).toDF("vec_id", "label", "v").withColumn("v", F.col("v").cast("array<double>")).where(finite("v"))
    ranked = [F.col("vec_id").asc_nulls_last(), F.col("v")]
    least = rows.orderBy(*ranked).limit(1).collect()
    width = len(least[0]["v"]) if least else 0
    rows = rows.where(F.size("v") == width)
    start = [r["v"] for r in rows.orderBy(*ranked).limit(entries).select("v").collect()]
    start = np.array(start, float).reshape(len(start), width)
    padded = -(-width // parts) * parts
    books = np.zeros((len(start), padded), np.int64)
    books[:, :width] = whole(start, scale)
    books = books.reshape(len(start), parts, padded // parts).transpose(1, 0, 2).copy()

    kinds = [f.dataType for f in rows.schema.fields[:2]]
    arrow = [f.type for f in _arrow(rows.select("vec_id", "label"))]
    names = [k.simpleString() for k in kinds]
    scratch = Scratch(spark, "vector-codes")
    schema = f"ids array<{names[0]}>, marks array<{names[1]}>, x binary, trees array<binary>"
    blocks = scratch.keep(rows.mapInArrow(_blocks(width, parts, scale, names, arrow), schema), "blocks")
    for _ in range(rounds if padded else 0):
        sums = blocks.mapInArrow(_sums(books), "part int, entry int, n bigint, s array<bigint>")
        total = sums.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("s")[i]) for i in range(padded // parts)]).alias("s"))
        for r in total.collect():  # parts * entries rows at most
            books[r["part"], r["entry"]] = np.array(r["s"]) // r["n"]
    digest = hashlib.sha256(",".join(str(c) for c in books.ravel().tolist()).encode()).hexdigest()
    coded = scratch.keep(blocks.mapInArrow(_codes(books, arrow), f"vec_id {names[0]}, label {names[1]}, code string, error bigint"), "codes")
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "of")
    joined = coded.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _arrow(df: DataFrame) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(df.schema)
