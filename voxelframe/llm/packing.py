"""Best-fit packing of token sequences by large-item matching.

Documents become token ids plus an end id; those over the capacity are cut
into pieces of the capacity, the first of which may be shorter.  Pieces above
a third of the capacity fit at most twice into a sequence: from the longest
down, each is matched with the longest other one that still fits, which
leaves the fewest sequences for them.  The shorter pieces, from the longest
down, go to the tightest gap left, and open new sequences when none fits.

All this is decided on the histogram of lengths: at most ``capacity`` counts
reach the driver, whatever the size of the corpus, and equal sequences are
handled together, so the plan's size is bounded by the capacity, too.  Pieces
find their place by their rank among the pieces of the same length; ranks come
from counts per (length, bucket) and a rank within the bucket, so no length,
however frequent, is gathered in one task.

Token ids are those of the ``tokenizers`` file without added special tokens.
The rank file of the same vocabulary gives the same ids several times faster
and is used for texts without a special token's string.

Defined results: null text is empty (one piece, the end id).  Repeated rows
are packed each.  Null doc_id is kept.  An empty table gives an empty result.
"""

from __future__ import annotations

import base64
import functools
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Scratch, lean, pack_columns

CAPACITY, END = 2048, 0


@functools.lru_cache(4)
def encoder(json_path: str | None = None, rank_path: str | None = None):
    """A function from text to uint32 ids."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(json_path or public_tokenizers.path("byte_bpe_50k.json"))
    special = [t.content for t in slow.get_added_tokens_decoder().values()]
    with open(rank_path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def by_file(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return by_file(text)
        try:
            return np.array(fast.encode_ordinary(text), np.uint32)
        except BaseException as error:  # the rank encoder gives up on some very long runs of blanks
            if type(error).__name__ != "PanicException":
                raise
            return by_file(text)

    return encode


def cut(ids: np.ndarray, capacity: int) -> list[tuple[int, int]]:
    """Start and length of each piece; the first may be shorter."""
    n = -(-len(ids) // capacity)
    head = len(ids) - capacity * (n - 1)
    return [(0, head), *((head + capacity * i, capacity) for i in range(n - 1))]


def _piece_batches(capacity: int, paths: tuple, keep_ids: bool):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(*paths)
        for batch in batches:
            doc, piece, start, length, crc, kept = [], [], [], [], [], []
            for d, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), np.uint32(END)).astype("<u4")
                for i, (s, n) in enumerate(cut(ids, capacity)):
                    part = ids[s : s + n]
                    doc.append(d), piece.append(i), start.append(s), length.append(n), crc.append(zlib.crc32(part.tobytes()))
                    if keep_ids:
                        kept.append(part.astype(np.int32))
            cols = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if keep_ids:
                cols, names = [*cols, pa.array(kept, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def pieces(docs: DataFrame, capacity: int = CAPACITY, json_path: str | None = None, rank_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32 (and ids)."""
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * keep_ids
    return pack_columns(docs, "doc_id", "text").mapInArrow(_piece_batches(capacity, (json_path, rank_path), keep_ids), schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Slots (length, first rank, bins, per bin, first sequence, offset) for all pieces.

    A slot puts ``per bin`` pieces of a length one after the other, from the
    offset on, into each of ``bins`` sequences with consecutive numbers.
    """
    left, rank, slots, sequences = dict(counts), dict.fromkeys(counts, 0), [], 0
    gaps: dict[int, list[tuple[int, int]]] = {}
    free: list[int] = []

    def put(size: int, bins: int, each: int, first: int, offset: int) -> None:
        slots.append((size, rank[size], bins, each, first, offset))
        rank[size] += bins * each
        left[size] -= bins * each

    def leave(gap: int, first: int, bins: int) -> None:
        if gap and bins:
            if gap not in gaps:
                gaps[gap] = []
                insort(free, gap)
            gaps[gap].append((first, bins))

    large = sorted(s for s in counts if 3 * s > capacity)
    for a in reversed(large):
        while left[a]:
            i = bisect_left(large, min(a, capacity - a) + 1) - 1
            while i >= 0 and left[large[i]] < (2 if large[i] == a else 1):
                i -= 1
            if i < 0:
                bins = left[a]
                put(a, bins, 1, sequences, 0)
                leave(capacity - a, sequences, bins)
            elif large[i] == a:
                bins = left[a] // 2
                put(a, bins, 2, sequences, 0)
                leave(capacity - 2 * a, sequences, bins)
            else:
                b = large[i]
                bins = min(left[a], left[b])
                put(a, bins, 1, sequences, 0)
                put(b, bins, 1, sequences, a)
                leave(capacity - a - b, sequences, bins)
            sequences += bins
    for s in sorted((s for s in counts if 3 * s <= capacity), reverse=True):
        while left[s]:
            i = bisect_left(free, s)
            if i < len(free):
                gap = free[i]
                first, bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], free[i]
            else:
                gap, first, bins = capacity, sequences, -(-left[s] // (capacity // s))
                sequences += bins
            each = min(gap // s, left[s])
            full = min(bins, left[s] // each)
            put(s, full, each, first, capacity - gap)
            leave(gap - each * s, first, full)
            rest = min(left[s], each) if full < bins else 0
            if rest:
                put(s, 1, rest, first + full, capacity - gap)
                leave(gap - rest * s, first + full, 1)
                full += 1
            leave(gap, first + full, bins - full)
    return slots


def pack(rows: DataFrame, capacity: int = CAPACITY, bucket_rows: int = 100_000) -> DataFrame:
    """The rows (with doc_id, piece, length) and their sequence_id and offset."""
    spark = rows.sparkSession
    total = rows.count()
    rows = rows.withColumn("bucket", F.expr(f"pmod(xxhash64(doc_id, piece), {max(1, total // bucket_rows)})"))
    counts = rows.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    schema = "length bigint, first_rank bigint, bins bigint, each bigint, first_sequence bigint, at bigint"
    slots = spark.createDataFrame(plan(histogram, capacity), schema)
    local = Window.partitionBy("length", "bucket").orderBy(*[c for c in ("doc_id", "piece", "start", "ids_crc32") if c in rows.columns])
    ranked = rows.withColumn("local", F.row_number().over(local) - 1).join(base, ["length", "bucket"]).withColumn("rank", F.col("base") + F.col("local"))
    placed = ranked.join(F.broadcast(slots), "length").where("rank >= first_rank and rank < first_rank + bins * each").withColumn("k", F.expr("rank - first_rank"))
    return placed.withColumns({"sequence_id": F.expr("first_sequence + k div each"), "offset": F.expr("at + (k % each) * length")}).select(*[c for c in rows.columns if c != "bucket"], "sequence_id", "offset")


def best_fit_packing(docs: DataFrame, capacity: int = CAPACITY, **options) -> DataFrame:
    """One row per piece with its sequence and place."""
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(scratch.keep(pieces(docs, capacity, **options), "pieces"), capacity)
