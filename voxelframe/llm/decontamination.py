"""Benchmark decontamination by template canonicalisation.

A text becomes a sequence of canonical tokens: words in lower case without
outer punctuation, and typed placeholders for numbers (any word with a digit),
names (a run of words with a capital and then a
small letter, not at a sentence's start) and units (a unit
word after a number).  Windows of ``window`` tokens are hashed and joined with
the windows of the benchmark's items.  Where windows meet, the values behind
their placeholders are compared: an item's value must stand for one value
throughout an occurrence.  A question asked again with other numbers or names
passes this check; chance meetings of templates mostly don't.

An occurrence is what a document holds at one distance between its places and
the item's: at the same distance exactly, or (words put in or left out) within
the item's length, or in the whole document.  A document is contaminated by an
item if the windows found in one of its occurrences cover at least ``coverage``
of the item's windows and at least ``consistency`` of the slots keep to the
most frequent value, so copies beside it, with other values, take nothing away.

Windows of which more than half are placeholders would meet any row of numbers
by their template; they are hashed with the values and meet only where these
agree.  What a copy with other values covers is measured on the windows that it
can have: coverage is the greater of the shares of all windows, and of those
that meet by template.  Items with fewer tokens than a window count
as one window of their own length (three tokens at least).

A bitmap of fixed size of the benchmark's window hashes goes to the executors
to skip windows that meet none; what passes is joined exactly by hash, so
neither a large benchmark nor a passage that thousands of documents share
gathers rows on the driver or in one task (hits are counted per document and
item).

Defined results: null text has no tokens.  Rows with equal doc_id count as one
document.  Null doc_id or item_id rows are kept out of the join.  Repeated
items each count.  An empty benchmark leaves every document clean.  Further
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .bitmaps import bitmap, hit
from .shared import Scratch, lean
from .toxicity import _PUNCT

WINDOW, COVERAGE, CONSISTENCY = 8, 0.25, 0.8
UNITS = ("mm cm m km in ft yd mi mile miles g kg mg lb lbs oz ton tons l ml s sec second seconds min minute minutes h hour hours day days week weeks month months year years "
         "usd eur dollar dollars cent cents euro euros percent mph kph degrees celsius fahrenheit watt watts volt volts").split()  # fmt: skip

_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_SMALL = np.zeros(256, bool)
_SMALL[97:123] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:"]] = True
WORD, NUMBER, NAME, UNIT = range(4)
#: Keeps hashes with values apart from those of templates.
DENSE = 1 << 40
_PLACE = B.mix(np.arange(1, 5, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))


def _lower(data: np.ndarray) -> np.ndarray:
    """ASCII and Latin-1 letters in lower case."""
    out = np.where(_UPPER[data], data + 32, data).astype(np.uint8)
    if len(data) > 1:
        accented = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
        out[1:][accented] += 0x20
    return out


_UNIT_HASHES = np.sort(np.concatenate([(b := B.Block(np.frombuffer(u.encode(), np.uint8), np.array([0, len(u)]), 0)).hashes(np.array([0]), np.array([len(u)])) for u in UNITS]))


def canonical(b: B.Block) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes, their kinds, hashes of the values behind them, and the first token of each document."""
    starts, ends, first = b.words()
    solid = np.flatnonzero(~_PUNCT[b.data])
    left, right = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    some = right > left  # words of punctuation alone are no tokens
    cs, ce = starts.copy(), ends.copy()
    if len(solid):
        cs = np.where(some, solid[np.minimum(left, len(solid) - 1)], starts)
        ce = np.where(some, solid[np.maximum(right, 1) - 1] + 1, ends)
    low = B.Block(_lower(b.data), b.off, b.first)
    value = low.hashes(cs, ce)
    digits = np.concatenate([[0], np.cumsum(_DIGIT[b.data])])
    number = digits[ce] > digits[cs]
    n = len(starts)
    head = b.data[cs] if n else np.zeros(0, np.uint8)
    second = b.data[np.minimum(cs + 1, len(b.data) - 1)] if n else head
    accented = (head == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    then = cs + 1 + accented  # a small letter must follow: words in capitals throughout are no names
    far = np.minimum(np.stack([then, then + 1]), max(0, len(b.data) - 1))
    small = (then < ce) & (_SMALL[b.data[far[0]]] | ((b.data[far[0]] == 0xC3) & (b.data[far[1]] >= 0xA0))) if n else np.zeros(0, bool)
    capital = (_UPPER[head] | accented) & small
    opens = np.ones(n, bool)  # at the start of a sentence, line or text
    if n > 1:
        lines = np.concatenate([[0], np.cumsum(b.data == 0x0A)])
        opens[1:] = _STOP[b.data[ends[:-1] - 1]] | (lines[starts[1:]] > lines[ends[:-1]])
    opens[first[:-1][first[:-1] < n]] = True
    kind = np.where(number, NUMBER, np.where(capital & ~opens, NAME, WORD))
    after = np.zeros(n, bool)
    after[1:] = number[:-1]
    after[first[:-1][first[:-1] < n]] = False
    kind[after & (kind == WORD) & np.isin(value, _UNIT_HASHES)] = UNIT
    follows = np.zeros(n, bool)
    follows[1:] = (kind[1:] == NAME) & (kind[:-1] == NAME)
    follows[first[:-1][first[:-1] < n]] = False
    keep = some & ~follows
    first = np.concatenate([[0], np.cumsum(keep)])[first]
    kind, value = kind[keep], value[keep]
    return np.where(kind == WORD, value, _PLACE[kind]), kind, value, first


def _window_batches(lengths: list[int], window: int, table: np.ndarray | None):
    """Windows of the given lengths; without a table (the benchmark) each text's own: of ``window`` tokens, or all of a shorter text."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for b in B.blocks(batch.column(1)):
                token, kind, value, first = canonical(b)
                doc = np.repeat(np.arange(b.n), np.diff(first))
                size = np.diff(first)[doc] if len(doc) else doc
                slots = np.concatenate([[0], np.cumsum(kind != WORD)])
                for k in sorted({*lengths, window}) if table is not None else [*range(3, window + 1)]:
                    h = B.windows(token, k) ^ np.uint64(k)
                    ok = B.inside(first, len(token), k)
                    dense = 2 * (slots[k:] - slots[: len(slots) - k]) > k if len(slots) > k else ~ok  # most of the tokens are placeholders
                    if dense.any():
                        h = np.where(dense, B.windows(value, k) ^ np.uint64(k + DENSE), h)
                    if table is None:
                        ok &= (size[: len(h)] >= k) if k == window else (size[: len(h)] == k)
                    else:
                        ok &= hit(table, h)
                    for i in np.flatnonzero(ok):
                        at = np.flatnonzero(kind[i : i + k] != WORD) + i if not dense[i] else np.zeros(0, np.int64)  # their values are in the hash
                        rows.append((ids[b.first + doc[i]], int(i - first[doc[i]]), int(h[i].astype(np.int64)), k, bool(dense[i]), value[at].view(np.int64).tolist()))
            cols = list(zip(*rows)) or [[]] * 6
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], ["id", "place", "h", "k", "dense", "slots"])

    return run


_SCHEMA = "id bigint, place int, h bigint, k int, dense boolean, slots array<bigint>"


def _occurrences() -> Column:
    """The occurrences that a window found at ``at`` for ``place`` is part of: at its distance, in two rows of ranges as wide as the item (the second half a range on), and in the whole document."""
    away = F.col("at") - F.col("place")
    ranges = [F.floor((away + shift) / F.col("length")) for shift in (F.lit(0), F.floor(F.col("length") / 2))]
    kinds = [away, *ranges, F.lit(0)]
    return F.array(*[F.struct(F.lit(i).alias("kind"), k.cast("bigint").alias("n")) for i, k in enumerate(kinds)])


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, consistency: float = CONSISTENCY) -> DataFrame:
    """doc_id, item_id, share of the item's windows found, and consistency of the slots, of each contaminated document and item, where it holds most of it."""
    scratch = Scratch(docs.sparkSession, "templates")
    items = benchmark.select(F.col("item_id").cast("bigint").alias("id"), "text").where("id is not null")
    items = scratch.keep(items.mapInArrow(_window_batches([], window, None), _SCHEMA), "items")
    lengths = [r["k"] for r in items.select("k").distinct().collect()]  # at most ``window`` values
    table = bitmap(items)
    found = docs.select("doc_id", "text").where("doc_id is not null").mapInArrow(_window_batches(lengths, window, table), _SCHEMA).withColumnsRenamed({"id": "doc_id", "place": "at", "slots": "values"})
    open_ = F.when(~F.col("dense"), F.col("place"))
    total = items.groupBy(F.col("id").alias("item_id")).agg(F.countDistinct("place").alias("windows"), F.countDistinct(open_).alias("open"), F.max(F.col("place") + F.col("k")).alias("length"))
    met = found.join(items, ["h", "k", "dense"]).where("size(slots) = size(values)").withColumnRenamed("id", "item_id")
    met = scratch.keep(met.select("doc_id", "item_id", "place", "at", "dense", "slots", "values"), "met")
    share = F.round(F.greatest(F.countDistinct("place") / F.first("windows"), F.countDistinct(open_) / F.nullif(F.first("open"), F.lit(0))), 6).alias("coverage")
    whole = met.join(total, "item_id").groupBy("doc_id", "item_id", "length").agg(share).where(F.col("coverage") >= coverage)
    # no occurrence covers more than the whole document
    met = met.join(whole.select("doc_id", "item_id", "length"), ["doc_id", "item_id"]).withColumn("occurrence", F.explode(_occurrences()))
    by = ["doc_id", "item_id", "occurrence"]
    covered = met.join(total.drop("length"), "item_id").groupBy(*by).agg(share).where(F.col("coverage") >= coverage)
    pairs = met.select(*by, F.explode(F.arrays_zip("slots", "values")).alias("s")).groupBy(*by, "s.slots", "s.values").agg(F.count("*").alias("n"))
    slot = pairs.groupBy(*by, "slots").agg(F.max("n").alias("most"), F.sum("n").alias("all"))
    agreed = slot.groupBy(*by).agg((F.sum("most") / F.sum("all")).alias("agreed"))
    rows = covered.join(agreed, by, "left").withColumn("consistency", F.round(F.coalesce("agreed", F.lit(1.0)), 6)).where(F.col("consistency") >= consistency)
    return rows.groupBy("doc_id", "item_id").agg(F.max(F.struct("coverage", "consistency")).alias("best")).select("doc_id", "item_id", "best.*")


def decontamination(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, contaminated, the items found in it (sorted) and the greatest coverage."""
    hits = contaminated(docs, benchmark, **options).groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.max("coverage").alias("coverage"))
    rows = docs.select("doc_id").distinct().join(hits, "doc_id", "left")
    return rows.select("doc_id", F.col("item_ids").isNotNull().alias("contaminated"), F.coalesce("item_ids", F.array().cast("array<bigint>")).alias("item_ids"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"))
