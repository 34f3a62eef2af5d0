"""Exact Jaccard self-join of word n-gram sets by vertical partitioning.

A document's set holds its distinct runs of ``n`` words (its whole sequence,
if it has fewer words).  All n-grams have one global order: those on a bounded
list of frequent ones last, the most frequent at the end, the rest by hash.
Any order gives the right result; this one keeps common passages out of the
prefixes.  The order is cut into FRAGMENTS, which do their part of the work
apart from each other:

1. Equal sets are one set, known by the hash of its n-grams.
2. Two sets that are similar enough share an n-gram among the first of each in
   the global order (prefix filter), and what is left of both from their first
   common one on is enough (positional filter).  In each fragment, the sets under an
   n-gram are paired with the least of them only, after a task has done the
   same with its own, so a group of any size sends one row per task and gives
   as many pairs as it has members.
3. Pairs whose signatures differ in more bits than similar sets can are out.
   A signature is as wide as its set is large, so few other pairs pass.
   For each pair, every fragment counts the overlap of the two sets
   within it; the counts are summed per pair and compared with the threshold.
4. Connected components of the links.  Where an n-gram still has sets of
   different components under it, a bounded list of its sets is laid beside the
   others; of all possible pairs between two components the one whose
   signatures are nearest is counted, and the components are made again.  Then
   all possible pairs that are still apart and uncounted are.  Pairs within a
   component need no count.  So no link between components is lost, and a
   group of near copies is not expanded into all its pairs.

Defined results: null texts and texts without words have an empty set that is
linked with nothing, and are their own component.  Rows with null doc_id take
no part in a component's least doc_id; among themselves their component is
null.  Rows that repeat a doc_id are rows of their own with that id.  Further
columns are ignored.  Sets are told apart by 64-bit hashes of their n-grams.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .bitmaps import bitmap, hit
from .blobs import by_bucket, groups, pack, unpack
from .components import components
from .shared import Scratch, lean, partitions

N, PERCENT = 5, 80
#: Frequent n-grams that a task reports, and that the global order knows.
TASK_FREQUENT, FREQUENT = 20_000, 1 << 17
#: Where the order of the n-grams that are not listed is cut, as shares of the hashes: prefixes are at its beginning.
CUTS = (1 / 16, 1 / 8, 1 / 4, 1 / 2)
FRAGMENTS = len(CUTS) + 2
#: n-grams in the blobs that meet a copy of a leader's, and bytes of a bucket.
SHARE, BUCKET_BYTES = 1 << 20, 4 << 20
#: Least bits of a signature.
SHORT = 1024
#: About so many sets of each n-gram are laid beside the others; n-grams with no more have all their pairs this way.
LEADERS_TESTED = 32


def sets(b: B.Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram hashes of each document, sorted, and where each document's begin (n + 1 places)."""
    starts, ends, first = b.words()
    words = b.hashes(starts, ends, B.LUT_LOWER)
    doc = np.repeat(np.arange(b.n), np.diff(first))
    h = B.windows(words, n)
    ok = B.inside(first, len(words), n)
    h, of = h[ok], doc[: len(ok)][ok]
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        whole = [B.windows(words[first[d] : first[d + 1]], int(size[d])) + np.uint64(size[d]) for d in short]
        h, of = np.concatenate([h, *whole]), np.concatenate([of, short])
    order = np.lexsort((h, of))
    h, of = h[order], of[order]
    g = groups(of, h)[:-1]
    h, of = h[g], of[g]
    return h, np.searchsorted(of, np.arange(b.n + 1))


def identity(h: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    x = B.mix(h ^ np.uint64(0x5DEECE66D1234567))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(x, out=total[1:])
    return B.mix((total[first[1:]] - total[first[:-1]]) + np.diff(first).astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))


def signature(h: np.ndarray, first: np.ndarray) -> list[bytes]:
    """Bits of each set, twice as many as it has n-grams and SHORT at least: whether an odd number of n-grams fall on the bit.  Each bit in which two sets differ takes an n-gram that only one of them has."""
    size = np.maximum(np.diff(first), SHORT // 2)
    width = np.left_shift(1, np.ceil(np.log2(2 * size)).astype(np.int64))
    begin = np.concatenate([[0], np.cumsum(width)])
    doc = np.repeat(np.arange(len(width)), np.diff(first))
    bit = begin[doc] + (B.mix(h) & (width[doc] - 1).astype(np.uint64)).astype(np.int64)
    bits = np.packbits((np.bincount(bit, minlength=int(begin[-1])) & 1).astype(bool)).tobytes()
    return [bits[i // 8 : j // 8] for i, j in zip(begin[:-1], begin[1:])]


def differing(x: pa.Array, y: pa.Array) -> np.ndarray:
    """Bits in which signatures differ, the wider one folded to the width of the other."""
    wide = np.stack([pc.binary_length(v).to_numpy(zero_copy_only=False) for v in (x, y)], 1)
    out = np.zeros(len(x), np.int64)
    for p, q in np.unique(wide, axis=0):
        rows = np.flatnonzero((wide == (p, q)).all(1))
        a, b = (np.frombuffer(b"".join(v.take(pa.array(rows)).to_pylist()), np.uint8).reshape(len(rows), -1, min(p, q)) for v in (x, y))
        out[rows] = np.bitwise_count(np.bitwise_xor.reduce(a, 1) ^ np.bitwise_xor.reduce(b, 1)).sum(1)
    return out


@lean
def _short_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sid, and its signature folded to SHORT bits."""
    for batch in batches:
        rows = [np.bitwise_xor.reduce(np.frombuffer(x, "<i8").reshape(-1, SHORT // 64), 0) for x in batch.column(1).to_pylist()]
        flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(np.arange(len(rows) + 1, dtype=np.int32) * (SHORT // 64), flat)], ["sid", "short"])


def _batch_sets(column: pa.Array, n: int, signed: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts, sizes = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    ids = [np.zeros(0, np.uint64)]
    for b in B.blocks(column):
        h, first = sets(b, n)
        parts.append(h), sizes.append(np.diff(first)), ids.append(identity(h, first))
        if signed is not None:
            signed.append(signature(h, first))
    return np.concatenate(parts), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(ids)


def _distinct(first: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One row of each non-empty set."""
    rows = np.flatnonzero(np.diff(first) > 0)
    return rows[np.unique(ids[rows], return_index=True)[1]]


def _take(h: np.ndarray, first: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of some rows, and which row (its place among them) each is of."""
    size = first[rows + 1] - first[rows]
    begin = np.concatenate([[0], np.cumsum(size)])
    return h[np.arange(begin[-1]) + np.repeat(first[rows] - begin[:-1], size)], np.repeat(np.arange(len(rows)), size)


def _profile_batches(n: int):
    """doc_id, size, hash and signature of each set; and (without doc_id) n-grams that several sets of the task have, with their number."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, 1):
            signed: list = []
            h, first, ids = _batch_sets(batch.column(1), n, signed)
            values, _ = _take(h, first, _distinct(first, ids))
            values, count = np.unique(values, return_counts=True)
            at = np.flatnonzero(count >= 2)
            at = at[np.argsort(-count[at], kind="stable")[:TASK_FREQUENT]]
            doc = pa.concat_arrays([batch.column(0), pa.nulls(len(at), pa.int64())])
            size = np.concatenate([np.diff(first), count[at]])
            key = np.concatenate([ids, values[at]]).view(np.int64)
            kind = np.repeat([0, 1], [batch.num_rows, len(at)])
            bits = pa.array([*itertools.chain(*signed), *[None] * len(at)], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(kind, pa.int32()), doc, pa.array(size, pa.int64()), pa.array(key, pa.int64()), bits], ["kind", "doc_id", "n", "sid", "bits"])

    return run


class Order:
    """The global order of n-grams: by how often they occur if they are listed (else 0), then by hash."""

    def __init__(self, listed: np.ndarray, counts: np.ndarray) -> None:
        by = np.argsort(listed)
        self.listed, self.counts = listed[by], counts[by]

    def often(self, h: np.ndarray) -> np.ndarray:
        if not len(self.listed):
            return np.zeros(len(h), np.int64)
        at = np.minimum(np.searchsorted(self.listed, h), len(self.listed) - 1)
        return np.where(self.listed[at] == h, self.counts[at], 0)

    @staticmethod
    def fragment(h: np.ndarray, often: np.ndarray) -> np.ndarray:
        """The part of the order that each n-gram is in."""
        edges = np.array([int(c * 2**64) for c in CUTS], np.uint64)
        return np.where(often > 0, FRAGMENTS - 1, np.searchsorted(edges, h, "right"))


def _key(h: np.ndarray, fragment: np.ndarray, per: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram, one of those of its fragment, and a key of bucket and short hash."""
    x = B.mix(h ^ np.uint64(0xC2B2AE3D27D4EB4F))
    bucket = fragment * per + ((x >> np.uint64(32)) % np.uint64(per)).astype(np.int64)
    return bucket, (bucket << 32) | (x & np.uint64(0xFFFFFFFF)).astype(np.int64)


PAIRS, MEMBER, LEADERS = range(3)
_PREFIX = "kind int, bucket int, a binary, b binary"


def _enough(n1: np.ndarray, left1: np.ndarray, n2: np.ndarray, left2: np.ndarray, percent: int) -> np.ndarray:
    """Whether two sets of n1 and n2 n-grams can be similar if the n-gram at hand is the first that they share: what is left of each from it on must do (this holds their sizes together, too)."""
    return (100 + percent) * np.minimum(left1, left2) >= percent * (n1 + n2)


def _prefix_batches(n: int, percent: int, per: int, grams: Order):
    """Three kinds of rows: pairs of the task's own sets, members (key, set) of groups, and for each bucket of a fragment the least own set under each n-gram."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, 0):
            h, first, ids = _batch_sets(batch.column(0), n)
            rows = _distinct(first, ids)  # by hash of set, so the first row of a group is the least set
            h, of = _take(h, first, rows)
            sid, size = ids[rows].view(np.int64), (first[rows + 1] - first[rows])
            order = np.argsort(sid, kind="stable")
            back = np.empty(len(order), np.int64)
            back[order] = np.arange(len(order))
            sid, size, of = sid[order], size[order], back[of]
            often = grams.often(h)
            order = np.lexsort((h, often, of))
            h, of, often = h[order], of[order], often[order]
            begin = np.searchsorted(of, np.arange(len(sid)))
            prefix = size - -(-percent * size // 100) + 1
            place = np.arange(len(h)) - begin[of]
            take = place < prefix[of]
            h, of = h[take], of[take]
            left = size[of] - place[take]  # n-grams from here on
            bucket, key = _key(h, grams.fragment(h, often[take]), per)
            order = np.lexsort((of, key))
            bucket, key, of, left = bucket[order], key[order], of[order], left[order]
            g = groups(key)
            count = np.diff(g)
            lead, number = np.repeat(g[:-1], count), np.repeat(count, count)
            out: list[tuple] = []
            rest = np.flatnonzero((np.arange(len(key)) != lead) & (of != of[lead]))
            if len(rest):
                close = rest[_enough(size[of[lead[rest]]], left[lead[rest]], size[of[rest]], left[rest], percent)]
                pair = np.unique(of[lead[close]] * len(sid) + of[close])
                x, y = pair // len(sid), pair % len(sid)
                out.append((PAIRS, None, pack(sid[x], size[x]), pack(sid[y], size[y])))
                at = np.flatnonzero(((np.arange(len(key)) != lead) & (of != of[lead])) | (number >= 3))
                out.append((MEMBER, None, pack(key[at], left[at]), pack(sid[of[at]], size[of[at]])))
            lead = g[:-1]
            o, which, cut = by_bucket(bucket[lead])
            for i, k in enumerate(which):
                part = lead[o[cut[i] : cut[i + 1]]]
                names, inv = np.unique(of[part], return_inverse=True)
                many = (count[o[cut[i] : cut[i + 1]]] > 1).astype(np.uint8)
                short = (key[part] & 0xFFFFFFFF).astype(np.uint32)
                out.append((LEADERS, int(k), pack(short, inv.astype(np.uint16 if len(names) < 65536 else np.uint32), many, left[part].astype(np.uint32)), pack(sid[names], size[names].astype(np.uint32))))
            cols = list(zip(*out)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["kind", "bucket", "a", "b"])

    return run


def _fragment(percent: int):
    def run(key, table):
        """Pairs of the least set under each n-gram with the others, and members of groups of three or more."""
        hs, sids, sizes, many, lefts = [], [], [], [], []
        for a, b in zip(table.column("a").to_pylist(), table.column("b").to_pylist()):
            short, inv, m, left = unpack(a, "<u4", "<u2" if a[13] == 2 else "<u4", "u1", "<u4")
            sid, size = unpack(b, "<i8", "<u4")
            size = size.astype(np.int64)
            hs.append(short), sids.append(sid[inv]), sizes.append(size[inv]), many.append(m), lefts.append(left.astype(np.int64))
        h, sid, size, m, left = map(np.concatenate, (hs, sids, sizes, many, lefts))
        order = np.lexsort((sid, h))
        h, sid, size, m, left = h[order], sid[order], size[order], m[order], left[order]
        g = groups(h, sid)[:-1]  # the same set from several tasks
        if len(g):
            m, left = np.maximum.reduceat(m, g), np.maximum.reduceat(left, g)
        h, sid, size = h[g], sid[g], size[g]
        g = groups(h)
        count = np.diff(g)
        lead = np.repeat(g[:-1], count)
        rest = np.flatnonzero(np.arange(len(h)) != lead)
        rest = rest[_enough(size[lead[rest]], left[lead[rest]], size[rest], left[rest], percent)]
        pairs = np.unique(np.stack([sid[lead[rest]], size[lead[rest]], sid[rest], size[rest]], 1), axis=0)
        more = np.repeat((count >= 3) | ((count >= 2) & (np.maximum.reduceat(m, g[:-1]) > 0)), count)
        names = (np.int64(key[0].as_py()) << 32) | h[more].astype(np.int64)
        rows = [(PAIRS, None, pack(pairs[:, 0], pairs[:, 1]), pack(pairs[:, 2], pairs[:, 3])), (MEMBER, None, pack(names, left[more]), pack(sid[more], size[more]))]
        return pa.table([pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["kind", "bucket", "a", "b"])

    return run


@lean
def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*unpack(a, "<i8", "<i8"), *unpack(b, "<i8", "<i8"))], ["a", "na", "b", "nb"])


@lean
def _member_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*unpack(a, "<i8", "<i8"), *unpack(b, "<i8", "<i8"))], ["key", "left", "sid", "n"])


def _chosen_batches(table: np.ndarray):
    """Only rows whose doc_id may be in the bitmap."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(hit(table, batch.column(2).to_numpy().view(np.uint64)))).select([0, 1])

    return run


def _overlap_batches(n: int, buckets: int, grams: Order):
    """For each fragment of a set, a row for every set it is counted against and, where it leads, one for every share of its members."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sids, leads, shares = (c.to_pylist() for c in batch.columns[1:])
            out: list[tuple] = []
            for b in B.blocks(batch.column(0)):
                h, first = sets(b, n)
                own = identity(h, first).view(np.int64)
                fragment = grams.fragment(h, grams.often(h))
                for d in range(b.n):
                    row = b.first + d
                    if own[d] != sids[row]:  # another text under the same doc_id
                        continue
                    mine, part = h[first[d] : first[d + 1]], fragment[first[d] : first[d + 1]]
                    for f in range(FRAGMENTS):
                        blob = mine[part == f].tobytes()
                        for lead in leads[row] or []:
                            out.append((lead["a"], sids[row], f, hash((lead["a"], f, lead["share"])) % buckets, lead["share"], blob))
                        for share in range(shares[row] or 0):
                            out.append((sids[row], None, f, hash((sids[row], f, share)) % buckets, share, blob))
            cols = list(zip(*out)) or [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds)], ["a", "b", "f", "bucket", "share", "blob"])

    return run


def _count_overlaps(key, table):
    """Partial overlaps of the pairs of one bucket."""
    cols = [table.column(c).to_pylist() for c in ("a", "b", "f", "share", "blob")]
    own = {(a, f, s): np.frombuffer(x, "<u8") for a, b, f, s, x in zip(*cols) if b is None}
    found = []
    for (a, b, f, s), x in {(a, b, f, s): x for a, b, f, s, x in zip(*cols)}.items():  # rows that repeat doc_id and text count once
        if b is not None and (lead := own.get((a, f, s))) is not None and len(lead) and x:
            h = np.frombuffer(x, "<u8")
            found.append((a, b, int((lead[np.minimum(np.searchsorted(lead, h), len(lead) - 1)] == h).sum())))
    cols = list(zip(*found)) or [[], [], []]
    return pa.table([pa.array(list(c), pa.int64()) for c in cols], ["a", "b", "part"])


def overlaps(docs: DataFrame, profile: DataFrame, pairs: DataFrame, n: int, grams: Order, scratch: Scratch, name: str) -> DataFrame:
    """The pairs (a, na, b, nb and further columns) with the size of their overlap, counted by fragment."""
    spark = docs.sparkSession
    share = F.expr("cast(pmod(xxhash64(b), shares) as int)")
    leaders = scratch.keep(pairs.groupBy("a").agg(F.ceil(F.sum("nb") / SHARE).cast("int").alias("shares"), (F.sum("nb") + F.ceil(F.sum("nb") / SHARE) * F.first("na")).alias("grams")), f"{name}leaders")
    sent = leaders.agg(F.sum("grams")).first()[0] or 0
    buckets = max(4 * partitions(spark, 8), 8 * int(sent) // BUCKET_BYTES)
    leaders = leaders.drop("grams")
    against = pairs.join(leaders, "a").groupBy(F.col("b").alias("sid")).agg(F.collect_list(F.struct("a", share.alias("share"))).alias("leads"))
    work = against.join(leaders.withColumnRenamed("a", "sid"), "sid", "full")
    place = profile.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id"))
    work = scratch.keep(work.join(place, "sid"), f"{name}work")
    key = F.xxhash64("doc_id")
    rows = docs.where("doc_id is not null").select("doc_id", "text", key.alias("k")).mapInArrow(_chosen_batches(bitmap(work.select(key.alias("h")))), "doc_id bigint, text string")
    parts = rows.join(work, "doc_id").select("text", "sid", "leads", "shares").mapInArrow(_overlap_batches(n, buckets, grams), "a bigint, b bigint, f int, bucket int, share int, blob binary")
    counted = parts.groupBy("bucket").applyInArrow(_count_overlaps, "a bigint, b bigint, part bigint").groupBy("a", "b").agg(F.sum("part").alias("overlap"))
    found = scratch.keep(pairs.join(counted, ["a", "b"]), name)
    scratch.drop(f"{name}leaders", f"{name}work")
    return found


def _most_frequent(counts: DataFrame, most: int = FREQUENT):
    """The n-grams with the greatest counts, ``most`` at most, as a pandas frame; the least count is found on a histogram of 65535 bins."""
    bins = counts.groupBy(F.least("n", F.lit(65535)).alias("n")).agg(F.count("*").alias("k")).toPandas().sort_values("n", ascending=False)
    enough = bins["n"][bins["k"].cumsum() <= most]
    return counts.where(F.col("n") >= (int(enough.iloc[-1]) if len(enough) else 2**62)).toPandas()


def _possible_batches(percent: int):
    """Pairs whose signatures do not rule out that they are similar enough, with the most that they can share; the last two columns are the signatures."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = batch.column("na").to_numpy() + batch.column("nb").to_numpy()
            most = (total - differing(*batch.columns[-2:])) // 2
            cols = [*batch.columns[:-2], pa.array(most, pa.int64())]
            out = pa.RecordBatch.from_arrays(cols, [*batch.schema.names[:-2], "most"])
            yield out.filter(pa.array(100 * most >= percent * (total - most)))

    return run


def _possible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Exact: no similar pair goes."""
    both = pairs.join(bits.toDF("a", "x"), "a").join(bits.toDF("b", "y"), "b").select(*pairs.columns, "x", "y")
    return both.mapInArrow(_possible_batches(percent), ", ".join(f"{c} bigint" for c in [*pairs.columns, "most"]))


def _placed(members: DataFrame, parts: DataFrame) -> DataFrame:
    """The members with their component (a set without links is its own)."""
    return members.join(parts.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid"))


def _mixed(members: DataFrame, parts: DataFrame, least: int) -> DataFrame:
    """The sets of n-grams with more than ``least`` sets, not all of one component; k: how many."""
    now = _placed(members, parts)
    mixed = now.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count("*").alias("k")).where(f"x < y and k > {least}").select("key", "k")
    return now.join(mixed, "key")


def _oriented(pairs: DataFrame) -> DataFrame:
    """Columns sid1, n1, component1, sid2, .. as a, na, ca, b, nb, cb with a < b, each pair once."""
    first = F.col("sid1") < F.col("sid2")
    names = [("sid", "a", "b"), ("n", "na", "nb"), ("component", "ca", "cb")]
    low = [F.when(first, F.col(f"{c}1")).otherwise(F.col(f"{c}2")).alias(x) for c, x, _ in names]
    high = [F.when(first, F.col(f"{c}2")).otherwise(F.col(f"{c}1")).alias(y) for c, _, y in names]
    return pairs.select(*low, *high).distinct()


def _beside_leaders(mixed: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """Pairs of different components in which one set is among about LEADERS_TESTED sets of an n-gram, chosen by hash, so that they are the same for n-grams that share sets."""
    lead = mixed.where(f"(xxhash64(sid) / {2.0**64} + 0.5) * k < {LEADERS_TESTED}")
    leaders = scratch.keep(lead.groupBy("key").agg(F.collect_list(F.struct("sid", "n", "component", "left")).alias("leaders")), "leaders")
    reach = f"x -> x.component <> component and {100 + percent} * least(left, x.left) >= {percent} * (n + x.n)"
    beside = mixed.join(leaders, "key").select("sid", "n", "component", F.expr(f"transform(filter(leaders, {reach}), x -> struct(x.sid, x.n, x.component))").alias("l")).where("size(l) > 0")
    beside = beside.groupBy("sid", "n", "component").agg(F.array_distinct(F.flatten(F.collect_list("l"))).alias("l"))
    pairs = beside.select("sid", "n", "component", F.explode("l").alias("l"))
    return _oriented(pairs.select(F.col("sid").alias("sid1"), F.col("n").alias("n1"), F.col("component").alias("component1"), F.col("l.sid").alias("sid2"), F.col("l.n").alias("n2"), F.col("l.component").alias("component2")))


def _every_pair(mixed: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """All pairs of different components under an n-gram whose short signatures do not rule them out."""
    mixed = mixed.join(bits.mapInArrow(_short_batches, "sid bigint, short array<bigint>"), "sid")
    x, y = (mixed.toDF(*[f"{c}{i}" if c != "key" else c for c in mixed.columns]) for i in (1, 2))
    differ = " + ".join(f"bit_count(short1[{i}] ^ short2[{i}])" for i in range(SHORT // 64))
    near = f"100 * (n1 + n2 - ({differ})) >= {percent} * (n1 + n2 + ({differ}))"
    return _oriented(x.join(y, "key").where(f"component1 <> component2 and {100 + percent} * least(left1, left2) >= {percent} * (n1 + n2) and sid1 < sid2 and {near}"))


def _merged(parts: DataFrame, links: DataFrame, scratch: Scratch, turn: int) -> DataFrame:
    """The components after links (ca, cb) between them; single sets may be new."""
    onto = components(links, scratch, f"c{turn}").toDF("old", "new")
    moved = parts.join(onto, parts["component"] == onto["old"], "left").select("node", F.coalesce("new", "component").alias("component"))
    single = onto.join(parts, onto["old"] == parts["node"], "left_anti").toDF("node", "component")
    return scratch.keep(moved.union(single), f"parts{turn}")


def similar_groups(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngrams")
    docs = docs.select("doc_id", "text")
    linked = F.expr(f"100 * overlap >= {percent} * (na + nb - overlap)")

    seen = scratch.keep(docs.mapInArrow(_profile_batches(n), "kind int, doc_id bigint, n bigint, sid bigint, bits binary"), "profile")
    profile = seen.where("kind = 0").select("doc_id", "n", "sid")
    common = _most_frequent(scratch.keep(seen.where("kind = 1").groupBy("sid").agg(F.sum("n").alias("n")), "frequent"))
    grams = Order(common["sid"].to_numpy(np.int64).view(np.uint64), common["n"].to_numpy(np.int64))

    # turn 1: each set with the least under each n-gram of its prefix
    entries = (profile.agg(F.sum("n")).first()[0] or 0) * (100 - percent) / 100
    per = -(-max(2 * partitions(spark, 8), int(11 * entries / BUCKET_BYTES)) // 3)  # three of the fragments hold most of the prefixes
    prefixes = docs.where("doc_id is not null").select("text").mapInArrow(_prefix_batches(n, percent, per, grams), _PREFIX)
    prefixes = scratch.keep(prefixes, "prefixes")
    groups_ = prefixes.where(f"kind = {LEADERS}").groupBy("bucket").applyInArrow(_fragment(percent), _PREFIX)
    groups_ = scratch.keep(prefixes.where(f"kind <> {LEADERS}").union(groups_), "groups")
    scratch.drop("prefixes", "frequent")
    pairs = scratch.keep(groups_.where(f"kind = {PAIRS}").select("a", "b").mapInArrow(_pair_batches, "a bigint, na bigint, b bigint, nb bigint").distinct(), "pairs1")
    members = groups_.where(f"kind = {MEMBER}").select("a", "b").mapInArrow(_member_batches, "key bigint, left bigint, sid bigint, n bigint").distinct()
    members = scratch.keep(members, "members")
    scratch.drop("groups")
    asked = pairs.select("a").union(pairs.select("b")).union(members.select("sid")).toDF("sid").distinct()
    bits = scratch.keep(seen.where("kind = 0 and n > 0").groupBy("sid").agg(F.first("bits").alias("bits")).join(asked, "sid", "left_semi"), "bits")
    counted = overlaps(docs, profile, scratch.keep(_possible(pairs, bits, percent).drop("most"), "possible1"), n, grams, scratch, "overlaps1")
    parts = scratch.keep(components(counted.where(linked).select("a", "b"), scratch, "c1"), "parts1")

    # turn 2: n-grams whose sets are in different components; of two components the pair that looks most similar
    mixed = scratch.keep(_mixed(members, parts, 2), "mixed2")
    beside = scratch.keep(_beside_leaders(mixed, percent, scratch).join(pairs.select("a", "b"), ["a", "b"], "left_anti"), "beside")
    scratch.drop("mixed2", "leaders")
    possible = scratch.keep(_possible(beside, bits, percent), "possible2")
    near = F.struct((F.col("most") / (F.col("na") + F.col("nb") - F.col("most"))).alias("most"), "a", "b")
    best = possible.groupBy(F.least("ca", "cb").alias("ca"), F.greatest("ca", "cb").alias("cb")).agg(F.max_by(F.struct("a", "na", "b", "nb"), near).alias("p"))
    counted = overlaps(docs, profile, scratch.keep(best.select("p.*", "ca", "cb"), "best"), n, grams, scratch, "overlaps2")
    parts = _merged(parts, counted.where(linked).select("ca", "cb"), scratch, 2)

    # turn 3: everything possible that is still apart and uncounted
    apart = possible.drop("most").join(counted.select("a", "b"), ["a", "b"], "left_anti")
    for c in ("ca", "cb"):
        apart = apart.join(parts.toDF(c, "new"), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
    apart = apart.where("ca <> cb").select("a", "na", "ca", "b", "nb", "cb")
    known = pairs.select("a", "b").union(beside.select("a", "b"))
    every = _every_pair(scratch.keep(_mixed(members, parts, LEADERS_TESTED), "mixed3"), bits, percent).join(known, ["a", "b"], "left_anti")
    rest = scratch.keep(_possible(every, bits, percent).select(*apart.columns).union(apart), "possible3")
    scratch.drop("mixed3", "members", "beside", "possible2", "best")
    if not rest.isEmpty():
        counted = overlaps(docs, profile, rest, n, grams, scratch, "overlaps3")
        parts = _merged(parts, counted.where(linked).select("ca", "cb"), scratch, 3)

    # the least doc_id of each component, found on distinct sets
    sets_ = profile.where("n > 0").groupBy("sid").agg(F.min("doc_id").alias("doc_id")).join(parts.withColumnRenamed("node", "sid"), "sid", "left")
    least = scratch.keep(sets_.groupBy(F.coalesce("component", "sid").alias("c")).agg(F.min("doc_id").alias("least")), "least")
    of = profile.join(parts.withColumnRenamed("node", "sid"), "sid", "left").withColumn("c", F.coalesce("component", "sid"))
    return of.join(least, "c", "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))
