"""Near duplicates among embeddings by binary codes of randomly rotated vectors (Gao and Long 2024).

A unit vector is rotated at random and only the signs are kept.  With the
stored factor f, the inner product of the vector with its own code, the product of another
vector with the code, divided by f, is an unbiased estimate of their cosine.
Here two rotations that are independent of each other give two codes, and the
other vector is known by its code in the other rotation, so that

    (code1(a) . code2(b) / (f1(a) f2(b)) + code2(a) . code1(b) / (f2(a) f1(b))) / 2

is an unbiased estimate from codes alone.  Its deviation follows from the
factors; pairs whose upper confidence bound is below the threshold are left out, all
others are computed anew from the whole vectors in double precision.

Pairs meet under keys.  In each of several rotations a vector is known by its
``top`` largest coordinates with their signs, and has one key for every
``shared`` of them; two vectors meet where they agree on that many.  A pair is judged only
under the first of its common keys.  Frequent keys are cut to blocks, and every pair of blocks is a
group of its own, so that no task holds a key's whole set.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .shared import Scratch, lean, pack_columns, partitions

ROTATIONS = 3
#: Largest coordinates of a rotation, and how many of them make a key, for tables of any size: with (4, 2) keys would hold too many of some million vectors.
PLACES = (6, 3)
#: Vectors of one block of a key, and of one cell of whole vectors.
BLOCK, CELL = 1024, 4096
#: Pairs computed at once.
STEP = 1 << 15


@dataclass(frozen=True)
class Plan:
    """How codes and keys are made; the same in every task."""

    threshold: float
    top: int
    shared: int
    sigmas: float
    seed: int

    def bits(self, width: int) -> int:
        return max(64, -(-width // 64) * 64)

    def rotation(self, width: int, k: int) -> np.ndarray:
        """bits x width: a random orthonormal frame."""
        bits = self.bits(width)
        q, r = np.linalg.qr(np.random.default_rng([self.seed, width, k]).normal(size=(bits, bits)))
        return (q * np.sign(np.diag(r)))[:, :width]

    def layout(self, width: int) -> np.dtype:
        bits = self.bits(width)
        return np.dtype([("code", "u1", (2, bits // 8)), ("f", "<f2", (2,)), ("top", "u1" if bits <= 128 else "<u2", (ROTATIONS, self.top))])

    def width(self, key: int, size: int) -> int:
        """Of the vectors under a key whose records have so many bytes."""
        bits = next(b for b in itertools.count(64, 64) if self.layout(b).itemsize == size)
        return key // (2 * bits) ** self.shared // ROTATIONS


def encode(x: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Records (codes, factors, top places) and keys of the rows of x, which are not zero."""
    n, width = x.shape
    bits = plan.bits(width)
    out = np.zeros(n, plan.layout(width))
    unit = x / np.abs(x).max(axis=1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    keys = []
    for k in range(ROTATIONS):
        y = unit @ plan.rotation(width, k).T
        if k < 2:
            out["code"][:, k] = np.packbits(y >= 0, axis=1)
            out["f"][:, k] = np.abs(y).sum(axis=1) / np.sqrt(bits)
        place = np.argsort(-np.abs(y), axis=1, kind="stable")[:, : plan.top]
        out["top"][:, k] = top = np.sort(2 * place + (np.take_along_axis(y, place, 1) < 0), axis=1)
        keys += [_key(width, bits, k, top[:, list(c)]) for c in itertools.combinations(range(plan.top), plan.shared)]
    return out, np.stack(keys, axis=1)


def _key(width: int, bits: int, rotation: int, places: np.ndarray) -> np.ndarray:
    """One number for ascending places of a rotation."""
    key = np.full(len(places), width * ROTATIONS + rotation, np.int64)
    for p in places.T:
        key = key * np.int64(2 * bits) + p.astype(np.int64)
    return key


@dataclass
class Codes:
    """Records in the form that estimates are made of: one code turned into the other's rotation, and both over their factors."""

    records: np.ndarray
    bits: int
    turned: np.ndarray  # code1 seen from the second rotation, over f1
    plain: np.ndarray  # code2 over f2
    loss: np.ndarray  # what each code leaves out, two columns

    @classmethod
    def of(cls, records: np.ndarray, width: int, plan: Plan) -> Codes:
        bits = plan.bits(width)
        turn = (plan.rotation(width, 0) @ plan.rotation(width, 1).T / bits).astype(np.float32)
        sign = np.unpackbits(records["code"], axis=2).astype(np.float32) * 2 - 1
        f = np.maximum(records["f"].astype(np.float32), 1e-3)
        return cls(records, bits, (sign[:, 0] @ turn) / f[:, :1], sign[:, 1] / f[:, 1:], np.maximum(1 / f.astype(float) ** 2 - 1, 0))

    def spread(self, left, right, threshold: float) -> np.ndarray:
        """The deviation of the estimates of pairs where their cosine is the threshold."""
        (a, d), (c, b) = self.loss[left].T, self.loss[right].T
        return np.sqrt(((1 - threshold**2) * (a + b + c + d) + a * b + c * d) / (4 * (self.bits - 1)))

    def cosines(self, left: slice, right: slice) -> np.ndarray:
        """Unbiased estimates between two runs of records."""
        return (self.turned[left] @ self.plain[right].T + (self.turned[right] @ self.plain[left].T).T) / 2

    def likely(self, left: slice, right: slice, plan: Plan, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose upper confidence bound reaches the threshold; ``most`` is not under any deviation here."""
        value = self.cosines(left, right)
        may = value >= plan.threshold - plan.sigmas * most
        i, j = np.nonzero(np.triu(may, 1) if left == right else may)
        value, i, j = value[i, j], i + left.start, j + right.start
        sure = value + plan.sigmas * self.spread(i, j, plan.threshold) >= plan.threshold
        return i[sure], j[sure]


def _first_key(left: np.ndarray, right: np.ndarray, width: int, plan: Plan) -> np.ndarray:
    """The first key that two records have in common, of each pair; some is."""
    bits, out = plan.bits(width), np.full(len(left), -1, np.int64)
    for k in reversed(range(ROTATIONS)):
        a, b = left["top"][:, k], right["top"][:, k]
        both = np.sort(np.where((a[:, :, None] == b[:, None, :]).any(axis=2), a, 2 * bits), axis=1)[:, : plan.shared]
        has = both[:, -1] < 2 * bits
        out[has] = _key(width, bits, k, both[has])
    return out


def _coded(plan: Plan, float_bytes: int) -> Callable:
    """node, n, rep and vector become node, n, rep, raw, record, cell and keys."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), np.diff(lists.offsets.to_numpy())
            ends = np.cumsum(sizes)
            for width in np.unique(sizes):
                rows = np.flatnonzero(sizes == width)
                x = flat[(ends[rows] - width)[:, None] + np.arange(width)]
                records, keys = encode(x.astype(float), plan)
                raw = np.ascontiguousarray(x, f"<f{float_bytes}")
                cell = _cells(records, np.zeros(len(rows), np.int64), int(width), {}) >> 24
                cut = np.arange(len(rows) + 1, dtype=np.int32)
                packed = [pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(cut * np.int32(v.nbytes // len(rows))), pa.py_buffer(v.tobytes())]) for v in (raw, records)]
                listed = pa.ListArray.from_arrays(cut * np.int32(keys.shape[1]), pa.array(keys.ravel()))
                taken = [c.take(pa.array(rows)) for c in batch.columns[:3]]
                yield pa.RecordBatch.from_arrays([*taken, *packed, pa.array(cell), listed], ["node", "n", "rep", "raw", "record", "cell", "keys"])

    return run


def _cells(records: np.ndarray, node: np.ndarray, width: int, cuts: dict[int, int]) -> np.ndarray:
    """Where whole vectors lie: by a place that near vectors mostly share, and in large cells by the node."""
    cell = width * 65536 + records["top"][:, 0, 0].astype(np.int64)
    salt = np.zeros(len(cell), np.int64)
    if cuts:
        ids, at = np.unique(cell, return_inverse=True)
        salt = np.mod(node, np.array([cuts.get(int(c), 1) for c in ids], np.int64)[at])
    return cell * (1 << 24) + salt


def _pairs(plan: Plan, cuts: dict[int, int]) -> Callable:
    """Rows key, part, node, record, sorted, become candidates: a node, a cell and the nodes in it.

    A part is (left block, right block, side); rows of one block have left = right and side 0.  A group is at most two blocks.
    """

    def of_groups(key: np.ndarray, part: np.ndarray, node: np.ndarray, raw: list[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Candidates of whole groups whose records have one size: node, cell of the other, other."""
        sizes = np.array([len(r) for r in raw])
        for size in np.unique(sizes):
            at = np.flatnonzero(sizes == size)
            ids, of = np.unique(key[at], return_inverse=True)
            widths = np.array([plan.width(int(k), int(size)) for k in ids])[of]
            for width in np.unique(widths):
                yield from of_width(*(v[at[widths == width]] for v in (key, part, node)), np.frombuffer(b"".join(raw[i].tobytes() for i in at[widths == width]), plan.layout(int(width))), int(width))

    def of_width(key, part, node, records, width) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        codes, pair, side = Codes.of(records, width, plan), part >> 1, part & 1
        cuts_at = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (pair[1:] != pair[:-1])) + 1, [len(key)]])
        high = codes.loss.max(initial=0.0)
        most = np.sqrt(((1 - plan.threshold**2) * 4 * high + 2 * high**2) / (4 * (codes.bits - 1)))
        ones = np.concatenate([[0], np.cumsum(side)])
        for a, b in itertools.pairwise(cuts_at.tolist()):
            if b - a < 2:
                continue
            block, other = divmod(int(pair[a]), 1 << 20)
            middle = b - int(ones[b] - ones[a])  # rows of the right block follow those of the left one
            left, right = (slice(a, b),) * 2 if block == other else (slice(a, middle), slice(middle, b))
            i, j = codes.likely(left, right, plan, most)
            if not len(i):
                continue
            mine = np.concatenate([_first_key(records[i[s : s + STEP]], records[j[s : s + STEP]], width, plan) == key[a] for s in range(0, len(i), STEP)])
            i, j = i[mine], j[mine]
            yield node[i], _cells(records[j], node[j], width, cuts), node[j]

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list = []

        def done(columns: list) -> Iterator[pa.RecordBatch]:
            found = list(of_groups(*columns))
            if not found:
                return
            a, cell, b = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((b, cell, a))
            a, cell, b = a[order], cell[order], b[order]
            new = np.concatenate([[0], np.flatnonzero((a[1:] != a[:-1]) | (cell[1:] != cell[:-1])) + 1]).astype(np.int32) if len(a) else np.zeros(0, np.int32)
            for s in range(0, len(new), 2000):
                some = np.append(new[s : s + 2000], new[s + 2000] if s + 2000 < len(new) else len(a)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(a[some[:-1]]), pa.array(cell[some[:-1]]), pa.ListArray.from_arrays(some - some[0], pa.array(b[some[0] : some[-1]]))], ["a", "cell", "others"])

        for batch in batches:
            cut = np.frombuffer(batch.column(3).buffers()[1], np.int32)[batch.column(3).offset :][: batch.num_rows + 1]
            data = np.frombuffer(batch.column(3).buffers()[2] or b"", np.uint8)
            columns = [*(c.to_numpy() for c in batch.columns[:3]), [data[s:e] for s, e in itertools.pairwise(cut.tolist())]]
            if held:
                columns = [*(np.concatenate([h, c]) for h, c in zip(held[:3], columns)), held[3] + columns[3]]
            key, pair = columns[0], columns[1] >> 1
            last = int(np.flatnonzero((key != key[-1]) | (pair != pair[-1]))[-1]) + 1 if len(key) and ((key != key[-1]) | (pair != pair[-1])).any() else 0
            if last:
                yield from done([c[:last] for c in columns])
            held = [c[last:] for c in columns]
        if held and len(held[0]):
            yield from done(held)

    return run


def _exact(threshold: float, float_bytes: int) -> Callable:
    """Of rows cell, kind (0 a vector of the cell, 1 candidates of a vector), node, n, raw, others, sorted by cell and kind: links.

    Gives numbers of links (u, null, w) and edges (u, v, null) that join what the links join.  A task holds one cell
    of vectors, one batch of candidates and the forest of the nodes that it has linked.
    """

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root: dict[int, int] = {}

        def find(a: int) -> int:
            while (up := root.setdefault(a, a)) != a:
                root[a] = a = root[up]
            return a

        def matrix(rows: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
            x = np.frombuffer(b"".join(rows), f"<f{float_bytes}").reshape(len(rows), -1).astype(float)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            return x, np.sqrt((x * x).sum(axis=1))

        cell, parts, known = None, [], None
        for batch in batches:
            head = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)])
            cuts = np.concatenate([[0], np.flatnonzero((head[:, 1:] != head[:, :-1]).any(axis=0)) + 1, [batch.num_rows]])
            for a, b in itertools.pairwise(cuts if batch.num_rows else []):
                rows, (this, kind) = batch.slice(a, b - a), head[:, a]
                if this != cell:
                    cell, parts, known = this, [], None
                if kind == 0:
                    parts.append(rows)
                    continue
                if known is None:
                    table = pa.Table.from_batches(parts)
                    ids = table.column(2).to_numpy()
                    order = np.argsort(ids)
                    known = ids[order], table.column(3).to_numpy()[order], *(m[order] for m in matrix(table.column(4).to_pylist()))
                ids, copies, x, norm = known
                others = rows.column(5)
                count = np.diff(others.offsets.to_numpy())
                left = np.repeat(np.arange(len(count)), count)
                right = np.searchsorted(ids, others.flatten().to_numpy())
                y, size = matrix(rows.column(4).to_pylist())
                step = max(1, 4 * STEP // max(1, x.shape[1] // 16))
                linked = [np.einsum("ij,ij->i", y[left[s : s + step]], x[right[s : s + step]]) / (size[left[s : s + step]] * norm[right[s : s + step]]) >= threshold for s in range(0, len(left), step)]
                linked = np.concatenate([np.zeros(0, bool), *linked])
                left, right = left[linked], right[linked]
                mine, my_copies = rows.column(2).to_numpy(), rows.column(3).to_numpy()
                degree = np.concatenate([np.bincount(left, copies[right], len(mine)), np.bincount(right, my_copies[left], len(ids))]).astype(np.int64)
                nodes = np.concatenate([mine, ids])
                for u, v in zip(mine[left].tolist(), ids[right].tolist()):
                    u, v = find(u), find(v)
                    root[max(u, v)] = min(u, v)
                some = np.flatnonzero(degree)
                yield pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.nulls(len(some), pa.int64()), pa.array(degree[some])], ["u", "v", "w"])
        tied = [(u, find(u)) for u in list(root)]
        tied = np.array([t for t in tied if t[0] != t[1]], np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(tied[:, 0]), pa.array(tied[:, 1]), pa.nulls(len(tied), pa.int64())], ["u", "v", "w"])

    return run


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, vector: str = "embedding", sigmas: float = 4.5, places: tuple[int, int] | None = PLACES, seed: int = 7) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row: its links to other rows with cosine >= threshold, and the least vec_id that links lead to.

    Every pair that is linked has been computed in double precision.  A pair is
    missed if its vectors share no key (at cosine 0.9, about three pairs in a thousand; fewer above)
    or if its estimate is over ``sigmas`` deviations too low (about three in a million).  Equal vectors are
    one node from the start and always linked, however many they are; a node is known by a 64-bit hash.

    Vectors that are null, empty, zero or hold null or non-finite numbers, and rows whose
    vec_id is null, link with nothing: no links, component_id is vec_id, kept.  Vectors of
    different lengths do not link.  Rows of one vec_id are rows of their own (as
    components they are one).  An empty table gives no rows.  Further columns are not read.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embedding-dedup")
    rows = pack_columns(vectors, "vec_id", vector).toDF("vec_id", "v")
    if rows.schema["v"].dataType.elementType.simpleString() not in ("float", "double"):
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    float_bytes = 4 if rows.schema["v"].dataType.elementType.simpleString() == "float" else 8
    sound = f"vec_id is not null and v is not null and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('inf')) and exists(v, x -> x <> 0)"
    known = rows.select("vec_id", F.expr(f"case when {sound} then xxhash64(size(v), v) end").alias("node"), "v")
    nodes = known.where("node is not null").groupBy("node").agg(F.count("*").alias("n"), F.min("vec_id").alias("rep"), F.first("v").alias("v"))
    places = places or PLACES
    plan = Plan(threshold, places[0], places[1], sigmas, seed)
    coded = scratch.keep(nodes.mapInArrow(_coded(plan, float_bytes), "node bigint, n bigint, rep bigint, raw binary, record binary, cell bigint, keys array<bigint>"), "coded")

    # The number of cells is bounded by the codes' bits.
    sizes = coded.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > CELL).limit(1 << 16).collect()
    cuts, salt = {r["cell"]: -(-r["n"] // CELL) for r in sizes}, F.lit(0)
    if cuts:
        table = F.create_map(*itertools.chain.from_iterable((F.lit(c), F.lit(k)) for c, k in cuts.items()))
        salt = F.pmod(F.col("node"), F.coalesce(table[F.col("cell")], F.lit(1)))
    coded = coded.withColumn("cell", F.col("cell") * (1 << 24) + salt)

    sent = coded.select(F.explode("keys").alias("key"), "node", "record")
    frequent = sent.groupBy("key").agg(F.count("*").alias("m")).where(F.col("m") > BLOCK).select(F.col("key").alias("hot"), F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    dealt = sent.join(frequent, F.col("key") == F.col("hot"), "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("node", F.lit(seed)), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    part = (F.least("own", "other") * (1 << 20) + F.greatest("own", "other")) * 2 + F.when(F.col("own") > F.col("other"), 1).otherwise(0)
    dealt = dealt.select("key", part.alias("part"), "node", "record")
    n = partitions(spark)
    grouped = dealt.repartition(n, "key", F.expr("part div 2")).sortWithinPartitions("key", "part")
    candidates = scratch.keep(grouped.mapInArrow(_pairs(plan, cuts), "a bigint, cell bigint, others array<bigint>"), "candidates")

    whole = coded.select("cell", F.lit(0).alias("kind"), "node", "n", "raw", F.lit(None).cast("array<bigint>").alias("others"))
    asked = candidates.join(coded.select(F.col("node").alias("a"), "n", "raw"), "a").select("cell", F.lit(1).alias("kind"), "a", "n", "raw", "others")
    met = whole.union(asked).repartition(n, "cell").sortWithinPartitions("cell", "kind")
    links = scratch.keep(met.mapInArrow(_exact(threshold, float_bytes), "u bigint, v bigint, w bigint"), "links")

    degrees = links.where("w is not null").groupBy(F.col("u").alias("node")).agg(F.sum("w").alias("w"))
    joined = components(links.where("v is not null").select("u", "v"), scratch)
    named = coded.select("node", "n", "rep")
    least = named.join(joined, "node").groupBy("component").agg(F.min("rep").alias("component_id"))
    member = joined.join(least, "component").select("node", "component_id")
    told = named.join(degrees, "node", "left").join(member, "node", "left").select("node", (F.col("n") - 1 + F.coalesce("w", F.lit(0))).alias("n_links"), F.coalesce("component_id", "rep").alias("component_id")).where("n_links > 0")
    told = scratch.keep(told, "told")
    out = known.select("vec_id", "node").join(told, "node", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
