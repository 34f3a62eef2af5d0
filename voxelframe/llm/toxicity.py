"""Toxicity: a convolutional text classifier over hashed word embeddings.

Words (lower-cased, outer punctuation removed) go to rows of two embedding
tables by independent hashes; a word's vector is their sum, so two words
share a vector only if both hashes meet.  Filters of one, two and three words
slide over the whole text, the greatest response of each over the text feeds
a logistic layer.  All is trained by AdaGrad on the rows that the maxima came
from.

All labelled texts are learned from, whole.  They are kept in shards by hashes
of doc_id, one for every ``each`` texts.  In each of a few rounds every shard
goes on from the common parameters by itself, side by side, and each parameter
then moves by the mean of the shards that changed it.  Only the parameters (a
bounded number) come to the driver.  A learner has the rows of the tables that
some word goes to; a worker holds it once (as a broadcast, not in a closure,
which is there as bytes, too), and a shard learns with a copy of the rows of
its own words.

Decision thresholds are calibrated by language on the fifth of the labelled
texts that the weights are not learned from, from counts of all their logits
in steps of 1 / 256.  The language is a guess from the text's
own words (a hashed word model), never the lang column of the scored row.
The threshold is taken into the score: 0.5 is the decision point everywhere.

Defined results: null and empty texts get the score of a text without words.  Without labels
of both kinds every score is the share of label 1 (0 without labels).
Repeated rows each give a row; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytetext as B
from .bitmaps import bitmap, hit
from .blobs import pack, unpack
from .shared import Scratch, lean, pack_columns, release

BITS, DIM, FILTERS, WIDTHS, LANG_BITS = 18, 4, 6, (1, 2, 3), 14
PAD = max(WIDTHS) - 1
SIZE = 1 << BITS
#: Words that are looked up at once; words of one training step; slices of a table in which changes are merged; steps of a logit of 1 in which thresholds are counted.
PART, MOST, SLICES, FINE = 1 << 17, 1 << 16, 32, 256
_PUNCT = np.zeros(256, bool)
_PUNCT[[ord(c) for c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"]] = True


def word_hashes(b: B.Block) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word without outer punctuation, and the first word of each document."""
    starts, ends, first = b.words()
    solid = np.flatnonzero(~_PUNCT[b.data])
    if len(solid):
        left = np.searchsorted(solid, starts)
        right = np.searchsorted(solid, ends)
        full = right > left
        starts = np.where(full, solid[np.minimum(left, len(solid) - 1)], starts)
        ends = np.where(full, solid[np.maximum(right, 1) - 1] + 1, ends)
    return b.hashes(starts, ends, B.LUT_LOWER), first


def rows_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h & np.uint64(SIZE - 1)).astype(np.int32), ((h >> np.uint64(24)) & np.uint64(SIZE - 1)).astype(np.int32)


def padded(values: np.ndarray, first: np.ndarray, fill: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values with PAD fillers after each document; the documents' first places; which places are fillers."""
    n = len(first) - 1
    at = first + PAD * np.arange(n + 1)
    out, pad = np.full(int(at[-1]), fill, np.int32), np.ones(int(at[-1]), bool)
    where = np.arange(len(values)) + np.repeat(PAD * np.arange(n), np.diff(first))
    out[where], pad[where] = values, False
    return out, at, pad


@dataclass
class ToxicNet:
    one: np.ndarray
    two: np.ndarray
    filters: list[np.ndarray]  # for each width: (width, DIM, FILTERS)
    dense: np.ndarray
    bias: np.ndarray  # one number
    lang: np.ndarray | None = None
    thresholds: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def params(self) -> list[np.ndarray]:
        return [self.one, self.two, *self.filters, self.dense, self.bias]

    def responses(self, a: np.ndarray, b: np.ndarray, pad: np.ndarray) -> list[np.ndarray]:
        x = self.one[a] + self.two[b]
        x = np.concatenate([x, np.zeros((PAD, DIM), np.float32)])
        n, out = len(a), []
        for f in self.filters:
            y = x[:n] @ f[0]
            for k in range(1, len(f)):
                y += x[k : n + k] @ f[k]
            y[pad] = -np.inf
            out.append(y)
        return out

    def logits(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        ra, rb = rows_of(h)
        a, at, pad = padded(ra, first, SIZE)
        b, _, _ = padded(rb, first, SIZE)
        if not len(a):
            return np.zeros(0)
        z = np.concatenate([np.maximum.reduceat(y, at[:-1]) for y in self.responses(a, b, pad)], 1)
        return np.maximum(z, 0) @ self.dense + self.bias[0]

    def language(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        if self.lang is None or not len(h):
            return np.zeros(len(first) - 1, np.int64)
        x = self.lang[(h & np.uint64((1 << LANG_BITS) - 1)).astype(np.int64)]
        total = np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, 0, np.float64)])
        return (total[first[1:]] - total[first[:-1]]).argmax(1)

    def scores(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        t = self.thresholds[self.language(h, first)]
        return 1 / (1 + np.exp(-np.clip(self.logits(h, first) - t, -30, 30)))


def _threshold(s: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """The cut of ascending logits with the fewest errors, nearer to the upper side of the widest gap that has so few."""
    cuts = np.concatenate([[s[0] - 2], 0.25 * s[:-1] + 0.75 * s[1:], [s[-1] + 2]])
    gap = np.concatenate([[1], np.diff(s), [1]])
    errors = np.concatenate([[0], np.cumsum(toxic)]) + np.concatenate([np.cumsum(clean[::-1])[::-1], [0]])
    best = np.flatnonzero(errors <= errors.min() + 1e-9)
    return float(cuts[best[gap[best].argmax()]])


@dataclass
class Learner:
    """A net with some rows of the tables, and the sums of squared gradients of its parameters (AdaGrad)."""

    rows: list[np.ndarray]  # of each table, ascending; the last is SIZE, the filler
    net: ToxicNet
    speed: list[np.ndarray]  # of net.params()

    @classmethod
    def start(cls, seen: list[np.ndarray], seed: int) -> Learner:
        """A random start: small values for the words seen; words never seen have no row and no say."""
        rng = np.random.default_rng(seed)
        rows = [np.append(np.flatnonzero(s[:SIZE]), SIZE).astype(np.int32) for s in seen]
        one, two = (np.where(s[:, None], rng.normal(0, 0.1, (SIZE + 1, DIM)), 0).astype(np.float32)[r] for s, r in zip(seen, rows))
        filters = [rng.normal(0, 0.5 / w, (w, DIM, FILTERS)).astype(np.float32) for w in WIDTHS]
        net = ToxicNet(one, two, filters, np.ones(FILTERS * len(WIDTHS), np.float32) * 0.3, np.full(1, -2.0))
        return cls(rows, net, [np.full(p.shape, 1e-2, p.dtype) for p in net.params()])

    def part(self, rows: list[np.ndarray]) -> Learner:
        """A copy with these of its rows."""
        n, (i, j) = self.net, (np.searchsorted(a, b) for a, b in zip(self.rows, rows))
        net = ToxicNet(n.one[i], n.two[j], [f.copy() for f in n.filters], n.dense.copy(), n.bias.copy())
        return Learner(rows, net, [self.speed[0][i], self.speed[1][j], *(s.copy() for s in self.speed[2:])])

    def whole(self) -> ToxicNet:
        """The net with all rows; those never seen are zeros."""
        tables = [np.zeros((SIZE + 1, DIM), np.float32) for _ in range(2)]
        for table, rows, values in zip(tables, self.rows, self.net.params()):
            table[rows] = values
        return ToxicNet(*tables, self.net.filters, self.net.dense, self.net.bias)

    def learn(self, ra: np.ndarray, rb: np.ndarray, first: np.ndarray, y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, epochs: int, batch: int, rate: float, drop: float) -> None:
        """Steps of at most ``batch`` texts and MOST words (a text with more is a step of its own).  ra, rb: each word's places in the two tables."""
        net, speed = self.net, self.speed
        no_a, no_b = len(net.one) - 1, len(net.two) - 1
        for _ in range(epochs):
            order = rng.permutation(len(y))
            for part in _steps(order, np.diff(first), batch):
                lens = first[part + 1] - first[part]
                local = np.concatenate([[0], np.cumsum(lens)])
                take = np.arange(local[-1]) + np.repeat(first[part] - local[:-1], lens)
                # words left out at random: else a text's first telling word ends what its others could teach
                out = rng.random(len(take)) < drop
                a, at, pad = padded(np.where(out, no_a, ra[take]), local, no_a)
                b, _, _ = padded(np.where(out, no_b, rb[take]), local, no_b)
                zs, places = [], []
                for q in net.responses(a, b, pad):
                    z = np.maximum.reduceat(q, at[:-1])
                    hit = q == np.repeat(z, np.diff(at), axis=0)
                    # the first place of each maximum
                    place = np.empty(z.shape, np.int64)
                    for f in range(FILTERS):
                        i = np.flatnonzero(hit[:, f])
                        place[:, f] = i[np.searchsorted(i, at[:-1])]
                    zs.append(z)
                    places.append(place)
                z = np.concatenate(zs, 1)
                act = np.maximum(z, 0)
                p = 1 / (1 + np.exp(-np.clip(act @ net.dense + net.bias[0], -30, 30)))
                g = (weight[part] * (p - y[part]) / len(part)).astype(np.float32)
                back = (g[:, None] * net.dense[None]) * (z > 0)
                x = np.concatenate([net.one[a] + net.two[b], np.zeros((PAD, DIM), np.float32)])
                fgrads, erows, egrads = [], [], []
                aa, bb = np.append(a, [no_a] * PAD), np.append(b, [no_b] * PAD)
                for j, f in enumerate(net.filters):
                    bk, gf = back[:, j * FILTERS : (j + 1) * FILTERS], np.zeros_like(f)
                    for k in range(len(f)):
                        vec = x[places[j] + k]
                        gf[k] = np.einsum("nfd,nf->df", vec, bk)
                        erows.append((places[j] + k).ravel())
                        egrads.append((bk[:, :, None] * f[k].T[None]).reshape(-1, DIM))
                    fgrads.append(gf)
                where, grad = np.concatenate(erows), np.concatenate(egrads)
                dense = act.T @ g
                for table, sp, ids, no in ((net.one, speed[0], aa, no_a), (net.two, speed[1], bb, no_b)):
                    rows, inv = np.unique(ids[where], return_inverse=True)
                    gr = np.zeros((len(rows), DIM), np.float32)
                    np.add.at(gr, inv, grad)
                    gr[rows == no] = 0
                    sp[rows] += gr * gr
                    table[rows] -= rate * gr / np.sqrt(sp[rows])
                for param, sp, gf in zip([*net.filters, net.dense, net.bias], speed[2:], [*fgrads, dense, g.sum(keepdims=True)]):
                    sp += gf * gf
                    param -= 0.3 * rate * gf / np.sqrt(sp)


def _steps(order: np.ndarray, sizes: np.ndarray, batch: int) -> Iterator[np.ndarray]:
    for part in np.array_split(order, max(1, len(order) // batch)):
        total = np.cumsum(sizes[part])
        if len(part) and total[-1] > MOST:
            yield from np.split(part, np.flatnonzero(np.diff(total // MOST)) + 1)
        elif len(part):
            yield part


# All labelled texts, in shards -------------------------------------------------------------


def _labelled_batches(table: np.ndarray):
    """doc_id, lang and the words (six bytes of each hash) of the rows that may have a label."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(hit(table, batch.column(0).to_numpy().view(np.uint64))))
            words = []
            for b in B.blocks(some.column(3)):
                h, first = word_hashes(b)
                six = np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :6]
                words += [six[first[d] : first[d + 1]].tobytes() for d in range(b.n)]
            yield pa.RecordBatch.from_arrays([some.column(1), some.column(2), pa.array(words, pa.binary())], ["doc_id", "lang", "words"])

    return run


def _squeezed(words: bytes) -> bytes:
    """Six-byte hashes as the distinct ones and which of them each word has: a shard is one row, and what the JVM holds to read, copy and write a row is several times the row."""
    six = np.frombuffer(words, np.uint8).reshape(-1, 6)
    parts = [slice(i, i + PART) for i in range(0, len(six), PART)]
    known = np.unique(np.concatenate([np.zeros(0, np.uint64), *(np.unique(_widened(six[p])) for p in parts)]))
    which = np.empty(len(six), "<u2" if len(known) <= 1 << 16 else "<u4")
    for p in parts:
        which[p] = np.searchsorted(known, _widened(six[p]))
    return zstandard.ZstdCompressor(level=1).compress(pack(known, which))


def _widened(six: np.ndarray) -> np.ndarray:
    h = np.zeros((len(six), 8), np.uint8)
    h[:, :6] = six
    return h.view(np.uint64).ravel()


def _unsqueezed(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    blob = zstandard.ZstdDecompressor().decompress(blob)
    known, which = unpack(blob, "<u8", "<u2" if blob[13] == 2 else "<u4")
    return known, which


_SHARD = "shard int, sizes binary, y binary, held binary, lang array<string>, words binary"


def _shard(key, docs, labels):
    """The labelled texts of a shard as one row, in an order that does not depend on how rows are dealt out."""
    known: dict[int, list[int]] = {}
    for i, label in zip(labels.column("doc_id").to_pylist(), labels.column("label").to_pylist()):
        known.setdefault(i, []).append(label)
    rows = [(i, label, w, lang, held) for i, lang, w, held in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "lang", "words", "held"))) for label in known.get(i, ())]
    rows.sort(key=lambda r: (r[0], r[1], r[2], r[3] or ""))
    pack = lambda j, f, t: np.array([f(r[j]) for r in rows], t).tobytes()
    fields = [[key[0].as_py()], [pack(2, lambda w: len(w) // 6, "<i8")], [pack(1, int, "u1")], [pack(4, int, "u1")], [[r[3] for r in rows]], [_squeezed(b"".join(r[2] for r in rows))]]
    del rows
    release()
    kinds = (pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.string()), pa.binary())
    return pa.table([pa.array(f, t) for f, t in zip(fields, kinds)], ["shard", "sizes", "y", "held", "lang", "words"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """shard, distinct hashes, which of them each word has, first places, labels, which are for the thresholds, languages."""
    for batch in batches:
        for i in range(batch.num_rows):
            shard, sizes, y, held, lang, words = (c[i] for c in batch.columns)
            first = np.concatenate([[0], np.cumsum(np.frombuffer(sizes.as_buffer(), "<i8"))]).astype(np.int64)
            yield shard.as_py(), *_unsqueezed(words.as_buffer()), first, np.frombuffer(y.as_buffer(), "u1").astype(float), np.frombuffer(held.as_buffer(), "u1") > 0, lang.as_py()


def _opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The same with the hash of each word."""
    for shard, known, which, *more in _packed(batches):
        yield shard, known[which], *more


def shards(docs: DataFrame, labels: DataFrame, each: int, scratch: Scratch) -> DataFrame | None:
    """All labelled texts, a row for about ``each`` of them by hashes of doc_id; None without labels."""
    ids = labels.select("doc_id", F.col("label").cast("int").alias("label")).where("doc_id is not null and label in (0, 1)").distinct()
    n = ids.count()
    if not n:
        return None
    shard = F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(-(-n // each))).cast("int").alias("shard")
    lang = "lang" if "lang" in docs.columns else F.lit(None).cast("string").alias("lang")
    table = bitmap(ids.select(F.xxhash64("doc_id").alias("h")))
    rows = docs.where("doc_id is not null").select(F.xxhash64("doc_id").alias("k"), "doc_id", lang, "text")
    words = rows.mapInArrow(_labelled_batches(table), "doc_id bigint, lang string, words binary")
    words = words.select(shard, "doc_id", "lang", "words", (F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(5)) == 4).cast("int").alias("held"))
    return scratch.keep(words.groupBy("shard").cogroup(ids.select(shard, "doc_id", "label").groupBy("shard")).applyInArrow(_shard, _SHARD), "shards")


@lean
def _survey_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is counted over all texts, a row for each count: labels, rows of the tables that words go to, words by language."""
    counts = {"y": np.zeros(2, np.int64), "0": np.zeros(SIZE + 1, bool), "1": np.zeros(SIZE + 1, bool)}
    for _, known, which, first, y, held, lang in _packed(batches):
        counts["y"] += np.bincount(y.astype(int), minlength=2)
        sizes, seen = np.diff(first), np.zeros(len(known), bool)
        seen[which[np.repeat(~held, sizes)]] = True
        for k, r in zip("01", rows_of(known)):
            counts[k][r[seen]] = True
        cells, code = (known & np.uint64((1 << LANG_BITS) - 1)).astype(np.int64), np.array(["" if x is None else "l" + x for x in lang], object)
        for name in set(code) - {""}:
            mine = which[np.repeat(code == name, sizes)]
            n = sum((np.bincount(mine[i : i + PART], minlength=len(known)) for i in range(0, len(mine), PART)), np.zeros(len(known), np.int64))
            np.add.at(counts.setdefault(name, np.zeros(1 << LANG_BITS, np.int64)), cells, n)
    yield pa.RecordBatch.from_arrays([pa.array(list(counts)), pa.array([c.astype(np.int64).tobytes() if k[0] in "yl" else np.packbits(c).tobytes() for k, c in counts.items()], pa.binary())], ["name", "blob"])


def _survey_merged(key, table):
    name = key[0].as_py()
    blobs = [np.frombuffer(b, np.int64 if name[0] in "yl" else np.uint8) for b in table.column("blob").to_pylist()]
    return pa.table([pa.array([name]), pa.array([(sum(blobs[1:], blobs[0]) if name[0] in "yl" else np.bitwise_or.reduce(blobs)).tobytes()], pa.binary())], ["name", "blob"])


def _round_batches(common: Broadcast, round_: int, weights: np.ndarray, seed: int, options: dict):
    """Each shard learns from the common Learner by itself; what has changed, in slices: slice, shard, blob."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, known, which, first, y, held, _ in _packed(batches):
            fitted = np.flatnonzero(~held)
            if not len(fitted):
                continue
            sizes, used = np.diff(first), np.zeros(len(known), bool)
            which = which[np.repeat(~held, sizes)]
            used[which] = True
            local = np.concatenate([[0], np.cumsum(sizes[fitted])])
            rows = [np.append(np.unique(r[used]), np.int32(SIZE)) for r in rows_of(known)]
            ra, rb = (np.searchsorted(own, r).astype(np.int32)[which] for own, r in zip(rows, rows_of(known)))
            del known, which
            old, new = common.value.part(rows), common.value.part(rows)
            new.learn(ra, rb, local, y[fitted], weights[y[fitted].astype(int)], np.random.default_rng([seed, round_, shard]), **options)
            out = [(2 * SLICES, b"".join((a - b).astype("<f8").tobytes() for a, b in zip([*new.net.params()[2:], *new.speed[2:]], [*old.net.params()[2:], *old.speed[2:]])))]
            for t in range(2):
                at = np.flatnonzero((new.speed[t] != old.speed[t]).any(axis=1))
                moved = np.concatenate([new.net.params()[t][at] - old.net.params()[t][at], new.speed[t][at] - old.speed[t][at]], axis=1).astype("<f4")
                ids = rows[t][at]
                cut = np.searchsorted(ids, np.arange(SLICES + 1) * (SIZE // SLICES))
                out += [(t * SLICES + k, ids[a:b].astype("<i4").tobytes() + moved[a:b].tobytes()) for k, (a, b) in enumerate(itertools.pairwise(cut)) if b > a]
            part, blob = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array([shard] * len(part), pa.int32()), pa.array(blob, pa.binary())], ["part", "shard", "blob"])

    return run


def _rows_moved(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // (4 + 8 * DIM)
    return np.frombuffer(blob, "<i4", n), np.frombuffer(blob, "<f4", offset=4 * n).reshape(n, 2 * DIM)


def _round_merged(key, table):
    """The mean change of each parameter over the shards that changed it."""
    part = key[0].as_py()
    blobs = [b for _, b in sorted(zip(table.column("shard").to_pylist(), table.column("blob").to_pylist()))]
    if part == 2 * SLICES:
        out = sum(np.frombuffer(b, "<f8") for b in blobs) / len(blobs)
        blob = out.astype("<f8").tobytes()
    else:
        low, size = part % SLICES * (SIZE // SLICES), SIZE // SLICES
        count, total = np.zeros(size, np.int64), np.zeros((size, 2 * DIM))
        for rows, moved in map(_rows_moved, blobs):
            count[rows - low] += 1
            total[rows - low] += moved
        rows = np.flatnonzero(count)
        blob = (rows + low).astype("<i4").tobytes() + (total[rows] / count[rows, None]).astype("<f4").tobytes()
    return pa.table([pa.array([part], pa.int32()), pa.array([blob], pa.binary())], ["part", "blob"])


def _moved(learner: Learner, parts: dict[int, bytes]) -> None:
    small = [*learner.net.params()[2:], *learner.speed[2:]]
    for p, d in zip(small, np.split(np.frombuffer(parts.pop(2 * SLICES), "<f8"), np.cumsum([p.size for p in small])[:-1])):
        p += d.reshape(p.shape).astype(p.dtype)
    for part, blob in parts.items():
        rows, moved = _rows_moved(blob)
        at = np.searchsorted(learner.rows[part // SLICES], rows)
        learner.net.params()[part // SLICES][at] += moved[:, :DIM]
        learner.speed[part // SLICES][at] += moved[:, DIM:]


def _calibration_batches(common: Broadcast):
    """Counts of the texts for the thresholds by guessed language, logit in steps of 1 / FINE, and label."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, known, which, first, y, held, _ in _packed(batches):
            net, cells = common.value, [np.zeros((0, 3), np.int64)]
            for d in np.flatnonzero(held):
                part = known[which[first[d] : first[d + 1]]], np.array([0, first[d + 1] - first[d]])
                z = np.floor(np.clip(net.logits(*part), -30, 30) * FINE + 0.5)
                cells.append(np.array([[net.language(*part)[0], z[0], y[d]]], np.int64))
            cells, n = np.unique(np.concatenate(cells), axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in cells.T), pa.array(n.astype(np.int64))], ["guess", "z", "y", "n"])

    return run


def _thresholds(cells: np.ndarray, names: int, shrink: float) -> np.ndarray:
    """cells: rows guess, z, y, n.  A language's own threshold is drawn to the common one, the more the fewer texts of the rarer label it has."""

    def cut(mine: np.ndarray) -> tuple[float, int]:
        z, at = np.unique(mine[:, 1], return_inverse=True)
        counts = np.zeros((2, len(z)))
        np.add.at(counts, (mine[:, 2], at), mine[:, 3])
        return _threshold(z / FINE, *counts), int(counts.sum(axis=1).min())

    if not len(cells):
        return np.zeros(max(1, names))
    whole = cut(cells)[0]
    out = np.full(max(1, names), whole)
    for i in range(names):
        mine = cells[cells[:, 0] == i]
        if len(mine) and (found := cut(mine))[1]:
            out[i] = (found[1] * found[0] + shrink * whole) / (found[1] + shrink)
    return out


def fit(docs: DataFrame, labels: DataFrame, each: int = 2500, rounds: int = 4, epochs: int = 3, batch: int = 64, rate: float = 0.8, drop: float = 0.85, shrink: float = 25.0, seed: int = 11) -> ToxicNet | float:
    """Learns from all labelled texts.  labels: doc_id and label (0 or 1), already without held-out rows.

    each: texts of a shard.  drop: share of the words left out of each training
    step.  shrink: texts of the rarer label at which a language's own threshold
    counts as much as the common one.
    """
    scratch = Scratch(docs.sparkSession, "toxicity")
    texts = shards(docs, labels, each, scratch)
    if texts is None:
        return 0.0
    counted = {r["name"]: r["blob"] for r in texts.mapInArrow(_survey_batches, "name string, blob binary").groupBy("name").applyInArrow(_survey_merged, "name string, blob binary").collect()}
    n = np.frombuffer(counted["y"], np.int64)
    if not n.all() or n.sum() < 10:
        return float(n[1] / n.sum()) if n.sum() else 0.0
    learner = Learner.start([np.unpackbits(np.frombuffer(counted[k], np.uint8), count=SIZE + 1) > 0 for k in "01"], seed)
    weights = np.sqrt(n.sum() / (2 * n))  # the rarer label counts for more
    options = {"epochs": epochs, "batch": batch, "rate": rate, "drop": drop}
    sc = docs.sparkSession.sparkContext
    for k in range(rounds):
        common = sc.broadcast(learner)
        moved = texts.mapInArrow(_round_batches(common, k, weights, seed, options), "part int, shard int, blob binary").groupBy("part").applyInArrow(_round_merged, "part int, blob binary")
        _moved(learner, {r["part"]: bytes(r["blob"]) for r in moved.collect()})
        common.destroy()
    net = learner.whole()
    names = sorted(k for k in counted if k[0] == "l")
    if names:
        by = np.stack([np.frombuffer(counted[k], np.int64) for k in names], axis=1) + 0.1
        by = by / by.sum(0)
        net.lang = np.log(by / by.sum(1, keepdims=True)).astype(np.float32)
    common = sc.broadcast(net)
    cells = texts.mapInArrow(_calibration_batches(common), "guess bigint, z bigint, y bigint, n bigint").groupBy("guess", "z", "y").agg(F.sum("n").alias("n")).collect()
    common.destroy()
    net.thresholds = _thresholds(np.array(cells, np.int64).reshape(-1, 4), len(names), shrink)
    scratch.drop("shards")
    return net


def _score_batches(common: Broadcast):
    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = common.value
        for batch in batches:
            out = np.zeros(batch.num_rows)
            for b in B.blocks(batch.column(1)):
                out[b.rows()] = net.scores(*word_hashes(b)) if isinstance(net, ToxicNet) else net
            out = np.round(out, 9)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out), pa.array((out >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return run


def predict(docs: DataFrame, net: ToxicNet | float) -> DataFrame:
    """doc_id, score and predicted of every row; reads doc_id and text only."""
    return pack_columns(docs, "doc_id", "text").mapInArrow(_score_batches(docs.sparkSession.sparkContext.broadcast(net)), "doc_id bigint, score double, predicted int")


def keep_clean(docs: DataFrame, net: ToxicNet | float) -> DataFrame:
    """The rows, with all their columns, that are not predicted toxic; only the texts go to Python."""

    common = docs.sparkSession.sparkContext.broadcast(net)

    def run(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        net = common.value
        for text in texts:
            out = np.zeros(len(text))
            for b in B.blocks(text):
                out[b.rows()] = net.scores(*word_hashes(b)) if isinstance(net, ToxicNet) else net
            yield pa.array(np.round(out, 9))

    return docs.where(F.arrow_udf(run, "double")(F.col("text")) < 0.5)
