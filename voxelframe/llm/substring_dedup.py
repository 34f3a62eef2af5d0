"""Repeated substrings over a de Bruijn graph of word windows.

Words are as they stand in the text.  A run of ``span`` words is an edge
between its first and its last ``span - 1`` words.  An edge is a repeat in a
document if it also starts in a document with a smaller doc_id; its source is
the least (document, place) where it starts.  ``remove_repeats`` takes the
words of all repeats out.

Edges are many and most of them occur once, so they are found in two steps:

1. Each edge has an anchor, the least hash among the runs of ``K`` words in
   it.  Equal edges have equal anchors.  Short hashes of the anchors go to
   buckets, one for each anchor and task, and those that occur in more than
   one document come back to their documents.
2. Only edges with such an anchor go to buckets by their anchor, with a hash
   of all their words and their coordinates.

A bucket has few neighbouring edges of a document, so what it finds are short
pieces of paths, as rows.  Pieces end in nodes, known by the place in the
document and in the source.  Nodes with one piece coming in and one going out
do not branch and vanish; what begins at a node without a piece before it is
joined with what ends at one without a piece behind it.  The words of such a
path, in the document and at its source, must agree (by a digest of the words
themselves, made from both texts), else it is dropped: hashes alone decide nothing.

A task sends an edge only for the least document among its own, as others
are repeats already: a passage that a third of all documents share costs one
row per task.  Nothing depends on how the rows are dealt out.

Defined results: null text has no words.  Rows with null doc_id count as no
source and lose no words.  Rows with equal doc_id are no sources of each
other.  Texts under ``span`` words lose none.  Further columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bytetext as B
from .bitmaps import bitmap, hit
from .blobs import by_bucket, groups, pack, unpack
from .shared import Scratch, lean, partitions

SPAN, K = 13, 8
_SALT = np.uint64(0xA24BAED4963EE407)


def edges(b: B.Block, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash and anchor of each run of span words, whether it ends within its document, and the first word of each document."""
    starts, ends, first = b.words()
    words, n = b.hashes(starts, ends), len(starts)
    if n < span:
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, bool), first
    runs = B.windows(words, K)
    anchor = runs[: n - span + 1].copy()
    for k in range(1, span - K + 1):
        np.minimum(anchor, runs[k : k + len(anchor)], out=anchor)
    return B.windows(words, span), B.mix(anchor ^ _SALT), B.inside(first, n, span), first


def _short(anchor: np.ndarray) -> np.ndarray:
    return (anchor & np.uint64(0xFFFFFFFF)).astype(np.uint32)


def _bucket(anchor: np.ndarray, n: int) -> np.ndarray:
    return ((anchor >> np.uint64(32)) % np.uint64(n)).astype(np.int32)


def _of(doc_first: np.ndarray, n: int) -> np.ndarray:
    return np.repeat(np.arange(len(doc_first) - 1), np.diff(doc_first))[:n]


def _small(values: np.ndarray) -> np.ndarray:
    """Numbers from 0 in as few bytes as they need."""
    top = int(values.max(initial=0))
    return values.astype("u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<i8")


def _kind(blob: bytes, k: int) -> str:
    """The type that _small chose for a blob's k-th array."""
    return {1: "u1", 2: "<u2", 4: "<u4", 8: "<i8"}[blob[5 + 8 * k]]


def _by_document(doc: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Records in the order of their documents, which these are, and how a blob names them: the records of each, the ids above the least, the least.

    A bucket holds few records of a document, the fewer the more buckets there are, so names are what a blob would be made of.
    """
    order = np.argsort(doc, kind="stable")
    g = groups(doc[order])
    names = doc[order[g[:-1]]]
    low = ids[names].min(initial=np.iinfo(np.int64).max) if len(names) else 0
    above = ids[names] - low
    if (above < 0).any():  # ids further apart than a number can tell
        low, above = 0, ids[names]
    return order, names, [_small(np.diff(g)), _small(above) if (above >= 0).all() else above, np.array([low], np.int64)]


def _ids(arrays: list[np.ndarray]) -> np.ndarray:
    """The id of each record; arrays: counts, ids above the least, the least."""
    return np.repeat(arrays[1].astype(np.int64) + arrays[2][0], arrays[0])


def _named(blob: bytes, *more: str) -> list[np.ndarray]:
    """Arrays of a blob that begins with names."""
    return unpack(blob, _kind(blob, 0), _kind(blob, 1), "<i8", *more)


def _part(ids: np.ndarray, n: int) -> np.ndarray:
    return (B.mix(ids.view(np.uint64)) % np.uint64(n)).astype(np.int32)


def _anchor_batches(span: int, buckets: int):
    """(bucket, doc_id, blob): to a bucket the short hashes of anchors and the document of each; to a document (bucket from its hash) those known to repeat."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(batches, 2):
            ids = batch.column(1).to_numpy()
            found, docs = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
            for b in B.blocks(batch.column(2)):
                _, anchor, ok, first = edges(b, span)
                doc = _of(first, len(anchor))
                new = ok.copy()
                new[1:] &= (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1]) | ~ok[:-1]
                found.append(anchor[new])
                docs.append(doc[new] + b.first)
            anchor, doc = np.concatenate(found), np.concatenate(docs)
            order = np.lexsort((doc, ids[doc], anchor))
            anchor, doc = anchor[order], doc[order]
            g = groups(anchor)
            size = np.diff(g)
            many = ids[doc[g[:-1]]] != ids[doc[g[1:] - 1]]  # in two of the task's own documents
            out: list[tuple] = []
            mine = np.repeat(many, size)
            o, who, at = by_bucket(doc[mine])
            short = _short(anchor[mine])[o]
            for i, (d, k) in enumerate(zip(who, _part(ids[who], buckets))):
                out.append((int(k), int(ids[d]), short[at[i] : at[i + 1]].tobytes()))
            lead = g[:-1]
            o, which, at = by_bucket(_bucket(anchor[lead], buckets))
            for i, k in enumerate(which):
                part = o[at[i] : at[i + 1]]
                order, _, names = _by_document(doc[lead[part]], ids)
                out.append((int(k), None, pack(*names, _short(anchor[lead[part[order]]]), np.packbits(many[part[order]]))))
            cols = list(zip(*out)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.int32()), pa.array(list(cols[1]), pa.int64()), pa.array(list(cols[2]), pa.binary())], ["bucket", "doc_id", "blob"])

    return run


_PART = "part int, blob binary"
_MARKED = "doc_id bigint, blob binary"


def _parts(ids: np.ndarray, buckets: int, short: np.ndarray) -> pa.Table:
    """One row per part of the documents (by hash) with their short hashes."""
    known, doc = np.unique(ids, return_inverse=True)
    order, found, at = by_bucket(_part(ids, buckets))
    blobs = []
    for i in range(len(found)):
        mine = order[at[i] : at[i + 1]]
        o, _, names = _by_document(doc[mine], known)
        blobs.append(pack(*names, short[mine[o]]))
    return pa.table([pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])


def _anchor_bucket(buckets: int):
    def run(key, table):
        """The documents whose anchors occur in two documents of the whole corpus, with these anchors."""
        short, ids, flag = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], [np.zeros(0, bool)]
        out_ids, out_short = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for doc, blob in zip(table.column("doc_id").to_pylist(), table.column("blob").to_pylist()):
            if doc is not None:
                out_short.append(np.frombuffer(blob, "<u4"))
                out_ids.append(np.full(len(out_short[-1]), doc, np.int64))
                continue
            *names, h, bits = _named(blob, "<u4", "u1")
            short.append(h), ids.append(_ids(names)), flag.append(np.unpackbits(bits, count=len(h)) > 0)
        short, ids, flag = map(np.concatenate, (short, ids, flag))
        if len(short):
            order = np.lexsort((ids, short))
            short, ids, flag = short[order], ids[order], flag[order]
            g = groups(short)
            many = (ids[g[:-1]] != ids[g[1:] - 1]) | np.logical_or.reduceat(flag, g[:-1])
            mine = np.repeat(many, np.diff(g))
            out_ids.append(ids[mine]), out_short.append(short[mine])
        return _parts(np.concatenate(out_ids), buckets, np.concatenate(out_short))

    return run


def _by_doc_id(key, table):
    """The short hashes of each document of a part."""
    found = [(_ids(names), short) for b in table.column("blob").to_pylist() for *names, short in [_named(b, "<u4")]]
    ids, short = map(np.concatenate, zip(*found))
    known, doc = np.unique(ids, return_inverse=True)
    order, _, at = by_bucket(doc)
    return pa.table([pa.array(known, pa.int64()), pa.array([pack(short[order[at[i] : at[i + 1]]]) for i in range(len(known))], pa.binary())], ["doc_id", "blob"])


def _packed(texts: pa.Array) -> pa.Array:
    """Each text compressed by itself: about two thirds of what the shuffle's own compression of rows leaves."""
    squeeze = zstandard.ZstdCompressor(level=1)
    return pa.array([None if t is None else squeeze.compress(t.encode()) for t in texts.to_pylist()], pa.binary())


def _plain(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches with the texts of a column as they were."""
    opened = zstandard.ZstdDecompressor()
    for batch in batches:
        texts = pa.array([None if t is None else opened.decompress(t) for t in batch.column(column).to_pylist()], pa.binary()).cast(pa.string())
        yield batch.set_column(column, batch.schema.names[column], texts)


def _chosen_batches(table: np.ndarray):
    """Only rows whose first column may be in the bitmap; the last one has texts, which are packed."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = batch.filter(pa.array(hit(table, batch.column(0).to_numpy().view(np.uint64))))
            yield pa.RecordBatch.from_arrays([*some.columns[:-1], _packed(some.columns[-1])], some.schema.names)

    return run


PIECE = ["rid", "place", "source_id", "source_place", "edges"]


def _pieces(rid: np.ndarray, place: np.ndarray, source: np.ndarray, at: np.ndarray) -> list[pa.Array]:
    """Repeats that follow each other in row and source, as one: row, place, source's document and place, number of edges."""
    order = np.lexsort((place, at - place, source, rid))
    rid, place, source, at = rid[order], place[order], source[order], at[order]
    g = groups(rid, source, at - place, place - np.arange(len(place)))
    return [pa.array(v.astype(np.int64)) for v in (rid[g[:-1]], place[g[:-1]], source[g[:-1]], at[g[:-1]], np.diff(g))]


def _edge_batches(span: int, buckets: int):
    """Paths found within the task, and edges for buckets."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in B.slices(_plain(batches, 2), 2):
            rid, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            marked = batch.column(3).to_pylist()
            hs, anchors, docs, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for b in B.blocks(batch.column(2)):
                h, anchor, ok, first = edges(b, span)
                short = _short(anchor)
                for d in range(b.n):
                    lo, hi = int(first[d]), min(int(first[d + 1]), len(h))
                    if hi > lo:
                        known = np.unique(unpack(marked[b.first + d], "<u4")[0])
                        at = np.minimum(np.searchsorted(known, short[lo:hi]), len(known) - 1)
                        hits = np.flatnonzero(ok[lo:hi] & (known[at] == short[lo:hi]))
                        hs.append(h[lo + hits]), anchors.append(anchor[lo + hits]), places.append(hits), docs.append(np.full(len(hits), b.first + d))
            h, anchor, doc, place = map(np.concatenate, (hs, anchors, docs, places))
            order = np.lexsort((place, ids[doc], h))
            h, anchor, doc, place = h[order], anchor[order], doc[order], place[order]
            g = groups(h)
            size = np.diff(g)
            lead = np.repeat(g[:-1], size)
            own = ids[doc] > ids[doc[lead]]  # repeats of a document of the same task
            at = np.flatnonzero(own)
            found = _pieces(rid[doc[at]], place[at], ids[doc[lead[at]]], place[lead[at]])
            sent = np.flatnonzero(~own)
            o, which, cut = by_bucket(_bucket(anchor[sent], buckets))
            blobs = []
            for i in range(len(which)):
                part = sent[o[cut[i] : cut[i + 1]]]
                order, which_docs, names = _by_document(doc[part], ids)
                blobs.append(pack(*names, rid[which_docs], h[part[order]], _small(place[part[order]])))
            cols = [pa.concat_arrays([c, pa.nulls(len(which), pa.int64())]) for c in found]
            none = pa.nulls(len(found[0]))
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([none.cast(pa.int32()), pa.array(which, pa.int32())]), *cols, pa.concat_arrays([none.cast(pa.binary()), pa.array(blobs, pa.binary())])], ["bucket", *PIECE, "blob"])

    return run


def _edge_bucket(key, table):
    """The pieces of paths that one bucket finds."""
    hs, rows, ids, places = [], [], [], []
    for blob in table.column("blob").to_pylist():
        *names, rid, h, place = _named(blob, "<i8", "<u8", _kind(blob, 5))
        hs.append(h), rows.append(np.repeat(rid, names[0])), ids.append(_ids(names)), places.append(place.astype(np.int64))
    h, row, ids, place = map(np.concatenate, (hs, rows, ids, places))
    order = np.lexsort((place, ids, h))
    h, row, ids, place = h[order], row[order], ids[order], place[order]
    g = groups(h)
    lead = np.repeat(g[:-1], np.diff(g))
    at = np.flatnonzero(ids > ids[lead])
    return pa.table(_pieces(row[at], place[at], ids[lead[at]], place[lead[at]]), PIECE)


def _repeats(docs: DataFrame, span: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The rows (rid, doc_id, text), and the pieces of paths in them."""
    spark = docs.sparkSession
    buckets = 2 * partitions(spark, 8)
    rows = docs.select(F.xxhash64("doc_id", "text").alias("rid"), "doc_id", "text")
    known = rows.where("doc_id is not null")
    anchors = known.mapInArrow(_anchor_batches(span, buckets), "bucket int, doc_id bigint, blob binary")
    marked = anchors.groupBy("bucket").applyInArrow(_anchor_bucket(buckets), _PART).groupBy("part").applyInArrow(_by_doc_id, _MARKED)
    marked = scratch.keep(marked, "marked")
    key = F.xxhash64("doc_id").alias("h")
    chosen = known.select(key, *known.columns).mapInArrow(_chosen_batches(bitmap(marked.select(key))), "h bigint, rid bigint, doc_id bigint, text binary")
    chosen = chosen.join(marked, "doc_id").select("rid", "doc_id", "text", "blob")
    piece = ", ".join(f"{c} bigint" for c in PIECE)
    passed = scratch.keep(chosen.mapInArrow(_edge_batches(span, buckets), f"bucket int, {piece}, blob binary"), "edges")
    found = passed.where("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(_edge_bucket, piece)
    pieces = scratch.keep(passed.where("bucket is null").select(*PIECE).union(found), "pieces")
    scratch.drop("marked", "edges")
    return rows, pieces


NODE = ["rid", "source_id", "shift", "place", "degree"]


def _nodes(*columns: np.ndarray) -> list[np.ndarray]:
    """The NODE columns, in their order, of the nodes with more pieces going out than coming in (degree) or less."""
    order = np.lexsort(columns[3::-1])
    columns = [c[order] for c in columns]
    g = groups(*columns[:4])
    degree = np.diff(np.concatenate([[0], np.cumsum(columns[4])])[g])
    at = g[:-1][degree != 0]
    return [*(c[at] for c in columns[:4]), degree[degree != 0]]


def _node_batches(parts: int, most: int = 1 << 18):
    """(part, blob): the nodes of the pieces, to the parts that their rows are in; what ends and begins in one task has gone."""

    def packed(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        rid, place, source, at, edges = map(np.concatenate, zip(*held))
        one = np.ones(len(rid), np.int64)
        nodes = _nodes(*(np.concatenate(c) for c in ((rid, rid), (source, source), (at - place, at - place), (place, place + edges), (one, -one))))
        order, found, cut = by_bucket(_part(nodes[0], parts))
        blobs = []
        for i in range(len(found)):
            line, place, degree = (lambda c: (c[:3], c[3], c[4]))([c[order[cut[i] : cut[i + 1]]] for c in nodes])
            g = groups(*line)
            blobs.append(pack(_small(np.diff(g)), _small(place), degree.astype("<i4"), *(c[g[:-1]] for c in line)))
        return pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(blobs, pa.binary())], ["part", "blob"])

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append([c.to_numpy() for c in batch.columns])
            n += batch.num_rows
            if n >= most:
                yield packed(held)
                held, n = [], 0
        if n:
            yield packed(held)

    return run


def _node_part(key, table):
    """The nodes of a part that are left when all tasks' are put together."""
    columns = []
    for blob in table.column("blob").to_pylist():
        n, place, degree, *line = unpack(blob, _kind(blob, 0), _kind(blob, 1), "<i4", "<i8", "<i8", "<i8")
        columns.append([*(np.repeat(c, n) for c in line), place.astype(np.int64), degree.astype(np.int64)])
    return pa.table(_nodes(*map(np.concatenate, zip(*columns))), NODE)


def _compacted(pieces: DataFrame, span: int) -> DataFrame:
    """Maximal paths: rid, place, source_id, source_place, n_words.  A node is a place on a line of (row, source, shift between them); the n-th head and the n-th tail on a line are of one path."""
    line = NODE[:3]
    parts = 2 * partitions(pieces.sparkSession, 8)
    nodes = pieces.select(*PIECE).mapInArrow(_node_batches(parts), _PART).groupBy("part")
    ends = nodes.applyInArrow(_node_part, ", ".join(f"{c} bigint" for c in NODE))
    # rows that are equal have one rid and may have their pieces cut differently, so several paths can begin at a node
    ends = ends.select(*line, "place", (F.col("degree") > 0).alias("head"), F.explode(F.sequence(F.lit(1).cast("bigint"), F.abs("degree"))).alias("j"))
    ends = ends.withColumn("i", F.row_number().over(Window.partitionBy(*line, "head").orderBy("place", "j")))
    heads, tails = ends.where("head").drop("head", "j"), ends.where("not head").select(*line, "i", F.col("place").alias("end"))
    return heads.join(tails, [*line, "i"]).select("rid", "place", "source_id", (F.col("place") + F.col("shift")).alias("source_place"), (F.col("end") - F.col("place") + span - 1).alias("n_words"))


def _digest(words: list[bytes]) -> bytes:
    return hashlib.sha256(b" ".join(words)).digest()[:16]


@lean
def _source_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of the words of a source's spans."""
    for batch in _plain(batches, 1):
        rows: list[tuple] = []
        for doc, text, spans in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            words = (text.as_py() or "").encode().split()
            rows += [(doc, s["source_place"], s["n_words"], _digest(words[s["source_place"] : s["source_place"] + s["n_words"]])) for s in spans]
        cols = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["source_id", "source_place", "n_words", "digest"])


def _with_digests(paths: DataFrame, rows: DataFrame, scratch: Scratch) -> DataFrame:
    """The paths with what their words must be, as the texts of their sources say."""
    span = ["source_id", "source_place", "n_words"]
    asked = scratch.keep(paths.groupBy("source_id").agg(F.collect_set(F.struct("source_place", "n_words")).alias("spans")), "asked")
    key = F.xxhash64("doc_id")
    sources = rows.where("doc_id is not null").select(key.alias("k"), "doc_id", "text")
    sources = sources.mapInArrow(_chosen_batches(bitmap(asked.select(F.xxhash64("source_id").alias("h")))), "k bigint, doc_id bigint, text binary")
    digests = sources.join(asked, F.col("doc_id") == F.col("source_id")).select("doc_id", "text", "spans").mapInArrow(_source_batches, "source_id bigint, source_place bigint, n_words bigint, digest binary")
    digests = scratch.keep(digests.groupBy(*span).agg(F.collect_set("digest").alias("digests")), "digests")  # rows that repeat a doc_id give several
    return paths.join(digests, span)


@lean
def _agreeing_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The spans (and where they come from) of each text whose words are those of their source."""
    for batch in batches:
        rows: list[tuple] = []
        for doc, text, paths in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            words = (text.as_py() or "").encode().split()
            rows += [(doc, p["place"], p["source_id"], p["source_place"], p["n_words"]) for p in paths if _digest(words[p["place"] : p["place"] + p["n_words"]]) in p["digests"]]
        cols = list(zip(*rows)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in cols], ["doc_id", "place", "source_id", "source_place", "n_words"])


def repeated_paths(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, place, source_id, source_place and n_words of the maximal paths of repeats."""
    scratch = Scratch(docs.sparkSession, "paths")
    rows, pieces = _repeats(docs, span, scratch)
    paths = _with_digests(scratch.keep(_compacted(pieces, span), "paths"), rows, scratch)
    paths = paths.groupBy("rid").agg(F.collect_list(F.struct("place", "source_id", "source_place", "n_words", "digests")).alias("paths"))
    return rows.join(paths, "rid").select("doc_id", "text", "paths").mapInArrow(_agreeing_batches, "doc_id bigint, place bigint, source_id bigint, source_place bigint, n_words bigint").distinct()


def _finished_batches(table: np.ndarray):
    """Word count and hash of each text; the text itself only where the bitmap says that it may lose words."""

    @lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maybe = hit(table, batch.column(0).to_numpy().view(np.uint64))
            texts, n_words, sha = [], [], []
            for m, t in zip(maybe, batch.column(2)):
                text = t.as_py() or ""
                words = () if m else text.encode().split()
                texts.append(text if m else None), n_words.append(len(words)), sha.append(None if m else hashlib.sha256(b" ".join(words)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _packed(pa.array(texts, pa.string())), pa.array(n_words, pa.int64()), pa.array(sha, pa.string())], ["rid", "doc_id", "text", "n_words", "kept_sha256"])

    return run


@lean
def _removed_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _plain(batches, 1):
        n_words, sha, n_removed = batch.column(2).to_pylist(), batch.column(3).to_pylist(), [0] * batch.num_rows
        for i, (text, paths) in enumerate(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist())):
            if text is None:
                continue
            words = text.encode().split()
            cover = np.zeros(len(words) + 1, np.int64)
            for path in paths or []:
                lo, hi = path["place"], path["place"] + path["n_words"]
                if _digest(words[lo:hi]) in path["digests"]:
                    cover[lo] += 1
                    cover[hi] -= 1
            kept = (np.cumsum(cover[:-1]) == 0).tolist()
            n_words[i], n_removed[i] = len(words), len(words) - sum(kept)
            sha[i] = hashlib.sha256(b" ".join(itertools.compress(words, kept))).hexdigest()
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(sha, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])


def remove_repeats(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """doc_id, n_words, n_removed and the SHA-256 of the words on no path, joined by single spaces."""
    scratch = Scratch(docs.sparkSession, "debruijn")
    rows, pieces = _repeats(docs, span, scratch)
    paths = scratch.keep(_compacted(pieces, span), "compacted")
    scratch.drop("pieces")
    paths = scratch.keep(_with_digests(paths, rows, scratch).groupBy("rid").agg(F.collect_list(F.struct("place", "n_words", "digests")).alias("paths")), "paths")
    scratch.drop("compacted", "asked", "digests")
    done = rows.mapInArrow(_finished_batches(bitmap(paths, "rid")), "rid bigint, doc_id bigint, text binary, n_words bigint, kept_sha256 string")
    cut = done.join(paths, "rid", "left").select("doc_id", "text", "n_words", "kept_sha256", "paths")
    return cut.mapInArrow(_removed_batches, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")
