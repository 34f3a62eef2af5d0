"""WARC archives: write, normalise whole-file gzip streams, read back.

``write_archives`` writes one record per page into archives that are each a
single gzip stream.  ``normalise`` inflates every such stream once, front to
back, rewrites each record as its own gzip member and writes a sidecar index
(one JSON line per record with its offset and length) next to the archive.
``read_archives`` goes through the indexes and reads each record by its place.

Of records with equal payloads the one with the smallest page_id is a
response; the others are revisits without a body, whose HTTP header keeps the
payload's length.  Which are equal is found on SHA-1 digests, aggregated
before the shuffle, so a payload that a third of all pages share costs one row
per task.

Files go to the folder that driver and executors share.  A task writes under a
name of its own and reports it in its result rows, so only the files of tasks
that ended count and a lost executor leaves nothing but an unread file.
Memory: one record and one buffer at a time.

Defined results: null html is an empty payload; empty payloads equal each
other.  Null page_id is kept and is a response only among payloads that have
no other page_id.  Rows that repeat a response's page_id and payload are
responses too.  Null url: no target header.  Line breaks in a url are
percent-encoded.  Further columns are ignored; no rows give no archive.
"""

from __future__ import annotations

import base64
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch

BUFFER = 1 << 20
_ID = "urn:page:"


def _file(uri: str):
    return pa.fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _name(page_id: int | None) -> str:
    return f"<{_ID}{'' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, revisit: bool = False, refers_to: int | None = None) -> bytes:
    """One WARC record, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(f"%{ord(c):02X}" if c < " " else c for c in url))
    head.append(f"WARC-Payload-Digest: sha1:{digest(payload)}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (lower-case names) and block of an uncompressed record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    fields = {k.lower(): v for k, v in fields.items()}
    return fields, rest[: int(fields["content-length"])]


def inflate(source) -> Iterator[bytes]:
    """The bytes of a gzip file of one or more members, in pieces."""
    z = zlib.decompressobj(31)
    while data := source.read(BUFFER):
        while data:
            yield z.decompress(data)
            data = z.unused_data
            if z.eof:
                z = zlib.decompressobj(31)
    if rest := z.flush():
        yield rest


def records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Single records from the inflated stream of an archive."""
    held = bytearray()
    need, pieces = None, iter(pieces)
    while True:
        if need is None and (end := held.find(b"\r\n\r\n")) >= 0:
            for line in held[:end].split(b"\r\n"):
                if line[:15].lower() == b"content-length:":
                    need = end + 4 + int(line[15:]) + 4
            if need is None:
                raise ValueError("a record without Content-Length")
        if need is not None and len(held) >= need:
            yield bytes(held[:need])
            del held[:need]
            need = None
            continue
        piece = next(pieces, None)
        if piece is None:
            if held.strip():
                raise ValueError("the archive ends within a record")
            return
        held += piece


def _write_batches(folder: str, roll: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, where = _file(folder)
        out, path, z, size, n = None, "", None, 0, 0
        done: list[tuple[str, int]] = []

        def close() -> None:
            nonlocal out
            if out is not None:
                out.write(z.flush())
                out.close()
                done.append((path, n))
                out = None

        for batch in batches:
            for page_id, url, html, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, z, size, n = f"{where}/{uuid.uuid4().hex}.warc.gz", zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                    out = fs.open_output_stream(path, compression=None)
                raw = record(page_id, url, (html or "").encode(), bool(revisit), refers_to)
                out.write(z.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= roll:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{p.rsplit('/', 1)[1]}" for p, _ in done], pa.string()), pa.array([k for _, k in done], pa.int64())], ["archive", "records"])

    return run


def revisits(pages: DataFrame, min_bytes: int) -> DataFrame:
    """page_id, payload digest and refers_to of the pages that revisit another."""
    slim = pages.select("page_id", "sha", "size").where(F.col("size") >= min_bytes)
    first = slim.groupBy("sha").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    return slim.join(first, "sha").where("not (page_id <=> refers_to)").select("page_id", "sha", "refers_to").distinct()


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, roll: int = 64 << 20) -> DataFrame:
    """archive and records of each written archive; one gzip stream of about ``roll`` bytes of records each."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    pages = pages.select("page_id", "url", "html").withColumns({"sha": F.sha1(payload), "size": F.length(payload)})
    again = revisits(pages, min_bytes).select(F.col("page_id").alias("p"), F.col("sha").alias("s"), "refers_to", F.lit(True).alias("revisit"))
    rows = pages.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("sha") == F.col("s")), "left").select("page_id", "url", "html", "revisit", "refers_to")
    return rows.mapInArrow(_write_batches(folder, roll), "archive string, records bigint")


def rewrite(source, out) -> Iterator[dict]:
    """Inflate one stream, write each record as its own member, give the index."""
    at = 0
    for raw in records(inflate(source)):
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = z.compress(raw) + z.flush()
        out.write(member)
        fields, _ = parse(raw)
        yield {"offset": at, "length": len(member), "id": fields["warc-record-id"], "type": fields["warc-type"], "digest": fields.get("warc-payload-digest"), "url": fields.get("warc-target-uri")}
        at += len(member)


def _normalise_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for archive in batch.column(0).to_pylist():
                fs, path = _file(archive)
                name = f"{folder}/{uuid.uuid4().hex}"
                to, base = _file(name)
                n = 0
                with fs.open_input_stream(path, compression=None) as source, to.open_output_stream(f"{base}.warc.gz", compression=None) as out, to.open_output_stream(f"{base}.index", compression=None) as index:
                    for entry in rewrite(source, out):
                        index.write(json.dumps(entry).encode() + b"\n")
                        n += 1
                found.append((f"{name}.warc.gz", f"{name}.index", n))
            cols = list(zip(*found)) or [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(list(cols[0]), pa.string()), pa.array(list(cols[1]), pa.string()), pa.array(list(cols[2]), pa.int64())], ["archive", "index", "records"])

    return run


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """archive, index and records of the rewritten form of each archive (a column archive with their places)."""
    return archives.select("archive").mapInArrow(_normalise_batches(folder), "archive string, index string, records bigint")


def _page(name: str) -> int | None:
    text = name[1:-1].removeprefix(_ID)
    return int(text) if text else None


def _read_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for archive, index in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            fs, path = _file(archive)
            at, where = _file(index)
            rows = []
            with fs.open_input_file(path) as source, at.open_input_stream(where, compression=None) as lines:
                for line in lines.read().splitlines():
                    entry = json.loads(line)
                    fields, block = parse(zlib.decompress(source.read_at(entry["length"], entry["offset"]), 31))
                    head, _, payload = block.partition(b"\r\n\r\n")
                    if fields["warc-type"] == "response":
                        size, code, refers = len(payload), digest(payload), None
                    else:
                        size = int(head.lower().split(b"content-length:")[1].split(b"\r\n")[0])
                        code, refers = fields["warc-payload-digest"].removeprefix("sha1:"), _page(fields["warc-refers-to"])
                    rows.append((_page(fields["warc-record-id"]), size, code, fields["warc-type"], refers, archive, entry["offset"]))
            cols = list(zip(*rows)) or [[]] * 7
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "archive", "record_offset"])


def read_archives(archives: DataFrame) -> DataFrame:
    """One row per record, read from its place in the archive."""
    schema = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, archive string, record_offset bigint"
    return archives.select("archive", "index").mapInArrow(_read_batches, schema)


def round_trip(pages: DataFrame, min_bytes: int = 0, roll: int = 64 << 20) -> DataFrame:
    """Write the pages, normalise the archives and read them back."""
    spark = pages.sparkSession
    scratch = Scratch(spark, "warc")
    for name in ("streams", "members"):
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{scratch.path}/{name}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(at)
    written = scratch.keep(write_archives(pages, f"{scratch.path}/streams", min_bytes, roll), "written")
    many = spark.sparkContext.defaultParallelism * 4
    members = scratch.keep(normalise(written.repartition(many, "archive"), f"{scratch.path}/members"), "normalised")
    scratch.drop("streams", "written")
    return read_archives(members.repartition(many, "archive")).drop("archive", "record_offset")
