"""WARC archives: one gzip member per record, written and read by Spark tasks.

Records follow the public WARC/1.1 layout. Equal payloads of at least
`min_revisit_bytes` are stored once, in the record of the smallest page_id; the
others become revisit records that name it. The reader walks an archive from
front to back: incremental zlib, one member at a time, blocks framed by
Content-Length, digests verified as the bytes arrive.

Defined results: null html or url is an empty payload or target; a null
page_id is written as an empty identifier and read back as null (it never is
the target of a revisit); repeated rows each give a record: rows of one
page_id go by their own payloads, and the smallest page_id that has a payload is
a response in each of its rows; an empty table gives no archive and no rows;
other columns of the table are ignored.

Archives are files of the shared folder, which tasks open with `pyarrow.fs`:
local or mounted folders, HDFS, S3, GCS, Azure (s3a:// and the like by their
names there), and any other that libhdfs knows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_spread, map_batches, only, partitions, tune

#: An archive is closed once it has this many compressed bytes.
ARCHIVE_BYTES = 16 << 20
CHUNK = 1 << 16
MIN_REVISIT_BYTES = 100
_DATE = "2025-01-01T00:00:00Z"


class WarcError(ValueError):
    """An archive that breaks the format or a digest."""


def _record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def _page_of(record_id: str) -> int | None:
    name = record_id.removeprefix("<urn:page:").removesuffix(">")
    return int(name) if name else None


def build_record(page_id: int | None, url: str, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """An uncompressed WARC record; a revisit leaves the payload out."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        "WARC-Target-URI: " + "".join(c for c in url if c >= " "),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines.insert(3, f"WARC-Refers-To: {_record_id(refers_to)}")
        lines.insert(4, "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def members(read: Callable[[int], bytes]) -> Iterator[Iterator[bytes]]:
    """Decompressed pieces of each gzip member of a stream, in order."""
    held = read(CHUNK)
    while held:
        state = zlib.decompressobj(wbits=31)

        def pieces() -> Iterator[bytes]:
            nonlocal held
            while not state.eof:
                if not held:
                    raise WarcError("archive ends within a gzip member")
                out = state.decompress(held, CHUNK)
                held = state.unused_data if state.eof else state.unconsumed_tail or read(CHUNK)
                if out:
                    yield out

        yield pieces()
        if not state.eof:
            raise WarcError("a record was not read to its end")
        held = held or read(CHUNK)


def _head(buffer: bytes, more: Iterator[bytes]) -> tuple[bytes, bytes]:
    """Split off what precedes the first blank line, reading on as needed."""
    while (at := buffer.find(b"\r\n\r\n")) < 0:
        piece = next(more, None)
        if piece is None:
            raise WarcError("no end of the header")
        buffer += piece
    return buffer[:at], buffer[at + 4 :]


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(": ") for line in head.decode().split("\r\n")[1:])
    return {k.lower(): v for k, _, v in pairs}


def read_record(pieces: Iterator[bytes], with_payload: bool = True) -> dict:
    """One record, framed by its Content-Length and checked against its digest."""
    head, rest = _head(b"", pieces)
    if not head.startswith(b"WARC/1."):
        raise WarcError("not a WARC record")
    fields = _fields(head)
    left = int(fields["content-length"])
    http, rest = _head(rest, pieces)
    left -= len(http) + 4
    stated = int(_fields(http)["content-length"])
    sha, kept, size = hashlib.sha256(), [], 0
    while True:
        part = rest[:left]
        sha.update(part)
        size += len(part)
        left -= len(part)
        if with_payload:
            kept.append(part)
        if not left:
            rest = rest[len(part) :]
            break
        rest = next(pieces, b"")
        if not rest:
            raise WarcError("record shorter than its Content-Length")
    if rest + b"".join(pieces) != b"\r\n\r\n":
        raise WarcError("record longer than its Content-Length")
    digest = fields["warc-payload-digest"].removeprefix("sha256:")
    revisit = fields["warc-type"] == "revisit"
    if not revisit and (size != stated or sha.hexdigest() != digest):
        raise WarcError(f"digest mismatch in {fields['warc-record-id']}")
    return {
        "page_id": _page_of(fields["warc-record-id"]),
        "url": fields["warc-target-uri"],
        "payload_bytes": stated,
        "payload_digest": digest,
        "record_type": fields["warc-type"],
        "refers_to": _page_of(fields["warc-refers-to"]) if revisit else None,
        "payload": b"".join(kept) if with_payload and not revisit else None,
    }


def open_store(uri: str) -> tuple[pafs.FileSystem, str]:
    """(file system, path) of a folder or file, by the name that Spark has for it."""
    scheme, _, rest = uri.partition("://")
    uri = f"{_SCHEMES.get(scheme, scheme)}://{rest}" if rest else uri
    try:
        return pafs.FileSystem.from_uri(uri)
    except pa.ArrowInvalid:
        if not rest:
            raise
        host, _, path = rest.partition("/")
        return pafs.HadoopFileSystem(f"{scheme}://{host}"), "/" + path


#: Names of Hadoop's connectors, and those that pyarrow has for the same stores.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "abfss": "abfs"}


def plan_records(pages: DataFrame, min_revisit_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages(page_id, url, html) with refers_to: the smallest page_id of an equal payload."""
    p = only(pages, "page_id", "url", "html")
    p = p.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    digest = F.when((F.octet_length("html") >= min_revisit_bytes) & F.col("page_id").isNotNull(), F.unhex(F.sha2("html", 256)))
    first = p.select("page_id", digest.alias("digest")).where("digest IS NOT NULL").groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("copies"))
    known = join_spread(p.withColumn("digest", digest), first.where("copies > 1"), ["digest"], "copies", F.col("page_id"))
    return known.select("page_id", "url", "html", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, scratch: Scratch, archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> DataFrame:
    """Write the archives in the shared folder; returns archives(path, records).

    A task writes under a name of its own and renames when the archive is
    whole. A task that is run again writes new files; only those of the
    attempt that succeeded are listed.
    """
    root = scratch.path()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_store(root)
        store.create_dir(base, recursive=True)
        out, path, size, count = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            store.move(path + ".part", path)
            return pa.RecordBatch.from_pydict({"path": [root + path[len(base) :]], "records": pa.array([count], pa.int64())})

        for batch in batches:
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None:
                    path, size, count = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(path + ".part", compression=None)
                payload = html.encode()
                record = build_record(page_id, url, payload, hashlib.sha256(payload).hexdigest(), refers_to)
                press = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = press.compress(record) + press.flush()
                out.write(member)
                size, count = size + len(member), count + 1
                if size >= archive_bytes:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return scratch.keep(map_batches(plan_records(pages).select("page_id", "url", "html", "refers_to"), write, "path string, records long"))


READ_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records of archives(path), each archive read front to back by one task."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in READ_SCHEMA.split(", ")]

        def batch_of(rows: list[dict]) -> pa.RecordBatch:
            types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
            cols = [*names, "payload"] if with_payload else names
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], types.get(c, pa.string())) for c in cols], cols)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, at = open_store(path)
                rows, held = [], 0
                with store.open_input_stream(at, compression=None) as stream:
                    for pieces in members(stream.read):
                        rows.append(read_record(pieces, with_payload))
                        held += rows[-1]["payload_bytes"] if with_payload else 100
                        if held > 4 << 20:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    paths = only(archives, "path").repartition(partitions(archives.sparkSession), F.xxhash64("path"))
    return map_batches(paths, read, READ_SCHEMA + (", payload binary" if with_payload else ""))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(tune(spark), "warc")
    archives = write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet"), scratch)
    return read_archives(archives, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP8_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND page_id > first_id THEN first_id END AS refers_to
FROM f
"""
