"""WARC archives, written from a table and read back as a chunked record table.

Writing: a payload's digest decides whether its record is a response or a revisit of an earlier one. Each task writes
archives of its own, a gzip member a record, to the folder that all executors share, and returns a manifest row for
each; only archives in the manifest count, so a task that runs twice leaves nothing that is read.

Reading: each archive is one stream. A payload comes as rows of record and chunk number, at most CHUNK bytes each,
with the length and the SHA-256 so far, so that no record is held whole, however large.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shared_path, written

#: Tasks that read archives, if there are so many archives.
READERS = 10_000
#: Bytes of a chunk and of an archive before the next one begins; payload bytes from which equal ones are revisits.
CHUNK, ARCHIVE_BYTES, LEAST_REVISIT = 1 << 20, 256 << 20, 100
DATE = "1970-01-01T00:00:00Z"
_ID = "<urn:x-page:{}>"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def decided(pages: DataFrame, id_col: str, payload_col: str, uri_col: str | None) -> DataFrame:
    """(id, uri, payload, n_bytes, digest, refers_to): refers_to is the smallest id with an equal payload, if not its own."""
    payload = F.encode(F.coalesce(F.col(f"`{payload_col}`").cast("string"), F.lit("")), "UTF-8")
    uri = F.col(f"`{uri_col}`").cast("string") if uri_col else F.lit(None).cast("string")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), uri.alias("uri"), payload.alias("payload"))
    rows = rows.withColumns({"n_bytes": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    # a short payload has a key of its own, so that none of them gather
    alone = F.concat(F.lit("-"), F.coalesce(F.col("id").cast("string"), F.lit("")), F.col("digest"))
    rows = rows.withColumn("key", F.when((F.col("n_bytes") >= LEAST_REVISIT) & F.col("id").isNotNull(), F.col("digest")).otherwise(alone))
    firsts = rows.where(F.col("key") == F.col("digest")).groupBy("key").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last").select("key", "first")
    found = rows.join(firsts, "key", "left")
    return found.select("id", "uri", "payload", "n_bytes", "digest", F.when(F.col("first") != F.col("id"), F.col("first")).alias("refers_to"))


def head(record_id: object, uri: str | None, n_bytes: int, digest: str, refers_to: object, date: str) -> tuple[bytes, bytes]:
    """The WARC header and the HTTP header of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = len(http) + (n_bytes if refers_to is None else 0)
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {_ID.format('' if record_id is None else record_id)}",
        f"WARC-Date: {date}",
        *([f"WARC-Target-URI: {''.join(c if c > ' ' else f'%{ord(c):02X}' for c in uri)}"] if uri else []),
        *([f"WARC-Refers-To: {_ID.format(refers_to)}", f"WARC-Profile: {_PROFILE}"] if refers_to is not None else []),
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http;msgtype=response",
        f"Content-Length: {block}",
    ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n", http


def archived(pages: DataFrame, folder: str, id_col: str = "page_id", payload_col: str = "html", uri_col: str | None = "url", date: str = DATE) -> DataFrame:
    """Writes a record for each row of pages to archives in folder; returns the manifest: path, n_records, n_bytes.

    A null payload is an empty one. Records of equal payloads of LEAST_REVISIT bytes or more: the smallest id's is the
    response and the others revisit it; rows that repeat that id are responses too. A null id gives a response. An
    empty table gives no archive. Other columns aren't read.
    """
    rows = decided(pages, id_col, payload_col, uri_col)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, at = file_system(folder)
        store.create_dir(at, recursive=True)
        out, name, count, size, part = None, "", 0, 0, 0
        done = []
        for b in batches:
            for record_id, uri, payload, n_bytes, digest, refers_to in zip(*b.columns, strict=True):
                if out is None:
                    name = f"part-{TaskContext.get().partitionId():05d}-{part:04d}-{uuid.uuid4().hex}.warc.gz"
                    out, count, size, part = store.open_output_stream(f"{at}/{name}", compression=None), 0, 0, part + 1
                warc, http = head(record_id.as_py(), uri.as_py(), n_bytes.as_py(), digest.as_py(), refers_to.as_py(), date)
                member = zlib.compressobj(1, zlib.DEFLATED, 31)
                pieces = [warc, http] + ([] if refers_to.is_valid else [memoryview(payload.as_buffer())[k : k + CHUNK] for k in range(0, n_bytes.as_py(), CHUNK)]) + [b"\r\n\r\n"]
                for piece in pieces:
                    size += out.write(member.compress(piece))
                size += out.write(member.flush())
                count += 1
                if size >= ARCHIVE_BYTES:
                    out.close()
                    done.append((f"{folder}/{name}", count, size))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", count, size))
        if done:
            paths, counts, sizes = zip(*done, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(counts, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "n_records", "n_bytes"])

    return written(rows.mapInArrow(write, "path string, n_records long, n_bytes long"), "warc-manifest")


def headers(stream: io.BufferedReader) -> dict[str, str] | None:
    """The header lines up to an empty one, names in lower case; None at the end of the stream."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    found = {"": line.strip().decode("latin-1")}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode("utf-8", "replace").partition(":")
        found[name.strip().lower()] = value.strip()
    return found


def number(urn: str | None) -> int | None:
    digits = (urn or "").rpartition(":")[2].rstrip(">")
    return int(digits) if digits else None


def chunks(stream: io.BufferedReader, size: int = CHUNK) -> Iterator[tuple]:
    """(record, chunk number, bytes, length so far, digest so far, last, type, refers to) of all records in a stream.

    A record has a chunk at least; a revisit has one without bytes, with the length and digest that its header gives.
    A payload that its record's digest doesn't fit raises an error, as does a cut record.
    """
    while (warc := headers(stream)) is not None:
        record, kind, refers_to = number(warc["warc-record-id"]), warc["warc-type"], number(warc.get("warc-refers-to"))
        stated = warc["warc-payload-digest"].removeprefix("sha256:")
        http = headers(stream)
        total = int(http["content-length"])
        if kind == "revisit":
            yield record, 0, b"", total, stated, True, kind, refers_to
            continue
        hashed, read, chunk = hashlib.sha256(), 0, 0
        while read < total or not chunk:
            data = stream.read(min(size, total - read))
            if len(data) < min(size, total - read):
                raise ValueError(f"record {record} is cut after {read + len(data)} of {total} bytes")
            hashed.update(data)
            read += len(data)
            yield record, chunk, data, read, hashed.hexdigest(), read == total, kind, refers_to
            chunk += 1
        if hashed.hexdigest() != stated:
            raise ValueError(f"record {record} doesn't fit its digest")


def chunk_table(manifest: DataFrame, with_data: bool = True, size: int = CHUNK) -> DataFrame:
    """The chunked record table of a manifest's archives: record_id, chunk_no, data (null without with_data), n_bytes and
    digest so far, is_last, record_type, refers_to. A record's chunks stand in one partition, in order."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_(), pa.string(), pa.int64()]
        names = ["record_id", "chunk_no", "data", "n_bytes", "digest", "is_last", "record_type", "refers_to"]

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        rows, held = [], 0
        for b in batches:
            for path in b.column(0).to_pylist():
                store, at = file_system(path)
                with store.open_input_stream(at, compression=None) as raw, io.BufferedReader(gzip.GzipFile(fileobj=raw), 1 << 18) as stream:
                    for row in chunks(stream, size):
                        held += len(row[2])
                        rows.append(row if with_data else (*row[:2], None, *row[3:]))
                        if len(rows) >= 2048 or with_data and held >= 8 * CHUNK:
                            yield batch(rows)
                            rows, held = [], 0
        if rows:
            yield batch(rows)

    # a number of its own: by their bytes alone all paths would go to one task
    readers = max(1, min(READERS, manifest.count()))
    paths = manifest.select("path").repartition(readers, "path")
    return paths.mapInArrow(read, "record_id long, chunk_no long, data binary, n_bytes long, digest string, is_last boolean, record_type string, refers_to long")


def round_trip(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives pages and reads the archives back: a row for each record, its length and digest from its last chunk."""
    folder = folder or shared_path(pages.sparkSession, "warc")
    table = chunk_table(archived(pages, folder), with_data=False).where("is_last")
    return table.select(F.col("record_id").alias("page_id"), F.col("n_bytes").alias("payload_bytes"), F.col("digest").alias("payload_digest"), "record_type", "refers_to")


#: The same over whole tables in DuckDB.
SQL = """
with p as (
    select page_id, coalesce(html, '') as html from pages
), d as (
    select page_id, octet_length(encode(html)) as n, sha256(html) as h from p
), f as (
    select h, min(page_id) as first from d where n >= 100 group by h
)
select d.page_id, cast(d.n as bigint) as payload_bytes, d.h as payload_digest,
       case when first is null or first = d.page_id then 'response' else 'revisit' end as record_type,
       case when first <> d.page_id then first end as refers_to
from d left join f on d.n >= 100 and d.h = f.h
"""
