"""WARC archives: a writer and a sequential reader.

An archive is a run of gzip members, one for each record.  The reader takes
the bytes in order: it inflates one member at a time with an incremental zlib
object, parses the record's header lines, frames the block by Content-Length
and checks the payload's SHA-1 against WARC-Payload-Digest.

Archives are kept as rows (segment, archive) of a table in the shared folder,
so that Spark's committed writers make them once, whatever task is retried,
on any file system.  ``archive`` is the content of one .warc.gz file; rows of
``spark.read.format("binaryFile")`` over real files can be read alike.

Pages with equal payloads share one response, the page with the largest id;
the others are revisits of it without a payload.  The largest id per digest is
aggregated before its shuffle.  Digests that repeat are broadcast behind a count of
them, so that no html moves; beyond ``BROADCAST_DIGESTS`` of them the join on the
digest is a shuffle, which AQE may split where one payload is frequent.

Defined results: null html is an empty payload; payloads shorter than
``least_bytes`` are never revisits; a page without id revisits the largest id
if there is one, else it is a response; rows that tie on the largest id are all
responses; an empty table gives an empty result; other columns are ignored, names may
clash; a null url leaves the target header out; control characters and
non-ASCII of a url are percent-encoded in the archive only.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded, cut, slices, stored

#: Compressed bytes after which a segment is closed.
SEGMENT_BYTES = 4 << 20
PIECE = 1 << 16
#: Repeated digests (some 30 bytes each) up to which they are broadcast.
BROADCAST_DIGESTS = 500_000
DATE = "2024-01-01T00:00:00Z"  # records must not differ between runs


class WarcError(ValueError):
    """A record that is cut short, badly framed or fails its digest."""


class Record(NamedTuple):
    kind: str
    record_id: str
    refers_to: str | None
    target: str | None
    digest: str
    payload_bytes: int
    payload: bytes


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record(page_id, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=''.join(map(chr, range(0x21, 0x7F))))}")
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def _members(archive: bytes) -> Iterator[bytes]:
    """The inflated gzip members of an archive, one at a time."""
    at, view = 0, memoryview(archive)
    while at < len(view):
        unpack, made, start = zlib.decompressobj(31), [], at
        while not unpack.eof:
            if at >= len(view):
                raise WarcError(f"the archive ends within the member at byte {start}")
            piece = view[at : at + PIECE]
            made.append(unpack.decompress(piece))
            at += len(piece) - len(unpack.unused_data)
        yield b"".join(made)


def read_records(archive: bytes) -> Iterator[Record]:
    for member in _members(archive):
        head, gap, rest = member.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        if not gap or not lines[0].startswith("WARC/"):
            raise WarcError("a member doesn't begin with a WARC header")
        named = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        length = int(named["content-length"])
        block, end = rest[:length], rest[length:]
        if len(block) != length or end != b"\r\n\r\n":
            raise WarcError(f"{named['warc-record-id']}: the block isn't framed by its length")
        if named.get("warc-block-digest", "").removeprefix("sha1:") not in ("", base32_sha1(block)):
            raise WarcError(f"{named['warc-record-id']}: block digest")
        http, _, payload = block.partition(b"\r\n\r\n")
        digest = named["warc-payload-digest"].removeprefix("sha1:")
        declared = int(re.search(rb"(?i)content-length:\s*(\d+)", http)[1])
        if named["warc-type"] == "response" and (len(payload) != declared or base32_sha1(payload) != digest):
            raise WarcError(f"{named['warc-record-id']}: payload digest")
        bare = lambda x: x and x.removeprefix("<urn:page:").removesuffix(">")
        yield Record(named["warc-type"], bare(named["warc-record-id"]), bare(named.get("warc-refers-to")), named.get("warc-target-uri"), digest, declared, payload)


def assign(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html, sha (hex), refers_to: null for responses."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    own = pages.select("page_id", "url", "html", F.sha1(body).alias("sha"), F.length(body).alias("_bytes"))
    repeated = cut(
        own.where(F.col("_bytes") >= least_bytes).groupBy("sha").agg(F.max("page_id").alias("last"), F.count("*").alias("n"))
        .where("n > 1 and last is not null").select(F.col("sha").alias("of"), "last")
    )
    revisit = F.col("last").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") < F.col("last")))
    return own.join(bounded(repeated, BROADCAST_DIGESTS), F.col("sha") == F.col("of"), "left").select("page_id", "url", "html", "sha", F.when(revisit, F.col("last")).alias("refers_to"))


def write(pages: DataFrame, least_bytes: int = 0) -> str:
    """Write a record for every page; return the path of the table of archives."""

    def pack(batches):
        held, size = [], 0
        for part in slices(batches, text="html"):
            for page, url, html, sha, refers in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "html", "sha", "refers_to"))):
                payload = (html or "").encode("utf-8")
                held.append(_record(page, url, payload, base64.b32encode(bytes.fromhex(sha)).decode(), refers))
                size += len(held[-1])
                if size >= SEGMENT_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["records", "archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int64()), pa.array([b"".join(held)], pa.binary())], ["records", "archive"])

    return stored(assign(pages, least_bytes).mapInArrow(pack, "records long, archive binary"), "warc")


COLUMNS = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "url": pa.string(), "payload": pa.binary()}
TYPES = {pa.int64(): "long", pa.string(): "string", pa.binary(): "binary"}


def read(archives: DataFrame, columns: tuple[str, ...] = tuple(COLUMNS)) -> DataFrame:
    """A row per record of the ``archive`` column, digests verified."""

    def unpack(batches):
        for batch in batches:
            for archive in batch.column(0):
                rows = {c: [] for c in columns}
                held = 0
                for r in read_records(archive.as_py()):
                    made = (int(r.record_id) if r.record_id else None, r.payload_bytes, r.digest, r.kind, int(r.refers_to) if r.refers_to else None, r.target, r.payload)
                    for c, v in zip(COLUMNS, made):
                        if c in rows:
                            rows[c].append(v)
                    held += len(r.payload) if "payload" in rows else 64
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(rows[c], COLUMNS[c]) for c in columns], list(columns))
                        rows, held = {c: [] for c in columns}, 0
                yield pa.RecordBatch.from_arrays([pa.array(rows[c], COLUMNS[c]) for c in columns], list(columns))

    return archives.select("archive").mapInArrow(unpack, ", ".join(f"{c} {TYPES[COLUMNS[c]]}" for c in columns))


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write all pages and read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    return read(spark.read.parquet(write(pages, least_bytes)), tuple(COLUMNS)[:5])
