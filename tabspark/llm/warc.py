"""WARC archives: one gzip member per record, written and read sequentially.

Writing: each task streams its rows into archives of bounded size in a shared
folder. An archive counts once its line stands in the manifest, a table Spark
commits; files left by lost or repeated attempts are in no manifest.

Reading: an archive is inflated incrementally, records are framed by their
Content-Length, and block and payload digests are verified.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabspark.llm.common import require, staged
from tabspark.session import scratch_path

VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID_PREFIX = "urn:page:"
CHUNK = 1 << 20
LEVEL = 3
READ_SCHEMA = (
    "path string, record_id string, record_type string, refers_to string, url string, "
    "payload_bytes long, payload_digest string, payload binary"
)


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def frame(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member."""
    head = b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    size = f"Content-Length: {len(block)}\r\n".encode()
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    parts = (VERSION + b"\r\n", head, size, b"\r\n", block, b"\r\n\r\n")
    return b"".join(map(packer.compress, parts)) + packer.flush()


def clean_uri(url: str) -> str:
    """A header value must not hold line ends; they and other controls are escaped."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def record(name: str | None, url: str | None, payload: bytes, holder: str | None, date: str) -> bytes:
    """A response, or a revisit of ``holder`` if that is given."""
    page = f"<{ID_PREFIX}{'null' if name is None else name}>"
    headers = [("WARC-Type", "revisit" if holder else "response"), ("WARC-Record-ID", page),
               ("WARC-Date", date)]
    if url is not None:
        headers.append(("WARC-Target-URI", clean_uri(url)))
    headers.append(("WARC-Payload-Digest", sha1_label(payload)))
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n"
    block = http.encode()
    if holder:
        headers += [("WARC-Refers-To", f"<{ID_PREFIX}{holder}>"), ("WARC-Profile", PROFILE)]
    else:
        block += payload
    headers += [("WARC-Block-Digest", sha1_label(block)),
                ("Content-Type", "application/http; msgtype=response")]
    return frame(headers, block)


def mark_revisits(pages: DataFrame, key: str, payload: str, min_bytes: int) -> DataFrame:
    """``pages`` with ``holder``: the id of the record a row revisits, else null.

    Rows with equal payloads of at least ``min_bytes`` bytes revisit the row with the
    largest id. Rows repeating that id, and groups without any id, are responses.
    """
    digest = F.sha1(F.col(payload))
    groups = (
        pages.where(F.octet_length(payload) >= min_bytes)
        .groupBy(digest.alias("digest"))
        .agg(F.max(key).alias("holder"), F.count("*").alias("n"))
        .where("n > 1")
        .select("digest", "holder")
    )
    digested = pages.withColumn("digest", F.when(F.octet_length(payload) >= min_bytes, digest))
    same = F.col(key).eqNullSafe(F.col("holder"))
    return (
        digested.join(groups, "digest", "left")
        .withColumn("holder", F.when(~same, F.col("holder")))
        .drop("digest")
    )


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url",
               text: str = "html", min_revisit_bytes: int = 1000,
               archive_bytes: int = 256 << 20) -> DataFrame:
    """Write a record per row below ``folder``; returns the committed manifest.

    ``folder`` must be one that every executor reaches. A null text is an empty
    payload, a null url leaves its header out, a null key is named ``null``. Other
    columns are ignored. An empty table writes no archive.
    """
    require(pages, [key, url, text])
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8").alias("payload"),
    )
    marked = mark_revisits(rows, "key", "payload", min_revisit_bytes).select(
        F.col("key").cast("string").alias("key"), "url", "payload",
        F.col("holder").cast("string").alias("holder"),
    )
    date = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, records, size = None, "", 0, 0

        def close() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_pylist([{"path": name, "records": records, "bytes": size}])

        for batch in batches:
            for values in zip(*batch.columns):
                k, u, payload, holder = (v.as_py() for v in values)
                data = record(k, u, payload, holder, date)
                if out is not None and size + len(data) > archive_bytes:
                    yield close()
                    out = None
                if out is None:
                    name, records, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{base}/{name}")
                out.write(data)
                records, size = records + 1, size + len(data)
        if out is not None:
            yield close()

    return staged(marked.mapInArrow(run, "path string, records long, bytes long"), "manifest")


class ArchiveError(ValueError):
    """The archive does not follow its framing, or a digest does not match."""


class Member:
    """Bytes of one gzip member after another, inflated as they are asked for."""

    def __init__(self, stream) -> None:
        self.stream, self.raw, self.plain = stream, b"", b""
        self.inflate = None

    def start(self) -> bool:
        """Go to the next member; False at the end of the archive."""
        self.raw = self.raw or self.stream.read(CHUNK)
        if not self.raw:
            return False
        self.inflate, self.plain = zlib.decompressobj(31), b""
        return True

    def more(self) -> bool:
        """Inflate at most one further chunk; False at the member's end."""
        if self.inflate.eof:
            return False
        if not self.raw:
            self.raw = self.stream.read(CHUNK)
        given = self.raw
        try:
            more = self.inflate.decompress(given, CHUNK)
        except zlib.error as error:
            raise ArchiveError(f"broken gzip member: {error}") from error
        if not (given or more or self.inflate.eof):
            raise ArchiveError("the archive ends within a record")
        self.plain += more
        self.raw = self.inflate.unused_data if self.inflate.eof else self.inflate.unconsumed_tail
        return True

    def line(self) -> bytes:
        while (end := self.plain.find(b"\r\n")) < 0:
            if not self.more():
                raise ArchiveError("a header line does not end")
        line, self.plain = self.plain[:end], self.plain[end + 2 :]
        return line

    def take(self, size: int) -> bytes:
        parts, have = [self.plain], len(self.plain)
        self.plain = b""
        while have < size:
            if not self.more():
                raise ArchiveError("a record is shorter than its Content-Length")
            parts.append(self.plain)
            have += len(self.plain)
            self.plain = b""
        data = b"".join(parts)
        self.plain = data[size:]
        return data[:size]

    def rest(self) -> bytes:
        while self.more():
            pass
        return self.plain


def records_of(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers in lower case, block) of each record of an open archive, digests checked."""
    member = Member(stream)
    while member.start():
        if not member.line().startswith(b"WARC/1."):
            raise ArchiveError("a record does not begin with its version")
        headers: dict[str, str] = {}
        while line := member.line():
            name, colon, value = line.decode("utf-8", "replace").partition(":")
            if not colon:
                raise ArchiveError("a header line has no colon")
            headers[name.strip().lower()] = value.strip()
        try:
            size = int(headers["content-length"])
        except (KeyError, ValueError) as error:
            raise ArchiveError("a record has no Content-Length") from error
        block = member.take(size)
        if member.rest() != b"\r\n\r\n":
            raise ArchiveError("a record does not end where its Content-Length says")
        if (said := headers.get("warc-block-digest")) and said != sha1_label(block):
            raise ArchiveError("a block digest does not match")
        yield headers, block


def payload_of(headers: dict[str, str], block: bytes) -> tuple[int, bytes | None]:
    """(bytes of the full payload, payload); a revisit has the length only."""
    head, _, body = block.partition(b"\r\n\r\n")
    if headers.get("warc-type") == "revisit":
        found = re.search(rb"(?mi)^content-length:\s*(\d+)", head)
        return int(found[1]) if found else 0, None
    if (said := headers.get("warc-payload-digest")) and said != sha1_label(body):
        raise ArchiveError("a payload digest does not match")
    return len(body), body


def bare(name: str | None) -> str | None:
    """The page id of a record id; null for none."""
    if name is None:
        return None
    found = name.strip("<>").removeprefix(ID_PREFIX)
    return None if found == "null" else found


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """A row per record of the manifest's archives, one archive after another in a task.

    ``payload_digest`` is lower-case hex; ``payload`` is null for revisits. Broken
    framing or a digest that does not match raises ``ArchiveError``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        names = [f.split()[0] for f in READ_SCHEMA.split(", ")]
        types = [pa.string()] * 5 + [pa.int64(), pa.string(), pa.binary()]

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names
            )

        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{base}/{path}") as stream:
                    for headers, block in records_of(stream):
                        size, payload = payload_of(headers, block)
                        label = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                        rows.append((
                            path, bare(headers.get("warc-record-id")), headers.get("warc-type"),
                            bare(headers.get("warc-refers-to")), headers.get("warc-target-uri"),
                            size, base64.b32decode(label).hex(), payload,
                        ))
                        held += len(block)
                        if len(rows) >= 5000 or held > 16 << 20:
                            yield packed(rows)
                            rows, held = [], 0
                if rows:
                    yield packed(rows)

    files = manifest.select("path", "bytes")
    # one archive per task, so that a lost task repeats one archive only
    n = max(1, manifest.count())
    return files.repartition(n, F.xxhash64("path")).mapInArrow(run, READ_SCHEMA)


def archive_folder(spark: SparkSession) -> str:
    path = scratch_path(spark, "warc")
    return path if "://" in path or path.startswith("file:") else f"file://{path}"
