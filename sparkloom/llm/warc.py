"""WARC archives: a writer of deduplicated response and revisit records, and a sequential reader.

Archives hold one gzip member per record, a warcinfo record first. A record's id holds its page's, so that a revisit names the record it
refers to as any reader expects. The reader inflates them incrementally from a stream, frames records by their
Content-Length, and checks that each member ends with its record and that block and payload digests agree. Archives lie in
the shared folder of the cluster; a task writes under a name of its own attempt, and only files of attempts that succeeded
are in the manifest that the reader follows.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, short_batches, stored, work_dir

LEVEL, READ_BYTES = 1, 1 << 20
#: Low bits of the record ids that hold a page number; the target of pages without a URL.
PAGE_MARK, NO_URL = 0x1A0F1E2D3C4B5, "about:blank"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    """A UUID of version 8 (own bits) with the page's number in it; a random one of version 4 for a page without number."""
    if page_id is None:
        return f"<urn:uuid:{uuid.uuid4()}>"
    n = page_id & (1 << 64) - 1
    return f"<urn:uuid:{uuid.UUID(int=(n >> 16) << 80 | 0x8 << 76 | (n >> 4 & 0xFFF) << 64 | 0b10 << 62 | (n & 0xF) << 58 | PAGE_MARK)}>"


def page_of(record: str | None) -> int | None:
    """The page's number in a record's id; None if it holds none."""
    x = uuid.UUID(record.removeprefix("<urn:uuid:").removesuffix(">")).int if record else 0
    if x >> 76 & 0xF != 8 or x & (1 << 58) - 1 != PAGE_MARK:
        return None
    n = (x >> 80) << 16 | (x >> 64 & 0xFFF) << 4 | x >> 58 & 0xF
    return n - (1 << 64) if n >> 63 else n


def member(fields: dict[str, str], block: bytes) -> bytes:
    """A record as a gzip member."""
    fields = fields | {"WARC-Block-Digest": digest(block), "Content-Length": str(len(block))}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    deflate = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return deflate.compress(head.encode() + block + b"\r\n\r\n") + deflate.flush()


def info(date: str) -> bytes:
    """The record that begins an archive."""
    return member({"WARC-Type": "warcinfo", "WARC-Record-ID": record_id(None), "WARC-Date": date, "Content-Type": "application/warc-fields"}, b"software: sparkloom\r\nformat: WARC File Format 1.1\r\n")


def record(page_id, url: str, payload: bytes, refers_to=None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """One page's record. A revisit keeps the HTTP header with the payload's size, not the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": (url or NO_URL).replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": digest(payload),
        "Content-Type": "application/http; msgtype=response",
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": record_id(refers_to), "WARC-Refers-To-Date": date}
    return member(fields, http if refers_to is not None else http + payload)


class BadRecord(ValueError):
    pass


def members(stream) -> Iterator[bytes]:
    """Inflated gzip members, one at a time."""
    left = b""
    while True:
        left = left or stream.read(READ_BYTES)
        if not left:
            return
        inflate, out = zlib.decompressobj(31), []
        while not inflate.eof:
            if not left:
                left = stream.read(READ_BYTES)
                if not left:
                    raise BadRecord("the archive ends inside a member")
            out.append(inflate.decompress(left))
            left = inflate.unused_data
        yield b"".join(out)


def parse(one: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """Fields, HTTP header and payload of one record, all verified."""
    head, found, rest = one.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not found or not version.startswith("WARC/"):
        raise BadRecord("no WARC header")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    size = int(fields["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise BadRecord("Content-Length doesn't frame the record")
    if digest(block) != fields["WARC-Block-Digest"]:
        raise BadRecord("block digest")
    http, _, payload = block.partition(b"\r\n\r\n")
    if fields["WARC-Type"] == "response" and digest(payload) != fields["WARC-Payload-Digest"]:
        raise BadRecord("payload digest")
    return fields, http, payload


def read_archive(stream) -> Iterator[tuple]:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of each record in order."""
    for one in members(stream):
        fields, http, payload = parse(one)
        if fields["WARC-Type"] == "warcinfo":
            continue
        size = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
        if fields["WARC-Type"] == "response" and size != len(payload):
            raise BadRecord("HTTP Content-Length")
        url = fields["WARC-Target-URI"]
        yield page_of(fields["WARC-Record-ID"]), "" if url == NO_URL else url, size, fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"], page_of(fields.get("WARC-Refers-To")), payload


def open_fs(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if ":/" in path else f"file://{path}")


def deduplicated(pages: DataFrame, least: int = 0) -> DataFrame:
    """pages with refers_to: the smallest page_id with the same payload of at least `least` bytes, null on its own record.

    Only digests are grouped; pages meet their answer by page_id, so a payload that a third of all pages share is not one group.
    """
    html = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keys = pages.where(F.col("page_id").isNotNull() & (F.length(html) >= least)).select("page_id", F.sha1(html).alias("digest"))
    owners = keys.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = keys.join(owners, "digest").where("page_id <> refers_to").select("page_id", "refers_to", "digest").distinct()
    rows = pages.select("page_id", "url", "html", F.sha1(html).alias("digest"))
    return rows.join(revisits, ["page_id", "digest"], "left").drop("digest")


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes an archive per task under folder; the manifest (path, records)."""
    short_batches(pages.sparkSession)
    schema = "path string, records long"
    out = arrow_schema(pages.sparkSession, schema)
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        fs, base = open_fs(folder)
        fs.create_dir(base, recursive=True)
        name, n, stream = f"{base}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if stream is None:
                    stream = fs.open_output_stream(name, compression=None)
                    stream.write(info(date))
                stream.write(record(row[0], row[1], (row[2] or "").encode(), row[3], date))
                n += 1
        if stream:
            stream.close()
            yield pa.record_batch([[name], [n]], schema=out)

    return pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, schema)


RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(manifest: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """Records of the archives of a manifest, in archive order; with payloads also url and html."""
    schema = RECORDS + (", url string, html string" if payloads else "")
    out = arrow_schema(manifest.sparkSession, schema)

    def run(batches):
        fs, _ = open_fs(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(path, compression=None) as stream:
                    for page, url, size, sha, kind, refers, payload in read_archive(stream):
                        rows.append((page, size, sha, kind, refers) + ((url, payload.decode()) if payloads else ()))
                        if len(rows) == 512:
                            yield _batch(rows, out)
                            rows = []
                yield _batch(rows, out)

    return manifest.select("path").mapInArrow(run, schema)


def _batch(rows: list[tuple], out: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [()] * len(out)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Archives the pages and reads them back: one row per page.

    Null html counts as empty. Rows with a null page_id are responses and own nothing; of repeated rows with one page_id and
    one payload all are as that page is (response if it is the smallest). An empty table gives an empty result; columns other than
    page_id, url and html are not read.
    """
    folder = work_dir(pages.sparkSession, "warc")
    manifest = stored(write_archives(deduplicated(pages, least), folder), "warc-manifest")
    n = max(1, manifest.count())
    return read_archives(manifest.repartition(n, "path"), folder)
