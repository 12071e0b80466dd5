"""Line deduplication by range-partitioned hashes with a secondary sort.

One row per document and distinct line key, (128-bit hash, doc_id, text hash), is range-partitioned and sorted by hash, then
document. The ranges cut through a hash that many documents hold, so no key makes a large partition. Each partition streams
its rows: the first row of a hash is its first occurrence, the others are copies. Only at a partition's start may a hash have
begun earlier; the last hash of every partition, two numbers each, tells. What comes back per document is a compressed bitmap
of the lines to keep, never text.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, short_batches, stored

SPACE = b" \t\n\v\f\r"
MIN_LENGTH = 10


def line_keys(text: bytes, least: int = MIN_LENGTH) -> list[tuple[int, bytes]]:
    """(line number, key) of the lines whose keys have at least `least` code points."""
    out = []
    for i, line in enumerate(text.split(b"\n")):
        key = line.strip(SPACE)
        if len(key) >= 4 * least or (len(key) >= least and len(key.decode()) >= least):
            out.append((i, key.lower()))  # bytes.lower() folds A-Z only
    return out


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


POSTINGS = "h1 long, h2 long, doc_id long, body long, lines binary"


def postings(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """A row per document and distinct key: hash, document and the numbers of the key's lines (as unsigned 32-bit integers)."""
    short_batches(docs.sparkSession)
    out = arrow_schema(docs.sparkSession, POSTINGS)

    def run(batches):
        for batch in batches:
            h1, h2, ids, bodies, lines = [], [], [], [], []
            for doc, text, body in zip(*(c.to_pylist() for c in batch.columns)):
                keys: dict[int, list[int]] = {}
                for i, key in line_keys(text.encode(), least):
                    keys.setdefault(xxhash.xxh3_128_intdigest(key), []).append(i)
                if keys:
                    h1 += [_signed(h >> 64) for h in keys]
                    h2 += [_signed(h & (1 << 64) - 1) for h in keys]
                    ids += [doc] * len(keys)
                    bodies += [body] * len(keys)
                    lines += [np.array(x, "<u4").tobytes() for x in keys.values()]
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip((h1, h2, ids, bodies, lines), out)], schema=out)

    rows = docs.where("doc_id is not null and text is not null").select("doc_id", "text", F.xxhash64("text").alias("body"))
    return rows.mapInArrow(run, POSTINGS)


COPIES = "part int, h1 long, h2 long, owner long, doc_id long, body long, lines binary, head boolean, last boolean"


def copies(sorted_rows: DataFrame) -> DataFrame:
    """Streams sorted postings: rows that another document's row of the same hash precedes in the partition.

    Besides, with head set, the rows of the hash that a partition begins with, and, with last set, one row for the hash that
    it ends with, whose owner is the first document of that hash there.
    """
    short_batches(sorted_rows.sparkSession)
    out = arrow_schema(sorted_rows.sparkSession, COPIES)

    def run(batches):
        part, first, previous, owner = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, doc = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            n = len(h1)
            if first is None:
                first = (h1[0], h2[0])
            new = np.ones(n, bool)
            new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
            if previous == (h1[0], h2[0]):
                new[0] = False
            at = np.maximum.accumulate(np.where(new, np.arange(n), -1))
            owners = np.where(at >= 0, doc[np.maximum(at, 0)], owner if owner is not None else 0)
            head = (h1 == first[0]) & (h2 == first[1])
            kept = np.flatnonzero((owners != doc) | head)
            previous, owner = (h1[-1], h2[-1]), owners[-1]
            rows = batch.take(pa.array(kept))
            yield pa.record_batch(
                [pa.array(np.full(len(kept), part, np.int32)), rows.column(0), rows.column(1), pa.array(owners[kept], pa.int64()), rows.column(2), rows.column(3), rows.column(4), pa.array(head[kept]), pa.array(np.zeros(len(kept), bool))],
                schema=out,
            )
        if previous is not None:
            yield pa.record_batch([pa.array([x], f.type) for x, f in zip((part, previous[0], previous[1], owner, None, None, None, False, True), out)], schema=out)

    return sorted_rows.mapInArrow(run, COPIES)


BITMAPS = "doc_id long, body long, keep binary, n_dropped long"


def keep_bitmaps(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """(doc_id, body, keep, n_dropped) of the documents that lose lines; body is the text's hash, keep a zlib-compressed bitmap
    with a bit for each line up to the last dropped one, set where the line stays; whole bytes, filled up with ones."""
    spark = docs.sparkSession
    rows = stored(postings(docs, least), "line-postings")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = stored(copies(rows.repartitionByRange(parts, "h1", "h2", "doc_id", "body").sortWithinPartitions("h1", "h2", "doc_id", "body")), "line-copies")

    # A few numbers for each partition: whether its first hash began in an earlier one, and with which document.
    carried: dict[int, int] = {}
    before: tuple[int, int, int] | None = None
    for r in found.where("last").select("part", "h1", "h2", "owner").orderBy("part").toLocalIterator():
        if before:
            carried[r.part] = before
        same = before and before[:2] == (r.h1, r.h2)
        before = before if same else (r.h1, r.h2, r.owner)
    begun = spark.createDataFrame([(p, *x) for p, x in carried.items()], "part int, b1 long, b2 long, first_owner long")
    rows = found.where("not last")
    dropped = (
        rows.join(F.broadcast(begun), "part", "left")  # one row a partition
        .withColumn("owner", F.when(F.col("head") & (F.col("b1") == F.col("h1")) & (F.col("b2") == F.col("h2")), F.col("first_owner")).otherwise(F.col("owner")))
        .where("owner <> doc_id")
        .select("doc_id", "body", "lines")
    )
    out = arrow_schema(spark, BITMAPS)

    def run(batches):
        ids, bodies, lines, counts = [], [], [], []
        for batch in batches:
            for doc, body, parts_ in zip(*(c.to_pylist() for c in batch.columns)):
                gone = np.unique(np.frombuffer(b"".join(parts_), "<u4"))  # repeated rows hold the same lines
                keep = np.ones((int(gone[-1]) // 8 + 1) * 8, bool)
                keep[gone] = False
                ids.append(doc)
                bodies.append(body)
                lines.append(zlib.compress(np.packbits(keep).tobytes(), 1))
                counts.append(len(gone))
            yield pa.record_batch([pa.array(x, f.type) for x, f in zip((ids, bodies, lines, counts), out)], schema=out)
            ids, bodies, lines, counts = [], [], [], []

    # a document's dropped lines are no more than its text
    return dropped.groupBy("doc_id", "body").agg(F.collect_list("lines").alias("lines")).mapInArrow(run, BITMAPS)


def kept_lines(text: str, keep: bytes | None) -> tuple[int, int, str]:
    """Lines, dropped lines and the text that stays."""
    lines = text.split("\n")
    if keep is None:
        return len(lines), 0, text
    bits = np.unpackbits(np.frombuffer(zlib.decompress(keep), np.uint8)).astype(bool)[: len(lines)]
    stay = [x for x, k in zip(lines, bits) if k] + lines[len(bits) :]
    return len(lines), len(lines) - len(stay), "\n".join(stay)


def with_bitmaps(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """docs with _keep (null: all lines stay), matched by doc_id and text."""
    marks = keep_bitmaps(docs, least).select(F.col("doc_id").alias("_doc"), F.col("body").alias("_body"), F.col("keep").alias("_keep"))
    return docs.join(marks, (docs["doc_id"] == marks["_doc"]) & (F.xxhash64(docs["text"]) == marks["_body"]), "left").drop("_doc", "_body")


SCHEMA = "doc_id long, n_lines long, n_dropped long, kept_sha256 string"


def dedup_lines(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256 for each row of docs (doc_id, text).

    A key of at least `least` code points that at least two documents hold stays only in the smallest of their doc_ids.
    Null and empty texts are one empty line. A null doc_id owns nothing and loses nothing; repeated rows of one doc_id and
    text keep and lose the same lines; rows of one doc_id with different texts count as one document. An empty table gives an
    empty result; other columns are not read.
    """
    marked = with_bitmaps(docs.select("doc_id", "text"), least).select("doc_id", "text", "_keep")
    out = arrow_schema(docs.sparkSession, SCHEMA)

    def run(batches):
        for batch in batches:
            columns: list[list] = [[], [], []]
            for text, keep in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                n, gone, kept = kept_lines(text or "", keep)
                for c, x in zip(columns, (n, gone, hashlib.sha256(kept.encode()).hexdigest())):
                    c.append(x)
            yield pa.record_batch([batch.column(0).cast(pa.int64()), *(pa.array(c, f.type) for c, f in zip(columns, list(out)[1:]))], schema=out)

    return marked.mapInArrow(run, SCHEMA)


def without_repeated_lines(docs: DataFrame, least: int = MIN_LENGTH) -> DataFrame:
    """docs with the repeated lines taken out of text (null stays null), and n_chars, if there is one, to match."""
    marked = with_bitmaps(docs, least)
    columns = [c for c in docs.columns if c != "n_chars"]
    schema = docs.select(*columns).schema

    def run(batches):
        for batch in batches:
            keeps = batch.column("_keep").to_pylist()
            texts = [x if k is None else kept_lines(x, k)[2] for x, k in zip(batch.column("text").to_pylist(), keeps)]
            yield pa.record_batch([pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in columns], names=columns)

    short_batches(docs.sparkSession)
    out = marked.select(*columns, "_keep").mapInArrow(run, schema)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out
