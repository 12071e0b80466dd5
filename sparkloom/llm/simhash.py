"""SimHash near-duplicates: fingerprints of shingles, pigeonhole blocks, Hamming verification, components.

A fingerprint of 64 bits is split into BLOCKS blocks. Two fingerprints that differ in at most DISTANCE bits agree on all blocks
but DISTANCE at most, so they share the bits of one choice of BLOCKS - DISTANCE blocks: each choice is a table, keyed by those
bits, and only fingerprints with an equal key meet. Exact copies are folded first, so a key holds distinct fingerprints.

A key that more than CROWD of them share isn't compared pair by pair: what is left of its bits is split in the same way
again, until the bits left over can't tell more than CROWD fingerprints apart. Work on a crowded key is thus linear in its
fingerprints, whatever their number, and no link is lost: of each key's members every linked pair is found on some level.

Stated results for odd rows: null and empty texts, and texts of separators only, have fingerprint zero; rows without doc_id
link others but name no component (component_id is the smallest doc_id reached, null if there is none); repeated rows stay;
an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, forget, short_batches, stored
from .components import components

WIDTH, SEED, DISTANCE, BLOCKS = 3, 42, 2, 6
#: Fingerprints under one key that are compared with each other; more are split further.
CROWD = 256
#: Bytes of a text that are turned into words at once.
PIECE = 1 << 18
_SPACE = b" \t\n\v\f\r"


def pieces(text: bytes, size: int = PIECE):
    """The text in pieces of about `size` bytes that end where a word does."""
    begin = 0
    while len(text) - begin > size:
        end = begin + size
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        yield text[begin:end]
        begin = end
    yield text[begin:]


def votes(hashes: list[int]) -> np.ndarray:
    """How many of the hashes have each bit, from bit 0."""
    bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint(text: bytes, width: int = WIDTH, seed: int = SEED) -> int:
    """Bit j is 1 if over half of the shingles' hashes have it; zero without words. Repeated shingles count each time."""
    digest, total, n, tail = xxhash.xxh64_intdigest, np.zeros(64, np.int64), 0, []
    for piece in pieces(text):
        words = tail + piece.lower().split()  # of bytes: folds A-Z, splits at ASCII white space
        if len(words) >= width:
            joined = b" ".join(words)
            gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32).tolist()
            starts, ends = [0, *(g + 1 for g in gaps)], [*gaps, len(joined)]
            hashes = [digest(joined[s:e], seed) for s, e in zip(starts, ends[width - 1 :])]
            for k in range(0, len(hashes), 1 << 14):
                total += votes(hashes[k : k + (1 << 14)])
            n += len(hashes)
        tail = words[-(width - 1) :] if width > 1 else []
    if not n and tail:
        total, n = votes([digest(b" ".join(tail), seed)]), 1
    return int(sum(1 << j for j in range(64) if 2 * total[j] > n))


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, width: int = WIDTH, seed: int = SEED) -> DataFrame:
    """(doc_id, f long) of every row; f is the fingerprint as a signed number."""
    short_batches(docs.sparkSession)
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, f long"
    out = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        for batch in batches:
            found = [signed(fingerprint(t.as_py() or b"", width, seed)) for t in batch.column(1).cast(pa.large_binary())]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.int64())], schema=out)

    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(run, schema)


def split(mask: int, parts: int) -> list[int]:
    """The bits of mask in at most `parts` masks of neighbouring bits, as even as can be."""
    bits = [j for j in range(64) if mask >> j & 1]
    ends = [round(k * len(bits) / parts) for k in range(parts + 1)]
    return [m for a, b in zip(ends, ends[1:]) if (m := sum(1 << j for j in bits[a:b]))]


def tables(rest: int, distance: int = DISTANCE, blocks: int = BLOCKS) -> list[tuple[int, int]]:
    """(bits of the key, bits left over) for each choice of `distance` blocks of the bits `rest` that may differ."""
    parts = split(rest, blocks)
    return [(rest & ~sum(chosen), sum(chosen)) for chosen in combinations(parts, min(distance, len(parts)))]


#: Keys that hold more than this share of the rows are few, whatever the size of the data: their rows are met by a broadcast.
HOT_SHARE = 1000


def met(rows: DataFrame, grouped: DataFrame, keys: list[str], total: int) -> DataFrame:
    """rows (`total` of them) joined with grouped (keys and n, their number of rows); keys that hold a large part of all rows don't go to one task."""
    hot = F.broadcast(grouped.where(F.col("n") > max(1, total // HOT_SHARE)))
    return rows.join(hot, keys).unionByName(rows.join(hot, keys, "left_anti").join(grouped, keys))


def links(distinct: DataFrame, distance: int = DISTANCE, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """(a, b) with a < b: fingerprints of `distinct` (f long, distinct) at `distance` or fewer differing bits, as many as link all such pairs.

    A level has a row per fingerprint and table: path (the number of the tables chosen so far), key (the bits that are equal), rest
    (the mask of the bits left over). Keys that hold few members give pairs, the others go on to the next level by their rest.
    """
    every = (1 << 64) - 1
    few = crowd.bit_length() - 1  # bits left over that can't tell more than `crowd` fingerprints apart
    choice = lambda ts: F.array(*(F.struct(F.lit(i).alias("i"), F.lit(signed(left)).alias("rest")) for i, (_, left) in enumerate(ts)))
    level, rests = distinct.select("f", F.lit(0).cast("long").alias("path"), F.explode(choice(tables(every, distance, blocks))).alias("t")), {every}
    found, kept, total = None, [], distinct.count()
    while True:
        rests = {rest: tables(rest, distance, blocks) for rest in rests}
        number = max(map(len, rests.values()))
        level = level.select("f", (F.col("path") * number + F.col("t.i")).alias("path"), F.col("f").bitwiseAND(F.bitwise_not("t.rest")).alias("key"), "t.rest")
        sizes = level.groupBy("path", "key").agg(F.count("*").alias("n")).where("n > 1")
        level = stored(met(level, sizes, ["path", "key"], total * number), "simhash-level")
        kept.append(level)
        last = (F.col("n") <= crowd) | (F.bit_count("rest") <= max(few, distance + 1))
        pairs = level.where(last).select("path", "key", F.col("f").alias("a")).join(level.where(last).select("path", "key", F.col("f").alias("b")), ["path", "key"])
        pairs = pairs.where("a < b").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance).select("a", "b")
        found = pairs if found is None else found.unionAll(pairs)
        level, total = level.where(~last), level.where(~last).count()
        if not total:
            break
        rests = {left: tables(left, distance, blocks) for ts in rests.values() for _, left in ts if left.bit_count() > max(few, distance + 1)}
        choices = F.create_map(*(x for rest, ts in rests.items() for x in (F.lit(signed(rest)), choice(ts))))
        level = level.select("f", "path", F.explode(choices[F.col("rest")]).alias("t"))
    out = stored(found.distinct(), "simhash-links")
    forget(*kept)
    return out


def near_duplicates(docs: DataFrame, width: int = WIDTH, seed: int = SEED, distance: int = DISTANCE, blocks: int = BLOCKS, crowd: int = CROWD) -> DataFrame:
    """One row per row of docs: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id that links reach), n_same (rows with this fingerprint)."""
    rows = stored(fingerprints(docs, width, seed), "simhash-rows")
    distinct = stored(rows.groupBy("f").agg(F.min("doc_id").alias("least"), F.count("*").alias("n_same")), "simhash-distinct")
    edges = links(distinct.select("f"), distance, blocks, crowd)
    members = distinct.join(components(edges).withColumnRenamed("node", "f"), "f", "left").withColumn("component", F.coalesce("component", "f"))
    named = members.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("n"))
    named = stored(met(members, named, ["component"], distinct.count()).select("f", F.col("n_same").alias("n"), "component_id"), "simhash-named")
    forget(edges, distinct)
    out = met(rows, named, ["f"], rows.count())
    return out.select("doc_id", F.lower(F.lpad(F.hex("f"), 16, "0")).alias("fingerprint"), "component_id", F.col("n").alias("n_same"))
