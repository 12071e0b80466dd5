"""Source divergence audit: how far the term shares of a language's sources lie from each other and from the language.

1. A count-min sketch of document frequencies: each task counts its documents' terms, adds them to `depth` rows of 2^width
   counters that stop at the least frequency asked for, and gives its counters packed in slices; slices are merged each on its
   own. A counter is never below a term's true frequency, so a term with a counter short of the threshold can't be kept and
   isn't shuffled. What tasks get of the merged sketch is one bit a counter: depth * 2^width bits, whatever the input.
2. The terms left over are counted exactly by language, source and term, and those below the threshold are dropped.
3. Pairs: most terms are missing from most sources, where a share is the source's base value. So the sum over all kept terms
   of f(p, q) is the sum over the terms of the one with the other's base value, the same the other way round, a correction
   for the terms that both hold (a join on the term), and the base values' f times the rest.

Shares are whole billionths; all sums are exact integers (the squares of the shares of one group sum to at most (10^9 + V)^2).

Stated results for odd rows: null text, lang and source are ''. Repeated rows count each. A source without kept terms has base
shares only. A language without kept terms has pairs of value 0. An empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from .common import arrow_schema, forget, plain_text, short_batches, stored
from .textblock import blocks, byte_set, mix, words

LEAST, SCALE, TOP = 3, 10**9, 200
DEPTH, WIDTH = 4, 21
#: Counters of a slice of the sketch, as a power of two; distinct terms that a task holds before it passes them on.
SLICE, HELD = 16, 200_000
#: Bytes of a text that are split into terms at once; parts that a group with very many terms is dealt into.
PIECE, PARTS = 1 << 18, 64

#: ASCII but letters.
_OTHERS = byte_set((0, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
#: Letters of ASCII in lower case, other ASCII as a blank, bytes of other characters as they are.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms_of(text: bytes, size: int = PIECE):
    """Lists of the terms of a text, in pieces that end where a term does."""
    begin, folded = 0, text.translate(_FOLD)
    while begin < len(folded):
        end = begin + size
        if end < len(folded):
            end = folded.find(b" ", end)
            end = len(folded) if end < 0 else end
        yield folded[begin:end].split()
        begin = end


#: Bits of a term's hash that the sketch goes by, and rows of a block that they leave room for; terms that share them count as one.
KEY = 42


def keys(language: np.ndarray | int, hashes: np.ndarray) -> np.ndarray:
    """What the sketch knows of terms: KEY bits of their and their language's hash."""
    return mix(hashes ^ np.asarray(language, np.uint64)) >> np.uint64(64 - KEY)


def language_hash(language: str) -> int:
    return xxhash.xxh64_intdigest(language)


def term_hashes(terms: list[bytes]) -> np.ndarray:
    joined = np.frombuffer(b" ".join(terms), np.uint8)
    return words(joined, np.array([0, len(joined)]), _OTHERS).hash


def places(key: np.ndarray, row: int, width: int) -> np.ndarray:
    """Counter numbers of keys in a row of the sketch."""
    return (mix(key + np.uint64((row + 1) << KEY)) >> np.uint64(64 - width)).astype(np.int64)


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(plain_text("lang").cast("string").alias("lang"), plain_text("source").cast("string").alias("source"), plain_text("text").cast("string").alias("text"))


def sketch(docs: DataFrame, least: int = LEAST, depth: int = DEPTH, width: int = WIDTH) -> np.ndarray:
    """Packed bits, one a counter: whether at least `least` documents may hold the terms that count there."""
    if not 0 < least < 128:
        raise ValueError("counters hold at most 127")
    spark = docs.sparkSession
    short_batches(spark)
    size = min(1 << SLICE, 1 << width)
    schema = "slice int, counts binary"
    out = arrow_schema(spark, schema)

    def count(batches):
        counters, seen, held = np.zeros((depth, 1 << width), np.uint8), [], 0

        def add():
            key, number = np.unique(np.concatenate(seen), return_counts=True)
            for k, row in enumerate(counters):
                # counters stop at `least`, which the sums of several stopped ones can't miss
                row[:] = np.minimum(row + np.bincount(places(key, k, width), np.minimum(number, least), 1 << width), least)
            seen.clear()

        for batch in batches:
            language = np.array([language_hash(x) for x in batch.column(0).to_pylist()], np.uint64)
            for first, data, offsets in blocks(batch.column(1)):
                found = words(data, offsets, _OTHERS)
                row = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint64), np.diff(found.first))
                # each document counts once: rows of a block are fewer than 2^(64 - KEY)
                one = np.unique(row << np.uint64(KEY) | keys(language[first:][row.astype(np.int64)], found.hash))
                seen.append(one & np.uint64((1 << KEY) - 1))
                held += len(one)
                if held > 4 * HELD:
                    add()
                    held = 0
        if seen:
            add()
        flat = counters.reshape(-1)
        for k in range(len(flat) // size):
            part = flat[k * size : (k + 1) * size]
            if part.any():
                yield pa.record_batch([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], schema=out)

    def merging(finish):
        def merge(batches):
            held, total = None, None
            row = lambda: pa.record_batch([pa.array([held], pa.int32()), pa.array([finish(total)], pa.binary())], schema=out)
            for batch in batches:
                for k, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if k != held:
                        if held is not None:
                            yield row()
                        held, total = k, np.zeros(size, np.uint8)
                    total = np.minimum(total + np.frombuffer(counts, np.uint8), least).astype(np.uint8)
            if held is not None:
                yield row()

        return merge

    parts = _columns(docs).select("lang", "text").mapInArrow(count, schema)
    # the tasks' copies of a slice are merged in PARTS portions, then those
    parts = parts.withColumn("part", F.spark_partition_id() % PARTS).repartition("slice", "part").sortWithinPartitions("slice").select("slice", "counts").mapInArrow(merging(np.ndarray.tobytes), schema)
    merged = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(merging(lambda total: np.packbits(total >= least).tobytes()), schema)
    bits = np.zeros((depth << width) // 8, np.uint8)
    for row in merged.collect():  # as many rows as the sketch has slices, of fixed size
        bits[row["slice"] * size // 8 :][: size // 8] = np.frombuffer(row["counts"], np.uint8)
    return bits.reshape(depth, -1)


def counted(docs: DataFrame, bits: np.ndarray | None, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """(lang, source, term, n, df) of the terms that the sketch doesn't rule out: occurrences and documents in each source, exactly."""
    spark = docs.sparkSession
    short_batches(spark)
    schema = "lang string, source string, term string, n long, df long"
    out = arrow_schema(spark, schema)
    shared = spark.sparkContext.broadcast(bits)

    def run(batches):
        groups: dict[tuple, tuple[Counter, Counter]] = {}

        def passed():
            bits = shared.value
            for (language, source), (n, df) in groups.items():
                terms = list(n)
                if bits is not None and terms:
                    key = keys(language_hash(language), term_hashes(terms))
                    fine = np.ones(len(terms), bool)
                    for k, row in enumerate(bits):
                        at = places(key, k, width)
                        fine &= (row[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool)
                    terms = [t for t, ok in zip(terms, fine.tolist()) if ok]
                for k in range(0, len(terms), 1 << 15):
                    some = terms[k : k + (1 << 15)]
                    m = len(some)
                    yield pa.record_batch([pa.array([language] * m, pa.string()), pa.array([source] * m, pa.string()), pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()), pa.array([df[t] for t in some], pa.int64())], schema=out)
            groups.clear()

        for batch in batches:
            for language, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary())):
                n, df = groups.setdefault((language, source), (Counter(), Counter()))
                distinct = set()
                for terms in terms_of(text.as_py()):
                    n.update(terms)
                    distinct.update(terms)
                df.update(distinct)
            if sum(len(n) for n, _ in groups.values()) > HELD:
                yield from passed()
        yield from passed()

    return _columns(docs).mapInArrow(run, schema).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def share(count, total, size):
    """1 + floor(SCALE * (count + 1) / (total + size)), exact for any long."""
    wide = lambda c: c.cast("decimal(20,0)")
    return (F.lit(1) + F.call_function("div", wide(count + 1) * F.lit(SCALE).cast("decimal(10,0)"), wide(total + size))).cast("long")


def gap(p, q):
    """floor((p - q)^2 / q)"""
    return F.call_function("div", (p - q) * (p - q), q)


def divergence(docs: DataFrame, least: int = LEAST, top: int = TOP, depth: int = DEPTH, width: int = WIDTH) -> DataFrame:
    """lang, source, part ('pair': item is another source; 'term': item is a kept term), item, value, rank."""
    groups = _columns(docs).select("lang", "source").distinct()
    exact = counted(docs, sketch(docs, least, depth, width), depth, width)
    # a term's rows are one a source; their sums are the language's
    term = W.partitionBy("lang", "term")
    exact = exact.select("lang", "source", "term", "n", F.sum("n").over(term).alias("in_lang"), F.sum("df").over(term).alias("df"), (F.row_number().over(term.orderBy("source")) == 1).alias("first"))
    kept = stored(exact.where(F.col("df") >= least).drop("df"), "divergence-kept")
    sizes = kept.groupBy("lang").agg(F.count(F.when(F.col("first"), 1)).alias("v"), F.sum("n").alias("lang_total"))
    mine = kept.groupBy("lang", "source").agg(F.count("*").alias("held"), F.sum("n").alias("total"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    groups = groups.join(mine, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", *(zero(c) for c in ("held", "total", "v", "lang_total")))
    groups = groups.withColumn("base", F.when(F.col("v") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("v"))).otherwise(1))
    groups = stored(groups, "divergence-groups")
    # a source may hold most of a language's terms: its terms are dealt out with copies of its totals
    part = F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int")
    dealt = groups.select("lang", "source", "total", "v", "lang_total", "base", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))).alias("part"))
    terms = kept.withColumn("part", part).join(dealt, ["lang", "source", "part"])
    terms = terms.select("lang", "source", "part", "term", share(F.col("n"), F.col("total"), F.col("v")).alias("p"), share(F.col("in_lang"), F.col("lang_total"), F.col("v")).alias("q"), "base")
    terms = stored(terms, "divergence-shares")
    forget(kept)
    pairs = _pairs(terms, groups)
    order = [F.col("value").desc(), F.col("item")]
    pairs = pairs.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(*order)))
    found = terms.where("p > q").select("lang", "source", "part", F.col("term").alias("item"), gap(F.col("p"), F.col("q")).alias("value"))
    # the first of each part of a group, then the first of those: at most PARTS * top rows of a group meet
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source", "part").orderBy(*order))).where(F.col("rank") <= top)
    found = found.withColumn("rank", F.row_number().over(W.partitionBy("lang", "source").orderBy(*order))).where(F.col("rank") <= top)
    row = lambda df, what: df.select("lang", "source", F.lit(what).alias("part"), "item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return row(pairs, "pair").unionAll(row(found, "term"))


def _beside(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows of left with the other sources of their language: left is dealt out in PARTS, right (a row a source) copied to each."""
    left = left.withColumn("part", F.pmod(F.xxhash64(*left.columns), F.lit(PARTS)).cast("int"))
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return left.join(right, ["lang", "part"]).where("source <> item").drop("part")


def _pairs(terms: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of a language's sources."""
    f = lambda x, y: gap(F.col(x), F.col(y))
    total = lambda df, x: df.groupBy("lang", "source", "item").agg(F.sum(x).alias("x"))
    one = groups.select("lang", "source", F.col("base").alias("p0"), F.col("held").alias("m"), "v")
    other = groups.select("lang", F.col("source").alias("item"), F.col("base").alias("q0"), F.col("held").alias("m2"))
    rest = _beside(one, other).select("lang", "source", "item", F.when(F.col("v") > 0, (F.col("v") - F.col("m") - F.col("m2")) * f("p0", "q0")).otherwise(0).alias("x"))
    # equal shares are folded: a source has far fewer of them than terms
    folded = terms.groupBy("lang", "source", "p").agg(F.count("*").alias("k"))
    ours = total(_beside(folded, other), F.col("k") * f("p", "q0"))
    theirs = _beside(folded.select("lang", F.col("source").alias("item"), F.col("p").alias("q"), "k"), one)
    a = terms.select("lang", "part", "term", "source", "p", F.col("base").alias("p0"))
    b = terms.select("lang", "part", "term", F.col("source").alias("item"), F.col("p").alias("q"), F.col("base").alias("q0"))
    both = total(a.join(b, ["lang", "part", "term"]).where("source <> item"), f("p", "q") - f("p", "q0") - f("p0", "q") + f("p0", "q0"))
    every = rest.unionAll(ours).unionAll(total(theirs, F.col("k") * f("p0", "q"))).unionAll(both)
    return every.groupBy("lang", "source", "item").agg(F.sum("x").alias("value"))
