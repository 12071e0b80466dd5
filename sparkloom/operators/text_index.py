"""A stored text index: positional postings dealt by term, and cover density over them.

A row is (bucket, term, scope, postings: chunk_id and positions of some chunks that hold the term). The table is partitioned by a hash of the term; each task writes
its chunks into a file of each bucket, sorted by term, so a search reads the row groups of the terms that are asked for, and postings aren't shuffled to be stored.
Chunks are indexed once, under a generation of their own if need be.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StringType, StructType

from ..functions.stems import hits, lexemes
from ..sources.shared import dealt, stored
from .retrieval import POOL, ranked

#: Partitions of the table; parts that the postings of one term are dealt into when they are joined; weight of a match in a text without weights.
BUCKETS, PARTS, WEIGHT = 32, 32, 0.1
#: Texts that a Python worker turns into lexemes at once, and bytes of texts that it turns into postings at once (a longer text is alone).
ROWS, BYTES = 64, 1 << 22
#: Texts of a task that writes postings; terms of questions that every task may hold.
TEXTS, ASKED = 20_000, 1 << 16


def _lexemes(df: DataFrame, keys: list[str], text: str, stemmed: bool) -> DataFrame:
    """keys, term, positions: a row for each lexeme of each row's text."""
    schema = StructType([df.schema[k] for k in keys]).add("term", StringType()).add("positions", ArrayType(IntegerType(), False))
    out = to_arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):  # a text has many lexemes: few texts at a time
                batch = whole.slice(k, ROWS)
                found = [lexemes(t.as_py(), stemmed) for t in batch.column(len(keys))]
                at = pa.array([i for i, x in enumerate(found) for _ in x], pa.int64())
                columns = [batch.column(i).take(at) for i in range(len(keys))]
                columns += [pa.array([t for x in found for t in x], pa.string()), pa.array([p for x in found for p in x.values()], out.field(len(keys) + 1).type)]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return df.select(*keys, text).mapInArrow(run, schema)


def bucket(term: str = "term") -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def slices(batch: pa.RecordBatch, texts: str, size: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most `size` bytes of texts, and of one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch[texts]), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    k = 0
    while k < batch.num_rows:
        before = ends[k - 1] if k else 0
        n = max(1, int(np.searchsorted(ends, before + size, "right")) - k)
        yield batch.slice(k, n)
        k += n


def _postings(chunks: DataFrame, stemmed: bool) -> DataFrame:
    """scope, term, postings (structs of chunk_id and positions): a row for each term of a scope in each slice of chunks, so a term isn't repeated for each posting."""
    posting = StructType([chunks.schema["chunk_id"]]).add("positions", ArrayType(IntegerType(), False))
    schema = StructType([chunks.schema["scope"]]).add("term", StringType()).add("postings", ArrayType(posting, False))
    out = to_arrow_schema(schema)
    fields = to_arrow_schema(posting)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "content", BYTES):
                terms, term, text, position = hits(batch["content"].to_pylist(), stemmed)
                if not len(term):
                    continue
                scopes = batch["scope"].dictionary_encode("encode")
                group = scopes.indices.to_numpy()[text] * np.int64(len(terms)) + term
                key = group * batch.num_rows + text
                order = np.argsort(key, kind="stable")  # hits of a posting stay in reading order
                key, group = key[order], group[order]
                first = np.flatnonzero(np.diff(key, prepend=-1))  # of each posting
                row = np.flatnonzero(np.diff(group[first], prepend=-1))  # of each row, in postings
                ends = lambda at, n: pa.array(np.append(at, n), pa.int32())
                positions = pa.ListArray.from_arrays(ends(first, len(key)), pa.array(position[order]), fields.field(1).type)
                held = pa.StructArray.from_arrays([batch["chunk_id"].take(pa.array(text[order][first])), positions], fields=list(fields))
                scope, number = np.divmod(group[first][row], len(terms))
                columns = [scopes.dictionary.take(pa.array(scope)), pa.array(terms, pa.string()).take(pa.array(number)), pa.ListArray.from_arrays(ends(row, len(first)), held, out.field(2).type)]
                yield pa.RecordBatch.from_arrays(columns, schema=out)

    return chunks.select("scope", "chunk_id", "content").mapInArrow(run, schema)


def build(chunks: DataFrame, stemmed: bool = True) -> DataFrame:
    """The index of chunks (scope, chunk_id, content), written and read again. Null and empty contents have no posting; repeated rows have theirs."""
    chunks = dealt(chunks.select("scope", "chunk_id", "content"), TEXTS, "chunk_id")
    rows = _postings(chunks, stemmed).withColumn("bucket", bucket()).sortWithinPartitions("bucket", "term")
    return stored(rows.select("term", "scope", "postings", "bucket"), "text-index", "bucket")


def cover_density(held: list[tuple[int, list[int]]], terms: int) -> float:
    """The rank of one chunk: held (number of a term from 0, its positions), terms, how many all have to occur in a cover.

    A cover is a shortest stretch that holds each term; it counts WEIGHT / (1 + words in it that match nothing). One sweep keeps each term's last
    position: a hit ends a cover if each term has been seen and the stretch begins after the last cover did. What matches in a stretch is found by its ends.
    """
    hits = sorted({(at, term) for term, positions in held for at in positions})
    points = [at for at, _ in hits]
    last, begin, rank = [0] * terms, 0, 0.0
    for at, term in hits:
        last[term] = at
        first = min(last)
        if first > begin:
            noise = at - first + 1 - (bisect_right(points, at) - bisect_left(points, first))
            begin, rank = first, rank + WEIGHT / (1 + noise)
    return rank


def _densities(df: DataFrame) -> DataFrame:
    """q_id, chunk_id, density of rows (q_id, chunk_id, terms, held: structs of t and positions)."""
    schema = StructType([df.schema["q_id"], df.schema["chunk_id"]]).add("density", DoubleType())
    out = to_arrow_schema(schema)

    def run(batches):
        for whole in batches:
            for k in range(0, whole.num_rows, ROWS):
                batch = whole.slice(k, ROWS)
                ranks = [cover_density([(h["t"], h["positions"]) for h in held], terms) for terms, held in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ranks, pa.float64())], schema=out)

    return df.select("q_id", "chunk_id", "terms", "held").mapInArrow(run, schema)


def search(questions: DataFrame, index: DataFrame, k: int = POOL, every: bool = False, stemmed: bool = True) -> DataFrame:
    """q_id, chunk_id, lexical_rank, l_rank: the k best chunks of each question (q_id, scope, text; a row for each scope that it may search).

    Any term of a question finds a chunk, and each position that matches counts WEIGHT; with `every`, all terms must occur and covers count. A question
    of stop words finds nothing. index: as build() gives it, with the same `stemmed`.
    """
    asked = _lexemes(questions.select("q_id", "scope", "text").distinct(), ["q_id", "scope"], "text", stemmed).drop("positions")
    if every:
        mine = F.collect_set("term")
        asked = asked.groupBy("q_id", "scope").agg(F.array_sort(mine).alias("ts")).select("q_id", "scope", F.size("ts").alias("terms"), F.posexplode("ts").alias("t", "term"))
    asked = asked.withColumn("bucket", bucket())
    # only postings of terms that are asked for go on
    held = index.join(asked.select("bucket", "term", "scope").distinct(), ["bucket", "term", "scope"], "left_semi").select("bucket", "term", "scope", F.inline("postings"))
    if not every:
        held = held.withColumn("n", F.size("positions")).drop("positions")
    if asked.count() <= ASKED:
        # dealt by chunk, a chunk meets its questions and is scored in one task
        found = held.repartition("chunk_id").join(F.broadcast(asked), ["bucket", "term", "scope"])
    else:
        part = F.pmod(F.xxhash64("chunk_id"), F.lit(PARTS)).cast("int")
        found = held.withColumn("part", part).join(asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), ["bucket", "term", "scope", "part"])
    if every:
        # a chunk goes on only if it holds every term
        of = found.groupBy("q_id", "chunk_id", "terms").agg(F.collect_list(F.struct("t", "positions")).alias("held")).where(F.size(F.array_distinct("held.t")) == F.col("terms"))
        scored = _densities(of).select("q_id", "chunk_id", F.round("density", 6).alias("lexical_rank")).where("lexical_rank > 0")
    else:
        scored = found.groupBy("q_id", "chunk_id").agg(F.round(F.sum("n") * F.lit(WEIGHT), 6).alias("lexical_rank"))
    return ranked(scored, "lexical_rank", "l_rank", k)
