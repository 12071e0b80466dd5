"""Benchmark decontamination with a distributed positional inverted index.

build_index() stores the postings of every word of the training texts. The index is partitioned by document: a row is the
index of a shard, a run of neighbouring documents: its sorted distinct terms, how often each occurs, and all positions by term.
Positions run through the shard with a gap after each document, so no phrase reaches into the next one.

search() takes the test phrases in slices of bounded size. In each shard a phrase starts from the postings of its rarest term
there, shifted by the term's offset; the lists of the other terms, rarer ones first, are intersected with these starts. A
phrase with a term that the shard lacks costs one look-up. What is left are exact occurrences. A proximity search
(slop) goes the same way with a tolerance around each offset.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textblock as tb
from .common import arrow_schema, short_batches, stored

WIDTH = 10
#: Free positions after each document: more than any phrase or tolerance spans.
GAP = 64
#: Phrases that are searched, and sent to the executors, at once.
SLICE_PHRASES = 50_000

INDEX = "shard long, docs binary, known binary, sizes binary, terms binary, counts binary, positions binary"


def build_index(docs: DataFrame) -> DataFrame:
    """A row for each shard: doc ids (64-bit), whether each is known (a byte), word counts (64-bit), distinct terms (sorted 64-bit hashes), their
    counts and, by term, the positions (32-bit). Documents are the rows of docs (doc_id, text); null text has no words, a null doc_id is unknown: the 64-bit hash
    of its text stands there."""
    short_batches(docs.sparkSession)
    out = arrow_schema(docs.sparkSession, INDEX)

    def run(batches):
        shard = TaskContext.get().partitionId() << 32
        for batch in batches:
            known = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            ids = batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64)
            for first, data, offsets in tb.blocks(batch.column(1)):
                words = tb.words(data, offsets, tb.NOT_ALNUM)
                n = len(offsets) - 1
                sizes = np.diff(words.first)
                base = np.concatenate([[0], np.cumsum(sizes + GAP)])[:-1] - words.first[:-1]
                positions = np.arange(len(words.hash)) + np.repeat(base, sizes)
                order = np.argsort(words.hash, kind="stable")
                terms, counts = np.unique(words.hash[order], return_counts=True)
                rows = [ids[first : first + n], known[first : first + n], sizes.astype(np.int64), terms, counts.astype(np.uint32), positions[order].astype(np.uint32)]
                yield pa.record_batch([pa.array([shard], pa.int64()), *(pa.array([x.tobytes()], pa.binary()) for x in rows)], schema=out)
                shard += 1

    return docs.select("doc_id", "text", key_of()).mapInArrow(run, INDEX)


def key_of() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))


class Shard:
    def __init__(self, row: dict) -> None:
        self.docs = np.frombuffer(row["docs"], np.int64)
        self.unknown = ~np.frombuffer(row["known"], bool)
        self.sizes = np.frombuffer(row["sizes"], np.int64)
        self.terms = np.frombuffer(row["terms"], np.uint64)
        self.counts = np.frombuffer(row["counts"], np.uint32).astype(np.int64)
        self.positions = np.frombuffer(row["positions"], np.uint32)
        self.first = np.concatenate([[0], np.cumsum(self.counts)])
        self.base = np.concatenate([[0], np.cumsum(self.sizes + GAP)])[:-1]

    def postings(self, term: int) -> np.ndarray:
        return self.positions[self.first[term] : self.first[term + 1]].astype(np.int64)

    def lookup(self, words: np.ndarray) -> np.ndarray:
        """Numbers of the terms, -1 for those that the shard lacks."""
        if not len(self.terms):
            return np.full(words.shape, -1)
        at = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        return np.where(self.terms[at] == words, at, -1)

    def document(self, starts: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.base, starts, "right") - 1

    def occurrences(self, phrases: list[np.ndarray], slop: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(phrase number, first position, last position) of every match."""
        numbers, begins, ends = [], [], []
        sizes = np.array([len(p) for p in phrases])
        if not len(phrases):
            none = np.zeros(0, np.int64)
            return none, none, none
        edge = np.concatenate([[0], np.cumsum(sizes)])
        terms = self.lookup(np.concatenate(phrases))
        whole = np.minimum.reduceat(terms, edge[:-1]) >= 0
        for k in np.flatnonzero(whole).tolist():
            own = terms[edge[k] : edge[k + 1]]
            order = np.argsort(self.counts[own], kind="stable")
            start = self.postings(own[order[0]]) - order[0]
            low, high = start + order[0], start + order[0]
            for i in order[1:].tolist():
                if not len(start):
                    break
                places = self.postings(own[i])
                at = np.searchsorted(places, start + i - slop)
                hit = at < len(places)
                found = places[np.minimum(at, len(places) - 1)]
                hit &= found <= start + i + slop
                start, low, high = start[hit], np.minimum(low, found)[hit], np.maximum(high, found)[hit]
            if len(start):
                numbers.append(np.full(len(start), k))
                begins.append(low)
                ends.append(high)
        if not numbers:
            none = np.zeros(0, np.int64)
            return none, none, none
        return np.concatenate(numbers), np.concatenate(begins), np.concatenate(ends)


def windows(words: np.ndarray, width: int = WIDTH) -> list[np.ndarray]:
    """Runs of width words; a shorter text, if it has words, is one window."""
    if len(words) < width:
        return [words] if len(words) else []
    return [words[i : i + width] for i in range(len(words) - width + 1)]


PHRASES = "item_id long, words array<binary>"


def phrases_of(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """item_id and the distinct windows of each item (item_id, text); items without id or words have none."""
    short_batches(items.sparkSession)
    out = arrow_schema(items.sparkSession, PHRASES)

    def run(batches):
        for batch in batches:
            ids, lists = [], []
            for item, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = np.frombuffer((text or "").encode(), np.uint8)
                hashed = tb.words(raw, np.array([0, len(raw)]), tb.NOT_ALNUM).hash
                found = list({w.tobytes() for w in windows(hashed, width)})
                if found:
                    ids.append(item)
                    lists.append(found)
            yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.binary()))], schema=out)

    return items.where("item_id is not null").select("item_id", "text").mapInArrow(run, PHRASES)


MATCHES = "shard long, row int, doc_id long, n_words long, covered binary, n_hit long, items array<long>, key long"


def search(index: DataFrame, phrases: dict[bytes, list[int]], slop: int = 0) -> DataFrame:
    """Each document of the index with the word ranges that matches cover (pairs of 32-bit numbers, end exclusive, merged) and the items
    whose phrases occur.

    phrases: a window (its word hashes as bytes) and the items that have it. With slop, each term may be so many places off
    its offset from the phrase's rarest term.
    """
    if slop * 2 + WIDTH >= GAP:
        raise ValueError(f"slop of {slop} reaches into the next document")
    out = arrow_schema(index.sparkSession, MATCHES)
    keys = list(phrases)
    sent = index.sparkSession.sparkContext.broadcast((keys, [phrases[k] for k in keys]))  # of at most SLICE_PHRASES

    def run(batches):
        texts, owners = sent.value
        wanted = [np.frombuffer(k, np.uint64) for k in texts]
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row)
                number, low, high = shard.occurrences(wanted, slop)
                n = len(shard.docs)
                ranges, items = [b""] * n, [set() for _ in range(n)]
                documents = shard.document(low)
                for d in np.unique(documents).tolist():
                    own = documents == d
                    ranges[d] = merged(low[own] - shard.base[d], high[own] + 1 - shard.base[d])
                    for k in np.unique(number[own]).tolist():
                        items[d].update(owners[k])
                ids = pa.array(shard.docs, pa.int64(), mask=shard.unknown)
                columns = ([row["shard"]] * n, list(range(n)), ids, shard.sizes, ranges, list(map(length, ranges)), [sorted(x) for x in items], shard.docs)
                yield pa.record_batch([x if isinstance(x, pa.Array) else pa.array(x, f.type) for x, f in zip(columns, out)], schema=out)

    return index.mapInArrow(run, MATCHES)


def merged(low: np.ndarray, high: np.ndarray) -> bytes:
    """Sorted disjoint ranges that cover the same numbers."""
    order = np.argsort(low, kind="stable")
    low, reach = low[order], np.maximum.accumulate(high[order])
    new = np.concatenate([[True], low[1:] > reach[:-1]])
    begin = np.flatnonzero(new)
    end = reach[np.concatenate([begin[1:], [len(low)]]) - 1]
    return np.column_stack([low[begin], end]).astype("<u4").tobytes()


def length(ranges: bytes) -> int:
    pairs = np.frombuffer(ranges, "<u4").astype(np.int64)
    return int(pairs[1::2].sum() - pairs[::2].sum())


def united(found: list[DataFrame]) -> DataFrame:
    """The results of several searches of one index as those of one."""
    rows = found[0]
    for more in found[1:]:
        rows = rows.unionAll(more)
    out = arrow_schema(rows.sparkSession, MATCHES)
    rows = rows.groupBy("shard", "row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.collect_list("covered").alias("covered"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.first("key").alias("key"))

    def run(batches):
        for batch in batches:
            ranges = []
            for lists in batch.column(4).to_pylist():
                pairs = np.frombuffer(b"".join(lists), "<u4").reshape(-1, 2).astype(np.int64)
                ranges.append(merged(pairs[:, 0], pairs[:, 1]) if len(pairs) else b"")
            yield pa.record_batch([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(ranges, pa.binary()), pa.array(list(map(length, ranges)), pa.int64()), batch.column(5).cast(out.field(6).type), batch.column(6)], schema=out)

    return rows.mapInArrow(run, MATCHES)


def phrase_slices(items: DataFrame, width: int = WIDTH, most: int = SLICE_PHRASES):
    """Dicts of at most about `most` windows; a window and all its items are in the same slice only if they come together, so results
    of slices are united."""
    part: dict[bytes, list[int]] = {}
    for row in phrases_of(items, width).toLocalIterator():
        for w in row.words:
            part.setdefault(bytes(w), []).append(row.item_id)
            if len(part) >= most:
                yield part
                part = {}
    yield part


RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def decontaminate(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs (doc_id, text), against items (item_id, text).

    Null and empty texts have no words and no hits; items without words match nothing. Rows without doc_id are searched like others, repeated
    rows give repeated rows, and items with one id count once. Empty tables give an empty result or no hits; other columns are
    not read.
    """
    return digests(matches(docs, items, width))


def matches(docs: DataFrame, items: DataFrame, width: int = WIDTH, slop: int = 0) -> DataFrame:
    """search() of all items' windows in a stored index of docs."""
    index = stored(build_index(docs), "positional-index")
    found = [search(index, part, slop) for part in phrase_slices(items, width)]
    return found[0] if len(found) == 1 else united(found)


def digests(found: DataFrame) -> DataFrame:
    names = F.sort_array(F.transform("items", lambda x: x.cast("string")))
    out = found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"))
    return out.withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, items: DataFrame, width: int = WIDTH) -> DataFrame:
    """The rows of docs in which no window of an item occurs, and no window in a row of the same doc_id. A row without doc_id goes by the 64-bit hash of its text."""
    known, key = "decontamination: known", "decontamination: key"
    hit = matches(docs, items, width).where("n_hit > 0").select(F.col("doc_id").isNotNull().alias(known), F.col("key").alias(key)).distinct()
    keyed = docs.withColumns({known: F.col("doc_id").isNotNull(), key: key_of()})
    return keyed.join(hit, [known, key], "left_anti").select(*docs.columns)
