"""N-gram Jaccard join by a blocked sparse matrix product of document by n-gram incidence.

Rows of the matrix are classes of documents with one shingle set (class key: 128-bit digest of the sorted set), columns are
shingles. Blocks. Two sets with a similarity of t or more differ in D = (1 - t) / (1 + t) (|x| + |y|) shingles at most. So with the columns cut
by hash into K > D buckets, some bucket holds the same shingles of both, and a row meets only rows that share a whole bucket with it:
a block of the product is a bucket's content (a signature), and rows with no such partner never enter the product. K goes by
size ranges, of which a partner's may be the next one. As K - D buckets are equal at least, E of them may be left out: a row
with up to E empty buckets leaves those out, a row with more of them has its smallest shingles in one order
for all as blocks of its own, too, as many as every partner must meet.

The product is taken in rounds; each counts the overlaps of chosen rows, column block after column block, and drops a pair as soon as the
columns left can't reach ceil(t / (1 + t) (|x| + |y|)). Before that, pairs are dropped whose sizes are too far apart (t |x| <= |y| <= |x| / t)
or whose sets differ in more than D parities, of which a set has as many as shingles at least.
1. neighbours: in each block, sorted by size, a row meets the one before it and its parent in a tree of FAN_OUT children a node. Of a row's
   pairs the one that comes most often is multiplied. Its links already join large groups of near copies.
2. the rest: in blocks whose rows are of several components so far, pairs of rows across components: first of each component the
   nearest by parities to another one, then of each pair of components the 16 nearest, 256 next, until none is left. A pair within a component adds nothing to it, so
   no link between components is lost, and a group of near copies costs rows and not pairs.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textblock as tb
from .common import arrow_schema, forget, short_batches, stored
from .components import components

#: Children of a row in the first round; rows of a side of a block in the later ones.
FAN_OUT, SIDE_ROWS = 64, 1024
#: Signatures that are packed together; so many classes among them with one signature make it hot; bytes of text whose signatures make a part.
FLUSH_ROWS, HOT_BLOCK, PART_BYTES = 1 << 19, 32, 1 << 23
#: Column blocks of the product; pairs of a row from which on they are dealt to several tasks.
COLUMN_BLOCKS, HOT_ROW = 8, 256
#: Bits of the filter of sets that are sent on: 16 a set, these at most (beyond, more sets are sent than needed).
BLOOM_LEAST, BLOOM_MOST = 20, 30
GROWTH, LEAST_PARITIES = 1.5, 256
_zstd = pa.Codec("zstd", 1)


def _key(shingles: np.ndarray) -> tuple[int, int]:
    k1, k2 = np.frombuffer(hashlib.blake2b(shingles.tobytes(), digest_size=16).digest(), "<i8")
    return int(k1), int(k2)


def sets_of(column: pa.Array, width: int):
    """The sorted shingle set of each text."""
    for _, data, offsets in tb.blocks(column):
        words = tb.words(data, offsets, tb.SPACES)
        for i in range(len(offsets) - 1):
            yield tb.row_shingles(words.hash[words.first[i] : words.first[i + 1]], width)


class Ranges:
    """Ranges of set sizes, each with its number of buckets and of those that may be left out."""

    def __init__(self, num: int, den: int) -> None:
        self.num, self.den, self.begins, self.plans = num, den, [1], []

    def plan(self, g: int) -> tuple[int, int]:
        """(K, E) of range g; K is 0 if only equal sets are similar there, and -1 if only the smallest shingles can be blocks."""
        while len(self.begins) < g + 2:
            self.begins.append(max(self.begins[-1] + 1, math.ceil(self.begins[-1] * GROWTH)))
        while len(self.plans) <= g:
            least, most = self.begins[len(self.plans)], self.begins[len(self.plans) + 1] - 1
            differ = (self.den - self.num) * 2 * most // (self.den + self.num)
            smallest, found = -(-least * self.num // self.den), (-1, 0)
            for k in range(differ + 2, max(differ + 2, 4 * smallest) + 1):
                spare = math.ceil(1.5 * k * math.exp(-smallest / k)) + 1
                if k >= differ + 1 + spare:
                    found = k, spare
                    break
            self.plans.append(found if differ else (0, 0))
        return self.plans[g]

    def of(self, n: int):
        """(range, K, E) of the pairs that a set of n shingles may be in: by the size of the larger one."""
        most, g = n * self.den // self.num, 0
        while True:
            k, spare = self.plan(g)
            if self.begins[g] > most:
                return
            if self.begins[g + 1] > n and k:
                yield g, k, spare
            g += 1


def signatures(s: np.ndarray, ranges: Ranges) -> np.ndarray:
    """The blocks of a sorted set."""
    out, n = [], len(s)
    for g, k, spare in ranges.of(n):
        empty = spare + 1
        if k > 0:
            edges = np.searchsorted(s >> np.uint64(32), (np.arange(k + 1, dtype=np.uint64) << np.uint64(32)) // np.uint64(k))
            edges[-1] = n
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(tb.mix(s + np.uint64(g)))])
            full = np.flatnonzero(edges[1:] > edges[:-1])
            empty = k - len(full)
            out.append(tb.mix((total[edges[1:]] - total[edges[:-1]])[full] + tb.mix(full.astype(np.uint64) + np.uint64(g << 32))))
        if empty > spare:
            # a partner of this kind shares one of the smallest: it lacks n - ceil(t n) of them at most
            out.append(tb.mix(np.sort(tb.mix(s))[: n + (-n * ranges.num // ranges.den) + 1] ^ np.uint64(g + 1 << 48)))
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


MEMBERS = "doc_id long, n int, k1 long, k2 long, parity binary"
PACKED = "part int, blocks binary, " + MEMBERS
#: Stands for classes that hold a signature in other parts.
ELSEWHERE = np.uint32(0xFFFFFFFF)


def pack(sig: np.ndarray, row: np.ndarray, k1: np.ndarray, n: np.ndarray) -> bytes:
    """Signatures in order, each with the place of its class in k1 and n, or ELSEWHERE."""
    step = np.diff(sig, prepend=np.uint64(0))
    planes = np.ascontiguousarray(step.view(np.uint8).reshape(-1, 8).T)  # the upper bytes of small steps are zeros
    head = np.array([len(sig), len(k1)], np.int64)
    raw = b"".join(x.tobytes() for x in (head, planes, np.ascontiguousarray(row.view(np.uint8).reshape(-1, 4).T), k1, n))
    return len(raw).to_bytes(4, "little") + _zstd.compress(raw, asbytes=True)


def unpack(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sig, k1, n) of the rows of pack(); n is -1 where the class is elsewhere."""
    size = int.from_bytes(data[:4], "little")
    raw = _zstd.decompress(data[4:], size, asbytes=True)
    count, classes = np.frombuffer(raw, np.int64, 2)
    at = 16
    sig = np.cumsum(np.frombuffer(raw, np.uint8, 8 * count, at).reshape(8, -1).T.copy().view(np.uint64).ravel(), dtype=np.uint64)
    at += 8 * count
    row = np.frombuffer(raw, np.uint8, 4 * count, at).reshape(4, -1).T.copy().view(np.uint32).ravel()
    at += 4 * count
    k1 = np.append(np.frombuffer(raw, np.int64, classes, at), 0)
    n = np.append(np.frombuffer(raw, np.int32, classes, at + 8 * classes), -1).astype(np.int64)
    place = np.minimum(row, np.uint32(classes)).astype(np.int64)
    return sig, k1[place], n[place]


def parts_of(sig: np.ndarray, row: np.ndarray, k1: np.ndarray, n: np.ndarray, parts: int, salt: int):
    """(part, pack()) of some classes' signatures. A part has a range of signatures; those that many of the classes hold go to another part that
    salt chooses, and their own part is only told of them. A task that runs again must choose as before, so salt is made of its number."""
    order = np.argsort(sig, kind="stable")
    sig, row = sig[order], row[order]
    begin = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    times = np.diff(np.append(begin, len(sig)))
    part = ((sig >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
    hot = np.repeat(times >= HOT_BLOCK, times)
    if hot.any():
        away = (tb.mix(sig[hot] + np.uint64(salt)) % np.uint64(parts)).astype(np.int64)
        told = begin[times >= HOT_BLOCK]
        sig, row, part = np.concatenate([sig[~hot], sig[told], sig[hot], sig[told]]), np.concatenate([row[~hot], np.full(len(told), ELSEWHERE), row[hot], np.full(len(told), ELSEWHERE)]), np.concatenate([part[~hot], part[told], away, away[np.searchsorted(sig[hot], sig[told])]])
        order = np.lexsort((row, sig, part))
        sig, row, part = sig[order], row[order], part[order]
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
    for a, b in zip(cuts[:-1], cuts[1:]):
        used, place = np.unique(row[a:b], return_inverse=True)
        place = place.astype(np.uint32)
        if used[-1] == ELSEWHERE:
            used = used[:-1]
            place[place == len(used)] = ELSEWHERE
        yield int(part[a]), pack(sig[a:b], place, k1[used], n[used])


def parity_of(s: np.ndarray) -> bytes:
    """Parities of a set's columns by their lowest bits: a power of two of them, one a column at least."""
    m = max(LEAST_PARITIES, 1 << (len(s) - 1).bit_length())
    return np.packbits(np.bincount((s & np.uint64(m - 1)).astype(np.int64), minlength=m) & 1).tobytes()


def folded(parities: list[bytes]) -> np.ndarray:
    """A row of 64-bit words for each, all of the least size among them: the halves of longer ones are added."""
    size = min(map(len, parities))
    out = np.empty((len(parities), size), np.uint8)
    for i, x in enumerate(parities):
        row = np.frombuffer(x, np.uint8)
        out[i] = np.bitwise_xor.reduce(row.reshape(-1, size), axis=0)
    return out.view(np.uint64)


def unlike(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """In how many parities each row of left differs from each of right."""
    if left.shape[1] <= 16:
        return sum(np.bitwise_count(left[:, w, None] ^ right[None, :, w]).astype(np.int64) for w in range(left.shape[1]))
    out = np.zeros((len(left), len(right)), np.float32)
    for w in range(0, left.shape[1], 64):
        a, b = (np.unpackbits(np.ascontiguousarray(x[:, w : w + 64]).view(np.uint8), axis=1).astype(np.float32) for x in (left, right))
        out += a.sum(axis=1)[:, None] + b.sum(axis=1)[None, :] - 2 * (a @ b.T)
    return np.rint(out).astype(np.int64)


def classes_and_blocks(docs: DataFrame, width: int, num: int, den: int, parts: int) -> DataFrame:
    """One reading of the texts: a row per document (MEMBERS: its set's size, key and parities), and packed signatures of its set by parts."""
    short_batches(docs.sparkSession)
    out = arrow_schema(docs.sparkSession, PACKED)

    def run(batches):
        ranges, seen, task = Ranges(num, den), set(), TaskContext.get().partitionId()
        held, size, flushes = [], 0, 0

        def flush():
            nonlocal held, size, flushes
            sigs, keys, sizes = zip(*held)
            row = np.repeat(np.arange(len(held), dtype=np.uint32), [len(x) for x in sigs])
            salt = (task << 20) + flushes + 1
            packed = parts_of(np.concatenate(sigs), row, np.array(keys, np.int64), np.array(sizes, np.int32), parts, salt)
            held, size, flushes = [], 0, flushes + 1
            for part, data in packed:
                yield pa.record_batch([pa.array([part], pa.int32()), pa.array([data], pa.binary()), *(pa.nulls(1, f.type) for f in list(out)[2:])], schema=out)

        for batch in batches:
            n, k1, k2, parity = [], [], [], []
            known = batch.column(0).is_valid().to_pylist()
            for row, s in enumerate(sets_of(batch.column(1), width)):
                parity.append(parity_of(s))
                key = _key(s) if len(s) else (0, 0)
                n.append(len(s))
                k1.append(key[0])
                k2.append(key[1])
                if len(s) and known[row] and key not in seen:
                    if len(seen) < 1_000_000:  # a class that comes again only has its rows twice
                        seen.add(key)
                    x = signatures(s, ranges)
                    if len(x):
                        held.append((x, key[0], len(s)))
                        size += len(x)
                        if size >= FLUSH_ROWS:
                            yield from flush()
            ids = batch.column(0).cast(pa.int64())
            part = (tb.mix(np.array(k2, np.int64).view(np.uint64) + np.arange(len(k2), dtype=np.uint64)) % np.uint64(parts)).astype(np.int32)
            yield pa.record_batch([pa.array(part), pa.nulls(len(n), pa.binary()), ids, pa.array(n, pa.int32()), pa.array(k1, pa.int64()), pa.array(k2, pa.int64()), pa.array(parity, pa.binary())], schema=out)
        if held:
            yield from flush()

    return docs.select("doc_id", "text").mapInArrow(run, PACKED)


ENTRIES = "sig long, c long, x long, " + MEMBERS


def neighbours(packed: DataFrame, num: int, den: int) -> DataFrame:
    """Of each part the pairs of classes (c, x by k1) of round 1, then the rows (sig, c) of blocks that more than one class is in. Rows of
    MEMBERS are passed on."""
    short_batches(packed.sparkSession)
    out = arrow_schema(packed.sparkSession, ENTRIES)
    member_types = [f.type for f in list(out)[3:]]

    def rows(sig, c, x):
        for i in range(0, len(c), 50_000):
            some = slice(i, i + 50_000)
            columns = [pa.nulls(len(c[some]), pa.int64()) if v is None else pa.array(v[some]) for v in (sig, c, x)]
            yield pa.record_batch([*columns, *(pa.nulls(len(c[some]), t) for t in member_types)], schema=out)

    def run(batches):
        held = []
        for batch in batches:
            blocks = batch.column(1)
            member = batch.filter(blocks.is_null())
            if member.num_rows:
                yield pa.record_batch([*(pa.nulls(member.num_rows, pa.int64()) for _ in range(3)), *member.columns[2:]], schema=out)
            held += [unpack(x.as_buffer().to_pybytes()) for x in blocks.drop_null()]
        if not held:
            return
        sig, k1, n = (np.concatenate(x) for x in zip(*held))
        held.clear()
        order = np.lexsort((k1, n, sig))
        sig, k1, n = sig[order], k1[order], n[order]
        keep = np.concatenate([[True], (sig[1:] != sig[:-1]) | (k1[1:] != k1[:-1]) | (n[1:] != n[:-1])])
        sig, k1, n = sig[keep].view(np.int64), k1[keep], n[keep]
        new = np.concatenate([[True], sig[1:] != sig[:-1]])
        group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
        shared = (np.diff(np.append(begin, len(sig))) > 1)[group]
        here = shared & (n >= 0)
        sig, k1, n = sig[here], k1[here], n[here]
        if not len(sig):
            return
        yield from rows(sig, k1, None)
        new = np.concatenate([[True], sig[1:] != sig[:-1]])
        group, begin = np.cumsum(new) - 1, np.flatnonzero(new)
        at = np.arange(len(sig))
        place = at - begin[group]
        parent, step = place.copy(), FAN_OUT
        while len(low := np.flatnonzero((parent == place) & (place > 0))):
            parent[low] -= place[low] % step
            step *= FAN_OUT
        far = (place > 0) & (parent < place - 1)
        a = np.concatenate([at[place > 0], at[far]])
        b = np.concatenate([at[place > 0] - 1, (begin[group] + parent)[far]])
        fine = n[b] * den >= n[a] * num  # sorted by size: b is the smaller one
        if fine.any():
            found, times = np.unique(np.column_stack([k1[a[fine]], k1[b[fine]]]), axis=0, return_counts=True)
            yield from rows(times, np.ascontiguousarray(found[:, 0]), np.ascontiguousarray(found[:, 1]))

    return packed.mapInArrow(run, ENTRIES)


def _spot(ids: np.ndarray, bits: int) -> np.ndarray:
    return (tb.mix(ids.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


SETS = "node long, shingles binary"


def sets_for(docs: DataFrame, pairs: DataFrame, n_pairs: int, width: int) -> DataFrame:
    """(node, shingles) of the documents in pairs (a, b), and of few others: the texts are read again, and a Bloom filter tells which sets
    are worth making and sending."""
    spark = docs.sparkSession
    short_batches(spark)
    bits = min(BLOOM_MOST, max(BLOOM_LEAST, math.ceil(math.log2(32 * max(1, n_pairs)))))
    parts = max(1, min(64, n_pairs >> 16))  # filters that reach the driver, one at a time

    def mark(batches):
        filled = np.zeros(1 << bits, bool)
        for batch in batches:
            for c in batch.columns:
                filled[_spot(c.to_numpy(zero_copy_only=False), bits)] = True
        yield pa.record_batch({"filled": pa.array([zlib.compress(np.packbits(filled).tobytes(), 1)], pa.binary())})

    filled = np.zeros((1 << bits) // 8, np.uint8)
    for r in pairs.select("a", "b").repartition(parts).mapInArrow(mark, "filled binary").toLocalIterator():
        filled |= np.frombuffer(zlib.decompress(r.filled), np.uint8)
    sent = spark.sparkContext.broadcast(filled)
    out = arrow_schema(spark, SETS)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            spot = _spot(batch.column(0).cast(pa.int64()).to_numpy(zero_copy_only=False), bits)
            batch = batch.filter(pa.array((sent.value[spot >> 3] >> (7 - (spot & 7)) & 1).astype(bool)))
            ids, held, size, first = batch.column(0).cast(pa.int64()), [], 0, 0
            for i, s in enumerate(sets_of(batch.column(1), width)):
                held.append(s.tobytes())
                size += len(held[-1])
                if size >= 1 << 22 or i == batch.num_rows - 1:  # long texts have long sets
                    yield pa.record_batch([ids[first : i + 1], pa.array(held, pa.binary())], schema=out)
                    held, size, first = [], 0, i + 1

    return docs.where("doc_id is not null").select("doc_id", "text").mapInArrow(run, SETS)


def similar(row: np.ndarray, others: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """Which of others are similar to row: overlap counts, added up over the column blocks; pairs that can't reach the bound are dropped."""
    size = np.array([len(x) for x in others], np.int64)
    need = -(-num * (len(row) + size) // (num + den))
    count, alive = np.zeros(len(others), np.int64), np.flatnonzero(np.minimum(len(row), size) >= need)
    cuts = (np.arange(1, COLUMN_BLOCKS, dtype=np.uint64) << np.uint64(61))[: COLUMN_BLOCKS - 1]
    mine = np.concatenate([[0], np.searchsorted(row, cuts), [len(row)]])
    theirs = np.array([[0, *np.searchsorted(others[i], cuts), len(others[i])] for i in range(len(others))], np.int64).reshape(len(others), -1)
    for c in range(COLUMN_BLOCKS):
        if not len(alive):
            break
        part = row[mine[c] : mine[c + 1]]
        if len(part):
            columns = [others[i][theirs[i, c] : theirs[i, c + 1]] for i in alive]
            flat = np.concatenate(columns)
            at = np.minimum(np.searchsorted(part, flat), len(part) - 1)
            hits = np.concatenate([[0], np.cumsum(part[at] == flat)])
            ends = np.cumsum([len(x) for x in columns])
            count[alive] += hits[ends] - hits[np.concatenate([[0], ends[:-1]])]
        left = np.minimum(len(row) - mine[c + 1], size[alive] - theirs[alive, c + 1])
        alive = alive[count[alive] + left >= need[alive]]
    out = np.zeros(len(others), bool)
    out[alive] = True
    return out


def links(docs: DataFrame, pairs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of documents whose sets are similar. All sides grow with the input, so none is broadcast by hand; a row with many
    partners goes to several tasks."""
    spark = docs.sparkSession
    sets = sets_for(docs, pairs, pairs.count(), width)
    hot = pairs.groupBy("a").count().where(F.col("count") > HOT_ROW)
    dealt = pairs.join(hot, "a", "left").select("a", "b", F.coalesce(F.pmod(F.xxhash64("b"), F.ceil(F.col("count") / HOT_ROW)), F.lit(0)).cast("int").alias("salt"))
    left = dealt.select("a", "salt").distinct().join(sets.hint("merge"), F.col("a") == F.col("node")).select("a", "salt", F.lit(None).cast("long").alias("b"), "shingles")
    right = dealt.join(sets.hint("merge"), F.col("b") == F.col("node")).select("a", "salt", "b", "shingles")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = left.unionAll(right).repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", "b")
    out = arrow_schema(spark, "a long, b long")

    def run(batches):
        at, mine = None, []
        for batch in batches:
            a, salt, b = (batch.column(i).to_pylist() for i in range(3))
            found_a, found_b, i = [], [], 0
            while i < len(a):
                if b[i] is None:
                    if at != (a[i], salt[i]):
                        at, mine = (a[i], salt[i]), []
                    mine.append(np.frombuffer(batch.column(3)[i].as_buffer(), np.uint64))
                    i += 1
                    continue
                j = i
                while j < len(a) and b[j] is not None and (a[j], salt[j]) == (a[i], salt[i]):
                    j += 1
                if at == (a[i], salt[i]):
                    others = [np.frombuffer(batch.column(3)[r].as_buffer(), np.uint64) for r in range(i, j)]
                    ok = np.zeros(j - i, bool)
                    for row in mine:
                        ok |= similar(row, others, num, den)
                    found_a += [a[i]] * int(ok.sum())
                    found_b += [b[i + r] for r in np.flatnonzero(ok)]
                i = j
            mine = [x.copy() for x in mine]
            yield pa.record_batch([pa.array(found_a, pa.int64()), pa.array(found_b, pa.int64())], schema=out)

    return rows.mapInArrow(run, "a long, b long").distinct()


def link_components(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for each row of docs (doc_id, text): the smallest doc_id that links reach.

    Two documents link when their sets of width-word shingles have a Jaccard similarity of num / den or more. Null and empty texts
    and texts without words have no shingles and no links; a text of fewer words is one shingle. Copies link, also repeated rows
    with one doc_id. Rows without doc_id link with nothing; their component is null. An empty table gives an empty result;
    other columns are not read.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))
    first = stored(neighbours(classes_and_blocks(docs, width, num, den, parts).repartitionById(parts, "part"), num, den), "jaccard-first")
    members = stored(first.where("c is null").drop("sig", "c", "x"), "jaccard-members")

    # a class is known by its smallest doc_id
    nodes = stored(members.where("n > 0 and doc_id is not null").groupBy("k1", "k2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("parity").alias("parity")), "jaccard-nodes")

    # of the pairs of a class the one that meets most often
    pairs = first.where("x is not null").groupBy(F.col("c").alias("k1"), F.col("x").alias("x1")).agg(F.sum("sig").alias("count"))
    best = Window.partitionBy("k1").orderBy(F.col("count").desc(), "x1")
    pairs = pairs.withColumn("r", F.row_number().over(best)).where("r = 1").select("k1", "x1")
    entries = first.where("c is not null and x is null").select("sig", F.col("c").alias("k1"))
    entries.stored_at = first.stored_at
    x, y = end_of(nodes, "b", "k1"), end_of(nodes, "a", "x1")
    pairs = near_enough(pairs.join(x.hint("merge"), "k1").join(y.hint("merge"), "x1").where("a <> b"), num, den)
    pairs = stored(pairs.distinct(), "jaccard-pairs")
    edges = stored(links(docs, pairs, width, num, den), "jaccard-links")
    found = stored(labels(nodes, edges), "jaccard-found")
    forget(pairs)

    skip, take = 0, 0
    while True:
        last, entries = entries, stored(mixed(entries, found), "jaccard-mixed")
        forget(last)
        rest = stored(across(entries, found, num, den, skip, take), "jaccard-rest")
        pairs = stored(rest.where("a is not null").distinct(), "jaccard-pairs")
        if not pairs.isEmpty():
            old = edges, found
            edges = stored(edges.unionAll(links(docs, pairs, width, num, den)), "jaccard-links")
            found = stored(labels(nodes, edges), "jaccard-found")
            forget(*old)
        done = rest.where("a is null").isEmpty()  # no tile has further pairs
        forget(rest, pairs)
        if done:
            break
        skip, take = skip + take, max(16, take * 16)
    forget(entries, edges, nodes)
    joined = members.join(found.select("k1", "k2", "component").hint("merge"), ["k1", "k2"], "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def end_of(nodes: DataFrame, name: str, key: str) -> DataFrame:
    """nodes as one end of a pair: number, size and parities with the end's name."""
    return nodes.select(F.col("k1").alias(key), F.col("node").alias(name), F.col("n").alias(f"{name}_n"), F.col("parity").alias(f"{name}_parity"))


def near_enough(pairs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose sizes allow it; two sets differ in as many shingles at least as their parities do."""
    fits = f"least(a_n, b_n) * {den}L >= greatest(a_n, b_n) * {num}L"
    out = arrow_schema(pairs.sparkSession, "a long, b long")

    def run(batches):
        for batch in batches:
            a, b, n, m, x, y = (c.to_pylist() for c in batch.columns)
            fine = [int(unlike(two[:1], two[1:])[0, 0]) * (num + den) <= (n[i] + m[i]) * (den - num) for i in range(len(a)) for two in [folded([x[i], y[i]])]]
            yield pa.record_batch([batch.column(0), batch.column(1)], schema=out).filter(pa.array(fine, pa.bool_()))

    return pairs.where(fits).select("a", "b", "a_n", "b_n", "a_parity", "b_parity").mapInArrow(run, "a long, b long")


def labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with component."""
    component = components(edges).select(F.col("node").alias("_node"), "component")
    return nodes.join(component.hint("merge"), F.col("node") == F.col("_node"), "left").drop("_node").withColumn("component", F.coalesce("component", "node"))


def mixed(entries: DataFrame, found: DataFrame) -> DataFrame:
    """The rows (sig, k1) of blocks with several components."""
    of = found.groupBy("k1").agg(F.min("component").alias("c1"), F.max("component").alias("c2"))
    several = entries.join(of.hint("merge"), "k1").groupBy("sig").agg(F.min("c1").alias("c1"), F.max("c2").alias("c2")).where("c1 < c2").select("sig")
    return entries.join(several.hint("merge"), "sig").distinct()



def across(entries: DataFrame, found: DataFrame, num: int, den: int, skip: int, take: int) -> DataFrame:
    """Pairs (a, b) of classes in one block and of different components that pass the bounds: of each pair of components in a block those at places skip
    to skip + take by how near their parities are; a row of nulls tells of more than that. With take 0: of each component the nearest to another."""
    spark = entries.sparkSession
    rows = entries.join(found.select("k1", "component", "node", "n", "parity").hint("merge"), "k1").drop("k1")
    sides = entries.groupBy("sig").agg(F.ceil(F.count("*") / SIDE_ROWS).cast("int").alias("s"))
    rows = rows.join(sides.hint("merge"), "sig").withColumn("own", F.pmod(F.xxhash64("node"), F.col("s")).cast("int"))
    # a large block is cut into sides; each pair of sides is a tile of its own
    tiles = rows.withColumn("t", F.explode(F.sequence(F.lit(0), F.col("s") - 1)))
    tiles = tiles.select("sig", F.least("own", "t").alias("i"), F.greatest("own", "t").alias("j"), F.when(F.col("own") <= F.col("t"), 0).otherwise(1).alias("side"), "component", "node", "n", "parity")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tiles = tiles.repartition(parts, "sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    short_batches(spark)
    out = arrow_schema(spark, "a long, b long")

    def tile(columns: list[np.ndarray], sent: set) -> tuple[list, bool]:
        i, j, side, component, node, n = (x.astype(np.int64) for x in columns[2:8])
        bits = folded(columns[8].tolist())
        left = np.flatnonzero(side == 0)
        right = left if i[0] == j[0] else np.flatnonzero(side == 1)
        kept = np.zeros((5, 0), np.int64)
        place = np.zeros(0, np.int64)
        for begin in range(0, len(left), 128):
            r = left[begin : begin + 128]
            differ = unlike(bits[r], bits[right])
            total = n[r, None] + n[None, right]
            fine = (differ * (num + den) <= total * (den - num)) & (np.minimum(n[r, None], n[None, right]) * den >= np.maximum(n[r, None], n[None, right]) * num) & (component[r, None] != component[None, right])
            if right is left:
                fine &= right[None, :] > r[:, None]
            x, y = np.nonzero(fine)
            differ, x, y = differ[x, y], r[x], right[y]
            low, high = np.minimum(component[x], component[y]), np.maximum(component[x], component[y])
            new = np.stack([low, high, differ, np.minimum(node[x], node[y]), np.maximum(node[x], node[y])])
            if not take:  # each pair once for either of its components
                new = np.concatenate([new, new], axis=1)
                new[0, len(x) :] = high
                new[1] = 0
            kept = np.concatenate([kept, new], axis=1)
            kept = kept[:, np.lexsort(kept[::-1])]
            first = np.concatenate([[True], (kept[0, 1:] != kept[0, :-1]) | (kept[1, 1:] != kept[1, :-1])]) if kept.shape[1] else np.zeros(0, bool)
            place = np.arange(kept.shape[1]) - np.flatnonzero(first)[np.cumsum(first) - 1]
            # one more than is wanted tells that there are more
            kept, place = kept[:, place <= skip + max(1, take)], place[place <= skip + max(1, take)]
        a, b = kept[3], kept[4]
        now = (place >= skip) & (place < skip + max(1, take))
        chosen = {p for p in zip(a[now].tolist(), b[now].tolist()) if p not in sent}
        if len(sent) < 1_000_000:  # pairs are made distinct later, too
            sent |= chosen
        return list(chosen), bool((place >= skip + take).any())

    def run(batches):
        held, more, sent = [], False, set()
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            columns = [np.zeros(batch.num_rows, np.int8), *columns]
            new = np.flatnonzero(np.any([columns[k][1:] != columns[k][:-1] for k in (1, 2, 3)], axis=0)) + 1
            pairs = []
            for k, (s, e) in enumerate(zip([0, *new], [*new, batch.num_rows])):
                piece = [c[s:e] for c in columns]
                if held and k == 0 and all(held[-1][c][0] == piece[c][0] for c in (1, 2, 3)):
                    held.append(piece)
                    continue
                if held:
                    found_, left_ = tile([np.concatenate(c) for c in zip(*held)], sent)
                    pairs, more = pairs + found_, more or left_
                held = [piece]
            if pairs:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*pairs)], schema=out)
        if held:
            pairs, left_ = tile([np.concatenate(c) for c in zip(*held)], sent)
            more = more or left_
            if pairs:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*pairs)], schema=out)
        if more:
            yield pa.record_batch([pa.nulls(1, pa.int64())] * 2, schema=out)

    return tiles.mapInArrow(run, "a long, b long")


def one_of_each_group(docs: DataFrame, width: int = 5, num: int = 4, den: int = 5) -> DataFrame:
    """The rows of docs whose doc_id is that of their component; rows without doc_id stay, of repeated rows with one doc_id all do."""
    dropped = link_components(docs, width, num, den).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)
