"""Nearest neighbours from randomly rotated one-bit codes, in coarse cells.

A vector is turned by a random matrix with orthonormal columns into BITS dimensions, and the code keeps the signs, packed, with
two scalars: the vector's length and the inner product of its direction with the code's. A query's turned direction is quantised
to PLANES bits a component; popcounts of its bit planes and a code give the product of both, which divided by that
scalar is an unbiased estimate of the cosine. Its error is bounded, with high probability, by sqrt((1 - c^2) / c^2) * SIGMAS /
sqrt(BITS - 1), c being the scalar, and by the quantisation's own share.

Codes are made once and stored, by cells of a k-means fitted on at most MAX_SAMPLE vectors; every vector is in a cell. A query goes to
the cells nearest to it first, which gives its k-th best score so far. Then it goes to all further cells that can hold a better one: those where
the product with the cell's mean and REACH standard deviations of the members' rest reach that score. In a cell, vectors whose upper
bound reaches it are reranked with exact products of the original vectors; no fixed number of cells or candidates is involved.
exact=True reads all cells and reranks all vectors.

Cells are cut into parts of bounded size, and so are the queries of a part. Of equal vectors only the 2 k smallest ids are candidates, as no
more can be among the nearest, and equal queries are searched once.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow_schema, short_batches, stored

BITS, PLANES, SIGMAS, REACH, SEED = 512, 4, 3.0, 4.0, 20240521
#: Vectors that the cells are fitted on, at most: those with the smallest hashes. Vectors of a cell, aimed at; cells, at most.
MAX_SAMPLE, CELL_ROWS, MAX_CELLS = 65_536, 2_048, 4_096
#: Queries and candidates of a block, at most.
QUERY_BLOCK, CANDIDATE_BLOCK = 1024, 4096
#: Queries that meet a block's codes at once; pairs that are gathered at once for exact products.
QUERY_ROWS, RERANK_PAIRS = 64, 1 << 16
#: Stands for no id.
NONE = -(1 << 63)


def rotation(dims: int, bits: int = BITS) -> np.ndarray:
    """bits x dims with orthonormal columns; bits is at least dims."""
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((max(bits, dims), dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def width_of(dims: int) -> int:
    """Bits of a code: whole words of 64."""
    return max(BITS, -(-dims // 64) * 64)


_turns: dict[int, np.ndarray] = {}


def turned(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lengths, and directions after the rotation."""
    dims = x.shape[1]
    if dims not in _turns:
        _turns[dims] = rotation(dims, width_of(dims))
    length = np.sqrt(np.einsum("ij,ij->i", x, x))
    return length, (x / length[:, None]).astype(np.float32) @ _turns[dims].T


class Codes:
    """Packed codes (rows of 64-bit words) with their correction scalars."""

    def __init__(self, words: np.ndarray, length: np.ndarray, scalar: np.ndarray) -> None:
        self.words, self.length, self.scalar = words, length, scalar
        self.width = words.shape[1] * 64
        self.ones = np.bitwise_count(words).sum(axis=1, dtype=np.int64)

    @classmethod
    def of(cls, x: np.ndarray) -> Codes:
        length, unit = turned(x)
        return cls(np.packbits(unit > 0, axis=1).view(np.uint64), length, np.abs(unit).sum(axis=1) / np.sqrt(unit.shape[1]))

    def error(self, sigmas: float = SIGMAS) -> np.ndarray:
        c = np.clip(self.scalar, 1e-9, 1.0)
        return np.sqrt((1 - c * c) / (c * c)) * sigmas / np.sqrt(self.width - 1)


class Planes:
    """Directions of queries, turned and quantised: bit planes packed as the codes are."""

    def __init__(self, queries: np.ndarray) -> None:
        self.length, unit = turned(queries)
        self.low = unit.min(axis=1)
        self.step = np.maximum((unit.max(axis=1) - self.low) / ((1 << PLANES) - 1), 1e-12)
        level = np.rint((unit - self.low[:, None]) / self.step[:, None]).astype(np.uint8)
        self.total = level.sum(axis=1) * self.step + self.low * unit.shape[1]
        self.bits = [np.packbits(level >> j & 1, axis=1).view(np.uint64) for j in range(PLANES)]

    def cosines(self, codes: Codes, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """Estimates of rows x codes from popcounts, and the quantisation's standard error."""
        levels = np.zeros((len(self.low[rows]), len(codes.words)), np.uint32)
        count = np.empty(levels.shape, np.uint16)
        for j, plane in enumerate(self.bits):
            count[:] = 0
            for w in range(codes.words.shape[1]):
                count += np.bitwise_count(plane[rows, w, None] & codes.words[None, :, w])
            levels += count.astype(np.uint32) << np.uint32(j)
        product = 2 * (self.step[rows, None] * levels + self.low[rows, None] * codes.ones[None, :]) - self.total[rows, None]
        over = np.sqrt(codes.width) * codes.scalar
        return product / over[None, :], self.step[rows, None] * np.sqrt(codes.width / 12) / over[None, :]


def exact(queries: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Products of pairs of rows in double precision, summed from the first component to the last."""
    total = np.zeros(len(x))
    for d in range(x.shape[1]):
        total += queries[:, d] * x[:, d]
    return total


def scores(queries: np.ndarray, x: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
    out = np.empty(len(rows))
    for i in range(0, len(rows), RERANK_PAIRS):
        part = slice(i, i + RERANK_PAIRS)
        out[part] = exact(queries[rows[part]], x[columns[part]])
    return out


def block_best(own: np.ndarray, queries: np.ndarray, least: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, codes: Codes | None = None, sigmas: float = SIGMAS):
    """(query's number, vector id, score) of the k best of one block for each query, ties to smaller ids.

    own: an id that is no candidate for the query (or NONE); least: a score that the k-th best reaches anyhow. Without codes all are reranked.
    """
    parts = []
    planes = Planes(queries) if codes is not None else None
    for begin in range(0, len(queries), QUERY_ROWS):
        some = slice(begin, begin + QUERY_ROWS)
        q = queries[some]
        other = own[some, None] != ids[None, :]
        if codes is None:
            rows, columns = np.nonzero(other)
            score = scores(q, x, rows, columns)
        else:
            estimate, rough = planes.cosines(codes, some)
            scale = planes.length[some, None] * codes.length[None, :]
            high = np.where(other, (estimate + codes.error(sigmas)[None, :] + sigmas * rough) * scale, -np.inf)
            bar = least[some].copy()
            if len(ids) > k:
                # the exact scores of the k best estimates: the k-th best score can't be lower than their least one
                best = np.argpartition(np.where(other, -estimate * scale, np.inf), k - 1, axis=1)[:, :k]
                first = scores(q, x, np.repeat(np.arange(len(q)), k), best.ravel()).reshape(len(q), k)
                first[~np.take_along_axis(other, best, axis=1)] = -np.inf
                bar = np.maximum(bar, first.min(axis=1))
            rows, columns = np.nonzero((high >= bar[:, None]) & other)
            score = scores(q, x, rows, columns)
            reach = score >= bar[rows]
            rows, columns, score = rows[reach], columns[reach], score[reach]
        order = np.lexsort((ids[columns], -score, rows))
        rows, columns, score = rows[order], columns[order], score[order]
        keep = np.arange(len(rows)) - np.searchsorted(rows, rows) < k
        parts.append((rows[keep] + begin, ids[columns[keep]], score[keep]))
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*parts))


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding as doubles) of the vectors that take part."""
    x = F.col("embedding")
    fine = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) > 0) & fine & F.exists(x, lambda v: v != 0)).select("vec_id", x.cast("array<double>").alias("embedding"))


class Cells:
    """Means of the cells of each number of dimensions, and, once counted, what each cell holds. Cells have numbers from 0 on."""

    def __init__(self, samples: dict[int, np.ndarray], rows: dict[int, int]) -> None:
        self.means, self.first, n = {}, {}, 0
        for dims in sorted(rows):
            self.means[dims] = k_means(samples[dims], min(MAX_CELLS, -(-rows[dims] // CELL_ROWS)))
            self.first[dims] = n
            n += len(self.means[dims])
        self.rows, self.spread = np.zeros(n, np.int64), np.zeros(n)

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The cell of each row, and the square of what the cell's mean leaves of it."""
        means = self.means[x.shape[1]]
        away = (means * means).sum(axis=1)[None, :] - 2 * (x @ means.T)
        at = away.argmin(axis=1)
        rest = x - means[at]
        return at + self.first[x.shape[1]], np.einsum("ij,ij->i", rest, rest)

    def routes(self, queries: np.ndarray, least: np.ndarray | None, k: int):
        """(query's number, cell) of the cells that come first (least is None), or of the others that can hold a score of least or more."""
        dims = queries.shape[1]
        means, begin = self.means[dims], self.first[dims]
        cells = slice(begin, begin + len(means))
        product = queries @ means.T
        order = np.argsort(-product, axis=1, kind="stable")
        held = np.cumsum(self.rows[cells][order], axis=1)
        home = np.empty(product.shape, bool)
        np.put_along_axis(home, order, held - self.rows[cells][order] < 2 * k, axis=1)
        home &= self.rows[cells] > 0
        if least is None:
            chosen = home
        else:
            size = np.sqrt(np.einsum("ij,ij->i", queries, queries))
            chosen = ~home & (self.rows[cells] > 0) & (product + REACH * size[:, None] * self.spread[cells][None, :] >= least[:, None])
        rows, columns = np.nonzero(chosen)
        return rows, columns + begin


def k_means(x: np.ndarray, n: int, rounds: int = 6) -> np.ndarray:
    means = x[np.linspace(0, len(x) - 1, min(n, len(x))).astype(int)].copy()
    for _ in range(rounds if len(means) > 1 else 0):
        at = np.concatenate([((means * means).sum(axis=1)[None, :] - 2 * (x[i : i + 4096] @ means.T)).argmin(axis=1) for i in range(0, len(x), 4096)])
        count = np.bincount(at, minlength=len(means))
        for d in range(x.shape[1]):
            total = np.bincount(at, x[:, d], minlength=len(means))
            means[:, d] = np.where(count > 0, total / np.maximum(count, 1), means[:, d])
    return means if n > 1 else x.mean(axis=0, keepdims=True)


def by_size(rows: pa.Table | pa.RecordBatch) -> list[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each number of dimensions."""
    column = rows.column("embedding")
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat, begin = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])
    return [(at, flat[begin[at][:, None] + np.arange(d)]) for d in np.unique(sizes) for at in [np.flatnonzero(sizes == d)]]


INDEX = "vec_id long, embedding array<double>, cell int, rest double, code binary, length double, scalar double"


def build(vectors: DataFrame, k: int) -> tuple[DataFrame, Cells]:
    """The stored index (INDEX) of usable vectors, and its cells."""
    spark = vectors.sparkSession
    vectors = vectors.withColumn("h", F.xxhash64("embedding"))
    # no more than 2 k rows of one vector, no more than k of one id: whatever id is left out, the k smallest others are there
    one = Window.partitionBy("h", "embedding").orderBy("vec_id")
    same = Window.partitionBy("h", "embedding", "vec_id").orderBy("vec_id")
    kept = vectors.withColumn("r", F.row_number().over(same)).where(F.col("r") <= k).withColumn("r", F.row_number().over(one)).where(F.col("r") <= 2 * k)
    kept = stored(kept.select("vec_id", "embedding", "h"), "ann-vectors")
    rows = {r["d"]: r["count"] for r in kept.groupBy(F.size("embedding").alias("d")).count().collect()}
    picked = kept.orderBy("h", "vec_id").limit(MAX_SAMPLE).select("embedding").toArrow()
    samples = {x.shape[1]: x for _, x in by_size(picked)} if picked.num_rows else {}
    for d in rows:  # a rare number of dimensions may miss the sample: one cell around any of its vectors
        if d not in samples:
            samples[d] = np.array([kept.where(F.size("embedding") == d).first().embedding])
    cells = Cells(samples, rows)
    short_batches(spark)
    out = arrow_schema(spark, INDEX)

    def run(batches):
        for batch in batches:
            for at, x in by_size(batch) if batch.num_rows else ():
                cell, rest = cells.nearest(x)
                codes = Codes.of(x)
                packed = pa.array([w.tobytes() for w in codes.words], pa.binary())
                yield pa.record_batch([batch.column("vec_id").take(pa.array(at)), batch.column("embedding").take(pa.array(at)), pa.array(cell, pa.int32()), pa.array(rest), packed, pa.array(codes.length, pa.float64()), pa.array(codes.scalar, pa.float64())], schema=out)

    index = stored(kept.select("vec_id", "embedding").mapInArrow(run, INDEX), "ann-index")
    for r in index.groupBy("cell").agg(F.count("*").alias("n"), F.avg(F.col("rest") / F.size("embedding")).alias("v")).collect():  # MAX_CELLS a number of dimensions, at most
        cells.rows[r.cell], cells.spread[r.cell] = r.n, np.sqrt(r.v)
    return index, cells


ROUTED = "q long, own long, embedding array<double>, least double, cell int"
FOUND = "q long, vec_id long, score double"


def route(queries: DataFrame, cells: Cells, k: int, further: bool, all_cells: bool) -> DataFrame:
    """A row per query (q, own, embedding, least) and cell that it goes to."""
    out = arrow_schema(queries.sparkSession, ROUTED)

    def run(batches):
        for batch in batches:
            for at, x in by_size(batch) if batch.num_rows else ():
                if x.shape[1] not in cells.means:
                    continue
                least = batch.column("least").to_numpy(zero_copy_only=False)[at].astype(float)
                least = np.where(np.isnan(least) | all_cells, -np.inf, least)
                rows, cell = cells.routes(x, least if further else None, k)
                for i in range(0, len(rows), 512):
                    some = pa.array(at[rows[i : i + 512]])
                    yield pa.record_batch([batch.column("q").take(some), batch.column("own").take(some), batch.column("embedding").take(some), pa.array(least[rows[i : i + 512]]), pa.array(cell[i : i + 512], pa.int32())], schema=out)

    return queries.select("q", "own", "embedding", "least").mapInArrow(run, ROUTED)


def meet(routed: DataFrame, index: DataFrame, cells: Cells, k: int, sigmas: float, everything: bool) -> DataFrame:
    """FOUND rows: the best of each part of a cell for the queries that go there."""
    spark = index.sparkSession
    out = arrow_schema(spark, FOUND)
    routed = stored(routed, "ann-routes")
    asked = {r["cell"]: r["count"] for r in routed.groupBy("cell").count().collect()}  # one row a cell
    if not asked:
        return spark.createDataFrame([], FOUND)
    parts = np.maximum(1, -(-cells.rows * 4 // (CANDIDATE_BLOCK * 3)))
    blocks = [max(1, -(-asked.get(c, 0) * 4 // (QUERY_BLOCK * 3))) for c in range(len(cells.rows))]

    def of_cell(numbers):
        return F.element_at(F.array(*map(F.lit, map(int, numbers))), F.col("cell") + 1) if len(numbers) < 64 else F.element_at(F.from_json(F.lit(str(list(map(int, numbers)))), "array<int>"), F.col("cell") + 1)

    up_to = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    visited = index.where(F.col("cell").isin(list(map(int, asked)))) if len(asked) < 64 else index
    left = routed.withColumn("b", F.pmod(F.xxhash64("q"), of_cell(blocks)).cast("int")).withColumn("p", up_to(of_cell(parts)))
    right = visited.withColumn("p", F.pmod(F.xxhash64("vec_id", F.lit(1)), of_cell(parts)).cast("int")).withColumn("b", up_to(of_cell(blocks)))

    def pair(asking: pa.Table, held: pa.Table) -> pa.Table:
        rows = []
        if asking.num_rows and held.num_rows:
            (_, queries), (_, x) = by_size(asking)[0], by_size(held)[0]  # a cell has one number of dimensions
            number = lambda table, name: table.column(name).to_numpy()
            q, own, least, ids = number(asking, "q"), number(asking, "own"), number(asking, "least"), number(held, "vec_id")
            words = np.frombuffer(b"".join(held.column("code").to_pylist()), np.uint64).reshape(len(ids), -1)
            for b in range(0, len(ids), CANDIDATE_BLOCK):
                some = slice(b, b + CANDIDATE_BLOCK)
                codes = None if everything else Codes(words[some], number(held, "length")[some], number(held, "scalar")[some])
                at, found, score = block_best(own, queries, least, ids[some], x[some], k, codes, sigmas)
                rows.append((q[at], found, score))
        columns = [np.concatenate(c) for c in zip(*rows)] if rows else [[], [], []]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, out)], schema=out)

    return left.groupBy("cell", "p", "b").cogroup(right.drop("rest").groupBy("cell", "p", "b")).applyInArrow(pair, FOUND)


def search(vectors: DataFrame, queries: DataFrame, k: int = 20, sigmas: float = SIGMAS, exact: bool = False) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest vectors (vec_id, embedding) of each query by inner product.

    Vectors that are null, empty or zero, or hold null or non-finite components, or have no vec_id, take no part, as queries or as
    candidates; a vector is no neighbour of a query with its id. Vectors meet queries of their own number of dimensions. All rows of a
    repeated vec_id are candidates; a vec_id with several query rows is one query per vector, ranked together. Ties go to the smaller
    vec_id. Empty tables give an empty result; other columns are not read. exact: every vector is reranked.
    """
    index, cells = build(usable(vectors), k)
    # equal queries are searched once, with one neighbour more, as each of them leaves itself out; a vec_id with several rows is on its own
    asked = usable(queries).distinct().join(usable(vectors).groupBy("vec_id").count().where("count > 1").select("vec_id", F.lit(True).alias("many")), "vec_id", "left")
    asked = asked.withColumn("own", F.when(F.col("many"), F.col("vec_id")).otherwise(F.lit(NONE))).withColumn("h", F.xxhash64("embedding"))
    asked = stored(asked.withColumn("q", F.min("vec_id").over(Window.partitionBy("h", "embedding", "own"))), "ann-queries")
    # q may be that of several vectors of a repeated id: made distinct with the vector's hash
    asked = asked.withColumn("q", F.when(F.col("own") == NONE, F.col("q")).otherwise(F.xxhash64("q", "h")))
    once = asked.where((F.col("own") != NONE) | (F.col("q") == F.col("vec_id"))).select("q", F.col("own").cast("long").alias("own"), "embedding")
    once = once.withColumn("least", F.lit(None).cast("double"))

    most = k + 1
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    ranked = lambda df: df.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most)
    home = stored(ranked(meet(route(once, cells, most, False, exact), index, cells, most, sigmas, exact)).drop("r"), "ann-home")
    least = home.groupBy("q").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == most).drop("n")
    rest = meet(route(once.drop("least").join(least, "q", "left"), cells, most, True, exact), index, cells, most, sigmas, exact)
    found = ranked(home.unionAll(rest)).select("q", F.col("vec_id").alias("id"), "score")
    found = asked.select("q", F.col("vec_id").alias("query_id")).join(found, "q").where("id <> query_id")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias("vec_id"), "score")
