"""A stored nearest-neighbour graph for each scope and generation of vectors, walked for many questions at once.

Build: a few times over, with other pivots each time, every vector goes to its nearest pivots of its scope; vectors under one pivot are compared with each
other by a matrix product and each keeps its nearest ones and a few at random. What all rounds found is merged, links are made to go both ways, and
a vector keeps its DEGREE best: a navigable small world, stored as adjacency lists sorted by vector, partitioned by generation.

Search: a question starts at its scope's entry vectors and holds a beam of the best vectors seen. Each step joins the unread vectors of all beams with
their adjacency lists, and compares what hasn't been seen; the walk ends where no beam has an unread vector. Graphs never leave a scope, so the tenancy
filter holds inside the walk: a small tenant costs a small walk, and no candidates are spent on others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DoubleType, FloatType, IntegerType, StructField, StructType
from pyspark.sql.window import Window

from ..sources.shared import forget, stored
from .retrieval import BLOCK, POOL, dense, in_blocks, ranked

#: Rounds of pivots, pivots that each vector goes to in a round, vectors under a pivot on average and at most, pivots of a scope at most.
ROUNDS, NEAREST, LEAF, LEAF_MOST, PIVOTS = 3, 2, 128, 2048, 1024
#: Links: the nearest and random ones that a leaf gives, and how many a vector keeps.
NEAR, RANDOM, DEGREE = 16, 2, 32
#: Entry vectors of a scope, and the width of a beam.
ENTRIES, BEAM = 32, 96


def usable(vectors: DataFrame) -> DataFrame:
    """The rows (scope, chunk_id, embedding) with a direction; null, zero and non-finite vectors have no place in an index."""

    def run(batches):
        for batch in batches:
            norms = [np.linalg.norm(np.asarray(x, np.float64)) if x is not None else 0 for x in batch.column(2).to_numpy(zero_copy_only=False)]
            yield batch.filter(pa.array([bool(np.isfinite(n) and n > 0) for n in norms], pa.bool_()))

    rows = vectors.select("scope", "chunk_id", "embedding")
    return rows.mapInArrow(run, rows.schema)


def matrix(column: pa.ChunkedArray, kind=np.float32) -> np.ndarray:
    """Vectors of one size as rows of length one."""
    flat = column.combine_chunks()
    if not len(flat):
        return np.zeros((0, 0), kind)
    m = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1).astype(np.float64)
    return (m / np.linalg.norm(m, axis=1, keepdims=True)).astype(kind)


def leaves(vectors: DataFrame) -> DataFrame:
    """vectors once for each round and each of their NEAREST pivots: round, leaf, scope, chunk_id, embedding."""
    order = Window.partitionBy("scope", "round").orderBy(F.xxhash64("chunk_id", "round"), "chunk_id")
    sizes = vectors.groupBy("scope").agg(F.least(F.lit(PIVOTS), F.ceil(F.count("*") / LEAF)).cast("int").alias("want"))
    pivots = vectors.withColumn("round", F.explode(F.sequence(F.lit(0), F.lit(ROUNDS - 1)))).withColumn("leaf", F.row_number().over(order)).where(F.col("leaf") <= PIVOTS)
    pivots = pivots.join(sizes, "scope").where("leaf <= want").select("scope", "round", "leaf", F.col("embedding").alias("pivot"))
    held, pivots = in_blocks(vectors, pivots, "chunk_id", "part", BLOCK)
    schema = StructType([StructField("round", IntegerType()), StructField("leaf", IntegerType()), *vectors.schema.fields])
    out = to_arrow_schema(schema)

    def assign(rows: pa.Table, around: pa.Table) -> pa.Table:
        v, found = matrix(rows["embedding"]), []
        rounds, numbers, p = around["round"].to_numpy(), around["leaf"].to_numpy(), matrix(around["pivot"])
        for r in np.unique(rounds) if len(v) else ():
            near = v @ p[rounds == r].T
            best = np.argsort(-near, axis=1, kind="stable")[:, :NEAREST]
            for k in range(best.shape[1]):
                leaf = numbers[rounds == r][best[:, k]]
                found.append(pa.Table.from_arrays([pa.array(np.full(len(v), r, np.int32)), pa.array(leaf.astype(np.int32)), *(rows[c] for c in ("scope", "chunk_id", "embedding"))], schema=out))
        return pa.concat_tables(found) if found else out.empty_table()

    pivots = pivots.select(*(F.col(c).alias(c) for c in pivots.columns))  # both sides come from one table
    return held.groupBy("scope", "part").cogroup(pivots.groupBy("scope", "part")).applyInArrow(assign, schema)


def links(members: DataFrame) -> DataFrame:
    """scope, chunk_id, other, near: of each leaf's vectors the nearest ones and some at random. A leaf with many vectors is cut by vector."""
    keys = ["scope", "round", "leaf"]
    large = members.groupBy(*keys).agg(F.ceil(F.count("*") / LEAF_MOST).cast("int").alias("_n"))
    members = members.join(large.where("_n > 1"), keys, "left").withColumn("cut", F.pmod(F.xxhash64("chunk_id"), F.coalesce("_n", F.lit(1))).cast("int")).drop("_n")
    id_ = members.schema["chunk_id"]
    schema = StructType([members.schema["scope"], id_, StructField("other", id_.dataType), StructField("near", FloatType())])
    out = to_arrow_schema(schema)

    def compare(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk_id")
        v, n = matrix(rows["embedding"]), rows.num_rows
        rng, found = np.random.default_rng(n), []
        for k in range(0, n, 512):
            near = v[k : k + 512] @ v.T
            near[np.arange(len(near)), np.arange(k, k + len(near))] = -2
            m = min(NEAR, n - 1)
            best = np.argpartition(-near, m - 1, axis=1)[:, :m] if m > 0 else np.zeros((len(near), 0), int)
            best = np.concatenate([best, rng.integers(0, n, (len(near), RANDOM))], axis=1)
            a = np.repeat(np.arange(k, k + len(near)), best.shape[1])
            b = best.ravel()
            fine = a != b
            found.append((a[fine], b[fine], near[a[fine] - k, b[fine]]))
        a, b, near = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int),) * 3
        ids = rows["chunk_id"]
        return pa.Table.from_arrays([rows["scope"].take(pa.array(a)), ids.take(pa.array(a)), ids.take(pa.array(b)), pa.array(near.astype(np.float32))], schema=out)

    return members.groupBy(*keys, "cut").applyInArrow(compare, schema)


def build(vectors: DataFrame, generation: str = "active") -> DataFrame:
    """The index of vectors (scope, chunk_id, embedding, one size a scope), written and read again: scope, chunk_id, embedding, others, entry, generation."""
    held = stored(usable(vectors).dropDuplicates(["scope", "chunk_id"]), "vector-units")
    one_way = links(leaves(held))
    both = one_way.unionByName(one_way.select("scope", F.col("other").alias("chunk_id"), F.col("chunk_id").alias("other"), "near"))
    both = stored(both.groupBy("scope", "chunk_id", "other").agg(F.max("near").alias("near")), "vector-links")
    # the best links, and as many at random as a leaf gave: those lead from one region to another
    mine = Window.partitionBy("scope", "chunk_id")
    chosen = both.withColumn("r", F.row_number().over(mine.orderBy(F.col("near").desc(), "other"))).withColumn("far", F.row_number().over(mine.orderBy(F.xxhash64("other"), "other")))
    chosen = chosen.where((F.col("r") <= DEGREE) | (F.col("far") <= 2 * RANDOM)).groupBy("scope", "chunk_id").agg(F.collect_list("other").alias("others"))
    first = Window.partitionBy("scope").orderBy(F.xxhash64("chunk_id"), "chunk_id")
    entries = held.select("scope", "chunk_id", F.row_number().over(first).alias("e")).where(F.col("e") <= ENTRIES).select("scope", "chunk_id", F.lit(True).alias("entry"))
    rows = held.join(chosen, ["scope", "chunk_id"], "left").join(entries, ["scope", "chunk_id"], "left")
    rows = rows.select("scope", "chunk_id", "embedding", F.coalesce("others", F.array().cast(rows.schema["others"].dataType)).alias("others"), F.coalesce("entry", F.lit(False)).alias("entry"), F.lit(generation).alias("generation"))
    index = stored(rows.sortWithinPartitions("scope", "chunk_id"), "vector-index", "generation")
    forget(held, both)
    return index


def search(questions: DataFrame, index: DataFrame, k: int = POOL, beam: int = BEAM, count_visits: bool = False, exact: bool = False) -> DataFrame:
    """q_id, chunk_id, similarity, v_rank: the k nearest found by cosine for each question (q_id, scope, embedding; a row for each scope that it may search).

    A beam is at least as wide as k. With exact, every vector of the scope is compared after the walk, by blocks, and what the walk found says which of them go on:
    only those at least as near as its k-th; so none of the nearest is missed. With count_visits: q_id, scope and how many vectors the question was compared with. Questions without a vector,
    and in a scope without vectors, find nothing.
    """
    beam = max(beam, k)
    asked = stored(usable(questions.select("scope", F.col("q_id").alias("chunk_id"), "embedding")).select("scope", F.col("chunk_id").alias("q_id"), F.col("embedding").alias("q")).dropDuplicates(["scope", "q_id"]), "vector-questions")
    seen = stored(_compared(asked.join(index.where("entry").select("scope", "chunk_id", "embedding"), "scope")), "vector-walk")
    order = Window.partitionBy("scope", "q_id").orderBy(F.col("near").desc(), "chunk_id")
    while True:
        now = seen.withColumn("place", F.row_number().over(order))
        unread = now.where((F.col("place") <= beam) & ~F.col("read")).select("scope", "q_id", "chunk_id")
        found = unread.join(index.select("scope", "chunk_id", "others"), ["scope", "chunk_id"]).select("scope", "q_id", F.explode("others").alias("chunk_id")).distinct()
        found = found.join(seen.select("scope", "q_id", "chunk_id"), ["scope", "q_id", "chunk_id"], "left_anti")
        new = _compared(found.join(index.select("scope", "chunk_id", "embedding"), ["scope", "chunk_id"]).join(asked, ["scope", "q_id"]))
        after = stored(now.select("scope", "q_id", "chunk_id", "near", (F.col("read") | (F.col("place") <= beam)).alias("read")).unionByName(new), "vector-walk")
        forget(seen)
        seen = after
        if seen.where("not read").isEmpty():
            break
        # what came last may lie outside all beams
        if seen.withColumn("place", F.row_number().over(order)).where((F.col("place") <= beam) & ~F.col("read")).isEmpty():
            break
    if count_visits:
        return seen.groupBy("q_id", "scope").agg(F.count("*").alias("visits"))
    scored = seen.select("q_id", "chunk_id", F.round("near", 6).alias("similarity"))
    best = ranked(scored, "similarity", "v_rank", k)
    if not exact:
        return best
    # a floor lies under any rounding of the k-th similarity
    floors = best.where(F.col("v_rank") == k).select("q_id", (F.col("similarity") - 2e-6).alias("floor"))
    return dense(asked.join(floors, "q_id", "left").withColumnRenamed("q", "embedding"), index, k)


def _compared(pairs: DataFrame) -> DataFrame:
    """scope, q_id, chunk_id, near (the product of embedding and q), read: false."""
    kept = ["scope", "q_id", "chunk_id"]
    schema = StructType([*(pairs.schema[c] for c in kept), StructField("near", DoubleType()), StructField("read", BooleanType())])
    out = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            t = pa.Table.from_batches([batch])
            near, size, other = np.zeros(len(t)), pc.list_value_length(t["embedding"]).to_numpy(), pc.list_value_length(t["q"]).to_numpy()
            for n in np.unique(size):  # scopes may have sizes of their own; a question of another size is near nothing
                at = np.flatnonzero((size == n) & (other == n))
                if len(at):
                    near[at] = np.einsum("ij,ij->i", matrix(t["embedding"].take(pa.array(at)), np.float64), matrix(t["q"].take(pa.array(at)), np.float64))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), pa.array(near), pa.array(np.zeros(len(near), bool))], schema=out)

    return pairs.select(*kept, "embedding", "q").mapInArrow(run, schema)
