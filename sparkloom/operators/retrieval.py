"""Hybrid retrieval over many questions at once, as one plan.

chunks: chunk_id, scope, content. vectors: chunk_id, scope, embedding. questions: q_id, scope, text, embedding. Scope filters stand
below every ranking, so candidates are not spent on other tenants. Similarities and ranks are rounded before they order,
and every order ends with the id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType
from pyspark.sql.window import Window

from ..functions import text as T
from ..functions.rules import channel_size, pool_size
from ..functions.stems import cut
from ..sources.shared import dealt

RRF_K, FLOOR, TOP_K, POOL = 60, 0.35, 8, 20
#: Rows of a block of a scope's vectors or questions.
BLOCK = 4096
#: Texts of a partition that lexical search deals; bytes of texts of a block, rows of a block of questions, counts that stand in memory.
TEXTS, BYTES, QUESTIONS, CELLS = 2_500, 1 << 23, 1 << 14, 1 << 23


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null if either is null or zero, or sizes differ."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm)


def ranked(df: DataFrame, score: str, name: str, k: int) -> DataFrame:
    """The k best rows of each question; row_number <= k becomes a group limit before the shuffle."""
    order = Window.partitionBy("q_id").orderBy(F.col(score).desc(), "chunk_id")
    return df.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def dense(questions: DataFrame, vectors: DataFrame, k: int = POOL) -> DataFrame:
    """q_id, chunk_id, similarity, v_rank: exact cosine over the vectors of the question's scope; 0 where either is null, zero or of another size.

    Blocks of a scope's vectors meet blocks of its questions: each pair of blocks is one matrix product that keeps the k best of each question, so
    what is shuffled afterwards is k rows a question and block. Scopes of up to BLOCK vectors are one block; larger ones are cut by chunk. Questions
    with a column `floor` get only rows of at least that similarity (null: all).
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    held, asked = vectors.select("scope", "chunk_id", "embedding"), questions.select("scope", "q_id", "embedding", *(["floor"] if "floor" in questions.columns else []))
    held, asked = in_blocks(held, asked, "chunk_id", "part", BLOCK)
    asked, held = in_blocks(asked, held, "q_id", "q_part", BLOCK)
    schema = StructType([questions.schema["q_id"], vectors.schema["chunk_id"], StructField("similarity", DoubleType())])
    out = to_arrow_schema(schema)

    def best(vectors_: pa.Table, questions_: pa.Table) -> pa.Table:
        v = vectors_.sort_by("chunk_id")  # of equal similarities the smaller id stands first
        rows, columns, values = [], [], []
        floors = questions_["floor"].to_pylist() if "floor" in questions_.column_names else [None] * questions_.num_rows
        for q, similarity in cosines(questions_["embedding"], v["embedding"]):
            similarity = np.floor(similarity * 1e6 + 0.5) / 1e6
            near = np.arange(len(similarity))
            if len(near) > k:
                near = np.flatnonzero(similarity >= np.partition(similarity, -k)[-k])
            if floors[q] is not None:
                near = near[similarity[near] >= floors[q]]
            near = near[np.argsort(-similarity[near], kind="stable")[:k]]
            rows += [q] * len(near)
            columns.append(near)
            values.append(similarity[near])
        if not rows:
            return out.empty_table()
        return pa.Table.from_arrays([questions_["q_id"].take(pa.array(rows)), v["chunk_id"].take(pa.array(np.concatenate(columns))), pa.array(np.concatenate(values))], schema=out)

    keys = ["scope", "part", "q_part"]
    scored = held.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(best, schema)
    return ranked(scored.withColumn("similarity", F.round("similarity", 6)), "similarity", "v_rank", k)


def in_blocks(df: DataFrame, other: DataFrame, key: str, name: str, size: int) -> tuple[DataFrame, DataFrame]:
    """df cut into blocks of about `size` rows of a scope, by key, and other with a copy of each row for each block of its scope."""
    large = df.groupBy("scope").agg(F.ceil(F.count("*") / size).cast("int").alias("_n")).where("_n > 1")
    if large.count() <= 1 << 16:  # rows of a scope and a number: a few MB
        large = F.broadcast(large)
    number = F.coalesce("_n", F.lit(1))
    cut = df.join(large, "scope", "left").withColumn(name, F.pmod(F.xxhash64(key), number).cast("int")).drop("_n")
    copied = other.join(large, "scope", "left").withColumn(name, F.explode(F.sequence(F.lit(0), number - 1))).drop("_n")
    return cut, copied


def cosines(questions: pa.ChunkedArray, vectors: pa.ChunkedArray, step: int = 64) -> Iterator[tuple[int, np.ndarray]]:
    """(number of a question, its similarity to each vector), by matrix products of `step` questions."""
    sides = []
    for column in (questions, vectors):
        by_size: dict[int, list] = {}
        for i, x in enumerate(column.to_numpy()):
            if x is not None:
                x = np.asarray(x, np.float64)
                norm = np.sqrt(x @ x)
                if np.isfinite(norm) and norm > 0:
                    by_size.setdefault(len(x), []).append((i, x / norm))
        sides.append({n: (np.array([i for i, _ in rows]), np.array([x for _, x in rows])) for n, rows in by_size.items()})
    seen = set()
    for n, (numbers, matrix) in sides[0].items():
        at, held = sides[1].get(n, (None, None))
        for k in range(0, len(numbers), step):
            product = matrix[k : k + step] @ held.T if held is not None else None
            for j, q in enumerate(numbers[k : k + step].tolist()):
                similarity = np.zeros(len(vectors))
                if held is not None:
                    similarity[at] = product[j]
                seen.add(q)
                yield q, similarity
    for q in range(len(questions)):
        if q not in seen:
            yield q, np.zeros(len(vectors))


def lexical(questions: DataFrame, chunks: DataFrame, k: int = POOL) -> DataFrame:
    """q_id, chunk_id, lexical_rank, l_rank: 0.1 for each position of a chunk that holds a term of the question.

    Blocks of texts, dealt by chunk, meet blocks of questions: a block's words are cut and counted once and scored for all its questions at once, so what is
    shuffled afterwards is k rows a question and block, not a row for each pair or for each word.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    asked = questions.where("scope is not null").groupBy("q_id", "scope").agg(F.array_distinct(F.flatten(F.collect_list(T.terms(F.col("text"))))).alias("terms"))
    # aliases: questions may have been derived from the chunks
    texts = chunks.select(F.col("scope").alias("scope"), F.col("chunk_id").alias("chunk_id"), F.lower("content").alias("content"))
    size = chunks.agg(F.coalesce(F.sum(F.octet_length("content")), F.lit(0))).first()[0]
    blocks, q_blocks = max(4 * texts.sparkSession.sparkContext.defaultParallelism, -(-size // BYTES)), max(1, -(-asked.count() // QUESTIONS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    number = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    keys = ["part", "q_part"]
    texts = dealt(texts.withColumn("part", number("chunk_id", blocks)).withColumn("q_part", each(q_blocks)), TEXTS, *keys)
    asked = asked.withColumn("q_part", number("q_id", q_blocks)).withColumn("part", each(blocks))
    schema = StructType([questions.schema["q_id"], chunks.schema["chunk_id"], StructField("n", LongType())])
    out = to_arrow_schema(schema)

    def best(texts_: pa.Table, asked_: pa.Table) -> pa.Table:
        if not texts_.num_rows or not asked_.num_rows:
            return out.empty_table()
        ids, of = asked_["q_id"].combine_chunks(), asked_["scope"].combine_chunks().dictionary_encode()
        terms = pc.list_flatten(asked_["terms"]).combine_chunks().dictionary_encode()
        ends = np.cumsum(pc.list_value_length(asked_["terms"]).to_numpy())
        lists = np.split(terms.indices.to_numpy(), ends[:-1])  # of each row of a question and a scope
        rows_of: dict[int, list[int]] = {}
        for row, q in enumerate(ids.dictionary_encode("encode").indices.to_pylist()):
            rows_of.setdefault(q, []).append(row)
        t = texts_.take(pc.sort_indices(texts_["chunk_id"], null_placement="at_start"))  # of equal counts the smaller id stands first
        chunk_ids = t["chunk_id"].combine_chunks().dictionary_encode("encode")
        words, at = cut([x or b"" for x in t["content"].cast(pa.binary()).to_pylist()])
        term = pc.fill_null(pc.index_in(words, value_set=terms.dictionary), -1).to_numpy()
        scope = pc.fill_null(pc.index_in(t["scope"].combine_chunks(), value_set=of.dictionary), -1).to_numpy()[at]
        hit = (term >= 0) & (scope >= 0)
        term, scope, chunk = term[hit], scope[hit], chunk_ids.indices.to_numpy()[at[hit]]
        present, term = np.unique(term, return_inverse=True)
        row_of = np.full(len(terms.dictionary), -1)
        row_of[present] = np.arange(len(present))
        lists = [r[r >= 0] for r in (row_of[x] for x in lists)]
        scopes = of.indices.to_numpy()
        q_rows, columns, values = [], [], []
        step = max(1, CELLS // max(1, len(present)))  # chunks whose counts stand in memory
        for begin in range(0, len(chunk_ids.dictionary), step):
            inside = (chunk >= begin) & (chunk < begin + step)
            counts = {}
            for s in np.unique(scope[inside]).tolist():
                mine = inside & (scope == s)
                held, column = np.unique(chunk[mine], return_inverse=True)
                counts[s] = held - begin, np.bincount(term[mine] * len(held) + column, minlength=len(present) * len(held)).reshape(len(present), -1)
            for rows in rows_of.values():
                total = np.zeros(min(step, len(chunk_ids.dictionary) - begin), np.int64)
                for row in rows:
                    if scopes[row] in counts and len(lists[row]):
                        held, table = counts[scopes[row]]
                        total[held] += table[lists[row]].sum(axis=0)
                near = np.flatnonzero(total)
                if len(near) > k:
                    near = near[total[near] >= np.partition(total[near], -k)[-k]]
                near = near[np.argsort(-total[near], kind="stable")[:k]]
                q_rows += [rows[0]] * len(near)
                columns.append(near + begin)
                values.append(total[near])
        if not q_rows:
            return out.empty_table()
        return pa.Table.from_arrays([ids.take(pa.array(q_rows)), chunk_ids.dictionary.take(pa.array(np.concatenate(columns))), pa.array(np.concatenate(values))], schema=out)

    scored = texts.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(best, schema)
    return ranked(scored.select("q_id", "chunk_id", F.round(F.col("n") * F.lit(0.1), 6).alias("lexical_rank")), "lexical_rank", "l_rank", k)


def fuse(by_vector: DataFrame, by_words: DataFrame, k: int = RRF_K) -> DataFrame:
    """Full outer join of the channels with the sum of reciprocal ranks and the channel's name."""
    both = by_vector.join(by_words, ["q_id", "chunk_id"], "full_outer")
    part = lambda rank: F.coalesce(F.lit(1.0) / (F.lit(k) + F.col(rank)), F.lit(0.0))
    source = F.when(F.col("l_rank").isNull(), "vector").when(F.col("v_rank").isNull(), "lexical").otherwise("both")
    return both.withColumn("rrf", F.round(part("v_rank") + part("l_rank"), 8)).withColumn("source", source)


def pooled(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, pool: int = POOL, by_vector: DataFrame | None = None, by_words: DataFrame | None = None) -> DataFrame:
    """The best fused rows of each question with their similarity: that of the dense channel, worked out only for rows that words alone found; without a vector it is 0.

    by_vector and by_words: what the stored indexes found (vector_index.search, text_index.search); without them all of the scope is scanned.
    """
    by_vector = dense(questions, vectors) if by_vector is None else by_vector
    best = ranked(fuse(by_vector, lexical(questions, chunks) if by_words is None else by_words), "rrf", "rank", pool)
    words_only = best.where("similarity is null").select("q_id", "chunk_id")
    asked = questions.select("q_id", F.col("embedding").alias("q")).dropDuplicates(["q_id"])
    more = words_only.join(vectors.select("chunk_id", "embedding"), "chunk_id").join(asked, "q_id").select("q_id", "chunk_id", F.round(cosine(F.col("embedding"), F.col("q")), 6).alias("late"))
    return best.join(more, ["q_id", "chunk_id"], "left").withColumn("similarity", F.coalesce("similarity", "late", F.lit(0.0))).drop("late")


def retrieve(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, floor: float = FLOOR, top_k: int = TOP_K, **found: DataFrame) -> DataFrame:
    """Fuse, pool, gate on similarity, cut. questions: a row for each scope that a question may search; found: by_vector and by_words of pooled()."""
    scored = pooled(questions, chunks, vectors, **found).where(F.col("similarity") >= floor).drop("rank")
    return ranked(scored, "rrf", "rank", top_k).select("q_id", "rank", "chunk_id", "similarity", "rrf", "source")


def retrieve_sections(
    questions: DataFrame, chunks: DataFrame, vectors: DataFrame, reranker: Callable[[DataFrame], DataFrame], places: DataFrame, floor: float = FLOOR, top_k: int = TOP_K, candidates: int | None = POOL, most_tokens: int = 3 * 512, evidence: bool = False
) -> DataFrame:
    """The whole chain: fuse, pool, rerank, gate, parents, cut. questions: a row for each scope that a question may search.

    A channel offers more rows the more scopes a question has, and at least the pool's if that is wider than the answer (rules.channel_size).
    reranker adds score to the pool's rows (q_id, chunk_id, …): a question with any missing score keeps the fused order. places (chunk_id, doc_id, chunk_index, section, token_count): two or more
    admitted chunks of one run of a section become one row, if the run has no more than most_tokens. An empty scope has no rows. With `evidence`, places has what
    sections.with_evidence() reads, and rows have content, kind, heading, member_ids and boxes.
    """
    from . import sections as S

    pool = pool_size(top_k, candidates)
    bases = questions.groupBy("q_id").agg(F.count("*").alias("bases")).withColumn("offered", channel_size(F.col("bases"), top_k, pool)).select("q_id", "offered")
    widest = bases.agg(F.max("offered")).first()[0] or pool
    own = lambda found, rank: found.join(bases, "q_id").where(F.col(rank) <= F.col("offered")).drop("offered")
    by_vector, by_words = own(dense(questions, vectors, widest), "v_rank"), own(lexical(questions, chunks, widest), "l_rank")
    rows = rerank(reranker(pooled(questions, chunks, vectors, pool, by_vector, by_words)))
    admitted = rows.where(F.col("similarity") >= floor).drop("rank").withColumnRenamed("new_rank", "rank").join(places.select("chunk_id", "doc_id", "chunk_index"), "chunk_id")
    whole = S.parents(admitted.select("q_id", "rank", "chunk_id", "doc_id", "chunk_index", "similarity"), places, most_tokens)
    cut = whole.withColumn("place", F.row_number().over(Window.partitionBy("q_id").orderBy("rank"))).where(F.col("place") <= top_k)
    found = ["q_id", "place", "chunk_id", "similarity", "members"]
    if evidence:
        cut, found = S.with_evidence(cut, places), [*found, "content", "kind", "heading", "member_ids", "boxes"]
    return cut.join(places.select("doc_id", "chunk_index", "chunk_id"), ["doc_id", "chunk_index"]).select(*found)


def rerank(pool: DataFrame, score: str = "score") -> DataFrame:
    """Rows of each question by score, then by their former rank; a question with any missing score keeps its order."""
    whole = F.count(score).over(Window.partitionBy("q_id")) == F.count("*").over(Window.partitionBy("q_id"))
    order = Window.partitionBy("q_id").orderBy(F.col("_score").desc(), "rank")
    return pool.withColumn("_score", F.when(whole, F.col(score)).otherwise(F.lit(0.0))).withColumn("new_rank", F.row_number().over(order)).drop("_score")


def accumulate(searches: DataFrame) -> DataFrame:
    """Passages of several searches once each: the largest similarity and the first search that found it."""
    return searches.groupBy("q_id", "chunk_id").agg(F.max("similarity").alias("similarity"), F.min("search").alias("first_search"))


def accumulate_parents(found: DataFrame) -> DataFrame:
    """found (q_id, chunk_id, similarity, member_ids: a parent's chunks, null or empty for a chunk alone) of several searches, each evidence once: a parent takes in its
    members, whichever search found them; what is left has the largest similarity that any of it was seen with, best first (place). A parent has the id of its first chunk,
    which may also come alone, so the two are told apart."""
    rows = found.withColumn("parent", F.coalesce(F.size("member_ids") > 0, F.lit(False)))
    inside = rows.where("parent").select("q_id", F.explode("member_ids").alias("chunk_id"), F.col("chunk_id").alias("in_")).groupBy("q_id", "chunk_id").agg(F.min("in_").alias("in_"))
    rows = rows.join(inside, ["q_id", "chunk_id"], "left").withColumn("of", F.when(F.col("parent"), F.col("chunk_id")).otherwise(F.col("in_")))
    key = F.struct(F.col("of").isNotNull().alias("parent"), F.coalesce("of", "chunk_id").alias("id"))
    whole = rows.groupBy("q_id", key.alias("key")).agg(F.max("similarity").alias("similarity"), F.count("*").alias("seen"), F.max_by("member_ids", F.when(F.col("parent"), F.col("similarity"))).alias("member_ids"))
    out = whole.select("q_id", F.col("key.id").alias("chunk_id"), F.col("key.parent").alias("parent"), "similarity", "seen", "member_ids")
    return out.withColumn("place", F.row_number().over(Window.partitionBy("q_id").orderBy(F.col("similarity").desc(), "chunk_id", "parent")))


def generation_similarity(pairs: DataFrame, embeddings: DataFrame, generation: str) -> DataFrame:
    """pairs (q_id, chunk_id, q: a vector) with their cosine similarity in one generation of embeddings (generation_id, chunk_id, embedding); 0 for chunks that it lacks."""
    mine = embeddings.where(F.col("generation_id") == generation).select("chunk_id", "embedding")
    return pairs.join(mine, "chunk_id", "left").select("q_id", "chunk_id", F.round(F.coalesce(cosine(F.col("embedding"), F.col("q")), F.lit(0.0)), 6).alias("similarity"))


def effective_floor(searches: Column, base: float = FLOOR, step: float = 0.02) -> Column:
    return F.round(F.lit(base) + F.lit(step) * F.greatest(F.lit(0), searches - 1), 6)
