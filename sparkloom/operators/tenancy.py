"""Documents, chunks, files, knowledge bases, users and runs: joins, listings, guards, control tables.

All joins are declared; Catalyst picks their kind by size. Null keys match nothing. Empty tables give empty results (counts: 0).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R
from ..sources.shared import dealt, forget, stored, together


def with_documents(fused: DataFrame, chunks: DataFrame, documents: DataFrame, files: DataFrame) -> DataFrame:
    """fused (q_id, rank, chunk_id) with the chunk's document, title and, for documents without pages, the unit "section". A document's file may be
    missing, a chunk or document may not."""
    rows = fused.join(chunks.select("chunk_id", "document_id"), "chunk_id").join(documents.select("document_id", "title", "file_id"), "document_id")
    return rows.join(files.select("file_id", "mime"), "file_id", "left").select("q_id", "rank", "chunk_id", "document_id", "title", R.section_unit(F.col("mime")).alias("unit"))


def listed(documents: DataFrame, bases: DataFrame, files: DataFrame) -> DataFrame:
    """Ready documents with their knowledge base's name and MIME type, by both names without regard to case."""
    ready = documents.where(F.col("status") == "ready")
    rows = ready.join(bases.select("base_id", F.col("name").alias("base")), "base_id").join(files.select("file_id", "mime"), "file_id", "left")
    return rows.select("document_id", "base", "title", "mime").orderBy(F.lower("base"), F.lower("title"), "document_id")


def citation(chunks: DataFrame, documents: DataFrame, files: DataFrame, owner) -> DataFrame:
    """What a citation of an owner's chunk opens."""
    rows = chunks.join(documents.where(F.col("owner_id") == owner), "document_id").join(files, "file_id", "left")
    return rows.select("chunk_id", "document_id", "title", "page", F.coalesce("mime", F.lit("application/pdf")).alias("mime"))


def nested(parents: DataFrame, links: DataFrame, children: DataFrame, parent: str, child: str, name: str) -> DataFrame:
    """Each parent with the sorted names of its children; none gives an empty list."""
    of = links.join(children, child).groupBy(parent).agg(F.array_sort(F.collect_set(name)).alias("names"))
    return parents.join(of, parent, "left").select(parent, F.coalesce("names", F.array().cast("array<string>")).alias("names"))


def back_filled(rows: DataFrame, parents: DataFrame, key: str, column: str) -> DataFrame:
    """rows whose null column takes the parent's value."""
    return rows.join(parents.select(key, F.col(column).alias("_new")), key, "left").withColumn(column, F.coalesce(column, "_new")).drop("_new")


def scope_links(conversations: DataFrame, bases: DataFrame, owner: str) -> DataFrame:
    """(conv_id, base_id) of every conversation and each base of its owner, once."""
    return conversations.join(bases, owner).select("conv_id", "base_id").dropDuplicates()


def permitted(asked: DataFrame, owned: DataFrame, requested: DataFrame) -> DataFrame:
    """(q_id, base_id) that each question (q_id, owner_id) may search: what it requests of the owner's bases, all of them where it requests none at all.
    requested: q_id, base_id; a request for another's base gives nothing, not everything."""
    own = asked.join(owned, "owner_id").select("q_id", "base_id")
    named = own.join(requested.distinct(), ["q_id", "base_id"], "left_semi")
    return named.unionByName(own.join(requested.select("q_id").distinct(), "q_id", "left_anti"))


def stored_scope(conversations: DataFrame, bridge: DataFrame, owned: DataFrame) -> DataFrame:
    """(conv_id, base_id) of the bases that a conversation (conv_id, owner_id) was given (bridge: conv_id, base_id) and its owner still has."""
    return conversations.join(bridge.distinct(), "conv_id").join(owned, ["owner_id", "base_id"], "left_semi").select("conv_id", "base_id")


def outline(chunks: DataFrame, owner, bases: list) -> DataFrame:
    """chunk_id, document_id, chunk_index, page, heading of an owner's chunks in these bases: places only, the texts aren't read."""
    return chunks.where((F.col("owner_id") == owner) & F.col("base_id").isin(bases)).select("chunk_id", "document_id", "chunk_index", "page", "heading")


def attached(values: DataFrame, chunks: DataFrame, present: DataFrame) -> DataFrame:
    """New vectors with the owner and base of their chunk; those of unknown chunks, and those that are there already, are left out. Running it again adds nothing."""
    new = values.join(present.select("chunk_id"), "chunk_id", "left_anti").dropDuplicates(["chunk_id"])
    return new.join(chunks.select("chunk_id", "owner_id", "base_id"), "chunk_id")


def activation(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: chunks, those without a vector, and whether the generation may be activated."""
    missing = chunks.join(vectors.select("chunk_id"), "chunk_id", "left_anti").agg(F.count("*").alias("missing"))
    # both sides are one row
    return chunks.agg(F.count("*").alias("total")).crossJoin(missing).withColumn("ready", (F.col("missing") == 0) & (F.col("total") > 0))


def section_pages(chunks: DataFrame, wanted: DataFrame) -> DataFrame:
    """The chunks of the wanted (document_id, page) pairs in reading order."""
    return chunks.join(wanted.select("document_id", "page"), ["document_id", "page"], "left_semi").orderBy("document_id", "page", "chunk_index")


def chosen(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Chunks that were picked, in reading order; their similarity counts as 1."""
    return chunks.join(ids.select("document_id", "chunk_index"), ["document_id", "chunk_index"], "left_semi").withColumn("similarity", F.lit(1.0)).orderBy("document_id", "chunk_index")


def partially_indexed(exhausted: Column, outcomes: Column, indexed: Column) -> Column:
    """Some page of a document isn't searchable; without a record (null outcomes) that isn't known and counts as no."""
    return F.when(outcomes.isNull(), F.lit(False)).otherwise(F.coalesce(exhausted, F.lit(False)) | F.exists(outcomes, lambda x: x == "failed") | (indexed < F.size(outcomes)))


def newest(rows: DataFrame, when: str, key: str, n: int, most: int = 200) -> DataFrame:
    """The n newest rows (at least one, at most `most`), ties by key."""
    return rows.orderBy(F.col(when).desc(), F.col(key).desc()).limit(max(1, min(most, n)))


def latest(rows: DataFrame, key: list[str], version: str) -> DataFrame:
    """The last version of each key."""
    order = Window.partitionBy(*key).orderBy(F.col(version).desc())
    return rows.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """What is left of a child table when the parents in gone are deleted."""
    return rows.join(gone.select(key), key, "left_anti")


def differences(listed_: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Keys that only one side has, and which."""
    one = listed_.select(key).distinct().join(there.select(key), key, "left_anti").withColumn("side", F.lit("listed"))
    return one.unionAll(there.select(key).distinct().join(listed_.select(key), key, "left_anti").withColumn("side", F.lit("there")))


def run_detail(runs: DataFrame, spans: DataFrame, prices: DataFrame) -> DataFrame:
    """Each run with its spans in key order and what its tokens cost, in dollars per million; null where no token has a price."""
    priced = spans.join(prices, "model", "left")
    of = priced.groupBy("run_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("key", "step"))), lambda x: x["step"]), ",").alias("steps"), F.round(F.sum(F.col("tokens") * F.col("price") / 1e6), 9).alias("usd"))
    return runs.join(of, "run_id", "left")


def span_tree(spans: DataFrame) -> DataFrame:
    """run_id, key, depth, path: spans below their parents, children by key. A span without a parent in its run is a root; spans that are each other's parents hang
    on no root and have no row. A level a step, each written before the next, so neither rows nor levels are limited."""
    above = spans.select("run_id", F.col("key").alias("parent_key"), F.col("key").alias("parent"))
    rows = stored(spans.select("run_id", "key", "parent_key").join(above, ["run_id", "parent_key"], "left").select("run_id", "key", "parent"), "span-parents")
    level = stored(rows.where("parent is null").select("run_id", "key", F.lit(0).alias("depth"), F.col("key").cast("string").alias("path")), "span-level")
    below = rows.where("parent is not null")
    levels = [level]
    while True:
        up = level.select("run_id", F.col("key").alias("parent"), "depth", "path")
        next_ = below.join(up, ["run_id", "parent"]).select("run_id", "key", (F.col("depth") + 1).alias("depth"), F.concat("path", F.lit("/"), F.col("key").cast("string")).alias("path"))
        level = stored(next_, "span-level")
        if level.isEmpty():
            break
        levels.append(level)
    forget(rows, level)
    return together(levels)


def annotated(calls: DataFrame) -> DataFrame:
    """Of the calls of each span: tokens add up (null if none told any), the last model that was told stays."""
    last = F.max_by("model", F.when(F.col("model").isNotNull(), F.col("at")))
    return calls.groupBy("run_id", "key").agg(F.sum("tokens").alias("tokens"), last.alias("model"))


def ingestion_kpis(documents: DataFrame) -> DataFrame:
    """Documents by state, and pages and chunks of the ready ones; 0 where there are none."""
    of = lambda state: F.count(F.when(F.col("status") == state, 1)).alias(state)
    ready = lambda c: F.coalesce(F.sum(F.when(F.col("status") == "ready", F.col(c))), F.lit(0)).alias(c)
    return documents.agg(F.count("*").alias("documents"), of("ready"), of("failed"), of("processing"), ready("pages"), ready("chunks"))


def stranded(documents: DataFrame, now: Column, minutes: int = 10, attempts: int = 3) -> DataFrame:
    """Work that nobody holds any more: in progress with a lease that has run out, and tried too seldom to be given up."""
    return documents.where((F.col("status") == "processing") & (F.col("leased_at") < now - F.expr(f"INTERVAL {minutes} MINUTES")) & (F.col("attempts") < attempts))


def stored_citations(retrieved: DataFrame) -> DataFrame:
    """q_id, index (from 1), chunk and page of what was retrieved, similarities to four decimals."""
    order = Window.partitionBy("q_id").orderBy("rank")
    return retrieved.select("q_id", F.row_number().over(order).alias("index"), "chunk_id", "document_id", "page", F.round("similarity", 4).alias("similarity"))


def citation_groups(citations: DataFrame) -> DataFrame:
    """One row a page of a document, by the first citation of it, with the numbers of all its citations."""
    rows = citations.groupBy("q_id", "document_id", F.coalesce("unit", F.lit("page")).alias("unit"), "page").agg(F.array_sort(F.collect_list("index")).alias("numbers"), F.min("index").alias("first"))
    order = Window.partitionBy("q_id").orderBy("first")
    return rows.select("q_id", F.row_number().over(order).alias("place"), "document_id", "unit", "page", F.array_join(F.col("numbers").cast("array<string>"), ",").alias("numbers"))


#: Characters of a title that a question must hold before whole titles are compared with it; questions of a task.
HEAD, QUESTIONS = 8, 50_000


def named(questions: DataFrame, documents: DataFrame, head: int = HEAD) -> DataFrame:
    """q_id, document_id of the questions (q_id, text) that name a title: the longest if several, of equal titles and lengths the smallest document_id.

    Equal titles are one before anything is joined. A question meets titles by equality only: where it holds the first `head` characters of titles, it is cut to
    the lengths of those titles, and what that gives is joined with the titles. So the rows grow with the questions' characters and with the lengths that titles
    have, whatever the number of titles. Titles of under three characters name nothing.
    """
    titled = documents.select("document_id", R.title_key(F.col("title")).alias("t")).where(F.length("t") >= 3)
    titled = stored(titled.groupBy("t").agg(F.min("document_id").alias("document_id")), "titles")
    begins = titled.select(F.substring("t", 1, head).alias("head"), F.length("t").alias("size")).distinct()
    # shorter titles are heads of their own size: `head` sizes at most
    sizes = [(r.of, r.longest) for r in titled.groupBy(F.least(F.length("t"), F.lit(head)).alias("of")).agg(F.max(F.length("t")).alias("longest")).collect()]
    longest = max((n for _, n in sizes), default=head)
    asked = questions.select("q_id", R.title_key(F.col("text")).alias("q")).where(F.length("q") >= 3)
    rest = asked.select("q_id", "q", F.explode(F.sequence(F.lit(1), F.length("q"))).alias("at")).select("q_id", F.col("q").substr(F.col("at"), F.lit(longest)).alias("rest"))
    starts = rest.select("q_id", "rest", F.explode(F.array(*(F.lit(n) for n, _ in sizes)).cast("array<int>")).alias("of")).where(F.length("rest") >= F.col("of"))
    found = starts.withColumn("head", F.col("rest").substr(F.lit(1), F.col("of"))).join(begins, "head").where(F.length("rest") >= F.col("size"))
    best = found.select("q_id", F.col("rest").substr(F.lit(1), F.col("size")).alias("t")).join(titled, "t")
    return best.groupBy("q_id").agg(F.min_by("document_id", F.struct(-F.length("t"), "document_id")).alias("document_id"))


def mentioned(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """questions (q_id, text) with the document whose title they name, null if none."""
    questions = dealt(questions, QUESTIONS, "q_id")
    return questions.join(named(questions, documents), "q_id", "left")


def scope(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """How each question is read: a whole document (named, or the only one there is) or a search."""
    only = documents.agg(F.count("*").alias("_n"), F.min("document_id").alias("_only"))
    questions = dealt(questions, QUESTIONS, "q_id").withColumn("_whole", R.wants_document(F.col("text")))
    # only a question that asks for a whole document depends on what it names
    rows = questions.join(named(questions.where("_whole"), documents), "q_id", "left").crossJoin(only)  # one row
    whole = F.col("_whole")
    reason = F.when(whole & F.col("document_id").isNotNull(), "named").when(whole & (F.col("_n") == 1), "only-document")
    return rows.select("q_id", F.when(reason.isNull(), "search").otherwise("document").alias("mode"), reason.alias("reason"), F.when(reason == "named", F.col("document_id")).when(reason == "only-document", F.col("_only")).alias("document_id"))


def evidence_route(questions: DataFrame, scoped: DataFrame) -> DataFrame:
    """The branch that answers each question: none in scope, a list, a planner, a whole document, or a search. questions: q_id, text, turns, bases."""
    rows = questions.join(scoped.select("q_id", "mode"), "q_id")
    route = (
        F.when(F.col("bases") == 0, "no-scope").when(R.turn_route(F.col("text")) == "answer-directly", "direct").when(R.wants_list(F.col("text")), "list").when(F.col("mode") == "document", "whole-document").when(R.plan_reason(F.col("text"), F.col("turns")) != "standalone", "planner").otherwise("search")
    )
    return rows.select("q_id", route.alias("route"))
