"""Tables that change: replaced, upserted, pruned and moved rows, checks of control tables, page caches, and how tables are laid out.

A change is the whole new table, so that running it again gives the same one; write_replacing puts only the partitions that changed in place.
Null keys match nothing: such stored rows stay, such incoming rows are added. Empty tables are changed like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .tenancy import latest, without


def replaced(stored: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """All rows of a key that comes in give way to the rows that come: a document's chunks, say. Other keys stay."""
    return without(stored, incoming.select(key).distinct(), key).unionByName(incoming)


def inserted(stored: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that come in are added unless their keys are there; of those that come twice one is added. Running it again adds nothing."""
    return stored.unionByName(incoming.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def upserted(stored: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The newest row of each key, of those stored and those that come in."""
    return latest(stored.unionByName(incoming), keys, version)


def cache_misses(wanted: DataFrame, cached: DataFrame, keys: list[str]) -> DataFrame:
    """Wanted keys that the cache lacks, each once; another render scale is another key."""
    return wanted.select(*keys).dropDuplicates().join(cached.select(*keys), keys, "left_anti")


def retained(rows: DataFrame, when: str, now: Column, days: int) -> DataFrame:
    """Rows no older than so many days before now; rows without a time stay. The condition reaches the scan."""
    return rows.where(F.col(when).isNull() | (F.col(when) >= now - F.expr(f"INTERVAL {int(days)} DAYS")))


def moved(rows: DataFrame, moves: DataFrame, key: str, column: str) -> DataFrame:
    """rows with a new value of column where moves (key, column) names their key; of two moves of a key the larger value counts."""
    to = moves.groupBy(key).agg(F.max(column).alias("_to"))
    return rows.join(to, key, "left").withColumn(column, F.coalesce("_to", column)).drop("_to")


def base_deleted(base: Column, bases: DataFrame, documents: DataFrame, chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables without the bases for which the condition holds, their documents and the chunks of those."""
    gone = bases.where(base).select("base_id")
    lost = documents.join(gone, "base_id", "left_semi").select("document_id")
    return without(bases, gone, "base_id"), without(documents, lost, "document_id"), without(chunks, lost, "document_id")


def state_violations(control: DataFrame, key: str, states: list[str]) -> DataFrame:
    """(key, status, n) of every status of which a key may have one row and has more: two active generations, say."""
    return control.where(F.col("status").isin(states)).groupBy(key, "status").agg(F.count("*").alias("n")).where("n > 1")


def swapped(control: DataFrame, ready: DataFrame) -> DataFrame:
    """control (owner_id, generation_id, status) after the activation of the building generations in ready (generation_id): these become active,
    the active ones of the same owner retired."""
    new = control.where("status = 'building'").join(ready.select("generation_id").distinct(), "generation_id", "left_semi").select("generation_id", F.lit(True).alias("_new"))
    rows = control.join(new, "generation_id", "left")
    takes = F.max("_new").over(Window.partitionBy("owner_id"))
    status = F.when(F.col("_new"), "active").when(takes & (F.col("status") == "active"), "retired").otherwise(F.col("status"))
    return rows.withColumn("status", status).select(*control.columns)


def reindexed(chunks: DataFrame, vectors: DataFrame, control: DataFrame, embed) -> tuple[DataFrame, DataFrame]:
    """One pass of a re-index: (vectors, control) after it.

    chunks: owner_id, chunk_id, text. vectors: owner_id, generation_id, chunk_id, embedding. control: owner_id, generation_id, status. Chunks that a building generation
    has no vector of are embedded (embed: text -> vector, null if it can't) and added; run again, it adds nothing. A building generation without a missing chunk
    becomes active and the owner's active one is retired; others stay as they are, and what is read goes on to be the active generation meanwhile.
    """
    building = control.where("status = 'building'").select("owner_id", "generation_id")
    every = chunks.join(building, "owner_id").select("owner_id", "generation_id", "chunk_id", "text")
    missing = every.join(vectors.select("generation_id", "chunk_id"), ["generation_id", "chunk_id"], "left_anti")
    made = missing.select("owner_id", "generation_id", "chunk_id", embed(F.col("text")).alias("embedding"))
    lacking = made.where("embedding is null").select("generation_id").distinct()
    ready = building.join(lacking, "generation_id", "left_anti").select("generation_id")
    return vectors.unionByName(made.where("embedding is not null")), swapped(control, ready)


def checked_vectors(vectors: DataFrame, dimensions: int, column: str = "embedding") -> DataFrame:
    """vectors; a row of another size fails the job. A null vector is of another size."""
    size = F.coalesce(F.size(column), F.lit(-1))
    fault = F.raise_error(F.concat(F.lit(f"a vector has {dimensions} dimensions, not "), size))
    return vectors.where(F.when(size == dimensions, True).otherwise(fault.cast("boolean")))


def completeness(documents: DataFrame, pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Per document: pages that failed and have no chunk, pages that did not fail and have none, whether the page budget ran out, and whether it is
    partially indexed for any of these. documents (document_id, exhausted), pages (document_id, page, outcome), chunks (document_id, page).

    A failed page with chunks was read from its text layer. A document without recorded pages is not partial by them; a null outcome did not fail.
    """
    there = chunks.select("document_id", "page").distinct().withColumn("_there", F.lit(True))
    bare = pages.join(there, ["document_id", "page"], "left").where(F.col("_there").isNull())
    failed = F.coalesce(F.col("outcome") == "failed", F.lit(False))
    counts = bare.groupBy("document_id").agg(F.count_if(failed).alias("unreadable"), F.count_if(~failed).alias("silent"))
    rows = documents.join(counts, "document_id", "left")
    unreadable, silent, exhausted = (F.coalesce(c, F.lit(x)) for c, x in (("unreadable", 0), ("silent", 0), ("exhausted", False)))
    return rows.select("document_id", unreadable.alias("unreadable"), silent.alias("silent"), exhausted.alias("exhausted"), ((unreadable + silent > 0) | exhausted).alias("partial"))


def budgeted(pages: DataFrame, budget: int) -> DataFrame:
    """pages (document_id, page, route, cached) with how each is read: "text" ones from their text layer, cached ones from the cache, others by the parser
    until the document's budget of parser calls is spent, in page order, then from the text layer too ("over-budget"). A null cached is false."""
    by_parser = (F.col("route") != "text") & ~F.coalesce("cached", F.lit(False))
    calls = F.count_if(by_parser).over(Window.partitionBy("document_id").orderBy("page").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    reading = F.when(F.col("route") == "text", "text").when(~by_parser, "cached").when(calls <= budget, "parsed").otherwise("over-budget")
    return pages.select("document_id", "page", reading.alias("reading"))


def figures(wanted: DataFrame, chunks: DataFrame, documents: DataFrame, files: DataFrame) -> DataFrame:
    """The figures among wanted (chunk_id, owner_id, base_id: a scope the asker may read), with their document and file. Chunks of other kinds, without a box,
    outside that scope, or whose file is gone give no row."""
    rows = chunks.where((F.col("kind") == "figure") & F.col("bbox").isNotNull()).join(wanted.distinct(), ["chunk_id", "owner_id", "base_id"], "left_semi")
    rows = rows.join(documents.select("document_id", "title", "file_id"), "document_id").join(files.select("file_id", "bucket_key"), "file_id")
    return rows.select("chunk_id", "document_id", "title", "page", "bucket_key", "content")


def read_figures(rows: DataFrame, readings: DataFrame) -> DataFrame:
    """rows (chunk_id, kind, content): a figure that was read carries its label and, in the order of the readings (chunk_id, n, question, text), what was asked and seen."""
    part = F.struct("n", F.concat(F.lit("Asked: "), "question", F.lit("\nSeen: "), "text").alias("said"))
    read = readings.groupBy("chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda x: x["said"]), "\n\n").alias("_read"))
    label = F.trim(F.regexp_replace("content", r"\s+", " "))
    note = F.concat(F.lit("[Read by a vision model; not the document's own text.]\nFigure label: "), label, F.lit("\n"), "_read")
    seen = (F.col("kind") == "figure") & F.col("_read").isNotNull()
    return rows.join(read, "chunk_id", "left").withColumn("content", F.when(seen, note).otherwise(F.col("content"))).drop("_read")


def fallback_results(found: DataFrame, yardstick: DataFrame) -> DataFrame:
    """Results of searches without a planner: found (q_id, search, chunk_id, similarity), search 0 for the question as it stands, later ones with the
    turn before it; yardstick (q_id, chunk_id, similarity) for that turn alone.

    The first search's chunks are all kept; one that a later search adds is kept if it is nearer to that search than to the turn before alone.
    A chunk comes once, with its largest similarity. Null similarities of later searches beat nothing but a missing yardstick.
    """
    literal = found.where("search = 0").select("q_id", "chunk_id").distinct().withColumn("_literal", F.lit(True))
    yard = yardstick.groupBy("q_id", "chunk_id").agg(F.max("similarity").alias("_yard"))
    rows = found.join(literal, ["q_id", "chunk_id"], "left").join(yard, ["q_id", "chunk_id"], "left")
    kept = rows.where(F.col("_literal").isNotNull() | F.col("_yard").isNull() | (F.col("similarity") > F.col("_yard")))
    return kept.groupBy("q_id", "chunk_id").agg(F.max("similarity").alias("similarity"))


SEARCHES, MILLISECONDS, TOKENS = 3, 15_000, 8_000


def replayed(steps: DataFrame) -> DataFrame:
    """Recorded planner steps (run_id, at, action, ms, tokens) taken until one ends the run or a budget is spent: searches, time or tokens before
    the step, in that order. Per run: the steps that were taken, searches, and why it ended ("steps-done" if the record ends first).

    A run's steps are few by the budgets, but a record may hold more: they stream past in order, none is gathered.
    """
    before = Window.partitionBy("run_id").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    spent = {
        "search-budget": F.coalesce(F.count_if(F.col("action") == "search").over(before), F.lit(0)) >= SEARCHES,
        "time-budget": F.coalesce(F.sum("ms").over(before), F.lit(0)) >= MILLISECONDS,
        "token-budget": F.coalesce(F.sum("tokens").over(before), F.lit(0)) >= TOKENS,
    }
    end = F.when(F.col("action").isin("answer", "refuse"), F.col("action"))
    for why, over in reversed(spent.items()):
        end = F.when(over, why).otherwise(end)
    rows = steps.withColumn("_end", end).withColumn("_ended", F.coalesce(F.max(F.col("_end").isNotNull()).over(before), F.lit(False))).where(~F.col("_ended"))
    taken = F.col("_end").isNull() | F.col("_end").isin("answer", "refuse")
    return rows.groupBy("run_id").agg(F.count_if(taken).alias("steps"), F.count_if(taken & (F.col("action") == "search")).alias("searches"), F.coalesce(F.max("_end"), F.lit("steps-done")).alias("termination"))


def filtered_logs(logs: DataFrame, levels: list[str], categories: list[str], request: str | None, words: str | None) -> DataFrame:
    """Log rows by every filter that is given; an empty one lets all rows through. words: in the message or the details, case aside, % and _ for themselves."""
    rows = logs
    for column, some in (("level", levels), ("category", categories)):
        rows = rows.where(F.col(column).isin(some)) if some else rows
    rows = rows.where(F.col("request_id") == request) if request else rows
    low = F.lower(F.lit(words or ""))
    return rows.where(F.contains(F.lower("message"), low) | F.contains(F.lower("meta"), low)) if words else rows


def write_replacing(rows: DataFrame, path: str, partitions: list[str], order: list[str]) -> None:
    """Writes rows as Parquet in folders by the partition columns, sorted in files so that footers' ranges prune scans by the leading order column.
    Only the partitions that rows holds are replaced. A partition is spread by the order columns' hash over as many files as AQE finds it needs."""
    spread = rows.repartition(*partitions, *order[:1]).sortWithinPartitions(*partitions, *order)
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)
