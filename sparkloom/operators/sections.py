"""Sections of a document's chunks, whole-document sampling, parents, conversation windows, page geometry."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import dealt

#: Chunks that one task sorts.
ROWS = 500_000


def section_runs(chunks: DataFrame, key: str = "section") -> DataFrame:
    """chunks (doc_id, chunk_index, key, and page and kind where there are) with run: a new one begins whenever the key or the page changes in chunk order.
    Figures are in no run (null) and part none."""
    page = F.col("page") if "page" in chunks.columns else F.lit(0)
    text = F.col("kind").eqNullSafe("figure") == F.lit(False) if "kind" in chunks.columns else F.lit(True)
    # figures are ordered by themselves, so that the rows around one are neighbours
    order = Window.partitionBy("doc_id", "_text").orderBy("chunk_index")
    rows = dealt(chunks, ROWS, "doc_id").withColumn("_text", text).withColumn("_key", F.struct(page, F.col(key)))
    rows = rows.withColumn("_new", F.when(F.col("_key").eqNullSafe(F.lag("_key").over(order)), 0).otherwise(1))
    return rows.withColumn("run", F.when(F.col("_text"), F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_new", "_key", "_text")


def choose_chunks(chunks: DataFrame, most: int = 8) -> DataFrame:
    """Up to `most` chunks of each document: all if they fit; the first of evenly spread sections if there are more sections than
    places; else sections take turns, deeper chunk by deeper chunk."""
    runs = section_runs(chunks)
    doc, run = Window.partitionBy("doc_id"), Window.partitionBy("doc_id", "run").orderBy("chunk_index")
    runs = runs.withColumn("depth", F.row_number().over(run)).withColumn("sections", F.max("run").over(doc)).withColumn("total", F.count("*").over(doc))
    turn = F.row_number().over(Window.partitionBy("doc_id").orderBy("depth", "run"))
    # section number (0-based) r is picked if some place p has round(p * last / (most - 1)) = r
    last = F.col("sections") - 1
    places = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda p: F.floor(p * last / F.lit(float(most - 1)) + F.lit(0.5)))
    spread = (F.col("depth") == 1) & F.array_contains(places, (F.col("run") - 1).cast("long"))
    runs = runs.withColumn("turn", turn)
    keep = F.when(F.col("total") <= most, F.lit(True)).when(F.col("sections") > most, spread).otherwise(F.col("turn") <= most)
    return runs.where(keep).select("doc_id", "chunk_index", "run")


def parents(admitted: DataFrame, chunks: DataFrame, most_tokens: int) -> DataFrame:
    """admitted (q_id, rank, chunk_id, doc_id, chunk_index, similarity): runs of a section with two or more admitted chunks and no more than most_tokens
    become one row (parent) at their best rank, with the first chunk's index, the largest similarity and how many were admitted; other rows, figures too,
    stay alone."""
    runs = section_runs(chunks)
    run_of = runs.select("doc_id", "chunk_index", "run")
    whole = runs.groupBy("doc_id", "run").agg(F.sum("token_count").alias("tokens"), F.min("chunk_index").alias("first_index"))
    hits = admitted.join(run_of, ["doc_id", "chunk_index"]).join(whole, ["doc_id", "run"], "left")
    grouped = Window.partitionBy("q_id", "doc_id", "run")
    parent = F.col("run").isNotNull() & (F.count("*").over(grouped) >= 2) & (F.col("tokens") <= most_tokens)
    hits = hits.withColumn("parent", F.coalesce(parent, F.lit(False))).withColumn("one", F.when(~F.col("parent"), F.col("chunk_index")))
    return hits.groupBy("q_id", "doc_id", "run", "parent", "one").agg(
        F.min("rank").alias("rank"), F.max("similarity").alias("similarity"), F.count("*").alias("members"), F.min(F.when(F.col("parent"), F.col("first_index")).otherwise(F.col("chunk_index"))).alias("chunk_index")
    ).drop("one")


def assemble_parents(admitted: DataFrame, chunks: DataFrame, most_tokens: int) -> DataFrame:
    return parents(admitted, chunks, most_tokens).drop("run", "parent")


def with_evidence(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """rows of parents() with what an answer is given and a citation shows: content (of a parent its whole run as one text), kind (ocr if any of it is),
    heading, member_ids (a parent's chunks in order, null for a row alone) and boxes, those of all its chunks one after the other, never their union.

    chunks: doc_id, chunk_index, chunk_id, section, page, kind, heading, content, boxes, bbox. Only the chunks of the rows' runs are read on; a parent's run
    has a bounded number of tokens.
    """
    from ..functions.rules import citation_boxes

    runs = section_runs(chunks)
    wanted = rows.select("doc_id", "chunk_index", "run", "parent").distinct()
    key = ["doc_id", F.coalesce("run", F.lit(-1)).alias("run"), F.when(F.col("parent"), F.lit(None)).otherwise(F.col("chunk_index")).alias("one")]
    of = wanted.select(*key, F.col("chunk_index").alias("at"))
    members = runs.withColumn("run", F.coalesce("run", F.lit(-1))).join(of, ["doc_id", "run"]).where(F.col("one").isNull() | (F.col("one") == F.col("chunk_index")))
    members = with_seams(members, ["doc_id", "run", "one"])
    e = F.struct("chunk_index", "chunk_id", "piece", F.coalesce(citation_boxes(F.col("boxes"), F.col("bbox")), F.array().cast(chunks.schema["boxes"].dataType)).alias("boxes"))
    said = members.groupBy("doc_id", "at", "one").agg(F.array_sort(F.collect_list(e)).alias("e"), F.max(F.col("kind") == "ocr").alias("ocr"), F.min_by("kind", "chunk_index").alias("kind"), F.min_by("heading", "chunk_index").alias("heading"))
    parent = F.col("one").isNull()
    said = said.select(
        "doc_id", F.col("at").alias("chunk_index"), parent.alias("parent"), F.array_join(F.col("e.piece"), "").alias("content"), F.when(~parent, F.col("kind")).when(F.col("ocr"), "ocr").otherwise("text").alias("kind"), "heading",
        F.when(parent, F.col("e.chunk_id")).alias("member_ids"), F.flatten("e.boxes").alias("boxes"),
    )
    return rows.join(said, ["doc_id", "chunk_index", "parent"])


def previous_user_turn(turns: DataFrame, most: int = 300) -> DataFrame:
    """Each user turn with the last user turn before it that has text, clipped."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    said = F.when((F.col("role") == "user") & (F.trim("text") != ""), F.substring(F.trim("text"), 1, most))
    return turns.withColumn("previous", F.last(said, ignorenulls=True).over(before)).where("role = 'user'").select("conv_id", "turn", "previous")


def last_turns(turns: DataFrame, n: int = 4) -> DataFrame:
    """How many turns stand in the window before each turn, and their roles."""
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(-n, -1)
    return turns.select("conv_id", "turn", F.array_join(F.collect_list("role").over(before), ",").alias("roles"))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (xmin, ymin, xmax, ymax); 0 where the union is empty."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    area = lambda x: F.greatest(F.lit(0.0), x["xmax"] - x["xmin"]) * F.greatest(F.lit(0.0), x["ymax"] - x["ymin"])
    common = side("xmin", "xmax") * side("ymin", "ymax")
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


PIECE = "\n\n"


def seam(previous: Column, content: Column) -> Column:
    """The text that a chunk repeats from the one before: the longest run of whole pieces at its end, never all of it, with which this one begins; null if there is none."""
    pieces = F.split(previous, PIECE)
    tails = F.transform(F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(pieces))), lambda k: F.array_join(F.slice(pieces, k, F.greatest(F.lit(0), F.size(pieces) - k + 1)), PIECE))
    return F.try_element_at(F.filter(tails, lambda t: (t != "") & F.startswith(content, F.concat(t, F.lit(PIECE)))), F.lit(1))


def with_seams(chunks: DataFrame, run: list[str]) -> DataFrame:
    """chunks with piece: what each adds to the text of its run; the pieces in order are the run's text."""
    previous = F.lag("content").over(Window.partitionBy(*run).orderBy("chunk_index"))
    rows = chunks.withColumn("_before", previous).withColumn("_seam", seam(F.col("_before"), F.col("content")))
    added = F.expr("substring(content, length(_seam) + 1)")
    first = F.row_number().over(Window.partitionBy(*run).orderBy("chunk_index")) == 1
    return rows.withColumn("piece", F.when(first, F.coalesce("content", F.lit(""))).when(F.col("_seam").isNotNull(), added).otherwise(F.concat(F.lit(PIECE), F.coalesce("content", F.lit(""))))).drop("_before", "_seam")


def merged_runs(chunks: DataFrame) -> DataFrame:
    """doc_id, run, content of the runs of chunks (doc_id, chunk_index, section, content), each as one text without what neighbours repeat. A null content is an empty one."""
    rows = with_seams(section_runs(chunks).where("run is not null"), ["doc_id", "run"])
    return rows.groupBy("doc_id", "run").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "piece"))), lambda x: x["piece"]), "").alias("content"))


def fixed_windows(hits: DataFrame, seconds: int, most: int) -> DataFrame:
    """hits (key, ts, id) with allowed: at most `most` in a window that begins with its first hit and lasts so many seconds.

    A window depends on the one before it, so each key's hits are read in order of time and id; they stream past, sorted on disk where
    they must be, with a window's begin and count as the only state. Hits without time are left out.
    """
    rows = hits.where("ts is not null").select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "id")
    kind, micros = dict(rows.dtypes)["key"], seconds * 1_000_000

    def run(batches):
        # a partition may hold several keys, one after the other
        last, begin, n = object(), 0, 0
        for batch in batches:
            allowed = []
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if key != last or t - begin >= micros:
                    last, begin, n = key, t, 0
                n += 1
                allowed.append(n <= most)
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(allowed, pa.bool_())], names=["key", "id", "allowed"])

    return rows.repartition("key").sortWithinPartitions("key", "t", "id").mapInArrow(run, f"key {kind}, id long, allowed boolean")
