"""Where a chunk's text stands on its page, as the few rectangles that a reader's highlight draws.

items: doc_id, page, idx, str, box (in shares of the page). chunks: doc_id, page, chunk_index, content. A page's items and chunks are bounded groups.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import rules as R

PAGE = ["doc_id", "page"]
#: Shares of overlap and gaps in heights by which items are one line and lines one block; the most regions of a chunk; the least fill of a single box.
OVERLAP, GAP, MOST, FILL = 0.5, 1.5, 16, 0.65
_NO_HEIGHT = 1e-6


def dense(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")


def located(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, page, chunk_index, idx, box: the items that each chunk's text runs over. White space doesn't count.

    Chunks of a page are looked up in order, each from where the one before began (they may overlap), and from the page's top if it isn't found there. Chunks without
    text, or whose text the page doesn't have, have no items.
    """
    rows = items.withColumn("d", dense(F.col("str"))).where("d <> ''")
    before = Window.partitionBy(*PAGE).orderBy("idx").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("begin", F.coalesce(F.sum(F.length("d")).over(before), F.lit(0)) + 1)
    pages = rows.groupBy(*PAGE).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "d"))), lambda x: x["d"]), "").alias("said"))
    wanted = chunks.select(*PAGE, "chunk_index", dense(F.col("content")).alias("d")).where("d <> ''").groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("chunk_index", "d"))).alias("cs"))
    place = F.struct(F.lit(None).cast(chunks.schema["chunk_index"].dataType).alias("chunk_index"), F.lit(0).alias("at"), F.lit(0).alias("n"))

    def look(s: Column, c: Column) -> Column:
        find = lambda begin: F.call_function("locate", c["d"], F.col("said"), begin)
        at = F.when(find(s["from_"]) > 0, find(s["from_"])).otherwise(find(F.lit(1)))
        return R.bound(at, lambda at: F.struct(F.when(at > 0, at).otherwise(s["from_"]).alias("from_"), F.concat(s["found"], F.array(F.struct(c["chunk_index"].alias("chunk_index"), at.alias("at"), F.length(c["d"]).alias("n")))).alias("found")))

    found = wanted.join(pages, PAGE).select(*PAGE, F.explode(F.aggregate("cs", F.struct(F.lit(1).alias("from_"), F.slice(F.array(place), 1, 0).alias("found")), look, lambda s: s["found"])).alias("f")).where("f.at > 0")
    inside = (F.col("begin") < F.col("f.at") + F.col("f.n")) & (F.col("begin") + F.length("d") > F.col("f.at"))
    return found.join(rows, PAGE).where(inside).select(*PAGE, "f.chunk_index", "idx", "box")


def _height(b: Column) -> Column:
    return F.greatest(b["ymax"] - b["ymin"], F.lit(_NO_HEIGHT))


def lines(boxes: Column) -> Column:
    """Boxes in reading order as lines: one goes on with the line before if they share half the lower one's height and are no further apart than its height and a half."""

    def step(out: Column, b: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        beside = (R.overlap_ratio(last["ymin"], last["ymax"], b["ymin"], b["ymax"]) >= OVERLAP) & (F.greatest(b["xmin"] - last["xmax"], last["xmin"] - b["xmax"]) <= _height(b) * GAP)
        return F.when((F.size(out) > 0) & beside, F.concat(F.slice(out, 1, F.greatest(F.lit(0), F.size(out) - 1)), F.array(R.union(last, b)))).otherwise(F.concat(out, F.array(b)))

    return F.aggregate(boxes, F.slice(boxes, 1, 0), step)


def blocks(rows: Column) -> Column:
    """Lines as blocks: a line goes to the first block that it overlaps sideways by half and stands no further from than its height and a half. All blocks are open, as the
    lines of two columns may come by turns."""

    def step(out: Column, b: Column) -> Column:
        takes = F.transform(out, lambda o: (R.overlap_ratio(o["xmin"], o["xmax"], b["xmin"], b["xmax"]) >= OVERLAP) & (F.greatest(b["ymin"] - o["ymax"], o["ymin"] - b["ymax"]) <= _height(b) * GAP))
        return R.bound(F.array_position(takes, F.lit(True)), lambda at: F.when(at > 0, F.transform(out, lambda o, i: F.when(i == at - 1, R.union(o, b)).otherwise(o))).otherwise(F.concat(out, F.array(b))))

    return F.aggregate(rows, F.slice(rows, 1, 0), step)


def columns(boxes: Column) -> Column:
    """One box for each column, from the left: boxes that overlap sideways, also by way of others."""

    def step(out: Column, b: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        return F.when((F.size(out) > 0) & (b["xmin"] < last["xmax"]), F.concat(F.slice(out, 1, F.greatest(F.lit(0), F.size(out) - 1)), F.array(R.union(last, b)))).otherwise(F.concat(out, F.array(b)))

    return F.aggregate(F.array_sort(boxes), F.slice(boxes, 1, 0), step)


def regions(boxes: Column) -> Column:
    """The blocks of a chunk's boxes, or one box a column if they are more than MOST. No box reaches over the gap between columns."""
    return R.bound(blocks(lines(boxes)), lambda found: F.when(F.size(found) <= MOST, found).otherwise(columns(found)))


def single(found: Column) -> Column:
    """One box for all regions, null where that would say too much: several columns, or under FILL of it filled."""
    whole = F.aggregate(found, F.get(found, F.lit(0)), lambda a, b: R.union(a, b))
    filled = F.aggregate(found, F.lit(0.0), lambda s, b: s + R.area(b))
    return F.when((F.size(found) > 0) & (F.size(columns(found)) == 1) & (R.area(whole) > 0) & (filled / R.area(whole) >= FILL), whole)


def with_boxes(chunks: DataFrame, items: DataFrame) -> DataFrame:
    """chunks with boxes (its regions, null if its text isn't found) and bbox."""
    of = located(chunks, items).where("box is not null").groupBy(*PAGE, "chunk_index").agg(F.transform(F.array_sort(F.collect_list(F.struct("idx", "box"))), lambda x: x["box"]).alias("b"))
    of = of.select(*PAGE, "chunk_index", regions(F.col("b")).alias("boxes")).withColumn("bbox", single(F.col("boxes")))
    return chunks.join(of, [*PAGE, "chunk_index"], "left")
