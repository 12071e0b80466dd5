"""What a page draws: pictures, and paths that are content rather than the page's template.

ops: doc_id, page, seq, op, matrix (six numbers, of transform and form-begin) and bounds (xmin, ymin, xmax, ymax of a path, in the space it was drawn in). A page's
operators are a bounded group; they are folded in order, as a path's place on the page depends on the transforms in force where it was drawn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import bound

#: Operators that draw pictures and paths; a rule is wide and flat, a frame goes round the whole page (shares of it).
PICTURES = ["paintImageXObject", "paintImageXObjectRepeat", "paintInlineImageXObject", "paintImageMaskXObject", "paintJpegXObject"]
PATHS = ["constructPath", "rawFillPath", "shadingFill"]
RULE_WIDTH, RULE_HEIGHT, FRAME_SIDE = 0.6, 0.01, 0.8

IDENTITY = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0]


def _numbers(values: Column, n: int) -> Column:
    """values if they are n finite numbers, else null."""
    finite = F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when((F.size(values) == n) & finite, values)


def times(m: Column, onto: Column) -> Column:
    """The matrix that applies m first."""
    a, b = (lambda i: F.get(m, F.lit(i))), (lambda i: F.get(onto, F.lit(i)))
    return F.array(*(a(2 * r) * b(c) + a(2 * r + 1) * b(2 + c) + (b(4 + c) if r == 2 else 0.0) for r in range(3) for c in range(2)))


def furniture(bounds: Column, ctm: Column, width: Column, height: Column) -> Column:
    """Whether a path is a rule or a frame of the page's template. All four corners are placed, as a turned page makes tall what was wide. Without usable bounds it's content."""
    b, m = (lambda i: F.get(bounds, F.lit(i))), (lambda i: F.get(ctm, F.lit(i)))
    corners = [(b(x), b(y)) for x in (0, 2) for y in (1, 3)]
    side = lambda i, of: (F.greatest(*at(i)) - F.least(*at(i))) / of
    at = lambda i: [m(i) * x + m(2 + i) * y + m(4 + i) for x, y in corners]
    size = F.struct(side(0, width).alias("w"), side(1, height).alias("h"))
    kind = bound(size, lambda s: ((s["w"] >= RULE_WIDTH) & (s["h"] <= RULE_HEIGHT)) | ((s["w"] >= FRAME_SIDE) & (s["h"] >= FRAME_SIDE)))
    return F.coalesce(F.when((width > 0) & (height > 0), kind), F.lit(False))


def drawing_signals(ops: DataFrame, width: Column, height: Column) -> DataFrame:
    """doc_id, page, images, paths: pictures, and paths that are no rule or frame. width and height: columns of ops, the same for a page.

    save and form-begin keep the matrix, restore and form-end take it back (the identity where nothing was kept); transform and form-begin apply theirs. Matrices that
    aren't six finite numbers change nothing.
    """
    identity = F.array(*map(F.lit, IDENTITY))
    o = F.struct("seq", F.coalesce("op", F.lit("")).alias("op"), _numbers(F.col("matrix"), 6).alias("matrix"), _numbers(F.col("bounds"), 4).alias("bounds"))
    pages = ops.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(o)).alias("ops"), F.max(width).cast("double").alias("w"), F.max(height).cast("double").alias("h"))
    start = F.struct(identity.alias("ctm"), F.slice(F.array(identity), 1, 0).alias("kept"), F.lit(0).alias("images"), F.lit(0).alias("paths"))

    def step(s: Column, x: Column) -> Column:
        op, ctm, kept = x["op"], s["ctm"], s["kept"]
        applied = F.when(x["matrix"].isNotNull(), times(x["matrix"], ctm)).otherwise(ctm)
        back = op.isin("restore", "form-end")
        new = F.when(back, F.coalesce(F.get(kept, F.size(kept) - 1), identity)).when(op.isin("transform", "form-begin"), applied).otherwise(ctm)
        keep = F.when(back, F.slice(kept, 1, F.greatest(F.lit(0), F.size(kept) - 1))).when(op.isin("save", "form-begin"), F.concat(kept, F.array(ctm))).otherwise(kept)
        content = op.isin(PATHS) & ~((op != "shadingFill") & furniture(x["bounds"], ctm, F.col("w"), F.col("h")))
        return F.struct(new.alias("ctm"), keep.alias("kept"), (s["images"] + op.isin(PICTURES).cast("int")).alias("images"), (s["paths"] + content.cast("int")).alias("paths"))

    return pages.select("doc_id", "page", F.aggregate("ops", start, step).alias("s")).select("doc_id", "page", "s.images", "s.paths")
