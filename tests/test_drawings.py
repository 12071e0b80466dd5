"""Drawing signals against a plain machine with a stack."""

import math
import random

from pyspark.sql import functions as F

from sparkloom.operators import drawings as D

SCHEMA = "doc_id int, page int, seq int, op string, matrix array<double>, bounds array<double>, w double, h double"


def plain(ops, w, h):
    """(images, paths) of one page's (op, matrix, bounds)."""
    fine = lambda x, n: x is not None and len(x) == n and all(v is not None and math.isfinite(v) for v in x)
    m, stack, images, paths = list(D.IDENTITY), [], 0, 0
    for op, t, b in ops:
        if op in ("save", "form-begin"):
            stack.append(m)
        if op in ("restore", "form-end"):
            m = stack.pop() if stack else list(D.IDENTITY)
        elif op in ("transform", "form-begin") and fine(t, 6):
            m = [t[0] * m[0] + t[1] * m[2], t[0] * m[1] + t[1] * m[3], t[2] * m[0] + t[3] * m[2], t[2] * m[1] + t[3] * m[3], t[4] * m[0] + t[5] * m[2] + m[4], t[4] * m[1] + t[5] * m[3] + m[5]]
        elif op in D.PICTURES:
            images += 1
        elif op in D.PATHS:
            flat = False
            if op != "shadingFill" and fine(b, 4) and w > 0 and h > 0:
                xs = [m[0] * x + m[2] * y + m[4] for x in (b[0], b[2]) for y in (b[1], b[3])]
                ys = [m[1] * x + m[3] * y + m[5] for x in (b[0], b[2]) for y in (b[1], b[3])]
                wide, tall = (max(xs) - min(xs)) / w, (max(ys) - min(ys)) / h
                flat = (wide >= 0.6 and tall <= 0.01) or (wide >= 0.8 and tall >= 0.8)
            paths += not flat
    return images, paths


def test_same_as_a_plain_machine(spark):
    rng = random.Random(9)
    names = ["save", "save", "restore", "transform", "form-begin", "form-end", "constructPath", "constructPath", "rawFillPath", "shadingFill", "paintImageXObject", "setFont", None]
    matrices = [[0.0, 1.0, -1.0, 0.0, 600.0, 0.0], [2.0, 0.0, 0.0, 2.0, 0.0, 0.0], [0.5, 0.0, 0.0, 0.5, 10.0, 10.0], [1.0, 2.0], None, [float("nan")] * 6]
    boxes = [[0.0, 5.0, 500.0, 6.0], [5.0, 0.0, 6.0, 700.0], [10.0, 10.0, 590.0, 790.0], [0.0, 0.0, 50.0, 50.0], [1.0], None, [0.0, 0.0, None, 1.0]]
    pages = {}
    for k in range(200):
        pages[k] = [(rng.choice(names), rng.choice(matrices), rng.choice(boxes)) for _ in range(rng.randrange(1, 40))]
    size = lambda k: (0.0, 0.0) if k == 7 else (600.0, 800.0)
    rows = [(1, k, i, *o, *size(k)) for k, ops in pages.items() for i, o in enumerate(ops)]
    rng.shuffle(rows)
    got = {r.page: (r.images, r.paths) for r in D.drawing_signals(spark.createDataFrame(rows, SCHEMA), F.col("w"), F.col("h")).collect()}
    assert got == {k: plain([(o or "", t, b) for o, t, b in ops], *size(k)) for k, ops in pages.items()}


def test_nested_and_rotated_frames(spark):
    frame, rule = [0.0, 0.0, 800.0, 600.0], [0.0, 1.0, 700.0, 2.0]
    turned = [0.0, 1.0, -1.0, 0.0, 600.0, 0.0]
    ops = [("save", None, None), ("transform", turned, None), ("constructPath", None, frame), ("save", None, None), ("transform", [0.1, 0.0, 0.0, 0.1, 0.0, 0.0], None), ("constructPath", None, frame), ("restore", None, None), ("rawFillPath", None, frame), ("restore", None, None), ("constructPath", None, rule), ("restore", None, None), ("constructPath", None, [0.0, 0.0, 60.0, 1.0])]
    rows = [(1, 1, i, *o, 600.0, 800.0) for i, o in enumerate(ops)]
    r = D.drawing_signals(spark.createDataFrame(rows, SCHEMA), F.col("w"), F.col("h")).first()
    assert (r.images, r.paths) == (0, 2)
