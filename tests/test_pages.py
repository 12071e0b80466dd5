"""Pages are worked out where they were dealt once: what a query shuffles is its input, not each step's rows."""

import random
import re
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__ as entry
from sparkloom.operators import pages as P
from sparkloom.sources import loaders as L

SMALL = "/root/testdata/sf0.001"
ELEMENT = "doc_id int, page int, idx int, type string, text string, box struct<xmin:double,ymin:double,xmax:double,ymax:double>"


def moves(df):
    """Shuffles and joins of a plan."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"\bExchange (?!SinglePartition)", plan)), len(re.findall(r"\b\w*Join\w*\b", plan))


def test_a_page_is_shuffled_once(spark):
    assert moves(entry.queries()["normalised_pages"](spark, SMALL)) == (1, 0)
    elements = spark.range(100).select(F.col("id").alias("doc_id"), F.col("id").alias("page"), F.lit(1).alias("idx"), F.lit("Text").alias("type"), F.lit("t").alias("text"), F.struct(*(F.lit(x).alias(k) for k, x in (("xmin", 0.0), ("ymin", 0.0), ("xmax", 0.5), ("ymax", 0.5)))).alias("box"))
    assert moves(P.normalise_pages(elements)) == (1, 0)


def test_captions_of_several_pages(spark):
    page = [
        ("Caption", "Table  1", (10, 5, 90, 8)), ("Table", "cells", (10, 10, 90, 30)), ("Caption", "Table 1 again", (10, 31, 90, 33)), ("Caption", "table 1", (10, 45, 90, 47)),
        ("Picture", "bars", (10, 70, 90, 80)), ("Caption", "Figure 2", (10, 81, 90, 83)), ("Picture", "alone", (10, 94, 20, 99)),
    ]
    # a page with captions only, and one with a table only, have none from their neighbours
    pages = {(1, 1): page, (1, 2): [page[0]], (2, 1): [page[1]], (2, 2): [page[1], page[0]]}
    rows = [(d, p, i, kind, text, tuple(x / 100 for x in sides)) for (d, p), es in pages.items() for i, (kind, text, sides) in enumerate(es)]
    got = sorted((r.doc_id, r.page, r.place, r.text, r.caption) for r in P.normalise_pages(spark.createDataFrame(rows, ELEMENT)).collect())
    # the first caption that goes to a table stays; what says the same isn't said again, another one that found its table taken is
    assert got == [
        (1, 1, 0, "cells", "Table  1"), (1, 1, 1, "Table 1 again", None), (1, 1, 2, "bars", "Figure 2"), (1, 1, 3, "alone", None),
        (1, 2, 0, "Table  1", None), (2, 1, 0, "cells", None), (2, 2, 0, "cells", "Table  1"),
    ]


def test_chunks_are_numbered_without_another_shuffle(spark):
    assert moves(entry.queries()["normalised_chunks"](spark, SMALL)) == (1, 0)
    assert moves(entry.queries()["html_chunks"](spark, SMALL)) == (1, 0)


def test_chunks_are_numbered_over_their_document(spark):
    rng = random.Random(1)
    # texts of no, one and several chunks; more rows than one slice of a batch, in no order
    texts = ["", " ", "one", "word " * 30, "\n\n".join(["many words here"] * 20), None]
    rows = [(d, p, i, rng.choice(["Text", "Table", "Picture"]), rng.choice(texts), f"h{p}", None) for d in range(40) for p in range(rng.randrange(1, 40)) for i in range(rng.randrange(6))]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, page int, place int, type string, text string, heading string, caption string").repartition(5)
    got = sorted((r.doc_id, r.chunk_index, r.page, r.heading, r.content, r.token_count) for r in L.element_chunks(df, 16, 4).collect())
    want, n = [], Counter()
    for d, p, i, kind, text, heading, _ in sorted(rows, key=lambda r: r[:3]):
        for part in [(text, L.estimate(text))] if kind != "Text" and text and text.strip() else L.pack(text or "", 16, 4):
            want.append((d, n[d], p, heading, *part))
            n[d] += 1
    assert got == want and max(n.values()) > 64 and len(n) < 41
