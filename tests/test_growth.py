"""Results and plans that must not depend on how large the tables are."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from sparkloom.functions import answers as A
from sparkloom.functions import rules as R
from sparkloom.functions.stems import hits, lexemes
from sparkloom.operators import docs_index, pages, sections
from sparkloom.operators import retrieval as D
from sparkloom.operators import selection as S
from sparkloom.operators import tenancy as T
from sparkloom.operators import text_index as X
from sparkloom.operators import vector_index as V
from sparkloom.sources import loaders as L


def test_span_trees_have_no_limit_of_rows_or_levels(spark):
    rows = [(1, 1, None), (1, 2, 1), (1, 3, 1), (1, 4, 3), (1, 8, 9), (1, 9, 8), (2, 5, 7), (2, None, 5)]
    spark.conf.set("spark.sql.cteRecursionRowLimit", 3)
    spark.conf.set("spark.sql.cteRecursionLevelLimit", 2)
    try:
        got = sorted(map(tuple, T.span_tree(spark.createDataFrame(rows, "run_id int, key int, parent_key int")).collect()), key=str)
    finally:
        spark.conf.unset("spark.sql.cteRecursionRowLimit")
        spark.conf.unset("spark.sql.cteRecursionLevelLimit")
    assert got == [(1, 1, 0, "1"), (1, 2, 1, "1/2"), (1, 3, 1, "1/3"), (1, 4, 2, "1/3/4"), (2, 5, 0, "5"), (2, None, 1, None)]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_addresses_are_matched_once(spark):
    rows = spark.createDataFrame([("8.8.8.8", "http://a.org"), ("10.0.0.1", "ftp://a.org")], "a string, u string").withColumn("a", F.concat("a", F.lit("")))
    plan = plan_of(rows.select(R.public_v4(F.col("a")).alias("p"), R.url_error(F.col("u"), ["a.org", "b.org"]).alias("e")))
    assert plan.count("RLIKE") == 1 and plan.count("regexp_extract(") == 4, plan
    assert [tuple(r) for r in rows.select(R.public_v4(F.col("a")), R.url_error(F.col("u"), ["a.org"])).collect()] == [(True, None), (False, "Only http and https addresses can be added.")]


def test_sentences_of_an_answer_are_found_once(spark):
    rows = spark.createDataFrame([("A. [1] B. [2]", [2])], "t string, bad array<int>")
    plan = plan_of(rows.select(A.without_unsupported(F.col("t"), F.col("bad")).alias("s")))
    assert plan.count("(?:[^\\n.!?]++") == 1, plan


def test_covers_of_a_long_text():
    n = 200_000
    got = X.cover_density([(0, list(range(1, n, 4))), (1, list(range(3, n, 4)))], 2)
    assert abs(got - (n // 2 - 1) * 0.1 / 2) < 1e-3
    assert X.cover_density([(0, [5])], 2) == 0.0


def test_many_texts_become_rows_few_at_a_time():
    assert [b.num_rows for b in L.few([pa.record_batch({"k": list(range(150))})])] == [64, 64, 22]


def test_percentiles_read_their_rows_twice_at_most(spark):
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def value(x):
        seen.add(1)
        return float(x * x % 1999)

    rows = spark.range(2000).select((F.col("id") % 2).alias("g"), value("id").alias("v"))
    got = {r.g: r.p for r in S.percentiles(rows, ["g"], {"p": (F.col("v"), 0.5)}, limit=20).collect()}
    want = {g: sorted(float(x * x % 1999) for x in range(g, 2000, 2)) for g in (0, 1)}
    assert got == {g: (v[499] + v[500]) / 2 for g, v in want.items()} and seen.value <= 4000


def test_an_exact_walk_misses_nothing(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(3000, 48)), np.tile(rng.normal(size=48), (300, 1))])
    vectors = spark.createDataFrame([("ab"[i % 2], i, v.tolist()) for i, v in enumerate(x)], "scope string, chunk_id long, embedding array<float>")
    asked = spark.createDataFrame([("ab"[i % 2], i, (x[-1 - i] + rng.normal(size=48)).tolist()) for i in range(0, 600, 20)], "scope string, q_id long, embedding array<float>")
    index = V.build(vectors)
    rows = lambda df: sorted(tuple(r) for r in df.select("q_id", "v_rank", "chunk_id", "similarity").collect())
    want = rows(D.dense(asked, vectors, 10))
    assert rows(V.search(asked, index, 10, beam=10)) != want
    assert rows(V.search(asked, index, 10, beam=10, exact=True)) == want


def test_tasks_hold_a_bounded_number_of_rows(spark, monkeypatch):
    for module, name in ((sections, "ROWS"), (pages, "ROWS"), (docs_index, "FILES"), (D, "TEXTS")):
        monkeypatch.setattr(module, name, 2)
    box = F.struct(*(F.lit(x).alias(k) for k, x in (("xmin", 0.0), ("ymin", 0.0), ("xmax", 0.5), ("ymax", 0.5))))
    rows = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(1).alias("chunk_index"), F.lit("s").alias("section"))
    elements = spark.range(100).select(F.col("id").alias("doc_id"), F.lit(1).alias("page"), F.lit(1).alias("idx"), F.lit("Text").alias("type"), F.lit("t").alias("text"), box.alias("box"))
    files = spark.range(100).select(F.concat(F.lit("f"), "id").alias("slug"), F.lit("# A\nb").alias("text"))
    texts = spark.range(100).select(F.col("id").alias("chunk_id"), F.lit("a").alias("scope"), F.lit("word").alias("content"))
    asked = spark.createDataFrame([(1, "a", "word")], "q_id int, scope string, text string")
    for df, n in ((sections.section_runs(rows), 100), (pages.normalise_pages(elements), 100), (docs_index.prose(files), 100), (D.lexical(asked, texts, 200), 100)):
        assert re.search(r"RepartitionByExpression \[[^\]]*\], 50", plan_of(df)), plan_of(df)
        assert df.count() >= n


def test_words_are_scored_by_blocks(spark, monkeypatch):
    rng = random.Random(23)
    vocabulary = [f"w{i}" for i in range(40)] + ["the", "É", "\u212a9", "\u0130", "x_y", "A1", "", "\n"]
    say = lambda n: rng.choice([" ", "-", "  "]).join(rng.choice(vocabulary) for _ in range(rng.randrange(n)))
    # ids that repeat, in one scope and in two; no id, no scope, no text
    texts = [(i, rng.choice("abc"), say(30)) for i in range(300)] + [(i, "ab"[i % 2], say(30)) for i in range(0, 60, 3)] + [(None, "a", "w1 w2"), (400, None, "w1"), (401, "a", None), (402, "a", "w3 " * 900)]
    asked = [(q, s, text) for q in range(30) for text in [say(12)] for s in "abc"[q % 3 :]] + [(90, "a", None), (91, "b", "the"), (92, None, "w1"), (93, "d", "w1"), (5, "c", "w7 w8"), (6, "a", "K9 i X Y a1")]
    chunks, questions = spark.createDataFrame(texts, "chunk_id long, scope string, content string"), spark.createDataFrame(asked, "q_id int, scope string, text string")
    words = lambda text: [w for w in re.split("[^a-z0-9]+", (text or "").lower()) if w and w != "the"]
    wanted, score = {}, {}
    for q, s, text in asked:
        wanted.setdefault((q, s), set()).update(words(text))
    for (q, s), terms in wanted.items():
        for i, scope, text in texts:
            if s is not None and s == scope and (n := sum(w in terms for w in words(text))):
                score.setdefault(q, {})[i] = score.get(q, {}).get(i, 0) + n
    want = {(q, i, rank, round(n * 0.1, 6)) for q, found in score.items() for rank, (i, n) in enumerate(sorted(found.items(), key=lambda x: (-x[1], -1 if x[0] is None else x[0]))[:7], 1)}
    got = lambda: [(r.q_id, r.chunk_id, r.l_rank, r.lexical_rank) for r in D.lexical(questions, chunks, 7).collect()]
    rows = got()
    assert set(rows) == want and len(rows) == len(want) > 150
    # no row for each pair of a question and a chunk, or for each word of a text
    plan = plan_of(D.lexical(questions, chunks, 7))
    assert "FlatMapCoGroups" in plan and "Join" not in plan and plan.count("Generate explode") == 2
    for name, n in (("BYTES", 500), ("QUESTIONS", 9), ("CELLS", 200), ("TEXTS", 20)):
        monkeypatch.setattr(D, name, n)
    rows = got()
    assert set(rows) == want and len(rows) == len(want)
    of_chunks = chunks.where("chunk_id < 3").select(F.col("chunk_id").alias("q_id"), "scope", F.col("content").alias("text"))
    assert D.lexical(of_chunks, chunks, 7).where("l_rank = 1").count() == 3
    assert D.lexical(questions.limit(0), chunks).count() == D.lexical(questions, chunks.limit(0)).count() == 0


def test_titles_are_found_by_equality(spark):
    rng = random.Random(15)
    say = lambda n: "".join(rng.choice("ab -") for _ in range(n))
    titles = [(k, say(rng.randrange(0, 14))) for k in range(300)] + [(500, None), (501, "Guide_to b"), (502, "guide to"), (499, "GUIDE-to b")]
    asked = [(k, say(rng.randrange(0, 60))) for k in range(200)] + [(900, None), (901, "Summarise misguide to bb!"), (902, "")]
    docs, rows = spark.createDataFrame(titles, "document_id int, title string"), spark.createDataFrame(asked, "q_id int, text string")
    got = T.mentioned(rows, docs)
    assert "FlatMapCoGroups" not in plan_of(got)  # no block of questions meets a block of titles
    key = lambda x: re.sub(r"\s+", " ", re.sub(r"[_\-.]+", " ", (x or "").lower())).strip()
    best = {q: min(((-len(key(t)), d) for d, t in titles if len(key(t)) >= 3 and key(t) in key(text)), default=(0, None))[1] for q, text in asked}
    assert {r.q_id: r.document_id for r in got.collect()} == best and best[901] == 499 and best[900] is None
    assert len(set(best.values())) > 20
    # a question that doesn't ask for a whole document isn't searched
    scoped = {r.q_id: (r.mode, r.document_id) for r in T.scope(rows, docs).collect()}
    assert scoped[901] == ("document", 499) and scoped[902] == ("search", None)


def test_postings_of_many_texts_share_a_row(spark, monkeypatch):
    rows = spark.range(400, numPartitions=1).select(F.lit("a").alias("scope"), F.col("id").alias("chunk_id"), F.concat(F.lit("Running, the rün "), "id", F.lit(" runs")).alias("content"))
    packed = X._postings(rows.repartition(1), True).collect()
    assert len(packed) == 403 and {r.term: len(r.postings) for r in packed if not r.term.isdigit()} == {"run": 400, "r": 400, "n": 400}
    held = X.build(rows).where("term = 'run'").selectExpr("inline(postings)").collect()
    assert len(held) == 400 and {tuple(r.positions) for r in held} == {(1, 6)}
    asked = spark.createDataFrame([(1, "a", "ran runs"), (2, "a", "7")], "q_id int, scope string, text string")
    small = X.search(asked, X.build(rows), 400)
    assert "positions" not in plan_of(small).split("Aggregate")[1].split("RepartitionByExpression")[0]  # what goes on is a number
    monkeypatch.setattr(X, "ASKED", 0)
    assert small.exceptAll(X.search(asked, X.build(rows), 400)).count() == 0 and small.count() == 401
    # slices are bounded by bytes
    batch = pa.record_batch({"t": ["x" * 10, None, "", "y" * 50, "z", "z"]})
    assert [s.num_rows for s in X.slices(batch, "t", 12)] == [3, 1, 2]


def test_words_of_many_texts_are_lexemes_of_each():
    texts = [None, "", "İstanbul KKelvin été x1", "the of", " Policies policy; POLICY\tran ", "agreed"]
    for stemmed in (True, False):
        terms, term, text, position = hits(texts, stemmed)
        got = [{} for _ in texts]
        for k, i, p in zip(term.tolist(), text.tolist(), position.tolist()):
            got[i].setdefault(terms[k], []).append(p)
        assert got == [lexemes(t, stemmed) for t in texts]
    assert [len(x) for x in hits([])] == [0, 0, 0, 0]
