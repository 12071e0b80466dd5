"""Rules on texts, pages and replies on small fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import answers as A
from sparkloom.functions import rules as R
from sparkloom.operators import pages as P
from sparkloom.operators import sections as S
from sparkloom.operators import tenancy as T
from sparkloom.sources import loaders as L


@pytest.mark.parametrize(
    ("text", "parts"),
    [
        ("One. Two! Three?", ["One.", " Two!", " Three?"]),
        ("Version 2.8 of v1.2 is out. [1] [2] Next", ["Version 2.8 of v1.2 is out. [1] [2]", " Next"]),
        ('He said "no." Then left.', ['He said "no."', " Then left."]),
        ("Costs rise.[3][4] So what", ["Costs rise.[3][4]", " So what"]),
        ("A line\n\nanother one", ["A line\n\n", "another one"]),
        ("Wait... what?! Yes", ["Wait...", " what?!", " Yes"]),
        ("First.\n  \nSecond.", ["First.\n  \n", "Second."]),
        ("", []),
        (None, []),
        ("  ", []),
    ],
)
def test_sentences(spark, text, parts):
    assert values(spark, [(text,)], A.sentences(F.col("_1"))) == [parts]


def values(spark, rows, column):
    kinds = ", ".join(f"_{i} {'array<int>' if isinstance(x, list) else 'string'}" for i, x in enumerate(rows[0], 1))
    return [r[0] for r in spark.createDataFrame(rows, kinds).select(column).collect()]


def test_sentences_join_to_the_text(spark):
    rng = random.Random(2)
    texts = ["a" + "".join(rng.choice(["a", "b ", ".", "!", "?", " ", "\n", "[1]", "[", '"', ")", "2.5"]) for _ in range(rng.randint(0, 25))) for _ in range(5000)]
    assert ["".join(x) for x in values(spark, [(t,) for t in texts], A.sentences(F.col("_1")))] == texts
    assert values(spark, [("x. " * 200_000,), ("a.b" * 200_000,)], F.size(A.sentences(F.col("_1")))) == [200_000, 1]


def test_unsupported_sentences_go(spark):
    text = "Leave is 20 days. [1] It carries over. [2] Ask HR."
    rows = [(text, [2]), (text, [1, 2]), (text, []), (None, [1]), ("A. [1]", [1])]
    got = [tuple(x) for x in values(spark, rows, A.without_unsupported(F.col("_1"), F.col("_2")))]
    assert got == [("Leave is 20 days. [1] Ask HR.", [2], 1, False), ("Ask HR.", [1, 2], 2, True), (text, [], 0, False), ("", [], 0, True), ("", [1], 1, True)]
    assert values(spark, [("A. B!",)], A.numbered(F.col("_1"))) == ["S1: A.\nS2: B!"]


def test_numbers_that_are_not_printed(spark):
    rows = [("Q3 is about 90, Q2 1,200; see page 7 and Figure 3.2", "Q2 1200"), ("Roughly 5 of x7, fig. 2: 3.14.15\n8", "8 15"), ("", None), (None, "1"), ("page about 7, 1,200", "1,200")]
    got = [tuple(x) for x in values(spark, rows, A.without_unlabelled(F.col("_1"), F.col("_2")))]
    assert got == [("Q3 is [unlabelled], Q2 1,200; see page 7 and Figure 3.2", 1), ("[unlabelled] of x7, fig. 2: [unlabelled].15\n8", 2), ("", 0), ("", 0), ("page about 7, 1,200", 0)]


def test_replies(spark):
    assert A.rerank_scores('ids {"scores": []} then {"scores": [{"id": 2, "score": 15}, {"id": "1", "score": "5"}]}', 2) == [0.5, 1.0]
    for bad in ('{"scores": [{"id": 1, "score": 1}, {"id": 1, "score": 2}]}', '{"scores": [{"id": 1, "score": 1}]}', '{"scores": [{"id": 1, "score": "x"}, {"id": 2, "score": 2}]}', "none", None):
        assert A.rerank_scores(bad, 2) is None
    replies = [('so {"unsupported": [2, "3", 2, -1, 1.5, "x"]}',), ("no",), ('{"unsupported": []}',), ('{"unsupported": 3}',), ('{"unsupported": [1',), (None,)]
    assert values(spark, replies, A.verdict(F.col("_1"))) == [[2, 3], None, [], None, None, None]


ELEMENT = "doc_id int, page int, idx int, type string, text string, box struct<xmin:double,ymin:double,xmax:double,ymax:double>"


def page_of(spark, elements, page=1):
    """elements: (type, text, sides of the box in hundredths)"""
    return spark.createDataFrame([(1, page, i, kind, text, None if sides is None else tuple(x / 100 for x in sides)) for i, (kind, text, sides) in enumerate(elements)], ELEMENT)


def test_page_in_reading_order(spark):
    page = [
        ("Text", "right top", (55, 20, 95, 30)), ("Text", "left low", (5, 50, 45, 60)), ("Title", "# Banner", (5, 5, 95, 10)), ("Text", "left top", (5, 20, 45, 30)), ("Page-footer", "page 1", (5, 95, 95, 98)),
        ("Text", "left  top", (5, 20, 45, 31)), ("Text", "upside down", (50, 90, 40, 80)), ("Text", "nowhere", None), ("Text", " ", (5, 5, 9, 9)),
    ]
    got = P.normalise_pages(page_of(spark, page)).orderBy("place").collect()
    assert [(r.place, r.text, r.heading) for r in got] == [(0, "left top", "Banner"), (1, "left low", "Banner"), (2, "right top", "Banner")]


def test_full_width_elements_cut_the_page_into_bands(spark):
    page = [("Text", "d", (55, 70, 95, 80)), ("Text", "a", (5, 10, 45, 20)), ("Text", "wide", (5, 50, 95, 55)), ("Text", "c", (5, 72, 45, 80)), ("Text", "b", (55, 5, 95, 20)), ("Text", "e2", (80, 85.4, 90, 90)), ("Text", "e1", (60, 85.7, 75, 90))]
    got = P.in_reading_order(page_of(spark, page)).orderBy("place").collect()
    assert [r.text for r in got] == ["a", "b", "wide", "c", "d", "e1", "e2"] and [r.place for r in got] == list(range(1, 8))


def test_captions_bind_to_what_is_next_to_them(spark):
    page = [("Table", "\\begin{tabular} a \\end{tab", (10, 10, 90, 30)), ("Caption", "Table 1", (10, 31, 90, 34)), ("Picture", "bars", (10, 50, 90, 80)), ("Caption", "Figure 2 ", (10, 45, 90, 49)), ("Caption", "far away", (10, 98, 20, 99)), ("Section-header", "##", (10, 36, 30, 38))]
    out = {r.type: r for r in P.normalise_pages(page_of(spark, page)).collect()}
    assert out["Table"].text == "\\begin{tabular} a\n\\end{tabular}" and out["Table"].caption == "Table 1" and out["Picture"].caption == "Figure 2"
    # the caption below the picture comes second, and isn't said anywhere else
    assert out["Caption"].text == "far away" and out["Picture"].heading is None


def test_repeats_prefer_usable_boxes(spark):
    bad, good = (50, 50, 10, 90), (10, 10, 40, 20)
    texts = lambda *e: sorted(r.text for r in P.once(page_of(spark, e)).collect())
    assert texts(("Text", "A", bad), ("Text", "*a*", good)) == ["*a*"] and texts(("Text", "A", bad), ("Text", "a", bad)) == ["A"]
    assert texts(("Text", "continued", good), ("Text", "continued", (60, 80, 90, 90))) == ["continued"] * 2
    # of a chain of overlaps, only what overlaps one that stays goes
    assert len(texts(*(("Text", "x", (10, 10 + 5 * k, 40, 20 + 5 * k)) for k in range(5)))) == 3


def test_runs_go_on_around_figures(spark):
    rows = [(1, 0, "A", 1, "text"), (1, 1, "A", 1, "figure"), (1, 2, "A", 1, "text"), (1, 3, "A", 2, "text"), (1, 4, None, 2, "ocr"), (1, 5, None, 2, None)]
    df = spark.createDataFrame(rows, "doc_id int, chunk_index int, section string, page int, kind string")
    assert [r.run for r in S.section_runs(df).orderBy("chunk_index").collect()] == [1, None, 1, 2, 3, 3]


def merged(spark, contents):
    rows = [(1, i, "A", c) for i, c in enumerate(contents)]
    return [r.content for r in S.merged_runs(spark.createDataFrame(rows, "doc_id int, chunk_index int, section string, content string")).collect()]


def test_merged_runs(spark):
    assert merged(spark, ["a\n\nb", "b\n\nc", "c", "c"]) == ["a\n\nb\n\nc\n\nc\n\nc"]
    assert merged(spark, ["x\n\ny\n\nz", "y\n\nz\n\nw"]) == ["x\n\ny\n\nz\n\nw"] and merged(spark, []) == []
    # the longest tail counts; a whole chunk is no seam; nulls are empty; long runs have a row, too
    assert merged(spark, ["p\n\nq\n\nq", "q\n\nq\n\nr"]) == ["p\n\nq\n\nq\n\nr"] and merged(spark, ["s", "s\n\nt"]) == ["s\n\ns\n\nt"]
    assert merged(spark, [None, "u", None]) == ["\n\nu\n\n"] and len(merged(spark, ["x"] * 1500)[0]) == 1500 + 2 * 1499


def test_parents_have_their_text_and_boxes(spark):
    box = lambda x: (x, 0.1, x + 0.1, 0.2)
    kinds = "doc_id int, chunk_index int, chunk_id int, section string, page int, kind string, heading string, content string, token_count int, boxes array<struct<xmin:double,ymin:double,xmax:double,ymax:double>>, bbox struct<xmin:double,ymin:double,xmax:double,ymax:double>"
    chunks = [
        (1, 0, 10, "A", 1, "text", "A", "one\n\ntwo", 5, [box(0.1)], None), (1, 1, 11, "A", 1, "figure", "A", "bars", 1, None, box(0.6)), (1, 2, 12, "A", 1, "ocr", "A", "two\n\nthree", 5, [], box(0.3)),
        (1, 3, 13, "A", 2, "text", "A", "next page", 5, None, None), (1, 4, 14, "B", 2, "text", "B", "other", 5, [box(0.5)], None),
    ]
    chunks = spark.createDataFrame(chunks, kinds)
    admitted = spark.createDataFrame([(1, 1, 14, 1, 4, 0.5), (1, 2, 12, 1, 2, 0.4), (1, 3, 11, 1, 1, 0.9), (1, 4, 10, 1, 0, 0.6), (2, 1, 10, 1, 0, 0.7)], "q_id int, rank int, chunk_id int, doc_id int, chunk_index int, similarity double")
    got = S.with_evidence(S.parents(admitted, chunks, 100), chunks).orderBy("q_id", "rank").collect()
    assert [(r.q_id, r.rank, r.chunk_index, r.content, r.kind, r.member_ids, [b.xmin for b in r.boxes]) for r in got] == [
        (1, 1, 4, "other", "text", None, [0.5]), (1, 2, 0, "one\n\ntwo\n\nthree", "ocr", [10, 12], [0.1, 0.3]), (1, 3, 1, "bars", "figure", None, [0.6]), (2, 1, 0, "one\n\ntwo", "text", None, [0.1]),
    ]
    assert got[1].similarity == 0.6 and got[1].members == 2
    # a run that doesn't fit stays in parts
    assert S.parents(admitted, chunks, 9).where("parent").count() == 0


def test_chunks_keep_to_pages_and_elements(spark):
    pages = spark.createDataFrame([(1, 1, "RULES OF LEAVE\n\n" + "word " * 90), (1, 2, ""), (1, 3, "short"), (2, 1, None)], "doc_id long, page int, text string")
    out = L.page_chunks(pages, 40, 8).orderBy("doc_id", "chunk_index").collect()
    assert [r.chunk_index for r in out] == list(range(len(out))) and {r.page for r in out} == {1, 3} and out[0].heading == "RULES OF LEAVE" and all(r.token_count <= 40 for r in out)
    rows = [(1, 1, 0, "Text", "t " * 100, "H", None), (1, 1, 1, "Table", "cell " * 100, "H", "Table 1"), (1, 1, 2, "Picture", " ", None, None)]
    out = L.element_chunks(spark.createDataFrame(rows, "doc_id long, page int, place int, type string, text string, heading string, caption string"), 40, 8).orderBy("chunk_index").collect()
    assert [r.kind for r in out].count("table") == 1 and out[-1].content == "cell " * 100 and "figure" not in [r.kind for r in out]


def test_addresses_and_urls(spark):
    rows = [("8.8.8.8", True), ("10.1.2.3", False), ("172.32.0.1", True), ("256.1.1.1", False), ("1.2.3", False), (None, False), ("100.128.0.1", True), ("198.19.255.255", False)]
    df = spark.createDataFrame(rows, "a string, want boolean").withColumn("got", R.public_v4(F.col("a")))
    assert all(r.got == r.want for r in df.collect())
    urls = [("https://a.org/x", None), ("ftp://a.org", "Only http"), ("https://u:p@a.org", "Addresses with"), ("https://a.org:8443", "Only the standard"), ("https://evil.com/a.org", "evil.com"), ("https://docs.a.org", None), ("notaurl", "That is not")]
    for r in spark.createDataFrame(urls, "u string, want string").withColumn("got", R.url_error(F.col("u"), ["a.org"])).collect():
        assert (r.got is None) == (r.want is None) and (r.want is None or r.got.startswith(r.want)), r


def test_prices_and_pools(spark):
    assert R.model_prices("a/b=c=2.5, d=0,") == {"a/b=c": 2.5, "d": 0.0} and R.model_prices(None) == {}
    for bad in ("x", "=1", "a=-1", "a=nan", "a=b"):
        with pytest.raises(ValueError):
            R.model_prices(bad)
    assert [R.pool_size(8, None), R.pool_size(8, 20), R.pool_size(30, 20)] == [8, 20, 30]
    sizes = lambda bases, top_k, pool: values(spark, [(str(bases),)], R.channel_size(F.col("_1").cast("int"), top_k, pool))[0]
    assert [sizes(1, 8, 8), sizes(1, 8, 50), sizes(30, 8, 8), sizes(4, 8, 50)] == [20, 50, 200, 80]


def test_writes_are_idempotent(spark):
    chunks = spark.createDataFrame([(1, "o", "k"), (2, "o", "k")], "chunk_id int, owner_id string, base_id string")
    values = spark.createDataFrame([(1,), (1,), (2,), (9,)], "chunk_id int")
    present = spark.createDataFrame([], "chunk_id int")
    first = T.attached(values, chunks, present)
    assert first.count() == 2 and T.attached(values, chunks, first).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "run_id int, key int, parent_key int")
    assert T.span_tree(none).count() == 0
    docs = spark.createDataFrame([], "document_id int, title string")
    asked = spark.createDataFrame([(1, "summarise it")], "q_id int, text string")
    assert T.scope(asked, docs).first().mode == "search"
    one = spark.createDataFrame([(5, "Handbook")], "document_id int, title string")
    assert tuple(T.scope(asked, one).first()) == (1, "document", "only-document", 5)


def test_canonical_json(spark):
    from sparkloom.functions.render import canonical_json

    texts = ['{"b": 1, "a": [2, {"d": null, "c": "x"}]}', '{"a":[2,{"c":"x","d":null}],"b":1}', '{"a":[{"c":"x","d":null},2],"b":1}', '{"b":"1","a":[2,{"d":null,"c":"x"}]}', "no json", None, "[]"]
    got = values(spark, [(t,) for t in texts], canonical_json(F.col("_1")))
    assert got[0] == got[1] == '{"a":[2,{"c":"x","d":null}],"b":1}' and len(set(got[1:5])) == 4 and got[4:6] == [None, None] and got[6] == "[]"


def test_details_are_scrubbed_and_bounded():
    import json

    from sparkloom.functions.details import scrubbed

    got = json.loads(scrubbed(json.dumps({"X-API-Key": "a", "secret": None, "token": 3, "auth": {"password": ["p"], "cookie": True}, "tokens": "kept", "text": "sk-abcdefgh1 " + "z" * 5000, "n": list(range(150)), "d": [[[[[[[1]]]]]]]})))
    assert got["X-API-Key"] == "[redacted]" and got["secret"] is None and got["token"] == 3 and got["auth"] == {"password": "[redacted]", "cookie": True} and got["tokens"] == "kept"
    assert got["text"].startswith("[redacted] zz") and got["text"].endswith("… (1011 more characters)") and got["n"][99:] == [99, "… 50 more"] and got["d"] == [[[[["[too deep]"]]]]]
    assert scrubbed(None) is None and scrubbed("{") is None and scrubbed("1") == "1" and len(json.loads(scrubbed(json.dumps({str(i): i for i in range(300)})))) == 100
    assert scrubbed("[" * 900 + "]" * 900) == '[[[[[["[too deep]"]]]]]]'
