"""Changing tables, rendered texts, tool calls and filters on small fixtures and odd rows."""

import datetime
import io
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sparkloom.functions import render as N
from sparkloom.operators import stores as T
from sparkloom.sources import files as D
from sparkloom.sources import loaders as L


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)


def fnv(word):
    h = 0x811C9DC5
    for c in word.encode():
        h = (h ^ c) * 0x01000193 % 2**32
    return h


def test_word_vectors(spark):
    texts = spark.createDataFrame([(1, "The days, a Day; X1"), (2, None), (3, ""), (4, "the of a"), (5, "ss ss")], "id int, text string")
    want = {(1, fnv("day") % 2048): 2 / 5**0.5, (1, fnv("x1") % 2048): 1 / 5**0.5, (5, fnv("s") % 2048): 1.0}
    got = {(r.id, r.slot): r.weight for r in N.word_vectors(texts, "id", "text").collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-8 for k in want)
    assert N.word_vectors(texts.limit(0), "id", "text").count() == 0


@pytest.mark.parametrize(
    ("data", "kind", "message", "content"),
    [
        (None, "skip", None, None),
        ("", "skip", None, None),
        ("[DONE]", "skip", None, None),
        ('{"a": ', "skip", None, None),
        ("17", "skip", None, None),
        ("null", "skip", None, None),
        ("{}", "delta", None, ""),
        ('{"choices": []}', "delta", None, ""),
        ('{"error": ""}', "delta", None, ""),
        ('{"error": null, "choices": [{"delta": {"content": "x"}}]}', "delta", None, "x"),
        ('{"error": "no"}', "error", "no", None),
        ('{"error": {"code": null}}', "error", "upstream error", None),
    ],
)
def test_frames(spark, data, kind, message, content):
    r = spark.createDataFrame([(data,)], "data string").select(N.frame(F.col("data")).alias("f")).first().f
    assert (r.kind, r.message, r.content) == (kind, message, content)


def test_document_lists(spark):
    docs = [(1, "B", "two", "application/pdf", None, 1), (1, "a", "one", None, "http://x", None), (1, "B", "Ape", "text/html", None, 2), (2, None, None, None, None, None)]
    schema = "o int, base string, title string, mime string, url string, pages int"
    got = dict(rows(N.document_lists(spark.createDataFrame(docs, schema), "o", 500)))
    assert got[1] == "3 documents in 2 knowledge bases:\n\na:\n- one (web page)\n\nB:\n- Ape (HTML, 2 sections)\n- two (PDF, 1 page)"
    assert got[2] == "1 document in 1 knowledge base:\n\n:\n-  (document)"
    many = spark.range(5000).select(F.lit(1).alias("o"), F.lit("b").alias("base"), F.format_string("d%05d", "id").alias("title"), F.lit(None).cast("string").alias("mime"), F.lit(None).cast("string").alias("url"), F.lit(None).cast("int").alias("pages"))
    text = N.document_lists(many, "o", 300).first().text
    assert len(text) <= 300 and text.startswith("5000 documents in 1 knowledge base:") and text.endswith(f"(and {5000 - text.count('- d')} more not listed)")
    assert rows(N.document_lists(many, "o", 20)) == [(1, "5000 documents in 1 knowledge base:\n(and 5000 more not listed)")]


def test_highlights_join_to_the_text(spark):
    df = spark.createDataFrame([("a.b A.B axb",), ("",), (None,), ("none",), ("\\E[x",)], "t string")
    for terms in (["a.b"], [], ["b", "A"], ["\\E"], ["["]):
        for text, parts in df.select("t", N.highlighted(F.col("t"), terms)).collect():
            if text is not None:
                assert "".join(p.text for p in parts) == text and all(p.match == (p.text.lower() in [t.lower() for t in terms]) for p in parts)


def test_padded(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4, 5]), (1, [7]), (1, None), (2, [])], "b int, ids array<int>")
    got = rows(N.padded(df, "b", "ids", 3))
    assert got == [(1, [0, 0, 0], [0, 0, 0]), (1, [1, 2, 5], [1, 1, 1]), (1, [7, 0, 0], [1, 0, 0]), (2, [], [])]


def test_tools(spark):
    with pytest.raises(ValueError, match="already"):
        N.registry([N.DAYS_BETWEEN, N.DAYS_BETWEEN])
    with pytest.raises(ValueError, match="already"):
        N.registry([N.Tool("search", {}, lambda: F.lit(""))])
    tools = N.registry([N.DAYS_BETWEEN, N.Tool("long", {}, lambda: F.repeat(F.lit("x"), F.lit(3000)))])
    calls = [("days_between", '{"start": "2024-01-01", "end": "2023-12-31"}'), ("days_between", None), ("days_between", "[1]"), ("long", " "), ("long", '{"a": 1}'), (None, "{}"), ("days_between", '{"start": "2024-13-01", "end": "2024-01-02"}')]
    got = [r[0] for r in spark.createDataFrame(calls, "n string, a string").coalesce(1).select(N.called(tools, F.col("n"), F.col("a"))).collect()]
    assert got[:3] == ["-1 day from 2024-01-01 to 2023-12-31.", "Invalid arguments of days_between: start, end", "The arguments of days_between are not a JSON object."]
    assert got[3] == "x" * 2000 and got[4:] == ["Invalid arguments of long: a", 'There is no tool called "".', "Not a real date."]


def test_settings_and_filters(spark):
    spec = [("size", "int", 1, 100), ("overlap", "int", 0, 100), ("floor", "float", 0, 1)]
    saved = lambda *r: spark.createDataFrame(list(r), "key string, value string")
    assert rows(N.typed_settings(saved(("size", "10"), ("overlap", "20"), ("floor", "0.5"), ("more", "1"), (None, None)), spec, ("overlap", "size"))) == [("floor", 0.5)]
    assert rows(N.typed_settings(saved(("size", "10.5"), ("overlap", "2"), ("floor", "2")), spec, ("overlap", "size"))) == [("overlap", 2.0)]
    assert rows(N.typed_settings(saved().limit(0), spec, ("overlap", "size"))) == []
    assert N.log_filters("levels=info,x&q=" + "y" * 300, ["info"], []) == {"levels": ["info"], "words": "y" * 200}
    assert N.log_filters("", ["info"], ["a"]) == {}


def test_changes(spark):
    stored = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "n")], "k int, n int, x string")
    new = spark.createDataFrame([(1, 1, "A"), (3, 1, "D"), (3, 1, "D"), (None, 2, "N")], "k int, n int, x string")
    assert rows(T.replaced(stored, new, "k")) == sorted([(2, 1, "c"), (None, 1, "n"), (1, 1, "A"), (3, 1, "D"), (3, 1, "D"), (None, 2, "N")], key=repr)
    once = T.inserted(stored, new.where("k IS NOT NULL"), ["k", "n"])
    assert rows(once) == sorted([(1, 1, "a"), (1, 2, "b"), (2, 1, "c"), (None, 1, "n"), (3, 1, "D")], key=repr)
    assert rows(T.inserted(once, new.where("k IS NOT NULL"), ["k", "n"])) == rows(once)
    assert rows(T.moved(stored, spark.createDataFrame([(2, 9), (2, 8)], "k int, n int"), "k", "n")) == sorted([(1, 1, "a"), (1, 2, "b"), (2, 9, "c"), (None, 1, "n")], key=repr)
    for empty in (T.replaced(stored.limit(0), new.limit(0), "k"), T.inserted(stored.limit(0), new.limit(0), ["k"])):
        assert empty.count() == 0


def test_replayed(spark):
    steps = [("a", 1, "search", 9000, 1), ("a", 2, "search", 7000, 1), ("a", 3, "answer", 1, 1), ("b", 1, "answer", 1, 1), ("b", 2, "search", 1, 1), ("c", 1, "search", None, 9000), ("c", 2, "search", 1, 1), ("d", 1, "search", 1, 1)]
    steps += [("e", i, "search", 1, 1) for i in range(9)]
    got = rows(T.replayed(spark.createDataFrame(steps, "run_id string, at int, action string, ms long, tokens long")))
    assert got == [("a", 2, 2, "time-budget"), ("b", 1, 0, "answer"), ("c", 1, 1, "token-budget"), ("d", 1, 1, "steps-done"), ("e", 3, 3, "search-budget")]


def test_wrong_dimensions_fail(spark):
    df = spark.createDataFrame([([1.0, 2.0],), ([1.0],)], "embedding array<double>")
    with pytest.raises(Exception, match="2 dimensions"):
        T.checked_vectors(df, 2).collect()
    assert T.checked_vectors(df.limit(1), 2).count() == 1


def test_layout_replaces_partitions_and_prunes(spark, tmp_path):
    path = str(tmp_path / "t")
    day = datetime.date(2024, 1, 1)
    first = spark.range(100).select(F.date_add(F.lit(day), (F.col("id") % 4).cast("int")).alias("day"), "id")
    T.write_replacing(first, path, ["day"], ["id"])
    T.write_replacing(first.where("id % 4 = 1").limit(3), path, ["day"], ["id"])
    back = spark.read.parquet(path)
    assert rows(back.groupBy("day").count(), "count") == [(25,), (25,), (25,), (3,)]
    plan = back.where((F.col("day") == day) & (F.col("id") > 5))._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "GreaterThan(id,5)" in plan


def docx(body):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as file:
        file.writestr(D.PART, f'<w:document xmlns:w="{D.W[1:-1]}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_word_files():
    p = lambda text, inner="": f"<w:p><w:pPr>{inner}</w:pPr><w:r><w:t>{text}</w:t></w:r></w:p>"
    cell = lambda *ps: f"<w:tc>{''.join(map(p, ps))}</w:tc>"
    table = f"<w:tbl><w:tr>{cell('a', 'b')}{cell('')}</w:tr><w:tr>{cell('c')}{cell('d')}</w:tr></w:tbl>"
    body = p("Lead") + p("First", '<w:pStyle w:val="Heading2"/>') + p("one", "<w:numPr/>") + table + p("Deep", '<w:pStyle w:val="heading 4"/>')
    body += "<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t></w:r><w:del><w:r><w:delText>gone</w:delText></w:r></w:del></w:p>" + p("Next", '<w:pStyle w:val="Title"/>')
    want = [[("Text", "Lead")], [("Section-header", "First"), ("List-item", "one"), ("Table", "a b | \nc | d"), ("Section-header", "Deep"), ("Text", "x y")], [("Section-header", "Next")]]
    assert D.docx_sections(docx(body)) == want
    whole = docx(body)
    for bad in (None, b"", b"PK\x03\x04", whole[:-40], docx("<w:p>"), docx("")):
        assert D.docx_sections(bad) == [[]]
    long = "w" * 50 + "\n"
    assert len(D.docx_sections(D.as_docx(long * 50_000))[0]) == 50_000
    assert D.docx_sections(D.as_docx("# A <b>&\n\x00\x0bz\n\n## B")) == [[("Section-header", "A <b>&"), ("Text", "\ufffd\ufffdz")], [("Section-header", "B")]]


def test_word_files_in_a_table(spark):
    texts = spark.createDataFrame([(1, "# T\nbody", 9), (2, None, 9), (3, "", 9), (None, "x", 9)], "id long, text string, data int")
    files = D.docx_files(texts, "id", "text")
    assert rows(L.elements(files, "id", "data", D.docx_sections)) == sorted([(1, 0, 0, "Section-header", "T"), (1, 0, 1, "Text", "body"), (None, 0, 0, "Text", "x")], key=repr)
    assert L.elements(D.docx_files(texts.limit(0), "id", "text"), "id", "data", D.docx_sections).count() == 0


def test_evaluation_files(spark, tmp_path):
    for i, grade in enumerate([{"reviewed": True, "completeness": 3, "claims": [{"sentence": 1, "text": "a", "faithfulness": 4}]}, {"reviewed": False, "completeness": 1, "claims": []}, None]):
        (tmp_path / f"{i}.json").write_text(json.dumps({"question_id": str(i), "answer": "x", "more": 1, "grade": grade}, indent=1))
    (tmp_path / "notes.txt").write_text("no JSON")
    assert rows(D.graded_answers(spark, str(tmp_path)), "question_id") == [("0",)]
    assert rows(D.graded_answers(spark, str(tmp_path), drafts=True), "question_id") == [("0",), ("1",)]
    D.write_results(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "out"))
    D.write_results(spark.createDataFrame([(2, None)], "a int, b string").coalesce(1), str(tmp_path / "out"))
    assert [x for f in (tmp_path / "out").glob("*.json") for x in f.read_text().splitlines()] == ['{"a":2,"b":null}']
