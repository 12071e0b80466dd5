"""Pages, chunks, answers and the retrieval chain over the test tables, with SQL where it can express the result.

lineitem stands for lines and positions of pages, documents and pages for texts, benchmark for questions.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers as A
from ..functions import rules
from ..operators import drawings as W
from ..operators import evaluation as E
from ..operators import pages as P
from ..operators import regions as G
from ..operators import retrieval as R
from ..operators import sections as S
from ..sources import loaders as L
from ..sources.shared import dealt
from .catalog import chunks, questions, read, vectors


#: Lines that a task works pages out of: a sort of their elements takes some 100 MB.
LINES = 250_000


def lines(spark, d):
    """Lines of pages: an order is a document, the line's status its page."""
    rows = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_linestatus", "l_suppkey", "l_partkey", "l_returnflag", "l_quantity")))
    text = F.concat(F.lit("Line "), F.when(F.col("l_suppkey") % 3 == 0, F.lit("of 7")).otherwise(F.concat("l_returnflag", F.lit(" "), F.col("l_partkey"))))
    top = F.col("l_linenumber") / 10
    return rows.select(
        F.col("l_orderkey").alias("doc_id"), F.when(F.col("l_linestatus") == "O", 1).otherwise(2).alias("page"), F.col("l_linenumber").alias("idx"), F.when(F.col("l_suppkey") % 11 > 0, F.lit(7.5) + F.col("l_suppkey") % 4).alias("size"),
        F.when(F.col("l_suppkey") % 13 == 0, F.concat(F.lit("Figure 2: "), text)).otherwise(text).alias("text"), top.alias("ymin"), (top + F.col("l_quantity") / 500).alias("ymax"),
    )


def body_sizes(spark, d):
    return P.body_size(lines(spark, d))


def classified_lines(spark, d):
    return P.classified_lines(lines(spark, d)).select("doc_id", "page", "idx", "type")


def layout_elements(spark, d):
    out = P.paragraphs(P.classified_lines(lines(spark, d)))
    return out.select("doc_id", "page", F.col("element").cast("int").alias("element"), "type", "text")


def items(spark, d, by_order=False):
    """by_order: an order's lines stand in one task."""
    rows = read(spark, d, "lineitem")
    if by_order:
        rows = dealt(rows.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_discount"), LINES, "l_orderkey")
    rows = rows.groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_quantity", "l_discount")))
    view = F.struct(F.lit(0.0).alias("x0"), F.lit(10.0).alias("y0"), F.lit(600.0).alias("x1"), F.lit(810.0).alias("y1"))
    return rows.select(
        F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("idx"), F.when(F.col("l_suppkey") % 10 > 0, "word").otherwise(" ").alias("str"), (F.col("l_partkey") % 560).cast("double").alias("x"), (F.col("l_suppkey") % 800 + 10).cast("double").alias("y"),
        (F.col("l_quantity") * 4 * F.when(F.col("l_discount") > 0.08, 0).otherwise(1)).alias("width"), (F.col("l_quantity") / 4).alias("height"), view.alias("view"), (F.col("l_linenumber") * 90 - 180).cast("double").alias("rotation"),
    )


def positioned_items(spark, d):
    out = P.positioned(items(spark, d))
    return out.select("doc_id", "idx", *(F.round(F.col("box")[k], 9).alias(k) for k in ("xmin", "ymin", "xmax", "ymax")))


def text_signals(spark, d):
    return P.text_signals(items(spark, d), 600.0, 800.0)


def normalised_pages(spark, d):
    # an order is a document: what is dealt as it is read needn't be dealt again
    rows = P.positioned(items(spark, d, by_order=True).withColumn("rotation", F.lit(0.0)))
    kinds = ["Text", "Table", "Caption", "Section-header", "Page-footer", "Picture", "Text"]
    kind = F.element_at(F.array(*map(F.lit, kinds)), F.col("idx"))
    text = F.concat(kind, F.lit(" "), (F.col("doc_id") % 3).cast("string"))
    out = P.normalised(rows.select("doc_id", "page", "idx", kind.alias("type"), text.alias("text"), "box"))
    return out.drop("box")


def normalised_chunks(spark, d):
    return L.element_chunks(normalised_pages(spark, d), 16, 4)


def words_on_pages(spark, d):
    """Every line is a word on its order's page, unlike any other; two lines make a chunk."""
    word = F.concat(F.lit("w"), (F.col("x") * 7 + F.col("y")).cast("int"), F.lit(" ."), F.col("idx"), F.lit(";"))
    rows = P.positioned(items(spark, d).withColumn("rotation", F.lit(0.0))).withColumn("str", word)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "str"))), lambda x: x["str"]), "\n")
    found = rows.groupBy("doc_id", "page", F.floor((F.col("idx") - 1) / 2).cast("int").alias("chunk_index")).agg(text.alias("content"))
    return rows.select("doc_id", "page", "idx", "str", "box"), found


def located_chunks(spark, d):
    its, found = words_on_pages(spark, d)
    return G.located(found, its).select("doc_id", "chunk_index", "idx")


def chunk_regions(spark, d):
    its, found = words_on_pages(spark, d)
    return G.with_boxes(found, its).select("doc_id", "chunk_index", F.size("boxes").alias("regions"), *(F.round(F.col("bbox")[k], 6).alias(k) for k in ("xmin", "ymin", "xmax", "ymax")))


def drawing_ops(spark, d):
    """Seven operators at most on an order's page: kept and restored matrices, pictures, rules, frames and small paths."""
    rows = read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_suppkey", "l_partkey")))
    pick = lambda n, *of: F.element_at(F.array(*map(F.lit, of)), (n + 1).cast("int"))
    op = pick(F.col("l_suppkey") % 9, "save", "transform", "restore", "constructPath", "rawFillPath", "constructPath", "paintImageXObject", "form-begin", "shadingFill")
    k = F.col("l_partkey") % 3
    matrix = F.when(k == 0, F.array(*map(F.lit, (0.0, 1.0, -1.0, 0.0, 600.0, 0.0)))).when(k == 1, F.array(*map(F.lit, (2.0, 0.0, 0.0, 2.0, 5.0, 5.0))))
    b = F.col("l_partkey") % 4
    bounds = F.when(b == 0, F.array(*map(F.lit, (0.0, 5.0, 500.0, 6.0)))).when(b == 1, F.array(*map(F.lit, (10.0, 10.0, 790.0, 590.0)))).when(b == 2, F.array(*map(F.lit, (5.0, 0.0, 6.0, 500.0))))
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.lit(1).alias("page"), F.col("l_linenumber").alias("seq"), op.alias("op"), matrix.alias("matrix"), bounds.alias("bounds"))


def drawing_signals(spark, d):
    return W.drawing_signals(drawing_ops(spark, d), F.lit(600.0), F.lit(800.0))


def page_signals(spark, d):
    """All that a page's route goes by, and the route."""
    words = P.text_signals(items(spark, d), 600.0, 800.0).join(items(spark, d).groupBy("doc_id", "page").agg(F.count(F.when(F.trim("str") != "", 1)).alias("items"), F.sum(F.length(F.trim("str"))).cast("long").alias("chars")), ["doc_id", "page"])
    rows = words.join(drawing_signals(spark, d), ["doc_id", "page"], "left").fillna(0, ["images", "paths"])
    return rows.withColumn("route", rules.page_route(F.col("chars"), F.col("columns"), F.col("items"), F.col("covered"), F.col("images"), F.col("paths")))


def document_pages(spark, d):
    """The parts of a document between form feeds, or its blank lines after each third: here each third paragraph ends a page."""
    parts = F.posexplode(F.split("text", "\n"))
    rows = read(spark, d, "documents").select("doc_id", parts.alias("i", "line"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"]), "\n\n")
    return rows.groupBy("doc_id", F.floor(F.col("i") / 20).cast("int").alias("page")).agg(text.alias("text"))


def page_chunks(spark, d):
    return L.page_chunks(document_pages(spark, d))


def html_chunks(spark, d):
    return L.section_chunks(L.elements(read(spark, d, "pages"), "page_id", "html", L.html_sections), "page_id", 128, 32)


def byte_formats(spark, d):
    data = F.when(F.col("page_id") % 5 == 0, F.concat(F.encode(F.lit("%PDF-1.7"), "UTF-8"), F.encode("url", "UTF-8"))).when(F.col("page_id") % 5 == 1, F.concat(F.unhex(F.lit("504B0304")), F.encode(F.when(F.col("page_id") % 2 == 0, "word/document.xml").otherwise("other.xml"), "UTF-8"), F.encode("url", "UTF-8"))).when(F.col("page_id") % 5 == 2, F.concat(F.unhex(F.lit("EFBBBF")), F.encode("url", "UTF-8"))).when(F.col("page_id") % 5 == 3, F.concat(F.unhex(F.lit("00")), F.encode("url", "UTF-8"))).otherwise(F.encode("html", "UTF-8"))
    rows = read(spark, d, "pages").select("page_id", data.alias("data"))
    return rows.select("page_id", L.format_of(F.col("data")).alias("format"), F.length(L.as_text(F.col("data"))).cast("long").alias("chars"))


def replies(spark, d):
    """Answers of some sentences with citations, and what a verifier replied."""
    rows = read(spark, d, "part")
    text = F.concat("p_name", F.lit(" costs 2."), F.col("p_size"), F.lit(". It is "), "p_type", F.lit("! [1] See "), "p_brand", F.lit(".[2][3]\n\nIs it?\" About "), F.col("p_size"), F.lit(" are left [4]. Page 7 says so"))
    reply = F.concat(F.lit("Sure: {\"unsupported\": ["), F.col("p_size") % 6, F.lit(", 2, \"3\", 2.5]}"))
    return rows.select("p_partkey", text.alias("text"), F.when(F.col("p_size") % 5 > 0, reply).alias("reply"))


def answer_sentences(spark, d):
    return replies(spark, d).select("p_partkey", F.posexplode(A.sentences(F.col("text"))).alias("i", "sentence")).select("p_partkey", (F.col("i") + 1).alias("place"), "sentence")


def verifier_requests(spark, d):
    return replies(spark, d).select("p_partkey", A.numbered(F.col("text")).alias("request"))


def stripped_answers(spark, d):
    out = replies(spark, d).select("p_partkey", A.without_unsupported(F.col("text"), A.verdict(F.col("reply"))).alias("s"))
    return out.select("p_partkey", "s.left", F.array_join(F.col("s.gone").cast("array<string>"), ",").alias("gone"), "s.sentences", "s.empty")


def unlabelled_numbers(spark, d):
    rows = replies(spark, d).join(read(spark, d, "part").select("p_partkey", F.concat(F.lit("axis 0 10 20 2."), F.col("p_size") % 9).alias("printed")), "p_partkey")
    return rows.select("p_partkey", A.without_unlabelled(F.col("text"), F.col("printed")).alias("s")).select("p_partkey", "s.reading", "s.redacted")


def reply_scores(spark, d):
    scores = F.concat(F.lit('think {"scores": 1} so {"scores": [{"id": 2, "score": '), F.col("p_size"), F.lit('}, {"id": "1", "score": 4}'), F.when(F.col("p_size") % 4 == 0, ', {"id": 1, "score": 0}').otherwise(""), F.lit("]}"))
    return A.mapped(read(spark, d, "part").select("p_partkey", scores.alias("reply")), "p_partkey", ["reply"], "scores string", lambda x: [(None if (s := A.rerank_scores(x, 2)) is None else ",".join(map(str, s)),)])


def merged_sections(spark, d):
    rows = lines(spark, d).select("doc_id", F.col("idx").alias("chunk_index"), F.col("page").alias("section"), F.concat(F.lit("tail "), F.floor((F.col("idx") - 1) / 2), F.lit("\n\n"), "text", F.lit("\n\ntail "), F.floor(F.col("idx") / 2)).alias("content"))
    return S.merged_runs(rows)


# the chain


def asked(spark, d):
    """Every benchmark item with the vector of its number, in two scopes."""
    own = read(spark, d, "embeddings").select(F.col("vec_id").alias("q_id"), "embedding")
    scopes = F.when(F.col("item_id") % 2 == 0, F.array(F.lit("en"), F.lit("de"))).otherwise(F.array(F.lit("fr"), F.lit("es"), F.lit("en")))
    return read(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), F.explode(scopes).alias("scope"), "text").join(own, "q_id")


def retrieve_chain(spark, d):
    docs = read(spark, d, "documents")
    places = docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_index"), F.col("lang").alias("section"), F.floor(F.col("n_chars") / 16).alias("token_count"))
    # a reranker's score of each passage; every fifth question's reranker fails
    score = F.when(F.col("q_id") % 5 != 0, (F.col("chunk_id") % 97 * 31 + F.col("q_id") * 7) % 97 / 97)
    return R.retrieve_sections(asked(spark, d), chunks(spark, d), vectors(spark, d), lambda pool: pool.withColumn("score", score), places)


def retrieve_parents(spark, d):
    """The chain with its evidence: every document is a chunk of its source, with a box or two; of 17 one is a figure and one was read from a picture."""
    docs = read(spark, d, "documents")
    n = F.col("doc_id") % 17
    side = lambda k: F.round((F.col("doc_id") * k % 50) / 100, 2)
    box = lambda k: F.struct(side(k).alias("xmin"), side(k + 1).alias("ymin"), (side(k) + 0.25).alias("xmax"), (side(k + 1) + 0.125).alias("ymax"))
    places = docs.select(
        F.col("doc_id").alias("chunk_id"), F.col("source").alias("doc_id"), F.col("doc_id").alias("chunk_index"), F.col("lang").alias("section"), F.col("lang").alias("heading"), F.floor(F.col("n_chars") / 16).alias("token_count"),
        F.when(n == 3, "figure").when(n == 5, "ocr").otherwise("text").alias("kind"), F.lit(1).alias("page"), F.substring("text", 1, 40).alias("content"), F.when(n > 1, F.array(box(3), box(7))).when(n == 1, F.slice(F.array(box(3)), 1, 0)).alias("boxes"), box(5).alias("bbox"),
    )
    score = F.when(F.col("q_id") % 5 != 0, (F.col("chunk_id") % 97 * 31 + F.col("q_id") * 7) % 97 / 97)
    rows = R.retrieve_sections(asked(spark, d), chunks(spark, d), vectors(spark, d), lambda pool: pool.withColumn("score", score), places, evidence=True)
    sides = F.array_join(F.transform("boxes", lambda b: F.concat_ws(",", *(F.round(b[k] * 1000).cast("int") for k in ("xmin", "ymin", "xmax", "ymax")))), " ")
    return rows.select("q_id", "place", "chunk_id", "members", F.md5("content").alias("content_md5"), "kind", "heading", F.array_join(F.col("member_ids").cast("array<string>"), ",").alias("member_ids"), sides.alias("boxes"))


def complement_scopes(spark, d):
    """What each question finds in all scopes but the right one, and how much of it belongs to that."""
    texts, held = chunks(spark, d), vectors(spark, d)
    asked_ = questions(spark, d).withColumn("right", F.col("scope"))
    others = texts.select("scope").distinct()
    out = R.retrieve(asked_.drop("scope").crossJoin(F.broadcast(others)).where("scope <> right"), texts, held, floor=0.0)  # a handful of scopes
    return E.complement(out, asked_.select("q_id", "right"), texts.select("chunk_id", "scope"))


_LINES = """l AS (
  SELECT l_orderkey AS doc_id, CASE WHEN max(l_linestatus) = 'O' THEN 1 ELSE 2 END AS page, l_linenumber AS idx, CASE WHEN max(l_suppkey) % 11 > 0 THEN 7.5::DOUBLE + max(l_suppkey) % 4 END AS size,
    CASE WHEN max(l_suppkey) % 13 = 0 THEN 'Figure 2: ' ELSE '' END || 'Line ' || CASE WHEN max(l_suppkey) % 3 = 0 THEN 'of 7' ELSE max(l_returnflag) || ' ' || max(l_partkey) END AS text,
    l_linenumber / 10 AS ymin, l_linenumber / 10 + max(l_quantity) / 500 AS ymax FROM lineitem GROUP BY l_orderkey, l_linenumber),
body AS (
  SELECT doc_id, body FROM (SELECT doc_id, round(size * 4) / 4 AS body, sum(length(text)) AS n, min({'page': page, 'idx': idx}) AS at_ FROM l WHERE size > 0 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, at_) = 1)"""
_TYPED = (
    _LINES
    + r""",
k AS (
  SELECT l.*, body, row_number() OVER (PARTITION BY doc_id, page ORDER BY idx) AS t, row_number() OVER (PARTITION BY doc_id, page ORDER BY idx DESC) AS b FROM l LEFT JOIN body USING (doc_id)),
f AS (SELECT *, CASE WHEN (t <= 2 OR b <= 2) AND (body IS NULL OR size < body) THEN CASE WHEN t <= 2 THEN 'top:' ELSE 'bottom:' END || lower(trim(regexp_replace(text, '\d+', '#', 'g'))) END AS key FROM k),
typed AS (
  SELECT f.* EXCLUDE (key, t, b), CASE WHEN again THEN CASE WHEN key LIKE 'top:%' THEN 'Page-header' ELSE 'Page-footer' END WHEN text LIKE 'Figure%' THEN 'Caption' WHEN size / body >= 1.4 THEN 'Title' WHEN size / body >= 1.12 THEN 'Section-header' ELSE 'Text' END AS type
  FROM f LEFT JOIN (SELECT doc_id, key, true AS again FROM f WHERE key IS NOT NULL GROUP BY 1, 2 HAVING count(DISTINCT page) > 1) USING (doc_id, key))"""
)
_ITEMS = """i AS (
  SELECT l_orderkey AS doc_id, l_linenumber AS idx, CASE WHEN max(l_suppkey) % 10 > 0 THEN 'word' ELSE ' ' END AS str, (max(l_partkey) % 560)::DOUBLE AS x, (max(l_suppkey) % 800 + 10)::DOUBLE AS y,
    max(l_quantity) * 4 * CASE WHEN max(l_discount) > 0.08 THEN 0 ELSE 1 END AS w, max(l_quantity) / 4 AS h, (l_linenumber * 90 + 180) % 360 AS turn FROM lineitem GROUP BY 1, 2)"""

ORACLE_SQL = {
    "body_sizes": f"WITH {_LINES} SELECT * FROM body",
    "classified_lines": f"WITH {_TYPED} SELECT doc_id, page, idx, type FROM typed",
    "layout_elements": f"""
WITH {_TYPED},
g AS (SELECT *, ymin - lag(ymax) OVER w AS gap, greatest(ymax - ymin, lag(ymax - ymin) OVER w) AS tall, lag(type) OVER w AS before FROM typed WINDOW w AS (PARTITION BY doc_id, page ORDER BY idx)),
e AS (SELECT *, sum(CASE WHEN type = 'Text' AND before = 'Text' AND gap >= tall * -0.3::DOUBLE AND gap <= tall * 0.6::DOUBLE THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page ORDER BY idx) AS element FROM g)
SELECT doc_id, page, element::INTEGER AS element, min(type) AS type, string_agg(text, chr(10) ORDER BY idx) AS text FROM e GROUP BY 1, 2, 3""",
    "positioned_items": f"""
WITH {_ITEMS},
c AS (
  SELECT *, CASE WHEN turn IN (90, 270) THEN 800 ELSE 600 END AS across, CASE WHEN turn IN (90, 270) THEN 600 ELSE 800 END AS down,
    CASE turn WHEN 0 THEN [x, x + w] WHEN 90 THEN [y - 10, y - 10 + h] WHEN 180 THEN [600 - x - w, 600 - x] ELSE [810 - y - h, 810 - y] END AS hs,
    CASE turn WHEN 0 THEN [810 - y - h, 810 - y] WHEN 90 THEN [x, x + w] WHEN 180 THEN [810 - y - h, 810 - y] ELSE [600 - x - w, 600 - x] END AS vs FROM i),
s AS (SELECT *, greatest(0, least(1, hs[1] / across)) AS x0, greatest(0, least(1, vs[1] / down)) AS y0, greatest(0, least(1, hs[2] / across)) AS x1, greatest(0, least(1, vs[2] / down)) AS y1 FROM c)
SELECT doc_id, idx, CASE WHEN fine THEN round(x0, 9) END AS xmin, CASE WHEN fine THEN round(y0, 9) END AS ymin, CASE WHEN fine THEN round(x1, 9) END AS xmax, CASE WHEN fine THEN round(y1, 9) END AS ymax
FROM (SELECT *, w > 0 AND h > 0 AND x0 < x1 AND y0 < y1 AS fine FROM s)""",
    "text_signals": f"""
WITH {_ITEMS},
n AS (SELECT doc_id, (x + w / 2) / 600 - lag((x + w / 2) / 600) OVER (PARTITION BY doc_id ORDER BY (x + w / 2) / 600) AS gap FROM i WHERE str = 'word' AND w / 600 <= 0.6)
SELECT doc_id, 1 AS page, 1 + coalesce(c, 0) AS columns, covered FROM (SELECT doc_id, least(1.0, round(sum(w * h) / 480000, 9)) AS covered FROM i GROUP BY 1) LEFT JOIN (SELECT doc_id, count(*) FILTER (WHERE gap > 0.15) AS c FROM n GROUP BY 1) USING (doc_id)""",
    "byte_formats": r"""
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'pdf' WHEN 1 THEN CASE WHEN page_id % 2 = 0 THEN 'docx' ELSE 'markdown' END WHEN 2 THEN 'markdown' WHEN 3 THEN NULL ELSE CASE WHEN regexp_matches(left(html, 4096), '(?i)<(!doctype html|html|head|body)[\s>]') THEN 'html' ELSE 'markdown' END END AS format,
  CASE page_id % 5 WHEN 0 THEN 8 + length(url) WHEN 1 THEN CASE WHEN page_id % 2 = 0 THEN 21 ELSE 13 END + length(url) WHEN 2 THEN length(url) WHEN 3 THEN NULL ELSE length(html) END AS chars FROM pages""",
    "retrieve_chain": """
WITH q AS (SELECT item_id AS q_id, CASE WHEN item_id % 2 = 0 THEN 40 ELSE 60 END AS offered, unnest(CASE WHEN item_id % 2 = 0 THEN ['en', 'de'] ELSE ['fr', 'es', 'en'] END) AS lang, text, embedding::DOUBLE[] AS qe FROM benchmark JOIN embeddings ON vec_id = item_id),
v AS (
  SELECT q_id, offered, vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], qe), 6) AS similarity FROM embeddings JOIN documents ON doc_id = vec_id JOIN q USING (lang)),
vr AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, chunk_id) AS r FROM v QUALIFY r <= offered),
t AS (SELECT DISTINCT q_id, offered, lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM q),
p AS (SELECT chunk_id, lang, term, count(*) AS n FROM (SELECT doc_id AS chunk_id, lang, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY 1, 2, 3),
lx AS (
  SELECT q_id, offered, chunk_id, round(sum(n)::DOUBLE * 0.1::DOUBLE, 6) AS score FROM t JOIN p USING (lang, term)
  WHERE term NOT IN ('a', 'an', 'and', 'are', 'as', 'at', 'be', 'by', 'for', 'from', 'has', 'have', 'in', 'is', 'it', 'its', 'of', 'on', 'or', 'that', 'the', 'this', 'to', 'was', 'were', 'will', 'with') GROUP BY 1, 2, 3),
lr AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, chunk_id) AS r FROM lx QUALIFY r <= offered),
fused AS (
  SELECT q_id, chunk_id, round(coalesce(1.0::DOUBLE / (60 + vr.r), 0) + coalesce(1.0::DOUBLE / (60 + lr.r), 0), 8) AS rrf FROM vr FULL JOIN lr USING (q_id, chunk_id)),
pool AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY rrf DESC, chunk_id) AS rank FROM fused QUALIFY rank <= 20),
seen AS (SELECT pool.*, coalesce((SELECT max(similarity) FROM v WHERE v.q_id = pool.q_id AND v.chunk_id = pool.chunk_id), 0) AS similarity, CASE WHEN q_id % 5 <> 0 THEN (chunk_id % 97 * 31 + q_id * 7) % 97 / 97 END AS score FROM pool),
ordered AS (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY coalesce(score, 0) DESC, rank) AS place FROM seen),
d AS (SELECT doc_id AS chunk_id, source, lang, floor(n_chars / 16) AS tokens, CASE WHEN lang IS DISTINCT FROM lag(lang) OVER (PARTITION BY source ORDER BY doc_id) THEN 1 ELSE 0 END AS new FROM documents),
runs AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY chunk_id) AS run FROM d),
whole AS (SELECT source, run, min(chunk_id) AS first, sum(tokens) AS tokens FROM runs GROUP BY 1, 2),
hits AS (
  SELECT q_id, place, chunk_id, similarity, source, run, first, whole.tokens <= 1536 AND count(*) OVER (PARTITION BY q_id, source, run) >= 2 AS parent
  FROM ordered JOIN runs USING (chunk_id) JOIN whole USING (source, run) WHERE similarity >= 0.35),
rows AS (SELECT q_id, min(place) AS best, CASE WHEN parent THEN first ELSE chunk_id END AS chunk, max(similarity) AS similarity, count(*) AS members FROM hits GROUP BY q_id, source, run, parent, chunk)
SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY best)::INTEGER AS place, chunk AS chunk_id, similarity, members FROM rows QUALIFY place <= 8""",
}

#: Elements of one text stand at most twice on these pages, so a repeat is one that overlaps the other.
ORACLE_SQL["normalised_pages"] = f"""
WITH {_ITEMS},
b AS (
  SELECT doc_id, idx, ['Text', 'Table', 'Caption', 'Section-header', 'Page-footer', 'Picture', 'Text'][idx] AS type, greatest(0, least(1, x / 600)) AS x0, greatest(0, least(1, (810 - y - h) / 800)) AS y0,
    greatest(0, least(1, (x + w) / 600)) AS x1, greatest(0, least(1, (810 - y) / 800)) AS y1 FROM i WHERE w > 0 AND h > 0),
e AS (SELECT *, type || ' ' || doc_id % 3 AS text, (x1 - x0) * (y1 - y0) AS area FROM b WHERE x0 < x1 AND y0 < y1),
o AS (
  SELECT * FROM e WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.doc_id = e.doc_id AND f.text = e.text AND f.idx < e.idx AND least(e.x1, f.x1) > greatest(e.x0, f.x0) AND least(e.y1, f.y1) > greatest(e.y0, f.y0)
    AND (least(e.x1, f.x1) - greatest(e.x0, f.x0)) * (least(e.y1, f.y1) - greatest(e.y0, f.y0)) / (e.area + f.area - (least(e.x1, f.x1) - greatest(e.x0, f.x0)) * (least(e.y1, f.y1) - greatest(e.y0, f.y0))) >= 0.3::DOUBLE)),
c1 AS (SELECT *, x1 - x0 > 0.6::DOUBLE AS wide, (x0 + x1) / 2 AS mid FROM o),
c2 AS (SELECT *, CASE WHEN NOT wide AND mid - lag(mid) OVER (PARTITION BY doc_id, wide ORDER BY mid, idx) > 0.15::DOUBLE THEN 1 ELSE 0 END AS far, sum(wide::INT) OVER (PARTITION BY doc_id ORDER BY y0, x0, idx) AS band FROM c1),
c3 AS (SELECT *, sum(far) OVER (PARTITION BY doc_id, wide ORDER BY mid, idx) AS col FROM c2),
c4 AS (SELECT *, CASE WHEN y0 - lag(y0) OVER (PARTITION BY doc_id, band, wide, col ORDER BY y0, idx) > 0.005::DOUBLE THEN 1 ELSE 0 END AS low FROM c3),
c5 AS (SELECT *, sum(low) OVER (PARTITION BY doc_id, band, wide, col ORDER BY y0, idx) AS line FROM c4),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY band, wide DESC, col, line, x0, idx) AS place FROM c5),
pairs AS (
  SELECT c.doc_id, c.place AS cp, a.place AS ap, c.text AS caption, coalesce((least(c.x1, a.x1) - greatest(c.x0, a.x0)) / least(c.x1 - c.x0, a.x1 - a.x0), 0) >= 0.5::DOUBLE AS near,
    greatest(0, a.y0 - c.y1, c.y0 - a.y1) AS gap, sqrt(pow((c.x0 + c.x1 - a.x0 - a.x1) / 2, 2) + pow((c.y0 + c.y1 - a.y0 - a.y1) / 2, 2)) AS far
  FROM r c JOIN r a USING (doc_id) WHERE c.type = 'Caption' AND a.type IN ('Table', 'Picture')),
to_ AS (SELECT *, CASE WHEN near THEN gap ELSE far END AS dist FROM pairs QUALIFY row_number() OVER (PARTITION BY doc_id, cp ORDER BY NOT near, dist, ap) = 1),
bound AS (SELECT doc_id, ap AS place, min_by(caption, cp) AS caption FROM to_ WHERE dist <= 0.25::DOUBLE GROUP BY 1, 2),
h AS (SELECT r.*, last_value(CASE WHEN type = 'Section-header' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place) AS heading FROM r)
SELECT doc_id, 1 AS page, (row_number() OVER (PARTITION BY doc_id ORDER BY h.place) - 1)::INTEGER AS place, type, text, heading, caption
FROM h LEFT JOIN bound USING (doc_id, place)
WHERE type NOT IN ('Section-header', 'Page-footer') AND NOT (type = 'Caption' AND EXISTS (SELECT 1 FROM bound z WHERE z.doc_id = h.doc_id AND z.caption = h.text))"""
ORACLE_SQL["retrieve_parents"] = (
    ORACLE_SQL["retrieve_chain"][: ORACLE_SQL["retrieve_chain"].index("d AS (SELECT doc_id AS chunk_id")]
    + """c AS (
  SELECT doc_id AS chunk_id, source, lang, floor(n_chars / 16) AS tokens, CASE doc_id % 17 WHEN 3 THEN 'figure' WHEN 5 THEN 'ocr' ELSE 'text' END AS kind, left(text, 40) AS content,
    list_transform(CASE WHEN doc_id % 17 <= 1 THEN [5] WHEN doc_id % 25 > 0 THEN [3, 7] ELSE [3] END, lambda k: concat_ws(',', doc_id * k % 50 * 10, doc_id * (k + 1) % 50 * 10, doc_id * k % 50 * 10 + 250, doc_id * (k + 1) % 50 * 10 + 125)) AS boxes FROM documents),
d AS (SELECT *, CASE WHEN lang IS DISTINCT FROM lag(lang) OVER (PARTITION BY source ORDER BY chunk_id) THEN 1 ELSE 0 END AS new FROM c WHERE kind <> 'figure'),
runs AS (SELECT * EXCLUDE (new), sum(new) OVER (PARTITION BY source ORDER BY chunk_id) AS run FROM d UNION ALL SELECT *, NULL FROM c WHERE kind = 'figure'),
whole AS (
  SELECT source, run, min(chunk_id) AS first, sum(tokens) AS tokens, string_agg(content, chr(10) || chr(10) ORDER BY chunk_id) AS content, CASE WHEN bool_or(kind = 'ocr') THEN 'ocr' ELSE 'text' END AS kind,
    string_agg(chunk_id, ',' ORDER BY chunk_id) AS member_ids, string_agg(array_to_string(boxes, ' '), ' ' ORDER BY chunk_id) AS boxes FROM runs WHERE run IS NOT NULL GROUP BY 1, 2),
hits AS (
  SELECT q_id, place, r.*, first, whole.content AS w_content, whole.kind AS w_kind, member_ids, whole.boxes AS w_boxes, coalesce(whole.tokens <= 1536 AND count(*) OVER (PARTITION BY q_id, r.source, r.run) >= 2, false) AS parent
  FROM ordered JOIN runs r USING (chunk_id) LEFT JOIN whole ON whole.source = r.source AND whole.run = r.run WHERE similarity >= 0.35),
rows AS (
  SELECT q_id, min(place) AS best, CASE WHEN parent THEN first ELSE chunk_id END AS chunk, count(*) AS members, any_value(CASE WHEN parent THEN w_content ELSE content END) AS content, any_value(CASE WHEN parent THEN w_kind ELSE kind END) AS kind,
    any_value(lang) AS heading, any_value(CASE WHEN parent THEN member_ids END) AS member_ids, any_value(CASE WHEN parent THEN w_boxes ELSE array_to_string(boxes, ' ') END) AS boxes FROM hits GROUP BY q_id, source, run, parent, chunk)
SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY best)::INTEGER AS place, chunk AS chunk_id, members, md5(content) AS content_md5, kind, heading, member_ids, boxes FROM rows QUALIFY place <= 8"""
)
ORACLE_SQL["merged_sections"] = f"""
WITH {_LINES},
c AS (SELECT *, 'tail ' || floor((idx - 1) / 2)::INT AS head, 'tail ' || floor(idx / 2)::INT AS tail FROM l),
r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY idx) AS run FROM (SELECT *, CASE WHEN page = lag(page) OVER (PARTITION BY doc_id ORDER BY idx) THEN 0 ELSE 1 END AS new FROM c)),
s AS (SELECT *, lag(tail) OVER (PARTITION BY doc_id, run ORDER BY idx) AS before FROM r)
SELECT doc_id, run::BIGINT AS run, string_agg(CASE WHEN before IS NULL THEN head || chr(10) || chr(10) WHEN before = head THEN chr(10) || chr(10) ELSE chr(10) || chr(10) || head || chr(10) || chr(10) END || text || chr(10) || chr(10) || tail, '' ORDER BY idx) AS content FROM s GROUP BY 1, 2"""
ORACLE_SQL["located_chunks"] = "SELECT DISTINCT l_orderkey AS doc_id, ((l_linenumber - 1) // 2)::INTEGER AS chunk_index, l_linenumber AS idx FROM lineitem"
_SENTENCES = """r AS (
  SELECT p_partkey, p_size, [p_name || ' costs 2.' || p_size || '.', ' It is ' || p_type || '! [1]', ' See ' || p_brand || '.[2][3]' || chr(10) || chr(10), 'Is it?"', ' About ' || p_size || ' are left [4].', ' Page 7 says so'] AS s,
    CASE WHEN p_size % 5 > 0 THEN [p_size % 6, 2, 3] ELSE [] END AS bad FROM part)"""
ORACLE_SQL |= {
    "answer_sentences": f"WITH {_SENTENCES} SELECT p_partkey, generate_subscripts(s, 1)::INTEGER AS place, unnest(s) AS sentence FROM r",
    "verifier_requests": f"WITH {_SENTENCES} SELECT p_partkey, string_agg('S' || i || ': ' || trim(replace(x, chr(10), '')), chr(10) ORDER BY i) AS request FROM (SELECT p_partkey, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM r) GROUP BY 1",
    "stripped_answers": f"""
WITH {_SENTENCES}, x AS (SELECT *, unnest(s) AS x, generate_subscripts(s, 1) AS i FROM r), y AS (SELECT *, list_contains(bad, i) AS out FROM x)
SELECT p_partkey, CASE WHEN len(any_value(bad)) = 0 THEN string_agg(x, '' ORDER BY i) ELSE trim(coalesce(string_agg(x, '' ORDER BY i) FILTER (WHERE NOT out), ''), ' ' || chr(10)) END AS left,
  coalesce(string_agg(CASE i WHEN 2 THEN '1' WHEN 3 THEN '2,3' ELSE '4' END, ',' ORDER BY i) FILTER (WHERE out AND i IN (2, 3, 5)), '') AS gone,
  count(*) FILTER (WHERE out)::INTEGER AS sentences, count(*) FILTER (WHERE NOT out AND i IN (2, 3, 5)) = 0 AS empty FROM y GROUP BY 1""",
    "unlabelled_numbers": rf"""
WITH {_SENTENCES},
t AS (
  SELECT p_partkey, ['0', '10', '20', '2.' || p_size % 9] AS known,
    regexp_extract_all(array_to_string(s, ''), '(?is)page 7|\b(?:about )?[0-9]+(?:[.][0-9]+)?\b|.') AS parts FROM r),
m AS (SELECT p_partkey, list_transform(parts, lambda x: CASE WHEN regexp_matches(x, '^([Aa]bout )?[0-9]') AND NOT list_contains(known, regexp_extract(x, '[0-9.]+$')) THEN '[unlabelled]' ELSE x END) AS p FROM t)
SELECT p_partkey, array_to_string(p, '') AS reading, len(list_filter(p, lambda x: x = '[unlabelled]'))::INTEGER AS redacted FROM m""",
    "reply_scores": "SELECT p_partkey, CASE WHEN p_size % 4 <> 0 THEN '0.4,' || (least(p_size, 10) / 10)::DOUBLE END AS scores FROM part",
}
ORACLE_SQL["stream_logs"] = """
SELECT CASE WHEN event_id % 8 < 6 THEN ['agent', 'inference', 'retrieval', 'ingestion', 'auth', 'settings'][event_id % 8 + 1] WHEN user_id % 2 = 0 THEN 'ingestion' ELSE 'system' END AS category, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY 1"""
_CHAIN = ORACLE_SQL["retrieve_chain"].replace("CASE WHEN item_id % 2 = 0 THEN 40 ELSE 60 END AS offered", "20 AS offered").replace("unnest(CASE WHEN item_id % 2 = 0 THEN ['en', 'de'] ELSE ['fr', 'es', 'en'] END) AS lang", "'en' AS lang")
ORACLE_SQL["hybrid_retrieve"] = (
    _CHAIN[: _CHAIN.index("fused AS (")]
    + """fused AS (
  SELECT q_id, chunk_id, round(coalesce(1.0::DOUBLE / (60 + vr.r), 0) + coalesce(1.0::DOUBLE / (60 + lr.r), 0), 8) AS rrf,
    CASE WHEN lr.r IS NULL THEN 'vector' WHEN vr.r IS NULL THEN 'lexical' ELSE 'both' END AS source FROM vr FULL JOIN lr USING (q_id, chunk_id)),
pool AS (SELECT * FROM fused QUALIFY row_number() OVER (PARTITION BY q_id ORDER BY rrf DESC, chunk_id) <= 20),
seen AS (SELECT pool.*, coalesce((SELECT max(similarity) FROM v WHERE v.q_id = pool.q_id AND v.chunk_id = pool.chunk_id), 0) AS similarity FROM pool)
SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY rrf DESC, chunk_id)::INTEGER AS rank, chunk_id, similarity, rrf, source FROM seen WHERE similarity >= 0 QUALIFY rank <= 8"""
)

_MACHINE = """RECURSIVE d AS (SELECT l_orderkey AS k, l_linenumber AS l, max(l_suppkey) AS s, max(l_partkey) AS p FROM lineitem GROUP BY 1, 2),
o AS (
  SELECT k, row_number() OVER (PARTITION BY k ORDER BY l) AS n, ['save', 'transform', 'restore', 'constructPath', 'rawFillPath', 'constructPath', 'paintImageXObject', 'form-begin', 'shadingFill'][s % 9 + 1] AS op,
    CASE p % 3 WHEN 0 THEN [0, 1, -1, 0, 600, 0]::DOUBLE[] WHEN 1 THEN [2, 0, 0, 2, 5, 5]::DOUBLE[] END AS t, CASE p % 4 WHEN 0 THEN [0, 5, 500, 6]::DOUBLE[] WHEN 1 THEN [10, 10, 790, 590]::DOUBLE[] WHEN 2 THEN [5, 0, 6, 500]::DOUBLE[] END AS b FROM d),
m AS (
  SELECT DISTINCT k, 0::BIGINT AS n, [1, 0, 0, 1, 0, 0]::DOUBLE[] AS c, []::DOUBLE[][] AS st, 0 AS images, 0 AS paths FROM o
  UNION ALL
  SELECT k, n, CASE WHEN op = 'restore' THEN coalesce(st[len(st)], [1, 0, 0, 1, 0, 0]::DOUBLE[]) WHEN op IN ('transform', 'form-begin') AND t IS NOT NULL
      THEN [t[1] * c[1] + t[2] * c[3], t[1] * c[2] + t[2] * c[4], t[3] * c[1] + t[4] * c[3], t[3] * c[2] + t[4] * c[4], t[5] * c[1] + t[6] * c[3] + c[5], t[5] * c[2] + t[6] * c[4] + c[6]] ELSE c END,
    CASE WHEN op = 'restore' THEN st[:greatest(len(st) - 1, 0)] WHEN op IN ('save', 'form-begin') THEN list_append(st, c) ELSE st END, images + (op = 'paintImageXObject')::INT,
    paths + (op = 'shadingFill' OR op IN ('constructPath', 'rawFillPath') AND NOT coalesce(w >= 0.6::DOUBLE AND h <= 0.01::DOUBLE OR w >= 0.8::DOUBLE AND h >= 0.8::DOUBLE, false))::INT
  FROM (
    SELECT o.*, m.c, m.st, m.images, m.paths, (greatest(c[1] * b[1] + c[3] * b[2], c[1] * b[3] + c[3] * b[2], c[1] * b[1] + c[3] * b[4], c[1] * b[3] + c[3] * b[4]) - least(c[1] * b[1] + c[3] * b[2], c[1] * b[3] + c[3] * b[2], c[1] * b[1] + c[3] * b[4], c[1] * b[3] + c[3] * b[4])) / 600 AS w,
      (greatest(c[2] * b[1] + c[4] * b[2], c[2] * b[3] + c[4] * b[2], c[2] * b[1] + c[4] * b[4], c[2] * b[3] + c[4] * b[4]) - least(c[2] * b[1] + c[4] * b[2], c[2] * b[3] + c[4] * b[2], c[2] * b[1] + c[4] * b[4], c[2] * b[3] + c[4] * b[4])) / 800 AS h
    FROM m JOIN o ON o.k = m.k AND o.n = m.n + 1)),
w AS (SELECT k AS doc_id, images, paths FROM m QUALIFY row_number() OVER (PARTITION BY k ORDER BY n DESC) = 1)"""
ORACLE_SQL["drawing_signals"] = f"WITH {_MACHINE} SELECT doc_id, 1 AS page, images::INTEGER AS images, paths::INTEGER AS paths FROM w"
ORACLE_SQL["page_signals"] = f"""
WITH {_MACHINE}, x AS ({ORACLE_SQL["text_signals"]}),
i AS (SELECT l_orderkey AS doc_id, count(*) FILTER (WHERE s % 10 > 0) AS items, sum(CASE WHEN s % 10 > 0 THEN 4 ELSE 0 END)::BIGINT AS chars FROM (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS s FROM lineitem GROUP BY 1, 2) GROUP BY 1)
SELECT x.doc_id, x.page, columns, covered, items, chars, images::INTEGER AS images, paths::INTEGER AS paths,
  CASE WHEN chars < 60 THEN 'no-text' WHEN columns >= 2 OR covered > 0 AND items / (covered * 100) >= 10 THEN 'structured' WHEN images >= 1 OR paths >= 6 THEN 'image-heavy' ELSE 'clean-text' END AS route
FROM x JOIN i USING (doc_id) JOIN w USING (doc_id)"""
# the questions in every scope but their own
ORACLE_SQL["complement_scopes"] = (
    "WITH f AS ("
    + ORACLE_SQL["hybrid_retrieve"].replace("'en' AS lang", "unnest(['de', 'es', 'fr']) AS lang")
    + ") SELECT f.q_id, count(*) AS found, count(*) FILTER (WHERE documents.lang = 'en') AS leaked, max(similarity) AS best FROM f JOIN documents ON doc_id = chunk_id GROUP BY 1"
)

QUERIES = {
    f.__name__: f
    for f in (
        body_sizes, classified_lines, layout_elements, positioned_items, text_signals, normalised_pages, normalised_chunks, located_chunks, chunk_regions, drawing_signals, page_signals, page_chunks, html_chunks, byte_formats, answer_sentences, verifier_requests, stripped_answers, unlabelled_numbers, reply_scores, merged_sections, retrieve_chain, retrieve_parents, complement_scopes,
    )
}
