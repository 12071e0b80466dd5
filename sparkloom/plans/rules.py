"""Rules, joins, listings, control tables and evaluation scores over the test tables, with SQL for the same results.

part stands for documents and search entries, customer for users and questions, orders for runs and documents, lineitem for chunks, spans,
boxes and pages.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules as R
from ..functions import text as X
from ..operators import scores as E
from ..operators import telemetry as O
from ..operators import tenancy as T
from .catalog import read

# keys, labels, formats


def search_keys(spark, d):
    mixed = F.concat_ws("/", "p_name", "p_type", "p_brand")
    return read(spark, d, "part").select("p_partkey", R.same_search_key(mixed).alias("search_key"), R.slug(mixed).alias("slug"), R.tool_name(F.col("p_type"), mixed).alias("tool"), R.short_model_name(mixed).alias("short"), R.text_key(F.concat(F.lit("**#"), mixed, F.lit("`  \n"))).alias("text_key"))


def fenced_texts(spark, d):
    text = F.concat(F.lit("<<<<"), "p_name", F.lit(">>>F1 "), "p_type", F.lit("<<F1>>>>>>"))
    return read(spark, d, "part").select("p_partkey", R.neutralise_fence(text, F.lit("F1")).alias("text"))


def formatted(spark, d):
    ms = F.when(F.col("l_linenumber") < 7, (F.col("l_partkey") * F.col("l_linenumber") * F.col("l_linenumber") * 17))
    dollars = F.when(F.col("l_linenumber") == 1, 0.0).when(F.col("l_linenumber") < 4, F.col("l_partkey") / 64.0).when(F.col("l_linenumber") < 7, F.col("l_quantity") / 4096)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R.duration(ms).alias("duration"), R.usd(dollars).alias("usd"))


def doc_snippets(spark, d):
    text = F.concat(F.repeat(F.concat("p_type", F.lit(" ")), F.col("p_size")), "p_name", F.lit(" zebra "), F.repeat(F.concat("p_brand", F.lit(" ")), F.col("p_size")))
    return read(spark, d, "part").select("p_partkey", R.snippet(text, ["zebra", "quagga"]).alias("snippet"))


def indexed_texts(spark, d):
    heading = F.when(F.col("p_size") % 2 == 0, F.col("p_type"))
    return read(spark, d, "part").select("p_partkey", R.indexed_text(heading, F.when(F.col("p_size") % 3 == 0, F.col("p_brand")), F.col("p_name")).alias("text"), R.passage(F.col("p_name"), F.col("p_size"), F.col("p_type")).alias("passage"), X.embedding_text(F.concat("p_name", F.lit("--v_2")), heading, F.lit(None).cast("string"), F.col("p_brand")).alias("embedded"))


def repaired_tables(spark, d):
    tail = F.element_at(F.array(F.lit("\\end{tabular}"), F.lit("\\end{tab"), F.lit("\\end{"), F.lit("a & b  \n"), F.lit("\\end{tabular} \n")), F.col("p_size") % 5 + 1)
    text = F.when(F.col("p_size") % 7 == 0, F.concat("p_name", F.lit("  "))).otherwise(F.concat(F.lit("\\begin{tabular}\n"), "p_name", tail))
    return read(spark, d, "part").select("p_partkey", R.repaired_table(text).alias("text"), R.truncated_table(text).alias("truncated"))


# boxes


def boxes(spark, d):
    line = read(spark, d, "lineitem")
    box = lambda a, b: F.struct((F.col(a) * 10 - 0.03).alias("xmin"), (F.col(b) * 8 - 0.01).alias("ymin"), (F.col(a) * 4 + F.col("l_quantity") / 64).alias("xmax"), (F.col(b) * 2 + F.col("l_linenumber") / 6).alias("ymax"))
    return line.select("l_orderkey", "l_linenumber", box("l_discount", "l_tax").alias("a"), box("l_tax", "l_discount").alias("b"))


def box_rules(spark, d):
    a, b, u = F.col("a"), F.col("b"), R.union(F.col("a"), F.col("b"))
    crop = R.crop(a, F.lit(800), F.lit(1100))
    return boxes(spark, d).select(
        "l_orderkey", "l_linenumber", R.usable(a).alias("usable"), F.round(R.area(u), 9).alias("area"), R.describable(a, 0.25).alias("describable"),
        F.round(R.overlap_ratio(a["xmin"], a["xmax"], b["xmin"], b["xmax"]), 9).alias("overlap"), crop["left"].cast("long").alias("left"), crop["top"].cast("long").alias("top"), crop["width"].cast("long").alias("width"), crop["height"].cast("long").alias("height"),
    )


def citation_boxes(spark, d):
    some = F.when(F.col("l_linenumber") % 3 == 0, F.array().cast("array<struct<xmin:double,ymin:double,xmax:double,ymax:double>>")).when(F.col("l_linenumber") % 3 == 1, F.array("a", "b", "a"))
    out = R.citation_boxes(some, F.when(F.col("l_linenumber") % 2 == 0, F.col("b")))
    return boxes(spark, d).select("l_orderkey", "l_linenumber", F.size(out).cast("long").alias("n"), F.round(F.aggregate(out, F.lit(0.0), lambda s, x: s + x["xmax"] - x["xmin"]), 9).alias("width"))


# documents, uploads, addresses

MIMES = ["application/pdf", "text/html", "text/markdown", "image/png", ""]


def mime(key):
    return F.when(F.col(key) % 6 < 5, F.element_at(F.array(*map(F.lit, MIMES)), (F.col(key) % 6 + 1).cast("int")))


def loader_formats(spark, d):
    return read(spark, d, "orders").select("o_orderkey", R.loader_of(mime("o_orderkey")).alias("loader"), R.section_unit(mime("o_orderkey")).alias("unit"))


def upload_checks(spark, d):
    size = (F.col("o_totalprice") * 60).cast("long") - 200_000
    return read(spark, d, "orders").select("o_orderkey", R.upload_error(size, F.coalesce(mime("o_orderkey"), F.lit("None")), F.col("o_custkey") * 40_000, 20 << 20, MIMES[:3], 50 << 20).alias("error"))


def address_checks(spark, d):
    octet = lambda a: F.col(a).cast("long")
    first = F.element_at(F.array(*(F.lit(x) for x in ("10", "100", "172", "192.168", "198", "8", "203.0", "224", "169.254", "1"))), (F.col("l_linenumber") + F.col("l_suppkey") % 3).cast("int"))
    rest = F.when(F.contains(first, F.lit(".")), F.concat_ws(".", octet("l_partkey") % 256, octet("l_suppkey") % 256)).otherwise(F.concat_ws(".", octet("l_partkey") % 130, octet("l_suppkey") % 256, octet("l_linenumber")))
    url = F.concat(F.element_at(F.array(*(F.lit(x) for x in ("http://", "https://", "ftp://", "HTTP://a@", "", "https://docs."))), (F.col("l_suppkey") % 6 + 1).cast("int")), F.lit("Site"), F.col("l_linenumber"), F.lit(".org"), F.element_at(F.array(*(F.lit(x) for x in ("", ":80", ":443", "/a:b@c", ":8080/x"))), (F.col("l_partkey") % 5 + 1).cast("int")))
    address = F.concat_ws(".", first, rest)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", R.public_v4(address).alias("public"), R.url_error(url, ["site1.org", "site2.org", "site3.org"]).alias("error"))


# joins, listings, control tables


def documents(spark, d):
    state = F.element_at(F.array(F.lit("ready"), F.lit("failed"), F.lit("processing"), F.lit("ready")), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return read(spark, d, "orders").select(
        F.col("o_orderkey").alias("document_id"), F.concat(F.lit("Doc "), F.col("o_orderpriority"), F.lit(" "), F.col("o_orderkey")).alias("title"), (F.col("o_custkey") % 7).alias("owner_id"), (F.col("o_custkey") % 25).cast("int").alias("base_id"),
        F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderkey")).alias("file_id"), state.alias("status"), (F.col("o_custkey") % 5).alias("attempts"), F.col("o_orderdate").alias("leased_at"),
    )


def lines(spark, d):
    """One row an order and line number."""
    return read(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")))


def chunks(spark, d):
    return lines(spark, d).select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("chunk_id"), F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk_index"), (F.col("l_suppkey") % 4).alias("page"), F.col("l_quantity").alias("score"))


def files(spark, d):
    return read(spark, d, "orders").where("o_orderkey % 3 = 1").select(F.col("o_orderkey").alias("file_id"), mime("o_orderkey").alias("mime"))


def bases(spark, d):
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("base_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("owner_id"))


def retrieved_rows(spark, d):
    c = chunks(spark, d)
    fused = c.where("page = 1").select((F.col("document_id") % 50).alias("q_id"), F.col("chunk_index").alias("rank"), "chunk_id")
    return T.with_documents(fused, c, documents(spark, d), files(spark, d))


def listed_documents(spark, d):
    return T.listed(documents(spark, d), bases(spark, d), files(spark, d))


def citation_lookup(spark, d):
    return T.citation(chunks(spark, d), documents(spark, d).select("document_id", "title", "owner_id", "file_id"), files(spark, d), 3)


def users_with_roles(spark, d):
    users = read(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    links = read(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("role_id"))
    roles = spark.createDataFrame([("O", "open"), ("F", "done")], "role_id string, name string")
    return T.nested(users, links, roles, "user_id", "role_id", "name").select("user_id", F.array_join("names", ",").alias("roles"))


def backfilled_bases(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") > 2, F.col("l_suppkey")).alias("base"))
    parents = read(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("base"))
    return T.back_filled(rows, parents, "l_orderkey", "base")


def conversation_scope(spark, d):
    talks = read(spark, d, "conversations").select("conv_id", (F.col("conv_id") % 5).cast("int").alias("owner_id"))
    return T.scope_links(talks, bases(spark, d), "owner_id")


def attached_vectors(spark, d):
    v = read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"))
    c = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("owner_id"), F.col("source").alias("base_id"))
    return T.attached(v.unionAll(v), c, v.where("chunk_id % 3 = 0"))


def activation_guard(spark, d):
    return T.activation(read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id")), read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id")))


def section_pages(spark, d):
    c = chunks(spark, d)
    wanted = c.groupBy("document_id", "page").count().where("count >= 2")
    return T.section_pages(c, wanted).select("document_id", "page", "chunk_index", "chunk_id")


def whole_document(spark, d):
    c = chunks(spark, d)
    return T.chosen(c, c.where("page = 2").select("document_id", "chunk_index")).select("document_id", "chunk_index", "chunk_id", "similarity")


def document_list(spark, d):
    pages = chunks(spark, d).groupBy("document_id").agg(F.count("*").alias("chunks"), F.countDistinct("page").alias("pages"))
    outcome = F.when(F.col("document_id") % 9 == 0, "failed").otherwise("text")
    record = F.when(F.col("document_id") % 2 == 0, F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.when(i == 2, outcome).otherwise("text")))
    rows = documents(spark, d).join(pages, "document_id", "left")
    return rows.select("document_id", F.coalesce("chunks", F.lit(0)).alias("chunks"), T.partially_indexed(F.col("document_id") % 14 == 0, record, F.coalesce("pages", F.lit(0))).alias("partial"))


def newest_runs(spark, d):
    return T.newest(read(spark, d, "orders").select("o_orderkey", "o_orderdate"), "o_orderdate", "o_orderkey", 50)


def latest_versions(spark, d):
    return T.latest(read(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus"), ["o_custkey"], "o_orderkey")


def cascade_delete(spark, d):
    gone = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("document_id"))
    return T.without(chunks(spark, d), gone, "document_id").select("chunk_id")


def index_differences(spark, d):
    a, b = read(spark, d, "documents").select(F.col("doc_id").alias("id")), read(spark, d, "embeddings").select((F.col("vec_id") * 2).alias("id"))
    return T.differences(a, b, "id")


def spans(spark, d):
    return lines(spark, d).select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("key"), F.when(F.col("l_linenumber") > 1, F.floor(F.col("l_linenumber") / 2).cast("int")).alias("parent_key"), F.col("l_returnflag").alias("step"), F.col("l_linestatus").alias("model"), F.col("l_quantity").cast("long").alias("tokens"))


def run_details(spark, d):
    prices = spark.createDataFrame([("O", 2.5)], "model string, price double")
    return T.run_detail(read(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), "o_orderstatus"), spans(spark, d), prices)


def span_trees(spark, d):
    return T.span_tree(spans(spark, d))


def span_annotations(spark, d):
    calls = lines(spark, d).select(F.col("l_orderkey").alias("run_id"), (F.col("l_linenumber") % 2).alias("key"), F.col("l_linenumber").alias("at"), F.when(F.col("l_suppkey") % 3 > 0, F.col("l_returnflag")).alias("model"), F.when(F.col("l_suppkey") % 2 > 0, F.col("l_quantity").cast("long")).alias("tokens"))
    return T.annotated(calls)


def ingestion_kpis(spark, d):
    counts = chunks(spark, d).groupBy("document_id").agg(F.count("*").alias("chunks"), F.countDistinct("page").alias("pages"))
    return T.ingestion_kpis(documents(spark, d).join(counts, "document_id", "left"))


def stranded_documents(spark, d):
    return T.stranded(documents(spark, d), F.to_timestamp_ntz(F.lit("1995-06-01 00:00:00"))).select("document_id", "attempts")


def citations(spark, d):
    rows = chunks(spark, d).select((F.col("document_id") % 97).alias("q_id"), (F.col("document_id") * 8 + F.col("chunk_index")).alias("rank"), "chunk_id", (F.col("document_id") % 11).alias("document_id"), "page", (F.col("score") / 51).alias("similarity"))
    return T.stored_citations(rows)


def grouped_citations(spark, d):
    return T.citation_groups(citations(spark, d).withColumn("unit", F.when(F.col("page") == 0, "section")))


def best_similarities(spark, d):
    rows = read(spark, d, "customer").select("c_custkey").join(read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_totalprice"), "c_custkey", "left")
    return rows.groupBy("c_custkey").agg(F.max("o_totalprice").alias("best"), F.count("o_totalprice").alias("sources"))


QUESTIONS = [
    "Summarise {} please", "what documents do you have", "thanks!", "And what about it?", "Which files mention {}?", "compare {} and the other one?", "How long is the notice period for staff in the warehouse", "help", "list all my files", "overview of this document",
]


def questions(spark, d):
    text = F.element_at(F.array(*map(F.lit, QUESTIONS)), (F.col("c_custkey") % 10 + 1).cast("int"))
    name = F.concat(F.lit("doc-"), F.col("c_custkey") % 5 + 1, F.lit("_urgent "), (F.col("c_custkey") * 10).cast("string"))
    return read(spark, d, "customer").select(F.col("c_custkey").alias("q_id"), F.replace(text, F.lit("{}"), name).alias("text"), (F.col("c_custkey") % 3).alias("turns"), (F.col("c_custkey") % 17).alias("bases"))


def titles(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("document_id"), F.concat(F.lit("Doc."), F.col("o_orderkey") % 5 + 1, F.lit("-Urgent"), F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("_"), F.col("o_orderkey").cast("string"))).otherwise("")).alias("title"))


def question_intents(spark, d):
    q = F.col("text")
    return questions(spark, d).select("q_id", R.wants_document(q).alias("whole"), R.wants_list(q).alias("list"), R.turn_route(q).alias("turn"), R.plan_reason(q, F.col("turns")).alias("plan"))


def question_scopes(spark, d):
    return T.scope(questions(spark, d), titles(spark, d))


def evidence_routes(spark, d):
    asked = questions(spark, d)
    return T.evidence_route(asked, T.scope(asked, titles(spark, d)))


def page_routes(spark, d):
    """Routes of pages by document, and how many of them need a parser."""
    line = read(spark, d, "lineitem")
    area = F.when(F.col("l_linenumber") % 5 > 0, F.col("l_tax") / 2).otherwise(F.lit(0.0))
    route = R.page_route(F.col("l_quantity") * 10, F.col("l_suppkey") % 3, F.col("l_quantity"), area, F.when(F.col("l_partkey") % 11 == 0, 1).otherwise(0), F.col("l_partkey") % 7)
    return line.select("l_orderkey", "l_linenumber", route.alias("route")).groupBy("l_orderkey", "route").agg(F.count("*").alias("pages"), F.count(F.when(F.col("route") != "clean-text", 1)).alias("crackable"))


# telemetry


def run_outcomes(spark, d):
    status = F.element_at(F.create_map(*map(F.lit, ("view", "ok", "purchase", "ok", "click", "refused", "error", "error", "signup", "cancelled"))), F.col("event_type"))
    runs = read(spark, d, "events").select(F.to_date("ts").alias("day"), status.alias("status"), F.col("value").alias("duration_ms"), F.when(F.col("event_id") % 3 > 0, F.col("value") / 4).alias("ttft_ms"), F.when(F.col("event_id") % 2 > 0, F.col("user_id")).alias("tokens"))
    return O.outcomes(runs.withColumn("day", F.col("day").cast("string")), "day")


def log_tail(spark, d):
    """The page after an id, and the newest page."""
    rows = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("level"))
    return O.tail_after(rows, 500, 50).withColumn("page", F.lit("after")).unionAll(O.tail_newest(rows, 50).withColumn("page", F.lit("newest")))


# evaluation


def multi_hop_scores(spark, d):
    return E.multi_hop(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("q_id"), (F.col("l_quantity") > 10).alias("found")))


def summary_scores(spark, d):
    return E.summaries(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("q_id"), (F.col("l_quantity") > 5).alias("reached")))


def latency_summary(spark, d):
    return E.latencies(read(spark, d, "lineitem").select("l_shipdate", F.col("l_returnflag").alias("mode"), F.col("l_partkey").alias("ms"), F.col("l_linenumber").alias("searches"), F.col("l_quantity").alias("tokens")), "mode")


def judge_rows(spark, d):
    return E.judge_rows(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("q_id"), F.when(F.col("l_linenumber") < 6, F.col("l_suppkey") % 3).alias("score")))


def answer_expectations(spark, d):
    must = F.when(F.col("p_size") % 4 > 0, F.array(F.lit("BRAND"), F.substring("p_type", 1, 4)))
    return E.expectations(read(spark, d, "part").select(F.col("p_partkey").alias("q_id"), F.concat_ws(" ", "p_brand", "p_name", "p_type").alias("text"), must.alias("must_contain"), F.when(F.col("p_size") % 3 == 0, "#[1-3]").alias("must_not_match")))


def parent_outcomes(spark, d):
    a = read(spark, d, "orders").where("o_orderkey % 5 > 0").select(F.col("o_orderkey").alias("q_id"), (F.col("o_orderstatus") == "F").alias("refused"))
    b = read(spark, d, "orders").where("o_orderkey % 7 > 0").select(F.col("o_orderkey").alias("q_id"), (F.col("o_totalprice") > 200_000).alias("refused"))
    return E.outcomes_differ(a, b)


def answer_precision(spark, d):
    return E.precision(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("q_id"), (F.col("l_linenumber") % 4).alias("cited"), F.when(F.col("l_linenumber") < 6, F.col("l_tax") > 0.02).alias("supported"), F.least(F.col("l_linenumber") % 4, F.col("l_suppkey") % 3).alias("right")))


def faithfulness(spark, d):
    return E.faithfulness(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("q_id"), F.when(F.col("l_linenumber") > 1, F.col("l_suppkey") % 3).alias("score")))


def release_gate(spark, d):
    rates = read(spark, d, "lineitem").groupBy("l_returnflag").agg(F.round(F.avg(F.when(F.col("l_quantity") > 20, 1.0).otherwise(0.0)), 3).alias("value"), F.round(F.avg(F.when(F.col("l_tax") > 0.04, 1.0).otherwise(0.0)), 3).alias("b"))
    name = F.element_at(F.create_map(*map(F.lit, ("A", "refusal_accuracy", "N", "leakage", "R", "hit@1"))), F.col("l_returnflag"))
    return E.gate(rates.select(name.alias("metric"), "value"), rates.select(name.alias("metric"), F.col("b").alias("value")))


def leaked_chunks(spark, d):
    c = chunks(spark, d).select("chunk_id", "document_id", (F.col("page")).alias("base_id"))
    return E.leaks(c.select((F.col("document_id") % 40).alias("q_id"), "chunk_id"), c.where("base_id < 3").select((F.col("document_id") % 40).alias("q_id"), "base_id").distinct().where("q_id % 4 <> base_id"), c)


def section_passes(spark, d):
    c = chunks(spark, d)
    results = c.select((F.col("document_id") % 300).alias("q_id"), "chunk_id", F.col("page").alias("members"), F.concat(F.lit("page "), F.col("page"), F.lit(" chunk "), F.col("chunk_index")).alias("content"))
    members = c.where("page >= 2").select((F.col("document_id") % 300).alias("q_id"), F.col("chunk_id").alias("parent_id"), (F.col("chunk_id") + 1).alias("chunk_id"))
    phrases = c.select((F.col("document_id") % 300).alias("q_id"), F.concat(F.lit("PAGE "), F.lit(2) + F.col("document_id") % 300 % 2).alias("phrase")).distinct()
    return E.section_pass(results, members, phrases)


QUERIES = {
    f.__name__: f
    for f in (
        search_keys, fenced_texts, formatted, doc_snippets, indexed_texts, repaired_tables, box_rules, citation_boxes, loader_formats, upload_checks, address_checks, retrieved_rows, listed_documents, citation_lookup, users_with_roles, backfilled_bases, conversation_scope,
        attached_vectors, activation_guard, section_pages, whole_document, document_list, newest_runs, latest_versions, cascade_delete, index_differences, run_details, span_trees, span_annotations, ingestion_kpis, stranded_documents, citations, grouped_citations, best_similarities,
        question_intents, question_scopes, evidence_routes, page_routes, run_outcomes, log_tail, multi_hop_scores, summary_scores, latency_summary, judge_rows, answer_expectations, parent_outcomes, answer_precision, faithfulness, release_gate, leaked_chunks, section_passes,
    )
}
