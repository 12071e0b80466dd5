"""The retrieval and analytics operators applied to the test tables, by query name.

documents stand for chunks (lang is the owner, source the collection), events for runs and logs, orders and lineitem for runs and
spans, embeddings for chunk vectors, benchmark for questions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import retrieval as R
from ..operators import sections as S
from ..operators import telemetry as O
from ..sources import loaders as L
from ..sources.shared import dealt, parts

START, MIDDLE, END = "2024-01-08 00:00:00", "2024-01-15 00:00:00", "2024-01-22 00:00:00"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def runs(spark, d) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("started_at"), F.col("event_type").alias("status"), F.col("value").alias("duration_ms"), "user_id", "props")


def logs(spark, d) -> DataFrame:
    return read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("level"), F.concat(F.lit("document "), F.col("event_type"), F.lit(" by "), F.col("user_id")).alias("message"), F.col("props").alias("meta"))


def spans(spark, d) -> DataFrame:
    bad = F.when(F.col("l_discount") >= 0.09, "error").otherwise("ok")
    return read(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("key"), F.col("l_returnflag").alias("step"), F.col("l_linestatus").alias("model"), bad.alias("status"), F.col("l_extendedprice").alias("duration_ms"),
        F.col("l_quantity").cast("long").alias("tokens"), F.concat(F.lit("error of part "), F.col("l_partkey")).alias("error"), F.col("l_shipdate").alias("started_at"),
    )


def chunks(spark, d) -> DataFrame:
    return read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("lang").alias("scope"), F.col("text").alias("content"))


def vectors(spark, d) -> DataFrame:
    """A vector belongs to the scope of its chunk."""
    return read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding").join(chunks(spark, d).select("chunk_id", "scope"), "chunk_id")


def questions(spark, d) -> DataFrame:
    """All benchmark items, each in the English scope, with the vector of the same number."""
    own = read(spark, d, "embeddings").select(F.col("vec_id").alias("q_id"), "embedding")
    return read(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), F.lit("en").alias("scope"), "text").join(own, "q_id")


def telemetry_kpis(spark, d):
    return O.kpis(O.between(runs(spark, d), START, MIDDLE))


def telemetry_periods(spark, d):
    return O.periods(runs(spark, d), START, MIDDLE, END)


def telemetry_buckets(spark, d):
    return O.buckets(O.between(runs(spark, d), START, MIDDLE), START, 6 * 3600, 28)


def similarity_histogram(spark, d):
    return O.histogram(read(spark, d, "lineitem"), F.col("l_discount") * 10)


def runs_by_status(spark, d):
    return O.grouped(runs(spark, d), "status")


def step_latency(spark, d):
    own = read(spark, d, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return O.step_latency(spans(spark, d), own)


def last_error_per_group(spark, d):
    return O.last_errors(spans(spark, d))


def token_cost(spark, d):
    prices = spark.createDataFrame([("O", 2.5)], "model string, price double")
    return O.token_cost(spans(spark, d), prices)


def run_rollup(spark, d):
    return O.run_rollup(spans(spark, d))


def log_search(spark, d):
    return O.log_search(logs(spark, d), ["error", "click"], "BY 1").select("id", "level", "message")


def log_tail_page(spark, d):
    return O.tail_page(logs(spark, d), 500, 50).select("id", "level", "has_older")


def log_level_counts(spark, d):
    return O.level_counts(logs(spark, d), ["debug", "error", "view", "click"])


#: Messages of every category; the last two say nothing themselves.
MESSAGES = ["Agentic step 2", "inference request sent", "rerank done in 3 ms", "page 3 parsed", "user login", "ai-settings: saved", "tick", "tick"]


def categorise_logs(spark, d):
    at = (F.col("event_id") % 8 + 1).cast("int")
    message, kind = F.element_at(F.array(*map(F.lit, MESSAGES)), at), F.when(at == 8, F.element_at(F.array(F.lit("chat"), F.lit("ingest")), (F.col("user_id") % 2 + 1).cast("int")))
    own = F.when(F.col("user_id") % 10 == 0, F.when(F.col("user_id") % 20 == 0, "settings").otherwise("no category"))
    out = read(spark, d, "events").select(F.col("event_type").alias("level"), T.categorise(message, own, kind).alias("category"))
    return out.groupBy("level", "category").agg(F.count("*").alias("n"))


def redact_logs(spark, d):
    id_ = F.col("id").cast("string")
    secret = F.element_at(F.array(F.concat(F.lit("Bearer abcdefgh"), id_), F.concat(F.lit("key=sk-"), F.lpad(id_, 9, "x")), F.concat(F.lit("sk_short "), id_), F.concat(F.lit("(nvapi-"), F.lpad(id_, 8, "Q"), F.lit(")")), F.repeat(F.lit("long "), 801)), (F.col("id") % 5 + 1).cast("int"))
    return logs(spark, d).select("id", T.redact(F.concat(secret, F.lit(" "), F.col("message"))).alias("message"))


def scoped_documents(spark, d):
    return read(spark, d, "documents").where((F.col("lang") == "en") & F.col("source").isin("src1", "src2")).select("doc_id", "source")


def kb_document_counts(spark, d):
    every = spark.createDataFrame([("src0",), ("src1",), ("absent",)], "source string")
    return every.join(read(spark, d, "documents"), "source", "left").groupBy("source").agg(F.count("doc_id").alias("documents"))


def doc_chunk_counts(spark, d):
    lines = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey")
    n = parts(lines, 500_000)  # both sides are dealt alike, by the key of join and groups
    orders = read(spark, d, "orders").select("o_orderkey").repartition(n, "o_orderkey")
    return orders.join(lines.repartition(n, "l_orderkey"), F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_orderkey").agg(F.count("l_linenumber").alias("chunks"), F.countDistinct("l_suppkey").alias("pages"))


def missing_embeddings(spark, d):
    return read(spark, d, "documents").select("doc_id").join(read(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id")), "doc_id", "left_anti")


def owners_with_docs(spark, d):
    return read(spark, d, "customer").select("c_custkey").join(read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")


def fragmented_owners(spark, d):
    return read(spark, d, "documents").groupBy("lang").agg(F.countDistinct("source").alias("sources")).where("sources > 1")


def storage_use(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.coalesce(F.sum("n_chars"), F.lit(0)).alias("size"))


def estimate_tokens(spark, d):
    return read(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


def detect_heading(spark, d):
    return read(spark, d, "documents").select("doc_id", T.detect_heading(F.col("text")).alias("heading"))


def normalise_title(spark, d):
    return read(spark, d, "part").select("p_partkey", T.normalise(F.concat("p_name", F.lit("_V2.0 - "), "p_brand")).alias("title"))


def cited_indices(spark, d):
    cited = F.concat("o_orderpriority", F.lit(" ["), F.col("o_custkey") % 7, F.lit("] and ["), F.col("o_orderkey") % 5, F.lit("]["), F.col("o_custkey") % 7, F.lit("]"))
    return read(spark, d, "orders").select("o_orderkey", F.array_join(T.cited_indices(cited), ",").alias("cited"))


def dense_topk(spark, d):
    return R.dense(questions(spark, d), vectors(spark, d)).select("q_id", "chunk_id", "similarity", "v_rank")


def lexical_rank(spark, d):
    return R.lexical(questions(spark, d), chunks(spark, d)).select("q_id", "chunk_id", "lexical_rank", "l_rank")


def rrf_fusion(spark, d):
    return R.fuse(R.dense(questions(spark, d), vectors(spark, d)), R.lexical(questions(spark, d), chunks(spark, d))).select("q_id", "chunk_id", "rrf", "source")


def hybrid_retrieve(spark, d):
    return R.retrieve(questions(spark, d), chunks(spark, d), vectors(spark, d), floor=0.0)


def rerank_permutation(spark, d):
    rows = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("q_id"), F.col("l_linenumber").alias("rank"), F.when(F.col("l_partkey") % 17 != 0, F.col("l_quantity")).alias("score"))
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("q_id").orderBy("rank", "score")))
    return R.rerank(rows).select("q_id", "rank", "new_rank")


def accumulate_searches(spark, d):
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") % 500).alias("q_id"), F.col("l_partkey").alias("chunk_id"), F.col("l_linenumber").alias("search"), F.col("l_discount").alias("similarity"))
    return R.accumulate(rows)


def effective_floor(spark, d):
    return read(spark, d, "lineitem").select("l_linenumber").distinct().select("l_linenumber", R.effective_floor(F.col("l_linenumber")).alias("floor"))


def section_chunks(spark, d) -> DataFrame:
    lines = dealt(read(spark, d, "lineitem"), S.ROWS, "l_orderkey")
    rows = lines.select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag")).alias("chunk_index"), F.col("l_returnflag").alias("section"), F.col("l_quantity").cast("int").alias("token_count"))
    return rows


def section_runs(spark, d):
    return S.section_runs(section_chunks(spark, d)).select("doc_id", "chunk_index", "run")


def choose_document_chunks(spark, d):
    return S.choose_chunks(section_chunks(spark, d), 4)


def parent_assembly(spark, d):
    rows = section_chunks(spark, d)
    admitted = rows.where("chunk_index <= 3").select((F.col("doc_id") % 50).alias("q_id"), F.col("chunk_index").alias("rank"), (F.col("doc_id") * 100 + F.col("chunk_index")).alias("chunk_id"), "doc_id", "chunk_index", (F.col("token_count") / 50.0).alias("similarity"))
    return S.assemble_parents(admitted, rows, 80)


def previous_user_turn(spark, d):
    return S.previous_user_turn(read(spark, d, "conversations"))


def last_turns(spark, d):
    return S.last_turns(read(spark, d, "conversations"))


def scored_questions(spark, d) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "P", "refusal").when(F.col("o_orderstatus") == "F", "single-hop").otherwise("multi-hop")
    truth = read(spark, d, "orders").select(F.col("o_orderkey").alias("q_id"), kind.alias("type"), (F.col("o_orderkey") % 40).alias("target"))
    found = read(spark, d, "lineitem").where("l_quantity > 10").select(F.col("l_orderkey").alias("q_id"), F.col("l_linenumber").alias("rank"), (F.col("l_partkey") % 40).alias("target"))
    return E.first_correct(found, truth)


def eval_metrics(spark, d):
    return E.metrics(scored_questions(spark, d), "type")


def eval_by_slice(spark, d):
    return E.by_slice(scored_questions(spark, d))


def gate_separation(spark, d):
    kind = F.when(F.col("o_orderpriority").startswith("5"), "refusal").otherwise("single-hop")
    return E.gate_separation(read(spark, d, "orders").select(kind.alias("type"), F.col("o_totalprice").alias("similarity")))


def judge_agreement(spark, d):
    return E.agreement(read(spark, d, "lineitem").select((F.col("l_tax") * 100 / 4).alias("human"), (F.col("l_discount") * 100 / 4).alias("judge")))


def judge_aggregate(spark, d):
    return E.judge_samples(read(spark, d, "lineitem").select(F.col("l_orderkey").alias("item"), F.col("l_quantity").alias("score")))


def kb_leakage(spark, d):
    asked = read(spark, d, "lineitem").select((F.col("l_orderkey") % 5).alias("scope"), F.col("l_partkey").alias("chunk_id"))
    return E.leakage(asked, read(spark, d, "part").select(F.col("p_partkey").alias("chunk_id"), (F.col("p_partkey") % 5).alias("scope")))


def html_title(spark, d):
    return read(spark, d, "pages").select("page_id", T.html_title(F.col("html")).alias("title"))


def html_sections(spark, d):
    return L.elements(read(spark, d, "pages"), "page_id", "html", L.html_sections)


def markdown_sections(spark, d):
    return L.elements(read(spark, d, "documents"), "doc_id", "text", L.markdown_sections)


def chunk_documents(spark, d):
    return L.chunk(read(spark, d, "documents"))


def box_iou(spark, d):
    box = lambda x, y, w: F.struct(x.alias("xmin"), y.alias("ymin"), (x + w).alias("xmax"), (y + w).alias("ymax"))
    a = box(F.col("l_discount"), F.col("l_tax"), F.lit(0.5))
    b = box(F.col("l_tax"), F.col("l_discount"), F.col("l_quantity") / 50.0)
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(S.iou(a, b), 6).alias("iou"))


def fixed_window_limit(spark, d):
    return S.fixed_windows(read(spark, d, "events").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id")), 3600 * 24, 3)


QUERIES = {
    f.__name__: f
    for f in (
        telemetry_kpis, telemetry_periods, telemetry_buckets, similarity_histogram, runs_by_status, step_latency, last_error_per_group, token_cost, run_rollup,
        log_search, log_tail_page, log_level_counts, categorise_logs, redact_logs, scoped_documents, kb_document_counts, doc_chunk_counts, missing_embeddings,
        owners_with_docs, fragmented_owners, storage_use, estimate_tokens, detect_heading, normalise_title, cited_indices, dense_topk, lexical_rank, rrf_fusion,
        hybrid_retrieve, rerank_permutation, accumulate_searches, effective_floor, section_runs, choose_document_chunks, parent_assembly, previous_user_turn,
        last_turns, eval_metrics, eval_by_slice, gate_separation, judge_agreement, judge_aggregate, kb_leakage, html_title, html_sections, markdown_sections,
        chunk_documents, box_iou, fixed_window_limit,
    )
}
