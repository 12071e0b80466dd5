"""Streams, documentation search, dates, timings and set operations over the test tables, with SQL for the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import search as D
from ..streaming import events as V
from .catalog import MESSAGES, read
from .oracle import _SECTIONS
from .oracle import ORACLE_SQL as _FIRST

DAY = 24 * 3600


def stream_buckets(spark, d):
    stream = V.event_stream(spark, f"{d}/events.parquet")
    return V.latest(V.buckets(stream, 6 * 3600, 3600, "event_type"), "buckets")


def stream_logs(spark, d):
    """Messages of every category, as they come."""
    stream = V.event_stream(spark, f"{d}/events.parquet")
    message = F.element_at(F.array(*map(F.lit, MESSAGES)), (F.col("event_id") % 8 + 1).cast("int"))
    rows = V.appended(V.log_rows(stream, T.categorise(message, F.lit(None).cast("string"), F.when(F.col("user_id") % 2 == 0, "ingest"))), "logs")
    return rows.groupBy("category").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


def stream_rate_limit(spark, d):
    hits = V.event_stream(spark, f"{d}/events.parquet").select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"))
    return V.appended(V.rate_limit(hits, DAY, 3), "rate-limit")


def docs_search(spark, d):
    entries = read(spark, d, "part").select(F.col("p_brand").alias("page"), F.col("p_partkey").alias("id"), F.col("p_name").alias("heading"), F.col("p_type").alias("title"), F.concat_ws(" ", "p_type", "p_brand", "p_name").alias("text"))
    return D.search_entries(entries, "Brand a", 20, 2)


def recent_groups(spark, d):
    label = D.recent_group(F.col("ts"), F.to_date(F.lit("2024-01-25")))
    return read(spark, d, "events").select(label.alias("label")).groupBy("label").agg(F.count("*").alias("n"))


def message_metrics(spark, d):
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.lit(0).alias("started"), F.when(F.col("l_partkey") % 7 != 0, F.col("l_suppkey") * 10).alias("first_token"), (F.col("l_partkey") * 3).alias("finished"), F.col("l_quantity").cast("int").alias("tokens"))
    return D.timings(rows).groupBy("l_linenumber").agg(F.sum("ttft_ms").alias("ttft_ms"), F.sum("total_ms").alias("total_ms"), F.count("tokens_per_second").alias("n"))


def file_names(spark, d):
    name = F.concat(F.lit(" a/b\\"), "p_name", F.lit("\t.pdf"))
    return read(spark, d, "part").select("p_partkey", D.file_name(name).alias("name"))


def derived_titles(spark, d):
    return read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", D.derive_title(F.col("text")).alias("title"))


def scope_intersection(spark, d):
    owned = read(spark, d, "orders").where("o_orderstatus = 'O'").select("o_custkey")
    return owned.intersect(read(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey")))


def other_scopes(spark, d):
    return read(spark, d, "documents").select("source").exceptAll(read(spark, d, "documents").where("lang = 'en'").select("source")).distinct()


def slice_sample(spark, d):
    """The first three questions of each slice by id."""
    from pyspark.sql.window import Window

    n = F.row_number().over(Window.partitionBy("o_orderpriority").orderBy("o_orderkey"))
    return read(spark, d, "orders").select("o_orderpriority", "o_orderkey", n.alias("n")).where("n <= 3")


QUERIES = {f.__name__: f for f in (stream_buckets, stream_logs, stream_rate_limit, docs_search, recent_groups, message_metrics, file_names, derived_titles, scope_intersection, other_scopes, slice_sample)}

_WINDOWS = """WITH RECURSIVE h AS (SELECT user_id AS key, ts, event_id AS id FROM events WHERE ts IS NOT NULL),
w AS (
  SELECT key, min(ts) AS b FROM h GROUP BY key
  UNION ALL SELECT w.key, min(h.ts) AS b FROM w JOIN h ON h.key = w.key AND h.ts >= w.b + INTERVAL 24 HOUR GROUP BY w.key, w.b),
p AS (SELECT h.key, h.id, h.ts, max(w.b) AS b FROM h JOIN w ON w.key = h.key AND w.b <= h.ts GROUP BY 1, 2, 3)
SELECT key, id, row_number() OVER (PARTITION BY key, b ORDER BY ts, id) <= 3 AS allowed FROM p"""

_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_LEXICAL = f"""
WITH q AS (
  SELECT DISTINCT item_id AS q_id, unnest(regexp_extract_all(lower(b.text), '[a-z0-9]+')) AS term FROM benchmark b JOIN embeddings ON vec_id = item_id),
d AS (
  SELECT chunk_id, term, count(*) AS n FROM (SELECT doc_id AS chunk_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents WHERE lang = 'en') GROUP BY 1, 2),
s AS (SELECT q_id, chunk_id, round(sum(n)::DOUBLE * 0.1::DOUBLE, 6) AS lexical_rank FROM q JOIN d USING (term) WHERE term NOT IN ({_STOP}) GROUP BY 1, 2)
SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY lexical_rank DESC, chunk_id)::INTEGER AS l_rank FROM s QUALIFY l_rank <= 20"""

ORACLE_SQL = {
    "lexical_rank": _LEXICAL,
    "rrf_fusion": f"""
SELECT q_id, chunk_id, round(coalesce(1.0::DOUBLE / (60 + v_rank), 0) + coalesce(1.0::DOUBLE / (60 + l_rank), 0), 8) AS rrf,
  CASE WHEN l_rank IS NULL THEN 'vector' WHEN v_rank IS NULL THEN 'lexical' ELSE 'both' END AS source
FROM ({_FIRST["dense_topk"]}) v FULL JOIN ({_LEXICAL}) l USING (q_id, chunk_id)""",
    "choose_document_chunks": f"""
WITH {_SECTIONS},
x AS (SELECT *, row_number() OVER (PARTITION BY doc_id, run ORDER BY chunk_index) AS depth, max(run) OVER (PARTITION BY doc_id) AS sections, count(*) OVER (PARTITION BY doc_id) AS total FROM runs),
y AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY depth, run) AS turn FROM x)
SELECT doc_id, chunk_index, run FROM y
WHERE total <= 4 OR (sections > 4 AND depth = 1 AND list_contains([floor(p * (sections - 1) / 3.0 + 0.5)::BIGINT FOR p IN range(4)], run - 1)) OR (total > 4 AND sections <= 4 AND turn <= 4)""",
    "box_iou": """
WITH b AS (SELECT l_orderkey, l_linenumber, l_discount AS a_left, l_tax AS a_low, l_discount + 0.5::DOUBLE AS a_right, l_tax + 0.5::DOUBLE AS a_top, l_tax AS b_left, l_discount AS b_low, l_tax + l_quantity / 50.0::DOUBLE AS b_right, l_discount + l_quantity / 50.0::DOUBLE AS b_top FROM lineitem),
c AS (SELECT *, greatest(0, least(a_right, b_right) - greatest(a_left, b_left)) * greatest(0, least(a_top, b_top) - greatest(a_low, b_low)) AS common, greatest(0, a_right - a_left) * greatest(0, a_top - a_low) + greatest(0, b_right - b_left) * greatest(0, b_top - b_low) AS areas FROM b)
SELECT l_orderkey, l_linenumber, round(CASE WHEN areas - common > 0 THEN common / (areas - common) ELSE 0 END, 6) AS iou FROM c""",
    "stream_buckets": """
SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01 01:00:00') AS bucket_start, event_type AS kind, count(*) AS n FROM events GROUP BY 1, 2""",
    "stream_rate_limit": _WINDOWS,
    "fixed_window_limit": _WINDOWS,
    "docs_search": """
WITH e AS (SELECT p_brand AS page, p_partkey AS id, lower(p_name) AS h, lower(p_type) AS t, lower(concat_ws(' ', p_type, p_brand, p_name)) AS x FROM part),
s AS (
  SELECT page, id, sum(p) + sum(CASE WHEN starts_with(h, k) THEN 2 ELSE 0 END) AS score, min(p) AS least
  FROM (SELECT *, CASE WHEN contains(h, k) THEN 10 ELSE 0 END + CASE WHEN contains(t, k) THEN 6 ELSE 0 END + least(5, (length(x) - length(replace(x, k, ''))) // length(k)) AS p
    FROM e, (SELECT unnest(['brand', 'a']) AS k)) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, id) AS r FROM s WHERE least > 0)
SELECT page, id, score::INTEGER AS score, row_number() OVER (ORDER BY score DESC, id)::INTEGER AS place FROM r WHERE r <= 2 ORDER BY score DESC, id LIMIT 20""",
    "recent_groups": """
SELECT CASE WHEN ts::DATE >= DATE '2024-01-25' THEN 'Today' WHEN ts::DATE = DATE '2024-01-24' THEN 'Yesterday' WHEN ts::DATE >= DATE '2024-01-18' THEN 'Previous 7 days' ELSE 'Older' END AS label, count(*) AS n
FROM events GROUP BY 1""",
    "message_metrics": """
SELECT l_linenumber, sum(greatest(0, l_suppkey * 10)) FILTER (WHERE l_partkey % 7 <> 0)::BIGINT AS ttft_ms, sum(l_partkey * 3)::BIGINT AS total_ms,
  count(*) FILTER (WHERE l_partkey % 7 <> 0 AND l_partkey * 3 > l_suppkey * 10 AND l_quantity::INTEGER > 0) AS n FROM lineitem GROUP BY 1""",
    "file_names": "SELECT p_partkey, 'a_b_' || p_name || '.pdf' AS name FROM part",
    "scope_intersection": "SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' INTERSECT SELECT c_custkey FROM customer WHERE c_acctbal > 0",
    "other_scopes": "SELECT DISTINCT source FROM (SELECT source FROM documents EXCEPT ALL SELECT source FROM documents WHERE lang = 'en')",
    "slice_sample": "SELECT * FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey)::INTEGER AS n FROM orders) WHERE n <= 3",
    "derived_titles": r"""
WITH f AS (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS f FROM conversations WHERE role = 'user'),
c AS (SELECT *, f[:60] AS c, 60 - length(regexp_extract(f[:60], '[^ ]*$')) - 1 AS s FROM f)
SELECT conv_id, turn, CASE WHEN f = '' THEN NULL WHEN length(f) <= 60 THEN f ELSE rtrim(CASE WHEN s > 30 THEN c[:s] ELSE c END) || '…' END AS title FROM c""",
}
