"""DuckDB SQL for the results of catalog.QUERIES."""

from __future__ import annotations

_WEEK = "ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'"
_SPANS = """spans AS (
  SELECT l_orderkey AS run_id, l_linenumber AS key, l_returnflag AS step, l_linestatus AS model, l_discount >= 0.09 AS bad, l_extendedprice AS duration_ms,
    l_quantity::BIGINT AS tokens, 'error of part ' || l_partkey AS error, l_shipdate AS started_at FROM lineitem)"""
_SECTIONS = """sc AS (
  SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_returnflag)::INTEGER AS chunk_index, l_returnflag AS section, l_quantity::INTEGER AS token_count FROM lineitem),
runs AS (
  SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY chunk_index)::BIGINT AS run
  FROM (SELECT *, CASE WHEN section = lag(section) OVER (PARTITION BY doc_id ORDER BY chunk_index) THEN 0 ELSE 1 END AS new FROM sc))"""
_SCORED = """scored AS (
  SELECT o_orderkey AS q_id, CASE o_orderstatus WHEN 'P' THEN 'refusal' WHEN 'F' THEN 'single-hop' ELSE 'multi-hop' END AS type,
    min(l_linenumber) FILTER (WHERE l_partkey % 40 = o_orderkey % 40) AS rank, count(l_partkey) AS returned
  FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_quantity > 10) l ON l_orderkey = o_orderkey GROUP BY 1, 2)"""

ORACLE_SQL = {
    "telemetry_kpis": f"""
SELECT count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS errors, round(count(*) FILTER (WHERE event_type = 'error') / nullif(count(*), 0), 6) AS error_rate,
  round(quantile_cont(value, 0.5) FILTER (WHERE event_type <> 'error'), 6) AS p50, round(quantile_cont(value, 0.95) FILTER (WHERE event_type <> 'error'), 6) AS p95,
  round(avg(value) FILTER (WHERE event_type <> 'error'), 6) AS mean FROM events WHERE {_WEEK}""",
    "telemetry_periods": """
SELECT CASE WHEN ts < TIMESTAMP '2024-01-15' THEN 'previous' ELSE 'current' END AS period, count(*) AS runs, round(avg(value), 6) AS mean
FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-22' GROUP BY 1""",
    "telemetry_buckets": f"""
WITH b AS (SELECT (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-08')) // 21600000000 AS bucket, count(*) AS runs, count(*) FILTER (WHERE event_type = 'error') AS errors, round(quantile_cont(value, 0.5), 6) AS p50
  FROM events WHERE {_WEEK} GROUP BY 1)
SELECT r.range AS bucket, coalesce(runs, 0) AS runs, coalesce(errors, 0) AS errors, p50 FROM range(28) r LEFT JOIN b ON b.bucket = r.range""",
    "similarity_histogram": """
WITH h AS (SELECT least(floor(l_discount * 10 * 20), 19)::BIGINT AS bin, count(*) AS n FROM lineitem GROUP BY 1)
SELECT r.range AS bin, coalesce(n, 0) AS n FROM range(20) r LEFT JOIN h ON h.bin = r.range""",
    "runs_by_status": "SELECT coalesce(event_type, 'none') AS status, count(*) AS n FROM events GROUP BY 1",
    "step_latency": f"""
WITH {_SPANS} SELECT step, count(*) AS n, round(avg(duration_ms), 4) AS mean, round(quantile_cont(duration_ms, 0.95), 4) AS p95, count(*) FILTER (WHERE bad) AS errors
FROM spans JOIN orders ON o_orderkey = run_id WHERE o_orderstatus = 'F' GROUP BY 1""",
    "last_error_per_group": f"""
WITH {_SPANS} SELECT model, step, count(*) AS errors, arg_max(error, (started_at, run_id, key)) AS last_error, max(started_at) AS last_at
FROM spans WHERE bad GROUP BY 1, 2 ORDER BY last_at DESC, model, step LIMIT 10""",
    "token_cost": f"""
WITH {_SPANS} SELECT coalesce(model, '(unknown)') AS model, sum(tokens)::BIGINT AS tokens, CASE WHEN model = 'O' THEN round(sum(tokens) * 2.5::DOUBLE / 1e6, 6) END AS cost FROM spans WHERE tokens > 0 GROUP BY model""",
    "run_rollup": f"""
WITH {_SPANS} SELECT run_id, sum(tokens)::BIGINT AS tokens, count(*) AS spans, string_agg(DISTINCT model, ',' ORDER BY model) AS models FROM spans GROUP BY 1""",
    "log_search": """
SELECT event_id AS id, event_type AS level, 'document ' || event_type || ' by ' || user_id AS message FROM events
WHERE event_type IN ('error', 'click') AND ('document ' || event_type || ' by ' || user_id ILIKE '%BY 1%' OR props ILIKE '%BY 1%')""",
    "log_tail_page": """
WITH p AS (SELECT event_id, event_type FROM events WHERE event_id < 500 ORDER BY event_id DESC LIMIT 51)
SELECT event_id AS id, event_type AS level, (SELECT count(*) > 50 FROM p) AS has_older FROM p ORDER BY event_id DESC LIMIT 50""",
    "log_level_counts": """
SELECT level, count(event_id) AS n FROM (VALUES ('debug'), ('error'), ('view'), ('click')) v(level) LEFT JOIN events ON event_type = level GROUP BY 1""",
    "categorise_logs": """
SELECT event_type AS level, CASE WHEN user_id % 20 = 0 THEN 'settings' WHEN event_id % 8 < 6 THEN ['agent', 'inference', 'retrieval', 'ingestion', 'auth', 'settings'][event_id % 8 + 1] WHEN event_id % 8 = 6 THEN 'system'
  WHEN user_id % 2 = 0 THEN 'retrieval' ELSE 'ingestion' END AS category, count(*) AS n FROM events GROUP BY 1, 2""",
    "redact_logs": """
WITH m AS (SELECT event_id AS id, 'document ' || event_type || ' by ' || user_id AS m FROM events)
SELECT id, CASE id % 5 WHEN 0 THEN '[redacted] ' || m WHEN 1 THEN 'key=[redacted] ' || m WHEN 2 THEN 'sk_short ' || id || ' ' || m WHEN 3 THEN '([redacted]) ' || m
  ELSE repeat('long ', 800) || '… (' || (6 + length(m)) || ' more characters)' END AS message FROM m""",
    "scoped_documents": "SELECT doc_id, source FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2')",
    "kb_document_counts": "SELECT v.source, count(doc_id) AS documents FROM (VALUES ('src0'), ('src1'), ('absent')) v(source) LEFT JOIN documents d ON d.source = v.source GROUP BY 1",
    "doc_chunk_counts": "SELECT o_orderkey, count(l_linenumber) AS chunks, count(DISTINCT l_suppkey) AS pages FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1",
    "missing_embeddings": "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)",
    "owners_with_docs": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "fragmented_owners": "SELECT lang, count(DISTINCT source) AS sources FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1",
    "storage_use": "SELECT source, coalesce(sum(n_chars), 0)::BIGINT AS size FROM documents GROUP BY 1",
    "estimate_tokens": r"""
SELECT doc_id, CASE WHEN coalesce(text, '') = '' THEN 0 ELSE ceil(2 + len(regexp_extract_all(text, '[0-9]')) + 0.5::DOUBLE * len(regexp_extract_all(text, '\s[0-9]'))
  + coalesce(list_sum(list_transform(regexp_extract_all(text, '[A-Za-z]+'), lambda x: ceil(length(x) / 6.6::DOUBLE))), 0)
  + coalesce(list_sum(list_transform(regexp_extract_all(text, '[^\sA-Za-z0-9]+'), lambda x: ceil(length(x) / 2.5::DOUBLE))), 0)) END::BIGINT AS tokens FROM documents""",
    "normalise_title": r"""
SELECT p_partkey, trim(regexp_replace(regexp_replace(regexp_replace(lower(p_name || '_V2.0 - ' || p_brand), '[_\-.]+', ' ', 'g'), '[^a-z0-9\s]', ' ', 'g'), '\s+', ' ', 'g')) AS title FROM part""",
    "cited_indices": """
SELECT o_orderkey, CASE WHEN o_custkey % 7 = o_orderkey % 5 THEN (o_custkey % 7)::VARCHAR ELSE (o_custkey % 7) || ',' || (o_orderkey % 5) END AS cited FROM orders""",
    "rerank_permutation": """
WITH r AS (SELECT l_orderkey AS q_id, CASE WHEN l_partkey % 17 <> 0 THEN l_quantity END AS score, l_linenumber AS n FROM lineitem),
k AS (SELECT q_id, score, row_number() OVER (PARTITION BY q_id ORDER BY n, score NULLS FIRST)::INTEGER AS rank FROM r),
w AS (SELECT *, count(score) OVER (PARTITION BY q_id) = count(*) OVER (PARTITION BY q_id) AS whole FROM k)
SELECT q_id, rank, row_number() OVER (PARTITION BY q_id ORDER BY CASE WHEN whole THEN score ELSE 0 END DESC, rank)::INTEGER AS new_rank FROM w""",
    "accumulate_searches": "SELECT l_orderkey % 500 AS q_id, l_partkey AS chunk_id, max(l_discount) AS similarity, min(l_linenumber) AS first_search FROM lineitem GROUP BY 1, 2",
    "effective_floor": "SELECT DISTINCT l_linenumber, round(0.35::DOUBLE + 0.02::DOUBLE * greatest(0, l_linenumber - 1), 6) AS floor FROM lineitem",
    "section_runs": f"WITH {_SECTIONS} SELECT doc_id, chunk_index, run FROM runs",
    "parent_assembly": f"""
WITH {_SECTIONS},
w AS (SELECT doc_id, run, sum(token_count) AS tokens, min(chunk_index) AS first_index FROM runs GROUP BY 1, 2),
h AS (SELECT doc_id % 50 AS q_id, chunk_index AS rank, chunk_index, doc_id, token_count / 50.0::DOUBLE AS similarity, run, tokens, first_index, count(*) OVER (PARTITION BY doc_id % 50, doc_id, run) AS m
  FROM runs JOIN w USING (doc_id, run) WHERE chunk_index <= 3),
k AS (SELECT *, m >= 2 AND tokens <= 80 AS parent FROM h)
SELECT q_id, doc_id, min(rank) AS rank, max(similarity) AS similarity, count(*) AS members, min(CASE WHEN parent THEN first_index ELSE chunk_index END) AS chunk_index
FROM k GROUP BY q_id, doc_id, parent, CASE WHEN parent THEN run ELSE chunk_index END""",
    "previous_user_turn": """
SELECT conv_id, turn, previous FROM (SELECT *, last_value(CASE WHEN role = 'user' AND trim(text) <> '' THEN left(trim(text), 300) END IGNORE NULLS)
  OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous FROM conversations) WHERE role = 'user'""",
    "last_turns": """
SELECT conv_id, turn, coalesce(array_to_string(list(role) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING), ','), '') AS roles FROM conversations""",
    "eval_metrics": f"""
WITH {_SCORED} SELECT type, count(*) AS questions, round(avg(CASE WHEN type <> 'refusal' THEN CASE WHEN rank <= 1 THEN 1.0 ELSE 0.0 END END), 3) AS hit1,
  round(avg(CASE WHEN type <> 'refusal' THEN CASE WHEN rank <= 3 THEN 1.0 ELSE 0.0 END END), 3) AS hit3, round(avg(CASE WHEN type <> 'refusal' THEN coalesce(1.0::DOUBLE / rank, 0) END), 3) AS mrr,
  round(coalesce(avg(CASE WHEN type = 'refusal' THEN CASE WHEN returned = 0 THEN 1.0 ELSE 0.0 END END), 1), 3) AS refusal FROM scored GROUP BY 1""",
    "eval_by_slice": f"WITH {_SCORED} SELECT coalesce(type, 'all') AS type, count(*) AS questions, round(avg(coalesce(1.0::DOUBLE / rank, 0)), 3) AS mrr FROM scored GROUP BY ROLLUP (type)",
    "gate_separation": """
WITH t AS (SELECT max(o_totalprice) AS threshold FROM orders WHERE o_orderpriority LIKE '5%')
SELECT t.threshold, count(*) AS answerable, count(*) FILTER (WHERE o_totalprice > coalesce(t.threshold, -1)) AS above FROM orders, t WHERE o_orderpriority NOT LIKE '5%' GROUP BY 1""",
    "judge_agreement": "SELECT count(*) AS n, round(avg(CASE WHEN round(l_tax * 100 / 4) = round(l_discount * 100 / 4) THEN 1.0 ELSE 0.0 END), 3) AS agreement FROM lineitem",
    "judge_aggregate": "SELECT l_orderkey AS item, quantile_cont(l_quantity, 0.5) AS median, max(l_quantity) - min(l_quantity) AS spread, count(*) AS n FROM lineitem GROUP BY 1",
    "kb_leakage": "SELECT l_orderkey % 5 AS scope, count(*) AS results, count(*) FILTER (WHERE p_partkey % 5 <> l_orderkey % 5) AS leaked FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1",
    "html_title": r"""
SELECT page_id, nullif(trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')), '') AS title FROM pages""",
    "dense_topk": """
WITH q AS (SELECT item_id AS q_id, e.embedding::DOUBLE[] AS qe FROM benchmark JOIN embeddings e ON vec_id = item_id),
s AS (SELECT q_id, vec_id AS chunk_id, round(list_cosine_similarity(embedding::DOUBLE[], qe), 6) AS similarity FROM q, embeddings JOIN documents ON doc_id = vec_id WHERE lang = 'en')
SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY similarity DESC, chunk_id)::INTEGER AS v_rank FROM s QUALIFY v_rank <= 20""",
}
