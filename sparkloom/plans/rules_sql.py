"""SQL (DuckDB) for the results of rules.QUERIES, written from the stated rules."""

_DOCUMENTS = """documents_ AS (
  SELECT o_orderkey AS document_id, 'Doc ' || o_orderpriority || ' ' || o_orderkey AS title, o_custkey % 7 AS owner_id, (o_custkey % 25)::INTEGER AS base_id,
    CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey END AS file_id, ['ready', 'failed', 'processing', 'ready'][o_orderkey % 4 + 1] AS status, o_custkey % 5 AS attempts, o_orderdate AS leased_at FROM orders)"""
_LINES = "(SELECT l_orderkey, l_linenumber, max(l_suppkey) AS l_suppkey, max(l_quantity) AS l_quantity, max(l_returnflag) AS l_returnflag, max(l_linestatus) AS l_linestatus FROM lineitem GROUP BY 1, 2)"
_CHUNKS = f"chunks AS (SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_orderkey AS document_id, l_linenumber AS chunk_index, l_suppkey % 4 AS page, l_quantity AS score FROM {_LINES})"
_MIME = "CASE WHEN o_orderkey % 6 < 5 THEN ['application/pdf', 'text/html', 'text/markdown', 'image/png', ''][o_orderkey % 6 + 1] END"
_FILES = f"files AS (SELECT o_orderkey AS file_id, {_MIME} AS mime FROM orders WHERE o_orderkey % 3 = 1)"
_BOXES = """boxes AS (
  SELECT l_orderkey, l_linenumber, {'xmin': l_discount * 10 - 0.03, 'ymin': l_tax * 8 - 0.01, 'xmax': l_discount * 4 + l_quantity / 64, 'ymax': l_tax * 2 + l_linenumber / 6} AS a,
    {'xmin': l_tax * 10 - 0.03, 'ymin': l_discount * 8 - 0.01, 'xmax': l_tax * 4 + l_quantity / 64, 'ymax': l_discount * 2 + l_linenumber / 6} AS b FROM lineitem)"""
_GOOD = "({0}.xmin < {0}.xmax AND {0}.ymin < {0}.ymax AND {0}.xmin >= -0.02 AND {0}.ymin >= -0.02 AND {0}.xmax <= 1.02 AND {0}.ymax <= 1.02)"
_QUESTIONS = """asked AS (
  SELECT c_custkey AS q_id, replace(['Summarise {} please', 'what documents do you have', 'thanks!', 'And what about it?', 'Which files mention {}?', 'compare {} and the other one?',
      'How long is the notice period for staff in the warehouse', 'help', 'list all my files', 'overview of this document'][c_custkey % 10 + 1], '{}', 'doc-' || (c_custkey % 5 + 1) || '_urgent ' || (c_custkey * 10)) AS text,
    c_custkey % 3 AS turns, c_custkey % 17 AS bases FROM customer)"""
_TITLES = "titles AS (SELECT o_orderkey AS document_id, 'Doc.' || (o_orderkey % 5 + 1) || '-Urgent' || CASE WHEN o_orderkey % 2 = 0 THEN '_' || o_orderkey ELSE '' END AS title FROM orders)"
# of the ten questions, by their number: those that ask for a whole document, and so on
_INTENT = """CASE WHEN q_id % 10 IN (0, 9) THEN true ELSE false END AS whole, q_id % 10 IN (1, 8) AS list, CASE WHEN q_id % 10 IN (2, 7) THEN 'answer-directly' ELSE 'retrieve' END AS turn,
  CASE WHEN q_id % 10 = 5 THEN 'multi-part' WHEN turns > 0 AND q_id % 10 IN (0, 1, 2, 3, 7, 8, 9) THEN 'follow-up' ELSE 'standalone' END AS plan"""
_KEY = "trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '[_\\-.]+', ' ', 'g'), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_SCOPES = f"""named AS (
  SELECT q_id, document_id FROM (
    SELECT a.q_id, t.document_id, row_number() OVER (PARTITION BY a.q_id ORDER BY length(t.k) DESC, t.document_id) AS r
    FROM (SELECT q_id, {_KEY.format('text')} AS k FROM asked) a JOIN (SELECT document_id, {_KEY.format('title')} AS k FROM titles) t ON length(t.k) >= 3 AND contains(a.k, t.k)) WHERE r = 1),
scopes AS (
  SELECT asked.q_id, CASE WHEN asked.q_id % 10 IN (0, 9) AND document_id IS NOT NULL THEN 'document' ELSE 'search' END AS mode,
    CASE WHEN asked.q_id % 10 IN (0, 9) AND document_id IS NOT NULL THEN 'named' END AS reason, CASE WHEN asked.q_id % 10 IN (0, 9) THEN document_id END AS document_id FROM asked LEFT JOIN named USING (q_id))"""

ORACLE_SQL = {
    "search_keys": r"""
SELECT p_partkey, trim(regexp_replace(lower(m), '[^a-z0-9]+', ' ', 'g')) AS search_key, regexp_replace(left(regexp_replace(regexp_replace(lower(m), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 20), '_+$', '') AS slug,
  left('mcp_' || regexp_replace(left(regexp_replace(regexp_replace(lower(p_type), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 20), '_+$', '') || '_' || regexp_replace(m, '[^A-Za-z0-9_-]', '_', 'g'), 64) AS tool,
  p_brand AS short, trim(regexp_replace(regexp_replace(lower(m), '[*_#`<>]', '', 'g'), '\s+', ' ', 'g')) AS text_key
FROM (SELECT *, p_name || '/' || p_type || '/' || p_brand AS m FROM part)""",
    "fenced_texts": "SELECT p_partkey, '<<' || p_name || '>> ' || p_type || '<<>>' AS text FROM part",
    "formatted": r"""
WITH v AS (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 7 THEN l_partkey * l_linenumber * l_linenumber * 17 END AS ms,
    CASE WHEN l_linenumber = 1 THEN 0 WHEN l_linenumber < 4 THEN l_partkey / 64.0::DOUBLE WHEN l_linenumber < 7 THEN l_quantity / 4096 END AS u FROM lineitem),
w AS (SELECT *, greatest(2, least(7, 1 - floor(log10(nullif(u, 0)))))::INTEGER AS places FROM v)
SELECT l_orderkey, l_linenumber,
  CASE WHEN ms IS NULL THEN '–' WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 10000 THEN printf('%.1f', round(ms / 1000, 1)) || ' s' WHEN ms < 60000 THEN round(ms / 1000)::BIGINT || ' s'
    ELSE (ms // 60000) || ' m ' || round((ms % 60000) / 1000)::BIGINT || ' s' END AS duration,
  CASE WHEN u IS NULL THEN '–' WHEN u = 0 THEN '$0' WHEN u >= 1 THEN '$' || printf('%.2f', round(u, 2)) ELSE '$' || left(printf('%.7f', round(u * pow(10, places)) / pow(10, places)), places + 2) END AS usd
FROM w""",
    "doc_snippets": r"""
WITH t AS (SELECT p_partkey, repeat(p_type || ' ', p_size) || p_name || ' zebra ' || repeat(p_brand || ' ', p_size) AS t FROM part),
a AS (SELECT *, strpos(lower(t), 'zebra') - 1 AS pos FROM t),
s AS (SELECT *, length(b) - strpos(reverse(b), ' ') + 1 AS start FROM (SELECT *, left(t, floor(pos - 160.0 / 3)::INTEGER + 1) AS b FROM a))
SELECT p_partkey, CASE WHEN pos < 80 THEN CASE WHEN length(t) > 160 THEN rtrim(left(t, 160)) || '…' ELSE t END
  ELSE '…' || rtrim(substr(t, start + 1, 160)) || CASE WHEN start + 160 < length(t) THEN '…' ELSE '' END END AS snippet FROM s""",
    "indexed_texts": r"""
SELECT p_partkey, concat_ws(' ', CASE WHEN p_size % 2 = 0 THEN p_type END, CASE WHEN p_size % 3 = 0 THEN p_brand END, p_name) AS text, p_name || ', page ' || p_size || ':' || chr(10) || p_type AS passage,
  concat_ws(' — ', p_name || ' v 2', CASE WHEN p_size % 2 = 0 THEN p_type END) || chr(10) || p_brand AS embedded FROM part""",
    "repaired_tables": r"""
SELECT p_partkey, CASE WHEN p_size % 7 = 0 THEN rtrim(p_name) WHEN p_size % 5 = 3 THEN '\begin{tabular}' || chr(10) || p_name || 'a & b' || chr(10) || '\end{tabular}'
    WHEN p_size % 5 IN (0, 4) THEN '\begin{tabular}' || chr(10) || p_name || '\end{tabular}' ELSE '\begin{tabular}' || chr(10) || rtrim(p_name) || chr(10) || '\end{tabular}' END AS text,
  p_size % 7 <> 0 AND p_size % 5 IN (1, 2, 3) AS truncated FROM part""",
    "box_rules": f"""
WITH {_BOXES},
u AS (SELECT *, greatest(0, greatest(a.xmax, b.xmax) - least(a.xmin, b.xmin)) * greatest(0, greatest(a.ymax, b.ymax) - least(a.ymin, b.ymin)) AS area,
  least(a.xmax, b.xmax) - greatest(a.xmin, b.xmin) AS common, least(a.xmax - a.xmin, b.xmax - b.xmin) AS shorter,
  greatest(0, floor((a.xmin - 0.012::DOUBLE) * 800)) AS l, greatest(0, floor((a.ymin - 0.012::DOUBLE) * 1100)) AS t, least(800, ceil((a.xmax + 0.012::DOUBLE) * 800)) AS r, least(1100, ceil((a.ymax + 0.012::DOUBLE) * 1100)) AS m FROM boxes)
SELECT l_orderkey, l_linenumber, {_GOOD.format('a')} AS usable, round(area, 9) AS area, greatest(0, a.xmax - a.xmin) * greatest(0, a.ymax - a.ymin) >= 0.25 AS describable,
  round(CASE WHEN common > 0 AND shorter > 0 THEN common / shorter ELSE 0 END, 9) AS overlap, l::BIGINT AS left, t::BIGINT AS top, greatest(1, r - l)::BIGINT AS width, greatest(1, m - t)::BIGINT AS height FROM u""",
    "citation_boxes": f"""
WITH {_BOXES},
c AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 1 THEN CASE WHEN a = b THEN [a] ELSE [a, b] END WHEN l_linenumber % 2 = 0 THEN [b] ELSE [] END AS list FROM boxes),
k AS (SELECT l_orderkey, l_linenumber, list_distinct(list_transform(list_filter(list, lambda x: {_GOOD.format('x')}),
  lambda x: {{'a': least(1.0, greatest(0.0, x.xmin)), 'b': least(1.0, greatest(0.0, x.ymin)), 'c': least(1.0, greatest(0.0, x.xmax)), 'd': least(1.0, greatest(0.0, x.ymax))}})) AS list FROM c)
SELECT l_orderkey, l_linenumber, len(list)::BIGINT AS n, round(coalesce(list_sum(list_transform(list, lambda x: x.c - x.a)), 0), 9) AS width FROM k""",
    "loader_formats": f"""
SELECT o_orderkey, CASE m WHEN 'text/html' THEN 'html' WHEN 'text/markdown' THEN 'markdown' ELSE 'pdf' END AS loader, CASE WHEN m <> '' AND m <> 'application/pdf' THEN 'section' END AS unit FROM (SELECT o_orderkey, {_MIME} AS m FROM orders)""",
    "upload_checks": f"""
SELECT o_orderkey, CASE WHEN s <= 0 THEN 'File is empty.' WHEN s > 20971520 THEN 'File exceeds the 20 MB upload limit.' WHEN m NOT IN ('application/pdf', 'text/html', 'text/markdown') THEN 'File type "' || m || '" isn''t allowed.'
  WHEN o_custkey * 40000 + s > 52428800 THEN 'This would exceed your 50 MB storage quota.' END AS error FROM (SELECT o_orderkey, o_custkey, trunc(o_totalprice * 60)::BIGINT - 200000 AS s, coalesce({_MIME}, 'None') AS m FROM orders)""",
    "address_checks": r"""
WITH f AS (SELECT *, ['10', '100', '172', '192.168', '198', '8', '203.0', '224', '169.254', '1'][l_linenumber + l_suppkey % 3] AS h FROM lineitem),
a AS (SELECT *, string_split(CASE WHEN contains(h, '.') THEN h || '.' || l_partkey % 256 || '.' || l_suppkey % 256 ELSE h || '.' || l_partkey % 130 || '.' || l_suppkey % 256 || '.' || l_linenumber END, '.')::INTEGER[] AS o FROM f),
u AS (SELECT *, l_suppkey % 6 AS s, l_partkey % 5 AS p,
  'site' || l_linenumber || '.org' AS host FROM a)
SELECT l_orderkey, l_linenumber,
  NOT (o[1] IN (0, 10, 127) OR o[1] >= 224 OR (o[1] = 100 AND o[2] BETWEEN 64 AND 127) OR (o[1] = 169 AND o[2] = 254) OR (o[1] = 172 AND o[2] BETWEEN 16 AND 31) OR (o[1] = 192 AND o[2] = 168)
    OR (o[1] = 192 AND o[2] = 0 AND o[3] IN (0, 2)) OR (o[1] = 192 AND o[2] = 88 AND o[3] = 99) OR (o[1] = 198 AND o[2] IN (18, 19)) OR (o[1] = 198 AND o[2] = 51 AND o[3] = 100) OR (o[1] = 203 AND o[2] = 0 AND o[3] = 113)) AS public,
  CASE WHEN s = 4 AND p IN (0, 3) THEN 'That is not a valid web address.' WHEN s IN (2, 4) THEN 'Only http and https addresses can be added.' WHEN s = 3 THEN 'Addresses with a user name or password cannot be added.'
    WHEN p = 4 OR (p = 1 AND s IN (1, 5)) OR (p = 2 AND s = 0) THEN 'Only the standard web ports can be used.' WHEN l_linenumber > 3 THEN CASE WHEN s = 5 THEN 'docs.' ELSE '' END || host || ' is not on this server''s list of allowed sites.' END AS error
FROM u""",
    "retrieved_rows": f"""
WITH {_DOCUMENTS}, {_CHUNKS}, {_FILES}
SELECT document_id % 50 AS q_id, chunk_index AS rank, chunk_id, document_id, title, CASE WHEN mime <> '' AND mime <> 'application/pdf' THEN 'section' END AS unit
FROM chunks JOIN documents_ USING (document_id) LEFT JOIN files USING (file_id) WHERE page = 1""",
    "listed_documents": f"""
WITH {_DOCUMENTS}, {_FILES} SELECT document_id, n_name AS base, title, mime FROM documents_ JOIN nation ON n_nationkey = base_id LEFT JOIN files USING (file_id) WHERE status = 'ready'""",
    "citation_lookup": f"""
WITH {_DOCUMENTS}, {_CHUNKS}, {_FILES} SELECT chunk_id, document_id, title, page, coalesce(mime, 'application/pdf') AS mime FROM chunks JOIN documents_ USING (document_id) LEFT JOIN files USING (file_id) WHERE owner_id = 3""",
    "users_with_roles": """
SELECT c_custkey AS user_id, coalesce(string_agg(DISTINCT CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' END, ',' ORDER BY CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' END), '') AS roles
FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1""",
    "backfilled_bases": "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 2 THEN l_suppkey ELSE o_custkey END AS base FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey",
    "conversation_scope": "SELECT DISTINCT conv_id, n_nationkey AS base_id FROM conversations JOIN nation ON n_regionkey = conv_id % 5",
    "attached_vectors": "SELECT vec_id AS chunk_id, lang AS owner_id, source AS base_id FROM (SELECT DISTINCT vec_id FROM embeddings WHERE vec_id % 3 <> 0) JOIN documents ON doc_id = vec_id",
    "activation_guard": """
SELECT count(*) AS total, count(*) FILTER (WHERE vec_id IS NULL) AS missing, count(*) FILTER (WHERE vec_id IS NULL) = 0 AND count(*) > 0 AS ready FROM documents LEFT JOIN (SELECT DISTINCT vec_id FROM embeddings) ON vec_id = doc_id""",
    "section_pages": f"WITH {_CHUNKS} SELECT document_id, page, chunk_index, chunk_id FROM chunks QUALIFY count(*) OVER (PARTITION BY document_id, page) >= 2",
    "whole_document": f"WITH {_CHUNKS} SELECT document_id, chunk_index, chunk_id, 1.0::DOUBLE AS similarity FROM chunks c WHERE (document_id, chunk_index) IN (SELECT (document_id, chunk_index) FROM chunks WHERE page = 2)",
    "document_list": f"""
WITH {_DOCUMENTS}, {_CHUNKS}, p AS (SELECT document_id, count(*) AS chunks, count(DISTINCT page) AS pages FROM chunks GROUP BY 1)
SELECT document_id, coalesce(chunks, 0) AS chunks, document_id % 2 = 0 AND (document_id % 14 = 0 OR document_id % 9 = 0 OR coalesce(pages, 0) < 3) AS partial FROM documents_ LEFT JOIN p USING (document_id)""",
    "newest_runs": "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 50",
    "latest_versions": "SELECT o_custkey, max(o_orderkey) AS o_orderkey, arg_max(o_orderstatus, o_orderkey) AS o_orderstatus FROM orders GROUP BY 1",
    "cascade_delete": f"WITH {_CHUNKS} SELECT chunk_id FROM chunks WHERE document_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')",
    "index_differences": """
SELECT DISTINCT coalesce(doc_id, v) AS id, CASE WHEN v IS NULL THEN 'listed' ELSE 'there' END AS side FROM documents FULL JOIN (SELECT vec_id * 2 AS v FROM embeddings) ON doc_id = v WHERE doc_id IS NULL OR v IS NULL""",
    "run_details": f"""
SELECT o_orderkey AS run_id, o_orderstatus, steps, usd FROM orders LEFT JOIN (
  SELECT l_orderkey, string_agg(l_returnflag, ',' ORDER BY l_linenumber, l_returnflag) AS steps, round(sum(CASE WHEN l_linestatus = 'O' THEN l_quantity::BIGINT * 2.5::DOUBLE / 1e6 END), 9) AS usd FROM {_LINES} GROUP BY 1) ON l_orderkey = o_orderkey""",
    "span_trees": f"""
WITH RECURSIVE t AS (
  SELECT l_orderkey AS run_id, l_linenumber AS key, 0 AS depth, l_linenumber::VARCHAR AS path FROM {_LINES} a
  WHERE l_linenumber = 1 OR NOT EXISTS (FROM {_LINES} b WHERE b.l_orderkey = a.l_orderkey AND b.l_linenumber = a.l_linenumber // 2)
  UNION ALL SELECT run_id, l_linenumber, depth + 1, path || '/' || l_linenumber FROM t JOIN {_LINES} ON l_orderkey = run_id AND l_linenumber > 1 AND l_linenumber // 2 = key)
SELECT * FROM t""",
    "span_annotations": f"""
SELECT l_orderkey AS run_id, l_linenumber % 2 AS key, sum(CASE WHEN l_suppkey % 2 > 0 THEN l_quantity::BIGINT END)::BIGINT AS tokens, arg_max(l_returnflag, l_linenumber) FILTER (WHERE l_suppkey % 3 > 0) AS model FROM {_LINES} GROUP BY 1, 2""",
    "ingestion_kpis": f"""
WITH {_DOCUMENTS}, {_CHUNKS}, p AS (SELECT document_id, count(*) AS chunks, count(DISTINCT page) AS pages FROM chunks GROUP BY 1)
SELECT count(*) AS documents, count(*) FILTER (WHERE status = 'ready') AS ready, count(*) FILTER (WHERE status = 'failed') AS failed, count(*) FILTER (WHERE status = 'processing') AS processing,
  coalesce(sum(pages) FILTER (WHERE status = 'ready'), 0)::BIGINT AS pages, coalesce(sum(chunks) FILTER (WHERE status = 'ready'), 0)::BIGINT AS chunks FROM documents_ LEFT JOIN p USING (document_id)""",
    "stranded_documents": f"WITH {_DOCUMENTS} SELECT document_id, attempts FROM documents_ WHERE status = 'processing' AND attempts < 3 AND leased_at < TIMESTAMP '1995-06-01 00:00:00' - INTERVAL 10 MINUTE",
    "citations": f"""
WITH {_CHUNKS} SELECT document_id % 97 AS q_id, row_number() OVER (PARTITION BY document_id % 97 ORDER BY document_id * 8 + chunk_index)::INTEGER AS index, chunk_id, document_id % 11 AS document_id, page, round(score / 51, 4) AS similarity FROM chunks""",
    "grouped_citations": f"""
WITH {_CHUNKS}, c AS (SELECT document_id % 97 AS q_id, row_number() OVER (PARTITION BY document_id % 97 ORDER BY document_id * 8 + chunk_index) AS i, document_id % 11 AS document_id, page, CASE WHEN page = 0 THEN 'section' ELSE 'page' END AS unit FROM chunks)
SELECT q_id, row_number() OVER (PARTITION BY q_id ORDER BY min(i))::INTEGER AS place, document_id, unit, page, string_agg(i, ',' ORDER BY i) AS numbers FROM c GROUP BY q_id, document_id, unit, page""",
    "best_similarities": "SELECT c_custkey, max(o_totalprice) AS best, count(o_totalprice) AS sources FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1",
    "question_intents": f"WITH {_QUESTIONS} SELECT q_id, {_INTENT} FROM asked",
    "question_scopes": f"WITH {_QUESTIONS}, {_TITLES}, {_SCOPES} SELECT * FROM scopes",
    "evidence_routes": f"""
WITH {_QUESTIONS}, {_TITLES}, {_SCOPES}, i AS (SELECT q_id, bases, {_INTENT} FROM asked)
SELECT q_id, CASE WHEN bases = 0 THEN 'no-scope' WHEN turn = 'answer-directly' THEN 'direct' WHEN list THEN 'list' WHEN mode = 'document' THEN 'whole-document' WHEN plan <> 'standalone' THEN 'planner' ELSE 'search' END AS route FROM i JOIN scopes USING (q_id)""",
    "page_routes": """
WITH r AS (
  SELECT l_orderkey, CASE WHEN l_quantity * 10 < 60 THEN 'no-text' WHEN l_suppkey % 3 >= 2 THEN 'structured' WHEN l_linenumber % 5 > 0 AND l_tax > 0 AND l_quantity / (l_tax / 2 * 100) >= 10 THEN 'structured'
    WHEN l_partkey % 11 = 0 OR l_partkey % 7 >= 6 THEN 'image-heavy' ELSE 'clean-text' END AS route FROM lineitem)
SELECT l_orderkey, route, count(*) AS pages, count(*) FILTER (WHERE route <> 'clean-text') AS crackable FROM r GROUP BY 1, 2""",
    "multi_hop_scores": """
SELECT count(*) AS questions, round(avg(CASE WHEN n = f THEN 1.0 ELSE 0 END), 3) AS full_match, round(avg(f / n), 3) AS fact_recall FROM (SELECT l_orderkey, count(*) AS n, count(*) FILTER (WHERE l_quantity > 10) AS f FROM lineitem GROUP BY 1)""",
    "summary_scores": "SELECT count(*) AS questions, round(avg(CASE WHEN ok THEN 1.0 ELSE 0 END), 3) AS complete FROM (SELECT l_orderkey, bool_and(l_quantity > 5) AS ok FROM lineitem GROUP BY 1)",
    "latency_summary": """
SELECT l_returnflag AS mode, round(avg(l_partkey), 3) AS mean_ms, round(median(l_partkey), 3)::DOUBLE AS median_ms, max(l_partkey) AS max_ms, round(avg(l_linenumber), 3) AS searches, round(avg(l_quantity), 3) AS tokens FROM lineitem GROUP BY 1""",
    "judge_rows": """
SELECT round(avg(m), 3) AS mean, count(*) AS judged, count(*) FILTER (WHERE s >= 1) AS unsure FROM (SELECT median(l_suppkey % 3) AS m, max(l_suppkey % 3) - min(l_suppkey % 3) AS s FROM lineitem WHERE l_linenumber < 6 GROUP BY l_orderkey)""",
    "answer_expectations": r"""
WITH a AS (SELECT p_partkey AS q_id, p_brand || ' ' || p_name || ' ' || p_type AS t, p_size, substr(p_type, 1, 4) AS w FROM part),
b AS (SELECT q_id, p_size % 4 = 0 OR (contains(lower(t), 'brand') AND contains(lower(t), lower(w))) AS contains, p_size % 3 <> 0 OR NOT regexp_matches(t, '#[1-3]') AS clean FROM a)
SELECT *, contains AND clean AS passed FROM b""",
    "parent_outcomes": """
WITH a AS (SELECT o_orderkey AS q_id, o_orderstatus = 'F' AS before FROM orders WHERE o_orderkey % 5 > 0), b AS (SELECT o_orderkey AS q_id, o_totalprice > 200000 AS after FROM orders WHERE o_orderkey % 7 > 0)
SELECT * FROM a FULL JOIN b USING (q_id) WHERE before IS DISTINCT FROM after""",
    "answer_precision": """
SELECT round(count(*) FILTER (WHERE l_linenumber < 6 AND l_tax > 0.02) / count(*) FILTER (WHERE l_linenumber < 6), 3) AS support_rate, round(sum(least(l_linenumber % 4, l_suppkey % 3)) / sum(l_linenumber % 4), 3) AS citation_precision FROM lineitem""",
    "faithfulness": "SELECT l_orderkey AS q_id, round(avg(CASE WHEN l_linenumber > 1 THEN l_suppkey % 3 END), 3) AS faithfulness FROM lineitem GROUP BY 1",
    "release_gate": """
WITH r AS (SELECT CASE l_returnflag WHEN 'A' THEN 'refusal_accuracy' WHEN 'N' THEN 'leakage' ELSE 'hit@1' END AS metric, round(avg(CASE WHEN l_quantity > 20 THEN 1.0 ELSE 0 END), 3) AS value, round(avg(CASE WHEN l_tax > 0.04 THEN 1.0 ELSE 0 END), 3) AS baseline FROM lineitem GROUP BY l_returnflag)
SELECT *, CASE metric WHEN 'leakage' THEN value = 0 WHEN 'refusal_accuracy' THEN value >= baseline ELSE round(value, 6) >= round(baseline - 0.05, 6) END AS passed FROM r""",
    "leaked_chunks": f"""
WITH {_CHUNKS}, s AS (SELECT DISTINCT document_id % 40 AS q, page AS b FROM chunks WHERE page < 3 AND document_id % 40 % 4 <> page)
SELECT document_id % 40 AS q_id, count(*) FILTER (WHERE b IS NULL) AS leaked FROM chunks LEFT JOIN s ON q = document_id % 40 AND b = page GROUP BY 1""",
    "section_passes": f"""
WITH {_CHUNKS}, r AS (SELECT document_id % 300 AS q_id, chunk_id, page, chunk_index FROM chunks),
alone AS (SELECT a.q_id, a.chunk_id FROM r a WHERE a.page >= 2 AND EXISTS (FROM r b WHERE b.q_id = a.q_id AND b.chunk_id = a.chunk_id + 1 AND b.page < 2))
SELECT q_id, bool_or(page >= 2 AND page = 2 + q_id % 2 AND (q_id, chunk_id) NOT IN (SELECT (q_id, chunk_id) FROM alone)) AS passed FROM r GROUP BY 1""",
    "run_outcomes": """
SELECT ts::DATE::VARCHAR AS day, count(*) AS runs, count(*) FILTER (WHERE event_type IN ('view', 'purchase')) AS answered, count(*) FILTER (WHERE event_type = 'click') AS refused, count(*) FILTER (WHERE event_type IN ('error', 'signup')) AS failed,
  round(quantile_cont(value, 0.5), 6) AS median_ms, round(quantile_cont(value, 0.95), 6) AS p95_ms, round(quantile_cont(CASE WHEN event_id % 3 > 0 THEN value / 4 END, 0.5), 6) AS ttft_ms,
  coalesce(sum(CASE WHEN event_id % 2 > 0 THEN user_id END), 0)::BIGINT AS tokens FROM events GROUP BY 1""",
    "log_tail": """
(SELECT event_id AS id, event_type AS level, 'after' AS page FROM events WHERE event_id > 500 ORDER BY event_id LIMIT 50) UNION ALL (SELECT event_id, event_type, 'newest' FROM events ORDER BY event_id DESC LIMIT 50)""",
}
