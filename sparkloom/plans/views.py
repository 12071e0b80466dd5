"""Buckets of outcomes, costs, accumulated evidence, addresses and conversations over the test tables, with SQL for the same results."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import details, rules
from ..functions.render import canonical_json
from ..operators import retrieval as R
from ..operators import search as D
from ..operators import telemetry as O
from ..operators import tenancy as T
from . import rules_sql
from .catalog import START, questions, read, spans, vectors


def outcome_buckets(spark, d):
    status = F.element_at(F.create_map(*map(F.lit, ("view", "ok", "purchase", "ok", "click", "refused", "error", "error", "signup", "cancelled"))), F.col("event_type"))
    runs = read(spark, d, "events").select(
        F.col("ts").alias("started_at"), status.alias("status"), F.col("value").alias("duration_ms"), F.when(F.col("event_id") % 3 > 0, F.col("value") / 4).alias("ttft_ms"), F.when(F.col("event_id") % 2 > 0, F.col("user_id")).alias("tokens")
    )
    return O.outcome_buckets(runs, START, 6 * 3600, 28)


def run_endings(spark, d):
    mode = F.element_at(F.array(F.lit("agentic"), F.lit("fixed"), F.lit(None)), (F.col("o_orderkey") % 3 + 1).cast("int"))
    ending = F.when(F.col("o_orderkey") % 4 > 0, F.col("o_orderpriority"))
    return O.endings(read(spark, d, "orders").select(mode.alias("mode"), ending.alias("termination")))


def cost_summary(spark, d):
    model = F.when(F.col("tokens") % 7 > 0, F.concat("model", F.col("step")))
    return O.cost_summary(spans(spark, d).withColumn("model", model), spark.createDataFrame([("OA", 2.5), ("OR", 1.0), ("FN", 4.0), ("unused", 1.0)], "model string, price double"))


def accumulated_parents(spark, d):
    """Lines are chunks, found by several searches; every fifth part came as a parent of itself and the two after it."""
    key = F.col("l_partkey")
    parent = (key % 5 == 0) & (F.col("l_linenumber") < 4)
    rows = read(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("q_id"), key.alias("chunk_id"), F.col("l_discount").alias("similarity"), F.when(parent, F.array(key, key + 1, key + 2)).alias("member_ids"))
    return R.accumulate_parents(rows).select("q_id", "chunk_id", "parent", "similarity", "seen", "place", F.array_join(F.col("member_ids").cast("array<string>"), ",").alias("members"))


def generation_similarity(spark, d):
    """Every question beside every tenth vector of its scope, in a generation that lacks a third of them; another has all of them turned round."""
    held = vectors(spark, d)
    made = held.where("chunk_id % 3 > 0").withColumn("generation_id", F.lit("new")).unionByName(held.withColumn("embedding", F.transform("embedding", lambda x: -x)).withColumn("generation_id", F.lit("old")))
    pairs = questions(spark, d).select("q_id", "scope", F.col("embedding").alias("q")).join(held.where("chunk_id % 10 = 0").select("scope", "chunk_id"), "scope")
    return R.generation_similarity(pairs, made, "new")


#: Forms of addresses, with x for a number, and whether they are public.
ADDRESSES = [
    ("2a00:1450::x", True), ("fe80::x%eth0", False), ("::ffff:8.8.x.4", True), ("::ffff:10.0.0.x", False), ("2001:db8::x", False), ("64:ff9b::808:x", True), ("64:ff9b::a00:x", False), ("1::x::2", False), ("2002:808:808::x", False), ("2600:1:2:3:4:5:6:x", True), ("2600:1:2:3:4:5:6:7:x", False),
    ("::x", False), ("8.8.x.8", True), ("127.0.0.x", False), ("2A00:0:0::1.2.3.x", True), ("fc00::x", False), ("12345::x", False), ("3fff:1::x", True), ("::ffff:8.8.8", False), ("", False),
]


def public_addresses(spark, d):
    form = F.element_at(F.array(*(F.lit(a) for a, _ in ADDRESSES)), (F.col("s_suppkey") % len(ADDRESSES) + 1).cast("int"))
    rows = read(spark, d, "supplier").select("s_suppkey", F.replace(form, F.lit("x"), (F.col("s_suppkey") % 99 + 1).cast("string")).alias("address"))
    return rows.select("s_suppkey", "address", rules.public_address(F.col("address")).alias("public"))


def conversation_view(spark, d):
    """Each conversation with its messages in order and the bases that it may search."""
    rows = read(spark, d, "conversations")
    said = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    whole = rows.groupBy("conv_id").agg(said.alias("m"))
    scope = rows.select("conv_id", (F.col("turn") % 3).alias("base")).distinct().groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_list(F.col("base").cast("string"))), ",").alias("bases"))
    return whole.join(scope, "conv_id", "left").select("conv_id", F.size("m").cast("long").alias("messages"), F.array_join("m.role", ",").alias("roles"), F.md5(F.array_join("m.text", "|")).alias("texts_md5"), "bases")


def json_keys(spark, d):
    """Details of events written in two orders meet by their canonical text; a third, with a number as text, meets none of them."""
    user, kind = F.col("user_id"), F.concat(F.lit('"'), "event_type", F.lit('"'))
    rows = read(spark, d, "events").select(
        F.col("event_id").alias("id"), F.concat(F.lit('{"kind": '), kind, F.lit(', "by": {"user": '), user, F.lit(', "at": [1, 2]}}')).alias("a"), F.concat(F.lit('{"by":{"at":[1,2],"user":'), user, F.lit('},"kind":'), kind, F.lit("}")).alias("b"),
        F.concat(F.lit('{"by":{"at":[1,2],"user":"'), user, F.lit('"},"kind":'), kind, F.lit("}")).alias("c"),
    )
    key = lambda c: rows.select("id", canonical_json(F.col(c)).alias("key"))
    other = key("b").unionAll(key("c")).groupBy("key").agg(F.count("*").alias("n"))
    return key("a").join(other, "key").groupBy("key").agg(F.count("*").alias("events"), F.max("n").alias("others"))


def permitted_bases(spark, d):
    """Questions of five owners: every third requests nothing, every fourth a base that isn't its owner's besides one that is."""
    asked = read(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), (F.col("item_id") % 5).cast("int").alias("owner_id"))
    owned = read(spark, d, "nation").select(F.col("n_regionkey").cast("int").alias("owner_id"), F.col("n_nationkey").alias("base_id"))
    requested = asked.where("q_id % 3 > 0").select("q_id", F.explode(F.array(F.col("q_id") % 25, (F.col("q_id") + 1) % 25, F.when(F.col("q_id") % 4 == 0, 99).otherwise((F.col("q_id") + 7) % 25))).alias("base_id"))
    return T.permitted(asked, owned.withColumn("base_id", F.col("base_id").cast("int")), requested.withColumn("base_id", F.col("base_id").cast("int")))


def bridged_scope(spark, d):
    talks = read(spark, d, "conversations").select("conv_id", (F.col("conv_id") % 5).cast("int").alias("owner_id")).distinct()
    bridge = read(spark, d, "conversations").select("conv_id", ((F.col("conv_id") + F.col("turn")) % 25).cast("int").alias("base_id"))
    owned = read(spark, d, "nation").select(F.col("n_regionkey").cast("int").alias("owner_id"), F.col("n_nationkey").cast("int").alias("base_id"))
    return T.stored_scope(talks, bridge, owned)


def document_outline(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), F.col("doc_id").alias("chunk_index"), (F.col("n_chars") % 9).alias("page"), F.substring("text", 1, 9).alias("heading"), F.col("lang").alias("owner_id"), F.col("source").alias("base_id"))
    return T.outline(docs, "en", ["src1", "src2", "src3"])


def recent_conversations(spark, d):
    talks = read(spark, d, "conversations").select("conv_id").distinct().select((F.col("conv_id") % 2).alias("owner_id"), "conv_id", F.date_sub(F.lit("2024-05-01").cast("date"), (F.col("conv_id") * 7 % 20).cast("int")).cast("timestamp_ntz").alias("updated"))
    return D.recents(talks, F.lit("2024-05-01").cast("date"))


def bucket_keys(spark, d):
    random = F.concat_ws("-", F.substring(F.md5("p_name"), 1, 8), F.substring(F.md5("p_name"), 9, 4))
    return read(spark, d, "part").select("p_partkey", D.bucket_key(F.col("p_size"), random, F.concat(F.lit("a/"), "p_type")).alias("key"))


def span_errors(spark, d):
    """Fields of the details, which are JSON text: as text, as a number, null where they lack it."""
    made = F.when(F.col("event_type") == "error", F.concat(F.lit('{"error": "bad \\"'), "user_id", F.lit('\\"", "step": {"n": '), F.col("event_id") % 9, F.lit("}}"))).otherwise(F.concat(F.lit('{"step": {"n": "'), F.col("user_id"), F.lit('"}}')))
    field = lambda path: F.get_json_object(made, path)
    return read(spark, d, "events").select(F.col("event_id").alias("id"), field("$.error").alias("error"), field("$.step.n").cast("long").alias("n"))


def redacted_details(spark, d):
    """Secrets by name and by look, in nested details."""
    made = F.concat(
        F.lit('{"user": '), "user_id", F.lit(', "api_key": "abc", "note": "with Bearer abcdefgh'), "event_id", F.lit('", "deep": [[[[[[["x"]]]]]]], "token": 5, "password": null, "nested": {"session_token": ["a"], "keyboard": "ok", "key": "k"}, "many": ['), F.repeat(F.lit("1,"), 101), F.lit("1]}")
    )
    return read(spark, d, "events").select(F.col("event_id").alias("id"), details.redacted_details(F.when(F.col("event_id") % 10 > 0, made).otherwise(F.lit("no json"))).alias("details"))


def image_only(spark, d):
    """Documents (here conversations, a page a turn) whose pages have too few characters on average to be text."""
    return read(spark, d, "conversations").groupBy("conv_id").agg((F.avg(F.length(F.trim(F.substring("text", 1, 60)))) < 50).alias("image_only"))


_BUCKETS = rules_sql.ORACLE_SQL["run_outcomes"].replace("ts::DATE::VARCHAR AS day", "(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-08')) // 21600000000 AS bucket").replace("FROM events", "FROM events WHERE ts >= TIMESTAMP '2024-01-08' AND ts < TIMESTAMP '2024-01-15'")
_PUBLIC = ", ".join(f"('{a}', {str(p).lower()})" for a, p in ADDRESSES)

ORACLE_SQL = {
    "outcome_buckets": f"""
WITH b AS ({_BUCKETS})
SELECT r.range AS bucket, coalesce(runs, 0) AS runs, coalesce(answered, 0) AS answered, coalesce(refused, 0) AS refused, coalesce(failed, 0) AS failed, coalesce(tokens, 0) AS tokens, median_ms, p95_ms, ttft_ms FROM range(28) r LEFT JOIN b ON b.bucket = r.range""",
    "run_endings": """
WITH r AS (SELECT ['agentic', 'fixed', NULL][o_orderkey % 3 + 1] AS mode, CASE WHEN o_orderkey % 4 > 0 THEN o_orderpriority END AS t FROM orders)
SELECT 'mode' AS by, coalesce(mode, 'none') AS name, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'termination', coalesce(t, 'none'), count(*) FROM r WHERE mode = 'agentic' GROUP BY 2""",
    "cost_summary": """
WITH s AS (SELECT coalesce(CASE WHEN l_quantity::BIGINT % 7 > 0 THEN l_linestatus || l_returnflag END, '(unknown)') AS model, l_quantity::BIGINT AS tokens FROM lineitem WHERE l_quantity::BIGINT > 0),
m AS (SELECT model, sum(tokens)::BIGINT AS tokens FROM s GROUP BY 1),
p AS (SELECT m.*, price FROM m LEFT JOIN (VALUES ('OA', 2.5::DOUBLE), ('OR', 1.0), ('FN', 4.0)) v(model, price) USING (model))
SELECT model, sum(tokens)::BIGINT AS tokens, coalesce(sum(tokens) FILTER (WHERE price IS NOT NULL), 0)::BIGINT AS priced, coalesce(sum(tokens) FILTER (WHERE price IS NULL), 0)::BIGINT AS unpriced, round(sum(tokens * price / 1e6), 6) AS usd FROM p GROUP BY ROLLUP (model)""",
    "accumulated_parents": """
WITH r AS (SELECT l_orderkey % 50 AS q, l_partkey AS c, l_discount AS s, l_partkey % 5 = 0 AND l_linenumber < 4 AS p FROM lineitem),
i AS (SELECT DISTINCT q, unnest([c, c + 1, c + 2]) AS c, c AS o FROM r WHERE p),
k AS (SELECT r.*, CASE WHEN p THEN r.c ELSE i.o END AS o FROM r LEFT JOIN i USING (q, c)),
g AS (SELECT q, o IS NOT NULL AS parent, coalesce(o, c) AS c, max(s) AS s, count(*) AS seen FROM k GROUP BY 1, 2, 3)
SELECT q AS q_id, c AS chunk_id, parent, s AS similarity, seen, row_number() OVER (PARTITION BY q ORDER BY s DESC, c, parent)::INTEGER AS place, CASE WHEN parent THEN concat_ws(',', c, c + 1, c + 2) END AS members FROM g""",
    "generation_similarity": """
SELECT q.item_id AS q_id, d.doc_id AS chunk_id, CASE WHEN d.doc_id % 3 > 0 THEN round(list_cosine_similarity(e.embedding::DOUBLE[], o.embedding::DOUBLE[]), 6) ELSE 0 END AS similarity
FROM benchmark q JOIN embeddings o ON o.vec_id = q.item_id JOIN documents d ON d.lang = 'en' AND d.doc_id % 10 = 0 JOIN embeddings e ON e.vec_id = d.doc_id""",
    "public_addresses": f"""
WITH f AS (SELECT row_number() OVER () - 1 AS i, * FROM (VALUES {_PUBLIC}) v(form, public))
SELECT s_suppkey, replace(form, 'x', (s_suppkey % 99 + 1)::VARCHAR) AS address, public FROM supplier JOIN f ON i = s_suppkey % {len(ADDRESSES)}""",
    "conversation_view": """
SELECT conv_id, count(*) AS messages, string_agg(role, ',' ORDER BY turn) AS roles, md5(string_agg(text, '|' ORDER BY turn)) AS texts_md5, array_to_string(list_sort(list(DISTINCT (turn % 3)::VARCHAR)), ',') AS bases FROM conversations GROUP BY 1""",
    "image_only": "SELECT conv_id, avg(length(trim(left(text, 60), ' '))) < 50 AS image_only FROM conversations GROUP BY 1",
    "json_keys": """SELECT '{"by":{"at":[1,2],"user":' || user_id || '},"kind":"' || event_type || '"}' AS key, count(*) AS events, count(*) AS others FROM events GROUP BY user_id, event_type""",
    "permitted_bases": """
WITH a AS (SELECT item_id AS q, (item_id % 5)::INTEGER AS o FROM benchmark), w AS (SELECT a.q, n_nationkey::INTEGER AS b FROM a JOIN nation ON n_regionkey = o)
SELECT q AS q_id, b AS base_id FROM w WHERE q % 3 = 0 OR b IN (q % 25, (q + 1) % 25, CASE WHEN q % 4 = 0 THEN 99 ELSE (q + 7) % 25 END)""",
    "bridged_scope": "SELECT DISTINCT conv_id, n_nationkey::INTEGER AS base_id FROM conversations JOIN nation ON n_nationkey = (conv_id + turn) % 25 AND n_regionkey = conv_id % 5",
    "document_outline": "SELECT doc_id AS chunk_id, source AS document_id, doc_id AS chunk_index, n_chars % 9 AS page, left(text, 9) AS heading FROM documents WHERE lang = 'en' AND source IN ('src1', 'src2', 'src3')",
    "recent_conversations": """
WITH c AS (SELECT DISTINCT conv_id, conv_id % 2 AS o, conv_id * 7 % 20 AS age FROM conversations), r AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY o ORDER BY age, conv_id) <= 50),
l AS (SELECT *, CASE WHEN age = 0 THEN 1 WHEN age = 1 THEN 2 WHEN age <= 7 THEN 3 ELSE 4 END AS k FROM r)
SELECT o AS owner_id, k::INTEGER AS label_place, ['Today', 'Yesterday', 'Previous 7 days', 'Older'][k] AS label, row_number() OVER (PARTITION BY o, k ORDER BY age, conv_id)::INTEGER AS place, conv_id FROM l""",
    "bucket_keys": "SELECT p_partkey, p_size || '/' || left(md5(p_name), 8) || '-' || substr(md5(p_name), 9, 4) || '-a_' || p_type AS key FROM part",
    "span_errors": """SELECT event_id AS id, CASE WHEN event_type = 'error' THEN 'bad "' || user_id || '"' END AS error, CASE WHEN event_type = 'error' THEN event_id % 9 ELSE user_id END AS n FROM events""",
    "redacted_details": """
SELECT event_id AS id, CASE WHEN event_id % 10 > 0 THEN '{"user":' || user_id || ',"api_key":"[redacted]","note":"with [redacted]","deep":[[[[["[too deep]"]]]]],"token":5,"password":null,"nested":{"session_token":"[redacted]","keyboard":"ok","key":"[redacted]"},"many":['
  || repeat('1,', 100) || '"… 2 more"]}' END AS details FROM events""",
    "detect_heading": r"""
WITH f AS (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1] AS h FROM documents),
w AS (SELECT *, regexp_split_to_array(h, '[ \t\n\x0B\f\r]+') AS ws, regexp_replace(h, '[^A-Za-z]', '', 'g') AS letters FROM f)
SELECT doc_id, CASE WHEN length(h) <= 90 AND NOT regexp_matches(h, '[.!?;:]$') AND length(letters) >= 3
  AND (letters = upper(letters) OR (len(ws) <= 12 AND len(list_filter(ws, lambda x: regexp_matches(x, '^[A-Z]'))) >= ceil(len(ws) / 2))) THEN h END AS heading FROM w""",
}

QUERIES = {f.__name__: f for f in (outcome_buckets, run_endings, cost_summary, accumulated_parents, generation_similarity, public_addresses, conversation_view, image_only, json_keys, permitted_bases, bridged_scope, document_outline, recent_conversations, bucket_keys, span_errors, redacted_details)}
