"""Leases and re-indexing over the test tables: events stand for requests, documents for what is claimed and indexed."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stores as T
from ..sources.shared import prune, stored
from ..streaming import events as V
from ..streaming import leases as L
from .catalog import read

HOURS = 10


def requests(events):
    kind = F.element_at(F.create_map(*map(F.lit, ("view", "claim", "click", "renew", "purchase", "finish", "error", "fail", "signup", "recovery"))), F.col("event_type"))
    return events.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("id"), kind.alias("kind"), (F.col("event_id") % 3).alias("worker"))


def stream_leases(spark, d):
    return V.appended(L.decisions(requests(V.event_stream(spark, f"{d}/events.parquet")), HOURS * 60), "leases")


def batch_leases(spark, d):
    """How the requests of each kind end."""
    rows = requests(read(spark, d, "events"))
    return L.decisions(rows, HOURS * 60).join(rows.select("id", "kind"), "id").groupBy("kind", "outcome").agg(F.count("*").alias("n"))


def recovery_sweep(spark, d):
    n = F.col("o_orderkey")
    status = F.element_at(F.array(*map(F.lit, ("pending", "extracting", "embedding", "ready", "failed"))), (n % 5 + 1).cast("int"))
    at = lambda k: F.expr(f"TIMESTAMP_NTZ'2024-05-01 12:00:00' - make_dt_interval(0, 0, CAST(o_orderkey * {k} % 40 AS INT), 0)")
    rows = read(spark, d, "orders").select(n.alias("document_id"), status.alias("status"), F.when(n % 3 > 0, at(7)).alias("claimed_at"), at(3).alias("updated_at"), (n % 4).alias("attempts"))
    return L.sweep(rows, F.expr("TIMESTAMP_NTZ'2024-05-01 12:00:00'"))


def reindexed_generations(spark, d):
    """Each language has an active generation and one in the making that holds a third of the vectors; one text of a language can't be embedded."""
    docs = read(spark, d, "documents")
    chunks = docs.select(F.col("lang").alias("owner_id"), F.col("doc_id").alias("chunk_id"), F.when(~((F.col("lang") == "fr") & (F.col("doc_id") % 50 == 7)), F.coalesce("text", F.lit(""))).alias("text"))
    control = docs.select(F.col("lang").alias("owner_id")).distinct().withColumn("s", F.explode(F.array(F.lit("active"), F.lit("building")))).select("owner_id", F.concat("owner_id", F.lit("-"), "s").alias("generation_id"), F.col("s").alias("status"))
    old = chunks.select("owner_id", F.concat("owner_id", F.lit("-active")).alias("generation_id"), "chunk_id").unionByName(chunks.where("chunk_id % 3 = 0").select("owner_id", F.concat("owner_id", F.lit("-building")).alias("generation_id"), "chunk_id"))
    embed = lambda text: F.when(text.isNotNull(), F.array(F.length(text).cast("float"), F.lit(1).cast("float")))
    vectors, after = T.reindexed(chunks, old.withColumn("embedding", F.array(F.lit(1).cast("float"))), control, embed)
    return after.join(vectors.groupBy("generation_id").agg(F.count("*").alias("vectors")), "generation_id", "left").select("owner_id", "generation_id", "status", "vectors")


def pruned_logs(spark, d):
    """A log table by day after its hourly prune: what is left of each day."""
    logs = read(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("level"), F.date_format("ts", "yyyy-MM-dd").alias("day"))
    held = stored(logs, "logs", "day")
    prune(held, "day", "2024-01-16")
    left = spark.read.schema(held.schema).parquet(held.stored_at)
    return left.groupBy("day").agg(F.count("*").alias("n"), F.max("id").alias("last_id"))


_LEASES = f"""WITH RECURSIVE r AS (
  SELECT user_id AS key, event_id AS id, epoch_us(ts) AS t, CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'renew' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' ELSE 'recovery' END AS kind, event_id % 3 AS worker,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE ts IS NOT NULL),
s AS (
  SELECT DISTINCT key, 0::BIGINT AS n, NULL::BIGINT AS id, NULL::VARCHAR AS kind, NULL::BIGINT AS holder, 0::BIGINT AS token, 0::INTEGER AS attempts, NULL::VARCHAR AS outcome FROM r
  UNION ALL
  SELECT key, n, id, kind, CASE WHEN outcome = 'granted' THEN worker WHEN outcome NOT IN ('ready', 'failed') THEN holder END, CASE WHEN outcome IN ('granted', 'renewed') THEN t ELSE token END,
    CASE WHEN outcome = 'ready' THEN 0 WHEN outcome <> 'granted' THEN attempts WHEN kind = 'claim' THEN 1 ELSE attempts + 1 END, outcome
  FROM (
    SELECT r.*, s.holder, s.token, s.attempts, CASE WHEN r.kind = 'recovery' AND s.attempts >= 3 THEN 'exhausted' WHEN r.kind IN ('claim', 'recovery') THEN CASE WHEN s.holder IS NULL OR s.token < r.t - {HOURS} * 3600000000 THEN 'granted' ELSE 'held' END
      WHEN s.holder IS DISTINCT FROM r.worker THEN 'lost' WHEN r.kind = 'renew' THEN 'renewed' WHEN r.kind = 'finish' THEN 'ready' ELSE 'failed' END AS outcome
    FROM s JOIN r ON r.key = s.key AND r.n = s.n + 1))"""

ORACLE_SQL = {
    "stream_leases": f"{_LEASES} SELECT key, id, outcome, holder::VARCHAR AS holder, attempts FROM s WHERE n > 0",
    "batch_leases": f"{_LEASES} SELECT kind, outcome, count(*) AS n FROM s WHERE n > 0 GROUP BY 1, 2",
    "recovery_sweep": """
WITH d AS (SELECT o_orderkey AS k, o_orderkey % 5 AS s, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey * 7 % 40 END AS claimed, o_orderkey * 3 % 40 AS updated FROM orders)
SELECT k AS document_id, CASE WHEN k % 4 >= 3 THEN 'abandon' ELSE 'resume' END AS action FROM d WHERE s < 3 AND (claimed IS NULL OR claimed > 10) AND updated > 1 ORDER BY updated DESC, k LIMIT 10""",
    "pruned_logs": "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n, max(event_id) AS last_id FROM events WHERE ts IS NULL OR ts >= TIMESTAMP '2024-01-16' GROUP BY 1",
    "reindexed_generations": """
WITH l AS (SELECT lang, count(*) AS n, count(*) FILTER (WHERE lang = 'fr' AND doc_id % 50 = 7 AND doc_id % 3 <> 0) AS bad FROM documents GROUP BY 1)
SELECT lang AS owner_id, lang || '-active' AS generation_id, CASE WHEN bad = 0 THEN 'retired' ELSE 'active' END AS status, n AS vectors FROM l
UNION ALL SELECT lang, lang || '-building', CASE WHEN bad = 0 THEN 'active' ELSE 'building' END, n - bad FROM l""",
}

QUERIES = {f.__name__: f for f in (stream_leases, batch_leases, recovery_sweep, reindexed_generations, pruned_logs)}
