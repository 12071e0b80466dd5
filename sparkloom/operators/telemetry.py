"""Run and span telemetry: aggregates, buckets, histograms, costs, log search.

runs: id, started_at, status, mode, duration_ms. spans: run_id, key, step, model, status, duration_ms, tokens, error, started_at.
All are one pass with map-side aggregation; percentiles come from `selection`, which never holds a large group's values in one buffer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .selection import percentiles


def between(df: DataFrame, start: str, end: str, column: str = "started_at") -> DataFrame:
    return df.where((F.col(column) >= F.lit(start).cast("timestamp_ntz")) & (F.col(column) < F.lit(end).cast("timestamp_ntz")))


def with_percentiles(found: DataFrame, rows: DataFrame, by: list[str], wanted: dict, digits: int = 6) -> DataFrame:
    """found (a row a group) with the percentiles of rows, rounded; null keys meet, too."""
    of = percentiles(rows, by, wanted).select(F.struct(*by).alias("_g") if by else F.lit(0).alias("_g"), *(F.round(name, digits).alias(name) for name in wanted))
    return found.withColumn("_g", F.struct(*by) if by else F.lit(0)).join(of, "_g", "left").drop("_g")


def kpis(runs: DataFrame) -> DataFrame:
    """Counts, error share (null without runs), percentiles and mean of the durations of runs that did not fail."""
    fine = F.col("status") != "error"
    took = F.when(fine, F.col("duration_ms"))
    found = runs.agg(
        F.count("*").alias("runs"),
        F.count(F.when(~fine, 1)).alias("errors"),
        F.round(F.try_divide(F.count(F.when(~fine, 1)), F.count("*")), 6).alias("error_rate"),
        F.round(F.avg(took), 6).alias("mean"),
    )
    return with_percentiles(found, runs, [], {"p50": (took, 0.5), "p95": (took, 0.95)})


def periods(runs: DataFrame, start: str, middle: str, end: str) -> DataFrame:
    """Counts and mean duration of two neighbouring periods, previous and current."""
    both = between(runs, start, end).withColumn("period", F.when(F.col("started_at") < F.lit(middle).cast("timestamp_ntz"), "previous").otherwise("current"))
    return both.groupBy("period").agg(F.count("*").alias("runs"), F.round(F.avg("duration_ms"), 6).alias("mean"))


def buckets(runs: DataFrame, start: str, seconds: int, n: int) -> DataFrame:
    """Buckets 0 to n - 1 of fixed width from start; empty ones have zero counts and a null percentile."""
    origin = F.unix_micros(F.lit(start).cast("timestamp"))
    number = F.floor((F.unix_micros(F.col("started_at").cast("timestamp")) - origin) / F.lit(seconds * 1_000_000)).cast("long")
    inside = runs.withColumn("bucket", number).where((F.col("bucket") >= 0) & (F.col("bucket") < n))
    counted = inside.groupBy("bucket").agg(F.count("*").alias("runs"), F.count(F.when(F.col("status") == "error", 1)).alias("errors"))
    counted = with_percentiles(counted, inside, ["bucket"], {"p50": (F.col("duration_ms"), 0.5)})
    empty = runs.sparkSession.range(n).withColumnRenamed("id", "bucket")
    return empty.join(counted, "bucket", "left").select("bucket", F.coalesce("runs", F.lit(0)).alias("runs"), F.coalesce("errors", F.lit(0)).alias("errors"), "p50")


def histogram(df: DataFrame, value: Column, bins: int = 20) -> DataFrame:
    """Counts of values of 0 to 1 in equal bins, 1 in the last; empty bins are there."""
    found = df.select(F.least(F.floor(value * bins), F.lit(bins - 1)).cast("long").alias("bin")).groupBy("bin").count()
    return df.sparkSession.range(bins).withColumnRenamed("id", "bin").join(found, "bin", "left").select("bin", F.coalesce("count", F.lit(0)).alias("n"))


def grouped(runs: DataFrame, column: str) -> DataFrame:
    return runs.groupBy(F.coalesce(column, F.lit("none")).alias(column)).agg(F.count("*").alias("n"))


def step_latency(spans: DataFrame, runs: DataFrame) -> DataFrame:
    """Per step of the given runs' spans: count, mean, 95th percentile, errors."""
    own = spans.join(runs.select(F.col("id").alias("run_id")), "run_id")
    found = own.groupBy("step").agg(F.count("*").alias("n"), F.round(F.avg("duration_ms"), 4).alias("mean"), F.count(F.when(F.col("status") == "error", 1)).alias("errors"))
    return with_percentiles(found, own, ["step"], {"p95": (F.col("duration_ms"), 0.95)}, 4)


def last_errors(spans: DataFrame, most: int = 10) -> DataFrame:
    """The latest failed span of each model and step, newest first; ties to the larger run and key."""
    newest = spans.where("status = 'error'").groupBy("model", "step").agg(F.count("*").alias("errors"), F.max_by("error", F.struct("started_at", "run_id", "key")).alias("last_error"), F.max("started_at").alias("last_at"))
    return newest.orderBy(F.col("last_at").desc(), "model", "step").limit(most)


def token_cost(spans: DataFrame, prices: DataFrame) -> DataFrame:
    """Tokens of each model and their cost by price of a million; unpriced models have a null cost."""
    used = spans.where("tokens > 0").groupBy(F.coalesce("model", F.lit("(unknown)")).alias("model")).agg(F.sum("tokens").alias("tokens"))
    return used.join(prices, "model", "left").select("model", "tokens", F.round(F.col("tokens") * F.col("price") / 1e6, 6).alias("cost"))


def run_rollup(spans: DataFrame) -> DataFrame:
    """Tokens, spans and distinct models of each run."""
    return spans.groupBy("run_id").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("spans"), F.array_join(F.sort_array(F.collect_set("model")), ",").alias("models"))


def escape_like(words: str) -> str:
    return "".join("\\" + c if c in "\\%_" else c for c in words)


def log_search(logs: DataFrame, levels: list[str], words: str) -> DataFrame:
    """Logs of the levels whose message or details hold the words, case aside; % and _ stand for themselves."""
    pattern = f"%{escape_like(words)}%"
    return logs.where(F.col("level").isin(levels) & (F.col("message").ilike(pattern) | F.col("meta").ilike(pattern)))


def tail_page(logs: DataFrame, before: int, size: int) -> DataFrame:
    """The page of logs just before an id, and whether there are older ones: one row more is read than shown."""
    size = min(max(size, 1), 1000)
    page = logs.where(F.col("id") < before).orderBy(F.col("id").desc()).limit(size + 1)
    older = page.agg((F.count("*") > size).alias("has_older"))
    return page.orderBy(F.col("id").desc()).limit(size).crossJoin(F.broadcast(older))  # one row


def level_counts(logs: DataFrame, levels: list[str]) -> DataFrame:
    every = logs.sparkSession.createDataFrame([(x,) for x in levels], "level string")
    return every.join(logs.groupBy("level").count(), "level", "left").select("level", F.coalesce("count", F.lit(0)).alias("n"))


def outcomes(runs: DataFrame, *by: str) -> DataFrame:
    """Of runs (status, duration_ms, ttft_ms, tokens): answered, refused and failed ones (cancelled ones failed), median and 95th percentile of the duration, median time to
    the first token of those that had one, and tokens; null measures are left out, no tokens are 0."""
    is_ = lambda *states: F.count(F.when(F.col("status").isin(*states), 1))
    found = runs.groupBy(*by).agg(
        F.count("*").alias("runs"), is_("ok").alias("answered"), is_("refused").alias("refused"), is_("error", "cancelled").alias("failed"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"),
    )
    took, first = F.col("duration_ms"), F.col("ttft_ms")
    return with_percentiles(found, runs, list(by), {"median_ms": (took, 0.5), "p95_ms": (took, 0.95), "ttft_ms": (first, 0.5)})


def outcome_buckets(runs: DataFrame, start: str, seconds: int, n: int) -> DataFrame:
    """outcomes() of buckets 0 to n - 1 of fixed width from start; empty ones have zero counts and null measures."""
    number = F.floor((F.unix_micros(F.col("started_at").cast("timestamp")) - F.unix_micros(F.lit(start).cast("timestamp"))) / F.lit(seconds * 1_000_000)).cast("long")
    found = outcomes(runs.withColumn("bucket", number).where((F.col("bucket") >= 0) & (F.col("bucket") < n)), "bucket")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    counts, measures = ["runs", "answered", "refused", "failed", "tokens"], ["median_ms", "p95_ms", "ttft_ms"]
    return runs.sparkSession.range(n).withColumnRenamed("id", "bucket").join(found, "bucket", "left").select("bucket", *map(zero, counts), *measures)


def endings(runs: DataFrame) -> DataFrame:
    """How runs (mode, termination) went: `by` mode, of all, and `by` termination, of the agentic ones only, which alone have any; name ('none' for null) and n."""
    of = lambda df, by: grouped(df.select(F.col(by).alias("name")), "name").select(F.lit(by).alias("by"), "name", "n")
    return of(runs, "mode").unionAll(of(runs.where("mode = 'agentic'"), "termination"))


def cost_summary(spans: DataFrame, prices: DataFrame) -> DataFrame:
    """A row a model and one for all (model null), most tokens first: tokens, of those priced and unpriced ones, and usd, null where nothing has a price."""
    used = token_cost(spans, prices).join(prices, "model", "left")
    priced = F.col("price").isNotNull()
    sums = [F.sum("tokens").alias("tokens"), F.coalesce(F.sum(F.when(priced, F.col("tokens"))), F.lit(0)).alias("priced"), F.coalesce(F.sum(F.when(~priced, F.col("tokens"))), F.lit(0)).alias("unpriced"), F.round(F.sum(F.col("tokens") * F.col("price") / 1e6), 6).alias("usd")]
    every = used.groupBy("model").agg(*sums).unionByName(used.agg(*sums).where("tokens is not null").withColumn("model", F.lit(None).cast("string")))
    order = F.struct(F.col("model").isNull().alias("all"), (-F.col("tokens")).alias("most"), "model")
    return every.orderBy(order)


def tail_after(logs: DataFrame, after: int, n: int) -> DataFrame:
    """The next n rows after an id, oldest first."""
    return logs.where(F.col("id") > after).orderBy("id").limit(n)


def tail_newest(logs: DataFrame, n: int) -> DataFrame:
    """The newest n rows, newest first."""
    return logs.orderBy(F.col("id").desc()).limit(n)
