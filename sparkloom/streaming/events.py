"""Structured Streaming over event files: tumbling buckets, a fixed-window rate limiter, and an idempotent log sink.

Each query works in micro-batches of `files` files and keeps its offsets and state in the shared folder. A batch is written under
its own number, so a batch that runs again after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.shared import shared_dir


def event_stream(spark: SparkSession, path: str, files: int = 16) -> DataFrame:
    """The Parquet files of path as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files).parquet(f"{path}*")


def caught_up(stream: DataFrame, mode: str, what: str) -> tuple[str, list[int]]:
    """Runs the stream over all that there is; the folder of its batches and their numbers."""
    spark = stream.sparkSession
    path, batches = shared_dir(spark, what), []

    def sink(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch={number}")
        batches.append(number)

    stream.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{path}-state").trigger(availableNow=True).start().awaitTermination()
    return path, sorted(set(batches))


def appended(stream: DataFrame, what: str) -> DataFrame:
    """All rows that the stream's batches gave; an empty stream gives none."""
    path, batches = caught_up(stream, "append", what)
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(*(f"{path}/batch={n}" for n in batches)) if batches else spark.createDataFrame([], stream.schema)


def latest(stream: DataFrame, what: str) -> DataFrame:
    """The last complete result of a stream of aggregates."""
    path, batches = caught_up(stream, "complete", what)
    spark = stream.sparkSession
    return spark.read.schema(stream.schema).parquet(f"{path}/batch={batches[-1]}") if batches else spark.createDataFrame([], stream.schema)


def buckets(events: DataFrame, seconds: int, offset: int, kind: str) -> DataFrame:
    """bucket_start, kind, n of tumbling buckets that begin `offset` seconds after the epoch; state is a row per bucket and kind."""
    window = F.window("ts", f"{seconds} seconds", startTime=f"{offset} seconds")
    return events.groupBy(window.alias("w"), F.col(kind).alias("kind")).agg(F.count("*").alias("n")).select(F.col("w.start").alias("bucket_start"), "kind", "n")


def log_rows(events: DataFrame, category: Column) -> DataFrame:
    """Every event as a log row with its category, late ones and those without id too; the sink writes a batch under its number, so that none is there twice."""
    return events.select(F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("time"), category.alias("category"))


def tail_after(events: DataFrame, after: int) -> DataFrame:
    """The events after an id, as they arrive; ones without an id are never after it."""
    return events.where(F.col("event_id") > after)


def rate_limit(hits: DataFrame, seconds: int, most: int) -> DataFrame:
    """hits (key, ts, id) with allowed: at most `most` in a window that begins with a key's first hit and lasts so many seconds.

    State is a key's window and count. Within a micro-batch hits are taken by time, then id; hits of later batches are taken to be later,
    and one that isn't counts in the open window. Hits without key share one key; hits without time are left out.
    """
    rows = hits.where("ts is not null").select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "id")
    key_type = dict(rows.dtypes)["key"]

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        begin, n = state.get if state.exists else (None, 0)
        found = pd.concat(list(parts)).sort_values(["t", "id"])
        allowed = []
        for t in found["t"].tolist():
            if begin is None or t - begin >= seconds * 1_000_000:
                begin, n = t, 0
            n += 1
            allowed.append(n <= most)
        state.update((begin, n))
        yield pd.DataFrame({"key": found["key"], "id": found["id"], "allowed": allowed})

    return rows.groupBy("key").applyInPandasWithState(step, f"key {key_type}, id long, allowed boolean", "begin long, n int", "append", GroupStateTimeout.NoTimeout)
