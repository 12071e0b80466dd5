"""Evaluation of retrieval and answers: ranks, slices, gates, judges, leakage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_correct(results: DataFrame, truth: DataFrame) -> DataFrame:
    """questions of truth (q_id, type, target) with the rank of the first result (q_id, rank, target) that is right, or null."""
    right = truth.join(results.withColumnRenamed("target", "found"), "q_id", "left")
    return right.groupBy("q_id", "type").agg(F.min(F.when(F.col("found") == F.col("target"), F.col("rank"))).alias("rank"), F.count("found").alias("returned"))


def metrics(scored: DataFrame, *by: str) -> DataFrame:
    """hit@1, hit@3, reciprocal rank and refusals of questions (rank, type, returned); refusals pass when nothing comes back, and without
    any the accuracy is 1."""
    asked, refusal = F.col("type") != "refusal", F.col("type") == "refusal"
    share = lambda hit: F.round(F.avg(F.when(asked, F.when(hit, 1.0).otherwise(0.0))), 3)
    return scored.groupBy(*by).agg(
        F.count("*").alias("questions"),
        share(F.coalesce(F.col("rank") <= 1, F.lit(False))).alias("hit1"),
        share(F.coalesce(F.col("rank") <= 3, F.lit(False))).alias("hit3"),
        F.round(F.avg(F.when(asked, F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0)))), 3).alias("mrr"),
        F.round(F.coalesce(F.avg(F.when(refusal, F.when(F.col("returned") == 0, 1.0).otherwise(0.0))), F.lit(1.0)), 3).alias("refusal"),
    )


def by_slice(scored: DataFrame) -> DataFrame:
    """metrics of each type and of all, in one rollup."""
    out = scored.rollup("type").agg(F.count("*").alias("questions"), F.round(F.avg(F.coalesce(F.lit(1.0) / F.col("rank"), F.lit(0.0))), 3).alias("mrr"), F.grouping("type").alias("g"))
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("type")).alias("type"), "questions", "mrr")


def gate_separation(scored: DataFrame) -> DataFrame:
    """The largest similarity of a refusal, and how many answerable questions lie above it."""
    top = scored.agg(F.max(F.when(F.col("type") == "refusal", F.col("similarity"))).alias("threshold"))
    rest = scored.where("type <> 'refusal'").crossJoin(F.broadcast(top))  # one row
    return rest.agg(F.first("threshold").alias("threshold"), F.count("*").alias("answerable"), F.count(F.when(F.col("similarity") > F.coalesce("threshold", F.lit(-1.0)), 1)).alias("above"))


def judge_samples(samples: DataFrame) -> DataFrame:
    """Median and spread of each claim's scores; nulls don't count."""
    return samples.groupBy("item").agg(F.percentile("score", F.lit(0.5)).alias("median"), (F.max("score") - F.min("score")).cast("double").alias("spread"), F.count("score").alias("n"))


def agreement(pairs: DataFrame) -> DataFrame:
    """Share of items on which two graders agree after rounding."""
    same = F.when(F.round("human") == F.round("judge"), 1.0).otherwise(0.0)
    return pairs.where("human is not null and judge is not null").agg(F.count("*").alias("n"), F.round(F.avg(same), 3).alias("agreement"))


def leakage(results: DataFrame, owners: DataFrame) -> DataFrame:
    """Results (q_id, scope, chunk_id) whose chunk (chunk_id, scope) belongs to another scope, counted by scope asked."""
    own = owners.select("chunk_id", F.col("scope").alias("owner"))
    return results.join(own, "chunk_id").groupBy("scope").agg(F.count("*").alias("results"), F.count(F.when(F.col("owner") != F.col("scope"), 1)).alias("leaked"))


def complement(found: DataFrame, right: DataFrame, owners: DataFrame) -> DataFrame:
    """Of searches outside the right scope (found: q_id, chunk_id, similarity): per question how many chunks were found, how many of them belong to the right scope all the
    same (right: q_id, right; owners: chunk_id, scope), and the best similarity. A leak is a fault of the scope filter."""
    rows = found.join(right, "q_id").join(owners, "chunk_id", "left")
    leaked = F.count(F.when(F.col("scope").eqNullSafe(F.col("right")), 1))
    return rows.groupBy("q_id").agg(F.count("*").alias("found"), leaked.alias("leaked"), F.max("similarity").alias("best"))
