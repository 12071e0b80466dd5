"""Scores of answers and evaluation runs. Rates are null over nothing; three decimals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def share(hit: Column, of: Column | None = None) -> Column:
    """Share of rows (of those where `of` holds) with hit; a null hit counts as none."""
    value = F.when(hit, 1.0).otherwise(0.0)
    return F.round(F.avg(value if of is None else F.when(of, value)), 3)


def section_pass(results: DataFrame, members: DataFrame, phrases: DataFrame) -> DataFrame:
    """Section questions: whether some result is a parent of two members or more that holds every phrase, with no member listed alone as well.

    results (q_id, chunk_id, members, content), members (q_id, parent_id, chunk_id), phrases (q_id, phrase).
    """
    parents = results.where("members >= 2").select("q_id", F.col("chunk_id").alias("parent_id"), F.lower("content").alias("content"))
    holds = parents.join(phrases, "q_id").groupBy("q_id", "parent_id").agg(F.min(F.contains("content", F.lower("phrase")).cast("int")).alias("all"))
    alone = members.join(results.where("members < 2").select("q_id", "chunk_id"), ["q_id", "chunk_id"], "left_semi").select("q_id", "parent_id").distinct()
    good = holds.where("all = 1").join(alone, ["q_id", "parent_id"], "left_anti").select("q_id").distinct().withColumn("passed", F.lit(True))
    return phrases.select("q_id").distinct().join(good, "q_id", "left").select("q_id", F.coalesce("passed", F.lit(False)).alias("passed"))


def multi_hop(facts: DataFrame) -> DataFrame:
    """facts (q_id, found): questions, the share with every fact, and the mean share of facts found."""
    of = facts.groupBy("q_id").agg(F.avg(F.col("found").cast("double")).alias("recall"))
    return of.agg(F.count("*").alias("questions"), share(F.col("recall") == 1).alias("full_match"), F.round(F.avg("recall"), 3).alias("fact_recall"))


def summaries(pages: DataFrame) -> DataFrame:
    """pages (q_id, wanted page, reached): the share of questions with all pages reached."""
    return pages.groupBy("q_id").agg(F.min(F.col("reached").cast("int")).alias("all")).agg(F.count("*").alias("questions"), share(F.col("all") == 1).alias("complete"))


def latencies(runs: DataFrame, by: str) -> DataFrame:
    """Mean, median and largest duration, mean searches and tokens."""
    return runs.groupBy(by).agg(F.round(F.avg("ms"), 3).alias("mean_ms"), F.round(F.percentile("ms", 0.5), 3).alias("median_ms"), F.max("ms").alias("max_ms"), F.round(F.avg("searches"), 3).alias("searches"), F.round(F.avg("tokens"), 3).alias("tokens"))


def judge_rows(samples: DataFrame) -> DataFrame:
    """samples (q_id, score): of each question the median, and whether the samples are a point apart or more; then means and the unsure."""
    of = samples.where("score is not null").groupBy("q_id").agg(F.percentile("score", 0.5).alias("median"), (F.max("score") - F.min("score")).alias("spread"))
    return of.agg(F.round(F.avg("median"), 3).alias("mean"), F.count("*").alias("judged"), F.count(F.when(F.col("spread") >= 1, 1)).alias("unsure"))


def expectations(answers: DataFrame) -> DataFrame:
    """answers (q_id, text, must_contain, must_not_match): every phrase is in the text, without regard to case, and the pattern isn't; null lists and patterns ask for nothing."""
    all_there = F.forall(F.coalesce("must_contain", F.array().cast("array<string>")), lambda x: F.contains(F.lower("text"), F.lower(x)))
    none = F.coalesce(~F.regexp_like("text", F.col("must_not_match")), F.lit(True))
    return answers.select("q_id", all_there.alias("contains"), none.alias("clean"), (all_there & none).alias("passed"))


def outcomes_differ(a: DataFrame, b: DataFrame) -> DataFrame:
    """Questions whose refusals two runs (q_id, refused) don't share, also those that only one run has."""
    both = a.select("q_id", F.col("refused").alias("before")).join(b.select("q_id", F.col("refused").alias("after")), "q_id", "full_outer")
    return both.where(~F.col("before").eqNullSafe(F.col("after")))


def precision(sentences: DataFrame) -> DataFrame:
    """sentences (q_id, cited, supported, right): pooled over all answers the share of supported sentences, and of citations that are right; null over nothing."""
    ratio = lambda a, b: F.round(F.when(b > 0, a / b), 3)
    return sentences.agg(ratio(F.sum(F.col("supported").cast("int")), F.count("supported")).alias("support_rate"), ratio(F.sum("right"), F.sum("cited")).alias("citation_precision"))


def faithfulness(claims: DataFrame) -> DataFrame:
    """Mean claim score of each answer; null if no claim has one."""
    return claims.groupBy("q_id").agg(F.round(F.avg("score"), 3).alias("faithfulness"))


def gate(now: DataFrame, before: DataFrame, slack: float = 0.05) -> DataFrame:
    """metric, value and baseline of two runs with pass: refusals may not drop, leakage must be 0, others may lose the slack at most. A metric without a baseline passes."""
    rows = now.join(before.withColumnRenamed("value", "baseline"), "metric", "left")
    fine = F.when(F.col("metric") == "leakage", F.col("value") == 0).when(F.col("metric") == "refusal_accuracy", F.col("value") >= F.col("baseline")).otherwise(F.round(F.col("value"), 6) >= F.round(F.col("baseline") - slack, 6))
    return rows.select("metric", "value", "baseline", F.coalesce(fine, F.lit(True)).alias("passed"))


def leaks(results: DataFrame, scopes: DataFrame, chunks: DataFrame) -> DataFrame:
    """Results (q_id, chunk_id) whose chunk lies in a base that the question's scope (q_id, base_id) doesn't hold, counted by question; 0 for a question without."""
    outside = results.join(chunks.select("chunk_id", "base_id"), "chunk_id").join(scopes, ["q_id", "base_id"], "left_anti").groupBy("q_id").agg(F.count("*").alias("n"))
    return results.select("q_id").distinct().join(outside, "q_id", "left").select("q_id", F.coalesce("n", F.lit(0)).alias("leaked"))
