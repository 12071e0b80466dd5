"""Search of documentation entries by substrings, titles named in questions, labels of dates, timings of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Points for a term in the heading, in the page title, at the heading's start, and for occurrences in the text at most.
IN_HEADING, IN_TITLE, AT_START, MOST_IN_TEXT = 10, 6, 2, 5


def search_terms(query: str) -> list[str]:
    return list(dict.fromkeys(query.lower().split()))


def search_entries(entries: DataFrame, query: str, limit: int = 8, per_page: int = 3) -> DataFrame:
    """page, id, score, place of the best entries (page, id, heading, title, text) that hold every term; a page gives per_page at most.

    Ties go to the smaller id. Null columns hold no term; a query without terms finds nothing.
    """
    terms = search_terms(query)
    if not terms:
        return entries.limit(0).select("page", "id", F.lit(0).alias("score"), F.lit(0).alias("place"))
    heading, title, text = (F.lower(F.coalesce(F.col(c), F.lit(""))) for c in ("heading", "title", "text"))
    total, every = F.lit(0), F.lit(True)
    for term in map(F.lit, terms):
        times = F.least(F.lit(MOST_IN_TEXT), ((F.length(text) - F.length(F.replace(text, term))) / F.length(term)).cast("int"))
        points = F.when(F.contains(heading, term), IN_HEADING).otherwise(0) + F.when(F.contains(title, term), IN_TITLE).otherwise(0) + times
        total, every = total + points + F.when(F.startswith(heading, term), AT_START).otherwise(0), every & (points > 0)
    found = entries.where(every).select("page", "id", total.alias("score"))
    best = Window.partitionBy("page").orderBy(F.col("score").desc(), "id")
    found = found.withColumn("r", F.row_number().over(best)).where(F.col("r") <= per_page)
    top = found.orderBy(F.col("score").desc(), "id").limit(limit)  # a report of `limit` rows
    return top.select("page", "id", "score", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("score").desc(), "id")).alias("place"))


def recent_group(updated: Column, today: Column) -> Column:
    """The label of a date in a list of recents; later dates than today count as today."""
    age = F.date_diff(today, F.to_date(updated))
    return F.when(age <= 0, "Today").when(age == 1, "Yesterday").when(age <= 7, "Previous 7 days").when(age.isNotNull(), "Older")


def recents(conversations: DataFrame, today: Column, most: int = 50) -> DataFrame:
    """The newest conversations (owner_id, conv_id, updated) of each owner under their labels: label_place (labels from the newest), place in it, conv_id."""
    newest = Window.partitionBy("owner_id").orderBy(F.col("updated").desc(), "conv_id")
    rows = conversations.withColumn("_r", F.row_number().over(newest)).where(F.col("_r") <= most).withColumn("label", recent_group(F.col("updated"), today))
    labels = F.array(*map(F.lit, ("Today", "Yesterday", "Previous 7 days", "Older")))
    place = F.row_number().over(Window.partitionBy("owner_id", "label").orderBy("_r"))
    return rows.select("owner_id", F.array_position(labels, F.col("label")).cast("int").alias("label_place"), "label", place.alias("place"), "conv_id")


def timings(messages: DataFrame) -> DataFrame:
    """messages (started, first_token, finished in ms, tokens) with ttft_ms, total_ms, tokens_per_second (one decimal; null without tokens,
    a first token or any time between)."""
    ttft = F.when(F.col("first_token").isNotNull(), F.greatest(F.lit(0), F.col("first_token") - F.col("started")))
    span = F.greatest(F.lit(0), F.col("finished") - F.col("first_token"))
    speed = F.when((F.col("tokens") > 0) & F.col("first_token").isNotNull() & (span > 0), F.round(F.col("tokens") / (span / F.lit(1000.0)), 1))
    return messages.select("*", ttft.alias("ttft_ms"), F.greatest(F.lit(0), F.col("finished") - F.col("started")).alias("total_ms"), speed.alias("tokens_per_second"))


def derive_title(message: Column, most: int = 60) -> Column:
    """The first `most` characters of a message, cut at a space if one stands in the second half; null where there is no text."""
    flat = F.trim(F.regexp_replace(message, r"\s+", " "))
    clip = F.substring(flat, 1, most)
    space = F.length(clip) - F.length(F.substring_index(clip, " ", -1)) - 1
    base = F.when(space > most / 2, F.substring(clip, F.lit(1), space)).otherwise(clip)
    return F.when(flat == "", None).when(F.length(flat) <= most, flat).otherwise(F.concat(F.rtrim(base), F.lit("…")))


def file_name(name: Column) -> Column:
    """A name without path separators and control characters: its last 200 characters."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(name, r"[/\\]", "_"), r"[\x00-\x1F\x7F]", ""))
    return F.when(clean == "", "file").otherwise(F.right(clean, F.lit(200)))


def bucket_key(owner: Column, random: Column, name: Column) -> Column:
    """Where an upload is stored: under its owner, told apart by a random part (a UUID)."""
    return F.concat(owner.cast("string"), F.lit("/"), random, F.lit("-"), file_name(name))
