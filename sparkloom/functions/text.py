"""Text functions as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the token estimate: letters of a word token, characters of a symbol token, cost of a spaced digit, framing.
WORD_CHARS, SYMBOL_CHARS, SPACED_DIGIT, FRAMING = 6.6, 2.5, 0.5, 2

#: Words that carry no meaning in a lexical query.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "have", "in", "is", "it", "its", "of", "on", "or", "that", "the", "this", "to", "was", "were", "will", "with"]


def estimate_tokens(text: Column) -> Column:
    """Estimated tokens: words and symbol runs by length, digits one by one, and a share for digits after white space."""
    runs = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    cost = lambda found, chars: F.aggregate(found, F.lit(0.0), lambda s, x: s + F.ceil(F.length(x) / F.lit(chars)))
    digits = F.size(runs("[0-9]"))
    spaced = F.size(runs(r"\s[0-9]"))
    total = F.lit(FRAMING) + cost(runs("[A-Za-z]+"), WORD_CHARS) + cost(runs(r"[^\sA-Za-z0-9]+"), SYMBOL_CHARS) + digits + spaced * F.lit(SPACED_DIGIT)
    return F.when(text.isNull() | (text == ""), F.lit(0)).otherwise(F.ceil(total)).cast("long")


def detect_heading(text: Column) -> Column:
    """The first line with text, if it is short, ends without punctuation and is all capitals or title case; else null."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = F.try_element_at(lines, F.lit(1))
    letters = F.regexp_replace(first, "[^A-Za-z]", "")
    words = F.split(first, r"\s+")
    capital = F.size(F.filter(words, lambda w: w.rlike("^[A-Z]")))
    title = (F.size(words) <= 12) & (capital >= F.ceil(F.size(words) / F.lit(2.0)))
    fine = (F.length(first) <= 90) & ~first.rlike("[.!?;:]$") & (F.length(letters) >= 3) & ((letters == F.upper(letters)) | title)
    return F.when(fine, first)


def normalise(text: Column) -> Column:
    """Lower-case ASCII words with single spaces between them."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(text), r"[_\-.]+", " "), r"[^a-z0-9\s]", " "), r"\s+", " "))


def terms(text: Column) -> Column:
    """Lower-case alphanumeric words without stop words."""
    return F.array_except(F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != ""), F.array(*map(F.lit, STOP_WORDS)))


def all_terms(text: Column) -> Column:
    """As terms(), with repeats."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: (w != "") & ~w.isin(STOP_WORDS))


def cited_indices(text: Column) -> Column:
    """The distinct numbers n of citations [n], in order of appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[([0-9]{1,9})\]"), F.lit(1)), lambda x: x.cast("int")))


#: Fixed value: how secrets look.
SECRETS = r"\b(nvapi-[A-Za-z0-9_-]{8,}|sk-[A-Za-z0-9_-]{8,}|sk_[A-Za-z0-9_-]{8,}|Bearer\s+[A-Za-z0-9._-]{8,})"


def redact(text: Column) -> Column:
    """Values that look like API keys or bearer tokens become [redacted]; long texts are cut."""
    clean = F.regexp_replace(text, SECRETS, "[redacted]")
    over = F.length(clean) - 4000
    return F.when(over > 0, F.concat(F.substring(clean, 1, 4000), F.lit("… ("), over.cast("string"), F.lit(" more characters)"))).otherwise(clean)


#: The category of a log message by the first pattern that it matches.
CATEGORY_PATTERNS = [
    ("^ai-settings:", "settings"),
    (r"^agentic|planner|^agent\b", "agent"),
    ("^inference request|^upstream error|drafting", "inference"),
    ("rerank|retriev|search|citation", "retrieval"),
    ("ingest|crack|pars(e|er)|figure|page|document|extract|embed|chunk", "ingestion"),
    ("login|session|registration|register|password|sign(ed)? ?(in|out)|verification|invite|profile photo|oauth|rate limit|admin action", "auth"),
]


def categorise(message: Column, own: Column, kind: Column) -> Column:
    """Own category if it is a known one, else by message, else by kind of request, else system."""
    names = ["agent", "retrieval", "inference", "ingestion", "auth", "settings", "system"]
    out = F.when(own.isin(names), own)
    for pattern, name in CATEGORY_PATTERNS:
        out = out.when(message.rlike(f"(?i){pattern}"), F.lit(name))
    return out.when(kind == "ingest", "ingestion").when(kind == "chat", "retrieval").otherwise("system")


def embedding_text(title: Column, heading: Column, caption: Column, content: Column) -> Column:
    """What is embedded for a chunk: title, heading and caption before the content."""
    return F.concat(F.concat_ws(" — ", F.regexp_replace(title, "[-_]+", " "), heading, caption), F.lit("\n"), content)


def html_title(html: Column) -> Column:
    """Text of the first title element, white space collapsed; null if there is none."""
    raw = F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)
    clean = F.trim(F.regexp_replace(raw, r"\s+", " "))
    return F.when(clean != "", clean)
