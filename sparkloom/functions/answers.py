"""Text of answers and model replies: sentences, unsupported ones, unlabelled numbers, verdicts and scores in replies.

All are column expressions but rerank_scores, which looks for whole JSON objects inside a reply's prose and runs in Python over Arrow batches.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rules import bound
from .text import cited_indices

_CLOSERS = "\"')”’*`"
#: A sentence: up to its stops with the quotes that close it, if white space, a citation or the end follows, and the citations after them; or up to a
#: line's end; and the blank lines behind it. Repeats are possessive: they never need to give back, and long texts need no deep stack.
_SENTENCE = rf"(?:[^\n.!?]++|[.!?]+[{_CLOSERS}]*(?![.!?{_CLOSERS}\s\[]|\z))*+(?:[.!?]+[{_CLOSERS}]*(?:[ \t]*\[\d+\])*+|\n+|\z)(?:[ \t\r\f\x0B]*(?:\n+|\z))*+"
_NUMBER = r"\d+(?:[.,]\d+)?"
#: Hedges that go with a number, and words after which a number is a name.
_HEDGES = "about|approximately|around|roughly|nearly|some"
_NAMES = r"figure|fig\.|table|page|section|appendix|part"
_CLAIM = rf"\b(?:(?:{_HEDGES})\s+)?{_NUMBER}\b"
#: Parts of a reading: a number that is a name, a number that is claimed, a word with digits, any other character.
_PARTS = rf"(?is)(?:{_NAMES})\s*{_CLAIM}|{_CLAIM}|[a-z_]*\d\w*|."
SCORE_MOST = 10


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def blank(text: Column) -> Column:
    return stripped(text) == ""


def sentences(text: Column) -> Column:
    """The sentences of a text, which join to it again but for blank lines before the first. Null and blank texts have none."""
    return F.filter(found(F.coalesce(text, F.lit("")), _SENTENCE), lambda x: ~blank(x))


def numbered(text: Column) -> Column:
    """One numbered sentence a line, as a verifier reads an answer."""
    return F.array_join(F.transform(sentences(text), lambda x, i: F.concat(F.lit("S"), i + 1, F.lit(": "), stripped(x))), "\n")


def without_unsupported(text: Column, unsupported: Column) -> Column:
    """A struct: left, the text without the sentences of these numbers; gone, the citations of those; sentences, how many there were; empty, whether
    no answer is left: nothing, or only prose where there were citations. With no numbers (or null) the text stays as it is."""
    given = F.struct(F.coalesce(text, F.lit("")).alias("text"), F.coalesce(unsupported, F.array().cast("array<int>")).alias("bad"))

    def cut(s: Column) -> Column:
        split = lambda keep: F.array_join(F.filter(s["every"], lambda x, i: F.array_contains(s["bad"], i + 1) != F.lit(keep)), "")
        return F.struct(s["text"].alias("text"), split(True).alias("kept"), split(False).alias("dropped"), F.size(F.filter(s["every"], lambda x, i: F.array_contains(s["bad"], i + 1))).alias("n"))

    def left(s: Column) -> Column:
        nothing = blank(s["kept"]) | ((F.size(cited_indices(s["text"])) > 0) & (F.size(cited_indices(s["kept"])) == 0))
        return F.struct(stripped(s["kept"]).alias("left"), F.array_sort(cited_indices(s["dropped"])).alias("gone"), s["n"].alias("sentences"), nothing.alias("empty"))

    def result(s: Column) -> Column:
        whole = F.struct(s["text"].alias("left"), F.array().cast("array<int>").alias("gone"), F.lit(0).alias("sentences"), blank(s["text"]).alias("empty"))
        each = F.struct(s["text"].alias("text"), s["bad"].alias("bad"), sentences(s["text"]).alias("every"))
        # each step is worked out once; a text that stays isn't cut at all
        return F.when(F.size(s["bad"]) == 0, whole).otherwise(bound(bound(each, cut), left))

    return bound(given, result)


def without_unlabelled(reading: Column, printed: Column) -> Column:
    """A struct: reading, in which claimed numbers that aren't printed on the figure are a mark (names such as "page 7" stay), and redacted, how many are.
    Thousands may be written with a comma or without."""
    plain = lambda x: F.replace(x, F.lit(","), F.lit(""))
    known = F.transform(found(F.coalesce(printed, F.lit("")), _NUMBER), plain)
    marked = lambda x: x.rlike(rf"(?i)^(?:(?:{_HEDGES})\s+)?{_NUMBER}$") & ~F.array_contains(known, plain(F.regexp_extract(x, rf"{_NUMBER}$", 0)))
    parts = found(F.coalesce(reading, F.lit("")), _PARTS)
    return F.struct(F.array_join(F.transform(parts, lambda x: F.when(marked(x), "[unlabelled]").otherwise(x)), "").alias("reading"), F.size(F.filter(parts, marked)).alias("redacted"))


def objects(reply: str | None) -> Iterator[dict]:
    """The JSON objects that stand in a reply at the outermost level, the last one first."""
    found, at, decoder = [], 0, json.JSONDecoder()
    reply = reply or ""
    while (at := reply.find("{", at)) >= 0:
        try:
            value, end = decoder.raw_decode(reply, at)
        except ValueError:
            at += 1
            continue
        found.append(value)
        at = end
    return reversed(found)


def _number(x) -> float:
    try:
        return float("nan") if isinstance(x, (dict, list)) else float(x)
    except (TypeError, ValueError):
        return float("nan")


def rerank_scores(reply: str | None, n: int) -> list[float] | None:
    """Scores 0 to 1 of n passages from the last object of a reply that has one for each number from 1 to n; null if none has."""
    for value in objects(reply):
        rows = value.get("scores")
        if n > 0 and isinstance(rows, list) and len(rows) == n and all(isinstance(r, dict) for r in rows):
            ids, scores = [_number(r.get("id")) for r in rows], [_number(r.get("score")) for r in rows]
            if sorted(ids) == list(range(1, n + 1)) and all(abs(s) < float("inf") for s in scores):
                return [min(max(s, 0.0), SCORE_MOST) / SCORE_MOST for _, s in sorted(zip(ids, scores))]
    return None


def verdict(reply: Column) -> Column:
    """Numbers of unsupported sentences in a reply (positive whole ones, each once); null where there is no verdict, which isn't the same as none unsupported."""
    rows = F.from_json(F.regexp_extract(reply, r"(?s)\{.*\}", 0), "unsupported array<string>")["unsupported"]
    numbers = F.transform(rows, lambda x: x.try_cast("double"))
    return F.array_distinct(F.transform(F.filter(numbers, lambda x: (x > 0) & (x == F.floor(x))), lambda x: x.cast("int")))


def mapped(df: DataFrame, keys: str, columns: list[str], schema: str, function: Callable) -> DataFrame:
    """The key column, and for each row the rows (tuples of schema) that function(*columns) gives."""
    kind = dict(df.dtypes)[keys]

    def run(batches):
        for batch in batches:
            key, *rest = (c.to_pylist() for c in batch.columns)
            rows = [(k, *row) for k, *x in zip(key, *rest) for row in function(*x)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows], schema=out)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out = to_arrow_schema(StructType.fromDDL(f"{keys} {kind}, {schema}"))
    names = out.names
    return df.select(keys, *columns).mapInArrow(run, f"{keys} {kind}, {schema}")
