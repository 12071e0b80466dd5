"""A documentation index over Markdown files: headings with anchors, pieces to search, titles, summaries, links and where they go.

files: slug, text. A file becomes rows of lines first; all that follows is over those rows. What is inside a fenced block is no prose.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.shared import dealt

#: Files whose lines one task holds.
FILES = 20_000
_FENCE = r"^\s*(```+|~~~+)"
_HEADING = r"^(#{1,6})\s+(.+?)\s*#*\s*$"
#: Labels that open a page's lead, a line that leads back, marks of notes.
LEAD = r"^\*\*(?:What this covers|You'll learn):\*\*\s*"
BACK = r"^\[← Back to "
NOTE = r"\[!(?:NOTE|TIP|IMPORTANT|WARNING|CAUTION)\]"
_LINK = r'!?\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)'
#: Characters that mean something in Markdown, and stand-ins for them inside code spans.
_MARKS = "*_[]()<>\\!#"
_STANDINS = "".join(chr(0xE000 + i) for i in range(len(_MARKS)))


def files(spark: SparkSession, glob: str) -> DataFrame:
    """slug (the name without .md) and text of the files that a glob finds."""
    found = spark.read.text(glob, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return found.select(F.regexp_extract("path", r"([^/]+)\.md$", 1).alias("slug"), F.col("value").alias("text"))


def prose(files: DataFrame) -> DataFrame:
    """slug, number (from 1), line: the lines outside fenced blocks. A fence is closed by one of its own kind only, or by the end."""
    lines = dealt(files.select("slug", "text"), FILES, "slug").select("slug", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("i", "line")).select("slug", (F.col("i") + 1).alias("number"), "line", F.substring(F.ltrim(F.regexp_extract("line", _FENCE, 0)), 1, 1).alias("mark"))
    # only the fences of a file are folded, into the stretches that they enclose
    marks = lines.where(F.col("line").rlike(_FENCE)).groupBy("slug").agg(F.array_sort(F.collect_list(F.struct("number", "mark"))).alias("marks"))
    nothing = F.struct(F.lit("").alias("open"), F.lit(0).alias("at"), F.slice(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))), 1, 0).alias("spans"))

    def step(s: Column, m: Column) -> Column:
        closes, opens = s["open"] == m["mark"], s["open"] == ""
        return F.struct(
            F.when(closes, "").when(opens, m["mark"]).otherwise(s["open"]).alias("open"), F.when(opens, m["number"]).otherwise(s["at"]).alias("at"),
            F.when(closes, F.concat(s["spans"], F.array(F.struct(s["at"].alias("a"), m["number"].alias("b"))))).otherwise(s["spans"]).alias("spans"),
        )

    fenced = marks.select("slug", F.aggregate("marks", nothing, step, lambda s: F.when(s["open"] == "", s["spans"]).otherwise(F.concat(s["spans"], F.array(F.struct(s["at"].alias("a"), F.lit(2**31 - 1).alias("b")))))).alias("spans"))
    inside = F.exists("spans", lambda x: F.col("number").between(x["a"], x["b"]))
    return lines.join(fenced, "slug", "left").where((F.col("mark") == "") & ~F.coalesce(inside, F.lit(False))).select("slug", "number", "line")


def chain(text: Column, *rules: tuple[str, str]) -> Column:
    for pattern, to in rules:
        text = F.regexp_replace(text, pattern, to)
    return text


def heading_text(raw: Column) -> Column:
    """The words of a heading as a page shows them. Code spans are taken literally: what means something in Markdown is replaced in them until the rest is done."""
    parts = F.regexp_extract_all(raw, F.lit("`[^`]*`|[^`]+|`"), F.lit(0))
    safe = F.array_join(F.transform(parts, lambda p: F.when(p.rlike("^`.*`$"), F.translate(F.regexp_replace(p, "`", ""), _MARKS, _STANDINS)).otherwise(p)), "")
    shown = chain(safe, (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"\*\*(.+?)\*\*", "$1"), (r"\*(.+?)\*", "$1"), (r"(?<!\w)__(.+?)__(?!\w)", "$1"), (r"(?<!\w)_(.+?)_(?!\w)", "$1"), ("<[^>]+>", ""), (r"\\([\\`*_{}\[\]()#+\-.!])", "$1"))
    return F.trim(F.translate(shown, _STANDINS, _MARKS))


def anchor(text: Column) -> Column:
    """The id of a heading before numbers tell equal ones apart."""
    return F.replace(F.regexp_replace(F.lower(text), r"[^\p{L}\p{M}\p{N}\p{Pc}\- ]", ""), F.lit(" "), F.lit("-"))


def headings(lines: DataFrame) -> DataFrame:
    """slug, number, depth, text, id of prose()'s headings. Of equal ids in a file the second is id-1, the third id-2 (also where a heading is called that itself)."""
    found = lines.where(F.col("line").rlike(_HEADING)).select("slug", "number", F.length(F.regexp_extract("line", _HEADING, 1)).alias("depth"), heading_text(F.regexp_extract("line", _HEADING, 2)).alias("text"))
    again = F.row_number().over(Window.partitionBy("slug", "_id").orderBy("number")) - 1
    return found.withColumn("_id", anchor(F.col("text"))).withColumn("id", F.when(again == 0, F.col("_id")).otherwise(F.concat_ws("-", "_id", again.cast("string")))).drop("_id")


def plain_line(line: Column) -> Column:
    """A line's words without Markdown."""
    return chain(
        line, (r"!?\[([^\]]*)\]\([^)]*\)", "$1"), (r"(?i)</?[a-z][^>]*>", " "), (r"^\s*(?:>\s*)+", ""), (r"^\s*(?:[-*+]|\d+\.)\s+", ""), (NOTE, ""), (r"[*`]|(?<=^|\s)_+|_+(?=\s|$)", ""), (r"\|", " "), (r"^\s*:?-{3,}:?(\s+:?-{3,}:?)*\s*$", ""),
    )


def search_entries(files: DataFrame) -> DataFrame:
    """slug, place, id, heading, depth, text: a piece for each heading but titles, and what comes before the first of them (depth 1), if it says anything."""
    lines = prose(files)
    parts = lines.join(headings(lines), ["slug", "number"], "left")
    order = Window.partitionBy("slug").orderBy("number").rowsBetween(Window.unboundedPreceding, 0)
    parts = parts.withColumn("place", F.sum(F.when(F.col("depth") > 1, 1).otherwise(0)).over(order))
    words = F.when(F.col("depth").isNull() & ~F.col("line").rlike(BACK), plain_line(F.col("line")))
    of = parts.groupBy("slug", "place").agg(
        F.max(F.when(F.col("depth") > 1, F.struct("id", F.col("text").alias("heading"), "depth"))).alias("h"), F.array_sort(F.collect_list(F.when(words.isNotNull(), F.struct("number", words.alias("w"))))).alias("ws")
    )
    text = F.trim(F.regexp_replace(F.array_join(F.col("ws.w"), " "), r"\s+", " "))
    out = of.select("slug", F.col("place").cast("int").alias("place"), F.coalesce("h.id", F.lit("")).alias("id"), F.coalesce("h.heading", F.lit("")).alias("heading"), F.coalesce("h.depth", F.lit(1)).alias("depth"), text.alias("text"))
    return out.where((F.col("id") != "") | (F.col("text") != ""))


def cards(files: DataFrame) -> DataFrame:
    """slug, title (the first heading of depth 1, else the slug) and summary: the paragraph that a lead label opens, else the first that is ordinary prose."""
    lines = prose(files)
    titles = headings(lines).where("depth = 1").groupBy("slug").agg(F.min_by("text", "number").alias("title"))
    line, trimmed = F.col("line"), F.trim("line")
    ordinary = (trimmed != "") & ~line.rlike(r"^(#|\[←|>|\||<)") & ~trimmed.rlike(r"^[-*]\s") & ~trimmed.rlike("^---+$")
    starts = lines.groupBy("slug").agg(F.coalesce(F.min(F.when(line.rlike(LEAD), F.col("number"))), F.min(F.when(ordinary, F.col("number")))).alias("begin"))
    rows = lines.join(starts, "slug").where("number >= begin")
    ends = rows.where(trimmed == "").groupBy("slug").agg(F.min("number").alias("end"))
    rows = rows.join(ends, "slug", "left").where(F.col("end").isNull() | (F.col("number") < F.col("end")))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", trimmed.alias("t")))), lambda x: x["t"]), " ")
    plain = rows.groupBy("slug").agg(F.trim(chain(said, (LEAD, ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), ("[*_`]", ""))).alias("s"))
    summary = F.concat(F.upper(F.substring("s", 1, 1)), F.expr("substring(s, 2)"))
    return files.select("slug").join(titles, "slug", "left").join(plain, "slug", "left").select("slug", F.coalesce("title", "slug").alias("title"), F.coalesce(summary, F.lit("")).alias("summary"))


def links(files: DataFrame) -> DataFrame:
    """slug, line, href of every link and image outside code."""
    bare = F.regexp_replace("line", "`[^`]*`", "")
    return prose(files).select("slug", F.col("number").alias("line"), F.explode(F.regexp_extract_all(bare, F.lit(_LINK), F.lit(1))).alias("href"))


def normalised_path(path: Column) -> Column:
    """The path without empty and . parts, each .. taking the part before with it."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    step = lambda out, p: F.when(p == "..", F.slice(out, 1, F.greatest(F.lit(0), F.size(out) - 1))).otherwise(F.concat(out, F.array(p)))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def resolved(href: Column, folder: str = "docs") -> Column:
    """Where a link in a file of the folder goes: a struct of kind (external, anchor, doc, image, repo), target (a slug, a picture's name or a path) and fragment."""
    path, fragment = F.split_part(href, F.lit("#"), F.lit(1)), F.split_part(href, F.lit("#"), F.lit(2))
    to = normalised_path(F.concat(F.lit(f"{folder}/"), path))
    outside = href.rlike("(?i)^[a-z][a-z0-9+.-]*:") | href.startswith("//") | (href == "")
    doc, image = F.regexp_extract(to, rf"(?i)^{folder}/([a-z0-9-]+)\.md$", 1), F.regexp_extract(to, rf"^{folder}/images/([^/]+)$", 1)
    kind = F.when(outside, "external").when(href.startswith("#"), "anchor").when(doc != "", "doc").when(image != "", "image").otherwise("repo")
    target = F.when(kind == "external", href).when(kind == "doc", doc).when(kind == "image", image).when(kind == "repo", to).otherwise("")
    return F.struct(kind.alias("kind"), target.alias("target"), F.when(kind == "external", "").otherwise(fragment).alias("fragment"))


def dangling(files: DataFrame) -> DataFrame:
    """slug, line, href of the links to a file that isn't there, or to an anchor that its file doesn't have."""
    rows = links(files).withColumn("to", resolved(F.col("href"))).where(F.col("to.kind").isin("doc", "anchor"))
    rows = rows.select("slug", "line", "href", F.when(F.col("to.kind") == "doc", F.col("to.target")).otherwise(F.col("slug")).alias("page"), F.col("to.fragment").alias("id"))
    there = files.select(F.col("slug").alias("page"), F.lit("").alias("id")).unionByName(headings(prose(files)).select(F.col("slug").alias("page"), "id")).distinct()
    return rows.join(there, ["page", "id"], "left_anti").select("slug", "line", "href")
