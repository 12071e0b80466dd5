"""Loaders: HTML and Markdown into sections of typed elements, and sections into chunks under a token budget.

Sections and packing depend on order, so they run in Python over Arrow batches, one row at a time; only the number of a document's chunks goes on from row to row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable
from html.parser import HTMLParser
from itertools import accumulate, groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import detect_heading

Section = list[tuple[str, str]]

#: Elements that hold no content, and elements that never have an end tag.
DROPPED = {"script", "style", "noscript", "template", "svg", "nav", "header", "footer", "aside", "form", "iframe"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Open elements without an end tag that a start tag ends.
ENDED_BY = {"p": {"p"}, "li": {"li"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"td", "th", "tr"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}}
BLOCKS = {"p": "Text", "blockquote": "Text", "dd": "Text", "dt": "Text", "li": "List-item"}
HEADING_TAGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
DEPTH = 3


class _Tree(HTMLParser):
    """A small tree: nodes are [tag, children], text is str."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root: list = ["", []]
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        while self.open[-1][0] in ENDED_BY.get(tag, ()):
            self.open.pop()
        node = [tag, []]
        self.open[-1][1].append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data):
        self.open[-1][1].append(data)


def _flat(text: str) -> str:
    return re.sub(r"\s+", " ", text).strip()


def walk(node, inside: Callable[[list], bool]):
    """Texts (str), and nodes as they begin, in document order; a node's children only if inside(node). No recursion: pages may nest deeply."""
    pending = [iter(node[1])]
    while pending:
        child = next(pending[-1], None)
        if child is None:
            pending.pop()
        else:
            yield child
            if not isinstance(child, str) and inside(child):
                pending.append(iter(child[1]))


def _text(node) -> str:
    return "".join(x for x in walk(node, lambda n: n[0] not in DROPPED) if isinstance(x, str))


def _find(node, tags: set[str]):
    return (x for x in walk(node, lambda n: n[0] not in DROPPED) if not isinstance(x, str) and x[0] in tags)


def _element(node) -> tuple[str, str] | None:
    """What a node is as a whole; None if its children are looked at one by one."""
    tag = node[0]
    if tag in HEADING_TAGS:
        return "Section-header", _flat(_text(node))
    if tag in BLOCKS:
        return BLOCKS[tag], _flat(_text(node))
    if tag == "pre":
        return "Table", _text(node).strip()
    if tag == "table":
        cells = ([_flat(_text(c)) for c in _find(row, {"td", "th"})] for row in _find(node, {"tr"}))
        return "Table", "\n".join(filter(None, map(" | ".join, cells)))
    return None


def sectioned(found: Iterable[tuple[str, str, int]]) -> list[Section]:
    """(type, text, heading level or 0) in order, as sections: one begins at each heading down to DEPTH. Empty texts are left out."""
    sections: list[Section] = [[]]
    for kind, text, level in found:
        if text:
            if 0 < level <= DEPTH and sections[-1]:
                sections.append([])
            sections[-1].append((kind, text))
    return sections


def html_sections(html: str) -> list[Section]:
    """Sections that begin at headings of level 1 to 3; tables and preformatted text stay whole. Null and empty pages have one empty section."""
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    body = next((x for tag in ("main", "article", "body") for x in _find(tree.root, {tag})), tree.root)
    parts = walk(body, lambda n: n[0] not in DROPPED and _element(n) is None)

    def content():
        for x in parts:
            if isinstance(x, str):
                yield "Text", _flat(x), 0
            elif x[0] not in DROPPED and (e := _element(x)):
                yield *e, int(x[0][1]) if x[0] in HEADING_TAGS else 0

    return sectioned(content())


#: What a line of Markdown is, by the first form that fits the whole line.
_LINE = re.compile(r"\s*(?P<fence>```|~~~).*|(?P<marks>#{1,6})\s+(?P<title>.*?)\s*#*|(?P<rule>\s*\|[\s:|-]+\|)|(?P<row>\s*\|.*\|)|\s*(?:[-*+]|\d+[.)])\s+(?P<item>.*)|(?P<blank>\s*)|(?P<words>.*)")


def markdown_sections(text: str) -> list[Section]:
    """As html_sections(), by lines: fences and pipe tables stay whole, list items stand alone, other lines join to paragraphs."""
    lines = [line.rstrip() for line in re.split(r"\r?\n", text or "")]
    read = [_LINE.fullmatch(line) for line in lines]
    # the lines after an odd number of fences are code
    fences = list(accumulate(int(m["fence"] is not None) for m in read))

    def kind(i: int) -> tuple:
        m = read[i]
        if fences[i] % 2 and m["fence"] is None:
            return "code", fences[i]
        name = "row" if m["rule"] is not None else m.lastgroup
        return (name, None) if name in ("row", "words") else (name, i)

    def content():
        for (name, _), run in groupby(range(len(lines)), kind):
            run = list(run)
            m = read[run[0]]
            if name == "code":
                yield "Table", "\n".join(lines[i] for i in run), 0
            elif name == "row":
                yield "Table", "\n".join(lines[i].strip() for i in run if read[i]["rule"] is None), 0
            elif name == "words":
                yield "Text", " ".join(lines[i].strip() for i in run), 0
            elif name == "item":
                yield "List-item", m["item"], 0
            elif name == "title":
                yield "Section-header", m["title"], len(m["marks"])

    return sectioned(content())


#: Texts that a Python worker turns into rows at once.
ROWS = 64


def few(batches: Iterable[pa.RecordBatch]):
    """batches in slices of ROWS rows: a text may become many rows."""
    for batch in batches:
        for k in range(0, batch.num_rows, ROWS):
            yield batch.slice(k, ROWS)


#: Rows and characters that a Python worker hands back at once.
BATCH_ROWS, BATCH_CHARS = 4096, 1 << 22


def elements(df: DataFrame, key: str, column: str, sections: Callable[[str], list[Section]]) -> DataFrame:
    """key, section, position, type, text of all elements of the texts in column; null has none."""
    schema = f"{key} long, section int, position int, type string, text string"
    out = pa.schema([(key, pa.int64()), ("section", pa.int32()), ("position", pa.int32()), ("type", pa.string()), ("text", pa.string())])

    def run(batches):
        for batch in few(batches):
            rows = [(k, s, i, *e) for k, x in zip(*(c.to_pylist() for c in batch.columns)) for s, part in enumerate(sections(x or "")) for i, e in enumerate(part)]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 5, out)], schema=out)

    return df.select(key, column).mapInArrow(run, schema)


_digits, _spaced, _letters, _others = (re.compile(p).findall for p in ("[0-9]", r"\s[0-9]", "[A-Za-z]+", r"[^\sA-Za-z0-9]+"))


def estimate(text: str) -> int:
    """The token estimate of sparkloom.functions.text, for packing."""
    if not text:
        return 0
    total = 2 + len(_digits(text)) + 0.5 * len(_spaced(text))
    total += sum([math.ceil(len(x) / 6.6) for x in _letters(text)])
    total += sum([math.ceil(len(x) / 2.5) for x in _others(text)])
    return math.ceil(total)


def pieces(text: str, budget: int) -> list[tuple[str, int]]:
    """Paragraphs that fit the budget; sentences of those that don't; of longer sentences, slices that do; each with its tokens."""
    out = []
    for paragraph in re.split(r"\n\s*\n+", text) if "\n" in text else [text]:
        if not (paragraph := paragraph.strip()):
            continue
        if (cost := estimate(paragraph)) <= budget:
            out.append((paragraph, cost))
            continue
        for part in re.split(r"(?<=[.!?])\s+", paragraph):
            while part.strip():
                size = len(part)
                if estimate(part) > budget:
                    size = max(1, min(size, int(budget * size / estimate(part))))
                    while size > 1 and estimate(part[:size]) > budget:
                        size = int(size * 0.9)
                if piece := part[:size].strip():
                    out.append((piece, estimate(piece)))
                part = part[size:]
    return out


def pack(text: str, budget: int, overlap: int) -> list[tuple[str, int]]:
    """(content, tokens) of chunks: pieces in order, each chunk within the budget, begun with the last pieces of the one before as far as
    the overlap allows and there is room."""
    chunks: list[list[tuple[str, int]]] = []
    held: list[tuple[str, int]] = []
    for piece, cost in pieces(text, budget):
        if held and sum(c for _, c in held) + cost > budget:
            chunks.append(held)
            tail: list[tuple[str, int]] = []
            for p in reversed(held):
                if sum(c for _, c in tail) + p[1] > overlap:
                    break
                tail.insert(0, p)
            held = tail if sum(c for _, c in tail) + cost <= budget else []
        held.append((piece, cost))
    if held:
        chunks.append(held)
    # of a single piece the tokens are known
    return [c[0] if len(c) == 1 else (content := "\n\n".join(p for p, _ in c), estimate(content)) for c in chunks]


def chunk(df: DataFrame, key: str = "doc_id", column: str = "text", budget: int = 512, overlap: int = 64) -> DataFrame:
    """key, chunk_index, content, token_count."""
    schema = f"{key} long, chunk_index int, content string, token_count int"
    out = pa.schema([(key, pa.int64()), ("chunk_index", pa.int32()), ("content", pa.string()), ("token_count", pa.int32())])

    def run(batches):
        for batch in few(batches):
            rows = [(k, i, c, n) for k, x in zip(*(c.to_pylist() for c in batch.columns)) for i, (c, n) in enumerate(pack(x or "", budget, overlap))]
            yield pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * 4, out)], schema=out)

    return df.select(key, column).mapInArrow(run, schema)


def packed(rows: DataFrame, keys: list[str], budget: int, overlap: int, whole: Iterable[str] = (), nth: str | None = None) -> DataFrame:
    """rows (keys, type, text) cut to the budget each for itself: keys, part, content, token_count; texts of the types in `whole` stay in one piece.

    nth: a row's number in its document, from 1, by a window that stands right before; then part goes on over the document, without another shuffle of the chunks.
    """
    kinds = dict(rows.dtypes)
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys) + ", part int, content string, token_count int"
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    out, whole = to_arrow_schema(StructType.fromDDL(schema)), frozenset(whole)

    def run(batches):
        last = part = size = 0
        found = []
        made = lambda: pa.record_batch([pa.array(c, f.type) for c, f in zip(list(zip(*found)), out)], schema=out)
        for batch in few(batches):
            *key, types, texts, numbers = (c.to_pylist() for c in batch.columns)
            for k, t, x, n in zip(zip(*key), types, texts, numbers):
                if n != 1 and n != last + 1:
                    raise ValueError(f"row {n} of a document after its row {last}")
                last, part = n, 0 if n == 1 else part
                parts = [(x, estimate(x))] if t in whole and x and x.strip() else pack(x or "", budget, overlap)
                found += [(*k, i, *p) for i, p in enumerate(parts, part)]
                part += len(parts)
                size += sum(len(p) for p, _ in parts)
                if len(found) >= BATCH_ROWS or size >= BATCH_CHARS:
                    yield made()
                    found, size = [], 0
        if found:
            yield made()

    return rows.select(*keys, "type", "text", F.col(nth) if nth else F.lit(1)).mapInArrow(run, schema)


def numbered(chunks: DataFrame, *order: str) -> DataFrame:
    """chunk_index over a document, from 0."""
    return chunks.withColumn("chunk_index", (F.row_number().over(Window.partitionBy("doc_id").orderBy(*order)) - 1).cast("int"))


def page_chunks(pages: DataFrame, budget: int = 512, overlap: int = 64) -> DataFrame:
    """pages (doc_id, page, text) as chunks: never across a page, each with its page's heading. Pages without text have none."""
    rows = packed(pages.withColumn("type", F.lit("Text")), ["doc_id", "page"], budget, overlap)
    headed = rows.join(pages.select("doc_id", "page", detect_heading(F.col("text")).alias("heading")), ["doc_id", "page"])
    return numbered(headed, "page", "part").select("doc_id", "chunk_index", "page", "heading", "content", "token_count")


def element_chunks(found: DataFrame, budget: int = 512, overlap: int = 64) -> DataFrame:
    """Elements (doc_id, page, place, type, text, heading, caption) as chunks: tables and pictures whole, other text cut within its element."""
    # a document's rows are numbered where they stand: they are dealt by document here, or were before
    rows = found.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "place")))
    rows = packed(rows, ["doc_id", "page", "heading", "caption", "type"], budget, overlap, ("Table", "Picture"), "_nth")
    kind = F.when(F.col("type") == "Table", "table").when(F.col("type") == "Picture", "figure").otherwise("text")
    return rows.select("doc_id", F.col("part").alias("chunk_index"), "page", kind.alias("kind"), "heading", "caption", "content", "token_count")


def section_chunks(found: DataFrame, key: str, budget: int = 512, overlap: int = 64) -> DataFrame:
    """Sections' elements (key, section, position, type, text) as chunks; the number of a section among those with text counts as page, and its heading is the last one before."""
    rows = found.where(F.trim("text") != "").withColumnRenamed(key, "doc_id")
    at = Window.partitionBy("doc_id").orderBy("section")
    rows = rows.withColumn("page", F.dense_rank().over(at))
    before = Window.partitionBy("doc_id", "section").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    headed = rows.withColumn("heading", F.last(F.when(F.col("type") == "Section-header", F.trim(F.regexp_replace("text", "^#+\\s*", ""))), ignorenulls=True).over(before))
    content = headed.where("type <> 'Section-header'").withColumn("place", F.col("position")).withColumn("caption", F.lit(None).cast("string"))
    return element_chunks(content, budget, overlap).drop("caption")


def as_text(data):
    """Bytes as text: null if they hold a NUL, or if more than a hundredth of the text is replacement characters; a byte order mark goes."""
    text = F.decode(data, "UTF-8")
    bad = F.length(text) - F.length(F.replace(text, F.lit("\ufffd"), F.lit("")))
    return F.when(~F.contains(F.hex(data), F.lit("00")) | (F.length(F.replace(text, F.lit("\x00"), F.lit(""))) == F.length(text)), F.when(bad <= F.length(text) / 100, F.regexp_replace(text, "^\ufeff", "")))


def format_of(data, name=None):
    """The format of bytes by their content: PDF, DOCX (an archive that names word/document.xml), HTML, else Markdown for text, else null (also for null)."""
    word = F.decode(data, "ISO-8859-1").contains("word/document.xml")
    head = F.decode(F.substring(data, 1, 4096), "ISO-8859-1")
    return (
        F.when(head.startswith("%PDF-"), "pdf").when(head.startswith("PK\x03\x04") & word, "docx").when(head.rlike(r"(?i)<(!doctype html|html|head|body)[\s>]"), "html").when(~head.contains("\x00"), "markdown")
    )
