"""Word files into sections and back, and evaluation files.

A Word file is one value, so it is read in Python, one row at a time, and as a stream of XML events; its main part is read up to MOST bytes.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .loaders import Section, sectioned

#: The part that holds a file's text, and the namespace of its elements.
PART = "word/document.xml"
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
#: A main part that unpacks to more is taken for damaged.
MOST = 256 << 20

_HEADING = re.compile(r"heading ?([1-6])|(title)", re.I)
_SPACE = re.compile(r"[ \t\n\r\f\v]+")
_NOT_XML = re.compile("[^\t\n\r\x20-퟿-�\U00010000-\U0010ffff]")


def _words(node) -> str:
    """A paragraph's text: runs as they stand, tabs and breaks as blanks; deleted text and field codes are other elements."""
    parts = (x.text or "" if x.tag == W + "t" else " " if x.tag in (W + "tab", W + "br", W + "cr") else "" for x in node.iter())
    return _SPACE.sub(" ", "".join(parts)).strip(" ")


def _paragraph(node) -> tuple[str, str, int]:
    style = node.find(f"{W}pPr/{W}pStyle")
    heading = _HEADING.fullmatch(style.get(W + "val", "")) if style is not None else None
    if heading:
        return "Section-header", _words(node), int(heading[1] or 1)
    return "List-item" if node.find(f"{W}pPr/{W}numPr") is not None else "Text", _words(node), 0


def _table(node) -> tuple[str, str, int]:
    rows = ([" ".join(filter(None, map(_words, cell.iter(W + "p")))) for cell in row.findall(W + "tc")] for row in node.iter(W + "tr"))
    return "Table", "\n".join(" | ".join(cells) for cells in rows if any(cells)), 0


def _content(xml) -> Iterator[tuple[str, str, int]]:
    depth = 0
    for event, node in ElementTree.iterparse(xml, ("start", "end")):
        if event == "start":
            depth += node.tag == W + "tbl"
        elif node.tag == W + "tbl":
            depth -= 1
            if not depth:
                yield _table(node)
                node.clear()
        elif node.tag == W + "p" and not depth:
            yield _paragraph(node)
            node.clear()


def docx_sections(data: bytes | None) -> list[Section]:
    """Sections that begin at headings of level 1 to 3; list items and tables are elements of their own, a table's cells stand between bars, one row a line.
    Null, empty, damaged and too large files, and files without a main part, have one empty section."""
    try:
        with zipfile.ZipFile(io.BytesIO(data or b"")) as file:
            if file.getinfo(PART).file_size > MOST:
                return [[]]
            with file.open(PART) as xml:
                return sectioned(_content(xml))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError, EOFError, NotImplementedError, RuntimeError, OSError, zipfile.zlib.error):
        return [[]]


def as_docx(text: str | None) -> bytes:
    """A Word file with a paragraph per line; lines that begin with # to ###### are headings. Characters that XML can't hold become U+FFFD."""

    def paragraph(line: str) -> str:
        marks = re.match(r"(#{1,6}) ", line)
        style = f'<w:pPr><w:pStyle w:val="Heading{len(marks[1])}"/></w:pPr>' if marks else ""
        return f'<w:p>{style}<w:r><w:t xml:space="preserve">{escape(line[marks.end() :] if marks else line)}</w:t></w:r></w:p>'

    lines = _NOT_XML.sub("�", text or "").split("\n")
    body = f'<?xml version="1.0" encoding="UTF-8"?><w:document xmlns:w="{W[1:-1]}"><w:body>{"".join(map(paragraph, lines))}</w:body></w:document>'
    types = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
    links = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as file:
        for name, part in (("[Content_Types].xml", types), ("_rels/.rels", links), (PART, body)):
            file.writestr(name, part)
    return out.getvalue()


def docx_files(texts: DataFrame, key: str, column: str) -> DataFrame:
    """(key, data) with a Word file per text."""
    schema = f"{key} long, data binary"
    out = pa.schema([(key, pa.int64()), ("data", pa.binary())])

    def run(batches):
        for batch in batches:
            for keys, text in zip(batch.column(0), batch.column(1)):
                yield pa.record_batch([pa.array([keys.as_py()], pa.int64()), pa.array([as_docx(text.as_py())], pa.binary())], schema=out)

    return texts.select(key, column).mapInArrow(run, schema)


#: An answer that people or a model graded, one JSON file each.
GRADED = "question_id string, type string, question string, answer string, sources array<struct<id: int, document: string, page: int, content: string>>, grade struct<claims: array<struct<sentence: int, text: string, faithfulness: int>>, completeness: int, reviewed: boolean>"


def graded_answers(spark: SparkSession, path: str, drafts: bool = False) -> DataFrame:
    """The graded answers in a folder's .json files; those without a grade are left out, and those that nobody reviewed unless drafts are wanted. A damaged file fails the job."""
    rows = spark.read.schema(GRADED).option("multiLine", True).option("mode", "FAILFAST").option("pathGlobFilter", "*.json").json(path)
    return rows.where(F.col("grade").isNotNull() if drafts else F.col("grade.reviewed"))


def write_results(rows: DataFrame, path: str) -> None:
    """Rows as JSON lines, nulls written out, in place of an earlier run's."""
    rows.write.mode("overwrite").option("ignoreNullFields", False).json(path)
