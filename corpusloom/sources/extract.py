"""From files to elements: (file_id, elem_idx, type, level, text, line_start, line_end, char_start, char_end).

Text, Markdown and code are cut with windows over lines. Markup and tabular formats are parsed by small functions, a batch of files at a time,
inside mapInPandas; register_extractor adds formats.
"""

from __future__ import annotations

import csv
import io
import json
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions import text as T
from corpusloom.sources.formats import detect_format, route
from corpusloom.sources.rtf import parse_rtf

__all__ = ["detect_format", "parse_rtf", "route"]

ELEMENTS = "file_id string, elem_idx int, type string, level int, text string"
ROWS_PER_TABLE = 50

Parser = Callable[[str], list[tuple[str, int | None, str]]]
EXTRACTORS: dict[str, Parser] = {}


def register_extractor(branch: str, parse: Parser) -> None:
    """A parser takes a file's text and returns its elements: (type, level, text)."""
    EXTRACTORS[branch] = parse


def scan_files(spark: SparkSession, root: str, recursive: bool = True, pattern: str | None = None) -> DataFrame:
    """path, relative_path, filename, extension, size_bytes, modified_at of each file under root; contents aren't read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    f = (reader.option("pathGlobFilter", pattern) if pattern else reader).load(root)
    parts = T.path_parts(F.col("path"))
    return f.select("path", F.expr(f"substring(path, locate('{root.rstrip('/')}/', path) + {len(root.rstrip('/')) + 1})").alias("relative_path"), parts["name"].alias("filename"), parts["extension"].alias("extension"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"))


def decode_strictly(files: DataFrame) -> DataFrame:
    """files (content binary) with text and a decode error: invalid UTF-8 has no text; a byte order mark goes."""
    s = F.col("content").cast("string")
    good = F.is_valid_utf8(s)
    return files.withColumn("text", F.when(good, F.regexp_replace(s, r"^\x{FEFF}", ""))).withColumn("error", F.when(~good, "invalid UTF-8"))


def text_lines(files: DataFrame) -> DataFrame:
    """(file_id, line, content, at): lines from 1, with the place of their first character from 0."""
    rows = files.select("file_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("n", "content"))
    before = W.partitionBy("file_id").orderBy("n").rowsBetween(W.unboundedPreceding, -1)
    return rows.select("file_id", (F.col("n") + 1).alias("line"), "content", F.coalesce(F.sum(F.length("content") + 1).over(before), F.lit(0)).alias("at"))


def _islands(rows: DataFrame, starts: Column) -> DataFrame:
    """Elements from lines with type and level: an element begins where starts holds."""
    w = W.partitionBy("file_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    e = rows.withColumn("island", F.count_if(starts).over(w)).filter("type is not null")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "content"))), lambda x: x["content"]), "\n")
    e = e.groupBy("file_id", "island").agg(F.first("type").alias("type"), F.first("level").alias("level"), text.alias("text"), F.min("line").alias("line_start"), F.max("line").alias("line_end"), F.min("at").alias("char_start"), F.max(F.col("at") + F.length("content")).alias("char_end"))
    index = F.row_number().over(W.partitionBy("file_id").orderBy("line_start")) - 1
    return e.select("file_id", index.alias("elem_idx"), "type", "level", "text", "line_start", "line_end", "char_start", "char_end")


def _previous(column: str) -> Column:
    return F.lag(column).over(W.partitionBy("file_id").orderBy("line"))


def text_elements(files: DataFrame) -> DataFrame:
    """Paragraphs between blank lines."""
    blank = F.trim(F.regexp_replace("content", r"\s", "")) == ""
    rows = text_lines(files).withColumn("type", F.when(~blank, "PARAGRAPH")).withColumn("level", F.lit(None).cast("int"))
    return _islands(rows, blank)


def markdown_elements(files: DataFrame) -> DataFrame:
    """Headings, list items, fenced code, tables and paragraphs."""
    w = W.partitionBy("file_id").orderBy("line").rowsBetween(W.unboundedPreceding, 0)
    rows = text_lines(files).withColumn("fence", F.col("content").rlike(r"^\s*(```|~~~)"))
    rows = rows.withColumn("fences", F.count_if("fence").over(w))
    code = F.col("fence") | (F.col("fences") % 2 == 1)
    c = F.col("content")
    kind = (
        F.when(code, "CODE_BLOCK")
        .when(F.trim(c) == "", F.lit(None))
        .when(c.rlike(r"^#{1,6}\s+\S"), "HEADING")
        .when(c.rlike(r"^\s*\|.*\|\s*$"), "TABLE")
        .when(c.rlike(r"^\s*([-*+]|\d+[.)])\s+"), "LIST_ITEM")
        .otherwise("PARAGRAPH")
    )
    rows = rows.withColumn("type", kind).withColumn("level", F.when(F.col("type") == "HEADING", F.length(F.regexp_extract("content", "^#+", 0))))
    rows = rows.withColumn("opens", F.col("fence") & (F.col("fences") % 2 == 1)).withColumn("before", _previous("type"))
    starts = F.coalesce(F.col("type") != F.col("before"), F.lit(True)) | F.col("type").isin("HEADING", "LIST_ITEM") | F.col("opens")
    return _islands(rows, starts).withColumn("text", F.when(F.col("type") == "HEADING", F.trim(F.regexp_replace("text", r"^#{1,6}\s+", ""))).otherwise(F.col("text")))


# What a class or type and a function begin with, some in files of one language only.
CLASS_LINE = r"^\s*class "
TYPE_LINES = {".rs": r"^\s*(pub |pub\(crate\) )?(struct|enum|impl|trait) ", ".go": r"^\s*type "}
FUNCTION_LINE = r"^\s*((async )?def |function |(pub |pub\(crate\) )?(async )?fn |func |public void |public int )"


def code_elements(files: DataFrame) -> DataFrame:
    """A heading of level 1 for each class line, of level 2 for each function line, without a colon or brace at its end; the lines under them are a code block.
    Types of Rust and Go are known by the file's extension, if files has one."""
    rows = text_lines(files)
    first = F.col("content").rlike(CLASS_LINE)
    if "extension" in files.columns:
        rows = rows.join(files.select("file_id", F.lower("extension").alias("extension")), "file_id")
        for extension, line in TYPE_LINES.items():
            first = first | ((F.col("extension") == extension) & F.col("content").rlike(line))
    level = F.when(first, 1).when(F.col("content").rlike(FUNCTION_LINE), 2)
    rows = rows.withColumn("level", level).withColumn("type", F.when(level.isNotNull(), "HEADING").otherwise("CODE_BLOCK")).withColumn("before", _previous("type"))
    starts = (F.col("type") == "HEADING") | F.coalesce(F.col("before") == "HEADING", F.lit(True))
    plain = F.trim(F.regexp_replace(F.regexp_replace(F.trim("text"), ":+$", ""), r"\{+$", ""))
    return _islands(rows, starts).withColumn("text", F.when(F.col("type") == "HEADING", plain).otherwise(F.col("text")))


class _Html(HTMLParser):
    # What is left out, and what ends a paragraph.
    LEFT_OUT = frozenset("script style nav header footer aside noscript svg".split())
    BLOCKS = frozenset("p div article section li ul ol br table tr blockquote pre h1 h2 h3 h4 h5 h6".split())

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found, self.words, self.hidden, self.level = [], [], [], None
        self.table: list[list[str]] | None = None

    def end(self) -> None:
        text = re.sub(r"\s+", " ", "".join(self.words)).strip()
        if text and self.table is not None:
            if self.table:
                self.table[-1].append(text)
        elif text:
            self.found.append(("HEADING" if self.level else "PARAGRAPH", self.level, text))
        self.words = []

    def handle_starttag(self, tag, attrs):
        if tag in self.LEFT_OUT:
            self.hidden.append(tag)
        if self.hidden:
            return
        if tag in self.BLOCKS or tag in ("td", "th"):
            self.end()
        if tag == "table":
            self.table = []
        elif tag == "tr" and self.table is not None:
            self.table.append([])
        elif re.fullmatch("h[1-6]", tag):
            self.level = int(tag[1])

    def handle_endtag(self, tag):
        if tag in self.hidden:
            while self.hidden.pop() != tag:
                pass
            return
        if self.hidden:
            return
        if tag in self.BLOCKS or tag in ("td", "th"):
            self.end()
        if tag == "table" and self.table is not None:
            rows, self.table = [r for r in self.table if r], None
            if rows:
                self.found.append(("TABLE", None, markdown_table(rows[0], rows[1:])))
        elif re.fullmatch("h[1-6]", tag):
            self.level = None

    def handle_data(self, data):
        if not self.hidden:
            self.words.append(data)


def markdown_table(headers: list[str], rows: list[list[str]]) -> str:
    line = lambda cells: "| " + " | ".join(str(c).replace("|", "\\|").replace("\n", " ") for c in cells) + " |"
    pad = lambda r: (r + [""] * len(headers))[: len(headers)]
    return "\n".join([line(headers), line(["---"] * len(headers)), *(line(pad(r)) for r in rows)])


def parse_html(text: str) -> list[tuple[str, int | None, str]]:
    p = _Html()
    p.feed(text)
    p.close()
    p.end()
    return p.found


def parse_delimited(text: str) -> list[tuple[str, int | None, str]]:
    """Tables of 50 rows, each with the header; level is the first row's number, from 1."""
    try:
        dialect = csv.Sniffer().sniff(text[:4096], delimiters=",;\t|")
    except csv.Error:
        dialect = csv.excel
    rows = [r for r in csv.reader(io.StringIO(text), dialect) if r]
    return [("TABLE", start + 1, markdown_table(rows[0], rows[1 + start : 1 + start + ROWS_PER_TABLE])) for start in range(0, len(rows) - 1, ROWS_PER_TABLE)]


def parse_json(text: str) -> list[tuple[str, int | None, str]]:
    """A list of objects as tables of 50, by the first one's keys; an object as a heading and a paragraph for each key; else one paragraph."""
    try:
        data = json.loads(text)
    except ValueError:
        return [("PARAGRAPH", None, text.strip())]
    if isinstance(data, list) and data and all(isinstance(x, dict) for x in data):
        keys = list(data[0])
        cell = lambda v: v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
        rows = [[cell(x.get(k, "")) for k in keys] for x in data]
        return [("TABLE", i + 1, markdown_table(keys, rows[i : i + ROWS_PER_TABLE])) for i in range(0, len(rows), ROWS_PER_TABLE)]
    if isinstance(data, dict):
        return [e for k, v in data.items() for e in (("HEADING", 1, str(k)), ("PARAGRAPH", None, v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)))]
    return [("PARAGRAPH", None, json.dumps(data, ensure_ascii=False))]


def parse_xml(text: str) -> list[tuple[str, int | None, str]]:
    """Headings for branches, paragraphs for leaves; a text with a document type or entities gives nothing."""
    if re.search(r"<!(DOCTYPE|ENTITY)", text, re.IGNORECASE):
        return []
    try:
        root = ElementTree.fromstring(text)
    except ElementTree.ParseError:
        return []
    out, stack = [], [(root, 1)]
    while stack:
        node, depth = stack.pop()
        name, own = node.tag.rpartition("}")[2], (node.text or "").strip()
        if len(node):
            out.append(("HEADING", min(depth, 6), name))
        if own:
            out.append(("PARAGRAPH", None, f"{name}: {own}"))
        stack.extend((child, depth + 1) for child in reversed(node))
    return out


for _branch, _parse in (("html", parse_html), ("rtf", parse_rtf), ("delimited", parse_delimited), ("json", parse_json), ("xml", parse_xml)):
    register_extractor(_branch, _parse)


def parsed_elements(files: DataFrame, branch: str) -> DataFrame:
    """Elements of files (file_id, text) by the branch's parser."""
    parse = EXTRACTORS[branch]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for start in range(0, len(pdf), 200):
                part = pdf.iloc[start : start + 200]
                rows = [(f, i, *e) for f, t in zip(part["file_id"], part["text"], strict=True) if t for i, e in enumerate(parse(t))]
                frame = pd.DataFrame(rows, columns=["file_id", "elem_idx", "type", "level", "text"])
                frame["level"] = frame["level"].astype("Int32")
                yield frame

    return files.select("file_id", "text").mapInPandas(run, ELEMENTS)
