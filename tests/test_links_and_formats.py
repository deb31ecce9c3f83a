import io
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from corpusloom.operators import graph
from corpusloom.sources import formats
from corpusloom.sources.rtf import parse_rtf, rtf_text


def named(spark):
    files = [("1", "a/report final.txt", "report final.txt"), ("2", "a/b.md", "b.md"), ("3", "c/b.md", "b.md"), ("4", "c/x+y(1).csv", "x+y(1).csv"), ("5", "d/long.name.py", "long.name.py"), ("6", "C:\\Top\\Z.txt", "Z.txt")]
    chunks = [
        ("9", "9:0", 0, "see Report FINAL.txt, and b.md"), ("9", "9:1", 1, "a/b.md; xc/b.md c/b.md2"), ("9", "9:2", 2, "(x+y(1).csv)"), ("8", "8:0", 0, "along.name.py long.name.pyc"), ("8", "8:1", 1, "long.name.py. or 'long.name.py'"),
        ("8", "8:2", 2, "c:/top/z.txt"), ("5", "5:0", 0, "long.name.py itself"), ("7", "7:0", 0, None), ("7", "7:1", 1, ""), ("7", "7:2", 2, "é_report final.txt report final.txté"),
    ]
    return spark.createDataFrame(chunks, "file_id string, chunk_id string, chunk_index int, content string"), spark.createDataFrame(files, "file_id string, relative_path string, filename string")


@pytest.mark.parametrize("bounds", [{}, {"names_a_shard": 3}, {"most_shards": 0}])
def test_references_by_automaton_and_by_join(spark, bounds):
    got = {tuple(r) for r in graph.file_references(*named(spark), **bounds).collect()}
    assert got == {("9", "1", "filename", "9:0"), ("9", "2", "path", "9:1"), ("9", "4", "filename", "9:2"), ("8", "5", "filename", "8:1"), ("8", "6", "path", "8:2")}


def test_references_shuffle_no_text(spark):
    plan = graph.file_references(*named(spark))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 2


def test_rtf_groups_and_escapes():
    assert rtf_text(r"a\~b \_ c\-d {\header HEAD {\b x}}...C:\\users\\u233 end \u233?x \'e9{\*\generator Foo;}\uc2\u8364 ??y{\pict\bin3 }}}}\u-10179?\u-8704? \column k") == "a b - cd ...C:\\users\\u233 end \u00e9x \u00e9\u20acy\U0001f600\nk"
    body = r"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Calibri;}{\f1 Symbol;}}{\colortbl ;\red0;}\viewkind4\uc1\pard\b Executive Summary\b0\par \{esc\} and: \\.\par dash \u8212? and \'e9 clair.\par {\footer PAGE 1}\sect last{\info{\title T}}\par}"
    assert [t for _, _, t in parse_rtf(body)] == ["Executive Summary", "{esc} and: \\.", "dash \u2014 and \u00e9 clair.", "last"]
    assert rtf_text(r"{\rtf1\ansicpg932 \'93\'fa\'96\'7b}") == "\u65e5\u672c" and rtf_text(r"{\rtf1\mac \'8e}") == "\u00e9"
    assert parse_rtf("") == [] and parse_rtf("}}{\\") == [] and parse_rtf("plain") == [("PARAGRAPH", None, "plain")]


def archive(*names, first=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        if first:
            z.writestr("mimetype", first)
        for n in names:
            z.writestr(n, "x" * 3000)
    return out.getvalue()


def ole(*names):
    header = bytearray(512)
    header[:8] = bytes.fromhex(formats.OLE)
    struct.pack_into("<HHH", header, 26, 3, 0xFFFE, 9)
    struct.pack_into("<I", header, 48, 1)  # the directory is in the second sector
    entries = b"".join(n.encode("utf-16-le").ljust(128, b"\0") for n in ("Root Entry", *names))
    return bytes(header) + bytes(512) + entries.ljust(512, b"\0")


CASES = [
    (archive("[Content_Types].xml", "word/document.xml"), ".bin", formats.WORD, "DOCX"), (archive("ppt/presentation.xml"), "", formats.SLIDES, "PPTX"), (archive("xl/workbook.xml"), ".docx", formats.SHEET, "XLSX"),
    (archive("xl/workbook.bin"), ".zip", formats.SHEET, "XLSX"), (archive("content.xml", first="application/vnd.oasis.opendocument.text"), ".zip", "application/vnd.oasis.opendocument.text", "UNKNOWN"),
    (archive("readme.txt"), ".zip", "application/zip", "UNKNOWN"), (b"PK\x03\x04cut", ".pptx", formats.SLIDES, "PPTX"), (b"PK\x03\x04cut", ".x", "application/zip", "UNKNOWN"), (archive("a") + b"trailing word/document.xml", ".x", "application/zip", "UNKNOWN"),
    (ole("WordDocument"), ".x", "application/msword", "DOC"), (ole("Workbook"), ".doc", "application/vnd.ms-excel", "XLS"), (ole("PowerPoint Document"), "", "application/vnd.ms-powerpoint", "PPT"), (ole("Other"), ".xls", "application/vnd.ms-excel", "XLS"), (ole(), "", "application/msword", "DOC"),
    (b"%PDF-1.7", ".docx", "application/pdf", "PDF"), (b"\x89PNG\r\n\x1a\n", ".dat", "image/png", "IMAGE"), (b"RIFF\x24\0\0\0WAVEfmt ", ".bin", "audio/wav", "AUDIO"), (b"RIFF\x24\0\0\0WEBP", "", "image/webp", "IMAGE"), (b"ID3x", "", "audio/mpeg", "AUDIO"), (b"\xff\xfb\x90", "", "audio/mpeg", "AUDIO"),
    (b"\xff\xd8\xff\xe0", "", "image/jpeg", "IMAGE"), (b"\0\0\0\x20ftypmp42", ".m4a", "audio/mp4", "AUDIO"), (b"\0\0\0\x20ftypmp42", ".x", "video/mp4", "VIDEO"), (b"\x1aE\xdf\xa3", ".webm", "video/webm", "VIDEO"), (b"OggS", ".ogv", "video/ogg", "VIDEO"), (b"SQLite format 3\0\x10", ".db", "application/x-sqlite3", "UNKNOWN"),
    (b"Plain text", ".txt", "text/plain", "TEXT"), (b"Plain text", ".MD", "text/markdown", "MARKDOWN"), (b"x = 1", ".py", "text/x-python", "CODE"), (b"x: 1", ".toml", "text/plain", "CODE"), (b"words", ".qqq", "text/plain", "TEXT"), (b"\xff\x00\xfe", ".qqq", "application/octet-stream", "UNKNOWN"),
    (b"", "", "text/plain", "TEXT"), (None, ".pdf", "application/pdf", "PDF"), (None, None, "application/octet-stream", "UNKNOWN"), (b"<svg", ".svg", "image/svg+xml", "IMAGE"),
]


def test_formats_by_content(spark):
    df = spark.createDataFrame([(i, c, e) for i, (c, e, _, _) in enumerate(CASES)], "i int, content binary, extension string")
    got = {r.i: tuple(r.kind) for r in df.select("i", formats.detect_format(F.col("content"), F.col("extension")).alias("kind")).collect()}
    assert got == {i: (mime, label) for i, (_, _, mime, label) in enumerate(CASES)}


def test_every_extension_is_known(spark):
    assert len(formats.MIME) == 62 + 1 and len(set(formats.BRANCH.values())) == 9
    rows = [(e, None) for e in formats.MIME] + [(".odd", "text/csv"), (".odd", "image/gif"), ("", None), (None, "text/markdown")]
    got = {(r.extension, r.mime): r for r in formats.route(spark.createDataFrame(rows, "extension string, mime string")).collect()}
    assert got[(".odd", "text/csv")].branch == "delimited" and got[(None, "text/markdown")].branch == "markdown" and got[(".tsx", "text/typescript-jsx")].language == "TYPESCRIPT"
    assert got[(".odd", "image/gif")].status == got[(".pdf", "application/pdf")].status == "SKIPPED" and got[(".pdf", "application/pdf")].reason == "No parser for .pdf" and got[("", None)].reason == "No parser for a file without an extension"
