"""What kind of file a row is: by its first bytes, by what a container holds, by its extension. All in Column expressions.

ZIP and OLE files are containers of many formats. Of a ZIP file the central directory is found from the end of the content, of an OLE file the
directory sector from the header; the names in them tell the format. Nothing is unpacked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
SLIDES = "application/vnd.openxmlformats-officedocument.presentationml.presentation"
SHEET = "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"

# Extension, MIME type, label, language of code, extraction branch.
FORMATS = f"""
.pdf application/pdf PDF - -
.docx {WORD} DOCX - -
.doc application/msword DOC - -
.pptx {SLIDES} PPTX - -
.ppt application/vnd.ms-powerpoint PPT - -
.xlsx {SHEET} XLSX - -
.xls application/vnd.ms-excel XLS - -
.odt application/vnd.oasis.opendocument.text UNKNOWN - -
.rtf application/rtf RTF - rtf
.txt text/plain TEXT - text
.md text/markdown MARKDOWN - markdown
.markdown text/markdown MARKDOWN - markdown
.csv text/csv CSV - delimited
.tsv text/tab-separated-values TSV - delimited
.json application/json JSON - json
.xml application/xml XML - xml
.html text/html HTML - html
.htm text/html HTML - html
.py text/x-python CODE PYTHON code
.js application/javascript CODE JAVASCRIPT code
.ts application/typescript CODE TYPESCRIPT code
.tsx text/typescript-jsx CODE TYPESCRIPT code
.jsx text/javascript-jsx CODE JAVASCRIPT code
.rs text/x-rust CODE RUST code
.go text/x-go CODE GO code
.c text/x-c CODE C code
.cpp text/x-c++ CODE C++ code
.h text/x-c-header CODE C code
.hpp text/x-c-header CODE C++ code
.java text/x-java CODE JAVA code
.css text/css CODE CSS code
.yaml text/yaml CODE YAML code
.yml text/yaml CODE YAML code
.toml text/plain CODE TOML code
.ini text/plain CODE INI code
.cfg text/plain CODE INI code
.sql text/plain CODE SQL code
.sh text/plain CODE SHELL code
.bat text/plain CODE BATCH code
.ps1 text/plain CODE POWERSHELL code
.log text/plain TEXT - text
.png image/png IMAGE - -
.jpg image/jpeg IMAGE - -
.jpeg image/jpeg IMAGE - -
.webp image/webp IMAGE - -
.bmp image/bmp IMAGE - -
.tiff image/tiff IMAGE - -
.tif image/tiff IMAGE - -
.ico image/x-icon IMAGE - -
.svg image/svg+xml IMAGE - -
.mp3 audio/mpeg AUDIO - -
.wav audio/wav AUDIO - -
.m4a audio/mp4 AUDIO - -
.flac audio/flac AUDIO - -
.ogg audio/ogg AUDIO - -
.aac audio/aac AUDIO - -
.wma audio/x-ms-wma AUDIO - -
.mp4 video/mp4 VIDEO - -
.mkv video/x-matroska VIDEO - -
.mov video/quicktime VIDEO - -
.avi video/x-msvideo VIDEO - -
.webm video/webm VIDEO - -
.wmv video/x-ms-wmv VIDEO - -
"""
ROWS = [[None if x == "-" else x for x in line.split()] for line in FORMATS.split("\n") if line]
MIME, LABEL, LANGUAGE, BRANCH = ({r[0]: r[i] for r in ROWS} for i in range(1, 5))
#: By MIME type: the first extension's.
LABEL_OF_MIME = {r[1]: r[2] for r in reversed(ROWS)} | {"text/plain": "TEXT"}
BRANCH_OF_MIME = {r[1]: r[4] for r in reversed(ROWS)} | {"text/plain": "text"}

# First bytes in hexadecimal, and what they are whatever the extension says.
MAGIC = """
255044462D application/pdf
89504E470D0A1A0A image/png
FFD8FF image/jpeg
7B5C727466 application/rtf
494433 audio/mpeg
664C6143 audio/flac
424D image/bmp
49492A00 image/tiff
4D4D002A image/tiff
53514C69746520666F726D6174203300 application/x-sqlite3
"""
ZIP, OLE, RIFF, OGG, EBML, FTYP = "504B0304", "D0CF11E0A1B11AE1", "52494646", "4F676753", "1A45DFA3", "66747970"
#: Names in a ZIP's directory, and in an OLE directory.
ZIP_NAMES = {"word/document.xml": WORD, "ppt/presentation.xml": SLIDES, "xl/workbook.": SHEET}
OLE_NAMES = {"WordDocument": "application/msword", "PowerPoint Document": "application/vnd.ms-powerpoint", "Workbook": "application/vnd.ms-excel", "Book": "application/vnd.ms-excel"}
END_OF_ZIP, MOST_TAIL, OLE_SECTORS = "PK\x05\x06", 65_557, 8


def _latin(content: Column) -> Column:
    """Bytes as characters, one each."""
    return F.decode(content, "ISO-8859-1")


def _number(content: Column, at: Column | int, size: int) -> Column:
    """The little-endian number of so many bytes at a place from 0."""
    at = F.lit(at) if isinstance(at, int) else at
    byte = lambda i: F.conv(F.hex(F.substring(content, at + i + 1, F.lit(1))), 16, 10).cast("long")
    return sum((byte(i) * 256**i for i in range(1, size)), byte(0))


def zip_names(content: Column) -> Column:
    """The central directory of a ZIP file as text, with the names in it; null without a whole one. Only the end of the file and the directory are looked at."""
    tail = _latin(F.substring(content, F.greatest(F.lit(1), F.length(content) - MOST_TAIL + 1), F.lit(MOST_TAIL)))
    after = F.substring_index(tail, END_OF_ZIP, -1)
    end = F.length(content) - F.length(after)  # behind the mark
    size, begin = _number(content, end + 8, 4), _number(content, end + 12, 4)
    whole = F.contains(tail, F.lit(END_OF_ZIP)) & (F.length(after) >= 18) & (begin + size <= F.length(content))
    return F.when(whole, _latin(F.substring(content, (begin + 1).cast("int"), size.cast("int"))))


def ole_names(content: Column) -> Column:
    """The first directory sectors of an OLE file as text without zero bytes."""
    sector = F.when(_number(content, 30, 2) == 12, 4096).otherwise(512)
    at = (_number(content, 48, 4) + 1) * sector + 1
    found = F.when(at < F.length(content), _latin(F.substring(content, at.cast("int"), (sector * OLE_SECTORS).cast("int"))))
    return F.replace(found, F.lit("\x00"), F.lit(""))


def _first(text: Column, names: dict[str, str], before: str = "") -> Column:
    out = None
    for name, mime in names.items():
        holds = F.contains(text, F.lit(before + name))
        out = F.when(holds, F.lit(mime)) if out is None else out.when(holds, F.lit(mime))
    return out


def _lookup(table: dict[str, str | None], key: Column) -> Column:
    known = F.create_map(*[F.lit(x) for k, v in table.items() if v is not None for x in (k, v)])
    return F.try_element_at(known, key)


def sniffed_mime(content: Column, extension: Column) -> Column:
    """MIME type by content: a container by what it holds, else, if it can't be told, by the extension; null if the first bytes say nothing."""
    head, e = F.hex(F.substring(content, 1, 16)), F.lower(F.coalesce(extension, F.lit("")))
    begins = lambda magic, at=0: F.startswith(F.substring(head, 2 * at + 1, 32), F.lit(magic))
    stored = F.when(_latin(F.substring(content, 31, 8)) == "mimetype", F.regexp_extract(_latin(F.substring(content, 39, 100)), r"^[a-z]+/[\w.+-]*?(?=PK|[^\w.+-]|$)", 0))
    in_zip = F.coalesce(F.when(stored != "", stored), _first(zip_names(content), ZIP_NAMES), F.when(e.isin(".docx", ".pptx", ".xlsx", ".odt"), _lookup(MIME, e)), F.lit("application/zip"))
    in_ole = F.coalesce(_first(ole_names(content), OLE_NAMES), F.when(e.isin(".doc", ".ppt", ".xls"), _lookup(MIME, e)), F.lit("application/msword"))
    out = F.when(begins(ZIP), in_zip).when(begins(OLE), in_ole)
    out = out.when(begins(RIFF) & begins("57415645", 8), "audio/wav").when(begins(RIFF) & begins("57454250", 8), "image/webp")
    out = out.when(begins(OGG), F.when(e == ".ogv", "video/ogg").otherwise("audio/ogg")).when(begins(FTYP, 4), F.when(e.isin(".m4a", ".aac"), "audio/mp4").otherwise("video/mp4"))
    out = out.when(begins(EBML), F.when(e == ".webm", "video/webm").otherwise("video/x-matroska"))
    for line in MAGIC.split():
        if "/" not in line:
            magic = line
        else:
            out = out.when(begins(magic), F.lit(line))
    return out.when(head.rlike("^FF[EF]"), "audio/mpeg")


def detect_format(content: Column, extension: Column) -> Column:
    """struct<mime, label>: by the first bytes and what a container holds, else by the extension, else a text or an octet stream. Null contents go by the extension."""
    e = F.lower(F.coalesce(extension, F.lit("")))
    sniffed = sniffed_mime(content, extension)
    text = F.when(F.is_valid_utf8(content.cast("string")), "text/plain").otherwise("application/octet-stream")
    mime = F.coalesce(sniffed, _lookup(MIME, e), F.coalesce(text, F.lit("application/octet-stream")))
    kind = F.split_part(mime, F.lit("/"), F.lit(1))
    general = F.when(kind.isin("image", "audio", "video"), F.upper(kind)).when(kind == "text", "TEXT").otherwise("UNKNOWN")
    label = F.when(sniffed.isNull(), _lookup(LABEL, e))
    return F.struct(mime.alias("mime"), F.coalesce(label, _lookup(LABEL_OF_MIME, mime), general).alias("label"))


def route(files: DataFrame) -> DataFrame:
    """files (extension, and mime if it is known) with mime, label (of code the language), language and branch: by the extension, else by the MIME type; what no branch takes is SKIPPED with a reason."""
    e = F.lower(F.coalesce(F.col("extension"), F.lit("")))
    given = F.col("mime") if "mime" in files.columns else F.lit(None).cast("string")
    mime = F.coalesce(_lookup(MIME, e), given)
    known = _lookup(LABEL, e).isNotNull()
    branch = F.when(known, _lookup(BRANCH, e)).otherwise(_lookup(BRANCH_OF_MIME, given))
    language = _lookup(LANGUAGE, e)
    label = F.coalesce(language, _lookup(LABEL, e), _lookup(LABEL_OF_MIME, given))
    out = files.withColumn("mime", mime).withColumn("label", label).withColumn("language", language).withColumn("branch", branch)
    why = F.concat(F.lit("No parser for "), F.when(e != "", e).otherwise(F.coalesce("mime", F.lit("a file without an extension"))))
    return out.withColumn("status", F.when(F.col("branch").isNull(), "SKIPPED").otherwise("PROCESSING")).withColumn("reason", F.when(F.col("branch").isNull(), why))
