"""Scalar functions on text, as Column expressions: everything stays in the JVM unless it says otherwise."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point ranges that count one token a character.
CJK = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}"
# The ranges that queries are tested for; Extension B is only here.
CJK_QUERY = CJK + r"\x{20000}-\x{2A6DF}"
# Extensions that make a query a file name.
FILE_EXTENSIONS = (
    "pdf docx pptx xlsx csv md py json txt ts tsx js jsx html css rs go c cpp h java sh bat cmd sql yaml yml toml xml log env ini cfg zip tar gz 7z png jpg jpeg gif svg rtf odt ods odp"
).split()
# First words of a question or a request.
QUESTION_WORDS = "what how why who where when can could would is are tell summarize find search explain describe show give list".split()
# Message patterns, tested in this order.
GREETING = r"(?i)^(hi|hello|hey|hey\s+there|greetings|good\s+morning|good\s+afternoon|good\s+evening|howdy|hola|yo)[\s.!?,]*$"
CONVERSATIONAL = (
    r"(?i)(how\s+are\s+you|who\s+are\s+you|what\s+is\s+your\s+name|what\s+are\s+you|thanks|thank\s+you|bye|goodbye|cya|see\s+you|^help[\s.!?,]*$|what\s+can\s+you\s+do|"
    r"what\s+are\s+your\s+capabilities|help\s+me|what\s+features\s+do\s+you\s+have)"
)
INVENTORY = (
    r"(?i)(what\s+files\s+(do\s+i\s+have|are\s+indexed|have\s+been\s+indexed|are\s+in\s+this|are\s+there|are\s+in\s+the\s+index)|show\s+(me\s+)?(all\s+)?(my\s+)?(indexed\s+)?(files|documents)|"
    r"list\s+(all\s+)?(my\s+)?(indexed\s+)?(files|documents)|what\s+are\s+all\s+the\s+files|tell\s+me\s+about\s+this\s+file|what\s+is\s+this\s+file|how\s+many\s+files|what\s+folders|"
    r"which\s+folders|show\s+folders|list\s+folders)"
)
# What is masked, and by what, one after the other.
SECRETS = (
    (r"(?i)(Bearer\s+)[A-Za-z0-9\-\._~\+/]+=*", "$1[REDACTED]"),
    (r"(?i)((?:api[_-]?key|password|secret|token)\s*[:=]\s*['\"]?)(?:[^\s,'\"]+)(['\"]?)", "$1[REDACTED]$2"),
    (r"(?i)(Authorization\s*:\s*(?!Bearer\b))['\"]?[^\s,'\"]+['\"]?", "Authorization: [REDACTED]"),
    (r"\bsk-[A-Za-z0-9_-]{16,}\b", "sk-[REDACTED]"),
    (r"(?i)(https?://[^:\s]+:)[^@\s]+(@)", "$1[REDACTED]$2"),
)
#: White space at the ends of a text.
BLANKS = " \t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\u00a0"


def strip(col: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(col, F.lit(BLANKS))


def _tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """By rule from the Unicode data of the basic plane: letters with marks of U+0300 to U+036F to the letter alone; characters to their compatible forms
    (NFKC); a character and a mark after it to the composed one."""
    plain, compatible, composed = {}, {}, {}
    for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]):
        parts = unicodedata.normalize("NFD", c)
        if len(parts) > 1 and all("\u0300" <= m <= "\u036f" for m in parts[1:]):
            plain[c] = parts[0]
        if (k := unicodedata.normalize("NFKC", c)) != c:
            compatible[c] = k
        pair = unicodedata.decomposition(c)
        if pair and not pair.startswith("<") and " " in pair:
            pair = "".join(chr(int(x, 16)) for x in pair.split())
            if unicodedata.normalize("NFC", pair) == c:
                composed[pair] = c
    return plain, compatible, composed


_PLAIN, _COMPATIBLE, _COMPOSED = _tables()
_MARKS = "".join(map(chr, range(0x300, 0x370)))


def _beyond_ascii(col: Column, done: Column) -> Column:
    """done where the text has more than ASCII: a count of bytes spares all other texts the work."""
    return F.when(F.octet_length(col) == F.length(col), col).otherwise(done)


def _literal_map(table: dict[str, str]) -> Column:
    """The table as a map, written as one literal: a plan with thousands of them takes seconds to make."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in table.items())), F.lit("\x01"), F.lit("\x02"))


def _replaced(col: Column, table: dict[str, str]) -> Column:
    """Each character of the table for its longer form. Texts without any are left alone."""
    known = _literal_map(table)
    chars = F.transform(F.split(col, ""), lambda c: F.coalesce(F.try_element_at(known, c), c))
    return F.when(col.rlike(f"[{''.join(table)}]"), F.array_join(chars, "")).otherwise(col)


def without_marks(col: Column) -> Column:
    """Letters without their accents and other marks of U+0300 to U+036F, whether composed or apart."""
    return _beyond_ascii(col, F.translate(col, "".join(_PLAIN) + _MARKS, "".join(_PLAIN.values())))


def compatible(col: Column) -> Column:
    """NFKC for the basic plane, in the JVM: full and half width forms, ligatures, circled and raised characters become plain ones, and marks are composed with the
    letter before them. Several marks in an order that isn't canonical keep it, and single jamo aren't composed."""
    one = {k: v for k, v in _COMPATIBLE.items() if len(v) == 1}
    more = {k: v for k, v in _COMPATIBLE.items() if len(v) != 1}
    out = _replaced(F.translate(col, "".join(one), "".join(one.values())), more)
    known = _literal_map(_COMPOSED)
    marks = "".join(sorted({pair[1] for pair in _COMPOSED}))

    start = F.struct(F.lit("").alias("done"), F.lit("").alias("last"))

    def add(acc: Column, c: Column) -> Column:
        both = F.try_element_at(known, F.concat(acc["last"], c))
        return F.when(both.isNotNull(), F.struct(acc["done"].alias("done"), both.alias("last"))).otherwise(F.struct(F.concat(acc["done"], acc["last"]).alias("done"), c.alias("last")))

    whole = F.aggregate(F.split(out, ""), start, add, lambda acc: F.concat(acc["done"], acc["last"]))
    return _beyond_ascii(col, F.when(out.rlike(f"[{marks}]"), whole).otherwise(out))


#: Characters that become several by upper(), each with the one that it becomes by itself: titles are single where such a one exists.
_WIDENED = {c: "\u1e9e" if c == "\u00df" else c.title() if len(c.title()) == 1 else c for c in map(chr, [*range(0x80, 0xD800), *range(0xE000, 0x10000)]) if len(c.upper()) > 1}


def upper_each(col: Column) -> Column:
    """Upper case of each character by itself, so that none becomes several: sharp s has its own capital."""
    known = _literal_map(_WIDENED)
    rest = "".join(c for c in _WIDENED if c != "\u00df")
    chars = F.transform(F.split(col, ""), lambda c: F.coalesce(F.try_element_at(known, c), F.upper(c)))
    return F.when(col.rlike(f"[{rest}]"), F.array_join(chars, "")).otherwise(F.upper(F.translate(col, "\u00df", "\u1e9e")))


def tokenize(col: Column) -> Column:
    """Lower-cased runs of letters and digits, without accents and other marks."""
    return F.regexp_extract_all(F.lower(without_marks(F.coalesce(col, F.lit("")))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def query_tokens(col: Column) -> Column:
    """Words of a query: separators - _ . : / stay inside words and go at their ends; repeats that differ in case are left out."""
    words = F.transform(F.regexp_extract_all(compatible(F.coalesce(col, F.lit(""))), F.lit(r"[\p{L}\p{N}_.:/-]+"), F.lit(0)), lambda w: F.regexp_replace(w, r"^[._/:-]+|[._/:-]+$", ""))
    words = F.filter(words, lambda w: w != "")
    step = lambda acc, w: F.when(F.exists(acc, lambda x: F.lower(x) == F.lower(w)), acc).otherwise(F.concat(acc, F.array(w)))
    return F.aggregate(words, F.array().cast("array<string>"), step)


def query_phrases(col: Column) -> Column:
    """Quoted phrases, stripped, empty ones left out."""
    return F.filter(F.transform(F.regexp_extract_all(F.coalesce(col, F.lit("")), F.lit('"([^"]+)"'), F.lit(1)), strip), lambda p: p != "")


def match_terms(col: Column) -> Column:
    """Terms that all must match: array<struct<toks array<string>, prefix boolean>>. A phrase matches word for word; a compound
    word as a phrase and each part of two or more characters as a prefix; any other word as a prefix if it has two characters
    or is CJK."""
    phrase = F.transform(query_phrases(col), lambda p: F.struct(tokenize(p).alias("toks"), F.lit(False).alias("prefix")))
    rest = query_tokens(F.regexp_replace(F.coalesce(col, F.lit("")), '"[^"]+"', " "))

    def of_word(w: Column) -> Column:
        parts = tokenize(w)
        compound = F.concat(
            F.array(F.struct(parts.alias("toks"), F.lit(False).alias("prefix"))),
            F.transform(F.filter(parts, lambda p: F.length(p) >= 2), lambda p: F.struct(F.array(p).alias("toks"), F.lit(True).alias("prefix"))),
        )
        single = F.array(F.struct(parts.alias("toks"), ((F.length(w) >= 2) | is_cjk(w)).alias("prefix")))
        return F.when(F.size(parts) > 1, compound).otherwise(single)

    terms = F.concat(phrase, F.flatten(F.transform(rest, of_word)))
    return F.array_distinct(F.filter(terms, lambda t: F.size(t["toks"]) > 0))


def is_cjk(col: Column) -> Column:
    return col.rlike(f"[{CJK_QUERY}]")


def stems(filename: Column) -> tuple[Column, Column]:
    """The name before its last dot, and before its first."""
    return F.regexp_replace(filename, r"\.[^.]*$", ""), F.substring_index(filename, ".", 1)


def filename_boost(query: Column, tokens: Column, filename: Column, domain: str = "bm25") -> Column:
    """What a query that names the file adds to its score."""
    whole, word, stem = {"bm25": (5.0, 3.0, 2.0), "rrf": (0.02, 0.008, 0.005)}[domain]
    name, q = F.lower(filename), F.lower(query)
    direct, root = stems(name)
    long = F.filter(F.transform(tokens, F.lower), lambda t: F.length(t) >= 2)
    return (
        F.when((q == name) | (q == direct) | (q == root), F.lit(whole))
        .when(F.exists(long, lambda t: t == name), F.lit(word))
        .when(F.exists(long, lambda t: (t == direct) | (t == root)), F.lit(stem))
        .otherwise(F.lit(0.0))
    )


def cosine(a: Column, b: Column) -> Column:
    """Similarity of two arrays of numbers, in [-1, 1], with 4 decimals."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.greatest(norm, F.lit(1e-12)))), 4)


def l2_normalize(v: Column) -> Column:
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: x.cast("double") / F.greatest(norm, F.lit(1e-12)))


def sigmoid(x: Column) -> Column:
    return F.round(1 / (1 + F.exp(-x)), 6)


def _cjk_count(col: Column) -> Column:
    return F.when(F.length(col) == F.octet_length(col), 0).otherwise(F.length(F.regexp_replace(col, f"[^{CJK}]", "")))


def chunk_tokens(col: Column) -> Column:
    """A token for each CJK character and for every four others, at least one; 0 for blank text."""
    t = strip(F.coalesce(col, F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(F.greatest(F.lit(1), _cjk_count(t) + F.floor((F.length(t) - _cjk_count(t)) / 4))).cast("long")


def budget_tokens(col: Column, chars_per_token: float = 3.5) -> Column:
    """The careful estimate: a token for each CJK character and for every 3.5 others, rounded up."""
    t = strip(F.coalesce(col, F.lit("")))
    return F.when(t == "", F.lit(0)).otherwise(F.greatest(F.lit(1), _cjk_count(t) + F.ceil((F.length(t) - _cjk_count(t)) / chars_per_token))).cast("long")


def content_hash(col: Column) -> Column:
    return F.sha2(strip(F.coalesce(col, F.lit(""))), 256)


def chunk_id(file_id: Column, h1: Column, h2: Column, index: Column, hash_: Column) -> Column:
    """chk_ and 16 digits of the SHA-256 of the parts as a JSON list."""
    quoted = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.array(c)), r"(?s)^\[(.*)\]$", 1), F.lit("null"))
    parts = F.concat(F.lit("["), F.concat_ws(",", quoted(file_id), F.when(h1.isNull(), F.lit("null")).otherwise(quoted(h1)), F.when(h2.isNull(), F.lit("null")).otherwise(quoted(h2)), index.cast("string"), quoted(hash_)), F.lit("]"))
    return F.concat(F.lit("chk_"), F.substring(F.sha2(parts, 256), 1, 16))


def topic_key(col: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(col), r"\s+", " "))


def topic_evidence(topic: Column, citations: Column) -> Column:
    """Citations that mention a word of the topic longer than two characters; all of them if none does."""
    words = F.filter(F.split(topic_key(topic), " "), lambda w: F.length(w) > 2)
    kept = F.filter(citations, lambda c: F.exists(words, lambda w: F.contains(F.lower(c), w)))
    return F.when(F.size(kept) == 0, citations).otherwise(kept)


def format_timestamp(seconds: Column) -> Column:
    s = F.floor(seconds).cast("long")
    h, m, r = F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("int")
    return F.when(h > 0, F.format_string("%02d:%02d:%02d", h, m, r)).otherwise(F.format_string("%02d:%02d", m, r))


def evidence_header(source: Column, section: Column, page: Column, line_start: Column, line_end: Column) -> Column:
    """[Source: f | Section: s | Page: p | Lines: a-b], without what is absent."""
    parts = [
        F.concat(F.lit("Source: "), source),
        F.when(section.isNotNull() & (section != "") & (section != "General"), F.concat(F.lit("Section: "), section)),
        F.when(page.isNotNull(), F.concat(F.lit("Page: "), page.cast("string"))),
        F.when(line_start.isNotNull() & line_end.isNotNull(), F.concat(F.lit("Lines: "), line_start.cast("string"), F.lit("-"), line_end.cast("string"))),
    ]
    return F.concat(F.lit("["), F.concat_ws(" | ", *parts), F.lit("]"))


def cited_numbers(answer: Column) -> Column:
    """Numbers of the [E n] markers in order of first appearance."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(answer, F.lit("")), F.lit(r"\[[Ee]\s*(\d+)\]"), F.lit(1)), lambda d: d.cast("int")))


def snippet(content: Column, tokens: Column, most: int = 240) -> Column:
    """At most `most` characters around the first whole-word hit, else the first hit, else from the start."""
    low = F.lower(content)
    at = lambda found: F.array_min(F.filter(found, lambda p: p > 0))
    word = at(F.transform(tokens, lambda t: F.regexp_instr(low, F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.lower(t), F.lit(r"\E(?![\p{L}\p{N}_])")))))
    part = at(F.transform(tokens, lambda t: F.instr(low, F.lower(t))))
    hit = F.coalesce(word, part, F.lit(1))
    start = F.greatest(F.lit(1), F.least(hit - most // 2, F.length(content) - most + 1))
    cut = strip(F.substring(content, start, F.lit(most)))
    return F.when(F.length(content) <= most, strip(content)).otherwise(F.concat(F.when(start > 1, "...").otherwise(""), cut, F.when(start + most - 1 < F.length(content), "...").otherwise("")))


def chat_intent(col: Column) -> Column:
    q = strip(F.coalesce(col, F.lit("")))
    return F.when((q == "") | q.rlike(GREETING) | q.rlike(CONVERSATIONAL), "CONVERSATIONAL").when(q.rlike(INVENTORY), "METADATA_INVENTORY").otherwise("GROUNDED_CONTENT")


def redact_secrets(col: Column) -> Column:
    for pattern, by in SECRETS:
        col = F.regexp_replace(col, pattern, by)
    return col


def filename_intent(col: Column) -> Column:
    """The file name that a query asks for; null if it is no file name."""
    raw = strip(col)
    raw = F.when(raw.rlike("""(?s)^(".*"|'.*')$"""), strip(F.substring(raw, F.lit(2), F.length(raw) - 2))).otherwise(raw)
    name = strip(F.element_at(F.split(F.replace(raw, F.lit("\\"), F.lit("/")), "/"), -1))
    stem, ext = strip(F.regexp_replace(name, r"\.[^.]*$", "")), F.lower(strip(F.substring_index(name, ".", -1)))
    words = F.split(F.lower(stem), r"\s+")
    asks = (F.size(words) > 1) & F.element_at(words, 1).isin(QUESTION_WORDS)
    good = (raw != "") & ~raw.contains("?") & ~raw.contains("\n") & name.contains(".") & ext.isin(FILE_EXTENSIONS) & (stem != "") & ~asks & (F.size(words) <= 6)
    return F.when(good, name)


def path_parts(path: Column) -> dict[str, Column]:
    """slashes made one way; name, folder and extension (lower case, with its dot)."""
    norm = F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "/+", "/")
    norm = F.when(F.length(norm) > 1, F.regexp_replace(norm, "/$", "")).otherwise(norm)
    name = F.element_at(F.split(norm, "/"), -1)
    return {"path": norm, "name": name, "folder": F.regexp_replace(norm, "/?[^/]*$", ""), "extension": F.lower(F.regexp_extract(name, r".(\.[^.]+)$", 1))}


def path_in_root(path: Column, root: Column) -> Column:
    return (path == root) | F.startswith(path, F.concat(root, F.lit("/")))


def string_list(col: Column) -> Column:
    """A JSON list, a JSON list in a JSON string, comma-separated values or one value, as a list; empty items left out."""
    inner = F.when(col.rlike(r'^\s*"'), F.element_at(F.from_json(F.concat(F.lit("["), col, F.lit("]")), "array<string>"), 1)).otherwise(col)
    listed = F.when(inner.rlike(r"^\s*\["), F.from_json(inner, "array<string>"))
    return F.filter(F.transform(F.coalesce(listed, F.split(F.coalesce(inner, F.lit("")), ",")), lambda x: F.trim(x)), lambda x: x != "")


def parse_answer(col: Column) -> Column:
    """summary, topics and decisions (ten at most) of a model's JSON answer, with or without code fences or text around; the text is the summary if there is no JSON."""
    schema = "struct<summary:string,topics:array<string>,decisions:array<string>>"
    plain = strip(F.regexp_replace(col, r"(?m)^\s*```[a-zA-Z]*\s*$", ""))
    found = F.from_json(F.regexp_extract(plain, r"(?s)\{.*\}", 0), schema)
    return F.struct(
        F.coalesce(found["summary"], plain).alias("summary"),
        F.slice(F.coalesce(found["topics"], F.array().cast("array<string>")), 1, 10).alias("topics"),
        F.slice(F.coalesce(found["decisions"], F.array().cast("array<string>")), 1, 10).alias("decisions"),
    )


def with_prefix(col: Column, prefix: str) -> Column:
    """The task prefix of an embedding model, unless it is there."""
    return F.when(F.startswith(col, F.lit(prefix)), col).otherwise(F.concat(F.lit(prefix), col))


def export_filename(title: Column) -> Column:
    clean = F.trim(F.regexp_replace(F.coalesce(title, F.lit("")), r"[^\p{L}\p{N} _-]", ""))
    return F.when(clean == "", F.lit("export")).otherwise(F.replace(clean, F.lit(" "), F.lit("_")))


def table_to_markdown(headers: Column, rows: Column) -> Column:
    """A cell grid as a Markdown table: pipes escaped, line breaks made spaces, short rows padded."""
    cell = lambda c: F.replace(F.regexp_replace(F.coalesce(c, F.lit("")), r"\r?\n", " "), F.lit("|"), F.lit("\\|"))
    line = lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))
    width = F.size(headers)
    padded = lambda r: F.concat(F.transform(F.slice(r, 1, width), cell), F.array_repeat(F.lit(""), F.greatest(F.lit(0), width - F.size(r))))
    body = F.transform(rows, lambda r: line(padded(r)))
    return F.array_join(F.concat(F.array(line(F.transform(headers, cell)), line(F.transform(headers, lambda c: F.lit("---")))), body), "\n")
