"""Queries for sources, extraction, chunking and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking, export, indexing, lifecycle
from corpusloom.plans.registry import query
from corpusloom.sources import extract as X
from corpusloom.sources import large
from corpusloom.sources.shared import shared_path
from corpusloom.sources.tables import FILES, LINES, files, lines, messages, table

LINE_ROWS = """ln AS (SELECT file_id, chunk_index + 1 AS line, content, coalesce(sum(length(content) + 1) OVER (PARTITION BY file_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos FROM lines)"""


def texts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_id"), "text")


def marked_up(spark, sf):
    """documents as Markdown: every line that ends a paragraph of ten lines is followed by a blank one; first lines are headings."""
    t = F.regexp_replace(F.concat(F.lit("# "), "text"), r"\n([^\n]*\|)", "\n\n| $1")
    return table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_id"), t.alias("text"))


@query("scan_files")
def scan_files(spark, sf):
    return X.scan_files(spark, sf, pattern="*.parquet").select("filename", "extension", "size_bytes")


@query("detect_format", "SELECT page_id, CASE WHEN page_id % 3 = 0 THEN 'PDF' WHEN page_id % 3 = 1 THEN 'HTML' ELSE 'TEXT' END AS label FROM pages")
def detect_format(spark, sf):
    k = F.col("page_id") % 3
    p = table(spark, sf, "pages").select("page_id", F.when(k == 0, F.concat(F.lit("%PDF-1.7 "), "html")).otherwise(F.col("html")).cast("binary").alias("content"), F.when(k == 1, ".html").otherwise("").alias("extension"))
    return p.select("page_id", X.detect_format(F.col("content"), F.col("extension"))["label"].alias("label"))


@query("decode_utf8_strict", "SELECT page_id, CASE WHEN page_id % 4 = 0 THEN NULL ELSE md5(html) END AS text_hash, CASE WHEN page_id % 4 = 0 THEN 'invalid UTF-8' END AS error FROM pages")
def decode_utf8_strict(spark, sf):
    raw = F.when(F.col("page_id") % 4 == 0, F.concat(F.unhex(F.lit("C328")), F.col("html").cast("binary"))).when(F.col("page_id") % 4 == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.col("html").cast("binary"))).otherwise(F.col("html").cast("binary"))
    return X.decode_strictly(table(spark, sf, "pages").select("page_id", raw.alias("content"))).select("page_id", F.md5(F.col("text").cast("binary")).alias("text_hash"), "error")


@query("text_elements", f"WITH {LINES}, {LINE_ROWS}, g AS (SELECT *, sum(CASE WHEN trim(content) = '' THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY line) AS island FROM ln), e AS (SELECT file_id, island, min(line) AS line_start, max(line) AS line_end, min(pos) AS char_start, max(pos + length(content)) AS char_end FROM g WHERE trim(content) <> '' GROUP BY ALL) SELECT file_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY line_start) - 1 AS INTEGER) AS elem_idx, line_start, line_end, char_start, char_end FROM e")
def text_elements(spark, sf):
    return X.text_elements(texts(spark, sf)).select("file_id", "elem_idx", "line_start", "line_end", "char_start", "char_end")


@query("markdown_elements")
def markdown_elements(spark, sf):
    return X.markdown_elements(marked_up(spark, sf))


HEADS = ["def ", "  class ", "pub(crate) async fn ", "func (r T) ", "pub struct ", "type "]


@query(
    "code_elements",
    f"""WITH src AS (SELECT doc_id, CASE doc_id % 6 WHEN 4 THEN '.rs' WHEN 5 THEN '.go' ELSE '.py' END AS ext, string_split(replace(text, '. ', ':{{' || chr(10) || {HEADS}[doc_id % 6 + 1]), chr(10)) AS parts FROM documents),
    l AS (SELECT doc_id, ext, i AS line, parts[i] AS content FROM src, LATERAL unnest(range(1, len(parts) + 1)) AS t(i)),
    k AS (SELECT *, coalesce(sum(length(content) + 1) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS begins,
      CASE WHEN starts_with(ltrim(content), 'class ') OR (ext = '.rs' AND regexp_matches(content, '^ *(pub |pub\\(crate\\) )?(struct|enum|impl|trait) ')) OR (ext = '.go' AND starts_with(ltrim(content), 'type ')) THEN 1
        WHEN regexp_matches(content, '^ *(def |async def |function |fn |pub fn |pub\\(crate\\) fn |async fn |pub async fn |pub\\(crate\\) async fn |func |public void |public int )') THEN 2 END AS level FROM l),
    s AS (SELECT *, CASE WHEN level IS NOT NULL OR lag(level) OVER w IS NOT NULL OR lag(line) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM k WINDOW w AS (PARTITION BY doc_id ORDER BY line)),
    g AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY line) AS island FROM s),
    e AS (SELECT doc_id, island, any_value(level) AS level, string_agg(content, chr(10) ORDER BY line) AS text, min(line) AS line_start, max(line) AS line_end, min(begins) AS char_start, max(begins + length(content)) AS char_end FROM g GROUP BY doc_id, island)
    SELECT doc_id::VARCHAR AS file_id, CAST(island - 1 AS INTEGER) AS elem_idx, CASE WHEN level IS NULL THEN 'CODE_BLOCK' ELSE 'HEADING' END AS type, level,
      CASE WHEN level IS NULL THEN text ELSE trim(regexp_replace(regexp_replace(trim(text), ':+$', ''), '\\{{+$', '')) END AS text, CAST(line_start AS INTEGER) AS line_start, CAST(line_end AS INTEGER) AS line_end, CAST(char_start AS BIGINT) AS char_start, CAST(char_end AS BIGINT) AS char_end FROM e""",
)
def code_elements(spark, sf):
    """The documents as code: each sentence begins as a function or a type does in one language."""
    k = F.col("doc_id") % 6
    head = F.element_at(F.array(*map(F.lit, HEADS)), (k + 1).cast("int"))
    d = table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_id"), F.when(k == 4, ".rs").when(k == 5, ".go").otherwise(".py").alias("extension"), F.replace("text", F.lit(". "), F.concat(F.lit(":{\n"), head)).alias("text"))
    return X.code_elements(d)


@query("html_elements")
def html_elements(spark, sf):
    return X.parsed_elements(table(spark, sf, "pages").select(F.col("page_id").cast("string").alias("file_id"), F.col("html").alias("text")), "html")


@query("rtf_paragraphs", "SELECT CAST(doc_id AS VARCHAR) AS file_id, CAST(len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS BIGINT) AS n FROM documents")
def rtf_paragraphs(spark, sf):
    body = F.regexp_replace(F.regexp_replace("text", r"([\\{}])", r"\\$1"), "\n", r"\\par ")
    rtf = F.concat(F.lit(r"{\rtf1\ansi{\fonttbl{\f0 Arial;}}\f0\fs24 "), body, F.lit("}"))
    found = X.parsed_elements(table(spark, sf, "documents").select(F.col("doc_id").cast("string").alias("file_id"), rtf.alias("text")), "rtf")
    return found.groupBy("file_id").agg(F.count(F.lit(1)).alias("n"))


def orders_by(spark, sf, cell, head, sep):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 50).cast("string").alias("file_id"), "o_orderkey", cell.alias("cell"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "cell"))), lambda x: x["cell"])
    return o.groupBy("file_id").agg(F.concat(F.lit(head), F.array_join(rows, sep)).alias("text"))


@query("delimited_tables", "WITH r AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS file_id, (row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1) // 50 AS g FROM orders) SELECT file_id, CAST(g * 50 + 1 AS INTEGER) AS first_row, count(*) AS n FROM r GROUP BY ALL")
def delimited_tables(spark, sf):
    f = orders_by(spark, sf, F.concat_ws(";", "o_orderkey", "o_orderstatus", "o_orderpriority"), "key;status;priority\n", "\n")
    return X.parsed_elements(f, "delimited").select("file_id", F.col("level").alias("first_row"), (F.size(F.split("text", "\n")) - 2).cast("long").alias("n"))


@query("json_elements", "WITH r AS (SELECT CAST(o_custkey % 50 AS VARCHAR) AS file_id, (row_number() OVER (PARTITION BY o_custkey % 50 ORDER BY o_orderkey) - 1) // 50 AS g FROM orders) SELECT file_id, CAST(g * 50 + 1 AS INTEGER) AS first_item, count(*) AS n FROM r GROUP BY ALL")
def json_elements(spark, sf):
    f = orders_by(spark, sf, F.to_json(F.struct("o_orderkey", "o_orderstatus")), "[", ",").withColumn("text", F.concat("text", F.lit("]")))
    return X.parsed_elements(f, "json").select("file_id", F.col("level").alias("first_item"), (F.size(F.split("text", "\n")) - 2).cast("long").alias("n"))


@query("xml_elements", "SELECT CAST(o_custkey % 50 AS VARCHAR) AS file_id, count(*) AS leaves FROM orders GROUP BY 1")
def xml_elements(spark, sf):
    f = orders_by(spark, sf, F.concat(F.lit("<order>"), F.col("o_orderkey").cast("string"), F.lit("</order>")), "<orders>", "").withColumn("text", F.concat("text", F.lit("</orders>")))
    return X.parsed_elements(f, "xml").filter("type = 'PARAGRAPH'").groupBy("file_id").agg(F.count(F.lit(1)).alias("leaves"))


ROUTED = f"WITH {FILES}, r AS (SELECT file_id, CASE extension WHEN '.en' THEN '.md' WHEN '.fr' THEN '.csv' WHEN '.de' THEN '.py' ELSE extension END AS ext FROM files)"


def as_formats(spark, sf):
    e = F.col("extension")
    return files(spark, sf).withColumn("extension", F.when(e == ".en", ".md").when(e == ".fr", ".csv").when(e == ".de", ".py").otherwise(e))


@query("parser_route", f"{ROUTED} SELECT file_id, CASE ext WHEN '.md' THEN 'markdown' WHEN '.csv' THEN 'delimited' WHEN '.py' THEN 'code' END AS branch, CASE WHEN ext IN ('.md', '.csv', '.py') THEN 'PROCESSING' ELSE 'SKIPPED' END AS status, CASE WHEN ext NOT IN ('.md', '.csv', '.py') THEN 'No parser for ' || ext END AS reason FROM r")
def parser_route(spark, sf):
    return X.route(as_formats(spark, sf)).select("file_id", "branch", "status", "reason")


@query("format_labels", f"{ROUTED} SELECT file_id, CASE ext WHEN '.md' THEN 'text/markdown' WHEN '.csv' THEN 'text/csv' WHEN '.py' THEN 'text/x-python' END AS mime, CASE ext WHEN '.md' THEN 'MARKDOWN' WHEN '.csv' THEN 'CSV' WHEN '.py' THEN 'PYTHON' END AS label FROM r")
def format_labels(spark, sf):
    return X.route(as_formats(spark, sf)).select("file_id", "mime", "label")


@query("replace_file_chunks", f"WITH {LINES} SELECT chunk_id, CASE WHEN extension = '.fr' THEN upper(content) ELSE content END AS content FROM lines WHERE extension <> '.fr' OR chunk_index < 3")
def replace_file_chunks(spark, sf):
    base = lines(spark, sf)
    new = base.filter("extension = '.fr' and chunk_index < 3").withColumn("content", T.upper_each(F.col("content")))
    changed = base.filter("extension = '.fr'").select("file_id").distinct()
    return lifecycle.replace_rows(base, new, changed, "file_id").select("chunk_id", "content")


@query("load_vectors", "SELECT vec_id, CASE WHEN vec_id % 10 = 0 THEN -1 ELSE label END AS label FROM embeddings")
def load_vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return lifecycle.load_vectors(e, e.filter("vec_id % 10 = 0").withColumn("label", F.lit(-1)), "vec_id", 64).select("vec_id", "label")


@query("export_conversation", "SELECT conv_id, '# Conversation ' || conv_id || chr(10) || chr(10) || string_agg('**' || CASE WHEN role = 'user' THEN 'User' ELSE 'Assistant' END || '**: ' || text, chr(10) || chr(10) ORDER BY turn) AS markdown FROM conversations GROUP BY conv_id")
def export_conversation(spark, sf):
    return export.conversation_markdown(messages(spark, sf), F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")))


@query("chunk_documents")
def chunk_documents(spark, sf):
    return chunking.chunk_documents(X.markdown_elements(marked_up(spark, sf)))


@query("split_tables")
def split_tables(spark, sf):
    f = orders_by(spark, sf, F.concat_ws(";", "o_orderkey", "o_orderstatus", "o_orderpriority"), "key;status;priority\n", "\n")
    return chunking.split_tables(X.parsed_elements(f, "delimited"), most=1000, target=500)


@query("incremental_index")
def incremental_index(spark, sf):
    """The documents as Markdown files over a chunk table that knows half of them."""
    f = marked_up(spark, sf).withColumn("extension", F.lit(".md")).withColumn("sha256", F.sha2("text", 256))
    old = f.filter(F.col("file_id").cast("long") % 2 == 0).select("file_id", F.lit(0).alias("chunk_index"), F.concat("file_id", F.lit(":0")).alias("chunk_id"), F.col("text").alias("content"), F.col("sha256").alias("source_sha256"), F.lit("1").alias("parser_version"), F.lit("1").alias("chunker_version"))
    return indexing.incremental_index(f, old).select("file_id", "chunk_index", "chunk_id")


TURNS = "t AS (SELECT conv_id || ':' || turn AS file_id, turn, regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '') AS text FROM conversations)"


@query(
    "index_batches",
    rf"""WITH {TURNS}, first AS (SELECT file_id, text, 0 AS batch_id FROM t WHERE turn % 2 = 0), second AS (SELECT file_id, CASE WHEN turn % 3 = 0 THEN 'Again: ' || text ELSE text END AS text, turn FROM t WHERE turn % 5 <> 4),
    f AS (SELECT s.file_id, s.text, CASE WHEN s.text = o.text THEN 0 ELSE 1 END AS batch_id FROM second s LEFT JOIN first o USING (file_id)),
    c AS (SELECT file_id, batch_id, unnest(list_filter(string_split_regex(text, '\n\s*\n'), lambda x: trim(x) <> '')) AS p FROM f)
    SELECT file_id, CAST(batch_id AS BIGINT) AS batch_id, string_agg(p, chr(10) || chr(10)) AS content, true AS embedded FROM c GROUP BY ALL""",
)
def index_batches(spark, sf):
    """Turns of conversations as files, in two batches: those with even numbers; then all, every third changed and every fifth deleted. The second batch runs twice."""
    path = shared_path(spark, "index")
    t = messages(spark, sf).select(F.concat_ws(":", "conv_id", "turn").alias("file_id"), "turn", T.strip(F.col("text")).alias("text"), F.lit(".txt").alias("extension"), F.lit(0).alias("seq"))
    first = t.filter("turn % 2 = 0").withColumn("deleted", F.lit(False))
    second = t.withColumn("text", F.when(F.col("turn") % 3 == 0, F.concat(F.lit("Again: "), "text")).otherwise(F.col("text"))).withColumn("deleted", F.col("turn") % 5 == 4)
    for number, batch in ((0, first), (1, second), (1, second)):
        indexing.index_batch(batch.withColumn("sha256", F.sha2("text", 256)), path, number, buckets=16)
    c = indexing.indexed_chunks(spark, path)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "\n\n")
    return c.groupBy("file_id", "batch_id").agg(joined.alias("content"), F.bool_and(F.col("embedding").isNotNull()).alias("embedded"))


PRICED = """r AS (SELECT o_orderkey // 2000 AS file_id, CAST(row_number() OVER (PARTITION BY o_orderkey // 2000 ORDER BY o_orderkey) AS BIGINT) AS record, o_orderkey, o_orderstatus, o_orderpriority, o_custkey FROM orders)"""


def priced_files(spark, sf):
    """Orders as delimited files of up to 2000 rows: quoted cells with line breaks, delimiters and quotes in them."""
    note = F.concat(F.lit('"'), "o_orderstatus", F.lit(';\n""'), "o_orderpriority", F.lit('"""'))
    o = table(spark, sf, "orders").select(F.floor(F.col("o_orderkey") / 2000).cast("string").alias("file_id"), "o_orderkey", F.concat_ws(";", "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, note).otherwise(F.col("o_orderpriority")), "o_custkey").alias("row"))
    rows = F.transform(F.array_sort(F.collect_list(F.struct("o_orderkey", "row"))), lambda x: x["row"])
    return o.groupBy("file_id").agg(F.concat(F.lit("key;note;customer\n"), F.array_join(rows, "\n"), F.lit("\n")).alias("text"))


@query("delimited_cells", f"WITH {PRICED} SELECT file_id::VARCHAR AS file_id, record, o_orderkey::VARCHAR AS key, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus || ';' || chr(10) || '\"' || o_orderpriority || '\"' ELSE o_orderpriority END AS note, o_custkey::VARCHAR AS customer FROM r")
def delimited_cells(spark, sf):
    c = large.delimited_cells(large.delimited_records(large.lines_of_texts(priced_files(spark, sf), 500)))
    return c.select("file_id", "record", *[F.get("cells", F.lit(i)).alias(name) for i, name in enumerate(("key", "note", "customer"))])
