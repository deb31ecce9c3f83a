"""Queries for aggregates, windows, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import summary as S
from corpusloom.plans.registry import query
from corpusloom.sources.tables import FILES, LINES, STATUSES, TOPICS, files, lines, messages, table, topics

TOK = "(SELECT CASE WHEN c = '' THEN 0 ELSE greatest(1, length(c) // 4) END FROM (SELECT regexp_replace(regexp_replace(content, '^\\s+', ''), '\\s+$', '') AS c))"


@query("count_by_status", f"WITH {FILES} SELECT s AS status, count(file_id) AS n FROM (SELECT unnest({STATUSES}) AS s) LEFT JOIN files ON index_status = s GROUP BY s UNION ALL SELECT 'TOTAL', count(*) FROM files")
def count_by_status(spark, sf):
    return S.count_by_status(files(spark, sf), STATUSES)


@query("corpus_stats", f"WITH {LINES} SELECT count(*) AS chunks, count(DISTINCT file_id) AS files FROM lines")
def corpus_stats(spark, sf):
    return S.corpus_stats(lines(spark, sf))


@query("index_progress", f"WITH {FILES} SELECT round(100.0::DOUBLE * count(*) FILTER (index_status = 'INDEXED') / count(*), 1) AS percent FROM files")
def index_progress(spark, sf):
    return S.index_progress(files(spark, sf))


@query(
    "corpus_overview",
    f"""WITH {FILES}, {TOPICS}, {LINES}, n AS (SELECT (SELECT count(*) FROM lines) AS chunks, (SELECT count(*) FROM insights) AS insights, (SELECT count(*) FROM files) AS files, (SELECT count(*) FROM files WHERE index_status = 'INDEXED') AS indexed, (SELECT count(DISTINCT conv_id) FROM conversations) AS conversations, (SELECT count(DISTINCT folder_id) FROM files) AS folders)
    SELECT i.file_id, filename, files, indexed, chunks, conversations, folders, n.insights AS insights FROM (SELECT * FROM insights ORDER BY updated_at DESC, file_id LIMIT 10) i JOIN files f ON f.file_id = i.file_id, n""",
)
def corpus_overview(spark, sf):
    f = files(spark, sf)
    top = S.newest(topics(spark, sf), "file_id", "updated_at", 10).join(f.select("file_id", "filename"), "file_id")
    one = f.agg(F.count(F.lit(1)).alias("files"), F.count_if(F.col("index_status") == "INDEXED").alias("indexed"), F.countDistinct("folder_id").alias("folders")).select(F.struct("files", "indexed", "folders").alias("s")).scalar()
    talks = messages(spark, sf).agg(F.countDistinct("conv_id")).scalar()
    total = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return top.select("file_id", "filename", one["files"].alias("files"), one["indexed"].alias("indexed"), total(lines(spark, sf)).alias("chunks"), talks.alias("conversations"), one["folders"].alias("folders"), total(topics(spark, sf)).alias("insights"))


@query("topic_clusters", f"WITH {TOPICS} SELECT topic, count(*) AS file_count, string_agg(file_id, ',' ORDER BY file_id) AS files FROM (SELECT DISTINCT file_id, unnest(topics) AS topic FROM insights) GROUP BY topic")
def topic_clusters(spark, sf):
    return S.topic_clusters(topics(spark, sf))


@query("dominant_topics", f"WITH {TOPICS}, t AS (SELECT folder_id, topic, count(*) AS n FROM (SELECT folder_id, unnest(topics) AS topic FROM insights) GROUP BY ALL) SELECT *, CAST(row_number() OVER (PARTITION BY folder_id ORDER BY n DESC, topic) AS INTEGER) AS rank FROM t QUALIFY rank <= 10")
def dominant_topics(spark, sf):
    return S.dominant_topics(topics(spark, sf))


@query(
    "folder_summary",
    f"""WITH {FILES}, {LINES}, f AS (SELECT folder_id, count(*) AS files, count(*) FILTER (index_status = 'INDEXED') AS indexed, count(*) FILTER (index_status IN ('FAILED', 'SKIPPED')) AS failed, count(*) FILTER (index_status NOT IN ('INDEXED', 'FAILED', 'SKIPPED', 'MISSING')) AS waiting, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY folder_id),
    c AS (SELECT folder_id, count(*) AS chunks, sum({TOK})::BIGINT AS tokens FROM lines GROUP BY folder_id), e AS (SELECT folder_id, string_agg(x, ',' ORDER BY x) AS extensions FROM (SELECT folder_id, extension || '=' || count(*) AS x FROM files GROUP BY folder_id, extension) GROUP BY folder_id)
    SELECT * FROM f LEFT JOIN c USING (folder_id) JOIN e USING (folder_id)""",
)
def folder_summary(spark, sf):
    return S.folder_summary(files(spark, sf), lines(spark, sf))


@query(
    "document_summary",
    f"""WITH {LINES}, r AS (SELECT file_id, chunk_index, left(content, 2) AS section, length(content) // 100 AS page, {TOK} AS tokens FROM lines),
    s AS (SELECT file_id, string_agg(section, ',' ORDER BY i) AS sections FROM (SELECT * FROM (SELECT file_id, section, min(chunk_index) AS i FROM r GROUP BY file_id, section) QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY i) <= 20) GROUP BY file_id),
    p AS (SELECT file_id, string_agg(page, ',' ORDER BY page) AS pages FROM (SELECT DISTINCT file_id, page FROM r QUALIFY dense_rank() OVER (PARTITION BY file_id ORDER BY page) <= 20) GROUP BY file_id)
    SELECT file_id, count(*) AS chunks, sum(tokens)::BIGINT AS tokens, any_value(sections) AS sections, any_value(pages) AS pages FROM r JOIN s USING (file_id) JOIN p USING (file_id) GROUP BY file_id""",
)
def document_summary(spark, sf):
    return S.document_summary(lines(spark, sf), F.substring("content", 1, 2), F.floor(F.length("content") / 100))


@query("composite_hash", f"WITH {FILES} SELECT folder_id, sha256(string_agg(file_id || ':' || sha256 || ':' || size_bytes, '' ORDER BY file_id)) AS hash FROM files GROUP BY folder_id")
def composite_hash(spark, sf):
    return S.composite_hash(files(spark, sf), "sha256", "size_bytes")


@query(
    "inventory_report",
    f"""WITH {FILES}, e AS (SELECT 'extension' AS kind, extension AS name, count(*) AS n, sum(size_bytes)::BIGINT AS bytes FROM files GROUP BY extension ORDER BY n DESC, name LIMIT 8)
    SELECT * FROM e UNION ALL SELECT 'status', index_status, count(*), sum(size_bytes)::BIGINT FROM files GROUP BY index_status UNION ALL SELECT 'total', '', count(*), sum(size_bytes)::BIGINT FROM files""",
)
def inventory_report(spark, sf):
    return S.inventory(files(spark, sf))


@query("chat_overview", "SELECT conv_id, count(*) AS messages, arg_max(text, turn) AS last_message, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id")
def chat_overview(spark, sf):
    return S.chat_overview(messages(spark, sf))


@query("chunk_counts", f"WITH {LINES}, {FILES} SELECT folder_id, file_id, count(*) AS chunks FROM lines WHERE file_id IN (SELECT file_id FROM files WHERE index_status <> 'SKIPPED') GROUP BY ALL")
def chunk_counts(spark, sf):
    return lines(spark, sf).join(files(spark, sf).filter("index_status <> 'SKIPPED'").select("file_id"), "file_id", "left_semi").groupBy("folder_id", "file_id").agg(F.count(F.lit(1)).alias("chunks"))


SIGNALS = r"""sig AS (SELECT doc_id, length(text) AS chars, length(text) - length(regexp_replace(text, '\x{FFFD}', '', 'g')) AS replacement, length(text) - length(regexp_replace(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x{9f}]', '', 'g')) AS control,
    length(text) - length(regexp_replace(text, '[\t\n\r \x{A0}\x{2000}-\x{200A}\x{3000}]', '', 'g')) AS whitespace, len(regexp_extract_all(text, '\S+')) AS words, regexp_split_to_array(text, '\n\s*\n') AS blocks FROM documents),
  sg AS (SELECT doc_id, chars, chars - replacement - control AS printable, replacement, control, whitespace, words, len(blocks) AS pages, len(list_filter(blocks, lambda p: length(trim(p)) >= 30 AND len(regexp_extract_all(p, '\S+')) >= 5)) AS meaningful,
    round((chars - replacement - control)::DOUBLE / greatest(1, chars), 4) AS printable_ratio, round(replacement::DOUBLE / greatest(1, chars), 4) AS replacement_ratio, round(control::DOUBLE / greatest(1, chars), 4) AS control_ratio, round(whitespace::DOUBLE / greatest(1, chars), 4) AS whitespace_ratio FROM sig)"""


@query("extraction_signals", f"WITH {SIGNALS} SELECT * FROM sg")
def extraction_signals(spark, sf):
    return S.extraction_signals(table(spark, sf, "documents"))


@query("quality_gate", f"WITH {SIGNALS} SELECT doc_id, CASE WHEN meaningful = 0 AND chars::DOUBLE / pages < 25 AND doc_id % 2 = 1 THEN 'REQUIRES_OCR' WHEN (pages > 1 AND meaningful > 0 AND meaningful < pages AND doc_id % 2 = 1) OR (pages = 1 AND chars < 30 AND doc_id % 2 = 0) THEN 'PARSE_WARNING' ELSE 'PARSED' END AS status FROM sg")
def quality_gate(spark, sf):
    return S.quality_gate(S.extraction_signals(table(spark, sf, "documents")), F.col("doc_id") % 2).select("doc_id", "status")


PLACED = f"WITH {LINES}, p AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY chunk_index) - 1 AS place, count(*) OVER (PARTITION BY file_id) AS total FROM lines)"


@query("strided_sample", f"{PLACED} SELECT chunk_id FROM p WHERE total <= 4 OR (place % (total // 4) = 0 AND place // (total // 4) < 4)")
def strided_sample(spark, sf):
    return S.strided(lines(spark, sf), 4).select("chunk_id")


@query("head_mid_tail", f"{PLACED} SELECT chunk_id FROM p WHERE total <= 15 OR place < 5 OR place >= total - 5 OR (place >= greatest(0, total // 2 - 3) AND place < total // 2 + 3)")
def head_mid_tail(spark, sf):
    return S.head_mid_tail(lines(spark, sf)).select("chunk_id")


@query(
    "representative_chunks",
    f"""{PLACED}, r AS (SELECT *, {TOK} AS tokens, row_number() OVER (PARTITION BY file_id, left(content, 1) ORDER BY chunk_index) AS s, row_number() OVER (PARTITION BY file_id, length(content) // 1000 ORDER BY chunk_index) AS h FROM p),
    w AS (SELECT *, sum(tokens) OVER (PARTITION BY file_id ORDER BY chunk_index) AS used, row_number() OVER (PARTITION BY file_id ORDER BY chunk_index) AS n FROM r WHERE total <= 10 OR place < 2 OR place >= total - 2 OR s = 1 OR h = 1) SELECT chunk_id FROM w WHERE total <= 10 OR used <= 300 OR n = 1""",
)
def representative_chunks(spark, sf):
    c = lines(spark, sf).withColumn("section", F.substring("content", 1, 1)).withColumn("h1", F.floor(F.length("content") / 1000).cast("string")).withColumn("tokens", T.chunk_tokens(F.col("content")))
    return S.representative_chunks(c, "section", "h1", "tokens", 300).select("chunk_id")


@query(
    "heading_context",
    f"""WITH {LINES}, e AS (SELECT file_id, chunk_index AS elem_idx, CASE WHEN length(content) < 40 THEN 1 WHEN length(content) < 80 THEN 2 WHEN length(content) < 120 THEN 3 END AS level, trim(content) AS text FROM lines),
    a AS (SELECT *, count(*) FILTER (level = 1) OVER w AS n, last_value(CASE WHEN level = 1 THEN text END IGNORE NULLS) OVER w AS h1 FROM e WINDOW w AS (PARTITION BY file_id ORDER BY elem_idx)),
    b AS (SELECT *, last_value(CASE WHEN level = 2 THEN text END IGNORE NULLS) OVER w AS h2, last_value(CASE WHEN level > 1 THEN text END IGNORE NULLS) OVER w AS low FROM a WINDOW w AS (PARTITION BY file_id, n ORDER BY elem_idx))
    SELECT file_id, elem_idx, h1, h2, CASE WHEN low IS NULL THEN coalesce(h1, 'General') WHEN h1 IS NULL THEN low ELSE h1 || ' > ' || low END AS section FROM b""",
)
def heading_context(spark, sf):
    n = F.length("content")
    e = lines(spark, sf).select("file_id", F.col("chunk_index").alias("elem_idx"), F.when(n < 40, 1).when(n < 80, 2).when(n < 120, 3).alias("level"), F.col("content").alias("text"))
    return S.heading_context(e).select("file_id", "elem_idx", "h1", "h2", "section")


@query("running_offsets", f"WITH {LINES} SELECT chunk_id, chunk_index + 1 AS line, coalesce(sum(length(content) + 1) OVER (PARTITION BY file_id ORDER BY chunk_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS char_start FROM lines")
def running_offsets(spark, sf):
    from pyspark.sql import Window as W

    before = W.partitionBy("file_id").orderBy("chunk_index").rowsBetween(W.unboundedPreceding, -1)
    return lines(spark, sf).select("chunk_id", (F.col("chunk_index") + 1).alias("line"), F.coalesce(F.sum(F.length("content") + 1).over(before), F.lit(0)).alias("char_start"))


@query("latest_per_key", "SELECT * FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_key(spark, sf):
    return S.latest(table(spark, sf, "orders"), "o_custkey", "o_orderdate", "o_orderkey")


@query("superseded", "SELECT event_id, user_id FROM events QUALIFY lead(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL")
def superseded(spark, sf):
    return S.not_superseded(table(spark, sf, "events"), "user_id", "ts", "event_id").select("event_id", "user_id")


@query("retain_newest", "SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F' UNION ALL (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1000)")
def retain_newest(spark, sf):
    return S.retain_newest(table(spark, sf, "orders"), F.col("o_orderstatus") == "F", "o_orderdate", "o_orderkey", 1000).select("o_orderkey")


@query(
    "history_window",
    r"""WITH m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS line FROM conversations QUALIFY back <= 6),
    u AS (SELECT *, sum(length(line)) OVER (PARTITION BY conv_id ORDER BY back) AS used FROM m WHERE trim(text) <> '') SELECT conv_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM u WHERE used <= 3000 GROUP BY conv_id""",
)
def history_window(spark, sf):
    return S.history_window(messages(spark, sf))


@query("auto_title", "SELECT conv_id, CASE WHEN length(t) > 40 THEN left(t, 40) || '...' ELSE t END AS title FROM (SELECT conv_id, trim(arg_min(text, turn)) AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)")
def auto_title(spark, sf):
    return S.auto_title(messages(spark, sf))


@query("page_files", f"WITH {FILES} SELECT file_id, modified_at, (SELECT count(*) FROM files WHERE extension = '.en') AS matching FROM files WHERE extension = '.en' ORDER BY modified_at DESC, file_id LIMIT 50 OFFSET 100")
def page_files(spark, sf):
    f = files(spark, sf).filter("extension = '.en'")
    return S.page_of(f, F.desc("modified_at"), F.col("file_id"), limit=50, offset=100).select("file_id", "modified_at", f.agg(F.count(F.lit(1))).scalar().alias("matching"))


@query("page_log", "SELECT event_id, ts, event_type FROM events ORDER BY ts DESC, event_id LIMIT 100")
def page_log(spark, sf):
    return S.page_of(table(spark, sf, "events"), F.desc("ts"), F.col("event_id"), limit=100).select("event_id", "ts", "event_type")


@query(
    "representative_files",
    f"""WITH {FILES}, {LINES}, {TOPICS}, c AS (SELECT file_id, count(*) AS n FROM lines GROUP BY file_id)
    SELECT folder_id, CAST(row_number() OVER (PARTITION BY folder_id ORDER BY ready DESC, n DESC, size_bytes DESC, file_id) AS INTEGER) AS rank, file_id FROM (SELECT f.*, c.n, len(topics) = 5 AS ready FROM files f JOIN c USING (file_id) JOIN (SELECT file_id, topics FROM insights) USING (file_id) WHERE index_status = 'INDEXED') QUALIFY rank <= 5""",
)
def representative_files(spark, sf):
    return S.representative_files(files(spark, sf), topics(spark, sf).filter("size(topics) = 5"), lines(spark, sf))


@query("topic_intersection", f"WITH {TOPICS} SELECT a.file_id, coalesce(array_to_string(list_sort(list_intersect(a.topics, b.topics)), ','), '') AS shared FROM insights a JOIN insights b ON CAST(b.file_id AS BIGINT) = CAST(a.file_id AS BIGINT) + 1")
def topic_intersection(spark, sf):
    t = topics(spark, sf)
    nxt = t.select((F.col("file_id").cast("long") - 1).cast("string").alias("file_id"), F.col("topics").alias("other"))
    return t.join(nxt, "file_id").select("file_id", F.array_join(F.array_sort(F.array_intersect("topics", "other")), ",").alias("shared"))


@query("scan_difference", "SELECT o_custkey AS key FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def scan_difference(spark, sf):
    return table(spark, sf, "orders").select(F.col("o_custkey").alias("key")).subtract(table(spark, sf, "customer").filter("c_acctbal > 0").select("c_custkey"))


@query("page_union", "WITH p AS (SELECT o_custkey AS key, o_orderkey AS row_id, 1 AS page FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_custkey, o_orderkey, 2 FROM orders) SELECT key, min(page) AS page FROM p GROUP BY key")
def page_union(spark, sf):
    o = table(spark, sf, "orders")
    pages = o.filter("o_orderstatus = 'O'").select(F.col("o_custkey").alias("key"), F.lit(1).alias("page")).union(o.select("o_custkey", F.lit(2)))
    return S.page_union(pages, "key", "page").select("key", "page")
