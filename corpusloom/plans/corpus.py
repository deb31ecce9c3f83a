"""Queries for snapshots, links, context and prompts."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import context as C
from corpusloom.operators import export, graph, search
from corpusloom.operators import lifecycle as L
from corpusloom.operators import summary as S
from corpusloom.plans import contexts as X
from corpusloom.plans import search as Q
from corpusloom.plans.registry import query
from corpusloom.sources.tables import FILES, LINES, TOPICS, files, lines, messages, table, topics

# a former snapshot: every third file is unknown, every fifth has another size, every seventh is gone from the scan
KNOWN = f"WITH {FILES}, k AS (SELECT file_id, path, size_bytes + CASE WHEN CAST(file_id AS BIGINT) % 5 = 0 THEN 1 ELSE 0 END AS size_bytes, modified_at, sha256, index_status FROM files WHERE CAST(file_id AS BIGINT) % 3 <> 0), s AS (SELECT file_id, path, size_bytes, modified_at FROM files WHERE CAST(file_id AS BIGINT) % 7 <> 0)"


def n(column="file_id"):
    return F.col(column).cast("long")


def known(spark, sf):
    f = files(spark, sf).filter(n() % 3 != 0)
    return f.withColumn("size_bytes", F.col("size_bytes") + F.when(n() % 5 == 0, 1).otherwise(0)).withColumn("parser_version", F.lit("1")).withColumn("chunker_version", F.lit("1"))


def scanned(spark, sf):
    return files(spark, sf).filter(n() % 7 != 0)


@query("change_detection", f"{KNOWN} SELECT path, CASE WHEN s.path IS NULL THEN 'STALE' WHEN s.size_bytes > 30000 THEN 'SKIPPED' WHEN k.path IS NULL THEN 'NEW' WHEN s.size_bytes = k.size_bytes THEN 'UNCHANGED' ELSE 'MODIFIED' END AS change FROM s FULL JOIN k USING (path)")
def change_detection(spark, sf):
    return L.change_detection(scanned(spark, sf), known(spark, sf), most=30000)


@query("offline_deletes", f"{KNOWN} SELECT file_id FROM k WHERE path NOT IN (SELECT path FROM s)")
def offline_deletes(spark, sf):
    return L.offline_deletes(known(spark, sf), scanned(spark, sf)).select("file_id")


@query(
    "upsert_files",
    f"{KNOWN} SELECT path, coalesce(k.file_id, s.file_id) AS file_id, coalesce(s.size_bytes, k.size_bytes) AS size_bytes, k.sha256, CASE WHEN s.path IS NOT NULL THEN 'INDEXED' ELSE k.index_status END AS index_status FROM s FULL JOIN k USING (path)",
)
def upsert_files(spark, sf):
    add = lambda df: df.withColumn("indexing_error", F.lit(None).cast("string")).withColumn("indexed_at", F.lit(None).cast("timestamp"))
    new = add(scanned(spark, sf)).withColumn("sha256", F.lit(None).cast("string")).withColumn("index_status", F.lit("INDEXED"))
    return L.upsert_files(add(known(spark, sf)), new).select("path", "file_id", "size_bytes", "sha256", "index_status")


@query("subtree_join", f"WITH {FILES} SELECT file_id, d AS folder FROM files JOIN (SELECT '/corpus/fr' AS d UNION SELECT '/corpus/de/src3') ON starts_with(path, d || '/')")
def subtree_join(spark, sf):
    return L.subtree(files(spark, sf), S.values(spark, "folder", ["/corpus/fr", "/corpus/de/src3"])).select("file_id", "folder")


@query("apply_renames", f"WITH {FILES} SELECT file_id, CASE WHEN starts_with(path, '/corpus/fr/src1/') THEN '/old' || substring(path, 16) WHEN starts_with(path, '/corpus/fr/') THEN '/corpus/gallic' || substring(path, 11) ELSE path END AS new_path FROM files")
def apply_renames(spark, sf):
    r = spark.range(1).select(F.inline(F.array(F.struct(F.lit("/corpus/fr").alias("folder"), F.lit("/corpus/gallic").alias("new_folder")), F.struct(F.lit("/corpus/fr/src1").alias("folder"), F.lit("/old").alias("new_folder")))))
    return L.apply_renames(files(spark, sf), r).select("file_id", "new_path")


@query("reindex_plan", f"WITH {FILES} SELECT file_id, NOT (CAST(file_id AS BIGINT) % 4 <> 0 AND extension <> '.es') AS reparse FROM files")
def reindex_plan(spark, sf):
    f = files(spark, sf)
    c = f.select("file_id", F.lit(0).alias("chunk_index"), F.when(n() % 4 == 0, "gone").otherwise(F.col("sha256")).alias("source_sha256"), F.when(F.col("extension") == ".es", "1").otherwise("2").alias("parser_version"), F.lit("1").alias("chunker_version"))
    return L.reindex_plan(f, c, "2", "1")


@query("vector_lineage", "SELECT CAST(label AS VARCHAR) AS label, CAST(len(embedding) AS VARCHAR) AS dimension, count(*) AS n FROM embeddings WHERE NOT (label = 2 AND len(embedding) = 64) GROUP BY 1, 2")
def vector_lineage(spark, sf):
    v = table(spark, sf, "embeddings").select(F.col("label").cast("string").alias("label"), F.size("embedding").cast("string").alias("dimension"))
    return L.vector_lineage(v, {"label": "2", "dimension": "64"})


@query("cascade_delete", "SELECT 'orders' AS name, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) UNION ALL SELECT 'customer', count(*) FROM customer WHERE c_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(spark, sf):
    c = table(spark, sf, "customer").withColumnRenamed("c_custkey", "key")
    left = L.cascade_delete({"orders": table(spark, sf, "orders").withColumnRenamed("o_custkey", "key"), "customer": c}, c.filter("c_acctbal < 0"), "key")
    counts = [t.agg(F.lit(name).alias("name"), F.count(F.lit(1)).alias("n")) for name, t in left.items()]
    return counts[0].union(counts[1])


@query("orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def orphans(spark, sf):
    return L.orphans(table(spark, sf, "documents"), table(spark, sf, "labels"), "doc_id").select("doc_id")


@query("root_overlap", f"WITH {FILES}, r AS (SELECT DISTINCT '/corpus' || CASE WHEN CAST(file_id AS BIGINT) % 2 = 0 THEN '/' || split_part(relative_path, '/', 1) ELSE '/' || split_part(relative_path, '/', 1) || '/' || folder_id END AS root FROM files) SELECT a.root, b.root AS inside FROM r a JOIN r b ON starts_with(b.root, a.root || '/')")
def root_overlap(spark, sf):
    part = F.split("relative_path", "/")[0]
    r = files(spark, sf).select(F.when(n() % 2 == 0, F.concat(F.lit("/corpus/"), part)).otherwise(F.concat(F.lit("/corpus/"), part, F.lit("/"), "folder_id")).alias("root")).distinct()
    return L.root_overlap(r)


@query("insight_freshness", f"WITH {FILES} SELECT file_id, CASE WHEN CAST(file_id AS BIGINT) % 4 = 0 OR extension = '.es' THEN 'STALE' ELSE 'READY' END AS freshness FROM files")
def insight_freshness(spark, sf):
    f = files(spark, sf)
    i = f.select("file_id", F.when(n() % 4 == 0, "gone").otherwise(F.col("sha256")).alias("content_hash"), F.when(F.col("extension") == ".es", "old").otherwise("m").alias("model_name"), F.lit("1").alias("parser_version"))
    return L.insight_freshness(i, f, model="m", parser="1")


@query("citation_integrity", f"WITH {LINES} SELECT chunk_id FROM lines WHERE chunk_index < 2 AND length(content) % 3 <> 0")
def citation_integrity(spark, sf):
    c = lines(spark, sf).withColumn("content_hash", T.content_hash(F.col("content")))
    cited = c.filter("chunk_index < 2").withColumn("content_hash", F.when(F.length("content") % 3 == 0, "gone").otherwise(F.col("content_hash"))).select("chunk_id", "file_id", "content_hash")
    return L.citation_integrity(cited, c).select("chunk_id")


@query("insight_semi", f"WITH {FILES}, {TOPICS} SELECT file_id FROM files WHERE index_status = 'INDEXED' AND file_id IN (SELECT file_id FROM insights WHERE len(topics) >= 3)")
def insight_semi(spark, sf):
    return files(spark, sf).filter("index_status = 'INDEXED'").join(topics(spark, sf).filter("size(topics) >= 3"), "file_id", "left_semi").select("file_id")


SHARED = f"WITH {TOPICS}, t AS (SELECT DISTINCT file_id, unnest(topics) AS topic_key FROM insights), st AS (SELECT a.file_id, b.file_id AS other_id, a.topic_key FROM t a JOIN t b USING (topic_key) WHERE CAST(a.file_id AS BIGINT) % 50 = 0 AND a.file_id <> b.file_id)"


def requested(spark, sf):
    return files(spark, sf).filter(n() % 50 == 0).select("file_id")


@query("shared_topics", f"{SHARED} SELECT * FROM st")
def shared_topics(spark, sf):
    return graph.shared_topics(requested(spark, sf), topics(spark, sf))


def naming_chunks(spark, sf):
    """lines, each with the name of the file whose id follows at its end; every third by relative path."""
    f = files(spark, sf)
    named = f.select((n() - 1).cast("string").alias("file_id"), F.when(n() % 3 == 0, F.col("relative_path")).otherwise(F.col("filename")).alias("name"))
    return lines(spark, sf).join(named, "file_id").withColumn("content", F.concat("content", F.lit(" See "), "name", F.lit(", please.")))


REFERENCES = f"{FILES}, {LINES}, x AS (SELECT CAST(CAST(file_id AS BIGINT) - 1 AS VARCHAR) AS file_id, file_id AS target_id, CASE WHEN CAST(file_id AS BIGINT) % 3 = 0 THEN 'path' ELSE 'filename' END AS by FROM files), rf AS (SELECT DISTINCT x.*, x.file_id || ':0' AS chunk_id FROM x JOIN lines USING (file_id))"


@query("file_references", f"WITH {REFERENCES} SELECT * FROM rf")
def file_references(spark, sf):
    return graph.file_references(naming_chunks(spark, sf), files(spark, sf))


@query("file_edges", f"{SHARED}, {REFERENCES} SELECT file_id, other_id AS target_id, 'shared_topic' AS kind, topic_key AS label FROM st UNION ALL SELECT file_id, target_id, 'reference', rf.by FROM rf")
def file_edges(spark, sf):
    return graph.file_edges(shared_topics(spark, sf), file_references(spark, sf))


@query("edge_order", f"{SHARED}, {REFERENCES}, e AS (SELECT file_id, other_id AS target_id, 'shared_topic' AS kind, topic_key AS label FROM st UNION ALL SELECT file_id, target_id, 'reference', rf.by FROM rf) SELECT file_id, kind, label, target_id, CAST(row_number() OVER (PARTITION BY file_id ORDER BY kind, target_id, lower(label)) AS INTEGER) AS place FROM e")
def edge_order(spark, sf):
    asked = requested(spark, sf)
    found = graph.edge_order(asked, graph.shared_topics_in_order(asked, topics(spark, sf)), file_references(spark, sf))
    return found.select("file_id", "kind", "label", "target_id", "place")


HEADED = "headed AS (SELECT *, 'Part ' || (chunk_index // 4) AS section, row_number() OVER (PARTITION BY file_id ORDER BY chunk_index) - 1 AS place, count(*) OVER (PARTITION BY file_id) AS total FROM lines)"
SYNTHETIC = rf"""{FILES}, {LINES}, {HEADED},
  sampled AS (SELECT file_id, section, min(place) AS place FROM headed WHERE total <= 15 OR place < 5 OR place BETWEEN total // 2 - 3 AND total // 2 + 2 OR place >= total - 5 GROUP BY file_id, section),
  hs AS (SELECT file_id, string_agg(section, ' ' ORDER BY place) AS headings FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY place) AS r FROM sampled) WHERE r <= 6 GROUP BY file_id),
  snip AS (SELECT file_id, place, left(trim(regexp_replace(content, '\s+', ' ', 'g')), 140) AS t FROM headed WHERE place < 2 OR (total > 4 AND place = total // 2)),
  ts AS (SELECT file_id, string_agg(t, ' ' ORDER BY place) AS texts FROM snip WHERE t <> '' GROUP BY file_id),
  whole AS (SELECT file_id, trim(concat_ws(' ', translate(regexp_replace(filename, '\.[^.]*$', ''), '_-', '  '), headings, texts)) AS q FROM files JOIN hs USING (file_id) LEFT JOIN ts USING (file_id)),
  synthetic AS (SELECT file_id AS query_id, trim(CASE WHEN length(q) <= 400 THEN q ELSE regexp_replace(left(q, 400), ' [^ ]*$', '') END) AS query FROM whole)"""


def headed(spark, sf):
    """lines, four of which stand under one heading."""
    return lines(spark, sf).withColumn("section", F.concat(F.lit("Part "), F.floor(F.col("chunk_index") / 4).cast("string")))


@query("synthetic_query", f"WITH {SYNTHETIC} SELECT query_id, query FROM synthetic")
def synthetic_query(spark, sf):
    return graph.synthetic_queries(headed(spark, sf), files(spark, sf))


@query(
    "related_files",
    rf"""WITH {SYNTHETIC}, q AS (SELECT query_id, regexp_extract_all(lower(strip_accents(query)), '[\p{{L}}\p{{N}}]+') AS ws, embedding FROM synthetic LEFT JOIN embeddings ON vec_id = query_id::BIGINT),
  qt AS (SELECT DISTINCT query_id, 0 AS nt, unnest(ws) AS term FROM q),
  tok AS (SELECT chunk_id, len(w) AS len, unnest(w) AS term FROM (SELECT chunk_id, regexp_extract_all(lower(strip_accents(content)), '[\p{{L}}\p{{N}}]+') AS w FROM lines)),
  tf AS (SELECT chunk_id, len, term, 5.0::DOUBLE * count(*) AS f FROM tok GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  st AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(strip_accents(content)), '[\p{{L}}\p{{N}}]+'))) AS a FROM lines),
  {Q.SCORED.format(having='true', k=60)},
  sim AS (SELECT q.query_id, e.vec_id || ':0' AS chunk_id, round(greatest(-1.0, least(1.0, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 4) AS score FROM q, embeddings e WHERE q.embedding IS NOT NULL AND e.vec_id IN (SELECT doc_id FROM documents)),
  den AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sim QUALIFY rank <= 60), {Q.FUSED},
  hit AS (SELECT o.query_id AS file_id, l.file_id AS related_id, o.chunk_id, rrf_score, row_number() OVER (PARTITION BY o.query_id, l.file_id ORDER BY rrf_score DESC, o.chunk_id) AS place FROM ordered o JOIN lines l USING (chunk_id) WHERE o.rank <= 30 AND o.query_id <> l.file_id),
  g AS (SELECT file_id, related_id, max(rrf_score) AS score, count(*) AS hits, arg_min(chunk_id, place) AS best_chunk, coalesce(list(chunk_id ORDER BY place) FILTER (place IN (2, 3)), []) AS supporting FROM hit GROUP BY file_id, related_id)
  SELECT *, CAST(row_number() OVER (PARTITION BY file_id ORDER BY score DESC, hits DESC, related_id) AS INTEGER) AS rank FROM g QUALIFY rank <= 5""".replace("hit AS (SELECT query_id, nt", "scored AS (SELECT query_id, nt").replace("FROM hit GROUP BY query_id, nt", "FROM scored GROUP BY query_id, nt"),
)
def related_files(spark, sf):
    """Related files of every file among all: by words, and by the vectors of their first lines."""
    c = headed(spark, sf).select("file_id", "chunk_id", "content")
    v = table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("file_id"), "embedding")
    q = graph.synthetic_queries(headed(spark, sf), files(spark, sf))
    q = q.join(v.withColumnRenamed("file_id", "query_id"), "query_id", "left")
    near = v.join(files(spark, sf).select("file_id"), "file_id").select(F.concat("file_id", F.lit(":0")).alias("chunk_id"), "embedding")
    return graph.related_files(search.hybrid_search(q, c, near, top_k=30, match="any"), c)


@query("match_explanation", f"{Q.POOL}, g AS (SELECT query_id, source, count(*) AS hits, 'doc ' || arg_min(chunk_id, rank) AS heading FROM ordered JOIN documents ON doc_id = chunk_id GROUP BY ALL) SELECT query_id, source, 'Matched ' || hits || CASE WHEN hits = 1 THEN ' section' ELSE ' sections' END || ' including ''' || heading || '''' AS explanation FROM g")
def match_explanation(spark, sf):
    found = search.fuse(Q.lexical(spark, sf), Q.dense(spark, sf), 1_000_000).join(table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id")
    g = found.groupBy("query_id", "source").agg(F.count(F.lit(1)).alias("hits"), F.concat(F.lit("doc "), F.min_by("chunk_id", "rank").cast("string")).alias("heading"))
    return g.select("query_id", "source", graph.explain_match("hits", "heading").alias("explanation"))


def candidates(spark, sf):
    """What the stated queries find among all documents: a pool of 50 each, with texts."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return docs.join(Q.lexical(spark, sf), "chunk_id").select("query_id", "rank", "chunk_id", "content")


@query("build_context", f"WITH RECURSIVE {Q.lex_cte('true', 50)}, cand AS (SELECT query_id, rank, chunk_id, {X.TOKENS.format('text')} AS tokens FROM lex JOIN documents ON doc_id = chunk_id), {X.FOLD.format(evidence=2596, chunks=20)} SELECT * FROM filled")
def build_context(spark, sf):
    c = C.build_context(candidates(spark, sf))
    return c.select("query_id", "status", "used", F.size("included").alias("n_included"), F.array_join(F.transform("omitted", lambda o: F.concat(o["chunk_id"].cast("string"), F.lit(":"), o["reason"])), ",").alias("omitted"))


@query("budget_for_model", "SELECT event_id, CASE event_type WHEN 'view' THEN 5892 WHEN 'click' THEN 6392 WHEN 'error' THEN 1048 ELSE 2596 END AS evidence FROM events")
def budget_for_model(spark, sf):
    e = F.col("event_type")
    name = F.when(e == "view", "Qwen2.5:7b").when(e == "click", "llama3:8b").when(e == "error", "phi-mini").otherwise(e)
    return table(spark, sf, "events").select("event_id", C.budget_for_model(name)["evidence"].alias("evidence"))


PROMPT = r"""m AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back, CASE WHEN role = 'user' THEN 'User: ' ELSE 'Assistant: ' END || regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '') AS line FROM conversations QUALIFY back <= 6),
  u AS (SELECT *, sum(length(line)) OVER (PARTITION BY conv_id ORDER BY back) AS used FROM m WHERE trim(text) <> ''), h AS (SELECT conv_id AS query_id, string_agg(line, chr(10) ORDER BY turn) AS history FROM u WHERE used <= 3000 GROUP BY conv_id),
  e AS (SELECT query_id, string_agg('[E' || rank || '] [Source: ' || source || ']' || chr(10) || regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', ''), chr(10) || chr(10) ORDER BY rank) AS evidence,
    string_agg('E' || rank || '=' || chunk_id, ',' ORDER BY rank) AS citations FROM den JOIN documents ON doc_id = chunk_id GROUP BY query_id)
  SELECT query_id, '{i}' || chr(10) || chr(10) || CASE WHEN history IS NULL THEN '' ELSE '--- CONVERSATION HISTORY ---' || chr(10) || history || chr(10) || chr(10) END || '--- EVIDENCE ---' || chr(10) || chr(10) || coalesce(evidence, '[No evidence provided]')
    || chr(10) || chr(10) || '--- USER QUESTION ---' || chr(10) || chr(10) || array_to_string(ws, ' ') || chr(10) || chr(10) || '--- ANSWER ---' AS prompt, coalesce(citations, '') AS citations
  FROM q LEFT JOIN e USING (query_id) LEFT JOIN h USING (query_id) WHERE ws IS NOT NULL""".format(i=C.INSTRUCTIONS)


@query("build_prompts", f"WITH {Q.QUERIES}, {Q.SIM.format(k=3)}, {PROMPT}")
def build_prompts(spark, sf):
    """A prompt for each stated text, with the nearest documents of those that have a vector, and the history of the conversation with the query's number."""
    none = F.lit(None).cast("string")
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), T.evidence_header(F.col("source"), none, none, none, none).alias("header"))
    e = docs.join(search.small(Q.dense(spark, sf, 3)), "chunk_id").select("query_id", "rank", "chunk_id", "header", "content")
    history = S.history_window(messages(spark, sf)).withColumnRenamed("conv_id", "query_id")
    found = C.build_prompts(e, Q.text_queries(spark, sf), history)
    cited = F.transform(F.map_entries("citations"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string")))
    return found.select("query_id", "prompt", F.array_join(cited, ",").alias("citations"))


@query("export_search", f"WITH {Q.QUERIES}, {Q.SIM.format(k=3)} SELECT query_id, '# Search: ' || any_value(array_to_string(ws, ' ')) || chr(10) || chr(10) || string_agg('## ' || rank || '. ' || source || ' (score: ' || CASE WHEN rank = 3 THEN 'Unranked' ELSE printf('%.3f', score) END || ')' || chr(10) || chr(10) || left(text, 50), chr(10) || chr(10) ORDER BY rank) AS markdown FROM den JOIN documents ON doc_id = chunk_id JOIN q USING (query_id) WHERE ws IS NOT NULL GROUP BY query_id")
def export_search(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "source", F.substring("text", 1, 50).alias("snippet"))
    found = docs.join(search.small(Q.dense(spark, sf, 3)), "chunk_id").withColumn("score", F.when(F.col("rank") < 3, F.col("score")))
    return export.search_markdown(found, Q.text_queries(spark, sf), "score")


def groups(spark, sf):
    """Five files a group: those whose ids follow each other."""
    return files(spark, sf).select(F.floor(n() / 5).alias("group_id"), "file_id", "filename", "size_bytes", "index_status")


STRIDE = "(total <= {k} OR (place % (total // {k}) = 0 AND place // (total // {k}) < {k}))"


@query(
    "compare_files",
    f"WITH {FILES}, {LINES}, {TOPICS}, p AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY chunk_index) - 1 AS place, count(*) OVER (PARTITION BY file_id) AS total FROM lines), e AS (SELECT file_id, string_agg(chunk_id, ',' ORDER BY chunk_index) AS evidence FROM p WHERE {STRIDE.format(k=4)} GROUP BY file_id) SELECT CAST(file_id AS BIGINT) // 5 AS group_id, file_id, filename, size_bytes, coalesce(array_to_string(topics, ','), '') AS topics, evidence FROM files JOIN insights USING (file_id) JOIN e USING (file_id)",
)
def compare_files(spark, sf):
    e = S.strided(lines(spark, sf), 4).groupBy("file_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id"))), lambda x: x["chunk_id"]), ",").alias("evidence"))
    return groups(spark, sf).join(topics(spark, sf).select("file_id", F.array_join("topics", ",").alias("topics")), "file_id").join(e, "file_id").select("group_id", "file_id", "filename", "size_bytes", "topics", "evidence")


@query("synthesize_evidence", f"WITH {LINES}, p AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY chunk_index) - 1 AS place, count(*) OVER (PARTITION BY file_id) AS total FROM lines) SELECT CAST(file_id AS BIGINT) // 10 AS group_id, count(*) AS chunks, sum(length(content))::BIGINT AS chars FROM p WHERE {STRIDE.format(k=3)} GROUP BY ALL")
def synthesize_evidence(spark, sf):
    return S.strided(lines(spark, sf), 3).groupBy(F.floor(n() / 10).alias("group_id")).agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("content")).alias("chars"))


@query(
    "folder_evidence",
    f"""WITH {FILES}, {LINES}, {TOPICS}, c AS (SELECT file_id, count(*) AS n FROM lines GROUP BY file_id), r AS (SELECT f.folder_id, f.file_id, topics, row_number() OVER (PARTITION BY f.folder_id ORDER BY c.n DESC, size_bytes DESC, f.file_id) AS rank FROM files f JOIN c USING (file_id) JOIN insights i ON i.file_id = f.file_id WHERE index_status = 'INDEXED' QUALIFY rank <= 5)
    SELECT folder_id, file_id, 'summary' AS kind, coalesce(array_to_string(topics, ','), '') AS content FROM r UNION ALL SELECT r.folder_id, file_id, 'chunk', content FROM r JOIN (SELECT file_id, content FROM lines WHERE chunk_index < 2) USING (file_id)""",
)
def folder_evidence(spark, sf):
    c, t = lines(spark, sf), topics(spark, sf)
    r = S.representative_files(files(spark, sf), t, c).select("folder_id", "file_id")
    a = r.join(t.select("file_id", F.array_join("topics", ",").alias("content")), "file_id").select("folder_id", "file_id", F.lit("summary").alias("kind"), "content")
    b = r.join(S.first_n(c, "file_id", "chunk_index", 2).select("file_id", "content"), "file_id").select("folder_id", "file_id", F.lit("chunk").alias("kind"), "content")
    return a.unionByName(b)
