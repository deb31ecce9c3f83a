"""Queries for hash trees, mergeable statistics, validity, rules and evidence."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import export
from corpusloom.operators import ledger as L
from corpusloom.plans.registry import query
from corpusloom.sources.tables import FILES, LINES, TOPICS, files, lines, messages, topics


def n(column="file_id"):
    return F.col(column).cast("long")


TREE = """lf AS (SELECT folder_id, substr(md5(file_id), 1, 2) AS prefix, count(*) AS files, sha256(string_agg(file_id || ':' || {state} || ':' || size_bytes, '' ORDER BY file_id)) AS hash FROM files GROUP BY ALL),
  nd AS (SELECT folder_id, substr(prefix, 1, 1) AS prefix, sum(files)::BIGINT AS files, sha256(string_agg(hash, '' ORDER BY prefix)) AS hash FROM lf GROUP BY folder_id, substr(prefix, 1, 1)),
  rt AS (SELECT folder_id, '' AS prefix, sum(files)::BIGINT AS files, sha256(string_agg(hash, '' ORDER BY prefix)) AS hash FROM nd GROUP BY folder_id)"""


@query("hash_tree", f"WITH {FILES}, {TREE.format(state='sha256')} SELECT * FROM lf UNION ALL SELECT * FROM nd UNION ALL SELECT * FROM rt")
def hash_tree(spark, sf):
    return L.hash_tree(files(spark, sf), "sha256", "size_bytes")


@query("changed_leaves", f"WITH {FILES} SELECT DISTINCT folder_id, substr(md5(file_id), 1, 2) AS prefix FROM files WHERE CAST(file_id AS BIGINT) % 97 = 0")
def changed_leaves(spark, sf):
    """The leaves of the files that have another hash in a second snapshot."""
    f = files(spark, sf)
    later = f.withColumn("sha256", F.when(n() % 97 == 0, F.reverse("sha256")).otherwise(F.col("sha256")))
    return L.changed_leaves(L.hash_tree(f, "sha256", "size_bytes"), L.hash_tree(later, "sha256", "size_bytes"))


@query(
    "folder_validity",
    f"WITH {FILES}, {TREE.format(state='sha256')}, f AS (SELECT DISTINCT folder_id FROM files) SELECT folder_id, CASE WHEN md5(folder_id) < '4' THEN 'STALE' WHEN md5(folder_id) < '8' THEN 'FAILED' WHEN md5(folder_id) < 'a' THEN 'STALE' ELSE 'READY' END AS freshness FROM f",
)
def folder_validity(spark, sf):
    """Insights of folders: a quarter of them of another state, a quarter failed, some half made, the rest current."""
    tree, key = L.hash_tree(files(spark, sf), "sha256", "size_bytes"), F.md5("folder_id")
    i = tree.filter("prefix = ''").select("folder_id", F.when(key < "4", "gone").otherwise(F.col("hash")).alias("composite_hash"), F.when((key >= "4") & (key < "8"), "FAILED").when((key >= "8") & (key < "a"), "GENERATING").otherwise("READY").alias("status"), F.lit("m").alias("model_name"))
    return L.folder_validity(i, tree, model="m")


@query("intelligence_stats", f"WITH {FILES}, {LINES} SELECT (SELECT count(*) FROM lines) AS total_chunks, (SELECT count(DISTINCT file_id) FROM lines) AS files_with_chunks, count(*) FILTER (index_status = 'INDEXED') AS indexed_files, count(*) FILTER (index_status = 'QUEUED') AS queued_files, count(*) FILTER (index_status = 'FAILED') AS failed_files, count(*) FILTER (index_status = 'SKIPPED') AS skipped_files FROM files")
def intelligence_stats(spark, sf):
    return L.intelligence_stats(files(spark, sf), lines(spark, sf))


@query("sketch_stats", f"WITH {LINES} SELECT folder_id, count(*) AS chunks, true AS files_near FROM lines GROUP BY folder_id")
def sketch_stats(spark, sf):
    """Statistics of folders from sketches of five increments, merged; whether the estimate of files is within five standard errors."""
    c = lines(spark, sf)
    parts = [L.chunk_sketches(c.filter(F.pmod(F.xxhash64("chunk_id"), F.lit(5)) == i)) for i in range(5)]
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    found = L.sketch_stats(L.merged_sketches(union, "folder_id"), "folder_id")
    exact = c.groupBy("folder_id").agg(F.countDistinct("file_id").alias("exact"))
    return found.join(exact, "folder_id").select("folder_id", "chunks", (F.abs(F.col("files") - F.col("exact")) <= F.greatest(F.lit(1.0), 0.05 * F.col("exact"))).alias("files_near"))


@query(
    "insight_validity",
    f"""WITH {FILES}, x AS (SELECT file_id, CAST(file_id AS BIGINT) % 11 AS k FROM files)
    SELECT file_id, CASE WHEN k IN (0, 1, 2, 3, 4, 5, 6) THEN 'STALE' ELSE 'READY' END AS freshness, CASE k WHEN 0 THEN 'status' WHEN 1 THEN 'content' WHEN 2 THEN 'chunks' WHEN 3 THEN 'model' WHEN 4 THEN 'parser' WHEN 5 THEN 'chunker' WHEN 6 THEN 'chunks' END AS reason FROM x""",
)
def insight_validity(spark, sf):
    """An insight of each file, of which some have another status, hash, model, parser or chunker, or have lost their chunks."""
    f, k = files(spark, sf), n() % 11
    i = f.select(
        "file_id", F.when(k == 0, "FAILED").otherwise("READY").alias("status"), F.when(k == 1, "gone").otherwise(F.col("sha256")).alias("content_hash"), F.when(k == 3, "old").otherwise("m").alias("model_name"),
        F.when(k == 4, "0").when(k.isin(2, 7), "unknown").otherwise("1").alias("parser_version"), F.when(k == 5, "0").otherwise("1").alias("chunker_version"), F.when(k == 2, F.array(F.lit("c"))).otherwise(F.array().cast("array<string>")).alias("citations"),
    )
    c = lines(spark, sf).filter(~k.isin(2, 6, 7)).select("file_id", "chunk_index", F.lit("1").alias("parser_version"), F.when(k == 8, "").otherwise("1").alias("chunker_version"))
    return L.insight_validity(i, f, c, model="m")


@query(
    "folder_rules",
    f"""WITH {FILES} SELECT file_id FROM files WHERE NOT (folder_id = 'src3' AND regexp_matches(filename, '^.*\\.en$')) AND NOT (folder_id = 'src5' AND contains('/' || relative_path, '/fr/')) AND NOT regexp_matches(filename, '^src._.7\\..*$')
    AND NOT (folder_id = 'src7' AND regexp_matches(relative_path, '^de/.*$'))""",
)
def folder_rules(spark, sf):
    """Files by the rules of their folders: an extension, a folder's name, a path; and one rule of all folders."""
    given = [("src3", "*.EN"), ("src5", "FR/"), (None, "src?_?7.*"), ("src7", "de\\*"), ("src9", " "), ("elsewhere", "*")]
    rules = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(f).cast("string").alias("folder_id"), F.lit(p).alias("pattern")) for f, p in given])))
    return L.apply_rules(files(spark, sf), rules).select("file_id")


@query("inventory_files", f"WITH {FILES} SELECT folder_id, CAST(row_number() OVER w AS INTEGER) AS place, filename, extension, CASE WHEN size_bytes < 1048576 THEN printf('%.1f', round(size_bytes / 1024.0::DOUBLE, 1)) || ' KB' ELSE printf('%.2f', round(size_bytes / 1048576.0::DOUBLE, 2)) || ' MB' END AS size, index_status FROM files WINDOW w AS (PARTITION BY folder_id ORDER BY modified_at DESC, file_id) QUALIFY place <= 25")
def inventory_files(spark, sf):
    return L.inventory_files(files(spark, sf))


@query(
    "topic_evidence_edges",
    f"""WITH {TOPICS}, {LINES}, t AS (SELECT DISTINCT file_id, unnest(topics) AS topic_key FROM insights), c AS (SELECT file_id, list({{'i': chunk_index, 'x': content}} ORDER BY chunk_index) AS cites FROM lines WHERE chunk_index < 8 GROUP BY file_id),
    e AS (SELECT file_id, topic_key, CASE WHEN len(k) = 0 THEN cites ELSE k END AS ev FROM (SELECT t.file_id, topic_key, cites, list_filter(cites, lambda x: contains(lower(x.x), topic_key)) AS k FROM t JOIN c USING (file_id)))
    SELECT a.file_id, b.file_id AS other_id, a.topic_key, array_to_string(list_transform(a.ev, lambda x: a.file_id || ':' || x.i), ',') AS source_evidence, array_to_string(list_transform(b.ev, lambda x: b.file_id || ':' || x.i), ',') AS target_evidence
    FROM e a JOIN e b USING (topic_key) WHERE CAST(a.file_id AS BIGINT) % 50 = 0 AND a.file_id <> b.file_id""",
)
def topic_evidence_edges(spark, sf):
    """Links by topics of the stated files, with the citing chunks of both sides: the first eight of a file are its citations."""
    cites = lines(spark, sf).filter("chunk_index < 8").groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct("chunk_index", "chunk_id", F.col("content").alias("text")))).alias("citations"))
    found = L.topic_evidence_edges(files(spark, sf).filter(n() % 50 == 0), topics(spark, sf).join(cites, "file_id"))
    ids = lambda c: F.array_join(F.transform(c, lambda x: x["chunk_id"]), ",").alias(c)
    return found.select("file_id", "other_id", "topic_key", ids("source_evidence"), ids("target_evidence"))


NOTES = """m AS (SELECT conv_id, turn, role, text, CASE WHEN role <> 'user' AND turn % 3 <> 0 THEN turn END AS cited FROM conversations),
  p AS (SELECT conv_id, string_agg(upper(role) || ': ' || text || CASE WHEN cited IS NULL THEN '' ELSE ' [' || cited || ']' END, chr(10) || chr(10) ORDER BY turn) AS body, string_agg('[' || cited || '] file' || cited || '.md, Part ' || cited, chr(10) ORDER BY turn) FILTER (cited IS NOT NULL) AS notes FROM m GROUP BY conv_id)"""


@query("export_conversation_text", f"WITH {NOTES} SELECT conv_id, 'Conversation ' || conv_id || chr(10) || chr(10) || body || CASE WHEN notes IS NULL THEN '' ELSE chr(10) || chr(10) || 'Sources:' || chr(10) || notes END AS transcript FROM p")
def export_conversation_text(spark, sf):
    """Conversations as plain text, with the sources of the answers that cite one as footnotes."""
    turn = F.col("turn").cast("string")
    cite = F.struct(turn.alias("mark"), F.concat(F.lit("file"), turn, F.lit(".md")).alias("source_file"), F.concat(F.lit("Part "), turn).alias("section"))
    m = messages(spark, sf).withColumn("citations", F.when((F.col("role") != "user") & (F.col("turn") % 3 != 0), F.array(cite)).otherwise(F.array().cast("array<struct<mark:string,source_file:string,section:string>>")))
    return export.conversation_text(m, F.concat(F.lit("Conversation "), F.col("conv_id").cast("string")))


@query("export_conversation_json", "SELECT conv_id, count(*) AS n, sum(length(text))::BIGINT AS chars, string_agg(role, ',' ORDER BY turn) AS roles FROM conversations GROUP BY conv_id")
def export_conversation_json(spark, sf):
    """Conversations as JSON, read back."""
    j = export.conversation_json(messages(spark, sf))
    back = j.select(F.from_json("json", "conv_id long, messages array<struct<turn: long, role: string, text: string>>").alias("j"))
    m = F.col("j.messages")
    return back.select("j.conv_id", F.size(m).cast("long").alias("n"), F.aggregate(m, F.lit(0).cast("long"), lambda s, x: s + F.length(x["text"])).alias("chars"), F.array_join(F.transform(m, lambda x: x["role"]), ",").alias("roles"))
