"""Queries for scalar functions and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import filters
from corpusloom.plans.registry import query
from corpusloom.sources.tables import FILES, LINES, files, lines, messages, table

TRIM = "regexp_replace(regexp_replace({0}, '^\\s+', ''), '\\s+$', '')"


@query("tokenize", r"SELECT doc_id, len(w) AS n_tokens, sha256(array_to_string(w, ' ')) AS tokens_sha256 FROM (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM documents)")
def tokenize(spark, sf):
    w = table(spark, sf, "documents").select("doc_id", T.tokenize(F.col("text")).alias("w"))
    return w.select("doc_id", F.size("w").alias("n_tokens"), F.sha2(F.array_join("w", " "), 256).alias("tokens_sha256"))


@query(
    "normalize_query",
    r"""SELECT conv_id, turn, len(w) AS n_tokens, array_to_string(w, ' ') AS tokens FROM (SELECT conv_id, turn, (SELECT list(w ORDER BY i) FROM (
      SELECT min_by(w, i) AS w, min(i) AS i FROM (SELECT w, i FROM (SELECT regexp_replace(unnest(ws), '^[._/:-]+|[._/:-]+$', '', 'g') AS w, unnest(range(1, len(ws) + 1)) AS i) WHERE w <> '') GROUP BY lower(w))) AS w
      FROM (SELECT conv_id, turn, regexp_extract_all(text, '[\p{L}\p{N}_.:/-]+') AS ws FROM conversations))""",
)
def normalize_query(spark, sf):
    q = messages(spark, sf).select("conv_id", "turn", T.query_tokens(F.col("text")).alias("w"))
    return q.select("conv_id", "turn", F.size("w").alias("n_tokens"), F.array_join("w", " ").alias("tokens"))


TOKENS = r"regexp_extract_all(lower(strip_accents({})), '[\p{{L}}\p{{N}}]+')"


@query(
    "match_terms",
    rf"""WITH m AS (SELECT conv_id, turn, list_transform(regexp_extract_all(text, '"([^"]+)"', 1), lambda p: trim(p)) AS ph,
      list_distinct(list_filter(list_transform(regexp_extract_all(regexp_replace(text, '"[^"]+"', ' ', 'g'), '[\p{{L}}\p{{N}}_.:/-]+'), lambda w: lower(regexp_replace(w, '^[._/:-]+|[._/:-]+$', '', 'g'))), lambda w: w <> '')) AS ws FROM conversations WHERE role = 'user'),
    t AS (SELECT conv_id, turn, list_distinct(list_filter(list_concat(list_transform(ph, lambda p: {{'toks': {TOKENS.format('p')}, 'prefix': false}}),
      flatten(list_transform(ws, lambda w: CASE WHEN len({TOKENS.format('w')}) > 1
        THEN list_concat([{{'toks': {TOKENS.format('w')}, 'prefix': false}}], list_transform(list_filter({TOKENS.format('w')}, lambda p: length(p) >= 2), lambda p: {{'toks': [p], 'prefix': true}}))
        ELSE [{{'toks': {TOKENS.format('w')}, 'prefix': length(w) >= 2}}] END))), lambda t: len(t.toks) > 0)) AS terms FROM m)
    SELECT conv_id, turn, CAST(len(terms) AS INTEGER) AS n_terms, CAST(len(list_filter(terms, lambda t: t.prefix)) AS INTEGER) AS n_prefix FROM t""",
)
def match_terms(spark, sf):
    q = messages(spark, sf).filter("role = 'user'").select("conv_id", "turn", T.match_terms(F.col("text")).alias("terms"))
    return q.select("conv_id", "turn", F.size("terms").alias("n_terms"), F.size(F.filter("terms", lambda t: t["prefix"])).alias("n_prefix"))


@query("is_cjk", r"SELECT doc_id, regexp_matches(text, '[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}\x{20000}-\x{2A6DF}]') AS cjk FROM documents")
def is_cjk(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.is_cjk(F.col("text")).alias("cjk"))


@query("filename_stems", f"WITH {FILES} SELECT file_id, regexp_replace(filename, '\\.[^.]*$', '') AS direct_stem, split_part(filename, '.', 1) AS root_stem FROM files")
def filename_stems(spark, sf):
    direct, root = T.stems(F.col("filename"))
    return files(spark, sf).select("file_id", direct.alias("direct_stem"), root.alias("root_stem"))


@query(
    "filename_boost",
    f"""WITH {FILES}, q AS (SELECT concat('src', x, '_', y) AS q FROM range(0, 20) a(x), range(0, 50) b(y))
    SELECT file_id, q, 5.0::DOUBLE AS boost FROM files JOIN q ON q = regexp_replace(filename, '\\.[^.]*$', '')""",
)
def filename_boost(spark, sf):
    q = spark.range(20).select(F.explode(F.sequence(F.lit(0), F.lit(49))).alias("y"), F.col("id")).select(F.concat(F.lit("src"), F.col("id").cast("string"), F.lit("_"), F.col("y").cast("string")).alias("q"))
    f = files(spark, sf).withColumn("stem", T.stems(F.col("filename"))[0])
    return f.join(F.broadcast(q), F.col("stem") == F.col("q")).select("file_id", "q", T.filename_boost(F.col("q"), F.array("q"), F.col("filename")).alias("boost"))


@query("cosine_sim", "SELECT a.vec_id, round(greatest(-1.0, least(1.0, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 4) AS sim FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def cosine_sim(spark, sf):
    e = table(spark, sf, "embeddings")
    nxt = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(nxt, "vec_id").select("vec_id", T.cosine(F.col("embedding"), F.col("other")).alias("sim"))


@query("l2_normalize", "SELECT vec_id, round(embedding[1]::DOUBLE / greatest(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 1e-12), 6) AS first_value FROM embeddings")
def l2_normalize(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.round(T.l2_normalize(F.col("embedding"))[0], 6).alias("first_value"))


@query("sigmoid", "SELECT event_id, round(1 / (1 + exp(-(value - 10) / 10)), 6) AS p FROM events")
def sigmoid(spark, sf):
    return table(spark, sf, "events").select("event_id", T.sigmoid((F.col("value") - 10) / 10).alias("p"))


CJK_SQL = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{AC00}-\x{D7AF}]"


@query("token_count_chunk", f"WITH {LINES}, t AS (SELECT chunk_id, {TRIM.format('content')} AS c FROM lines) SELECT chunk_id, CASE WHEN c = '' THEN 0 ELSE greatest(1, length(regexp_replace(c, '[^' || '{CJK_SQL[1:]}', '', 'g')) + (length(regexp_replace(c, '{CJK_SQL}', '', 'g')) // 4)) END AS tokens FROM t")
def token_count_chunk(spark, sf):
    return lines(spark, sf).select("chunk_id", T.chunk_tokens(F.col("content")).alias("tokens"))


@query("token_count_budget", f"WITH {LINES}, t AS (SELECT chunk_id, {TRIM.format('content')} AS c FROM lines) SELECT chunk_id, CASE WHEN c = '' THEN 0 ELSE greatest(1, CAST(ceil(length(c) / 3.5::DOUBLE) AS BIGINT)) END AS tokens FROM t")
def token_count_budget(spark, sf):
    return lines(spark, sf).select("chunk_id", T.budget_tokens(F.col("content")).alias("tokens"))


@query("content_hash", f"SELECT doc_id, sha256({TRIM.format('text')}) AS hash FROM documents")
def content_hash(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query(
    "chunk_id",
    f"WITH {LINES} SELECT file_id, chunk_index, 'chk_' || left(sha256('[' || to_json(file_id) || ',null,' || to_json(folder_id) || ',' || chunk_index || ',' || to_json(sha256({TRIM.format('content')})) || ']'), 16) AS id FROM lines",
)
def chunk_id(spark, sf):
    c = lines(spark, sf)
    return c.select("file_id", "chunk_index", T.chunk_id(F.col("file_id"), F.lit(None).cast("string"), F.col("folder_id"), F.col("chunk_index"), T.content_hash(F.col("content"))).alias("id"))


@query("topic_key", r"SELECT page_id, trim(regexp_replace(lower(url), '\s+', ' ', 'g')) AS key FROM pages")
def topic_key(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.topic_key(F.col("url")).alias("key"))


@query(
    "topic_evidence",
    f"""WITH {LINES}, c AS (SELECT file_id, list(content ORDER BY chunk_index) AS cites FROM lines GROUP BY file_id)
    SELECT file_id, CASE WHEN len(k) = 0 THEN len(cites) ELSE len(k) END AS n FROM (SELECT file_id, cites, list_filter(cites, lambda x: contains(lower(x), 'license') OR contains(lower(x), 'terms')) AS k FROM c)""",
)
def topic_evidence(spark, sf):
    c = lines(spark, sf).groupBy("file_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]).alias("cites"))
    return c.select("file_id", F.size(T.topic_evidence(F.lit("License  of Terms"), F.col("cites"))).alias("n"))


@query("format_timestamp", "SELECT event_id, CASE WHEN s >= 3600 THEN printf('%02d:%02d:%02d', s // 3600, s % 3600 // 60, s % 60) ELSE printf('%02d:%02d', s // 60, s % 60) END AS label FROM (SELECT event_id, CAST(floor(value * 100) AS BIGINT) AS s FROM events WHERE value >= 0)")
def format_timestamp(spark, sf):
    return table(spark, sf, "events").filter("value >= 0").select("event_id", T.format_timestamp(F.col("value") * 100).alias("label"))


@query("evidence_header", f"WITH {LINES} SELECT chunk_id, '[Source: ' || file_id || ' | Section: ' || folder_id || CASE WHEN chunk_index > 0 THEN ' | Page: ' || chunk_index ELSE '' END || ' | Lines: ' || chunk_index || '-' || (chunk_index + 1) || ']' AS header FROM lines")
def evidence_header(spark, sf):
    c, i = lines(spark, sf), F.col("chunk_index")
    return c.select("chunk_id", T.evidence_header(F.col("file_id"), F.col("folder_id"), F.when(i > 0, i), i, i + 1).alias("header"))


@query(
    "extract_citations",
    r"""SELECT conv_id, turn, list_distinct_in_order AS valid, unresolved FROM (SELECT conv_id, turn,
      (SELECT coalesce(array_to_string(list(n ORDER BY i), ','), '') FROM (SELECT n, min(i) AS i FROM (SELECT unnest(ns) AS n, unnest(range(len(ns))) AS i) GROUP BY n) WHERE n <= 3) AS list_distinct_in_order,
      (SELECT count(DISTINCT n) FROM (SELECT unnest(ns) AS n) WHERE n > 3) AS unresolved
      FROM (SELECT conv_id, turn, list_transform(regexp_extract_all(regexp_replace(text, '([a-z]+)\.', '\1 [e ' || (turn + 1) || '] [E0' || (length(text) % 5 + 1) || '].', 'g'), '\[[Ee]\s*(\d+)\]', 1), lambda x: CAST(x AS INTEGER)) AS ns FROM conversations))""",
)
def extract_citations(spark, sf):
    mark = F.concat(F.lit("$1 [e "), (F.col("turn") + 1).cast("string"), F.lit("] [E0"), (F.length("text") % 5 + 1).cast("string"), F.lit("]."))
    n = messages(spark, sf).select("conv_id", "turn", T.cited_numbers(F.regexp_replace(F.col("text"), F.lit(r"([a-z]+)\."), mark)).alias("n"))
    return n.select("conv_id", "turn", F.array_join(F.filter("n", lambda x: x <= 3), ",").alias("valid"), F.size(F.filter("n", lambda x: x > 3)).cast("long").alias("unresolved"))


def _whole_word(word: str) -> str:
    other = r"[^\p{L}\p{N}_]"
    return rf"CASE WHEN regexp_matches(low, '(?s)(^|{other}){word}({other}|$)') THEN length(regexp_extract(low, '(?s)^((?:.*?{other})??){word}(?:{other}|$)', 1)) + 1 END"


BLANKS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(28) || chr(29) || chr(30) || chr(31) || chr(133) || chr(160)"


@query(
    "snippet",
    f"""WITH d AS (SELECT doc_id, text, lower(text) AS low, length(text) AS n FROM documents),
    h AS (SELECT *, coalesce(least({_whole_word('license')}, {_whole_word('the')}), least(nullif(instr(low, 'license'), 0), nullif(instr(low, 'the'), 0)), 1) AS hit FROM d),
    c AS (SELECT *, greatest(1, least(hit - 120, n - 239)) AS start FROM h)
    SELECT doc_id, CASE WHEN n <= 240 THEN trim(text, {BLANKS}) ELSE CASE WHEN start > 1 THEN '...' ELSE '' END || trim(substr(text, start, 240), {BLANKS}) || CASE WHEN start + 239 < n THEN '...' ELSE '' END END AS snippet FROM c""",
)
def snippet(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.snippet(F.col("text"), F.array(F.lit("license"), F.lit("the"))).alias("snippet"))


@query("hydrate_metadata", "SELECT event_id, coalesce(json_extract_string(props, '$.media_type'), 'document') AS media_type, json_extract_string(props, '$.k') AS k FROM events")
def hydrate_metadata(spark, sf):
    m = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", F.coalesce(F.try_element_at(m, F.lit("media_type")), F.lit("document")).alias("media_type"), F.try_element_at(m, F.lit("k")).alias("k"))


@query("parse_answer_json", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN concat('no json ', event_id) ELSE event_type END AS summary, CASE WHEN event_id % 3 = 0 THEN 0 ELSE 2 END AS n_topics FROM events")
def parse_answer_json(spark, sf):
    body = F.concat(F.lit('```json\n{"summary": "'), F.col("event_type"), F.lit('", "topics": ["a", "b"]}\n```'))
    answer = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("no json "), F.col("event_id").cast("string"))).when(F.col("event_id") % 3 == 1, body).otherwise(F.concat(F.lit("Here it is: "), body, F.lit(" Done.")))
    a = table(spark, sf, "events").select("event_id", T.parse_answer(answer).alias("a"))
    return a.select("event_id", "a.summary", F.size("a.topics").alias("n_topics"))


@query("path_parts", f"WITH {FILES} SELECT file_id, path, filename AS name, regexp_replace(path, '/[^/]*$', '') AS folder, extension FROM files")
def path_parts(spark, sf):
    parts = T.path_parts(F.replace("path", F.lit("/"), F.lit("\\")))
    return files(spark, sf).select("file_id", *[c.alias(n) for n, c in parts.items()])


@query("patterns_canonical", "SELECT event_id, CASE WHEN event_id % 4 = 3 THEN event_type ELSE event_type || ';*.log' END AS patterns FROM events")
def patterns_canonical(spark, sf):
    e, kind = F.col("event_type"), F.col("event_id") % 4
    raw = F.when(kind == 0, F.concat(F.lit('["'), e, F.lit('", "*.log"]'))).when(kind == 1, F.concat(F.lit('"[\\"'), e, F.lit('\\", \\"*.log\\"]"'))).when(kind == 2, F.concat(e, F.lit(", *.log"))).otherwise(e)
    return table(spark, sf, "events").select("event_id", F.array_join(T.string_list(raw), ";").alias("patterns"))


@query("nomic_prefix", "SELECT item_id, 'search_query: ' || text AS text FROM benchmark")
def nomic_prefix(spark, sf):
    once = T.with_prefix(F.col("text"), "search_query: ")
    return table(spark, sf, "benchmark").select("item_id", T.with_prefix(once, "search_query: ").alias("text"))


@query("redact_secrets", r"""SELECT doc_id, regexp_replace(regexp_replace(text, '((?:api[_-]?key|password|secret|token)\s*[:=]\s*[''"]?)(?:[^\s,''"]+)([''"]?)', '\1[REDACTED]\2', 'gi'), '\bsk-[A-Za-z0-9_-]{16,}\b', 'sk-[REDACTED]', 'g') AS text FROM documents""")
def redact_secrets(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.redact_secrets(F.col("text")).alias("text"))


@query("chat_intent", f"""SELECT conv_id, turn, CASE WHEN trim(text) = '' OR regexp_matches(text, '{T.GREETING}') OR regexp_matches(text, '{T.CONVERSATIONAL}') THEN 'CONVERSATIONAL' WHEN regexp_matches(text, '{T.INVENTORY}') THEN 'METADATA_INVENTORY' ELSE 'GROUNDED_CONTENT' END AS intent FROM conversations""")
def chat_intent(spark, sf):
    return messages(spark, sf).select("conv_id", "turn", T.chat_intent(F.col("text")).alias("intent"))


@query("filename_intent", f"WITH {FILES} SELECT file_id, CASE WHEN extension = '.md' THEN filename END AS name FROM (SELECT file_id, concat(folder_id, '_', file_id, '.md') AS filename, CASE WHEN extension = '.en' THEN '.md' ELSE '' END AS extension FROM files)")
def filename_intent(spark, sf):
    name = F.concat("folder_id", F.lit("_"), "file_id", F.lit(".md"))
    asked = F.when(F.col("extension") == ".en", F.concat(F.lit(' "notes\\'), name, F.lit('" '))).otherwise(F.concat(F.lit("What is in "), name, F.lit("?")))
    return files(spark, sf).select("file_id", T.filename_intent(asked).alias("name"))


@query("path_in_root", f"WITH {FILES} SELECT file_id FROM files WHERE path = '/corpus/fr/src1' OR starts_with(path, '/corpus/fr/src1/')")
def path_in_root(spark, sf):
    return files(spark, sf).filter(T.path_in_root(F.col("path"), F.lit("/corpus/fr/src1"))).select("file_id")


@query("like_escape", f"WITH {FILES} SELECT file_id FROM files WHERE starts_with(filename, 'src1_')")
def like_escape(spark, sf):
    return files(spark, sf).filter(F.startswith("filename", F.lit("src1_"))).select("file_id")


@query("name_filter", f"WITH {FILES} SELECT file_id, filename FROM files WHERE contains(lower(filename), lower('SRC1_1'))")
def name_filter(spark, sf):
    return files(spark, sf).filter(F.contains(F.lower("filename"), F.lower(F.lit("SRC1_1")))).select("file_id", "filename")


@query("export_filename", r"SELECT page_id, replace(trim(regexp_replace(url, '[^\p{L}\p{N} _-]', '', 'g')), ' ', '_') AS name FROM pages")
def export_filename(spark, sf):
    return table(spark, sf, "pages").select("page_id", T.export_filename(F.col("url")).alias("name"))


@query(
    "table_to_markdown",
    "SELECT n_regionkey, '| key | name |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || n_nationkey || ' | ' || n_name || ' |', chr(10) ORDER BY n_nationkey) AS markdown FROM nation GROUP BY n_regionkey",
)
def table_to_markdown(spark, sf):
    n = table(spark, sf, "nation").groupBy("n_regionkey").agg(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("r"))
    rows = F.transform("r", lambda x: F.array(x["n_nationkey"].cast("string"), x["n_name"]))
    return n.select("n_regionkey", T.table_to_markdown(F.array(F.lit("key"), F.lit("name")), rows).alias("markdown"))


@query("scope_filter", f"WITH {FILES}, {LINES} SELECT chunk_id FROM lines WHERE extension = '.fr' AND file_id IN (SELECT file_id FROM files WHERE folder_id IN ('src1', 'src3', 'src5'))")
def scope_filter(spark, sf):
    return filters.in_scope(lines(spark, sf), extension="FR", file_id="99", file_ids=files(spark, sf).filter("folder_id in ('src1', 'src3', 'src5')")).select("chunk_id")


@query("status_filter", f"WITH {FILES} SELECT file_id, index_status NOT IN ('MISSING', 'FAILED', 'SKIPPED') AS lexical, index_status <> 'MISSING' AS dense FROM files")
def status_filter(spark, sf):
    return files(spark, sf).select("file_id", filters.visible("lexical").alias("lexical"), filters.visible("dense").alias("dense"))


@query("exclude_globs", f"WITH {FILES} SELECT file_id FROM files WHERE NOT contains(relative_path, '/src3/') AND NOT regexp_matches(filename, '^src1_.*\\.en$')")
def exclude_globs(spark, sf):
    return filters.not_excluded(files(spark, sf), ["SRC3/", "src1_*.EN"]).select("file_id")


@query("size_guard", f"WITH {FILES} SELECT file_id, CASE WHEN size_bytes > 20000 THEN 'SKIPPED' ELSE index_status END AS index_status, CASE WHEN size_bytes > 20000 THEN 'File size exceeds the limit' END AS indexing_error FROM files")
def size_guard(spark, sf):
    return filters.guard_size(files(spark, sf), 20000).select("file_id", "index_status", "indexing_error")


@query("file_search", f"WITH {FILES} SELECT file_id FROM files WHERE contains(filename, 'src1') AND contains(relative_path, 'fr/src')")
def file_search(spark, sf):
    return filters.search_files(files(spark, sf), "SRC1 fr/src").select("file_id")


@query(
    "filename_scope",
    f"WITH {FILES}, q AS (SELECT item_id, concat('src', item_id % 20, '_', item_id, '.en') AS name FROM benchmark) SELECT item_id, file_id FROM q JOIN files ON lower(filename) = lower(name)",
)
def filename_scope(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string"), F.lit("_"), F.col("item_id").cast("string"), F.lit(".en")).alias("name"))
    return filters.named_files(b, files(spark, sf), "item_id", "name")


@query("event_scope", """SELECT event_id, CASE WHEN s AND t THEN NULL WHEN t THEN 'DELETE' WHEN s THEN 'CREATE' WHEN user_id % 3 = 0 THEN 'RENAME' ELSE 'MOVE' END AS kind FROM (SELECT event_id, user_id, user_id % 5 = 0 AS s, event_id % 4 = 0 AS t FROM events)""")
def event_scope(spark, sf):
    e = table(spark, sf, "events")
    src = F.when(F.col("user_id") % 5 == 0, "/out/a/x").otherwise("/root/a/x")
    dst = F.when(F.col("event_id") % 4 == 0, "/out/b/x").when(F.col("user_id") % 3 == 0, "/root/a/y").otherwise("/root/b/x")
    return e.select("event_id", filters.move_kind(src, dst, ~T.path_in_root(src, F.lit("/root")), ~T.path_in_root(dst, F.lit("/root"))).alias("kind"))
