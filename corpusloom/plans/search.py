"""Queries for search: the documents are the chunks; every document and every vector whose id is divisible by 50 is a query."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import search as S
from corpusloom.plans.registry import query
from corpusloom.sources.tables import files, lines, FILES, LINES, table

K = 10
TOKENS = r"tok AS (SELECT doc_id AS chunk_id, len(w) AS len, unnest(w) AS term FROM (SELECT doc_id, regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+') AS w FROM documents))"
STATS = f"""{TOKENS}, tf AS (SELECT chunk_id, len, term, 5.0::DOUBLE * count(*) AS f FROM tok GROUP BY ALL), dfs AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
  st AS (SELECT count(*) AS n, avg(len(regexp_extract_all(lower(strip_accents(text)), '[\\p{{L}}\\p{{N}}]+'))) AS a FROM documents)"""
SCORED = """hit AS (SELECT query_id, nt, chunk_id, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * len / a)) AS s
    FROM qt JOIN tf USING (term) JOIN dfs USING (term), st),
  lex0 AS (SELECT query_id, chunk_id, round(sum(s), 4) AS score FROM hit GROUP BY query_id, nt, chunk_id HAVING {having}),
  lex AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM lex0 QUALIFY rank <= {k})"""
#: Stated queries: the texts of the documents and the vectors whose ids are divisible by 50, joined in full: either may be missing.
QUERIES = r"""q AS (SELECT coalesce(doc_id, vec_id) AS query_id, ws, embedding FROM (SELECT doc_id, regexp_extract_all(lower(strip_accents(coalesce(text, ''))), '[\p{L}\p{N}]+') AS ws FROM documents WHERE doc_id % 50 = 0)
    FULL JOIN (SELECT vec_id, embedding FROM embeddings WHERE vec_id % 50 = 0) ON vec_id = doc_id),
  qt AS (SELECT DISTINCT query_id, 0 AS nt, unnest(ws) AS term FROM q)"""
BENCH = r"qt AS (SELECT DISTINCT item_id AS query_id, 0 AS nt, unnest(regexp_extract_all(lower(strip_accents(text)), '[\p{L}\p{N}]+')) AS term FROM benchmark)"
SIM = """sim AS (SELECT q.query_id, e.vec_id AS chunk_id, round(greatest(-1.0, least(1.0, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 4) AS score FROM q, embeddings e WHERE q.embedding IS NOT NULL),
  den AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sim QUALIFY rank <= {k})"""


def lex_cte(having: str, k: int) -> str:
    return f"{STATS}, {QUERIES}, {SCORED.format(having=having, k=k)}"


FUSED = """fused AS (SELECT query_id, chunk_id, l.rank AS lexical_rank, l.score AS lexical_score, d.rank AS dense_rank, d.score AS dense_score,
    round(coalesce(1.0::DOUBLE / (60 + l.rank), 0) + coalesce(1.0::DOUBLE / (60 + d.rank), 0), 6) AS rrf_score FROM lex l FULL JOIN den d USING (query_id, chunk_id)),
  ordered AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, coalesce(dense_score, 0) DESC, coalesce(lexical_score, 0) DESC, chunk_id) AS INTEGER) AS rank,
    'hybrid' AS method FROM fused)"""
POOL = f"WITH {lex_cte('true', 50)}, {SIM.format(k=50)}, {FUSED}"


def chunks(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def text_queries(spark, sf):
    """query_id, query: the words of the stated documents."""
    return table(spark, sf, "documents").filter("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), F.array_join(T.tokenize(F.col("text")), " ").alias("query"))


def vector_queries(spark, sf):
    """query_id, embedding: the stated vectors."""
    return vectors(spark, sf).filter("chunk_id % 50 = 0 and embedding is not null").withColumnRenamed("chunk_id", "query_id")


def stated_queries(spark, sf):
    """query_id, query (a document's words, null without one), embedding (null without one)."""
    return text_queries(spark, sf).join(vector_queries(spark, sf), "query_id", "full")


def bench_queries(spark, sf):
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def lexical(spark, sf, k=50):
    return S.lexical_search(text_queries(spark, sf), chunks(spark, sf), top_k=k, match="any")


def dense(spark, sf, k=50):
    return S.knn_join(vector_queries(spark, sf), vectors(spark, sf), top_k=k)


@query("bm25_stats", f"WITH {STATS}, {BENCH} SELECT term, df, n, round(a, 6) AS avg_len FROM (SELECT DISTINCT term FROM qt) JOIN dfs USING (term), st")
def bm25_stats(spark, sf):
    words = bench_queries(spark, sf).select(F.explode(T.tokenize(F.col("query"))).alias("term")).distinct()
    p = S.document_frequencies(chunks(spark, sf), words)
    whole = S.corpus_stats(chunks(spark, sf)).select(F.struct("n", "avg_len").alias("s")).scalar()
    return p.select("term", "df", whole["n"].alias("n"), F.round(whole["avg_len"], 6).alias("avg_len"))


@query("bm25_score", f"WITH {lex_cte('true', 1000000)} SELECT query_id, chunk_id, score FROM lex")
def bm25_score(spark, sf):
    found = S.lexical_search(text_queries(spark, sf), chunks(spark, sf), top_k=1_000_000, match="any")
    return found.select("query_id", "chunk_id", "score")


@query("bm25_topk", f"WITH {STATS}, {BENCH}, {SCORED.format(having='true', k=K)} SELECT query_id, rank, chunk_id, score FROM lex")
def bm25_topk(spark, sf):
    return S.lexical_search(bench_queries(spark, sf), chunks(spark, sf), top_k=K, match="any")


#: Chunks with three fields, and queries of three kinds: a phrase and the beginning of a word; a file's stem; two words of which the second is cut.
FIELDS = r"""fields AS (SELECT doc_id AS chunk_id, unnest(['content', 'section', 'source_file']) AS field, unnest([5.0::DOUBLE, 1.0, 15.0]) AS weight,
    unnest([coalesce(text, ''), source || ' ' || lang, concat(source, '_', doc_id, '.txt')]) AS body FROM documents),
  cut AS (SELECT chunk_id, field, weight, regexp_extract_all(lower(strip_accents(body)), '[\p{{L}}\p{{N}}]+') AS ws FROM fields),
  spot AS (SELECT chunk_id, field, weight, unnest(range(1, len(ws) + 1)) AS pos, unnest(ws) AS word FROM cut),
  size AS (SELECT chunk_id, sum(len(ws)) AS len FROM cut GROUP BY chunk_id), st AS (SELECT count(*) AS n, avg(len) AS a FROM size),
  asked AS (SELECT doc_id AS query_id, doc_id // 50 % {kinds} AS kind, source, lang, ws FROM (SELECT *, regexp_extract_all(lower(strip_accents(text)), '[\p{{L}}\p{{N}}]+') AS ws FROM documents WHERE doc_id % 50 = 0) WHERE len(ws) > 4),
  raw AS (SELECT query_id, kind, CASE kind WHEN 0 THEN '"' || ws[1] || ' ' || ws[2] || '" ' || left(ws[3], 3) WHEN 1 THEN source || '_' || query_id WHEN 2 THEN ws[4] || ' ' || left(ws[5], 2) ELSE source || '_' || query_id || '.txt' END AS query,
    CASE kind WHEN 0 THEN [{{'toks': ws[1:2], 'prefix': false}}, {{'toks': [left(ws[3], 3)], 'prefix': length(left(ws[3], 3)) >= 2}}]
      WHEN 2 THEN [{{'toks': [ws[4]], 'prefix': length(ws[4]) >= 2}}, {{'toks': [left(ws[5], 2)], 'prefix': length(left(ws[5], 2)) >= 2}}]
      ELSE [{{'toks': [source, query_id::VARCHAR], 'prefix': false}}, {{'toks': [source], 'prefix': true}}] || CASE WHEN query_id >= 10 THEN [{{'toks': [query_id::VARCHAR], 'prefix': true}}] ELSE [] END END AS terms FROM asked),
  term AS (SELECT query_id, kind, CASE WHEN kind = 3 THEN [{{'toks': [parts[1], parts[2], 'txt'], 'prefix': false}}] || terms[2:] || [{{'toks': ['txt'], 'prefix': true}}] ELSE list_distinct(terms) END AS terms FROM (SELECT *, terms[1].toks AS parts FROM raw)),
  each AS (SELECT query_id, kind, len(terms) AS nt, unnest(terms) AS t FROM term),
  met AS (SELECT query_id, nt, t, chunk_id, sum(weight) AS f FROM (
      SELECT query_id, nt, t, chunk_id, weight FROM each JOIN spot ON word = t.toks[1] WHERE len(t.toks) = 1 AND NOT t.prefix
      UNION ALL SELECT query_id, nt, t, s.chunk_id, s.weight FROM each JOIN spot s ON word = t.toks[1] JOIN cut USING (chunk_id, field) WHERE len(t.toks) > 1 AND ws[pos:pos + len(t.toks) - 1] = t.toks
      UNION ALL SELECT query_id, nt, t, chunk_id, weight FROM each JOIN (SELECT chunk_id, word, sum(weight) AS weight FROM spot GROUP BY ALL) ON starts_with(word, t.toks[1]) WHERE len(t.toks) = 1 AND t.prefix) GROUP BY ALL),
  often AS (SELECT query_id, t, count(*) AS df FROM met GROUP BY ALL),
  found AS (SELECT query_id, chunk_id, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - df + 0.5) / (df + 0.5)) END * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * len / a))), 4) AS score
    FROM met JOIN often USING (query_id, t) JOIN size USING (chunk_id), st GROUP BY query_id, nt, chunk_id HAVING count(*) = nt),
  scoped AS (SELECT query_id, chunk_id, score FROM found JOIN documents ON doc_id = chunk_id LEFT JOIN labels l ON l.doc_id = chunk_id WHERE lang = 'en' AND coalesce(quality, 1) <> 0 AND coalesce(toxic, 0) <> 1),
  first AS (SELECT query_id, chunk_id, round(score + CASE WHEN kind IN (1, 3) AND chunk_id = query_id THEN 5.0 ELSE 0 END, 4) AS score, kind
    FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS r FROM scoped) JOIN raw USING (query_id) WHERE r <= {fetch}),
  lexical AS (SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM first WHERE kind <> 3 OR chunk_id = query_id QUALIFY rank <= {k})"""


def field_chunks(spark, sf):
    name = F.concat("source", F.lit("_"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").cast("string").alias("file_id"), F.col("text").alias("content"), F.concat_ws(" ", "source", "lang").alias("section"), name.alias("source_file"))


def text_files(spark, sf):
    """files, with names that end in .txt."""
    f = files(spark, sf).withColumn("filename", F.concat("folder_id", F.lit("_"), "file_id", F.lit(".txt")))
    return f.withColumn("relative_path", F.concat("folder_id", F.lit("/"), "filename")).withColumn("path", F.concat(F.lit("/corpus/"), "relative_path"))


def kinds_of_queries(spark, sf, kinds):
    """query_id, query: the kinds of FIELDS in turn."""
    w = T.tokenize(F.col("text"))
    d = table(spark, sf, "documents").filter("doc_id % 50 = 0").withColumn("ws", w).filter("size(ws) > 4").withColumn("kind", F.floor(F.col("doc_id") / 50) % kinds)
    stem, word = F.concat("source", F.lit("_"), F.col("doc_id").cast("string")), lambda i: F.get("ws", F.lit(i))
    raw = F.when(F.col("kind") == 0, F.concat(F.lit('"'), word(0), F.lit(" "), word(1), F.lit('" '), F.left(word(2), F.lit(3)))).when(F.col("kind") == 1, stem)
    return d.select(F.col("doc_id").alias("query_id"), raw.when(F.col("kind") == 2, F.concat(word(3), F.lit(" "), F.left(word(4), F.lit(2)))).otherwise(F.concat(stem, F.lit(".txt"))).alias("query"))


@query("lexical_search", f"WITH {FIELDS.format(kinds=3, fetch=150, k=50)} SELECT query_id, rank, chunk_id, score AS lexical_score, 'bm25' AS method FROM lexical")
def lexical_search(spark, sf):
    """Phrases, prefixes and names over three weighted fields, in the visible English files, with the boost of names."""
    found = S.hybrid_search(kinds_of_queries(spark, sf, 3), field_chunks(spark, sf), None, files=text_files(spark, sf), mode="bm25", top_k=50, extension="en")
    return found.select("query_id", "rank", "chunk_id", "lexical_score", "method")


@query("knn_join", f"WITH {QUERIES}, {SIM.format(k=K)} SELECT query_id, rank, chunk_id, score FROM den")
def knn_join(spark, sf):
    return dense(spark, sf, K)


@query("knn_join_approx")
def knn_join_approx(spark, sf):
    return S.knn_join_approx(vector_queries(spark, sf), vectors(spark, sf), top_k=K)


@query("dense_search", f"WITH {QUERIES}, {SIM.format(k=1000000)}, r AS (SELECT d.*, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS r FROM den d JOIN embeddings e ON e.vec_id = d.chunk_id WHERE e.label = 2 QUALIFY r <= {K}) SELECT query_id, r AS rank, chunk_id, score FROM r")
def dense_search(spark, sf):
    scoped = table(spark, sf, "embeddings").filter("label = 2").select(F.col("vec_id").alias("chunk_id"), "embedding")
    return S.knn_join(vector_queries(spark, sf), scoped, top_k=K)


@query("rrf_join", f"{POOL} SELECT query_id, chunk_id, lexical_rank, lexical_score, dense_rank, dense_score FROM fused")
def rrf_join(spark, sf):
    return S.rrf_join(lexical(spark, sf), dense(spark, sf))


@query("rrf_score", f"{POOL} SELECT query_id, chunk_id, rrf_score FROM fused")
def rrf_score(spark, sf):
    return S.rrf_join(lexical(spark, sf), dense(spark, sf)).select("query_id", "chunk_id", S.rrf_score().alias("rrf_score"))


@query("candidate_union", f"{POOL} SELECT query_id, chunk_id FROM lex UNION SELECT query_id, chunk_id FROM den")
def candidate_union(spark, sf):
    return lexical(spark, sf).select("query_id", "chunk_id").union(dense(spark, sf).select("query_id", "chunk_id")).distinct()


@query("fusion_sort", f"{POOL} SELECT query_id, rank, chunk_id FROM ordered")
def fusion_sort(spark, sf):
    return S.fuse(lexical(spark, sf), dense(spark, sf), 1_000_000).select("query_id", "rank", "chunk_id")


HYBRID = f"""WITH {FIELDS.format(kinds=4, fetch=150, k=50)},
  sims AS (SELECT query_id, e.vec_id AS chunk_id, round(greatest(-1.0, least(1.0, list_cosine_similarity(v.embedding::DOUBLE[], e.embedding::DOUBLE[]))), 4) AS score
    FROM raw JOIN embeddings v ON v.vec_id = query_id, embeddings e JOIN documents d ON d.doc_id = e.vec_id WHERE d.lang = 'en' AND (kind <> 3 OR e.vec_id = query_id)),
  dense AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS INTEGER) AS rank FROM sims QUALIFY rank <= 50),
  joined AS (SELECT query_id, chunk_id, l.rank AS lexical_rank, l.score AS lexical_score, d.rank AS dense_rank, d.score AS dense_score FROM lexical l FULL JOIN dense d USING (query_id, chunk_id)),
  fused AS (SELECT joined.*, round(coalesce(1.0::DOUBLE / (60 + lexical_rank), 0) + coalesce(1.0::DOUBLE / (60 + dense_rank), 0) + CASE WHEN kind NOT IN (1, 3) OR chunk_id <> query_id THEN 0 WHEN lexical_rank <= 3 THEN 0.02 ELSE 0.005 END, 6) AS rrf_score FROM joined JOIN raw USING (query_id))
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, coalesce(dense_score, 0) DESC, coalesce(lexical_score, 0) DESC, chunk_id) AS INTEGER) AS rank, chunk_id, rrf_score, lexical_rank, lexical_score, dense_rank, dense_score, 'hybrid' AS method FROM fused QUALIFY rank <= {K}"""


@query("hybrid_search", HYBRID)
def hybrid_search(spark, sf):
    """Both arms in the visible English files, names among the queries."""
    q = kinds_of_queries(spark, sf, 4).join(vectors(spark, sf).withColumnRenamed("chunk_id", "query_id"), "query_id", "left")
    return S.hybrid_search(q, field_chunks(spark, sf), vectors(spark, sf), files=text_files(spark, sf), top_k=K, extension="en")


@query("degrade_arms", f"WITH {lex_cte('true', 50)}, {SIM.format(k=50)} SELECT query_id, rank, chunk_id, score AS lexical_score, NULL::DOUBLE AS dense_score, 'bm25_fallback' AS method FROM lex WHERE rank <= {K} UNION ALL SELECT query_id, rank, chunk_id, NULL, score, 'dense_fallback' FROM den WHERE rank <= {K}")
def degrade_arms(spark, sf):
    """What stays of a hybrid search without one arm or the other."""
    left = S.hybrid_search(stated_queries(spark, sf), chunks(spark, sf), None, top_k=K, match="any").unionByName(S.fuse(None, dense(spark, sf), K))
    return left.select("query_id", "rank", "chunk_id", "lexical_score", "dense_score", "method")


@query("arm_rank", f"WITH {QUERIES}, {SIM.format(k=50)} SELECT query_id, chunk_id, rank FROM den")
def arm_rank(spark, sf):
    return dense(spark, sf).select("query_id", "chunk_id", "rank")


WIDE = f"WITH {lex_cte('true', 100)}, {SIM.format(k=100)}, {FUSED}"
RERANKED = f"""{WIDE}, p AS (SELECT o.query_id, o.chunk_id, o.rrf_score, list_distinct(q.ws) AS ws, regexp_extract_all(lower(strip_accents(left(text, 2000))), '[\\p{{L}}\\p{{N}}]+') AS has FROM ordered o JOIN q USING (query_id) JOIN documents ON doc_id = chunk_id WHERE rank <= 25 AND q.ws IS NOT NULL),
  s AS (SELECT *, round(1 / (1 + exp(-(8.0::DOUBLE * len(list_intersect(ws, has)) / greatest(1, len(ws)) - 4))), 6) AS reranker_score FROM p)
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY reranker_score DESC, coalesce(rrf_score, 0) DESC, chunk_id) AS INTEGER) AS rank, chunk_id, rrf_score, reranker_score FROM s"""


@query("rerank", f"SELECT * FROM ({RERANKED}) WHERE rank <= {K}")
def rerank(spark, sf):
    q = stated_queries(spark, sf).filter("query is not null")
    found = S.hybrid_search(q, chunks(spark, sf), vectors(spark, sf), top_k=50, match="any")
    return S.rerank(found, q, chunks(spark, sf), top_k=K)


@query("rerank_sort", f"SELECT query_id, rank, chunk_id FROM ({RERANKED})")
def rerank_sort(spark, sf):
    q = stated_queries(spark, sf).filter("query is not null")
    found = S.hybrid_search(q, chunks(spark, sf), vectors(spark, sf), top_k=50, match="any")
    return S.rerank(found, q, chunks(spark, sf), top_k=25).select("query_id", "rank", "chunk_id")


@query("group_by_file", f"{POOL} SELECT query_id, source, min(rank) AS best_rank, arg_min(rrf_score, rank) AS best_score, array_to_string(list(chunk_id ORDER BY rank), ',') AS hits FROM ordered JOIN documents ON doc_id = chunk_id GROUP BY query_id, source")
def group_by_file(spark, sf):
    found = S.fuse(lexical(spark, sf), dense(spark, sf), 1_000_000).join(table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id")
    hits = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda h: h["chunk_id"].cast("string")), ",")
    return found.groupBy("query_id", "source").agg(F.min("rank").alias("best_rank"), F.min_by("rrf_score", "rank").alias("best_score"), hits.alias("hits"))


@query("chunk_file_join", f"WITH {FILES}, {LINES} SELECT chunk_id, filename, index_status FROM lines JOIN files USING (file_id) WHERE index_status <> 'MISSING'")
def chunk_file_join(spark, sf):
    return lines(spark, sf).select("chunk_id", "file_id").join(files(spark, sf).select("file_id", "filename", "index_status"), "file_id").filter("index_status <> 'MISSING'").select("chunk_id", "filename", "index_status")


@query("hydrate", f"WITH {QUERIES}, {SIM.format(k=K)} SELECT query_id, rank, doc_id, source, n_chars FROM den JOIN documents ON doc_id = chunk_id")
def hydrate(spark, sf):
    found = dense(spark, sf, K)
    docs = table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    return docs.join(S.small(found), docs["doc_id"] == found["chunk_id"]).select("query_id", "rank", "doc_id", "source", "n_chars")


@query("top_n_per_group", f"""{POOL}, n AS (SELECT query_id, source, chunk_id, CAST(row_number() OVER (PARTITION BY query_id, source ORDER BY rank) AS INTEGER) AS place FROM ordered JOIN documents ON doc_id = chunk_id) SELECT *, CASE WHEN place = 1 THEN 'best' ELSE 'supporting' END AS role FROM n WHERE place <= 3""")
def top_n_per_group(spark, sf):
    from pyspark.sql import Window as W

    found = S.fuse(lexical(spark, sf), dense(spark, sf), 1_000_000).join(table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "source"), "chunk_id")
    place = F.row_number().over(W.partitionBy("query_id", "source").orderBy("rank"))
    return found.withColumn("place", place).filter("place <= 3").select("query_id", "source", "chunk_id", "place", F.when(F.col("place") == 1, "best").otherwise("supporting").alias("role"))
