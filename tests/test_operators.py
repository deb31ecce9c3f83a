"""Behaviours on small tables."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import chunking, context, filters, graph, indexing, lifecycle, search, summary
from corpusloom.sources import extract as X
from corpusloom.streaming import events as E


def one(spark, *cols):
    return spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_query_terms(spark):
    r = one(spark, T.query_tokens(F.lit('Alpha, alpha "big cat" sample.txt (beta)')), T.query_phrases(F.lit('x "big cat" y " "')), T.match_terms(F.lit('"big cat" sample.txt b 中')))
    assert r.c0 == ["Alpha", "big", "cat", "sample.txt", "beta"] and r.c1 == ["big cat"]
    assert [(t.toks, t.prefix) for t in r.c2] == [(["big", "cat"], False), (["sample", "txt"], False), (["sample"], True), (["txt"], True), (["b"], False), (["中"], True)]


def test_snippet(spark):
    long = "x" * 300 + " needle " + "y" * 300
    r = one(spark, T.snippet(F.lit(long), F.array(F.lit("NEEDLE"))), T.snippet(F.lit(" short "), F.array(F.lit("q"))), T.snippet(F.lit("xneedley " * 50 + "needle"), F.array(F.lit("needle"))))
    assert "needle" in r.c0 and len(r.c0) <= 246 and r.c0.startswith("...") and r.c0.endswith("...") and r.c1 == "short" and r.c2.endswith("needle")


@pytest.mark.parametrize(("text", "name"), [("nonexistent_report.pdf", "nonexistent_report.pdf"), (' "budget_2024.xlsx" ', "budget_2024.xlsx"), ("subfolder\\notes.md", "notes.md"), ("How does it work?", None), ("What is in report.pdf?", None), ("show me report.pdf", None), ("get_config()", None), (".pdf", None), ("one two three four five six seven.txt", None)])
def test_filename_intent(spark, text, name):
    assert one(spark, T.filename_intent(F.lit(text))).c0 == name


def test_secrets(spark):
    t = 'Authorization: Bearer abc.def password="hunter2" sk-abcdefghijklmnop1234 https://u:pw@h/x Authorization: Zm9v'
    got = one(spark, T.redact_secrets(F.lit(t))).c0
    assert not any(s in got for s in ("abc.def", "hunter2", "abcdefghijklmnop", "pw@", "Zm9v")) and "https://u:[REDACTED]@h/x" in got


def test_tokens_and_ids(spark):
    import hashlib
    import json

    r = one(spark, T.chunk_tokens(F.lit("  中文 abcdefgh ")), T.budget_tokens(F.lit("中文 abcdefgh")), T.chunk_tokens(F.lit(" ")), T.chunk_id(F.lit("f"), F.lit('H "1"'), F.lit(None).cast("string"), F.lit(3), F.lit("hé")))
    assert (r.c0, r.c1, r.c2) == (2 + 9 // 4, 2 + 3, 0)
    assert r.c3 == "chk_" + hashlib.sha256(json.dumps(["f", 'H "1"', None, 3, "hé"], separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()[:16]


def test_exclusions_and_search(spark):
    f = spark.createDataFrame([("a/node_modules/x.js", "x.js"), ("a/b.LOG", "b.LOG"), ("drafts/c.md", "c.md"), ("a/keep.md", "keep.md"), ("a/~$d.docx", "~$d.docx")], "relative_path string, filename string")
    assert [r.filename for r in filters.not_excluded(f, ["Drafts/", "*.tmp"]).collect()] == ["keep.md"]
    g = f.withColumn("sha256", F.lit("abc123"))
    assert filters.search_files(g, "KEEP abc").count() == 1 and filters.search_files(g, "a/ keep").count() == 0 and filters.search_files(g, "a/keep").count() == 1


def test_search_semantics(spark):
    c = spark.createDataFrame([("1", "the quick brown fox", "fox.md"), ("2", "quick thinking", "b.md"), ("3", "brown bread and quickly", "bread.md"), ("4", "nothing here", "d.md"), ("5", "else", "e.md"), ("6", "zzz", "z.md")], "chunk_id string, content string, source_file string")
    terms = lambda q: spark.createDataFrame([("q", q)], "query_id string, query string").withColumn("terms", T.match_terms(F.col("query")))
    ids = lambda q, **k: sorted(r.chunk_id for r in search.lexical_search(terms(q), c, **k).collect())
    assert ids("quick") == ["1", "2", "3"] and ids("quick brown") == ["1", "3"] and ids('"quick brown"') == ["1"] and ids("bread.md") == ["3"]
    assert ids("quick", scope=c.filter("chunk_id <> '1'").select("chunk_id")) == ["2", "3"]
    q = spark.createDataFrame([("q", "fox.md")], "query_id string, query string")
    found = search.boosted(search.lexical_search(terms("fox.md"), c), q, c, 5).first()
    assert found.chunk_id == "1" and found.score > 5


def test_fusion(spark):
    s = "query_id string, rank int, chunk_id string, score double"
    lex, den = spark.createDataFrame([("q", 1, "a", 9.0), ("q", 2, "b", 3.0)], s), spark.createDataFrame([("q", 1, "b", 0.9), ("q", 2, "c", 0.8)], s)
    got = {r.chunk_id: r for r in search.fuse(lex, den, 10).collect()}
    assert got["b"].rank == 1 and got["b"].rrf_score == round(1 / 62 + 1 / 61, 6) and got["a"].dense_score is None and got["c"].lexical_rank is None
    boosts = spark.createDataFrame([("q", "a", 0.02), ("q", "c", 0.02)], "query_id string, chunk_id string, boost double")
    up = {r.chunk_id: r.rrf_score for r in search.fuse(lex, den, 10, boosts).collect()}
    assert up["a"] == round(1 / 61 + 0.02, 6) and up["c"] == round(1 / 62 + 0.005, 6)
    assert {r.method for r in search.fuse(lex, None, 10).collect()} == {"bm25_fallback"}


def test_knn_blocks_and_sketches(spark, data):
    v = spark.read.parquet(f"{data}/embeddings.parquet").select(F.col("vec_id").alias("chunk_id"), "embedding")
    q = v.filter("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
    exact = {tuple(r) for r in search.knn_join(q, v, top_k=5).collect()}
    assert exact == {tuple(r) for r in search.knn_join(q, v, top_k=5, block=3).collect()}
    near = {tuple(r) for r in search.knn_join_approx(q, v, top_k=5).collect()}
    pairs = lambda rows: {(r[0], r[1]) for r in rows}
    assert len(pairs(near) & pairs(exact)) >= 0.9 * len(exact)
    verified = search.sketch_candidates(q, v, 50).count()
    assert verified <= 0.1 * q.count() * v.count()
    more = {tuple(r) for r in search.knn_join(q, v.filter("chunk_id < 0"), top_k=5).collect()} | {tuple(r) for r in search.knn_join(q.filter("query_id < 0"), v, top_k=5).collect()}
    assert not more


def test_both_ways_of_lexical_search_agree(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    chunks = docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.concat("source", F.lit("_"), "lang").alias("source_file"))
    w = T.tokenize(F.col("text"))
    text = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('"'), F.get(w, 0), F.lit(" "), F.get(w, 1), F.lit('" '), F.left(F.get(w, 2), F.lit(2)))).otherwise(F.concat(F.get(w, 3), F.lit(" "), F.left(F.get(w, 4), F.lit(2))))
    q = docs.filter("doc_id % 10 = 0").select(F.col("doc_id").alias("query_id"), text.alias("query"), T.match_terms(text).alias("terms")).persist()
    for match in ("all", "any"):
        for scope in (None, chunks.filter("chunk_id % 3 = 0")):
            a, b = (search.lexical_search(q, chunks, top_k=7, match=match, scope=scope, most_terms=n).collect() for n in (1_000_000, 0))
            assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and a
    empty = search.lexical_search(q.limit(0), chunks)
    assert empty.count() == 0 and empty.columns == ["query_id", "chunk_id", "score", "rank"]
    assert search.lexical_search(q, chunks.limit(0)).count() == 0


def test_hybrid_search_of_file_names(spark):
    chunks = spark.createDataFrame([("a1", "a", "alpha beta", "a.md"), ("a2", "a", "gamma", "a.md"), ("b1", "b", "alpha a md", "b.md"), ("c1", "c", "alpha", "c.md")], "chunk_id string, file_id string, content string, source_file string")
    files = spark.createDataFrame([(i, f"{i}.md", f"/r/{i}.md", f"{i}.md", "x", ".md", s) for i, s in (("a", "INDEXED"), ("b", "INDEXED"), ("c", "FAILED"))], "file_id string, filename string, path string, relative_path string, folder_id string, extension string, index_status string")
    vectors = spark.createDataFrame([(c, [float(i), 1.0]) for i, c in enumerate(("a1", "a2", "b1", "c1"))], "chunk_id string, embedding array<double>")
    q = spark.createDataFrame([("name", "a.md", [0.0, 1.0]), ("none", "z.md", [0.0, 1.0]), ("words", "alpha", [0.0, 1.0])], "query_id string, query string, embedding array<double>")
    got = {}
    for r in search.hybrid_search(q, chunks, vectors, files=files).collect():
        got.setdefault(r.query_id, {})[r.chunk_id] = (r.lexical_rank, r.dense_rank, r.method)
    assert set(got) == {"name", "words"} and set(got["name"]) == {"a1", "a2"}
    assert got["words"]["c1"] == (None, 4, "hybrid") and got["words"]["a1"][0] in (1, 2) and got["words"]["a2"][0] is None
    assert {r.method for r in search.hybrid_search(q, chunks, vectors, files=files, mode="bm25").collect()} == {"bm25"}
    assert {r.method for r in search.hybrid_search(q, chunks, None, files=files).collect()} == {"bm25_fallback"}
    assert search.hybrid_search(q, chunks, vectors, files=files, quality="quality").columns == ["query_id", "rank", "chunk_id", "rrf_score", "reranker_score"]
    with pytest.raises(ValueError):
        search.hybrid_search(q, chunks, vectors, mode="bm25", quality="quality")


def test_names_with_spaces_are_found(spark):
    files = spark.createDataFrame([("1", "annual report (final).pdf", "docs/annual report (final).pdf"), ("2", "a.md", "x/a.md"), ("3", "a.md", "y/a.md"), ("4", "note-1.txt", "note-1.txt")], "file_id string, filename string, relative_path string")
    texts = ["see Annual Report (Final).pdf, and", "xannual report (final).pdf", "in y/a.md or a.md", "note-1.txt.bak", "my-note-1.txt; (note-1.txt)"]
    chunks = spark.createDataFrame([(str(10 + i), f"c{i}", 0, t) for i, t in enumerate(texts)], "file_id string, chunk_id string, chunk_index int, content string")
    assert {(r.file_id, r.target_id, r.by) for r in graph.file_references(chunks, files).collect()} == {("10", "1", "filename"), ("12", "3", "path"), ("14", "4", "path")}


def test_markdown_and_chunks(spark):
    md = "# Title\nintro one\nintro two\n\n## Part\n- a\n- b\n```py\ncode | x\n\nmore\n```\n| h | i |\n| --- | --- |\n| 1 | 2 |\n# Next\nlast"
    f = spark.createDataFrame([("f", md)], "file_id string, text string")
    e = X.markdown_elements(f).orderBy("elem_idx").collect()
    assert [x.type for x in e] == ["HEADING", "PARAGRAPH", "HEADING", "LIST_ITEM", "LIST_ITEM", "CODE_BLOCK", "TABLE", "HEADING", "PARAGRAPH"]
    assert all(md[x.char_start : x.char_end].lstrip("# ") == x.text.lstrip("# ") for x in e) and e[0].text == "Title"
    c = chunking.chunk_documents(X.markdown_elements(f)).orderBy("chunk_index").collect()
    assert [(x.h1, x.h2, x.content_type) for x in c] == [("Title", None, "text"), ("Title", "Part", "code"), ("Title", "Part", "table"), ("Next", None, "text")]
    assert c[1].section == "Title > Part" and len({x.chunk_id for x in c}) == 4


def test_chunk_sizes_and_overlap(spark):
    rows = [("f", i, "PARAGRAPH", None, f"{i:02d}" + "x" * 98, i, i) for i in range(40)]
    c = chunking.chunk_documents(spark.createDataFrame(rows, "file_id string, elem_idx int, type string, level int, text string, line_start int, line_end int")).orderBy("chunk_index").collect()
    assert all(len(x.content) <= 3100 for x in c) and len(c) > 2
    assert c[1].content.split("\n\n")[0] == c[0].content.split("\n\n")[-1]
    assert chunking.split_table("| a |\n| --- |\n" + "\n".join(f"| {i} |" for i in range(100)), 200, 100)[3].startswith("| a |\n| --- |\n")


def test_parsers():
    html = "<nav>x</nav><h2>Head</h2><p>One &amp; two<br>three</p><script>no</script><table><tr><th>a</th><th>b</th></tr><tr><td>1|2</td></tr></table>"
    assert X.parse_html(html) == [("HEADING", 2, "Head"), ("PARAGRAPH", None, "One & two"), ("PARAGRAPH", None, "three"), ("TABLE", None, "| a | b |\n| --- | --- |\n| 1\\|2 |  |")]
    assert [p[2] for p in X.parse_rtf(r"{\rtf1{\fonttbl{\f0 Arial;}}Caf\'e9 \u8364?\par \{x\}}")] == ["Café €", "{x}"]
    assert X.parse_xml("<!DOCTYPE x><a/>") == [] and X.parse_xml("<a><b>t</b></a>") == [("HEADING", 1, "a"), ("PARAGRAPH", None, "b: t")]
    assert X.parse_json('{"k": [1]}') == [("HEADING", 1, "k"), ("PARAGRAPH", None, "[1]")] and X.parse_json("no") == [("PARAGRAPH", None, "no")]


def test_incremental_index_is_idempotent(spark):
    f = spark.createDataFrame([("1", "# A\nx", ".md", "h1"), ("2", "y", ".txt", "h2"), ("3", "k,v\n1,2", ".csv", "h3"), ("4", "?", ".bin", "h4")], "file_id string, text string, extension string, sha256 string")
    none = spark.createDataFrame([], "file_id string, chunk_index int, chunk_id string, content string, source_sha256 string, parser_version string, chunker_version string")
    first = indexing.incremental_index(f, none).cache()
    assert {r.file_id for r in first.collect()} == {"1", "2", "3"}
    again = indexing.incremental_index(f, first)
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, again.collect()))
    assert {r.file_id for r in indexing.incremental_index(f.filter("file_id <> '2'"), first).collect()} == {"1", "3"}
    assert indexing.hashing_embedder(first, 16).select(F.size("embedding")).distinct().first()[0] == 16


def test_context_budget(spark):
    rows = [("q", 1, "a", "x" * 35), ("q", 2, "b", "x" * 350), ("q", 3, "a", "x" * 35), ("q", 4, "c", " "), ("q", 5, "d", "x" * 28), ("q", 6, "e", "x" * 63), ("q", 7, "f", "x" * 7)]
    r = context.build_context(spark.createDataFrame(rows, "query_id string, rank int, chunk_id string, content string"), evidence=21, max_chunks=3).first()
    assert [i.chunk_id for i in r.included] == ["a", "d", "f"] and r.used == 20 and r.status == "READY"
    assert [(o.chunk_id, o.reason) for o in r.omitted] == [("b", "oversized_single_chunk"), ("a", "duplicate_chunk"), ("c", "invalid_empty_content"), ("e", "budget_exceeded")]


def test_prompt(spark):
    q = spark.createDataFrame([("q", " why? "), ("r", "x")], "query_id string, query string")
    e = spark.createDataFrame([("q", 2, "b", "[Source: b]", "two"), ("q", 1, "a", "[Source: a]", "one")], "query_id string, rank int, chunk_id string, header string, content string")
    got = {r.query_id: r for r in context.build_prompts(e, q).collect()}
    assert "[E1] [Source: a]\none\n\n[E2] [Source: b]\ntwo" in got["q"].prompt and got["q"].citations == {"E1": "a", "E2": "b"} and "[No evidence provided]" in got["r"].prompt


def test_representative_chunks(spark):
    rows = [("f", i, "General" if i < 6 else f"s{i // 6}", None, 400) for i in range(20)]
    c = summary.representative_chunks(spark.createDataFrame(rows, "file_id string, chunk_index int, section string, h1 string, tokens int"), "section", "h1", "tokens")
    assert sorted(r.chunk_index for r in c.collect()) == [0, 1, 6, 12, 18, 19]


def test_references_need_a_unique_name(spark):
    f = spark.createDataFrame([("1", "a/x.md", "x.md"), ("2", "b/x.md", "x.md"), ("3", "c/y.md", "y.md")], "file_id string, relative_path string, filename string")
    c = spark.createDataFrame([("1", "1:0", 0, "see x.md and (y.md), but not y.md2"), ("3", "3:0", 0, "b/x.md!")], "file_id string, chunk_id string, chunk_index int, content string")
    assert {(r.file_id, r.target_id, r.by) for r in graph.file_references(c, f).collect()} == {("1", "3", "filename"), ("3", "2", "path")}


def test_load_vectors_checks_dimension(spark):
    v = spark.createDataFrame([(1, [1.0, 2.0])], "id long, embedding array<double>")
    with pytest.raises(Exception, match="vector of 2 values"):
        lifecycle.load_vectors(v, v, "id", 3).collect()


def at(s):
    return datetime(2024, 1, 1) + timedelta(seconds=s)


def events(spark, rows):
    return spark.createDataFrame([(i, "r", k, p, o, d, at(s)) for i, (k, p, o, d, s) in enumerate(rows)], E.SCHEMA)


def test_events(spark):
    e = events(spark, [("CREATE", "/r/a", None, False, 0.0), ("MODIFY", "/r/a", None, False, 0.1), ("MODIFY", "/r/d/x", None, False, 0.2), ("DELETE", "/r/d", None, True, 0.3), ("DELETE", "/r/d/y", None, False, 0.4), ("CREATE", "/r/t", None, False, 0.5), ("MOVE", "/r/u", "/r/t", False, 0.6), ("MODIFY", "/r/a", None, False, 5.0)])
    b = E.with_burst(e)
    done = {(r.burst, r.path): r.event_type for r in E.coalesce_events(E.collapse_cascades(b)).collect()}
    assert done == {(1, "/r/a"): "CREATE", (1, "/r/d"): "DELETE", (1, "/r/u"): "CREATE", (2, "/r/a"): "MODIFY"}
    files = spark.createDataFrame([("/r/d/x", "1", "INDEXED", at(0)), ("/r/k", "2", "INDEXED", at(0))], "path string, file_id string, index_status string, modified_at timestamp")
    after = {r.path: r.index_status for r in E.apply_events(files, E.coalesce_events(E.collapse_cascades(b))).collect()}
    assert after == {"/r/d/x": "MISSING", "/r/k": "INDEXED", "/r/a": "QUEUED", "/r/u": "QUEUED"}


def test_many_deletes_under_one_folder(spark):
    e = events(spark, [("DELETE", f"/r/d/f{i}", None, False, i / 1000) for i in range(500)] + [("DELETE", "/r/d", None, True, 0.6)])
    assert [r.path for r in E.collapse_cascades(E.with_burst(e)).collect()] == ["/r/d"]


def test_stream_equals_batch(spark, tmp_path):
    rows = [("CREATE", "/r/a", None, False, 0.0), ("MODIFY", "/r/a", None, False, 0.2), ("MODIFY", "/r/b", None, False, 3.0), ("CREATE", "/r/end", None, False, 100.0)]
    e = events(spark, rows)
    e.filter("event_id < 2").coalesce(1).write.parquet(str(tmp_path / "in"))
    e.filter("event_id >= 2").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    q = E.bursts(E.event_source(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("bursts").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    batch = {(r.first_event, r.last_event, r.n) for r in E.bursts(e).collect()}
    assert {(r.first_event, r.last_event, r.n) for r in spark.sql("select * from bursts").collect()} == batch - {(3, 3, 1)}
    start = spark.createDataFrame([("r", "/r/b", "9", "INDEXED", at(0)), ("other", "/o/c", "8", "INDEXED", at(0))], "folder_id string, path string, file_id string, index_status string, modified_at timestamp")
    E.run_incremental(E.event_source(spark, str(tmp_path / "in")), str(tmp_path / "cp2"), str(tmp_path / "snap"), start).awaitTermination(120)
    assert {r.path: (r.folder_id, r.index_status) for r in E.latest_files(spark, str(tmp_path / "snap")).collect()} == {"/r/a": ("r", "QUEUED"), "/r/b": ("r", "QUEUED"), "/o/c": ("other", "INDEXED")}


def test_a_burst_split_over_batches_comes_as_one(spark, tmp_path):
    rows = [("CREATE", "/r/a", None, False, 0.0), ("MODIFY", "/r/a", None, False, 0.2), ("MOVE", "/r/b", "/r/a", False, 0.4), ("CREATE", "/r/c", None, False, 60.0), ("CREATE", "/r/end", None, False, 120.0), ("MODIFY", "/r/late", None, False, 1.0), ("CREATE", "/r/end2", None, False, 240.0)]
    e = events(spark, rows)
    for i in range(len(rows)):  # an event a batch
        e.filter(f"event_id = {i}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.02)
    q = E.closed_bursts(E.event_source(spark, str(tmp_path / "in"), 1)).writeStream.format("memory").queryName("closed").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = spark.sql("select * from closed")
    got = spark.createDataFrame(got.collect(), got.schema)
    assert {(r.event_id, r.burst) for r in got.collect()} == {(0, micros(0)), (1, micros(0)), (2, micros(0)), (3, micros(60)), (4, micros(120))}
    done = {(r.path, r.event_type) for r in E.coalesce_events(E.collapse_cascades(got)).collect()}
    assert done == {("/r/b", "CREATE"), ("/r/a", "MODIFY"), ("/r/c", "CREATE"), ("/r/end", "CREATE")}
    assert sum(o["numRowsDroppedByWatermark"] for p in q.recentProgress for o in p["stateOperators"]) == 1


def micros(s):
    return int((at(s) - datetime(1970, 1, 1)).total_seconds() * 1_000_000)


def test_apply_events_by_brute_force(spark):
    kinds, rows = ["CREATE", "MODIFY", "DELETE", "MOVE"], []
    for i in range(120):
        d, f = f"/r/d{i * 7 % 4}", i * 13 % 6
        kind = kinds[i * 11 % 4]
        rows.append((kind, f"{d}/f{f}", f"{d}/g{f}" if kind == "MOVE" else None, False, float(i)))
    rows.append(("MOVE", "/r/new", "/r/whole", True, 500.0))
    rows.append(("DELETE", "/r/gone", None, True, 501.0))
    start = {f"/r/d{d}/{x}{f}": "INDEXED" for d in range(4) for x in "fg" for f in range(6)} | {f"/r/whole/s/h{i}": "INDEXED" for i in range(3)} | {f"/r/gone/h{i}": "FAILED" for i in range(3)} | {"/r/wholesale": "INDEXED"}
    files = spark.createDataFrame([(p, p, s, at(0)) for p, s in start.items()], "path string, file_id string, index_status string, modified_at timestamp")
    done = E.coalesce_events(events(spark, rows).withColumn("burst", F.lit(0)))
    last = {}
    for k, p, o, d, _ in rows:
        last[p] = (k, o, d)
    want = []
    moves = {o: p for p, (k, o, _) in last.items() if k == "MOVE"}
    for p, s in start.items():
        to = next((n + p[len(o) :] for o, n in moves.items() if p == o or p.startswith(o + "/")), p)
        gone = any(k == "DELETE" and (to == q or to.startswith(q + "/")) for q, (k, _, _) in last.items())
        want.append((to, "MISSING" if gone else s))
    written = {p for p, (k, _, d) in last.items() if k in ("CREATE", "MODIFY") and not d}
    want = [(p, "QUEUED" if p in written else s) for p, s in want] + [(p, "QUEUED") for p in written - {p for p, _ in want}]
    assert sorted((r.path, r.index_status) for r in E.apply_events(files, done).collect()) == sorted(want)
