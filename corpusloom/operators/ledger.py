"""What is kept beside the corpus so that little is read again: hash trees of folders, mergeable statistics, validity of insights, rules of folders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.functions import text as T
from corpusloom.operators.search import small


def hash_tree(files: DataFrame, *state: str, depth: int = 2) -> DataFrame:
    """(folder_id, prefix, files, hash): a tree over the files of each folder, with the root at prefix ''.

    A file's leaf is given by the first `depth` hexadecimal digits of the MD5 of its id. A leaf's hash is the SHA-256 of its files' states in the order of their
    ids, a node's that of its children's hashes in the order of their prefixes, of which there are 16 at most. So no task gathers more than a leaf, with 16 ** depth leaves a
    folder, and a changed file changes the hashes of one path only.
    """
    line = F.concat_ws(":", "file_id", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in state])
    level = files.select("folder_id", F.substring(F.md5(F.col("file_id").cast("binary")), 1, depth).alias("prefix"), F.col("file_id").alias("key"), line.alias("part"), F.lit(1).cast("long").alias("files"))
    out = None
    for left in range(depth, -1, -1):
        parts = F.transform(F.array_sort(F.collect_list(F.struct("key", "part"))), lambda x: x["part"])
        nodes = level.groupBy("folder_id", "prefix").agg(F.sum("files").alias("files"), F.sha2(F.array_join(parts, ""), 256).alias("hash"))
        out = nodes if out is None else out.unionByName(nodes)
        level = nodes.select("folder_id", F.substring("prefix", 1, max(0, left - 1)).alias("prefix"), F.col("prefix").alias("key"), F.col("hash").alias("part"), "files")
    return out


def changed_leaves(old: DataFrame, new: DataFrame, depth: int = 2) -> DataFrame:
    """(folder_id, prefix) of the leaves that differ between two trees; whole folders may be new or gone."""
    a, b = (t.filter(F.length("prefix") == depth).select("folder_id", "prefix", F.col("hash").alias(n)) for t, n in ((old, "a"), (new, "b")))
    return a.join(b, ["folder_id", "prefix"], "full").filter(~F.col("a").eqNullSafe(F.col("b"))).select("folder_id", "prefix")


def intelligence_stats(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: total_chunks, files_with_chunks, and files by status: indexed_files, queued_files, failed_files, skipped_files."""
    of_chunks = chunks.agg(F.count(F.lit(1)).alias("total_chunks"), F.countDistinct("file_id").alias("files_with_chunks"))
    names = ("indexed", "queued", "failed", "skipped")
    counts = files.agg(F.struct(*[F.count_if(F.col("index_status") == s.upper()).alias(s) for s in names])).scalar()
    return of_chunks.select("*", *[counts[s].alias(f"{s}_files") for s in names])


def chunk_sketches(chunks: DataFrame, accuracy: int = 14) -> DataFrame:
    """(folder_id, chunks, files_sketch, tokens_sketch): counts that stay exact, a HyperLogLog sketch of the file ids (standard error 1.04 / sqrt(2 ** accuracy)) and
    a KLL sketch of the chunks' tokens. Sketches of increments are merged by merged_sketches, so chunks are never read twice."""
    return chunks.groupBy("folder_id").agg(F.count(F.lit(1)).alias("chunks"), F.hll_sketch_agg("file_id", accuracy).alias("files_sketch"), F.kll_sketch_agg_bigint(T.chunk_tokens(F.col("content")).cast("long")).alias("tokens_sketch"))


def merged_sketches(sketches: DataFrame, *keys: str) -> DataFrame:
    """Sketches of several tables or folders as one a key; without keys one row."""
    return sketches.groupBy(*keys).agg(F.sum("chunks").alias("chunks"), F.hll_union_agg("files_sketch").alias("files_sketch"), F.kll_merge_agg_bigint("tokens_sketch").alias("tokens_sketch"))


def sketch_stats(sketches: DataFrame, *keys: str) -> DataFrame:
    """(keys, chunks, files, median_tokens, p95_tokens) from sketches; files and the quantiles are estimates."""
    quantile = lambda q: F.kll_sketch_get_quantile_bigint("tokens_sketch", F.lit(q))
    return sketches.select(*keys, "chunks", F.hll_sketch_estimate("files_sketch").alias("files"), quantile(0.5).alias("median_tokens"), quantile(0.95).alias("p95_tokens"))


UNKNOWN_PARSER, DEFAULT_CHUNKER = "unknown", "1"


def insight_validity(insights: DataFrame, files: DataFrame, chunks: DataFrame, *, model: str, chunker: str = DEFAULT_CHUNKER) -> DataFrame:
    """(file_id, freshness, reason): READY while an insight's status is READY, it was made from the file's present hash by the present model, and by the parser and chunker of the
    file's first chunk; else STALE with the first reason. A file that has lost its chunks is stale if the insight cites any or names a parser.

    insights: file_id, status, content_hash, model_name, parser_version, chunker_version, citations (array). chunks: file_id, chunk_index, parser_version, chunker_version.
    """
    first = chunks.groupBy("file_id").agg(F.min_by(F.struct(F.col("parser_version").alias("parser"), F.col("chunker_version").alias("chunker")), "chunk_index").alias("c"))
    i = insights.join(files.select("file_id", F.coalesce("sha256", F.lit("")).alias("sha256")), "file_id", "left").join(first, "file_id", "left")
    bare = F.col("c").isNull()
    parser, cut = F.when(bare, UNKNOWN_PARSER).otherwise(F.col("c.parser")), F.when(bare, chunker).otherwise(F.col("c.chunker"))
    made = F.coalesce("parser_version", F.lit(""))
    differs = lambda a, b: (b != "") & ~F.col(a).eqNullSafe(b)  # noqa: E731  an empty version isn't held against an insight
    reason = (
        F.when(~F.col("status").eqNullSafe(F.lit("READY")), "status")
        .when(~F.col("content_hash").eqNullSafe(F.coalesce("sha256", F.lit(""))), "content")
        .when(bare & ((F.coalesce(F.size("citations"), F.lit(0)) > 0) | ~made.isin("", UNKNOWN_PARSER)), "chunks")
        .when(~F.col("model_name").eqNullSafe(F.lit(model)), "model")
        .when(F.coalesce(differs("parser_version", parser), F.lit(False)), "parser")
        .when(F.coalesce(differs("chunker_version", cut), F.lit(False)), "chunker")
    )
    return i.select("file_id", F.when(reason.isNull(), "READY").otherwise("STALE").alias("freshness"), reason.alias("reason"))


def folder_validity(insights: DataFrame, trees: DataFrame, *, model: str, active: DataFrame | None = None) -> DataFrame:
    """(folder_id, freshness) of folders' insights (folder_id, status, composite_hash, model_name): a READY one whose hash isn't the root of the folder's
    tree, or that another model made, is STALE; so is one that is GENERATING while no generation of its folder is active (folder_id). Others keep their status."""
    roots = trees.filter("prefix = ''").select("folder_id", F.col("hash").alias("root"))
    i = insights.join(roots, "folder_id", "left")
    i = i.join(active.select("folder_id", F.lit(True).alias("running")), "folder_id", "left") if active is not None else i.withColumn("running", F.lit(None).cast("boolean"))
    other = ~F.col("composite_hash").eqNullSafe(F.col("root")) | ~F.col("model_name").eqNullSafe(F.lit(model))
    status = F.coalesce("status", F.lit("READY"))
    left = (status == "GENERATING") & F.col("running").isNull()
    return i.select("folder_id", F.when(left | ((status == "READY") & other), "STALE").otherwise(status).alias("freshness"))


def _pattern(glob: Column) -> Column:
    """A glob with * and ? as a pattern for whole texts, in lower case."""
    quoted = F.regexp_replace(F.lower(glob), r"([\\.\[\]{}()+^$|])", r"\\$1")
    return F.concat(F.lit("^"), F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("$"))


def apply_rules(files: DataFrame, rules: DataFrame) -> DataFrame:
    """files (folder_id, relative_path, filename) that no rule (folder_id, pattern) of their folder excludes, in any case; a null folder_id is a rule of all.

    A rule without * ? / is the name of a folder and is joined with the folders of a path. A rule that ends with an extension is joined with the files of that
    extension, any other with the files of its folder, and then tested on the file's name and path. So thousands of rules cost joins on keys, and no file meets the rules of other folders or extensions.
    """
    path = F.lower(F.replace("relative_path", F.lit("\\"), F.lit("/")))
    base = files.withColumn("_path", path)
    clean = F.regexp_replace(F.lower(F.trim("pattern")), r"[/\\]+$", "")
    r = rules.select("folder_id", clean.alias("glob")).filter("glob <> ''").distinct()
    everyone = lambda c: F.array(F.coalesce(c, F.lit("")), F.lit("*"))
    owner = F.coalesce("folder_id", F.lit("*"))
    plain = r.filter(~F.col("glob").rlike(r"[/\\*?]")).select(owner.alias("_owner"), F.col("glob").alias("_part"))
    parts = F.split("_path", "/")
    keyed = base.select("folder_id", "relative_path", F.lower("filename").alias("_name"), "_path", F.explode(everyone(F.col("folder_id"))).alias("_owner"))
    by_name = keyed.withColumn("_part", F.explode(F.slice(F.split("_path", "/"), F.lit(1), F.size(parts) - 1))).join(plain, ["_owner", "_part"]).select("folder_id", "relative_path")
    globs = r.filter(F.col("glob").rlike(r"[/\\*?]")).select(owner.alias("_owner"), F.replace("glob", F.lit("\\"), F.lit("/")).alias("glob"))
    globs = globs.select("_owner", F.regexp_extract("glob", r"(\.[^.*?/]+)$", 1).alias("_end"), _pattern(F.col("glob")).alias("_test"))
    ends = keyed.withColumn("_end", F.explode(F.array_distinct(F.array(F.regexp_extract("_name", r"(\.[^.]+)$", 1), F.lit("")))))
    by_glob = ends.join(globs, ["_owner", "_end"]).filter(F.regexp_like("_name", F.col("_test")) | F.regexp_like("_path", F.col("_test"))).select("folder_id", "relative_path")
    gone = by_name.union(by_glob).distinct()
    return files.join(gone, files["folder_id"].eqNullSafe(gone["folder_id"]) & (files["relative_path"] == gone["relative_path"]), "left_anti")


def inventory_files(files: DataFrame, n: int = 25) -> DataFrame:
    """(folder_id, place, filename, extension, size, index_status): of each folder the n files modified last, as an inventory lists them."""
    kb = F.col("size_bytes") / 1024
    size = F.when(F.col("size_bytes") < 1 << 20, F.concat(F.format_string("%.1f", F.round(kb, 1)), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.2f", F.round(kb / 1024, 2)), F.lit(" MB")))
    place = F.row_number().over(W.partitionBy("folder_id").orderBy(F.desc("modified_at"), "file_id"))
    return files.withColumn("place", place).filter(F.col("place") <= n).select("folder_id", "place", "filename", "extension", size.alias("size"), "index_status")


def topic_evidence_edges(requested: DataFrame, insights: DataFrame) -> DataFrame:
    """(file_id, other_id, topic_key, source_evidence, target_evidence): files that share a topic, with the citations of both sides that speak of it.
    insights: file_id, topics array, citations array of struct<chunk_id, chunk_index, text>; evidence: chunk_id and chunk_index of each."""

    def cited(insights: DataFrame) -> DataFrame:
        """(file_id, topic_key, evidence): made once for each file and topic, so that a pair meets chunk ids and no texts."""
        t = insights.select("file_id", F.explode("topics").alias("topic")).select("file_id", T.topic_key(F.col("topic")).alias("topic_key")).filter("topic_key <> ''").distinct()
        words = F.filter(F.split("topic_key", " "), lambda w: F.length(w) > 2)
        kept = F.filter("citations", lambda x: F.exists(words, lambda w: F.contains(F.lower(x["text"]), w)))
        evidence = F.transform(F.when(F.size(kept) == 0, F.col("citations")).otherwise(kept), lambda x: F.struct(x["chunk_id"].alias("chunk_id"), x["chunk_index"].alias("chunk_index")))
        return t.join(insights.select("file_id", "citations"), "file_id").select("file_id", "topic_key", evidence.alias("evidence"))

    mine = cited(insights.join(small(requested.select("file_id").distinct()), "file_id", "left_semi")).withColumnRenamed("evidence", "source_evidence")
    theirs = cited(insights).select(F.col("file_id").alias("other_id"), "topic_key", F.col("evidence").alias("target_evidence"))
    pairs = theirs.join(small(mine), "topic_key").filter("file_id <> other_id")
    return pairs.select("file_id", "other_id", "topic_key", "source_evidence", "target_evidence")

