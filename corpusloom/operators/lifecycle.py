"""Changes between snapshots of the corpus. Each operator takes tables and returns the new snapshot or the rows concerned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.operators.search import small


def replace_rows(base: DataFrame, new: DataFrame, changed: DataFrame, key: str) -> DataFrame:
    """base without the rows of the changed keys, and new."""
    return base.join(changed.select(key).distinct(), key, "left_anti").unionByName(new)


def load_vectors(base: DataFrame, new: DataFrame, key: str, dimension: int) -> DataFrame:
    """base with new's vectors in place of those with the same key; a vector of another dimension is an error."""
    n = F.coalesce(F.size("embedding"), F.lit(0))
    bad = F.concat(F.lit("vector of "), n.cast("string"), F.lit(f" values; {dimension} expected"))
    checked = new.withColumn("embedding", F.when(n == dimension, F.col("embedding")).otherwise(F.raise_error(bad).cast(dict(new.dtypes)["embedding"])))
    return replace_rows(base, checked, new, key)


def change_detection(scan: DataFrame, known: DataFrame, *, strict: bool = False, parser: str = "1", chunker: str = "1", most: int = 50 << 20) -> DataFrame:
    """(path, change): NEW, MODIFIED, UNCHANGED, SKIPPED or STALE (known, but not seen).

    scan: path, size_bytes, modified_at. known: the same, with sha256, parser_version, chunker_version, index_status.
    """
    k = known.select("path", *[F.col(c).alias(f"k_{c}") for c in ("size_bytes", "modified_at", "sha256", "parser_version", "chunker_version", "index_status")])
    both = scan.withColumn("seen", F.lit(True)).join(k.withColumn("known", F.lit(True)), "path", "full")
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    unchanged = same("size_bytes", "k_size_bytes") & same("modified_at", "k_modified_at") & F.col("k_sha256").isNotNull() & F.col("k_parser_version").eqNullSafe(F.lit(parser)) & F.col("k_chunker_version").eqNullSafe(F.lit(chunker)) & F.lit(not strict)
    change = (
        F.when(F.col("seen").isNull(), F.when(F.col("k_index_status") != "MISSING", "STALE"))
        .when(F.col("size_bytes") > most, "SKIPPED")
        .when(F.col("known").isNull(), "NEW")
        .when(unchanged, "UNCHANGED")
        .otherwise("MODIFIED")
    )
    return both.select("path", change.alias("change")).filter("change is not null")


def upsert_files(known: DataFrame, new: DataFrame) -> DataFrame:
    """The snapshot after new files are merged by path: a hash that new lacks is kept; an error goes unless the status is FAILED or SKIPPED; indexed_at is kept unless newly indexed."""
    cols = ["file_id", "size_bytes", "modified_at", "sha256", "index_status", "indexing_error", "indexed_at"]
    k, n = (df.select("path", *[F.col(c).alias(f"{p}_{c}") for c in cols], F.lit(True).alias(p)) for p, df in (("k", known), ("n", new)))
    both = k.join(n, "path", "full")
    has = F.col("n").isNotNull()
    pick = lambda c: F.when(has, F.col(f"n_{c}")).otherwise(F.col(f"k_{c}"))
    kept = lambda c: F.coalesce(f"n_{c}", f"k_{c}")
    return both.select(
        "path",
        F.coalesce("k_file_id", "n_file_id").alias("file_id"),
        pick("size_bytes").alias("size_bytes"),
        pick("modified_at").alias("modified_at"),
        kept("sha256").alias("sha256"),
        pick("index_status").alias("index_status"),
        F.when(~has, F.col("k_indexing_error")).when(F.col("n_index_status").isin("FAILED", "SKIPPED"), F.col("n_indexing_error")).alias("indexing_error"),
        F.when(has & (F.col("n_index_status") == "INDEXED"), kept("indexed_at")).otherwise(F.col("k_indexed_at")).alias("indexed_at"),
    )


def ancestors(path: Column) -> Column:
    """All folders above a path."""
    parts = F.split(path, "/")
    return F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(parts) - 1)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")), lambda p: p != "")


def subtree(files: DataFrame, folders: DataFrame) -> DataFrame:
    """files under the folders (folder): each file meets its own ancestors, an equi join."""
    rows = files.withColumn("folder", F.explode(ancestors(F.col("path"))))
    return rows.join(small(folders.select("folder").distinct()), "folder")


def apply_renames(files: DataFrame, renames: DataFrame) -> DataFrame:
    """files (path) after folders are renamed (folder, new_folder): the deepest renamed ancestor counts."""
    hit = files.select("path", F.explode(ancestors(F.col("path"))).alias("folder")).join(small(renames), "folder").groupBy("path").agg(F.max_by(F.struct("folder", "new_folder"), F.length("folder")).alias("r"))
    out = files.join(hit, "path", "left")
    path = F.when(F.col("r").isNotNull(), F.concat("r.new_folder", F.expr("substring(path, length(r.folder) + 1)"))).otherwise(F.col("path"))
    out = out.withColumn("new_path", path).drop("r")
    return out.withColumn("filename", F.element_at(F.split("new_path", "/"), -1)).withColumn("extension", F.lower(F.regexp_extract("filename", r"(\.[^.]*)$", 1)))


def reindex_plan(files: DataFrame, chunks: DataFrame, parser: str, chunker: str) -> DataFrame:
    """(file_id, reparse): false only if the first chunk was made from the same hash by the same versions."""
    first = chunks.groupBy("file_id").agg(F.min_by(F.struct("source_sha256", "parser_version", "chunker_version"), "chunk_index").alias("c"))
    current = (F.col("c.source_sha256") == F.col("sha256")) & (F.col("c.parser_version") == parser) & (F.col("c.chunker_version") == chunker)
    return files.join(first, "file_id", "left").select("file_id", (~F.coalesce(current, F.lit(False))).alias("reparse"))


def vector_lineage(vectors: DataFrame, expected: dict[str, str]) -> DataFrame:
    """(identity columns, n) of vectors that don't come from the expected model; no rows: all is valid."""
    keys = list(expected)
    differs = F.lit(False)
    for k, v in expected.items():
        differs = differs | ~F.col(k).cast("string").eqNullSafe(F.lit(v))
    return vectors.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(differs)


def offline_deletes(known: DataFrame, scan: DataFrame) -> DataFrame:
    return known.filter("index_status <> 'MISSING'").join(scan.select("path"), "path", "left_anti")


def cascade_delete(tables: dict[str, DataFrame], doomed: DataFrame, key: str = "file_id") -> dict[str, DataFrame]:
    """Every table without the doomed keys."""
    gone = small(doomed.select(key).distinct())
    return {name: t.join(gone, key, "left_anti") for name, t in tables.items()}


def orphans(child: DataFrame, parent: DataFrame, key: str) -> DataFrame:
    return child.join(parent.select(key), key, "left_anti")


def root_overlap(roots: DataFrame) -> DataFrame:
    """(root, inside): pairs of registered roots (root) of which one is the other or stands in it."""
    up = roots.select(F.col("root").alias("inside"), F.explode(F.concat(ancestors(F.col("root")), F.array("root"))).alias("root")).distinct()
    twice = roots.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return up.join(twice, "root").filter((F.col("root") != F.col("inside")) | (F.col("n") > 1)).select("root", "inside")


def insight_freshness(insights: DataFrame, files: DataFrame, *, model: str, parser: str) -> DataFrame:
    """(file_id, freshness): READY while made from the file's present hash by the present model and parser, else STALE."""
    i = insights.select("file_id", F.col("content_hash").alias("made_from"), "model_name", "parser_version")
    ready = (F.col("made_from") == F.col("sha256")) & (F.col("model_name") == model) & (F.col("parser_version") == parser)
    return i.join(files.select("file_id", "sha256"), "file_id", "left").select("file_id", F.when(F.coalesce(ready, F.lit(False)), "READY").otherwise("STALE").alias("freshness"))


def citation_integrity(citations: DataFrame, chunks: DataFrame) -> DataFrame:
    """Citations (chunk_id, file_id, content_hash) whose chunk still stands in the file with the same content."""
    return citations.join(chunks.select("chunk_id", "file_id", "content_hash").distinct(), ["chunk_id", "file_id", "content_hash"])
