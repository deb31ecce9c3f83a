"""The driver's tables, and the corpus tables (files, paragraphs, insights) that stand on them, for Spark and for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

STATUSES = ["DISCOVERED", "QUEUED", "PROCESSING", "INDEXED", "FAILED", "SKIPPED", "MISSING"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: file_id, folder_id, filename, extension, relative_path, path, size_bytes, modified_at, sha256, index_status."""
    d, marks = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    name = F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"), F.lit("."), F.col("lang"))
    status = F.when(F.col("quality") == 0, "FAILED").when(F.col("toxic") == 1, "SKIPPED").when(F.col("quality") == 1, "INDEXED").otherwise("QUEUED")
    return d.join(marks, "doc_id", "left").select(
        F.col("doc_id").cast("string").alias("file_id"),
        F.col("source").alias("folder_id"),
        name.alias("filename"),
        F.concat(F.lit("."), F.col("lang")).alias("extension"),
        F.concat(F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), name).alias("relative_path"),
        F.concat(F.lit("/corpus/"), F.col("lang"), F.lit("/"), F.col("source"), F.lit("/"), name).alias("path"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 7919 % 864000).alias("modified_at"),
        F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
        status.alias("index_status"),
    )


FILES = """files AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS file_id, source AS folder_id, concat(source, '_', d.doc_id, '.', lang) AS filename, concat('.', lang) AS extension,
    concat(lang, '/', source, '/', source, '_', d.doc_id, '.', lang) AS relative_path, concat('/corpus/', lang, '/', source, '/', source, '_', d.doc_id, '.', lang) AS path,
    strlen(text) AS size_bytes, TIMESTAMP '2024-01-01' + to_seconds(d.doc_id * 7919 % 864000) AS modified_at, sha256(text) AS sha256,
    CASE WHEN quality = 0 THEN 'FAILED' WHEN toxic = 1 THEN 'SKIPPED' WHEN quality = 1 THEN 'INDEXED' ELSE 'QUEUED' END AS index_status
  FROM documents d LEFT JOIN labels USING (doc_id))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents by line, as chunks: file_id, chunk_id, chunk_index (from 0), folder_id, extension, content."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").cast("string").alias("file_id"), F.col("source").alias("folder_id"), F.concat(F.lit("."), F.col("lang")).alias("extension"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "content")
    ).select("file_id", F.concat("file_id", F.lit(":"), F.col("chunk_index").cast("string")).alias("chunk_id"), "chunk_index", "folder_id", "extension", "content")


LINES = """lines AS (
  SELECT file_id, concat(file_id, ':', i - 1) AS chunk_id, CAST(i - 1 AS INTEGER) AS chunk_index, folder_id, extension, parts[i] AS content
  FROM (SELECT CAST(doc_id AS VARCHAR) AS file_id, source AS folder_id, concat('.', lang) AS extension, string_split(text, chr(10)) AS parts FROM documents),
    LATERAL unnest(range(1, len(parts) + 1)) AS t(i))"""


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insights of the indexed files: file_id, folder_id, topics (the five first distinct words of over six letters), updated_at."""
    d = table(spark, sf_dir, "documents")
    words = F.filter(F.array_distinct(F.split(F.lower("text"), r"[^a-z]+")), lambda w: F.length(w) > 6)
    return d.select(F.col("doc_id").cast("string").alias("file_id"), F.col("source").alias("folder_id"), F.slice(words, 1, 5).alias("topics"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 104729 % 864000).alias("updated_at"))


TOPICS = """insights AS (
  SELECT CAST(doc_id AS VARCHAR) AS file_id, source AS folder_id, firsts[1:5] AS topics, TIMESTAMP '2024-01-01' + to_seconds(doc_id * 104729 % 864000) AS updated_at
  FROM (SELECT doc_id, source, (SELECT list(w ORDER BY i) FROM (SELECT w, min(i) AS i FROM (SELECT unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS i) WHERE length(w) > 6 GROUP BY w)) AS firsts
    FROM (SELECT doc_id, source, regexp_split_to_array(lower(text), '[^a-z]+') AS ws FROM documents)))"""
