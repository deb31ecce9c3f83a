"""Changed files through extraction and chunking into the chunk table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.functions import text as T
from corpusloom.operators import lifecycle
from corpusloom.operators.chunking import chunk_documents
from corpusloom.sources import extract as X

WINDOWED = {"text": X.text_elements, "markdown": X.markdown_elements, "code": X.code_elements}


def extract_all(files: DataFrame, branches: list[str] | None = None) -> DataFrame:
    """Elements of routed files (file_id, text, branch), each by its branch; branches: those that files can have, if not all."""
    out = None
    for branch in branches or [*WINDOWED, *X.EXTRACTORS]:
        part = files.filter(F.col("branch") == branch)
        e = WINDOWED[branch](part) if branch in WINDOWED else X.parsed_elements(part, branch).withColumn("line_start", F.col("elem_idx")).withColumn("line_end", F.col("elem_idx"))
        e = e.select("file_id", "elem_idx", "type", "level", "text", "line_start", "line_end")
        out = e if out is None else out.unionByName(e)
    return out


def incremental_index(files: DataFrame, chunks: DataFrame, *, parser: str = "1", chunker: str = "1") -> DataFrame:
    """The chunk table after the present files (file_id, text, extension, sha256): files whose hash and versions are unchanged keep their chunks, changed ones are
    extracted and chunked anew, chunks of files that are gone go. chunks: file_id, chunk_index, chunk_id, content, source_sha256, parser_version, chunker_version.

    Chunk ids come from the contents, so a batch that runs again gives the same table.
    """
    plan = lifecycle.reindex_plan(files, chunks, parser, chunker).filter("reparse").select("file_id")
    changed = X.route(files.join(plan, "file_id", "left_semi")).filter("branch is not null")
    new = chunk_documents(extract_all(changed)).join(files.select("file_id", F.col("sha256").alias("source_sha256")), "file_id")
    new = new.select("file_id", "chunk_index", "chunk_id", "content", "source_sha256", F.lit(parser).alias("parser_version"), F.lit(chunker).alias("chunker_version"))
    kept = chunks.join(files.select("file_id"), "file_id", "left_semi").join(plan, "file_id", "left_anti")
    return kept.select(*new.columns).unionByName(new)


INDEX = "file_id string, chunk_index int, chunk_id string, content string, source_sha256 string, parser_version string, chunker_version string, embedding array<float>, batch_id long, bucket int"


def indexed_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunks of an index folder, each with its vector and the number of the batch that made it."""
    return _index(spark, path).filter("chunk_id is not null").drop("bucket")


def _index(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(INDEX).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], INDEX)


def index_batch(batch: DataFrame, path: str, batch_id: int, *, buckets: int = 64, parser: str = "1", chunker: str = "1", embed: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Write the chunks and vectors of a batch of files (file_id, text, extension, sha256, deleted, seq) into an index folder, in one commit.

    Of a file's rows the one with the greatest seq counts. Files whose hash and versions are unchanged keep their rows; changed ones are extracted, chunked and
    embedded anew; of deleted ones all rows go, and of those that no parser takes. Files are dealt into buckets by a hash of their id, and only the
    buckets of the batch's files are read and overwritten, all at once by a dynamic partition overwrite. A bucket that has lost its last file keeps a row without a chunk, so that it is
    overwritten too. A batch that runs again finds its own hashes, changes nothing and writes equal rows. embed: chunks (chunk_id, content) to (chunk_id, embedding).
    """
    spark = batch.sparkSession
    columns = ["file_id", "text", "extension", "sha256", "deleted"]
    files = batch.groupBy("file_id").agg(F.max_by(F.struct(*columns[1:]), "seq").alias("f")).select("file_id", "f.*")
    files = files.withColumn("bucket", F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int"))
    touched = [r.bucket for r in files.select("bucket").distinct().collect()]
    if not touched:
        return
    old = _index(spark, path).filter(F.col("bucket").isin(touched) & F.col("chunk_id").isNotNull())
    present = files.filter(~F.coalesce("deleted", F.lit(False)))
    plan = lifecycle.reindex_plan(present, old, parser, chunker).filter("reparse").select("file_id")
    changed = X.route(present.join(plan, "file_id", "left_semi")).persist()
    branches = [r.branch for r in changed.select("branch").distinct().collect() if r.branch]
    chunks = chunk_documents(extract_all(changed.filter("branch is not null"), branches)).select("file_id", "chunk_index", "chunk_id", "content").persist()
    vectors = (embed or hashing_embedder)(chunks.select("chunk_id", "content")).dropDuplicates(["chunk_id"])
    new = chunks.join(vectors, "chunk_id", "left").join(changed.select("file_id", F.col("sha256").alias("source_sha256"), "bucket"), "file_id")
    new = new.withColumn("parser_version", F.lit(parser)).withColumn("chunker_version", F.lit(chunker)).withColumn("batch_id", F.lit(batch_id).cast("long"))
    gone = changed.select("file_id").union(files.filter("deleted").select("file_id"))
    names = [c.split()[0] for c in INDEX.split(", ")]
    marks = files.select("bucket").distinct().select(*[F.col(c) if c == "bucket" else F.lit(None).cast(t).alias(c) for c, t in (x.split(" ") for x in INDEX.split(", "))])
    rows = old.join(gone, "file_id", "left_anti").select(*names).unionByName(new.select(*names)).unionByName(marks)
    rows.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    chunks.unpersist()
    changed.unpersist()


def run_index(source: DataFrame, checkpoint: str, path: str, **options) -> StreamingQuery:
    """Start a query that brings the files of a stream (see index_batch) into an index folder, micro-batch by micro-batch; it ends when all that is there is done."""
    return source.writeStream.foreachBatch(lambda batch, i: index_batch(batch, path, i, **options)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hashing_embedder(chunks: DataFrame, dimension: int = 384) -> DataFrame:
    """(chunk_id, embedding): the offline embedder. Words are hashed to places with a sign, counted, damped and normalised; any pandas UDF from text to floats can take its place."""
    words = chunks.select("chunk_id", F.explode(T.tokenize(F.col("content"))).alias("w")).groupBy("chunk_id", F.pmod(F.xxhash64("w"), F.lit(dimension)).cast("int").alias("i")).agg(F.sum(F.when(F.pmod(F.xxhash64("w", F.lit("sign")), F.lit(2)) == 0, 1.0).otherwise(-1.0)).alias("v"))
    damped = words.select("chunk_id", "i", (F.signum("v") * F.log1p(F.abs("v"))).alias("v"))
    m = damped.groupBy("chunk_id").agg(F.map_from_entries(F.collect_list(F.struct("i", "v"))).alias("m"), F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("norm"))
    value = lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)) / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0)
    return m.select("chunk_id", F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: value(i).cast("float")).alias("embedding"))
