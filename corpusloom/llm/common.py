"""Helpers that the training-data operators share."""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; an own temporary one only where that is unset and the master is local."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
        path = _OWN.setdefault("dir", tempfile.mkdtemp(prefix="corpusloom-"))
    return path.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it again: cuts the lineage, and what follows survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, keys: list[str], buckets: int) -> DataFrame:
    """As materialize, but in buckets of the keys (100 000 at most), so that later joins on them don't shuffle it again."""
    spark, table_name = df.sparkSession, f"{name}_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(min(buckets, 100_000), *keys).option("path", f"{shared_dir(spark)}/{table_name}").saveAsTable(table_name)
    return spark.table(table_name)


def fresh(name: str, *taken: DataFrame) -> str:
    """name, lengthened until none of the tables has such a column, in any case."""
    have = {c.lower() for df in taken for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of df but those with these names, in any case."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


def held_apart(docs: DataFrame) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """docs with its text and, in one column, all else, so that no name can clash with what an operator adds; and how to bring back the columns as they were."""
    own = fresh("held", docs)
    rest = docs.select("text", F.struct(*[F.col(c) for c in others(docs, "text")]).alias(own))
    return rest, lambda df: df.select(*[F.col("text").alias(c) if c.lower() == "text" else F.col(own)[c].alias(c) for c in docs.columns])


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def corpus_size(docs: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and bytes of the texts, for sizing partitions; never for results."""
    row = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()
    return int(row[0]), int(row[1])


def parts_for(spark: SparkSession, size: int, bytes_per_part: int) -> int:
    """As many partitions as hold bytes_per_part each, and no fewer than spark.sql.shuffle.partitions."""
    return max(shuffle_partitions(spark), math.ceil(size / bytes_per_part))


def fold(doc_id: str | Column, n: int, k: int) -> Column:
    """True where crc32(doc_id as text) mod n is k; false for a null id."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(col.cast("string").cast("binary")) % n == k, F.lit(False))


def draw(rows: DataFrame, max_rows: int) -> DataFrame:
    """All rows of (doc_id, ...), or a draw of about max_rows of them by a hash of their id, with a hard bound of twice that: small enough to broadcast."""
    n = rows.count()
    if n > max_rows:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("draw")), F.lit(1 << 30)) < int((1 << 30) * max_rows / n))
    return rows.limit(2 * max_rows)


def small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """df (some numbers a row) with a broadcast hint if it has at most so many rows: counted, not assumed; else as it is, to be joined by shuffling."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
