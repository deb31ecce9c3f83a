"""Evidence of groups of files within a token budget: comparison, synthesis, folders."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.operators import context
from corpusloom.operators import summary as S

CONTEXT = ("status", "used", "included", "omitted")


def _contexts(groups: DataFrame, items: DataFrame, key: str, budget: dict[str, int]) -> DataFrame:
    """(key, status, used, included, omitted) of all groups (key, valid); items: key, rank, chunk_id, content. Groups that aren't valid get the status INVALID and no evidence."""
    done = context.build_context(items.withColumnRenamed(key, "query_id"), **budget).withColumnRenamed("query_id", key)
    none = {c: F.array().cast(dict(done.dtypes)[c]) for c in ("included", "omitted")}
    out = groups.join(done, key, "left")
    status = F.when(~F.col("valid"), "INVALID").otherwise(F.coalesce("status", F.lit("BUDGET_LIMITED")))
    return out.select(key, status.alias("status"), F.coalesce("used", F.lit(0)).alias("used"), *[F.coalesce(c, empty).alias(c) for c, empty in none.items()])


def _evidence(requests: DataFrame, chunks: DataFrame, n: int) -> DataFrame:
    """(group_id, rank, chunk_id, content): n chunks of each requested file (group_id, file_id, place), in the order of the request."""
    mine = chunks.join(requests.select("file_id").distinct(), "file_id", "left_semi")
    rows = S.strided(mine, n).select("file_id", "chunk_index", "chunk_id", "content").join(requests, "file_id")
    rank = F.row_number().over(W.partitionBy("group_id").orderBy("place", "chunk_index"))
    return rows.select("group_id", rank.alias("rank"), "chunk_id", "content")


def compare_groups(requests: DataFrame, chunks: DataFrame, *, n: int = 4, least: int = 2, most: int = 5, **budget: int) -> DataFrame:
    """(group_id, status, used, included, omitted): the evidence to compare the files of each group, n chunks a file taken at even steps, within a token budget (see
    build_context). requests: group_id, file_id, place. A group of fewer than `least` or more than `most` different files is INVALID."""
    first = requests.groupBy("group_id", "file_id").agg(F.min("place").alias("place"))
    groups = first.groupBy("group_id").agg(F.count(F.lit(1)).between(least, most).alias("valid"))
    valid = first.join(groups.filter("valid"), "group_id", "left_semi")
    return _contexts(groups, _evidence(valid, chunks, n), "group_id", budget)


def synthesize_groups(requests: DataFrame, chunks: DataFrame, *, n: int = 3, most: int = 10, **budget: int) -> DataFrame:
    """(group_id, status, used, included, omitted): as compare_groups, of the first `most` different files of each group in the order of the request, n chunks a file."""
    first = requests.groupBy("group_id", "file_id").agg(F.min("place").alias("place"))
    order = F.row_number().over(W.partitionBy("group_id").orderBy("place", "file_id"))
    taken = first.withColumn("order", order).filter(F.col("order") <= most).select("group_id", "file_id", "place")
    groups = taken.select("group_id", F.lit(True).alias("valid")).distinct()
    return _contexts(groups, _evidence(taken, chunks, n), "group_id", budget)


def folder_contexts(files: DataFrame, insights: DataFrame, chunks: DataFrame, *, top: int = 5, n: int = 2, **budget: int) -> DataFrame:
    """(folder_id, status, used, included, omitted): of each folder the representative files' summaries (insights: file_id, summary), each followed by the first n chunks of its
    file, within a token budget. A summary's chunk_id is `summary:` and the file's id."""
    r = S.representative_files(files, insights, chunks, top).select("folder_id", "file_id", F.col("rank").alias("of"))
    told = r.join(insights.select("file_id", "summary"), "file_id").select("folder_id", "of", F.lit(-1).alias("at"), F.concat(F.lit("summary:"), "file_id").alias("chunk_id"), F.col("summary").alias("content"))
    cut = r.join(S.first_n(chunks, "file_id", "chunk_index", n).select("file_id", "chunk_index", "chunk_id", "content"), "file_id").select("folder_id", "of", F.col("chunk_index").alias("at"), "chunk_id", "content")
    rank = F.row_number().over(W.partitionBy("folder_id").orderBy("of", "at"))
    items = told.union(cut).select("folder_id", rank.alias("rank"), "chunk_id", "content")
    return _contexts(r.select("folder_id", F.lit(True).alias("valid")).distinct(), items, "folder_id", budget)
