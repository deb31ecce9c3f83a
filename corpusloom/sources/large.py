"""Delimited files larger than a task: many tasks read the rows of one file.

A line break inside quotes doesn't end a row, so whether a line begins one depends on all quotes before it. Files are read as lines in blocks (parts of a
file). Each block counts its quotes; a prefix sum over a file's blocks tells each block whether it begins inside quotes, and running sums in a block tell
its lines. The same sums number the rows. Only rows of several lines, and what is needed to put them together, are shuffled by row.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusloom.sources.extract import ROWS_PER_TABLE, markdown_table

DELIMITERS = ",;\t|"


def lines_of_files(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, block, n, content) of text files: file_id is the path, block the byte at which a task's part of it begins, n the order in the part."""
    rows = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file_id"), F.col("_metadata.file_block_start").alias("block"))
    return rows.select("file_id", "block", F.monotonically_increasing_id().alias("n"), F.regexp_replace("value", "\r$", "").alias("content"))


def lines_of_texts(files: DataFrame, lines_a_block: int = 100_000) -> DataFrame:
    """(file_id, block, n, content) of texts in a column (file_id, text)."""
    rows = files.select("file_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("n", "content"))
    return rows.select("file_id", F.floor(F.col("n") / lines_a_block).alias("block"), F.col("n").cast("long").alias("n"), "content")


def _quotes(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit('"'), F.lit("")))


def delimited_records(lines: DataFrame) -> DataFrame:
    """(file_id, record, content): the rows of delimited files (see lines_of_files), numbered from 0, line breaks in quotes kept.

    Blank lines outside quotes are no rows. Quotes that are never closed make the rest of their file one row. A null content is a blank line.
    """
    line = lines.withColumn("content", F.coalesce("content", F.lit(""))).withColumn("quotes", _quotes(F.col("content")))
    blocks = line.groupBy("file_id", "block").agg(F.sum("quotes").alias("sum"))
    before = W.partitionBy("file_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)  # a row a block
    blocks = blocks.select("file_id", "block", (F.coalesce(F.sum("sum").over(before), F.lit(0)) % 2).alias("inside"))
    here = W.partitionBy("file_id", "block").orderBy("n")
    line = line.join(blocks, ["file_id", "block"])
    opened = F.col("inside") + F.coalesce(F.sum("quotes").over(here.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    line = line.withColumn("begins", opened % 2 == 0).filter(~F.col("begins") | (F.trim("content") != ""))
    line = line.withColumn("own", F.count_if("begins").over(here.rowsBetween(W.unboundedPreceding, 0)))
    counts = line.groupBy("file_id", "block").agg(F.count_if("begins").alias("rows"))
    counts = counts.select("file_id", "block", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("earlier"))
    row = line.join(counts, ["file_id", "block"]).withColumn("record", F.col("earlier") + F.col("own") - 1).withColumn("whole", F.col("begins") & (F.col("quotes") % 2 == 0))
    parts = row.filter(~F.col("whole")).groupBy("file_id", "record").agg(F.array_sort(F.collect_list(F.struct("block", "n", "content"))).alias("p"))
    joined = parts.select("file_id", "record", F.array_join(F.transform("p", lambda x: x["content"]), "\n").alias("content"))
    return row.filter("whole").select("file_id", "record", "content").union(joined)


def delimited_cells(records: DataFrame) -> DataFrame:
    """(file_id, record, header, cells) of all rows but the first of each file, whose cells are the header. A file's delimiter is the one of , ; tab and | that its first row has most of."""
    counts = [F.struct(_count(F.col("content"), d).alias("n"), F.lit(len(DELIMITERS) - i).alias("i"), F.lit(d).alias("d")) for i, d in enumerate(DELIMITERS)]
    first = records.filter("record = 0").select("file_id", F.col("content").alias("head"), F.greatest(*counts)["d"].alias("delimiter"))

    @F.pandas_udf("array<string>")
    def cells(content: pd.Series, delimiter: pd.Series) -> pd.Series:
        return pd.Series([next(csv.reader([*_lines(c)], delimiter=d), []) for c, d in zip(content, delimiter, strict=True)])

    rows = records.filter("record > 0").join(first, "file_id")
    return rows.select("file_id", "record", cells("head", "delimiter").alias("header"), cells("content", "delimiter").alias("cells"))


def _count(text: Column, sign: str) -> Column:
    plain = F.regexp_replace(text, '"[^"]*"', "")
    return F.length(plain) - F.length(F.replace(plain, F.lit(sign), F.lit("")))


def _lines(content: str) -> Iterator[str]:
    """A row as the reader wants it: line by line, breaks kept."""
    parts = content.split("\n")
    return (p + "\n" for p in parts[:-1]) if not parts[-1] else iter([p + "\n" for p in parts[:-1]] + [parts[-1]])


def delimited_tables(cells: DataFrame) -> DataFrame:
    """Elements of delimited_cells: tables of 50 rows, each with the header; level is the number of the first row, from 1."""

    @F.pandas_udf("string")
    def table(header: pd.Series, rows: pd.Series) -> pd.Series:
        return pd.Series([markdown_table(list(h), [list(r["cells"]) for r in rs]) for h, rs in zip(header, rows, strict=True)])

    numbered = cells.withColumn("elem_idx", F.floor((F.col("record") - 1) / ROWS_PER_TABLE).cast("int"))
    g = numbered.groupBy("file_id", "elem_idx").agg(F.first("header").alias("header"), F.array_sort(F.collect_list(F.struct("record", "cells"))).alias("rows"))
    return g.select("file_id", "elem_idx", F.lit("TABLE").alias("type"), (F.col("elem_idx") * ROWS_PER_TABLE + 1).alias("level"), table("header", "rows").alias("text"))
