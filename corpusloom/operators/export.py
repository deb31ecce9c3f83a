"""Conversations and evidence as text."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def conversation_markdown(messages: DataFrame, title: Column) -> DataFrame:
    who = F.when(F.col("role") == "user", "User").otherwise("Assistant")
    rows = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", F.concat(F.lit("**"), who, F.lit("**: "), "text").alias("line")))).alias("m"))
    return rows.select("conv_id", F.concat(F.lit("# "), title, F.lit("\n\n"), F.array_join(F.transform("m", lambda x: x["line"]), "\n\n")).alias("markdown"))


def conversation_json(messages: DataFrame) -> DataFrame:
    m = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("messages"))
    return m.select("conv_id", F.to_json(F.struct("conv_id", "messages")).alias("json"))


@F.pandas_udf(StringType())
def three_places(scores: pd.Series) -> pd.Series:
    """As C prints %.3f: by the exact value of the double, halves to even. Java's format rounds the shortest decimal form up."""
    return scores.map(lambda x: f"{x:.3f}")


def search_markdown(found: DataFrame, queries: DataFrame, score: str) -> DataFrame:
    """(query_id, markdown): the evidence of each query in order; a null score prints as Unranked. found: query_id, rank, source, score, snippet."""
    shown = F.when(F.col(score).isNull(), "Unranked").otherwise(three_places(F.col(score)))
    item = F.concat(F.lit("## "), F.col("rank").cast("string"), F.lit(". "), "source", F.lit(" (score: "), shown, F.lit(")\n\n"), "snippet")
    rows = found.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", item.alias("item")))).alias("r"))
    return rows.join(queries.select("query_id", "query"), "query_id").select("query_id", F.concat(F.lit("# Search: "), "query", F.lit("\n\n"), F.array_join(F.transform("r", lambda x: x["item"]), "\n\n")).alias("markdown"))


def conversation_text(messages: DataFrame, title: Column) -> DataFrame:
    """(conv_id, transcript): plain text. messages: conv_id, turn, role, text, citations array<struct<mark, source_file, section>>; an answer is followed by the marks that it
    cites, and the sources stand below, each mark once, in the order of their first use."""
    marks = F.array_join(F.transform("citations", lambda c: F.concat(F.lit(" ["), c["mark"], F.lit("]"))), "")
    line = F.concat(F.upper("role"), F.lit(": "), "text", marks)
    rows = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", line.alias("line"), "citations"))).alias("m"))
    cited = F.array_distinct(F.flatten(F.transform("m", lambda x: x["citations"])))
    note = lambda c: F.concat(F.lit("["), c["mark"], F.lit("] "), c["source_file"], F.when(F.coalesce(c["section"], F.lit("")) != "", F.concat(F.lit(", "), c["section"])).otherwise(""))
    notes = F.when(F.size(cited) > 0, F.concat(F.lit("\n\nSources:\n"), F.array_join(F.transform(cited, note), "\n"))).otherwise("")
    return rows.select("conv_id", F.concat(title, F.lit("\n\n"), F.array_join(F.transform("m", lambda x: x["line"]), "\n\n"), notes).alias("transcript"))
