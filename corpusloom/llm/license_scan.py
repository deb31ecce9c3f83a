"""License scans by diagonal voting.

All rolling two-word hashes of a text are joined with the positions that they have in the templates. A hit at word p of the
text and word t of a template votes for the diagonal p - t, where the template would begin. A hit counts if the
words are the same, not their hashes alone. The votes are counted by document, template and diagonal. A phrase whose every pair votes on one diagonal stands there word for word. For notices,
neighbouring diagonals are merged, as an inserted or missing word shifts what follows, and a merged span is verified: it must
hold enough of the template's distinct pairs in little more than the template's length.

Only DataFrame functions; the documents are read once. The join carries the templates, a fixed list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# Wording of public licenses and their usual notices, and their labels.
NOTICES = {
    "gnu general public license version 2": "gpl-2.0",
    "gnu general public license version 3": "gpl-3.0",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "apache license version 2 0": "apache-2.0",
    "mozilla public license version 2 0": "mpl-2.0",
    "cc by 4 0": "cc-by-4.0",
    "cc by sa 4 0": "cc-by-sa-4.0",
    "cc by nc 4 0": "cc-by-nc-4.0",
    "cc by nc sa 4 0": "cc-by-nc-sa-4.0",
    "cc by nd 4 0": "cc-by-nd-4.0",
    "cc0 1 0 universal": "cc0-1.0",
    "released under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit-text",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-text",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc-text",
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLACK = 2  # diagonals that far apart are neighbours


def license_words(text: str | Column) -> Column:
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.translate(F.coalesce(col, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def _pairs(words: str) -> Column:
    """(place, hash) of each pair of neighbouring words."""
    return F.when(
        F.size(words) > 1,
        F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.struct(i.alias("place"), F.xxhash64(F.get(F.col(words), i), F.get(F.col(words), i + 1)).alias("hash"))),
    ).otherwise(F.array().cast("array<struct<place:int,hash:bigint>>"))


def templates(spark, phrases: dict[str, str], notices: dict[str, str]) -> DataFrame:
    """(template, label, base, pairs, least, its_words, place, hash): least is how many distinct pairs a verified span has."""
    rows = [(t, label, base) for found, base in ((phrases, True), (notices, False)) for t, label in found.items()]
    values = F.array(*[F.struct(F.lit(t).alias("template"), F.lit(label).alias("label"), F.lit(base).alias("base")) for t, label, base in rows])
    known = spark.range(1).select(F.explode(values).alias("t")).select("t.*").withColumn("words", F.split("template", " "))
    known = known.withColumn("pairs", F.size("words") - 1)
    least = F.when(F.col("pairs") < 10, F.col("pairs")).otherwise(F.ceil(0.7 * F.col("pairs")))
    return known.select("template", "label", "base", "pairs", least.cast("int").alias("least"), F.col("words").alias("its_words"), F.inline(_pairs("words")))


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None) -> DataFrame:
    """Per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    score is the largest share of a template's pairs that a verified span has (1 for a phrase; 0 without any). Null and empty
    texts have no words. Repeated rows are each returned. Other columns are ignored. Phrases need at least two words.
    """
    known = templates(docs.sparkSession, PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    mark = -1  # a place that stands for the document itself, so that every document has a hit
    itself = docs.sparkSession.range(1).select(*[F.lit(v).alias(c) for c, v in (("template", ""), ("label", ""), ("base", False), ("pairs", 0), ("least", 0))], F.array().cast("array<string>").alias("its_words"), F.lit(mark).alias("place"), F.xxhash64(F.lit("the document")).alias("hash"))
    known = known.unionByName(itself)
    words = docs.select("doc_id", F.xxhash64("text").alias("text_key"), license_words("text").alias("words"))
    length = F.array(F.struct(F.size("words").alias("place"), F.xxhash64(F.lit("the document")).alias("hash")))
    rolled = words.select("doc_id", "text_key", "words", F.inline(F.concat(length, _pairs("words"))))
    same = [F.get("words", F.col("place") + i) == F.get("its_words", F.col("at") + i) for i in (0, 1)]  # word for word, whatever the hash
    hits = rolled.join(F.broadcast(known.withColumnRenamed("place", "at")), "hash").filter((F.col("template") == "") | (same[0] & same[1]))
    keys = ["doc_id", "text_key"]
    # a repeated row doubles its hits: how often is told by its own mark, so places are counted once
    votes = hits.groupBy(*keys, "template", "label", "base", "pairs", "least", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("at"), F.min("place").alias("lo"), F.max("place").alias("hi"), F.count(F.lit(1)).alias("n"))
    marks = F.col("template") == ""
    whole = F.col("base") & (F.size("at") == F.col("pairs"))
    notice = ~F.col("base") & ~marks & (F.size("at") >= F.least(F.lit(2), F.col("pairs")))
    votes = votes.filter(marks | whole | notice)
    line = W.partitionBy(*keys, "template").orderBy("diagonal")
    votes = votes.withColumn("span", F.sum(F.when(F.col("base") | (F.col("diagonal") - F.lag("diagonal").over(line) > SLACK), 1).otherwise(0)).over(line))
    spans = votes.groupBy(*keys, "template", "label", "base", "pairs", "least", "span").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("at")))).alias("found"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.min("diagonal").alias("start"), F.max("n").alias("n")
    )
    spans = spans.filter((F.col("found") >= F.col("least")) & (F.col("hi") - F.col("lo") <= 1.5 * F.col("pairs") + SLACK) | (F.col("template") == ""))
    base, own = F.col("base"), F.col("template") != ""
    join = lambda labels: F.array_join(F.array_sort(labels), ",")
    out = spans.groupBy(*keys).agg(
        F.max(F.when(~own, F.col("start") + mark)).cast("long").alias("n_words"),
        F.count_if(base).alias("n_base"),
        F.min(F.when(base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(base, F.col("start"))).cast("long").alias("last_word"),
        join(F.collect_set(F.when(base, F.col("label")))).alias("base_labels"),
        join(F.collect_set(F.when(own, F.col("label")))).alias("labels"),
        F.coalesce(F.max(F.when(own, F.round(F.least(F.lit(1.0), F.col("found") / F.col("pairs")), 6))), F.lit(0.0)).alias("score"),
        F.max(F.when(~own, F.col("n"))).alias("rows"),
    )
    return out.withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows")))).drop("row", "rows", "text_key")
