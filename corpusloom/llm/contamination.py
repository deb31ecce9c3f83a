"""Benchmark decontamination: which short items stand inside which documents.

Containment search by MinHash with the items' sizes as partitions. Jaccard similarity of a short item and a long document is
tiny even if the item stands in it whole, so signatures aren't compared slot by slot; an item is represented by min-wise
samples of its own shingles (anchors), and each anchor is looked up among all shingles of a document. Items are partitioned by
the power of two of their size; all items of a partition take as many anchors as its largest size needs to be found for
certain: a document with a share t of n shingles can lack at most n - ceil(t * n) of them, so one anchor more can't all be
lacking. Documents that are too short for the item's size are no candidates. The candidates, pairs of a document and an item,
are verified by exact containment of the item's whole set of shingles.

Only DataFrame functions. Items are numbered; an anchor is joined as a hash and a number. A document's shingles are joined without its words, and the
pairs found are distinct before they are verified. Anchors and the items' sets are broadcast while they are counted to be few, so the
documents are read where they are; pairs are joined with the documents likewise. Else all are joined by shuffling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import materialize, small

SHINGLE = 5
DOCUMENT = ["doc_id", "text_key"]


def content_words(text: str | Column) -> Column:
    """Lower-cased runs of letters and digits; an empty array for null."""
    col = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(col, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def _hashes(words: str, width: int) -> Column:
    """Hashes of all runs of width words, in order; empty if there are fewer words."""
    last = F.size(words) - width
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(F.col(words), i + j) for j in range(width)]))).otherwise(F.array().cast("array<bigint>"))


def _item_sets(items: DataFrame) -> DataFrame:
    """(item_id, item_size, item_grams): distinct shingles by a hash rank; an item of fewer than five words is one shingle of all its words."""
    words = items.select("item_id", content_words("text").alias("words")).filter(F.size("words") > 0).distinct()
    by_width = F.when(F.size("words") >= SHINGLE, F.array_distinct(_hashes("words", SHINGLE)))
    for width in range(1, SHINGLE):
        by_width = by_width.when(F.size("words") == width, _hashes("words", width))
    ranked = F.array_sort(F.transform(by_width.otherwise(F.array().cast("array<bigint>")), lambda h: F.struct(F.xxhash64(h, F.lit("rank")).alias("rank"), h.alias("hash"))))
    return words.select("item_id", F.transform(ranked, lambda r: r["hash"]).alias("item_grams")).withColumn("item_size", F.size("item_grams"))


def _anchors(sets: DataFrame, threshold: float) -> DataFrame:
    """(number, least_words, hash): of each item the anchors that its size partition needs, and how many words a document must have."""
    largest = F.pow(F.lit(2), F.floor(F.log2("item_size")) + 1).cast("int") - 1
    need = largest - F.ceil(F.lit(threshold) * largest).cast("int") + 1
    least = F.ceil(F.lit(threshold) * F.col("item_size")).cast("int").alias("least_words")
    return sets.select("number", least, F.explode(F.slice("item_grams", F.lit(1), F.least(need, F.col("item_size")))).alias("hash"))


def _grams(short: bool) -> Column:
    """Hashes of a document's shingles, from its words; of shorter runs too if there are short items. Always written out, never a column of its own: Spark
    would put an exploded column into a filter, and there cut the words anew for every place."""
    return F.concat(*[_hashes("words", w) for w in range(SHINGLE, 0, -1)]) if short else _hashes("words", SHINGLE)


def candidates(docs: DataFrame, items: DataFrame, *, threshold: float = 0.75, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Pairs that share an anchor, each once: doc_id, text_key, item_id, item_size, shared."""
    sets = materialize(_item_sets(items.select("item_id", "text")).withColumn("number", F.monotonically_increasing_id()), "items")
    rows, least = sets.agg(F.coalesce(F.sum("item_size"), F.lit(0)), F.min("item_size")).first()
    few = F.broadcast if rows <= broadcast_rows else lambda df: df
    grams = _grams(least == 1)
    words = docs.select("doc_id", F.xxhash64("text").alias("text_key"), content_words("text").alias("words"))
    found = words.select(*DOCUMENT, F.size("words").alias("n_words"), F.explode(grams).alias("hash"))
    met = found.join(few(_anchors(sets, threshold)), "hash").filter("n_words >= least_words").select(F.col("doc_id").alias("d"), F.col("text_key").alias("k"), "number").distinct()
    met = materialize(met, "candidates")
    again = words.join(small(met), F.col("d").eqNullSafe(F.col("doc_id")) & (F.col("k") == F.col("text_key"))).select(*DOCUMENT, "words", "number")
    pairs = again.join(few(sets), "number")
    return pairs.select(*DOCUMENT, "item_id", "item_size", F.size(F.array_intersect("item_grams", grams)).cast("long").alias("shared"))


def contaminated(docs: DataFrame, items: DataFrame, *, threshold: float = 0.75, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Pairs with containment of the item's distinct 5-word shingles in the document of at least threshold:
    doc_id, text_key, item_id, item_shingles, shared, containment.

    Words are lower-cased runs of letters and digits. An item of fewer than five words is one shingle of its length. Null and
    wordless texts match nothing. A document is told by its id and text_key, the xxhash64 of its text: rows equal in both are one
    document, others with the same id, or with none, are judged each on its own; so are items. Other columns are
    ignored. Empty tables give an empty result.
    """
    found = candidates(docs, items, threshold=threshold, broadcast_rows=broadcast_rows).distinct().withColumn("item_shingles", F.col("item_size").cast("long")).drop("item_size")
    return found.filter(F.col("shared") >= F.lit(threshold) * F.col("item_shingles")).withColumn("containment", F.round(F.col("shared") / F.col("item_shingles"), 6))
