"""Mixing sources to target weights by Poisson replication.

A source that has the share a of all characters and shall have the share t is repeated at the mean rate t / a. Each document
draws its count of copies from the Poisson distribution with that mean, by inverting its distribution function at a uniform
number made from a hash of the document's id and a seed: the same document gets the same count in every run, wherever it is
processed, and no source needs a second look. Documents are exploded by their counts, and the copies are dealt to partitions
by a hash of their own and sorted by it in each, a global shuffle that no single task sees.

Only DataFrame functions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh, materialize, others, shuffle_partitions

STEP = 16.0  # a mean above is split, as e ** -mean must not vanish
MOST_SOURCES = 200_000  # the rates of so many are broadcast; of more, joined by shuffling
MOST = 80  # P(X > 80) is below 1e-30 for a mean of 16


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) of 52 bits from the MD5 of the parts."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def poisson_count(mean: Column, *key: Column) -> Column:
    """Poisson(mean), inverted at the uniform number of the key; a large mean is a sum of independent draws with means of STEP at most."""

    def invert(m: Column, u: Column) -> Column:
        start = F.struct(F.lit(0).alias("n"), F.exp(-m).alias("p"), F.exp(-m).alias("cdf"))
        step = lambda s, i: F.when(u < s["cdf"], s).otherwise(F.struct((s["n"] + 1).alias("n"), (s["p"] * m / i).alias("p"), (s["cdf"] + s["p"] * m / i).alias("cdf")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(MOST)), start, step, lambda s: s["n"])

    draws = F.greatest(F.lit(1), F.ceil(mean / STEP)).cast("int")
    return F.aggregate(F.sequence(F.lit(1), draws), F.lit(0), lambda total, i: total + invert(mean / draws, uniform(*key, i)))


def source_rates(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, mean: float = 1.0) -> DataFrame:
    """(source, chars, rate): the mean repetition of each source's documents, such that all of them together keep mean times their
    characters. Target shares are in proportion to weights (0 for sources not named), or, without weights, to each source's
    characters to the given power. One row a source."""
    sizes = docs.groupBy("source").agg(F.sum(F.greatest(F.length(F.coalesce("text", F.lit(""))), F.lit(1))).cast("double").alias("chars"))
    if weights is None:
        want = F.pow("chars", F.lit(power))
    else:
        want = F.coalesce(F.element_at(F.create_map(*[x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]), F.col("source")), F.lit(0.0))
    sizes = sizes.withColumn("want", want)
    total = sizes.agg(F.struct(F.sum("chars").alias("chars"), F.sum("want").alias("want"))).scalar()
    return sizes.select("source", "chars", F.round(mean * F.col("want") / total["want"] * total["chars"] / F.col("chars"), 6).alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, *, power: float = 0.5, mean: float = 1.0, seed: int = 7, part_chars: int = 64 << 20) -> DataFrame:
    """docs with each row repeated by its count, and columns copy (from 1) and rate added, in shuffled order.

    Rows with a null source form a source of their own; with weights they need the weight of none, so are left out. Rows with equal
    ids get the same count; rows without an id draw by their text. A null text counts as one character of its source. Columns named
    copy or rate are replaced, others kept, whatever their names. The result has a partition for each part_chars characters or more.
    """
    kept = others(docs, "copy", "rate")
    rates = materialize(source_rates(docs, weights, power, mean), "source-rates")
    sources, chars = rates.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("chars") * F.col("rate")), F.lit(0.0))).first()
    own, rate, copies = (fresh(name, docs) for name in ("own_source", "own_rate", "copies"))
    rates = rates.select(F.col("source").alias(own), F.col("rate").alias(rate))
    if sources <= MOST_SOURCES:
        rates = F.broadcast(rates)
    key = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    rated = docs.select(*kept).join(rates, F.col("source").eqNullSafe(F.col(own)))
    counted = rated.withColumn(copies, poisson_count(F.col(rate), key, F.lit(seed))).filter(F.col(copies) > 0)
    out = counted.select(*kept, F.explode(F.sequence(F.lit(1), F.col(copies))).alias("copy"), F.col(rate).alias("rate"))
    order = F.xxhash64(key, "copy", F.lit(seed))
    parts = max(shuffle_partitions(docs.sparkSession), math.ceil(chars / part_chars))
    return out.repartition(parts, order).sortWithinPartitions(order)
