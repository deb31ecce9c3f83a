"""Five stages from raw documents to a training mix.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes what a stage returns as Parquet into the shared
folder and reads it again as the next one's documents. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import held_apart, materialize, small, table
from corpusloom.llm.contamination import contaminated
from corpusloom.llm.language_id import UNDETERMINED, identify_languages
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.near_dedup import near_duplicates
from corpusloom.llm.toxicity import reject_toxic

#: Phrases a symbol above which a text isn't in any known language: prose needs 0.12 to 0.35 of its own language.
MOST_PHRASES = 0.5


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier chain takes for toxic. Null and empty texts stay; without labels all stay. Other columns are kept."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those that need too many phrases in every known language. An empty table gives an empty one."""
    held, back = held_apart(docs)
    found = identify_languages(held, docs.select("doc_id", "text", "lang"))
    return back(found.filter((F.col("lang_pred") != UNDETERMINED) & (F.col("phrase_rate") <= MOST_PHRASES)))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near-duplicates the document with the least id, of rows equal in id and text one. Rows without an id all
    stay, and a column of any name is kept; an empty table gives an empty one."""
    found = near_duplicates(docs).filter("doc_id is not null")
    gone = found.filter(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(small(materialize(gone, "duplicates")), "doc_id", "left_anti").select(*docs.columns)
    if docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return kept
    return kept.filter("doc_id is null").union(kept.filter("doc_id is not null").dropDuplicates(["doc_id", "text"]))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item. A row is known by its id and a hash of its text, so each row without an id, or with a repeated one, stands for itself."""
    found = contaminated(docs.select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    leaks = small(materialize(found.select(F.col("doc_id").alias("leak_id"), "text_key").distinct(), "leaks"))
    return docs.join(leaks, docs["doc_id"].eqNullSafe(leaks["leak_id"]) & (F.xxhash64(docs["text"]) == leaks["text_key"]), "left_anti")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that sources meet their target weights, in shuffled order."""
    return mix_sources(docs)


STAGES = [("toxicity", toxicity), ("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("mixing", mixing)]

#: The trained stages have no SQL; tests/llm holds each stage against a brute-force version, and the trained ones against their labels.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
