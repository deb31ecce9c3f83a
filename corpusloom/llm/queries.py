"""The queries opN_<name>: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.common import fold, table
from corpusloom.llm.contamination import contaminated
from corpusloom.llm.fingerprints import fingerprint_documents
from corpusloom.llm.language_id import identify_languages
from corpusloom.llm.license_scan import scan_licenses
from corpusloom.llm.lm_scoring import score_texts
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.near_dedup import near_duplicates
from corpusloom.llm.oracles import ORACLES
from corpusloom.llm.periodic_runs import runs_query
from corpusloom.llm.quality import quality_query
from corpusloom.llm.repeats import remove_repeats
from corpusloom.llm.token_alignment import alignment_query
from corpusloom.llm.toxicity import CATEGORIES, category_labels, score_toxicity
from corpusloom.llm.warc import archive_folder, read_archives, write_archives

__all__ = ["ORACLES", "QUERIES"]


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log-probability of every document under a backoff automaton trained on six sevenths of them."""
    docs = table(spark, sf_dir, "documents")
    return score_texts(docs.withColumn("held_out", fold("doc_id", 7, 2)))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    return quality_query(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity categories of every document, and whether the pipeline would reject it."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_toxicity(docs.select("doc_id", "text"), category_labels(docs, labels), CATEGORIES)
    return scored.drop("text").withColumn("toxic", F.col("p_toxic") >= 0.5)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to dictionary-compressed archives and read back."""
    manifest = write_archives(table(spark, sf_dir, "pages"), archive_folder(spark))
    return read_archives(spark, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items contained in documents."""
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_key")


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, by automata of three quarters of them."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", fold("doc_id", 4, 2).alias("held_out"))
    labelled = docs.filter(~F.col("held_out")).select("doc_id", "text", "lang")
    return identify_languages(docs.drop("lang"), labelled).drop("text")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases and notices in every document."""
    return scan_licenses(table(spark, sf_dir, "documents"))


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    return fingerprint_documents(table(spark, sf_dir, "documents"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole corpus mixed to target weights."""
    return mix_sources(table(spark, sf_dir, "documents"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of a byte-level and of a piece tokenizer aligned in every document, with corpus-wide counts of their links."""
    return alignment_query(table(spark, sf_dir, "documents"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows of 35 words that also occur elsewhere."""
    cut = remove_repeats(table(spark, sf_dir, "documents"), kept=F.sha2("kept_text", 256).alias("kept_sha256"))
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, one document in ten with a planted tail."""
    return runs_query(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_lm_score, op2_quality, op3_toxicity, op4_warc, op5_contamination, op6_language_id, op7_license_scan, op8_fingerprints, op9_mixing, op10_near_dedup, op11_token_alignment, op12_substring_dedup, op13_periodic_runs)
}
