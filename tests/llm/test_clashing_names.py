"""Columns whose names differ only in case from those that an operator adds."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm.language_id import identify_languages
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.quality import score_quality
from corpusloom.llm.toxicity import CATEGORIES, category_labels, score_toxicity

EXTRA = ["Score", "Predicted", "Lang_Pred", "PHRASE_RATE", "P_TOXIC", "Copy", "RATE", "Judged", "Text_Key", "Leak_Id", "KEPT"]


@pytest.fixture(scope="module")
def clashing(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    return docs.select("*", *[F.lit("x").alias(c) for c in EXTRA])


@pytest.fixture(scope="module")
def labels(spark, data):
    return spark.read.parquet(f"{data}/labels.parquet")


def names(df):
    low = [c.lower() for c in df.columns]
    assert len(low) == len(set(low))
    return set(df.columns)


def test_operators(clashing, labels):
    assert {"score", "predicted", "Copy"} <= names(score_quality(clashing, labels)) and score_quality(clashing, labels).filter("score >= 0").count() == clashing.count()
    tox = score_toxicity(clashing, category_labels(clashing, labels), CATEGORIES)
    assert {"p_toxic", "Score"} <= names(tox) and tox.filter("p_toxic >= 0").count() == clashing.count()
    lang = identify_languages(clashing, clashing)
    assert {"lang_pred", "phrase_rate", "P_TOXIC"} <= names(lang) and lang.filter("score >= 0").count() == clashing.count()
    mixed = mix_sources(clashing)
    assert {"copy", "rate", "Score"} <= names(mixed) and mixed.filter("copy > 0").count() == mixed.count() > 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_keep_all_columns(spark, clashing, data, name):
    out = dict(corpus_pipeline.STAGES)[name](spark, clashing, data)
    if name != "mixing":
        assert out.columns == clashing.columns
    row = out.select(*[c for c in EXTRA if c.lower() not in ("copy", "rate")]).first()
    assert set(row) == {"x"}
