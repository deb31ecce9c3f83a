"""Toxicity by a chain of linear classifiers.

The categories are predicted one after the other: each model sees the same marker features and the probabilities that the
models before it gave. In training those probabilities are predicted out of fold, so a later model learns from what it will
see, not from fitted labels.

Features are markers: words, and word beginnings of four to six letters, for inflected and compounded forms. A marker is
chosen for how strongly the number of texts it is in departs from independence with any category (a signed likelihood
ratio), counted by Spark over the whole training sample. A text's feature is 1 if the marker is in it, however long the
text, so that one passage in a long document counts. The models are ridge-penalised logistic regressions.

The training sample is bounded: about max_rows labelled rows, drawn by a hash of their id, of which the driver gets only the
chosen markers in each. Scoring covers whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import draw, fresh, held_apart, materialize, others

WORD = regex.compile(r"\p{L}+")
PREFIXES = (4, 5, 6)


def markers_of(text: str | None) -> set[str]:
    """Distinct lower-case words ("=word"), and beginnings of longer words."""
    found = set()
    for w in set(WORD.findall(text.lower())) if text else ():
        found.add("=" + w)
        for n in PREFIXES:
            if len(w) > n:
                found.add(w[:n])
    return found


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float, steps: int = 30) -> np.ndarray:
    """Weights, the last for the intercept: Newton's method on the penalised likelihood. Equal rows, most of which have no marker at all, count as one with a weight."""
    mark = np.column_stack([x, y]) @ np.random.default_rng(0).random(x.shape[1] + 1)  # equal for equal rows
    _, first, at = np.unique(mark, return_index=True, return_inverse=True)
    times = np.bincount(at)
    x, y = np.column_stack([x[first], np.ones(len(first))]), y[first]
    w = np.zeros(x.shape[1])
    penalty = np.full(len(w), ridge)
    penalty[-1] = 1e-3
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (times * (p - y)) + penalty * w
        hess = (x * (times * p * (1 - p))[:, None]).T @ x + np.diag(penalty)
        move = np.linalg.solve(hess, grad)
        w -= move
        if np.abs(move).max() < 1e-6:
            break
    return w


def _predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass
class Chain:
    categories: list[str]
    markers: list[str]
    weights: list[np.ndarray] = field(default_factory=list)

    def fit(self, x: np.ndarray, labels: np.ndarray, folds: np.ndarray, ridge: float) -> Chain:
        """labels: rows x categories; folds: the fold of each row, for the out-of-fold probabilities."""
        for c in range(labels.shape[1]):
            y = labels[:, c].astype(float)
            self.weights.append(fit_logistic(x, y, ridge))
            ahead = np.empty(len(y))
            for f in np.unique(folds):
                out = folds == f
                ahead[out] = _predict(x[out], fit_logistic(x[~out], y[~out], ridge)) if (~out).any() else y.mean()
            x = np.column_stack([x, ahead])
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        out = np.empty((len(x), len(self.categories)))
        for c, w in enumerate(self.weights):
            out[:, c] = _predict(x, w)
            x = np.column_stack([x, out[:, c]])
        return out

    def predict_texts(self, texts: list[str | None]) -> np.ndarray:
        if not self.weights:
            return np.zeros((len(texts), len(self.categories)))
        at = {m: i for i, m in enumerate(self.markers)}
        out = np.empty((len(texts), len(self.categories)))
        for start in range(0, len(texts), 512):
            part = texts[start : start + 512]
            x = np.zeros((len(part), len(self.markers)))
            for r, t in enumerate(part):
                if t:
                    x[r, [at[m] for m in _known(t, at)]] = 1
            out[start : start + len(part)] = self.predict(x)
        return out


def _known(text: str, at: dict[str, int]) -> set[str]:
    """markers_of(text), of those in at."""
    found = set()
    for w in set(WORD.findall(text.lower())):
        if (m := "=" + w) in at:
            found.add(m)
        for n in PREFIXES:
            if len(w) > n and (m := w[:n]) in at:
                found.add(m)
    return found


def _explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for start in range(0, len(pdf), 64):
            part = pdf.iloc[start : start + 64]
            found = [list(markers_of(t)) for t in part["text"]]
            if any(found):
                yield pd.DataFrame({"marker": [m for f in found for m in f], "labels": [y for y, f in zip(part["labels"], found, strict=True) for _ in f]})


def train_chain(labelled: DataFrame, categories: list[str], *, max_markers: int = 400, min_texts: int = 5, folds: int = 5, ridge: float = 0.05) -> Chain:
    """labelled: doc_id, text and a 0/1 column for each category, in the order of the chain. Rows with a null category are left out."""
    rows = labelled.dropna(subset=categories).select("text", F.array(*[F.col(c).cast("int") for c in categories]).alias("labels"), F.xxhash64("doc_id", "text").alias("rank"))
    rows = materialize(rows, "toxicity-sample")
    sums = rows.agg(F.count(F.lit(1)), *[F.sum(F.col("labels")[i]) for i in range(len(categories))]).first()
    total, positive = sums[0], [s or 0 for s in sums[1:]]
    if not total:
        return Chain(categories, [])
    counts = rows.select("text", "labels").mapInPandas(_explode, "marker string, labels array<int>").groupBy("marker").agg(F.count(F.lit(1)).alias("n"), *[F.sum(F.col("labels")[i]).alias(f"k{i}") for i in range(len(categories))]).filter(F.col("n") >= min_texts)
    strength = F.lit(0.0)
    for i, p in enumerate(positive):
        share = min(max(p / total, 1e-9), 1 - 1e-9)
        k, m = F.col(f"k{i}"), F.col("n")
        gain = k * F.log((k + 0.5) / ((m + 1) * share)) + (m - k) * F.log((m - k + 0.5) / ((m + 1) * (1 - share)))
        strength = F.greatest(strength, F.when(k > m * share, gain).otherwise(gain / 4))
    best = counts.withColumn("strength", strength).filter("strength > 12").orderBy(F.desc("strength"), "marker").limit(max_markers).collect()
    markers = [r["marker"] for r in best]
    at = {m: i for i, m in enumerate(markers)}

    def present(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pd.DataFrame({"rank": pdf["rank"], "labels": pdf["labels"], "has": [sorted(at[m] for m in _known(t, at)) if t else [] for t in pdf["text"]]})

    got = rows.mapInPandas(present, "rank long, labels array<int>, has array<int>").toPandas().sort_values("rank", ignore_index=True)
    x = np.zeros((len(got), len(markers)))
    for r, has in enumerate(got["has"]):
        x[r, list(has)] = 1
    return Chain(categories, markers).fit(x, np.array(got["labels"].tolist()), (got["rank"] % folds).to_numpy(), ridge)


def score_toxicity(docs: DataFrame, labelled: DataFrame, categories: list[str], **training) -> DataFrame:
    """docs with a probability column p_<category> for each category added; columns of docs with these names are replaced.

    Null and empty texts have no markers and get the models' intercepts. Without labelled rows all probabilities are 0.
    Repeated rows get equal results. Texts of any length are read whole.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train_chain(labelled, categories, **training))
    names = [f"p_{c}" for c in categories]

    @F.pandas_udf(", ".join(f"`{n}` double" for n in names))
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(shared.value.predict_texts(texts.tolist()), columns=names)

    kept = [F.col(c) for c in others(docs, *names)]
    p = fresh("predicted", docs)
    return docs.select(*kept, predict("text").alias(p)).select(*kept, *[F.col(p)[n].alias(n) for n in names])


def category_labels(docs: DataFrame, labels: DataFrame, categories: list[str] | None = None, max_rows: int = 20_000) -> DataFrame:
    """doc_id, text and the categories, of about max_rows labelled documents at most. labels has doc_id and a 0/1 column a category; of
    several labels of a document the largest counts. Without such columns named, the categories are those of a table of quality and
    toxic: low_quality, what the labels know as no prose (1 - quality), whose probability the chain feeds to that of toxic.
    Equal rows count once."""
    values = [F.col(c) for c in categories] if categories else [(1 - F.col("quality")).alias("low_quality"), F.col("toxic")]
    marked = labels.filter("doc_id is not null").select("doc_id", *values)
    marked = marked.groupBy("doc_id").agg(*[F.max(c).alias(c) for c in marked.columns[1:]])
    rows = docs.select("doc_id", "text").join(F.broadcast(draw(marked, max_rows)), "doc_id")
    return rows.distinct().limit(4 * max_rows)


CATEGORIES = ["low_quality", "toxic"]


def reject_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """docs without those whose probability of toxic is at least threshold; same columns, whatever their names."""
    held, back = held_apart(docs)
    return back(score_toxicity(held, category_labels(docs, labels), CATEGORIES).filter(F.col("p_toxic") < threshold))
