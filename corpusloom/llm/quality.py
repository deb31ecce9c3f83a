"""A quality classifier learnt from positive and unlabelled texts.

Trusted positives are texts labelled good; unlabelled texts are a draw from the whole corpus. With class prior pi, loss l and
model g, the risk minimised is the non-negative estimate

    pi * E_p[l(g)] + max(0, E_u[l(-g)] - pi * E_p[l(-g)])

by full-batch gradient steps; when the second term would fall below zero, the step goes up that term instead, which keeps a
flexible model from driving it negative. pi is estimated: the share of good among the labelled rows, which are a draw from
the same corpus. The model is linear in features of how a text is written, not of what words it has: shares of neighbouring
character classes, repeated words and lines, word and line lengths. Learning is done on bounded draws of rows (max_rows
each), scoring covers whole texts. A text that is repeated or labelled more than once counts with its worst label.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import draw, fold, materialize, others

N_CLASSES = 12
SYMBOLS = "#$%&*@^~"
N_FEATURES = N_CLASSES * N_CLASSES + N_CLASSES + 7


def _classes() -> np.ndarray:
    """Code point to class, for the Basic Multilingual Plane; 1 (letter) beyond."""
    table = np.ones(0x10000, np.uint8)
    for cp in range(0x10000):
        ch = chr(cp)
        if ch == "\n":
            c = 3
        elif ch.isspace():
            c = 2
        elif ch.isdigit():
            c = 4
        elif ch.isupper():
            c = 0
        elif ch.isalpha():
            c = 1
        elif ch in ".,":
            c = 5
        elif ch == "!":
            c = 6
        elif ch == "|":
            c = 7
        elif ch in SYMBOLS:
            c = 8
        elif ch in "<>{}[]()=/\\_":
            c = 9
        elif ch in "?:;'\"-":
            c = 10
        else:
            c = 11
        table[cp] = c
    return table


_TABLE: list[np.ndarray] = []


def features(texts: list[str | None]) -> np.ndarray:
    """One row per text; all zeros, but for the mark of emptiness, for null and empty texts."""
    if not _TABLE:
        _TABLE.append(_classes())
    out = np.zeros((len(texts), N_FEATURES))
    pairs = N_CLASSES * N_CLASSES
    for r, text in enumerate(texts):
        if not text or not text.strip():
            out[r, -1] = 1
            continue
        cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        c = _TABLE[0][np.minimum(cp, 0xFFFF)].astype(np.int16)
        n = len(c)
        if n > 1:
            out[r, :pairs] = np.sqrt(np.bincount(c[:-1] * N_CLASSES + c[1:], minlength=pairs) / (n - 1))
        out[r, pairs : pairs + N_CLASSES] = np.bincount(c, minlength=N_CLASSES) / n
        words = text.split()
        out[r, pairs + N_CLASSES : -1] = (
            len(set(words)) / len(words),
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / len(words),
            min(len(max(words, key=len)), 50) / 50,
            min(n / len(words), 30) / 30,
            len(set(lines := text.split("\n"))) / len(lines),
            np.log1p(len(words)) / 10,
        )
    return out


@dataclass
class LinearModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit_non_negative(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 600, rate: float = 0.02, ridge: float = 1e-4) -> LinearModel:
    """Adam on the non-negative risk with the logistic loss."""
    mean, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0)
    scale[scale < 1e-4] = 1.0
    p, u = (np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))]) for x in (positive, unlabelled))
    w, m, v = (np.zeros(p.shape[1]) for _ in range(3))
    for t in range(1, steps + 1):
        zp, zu = p @ w, u @ w
        sp, su = 1 / (1 + np.exp(-zp)), 1 / (1 + np.exp(-zu))
        as_negative_u, as_negative_p = np.logaddexp(0, zu).mean(), np.logaddexp(0, zp).mean()
        grad_p = p.T @ (sp - 1) / len(p)
        grad_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        grad = prior * grad_p + grad_negative if as_negative_u - prior * as_negative_p >= 0 else -grad_negative
        grad = grad + ridge * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return LinearModel(mean, scale, w)


def _features_of(rows: DataFrame) -> np.ndarray:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"rank": pdf["rank"], "x": list(features(pdf["text"].tolist()))})

    got = rows.select("text", F.xxhash64("doc_id", "text").alias("rank")).mapInPandas(run, "rank long, x array<double>").toPandas()
    return np.array(got.sort_values("rank")["x"].tolist()).reshape(-1, N_FEATURES)


def train_quality(docs: DataFrame, labels: DataFrame, *, max_rows: int = 12_000) -> LinearModel | None:
    """docs: doc_id, text; labels: doc_id, quality (1 for good). None without positives or without unlabelled rows."""
    marked = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    found = marked.agg(F.count(F.lit(1)), F.coalesce(F.sum("quality"), F.lit(0))).first()
    if not found[1]:
        return None
    good = F.broadcast(draw(marked.filter("quality = 1"), max_rows).select("doc_id", F.lit(True).alias("good")))
    total = docs.count()
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, max_rows / max(1, total)))
    rows = docs.select("doc_id", "text", drawn.alias("drawn")).join(good, "doc_id", "left").filter("drawn or good").distinct().limit(6 * max_rows)  # equal rows count once
    rows = materialize(rows.withColumn("good", F.coalesce("good", F.lit(False))), "quality-sample")
    unlabelled, positive = _features_of(rows.filter("drawn")), _features_of(rows.filter("good"))
    if not len(unlabelled) or not len(positive):
        return None
    prior = min(max(found[1] / found[0], 0.01), 0.99)
    return fit_non_negative(positive, unlabelled, prior)


def score_quality(docs: DataFrame, labels: DataFrame, **training) -> DataFrame:
    """docs with score double (0 to 1) and predicted int added; columns of docs with these names are replaced.

    Null and empty texts are scored by the mark of emptiness alone. Without usable labels every score is 0.5. Repeated rows
    get equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(train_quality(docs.select("doc_id", "text"), labels, **training))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        model, out = shared.value, []
        for start in range(0, len(texts), 1000):
            part = texts.iloc[start : start + 1000].tolist()
            out.append(model.score(features(part)) if model else np.full(len(part), 0.5))
        return pd.Series(np.concatenate(out) if out else np.empty(0))

    kept = [F.col(c) for c in others(docs, "score", "predicted")]
    return docs.select(*kept, score("text").alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def quality_query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, learnt from the labels of two thirds of them."""
    scored = score_quality(docs.select("doc_id", "text"), labels.filter(~fold("doc_id", 3, 1)).select("doc_id", "quality"))
    return scored.select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "score", "predicted")
