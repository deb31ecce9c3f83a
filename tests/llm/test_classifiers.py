import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm.common import fold, table
from corpusloom.llm.language_id import Model, identify_languages, suffix_automaton, to_symbols, training_sample
from corpusloom.llm.quality import features, fit_non_negative, quality_query, score_quality
from corpusloom.llm.toxicity import CATEGORIES, Chain, category_labels, fit_logistic, reject_toxic, score_toxicity


def test_suffix_automaton_accepts_substrings_only():
    text = [1, 2, 1, 2, 3, 1, 1, 2]
    step = suffix_automaton(text, 4)

    def accepts(s):
        state = 0
        for c in s:
            state = step[state, c]
            if state < 0:
                return False
        return True

    subs = {tuple(text[i:j]) for i in range(8) for j in range(i, 9)}
    rng = np.random.default_rng(0)
    for _ in range(500):
        s = tuple(rng.integers(1, 4, rng.integers(1, 5)).tolist())
        assert accepts(s) == (s in subs)


def test_phrases_by_brute_force():
    samples = {"x": "abra cadabra abra", "y": "hocus pocus"}
    model = Model(samples)
    text = "abracadabra hocus! Zabra"
    need, size = model.phrases([text, None, "123"], segment=1000)
    table_ = model._table
    s = to_symbols(text, table_).tolist()
    for i, lang in enumerate(model.languages):
        have = "".join(map(chr, to_symbols(samples[lang], table_)))
        count, at = 0, 0
        while at < len(s):
            n = 1
            while at + n < len(s) and "".join(map(chr, s[at : at + n + 1])) in have:
                n += 1
            count, at = count + 1, at + n
        assert need[0, i] == count
    assert size.tolist() == [len(s), 0, 0]


@pytest.mark.parametrize("table_bytes", [0, 1 << 30])
def test_phrases_of_large_alphabets_by_brute_force(table_bytes):
    rng = np.random.default_rng(3)
    han, hangul = [chr(0x4E00 + i) for i in range(400)], [chr(0xAC00 + i) for i in range(400)]
    say = lambda letters, n: "".join(rng.choice(letters + [" "] * 40, n))
    samples = {"zh": say(han, 3000), "ja": say(han, 3000), "ko": say(hangul, 3000), "en": "plain words " * 20}
    model = Model(samples, table_bytes)
    texts = [samples["zh"][700:1000], samples["ja"][100:400] + "words", samples["ko"][-300:], say(han, 300)]
    need, size = model.phrases(texts, segment=1000)
    for t, text in enumerate(texts):
        s = "".join(map(chr, to_symbols(text, model._table)))
        assert size[t] == len(s)
        for i, lang in enumerate(model.languages):
            have = "".join(map(chr, to_symbols(samples[lang], model._table)))
            count, at = 0, 0
            while at < len(s):
                n = 1
                while at + n < len(s) and s[at : at + n + 1] in have:
                    n += 1
                count, at = count + 1, at + n
            assert need[t, i] == count
    assert [model.languages[i] for i in need[:3].argmin(axis=1)] == ["zh", "ja", "ko"]


@pytest.mark.parametrize("group_bytes", [20_000, 128 << 20])
def test_all_languages_are_learned(spark, group_bytes):
    rng = np.random.default_rng(4)
    alphabet = list("abcdefghijklmnopqrstuvwxyz")
    words = {f"l{i:02}": ["".join(rng.choice(alphabet, 6)) for _ in range(12)] for i in range(70)}
    rows = [(i, " ".join(rng.choice(words[lang], 40)), lang) for i, lang in enumerate(words)]
    new = [(100 + i, " ".join(rng.choice(words[lang], 8)), lang) for i, lang in enumerate(words)]
    schema = "doc_id long, text string, lang string"
    got = identify_languages(spark.createDataFrame(new, schema), spark.createDataFrame(rows, schema), group_bytes=group_bytes).collect()
    assert all(r.lang == r.lang_pred and 0 < r.score <= 1 for r in got) and len(got) == 70


def test_languages(spark, data):
    docs = table(spark, data, "documents").withColumn("held_out", fold("doc_id", 4, 2))
    got = identify_languages(docs.drop("lang"), docs.filter("not held_out")).join(docs.select("doc_id", "lang"), "doc_id")
    right = got.filter("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


def test_language_odd_rows(spark, odd_docs, no_docs):
    got = {r.doc_id: r for r in identify_languages(odd_docs, odd_docs).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (1, 2, 3, 9)) and got[7].lang_pred in ("en", "fr") and 0 <= got[7].score <= 1
    assert identify_languages(no_docs, odd_docs).count() == 0
    assert {r.lang_pred for r in identify_languages(odd_docs, no_docs).collect()} == {"und"}
    assert len(training_sample(odd_docs, 500)["fr"]) <= 500


def test_quality(spark, data):
    docs, labels = table(spark, data, "documents"), table(spark, data, "labels")
    got = quality_query(docs, labels).join(labels, "doc_id").filter("held_out")
    assert got.agg(F.avg((F.col("quality") == F.col("predicted")).cast("int"))).first()[0] > 0.9


def test_quality_odd_rows(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(5, 1, 0), (7, 1, 0), (9, 0, 1), (None, 1, 1), (8, None, None)], "doc_id long, quality int, toxic int")
    got = score_quality(odd_docs, labels).collect()
    assert len(got) == 12 and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in score_quality(odd_docs, labels.limit(0)).collect()} == {0.5}
    assert score_quality(no_docs, labels).count() == 0
    assert features([None, "", " ", "x"]).shape[0] == 4


def test_non_negative_risk_finds_the_boundary():
    rng = np.random.default_rng(1)
    pos, neg = rng.normal(1.5, 1, (400, 2)), rng.normal(-1.5, 1, (400, 2))
    unlabelled = np.concatenate([rng.normal(1.5, 1, (300, 2)), rng.normal(-1.5, 1, (300, 2))])
    model = fit_non_negative(pos, unlabelled, 0.5)
    assert (model.score(pos) >= 0.5).mean() > 0.93 and (model.score(neg) < 0.5).mean() > 0.93


@pytest.fixture(scope="module")
def labelled(spark, prose_of):
    rows = [(i, prose_of(i, 40) + (" badwordful vile" if i % 4 == 0 else ""), int(i % 4 == 0)) for i in range(120)]
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, 1, y) for i, _, y in rows], "doc_id long, quality int, toxic int")


def test_toxicity(spark, labelled):
    docs, labels = labelled
    kept = {r.doc_id for r in reject_toxic(docs, labels.filter("doc_id < 80")).collect()}
    assert kept == {i for i in range(120) if i % 4}


def test_toxicity_odd_rows(labelled, odd_docs, no_docs):
    docs, labels = labelled
    got = score_toxicity(odd_docs, category_labels(docs, labels), CATEGORIES).collect()
    assert len(got) == 12 and all(0 <= r.p_toxic < 0.5 for r in got)
    assert score_toxicity(no_docs, category_labels(docs, labels), CATEGORIES).count() == 0
    assert {r.p_toxic for r in score_toxicity(odd_docs, category_labels(docs, labels.limit(0)), CATEGORIES).collect()} == {0.0}
    assert reject_toxic(odd_docs, labels).columns == odd_docs.columns


def test_chain_feeds_earlier_probabilities():
    rng = np.random.default_rng(2)
    x = (rng.random((400, 3)) < 0.5).astype(float)
    y = np.column_stack([x[:, 0], x[:, 0] * x[:, 1]])
    chain = Chain(["a", "b"], ["m"] * 3).fit(x, y, np.arange(400) % 5, 0.05)
    assert len(chain.weights[1]) == len(chain.weights[0]) + 1 and chain.weights[1][3] > 0
    assert ((chain.predict(x) >= 0.5) == y).all()
    assert fit_logistic(x, np.zeros(400), 0.1)[-1] < -2


def plain_chain(texts, labels, new, ridge=0.05, min_texts=5, folds_of=None, folds=5):
    """Toxicity as the operator defines it, without Spark: markers by a signed likelihood ratio, and each category's ridge regression by plain gradient steps."""
    def marks(t):
        out = set()
        for w in set(re.findall(r"[^\W\d_]+", t.lower())):
            out |= {"=" + w} | {w[:n] for n in (4, 5, 6) if len(w) > n}
        return out

    sets, total = [marks(t) for t in texts], len(texts)
    seen = Counter(m for s in sets for m in s)
    strength = {}
    for c in range(labels.shape[1]):
        share = min(max(labels[:, c].mean(), 1e-9), 1 - 1e-9)
        for m, n in seen.items():
            if n >= min_texts:
                k = sum(int(labels[i, c]) for i in range(total) if m in sets[i])
                gain = k * math.log((k + 0.5) / ((n + 1) * share)) + (n - k) * math.log((n - k + 0.5) / ((n + 1) * (1 - share)))
                strength[m] = max(strength.get(m, 0.0), gain if k > n * share else gain / 4)
    chosen = sorted((m for m, s in strength.items() if s > 12), key=lambda m: (-strength[m], m))[:400]
    table_ = lambda ss: np.array([[float(m in s) for m in chosen] for s in ss]).reshape(len(ss), len(chosen))

    def fit(x, y):
        x, w = np.column_stack([x, np.ones(len(x))]), np.zeros(x.shape[1] + 1)
        for _ in range(40_000):
            p = 1 / (1 + np.exp(-x @ w))
            w -= (x.T @ (p - y) + np.append(np.full(len(w) - 1, ridge), 1e-3) * w) * 4 / (len(x) * x.shape[1])
        return w

    say = lambda x, w: 1 / (1 + np.exp(-(x @ w[:-1] + w[-1])))
    x, z, out = table_(sets), table_([marks(t) for t in new]), []
    for c in range(labels.shape[1]):
        y = labels[:, c].astype(float)
        out.append(say(z, fit(x, y)))
        ahead = np.zeros(total)
        for f in range(folds):
            if (folds_of == f).any():
                ahead[folds_of == f] = say(x[folds_of == f], fit(x[folds_of != f], y[folds_of != f]))
        x, z = np.column_stack([x, ahead]), np.column_stack([z, out[-1]])
    return np.array(out).T


def test_chain_against_brute_force(spark, labelled):
    docs, labels = labelled
    marked = category_labels(docs, labels.filter("doc_id < 80").withColumn("quality", (F.col("doc_id") % 3 > 0).cast("int")))
    rows = marked.withColumn("fold", F.pmod(F.xxhash64("doc_id", "text"), F.lit(5))).collect()
    got = {r.doc_id: (r.p_low_quality, r.p_toxic) for r in score_toxicity(docs, marked, CATEGORIES).collect()}
    new = docs.collect()
    want = plain_chain([r.text for r in rows], np.array([[r.low_quality, r.toxic] for r in rows]), [r.text for r in new], folds_of=np.array([r.fold for r in rows]))
    assert np.abs(np.array([got[r.doc_id] for r in new]) - want).max() < 0.01


def test_quality_against_brute_force(spark, data):
    """The scores are a linear model's that lowers the non-negative risk, written out here anew, over all rows."""
    docs, labels = table(spark, data, "documents").select("doc_id", "text"), table(spark, data, "labels").select("doc_id", "quality")
    marks = {r.doc_id: r.quality for r in labels.collect()}
    rows = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("rank")).orderBy("rank").collect()
    x = features([r.text for r in rows])
    good = x[[marks.get(r.doc_id) == 1 for r in rows]]
    prior = sum(marks.values()) / len(marks)
    mean, scale = x.mean(axis=0), x.std(axis=0)
    scale[scale < 1e-4] = 1
    z = lambda m: np.column_stack([np.clip((m - mean) / scale, -8, 8), np.ones(len(m))])
    p, u = z(good), z(x)

    def risk(w):
        loss = lambda m: np.logaddexp(0, m)
        positive, negative = prior * loss(-(p @ w)).mean(), loss(u @ w).mean() - prior * loss(p @ w).mean()
        return positive + max(negative, 0.0)

    got = score_quality(docs, labels).collect()
    s = {r.doc_id: r.score for r in got}
    logit = np.array([math.log(s[r.doc_id] / (1 - s[r.doc_id])) for r in rows])
    inside = np.abs(logit) < 20
    w, *_ = np.linalg.lstsq(u[inside], logit[inside], rcond=None)
    assert np.abs(u[inside] @ w - logit[inside]).max() < 1e-3  # a linear model of the features
    assert risk(w) < risk(np.zeros(len(w))) / 3
    step = np.eye(len(w)) * 1e-5
    slope = np.array([(risk(w * 0.5 + d) - risk(w * 0.5 - d)) / 2e-5 for d in step])
    assert slope @ w < 0  # half-way to the weights found the risk still falls towards them
