import hashlib
import random
from collections import Counter

import pytest

from corpusloom.llm.queries import op12_substring_dedup
from corpusloom.llm.repeats import remove_repeats


def brute_force(docs, window):
    cut = [(d, (t or "").encode().split()) for d, t in docs]
    times = Counter(tuple(w[i : i + window]) for _, w in cut for i in range(len(w) - window + 1))
    out = []
    for d, w in cut:
        gone = {j for i in range(len(w) - window + 1) if times[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def mixed(seed, words):
    """Documents made of shared passages and own words, from a vocabulary of so many words."""
    rng = random.Random(seed)

    def prose(n):
        return [f"W{rng.randrange(words)}" for _ in range(n)]

    passages, docs = [prose(rng.choice([34, 35, 36, 50, 90])) for _ in range(6)], []
    for i in range(60):
        w = []
        for _ in range(rng.randrange(0, 5)):
            w += rng.choice(passages) if rng.random() < 0.5 else prose(rng.randrange(1, 80))
        docs.append((i, " ".join(w)))
    return docs + docs[:3] + [(900, None), (901, ""), (902, " \n"), (None, docs[5][1])]


@pytest.mark.parametrize(("window", "gram", "words"), [(35, 8, 500), (35, 8, 2), (5, 2, 3), (35, 8, 1), (70, 8, 3)])
def test_against_brute_force(spark, window, gram, words):
    docs = mixed(window + words, words)
    got = remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), window=window, gram=gram)
    assert sorted(((r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in got.collect()), key=str) == brute_force(docs, window)


def test_maximal_repeats(spark, prose_of):
    p, own = prose_of(1, 60), [prose_of(10 + i, 40) for i in range(4)]
    docs = spark.createDataFrame([(1, f"{own[0]} {p} {own[1]}"), (2, f"{p} {own[2]}"), (3, own[3])], "doc_id long, text string")
    got = {r.doc_id: [(x.start, x.length) for x in r.repeats] for r in remove_repeats(docs).collect()}
    assert got == {1: [(40, 60)], 2: [(0, 60)], 3: []}


def test_case_counts_and_case_of_words(spark, prose_of):
    p = prose_of(1, 50)
    docs = spark.createDataFrame([(1, p), (2, p.upper()), (3, "\t".join(p.split()) + "\x0b")], "doc_id long, text string")
    assert {r.doc_id: r.n_removed for r in remove_repeats(docs).collect()} == {1: 50, 2: 0, 3: 50}


def test_odd_rows(odd_docs, no_docs):
    got = {}
    for r in remove_repeats(odd_docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_words, r.n_removed))
    assert got[1] == got[2] == got[3] == [(0, 0)] and got[4] == [(1, 0)] and got[5] == [(120, 120)] * 2 and got[None] == [(120, 120)]
    assert got[8] == [(122, 120)] and got[7][0][0] == 30_000
    assert remove_repeats(no_docs).count() == 0


def test_query(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    want = {(d, n, gone, hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, kept in brute_force(docs, 35)}
    assert {tuple(r) for r in op12_substring_dedup(spark, data).collect()} == want
