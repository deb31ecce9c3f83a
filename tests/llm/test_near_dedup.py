import itertools
import random

import numpy as np
import pytest

from corpusloom.llm import near_dedup, shingles
from corpusloom.llm.near_dedup import band_keys, connected_components, near_duplicates, super_minhash
from corpusloom.llm.shingles import mix64, shingle_sets


def brute_force(docs):
    sets = {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            p, q = sorted((find(a), find(b)))
            root[q] = p
    return {(d, len(s), find(d), d == find(d)) for d, s in sets.items()}


@pytest.fixture(scope="module")
def near_copies(prose_of):
    """Exact copies, chains of edits, a group about one passage, unrelated texts, short texts."""
    rng, docs, n = random.Random(3), [], 0
    for g in range(12):
        w = prose_of(g, 60 + 20 * g).split()
        for _ in range(8):
            docs.append((n, " ".join(w)))
            n += 1
            for _ in range(rng.choice([0, 1, 3])):
                w[rng.randrange(len(w))] = f"edit{n}"
    passage = prose_of(99, 50)
    docs += [(n + i, f"{prose_of(200 + i, 15 + i)} {passage}") for i in range(25)]
    return docs + [(1000, "one two"), (1001, "one  TWO"), (1002, "one"), (1003, None), (1004, "")]


def test_against_brute_force(spark, near_copies):
    df = spark.createDataFrame(near_copies, "doc_id long, text string")
    assert {tuple(r) for r in near_duplicates(df).collect()} == brute_force(near_copies)


def test_odd_rows(odd_docs):
    got = {}
    for r in near_duplicates(odd_docs).collect():
        got.setdefault(r.doc_id, []).append((r.n_shingles, r.component_id, r.kept))
    assert got[1] == got[1][:1] == [(0, 1, True)] and got[2] == [(0, 2, True)] and got[3] == [(0, 3, True)]
    assert got[5] == [(116, 5, True)] * 2 and got[6] == [(116, 5, False)] and got[8] == [(118, 5, False)]
    assert got[None] == [(116, None, False)] and got[7][0][1] == 7


def test_empty(no_docs):
    assert near_duplicates(no_docs).count() == 0


def test_super_minhash_is_unbiased():
    m, agree = 64, []
    for seed in range(40):
        base = mix64(np.arange(300, dtype=np.uint64) + np.uint64(seed * 1000 + 1))
        a, b = base[:200], base[100:]  # Jaccard 1/3
        sig = super_minhash(np.concatenate([a, b]), np.repeat([0, 1], 200), 2, m)
        agree.append((sig[0] == sig[1]).mean())
    assert abs(np.mean(agree) - 1 / 3) < 0.03


def test_super_minhash_slots_of_a_single_element_are_a_permutation():
    sig = super_minhash(np.array([12345], np.uint64), np.array([0]), 1, 32)[0]
    assert sorted((sig >> np.uint64(32)).tolist()) == list(range(32))
    assert band_keys(sig[None, :], 8).shape == (1, 8)


def test_shingles(monkeypatch, prose_of):
    texts = ["a b c d e f", "a b a b", "ÀB\x0bc\x1cd", "A  b\ta\nB ", None, "", " ", prose_of(1, 50), "x y z v w x y z v w x"]

    def sizes():
        return [len(s) for s in shingle_sets(texts)]

    got = shingle_sets(texts)
    assert sizes() == [2, 1, 1, 1, 0, 0, 0, 46, 5] and (got[1] == got[3]).all() and got[1] != got[2]
    monkeypatch.setattr(shingles, "PIECE", 10)
    assert [s.tolist() for s in shingle_sets(texts)] == [s.tolist() for s in got]


def test_large_ids_beside_null(spark, prose_of):
    a, b = prose_of(1, 30), prose_of(2, 30)
    rows = [(2**53 + 1, a), (2**53 + 3, a), (2**63 - 1, b), (None, b)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(2**53 + 1, 2**53 + 1), (2**53 + 3, 2**53 + 1), (2**63 - 1, 2**63 - 1), (None, None)}


def test_one_id_with_several_texts(spark, prose_of):
    a, b, c = (prose_of(i, 30 + i) for i in (1, 2, 3))
    rows = [(5, a), (5, b), (3, a + " more"), (7, b + " more"), (9, c), (9, a + " " + c[:1]), (11, c)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.component_id) for r in got} == {(d, 3) for d, _ in rows} and len(got) == 7


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long").repartition(7)
    got = {r.node: r.comp for r in connected_components(links).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[101] == 100


def test_rounds_grow_with_the_logarithm(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "_forest", lambda batches: batches)  # every link is one of its own, as if each came from another partition
    links, rounds = spark.createDataFrame([(i, i + 1) for i in range(4096)] + [(5000 + i, 6000) for i in range(50)], "a long, b long").repartition(8), []
    got = {r.node: r.comp for r in connected_components(links, rounds).collect()}
    assert all(got[i] == 0 for i in range(4097)) and all(got[5000 + i] == got[6000] == 5000 for i in range(50))
    assert len(rounds) <= 15 and all(b < 0.7 * a for a, b in zip(rounds, rounds[1:], strict=False) if a > 50)
