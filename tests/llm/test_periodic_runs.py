import hashlib
import random
import zlib

import numpy as np
import pytest

from corpusloom.llm.periodic_runs import RangeMinima, SuffixTree, periodic_runs, planted, runs_query, word_runs


def brute_force(words, least):
    """Every stretch on which words q apart agree, of its periods the smallest."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, 2 * q):
                found.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def test_against_brute_force():
    rng = random.Random(1)
    for _ in range(3000):
        n, k = rng.randrange(0, 60), rng.choice([1, 2, 3, 5])
        words = [b"%d" % rng.randrange(k) for _ in range(n)]
        if rng.random() < 0.4:
            words = planted(words, rng.randrange(10**9))
        least = rng.choice([2, 3, 4, 7, 12])
        assert list(map(tuple, word_runs(words, least).tolist())) == brute_force(words, least)


def test_suffix_tree_gives_suffixes_in_order():
    rng = random.Random(2)
    for _ in range(200):
        s = [rng.randrange(1, 4) for _ in range(rng.randrange(1, 40))]
        tree = SuffixTree(s)
        suffixes = [[*s[i:], 0] for i in range(len(s) + 1)]
        for opposite in (False, True):
            place = tree.tour(opposite)[0]
            order = sorted(range(len(suffixes)), key=lambda i: [(-x if opposite and x else x) - 10 * (not x) for x in suffixes[i]])  # noqa: B023
            assert np.argsort(place).tolist() == order


def test_range_minima():
    rng = np.random.default_rng(3)
    for n in (1, 15, 16, 17, 300, 5000):
        v = rng.integers(0, 1000, n)
        lo, hi = np.sort(rng.integers(0, n, (2, 400)), axis=0)
        assert RangeMinima(v).least(lo, hi).tolist() == [v[a : b + 1].min() for a, b in zip(lo, hi, strict=True)]


def digest(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = brute_force(w, 12)
    gone = {i for s, length, q in runs for i in range(s + q, s + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    sha = [hashlib.sha256(x).hexdigest() for x in (lines.encode(), b" ".join(x for i, x in enumerate(w) if i not in gone))]
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, *sha)


@pytest.mark.parametrize("words", [2, 40])
def test_query_against_brute_force(spark, words):
    rng = random.Random(words)
    docs = [(i, " ".join(f"w{rng.randrange(words)}" for _ in range(rng.randrange(0, 150)))) for i in range(120)]
    docs += [(500, "same line of words\n" * 9), (501, "a b " * 40 + "x " + "a b c " * 20), (502, None), (503, ""), (None, "z " * 30), (500, "other")]
    got = runs_query(spark.createDataFrame(docs, "doc_id long, text string"))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert [t for _, t in got.dtypes] == ["bigint"] * 6 + ["string"] * 2
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted((digest(*d) for d in docs), key=str)


def test_odd_rows(odd_docs, no_docs):
    got = {r.doc_id: r for r in periodic_runs(odd_docs).collect()}
    assert got[1].runs == got[2].runs == got[4].runs == [] and got[3].collapsed == "" and len(got[7].collapsed.split()) <= 30_000
    assert periodic_runs(no_docs).count() == runs_query(no_docs).count() == 0


def test_collapse(spark):
    r = periodic_runs(spark.createDataFrame([(1, "go " * 20 + "on")], "doc_id long, text string")).first()
    assert [tuple(x) for x in r.runs] == [(0, 20, 1)] and r.collapsed == "go on"
