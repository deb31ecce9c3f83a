import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import lm_scoring, shingles
from corpusloom.llm.common import fold
from corpusloom.llm.lm_scoring import score_texts


def brute_force(rows, order, smoothing=0.9, decay=0.1):
    """Dictionaries and a literal walk of the automaton: state, arc or failure arcs."""
    cut = lambda t: (t or "").encode().lower().split() + ["END"]
    grams = [Counter() for _ in range(order + 1)]
    for _, text, held in rows:
        if not held:
            w = ["START", *cut(text)]
            for i in range(1, len(w)):
                for k in range(1, order + 1):
                    if i - k + 1 >= 0:
                        grams[k][tuple(w[i - k + 1 : i + 1])] += 1
            grams[1][("START",)] += 1
    n, v = sum(c for g, c in grams[1].items() if g != ("START",)), len(grams[1]) - (("START",) in grams[1])

    def arc(h, w):
        if not h:
            return (grams[1][(w,)] + 1) / (n + v + 1)
        keep = smoothing * context(h) ** -decay if context(h) else 1
        return (1 - keep) * (grams[len(h) + 1][(*h, w)] / context(h) if context(h) else 0) + keep * arc(h[1:], w)

    def context(h):
        return grams[len(h)][h]

    out = []
    for d, text, held in rows:
        state, logp, base, known = ("START",) if order > 1 and grams[1][("START",)] else (), 0.0, 0.0, 0
        w = cut(text)
        for t in w:
            h, s = state, 0.0
            while h and not grams[len(h) + 1][(*h, t)]:
                s += math.log10(smoothing * context(h) ** -decay)
                h = h[1:]
            logp += s + math.log10(arc(h, t))
            base += math.log10((grams[1][(t,)] + 1) / (n + v + 1))
            known += grams[1][(t,)] > 0
            state = (*state, t)[-(order - 1) :] if order > 1 else ()
            while state and not context(state):
                state = state[1:]
        out.append((d, held, len(w), known, n, round(base, 6), round(logp, 6)))
    return sorted(out)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_against_brute_force(spark, prose_of, order):
    texts = [(i, " ".join(w[:3] if i % 3 else w[3:5] for w in prose_of(i % 9, 5 + i * 3).split())) for i in range(40)] + [(90, None), (91, ""), (92, "UNSEEN unseen x")]
    rows = [(d, t, zlib.crc32(str(d).encode()) % 7 == 2) for d, t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    got = score_texts(df, order=order, block_bytes=500).collect()
    assert sorted((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got) == brute_force(rows, order)


def test_odd_rows(odd_docs):
    got = score_texts(odd_docs.withColumn("held_out", fold("doc_id", 7, 2)))
    by = {}
    for r in got.collect():
        by.setdefault(r.doc_id, []).append(r)
    assert len(by[5]) == 2 and by[5][0].score == by[5][1].score
    assert by[1][0].n_tokens == 1 and by[7][0].n_tokens == 30_001 and by[None][0].held_out is False


def test_nothing_trained_on(odd_docs):
    got = score_texts(odd_docs.withColumn("held_out", F.lit(True))).collect()
    assert all(r.train_tokens == 0 and r.n_known == 0 and r.score == 0 for r in got)


def test_empty(no_docs):
    assert score_texts(no_docs.withColumn("held_out", F.lit(False))).count() == 0


def test_large_ids_beside_null(spark):
    ids = [2**63 - 1, 2**53 + 1, 2**53 + 3, None]
    df = spark.createDataFrame([(i, f"text {n}", False) for n, i in enumerate(ids)], "doc_id long, text string, held_out boolean").coalesce(1)
    assert {r.doc_id for r in score_texts(df).collect()} == set(ids)


def test_segments_and_pieces_change_nothing(monkeypatch, prose_of):
    texts = [prose_of(1, 1200), "", None, "A\x0bb  c\td ", "é　x \x1c", prose_of(2, 3), " "]
    held = np.array([False, False, True, False, False, True, False])

    def scores():
        block = lm_scoring.Block(texts, 3, 50)
        keys, counts = block.counts(~held)
        assert (np.diff(keys.astype(np.int64)) > 0).all() and counts.sum() > 0
        return [block.size.tolist(), lm_scoring.Automaton(block, counts.astype(float), 2000, 500, 0.9, 0.1).walk().round(9).tolist()]

    want = scores()
    assert want[0] == [len((t or "").encode().split()) + 2 for t in texts]
    monkeypatch.setattr(lm_scoring, "SEGMENT", 7)
    monkeypatch.setattr(shingles, "PIECE", 100)
    shingles._piece_powers.cache_clear()
    assert scores() == want
    shingles._piece_powers.cache_clear()


def test_word_hashes():
    h, n = shingles.word_hashes([b"one Two", b"", b"two\x0cONE  one"])
    assert n.tolist() == [2, 0, 3] and h[0] == h[3] == h[4] and h[1] == h[2] != h[0]


def test_sort_places():
    rng = np.random.default_rng(1)
    keys = (rng.integers(0, 50, 5000).astype(np.uint64) << np.uint64(40)) | rng.integers(0, 8, 5000).astype(np.uint64) | np.uint64(1 << 63)
    assert (np.diff(keys[lm_scoring.sort_places(keys)] - np.uint64(1 << 63)).astype(np.int64) >= 0).all()
    assert lm_scoring.sort_places(np.array([5], np.uint64)).tolist() == [0]
