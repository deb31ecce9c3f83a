import hashlib
import random
from collections import Counter, defaultdict

import pandas as pd
import pytest

from corpusloom.llm.token_alignment import BYTE_BPE, PIECE_BPE, Aligned, _tokenizers, align_tokens, alignment_query, overlaps, piece_pattern

COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = ["<|endoftext|> hi <s> </s> <unk>", "  two  spaces  ", "x" * 3000, "日本語の文章です。" * 20, "\n\n\n a", "don't we'll I'm", "<0x0A>", "a,\r b\r\r c", "▁ lower block", "it's wide \U0001f600\U0001f600"]


def whole(text):
    """Groups of a text that is encoded as a whole: (ids of a, ids of b) each."""
    a, b = _tokenizers(BYTE_BPE, PIECE_BPE)
    ids = a.model.encode(" " + text, add_special_tokens=False).ids, b.encode_whole([" " + text])[0]
    ends = []
    for side, v in zip(ids, (a, b), strict=True):
        if b"".join(v.bytes[i] for i in side) != (" " + text).encode():
            return []
        at, out = 0, []
        for i in side:
            at += len(v.bytes[i])
            out.append(at)
        ends.append(out)
    cuts, groups, i, j = sorted(set(ends[0]) & set(ends[1])), [], 0, 0
    for c in cuts:
        x, y = i, j
        while i < len(ends[0]) and ends[0][i] <= c:
            i += 1
        while j < len(ends[1]) and ends[1][j] <= c:
            j += 1
        groups.append((ids[0][x:i], ids[1][y:j]))
    return groups


def brute_force(docs):
    found = [(d, whole(t) if t else []) for d, t in docs]
    counts = Counter(p for _, gs in found for p in {(a, b) for x, y in gs for a in x for b in y})
    top = defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    out = []
    for d, gs in found:
        links = [(a, b) for x, y in gs for a in x for b in y]
        shown = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        best = sum(counts[p] == top[p[0]] for p in links)
        out.append((d, sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), len(links), best, sum(counts[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if gs else ""))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(4)
    letters = list("ab1 .,'\n\t\r  é日\U0001f600▁  \x1c\x85ßﬁ①s<>|")
    return ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(0, 40))) for _ in range(300)] + ["The quick brown fox jumped over 12 lazy dogs, twice."] * 3


@pytest.mark.parametrize("bound", [1_000_000, 0])
def test_against_brute_force(spark, texts, bound):
    docs = [*enumerate(texts), (None, "no id"), (5, "repeated id"), (5, "repeated id"), (901, None), (902, "")]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = alignment_query(df, broadcast_pairs=bound)
    assert got.columns == COLUMNS
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_force(docs)


def test_documents_of_the_tables(spark, data):
    docs = [tuple(r) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").limit(40).collect()]
    got = alignment_query(spark.createDataFrame(docs, "doc_id long, text string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_force(docs)


def test_odd_rows(odd_docs, no_docs):
    got = {r.doc_id: r for r in alignment_query(odd_docs).collect()}
    assert [got[i].n_a for i in (1, 2)] == [0, 0] and got[1].groups_sha256 == "" and got[4].n_groups == 1 and got[7].n_a > 30_000
    assert got[5].groups_sha256 == got[None].groups_sha256 == got[6].groups_sha256
    assert alignment_query(no_docs).count() == align_tokens(no_docs).count() == 0


def test_links(spark):
    r = align_tokens(spark.createDataFrame([(1, "abc abc")], "doc_id long, text string")).first()
    assert sum(x.times for x in r.links) == r.n_links and r.groups.count(";") + 1 == r.n_groups


def test_overlaps_join_covering_tokens():
    a = pd.DataFrame({"piece": 0, "start": [0, 2, 5], "end": [2, 5, 6], "token": [0, 1, 2]})
    b = pd.DataFrame({"piece": 0, "start": [0, 3], "end": [3, 6], "token": [0, 1]})
    assert set(overlaps(a, b)[["token_a", "token_b"]].itertuples(index=False, name=None)) == {(0, 0), (1, 0), (1, 1), (2, 1)}


def test_pieces_without_a_cut_give_the_same(texts):
    cut, uncut = Aligned(BYTE_BPE, PIECE_BPE), Aligned(BYTE_BPE, PIECE_BPE)
    assert cut.parts and piece_pattern({" "}) is None
    uncut.parts = None
    x, y = cut.documents(texts), uncut.documents(texts)
    assert x[1] == y[1] and all((p == q).all() for p, q in zip(x[:1] + x[2:], y[:1] + y[2:], strict=True))


def test_the_quick_encoder_equals_the_file(texts):
    a = _tokenizers(BYTE_BPE, PIECE_BPE)[0]
    assert a.quick
    quick, a.quick = a.quick, None
    plain = a.encode(texts)
    a.quick = quick
    assert a.encode(texts) == plain
