import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.llm import queries
from corpusloom.llm.contamination import candidates, contaminated
from corpusloom.llm.fingerprints import anchors, closed_syncmers, fingerprint, fingerprint_documents, in_order, likeness
from corpusloom.llm.license_scan import PHRASES, scan_licenses
from corpusloom.llm.mixing import mix_sources, poisson_count, source_rates

WORD = re.compile(r"[^\W_]+")


def item_shingles(t):
    w = WORD.findall((t or "").lower())
    return {tuple(w[i : i + min(5, len(w))]) for i in range(max(1, len(w) - 4))} if w else set()


def test_contamination_against_brute_force(spark, prose_of):
    items = [(i, prose_of(500 + i, 3 + 2 * i)) for i in range(12)] + [(50, None), (51, ""), (52, "Two words")]
    docs = []
    for i in range(30):
        w = prose_of(i, 200 + 100 * (i % 3)).split()
        part = (items[i % 12][1] or "").split()
        if i % 4 == 1 and len(part) > 8:
            part[len(part) // 2] = "changed"
        docs.append((i, " ".join(w[:50] + part + w[50:]).upper() if i % 2 else " ".join(w)))
    docs += [(100, "so: two words!"), (101, None)]
    want = set()
    for d, t in docs:
        w = WORD.findall((t or "").lower())
        for q, it in items:
            s = item_shingles(it)
            if s:
                k = len(next(iter(s)))
                n = len(s & {tuple(w[i : i + k]) for i in range(len(w) - k + 1)})
                if n and n >= 0.75 * len(s):
                    want.add((d, q, len(s), n))
    got = contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in got.collect()} == want and len(want) > 10
    tables = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    joined = contaminated(*tables, broadcast_rows=0)
    assert {(r.doc_id, r.item_id, r.item_shingles, r.shared) for r in joined.collect()} == want
    met = {(r.doc_id, r.item_id) for r in candidates(*tables).select("doc_id", "item_id").collect()}
    touched = {(d, q) for d, t in docs for q, it in items if item_shingles(t) & item_shingles(it)}
    assert {(d, q) for d, q, *_ in want} <= met and len(met) < len(docs) * len(items) // 4 and (met - touched) <= {(100, 52)}


def test_contamination_judges_each_text_alone(spark, prose_of):
    w = prose_of(900, 40).split()
    docs = spark.createDataFrame([(1, " ".join(w[:24])), (1, " ".join(w[16:])), (None, " ".join(w[:24])), (None, " ".join(w)), (2, " ".join(w)), (2, " ".join(w))], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(w))], "item_id long, text string")
    for rows in (0, 1000):
        assert sorted((r.doc_id or 0, r.shared) for r in contaminated(docs, items, broadcast_rows=rows).collect()) == [(0, 36), (2, 36)]


def test_contamination_odd_rows(spark, odd_docs, no_docs):
    items = odd_docs.filter("doc_id in (5, 1, 2, 9)").withColumn("item_id", F.lit(7))
    got = {(r.doc_id, r.item_id) for r in contaminated(odd_docs, items).collect()}
    assert (5, 7) in got and (None, 7) in got and (8, 7) in got and (4, 7) not in got
    assert contaminated(no_docs, items).count() == 0 and contaminated(odd_docs, items.limit(0)).count() == 0


def test_licenses_against_brute_force(spark):
    texts = ["The MIT License. mit license", "GNU General Public License, version 3", "cc by cc by-nc 4.0", "Apache\nLicense, Version 2.0", "gnu general public", None, "", "mit  LICENSE " * 3, "ﬀ mit licenseé"]
    split = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r.doc_id: r for r in scan_licenses(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for d, t in enumerate(texts):
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = split.findall(low)
        at = [(i, label) for p, label in PHRASES.items() for i in range(len(w)) if w[i : i + len(p.split())] == p.split()]
        r = got[d]
        assert (r.n_words, r.n_base, r.base_labels) == (len(w), len(at), ",".join(sorted({x for _, x in at})))
        assert (r.first_word, r.last_word) == ((min(i for i, _ in at), max(i for i, _ in at)) if at else (None, None))
        assert set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(",")))
    assert "gpl-3.0" in got[1].labels and "apache-2.0" in got[3].labels and got[4].labels == "" and got[4].score == 0


def test_license_merges_neighbouring_diagonals(spark):
    notice = "Permission is hereby granted, free of charge, to any other person obtaining a copy of this software and associated documentation files"
    r = scan_licenses(spark.createDataFrame([(1, notice), (2, "Permission is granted of charge")], "doc_id long, text string")).orderBy("doc_id").collect()
    assert r[0].labels == "mit-text" and 0.8 < r[0].score < 1 and r[1].labels == ""


def test_licenses_odd_rows(odd_docs, no_docs):
    got = Counter(r.doc_id for r in scan_licenses(odd_docs).collect())
    assert got[5] == 2 and len(got) == 11 and scan_licenses(no_docs).count() == 0


def test_syncmers_by_brute_force():
    text = "the quick brown fox jumps over the lazy dog again and again"
    places, hashes = closed_syncmers(text, 8, 3)
    inner, _ = closed_syncmers(text, 3, 3)
    assert len(inner) == len(text) - 2 and len(places) == len(hashes)
    gaps = [b - a for a, b in zip(places, places[1:], strict=False)]
    assert max(gaps) <= 8 - 3  # one in every window of k - s places
    same, _ = closed_syncmers("XX" + text, 8, 3)
    assert {p + 2 for p in places.tolist()} <= set(same.tolist())  # context-free


def test_fingerprints_against_brute_force(spark, prose_of):
    docs = [(i * 3, prose_of(i, 5 + i * 7)) for i in range(25)] + [(7, None), (8, "a"), (9, "é😀xyz" * 9)]
    order = sorted((d, t or "") for d, t in docs)
    want = {}
    for i, (d, t) in enumerate(order):
        nxt, k = order[(i + 1) % len(order)][1], len(t) // 4
        e = t[: len(t) - k] + nxt[:k]
        want[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), fingerprint(t), fingerprint(e), likeness(fingerprint(t), fingerprint(e)), likeness(fingerprint(t), fingerprint(nxt)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    for size in (300, 1 << 20):
        assert {r.doc_id: tuple(r)[1:] for r in fingerprint_documents(df, range_bytes=size).collect()} == want


def test_fingerprints_keep_all_anchors(prose_of):
    for text in (prose_of(1, 3000), "a", "é😀xyz" * 900, "x" * 5000):
        places, hashes = closed_syncmers(text)
        at, have = anchors(fingerprint(text))
        assert at.tolist() == places.tolist() and have.tolist() == (hashes >> np.uint64(24)).tolist()


def test_likeness_sees_passages_edits_and_order(prose_of):
    a, b, shared = prose_of(1, 2000), prose_of(2, 2000), " ".join("".join(chr(97 + (i * i * 7 + j * 5 + i) % 26) for j in range(8)) for i in range(100))
    cut = len(a) // 2
    joined = likeness(fingerprint(a[:cut] + shared + a[cut:]), fingerprint(b + shared))
    assert joined - likeness(fingerprint(a), fingerprint(b)) > 0.01
    assert 0.9 < likeness(fingerprint(a), fingerprint(a[:cut] + "!" + a[cut + 1 :])) < 1
    assert likeness(fingerprint(a), fingerprint(a[cut:] + a[:cut])) < 0.5


def test_common_anchors_in_order_by_brute_force():
    rng = np.random.default_rng(5)
    for top, most in ((3, 60), (2000, 300), (40, 200)):
        for _ in range(15):
            x, y = (rng.integers(0, top, rng.integers(0, most)) for _ in range(2))
            row = [0] * (len(y) + 1)
            for v in x:
                last = row[:]
                for j, w in enumerate(y, 1):
                    row[j] = last[j - 1] + 1 if v == w else max(last[j], row[j - 1])
            assert in_order(x, y) == row[-1]


def test_fingerprints_odd_rows(spark, odd_docs, no_docs):
    got = fingerprint_documents(odd_docs).collect()
    assert Counter(r.doc_id for r in got)[5] == 2 and len(got) == 12 and fingerprint_documents(no_docs).count() == 0
    one = fingerprint_documents(odd_docs.filter("doc_id = 7")).first()
    assert one.near_next == 1.0 and likeness("", "") == 1.0 and likeness("", fingerprint("abc")) == 0.0


def test_poisson_counts(spark):
    for mean in (0.0, 0.3, 2.5, 40.0):
        r = spark.range(20_000).select(poisson_count(F.lit(mean), F.col("id"), F.lit(1)).alias("k")).agg(F.avg("k"), F.variance("k")).first()
        assert abs(r[0] - mean) < 4 * math.sqrt(mean / 20_000) + 1e-9 and abs(r[1] - mean) < 0.1 * mean + 1e-9


def test_mixing(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "big").otherwise("small").alias("source"), F.lit("x" * 10).alias("text"))
    got = mix_sources(docs, {"big": 1.0, "small": 1.0}).groupBy("source").count().collect()
    assert all(abs(r["count"] - 3000) < 250 for r in got)
    again = mix_sources(docs.repartition(13), {"big": 1.0, "small": 1.0})
    assert Counter(map(tuple, again.collect())) == Counter(map(tuple, mix_sources(docs, {"big": 1.0, "small": 1.0}).collect()))
    assert {r.source: r.rate for r in source_rates(docs, {"big": 1.0}).collect()} == {"big": 1.5, "small": 0.0}


def test_mixing_odd_rows(odd_docs, no_docs):
    got = mix_sources(odd_docs, mean=3.0)
    assert set(odd_docs.columns) == set(got.columns) and got.count() > 0 and mix_sources(no_docs).count() == 0


@pytest.mark.parametrize("name", ["op4_warc", "op5_contamination", "op7_license_scan", "op9_mixing", "op10_near_dedup"])
def test_sql(name, spark, duck, data):
    df = queries.QUERIES[name](spark, data)
    rel = duck.sql(queries.ORACLES[name])
    assert sorted(map(repr, map(tuple, df.select(*rel.columns).collect()))) == sorted(map(repr, rel.fetchall()))


def test_choice_of_syncmers_by_brute_force():
    mask = (1 << 64) - 1

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def value(s):
        h = len(s)
        for ch in s:
            h = (h * 0x9E3779B97F4A7C15 + ord(ch)) & mask
        return mixed(h)

    text = "The quick brown fox jumps over the lazy dog, naïve \U0001f600 and the quick brown fox again and again."
    for k, s in ((16, 5), (9, 3)):
        chosen = []
        for i in range(len(text) - k + 1):
            inner = [value(text[i + j : i + j + s]) for j in range(k - s + 1)]
            if min(inner) in (inner[0], inner[-1]):
                chosen.append((i, value(text[i : i + k])))
        places, hashes = closed_syncmers(text, k, s)
        assert list(zip(places.tolist(), hashes.tolist(), strict=True)) == chosen and chosen


def test_shuffled_blocks_are_less_alike(prose_of):
    w = prose_of(31, 400).split()
    blocks = [" ".join(w[i : i + 20]) for i in range(0, 400, 20)]
    mixed = [blocks[i * 7 % 20] for i in range(20)]
    assert likeness(fingerprint(" ".join(blocks)), fingerprint(" ".join(mixed))) < 0.35
    assert likeness(fingerprint(" ".join(blocks)), fingerprint(" ".join(blocks[:10] + ["some new words here"] + blocks[10:]))) > 0.9


def test_fingerprints_of_large_ids_beside_null(spark):
    ids = [2**53 + 1, 2**53 + 3, 2**63 - 1, None]
    docs = spark.createDataFrame([(i, f"some text number {n}") for n, i in enumerate(ids)], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in fingerprint_documents(docs).collect()} == set(ids)


def test_rows_without_an_id_draw_by_their_text(spark):
    docs = spark.createDataFrame([(None, f"text {i}", "s") for i in range(300)] + [(1, "x", "s")], "doc_id long, text string, source string")
    got = mix_sources(docs).groupBy("text").count().collect()
    assert 150 < len(got) < 240 and max(r["count"] for r in got) < 9


def test_pairs_are_verified_once(spark, prose_of):
    w = prose_of(901, 60).split()
    docs = spark.createDataFrame([(1, " ".join(w)), (2, " ".join(w[:40])), (None, " ".join(w[5:]))], "doc_id long, text string")
    items = spark.createDataFrame([(5, " ".join(w[5:35])), (6, " ".join(w[30:])), (6, "quite another text of six words")], "item_id long, text string")
    found = candidates(docs, items)
    assert found.count() == found.distinct().count() > 3
    assert sorted(map(str, candidates(docs, items, broadcast_rows=0).distinct().collect())) == sorted(map(str, found.distinct().collect()))
