import base64
import hashlib
import itertools
import math
import re

import pytest

import corpus_pipeline
from corpusloom.llm import queries
from corpusloom.llm.common import table
from corpusloom.llm.near_dedup import near_duplicates
from corpusloom.llm.warc import _open, archive_folder, build_record, parse_record, read_archives, read_records, write_archives


def test_round_trip(spark):
    rows = [(1, "http://a/1", "<p>same</p>"), (2, "http://a/2", "<p>same</p>"), (9, None, "<p>same</p>"), (3, "u", ""), (4, "u", None), (5, "http://é\r\nx", "ünï"), (None, "n", "only"), (6, "z", "y" * 300_000), (7, "r", "rep"), (7, "r", "rep")]
    pages = spark.createDataFrame([(*r, "x", "x") for r in rows], "page_id long, url string, html string, key string, refers_to string")
    manifest = write_archives(pages, archive_folder(spark), archive_bytes=2000)
    got = {}
    for r in read_archives(spark, manifest).collect():
        got.setdefault(r.page_id, []).append(r)
    for page, _, html in rows:
        payload = (html or "").encode()
        assert all(r.payload_bytes == len(payload) and r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode() for r in got[page])
    kinds = {p: sorted((r.record_type, r.refers_to) for r in v) for p, v in got.items()}
    assert kinds[1] == kinds[2] == [("revisit", 9)] and kinds[9] == [("response", None)] and kinds[3] == [("revisit", 4)] and kinds[4] == [("response", None)]
    assert kinds[7] == [("response", None), ("revisit", 7)] and kinds[None] == [("response", None)]
    archive = manifest.first().archive
    fs, path = _open(archive)
    records = [parse_record(data)[0] for _, data in read_records(fs, path)]
    assert records[0]["WARC-Type"] == "warcinfo" and all(f["X-Payload-Length"].isdigit() for f in records[1:]) and len(records) > 1
    assert write_archives(pages.limit(0), archive_folder(spark)).count() == 0
    small = {r.record_type for r in read_archives(spark, write_archives(pages, archive_folder(spark), least_bytes=20)).filter("payload_bytes < 20").collect()}
    assert small == {"response"}


def test_record():
    fields, payload = parse_record(build_record("n", "1", "u", b"a\r\n\r\nb", 6, "S", "d"))
    assert payload == b"a\r\n\r\nb" and fields["WARC-Type"] == "response"
    again, block = parse_record(build_record("m", "2", None, None, 6, "S", "d", ("n", "1", "u")))
    assert again["WARC-Refers-To"] == fields["WARC-Record-ID"] != again["WARC-Record-ID"] and again["WARC-Refers-To-Target-URI"] == "u" and block == b""


def test_large_ids_beside_null(spark):
    rows = [(2**53 + 1, "a", "x"), (2**53 + 3, "a", "x"), (2**63 - 1, "a", "y"), (None, "a", "y"), (None, "a", "z"), (None, "b", "z"), (2**53 + 1, "a", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = sorted((r.payload_digest, r.page_id or 0, r.url, r.record_type, r.refers_to) for r in read_archives(spark, write_archives(pages, archive_folder(spark))).collect())
    sha = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    want = [(sha("x"), 2**53 + 1, "a", "revisit", 2**53 + 3)] * 2 + [(sha("x"), 2**53 + 3, "a", "response", None), (sha("y"), 0, "a", "revisit", 2**63 - 1), (sha("y"), 2**63 - 1, "a", "response", None), (sha("z"), 0, "a", "revisit", None), (sha("z"), 0, "b", "response", None)]
    assert got == sorted(want)


def test_query_covers_every_page(spark, data):
    got = queries.op4_warc(spark, data)
    assert got.count() == table(spark, data, "pages").count() == got.select("page_id").distinct().count()


def test_pipeline(spark, data):
    docs = table(spark, data, "documents")
    read = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, data).cache()
        assert out.columns == docs.columns
        read[name] = {r.doc_id for r in out.collect()}
        assert read[name] <= {r.doc_id for r in docs.select("doc_id").collect()}
        docs = out
    kept = {r.doc_id for r in near_duplicates(table(spark, data, "documents").filter(f"doc_id in ({','.join(map(str, read['language']))})")).filter("kept").collect()}
    assert read["near_dedup"] == kept
    labels = {r.doc_id: r.toxic for r in table(spark, data, "labels").collect()}
    clean = [d for d in labels if not labels[d] and d in {r.doc_id for r in table(spark, data, "documents").collect()}]
    assert len(set(clean) - read["toxicity"]) <= 0.05 * len(clean)
    final = corpus_pipeline.run(spark, data)
    assert {r.doc_id for r in final.select("doc_id").collect()} <= read["decontamination"]


def test_stages_on_odd_rows(spark, odd_docs, no_docs, data):
    docs = odd_docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES:
        assert name == "mixing" or stage(spark, docs, data).count() <= docs.count()
        assert stage(spark, docs.limit(0), data).count() == 0


def test_decontamination_judges_rows_without_an_id_one_by_one(spark, data, prose_of):
    item = next(r.text for r in table(spark, data, "benchmark").collect() if len((r.text or "").split()) >= 20)
    words = item.split()
    half = len(words) // 2
    texts = {"clean": prose_of(1, 80), "leak": f"{prose_of(2, 40)} {item}", "start": f"{prose_of(3, 40)} {' '.join(words[: half + 2])}", "end": f"{' '.join(words[half - 2 :])} {prose_of(4, 40)}"}
    docs = spark.createDataFrame([(i, t, s) for i in (None, 5) for s, t in texts.items()] + [(None, None, "null")], "doc_id long, text string, source string")
    kept = sorted((r.doc_id or 0, r.source) for r in corpus_pipeline.decontamination(spark, docs, data).collect())
    assert kept == sorted([(i, s) for i in (0, 5) for s in ("clean", "start", "end")] + [(0, "null")])


def linked_to_a_lesser(docs):
    """Ids of documents that are reachable from a lesser one by links of 75 % on five-word shingles: all pairs."""
    sets, root = {}, {}
    for d, t in docs:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
        root[d] = d

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {d for d in root if find(d) != d}


def holds_an_item(text, items):
    cut = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    w = cut(text)
    for item in items:
        x = cut(item)
        k = min(5, len(x))
        want = {tuple(x[i : i + k]) for i in range(len(x) - k + 1)} if x else set()
        if want and len(want & {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) >= 0.75 * len(want):
            return True
    return False


def test_stages_by_brute_force(spark, data):
    docs = table(spark, data, "documents")
    texts = {r.doc_id: r.text for r in docs.collect()}
    kept = {r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, data).collect()}
    assert kept == set(texts) - linked_to_a_lesser(texts.items()) and len(kept) < len(texts)
    items = [r.text for r in table(spark, data, "benchmark").collect()]
    clean = {r.doc_id for r in corpus_pipeline.decontamination(spark, docs, data).collect()}
    assert clean == {d for d, t in texts.items() if not holds_an_item(t, items)}
    no_letter = {d for d, t in texts.items() if not any(c.isalpha() for c in t or "")}
    known = {r.doc_id for r in corpus_pipeline.language(spark, docs, data).collect()}
    assert not known & no_letter and len(known) >= 0.95 * (len(texts) - len(no_letter))
    by_source = {}
    for r in docs.collect():
        by_source.setdefault(r.source, []).append(max(1, len(r.text or "")))
    chars = {s: sum(v) for s, v in by_source.items()}
    rate = {s: round(c**0.5 / sum(x**0.5 for x in chars.values()) * sum(chars.values()) / c, 6) for s, c in chars.items()}
    want = {}
    for r in docs.collect():
        u = int(hashlib.md5(f"{r.doc_id}:7:1".encode()).hexdigest()[:13], 16) / 2**52
        assert rate[r.source] <= 16
        n, p = 0, math.exp(-rate[r.source])
        total = p
        while u >= total:
            n += 1
            p *= rate[r.source] / n
            total += p
        if n:
            want[r.doc_id] = n
    assert {r.doc_id: r["count"] for r in corpus_pipeline.mixing(spark, docs, data).groupBy("doc_id").count().collect()} == want


@pytest.mark.parametrize("more", [[], [(5, "x y z"), (5, "x y z")]])
def test_near_dedup_keeps_rows_without_an_id(spark, data, prose_of, more):
    docs = spark.createDataFrame([(None, prose_of(1, 40)), (None, prose_of(1, 40)), (2, prose_of(1, 40)), (3, prose_of(1, 40)), *more], "doc_id long, text string")
    got = [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, data).collect()]
    assert sorted(got, key=str) == sorted([None, None, 2, *([5] if more else [])], key=str)
