import unicodedata

import duckdb
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import search

WORDS = ["Café crème", "cafe\u0301 noir", "ＦＵＬＬ　ｗｉｄｔｈ１２", "ﬁne ﬂow ㎏ ①②", "Ünïcödé ß Ø ł", "Ελλάδα Ёлка", "가나다 日本語 ｶﾞ", "naïve — “x”…", "plain ascii_word", "", "e\u0301e\u0300 a\u030a", "x²y³ ½", "ｶ\uff9e"]


def test_compatible_forms(spark):
    got = [r[0] for r in spark.createDataFrame([(w,) for w in WORDS], "w string").select(T.compatible(F.col("w"))).collect()]
    assert got == [unicodedata.normalize("NFKC", w) for w in WORDS]


def test_marks_go_as_in_sql(spark):
    words = [w for w in WORDS if not any("\uac00" <= c <= "\ud7a3" or "\uff00" <= c <= "\uffef" for c in w)]
    got = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(T.without_marks(F.col("w"))).collect()]
    assert got == [duckdb.execute("select strip_accents(nfc_normalize(?))", [w]).fetchone()[0] for w in words]


def test_every_letter_of_the_tables(spark):
    letters = [chr(c) for c in range(0xA0, 0x3000) if unicodedata.category(chr(c)) in ("Lu", "Ll", "Sm", "No", "So", "Sk")]
    df = spark.createDataFrame([(c,) for c in letters], "c string").select("c", T.compatible(F.col("c")).alias("k"), T.without_marks(F.col("c")).alias("p"))
    for r in df.collect():
        assert r.k == unicodedata.normalize("NFKC", r.c)
        parts = unicodedata.normalize("NFD", r.c)
        assert r.p == (parts[0] if len(parts) > 1 and all("\u0300" <= m <= "\u036f" for m in parts[1:]) else r.c)


def test_a_search_without_accents_finds_accents(spark):
    chunks = spark.createDataFrame([(1, "Le CAFÉ est fermé"), (2, "cafe\u0301 ouvert"), (3, "rien")], "chunk_id long, content string")
    q = spark.createDataFrame([(7, "cafe"), (8, "café"), (9, "ferme")], "query_id long, query string")
    found = {(r.query_id, r.chunk_id) for r in search.lexical_search(q, chunks).collect()}
    assert found == {(7, 1), (7, 2), (8, 1), (8, 2), (9, 1)}


def test_no_python_worker(spark):
    df = spark.createDataFrame([("é",)], "t string").select(T.tokenize(F.col("t")), T.query_tokens(F.col("t")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
