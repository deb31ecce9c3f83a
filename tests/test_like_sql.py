"""Results that Spark's own functions give otherwise than the SQL."""

import duckdb
from pyspark.sql import functions as F

from corpusloom.functions import text as T
from corpusloom.operators import export


def test_upper_case_of_each_character(spark):
    texts = ["Straße ß", "ﬁn ᾳ ŉ ΰ ß", "éà", "", None, *[chr(c) for c in (0x1E96, 0x1F80, 0x1F88, 0x1FB2, 0x1FBC, 0x0587, 0xFB13, 0x01F0, 0x0390, 0x1E9E, 0x01C6)]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.u for r in df.select("i", T.upper_each(F.col("t")).alias("u")).orderBy("i").collect()]
    assert got == [duckdb.execute("SELECT upper(?::VARCHAR)", [t]).fetchall()[0][0] for t in texts]


def test_scores_are_printed_by_their_exact_value(spark):
    scores = [0.0625, 0.3145, 0.3125, 0.4305, 1.0, -0.1235, 0.0005]
    found = spark.createDataFrame([(1, i + 1, "s", x, "t") for i, x in enumerate([*scores, None])], "query_id long, rank int, source string, score double, snippet string")
    text = export.search_markdown(found, spark.createDataFrame([(1, "q")], "query_id long, query string"), "score").first().markdown
    want = [duckdb.execute("SELECT printf('%.3f', ?::DOUBLE)", [x]).fetchall()[0][0] for x in scores]
    assert [line.split("score: ")[1][:-1] for line in text.split("\n") if line.startswith("## ")] == [*want, "Unranked"]
