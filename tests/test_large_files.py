import csv
import io
import random

from corpusloom.sources import large
from corpusloom.sources.extract import parse_delimited


def rows_of(seed, n):
    rng = random.Random(seed)
    words = ["a", "b c", 'say "x"', "two\nlines", "semi;colon", "", "comma, no", "é"]
    return [[str(i), rng.choice(words), rng.choice(words)] for i in range(n)]


def written(rows):
    out = io.StringIO()
    csv.writer(out, delimiter=";", lineterminator="\n").writerows([["id", "x", "y"], *rows])
    return out.getvalue()


def test_records_across_blocks(spark):
    files = {f"f{s}": rows_of(s, n) for s, n in enumerate((0, 1, 7, 200))}
    df = spark.createDataFrame([(f, written(r)) for f, r in files.items()] + [("null", None), ("empty", ""), ("open", 'h;i\na;"never\nclosed')], "file_id string, text string")
    for size in (1, 3, 1000):
        got = {}
        for r in large.delimited_cells(large.delimited_records(large.lines_of_texts(df, size))).collect():
            got.setdefault(r.file_id, {})[r.record] = list(r.cells)
        assert {f: [c[i] for i in sorted(c)] for f, c in got.items()} == {f: r for f, r in files.items() if r} | {"open": [["a", "never\nclosed"]]}


def test_one_file_in_many_parts(spark, tmp_path):
    rows = rows_of(9, 4000)
    (tmp_path / "big.csv").write_text(written(rows))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        lines = large.lines_of_files(spark, str(tmp_path / "big.csv"))
        assert lines.select("block").distinct().count() > 8
        cells = large.delimited_cells(large.delimited_records(lines))
        assert [list(r.cells) for r in cells.orderBy("record").collect()] == rows
        tables = large.delimited_tables(cells).orderBy("elem_idx").collect()
        assert [(r.level, r.text) for r in tables] == [(level, text) for _, level, text in parse_delimited(written(rows))]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
