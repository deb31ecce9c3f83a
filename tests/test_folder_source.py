import os
import time

from corpusloom.sources import extract, folder


def tree(tmp_path):
    for name, text in {"a.md": "# A", "x/b.TXT": "bb", "x/deep/er/c.md": "ccc", "y/d": "d", "y/e.csv": "k,v\n1,2"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_the_source_lists_what_scan_files_lists(spark, tmp_path):
    root = tree(tmp_path)
    folder.register(spark)
    got = spark.read.format("corpus_folder").load(root)
    names = ("relative_path", "filename", "extension", "size_bytes")
    rows = lambda df: sorted(tuple(r[c] for c in names) for r in df.collect())
    assert rows(got) == rows(extract.scan_files(spark, root)) and len(rows(got)) == 5
    assert got.rdd.getNumPartitions() == 3
    assert {r.filename for r in spark.read.format("corpus_folder").option("pattern", "*.md").load(root).collect()} == {"a.md", "c.md"}
    assert {r.filename for r in spark.read.format("corpus_folder").option("recursive", "false").load("file://" + root).collect()} == {"a.md"}
    assert spark.read.format("corpus_folder").load(root + "/none").count() == 0


def test_the_stream_lists_new_and_changed_files(spark, tmp_path):
    root = tree(tmp_path / "files")
    folder.register(spark)

    def advance():
        source = spark.readStream.format("corpus_folder").option("settle", "0").load(root)
        out = source.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        out.awaitTermination(120)
        return sorted(r.filename for r in spark.read.parquet(str(tmp_path / "out")).collect())

    first = advance()
    assert first == ["a.md", "b.TXT", "c.md", "d", "e.csv"]
    time.sleep(0.05)
    (tmp_path / "files/y/new.md").write_text("new")
    (tmp_path / "files/a.md").write_text("# changed")
    os.utime(tmp_path / "files/a.md")
    assert advance() == sorted([*first, "new.md", "a.md"])


def test_extraction_as_a_table_function(spark):
    folder.register(spark)
    spark.createDataFrame([("1", "delimited", "k;v\n1;2"), ("2", "json", '{"a": 1}'), ("3", "none", "x"), ("4", "rtf", None)], "file_id string, branch string, text string").createOrReplaceTempView("texts")
    got = spark.sql("SELECT file_id, e.* FROM texts, LATERAL extract_elements(branch, text) e ORDER BY file_id, elem_idx").collect()
    assert [(r.file_id, r.elem_idx, r.type) for r in got] == [("1", 0, "TABLE"), ("2", 0, "HEADING"), ("2", 1, "PARAGRAPH")]
