import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from corpusloom.operators import indexing
from corpusloom.streaming import events as E


def at(s):
    return datetime(2024, 1, 1) + timedelta(seconds=s)


def feed(frame, path, *groups):
    """Write the rows of each group (a condition) as a file of its own, in order."""
    for g in groups:
        frame.filter(g).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.05)


def file_events(spark, rows):
    return spark.createDataFrame([(i, f, k, p, o, d, at(s)) for i, (f, k, p, o, d, s) in enumerate(rows)], E.SCHEMA)


def run(spark, frame, tmp_path, name):
    q = frame.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(240)
    got = spark.sql(f"select * from {name}")
    return spark.createDataFrame(got.collect(), got.schema)


def test_closed_bursts_equal_the_batch_form(spark, tmp_path):
    rows = []
    for i in range(400):
        folder, second = f"f{i % 3}", (i // 40) * 30 + (i % 40) * 0.01
        kind = ["CREATE", "MODIFY", "MOVE", "DELETE"][i * 7 % 4]
        whole = i % 29 == 0
        path = f"/{folder}/d{i % 4}" + ("" if whole else f"/x{i % 5}")
        rows.append((folder, kind, path, f"/{folder}/d{i % 4}/x{(i + 1) % 5}" if kind == "MOVE" and not whole else None, whole, second))
    rows += [(f"f{k}", "CREATE", f"/f{k}/end{j}", None, False, 9000 + 100 * j) for k in range(3) for j in range(2)]
    e = file_events(spark, rows)
    feed(e, tmp_path / "in", "event_id < 130", "event_id >= 130 and event_id < 250", "event_id >= 250 and event_id <> 404", "event_id = 404")
    closed = run(spark, E.closed_bursts(E.event_source(spark, str(tmp_path / "in"), 1)), tmp_path, "all_bursts")
    want = E.with_burst(e).filter("path not like '%/end1'")
    assert closed.count() == want.count()
    per = lambda df: {frozenset(r.ids) for r in df.groupBy("folder_id", "burst").agg(F.collect_set("event_id").alias("ids")).collect()}
    assert per(closed) == per(want)
    done = lambda df: {(r.folder_id, r.path, r.event_type, r.event_id) for r in E.coalesce_events(E.collapse_cascades(df)).collect()}
    assert done(closed) == done(want)


def test_a_large_burst_of_one_folder(spark, tmp_path):
    n = 100_000
    e = spark.range(n + 1).select(F.col("id").alias("event_id"), F.lit("r").alias("folder_id"), F.lit("CREATE").alias("event_type"), F.concat(F.lit("/r/f"), "id").alias("path"), F.lit(None).cast("string").alias("old_path"), F.lit(False).alias("is_directory"), F.timestamp_micros(F.lit(1_700_000_000_000_000) + F.col("id") * 1000 + F.when(F.col("id") == n, 60_000_000).otherwise(0)).alias("observed_at"))
    feed(e, tmp_path / "in", f"event_id < {n // 2}", f"event_id >= {n // 2} and event_id < {n}", f"event_id = {n}")
    closed = run(spark, E.closed_bursts(E.event_source(spark, str(tmp_path / "in"), 1)), tmp_path, "large_burst")
    assert (closed.count(), closed.select("burst").distinct().count(), closed.select("path").distinct().count()) == (n, 1, n)


def test_late_rows_are_counted(spark, tmp_path):
    late = E.LateRows()
    spark.streams.addListener(late)
    try:
        seconds = [0, 1, 2, 3600, 3601, 5, 6, 3602, 7, 3000]  # a batch after the second file's, what is before 3001 s is late
        rows = [("r", "CREATE", f"/r/{i}", None, False, float(s)) for i, s in enumerate(seconds)]
        feed(file_events(spark, rows), tmp_path / "in", "event_id < 3", "event_id in (3, 4)", "event_id = 7", "event_id in (5, 6, 8)", "event_id = 9")
        got = run(spark, E.without_late_repeats(E.event_source(spark, str(tmp_path / "in"), 1), "10 minutes"), tmp_path, "late_rows")
        assert {r.event_id for r in got.collect()} == {0, 1, 2, 3, 4, 7}
        for _ in range(100):
            counts = late.table(spark).filter("query = 'late_rows'").agg(F.sum("dropped"), F.sum("input_rows")).first()
            if counts[1] == 10:
                break
            time.sleep(0.2)
        assert tuple(counts) == (4, 10)
    finally:
        spark.streams.removeListener(late)


FILES = "file_id string, text string, extension string, sha256 string, deleted boolean, seq int"


def file_rows(spark, *rows):
    df = spark.createDataFrame([(f, t, e, None, d, s) for f, t, e, d, s in rows], FILES)
    return df.withColumn("sha256", F.sha2("text", 256))


def test_index_of_a_stream_of_files(spark, tmp_path):
    first = file_rows(spark, ("a", "one text", ".txt", False, 0), ("b", "# Head\n\nbody", ".md", False, 0), ("c", "to go", ".txt", False, 0), ("d", "binary", ".bin", False, 0), ("e", "x,y\n1,2", ".csv", False, 0))
    second = file_rows(spark, ("a", "old", ".txt", False, 1), ("a", "another text", ".txt", False, 2), ("b", "# Head\n\nbody", ".md", False, 0), ("c", "to go", ".txt", True, 5), ("f", None, ".txt", True, 1))
    for frame in (first, second):
        feed(frame, tmp_path / "in", "true")
    path = str(tmp_path / "index")
    source = spark.readStream.schema(FILES).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    indexing.run_index(source, str(tmp_path / "cp"), path, buckets=4).awaitTermination(240)

    def state():
        return {(r.file_id, r.content, r.batch_id, tuple(r.embedding)) for r in indexing.indexed_chunks(spark, path).collect()}

    got = state()
    assert {(f, b) for f, _, b, _ in got} == {("a", 1), ("b", 0), ("e", 0)} and {c for f, c, _, _ in got if f == "a"} == {"another text"}
    assert all(abs(sum(x * x for x in v) - 1) < 1e-5 for *_, v in got)
    indexing.index_batch(second, path, 1, buckets=4)  # a batch that runs again
    assert state() == got
    chunks = spark.createDataFrame([("a", "another text")], "chunk_id string, content string")
    assert [tuple(r.embedding) for r in indexing.hashing_embedder(chunks).collect()] == [v for f, _, _, v in got if f == "a"]
    indexing.index_batch(file_rows(spark, *[(f, "", ".txt", True, 9) for f in "abe"]), path, 2, buckets=4)
    assert state() == set()
