"""File events as a stream, and the same operators in batch form.

Events: event_id, folder_id, event_type, path, old_path, is_directory, observed_at. State is kept by folder and path, as a folder's event concerns the paths
under it. A burst is a session of events of one folder with gaps shorter than the quiet time.
"""

from __future__ import annotations

from bisect import bisect_right

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from corpusloom.operators import lifecycle
from corpusloom.operators.lifecycle import ancestors

SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("folder_id", T.StringType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("old_path", T.StringType()),
        T.StructField("is_directory", T.BooleanType()),
        T.StructField("observed_at", T.TimestampType()),
    ]
)


def event_source(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def bursts(events: DataFrame, quiet: str = "500 milliseconds", late: str = "5 seconds") -> DataFrame:
    """(folder_id, started, ended, n, first_event, last_event) of each burst; the same code for a stream and a table."""
    e = events.withWatermark("observed_at", late) if events.isStreaming else events
    g = e.groupBy("folder_id", F.session_window("observed_at", quiet).alias("s"))
    return g.agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("first_event"), F.max("event_id").alias("last_event")).select("folder_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n", "first_event", "last_event")


def with_burst(events: DataFrame, quiet_seconds: float = 0.5) -> DataFrame:
    """events of a table with the number of their burst in the folder."""
    w = W.partitionBy("folder_id").orderBy("observed_at", "event_id")
    gap = F.col("observed_at").cast("timestamp").cast("double") - F.lag(F.col("observed_at").cast("timestamp").cast("double")).over(w)
    return events.withColumn("_new", F.coalesce(gap >= quiet_seconds, F.lit(True)).cast("int")).withColumn("burst", F.sum("_new").over(w)).drop("_new")


def coalesce_events(events: DataFrame) -> DataFrame:
    """One event for each folder, burst and path: the last one; a CREATE followed by MODIFY only stays a CREATE with the later time. events: with burst."""
    g = events.groupBy("folder_id", "burst", "path").agg(
        F.max_by(F.struct("event_id", "event_type", "old_path", "is_directory", "observed_at"), F.struct("observed_at", "event_id")).alias("last"),
        F.min_by("event_type", F.struct("observed_at", "event_id")).alias("first_type"),
        F.bool_and(F.col("event_type").isin("CREATE", "MODIFY")).alias("writes_only"),
    )
    kind = F.when((F.col("first_type") == "CREATE") & F.col("writes_only"), "CREATE").otherwise(F.col("last.event_type"))
    return g.select("folder_id", "burst", "path", "last.event_id", kind.alias("event_type"), "last.old_path", "last.is_directory", "last.observed_at")


def collapse_cascades(events: DataFrame) -> DataFrame:
    """events (with burst) without those that a folder's DELETE or MOVE in the same burst covers, and with a file's CREATE then MOVE made a CREATE at the new path."""
    gone = events.filter(F.col("is_directory") & F.col("event_type").isin("DELETE", "MOVE")).select("folder_id", "burst", F.coalesce("old_path", "path").alias("dir"), F.col("event_type").alias("by"), F.struct("observed_at", "event_id").alias("at")).groupBy("folder_id", "burst", "dir").agg(F.max("at").alias("at"))
    place = F.coalesce("old_path", "path")
    under = events.select("folder_id", "burst", "event_id", "event_type", F.struct("observed_at", "event_id").alias("own"), F.explode(ancestors(place)).alias("dir"))
    # pending child events go with the folder; of later ones only further deletes
    covered = under.join(gone, ["folder_id", "burst", "dir"]).filter((F.col("own") < F.col("at")) | (F.col("event_type") == "DELETE")).select("event_id").distinct()
    left = events.join(covered, "event_id", "left_anti")
    born = left.filter(~F.col("is_directory") & (F.col("event_type") == "CREATE")).select("folder_id", "burst", F.col("path").alias("from"), F.col("event_id").alias("born_id"))
    moved = left.filter(~F.col("is_directory") & (F.col("event_type") == "MOVE"))
    joined = moved.join(born, (moved["folder_id"] == born["folder_id"]) & (moved["burst"] == born["burst"]) & (moved["old_path"] == born["from"]) & (born["born_id"] < moved["event_id"])).select(moved["event_id"], "born_id")
    out = left.join(joined.select(F.col("born_id").alias("event_id")).distinct(), "event_id", "left_anti").join(joined.select("event_id", F.lit(True).alias("_born")).distinct(), "event_id", "left")
    born_here = F.col("_born").isNotNull()
    return out.withColumn("event_type", F.when(born_here, "CREATE").otherwise(F.col("event_type"))).withColumn("old_path", F.when(born_here, F.lit(None).cast("string")).otherwise(F.col("old_path"))).drop("_born")


def scoped_events(events: DataFrame, folders: DataFrame) -> DataFrame:
    """events as they concern their folder (folders: folder_id, root, indexing_enabled), which is to be known and enabled. A move out of the root is a DELETE of the old
    path, one into it a CREATE of the new path; what happens outside the root is left out. A folder that moves in is a CREATE of a folder, to be scanned."""
    known = folders.filter("indexing_enabled").select("folder_id", F.regexp_replace("root", "/+$", "").alias("_root"))
    inside = lambda c: F.coalesce((F.col(c) == F.col("_root")) | F.startswith(F.col(c), F.concat("_root", F.lit("/"))), F.lit(False))
    move = F.col("event_type").isin("MOVE", "RENAME") & F.col("old_path").isNotNull()
    e = events.join(lifecycle.small(known), "folder_id").withColumn("_new", inside("path")).withColumn("_old", F.when(move, inside("old_path")).otherwise(F.col("_new")))
    e = e.filter(F.col("_new") | F.col("_old"))
    left, came = move & ~F.col("_new"), move & ~F.col("_old")
    changed = {"event_type": F.when(left, "DELETE").when(came, "CREATE").otherwise(F.col("event_type")), "path": F.when(left, F.col("old_path")).otherwise(F.col("path")), "old_path": F.when(left | came, F.lit(None).cast("string")).otherwise(F.col("old_path"))}
    return e.select(*[changed.get(c, F.col(c)).alias(c) for c in events.columns])


def apply_events(files: DataFrame, events: DataFrame) -> DataFrame:
    """The file table (path, file_id, index_status, modified_at) after a coalesced batch: CREATE and MODIFY queue a file, DELETE marks a file or all under a folder as missing, MOVE and RENAME rewrite paths."""
    moves = events.filter(F.col("event_type").isin("MOVE", "RENAME") & F.col("old_path").isNotNull()).select(F.col("old_path").alias("folder"), F.col("path").alias("new_folder"))
    exact = moves.select(F.col("folder").alias("path"), F.col("new_folder").alias("_to"))
    f = lifecycle.apply_renames(files, moves).join(exact, "path", "left").withColumn("path", F.coalesce("_to", "new_path")).select("path", "file_id", "index_status", "modified_at")
    gone = events.filter("event_type = 'DELETE'").select(F.col("path").alias("gone")).distinct()
    lost = f.select("path", F.explode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("gone")).join(gone, "gone").select("path").distinct().withColumn("_lost", F.lit(True))
    f = f.join(lost, "path", "left").withColumn("index_status", F.when(F.col("_lost"), "MISSING").otherwise(F.col("index_status"))).drop("_lost")
    written = events.filter(F.col("event_type").isin("CREATE", "MODIFY") & ~F.col("is_directory")).groupBy("path").agg(F.max("observed_at").alias("_at"))
    out = f.join(written, "path", "full")
    new = F.col("_at").isNotNull()
    return out.select("path", F.coalesce("file_id", F.sha2("path", 256)).alias("file_id"), F.when(new, "QUEUED").otherwise(F.col("index_status")).alias("index_status"), F.coalesce("_at", "modified_at").alias("modified_at"))


def live_status(events: DataFrame, window: str | None = None, slide: str | None = None) -> DataFrame:
    """Counts by event type, running, or by tumbling or sliding window of observed_at."""
    keys = ["event_type"] if window is None else ["event_type", F.window("observed_at", window, slide).alias("w")]
    g = events.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g if window is None else g.select("event_type", F.col("w.start").alias("started"), "n")


def without_late_repeats(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """Each event_id once; what comes after the watermark is dropped (the query's progress counts it)."""
    if events.isStreaming:
        return events.withWatermark("observed_at", late).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


OUT_EVENTS = T.StructType([*SCHEMA.fields[:-1], T.StructField("micros", T.LongType()), T.StructField("burst", T.LongType())])
ROWS_OUT = 20_000  # in one frame of a closed burst


class HoldBursts(StatefulProcessor):
    """Of one folder: its events by path, and the first and last time of its open bursts. An event is written to the state once, when it comes, and read
    once, when its burst is closed; a timer wakes the folder when the watermark passes the first end of a burst."""

    EVENT = "path string, micros long, event_id long"
    REST = "event_type string, old_path string, is_directory boolean"

    def __init__(self, step: int):
        self.step = step

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getMapState("held", self.EVENT, self.REST)
        self.bursts = handle.getMapState("bursts", "first long", "last long")

    def handleInputRows(self, key, rows, timerValues):
        times = []
        for pdf in rows:
            for path, micros, event_id, kind, old, whole in zip(*(pdf[c].astype(object).where(pdf[c].notna(), None) for c in ("path", "micros", "event_id", "event_type", "old_path", "is_directory")), strict=True):
                self.held.updateValue((path, int(micros), int(event_id)), (kind, old, whole))
                times.append(int(micros))
        known = [(first, last) for (first,), (last,) in self.bursts.iterator()]
        merged: list[list[int]] = []
        for first, last in sorted(known + [(t, t) for t in set(times)]):
            if merged and first - merged[-1][1] < self.step:
                merged[-1][1] = max(merged[-1][1], last)
            else:
                merged.append([first, last])
        for first, _ in known:
            self.bursts.removeKey((first,))
        self._wait(merged)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = timerValues.getCurrentWatermarkInMs() * 1000
        spans = sorted((first, last) for (first,), (last,) in self.bursts.iterator())
        closed = [s for s in spans if s[1] + self.step <= now]
        firsts = [s[0] for s in closed]
        out, gone = [], []
        for (path, micros, event_id), (kind, old, whole) in self.held.iterator():
            at = bisect_right(firsts, micros) - 1
            if at >= 0 and micros <= closed[at][1]:
                gone.append((path, micros, event_id))
                out.append((event_id, key[0], kind, path, old, whole, micros, closed[at][0]))
                if len(out) >= ROWS_OUT:
                    yield pd.DataFrame(out, columns=OUT_EVENTS.names)
                    out = []
        for x in gone:
            self.held.removeKey(x)
        for first, _ in spans:
            self.bursts.removeKey((first,))
        self._wait([list(s) for s in spans if s not in closed])
        if out:
            yield pd.DataFrame(out, columns=OUT_EVENTS.names)

    def _wait(self, spans: list[list[int]]) -> None:
        """Keep the open bursts, and one timer for the end of the first that ends."""
        for first, last in spans:
            self.bursts.updateValue((first,), (last,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if spans:
            self.handle.registerTimer((min(last for _, last in spans) + self.step) // 1000 + 1)

    def close(self) -> None:
        pass


def closed_bursts(events: DataFrame, quiet: str = "500 milliseconds", late: str = "5 seconds") -> DataFrame:
    """events of a stream, each with its burst (the time of its first event, in microseconds), once the burst is closed: when the watermark is a quiet
    time past its last event, so no later event can be part of it. A burst that several micro-batches bring is held until then, and then comes as a whole.
    Events behind the watermark are dropped, and LateRows counts them. State is kept by folder and path in a state store that must be RocksDB
    (spark.sql.streaming.stateStore.providerClass), so it may be larger than memory."""
    step = int(microseconds(events.sparkSession, quiet))
    held = events.withColumn("micros", F.unix_micros("observed_at")).filter("micros is not null").withWatermark("observed_at", late)
    closed = held.groupBy("folder_id").transformWithStateInPandas(HoldBursts(step), OUT_EVENTS, "append", "eventtime")
    return closed.select(*SCHEMA.names[:-1], F.timestamp_micros("micros").alias("observed_at"), "burst")


class LateRows(StreamingQueryListener):
    """Counts, query by query and batch by batch, the rows that stateful operators drop behind the watermark: spark.streams.addListener(LateRows())."""

    COUNTS = "query string, batch_id long, input_rows long, dropped long"

    def __init__(self):
        self.batches: dict[tuple[str, int], tuple[int, int]] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.batches[(p.name or str(p.id), p.batchId)] = (p.numInputRows, sum(op.numRowsDroppedByWatermark for op in p.stateOperators))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def table(self, spark: SparkSession) -> DataFrame:
        """(query, batch_id, input_rows, dropped), a row a batch."""
        rows = [(name, batch, *n) for (name, batch), n in sorted(self.batches.items())]
        return spark.createDataFrame(rows, self.COUNTS)


def microseconds(spark: SparkSession, interval: str) -> int:
    """Of an interval such as "500 milliseconds"."""
    return spark.range(1).select(F.expr(f"unix_micros(timestamp_micros(0) + interval {interval})")).first()[0]


def latest_files(spark: SparkSession, snapshot: str, before: int | None = None) -> DataFrame:
    """The file table of a snapshot folder: of each folder_id the rows that the last batch which touched it has written, of those before one batch if that is given."""
    rows = spark.read.option("basePath", snapshot).parquet(snapshot)
    rows = rows if before is None else rows.filter(F.col("delta") < before)
    last = rows.groupBy("folder_id").agg(F.max("delta").alias("delta"))
    return rows.join(last, ["folder_id", "delta"], "left_semi").drop("delta")


def run_incremental(source: DataFrame, checkpoint: str, snapshot: str, initial: DataFrame, *, quiet: str = "500 milliseconds", late: str = "5 seconds"):
    """Start a query that applies each burst of events, when it is closed, to the files of its folder (folder_id, path, file_id, index_status, modified_at).

    A batch writes the files of the folders that it touches as one delta, numbered by the batch, so a batch that runs again replaces it by an equal one.
    latest_files reads the outcome. Events without a quiet time after them wait in the state.
    """
    spark = source.sparkSession
    initial.write.mode("ignore").parquet(f"{snapshot}/delta=0")

    def apply(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        touched = batch.select("folder_id").distinct()
        if not touched.isEmpty():
            files = latest_files(spark, snapshot, batch_id + 1).join(touched, "folder_id", "left_semi")
            done = coalesce_events(collapse_cascades(batch).withColumn("burst", F.lit(0)))
            folder = files.select("path", "folder_id").union(done.select("path", "folder_id")).dropDuplicates(["path"])
            apply_events(files, done).join(folder, "path").write.mode("overwrite").parquet(f"{snapshot}/delta={batch_id + 1}")
        batch.unpersist()

    return closed_bursts(source, quiet, late).writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
