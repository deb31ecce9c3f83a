"""Queries for event streams, in batch form: the events table with users as folders."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.plans.registry import query
from corpusloom.sources.tables import table
from corpusloom.streaming import events as E

QUIET = 3600.0


def file_events(spark, sf):
    """events as file events: fifteen paths in three directories of each user; views are CREATEs, clicks MODIFYs, errors DELETEs, the rest MOVEs; every 40th is of a directory."""
    k, t = F.col("event_id"), F.col("event_type")
    kind = F.when(t == "view", "CREATE").when(t == "click", "MODIFY").when(t == "error", "DELETE").otherwise("MOVE")
    root, whole = F.concat(F.lit("/r/u"), F.col("user_id").cast("string"), F.lit("/d")), k % 40 == 0
    place = lambda i: F.concat(root, (k % 3).cast("string"), F.lit("/f"), (i % 5).cast("string"))
    path = F.when(whole, F.concat(root, (k % 3).cast("string"))).otherwise(place(k))
    old = F.when((kind == "MOVE"), F.when(whole, F.concat(root, ((k + 1) % 3).cast("string"))).otherwise(place(k + 1)))
    return table(spark, sf, "events").select("event_id", F.col("user_id").cast("string").alias("folder_id"), kind.alias("event_type"), path.alias("path"), old.alias("old_path"), whole.alias("is_directory"), F.col("ts").alias("observed_at"))


EVENTS = """fe AS (SELECT event_id, CAST(user_id AS VARCHAR) AS folder_id, CASE event_type WHEN 'view' THEN 'CREATE' WHEN 'click' THEN 'MODIFY' WHEN 'error' THEN 'DELETE' ELSE 'MOVE' END AS event_type,
    '/r/u' || user_id || '/d' || (event_id % 3) || CASE WHEN event_id % 40 = 0 THEN '' ELSE '/f' || (event_id % 5) END AS path,
    CASE WHEN event_type NOT IN ('view', 'click', 'error') THEN CASE WHEN event_id % 40 = 0 THEN '/r/u' || user_id || '/d' || ((event_id + 1) % 3) ELSE '/r/u' || user_id || '/d' || (event_id % 3) || '/f' || ((event_id + 1) % 5) END END AS old_path, event_id % 40 = 0 AS is_directory, ts AS observed_at FROM events),
  gap AS (SELECT *, CASE WHEN observed_at - lag(observed_at) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS fresh FROM fe WINDOW w AS (PARTITION BY folder_id ORDER BY observed_at, event_id)),
  fb AS (SELECT * EXCLUDE fresh, sum(fresh) OVER (PARTITION BY folder_id ORDER BY observed_at, event_id)::BIGINT AS burst FROM gap)"""


@query("event_source", f"WITH {EVENTS} SELECT event_id, event_type, path FROM fe")
def event_source(spark, sf):
    return file_events(spark, sf).select("event_id", "event_type", "path")


@query("debounce_sessions", f"WITH {EVENTS} SELECT folder_id, min(observed_at) AS started, max(observed_at) + INTERVAL 1 HOUR AS ended, count(*) AS n FROM fb GROUP BY folder_id, burst")
def debounce_sessions(spark, sf):
    return E.bursts(file_events(spark, sf), "1 hour").select("folder_id", "started", "ended", "n")


@query("coalesce_events", f"WITH {EVENTS} SELECT folder_id, burst, path, arg_max(event_id, (observed_at, event_id)) AS event_id, CASE WHEN arg_min(event_type, (observed_at, event_id)) = 'CREATE' AND bool_and(event_type IN ('CREATE', 'MODIFY')) THEN 'CREATE' ELSE arg_max(event_type, (observed_at, event_id)) END AS event_type FROM fb GROUP BY folder_id, burst, path")
def coalesce_events(spark, sf):
    return E.coalesce_events(E.with_burst(file_events(spark, sf), QUIET)).select("folder_id", "burst", "path", "event_id", "event_type")


@query(
    "collapse_cascades",
    f"""WITH {EVENTS}, g AS (SELECT folder_id, burst, coalesce(old_path, path) AS dir, observed_at, event_id AS dir_id FROM fb WHERE is_directory AND event_type IN ('DELETE', 'MOVE')),
    cov AS (SELECT DISTINCT f.event_id FROM fb f JOIN g ON f.folder_id = g.folder_id AND f.burst = g.burst AND starts_with(coalesce(f.old_path, f.path), g.dir || '/') WHERE (f.observed_at, f.event_id) < (g.observed_at, g.dir_id) OR f.event_type = 'DELETE'),
    lf AS (SELECT * FROM fb WHERE event_id NOT IN (SELECT event_id FROM cov)),
    j AS (SELECT m.event_id, b.event_id AS born_id FROM lf m JOIN lf b ON m.folder_id = b.folder_id AND m.burst = b.burst AND m.old_path = b.path AND b.event_id < m.event_id WHERE NOT m.is_directory AND NOT b.is_directory AND m.event_type = 'MOVE' AND b.event_type = 'CREATE')
    SELECT event_id, path, CASE WHEN event_id IN (SELECT event_id FROM j) THEN 'CREATE' ELSE event_type END AS event_type FROM lf WHERE event_id NOT IN (SELECT born_id FROM j)""",
)
def collapse_cascades(spark, sf):
    return E.collapse_cascades(E.with_burst(file_events(spark, sf), QUIET)).select("event_id", "path", "event_type")


@query("apply_events")
def apply_events(spark, sf):
    """All events, MOVEs and cascades among them, applied to half of the files that they name."""
    e = file_events(spark, sf)
    named = e.filter("not is_directory").groupBy("path").agg(F.min("observed_at").alias("modified_at")).filter(F.md5("path") < "8")
    start = named.select("path", F.md5("path").alias("file_id"), F.lit("INDEXED").alias("index_status"), "modified_at")
    done = E.coalesce_events(E.collapse_cascades(E.with_burst(e, QUIET)).withColumn("burst", F.lit(0)))
    return E.apply_events(start, done)


@query("live_status", "SELECT CASE event_type WHEN 'view' THEN 'CREATE' WHEN 'click' THEN 'MODIFY' WHEN 'error' THEN 'DELETE' ELSE 'MOVE' END AS event_type, time_bucket(INTERVAL 1 HOUR, ts) AS started, count(*) AS n FROM events GROUP BY 1, 2")
def live_status(spark, sf):
    return E.live_status(file_events(spark, sf), "1 hour")


@query("late_events", "SELECT event_id, ts AS observed_at FROM events")
def late_events(spark, sf):
    e = file_events(spark, sf)
    return E.without_late_repeats(e.union(e)).select("event_id", "observed_at")


@query(
    "scoped_events",
    f"""WITH {EVENTS}, s AS (SELECT *, event_type = 'MOVE' AS moved, path = '/r/u' || folder_id || '/d1' OR starts_with(path, '/r/u' || folder_id || '/d1/') AS new, coalesce(old_path = '/r/u' || folder_id || '/d1' OR starts_with(old_path, '/r/u' || folder_id || '/d1/'), false) AS old FROM fe WHERE CAST(folder_id AS BIGINT) % 7 <> 0)
    SELECT event_id, CASE WHEN moved AND NOT new THEN 'DELETE' WHEN moved AND NOT old THEN 'CREATE' ELSE event_type END AS event_type, CASE WHEN moved AND NOT new THEN old_path ELSE path END AS path, CASE WHEN moved AND new AND old THEN old_path END AS old_path FROM s WHERE new OR (moved AND old)""",
)
def scoped_events(spark, sf):
    """Events as they concern the middle directory of each user; every seventh user's folder is disabled."""
    e = file_events(spark, sf)
    folders = e.select("folder_id").distinct().select("folder_id", F.concat(F.lit("/r/u"), "folder_id", F.lit("/d1/")).alias("root"), (F.col("folder_id").cast("long") % 7 != 0).alias("indexing_enabled"))
    return E.scoped_events(e, folders).select("event_id", "event_type", "path", "old_path")
