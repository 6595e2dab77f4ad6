"""Streams run to their end over the event files; each equals a batch query on the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from linkloom.operators.materialize import shared
from linkloom.plans.registry import query
from linkloom.sources.tables import table
from linkloom.streaming import windows


def _events(spark, sf):
    return windows.read_events(spark, sf, table(spark, sf, "events").schema, "events*.parquet")


def _run(spark, stream, mode="append"):
    return windows.run_to_end(stream, f"{shared(spark)}/streams/{uuid.uuid4().hex}", mode)


def _ntz(df, *columns):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


@query("SELECT date_trunc('hour', ts) AS hour, count(DISTINCT user_id) AS entities, count(*) AS n FROM events GROUP BY 1 HAVING count(DISTINCT user_id) >= 5")
def str_sync_hour(spark, sf):
    """STR-02: complete mode, so that the last hours are out too."""
    return _ntz(windows.synchronized(_run(spark, windows.hourly_counts(_events(spark, sf)), "complete")), "hour")


@query("SELECT a.event_id AS a, b.event_id AS b FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts - INTERVAL 15 MINUTES AND a.ts + INTERVAL 15 MINUTES WHERE a.event_type = 'click' AND b.event_type = 'purchase'")
def str_interval_join(spark, sf):
    """STR-06."""
    e = lambda kind: _events(spark, sf).where(F.col("event_type") == kind)
    return _run(spark, windows.interval_join(e("click"), e("purchase")))


@query("SELECT user_id, date_trunc('hour', ts) - to_hours(CAST(k AS INTEGER)) AS window_start, count(*) AS n FROM events, (SELECT unnest(range(24)) AS k) GROUP BY 1, 2")
def str_bursts(spark, sf):
    """STR-03: sliding days, hour by hour."""
    return _ntz(_run(spark, windows.sliding_counts(_events(spark, sf)), "complete"), "window_start")


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOURS THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL 6 HOURS AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def str_sessions(spark, sf):
    """STR-04: sessions with gaps under six hours."""
    return _ntz(_run(spark, windows.sessions(_events(spark, sf)), "complete"), "session_start", "session_end")


@query("""WITH w AS (SELECT user_id, ts, count(*) OVER f AS n, sum(CAST(value AS DECIMAL(18,4))) OVER f AS total FROM events WHERE value < 40 WINDOW f AS (PARTITION BY user_id ORDER BY date_trunc('second', ts) RANGE BETWEEN CURRENT ROW AND INTERVAL 1 DAY FOLLOWING)) SELECT user_id, min(ts) AS window_start FROM w WHERE n >= 3 AND total > 120 GROUP BY user_id""")
def str_structuring(spark, sf):
    """STR-05: the first day of each user with several small values that sum high."""
    out = _run(spark, windows.structuring(_events(spark, sf), 40.0))
    return _ntz(out.select("user_id", "window_start"), "window_start")


@query("SELECT DISTINCT user_id, event_type FROM events")
def str_dedupe(spark, sf):
    """STR-07: one event a key."""
    return _run(spark, windows.deduplicated(_events(spark, sf), ["user_id", "event_type"], "60 days")).select("user_id", "event_type")


@query("WITH h AS (SELECT date_trunc('hour', ts) AS hour, user_id, count(*) AS n FROM events GROUP BY 1, 2) SELECT hour, user_id, n AS batch_n, CAST(0 AS BIGINT) AS stream_n FROM h WHERE hour + INTERVAL 1 HOUR > (SELECT max(ts) FROM events) - INTERVAL 2 HOURS")
def str_late(spark, sf):
    """STR-08: what append mode has not let out, against the batch: the hours that the watermark holds open."""
    batch = table(spark, sf, "events").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    out = windows.missing_windows(batch, _run(spark, windows.hourly_counts(_events(spark, sf))), ["hour", "user_id"])
    return _ntz(out, "hour")


@query("SELECT event_id, event_type FROM events WHERE event_type = 'error'")
def str_topics(spark, sf):
    """STR-01: events published under their kind as a topic, one topic read back."""
    folder = f"{shared(spark)}/topics/{uuid.uuid4().hex}"
    windows.publish(table(spark, sf, "events").where("event_type = 'error'").select("event_id", "event_type"), folder, "error")
    out = _run(spark, windows.subscribe(spark, folder, "error"))
    return out.select(F.from_json("payload", "event_id bigint, event_type string").alias("p")).select("p.*")
