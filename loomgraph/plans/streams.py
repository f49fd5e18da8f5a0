"""Streaming queries, run over all events there are; the oracle is the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomgraph.plans import relational as r
from loomgraph.streaming import events as ev

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name, sql=None):
    return r.query(name, sql, QUERIES, SQL)


def _events(spark, d):
    return ev.read_events(spark, f"{d}/events.parquet")


@query("stream_tumbling", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS \"start\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_tumbling(spark, d):
    return ev.drain(ev.windowed(_events(spark, d), "6 hours"), "tumbling", "update", ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sliding", "SELECT s AS \"start\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT *, unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS s FROM events) GROUP BY 1, 2")
def stream_sliding(spark, d):
    return ev.drain(ev.windowed(_events(spark, d), "2 hours", "1 hour"), "sliding", "update", ["start", "event_type"]).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sessions", "SELECT user_id, min(ts) AS \"start\", max(ts) + INTERVAL 4 HOUR AS \"end\", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 4 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, session")
def stream_sessions(spark, d):
    s = ev.drain(ev.sessions(_events(spark, d), "4 hours"), "sessions", "complete")
    return s.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("stream_tumbling_closed", "SELECT time_bucket(INTERVAL 6 HOUR, ts) AS \"start\", event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2 HAVING time_bucket(INTERVAL 6 HOUR, min(ts)) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_tumbling_closed(spark, d):
    """Windows that the watermark has passed, each once: state and rows behind it are gone."""
    return ev.drain(ev.windowed(_events(spark, d), "6 hours"), "closed", "append").withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sessions_closed", "SELECT user_id, min(ts) AS \"start\", max(ts) + INTERVAL 4 HOUR AS \"end\", count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL 4 HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY user_id, session HAVING max(ts) + INTERVAL 4 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE")
def stream_sessions_closed(spark, d):
    s = ev.drain(ev.sessions(_events(spark, d), "4 hours"), "sessions-closed", "append")
    return s.withColumn("start", F.col("start").cast("timestamp_ntz")).withColumn("end", F.col("end").cast("timestamp_ntz"))


@query("stream_deduplicated", "SELECT event_type, count(DISTINCT event_id) AS n FROM events GROUP BY event_type")
def stream_deduplicated(spark, d):
    twice = _events(spark, d).union(_events(spark, d))
    return ev.drain(ev.deduplicated(twice).select("event_id", "event_type"), "dedup", "append").groupBy("event_type").agg(F.count("*").alias("n"))


@query("stream_watch", "SELECT user_id, count(*) AS n_rows, count(*) FILTER (before IS NOT NULL AND before <> band) AS n_changes, arg_max(band, (ts, event_id)) AS last_band FROM (SELECT *, lag(band) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM (SELECT *, CASE WHEN value < 20 THEN 'low' WHEN value < 80 THEN 'mid' ELSE 'high' END AS band FROM events)) GROUP BY user_id")
def stream_watch(spark, d):
    return ev.drain(ev.watch_changes(_events(spark, d)), "watch", "update", ["user_id"])


@query("stream_filtered", "SELECT event_id, user_id FROM events WHERE event_type = 'purchase'")
def stream_filtered(spark, d):
    return ev.drain(_events(spark, d).where(ev.matches("purchase")).select("event_id", "user_id"), "filtered", "append")
