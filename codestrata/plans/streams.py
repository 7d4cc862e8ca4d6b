"""Queries that run as streams over the stored tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from codestrata.session import Scratch
from codestrata.streaming import watch


def stream_sessions(spark, sf_dir):
    """Quiet runs of each user's events, by a stream over the stored file whose finished sessions go to a table."""
    scratch = Scratch(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    events = raw.select(F.col("user_id").cast("string").alias("repo"), F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("path"))
    batches = watch.quiet_batches(events, quiet="1 hour", late="1 hour").select("repo", "started", "ended", "changes")
    out = scratch.path("sessions")
    query = batches.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch.path("checkpoint")).outputMode("append").trigger(availableNow=True).queryName(f"sessions-{uuid.uuid4().hex}").start()
    query.awaitTermination()
    return spark.read.schema("repo string, started timestamp, ended timestamp, changes long").parquet(out).select(F.col("repo").cast("long").alias("user_id"), F.date_format("started", "yyyy-MM-dd HH:mm:ss").alias("started"), "changes")


def stream_hourly(spark, sf_dir):
    """Events per hour and kind, by a stream in append mode; the last windows, which later events could still change, are not out yet."""
    scratch = Scratch(spark, "stream")
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    counts = watch.windowed_counts(raw.select(F.col("ts").cast("timestamp").alias("at"), F.col("event_type").alias("kind")))
    out = scratch.path("hourly")
    counts.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch.path("checkpoint")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("started timestamp, kind string, events long").parquet(out).select(F.date_format("started", "yyyy-MM-dd HH:mm").alias("started"), "kind", "events")


QUERIES = {f.__name__: f for f in (stream_sessions, stream_hourly)}
# What the watermark has passed when the stream ends: the greatest time less what may come late.
SQL = {
    "stream_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS started, count(*) AS changes FROM s GROUP BY user_id, k
        HAVING max(ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)""",
    "stream_hourly": """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS started, event_type AS kind, count(*) AS events FROM events GROUP BY date_trunc('hour', ts), event_type
        HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""",
}
