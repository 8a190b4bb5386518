"""Windowed counts in batch form, and the same computed by a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from factloom.plans import views  # noqa: F401  (registers the shared views)
from factloom.plans.registry import query
from factloom.session import scratch_dir
from factloom.streaming import streams

_TUMBLE = """
    SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, time_bucket(INTERVAL '6 hours', ts) + INTERVAL '6 hours' AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2, 3"""


@query("event_tumbling", _TUMBLE)
def event_tumbling(t):
    return streams.tumbling_counts(t.events, "ts", "event_type", "6 hours")


@query("event_sliding", """
    SELECT s AS window_start, s + INTERVAL '12 hours' AS window_end, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
      SELECT *, unnest([time_bucket(INTERVAL '4 hours', ts), time_bucket(INTERVAL '4 hours', ts) - INTERVAL '4 hours', time_bucket(INTERVAL '4 hours', ts) - INTERVAL '8 hours']) AS s FROM events) GROUP BY 1, 2, 3""")
def event_sliding(t):
    return streams.tumbling_counts(t.events, "ts", "event_type", "12 hours", "4 hours")


@query("event_sessions", """
    WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER w >= INTERVAL '2 hours' OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT min(ts) AS window_start, max(ts) + INTERVAL '2 hours' AS window_end, user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def event_sessions(t):
    return streams.session_counts(t.events, "ts", "user_id", "2 hours")


def _folders(t):
    base = f"{scratch_dir(t.spark)}/stream-{uuid.uuid4().hex}"
    return base + "/out", base + "/state"


@query("event_tumbling_stream", _TUMBLE)
def event_tumbling_stream(t):
    """The stream's own output: complete mode returns every window, those still open included."""
    out, state = _folders(t)
    src = streams.open_stream(t.spark, f"{t.root}/events*.parquet", t.events.schema)
    # a watermark needs an instant; the table's zone-less times are read as UTC
    src = src.withColumn("ts", F.expr("CAST(convert_timezone('UTC', current_timezone(), ts) AS TIMESTAMP)"))
    streams.run_complete(streams.tumbling_counts(src, "ts", "event_type", "6 hours", late="1 hour"), out, state)
    got = t.spark.read.schema("window_start timestamp, window_end timestamp, event_type string, n bigint, total double").parquet(out)
    for c in ("window_start", "window_end"):
        got = got.withColumn(c, F.expr(f"convert_timezone(current_timezone(), 'UTC', CAST({c} AS TIMESTAMP_NTZ))"))
    return got


@query("unseen_content_stream", "SELECT count(DISTINCT sha256(text)) AS contents, CAST(sum(len) AS BIGINT) AS chars FROM (SELECT text, length(text) AS len FROM documents GROUP BY 1)")
def unseen_content_stream(t):
    out, state = _folders(t)
    src = streams.open_stream(t.spark, f"{t.root}/documents*.parquet", t.documents.schema)
    fresh = streams.unseen_content(src, "doc").select("sha", F.length("text").cast("bigint").alias("chars"))
    streams.run_available(fresh, out, state)
    got = t.spark.read.schema("sha string, chars bigint").parquet(out)
    return got.agg(F.count(F.lit(1)).alias("contents"), F.sum("chars").alias("chars"))


@query("change_feed_stream", """
    WITH v AS (SELECT o_custkey AS key, count(*) FILTER (o_orderdate < TIMESTAMP '1997-06-01') AS was, count(*) AS orders, bool_or(o_orderdate >= TIMESTAMP '1998-07-01') AS gone FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01' GROUP BY 1)
    SELECT CAST(0 AS INT) AS batch, 'added' AS change, count(*) AS n FROM v WHERE was > 0 UNION ALL
    SELECT 1, CASE WHEN gone THEN 'removed' WHEN was = 0 THEN 'added' ELSE 'modified' END, count(*) FROM v WHERE (gone AND was > 0) OR (NOT gone AND was <> orders) GROUP BY 2""")
def change_feed_stream(t):
    """Two versions of a snapshot arrive one after the other, the second with removed keys; the feed holds what each changed."""
    base = f"{scratch_dir(t.spark)}/feed-{uuid.uuid4().hex}"
    schema = "key bigint, orders bigint, gone boolean, version int"
    step = streams.change_feed("key", base + "/versions", base + "/feed", tombstone="gone")
    for version, until in enumerate(("1997-06-01", "1999-01-01")):
        state = t.orders.filter(F.col("o_orderdate") < F.lit(until).cast("timestamp_ntz")).groupBy(F.col("o_custkey").alias("key")).agg(
            F.count(F.lit(1)).alias("orders"), F.bool_or(F.col("o_orderdate") >= F.lit("1998-07-01").cast("timestamp_ntz")).alias("gone"))
        state.withColumn("version", F.lit(version)).write.mode("append").parquet(base + "/in")
        src = streams.open_stream(t.spark, base + "/in", schema)
        q = src.writeStream.foreachBatch(step).option("checkpointLocation", base + "/state").trigger(availableNow=True).start()
        q.awaitTermination()
    feed = t.spark.read.parquet(base + "/feed")
    return feed.groupBy("batch", "change").agg(F.count(F.lit(1)).alias("n"))
