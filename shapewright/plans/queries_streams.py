"""Streaming queries: the events table is read as a stream until it is used up, the sink as a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from shapewright.plans.queries_changes import event_feed
from shapewright.plans.registry import query
from shapewright.session import new_folder
from shapewright.sources.keyed import KeyedTable
from shapewright.streaming.streams import history_stream, latest_per_key_stream, read_latest, upsert_stream, usage_stream


def event_stream(t):
    source = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 100)
    # a stream reads folders; the pattern lets the table be one file as well
    return source.parquet(f"{t.folder}/events.parquet*")


@query(
    """SELECT CASE event_type WHEN 'signup' THEN 1 WHEN 'purchase' THEN 2 ELSE 3 END AS history_type, user_id, value FROM events
    WHERE event_type IN ('signup', 'error') OR (event_type = 'purchase' AND value > 10)""",
    "history_stream",
)
def stream_history(t):
    out, state = new_folder(t.spark, "history"), new_folder(t.spark, "state")
    history_stream(event_feed(event_stream(t)), "op", out, state, "watched").awaitTermination()
    return t.spark.read.parquet(out)


LATEST = """SELECT user_id, event_id, event_type, ts FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events)
    WHERE n = 1"""


@query(LATEST, "latest_stream")
def stream_latest(t):
    out, state = new_folder(t.spark, "latest"), new_folder(t.spark, "state")
    rows = event_stream(t).select("user_id", "event_id", "event_type", "ts")
    latest_per_key_stream(rows, "user_id", ["ts", "event_id"], out, state).awaitTermination()
    return read_latest(t.spark.read.parquet(out), "user_id")


@query(LATEST, "latest_upsert_stream")
def stream_upserts(t):
    """The same table kept by merges, without state in the stream."""
    folder, state = new_folder(t.spark, "latest-table"), new_folder(t.spark, "state")
    rows = event_stream(t).select("user_id", "event_id", "event_type", "ts")
    upsert_stream(rows, "user_id", ["ts", "event_id"], folder, state, buckets=8).awaitTermination()
    return KeyedTable(t.spark, folder).read()


@query(
    """SELECT date_trunc('day', ts) AS period_start, event_type, count(*) AS uses, CAST(sum(CAST(value AS DECIMAL(12,2))) AS DOUBLE) AS total FROM events
    WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""",
    "usage_stream",
)
def stream_usage(t):
    out, state = new_folder(t.spark, "usage"), new_folder(t.spark, "state")
    amount = F.col("value").cast("decimal(12,2)")
    usage_stream(event_stream(t), "ts", "event_type", amount, out, state).awaitTermination()
    return t.spark.read.parquet(out).withColumn("total", F.col("total").cast("double"))
