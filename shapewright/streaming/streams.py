"""Streams that end in files. Every sink can be repeated after a failure without doubling rows."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shapewright.functions.temporal import utc_instant, utc_wall_time
from shapewright.operators.changes import history_from_feed
from shapewright.operators.ranking import latest_per_key
from shapewright.sources.keyed import KeyedTable


def history_stream(
    feed: DataFrame,
    op: str,
    out: str,
    checkpoint: str,
    watched: str | None = None,
    stamp: str | None = None,
    as_of: str | None = None,
) -> StreamingQuery:
    """Appends change rows of a feed to the parquet folder ``out``. No state."""
    changes = history_from_feed(feed, op, watched, stamp, as_of)
    return (
        changes.writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_per_key_stream(rows: DataFrame, key: str, order: list[str], out: str, checkpoint: str) -> StreamingQuery:
    """Writes, per batch, the keys that changed with their latest row. State is one row per key.

    A batch goes to its own folder, which a repeated batch overwrites. read_latest gives the table.
    """
    columns = [c for c in rows.columns if c != key]
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")
    latest = rows.groupBy(key).agg(newest)

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.select(key, "_row.*").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        latest.writeStream.outputMode("update")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def read_latest(updates: DataFrame, key: str) -> DataFrame:
    """One row per key from the folder latest_per_key_stream writes: that of the last batch."""
    return latest_per_key(updates, [key], F.col("batch").desc()).drop("batch")


def upsert_stream(rows: DataFrame, key: str, order: list[str], folder: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps the latest row of each key in the KeyedTable in ``folder``, which the first batch creates. No state.

    A batch is cut down to one row per key and merged: only files that may hold its keys are rewritten, and a row
    that is older than the table's, by ``order``, changes nothing. A batch that is repeated after a failure is known by
    its number and the id of the checkpoint, so it counts once. Rows without key are dropped.
    """
    columns = [c for c in rows.columns if c != key]
    newest = F.max_by(F.struct(*columns), F.struct(*order)).alias("_row")

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        query_id = json.loads(spark.read.text(f"{checkpoint}/metadata", wholetext=True).first()[0])["id"]
        table = KeyedTable(spark, folder)
        if table.current() is None:
            table.create(spark.createDataFrame([], batch.schema), key, buckets)
        latest = batch.filter(F.col(key).isNotNull()).groupBy(key).agg(newest).select(key, "_row.*").select(*batch.columns)
        table.merge(latest, newer=order, writer=query_id, batch=batch_id)

    return (
        rows.writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(write)
        .start()
    )


def usage_counts(rows: DataFrame, ts: str, key: str, value: Column, late: str = "1 hour", width: str = "1 day"):
    """Rows and value total per day and key; a day closes when the watermark passes its end."""
    timed = rows.withColumn("_ts", utc_instant(F.col(ts))).withWatermark("_ts", late)
    return (
        timed.groupBy(F.window("_ts", width).alias("_span"), F.col(key))
        .agg(F.count(F.lit(1)).alias("uses"), F.sum(value).alias("total"))
        .select(utc_wall_time(F.col("_span.start")).alias("period_start"), key, "uses", "total")
    )


def usage_stream(rows: DataFrame, ts: str, key: str, value: Column, out: str, checkpoint: str, **widths):
    """Appends closed periods to the parquet folder ``out``; rows later than the watermark are dropped."""
    return (
        usage_counts(rows, ts, key, value, **widths)
        .writeStream.format("parquet")
        .outputMode("append")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
