from datetime import datetime

from pyspark.sql import functions as F

from shapewright.streaming.streams import history_stream, latest_per_key_stream, read_latest, usage_stream


def feed(spark, path, batches, schema):
    """A source folder with one file per batch, oldest first; the stream takes one file a trigger."""
    for at, batch in enumerate(batches):
        df = spark.createDataFrame(batch, schema)
        df.coalesce(1).write.mode("append").parquet(f"{path}/b{at}")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/b*")


def test_history_stream_runs_once(spark, tmp_path, rows):
    source = feed(spark, f"{tmp_path}/in", [[("insert", True, 1)], [("update", False, 2), ("delete", True, 3)]], "op string, w boolean, id int")
    for _ in range(2):  # started again with the same checkpoint it finds nothing new
        history_stream(source, "op", f"{tmp_path}/out", f"{tmp_path}/state", "w").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == [(1, 1), (3, 3)]


def test_latest_stream(spark, tmp_path, rows):
    batches = [[(1, 5, "a"), (2, 5, "b")], [(1, 7, "c"), (1, 6, "d")], [(2, 4, "late")]]
    source = feed(spark, f"{tmp_path}/in", batches, "k int, at int, v string")
    latest_per_key_stream(source, "k", ["at"], f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    table = read_latest(spark.read.parquet(f"{tmp_path}/out"), "k")
    assert rows(table, "k", "at", "v") == [(1, 7, "c"), (2, 5, "b")]


def test_late_rows_are_dropped(spark, tmp_path, rows):
    batches = [
        [("2024-01-01 10:00:00", "u", 1)],
        [("2024-01-03 10:00:00", "u", 2)],
        [("2024-01-03 11:00:00", "u", 4)],  # from here on the watermark of the batch before counts
        [("2024-01-01 11:00:00", "u", 100)],
        [("2024-01-05 00:00:00", "u", 3)],
    ]
    source = feed(spark, f"{tmp_path}/in", batches, "ts string, k string, v int")
    timed = source.withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    usage_stream(timed, "ts", "k", F.col("v"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    assert rows(spark.read.parquet(f"{tmp_path}/out")) == [
        (datetime(2024, 1, 1), "u", 1, 1),
        (datetime(2024, 1, 3), "u", 2, 6),
    ]
