"""Session builder and the one place that writes intermediate results."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "shapewright", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are specified for: UTC, ANSI, AQE."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.ansi.enabled", "true")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # state of a stream that keeps one row per key does not have to fit the heap
        .config(
            "spark.sql.streaming.stateStore.providerClass",
            "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
        )
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in spark.checkpoint.dir.

    Only a local session, where driver and executors are one machine, may fall back to a temporary
    folder; on a cluster an unset folder is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="shapewright-")
    spark.sparkContext.setCheckpointDir(folder)
    return shared_folder(spark)


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path under the shared folder; nothing is created yet."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


_settled: list[str] = []


def settle(df: DataFrame, label: str = "settled") -> DataFrame:
    """Write the rows once to the shared folder and go on from the files.

    Cuts the lineage, so a lost executor costs a re-read and not a re-computation, and freezes values
    such as row positions that must not change between two uses. Parquet rather than checkpoint()
    because later branches then read only the columns they need.
    """
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    _settled.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Deletes what settle wrote in this process; returns the number of folders.

    For long-lived applications: call it when the results that were built on the settled rows have
    been written.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    count = 0
    while _settled:
        place = jvm.org.apache.hadoop.fs.Path(_settled.pop())
        count += bool(place.getFileSystem(conf).delete(place, True))
    return count


def create_file(spark: SparkSession, path: str, text: str) -> bool:
    """Creates a small file, whole or not at all; False if there is one already.

    It is written beside its place and renamed without replacing, which a file system does in one step. So of several
    writers one succeeds, and one that dies leaves nothing under the name.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    place = jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(conf)
    draft = jvm.org.apache.hadoop.fs.Path(place.getParent().getParent(), f"drafts/{uuid.uuid4().hex}")
    out = files.create(draft, True)
    out.write(bytearray(text.encode()))
    out.close()
    files.mkdirs(place.getParent())
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), conf)
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    try:
        context.rename(files.makeQualified(draft), files.makeQualified(place), spark.sparkContext._gateway.new_array(rename, 0))
    except Exception:
        files.delete(draft, False)
        if files.exists(place):
            return False
        raise
    return True
