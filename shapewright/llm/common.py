"""Helpers that the operators of this folder share: tables, stages on shared storage, batches of text."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapewright.session import new_folder

CHUNK_BYTES = 2 << 20  # text that one numpy step works on; a longer document is a chunk of its own
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
SPACE_WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_az(text: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


class Stages:
    """Intermediate tables in the folder that spark.checkpoint.dir names.

    A stage survives lost executors, later steps read only the columns they need, and the shuffle files
    of the job that wrote it are deleted at its end. A stage that is no longer needed can be dropped.
    Results are lazy and read their last stages, so those stay until ``release``.
    """

    written: list[Stages] = []

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folders: dict[str, str] = {}
        Stages.written.append(self)

    @classmethod
    def release(cls) -> int:
        """Deletes all stages that this process wrote; for when the results built on them have been written."""
        count = 0
        while cls.written:
            stages = cls.written.pop()
            count += len(stages.folders)
            stages.drop(*list(stages.folders))
        return count

    def write(self, name: str, df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
        folder = new_folder(self.spark, name)
        before = self.spark.conf.get(CLEANUP)
        self.spark.conf.set(CLEANUP, "true")
        try:
            df.write.partitionBy(*partition_by).option("compression", "zstd").parquet(folder)
        finally:
            self.spark.conf.set(CLEANUP, before)
        self.drop(name)
        self.folders[name] = folder
        return self.spark.read.schema(df.schema).parquet(folder)

    def drop(self, *names: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for name in names:
            if folder := self.folders.pop(name, None):
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(conf).delete(path, True)


def chunks(batches: Iterator[pa.RecordBatch], text: str, limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts Arrow batches between rows so that each holds about ``limit`` bytes of ``text``."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_pylist()
        first = held = 0
        for row, size in enumerate(sizes):
            if held and held + size > limit:
                yield batch.slice(first, row - first)
                first, held = row, 0
            held += size
        if first < len(sizes):
            yield batch.slice(first)
