"""Rows to files and files to rows. The writer is the only place with Python per row."""

from __future__ import annotations

import posixpath
import uuid
from fnmatch import fnmatch

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shapewright.functions.text import folder_of, strip_extension


def path_projection(df: DataFrame, path: str, blob: str, sep_from: str = "/", sep_to: str = "\\") -> DataFrame:
    """Path with its separators swapped, and the content as bytes."""
    swapped = F.replace(F.col(path), F.lit(sep_from), F.lit(sep_to))
    return df.withColumn(path, swapped).withColumn(blob, F.col(blob).cast("binary"))


def write_blobs(df: DataFrame, path: str, blob: str, root: str) -> DataFrame:
    """One file per row at root/path, written by the tasks; returns (path, bytes, ok, error).

    ``root`` is a folder or URI all executors can reach. A file is written beside its place and then
    moved there, so a repeated task leaves the same file. A row that fails is reported and the others
    go on. Nothing is written until the result is read.
    """

    def write(batches):
        import pyarrow as pa
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(root)
        for batch in batches:
            done = []
            for at in range(batch.num_rows):
                name, content = batch.column(0)[at].as_py(), batch.column(1)[at].as_py()
                try:
                    relative = posixpath.normpath(name.lstrip("/"))
                    if relative in ("", ".") or relative.startswith(".."):
                        raise ValueError("the path does not name a file below the root")
                    target = posixpath.join(base, relative)
                    store.create_dir(posixpath.dirname(target), recursive=True)
                    part = f"{target}.{uuid.uuid4().hex}.part"
                    with store.open_output_stream(part) as out:
                        out.write(content if content is not None else b"")
                    store.move(part, target)
                    done.append((name, len(content or b""), True, None))
                except Exception as failure:
                    done.append((name, 0, False, f"{type(failure).__name__}: {failure}"[:500]))
            kinds = {"path": pa.string(), "bytes": pa.int64(), "ok": pa.bool_(), "error": pa.string()}
            columns = [pa.array([d[i] for d in done], kind) for i, kind in enumerate(kinds.values())]
            yield pa.RecordBatch.from_arrays(columns, names=list(kinds))

    rows = df.select(F.col(path).alias("path"), F.col(blob).cast("binary").alias("content"))
    return rows.mapInArrow(write, "path string, bytes long, ok boolean, error string")


def read_blobs(
    spark: SparkSession, root: str, pattern: str = "*", extension: str | None = None, keep_empty: bool = True
) -> DataFrame:
    """All files below a folder: folder relative to it, name, content.

    The pattern (*, ? and [...]) is for the file name. Spark's file sources give no row for a file
    of length 0; ``keep_empty`` adds those from a listing made by the tasks.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    ).select("path", "content")
    if keep_empty:
        files = files.unionByName(_empty_files(spark, root, pattern))
    return files.select(*_place(F.col("path"), root, extension), "content")


def _empty_files(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """Files of length 0: the top folder is listed here, each folder in it by a task."""
    from pyarrow import fs

    store, base = fs.FileSystem.from_uri(root)
    top = store.get_file_info(fs.FileSelector(base))
    is_empty = lambda f: f.type == fs.FileType.File and f.size == 0 and fnmatch(f.base_name, pattern)

    def list_folders(batches):
        import pyarrow as pa

        for batch in batches:
            for folder in batch.column(0).to_pylist():
                below = store.get_file_info(fs.FileSelector(folder, recursive=True))
                found = [f.path for f in below if is_empty(f)]
                columns = [pa.array(found, pa.string()), pa.array([b""] * len(found), pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["path", "content"])

    schema = "path string, content binary"
    folders = [(f.path,) for f in top if f.type == fs.FileType.Directory]
    listed = spark.createDataFrame(folders, "path string")
    if len(folders) > 1:
        listed = listed.repartition(min(len(folders), spark.sparkContext.defaultParallelism))
    here = spark.createDataFrame([(f.path, b"") for f in top if is_empty(f)], schema)
    return here.unionByName(listed.mapInArrow(list_folders, schema))


def _place(path: Column, root: str, extension: str | None) -> list[Column]:
    from pyarrow import fs

    plain = fs.FileSystem.from_uri(root)[1].rstrip("/")  # the part that all spellings of the root share
    below = F.substring(path, F.instr(path, plain) + F.lit(len(plain)), F.length(path))
    leaf = F.substring_index(below, "/", -1)
    return [folder_of(below).alias("folder"), (strip_extension(leaf, extension) if extension else leaf).alias("name")]
