"""A table with one row per key that is changed in place: snapshots of files, listed by a manifest.

Rows are dealt into buckets by a hash of the key; the files of a bucket hold ranges of the key, and the
manifest keeps each file's smallest and largest key. A merge reads and rewrites only the files that may hold
one of its keys; all others pass into the next snapshot unread.

A snapshot becomes current by the creation of one small commit file, which fails if another writer has
created it first. So readers see a whole snapshot or the one before, a writer that dies leaves nothing that
counts, and of two writers the second merges again on top of the first.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shapewright.session import create_file, settle

ROWS_PER_FILE = 1_000_000
ATTEMPTS = 5


class ConcurrentCommit(RuntimeError):
    """Another writer has created the next snapshot first."""


class KeyedTable:
    """The table in ``folder``, which every executor must reach.

    ``data/`` holds files of rows, ``manifests/`` lists of files, ``commits/`` one file for each version. A bucket
    should hold about a gigabyte: one task rewrites what a merge touches of it. Keys are not null; their type can be ordered.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._jvm = spark.sparkContext._jvm

    # --- files

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _publish(self, version: int, commit: dict) -> None:
        """Creates the commit file of a version, whole or not at all, or fails as there is one already."""
        if not create_file(self.spark, f"{self.folder}/commits/{version:012d}", json.dumps(commit)):
            raise ConcurrentCommit(f"version {version} of {self.folder}")

    def versions(self) -> list[int]:
        files, place = self._files(), self._path("commits")
        if not files.exists(place):
            return []
        return sorted(int(s.getPath().getName()) for s in files.listStatus(place) if s.getPath().getName().isdigit())

    def _commit_of(self, version: int) -> dict:
        return json.loads(self.spark.read.text(f"{self.folder}/commits/{version:012d}", wholetext=True).first()[0])

    def current(self) -> dict | None:
        """The current commit: version, manifest, key, buckets, schema, batches; None before the first one."""
        versions = self.versions()
        return self._commit_of(versions[-1]) if versions else None

    def manifest(self, commit: dict) -> DataFrame:
        """bucket, path (below the table's folder), rows, low, high of each file of a snapshot."""
        kind = StructType.fromJson(commit["schema"])[commit["key"]].dataType.simpleString()
        schema = f"bucket int, path string, rows long, low {kind}, high {kind}"
        return self.spark.read.schema(schema).parquet(f"{self.folder}/{commit['manifest']}")

    def _rows_of(self, paths: list[str], schema: StructType) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{p}" for p in paths])

    def read(self, version: int | None = None) -> DataFrame:
        """The rows of the current snapshot, or of an older one that has not been vacuumed."""
        commit = self.current() if version is None else self._commit_of(version)
        paths = [r["path"] for r in self.manifest(commit).select("path").collect()]
        return self._rows_of(paths, StructType.fromJson(commit["schema"]))

    # --- changes

    def _bucket(self, key: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(buckets)).cast("int")

    def _write(self, rows: DataFrame, key: str, buckets: int, rows_per_file: int) -> DataFrame:
        """Writes rows into new files, ranges of the key in each bucket, and returns their manifest rows."""
        name = f"data/{uuid.uuid4().hex}"
        placed = rows.withColumn("_bucket", self._bucket(key, buckets))
        width = min(buckets, max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions"))) * 8)
        placed = placed.repartition(width, "_bucket").sortWithinPartitions("_bucket", key)
        placed.write.partitionBy("_bucket").option("maxRecordsPerFile", rows_per_file).parquet(f"{self.folder}/{name}")
        written = self.spark.read.schema(f"`{key}` {rows.schema[key].dataType.simpleString()}, _bucket int").parquet(f"{self.folder}/{name}")
        file = F.concat(F.lit(f"{name}/"), F.element_at(F.split(F.col("_metadata.file_path"), f"{name}/"), -1))
        return written.groupBy(F.col("_bucket").alias("bucket"), file.alias("path")).agg(
            F.count(F.lit(1)).alias("rows"), F.min(key).alias("low"), F.max(key).alias("high")
        )

    def _save(self, manifest: DataFrame) -> str:
        name = f"manifests/{uuid.uuid4().hex}"
        manifest.write.parquet(f"{self.folder}/{name}")
        return name

    def create(self, rows: DataFrame, key: str, buckets: int = 64, rows_per_file: int = ROWS_PER_FILE) -> int:
        """Version 0, from rows with a unique key. An existing table is an error."""
        manifest = self._save(self._write(rows, key, buckets, rows_per_file))
        self._publish(0, {"version": 0, "manifest": manifest, "key": key, "buckets": buckets, "rows_per_file": rows_per_file, "schema": rows.schema.jsonValue(), "batches": {}})
        return 0

    def touched(self, commit: dict, keys: DataFrame) -> DataFrame:
        """Manifest rows of the files that a merge of these keys rewrites.

        Those whose range holds one of the keys and, in buckets that get rows, those less than half full,
        so that files which small merges leave are put together by the next one.
        """
        files = self.manifest(commit)
        near = keys.select(F.col(commit["key"]).alias("_key"), self._bucket(commit["key"], commit["buckets"]).alias("_in"))
        inside = (files["bucket"] == near["_in"]) & (
            near["_key"].between(files["low"], files["high"]) | (files["rows"] * 2 < commit["rows_per_file"])
        )
        return files.join(near, inside, "left_semi")

    def merge(self, source: DataFrame, newer: list[str] | None = None, deleted: str | None = None, writer: str | None = None, batch: int | None = None) -> dict:
        """Inserts rows with new keys and replaces those with known ones; returns the commit and what was done.

        ``source`` has the table's columns and unique keys. With ``newer`` a known key is replaced only if these
        columns of the new row, compared in order, are not below the old ones'. Rows in which the boolean column
        ``deleted`` is true take their key out. A ``writer`` numbers its batches upwards: a batch that is not above
        the last one that counts changes nothing. Of concurrent writers the later merges again, at most ``ATTEMPTS`` times.
        """
        frozen = None
        for _ in range(ATTEMPTS):
            commit = self.current()
            done = commit["batches"].get(writer) if writer is not None else None
            if done is not None and batch is not None and batch <= done:
                return {"version": commit["version"], "files_read": 0, "files": 0, "applied": False}
            if frozen is None:
                frozen = settle(source, "merge")
                keys = frozen.groupBy(F.col(commit["key"]).alias("key")).count()
                if not keys.filter("key IS NULL OR count > 1").isEmpty():
                    raise ValueError("the keys of a merge must not be null and not be repeated")
            try:
                return self._merge_once(commit, frozen, newer, deleted, writer, batch)
            except ConcurrentCommit:
                continue
        raise ConcurrentCommit(f"no merge into {self.folder} in {ATTEMPTS} attempts")

    def _merge_once(self, commit: dict, source: DataFrame, newer, deleted, writer, batch) -> dict:
        key, schema = commit["key"], StructType.fromJson(commit["schema"])
        names = schema.names
        paths = [r["path"] for r in self.touched(commit, source).select("path").collect()]
        old = self._rows_of(paths, schema)
        new = source.select(*[F.col(f"`{c}`").alias(f"_new_{c}") for c in names], (F.col(deleted) if deleted else F.lit(False)).alias("_deleted"))
        both = old.join(new, old[key] == new[f"_new_{key}"], "full")
        take = F.col(f"_new_{key}").isNotNull()
        if newer:
            fresh = F.struct(*[f"_new_{c}" for c in newer]) >= F.struct(*newer)
            take = take & (F.col(key).isNull() | fresh)
        gone = take & F.coalesce(F.col("_deleted"), F.lit(False))
        merged = both.filter(~gone).select(*[F.when(take, F.col(f"_new_{c}")).otherwise(F.col(f"`{c}`")).alias(c) for c in names])
        made = self._write(merged, key, commit["buckets"], commit["rows_per_file"])
        listed = self.manifest(commit)
        kept = listed.join(self.spark.createDataFrame([(p,) for p in paths], "path string"), "path", "left_anti")
        manifest = self._save(kept.unionByName(made))
        batches = commit["batches"] | ({writer: batch} if writer is not None and batch is not None else {})
        following = commit | {"version": commit["version"] + 1, "manifest": manifest, "batches": batches}
        self._publish(following["version"], following)
        return {"version": following["version"], "files_read": len(paths), "files": listed.count(), "applied": True}

    def vacuum(self, keep: int = 2) -> int:
        """Deletes the commits before the last ``keep`` and every file that none of these lists; returns the number of entries deleted.

        For times without writers, as the files of a merge under way are listed nowhere yet.
        """
        files, versions = self._files(), self.versions()
        commits = [self._commit_of(v) for v in versions[-keep:]]
        lists = {c["manifest"].split("/")[1] for c in commits}
        held = {r["path"].split("/")[1] + "/" + "/".join(r["path"].split("/")[2:]) for c in commits for r in self.manifest(c).select("path").collect()}
        stale = [self._path(f"commits/{v:012d}") for v in versions[:-keep]]
        for kind, used in (("manifests", lists), ("data", {h.split("/")[0] for h in held})):
            place = self._path(kind)
            if files.exists(place):
                stale += [s.getPath() for s in files.listStatus(place) if s.getPath().getName() not in used]
        for name in sorted({h.split("/")[0] for h in held}):
            for bucket in files.listStatus(self._path(f"data/{name}")):
                if bucket.isDirectory():
                    inside = f"{name}/{bucket.getPath().getName()}"
                    stale += [s.getPath() for s in files.listStatus(bucket.getPath()) if f"{inside}/{s.getPath().getName()}" not in held]
        for place in stale:
            files.delete(place, True)
        return len(stale)
