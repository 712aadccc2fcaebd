from pathlib import Path

import pytest
from pyspark.sql import functions as F

from shapewright.session import new_folder, release, settle, shared_folder
from shapewright.sources.blobs import path_projection, read_blobs, write_blobs
from shapewright.sources.tables import column_profile, materialise, profile_tables, scan


def test_shared_folder_is_the_configured_one(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert new_folder(spark, "x") != new_folder(spark, "x")


def test_settle_freezes_values(spark, rows):
    frozen = settle(spark.range(20).withColumn("r", F.rand()))
    assert rows(frozen) == rows(frozen)


def test_release(spark):
    release(spark)
    folder = Path(settle(spark.range(3), "gone").inputFiles()[0].removeprefix("file://")).parent
    assert folder.is_dir() and folder.name.startswith("gone-")
    assert release(spark) == 1 and not folder.exists()
    assert release(spark) == 0


def test_scan(spark, small):
    assert scan(spark, small, "nation").count() == 25
    assert scan(spark, small, "nation", "n_nationkey int").columns == ["n_nationkey"]


def test_profiles(spark, small, tmp_path, rows):
    spark.range(0).write.parquet(f"{tmp_path}/none")
    spark.range(10).repartition(3).write.parquet(f"{tmp_path}/ten")
    tables = {n: spark.read.schema("id long").parquet(f"{tmp_path}/{n}") for n in ("none", "ten")}
    profile = {r.table_name: r for r in profile_tables(tables).collect()}
    assert (profile["none"].total_rows, profile["ten"].total_rows) == (0, 10)
    size = sum(f.stat().st_size for f in (tmp_path / "ten").glob("*.parquet"))
    assert profile["ten"].total_bytes == size
    df = spark.createDataFrame([(1, None), (2, None)], "a int, b string")
    assert rows(column_profile(df)) == [(1, "a", "int", True, 0, 2), (2, "b", "string", True, 2, 0)]


def test_materialise(spark, tmp_path, rows):
    first = materialise(spark.range(3), f"{tmp_path}/t")
    assert rows(first) == [(0,), (1,), (2,)]
    assert materialise(spark.range(1), f"{tmp_path}/t").count() == 1


def test_blobs(spark, tmp_path, rows):
    df = spark.createDataFrame(
        [("/a/b/one.rdl", b"1"), ("/two.RDL", b""), ("/a/null.rdl", None), ("../up.rdl", b"x"), ("", b"x"), ("/a/b", b"dir")],
        "path string, content binary",
    )
    root = f"{tmp_path}/out"
    (tmp_path / "out" / "a" / "b").mkdir(parents=True)
    for _ in range(2):  # a repeated task leaves the same files
        done = {r.path: (r.bytes, r.ok) for r in write_blobs(df, "path", "content", root).collect()}
    assert {p: ok for p, (_, ok) in done.items()} == {
        "/a/b/one.rdl": True,
        "/two.RDL": True,
        "/a/null.rdl": True,
        "../up.rdl": False,
        "": False,
        "/a/b": False,
    }
    found = read_blobs(spark, root, "*.[rR][dD][lL]", "rdl")
    assert [(a, b, bytes(c)) for a, b, c in rows(found)] == [("", "two", b""), ("/a", "null", b""), ("/a/b", "one", b"1")]
    assert not list(tmp_path.rglob("up.rdl"))


def test_path_projection(spark):
    row = path_projection(spark.createDataFrame([("/a/b", "x")], "p string, c string"), "p", "c").first()
    assert (row.p, bytes(row.c)) == ("\\a\\b", b"x")


def test_cluster_without_folder_is_an_error(spark, monkeypatch):
    class Conf:
        def get(self, key, default=None):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Session())
