"""The keyed table: merges, pruning, repeated batches, writers that die or meet."""

import pytest
from pyspark.sql import functions as F

from shapewright.sources import keyed
from shapewright.sources.keyed import ConcurrentCommit, KeyedTable
from shapewright.streaming.streams import upsert_stream


def table_of(spark, folder, n=1000, buckets=4, rows_per_file=50):
    table = KeyedTable(spark, str(folder))
    table.create(spark.range(n).select("id", (F.col("id") * 10).alias("v")), "id", buckets, rows_per_file)
    return table


def change(spark, pairs):
    return spark.createDataFrame(pairs, "id long, v long")


def values(table):
    return {r["id"]: r["v"] for r in table.read().collect()}


def test_merge_replaces_inserts_and_deletes(spark, tmp_path):
    table = table_of(spark, tmp_path)
    source = spark.createDataFrame([(3, 1, False), (4, 1, True), (5000, 2, False), (6000, 2, True)], "id long, v long, gone boolean")
    table.merge(source, deleted="gone")
    want = {i: i * 10 for i in range(1000)} | {3: 1, 5000: 2}
    del want[4]
    assert values(table) == want and table.read().count() == len(want)
    assert table.read(version=0).count() == 1000


def test_only_files_that_may_hold_the_keys_are_read(spark, tmp_path):
    table = table_of(spark, tmp_path, n=4000)
    before = {r["path"]: r for r in table.manifest(table.current()).collect()}
    small = sum(r["rows"] * 2 < 50 for r in before.values())
    assert len(before) >= 80
    done = table.merge(change(spark, [(i, 7) for i in range(1000, 1010)]))
    after = {r["path"] for r in table.manifest(table.current()).collect()}
    assert done["files"] == len(before) and done["files_read"] <= 4 * 2 + small
    rewritten = set(before) - after
    assert len(rewritten) == done["files_read"]
    assert all(before[p]["low"] <= 1009 and before[p]["high"] >= 1000 or before[p]["rows"] * 2 < 50 for p in rewritten)
    assert values(table) == {i: 7 if 1000 <= i < 1010 else i * 10 for i in range(4000)}


def test_small_files_are_put_together(spark, tmp_path):
    table = table_of(spark, tmp_path, n=100, buckets=2)
    for i in range(6):
        table.merge(change(spark, [(1000 + 10 * i + j, i) for j in range(4)]))
    rows = [r["rows"] for r in table.manifest(table.current()).collect()]
    assert sum(rows) == 124 and len(rows) <= 6


def test_a_repeated_batch_counts_once(spark, tmp_path):
    table = table_of(spark, tmp_path, 10)
    assert table.merge(change(spark, [(1, 5)]), writer="w", batch=0)["applied"]
    table.merge(change(spark, [(1, 6)]), writer="w", batch=1)
    assert not table.merge(change(spark, [(1, 5)]), writer="w", batch=0)["applied"]
    assert values(table)[1] == 6 and table.merge(change(spark, [(1, 8)]), writer="other", batch=0)["applied"]
    assert values(table)[1] == 8


def test_older_rows_do_not_replace_newer_ones(spark, tmp_path):
    table = table_of(spark, tmp_path, 10)
    table.merge(change(spark, [(1, 5), (2, 25), (3, None)]), newer=["v"])
    assert values(table) == {i: i * 10 for i in range(10)} | {2: 25}


def test_a_writer_that_dies_before_its_commit_leaves_nothing(spark, tmp_path, monkeypatch):
    table = table_of(spark, tmp_path, 100)
    with monkeypatch.context() as patched:
        patched.setattr(KeyedTable, "_publish", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            table.merge(change(spark, [(1, 5)]), writer="w", batch=0)
    assert values(table)[1] == 10 and table.versions() == [0]
    table.merge(change(spark, [(1, 6)]), writer="w", batch=0)
    assert values(table)[1] == 6
    files = lambda: len(list(tmp_path.glob("data/*/*/*.parquet")))
    before, live = files(), table.manifest(table.current()).count()
    assert table.vacuum(keep=1) > 0 and before > files() == live and table.versions() == [1]
    assert values(table) == {i: 6 if i == 1 else i * 10 for i in range(100)}


def test_of_two_writers_the_second_merges_again(spark, tmp_path, monkeypatch):
    one, two = table_of(spark, tmp_path, 100), KeyedTable(spark, str(tmp_path))
    publish, met = KeyedTable._publish, []

    def meet(self, version, commit):
        if self is one and not met:
            met.append(version)
            two.merge(change(spark, [(1, 5), (2, 5)]))
        publish(self, version, commit)

    monkeypatch.setattr(KeyedTable, "_publish", meet)
    assert one.merge(change(spark, [(2, 6), (3, 6)]))["version"] == 2
    assert met == [1] and values(one) == {i: i * 10 for i in range(100)} | {1: 5, 2: 6, 3: 6}
    monkeypatch.setattr(keyed, "ATTEMPTS", 0)
    with pytest.raises(ConcurrentCommit):
        one.merge(change(spark, [(1, 1)]))


def test_empty_tables_and_empty_sources(spark, tmp_path):
    table = table_of(spark, tmp_path, 0)
    assert values(table) == {}
    table.merge(change(spark, []))
    table.merge(change(spark, [(1, 2)]))
    assert values(table) == {1: 2}
    assert table.merge(change(spark, []))["files_read"] == 0


@pytest.mark.parametrize("pairs", [[(1, 2), (1, 3)], [(None, 1)]])
def test_repeated_and_missing_keys_are_an_error(spark, tmp_path, pairs):
    table = table_of(spark, tmp_path, 10)
    with pytest.raises(ValueError):
        table.merge(change(spark, pairs))
    assert table.versions() == [0]


def test_text_keys_and_an_existing_table(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path))
    rows = spark.createDataFrame([("a=b/c %", 1), ("ü", 2)], "`the key` string, v int")
    table.create(rows, "the key", 2)
    table.merge(spark.createDataFrame([("ü", 3)], rows.schema))
    assert sorted(map(tuple, table.read().collect())) == [("a=b/c %", 1), ("ü", 3)]
    with pytest.raises(ConcurrentCommit):
        table.create(rows, "the key")


def test_stream_of_upserts(spark, tmp_path, rows):
    batches = [[(1, 5, "a"), (2, 5, "b"), (None, 1, "x")], [(1, 7, "c"), (1, 6, "d")], [(2, 4, "late"), (3, 1, "e")]]
    for at, batch in enumerate(batches):
        spark.createDataFrame(batch, "k int, at int, v string").coalesce(1).write.parquet(f"{tmp_path}/in/b{at}")
    schema = "k int, at int, v string"
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/b*")
    for _ in range(2):
        upsert_stream(source, "k", ["at"], f"{tmp_path}/t", f"{tmp_path}/state", 2).awaitTermination()
    table = KeyedTable(spark, f"{tmp_path}/t")
    assert rows(table.read(), "k", "at", "v") == [(1, 7, "c"), (2, 5, "b"), (3, 1, "e")]
    assert list(table.current()["batches"].values()) == [2] and table.manifest(table.current()).count() <= 2


def test_a_stream_batch_that_dies_is_replayed(spark, tmp_path, rows, monkeypatch):
    schema = "k int, at int, v string"
    spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], schema).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
    run = lambda: upsert_stream(source, "k", ["at"], f"{tmp_path}/t", f"{tmp_path}/state", 2).awaitTermination()
    publish = KeyedTable._publish
    with monkeypatch.context() as patched:  # it dies after the swap: Spark does not learn that the batch is done

        def die(self, version, commit):
            publish(self, version, commit)
            if version:
                raise OSError("lost")

        patched.setattr(KeyedTable, "_publish", die)
        with pytest.raises(Exception, match="lost"):
            run()
    table = KeyedTable(spark, f"{tmp_path}/t")
    assert table.versions() == [0, 1]
    run()
    assert table.versions() == [0, 1] and rows(table.read(), "k", "v") == [(1, "a"), (2, "b")]
