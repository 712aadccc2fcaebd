from datetime import datetime

from pyspark.sql import functions as F

from shapewright.operators.changes import (
    append_history,
    apply_update,
    fill_on_change,
    history,
    history_from_feed,
    history_schema,
    qualify,
    quarantine,
    set_from_rules,
    shift_keys,
    upsert,
)

SCHEMA = "id int, version int, note string"


def test_history(spark, rows):
    before = spark.createDataFrame([(1, 1, "a"), (2, 1, "b"), (3, 1, "c"), (4, 1, "d"), (5, None, "e")], SCHEMA)
    after = spark.createDataFrame([(1, 1, "a"), (2, 2, "b"), (3, 1, "C"), (5, 1, "e"), (6, 1, "f")], SCHEMA)
    changes = history(before, after, "id", ["version"])
    assert rows(changes) == [(1, 6, 1, "f"), (2, 2, 2, "b"), (2, 5, 1, "e"), (3, 4, 1, "d")]
    assert rows(history(before, before, "id", ["version"])) == []
    assert len(rows(history(before.limit(0), after, "id", ["version"]))) == 5


def test_history_stamp(spark):
    empty = spark.createDataFrame([], "id int, seen timestamp_ntz")
    one = spark.createDataFrame([(1,)], "id int").withColumn("seen", F.lit(None).cast("timestamp_ntz"))
    stamped = history(empty, one, "id", [], "seen", "2024-01-31")
    assert stamped.first().seen == datetime(2024, 1, 31)


def test_history_from_feed(spark, rows):
    feed = spark.createDataFrame(
        [("insert", False, 1), ("update", True, 2), ("update", False, 3), ("delete", False, 4), ("other", True, 5)],
        "op string, watched boolean, id int",
    )
    assert rows(history_from_feed(feed, "op", "watched")) == [(1, 1), (2, 2), (3, 4)]


def test_history_table(spark, rows):
    table = spark.createDataFrame([(1, 1, "a")], SCHEMA)
    schema = history_schema(table)
    assert schema.names == ["history_id", "history_type", "id", "version", "note"]
    log = spark.createDataFrame([], schema)
    log = append_history(log, history(table.limit(0), table, "id", []), "id")
    log = append_history(log, history(table, table.limit(0), "id", []), "id")
    assert rows(log) == [(1, 1, 1, 1, "a"), (2, 3, 1, 1, "a")]


def test_updates(spark, rows):
    target = spark.createDataFrame([(1, 1, "a"), (2, 2, "b")], SCHEMA)
    changes = spark.createDataFrame([(1, "x", 1), (1, None, 2), (9, "z", 1)], "id int, new string, at int")
    updated = apply_update(target, changes, "id", {"note": "new"}, F.col("at").desc())
    assert rows(updated) == [(1, 1, None), (2, 2, "b")]
    source = spark.createDataFrame([(2, None, "B"), (3, 3, "c")], SCHEMA)
    assert rows(upsert(target, source, "id")) == [(1, 1, "a"), (2, None, "B"), (3, 3, "c")]
    assert rows(upsert(target.limit(0), source, "id")) == rows(source)


def test_small_updates(spark, rows):
    df = spark.createDataFrame([(19000,), (19001,), (19020,), (19021,), (None,)], "id int")
    assert rows(shift_keys(df, "id", 19001, 19020, -19000)) == [(1,), (19000,), (19021,), (20,), (None,)]
    ruled = set_from_rules(df, "id", F.when(F.col("id") > 19001, 1).otherwise(0))
    assert sum(r.id for r in ruled.collect()) == 2
    names = spark.createDataFrame([("dbo.a",), ("dbo.b",)], "full string")
    bare = spark.createDataFrame([("a", 1), ("x", 2)], "name string, n int")
    assert rows(qualify(bare, "name", names, "full")) == [("dbo.a", 1), ("x", 2)]


def test_fill_on_change(spark, rows):
    docs = spark.createDataFrame(
        [(1, None), (2, "<s xmlns='u'><t>5</t></s>"), (3, "<s xmlns='u'><n/></s>"), (4, "<s><t>"), (5, "<other/>")],
        "id int, doc string",
    )
    filled = dict(rows(fill_on_change(docs, "doc", "s", "t", "<t>0.00</t>")))
    assert filled == {
        1: "<s><t>0.00</t></s>",
        2: "<s xmlns='u'><t>5</t></s>",
        3: "<s xmlns='u'><t>0.00</t><n/></s>",
        4: "<s><t>",
        5: "<other/>",
    }


def test_quarantine(spark, rows):
    df = spark.createDataFrame([("1", 5), ("x", 5), (None, 5), ("2", -1)], "n string, v int")
    checks = {"no number": F.col("n").try_cast("int").isNotNull(), "negative": F.col("v") >= 0}
    good, bad = quarantine(df, checks)
    assert rows(good) == [("1", 5)]
    assert rows(bad, "n", "error") == [("2", "negative"), ("x", "no number"), (None, "no number")]
