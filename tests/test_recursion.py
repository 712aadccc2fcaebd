import pytest
from pyspark.sql import functions as F

from shapewright.operators import recursion
from shapewright.operators.recursion import closure, descend, follow, name_cycles, paths


def tree(spark, pairs):
    return spark.createDataFrame(pairs, "id int, boss int")


def test_two_roots_and_an_orphan(spark, rows):
    df = tree(spark, [(1, None), (2, None), (3, 1), (4, 3), (5, 2), (6, 99), (7, 7)])
    assert rows(descend(df, "id", "boss"), "id", "level") == [(1, 0), (2, 0), (3, 1), (4, 2), (5, 1)]


def test_no_roots(spark, rows):
    assert rows(descend(tree(spark, [(1, 2), (2, 1)]), "id", "boss")) == []
    assert rows(descend(tree(spark, []), "id", "boss")) == []


def test_repeated_rows_stay(spark, rows):
    df = tree(spark, [(1, None), (2, 1), (2, 1)])
    assert rows(descend(df, "id", "boss"), "id", "level") == [(1, 0), (2, 1), (2, 1)]


def test_chain_and_depth_limit(spark, rows):
    chain = tree(spark, [(1, None)] + [(i, i - 1) for i in range(2, 13)])
    assert len(rows(descend(chain, "id", "boss"))) == 12
    with pytest.raises(RuntimeError, match="level 5"):
        descend(chain, "id", "boss", max_depth=5)


def test_cycle_below_a_root_raises(spark):
    df = tree(spark, [(1, None), (2, 1), (3, 2), (2, 3)])
    with pytest.raises(RuntimeError, match="cycle"):
        descend(df, "id", "boss", max_depth=6)


def test_paths_leave_the_root_out(spark, rows):
    df = spark.createDataFrame([(1, 0, "a"), (2, 1, "b"), (3, 2, "c"), (4, 1, None)], "id int, up int, name string")
    assert rows(paths(df, "id", "up", "name", "\\", root=0), "id", "path") == [
        (1, "a"),
        (2, "a\\b"),
        (3, "a\\b\\c"),
        (4, None),
    ]
    top = df.withColumn("up", F.nullif(F.col("up"), F.lit(0)))
    assert rows(paths(top, "id", "up", "name"), "id", "path")[2] == (3, "a/b/c")


def test_closure(spark, rows):
    edges = lambda pairs: spark.createDataFrame(pairs, "p string, c string")
    diamond = edges([("s", "a"), ("s", "b"), ("a", "d"), ("b", "d"), ("d", "leaf"), ("s", "a")])
    assert rows(closure(diamond, "p", "c", "s")) == [("a", 1), ("b", 1), ("d", 2), ("s", 0)]
    looped_start = edges([("s", "s"), ("s", "a"), ("a", "x")])
    assert rows(closure(looped_start, "p", "c", "s")) == [("a", 1), ("s", 0)]
    looped_child = edges([("s", "a"), ("a", "a"), ("a", "b"), ("b", "x")])
    assert rows(closure(looped_child, "p", "c", "s")) == [("s", 0)]
    cycle = edges([("s", "a"), ("a", "b"), ("b", "s")])
    assert rows(closure(cycle, "p", "c", "s")) == [("a", 1), ("b", 2), ("s", 0)]
    assert rows(closure(cycle, "p", "c", "none")) == []
    with pytest.raises(RuntimeError):
        closure(cycle, "p", "c", "s", max_depth=1)


def test_a_chain_of_100000_takes_few_joins(spark, monkeypatch):
    n = 100_000
    mixed = F.pmod(F.col("id") * 7919, F.lit(n))  # neighbours in the chain are far apart in the table
    at = spark.range(n).select(mixed.alias("id")).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("boss"))
    settled, settle = [], recursion.settle
    monkeypatch.setattr(recursion, "settle", lambda df, label: (settled.append(label), settle(df, label))[1])
    levels = descend(at, "id", "boss")
    assert settled.count("jump") <= 18
    assert levels.agg(F.count_if(F.col("level") == F.col("id")), F.count(F.lit(1))).first() == (n, n)


def test_deep_paths(spark, rows):
    pairs = [(i, i - 1 if i else None, str(i)) for i in range(300)]
    df = spark.createDataFrame(pairs, "id int, up int, name string")
    got = {r["id"]: (r["path"], r["level"]) for r in paths(df, "id", "up", "name").collect()}
    assert got == {i: ("/".join(map(str, range(i + 1))), i) for i in range(300)}


def test_hub_with_a_third_of_all_rows(spark):
    df = spark.range(1, 3001).select("id", F.when(F.col("id") % 3 == 0, 2).when(F.col("id") > 1, (F.col("id") / 2).cast("int")).alias("boss"))
    parent = {r["id"]: r["boss"] for r in df.collect()}

    def level(i):
        return 0 if parent[i] is None else level(parent[i]) + 1

    assert {r["id"]: r["level"] for r in descend(df, "id", "boss").collect()} == {i: level(i) for i in parent}


def test_cycles_are_named_and_not_reached(spark, rows):
    df = tree(spark, [(1, None), (2, 1), (3, 5), (4, 3), (5, 4), (6, 5), (7, 7), (8, 99), (9, 8), (10, 6), (11, 12), (12, 11)])
    assert rows(descend(df, "id", "boss"), "id", "level") == [(1, 0), (2, 1)]
    looped = follow(df, "id", "boss")[1]
    assert rows(name_cycles(looped), "id", "cycle", "on_cycle") == [
        (10, 3, False), (11, 11, True), (12, 11, True), (3, 3, True), (4, 3, True), (5, 3, True), (6, 3, False), (7, 7, True),
    ]
    assert rows(name_cycles(tree(spark, []).toDF("id", "next"))) == []


def test_rows_without_id_and_repeated_ids(spark, rows):
    df = tree(spark, [(1, None), (None, 1), (None, None), (2, 1), (3, None)])
    assert rows(descend(df, "id", "boss"), "id", "level") == [(1, 0), (2, 1), (3, 0), (None, 0), (None, 1)]
    twice = tree(spark, [(1, None), (2, 1), (2, 1), (3, 2)])
    assert rows(descend(twice, "id", "boss"), "id", "level") == [(1, 0), (2, 1), (2, 1), (3, 2), (3, 2)]
