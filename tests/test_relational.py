import pytest
from pyspark.sql import functions as F

from shapewright.functions.nulls import to_number
from shapewright.operators.aggregates import (
    group_stats,
    mode_per_group,
    ordered_list,
    ordered_list_parts,
    pair_ratio,
    parents_with_children,
    pivot_count,
    pivot_dynamic,
    unpivot,
)
from shapewright.operators.filters import decode, first_match, flagged, only, with_match, within_days, without_match
from shapewright.operators.joins import (
    all_combinations,
    child_above_parent,
    expand,
    join_rollups,
    lookup,
    values_in_runs,
    waits_with_holder,
)
from shapewright.operators.sets import append_all, union_distinct, union_sources
from shapewright.operators.table_functions import at_least, contact_lookup, filtered_view
from shapewright.sources.tables import scan_named, values


@pytest.fixture
def staff(spark):
    return spark.createDataFrame(
        [(1, "a", 50, None), (2, "b", 60, 1), (3, "c", 50, 1), (4, "d", 90, 2), (5, "e", 90, 99), (2, "b2", 10, 1)],
        "id int, name string, pay int, boss int",
    )


def test_above_parent(staff, rows):
    assert rows(child_above_parent(staff, "id", "boss", "pay"), "name") == [("b",), ("d",), ("d",)]
    assert rows(child_above_parent(staff, "id", "boss", "pay", "exists"), "name") == [("b",), ("d",)]


def test_parents_with_children(staff, rows):
    assert rows(parents_with_children(staff, "id", "boss", 3), "name") == [("a",)]
    assert rows(parents_with_children(staff, "id", "boss", 4), "name") == []


def test_runs(spark, rows):
    log = spark.createDataFrame(
        [(1, "1"), (2, "1.00"), (3, "1"), (4, "x"), (5, "x"), (6, "x"), (8, "2"), (9, "2"), (11, "2")], "id int, num string"
    )
    number = to_number(F.col("num"), "decimal(8,2)")
    assert [float(v) for (v,) in rows(values_in_runs(log, "id", number))] == [1.0]
    assert rows(values_in_runs(log, "id", F.col("num"))) == [("x",)]
    assert rows(values_in_runs(log, "id", F.col("num"), 2)) == [("2",), ("x",)]


def test_pair_ratio(spark, rows):
    asked = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (2, 3)], "s int, t int")
    taken = spark.createDataFrame([(1, 2), (1, 2)], "r int, a int")
    ratio = lambda part, whole: rows(pair_ratio(part, whole, ["r", "a"], ["s", "t"]))
    assert ratio(taken, asked) == [(0.33,)]
    assert ratio(taken, asked.limit(0)) == ratio(taken.limit(0), asked) == [(0.0,)]


def test_mode(spark, rows):
    df = spark.createDataFrame([("a", "y"), ("a", "x"), ("a", "x"), ("b", "q"), ("b", "p"), (None, "z")], "k string, v string")
    assert rows(mode_per_group(df, ["k"], "v")) == [("a", "x"), ("b", "p"), (None, "z")]


@pytest.mark.parametrize("hot_rows", [1, 10**9])
def test_ordered_lists(spark, rows, hot_rows):
    df = spark.createDataFrame([("c", "b"), ("c", "a&b"), ("c", None), ("d", "z"), (None, "q"), ("e", None)], "k string, v string")
    assert rows(ordered_list(df, ["k"], "v", trailing_sep=True)) == [
        ("c", "a&b,b,"),
        ("d", "z,"),
        ("e", None),
        (None, "q,"),
    ]
    with pytest.raises(ValueError, match="ordered_list_parts"):
        ordered_list(df, ["k"], "v", max_items=2)
    assert ("c", "a&b'\\b") in rows(ordered_list(df, ["k"], "v", sep="'\\"))
    parts = ordered_list_parts(df, ["k"], "v", "v", per_part=1, hot_rows=hot_rows)
    assert rows(parts, "k", "part_no", "items") == [("c", 1, "a&b"), ("c", 2, "b"), ("d", 1, "z"), (None, 1, "q")]


def test_pivots(spark, rows):
    df = spark.createDataFrame([("u", "a]b"), ("u", "a]b"), ("v", "c"), ("w", None)], "who string, role string")
    fixed = pivot_count(df, ["who"], "role", ["c", "none"])
    assert rows(fixed, "who", "c", "none") == [("u", 0, 0), ("v", 1, 0), ("w", 0, 0)]
    first_c = F.when(F.col("role") == "c", 0).otherwise(1)
    made = pivot_dynamic(df, ["who"], "role", first_c)
    assert made.columns == ["who", "c", "a]b"]
    assert rows(made) == [("u", 0, 2), ("v", 1, 0), ("w", 0, 0)]
    with pytest.raises(ValueError, match="more than 1"):
        pivot_dynamic(df, ["who"], "role", cap=1)
    assert rows(unpivot(fixed, ["who"], ["c"])) == [("u", "c", 0), ("v", "c", 1), ("w", "c", 0)]


def test_group_stats(spark, rows):
    df = spark.createDataFrame([(1, 1), (1, 2)], "k int, v int")
    assert rows(group_stats(df, ["k"], "v", whole_avg=True)) == [(1, 2, 1, 2)]
    assert rows(group_stats(df, ["k"], "v")) == [(1, 2, 1.5, 2)]


def test_semi_and_anti(spark, rows):
    left = spark.createDataFrame([(1,), (2,), (None,)], "id int")
    right = spark.createDataFrame([(1, 5), (1, 6), (None, 7)], "ref int, v int")
    assert rows(with_match(left, right, {"id": "ref"})) == [(1,)]
    assert rows(without_match(left, right, {"id": "ref"})) == [(2,), (None,)]
    assert rows(with_match(left, right, {"id": "ref"}, lambda a, b: b["v"] > 6)) == []


def test_filters(spark, rows):
    df = spark.createDataFrame([(1, "2024-01-01"), (2, "2023-12-31")], "id int, day string").withColumn(
        "ts", F.col("day").cast("timestamp_ntz")
    )
    assert rows(within_days(df, "ts", 30, "2024-01-31"), "id") == [(1,)]
    assert len(rows(only(df, "id", None))) == len(rows(only(df, "day", ""))) == 2
    assert rows(only(df, "id", 2), "id") == rows(flagged(df, id=2), "id") == [(2,)]
    labels = df.select(
        decode(F.col("id"), {1: "one"}).alias("a"),
        decode(F.col("id"), {1: "one"}, "other").alias("b"),
        first_match([(F.col("id") > 1, F.lit("big"))], F.lit("small")).alias("c"),
    )
    assert rows(labels) == [("one", "one", "small"), (None, "other", "big")]


def test_joins(spark, rows):
    base = spark.createDataFrame([(1,), (2,)], "id int")
    counts = spark.createDataFrame([(1, 4)], "id int, n long")
    assert rows(join_rollups(base, [counts], "id", ["n"])) == [(1, 4), (2, 0)]
    assert rows(lookup(base, counts, "id", "id", {"found": "n"})) == [(1, 4), (2, None)]
    assert len(rows(all_combinations(base, counts.select("n")))) == 2
    with pytest.raises(ValueError, match="more than max_rows"):
        all_combinations(base, base.withColumnRenamed("id", "other"), max_rows=3)
    lists = spark.createDataFrame([(1, [7, 8]), (2, [])], "id int, xs array<int>")
    assert rows(expand(lists, F.col("xs"), "x", place="at"), "id", "at", "x") == [(1, 0, 7), (1, 1, 8)]
    assert rows(expand(lists, F.col("xs"), "x", keep_empty=True), "id", "x") == [(1, 7), (1, 8), (2, None)]
    holders = spark.createDataFrame([(1, "h")], "res int, holder string")
    assert rows(waits_with_holder(base, holders, {"id": "res"}), "id", "holder") == [(1, "h"), (2, None)]


def test_sets(spark, rows):
    a = spark.createDataFrame([(1, None), (1, None)], "x int, y int")
    b = spark.createDataFrame([(None, 1)], "y int, x int").select("y", "x")
    assert len(rows(append_all(a, b))) == 3
    assert rows(union_distinct(a, a.select("y", "x"))) == [(1, None)]
    assert {r.source for r in union_sources({"p": a, "q": a}).collect()} == {"p", "q"}


def test_table_functions(spark, rows):
    people = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    staff = spark.createDataFrame([(1, "boss"), (1, "clerk")], "id long, title string")
    assert len(rows(contact_lookup(people, staff, "id", 1))) == 2
    assert rows(contact_lookup(people, staff, "id", 2)) == rows(contact_lookup(people, staff, "id", None)) == []
    assert rows(at_least(people, "id", 2, ["name"])) == [("b",)]
    filtered_view(people.withColumn("last", F.when(F.col("id") == 1, "x")), "v_people", ["id"], "last")
    assert rows(scan_named(spark, "v_people")) == [(1,)]
    assert rows(values(spark, [("a", 1)], "k string, n int")) == [("a", 1)]
    with pytest.raises(Exception):
        scan_named(spark, "v_people; DROP VIEW v_people").collect()
