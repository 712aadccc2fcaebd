import bisect

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from shapewright.operators.aggregates import nth_highest, second_highest
from shapewright.operators.joins import rows_at_group_max
from shapewright.operators.numbering import (
    dense_rank_all,
    lag_lead,
    locate_in_ranges,
    ntile_in_groups,
    number_in_groups,
    number_rows,
)
from shapewright.operators import ranking
from shapewright.operators.ranking import latest_or_null, latest_per_key, top_per_group, top_rows


@pytest.fixture
def skewed(spark):
    """Group 0 holds most rows, value 5 most of them; some groups and values are NULL."""
    k = F.col("id")
    return spark.range(400).select(
        k,
        F.when(k % 3 != 0, 0).when(k % 31 == 0, None).otherwise(k % 7).alias("g"),
        F.when(k % 2 == 0, 5).when(k % 29 == 0, None).otherwise(k % 11).alias("v"),
    )


def test_nth_highest(spark, rows):
    pay = spark.createDataFrame([(1, 100), (2, 200), (3, 200), (4, None)], "id int, salary int")
    assert rows(second_highest(pay, "salary")) == rows(nth_highest(pay, "salary", 2)) == [(100,)]
    assert rows(nth_highest(pay, "salary", 1)) == [(200,)]
    assert rows(nth_highest(pay, "salary", 9)) == [(None,)]
    assert rows(nth_highest(pay, "salary", 20_000)) == [(None,)]
    for none in (pay.filter("id = 1"), pay.filter("id > 9"), pay.filter("id = 4")):
        assert rows(second_highest(none, "salary")) == [(None,)]
    with pytest.raises(ValueError):
        nth_highest(pay, "salary", 0)


def test_dense_rank_all_is_the_plain_window(skewed, rows):
    plain = skewed.select("id", F.dense_rank().over(Window.orderBy(F.col("v").desc())).cast("long").alias("rank"))
    assert rows(dense_rank_all(skewed, "v"), "id", "rank") == rows(plain)
    plain = skewed.select("id", F.dense_rank().over(Window.orderBy("v")).cast("long").alias("rank"))
    assert rows(dense_rank_all(skewed, "v", descending=False), "id", "rank") == rows(plain)


@pytest.mark.parametrize("k", [1, 2, 5])
@pytest.mark.parametrize("ties", ["rank", "dense_rank"])
def test_top_per_group_is_the_plain_window(skewed, rows, k, ties):
    w = Window.partitionBy("g").orderBy(F.col("v").desc())
    plain = skewed.withColumn("r", getattr(F, ties)().over(w).cast("long")).filter(F.col("r") <= k)
    assert rows(top_per_group(skewed, ["g"], "v", k, ties, "r"), "id", "r") == rows(plain, "id", "r")


def test_three_forms_of_top_per_group(spark, rows):
    pay = spark.createDataFrame(
        [(1, "a", 10), (1, "b", 10), (1, "c", 5), (2, "d", 7), (3, "e", None)], "dept int, name string, pay int"
    )
    ranked = top_per_group(pay, ["dept"], "pay").filter("pay IS NOT NULL")
    assert rows(ranked, "dept", "name") == rows(rows_at_group_max(pay, ["dept"], "pay"), "dept", "name")
    assert rows(ranked, "name") == [("a",), ("b",), ("d",)]


def test_group_name_against_group_id(spark, rows):
    """Two departments with one name are one group by name and two by id."""
    rowset = spark.createDataFrame([(1, "ops", 10), (2, "ops", 8)], "id int, name string, pay int")
    assert rows(top_per_group(rowset, ["name"], "pay"), "id") == [(1,)]
    assert rows(top_per_group(rowset, ["id"], "pay"), "id") == [(1,), (2,)]


@pytest.mark.parametrize("hot_rows", [3, 10**9])
def test_group_positions(skewed, rows, hot_rows):
    w = Window.partitionBy("g").orderBy(F.col("v").desc(), "id")
    order = [F.col("v").desc(), "id"]
    plain = skewed.select(
        "id",
        F.row_number().over(w).cast("long"),
        F.count("*").over(Window.partitionBy("g")),
        F.ntile(7).over(w).cast("long"),
        F.lag("id").over(w),
        F.lead("v").over(w),
    )
    numbered = number_in_groups(skewed, ["g"], order, "no", "size", hot_rows)
    tiled = ntile_in_groups(numbered, ["g"], order, 7, "tile", hot_rows)
    both = lag_lead(tiled, ["g"], order, {"before": "id"}, {"after": "v"}, hot_rows)
    assert rows(both, "id", "no", "size", "tile", "before", "after") == rows(plain)


@pytest.mark.parametrize("copies", [False, True])
def test_number_rows(spark, rows, monkeypatch, copies):
    monkeypatch.setattr("shapewright.operators.numbering.COPY_BLOCK", 4)
    df = spark.range(50).select((F.col("id") % 3).alias("a"), F.when(F.col("id") > 4, "x").alias("b"))
    numbered = number_rows(df, F.col("a").desc(), copies=copies)
    by_place = [r.a for r in numbered.orderBy("row_no").collect()]
    assert by_place == sorted(by_place, reverse=True)
    assert [r.row_no for r in numbered.orderBy("row_no").collect()] == list(range(1, 51))
    assert rows(numbered, "a", "b") == rows(df)


def test_number_rows_of_nothing(spark, rows):
    assert rows(number_rows(spark.range(0), "id")) == []


def test_latest_per_key(spark, rows):
    people = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    mails = spark.createDataFrame([(10, 1, "a"), (11, 1, "b"), (12, 2, "c"), (13, None, "d")], "mid int, pid int, mail string")
    order = F.col("mid").desc()
    assert rows(latest_or_null(people, mails, "id", "pid", order), "id", "mail") == [(1, "b"), (2, "c"), (3, None)]
    assert rows(latest_per_key(mails, ["pid"], order), "pid", "mail") == [(1, "b"), (2, "c"), (None, "d")]


def test_top_rows(spark, rows):
    df = spark.range(30)
    assert rows(top_rows(df, F.col("id").desc(), 2, 3)) == [(25,), (26,)]
    deep = top_rows(spark.range(11_000), F.col("id").desc(), 1, 10_500)
    assert rows(deep) == [(499,)]
    for n, skip in ((150, 30), (1000, 0), (1000, 1), (0, 5)):
        page = top_rows(spark.range(0, 3000, 1, 70), F.col("id").desc(), n, skip)
        assert sorted(r.id for r in page.collect()) == list(range(3000 - skip - n, 3000 - skip))
    with pytest.raises(ValueError):
        top_rows(df, "id", -1)


def test_top_rows_have_one_order_for_every_length(spark, monkeypatch):
    """Pages of any length are in order, and ties fall alike whichever way they are found."""
    df = spark.range(0, 5000, 1, 7).select((F.col("id") % 40).alias("k"), "id", F.lit(None).cast("string").alias("none"))
    order = [F.col("k").desc()]
    whole = [r["id"] for r in top_rows(df, order, 100).collect()]
    longer = [r["id"] for r in top_rows(df, order, 1500).collect()]
    monkeypatch.setattr(ranking, "ONE_TASK", 1000)
    deep = top_rows(df, order, 1500)
    assert longer[:100] == whole and [r["id"] for r in deep.collect()] == longer
    assert [r["id"] for r in top_rows(df, order, 50, 1400).collect()] == longer[1400:1450]
    assert [r["k"] for r in deep.collect()] == sorted((i % 40 for i in longer), reverse=True)


def test_lag_lead_over_slices(spark):
    """Slices, hot groups, null keys and single rows give what a window gives."""
    rows = [(None if i % 11 == 0 else i % 3 if i < 900 else i, i * 7919 % 1000, f"v{i}") for i in range(1000)]
    df = spark.createDataFrame(rows, "g int, o int, v string")
    got = {(r["g"], r["o"]): (r["before"], r["after"]) for r in lag_lead(df, ["g"], "o", {"before": "v"}, {"after": "v"}, hot_rows=10).collect()}
    want = {(r["g"], r["o"]): (r["before"], r["after"]) for r in lag_lead(df, ["g"], "o", {"before": "v"}, {"after": "v"}).collect()}
    assert got == want and len(got) == 1000


def test_locate_in_ranges(spark):
    bounds = [5, 5, None, 17, 18, 40, -3]
    keys = [None, -4, -3, 0, 4, 5, 16, 17, 18, 39, 40, 99] + [20] * 300
    df = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k long, `a b` int")
    marks = spark.createDataFrame([(b,) for b in bounds], "b long")
    got = {r["a b"]: r["range_no"] for r in locate_in_ranges(df, "k", marks, "b").collect()}
    cuts = sorted({b for b in bounds if b is not None})
    assert got == {i: None if k is None else 1 + sum(b <= k for b in cuts) for i, k in enumerate(keys)}
    assert {r["range_no"] for r in locate_in_ranges(df.filter("k > 0"), "k", marks.limit(0), "b").collect()} == {1}
    assert locate_in_ranges(df.limit(0), "k", marks, "b").collect() == []


def test_a_million_uneven_bounds(spark):
    bounds = spark.range(1_000_000).select((F.col("id") * F.col("id") % 1_000_003 * 4 + 1).alias("b"))
    cuts = sorted({i * i % 1_000_003 * 4 + 1 for i in range(1_000_000)})
    keys = [-5, 0, 1, 2, 4_000_000, 1_234_567, cuts[1000], cuts[1000] - 1, cuts[-1], cuts[-1] + 9]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r["k"]: r["range_no"] for r in locate_in_ranges(df, "k", bounds, "b").collect()}
    assert got == {k: 1 + bisect.bisect_right(cuts, k) for k in keys}
