"""Key ranges, range partitions and space."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapewright.functions.numeric import key_limit, pages_to_mb, share_used
from shapewright.operators.numbering import locate_in_ranges, number_rows
from shapewright.operators.ranking import sorted_if
from shapewright.operators.sets import append_all
from shapewright.session import settle

KEY_BITS = {"tinyint": 8, "smallint": 16, "int": 32, "bigint": 64}  # fixed values
SPLIT_HEADROOM = 8_000_000  # fixed value: below this many free ids a range is to be split
MAX_BOUNDS = 15_000


def keyspace_used(
    keys: dict[str, tuple[DataFrame, str]], at_least: float = 0.8, key_type: str | None = None, sort: bool = False
) -> DataFrame:
    """Part of each table's integer key range that is used, from its largest key, filtered.

    keys: {table name: (table, key column)}. ``key_type`` sets the range where the stored type is
    wider than the key's. Tables without keys are left out.
    """
    branches = []
    for name, (df, column) in keys.items():
        kind = key_type or df.schema[column].dataType.simpleString()
        top = df.agg(F.max(column).cast("long").alias("current_value")).filter(F.col("current_value").isNotNull())
        branches.append(
            top.select(
                F.lit(name).alias("table_name"),
                F.lit(column).alias("column_name"),
                F.lit(kind).alias("data_type"),
                "current_value",
                key_limit(KEY_BITS[kind]).alias("max_value"),
            )
        )
    used = append_all(*branches).withColumn("share_used", share_used(F.col("current_value"), F.col("max_value")))
    return sorted_if(used.filter(F.col("share_used") >= at_least), sort, F.col("share_used").desc())


def range_ordinal(value: Column, bounds: list[int]) -> Column:
    """Number, from 1, of the range a value is in; a bound belongs to the range above it.

    A binary search over the sorted bounds inside the expression, so no join is needed.
    """
    if len(bounds) > MAX_BOUNDS:
        raise ValueError(f"more than {MAX_BOUNDS} bounds; use equally spaced ranges")
    bounds = sorted(bounds)
    steps = [1 << b for b in range(len(bounds).bit_length() - 1, -1, -1)]
    held = F.expr("array(" + ",".join(f"{b}L" for b in bounds) + ")")
    passed = F.aggregate(
        F.array(*[F.lit(s) for s in steps]),
        F.lit(0),
        lambda at, step: F.when(
            (at + step <= len(bounds)) & (F.get(held, at + step - 1) <= value), at + step
        ).otherwise(at),
    )
    return F.when(value.isNotNull(), passed + 1)


def _between_many(df: DataFrame, key: str, bounds: DataFrame, headroom: int) -> DataFrame:
    """The report of ``range_partitions`` for a table of bounds. Keys are counted first, so a repeated key moves once."""
    keys = df.select(F.col(key).cast("long").alias("_key")).filter("_key IS NOT NULL").groupBy("_key").agg(F.count(F.lit(1)).alias("_n"))
    bounds = settle(bounds.select(F.col(bounds.columns[0]).cast("long").alias("_bound")).filter("_bound IS NOT NULL").distinct(), "bounds")
    located = locate_in_ranges(keys, "_key", bounds, "_bound", "_no")
    counts = settle(located.groupBy("_no").agg(F.sum("_n").alias("_rows"), F.max("_key").alias("_top")), "ranges")
    top_key = counts.agg(F.max("_top")).first()[0]
    top_bound, many = bounds.agg(F.max("_bound"), F.count(F.lit(1))).first()
    numbered = number_rows(bounds, "_bound", "_at")
    upper = numbered.select(F.col("_at").alias("range_no"), F.col("_bound").alias("upper_bound"))
    lower = numbered.select((F.col("_at") + 1).alias("range_no"), F.col("_bound").alias("lower_bound"))
    ranges = df.sparkSession.range(1, many + 2).withColumnRenamed("id", "range_no").join(lower, "range_no", "left").join(upper, "range_no", "left")
    left = None if top_key is None or top_bound is None else top_bound - top_key
    return ranges.join(counts, ranges["range_no"] == counts["_no"], "left").select(
        "range_no",
        "lower_bound",
        "upper_bound",
        F.coalesce("_rows", F.lit(0)).alias("rows"),
        F.col("upper_bound").isNull().alias("is_open"),
        F.lit(top_key).cast("long").alias("max_key"),
        F.lit(left).cast("long").alias("headroom"),
        (F.lit(left).cast("long") < headroom).alias("needs_split"),
    )


def range_partitions(
    df: DataFrame, key: str, bounds: list[int] | DataFrame | None = None, every: int | None = None, headroom: int = SPLIT_HEADROOM
) -> DataFrame:
    """Ranges of a key with their bounds and rows, and whether the last range is to be split.

    Either ``bounds``, a list or a table of one column with any number of them, or equally spaced ones ``every``
    so many keys from 0 up to the largest key. The lower bound is inclusive; the first range has no lower and the last no upper bound. Only
    the ordinal and its count are shuffled; the ranges join on the ordinal.
    """
    spark = df.sparkSession
    if isinstance(bounds, list) and len(bounds) > MAX_BOUNDS:
        bounds = spark.createDataFrame([(b,) for b in bounds], "bound long")
    if isinstance(bounds, DataFrame):
        return _between_many(df, key, bounds, headroom)
    if every:
        ordinal = F.expr(f"CASE WHEN `{key}` < 0 THEN 1 ELSE `{key}` div {every} + 1 END")
    else:
        bounds = sorted(bounds)
        ordinal = range_ordinal(F.col(key), bounds)
    # one pass over the table; everything else is read from the counts
    counts = settle(
        df.select(ordinal.cast("long").alias("_no"), F.col(key).cast("long").alias("_key"))
        .filter(F.col("_no").isNotNull())
        .groupBy("_no")
        .agg(F.count(F.lit(1)).alias("_rows"), F.max("_key").alias("_top")),
        "ranges",
    )
    top_key = counts.agg(F.max("_top")).first()[0]
    if every:
        last = max(top_key // every, 0) if top_key is not None else 0
        top_bound = last * every if last else None
        ranges = spark.range(1, last + 2).select(
            F.col("id").alias("range_no"),
            F.when(F.col("id") > 1, (F.col("id") - 1) * every).alias("lower_bound"),
            F.when(F.col("id") <= last, F.col("id") * every).alias("upper_bound"),
        )
    else:
        top_bound = bounds[-1] if bounds else None
        rows = list(zip(range(1, len(bounds) + 2), [None, *bounds], [*bounds, None]))
        ranges = spark.createDataFrame(rows, "range_no long, lower_bound long, upper_bound long")
    left = None if top_key is None or top_bound is None else top_bound - top_key
    return ranges.join(counts, ranges["range_no"] == counts["_no"], "left").select(
        "range_no",
        "lower_bound",
        "upper_bound",
        F.coalesce("_rows", F.lit(0)).alias("rows"),
        F.col("upper_bound").isNull().alias("is_open"),
        F.lit(top_key).cast("long").alias("max_key"),
        F.lit(left).cast("long").alias("headroom"),
        (F.lit(left).cast("long") < headroom).alias("needs_split"),
    )


def space_report(files: DataFrame, sort: bool = False) -> DataFrame:
    """Allocated and used MB per file from 8 KB pages. files: file_name, group_id, pages, used_pages."""
    mb = lambda c: pages_to_mb(F.col(c)).cast("decimal(14,2)")
    report = files.select(
        F.rtrim("file_name").alias("file_name"), "group_id", mb("pages").alias("allocated_mb"), mb("used_pages").alias("used_mb")
    )
    return sorted_if(report, sort, F.col("group_id").desc())


def space_totals(files: DataFrame, by: str) -> DataFrame:
    """Total MB and TB per group of files."""
    total = F.sum(F.col("pages").cast("long"))
    return files.groupBy(by).agg(
        pages_to_mb(total).alias("total_mb"), (pages_to_mb(total) / F.lit(1048576.0)).alias("total_tb")
    )
