"""Top rows per group, latest row per key, and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapewright.operators.numbering import SLICE_BITS, _columns, number_rows

FEW_ROWS = 100  # up to here an ordered limit lets every task send its first rows to one task
ONE_TASK = 100_000  # rows up to which one task puts the page in order
BUCKETS = 64


def top_per_group(df: DataFrame, by: list[str], value: str, k: int = 1, ties: str = "rank", name: str | None = None):
    """Rows whose RANK (or ``ties='dense_rank'``) of ``value``, highest first, is at most k in the group.

    The best value of a group is a plain maximum. For k > 1 ranks are worked out on (group, value)
    levels, counted with map-side combine and cut to k levels per group before they are shuffled by
    group. Copies of a top value therefore never meet in one task: the rows themselves are only
    filtered by an equi join with the few levels that are kept.
    """
    groups = [F.col(b).alias(f"_by_{b}") for b in by]
    if k == 1:
        kept = df.groupBy(*groups).agg(F.max(value).alias("_value"))
        rank = F.lit(1).cast("long")
    else:
        levels = df.groupBy(*groups, F.col(value).alias("_value")).agg(F.count(F.lit(1)).alias("_rows"))
        w = Window.partitionBy(*[f"_by_{b}" for b in by]).orderBy(F.col("_value").desc())
        kept = levels.withColumn("_level", F.row_number().over(w)).filter(F.col("_level") <= k)
        rank = F.col("_level").cast("long")
        if ties == "rank":
            above = F.sum("_rows").over(w.rowsBetween(Window.unboundedPreceding, -1))
            kept = kept.withColumn("_rank", F.coalesce(above, F.lit(0)) + 1).filter(F.col("_rank") <= k)
            rank = F.col("_rank")
    kept = kept.select(*[f"_by_{b}" for b in by], "_value", rank.alias(name or "_rank"))
    same = df[value].eqNullSafe(kept["_value"])
    for b in by:
        same = same & df[b].eqNullSafe(kept[f"_by_{b}"])
    out = df.join(kept, same).drop("_value", *[f"_by_{b}" for b in by])
    return out if name else out.drop("_rank")


def latest_per_key(df: DataFrame, key: list[str], order_by) -> DataFrame:
    """The first row of each key in the given order, which must be total within a key.

    The row_number filter is pushed below the shuffle as a group limit: each task sends at most one
    row of a key on, however many rows the key has.
    """
    w = Window.partitionBy(*key).orderBy(*_columns(order_by))
    return df.withColumn("_place", F.row_number().over(w)).filter(F.col("_place") == 1).drop("_place")


def latest_or_null(parents: DataFrame, children: DataFrame, key: str, child_key: str, order_by) -> DataFrame:
    """Each parent with its latest child; parents without one keep NULLs (outer apply of top 1)."""
    latest = latest_per_key(children, [child_key], order_by)
    return parents.join(latest, parents[key] == latest[child_key], "left").drop(latest[child_key])


def top_rows(df: DataFrame, order_by, n: int, skip: int = 0) -> DataFrame:
    """ORDER BY with LIMIT n OFFSET skip; the order must be given. Ties are in order of a hash of the row.

    The result is in order, for any n. Up to ``FEW_ROWS`` a plain ordered limit is taken, which gathers skip + n rows
    of every task in one task. Beyond, each task sorts what it has and lets only its first skip + n rows
    pass, first where the rows are, then once more in ``BUCKETS``; so rows beyond the page are not moved. If
    it is too long for one task, the rest is numbered and sorted over ranges.
    """
    if n < 0 or skip < 0:
        raise ValueError("n and skip must not be negative")
    hashed = [F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()]
    order = [*_columns(order_by), F.xxhash64(*hashed)]
    last = skip + n
    if last > FEW_ROWS:
        df = _first_of_tasks(df, order, last)
        df = _first_of_tasks(df.repartition(BUCKETS, F.xxhash64(*hashed)), order, last)
    if last > ONE_TASK:
        numbered = number_rows(df, order, "_no").filter(F.col("_no").between(skip + 1, last))
        return numbered.orderBy("_no").drop("_no")
    ordered = df.orderBy(*order)
    return (ordered.offset(skip) if skip else ordered).limit(n)


def _first_of_tasks(df: DataFrame, order, last: int) -> DataFrame:
    """The first ``last`` rows of each partition in the given order."""
    placed = df.sortWithinPartitions(*order).withColumn("_place", F.monotonically_increasing_id())
    place = F.col("_place").bitwiseAND(F.lit((1 << SLICE_BITS) - 1))
    return placed.filter(place < last).drop("_place")


def sorted_if(df: DataFrame, sort: bool, *order_by) -> DataFrame:
    """The final order of a report. A total sort is a shuffle of its own, so it is only done when asked for."""
    return df.orderBy(*order_by) if sort else df
