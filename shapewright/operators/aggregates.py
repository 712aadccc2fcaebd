"""Nth values, ratios, modes, ordered lists and pivots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapewright.functions.numeric import safe_ratio
from shapewright.operators.numbering import HOT_ROWS, has_hot_group, number_in_groups
from shapewright.operators.ranking import top_rows
from shapewright.session import settle

MAX_ITEMS = 1_000_000  # items that may go into one text cell


def second_highest(df: DataFrame, value: str, name: str = "second_highest") -> DataFrame:
    """Largest value below the maximum. Always one row; NULL if there is none."""
    top = df.agg(F.max(value)).scalar()
    return df.filter(F.col(value) < top).agg(F.max(value).alias(name))


def nth_highest(df: DataFrame, value: str, n: int, name: str = "nth_highest") -> DataFrame:
    """Nth largest distinct value. Always one row; NULL if there are fewer values."""
    if n < 1:
        raise ValueError("n must be at least 1")
    values = df.select(F.col(value).alias(name)).distinct()
    return top_rows(values, F.col(name).desc(), 1, n - 1).agg(F.max(name).alias(name))


def parents_with_children(df: DataFrame, id_col: str, parent: str, at_least: int) -> DataFrame:
    """Rows that at least so many rows name as parent."""
    busy = df.groupBy(F.col(parent).alias("_parent_id")).count().filter(F.col("count") >= at_least)
    return df.join(busy.select("_parent_id"), df[id_col] == F.col("_parent_id"), "left_semi")


def pair_ratio(part: DataFrame, whole: DataFrame, part_keys: list[str], whole_keys: list[str], name: str = "ratio"):
    """Distinct pairs of one table over distinct pairs of another, two digits, 0 if the other is empty."""
    count = lambda df, keys: df.select(*keys).distinct().agg(F.count(F.lit(1)).alias("_whole"))
    top = count(part, part_keys).withColumnRenamed("_whole", "_part")
    return top.select(safe_ratio(F.col("_part"), count(whole, whole_keys).scalar()).alias(name))


def mode_per_group(df: DataFrame, by: list[str], value: str, name: str = "mode") -> DataFrame:
    """Most frequent value per group; the smallest value wins a tie. Counts are combined map-side."""
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    best = F.min(F.struct((-F.col("_n")).alias("_less"), F.col(value).alias("_value")))
    return counts.groupBy(*by).agg(best["_value"].alias(name))


def list_in_order(item: str, sep: str, order: str) -> Column:
    """Aggregate: the non-NULL items of a group as one text, in the order of an SQL expression."""
    quoted = sep.replace("\\", "\\\\").replace("'", "\\'")
    return F.expr(f"listagg(CAST(`{item}` AS STRING), '{quoted}') WITHIN GROUP (ORDER BY {order})")


def ordered_list(
    df: DataFrame,
    by: list[str],
    item: str,
    name: str = "items",
    sep: str = ",",
    trailing_sep: bool = False,
    max_items: int = MAX_ITEMS,
) -> DataFrame:
    """Items of a group as one text, in item order. NULL items are skipped; a group of NULLs gives NULL.

    The text is one cell, so the largest group is counted first and more than ``max_items`` is an
    error; ordered_list_parts takes groups of any size.
    """
    if has_hot_group(df, by, max_items):
        raise ValueError(f"a group has more than {max_items} rows; use ordered_list_parts")
    ordered = list_in_order(item, sep, f"CAST(`{item}` AS STRING)")
    return df.groupBy(*by).agg((F.concat(ordered, F.lit(sep)) if trailing_sep else ordered).alias(name))


def ordered_list_parts(
    df: DataFrame,
    by: list[str],
    item: str,
    order_by,
    per_part: int = 1000,
    name: str = "items",
    sep: str = ",",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Ordered list cut into numbered parts of ``per_part`` items, for groups of any size.

    Places in the group come from number_in_groups, so a group's items spread over (group, part)
    and no task holds a whole group. ``order_by`` must be unique within a group.
    """
    placed = number_in_groups(df.filter(F.col(item).isNotNull()), by, order_by, "_place", hot_rows=hot_rows)
    part = F.expr(f"(_place - 1) div {per_part} + 1").alias("part_no")
    text = list_in_order(item, sep, "_place")
    return placed.select(*by, item, "_place", part).groupBy(*by, "part_no").agg(text.alias(name))


def pivot_count(df: DataFrame, keys: list[str], column: str, headers: list) -> DataFrame:
    """COUNT of rows per key and header value; absent cells are 0."""
    return _spread(df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_rows")), keys, column, headers)


def pivot_dynamic(df: DataFrame, keys: list[str], column: str, rank: Column | None = None, cap: int = 1000) -> DataFrame:
    """pivot_count with the headers taken from the data, lowest ``rank`` first, then by name.

    The table is read once: headers and cells both come from the settled counts.
    """
    counts = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_rows"), F.min(_rank_or_zero(rank)).alias("_rank"))
    counts = settle(counts, "counts")
    return _spread(counts, keys, column, header_values(counts, column, F.col("_rank"), cap))


def _rank_or_zero(rank: Column | None) -> Column:
    return F.lit(0) if rank is None else rank


def _spread(counts: DataFrame, keys: list[str], column: str, headers: list) -> DataFrame:
    if not headers:
        return counts.select(*keys).distinct()
    cells = counts.groupBy(*keys).pivot(column, headers).agg(F.sum("_rows"))
    return cells.fillna(0, [c for c in cells.columns if c not in keys])


def header_values(df: DataFrame, column: str, rank: Column | None = None, cap: int = 1000) -> list:
    """Distinct non-NULL values that become column names, by lowest rank and name. More than ``cap`` is an error."""
    names = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.min(_rank_or_zero(rank)).alias("_rank"))
    found = [r[0] for r in names.orderBy("_rank", column).limit(cap + 1).collect()]
    if len(found) > cap:
        raise ValueError(f"{column} has more than {cap} values; they cannot all become columns")
    return found


def unpivot(df: DataFrame, keys: list[str], columns: list[str], names: str = "name", values: str = "value"):
    """One row per key and column; NULL cells are left out, as UNPIVOT does."""
    return df.unpivot(keys, columns, names, values).filter(F.col(values).isNotNull())


def group_stats(df: DataFrame, by: list[str], value: str, whole_avg: bool = False) -> DataFrame:
    """rows, mean and max per group. ``whole_avg`` cuts the mean's fraction off, as AVG of INT does in T-SQL."""
    mean = F.avg(value).cast("long") if whole_avg else F.avg(value)
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("rows"), mean.alias("mean"), F.max(value).alias("max"))
