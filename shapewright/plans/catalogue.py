"""Catalogue searches, subscriptions, key lists and reference lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapewright.functions.binary import bytes_to_text
from shapewright.functions.text import contains_text, fill_template, quote_name, text_length
from shapewright.operators.aggregates import list_in_order, mode_per_group, ordered_list_parts
from shapewright.operators.joins import expand, lookup
from shapewright.operators.numbering import HOT_ROWS, number_in_groups, number_rows
from shapewright.operators.ranking import sorted_if
from shapewright.operators.recursion import closure

# fixed values: the texts of the reference lines
PARENT_LINE = "-- The following are the child tables of: {parent}\n"
CHILD_LINE = "SELECT '{child}' AS [TABLE], * FROM {child_schema}.{child} WHERE {child_column} IN (@ToBeDELETED); \n"


def catalogue_search(
    items: DataFrame, sources: DataFrame, types: list, pattern: str, case_insensitive: bool = True, sort: bool = False
) -> DataFrame:
    """Items of the given types whose content holds a pattern, with their source and the source's own path.

    items: item_id, path, name, type, content (bytes); sources: item_id, source_name, link (an item
    id). The whole content is searched; it is dropped before the joins.
    """
    wanted = items.filter(F.col("type").isin(types) & (text_length(F.col("name")) != 0))
    found = wanted.filter(contains_text(bytes_to_text(F.col("content")), pattern, case_insensitive)).drop("content")
    linked = found.join(sources, "item_id", "left")
    return sorted_if(lookup(linked, items, "link", "item_id", {"source_path": "path"}), sort, "path", "name")


def subscriptions(
    subs: DataFrame, users: DataFrame, items: DataFrame, bridge: DataFrame, schedules: DataFrame, sort: bool = False
) -> DataFrame:
    """Subscriptions with owner, item and schedule.

    subs: item_id, subscription_id, owner_id and any others; users: owner_id, owner_name; items:
    item_id, item_name; bridge: item_id, subscription_id, schedule_id; schedules: schedule_id,
    schedule_name.
    """
    report = (
        subs.join(bridge, ["item_id", "subscription_id"])
        .join(users, "owner_id")
        .join(items, "item_id")
        .join(schedules, "schedule_id")
    )
    return sorted_if(report, sort, "schedule_name", "item_name")


def key_lists(
    columns: DataFrame,
    partitions: DataFrame,
    extras: DataFrame,
    per_part: int = 1000,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Per parent: ordered key columns with direction, included columns, most frequent setting, extra column.

    columns: parent, column_name, ordinal (unique in the parent), descending, included; partitions:
    parent, setting; extras: parent, extra. Lists come in parts of ``per_part`` names, part_no 1
    holding the first; a parent without any listed column does not appear. Both lists come from one
    pass over the columns.
    """
    direction = F.when(F.col("descending"), F.lit(" Desc")).otherwise(F.lit(" Asc"))
    name = quote_name(F.col("column_name"))
    named = columns.filter(F.col("column_name").isNotNull())
    placed = number_in_groups(named, ["parent", "included"], "ordinal", "_place", hot_rows=hot_rows)
    parts = placed.select(
        "parent",
        F.expr(f"(_place - 1) div {per_part} + 1").alias("part_no"),
        "_place",
        F.when(~F.col("included"), F.concat(name, direction)).alias("_key"),
        F.when(F.col("included"), name).alias("_other"),
    )
    both = parts.groupBy("parent", "part_no").agg(
        list_in_order("_key", ",", "_place").alias("key_columns"),
        list_in_order("_other", ",", "_place").alias("included_columns"),
    )
    main = mode_per_group(partitions, ["parent"], "setting", "main_setting")
    return both.join(main, "parent", "left").join(extras, "parent", "left")


def child_lines(edges: DataFrame, start=None, per_part: int = 1000, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Numbered parents with one lookup line per child, as blocks of text.

    edges: parent, child, child_schema, child_column. With ``start`` only parents reachable from it.
    A block holds up to ``per_part`` lines; the first one begins with the parent's heading.
    """
    parents = edges.select("parent").distinct() if start is None else closure(edges, "parent", "child", start, name="parent")
    numbered = number_rows(parents.select("parent"), "parent", "row_no")
    words = {c: F.col(c) for c in ("parent", "child", "child_schema", "child_column")}
    lines = edges.join(parents.select("parent"), "parent", "left_semi").withColumn(
        "shown", fill_template(CHILD_LINE, **words)
    )
    blocks = ordered_list_parts(
        lines, ["parent"], "shown", ["child", "child_column"], per_part, "lines", sep="", hot_rows=hot_rows
    )
    heading = F.when(F.col("part_no") == 1, fill_template(PARENT_LINE, parent=F.col("parent"))).otherwise(F.lit(""))
    return blocks.join(numbered, "parent").select(
        "row_no", "parent", "part_no", F.concat(heading, F.col("lines")).alias("block")
    )


def advice_expand(
    details: DataFrame, groups: DataFrame, stats: DataFrame, statement: str | None = None, sort: bool = False
) -> DataFrame:
    """Each suggestion expanded to its columns, with its group's figures.

    details: handle, statement, column_names (array); groups: handle, group_handle; stats:
    group_handle and any figures. A suggestion without columns gives no row.
    """
    wanted = details if statement is None else details.filter(contains_text(F.col("statement"), statement))
    rows = expand(wanted, F.col("column_names"), "column_name", place="column_id").drop("column_names")
    report = rows.join(groups, "handle").join(stats, "group_handle")
    return sorted_if(report, sort, "group_handle", "handle", "column_id")


def threshold_report(
    parts: DataFrame, names: DataFrame, keys: list[str], object_name: str, percent: str, above: float | None = None, sort: bool = False
) -> DataFrame:
    """An object's parts with a percentage, optionally only those above a threshold.

    names: the key columns, object_name, part_name.
    """
    chosen = names.filter(F.col("object_name") == object_name)
    found = parts if above is None else parts.filter(F.col(percent) > above)
    return sorted_if(found.join(chosen, keys).drop(*keys), sort, F.col(percent).desc())
