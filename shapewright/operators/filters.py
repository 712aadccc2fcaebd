"""Decoding, optional and rolling filters, semi and anti joins."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapewright.functions.temporal import moment, shift


def decode(col: Column, labels: Mapping, default=None) -> Column:
    """Simple CASE: code to label; without a default an unknown code gives NULL."""
    out = F
    for code, label in labels.items():
        out = out.when(col == F.lit(code), F.lit(label))
    return out.otherwise(F.lit(default)) if default is not None else out


def first_match(rules: list[tuple[Column, object]], default=None) -> Column:
    """Searched CASE: the first rule that holds decides."""
    out = F
    for condition, result in rules:
        out = out.when(condition, result)
    return out.otherwise(default) if default is not None else out


def only(df: DataFrame, col: str, value=None) -> DataFrame:
    """Equality filter whose NULL or empty value means all rows; decided when the plan is built."""
    return df if value in (None, "") else df.filter(F.col(col) == F.lit(value))


def flagged(df: DataFrame, **flags) -> DataFrame:
    """Keeps rows whose flag columns have the given values, as enabled=1."""
    for col, value in flags.items():
        df = df.filter(F.col(col) == F.lit(value))
    return df


def within_days(df: DataFrame, ts: str, days: int, as_of: datetime | str | None = None) -> DataFrame:
    """Rows not older than ``days`` before ``as_of``; the bound is a constant the scan can use."""
    return df.filter(F.col(ts) >= shift(moment(as_of), "DAY", -days))


def _pairs(keys) -> list[tuple[str, str]]:
    keys = {keys: keys} if isinstance(keys, str) else keys
    return list(keys.items()) if isinstance(keys, Mapping) else [(k, k) for k in keys]


def _on(left: DataFrame, right: DataFrame, keys) -> Column:
    condition = None
    for a, b in _pairs(keys):
        same = left[a] == right[b]
        condition = same if condition is None else condition & same
    return condition


def _few_per_key(right: DataFrame, keys) -> DataFrame:
    """The right side's keys with few copies each: enough for a semi or anti join.

    A key held by a third of the rows shrinks before it is shuffled. A full distinct() would leave its
    own shuffle as the join's, and then Spark could not split a hot key of the left side at run time.
    """
    columns = [b for _, b in _pairs(keys)]
    return right.select(*columns, (F.spark_partition_id() % 8).alias("_copy")).distinct().select(*columns)


def with_match(left: DataFrame, right: DataFrame, keys, residual=None) -> DataFrame:
    """IN / EXISTS: left rows with a partner, once each. ``residual(left, right)`` may add a condition."""
    if residual:
        right = right.alias("_r")
        return left.join(right, _on(left, right, keys) & residual(left, right), "left_semi")
    right = _few_per_key(right, keys).alias("_r")
    return left.join(right, _on(left, right, keys), "left_semi")


def without_match(left: DataFrame, right: DataFrame, keys) -> DataFrame:
    """NOT EXISTS: left rows with no partner; a NULL key has none."""
    right = _few_per_key(right, keys).alias("_r")
    return left.join(right, _on(left, right, keys), "left_anti")
