"""Integer division, scaling, rounding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def int_divide(left: Column, right: Column | int) -> Column:
    """Integer division that truncates toward zero, as INT / INT does in T-SQL."""
    right = F.lit(right) if isinstance(right, int) else right
    return F.call_function("div", left, right)


def safe_ratio(left: Column, right: Column, digits: int = 2) -> Column:
    """Rounded ratio; 0 when the divisor is 0 or missing."""
    return F.round(F.coalesce(F.try_divide(left.cast("double"), right.cast("double")), F.lit(0.0)), digits)


def pages_to_mb(pages: Column) -> Column:
    """8 KB pages as MB."""
    return pages / F.lit(128.0)


def bytes_to_mb(size: Column) -> Column:
    return size / F.lit(1024.0) / F.lit(1024.0)


def minutes_from_ms(ms: Column) -> Column:
    """Milliseconds as minutes with two digits, half up, in exact decimals."""
    return (ms.cast("decimal(20,0)") / F.lit(60000).cast("decimal(5,0)")).cast("decimal(10,2)")


def key_limit(bits: int) -> Column:
    """Largest value of a signed integer of that width."""
    return F.lit(2 ** (bits - 1) - 1).cast("long")


def share_used(current: Column, limit: Column) -> Column:
    """Part of a key range that is used up; a negative key is counted from the far end."""
    current = current.cast("double")
    limit = limit.cast("double")
    return F.when(current < 0, (limit + current) / limit).otherwise(current / limit)


def whole_mean(col: Column) -> Column:
    """AVG of an integer column with the fraction cut off."""
    return F.avg(col).cast("long")
