"""NULL replacement and casts that do not fail the job."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def or_default(col: Column, default) -> Column:
    """ISNULL / COALESCE with a literal."""
    return F.coalesce(col, F.lit(default))


def to_number(col: Column, kind: str = "decimal(18,2)") -> Column:
    """Text as a number; NULL where it is none."""
    return col.try_cast(kind)


def to_text(col: Column) -> Column:
    """Text of any width; a narrow VARCHAR would print * or cut it."""
    return col.cast("string")
