"""Appending tables and removing duplicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def append_all(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(DataFrame.unionByName, frames)


def union_distinct(*frames: DataFrame) -> DataFrame:
    """UNION: duplicates are removed inside and across the branches, NULLs being equal."""
    return append_all(*frames).distinct()


def union_sources(sources: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """The same rows from several places in one plan, each tagged with its place."""
    return append_all(*[df.withColumn(tag, F.lit(name)) for name, df in sources.items()])
