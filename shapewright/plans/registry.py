"""Named queries: a function of (spark, folder) and, where SQL can state it, the same query as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DecimalType, StructType

from shapewright.sources.tables import scan

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


_schemas: dict[str, StructType] = {}


class Tables:
    """The tables of one folder, read on first use: t.orders, t.events ...

    A table's footers are read for its schema once per process, not once per query.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        place = f"{self.folder}/{name}"
        table = scan(self.spark, self.folder, name, _schemas.get(place))
        _schemas.setdefault(place, table.schema)
        setattr(self, name, table)
        return table


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and bytes as hexadecimal text, which every engine's client shows alike."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    changed = {n: F.col(f"`{n}`").cast("double") for n, k in kinds.items() if isinstance(k, DecimalType)}
    changed |= {n: F.hex(F.col(f"`{n}`")) for n, k in kinds.items() if isinstance(k, BinaryType)}
    return df.withColumns(changed) if changed else df


def query(sql: str | None = None, name: str | None = None):
    """Registers fn(tables) under its own name or the given one."""

    def register(fn: Callable[[Tables], DataFrame]):
        key = name or fn.__name__
        QUERIES[key] = lambda spark, folder: _plain(fn(Tables(spark, folder)))
        if sql is not None:
            ORACLES[key] = sql
        return fn

    return register
