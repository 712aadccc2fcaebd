"""Functions that return tables, and views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def contact_lookup(people: DataFrame, staff: DataFrame, key: str, wanted: int | None, kind: str = "Employee"):
    """The person's row joined to the staff row, labelled; no rows for a NULL id or a person not on the staff."""
    person = people.filter(F.col(key) == F.lit(wanted).cast("long"))
    member = staff.filter(F.col(key) == F.lit(wanted).cast("long"))
    return person.join(member, key).withColumn("kind", F.lit(kind))


def at_least(df: DataFrame, column: str, bound, columns: list[str]) -> DataFrame:
    """Selected columns of the rows at or above a bound."""
    return df.filter(F.col(column) >= F.lit(bound)).select(*columns)


def filtered_view(df: DataFrame, name: str, columns: list[str], not_null: str) -> DataFrame:
    """Registers a projection without the rows where a column is NULL as a temporary view."""
    df.filter(F.col(not_null).isNotNull()).select(*columns).createOrReplaceTempView(name)
    return df.sparkSession.table(name)
