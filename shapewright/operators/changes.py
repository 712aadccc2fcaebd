"""Change rows between snapshots or from a feed, and updates as new table versions."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shapewright.functions.binary import xml_has, xml_insert_first
from shapewright.functions.temporal import moment
from shapewright.operators.numbering import number_rows
from shapewright.operators.ranking import latest_per_key

INSERTED, UPDATED, DELETED = 1, 2, 3


def history(
    before: DataFrame,
    after: DataFrame,
    key: str,
    watch: list[str],
    stamp: str | None = None,
    as_of: datetime | str | None = None,
) -> DataFrame:
    """Change rows between two snapshots with a unique key: history_type, then the table's columns.

    Inserts and updates carry the new image, deletes the old one. An update counts only if a watched
    column has another value. ``stamp`` is set to ``as_of``. One shuffle of each side, by the key.
    """
    names = after.columns
    old = before.select(*[F.col(c).alias(f"_old_{c}") for c in names])
    both = old.join(after, old[f"_old_{key}"] == after[key], "full")
    changed = F.lit(False)
    for c in watch:
        changed = changed | ~F.col(c).eqNullSafe(F.col(f"_old_{c}"))
    kind = (
        F.when(F.col(f"_old_{key}").isNull(), F.lit(INSERTED))
        .when(F.col(key).isNull(), F.lit(DELETED))
        .when(changed, F.lit(UPDATED))
    )
    rows = both.withColumn("history_type", kind).filter(F.col("history_type").isNotNull())
    deleted = F.col("history_type") == DELETED
    images = [F.when(deleted, F.col(f"_old_{c}")).otherwise(F.col(c)).alias(c) for c in names]
    out = rows.select("history_type", *images)
    return out.withColumn(stamp, moment(as_of)) if stamp else out


def history_from_feed(
    feed: DataFrame, op: str, watched: str | None = None, stamp: str | None = None, as_of: datetime | str | None = None
) -> DataFrame:
    """The same change rows from a feed whose ``op`` is insert, update or delete. Works on streams too.

    ``watched`` names a boolean column: updates that assigned no watched column are dropped.
    """
    kind = (
        F.when(F.col(op) == "insert", F.lit(INSERTED))
        .when(F.col(op) == "update", F.lit(UPDATED))
        .when(F.col(op) == "delete", F.lit(DELETED))
    )
    rows = feed.withColumn("history_type", kind).filter(F.col("history_type").isNotNull())
    if watched:
        rows = rows.filter((F.col("history_type") != UPDATED) | F.col(watched))
    keep = [c for c in feed.columns if c not in (op, watched)]
    out = rows.select("history_type", *keep)
    return out.withColumn(stamp, moment(as_of)) if stamp else out


def history_schema(df: DataFrame) -> T.StructType:
    """history_id, history_type and all columns of the table, in order."""
    lead = [T.StructField("history_id", T.LongType(), False), T.StructField("history_type", T.IntegerType(), False)]
    return T.StructType(lead + list(df.schema.fields))


def append_history(log: DataFrame, changes: DataFrame, order_by) -> DataFrame:
    """The history table's next version: new rows get ids that follow on the last one."""
    last = log.agg(F.coalesce(F.max("history_id"), F.lit(0)).alias("_last")).scalar()
    numbered = number_rows(changes, order_by, "_no").withColumn("history_id", F.col("_no") + last).drop("_no")
    return log.unionByName(numbered.select(*log.columns))


def apply_update(
    target: DataFrame, changes: DataFrame, key: str, columns: Mapping[str, str], order_by=None
) -> DataFrame:
    """Sets ``columns`` ({target column: change column}) on the rows a change names.

    Of several changes to a key the latest by ``order_by`` counts. A changed value may be NULL.
    """
    if order_by is not None:
        changes = latest_per_key(changes, [key], order_by)
    new = changes.select(
        F.col(key).alias("_key"), F.lit(True).alias("_hit"), *[F.col(c).alias(f"_new_{t}") for t, c in columns.items()]
    )
    joined = target.join(new, target[key] == new["_key"], "left")
    hit = F.col("_hit").isNotNull()
    return joined.select(
        *[
            F.when(hit, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in target.columns
        ]
    )


def upsert(target: DataFrame, source: DataFrame, key: str) -> DataFrame:
    """Rows of both tables; where both have the key (unique in each) the source's row is taken."""
    new = source.select(*[F.col(c).alias(f"_new_{c}") for c in target.columns])
    joined = target.join(new, target[key] == new[f"_new_{key}"], "full")
    from_source = F.col(f"_new_{key}").isNotNull()
    return joined.select(
        *[F.when(from_source, F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) for c in target.columns]
    )


def set_from_rules(df: DataFrame, column: str, value: Column) -> DataFrame:
    """Overwrites a column from an expression, usually a searched CASE."""
    return df.withColumn(column, value)


def qualify(df: DataFrame, column: str, names: DataFrame, full_name: str, sep: str = ".") -> DataFrame:
    """Replaces a bare name by the qualified one that ends in it, from a small table of names."""
    full = names.select(
        F.col(full_name).alias("_full"), F.substring_index(F.col(full_name), sep, -1).alias("_bare")
    ).distinct()
    return df.join(full, df[column] == full["_bare"], "left").select(
        *[F.coalesce("_full", F.col(c)).alias(c) if c == column else df[c] for c in df.columns]
    )


def shift_keys(df: DataFrame, key: str, low: int, high: int, by: int) -> DataFrame:
    """Adds ``by`` to the keys from ``low`` to ``high``; the others stay."""
    moved = F.when(F.col(key).between(low, high), F.col(key) + by).otherwise(F.col(key))
    return df.withColumn(key, moved)


def fill_on_change(changes: DataFrame, doc: str, root: str, element: str, default: str) -> DataFrame:
    """New or changed rows: a NULL document becomes the default one, a document without the element
    gets it first in its root. Text that is no XML is left alone; quarantine it."""
    whole = f"<{root}>{default}</{root}>"
    lacks = ~xml_has(F.col(doc), f"/{root}/{element}") & xml_has(F.col(doc), f"/{root}")
    filled = (
        F.when(F.col(doc).isNull(), F.lit(whole))
        .when(lacks, xml_insert_first(F.col(doc), root, default))
        .otherwise(F.col(doc))
    )
    return changes.withColumn(doc, filled)


def check_rows(df: DataFrame, checks: Mapping[str, Column], reason: str = "error") -> DataFrame:
    """Adds the first failed check's name, NULL for good rows. A check that is NULL has failed."""
    failed = F.coalesce(
        *[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()], F.lit(None).cast("string")
    )
    return df.withColumn(reason, failed)


def quarantine(df: DataFrame, checks: Mapping[str, Column], reason: str = "error") -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows with the reason); work goes on with the good ones."""
    checked = check_rows(df, checks, reason)
    return checked.filter(F.col(reason).isNull()).drop(reason), checked.filter(F.col(reason).isNotNull())
