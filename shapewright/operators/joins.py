"""Self joins, lookups and joins with branches that are aggregated first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapewright.operators.filters import _on, _pairs


def values_in_runs(df: DataFrame, id_col: str, value: Column, length: int = 3, name: str = "value") -> DataFrame:
    """Distinct values equal on ``length`` adjacent ids. Adjacent means id + 1, so a gap breaks a run.

    The shifts are equi joins on a computed id. Every join is on the first row's id, so the first
    side is shuffled once and keeps its place.
    """
    rows = df.select(F.col(id_col).alias("_id"), value.alias(name))
    out = rows
    for step in range(1, length):
        later = rows.select((F.col("_id") - step).alias("_id"), F.col(name).alias(f"_v{step}"))
        out = out.join(later, "_id").filter(F.col(name) == F.col(f"_v{step}")).drop(f"_v{step}")
    return out.select(name).distinct()


def child_above_parent(df: DataFrame, id_col: str, parent: str, value: str, form: str = "join") -> DataFrame:
    """Rows whose value is above their parent row's.

    ``form='join'`` repeats a row for each parent row with that id, ``'exists'`` gives it once.
    """
    above = df.select(F.col(id_col).alias("_parent_id"), F.col(value).alias("_parent_value"))
    on = (df[parent] == above["_parent_id"]) & (df[value] > above["_parent_value"])
    if form == "exists":
        return df.join(above, on, "left_semi")
    return df.join(above, on).drop("_parent_id", "_parent_value")


def rows_at_group_max(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """Rows at their group's maximum, by joining back on (group, maximum); all ties stay."""
    best = df.groupBy(*by).agg(F.max(value).alias(value))
    return df.join(best, [*by, value])


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, columns: dict[str, str]) -> DataFrame:
    """Adds columns of a dimension ({new name: dimension column}); an unknown key gives NULL.

    Spark broadcasts the dimension when its measured size allows and shuffles otherwise.
    """
    picked = dim.select(F.col(dim_key).alias("_key"), *[F.col(c).alias(n) for n, c in columns.items()])
    return df.join(picked, df[key] == picked["_key"], "left").drop("_key")


def join_rollups(base: DataFrame, rollups: list[DataFrame], keys, zero: list[str] = ()) -> DataFrame:
    """Left-joins branches that hold one row per key, then sets the named columns to 0 where missing."""
    for rollup in rollups:
        on = _on(base, rollup, keys)
        base = base.join(rollup, on, "left").drop(*[rollup[b] for _, b in _pairs(keys)])
    return base.fillna(0, list(zero)) if zero else base


def expand(df: DataFrame, items: Column, name: str, place: str | None = None, keep_empty: bool = False) -> DataFrame:
    """One row per array item (cross apply); ``keep_empty`` keeps rows without items (outer apply)."""
    if place:
        generate = F.posexplode_outer if keep_empty else F.posexplode
        return df.select("*", generate(items).alias(place, name))
    generate = F.explode_outer if keep_empty else F.explode
    return df.select("*", generate(items).alias(name))


def all_combinations(left: DataFrame, right: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """Every pair of two small domains, such as the cells of a report grid.

    Both are counted first; a product above ``max_rows`` is an error. The counted right side then goes
    to the left rows as one array, so no join without a key is planned.
    """
    n_left, n_right = left.limit(max_rows + 1).count(), right.limit(max_rows + 1).count()
    if n_left * n_right > max_rows:
        raise ValueError(f"{n_left} x {n_right} rows is more than max_rows={max_rows}")
    domain = right.agg(F.collect_list(F.struct(*right.columns))).scalar()
    return left.withColumn("_domain", domain).select(*left.columns, F.inline("_domain"))


def waits_with_holder(waits: DataFrame, holders: DataFrame, resource, keep_free: bool = True) -> DataFrame:
    """Each waiting row with the rows that hold its resource; holder columns must have their own names."""
    return waits.join(holders, _on(waits, holders, resource), "left" if keep_free else "inner")
