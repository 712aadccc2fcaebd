"""Positions in a total order without a single-partition window.

Rows are range-partitioned and sorted, so each partition holds one contiguous slice of the order and
monotonically_increasing_id() gives (slice, place in slice). The slices are settled, their sizes are
summed up (one row per slice) and added to the local places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapewright.session import settle

SLICE_BITS = 33  # monotonically_increasing_id keeps the partition above, the row below this bit
COPY_BLOCK = 100_000  # copies of one row that are written out by one step
HOT_ROWS = 5_000_000  # a group above this is split over tasks instead of put in one window


def _columns(items) -> list[Column]:
    items = [items] if isinstance(items, (str, Column)) else items
    return [F.col(i) if isinstance(i, str) else i for i in items]


def number_rows(df: DataFrame, order_by, name: str = "row_no", copies: bool = False) -> DataFrame:
    """Adds ``name`` = 1, 2, 3 ... over the whole table in the given order.

    Ties are broken by a hash of the row, so the numbering is repeatable and the sort key, of which
    Spark samples some to the driver, stays as narrow as ``order_by``. Rows equal in every column
    sort into one slice; where such copies may be many, ``copies`` counts them before the sort and
    deals their numbers out afterwards.
    """
    if copies:
        return _number_copies(df, order_by, name)
    placed = _slices(df, order_by)
    sizes = placed.groupBy("_slice").agg(F.count(F.lit(1)).alias("_rows"))
    place = F.col("_at").bitwiseAND(F.lit((1 << SLICE_BITS) - 1))
    return placed.join(F.broadcast(_starts(sizes)), "_slice").select(
        *[F.col(f"`{c}`") for c in df.columns], (F.col("_start") + place + 1).alias(name)
    )


def _slices(df: DataFrame, order_by, but: tuple[str, ...] = ()) -> DataFrame:
    """The rows, settled, with their slice of the order (_slice) and a number that rises in it (_at)."""
    hashed = [f.name for f in df.schema.fields if f.name not in but and "map<" not in f.dataType.simpleString()]
    order = _columns(order_by) + [F.col("_tie")]
    tied = df.withColumn("_tie", F.xxhash64(*[F.col(f"`{c}`") for c in hashed]))
    sliced = tied.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
    placed = settle(sliced.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    return placed.withColumn("_slice", F.shiftright("_at", SLICE_BITS))


def _starts(sizes: DataFrame) -> DataFrame:
    """Rows before each slice. One row per slice, so window and broadcast are bounded by the partition count."""
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    return sizes.select("_slice", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_start"))


def _number_copies(df: DataFrame, order_by, name: str) -> DataFrame:
    counted = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    placed = _slices(counted, order_by, but=("_copies",))
    sizes = placed.groupBy("_slice").agg(F.sum("_copies").alias("_rows"))
    before = Window.partitionBy("_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_copies").over(before), F.lit(0))
    first = placed.withColumn("_inside", inside).join(F.broadcast(_starts(sizes)), "_slice")
    first = first.withColumn("_first", F.col("_start") + F.col("_inside") + 1)
    rows = [F.col(f"`{c}`") for c in df.columns]
    few = first.filter(F.col("_copies") <= COPY_BLOCK).select(
        *rows, F.explode(F.expr("sequence(_first, _first + _copies - 1)")).alias(name)
    )
    # a row held very often is first cut into blocks, which are spread before they are written out
    blocks = first.filter(F.col("_copies") > COPY_BLOCK).select(
        *rows,
        (F.col("_first") + F.col("_copies") - 1).alias("_last"),
        F.explode(F.expr(f"sequence(_first, _first + _copies - 1, {COPY_BLOCK})")).alias("_from"),
    )
    many = blocks.repartition("_from").select(
        *rows, F.explode(F.expr(f"sequence(_from, least(_last, _from + {COPY_BLOCK} - 1))")).alias(name)
    )
    return few.unionByName(many)


def dense_rank_all(df: DataFrame, value: str, name: str = "rank", descending: bool = True) -> DataFrame:
    """DENSE_RANK over the whole table; NULL ranks last when descending, first when ascending.

    Only the distinct values are ordered. They are found with map-side combine, so a value held by a
    third of the rows is one row here; the ranks then go back by an equi join on the value.
    """
    values = df.select(F.col(value).alias("_value")).distinct()
    order = F.col("_value").desc() if descending else F.col("_value").asc()
    ranks = number_rows(values, order, name)
    return df.join(ranks, df[value].eqNullSafe(ranks["_value"])).drop("_value")


def has_hot_group(df: DataFrame, by: list[str], hot_rows: int = HOT_ROWS) -> bool:
    """True if some group is too large for one task. One column-pruned, pre-aggregated count."""
    largest = df.groupBy(*by).count().agg(F.max("count")).first()[0]
    return (largest or 0) > hot_rows


def lag_lead(
    df: DataFrame,
    by: list[str],
    order_by,
    lag: dict[str, str] | None = None,
    lead: dict[str, str] | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Value of the row before (``lag``: {new column: source column}) and after (``lead``) per group.

    ``order_by`` must be unique within a group. Groups that fit a task use a window. With a hot group
    the rows are cut into slices of the order (by, order_by) instead, with windows inside the slices; what
    the first and last row of a slice lack comes from the slices beside it, one row each.
    """
    lag, lead = lag or {}, lead or {}
    if not has_hot_group(df, by, hot_rows):
        w = Window.partitionBy(*by).orderBy(*_columns(order_by))
        return df.select(
            "*",
            *[F.lag(src).over(w).alias(new) for new, src in lag.items()],
            *[F.lead(src).over(w).alias(new) for new, src in lead.items()],
        )
    placed = _slices(df, [*by, *_columns(order_by)])
    wanted = dict.fromkeys([*by, *lag.values(), *lead.values()])
    row = F.struct(*[F.col(f"`{c}`").alias(f"_{at}") for at, c in enumerate(wanted)])
    field = {c: f"_{at}" for at, c in enumerate(wanted)}
    edges = placed.groupBy("_slice").agg(F.min_by(row, "_at").alias("_first"), F.max_by(row, "_at").alias("_last"))
    beside = Window.orderBy("_slice")
    edges = edges.select("_slice", F.lag("_last").over(beside).alias("_above"), F.lead("_first").over(beside).alias("_below"))
    inside = Window.partitionBy("_slice").orderBy("_at")
    out = placed.join(F.broadcast(edges), "_slice").select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.coalesce(F.lag(row).over(inside), "_above").alias("_above"),
        F.coalesce(F.lead(row).over(inside), "_below").alias("_below"),
    )

    def taken(other: str, source: str) -> Column:
        same = F.col(other).isNotNull()
        for b in by:
            same = same & F.col(f"{other}.{field[b]}").eqNullSafe(F.col(f"`{b}`"))
        return F.when(same, F.col(f"{other}.{field[source]}"))

    return out.select(
        *[F.col(f"`{c}`") for c in df.columns],
        *[taken("_above", src).alias(new) for new, src in lag.items()],
        *[taken("_below", src).alias(new) for new, src in lead.items()],
    )


def locate_in_ranges(df: DataFrame, key: str, bounds: DataFrame, bound: str, name: str = "range_no") -> DataFrame:
    """Adds the number, from 1, of the range that ``key`` is in; a bound belongs to the range above it.

    ``bounds`` may be any number of rows; repeated and null bounds do not count. A null key has no range. Keys
    and bounds are sorted into slices together, the last bound is carried forward inside a slice, and each slice
    starts with the last bound of those before it. A key held by a third of all rows is split over slices.
    """
    known = bounds.select(F.col(bound).alias("_value")).filter("_value IS NOT NULL").distinct()
    known = number_rows(known, "_value", "_bound_no")
    columns = [F.col(f"`{c}`") for c in df.columns]
    rows = df.select(F.struct(*columns).alias("_row"), F.col(f"`{key}`").alias("_value"), F.lit(1).alias("_tag"), F.lit(None).cast("long").alias("_bound_no"))
    none = F.lit(None).cast(rows.schema["_row"].dataType)
    marks = known.select(none.alias("_row"), F.col("_value").cast(df.schema[key].dataType), F.lit(0).alias("_tag"), "_bound_no")
    placed = _slices(rows.unionByName(marks), ["_value", "_tag"], but=("_bound_no",))
    before = Window.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = placed.groupBy("_slice").agg(F.max("_bound_no").alias("_top")).select("_slice", F.max("_top").over(before).alias("_before"))
    inside = Window.partitionBy("_slice").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    passed = F.coalesce(F.max("_bound_no").over(inside), "_before", F.lit(0).cast("long"))
    located = placed.join(F.broadcast(starts), "_slice").select("_row", "_tag", F.when(F.col("_value").isNotNull(), passed + 1).alias("_no"))
    return located.filter("_tag = 1").select(*[F.col("_row").getField(c).alias(c) for c in df.columns], F.col("_no").alias(name))


def number_in_groups(
    df: DataFrame, by: list[str], order_by, name: str = "row_no", size: str | None = None, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """ROW_NUMBER per group and, if ``size`` is named, the group's row count.

    A hot group is numbered over the whole table first; its start is then found by an equi join on
    (group, block of row numbers), so no join task gets more than ``hot_rows`` rows of one group.
    """
    if not has_hot_group(df, by, hot_rows):
        w = Window.partitionBy(*by)
        out = df.withColumn(name, F.row_number().over(w.orderBy(*_columns(order_by))).cast("long"))
        return out.withColumn(size, F.count(F.lit(1)).over(w)) if size else out
    numbered = number_rows(df, [*by, *_columns(order_by)], "_no").withColumn("_block", F.expr(f"_no div {hot_rows}"))
    spans = numbered.groupBy(*by).agg(
        F.min("_no").alias("_first"), F.max("_no").alias("_last"), F.count(F.lit(1)).alias("_size")
    )
    blocks = spans.select(
        *[F.col(b).alias(f"_by_{b}") for b in by],
        "_first",
        "_size",
        F.explode(F.expr(f"sequence(_first div {hot_rows}, _last div {hot_rows})")).alias("_blk"),
    )
    same = numbered["_block"] == blocks["_blk"]
    for b in by:
        same = same & numbered[b].eqNullSafe(blocks[f"_by_{b}"])
    out = numbered.join(blocks, same).select(
        *[numbered[c] for c in df.columns],
        (F.col("_no") - F.col("_first") + 1).alias(name),
        *([F.col("_size").alias(size)] if size else []),
    )
    return out


def ntile_in_groups(
    df: DataFrame, by: list[str], order_by, tiles: int, name: str = "tile", hot_rows: int = HOT_ROWS
) -> DataFrame:
    """NTILE(tiles) per group: the first (size mod tiles) tiles are one row longer."""
    placed = number_in_groups(df, by, order_by, "_place", "_group_size", hot_rows)
    short = f"(_group_size div {tiles})"
    longer = f"(_group_size % {tiles})"
    tile = F.expr(
        f"CASE WHEN _place <= {longer} * ({short} + 1) THEN (_place - 1) div ({short} + 1)"
        f" ELSE {longer} + (_place - 1 - {longer} * ({short} + 1)) div greatest({short}, 1) END"
    )
    return placed.withColumn(name, (tile + 1).cast("long")).drop("_place", "_group_size")
