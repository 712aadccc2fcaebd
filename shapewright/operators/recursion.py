"""Trees and graphs held as edge tables.

Where every id has one row, ancestors are found by pointer doubling: each step joins every row's pointer with
the pointer of the row it points to, so the distance covered doubles and a tree of any depth takes log2(depth)
joins. Other graphs are walked level by level, one join of the frontier with the edges each. Steps are settled,
so the plan of a step does not contain those before it, and a lost executor costs one step at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapewright.operators.sets import append_all
from shapewright.session import settle

MAX_DEPTH = 1000


def _walk(df, is_top: Column, id_col: str, parent: str, needs: list[str], carry: dict, max_depth: int) -> DataFrame:
    """Rows reachable from the top rows, with their level and carried values.

    ``carry`` is {new column: (value of a top row, value from the parent's _up_<column>)}, made from
    the columns in ``needs``. The walk itself moves only ids and carried values; the rows are joined
    to the visited ids once at the end.
    """
    narrow = df.select(*dict.fromkeys([id_col, parent, *needs]))
    step = lambda rows, at, level: rows.select(
        F.col(id_col).alias("_up_id"), level.alias("_up_level"), *[made[at].alias(f"_up_{c}") for c, made in carry.items()]
    )
    level = (F.col("_up_level") + 1).cast("int")
    visited = [settle(step(narrow.filter(is_top), 0, F.lit(0)), "level")]
    while not visited[-1].isEmpty():
        if len(visited) > max_depth:
            raise RuntimeError(f"still rows below level {max_depth}: a cycle or a deeper tree")
        below = narrow.join(visited[-1], narrow[parent] == F.col("_up_id")).drop("_up_id")
        visited.append(settle(step(below, 1, level), "level"))
    whole = lambda rows, at, level: rows.select(
        *[F.col(f"`{c}`") for c in df.columns], *[made[at].alias(c) for c, made in carry.items()], level.alias("level")
    )
    top = whole(df.filter(is_top), 0, F.lit(0))
    return append_all(top, whole(df.join(append_all(*visited), df[parent] == F.col("_up_id")), 1, level))


def follow(pointers: DataFrame, id_col: str, next_col: str, text: str | None = None, sep: str = "/") -> tuple[DataFrame, DataFrame]:
    """Where pointers lead: (rows whose pointers come to an end, rows whose pointers may go round for ever).

    ``pointers``: unique ids, not null, each with the id it points to, null at an end. The first result has id, last
    (the id at the end), steps and path: the texts in column ``text`` from the end to the row, joined by ``sep``. The
    second has id and next of the others: those on a cycle or leading into one, which ``name_cycles`` tells apart, and some
    of those that lead to an id that is not in the table.

    A row that many point to is found by an equi join whose many-rows side Spark can split.
    """
    kind = pointers.schema[id_col].dataType
    label = F.lit(None).cast("string") if text is None else F.col(text).cast("string")
    start = pointers.select(F.col(id_col).alias("id"), F.col(next_col).cast(kind).alias("next"), label.alias("path"))
    start = settle(start, "pointers")
    end = F.col("next").isNull()
    state = start.select(
        "id", F.coalesce("next", "id").alias("at"), F.when(end, 0).otherwise(1).cast("long").alias("steps"), "path", end.alias("done")
    )
    ended = [state.filter("done")]
    active = state.filter("NOT done")
    while not active.isEmpty():
        known = append_all(*ended, active).select(*[F.col(c).alias(f"_{c}") for c in state.columns])
        step = active.join(known, active["at"] == known["_id"]).select(
            "id",
            F.col("_at").alias("at"),
            (F.col("steps") + F.col("_steps")).alias("steps"),
            F.concat("_path", F.lit(sep), "path").alias("path"),
            F.col("_done").alias("done"),
        )
        step = settle(step, "jump")
        ended.append(step.filter("done"))
        active = step.filter("NOT done")
        # a jump twice as far that reaches no end: no row is that deep, what is left goes round
        if ended[-1].isEmpty():
            break
    found = append_all(*ended).select("id", F.col("at").alias("last"), "steps", "path")
    return found, start.join(active.select("id"), "id", "left_semi").select("id", "next")


def name_cycles(looped: DataFrame) -> DataFrame:
    """id, cycle (its smallest id), on_cycle for the rows of ``looped`` (id, next) that are on a cycle or lead into one.

    Pointers are doubled until they are longer than the longest way into a cycle and round it; so each has
    landed on its cycle, and the smallest id met from there on is the cycle's.
    """
    jumps = settle(looped.select("id", F.col("next").alias("at"), F.col("id").alias("low")), "loop")
    for _ in range(max(jumps.count() - 1, 0).bit_length()):
        further = jumps.select(F.col("id").alias("_id"), F.col("at").alias("_at"), F.col("low").alias("_low"))
        doubled = jumps.join(further, jumps["at"] == further["_id"])
        jumps = settle(doubled.select("id", F.col("_at").alias("at"), F.least("low", "_low").alias("low")), "loop")
    landed = jumps.select(F.col("id").alias("_id"), F.col("low").alias("cycle"))
    on = jumps.select(F.col("at").alias("_on")).distinct()
    named = jumps.join(landed, jumps["at"] == landed["_id"]).join(on, jumps["id"] == on["_on"], "left")
    return named.select("id", "cycle", F.col("_on").isNotNull().alias("on_cycle"))


def _ids_repeat(df: DataFrame, id_col: str) -> bool:
    counts = df.groupBy(F.col(id_col).alias("_id")).count()
    return not counts.filter("_id IS NOT NULL AND count > 1").isEmpty()


def _from_top(df: DataFrame, is_top: Column, id_col: str, parent: str, name: str | None, sep: str, max_depth: int | None) -> DataFrame:
    """Rows under the top rows with path and level, where ids are unique."""
    top = F.coalesce(is_top, F.lit(False))
    label = F.lit(None).cast("string") if name is None else F.col(name).cast("string")
    nodes = df.filter(F.col(id_col).isNotNull() & (top | F.col(parent).isNotNull()))
    nodes = nodes.select(F.col(id_col).alias("_id"), F.when(~top, F.col(parent)).alias("_next"), label.alias("_name"))
    found = follow(nodes, "_id", "_next", "_name", sep)[0]
    above = found.select(F.col("id").alias("_up_id"), F.col("path").alias("_up_path"), (F.col("steps") + 1).cast("int").alias("level"))
    if max_depth is not None and not above.filter(F.col("level") > max_depth + 1).isEmpty():
        raise RuntimeError(f"still rows below level {max_depth}: a cycle or a deeper tree")
    rows = [F.col(f"`{c}`") for c in df.columns]
    first = df.filter(top).select(*rows, label.alias("path"), F.lit(0).alias("level"))
    under = df.filter(~top).join(above, F.col(parent) == F.col("_up_id"))
    return append_all(first, under.select(*rows, F.concat("_up_path", F.lit(sep), label).alias("path"), "level"))


def descend(df: DataFrame, id_col: str, parent: str, max_depth: int | None = None) -> DataFrame:
    """All rows reachable from the roots (parent IS NULL), with their level.

    Nothing is deduplicated: a row reached twice comes twice. Where ids are unique depth does not matter, and rows on
    cycles are not reachable; where ids repeat a cycle ends in an error, as do more than ``MAX_DEPTH`` levels.
    """
    is_top = F.col(parent).isNull()
    if _ids_repeat(df, id_col):
        return _walk(df, is_top, id_col, parent, [], {}, MAX_DEPTH if max_depth is None else max_depth)
    return _from_top(df, is_top, id_col, parent, None, "/", max_depth).drop("path")


def paths(
    df: DataFrame, id_col: str, parent: str, name: str, sep: str = "/", root=None, max_depth: int | None = None
) -> DataFrame:
    """Adds ``path``, the names from the top joined by ``sep``.

    The top rows are those whose parent equals ``root`` (or is NULL); the root itself is no part of
    the path. Ids that repeat are treated as in ``descend``.
    """
    is_top = F.col(parent).isNull() if root is None else F.col(parent) == F.lit(root)
    if not _ids_repeat(df, id_col):
        return _from_top(df, is_top, id_col, parent, name, sep, max_depth)
    here = F.col(name).cast("string")
    carry = {"path": (here, F.concat(F.col("_up_path"), F.lit(sep), here))}
    return _walk(df, is_top, id_col, parent, [name], carry, MAX_DEPTH if max_depth is None else max_depth)


def closure(
    edges: DataFrame, parent: str, child: str, start, max_depth: int = MAX_DEPTH, name: str = "node"
) -> DataFrame:
    """Distinct parents reachable from ``start`` over parent-to-child edges, with the lowest level.

    Leaves never appear. The start is kept even if it refers to itself; further down a parent that
    refers to itself is left out and not walked through. Each parent is visited once, so cycles end.
    """
    edges = edges.select(F.col(parent).alias("_p"), F.col(child).alias("_c")).distinct()
    looped = edges.filter(F.col("_p") == F.col("_c")).select(F.col("_p").alias("_self"))
    walkable = settle(edges.join(looped, edges["_p"] == looped["_self"], "left_anti"), "edges")
    parents = settle(walkable.select(F.col("_p").alias(name)).distinct(), "parents")
    level = settle(
        edges.filter(F.col("_p") == F.lit(start)).select(F.col("_p").alias(name)).distinct().withColumn("level", F.lit(0)),
        "level",
    )
    # the start may be walked from even though it refers to itself
    step = edges.filter((F.col("_p") == F.lit(start)) & (F.col("_c") != F.lit(start))).select("_c")
    levels = [level]
    while not levels[-1].isEmpty():
        if len(levels) > max_depth:
            raise RuntimeError(f"still parents below level {max_depth}")
        seen = append_all(*levels).select(F.col(name).alias("_seen"))
        found = step.select(F.col("_c").alias(name)).distinct().join(parents, name, "left_semi")
        found = found.join(seen, found[name] == seen["_seen"], "left_anti")
        levels.append(settle(found.withColumn("level", F.lit(len(levels))), "level"))
        here = levels[-1].select(F.col(name).alias("_p"))
        step = walkable.join(here, "_p", "left_semi").select("_c")
    return append_all(*levels)
