"""Merkle manifest of a dataset: digests of rows, a tree for each group of rows, and proofs of single rows.

A leaf is the digest of a row. In each group the leaves stand in order of their key; every ``FANOUT``
consecutive nodes become one node of the next level, until one is left, the group's subroot. The subroots,
ordered by group, become the root in the same way.

A level is worked out by window functions: lag and lead columns at fixed offsets supply the siblings of a
node, masked by its slot in the run and the length of the run, and the rows that are first children hash the
run into its parent. Windows are over blocks of ``BLOCK`` nodes, which hold whole runs, so a group of any size
is spread over all tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapewright.llm.common import Stages, lower_az, table
from shapewright.operators.numbering import number_rows

FANOUT = 8
BLOCK = 64  # nodes of a window, a multiple of FANOUT
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<before: string, after: string>>"


def digest(*parts: Column) -> Column:
    """Lowercase hex SHA-256 of the parts, put together."""
    return F.sha2(F.concat(*parts), 256)


def encoded(value: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value; a number is written in decimal."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def row_digest(columns: dict[str, Column]) -> Column:
    return digest(*[encoded(c) for c in columns.values()])


def _places(leaves: DataFrame, stages: Stages) -> DataFrame:
    """grp, idx (from 0 in the group), n (rows of the group) and all other columns; leaves ascend by key, then node."""
    numbered = number_rows(leaves, ["grp", "key", "node"], "_no", copies=True)
    numbered = stages.write("merkle-numbered", numbered)
    groups = numbered.groupBy("grp").agg(F.min("_no").alias("_first"), F.count(F.lit(1)).alias("n"))
    # written first, so that Spark knows how small they are and need not shuffle the leaves by group
    groups = stages.write("merkle-groups", groups.withColumnRenamed("grp", "_grp"))
    placed = numbered.join(groups, numbered["grp"].eqNullSafe(groups["_grp"]))
    return placed.withColumn("idx", F.col("_no") - F.col("_first")).drop("_no", "_first", "_grp")


def _with_siblings(nodes: DataFrame) -> DataFrame:
    """Adds ``before`` and ``after``: the digests of the other nodes of the run, on either side, put together."""
    block = Window.partitionBy("grp", F.expr(f"idx div {BLOCK}")).orderBy("idx")
    slot = F.col("idx") % FANOUT
    length = F.least(F.lit(FANOUT), F.col("n") - (F.col("idx") - slot))
    before = [F.when(slot >= k, F.lag("node", k).over(block)) for k in range(FANOUT - 1, 0, -1)]
    after = [F.when(slot + k < length, F.lead("node", k).over(block)) for k in range(1, FANOUT)]
    return nodes.select("*", F.concat_ws("", *before).alias("before"), F.concat_ws("", *after).alias("after"))


def _parents(level: DataFrame) -> DataFrame:
    """First children make the nodes of the next level."""
    first = level.filter(F.col("idx") % FANOUT == 0)
    return first.select(
        "grp",
        F.expr(f"idx div {FANOUT}").alias("idx"),
        F.expr(f"(n + {FANOUT - 1}) div {FANOUT}").alias("n"),
        digest(F.col("node"), F.col("after")).alias("node"),
    )


class Tree:
    """Levels of the trees of all groups, each a written table of grp, idx, n, node, before and after.

    ``levels[0]`` has the leaves and their further columns. A group takes part in a level while it has
    several nodes there; ``tops`` has grp and node of each group: what remained of it.
    """

    def __init__(self, placed: DataFrame, stages: Stages, name: str = "merkle"):
        self.levels: list[DataFrame] = []
        tops = []
        here = placed
        while True:
            level = stages.write(f"{name}-level-{len(self.levels)}", _with_siblings(here))
            self.levels.append(level)
            tops.append(level.filter("n = 1").select("grp", "node"))
            here = _parents(level.filter("n > 1"))
            if here.isEmpty():
                break
        self.tops = stages.write(f"{name}-tops", reduce(DataFrame.unionByName, tops))

    def paths(self, above: DataFrame | None = None) -> DataFrame:
        """The leaves with their path: siblings on either side, level by level up to the top of the group.

        ``above`` (grp, path) goes on from there: the path of each group's top in a tree over groups.
        """
        none = F.array().cast(PATH)
        if above is not None:
            above = above.select(F.col("grp").alias("_grp"), F.col("path").alias("_path"))
        found = None
        for level in reversed(self.levels):
            keep = [F.col(f"`{c}`") for c in level.columns if c not in ("before", "after")]
            single = level.filter("n = 1")
            if above is None:
                out = single.select(*keep, none.alias("path"))
            else:
                out = single.join(above, single["grp"].eqNullSafe(above["_grp"])).select(*keep, F.col("_path").alias("path"))
            if found is not None:
                parent = found.select(F.col("grp").alias("_grp"), F.col("idx").alias("_idx"), F.col("path").alias("_path"))
                many = level.filter("n > 1")
                same = (F.expr(f"idx div {FANOUT}") == F.col("_idx")) & many["grp"].eqNullSafe(parent["_grp"])
                here = F.array(F.struct("before", "after"))
                out = out.unionByName(many.join(parent, same).select(*keep, F.concat(here, F.col("_path")).alias("path")))
            found = out
        return found


def fold(node: Column, path: Column) -> Column:
    """The digest at the end of the path, worked out from a node and its siblings."""
    return F.aggregate(path, node, lambda made, run: F.sha2(F.concat(run["before"], made, run["after"]), 256))


def siblings(path: Column) -> Column:
    """All digests of a path, level by level, from left to right, put together."""
    return F.concat_ws("", F.transform(path, lambda run: F.concat(run["before"], run["after"])))


def manifest(docs: DataFrame, columns: tuple[str, ...] = COLUMNS, key: str = "doc_id", group: str = "lang", carry: dict[str, Column] | None = None) -> DataFrame:
    """key, grp, ``carry`` columns, leaf, subroot, root and path for each row.

    ``path`` holds the siblings from the leaf to the root as (before, after) pairs of hex text, so that
    ``fold(leaf, path)`` is the root: what a holder of one row needs to prove that it is in the dataset.

    Nulls are digested as such: a null group is one group and comes first, rows without key come first in
    their group. Rows that repeat a key stand in order of their digests; equal rows are leaves each. Texts of
    any length are digested where they are read and are not moved. An empty table has no rows, and no root.
    Columns that are not named are ignored.
    """
    stages = Stages(docs.sparkSession)
    carry = carry or {}
    made = {name: value.alias(f"carry_{name}") for name, value in carry.items()}
    leaf = row_digest({c: F.col(f"`{c}`") for c in columns})
    leaves = docs.select(F.col(f"`{group}`").alias("grp"), F.col(f"`{key}`").alias("key"), leaf.alias("node"), *made.values())
    tree = Tree(_places(stages.write("merkle-leaves", leaves), stages), stages)
    roots = tree.tops.select(F.lit(0).alias("grp"), F.col("grp").alias("key"), "node")
    upper = Tree(_places(roots, stages), stages, "merkle-root")
    ends = upper.paths().select(F.col("key").alias("_grp"), F.col("node").alias("subroot"), fold(F.col("node"), F.col("path")).alias("root"), "path")
    ends = stages.write("merkle-ends", ends)
    found = tree.paths(ends.select(F.col("_grp").alias("grp"), "path"))
    ends = ends.drop("path")
    out = found.join(ends, found["grp"].eqNullSafe(ends["_grp"]))
    return out.select(
        F.col("key").alias(key), "grp", *[F.col(f"carry_{name}").alias(name) for name in carry], F.col("node").alias("leaf"), "subroot", "root", "path"
    )


def verify(rows: DataFrame, digest_column: str = "leaf") -> DataFrame:
    """Adds folded_root, from the digest and the path, and verified: whether that is the root."""
    folded = rows.withColumn("folded_root", fold(F.col(digest_column), F.col("path")))
    return folded.withColumn("verified", F.col("folded_root") == F.col("root"))


def op11_merkle(spark, sf_dir: str) -> DataFrame:
    """Proofs of all documents against the root, a third of them with a text whose letter case was changed."""
    docs = table(spark, sf_dir, "documents")
    columns = {c: F.col(c) for c in COLUMNS}
    tampered = row_digest(columns | {"text": lower_az(F.col("text"))})
    hit = F.coalesce(F.crc32(F.encode(F.col("doc_id").cast("string"), "utf-8")) % 3 == 0, F.lit(False))
    held = F.when(hit, tampered).otherwise(row_digest(columns))
    rows = verify(manifest(docs, carry={"held": held}), "held")
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(siblings(F.col("path")), 256).alias("proof_sha256"), "folded_root", "verified")


_ENCODED = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')" for c in COLUMNS[:-1])


def _sql_levels(name: str, leaves: str) -> str:
    """DuckDB SQL of a tree over ``leaves`` (grp, idx, n, node) and of the siblings of its nodes."""
    run = f"PARTITION BY level, grp, idx // {FANOUT} ORDER BY idx ROWS BETWEEN"
    return f"""
{name} AS (
  SELECT 0 AS level, grp, idx, n, node FROM {leaves}
  UNION ALL
  SELECT level + 1, grp, idx // {FANOUT}, (n + {FANOUT - 1}) // {FANOUT}, sha256(string_agg(node, '' ORDER BY idx))
  FROM {name} WHERE n > 1 GROUP BY level, grp, idx // {FANOUT}, n
), {name}_runs AS (
  SELECT level, grp, idx,
    coalesce(string_agg(node, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS bef,
    coalesce(string_agg(node, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS aft
  FROM {name} WHERE n > 1
)"""


def _sql_fold(name: str, start: str, tree: str) -> str:
    """DuckDB SQL of climbing ``tree`` from rows of rid, grp, idx, held and proof; the end of each is its last level."""
    return f"""
{name} AS (
  SELECT 0 AS level, rid, grp, idx, held, proof FROM {start}
  UNION ALL
  SELECT f.level + 1, f.rid, f.grp, f.idx // {FANOUT}, sha256(r.bef || f.held || r.aft), f.proof || r.bef || r.aft
  FROM {name} f JOIN {tree}_runs r ON r.level = f.level AND r.grp IS NOT DISTINCT FROM f.grp AND r.idx = f.idx
), {name}_ends AS (
  SELECT rid, any_value(grp) AS grp, arg_max(held, level) AS held, arg_max(proof, level) AS proof FROM {name} GROUP BY rid
)"""


OP11_SQL = rf"""
WITH RECURSIVE hashed AS (
  SELECT doc_id, lang, {_ENCODED} || coalesce(octet_length(encode(text)) || ':' || text, '-') AS own,
    {_ENCODED} || coalesce(octet_length(encode(text)) || ':' || translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '-') AS low,
    xor(4294967295::UBIGINT, list_reduce(
      [4294967295::UBIGINT] || [ascii(d)::UBIGINT for d in string_split(doc_id::VARCHAR, '')],
      lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, y: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))
    )) AS crc
  FROM documents
), leaf AS (
  SELECT doc_id, lang AS grp, sha256(own) AS node, sha256(CASE WHEN doc_id IS NOT NULL AND crc % 3 = 0 THEN low ELSE own END) AS held FROM hashed
), placed AS (
  SELECT *, row_number() OVER (ORDER BY grp NULLS FIRST, doc_id NULLS FIRST, node) AS rid,
    row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, node) - 1 AS idx, count(*) OVER (PARTITION BY grp) AS n
  FROM leaf
), {_sql_levels("tree", "placed")}, subroots AS (
  SELECT grp AS lang, node, row_number() OVER (ORDER BY encode(grp) NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM tree WHERE n = 1
), tops AS (SELECT 0 AS grp, idx, n, node FROM subroots),
{_sql_levels("upper", "tops")},
leaf_start AS (SELECT rid, grp, idx, held, '' AS proof FROM placed),
{_sql_fold("low_fold", "leaf_start", "tree")},
top_start AS (
  SELECT f.rid, 0 AS grp, s.idx, f.held, f.proof FROM low_fold_ends f JOIN subroots s ON s.lang IS NOT DISTINCT FROM f.grp
),
{_sql_fold("top_fold", "top_start", "upper")}
SELECT p.doc_id, p.node AS leaf, s.node AS subroot, r.node AS root, sha256(e.proof) AS proof_sha256,
  e.held AS folded_root, e.held = r.node AS verified
FROM placed p JOIN subroots s ON s.lang IS NOT DISTINCT FROM p.grp JOIN top_fold_ends e ON e.rid = p.rid
CROSS JOIN (SELECT node FROM upper WHERE n = 1) r
"""
