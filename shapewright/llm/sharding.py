"""Sharding by a weighted hash tree: region, rack, shard.

A row descends from the root. At each node its key draws a number for every child, a hash of key and child
turned into an exponential variable with the child's weight as its rate; the smallest draw wins, so a child is
chosen in proportion to its weight. The weight of an inner node is the sum of the weights below it.

A draw depends on the key, the child and its weight only. So a greater weight can only attract keys, a smaller
one only release them, and keys whose path has no node of another weight, and that no such node attracts, stay:
movement is confined to the subtrees whose weights change. A shard that is added as a region of its own changes
the weight of no other node, so it takes keys only into itself.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapewright.llm.common import Stages, table
from shapewright.operators.numbering import number_rows

SEED = "shards-1"
HEX_DIGITS = 13  # of the hash, 52 bits: whole numbers that a double holds exactly
OVERHEAD = 16  # bytes of a row besides its text
LEVELS = ("region", "rack", "shard")


@dataclass(frozen=True)
class Tree:
    """Shards with their place and weight: {shard: (region, rack, weight)}. Names are text, weights above 0."""

    shards: dict[int, tuple[str, str, float]] = field(default_factory=dict)

    def __post_init__(self):
        if not self.shards or any(not w > 0 for _, _, w in self.shards.values()):
            raise ValueError("a tree needs shards, each with a weight above 0")

    @staticmethod
    def regular(regions: int, racks: int, shards: int, weight: float = 1.0) -> Tree:
        """``shards`` in each of ``racks`` in each of ``regions``, numbered from 0."""
        return Tree(
            {
                (r * racks + k) * shards + s: (f"r{r}", f"r{r}.k{k}", weight)
                for r in range(regions)
                for k in range(racks)
                for s in range(shards)
            }
        )

    def grown(self, weight: float = 1.0) -> Tree:
        """The tree with one more shard, in a region of its own; no other shard takes a row."""
        new = max(self.shards) + 1
        return Tree(self.shards | {new: (f"r+{new}", f"r+{new}.k0", weight)})

    def with_weight(self, shard: int, weight: float) -> Tree:
        """The tree with another weight of a shard, and so of its rack and region."""
        region, rack, _ = self.shards[shard]
        return Tree(self.shards | {shard: (region, rack, weight)})

    def children(self) -> list[dict[str, dict[str, float]]]:
        """For each level: {node above: {node: weight}}; shards are written as text."""
        levels: list[dict[str, dict[str, float]]] = [{}, {}, {}]
        for shard, (region, rack, weight) in sorted(self.shards.items()):
            for level, (above, node) in enumerate((("", region), (region, rack), (rack, str(shard)))):
                nodes = levels[level].setdefault(above, {})
                nodes[node] = nodes.get(node, 0.0) + weight
        return levels


def _draw(key: Column, level: str, node: Column, weight: Column, seed: str) -> Column:
    """An exponential variable with the weight as its rate, the same for the same key, node and weight."""
    digits = F.substring(F.md5(F.concat_ws("/", F.lit(seed), F.lit(level), node, key)), 1, HEX_DIGITS)
    unit = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**HEX_DIGITS)
    return -F.ln(unit) / weight


def descend(key: Column, tree: Tree, seed: str = SEED) -> Column:
    """The shard of a key: struct of region, rack and shard (int). The tree is a literal, a few bytes a shard."""
    chosen = F.lit("")
    found: list[Column] = []
    for level, nodes in zip(LEVELS, tree.children()):
        lists = [
            F.array(*[F.struct(F.lit(n).alias("node"), F.lit(float(w)).alias("weight")) for n, w in below.items()])
            for below in nodes.values()
        ]
        below = lists[0]
        if len(lists) > 1:
            known = F.map_from_arrays(F.array(*[F.lit(n) for n in nodes]), F.array(*lists))
            below = F.element_at(known, chosen)
        drawn = F.transform(
            below, lambda c: F.struct(_draw(key, level, c["node"], c["weight"], seed).alias("draw"), c["node"].alias("node"))
        )
        chosen = F.array_min(drawn)["node"]
        found.append(chosen)
    return F.struct(*[c.alias(name) for c, name in zip(found[:2], LEVELS)], found[2].cast("int").alias("shard"))


def place(docs: DataFrame, tree: Tree, grown: Tree | None = None, key: str = "doc_id", seed: str = SEED) -> DataFrame:
    """key, size, text_crc32, region, rack, shard, slot and grown_shard (null without ``grown``) for each row.

    The key alone decides on the shard, so rows that repeat it are together, and all rows without key are
    together as those of one key. Slots count from 0 in each shard by key (null first), then checksum and size
    of the text. A null text has no bytes and checksum 0. No rows: no rows. Other columns are ignored.

    Texts are read once and not moved. The slots come from a numbering of narrow rows by ranges, so a shard of
    any size is spread over tasks.
    """
    stages = Stages(docs.sparkSession)
    id_text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("-"))
    text = F.coalesce(F.encode("text", "utf-8"), F.lit(b""))
    rows = docs.select(
        F.col(f"`{key}`").alias("key"),
        (F.octet_length(text) + F.lit(OVERHEAD)).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        descend(id_text, tree, seed).alias("at"),
        (descend(id_text, grown, seed)["shard"] if grown else F.lit(None).cast("int")).alias("grown_shard"),
    ).select("key", "size", "text_crc32", "at.*", "grown_shard")
    rows = stages.write("shard-rows", rows)
    numbered = stages.write("shard-numbered", number_rows(rows, ["shard", "key", "text_crc32", "size"], "_no", copies=True))
    firsts = numbered.groupBy(F.col("shard").alias("_shard")).agg(F.min("_no").alias("_first"))
    # one row for each shard of the tree
    placed = numbered.join(F.broadcast(firsts), F.col("shard") == F.col("_shard"))
    slot = (F.col("_no") - F.col("_first")).alias("slot")
    return placed.select(F.col("key").alias(key), "size", "text_crc32", *LEVELS, slot, "grown_shard")


def write_shards(docs: DataFrame, tree: Tree, folder: str, rows_per_file: int = 1_000_000, key: str = "doc_id", seed: str = SEED) -> None:
    """Writes all columns as one parquet sub-folder for each shard (``at_shard=N``), in files of about ``rows_per_file``.

    A shard's rows are dealt over its files by the hash of their place in the input, so a large shard has as many tasks as files.
    """
    id_text = F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("-"))
    rows = docs.withColumn("at_shard", descend(id_text, tree, seed)["shard"])
    largest = rows.groupBy("at_shard").count().agg(F.max("count")).first()[0] or 0
    files = max(1, -(-largest // rows_per_file))
    part = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(files))
    dealt = rows.repartition(min(files * len(tree.shards), 10_000), "at_shard", part)
    dealt.write.partitionBy("at_shard").option("compression", "zstd").parquet(folder)


PRODUCTION = Tree.regular(4, 2, 5)  # 40 shards


def op12_sharding(spark, sf_dir: str) -> DataFrame:
    """All documents in 40 shards, and where they would be with one more."""
    placed = place(table(spark, sf_dir, "documents"), PRODUCTION, PRODUCTION.grown())
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", "region", "rack")
