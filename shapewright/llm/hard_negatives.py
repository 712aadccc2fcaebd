"""Hard negatives by lists that clusters of anchors share.

Anchors are clustered by direction. By the triangle inequality of angles no member of a cluster scores more
with a candidate x than |a| |x| cos(max(0, angle(centroid, x) - widest angle(centroid, member))). So for a
cluster the candidates are sorted once by that bound, and every member walks the list: it scores candidates
exactly, keeps its best, and ends when the bound of the rest is below what it still needs. That end is
certified; nothing is approximate.

Spark deals the candidates, sorted by cell, over tasks. Each batch of them is a list of its own, and what a
member has found goes on from batch to batch of a task. Anchors come to the tasks in blocks of at most
``PASS_BYTES``, one job each. The few best of each task are shuffled and merged. With many tasks the candidates
take turns, a small share first, whose results are the needs that the next share starts with.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shapewright.llm.common import Stages, table
from shapewright.operators.numbering import number_rows

SAMPLE = 4096  # anchors on which centroids are fitted; every row is assigned to one
MEMBERS = 256  # anchors a cluster is meant to have, and the most that walk a list together
MAX_CLUSTERS = 256
PASS_BYTES = 16 << 20  # anchor vectors that are broadcast at once
STEP = 1024  # candidates of a list that are scored at once
TASKS = 16  # tasks up to which the candidates are one turn
SHARE = 8  # a turn has this many times the candidates of the one before
EXACT = 1 << 53  # whole numbers below are exact as double
BEYOND = (1 << 62) + 1  # above all scores


def whole_components(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as double."""
    scaled = lambda x: x.cast("double") * scale
    return F.transform(vector, lambda x: F.when(F.abs(scaled(x)) < float(EXACT), F.floor(scaled(x)).cast("double")).otherwise(scaled(x)))


def finite(vector: Column) -> Column:
    """Whether there is a vector and all its components are numbers."""
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(vector, number), F.lit(False))


def _matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """Rows of whole numbers; shorter vectors are filled up with zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    values = vectors.flatten().to_numpy(zero_copy_only=False)
    if (lengths == dim).all():
        return values.reshape(-1, dim)
    out = np.zeros((len(lengths), dim))
    row = np.repeat(np.arange(len(lengths)), lengths)
    out[row, np.arange(len(values)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = values
    return out


def _directions(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norms = np.sqrt((matrix * matrix).sum(axis=1))
    return matrix / np.where(norms > 0, norms, 1)[:, None], norms


def fit_centroids(matrix: np.ndarray, clusters: int, rounds: int = 10, seed: int = 13) -> np.ndarray:
    """Spherical k-means."""
    unit, _ = _directions(matrix)
    centroids = unit[np.random.default_rng(seed).choice(len(unit), min(clusters, len(unit)), replace=False)]
    for _ in range(rounds):
        nearest = (unit @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, unit)
        held = np.bincount(nearest, minlength=len(centroids)) > 0
        centroids = np.where(held[:, None], _directions(sums)[0], centroids)
    return centroids


def _best(row: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` of each row: higher scores first, then smaller ids."""
    order = np.lexsort((ident, -score, row))
    sorted_row = row[order]
    first = np.searchsorted(sorted_row, sorted_row)
    return order[np.arange(len(order)) - first < k]


class _Block:
    """Anchors that walk lists together: what each needs, and the best that it has found so far.

    An anchor has ``low.shape[1]`` searches, each for the best scores from ``low`` to ``high``.
    """

    def __init__(self, at: np.ndarray, anchors: dict, centroid: np.ndarray):
        self.rid, self.label = anchors["rid"][at], anchors["label"][at]
        self.matrix = anchors["matrix"][at]
        unit, self.norm = _directions(self.matrix)
        self.centroid = centroid
        self.widest = np.arccos(np.clip(unit @ centroid, -1, 1)).max() + 1e-7
        self.low, self.high = anchors["low"][at], anchors["high"][at]
        self.need = self.low.copy()
        none = np.zeros(0, dtype=np.int64)
        self.row, self.score, self.ident = none, none, none

    def walk(self, cand: dict, unit: np.ndarray, same: bool, k: int, exact: bool) -> None:
        angle = np.arccos(np.clip(unit @ self.centroid, -1, 1))
        bound = cand["norm"] * np.cos(np.maximum(angle - self.widest, 0))
        bound += 1e-9 * cand["norm"]
        order = np.argsort(-bound, kind="stable")
        searches = self.low.shape[1]
        for start in range(0, len(order), STEP):
            step = order[start : start + STEP]
            least = self.need.min(axis=1)
            active = np.flatnonzero(self.norm * bound[step[0]] + 1 >= least)
            if not len(active):
                return
            left, right = self.matrix[active], cand["matrix"][step]
            if exact:
                scores = left @ right.T
            else:
                scores = left.astype(np.int64) @ right.astype(np.int64).T
            partners = (self.label[active][:, None] == cand["label"][step][None, :]) == same
            partners &= self.rid[active][:, None] != cand["rid"][step][None, :]
            hits = []
            for j in range(searches):
                a, c = np.nonzero(partners & (scores >= self.need[active, j][:, None]) & (scores <= self.high[active, j][:, None]))
                hits.append((active[a] * searches + j, scores[a, c].astype(np.int64), cand["id"][step[c]]))
            self._merge(*[np.concatenate(part) for part in zip(*hits)], k)

    def _merge(self, row: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> None:
        if not len(row):
            return
        row, score, ident = (np.concatenate(p) for p in ((self.row, row), (self.score, score), (self.ident, ident)))
        kept = _best(row, score, ident, k)
        self.row, self.score, self.ident = row[kept], score[kept], ident[kept]
        ends = np.flatnonzero(np.append(self.row[1:] != self.row[:-1], True))
        full = np.diff(np.append(-1, ends)) == k
        need = self.need.reshape(-1)  # a view
        need[self.row[ends[full]]] = np.maximum(need[self.row[ends[full]]], self.score[ends[full]])


def _walker(broadcast, dim: int, same: bool, k: int, exact: bool):
    """The task: all batches of candidates against all blocks of anchors, then the best of each search."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        anchors = broadcast.value
        blocks = [_Block(at, anchors, anchors["centroids"][anchors["cell"][at[0]]]) for at in anchors["blocks"]]
        for batch in batches:
            matrix = _matrix(batch.column("vector"), dim)
            unit, norm = _directions(matrix)
            cand = {name: batch.column(name).to_numpy() for name in ("rid", "id", "label")} | {"matrix": matrix, "norm": norm}
            for block in blocks:
                block.walk(cand, unit, same, k, exact)
        for block in blocks:
            searches = block.low.shape[1]
            columns = [block.rid[block.row // searches], block.row % searches, block.ident, block.score]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["rid", "search", "found_id", "score"])

    return scan


class _Search:
    """Candidates and anchors as written tables, with the centroids that both are assigned to."""

    def __init__(self, rows: DataFrame, stages: Stages):
        self.spark, self.stages = rows.sparkSession, stages
        rows = stages.write("negatives-rows", rows.withColumn("rid", F.monotonically_increasing_id()))
        self.dim, largest = rows.agg(
            F.coalesce(F.max(F.size("vector")), F.lit(0)),
            F.coalesce(F.max(F.array_max(F.transform("vector", F.abs))), F.lit(0.0)),
        ).first()
        self.dim = max(self.dim, 1)
        # a score must be a long, whatever rows it is of
        limit = math.isqrt((1 << 62) // self.dim)
        if largest > limit:
            rows = rows.filter(F.forall("vector", lambda x: F.abs(x) <= float(limit)))
            largest = limit
        self.exact = self.dim * int(largest) ** 2 < EXACT
        anchors = rows.filter("anchor")
        count = anchors.count()
        first = anchors.select("rid", "vector").orderBy(F.xxhash64("id"), "rid").limit(SAMPLE).toArrow()
        clusters = min(MAX_CLUSTERS, -(-count // MEMBERS))
        sample = _matrix(first.column("vector"), self.dim) if count else np.zeros((0, self.dim))
        self.centroids = fit_centroids(sample, clusters) if count else np.zeros((1, self.dim))
        assigned = self._assigned(rows)
        tasks = rows.rdd.getNumPartitions()
        self.turns = 1 + max(0, math.ceil(math.log(tasks / TASKS, SHARE)))
        # turn t has SHARE times the rows of turn t - 1
        draw = F.pmod(F.xxhash64("rid", F.lit("turn")), F.lit(SHARE ** (self.turns - 1)))
        turn = reduce(lambda made, t: F.when(draw < SHARE**t, t).otherwise(made), range(self.turns - 2, -1, -1), F.lit(self.turns - 1))
        sliced = assigned.withColumn("turn", turn).repartitionByRange("cell", F.xxhash64("rid")).sortWithinPartitions("turn", "cell")
        self.candidates = stages.write("negatives-candidates", sliced, ("turn",) if self.turns > 1 else ())
        width = max(1, PASS_BYTES // (8 * self.dim))
        numbered = number_rows(self._assigned(anchors), ["cell", "rid"], "no").withColumn("pass", F.expr(f"(no - 1) div {width}"))
        self.anchors = stages.write("negatives-anchors", numbered)
        self.passes = -(-count // width)
        stages.drop("negatives-rows")

    def _assigned(self, rows: DataFrame) -> DataFrame:
        centroids, dim = self.centroids, self.dim

        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                cell = (_matrix(batch.column("vector"), dim) @ centroids.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32())], names=[*batch.schema.names, "cell"])

        narrow = rows.select("rid", "id", "label", "vector")
        return narrow.mapInArrow(assign, "rid long, id long, label long, vector array<double>, cell int")

    def best(self, wanted: DataFrame, same: bool, k: int) -> DataFrame:
        """rid, search, place, found_id, score: the first ``k`` of each search.

        ``wanted``: rid, search (from 0), low, high (long). Partners have the anchor's label, or (not ``same``) another.
        """
        searches = (wanted.agg(F.max("search")).first()[0] or 0) + 1
        found = None
        for turn in range(self.turns):
            rows = self.candidates if self.turns == 1 else self.candidates.filter(F.col("turn") == turn)
            parts = [self._pass(rows, wanted, found, number, searches, same, k) for number in range(self.passes)]
            parts += [found.drop("place")] if found is not None else []
            if not parts:
                break
            every = reduce(DataFrame.unionByName, parts)
            place = F.row_number().over(Window.partitionBy("rid", "search").orderBy(F.desc("score"), "found_id"))
            merged = every.withColumn("place", place).filter(F.col("place") <= k)
            name = f"negatives-{'same' if same else 'other'}"
            found = self.stages.write(f"{name}-{turn}", merged)
            self.stages.drop(f"{name}-{turn - 1}", *[f"{name}-part-{n}" for n in range(self.passes)])
        schema = "rid long, search long, found_id long, score long, place int"
        return found if found is not None else self.spark.createDataFrame([], schema)

    def _pass(self, rows: DataFrame, wanted: DataFrame, found: DataFrame | None, number: int, searches: int, same: bool, k: int) -> DataFrame:
        held = self.anchors.filter(F.col("pass") == number)
        needs = wanted.join(held.select("rid"), "rid", "left_semi")
        if found is not None:
            reached = found.filter(F.col("place") == k).select("rid", "search", F.col("score").alias("reached"))
            needs = needs.join(reached, ["rid", "search"], "left")
            needs = needs.withColumn("low", F.greatest("low", "reached")).drop("reached")
        got = held.select("rid", "label", "cell", "vector").orderBy("cell", "rid").toArrow()
        asked = needs.select("rid", "search", "low", "high").toArrow()
        rid = got.column("rid").to_numpy()
        low, high = np.full((len(rid), searches), BEYOND), np.full((len(rid), searches), -BEYOND)
        by_rid = np.argsort(rid)
        at = by_rid[np.searchsorted(rid, asked.column("rid").to_numpy(), sorter=by_rid)] if len(rid) else np.zeros(0, dtype=int)
        low[at, asked.column("search").to_numpy()] = asked.column("low").to_numpy()
        high[at, asked.column("search").to_numpy()] = asked.column("high").to_numpy()
        cell = got.column("cell").to_numpy()
        cuts = np.flatnonzero(np.append(True, cell[1:] != cell[:-1])) if len(cell) else []
        spans = zip(cuts, [*cuts[1:], len(cell)])
        blocks = [np.arange(i, min(i + MEMBERS, end)) for first, end in spans for i in range(first, end, MEMBERS)]
        anchors = {"rid": rid, "label": got.column("label").to_numpy(), "cell": cell, "matrix": _matrix(got.column("vector"), self.dim)}
        broadcast = self.spark.sparkContext.broadcast(anchors | {"low": low, "high": high, "blocks": blocks, "centroids": self.centroids})
        walk = _walker(broadcast, self.dim, same, k, self.exact)
        out = rows.select("rid", "id", "label", "vector").mapInArrow(walk, "rid long, search long, found_id long, score long")
        written = self.stages.write(f"negatives-{'same' if same else 'other'}-part-{number}", out)
        broadcast.destroy()
        return written


def mine(vectors: DataFrame, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``vectors``: id (long), label (long), vector (array of whole numbers as double), anchor (boolean). The positives of an anchor are
    its first ``positives`` other rows of the same label; for each, the first ``negatives`` rows of another label whose score is
    ``low`` to ``high`` per cent of the positive's are returned. Higher scores come first, ties by smaller id.

    Rows with a null in any column, in a component too, take no part, nor do rows with a component so large that an inner
    product of such rows leaves a long (above 2**31 / sqrt of the number of components). A shorter vector counts as
    followed by zeros. Rows that repeat an id are rows of their own. An anchor without positives has no rows, a positive below 0 has none either.
    No anchors or no candidates: no rows.

    At any time one block of anchors (``PASS_BYTES``) and the centroids (``MAX_CLUSTERS``) are broadcast. Candidates are shuffled once, by ranges of
    cell and hash, so copies of a vector are spread.
    """
    stages = Stages(vectors.sparkSession)
    known = F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("vector"))
    search = _Search(vectors.filter(known).select("id", "label", "vector", F.coalesce("anchor", F.lit(False)).alias("anchor")), stages)
    every = search.anchors.select("rid", F.lit(0).alias("search"), F.lit(-BEYOND).alias("low"), F.lit(BEYOND).alias("high"))
    best = search.best(every, True, positives)
    best = best.select("rid", (F.col("place") - 1).alias("search"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    best = stages.write("negatives-positives", best)
    share = F.col("positive_score").cast("decimal(25,0)")
    least = F.ceil(share * low / 100).cast("long")
    most = F.floor(share * high / 100).cast("long")
    ranges = best.select("rid", "search", least.alias("low"), most.alias("high")).filter("low <= high")
    hard = search.best(ranges, False, negatives).withColumnRenamed("found_id", "negative_id").withColumnRenamed("score", "negative_score")
    named = search.anchors.select("rid", F.col("id").alias("anchor_id"))
    out = hard.join(best, ["rid", "search"]).join(named, "rid")
    return out.select("anchor_id", "positive_id", F.col("place").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark, sf_dir: str) -> DataFrame:
    """Hard negatives of every hundredth vector against all vectors, with the labels of some changed."""
    rows = table(spark, sf_dir, "embeddings")
    label = F.col("label").cast("long")
    label = F.when(F.col("vec_id") % 7 == 0, (label + 1) % 10).otherwise(label)
    known = F.when(finite(F.col("embedding")), whole_components(F.col("embedding")))
    return mine(
        rows.select(F.col("vec_id").cast("long").alias("id"), label.alias("label"), known.alias("vector"), (F.col("vec_id") % 100 == 0).alias("anchor"))
    )


OP13_SQL = """
WITH kept AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * x::DOUBLE)::BIGINT for x in embedding] AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0
), scored AS (
  SELECT a.rid, a.vec_id AS anchor_id, b.rid AS other, b.vec_id AS other_id, a.label = b.label AS same,
    list_sum([p[1] * p[2] for p in list_zip(a.q, b.q)])::BIGINT AS score
  FROM kept a JOIN kept b ON a.vec_id % 100 = 0 AND a.rid <> b.rid
), positives AS (
  SELECT rid, anchor_id, other, other_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY score DESC, other_id, other) <= 5
)
SELECT p.anchor_id, p.positive_id, row_number() OVER (PARTITION BY p.rid, p.other ORDER BY n.score DESC, n.other_id)::INT AS rank,
  n.other_id AS negative_id, p.positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.rid = p.rid AND NOT n.same
  AND 80 * p.positive_score <= 100 * n.score AND 100 * n.score <= 100 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.rid, p.other ORDER BY n.score DESC, n.other_id) <= 5
"""
