"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

A source's target is its weighted share of the wanted words. Where that exceeds ``max_epochs`` times the
source's size, the target is clamped there and the excess goes to the other sources by weight, until no
target is above its clamp. A source whose target is e times its size repeats every document floor(e)
times; the documents of the fractional repetition come in the order of a seeded hash of their id, up to
the document that straddles the target, which is taken if at least half of it fits.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shapewright.llm.common import SPACE_WORD, Stages
from shapewright.operators.numbering import number_rows

WEIGHTS = (5, 2, 1)
BUCKET_DIGITS = 3  # hexadecimal digits of the hash by which a level of the search narrows the cut


def document_sizes(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, ``keep`` columns and the number of words of each document; no text counts 0."""
    words = F.regexp_count("text", F.lit(SPACE_WORD))
    return docs.select("doc_id", "source", *keep, F.coalesce(words, F.lit(0)).cast("long").alias("size"))


def source_weights(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """Per source: its size, and the weight that its place by code point gives it; the null source is last.

    A row per source, found with map-side sums and numbered over range partitions.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    placed = number_rows(totals, F.col("source").asc_nulls_last(), "place")
    cycle = F.array(*[F.lit(w) for w in weights])
    at = ((F.col("place") - 1) % len(weights) + 1).cast("int")
    return placed.select("source", "source_size", F.element_at(cycle, at).cast("long").alias("weight"))


def water_fill(sources: DataFrame, share=Fraction(3, 2), max_epochs: int = 2) -> DataFrame:
    """Adds ``target``. Each round clamps what is above its cap; only three sums reach the driver.

    Sums are whole numbers, so the level is exact and does not depend on the order of rows.
    """
    share = Fraction(share)
    if share > max_epochs:
        raise ValueError("the share cannot exceed the largest number of epochs")
    cap = F.col("source_size") * max_epochs
    capped: tuple[int, int] | None = None  # the level of the last round, as words a unit of weight
    while True:
        over = F.lit(False) if capped is None else _above(cap, capped)
        total, used, weight, clamped = sources.agg(
            F.coalesce(F.sum("source_size"), F.lit(0)),
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0)),
            F.count_if(over),
        ).first()
        rest = share.numerator * total - share.denominator * used
        level = (rest, share.denominator * weight) if weight else None
        if level is None or capped is not None and level[0] * capped[1] == level[1] * capped[0]:
            break
        capped = level
    level = capped or (0, 1)
    target = F.col("weight") * F.lit(level[0]).cast("double") / F.lit(level[1]).cast("double")
    return sources.withColumn("target", F.when(_above(cap, level), cap.cast("double")).otherwise(target))


def _above(cap, level: tuple[int, int]):
    """Whether a source's weighted share of the level is above its cap, in whole numbers."""
    exact = "decimal(19,0)"
    share = F.col("weight").cast(exact) * F.lit(level[0]).cast(exact)
    return share > cap.cast(exact) * F.lit(level[1]).cast(exact)


def _level(rows: DataFrame, cuts: DataFrame, digits: int) -> DataFrame:
    """Narrows each source's cut by one level: the bucket of the hash in which the running size passes it.

    ``cuts``: source, prefix (of the hash), want (words still to take inside the prefix). A level has at
    most 16**BUCKET_DIGITS buckets a source, summed map-side, so the window is over few narrow rows.
    """
    inside = _inside(rows, cuts)
    bucket = F.substring("order", 1, digits)
    sums = inside.groupBy("source", bucket.alias("bucket")).agg(
        F.sum("size").alias("size"), F.max("want").alias("want")
    )
    before = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("size").over(before), F.lit(0)))
    holds = (F.col("before") <= F.col("want")) & (F.col("want") < F.col("before") + F.col("size"))
    return sums.filter(holds).select("source", F.col("bucket").alias("prefix"), (F.col("want") - F.col("before")).alias("want"), "size")


def mix(docs: DataFrame, weights=WEIGHTS, share=Fraction(3, 2), max_epochs: int = 2, seed: int = 17, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, ``keep`` columns, size, source_size, target, copies: how often the mix takes each document.

    Ties: rows that repeat a doc_id within a source come at one place of the order, so all of them or
    none get the fractional copy. Null ids are ordered as an empty id. Documents without words are
    repeated like their neighbours and add nothing. No documents: no rows. Columns not in ``keep`` are ignored.

    Sources, cuts and level sums are as many as sources (times at most 4096 buckets). Documents are only
    read, filtered and joined with one row per source: by broadcast if Spark measures the sources as
    small, else by a shuffle that splits hot sources at run time.
    """
    stages = Stages(docs.sparkSession)
    order = F.md5(F.concat(F.lit(f"{seed}/"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    rows = stages.write("mix-sizes", document_sizes(docs, keep).withColumn("order", order))
    sources = water_fill(source_weights(rows, weights), share, max_epochs)
    sources = stages.write("mix-sources", sources.coalesce(1))
    whole = F.floor(F.try_divide(F.col("target"), F.col("source_size")))
    sources = sources.withColumn("whole", F.coalesce(whole, F.lit(0)).cast("int"))
    sources = sources.withColumn("want", F.col("target") - F.col("whole") * F.col("source_size"))
    cuts = sources.filter("source_size > 0").select("source", F.lit("").alias("prefix"), "want")
    for level in range(1, 33 // BUCKET_DIGITS + 1):
        cuts = _level(rows, cuts, min(32, level * BUCKET_DIGITS)).coalesce(1)
        cuts = stages.write(f"mix-cuts-{level}", cuts)
        if cuts.filter(F.length("prefix") < 32).isEmpty() or _single(rows, cuts):
            break
    cut = cuts.select(F.col("source").alias("_source"), "prefix", (F.col("want") * 2 >= F.col("size")).alias("half"))
    placed = sources.join(cut, sources["source"].eqNullSafe(cut["_source"]), "left").drop("_source")
    placed = placed.select(F.col("source").alias("_source"), "source_size", "target", "whole", "prefix", "half")
    out = rows.join(placed, rows["source"].eqNullSafe(placed["_source"]))
    at = F.substring("order", 1, F.length("prefix"))
    extra = F.when(at < F.col("prefix"), 1).when((at == F.col("prefix")) & F.col("half"), 1).otherwise(0)
    copies = F.least(F.col("whole") + extra, F.lit(max_epochs)).alias("copies")
    return out.select("doc_id", "source", *keep, "size", "source_size", "target", copies)


def _inside(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    cuts = cuts.select(F.col("source").alias("_source"), "prefix", "want")
    inside = rows.join(cuts, rows["source"].eqNullSafe(cuts["_source"])).drop("_source")
    return inside.filter(F.col("order").startswith(F.col("prefix")))


def _single(rows: DataFrame, cuts: DataFrame) -> bool:
    """True if no cut holds two different places of the order any more."""
    inside = _inside(rows, cuts)
    return inside.groupBy("source").agg(F.min("order").alias("a"), F.max("order").alias("b")).filter("a < b").isEmpty()


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document."""
    mixed = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    taken = (F.col("size") * F.col("copies")).cast("long").alias("taken")
    return mixed.select("doc_id", "size", "source_size", "target", taken)


OP10_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('17/' || coalesce(doc_id::VARCHAR, '')) AS ord
  FROM documents
), totals AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source
), weighted AS (
  SELECT *, ([5, 2, 1])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::BIGINT AS weight FROM totals
), ranked AS (
  SELECT *, row_number() OVER (ORDER BY source_size::DOUBLE / weight, source) AS place FROM weighted
), filled AS (
  SELECT *,
    3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    2 * sum(weight) OVER (ORDER BY place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free
  FROM ranked
), level AS (
  SELECT rest::DOUBLE AS rest, free::DOUBLE AS free FROM filled WHERE weight * rest <= 2 * source_size * free ORDER BY place LIMIT 1
), targets AS (
  SELECT r.source, r.source_size, least(r.weight * l.rest / l.free, 2.0 * r.source_size) AS target FROM ranked r, level l
), wanted AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS whole FROM targets
), placed AS (
  SELECT s.doc_id, s.size, w.source_size, w.target, w.whole, w.target - w.whole * w.source_size AS want,
    sum(s.size) OVER (PARTITION BY s.source ORDER BY s.ord RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
    sum(s.size) OVER (PARTITION BY s.source, s.ord) AS here
  FROM sized s JOIN wanted w ON s.source IS NOT DISTINCT FROM w.source
)
SELECT doc_id, size, source_size, target,
  (size * (whole + CASE WHEN here > 0 AND (upto <= want OR 2 * (want - (upto - here)) >= here) AND upto - here <= want THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""
