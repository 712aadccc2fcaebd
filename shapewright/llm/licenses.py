"""License scans by diagonal voting.

All rolling k-grams of the words of every document are joined by hash to their positions in license
templates. A hit votes for the offset (document position minus template position) at which the template
would start. A template that stands in the document word for word collects all its votes on one
diagonal; inserted or missing words shift the rest to a neighbouring one, so neighbouring diagonals are
merged to spans, and a span counts if enough of the template is covered within little more than its length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shapewright.llm.common import Stages, chunks, table
from shapewright.llm.words import ALNUM, windows, words_of

K = 2
SHIFT = 3  # diagonals this far apart are neighbours
MIN_SCORE = 0.75
TASK_BITS = 33

#: fixed values: phrases whose every place is reported, with their labels
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: fixed values: opening sentences of public licenses, as words, with the labels they stand for
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("you may not use this file except in compliance with the license", "apache-2.0"),
    ("licensed under the gnu general public license version 3", "gpl-3.0"),
    ("licensed under the gnu general public license version 2", "gpl-2.0"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license v 2 0", "mpl-2.0"),
    ("licensed under cc by nc 4 0", "cc-by-nc-4.0"),
    ("licensed under cc by sa 4 0", "cc-by-sa-4.0"),
    ("licensed under cc by 4 0", "cc-by-4.0"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("free and unencumbered software released into the public domain", "unlicense"),
)


def template_grams(spark: SparkSession, templates, base, k: int = K) -> DataFrame:
    """template, label, is_base, words, gram, place: every k-gram of every template; as small as the list in code."""
    rows = []
    for number, (text, label, is_base) in enumerate([(*b, True) for b in base] + [(*t, False) for t in templates]):
        words = words_of(pa.array([text]), True, ALNUM)
        if len(words.start) < k:
            raise ValueError(f"a template needs {k} words: {text}")
        grams = windows(words.hashes(), words.whole(k), k).view(np.int64)
        rows += [(number, label, is_base, len(words.start), int(g), i) for i, g in enumerate(grams)]
    return spark.createDataFrame(rows, "template int, label string, is_base boolean, words int, gram long, place int")


def rolling_grams(docs: DataFrame, k: int = K) -> DataFrame:
    """One row for each document (row, doc_id, n_words) and one for each k-gram in it (row, pos, gram).

    ``row`` numbers the documents within this pass, so equal ids stay apart. A null text has no words.
    """
    schema = StructType([docs.schema["doc_id"]]).add("row", "long").add("n_words", "long").add("pos", "integer").add("gram", "long")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << TASK_BITS
        for batch in chunks(batches, "text"):
            words = words_of(batch.column("text"), True, ALNUM)
            starts = words.whole(k)
            grams = windows(words.hashes(), starts, k).view(np.int64)
            here = words.row[starts]
            ids, n, m = batch.column("doc_id"), batch.num_rows, len(starts)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(row + np.arange(n)), pa.array(words.counts), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())],
                names=schema.names,
            )
            yield pa.RecordBatch.from_arrays(
                [
                    pa.nulls(m, ids.type),
                    pa.array(row + here),
                    pa.nulls(m, pa.int64()),
                    pa.array((starts - words.at[here]).astype(np.int32)),
                    pa.array(grams),
                ],
                names=schema.names,
            )
            row += n

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def votes(hits: DataFrame, k: int = K) -> DataFrame:
    """Hits summed up by document, template and diagonal: the template's places that were hit, and where."""
    diagonal = (F.col("pos") - F.col("place")).alias("diagonal")
    return hits.groupBy("row", "template", "label", "is_base", "words", diagonal).agg(
        F.collect_set("place").alias("places"), F.min("pos").alias("first"), (F.max("pos") + k).alias("end")
    )


def spans(voted: DataFrame, k: int = K, shift: int = SHIFT, min_score: float = MIN_SCORE) -> DataFrame:
    """Merged and verified spans: row, label, first, end, score.

    A template's diagonals in a document are put in order of position; one joins the one before if it
    starts within ``shift`` words of where that ended and is no more than ``shift`` diagonals away. The score is the share of
    the template's words that are covered, times template length over span length where the span is longer.
    Of spans that start within ``shift`` words of each other only those with the best score stay. The windows are as long as one document has hits of one template.
    """
    by = Window.partitionBy("row", "template").orderBy("first", "diagonal")
    away = F.abs(F.col("diagonal") - F.lag("diagonal").over(by)) > shift
    gap = F.col("first") > F.lag("end").over(by) + shift
    opens = F.when(F.coalesce(away | gap, F.lit(True)), 1).otherwise(0)
    island = F.sum("opens").over(by.rowsBetween(Window.unboundedPreceding, 0))
    merged = voted.withColumn("opens", opens).withColumn("island", island)
    merged = merged.groupBy("row", "template", "label", "words", "island").agg(
        F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"),
        F.min("first").alias("first"),
        F.max("end").alias("end"),
    )
    alone = voted.select("row", "template", "label", "words", F.lit(-1).alias("island"), "places", "first", "end")
    covered = F.size(F.array_distinct(F.flatten(F.transform("places", lambda p: F.sequence(p, p + k - 1)))))
    fit = F.least(F.lit(1.0), F.col("words") / (F.col("end") - F.col("first")))
    scored = merged.unionByName(alone).withColumn("score", covered / F.col("words") * fit)
    good = scored.filter(F.col("score") >= min_score)
    best = F.max("score").over(Window.partitionBy("row").orderBy("first").rangeBetween(-shift, shift))
    return good.withColumn("best", best).filter("score = best").select("row", "label", "first", "end", "score")


def scan_licenses(docs: DataFrame, templates=TEMPLATES, base=BASE, k: int = K, shift: int = SHIFT, min_score: float = MIN_SCORE) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans, one row per row of ``docs``.

    Base phrases count at every place where all their words stand on one diagonal without a gap. ``spans``
    lists (first, end, label, score) of verified spans. Documents without hits, without words or without
    text have 0, null, empty strings, score 0 and no spans. Repeated rows are reported each. Extra columns are ignored.
    The templates are a list in code, so the broadcast does not grow with the data; hits are shuffled by
    document, which a hot source or template does not skew.
    """
    grams = template_grams(docs.sparkSession, templates, base, k)
    stages = Stages(docs.sparkSession)
    joined = rolling_grams(docs, k).join(F.broadcast(grams), "gram", "left")
    hits = stages.write("license-hits", joined.filter("n_words IS NOT NULL OR template IS NOT NULL").drop("gram"))
    voted = stages.write("license-votes", votes(hits.filter("template IS NOT NULL"), k))
    places = voted.filter(F.col("is_base") & (F.size("places") == F.col("words") - k + 1))
    based = places.groupBy("row").agg(
        F.count(F.lit(1)).alias("n_base"),
        F.min("diagonal").cast("long").alias("first_word"),
        F.max("diagonal").cast("long").alias("last_word"),
        F.collect_set("label").alias("base_list"),
    )
    found = spans(voted, k, shift, min_score).groupBy("row").agg(
        F.max("score").alias("score"),
        F.collect_set("label").alias("label_list"),
        F.array_sort(F.collect_set(F.struct("first", "end", "label", "score"))).alias("spans"),
    )
    none = F.array().cast("array<string>")
    base_list, label_list = F.coalesce("base_list", none), F.coalesce("label_list", none)
    documents = hits.filter("n_words IS NOT NULL").select("row", "doc_id", "n_words")
    return documents.join(based, "row", "left").join(found, "row", "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.array_join(F.array_sort(base_list), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_list, label_list)), ",").alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        "spans",
    )


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    """License phrases and sentences of every document."""
    return scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


_ROWS = ", ".join(
    f"({i}, '{label}', {i < len(BASE)}, string_split('{text}', ' '))" for i, (text, label) in enumerate(BASE + TEMPLATES)
)
#: no id here is null or repeated; grams are two words joined by a space
OP2_SQL = rf"""
WITH templates(template, label, is_base, words) AS (VALUES {_ROWS}),
template_grams AS (
  SELECT template, label, is_base, len(words) AS size, unnest([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) AS gram,
    unnest(range(0, len(words) - 1)) AS place
  FROM templates
), worded AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents
), grams AS (
  SELECT doc_id, unnest([words[i] || ' ' || words[i + 1] FOR i IN range(1, len(words))]) AS gram, unnest(range(0, len(words) - 1)) AS pos FROM worded
), voted AS (
  SELECT doc_id, template, label, is_base, size, pos - place AS diagonal, list(DISTINCT place) AS places, min(pos) AS first, max(pos) + 2 AS last
  FROM grams JOIN template_grams USING (gram) GROUP BY ALL
), based AS (
  SELECT doc_id, count(*) AS n_base, min(diagonal) AS first_word, max(diagonal) AS last_word, list(DISTINCT label) AS labels
  FROM voted WHERE is_base AND len(places) = size - 1 GROUP BY doc_id
), stepped AS (
  SELECT *, CASE WHEN coalesce(abs(diagonal - lag(diagonal) OVER w) > {SHIFT} OR first > lag(last) OVER w + {SHIFT}, true) THEN 1 ELSE 0 END AS opens
  FROM voted WINDOW w AS (PARTITION BY doc_id, template ORDER BY first, diagonal)
), islands AS (
  SELECT *, sum(opens) OVER (PARTITION BY doc_id, template ORDER BY first, diagonal ROWS UNBOUNDED PRECEDING) AS island FROM stepped
), merged AS (
  SELECT doc_id, template, label, size, list_distinct(flatten(list(places))) AS places, min(first) AS first, max(last) AS last
  FROM islands GROUP BY doc_id, template, label, size, island
  UNION ALL SELECT doc_id, template, label, size, places, first, last FROM voted
), scored AS (
  SELECT doc_id, label, first,
    len(list_distinct(list_concat(places, [p + 1 FOR p IN places])))::DOUBLE / size * least(1.0::DOUBLE, size::DOUBLE / (last - first)) AS score
  FROM merged
), best AS (
  SELECT *, max(score) OVER (PARTITION BY doc_id ORDER BY first RANGE BETWEEN {SHIFT} PRECEDING AND {SHIFT} FOLLOWING) AS top FROM scored WHERE score >= {MIN_SCORE}
), found AS (
  SELECT doc_id, max(score) AS score, list(DISTINCT label) AS labels FROM best WHERE score = top GROUP BY doc_id
)
SELECT w.doc_id, len(w.words)::BIGINT AS n_words, coalesce(b.n_base, 0)::BIGINT AS n_base, b.first_word::BIGINT AS first_word, b.last_word::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(b.labels), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
  coalesce(f.score, 0)::DOUBLE AS score
FROM worded w LEFT JOIN based b ON b.doc_id = w.doc_id LEFT JOIN found f ON f.doc_id = w.doc_id
"""
