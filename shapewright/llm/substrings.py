"""Substring dedup with difference-cover anchors.

Words are removed that lie in a window of ``length`` consecutive words which also starts earlier: in a
document of smaller id, or earlier in the same one. Hashing every window of every document would ship
the whole corpus several times, so it is done in two steps.

Anchors. D = {0, 1, 3, 9} is a difference cover modulo 13: for any two places i and j there is a shift
below 13 that brings both to places of D modulo 13. So two equal windows, wherever they start, have an
anchor in common, a shorter window of ``length - 12`` words at such a place. Only 4 of 13 places are
hashed and compared.

Extension. Windows that hold an anchor met more than once are hashed in full. Equal ones are put in
order; all but the first are copies, and their words go.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shapewright.llm.common import Stages, chunks, table
from shapewright.llm.words import KEEP, NOT_SPACE, U, mix, windows, words_of

LENGTH = 20
PERIOD = 13
COVER = (0, 1, 3, 9)  # fixed values: every difference modulo 13 is one of two members of the cover
LAST_ID = (1 << 63) - 1  # where documents without id stand in the order

_PLACES = "key long, doc long, body long, pos int, known boolean"


def _keyed(docs: DataFrame) -> DataFrame:
    """doc (the id, null last), body (a hash of the text, to tell rows of one id apart) and the text."""
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("doc"),
        F.xxhash64("text").alias("body"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def _places(batch: pa.RecordBatch, row: np.ndarray, pos: np.ndarray, key: np.ndarray, all_copies: bool) -> pa.RecordBatch:
    """Places of hashed windows, summed up within the chunk.

    Of equal windows in the chunk the earliest stands for all: it keeps their key. The others are known
    to be copies and need no comparison, so they get keys of their own, and no key has more rows than
    there are chunks. ``all_copies``: whether the earliest of several counts as a copy, too.
    """
    doc = batch.column("doc").to_numpy()[row]
    body = batch.column("body").to_numpy()[row]
    order = np.lexsort((pos, doc, key))
    key, doc, body, pos, row = key[order], doc[order], body[order], pos[order], row[order]
    same = np.zeros(len(key), dtype=bool)
    same[1:] = key[1:] == key[:-1]
    first = np.maximum.accumulate(np.where(same, 0, np.arange(len(key)))) if len(key) else np.zeros(0, np.int64)
    known = same & ((doc != doc[first]) | (pos != pos[first])) if not all_copies else same.copy()
    if all_copies and len(key):
        known[:-1] |= same[1:]
    # equal windows at the same place of repeated rows: neither is earlier, both are compared under the key
    apart = same & known
    key = np.where(apart, mix(key ^ mix(doc.view(U) + (pos.astype(U) << U(1)))), key)
    return pa.RecordBatch.from_arrays(
        [pa.array(key.view(np.int64)), pa.array(doc), pa.array(body), pa.array(pos.astype(np.int32)), pa.array(known)],
        names=["key", "doc", "body", "pos", "known"],
    )


def anchors(keyed: DataFrame, length: int = LENGTH) -> DataFrame:
    """Places of cover windows: key (hash), doc, body, pos, known."""
    size = length - PERIOD + 1
    in_cover = np.isin(np.arange(PERIOD), COVER)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = words_of(batch.column("text"), False, NOT_SPACE)
            starts = words.whole(size)
            pos = starts - words.at[words.row[starts]]
            taken = in_cover[pos % PERIOD]
            starts, pos = starts[taken], pos[taken]
            yield _places(batch, words.row[starts], pos, windows(words.hashes(), starts, size), True)

    return keyed.mapInArrow(scan, _PLACES)


def _runs(batches: Iterator[pa.RecordBatch], copies: Callable) -> Iterator[pa.RecordBatch]:
    """Streams rows sorted by key; gives ``copies`` each batch with the first row of an open run before it."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        key = rows.column("key").to_numpy()
        opens = np.ones(len(key), dtype=bool)
        opens[1:] = key[1:] != key[:-1]
        first = np.maximum.accumulate(np.where(opens, np.arange(len(key)), 0))
        keep = copies(rows, first, 0 if held is None else 1)
        yield rows.select(["doc", "body", "pos"]).filter(pa.array(keep))
        held = rows.slice(int(first[-1]), 1)


def met_again(places: DataFrame) -> DataFrame:
    """doc, body, pos of places whose key has another row, or that are known to be copies."""

    def copies(rows: pa.RecordBatch, first: np.ndarray, skip: int) -> np.ndarray:
        index = np.arange(len(first))
        keep = first != index
        # the first of a run is kept when its second row is seen, which may be in a later batch
        seen = np.zeros(len(first), dtype=bool)
        second = np.flatnonzero(keep & (first == index - 1))
        seen[second - 1] = True
        known = rows.column("known").to_numpy(zero_copy_only=False).copy()
        known[:skip] = False
        return keep | seen | known

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _runs(batches, copies)

    return places.repartition("key").sortWithinPartitions("key").mapInArrow(scan, "doc long, body long, pos int")


def later(places: DataFrame) -> DataFrame:
    """doc, body, pos of places that come after the first place of their key, or are known to."""

    def copies(rows: pa.RecordBatch, first: np.ndarray, skip: int) -> np.ndarray:
        doc, pos = rows.column("doc").to_numpy(), rows.column("pos").to_numpy()
        known = rows.column("known").to_numpy(zero_copy_only=False).copy()
        known[:skip] = False
        return known | (doc != doc[first]) | (pos != pos[first])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _runs(batches, copies)

    ordered = places.repartition("key").sortWithinPartitions("key", "doc", "pos")
    return ordered.mapInArrow(scan, "doc long, body long, pos int")


def _by_document(places: DataFrame) -> DataFrame:
    """The places of each document as one list, which is no longer than the document."""
    return places.groupBy("doc", "body").agg(F.collect_set("pos").alias("places"))


def _lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows and values of a list column; a null list is empty."""
    column = batch.column(name)
    lengths = np.array([0 if n is None else n for n in pc.list_value_length(column).to_pylist()], dtype=np.int64)
    return np.repeat(np.arange(len(column)), lengths), column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)


def _spread(words, row: np.ndarray, places: np.ndarray, before: int, after: int) -> np.ndarray:
    """Marks the words from ``before`` words before to ``after`` words behind each place, within its row."""
    low = np.maximum(words.at[row] + places - before, words.at[row])
    high = np.minimum(words.at[row] + places + after + 1, words.at[row + 1])
    change = np.bincount(low, minlength=len(words.row) + 1) - np.bincount(high, minlength=len(words.row) + 1)
    return np.cumsum(change)[: len(words.row)] > 0


def candidates(keyed: DataFrame, again: DataFrame, length: int = LENGTH) -> DataFrame:
    """Full windows that hold an anchor met again: key (hash), doc, body, pos, known."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = words_of(batch.column("text"), False, NOT_SPACE)
            starts = words.whole(length)
            starts = starts[_spread(words, *_lists(batch, "places"), PERIOD - 1, 0)[starts]]
            row = words.row[starts]
            yield _places(batch, row, starts - words.at[row], windows(words.hashes(), starts, length), False)

    return keyed.join(_by_document(again), ["doc", "body"]).mapInArrow(scan, _PLACES)


def remove_copies(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, n_words, n_removed and kept_text (kept words joined by one space) for each row of ``docs``.

    Windows are judged on the input. Rows with one doc_id count as one document: a window does not start
    earlier than the same window at the same place of a repeated row. Documents without id come last in
    the order, and count as one. Null and empty texts have no words and keep an empty text. Texts of fewer
    than ``length`` words are kept. No documents: no rows. Extra columns are ignored. Windows are compared
    by 64-bit hashes. A stage is written after each comparison, so a lost executor repeats one of them.
    """
    if length < PERIOD:
        raise ValueError(f"windows need at least {PERIOD} words")
    stages = Stages(docs.sparkSession)
    keyed = _keyed(docs)
    again = stages.write("anchors", met_again(anchors(keyed, length)))
    copies = stages.write("copies", later(candidates(keyed, again, length)))
    stages.drop("anchors")
    named = docs.select("doc_id", F.xxhash64("text").alias("body"), F.coalesce("text", F.lit("")).alias("text"))
    named = named.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)))
    joined = named.join(_by_document(copies), ["doc", "body"], "left").select("doc_id", "text", "places")

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "text"):
            words = words_of(batch.column("text"), False, NOT_SPACE)
            gone = _spread(words, *_lists(batch, "places"), 0, length - 1)
            data, kept, removed = words.data.tobytes(), [], []
            for row in range(batch.num_rows):
                low, high = words.at[row], words.at[row + 1]
                here = gone[low:high]
                text = data[words.start[low] : words.end[high - 1]].split() if high > low else []
                kept.append(b" ".join(compress(text, (~here).tolist()) if here.any() else text))
                removed.append(int(here.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(words.counts), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_text"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return joined.mapInArrow(strip, f"doc_id {kind}, n_words long, n_removed long, kept_text string")


def op9_substrings(spark, sf_dir: str) -> DataFrame:
    """What remains of every document."""
    kept = remove_copies(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept_text", "utf-8"), 256).alias("kept_sha256"))


#: no id here is null or repeated
OP9_SQL = r"""
WITH worded AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS pos
  FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents)
), windowed AS (
  SELECT *, CASE WHEN count(*) OVER ahead = 20 THEN string_agg(word, ' ') OVER ahead END AS run
  FROM worded WINDOW ahead AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN CURRENT ROW AND 19 FOLLOWING)
), ranked AS (
  SELECT doc_id, word, pos, run IS NOT NULL AND row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) > 1 AS again FROM windowed
), judged AS (
  SELECT doc_id, word, pos, bool_or(again) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) AS gone FROM ranked
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone), '') AS text
  FROM judged GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON k.doc_id = d.doc_id
"""
