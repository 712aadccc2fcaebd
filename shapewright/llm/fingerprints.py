"""Document fingerprints by Order MinHash over words.

A k-mer is ``k`` consecutive words together with how often it came before in the document. Each of ``m``
hash functions selects the ``pick`` smallest k-mers; they are put back in text order and the tuple is
hashed. So a position of the signature agrees for two documents only if the same k-mers are selected
*and* stand in the same order, which makes the share of agreeing positions follow edit distance, not
just common vocabulary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shapewright.llm.common import chunks, table
from shapewright.llm.words import NOT_SPACE, U, mix, windows, words_of

K = 2  # words of a k-mer
M = 64  # positions of a signature
PICK = 2  # k-mers that a position selects
DIGITS = 8  # hexadecimal digits of a position
LIKELY = 24  # k-mers of a document that pass the first look of a hash function, on average
_MOST = U(0xFFFFFFFFFFFFFFFF)


def kmers(texts: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the occurrence-numbered k-mers in text order, and how many each text has.

    A text of 1 to k-1 words has its words as one k-mer.
    """
    words = words_of(texts, False, NOT_SPACE)
    word = words.hashes()
    starts = words.whole(k)
    hashes, rows = windows(word, starts, k), words.row[starts]
    for short in range(1, k):
        few = words.at[:-1][words.counts == short]
        if len(few):
            at = np.searchsorted(rows, words.row[few])
            hashes = np.insert(hashes, at, mix(windows(word, few, short)))
            rows = np.insert(rows, at, words.row[few])
    key = hashes + mix(rows.astype(U))
    order = np.argsort(key, kind="stable")
    opens = np.ones(len(key), dtype=bool)
    opens[1:] = key[order][1:] != key[order][:-1]
    index = np.arange(len(key))
    count = np.empty(len(key), dtype=np.int64)
    count[order] = index - np.maximum.accumulate(np.where(opens, index, 0))
    return mix(hashes + mix(count.astype(U))), np.bincount(rows, minlength=len(texts))


def _smallest(value: np.ndarray, row: np.ndarray, place: np.ndarray, rows: int, pick: int) -> np.ndarray:
    """Places of the ``pick`` smallest values of each row (rows in order, each present); a row with fewer repeats them."""
    start = np.searchsorted(row, np.arange(rows))
    lengths = np.diff(np.append(start, len(row)))
    value, out = value.copy(), np.empty((pick, rows), dtype=np.int64)
    for i in range(pick):
        low = np.repeat(np.minimum.reduceat(value, start), lengths)
        hit = np.flatnonzero(value == low)
        first = hit[np.searchsorted(row[hit], np.arange(rows))]
        out[i] = np.where(lengths > i, place[first], out[i - 1])
        value[first] = _MOST
    return np.sort(out, axis=0)


def signatures(texts: pa.Array, k: int = K, m: int = M, pick: int = PICK) -> np.ndarray:
    """One row of ``m`` 32-bit numbers for each text. A text without words has zeros only."""
    hashes, counts = kmers(texts, k)
    full = np.flatnonzero(counts)
    result = np.zeros((len(counts), m), dtype=np.uint32)
    if not len(full):
        return result
    counts = counts[full]
    row = np.repeat(np.arange(len(full)), counts)
    limit = np.where(counts > LIKELY, 2.0**64 * LIKELY / counts, 2.0**64 * (1 - 2**-50)).astype(U)
    bound = np.repeat(limit, counts)
    multipliers = mix(np.arange(1, m + 1, dtype=U)) | U(1)
    for j in range(m):
        value = (hashes ^ mix(multipliers[j : j + 1])) * multipliers[j]
        passed = np.flatnonzero(value <= bound)
        found = np.bincount(row[passed], minlength=len(full))
        thin = found < np.minimum(counts, pick)
        if thin.any():  # fewer than needed were below the bound: these documents are looked at in full
            passed = np.flatnonzero((value <= bound) | thin[row])
        places = _smallest(value[passed], row[passed], passed, len(full), pick)
        total = np.zeros(len(full), dtype=U)
        for i in range(pick):
            total = mix(total + hashes[places[i]])
        result[full, j] = (total >> U(32)).astype(np.uint32)
    return result


def as_text(signature: np.ndarray) -> list[str]:
    """Signatures as hexadecimal strings, ``DIGITS`` digits a position."""
    digits = signature.astype(">u4").tobytes().hex()
    width = DIGITS * signature.shape[1]
    return [digits[i : i + width] for i in range(0, len(digits), width)] if width else []


def fingerprints(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), k: int = K, m: int = M, pick: int = PICK) -> DataFrame:
    """``keep`` columns and fingerprint for each row; null and empty texts have the fingerprint of zeros."""
    narrow = docs.select(*keep, F.coalesce(text, F.lit("")).alias("_text"))
    types = ", ".join(f"`{c}` {narrow.schema[c].dataType.simpleString()}" for c in keep)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "_text"):
            made = pa.array(as_text(signatures(batch.column("_text"), k, m, pick)), pa.string())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], made], names=[*keep, "fingerprint"])

    return narrow.mapInArrow(scan, f"{types}, fingerprint string")


def likeness(a: Column, b: Column, m: int = M) -> Column:
    """Share of positions in which two fingerprints agree."""
    same = F.filter(F.sequence(F.lit(0), F.lit(m - 1)), lambda i: a.substr(i * DIGITS + 1, F.lit(DIGITS)) == b.substr(i * DIGITS + 1, F.lit(DIGITS)))
    return F.size(same) / F.lit(float(m))


def in_slices(docs: DataFrame) -> DataFrame:
    """doc_id, doc, body, text, slice, extra, so that each row's successor by descending id is in its slice.

    Slices are ranges of ids between approximate quantiles, one for each shuffle partition. The first row
    of the next slice is added to the end of each (``extra``), and the very first to the last. Rows of
    one id are in order of a hash of their text; rows without id come last.
    """
    spark = docs.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    named = docs.select("doc_id", doc.alias("doc"), F.xxhash64("text").alias("body"), F.coalesce("text", F.lit("")).alias("text"))
    shares = [i / parts for i in range(1, parts)]
    cuts = named.agg(F.percentile_approx("doc", shares, max(10_000, 20 * parts))).first()[0] if shares else []
    cuts = sorted(set(cuts or []), reverse=True)
    above = F.filter(F.array(*[F.lit(c) for c in cuts]).cast("array<bigint>"), lambda c: c > F.col("doc"))
    sliced = named.withColumn("slice", F.size(above))
    heads = sliced.groupBy("slice").agg(F.max("doc").alias("doc")).orderBy("slice").collect()
    known = [r["slice"] for r in heads]
    to = [(r["doc"], known[i - 1]) for i, r in enumerate(heads)]
    firsts = spark.createDataFrame(to, "doc long, slice int")
    extra = named.join(F.broadcast(firsts), "doc").select(named.columns + ["slice", F.lit(True).alias("extra")])
    return sliced.withColumn("extra", F.lit(False)).unionByName(extra)


def compare_with_next(docs: DataFrame, k: int = K, m: int = M, pick: int = PICK) -> DataFrame:
    """Each document against its successor by descending id and against a half-edited version of itself.

    doc_id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next. The edited text
    has its last floor(n_chars / 2) code points replaced by as many of the successor's first (or all it
    has). After the last document comes the first, so a single document is its own successor. Repeated
    rows follow each other. Texts without words agree fully with each other and not at all with others. No documents:
    no rows. Extra columns are ignored.

    Texts are shuffled once, by ranges of ids of about equal numbers of documents.
    """
    placed = in_slices(docs).repartition("slice").sortWithinPartitions("slice", "extra", F.desc("doc"), "body")
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in chunks(batches, "text"):
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            held = rows.slice(rows.num_rows - 1)
            own = np.flatnonzero(~rows.column("extra").to_numpy(zero_copy_only=False)[:-1])
            text = rows.column("text").to_pylist()
            edited = [text[i][: len(text[i]) - len(text[i]) // 2] + text[i + 1][: len(text[i]) // 2] for i in own]
            one = signatures(rows.column("text"), k, m, pick)
            two = signatures(pa.array(edited, pa.string()), k, m, pick)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("doc_id").take(pa.array(own)),
                    pa.array([len(text[i]) for i in own], pa.int64()),
                    pa.array(edited, pa.string()),
                    pa.array(as_text(one[own]), pa.string()),
                    pa.array(as_text(two), pa.string()),
                    pa.array((one[own] == two).mean(axis=1), pa.float64()),
                    pa.array((one[own] == one[own + 1]).mean(axis=1), pa.float64()),
                ],
                names=names,
            )

    return placed.mapInArrow(
        scan,
        f"doc_id {kind}, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double",
    )


def op7_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Fingerprints of every document and of its edited text."""
    compared = compare_with_next(table(spark, sf_dir, "documents"))
    return compared.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited_text", "utf-8"), 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint", "near_edited", "near_next",
    )
