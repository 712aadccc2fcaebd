"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the words, word pairs and pairs with one word between, hashed to ``2**bits`` coordinates;
a document has a feature or not. Each coordinate has its own learning rate, and the L1 term keeps a
coordinate at zero until it has gathered enough evidence, so the model is a short list of weights.

The fit uses a sample of at most ``max_rows`` labelled rows (in order of a hash of their id), which one
task reads as the stream that FTRL needs: averaging the weights of several learners, each with a part of
the sample, found far fewer toxic documents. Scoring covers every document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shapewright.llm.common import chunks, table
from shapewright.llm.words import ALNUM, U, Words, mix, words_of

BITS = 22
MAX_ROWS = 20_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 2.0, 1.0, 10.0, 0.01
BIAS = -1  # the coordinate under which the bias travels


def features(words: Words, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Rows and coordinates of all features, repeats included."""
    word = words.hashes()
    rows, keys = [words.row], [word]
    for gap, salt in ((1, 0x51ED270B0A1F39C1), (2, 0x2545F4914F6CDD1D)):
        starts = words.whole(gap + 1)
        rows.append(words.row[starts])
        keys.append(mix(word[starts] * U(salt) + word[starts + gap]))
    coordinates = (np.concatenate(keys) >> U(64 - bits)).astype(np.int64)
    return np.concatenate(rows), coordinates


def _distinct(rows: np.ndarray, coordinates: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    both = np.unique((rows.astype(np.int64) << bits) | coordinates)
    return both >> bits, both & ((1 << bits) - 1)


def ftrl(examples: list[np.ndarray], labels: np.ndarray, size: int, epochs: int, alpha=ALPHA, beta=BETA, l1=L1, l2=L2):
    """Weights and bias after ``epochs`` passes; an example lists the coordinates (below ``size``) that it has."""
    z, n = np.zeros(size), np.zeros(size)
    bias_z = bias_n = 0.0

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for has, label in zip(examples, labels, strict=True):
            bias = -bias_z / ((beta + np.sqrt(bias_n)) / alpha)
            w = weights(z[has], n[has])
            margin = np.clip(w.sum() + bias, -30, 30)
            slope = 1 / (1 + np.exp(-margin)) - label
            square = slope * slope
            before = n[has]
            z[has] += slope - (np.sqrt(before + square) - np.sqrt(before)) / alpha * w
            n[has] = before + square
            bias_z += slope - (np.sqrt(bias_n + square) - np.sqrt(bias_n)) / alpha * bias
            bias_n += square
    return weights(z, n), -bias_z / ((beta + np.sqrt(bias_n)) / alpha)


def label_sample(labels: DataFrame, max_rows: int = MAX_ROWS) -> DataFrame:
    """doc_id and label (0 or 1) of the rows to learn from; rows without id or label are left out.

    Of several labels for one id the larger counts. The sample is in order of a hash, whatever the table's order.
    """
    known = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max((F.col("toxic") > 0).cast("int")).alias("label"))
    return known.orderBy(F.md5(F.col("doc_id").cast("string")), "doc_id").limit(max_rows)


def fit(docs: DataFrame, labelled: DataFrame, bits: int = BITS, epochs: int = EPOCHS) -> pd.DataFrame:
    """coordinate and weight of the model, the bias under -1; empty without any labelled document.

    ``labelled`` is bounded (see ``label_sample``), so it is broadcast, and the task that learns holds the
    features of the sample and ``2**bits`` coordinates. The driver gets the weights that L1 left.
    """
    chosen = docs.select("doc_id", "text").join(F.broadcast(labelled), "doc_id").select("doc_id", "text", "label")

    def learn(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["label", "doc_id"], kind="stable").reset_index(drop=True)
        rows = rows.iloc[np.random.default_rng(7).permutation(len(rows))]
        examples = []
        for first in range(0, len(rows), 200):
            texts = pa.array(rows["text"].iloc[first : first + 200], pa.string())
            row, coordinate = _distinct(*features(words_of(texts, True, ALNUM), bits), bits)
            examples += np.split(coordinate.astype(np.int32), np.searchsorted(row, np.arange(1, len(texts))))
        weights, bias = ftrl(examples, rows["label"].to_numpy(), 1 << bits, epochs)
        used = np.flatnonzero(weights)
        return pd.DataFrame({"coordinate": np.append(used, BIAS), "weight": np.append(weights[used], bias)})

    learned = chosen.groupBy(F.lit(0).alias("sample")).applyInPandas(learn, "coordinate long, weight double")
    return learned.toPandas().sort_values("coordinate", ignore_index=True)


def score(docs: DataFrame, model: pd.DataFrame, bits: int = BITS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and score for each row; without a model every score is 0.

    A null or empty text scores what the bias alone gives. The broadcast is at most ``2**bits`` weights.
    """
    narrow = docs.select(*keep, "text")
    schema = StructType([f for f in narrow.schema.fields if f.name != "text"]).add("score", "double")
    known = model["coordinate"] != BIAS
    shared = docs.sparkSession.sparkContext.broadcast(
        (model["coordinate"][known].to_numpy(), model["weight"][known].to_numpy(), float(model["weight"][~known].sum()), len(model) > 0)
    )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights, bias, fitted = shared.value
        place = np.full(1 << bits, -1, dtype=np.int32)
        place[names] = np.arange(len(names))
        for batch in chunks(batches, "text"):
            row, coordinate = features(words_of(batch.column("text"), True, ALNUM), bits)
            at = place[coordinate]
            hit = np.flatnonzero(at >= 0)
            row, coordinate = _distinct(row[hit], coordinate[hit], bits)
            margin = np.bincount(row, weights[place[coordinate]], batch.num_rows) + bias
            scores = 1 / (1 + np.exp(-np.clip(margin, -30, 30))) if fitted else np.zeros(batch.num_rows)
            columns = [batch.column(name) for name in schema.names[:-1]]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(scores, pa.float64())], names=schema.names)

    return narrow.mapInArrow(scan, schema)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: the id's CRC-32 divides by 5, or there is no id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> pd.DataFrame:
    return fit(docs, label_sample(labels.filter(~held_out(F.col("doc_id"))), max_rows))


def toxic_scores(docs: DataFrame, model: pd.DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    scored = score(docs, model, keep=keep)
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op6_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned from labelled rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    scored = toxic_scores(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
