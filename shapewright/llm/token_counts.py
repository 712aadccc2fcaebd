"""Token counts kept as rollups by source, language and tokenizer version, maintained by deltas.

A change is a document before and after: an insert has no before, a delete no after, a revision (new
text, source, language, or a recount by another tokenizer version) has both. A batch of changes becomes
one signed rollup: minus what was, plus what is. Totals are sums, so batches commute, and a batch that
is committed again under its id changes nothing.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shapewright.llm.common import SPACE_WORD, table
from shapewright.session import create_file, new_folder

KEYS = ("source", "lang", "tokenizer")
#: tokenizer versions that are a pattern: each match is a token
PATTERNS = {
    "words-1": SPACE_WORD,
    "pieces-2": r"[A-Za-z]+|[0-9]{1,3}|[\x80-\x{10FFFF}]|[^\x00-\x20A-Za-z0-9\x7F-\x{10FFFF}]",
}


def pattern_counts(docs: DataFrame, versions: dict[str, str], carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, lang, tokenizer, tokens: one row for each document and version. No text: 0 tokens."""
    counts = [
        F.struct(
            F.lit(name).alias("tokenizer"),
            F.coalesce(F.regexp_count("text", F.lit(pattern)), F.lit(0)).cast("long").alias("tokens"),
        )
        for name, pattern in versions.items()
    ]
    return docs.select("doc_id", "source", "lang", *carry, F.inline(F.array(*counts)))


def bpe_counts(docs: DataFrame, ranks_file: str, pattern: str, version: str) -> DataFrame:
    """The same for a public byte-pair vocabulary in the rank format; every executor must see the file."""
    narrow = docs.select("doc_id", "source", "lang", "text")
    schema = StructType(narrow.drop("text").schema.fields).add("tokenizer", "string").add("tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken
        from tiktoken.load import load_tiktoken_bpe

        encoding = tiktoken.Encoding(
            version, pat_str=pattern, mergeable_ranks=load_tiktoken_bpe(ranks_file), special_tokens={}
        )
        for batch in batches:
            tokens = [len(encoding.encode_ordinary(t or "")) for t in batch.column("text").to_pylist()]
            columns = [*batch.columns[:3], pa.array([version] * len(tokens)), pa.array(tokens, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(
                [*list(batch.schema)[:3], ("tokenizer", pa.string()), ("tokens", pa.int64())]
            ))

    return narrow.mapInArrow(count, schema)


def signed(counts: DataFrame, sign: int) -> DataFrame:
    """Counts as additions (1) or removals (-1)."""
    return counts.select(*KEYS, F.lit(sign).cast("long").alias("docs"), (F.lit(sign) * F.col("tokens")).alias("tokens"))


def insert(after: DataFrame) -> list[DataFrame]:
    return [signed(after, 1)]


def delete(before: DataFrame) -> list[DataFrame]:
    return [signed(before, -1)]


def revise(before: DataFrame, after: DataFrame) -> list[DataFrame]:
    return [signed(before, -1), signed(after, 1)]


class RepeatedBatch(ValueError):
    """A batch id is committed already, with other changes."""


class TokenRollup:
    """A rollup table in a shared folder: folders of summed, signed rows, and one small file for each batch that counts.

    A batch is written to a folder of its own and counts from the moment its file is created, whole or not at all.
    The file fails to be created if there is one of its id, so of two writers of a batch one counts. Folders
    that no file names, of writers that died, are ignored. ``compact`` sums all batches up into one folder, so
    that totals read few files. Summing happens map-side: a source with a third of all documents sends no more rows than any other.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, name: str):
        return self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")

    def _files(self):
        return self._path("x").getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _create(self, name: str, record: dict) -> bool:
        """Creates a file with the record, whole or not at all; False if it is there already."""
        return create_file(self.spark, f"{self.folder}/{name}", json.dumps(record))

    def _records(self, kind: str) -> dict[str, dict]:
        files, place = self._files(), self._path(kind)
        if not files.exists(place) or not files.listStatus(place):
            return {}
        rows = self.spark.read.text(f"{self.folder}/{kind}", wholetext=True).select("value").collect()
        return {r["id"]: r for r in (json.loads(row["value"]) for row in rows)}

    def committed(self) -> list[str]:
        """Ids of the batches that count."""
        return sorted(self._records("batches"))

    def _sums(self, rows: DataFrame) -> DataFrame:
        sums = rows.groupBy(*KEYS).agg(F.sum("docs").alias("docs"), F.sum("tokens").alias("tokens"))
        return sums.filter("docs <> 0 OR tokens <> 0")

    def _read(self, folders: list[str]) -> DataFrame:
        schema = "source string, lang string, tokenizer string, docs long, tokens long"
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.folder}/{f}" for f in folders])

    def commit(self, batch: str, changes: list[DataFrame]) -> bool:
        """Adds the signed changes under the batch's id; False, and nothing happens, if it is already there.

        The same id with other changes is a ``RepeatedBatch``. Any text can be an id.
        """
        folder = f"data/{uuid.uuid4().hex}"
        self._sums(reduce(DataFrame.unionByName, changes)).coalesce(1).write.parquet(f"{self.folder}/{folder}")
        row = F.xxhash64(*KEYS, "docs", "tokens").cast("decimal(38,0)")
        content = str(self._read([folder]).agg(F.coalesce(F.sum(row), F.lit(0))).first()[0])
        name = hashlib.sha256(batch.encode()).hexdigest()
        if self._create(f"batches/{name}", {"id": batch, "folder": folder, "content": content}):
            return True
        self._files().delete(self._path(folder), True)
        if self._records("batches")[batch]["content"] != content:
            raise RepeatedBatch(batch)
        return False

    def _state(self) -> tuple[int, list[str], list[str]]:
        """Number of compactions, all batches that count, folders that hold them."""
        rounds = self._records("compactions")
        last = max(rounds.values(), key=lambda r: r["round"], default={"round": 0, "batches": [], "folder": None})
        held, known = set(last["batches"]), self._records("batches")
        newer = [r["folder"] for b, r in sorted(known.items()) if b not in held]
        return last["round"], sorted(known), ([last["folder"]] if last["folder"] else []) + newer

    def compact(self) -> bool:
        """Sums up what is committed into one folder; False if another writer was first. Old folders stay for readers under way."""
        number, batches, folders = self._state()
        folder = f"data/{uuid.uuid4().hex}"
        self._sums(self._read(folders)).coalesce(1).write.parquet(f"{self.folder}/{folder}")
        return self._create(f"compactions/{number + 1:09d}", {"id": str(number + 1), "round": number + 1, "batches": batches, "folder": folder})

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, docs, tokens over all batches; groups that came to nothing are left out.

        Null sources and languages are groups of their own. No batch: no rows.
        """
        return self._sums(self._read(self._state()[2]))


def op4_token_counts(spark, sf_dir: str) -> DataFrame:
    """Totals of all documents under both tokenizer versions, after batches that insert, revise, delete and repeat.

    Load: every document by words-1, English ones as if they had no text. Correction: English documents are revised to
    their counts. Recount: every document by pieces-2 besides. Move: documents without source are deleted and
    inserted again. The load is committed once more at the end, which changes nothing.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text")
    counts = pattern_counts(docs, PATTERNS)
    rollup = TokenRollup(spark, new_folder(spark, "token-rollup"))
    old, new = counts.filter("tokenizer = 'words-1'"), counts.filter("tokenizer = 'pieces-2'")
    english = F.col("lang").eqNullSafe("en")
    first = old.withColumn("tokens", F.when(english, F.lit(0)).otherwise(F.col("tokens")).cast("long"))
    rollup.commit("1-load", insert(first))
    rollup.commit("2-correction", revise(first.filter(english), old.filter(english)))
    rollup.commit("3-recount", insert(new))
    moved = F.col("source").isNull()
    rollup.commit("4-move-out", delete(old.filter(moved)))
    rollup.commit("5-move-in", insert(old.filter(moved)))
    rollup.commit("1-load", insert(first))
    rollup.compact()
    return rollup.totals()


OP4_SQL = rf"""
WITH counted AS (
  SELECT source, lang, unnest([
    {{'tokenizer': 'words-1', 'tokens': len(regexp_extract_all(coalesce(text, ''), '{SPACE_WORD}'))}},
    {{'tokenizer': 'pieces-2', 'tokens': len(regexp_extract_all(coalesce(text, ''), '{PATTERNS["pieces-2"]}'))}}
  ]) AS c
  FROM documents
)
SELECT source, lang, c.tokenizer AS tokenizer, count(*) AS docs, sum(c.tokens)::BIGINT AS tokens
FROM counted
GROUP BY ALL
"""
