"""A training corpus from raw documents: five stages, each an operator of ``shapewright.llm``.

Each stage gets the documents that the one before kept. Between stages they are written to the folder
in spark.checkpoint.dir and read again. Rows are carried as one struct, so columns of any name pass through.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapewright.llm import decontamination, jaccard, mixing, pii, toxicity
from shapewright.llm.common import Stages, table


_inner: dict[str, list[Stages]] = {}  # by application: what the operators of the stage before have written


def _drop_inner(spark: SparkSession, docs: DataFrame) -> None:
    """Deletes the intermediate tables of the stage before, as its result has been written; not those that ``docs`` reads."""
    read = docs.inputFiles()
    for stages in _inner.pop(spark.sparkContext.applicationId, []):
        done = [n for n, folder in stages.folders.items() if not any(folder.split("/")[-1] in file for file in read)]
        stages.drop(*done)


def _stage(function: Callable) -> Callable:
    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _drop_inner(spark, docs)
        before = len(Stages.written)
        result = function(spark, docs, sf_dir)
        _inner[spark.sparkContext.applicationId] = Stages.written[before:]
        return result

    return run_stage


def _carried(docs: DataFrame) -> DataFrame:
    """_row (all columns), doc_id, source and text."""
    columns = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    return docs.select(F.struct(*columns).alias("_row"), "doc_id", "source", "text")


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model, learned from the labels of those at hand, does not reject.

    Null and empty texts stay unless the bias alone rejects; without labels all stay. Repeated rows are judged each.
    """
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.toxic_scores(_carried(docs), model, keep=("_row",))
    return scored.filter("predicted = 0").select("_row.*")


@_stage
def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of near duplicates; those without id come last.

    Of rows that repeat an id one stays. Documents without words are linked with nothing and stay.
    """
    stages = Stages(spark)
    rows = stages.write("dedup-rows", _carried(docs).select("_row", "doc_id", "text", F.monotonically_increasing_id().alias("_uid")))
    linked = jaccard.link_classes(rows.select(F.col("_uid").alias("doc_id"), "text"))
    linked = linked.filter("size > 1").select(F.col("doc_id").alias("_uid"), F.col("component_id").alias("_class"))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "_uid")
    linked = stages.write("dedup-linked", linked)
    best = rows.select("_uid", "doc_id").join(linked, "_uid").groupBy("_class").agg(F.min(place).alias("best"))
    winners = best.select(F.col("best._uid").alias("_uid"))
    losers = stages.write("dedup-losers", linked.select("_uid").join(winners, "_uid", "left_anti"))
    return rows.join(losers, "_uid", "left_anti").select("_row.*")


@_stage
def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item is found. Without benchmark or text nothing is found."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    found = Stages(spark).write("contaminated", found.select(F.col("doc_id").alias("_id"), F.col("body").alias("_body")).distinct())
    own = _carried(docs).withColumn("_hash", F.xxhash64("text"))
    same = own["doc_id"].eqNullSafe(found["_id"]) & (own["_hash"] == found["_body"])
    return own.join(found, same, "left_anti").select("_row.*")


@_stage
def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data replaced by its kind in brackets, and n_chars to match."""
    found = pii.find_personal_data(_carried(docs), keep=("_row",))
    text = pii.redact(F.col("_row.text"), F.col("spans"))
    changed = found.select("_row", F.size("spans").alias("_spans"), text.alias("_text"))
    columns = {c: F.col("_row").getField(c) for c in docs.columns} | {"text": F.col("_text")}
    if "n_chars" in columns:
        counted = F.char_length("_text").cast(docs.schema["n_chars"].dataType)
        columns["n_chars"] = F.when(F.col("_spans") > 0, counted).otherwise(columns["n_chars"])
    return changed.select(*[columns[c].alias(c) for c in docs.columns])


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken, numbered from 1 in ``mix_copy``."""
    name = "mix_copy"
    while name in docs.columns:
        name += "_"
    mixed = mixing.mix(_carried(docs), keep=("_row",)).filter("copies > 0")
    return mixed.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("_copy")).select("_row.*", F.col("_copy").cast("int").alias(name))


STAGES = [
    ("toxicity", drop_toxic),
    ("jaccard_join", keep_one_of_each_class),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
]

#: SQL states neither the toxicity model nor the templates; tests compare with brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the table of documents."""
    stages = Stages(spark)
    docs = table(spark, sf_dir, "documents")
    for i, (name, function) in enumerate(STAGES):
        docs = stages.write(f"pipeline-{name}", function(spark, docs, sf_dir))
        if i:
            stages.drop(f"pipeline-{STAGES[i - 1][0]}")
    _drop_inner(spark, docs)
    return docs
