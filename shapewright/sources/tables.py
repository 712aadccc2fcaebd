"""Table scans, profiles and written copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shapewright.operators.ranking import sorted_if
from shapewright.operators.sets import append_all


def scan(spark: SparkSession, folder: str, name: str, schema: StructType | str | None = None) -> DataFrame:
    """The parquet table ``name`` in a folder; with a schema no footer is read to plan the scan."""
    reader = spark.read.schema(schema) if schema is not None else spark.read
    return reader.parquet(f"{folder}/{name}.parquet")


def scan_named(spark: SparkSession, name: str) -> DataFrame:
    """The table or view whose name is in a variable, passed as a parameter and never as SQL text."""
    return spark.sql("SELECT * FROM IDENTIFIER(:name)", args={"name": name})


def values(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """Inline rows."""
    return spark.createDataFrame(rows, schema)


def profile_tables(tables: dict[str, DataFrame], sort: bool = False) -> DataFrame:
    """Rows and file bytes per table in one job. The tables must be plain file scans.

    Counts are combined per file before the shuffle, so what moves is one row per file and task.
    """
    per_file = [
        df.select(
            F.lit(name).alias("table_name"),
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_size").alias("_bytes"),
        )
        .groupBy("table_name", "_file")
        .agg(F.count(F.lit(1)).alias("_rows"), F.max("_bytes").alias("_bytes"))
        for name, df in tables.items()
    ]
    sizes = append_all(*per_file).groupBy("table_name").agg(F.sum("_rows").alias("n"), F.sum("_bytes").alias("b"))
    # a table without rows has no files in the scan
    spark = next(iter(tables.values())).sparkSession
    names = values(spark, [(name,) for name in tables], "table_name string")
    profile = names.join(sizes, "table_name", "left").select(
        "table_name", F.coalesce("n", F.lit(0)).alias("total_rows"), F.coalesce("b", F.lit(0)).alias("total_bytes")
    )
    return sorted_if(profile, sort, F.col("total_rows").desc(), "table_name")


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column in ordinal order: type, nullability, NULL count, approximate distinct count.

    All columns are measured in one pass.
    """
    measured = df.agg(
        F.array(
            *[
                F.struct(
                    F.lit(at).alias("ordinal"),
                    F.lit(f.name).alias("column_name"),
                    F.lit(f.dataType.simpleString()).alias("data_type"),
                    F.lit(f.nullable).alias("is_nullable"),
                    F.count_if(F.col(f"`{f.name}`").isNull()).alias("null_rows"),
                    F.approx_count_distinct(F.col(f"`{f.name}`")).alias("distinct_estimate"),
                )
                for at, f in enumerate(df.schema.fields, 1)
            ]
        ).alias("columns")
    )
    return measured.select(F.inline("columns"))


def materialise(df: DataFrame, path: str) -> DataFrame:
    """Writes the rows to a folder and returns the written table. The order of rows is not kept."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
