"""Model tables and result tables on storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MISSING = "NA"


def read_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV table with a header and a fixed schema; ``NA`` is null."""
    return (
        spark.read.schema(schema).option("header", True).option("nullValue", MISSING)
        .option("enforceSchema", False).csv(path)
    )


def write_results(df: DataFrame, path: str) -> None:
    """One directory per scenario, columns in the table's order.

    Rebalanced, not hashed, by scenario: a large scenario is cut into several
    files instead of going through one task.
    """
    df.hint("rebalance", "scenario").write.mode("overwrite").partitionBy("scenario").parquet(path)


def read_results(spark: SparkSession, path: str, scenario: str | None = None) -> DataFrame:
    """Results of one scenario (other directories are not read) or of all."""
    df = spark.read.parquet(path)
    return df if scenario is None else df.where(F.col("scenario") == scenario)


def read_scenario_files(
    spark: SparkSession, folder: str, table: str, schema: T.StructType
) -> DataFrame:
    """Per-scenario files ``<scenario>_<table>.csv``; absent ones are not missed."""
    rows = (
        spark.read.schema(schema).option("header", True).option("nullValue", MISSING)
        .option("pathGlobFilter", f"*_{table}.csv").option("recursiveFileLookup", True)
        .csv(folder)
    )
    name = F.regexp_replace(F.col("_metadata.file_name"), "%20", " ")
    return rows.withColumn("scenario", F.regexp_extract(name, rf"^(.*)_{table}\.csv$", 1))


def export_csv(df: DataFrame, path: str) -> None:
    """A small table (a report) as one CSV file; the rows alone go through one task."""
    df.repartition(1).write.mode("overwrite").option("header", True).option("nullValue", MISSING).csv(path)
