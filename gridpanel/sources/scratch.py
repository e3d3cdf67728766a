"""Where intermediate tables go: the shared folder the cluster names."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    folder = spark.conf.get(SETTING, None)
    if not folder:
        raise ValueError(f"set {SETTING} to a folder that the driver and all executors share")
    return folder


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/gridpanel/{spark.sparkContext.applicationId}"


_MADE: dict[str, list[str]] = {}


def new_path(spark: SparkSession, name: str) -> str:
    """A path nothing else writes to, in a folder of the application's own."""
    path = f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def made(spark: SparkSession) -> list[str]:
    """The paths given out to this application, oldest first, those that were removed excepted."""
    return list(_MADE.get(spark.sparkContext.applicationId, []))


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Remove landed tables that no table in use is read from any more."""
    context = spark.sparkContext
    for name in paths:
        path = context._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)
    gone = set(paths)
    _MADE[context.applicationId] = [p for p in made(spark) if p not in gone]


def clear(spark: SparkSession) -> None:
    """Remove what this application has landed. Tables that were read from there are
    lazy, so this is for the end of the application, or of the work on its results."""
    remove(spark, [_own_folder(spark)])
    _MADE.pop(spark.sparkContext.applicationId, None)


def landed(df: DataFrame, name: str) -> DataFrame:
    """Write a table once and go on from the file: for a small table with a long
    history that is read several times. A lost executor costs a re-read."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
