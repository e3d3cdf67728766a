"""Landed raw feeds to tidy series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpanel import fixed_values as fv
from gridpanel import schemas
from gridpanel.operators import clean


def read_payloads(spark: SparkSession, path: str, multi_line: bool = False) -> DataFrame:
    """Indicator payloads, one document per line or per file, as rows.

    ``file`` and ``position`` give the order in which values arrived.
    """
    docs = (
        spark.read.schema(schemas.INDICATOR_PAYLOAD)
        .option("multiLine", multi_line)
        .json(path)
        .select(F.col("_metadata.file_path").alias("file"), "indicator")
    )
    return docs.select(
        "file", F.col("indicator.id").alias("id"),
        F.posexplode("indicator.values").alias("position", "v"),
    ).select(
        "file", "id", "position",
        F.try_to_timestamp(F.col("v.datetime_utc")).alias("ts"),
        F.col("v.value").alias("value"),
    )


def _name_of(id_column: str, names: dict[int, str]) -> Column:
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), F.col(id_column))


def indicator_series(payloads: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """Hourly series by name. Area-summed indicators add up the rows of a time;
    of the others the first row counts."""
    names = fv.INDICATOR_NAMES if names is None else names
    named = payloads.withColumn("series", _name_of("id", names)).where(
        F.col("series").isNotNull() & F.col("ts").isNotNull()
    )
    areas = F.col("id").isin(fv.AREA_SUMMED_INDICATORS)
    added = named.where(areas).groupBy("series", "ts").agg(F.sum("value").alias("value"))
    first = clean.first_wins(
        named.where(~areas).select("series", "ts", "file", "position", "value"),
        ["series", "ts"], ["file", "position"],
    ).select("series", "ts", "value")
    return clean.hourly_mean(first.unionByName(added))


def monthly_capacity(payloads: DataFrame, names: dict[int, str] | None = None) -> DataFrame:
    """Monthly sums by capacity name."""
    names = fv.MONTHLY_CAPACITY_NAMES if names is None else names
    named = payloads.withColumn("series", _name_of("id", names)).where(
        F.col("series").isNotNull() & F.col("ts").isNotNull()
    )
    return clean.monthly_sum(named)


def matching_column(columns: list[str], marks: list[str]) -> str | None:
    """First column whose name contains all marks."""
    return next((c for c in columns if all(m in c for m in marks)), None)


def hydro_feed(df: DataFrame, chunk: str) -> DataFrame:
    """Hourly hydro columns from overlapping chunks of a vendor table.

    Columns are found by parts of their names. Each chunk is averaged by hour;
    where chunks overlap the first one counts. Pumping is 0 where it is missing.
    """
    found = {
        out: matching_column(df.columns, marks) for out, marks in fv.HYDRO_FEED_COLUMNS.items()
    }
    hour = F.date_trunc("hour", F.col("datetime").cast("timestamp"))
    means = df.groupBy(F.col(chunk).alias("_chunk"), hour.alias("datetime")).agg(
        *[F.avg(F.col(f"`{c}`")).alias(out) for out, c in found.items() if c is not None]
    )
    hourly = clean.first_wins(means, ["datetime"], ["_chunk"]).drop("_chunk")
    pumped = [c for c in fv.HYDRO_FEED_COLUMNS if c.startswith("pumped")]
    return hourly.withColumns(
        {c: F.coalesce(c, F.lit(0.0)) if c in hourly.columns else F.lit(0.0) for c in pumped}
    )


def coerced_prices(raw: DataFrame, date: str, value: str, order: list[str]) -> DataFrame:
    """Daily prices from text: bad dates and numbers are dropped, the first row
    of a date counts."""
    typed = raw.select(
        F.to_date(F.try_to_timestamp(F.col(date))).alias("date"),
        F.col(value).try_cast("double").alias("price"),
        *order,
    ).na.drop(subset=["date", "price"])
    return clean.first_wins(typed, ["date"], order).select("date", "price")
