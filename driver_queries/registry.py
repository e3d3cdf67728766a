"""Query registry and the shared presentation of Spark and SQL results.

Both sides of a query are shaped by one column list, for example
``"series ts:t n:i value total:2"``: plain text, timestamp, integer, number with
6 (default) or 2 decimals. Numbers are rounded after a shift by a fixed fraction
of the last digit, so that a sum which ends exactly between two roundings does
not come out differently when its terms are added in another order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpanel.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

SHIFT = 0.1234567


def _parse(columns: str) -> list[tuple[str, str]]:
    out = []
    for item in columns.split():
        name, _, kind = item.partition(":")
        out.append((name, kind or "s"))
    return out


def _spark_column(name: str, kind: str):
    c = F.col(f"`{name}`")
    if kind == "t":
        return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(name)
    if kind == "d":
        return F.date_format(c, "yyyy-MM-dd").alias(name)
    if kind == "i":
        return c.cast("bigint").alias(name)
    if kind == "s":
        return c.cast("string").alias(name)
    digits = int(kind)
    return (F.round(c.cast("double") + SHIFT * 10.0**-digits, digits) + F.lit(0.0)).alias(name)


def _sql_column(name: str, kind: str) -> str:
    c = f'"{name}"'
    if kind == "t":
        return f"strftime({c}, '%Y-%m-%d %H:%M:%S') AS {c}"
    if kind == "d":
        return f"strftime({c}, '%Y-%m-%d') AS {c}"
    if kind == "i":
        return f"CAST({c} AS BIGINT) AS {c}"
    if kind == "s":
        return f"CAST({c} AS VARCHAR) AS {c}"
    digits = int(kind)
    shift = f"{SHIFT * 10.0**-digits:.17g}"
    return f"round(CAST({c} AS DOUBLE) + CAST({shift} AS DOUBLE), {digits}) + 0.0 AS {c}"


def present(df: DataFrame, columns: str) -> DataFrame:
    return df.select(*[_spark_column(n, k) for n, k in _parse(columns)])


def present_sql(body: str, columns: str) -> str:
    picked = ",\n       ".join(_sql_column(n, k) for n, k in _parse(columns))
    return f"SELECT {picked}\nFROM (\n{body.strip()}\n) AS result"


def query(name: str, columns: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query with the columns it reports and, where SQL can say it, its twin."""

    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return present(fn(tune(spark), sf_dir), columns)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = present_sql(sql, columns)
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
