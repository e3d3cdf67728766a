"""Calendar keys of a timestamp column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridpanel.functions.scalars import as_col


def hour_number(ts: Column | str) -> Column:
    """Whole hours since the epoch: an integer position on the hourly calendar."""
    return F.floor(F.unix_timestamp(as_col(ts).cast("timestamp")) / 3600).cast("bigint")


def hour_start(number: Column | str) -> Column:
    """Timestamp of an hour number."""
    return F.timestamp_seconds(as_col(number) * 3600)


def year_month(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), "yyyy-MM")


def month_day_hour(ts: Column | str) -> Column:
    return F.date_format(as_col(ts), "MM-dd-HH")


def month_start(year: Column | str, month: Column | str) -> Column:
    return F.make_date(as_col(year), as_col(month), F.lit(1))


def month_label(month: Column | str) -> Column:
    """Month number to its three-letter English name."""
    return F.date_format(F.make_date(F.lit(2000), as_col(month), F.lit(1)), "MMM")


def by_month(values: list[float], month: Column | str) -> Column:
    """The month's entry of a 12-element list."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), as_col(month).cast("int"))
