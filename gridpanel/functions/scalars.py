"""Scalar column expressions. Nulls pass through unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridpanel import fixed_values as fv


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(x: Column | str, y: Column | str) -> Column:
    """``x / y``; null where ``y`` is 0."""
    return as_col(x) / F.nullif(as_col(y), F.lit(0.0))


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Bound ``x``. ``greatest``/``least`` skip nulls, hence the guard."""
    c = as_col(x)
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(float(low)))
    if high is not None:
        out = F.least(out, F.lit(float(high)))
    return F.when(c.isNotNull(), out)


def capacity_factor(gen: Column | str, cap: Column | str) -> Column:
    """Output over capacity in [0, 1]; 0 where capacity is 0 or a side is missing."""
    return F.coalesce(clip(ratio(gen, cap), 0.0, 1.0), F.lit(0.0))


def import_part(net: Column | str) -> Column:
    return clip(net, low=0.0)


def export_part(net: Column | str) -> Column:
    return F.abs(clip(net, high=0.0))


def price_floor(price: Column | str, floor: float = fv.PRICE_FLOOR) -> Column:
    return clip(price, low=floor)


def snap_small(x: Column | str, tol: float = fv.SMALL_VALUE) -> Column:
    """Solver-noise sized values become 0."""
    c = as_col(x)
    return F.when(F.abs(c) < tol, F.lit(0.0)).otherwise(c)


def add_up(cols) -> Column:
    """Sum of columns; null if any of them is null."""
    total = None
    for c in cols:
        total = as_col(c) if total is None else total + as_col(c)
    return F.lit(0.0) if total is None else total


def fuel_cost_eur_mwh(fuel: str, quote: Column | str, usd_per_eur: Column | str | None = None) -> Column:
    """EUR per MWh of fuel from a quote per tonne, gallon or pound.

    A quote that is in EUR already is given without an exchange rate.
    """
    c = as_col(quote)
    if usd_per_eur is not None:
        c = ratio(c, usd_per_eur)
    return c / F.lit(fv.MWH_PER_UNIT[fuel])
