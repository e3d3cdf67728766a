"""Panels derived from the driver's tables.

``panel`` casts the line items as a power system: each line is output of one of
the 17 technologies (by part type and return flag) in one of four steps of its
ship date; monthly peaks stand for capacity. It has the columns of the hourly
panel, so the operators run on it unchanged.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driver_queries.registry import table
from gridpanel import fixed_values as fv
from gridpanel.functions import calendars, scalars
from gridpanel.operators import clean

PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
RETURN_FLAGS = ["A", "N", "R"]
# ship dates lie in 1995-01 to 2001-12
MAX_MONTHS = 84
MAX_DAYS = 2557
# base years have to be whole; the last line items are shipped in November 2001
YEARS = [1995, 1996, 1997, 1998, 1999, 2000]

GEN = {t: fv.GENERATION_COLUMN[t] for t in fv.TECHNOLOGIES}
CAP = {t: fv.CAPACITY_COLUMN[t] for t in fv.TECHNOLOGIES}
# sector of each line number
SECTOR_LINES = {"residential": [1, 2, 3], "commercial": [4, 5], "industrial": [6, 7]}
BORDER_LINE = {"France": 1, "Portugal": 2, "Morocco": 3}
DEMAND_SCALE = 2.0
# cost column -> (level, slope, source column)
COSTS = {
    "cost_coal_eur_gwh": (12000.0, 50000.0, "l_tax"),
    "cost_gas_eur_gwh": (25000.0, 200000.0, "l_discount"),
    "cost_diesel_eur_gwh": (60000.0, 100000.0, "l_tax"),
    "cost_uranium_eur_gwh": (1500.0, 1000.0, "l_discount"),
    "eu_ets_price_eur_tco2": (30.0, 500.0, "l_tax"),
}
FACTORS = {"nuclear": "nuclear", "solar_pv": "solar_pv", "solar_thermal": "solar_thermal", "wind": "wind"}


def technology_of(part_type, flag):
    """Technology of a line: position of (part type, flag) modulo 17."""
    k = (
        F.array_position(F.array(*[F.lit(p) for p in PART_TYPES]), part_type) * 3
        + F.array_position(F.array(*[F.lit(f) for f in RETURN_FLAGS]), flag)
        - 4
    )
    names = F.array(*[F.lit(t) for t in fv.TECHNOLOGIES])
    return F.element_at(names, (F.pmod(k, F.lit(len(fv.TECHNOLOGIES))) + 1).cast("int"))


def lines(spark, sf_dir):
    """Line items with their technology and time step."""
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    step = F.col("l_shipdate").cast("timestamp") + F.make_dt_interval(
        hours=(F.pmod("l_orderkey", F.lit(4)) * 6).cast("int")
    )
    return (
        table(spark, sf_dir, "lineitem")
        .join(part, "l_partkey")
        .withColumn("technology", technology_of(F.col("p_type"), F.col("l_returnflag")))
        .withColumn("ts", step)
    )


def _quantity_where(condition):
    return F.sum(F.when(condition, F.col("l_quantity")).otherwise(0.0))


def step_measures() -> dict:
    """Aggregates of the lines of one time step."""
    sign = F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(-F.col("l_quantity"))
    out = {"spot_price_eur_mwh": F.avg(F.col("l_extendedprice") / F.col("l_quantity")) / 20.0}
    for s, numbers in SECTOR_LINES.items():
        out[f"{s}_demand_gwh"] = DEMAND_SCALE * _quantity_where(F.col("l_linenumber").isin(numbers))
    for t, c in GEN.items():
        out[c] = _quantity_where(F.col("technology") == t)
    out["pumped_hydro_consumption_gwh"] = _quantity_where(
        (F.col("technology") == "pumped_hydro") & (F.col("l_linestatus") == "O")
    )
    for b, n in BORDER_LINE.items():
        out[f"net_raw_{b}_gwh"] = F.sum(F.when(F.col("l_linenumber") == n, sign).otherwise(0.0))
    for c, (level, slope, source) in COSTS.items():
        out[c] = level + slope * F.avg(source)
    return out


def panel(spark, sf_dir):
    """The wide panel: one row per time step, columns as in the hourly panel."""
    steps = lines(spark, sf_dir).groupBy("ts").agg(
        *[e.alias(n) for n, e in step_measures().items()]
    )
    # a month has at most 124 steps; a window spares the second pass over the lines
    month = Window.partitionBy("year_month")
    wide = steps.withColumn("year_month", calendars.year_month("ts")).withColumns(
        {CAP[t]: F.max(GEN[t]).over(month) for t in fv.TECHNOLOGIES}
    )
    wide = wide.withColumn("pumped_hydro_pump_cap_gw", 0.7 * F.col("pumped_hydro_turb_cap_gw"))
    wide = wide.withColumns(
        {f"{t}_cap_factor": scalars.capacity_factor(GEN[t], CAP[t]) for t in FACTORS}
    )
    for b in fv.BORDERS:
        wide = clean.signed_split(wide, f"net_raw_{b}_gwh", b, "gwh").drop(f"net_raw_{b}_gwh")
    return clean.calendar_parts(wide)


# --- the same panel in SQL ------------------------------------------------------------------


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


TECHNOLOGY_SQL = (
    f"list_extract({_list(fv.TECHNOLOGIES)}, 1 + (list_position({_list(PART_TYPES)}, p_type) * 3 "
    f"+ list_position({_list(RETURN_FLAGS)}, l_returnflag) - 4) % {len(fv.TECHNOLOGIES)})"
)

LINES_SQL = f"""
lines AS (
  SELECT l.*, {TECHNOLOGY_SQL} AS technology,
         l_shipdate + to_hours(CAST((l_orderkey % 4) * 6 AS INTEGER)) AS ts
  FROM lineitem l JOIN part ON l_partkey = p_partkey)
"""


def _sum_case(condition: str) -> str:
    return f"sum(CASE WHEN {condition} THEN l_quantity ELSE 0.0 END)"


def _step_columns_sql() -> str:
    out = ["avg(l_extendedprice / l_quantity) / 20.0 AS spot_price_eur_mwh"]
    for s, numbers in SECTOR_LINES.items():
        inside = ", ".join(map(str, numbers))
        out.append(
            f"CAST({DEMAND_SCALE} AS DOUBLE) * {_sum_case(f'l_linenumber IN ({inside})')} "
            f"AS {s}_demand_gwh"
        )
    for t, c in GEN.items():
        condition = f"technology = '{t}'"
        out.append(f"{_sum_case(condition)} AS {c}")
    pumping = "technology = 'pumped_hydro' AND l_linestatus = 'O'"
    out.append(f"{_sum_case(pumping)} AS pumped_hydro_consumption_gwh")
    for b, n in BORDER_LINE.items():
        out.append(
            f"sum(CASE WHEN l_linenumber = {n} THEN CASE WHEN l_linestatus = 'O' THEN l_quantity "
            f"ELSE -l_quantity END ELSE 0.0 END) AS net_flows_{b}_gwh"
        )
    for c, (level, slope, source) in COSTS.items():
        out.append(f"{level} + {slope} * avg({source}) AS {c}")
    return ",\n         ".join(out)


def _panel_columns_sql() -> str:
    out = [f"c.{CAP[t]}" for t in fv.TECHNOLOGIES]
    out.append("CAST(0.7 AS DOUBLE) * c.pumped_hydro_turb_cap_gw AS pumped_hydro_pump_cap_gw")
    for t in FACTORS:
        out.append(
            f"coalesce(least(greatest(s.{GEN[t]} / nullif(c.{CAP[t]}, 0), 0.0), 1.0), 0.0) "
            f"AS {t}_cap_factor"
        )
    for b in fv.BORDERS:
        out.append(f"greatest(s.net_flows_{b}_gwh, 0.0) AS imports_{b}_gwh")
        out.append(f"abs(least(s.net_flows_{b}_gwh, 0.0)) AS exports_{b}_gwh")
    out += [
        "CAST(year(s.ts) AS INTEGER) AS year", "CAST(month(s.ts) AS INTEGER) AS month",
        "CAST(day(s.ts) AS INTEGER) AS day", "CAST(hour(s.ts) AS INTEGER) AS hour",
    ]
    return ",\n         ".join(out)


PANEL_SQL = f"""
{LINES_SQL.strip()},
steps AS (
  SELECT ts, strftime(ts, '%Y-%m') AS year_month,
         {_step_columns_sql()}
  FROM lines GROUP BY ts),
caps AS (
  SELECT year_month,
         {", ".join(f"max({GEN[t]}) AS {CAP[t]}" for t in fv.TECHNOLOGIES)}
  FROM steps GROUP BY year_month),
panel AS (
  SELECT s.*,
         {_panel_columns_sql()}
  FROM steps s JOIN caps c ON s.year_month = c.year_month)
"""
