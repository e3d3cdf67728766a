"""Keyed draws, estimate distributions and sampled projections on the driver's tables.

Customers or suppliers stand for iterations, the region they live in for the
scenario: the five regions take the settings of the five scenarios.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from driver_queries.bases import LINES_SQL, PANEL_SQL, YEARS, lines, panel
from driver_queries.registry import query, table
from gridpanel import fixed_values as fv
from gridpanel import schemas
from gridpanel.functions import keyed_random as rnd
from gridpanel.operators import asof, draws, project
from gridpanel.sources import scratch

SEED = 7
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
SETTINGS = [(region, *row[1:]) for region, row in zip(REGIONS, fv.SCENARIO_ROWS)]
SETTING_NAMES = [f.name for f in schemas.SCENARIOS.fields]


def settings(spark):
    return spark.createDataFrame(SETTINGS, schemas.SCENARIOS)


def runs(spark, sf_dir, who="customer"):
    """One iteration per customer or supplier, with its scenario's settings."""
    key, nation_key = {"customer": ("c_custkey", "c_nationkey"), "supplier": ("s_suppkey", "s_nationkey")}[who]
    people = table(spark, sf_dir, who).select(
        F.col(key).alias("iteration"), F.col(nation_key).alias("n_nationkey")
    )
    region = table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("n_regionkey"), F.col("r_name").alias("scenario")
    )
    return (
        people.join(table(spark, sf_dir, "nation"), "n_nationkey")
        .join(region, "n_regionkey")
        .join(F.broadcast(settings(spark)), "scenario")  # five fixed rows
        .select(*SETTING_NAMES, "iteration", "n_name")
    )


# --- SQL pieces ----------------------------------------------------------------------------


def runs_sql(who="customer") -> str:
    key, nation_key = {"customer": ("c_custkey", "c_nationkey"), "supplier": ("s_suppkey", "s_nationkey")}[who]
    rows = ", ".join(
        "(" + ", ".join(
            f"'{v}'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else f"CAST({v} AS DOUBLE)"
            for v in row
        ) + ")"
        for row in SETTINGS
    )
    return f"""
settings({", ".join(SETTING_NAMES)}) AS (VALUES {rows}),
runs AS (
  SELECT s.*, {key} AS iteration, n_name
  FROM {who} JOIN nation ON n_nationkey = {nation_key} JOIN region ON r_regionkey = n_regionkey
  JOIN settings s ON s.scenario = r_name)
"""


def uniform_sql(*key: str, seed: int = SEED) -> str:
    text = f"concat_ws('|', '{seed}', {', '.join(f'CAST({k} AS VARCHAR)' for k in key)})"
    return (
        f"((CAST(('0x' || substr(md5({text}), 1, 8)) AS BIGINT) + CAST(0.5 AS DOUBLE))"
        f" / CAST(4294967296 AS DOUBLE))"
    )


def normal_sql(*key: str, seed: int = SEED) -> str:
    u1, u2 = uniform_sql(*key, "'radius'", seed=seed), uniform_sql(*key, "'angle'", seed=seed)
    return f"(sqrt(-2.0 * ln({u1})) * cos(2.0 * pi() * {u2}))"


def window_columns_sql(years) -> str:
    listed = "[" + ", ".join(map(str, years)) + "]"
    year = uniform_sql("scenario", "iteration", "'base_year'")
    day = uniform_sql("scenario", "iteration", "'day_start'")
    return (
        f"list_extract({listed}, CAST(least(floor({year} * {len(years)}), {len(years) - 1}) + 1 AS BIGINT)) AS base_year, "
        f"CAST(floor({day} * 21) + 1 AS INTEGER) AS day_start"
    )


WINDOW_COLUMNS_SQL = window_columns_sql(YEARS)


# --- draws -------------------------------------------------------------------------------------


@query(
    "keyed_uniform", "scenario iteration:i u:9",
    f"WITH {runs_sql()} SELECT scenario, iteration, {uniform_sql('scenario', 'iteration', chr(39) + 'wind' + chr(39))} AS u FROM runs",
)
def keyed_uniform(spark, sf_dir):
    return runs(spark, sf_dir).withColumn(
        "u", rnd.uniform(SEED, "scenario", "iteration", F.lit("wind"))
    )


@query(
    "normal_draw", "scenario iteration:i z:6",
    f"WITH {runs_sql()} SELECT scenario, iteration, {normal_sql('scenario', 'iteration')} AS z FROM runs",
)
def normal_draw(spark, sf_dir):
    return runs(spark, sf_dir).withColumn("z", rnd.normal(SEED, "scenario", "iteration"))


@query(
    "window_draw", "scenario iteration:i base_year:i day_start:i",
    f"WITH {runs_sql()} SELECT scenario, iteration, {WINDOW_COLUMNS_SQL} FROM runs",
)
def window_draw(spark, sf_dir):
    return draws.draw_windows(runs(spark, sf_dir), SEED, YEARS)


@query(
    "iteration_blocks", "scenario iteration:i iter_block:i suppliers:i",
    """WITH counts AS (
      SELECT r_name AS scenario, count(*) AS suppliers FROM supplier
      JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1)
    SELECT scenario, i AS iteration, (i - 1) // 100 AS iter_block, suppliers
    FROM (SELECT scenario, suppliers, unnest(generate_series(1, suppliers * 25)) AS i FROM counts) g""",
)
def iteration_blocks(spark, sf_dir):
    """Every scenario gets 25 iterations per supplier, in blocks of 100."""
    counts = runs(spark, sf_dir, "supplier").groupBy("scenario").agg(F.count("*").alias("suppliers"))
    return draws.iterations(counts, F.col("suppliers") * 25, block=100)


# --- estimates: monthly means of the last year against the mean of each base year ---------------

BASE = [1995, 1996, 1997, 1998, 1999]
ESTIMATE_YEAR = 2000

ESTIMATES_SQL = f"""
{LINES_SQL.strip()},
hist AS (SELECT technology AS variable, year(ts) AS base_year, avg(l_quantity) AS hist_mean
         FROM lines WHERE year(ts) BETWEEN {BASE[0]} AND {BASE[-1]} GROUP BY 1, 2),
est AS (SELECT technology AS variable, month(ts) AS month,
               CASE WHEN technology = 'coal' THEN 0.0
                    WHEN technology IN ('gas_turbine', 'diesel') THEN NULL ELSE avg(l_quantity) END AS estimate,
               CASE month(ts) % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 ELSE 1.0 END AS weight
        FROM lines WHERE year(ts) = {ESTIMATE_YEAR} GROUP BY 1, 2),
points AS (SELECT h.base_year, h.variable, e.month, CAST(e.weight AS DOUBLE) AS weight,
                  coalesce(round(e.estimate / nullif(h.hist_mean, 0) - 1, 3), 0.0) AS delta
           FROM est e JOIN hist h ON h.variable = e.variable)
"""


def estimates_table(spark, sf_dir):
    """Wide, as it is published: a row per variable and source, a column per base year."""
    rows = lines(spark, sf_dir).select(
        F.col("technology").alias("variable"), F.year("ts").alias("year"),
        F.month("ts").alias("month"), "l_quantity",
    )
    hist = rows.where(F.col("year").between(BASE[0], BASE[-1])).groupBy("variable").agg(
        *[F.avg(F.when(F.col("year") == y, F.col("l_quantity"))).alias(f"hist_mean_value_{y}") for y in BASE]
    )
    mean = F.avg("l_quantity")
    known = F.when(F.col("variable") == "coal", F.lit(0.0)).when(
        ~F.col("variable").isin("gas_turbine", "diesel"), F.col("mean")
    )
    weight = F.element_at(F.array(F.lit(0.2), F.lit(0.5), F.lit(1.0)), (F.col("month") % 3 + 1).cast("int"))
    est = (
        rows.where(F.col("year") == ESTIMATE_YEAR)
        .groupBy("variable", "month").agg(mean.alias("mean"))
        .select("variable", "month", known.alias("estimate"), weight.alias("weight"))
    )
    return est.join(hist, "variable").withColumns(
        {f"delta_wrt_{y}": draws.estimate_to_delta("estimate", f"hist_mean_value_{y}") for y in BASE}
    )


def estimate_points(spark, sf_dir):
    """The estimates are a small stored table; statistics, grids and draws read it."""
    stored = scratch.landed(estimates_table(spark, sf_dir), "estimates")
    return draws.long_estimates(stored, BASE)


@query(
    "estimate_delta", "variable month:i weight:2 " + " ".join(f"delta_wrt_{y}:3" for y in BASE),
    f"""WITH {ESTIMATES_SQL} SELECT variable, month, weight,
      {", ".join(f"max(CASE WHEN base_year = {y} THEN delta END) AS delta_wrt_{y}" for y in BASE)}
    FROM points GROUP BY 1, 2, 3""",
)
def estimate_delta(spark, sf_dir):
    return estimates_table(spark, sf_dir)


@query(
    "delta_lookup", "variable base_year:i weight:2 delta:3",
    f"WITH {ESTIMATES_SQL} SELECT variable, base_year, weight, delta FROM points",
)
def delta_lookup(spark, sf_dir):
    return estimate_points(spark, sf_dir)


STATS_SQL = """
stats AS (
  SELECT base_year, variable, avg(delta) AS mean,
         CASE WHEN min(delta) = max(delta) THEN 0.0 ELSE stddev_samp(delta) END AS sd,
         count(*) AS n, min(delta) AS mn, max(delta) AS mx
  FROM points GROUP BY 1, 2),
ruled AS (
  SELECT *, CASE WHEN mx = 0 AND sd = 0 THEN 'jitter' WHEN sd = 0 THEN 'constant'
                 WHEN sd < 0.05 THEN 'normal' ELSE 'kde' END AS rule FROM stats)
"""


@query(
    "delta_stats", "base_year:i variable mean:6 sd:6 n:i min:3 max:3 rule",
    f"WITH {ESTIMATES_SQL}, {STATS_SQL} SELECT base_year, variable, mean, sd, n, mn AS min, mx AS max, rule FROM ruled",
)
def delta_stats(spark, sf_dir):
    return draws.delta_stats(estimate_points(spark, sf_dir))


# --- kernel densities: account balances of the suppliers of a nation ---------------------------------

SUPPLIER_POINTS_SQL = """
points AS (
  SELECT 2000 AS base_year, n_name AS variable, s_acctbal / 10000.0 AS delta,
         CAST(CASE s_suppkey % 3 WHEN 0 THEN 0.2 WHEN 1 THEN 0.5 ELSE 1.0 END AS DOUBLE) AS weight
  FROM supplier JOIN nation ON n_nationkey = s_nationkey)
"""
GRID_SQL = """
ranges AS (
  SELECT *, mn - 4 * bw AS lo, (mx + 4 * bw - (mn - 4 * bw)) / 2047 AS step
  FROM (SELECT *, 0.75 * sd * pow(n, -0.2) AS bw FROM ruled WHERE rule = 'kde') r),
placed AS (
  SELECT p.base_year, p.variable, weight, (delta - lo) / step AS place
  FROM points p JOIN ranges r ON r.base_year = p.base_year AND r.variable = p.variable),
cells AS (
  SELECT base_year, variable, cell, sum(mass) AS mass FROM (
    SELECT base_year, variable, floor(place) AS cell, weight * (1 - (place - floor(place))) AS mass FROM placed
    UNION ALL
    SELECT base_year, variable, floor(place) + 1, weight * (place - floor(place)) FROM placed) c
  GROUP BY 1, 2, 3),
density AS (
  SELECT r.base_year, r.variable, g.i, any_value(r.lo + g.i * r.step) AS x,
         sum(c.mass * exp(-0.5 * pow((g.i - c.cell) * (r.step / r.bw), 2))) AS d
  FROM ranges r JOIN cells c ON r.base_year = c.base_year AND r.variable = c.variable,
       (SELECT unnest(generate_series(0, 2047)) AS i) g
  GROUP BY 1, 2, 3),
normed AS (
  SELECT base_year, variable, i, x, d / sum(d) OVER (PARTITION BY base_year, variable) AS pdf FROM density),
grid AS (
  SELECT *, sum(pdf) OVER (PARTITION BY base_year, variable ORDER BY i
                           ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cdf FROM normed),
-- first grid point of each level; the last level answers for everything above it
levels AS (SELECT base_year, variable, cdf, min(x) AS x FROM grid GROUP BY 1, 2, 3),
top AS (SELECT base_year, variable, max(x) AS x FROM grid GROUP BY 1, 2)
"""


def supplier_points(spark, sf_dir):
    weight = F.element_at(
        F.array(F.lit(0.2), F.lit(0.5), F.lit(1.0)), (F.col("s_suppkey") % 3 + 1).cast("int")
    )
    nation = table(spark, sf_dir, "nation").withColumnRenamed("n_nationkey", "s_nationkey")
    return table(spark, sf_dir, "supplier").join(nation, "s_nationkey").select(
        F.lit(2000).alias("base_year"), F.col("n_name").alias("variable"),
        (F.col("s_acctbal") / 10000.0).alias("delta"), weight.alias("weight"),
    )


@query(
    "kde_grid_cdf", "variable i:i x:6 pdf:9 cdf:7",
    f"WITH {SUPPLIER_POINTS_SQL}, {STATS_SQL}, {GRID_SQL} SELECT variable, i, x, pdf, cdf FROM grid",
)
def kde_grid_cdf(spark, sf_dir):
    points = supplier_points(spark, sf_dir)
    return draws.kde_grid(points, draws.delta_stats(points))


DRAWN_SQL = f"""
asked AS (
  SELECT w.*, r.variable, r.rule, r.mean, r.sd, r.mn, r.mx,
         {uniform_sql("scenario", "iteration", "r.variable", "'kde'")} AS u,
         {normal_sql("scenario", "iteration", "r.variable")} AS z
  FROM windows w JOIN ruled r ON {{on}}),
drawn AS (
  SELECT a.*, CASE rule WHEN 'jitter' THEN z * 0.05 WHEN 'constant' THEN mean
                        WHEN 'normal' THEN mean + z * sd
    ELSE least(greatest(coalesce(l.x, t.x), greatest(mn - 0.1 * abs(mn), -0.99)), mx + 0.1 * abs(mx))
    END AS delta
  FROM asked a
  ASOF LEFT JOIN levels l ON l.base_year = a.base_year AND l.variable = a.variable AND a.u <= l.cdf
  LEFT JOIN top t ON t.base_year = a.base_year AND t.variable = a.variable)
"""


@query(
    "kde_draw", "scenario iteration:i variable rule delta:6",
    f"""WITH {runs_sql()}, {SUPPLIER_POINTS_SQL}, {STATS_SQL}, {GRID_SQL},
    windows AS (SELECT *, 2000 AS base_year FROM runs),
    {DRAWN_SQL.format(on="r.variable = w.n_name")}
    SELECT scenario, iteration, variable, rule, delta FROM drawn""",
)
def kde_draw(spark, sf_dir):
    """Each customer draws from the balances of its nation's suppliers."""
    windows = runs(spark, sf_dir).withColumnRenamed("n_name", "variable").withColumn(
        "base_year", F.lit(2000)
    )
    known = draws.distributions(supplier_points(spark, sf_dir))
    return draws.draw_deltas(windows, known, SEED, max_groups=25)


@query(
    "asof_draw", "scenario iteration:i variable delta:6",
    f"""WITH {runs_sql()}, {SUPPLIER_POINTS_SQL}, {STATS_SQL}, {GRID_SQL},
    windows AS (SELECT *, 2000 AS base_year FROM runs),
    {DRAWN_SQL.format(on="r.variable = w.n_name")}
    SELECT scenario, iteration, variable, delta FROM drawn WHERE rule = 'kde'""",
)
def asof_draw(spark, sf_dir):
    """The draws from densities again, each looked up in the rows of its grid."""
    points = supplier_points(spark, sf_dir)
    stats = scratch.landed(draws.delta_stats(points).where(F.col("rule") == draws.KDE), "stats")
    grid = draws.kde_grid(points, stats).select("variable", "cdf", "x")
    asked = runs(spark, sf_dir).select("scenario", "iteration", F.col("n_name").alias("variable")).withColumn(
        "u", rnd.uniform(SEED, "scenario", "iteration", "variable", F.lit("kde"))
    )
    asked = asked.join(stats.select("variable", "min", "max"), "variable")
    found = asof.asof_join(asked, grid, ["variable"], "u", "cdf", 1 / 64, clamp=True)
    return found.withColumn("delta", draws.clamped(F.col("found.x")))


@query(
    "asof_events", "event_id:i value:6 seconds:0",
    """WITH bought AS (SELECT user_id, ts, min(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
    SELECT e.event_id, b.value, epoch(e.ts) - epoch(b.ts) AS seconds
    FROM events e ASOF LEFT JOIN bought b ON e.user_id = b.user_id AND e.ts >= b.ts WHERE e.event_type = 'view'""",
)
def asof_events(spark, sf_dir):
    """What each viewer had last bought, and how long ago."""
    events = table(spark, sf_dir, "events").withColumn("at", F.col("ts").cast("timestamp").cast("double"))
    views = events.where(F.col("event_type") == "view").select("event_id", "user_id", "at")
    bought = events.where(F.col("event_type") == "purchase").select("user_id", F.col("at").alias("bought_at"), "value")
    found = asof.asof_join(views, bought, ["user_id"], "at", "bought_at", 7 * 86_400.0, "backward")
    return found.select("event_id", F.col("found.value").alias("value"), (F.col("at") - F.col("found.bought_at")).alias("seconds"))


@query(
    "delta_draws", "scenario iteration:i base_year:i day_start:i variable rule delta:6",
    f"""WITH {runs_sql("supplier")}, {ESTIMATES_SQL}, {STATS_SQL}, {GRID_SQL},
    windows AS (SELECT scenario, iteration, {window_columns_sql(BASE)} FROM runs),
    {DRAWN_SQL.format(on="r.base_year = w.base_year")}
    SELECT scenario, iteration, base_year, day_start, variable, rule, delta FROM drawn""",
)
def delta_draws(spark, sf_dir):
    """Windows, distributions and draws of every variable for each supplier."""
    windows = (
        draws.draw_windows(runs(spark, sf_dir, "supplier"), SEED, BASE)
        .select("scenario", "iteration", "base_year", "day_start")
    )
    known = draws.distributions(estimate_points(spark, sf_dir))
    return draws.draw_deltas(windows, known, SEED, max_groups=len(BASE) * len(fv.TECHNOLOGIES))


# --- scenario rules --------------------------------------------------------------------------------

SPREAD = 0.1


def simple_draws(runs_table):
    """Every variable of an iteration with a normal growth factor."""
    names = F.array(*[F.lit(v) for v in fv.DRAWN_VARIABLES])
    return runs_table.withColumn("variable", F.explode(names)).withColumn(
        "delta", rnd.normal(SEED, "scenario", "iteration", "variable") * SPREAD
    )


SIMPLE_DRAWS_SQL = f"""
variables AS (SELECT unnest([{", ".join(f"'{v}'" for v in fv.DRAWN_VARIABLES)}]) AS variable),
simple AS (
  SELECT r.*, variable, {normal_sql("scenario", "iteration", "variable")} * {SPREAD} AS delta
  FROM runs r, variables),
adjusted AS (
  SELECT * REPLACE (CASE
      WHEN variable = 'coal_cap_gw' AND coal_phase_out THEN -1.0
      WHEN variable = 'nuclear_cap_gw' AND NOT nuclear_phase_out THEN 0.0
      WHEN variable = 'batteries_cap_gw' THEN delta * batt_cap_multiplier
      WHEN variable IN ({", ".join(f"'{v}'" for v in draws.DEPLOYED)}) THEN delta * ren_cap_multiplier
      ELSE delta END AS delta)
  FROM simple),
fan(source, target, factor) AS (VALUES
  ('pumped_hydro_turb_cap_gw', 'pumped_hydro_turb_cap_gw', CAST(1.0 AS DOUBLE)),
  ('pumped_hydro_turb_cap_gw', 'pumped_hydro_pump_cap_gw', CAST(0.7 AS DOUBLE)),
  ('total_national_demand_gwh', 'residential_demand_gwh', CAST(1.0 AS DOUBLE)),
  ('total_national_demand_gwh', 'commercial_demand_gwh', CAST(1.0 AS DOUBLE)),
  ('total_national_demand_gwh', 'industrial_demand_gwh', CAST(1.0 AS DOUBLE))),
fanned AS (
  SELECT a.scenario, a.iteration, coalesce(f.target, a.variable) AS variable,
         a.delta * coalesce(f.factor, 1.0) AS delta
  FROM adjusted a LEFT JOIN fan f ON f.source = a.variable)
"""


@query(
    "scenario_adjust", "scenario iteration:i variable delta:6",
    f"WITH {runs_sql()}, {SIMPLE_DRAWS_SQL} SELECT scenario, iteration, variable, delta FROM adjusted",
)
def scenario_adjust(spark, sf_dir):
    return draws.adjust(simple_draws(runs(spark, sf_dir)))


@query(
    "delta_fanout", "scenario iteration:i variable delta:6",
    f"WITH {runs_sql()}, {SIMPLE_DRAWS_SQL} SELECT * FROM fanned",
)
def delta_fanout(spark, sf_dir):
    return draws.fan_out(draws.adjust(simple_draws(runs(spark, sf_dir))))


# --- projections ---------------------------------------------------------------------------------------

VARIABLES = draws.fanned_variables()


def wide_draws(spark, sf_dir):
    """One row per supplier: window, settings and a growth factor per column."""
    windows = draws.draw_windows(runs(spark, sf_dir, "supplier").drop("n_name"), SEED, YEARS)
    keys = [*SETTING_NAMES, "iteration", "base_year", "day_start"]
    fanned = draws.fan_out(draws.adjust(simple_draws(windows)))
    return draws.to_wide(fanned, keys, VARIABLES)


def sampled_hours(spark, sf_dir):
    return project.expand(scratch.landed(panel(spark, sf_dir), "panel"), wide_draws(spark, sf_dir))


def projected_hours(spark, sf_dir):
    return project.project(sampled_hours(spark, sf_dir), VARIABLES)


def _projected_column(v: str) -> str:
    climate = ""
    if v in ("residential_demand_gwh", "commercial_demand_gwh"):
        listed = ", ".join(f"CAST({m} AS DOUBLE)" for m in fv.CLIMATE_MULTIPLIER)
        climate = f" * CASE WHEN w.climate_demand THEN list_extract([{listed}], p.month) ELSE 1.0 END"
    return f"p.{v} * (1.0 + w.d_{v}){climate} AS {v}"


PROJECTED_SQL = f"""
{PANEL_SQL.strip()}, {runs_sql("supplier").strip()}, {SIMPLE_DRAWS_SQL.strip()},
wide AS (
  SELECT r.scenario, r.iteration, any_value(elas_anomaly) AS elas_anomaly,
         any_value(hydro_anomaly) AS hydro_anomaly, any_value(climate_demand) AS climate_demand,
         {", ".join(f"max(CASE WHEN f.variable = '{v}' THEN f.delta END) AS d_{v}" for v in VARIABLES)}
  FROM runs r JOIN fanned f ON f.scenario = r.scenario AND f.iteration = r.iteration
  GROUP BY 1, 2),
sampled AS (SELECT w.*, {WINDOW_COLUMNS_SQL} FROM wide w),
hours AS (
  SELECT p.* EXCLUDE ({", ".join(VARIABLES)}, spot_price_eur_mwh),
         w.scenario, w.iteration, w.elas_anomaly, w.hydro_anomaly, w.base_year, w.day_start,
         greatest(p.spot_price_eur_mwh, 0.5) AS spot_price_eur_mwh,
         {", ".join(_projected_column(v) for v in VARIABLES)}
  FROM panel p JOIN sampled w
    ON p.year = w.base_year AND p.day >= w.day_start AND p.day < w.day_start + 7)
"""


@query(
    "sampled_window", "scenario iteration:i ts:t base_year:i day_start:i wind_gen_gwh:2",
    f"""WITH {PANEL_SQL}, {runs_sql("supplier")},
    sampled AS (SELECT scenario, iteration, {WINDOW_COLUMNS_SQL} FROM runs)
    SELECT w.*, p.ts, p.wind_gen_gwh FROM panel p JOIN sampled w
      ON p.year = w.base_year AND p.day >= w.day_start AND p.day < w.day_start + 7""",
)
def sampled_window(spark, sf_dir):
    return sampled_hours(spark, sf_dir)


SHOWN = [
    "residential_demand_gwh", "commercial_demand_gwh", "industrial_demand_gwh", "coal_cap_gw",
    "nuclear_cap_gw", "wind_cap_gw", "batteries_cap_gw", "pumped_hydro_pump_cap_gw",
    "cost_gas_eur_gwh", "eu_ets_price_eur_tco2",
]


@query(
    "sampled_projection",
    "scenario iteration:i ts:t spot_price_eur_mwh:4 " + " ".join(f"{c}:4" for c in SHOWN),
    f"WITH {PROJECTED_SQL} SELECT * FROM hours",
)
def sampled_projection(spark, sf_dir):
    return projected_hours(spark, sf_dir)


@query(
    "full_year_projection", "scenario iteration:i month:i n:i wind_cap_gw:4 demand:2",
    f"""WITH {PROJECTED_SQL.replace("AND p.day >= w.day_start AND p.day < w.day_start + 7", "")}
    SELECT scenario, iteration, month, count(*) AS n, avg(wind_cap_gw) AS wind_cap_gw,
           sum(residential_demand_gwh + commercial_demand_gwh + industrial_demand_gwh) AS demand
    FROM hours GROUP BY 1, 2, 3""",
)
def full_year_projection(spark, sf_dir):
    """The whole base year instead of a week per month."""
    stored = scratch.landed(panel(spark, sf_dir), "panel")
    hours = project.expand(stored, wide_draws(spark, sf_dir), window_days=None)
    demand = F.col("residential_demand_gwh") + F.col("commercial_demand_gwh") + F.col("industrial_demand_gwh")
    return project.project(hours, VARIABLES).groupBy("scenario", "iteration", "month").agg(
        F.count("*").alias("n"), F.avg("wind_cap_gw").alias("wind_cap_gw"), F.sum(demand).alias("demand")
    )


@query(
    "climate_scale", "c_custkey:i scenario month:i residential_demand_gwh:4 commercial_demand_gwh:4 industrial_demand_gwh:4",
    f"""WITH {runs_sql()} SELECT c_custkey, scenario, c_custkey % 12 + 1 AS month,
      c_acctbal * m AS residential_demand_gwh, c_acctbal * 2 * m AS commercial_demand_gwh,
      c_acctbal * 3 AS industrial_demand_gwh
    FROM (SELECT c_custkey, c_acctbal, r.*, CASE WHEN climate_demand
      THEN list_extract([{", ".join(f"CAST({m} AS DOUBLE)" for m in fv.CLIMATE_MULTIPLIER)}], c_custkey % 12 + 1)
      ELSE 1.0 END AS m FROM customer JOIN runs r ON r.iteration = c_custkey) q""",
)
def climate_scale(spark, sf_dir):
    people = table(spark, sf_dir, "customer").withColumn("iteration", F.col("c_custkey"))
    hours = runs(spark, sf_dir).join(people, "iteration").withColumns(
        {
            "month": F.pmod("c_custkey", F.lit(12)) + 1,
            "residential_demand_gwh": F.col("c_acctbal"),
            "commercial_demand_gwh": F.col("c_acctbal") * 2,
            "industrial_demand_gwh": F.col("c_acctbal") * 3,
        }
    )
    return project.climate_scale(hours)
