"""Random growth factors per scenario and iteration, from published estimates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridpanel import fixed_values as fv
from gridpanel.functions import keyed_random as rnd
from gridpanel.functions import scalars
from gridpanel.functions.sizes import broadcast_within

GROUP = ["base_year", "variable"]
# sampling rules
JITTER, CONSTANT, NORMAL, KDE = "jitter", "constant", "normal", "kde"

# --- iterations ------------------------------------------------------------------------


def iterations(scenarios: DataFrame, n: int | Column, block: int = 1000) -> DataFrame:
    """One row per scenario and iteration 1..n with the scenario's settings.

    Unrolled in two steps, so that neither a cross join nor an array of n
    elements is needed; ``iter_block`` numbers the runs of ``block`` iterations.
    ``n`` may be a column of the scenario table.
    """
    total = (n if isinstance(n, Column) else F.lit(n)).cast("bigint")
    last = F.floor((total - 1) / block)
    blocks = scenarios.withColumn(
        "iter_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last))
    ).repartition("scenario", "iter_block")
    first = F.col("iter_block") * block + 1
    return blocks.withColumn(
        "iteration", F.explode(F.sequence(first, F.least(first + block - 1, total)))
    )


def draw_windows(
    runs: DataFrame, seed: int, base_years: list[int] | None = None,
    max_day_start: int = fv.MAX_DAY_START, partitions: int | None = None,
) -> DataFrame:
    """Add an equally likely base year and first day to each iteration.

    Iterations are placed by their key, in the session's number of shuffle
    partitions unless another is given. The few bytes here become thousands of
    hours each, so the number must not be left to the size of this table; all
    later steps of an iteration stay in its partition.
    """
    years = fv.BASE_YEARS if base_years is None else base_years
    key = ("scenario", "iteration")
    if partitions is None:
        partitions = int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return runs.repartition(partitions, *key).withColumns(
        {
            "base_year": rnd.choice(rnd.uniform(seed, *key, F.lit("base_year")), years),
            "day_start": rnd.integer_between(
                rnd.uniform(seed, *key, F.lit("day_start")), 1, max_day_start
            ),
        }
    )


# --- estimates ---------------------------------------------------------------------------


def estimate_to_delta(estimate: Column | str, historical_mean: Column | str) -> Column:
    """Growth against the historical mean, 3 decimals; no estimate means no growth."""
    growth = scalars.ratio(estimate, historical_mean) - 1.0
    return F.coalesce(F.round(growth, 3), F.lit(0.0))


def long_estimates(estimates: DataFrame, base_years: list[int] | None = None) -> DataFrame:
    """The estimates table as one row per variable, source and base year."""
    years = fv.BASE_YEARS if base_years is None else base_years
    long = estimates.unpivot(
        ["variable", "weight"], [f"delta_wrt_{y}" for y in years], "column", "delta"
    )
    year = F.regexp_extract("column", r"(\d{4})$", 1).cast("int")
    return long.select("variable", year.alias("base_year"), F.coalesce("delta", F.lit(0.0)).alias("delta"), "weight")


def delta_stats(points: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Unweighted statistics of the estimates and the sampling rule they call for."""
    spread = F.when(F.min("delta") == F.max("delta"), F.lit(0.0)).otherwise(F.stddev_samp("delta"))
    stats = points.groupBy(*group).agg(
        F.avg("delta").alias("mean"),
        spread.alias("sd"),
        F.count("delta").alias("n"),
        F.min("delta").alias("min"),
        F.max("delta").alias("max"),
    )
    rule = (
        F.when((F.col("max") == 0) & (F.col("sd") == 0), JITTER)
        .when(F.col("sd") == 0, CONSTANT)
        .when(F.col("sd") < fv.NARROW_SD, NORMAL)
        .otherwise(KDE)
    )
    return stats.withColumn("rule", rule)


# --- kernel density ----------------------------------------------------------------------


def kde_range(stats: DataFrame) -> DataFrame:
    """Bandwidth, first point and spacing of the density grid."""
    bandwidth = fv.KDE_BANDWIDTH_FACTOR * F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))
    tail = fv.KDE_TAIL_BANDWIDTHS * F.col("bandwidth")
    return (
        stats.where(F.col("rule") == KDE)
        .withColumn("bandwidth", bandwidth)
        .withColumn("low", F.col("min") - tail)
        .withColumn("spacing", (F.col("max") + tail - F.col("low")) / (fv.KDE_POINTS - 1))
    )


def _densities(points: DataFrame, stats: DataFrame, group: list[str]) -> DataFrame:
    """``low, spacing`` and the arrays ``pdf`` and ``cdf`` of grid length for each group.

    Points are first shared between the two grid cells around them, so a group
    holds at most as many cells as the grid has, whatever its number of points; the cells are
    then convolved with the kernel.
    """
    ranges = kde_range(stats).select(*group, "bandwidth", "low", "spacing")
    place = (F.col("delta") - F.col("low")) / F.col("spacing")
    cell = F.floor(place)
    part = place - cell
    shared = F.array(
        F.struct(cell.alias("cell"), (F.col("weight") * (1 - part)).alias("mass")),
        F.struct((cell + 1).alias("cell"), (F.col("weight") * part).alias("mass")),
    )
    cells = (
        points.join(ranges, group)
        .select(*group, "low", "spacing", "bandwidth", F.explode(shared).alias("c"))
        .groupBy(*group, "low", "spacing", "bandwidth", "c.cell")
        .agg(F.sum("c.mass").alias("mass"))
        .groupBy(*group, "low", "spacing", "bandwidth")
        .agg(F.array_sort(F.collect_list(F.struct("cell", "mass"))).alias("cells"))
    )

    @F.arrow_udf("pdf array<double>, cdf array<double>")
    def smoothed(cells: pa.Array, unit: pa.Array) -> pa.Array:
        pdfs = []
        for own, width in zip(cells, unit.to_pylist()):
            at = own.values.field("cell").to_numpy(zero_copy_only=False)
            pdfs.append(density(at, own.values.field("mass").to_numpy(zero_copy_only=False), width, fv.KDE_POINTS))
        ends = pa.array(np.arange(len(pdfs) + 1, dtype=np.int32) * fv.KDE_POINTS)
        arrays = [pa.array(np.concatenate([np.zeros(0), *some])) for some in (pdfs, [p.cumsum() for p in pdfs])]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends, x) for x in arrays], ["pdf", "cdf"])

    found = cells.withColumn("d", smoothed("cells", F.col("spacing") / F.col("bandwidth")))
    return found.select(*group, "low", "spacing", "d.pdf", "d.cdf")


KERNEL_REACH = 9.0  # bandwidths; beyond, the kernel is under 3e-18 of its height


def density(cell: np.ndarray, mass: np.ndarray, unit: float, size: int) -> np.ndarray:
    """Normalised Gaussian smoothing of masses on a grid; ``unit`` is its spacing in bandwidths.
    The kernel is evaluated once and cut where it has no weight left."""
    reach = min(size - 1, int(np.ceil(KERNEL_REACH / unit)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) * unit) ** 2)
    on_grid = np.zeros(size)
    np.add.at(on_grid, cell, mass)
    smooth = np.convolve(on_grid, kernel)[reach : reach + size]
    return smooth / smooth.sum()


def kde_grid(points: DataFrame, stats: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """Normalised weighted Gaussian density and its running sum, one row per grid point."""
    known = _densities(points, stats, group)
    rows = known.select(*group, "low", "spacing", F.posexplode(F.arrays_zip("pdf", "cdf")).alias("i", "d"))
    return rows.select(*group, "low", "spacing", "i", "d.pdf", "d.cdf", (F.col("low") + F.col("i") * F.col("spacing")).alias("x"))


def distributions(points: DataFrame, group: list[str] = GROUP) -> DataFrame:
    """One row per base year and variable: sampling rule, statistics and, for
    kernel densities, the running sum as an array of grid length."""
    stats = delta_stats(points, group)
    return stats.join(_densities(points, stats, group).drop("pdf"), group, "left")


def grid_index(cdf: Column | str, u: Column | str, size: int = fv.KDE_POINTS) -> Column:
    """Position of the first entry >= u, the last one if there is none.

    The array is ascending and ``size`` long, a power of two: halving steps
    count the entries below u.
    """
    table, level = scalars.as_col(cdf), scalars.as_col(u)
    steps = []
    width = size // 2
    while width:
        steps.append(F.lit(width))
        width //= 2
    return F.aggregate(
        F.array(*steps),
        F.lit(0),
        lambda at, step: F.when(F.element_at(table, at + step) < level, at + step).otherwise(at),
    )


def clamped(draw: Column, low: Column | str = "min", high: Column | str = "max") -> Column:
    """Keep a draw near the estimates and above the loss of the whole capacity."""
    lo, hi = scalars.as_col(low), scalars.as_col(high)
    floor = F.greatest(lo - fv.CLAMP_MARGIN * F.abs(lo), F.lit(fv.CLAMP_FLOOR))
    return F.least(F.greatest(draw, floor), hi + fv.CLAMP_MARGIN * F.abs(hi))


def draw_deltas(
    windows: DataFrame, table: DataFrame, seed: int, max_groups: int | None = None
) -> DataFrame:
    """One growth factor per iteration and variable of its base year, or for the
    iteration's own variable if ``windows`` names one.

    ``table`` comes from ``distributions``; ``max_groups`` is its number of rows
    (years x variables) if known, each of which carries a grid.
    """
    on = [c for c in GROUP if c in windows.columns]
    carried = [c for c in windows.columns if c != "variable"]
    known = None if max_groups is None else max_groups * fv.KDE_POINTS // len(table.columns)
    key = ("scenario", "iteration", "variable")
    z = rnd.normal(seed, *key)
    u = rnd.uniform(seed, *key, F.lit("kde"))
    from_grid = F.col("low") + F.col("spacing") * grid_index("cdf", u)
    delta = (
        F.when(F.col("rule") == JITTER, z * fv.JITTER_SD)
        .when(F.col("rule") == CONSTANT, F.col("mean"))
        .when(F.col("rule") == NORMAL, F.col("mean") + z * F.col("sd"))
        .otherwise(clamped(from_grid))
    )
    joined = windows.join(broadcast_within(table, known), on)
    return joined.select(*carried, "variable", "rule", delta.alias("delta"))


# --- scenario rules ------------------------------------------------------------------------

DEPLOYED = [fv.CAPACITY_COLUMN[t] for t in fv.RENEWABLE]


def scenario_rules(renewables: list[str] | None = None) -> list[tuple]:
    """What a scenario does to drawn factors, first match wins.

    Rows are (variables, condition, operation, value). The renewable multiplier
    applies to all renewable capacities; another list can be given, such as the
    single name that starts with ``ren``.
    """
    return [
        (["coal_cap_gw"], F.col("coal_phase_out"), "set", F.lit(-1.0)),
        (["nuclear_cap_gw"], ~F.col("nuclear_phase_out"), "set", F.lit(0.0)),
        (["batteries_cap_gw"], F.lit(True), "scale", F.col("batt_cap_multiplier")),
        (DEPLOYED if renewables is None else renewables, F.lit(True), "scale", F.col("ren_cap_multiplier")),
    ]


def adjust(draws: DataFrame, rules: list[tuple] | None = None) -> DataFrame:
    """Apply scenario rules. The settings ride on each draw, so nothing is joined.

    Multipliers scale the growth, not the capacity.
    """
    chain = None
    for variables, condition, operation, value in scenario_rules() if rules is None else rules:
        match = F.col("variable").isin(variables) & condition
        result = value if operation == "set" else F.col("delta") * value
        chain = F.when(match, result) if chain is None else chain.when(match, result)
    return draws if chain is None else draws.withColumn("delta", chain.otherwise(F.col("delta")))


def fan_out(draws: DataFrame, targets: dict | None = None) -> DataFrame:
    """Pass a factor on to the columns it drives, some of them in part."""
    targets = fv.DELTA_FANOUT if targets is None else targets

    def entry(name, factor):
        return F.struct(name.alias("variable"), F.lit(factor).alias("factor"))

    driven = None
    for source, rows in targets.items():
        arr = F.array(*[entry(F.lit(n), f) for n, f in rows])
        match = F.col("variable") == source
        driven = F.when(match, arr) if driven is None else driven.when(match, arr)
    same = F.array(entry(F.col("variable"), 1.0))
    kept = [c for c in draws.columns if c not in ("variable", "delta")]
    return draws.withColumn("t", F.explode(driven.otherwise(same))).select(
        *kept, F.col("t.variable").alias("variable"), (F.col("delta") * F.col("t.factor")).alias("delta")
    )


def fanned_variables(variables: list[str] | None = None) -> list[str]:
    out = []
    for v in fv.DRAWN_VARIABLES if variables is None else variables:
        out += [n for n, _ in fv.DELTA_FANOUT.get(v, [(v, 1.0)])]
    return out


def to_wide(draws: DataFrame, keys: list[str], variables: list[str]) -> DataFrame:
    """One row per iteration with a ``d_`` column per variable."""
    return draws.groupBy(*keys).agg(
        *[F.max(F.when(F.col("variable") == v, F.col("delta"))).alias(f"d_{v}") for v in variables]
    )
