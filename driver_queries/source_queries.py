"""Readers and writers: the driver's tables are landed as raw feeds and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from driver_queries.draw_queries import REGIONS
from driver_queries.ensemble_queries import RESULTS_SQL, RUN, results
from driver_queries.registry import query, table
from gridpanel.sources import commits, feeds, scratch, tables

# event types under the ids of indicators; the last one is reported per area
EVENT_IDS = {"click": 2038, "view": 2039, "signup": 2040, "error": 600, "purchase": 10039}
EVENT_SERIES = {
    "click": "wind_gen_mwh", "view": "nuclear_gen_mwh", "signup": "coal_gen_mwh",
    "error": "spot_price_eur_mwh", "purchase": "cogeneration_gen_mwh",
}
PRIORITY_IDS = {"1-URGENT": 1478, "2-HIGH": 1483, "3-MEDIUM": 1480, "4-NOT SPECIFIED": 1481, "5-LOW": 1489}
PRIORITY_SERIES = {
    "1-URGENT": "coal_cap_mw", "2-HIGH": "combined_cycle_cap_mw", "3-MEDIUM": "gas_turbine_cap_mw",
    "4-NOT SPECIFIED": "vapor_turbine_cap_mw", "5-LOW": "cogeneration_cap_mw",
}


def _case(column: str, mapping: dict) -> str:
    whens = " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in mapping.items())
    return f"CASE {column} {whens} END"


def _id_of(column: str, ids: dict):
    return F.create_map(*[F.lit(x) for item in ids.items() for x in item])[F.col(column)]


def _land_payloads(spark, rows, name):
    """Rows ``id, period, ts, rank, value`` as payload documents, one per id and period."""
    entry = F.struct("ts", "rank", "value")
    values = F.transform(
        F.array_sort(F.collect_list(entry)),
        lambda v: F.struct(
            v["value"].alias("value"),
            F.date_format(v["ts"], "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("datetime_utc"),
        ),
    )
    docs = rows.groupBy("id", "period").agg(values.alias("values"))
    path = scratch.new_path(spark, name)
    docs.select(F.struct("id", "values").alias("indicator")).write.json(path)
    return path


@query(
    "indicator_series", "series ts:t value:6",
    f"""WITH areas AS (SELECT event_type, date_trunc('hour', ts) AS ts, user_id % 2 AS area, avg(value) AS value
      FROM events GROUP BY 1, 2, 3)
    SELECT {_case("event_type", EVENT_SERIES)} AS series, ts,
      CASE WHEN event_type = 'purchase' THEN sum(value) ELSE arg_min(value, area) END AS value
    FROM areas GROUP BY event_type, ts""",
)
def indicator_series(spark, sf_dir):
    """Two areas report per hour: one indicator adds them up, the others keep the first."""
    rows = (
        table(spark, sf_dir, "events")
        .groupBy(
            _id_of("event_type", EVENT_IDS).alias("id"),
            F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"),
            F.pmod("user_id", F.lit(2)).alias("rank"),
        )
        .agg(F.avg("value").alias("value"))
        .withColumn("period", F.to_date("ts"))
    )
    path = _land_payloads(spark, rows, "indicator_series")
    return feeds.indicator_series(feeds.read_payloads(spark, path))


@query(
    "monthly_capacity", "series year_month value:1",
    f"""SELECT {_case("o_orderpriority", PRIORITY_SERIES)} AS series, strftime(o_orderdate, '%Y-%m') AS year_month,
      sum(o_totalprice) AS value FROM orders GROUP BY 1, 2""",
)
def monthly_capacity(spark, sf_dir):
    rows = (
        table(spark, sf_dir, "orders")
        .groupBy(
            _id_of("o_orderpriority", PRIORITY_IDS).alias("id"),
            F.date_trunc("month", F.col("o_orderdate").cast("timestamp")).alias("ts"),
            F.col("o_orderstatus").alias("rank"),
        )
        .agg(F.sum("o_totalprice").alias("value"))
        .withColumn("period", F.year("ts"))
    )
    path = _land_payloads(spark, rows, "monthly_capacity")
    return feeds.monthly_capacity(feeds.read_payloads(spark, path))


HYDRO_COLUMNS = {
    "click": "Hydro Run-of-river and poundage", "view": "Hydro Water Reservoir",
    "signup": "Hydro Pumped Storage_Actual Aggregated", "error": "Hydro Pumped Storage_Actual Consumption",
    "purchase": "Geothermal",  # a column the reader has to pass over
}


@query(
    "hydro_feed",
    "datetime:t run_of_river_hydro_gen_mwh:6 conventional_hydro_gen_mwh:6 pumped_hydro_gen_mwh:6 pumped_hydro_consumption_mwh:6",
    """WITH chunks AS (
      SELECT 1 AS chunk, * FROM events WHERE day(ts) <= 16
      UNION ALL SELECT 2, * REPLACE (value + 1000 AS value) FROM events WHERE day(ts) >= 15),
    hourly AS (SELECT chunk, date_trunc('hour', ts) AS datetime,
      avg(CASE WHEN event_type = 'click' THEN value END) AS r, avg(CASE WHEN event_type = 'view' THEN value END) AS c,
      avg(CASE WHEN event_type = 'signup' THEN value END) AS g, avg(CASE WHEN event_type = 'error' THEN value END) AS p
      FROM chunks GROUP BY 1, 2)
    SELECT datetime, r AS run_of_river_hydro_gen_mwh, c AS conventional_hydro_gen_mwh,
      coalesce(g, 0.0) AS pumped_hydro_gen_mwh, coalesce(p, 0.0) AS pumped_hydro_consumption_mwh
    FROM (SELECT *, row_number() OVER (PARTITION BY datetime ORDER BY chunk) AS rn FROM hourly) r WHERE rn = 1""",
)
def hydro_feed(spark, sf_dir):
    """Two chunks overlap for two days; in the overlap the first one counts."""
    events = table(spark, sf_dir, "events")
    day = F.dayofmonth("ts")
    first = events.where(day <= 16).withColumn("chunk", F.lit(1))
    second = events.where(day >= 15).withColumn("chunk", F.lit(2)).withColumn("value", F.col("value") + 1000)
    landed = first.unionByName(second).select(
        "chunk", F.col("ts").alias("datetime"),
        *[F.when(F.col("event_type") == e, F.col("value")).alias(c) for e, c in HYDRO_COLUMNS.items()],
    )
    path = scratch.new_path(spark, "hydro_feed")
    landed.write.partitionBy("chunk").parquet(path)
    return feeds.hydro_feed(spark.read.parquet(path), "chunk")


ORDER_SCHEMA = T.StructType(
    [
        T.StructField("o_orderkey", T.LongType()), T.StructField("o_orderdate", T.TimestampType()),
        T.StructField("o_totalprice", T.DoubleType()), T.StructField("o_orderpriority", T.StringType()),
    ]
)


@query(
    "csv_scan", "o_orderkey:i o_orderdate:d o_totalprice:2 o_orderpriority",
    """SELECT o_orderkey, o_orderdate, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice,
      CASE WHEN o_orderstatus <> 'F' THEN o_orderpriority END AS o_orderpriority FROM orders""",
)
def csv_scan(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_orderdate").cast("timestamp").alias("o_orderdate"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"),
        F.when(F.col("o_orderstatus") != "F", F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    path = scratch.new_path(spark, "csv_scan")
    orders.write.option("header", True).option("nullValue", tables.MISSING).csv(path)
    return tables.read_table(spark, path, ORDER_SCHEMA)


@query(
    "price_scan", "date:d price:4",
    """SELECT date, price FROM (
      SELECT CAST(o_orderdate AS DATE) AS date, o_totalprice AS price,
        row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS rn
      FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0) r WHERE rn = 1""",
)
def price_scan(spark, sf_dir):
    """Text quotes: every 7th date and every 5th number cannot be read."""
    raw = table(spark, sf_dir, "orders").select(
        F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a"))
        .otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("day"),
        F.when(F.col("o_orderkey") % 5 == 0, F.lit("closed"))
        .otherwise(F.col("o_totalprice").cast("string")).alias("quote"),
        F.col("o_orderkey").cast("string").alias("row"),
    )
    path = scratch.new_path(spark, "price_scan")
    raw.write.option("header", True).csv(path)
    landed = spark.read.option("header", True).csv(path).withColumn("row", F.col("row").cast("bigint"))
    return feeds.coerced_prices(landed, "day", "quote", ["row"])


@query(
    "incremental_write", "scenario iteration:i iter_block:i total_generation:2 rerun",
    f"""WITH {RESULTS_SQL} SELECT scenario, iteration + 1 AS iteration, iteration // 20 AS iter_block,
      CASE WHEN iteration // 20 = 1 THEN total_generation * 2 ELSE total_generation END AS total_generation,
      iteration // 20 = 1 AS rerun FROM results""",
)
def incremental_write(spark, sf_dir):
    """All blocks are written, then one block again with other numbers."""
    stored = scratch.landed(results(spark, sf_dir).select(*RUN, "total_generation"), "results")
    rows = stored.withColumns({"iteration": F.col("iteration") + 1, "rerun": F.lit(False)})
    path = scratch.new_path(spark, "incremental_write")
    commits.write_iterations(rows, path, 20)
    again = commits.with_block(rows, 20).where(F.col("iter_block") == 1).drop("iter_block")
    changed = again.withColumns({"total_generation": F.col("total_generation") * 2, "rerun": F.lit(True)})
    commits.write_iterations(changed, path, 20)
    return commits.read_iterations(spark, path)


RESUMED = 60  # iterations of the last run; the first one has 25


@query(
    "resumed_run", "scenario iteration:i total_generation:2 run:i",
    f"""WITH {RESULTS_SQL} SELECT scenario, iteration, total_generation,
      CASE WHEN scenario = 'AFRICA' THEN 4 WHEN scenario = 'ASIA' THEN 2 WHEN iteration <= 20 THEN 1 ELSE 3 END AS run
    FROM results WHERE scenario IN ('AFRICA', 'AMERICA', 'ASIA') AND iteration BETWEEN 1 AND {RESUMED}""",
)
def resumed_run(spark, sf_dir):
    """Runs on one path: 25 iterations of two scenarios; with a scenario more; with more iterations,
    which keeps the first's whole blocks; and after the seed of one scenario has changed."""
    rows = scratch.landed(results(spark, sf_dir).select("scenario", "iteration", "total_generation"), "results")
    path = scratch.new_path(spark, "resumed_run")

    def go(run, n, seeds):
        digests = {s: commits.digest_of(s, seed) for s, seed in seeds.items()}

        def rows_of(first, last, names):
            some = rows.where(F.col("iteration").between(first, last) & F.col("scenario").isin(names))
            return some.withColumn("run", F.lit(run))

        commits.write_blocks(spark, rows_of, path, n, digests, block=20)
        return commits.read_iterations(spark, path, digests, n)

    africa, america, asia = REGIONS[:3]
    go(1, 25, {africa: 1, america: 1})
    go(2, RESUMED, {asia: 1})
    go(3, RESUMED, {africa: 1, america: 1, asia: 1})
    return go(4, RESUMED, {africa: 2, america: 1, asia: 1})


@query(
    "result_scan", "scenario iteration:i total_generation:2",
    f"WITH {RESULTS_SQL} SELECT scenario, iteration, total_generation FROM results WHERE scenario = 'ASIA'",
)
def result_scan(spark, sf_dir):
    """Only the directory of the asked scenario is read."""
    path = scratch.new_path(spark, "result_scan")
    tables.write_results(results(spark, sf_dir).select("scenario", "iteration", "total_generation"), path)
    return tables.read_results(spark, path, REGIONS[2])
