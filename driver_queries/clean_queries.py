"""Panel building, gap filling and column clean-up on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from driver_queries.bases import MAX_DAYS, MAX_MONTHS, PANEL_SQL, lines, panel
from driver_queries.registry import query, table
from gridpanel.functions import calendars, scalars
from gridpanel.operators import clean, fill
from gridpanel.sources import priority


def event_panel(spark, sf_dir):
    """Hourly mean value per event type, gaps left open."""
    raw = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("series"), "ts", "value"
    )
    return clean.hourly_mean(raw)


def event_spine_panel(spark, sf_dir):
    """From the first to the last hour of the table for every series, all-null ones too."""
    panel = event_panel(spark, sf_dir)
    spans = panel.groupBy("series").agg(F.min("ts").alias("first"), F.max("ts").alias("last"))
    everything = Window.partitionBy()  # one row a series
    listed = spans.select(
        "series", F.min("first").over(everything).alias("start"), F.max("last").over(everything).alias("end")
    )
    return clean.on_spine(panel, clean.hourly_spine(listed, F.col("start"), F.col("end")))


HOURLY = """
hourly AS (
  SELECT event_type AS series, date_trunc('hour', ts) AS ts, avg(value) AS value
  FROM events GROUP BY 1, 2),
spine AS (
  SELECT s.series, h.ts
  FROM (SELECT DISTINCT event_type AS series FROM events) s,
       (SELECT unnest(generate_series((SELECT min(ts) FROM hourly), (SELECT max(ts) FROM hourly),
                                      INTERVAL 1 HOUR)) AS ts) h),
panel AS (
  SELECT spine.series, spine.ts, hourly.value
  FROM spine LEFT JOIN hourly ON hourly.series = spine.series AND hourly.ts = spine.ts)
"""

IMPUTED = HOURLY + """,
f1 AS (
  SELECT *, coalesce(value, lag(value) OVER w) AS v1
  FROM panel WINDOW w AS (PARTITION BY series ORDER BY ts)),
f2 AS (
  SELECT *, CASE WHEN series = 'error' THEN v1 ELSE coalesce(v1, lag(v1, 24) OVER w) END AS v2
  FROM f1 WINDOW w AS (PARTITION BY series ORDER BY ts)),
f3 AS (
  SELECT *, CASE WHEN series = 'error' THEN v2 ELSE coalesce(v2, lag(v2, 24) OVER w) END AS v3
  FROM f2 WINDOW w AS (PARTITION BY series ORDER BY ts)),
f4 AS (
  SELECT *, CASE WHEN series = 'error' THEN v3 ELSE coalesce(v3, lag(v3, 24) OVER w) END AS v4
  FROM f3 WINDOW w AS (PARTITION BY series ORDER BY ts)),
numbered AS (
  SELECT series, ts, v4, row_number() OVER (PARTITION BY series ORDER BY ts) AS pos FROM f4),
near AS (
  SELECT *,
    last_value(v4 IGNORE NULLS) OVER back AS bv,
    last_value(CASE WHEN v4 IS NOT NULL THEN pos END IGNORE NULLS) OVER back AS bp,
    first_value(v4 IGNORE NULLS) OVER ahead AS av,
    first_value(CASE WHEN v4 IS NOT NULL THEN pos END IGNORE NULLS) OVER ahead AS ap
  FROM numbered
  WINDOW back AS (PARTITION BY series ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
         ahead AS (PARTITION BY series ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
imputed AS (
  SELECT series, ts,
         coalesce(v4, bv + (av - bv) * (pos - bp) / nullif(ap - bp, 0), bv, av) AS value
  FROM near)
"""


@query(
    "hourly_resample_spine", "series ts:t value:6",
    f"WITH {HOURLY} SELECT * FROM panel",
)
def hourly_resample_spine(spark, sf_dir):
    return event_spine_panel(spark, sf_dir)


@query("impute_panel", "series ts:t value:6", f"WITH {IMPUTED} SELECT * FROM imputed")
def impute_panel(spark, sf_dir):
    """Prices (here the error series) take no part in the seasonal step."""
    return fill.impute(event_spine_panel(spark, sf_dir), seasonal_exempt=["error"])


@query(
    "null_audit", "series n_rows:i nulls_before:i filled:i nulls_after:i",
    f"""WITH {IMPUTED}
    SELECT p.series, count(*) AS n_rows,
           sum(CASE WHEN p.value IS NULL THEN 1 ELSE 0 END) AS nulls_before,
           sum(CASE WHEN p.value IS NULL AND i.value IS NOT NULL THEN 1 ELSE 0 END) AS filled,
           sum(CASE WHEN i.value IS NULL THEN 1 ELSE 0 END) AS nulls_after
    FROM panel p JOIN imputed i ON p.series = i.series AND p.ts = i.ts GROUP BY 1""",
)
def null_audit(spark, sf_dir):
    before = event_spine_panel(spark, sf_dir)
    after = fill.impute(before, seasonal_exempt=["error"])
    a = fill.null_audit(before, ["series"], ["value"]).withColumnRenamed("value_nulls", "nulls_before")
    b = fill.null_audit(after, ["series"], ["value"]).select(
        "series", F.col("value_nulls").alias("nulls_after")
    )
    return a.join(b, "series").withColumn("filled", F.col("nulls_before") - F.col("nulls_after"))


# --- joins of calendars and sources -------------------------------------------------------


@query(
    "coarse_join", "series ts:t value:6 month_total:2",
    f"""WITH {HOURLY},
    monthly AS (SELECT event_type AS series, strftime(ts, '%Y-%m') AS year_month,
                       sum(value) AS month_total FROM events GROUP BY 1, 2)
    SELECT p.series, p.ts, p.value, m.month_total
    FROM panel p LEFT JOIN monthly m
      ON m.series = p.series AND m.year_month = strftime(p.ts, '%Y-%m')""",
)
def coarse_join(spark, sf_dir):
    raw = table(spark, sf_dir, "events").select(F.col("event_type").alias("series"), "ts", "value")
    monthly = clean.monthly_sum(raw).withColumnRenamed("value", "month_total")
    fine = event_spine_panel(spark, sf_dir).withColumn("year_month", calendars.year_month("ts"))
    return fine.join(monthly, ["series", "year_month"], "left")


@query(
    "monthly_capacity_join", "ts:t wind_gen_gwh:2 wind_cap_gw:2 nuclear_cap_gw:2",
    f"WITH {PANEL_SQL} SELECT ts, wind_gen_gwh, wind_cap_gw, nuclear_cap_gw FROM panel",
)
def monthly_capacity_join(spark, sf_dir):
    """A wide monthly table joined to the steps of its month."""
    steps = lines(spark, sf_dir).groupBy("ts").agg(
        *[
            F.sum(F.when(F.col("technology") == t, F.col("l_quantity")).otherwise(0.0)).alias(f"{t}_gen_gwh")
            for t in ("wind", "nuclear")
        ]
    )
    month = calendars.year_month("ts")
    caps = steps.groupBy(month.alias("year_month")).agg(
        F.max("wind_gen_gwh").alias("wind_cap_gw"), F.max("nuclear_gen_gwh").alias("nuclear_cap_gw")
    )
    return clean.coarse_join(steps, caps, month, "year_month", MAX_MONTHS)


@query(
    "override_join", "series ts:t value:6",
    f"""WITH {HOURLY},
    better AS (SELECT o_orderpriority AS series, o_orderdate AS ts, avg(o_totalprice) AS value
               FROM orders GROUP BY 1, 2),
    base AS (SELECT CASE WHEN series = 'click' THEN '1-URGENT' WHEN series = 'view' THEN '2-HIGH'
                         ELSE series END AS series, ts, value FROM panel)
    SELECT * FROM base WHERE series NOT IN (SELECT series FROM better)
    UNION ALL SELECT * FROM better""",
)
def override_join(spark, sf_dir):
    """Two series of the panel are replaced by another source under the same names; its
    three others are added."""
    renamed = (
        F.when(F.col("series") == "click", "1-URGENT")
        .when(F.col("series") == "view", "2-HIGH")
        .otherwise(F.col("series"))
    )
    base = event_spine_panel(spark, sf_dir).withColumn("series", renamed)
    better = (
        table(spark, sf_dir, "orders")
        .groupBy(
            F.col("o_orderpriority").alias("series"),
            F.col("o_orderdate").cast("timestamp").alias("ts"),
        )
        .agg(F.avg("o_totalprice").alias("value"))
    )
    return clean.override_series(base, better)


@query(
    "override_columns", "ts:t wind_gen_gwh:2 conventional_hydro_gen_gwh:2 run_of_river_hydro_gen_gwh:2",
    f"""WITH {PANEL_SQL},
    feed AS (SELECT ts, sum(l_extendedprice) / 1000.0 AS conventional_hydro_gen_gwh,
                    sum(l_tax * l_quantity) AS run_of_river_hydro_gen_gwh
             FROM lines WHERE technology IN ('conventional_hydro', 'run_of_river_hydro') GROUP BY ts)
    SELECT p.ts, p.wind_gen_gwh, f.conventional_hydro_gen_gwh, f.run_of_river_hydro_gen_gwh
    FROM panel p LEFT JOIN feed f ON f.ts = p.ts""",
)
def override_columns(spark, sf_dir):
    """Hydro columns of the wide panel come from a feed of their own."""
    feed = (
        lines(spark, sf_dir)
        .where(F.col("technology").isin("conventional_hydro", "run_of_river_hydro"))
        .groupBy("ts")
        .agg(
            (F.sum("l_extendedprice") / 1000.0).alias("conventional_hydro_gen_gwh"),
            F.sum(F.col("l_tax") * F.col("l_quantity")).alias("run_of_river_hydro_gen_gwh"),
        )
    )
    return clean.override_columns(panel(spark, sf_dir), feed, "ts")


DAILY_COST = """
calendar AS (
  SELECT unnest(generate_series(
    least((SELECT min(CAST(o_orderdate AS DATE)) FROM orders), (SELECT min(CAST(l_shipdate AS DATE)) FROM lineitem)),
    greatest((SELECT max(CAST(o_orderdate AS DATE)) FROM orders), (SELECT max(CAST(l_shipdate AS DATE)) FROM lineitem)),
    INTERVAL 1 DAY)) AS day),
quotes AS (
  SELECT CAST(o_orderdate AS DATE) AS day, avg(o_totalprice) AS cost
  FROM orders WHERE dayofweek(o_orderdate) BETWEEN 1 AND 5 GROUP BY 1),
daily AS (
  SELECT CAST(c.day AS DATE) AS day, q.cost
  FROM calendar c LEFT JOIN quotes q ON CAST(c.day AS DATE) = q.day),
filled AS (
  SELECT day, coalesce(
    last_value(cost IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
    first_value(cost IGNORE NULLS) OVER (ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  ) AS cost
  FROM daily)
"""


def daily_cost(spark, sf_dir):
    """Quotes exist on weekdays only; the calendar has every day."""
    quotes = (
        table(spark, sf_dir, "orders")
        .withColumn("day", F.to_date("o_orderdate"))
        .where(F.dayofweek("day").between(2, 6))
        .groupBy("day")
        .agg(F.avg("o_totalprice").alias("cost"))
    )
    dates = [table(spark, sf_dir, t).select(F.to_date(c).alias("day")) for t, c in (("orders", "o_orderdate"), ("lineitem", "l_shipdate"))]
    days = dates[0].unionByName(dates[1]).agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    calendar = days.join(quotes, "day", "left").withColumn("kind", F.lit("cost"))
    dated = calendar.withColumn("block", F.year("day"))
    return fill.ffill_bfill(dated, ["kind"], "day", "block", "cost").select("day", "cost")


@query(
    "ffill_bfill_daily", "ts:t day_cost:4 wind_gen_gwh:2",
    f"""WITH {PANEL_SQL}, {DAILY_COST}
    SELECT p.ts, f.cost AS day_cost, p.wind_gen_gwh
    FROM panel p LEFT JOIN filled f ON f.day = CAST(p.ts AS DATE)""",
)
def ffill_bfill_daily(spark, sf_dir):
    costs = daily_cost(spark, sf_dir).withColumnRenamed("cost", "day_cost")
    return clean.coarse_join(panel(spark, sf_dir), costs, F.to_date("ts"), "day", MAX_DAYS)


# --- rows ------------------------------------------------------------------------------------


@query(
    "dedupe_first", "user_id:i hour:t event_id:i event_type value:2",
    """SELECT user_id, hour, event_id, event_type, value FROM (
      SELECT user_id, date_trunc('hour', ts) AS hour, event_id, event_type, value,
             row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS rn
      FROM events) AS ranked WHERE rn = 1""",
)
def dedupe_first(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(
        "user_id", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("hour"),
        "ts", "event_id", "event_type", "value",
    )
    return clean.first_wins(events, ["user_id", "hour"], ["ts", "event_id"])


@query(
    "prioritized_source", "series ts:t value:2",
    """WITH tagged AS (
      SELECT 'u' || CAST(user_id % 40 AS VARCHAR) AS series, ts,
             CASE WHEN event_type = 'click' AND value > 20 THEN NULL ELSE value END AS value,
             list_position(['click', 'view', 'purchase', 'error', 'signup'], event_type) AS priority
      FROM events),
    best AS (
      SELECT series, min(priority) AS priority FROM (
        SELECT series, priority, count(value) AS known FROM tagged GROUP BY 1, 2) c
      WHERE known > 25 OR (priority = 5 AND known > 0) GROUP BY series)
    SELECT t.series, t.ts, coalesce(t.value, 0.0) AS value
    FROM tagged t JOIN best b ON t.series = b.series AND t.priority = b.priority""",
)
def prioritized_source(spark, sf_dir):
    """Clicks if a series has enough of them, else views, purchases, errors, signups."""
    events = table(spark, sf_dir, "events").withColumn(
        "series", F.concat(F.lit("u"), F.pmod("user_id", F.lit(40)))
    )

    def of(kind, value):
        return events.where(F.col("event_type") == kind).select("series", "ts", value.alias("value"))

    value = F.col("value")
    return priority.prioritized_source(
        [of("click", F.when(value <= 20, value)), *[of(k, value) for k in ("view", "purchase", "error", "signup")]],
        min_non_null=25,
        default=0.0,
    )


EXPECTED = ["u1", "u2", "uranium", "ets"]


@query(
    "prioritized_default", "series ts:t value:2",
    """WITH of_type AS (SELECT 'u' || CAST(user_id % 40 AS VARCHAR) AS series, ts, value, event_type FROM events WHERE user_id % 40 < 3),
    best AS (SELECT series, CASE WHEN count(*) FILTER (event_type = 'click') > 25 THEN 'click' ELSE 'view' END AS kind
             FROM of_type WHERE event_type IN ('click', 'view') GROUP BY series),
    days AS (SELECT DISTINCT date_trunc('day', ts) AS ts FROM events)
    SELECT t.series, t.ts, t.value FROM of_type t JOIN best b ON t.series = b.series AND t.event_type = b.kind
    UNION ALL
    SELECT n.series, days.ts, 0.0 FROM (SELECT unnest(['u1', 'u2', 'uranium', 'ets']) AS series) n, days
    WHERE n.series NOT IN (SELECT series FROM best)""",
)
def prioritized_default(spark, sf_dir):
    """Two sources of three series; of four that are expected two are in neither and become 0."""
    events = table(spark, sf_dir, "events").where(F.pmod("user_id", F.lit(40)) < 3).withColumn(
        "series", F.concat(F.lit("u"), F.pmod("user_id", F.lit(40)))
    )
    sources = [events.where(F.col("event_type") == kind).select("series", "ts", "value") for kind in ("click", "view")]
    days = table(spark, sf_dir, "events").select(F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts")).distinct()
    return priority.prioritized_source(sources, 25, 0.0, EXPECTED, days)


# --- columns -----------------------------------------------------------------------------------


@query(
    "signed_split", "c_custkey:i net_flows_A_mwh:2 imports_A_mwh:2 exports_A_mwh:2",
    """SELECT c_custkey, c_acctbal AS net_flows_A_mwh, greatest(c_acctbal, 0.0) AS imports_A_mwh,
              abs(least(c_acctbal, 0.0)) AS exports_A_mwh FROM customer""",
)
def signed_split(spark, sf_dir):
    return clean.signed_split(table(spark, sf_dir, "customer"), "c_acctbal", "A")


@query(
    "capacity_factor",
    "ts:t nuclear_cap_factor:6 solar_pv_cap_factor:6 solar_thermal_cap_factor:6 wind_cap_factor:6",
    f"WITH {PANEL_SQL} SELECT * FROM panel",
)
def capacity_factor(spark, sf_dir):
    p = panel(spark, sf_dir)
    raw = {"nuclear_self_reported_cap_mw": "nuclear_gen_gwh", "nuclear_cap_mw": "nuclear_cap_gw"}
    for t in ("solar_pv", "solar_thermal", "wind"):
        raw |= {f"{t}_gen_mwh": f"{t}_gen_gwh", f"{t}_cap_mw": f"{t}_cap_gw"}
    named = p.select("ts", *[F.col(old).alias(new) for new, old in raw.items()])
    return clean.clip_negative(clean.capacity_factors(named))


@query(
    "unit_convert",
    "l_orderkey:i l_linenumber:i spot_price_eur_mwh:2 wind_gen_gwh:6 wind_cap_gw:6 cost_gas_eur_gwh:2",
    """SELECT l_orderkey, l_linenumber, l_extendedprice AS spot_price_eur_mwh,
              l_extendedprice / 1000.0 AS wind_gen_gwh, l_quantity / 1000.0 AS wind_cap_gw,
              l_discount * 1000.0 AS cost_gas_eur_gwh FROM lineitem""",
)
def unit_convert(spark, sf_dir):
    raw = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.col("l_extendedprice").alias("spot_price_eur_mwh"),
        F.col("l_extendedprice").alias("wind_gen_mwh"),
        F.col("l_quantity").alias("wind_cap_mw"),
        F.col("l_discount").alias("cost_gas_eur_mwh"),
    )
    order = [
        "l_orderkey", "l_linenumber", "spot_price_eur_mwh", "wind_cap_gw", "wind_gen_gwh",
        "cost_gas_eur_gwh",
    ]
    return clean.ordered_projection(clean.convert_units(raw), order)


@query(
    "calendar_parts", "event_id:i time_long year:i month:i day:i hour:i",
    """SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time_long, year(ts) AS year,
              month(ts) AS month, day(ts) AS day, hour(ts) AS hour FROM events""",
)
def calendar_parts(spark, sf_dir):
    return clean.calendar_parts(table(spark, sf_dir, "events"))


@query(
    "year_mapped_column",
    "o_orderkey:i batteries_cap_mw:2 run_of_river_hydro_cap_mw:2 pumped_hydro_pump_cap_mw:2",
    """SELECT o_orderkey, CASE year(o_orderdate) WHEN 1995 THEN 10.0 WHEN 1996 THEN 10.0
              WHEN 1997 THEN 15.0 ELSE 25.0 END AS batteries_cap_mw,
              3453.0 AS run_of_river_hydro_cap_mw, 2278.0 AS pumped_hydro_pump_cap_mw FROM orders""",
)
def year_mapped_column(spark, sf_dir):
    orders = clean.constant_columns(table(spark, sf_dir, "orders"))
    return clean.year_mapped_column(
        orders, F.year("o_orderdate"), "batteries_cap_mw", {1995: 10.0, 1996: 10.0, 1997: 15.0}
    )


@query(
    "column_backfill", "o_orderkey:i o_totalprice:2 coal_cap_mw:2",
    "SELECT o_orderkey, o_totalprice, 0.0 AS coal_cap_mw FROM orders",
)
def column_backfill(spark, sf_dir):
    return clean.backfill_columns(table(spark, sf_dir, "orders"), ["o_totalprice", "coal_cap_mw"])


@query(
    "conditional_rescale", "o_orderkey:i o_totalprice:4",
    """SELECT o_orderkey, CASE WHEN (SELECT avg(o_totalprice) FROM orders) > 50000
              THEN o_totalprice / 10 ELSE o_totalprice END AS o_totalprice FROM orders""",
)
def conditional_rescale(spark, sf_dir):
    return clean.rescale_if_mean_exceeds(table(spark, sf_dir, "orders"), "o_totalprice")


@query(
    "class_share_split", "day:d level demand:4",
    """WITH levels AS (
      SELECT CAST(l_shipdate AS DATE) AS day, l_returnflag || l_linestatus AS level,
             sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2),
    shares AS (
      SELECT strftime(day, '%m-%d') AS md, level, avg(value / nullif(total, 0)) AS share
      FROM (SELECT *, sum(value) OVER (PARTITION BY day) AS total FROM levels) t GROUP BY 1, 2),
    totals AS (
      SELECT CAST(o_orderdate AS DATE) AS day, sum(o_totalprice) AS total FROM orders GROUP BY 1),
    wanted AS (SELECT t.day, t.total, l.level, s.share FROM totals t JOIN (SELECT DISTINCT level FROM shares) l ON true
      LEFT JOIN shares s ON s.md = strftime(t.day, '%m-%d') AND s.level = l.level)
    SELECT day, level, total * coalesce(
      last_value(share IGNORE NULLS) OVER (PARTITION BY level ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
      first_value(share IGNORE NULLS) OVER (PARTITION BY level ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
    ) AS demand FROM wanted""",
)
def class_share_split(spark, sf_dir):
    """Mean share of each class per calendar day times the day's total; a day without a
    share takes the last one before it, or the next."""
    levels = (
        table(spark, sf_dir, "lineitem")
        .groupBy(
            F.to_date("l_shipdate").alias("day"),
            F.concat("l_returnflag", "l_linestatus").alias("level"),
        )
        .agg(F.sum("l_quantity").alias("value"))
        .withColumn("md", F.date_format("day", "MM-dd"))
    )
    shares = clean.level_shares(levels, ["day"], "level", "value", "md")
    totals = (
        table(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("day"))
        .agg(F.sum("o_totalprice").alias("total"))
    )
    return clean.split_by_share(totals, "day", F.date_format("day", "MM-dd"), shares, "md", "level").withColumn(
        "demand", F.col("share") * F.col("total")
    )


@query(
    "fuel_cost_convert", "l_orderkey:i l_linenumber:i coal:4 diesel:4 uranium_eur:6",
    """SELECT l_orderkey, l_linenumber, l_extendedprice / nullif(1 + l_tax, 0) / 8.14 AS coal,
              l_quantity / nullif(1 + l_discount, 0) / 0.0406 AS diesel,
              l_quantity / 30.211 AS uranium_eur FROM lineitem""",
)
def fuel_cost_convert(spark, sf_dir):
    """Quotes per tonne, gallon and pound to EUR per MWh; the last is in EUR already."""
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_linenumber",
        scalars.fuel_cost_eur_mwh("coal", "l_extendedprice", 1 + F.col("l_tax")).alias("coal"),
        scalars.fuel_cost_eur_mwh("diesel", "l_quantity", 1 + F.col("l_discount")).alias("diesel"),
        scalars.fuel_cost_eur_mwh("uranium", "l_quantity").alias("uranium_eur"),
    )
