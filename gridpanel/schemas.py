"""Column types of the tables that enter and leave the engine."""

from pyspark.sql import types as T

from gridpanel import fixed_values as fv


def _fields(names, data_type):
    return [T.StructField(n, data_type, True) for n in names]


SERIES_PANEL = T.StructType(
    [
        T.StructField("series", T.StringType(), False),
        T.StructField("ts", T.TimestampType(), False),
        T.StructField("value", T.DoubleType(), True),
    ]
)

INDICATOR_PAYLOAD = T.StructType(
    [
        T.StructField(
            "indicator",
            T.StructType(
                [
                    T.StructField("id", T.IntegerType(), True),
                    T.StructField(
                        "values",
                        T.ArrayType(
                            T.StructType(
                                [
                                    T.StructField("value", T.DoubleType(), True),
                                    T.StructField("datetime_utc", T.StringType(), True),
                                ]
                            )
                        ),
                        True,
                    ),
                ]
            ),
            True,
        )
    ]
)

PANEL_CAPACITIES = [fv.CAPACITY_COLUMN[t] for t in fv.NON_RENEWABLE + fv.RENEWABLE[:2]] + [
    "pumped_hydro_turb_cap_gw",
    "pumped_hydro_pump_cap_gw",
    *[fv.CAPACITY_COLUMN[t] for t in fv.RENEWABLE[2:]],
    "batteries_cap_gw",
]
PANEL_GENERATION = [fv.GENERATION_COLUMN[t] for t in fv.NON_RENEWABLE + fv.RENEWABLE[:2]] + [
    "pumped_hydro_gen_gwh",
    "pumped_hydro_consumption_gwh",
    *[fv.GENERATION_COLUMN[t] for t in fv.RENEWABLE[2:]],
    "batteries_gen_gwh",
]
PANEL_DEMAND = [f"{s}_demand_gwh" for s in fv.SECTORS]
PANEL_FLOWS = [f"{kind}_{b}_gwh" for b in fv.BORDERS for kind in ("imports", "exports", "net_flows")]
PANEL_MEASURES = (
    ["spot_price_eur_mwh"]
    + PANEL_DEMAND
    + PANEL_CAPACITIES
    + PANEL_GENERATION
    + fv.CAP_FACTOR_COLUMNS
    + PANEL_FLOWS
    + fv.COST_COLUMNS
)
HOURLY_PANEL = T.StructType(
    [T.StructField("time_long", T.TimestampType(), True)]
    + _fields(["year", "month", "day", "hour"], T.IntegerType())
    + _fields(PANEL_MEASURES, T.DoubleType())
)

TECHNOLOGY = T.StructType(
    [
        T.StructField("technology", T.StringType(), False),
        T.StructField("efficiency", T.DoubleType(), True),
        T.StructField("fossil_fuel", T.IntegerType(), True),
        T.StructField("direct_e_tco2_gwh", T.DoubleType(), True),
        T.StructField("var_om_eur_gwh", T.DoubleType(), True),
        T.StructField("fixed_om_Meur_gwy", T.DoubleType(), True),
    ]
)

TECHNICAL_PARAMS = T.StructType(
    _fields(
        [f"elas_{s}" for s in fv.SECTORS]
        + ["grid_loss_factor"]
        + [f"{t}_{k}" for t in ("coal", "ccgt", "cogen") for k in ("min", "max", "ramp")]
        + ["diesel_min"]
        + [f"non_ren_waste_{k}" for k in ("min", "max", "ramp")]
        + ["conv_hydro_ramp"]
        + [f"ror_{k}_{s}" for s in ("high", "med_high", "med_low", "low") for k in ("lo", "hi")]
        + ["ror_ramp", "ph_storage_cap_gwh", "ph_roundtrip_eff", "batt_roundtrip_eff", "batt_duration"]
        + [f"{t}_{k}" for t in ("other_ren", "ren_waste") for k in ("min", "max", "ramp")]
        + ["voll_eur_mwh"],
        T.DoubleType(),
    )
)

PROJECTION_ESTIMATES = T.StructType(
    [T.StructField("variable", T.StringType(), False)]
    + _fields([f"hist_mean_value_{y}" for y in fv.BASE_YEARS], T.DoubleType())
    + _fields(["estimated_value_2030"], T.DoubleType())
    + _fields(["source", "type_estimate"], T.StringType())
    + _fields(["weight"], T.DoubleType())
    + _fields([f"delta_wrt_{y}" for y in fv.BASE_YEARS], T.DoubleType())
)

SCENARIOS = T.StructType(
    [
        T.StructField("scenario", T.StringType(), False),
        T.StructField("elas_anomaly", T.DoubleType(), False),
        T.StructField("hydro_anomaly", T.DoubleType(), False),
        T.StructField("coal_phase_out", T.BooleanType(), False),
        T.StructField("nuclear_phase_out", T.BooleanType(), False),
        T.StructField("climate_demand", T.BooleanType(), False),
        T.StructField("batt_cap_multiplier", T.DoubleType(), False),
        T.StructField("ren_cap_multiplier", T.DoubleType(), False),
    ]
)
