"""Names, lookup tables and constants that results depend on.

They describe the data model (technologies, sectors, scenario settings, unit
factors) and are stated here once, in natural order. Nothing else in the
package repeats them.
"""

# --- technologies, in table order -------------------------------------------------
NON_RENEWABLE = [
    "coal",
    "combined_cycle",
    "gas_turbine",
    "vapor_turbine",
    "cogeneration",
    "diesel",
    "nonrenewable_waste",
    "nuclear",
]
RENEWABLE = [
    "conventional_hydro",
    "run_of_river_hydro",
    "solar_pv",
    "solar_thermal",
    "wind",
    "other_renewable",
    "renewable_waste",
]
STORAGE = ["pumped_hydro", "battery"]
TECHNOLOGIES = NON_RENEWABLE + RENEWABLE + STORAGE
LOW_CARBON = ["nuclear"] + RENEWABLE

# capacity column of the hourly panel for each technology
CAPACITY_COLUMN = {t: f"{t}_cap_gw" for t in NON_RENEWABLE + RENEWABLE} | {
    "pumped_hydro": "pumped_hydro_turb_cap_gw",
    "battery": "batteries_cap_gw",
}
# historical generation column of the hourly panel for each technology
GENERATION_COLUMN = {t: f"{t}_gen_gwh" for t in NON_RENEWABLE + RENEWABLE} | {
    "pumped_hydro": "pumped_hydro_gen_gwh",
    "battery": "batteries_gen_gwh",
}
# fuel price column per fuelled technology
FUEL_COLUMN = {
    "coal": "cost_coal_eur_gwh",
    "combined_cycle": "cost_gas_eur_gwh",
    "gas_turbine": "cost_gas_eur_gwh",
    "vapor_turbine": "cost_gas_eur_gwh",
    "cogeneration": "cost_gas_eur_gwh",
    "diesel": "cost_diesel_eur_gwh",
    "nuclear": "cost_uranium_eur_gwh",
}
# names of the technical parameters holding the lower and upper output factor;
# None stands for 0 as a lower and 1 as an upper factor
OUTPUT_FACTORS = {
    "coal": ("coal_min", "coal_max"),
    "combined_cycle": ("ccgt_min", "ccgt_max"),
    "gas_turbine": (None, None),
    "vapor_turbine": (None, None),
    "cogeneration": ("cogen_min", "cogen_max"),
    "diesel": ("diesel_min", None),
    "nonrenewable_waste": ("non_ren_waste_min", "non_ren_waste_max"),
    "other_renewable": ("other_ren_min", "other_ren_max"),
    "renewable_waste": ("ren_waste_min", "ren_waste_max"),
}
# technologies that may produce up to capacity times an hourly availability factor
FACTOR_LIMITED = ["solar_pv", "solar_thermal", "wind"]
# names of the technical parameters holding the hourly ramp limit
RAMP_FACTOR = {
    "coal": "coal_ramp",
    "combined_cycle": "ccgt_ramp",
    "cogeneration": "cogen_ramp",
    "nonrenewable_waste": "non_ren_waste_ramp",
    "conventional_hydro": "conv_hydro_ramp",
    "run_of_river_hydro": "ror_ramp",
    "other_renewable": "other_ren_ramp",
    "renewable_waste": "ren_waste_ramp",
}
# technologies whose lower bound counts towards the non-renewable floor
FLOOR_TECHNOLOGIES = [
    "coal",
    "combined_cycle",
    "cogeneration",
    "diesel",
    "nonrenewable_waste",
    "nuclear",
]
# run-of-river season of each month, January first
RIVER_SEASON = [
    "high", "high", "med_high", "med_high", "med_high", "med_high",
    "med_low", "low", "low", "low", "med_low", "high",
]

# reporting groups of the descriptive tables
GENERATION_GROUP = {
    "coal": "Other non renewable",
    "combined_cycle": "Combined cycle",
    "gas_turbine": "Other non renewable",
    "vapor_turbine": "Other non renewable",
    "cogeneration": "Cogeneration",
    "diesel": "Other non renewable",
    "nonrenewable_waste": "Other non renewable",
    "nuclear": "Nuclear",
    "conventional_hydro": "Conventional hydro",
    "run_of_river_hydro": "Other renewable",
    "solar_pv": "Solar PV",
    "solar_thermal": "Other renewable",
    "wind": "Wind",
    "other_renewable": "Other renewable",
    "renewable_waste": "Other renewable",
    "pumped_hydro": "Pumped hydro",
    "battery": "Batteries",
}

# --- sectors, borders --------------------------------------------------------------
SECTORS = ["residential", "commercial", "industrial"]
BORDERS = ["France", "Portugal", "Morocco"]
VOLTAGE_LEVELS = [
    "less1kV", "1kV_14kV", "14kV_36kV", "36kV_72.5kV",
    "72.5kV_145kV", "145kV_220kV", "more220kV",
]
SECTOR_OF_LEVEL = {
    "less1kV": "residential",
    "1kV_14kV": "commercial",
    "14kV_36kV": "commercial",
    "36kV_72.5kV": "industrial",
    "72.5kV_145kV": "industrial",
    "145kV_220kV": "industrial",
    "more220kV": "industrial",
}
CAP_FACTOR_COLUMNS = [
    "nuclear_cap_factor", "solar_pv_cap_factor", "solar_thermal_cap_factor", "wind_cap_factor",
]
COST_COLUMNS = [
    "cost_coal_eur_gwh", "cost_gas_eur_gwh", "cost_diesel_eur_gwh", "cost_uranium_eur_gwh",
    "eu_ets_price_eur_tco2",
]

# --- feed identifiers --------------------------------------------------------------
INDICATOR_NAMES = {
    1201: "demand_less1kV_mwh", 1202: "demand_1kV_14kV_mwh", 1203: "demand_14kV_36kV_mwh",
    1204: "demand_36kV_72.5kV_mwh", 1205: "demand_72.5kV_145kV_mwh",
    1206: "demand_145kV_220kV_mwh", 1207: "demand_more220kV_mwh",
    2037: "total_national_demand_mwh",
    10207: "net_raw_France_mwh", 10208: "net_raw_Portugal_mwh", 10209: "net_raw_Morocco_mwh",
    600: "spot_price_eur_mwh",
    2038: "wind_gen_mwh", 2039: "nuclear_gen_mwh", 2040: "coal_gen_mwh",
    2041: "combined_cycle_gen_mwh", 2042: "conventional_hydro_gen_mwh", 2044: "solar_pv_gen_mwh",
    2045: "solar_thermal_gen_mwh", 2047: "diesel_gen_mwh", 2048: "gas_turbine_gen_mwh",
    2049: "vapor_turbine_gen_mwh", 2046: "other_renewable_gen_mwh",
    10039: "cogeneration_gen_mwh", 10040: "nonrenewable_waste_gen_mwh",
    10062: "renewable_waste_gen_mwh", 474: "nuclear_self_reported_cap_mw",
}
MONTHLY_CAPACITY_NAMES = {
    1478: "coal_cap_mw", 1483: "combined_cycle_cap_mw", 1480: "gas_turbine_cap_mw",
    1481: "vapor_turbine_cap_mw", 1489: "cogeneration_cap_mw", 1479: "diesel_cap_mw",
    1490: "nonrenewable_waste_cap_mw", 1477: "nuclear_cap_mw", 1475: "conventional_hydro_cap_mw",
    1476: "pumped_hydro_cap_mw", 1486: "solar_pv_cap_mw", 1487: "solar_thermal_cap_mw",
    1485: "wind_cap_mw", 1488: "other_renewable_cap_mw", 1491: "renewable_waste_cap_mw",
}
# indicators reported per area, to be added up
AREA_SUMMED_INDICATORS = [10039, 10040, 10062, 472, 474]
# hydro feed: output column and the substrings its source column name contains
HYDRO_FEED_COLUMNS = {
    "run_of_river_hydro_gen_mwh": ["Run-of-river"],
    "conventional_hydro_gen_mwh": ["Reservoir"],
    "pumped_hydro_gen_mwh": ["Pumped Storage", "Aggregated"],
    "pumped_hydro_consumption_mwh": ["Pumped Storage", "Consumption"],
}

# --- capacities, units, thresholds -------------------------------------------------
FIXED_CAPACITY_MW = {
    "run_of_river_hydro_cap_mw": 3453.0,
    "pumped_hydro_turb_cap_mw": 3331.0,
    "pumped_hydro_pump_cap_mw": 2278.0,
    "conventional_hydro_cap_mw": 13655.0,
}
BATTERY_MW_BY_YEAR = {2020: 10.0, 2021: 10.0, 2022: 15.0, 2023: 25.0, 2024: 25.0}
BATTERY_MW_DEFAULT = 25.0
# MWh of fuel per traded unit (tonne, US gallon, pound)
MWH_PER_UNIT = {"coal": 8.14, "diesel": 0.0406, "uranium": 30.211}
RESCALE_MEAN_THRESHOLD = 50000.0
MIN_SOURCE_ROWS = 100
PRICE_FLOOR = 0.5
SMALL_VALUE = 1e-3
BUNDLE_HOURS = 168
WINDOW_DAYS = 7
MAX_DAY_START = 21
HOURS_PER_YEAR = 365.25 * 24
TARGET_SHARE = 81.0
SHED_HOUR_THRESHOLD = 0.001
CONFIDENCE_Z = 1.96
PEAK_MARGIN = 0.02
ACCEPTED_BELOW_TWH = 300.0

# --- sampling ----------------------------------------------------------------------
BASE_YEARS = [2020, 2021, 2022, 2023, 2024]
JITTER_SD = 0.05
NARROW_SD = 0.05
KDE_POINTS = 2048
KDE_BANDWIDTH_FACTOR = 0.75
KDE_TAIL_BANDWIDTHS = 4.0
CLAMP_MARGIN = 0.1
CLAMP_FLOOR = -0.99
PUMP_TO_TURBINE = 0.7
# demand multiplier of the climate scenario, January first
CLIMATE_MULTIPLIER = [0.98, 0.98, 0.99, 1.01, 1.03, 1.06, 1.10, 1.10, 1.06, 1.03, 0.99, 0.98]
DRAWN_VARIABLES = [
    "total_national_demand_gwh",
    "coal_cap_gw", "combined_cycle_cap_gw", "gas_turbine_cap_gw", "vapor_turbine_cap_gw",
    "cogeneration_cap_gw", "diesel_cap_gw", "nonrenewable_waste_cap_gw", "nuclear_cap_gw",
    "conventional_hydro_cap_gw", "run_of_river_hydro_cap_gw", "pumped_hydro_turb_cap_gw",
    "solar_pv_cap_gw", "solar_thermal_cap_gw", "wind_cap_gw", "other_renewable_cap_gw",
    "renewable_waste_cap_gw", "batteries_cap_gw",
    "cost_coal_eur_gwh", "cost_gas_eur_gwh", "cost_diesel_eur_gwh", "cost_uranium_eur_gwh",
    "eu_ets_price_eur_tco2",
]
# drawn variable -> (target variable, factor); variables not listed map to themselves
DELTA_FANOUT = {
    "pumped_hydro_turb_cap_gw": [
        ("pumped_hydro_turb_cap_gw", 1.0), ("pumped_hydro_pump_cap_gw", PUMP_TO_TURBINE),
    ],
    "total_national_demand_gwh": [(f"{s}_demand_gwh", 1.0) for s in SECTORS],
}
# scenario, demand elasticity factor, hydro factor, coal phase-out, nuclear phase-out,
# climate demand, battery multiplier, renewable multiplier
SCENARIO_ROWS = [
    ("baseline", 1.0, 1.0, True, True, False, 1.0, 1.0),
    ("nuclear", 1.0, 1.0, True, False, False, 0.5, 0.75),
    ("optimistic", 2.0, 1.0, True, True, False, 1.5, 1.25),
    ("climate change", 1.0, 0.8, True, True, True, 1.0, 1.0),
    ("no batteries", 1.0, 1.0, True, True, False, 0.0, 1.0),
]
SCENARIO_ORDER = [row[0] for row in SCENARIO_ROWS]

# --- demand history and projections (TWh) --------------------------------------------
HISTORICAL_DEMAND_TWH = [
    (2015, 262.81), (2016, 264.67), (2017, 267.87), (2018, 268.89), (2019, 264.66),
]
PROJECTED_DEMAND_TWH = [344.0, 274.0, 295.0, 330.0, 311.70, 351.06, 286.5, 280.0, 294.0]
