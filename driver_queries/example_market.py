"""An example market of round numbers, made by rule, for queries and tests.

Nothing here is a measured or published figure. Position is a technology's place in
``fixed_values.TECHNOLOGIES``, from 1.
"""

from __future__ import annotations

from gridpanel import fixed_values as fv
from gridpanel import schemas

BURNING = [t for t in fv.TECHNOLOGIES if t in fv.FUEL_COLUMN and t != "nuclear"] + ["nonrenewable_waste"]


def _row(position: int, technology: str) -> tuple:
    fossil = technology in BURNING
    return (
        technology,
        0.5 if technology in fv.FUEL_COLUMN else 0.0,
        int(fossil),
        100.0 * position if fossil else 0.0,
        1000.0 * (position * 5 % 17),
        10.0 * position,
    )


TECHNOLOGY_ROWS = [_row(i, t) for i, t in enumerate(fv.TECHNOLOGIES, 1)]
NAMES = [f.name for f in schemas.TECHNOLOGY.fields]
TECH = {row[0]: dict(zip(NAMES, row)) for row in TECHNOLOGY_ROWS}
#: Direct emissions of the technologies that burn something.
EMISSIONS = {t: row["direct_e_tco2_gwh"] for t, row in TECH.items() if row["fossil_fuel"]}

SINGLE = {
    "grid_loss_factor": 0.02,
    "ph_storage_cap_gwh": 40.0,
    "ph_roundtrip_eff": 0.8,
    "batt_roundtrip_eff": 0.8,
    "batt_duration": 5.0,
    "voll_eur_mwh": 10_000.0,
}
# share of capacity by kind of limit; run-of-river seasons from high to low
BY_ENDING = {"min": 0.1, "max": 0.8, "ramp": 0.2}
SEASONS = ["low", "med_low", "med_high", "high"]


def _parameter(name: str) -> float:
    if name in SINGLE:
        return SINGLE[name]
    if name.startswith("elas_"):
        return 0.01 * (1 + fv.SECTORS.index(name.removeprefix("elas_")))
    if name.startswith(("ror_lo_", "ror_hi_")):
        return 0.1 * (1 + SEASONS.index(name[7:])) + (0.2 if name.startswith("ror_hi_") else 0.0)
    return BY_ENDING[name.rsplit("_", 1)[1]]


PARAMS = {f.name: _parameter(f.name) for f in schemas.TECHNICAL_PARAMS.fields}
