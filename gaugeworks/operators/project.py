"""Derived columns: plasma quantities, categories, bins, polynomial terms and formula metrics.

Quantities are column factories over given names, so they serve any table. All of them stay inside
code generation.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, functions as F

from gaugeworks.session import scalar_row

# Physical constants and machine geometry.
BOLTZMANN = 1.38e-23
ELECTRON_CHARGE = 1.6e-19
VACUUM_PERMITTIVITY = 8.85e-12
ELECTRON_MASS = 9.11e-31
ION_MASS = 3.34e-27
VACUUM_PERMEABILITY = 4e-7 * math.pi
EPSILON = 1e-6
LAWSON_REFERENCE = 1e21
TROYON_FACTOR = 0.028
MAJOR_RADIUS, PLASMA_CROSS = 6.2, 4.0

# Upper bound (exclusive) and name of each performance level.
FOUR_LEVELS = [(0.1, "Poor"), (1.0, "Sub-critical"), (5.0, "Breakeven"), (10.0, "Ignition"), (None, "High Performance")]
SIX_LEVELS = [(0.1, "Very Poor"), (0.5, "Poor"), (1.0, "Sub-critical"), (5.0, "Break-even"), (10.0, "Ignition"), (None, "High Performance")]


def _c(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def thermal_energy_density(temperature, density) -> Column:
    return _c(temperature) * _c(density) * F.lit(BOLTZMANN)


def magnetic_pressure(field) -> Column:
    return _c(field) * _c(field) / F.lit(2 * VACUUM_PERMEABILITY)


def plasma_frequency(density) -> Column:
    return F.sqrt(_c(density) * F.lit(ELECTRON_CHARGE**2) / F.lit(VACUUM_PERMITTIVITY * ELECTRON_MASS))


def gyrofrequency(field) -> Column:
    return F.lit(ELECTRON_CHARGE) * _c(field) / F.lit(2 * ION_MASS)


def thermal_velocity(temperature) -> Column:
    return F.sqrt(2 * F.lit(BOLTZMANN) * _c(temperature) / F.lit(ION_MASS))


def power_efficiency(power, heating) -> Column:
    return _c(power) / (_c(heating) + F.lit(EPSILON))


def normalized_lawson(lawson) -> Column:
    return _c(lawson) / F.lit(LAWSON_REFERENCE)


def troyon_ratio(beta, safety) -> Column:
    return F.try_divide(_c(beta), F.lit(TROYON_FACTOR) * _c(safety))


def shot_progress(elapsed, duration) -> Column:
    return F.try_divide(_c(elapsed).cast("double"), _c(duration).cast("double"))


def fuel_ratio(deuterium, tritium) -> Column:
    return _c(deuterium) / (_c(tritium) + F.lit(EPSILON))


def row_mean(cols: Sequence[str]) -> Column:
    """Mean of the present values of a row; null when none is present."""
    vals = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in cols]
    total = sum((F.coalesce(v, F.lit(0.0)) for v in vals[1:]), F.coalesce(vals[0], F.lit(0.0)))
    n = sum((v.isNotNull().cast("int") for v in vals[1:]), vals[0].isNotNull().cast("int"))
    return F.try_divide(total, n)


def overall_health(df: DataFrame, marker: str = "health") -> DataFrame:
    cols = [c for c in df.columns if marker in c]
    return df.withColumn("overall_health", row_mean(cols)) if cols else df


# Feature name -> (input columns, column factory); a feature is added when all its inputs exist.
FEATURES = {
    "thermal_energy_density": (("plasma_temperature", "plasma_density"), thermal_energy_density),
    "magnetic_pressure": (("magnetic_field",), magnetic_pressure),
    "plasma_frequency": (("plasma_density",), plasma_frequency),
    "gyrofrequency": (("magnetic_field",), gyrofrequency),
    "thermal_velocity": (("plasma_temperature",), thermal_velocity),
    "power_efficiency": (("fusion_power", "total_heating_power"), power_efficiency),
    "normalized_lawson": (("lawson_criterion",), normalized_lawson),
    "troyon_ratio": (("beta_plasma", "safety_factor"), troyon_ratio),
    "shot_progress": (("time_in_shot", "shot_duration"), shot_progress),
    "dt_ratio": (("deuterium_fraction", "tritium_fraction"), fuel_ratio),
}


def engineer(df: DataFrame, features: dict = FEATURES) -> DataFrame:
    """All features whose inputs exist, in one projection."""
    have = set(df.columns)
    new = {n: make(*cols) for n, (cols, make) in features.items() if have.issuperset(cols)}
    return overall_health(df.withColumns(new) if new else df)


def fusion_metrics(df: DataFrame, density: str, confinement: str, temperature: str, fusion: str, beam: str, rf: str, deuterium: str) -> DataFrame:
    lawson = F.col(density) * F.col(confinement)
    heating = F.col(beam) + F.col(rf)
    return df.withColumns({
        "lawson_criterion": lawson, "triple_product": lawson * F.col(temperature),
        "total_heating_power": heating, "q_factor": F.try_divide(F.col(fusion), heating), "tritium_fraction": 1 - F.col(deuterium),
    })


def normalize_units(df: DataFrame, rules: dict[str, tuple[float, float]]) -> DataFrame:
    """Divide a column by its factor when the column's maximum shows the larger unit.

    `rules` maps a column to (limit, factor). One aggregate serves all columns.
    """
    top = scalar_row(df.agg(*[F.max(c).alias(c) for c in rules]))
    return df.withColumns({c: F.when(top[c] > limit, F.col(c) / factor).otherwise(F.col(c)) for c, (limit, factor) in rules.items()})


def derived_metrics(df: DataFrame, temperature: str, density: str, energy: str, loss: str, field: str) -> DataFrame:
    """Pressure from million-kelvin and 1e19 units, confinement from energy over loss, beta from both pressures."""
    pressure = F.col(temperature) * 1e6 * F.col(density) * 1e19 * F.lit(BOLTZMANN)
    return df.withColumns({
        "pressure": pressure, "confinement_time": F.try_divide(F.col(energy), F.col(loss)),
        "beta": F.try_divide(pressure, magnetic_pressure(field)),
    })


def level(value, levels: list[tuple[float | None, str]] = FOUR_LEVELS) -> Column:
    out = None
    for bound, name in levels:
        if bound is None:
            return out.otherwise(name)
        out = F.when(_c(value) < bound, name) if out is None else out.when(_c(value) < bound, name)
    return out


def cut(value, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bins; values at or below the first edge or above the last are null."""
    out = F.lit(None).cast("string")
    for lo, hi, name in reversed(list(zip(edges, edges[1:], labels))):
        inside = (_c(value) > lo) if math.isinf(hi) else (_c(value) > lo) & (_c(value) <= hi)
        out = F.when(inside, name).otherwise(out)
    return out


def prediction_confidence(q) -> Column:
    return F.least(F.lit(0.95), F.greatest(F.lit(0.6), 1 - F.abs(_c(q) - 1) * 0.2))


def polynomial(df: DataFrame, cols: Sequence[str], degree: int = 2) -> DataFrame:
    """All monomials of the columns up to `degree`, named like `a`, `a^2`, `a b`."""
    new = {}
    for d in range(1, degree + 1):
        for combo in combinations_with_replacement(cols, d):
            name = " ".join(c if combo.count(c) == 1 else f"{c}^{combo.count(c)}" for c in dict.fromkeys(combo))
            term = F.col(combo[0])
            for c in combo[1:]:
                term = term * F.col(c)
            new[name] = term
    return df.withColumns(new)


def clip(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> DataFrame:
    """Limit columns to their bounds, nulls stay."""
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(F.lit(hi), F.greatest(F.lit(lo), F.col(c)))) for c, (lo, hi) in bounds.items()})


def scenario_columns(df: DataFrame, beam: str, rf: str) -> DataFrame:
    total = F.col(beam) + F.col(rf)
    return df.withColumns({
        "total_power": total,
        "power_density": total / F.lit(4 * math.pi**2 * MAJOR_RADIUS * PLASMA_CROSS) * 1e6,
    })


# Name, formula, category, target (or none), better direction.
BUSINESS_METRICS = [
    ("Energy Efficiency", "energy_output / energy_input", "Performance", 1.0, "higher"),
    ("Operational Cost per Hour", "total_operational_cost / operating_hours", "Financial", None, "lower"),
    ("Prediction Accuracy Rate", "correct_predictions / total_predictions", "Quality", 0.95, "higher"),
    ("System Availability", "uptime_hours / total_hours", "Reliability", 0.999, "higher"),
    ("Data Processing Throughput", "processed_data_points / processing_time", "Performance", None, "higher"),
]


def formula(df: DataFrame, text: str) -> Column:
    """A formula over named columns; unknown names, a zero divisor or missing input give 0.0."""
    names = set(re.findall(r"[A-Za-z_]\w*", text))
    if not names.issubset(df.columns):
        return F.lit(0.0)
    # try_divide keeps a zero divisor from failing the query under ANSI rules.
    safe = re.sub(r"([\w.]+)\s*/\s*([\w.]+)", r"try_divide(\1, \2)", text)
    return F.coalesce(F.expr(safe).cast("double"), F.lit(0.0))
