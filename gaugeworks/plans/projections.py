"""Derived columns on the test tables, which stand in for plasma samples."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from gaugeworks.operators import project as p
from gaugeworks.plans.registry import query, r

# lineitem as samples: quantity = temperature, price = density, discount and tax as small ratios.
SAMPLE_SQL = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity * 1e6 AS t, l_extendedprice * 1e15 AS n,
           l_quantity / 10 AS b, l_discount + 0.0 AS d, l_tax + 0.0 AS x, l_extendedprice AS price FROM lineitem"""


def samples(t):
    return t.lineitem.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity * 1e6 t", "l_extendedprice * 1e15 n",
        "l_quantity / 10 b", "l_discount + 0.0 d", "l_tax + 0.0 x", "l_extendedprice price")


KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEY_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query("prj_01_thermal_energy_density", f"SELECT {KEY_SQL}, round(t * n * 1.38e-23, 7) AS v FROM ({SAMPLE_SQL})")
def thermal(t):
    return samples(t).select(*KEY, r(p.thermal_energy_density("t", "n"), 7).alias("v"))


@query("prj_02_magnetic_pressure", f"SELECT {KEY_SQL}, round(b * b / (2 * 4e-7 * pi()), 2) AS v FROM ({SAMPLE_SQL})")
def magnetic(t):
    return samples(t).select(*KEY, r(p.magnetic_pressure("b"), 2).alias("v"))


@query("prj_03_plasma_frequency", f"SELECT {KEY_SQL}, round(sqrt(n * (1.6e-19 * 1.6e-19) / (8.85e-12 * 9.11e-31)) / 1e6, 4) AS v FROM ({SAMPLE_SQL})")
def frequency(t):
    return samples(t).select(*KEY, r(p.plasma_frequency("n") / 1e6, 4).alias("v"))


@query("prj_04_gyro_and_velocity", f"""
    SELECT {KEY_SQL}, round(1.6e-19 * b / (2 * 3.34e-27) / 1e3, 4) AS gyro, round(sqrt(2 * 1.38e-23 * t / 3.34e-27), 4) AS velocity FROM ({SAMPLE_SQL})""")
def gyro(t):
    return samples(t).select(*KEY, r(p.gyrofrequency("b") / 1e3, 4).alias("gyro"), r(p.thermal_velocity("t"), 4).alias("velocity"))


@query("prj_05_power_efficiency", f"SELECT {KEY_SQL}, round(price / (x + 1e-6), 2) AS v FROM ({SAMPLE_SQL})")
def efficiency(t):
    return samples(t).select(*KEY, r(p.power_efficiency("price", "x"), 2).alias("v"))


@query("prj_06_lawson_troyon", f"""
    SELECT {KEY_SQL}, round(n / 1e21, 9) AS lawson, round(d / nullif(0.028 * x, 0), 6) AS troyon FROM ({SAMPLE_SQL})""")
def lawson(t):
    return samples(t).select(*KEY, r(p.normalized_lawson("n"), 9).alias("lawson"), r(p.troyon_ratio("d", "x")).alias("troyon"))


@query("prj_07_progress_ratio", f"""
    SELECT {KEY_SQL}, round(CAST(l_linenumber AS DOUBLE) / nullif(CAST(l_suppkey AS DOUBLE), 0), 6) AS progress, round(d / (x + 1e-6), 6) AS dt_ratio FROM ({SAMPLE_SQL})""")
def progress(t):
    return samples(t).select(*KEY, r(p.shot_progress("l_linenumber", "l_suppkey")).alias("progress"), r(p.fuel_ratio("d", "x")).alias("dt_ratio"))


@query("prj_08_overall_health", """
    SELECT o_orderkey, round((o_totalprice / 1e6 + coalesce(CASE WHEN o_custkey % 7 <> 0 THEN o_custkey / 1e4 END, 0.0)) / (CASE WHEN o_custkey % 7 <> 0 THEN 2 ELSE 1 END), 9) AS overall_health FROM orders""")
def health(t):
    df = t.orders.selectExpr("o_orderkey", "o_totalprice / 1e6 magnet_health", "if(o_custkey % 7 <> 0, o_custkey / 1e4, null) cooling_health")
    return p.overall_health(df).select("o_orderkey", r("overall_health", 9).alias("overall_health"))


@query("prj_09_engineered_features", f"""
    SELECT {KEY_SQL}, round(t * n * 1.38e-23, 7) AS thermal_energy_density, round(b * b / (2 * 4e-7 * pi()), 2) AS magnetic_pressure,
           round(sqrt(n * (1.6e-19 * 1.6e-19) / (8.85e-12 * 9.11e-31)) / 1e6, 4) AS plasma_frequency,
           round(d / (x + 1e-6), 6) AS dt_ratio FROM ({SAMPLE_SQL})""")
def engineered(t):
    named = samples(t).withColumnsRenamed({"t": "plasma_temperature", "n": "plasma_density", "b": "magnetic_field", "d": "deuterium_fraction", "x": "tritium_fraction"})
    got = p.engineer(named)
    return got.select(*KEY, r("thermal_energy_density", 7).alias("thermal_energy_density"), r("magnetic_pressure", 2).alias("magnetic_pressure"),
                      r(F.col("plasma_frequency") / 1e6, 4).alias("plasma_frequency"), r("dt_ratio").alias("dt_ratio"))


@query("prj_10_fusion_metrics", f"""
    SELECT {KEY_SQL}, round(price * d, 4) AS lawson_criterion, round(price * d * b, 6) AS triple_product, round(b + x, 6) AS total_heating_power,
           round(price / (b + x), 7) AS q_factor, round(1 - d, 6) AS tritium_fraction FROM ({SAMPLE_SQL})""")
def fusion(t):
    got = p.fusion_metrics(samples(t), "price", "d", "b", "price", "b", "x", "d")
    return got.select(*KEY, r("lawson_criterion", 4).alias("lawson_criterion"), r("triple_product", 6).alias("triple_product"),
                      r("total_heating_power").alias("total_heating_power"), r("q_factor", 7).alias("q_factor"), r("tritium_fraction").alias("tritium_fraction"))


@query("prj_11_unit_normalization", """
    SELECT p_partkey, CASE WHEN (SELECT max(p_retailprice) FROM part) > 1000 THEN round(p_retailprice / 1e6, 9) ELSE p_retailprice END AS p_retailprice,
           CASE WHEN (SELECT max(p_size) FROM part) > 100 THEN p_size / 1e19 ELSE CAST(p_size AS DOUBLE) END AS p_size FROM part""")
def units(t):
    got = p.normalize_units(t.part, {"p_retailprice": (1000.0, 1e6), "p_size": (100.0, 1e19)})
    return got.select("p_partkey", r("p_retailprice", 9).alias("p_retailprice"), F.col("p_size").cast("double").alias("p_size"))


@query("prj_12_derived_metrics", f"""
    SELECT {KEY_SQL}, round(b * 1e6 * x * 1e19 * 1.38e-23, 6) AS pressure, round(price / nullif(d, 0), 4) AS confinement_time,
           round(b * 1e6 * x * 1e19 * 1.38e-23 / nullif(b * b / (2 * 4e-7 * pi()), 0), 9) AS beta FROM ({SAMPLE_SQL})""")
def derived(t):
    got = p.derived_metrics(samples(t), "b", "x", "price", "d", "b")
    return got.select(*KEY, r("pressure").alias("pressure"), r("confinement_time", 4).alias("confinement_time"), r("beta", 9).alias("beta"))


@query("prj_13_performance_category", """
    SELECT o_orderkey, CASE WHEN q < 0.1 THEN 'Poor' WHEN q < 1 THEN 'Sub-critical' WHEN q < 5 THEN 'Breakeven' WHEN q < 10 THEN 'Ignition' ELSE 'High Performance' END AS category
    FROM (SELECT o_orderkey, o_totalprice / 40000 AS q FROM orders)""")
def category(t):
    return t.orders.select("o_orderkey", p.level(F.col("o_totalprice") / 40000).alias("category"))


@query("prj_14_performance_category_six", """
    SELECT o_orderkey, CASE WHEN q < 0.1 THEN 'Very Poor' WHEN q < 0.5 THEN 'Poor' WHEN q < 1 THEN 'Sub-critical' WHEN q < 5 THEN 'Break-even' WHEN q < 10 THEN 'Ignition' ELSE 'High Performance' END AS category
    FROM (SELECT o_orderkey, o_totalprice / 40000 AS q FROM orders)""")
def category_six(t):
    return t.orders.select("o_orderkey", p.level(F.col("o_totalprice") / 40000, p.SIX_LEVELS).alias("category"))


@query("prj_15_binning", """
    SELECT CASE WHEN v <= 0 THEN NULL WHEN v <= 0.1 THEN 'low' WHEN v <= 1 THEN 'mid' WHEN v <= 5 THEN 'high' ELSE 'top' END AS bin, count(*) AS n
    FROM (SELECT value / 20 - 0.1 AS v FROM events) GROUP BY 1""")
def binning(t):
    v = F.col("value") / 20 - 0.1
    return t.events.groupBy(p.cut(v, [0, 0.1, 1, 5, math.inf], ["low", "mid", "high", "top"]).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("prj_16_prediction_confidence", "SELECT event_id, round(least(0.95, greatest(0.6, 1 - abs(value / 30 - 1) * 0.2)), 6) AS confidence FROM events")
def confidence(t):
    return t.events.select("event_id", r(p.prediction_confidence(F.col("value") / 30)).alias("confidence"))


@query("prj_17_polynomial_features", """
    SELECT p_partkey, CAST(p_size AS DOUBLE) AS a, p_retailprice AS b, CAST(p_size * p_size AS DOUBLE) AS "a^2", round(p_size * p_retailprice, 4) AS "a b",
           round(p_retailprice * p_retailprice, 4) AS "b^2" FROM part""")
def polynomial(t):
    got = p.polynomial(t.part.selectExpr("p_partkey", "cast(p_size as double) a", "p_retailprice b"), ["a", "b"], 2)
    return got.select("p_partkey", "a", "b", "a^2", r("a b", 4).alias("a b"), r("b^2", 4).alias("b^2"))


@query("prj_18_bounds_clip", "SELECT event_id, least(60.0, greatest(5.0, value)) AS value FROM events")
def bounds(t):
    return p.clip(t.events.select("event_id", "value"), {"value": (5.0, 60.0)})


@query("prj_19_scenario_columns", f"""
    SELECT {KEY_SQL}, round(b + x, 6) AS total_power, round((b + x) / (4 * pi() * pi() * 6.2 * 4) * 1e6, 4) AS power_density FROM ({SAMPLE_SQL})""")
def scenario(t):
    return p.scenario_columns(samples(t), "b", "x").select(*KEY, r("total_power").alias("total_power"), r("power_density", 4).alias("power_density"))


@query("prj_20_formula_metrics", """
    SELECT o_orderkey, coalesce(round(sqrt(o_totalprice) / nullif(o_custkey, 0), 7), CAST(0 AS DOUBLE)) AS ratio, o_totalprice AS direct, CAST(0 AS DOUBLE) AS unknown FROM orders""")
def formulas(t):
    df = t.orders.withColumn("root", F.sqrt("o_totalprice"))
    return df.select("o_orderkey", r(p.formula(df, "root / o_custkey"), 7).alias("ratio"),
                     p.formula(df, "o_totalprice").alias("direct"), p.formula(df, "energy_output / energy_input").alias("unknown"))
