"""Time-series queries on the test tables: event values per type or user."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import series as s
from gaugeworks.plans.aggregations import rounded
from gaugeworks.plans.learning import ols
from gaugeworks.plans.registry import query


def hours(t):
    return s.buckets(t.events.select("event_type", "ts", F.sqrt("value").alias("value")), ["event_type"], "ts", "value", "hour")


HOURS = """(WITH m AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS bucket, avg(sqrt(value)) AS v FROM events GROUP BY 1, 2), g AS (SELECT event_type, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 HOUR)) AS bucket FROM m GROUP BY 1)
    SELECT event_type, bucket, last_value(v IGNORE NULLS) OVER (PARTITION BY event_type ORDER BY bucket ROWS UNBOUNDED PRECEDING) AS value, row_number() OVER (PARTITION BY event_type ORDER BY bucket) AS p, count(*) OVER (PARTITION BY event_type) AS n FROM g LEFT JOIN m USING (event_type, bucket))"""


@query("tsa_01_series_features", """
    WITH e AS (SELECT user_id, value AS v, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS p, avg(value) OVER (PARTITION BY user_id) AS m FROM events),
         g AS (SELECT user_id, count(*) AS n, avg(v) AS mean, stddev_pop(v) AS std, var_pop(v) AS variance, avg(pow(v - m, 3)) / pow(avg(pow(v - m, 2)), 1.5) AS skewness, avg(pow(v - m, 4)) / pow(avg(pow(v - m, 2)), 2) - 3 AS kurtosis, regr_slope(v, p) AS trend_slope, regr_r2(v, p) AS trend_r2 FROM e GROUP BY 1)
    SELECT user_id, n, """ + ", ".join(f"CASE WHEN n >= 10 THEN round({c}, 6) + 0.0::DOUBLE ELSE 0.0::DOUBLE END AS {c}" for c in ("mean", "std", "variance", "skewness", "kurtosis", "trend_slope", "trend_r2")) + " FROM g")
def features(t):
    return rounded(s.features(t.events.select("user_id", "ts", "event_id", "value"), ["user_id"], ["ts", "event_id"], "value"))


@query("tsa_02_spectrum", f"""
    WITH h AS MATERIALIZED {HOURS}, f AS MATERIALIZED (SELECT event_type, n, k, pow(sum(value * cos(2 * pi() * ((k * (p - 1)) % n) / n)), 2) + pow(sum(value * sin(2 * pi() * ((k * (p - 1)) % n) / n)), 2) AS power FROM h JOIN range(0, 1000) r(k) ON k < n GROUP BY event_type, n, k),
    s AS (SELECT *, power / sum(power) OVER (PARTITION BY event_type) AS share FROM f)
    SELECT event_type, n, round((arg_max(k, power) FILTER (k > 0 AND 2 * k < n)) / n, 6) AS dominant_frequency, round(-sum(share * log2(share + 1e-12)), 6) AS spectral_entropy FROM s GROUP BY event_type, n""")
def spectrum(t):
    return rounded(s.spectrum(hours(t), ["event_type"], "bucket", "value"))


DECOMP = f"""(WITH h AS (SELECT * FROM {HOURS}), t AS (SELECT *, (avg(value) OVER (PARTITION BY event_type ORDER BY p ROWS BETWEEN 12 PRECEDING AND 11 FOLLOWING) + avg(value) OVER (PARTITION BY event_type ORDER BY p ROWS BETWEEN 11 PRECEDING AND 12 FOLLOWING)) / 2 AS trend FROM h),
    i AS (SELECT *, (p - 1) % 24 AS phase, value - trend AS d FROM t WHERE p > 12 AND p <= n - 12), f AS (SELECT event_type, phase, avg(d) AS s FROM i GROUP BY 1, 2), c AS (SELECT event_type, phase, s - avg(s) OVER (PARTITION BY event_type) AS seasonal FROM f)
    SELECT event_type, bucket, phase::INT AS phase, value, trend, seasonal, d - seasonal AS residual FROM i JOIN c USING (event_type, phase))"""


@query("tsa_03_decomposition", f"SELECT event_type, bucket, phase, round(value, 6) AS value, round(trend, 6) AS trend, round(seasonal, 6) + 0.0::DOUBLE AS seasonal, round(residual, 6) + 0.0::DOUBLE AS residual FROM {DECOMP}")
def decomposition(t):
    return rounded(s.decompose(hours(t), ["event_type"], ["bucket"], "value", 24))


@query("tsa_03_seasonal_strength", f"SELECT event_type, round(var_pop(seasonal) / (var_pop(seasonal) + var_pop(residual)), 6) AS seasonal_strength FROM {DECOMP} GROUP BY 1")
def strength(t):
    return rounded(s.seasonal_strength(s.decompose(hours(t), ["event_type"], ["bucket"], "value", 24), ["event_type"]))


@query("tsa_04_stationarity", """
    WITH e AS (SELECT event_type, ts, value, lag(value) OVER w AS l, value - lag(value) OVER w AS d, sum(value - m) OVER w AS s FROM (SELECT *, avg(value) OVER (PARTITION BY event_type) AS m FROM events) WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
         g AS (SELECT event_type, regr_count(d, l) AS n, regr_slope(d, l) AS b, regr_sxx(d, l) AS sxx, regr_syy(d, l) AS syy, sum(s * s) / (pow(count(*), 2) * var_pop(value)) AS k FROM e GROUP BY 1)
    SELECT event_type, round(b / sqrt((syy - b * b * sxx) / ((n - 2) * sxx)), 5) AS df_statistic, round(k, 6) AS kpss_statistic, b / sqrt((syy - b * b * sxx) / ((n - 2) * sxx)) < -2.86 AND k < 0.463 AS stationary FROM g""")
def stationarity(t):
    return rounded(s.stationarity(t.events.select("event_type", "ts", "event_id", "value"), ["event_type"], ["ts", "event_id"], "value"), 6, df_statistic=5)


@query("tsa_04_unit_root", f"""
    WITH e AS (SELECT event_type, ts, value - avg(value) OVER (PARTITION BY event_type) AS v FROM events), l AS (SELECT event_type, ts, lag(v) OVER w AS q, v - lag(v) OVER w AS y FROM e WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
    r AS MATERIALIZED (SELECT event_type, y, q, lag(y, 1) OVER w AS d, lag(y, 2) OVER w AS x FROM l WINDOW w AS (PARTITION BY event_type ORDER BY ts)), f AS (SELECT * FROM r WHERE x IS NOT NULL), c AS {ols("f", "event_type")},
    v AS (SELECT event_type, count(*) AS n, sum(pow(y - b0 - b1 * q - b2 * d - b3 * x, 2)) / (count(*) - 4) AS s2, any_value(b1) AS b1, any_value(dd * xx - dx * dx) / any_value(det) / count(*) AS inv FROM f JOIN c USING (event_type) GROUP BY 1)
    SELECT event_type, n AS observations, round(b1 / sqrt(s2 * inv), 5) AS adf_statistic FROM v""")
def unit_root(t):
    """With exactly two lagged differences, as SQL can state."""
    e = t.events.select("event_type", "ts", "event_id", "value")
    return rounded(s.unit_root(e, ["event_type"], ["ts", "event_id"], "value", 2, choose=False).select("event_type", "observations", "adf_statistic"), 5)


@query("tsa_04_stationarity_tests")
def stationarity_tests(t):
    return rounded(s.stationarity_tests(t.events.select("event_type", "ts", "event_id", "value"), ["event_type"], ["ts", "event_id"], "value"), 5)


@query("tsa_05_change_points", """
    WITH e AS (SELECT event_id, avg(value) OVER a AS ma, avg(value) OVER b AS mb, var_samp(value) OVER a AS va, var_samp(value) OVER b AS vb, count(*) OVER a AS na, count(*) OVER b AS nb FROM events
               WINDOW a AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), b AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING)),
         s AS (SELECT event_id, CASE WHEN na = 10 AND nb = 10 THEN abs(mb - ma) / nullif(sqrt((va + vb) / 10), 0) END AS shift_score FROM e)
    SELECT event_id, round(shift_score, 5) AS shift_score, coalesce(shift_score > 3, false) AS change_point FROM s""")
def changes(t):
    got = s.change_points(t.events.select("event_type", "ts", "event_id", "value"), ["event_type"], ["ts", "event_id"], "value")
    return rounded(got.select("event_id", "shift_score", "change_point"), 5)


@query("tsa_06_filters", """
    SELECT event_id, round(avg(v) OVER a, 6) AS low, round(v - avg(v) OVER a, 6) + 0.0::DOUBLE AS high, round(avg(v) OVER a - avg(v) OVER b, 6) + 0.0::DOUBLE AS band FROM (SELECT event_id, event_type, ts, sqrt(value) AS v FROM events)
    WINDOW a AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), b AS (PARTITION BY event_type ORDER BY ts ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)""")
def filters(t):
    e = t.events.select("event_type", "ts", "event_id", F.sqrt("value").alias("v"))
    return rounded(s.bands(e, ["event_type"], ["ts", "event_id"], "v", 3, 12).select("event_id", "low", "high", "band"))


LAGS = f"(SELECT event_type, value AS y, lag(value, 1) OVER w AS q, lag(value, 2) OVER w AS d, lag(value, 3) OVER w AS x FROM {HOURS} WINDOW w AS (PARTITION BY event_type ORDER BY p) QUALIFY lag(value, 3) OVER w IS NOT NULL)"


@query("tsa_07_ar_coefficients", f"""
    WITH r AS MATERIALIZED {LAGS}, c AS {ols("r", "event_type")}
    SELECT event_type, count(*) AS n, round(any_value(b0), 6) AS constant, round(any_value(b1), 6) AS phi_1, round(any_value(b2), 6) AS phi_2, round(any_value(b3), 6) AS phi_3, round(avg(pow(y - b0 - b1 * q - b2 * d - b3 * x, 2)), 6) AS variance FROM r JOIN c USING (event_type) GROUP BY 1""")
def ar_coefficients(t):
    got = s.ar_coefficients(hours(t), ["event_type"], ["bucket"], "value", 3)
    return rounded(got.select("event_type", "n", "constant", *[F.col("phi")[k].alias(f"phi_{k + 1}") for k in range(3)], "variance"))


@query("tsa_07_ar_forecast")
def ar(t):
    return rounded(s.arima_forecast(hours(t), ["event_type"], "bucket", "value", max_p=3, max_q=0))


@query("tsa_07_arima_forecast")
def arima(t):
    return rounded(s.arima_forecast(hours(t), ["event_type"], "bucket", "value"))


@query("tsa_08_holt_winters", f"""
    WITH RECURSIVE h AS MATERIALIZED (SELECT event_type, p, n, value FROM {HOURS}),
    first AS (SELECT event_type, avg(value) FILTER (p <= 24) AS l, (avg(value) FILTER (p > 24 AND p <= 48) - avg(value) FILTER (p <= 24)) / 24 AS t, list(value ORDER BY p) FILTER (p <= 24) AS x FROM h GROUP BY 1),
    w(event_type, p, level, trend, season, e) AS (SELECT event_type, 24::BIGINT, l, t, list_transform(x, lambda v: v - l), NULL::DOUBLE FROM first UNION ALL
      SELECT event_type, p, now, 0.05::DOUBLE * (now - level) + 0.95::DOUBLE * trend, list_append(season[2:], 0.2::DOUBLE * (value - now) + 0.8::DOUBLE * season[1]), value - level - trend - season[1]
      FROM (SELECT w.event_type, h.p, w.level, w.trend, w.season, h.value, 0.3::DOUBLE * (h.value - w.season[1]) + 0.7::DOUBLE * (w.level + w.trend) AS now FROM w JOIN h ON h.event_type = w.event_type AND h.p = w.p + 1)),
    o AS (SELECT event_type, arg_max(level, p) AS level, arg_max(trend, p) AS trend, arg_max(season, p) AS season, stddev_pop(e) AS err FROM w GROUP BY 1)
    SELECT event_type, s AS step, round(level + s * trend + season[(s - 1) % 24 + 1], 6) AS forecast, round(level + s * trend + season[(s - 1) % 24 + 1] - 1.96::DOUBLE * err * sqrt(s), 6) AS lower, round(level + s * trend + season[(s - 1) % 24 + 1] + 1.96::DOUBLE * err * sqrt(s), 6) AS upper FROM o, range(1, 25) r(s)""")
def winters(t):
    return rounded(s.holt_winters(hours(t), ["event_type"], "bucket", "value", 24))


@query("tsa_09_forest_forecast")
def forest(t):
    return rounded(s.forest_forecast(hours(t), ["event_type"], "bucket", "value", 24, 100))


@query("tsa_10_ensemble_forecast", """
    WITH f AS (SELECT user_id, event_id % 5 AS step, sqrt(value) AS forecast, sqrt(value) - 1 AS lower, sqrt(value) + 1 AS upper FROM events UNION ALL SELECT user_id, event_id % 5, sqrt(value) * 2, sqrt(value) * 2 - 3, sqrt(value) * 2 + 3 FROM events)
    SELECT user_id, step, round(avg(forecast), 5) AS forecast, round(avg(lower), 5) AS lower, round(avg(upper), 5) AS upper FROM f GROUP BY 1, 2""")
def ensemble(t):
    a = t.events.selectExpr("user_id", "event_id % 5 step", "sqrt(value) forecast", "sqrt(value) - 1 lower", "sqrt(value) + 1 upper")
    b = t.events.selectExpr("user_id", "event_id % 5 step", "sqrt(value) * 2 forecast", "sqrt(value) * 2 - 3 lower", "sqrt(value) * 2 + 3 upper")
    return rounded(s.ensemble_forecast([a, b], ["user_id"]), 5)


@query("tsa_11_forecast_times", """
    WITH g AS (SELECT user_id, max(epoch_us(ts)) AS b, min(epoch_us(ts)) AS a, count(*) AS n FROM events GROUP BY 1)
    SELECT user_id, s::INT AS step, floor(b + coalesce((b - a) / nullif(n - 1, 0), 0) * s)::BIGINT AS micros FROM g, range(1, 7) r(s)""")
def times(t):
    return s.future_times(t.events, ["user_id"], "ts", 6)
