"""Operations reports: metrics, runs, service levels, traces, KPIs, queues, endpoints, query logs."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugeworks.operators.aggregate import rows
from gaugeworks.operators.ordered import nearest_rank, position, quantiles
from gaugeworks.session import match, scalar_row

# Service level targets (name, comparison, target, window in seconds).
SLA_TARGETS = [
    ("api_response_time", "<", 500.0, 300),
    ("system_availability", ">=", 99.9, 3600),
    ("error_rate", "<", 1.0, 600),
    ("fusion_analysis_time", "<", 30.0, 600),
]
SLA_LEVELS = {"healthy": 99.9, "warning": 99.0}

# KPI name, target, warning and critical threshold, better direction.
KPIS = [
    ("Plasma Temperature", 100.0, 80.0, 60.0, "higher"),
    ("Confinement Time", 10.0, 8.0, 5.0, "higher"),
    ("Energy Gain", 1.0, 0.8, 0.5, "higher"),
    ("Prediction Accuracy", 95.0, 90.0, 85.0, "higher"),
    ("System Uptime", 99.9, 99.5, 99.0, "higher"),
]

# Good and warning band of the latest reading.
BANDS = [
    ("plasma_current", 10.0, 20.0, 8.0, 25.0),
    ("electron_temperature", 8.0, 15.0, 5.0, 20.0),
    ("electron_density", 0.8, 1.5, 0.5, 2.0),
    ("magnetic_field", 5.0, 5.5, 4.5, 6.0),
]


def in_range(df: DataFrame, ts: str, start: str | None, end: str | None) -> DataFrame:
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    return df


def metric_summary(df: DataFrame, name: str, value: str, ts: str, start: str | None = None, end: str | None = None) -> DataFrame:
    df = in_range(df, ts, start, end)
    base = df.groupBy(name).agg(rows().alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.sum(value).alias("sum"),
                                F.max_by(value, ts).alias("latest"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))
    return match(base, quantiles(df, [name], [value], [0.5]).select(name, F.col(f"q_{value}")[0].alias("median")), [name])


def operation_profile(df: DataFrame, op: str, seconds: str, ts: str) -> DataFrame:
    return df.groupBy(op).agg(rows().alias("count"), F.sum(seconds).alias("total"), F.avg(seconds).alias("avg"), F.min(seconds).alias("min"), F.max(seconds).alias("max"), F.max_by(seconds, ts).alias("latest"))


def operation_summary(df: DataFrame, seconds: str, success: Column) -> DataFrame:
    """Success rate over all operations; time statistics over the successful ones."""
    ok = df.filter(success)
    one = ok.agg(rows().alias("successful"), F.avg(seconds).alias("mean"), F.stddev_pop(seconds).alias("std"), F.min(seconds).alias("min"), F.max(seconds).alias("max"))
    q, total = scalar_row(quantiles(ok, [], [seconds], [0.5, 0.95]))[f"q_{seconds}"], scalar_row(df.agg(rows().alias("n")))
    return one.withColumns({"total": total["n"], "success_rate": F.try_divide(F.col("successful"), total["n"]), "median": q[0], "p95": q[1]})


def run_history(df: DataFrame, model: str, order: Column, train: str, predict: str) -> DataFrame:
    """Latest run and spread of train and predict time per model."""
    latest = F.max_by(F.struct(train, predict), order)
    out = df.groupBy(model).agg(
        rows().alias("training_runs"), latest.alias("_l"),
        *[f(c).alias(f"{c}_{n}") for c in (train, predict) for n, f in (("mean", F.avg), ("std", F.stddev_pop), ("min", F.min), ("max", F.max))])
    return out.withColumns({f"latest_{c}": F.col("_l")[c] for c in (train, predict)}).drop("_l")


def performance_level(seconds: Column) -> Column:
    return F.when(seconds < 0.1, "excellent").when(seconds < 0.5, "good").when(seconds < 2.0, "fair").when(seconds < 10.0, "poor").otherwise("critical")


def query_log_summary(df: DataFrame, seconds: str, hit_rate: Column) -> DataFrame:
    one = df.agg(rows().alias("total"), F.avg(seconds).alias("avg"), F.min(seconds).alias("min"), F.max(seconds).alias("max"),
                 F.coalesce(F.avg(F.when(hit_rate > 0, hit_rate)), F.lit(0.0)).alias("avg_hit_rate"),
                 *[F.count_if(performance_level(F.col(seconds)) == lv).alias(lv) for lv in ("excellent", "good", "fair", "poor", "critical")])
    rank, med = scalar_row(nearest_rank(df, [], seconds, {"p95": 0.95})), scalar_row(quantiles(df, [], [seconds], [0.5]))
    return one.withColumns({"p95": rank["p95"], "median": med[f"q_{seconds}"][0]})


def hourly(df: DataFrame, ts: str, seconds: str, memory: Column) -> DataFrame:
    hour = F.date_trunc("hour", F.col(ts).cast("timestamp")).cast("timestamp_ntz").alias("hour")
    return df.groupBy(hour).agg(rows().alias("count"), F.avg(seconds).alias("avg"), F.max(seconds).alias("max"), F.avg(memory).alias("avg_memory"))


def halving_average(df: DataFrame, keys: Sequence[str], value: str, ts: str, tie: Sequence[str] = (), span: int = 512) -> DataFrame:
    """The recurrence a <- (a + x) / 2 started at the first value, per key; rows in order of `ts`, then of `tie`.

    The recurrence is linear, so all rows are summed by range of places from the end, each range scaled on its own, and
    the ranges are put together as a * 2 ** -span + s. From the sixth range on the factor is below the smallest double
    for any value a double can hold, so these ranges add exactly zero. It does not start anew where the average is 0.
    """
    keys = list(keys)
    n = df.groupBy(*keys).agg(rows().alias("_n"))
    placed = match(position(df.select(*dict.fromkeys([*keys, value, ts, *tie])), keys, [ts, *tie], "_back", desc=True), n, keys)
    first = F.when((F.col("_back") == F.col("_n")), 2.0).otherwise(1.0)
    within = placed.withColumn("_range", F.floor((F.col("_back") - 1) / span))
    sums = within.groupBy(*keys, "_range").agg(F.sum(F.col(value) * first * F.pow(F.lit(2.0), -((F.col("_back") - 1) % span + 1))).alias("_s"))
    step, scaled = F.lit(2.0**-span), F.lit(0.0)
    part = F.col("_s")
    for k in range(6):
        scaled = F.when(F.col("_range") == k, part).otherwise(scaled)
        part = part * step
    return sums.groupBy(*keys).agg(F.sum(scaled).alias("halving_avg"))


def event_metrics(df: DataFrame, kind: str, value: str, ts: str, error: Column, tie: Sequence[str] = ()) -> DataFrame:
    base = df.groupBy(kind).agg(rows().alias("count"), F.count_if(error).alias("errors"), F.avg(value).alias("avg_time"), F.max(ts).alias("last_ts"))
    base = base.withColumn("error_rate", F.col("errors") / F.col("count"))
    return match(base, halving_average(df, [kind], value, ts, tie), [kind])


def error_summary(df: DataFrame, kind: str, error: Column) -> DataFrame:
    """The overall row plus one row per kind that has errors."""
    g = df.groupBy(kind).agg(rows().alias("events"), F.count_if(error).alias("errors"))
    total = g.agg(F.sum("events").alias("events"), F.sum("errors").alias("errors")).select(F.lit("all").alias(kind), "events", "errors")
    both = total.unionByName(g.filter("errors > 0"))
    return both.withColumn("error_rate", F.coalesce(F.try_divide("errors", "events"), F.lit(0.0)))


def processing_percentiles(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    keys = list(keys)
    live = df.filter(F.col(value) > 0)
    base = live.groupBy(*keys).agg(F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"))
    rank = nearest_rank(live, keys, value, {"p95": 0.95, "p99": 0.99})
    med = quantiles(live, keys, [value], [0.5]).select(*keys, F.col(f"q_{value}")[0].alias("median"))
    if keys:
        return match(match(base, rank, keys), med, keys)
    s, m = scalar_row(rank), scalar_row(med)
    return base.withColumns({"p95": s["p95"], "p99": s["p99"], "median": m["median"]})


def complies(value: Column, comparison: Column, target: Column) -> Column:
    return F.when(comparison == "<", value < target).when(comparison == "<=", value <= target).when(comparison == ">", value > target).when(comparison == ">=", value >= target).otherwise(value == target)


def sla_status(pct: Column) -> Column:
    return F.when(pct.isNull(), "unknown").when(pct >= SLA_LEVELS["healthy"], "healthy").when(pct >= SLA_LEVELS["warning"], "warning").otherwise("violated")


def sla_compliance(readings: DataFrame, targets: DataFrame, name: str, value: str, ts: str) -> DataFrame:
    """Compliance per declared target; a target without readings is unknown. `targets` has (name, comparison, target)."""
    ok = complies(F.col(value), F.col("comparison"), F.col("target"))
    got = readings.join(targets, name).groupBy(name).agg(
        rows().alias("total"), F.count_if(ok).alias("compliant"), F.max_by(value, ts).alias("latest"), F.avg(value).alias("avg"), F.min(value).alias("min"), F.max(value).alias("max"))
    pct = F.try_divide(F.col("compliant") * 100.0, F.col("total"))
    out = targets.join(got, name, "left").withColumns({"status": sla_status(pct), "compliance": F.coalesce(pct, F.lit(0.0)), "total": F.coalesce("total", F.lit(0)), "compliant": F.coalesce("compliant", F.lit(0))})
    return out


def sla_overall(compliance: DataFrame) -> DataFrame:
    return compliance.agg(rows().alias("targets"), F.count_if(F.col("status") == "healthy").alias("healthy"), F.count_if(F.col("status") == "violated").alias("violated"),
                          (F.avg((F.col("status") == "healthy").cast("double")) * 100).alias("health_percentage"))


def sla_report(readings: DataFrame, targets: DataFrame, name: str, value: str, ts: str, start: str, end: str) -> DataFrame:
    """Period statistics with the 95th and 99th percentile by index."""
    inside = in_range(readings, ts, start, end)
    base = sla_compliance(inside, targets, name, value, ts).select(name, "total", "compliant", "compliance", "avg", "min", "max")
    rank = nearest_rank(inside.join(targets.select(name), name, "left_semi"), [name], value, {"p95": 0.95, "p99": 0.99})
    out = base.join(rank, name, "left")
    return out.na.fill(0.0, ["avg", "min", "max", "p95", "p99"])


def violation_summary(episodes: DataFrame, name: str, seconds: str, acknowledged: Column, open_: Column) -> DataFrame:
    g = episodes.groupBy(name).agg(rows().alias("violations"), F.coalesce(F.sum(seconds), F.lit(0.0)).alias("downtime_seconds"), F.count_if(~acknowledged).alias("unacknowledged"), F.count_if(open_).alias("active"))
    total = g.agg(*[F.sum(c).alias(c) for c in ("violations", "downtime_seconds", "unacknowledged", "active")]).withColumn(name, F.lit("all"))
    return g.unionByName(total)


def trace_analytics(spans: DataFrame, trace: str, kind: str, seconds: Column, error: Column) -> DataFrame:
    """Long table: whole-trace figures, then figures per span kind. A trace lasts as long as its spans together."""
    t = spans.groupBy(trace).agg(F.bool_or(error).alias("bad"), F.sum(seconds).alias("secs"))
    whole = t.agg(rows().alias("count"), F.count_if("bad").alias("errors"), F.avg("secs").alias("avg_duration"), F.min("secs").alias("min_duration"), F.max("secs").alias("max_duration")).withColumn(kind, F.lit("trace"))
    parts = spans.groupBy(kind).agg(rows().alias("count"), F.count_if(error).alias("errors"), (F.coalesce(F.sum(seconds), F.lit(0.0)) / rows()).alias("avg_duration"), F.min(seconds).alias("min_duration"), F.max(seconds).alias("max_duration"))
    return whole.unionByName(parts).withColumn("error_rate", F.col("errors") / F.col("count"))


def log_trend(df: DataFrame, by: Column, cols: Sequence[str]) -> DataFrame:
    """Averages in which a missing reading counts as 0."""
    return df.groupBy(by).agg(rows().alias("count"), *[F.avg(F.coalesce(F.col(c), F.lit(0.0))).alias(f"avg_{c}") for c in cols])


def kpi_status(values: DataFrame, kpis: DataFrame, name: str, value: str) -> DataFrame:
    """Performance in percent of target and status by direction and three thresholds."""
    v, t = F.col(value), F.col("target")
    up = F.when(v >= t, "excellent").when(v >= F.col("warning"), "good").when(v >= F.col("critical"), "warning").otherwise("critical")
    down = F.when(v <= t, "excellent").when(v <= F.col("warning"), "good").when(v <= F.col("critical"), "warning").otherwise("critical")
    out = values.join(kpis, name)
    return out.withColumns({"performance": F.coalesce(F.try_divide(v, t) * 100, F.lit(0.0)), "status": F.when(F.col("direction") == "higher", up).otherwise(down)})


def kpi_summary(status: DataFrame) -> DataFrame:
    return status.agg(rows().alias("kpis"), F.avg("performance").alias("average_performance"), *[F.count_if(F.col("status") == s).alias(s) for s in ("excellent", "good", "warning", "critical")])


def executive_summary(values: DataFrame, name: str, value: str, target: str) -> DataFrame:
    """Metric over target with its status, and the overall mean as the row `overall`."""
    p = F.try_divide(F.col(value), F.col(target))
    rated = values.filter(F.col(target).isNotNull() & (F.col(target) != 0)).select(name, p.alias("performance"))
    rated = rated.withColumn("status", F.when(F.col("performance") >= 1, "excellent").when(F.col("performance") >= 0.9, "good").when(F.col("performance") >= 0.8, "warning").otherwise("critical"))
    return rated.unionByName(rated.agg(F.avg("performance").alias("performance")).select(F.lit("overall").alias(name), "performance", F.lit(None).cast("string").alias("status")))


def severity_counts(alerts: DataFrame, severity: str, keys: Sequence[str] = ()) -> DataFrame:
    return alerts.groupBy(*keys).agg(rows().alias("active"), *[F.count_if(F.col(severity) == s).alias(s) for s in ("critical", "warning", "info")])


def api_usage(df: DataFrame, key: str, ts: str, now: str) -> DataFrame:
    recent = F.col(ts) > F.lit(now).cast("timestamp_ntz") - F.expr("interval 1 hour")
    return df.groupBy(key).agg(rows().alias("total"), F.count_if(recent).alias("last_hour"), F.max(ts).alias("last_used"))


def run_stats(runs: DataFrame, name: str, status: str, records: str, seconds: str, started: str) -> DataFrame:
    ok = F.col(status) == "completed"
    return runs.groupBy(name).agg(rows().alias("runs"), F.avg(ok.cast("double")).alias("success_rate"), F.sum(records).alias("records"), F.avg(F.when(ok, F.col(seconds))).alias("mean_seconds"), F.max(started).alias("last_run"))


def counts_wide(df: DataFrame, by: Sequence[str], col: str, values: Sequence) -> DataFrame:
    """Counts per value of one column, one column each (queue sizes per priority or status)."""
    return df.groupBy(*by).agg(rows().alias("total"), *[F.count_if(F.col(col) == v).alias(f"{col}_{v}") for v in values])


def dashboard(parts: dict[str, DataFrame]) -> DataFrame:
    """One-row reports as a long table (section, metric, value)."""
    out = []
    for section, df in parts.items():
        wide = df.select(*[F.col(c).cast("double").alias(c) for c in df.columns])
        out.append(wide.unpivot([], wide.columns, "metric", "value").withColumn("section", F.lit(section)))
    return reduce(DataFrame.unionByName, out)


def endpoint_metrics(df: DataFrame, method: str, path: str, status: str, seconds: str) -> DataFrame:
    key = F.concat_ws(":", method, path).alias("endpoint")
    return df.groupBy(key).agg(rows().alias("count"), F.avg(seconds).alias("avg"), F.min(seconds).alias("min"), F.max(seconds).alias("max"), F.count_if(F.col(status) >= 400).alias("errors"))


def tuning_summary(runs: DataFrame, model: str, method: str, score: str, params: str, order: Column) -> DataFrame:
    """Best run per model; `order` breaks ties between equal scores."""
    best = F.max_by(F.struct(F.col(score).alias("s"), F.col(method).alias("m"), F.col(params).alias("p")), F.struct(F.col(score), order))
    g = runs.groupBy(model).agg(rows().alias("total_runs"), best.alias("_b"))
    return g.select(model, "total_runs", F.col("_b.s").alias("best_score"), F.col("_b.m").alias("best_method"), F.col("_b.p").alias("best_params"))


def test_summary(df: DataFrame, passed: Column, seconds: str) -> DataFrame:
    return df.agg(rows().alias("total"), F.count_if(passed).alias("passed"), F.count_if(~passed).alias("failed"), F.coalesce(F.try_divide(F.count_if(passed) * 100.0, rows()), F.lit(0.0)).alias("success_rate"),
                  F.sum(seconds).alias("total_seconds"), F.avg(seconds).alias("mean_seconds"))


def band_status(df: DataFrame, bands: DataFrame, name: str, value: str, ts: str) -> DataFrame:
    """Latest reading per parameter against a good and a warning band (`bands`: name, four limits)."""
    last = df.groupBy(name).agg(F.max_by(value, ts).alias("latest"))
    v = F.col("latest")
    return last.join(bands, name).select(name, "latest", F.when(v.between(F.col("good_lo"), F.col("good_hi")), "good").when(v.between(F.col("warn_lo"), F.col("warn_hi")), "warning").otherwise("critical").alias("status"))
