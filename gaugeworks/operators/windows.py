"""Windowed operators over ordered rows of a key. All of them build on `ordered`, so hot keys are split."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugeworks.operators.aggregate import rows
from gaugeworks.operators.ordered import chain, first_after, fold, framed, islands, largest_group, position, running, trailing
from gaugeworks.operators.project import BOLTZMANN
from gaugeworks.session import durable, group_rows, match, scalar_row

REFERENCE_PRESSURE = 1e5


def sliding_metrics(df: DataFrame, keys: Sequence[str], order: Sequence[str], temperature: str, density: str, confinement: str | None = None, n: int = 100) -> DataFrame:
    """Statistics of the last `n` rows: mean, population deviation, slope by position, triple product, beta, fill."""
    size = largest_group(df, keys)
    placed = position(df, keys, order, "_place", largest=size)
    t, d = F.col(temperature), F.col(density)
    beta = t * d * F.lit(BOLTZMANN) / REFERENCE_PRESSURE

    def build(w):
        f = w.rowsBetween(-(n - 1), 0)
        out = {
            "avg_temperature": F.avg(t).over(f), "temp_std": F.stddev_pop(t).over(f), "temp_trend": F.coalesce(F.regr_slope(t, F.col("_place")).over(f), F.lit(0.0)),
            "avg_density": F.avg(d).over(f), "density_std": F.stddev_pop(d).over(f), "density_trend": F.coalesce(F.regr_slope(d, F.col("_place")).over(f), F.lit(0.0)),
            "avg_beta": F.avg(beta).over(f), "max_beta": F.max(beta).over(f), "window_size": F.count(F.lit(1)).over(f), "fill": F.count(F.lit(1)).over(f) / n,
        }
        if confinement:
            triple = t * d * F.col(confinement)
            out |= {"avg_triple_product": F.avg(triple).over(f), "max_triple_product": F.max(triple).over(f)}
        return out

    return framed(placed, keys, order, n - 1, 0, build, largest=size).drop("_place")


def slope(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, n: int) -> DataFrame:
    size = largest_group(df, keys)
    placed = position(df, keys, order, "_place", largest=size)
    fit = lambda w: {"slope": F.coalesce(F.regr_slope(value, "_place").over(w.rowsBetween(-(n - 1), 0)), F.lit(0.0))}
    return framed(placed, keys, order, n - 1, 0, fit, largest=size).drop("_place")


def gradient(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, name: str = "gradient") -> DataFrame:
    """Central differences, one-sided at both ends; null where a value it needs is null."""

    def build(w):
        prev, nxt, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        start, end = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
        return {name: F.when(start, nxt - here).when(end, here - prev).otherwise((nxt - prev) / 2)}

    return framed(df, keys, order, 1, 1, build)


def rate_flags(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, increase: float | None = None, decrease: float | None = None, name: str = "rate_flag") -> DataFrame:
    """Step to the previous row above `increase` or below -`decrease`; a first row is never flagged."""

    def build(w):
        step = F.col(value) - F.lag(value).over(w)
        hit = F.lit(False)
        if increase is not None:
            hit = hit | (step > increase)
        if decrease is not None:
            hit = hit | (step < -decrease)
        return {name: F.coalesce(hit, F.lit(False))}

    return framed(df, keys, order, 1, 0, build)


def lag_features(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, lags: Sequence[int] = (1, 2, 3, 6, 12, 24)) -> DataFrame:
    """Earlier values as columns, the missing front filled with the first value of the key."""
    size = largest_group(df, keys)
    with_first = running(df, keys, order, {"_first": ("first", F.col(value))}, largest=size)
    build = lambda w: {f"lag_{k}": F.coalesce(F.lag(value, k).over(w), F.col("_first")) for k in lags}
    return framed(with_first, keys, order, max(lags), 0, build, largest=size).drop("_first")


def rolling(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, sizes: Sequence[int] = (3, 6, 12, 24)) -> DataFrame:
    def build(w):
        out = {}
        for s in sizes:
            f = w.rowsBetween(-(s - 1), 0)
            out |= {f"mean_{s}": F.avg(value).over(f), f"std_{s}": F.coalesce(F.stddev_samp(value).over(f), F.lit(0.0))}
        return out

    return framed(df, keys, order, max(sizes) - 1, 0, build)


def sequences(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, length: int) -> DataFrame:
    """The `length` values before a row as an array, for rows that have that many."""
    got = framed(df, keys, order, length, 0, lambda w: {"history": F.collect_list(value).over(w.rowsBetween(-length, -1))})
    return got.filter(F.size("history") == length)


def fill(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, how: str = "forward") -> DataFrame:
    """Fill nulls from the row before (`forward`), from the row after (`backward`), or `drop` them."""
    if how == "drop":
        return df.filter(F.col(value).isNotNull())
    kind = {value: ("last", F.col(value))}
    return running(df, keys, order, kind, desc=(how == "backward"))


def interpolate(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Linear in row position between known values; leading nulls stay, trailing ones hold the last value."""
    size = largest_group(df, keys)
    placed = position(df, keys, order, "_place", largest=size)
    known = F.when(F.col(value).isNotNull(), F.struct(F.col(value).cast("double").alias("v"), F.col("_place").alias("p")))
    both = running(placed, keys, order, {"_prev": ("last", known)}, largest=size)
    both = running(both, keys, order, {"_next": ("last", known)}, desc=True, largest=size)
    part = (F.col("_place") - F.col("_prev.p")) / (F.col("_next.p") - F.col("_prev.p"))
    line = F.col("_prev.v") + (F.col("_next.v") - F.col("_prev.v")) * part
    filled = F.when(F.col(value).isNotNull(), F.col(value).cast("double")).when(F.col("_prev").isNull(), None).when(F.col("_next").isNull(), F.col("_prev.v")).otherwise(line)
    return both.withColumn(value, filled).drop("_place", "_prev", "_next")


def first_per_time(df: DataFrame, keys: Sequence[str], ts: str, tie: str) -> DataFrame:
    """One row per key and time, the one with the smallest `tie`: a map-side combined aggregate."""
    by = [*keys, ts]
    rest = [c for c in df.columns if c not in by]
    return df.groupBy(*by).agg(F.min_by(F.struct(*rest), tie).alias("_r")).select(*by, *[F.col(f"_r.{c}").alias(c) for c in rest])


def resample(df: DataFrame, keys: Sequence[str], ts: str, value: str, unit: str = "hour") -> DataFrame:
    """Mean per time bucket between the first and the last one of a key, empty buckets null.

    The grid grows day by day, then within the day, so no array holds the whole span of a key.
    """
    keys = list(keys)
    bucket = F.date_trunc(unit, F.col(ts).cast("timestamp")).alias("bucket")
    means = df.groupBy(*keys, bucket).agg(F.avg(value).alias(value))
    span = means.groupBy(*keys).agg(F.min("bucket").alias("_a"), F.max("bucket").alias("_b"))
    if unit in ("hour", "minute", "second"):
        days = F.sequence(F.date_trunc("day", "_a"), F.date_trunc("day", "_b"), F.expr("interval 1 day"))
        span = span.select(*keys, "_a", "_b", F.explode(days).alias("_d"))
        inside = F.sequence(F.greatest("_a", "_d"), F.least("_b", F.col("_d") + F.expr("interval 1 day") - F.expr(f"interval 1 {unit}")), F.expr(f"interval 1 {unit}"))
    else:
        inside = F.sequence("_a", "_b", F.expr(f"interval 1 {unit}"))
    grid = span.select(*keys, F.explode(inside).alias("bucket"))
    return grid.join(means, [*keys, "bucket"], "left").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))


def episodes(df: DataFrame, keys: Sequence[str], order: Sequence[str], bad: Column, value: str) -> DataFrame:
    """Runs of bad readings: start, end at the first good reading after it (null while open), seconds, last value."""
    ts = order[0]
    runs = islands(df.withColumn("_bad", F.coalesce(bad, F.lit(False))), keys, order, F.col("_bad"))
    runs = runs.groupBy(*keys, "island").agg(F.bool_or("_bad").alias("_bad"), F.min(ts).alias("start_ts"), F.max(ts).alias("last_ts"), rows().alias("readings"), F.max_by(value, F.struct(*order)).alias("last_value"))
    runs = framed(runs, keys, ["island"], 0, 1, lambda w: {"end_ts": F.lead("start_ts").over(w)})
    seconds = (F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / 1e6
    return runs.filter("_bad").withColumn("seconds", seconds).drop("_bad", "island")


def flagged_periods(df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column) -> DataFrame:
    """First and last row of every run of flagged rows."""
    runs = islands(df.withColumn("_bad", F.coalesce(flag, F.lit(False))), keys, order, F.col("_bad")).filter("_bad")
    return runs.groupBy(*keys, "island").agg(F.min(order[0]).alias("start"), F.max(order[0]).alias("end"), rows().alias("n")).drop("island")


def cooldown_step(ts: str, wait_micros: int):
    """Fire when more than `wait_micros` passed since the last firing; state: time of the last firing."""

    def step(pdf: pd.DataFrame, state: list[float]):
        t = pdf[ts].to_numpy(np.int64)
        fired = np.zeros(len(t), bool)
        last = state[0]
        i = 0 if math.isnan(last) else int(np.searchsorted(t, int(last) + wait_micros, side="right"))
        while i < len(t):
            fired[i], last = True, float(t[i])
            i = int(np.searchsorted(t, t[i] + wait_micros, side="right"))
        return {"fired": fired}, [last]

    return step


def cooldown_alerts(df: DataFrame, keys: Sequence[str], micros: str, tie: str, condition: Column, wait_seconds: int = 300) -> DataFrame:
    """Rows that meet the condition with a flag whether the alert fires, given the pause after each firing.

    Rows without the condition cannot change the outcome and are dropped before the shuffle. Which row fires after a row fires
    depends on that row alone: the first one later than the pause. So a key above the group limit is a chain of such rows.
    """
    keys = list(keys)
    most = largest_group(df.filter(condition), keys)
    if most > group_rows(df.sparkSession):
        live = durable(position(df.filter(condition), keys, [micros, tie], "_pos", largest=most))
        probes = live.select(*keys, (F.col(micros) + wait_seconds * 1_000_000).alias(micros), tie, "_pos")
        ahead = first_after(live, probes, keys, micros, tie, F.col("_pos"), False)
        met = chain(ahead, keys, "_pos", "_hit").withColumn("fired", F.lit(True))
        return match(live, met, [*keys, "_pos"], "left").withColumn("fired", F.coalesce("fired", F.lit(False))).drop("_pos")
    return fold(df.filter(condition), keys, [micros, tie], cooldown_step(micros, wait_seconds * 1_000_000), [math.nan], "fired boolean")


def alert_states(df: DataFrame, keys: Sequence[str], micros: str, tie: str, condition: Column, wait_seconds: int = 300) -> DataFrame:
    """What an alert rule does at each check: skip (pause), fire, active (already on), resolve or idle.

    After a row fires, the first check past the pause that doesn't meet the condition resolves the alert, and the first one
    after it that does, fires again. Above the group limit the firing rows are a chain, and every other row's action follows
    from the last one before it.
    """
    wait = wait_seconds * 1_000_000
    keys = list(keys)
    most = largest_group(df, keys)
    if most > group_rows(df.sparkSession):
        order = [micros, tie]
        placed = position(df.withColumn("_on", F.coalesce(condition, F.lit(False))), keys, order, "_pos", largest=most)
        placed = durable(running(durable(placed), keys, order, {"_next": ("last", F.when(F.col("_on"), F.col("_pos")))}, desc=True, largest=most))
        on = placed.filter("_on")
        probes = on.select(*keys, (F.col(micros) + wait).alias(micros), tie, "_pos")
        ahead = durable(first_after(placed.filter("not _on"), probes, keys, micros, tie, F.struct(F.col("_pos").alias("off"), F.col("_next").alias("on")), True))
        met = chain(ahead.select(*keys, "_pos", F.col("_hit.on").alias("_on")), keys, "_pos", "_on")
        fires = match(ahead, met, [*keys, "_pos"]).select(*keys, "_pos", F.lit(True).alias("_fires"), F.col("_hit.off").alias("_off"))
        told = match(placed, fires, [*keys, "_pos"], "left")
        told = running(durable(told), keys, order, {"_last": ("last", F.when(F.col("_fires"), F.struct(F.col(micros).alias("t"), F.col("_off").alias("off"))))}, largest=most)
        later = F.when(F.col("_last.off").isNull() | (F.col("_pos") < F.col("_last.off")), "active").when(F.col("_pos") == F.col("_last.off"), "resolve").otherwise("idle")
        action = F.when(F.col("_fires"), "fire").when(F.col("_last").isNull(), "idle").when(F.col(micros) - F.col("_last.t") < wait, "skip").otherwise(later)
        return told.withColumn("action", action).drop("_on", "_pos", "_next", "_fires", "_off", "_last")

    def step(pdf: pd.DataFrame, state: list[float]):
        active, last = bool(state[0]), state[1]
        actions = []
        for t, on in zip(pdf[micros].to_numpy(np.int64), pdf["_on"].to_numpy(bool)):
            if not math.isnan(last) and t - last < wait:
                actions.append("skip")
            elif on and not active:
                active, last = True, float(t)
                actions.append("fire")
            elif on:
                actions.append("active")
            else:
                actions.append("resolve" if active else "idle")
                active = False
        return {"action": actions}, [float(active), last]

    return fold(df.withColumn("_on", F.coalesce(condition, F.lit(False))), keys, [micros, tie], step, [0.0, math.nan], "action string").drop("_on")


# Window lengths in seconds of the three request budgets.
BUDGETS = {"minute": 60, "hour": 3600, "day": 86400}


def bucket_step(micros: str, limits: dict[str, int]):
    """Token buckets of all windows; a request takes one token from each or none. State: tokens, last time."""
    names = list(limits)

    def step(pdf: pd.DataFrame, state: list[float]):
        tokens, last = list(state[:-1]), state[-1]
        verdict = []
        for t in pdf[micros].to_numpy(np.int64):
            dt = 0.0 if math.isnan(last) else (t - int(last)) / 1e6
            last = float(t)
            tokens = [min(float(limits[n]), k + dt * (limits[n] / BUDGETS[n])) for n, k in zip(names, tokens)]
            short = next((n for n, k in zip(names, tokens) if k < 1.0), None)
            if short is None:
                tokens = [k - 1.0 for k in tokens]
            verdict.append(short or "allowed")
        return {"verdict": verdict}, [*tokens, last]

    return step


def rate_limit(df: DataFrame, keys: Sequence[str], micros: str, tie: str, limits: dict[str, int]) -> DataFrame:
    """`allowed`, or the window whose budget is used up, per request."""
    start = [*[float(v) for v in limits.values()], math.nan]
    return fold(df, keys, [micros, tie], bucket_step(micros, limits), start, "verdict string")


def latest_rows(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    """The last `n` rows per key; the rank filter is applied before the shuffle as well."""
    w = W.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= n).drop("_rank")


def every_nth(df: DataFrame, keys: Sequence[str], order: Sequence[str], n: int) -> DataFrame:
    return position(df, keys, order, "place").filter(F.col("place") % n == 0)


def event_rate(df: DataFrame, keys: Sequence[str], micros: str, tie: str, seconds: int = 300) -> DataFrame:
    """Events per second of the trailing span, over the time since the first event in it, at least 1 s."""
    got = trailing(df, keys, micros, seconds * 1_000_000, tie, "recent", "_start")
    return got.withColumn("rate", F.col("recent") / F.greatest((F.col(micros) - F.col("_start")) / 1e6, F.lit(1.0))).drop("_start")


# Risk weights, severity multipliers and additions of the audit score.
RISK_SEVERITY = {"low": 0.5, "medium": 1.0, "high": 1.5, "critical": 2.0}
RISK_DEFAULT, FAILURE_RISK, BURST_RISK, OFF_HOURS_RISK = 0.1, 0.3, 0.4, 0.2
FAILURE_LOOKBACK, FAILURE_LIMIT, BURST_LIMIT = 10, 3, 50


def failure_risk(df: DataFrame, user: str, micros: str, tie: str, failed: Column, seconds: int = 3600) -> DataFrame:
    """Risk added when 3 or more of the user's last 10 events are failures younger than `seconds`."""
    marked = df.withColumn("_bad", F.coalesce(failed, F.lit(False)))

    def build(w):
        return {"_seen": F.collect_list(F.struct(F.col(micros).alias("t"), F.col("_bad").alias("bad"))).over(w.rowsBetween(-FAILURE_LOOKBACK, -1))}

    got = framed(marked, [user], [micros, tie], FAILURE_LOOKBACK, 0, build)
    recent = F.size(F.filter("_seen", lambda e: e["bad"] & (F.col(micros) - e["t"] < seconds * 1_000_000)))
    return got.withColumns({"recent_failures": recent, "failure_risk": F.when(recent >= FAILURE_LIMIT, FAILURE_RISK).otherwise(0.0)}).drop("_seen", "_bad")


def burst_risk(df: DataFrame, address: str, micros: str, tie: str, seconds: int = 300, limit: int = BURST_LIMIT) -> DataFrame:
    """Risk added when more than `limit` earlier events of the address are strictly younger than `seconds`."""
    got = trailing(df, [address], micros, seconds * 1_000_000 - 1, tie, "_n")
    return got.withColumn("earlier", F.col("_n") - 1).withColumn("burst_risk", F.when(F.col("earlier") > limit, BURST_RISK).otherwise(0.0)).drop("_n")


def audit_risk(base: Column, severity: Column, pattern: Column, hour: Column) -> Column:
    """base x severity multiplier + pattern + off-hours (before 6 or after 22), at most 1."""
    mult = F.lit(1.0)
    for name, m in RISK_SEVERITY.items():
        mult = F.when(severity == name, m).otherwise(mult)
    off = F.when((hour < 6) | (hour > 22), OFF_HOURS_RISK).otherwise(0.0)
    return F.least(F.lit(1.0), F.coalesce(base, F.lit(RISK_DEFAULT)) * mult + pattern + off)


def warning_rates(df: DataFrame, order: Sequence[str], truth: str, predicted: str) -> DataFrame:
    """Missed and false alarm rates over all rows, and the share of true rows already predicted one row before."""
    got = framed(df, [], order, 1, 0, lambda w: {"_before": F.lag(predicted).over(w)})
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    return got.agg(F.avg((t & ~p).cast("double")).alias("missed_rate"), F.avg((~t & p).cast("double")).alias("false_alarm_rate"),
                   F.try_divide(F.count_if(t & (F.col("_before") == 1)), F.count_if(t)).alias("early_rate"))


def dequeue_order(df: DataFrame, priority: str, order: Sequence[str]) -> DataFrame:
    """Place in a queue served by priority, highest first, then by arrival."""
    within = position(df, [priority], order, "_within")
    sizes = df.groupBy(priority).agg(rows().alias("_n"))
    ahead = running(sizes, [], [priority], {"_upto": ("sum", F.col("_n"))}, desc=True)
    ahead = ahead.select(priority, (F.col("_upto") - F.col("_n")).alias("_ahead"))
    return match(within, ahead, [priority]).withColumn("place", F.col("_ahead") + F.col("_within")).drop("_ahead", "_within")


def partial_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Running sum of the deviations from the mean."""
    keys = list(keys)
    mean = df.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    both = match(df, mean, keys) if keys else df.withColumn("_mean", scalar_row(mean)["_mean"])
    return running(both, keys, order, {"partial_sum": ("sum", F.col(value) - F.col("_mean"))}).drop("_mean")
