"""Time-series analysis per series key.

Rows are first averaged into time buckets where a method needs the whole series at once, so a group
holds one row per bucket of its time span, however many readings fall into a bucket. Methods that
aggregates or bounded frames can state run on the rows themselves.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gaugeworks.operators.aggregate import rows
from gaugeworks.operators.learn import assemble
from gaugeworks.operators.ordered import framed, in_blocks, largest_group, position, running
from gaugeworks.operators.windows import lag_features, partial_sums, resample, rolling
from gaugeworks.session import durable, group_rows, match

MIN_POINTS = 10
# 5% critical values of the Dickey-Fuller (constant, no trend) and KPSS (level) statistics.
DF_CRITICAL, KPSS_CRITICAL = -2.86, 0.463
# Published response surface of the Dickey-Fuller p-value with a constant: where it is 0 and 1, where its two
# polynomials meet, and their coefficients, lowest power first.
UNIT_ROOT_ENDS, UNIT_ROOT_MIDDLE = (-18.83, 2.74), -1.61
UNIT_ROOT_LOW, UNIT_ROOT_HIGH = (2.1659, 1.4412, 0.038269), (1.7339, 0.93202, -0.12745, -0.010368)
# Published points of the KPSS level statistic and their p-values.
KPSS_POINTS = ((0.347, 0.10), (0.463, 0.05), (0.574, 0.025), (0.739, 0.01))


def features(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Moments and linear trend per series; short series get zeros."""
    placed = position(df, keys, order, "_p")
    g = placed.groupBy(*keys).agg(
        rows().alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.var_pop(value).alias("variance"), F.skewness(value).alias("skewness"),
        F.kurtosis(value).alias("kurtosis"), F.regr_slope(value, "_p").alias("trend_slope"), F.regr_r2(value, "_p").alias("trend_r2"))
    cols = [c for c in g.columns if c not in (*keys, "n")]
    return g.withColumns({c: F.when(F.col("n") >= MIN_POINTS, F.coalesce(c, F.lit(0.0))).otherwise(0.0) for c in cols})


def buckets(df: DataFrame, keys: Sequence[str], ts: str, value: str, unit: str = "hour") -> DataFrame:
    """Regular series: mean per time unit, gaps filled with the value before."""
    grid = resample(df, keys, ts, value, unit)
    return running(grid, keys, ["bucket"], {value: ("last", F.col(value))})


def transform(df: DataFrame, keys: Sequence[str], size: int, inverse: bool = False) -> DataFrame:
    """Discrete Fourier transform of every key's series: rows (keys, j, n, re, im) in, the same columns out, j from 0 to n - 1.

    n = a b with the divisors next to each other. Rows j = x b + y are transformed over x in groups (key, y) of a rows, turned
    by the twiddle factors, then over y in groups (key, u) of b rows; the result stands at u + a v. A group
    holds about the square root of a series. `size` bounds a group: where a length has no such divisors, the series
    becomes a convolution with a chirp, whose length is a power of two.
    """
    keys = list(keys)
    low = F.expr("array_max(filter(sequence(1L, cast(floor(sqrt(n)) as bigint)), d -> n % d = 0))")
    lengths = durable(df.select(*keys, "n").distinct().withColumn("a", low).withColumn("b", F.expr("n div a")))
    fits = lengths.filter(F.col("b") <= F.greatest(F.lit(size), 2 * F.col("a")))
    out = four_steps(match(df, fits.drop("n"), keys), keys, inverse)
    odd = lengths.filter(F.col("b") > F.greatest(F.lit(size), 2 * F.col("a"))).drop("a", "b", "n")
    return out if odd.isEmpty() else out.unionByName(chirped(match(df, odd, keys), keys, size, inverse))


def four_steps(df: DataFrame, keys: list[str], inverse: bool) -> DataFrame:
    """Two grouped passes over (keys, j, n, a, b, re, im)."""
    sign = 1 if inverse else -1
    rows_in = df.select(*keys, "n", "a", "b", F.expr("j div b").alias("x"), F.expr("j % b").alias("y"), "re", "im")
    kind = T.StructType([*[df.schema[k] for k in keys], *[T.StructField(c, T.LongType()) for c in ("n", "a", "b", "x", "y")], T.StructField("re", T.DoubleType()), T.StructField("im", T.DoubleType())])

    def over(at: str, fixed: str, turn: bool):
        def one(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(at)
            z = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
            f = np.fft.ifft(z) * len(z) if inverse else np.fft.fft(z)
            k = np.arange(len(z))
            if turn:
                f = f * np.exp(sign * 2j * np.pi * ((k * int(pdf[fixed].iloc[0])) % int(pdf["n"].iloc[0])) / pdf["n"].iloc[0])
            return pdf.assign(**{at: k, "re": f.real, "im": f.imag})
        return one

    first = rows_in.groupBy(*keys, "y").applyInPandas(over("x", "y", True), kind)
    second = first.groupBy(*keys, "x").applyInPandas(over("y", "x", False), kind)
    scale = F.when(F.lit(inverse), F.col("n")).otherwise(1)
    return second.select(*keys, (F.col("x") + F.col("a") * F.col("y")).alias("j"), "n", (F.col("re") / scale).alias("re"), (F.col("im") / scale).alias("im"))


def chirped(df: DataFrame, keys: list[str], size: int, inverse: bool) -> DataFrame:
    """The transform of any length n as a convolution of length m >= 2 n - 1, a power of two: jk = (j^2 + k^2 - (j - k)^2) / 2."""
    sign = 1.0 if inverse else -1.0
    angle = lambda j, s: F.lit(s * math.pi) * F.expr(f"(cast({j} as decimal(38,0)) * {j}) % (2 * n)").cast("double") / F.col("n")
    times = lambda r, i, c, s: (r * c - i * s, r * s + i * c)
    whole = lambda d: d.withColumn("m", F.expr("shiftleft(1L, cast(ceil(log2(2 * n - 1)) as int))"))
    data = whole(df)
    re, im = times(F.col("re"), F.col("im"), F.cos(angle("j", sign)), F.sin(angle("j", sign)))
    data = data.select(*keys, "j", "n", "m", re.alias("re"), im.alias("im"))
    ends = data.select(*keys, "n", "m").distinct()
    zeros = ends.withColumn("j", F.explode(F.sequence(F.col("n"), F.col("m") - 1))).withColumns({"re": F.lit(0.0), "im": F.lit(0.0)})
    arm = ends.withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("m") - 1)))
    near = F.least(F.col("j"), F.col("m") - F.col("j"))
    arm = arm.withColumn("i", near).withColumns({c: F.when(F.col("i") < F.col("n"), f(angle("i", -sign))).otherwise(0.0) for c, f in (("re", F.cos), ("im", F.sin))})
    at = lambda d: d.select(*keys, F.col("j"), F.col("m").alias("n"), "re", "im")
    left = transform(at(data.unionByName(zeros)), keys, size)
    right = transform(at(arm), keys, size).withColumnsRenamed({"re": "re2", "im": "im2"}).drop("n")
    both = match(left, right, [*keys, "j"])
    re, im = times(F.col("re"), F.col("im"), F.col("re2"), F.col("im2"))
    back = transform(durable(both.select(*keys, "j", "n", re.alias("re"), im.alias("im"))), keys, size, inverse=True)
    got = match(back.drop("n"), ends.select(*keys, "n"), keys).filter("j < n")
    re, im = times(F.col("re"), F.col("im"), F.cos(angle("j", sign)), F.sin(angle("j", sign)))
    scale = F.when(F.lit(inverse), F.col("n")).otherwise(1)
    return got.select(*keys, "j", "n", (re / scale).alias("re"), (im / scale).alias("im"))


def spectrum(df: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Strongest positive frequency (cycles per step, the lowest on a tie) and spectral entropy over all bins of a regular
    series. A series without power has equal shares. Rows with a null value are left out."""
    keys = list(keys)
    df = durable(df.filter(F.col(value).isNotNull()).select(*keys, order, value))
    most = largest_group(df, keys)
    placed = position(df, keys, [order], "_p", largest=most)
    size = placed.groupBy(*keys).agg(rows().alias("n"))
    x = match(placed, size, keys).select(*keys, (F.col("_p") - 1).alias("j"), "n", F.col(value).cast("double").alias("re"), F.lit(0.0).alias("im"))
    power = durable(transform(durable(x), keys, group_rows(df.sparkSession)).withColumn("power", F.col("re") * F.col("re") + F.col("im") * F.col("im")))
    up = (F.col("j") > 0) & (2 * F.col("j") < F.col("n"))
    total = power.groupBy(*keys).agg(F.sum("power").alias("total"), F.max_by("j", F.when(up, F.struct("power", (-F.col("j")).alias("k")))).alias("top"))
    share = F.when(F.col("total") > 0, F.col("power") / F.col("total")).otherwise(1 / F.col("n"))
    got = match(power, total, keys).groupBy(*keys, "n").agg(F.max(F.coalesce(F.col("top") / F.col("n"), F.lit(0.0))).alias("dominant_frequency"), (-F.sum(share * F.log2(share + 1e-12))).alias("spectral_entropy"))
    return got


def decompose(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, period: int) -> DataFrame:
    """Additive trend (centred moving average, 2 x period for even periods), seasonal means, residual; interior rows."""
    keys = list(keys)
    half = period // 2
    most = largest_group(df, keys)
    placed = position(df, keys, order, "_p", largest=most)
    size = placed.groupBy(*keys).agg(rows().alias("_n"))

    def build(w):
        if period % 2:
            return {"trend": F.avg(value).over(w.rowsBetween(-half, half))}
        a, b = F.avg(value).over(w.rowsBetween(-half, half - 1)), F.avg(value).over(w.rowsBetween(-half + 1, half))
        return {"trend": (a + b) / 2}

    got = framed(placed, keys, order, half, half, build, largest=most)
    got = match(got, size, keys)
    inner = got.filter((F.col("_p") > half) & (F.col("_p") <= F.col("_n") - half)).withColumns({"phase": ((F.col("_p") - 1) % period).cast("int"), "_d": F.col(value) - F.col("trend")})
    phase = inner.groupBy(*keys, "phase").agg(F.avg("_d").alias("_s"))
    level = phase.groupBy(*keys).agg(F.avg("_s").alias("_m"))
    out = match(inner, match(phase, level, keys).select(*keys, "phase", (F.col("_s") - F.col("_m")).alias("seasonal")), [*keys, "phase"])
    return out.withColumn("residual", F.col("_d") - F.col("seasonal")).drop("_p", "_n", "_d")


def seasonal_strength(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of the seasonal variance in seasonal plus residual variance."""
    g = parts.groupBy(*keys).agg(F.var_pop("seasonal").alias("_s"), F.var_pop("residual").alias("_r"))
    return g.select(*keys, F.coalesce(F.try_divide("_s", F.col("_s") + F.col("_r")), F.lit(0.0)).alias("seasonal_strength"))


def stationarity(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Dickey-Fuller t statistic (no lagged differences) and KPSS level statistic with verdict at 5%."""
    keys = list(keys)
    step = framed(df, keys, order, 1, 0, lambda w: {"_lag": F.lag(value).over(w)}).withColumn("_diff", F.col(value) - F.col("_lag"))
    d = step.groupBy(*keys).agg(F.regr_count("_diff", "_lag").alias("_n"), F.regr_slope("_diff", "_lag").alias("_b"), F.regr_sxx("_diff", "_lag").alias("_sxx"), F.regr_syy("_diff", "_lag").alias("_syy"))
    rest = F.greatest(F.col("_syy") - F.col("_b") * F.col("_b") * F.col("_sxx"), F.lit(0.0))
    d = d.select(*keys, F.try_divide("_b", F.sqrt(F.try_divide(rest, (F.col("_n") - 2) * F.col("_sxx")))).alias("df_statistic"))
    sums = partial_sums(df, keys, order, value)
    k = sums.groupBy(*keys).agg(F.try_divide(F.sum(F.pow("partial_sum", F.lit(2))), F.pow(F.count(F.lit(1)), F.lit(2)) * F.var_pop(value)).alias("kpss_statistic"))
    out = match(d, k, keys)
    return out.withColumn("stationary", (F.col("df_statistic") < DF_CRITICAL) & (F.col("kpss_statistic") < KPSS_CRITICAL))


def unit_root_p(t: float) -> float:
    """P-value of a Dickey-Fuller statistic with a constant, by the published response surface."""
    if not t > UNIT_ROOT_ENDS[0]:
        return 0.0
    if t > UNIT_ROOT_ENDS[1]:
        return 1.0
    z = sum(c * t**k for k, c in enumerate(UNIT_ROOT_LOW if t <= UNIT_ROOT_MIDDLE else UNIT_ROOT_HIGH))
    return 0.5 * math.erfc(-z / math.sqrt(2))


def unit_root(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, max_lag: int | None = None, choose: bool = True) -> DataFrame:
    """(keys, lags, observations, adf_statistic, adf_p_value): Dickey-Fuller with lagged differences and a constant.

    The differences up to max_lag before (by default 12 (n / 100)^(1/4) of the longest series, rounded up) are in one pass of
    cross products; their number goes by n ln(variance) + 2 k on the rows that have all of them (choose=False: max_lag). The statistic is then taken
    from all rows that have the chosen ones, in a second pass. Values enter less the series' mean. Short series have no row.
    """
    keys = list(keys)
    df = durable(df.filter(F.col(value).isNotNull()).select(*keys, *order, F.col(value).cast("double").alias("v")))
    size = df.groupBy(*keys).agg(rows().alias("_n"), F.avg("v").alias("_m"))
    longest = size.agg(F.max("_n")).first()[0] or 0
    lags = max_lag if max_lag is not None else math.ceil(12 * (longest / 100) ** 0.25)
    flat = match(df, size, keys).withColumn("v", F.col("v") - F.col("_m"))
    width = lags + 3
    flat = durable(flat.select(*keys, *order, "v"))
    picks = lambda k: [0, 1, *range(width - 1 - k, width - 1)]  # k differences next to the present one, which is last
    kind = T.StructType([*[df.schema[k] for k in keys], T.StructField("lags", T.LongType())])

    def pick_lags(batches):
        for pdf in batches:
            out = []
            for g, n in zip(pdf["g"], pdf["n"]):
                g = np.array(g).reshape(width, width)
                score = [n * math.log(max(solved(g, n, picks(k), width - 1)[1] / n, 1e-300)) + 2 * (k + 2) if n > k + 2 else math.inf for k in range(lags + 1)]
                out.append(int(np.argmin(score)) if choose else lags)
            yield pdf[keys].assign(lags=out)

    chosen = durable(difference_grams(flat.withColumn("_from", F.lit(lags + 1)), keys, order, lags).mapInPandas(pick_lags, kind))
    again = match(flat, chosen, keys).withColumn("_from", F.col("lags") + 1).drop("lags")
    g = match(difference_grams(again, keys, order, lags), chosen, keys)
    full = T.StructType([*kind.fields, T.StructField("observations", T.LongType()), T.StructField("adf_statistic", T.DoubleType()), T.StructField("adf_p_value", T.DoubleType())])

    def test(batches):
        for pdf in batches:
            found = []
            for k, g, n in zip(pdf["lags"], pdf["g"], pdf["n"]):
                coef, rest, inv = solved(np.array(g).reshape(width, width), n, picks(k), width - 1)
                free = n - k - 2
                found.append(coef[1] / math.sqrt(rest / free * inv[1, 1]) if free > 0 and rest > 0 else math.nan)
            yield pdf[[*keys, "lags"]].assign(observations=pdf["n"], adf_statistic=found, adf_p_value=[unit_root_p(t) if t == t else math.nan for t in found])

    return g.mapInPandas(test, full)


def level_stationarity(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """(keys, kpss_lags, kpss_statistic, kpss_p_value): KPSS around a level, with the long-run variance by a Bartlett kernel.

    The kernel's width follows the data: from the autocovariances up to n^(2/9), then all up to the width are added up. The
    p-value is read between the published points, and stays at the outermost beyond them.
    """
    keys = list(keys)
    df = durable(df.filter(F.col(value).isNotNull()).select(*keys, *order, F.col(value).cast("double").alias("v")))
    size = durable(df.groupBy(*keys).agg(rows().alias("_n"), F.avg("v").alias("_m")))
    flat = durable(match(df, size, keys).withColumn("v", F.col("v") - F.col("_m")).drop("_m"))
    longest = size.agg(F.max("_n")).first()[0] or 0

    def covariances(lags: int) -> DataFrame:
        return match(lag_products(flat, keys, order, lags).select(*keys, "g"), size.select(*keys, "_n"), keys)

    first = covariances(max(1, int(longest ** (2 / 9) + 1e-9)))
    n, third = F.col("_n"), F.pow(F.col("_n"), F.lit(1 / 3))
    near = F.filter(F.transform("g", lambda v, i: F.struct(v.alias("v"), i.alias("i"))), lambda e: (e["i"] > 0) & (e["i"] <= F.floor(F.pow(n, F.lit(2 / 9)) + 1e-9)))
    s0 = F.aggregate(near, F.get("g", F.lit(0)) / n, lambda a, e: a + e["v"] / (n / 2))
    s1 = F.aggregate(near, F.lit(0.0), lambda a, e: a + e["i"] * e["v"] / (n / 2))
    width = F.least(F.floor(1.1447 * F.pow(F.pow(F.try_divide(s1, s0), F.lit(2)), F.lit(1 / 3)) * third), n - 1)
    wide = durable(first.select(*keys, F.coalesce(width, F.lit(0)).cast("bigint").alias("kpss_lags")))
    most = wide.agg(F.max("kpss_lags")).first()[0] or 0
    cov = match(covariances(max(1, most)), wide, keys)
    parts = F.transform("g", lambda v, i: F.when(i == 0, v).when(i <= F.col("kpss_lags"), 2 * v * (1 - i / (F.col("kpss_lags") + 1))).otherwise(0.0))
    cov = cov.select(*keys, "kpss_lags", (F.aggregate(parts, F.lit(0.0), lambda a, b: a + b) / n).alias("_s"), "_n")
    sums = partial_sums(flat, keys, order, "v").groupBy(*keys).agg(F.sum(F.pow("partial_sum", F.lit(2))).alias("_eta"))
    got = match(cov, sums, keys).withColumn("kpss_statistic", F.try_divide(F.col("_eta") / (n * n), F.col("_s")))
    at = F.col("kpss_statistic")
    p = F.when(at <= KPSS_POINTS[0][0], KPSS_POINTS[0][1])
    for (x0, p0), (x1, p1) in zip(KPSS_POINTS, KPSS_POINTS[1:]):
        p = p.when(at <= x1, p0 + (at - x0) * ((p1 - p0) / (x1 - x0)))
    return got.select(*keys, "kpss_lags", "kpss_statistic", p.when(at > KPSS_POINTS[-1][0], KPSS_POINTS[-1][1]).alias("kpss_p_value"))


def stationarity_tests(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, max_lag: int | None = None) -> DataFrame:
    """Both tests side by side; stationary where the first rejects a unit root and the second doesn't reject a level, at 5 %."""
    out = match(unit_root(df, keys, order, value, max_lag), level_stationarity(df, keys, order, value), keys)
    return out.withColumn("stationary", (F.col("adf_p_value") < 0.05) & (F.col("kpss_p_value") > 0.05))


def change_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, width: int = 10, threshold: float = 3.0) -> DataFrame:
    """Rows where the mean of the next `width` rows differs from that of the previous ones by many standard errors."""
    def build(w):
        a, b = w.rowsBetween(-width, -1), w.rowsBetween(0, width - 1)
        return {"_ma": F.avg(value).over(a), "_mb": F.avg(value).over(b), "_va": F.var_samp(value).over(a), "_vb": F.var_samp(value).over(b), "_na": F.count(value).over(a), "_nb": F.count(value).over(b)}

    got = framed(df, keys, order, width, width - 1, build)
    shift = F.abs(F.col("_mb") - F.col("_ma"))
    got = got.withColumn("shift_score", F.when((F.col("_na") == width) & (F.col("_nb") == width), F.try_divide(shift, F.sqrt((F.col("_va") + F.col("_vb")) / width))))
    return got.withColumn("change_point", F.coalesce(F.col("shift_score") > threshold, F.lit(False))).drop("_ma", "_mb", "_va", "_vb", "_na", "_nb")


def bands(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, narrow: int, wide: int) -> DataFrame:
    """Low-pass (centred mean), high-pass (rest) and band-pass (difference of two means) of a series."""
    return framed(df, keys, order, wide, wide, lambda w: {
        "low": F.avg(value).over(w.rowsBetween(-narrow, narrow)), "high": F.col(value) - F.avg(value).over(w.rowsBetween(-narrow, narrow)),
        "band": F.avg(value).over(w.rowsBetween(-narrow, narrow)) - F.avg(value).over(w.rowsBetween(-wide, wide))})


def _forecast_frame(pdf: pd.DataFrame, keys: list[str], point: np.ndarray, err: np.ndarray) -> pd.DataFrame:
    h = len(point)
    return pd.DataFrame({**{k: [pdf[k].iloc[0]] * h for k in keys}, "step": np.arange(1, h + 1), "forecast": point, "lower": point - 1.96 * err, "upper": point + 1.96 * err})


def _forecast_schema(df: DataFrame, keys: Sequence[str]) -> T.StructType:
    return T.StructType([*[df.schema[k] for k in keys], T.StructField("step", T.LongType()), *[T.StructField(c, T.DoubleType()) for c in ("forecast", "lower", "upper")]])


def grams(df: DataFrame, keys: Sequence[str], x: str, width: int, first_row: bool = False) -> DataFrame:
    """(keys, n, g): the sum over rows of x x', flattened by rows, for the array column `x` of `width` numbers; first_row:
    only x[0] x'. Each task adds up its own rows per key before anything is shuffled."""
    keys, out = list(keys), width if first_row else width * width
    kind = T.StructType([*[df.schema[k] for k in keys], T.StructField("n", T.LongType()), T.StructField("g", T.ArrayType(T.DoubleType()))])

    def partial(batches):
        for pdf in batches:
            v = np.stack(pdf[x].to_numpy()).astype(float) if len(pdf) else np.zeros((0, width))
            groups = pdf.groupby(keys, dropna=False, sort=False).indices if keys else {0: np.arange(len(pdf))}
            found = [(at[0], len(at), (v[at, 0] @ v[at] if first_row else v[at].T @ v[at]).ravel().tolist()) for at in groups.values() if len(at)]
            head = pdf[keys].iloc[[i for i, _, _ in found]].reset_index(drop=True)
            yield head.assign(n=[n for _, n, _ in found], g=[g for _, _, g in found])

    part = df.select(*keys, x).mapInPandas(partial, kind)
    return added(part, keys).filter(F.size("g") == out)


def added(part: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, n, g): partial counts and arrays of sums of a key added up, place by place."""
    cells = part.select(*keys, "n", F.posexplode("g").alias("i", "v")).groupBy(*keys, "i").agg(F.sum("v").alias("v"), F.sum("n").alias("n"))
    return cells.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("g"))


def block_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int, sums: Callable[[pa.Table], tuple[int, np.ndarray]]) -> DataFrame:
    """(keys, n, g): counts and sums over the rows of a key, of which each block gives its own from the `before` rows around it."""
    out = T.StructType([*[df.schema[k] for k in keys], T.StructField("n", T.LongType()), T.StructField("g", T.ArrayType(T.DoubleType()))])

    def run(table: pa.Table) -> pa.Table:
        n, g = sums(table)
        made = table.select(list(keys)).slice(0, 1) if keys else None
        cells = [pa.array([n], pa.int64()), pa.array([g.ravel().tolist()], pa.list_(pa.float64()))]
        got = made.append_column("n", cells[0]).append_column("g", cells[1]) if keys else pa.table(cells, names=["n", "g"])
        return got.slice(0, 1 if n else 0)

    return added(in_blocks(df, keys, order, before, 0, out, run), keys)


def lag_products(df: DataFrame, keys: Sequence[str], order: Sequence[str], lags: int) -> DataFrame:
    """(keys, n, g): the sums over rows of `v` times its value 0 to `lags` rows before; no array of lags a row is made."""

    def sums(table: pa.Table) -> tuple[int, np.ndarray]:
        v, own = table["v"].to_numpy(), table["_own"].to_numpy()
        at = int(np.argmax(own)) if own.any() else len(own)
        short = [(v[max(at, i):], v[max(at - i, 0): max(len(v) - i, 0)]) for i in range(lags + 1)]
        return int(own.sum()), np.array([float(a @ b) if len(a) else 0.0 for a, b in short])

    return block_sums(df, keys, order, lags, sums)


def difference_grams(df: DataFrame, keys: Sequence[str], order: Sequence[str], lags: int, chunk: int = 4_000) -> DataFrame:
    """(keys, n, g): the sum of x x' over the rows from the second on that come after the first `_from` ones of a key, where x holds 1, the
    value before, the `lags` differences before (0 before the start), oldest first, and the row's own difference."""
    width = lags + 3

    def sums(table: pa.Table) -> tuple[int, np.ndarray]:
        v, place = table["v"].to_numpy(), table["_pos"].to_numpy()
        step = np.diff(v, prepend=v[:1])
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(lags), step]), lags + 1)
        use = np.flatnonzero(table["_own"].to_numpy() & (place > table["_from"].to_numpy()) & (place > 1))
        g = np.zeros((width, width))
        for start in range(0, len(use), chunk):
            at = use[start : start + chunk]
            x = np.column_stack([np.ones(len(at)), v[at - 1], windows[at]])
            g += x.T @ x
        return len(use), g

    return block_sums(df, keys, order, lags + 1, sums)


def solved(g: np.ndarray, n: int, use: list[int], y: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Least squares from a gram matrix: coefficients of the columns `use`, residual sum of squares, inverse of their gram."""
    inv = np.linalg.pinv(g[np.ix_(use, use)], hermitian=True)
    coef = inv @ g[use, y]
    return coef, float(max(g[y, y] - coef @ g[use, y], 0.0)), inv


def lagged(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, lags: int, name: str, own: bool = True) -> DataFrame:
    """Add the array `name` of a value (unless `own` is False) and its `lags` values before, nearest first; null before the start."""
    return framed(df, keys, order, lags, 0, lambda w: {name: F.array(*([F.col(value)] if own else []), *[F.lag(value, i).over(w) for i in range(1, lags + 1)])})


def ar_coefficients(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, p: int = 3) -> DataFrame:
    """(keys, n, constant, phi array, variance) of an autoregression of order p, from one pass of lagged cross products.

    Values enter less their series' mean, which the constant takes back. Rows without p rows before them only serve as lags.
    """
    keys = list(keys)
    df = durable(df.filter(F.col(value).isNotNull()).select(*keys, *order, F.col(value).cast("double").alias("v")))
    mean = df.groupBy(*keys).agg(F.avg("v").alias("_m"))
    own = lagged(match(df, mean, keys).withColumn("v", F.col("v") - F.col("_m")), keys, order, "v", p, "x")
    full = own.withColumn("x", F.concat(F.array(F.lit(1.0)), "x")).filter(~F.exists("x", lambda e: e.isNull()))
    g = match(grams(full, keys, "x", p + 2), mean, keys)
    kind = T.StructType([*[df.schema[k] for k in keys], T.StructField("n", T.LongType()), T.StructField("constant", T.DoubleType()), T.StructField("phi", T.ArrayType(T.DoubleType())), T.StructField("variance", T.DoubleType())])

    def fit(batches):
        for pdf in batches:
            got = [solved(np.array(g).reshape(p + 2, p + 2), n, [0, *range(2, p + 2)], 1) for g, n in zip(pdf["g"], pdf["n"])]
            yield pdf[[*keys, "n"]].assign(constant=[c[0] + m * (1 - c[1:].sum()) for (c, _, _), m in zip(got, pdf["_m"])], phi=[c[1:].tolist() for c, _, _ in got], variance=[r / n for (_, r, _), n in zip(got, pdf["n"])])

    return g.mapInPandas(fit, kind)


def arima_forecast(df: DataFrame, keys: Sequence[str], order: str, value: str, horizon: int = 24, max_p: int = 2, max_d: int = 1, max_q: int = 2, long: int = 8) -> DataFrame:
    """Forecast of a regular series with a 95 % interval by an autoregression with moving-average terms of its differences.

    The Hannan-Rissanen steps, each one pass of lagged cross products over halo frames, so that no task holds a series: a long
    autoregression gives the residuals that stand for the shocks; then the value is regressed on up to max_p values and max_q
    residuals before it. Orders (p, d, q) go by n ln(variance) + 2 (p + q + 1), all on the rows that have every lag. A series
    too short for that repeats its last value, within its deviation. Nulls are left out.
    """
    keys = list(keys)
    base = durable(df.filter(F.col(value).isNotNull()).select(*keys, order, F.col(value).cast("double").alias("v")))
    stats = durable(base.groupBy(*keys).agg(rows().alias("n"), F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"), F.max_by("v", order).alias("last")))
    flat = match(base, stats.select(*keys, "mean"), keys)
    stepped = framed(flat, keys, [order], 1, 0, lambda w: {"_before": F.lag("v").over(w)})
    kinds = [F.struct(F.lit(0).alias("d"), (F.col("v") - F.col("mean")).alias("y")), *([F.struct(F.lit(1).alias("d"), (F.col("v") - F.col("_before")).alias("y"))] if max_d else [])]
    by = [*keys, "d"]
    both = durable(stepped.select(*keys, order, F.explode(F.array(*kinds)).alias("s")).select(*keys, order, "s.d", "s.y").filter("y is not null"))
    if max_q:
        x = lagged(both, by, [order], "y", long, "x")
        full = x.withColumn("x", F.concat(F.array(F.lit(1.0)), "x")).filter(~F.exists("x", lambda e: e.isNull()))
        kind = T.StructType([*[both.schema[k] for k in by], T.StructField("ar", T.ArrayType(T.DoubleType()))])

        def fit(batches):
            for pdf in batches:
                got = [solved(np.array(g).reshape(long + 2, long + 2), n, [0, *range(2, long + 2)], 1)[0].tolist() for g, n in zip(pdf["g"], pdf["n"])]
                yield pdf[by].assign(ar=got)

        ar = grams(full, by, "x", long + 2).mapInPandas(fit, kind)
        guess = F.get("ar", F.lit(0)) + F.aggregate(F.zip_with(F.slice("ar", 2, long), F.slice("x", 2, long), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        both = durable(match(x, ar, by, "left").select(*by, order, "y", (F.col("y") - guess).alias("e")))
    else:
        both = both.withColumn("e", F.lit(0.0))
    reach = max(max_p, max_q, 1)
    placed = framed(both, by, [order], reach, 0, lambda w: {
        "ys": F.array("y", *[F.lag("y", i).over(w) for i in range(1, reach + 1)]), "es": F.array("e", *[F.lag("e", i).over(w) for i in range(1, reach + 1)])})
    placed = durable(placed)
    row = F.concat(F.array(F.lit(1.0)), F.slice("ys", 2, max_p) if max_p else F.array().cast("array<double>"), F.slice("es", 2, max_q) if max_q else F.array().cast("array<double>"), F.array("y"))
    width = max_p + max_q + 2
    g = grams(placed.withColumn("x", row).filter(~F.exists("x", lambda e: e.isNull())), by, "x", width)
    tail = placed.groupBy(*by).agg(F.max_by(F.struct("ys", "es"), order).alias("t")).select(*by, "t.ys", "t.es")
    fits = match(match(tail, g.select(*by, F.col("n").alias("m"), "g"), by), stats, keys, "left")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        best = None
        for r in pdf.itertuples():
            full_gram = np.array(r.g).reshape(width, width)
            for p in range(max_p + 1):
                for q in range(max_q + 1):
                    coef, rest, _ = solved(full_gram, r.m, [0, *range(1, p + 1), *range(1 + max_p, 1 + max_p + q)], width - 1)
                    score = r.m * math.log(max(rest / r.m, 1e-12)) + 2 * (p + q + 1)
                    if r.m > width + 2 and (best is None or score < best[0]):
                        best = (score, coef, rest / r.m, p, q, r)
        r = pdf.iloc[0]
        if best is None:
            return _forecast_frame(pdf, keys, np.full(horizon, r["last"]), np.full(horizon, r["std"]))
        _, coef, var, p, q, r = best
        phi, theta = coef[1 : p + 1], coef[p + 1 :]
        ys, es = [float(v) for v in r.ys[: max(p, 1)]], [float(v) for v in r.es[: max(q, 1)]]
        point, psi = [], [1.0]
        for h in range(horizon):
            y = coef[0] + sum(a * b for a, b in zip(phi, ys)) + sum(a * b for a, b in zip(theta, es))
            point.append(y)
            ys, es = [y, *ys][: max(p, 1)], [0.0, *es][: max(q, 1)]
            psi.append((theta[h] if h < q else 0.0) + sum(phi[i] * psi[h - i] for i in range(min(p, h + 1))))
        point, weight = np.array(point), np.array(psi[:horizon])
        point, weight = (r.last + np.cumsum(point), np.cumsum(weight)) if r.d else (r.mean + point, weight)
        return _forecast_frame(pdf, keys, point, np.sqrt(var * np.cumsum(weight**2)))

    got = fits.groupBy(*keys).applyInPandas(one, _forecast_schema(df, keys))
    short = match(stats, fits.select(*keys).distinct(), keys, "left_anti") if keys else stats.limit(0)
    steps = short.withColumn("step", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(horizon).cast("bigint"))))
    return got.unionByName(steps.select(*keys, "step", F.col("last").alias("forecast"), (F.col("last") - 1.96 * F.col("std")).alias("lower"), (F.col("last") + 1.96 * F.col("std")).alias("upper")))


def smoothed(state: np.ndarray, x: np.ndarray, first: int, period: int, alpha: float, beta: float, gamma: float) -> tuple[np.ndarray, float, float]:
    """Run level, trend and season over readings x, the first at place `first`: states after it, and the sum and the sum of
    squares of the one-step errors. `state` has level, trend and seasons as rows and any number of columns, each a state
    of its own; errors are those of column 0. A step is affine in the state, so columns can be added up afterwards."""
    s, total, square = state.copy(), 0.0, 0.0
    for i, v in enumerate(x, first):
        row = 2 + i % period
        level, trend, season = s[0].copy(), s[1].copy(), s[row].copy()
        e = v[0] - level[0] - trend[0] - season[0]
        total, square = total + e, square + e * e
        s[0] = alpha * (v - season) + (1 - alpha) * (level + trend)
        s[1] = beta * (s[0] - level) + (1 - beta) * trend
        s[row] = gamma * (v - s[0]) + (1 - gamma) * season
    return s, total, square


def holt_winters(df: DataFrame, keys: Sequence[str], order: str, value: str, period: int, horizon: int = 24, alpha: float = 0.3, beta: float = 0.05, gamma: float = 0.2, limit: int | None = None) -> DataFrame:
    """Additive level, trend and season smoothing of a regular series, forecast with a 95 % interval.

    Every reading maps the state (level, trend, seasons) to the next by an affine map, a matrix and a vector. Each range of at
    most `limit` readings composes its own map at once with all others; the maps of a key, one row per range, then give the state
    at the start of every range, and each range adds up its errors from there. Level, trend and seasons start from the first
    period and the step to the second. Series of fewer than two periods are forecast by their mean. Nulls are left out.
    """
    keys = list(keys)
    limit = limit or group_rows(df.sparkSession)
    df = durable(df.filter(F.col(value).isNotNull()).select(*keys, order, F.col(value).cast("double").alias("x")))
    most = largest_group(df, keys)
    placed = position(df, keys, [order], "p", largest=most)
    placed = durable(placed.withColumn("block", F.floor((F.col("p") - 1) / limit).cast("bigint")))
    early = F.when(F.col("p") <= 2 * period, F.struct("p", "x"))  # two periods a key
    sizes = placed.groupBy(*keys).agg(rows().alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.transform(F.array_sort(F.collect_list(early)), lambda e: e["x"]).alias("head"))
    sizes = durable(sizes)
    long = match(placed, sizes.filter(F.col("n") >= 2 * period).select(*keys), keys).filter(F.col("p") > period)
    by = [df.schema[k] for k in keys] + [T.StructField("block", T.LongType())]
    m = period + 2

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")
        x = np.zeros((len(pdf), m + 1))
        x[:, 0] = pdf["x"]  # column 0: from the zero state with the readings; column c: from unit state c without
        got, _, _ = smoothed(np.hstack([np.zeros((m, 1)), np.eye(m)]), x, int(pdf["p"].iloc[0]) - 1, period, alpha, beta, gamma)
        return pd.DataFrame({**{f.name: [pdf[f.name].iloc[0]] for f in by}, "map": [got.ravel().tolist()]})

    maps = long.groupBy(*keys, "block").applyInPandas(compose, T.StructType([*by, T.StructField("map", T.ArrayType(T.DoubleType()))]))
    start = match(maps, sizes.select(*keys, "head"), keys)

    def prefix(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, out = pdf.sort_values("block"), []
        head = np.array(pdf["head"].iloc[0])
        level = head[:period].mean()
        state = np.concatenate([[level, (head[period:].mean() - level) / period], head[:period] - level])
        for a in pdf["map"]:
            out.append(state.tolist())
            a = np.array(a).reshape(m, m + 1)
            state = a[:, 1:] @ state + a[:, 0]
        return pd.DataFrame({**{f.name: pdf[f.name] for f in by}, "entry": out, "leave": [*[None] * (len(pdf) - 1), state.tolist()]})

    state_type = T.ArrayType(T.DoubleType())
    states = durable(start.groupBy(*keys).applyInPandas(prefix, T.StructType([*by, T.StructField("entry", state_type), T.StructField("leave", state_type)])))

    def errors(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("p")
        _, e, e2 = smoothed(np.array(pdf["entry"].iloc[0])[:, None], pdf[["x"]].to_numpy(), int(pdf["p"].iloc[0]) - 1, period, alpha, beta, gamma)
        return pd.DataFrame({**{f.name: [pdf[f.name].iloc[0]] for f in by}, "e": [e], "e2": [e2], "c": [len(pdf)]})

    kinds = [*by, *[T.StructField(c, T.DoubleType()) for c in ("e", "e2")], T.StructField("c", T.LongType())]
    missed = match(long, states.select(*keys, "block", "entry"), [*keys, "block"]).groupBy(*keys, "block").applyInPandas(errors, T.StructType(kinds))
    spread_ = missed.groupBy(*keys).agg((F.sum("e2") / F.sum("c") - F.pow(F.sum("e") / F.sum("c"), F.lit(2))).alias("v")).select(*keys, F.sqrt(F.greatest("v", F.lit(0.0))).alias("err"))
    final = match(states.filter("leave is not null").select(*keys, "leave"), spread_, keys)
    out = match(sizes.drop("head"), final, keys, "left").withColumn("step", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(horizon).cast("bigint"))))
    season = F.get("leave", (2 + (F.col("n") + F.col("step") - 1) % period).cast("int"))
    point = F.when(F.col("leave").isNull(), F.col("mean")).otherwise(F.get("leave", F.lit(0)) + F.col("step") * F.get("leave", F.lit(1)) + season)
    wide = F.when(F.col("leave").isNull(), F.col("std")).otherwise(F.col("err") * F.sqrt("step"))
    return out.select(*keys, "step", point.alias("forecast"), (point - 1.96 * wide).alias("lower"), (point + 1.96 * wide).alias("upper"))


def forest_forecast(df: DataFrame, keys: Sequence[str], order: str, value: str, horizon: int = 3, trees: int = 20, seed: int = 42) -> DataFrame:
    """One forest on lag and rolling features of all series; each step is predicted and fed back."""
    keys, lags, sizes = list(keys), (1, 2, 3, 6), (3, 6)
    df = durable(df.select(*keys, order, value))
    cols = [*[f"lag_{k}" for k in lags], *[f"mean_{s}" for s in sizes]]
    feats = rolling(lag_features(df, keys, [order], value, lags), keys, [order], value, sizes)
    # Rolling means end one row earlier than the target, so they shift by one.
    shifted = framed(feats, keys, [order], 1, 0, lambda w: {f"mean_{s}": F.coalesce(F.lag(f"mean_{s}").over(w), F.col("lag_1")) for s in sizes})
    model = RandomForestRegressor(featuresCol="features", labelCol=value, numTrees=trees, seed=seed).fit(assemble(shifted, cols))
    tail = df.groupBy(*keys).agg(F.max(order).alias("_last"))
    # State per series: its last rows, newest first; bounded by the longest lag.
    back = framed(df, keys, [order], max(lags) - 1, 0, lambda w: {"_hist": F.reverse(F.collect_list(value).over(w.rowsBetween(-(max(lags) - 1), 0)))})
    state = back.join(tail, keys).filter(F.col(order) == F.col("_last")).select(*keys, "_hist")
    out = None
    for step in range(1, horizon + 1):
        at = lambda k: F.coalesce(F.get("_hist", F.lit(k - 1)), F.element_at("_hist", -1))
        x = state.withColumns({f"lag_{k}": at(k) for k in lags})
        x = x.withColumns({f"mean_{s}": F.aggregate(F.slice("_hist", 1, s), F.lit(0.0), lambda a, v: a + v) / F.least(F.size("_hist"), F.lit(s)) for s in sizes})
        got = durable(model.transform(assemble(x, cols)).select(*keys, "_hist", F.col("prediction").alias("forecast")))
        part = got.select(*keys, F.lit(step).cast("bigint").alias("step"), "forecast")
        out = part if out is None else out.unionByName(part)
        state = got.select(*keys, F.slice(F.concat(F.array("forecast"), "_hist"), 1, max(lags)).alias("_hist"))
    return out


def ensemble_forecast(forecasts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    both = forecasts[0]
    for f in forecasts[1:]:
        both = both.unionByName(f)
    return both.groupBy(*keys, "step").agg(*[F.avg(c).alias(c) for c in ("forecast", "lower", "upper")])


def future_times(df: DataFrame, keys: Sequence[str], ts: str, horizon: int) -> DataFrame:
    """The next `horizon` times after the last one, at the mean step of the series."""
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    g = df.groupBy(*keys).agg(F.max(us).alias("_b"), F.min(us).alias("_a"), rows().alias("_n"))
    step = F.coalesce(F.try_divide(F.col("_b") - F.col("_a"), F.col("_n") - 1), F.lit(0.0))
    g = g.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return g.select(*keys, "step", F.floor(F.col("_b") + step * F.col("step")).alias("micros"))
