"""Descriptive statistics, correlation, trend, quality and attainment aggregates.

All statistics of a table share one aggregate. Exact order statistics go through
`ordered.quantiles` / `nearest_rank`, which never put an unbounded group on one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from gaugeworks.functions.stats import t_two_sided
from gaugeworks.operators.ordered import average_rank, modes, nearest_rank, position, quantiles, running
from gaugeworks.session import match, scalar_row

N = F.count


def rows() -> Column:
    return F.count(F.lit(1))


def numeric_columns(df: DataFrame) -> list[str]:
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")
    return [n for n, k in df.dtypes if k.split("(")[0] in kinds]


def experiment_performance(df: DataFrame, by: Sequence[str], result: str, confinement: str, beta: str, disrupted: Column, duration: str, quality: str) -> DataFrame:
    return df.groupBy(*by).agg(
        rows().alias("total_shots"), F.avg(result).alias("avg_q"), F.stddev_samp(result).alias("std_q"), F.max(result).alias("max_q"), F.min(result).alias("min_q"),
        F.avg(confinement).alias("avg_confinement"), F.avg(beta).alias("avg_beta"), F.count_if(disrupted).alias("disruption_count"),
        F.try_divide(F.count_if(disrupted), rows()).alias("disruption_rate"), F.avg(duration).alias("avg_duration"),
        F.count_if(F.col(quality) >= 0.8).alias("high_quality_shots"),
    )


def diagnostic_stats(df: DataFrame, by: Sequence[str], value: str, flag: Column) -> DataFrame:
    return df.groupBy(*by).agg(
        rows().alias("data_points"), F.avg(value).alias("mean_value"), F.stddev_samp(value).alias("std_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"),
        F.count_if(flag == 0).alias("good"), F.count_if(flag == 1).alias("suspect"), F.count_if(flag == 2).alias("bad"),
    )


def daily_trend(df: DataFrame, ts: str, value: str, since: str | None = None) -> DataFrame:
    """Daily statistics since a cutoff; every row carries the slope of the daily mean over the day index."""
    if since is not None:
        df = df.filter(F.col(ts) >= F.lit(since).cast("timestamp_ntz"))
    days = df.groupBy(F.date_trunc("day", F.col(ts).cast("timestamp")).cast("timestamp_ntz").alias("day")).agg(
        rows().alias("n"), F.avg(value).alias("avg_value"), F.stddev_samp(value).alias("std_value"), F.min(value).alias("min_value"), F.max(value).alias("max_value"))
    placed = position(days, [], ["day"], "day_index")
    fit = scalar_row(placed.agg(F.regr_slope("avg_value", "day_index").alias("slope")))
    return placed.withColumn("slope", fit["slope"])


def describe(df: DataFrame, col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Count, centre, spread and quartiles; the mode is null when all values differ."""
    keys = list(keys)
    base = df.groupBy(*keys).agg(
        F.count(col).alias("count"), F.avg(col).alias("mean"), F.coalesce(F.stddev_samp(col), F.lit(0.0)).alias("std"),
        F.coalesce(F.var_samp(col), F.lit(0.0)).alias("variance"), F.min(col).alias("min"), F.max(col).alias("max"))
    q = quantiles(df, keys, [col], [0.25, 0.5, 0.75]).withColumnRenamed(f"q_{col}", "_q")
    m = modes(df, keys, col)
    if keys:
        base = match(match(base, q, keys), m, keys, "left")
        quart, top, top_n = F.col("_q"), F.col("mode"), F.col("mode_n")
    else:
        quart, mode = scalar_row(q)["_q"], scalar_row(m)
        top, top_n = mode["mode"], mode["mode_n"]
    base = base.withColumns({"q1": quart[0], "median": quart[1], "q3": quart[2], "mode": F.when(top_n > 1, top)})
    out = base.withColumns({"range": F.col("max") - F.col("min"), "iqr": F.col("q3") - F.col("q1")})
    return out.select(*keys, "count", "mean", "median", "mode", "std", "variance", "min", "max", "range", "q1", "q3", "iqr")


def strength(corr: Column) -> Column:
    a = F.abs(corr)
    return F.when(a > 0.7, "strong").when(a > 0.3, "moderate").otherwise("weak")


def pair_correlation(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    out = df.groupBy(*keys).agg(F.corr(x, y).alias("correlation"))
    return out.withColumns({"r_squared": F.col("correlation") * F.col("correlation"), "strength": strength(F.col("correlation"))})


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Long table (a, b, correlation), both orders and the diagonal; every pair comes from one aggregate."""
    pairs = list(combinations(cols, 2))
    one = df.agg(*[F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{p}|{q}`").alias("correlation")) for p, q in pairs for a, b in ((p, q), (q, p))]
    cells += [F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.lit(1.0).alias("correlation")) for c in cols]
    return one.select(F.explode(F.array(*cells)).alias("c")).select("c.*")


def spearman(df: DataFrame, x: str, y: str) -> DataFrame:
    """Pearson correlation of average ranks, on the table of distinct complete pairs weighted by count."""
    df = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    freq = df.groupBy(x, y).agg(rows().alias("_w"))

    def ranks(c: str, name: str) -> DataFrame:
        f = df.groupBy(c).agg(rows().alias("_n"))
        return running(f, [], [c], {"_cum": ("sum", F.col("_n"))}).select(c, (F.col("_cum") - (F.col("_n") - 1) / 2).alias(name))

    r = freq.join(ranks(x, "_rx"), x).join(ranks(y, "_ry"), y)
    w, a, b = F.col("_w"), F.col("_rx"), F.col("_ry")
    s = r.agg(F.sum(w).alias("n"), F.sum(w * a).alias("a"), F.sum(w * b).alias("b"), F.sum(w * a * b).alias("ab"), F.sum(w * a * a).alias("aa"), F.sum(w * b * b).alias("bb"))
    cov = F.col("ab") - F.col("a") * F.col("b") / F.col("n")
    va, vb = F.col("aa") - F.col("a") * F.col("a") / F.col("n"), F.col("bb") - F.col("b") * F.col("b") / F.col("n")
    return s.select(F.try_divide(cov, F.sqrt(va * vb)).alias("spearman"))


def kendall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Kendall tau-b without forming pairs.

    Distinct pairs are counted first. Values of y become dense ranks; two rows are discordant when the
    one earlier in x has the larger rank. The highest bit in which the ranks differ assigns every such
    pair to one level, where it is a row with bit 1 before a row with bit 0 in the same group of higher
    bits: a running sum per (level, group), n log n rows in all.
    """
    freq = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(rows().alias("_w"))
    freq = freq.select(F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y"), "_w")
    order_y = position(freq.select("_y").distinct(), [], ["_y"], "_rank")
    levels = max(1, int(order_y.count() + 1).bit_length())
    ranked = freq.join(order_y, "_y")
    split = ranked.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))))
    split = split.withColumns({
        "_group": F.expr("shiftright(_rank, _level + 1)"), "_bit": F.expr("shiftright(_rank, _level) & 1"),
    })
    ones = running(split, ["_level", "_group"], ["_x", "_rank"], {"_ones": ("sum", F.when(F.col("_bit") == 1, F.col("_w")).otherwise(0))})
    disc = ones.agg(F.sum(F.when(F.col("_bit") == 0, F.col("_w").cast("double") * F.col("_ones"))).alias("d"))
    half = F.col("w").cast("double") * (F.col("w") - 1) / 2

    def ties(*cols: str) -> Column:
        return scalar_row(freq.groupBy(*cols).agg(F.sum("_w").alias("w")).agg(F.sum(half).alias("t")))["t"]

    n0, n1, n2, n3 = ties(), ties("_x"), ties("_y"), ties("_x", "_y")
    d = F.coalesce(F.col("d"), F.lit(0.0))
    return disc.select(F.try_divide(n0 - n1 - n2 + n3 - 2 * d, F.sqrt((n0 - n1) * (n0 - n2))).alias("tau_b"))


def top_correlated(df: DataFrame, target: str, cols: Sequence[str], k: int) -> DataFrame:
    one = df.agg(*[F.corr(c, target).alias(c) for c in cols if c != target])
    long = one.unpivot([], [c for c in cols if c != target], "feature", "correlation")
    return long.withColumn("strength", F.abs("correlation")).orderBy(F.desc("strength"), "feature").limit(k)


def linear_trend(df: DataFrame, x: Column, y: Column, keys: Sequence[str] = (), p_value: bool = False) -> DataFrame:
    """Least squares line with standard error of the slope; optionally the two-sided p-value."""
    s = df.select(*keys, x.cast("double").alias("_x"), y.cast("double").alias("_y")).groupBy(*keys).agg(
        F.regr_count("_y", "_x").alias("n"), F.regr_slope("_y", "_x").alias("slope"), F.regr_intercept("_y", "_x").alias("intercept"),
        F.corr("_y", "_x").alias("r"), F.regr_sxx("_y", "_x").alias("_sxx"), F.regr_syy("_y", "_x").alias("_syy"))
    rest = (1 - F.col("r") * F.col("r")) * F.col("_syy")
    s = s.withColumns({
        "r_squared": F.col("r") * F.col("r"),
        "stderr": F.sqrt(F.try_divide(F.greatest(rest, F.lit(0.0)), (F.col("n") - 2) * F.col("_sxx"))),
        "direction": F.when(F.col("slope") > 0, "increasing").when(F.col("slope") < 0, "decreasing").otherwise("stable"),
        "strength": strength(F.col("r")),
    })
    if p_value:
        @F.pandas_udf("double")
        def two_sided(slope: pd.Series, err: pd.Series, n: pd.Series) -> pd.Series:
            return pd.Series([t_two_sided(b / e, k - 2) if e and k > 2 else None for b, e, k in zip(slope, err, n)])

        s = s.withColumn("p_value", two_sided("slope", "stderr", F.col("n").cast("double")))
    return s.drop("_sxx", "_syy")


def fences(df: DataFrame, cols: Sequence[str], k: float = 1.5, keys: Sequence[str] = (), accuracy: int | None = None) -> DataFrame:
    """Quartile fences per column as `<col>_q1, _q3, _iqr, _lower, _upper`; `accuracy` picks the approximate sketch."""
    keys = list(keys)
    if accuracy:
        q = df.groupBy(*keys).agg(*[F.percentile_approx(c, [0.25, 0.75], accuracy).alias(f"q_{c}") for c in cols])
    else:
        q = quantiles(df, keys, cols, [0.25, 0.75])
    out = []
    for c in cols:
        q1, q3 = F.col(f"q_{c}")[0], F.col(f"q_{c}")[1]
        iqr = q3 - q1
        out += [q1.alias(f"{c}_q1"), q3.alias(f"{c}_q3"), iqr.alias(f"{c}_iqr"), (q1 - k * iqr).alias(f"{c}_lower"), (q3 + k * iqr).alias(f"{c}_upper")]
    return q.select(*keys, *out)


def quality(df: DataFrame, violations: dict[str, Column]) -> DataFrame:
    """Missing cells, duplicate rows, broken rules and the score that starts from 1."""
    cols = df.columns
    copies = scalar_row(df.groupBy(*cols).agg(rows().alias("_n")).agg(F.sum(F.col("_n") - 1).alias("dup")))
    one = df.agg(rows().alias("rows"), *[F.count_if(F.col(c).isNull()).alias(f"{c}_missing") for c in cols], *[F.count_if(v).alias(f"{n}_violations") for n, v in violations.items()])
    missing = reduce(lambda a, b: a + b, [F.col(f"{c}_missing") for c in cols])
    broken = reduce(lambda a, b: a + b, [(F.col(f"{n}_violations") > 0).cast("int") for n in violations], F.lit(0))
    one = one.withColumns({"duplicate_rows": copies["dup"], "missing_total": missing})
    ratio = F.col("missing_total") / (F.col("rows") * len(cols)) + F.col("duplicate_rows") / F.col("rows") + broken / len(cols)
    return one.withColumn("quality_score", 1 - ratio)


def profile(df: DataFrame) -> DataFrame:
    """One row per column: rows, missing, and min, max, mean of numeric ones."""
    nums = set(numeric_columns(df))
    aggs = [rows().alias("_rows")]
    for c in df.columns:
        v = F.col(c).cast("double") if c in nums else F.lit(None).cast("double")
        aggs += [F.struct(F.count_if(F.col(c).isNull()).alias("missing"), F.min(v).alias("min"), F.max(v).alias("max"), F.avg(v).alias("mean")).alias(c)]
    one = df.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col("_rows").alias("rows"), F.col(f"{c}.missing"), F.col(f"{c}.min"), F.col(f"{c}.max"), F.col(f"{c}.mean")) for c in df.columns])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def constants_and_infinities(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Per column: constant when it has at most one value (min equals max), and its infinite values."""
    one = df.agg(*[F.struct(F.coalesce(F.min(c) == F.max(c), F.lit(True)).alias("constant"), F.count_if(F.abs(F.col(c).cast("double")) == float("inf")).alias("infinite")).alias(c) for c in cols])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.constant"), F.col(f"{c}.infinite")) for c in cols])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def group_stats(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    base = df.groupBy(*by).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.count(value).alias("count"))
    med = quantiles(df, by, [value], [0.5]).select(*by, F.col(f"q_{value}")[0].alias("median"))
    return match(base, med, by)


def attainment(df: DataFrame, value: str, thresholds: Sequence[float], dt: float = 0.1, keys: Sequence[str] = ()) -> DataFrame:
    aggs = []
    for v in thresholds:
        hit = F.col(value) >= v
        name = f"{v:g}".replace(".", "_")
        aggs += [F.avg(hit.cast("double")).alias(f"share_{name}"), (F.count_if(hit) * dt).alias(f"seconds_{name}")]
    return df.groupBy(*keys).agg(*aggs)


def histogram(df: DataFrame, col: str, bins: int) -> DataFrame:
    """Equal-width bins over [min, max], the last one closed; empty bins are reported with 0."""
    lim = scalar_row(df.agg(F.min(col).cast("double").alias("lo"), F.max(col).cast("double").alias("hi")))
    width = (lim["hi"] - lim["lo"]) / bins
    b = F.least(F.floor(F.try_divide(F.col(col) - lim["lo"], width)), F.lit(bins - 1)).cast("int")
    seen = df.filter(F.col(col).isNotNull()).groupBy(F.coalesce(b, F.lit(0)).alias("bin")).agg(rows().alias("n"))
    grid = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return grid.join(seen, "bin", "left").select("bin", (lim["lo"] + F.col("bin") * width).alias("left_edge"), F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def fusion_summary(df: DataFrame, temperature: str, density: str, confinement: str) -> DataFrame:
    triple = F.col(temperature) * F.col(density) * F.col(confinement)
    out = df.agg(F.avg(temperature).alias("avg_temperature"), F.max(temperature).alias("max_temperature"), F.avg(density).alias("avg_density"),
                 F.avg(confinement).alias("avg_confinement_time"), F.avg(triple).alias("avg_triple_product"), F.max(triple).alias("max_triple_product"))
    return out.withColumns({"low_temperature": F.col("avg_temperature") < 10, "below_ignition": F.col("avg_triple_product") < 1e21})
