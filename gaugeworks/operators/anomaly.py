"""Anomaly scores and flags: statistical, physical, pattern-based, forests, local density, ensembles."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F, types as T

from gaugeworks.functions.stats import grubbs_critical
from gaugeworks.operators import space
from gaugeworks.operators.aggregate import fences, rows
from gaugeworks.operators.ordered import average_rank, framed, in_blocks, quantiles
from gaugeworks.operators.project import row_mean
from gaugeworks.operators.quality import center_and_mad
from gaugeworks.operators.windows import gradient, rate_flags
from gaugeworks.session import durable, match, scalar_row

# Guards and limits of the statistical scores.
TINY, MODIFIED_FACTOR, MODIFIED_LIMIT, Z_LIMIT = 1e-8, 0.6745, 3.5, 3.0
# Equipment and disruption limits.
HEALTH_LIMIT, LOW_SAFETY, HIGH_IMPURITY, COOLING_GRADIENT, TROYON = 0.8, 2.0, 0.1, -1e7, 0.028
# Physical limits per parameter (min, max) and fractional drops that point to a disruption.
PHYSICS_LIMITS = {
    "magnetic_field": (0.1, 15.0),
    "plasma_current": (0.1, 50.0),
    "density": (1e18, 5e21),
    "temperature": (0.1, 100.0),
    "q_factor": (0.01, 50.0),
}
DISRUPTION_DROPS = {"magnetic_field": 0.3, "current": 0.4, "density": 0.5}
Q_COLLAPSE = 0.8


@dataclass(frozen=True)
class Rule:
    """A limit or rate rule on one parameter of a named pattern."""

    pattern: str
    severity: str
    parameter: str
    kind: str
    value: float


# Rules of the four plasma patterns.
PATTERNS = [
    Rule("disruption_precursor", "critical", "q_factor", "min", 0),
    Rule("disruption_precursor", "critical", "q_factor", "max", 2),
    Rule("disruption_precursor", "critical", "beta", "max", 0.1),
    Rule("confinement_degradation", "high", "confinement_time", "decrease_rate", 0.1),
    Rule("confinement_degradation", "high", "energy_content", "decrease_rate", 0.05),
    Rule("thermal_runaway", "critical", "ion_temperature", "increase_rate", 10.0),
    Rule("thermal_runaway", "critical", "electron_temperature", "increase_rate", 10.0),
    Rule("density_limit", "high", "electron_density", "threshold", 5e20),
    Rule("density_limit", "high", "line_density", "threshold", 1e20),
]


def severity(score: Column) -> Column:
    return F.when(score < 2, "low").when(score < 3, "medium").when(score < 4, "high").otherwise("critical")


def _flagged(df: DataFrame, score: Column, limit: float, confidence: float) -> DataFrame:
    out = df.withColumn("score", score)
    return out.withColumns({"anomaly": F.col("score") > limit, "severity": severity(F.col("score")), "confidence": F.least(F.col("score") / confidence, F.lit(1.0))})


def z_score(df: DataFrame, col: str, keys: Sequence[str] = (), limit: float = Z_LIMIT) -> DataFrame:
    keys = list(keys)
    stats = df.groupBy(*keys).agg(F.avg(col).alias("_m"), F.stddev_pop(col).alias("_s"))
    if keys:
        base = match(df, stats, keys)
        m, s = F.col("_m"), F.col("_s")
    else:
        row = scalar_row(stats)
        base, m, s = df, row["_m"], row["_s"]
    return _flagged(base, F.abs((F.col(col) - m) / (s + TINY)), limit, limit).drop("_m", "_s")


def modified_z(df: DataFrame, col: str, limit: float = MODIFIED_LIMIT) -> DataFrame:
    r = scalar_row(center_and_mad(df, [col]))
    return _flagged(df, F.abs(MODIFIED_FACTOR * (F.col(col) - r[f"q_{col}"][1]) / (r[f"mad_{col}"] + TINY)), limit, limit)


def iqr_score(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """Distance beyond the fences in units of the interquartile range."""
    f = scalar_row(fences(df, [col], k))
    lo, hi, iqr = f[f"{col}_lower"], f[f"{col}_upper"], f[f"{col}_iqr"] + TINY
    out = df.withColumn("score", F.greatest((lo - F.col(col)) / iqr, (F.col(col) - hi) / iqr, F.lit(0.0)))
    return out.withColumns({"anomaly": (F.col(col) < lo) | (F.col(col) > hi), "severity": severity(F.col("score")), "confidence": F.least(F.col("score"), F.lit(1.0))})


def grubbs(df: DataFrame, col: str, alpha: float = 0.05) -> DataFrame:
    """Deviation in population deviations against the critical value of Grubbs' test for n rows."""
    critical = grubbs_critical(df.filter(F.col(col).isNotNull()).count(), alpha)
    return z_score(df, col, limit=critical)


def disruption_risk(df: DataFrame, keys: Sequence[str], order: Sequence[str], beta: str | None = None, safety: str | None = None, impurity: str | None = None, temperature: str | None = None, cooling: float = COOLING_GRADIENT) -> DataFrame:
    """Share of the indicators that hold, over those whose columns are given; predicted above one half."""
    hits = []
    if beta and safety:
        hits.append(F.col(beta) > TROYON * F.col(safety))
    if safety:
        hits.append(F.col(safety) < LOW_SAFETY)
    if impurity:
        hits.append(F.col(impurity) > HIGH_IMPURITY)
    if temperature:
        df = gradient(df, keys, order, temperature, "_slope")
        hits.append(F.col("_slope") < cooling)
    if not hits:
        return df.withColumns({"disruption_risk": F.lit(0.0), "disruption_predicted": F.lit(False)})
    share = reduce(lambda a, b: a + b, [F.coalesce(h, F.lit(False)).cast("int") for h in hits]) / len(hits)
    return df.withColumn("disruption_risk", share).withColumn("disruption_predicted", F.col("disruption_risk") > 0.5).drop("_slope")


def equipment(df: DataFrame, marker: str = "health") -> DataFrame:
    """Each health column below its limit, and their row mean below it."""


    cols = [c for c in df.columns if marker in c]
    if not cols:
        return df.withColumns({"equipment_anomaly": F.lit(False), "equipment_health_score": F.lit(1.0)})
    out = df.withColumns({f"{c.replace('_' + marker, '')}_anomaly": F.coalesce(F.col(c) < HEALTH_LIMIT, F.lit(False)) for c in cols})
    out = out.withColumn("equipment_health_score", row_mean(cols))
    return out.withColumn("equipment_anomaly", F.coalesce(F.col("equipment_health_score") < HEALTH_LIMIT, F.lit(False)))


def operational(df: DataFrame, q: str, fusion: str, heating: str, confinement: str) -> DataFrame:
    flags = {
        "q_factor_anomaly": F.col(q) < 0.1,
        "power_balance_anomaly": F.col(fusion) / (F.col(heating) + 1e-6) > 2.0,
        "confinement_anomaly": (F.col(confinement) < 0.05) | (F.col(confinement) > 5.0),
    }
    return df.withColumns(flags).withColumn("operational_anomaly", F.col("q_factor_anomaly") | F.col("power_balance_anomaly") | F.col("confinement_anomaly"))


def combine(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Number of raised flags per row, and whether there is any."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags])
    return df.withColumn("anomaly_count", total).withColumn("is_anomaly", F.col("anomaly_count") > 0)


def flag_summary(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    one = df.agg(rows().alias("_n"), *[F.count_if(f).alias(f) for f in flags])
    cells = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("count"), (F.col(f) / F.col("_n")).alias("rate")) for f in flags])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def physics_limits(df: DataFrame, keys: Sequence[str], order: Sequence[str], limits: dict[str, tuple[float, float]], drops: dict[str, float], q: str, collapse: float = Q_COLLAPSE) -> DataFrame:
    """Out-of-range flags, fractional drops to the previous row, and a low gain; type by precedence and a score."""
    out_of = reduce(lambda a, b: a | b, [(F.col(c) < lo) | (F.col(c) > hi) for c, (lo, hi) in limits.items()])

    def build(w):
        hits = [F.lag(c).over(w) * (1 - part) > F.col(c) for c, part in drops.items()]
        return {"drop": reduce(lambda a, b: a | b, [F.coalesce(h, F.lit(False)) for h in hits])}

    got = framed(df, keys, order, 1, 0, build)
    got = got.withColumns({"out_of_range": F.coalesce(out_of, F.lit(False)), "collapse": F.coalesce(F.col(q) < collapse, F.lit(False))})
    score = F.when(F.col("out_of_range"), 0.4).otherwise(0.0) + F.when(F.col("drop"), 0.4).otherwise(0.0) + F.when(F.col("collapse"), 0.2).otherwise(0.0)
    kind = F.when(F.col("out_of_range"), "physics").when(F.col("drop"), "disruption").when(F.col("collapse"), "performance").otherwise("none")
    return got.withColumns({"score": score, "type": kind})


def pattern_flags(df: DataFrame, keys: Sequence[str], order: Sequence[str], rules: Sequence[Rule] = PATTERNS) -> DataFrame:
    """One boolean per pattern: any of its limit or rate rules on a present column is broken."""
    rules = [r for r in rules if r.parameter in df.columns]
    for i, r in enumerate(rules):
        if r.kind in ("increase_rate", "decrease_rate"):
            up, down = (r.value, None) if r.kind == "increase_rate" else (None, r.value)
            df = rate_flags(df, keys, order, r.parameter, up, down, f"_rate{i}")

    def broken(i: int, r: Rule) -> Column:
        if r.kind == "min":
            return F.col(r.parameter) < r.value
        if r.kind in ("max", "threshold"):
            return F.col(r.parameter) > r.value
        return F.col(f"_rate{i}")

    names = list(dict.fromkeys(r.pattern for r in rules))
    flags = {n: reduce(lambda a, b: a | b, [F.coalesce(broken(i, r), F.lit(False)) for i, r in enumerate(rules) if r.pattern == n]) for n in names}
    return df.withColumns(flags).drop(*[f"_rate{i}" for i in range(len(rules))])


def pattern_summary(flagged: DataFrame, rules: Sequence[Rule] = PATTERNS) -> DataFrame:
    """Hits per pattern with confidence min(1, hits / max(10, a tenth of the rows))."""
    names = {r.pattern: r.severity for r in rules if r.pattern in flagged.columns}
    one = flagged.agg(rows().alias("_n"), *[F.count_if(n).alias(n) for n in names])
    cells = F.array(*[F.struct(F.lit(n).alias("pattern"), F.lit(s).alias("severity"), F.col(n).alias("hits"), F.col("_n").alias("n")) for n, s in names.items()])
    long = one.select(F.explode(cells).alias("c")).select("c.*")
    return long.select("pattern", "severity", "hits", F.least(F.lit(1.0), F.col("hits") / F.greatest(F.lit(10.0), F.col("n") * 0.1)).alias("confidence"))


def consensus(df: DataFrame, flags: Sequence[str]) -> DataFrame:
    """Flagged by at least two methods and by half of them, the whole part where their number is odd."""
    votes = reduce(lambda a, b: a + b, [F.coalesce(F.col(f), F.lit(False)).cast("int") for f in flags])
    need = max(2, len(flags) // 2)
    return df.withColumn("votes", votes).withColumn("consensus", F.col("votes") >= need)


def column_report(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """z-score and fence anomalies of every column: one aggregate for the limits, one for the counts."""
    s = scalar_row(df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]))
    f = scalar_row(fences(df, cols))
    one = df.agg(*[F.struct(
        F.count_if(F.abs((F.col(c) - s[f"m_{c}"]) / (s[f"s_{c}"] + TINY)) > Z_LIMIT).alias("z_count"),
        F.count_if((F.col(c) < f[f"{c}_lower"]) | (F.col(c) > f[f"{c}_upper"])).alias("iqr_count")).alias(c) for c in cols])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{c}.z_count"), F.col(f"{c}.iqr_count")) for c in cols])
    return one.select(F.explode(cells).alias("c")).select("c.*")


def metric_report(df: DataFrame, name: str, ts: str, value: str, limit: float = Z_LIMIT) -> DataFrame:
    """One row per anomalous reading with its metric's anomaly count and severity by share of readings."""
    scored = z_score(df, value, [name], limit)
    per = scored.groupBy(name).agg(rows().alias("total"), F.count_if("anomaly").alias("anomalies"))
    share = F.col("anomalies") / F.col("total")
    per = per.withColumn("level", F.when(share > 0.1, "high").when(share > 0.05, "medium").otherwise("low"))
    return match(scored.filter("anomaly").select(name, ts, value, "score"), per, [name])


# --- isolation forest -------------------------------------------------------------------------------

SAMPLE = 256


def _path_norm(n: float) -> float:
    return 0.0 if n <= 1 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, limit: int, out: list[tuple]) -> int:
    """Append nodes (feature, cut, left, right, path length) and return the index of the root of `x`."""
    me = len(out)
    out.append(None)
    spread = np.flatnonzero(x.max(axis=0) > x.min(axis=0)) if len(x) > 1 else []
    if depth >= limit or len(spread) == 0:
        out[me] = (-1, 0.0, -1, -1, depth + _path_norm(len(x)))
        return me
    f = int(rng.choice(spread))
    cut = float(rng.uniform(x[:, f].min(), x[:, f].max()))
    low = x[:, f] < cut
    left = _grow(x[low], rng, depth + 1, limit, out)
    right = _grow(x[~low], rng, depth + 1, limit, out)
    out[me] = (f, cut, left, right, 0.0)
    return me


def isolation_trees(df: DataFrame, key: str, cols: Sequence[str], trees: int = 100, seed: int = 42) -> list[dict]:
    """Trees grown on a hashed sample of 256 rows each; the model has at most trees x 511 nodes."""
    total = df.count()
    part = min(1.0, 4 * SAMPLE / max(total, 1))
    h = lambda t: F.pmod(F.xxhash64(F.col(key), t, F.lit(seed)), F.lit(1 << 40))
    chosen = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: h(t) < F.lit(int(part * (1 << 40))))
    sample = df.select(key, *cols).withColumn("tree", F.explode(chosen)).withColumn("_h", h(F.col("tree")))

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.nsmallest(SAMPLE, ["_h", key])
        t = int(pdf["tree"].iloc[0])
        nodes: list[tuple] = []
        x = pdf[list(cols)].to_numpy(float)
        _grow(x, np.random.default_rng(seed * 1000 + t), 0, math.ceil(math.log2(max(len(x), 2))), nodes)
        f, c, l, r, p = zip(*nodes)
        return pd.DataFrame({"tree": [t], "n": [len(x)], "feature": [list(f)], "cut": [list(c)], "left": [list(l)], "right": [list(r)], "path": [list(p)]})

    schema = "tree int, n int, feature array<int>, cut array<double>, left array<int>, right array<int>, path array<double>"
    return [r.asDict() for r in sample.groupBy("tree").applyInPandas(grow, schema).orderBy("tree").collect()]


def isolation_scores(df: DataFrame, cols: Sequence[str], model: list[dict]) -> DataFrame:
    """Anomaly score in (0, 1] per row, scored in Arrow batches against the shipped trees."""
    norm = _path_norm(float(np.mean([t["n"] for t in model])))
    packed = [tuple(np.asarray(t[k]) for k in ("feature", "cut", "left", "right", "path")) for t in model]
    shared = df.sparkSession.sparkContext.broadcast(packed)

    @F.pandas_udf("double")
    def score(*xs: pd.Series) -> pd.Series:
        x = np.column_stack([s.to_numpy(float) for s in xs])
        total = np.zeros(len(x))
        for f, c, l, r, p in shared.value:
            at = np.zeros(len(x), int)
            while True:
                inner = f[at] >= 0
                if not inner.any():
                    break
                i = np.flatnonzero(inner)
                a = at[i]
                at[i] = np.where(x[i, f[a]] < c[a], l[a], r[a])
            total += p[at]
        return pd.Series(np.exp2(-total / len(shared.value) / norm) if norm else np.ones(len(x)))

    return df.withColumn("score", score(*[F.col(c).cast("double") for c in cols]))


def isolation_forest(df: DataFrame, key: str, cols: Sequence[str], trees: int = 100, contamination: float = 0.1, seed: int = 42) -> DataFrame:
    """Add `score` and `anomaly`, above the quantile 1 - `contamination` of the scores.

    The trees and the quantile read the key and the features only, and rows are scored where they are scanned, so the table
    is neither shuffled nor written. Trees come from hashes of the key: whichever task scores a row again gives the same.
    """
    model = isolation_trees(df.select(key, *cols), key, cols, trees, seed)
    scores = isolation_scores(df.select(*cols), cols, model).select("score")
    edge = scalar_row(quantiles(scores, [], ["score"], [1 - contamination]))["q_score"][0]
    return isolation_scores(df, cols, model).withColumn("anomaly", F.col("score") > edge)


def comprehensive(df: DataFrame, key: str, cols: Sequence[str], keys: Sequence[str], order: Sequence[str], rules: Sequence[Rule] = PATTERNS, trees: int = 50) -> DataFrame:
    """All methods side by side per row: z-score and fences over any column, forest, patterns, and their consensus."""
    s = scalar_row(df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]))
    f = scalar_row(fences(df, cols))
    either = lambda conds: reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conds])
    out = isolation_forest(df, key, cols, trees).withColumnRenamed("anomaly", "forest_flag").withColumnRenamed("score", "forest_score")
    out = out.withColumns({
        "z_flag": either([F.abs((F.col(c) - s[f"m_{c}"]) / (s[f"s_{c}"] + TINY)) > Z_LIMIT for c in cols]),
        "iqr_flag": either([(F.col(c) < f[f"{c}_lower"]) | (F.col(c) > f[f"{c}_upper"]) for c in cols]),
    })
    out = pattern_flags(out, keys, order, rules)
    names = [n for n in dict.fromkeys(r.pattern for r in rules) if n in out.columns]
    out = out.withColumn("pattern_flag", either([F.col(n) for n in names]) if names else F.lit(False))
    return consensus(out, ["z_flag", "iqr_flag", "forest_flag", "pattern_flag"])


# --- local outlier factor ---------------------------------------------------------------------------


def outlier_factors(df: DataFrame, key: str, cols: Sequence[str], k: int = 20, contamination: float = 0.1, scale: bool = True) -> DataFrame:
    """Add `lof`, the local outlier factor over all features, and `anomaly`, above the quantile 1 - `contamination` of it.

    Exactly k neighbours a row, by distance and then the smaller key; features are standardised first unless `scale` is
    False. Copies of a position are one weighted point, with the same factor; with more than k copies it is that of equal
    densities. Rows with a null feature get nulls. `key` is a unique whole number.
    """
    known = df.dropna(subset=list(cols))
    placed = space.scaled(known, cols, "_vec") if scale else known.withColumn("_vec", F.array(*[F.col(c).cast("double") for c in cols]))
    placed = durable(placed.withColumn("_vec", F.transform("_vec", lambda x: x + 0.0)))
    points = durable(space.positions(placed.select(key, F.col("_vec").alias("vec")), key))
    near = durable(space.nearest(points, len(cols), k))
    reach = near.select(F.col("id").alias("peer"), F.element_at("near", -1)["distance"].alias("kd"))
    edges = near.select("id", F.explode("near").alias("n")).select("id", F.col("n.id").alias("peer"), "n.distance", "n.w")
    mean = lambda c: F.sum(c * F.col("w")) / F.sum("w")
    density = edges.join(reach, "peer").groupBy("id").agg((1 / (mean(F.greatest("distance", "kd")) + 1e-10)).alias("lrd"))
    density = durable(density)
    around = edges.join(density.withColumnsRenamed({"id": "peer"}), "peer").groupBy("id").agg(mean(F.col("lrd")).alias("_around"))
    lof = points.join(around, "id").join(density, "id").select(F.col("vec").alias("_vec"), (F.col("_around") / F.col("lrd")).alias("lof"))
    scored = durable(placed.join(lof, "_vec", "left").drop("_vec"))
    edge = scalar_row(quantiles(scored, [], ["lof"], [1 - contamination]))["q_lof"][0]
    scored = scored.withColumn("anomaly", F.col("lof") > edge)
    rest = df.filter(" or ".join(f"`{c}` is null" for c in cols))
    return scored.unionByName(rest.withColumns({"lof": F.lit(None).cast("double"), "anomaly": F.lit(None).cast("boolean")}))


def local_outlier_factor(df: DataFrame, keys: Sequence[str], value: str, tie: str, k: int = 20) -> DataFrame:
    """Local outlier factor of a reading among those of its key.

    On one axis the k nearest neighbours are among the k rows before and the k after in value order, so blocks of rows with
    3 k rows around them give distance, density and factor as arrays, without any pair join. A missing reading's distances
    are unknown and come first.
    """
    out = T.StructType([*df.schema.fields, T.StructField("lof", T.DoubleType())])

    def run(table: pa.Table) -> pa.Table:
        values = table[value].cast("float64")
        factor = factors_in_order(values.to_numpy(), values.is_null().to_numpy(), k)
        lof = pa.array(factor[0], mask=factor[1])
        return table.append_column("lof", lof).filter(table["_own"])

    return in_blocks(df, keys, [value, tie], 3 * k, 3 * k, out, run)


def factors_in_order(v: np.ndarray, missing: np.ndarray, k: int, rows: int = 10_000) -> tuple[np.ndarray, np.ndarray]:
    """Outlier factors of ordered numbers, and where they are unknown; ties of distance go to the earlier place."""
    n, steps = len(v), np.array([*range(-k, 0), *range(1, k + 1)])
    near, gap = np.empty((n, k), np.int64), np.empty((n, k))
    size = np.empty(n, np.int64)
    for start in range(0, n, rows):
        i = np.arange(start, min(start + rows, n))
        j = i[:, None] + steps
        there = (j >= 0) & (j < n)
        j = np.clip(j, 0, n - 1)
        d = np.abs(v[j] - v[i, None])
        kind = np.where(there, np.where(missing[j] | missing[i, None], 0, np.where(np.isnan(d), 2, 1)), 3)
        order = np.argsort(d, 1, kind="stable") if (kind == 1).all() else np.lexsort((d, kind), axis=1)
        order = order[:, :k]
        near[i], gap[i], size[i] = np.take_along_axis(j, order, 1), np.take_along_axis(d, order, 1), np.minimum(there.sum(1), k)
    use = np.arange(k) < size[:, None]
    lost = missing[near] | missing[:, None]
    last = (np.arange(n), np.maximum(size - 1, 0))
    kd, kd_lost = gap[last], lost[last]
    reach = np.where(lost, kd[near], np.where(kd_lost[near], gap, np.maximum(gap, kd[near])))
    unknown = (use & lost & kd_lost[near]).any(1) | (size == 0)
    count = np.maximum(size, 1)
    density = 1 / (np.where(use, reach, 0.0).sum(1) / count + 1e-10)
    factor = np.where(use, density[near], 0.0).sum(1) / count / density
    return factor, unknown | (use & unknown[near]).any(1)


def ensemble(df: DataFrame, scores: dict[str, float]) -> DataFrame:
    """Weighted mean of min-max scaled scores, high meaning anomalous; label above the mean of the ensemble > .5."""
    s = scalar_row(df.agg(*[F.min(c).alias(f"a_{c}") for c in scores], *[F.max(c).alias(f"b_{c}") for c in scores]))
    total = sum(scores.values())
    parts = [F.coalesce(F.try_divide(F.col(c) - s[f"a_{c}"], s[f"b_{c}"] - s[f"a_{c}"]), F.lit(0.0)) * (w / total) for c, w in scores.items()]
    return df.withColumn("ensemble", reduce(lambda a, b: a + b, parts)).withColumn("anomaly", F.col("ensemble") > 0.5)


def reconstruction_error(df: DataFrame, cols: Sequence[str], k: int, quantile: float = 0.95) -> DataFrame:
    """Mean squared error of rebuilding standardised columns from k components; flagged above the quantile."""


    data = VectorAssembler(inputCols=list(cols), outputCol="_x").transform(df)
    data = StandardScaler(withMean=True, inputCol="_x", outputCol="_v").fit(data).transform(data)
    scored = PCA(k=k, inputCol="_v", outputCol="_p").fit(data).transform(data)
    n = scalar_row(df.agg(F.count(F.lit(1)).cast("double").alias("n")))["n"]
    # The components are orthonormal: what they miss of a row is its square less the square of its scores. The scaler
    # divides by the sample deviation, n / (n - 1) turns the squares into those of the population's.
    square = lambda v: F.aggregate(vector_to_array(v), F.lit(0.0), lambda s, x: s + x * x)
    err = F.greatest(square("_v") - square("_p"), F.lit(0.0)) / len(cols) * F.coalesce(F.try_divide(n, n - 1), F.lit(0.0))
    scored = scored.withColumn("error", err).drop("_x", "_v", "_p")
    edge = scalar_row(quantiles(scored, [], ["error"], [quantile]))["q_error"][0]
    return scored.withColumn("anomaly", F.col("error") > edge)


def evaluate(df: DataFrame, truth: str, predicted: str, score: str | None = None) -> DataFrame:
    """Confusion counts, the usual ratios, and the area under the curve from average ranks of the score."""
    t, p = F.col(truth) == 1, F.col(predicted) == 1
    out = df.agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))

    def part(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a, b), F.lit(0.0))

    out = out.withColumns({"accuracy": part(tp + tn, tp + fp + tn + fn), "precision": part(tp, tp + fp), "recall": part(tp, tp + fn), "specificity": part(tn, tn + fp), "f1": part(2 * tp, 2 * tp + fp + fn)})
    ranked = average_rank(df.select(F.col(truth).alias("_t"), F.col(score or predicted).alias("_s")), [], "_s", "_r")
    auc = ranked.agg(F.sum(F.when(F.col("_t") == 1, F.col("_r"))).alias("s"), F.count_if(F.col("_t") == 1).alias("p"), F.count_if(F.col("_t") != 1).alias("n"))
    auc = scalar_row(auc.select(F.try_divide(F.col("s") - F.col("p") * (F.col("p") + 1) / 2, F.col("p") * F.col("n")).alias("auc")))
    return out.withColumn("auc", auc["auc"])
