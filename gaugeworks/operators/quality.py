"""Cleaning, validation against constraint tables, scaling, feature selection and splits."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import PCA, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame, functions as F

from gaugeworks.operators import space
from gaugeworks.operators.aggregate import fences, numeric_columns, rows
from gaugeworks.operators.ordered import modes, quantiles, running
from gaugeworks.operators.project import FEATURES, engineer
from gaugeworks.operators.trees import forests
from gaugeworks.functions.portable import portable_hash
from gaugeworks.session import durable, match, scalar_row

# Parameter, min, max, typical min, typical max.
CONSTRAINTS = [
    ("magnetic_field", 0.1, 20.0, 2.0, 8.0),
    ("plasma_current", 0.1, 50.0, 5.0, 25.0),
    ("electron_density", 1e18, 5e21, 5e19, 2e20),
    ("ion_temperature", 0.1, 200.0, 5.0, 50.0),
    ("electron_temperature", 0.1, 200.0, 3.0, 40.0),
    ("neutral_beam_power", 0.0, 500.0, 10.0, 150.0),
    ("rf_heating_power", 0.0, 200.0, 5.0, 80.0),
    ("q_factor", 0.001, 100.0, 0.1, 20.0),
    ("beta", 0.0, 0.2, 0.01, 0.1),
    ("confinement_time", 0.001, 10.0, 0.1, 3.0),
]
# Limits of the cross-column checks.
RATIO_BAND, GREENWALD_SAFETY, TROYON_SAFETY, MINOR_RADIUS, TROYON_LIMIT = (0.5, 3.0), 1.2, 1.1, 2.0, 2.8e-2


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN means missing: replaced by null on ingest, since Spark would sort and sum it as a number."""
    cols = [c for c, k in df.dtypes if k in ("double", "float")]
    return df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c in cols}) if cols else df


def impute(df: DataFrame, cols: Sequence[str], strategy: str = "median", fit: DataFrame | None = None) -> DataFrame:
    """Fill missing numbers with the median or mean of `fit` (the rows themselves by default)."""
    fit = df if fit is None else fit
    if strategy == "mean":
        stats = scalar_row(fit.agg(*[F.avg(c).alias(c) for c in cols]))
        return df.withColumns({c: F.coalesce(F.col(c), stats[c]) for c in cols})
    stats = scalar_row(quantiles(fit, [], cols, [0.5]))
    return df.withColumns({c: F.coalesce(F.col(c), stats[f"q_{c}"][0]) for c in cols})


def impute_nearest(df: DataFrame, key: str, block: Sequence[str], target: str, axis0: str, k: int = 5) -> DataFrame:
    """Fill a missing target with the mean over the k known positions of the same block nearest on an axis.

    Known rows are reduced to distinct positions with their mean. Positions are numbered in order, so a
    missing row meets the k below and the k above it and no pairs within a block are formed.
    """
    known = df.filter(F.col(target).isNotNull()).groupBy(*block, axis0).agg(F.avg(target).alias("_t"), rows().alias("_n")).withColumn("_key", F.lit(None).cast(df.schema[key].dataType))
    holes = df.filter(F.col(target).isNull()).select(*block, axis0, F.col(key).alias("_key")).withColumns({"_t": F.lit(None).cast("double"), "_n": F.lit(None).cast("bigint")})
    both = known.unionByName(holes).withColumn("_known", F.col("_t").isNotNull().cast("int"))
    # Known positions are numbered; a hole takes the numbers around it.
    both = running(both, block, [axis0, "_known"], {"_no": ("sum", F.col("_known"))})
    spots = both.filter("_known = 1").select(*block, "_no", F.col(axis0).alias("_x"), "_t")
    want = both.filter("_known = 0").select(*block, F.col(axis0).alias("_at"), "_key", F.explode(F.sequence(F.col("_no") - (k - 1), F.col("_no") + k)).alias("_no"))
    near = want.join(spots, [*block, "_no"]).withColumn("_d", F.abs(F.col("_x") - F.col("_at")))
    # At most 2k candidates per hole, so the sorted array is bounded.
    best = near.groupBy("_key").agg(F.slice(F.sort_array(F.collect_list(F.struct("_d", "_x", "_t"))), 1, k).alias("_c"))
    filled = best.select(F.col("_key").alias(key), (F.aggregate("_c", F.lit(0.0), lambda a, c: a + c["_t"]) / F.size("_c")).alias("_fill"))
    return df.join(filled, key, "left").withColumn(target, F.coalesce(F.col(target), F.col("_fill"))).drop("_fill")


def impute_neighbours(df: DataFrame, key: str, cols: Sequence[str], k: int = 5) -> DataFrame:
    """Fill every missing number with the mean over the k rows nearest to it that know the column.

    Distances are Euclidean over the features known on both sides, raised by the share of the unknown ones; a row that shares
    none with any other gets the column's mean. Filled values don't serve as donors. Copies of a position have one common
    value, their mean; ties go to the smaller key. Each pattern of known features has a tree of its own. `key` is a unique
    whole number, features are taken as they are, so scale them first where units differ.
    """
    d = len(cols)
    given = durable(df.select(F.col(key).cast("long").alias("id"), F.array(*[F.col(c).cast("double") for c in cols]).alias("vec")))
    means = scalar_row(df.agg(*[F.avg(c).alias(c) for c in cols]))
    holes = given.agg(*[F.count_if(space.at("vec", j).isNull()).alias(c) for j, c in enumerate(cols)]).first()
    fills = {}
    for j, c in enumerate(cols):
        if not holes[c]:
            continue
        # Donors and holes are apart by whether the column is known, so its own value can stay out of the position.
        apart = given.withColumns({"_v": space.at("vec", j), "vec": F.transform("vec", lambda x, i: F.when(i != j, x + 0.0))})
        spots = apart.groupBy("vec", F.col("_v").isNull().alias("hole")).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("w"), F.avg("_v").alias("mean"))
        spots = durable(spots)
        near = space.nearest(spots, d, k, F.col("hole"), ~F.col("hole"), partial=True)
        edges = near.select("id", F.explode("near").alias("n")).select("id", F.col("n.id").alias("peer"), "n.w")
        value = edges.join(spots.select(F.col("id").alias("peer"), "mean"), "peer").groupBy("id").agg((F.sum(F.col("mean") * F.col("w")) / F.sum("w")).alias("_fill"))
        by_spot = spots.filter("hole").join(value, "id").select("vec", "_fill")
        fills[c] = durable(match(apart.filter("_v is null").select("id", "vec"), by_spot, ["vec"]).select(F.col("id").alias(key), F.col("_fill").alias(f"_fill_{c}")))
    out = df
    for c, f in fills.items():
        out = out.join(f, key, "left").withColumn(c, F.coalesce(F.col(c), F.col(f"_fill_{c}"), means[c])).drop(f"_fill_{c}")
    return out


def impute_mode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Nulls become the column's most frequent value, the smallest on a tie; a column without values stays null.

    Columns of one type are counted together in one scan, as (column, value) pairs combined on the map side.
    """
    kinds: dict[str, list[str]] = {}
    for c in cols:
        kinds.setdefault(df.schema[c].dataType.simpleString(), []).append(c)
    fills = {}
    for group in kinds.values():
        pairs = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_col"), F.col(f"`{c}`").alias("_val")) for c in group])).alias("_p")).select("_p.*")
        found = scalar_row(modes(pairs, ["_col"], "_val").agg(F.map_from_entries(F.collect_list(F.struct("_col", "mode"))).alias("modes")))["modes"]
        fills |= {c: F.coalesce(F.col(f"`{c}`"), found[c]) for c in group}
    return df.withColumns(fills)


def cap_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Values beyond the quartile fences set to the fence; rows and nulls stay."""
    f = scalar_row(fences(df, cols, k))
    return df.withColumns({c: F.when(F.col(c).isNotNull(), F.least(f[f"{c}_upper"], F.greatest(f[f"{c}_lower"], F.col(c)))) for c in cols})


def drop_outliers(df: DataFrame, cols: Sequence[str], method: str = "iqr", threshold: float = 1.5) -> DataFrame:
    """Remove outliers column by column; each column's limits come from the rows the previous one left."""
    for c in cols:
        if c not in df.columns:
            continue
        if method == "iqr":
            f = fences(df, [c], threshold).first()
            df = df.filter(F.col(c).between(f[f"{c}_lower"], f[f"{c}_upper"]))
        else:
            s = df.agg(F.avg(c).alias("m"), F.stddev_samp(c).alias("sd")).first()
            df = df.filter(F.abs(F.try_divide(F.col(c) - s["m"], F.lit(s["sd"]))) <= threshold)
    return df


def constraint_report(df: DataFrame, constraints: Sequence[tuple] = CONSTRAINTS) -> DataFrame:
    """Per constrained column: counts below, above, atypical, negative and missing, and the worst severity."""
    have = [c for c in constraints if c[0] in df.columns]
    aggs = []
    for name, lo, hi, tlo, thi in have:
        c = F.col(name)
        inside = c.between(lo, hi)
        aggs.append(F.struct(
            F.count_if(c < lo).alias("below"), F.count_if(c > hi).alias("above"), F.count_if(inside & ((c < tlo) | (c > thi))).alias("atypical"),
            F.count_if(c < 0).alias("negative"), F.count_if(c.isNull()).alias("missing"), rows().alias("total")).alias(name))
    one = df.agg(*aggs)
    cells = F.array(*[F.struct(F.lit(n).alias("parameter"), F.col(n).alias("s")) for n, *_ in have])
    long = one.select(F.explode(cells).alias("c")).select("c.parameter", "c.s.*")
    bad = F.col("below") + F.col("above")
    severity = F.when(bad + F.col("negative") > 0, "critical").when(F.col("atypical") + F.col("missing") > 0, "warning").otherwise("info")
    return long.withColumn("severity", severity)


def physics_checks(df: DataFrame, ti: str, te: str, density: str, current: str, beta: str, field: str, density_scale: float = 1e6 * 1e20) -> dict[str, Column]:
    """Cross-column conditions that are true where a relation is broken."""
    ratio = F.try_divide(ti, te)
    greenwald = F.col(current) * density_scale / (math.pi * MINOR_RADIUS**2)
    troyon = F.try_divide(F.lit(TROYON_LIMIT) * F.col(current), MINOR_RADIUS * F.col(field))
    return {
        "temperature_ratio": (ratio < RATIO_BAND[0]) | (ratio > RATIO_BAND[1]),
        "density_limit": F.col(density) > greenwald * GREENWALD_SAFETY,
        "beta_limit": F.col(beta) > troyon * TROYON_SAFETY,
    }


def center_and_mad(df: DataFrame, cols: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Median and median absolute deviation per column: two passes, arrays `q_<col>` and `mad_<col>`."""
    keys = list(keys)
    med = quantiles(df, keys, cols, [0.25, 0.5, 0.75])
    if keys:
        dev = match(df, med, keys).select(*keys, *[F.abs(F.col(c) - F.col(f"q_{c}")[1]).alias(c) for c in cols])
    else:
        m = scalar_row(med)
        dev = df.select(*[F.abs(F.col(c) - m[f"q_{c}"][1]).alias(c) for c in cols])
    mad = quantiles(dev, keys, cols, [0.5]).select(*keys, *[F.col(f"q_{c}")[0].alias(f"mad_{c}") for c in cols])
    if keys:
        return match(med, mad, keys)
    m2 = scalar_row(mad)
    return med.withColumns({f"mad_{c}": m2[f"mad_{c}"] for c in cols})


def outlier_flags(df: DataFrame, col: str) -> DataFrame:
    """Flags of three methods (quartile fences, z-score, modified z-score) and their union; needs 10 values."""
    s = scalar_row(df.agg(F.count(col).alias("n"), F.avg(col).alias("m"), F.stddev_pop(col).alias("sd")))
    r = scalar_row(center_and_mad(df, [col]))
    c, q, mad = F.col(col), r[f"q_{col}"], r[f"mad_{col}"]
    iqr = q[2] - q[0]
    flags = {
        "iqr_flag": (iqr > 0) & ((c < q[0] - 1.5 * iqr) | (c > q[2] + 1.5 * iqr)),
        "z_flag": (s["n"] > 30) & (F.abs(F.try_divide(c - s["m"], s["sd"])) > 3.0),
        "modified_z_flag": (mad > 0) & (F.abs(F.try_divide(F.lit(0.6745) * (c - q[1]), mad)) > 3.5),
    }
    flags = {n: F.coalesce(f & (s["n"] >= 10), F.lit(False)) for n, f in flags.items()}
    return df.withColumns(flags).withColumn("outlier", F.col("iqr_flag") | F.col("z_flag") | F.col("modified_z_flag"))


def outlier_report(df: DataFrame, col: str) -> DataFrame:
    got = outlier_flags(df, col).agg(F.count(col).alias("n"), *[F.count_if(f).alias(f) for f in ("iqr_flag", "z_flag", "modified_z_flag", "outlier")])
    return got.withColumn("severity", F.when(F.col("outlier") == 0, "none").when(F.col("outlier") > F.col("n") * 0.1, "critical").otherwise("warning"))


def issue_table(df: DataFrame, issues: Sequence[tuple[str, str, str, Column]]) -> DataFrame:
    """Rows (severity, field, message, count) for the checks that found something; one scan."""
    one = df.agg(*[F.count_if(cond).alias(f"_{i}") for i, (*_, cond) in enumerate(issues)])
    cells = F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(f).alias("field"), F.lit(m).alias("message"), F.col(f"_{i}").alias("count")) for i, (s, f, m, _) in enumerate(issues)])
    return one.select(F.explode(cells).alias("c")).select("c.*").filter("count > 0")


def issue_summary(issues: DataFrame) -> DataFrame:
    """Issues per severity; the data is valid when nothing critical was found."""
    return issues.agg(rows().alias("issues"), *[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "warning", "info")]).withColumn("valid", F.col("critical") == 0)


def quality_gate(df: DataFrame, critical: Sequence[str], max_missing: float = 0.1, max_extreme: float = 0.05) -> dict:
    """Raise when too many rows miss a critical value; return the counts and the columns to warn about."""
    s = scalar_row(df.agg(*[F.avg(c).alias(f"m_{c}") for c in critical], *[F.stddev_samp(c).alias(f"s_{c}") for c in critical]))
    hole = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in critical])
    row = df.agg(rows().alias("n"), F.count_if(hole).alias("missing"), *[F.count_if(F.abs(F.try_divide(F.col(c) - s[f"m_{c}"], s[f"s_{c}"])) > 5).alias(c) for c in critical]).first()
    if row["missing"] > row["n"] * max_missing:
        raise ValueError(f"{row['missing']} of {row['n']} rows miss a critical value")
    return {"rows": row["n"], "missing": row["missing"], "warn": [c for c in critical if row[c] > row["n"] * max_extreme]}


def scale(df: DataFrame, cols: Sequence[str], method: str = "standard", fit: DataFrame | None = None) -> DataFrame:
    """Standard (population deviation), min-max or robust scaling with statistics of `fit`; constants map to 0."""
    fit = df if fit is None else fit
    if method == "robust":
        q = scalar_row(quantiles(fit, [], cols, [0.25, 0.5, 0.75]))
        shift = {c: q[f"q_{c}"][1] for c in cols}
        width = {c: q[f"q_{c}"][2] - q[f"q_{c}"][0] for c in cols}
    elif method == "minmax":
        s = scalar_row(fit.agg(*[F.min(c).alias(f"a_{c}") for c in cols], *[F.max(c).alias(f"b_{c}") for c in cols]))
        shift, width = {c: s[f"a_{c}"] for c in cols}, {c: s[f"b_{c}"] - s[f"a_{c}"] for c in cols}
    elif method == "standard":
        s = scalar_row(fit.agg(*[F.avg(c).alias(f"a_{c}") for c in cols], *[F.stddev_pop(c).alias(f"b_{c}") for c in cols]))
        shift, width = {c: s[f"a_{c}"] for c in cols}, {c: s[f"b_{c}"] for c in cols}
    else:
        raise ValueError(f"unknown scaling {method!r}")
    return df.withColumns({c: (F.col(c) - shift[c]) / F.when(width[c] == 0, 1.0).otherwise(width[c]) for c in cols})


def f_scores(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """F statistic of each single-feature regression, from its correlation."""
    one = df.agg(rows().alias("_n"), *[F.corr(c, target).alias(c) for c in cols])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in cols])
    long = one.select("_n", F.explode(cells).alias("c")).select("_n", "c.feature", "c.r")
    r2 = F.col("r") * F.col("r")
    return long.select("feature", (F.try_divide(r2, 1 - r2) * (F.col("_n") - 2)).alias("f_score"))


def select_by_f(df: DataFrame, cols: Sequence[str], target: str, k: int) -> DataFrame:
    return f_scores(df, cols, target).orderBy(F.desc("f_score"), "feature").limit(k)


def mutual_information(df: DataFrame, cols: Sequence[str], target: str, bins: int = 10) -> DataFrame:
    """Mutual information of equal-width bins of each feature with those of the target, in nats."""
    every = [*cols, target]
    s = scalar_row(df.agg(*[F.min(c).cast("double").alias(f"a_{c}") for c in every], *[F.max(c).cast("double").alias(f"b_{c}") for c in every]))

    def binned(c: str) -> Column:
        return F.coalesce(F.least(F.floor(F.try_divide((F.col(c) - s[f"a_{c}"]) * bins, s[f"b_{c}"] - s[f"a_{c}"])), F.lit(bins - 1)), F.lit(0)).cast("int")

    b = df.select(binned(target).alias("y"), *[binned(c).alias(c) for c in cols])
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in cols])
    n = b.select("y", F.explode(cells).alias("c")).groupBy("c.feature", "c.x", "y").agg(rows().cast("double").alias("n"))
    nx, ny, total = n.groupBy("feature", "x").agg(F.sum("n").alias("nx")), n.groupBy("feature", "y").agg(F.sum("n").alias("ny")), n.groupBy("feature").agg(F.sum("n").alias("t"))
    j = n.join(nx, ["feature", "x"]).join(ny, ["feature", "y"]).join(total, "feature")
    return j.groupBy("feature").agg(F.sum(F.col("n") / F.col("t") * F.ln(F.col("n") * F.col("t") / (F.col("nx") * F.col("ny")))).alias("mutual_information"))


def digamma(x: Column) -> Column:
    """For x >= 1, to about 1e-12: the asymptotic series at x + 8."""
    y = x + 8.0
    i = 1 / (y * y)
    tail = i * (1 / 12 - i * (1 / 120 - i * (1 / 252 - i * (1 / 240 - i / 132))))
    return F.ln(y) - 0.5 / y - tail - reduce(lambda a, b: a + b, [1 / (x + float(j)) for j in range(8)])


def mutual_information_nearest(df: DataFrame, key: str, cols: Sequence[str], target: str, k: int = 3) -> DataFrame:
    """(feature, mutual_information) in nats of each feature with a continuous target, by nearest neighbours.

    The larger of the two gaps, each over its column's deviation, is the distance of two rows. A row's radius falls short of the
    distance to its k-th neighbour; the rows within it are counted on either axis by running counts, no pairs. The estimate is
    digamma(n) + digamma(k) less the mean digammas of both counts, itself included, and not below 0. No noise is added: rows
    that have k copies count their equals. Rows with a null in the pair are left out. `key` is a unique whole number.
    """
    parts = []
    for c in cols:
        pair = df.select(F.col(key).cast("long").alias("id"), F.col(c).cast("double").alias("x"), F.col(target).cast("double").alias("y")).dropna()
        s = scalar_row(pair.agg(F.stddev_pop("x").alias("x"), F.stddev_pop("y").alias("y")))
        by = lambda v: F.col(v) / F.when(s[v] > 0, s[v]).otherwise(1.0)
        spots = durable(space.positions(pair.select("id", F.array(by("x"), by("y")).alias("vec")), "id"))
        near = space.nearest(spots, 2, k, metric="chebyshev")
        radius = near.select("id", (F.element_at("near", -1)["distance"] * (1 - 1e-12)).alias("r"))
        known = durable(spots.join(radius, "id").select("id", "w", "r", F.posexplode("vec").alias("axis", "v")))
        marks = F.array(F.struct((F.col("v") - F.col("r")).alias("at"), F.lit(0).alias("kind"), F.lit(0).cast("bigint").alias("n")),
                        F.struct(F.col("v").alias("at"), F.lit(1).alias("kind"), F.col("w").alias("n")),
                        F.struct((F.col("v") + F.col("r")).alias("at"), F.lit(2).alias("kind"), F.lit(0).cast("bigint").alias("n")))
        line = known.select("id", "axis", "w", F.explode(marks).alias("m")).select("id", "axis", "w", "m.*")
        line = running(line, ["axis"], ["at", "kind", "id"], {"_c": ("sum", F.col("n"))})
        pick = lambda j: F.max(F.when(F.col("kind") == j, F.col("_c")))
        counts = line.groupBy("id", "axis", "w").agg((pick(2) - pick(0)).alias("n"))
        total = scalar_row(pair.agg(rows().cast("double").alias("n")))["n"]
        mean = F.sum(digamma(F.col("n").cast("double")) * F.col("w")) / total
        value = digamma(total) + float(_digamma_whole(k)) - F.coalesce(mean, F.lit(0.0))
        parts.append(counts.agg(value.alias("mutual_information")).select(F.lit(c).alias("feature"), F.greatest(F.lit(0.0), F.when(total > k, F.col("mutual_information")).otherwise(0.0)).alias("mutual_information")))
    return reduce(lambda a, b: a.unionByName(b), parts)


def _digamma_whole(k: int) -> float:
    return sum(1 / j for j in range(1, k)) - 0.5772156649015329


def forest_importance(df: DataFrame, cols: Sequence[str], target: str, trees: int = 20, depth: int = 5, seed: int = 42) -> dict[str, float]:
    if df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) for c in cols])).limit(1).count():
        raise ValueError(f"a forest needs a value in every one of {list(cols)}")
    if got := forests(df, cols, target, trees, depth, seed):
        return dict(zip(cols, (float(v) for v in got[0].model().featureImportances.toArray())))
    data = VectorAssembler(inputCols=list(cols), outputCol="_x").transform(df)
    m = RandomForestRegressor(featuresCol="_x", labelCol=target, numTrees=trees, maxDepth=depth, seed=seed).fit(data)
    return dict(zip(cols, (float(v) for v in m.featureImportances.toArray())))


def eliminate(df: DataFrame, cols: Sequence[str], target: str, keep: int, **forest) -> list[tuple[str, int]]:
    """Drop the least important feature of a refitted forest until `keep` are left; (feature, rank), 1 = kept."""
    left, dropped = list(cols), []
    while len(left) > keep:
        imp = forest_importance(df, left, target, **forest)
        worst = min(left, key=lambda c: (imp[c], c))
        left.remove(worst)
        dropped.insert(0, worst)
    return [(c, 1) for c in left] + [(c, i + 2) for i, c in enumerate(dropped)]


def principal_components(df: DataFrame, cols: Sequence[str], k: int | float = 0.95) -> tuple[DataFrame, list[float]]:
    """Scores on the leading components of the centred columns; a fraction picks k by explained variance."""
    mean = scalar_row(df.agg(*[F.avg(c).alias(c) for c in cols]))
    centred = df.withColumns({f"_c_{c}": F.col(c) - mean[c] for c in cols})
    data = VectorAssembler(inputCols=[f"_c_{c}" for c in cols], outputCol="_v").transform(centred)
    full = PCA(k=len(cols), inputCol="_v", outputCol="_p").fit(data)
    ratios = [float(v) for v in full.explainedVariance.toArray()]
    if isinstance(k, float) and k < 1:
        total, n = 0.0, 0
        while n < len(ratios) and total < k - 1e-12:
            total += ratios[n]
            n += 1
    else:
        n = int(k)
    arr = vector_to_array("_p")
    out = full.transform(data).withColumns({f"pc_{i + 1}": arr[i] for i in range(n)})
    return out.drop("_v", "_p", *[f"_c_{c}" for c in cols]), ratios[:n]


def split(df: DataFrame, keys: Sequence[str], test: float = 0.2, validation: float = 0.1, seed: int = 42) -> DataFrame:
    """Column `part` in train, validation, test by a hash of the key: the same for any partitioning and engine."""
    u = portable_hash(keys, seed) / float(1 << 32)
    # The validation share is taken from the rows left after the test split.
    edge = test + (1 - test) * (validation / (1 - test))
    return df.withColumn("part", F.when(u < test, "test").when(u < edge, "validation").otherwise("train"))


def encode(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Categories as indices and 0/1 vectors, so that scaling meets numbers only."""
    idx = [f"{c}_index" for c in cols]
    df = StringIndexer(inputCols=list(cols), outputCols=idx, stringOrderType="alphabetAsc", handleInvalid="keep").fit(df).transform(df)
    return OneHotEncoder(inputCols=idx, outputCols=[f"{c}_onehot" for c in cols]).fit(df).transform(df)


def preprocess(df: DataFrame, key: str, target: str, categorical: Sequence[str] = (), features: dict = FEATURES, method: str = "standard") -> DataFrame:
    """Clean, engineer, split and scale: statistics come from the training rows only."""
    df = split(nan_to_null(df).dropDuplicates(), [key])
    train = df.filter("part = 'train'")
    nums = [c for c in numeric_columns(df) if c not in (key, target)]
    df = impute(df, nums, fit=train)
    df = engineer(df, features)
    nums = [c for c in numeric_columns(df) if c not in (key, target)]
    df = encode(df, categorical) if categorical else df
    df = durable(df)
    return scale(df, [c for c in nums if not c.endswith("_index")], method, fit=df.filter("part = 'train'"))
