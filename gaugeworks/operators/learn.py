"""Clustering, regression, evaluation and what-if studies on MLlib and DataFrame plans."""

from __future__ import annotations

import hashlib
import math
import random
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml import Model, Pipeline
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import ClusteringEvaluator, RegressionEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame, functions as F

from gaugeworks.functions.portable import hash_prefix, portable_hash, prefixed_hashes
from gaugeworks.operators.aggregate import rows
from gaugeworks.operators import trees as grown
from gaugeworks.operators.ordered import position, quantile, quantiles
from gaugeworks.session import broadcast_if_small, durable, match, scalar_row, spread

# --- clustering -------------------------------------------------------------------------------------


def best_kmeans(df: DataFrame, key: str, vector: str, ks: Sequence[int] = range(2, 11), seed: int = 42, starts: int = 3, scaled: bool = True) -> tuple[DataFrame, dict[int, float]]:
    """K-means for each k on standardised features; the clustering with the best silhouette, and all silhouettes.

    Each k is fitted from `starts` seeds and keeps the fit with the smallest cost. The cluster goes by the scaled
    features, the rows come back with their own columns.
    """
    data = spread(df, key)
    at = vector
    if scaled:
        at = "_scaled"
        data = durable(StandardScaler(withMean=True, inputCol=vector, outputCol=at).fit(data).transform(data))
    judge = ClusteringEvaluator(featuresCol=at, predictionCol="cluster")
    scores, best = {}, None
    for k in ks:
        fits = [KMeans(k=k, seed=seed + s, featuresCol=at, predictionCol="cluster").fit(data) for s in range(starts)]
        out = min(fits, key=lambda m: m.summary.trainingCost).transform(data)
        scores[k] = judge.evaluate(out)
        if best is None or scores[k] > scores[best[0]]:
            best = (k, out)
    return best[1].drop("_scaled"), scores


def cluster_summary(df: DataFrame, cluster: str, cols: Sequence[str]) -> DataFrame:
    total = scalar_row(df.agg(rows().alias("n")))
    g = df.groupBy(cluster).agg(rows().alias("size"), *[f(c).alias(f"{c}_{n}") for c in cols for n, f in (("mean", F.avg), ("std", F.stddev_samp))])
    return g.withColumn("percent", F.col("size") * 100.0 / total["n"])


def components(edges: DataFrame) -> DataFrame:
    """Smallest reachable node per node of an undirected graph (columns a, b): rows (node, root).

    Each round takes the smallest root among neighbours and then the root of that root, so the number of
    rounds grows with the logarithm of the longest chain. Lineage is cut by a checkpoint per round.
    """
    both = durable(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    state = durable(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"))
    while True:
        near = both.join(state, both["b"] == state["node"]).groupBy("a").agg(F.min("root").alias("_near"))
        step = state.join(near, state["node"] == near["a"], "left").select("node", "root", F.least("root", F.coalesce("_near", "root")).alias("_new"))
        hop = state.select(F.col("node").alias("_new"), F.col("root").alias("_hop"))
        new = durable(step.join(hop, "_new", "left").select("node", "root", F.least("_new", F.coalesce("_hop", "_new")).alias("_next")))
        moved = new.filter("_next <> root").limit(1).count()
        state = new.select("node", F.col("_next").alias("root"))
        if not moved:
            return state


# --- regression -------------------------------------------------------------------------------------


def regressors(features: str, label: str, seed: int = 42, trees: int = 100) -> dict:
    """The model family: least squares, ridge, lasso, forest, boosting."""
    return {
        "linear": LinearRegression(featuresCol=features, labelCol=label, solver="normal"),
        "ridge": LinearRegression(featuresCol=features, labelCol=label, regParam=1.0, elasticNetParam=0.0),
        "lasso": LinearRegression(featuresCol=features, labelCol=label, regParam=1.0, elasticNetParam=1.0),
        "random_forest": RandomForestRegressor(featuresCol=features, labelCol=label, numTrees=trees, seed=seed),
        "gradient_boosting": GBTRegressor(featuresCol=features, labelCol=label, maxIter=trees, seed=seed),
    }


def assemble(df: DataFrame, cols: Sequence[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(cols), outputCol=out, handleInvalid="skip").transform(df)


def fit(df: DataFrame, cols: Sequence[str], label: str, kind: str = "linear", **options) -> Model | grown.CellModel:
    """A fitted model of the family. Trees are fitted on cells of binned features unless these are too many."""
    many = {"trees": 100} | options
    if kind == "random_forest" and (got := grown.forests(df, cols, label, **many)):
        return got[0].model()
    if kind == "gradient_boosting" and (got := grown.boosted(df, cols, label, **many)):
        return got
    est = regressors("features", label, **options)[kind]
    return Pipeline(stages=[VectorAssembler(inputCols=list(cols), outputCol="features", handleInvalid="skip"), est]).fit(df)


def regression_metrics(df: DataFrame, truth: str, predicted: str, keys: Sequence[str] = ()) -> DataFrame:
    """Errors of predictions in one aggregate, written as its row counts tell how to take the median error, an exact quantile."""
    keys = list(keys)
    y, p = F.col(truth), F.col(predicted)
    e = p - y
    work = df.select(*keys, y.alias("_y"), F.abs(e).alias("_abs"), (e * e).alias("_sq"))
    out = durable(work.groupBy(*keys).agg(
        rows().alias("n"), F.avg("_sq").alias("mse"), F.sqrt(F.avg("_sq")).alias("rmse"), F.avg("_abs").alias("mae"),
        (1 - F.try_divide(F.sum("_sq"), F.regr_syy("_y", "_y"))).alias("r2"), (F.avg(F.when(F.col("_y") != 0, F.col("_abs") / F.abs("_y"))) * 100).alias("mape"),
        (F.avg(F.col("_abs") / F.greatest(F.abs("_y"), F.lit(1e-8))) * 100).alias("mape_guarded"), F.max("_abs").alias("max_error")))
    med = quantile(work, keys, "_abs", 0.5, "median_error", out.agg(F.max("n")).first()[0] or 0)
    return match(out, med, keys, "left") if keys else out.withColumn("median_error", scalar_row(med)["median_error"])


def physics_evaluation(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Agreement on breakeven (1) and ignition (10) and shares of implausible predictions."""
    y, p = F.col(truth), F.col(predicted)
    share = lambda c: F.avg(c.cast("double"))
    out = df.agg(
        share((y >= 1) == (p >= 1)).alias("breakeven_agreement"), share((y >= 10) == (p >= 10)).alias("ignition_agreement"), share((p < 0) | (p > 100)).alias("implausible_share"),
        F.count_if(p < 0).alias("negative"), F.count_if(p > 50).alias("above_50"), rows().alias("n"))
    return out.withColumn("realism", 1 - F.try_divide(F.col("negative") + F.col("above_50"), "n"))


def residual_summary(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    e = df.select((F.col(truth) - F.col(predicted)).alias("e"), F.abs(F.col(truth) - F.col(predicted)).alias("a"))
    p95 = scalar_row(quantiles(e, [], ["a"], [0.95]))["q_a"][0]
    return e.agg(F.avg("e").alias("mean"), F.stddev_samp("e").alias("std"), F.avg("a").alias("mae"), F.max("a").alias("max")).withColumn("p95", p95)


def train_all(train: DataFrame, valid: DataFrame, cols: Sequence[str], label: str, **options) -> dict[str, Model]:
    return {kind: fit(train, cols, label, kind, **options) for kind in regressors("features", label)}


def compare(models: dict[str, Model], parts: dict[str, DataFrame], label: str, cols: Sequence[str]) -> DataFrame:
    """Metrics per model and data part, long: every model predicts in one scan of a part, all errors are one aggregate."""
    made = []
    for part, df in parts.items():
        df = df.select(label, *[c for c in cols if c != label])
        for kind, m in models.items():
            df = m.transform(df).withColumnRenamed("prediction", f"p_{kind}").drop("features")
        each = F.explode(F.array(*[F.struct(F.lit(kind).alias("model"), F.col(f"p_{kind}").alias("prediction")) for kind in models]))
        made.append(df.select(label, F.lit(part).alias("part"), each.alias("e")).select("part", "e.model", label, "e.prediction"))
    return regression_metrics(reduce(DataFrame.unionByName, made), label, "prediction", ["model", "part"])


def hashed_folds(df: DataFrame, keys: Sequence[str], k: int = 5, seed: int = 42) -> DataFrame:
    return df.withColumn("fold", F.pmod(portable_hash(keys, seed), F.lit(k)).cast("int"))


def weighted_vote(df: DataFrame, predictions: dict[str, float]) -> Column:
    """Mean of prediction columns weighted by max(0, R2); equal weights when none is positive."""
    w = {c: max(0.0, v) for c, v in predictions.items()}
    if sum(w.values()) == 0:
        w = {c: 1.0 for c in w}
    total = sum(w.values())
    return reduce(lambda a, b: a + b, [F.col(c) * (v / total) for c, v in w.items()])


def stacking(df: DataFrame, key: str, cols: Sequence[str], label: str, kinds: Sequence[str] = ("linear", "random_forest"), folds: int = 3, **options) -> DataFrame:
    """Ridge regression on predictions made for each fold by models that have not seen it."""
    data = spread(hashed_folds(df, [key], folds), key)
    forests = grown.forests(data, cols, label, **({"trees": 100} | options), fold="fold", folds=folds) if "random_forest" in kinds else None
    made = []
    for f in range(folds):
        train, test = data.filter(F.col("fold") != f), data.filter(F.col("fold") == f)
        part = test
        for kind in kinds:
            model = forests[f].model() if kind == "random_forest" and forests else fit(train, cols, label, kind, **options)
            part = model.transform(part).withColumnRenamed("prediction", f"p_{kind}").drop("features")
        made.append(part)
    oof = durable(reduce(DataFrame.unionByName, made))
    meta = fit(oof, [f"p_{k}" for k in kinds], label, "ridge")
    return meta.transform(oof).drop("features")


def _errors(metric: str, y: Column, p: Column) -> Column:
    """The metrics of `RegressionEvaluator` as aggregates."""
    e = y - p
    return {
        "r2": 1 - F.try_divide(F.sum(e * e), F.regr_syy(y, y)), "mse": F.avg(e * e), "rmse": F.sqrt(F.avg(e * e)), "mae": F.avg(F.abs(e)),
        "var": F.avg(p * p) - 2 * F.avg(y) * F.avg(p) + F.avg(y) * F.avg(y),
    }[metric]


def cross_validated_search(df: DataFrame, key: str, cols: Sequence[str], label: str, grid: dict[str, Sequence], folds: int = 5, metric: str = "r2", seed: int = 42, draws: int | None = None) -> tuple[Model | grown.CellModel, list[tuple[dict, float]]]:
    """Grid search over a forest, or `draws` seeded grid points for a random search; folds are hashes of the key.

    Numbers of trees and depths share one scan: the largest forest is grown for every fold left out, and a point of the grid is its
    first trees, cut off at its depth. Other parameters are searched by MLlib's cross-validator.
    """
    est = RandomForestRegressor(featuresCol="features", labelCol=label, seed=seed)
    b = ParamGridBuilder()
    for name, values in grid.items():
        b = b.addGrid(est.getParam(name), list(values))
    maps = b.build()
    if draws is not None and draws < len(maps):
        maps = random.Random(seed).sample(maps, draws)
    points = [{p.name: v for p, v in pm.items()} for pm in maps]
    data = spread(hashed_folds(df.dropna(subset=list(cols)), [key], folds, seed), key)
    judge = RegressionEvaluator(labelCol=label, metricName=metric)
    most = {"trees": max(p.get("numTrees", 20) for p in points), "depth": max(p.get("maxDepth", 5) for p in points)}
    forests = grown.forests(data, cols, label, **most, seed=seed, fold="fold", folds=folds) if {"numTrees", "maxDepth"} >= set(grid) else None
    if forests is None:
        cv = CrossValidator(estimator=est, estimatorParamMaps=maps, evaluator=judge, numFolds=folds, foldCol="fold", seed=seed, parallelism=4)
        m = cv.fit(assemble(data, cols))
        return m, list(zip(points, map(float, m.avgMetrics)))
    made = []
    for f in range(folds):
        part = data.filter(F.col("fold") == f).select("fold", F.col(label).alias("_y"), *cols)
        for i, p in enumerate(points):
            part = forests[f].model(p.get("numTrees", 20), p.get("maxDepth", 5)).transform(part).withColumnRenamed("prediction", f"_p{i}")
        made.append(part.agg(*[_errors(metric, F.col("_y"), F.col(f"_p{i}")).alias(f"s{i}") for i in range(len(points))]))
    each = reduce(DataFrame.unionByName, made).collect()
    scores = [float(np.mean([r[i] for r in each])) for i in range(len(points))]
    best = points[int(np.argmax(scores) if judge.isLargerBetter() else np.argmin(scores))]
    return forests[-1].model(best.get("numTrees", 20), best.get("maxDepth", 5)), list(zip(points, scores))


def cross_validation(df: DataFrame, key: str, cols: Sequence[str], label: str, kind: str = "linear", folds: int = 5, **options) -> DataFrame:
    """Held-out metrics per hashed fold."""
    data = spread(hashed_folds(df, [key], folds), key)
    made = []
    for f in range(folds):
        m = fit(data.filter(F.col("fold") != f), cols, label, kind, **options)
        made.append(m.transform(data.filter(F.col("fold") == f)).select("fold", F.col(label).alias("y"), "prediction"))
    return regression_metrics(durable(reduce(DataFrame.unionByName, made)), "y", "prediction", ["fold"])


def learning_curve(df: DataFrame, key: str, cols: Sequence[str], label: str, kind: str = "linear", sizes: int = 10) -> DataFrame:
    """Error on the held-out fold for growing hashed shares of the training rows."""
    data = spread(hashed_folds(df, [key]).withColumn("_u", F.pmod(portable_hash([key], 7), F.lit(1000)) / 1000), key)
    test, train = data.filter("fold = 0"), data.filter("fold <> 0")
    made = []
    for i in range(1, sizes + 1):
        part = train.filter(F.col("_u") < i / sizes)
        made.append(fit(part, cols, label, kind).transform(test).select(F.lit(i / sizes).alias("share"), F.col(label).alias("y"), "prediction"))
    return regression_metrics(durable(reduce(DataFrame.unionByName, made)), "y", "prediction", ["share"])


# Poisson(1) distribution function at 0, 1, 2, ...
_POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(8)]


def uniform(keys: Sequence[str], salt: Column | int) -> Column:
    """A number in (0, 1) from the row key: the same in every attempt of a task."""
    return (portable_hash(keys, salt, 10) + 0.5) / float(1 << 40)


def bootstrap(df: DataFrame, key: str, cols: Sequence[str], label: str, replicates: int = 100) -> DataFrame:
    """Coefficients of weighted least-squares refits, weights drawn from Poisson(1) per row; mean, spread, 95% interval.

    One scan serves all replicates: every task adds up, for each replicate, the weighted sums of products of its rows, so a
    (replicate, sums) row per task is shuffled and each replicate's normal equations are solved on their own. The draws are
    those of `uniform`, hashed for many rows at a time.
    """
    width = len(cols) + 2
    numbers = F.array(F.lit(1.0), *[F.col(c).cast("double") for c in cols], F.col(label).cast("double"))
    data = df.select(key, label, *cols).dropna(subset=[label, *cols])
    rows_in = data.select(numbers.alias("x"), hash_prefix([key]).cast("binary").alias("k"))

    def sums(batches):
        total = np.zeros((replicates, width * width))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            u = (prefixed_hashes(batch.column("k").to_pylist(), range(replicates)) + 0.5) / float(1 << 40)
            w = np.searchsorted(_POISSON, u).astype(float)
            total += w.T @ (x[:, :, None] * x[:, None, :]).reshape(len(x), -1)
        yield pa.RecordBatch.from_pydict({"replicate": pa.array(range(replicates), pa.int32()), "g": pa.array(total.tolist(), pa.list_(pa.float64()))})

    part = rows_in.mapInArrow(sums, "replicate int, g array<double>")
    cells = part.select("replicate", F.posexplode("g").alias("i", "v")).groupBy("replicate", "i").agg(F.sum("v").alias("v"))
    whole = cells.groupBy("replicate").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda c: c["v"]).alias("g"))

    @F.pandas_udf("array<double>")
    def solve(g: pd.Series) -> pd.Series:
        out = []
        for v in g:
            a = np.array(v).reshape(width, width)
            mean = a[0, 1:] / max(a[0, 0], 1.0)
            centred = a[1:, 1:] - a[0, 0] * np.outer(mean, mean)
            out.append((np.linalg.pinv(centred[:-1, :-1], hermitian=True) @ centred[:-1, -1]).tolist())
        return pd.Series(out)

    names = F.array(*[F.lit(c) for c in cols])
    long = whole.select(F.explode(F.arrays_zip(names.alias("feature"), solve("g").alias("coefficient"))).alias("c")).select("c.*").toDF("feature", "coefficient")
    return long.groupBy("feature").agg(F.avg("coefficient").alias("mean"), F.stddev_pop("coefficient").alias("std"), F.percentile("coefficient", [0.025, 0.975]).alias("q")).select("feature", "mean", "std", F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def turns(cols: Sequence[str], repeats: int) -> list[tuple[str, int, float]]:
    """(feature, repeat, share): how far each repeat turns a feature's values, as a share of all rows."""
    return [(c, r, int(hashlib.md5(f"{c}|{r}".encode()).hexdigest()[:10], 16) / (1 << 40)) for c in cols for r in range(repeats)]


# Rows of a block of `permutation_importance`.
BLOCK = 2048


def permutation_importance(df: DataFrame, key: str, cols: Sequence[str], label: str, model: Model, repeats: int = 10, block: int = BLOCK) -> DataFrame:
    """Rise of the squared error when one column is dealt out again.

    Rows are put in hashed order once; each repeat turns a feature's values by some places along it, so a row's partner is
    found by its place. Rows are packed in blocks of places, and a turn sends slices of the one column it deals out to the
    blocks of the partners: for a row, one number a turn, not a row. All turns are one join, one scoring and one aggregate.
    """
    placed = position(df.select(key, *cols, label).withColumn("_h", portable_hash([key])), [], ["_h", key], "_p")
    placed = durable(placed.select((F.col("_p") - 1).alias("_p"), *cols, label))
    n = scalar_row(placed.agg(rows().alias("n")))["n"]
    error = F.pow(F.col("prediction") - F.col(label), 2)
    base = scalar_row(model.transform(placed).agg(F.avg(error).alias("mse")))["mse"]
    names = [f"_{i}" for i in range(len(cols))]
    held = F.array_sort(F.collect_list(F.struct("_p", *[F.col(c).alias(a) for c, a in zip([*cols, label], [*names, "_y"])])))
    blocks = placed.withColumn("_b", F.expr(f"_p div {block}")).groupBy("_b").agg(held.alias("_h"), rows().alias("_n"))
    blocks = blocks.select("_b", "_n", *[F.col(f"_h.{a}").alias(a) for a in [*names, "_y"]])
    plan = F.explode(F.array(*[F.struct(F.lit(cols.index(c)).alias("c"), F.lit(r).alias("r"), F.lit(u).alias("u")) for c, r, u in turns(cols, repeats)])).alias("_t")
    # A block's values go to the places from `_a` on, with a new slice at each first place of a block.
    moved = blocks.withColumn("_all", n).select("_b", "_n", "_all", F.array(*[F.col(a).cast("array<double>") for a in names]).alias("_v"), plan)
    moved = moved.withColumn("_a", F.expr(f"pmod(_b * {block} - 1 - floor(_t.u * (_all - 1)), _all)"))
    cut = F.expr(f"array_sort(array_distinct(filter(array(0L, {block} - _a % {block}, _all - _a), i -> i < _n)))")
    moved = moved.withColumn("_cut", cut).select("*", F.posexplode("_cut").alias("_i", "_from"))
    moved = moved.withColumns({"_to": F.coalesce(F.get("_cut", F.col("_i") + 1), "_n"), "_place": (F.col("_a") + F.col("_from")) % F.col("_all")})
    slices = moved.select(
        F.expr(f"_place div {block}").alias("_b"), (F.col("_place") % block).cast("int").alias("_at"), F.col("_t.c").alias("_c"), F.col("_t.r").alias("_r"),
        F.slice(F.get("_v", F.col("_t.c")), (F.col("_from") + 1).cast("int"), (F.col("_to") - F.col("_from")).cast("int")).alias("_new"))
    pairs = slices.join(blocks.hint("shuffle_hash"), "_b")
    own = [F.slice(a, F.col("_at") + 1, F.size("_new")).alias(a) for a in [*names, "_y"]]
    each = pairs.select("_c", "_r", F.inline(F.arrays_zip(*own, F.col("_new"))))
    mixed = each.select("_c", "_r", F.col("_y").alias(label), *[F.when(F.col("_c") == i, F.col("_new")).otherwise(F.col(a)).alias(c) for i, (c, a) in enumerate(zip(cols, names))])
    rise = model.transform(mixed).groupBy("_c", "_r").agg((F.avg(error) - base).alias("rise"))
    return rise.groupBy(F.get(F.array(*[F.lit(c) for c in cols]), F.col("_c")).alias("feature")).agg(F.avg("rise").alias("importance"), F.stddev_pop("rise").alias("std"))


def importances(model: Model, cols: Sequence[str]) -> list[tuple[str, float]]:
    """Tree importances, or absolute coefficients as shares of their sum, of a fitted regression."""
    last = model.stages[-1] if hasattr(model, "stages") else model
    raw = last.featureImportances.toArray() if hasattr(last, "featureImportances") else abs(last.coefficients.toArray())
    total = float(raw.sum()) or 1.0
    return sorted(((c, float(v) / total) for c, v in zip(cols, raw)), key=lambda p: (-p[1], p[0]))


def normalized_importance(df: DataFrame, feature: str, value: str) -> DataFrame:
    """Absolute values as shares of their sum."""
    total = scalar_row(df.agg(F.sum(F.abs(value)).alias("t")))
    return df.withColumn("importance", F.try_divide(F.abs(value), total["t"]))


def grouped_importance(df: DataFrame, feature: str, value: str, groups: DataFrame) -> DataFrame:
    """Mean importance per group of features; `groups` is a rule table (feature, group)."""
    return df.join(broadcast_if_small(groups), feature).groupBy("group").agg(F.avg(value).alias("importance"), rows().alias("features"))


# --- what-if ----------------------------------------------------------------------------------------


def sensitivity(df: DataFrame, params: Sequence[str], scorer: Callable[[dict[str, Column]], Column], step: float = 0.1) -> DataFrame:
    """Relative effect of each parameter moved up and down by `step`, per row, in percent."""
    base = {p: F.col(p) for p in params}
    q0 = scorer(base)
    cells = []
    for p in params:
        up, down = scorer({**base, p: F.col(p) * (1 + step)}), scorer({**base, p: F.col(p) * (1 - step)})
        cells.append(F.struct(F.lit(p).alias("parameter"), (F.try_divide(up - down, 2 * step * q0) * 100).alias("sensitivity")))
    return df.withColumn("_s", F.explode(F.array(*cells))).select(*df.columns, "_s.*")


def normal(keys: Sequence[str], salt: int) -> Column:
    """A standard normal number from the row key (Box-Muller on two hashed uniforms)."""
    return F.sqrt(-2 * F.ln(uniform(keys, 2 * salt))) * F.cos(2 * math.pi * uniform(keys, 2 * salt + 1))


def monte_carlo(rows_in: DataFrame, key: str, percent: dict[str, float], scorer: Callable[[dict[str, Column]], Column], thresholds: Sequence[float] = (1, 5, 10), draws: int = 10) -> DataFrame:
    """Spread of a score when the parameters of every row vary normally around the row's own values.

    Each row gives `draws` draws; a draw is a hash of the row's key and its number, so it needs no order and no seed. Rows are
    dealt over all tasks first, as a few bytes of input make many draws, and scores are written once.
    """
    dealt = rows_in.select(key, *percent).repartition(4 * rows_in.sparkSession.sparkContext.defaultParallelism, key)
    drawn = dealt.select(key, *percent, F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("_draw"))
    moved = {p: F.greatest(F.col(p) * 0.1, F.col(p) + F.col(p) * share * normal([key, "_draw"], i)) for i, (p, share) in enumerate(percent.items())}
    scored = durable(drawn.select(scorer(moved).alias("q")))
    ci = scalar_row(quantiles(scored, [], ["q"], [0.025, 0.975]))["q_q"]
    out = scored.agg(rows().alias("draws"), F.avg("q").alias("mean"), F.stddev_pop("q").alias("std"), *[F.avg((F.col("q") >= v).cast("double")).alias(f"p_{v}") for v in thresholds])
    return out.withColumns({"cv": F.try_divide("std", "mean"), "lower": ci[0], "upper": ci[1]})
