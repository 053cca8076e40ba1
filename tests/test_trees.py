"""Forests and boosting on cells against MLlib on rows, and turned columns against plain Python."""

import uuid

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import functions as F

from gaugeworks.operators import learn as m
from gaugeworks.operators import quality as q
from gaugeworks.operators import trees


def made(spark, n=3000, nulls=False):
    rng = np.random.default_rng(3)
    a, b, c = rng.integers(1, 51, n).astype(float), rng.integers(0, 11, n) / 100, rng.normal(size=n)
    df = spark.createDataFrame(pd.DataFrame({"id": range(n), "a": a, "b": b, "c": c, "y": 40 * a - 300 * b + 5 * np.sin(c) + rng.normal(size=n)}))
    return df.withColumn("c", F.when(F.col("id") % 7 != 0, F.col("c"))) if nulls else df


def counted(spark, job):
    """Jobs that a call runs."""
    sc = spark.sparkContext
    group = uuid.uuid4().hex
    sc.setJobGroup(group, "counted")
    try:
        got = job()
        return got, len(sc.statusTracker().getJobIdsForGroup(group))
    finally:
        sc._jsc.clearJobGroup()


def test_boosting_on_cells_is_boosting_on_rows(spark):
    df = made(spark)
    got = m.fit(df, ["a", "b", "c"], "y", "gradient_boosting", trees=8)
    assert isinstance(got, trees.CellModel)
    x = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(df)
    want = GBTRegressor(labelCol="y", maxIter=8, seed=42).fit(x).transform(x).select("id", F.col("prediction").alias("want"))
    far = got.transform(df).join(want, "id").agg(F.max(F.abs(F.col("prediction") - F.col("want"))), F.count(F.lit(1))).first()
    assert far[0] < 1e-6 and far[1] == 3000


def test_forest_reads_rows_once_for_all_trees(spark):
    df = made(spark, nulls=True).cache()
    model, jobs = counted(spark, lambda: m.fit(df, ["a", "b", "c"], "y", "random_forest", trees=40))
    _, more = counted(spark, lambda: m.fit(df, ["a", "b", "c"], "y", "random_forest", trees=4))
    out = m.regression_metrics(model.transform(df), "y", "prediction").first()
    assert isinstance(model, trees.CellModel) and jobs <= more + 2 and out["n"] == df.filter("c is not null").count() and out["r2"] > 0.6
    with pytest.raises(ValueError):
        m.fit(df.withColumn("y", F.when(F.col("id") != 8, F.col("y"))), ["a", "b"], "y", "random_forest", trees=2)


def test_a_tree_without_draws_is_the_least_squares_cut():
    n, y = np.array([2.0, 3.0, 1.0, 4.0]), np.array([1.0, 1.5, 9.0, 9.5])
    feature, cut, value, _ = trees.grow(n, n * y, np.arange(4)[:, None], (4,), 1, np.random.default_rng(0))
    assert feature[0] == 0 and cut[0] == 1 and value[1] == pytest.approx(6.5 / 5) and value[2] == pytest.approx(47 / 5)


def test_stacking_and_search_leave_out_each_fold(spark):
    df = made(spark)
    out, jobs = counted(spark, lambda: m.stacking(df, "id", ["a", "b", "c"], "y", folds=3, trees=30))
    assert out.count() == 3000 and jobs < 80 and m.regression_metrics(out, "y", "prediction").first()["r2"] > 0.9
    # A feature that names the row tells nothing of rows left out.
    noise = df.select("id", F.col("id").cast("double").alias("a"), F.rand(5).alias("y")).cache()
    _, scores = m.cross_validated_search(noise, "id", ["a"], "y", {"numTrees": [5, 10], "maxDepth": [3, 5]}, folds=3)
    assert len(scores) == 4 and all(s < 0.02 for _, s in scores)
    model, scores = m.cross_validated_search(df, "id", ["a", "b", "c"], "y", {"numTrees": [5, 10], "maxDepth": [2, 5]}, folds=3)
    assert max(scores, key=lambda s: s[1])[0]["maxDepth"] == 5 and isinstance(model, trees.CellModel)


def test_elimination_fits_on_cells(spark, monkeypatch):
    monkeypatch.setattr(q, "RandomForestRegressor", None)
    assert q.eliminate(made(spark), ["a", "b", "c"], "y", 1, trees=30)[0] == ("a", 1)
    with pytest.raises(ValueError):
        q.eliminate(made(spark, nulls=True), ["a", "b", "c"], "y", 1, trees=2)


def test_many_features_stay_with_mllib(spark):
    df = made(spark, 400).withColumns({f"c{i}": F.col("c") * F.rand(i) for i in range(4)})
    assert not isinstance(m.fit(df, ["a", "c", "c0", "c1", "c2", "c3"], "y", "random_forest", trees=2), trees.CellModel)


@pytest.mark.parametrize("n", [1, 2, 37, 64])
def test_turned_columns_by_blocks(spark, n):
    from gaugeworks.functions.portable import portable_hash

    df = made(spark, n)
    model = m.fit(made(spark, 300), ["a", "b", "c"], "y")
    got = {r["feature"]: r for r in m.permutation_importance(df, "id", ["a", "b", "c"], "y", model, 4, block=8).collect()}
    x = [r.asDict() for r in df.withColumn("h", portable_hash(["id"])).orderBy("h", "id").collect()]
    w = dict(zip("abc", model.stages[-1].coefficients.toArray()))
    error = lambda row: (model.stages[-1].intercept + sum(w[c] * row[c] for c in "abc") - row["y"]) ** 2
    base = np.mean([error(r) for r in x])
    rise = {}
    for c, _, u in m.turns(["a", "b", "c"], 4):
        rise.setdefault(c, []).append(np.mean([error(r | {c: x[(p + 1 + int(u * (n - 1))) % n][c]}) for p, r in enumerate(x)]) - base)
    for c, v in rise.items():
        assert got[c]["importance"] == pytest.approx(np.mean(v), rel=1e-9, abs=1e-7) and got[c]["std"] == pytest.approx(np.std(v), rel=1e-9, abs=1e-7)


def test_turns_send_numbers_not_rows(spark):
    df = made(spark, 64)
    plan = m.permutation_importance(df, "id", ["a", "b", "c"], "y", m.fit(df, ["a", "b", "c"], "y"), 2, block=8)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate inline") < plan.index("Join") < plan.index("Generate explode")
