"""Operators without a reasonable SQL form, against brute force or known results on small fixtures."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gaugeworks.functions import portable
from gaugeworks.functions import stats
from gaugeworks.operators import aggregate as a
from gaugeworks.operators import anomaly as an
from gaugeworks.operators import density
from gaugeworks.operators import joins as j
from gaugeworks.operators import learn as m
from gaugeworks.operators import quality as q
from gaugeworks.operators import series as s


def test_student_t_tables():
    assert stats.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert stats.t_quantile(0.95, 1) == pytest.approx(6.313752, abs=1e-4)
    assert stats.t_two_sided(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert stats.grubbs_critical(10) == pytest.approx(2.290, abs=2e-3)


def test_trend_p_value(spark):
    df = spark.createDataFrame([(float(x), float(y)) for x, y in enumerate([1, 2, 1.5, 3.5, 3, 5])], "x double, y double")
    r = a.linear_trend(df, F.col("x"), F.col("y"), p_value=True).first()
    assert r["slope"] == pytest.approx(0.714286, abs=1e-5)
    # Tail of the t density with 4 degrees of freedom, 3/8 (1 + x^2/4)^(-5/2), by numerical integration.
    x = np.linspace(r["slope"] / r["stderr"], 2000, 4_000_001)
    tail = 2 * np.trapezoid(0.375 * (1 + x * x / 4) ** -2.5, x)
    assert r["p_value"] == pytest.approx(tail, rel=1e-3)


@pytest.mark.parametrize("rows", ["1000000", "20"])
def test_kendall_against_pairs(spark, rows):
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 12, 150), rng.integers(0, 9, 150)
    y = np.where(rng.random(150) < 0.4, x % 9, y)
    c = d = tx = ty = 0
    for i in range(150):
        for k in range(i):
            sx, sy = np.sign(x[i] - x[k]), np.sign(y[i] - y[k])
            c, d = c + (sx * sy > 0), d + (sx * sy < 0)
            tx, ty = tx + (sx == 0), ty + (sy == 0)
    n0 = 150 * 149 / 2
    spark.conf.set("spark.gaugeworks.groupRows", rows)
    got = a.kendall(spark.createDataFrame(pd.DataFrame({"x": x, "y": y})), "x", "y").first()["tau_b"]
    spark.conf.unset("spark.gaugeworks.groupRows")
    assert got == pytest.approx((c - d) / math.sqrt((n0 - tx) * (n0 - ty)))


def brute_dbscan(pts, eps, k):
    n = len(pts)
    near = [[j for j in range(n) if np.hypot(*(pts[i] - pts[j])) <= eps] for i in range(n)]
    core = [len(v) >= k for v in near]
    label = [-1] * n
    for i in range(n):
        if core[i] and label[i] == -1:
            stack, label[i] = [i], i
            while stack:
                for p in near[stack.pop()]:
                    if core[p] and label[p] == -1:
                        label[p] = i
                        stack.append(p)
    rim = {i: {label[p] for p in near[i] if core[p]} for i in range(n) if not core[i]}
    return label, core, rim


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_dbscan_against_search(spark, seed):
    rng = np.random.default_rng(seed)
    pts = np.vstack([rng.normal(0, 0.4, (80, 2)), rng.normal(3, 0.25, (60, 2)), rng.uniform(-2, 5, (50, 2)), np.repeat([[6.0, 6.0]], 7, axis=0)])
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(len(pts)), "x": pts[:, 0], "y": pts[:, 1]}))
    got = [r["cluster"] for r in density.dbscan(df, "id", ["x", "y"], 0.3, 5, scale=False).orderBy("id").collect()]
    label, core, rim = brute_dbscan(pts, 0.3, 5)
    names = {}
    for i, on in enumerate(core):
        if on:
            assert names.setdefault(label[i], got[i]) == got[i]
    assert len(set(names.values())) == len(names)
    for i, options in rim.items():
        assert got[i] in ({names[o] for o in options} or {-1})


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (200, 200)], "a long, b long")
    got = {r["node"]: r["root"] for r in m.components(edges).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[101] == 100 and got[200] == 200


@pytest.mark.parametrize("rows", ["1000000", "15"])
def test_pareto_front_against_pairs(spark, rows):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"id": range(80), "q": rng.integers(0, 30, 80), "p": rng.integers(0, 30, 80)})
    want = {r.id for r in pdf.itertuples() if not (((pdf.q >= r.q) & (pdf.p <= r.p)) & ((pdf.q > r.q) | (pdf.p < r.p))).any()}
    spark.conf.set("spark.gaugeworks.groupRows", rows)
    got = {r["id"] for r in j.pareto_front(spark.createDataFrame(pdf), "q", "p").collect()}
    spark.conf.unset("spark.gaugeworks.groupRows")
    assert got == want


def test_isolation_forest_ranks_planted_outliers_first(spark):
    rng = np.random.default_rng(2)
    x = np.vstack([rng.normal(0, 1, (500, 2)), [[9, 9], [-8, 7], [10, -9]]])
    df = spark.createDataFrame(pd.DataFrame({"id": range(503), "a": x[:, 0], "b": x[:, 1]}))
    got = an.isolation_forest(df, "id", ["a", "b"], trees=40)
    assert {r["id"] for r in got.orderBy(F.desc("score")).limit(3).collect()} == {500, 501, 502}
    assert 40 <= got.filter("anomaly").count() <= 51
    again = an.isolation_forest(df.repartition(7), "id", ["a", "b"], trees=40)
    assert [round(r["score"], 9) for r in again.orderBy("id").collect()] == [round(r["score"], 9) for r in got.orderBy("id").collect()]


def test_grubbs_flags_only_the_far_value(spark):
    df = spark.createDataFrame([(float(v),) for v in [10, 11, 9, 10, 12, 10, 11, 9, 10, 40]], "v double")
    assert [r["v"] for r in an.grubbs(df, "v").filter("anomaly").collect()] == [40.0]


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.9), (0, 0.8), (1, 0.8), (0, 0.1), (1, 0.4)], "t int, s double")
    pos, neg = [0.9, 0.8, 0.4], [0.8, 0.1]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert an.evaluate(df.withColumn("p", (F.col("s") > 0.5).cast("int")), "t", "p", "s").first()["auc"] == pytest.approx(want)


def test_spectrum_of_a_sine(spark):
    pdf = pd.DataFrame({"k": "a", "t": range(128), "v": np.sin(2 * np.pi * np.arange(128) / 16)})
    r = s.spectrum(spark.createDataFrame(pdf), ["k"], "t", "v").first()
    assert r["dominant_frequency"] == pytest.approx(1 / 16) and r["spectral_entropy"] == pytest.approx(1.0, abs=1e-6)


def test_ar_forecast_of_a_first_order_process(spark):
    rng = np.random.default_rng(4)
    x = [0.0]
    for _ in range(800):
        x.append(0.8 * x[-1] + rng.normal(0, 0.1))
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "t": range(len(x)), "v": x}))
    assert s.ar_coefficients(df, ["k"], ["t"], "v", 1).first()["phi"][0] == pytest.approx(0.8, abs=0.06)
    got = s.arima_forecast(df, ["k"], "t", "v", 6, max_q=0).orderBy("step").toPandas()
    assert len(got) == 6 and ((got["upper"] - got["lower"]).diff().dropna() >= -1e-12).all()


def test_holt_winters_follows_season_and_trend(spark):
    n = 96
    v = 10 + 0.5 * np.arange(n) + 5 * np.sin(2 * np.pi * np.arange(n) / 12)
    got = s.holt_winters(spark.createDataFrame(pd.DataFrame({"k": "a", "t": range(n), "v": v})), ["k"], "t", "v", 12, 12).orderBy("step").toPandas()
    want = 10 + 0.5 * np.arange(n, n + 12) + 5 * np.sin(2 * np.pi * np.arange(n, n + 12) / 12)
    assert np.abs(got["forecast"] - want).max() < 2.0


def test_scaling_has_zero_mean_unit_deviation_and_keeps_constants(spark):
    df = spark.createDataFrame([(float(i), 7.0) for i in range(20)], "x double, c double")
    r = q.scale(df, ["x", "c"]).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s"), F.max("c").alias("c")).first()
    assert r["m"] == pytest.approx(0) and r["s"] == pytest.approx(1) and r["c"] == 0


def test_split_is_complete_disjoint_and_stable(spark):
    df = spark.range(5000)
    one, two = q.split(df.repartition(1), ["id"]), q.split(df.repartition(7), ["id"])
    assert one.exceptAll(two).count() == 0
    share = {r["part"]: r["count"] / 5000 for r in one.groupBy("part").count().collect()}
    assert share["test"] == pytest.approx(0.2, abs=0.03) and share["validation"] == pytest.approx(0.1, abs=0.03) and sum(share.values()) == 1


def test_components_explain_variance(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=(300, 1))
    x = np.hstack([z, 2 * z, rng.normal(scale=0.01, size=(300, 1))])
    df = spark.createDataFrame(pd.DataFrame(x, columns=["a", "b", "c"]))
    out, ratios = q.principal_components(df, ["a", "b", "c"], 0.95)
    assert len(ratios) == 1 and ratios[0] > 0.99 and out.agg(F.avg("pc_1")).first()[0] == pytest.approx(0, abs=1e-9)
    err = an.reconstruction_error(df.limit(300).union(spark.createDataFrame([(5.0, -9.0, 0.0)], "a double, b double, c double")), ["a", "b", "c"], 2)
    assert err.orderBy(F.desc("error")).first()["b"] == -9.0


def test_elimination_keeps_the_driver_of_the_target(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 3))
    pdf = pd.DataFrame(x, columns=["a", "b", "c"]).assign(y=3 * x[:, 1])
    assert q.eliminate(spark.createDataFrame(pdf), ["a", "b", "c"], "y", 1, trees=5, depth=4)[0] == ("b", 1)


def test_quality_gate_raises(spark):
    df = spark.createDataFrame([(None,)] * 3 + [(1.0,)] * 10, "v double")
    with pytest.raises(ValueError):
        q.quality_gate(df, ["v"])
    assert q.quality_gate(df, ["v"], max_missing=0.5)["missing"] == 3


def test_regression_family_and_importance(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 2))
    df = spark.createDataFrame(pd.DataFrame({"id": range(600), "a": x[:, 0], "b": x[:, 1], "y": 4 * x[:, 0] + 0.5 * x[:, 1] + rng.normal(scale=0.1, size=600)})).cache()
    model = m.fit(df, ["a", "b"], "y")
    assert m.regression_metrics(model.transform(df), "y", "prediction").first()["r2"] > 0.99
    assert m.importances(model, ["a", "b"])[0][0] == "a" == m.importances(m.fit(df, ["a", "b"], "y", "random_forest", trees=5), ["a", "b"])[0][0]
    imp = {r["feature"]: r["importance"] for r in m.permutation_importance(df, "id", ["a", "b"], "y", model, 2).collect()}
    assert imp["a"] > imp["b"] > 0
    boot = {r["feature"]: r for r in m.bootstrap(df, "id", ["a", "b"], "y", 8).collect()}
    assert boot["a"]["lower"] - 0.1 < 4 < boot["a"]["upper"] + 0.1
    assert m.stacking(df, "id", ["a", "b"], "y", folds=2, trees=5).count() == 600
    _, scores = m.cross_validated_search(df, "id", ["a", "b"], "y", {"numTrees": [3], "maxDepth": [2, 5]}, folds=2)
    assert scores[1][1] > scores[0][1]


def test_monte_carlo_recovers_moments(spark):
    r = m.monte_carlo(spark.range(2000).select(F.col("id").alias("k"), F.lit(10.0).alias("p")), "k", {"p": 0.1}, lambda c: c["p"], (5, 10, 20)).first()
    assert r["mean"] == pytest.approx(10, abs=0.05) and r["std"] == pytest.approx(1, abs=0.05) and r["p_10"] == pytest.approx(0.5, abs=0.02)
    assert r["lower"] == pytest.approx(8.04, abs=0.1) and r["upper"] == pytest.approx(11.96, abs=0.1)


def test_prefixed_hashes_are_portable_hashes(spark):
    """Many rows at a time, of no, short and long keys; the bootstrap hashes each row's draws with them."""
    keys = [None, "", "a", "7-1-15519-785", "ü" * 20, "x" * 53, "y" * 54, "z" * 200]
    df = spark.createDataFrame([(i, k) for i, k in enumerate(keys)], "id int, k string")
    salts = [0, 9, 10, 99, 12345]
    rows = df.select("id", portable.hash_prefix(["k"]).cast("binary").alias("p"), *[portable.portable_hash(["k"], b, 10).alias(f"h{b}") for b in salts]).orderBy("id").collect()
    got = portable.prefixed_hashes([bytes(r.p) for r in rows], salts)
    assert got.tolist() == [[r[f"h{b}"] for b in salts] for r in rows]


def test_monte_carlo_deals_rows_of_one_file(spark):
    """Input of one partition is spread before it is multiplied, and scored once."""
    seen, real = [], m.durable
    m.durable = lambda df: seen.append(df.rdd.getNumPartitions()) or real(df)
    try:
        r = m.monte_carlo(spark.range(0, 500, 1, 1).select(F.col("id").alias("k"), F.lit(10.0).alias("p")), "k", {"p": 0.1}, lambda c: c["p"], (5,)).first()
    finally:
        m.durable = real
    assert r["draws"] == 5000 and seen[0] >= spark.sparkContext.defaultParallelism


def test_kmeans_finds_two_blobs(spark):
    rng = np.random.default_rng(0)
    pts = np.vstack([rng.normal(0, 0.2, (40, 2)), rng.normal(5, 0.2, (40, 2))])
    df = spark.createDataFrame([(i, [float(v) for v in p]) for i, p in enumerate(pts)], "id int, e array<double>").select("id", array_to_vector("e").alias("v"))
    best, scores = m.best_kmeans(df, "id", "v", range(2, 5))
    assert max(scores, key=scores.get) == 2 and best.select("cluster").distinct().count() == 2


@pytest.mark.parametrize("rows", ["1000000", "10"])
def test_nearest_imputation_takes_the_closest_known_positions(spark, rows):
    rng = np.random.default_rng(9)
    pdf = pd.DataFrame({"id": range(60), "b": np.where(np.arange(60) % 3, "x", "y"), "at": rng.permutation(60).astype(float), "v": rng.normal(size=60)})
    hole = pdf["id"] % 4 == 0
    df = spark.createDataFrame(pdf.assign(v=np.where(hole, np.nan, pdf["v"])))
    spark.conf.set("spark.gaugeworks.groupRows", rows)
    got = q.impute_nearest(q.nan_to_null(df), "id", ["b"], "v", "at", 3).toPandas().set_index("id")["v"]
    spark.conf.unset("spark.gaugeworks.groupRows")
    for r in pdf[hole].itertuples():
        known = pdf[~hole & (pdf["b"] == r.b)]
        near = known.assign(d=(known["at"] - r.at).abs()).sort_values(["d", "at"]).head(3)
        assert got[r.id] == pytest.approx(near["v"].mean())


def test_edge_rows(spark):
    empty = spark.createDataFrame([], "v double")
    one = spark.createDataFrame([(3.0,)], "v double")
    nulls = spark.createDataFrame([(None,), (None,)], "v double")
    assert a.describe(one, "v").first()["std"] == 0.0 and a.describe(one, "v").first()["mode"] is None
    assert a.describe(nulls, "v").count() in (0, 1)
    assert an.z_score(one, "v").first()["anomaly"] is False
    assert an.z_score(empty, "v").count() == 0
    assert a.histogram(one, "v", 5).agg(F.sum("n")).first()[0] == 1
    clean = q.nan_to_null(spark.createDataFrame([(float("nan"),), (1.0,)], "v double"))
    assert clean.filter("v is null").count() == 1


def test_comprehensive_run_agrees_on_a_planted_row(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(50, 5, 300)
    x[100] = 500
    df = spark.createDataFrame(pd.DataFrame({"id": range(300), "x": x, "y": rng.normal(0, 1, 300)}))
    got = an.comprehensive(df, "id", ["x", "y"], [], ["id"], [an.Rule("surge", "critical", "x", "max", 200)], 30)
    row = got.filter("id = 100").first()
    assert row["votes"] == 4 and row["consensus"] and got.filter("consensus").count() < 30


def test_searches_and_permutations_run_in_full(monkeypatch):
    """The registered grid search takes all points and 5 folds, the permutation importance 10 repeats."""
    import inspect

    from gaugeworks.operators import learn
    from gaugeworks.plans import learning

    for name, query, want in (("cross_validated_search", learning.grid, {"folds": 5, "draws": None}), ("permutation_importance", learning.permutation, {"repeats": 10})):
        kind, asked = inspect.signature(getattr(learn, name)), {}

        def stop(*a, **k):
            b = kind.bind(*a, **k)
            b.apply_defaults()
            asked.update(b.arguments)
            raise InterruptedError

        monkeypatch.setattr(learn, name, stop)
        for f in ("spread", "facts"):
            monkeypatch.setattr(learning, f, lambda *a: None)
        monkeypatch.setattr(learn, "fit", lambda *a, **k: None)
        try:
            query(None)
        except InterruptedError:
            pass
        assert {k: asked[k] for k in want} == want


def test_consensus_takes_the_whole_part_of_half(spark):
    """Two votes are enough for two to five methods, three for six."""
    rows = [(i, *[j < i for j in range(6)]) for i in range(7)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"f{j} boolean" for j in range(6)))
    for n, need in ((2, 2), (3, 2), (4, 2), (5, 2), (6, 3)):
        got = an.consensus(df, [f"f{j}" for j in range(n)])
        assert {r.id for r in got.filter("consensus").collect()} == set(range(need, 7))


def test_modes_of_several_columns_and_types(spark):
    rows = [(1, "b", None, 2.5, None), (2, "a", 3, None, None), (3, None, 3, 2.5, None), (4, "a", None, 1.0, None), (5, "b", 4, None, None), (6, None, 4, 1.0, None)]
    df = spark.createDataFrame(rows, "id int, s string, n int, x double, none string")
    got = [tuple(r) for r in q.impute_mode(df, ["s", "n", "x", "none"]).orderBy("id").collect()]
    fill = {1: "a", 2: 3, 3: 1.0, 4: None}  # every mode is a tie, or there is none
    assert got == [tuple(v if v is not None else fill[k] for k, v in enumerate(r)) for r in rows]
    assert q.impute_mode(df.limit(0), ["s", "n"]).collect() == []
    alone = q.impute_mode(df, ["none"]).collect()
    assert {r["none"] for r in alone} == {None}
