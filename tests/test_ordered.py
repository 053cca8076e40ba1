"""Ordered primitives: the split path must equal the plain one, also with a hot key and tied times."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from gaugeworks import session
from gaugeworks.operators import aggregate, filters, reports
from gaugeworks.operators import learn
from gaugeworks.operators import ordered as o
from gaugeworks.operators import windows as w


@pytest.fixture(scope="module")
def data():
    """900 rows: one key holds 60%, a third of all rows share one time."""
    rng = np.random.default_rng(3)
    n = 900
    t = rng.integers(0, 5000, n) * 1_000_000
    t[rng.random(n) < 0.33] = 2_500_000_000
    return pd.DataFrame({"key": np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", None], n)), "t": t, "id": np.arange(n), "v": np.round(rng.normal(50, 20, n), 3)})


@pytest.fixture(scope="module")
def df(spark, data):
    holes = data.assign(v=np.where(data["id"] % 4 == 0, np.nan, data["v"]))
    return spark.createDataFrame(holes).withColumn("v", F.when(~F.isnan("v"), F.col("v"))).cache()


def same(a, b, on="id"):
    a, b = a.toPandas().sort_values(on).reset_index(drop=True), b.toPandas().sort_values(on).reset_index(drop=True)
    pd.testing.assert_frame_equal(a[sorted(a)], b[sorted(b)], check_exact=False, rtol=1e-9)


@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("keys", [[], ["key"]])
def test_running_split_equals_plain(df, keys, desc):
    specs = {"s": ("sum", F.col("v")), "n": ("count", F.col("v")), "hi": ("max", F.col("v")), "lo": ("min", F.col("v")), "l": ("last", F.col("v")), "f": ("first", F.col("v"))}
    same(o.running(df, keys, ["t", "id"], specs, desc), o.running(df, keys, ["t", "id"], specs, desc, rows=40))


def test_ranges_are_bounded_despite_ties(df):
    seg = o.cut_ranges(df, ["t", "id"], 40)
    assert seg.groupBy("_seg").count().agg(F.max("count")).first()[0] <= 100
    pdf = seg.toPandas().sort_values(["t", "id"])
    assert pdf["_seg"].is_monotonic_increasing


def test_framed_split_equals_plain(df):
    build = lambda win: {"prev": F.lag("id", 3).over(win), "nxt": F.lead("id", 2).over(win), "m": F.avg("v").over(win.rowsBetween(-5, 2))}
    same(o.framed(df, ["key"], ["t", "id"], 5, 2, build), o.framed(df, ["key"], ["t", "id"], 5, 2, build, rows=30))


@pytest.mark.parametrize("rows", [None, 25])
def test_quantiles_match_numpy(df, data, rows):
    got = {r["key"]: r["q_v"] for r in o.quantiles(df, ["key"], ["v"], [0, 0.25, 0.5, 0.9, 1], rows).collect()}
    live = data[data["id"] % 4 != 0]
    assert None in got
    for k, g in live.groupby("key"):
        assert np.allclose(got[k], np.quantile(g["v"], [0, 0.25, 0.5, 0.9, 1]))


def test_split_quantiles_compute_their_input_twice(spark):
    """Once to measure the groups and once for the distinct values, however many passes the ranks take."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    df = spark.range(500).select(F.lit("k").alias("key"), F.col("id").cast("double").alias("v")).mapInPandas(count, "key string, v double")
    assert o.quantiles(df, ["key"], ["v"], [0.5], 50).first()["q_v"] == [249.5]
    assert seen.value <= 1000


@pytest.mark.parametrize("keys, p", [([], 0.25), (["key"], 0.5), (["key"], 1)])
def test_narrowed_quantile_equals_plain(spark, keys, p):
    """Normal, tied, nearly equal, far apart, smallest, infinite and no numbers."""
    rng = np.random.default_rng(1)
    n = 900
    made = {
        "normal": rng.normal(size=n), "ties": rng.integers(-2, 3, n), "near": 1000 + rng.random(n) * 1e-9, "far": rng.normal(size=n) * 10.0 ** rng.integers(-300, 300, n), "least": rng.integers(-3, 4, n) * 5e-324,
        "ends": np.select([rng.random(n) < 0.3, rng.random(n) < 0.5, rng.random(n) < 0.2], [np.inf, -np.inf, np.nan], rng.normal(size=n))}
    key = np.where(rng.random(n) < 0.6, "hot", rng.choice(["a", "b", None], n))
    df = spark.createDataFrame([(k, *map(float, v)) for k, *v in zip(key.tolist(), *made.values())], "key string, " + ", ".join(f"{c} double" for c in made)).cache()
    for c in made:
        want, got = ({r[:-1]: r[-1] for r in map(tuple, o.quantile(df, keys, c, p, "q", rows=most).collect())} for most in (None, 20))
        assert want.keys() == got.keys() and all(np.isclose(got[k], want[k], rtol=1e-12, atol=0, equal_nan=True) for k in want), c


def test_median_error_writes_counts_not_errors(spark, monkeypatch):
    """Groups above the limit: all but a few of their errors stay where they are, and each is computed three times."""
    seen = spark.sparkContext.accumulator(0)
    y = np.random.default_rng(2).normal(100, 9, 30_000)

    def count(batches):
        for pdf in batches:
            seen.add(len(pdf))
            yield pdf

    df = spark.createDataFrame(pd.DataFrame({"part": ["a", "b", "b"] * 10_000, "y": y, "p": 100.0})).mapInPandas(count, "part string, y double, p double")
    written = []
    for module in (o, learn):
        monkeypatch.setattr(module, "durable", lambda d, keep=module.durable: (out := keep(d), written.append(out.count()))[0])
    monkeypatch.setattr(o, "group_rows", lambda spark: 1000)
    got = {r["part"]: r["median_error"] for r in learn.regression_metrics(df, "y", "p", ["part"]).collect()}
    assert got == pytest.approx({"a": np.median(abs(y - 100)[::3]), "b": np.median(np.delete(abs(y - 100), np.s_[::3]))}, rel=1e-12)
    assert sum(written) < 10_000 and seen.value <= 90_000


def test_rows_in_enough_pieces_are_not_shuffled(spark, monkeypatch):
    asked = []
    monkeypatch.setattr(session, "durable", lambda d: asked.append(d._jdf.queryExecution().optimizedPlan().toString()) or d)
    for pieces in (spark.sparkContext.defaultParallelism, 1):
        df = spark.range(0, 90, 1, pieces).select(F.col("id").cast("string").alias("key"), (F.col("id") * 2).alias("v"))
        assert sorted(r[0] for r in session.dealt(df, ["key"], ["v"]).collect()) == list(range(0, 180, 2))
    assert ["Repartition" in p for p in asked] == [False, True] and "key" not in asked[0]


def test_predictions_are_scored_once(spark, monkeypatch):
    """The metrics of folds and shares read written predictions, not the models again."""
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 7 * 2.0 + F.hash("id") % 3).alias("y"))
    asked = []
    monkeypatch.setattr(learn, "regression_metrics", lambda d, *a: asked.append(d._jdf.queryExecution().optimizedPlan().toString()) or d)
    learn.cross_validation(df, "id", ["a"], "y", folds=2)
    learn.learning_curve(df, "id", ["a"], "y", sizes=2)
    assert len(asked) == 2 and not any("Union" in p or "UDF" in p for p in asked)


def test_modes_ranks_and_nearest_rank(spark):
    pdf = pd.DataFrame({"id": range(60), "x": [float(i * i % 11) for i in range(60)]})
    df = spark.createDataFrame(pdf)
    assert o.modes(df, [], "x").first()["mode"] == min(pdf["x"].mode())
    got = o.average_rank(df, [], "x", "r", rows=7).orderBy("id").toPandas()["r"].to_numpy()
    assert np.allclose(got, pdf["x"].rank().to_numpy())
    for rows in (None, 7):
        r = o.nearest_rank(df, [], "x", {"p95": 0.95, "p50": 0.5}, rows).first()
        xs = sorted(pdf["x"])
        assert (r["p95"], r["p50"]) == (xs[57], xs[30])


def test_trailing_burst_path_equals_sliding_frame_and_brute_force(df, data):
    a = o.trailing(df, ["key"], "t", 300_000_000, "id", "n", "a")
    b = o.trailing(df, ["key"], "t", 300_000_000, "id", "n", "a", dense=0)
    same(a, b)
    data = data.fillna({"key": "none"})
    brute = [((data["key"] == r.key) & (data["t"] <= r.t) & (data["t"] >= r.t - 300_000_000)).sum() for r in data.itertuples()]
    assert a.orderBy("id").toPandas()["n"].tolist() == brute


def test_trailing_has_no_sliding_frame(spark):
    """20,000 rows a cell: no frame slides, so a row's cost doesn't grow with the rows in its span."""
    n = 40_000
    df = spark.range(n).select("id", F.lit("k").alias("key"), (F.col("id") * 1000 + F.hash("id") % 300).alias("t"))
    got = o.trailing(df, ["key"], "t", 30_000_000, "id", "n", "a")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, -30000000" not in plan and plan.count("RangeFrame, unboundedpreceding$()") == 3
    t = np.array([r.t for r in df.orderBy("t", "id").collect()])
    found = got.orderBy("t", "id").toPandas()
    start = np.searchsorted(t, t - 30_000_000, "left")
    assert found["n"].tolist() == (np.searchsorted(t, t, "right") - start).tolist() and found["a"].tolist() == t[start].tolist()


def test_islands(df):
    flag = F.col("v") > 50
    same(o.islands(df, ["key"], ["t", "id"], flag), o.islands(df, ["key"], ["t", "id"], flag, rows=30))


def brute_cooldown(pdf, wait):
    last, out = {}, {}
    for r in pdf.sort_values(["t", "id"]).itertuples():
        fire = r.key not in last or r.t - last[r.key] > wait
        if fire:
            last[r.key] = r.t
        out[r.id] = fire
    return out


def test_cooldown_split_equals_brute_force(spark, df, data):
    live = data[(data["id"] % 4 != 0) & (data["v"] > 40)].fillna({"key": "none"})
    want = brute_cooldown(live, 120_000_000)
    for limit in ("1000000", "30"):
        spark.conf.set("spark.gaugeworks.groupRows", limit)
        got = {r["id"]: r["fired"] for r in w.cooldown_alerts(df, ["key"], "t", "id", F.col("v") > 40, 120).collect()}
        assert got == want
    spark.conf.unset("spark.gaugeworks.groupRows")


def test_stateful_rules_do_not_depend_on_the_split(spark, df):
    def both(make):
        a = make()
        spark.conf.set("spark.gaugeworks.groupRows", "40")
        try:
            return a.toPandas().sort_values("id"), make().toPandas().sort_values("id")
        finally:
            spark.conf.unset("spark.gaugeworks.groupRows")

    a, b = both(lambda: w.alert_states(df, ["key"], "t", "id", F.col("v") > 60, 200))
    assert a["action"].tolist() == b["action"].tolist() and set(a["action"]) >= {"fire", "skip", "resolve"}
    a, b = both(lambda: w.rate_limit(df, ["key"], "t", "id", {"minute": 2, "hour": 30, "day": 200}))
    assert a["verdict"].tolist() == b["verdict"].tolist() and len(set(a["verdict"])) > 2


def test_dequeue_order_is_a_permutation(spark):
    df = spark.createDataFrame([(i, i % 4, (i * 7) % 50) for i in range(50)], "id int, prio int, t int")
    got = w.dequeue_order(df, "prio", ["t", "id"]).orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1, 51))
    assert [(-r["prio"], r["t"], r["id"]) for r in got] == sorted((-r["prio"], r["t"], r["id"]) for r in got)


def test_interpolation_ends(spark):
    vals = [None, 1.0, None, None, 4.0, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(vals)], "t int, v double")
    assert [r["v"] for r in w.interpolate(df, [], ["t"], "v").orderBy("t").collect()] == [None, 1.0, 2.0, 3.0, 4.0, 4.0]
    assert [r["v"] for r in w.fill(df, [], ["t"], "v", "backward").orderBy("t").collect()] == [1.0, 1.0, 4.0, 4.0, 4.0, None]


def test_open_episode_has_no_end(spark):
    df = spark.createDataFrame([("k", 1, 5.0), ("k", 2, 20.0), ("k", 3, 21.0), ("k", 4, 5.0), ("k", 5, 30.0)], "key string, n int, v double")
    df = df.withColumn("ts", F.timestamp_seconds("n"))
    got = w.episodes(df, ["key"], ["ts"], F.col("v") > 10, "v").orderBy("start_ts").collect()
    assert [(r["readings"], r["last_value"], r["seconds"]) for r in got] == [(2, 21.0, 2.0), (1, 30.0, None)]


def test_gradient_single_row_and_pair(spark):
    df = spark.createDataFrame([("a", 1, 2.0), ("b", 1, 1.0), ("b", 2, 4.0)], "key string, t int, v double")
    got = {(r["key"], r["t"]): r["gradient"] for r in w.gradient(df, ["key"], ["t"], "v").collect()}
    assert got == {("a", 1): None, ("b", 1): 3.0, ("b", 2): 3.0}


@pytest.mark.parametrize("desc", [False, True])
@pytest.mark.parametrize("order", [["a", "b", "id"], ["t", "s", "id"], ["t", "id"]])
def test_null_nan_and_tied_orders_agree_on_both_paths(spark, desc, order):
    rows = [(None if k % 5 == 0 else float("nan") if k % 7 == 0 else float(k % 3), None if k % 4 == 0 else "xyz"[k % 3], 1.0, f"s{k % 50:02d}" if k % 9 else None, k, float(k)) for k in range(400)]
    df = spark.createDataFrame(rows, "a double, b string, t double, s string, id long, v double")
    specs = {"s1": ("sum", F.col("v")), "n": ("count", F.col("a")), "l": ("last", F.col("b")), "f": ("first", F.col("b"))}
    same(o.running(df, [], order, specs, desc), o.running(df, [], order, specs, desc, rows=25))
    assert o.cut_ranges(df, order, 25, desc).groupBy("_seg").count().agg(F.max("count")).first()[0] <= 75


@pytest.mark.parametrize("limit", ["1000000", "25"])
def test_backward_fill_and_retention_with_null_orders(spark, limit):
    rows = [(None if k in (3, 7) else k, k, None if k % 3 else float(k)) for k in range(60)]
    df = spark.createDataFrame(rows, "t long, id long, v double")
    spark.conf.set("spark.gaugeworks.groupRows", limit)
    try:
        kept = sorted(r.id for r in filters.retain_count(df, ["t", "id"], 5).collect())
        filled = {r.id: r.v for r in w.fill(df, [], ["t", "id"], "v", "backward").collect()}
    finally:
        spark.conf.unset("spark.gaugeworks.groupRows")
    assert kept == [55, 56, 57, 58, 59]
    assert filled[59] is None and filled[55] == 57.0


@pytest.mark.parametrize("limit", ["1000000", "200"])
def test_halving_average_keeps_early_rows(spark, limit):
    spark.conf.set("spark.gaugeworks.groupRows", limit)
    try:
        for values in ([1e300] * 20 + [0.0] * 1020, [3.0], [1.0, 2.0, 4.0], [float(k % 11) for k in range(1500)]):
            df = spark.createDataFrame([("k", k // 2, k, v) for k, v in enumerate(values)], "key string, t long, id long, v double").repartition(5)
            want = values[0]
            for x in values[1:]:
                want = (want + x) / 2
            got = reports.halving_average(df, ["key"], "v", "t", ["id"]).first().halving_avg
            assert got == pytest.approx(want, rel=1e-9), len(values)
    finally:
        spark.conf.unset("spark.gaugeworks.groupRows")


def test_spearman_ranks_complete_pairs_only(spark):
    rng = np.random.default_rng(4)
    pdf = pd.DataFrame({"x": rng.normal(size=80).round(1), "y": rng.normal(size=80).round(1)})
    pdf.loc[::6, "x"], pdf.loc[::7, "y"] = np.nan, np.nan
    df = spark.createDataFrame(pdf).select(*[F.when(~F.isnan(c), F.col(c)).alias(c) for c in ("x", "y")])
    live = pdf.dropna()
    assert aggregate.spearman(df, "x", "y").first().spearman == pytest.approx(live["x"].rank().corr(live["y"].rank()))


def test_gradient_is_null_beside_a_null(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate([1.0, 3.0, None, 7.0, 8.0, 12.0])], "t long, v double")
    got = [r.gradient for r in w.gradient(df, [], ["t"], "v").orderBy("t").collect()]
    assert got == [2.0, None, 2.0, None, 2.5, 4.0]


def test_chain_rounds_grow_with_the_logarithm(spark, monkeypatch):
    """One key whose rows alternate, so that a guessed state never settles; 200 blocks."""
    n, wait = 60_000, 7
    rows = spark.range(n).select(F.lit("hot").alias("key"), F.col("id"), (F.col("id") * 1_000_000 + F.col("id") % 3).alias("t"), (F.col("id") % 2 * 100).alias("v"))
    spark.conf.set("spark.gaugeworks.groupRows", "300")
    real, calls = o.durable, []
    monkeypatch.setattr(o, "durable", lambda d: calls.append(1) or real(d))
    try:
        fired = w.cooldown_alerts(rows, ["key"], "t", "id", F.col("v") >= 0, wait)
        got = sorted(r["id"] for r in fired.filter("fired").collect())
        assert len(calls) <= 20 + 6  # doubling up and down over 200 blocks, and what is written around it
        states = {r["id"]: r["action"] for r in w.alert_states(rows, ["key"], "t", "id", F.col("v") > 50, wait).collect()}
    finally:
        spark.conf.unset("spark.gaugeworks.groupRows")
    want, last = [], None
    for k in range(n):
        if last is None or k * 1_000_000 + k % 3 - last > wait * 1_000_000:
            want.append(k)
            last = k * 1_000_000 + k % 3
    assert got == want
    active, last = False, None
    for k in range(n):
        t, on = k * 1_000_000 + k % 3, k % 2 == 1
        if last is not None and t - last < wait * 1_000_000:
            action = "skip"
        elif on and not active:
            active, last, action = True, t, "fire"
        elif on:
            action = "active"
        else:
            action, active = "resolve" if active else "idle", False
        assert states[k] == action
