"""Clustering, regression, evaluation and what-if queries on the test tables."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from gaugeworks.functions.portable import portable_hash_sql
from gaugeworks.operators import density
from gaugeworks.operators import learn as m
from gaugeworks.operators import project as p
from gaugeworks.plans.aggregations import rounded
from gaugeworks.plans.registry import query
from gaugeworks.session import dealt, rows_table, spread


def facts(t):
    """Line items with a key of their own and a target to be predicted."""
    return t.lineitem.selectExpr(
        "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) key", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity q", "l_discount + 0.0 d", "l_tax + 0.0 x", "l_extendedprice y")


COLS = ["q", "d", "x"]
FACTS = "(SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS key, l_quantity AS q, l_discount + 0.0::DOUBLE AS d, l_tax + 0.0::DOUBLE AS x, l_extendedprice AS y FROM lineitem)"


def ols(train: str, by: str) -> str:
    """SQL: the least-squares plane y = b0 + b1 q + b2 d + b3 x of each group, by the normal equations of centred sums."""
    pairs = [(a, b) for k, a in enumerate("qdxy") for b in "qdxy"[k:] if (a, b) != ("y", "y")]
    sums = ", ".join([f"covar_pop({a}, {b}) AS {a}{b}" for a, b in pairs] + [f"avg({a}) AS m{a}" for a in "qdxy"])
    return f"""(SELECT *, my - b1 * mq - b2 * md - b3 * mx AS b0 FROM (SELECT *,
        (qy * (dd * xx - dx * dx) - qd * (dy * xx - dx * xy) + qx * (dy * dx - dd * xy)) / det AS b1,
        (qq * (dy * xx - dx * xy) - qy * (qd * xx - dx * qx) + qx * (qd * xy - dy * qx)) / det AS b2,
        (qq * (dd * xy - dy * dx) - qd * (qd * xy - dy * qx) + qy * (qd * dx - dd * qx)) / det AS b3
        FROM (SELECT *, qq * (dd * xx - dx * dx) - qd * (qd * xx - dx * qx) + qx * (qd * dx - dd * qx) AS det FROM (SELECT {by}, {sums} FROM {train} GROUP BY {by}))))"""


def errors_sql(pred: str, by: str) -> str:
    """SQL: the regression metrics of (by, y, p) rows, rounded as `metrics_rounded` does."""
    return f"""SELECT {by}, count(*) AS n, round(sqrt(avg((p - y) * (p - y))), 3) AS rmse, round(avg(abs(p - y)), 3) AS mae, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) AS r2,
        round(avg(abs(p - y) / abs(y)) * 100, 4) AS mape, round(max(abs(p - y)), 3) AS max_error, round(median(abs(p - y)), 3) AS median_error FROM {pred} GROUP BY {by}"""


def metrics_rounded(df, by):
    return rounded(df.select(by, "n", "rmse", "mae", "r2", "mape", "max_error", "median_error"), 3, r2=6, mape=4, share=6)


@query("mlx_01_kmeans_silhouette")
def kmeans(t):
    e = t.embeddings.select("vec_id", array_to_vector("embedding").alias("v"))
    best, _ = m.best_kmeans(e, "vec_id", "v")
    return best.select("vec_id", "cluster")


DIMS = range(64)


@query("mlx_02_cluster_summary", "SELECT label, count(*) AS size, " + ", ".join(f"round(avg(embedding[{i + 1}]::DOUBLE), 6) + 0.0::DOUBLE AS e{i}_mean, round(stddev_samp(embedding[{i + 1}]::DOUBLE), 6) AS e{i}_std" for i in DIMS)
       + ", round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM embeddings), 6) AS percent FROM embeddings GROUP BY 1")
def clusters(t):
    e = t.embeddings.select("label", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in DIMS])
    return rounded(m.cluster_summary(e, "label", [f"e{i}" for i in DIMS]))


READINGS = "(SELECT event_id, value::DOUBLE AS a, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS b, (epoch_us(ts) % 86400000000) / 1e6::DOUBLE AS c FROM events)"


def readings(t):
    """Three features of an event: its value, its setting, and the second of the day."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", F.col("value").cast("double").alias("a"), F.get_json_object("props", "$.k").cast("double").alias("b"), (micros % 86400000000 / 1e6).alias("c"))


def standard_sql(cols: str = "abc", source: str = READINGS) -> str:
    return "(SELECT event_id AS id, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in cols) + f" FROM {source})"


@query("mlx_03_dbscan", f"""
    WITH RECURSIVE p AS MATERIALIZED {standard_sql()}, e AS MATERIALIZED (SELECT x.id AS i, y.id AS j FROM p x JOIN p y ON pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + pow(x.c - y.c, 2) <= 0.5 * 0.5),
      core AS MATERIALIZED (SELECT i FROM e GROUP BY i HAVING count(*) >= 5), link AS MATERIALIZED (SELECT e.i, e.j FROM e JOIN core x ON x.i = e.i JOIN core y ON y.i = e.j WHERE e.i <> e.j),
      tag(i, root) USING KEY (i) AS (SELECT i, i FROM core UNION SELECT link.j, min(tag.root) FROM tag JOIN link ON link.i = tag.i JOIN recurring.tag AS old ON old.i = link.j WHERE tag.root < old.root GROUP BY link.j)
    SELECT p.id AS event_id, coalesce(tag.root, rim.root, -1)::BIGINT AS cluster FROM p LEFT JOIN tag ON tag.i = p.id
    LEFT JOIN (SELECT e.i, min(tag.root) AS root FROM e JOIN tag ON tag.i = e.j GROUP BY e.i) rim ON rim.i = p.id""")
def dbscan(t):
    return density.dbscan(readings(t), "event_id", ["a", "b", "c"]).select("event_id", "cluster")


@query("mlx_04_linear_regression", """
    WITH s AS (SELECT avg(l_quantity) AS mq, avg(l_tax) AS mx, avg(l_extendedprice) AS my, var_pop(l_quantity) AS qq, var_pop(l_tax) AS xx, covar_pop(l_quantity, l_tax) AS qx, covar_pop(l_quantity, l_extendedprice) AS qy, covar_pop(l_tax, l_extendedprice) AS xy FROM lineitem),
         b AS (SELECT *, (qy * xx - xy * qx) / (qq * xx - qx * qx) AS b1, (xy * qq - qy * qx) / (qq * xx - qx * qx) AS b2 FROM s)
    SELECT l_orderkey, l_linenumber, l_partkey, round(my + b1 * (l_quantity - mq) + b2 * (l_tax - mx), 3) AS prediction FROM lineitem, b""")
def linear(t):
    df = facts(t)
    got = m.fit(df, ["q", "x"], "y").transform(df)
    return rounded(got.select("l_orderkey", "l_linenumber", "l_partkey", "prediction"), 3)


@query("mlx_05_tree_models")
def trees(t):
    df = spread(facts(t), "key")
    a = m.fit(df, COLS, "y", "random_forest").transform(df).select("key", F.col("prediction").alias("forest"))
    b = m.fit(df, COLS, "y", "gradient_boosting").transform(df).select("key", F.col("prediction").alias("boosted"))
    return rounded(a.join(b, "key"), 4)


@query("mlx_06_compare_models")
def compare(t):
    df = dealt(m.hashed_folds(facts(t), ["key"]), ["key"], ["fold", *COLS, "y"])
    train, valid = df.filter("fold <> 0"), df.filter("fold = 0")
    return rounded(m.compare(m.train_all(train, valid, COLS, "y"), {"train": train, "validation": valid}, "y", COLS), 4)


@query("mlx_07_weighted_vote", "SELECT event_id, round(value * 0.75 + user_id * 0.25, 6) AS vote FROM events")
def vote(t):
    return rounded(t.events.select("event_id", m.weighted_vote(t.events, {"value": 0.9, "user_id": 0.3, "event_id": -2.0}).alias("vote")))


@query("mlx_07_stacking")
def stack(t):
    return rounded(m.stacking(facts(t), "key", COLS, "y", folds=5).select("key", "y", "prediction"), 4)


@query("mlx_08_batch_prediction", f"""
    SELECT CASE WHEN g < 0.1 THEN 'Poor' WHEN g < 1 THEN 'Sub-critical' WHEN g < 5 THEN 'Breakeven' WHEN g < 10 THEN 'Ignition' ELSE 'High Performance' END AS category, count(*) AS n, round(avg(g), 6) AS mean_gain, round(max(g), 6) AS max_gain
    FROM (SELECT (b0 + b1 * q + b2 * d + b3 * x) / 20000 AS g FROM {FACTS}, {ols(f"(SELECT 1 AS one, * FROM {FACTS})", "one")}) GROUP BY 1""")
def batch(t):
    df = facts(t)
    got = m.fit(df, COLS, "y").transform(df).withColumn("gain", F.col("prediction") / 20000)
    return got.groupBy(p.level("gain").alias("category")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("gain"), 6).alias("mean_gain"), F.round(F.max("gain"), 6).alias("max_gain"))


@query("mlx_09_grid_search")
def grid(t):
    df = spread(facts(t), "key")
    model, scores = m.cross_validated_search(df, "key", COLS, "y", {"numTrees": [50, 100], "maxDepth": [3, 5]}, folds=5)
    return rounded(model.transform(m.assemble(df, COLS)).select("key", "prediction"), 4)


PRED = "(SELECT event_id, value AS y, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS p FROM events)"


def predicted(t):
    return t.events.select("event_id", F.col("value").alias("y"), F.get_json_object("props", "$.k").cast("double").alias("p"))


@query("mlx_10_regression_metrics", f"""
    SELECT count(*) AS n, round(avg((p - y) * (p - y)), 4) AS mse, round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae, round(1 - sum((p - y) * (p - y)) / (var_pop(y) * count(*)), 6) AS r2,
           round(avg(CASE WHEN y <> 0 THEN abs(p - y) / abs(y) END) * 100, 4) AS mape, round(avg(abs(p - y) / greatest(abs(y), 1e-8)) * 100, 4) AS mape_guarded, round(max(abs(p - y)), 4) AS max_error, round(median(abs(p - y)), 4) AS median_error FROM {PRED}""")
def metrics(t):
    return rounded(m.regression_metrics(predicted(t), "y", "p"), 6, mse=4, mape=4, mape_guarded=4, max_error=4, median_error=4)


@query("mlx_11_physics_evaluation", f"""
    SELECT round(avg(((y >= 1) = (p >= 1))::INT), 6) AS breakeven_agreement, round(avg(((y >= 10) = (p >= 10))::INT), 6) AS ignition_agreement, round(avg((p < 0 OR p > 100)::INT), 6) AS implausible_share, count(*) FILTER (p < 0) AS negative, count(*) FILTER (p > 50) AS above_50, count(*) AS n,
           round(1 - count(*) FILTER (p < 0 OR p > 50) / count(*), 6) AS realism FROM {PRED}""")
def physics(t):
    return rounded(m.physics_evaluation(predicted(t), "y", "p"))


@query("mlx_12_residual_summary", f"SELECT round(avg(y - p), 6) AS mean, round(stddev_samp(y - p), 6) AS std, round(avg(abs(y - p)), 6) AS mae, round(max(abs(y - p)), 4) AS max, round(quantile_cont(abs(y - p), 0.95), 4) AS p95 FROM {PRED}")
def residuals(t):
    return rounded(m.residual_summary(predicted(t), "y", "p"), 6, max=4, p95=4)


FOLDED = f"(SELECT *, ({portable_hash_sql(['key'], 42)} % 5)::INT AS fold, ({portable_hash_sql(['key'], 7)} % 1000) / 1000.0::DOUBLE AS u FROM {FACTS})"


@query("mlx_13_cross_validation", f"""
    WITH f AS MATERIALIZED {FOLDED}, c AS {ols("(SELECT k::INT AS fold, q, d, x, y FROM f, range(5) r(k) WHERE fold <> k)", "fold")}
    {errors_sql("(SELECT fold, y, b0 + b1 * q + b2 * d + b3 * x AS p FROM f JOIN c USING (fold))", "fold")}""")
def cross(t):
    return metrics_rounded(m.cross_validation(facts(t), "key", COLS, "y"), "fold")


@query("mlx_13_learning_curve", f"""
    WITH f AS MATERIALIZED {FOLDED}, c AS {ols("(SELECT k / 10.0::DOUBLE AS share, q, d, x, y FROM f, range(1, 11) r(k) WHERE fold <> 0 AND u < k / 10.0::DOUBLE)", "share")}
    {errors_sql("(SELECT share, y, b0 + b1 * q + b2 * d + b3 * x AS p FROM f, c WHERE fold = 0)", "share")}""")
def curve(t):
    return metrics_rounded(m.learning_curve(facts(t), "key", COLS, "y"), "share")


DRAWN = f"(SELECT b, q, d, x, y, ({portable_hash_sql(['key'], 'b', 10)} + 0.5::DOUBLE) / 1099511627776.0::DOUBLE AS u FROM {FACTS}, range(100) r(b))"
WEIGHED = f"(SELECT b, q, d, x, y, unnest(range({' + '.join(f'(u > {p!r}::DOUBLE)::INT' for p in m._POISSON)})) FROM {DRAWN})"


@query("mlx_14_bootstrap", f"""
    WITH c AS MATERIALIZED {ols(WEIGHED, "b")}, l AS (SELECT 'q' AS feature, b1 AS v FROM c UNION ALL SELECT 'd', b2 FROM c UNION ALL SELECT 'x', b3 FROM c)
    SELECT feature, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS std, round(quantile_cont(v, 0.025), 4) AS lower, round(quantile_cont(v, 0.975), 4) AS upper FROM l GROUP BY 1""")
def bootstrap(t):
    return rounded(m.bootstrap(facts(t), "key", COLS, "y"), 4)


TURNS = ", ".join(f"('{c}', {r}, {u!r}::DOUBLE)" for c, r, u in m.turns(COLS, 10))


@query("mlx_15_permutation_importance", f"""
    WITH f AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY {portable_hash_sql(['key'])}, key) - 1 AS p, count(*) OVER () AS n FROM {FACTS}), c AS MATERIALIZED {ols("(SELECT 1 AS one, * FROM f)", "one")},
    e AS (SELECT t.c, t.r, avg(pow(b0 + b1 * CASE WHEN t.c = 'q' THEN o.q ELSE f.q END + b2 * CASE WHEN t.c = 'd' THEN o.d ELSE f.d END + b3 * CASE WHEN t.c = 'x' THEN o.x ELSE f.x END - f.y, 2)) AS mse
          FROM c, f, (VALUES {TURNS}) t(c, r, u), f o WHERE o.p = (f.p + 1 + floor(t.u * (f.n - 1))::BIGINT) % f.n GROUP BY 1, 2), base AS (SELECT avg(pow(b0 + b1 * q + b2 * d + b3 * x - y, 2)) AS mse FROM f, c)
    SELECT e.c AS feature, round(avg(e.mse - base.mse), 2) + 0.0::DOUBLE AS importance, round(stddev_pop(e.mse - base.mse), 2) + 0.0::DOUBLE AS std FROM e, base GROUP BY 1""")
def permutation(t):
    df = spread(facts(t), "key")
    return rounded(m.permutation_importance(df, "key", COLS, "y", m.fit(df, COLS, "y"), 10), 2)


@query("mlx_16_grouped_importance", """
    WITH i AS (SELECT p_brand AS feature, sum(p_size - 25)::BIGINT AS v FROM part GROUP BY 1), n AS (SELECT feature, abs(v) / sum(abs(v)) OVER () AS importance FROM i)
    SELECT g AS "group", round(avg(importance), 9) AS importance, count(*) AS features FROM n JOIN (VALUES ('Brand#1', 'magnetic'), ('Brand#2', 'magnetic'), ('Brand#3', 'thermal'), ('Brand#4', 'thermal'), ('Brand#5', 'thermal'), ('Brand#6', 'heating')) r(feature, g) USING (feature) GROUP BY 1""")
def grouped(t):
    imp = m.normalized_importance(t.part.groupBy(F.col("p_brand").alias("feature")).agg(F.sum(F.col("p_size") - 25).alias("v")), "feature", "v")
    g = rows_table(t.spark, [("Brand#1", "magnetic"), ("Brand#2", "magnetic"), ("Brand#3", "thermal"), ("Brand#4", "thermal"), ("Brand#5", "thermal"), ("Brand#6", "heating")], "feature string, group string")
    return rounded(m.grouped_importance(imp, "feature", "importance", g), 9)


def gain(c):
    """A gain formula: power over the square root of heating, damped by size."""
    return c["p_retailprice"] / F.sqrt(c["p_size"] + 10)


@query("mlx_17_sensitivity", """
    SELECT p_partkey, 'p_retailprice' AS parameter, round((p_retailprice * 1.1 - p_retailprice * 0.9) / (0.2 * p_retailprice) * 100, 5) AS sensitivity FROM part
    UNION ALL SELECT p_partkey, 'p_size', round((p_retailprice / sqrt(p_size * 1.1 + 10) - p_retailprice / sqrt(p_size * 0.9 + 10)) / (0.2 * p_retailprice / sqrt(p_size + 10)) * 100, 5) FROM part""")
def sensitivity(t):
    return rounded(m.sensitivity(t.part.select("p_partkey", "p_retailprice", "p_size"), ["p_retailprice", "p_size"], gain).select("p_partkey", "parameter", "sensitivity"), 5)


def _normal_sql(salt: int) -> str:
    u = lambda k: f"(({portable_hash_sql(['p_partkey', 'draw'], k, 10)} + 0.5::DOUBLE) / 1099511627776.0::DOUBLE)"
    return f"sqrt(-2 * ln({u(2 * salt)})) * cos(2 * pi() * {u(2 * salt + 1)})"


@query("mlx_18_monte_carlo", f"""
    WITH d AS (SELECT greatest(p_retailprice * 0.1, p_retailprice + p_retailprice * 0.1::DOUBLE * {_normal_sql(0)}) AS a, greatest(p_size * 0.1::DOUBLE, p_size + p_size * 0.2::DOUBLE * {_normal_sql(1)}) AS b FROM part, range(1, 11) r(draw)),
    s AS (SELECT a / sqrt(b + 10) AS q FROM d)
    SELECT count(*) AS draws, round(avg(q), 6) AS mean, round(stddev_pop(q), 6) AS std, round(avg((q >= 100)::INT), 6) AS p_100, round(avg((q >= 200)::INT), 6) AS p_200, round(avg((q >= 300)::INT), 6) AS p_300,
           round(stddev_pop(q) / avg(q), 6) AS cv, round(quantile_cont(q, 0.025), 6) AS lower, round(quantile_cont(q, 0.975), 6) AS upper FROM s""")
def monte_carlo(t):
    return rounded(m.monte_carlo(t.part, "p_partkey", {"p_retailprice": 0.1, "p_size": 0.2}, gain, (100, 200, 300)))


@query("mlx_19_scenarios", """
    SELECT p_partkey, s AS scenario, round(f * p_retailprice + p_size, 6) AS total_power, CASE WHEN f * p_retailprice / sqrt(p_size + 10) / 50 < 0.1 THEN 'Very Poor' WHEN f * p_retailprice / sqrt(p_size + 10) / 50 < 0.5 THEN 'Poor' WHEN f * p_retailprice / sqrt(p_size + 10) / 50 < 1 THEN 'Sub-critical'
      WHEN f * p_retailprice / sqrt(p_size + 10) / 50 < 5 THEN 'Break-even' WHEN f * p_retailprice / sqrt(p_size + 10) / 50 < 10 THEN 'Ignition' ELSE 'High Performance' END AS category FROM part, (VALUES ('low', 0.2::DOUBLE), ('nominal', 1.0), ('high', 3.5)) v(s, f)""")
def scenarios(t):
    s = F.explode(F.map_from_arrays(F.array(F.lit("low"), F.lit("nominal"), F.lit("high")), F.array(F.lit(0.2), F.lit(1.0), F.lit(3.5)))).alias("scenario", "f")
    df = t.part.select("p_partkey", "p_retailprice", "p_size", s).withColumn("p_retailprice", F.col("f") * F.col("p_retailprice"))
    scored = p.scenario_columns(df, "p_retailprice", "p_size").withColumn("category", p.level(gain({"p_retailprice": F.col("p_retailprice"), "p_size": F.col("p_size")}) / 50, p.SIX_LEVELS))
    return rounded(scored.select("p_partkey", "scenario", "total_power", "category"))
