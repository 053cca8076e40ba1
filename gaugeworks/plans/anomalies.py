"""Anomaly detection on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import anomaly as an
from gaugeworks.plans.aggregations import rounded
from gaugeworks.plans.learning import readings, standard_sql
from gaugeworks.plans.registry import query

SEV = "CASE WHEN score < 2 THEN 'low' WHEN score < 3 THEN 'medium' WHEN score < 4 THEN 'high' ELSE 'critical' END"
KEEP = ["event_id", "score", "anomaly", "severity", "confidence"]


@query("ano_01_z_score", f"""
    WITH z AS (SELECT event_id, abs((value - m) / (s + 1e-8)) AS score FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events))
    SELECT event_id, round(score, 6) AS score, score > 3 AS anomaly, {SEV} AS severity, round(least(score / 3, 1), 6) AS confidence FROM z""")
def z(t):
    return rounded(an.z_score(t.events, "value").select(*KEEP))


@query("ano_02_modified_z", f"""
    WITH s AS (SELECT median(value) AS med FROM events), d AS (SELECT median(abs(value - med)) AS mad FROM events, s), z AS (SELECT event_id, abs(0.6745 * (value - med) / (mad + 1e-8)) AS score FROM events, s, d)
    SELECT event_id, round(score, 6) AS score, score > 3.5 AS anomaly, {SEV} AS severity, round(least(score / 3.5, 1), 6) AS confidence FROM z""")
def modified(t):
    return rounded(an.modified_z(t.events, "value").select(*KEEP))


@query("ano_03_iqr_score", f"""
    WITH q AS (SELECT quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events), z AS (SELECT event_id, value, q1 - 1.5 * (q3 - q1) AS lo, q3 + 1.5 * (q3 - q1) AS hi, greatest((q1 - 1.5 * (q3 - q1) - value) / (q3 - q1 + 1e-8), (value - (q3 + 1.5 * (q3 - q1))) / (q3 - q1 + 1e-8), 0) AS score FROM events, q)
    SELECT event_id, round(score, 6) AS score, value < lo OR value > hi AS anomaly, {SEV} AS severity, round(least(score, 1), 6) AS confidence FROM z""")
def iqr(t):
    return rounded(an.iqr_score(t.events, "value").select(*KEEP))


#: Student's quantile at 1 - 0.05 / (2 n) by halving, its tail by Simpson's rule; then the critical value for n rows.
CRITICAL_SQL = """n AS (SELECT count(value)::DOUBLE AS n FROM events), t(lo, hi, n, k) AS (SELECT 0::DOUBLE, 60::DOUBLE, n, 0 FROM n UNION ALL
      SELECT CASE WHEN tail > 0.025::DOUBLE / n THEN mid ELSE lo END, CASE WHEN tail > 0.025::DOUBLE / n THEN hi ELSE mid END, n, k + 1
      FROM (SELECT lo, hi, n, k, (lo + hi) / 2 AS mid, exp(lgamma((n - 1) / 2) - lgamma((n - 2) / 2)) / sqrt((n - 2) * pi()) * 0.0025::DOUBLE / 3
              * list_sum(list_transform(range(0, 12001), lambda i: CASE WHEN i IN (0, 12000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END * exp(-(n - 1) / 2 * ln(1 + pow((lo + hi) / 2 + i * 0.0025::DOUBLE, 2) / (n - 2))))) AS tail FROM t WHERE k < 60)),
    c AS (SELECT (n - 1) / sqrt(n) * sqrt(lo * lo / (n - 2 + lo * lo)) AS critical FROM t WHERE k = 60)"""


@query("ano_04_grubbs", f"""
    WITH RECURSIVE {CRITICAL_SQL}, z AS (SELECT event_id, abs((value - m) / (s + 1e-8)) AS score FROM events, (SELECT avg(value) AS m, stddev_pop(value) AS s FROM events))
    SELECT event_id, round(score, 6) AS score, score > critical AS anomaly, {SEV} AS severity, round(least(score / critical, 1), 6) AS confidence FROM z, c""")
def grubbs(t):
    return rounded(an.grubbs(t.events, "value").select(*KEEP))


@query("ano_05_disruption_risk", """
    WITH g AS (SELECT event_id, value, user_id, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 50 AS q, coalesce(CASE WHEN lag(value) OVER w IS NULL THEN lead(value) OVER w - value WHEN lead(value) OVER w IS NULL THEN value - lag(value) OVER w ELSE (lead(value) OVER w - lag(value) OVER w) / 2 END < -20, false) AS cool FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT event_id, round(((value / 2000 > 0.028 * q)::INT + (q < 2)::INT + (user_id / 1000.0 > 0.1)::INT + cool::INT) / 4, 6) AS disruption_risk, ((value / 2000 > 0.028 * q)::INT + (q < 2)::INT + (user_id / 1000.0 > 0.1)::INT + cool::INT) / 4 > 0.5 AS disruption_predicted FROM g""")
def disruption(t):
    e = t.events.select("event_id", "user_id", "ts", "value", (F.col("value") / 2000).alias("beta"), (F.get_json_object("props", "$.k").cast("double") / 50).alias("q"), (F.col("user_id") / 1000).alias("impurity"))
    return rounded(an.disruption_risk(e, ["user_id"], ["ts", "event_id"], "beta", "q", "impurity", "value", -20.0).select("event_id", "disruption_risk", "disruption_predicted"))


@query("ano_06_equipment", """
    SELECT o_orderkey, round((o_totalprice / 450000 + o_custkey / 1000) / 2, 9) AS equipment_health_score, o_totalprice / 450000 < 0.8 AS magnet_anomaly, o_custkey / 1000 < 0.8 AS cooling_anomaly, (o_totalprice / 450000 + o_custkey / 1000) / 2 < 0.8 AS equipment_anomaly FROM orders""")
def equipment(t):
    o = t.orders.selectExpr("o_orderkey", "o_totalprice / 450000 magnet_health", "o_custkey / 1000 cooling_health")
    return rounded(an.equipment(o).drop("magnet_health", "cooling_health"), 9)


OPER = """(SELECT event_id, value / 100 < 0.1 AS q_factor_anomaly, value / (user_id + 1e-6) > 2 AS power_balance_anomaly, value / 50 < 0.05 OR value / 50 > 5 AS confinement_anomaly FROM events)"""
FLAGS = ["q_factor_anomaly", "power_balance_anomaly", "confinement_anomaly"]


def operational(t):
    return an.operational(t.events.selectExpr("event_id", "value / 100 q", "value", "user_id", "value / 50 conf"), "q", "value", "user_id", "conf")


@query("ano_07_operational", f"SELECT *, q_factor_anomaly OR power_balance_anomaly OR confinement_anomaly AS operational_anomaly FROM {OPER}")
def oper(t):
    return operational(t).drop("q", "value", "user_id", "conf")


@query("ano_08_combined_flags", f"SELECT event_id, q_factor_anomaly::INT + power_balance_anomaly::INT + confinement_anomaly::INT AS anomaly_count, q_factor_anomaly OR power_balance_anomaly OR confinement_anomaly AS is_anomaly FROM {OPER}")
def combined(t):
    return an.combine(operational(t), FLAGS).select("event_id", "anomaly_count", "is_anomaly")


@query("ano_08_flag_summary", " UNION ALL ".join(f"SELECT '{c}' AS flag, count(*) FILTER ({c}) AS count, round(count(*) FILTER ({c}) / count(*), 6) AS rate FROM {OPER}" for c in FLAGS))
def summary(t):
    return rounded(an.flag_summary(operational(t), FLAGS))


@query("ano_09_physics_limits", """
    WITH g AS (SELECT event_id, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, value < 5 OR value > 150 AS a, coalesce(lag(value) OVER w * (1 - 0.3) > value OR lag(k) OVER w * (1 - 0.5) > k, false) AS b, k / 50 < 0.8 AS c FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts))
    SELECT event_id, round(a::INT * 0.4::DOUBLE + b::INT * 0.4::DOUBLE + c::INT * 0.2::DOUBLE, 6) AS score, CASE WHEN a THEN 'physics' WHEN b THEN 'disruption' WHEN c THEN 'performance' ELSE 'none' END AS type FROM g""")
def physics(t):
    e = t.events.select("event_id", "user_id", "ts", "value", F.get_json_object("props", "$.k").cast("double").alias("k")).withColumn("q", F.col("k") / 50)
    return rounded(an.physics_limits(e, ["user_id"], ["ts", "event_id"], {"value": (5, 150)}, {"value": 0.3, "k": 0.5}, "q").select("event_id", "score", "type"))


RULES = [an.Rule("precursor", "critical", "value", "min", 1), an.Rule("precursor", "critical", "value", "max", 150), an.Rule("degradation", "high", "value", "decrease_rate", 60), an.Rule("runaway", "critical", "k", "increase_rate", 70), an.Rule("limit", "high", "k", "threshold", 95)]
PATTERN_SQL = """(SELECT event_id, value < 1 OR value > 150 AS precursor, coalesce(value - lag(value) OVER w < -60, false) AS degradation, coalesce(k - lag(k) OVER w > 70, false) AS runaway, k > 95 AS "limit"
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events) WINDOW w AS (PARTITION BY user_id ORDER BY ts))"""


def patterns(t):
    e = t.events.select("event_id", "user_id", "ts", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    return an.pattern_flags(e, ["user_id"], ["ts", "event_id"], RULES)


@query("ano_10_pattern_flags", f"SELECT * FROM {PATTERN_SQL}")
def pattern_flags(t):
    return patterns(t).drop("user_id", "ts", "value", "k")


@query("ano_10_pattern_summary", " UNION ALL ".join(f"""SELECT '{n}' AS pattern, '{s}' AS severity, count(*) FILTER ("{n}") AS hits, round(least(1, count(*) FILTER ("{n}") / greatest(10, count(*) * 0.1::DOUBLE)), 6) AS confidence FROM {PATTERN_SQL}""" for n, s in (("precursor", "critical"), ("degradation", "high"), ("runaway", "critical"), ("limit", "high"))))
def pattern_summary(t):
    return rounded(an.pattern_summary(patterns(t), RULES))


@query("ano_11_consensus", f"SELECT event_id, precursor::INT + degradation::INT + runaway::INT + \"limit\"::INT AS votes, precursor::INT + degradation::INT + runaway::INT + \"limit\"::INT >= 2 AS consensus FROM {PATTERN_SQL}")
def consensus(t):
    return an.consensus(patterns(t), ["precursor", "degradation", "runaway", "limit"]).select("event_id", "votes", "consensus")


COLS = ["l_quantity", "l_extendedprice", "l_discount"]


@query("ano_12_column_report", " UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) FILTER (abs(({c} - m) / (s + 1e-8)) > 3) AS z_count, count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) AS iqr_count
    FROM lineitem, (SELECT avg({c}) AS m, stddev_pop({c}) AS s, quantile_cont({c}, 0.25) AS q1, quantile_cont({c}, 0.75) AS q3 FROM lineitem)""" for c in COLS))
def report(t):
    return an.column_report(t.lineitem, COLS)


@query("ano_12_comprehensive")
def comprehensive(t):
    e = t.events.select("event_id", "user_id", "ts", "value", F.get_json_object("props", "$.k").cast("double").alias("k"))
    got = an.comprehensive(e, "event_id", ["value", "k"], ["user_id"], ["ts", "event_id"], RULES, 100)
    return got.select("event_id", "z_flag", "iqr_flag", "forest_flag", "pattern_flag", "votes", "consensus")


@query("ano_13_isolation_forest")
def forest(t):
    li = t.lineitem.selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "xxhash64(l_orderkey, l_linenumber, l_partkey, l_suppkey) key")
    return rounded(an.isolation_forest(li, "key", COLS, trees=100).select("l_orderkey", "l_linenumber", "l_partkey", "score", "anomaly"))


@query("ano_14_local_outlier_factor", """
    WITH p AS (SELECT event_id, event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS p FROM events),
         n AS (SELECT a.event_id, a.event_type, a.p, b.p AS q, abs(a.v - b.v) AS d, row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.v - b.v), b.p) AS k FROM p a JOIN p b ON a.event_type = b.event_type AND b.p BETWEEN a.p - 20 AND a.p + 20 AND a.p <> b.p),
         m AS (SELECT * FROM n WHERE k <= 20), kd AS (SELECT event_type, p, max(d) AS kd FROM m GROUP BY 1, 2),
         lrd AS (SELECT m.event_id, m.event_type, m.p, 1 / (avg(greatest(d, kd)) + 1e-10) AS lrd FROM m JOIN kd ON m.event_type = kd.event_type AND m.q = kd.p GROUP BY 1, 2, 3)
    SELECT m.event_id, round(avg(b.lrd) / any_value(a.lrd), 5) AS lof FROM m JOIN lrd a ON a.event_id = m.event_id JOIN lrd b ON b.event_type = m.event_type AND b.p = m.q GROUP BY 1""")
def lof(t):
    return rounded(an.local_outlier_factor(t.events.select("event_id", "event_type", "value"), ["event_type"], "value", "event_id").select("event_id", "lof"), 5)


@query("ano_14_outlier_factor_features", f"""
    WITH p AS MATERIALIZED {standard_sql()},
         n AS MATERIALIZED (SELECT id, unnest(m) AS m FROM (SELECT x.id, min({{'d': sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2) + pow(x.c - y.c, 2)), 'j': y.id}}, 20) AS m FROM p x JOIN p y ON x.id <> y.id GROUP BY x.id)),
         r AS (SELECT id, max(m.d) AS kd FROM n GROUP BY id), q AS MATERIALIZED (SELECT n.id, 1 / (avg(greatest(m.d, r.kd)) + 1e-10) AS lrd FROM n JOIN r ON r.id = m.j GROUP BY n.id),
         f AS MATERIALIZED (SELECT n.id, avg(o.lrd) / any_value(q.lrd) AS lof FROM n JOIN q o ON o.id = m.j JOIN q ON q.id = n.id GROUP BY n.id)
    SELECT id AS event_id, round(lof, 5) AS lof, lof > (SELECT quantile_cont(lof, 0.9) FROM f) AS anomaly FROM f""")
def lof_features(t):
    return rounded(an.outlier_factors(readings(t), "event_id", ["a", "b", "c"]).select("event_id", "lof", "anomaly"), 5)


@query("ano_15_ensemble", """
    WITH s AS (SELECT event_id, value AS a, user_id AS b, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS c FROM events), m AS (SELECT min(a) AS a0, max(a) AS a1, min(b) AS b0, max(b) AS b1, min(c) AS c0, max(c) AS c1 FROM s),
         e AS (SELECT event_id, (a - a0) / (a1 - a0) * 0.5 + (b - b0) / (b1 - b0) * 0.3 + (c - c0) / (c1 - c0) * 0.2 AS v FROM s, m)
    SELECT event_id, round(v, 6) AS ensemble, v > 0.5 AS anomaly FROM e""")
def ensemble(t):
    e = t.events.select("event_id", F.col("value").alias("a"), F.col("user_id").alias("b"), F.get_json_object("props", "$.k").cast("double").alias("c"))
    return rounded(an.ensemble(e, {"a": 0.5, "b": 0.3, "c": 0.2}).select("event_id", "ensemble", "anomaly"))


@query("ano_16_reconstruction_error")
def reconstruction(t):
    e = t.embeddings.select("vec_id", *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    return rounded(an.reconstruction_error(e, [f"e{i}" for i in range(64)], 3).select("vec_id", "error", "anomaly"))


@query("ano_17_metric_report", """
    WITH z AS (SELECT event_type, ts, value, abs((value - avg(value) OVER w) / (stddev_pop(value) OVER w + 1e-8)) AS score, count(*) OVER w AS total FROM events WINDOW w AS (PARTITION BY event_type)), g AS (SELECT event_type, count(*) FILTER (score > 2) AS anomalies FROM z GROUP BY 1)
    SELECT event_type, ts, value, round(score, 6) AS score, total, anomalies, CASE WHEN anomalies / total > 0.1 THEN 'high' WHEN anomalies / total > 0.05 THEN 'medium' ELSE 'low' END AS level FROM z JOIN g USING (event_type) WHERE score > 2""")
def metric_report(t):
    return rounded(an.metric_report(t.events, "event_type", "ts", "value", 2.0))


@query("ano_18_evaluation", """
    WITH c AS (SELECT count(*) FILTER (toxic = 1 AND quality = 1) AS tp, count(*) FILTER (toxic <> 1 AND quality = 1) AS fp, count(*) FILTER (toxic <> 1 AND quality <> 1) AS tn, count(*) FILTER (toxic = 1 AND quality <> 1) AS fn FROM labels),
         r AS (SELECT toxic, rank() OVER (ORDER BY quality) + (count(*) OVER (PARTITION BY quality) - 1) / 2.0 AS k FROM labels), a AS (SELECT (sum(k) FILTER (toxic = 1) - count(*) FILTER (toxic = 1) * (count(*) FILTER (toxic = 1) + 1) / 2.0) / (count(*) FILTER (toxic = 1) * count(*) FILTER (toxic <> 1)) AS auc FROM r)
    SELECT tp, fp, tn, fn, round((tp + tn) / (tp + fp + tn + fn), 6) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0), 0), 6) AS specificity, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1, round(auc::DOUBLE, 6) AS auc FROM c, a""")
def evaluation(t):
    return rounded(an.evaluate(t.labels, "toxic", "quality"))
