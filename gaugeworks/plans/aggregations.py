"""Aggregations, cubes and operations reports on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import aggregate as a
from gaugeworks.operators import reports as rep
from gaugeworks.operators.cube import Cube
from gaugeworks.operators.ordered import quantiles
from gaugeworks.plans.registry import query, r
from gaugeworks.session import rows_table


def rounded(df, digits=6, **special):
    """Round every double column."""
    return df.select(*[r(F.col(f"`{c}`"), special.get(c, digits)).alias(c) if k == "double" else F.col(f"`{c}`") for c, k in df.dtypes])


@query("agg_01_experiment_performance", """
    SELECT o_custkey, count(*) AS total_shots, round(avg(o_totalprice), 7) AS avg_q, round(stddev_samp(o_totalprice), 4) AS std_q, max(o_totalprice) AS max_q, min(o_totalprice) AS min_q,
           round(avg(o_totalprice / 3), 7) AS avg_confinement, round(avg(o_totalprice / 7), 7) AS avg_beta, count(*) FILTER (o_orderstatus = 'F') AS disruption_count,
           round(count(*) FILTER (o_orderstatus = 'F') / count(*), 7) AS disruption_rate, round(avg(o_orderkey), 7) AS avg_duration, count(*) FILTER (o_totalprice / 5e5 >= 0.8) AS high_quality_shots
    FROM orders GROUP BY 1""")
def performance(t):
    df = t.orders.selectExpr("*", "o_totalprice / 3 conf", "o_totalprice / 7 beta", "o_totalprice / 5e5 quality")
    return rounded(a.experiment_performance(df, ["o_custkey"], "o_totalprice", "conf", "beta", F.col("o_orderstatus") == "F", "o_orderkey", "quality"), 7, std_q=4)


@query("agg_02_diagnostic_stats", """
    SELECT l_returnflag, l_linenumber, count(*) AS data_points, round(avg(l_extendedprice), 4) AS mean_value, round(stddev_samp(l_extendedprice), 4) AS std_value, min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value,
           count(*) FILTER (l_suppkey % 3 = 0) AS good, count(*) FILTER (l_suppkey % 3 = 1) AS suspect, count(*) FILTER (l_suppkey % 3 = 2) AS bad
    FROM lineitem GROUP BY 1, 2""")
def diagnostics(t):
    return rounded(a.diagnostic_stats(t.lineitem, ["l_returnflag", "l_linenumber"], "l_extendedprice", F.col("l_suppkey") % 3), 4)


@query("agg_03_daily_trend", """
    WITH d AS (SELECT date_trunc('day', o_orderdate)::TIMESTAMP AS day, count(*) AS n, avg(o_totalprice) AS avg_value, stddev_samp(o_totalprice) AS std_value, min(o_totalprice) AS min_value, max(o_totalprice) AS max_value
               FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY 1),
         p AS (SELECT *, row_number() OVER (ORDER BY day) AS day_index FROM d)
    SELECT day, n, round(avg_value, 7) AS avg_value, round(std_value, 4) AS std_value, min_value, max_value, day_index, round((SELECT regr_slope(avg_value, day_index) FROM p), 4) AS slope FROM p""")
def daily(t):
    return rounded(a.daily_trend(t.orders, "o_orderdate", "o_totalprice", "1995-01-01"), 7, slope=4, std_value=4)


DESCRIBE = """count({c}) AS "count", round(avg({c}), 4) AS mean, round(median({c}), 4) AS median, round(coalesce(stddev_samp({c}), 0), 4) AS std, round(coalesce(var_samp({c}), 0), 2) AS variance, min({c}) AS "min", max({c}) AS "max",
    round(max({c}) - min({c}), 4) AS "range", round(quantile_cont({c}, 0.25), 4) AS q1, round(quantile_cont({c}, 0.75), 4) AS q3, round(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25), 4) AS iqr"""


@query("agg_04_descriptive_stats", f"""
    WITH f AS (SELECT event_type, value, count(*) AS n FROM events GROUP BY 1, 2),
         m AS (SELECT event_type, arg_min(value, (-n, value)) AS v, max(n) AS n FROM f GROUP BY 1)
    SELECT s.*, CASE WHEN m.n > 1 THEN m.v END AS mode FROM (SELECT event_type, {DESCRIBE.format(c='value')} FROM events GROUP BY 1) s JOIN m USING (event_type)""")
def descriptive(t):
    return rounded(a.describe(t.events, "value", ["event_type"]), 4, variance=2)


@query("agg_05_pair_correlation", """
    WITH c AS (SELECT l_returnflag, corr(l_quantity, l_extendedprice) AS k FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round(k, 6) AS correlation, round(k * k, 6) AS r_squared, CASE WHEN abs(k) > 0.7 THEN 'strong' WHEN abs(k) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength FROM c""")
def pair(t):
    return rounded(a.pair_correlation(t.lineitem, "l_quantity", "l_extendedprice", ["l_returnflag"]))


NUMS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MATRIX = " UNION ALL ".join(f"SELECT '{x}' AS a, '{y}' AS b, round({'1.0::DOUBLE' if x == y else f'corr({x}, {y})'}, 6) + 0.0::DOUBLE AS correlation FROM {'(SELECT 1)' if x == y else 'lineitem'}" for x in NUMS for y in NUMS)


@query("agg_06_correlation_matrix", MATRIX)
def matrix(t):
    return rounded(a.correlation_matrix(t.lineitem, NUMS))


@query("agg_07_spearman", """
    WITH r AS (SELECT rank() OVER (ORDER BY l_quantity) + (count(*) OVER (PARTITION BY l_quantity) - 1) / 2.0 AS x, rank() OVER (ORDER BY l_extendedprice) + (count(*) OVER (PARTITION BY l_extendedprice) - 1) / 2.0 AS y FROM lineitem)
    SELECT round(corr(x, y), 6) AS spearman FROM r""")
def spearman(t):
    return rounded(a.spearman(t.lineitem, "l_quantity", "l_extendedprice"))


@query("agg_08_kendall", """
    WITH f AS (SELECT l_quantity AS x, l_discount + 0.0 AS y, count(*)::DOUBLE AS w FROM lineitem GROUP BY 1, 2),
         p AS (SELECT sum(a.w * b.w * sign(a.x - b.x) * sign(a.y - b.y)) / 2 AS s FROM f a, f b),
         tx AS (SELECT sum(w * (w - 1) / 2) AS v FROM (SELECT sum(w) AS w FROM f GROUP BY x)), ty AS (SELECT sum(w * (w - 1) / 2) AS v FROM (SELECT sum(w) AS w FROM f GROUP BY y)),
         n AS (SELECT sum(w) * (sum(w) - 1) / 2 AS v FROM f)
    SELECT round(p.s / sqrt((n.v - tx.v) * (n.v - ty.v)), 6) + 0.0::DOUBLE AS tau_b FROM p, tx, ty, n""")
def kendall(t):
    return rounded(a.kendall(t.lineitem.selectExpr("l_quantity", "l_discount + 0.0 d"), "l_quantity", "d"))


@query("agg_09_top_correlated", """
    SELECT * FROM (SELECT 'l_quantity' AS feature, round(corr(l_quantity, l_extendedprice), 6) AS correlation, round(abs(corr(l_quantity, l_extendedprice)), 6) AS strength FROM lineitem
    UNION ALL SELECT 'l_discount', round(corr(l_discount, l_extendedprice), 6), round(abs(corr(l_discount, l_extendedprice)), 6) FROM lineitem
    UNION ALL SELECT 'l_tax', round(corr(l_tax, l_extendedprice), 6), round(abs(corr(l_tax, l_extendedprice)), 6) FROM lineitem) ORDER BY strength DESC LIMIT 2""")
def top(t):
    return rounded(a.top_correlated(t.lineitem, "l_extendedprice", NUMS, 2))


@query("agg_10_linear_trend", """
    WITH s AS (SELECT event_type, regr_count(value, x) AS n, regr_slope(value, x) AS slope, regr_intercept(value, x) AS intercept, corr(value, x) AS k, regr_sxx(value, x) AS sxx, regr_syy(value, x) AS syy
               FROM (SELECT event_type, value, (epoch_us(ts) - (SELECT epoch_us(min(ts)) FROM events)) / 1e6 / 86400 AS x FROM events) GROUP BY 1)
    SELECT event_type, n::BIGINT AS n, round(slope, 6) AS slope, round(intercept, 6) AS intercept, round(k, 6) AS r, round(k * k, 6) AS r_squared, round(sqrt((1 - k * k) * syy / ((n - 2) * sxx)), 6) AS stderr,
           CASE WHEN slope > 0 THEN 'increasing' WHEN slope < 0 THEN 'decreasing' ELSE 'stable' END AS direction, CASE WHEN abs(k) > 0.7 THEN 'strong' WHEN abs(k) > 0.3 THEN 'moderate' ELSE 'weak' END AS strength FROM s""")
def trend(t):
    first = a.scalar_row(t.events.agg(F.unix_micros(F.min("ts").cast("timestamp")).alias("t0")))
    x = (F.unix_micros(F.col("ts").cast("timestamp")) - first["t0"]) / 1e6 / 86400
    return rounded(a.linear_trend(t.events, x, F.col("value"), ["event_type"]))


@query("agg_11_quantile_fences", """
    SELECT l_returnflag, round(q1, 7) AS l_extendedprice_q1, round(q3, 7) AS l_extendedprice_q3, round(q3 - q1, 7) AS l_extendedprice_iqr, round(q1 - 1.5 * (q3 - q1), 7) AS l_extendedprice_lower, round(q3 + 1.5 * (q3 - q1), 7) AS l_extendedprice_upper
    FROM (SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem GROUP BY 1)""")
def fences(t):
    return rounded(a.fences(t.lineitem, ["l_extendedprice"], keys=["l_returnflag"]), 7)


@query("agg_12_quality_score", """
    WITH e AS (SELECT user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE round(value) END AS v FROM events), d AS (SELECT count(*) AS u FROM (SELECT DISTINCT * FROM e))
    SELECT count(*) AS rows, count(*) FILTER (user_id IS NULL) AS user_id_missing, count(*) FILTER (event_type IS NULL) AS event_type_missing, count(*) FILTER (v IS NULL) AS v_missing,
           count(*) FILTER (v <= 1) AS low_violations, count(*) FILTER (v > 1e9) AS high_violations, count(*) - (SELECT u FROM d) AS duplicate_rows, count(*) FILTER (v IS NULL) AS missing_total,
           round(1 - (count(*) FILTER (v IS NULL) / (count(*) * 3) + (count(*) - (SELECT u FROM d)) / count(*) + 1 / 3), 6) AS quality_score FROM e""")
def quality(t):
    e = t.events.selectExpr("user_id", "event_type", "if(event_id % 7 = 0, null, round(value)) v")
    return rounded(a.quality(e, {"low": F.col("v") <= 1, "high": F.col("v") > 1e9}))


@query("agg_13_profile", """
    WITH e AS (SELECT user_id, event_type, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events)
    SELECT 'user_id' AS "column", count(*) AS rows, count(*) FILTER (user_id IS NULL) AS missing, min(user_id)::DOUBLE AS min, max(user_id)::DOUBLE AS max, round(avg(user_id), 6) AS mean FROM e
    UNION ALL SELECT 'event_type', count(*), count(*) FILTER (event_type IS NULL), NULL, NULL, NULL FROM e
    UNION ALL SELECT 'value', count(*), count(*) FILTER (value IS NULL), min(value), max(value), round(avg(value), 6) FROM e""")
def profile(t):
    return rounded(a.profile(t.events.selectExpr("user_id", "event_type", "if(event_id % 7 = 0, null, value) value")))


@query("agg_14_constants_infinities", """
    SELECT 'flat' AS "column", true AS constant, 0::BIGINT AS infinite UNION ALL SELECT 'p_size', (SELECT count(DISTINCT p_size) <= 1 FROM part), 0
    UNION ALL SELECT 'ratio', false, (SELECT count(*) FILTER (p_partkey % 11 = 0) FROM part)""")
def constants(t):
    df = t.part.selectExpr("1.0D flat", "p_size", "if(p_partkey % 11 = 0, double('infinity'), p_retailprice) ratio")
    return a.constants_and_infinities(df, ["flat", "p_size", "ratio"])


@query("agg_15_group_stats", """
    SELECT o_orderstatus, round(avg(o_totalprice), 4) AS mean, round(stddev_samp(o_totalprice), 4) AS std, count(*) AS count, round(median(o_totalprice), 4) AS median FROM orders GROUP BY 1""")
def groups(t):
    return rounded(a.group_stats(t.orders, ["o_orderstatus"], "o_totalprice"), 4)


@query("agg_16_attainment", """
    SELECT event_type, round(avg((value >= 1)::INT), 6) AS share_1, round(count(*) FILTER (value >= 1) * 0.1::DOUBLE, 6) AS seconds_1, round(avg((value >= 5)::INT), 6) AS share_5, round(count(*) FILTER (value >= 5) * 0.1::DOUBLE, 6) AS seconds_5,
           round(avg((value >= 10)::INT), 6) AS share_10, round(count(*) FILTER (value >= 10) * 0.1::DOUBLE, 6) AS seconds_10 FROM events GROUP BY 1""")
def attainment(t):
    return rounded(a.attainment(t.events, "value", [1, 5, 10], keys=["event_type"]))


def star(t):
    """Order facts with segment, region, nation and year."""
    return (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("c_mktsegment").alias("segment"), F.col("r_name").alias("region"), F.col("n_name").alias("nation"), F.year("o_orderdate").alias("year"), "o_orderdate", F.col("o_totalprice").alias("price"), F.col("o_orderkey").alias("orders")))


STAR = """(SELECT c_mktsegment AS segment, r_name AS region, n_name AS nation, year(o_orderdate)::INT AS year, o_orderdate, o_totalprice AS price, o_orderkey AS orders
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


def cube(t):
    return Cube(star(t), ["segment", "region", "year"], ["price", "orders"], {"price": "sum", "orders": "count"})


@query("agg_17_slice_dice", f"SELECT nation, year, price FROM {STAR} WHERE segment = 'BUILDING' AND region = 'ASIA' AND year IN (1996, 1997)")
def slice_dice(t):
    return cube(t).dice({"region": "ASIA", "year": [1996, 1997]}).slice("segment", "BUILDING").data.select("nation", "year", "price")


@query("agg_18_roll_up", f"SELECT segment, region, round(sum(price), 2) AS price, count(orders) AS orders FROM {STAR} GROUP BY 1, 2")
def roll_up(t):
    return rounded(cube(t).roll_up("year").data, 2)


@query("agg_18_roll_up_totals", f"SELECT segment, region, year, round(sum(price), 2) AS price, count(orders) AS orders FROM {STAR} GROUP BY ROLLUP (segment, region, year)")
def roll_up_totals(t):
    return rounded(cube(t).all_totals(), 2)


@query("agg_19_drill_down", f"SELECT segment, date_trunc('quarter', o_orderdate)::TIMESTAMP AS quarter, round(sum(price), 2) AS price, count(orders) AS orders FROM {STAR} GROUP BY 1, 2")
def drill_down(t):
    return rounded(Cube(star(t), ["segment"], ["price", "orders"], {"orders": "count"}).drill_down("o_orderdate", "quarter").data, 2)


@query("agg_20_pivot", """
    SELECT o_orderpriority, round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 0), 2) AS "F", round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 0), 2) AS "O", round(coalesce(sum(o_totalprice) FILTER (o_orderstatus = 'X'), 0), 2) AS "X"
    FROM orders GROUP BY 1""")
def pivot(t):
    return rounded(Cube(t.orders, ["o_orderpriority"], ["o_totalprice"]).pivot(["o_orderpriority"], "o_orderstatus", ["F", "O", "X"], "o_totalprice"), 2)


@query("agg_21_metric_summary", """
    SELECT event_type, count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(sum(value), 2) AS sum, arg_max(value, ts) AS latest, min(ts) AS first_ts, max(ts) AS last_ts, round(median(value), 4) AS median
    FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-25' GROUP BY 1""")
def metrics(t):
    return rounded(rep.metric_summary(t.events, "event_type", "value", "ts", "2024-01-05", "2024-01-25"), 6, sum=2, median=4)


@query("agg_22_operation_profile", """
    SELECT event_type, count(*) AS count, round(sum(value), 2) AS total, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, arg_max(value, ts) AS latest FROM events GROUP BY 1""")
def operations(t):
    return rounded(rep.operation_profile(t.events, "event_type", "value", "ts"), 6, total=2)


@query("agg_22_operation_summary", """
    SELECT count(*) AS successful, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, min(value) AS min, max(value) AS max, (SELECT count(*) FROM events) AS total, round(count(*) / (SELECT count(*) FROM events), 6) AS success_rate,
           round(median(value), 4) AS median, round(quantile_cont(value, 0.95), 4) AS p95 FROM events WHERE event_type <> 'error'""")
def operation_summary(t):
    return rounded(rep.operation_summary(t.events, "value", F.col("event_type") != "error"), 6, median=4, p95=4)


@query("agg_23_run_history", """
    SELECT l_suppkey, count(*) AS training_runs, round(avg(l_extendedprice), 4) AS l_extendedprice_mean, round(stddev_pop(l_extendedprice), 4) AS l_extendedprice_std, min(l_extendedprice) AS l_extendedprice_min, max(l_extendedprice) AS l_extendedprice_max,
           round(avg(l_quantity), 4) AS l_quantity_mean, round(stddev_pop(l_quantity), 4) AS l_quantity_std, min(l_quantity) AS l_quantity_min, max(l_quantity) AS l_quantity_max,
           arg_max(l_extendedprice, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS latest_l_extendedprice, arg_max(l_quantity, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice)) AS latest_l_quantity FROM lineitem GROUP BY 1""")
def runs(t):
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return rounded(rep.run_history(t.lineitem, "l_suppkey", order, "l_extendedprice", "l_quantity"), 4)


@query("agg_24_query_log_summary", """
    WITH q AS (SELECT value / 10 AS s, (event_id % 4) / 4.0 AS hit FROM events), o AS (SELECT s, row_number() OVER (ORDER BY s) AS p, count(*) OVER () AS n FROM q)
    SELECT count(*) AS total, round(avg(s), 6) AS avg, round(min(s), 6) AS min, round(max(s), 6) AS max, round(avg(CASE WHEN hit > 0 THEN hit END)::DOUBLE, 6) AS avg_hit_rate, count(*) FILTER (s < 0.1) AS excellent, count(*) FILTER (s >= 0.1 AND s < 0.5) AS good,
           count(*) FILTER (s >= 0.5 AND s < 2) AS fair, count(*) FILTER (s >= 2 AND s < 10) AS poor, count(*) FILTER (s >= 10) AS critical, (SELECT round(s, 6) FROM o WHERE p = floor(n * 0.95::DOUBLE) + 1) AS p95, round(median(s), 6) AS median FROM q""")
def query_log(t):
    q = t.events.selectExpr("value / 10 s", "(event_id % 4) / 4.0D hit")
    return rounded(rep.query_log_summary(q, "s", F.col("hit")), 6)


@query("agg_25_hourly_trend", """
    SELECT date_trunc('hour', ts)::TIMESTAMP AS hour, count(*) AS count, round(avg(value), 6) AS avg, max(value) AS max, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS avg_memory FROM events GROUP BY 1""")
def hourly(t):
    return rounded(rep.hourly(t.events, "ts", "value", F.get_json_object("props", "$.k").cast("double")))


@query("agg_26_event_metrics", """
    WITH b AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC) AS back, count(*) OVER (PARTITION BY event_type) AS n FROM events)
    SELECT event_type, count(*) AS count, count(*) FILTER (CAST(json_extract_string(props, '$.k') AS INT) > 80) AS errors, round(avg(value), 6) AS avg_time, max(ts) AS last_ts,
           round(count(*) FILTER (CAST(json_extract_string(props, '$.k') AS INT) > 80) / count(*), 6) AS error_rate,
           round(sum(CASE WHEN back <= 1000 THEN value * pow(2.0::DOUBLE, -(CASE WHEN back = n THEN back - 1 ELSE back END)) END), 6) AS halving_avg FROM b GROUP BY 1""")
def event_metrics(t):
    return rounded(rep.event_metrics(t.events, "event_type", "value", "ts", F.get_json_object("props", "$.k").cast("int") > 80, tie=["event_id"]))


@query("agg_27_error_summary", """
    WITH g AS (SELECT user_id::VARCHAR AS who, count(*) AS events, count(*) FILTER (event_type = 'error') AS errors FROM events GROUP BY 1)
    SELECT who, events, errors, round(errors / events, 6) AS error_rate FROM g WHERE errors > 0 UNION ALL SELECT 'all', sum(events)::BIGINT, sum(errors)::BIGINT, round(sum(errors) / sum(events), 6) FROM g""")
def errors(t):
    return rounded(rep.error_summary(t.events.selectExpr("cast(user_id as string) who", "event_type"), "who", F.col("event_type") == "error"))


@query("agg_28_processing_percentiles", """
    WITH o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS p, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value > 0)
    SELECT event_type, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, max(value) FILTER (p = floor(n * 0.95::DOUBLE) + 1) AS p95, max(value) FILTER (p = floor(n * 0.99::DOUBLE) + 1) AS p99, round(median(value), 4) AS median FROM o GROUP BY 1""")
def percentiles(t):
    return rounded(rep.processing_percentiles(t.events, "value", ["event_type"]), 6, median=4)


TARGETS = [("view", "<", 90.0), ("click", "<=", 400.0), ("error", ">=", 0.05), ("purchase", ">", 0.5), ("absent", "<", 1.0)]
TARGETS_SQL = "(VALUES ('view', '<', 90.0::DOUBLE), ('click', '<=', 400.0), ('error', '>=', 0.05), ('purchase', '>', 0.5), ('absent', '<', 1.0)) t(event_type, comparison, target)"
OK_SQL = "CASE comparison WHEN '<' THEN value < target WHEN '<=' THEN value <= target WHEN '>' THEN value > target ELSE value >= target END"
SLA_SQL = f"""(SELECT t.event_type, comparison, target, count(value) AS total, count(*) FILTER ({OK_SQL}) AS compliant, arg_max(value, ts) AS latest, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max,
    round(coalesce(count(*) FILTER ({OK_SQL}) * 100.0::DOUBLE / nullif(count(value), 0), 0), 6) AS compliance,
    CASE WHEN count(value) = 0 THEN 'unknown' WHEN count(*) FILTER ({OK_SQL}) * 100.0::DOUBLE / count(value) >= 99.9 THEN 'healthy' WHEN count(*) FILTER ({OK_SQL}) * 100.0::DOUBLE / count(value) >= 99 THEN 'warning' ELSE 'violated' END AS status
    FROM {TARGETS_SQL} LEFT JOIN {{events}} USING (event_type) GROUP BY ALL)"""


def targets(t):
    return rows_table(t.spark, TARGETS, "event_type string, comparison string, target double")


@query("agg_29_sla_compliance", f"SELECT * FROM {SLA_SQL.format(events='events')}")
def compliance(t):
    return rounded(rep.sla_compliance(t.events, targets(t), "event_type", "value", "ts"))


@query("agg_30_sla_overall", f"SELECT count(*) AS targets, count(*) FILTER (status = 'healthy') AS healthy, count(*) FILTER (status = 'violated') AS violated, round(avg((status = 'healthy')::INT) * 100, 6) AS health_percentage FROM {SLA_SQL.format(events='events')}")
def overall(t):
    return rounded(rep.sla_overall(rep.sla_compliance(t.events, targets(t), "event_type", "value", "ts")))


@query("agg_30_sla_report", f"""
    WITH e AS (SELECT * FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-17'),
         o AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS p, count(*) OVER (PARTITION BY event_type) AS n FROM e),
         q AS (SELECT event_type, max(value) FILTER (p = floor(n * 0.95::DOUBLE) + 1) AS p95, max(value) FILTER (p = floor(n * 0.99::DOUBLE) + 1) AS p99 FROM o GROUP BY 1)
    SELECT s.event_type, total, compliant, compliance, coalesce(avg, 0) AS avg, coalesce(min, 0) AS min, coalesce(max, 0) AS max, coalesce(p95, 0) AS p95, coalesce(p99, 0) AS p99 FROM {SLA_SQL.format(events='e')} s LEFT JOIN q USING (event_type)""")
def sla_report(t):
    return rounded(rep.sla_report(t.events, targets(t), "event_type", "value", "ts", "2024-01-10", "2024-01-17"))


@query("agg_32_trace_analytics", """
    WITH s AS (SELECT event_id // 10 AS trace, event_type, value / 1000 AS secs, event_type = 'error' AS bad FROM events), t AS (SELECT trace, bool_or(bad) AS bad, sum(secs) AS secs FROM s GROUP BY 1)
    SELECT 'trace' AS event_type, count(*) AS count, count(*) FILTER (bad) AS errors, round(avg(secs), 6) AS avg_duration, round(min(secs), 6) AS min_duration, round(max(secs), 6) AS max_duration, round(count(*) FILTER (bad) / count(*), 6) AS error_rate FROM t
    UNION ALL SELECT event_type, count(*), count(*) FILTER (bad), round(sum(secs) / count(*), 6), round(min(secs), 6), round(max(secs), 6), round(count(*) FILTER (bad) / count(*), 6) FROM s GROUP BY 1""")
def traces(t):
    s = t.events.selectExpr("event_id div 10 trace", "event_type", "value / 1000 secs")
    return rounded(rep.trace_analytics(s, "trace", "event_type", F.col("secs"), F.col("event_type") == "error"))


@query("agg_33_log_trend", """
    SELECT date_trunc('day', ts)::TIMESTAMP AS day, count(*) AS count, round(avg(CASE WHEN event_id % 5 = 0 THEN 0 ELSE value END), 6) AS avg_response, round(avg(CASE WHEN event_id % 3 = 0 THEN 0 ELSE value / 2 END), 6) AS avg_cpu FROM events GROUP BY 1""")
def log_trend(t):
    e = t.events.selectExpr("ts", "if(event_id % 5 = 0, null, value) response", "if(event_id % 3 = 0, null, value / 2) cpu")
    return rounded(rep.log_trend(e, F.date_trunc("day", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("day"), ["response", "cpu"]))


KPI_ROWS = [("view", 60.0, 50.0, 40.0, "higher"), ("click", 45.0, 40.0, 30.0, "higher"), ("error", 40.0, 45.0, 50.0, "lower"), ("purchase", 45.0, 49.0, 49.5, "lower"), ("signup", 0.0, 1.0, 2.0, "higher")]
KPI_SQL = """(WITH k AS (SELECT event_type, avg(value) AS v FROM events GROUP BY 1)
    SELECT event_type, v, target, warning, critical, direction, coalesce(v / nullif(target, 0) * 100, 0) AS performance, CASE direction
      WHEN 'higher' THEN CASE WHEN v >= target THEN 'excellent' WHEN v >= warning THEN 'good' WHEN v >= critical THEN 'warning' ELSE 'critical' END
      ELSE CASE WHEN v <= target THEN 'excellent' WHEN v <= warning THEN 'good' WHEN v <= critical THEN 'warning' ELSE 'critical' END END AS status
    FROM k JOIN (VALUES ('view', 60.0::DOUBLE, 50.0::DOUBLE, 40.0::DOUBLE, 'higher'), ('click', 45.0, 40.0, 30.0, 'higher'), ('error', 40.0, 45.0, 50.0, 'lower'), ('purchase', 45.0, 49.0, 49.5, 'lower'), ('signup', 0.0, 1.0, 2.0, 'higher')) r(event_type, target, warning, critical, direction) USING (event_type))"""


def kpis(t):
    table = rows_table(t.spark, KPI_ROWS, "event_type string, target double, warning double, critical double, direction string")
    return rep.kpi_status(t.events.groupBy("event_type").agg(F.avg("value").alias("v")), table, "event_type", "v")


@query("agg_34_kpi_status", f"SELECT event_type, round(v, 6) AS v, target, warning, critical, direction, round(performance, 6) AS performance, status FROM {KPI_SQL}")
def kpi_status(t):
    return rounded(kpis(t))


@query("agg_34_kpi_summary", f"""SELECT count(*) AS kpis, round(avg(performance), 6) AS average_performance, count(*) FILTER (status = 'excellent') AS excellent, count(*) FILTER (status = 'good') AS good,
    count(*) FILTER (status = 'warning') AS warning, count(*) FILTER (status = 'critical') AS critical FROM {KPI_SQL}""")
def kpi_summary(t):
    return rounded(rep.kpi_summary(kpis(t)))


@query("agg_35_executive_summary", """
    WITH g AS (SELECT o_orderpriority AS name, avg(o_totalprice) AS v FROM orders GROUP BY 1), p AS (SELECT name, v / CASE WHEN name < '2' THEN 300000 WHEN name < '3' THEN 270000 WHEN name < '4' THEN 200000 WHEN name < '5' THEN 400000 END AS performance FROM g),
         k AS (SELECT name, performance, CASE WHEN performance >= 1 THEN 'excellent' WHEN performance >= 0.9 THEN 'good' WHEN performance >= 0.8 THEN 'warning' ELSE 'critical' END AS status FROM p WHERE performance IS NOT NULL)
    SELECT name, round(performance, 6) AS performance, status FROM k UNION ALL SELECT 'overall', round(avg(performance), 6), NULL FROM k""")
def executive(t):
    g = t.orders.groupBy(F.col("o_orderpriority").alias("name")).agg(F.avg("o_totalprice").alias("v"))
    g = g.withColumn("goal", F.expr("case when name < '2' then 300000 when name < '3' then 270000 when name < '4' then 200000 when name < '5' then 400000 end"))
    return rounded(rep.executive_summary(g, "name", "v", "goal"))


@query("agg_36_alert_severities", """
    SELECT user_id, count(*) AS active, count(*) FILTER (value > 150) AS critical, count(*) FILTER (value > 80 AND value <= 150) AS warning, count(*) FILTER (value <= 80) AS info FROM events GROUP BY 1""")
def severities(t):
    return rep.severity_counts(t.events.selectExpr("user_id", "case when value > 150 then 'critical' when value > 80 then 'warning' else 'info' end severity"), "severity", ["user_id"])


@query("agg_37_api_usage", "SELECT user_id, count(*) AS total, count(*) FILTER (ts > TIMESTAMP '2024-01-20' - INTERVAL 1 HOUR) AS last_hour, max(ts) AS last_used FROM events GROUP BY 1")
def usage(t):
    return rep.api_usage(t.events, "user_id", "ts", "2024-01-20")


@query("agg_38_fusion_summary", """
    SELECT round(avg(l_quantity), 6) AS avg_temperature, max(l_quantity) AS max_temperature, round(avg(l_extendedprice), 4) AS avg_density, round(avg(l_tax), 6) AS avg_confinement_time, round(avg(l_quantity * l_extendedprice * l_tax), 2) AS avg_triple_product,
           round(max(l_quantity * l_extendedprice * l_tax), 4) AS max_triple_product, avg(l_quantity) < 10 AS low_temperature, avg(l_quantity * l_extendedprice * l_tax) < 1e21 AS below_ignition FROM lineitem""")
def fusion(t):
    return rounded(a.fusion_summary(t.lineitem, "l_quantity", "l_extendedprice", "l_tax"), 4, avg_temperature=6, avg_confinement_time=6, avg_triple_product=2)


@query("agg_39_histogram", """
    WITH m AS (SELECT min(value) AS lo, (max(value) - min(value)) / 50 AS w FROM events), h AS (SELECT least(floor((value - lo) / w), 49)::INT AS bin, count(*) AS n FROM events, m GROUP BY 1)
    SELECT b::INT AS bin, round(lo + b * w, 6) AS left_edge, coalesce(n, 0) AS n FROM range(0, 50) g(b) CROSS JOIN m LEFT JOIN h ON bin = b""")
def histogram(t):
    return rounded(a.histogram(t.events, "value", 50))


@query("agg_40_run_stats", """
    SELECT o_orderpriority, count(*) AS runs, round(avg((o_orderstatus = 'F')::INT), 6) AS success_rate, sum(o_custkey)::BIGINT AS records, round(avg(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 4) AS mean_seconds, max(o_orderdate) AS last_run FROM orders GROUP BY 1""")
def run_stats(t):
    runs = t.orders.withColumn("status", F.when(F.col("o_orderstatus") == "F", "completed").otherwise("failed"))
    return rounded(rep.run_stats(runs, "o_orderpriority", "status", "o_custkey", "o_totalprice", "o_orderdate"), 6, mean_seconds=4)


@query("agg_41_queue_stats", """
    SELECT o_orderpriority, count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS "o_orderstatus_F", count(*) FILTER (o_orderstatus = 'O') AS "o_orderstatus_O", count(*) FILTER (o_orderstatus = 'P') AS "o_orderstatus_P" FROM orders GROUP BY 1""")
def queues(t):
    return rep.counts_wide(t.orders, ["o_orderpriority"], "o_orderstatus", ["F", "O", "P"])


@query("agg_42_dashboard", f"""
    WITH s AS (SELECT count(*)::DOUBLE AS total, avg(value) AS mean, max(value) AS peak FROM events), k AS (SELECT count(*)::DOUBLE AS kpis, avg(performance) AS average_performance FROM {KPI_SQL})
    SELECT 'metrics' AS section, 'total' AS metric, total AS value FROM s UNION ALL SELECT 'metrics', 'mean', round(mean, 6) FROM s UNION ALL SELECT 'metrics', 'peak', peak FROM s
    UNION ALL SELECT 'kpis', 'kpis', kpis FROM k UNION ALL SELECT 'kpis', 'average_performance', round(average_performance, 6) FROM k
    UNION ALL SELECT 'trend', 'slope', round(regr_slope(value, event_id) * 1e6, 4) FROM events""")
def dashboard(t):
    trend = a.linear_trend(t.events, F.col("event_id"), F.col("value")).select((F.col("slope") * 1e6).alias("slope"))
    return rounded(rep.dashboard({
        "metrics": t.events.agg(F.count(F.lit(1)).alias("total"), F.avg("value").alias("mean"), F.max("value").alias("peak")),
        "kpis": rep.kpi_summary(kpis(t)).select("kpis", "average_performance"), "trend": rounded(trend, 4)}))


@query("agg_43_endpoint_metrics", """
    SELECT CASE WHEN user_id % 2 = 0 THEN 'GET' ELSE 'POST' END || ':' || event_type AS endpoint, count(*) AS count, round(avg(value), 6) AS avg, min(value) AS min, max(value) AS max, count(*) FILTER (event_type = 'error' OR value > 150) AS errors FROM events GROUP BY 1""")
def endpoints(t):
    e = t.events.selectExpr("if(user_id % 2 = 0, 'GET', 'POST') method", "event_type", "case when event_type = 'error' then 500 when value > 150 then 404 else 200 end status", "value")
    return rounded(rep.endpoint_metrics(e, "method", "event_type", "status", "value"))


@query("agg_44_tuning_summary", """
    SELECT p_type, count(*) AS total_runs, max(p_retailprice) AS best_score, arg_max(p_brand, (p_retailprice, p_partkey)) AS best_method, arg_max(p_name, (p_retailprice, p_partkey)) AS best_params FROM part GROUP BY 1""")
def tuning(t):
    return rep.tuning_summary(t.part, "p_type", "p_brand", "p_retailprice", "p_name", F.col("p_partkey"))


@query("agg_46_test_summary", """
    SELECT count(*) AS total, count(*) FILTER (event_type <> 'error') AS passed, count(*) FILTER (event_type = 'error') AS failed, round(count(*) FILTER (event_type <> 'error') * 100.0::DOUBLE / count(*), 6) AS success_rate, round(sum(value), 2) AS total_seconds, round(avg(value), 6) AS mean_seconds FROM events""")
def tests(t):
    return rounded(rep.test_summary(t.events, F.col("event_type") != "error", "value"), 6, total_seconds=2)


@query("agg_47_band_status", """
    WITH l AS (SELECT event_type, arg_max(value, ts) AS latest FROM events GROUP BY 1)
    SELECT event_type, latest, CASE WHEN latest BETWEEN gl AND gh THEN 'good' WHEN latest BETWEEN wl AND wh THEN 'warning' ELSE 'critical' END AS status
    FROM l JOIN (VALUES ('view', 10, 20, 8, 60), ('click', 8, 15, 5, 20), ('error', 0, 500, 0, 900), ('signup', 5, 6, 4, 90)) b(event_type, gl, gh, wl, wh) USING (event_type)""")
def bands(t):
    b = rows_table(t.spark, [("view", 10.0, 20.0, 8.0, 60.0), ("click", 8.0, 15.0, 5.0, 20.0), ("error", 0.0, 500.0, 0.0, 900.0), ("signup", 5.0, 6.0, 4.0, 90.0)], "event_type string, good_lo double, good_hi double, warn_lo double, warn_hi double")
    return rep.band_status(t.events, b, "event_type", "value", "ts")
