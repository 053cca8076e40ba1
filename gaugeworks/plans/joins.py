"""Joins on the test tables: customers are experiments, orders are shots, line items are measurements."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import aggregate as a
from gaugeworks.operators import joins as j
from gaugeworks.plans.aggregations import rounded
from gaugeworks.plans.predicates import BINDINGS, BINDINGS_SQL, MATCH_SQL
from gaugeworks.plans.registry import query
from gaugeworks.session import rows_table

STATS_SQL = """
    SELECT c_custkey, c_name, count(o_orderkey) AS shot_count, {series} AS series_count, round(avg(sqrt(o_totalprice)), 6) AS avg_value, count(*) FILTER (o_orderstatus = 'F') AS disruption_count
    FROM customer LEFT JOIN orders ON o_custkey = c_custkey {join} GROUP BY 1, 2"""


def stats(t, fan_out):
    got = j.experiment_stats(t.customer.select("c_custkey", "c_name"), t.orders.withColumn("root", F.sqrt("o_totalprice")), t.lineitem, "c_custkey", "o_custkey", "o_orderkey", "l_orderkey", "root", F.col("o_orderstatus") == "F", fan_out)
    return rounded(got, 6)


@query("joi_01_experiment_stats_fan_out", STATS_SQL.format(series="count(l_orderkey)", join="LEFT JOIN lineitem ON l_orderkey = o_orderkey"))
def fan_out(t):
    return stats(t, True)


@query("joi_01_experiment_stats", STATS_SQL.format(series="coalesce(sum(n), 0)::BIGINT", join="LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey"))
def corrected(t):
    return stats(t, False)


@query("joi_02_series_shots", """
    SELECT o_custkey, l_returnflag, count(*) AS data_points, round(avg(l_extendedprice), 7) AS mean_value, round(stddev_samp(l_extendedprice), 4) AS std_value, min(l_extendedprice) AS min_value, max(l_extendedprice) AS max_value,
           count(*) FILTER (l_suppkey % 3 = 0) AS good, count(*) FILTER (l_suppkey % 3 = 1) AS suspect, count(*) FILTER (l_suppkey % 3 = 2) AS bad
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""")
def series(t):
    df = t.lineitem.join(t.orders.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rounded(a.diagnostic_stats(df, ["o_custkey", "l_returnflag"], "l_extendedprice", F.col("l_suppkey") % 3), 7, std_value=4)


@query("joi_03_prediction_errors", """
    WITH p AS (SELECT l_orderkey + 100 AS shot, l_returnflag AS version, l_extendedprice * 3 AS predicted FROM lineitem)
    SELECT version, count(*) AS n, count(o_orderkey) AS matched, round(avg(predicted - o_totalprice), 4) AS bias, round(avg(abs(predicted - o_totalprice)), 4) AS mae FROM p LEFT JOIN orders ON shot = o_orderkey GROUP BY 1""")
def predictions(t):
    p = t.lineitem.selectExpr("l_orderkey + 100 shot", "l_returnflag version", "l_extendedprice * 3 predicted")
    shots = t.orders.selectExpr("o_orderkey shot", "o_totalprice actual")
    return rounded(j.errors_by_version(j.prediction_errors(shots, p, "shot", "actual", "predicted", "version"), "version"), 4)


@query("joi_04_aligned_columns", "SELECT p_partkey, p_name, p_size, p_retailprice FROM part")
def aligned(t):
    p = t.part
    return j.align([p.select("p_partkey", "p_name"), p.select("p_partkey", "p_size"), p.select("p_partkey", "p_retailprice")], "p_partkey")


@query("joi_05_message_routing", f"""
    WITH b AS (SELECT * FROM {BINDINGS_SQL} WHERE pattern <> '*'), m AS (SELECT event_id, event_type, queue FROM events LEFT JOIN b ON {MATCH_SQL})
    SELECT DISTINCT event_id, coalesce(queue, 'events.' || event_type) AS queue FROM m""")
def routing(t):
    b = rows_table(t.spark, [("error", "alarms"), ("p*", "sales"), ("*up", "growth"), ("c*", "sales")], "pattern string, queue string")
    return j.route(t.events, b, "event_id", "event_type")


@query("joi_05_routing_catch_all", f"""
    WITH b AS (SELECT * FROM {BINDINGS_SQL}) SELECT DISTINCT event_id, queue FROM events JOIN b ON {MATCH_SQL}""")
def routing_catch_all(t):
    return j.route(t.events, rows_table(t.spark, BINDINGS, "pattern string, queue string"), "event_id", "event_type")


@query("joi_06_run_pairing", """
    WITH e AS (SELECT event_id // 3 AS run, ts, event_id % 3 AS k, value FROM events), g AS (SELECT run, min(ts) FILTER (k = 0) AS start_ts, max(ts) FILTER (k = 2 AND value > 20) AS end_ts FROM e GROUP BY 1)
    SELECT run, start_ts, end_ts, round((epoch_us(end_ts) - epoch_us(start_ts)) / 1e6, 6) AS seconds, end_ts IS NULL AS active FROM g WHERE start_ts IS NOT NULL""")
def pairing(t):
    e = t.events.selectExpr("event_id div 3 run", "ts", "event_id % 3 k", "value")
    return rounded(j.pair_runs(e, "run", "ts", F.col("k") == 0, (F.col("k") == 2) & (F.col("value") > 20)))


@query("joi_07_span_tree", """
    WITH s AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN NULL ELSE event_id - event_id % 3 - 1 END AS parent FROM events)
    SELECT s.event_id, s.parent, s.parent IS NULL AS is_root, p.event_id IS NOT NULL AS parent_found, coalesce(c.n, 0) AS children FROM s LEFT JOIN s p ON s.parent = p.event_id LEFT JOIN (SELECT parent, count(*) AS n FROM s GROUP BY 1) c ON c.parent = s.event_id""")
def tree(t):
    s = t.events.selectExpr("event_id", "if(event_id % 10 = 0, null, event_id - event_id % 3 - 1) parent")
    return j.span_tree(s, "event_id", "parent")


@query("joi_08_version_diff", """
    WITH a AS (SELECT o_custkey AS metric, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS metric, avg(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)
    SELECT metric, round(a.v, 7) AS v1, round(b.v, 7) AS v2, round(b.v - a.v, 7) AS difference, round((b.v - a.v) / abs(a.v) * 100, 6) AS improvement FROM a FULL JOIN b USING (metric)""")
def versions(t):
    g = t.orders.groupBy(F.col("o_custkey").alias("metric"), "o_orderstatus").agg(F.avg("o_totalprice").alias("v"))
    return rounded(j.version_diff(g.filter("o_orderstatus = 'F'"), g.filter("o_orderstatus = 'O'"), "metric", "v"), 7, improvement=6)


@query("joi_09_pareto_front", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice FROM (SELECT *, max(b) OVER (ORDER BY l_extendedprice ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cheaper
      FROM (SELECT l_extendedprice, max(l_quantity) AS b FROM lineitem GROUP BY 1)) f JOIN lineitem l USING (l_extendedprice) WHERE l.l_quantity = b AND (cheaper IS NULL OR b > cheaper)""")
def pareto(t):
    return j.pareto_front(t.lineitem, "l_quantity", "l_extendedprice").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")


@query("joi_10_snapshot_drift", """
    SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'removed' ELSE 'changed' END AS change FROM customer WHERE c_custkey % 11 = 0 OR c_custkey % 7 = 0
    UNION ALL SELECT c_custkey + 10000000, 'added' FROM customer WHERE c_custkey % 13 = 0""")
def drift(t):
    c = t.customer
    after = c.filter("c_custkey % 11 <> 0").withColumn("c_acctbal", F.expr("if(c_custkey % 7 = 0, c_acctbal + 1, c_acctbal)"))
    after = after.unionByName(c.filter("c_custkey % 13 = 0").withColumn("c_custkey", F.col("c_custkey") + 10000000))
    return j.snapshot_drift(c, after, "c_custkey")


@query("joi_11_nested_diff", """
    SELECT c_custkey, 'profile.segment' AS path, c_mktsegment AS old, NULL AS new, 'removed' AS kind FROM customer WHERE c_custkey % 5 = 0
    UNION ALL SELECT c_custkey, 'profile.place.nation', c_nationkey::VARCHAR, (c_nationkey + 1)::VARCHAR, 'changed' FROM customer WHERE c_custkey % 3 = 0
    UNION ALL SELECT c_custkey, 'note', NULL, 'x', 'added' FROM customer WHERE c_custkey % 4 = 0""")
def nested(t):
    def shape(seg, nation, note):
        return t.customer.select("c_custkey", F.struct(F.expr(seg).alias("segment"), F.struct(F.expr(nation).alias("nation")).alias("place")).alias("profile"), F.expr(note).alias("note"))

    before = shape("c_mktsegment", "c_nationkey", "cast(null as string)")
    after = shape("if(c_custkey % 5 = 0, null, c_mktsegment)", "if(c_custkey % 3 = 0, c_nationkey + 1, c_nationkey)", "if(c_custkey % 4 = 0, 'x', null)")
    return j.nested_diff(before, after, "c_custkey")
