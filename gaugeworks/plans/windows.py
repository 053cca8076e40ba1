"""Windowed operators on the test tables: users are sources, events are readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import reports as rep
from gaugeworks.operators import windows as w
from gaugeworks.operators.ordered import position
from gaugeworks.plans.aggregations import OK_SQL, TARGETS_SQL, rounded, targets
from gaugeworks.plans.registry import query

K_SQL = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
WIN = "OVER (PARTITION BY user_id ORDER BY ts)"
HOLES_SQL = "(SELECT event_id, user_id, ts, CASE WHEN event_id % 3 <> 0 THEN value END AS value FROM events)"


def readings(t):
    return t.events.select("event_id", "user_id", "ts", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.get_json_object("props", "$.k").cast("double").alias("k"))


def holes(t):
    return t.events.selectExpr("event_id", "user_id", "ts", "if(event_id % 3 <> 0, value, null) value")


@query("win_01_sliding_metrics", f"""
    WITH e AS (SELECT event_id, user_id, ts, sqrt(value) AS t, {K_SQL} + pi() AS d, row_number() {WIN} AS p FROM events)
    SELECT event_id, round(avg(t) OVER f, 6) AS avg_temperature, round(stddev_pop(t) OVER f, 5) AS temp_std, round(coalesce(nullif(regr_slope(t, p) OVER f, 'nan'::DOUBLE), 0), 5) + 0.0::DOUBLE AS temp_trend,
           round(avg(d) OVER f, 6) AS avg_density, round(stddev_pop(d) OVER f, 5) AS density_std, round(coalesce(nullif(regr_slope(d, p) OVER f, 'nan'::DOUBLE), 0), 5) + 0.0::DOUBLE AS density_trend,
           round(avg(t * d * 1.38) OVER f, 6) AS avg_beta, round(max(t * d * 1.38) OVER f, 6) AS max_beta, count(*) OVER f AS window_size, count(*) OVER f / 20 AS fill,
           round(avg(t * d * t) OVER f, 4) AS avg_triple_product, round(max(t * d * t) OVER f, 4) AS max_triple_product
    FROM e WINDOW f AS (PARTITION BY user_id ORDER BY ts ROWS 19 PRECEDING)""")
def sliding(t):
    got = w.sliding_metrics(readings(t).withColumns({"value": F.sqrt("value"), "k": F.col("k") + F.pi()}), ["user_id"], ["ts", "event_id"], "value", "k", "value", n=20)
    got = got.withColumns({"avg_beta": F.col("avg_beta") * 1e28, "max_beta": F.col("max_beta") * 1e28})
    return rounded(got.drop("user_id", "ts", "us", "value", "k"), 6, temp_std=5, density_std=5, temp_trend=5, density_trend=5, avg_triple_product=4, max_triple_product=4, fill=12)


@query("win_02_window_slope", "WITH e AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events) SELECT event_id, round(coalesce(nullif(regr_slope(value, p) OVER (PARTITION BY user_id ORDER BY ts ROWS 9 PRECEDING), 'nan'::DOUBLE), 0), 5) + 0.0::DOUBLE AS slope FROM e")
def slopes(t):
    return rounded(w.slope(readings(t), ["user_id"], ["ts", "event_id"], "value", 10).select("event_id", "slope"), 5)


@query("win_03_gradient", f"""
    SELECT event_id, round(CASE WHEN lag(value) {WIN} IS NULL THEN lead(value) {WIN} - value WHEN lead(value) {WIN} IS NULL THEN value - lag(value) {WIN} ELSE (lead(value) {WIN} - lag(value) {WIN}) / 2 END, 6) AS gradient FROM events""")
def gradient(t):
    return rounded(w.gradient(readings(t), ["user_id"], ["ts", "event_id"], "value").select("event_id", "gradient"))


@query("win_04_rate_rules", f"SELECT event_id, coalesce(value - lag(value) {WIN} > 40 OR value - lag(value) {WIN} < -60, false) AS rate_flag FROM events")
def rates(t):
    return w.rate_flags(readings(t), ["user_id"], ["ts", "event_id"], "value", 40, 60).select("event_id", "rate_flag")


@query("win_05_lag_features", "SELECT event_id, " + ", ".join(f"coalesce(lag(value, {k}) {WIN}, first(value) {WIN}) AS lag_{k}" for k in (1, 2, 3, 6, 12, 24)) + " FROM events")
def lags(t):
    return w.lag_features(readings(t), ["user_id"], ["ts", "event_id"], "value").drop("user_id", "ts", "us", "value", "k")


@query("win_06_rolling", "SELECT event_id, " + ", ".join(f"round(avg(value) OVER w{k}, 6) AS mean_{k}, round(coalesce(stddev_samp(value) OVER w{k}, 0), 5) AS std_{k}" for k in (3, 6, 12, 24)) + " FROM events WINDOW " + ", ".join(f"w{k} AS (PARTITION BY user_id ORDER BY ts ROWS {k - 1} PRECEDING)" for k in (3, 6, 12, 24)))
def rolling(t):
    return rounded(w.rolling(readings(t), ["user_id"], ["ts", "event_id"], "value").drop("user_id", "ts", "us", "value", "k"), 6, **{f"std_{k}": 5 for k in (3, 6, 12, 24)})


@query("win_07_sequences", "SELECT event_id, value, history FROM (SELECT event_id, value, list(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS history FROM events) WHERE len(history) = 5")
def sequences(t):
    return w.sequences(readings(t), ["user_id"], ["ts", "event_id"], "value", 5).select("event_id", "value", "history")


@query("win_08_fill", f"""
    SELECT event_id, last_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS forward, first_value(value IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS backward FROM {HOLES_SQL}""")
def fills(t):
    both = holes(t).withColumnsRenamed({"value": "forward"}).withColumn("backward", F.col("forward"))
    both = w.fill(w.fill(both, ["user_id"], ["ts", "event_id"], "forward"), ["user_id"], ["ts", "event_id"], "backward", "backward")
    return both.select("event_id", "forward", "backward")


@query("win_09_interpolate", f"""
    WITH h AS (SELECT *, row_number() {WIN} AS p FROM {HOLES_SQL}),
         n AS (SELECT *, last_value(value IGNORE NULLS) OVER a AS pv, last_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER a AS pp, first_value(value IGNORE NULLS) OVER b AS nv, first_value(CASE WHEN value IS NOT NULL THEN p END IGNORE NULLS) OVER b AS np
               FROM h WINDOW a AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY user_id ORDER BY ts ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT event_id, round(CASE WHEN value IS NOT NULL THEN value WHEN pv IS NULL THEN NULL WHEN nv IS NULL THEN pv ELSE pv + (nv - pv) * ((p - pp) / (np - pp)) END, 6) AS value FROM n""")
def interpolated(t):
    return rounded(w.interpolate(holes(t), ["user_id"], ["ts", "event_id"], "value").select("event_id", "value"))


@query("win_10_dedup_resample", """
    WITH d AS (SELECT event_type, date_trunc('hour', ts)::TIMESTAMP AS h, arg_min(value, event_id) AS value FROM events GROUP BY 1, 2), m AS (SELECT event_type, date_trunc('day', h)::TIMESTAMP AS bucket, avg(value) AS value FROM d GROUP BY 1, 2),
         g AS (SELECT event_type, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 DAY)) AS bucket FROM m GROUP BY 1)
    SELECT event_type, bucket, round(value, 6) AS value FROM g LEFT JOIN m USING (event_type, bucket)""")
def resampled(t):
    e = t.events.select("event_type", F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("h"), "event_id", "value")
    first = w.first_per_time(e, ["event_type"], "h", "event_id")
    return rounded(w.resample(first, ["event_type"], "h", "value", "day").select("event_type", "bucket", "value"))


EPISODES_SQL = f"""(WITH r AS (SELECT event_type, ts, value, NOT ({OK_SQL}) AS bad FROM events JOIN {TARGETS_SQL} USING (event_type)),
    c AS (SELECT *, CASE WHEN bad IS DISTINCT FROM lag(bad) OVER (PARTITION BY event_type ORDER BY ts) THEN 1 ELSE 0 END AS turn FROM r), i AS (SELECT *, sum(turn) OVER (PARTITION BY event_type ORDER BY ts) AS island FROM c),
    g AS (SELECT event_type, island, bool_or(bad) AS bad, min(ts) AS start_ts, max(ts) AS last_ts, count(*) AS readings, arg_max(value, ts) AS last_value FROM i GROUP BY 1, 2),
    n AS (SELECT *, lead(start_ts) OVER (PARTITION BY event_type ORDER BY island) AS end_ts FROM g)
    SELECT event_type, start_ts, last_ts, end_ts, readings, last_value, round((epoch_us(end_ts) - epoch_us(start_ts)) / 1e6, 6) AS seconds FROM n WHERE bad)"""


def violation_episodes(t):
    r = t.events.join(targets(t), "event_type")
    bad = ~rep.complies(F.col("value"), F.col("comparison"), F.col("target"))
    return w.episodes(r.withColumn("bad", bad), ["event_type"], ["ts", "event_id"], F.col("bad"), "value")


@query("win_11_violation_episodes", f"SELECT * FROM {EPISODES_SQL}")
def episodes(t):
    return rounded(violation_episodes(t))


@query("agg_31_violation_summary", f"""
    WITH g AS (SELECT event_type, count(*) AS violations, round(coalesce(sum(seconds), 0), 4) AS downtime_seconds, count(*) FILTER (last_value <= 100) AS unacknowledged, count(*) FILTER (end_ts IS NULL) AS active FROM {EPISODES_SQL} GROUP BY 1)
    SELECT * FROM g UNION ALL SELECT 'all', sum(violations)::BIGINT, round(sum(downtime_seconds), 4), sum(unacknowledged)::BIGINT, sum(active)::BIGINT FROM g""")
def violation_summary(t):
    return rounded(rep.violation_summary(violation_episodes(t), "event_type", "seconds", F.col("last_value") > 100, F.col("end_ts").isNull()), 4)


@query("win_12_anomaly_periods", f"""
    WITH c AS (SELECT *, CASE WHEN (value > 60) IS DISTINCT FROM lag(value > 60) {WIN} THEN 1 ELSE 0 END AS turn FROM events), i AS (SELECT *, sum(turn) {WIN} AS island FROM c)
    SELECT user_id, min(ts) AS start, max(ts) AS "end", count(*) AS n FROM i WHERE value > 60 GROUP BY user_id, island""")
def periods(t):
    return w.flagged_periods(t.events, ["user_id"], ["ts", "event_id"], F.col("value") > 60)


@query("win_13_alert_cooldown", """
    WITH RECURSIVE c AS (SELECT event_id, user_id % 5 AS source, ts FROM events WHERE value > 60),
         f AS (SELECT source, min(ts) AS ts FROM c GROUP BY 1 UNION ALL SELECT source, (SELECT min(c.ts) FROM c WHERE c.source = f.source AND c.ts > f.ts + INTERVAL 3 HOUR) FROM f WHERE f.ts IS NOT NULL)
    SELECT c.event_id, c.source, f.ts IS NOT NULL AS fired FROM c LEFT JOIN f ON c.source = f.source AND c.ts = f.ts""")
def cooldown(t):
    e = readings(t).selectExpr("event_id", "user_id % 5 source", "us", "value")
    return w.cooldown_alerts(e, ["source"], "us", "event_id", F.col("value") > 60, 3 * 3600).select("event_id", "source", "fired")


@query("win_14_alert_states", """
    WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, value > 40 AS on_, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
         s AS (SELECT user_id, 0::BIGINT AS p, false AS active, NULL::BIGINT AS last, NULL::BIGINT AS event_id, ''::VARCHAR AS action FROM (SELECT DISTINCT user_id FROM e)
               UNION ALL SELECT e.user_id, e.p,
                 CASE WHEN e.us - s.last < 36000000000 THEN s.active WHEN e.on_ THEN true ELSE false END,
                 CASE WHEN e.us - s.last < 36000000000 THEN s.last WHEN e.on_ AND NOT s.active THEN e.us ELSE s.last END, e.event_id,
                 CASE WHEN e.us - s.last < 36000000000 THEN 'skip' WHEN e.on_ AND NOT s.active THEN 'fire' WHEN e.on_ THEN 'active' WHEN s.active THEN 'resolve' ELSE 'idle' END
               FROM s JOIN e ON e.user_id = s.user_id AND e.p = s.p + 1)
    SELECT event_id, user_id, action FROM s WHERE p > 0""")
def alert_states(t):
    return w.alert_states(readings(t), ["user_id"], "us", "event_id", F.col("value") > 40, 36000).select("event_id", "user_id", "action")


@query("win_15_latest_rows", "SELECT event_id, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC) AS p FROM events) WHERE p <= 3")
def latest(t):
    return w.latest_rows(t.events, ["user_id"], ["ts", "event_id"], 3).select("event_id", "user_id", "value")


@query("win_16_every_third", "SELECT event_id, user_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS place FROM events WHERE event_type = 'error') WHERE place % 3 = 0")
def third(t):
    return w.every_nth(t.events.filter("event_type = 'error'"), ["user_id"], ["ts", "event_id"], 3).select("event_id", "user_id", "place")


@query("win_17_milestones", "SELECT event_id, place FROM (SELECT event_id, row_number() OVER (ORDER BY ts) AS place FROM events) WHERE place % 1000 = 0")
def milestones(t):
    return w.every_nth(t.events, [], ["ts", "event_id"], 1000).select("event_id", "place")


@query("win_18_event_rate", """
    WITH e AS (SELECT event_id, event_type, epoch_us(ts) AS us FROM events), s AS (SELECT *, count(*) OVER f AS recent, min(us) OVER f AS a FROM e WINDOW f AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW))
    SELECT event_id, recent, round(recent / greatest((us - a) / 1e6, 1.0), 9) AS rate FROM s""")
def event_rate(t):
    e = t.events.select("event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return rounded(w.event_rate(e, ["event_type"], "us", "event_id", 3600).select("event_id", "recent", "rate"), 9)


@query("win_18_minute_counts", "SELECT event_type, date_trunc('minute', ts)::TIMESTAMP AS minute, count(*) AS n FROM events GROUP BY 1, 2")
def minute_counts(t):
    return t.events.groupBy("event_type", F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("minute")).agg(F.count(F.lit(1)).alias("n"))


RISK_SQL = """(WITH e AS (SELECT event_id, user_id % 3 AS who, user_id % 4 AS addr, event_type, ts, epoch_us(ts) AS us, event_type IN ('error', 'click') AS bad FROM events),
    h AS (SELECT *, list(struct_pack(t := us, b := bad)) OVER (PARTITION BY who ORDER BY us ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS seen,
                 count(*) OVER (PARTITION BY addr ORDER BY us RANGE BETWEEN 21599999999 PRECEDING AND CURRENT ROW) - 1 AS earlier FROM e)
    SELECT *, coalesce(len(list_filter(seen, lambda x: x.b AND us - x.t < 3600000000)), 0)::INT AS recent_failures FROM h)"""


def risks(t):
    e = t.events.select("event_id", "event_type", "ts", (F.col("user_id") % 3).alias("who"), (F.col("user_id") % 4).alias("addr"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return w.burst_risk(w.failure_risk(e, "who", "us", "event_id", F.col("event_type").isin("error", "click")), "addr", "us", "event_id", 21600, 20)


@query("win_19_failure_risk", f"SELECT event_id, recent_failures, CASE WHEN recent_failures >= 3 THEN 0.3::DOUBLE ELSE 0::DOUBLE END AS failure_risk FROM {RISK_SQL}")
def failures(t):
    return risks(t).select("event_id", "recent_failures", "failure_risk")


@query("win_20_burst_risk", f"SELECT event_id, earlier, CASE WHEN earlier > 20 THEN 0.4::DOUBLE ELSE 0::DOUBLE END AS burst_risk FROM {RISK_SQL}")
def bursts(t):
    return risks(t).select("event_id", "earlier", "burst_risk")


@query("win_21_audit_risk", f"""
    SELECT event_id, round(least(1.0::DOUBLE, (CASE event_type WHEN 'error' THEN 0.4 WHEN 'signup' THEN 0.2 ELSE 0.1 END)::DOUBLE * (CASE event_type WHEN 'error' THEN 2.0 WHEN 'purchase' THEN 1.5 WHEN 'view' THEN 0.5 ELSE 1.0 END)::DOUBLE
      + CASE WHEN recent_failures >= 3 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN earlier > 20 THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN hour(ts) < 6 OR hour(ts) > 22 THEN 0.2::DOUBLE ELSE 0 END), 6) AS risk FROM {RISK_SQL}""")
def risk(t):
    base = F.expr("cast(case event_type when 'error' then 0.4 when 'signup' then 0.2 end as double)")
    severity = F.expr("case event_type when 'error' then 'critical' when 'purchase' then 'high' when 'view' then 'low' else 'medium' end")
    score = w.audit_risk(base, severity, F.col("failure_risk") + F.col("burst_risk"), F.hour("ts"))
    return rounded(risks(t).select("event_id", score.alias("risk")))


@query("win_22_early_detection", """
    WITH l AS (SELECT toxic AS t, quality AS p, lag(quality) OVER (ORDER BY doc_id) AS b FROM labels)
    SELECT round(avg((t = 1 AND p <> 1)::INT), 6) AS missed_rate, round(avg((t <> 1 AND p = 1)::INT), 6) AS false_alarm_rate, round(count(*) FILTER (t = 1 AND b = 1) / count(*) FILTER (t = 1), 6) AS early_rate FROM l""")
def early(t):
    return rounded(w.warning_rates(t.labels, ["doc_id"], "toxic", "quality"))


@query("win_23_dequeue_order", "SELECT o_orderkey, row_number() OVER (ORDER BY left(o_orderpriority, 1)::INT ASC, o_orderdate, o_orderkey) AS place FROM orders")
def dequeue(t):
    o = t.orders.select("o_orderkey", "o_orderdate", (-F.substring("o_orderpriority", 1, 1).cast("int")).alias("prio"))
    return w.dequeue_order(o, "prio", ["o_orderdate", "o_orderkey"]).select("o_orderkey", "place")


@query("win_24_sequence_number", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS seq FROM events")
def sequence_number(t):
    return position(t.events, ["user_id"], ["ts", "event_id"], "seq").select("event_id", "seq")


@query("win_25_token_bucket", """
    WITH RECURSIVE e AS (SELECT event_id, user_id % 25 AS who, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id % 25 ORDER BY ts) AS p FROM events),
      s AS (SELECT who, 0::BIGINT AS p, 0::BIGINT AS us, NULL::BIGINT AS event_id, 1.0::DOUBLE AS m, 2.0::DOUBLE AS h, 10.0::DOUBLE AS d, ''::VARCHAR AS verdict FROM (SELECT DISTINCT who FROM e)
            UNION ALL SELECT who, p, us, event_id, CASE WHEN m >= 1 AND h >= 1 AND d >= 1 THEN m - 1 ELSE m END, CASE WHEN m >= 1 AND h >= 1 AND d >= 1 THEN h - 1 ELSE h END, CASE WHEN m >= 1 AND h >= 1 AND d >= 1 THEN d - 1 ELSE d END,
                   CASE WHEN m < 1 THEN 'minute' WHEN h < 1 THEN 'hour' WHEN d < 1 THEN 'day' ELSE 'allowed' END
            FROM (SELECT e.who, e.p, e.us, e.event_id, least(1.0::DOUBLE, s.m + dt * (1 / 60::DOUBLE)) AS m, least(2.0::DOUBLE, s.h + dt * (2 / 3600::DOUBLE)) AS h, least(10.0::DOUBLE, s.d + dt * (10 / 86400::DOUBLE)) AS d
                  FROM (SELECT s.*, e.event_id AS ne, e.us AS nus, CASE WHEN s.p = 0 THEN 0.0::DOUBLE ELSE (e.us - s.us) / 1e6 END AS dt FROM s JOIN e ON e.who = s.who AND e.p = s.p + 1) s JOIN e ON e.event_id = s.ne))
    SELECT event_id, verdict FROM s WHERE p > 0""")
def token_bucket(t):
    e = readings(t).selectExpr("event_id", "user_id % 25 who", "us")
    return w.rate_limit(e, ["who"], "us", "event_id", {"minute": 1, "hour": 2, "day": 10}).select("event_id", "verdict")


@query("win_26_partial_sums", "WITH m AS (SELECT user_id, avg(value) AS m FROM events GROUP BY 1) SELECT event_id, round(sum(value - m) OVER (PARTITION BY user_id ORDER BY ts), 8) + 0.0::DOUBLE AS partial_sum FROM events JOIN m USING (user_id)")
def partial(t):
    return rounded(w.partial_sums(t.events.select("event_id", "user_id", "ts", "value"), ["user_id"], ["ts", "event_id"], "value").select("event_id", "partial_sum"), 8)
