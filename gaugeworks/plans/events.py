"""Event-log operators, query-log reports and scalar functions on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import eventlog as ev
from gaugeworks.plans.aggregations import rounded
from gaugeworks.plans.registry import query, r
from gaugeworks.session import scalar_row


@query("evt_01_snapshot", "SELECT user_id, event_type, arg_max(event_id, event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def snapshot(t):
    return ev.snapshot(t.events.select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id")


@query("evt_02_replay", "SELECT user_id, count(*) AS events, round(sum(value), 4) AS total, arg_max(value, event_id) AS last_value, max(event_id) AS last_seq FROM events GROUP BY 1")
def replay(t):
    mid = scalar_row(t.events.agg((F.max("event_id") / 2).alias("m")))["m"]
    model = ev.project(t.events.filter(F.col("event_id") <= mid), ["user_id"], "event_id", "value")
    return rounded(ev.project_increment(model, t.events, ["user_id"], "event_id", "value"), 4)


DERIVED = """(SELECT event_id, 'safety_threshold_exceeded' AS kind, 'temperature' AS parameter, value, 100.0::DOUBLE AS threshold, 'critical' AS severity FROM events WHERE value > 100
    UNION ALL SELECT event_id, 'emergency_shutdown', 'temperature', value, 100.0, 'critical' FROM events WHERE value > 100 * 1.1::DOUBLE
    UNION ALL SELECT event_id, 'safety_threshold_exceeded', 'density', user_id::DOUBLE, 120.0, 'warning' FROM events WHERE user_id > 120)"""


def derived(t):
    return ev.safety_events(t.events, "value", "user_id", 100.0, 120.0).select("event_id", "event.*")


@query("evt_03_safety_events", f"SELECT * FROM {DERIVED}")
def safety(t):
    return derived(t)


@query("evt_04_protocols", f"""
    SELECT event_id, kind, parameter, protocol FROM {DERIVED} JOIN (VALUES ('temperature', 'coolant_injection'), ('temperature', 'magnetic_field_reduction'), ('density', 'gas_injection'), ('density', 'pumping_increase'), ('instability', 'feedback_control')) p(parameter, protocol) USING (parameter)""")
def protocols(t):
    return ev.protocols(derived(t), "parameter").select("event_id", "kind", "parameter", "protocol")


@query("evt_05_retrain_trigger", "SELECT user_id, round(avg(value), 6) AS score FROM events GROUP BY 1 HAVING avg(value) < 0.8::DOUBLE * 60")
def retrain(t):
    return rounded(ev.retrain(t.events.groupBy("user_id").agg(F.avg("value").alias("score")), "score", 60.0))


@query("evt_06_dead_letters", "SELECT event_id, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) > 80 THEN 'dead_letter' ELSE 'pending' END AS status FROM events")
def dead(t):
    return ev.dead_letters(t.events.withColumn("retries", F.get_json_object("props", "$.k").cast("int")), "retries", F.lit(80)).select("event_id", "status")


@query("evt_07_json_round_trip", "SELECT event_id, event_type, value, ts, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def round_trip(t):
    whole = F.struct("event_id", "event_type", "value", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), F.from_json("props", "map<string,bigint>").alias("data"))
    back = t.events.select(F.from_json(F.to_json(whole), "event_id bigint, event_type string, value double, ts string, data map<string,bigint>").alias("e")).select("e.*")
    return back.select("event_id", "event_type", "value", F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("data")["k"].alias("k"))


K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"
ALERTS_SQL = f"""(SELECT event_id, 'slow_query' AS type, CASE WHEN value > 160 THEN 'high' ELSE 'medium' END AS severity FROM events WHERE value > 80 UNION ALL SELECT event_id, 'high_memory', 'high' FROM events WHERE {K} > 90
    UNION ALL SELECT event_id, 'low_cache_hit_rate', 'medium' FROM events WHERE {K} / 100 < 0.1 UNION ALL SELECT event_id, 'inefficient_scan', 'medium' FROM events WHERE user_id > 0 AND value / user_id > 10)"""


def alerts(t):
    e = t.events.withColumns({"k": F.get_json_object("props", "$.k").cast("double")}).withColumn("hit", F.col("k") / 100)
    return ev.query_alerts(e, "value", "k", "hit", "value", "user_id", 80.0, 90.0, 0.1, 10.0)


@query("evt_08_query_alerts", f"SELECT * FROM {ALERTS_SQL}")
def query_alerts(t):
    return alerts(t).select("event_id", "event.type", "event.severity")


# Query texts derived from every event row.
TEXT = """concat(case event_type when 'view' then 'SELECT * FROM readings' when 'click' then 'SELECT DISTINCT user FROM readings WHERE lower(name) = 1' when 'signup' then 'INSERT INTO readings VALUES (1)'
    when 'error' then 'select a, (select max(b) from t) from readings where a = 1 or b = 2' else 'UPDATE readings SET a = 1 WHERE name LIKE ''%x''' end, case when user_id % 3 = 0 then ' LIMIT 10' else '' end, repeat(' JOIN other USING (k)', cast(event_id % 8 as int)))"""
TEXT_SQL = f"(SELECT event_id, {TEXT} AS q FROM events)"
LINT_SQL = f"""(SELECT event_id, 'missing_where_clause' AS rule, 'Performance' AS category, 'High' AS severity FROM {TEXT_SQL} WHERE q ILIKE '%select%from%' AND q NOT ILIKE '%where%'
    UNION ALL SELECT event_id, 'select_star', 'Performance', 'Medium' FROM {TEXT_SQL} WHERE q ILIKE '%select *%' UNION ALL SELECT event_id, 'no_limit', 'Performance', 'Medium' FROM {TEXT_SQL} WHERE q ILIKE '%select%from%' AND q NOT ILIKE '%limit%'
    UNION ALL SELECT event_id, 'function_in_where', 'Indexing', 'High' FROM {TEXT_SQL} WHERE regexp_matches(q, '(?i)where.*\\w+\\(') UNION ALL SELECT event_id, 'like_leading_wildcard', 'Indexing', 'High' FROM {TEXT_SQL} WHERE q ILIKE '%like ''\\%%' ESCAPE '\\'
    UNION ALL SELECT event_id, 'or_in_where', 'Indexing', 'Medium' FROM {TEXT_SQL} WHERE q ILIKE '%where% or %' UNION ALL SELECT event_id, 'subquery_in_select', 'Performance', 'Medium' FROM {TEXT_SQL} WHERE q ILIKE '%select%(select%'
    UNION ALL SELECT event_id, 'distinct_without_reason', 'Performance', 'Low' FROM {TEXT_SQL} WHERE q ILIKE '%select distinct%' UNION ALL SELECT event_id, 'too_many_joins', 'Performance', 'High' FROM {TEXT_SQL} WHERE event_id % 8 > 5)"""


def findings(t):
    return ev.lint(t.events.select("event_id", F.expr(TEXT).alias("q")), "q")


@query("evt_09_query_lint", f"SELECT * FROM {LINT_SQL}")
def lint(t):
    return findings(t).select("event_id", "event.*")


@query("evt_09_query_types", "SELECT CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'purchase' THEN 'UPDATE' ELSE 'SELECT' END AS type, count(*) AS n FROM events GROUP BY 1")
def types(t):
    return t.events.groupBy(ev.query_type(F.expr(TEXT)).alias("type")).agg(F.count(F.lit(1)).alias("n"))


@query("agg_45_query_report", f"""
    SELECT 'suggestion_category' AS section, category AS name, count(*) AS n FROM {LINT_SQL} GROUP BY 2 UNION ALL SELECT 'suggestion_severity', severity, count(*) FROM {LINT_SQL} GROUP BY 2 UNION ALL SELECT 'alert', type, count(*) FROM {ALERTS_SQL} GROUP BY 2
    UNION ALL SELECT 'recommendation', v, 1 FROM (VALUES ('add_indexes'), ('review_patterns'), ('optimize_slow_queries'), ('optimize_memory'), ('improve_caching'), ('address_high_severity')) x(v)""")
def report(t):
    a, f = alerts(t), findings(t)

    def counted(df, section, col):
        return df.groupBy(F.col(f"event.{col}").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(section).alias("section"), "name", "n")

    mean = scalar_row(t.events.agg(F.avg("value").alias("v")))["v"]
    says = ev.query_report(a, f, mean).select(F.lit("recommendation").alias("section"), F.col("recommendation").alias("name"), F.lit(1).cast("bigint").alias("n"))
    return counted(f, "suggestion_category", "category").unionByName(counted(f, "suggestion_severity", "severity")).unionByName(counted(a, "alert", "type")).unionByName(says)


@query("sca_01_strings", """
    SELECT p_partkey, starts_with(p_name, 'red') AS prefix, suffix(p_name, 'ring') AS suffix, contains(p_name, 'wid') AS has, replace(p_name, ' ', '_') AS replaced, p_name ILIKE '%RING' AS ilike, upper(left(p_brand, 1)) || lower(substr(p_brand, 2)) AS title,
           p_brand || ' size ' || p_size AS formatted FROM part""")
def strings(t):
    n = F.col("p_name")
    return t.part.select("p_partkey", n.startswith("red").alias("prefix"), n.endswith("ring").alias("suffix"), n.contains("wid").alias("has"), F.replace(n, F.lit(" "), F.lit("_")).alias("replaced"), n.ilike("%RING").alias("ilike"),
                         F.initcap("p_brand").alias("title"), F.format_string("%s size %d", "p_brand", "p_size").alias("formatted"))


@query("sca_02_regex", "SELECT p_partkey, regexp_matches(p_name, '^(?:r[a-z]+)') AS anchored, regexp_matches(p_type, '(?i)econ') AS loose, regexp_extract(p_brand, '#([0-9]+)', 1) AS number FROM part")
def regex(t):
    return t.part.select("p_partkey", F.col("p_name").rlike("^(?:r[a-z]+)").alias("anchored"), F.col("p_type").rlike("(?i)econ").alias("loose"), F.regexp_extract("p_brand", "#([0-9]+)", 1).alias("number"))


@query("sca_03_datetime", """
    SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS iso, date_trunc('day', ts)::TIMESTAMP AS day, hour(ts)::INT AS hour, epoch_us(ts) AS micros, ts + INTERVAL 90 MINUTE AS later, epoch_us(ts) // 60000000 AS minute,
           round((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) / 1e6, 6) AS seconds FROM events""")
def datetimes(t):
    ts = F.col("ts").cast("timestamp")
    iso = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return t.events.select("event_id", iso.alias("iso"), F.date_trunc("day", F.to_timestamp(iso)).cast("timestamp_ntz").alias("day"), F.hour("ts").alias("hour"), F.unix_micros(ts).alias("micros"), (F.col("ts") + F.make_interval(mins=F.lit(90))).alias("later"),
                           F.floor(F.unix_micros(ts) / 60000000).alias("minute"), r((F.unix_micros(ts) - F.unix_micros(F.lit("2024-01-01").cast("timestamp"))) / 1e6).alias("seconds"))


@query("sca_04_math", "SELECT event_id, round(sqrt(value), 6) AS root, round(value * value, 4) AS square, round(abs(value - 50), 2) AS distance, round(log2(value + 1), 6) AS bits, round(sin(value), 6) AS wave, least(value, 40.0::DOUBLE) AS low, greatest(value, 40.0::DOUBLE) AS high, round(value / nullif(user_id, 0), 9) AS ratio FROM events")
def maths(t):
    v = F.col("value")
    return t.events.select("event_id", r(F.sqrt(v)).alias("root"), r(F.pow(v, F.lit(2)), 4).alias("square"), r(F.abs(v - 50), 2).alias("distance"), r(F.log2(v + 1)).alias("bits"), r(F.sin(v)).alias("wave"), F.least(v, F.lit(40.0)).alias("low"), F.greatest(v, F.lit(40.0)).alias("high"), r(F.try_divide(v, F.col("user_id")), 9).alias("ratio"))


@query("sca_05_arrays", """
    SELECT vec_id, list_contains(list_transform(embedding, lambda x: x > 0.2), true) AS any_high, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)), 5) AS norm, len(list_filter(embedding, lambda x: x > 0))::INT AS positives,
           round(list_sum(list_transform(embedding[1:3], lambda x: x::DOUBLE)), 5) + 0.0::DOUBLE AS head FROM embeddings""")
def arrays(t):
    e = F.col("embedding")
    d = F.transform(e, lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", F.exists(e, lambda x: x > 0.2).alias("any_high"), r(F.aggregate(d, F.lit(0.0), lambda a, x: a + x * x), 5).alias("norm"), F.size(F.filter(e, lambda x: x > 0)).alias("positives"), r(F.aggregate(F.slice(d, 1, 3), F.lit(0.0), lambda a, x: a + x), 5).alias("head"))


@query("sca_06_maps_json", """
    SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, 0::BIGINT AS absent, '{"reading":' || json_extract_string(props, '$.k') || '}' AS renamed, len(json_keys(props)) AS fields, octet_length(encode(props)) AS bytes FROM events""")
def maps(t):
    m = F.from_json("props", "map<string,bigint>")
    renamed = F.to_json(F.map_concat(F.map_filter(m, lambda k, v: k != "k"), F.create_map(F.lit("reading"), F.element_at(m, "k"))))
    return t.events.select("event_id", F.element_at(m, "k").alias("k"), F.coalesce(F.try_element_at(m, F.lit("gone")), F.lit(0)).cast("bigint").alias("absent"), renamed.alias("renamed"), F.size(F.expr("json_object_keys(props)")).cast("bigint").alias("fields"), F.octet_length("props").cast("bigint").alias("bytes"))


@query("sca_07_hash", "SELECT doc_id, sha256(text) AS hash FROM documents")
def hashes(t):
    return t.documents.select("doc_id", F.sha2("text", 256).alias("hash"))


@query("sca_08_conditionals", "SELECT event_id, CASE WHEN value > 100 THEN 'high' WHEN value > 50 THEN 'mid' ELSE 'low' END AS band, coalesce(nullif(user_id, 0), -1) AS user, (value > 50)::INT + (user_id > 100)::INT AS votes FROM events")
def conditionals(t):
    v = F.col("value")
    return t.events.select("event_id", F.when(v > 100, "high").when(v > 50, "mid").otherwise("low").alias("band"), F.coalesce(F.nullif("user_id", F.lit(0)), F.lit(-1)).cast("bigint").alias("user"), ((v > 50).cast("int") + (F.col("user_id") > 100).cast("int")).alias("votes"))
