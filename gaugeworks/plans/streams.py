"""Streaming queries over the event table as a file stream, and declared flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks import flows
from gaugeworks.operators import eventlog as ev
from gaugeworks.plans.aggregations import rounded
from gaugeworks.plans import windows  # noqa: F401  registers the batch forms whose SQL is shared
from gaugeworks.plans.registry import ORACLES, query
from gaugeworks.sources.external import decode, encode
from gaugeworks.sources.files import Source, scratch
from gaugeworks.streaming import core as c
from gaugeworks.streaming import operators as s


def stream(t):
    return c.file_stream(t.spark, t.folder, t.events.schema, "events.parquet")


def micros(df):
    return df.withColumn("us", F.unix_micros(F.col("ts").cast("timestamp")))


K = "CAST(json_extract_string(props, '$.k') AS DOUBLE)"


@query("str_01_message_processing", f"""
    SELECT event_id, round(value * {K}, 4) AS product, list_filter([CASE WHEN value < 5 THEN 'low_temperature' END, CASE WHEN value > 100 THEN 'high_temperature' END, CASE WHEN {K} < 10 THEN 'low_density' END], lambda x: x IS NOT NULL) AS alerts FROM events WHERE event_id % 13 <> 0""")
def messages(t):
    wire = encode(stream(t).select("event_id", F.expr("if(event_id % 13 = 0, null, value)").alias("temperature"), F.get_json_object("props", "$.k").cast("double").alias("density")), "event_id")
    m = decode(wire, "event_id bigint, temperature double, density double")
    got = s.process_messages(m, "temperature", "density", {"low_temperature": F.col("temperature") < 5, "high_temperature": F.col("temperature") > 100, "low_density": F.col("density") < 10})
    return rounded(c.drain(got.select("event_id", "product", "alerts"), "messages"), 4)


@query("str_02_sliding_state", ORACLES["win_01_sliding_metrics"])
def sliding(t):
    src = stream(t).select("event_id", "user_id", "ts", F.sqrt("value").alias("t"), (F.get_json_object("props", "$.k").cast("double") + F.pi()).alias("d"))
    out, state = scratch(t.spark, "sliding"), scratch(t.spark, "sliding-state")
    c.drain_batches(src, "sliding", s.sliding_batches(t.spark, src.schema, ["user_id"], ["ts", "event_id"], "t", "d", "t", 20, out, state))
    got = t.spark.read.parquet(out).drop("epoch", "user_id", "ts", "t", "d")
    got = got.withColumns({"avg_beta": F.col("avg_beta") * 1e28, "max_beta": F.col("max_beta") * 1e28})
    return rounded(got, 6, temp_std=5, density_std=5, temp_trend=5, density_trend=5, avg_triple_product=4, max_triple_product=4, fill=12)


@query("str_03_batch_metrics", f"""
    SELECT (SELECT arg_max(event_id, ts) FROM events) AS last_id, count(*) AS batch_size, round(avg(value), 6) AS avg_value, min(value) AS min_value, max(value) AS max_value FROM events""")
def batch_metrics(t):
    out = scratch(t.spark, "batches")
    c.drain_batches(stream(t).select("event_id", "ts", "value"), "batches", lambda b, e: c.write_batch(s.batch_metrics(b, "ts", ["value"]), out, e))
    return rounded(t.spark.read.parquet(out).select(F.col("last.event_id").alias("last_id"), "batch_size", "avg_value", "min_value", "max_value"))


@query("str_04_alert_cooldown", ORACLES["win_13_alert_cooldown"])
def cooldown(t):
    src = micros(stream(t)).selectExpr("event_id", "user_id % 5 source", "us", "value")
    out, state = scratch(t.spark, "alerts"), scratch(t.spark, "alerts-state")
    c.drain_batches(src, "alerts", s.cooldown_batches(t.spark, src.schema, ["source"], "us", "event_id", F.col("value") > 60, 3 * 3600, out, state))
    return t.spark.read.parquet(out).select("event_id", "source", "fired")


@query("str_05_event_windows", """
    WITH m AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events), g AS (SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2)
    SELECT start, start + INTERVAL 1 HOUR AS "end", event_type, n, total FROM g, m WHERE start + INTERVAL 1 HOUR <= mark""")
def event_windows(t):
    w = s.windows(c.event_time(stream(t), "ts"), "ts", ["event_type"], "value", "1 hour")
    got = c.drain(w, "windows")
    return rounded(got.select(F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "event_type", "n", "total"), 4)


@query("str_06_rate_limiter", ORACLES["win_25_token_bucket"])
def limiter(t):
    src = micros(stream(t)).selectExpr("event_id", "user_id % 25 who", "us")
    with c.keyed_state(t.spark):
        return c.drain(s.rate_limit_stream(src, "who", "us", "event_id", {"minute": 1, "hour": 2, "day": 10}), "limiter").select("event_id", "verdict")


@query("str_07_deduplicate", "SELECT event_id, event_type, value FROM events")
def dedup(t):
    twice = c.event_time(stream(t).unionByName(stream(t)), "ts", "40 days")
    return c.drain(s.deduplicate(twice, "event_id").select("event_id", "event_type", "value"), "dedup")


@query("str_08_sessions", """
    WITH b AS (SELECT *, CASE WHEN ts - lag(ts) OVER w < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM (SELECT user_id % 20 AS source, ts FROM events) WINDOW w AS (PARTITION BY source ORDER BY ts)), i AS (SELECT *, sum(new) OVER (PARTITION BY source ORDER BY ts) AS k FROM b),
         g AS (SELECT source, min(ts) AS start, max(ts) + INTERVAL 2 HOUR AS "end", count(*) AS n FROM i GROUP BY source, k)
    SELECT source, start, "end", n FROM g WHERE "end" <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)""")
def sessions(t):
    src = c.event_time(stream(t).selectExpr("user_id % 20 source", "ts"), "ts")
    got = c.drain(s.sessions(src, "ts", ["source"], "2 hours"), "sessions")
    return got.select("source", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "n")


@query("str_09_fan_out", "SELECT 'all' AS sink, event_id FROM events UNION ALL SELECT 'alerts', event_id FROM events WHERE value > 100")
def fan_out(t):
    one, two = scratch(t.spark, "all"), scratch(t.spark, "alerts")
    c.drain_batches(stream(t).select("event_id", "value"), "fan-out", s.fan_out(one, two, F.col("value") > 100))
    read = lambda path, name: t.spark.read.parquet(path).select(F.lit(name).alias("sink"), "event_id")
    return read(one, "all").unionByName(read(two, "alerts"))


@query("str_10_pairing_timeout", """
    WITH a AS (SELECT event_id // 3 AS run, ts AS start_ts FROM events WHERE event_id % 3 = 0), b AS (SELECT event_id // 3 AS run, ts AS end_ts FROM events WHERE event_id % 3 = 2 AND value > 20), w AS (SELECT least((SELECT max(start_ts) FROM a), (SELECT max(end_ts) FROM b)) - INTERVAL 10 MINUTE AS mark)
    SELECT run, start_ts, end_ts, end_ts IS NULL AS timed_out FROM (SELECT a.run, a.start_ts, b.end_ts FROM a LEFT JOIN b ON a.run = b.run AND b.end_ts BETWEEN a.start_ts AND a.start_ts + INTERVAL 6 HOUR), w WHERE end_ts IS NOT NULL OR start_ts + INTERVAL 6 HOUR < mark""")
def pairing(t):
    start = c.event_time(stream(t).filter("event_id % 3 = 0").selectExpr("event_id div 3 run", "ts start_ts"), "start_ts")
    end = c.event_time(stream(t).filter("event_id % 3 = 2 and value > 20").selectExpr("event_id div 3 end_run", "ts end_ts"), "end_ts")
    got = c.drain(s.pair_with_timeout(start, end, "run", "start_ts", "end_run", "end_ts", "6 hours"), "pairs")
    return got.select("run", F.col("start_ts").cast("timestamp_ntz").alias("start_ts"), F.col("end_ts").cast("timestamp_ntz").alias("end_ts"), "timed_out")


@query("udf_01_named_step", "SELECT p_partkey, round(p_retailprice / p_size, 7) AS price_per_size FROM part")
def named_step(t):
    step = flows.Step("price", lambda df, name: df.withColumn(name, F.col("p_retailprice") / F.col("p_size")), {"name": "price_per_size"}, ["p_retailprice", "p_size"], ["price_per_size"])
    return rounded(t.part.transform(step).select("p_partkey", "price_per_size"), 7)


@query("udf_02_flow_run", """
    WITH u AS (SELECT c_acctbal AS balance FROM customer UNION ALL SELECT s_acctbal FROM supplier), k AS (SELECT * FROM u WHERE balance > 0)
    SELECT 'accounts' AS name, 'completed' AS status, (SELECT count(*) FROM u) AS rows_in, (SELECT count(*) FROM k) AS rows_out, (SELECT count(*) FROM k WHERE balance > 9000) AS rows_failed""")
def flow(t):
    got = flows.run(t.spark, "accounts", [Source("c", lambda sp: t.customer.selectExpr("c_acctbal balance")), Source("s", lambda sp: t.supplier.selectExpr("s_acctbal balance"))],
                    [flows.Step("positive", lambda df: df.filter("balance > 0"), requires=["balance"])], {"too_high": F.col("balance") > 9000}, [(scratch(t.spark, "accounts"), "parquet")])
    return got.table(t.spark).drop("started")


@query("udf_03_declared_flow", """
    SELECT o_orderstatus, round(sum(o_totalprice), 2) AS o_totalprice_sum, count(o_custkey) AS o_custkey_count, round(max(o_totalprice / nullif(o_custkey, 0)), 4) AS ratio_max FROM orders WHERE o_totalprice > 50000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1""")
def declared(t):
    spec = {
        "name": "urgent_orders", "sources": [{"name": "orders", "path": f"{t.folder}/orders.parquet", "format": "parquet"}],
        "transformations": [
            {"kind": "filter", "config": {"conditions": [("o_totalprice", "gt", 50000), ("o_orderpriority", "in", ["1-URGENT", "2-HIGH"])]}},
            {"kind": "calculate", "config": {"columns": {"ratio": "o_totalprice / o_custkey"}}},
            {"kind": "aggregate", "config": {"by": ["o_orderstatus"], "measures": {"o_totalprice": "sum", "o_custkey": "count", "ratio": "max"}}}],
    }
    return rounded(flows.run_spec(t.spark, spec).data, 4, o_totalprice_sum=2)


@query("udf_04_registered_rules", """
    SELECT p_partkey, round(p_retailprice / p_size, 7) AS "Price Density", CAST(0 AS DOUBLE) AS "Energy Efficiency" FROM part""")
def registered(t):
    rules = flows.Rules()
    rules.add_metric("Price Density", "p_retailprice / p_size")
    return rounded(rules.evaluate_metrics(t.part).select("p_partkey", "Price Density", "Energy Efficiency"), 7)


@query("udf_05_event_handlers", """
    SELECT event_id, 'high' AS event FROM events WHERE value > 100 UNION ALL SELECT event_id, 'very_high' FROM events WHERE value > 150 UNION ALL SELECT event_id, 'failure' FROM events WHERE event_type = 'error'""")
def handlers(t):
    levels = lambda df: F.array_compact(F.array(F.when(F.col("value") > 100, "high"), F.when(F.col("value") > 150, "very_high")))
    failures = lambda df: F.array_compact(F.array(F.when(F.col("event_type") == "error", "failure")))
    return ev.handle(t.events, [levels, failures]).select("event_id", "event")
