"""Sources, sinks and table definitions on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.plans.registry import query, r
from gaugeworks.sources import external, files, tables


@query("src_01_read_formats", """
    SELECT 'csv' AS format, count(*) AS n, round(sum(s_acctbal), 2) AS total FROM supplier
    UNION ALL SELECT 'json', count(*), round(sum(s_acctbal), 2) FROM supplier
    UNION ALL SELECT 'parquet', count(*), round(sum(s_acctbal), 2) FROM supplier""")
def read_formats(t):
    out = None
    for fmt in files.FORMATS:
        path = files.scratch(t.spark, f"supplier-{fmt}")
        files.write(t.supplier, path, fmt)
        got = files.read(t.spark, path, fmt, schema=t.supplier.schema)
        part = got.agg(F.count(F.lit(1)).alias("n"), r(F.sum("s_acctbal"), 2).alias("total")).withColumn("format", F.lit(fmt))
        out = part if out is None else out.unionByName(part)
    return out


@query("src_02_partitioned_round_trip", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority, o_orderstatus FROM orders")
def partitioned_round_trip(t):
    path = files.scratch(t.spark, "orders")
    files.write(t.orders.drop("o_orderdate"), path, "parquet", partition_by=("o_orderstatus",))
    return files.read(t.spark, path, "parquet")


@query("src_05_json_documents", "SELECT event_id, event_type, value FROM events")
def json_documents(t):
    rec = t.events.select("event_id", "event_type", "value")
    wrapped = rec.filter("value < 20").select(F.array(F.struct("*")).alias("data"))
    path = files.scratch(t.spark, "documents")
    wrapped.write.mode("append").json(path)
    rec.filter("value >= 20").write.mode("append").json(path)
    schema = "data array<struct<event_id:bigint,event_type:string,value:double>>, event_id bigint, event_type string, value double"
    return files.json_records(files.read(t.spark, path, "json", schema=schema))


@query("src_06_multi_source_ingest", """
    SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer
    UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier""")
def multi_source_ingest(t):
    cust = t.customer.selectExpr("c_custkey id", "c_name name", "c_acctbal balance", "c_mktsegment segment")
    supp = t.supplier.selectExpr("s_suppkey id", "s_name name", "s_acctbal balance")
    df, failed = files.ingest(t.spark, [
        files.Source("customers", lambda s: cust), files.Source("suppliers", lambda s: supp),
        files.Source("switched_off", lambda s: cust, enabled=False),
        files.Source("absent", lambda s: files.read(s, t.folder + "/absent", "parquet")),
    ])
    assert failed == ["absent"]
    return df


@query("src_07_constraint_report", """
    SELECT 'lineitem_key_unique' AS rule, count(*) AS violations FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'orders_key_unique', count(*) FROM (SELECT 1 FROM orders GROUP BY o_orderkey HAVING count(*) > 1)
    UNION ALL SELECT 'orders_customer_known', count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)
    UNION ALL SELECT 'lineitem_order_known', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
    UNION ALL SELECT 'status_known', count(*) FROM orders WHERE o_orderstatus NOT IN ('F', 'O')""")
def constraint_report(t):
    return tables.constraint_report({
        "lineitem_key_unique": tables.duplicate_keys(t.lineitem, ["l_orderkey", "l_linenumber"]),
        "orders_key_unique": tables.duplicate_keys(t.orders, ["o_orderkey"]),
        "orders_customer_known": tables.orphans(t.orders, "o_custkey", t.customer, "c_custkey"),
        "lineitem_order_known": tables.orphans(t.lineitem, "l_orderkey", t.orders, "o_orderkey"),
        "status_known": t.orders.filter(~F.col("o_orderstatus").isin("F", "O")),
    })


STORE_SQL = {
    "experiments": """SELECT c_custkey::VARCHAR AS id, c_name AS name, CASE WHEN c_nationkey > 20 THEN NULL ELSE c_mktsegment END AS experiment_type,
        CASE WHEN c_nationkey < 5 THEN 'paused' ELSE 'running' END AS status, 'tokamak' AS reactor_type FROM customer WHERE c_acctbal > 0""",
    "shots": """SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS experiment_id, month(o_orderdate) AS shot_number, o_orderdate AS start_time, NULL AS plasma_current,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'paused' END AS status FROM orders WHERE o_totalprice > 50000""",
    "measurements": """SELECT l_orderkey || '-' || l_linenumber AS id, l_orderkey::VARCHAR AS shot_id, l_shipdate AS timestamp, CASE WHEN l_tax > 0.07 THEN NULL ELSE l_tax END AS time_relative,
        l_linestatus AS diagnostic_name, l_returnflag AS measurement_type, l_quantity AS value, l_linenumber AS quality_flag, 'pieces' AS units FROM lineitem""",
    "predictions": """SELECT event_id::VARCHAR AS id, CASE WHEN user_id % 5 > 0 THEN user_id::VARCHAR END AS shot_id, event_type AS model_id, '1' AS model_version, 'gain' AS prediction_type,
        props AS input_features, value AS predicted_value FROM events""",
}
_MISSING = {
    "experiments": "id name experiment_type reactor_type", "shots": "id experiment_id shot_number start_time",
    "measurements": "id shot_id timestamp time_relative diagnostic_name measurement_type value units",
    "predictions": "id model_id model_version prediction_type input_features predicted_value",
}


def store_sql() -> str:
    """SQL of the report, stated rule by rule."""
    ask = lambda table, rule, where, source=None: f"SELECT '{table}' AS \"table\", '{rule}' AS rule, count(*) AS violations FROM {source or table} WHERE {where}"
    parts = [ask(t, f"{c} missing", f"{c} IS NULL") for t, cols in _MISSING.items() for c in cols.split()]
    parts += [ask(t, f"{f.strip().split()[0]} unreadable", "NOT readable", f"(SELECT true AS readable FROM {t})") for t, layout in tables.STORE.items() for f in layout.columns.split(",") if f.strip().split()[1] != "string"
              and (t, f.strip().split()[0]) != ("predictions", "prediction_interval_lower")]
    parts.append(ask("predictions", "prediction_interval_lower unreadable", "x IS NOT NULL AND TRY_CAST(x AS DOUBLE) IS NULL", "(SELECT event_type AS x FROM events)"))
    parts += [ask("experiments", "status unknown", "status = 'paused'"), ask("shots", "status unknown", "status = 'paused'"), ask("measurements", "quality_flag unknown", "quality_flag > 2")]
    parts += [f"SELECT '{t}', '{k} unique', coalesce(sum(n - 1), 0)::BIGINT FROM (SELECT count(*) AS n FROM {t} GROUP BY {k})" for t, k in [*((t, "id") for t in STORE_SQL), ("shots", "experiment_id, shot_number")]]
    parts += [ask(t, f"{c} known", f"{c} IS NOT NULL AND {c} NOT IN (SELECT id FROM {p})") for t, c, p in (("shots", "experiment_id", "experiments"), ("measurements", "shot_id", "shots"), ("predictions", "shot_id", "shots"))]
    return "WITH " + ", ".join(f"{t} AS ({q})" for t, q in STORE_SQL.items()) + " " + " UNION ALL ".join(parts)


@query("src_07_experiment_store", store_sql())
def experiment_store(t):
    text = lambda c: F.col(c).cast("string")
    made = {
        "experiments": t.customer.where("c_acctbal > 0").select(
            text("c_custkey").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_nationkey") <= 20, F.col("c_mktsegment")).alias("experiment_type"),
            F.when(F.col("c_nationkey") < 5, "paused").otherwise("running").alias("status"), F.lit("tokamak").alias("reactor_type")),
        "shots": t.orders.where("o_totalprice > 50000").select(
            text("o_orderkey").alias("id"), text("o_custkey").alias("experiment_id"), F.month("o_orderdate").alias("shot_number"), F.col("o_orderdate").alias("start_time"),
            F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "running").otherwise("paused").alias("status")),
        "measurements": t.lineitem.select(
            F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), text("l_orderkey").alias("shot_id"), F.col("l_shipdate").alias("timestamp"), F.when(F.col("l_tax") <= 0.07, F.col("l_tax")).alias("time_relative"),
            F.col("l_linestatus").alias("diagnostic_name"), F.col("l_returnflag").alias("measurement_type"), F.col("l_quantity").alias("value"), F.col("l_linenumber").alias("quality_flag"), F.lit("pieces").alias("units")),
        "predictions": t.events.select(
            text("event_id").alias("id"), F.when(F.col("user_id") % 5 > 0, text("user_id")).alias("shot_id"), F.col("event_type").alias("model_id"), F.lit("1").alias("model_version"), F.lit("gain").alias("prediction_type"),
            F.col("props").alias("input_features"), F.col("value").alias("predicted_value"), F.col("event_type").alias("prediction_interval_lower")),
    }
    return tables.store_report(made)


@query("src_08_measurement_store", """
    SELECT user_id AS shot_id, event_id, CASE WHEN event_id % 7 = 0 THEN 0.0 ELSE value END AS value, 0 AS quality_flag FROM events""")
def measurement_store(t):
    raw = t.events.selectExpr("user_id shot_id", "event_id", "if(event_id % 7 = 0, null, value) value", "ts")
    path = files.scratch(t.spark, "measurements")
    tables.store_measurements(tables.with_defaults(raw, {"value": F.lit(0.0), "quality_flag": F.lit(0)}), path, "shot_id")
    return files.read(t.spark, path, "parquet").select("shot_id", "event_id", "value", "quality_flag")


@query("src_09_document_store", """
    SELECT event_id, user_id, octet_length(encode(props)) AS size_bytes, len(json_keys(props)) AS fields_count,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
    FROM events WHERE event_type = 'purchase'""")
def document_store(t):
    hit = t.events.filter("event_type = 'purchase'").orderBy("ts")
    body = tables.documents_with_size(hit, "props")
    return body.select("event_id", "user_id", "size_bytes", "fields_count", F.from_json("props", "k bigint")["k"].alias("k"))


@query("src_11_message_encoding", """
    SELECT CAST(event_id AS VARCHAR) AS key, value, user_id, event_type FROM events""")
def message_encoding(t):
    out = external.encode(t.events.select("event_id", "value", "user_id", "event_type"), "event_id")
    return out.select("key", F.from_json("value", "value double, user_id bigint, event_type string").alias("m")).select("key", "m.*")


@query("src_12_metric_export", """
    SELECT event_type, count(*) AS n, CAST(min(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS param_lo,
           CAST(max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS param_hi
    FROM events GROUP BY 1""")
def metric_export(t):
    k = F.get_json_object("props", "$.k").cast("bigint")
    rep = t.events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.create_map(F.lit("lo"), F.min(k), F.lit("hi"), F.max(k)).alias("params"))
    path = files.scratch(t.spark, "metrics")
    files.write(files.flatten_map(rep, "params", ["lo", "hi"]), path, "csv")
    return files.read(t.spark, path, "csv", schema="event_type string, n bigint, param_lo bigint, param_hi bigint")


@query("src_13_time_grid", """
    SELECT p_partkey, CAST(s AS INTEGER) AS time_step, round(CAST(0.1 AS DOUBLE) * s, 6) AS timestamp,
           round(p_retailprice * (1 + 0.05 * sin(2 * pi() * s / 50)), 6) AS p_retailprice
    FROM part, range(0, 20) g(s)""")
def time_grid(t):
    g = files.expand_grid(t.part.select("p_partkey", "p_retailprice"), 20, ["p_retailprice"])
    return g.select("p_partkey", "time_step", r("timestamp").alias("timestamp"), r("p_retailprice").alias("p_retailprice"))
