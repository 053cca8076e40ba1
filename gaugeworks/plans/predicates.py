"""Filters and predicates on the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from gaugeworks.operators import filters as f
from gaugeworks.plans.registry import query
from gaugeworks.session import rows_table


@query("flt_01_generic_filters", """
    SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 50000 AND o_totalprice <= 400000 AND o_orderstatus IN ('F', 'O')
      AND o_orderstatus NOT IN ('P') AND o_orderpriority ILIKE '%high%' AND o_custkey BETWEEN 10 AND 1200 AND o_custkey <> 77 AND o_orderkey >= 5 AND o_orderkey < 14000""")
def generic(t):
    return f.where_all(t.orders, [
        ("o_totalprice", "gt", 50000), ("o_totalprice", "lte", 400000), ("o_orderstatus", "in", ["F", "O"]), ("o_orderstatus", "not_in", ["P"]),
        ("o_orderpriority", "like", "%high%"), ("o_custkey", "between", (10, 1200)), ("o_custkey", "ne", 77), ("o_orderkey", "gte", 5), ("o_orderkey", "lt", 14000),
    ]).select("o_orderkey", "o_totalprice")


@query("flt_02_by_id", "SELECT * FROM orders WHERE o_orderkey = 42")
def one(t):
    return f.by_id(t.orders, "o_orderkey", 42)


@query("flt_03_time_range", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice, l_shipdate FROM lineitem WHERE l_returnflag = 'A' AND l_shipdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-06-30'""")
def time_range(t):
    return f.time_range(t.lineitem, "l_shipdate", "1996-01-01", "1997-06-30", l_returnflag="A").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_shipdate")


@query("flt_04_rule_counts", """
    SELECT 'value_range' AS rule, count(*) FILTER (value < 1 OR value > 100) AS violations FROM events
    UNION ALL SELECT 'value_positive', count(*) FILTER (value <= 0) FROM events
    UNION ALL SELECT 'required_user', count(*) FILTER (user_id IS NULL) FROM events
    UNION ALL SELECT 'too_old', count(*) FILTER (ts < TIMESTAMP '2024-01-31' - INTERVAL 240 HOUR) FROM events""")
def rules(t):
    return f.rule_counts(t.events, {
        "value_range": f.outside("value", 1, 100), "value_positive": f.not_positive("value"),
        "required_user": F.col("user_id").isNull(), "too_old": f.older_than("ts", "2024-01-31", 240),
    })


@query("flt_05_domain_violations", """
    SELECT 'discount' AS rule, count(*) FILTER (l_discount <= 0 OR l_discount > 1e9) AS violations FROM lineitem
    UNION ALL SELECT 'quantity', count(*) FILTER (l_quantity <= 0) FROM lineitem
    UNION ALL SELECT 'tax', count(*) FILTER (l_tax <= 0) FROM lineitem""")
def domain(t):
    return f.rule_counts(t.lineitem, {"discount": (F.col("l_discount") <= 0) | (F.col("l_discount") > 1e9), "quantity": f.not_positive("l_quantity"), "tax": f.not_positive("l_tax")})


@query("flt_06_event_filter", "SELECT event_id, value FROM events WHERE user_id = 7 AND event_type = 'click' AND event_id >= 100 AND event_id <= 9000")
def events(t):
    return f.where_all(t.events, [("user_id", "eq", 7), ("event_type", "eq", "click"), ("event_id", "gte", 100), ("event_id", "lte", 9000)]).select("event_id", "value")


@query("flt_07_payload_checks", """
    WITH e AS (SELECT json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.name') AS name FROM events)
    SELECT 'name_missing' AS rule, count(*) FILTER (name IS NULL) AS violations FROM e
    UNION ALL SELECT 'k_missing', count(*) FILTER (k IS NULL) FROM e
    UNION ALL SELECT 'k_type', count(*) FILTER (TRY_CAST(k AS DOUBLE) IS NULL) FROM e
    UNION ALL SELECT 'k_min', count(*) FILTER (CAST(k AS DOUBLE) < 10) FROM e
    UNION ALL SELECT 'k_max', count(*) FILTER (CAST(k AS DOUBLE) > 90) FROM e
    UNION ALL SELECT 'k_min_length', count(*) FILTER (length(k) < 2) FROM e
    UNION ALL SELECT 'k_max_length', count(*) FILTER (length(k) > 2) FROM e
    UNION ALL SELECT 'k_pattern', count(*) FILTER (NOT regexp_matches(k, '^(?:[1-4])')) FROM e
    UNION ALL SELECT 'k_enum', count(*) FILTER (k NOT IN ('1', '2', '3', '50')) FROM e""")
def payload(t):
    return f.rule_counts(t.events, f.payload_checks("props", ["name", "k"], {
        "k": {"type": "number", "min": 10, "max": 90, "min_length": 2, "max_length": 2, "pattern": "[1-4]", "enum": [1, 2, 3, 50]}}))


BINDINGS = [("*", "audit"), ("error", "alarms"), ("p*", "sales"), ("*up", "growth"), ("c*", "sales")]
BINDINGS_SQL = "(VALUES ('*', 'audit'), ('error', 'alarms'), ('p*', 'sales'), ('*up', 'growth'), ('c*', 'sales')) b(pattern, queue)"
MATCH_SQL = """(pattern = '*' OR event_type = pattern OR (pattern LIKE '%*' AND starts_with(event_type, left(pattern, length(pattern) - 1)))
      OR (pattern LIKE '*%' AND suffix(event_type, substr(pattern, 2))))"""


@query("flt_08_routing_key_match", f"SELECT event_id, pattern, queue FROM events JOIN {BINDINGS_SQL} ON {MATCH_SQL}")
def routing_key(t):
    b = rows_table(t.spark, BINDINGS, "pattern string, queue string")
    return t.events.join(b, f.key_matches(F.col("event_type"), F.col("pattern"))).select("event_id", "pattern", "queue")


RULES = [
    ("errors", "event_type == 'error'", 10, ["alarms", "audit"], True), ("urgent", "priority >= 3", 5, ["fast"], True),
    ("nines", "props contains '9'", 3, ["nines"], True), ("off", "event_type == 'view'", 1, ["never"], False), ("all", "true", 0, ["archive"], True)]


@query("flt_09_routing_rules", """
    WITH e AS (SELECT event_id, event_type, props, event_id % 5 AS priority FROM events)
    SELECT event_id, 'errors' AS rule, 10 AS rule_priority, d AS destination FROM e, (VALUES ('alarms'), ('audit')) v(d) WHERE event_type = 'error'
    UNION ALL SELECT event_id, 'urgent', 5, 'fast' FROM e WHERE priority >= 3
    UNION ALL SELECT event_id, 'nines', 3, 'nines' FROM e WHERE contains(props, '9')
    UNION ALL SELECT event_id, 'all', 0, 'archive' FROM e""")
def routing_rules(t):
    e = t.events.selectExpr("event_id", "event_type", "props", "cast(event_id % 5 as int) priority")
    return f.route_by_rules(e, RULES).select("event_id", "rule", "rule_priority", "destination")


@query("flt_10_retention", """
    SELECT 'age' AS policy, event_id FROM events WHERE ts >= TIMESTAMP '2024-01-31' - INTERVAL 10 DAY
    UNION ALL SELECT 'count', event_id FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC) AS p FROM events) WHERE p <= 500
    UNION ALL SELECT 'size', event_id FROM (SELECT event_id, sum(octet_length(encode(props))) OVER (ORDER BY ts DESC ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE s <= 20000""")
def retention(t):
    e = t.events.select("event_id", "ts", "props")
    kept = {"age": f.retain_age(e, "ts", "2024-01-31", 10), "count": f.retain_count(e, ["ts"], 500), "size": f.retain_size(e, ["ts"], F.octet_length("props").cast("bigint"), 20000)}
    out = None
    for name, df in kept.items():
        part = df.select(F.lit(name).alias("policy"), "event_id")
        out = part if out is None else out.unionByName(part)
    return out


@query("flt_11_ttl", """
    SELECT event_id FROM events WHERE event_id % 3 = 0 OR epoch_us(TIMESTAMP '2024-01-31') - epoch_us(ts) <= 86400000000 * (1 + event_id % 20)""")
def ttl(t):
    e = t.events.selectExpr("event_id", "ts", "if(event_id % 3 = 0, null, 86400.0 * (1 + event_id % 20)) ttl")
    return f.alive(e, "ts", "ttl", "2024-01-31").select("event_id")


@query("flt_12_registry_filters", """
    SELECT p_partkey FROM part WHERE p_type = 'ECONOMY' AND (p_name LIKE '%ring%' OR p_name LIKE 'red %')""")
def registry(t):
    reg = t.part.selectExpr("p_partkey", "p_type status", "p_brand model_id", "split(p_name, ' ') tags")
    return f.registry_filter(reg, status="ECONOMY", tags=["ring", "red"]).select("p_partkey")
