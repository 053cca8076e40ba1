"""Event logs as tables: snapshots, replay, derived events, protocols, dead letters, payload transforms, lint."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from gaugeworks.session import rows_table

# Plasma limits that raise safety events.
TEMPERATURE_LIMIT, SHUTDOWN_FACTOR, DENSITY_LIMIT = 200e6, 1.1, 1e22
# Protocols run per parameter that left its safe range.
PROTOCOLS = [
    ("temperature", "coolant_injection"),
    ("temperature", "magnetic_field_reduction"),
    ("density", "gas_injection"),
    ("density", "pumping_increase"),
    ("instability", "feedback_control"),
    ("instability", "auxiliary_heating_reduction"),
]
# Query lint rules (name, pattern that must match, pattern that must not, category, severity).
LINT_RULES = [
    ("missing_where_clause", r"SELECT.*FROM", r"WHERE", "Performance", "High"),
    ("select_star", r"SELECT\s+\*", None, "Performance", "Medium"),
    ("no_limit", r"SELECT.*FROM", r"LIMIT", "Performance", "Medium"),
    ("function_in_where", r"WHERE.*\w+\(", None, "Indexing", "High"),
    ("like_leading_wildcard", r"LIKE\s+['\"]%", None, "Indexing", "High"),
    ("or_in_where", r"WHERE.*\sOR\s", None, "Indexing", "Medium"),
    ("subquery_in_select", r"SELECT.*\(SELECT", None, "Performance", "Medium"),
    ("distinct_without_reason", r"SELECT\s+DISTINCT", None, "Performance", "Low"),
]
MAX_JOINS = 5
QUERY_TYPES = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "ALTER", "DROP")


def snapshot(df: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """Latest state per aggregate: a map-side combined maximum, no sort."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("_s")).select(*keys, *[F.col(f"_s.{c}").alias(c) for c in rest])


def project(events: DataFrame, keys: Sequence[str], seq: str, value: str) -> DataFrame:
    """Read model folded from a log: count, sum, last value and last sequence per key."""
    return events.groupBy(*keys).agg(F.count(F.lit(1)).alias("events"), F.sum(value).alias("total"), F.max_by(value, seq).alias("last_value"), F.max(seq).alias("last_seq"))


def project_increment(model: DataFrame, events: DataFrame, keys: Sequence[str], seq: str, value: str) -> DataFrame:
    """Bring a read model up to date with the events after each key's last sequence."""
    keys = list(keys)
    seen = model.select(*keys, F.col("last_seq").alias("_seen"))
    fresh = events.join(seen, keys, "left").filter(F.col("_seen").isNull() | (F.col(seq) > F.col("_seen"))).drop("_seen")
    both = model.unionByName(project(fresh, keys, seq, value))
    return both.groupBy(*keys).agg(F.sum("events").alias("events"), F.sum("total").alias("total"), F.max_by("last_value", "last_seq").alias("last_value"), F.max("last_seq").alias("last_seq"))


def emit(df: DataFrame, *outcomes: Column) -> DataFrame:
    """One row per outcome that is not null, beside the columns of its source row, in column `event`."""
    return df.withColumn("event", F.explode(F.array_compact(F.array(*outcomes))))


def safety_events(df: DataFrame, temperature: str, density: str, hot: float = TEMPERATURE_LIMIT, dense: float = DENSITY_LIMIT) -> DataFrame:
    """Threshold and shutdown events derived from readings."""
    def ev(kind: str, parameter: str, value: str, limit: float, severity: str) -> Column:
        return F.struct(F.lit(kind).alias("kind"), F.lit(parameter).alias("parameter"), F.col(value).cast("double").alias("value"), F.lit(float(limit)).alias("threshold"), F.lit(severity).alias("severity"))

    return emit(
        df,
        F.when(F.col(temperature) > hot, ev("safety_threshold_exceeded", "temperature", temperature, hot, "critical")),
        F.when(F.col(temperature) > hot * SHUTDOWN_FACTOR, ev("emergency_shutdown", "temperature", temperature, hot, "critical")),
        F.when(F.col(density) > dense, ev("safety_threshold_exceeded", "density", density, dense, "warning")),
    )


def protocols(df: DataFrame, parameter: str) -> DataFrame:
    """One row per protocol of the parameter; parameters without protocols give none."""
    table = rows_table(df.sparkSession, PROTOCOLS, "_parameter string, protocol string")
    return df.join(table, F.col(parameter) == F.col("_parameter")).drop("_parameter")


def retrain(df: DataFrame, score: str, threshold: float) -> DataFrame:
    return df.filter(F.col(score) < 0.8 * threshold)


def dead_letters(df: DataFrame, retries: str, limit: Column) -> DataFrame:
    return df.withColumn("status", F.when(F.col(retries) > limit, "dead_letter").otherwise("pending"))


def transform_payload(df: DataFrame, col: str, steps: Sequence[tuple[str, str, object]]) -> DataFrame:
    """Rename, add, remove and format fields of a struct column, in order; steps are (kind, field, argument)."""
    names = df.schema[col].dataType.fieldNames()
    for kind, field, arg in steps:
        c = F.col(col)
        if kind == "rename" and field in names:
            df = df.withColumn(col, c.withField(arg, c[field]).dropFields(field))
        elif kind == "add":
            df = df.withColumn(col, c.withField(field, F.lit(arg)))
        elif kind == "remove" and field in names and len(names) > 1:
            df = df.withColumn(col, c.dropFields(field))
        elif kind == "format" and field in names:
            df = df.withColumn(col, c.withField(field, F.format_string(arg, c[field])))
        names = df.schema[col].dataType.fieldNames()
    return df


def compliance_violations(df: DataFrame, event_id: str, kind: str, user: str, address: str, details: str, roles: str) -> DataFrame:
    """One row per audit event and broken rule; `details` is the array of detail keys present."""
    k, has = F.col(kind), lambda name: F.array_contains(details, name)
    broken = {
        "data_access_logged": (k == "data_access") & ~(has("resource") & has("action") & has("user_id")),
        "access_control": k.isin("access_granted", "access_denied") & ~has("authorization_check"),
        "monitoring": F.col(user).isNull() & F.col(address).isNull(),
        "failed_login_monitoring": (k == "login_failure") & ~has("attempt_count"),
        "privileged_access": F.array_contains(roles, "admin") & (k == "access_granted"),
    }
    return df.select(event_id, F.explode(F.array_compact(F.array(*[F.when(c, n) for n, c in broken.items()]))).alias("rule"))


def query_alerts(df: DataFrame, seconds: str, memory: str, hit_rate: str, examined: str, returned: str, max_seconds: float, max_memory: float, min_hit: float, max_ratio: float) -> DataFrame:
    """Alerts of a query log, one row each."""
    def alert(kind: str, severity: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), severity.alias("severity"))

    slow = F.col(seconds) > max_seconds
    return emit(
        df,
        F.when(slow, alert("slow_query", F.when(F.col(seconds) > 2 * max_seconds, "high").otherwise("medium"))),
        F.when(F.col(memory) > max_memory, alert("high_memory", F.lit("high"))),
        F.when(F.col(hit_rate) < min_hit, alert("low_cache_hit_rate", F.lit("medium"))),
        F.when((F.col(returned) > 0) & (F.try_divide(examined, returned) > max_ratio), alert("inefficient_scan", F.lit("medium"))),
    )


def lint(df: DataFrame, text: str) -> DataFrame:
    """One row per query and lint finding, with its category and severity."""
    def finding(name: str, category: str, severity: str) -> Column:
        return F.struct(F.lit(name).alias("rule"), F.lit(category).alias("category"), F.lit(severity).alias("severity"))

    q = F.col(text)
    hits = []
    for name, must, never, category, severity in LINT_RULES:
        cond = q.rlike(f"(?is){must}") & (~q.rlike(f"(?i){never}") if never else F.lit(True))
        hits.append(F.when(cond, finding(name, category, severity)))
    joins = F.regexp_count(q, F.lit(r"(?i)\bJOIN\b"))
    hits.append(F.when(joins > MAX_JOINS, finding("too_many_joins", "Performance", "High")))
    return emit(df, *hits)


def query_type(text: Column) -> Column:
    up = F.upper(F.trim(text))
    out = F.when(up.startswith(QUERY_TYPES[0]), QUERY_TYPES[0])
    for k in QUERY_TYPES[1:]:
        out = out.when(up.startswith(k), k)
    return out.when(up.contains("INDEX"), "INDEX").otherwise("SELECT")


def query_report(alerts: DataFrame, findings: DataFrame, avg_seconds: Column) -> DataFrame:
    """High-level recommendations from mean time, alert types and severe lint findings.

    `avg_seconds` is a scalar, `alerts` has `event.type`, `findings` has `event.severity`.
    """
    a = alerts.agg(*[F.count_if(F.col("event.type") == k).alias(k) for k in ("slow_query", "high_memory", "low_cache_hit_rate")])
    severe = findings.agg(F.count_if(F.col("event.severity") == "High").alias("severe")).select(F.struct("severe").alias("s")).scalar()
    says = [
        F.when(avg_seconds > 5, "add_indexes"), F.when(avg_seconds > 5, "review_patterns"), F.when(F.col("slow_query") > 0, "optimize_slow_queries"),
        F.when(F.col("high_memory") > 0, "optimize_memory"), F.when(F.col("low_cache_hit_rate") > 0, "improve_caching"), F.when(severe["severe"] > 5, "address_high_severity"),
    ]
    got = F.array_compact(F.array(*says))
    calm = F.array(F.lit("within_acceptable_range"), F.lit("continue_monitoring"))
    return a.select(F.explode(F.when(F.size(got) > 0, got).otherwise(calm)).alias("recommendation"))


def handle(df: DataFrame, handlers: Sequence[Callable[[DataFrame], Column]]) -> DataFrame:
    """Event handlers that each return an array of derived events per row; all in one pass."""
    return df.withColumn("event", F.explode(F.flatten(F.array(*[h(df) for h in handlers]))))
