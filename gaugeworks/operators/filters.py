"""Predicates: filter lists, rule counts, payload checks, routing, retention and expiry."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gaugeworks.operators.ordered import running

OPERATORS = {
    "eq": lambda c, v: c == v,
    "ne": lambda c, v: c != v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)),
    "not_in": lambda c, v: ~c.isin(list(v)),
    "like": lambda c, v: c.ilike(v),
    "between": lambda c, v: c.between(v[0], v[1]),
}


def where_all(df: DataFrame, filters: Sequence[tuple[str, str, object]]) -> DataFrame:
    """Rows that meet all (column, operator, value) filters; names and operators are checked."""
    for c, op, _ in filters:
        if c not in df.columns:
            raise ValueError(f"unknown column {c!r}")
        if op not in OPERATORS:
            raise ValueError(f"unknown operator {op!r}")
    return reduce(lambda d, f: d.filter(OPERATORS[f[1]](F.col(f[0]), f[2])), filters, df)


def by_id(df: DataFrame, key: str, value) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def time_range(df: DataFrame, ts: str, start=None, end=None, **equal) -> DataFrame:
    """Rows of given equal columns within [start, end], by time."""
    for c, v in equal.items():
        if v is not None:
            df = df.filter(F.col(c) == v)
    if start is not None:
        df = df.filter(F.col(ts) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        df = df.filter(F.col(ts) <= F.lit(end).cast("timestamp_ntz"))
    return df.orderBy(ts)


def rule_counts(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Number of rows that break each rule: one scan, one row out, then one row per rule."""
    one = df.agg(*[F.count_if(cond).alias(n) for n, cond in rules.items()])
    return one.unpivot([], list(rules), "rule", "violations")


def outside(col: str, lo: float | None = None, hi: float | None = None) -> Column:
    parts = [F.col(col) < lo] if lo is not None else []
    parts += [F.col(col) > hi] if hi is not None else []
    return reduce(lambda a, b: a | b, parts)


def not_positive(col: str) -> Column:
    return F.col(col) <= 0


def older_than(ts: str, now: str, hours: float) -> Column:
    return F.col(ts) < F.lit(now).cast("timestamp_ntz") - F.make_interval(hours=F.lit(hours).cast("int"))


def payload_checks(body: str, required: Sequence[str], rules: dict[str, dict]) -> dict[str, Column]:
    """Named conditions that are true where a JSON payload breaks a declared field rule."""
    out = {f"{f}_missing": F.get_json_object(body, f"$.{f}").isNull() for f in required}
    for f, rule in rules.items():
        text = F.get_json_object(body, f"$.{f}")
        number = F.expr(f"try_cast(get_json_object({body}, '$.{f}') as double)")
        have = text.isNotNull()
        if rule.get("type") == "number":
            out[f"{f}_type"] = have & number.isNull()
        if "min" in rule:
            out[f"{f}_min"] = have & (number < rule["min"])
        if "max" in rule:
            out[f"{f}_max"] = have & (number > rule["max"])
        if "min_length" in rule:
            out[f"{f}_min_length"] = have & (F.length(text) < rule["min_length"])
        if "max_length" in rule:
            out[f"{f}_max_length"] = have & (F.length(text) > rule["max_length"])
        if "pattern" in rule:
            out[f"{f}_pattern"] = have & ~text.rlike(f"^(?:{rule['pattern']})")
        if "enum" in rule:
            out[f"{f}_enum"] = have & ~text.isin([str(v) for v in rule["enum"]])
    return out


def key_matches(key: Column, pattern: Column) -> Column:
    """Routing patterns: `*`, an exact key, `prefix*` or `*suffix`."""
    return (
        (pattern == "*") | (key == pattern)
        | (pattern.endswith("*") & key.startswith(F.expr("substring(pattern, 1, length(pattern) - 1)")))
        | (pattern.startswith("*") & key.endswith(F.expr("substring(pattern, 2)")))
    )


def routing_condition(df: DataFrame, text: str) -> Column:
    """A routing rule as a condition: `event_type == x`, `priority >= n`, `field contains x`, else true."""
    if "event_type ==" in text:
        return F.col("event_type") == text.split("event_type ==")[1].strip().strip("'\"")
    if "priority >=" in text:
        bound = int(text.split("priority >=")[1].strip())
        return (F.coalesce(F.col("priority"), F.lit(0)) if "priority" in df.columns else F.lit(0)) >= bound
    if "contains" in text:
        field, value = (p.strip().strip("'\"") for p in text.split("contains"))
        return F.coalesce(F.col(field).cast("string"), F.lit("")).contains(value) if field in df.columns else F.lit(not value)
    return F.lit(True)


def route_by_rules(df: DataFrame, rules: Sequence[tuple[str, str, int, Sequence[str], bool]]) -> DataFrame:
    """One row per matching enabled rule and destination; rules are (name, condition, priority, destinations, enabled)."""
    hits = [
        F.when(routing_condition(df, cond), F.struct(F.lit(name).alias("rule"), F.lit(prio).alias("rule_priority"), F.array(*[F.lit(d) for d in dest]).alias("dest")))
        for name, cond, prio, dest, on in rules if on
    ]
    got = df.withColumn("_hit", F.explode(F.array_compact(F.array(*hits))))
    return got.withColumn("destination", F.explode("_hit.dest")).select(*df.columns, "_hit.rule", "_hit.rule_priority", "destination")


def retain_age(df: DataFrame, ts: str, now: str, days: int) -> DataFrame:
    return df.filter(F.col(ts) >= F.lit(now).cast("timestamp_ntz") - F.make_interval(days=F.lit(days)))


def retain_count(df: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    """The newest `n` rows."""
    return running(df, [], order, {"_pos": ("count", F.lit(1))}, desc=True).filter(F.col("_pos") <= n).drop("_pos")


def retain_size(df: DataFrame, order: Sequence[str], size: Column, limit: int) -> DataFrame:
    """The newest rows whose sizes together stay within `limit`."""
    return running(df, [], order, {"_bytes": ("sum", size)}, desc=True).filter(F.col("_bytes") <= limit).drop("_bytes")


def alive(df: DataFrame, ts: str, ttl_seconds: str, now: str) -> DataFrame:
    """Messages within their time to live; without one they never expire."""
    age = (F.unix_micros(F.lit(now).cast("timestamp")) - F.unix_micros(F.col(ts).cast("timestamp"))) / 1e6
    return df.filter(F.col(ttl_seconds).isNull() | (age <= F.col(ttl_seconds)))


def registry_filter(df: DataFrame, status: str | None = None, model_id: str | None = None, tags: Sequence[str] | None = None) -> DataFrame:
    if status is not None:
        df = df.filter(F.col("status") == status)
    if model_id is not None:
        df = df.filter(F.col("model_id") == model_id)
    if tags:
        df = df.filter(F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags])))
    return df
