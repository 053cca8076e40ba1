"""Joins of experiments, shots, measurements and predictions; routing, pairing, trees, fronts and diffs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from gaugeworks.operators.aggregate import rows
from gaugeworks.operators.ordered import framed, running
from gaugeworks.session import broadcast_if_small, scalar_row


def experiment_stats(exp: DataFrame, shots: DataFrame, series: DataFrame, exp_id: str, shot_exp: str, shot_id: str, series_shot: str, value: str, disrupted: Column, fan_out: bool = True) -> DataFrame:
    """Counts and means per experiment over shots and their measurements.

    With `fan_out` a shot counts once per measurement (at least once), as a plain double outer join
    yields; without, once. Both come from measurements counted per shot before any join, so the
    fanned-out rows never exist.
    """
    per_shot = series.groupBy(F.col(series_shot).alias("_shot")).agg(rows().alias("_series"))
    s = shots.join(per_shot, F.col(shot_id) == F.col("_shot"), "left").withColumn("_series", F.coalesce("_series", F.lit(0)))
    weight = F.greatest(F.col("_series"), F.lit(1)) if fan_out else F.lit(1)
    s = s.withColumns({"_w": weight, "_bad": disrupted})
    per = s.groupBy(F.col(shot_exp).alias("_exp")).agg(
        F.sum("_w").alias("shot_count"), F.sum("_series").alias("series_count"), F.try_divide(F.sum(F.col(value) * F.col("_w")), F.sum("_w")).alias("avg_value"),
        F.sum(F.when(F.col("_bad"), F.col("_w")).otherwise(0)).alias("disruption_count"))
    out = exp.join(per, F.col(exp_id) == F.col("_exp"), "left").drop("_exp")
    return out.na.fill(0, ["shot_count", "series_count", "disruption_count"])


def prediction_errors(shots: DataFrame, predictions: DataFrame, shot: str, actual: str, predicted: str, version: str) -> DataFrame:
    """Predictions beside actual values, with signed and absolute error; a prediction without a shot stays."""
    both = predictions.join(shots.select(shot, actual), shot, "left")
    return both.withColumns({"error": F.col(predicted) - F.col(actual), "abs_error": F.abs(F.col(predicted) - F.col(actual))})


def errors_by_version(joined: DataFrame, version: str) -> DataFrame:
    return joined.groupBy(version).agg(rows().alias("n"), F.count("error").alias("matched"), F.avg("error").alias("bias"), F.avg("abs_error").alias("mae"))


def align(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """Columns of several tables side by side, matched on a key instead of on row position."""
    out = frames[0]
    for df in frames[1:]:
        out = out.join(df, key)
    return out


def route(messages: DataFrame, bindings: DataFrame, message_id: str, key: str, default_prefix: str = "events.") -> DataFrame:
    """One row per message and distinct queue; a message without a match goes to its default queue.

    `bindings` is a rule table (pattern, queue). A pattern stands for equal keys, for keys with its prefix, for keys with
    its suffix or for all; a key offers itself and its ends of the lengths that occur among the rules, so the match is an
    equi-join of any number of rules. Rules for all are no join key: their queues, which every message gets anyway, are
    added as one array.
    """
    p = F.col("pattern")
    kinds = F.array(
        F.struct(F.lit("exact").alias("kind"), p.alias("text")),
        F.when(p.endswith("*") & (p != "*"), F.struct(F.lit("prefix").alias("kind"), F.expr("substring(pattern, 1, length(pattern) - 1)").alias("text"))),
        F.when(p.startswith("*") & (p != "*"), F.struct(F.lit("suffix").alias("kind"), F.expr("substring(pattern, 2)").alias("text"))),
    )
    every = bindings.where(p == "*").agg(F.collect_set("queue").alias("queues"))
    rules = bindings.where(p.isNotNull()).select(F.explode(F.array_compact(kinds)).alias("r"), "queue").select("r.kind", "r.text", "queue").distinct()
    sizes = {"prefix": set(), "suffix": set()}
    for r in rules.where("kind in ('prefix', 'suffix')").select("kind", F.length("text").alias("n")).distinct().collect():  # as many as lengths of keys
        sizes[r["kind"]].add(r["n"])
    k = F.col(key)
    offer = [F.struct(F.lit("exact").alias("kind"), k.alias("text"))]
    offer += [F.when(F.length(k) >= n, F.struct(F.lit("prefix").alias("kind"), F.substring(k, 1, n).alias("text"))) for n in sorted(sizes["prefix"])]
    offer += [F.when(F.length(k) >= n, F.struct(F.lit("suffix").alias("kind"), (F.substring(k, -n, n) if n else F.lit("")).alias("text"))) for n in sorted(sizes["suffix"])]
    offered = messages.select(message_id, key, F.explode(F.array_compact(F.array(*offer))).alias("o")).select(message_id, key, "o.kind", "o.text")
    hit = offered.join(broadcast_if_small(rules), ["kind", "text"], "left").groupBy(message_id, key).agg(F.collect_set("queue").alias("own"))
    hit = hit.withColumn("queues", F.array_union("own", scalar_row(every)["queues"]))
    queues = F.when(F.size("queues") > 0, F.col("queues")).otherwise(F.array(F.concat(F.lit(default_prefix), k)))
    return hit.select(message_id, F.explode(queues).alias("queue")).distinct()


def pair_runs(events: DataFrame, run: str, ts: str, started: Column, completed: Column) -> DataFrame:
    """Start and completion of each run by one conditional aggregate; no end means still active."""
    g = events.groupBy(run).agg(F.min(F.when(started, F.col(ts))).alias("start_ts"), F.max(F.when(completed, F.col(ts))).alias("end_ts")).filter("start_ts is not null")
    seconds = (F.unix_micros(F.col("end_ts").cast("timestamp")) - F.unix_micros(F.col("start_ts").cast("timestamp"))) / 1e6
    return g.withColumns({"seconds": seconds, "active": F.col("end_ts").isNull()})


def span_tree(spans: DataFrame, span: str, parent: str) -> DataFrame:
    """Every span with its parent's row presence and its number of children."""
    kids = spans.filter(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_p")).agg(rows().alias("children"))
    known = spans.select(F.col(span).alias("_known"))
    out = spans.join(kids, F.col(span) == F.col("_p"), "left").join(known, F.col(parent) == F.col("_known"), "left")
    return out.withColumns({"is_root": F.col(parent).isNull(), "parent_found": F.col("_known").isNotNull(), "children": F.coalesce("children", F.lit(0))}).drop("_p", "_known")


def version_diff(a: DataFrame, b: DataFrame, metric: str, value: str) -> DataFrame:
    """All metrics of two versions side by side with difference and relative improvement."""
    j = a.select(metric, F.col(value).alias("v1")).join(b.select(metric, F.col(value).alias("v2")), metric, "full")
    diff = F.col("v2") - F.col("v1")
    return j.withColumns({"difference": diff, "improvement": F.try_divide(diff, F.abs("v1")) * 100})


def pareto_front(df: DataFrame, maximize: str, minimize: str) -> DataFrame:
    """Rows no other row beats in both objectives: best value per cost, kept where it tops all cheaper ones."""
    best = df.groupBy(minimize).agg(F.max(maximize).alias("_best"))
    top = running(best, [], [minimize], {"_top": ("max", F.col("_best"))})
    top = framed(top, [], [minimize], 1, 0, lambda w: {"_cheaper": F.lag("_top").over(w)})
    front = top.filter(F.col("_cheaper").isNull() | (F.col("_best") > F.col("_cheaper"))).select(minimize, F.col("_best").alias(maximize))
    return df.join(front, [minimize, maximize], "left_semi")


def row_hash(cols: Sequence[str]) -> Column:
    """SHA-256 of the columns as text, null told apart from empty."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("~")) for c in cols]), 256)


def snapshot_drift(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """added, removed or changed rows between two snapshots, by row hash."""
    def hashed(df: DataFrame, name: str) -> DataFrame:
        return df.select(key, row_hash([c for c in df.columns if c != key]).alias(name))

    j = hashed(before, "_a").join(hashed(after, "_b"), key, "full")
    change = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(F.col("_a") != F.col("_b"), "changed")
    return j.select(key, change.alias("change")).filter("change is not null")


def leaf_paths(schema: T.StructType, prefix: str = "") -> list[str]:
    """Dotted paths of all leaves of a nested schema."""
    out = []
    for f in schema.fields:
        path = f"{prefix}{f.name}"
        out += leaf_paths(f.dataType, f"{path}.") if isinstance(f.dataType, T.StructType) else [path]
    return out


def leaves(df: DataFrame, key: str) -> DataFrame:
    """Rows (key, path, value) of all leaves, values as text; absent leaves are left out."""
    paths = [p for p in leaf_paths(df.schema) if p != key]
    cells = F.array(*[F.struct(F.lit(p).alias("path"), F.col(p).cast("string").alias("value")) for p in paths])
    return df.select(key, F.explode(cells).alias("c")).select(key, "c.path", "c.value").filter("value is not null")


def nested_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """removed, changed and added leaves with dotted path, old and new value."""
    a, b = leaves(before, key).withColumnRenamed("value", "old"), leaves(after, key).withColumnRenamed("value", "new")
    j = a.join(b, [key, "path"], "full")
    kind = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").otherwise("changed")
    return j.filter(~F.col("old").eqNullSafe(F.col("new"))).withColumn("kind", kind)
