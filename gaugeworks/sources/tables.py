"""Declared tables of the experiment store, constraint checks, and the measurement and document stores."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Table layouts of the experiment store.
EXPERIMENTS = """
    id string not null, name string not null, description string, created_at timestamp, updated_at timestamp,
    experiment_type string not null, status string, reactor_type string not null, major_radius double,
    minor_radius double, magnetic_field double, metadata string
"""
SHOTS = """
    id string not null, experiment_id string not null, shot_number int not null, start_time timestamp not null,
    end_time timestamp, duration double, plasma_current double, electron_density double,
    electron_temperature double, ion_temperature double, neutral_beam_power double, rf_heating_power double,
    q_factor double, confinement_time double, beta_normalized double, status string, quality_rating double,
    had_disruption boolean, disruption_time double, disruption_cause string, diagnostics_data string,
    analysis_results string
"""
MEASUREMENTS = """
    id string not null, shot_id string not null, timestamp timestamp not null, time_relative double not null,
    diagnostic_name string not null, measurement_type string not null, spatial_location string,
    value double not null, uncertainty double, quality_flag int, units string not null, calibration_id string
"""
PREDICTIONS = """
    id string not null, shot_id string, model_id string not null, model_version string not null,
    prediction_type string not null, created_at timestamp, prediction_time double, input_features string not null,
    predicted_value double not null, confidence_score double, prediction_interval_lower double,
    prediction_interval_upper double, actual_value double, prediction_error double, computation_time double,
    metadata string
"""
QUALITY_FLAGS = {"good": 0, "suspect": 1, "bad": 2}


# States an experiment and a shot can have.
EXPERIMENT_STATES = ("planned", "running", "completed", "failed", "cancelled")
SHOT_STATES = ("planned", "running", "completed", "disrupted", "failed")


@dataclass(frozen=True)
class Layout:
    """A declared table: columns, unique keys (the first is the primary one), references to the id of other tables, value
    lists, and what an absent or null value becomes on a write."""

    columns: str
    unique: tuple[tuple[str, ...], ...] = (("id",),)
    references: dict[str, str] = field(default_factory=dict)
    choices: dict[str, tuple] = field(default_factory=dict)
    defaults: dict[str, object] = field(default_factory=dict)

    def schema(self, spark: SparkSession):
        return spark.createDataFrame([], self.columns).schema


STORE = {
    "experiments": Layout(EXPERIMENTS, choices={"status": EXPERIMENT_STATES}, defaults={"status": "planned", "metadata": "{}"}),
    "shots": Layout(
        SHOTS, (("id",), ("experiment_id", "shot_number")), {"experiment_id": "experiments"}, {"status": SHOT_STATES},
        {"status": "completed", "had_disruption": False, "diagnostics_data": "{}", "analysis_results": "{}"}),
    "measurements": Layout(MEASUREMENTS, references={"shot_id": "shots"}, choices={"quality_flag": tuple(QUALITY_FLAGS.values())}, defaults={"quality_flag": QUALITY_FLAGS["good"]}),
    "predictions": Layout(PREDICTIONS, references={"shot_id": "shots"}, defaults={"metadata": "{}"}),
}


def typed(df: DataFrame, layout: Layout) -> DataFrame:
    """`df` with the columns and types of `layout`, defaults filled in, and `_unreadable`: the columns whose value is not of
    the declared type (they become null). Absent columns are null, further ones are left out."""
    kinds = {f.name: f.dataType for f in layout.schema(df.sparkSession)}
    raw = {c: F.col(f"`{c}`") if c in df.columns else F.lit(None) for c in kinds}
    read = {c: raw[c].try_cast(k) for c, k in kinds.items()}
    bad = F.array_compact(F.array(*[F.when(raw[c].isNotNull() & read[c].isNull(), F.lit(c)) for c in kinds]))
    given = {c: F.when(raw[c].isNull(), F.lit(layout.defaults[c]).cast(kinds[c])).otherwise(v) if c in layout.defaults else v for c, v in read.items()}
    return df.select(*[v.alias(c) for c, v in given.items()], bad.alias("_unreadable"))


def row_rules(layout: Layout, spark: SparkSession) -> dict[str, Column]:
    """Rules a row of `typed` breaks by itself, by name; a missing value is not unknown, an unreadable one not missing."""
    fields = layout.schema(spark).fields
    unread = {f.name: F.array_contains("_unreadable", f.name) for f in fields}
    rules = {f"{f.name} missing": F.col(f.name).isNull() & ~unread[f.name] for f in fields if not f.nullable}
    rules |= {f"{f.name} unreadable": unread[f.name] for f in fields if f.dataType.typeName() != "string"}
    return rules | {f"{c} unknown": F.coalesce(~F.col(c).isin(*values), F.lit(False)) for c, values in layout.choices.items()}


def accepted(df: DataFrame, layout: Layout) -> tuple[DataFrame, DataFrame]:
    """(rows of `typed` that break no rule of their own, the others with `broken`, the names of the rules)."""
    rules = row_rules(layout, df.sparkSession)
    judged = typed(df, layout).withColumn("broken", F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()])))
    return judged.where(F.size("broken") == 0).drop("broken", "_unreadable"), judged.where(F.size("broken") > 0)


def store_report(given: dict[str, DataFrame], layouts: dict[str, Layout] = STORE) -> DataFrame:
    """(table, rule, violations): every rule of every given table, also those nobody breaks.

    Rules of single rows are one aggregate a table. A key held by n rows counts n - 1 times; keys with a null part are
    never equal. References are counted per value before they meet the parent, so a shot with most measurements is one
    row of the join; a null reference is none. A parent that is not given has no ids.
    """
    ready = {name: typed(df, layouts[name]) for name, df in given.items()}
    out = []

    def told(df: DataFrame, name: str, rule: str, n: Column) -> None:
        out.append(df.agg(F.coalesce(n, F.lit(0)).cast("bigint").alias("violations")).select(F.lit(name).alias("table"), F.lit(rule).alias("rule"), "violations"))

    for name, df in ready.items():
        layout = layouts[name]
        rules = row_rules(layout, df.sparkSession)
        counts = df.agg(*[F.count_if(c).alias(n) for n, c in rules.items()])
        listed = F.explode(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"`{n}`").alias("violations")) for n in rules]))
        out.append(counts.select(listed.alias("r")).select(F.lit(name).alias("table"), "r.rule", "r.violations"))
        for key in layout.unique:
            told(duplicate_keys(df.dropna(subset=list(key)), list(key)), name, f"{', '.join(key)} unique", F.sum(F.col("n") - 1))
        for column, parent in layout.references.items():
            held = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
            lost = orphans(held, column, ready[parent], "id") if parent in ready else held
            told(lost, name, f"{column} known", F.sum("n"))
    return reduce(DataFrame.unionByName, out)


def duplicate_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def orphans(child: DataFrame, fk: str, parent: DataFrame, pk: str) -> DataFrame:
    return child.join(parent.select(F.col(pk).alias("_pk")), F.col(fk) == F.col("_pk"), "left_anti")


def constraint_report(checks: dict[str, DataFrame]) -> DataFrame:
    """One row per named check with the number of offending rows."""
    parts = [df.agg(F.count(F.lit(1)).alias("violations")).select(F.lit(n).alias("rule"), "violations") for n, df in checks.items()]
    return reduce(DataFrame.unionByName, parts)


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Fill absent or null columns before a bulk store."""
    return df.withColumns({c: F.coalesce(F.col(c), v) if c in df.columns else v for c, v in defaults.items()})


def store_measurements(df: DataFrame, path: str, shot: str, buckets: int | None = None, bucket_rows: int = 5_000_000) -> None:
    """Columnar store partitioned by a hash bucket of the shot, so one shot reads one folder.

    Without `buckets` there is one for every `bucket_rows` rows, 16 at least; a store that is appended to needs the number
    of its first write. Rows are dealt by bucket and a further hash of all columns first: a folder gets a few files from
    few tasks, and a shot that holds many rows is written by several.
    """
    n = buckets or max(16, -(-df.count() // bucket_rows))
    split = F.pmod(F.xxhash64(*df.columns), F.lit(4))
    bucketed = df.withColumn("shot_bucket", F.pmod(F.xxhash64(shot), F.lit(n)).cast("int"))
    bucketed.repartition(F.col("shot_bucket"), split).write.mode("append").partitionBy("shot_bucket").parquet(path)


def documents_with_size(df: DataFrame, body: str) -> DataFrame:
    return df.withColumns({
        "size_bytes": F.octet_length(body).cast("bigint"),
        "fields_count": F.size(F.expr(f"json_object_keys({body})")).cast("bigint"),
    })
