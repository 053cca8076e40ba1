"""Named transformation steps, runs over sources and sinks, and flows declared as data."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from gaugeworks.operators import project as p
from gaugeworks.operators import quality as q
from gaugeworks.operators.filters import OPERATORS, where_all
from gaugeworks.session import durable
from gaugeworks.sources.files import Source, ingest, read, write


@dataclass
class Step:
    """A function from table to table; missing inputs stop the run, missing outputs are reported."""

    name: str
    apply: Callable[..., DataFrame]
    config: dict = field(default_factory=dict)
    requires: Sequence[str] = ()
    expects: Sequence[str] = ()

    def __call__(self, df: DataFrame, warnings: list[str] | None = None) -> DataFrame:
        gone = [c for c in self.requires if c not in df.columns]
        if gone:
            raise ValueError(f"step {self.name}: missing columns {gone}")
        out = self.apply(df, **self.config)
        lost = [c for c in self.expects if c not in out.columns]
        if lost and warnings is not None:
            warnings.append(f"step {self.name}: expected columns {lost}")
        return out


@dataclass
class Run:
    """Outcome of a run; `table` can be appended to a run log."""

    name: str
    status: str = "completed"
    rows_in: int = 0
    rows_out: int = 0
    rows_failed: int = 0
    failed_sources: list[str] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    violations: dict[str, int] = field(default_factory=dict)
    started: datetime = field(default_factory=lambda: datetime.now(timezone.utc))
    data: DataFrame | None = None

    def table(self, spark: SparkSession) -> DataFrame:
        schema = "name string, status string, rows_in bigint, rows_out bigint, rows_failed bigint, started timestamp"
        return spark.createDataFrame([(self.name, self.status, self.rows_in, self.rows_out, self.rows_failed, self.started)], schema)


def run(spark: SparkSession, name: str, sources: Sequence[Source], steps: Sequence[Step], rules: dict[str, Column] | None = None, sinks: Sequence[tuple[str, str]] = (), stop_on_invalid: bool = False) -> Run:
    """Read and union the sources, apply the steps, count broken rules, write the sinks.

    Row counts are observed while the table is materialised once; the rule counts ride along.
    """
    got = Run(name)
    df, got.failed_sources = ingest(spark, list(sources))
    seen_in, seen_out = Observation(f"{name}-in"), Observation(f"{name}-out")
    df = df.observe(seen_in, F.count(F.lit(1)).alias("n"))
    for s in steps:
        df = s(df, got.warnings)
    counts = [F.count_if(c).alias(f"rule_{n}") for n, c in (rules or {}).items()]
    df = durable(df.observe(seen_out, F.count(F.lit(1)).alias("n"), *counts))
    got.rows_in, got.rows_out = seen_in.get["n"], seen_out.get["n"]
    got.violations = {n: seen_out.get[f"rule_{n}"] for n in rules or {}}
    got.rows_failed = sum(got.violations.values())
    got.data = df
    if got.rows_failed and stop_on_invalid:
        got.status = "failed"
        return got
    for path, fmt in sinks:
        write(df, path, fmt)
    return got


def _aggregate(df: DataFrame, by: Sequence[str], measures: dict[str, str]) -> DataFrame:
    fns = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}
    return df.groupBy(*by).agg(*[fns[f](c).alias(f"{c}_{f}") for c, f in measures.items()])


# Kinds of declared steps.
KINDS: dict[str, Callable[..., DataFrame]] = {
    "normalize": lambda df, rules: p.normalize_units(df, {c: tuple(v) for c, v in rules.items()}),
    "calculate": lambda df, columns: df.withColumns({n: p.formula(df, text) for n, text in columns.items()}),
    "filter": lambda df, conditions: where_all(df, [tuple(c) for c in conditions]),
    "outliers": lambda df, columns, method="iqr", threshold=1.5: q.drop_outliers(df, columns, method, threshold),
    "aggregate": lambda df, by, measures: _aggregate(df, by, measures),
}


def register_kind(name: str, fn: Callable[..., DataFrame]) -> None:
    """Make a custom step kind available to declared flows."""
    KINDS[name] = fn


def check_spec(spec: dict) -> list[str]:
    """Problems of a declared flow; empty when it can run."""
    bad = [f"missing {k}" for k in ("name", "sources") if not spec.get(k)]
    for s in spec.get("sources", []):
        bad += [f"source without {k}" for k in ("name", "path", "format") if k not in s]
    for t in spec.get("transformations", []):
        if t.get("kind") not in KINDS:
            bad.append(f"unknown kind {t.get('kind')!r}")
        for c in t.get("config", {}).get("conditions", []):
            if c[1] not in OPERATORS:
                bad.append(f"unknown operator {c[1]!r}")
    return bad


def run_spec(spark: SparkSession, spec: dict) -> Run:
    """Run a flow declared as a dict of sources, transformations and outputs."""
    bad = check_spec(spec)
    if bad:
        raise ValueError("; ".join(bad))
    sources = [Source(s["name"], lambda sp, s=s: read(sp, s["path"], s["format"]), s.get("enabled", True)) for s in spec["sources"]]
    steps = [Step(t.get("name", t["kind"]), KINDS[t["kind"]], t.get("config", {}), t.get("requires", ())) for t in spec.get("transformations", [])]
    return run(spark, spec["name"], sources, steps, sinks=[(o["path"], o["format"]) for o in spec.get("outputs", [])])


@dataclass
class Rules:
    """Constraints, metrics and targets registered at run time, kept as rows."""

    constraints: list[tuple] = field(default_factory=lambda: list(q.CONSTRAINTS))
    metrics: list[tuple] = field(default_factory=lambda: list(p.BUSINESS_METRICS))
    targets: list[tuple] = field(default_factory=list)

    def add_constraint(self, column: str, lo: float, hi: float, typical_lo: float | None = None, typical_hi: float | None = None) -> None:
        self.constraints = [c for c in self.constraints if c[0] != column]
        self.constraints.append((column, lo, hi, lo if typical_lo is None else typical_lo, hi if typical_hi is None else typical_hi))

    def add_metric(self, name: str, text: str, category: str = "", target: float | None = None, better: str = "higher") -> None:
        self.metrics = [m for m in self.metrics if m[0] != name]
        self.metrics.append((name, text, category, target, better))

    def add_target(self, name: str, comparison: str, target: float, window: int = 300) -> None:
        self.targets = [t for t in self.targets if t[0] != name]
        self.targets.append((name, comparison, target, window))

    def evaluate_metrics(self, df: DataFrame) -> DataFrame:
        """Every metric as a column; those whose inputs are absent are 0."""
        return df.withColumns({m[0]: p.formula(df, m[1]) for m in self.metrics})
