"""Order, limits, ranks, distinct rows and set differences."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from gaugeworks.operators.aggregate import rows
from gaugeworks.session import scalar_row


def page(df: DataFrame, order: str, tie: str, limit: int = 100, offset: int = 0, desc: bool = True) -> DataFrame:
    """One page of ordered rows, newest first by default, ties by key."""
    return df.orderBy(F.desc(order) if desc else F.asc(order), tie).offset(offset).limit(limit)


def top_groups(df: DataFrame, by: Sequence[str], k: int) -> DataFrame:
    return df.groupBy(*by).agg(rows().alias("n")).orderBy(F.desc("n"), *by).limit(k)


def slowest(df: DataFrame, seconds: str, ts: str, tie: str, now: str, hours: int, k: int) -> DataFrame:
    recent = df.filter(F.col(ts) > F.lit(now).cast("timestamp_ntz") - F.make_interval(hours=F.lit(hours)))
    return recent.orderBy(F.desc(seconds), tie).limit(k)


def ranked_share(df: DataFrame, score: str, tie: str) -> DataFrame:
    """Scores as shares of their total, best first."""
    total = scalar_row(df.agg(F.sum(score).alias("total")))
    return df.withColumn("share", F.try_divide(score, total["total"])).orderBy(F.desc("share"), tie)


def best(df: DataFrame, score: str, tie: str) -> DataFrame:
    """The row with the highest score."""
    return df.agg(F.max_by(F.struct(*df.columns), F.struct(score, tie)).alias("b")).select("b.*")


def recent(df: DataFrame, ts: str, n: int) -> DataFrame:
    return df.orderBy(F.desc(ts)).limit(n)


def distinct_rows(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    return df.dropDuplicates(list(subset) if subset else None)


def missing_columns(df: DataFrame, required: Sequence[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def missing_rows(required: DataFrame, present: DataFrame) -> DataFrame:
    return required.exceptAll(present)


def any_flag(flags: Sequence[Column]) -> Column:
    """Union of flagged rows over several methods."""
    return reduce(lambda a, b: a | b, [F.coalesce(f, F.lit(False)) for f in flags])
