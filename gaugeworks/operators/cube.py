"""Cubes: a table with named dimensions, measures and one aggregate per measure."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, functions as F

AGGREGATES = {"sum": F.sum, "mean": F.avg, "count": F.count}
GRANULARITIES = ("minute", "hour", "day", "week", "month", "quarter", "year")


@dataclass(frozen=True)
class Cube:
    data: DataFrame
    dimensions: list[str]
    measures: list[str]
    aggregations: dict[str, str] = field(default_factory=dict)

    def _measure(self, m: str) -> Column:
        return AGGREGATES[self.aggregations.get(m, "sum")](m).alias(m)

    def slice(self, dimension: str, value) -> "Cube":
        """Fix one dimension and drop it from the dimensions."""
        left = [d for d in self.dimensions if d != dimension]
        return replace(self, data=self.data.filter(F.col(dimension) == value), dimensions=left)

    def dice(self, filters: dict) -> "Cube":
        """Keep given values, or lists of values, of known dimensions."""
        df = self.data
        for d, v in filters.items():
            if d in self.dimensions:
                df = df.filter(F.col(d).isin(v) if isinstance(v, list) else F.col(d) == v)
        return replace(self, data=df)

    def roll_up(self, dimension: str) -> "Cube":
        """Aggregate one dimension away; a repeated mean is then a mean of means."""
        left = [d for d in self.dimensions if d != dimension]
        return replace(self, data=self.data.groupBy(*left).agg(*[self._measure(m) for m in self.measures]), dimensions=left)

    def drill_down(self, ts: str, granularity: str) -> "Cube":
        """Group by the dimensions and the time truncated to a granularity."""
        if granularity not in GRANULARITIES:
            raise ValueError(f"granularity must be one of {GRANULARITIES}")
        unit = F.date_trunc(granularity, F.col(ts).cast("timestamp")).cast("timestamp_ntz").alias(granularity)
        data = self.data.groupBy(*self.dimensions, unit).agg(*[self._measure(m) for m in self.measures])
        return replace(self, data=data, dimensions=[*self.dimensions, granularity])

    def pivot(self, rows: list[str], column: str, values: list, measure: str) -> DataFrame:
        """Rows by the given values of one column, empty cells 0; the value list keeps it a single pass."""
        return self.data.groupBy(*rows).pivot(column, values).agg(self._measure(measure)).na.fill(0)

    def all_totals(self) -> DataFrame:
        """Every level of the roll-up hierarchy in one pass, null meaning all."""
        return self.data.rollup(*self.dimensions).agg(*[self._measure(m) for m in self.measures])
