"""Streaming forms of the windowed and event operators.

Rules over the last rows of a key run per micro-batch through the batch operators, together with the few
rows of earlier batches they still need; so hot keys are split exactly as in batch. What needs true keyed
state uses `transformWithStateInPandas`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from gaugeworks.operators.windows import bucket_step, cooldown_alerts, latest_rows, sliding_metrics
from gaugeworks.session import broadcast_if_small, match
from gaugeworks.streaming.core import write_batch


def process_messages(df: DataFrame, temperature: str, density: str, alerts: dict[str, Column]) -> DataFrame:
    """Messages that carry both readings, with derived metrics and the names of the alerts they meet."""
    have = df.filter(F.col(temperature).isNotNull() & F.col(density).isNotNull())
    return have.withColumns({
        "product": F.col(temperature) * F.col(density),
        "alerts": F.array_compact(F.array(*[F.when(c, n) for n, c in alerts.items()])),
    })


class TailState:
    """The last rows per key of all batches so far.

    A batch writes the rows of its own keys only (one folder per epoch, in buckets of the key's hash), and reads back no other
    buckets and keys. Every `every` epochs the newest rows of all keys become a snapshot, so a read sees one snapshot and
    fewer than `every` epochs; what is older than the snapshot before is deleted, as no repeated batch can ask for it.
    Keys that no batch has touched for `idle` epochs are left out of a snapshot.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, keys: Sequence[str], every: int = 10, idle: int | None = None, buckets: int = 32):
        self.spark, self.folder, self.keys, self.every, self.idle, self.buckets = spark, folder, list(keys), every, idle, buckets
        self.columns = schema.fieldNames()
        self.schema = T.StructType([*schema.fields, T.StructField("_epoch", T.LongType()), T.StructField("_bucket", T.IntegerType())])

    def bucket(self) -> Column:
        return F.pmod(F.hash(*self.keys), F.lit(self.buckets))

    def _path(self, kind: str, epoch: int) -> str:
        return f"{self.folder}/{kind}={epoch}"

    def _write(self, df: DataFrame, kind: str, epoch: int) -> None:
        df.select(*self.columns, "_epoch", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(self._path(kind, epoch))

    def _newest(self, base: int, epoch: int) -> DataFrame:
        """The newest rows of every key before `epoch`, from the snapshot at `base` and the epochs since."""
        paths = [*([self._path("snapshot", base)] if base else []), *[self._path("epoch", e) for e in range(base, epoch)]]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        rows = reduce(DataFrame.unionByName, [self.spark.read.schema(self.schema).parquet(p) for p in paths])
        return rows.withColumn("_last", F.max("_epoch").over(W.partitionBy("_bucket", *self.keys))).filter("_epoch = _last").drop("_last")

    def _delete(self, kind: str, epoch: int) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self._path(kind, epoch))
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def before(self, epoch: int, batch: DataFrame) -> DataFrame:
        """What the state holds for the keys of a batch."""
        base = epoch - epoch % self.every
        if base == epoch and epoch:
            rows = self._newest(epoch - self.every, epoch)
            self._write(rows.filter(F.col("_epoch") >= epoch - self.idle) if self.idle else rows, "snapshot", epoch)
            for old in range(max(0, epoch - 3 * self.every), epoch - self.every):
                self._delete("epoch", old)
            if epoch >= 2 * self.every:
                self._delete("snapshot", epoch - 2 * self.every)
        touched = batch.select(*self.keys, self.bucket().alias("_bucket")).distinct()
        numbers = [r["_bucket"] for r in touched.select("_bucket").distinct().collect()]  # at most `buckets`
        rows = self._newest(base, epoch).filter(F.col("_bucket").isin(numbers))
        return match(rows, broadcast_if_small(touched.select(*self.keys)), self.keys, "left_semi").select(*self.columns)

    def keep(self, df: DataFrame, epoch: int) -> None:
        """The new rows of the batch's keys; they replace all that these keys had."""
        self._write(df.withColumns({"_epoch": F.lit(epoch).cast("bigint"), "_bucket": self.bucket()}), "epoch", epoch)


def sliding_batches(spark: SparkSession, schema: T.StructType, keys: Sequence[str], order: Sequence[str], temperature: str, density: str, confinement: str | None, n: int, out: str, state: str, **kept):
    """Per-batch handler: metrics of the last `n` messages of each source, across batches. kept: options of the state."""
    tail = TailState(spark, state, schema, keys, **kept)

    def handle(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        both = tail.before(epoch, batch).withColumn("_new", F.lit(False)).unionByName(batch.withColumn("_new", F.lit(True))).persist()
        got = sliding_metrics(both, keys, order, temperature, density, confinement, n)
        write_batch(got.filter("_new").drop("_new"), out, epoch)
        tail.keep(latest_rows(both.drop("_new"), keys, order, n - 1), epoch)
        both.unpersist()
        batch.unpersist()

    return handle


def cooldown_batches(spark: SparkSession, schema: T.StructType, keys: Sequence[str], micros: str, tie: str, condition: Column, wait_seconds: int, out: str, state: str, **kept):
    """Per-batch handler: alerts with a pause per key; the last firing of each key stands in for its past.

    The old row is the first of its key, so it fires first and sets the clock, then it is dropped. kept: options of the state.
    """
    tail = TailState(spark, state, schema, keys, **kept)

    def handle(batch: DataFrame, epoch: int) -> None:
        batch = batch.filter(condition).persist()
        both = tail.before(epoch, batch).withColumn("_new", F.lit(False)).unionByName(batch.withColumn("_new", F.lit(True)))
        got = cooldown_alerts(both, keys, micros, tie, condition, wait_seconds).persist()
        write_batch(got.filter("_new").drop("_new"), out, epoch)
        tail.keep(latest_rows(got.filter("fired").drop("_new", "fired"), keys, [micros, tie], 1), epoch)
        got.unpersist()
        batch.unpersist()

    return handle


def batch_metrics(batch: DataFrame, order: str, cols: Sequence[str]) -> DataFrame:
    """Size, mean and range of a micro-batch beside its last message."""
    rest = [c for c in batch.columns]
    return batch.agg(F.max_by(F.struct(*rest), order).alias("last"), F.count(F.lit(1)).alias("batch_size"), *[f(c).alias(f"{n}_{c}") for c in cols for n, f in (("avg", F.avg), ("min", F.min), ("max", F.max))])


def windows(df: DataFrame, ts: str, keys: Sequence[str], value: str, length: str, slide: str | None = None) -> DataFrame:
    """Count, sum and mean per event-time window; rows behind the watermark are dropped."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    g = df.groupBy(w.alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n", "total", "mean")


def deduplicate(df: DataFrame, message_id: str) -> DataFrame:
    return df.dropDuplicatesWithinWatermark([message_id])


def sessions(df: DataFrame, ts: str, keys: Sequence[str], gap: str) -> DataFrame:
    g = df.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "n")


def pair_with_timeout(started: DataFrame, completed: DataFrame, run: str, start_ts: str, end_run: str, end_ts: str, limit: str) -> DataFrame:
    """Starts joined to a completion within `limit`; a start whose time is up comes out alone."""
    inside = (F.col(run) == F.col(end_run)) & (F.col(end_ts) >= F.col(start_ts)) & (F.col(end_ts) <= F.col(start_ts) + F.expr(f"interval {limit}"))
    return started.join(completed, inside, "left_outer").withColumn("timed_out", F.col(end_ts).isNull())


def fan_out(first: str, second: str, split: Column):
    """Per-batch handler: all rows to one sink, those that meet a condition to another; the batch is computed once."""

    def handle(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        write_batch(batch, first, epoch)
        write_batch(batch.filter(split), second, epoch)
        batch.unpersist()

    return handle


class RateLimiter(StatefulProcessor):
    """Token buckets per key; the state is the tokens of each window and the time of the last request."""

    def __init__(self, micros: str, tie: str, limits: dict[str, int], columns: list[str]):
        self.micros, self.tie, self.limits, self.columns = micros, tie, limits, columns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("tokens", "values array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values([self.micros, self.tie], kind="stable")
        before = list(self.state.get()[0]) if self.state.exists() else [*[float(v) for v in self.limits.values()], math.nan]
        out, after = bucket_step(self.micros, self.limits)(pdf, before)
        self.state.update(([float(v) for v in after],))
        yield pdf[self.columns].assign(**out)

    def close(self) -> None:
        pass


def rate_limit_stream(df: DataFrame, key: str, micros: str, tie: str, limits: dict[str, int]) -> DataFrame:
    schema = T.StructType([*df.schema.fields, T.StructField("verdict", T.StringType())])
    return df.groupBy(key).transformWithStateInPandas(RateLimiter(micros, tie, limits, df.columns), schema, "Append", "None")
