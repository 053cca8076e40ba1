"""Starting streams and their sinks: file sources, run-to-end, per-batch writers that can be repeated."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from gaugeworks.sources.files import scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER_KEY = "spark.sql.streaming.stateStore.providerClass"


def file_stream(spark: SparkSession, folder: str, schema: T.StructType | str, pattern: str | None = None, fmt: str = "parquet", files_per_batch: int | None = None) -> DataFrame:
    r = spark.readStream.format(fmt).schema(schema)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    if files_per_batch:
        r = r.option("maxFilesPerTrigger", str(files_per_batch))
    return r.load(folder)


def event_time(df: DataFrame, ts: str, delay: str = "10 minutes") -> DataFrame:
    """A timestamp column fit for watermarks, with the watermark set."""
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


@contextmanager
def keyed_state(spark: SparkSession):
    """State kept in RocksDB while the block runs, as the keyed processors require."""
    before = spark.conf.get(PROVIDER_KEY, None)
    spark.conf.set(PROVIDER_KEY, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(PROVIDER_KEY, before) if before else spark.conf.unset(PROVIDER_KEY)


def drain(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all data now available into a parquet table and read that back."""
    spark = df.sparkSession
    out, ckpt = scratch(spark, f"{name}-out"), scratch(spark, f"{name}-ckpt")
    q = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def drain_batches(df: DataFrame, name: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over all data now available through a per-batch function."""
    ckpt = scratch(df.sparkSession, f"{name}-ckpt")
    q = df.writeStream.foreachBatch(handle).option("checkpointLocation", ckpt).trigger(availableNow=True).start()
    q.awaitTermination()


def write_batch(df: DataFrame, folder: str, epoch: int) -> None:
    """One folder per batch, overwritten when the batch is repeated after a failure."""
    df.write.mode("overwrite").parquet(f"{folder}/epoch={epoch}")
