"""Databases and message logs: option builders around Spark's own connectors (their jars are not bundled)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, DataFrameReader, DataFrameWriter, SparkSession, functions as F, types as T
from pyspark.sql.streaming import DataStreamReader, DataStreamWriter

MESSAGE_DDL = "data map<string,double>, timestamp string, source string, message_id string"


def jdbc_reader(spark: SparkSession, url: str, query: str, split: tuple[str, int, int, int] | None = None, **options) -> DataFrameReader:
    """A query, or, with `split` = (column, lower, upper, partitions), a parallel read of it."""
    reader = spark.read.format("jdbc").option("url", url).options(**options)
    if split is None:
        return reader.option("query", query)
    column, lower, upper, parts = split
    return (
        reader.option("dbtable", f"({query}) q").option("partitionColumn", column)
        .option("lowerBound", str(lower)).option("upperBound", str(upper)).option("numPartitions", str(parts))
    )


def jdbc_appender(df: DataFrame, url: str, table: str, **options) -> DataFrameWriter:
    return df.write.format("jdbc").mode("append").option("url", url).option("dbtable", table).options(**options)


def kafka_reader(spark: SparkSession, servers: str, topic: str, max_per_trigger: int | None = None) -> DataStreamReader:
    """A topic as a stream; `max_per_trigger` limits the offsets of a batch, by default there is no limit."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "latest")
    return reader.option("maxOffsetsPerTrigger", str(max_per_trigger)) if max_per_trigger else reader


def kafka_writer(df: DataFrame, servers: str, topic: str, checkpoint: str) -> DataStreamWriter:
    return (
        df.writeStream.format("kafka").option("kafka.bootstrap.servers", servers).option("kafka.acks", "all")
        .option("topic", topic).option("checkpointLocation", checkpoint)
    )


def decode(df: DataFrame, schema: str | T.StructType = MESSAGE_DDL, value: str = "value") -> DataFrame:
    """JSON values to columns; `timestamp` text becomes a timestamp for watermarks."""
    parsed = df.select(F.from_json(F.col(value).cast("string"), schema).alias("m")).select("m.*")
    if "timestamp" in parsed.columns:
        parsed = parsed.withColumn("timestamp", F.to_timestamp("timestamp"))
    return parsed


def encode(df: DataFrame, key: str | Column) -> DataFrame:
    """Rows as (key, value) pairs of text, the value being the row as JSON."""
    k = F.col(key) if isinstance(key, str) else key
    return df.select(k.cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))
