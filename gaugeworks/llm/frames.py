"""Small helpers around DataFrames shared by the operators: private column names, tables by name, folders, components."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from gaugeworks.session import checkpoint_dir, durable


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns under private names, so that further columns can't clash; ids and texts typed."""
    return df.select(*[F.col(f"`{c}`").alias(k) for k, c in columns.items()])


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder below the shared one."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(df: DataFrame, text: str) -> int:
    """UTF-8 bytes of all texts: one pass over one column."""
    return df.select(F.sum(F.octet_length(F.col(f"`{text}`")).cast("long"))).first()[0] or 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of the undirected edges; root is the smallest node of its component.

    Alternating large-star and small-star steps: every node sends its larger, then its smaller neighbours to the
    smallest node it knows, until nothing moves. Each step is a grouped minimum and a join, so no component meets in
    one task, and the rounds grow with the logarithm of its diameter. Each round's edges are written to the shared
    folder. Null nodes and loops are left out.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null and u <> v")
    e = durable(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    last = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("w")).select("u", F.least("u", "w").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v")))
        e = durable(small.distinct())
        now = e.agg(F.count("*"), F.sum(F.hash("u", "v").cast("long")), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == last:
            break
        last = now
    roots = e.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def bounded(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows of `df` by a hash of `key`, all if there are no more; the same rows at every run."""
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64(F.col(f"`{key}`").cast("string")), F.lit(1 << 30)) < int((1 << 30) * most / n))


def kept_table(df: DataFrame, name: str) -> DataFrame:
    """`df` written once to a new folder below the shared one, and read from there."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
