"""Session settings, durable cuts of lineage, and size checks."""

from __future__ import annotations

import tempfile
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

GROUP_ROWS_KEY = "spark.gaugeworks.groupRows"
BROADCAST_ROWS_KEY = "spark.gaugeworks.broadcastRows"


def build(app: str = "gaugeworks", master: str | None = None, **conf: str) -> SparkSession:
    """Create a session with the settings every operator assumes."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in conf.items():
        b = b.config(k, v)
    return prepare(b.getOrCreate())


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings: UTC clock, adaptive plans, skewed joins split even below a group-by."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
    return spark


def group_rows(spark: SparkSession) -> int:
    """Most rows of one ordered group that a single task may hold."""
    return int(spark.conf.get(GROUP_ROWS_KEY, "1000000"))


def broadcast_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_ROWS_KEY, "100000"))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a private one only on a local master with none set."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if shared:
        if not current or shared.rstrip("/") not in current:
            sc.setCheckpointDir(shared)
        return shared
    if current:
        return current
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    own = tempfile.mkdtemp(prefix="gaugeworks-ckpt-")
    sc.setCheckpointDir(own)
    return own


def durable(df: DataFrame) -> DataFrame:
    """Write `df` to the shared folder and go on from there; survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows dealt over all tasks by a hash of a unique key and written once, for fits that read them many times."""
    return durable(df.repartition(*keys))


def dealt(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Columns of rows written once for fits that read them many times: by `spread` if the rows come in fewer pieces than there
    are tasks, else where they are, as a shuffle would hold them on disk a second time, with their key."""
    if df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism:
        return spread(df, *keys).select(*cols)
    return durable(df.select(*cols))


def small(df: DataFrame, rows: int | None = None) -> bool:
    """True when `df` has at most `rows` rows; the probe stops as soon as it has seen one more."""
    limit = rows or broadcast_rows(df.sparkSession)
    return df.limit(limit + 1).count() <= limit


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Broadcast hint only for a side whose row count has been checked; else Spark picks the join."""
    return F.broadcast(df) if small(df, rows) else df


def match(left: DataFrame, right: DataFrame, by, how: str = "inner") -> DataFrame:
    """Equi-join on columns of the same name in which null equals null, so that no group is lost."""
    by = list(by)
    if not by:
        raise ValueError("match needs key columns")
    other = right.withColumnsRenamed({c: f"_match_{c}" for c in by})
    cond = [left[c].eqNullSafe(other[f"_match_{c}"]) for c in by]
    return left.join(other, cond, how).drop(*[f"_match_{c}" for c in by])


def scalar_row(df: DataFrame):
    """A one-row aggregate as a struct column: a scalar subquery, planned once, nothing joined."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("s")).scalar()


def rows_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A rule table: its size is that of the Python list that states it, hence always broadcast."""
    return F.broadcast(spark.createDataFrame(rows, schema))
