"""CSV, JSON and Parquet readers and writers, landed JSON documents, multi-source ingest."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from gaugeworks.session import checkpoint_dir

FORMATS = ("csv", "json", "parquet")


def _checked(fmt: str) -> str:
    if fmt.lower() not in FORMATS:
        raise ValueError(f"unsupported format {fmt!r}, expected one of {FORMATS}")
    return fmt.lower()


def read(spark: SparkSession, path: str, fmt: str = "csv", schema: T.StructType | str | None = None, **options) -> DataFrame:
    """Read a file or folder; FileNotFoundError when absent, ValueError for another format."""
    fmt = _checked(fmt)
    opts = {"header": "true", "escape": '"', **options} if fmt == "csv" else options
    reader = spark.read.options(**opts)
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", "true")
    try:
        return reader.format(fmt).load(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from e
        raise


def write(df: DataFrame, path: str, fmt: str = "csv", partition_by: tuple[str, ...] = (), **options) -> bool:
    fmt = _checked(fmt)
    opts = {"header": "true", "escape": '"', **options} if fmt == "csv" else options
    out = df.write.mode("overwrite").options(**opts)
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.format(fmt).save(path)
    return True


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder beside the checkpoints, reachable from every executor."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def json_records(df: DataFrame, field: str = "data") -> DataFrame:
    """Rows from landed JSON documents: a list of records, `{"data": [records]}`, or one record.

    The reader already turns a top-level list into rows; the other two shapes are told apart per row.
    """
    if field not in df.columns or not isinstance(df.schema[field].dataType, T.ArrayType):
        return df
    item = df.schema[field].dataType.elementType
    names = list(dict.fromkeys([*item.fieldNames(), *[c for c in df.columns if c != field]]))

    def cell(source: Column, have: list[str], n: str) -> Column:
        return (source[n] if n in have else F.lit(None)).alias(n)

    own = [c for c in df.columns if c != field]
    wrapped = df.filter(F.col(field).isNotNull()).select(F.explode(field).alias("_r"))
    wrapped = wrapped.select(*[cell(F.col("_r"), item.fieldNames(), n) for n in names])
    if not own:
        return wrapped
    single = df.filter(F.col(field).isNull()).select(F.struct(*own).alias("_r"))
    return wrapped.unionByName(single.select(*[cell(F.col("_r"), own, n) for n in names]))


def read_json_documents(spark: SparkSession, path: str, **options) -> DataFrame:
    return json_records(read(spark, path, "json", **{"multiLine": "true", **options}))


@dataclass
class Source:
    name: str
    load: Callable[[SparkSession], DataFrame]
    enabled: bool = True


def ingest(spark: SparkSession, sources: list[Source], strict: bool = False) -> tuple[DataFrame, list[str]]:
    """Union the enabled sources by column name. A source that cannot be opened is reported, or with `strict` ends the
    run; any other error, such as one in a caller's `load`, always does."""
    frames, failed = [], []
    for s in sources:
        if not s.enabled:
            continue
        try:
            frames.append(s.load(spark))
        except (AnalysisException, OSError):
            if strict:
                raise
            failed.append(s.name)
    if not frames:
        raise ValueError("no source delivered data")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames), failed


def expand_grid(df: DataFrame, steps: int, wave_cols: list[str], step_seconds: float = 0.1, amplitude: float = 0.05, period: float = 50.0) -> DataFrame:
    """Every row at `steps` time steps, with a sine modulation of some columns."""
    grid = df.withColumn("time_step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1))))
    wave = 1 + amplitude * F.sin(2 * F.pi() * F.col("time_step") / period)
    return grid.withColumns({"timestamp": F.col("time_step") * step_seconds, **{c: F.col(c) * wave for c in wave_cols}})


def flatten_map(df: DataFrame, col: str, keys: list[str], prefix: str = "param_") -> DataFrame:
    """Map entries as columns `param_<key>`, for flat exports."""
    return df.select(*[c for c in df.columns if c != col], *[F.element_at(col, k).alias(prefix + k) for k in keys])
