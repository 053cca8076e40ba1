"""Forests and boosting on cells: rows whose features fall into the same bins are added up once, trees grow on the sums.

A tree of at most 32 bins a feature, MLlib's default, sees no more of a row than its bins, so the rows are read once for all trees
and levels. The number of cells depends on the features alone: 32,768 for three of them, however many rows and values there are.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.ml.linalg import DenseVector
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, functions as F

from gaugeworks.operators.aggregate import rows
from gaugeworks.session import durable

BINS = 32
CELLS = 1 << 15
VALUES = 10_000
# Poisson(1) distribution function at 0, 1, 2, ... in 2^-32: a 32-bit number draws as many as the places it has passed.
_POISSON = np.array([int(2 ** 32 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(11)], np.uint32)


@dataclass(frozen=True)
class Cells:
    """Bins of the features: a value goes left of every edge it does not exceed."""

    cols: tuple[str, ...]
    edges: tuple[tuple[float, ...], ...]

    @property
    def radix(self) -> tuple[int, ...]:
        return tuple(len(e) + 1 for e in self.edges)

    @property
    def size(self) -> int:
        return math.prod(self.radix)

    def bins(self) -> np.ndarray:
        """The bins of every cell, one row a cell."""
        return np.stack(np.unravel_index(np.arange(self.size), self.radix), 1)

    def placed(self, df: DataFrame) -> DataFrame:
        """Rows that have all features, with the `_cell` of each."""
        df = df.dropna(subset=list(self.cols))
        cut = [i for i, e in enumerate(self.edges) if e]
        if cut:
            # A bucket holds its lower bound, a bin its upper edge, hence the next larger number.
            splits = [[-math.inf, *(math.nextafter(v, math.inf) for v in self.edges[i]), math.inf] for i in cut]
            df = Bucketizer(splitsArray=splits, inputCols=[self.cols[i] for i in cut], outputCols=[f"_b{i}" for i in cut]).transform(df)
        cell = F.lit(0)
        for i, r in enumerate(self.radix):
            cell = cell * r + (F.col(f"_b{i}").cast("int") if i in cut else 0)
        return df.withColumn("_cell", cell).drop(*[f"_b{i}" for i in cut])


@dataclass(frozen=True)
class CellModel:
    """A fitted model as one prediction per cell."""

    cells: Cells
    predictions: np.ndarray
    featureImportances: DenseVector

    def transform(self, df: DataFrame) -> DataFrame:
        """Rows with all features and their `prediction`; the table of cells is bounded by `CELLS`, hence broadcast."""
        table = df.sparkSession.createDataFrame(pa.table({"_cell": pa.array(np.arange(self.cells.size), pa.int32()), "prediction": pa.array(self.predictions, pa.float64())}))
        return self.cells.placed(df).join(F.broadcast(table), "_cell").drop("_cell")


def _edges(counts: Sequence[tuple[float, int]]) -> list[float]:
    """MLlib's thresholds from (value, rows) in order: between all values, or about equal numbers of rows apart."""
    middle = [(a + b) / 2 for (a, _), (b, _) in zip(counts, counts[1:])]
    if len(middle) < BINS:
        return middle
    stride = sum(n for _, n in counts) / BINS
    out, target, sofar = [], stride, counts[0][1]
    for i in range(1, len(counts)):
        before, sofar = sofar, sofar + counts[i][1]
        if abs(before - target) < abs(sofar - target):
            out.append(middle[i - 1])
            target += stride
    return out[:BINS - 1]


def cells_of(df: DataFrame, cols: Sequence[str], label: str) -> Cells | None:
    """The bins of all rows of `df`; None if there are more cells than `CELLS`, as with many features."""
    y = F.col(label).cast("double")
    seen = df.agg(rows().alias("n"), F.count_if(y.isNull() | F.isnan(y)).alias("bad"), *[F.approx_count_distinct(c).alias(f"d{i}") for i, c in enumerate(cols)]).first()
    if not seen["n"] or seen["bad"]:
        raise ValueError(f"a fit needs rows, and a label in every row: {seen['n']} rows, {seen['bad']} without a label")
    edges = []
    for i, c in enumerate(cols):
        if seen[f"d{i}"] <= VALUES:
            edges.append(_edges([(float(v), n) for v, n in df.groupBy(c).count().orderBy(c).collect()]))
        else:
            edges.append(sorted({float(v) for v in df.agg(F.percentile_approx(c, [k / BINS for k in range(1, BINS)], 10_000)).first()[0]}))
    found = Cells(tuple(cols), tuple(tuple(e) for e in edges))
    return found if found.size <= CELLS else None


# --- forest -----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """Trees as arrays, one row a tree; the children of node i are 2 i + 1 and 2 i + 2, a leaf has feature -1."""

    cells: Cells
    feature: np.ndarray
    cut: np.ndarray
    value: np.ndarray
    gain: np.ndarray

    def model(self, trees: int | None = None, depth: int | None = None) -> CellModel:
        """The first `trees` trees, cut off below `depth` levels."""
        bins, k = self.cells.bins(), len(self.cells.cols)
        inner = len(self.feature[0]) if depth is None else 2 ** depth - 1
        total, shares = np.zeros(len(bins)), np.zeros(k)
        for feature, cut, value, gain in zip(self.feature[:trees], self.cut, self.value, self.gain):
            feature = np.where(np.arange(len(feature)) < inner, feature, -1)
            at = np.zeros(len(bins), int)
            while (go := feature[at] >= 0).any():
                at[go] = 2 * at[go] + 1 + (bins[go, feature[at[go]]] > cut[at[go]])
            total += value[at]
            by = np.bincount(feature[feature >= 0], gain[feature >= 0], k)
            shares += by / (by.sum() or 1.0)
        return CellModel(self.cells, total / len(self.feature[:trees]), DenseVector(shares / (shares.sum() or 1.0)))


def grow(n: np.ndarray, s: np.ndarray, bins: np.ndarray, radix: Sequence[int], depth: int, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
    """One regression tree on cells of `n` drawn rows with label sum `s`: each node takes the cut that lowers the squared error
    most, among a third of the features, drawn anew for the node."""
    size, tries = 2 ** (depth + 1) - 1, math.ceil(len(radix) / 3)
    feature, cut, value, gain = np.full(size, -1), np.zeros(size, int), np.zeros(size), np.zeros(size)
    at = np.where(n > 0, 0, -1)
    for i in range(size):
        here = np.flatnonzero(at == i)
        if not len(here):
            continue
        w = n[here]
        value[i] = s[here].sum() / w.sum()
        if i >= size // 2:
            continue
        off = s[here] - value[i] * w
        for c in rng.choice(len(radix), tries, replace=False):
            left = np.cumsum(np.bincount(bins[here, c], w, radix[c]))
            drop = np.cumsum(np.bincount(bins[here, c], off, radix[c])) ** 2
            ok = (left > 0) & (left < left[-1])
            drop = np.where(ok, drop * left[-1] / np.where(ok, left * (left[-1] - left), 1.0), 0.0)
            if (k := int(drop.argmax())) < radix[c] and drop[k] > gain[i]:
                feature[i], cut[i], gain[i] = c, k, drop[k]
        if feature[i] >= 0:
            at[here] = 2 * i + 1 + (bins[here, feature[i]] > cut[i])
    return feature, cut, value, gain


def forests(df: DataFrame, cols: Sequence[str], label: str, trees: int, depth: int = 5, seed: int = 42, fold: str | None = None, folds: int = 1) -> list[Forest] | None:
    """The forest of all rows, after those that leave out fold 0, 1, ... if `fold` is given; None if there are too many cells.

    Every row draws a Poisson(1) weight for each tree, as in MLlib. One scan adds up weights and weighted labels per tree, fold and
    cell; a task a tree grows that tree for each fold left out, whose sums are those of all folds less its own.
    """
    data = df.dropna(subset=list(cols))
    cells = cells_of(data, cols, label)
    if cells is None:
        return None
    parts, size, radix, bins = folds if fold else 1, cells.size, cells.radix, cells.bins()

    def draw(batches):
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        n, s, held = np.zeros((trees, parts * size)), np.zeros((trees, parts * size)), []

        def add():
            at, y = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("at", "y"))
            for t in range(trees):
                u, w = rng.integers(0, 1 << 32, len(y), np.uint32), np.zeros(len(y), np.uint8)
                for edge in _POISSON:
                    w += u >= edge
                n[t] += np.bincount(at, w, parts * size)
                s[t] += np.bincount(at, w * y, parts * size)
            held.clear()

        for b in batches:
            held.append(b)
            if sum(map(len, held)) >= 2 * parts * size:
                add()
        if held:
            add()
        for t in range(trees):
            yield pa.RecordBatch.from_pydict({"tree": pa.array([t], pa.int32()), "n": pa.array([n[t]], pa.list_(pa.float64())), "s": pa.array([s[t]], pa.list_(pa.float64()))})

    def grown(g: pd.DataFrame) -> pd.DataFrame:
        tree = int(g["tree"].iloc[0])
        n, s = (np.sum(g[c].tolist(), axis=0).reshape(parts, size) for c in ("n", "s"))
        out = []
        for p in range(parts + 1 if fold else 1):
            rest = [q for q in range(parts) if not fold or q != p]
            out.append((tree, p, *(a.tolist() for a in grow(n[rest].sum(0), s[rest].sum(0), bins, radix, depth, np.random.default_rng([seed, tree, p])))))
        return pd.DataFrame(out, columns=["tree", "part", "feature", "cut", "value", "gain"])

    at = F.col("_cell") + F.col(fold) * size if fold else F.col("_cell")
    tasks = df.sparkSession.sparkContext.defaultParallelism
    sums = cells.placed(data).select(at.cast("int").alias("at"), F.col(label).cast("double").alias("y")).coalesce(tasks).mapInArrow(draw, "tree int, n array<double>, s array<double>")
    got = sums.groupBy("tree").applyInPandas(grown, "tree int, part int, feature array<int>, cut array<int>, value array<double>, gain array<double>").orderBy("part", "tree").collect()
    each = [[r for r in got if r["part"] == p] for p in range(parts + 1 if fold else 1)]
    return [Forest(cells, *(np.array([r[c] for r in one]) for c in ("feature", "cut", "value", "gain"))) for one in each]


# --- boosting ---------------------------------------------------------------------------------------


def boosted(df: DataFrame, cols: Sequence[str], label: str, trees: int, seed: int = 42) -> CellModel | None:
    """MLlib's boosting on one row per cell: the mean label, weighted by the rows. Rows of a cell have equal predictions in every
    round, so its mean residual and its weight give the trees that all its rows would give."""
    data = df.dropna(subset=list(cols))
    cells = cells_of(data, cols, label)
    if cells is None:
        return None
    k = len(cols)
    names = [f"_b{i}" for i in range(k)]
    # Bins count from 1, as MLlib takes the rows of value 0 from a difference; with these bins it looks at every cell.
    features = VectorAssembler(inputCols=names, outputCol="features")
    bins = df.sparkSession.createDataFrame(pa.table({"_cell": pa.array(np.arange(cells.size), pa.int32())} | {c: pa.array(b + 1.0) for c, b in zip(names, cells.bins().T)}))
    sums = cells.placed(data).groupBy("_cell").agg(F.avg(F.col(label).cast("double")).alias("y"), rows().cast("double").alias("n"))
    few = durable(features.transform(sums.join(F.broadcast(bins), "_cell")).select("features", "y", "n").coalesce(1))
    model = GBTRegressor(featuresCol="features", labelCol="y", weightCol="n", maxIter=trees, maxBins=math.isqrt(CELLS) + 1, seed=seed).fit(few)
    got = model.transform(features.transform(bins)).orderBy("_cell").select("prediction").collect()
    return CellModel(cells, np.array([r[0] for r in got]), DenseVector(model.featureImportances.toArray()))
