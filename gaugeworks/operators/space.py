"""Points in several dimensions: a tree of boxes along a space-filling curve, and exact nearest neighbours on it.

Copies of a position are one weighted point. A point's place on the curve is a string with one digit per level, each made of
one bit per dimension; a prefix of it is a cell, and a cell with more than `LEAF` points is halved in all dimensions
again. So a hot cell is split however full it is, and a cell's box is the box of its points, not of its grid. Two cells
are judged by their boxes; pairs of cells are expanded level by level with equi-joins and dropped as soon as the boxes
decide, so no pair of far points ever meets. Values may be null where `nearest` is asked to compare shared features.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from gaugeworks.operators.ordered import in_blocks
from gaugeworks.session import durable, scalar_row

#: Most points of a leaf, and levels of the curve: 2 ** LEVELS cells along each axis of the widest range.
LEAF = 64
LEVELS = 32
#: Most points of a leaf for nearest neighbours: far more than k, so that those found in a leaf bound the search closely.
WIDE_LEAF = 512


def scaled(df: DataFrame, cols: Sequence[str], name: str = "vec") -> DataFrame:
    """Columns less their mean over their population deviation, as one array; a constant column is only centred."""
    s = scalar_row(df.agg(*[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]))
    by = lambda c: F.when(s[f"s_{c}"] > 0, s[f"s_{c}"]).otherwise(1.0)
    return df.withColumn(name, F.array(*[(F.col(c).cast("double") - s[f"m_{c}"]) / by(c) for c in cols]))


def at(name: str, j: int) -> Column:
    return F.get(F.col(name), F.lit(j))


def along_curve(points: DataFrame, d: int, vec: str = "vec", parts: Sequence[str] = ()) -> DataFrame:
    """Add `z`, the place on the curve: the digits of all levels, after the values of `parts` (kept apart from the start)."""
    ends = scalar_row(points.agg(*[f(at(vec, j)).alias(f"{n}{j}") for j in range(d) for n, f in (("lo", F.min), ("hi", F.max))]))
    width = reduce(F.greatest, [ends[f"hi{j}"] - ends[f"lo{j}"] for j in range(d)]) if d > 1 else ends["hi0"] - ends["lo0"]
    step = F.when(width > 0, width).otherwise(1.0) / float(1 << LEVELS)
    cell = lambda j: F.coalesce(F.least(F.floor((at(vec, j) - ends[f"lo{j}"]) / step), F.lit((1 << LEVELS) - 1)), F.lit(0)).cast("long")
    out = points.withColumn("_cell", F.array(*[cell(j) for j in range(d)]))
    # Four dimensions to a hexadecimal digit, the bits of one level side by side.
    quads = [range(a, min(a + 4, d)) for a in range(0, d, 4)]
    bits = lambda q: " | ".join(f"shiftleft(cast(shiftright(_cell[{j}], b) & 1 as int), {j - q[0]})" for j in q)
    digits = F.expr(f"transform(sequence({LEVELS - 1}, 0, -1), b -> concat({', '.join(f'hex({bits(q)})' for q in quads)}))")
    return out.withColumn("z", F.concat(*[F.col(p) for p in parts], F.array_join(digits, ""))).drop("_cell")


def digit_width(d: int) -> int:
    return -(-d // 4)


def with_leaves(points: DataFrame, d: int, head: int = 0, most: int = LEAF) -> DataFrame:
    """Add `leaf`, the shortest prefix of `z` shared by at most `most` points.

    A prefix holds more than `most` points exactly if it is shared by two points that are `most` places apart, so the
    places around a point in the order of the curve tell its leaf, and all points of a leaf agree on it.
    """
    wide = digit_width(d)
    out = T.StructType([*points.schema.fields, T.StructField("leaf", T.StringType())])

    def run(table: pa.Table) -> pa.Table:
        z = table["z"].to_pylist()
        digits = np.array(z, dtype="S").view(np.uint8).reshape(len(z), -1)
        # Equal digits at the front of the points `most` places apart, -1 if even the head differs or there is none.
        shared = np.full(len(z), -1)
        differ = digits[:-most] != digits[most:]
        if len(differ):
            first = np.where(differ.any(1), differ.argmax(1), digits.shape[1])
            shared[:-most] = np.where(first >= head, (first - head) // wide, -1)
        deep = pd.Series(shared).rolling(most + 1, min_periods=1).max().to_numpy().astype(int)
        ends = head + np.minimum(deep + 1, LEVELS) * wide
        return table.append_column("leaf", pa.array([v[:e] for v, e in zip(z, ends.tolist())])).filter(table["_own"])

    return in_blocks(points, [], ["z", "id"], most, most, out, run)


def box(d: int, lo: str, hi: str) -> list[Column]:
    return [F.array(*[F.min(at(lo, j)) for j in range(d)]).alias("lo"), F.array(*[F.max(at(hi, j)) for j in range(d)]).alias("hi")]


def tree(points: DataFrame, d: int, sums: dict[str, Column], head: int = 0, tops: DataFrame | None = None) -> DataFrame:
    """(node, depth, leaf, lo, hi, id, rep, sums): every cell with its box, and its point of smallest id. `points` need
    `leaf`, `vec` and `id`. A leaf's box and sums are taken first; each leaf then counts into its ancestors, so rows grow
    with the leaves. `tops` (leaf, numbers) adds the largest of each over a cell's leaves, null being beyond all.
    """
    wide = digit_width(d)
    first = [F.min_by("vec", "id").alias("rep"), F.min("id").alias("id")]
    leaves = points.groupBy("leaf").agg(*box(d, "vec", "vec"), *first, *[F.sum(c).alias(n) for n, c in sums.items()])
    above = [c for c in tops.columns if c != "leaf"] if tops is not None else []
    if above:
        leaves = leaves.join(tops, "leaf", "left").fillna(math.inf, above)
    depth = ((F.length("leaf") - head) / wide).cast("int")
    up = leaves.withColumn("depth", F.explode(F.sequence(F.lit(0), depth))).withColumn("node", F.expr(f"substring(leaf, 1, {head} + depth * {wide})"))
    return up.groupBy("node", "depth").agg(*box(d, "lo", "hi"), F.min_by("rep", "id").alias("rep"), F.min("id").alias("id"), *[F.sum(n).alias(n) for n in sums], *[F.max(n).alias(n) for n in above], F.bool_or(F.col("leaf") == F.col("node")).alias("leaf"))


def gap(d: int, far: bool, metric: str = "euclidean", partial: bool = False) -> Column:
    """Least (or largest) distance of points of the boxes (alo, ahi) and (blo, bhi); squared for the Euclidean one.
    partial: over dimensions known on both sides, raised by the share of the unknown ones; null if none is shared."""
    parts = []
    for j in range(d):
        x, y = at("blo", j) - at("ahi", j), at("alo", j) - at("bhi", j)
        g = F.greatest(-x, -y) if far else F.greatest(F.lit(0.0), x, y)
        parts.append(g if metric == "chebyshev" else g * g)
    if metric == "chebyshev":
        return reduce(F.greatest, parts) if d > 1 else parts[0]
    if not partial:
        return reduce(lambda a, b: a + b, parts)
    known = [at("alo", j).isNotNull() & at("blo", j).isNotNull() for j in range(d)]
    total = reduce(lambda a, b: a + b, [F.when(k, p).otherwise(0.0) for k, p in zip(known, parts)])
    return total * float(d) / F.nullif(reduce(lambda a, b: a + b, [k.cast("int") for k in known]), F.lit(0))


def schedule(nodes: DataFrame, growth: int = 4, small: int = 64) -> list[int]:
    """Depths to visit: each next one has at most `growth` times the cells, so that chains of only children are skipped."""
    found = {r["depth"]: (r["n"], r["leaves"]) for r in nodes.groupBy("depth").agg(F.count(F.lit(1)).alias("n"), F.count_if("leaf").alias("leaves")).collect()}
    cover, above = [], 0
    for depth in range(max(found, default=-1) + 1):
        n, leaves = found.get(depth, (0, 0))
        cover.append(n + above)
        above += leaves
    out = [0] if cover else []
    while out and out[-1] < len(cover) - 1:
        fits = [x for x in range(out[-1] + 1, len(cover)) if cover[x] <= max(growth * cover[out[-1]], small)]
        out.append(max(fits, default=out[-1] + 1))
    return out


def frontier(nodes: DataFrame, depth: int, before: int, d: int, head: int = 0) -> DataFrame:
    """The cells that cover all points at a depth: those of that depth, and leaves above it; `up` is the cover before."""
    own = nodes.filter((F.col("depth") == depth) | ((F.col("depth") < depth) & F.col("leaf")))
    return own.withColumn("up", F.expr(f"substring(node, 1, {head} + least(depth, {before}) * {digit_width(d)})"))


def nearest(points: DataFrame, d: int, k: int, asks: Column | None = None, gives: Column | None = None, metric: str = "euclidean", partial: bool = False, most: int = WIDE_LEAF) -> DataFrame:
    """The k nearest of every asking point among the giving ones, without itself: (id, near), near an array of (distance, id,
    weight), nearest first, ties to the smaller id; the weights add up to k, or to all there are.

    points: distinct `id` (long), `vec` (array of d doubles) and `w`, how many copies the point stands for; a point's own other
    copies are neighbours at distance 0. partial compares the features known on both sides only (nan-Euclidean
    distance); points that share none are no neighbours. Each cell carries two bounds: the largest distance at which its points
    have k weights in their own leaves, and the smallest one within which the cells around it hold k weights for sure, which
    falls from level to level. Cells beyond either are dropped.
    """
    asks, gives = F.lit(True) if asks is None else asks, F.lit(True) if gives is None else gives
    head, parts = 0, []
    if partial:
        points = points.withColumn("_known", F.concat(*[F.when(at("vec", j).isNull(), "0").otherwise("1") for j in range(d)]))
        head, parts = d, ["_known"]
    points = durable(points)
    points = points.withColumns({"_asks": asks.cast("int"), "_gives": F.when(gives, F.col("w")).otherwise(0)})
    points = durable(with_leaves(along_curve(points, d, parts=parts), d, head, most).select("id", "vec", "w", "leaf", "_asks", "_gives"))
    nodes = durable(tree(points, d, {"asks": F.col("_asks"), "gives": F.col("_gives")}, head, own_reach(points, d, k, metric, partial)))
    side = lambda f, s: f.select(F.col("up").alias(f"{s}up"), F.col("node").alias(s), F.col("lo").alias(f"{s}lo"), F.col("hi").alias(f"{s}hi"), F.col("gives").alias(f"{s}gives"), F.col("reach").alias(f"{s}reach"))
    pairs = None
    depths = schedule(nodes)
    for before, depth in zip([0, *depths], depths):
        cover = frontier(nodes, depth, before, d, head)
        a, b = side(cover.filter("asks > 0"), "a"), side(cover.filter("gives > 0"), "b")
        if pairs is None:  # one cell per pattern of known features: at most 2 ** d
            pairs = a.withColumn("one", F.lit(1)).join(b.withColumn("one", F.lit(1)), "one")
        else:
            pairs = pairs.select(F.col("a").alias("aup"), F.col("b").alias("bup")).join(a, "aup").join(b, "bup")
        pairs = pairs.select("a", "b", gap(d, False, metric, partial).alias("near"), gap(d, True, metric, partial).alias("far"), "bgives", "areach").filter("near <= areach")
        sure = F.sum("bgives").over(W.partitionBy("a").orderBy("far", "b").rowsBetween(W.unboundedPreceding, W.currentRow))
        # The point itself is among the weights, hence one more than k.
        bound = F.min(F.when(F.col("_sure") > k, F.col("far"))).over(W.partitionBy("a"))
        pairs = pairs.withColumn("_sure", sure).withColumn("bound", bound).filter("bound is null or near <= bound").select("a", "b", "near", "bound")
        pairs = durable(pairs)
    if pairs is None:
        pairs = points.sparkSession.createDataFrame([], "a string, b string, near double, bound double")
    return compare(points, pairs, d, k, metric, partial)


def packed(points: DataFrame, *more: str) -> DataFrame:
    """(leaf, ids, ws, xs, more): the points of each leaf as arrays, the vectors one after the other."""
    return points.groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct("id", "w", "vec", *more))).alias("l")).select(
        "leaf", F.col("l.id").alias("ids"), F.col("l.w").alias("ws"), F.flatten(F.transform(F.col("l"), lambda x: x["vec"])).alias("xs"), *[F.col(f"l.{c}").alias(c) for c in more])


def numbers(cell: pa.ListScalar) -> np.ndarray:
    return cell.values.to_numpy(zero_copy_only=False)


def own_reach(points: DataFrame, d: int, k: int, metric: str, partial: bool) -> DataFrame:
    """(leaf, reach): the largest distance at which an asking point has k weights among its own leaf's, infinite if one has not;
    squared for the Euclidean one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for ids, ws, xs, asks, gives in zip(*(batch.column(c) for c in ("ids", "ws", "xs", "_asks", "_gives"))):
                ids, ws, x = numbers(ids), numbers(ws), np.asarray(numbers(xs), float).reshape(-1, d)
                a, g = numbers(asks) > 0, numbers(gives) > 0
                best = Best(ids[a], ws[a], x[a], k, metric, partial)
                if a.any() and g.any():
                    best.meet(0.0, ids[g], ws[g], x[g])
                # A little more, as cells must not be lost to rounding.
                out.append(float(best.reach.max(initial=0.0)) * (1 + 1e-9))
            yield pa.RecordBatch.from_arrays([batch.column("leaf"), pa.array(out, pa.float64())], names=["leaf", "reach"])

    return packed(points, "_asks", "_gives").mapInArrow(run, "leaf string, reach double")


def compare(points: DataFrame, pairs: DataFrame, d: int, k: int, metric: str, partial: bool) -> DataFrame:
    """The k nearest from pairs of leaves: each asking leaf's points, then the leaves around it, nearest first, stream through
    one task, which keeps k candidates a point and skips leaves beyond all of them."""
    asking = packed(points.filter("_asks > 0")).select(F.col("leaf").alias("a"), F.lit(-1.0).alias("near"), "ids", "ws", "xs")
    giving = pairs.join(packed(points.filter("_gives > 0")), F.col("b") == F.col("leaf")).select("a", "near", "ids", "ws", "xs")
    rows = asking.unionByName(giving).repartition("a").sortWithinPartitions("a", "near")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaf, best = None, None
        for batch in batches:
            names, near = batch.column("a").to_pylist(), batch.column("near").to_numpy()
            ids, ws, xs = (batch.column(c) for c in ("ids", "ws", "xs"))
            for i, name in enumerate(names):
                each = numbers(ids[i]), numbers(ws[i]), np.asarray(numbers(xs[i]), float).reshape(-1, d)
                if near[i] < 0:
                    if best:
                        yield best.rows()
                    leaf, best = name, Best(*each, k, metric, partial)
                elif name == leaf:
                    best.meet(near[i], *each)
        if best:
            yield best.rows()

    return rows.mapInArrow(run, "id bigint, near array<struct<distance: double, id: bigint, w: bigint>>")


class Best:
    """The points of one asking leaf with their nearest so far: arrays of k distances, ids and weights a point."""

    def __init__(self, ids, ws, x, k: int, metric: str, partial: bool):
        self.ids, self.ws, self.x, self.k, self.metric, self.partial = ids, ws, x, k, metric, partial
        self.d = np.full((len(ids), k), np.inf)
        self.n = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.w = np.zeros((len(ids), k), np.int64)
        #: The distance at which a point's weights reach k.
        self.reach = np.full(len(ids), np.inf)

    def total(self, gaps: list[np.ndarray]) -> np.ndarray:
        """Distances from the gaps per dimension, NaN being unknown."""
        if self.metric == "chebyshev":
            return reduce(np.maximum, gaps)
        if not self.partial:
            return reduce(np.add, [g * g for g in gaps])
        known = [~np.isnan(g) for g in gaps]
        shared = reduce(np.add, [q.astype(int) for q in known])
        return np.where(shared > 0, reduce(np.add, [np.where(q, g, 0.0) ** 2 for q, g in zip(known, gaps)]) * len(gaps) / np.maximum(shared, 1), np.inf)

    def meet(self, near: float, ids, ws, x) -> None:
        open_ = np.flatnonzero(self.reach >= near)
        if not len(open_):
            return
        # A point's distance to the box of the others is a bound for all of them.
        at, dims = self.x[open_], range(x.shape[1])
        low, high = x.min(0), x.max(0)
        open_ = open_[self.total([np.maximum(np.maximum(low[j] - at[:, j], at[:, j] - high[j]), 0.0) for j in dims]) <= self.reach[open_]]
        if not len(open_):
            return
        at = self.x[open_]
        dist = self.total([np.abs(at[:, j, None] - x[None, :, j]) for j in dims])
        weight = np.broadcast_to(ws, dist.shape) - (ids[None, :] == self.ids[open_, None])
        dist = np.where(weight > 0, dist, np.inf)
        # Only those that may be among the k nearest are put in order.
        edge = self.reach[open_]
        if dist.shape[1] > self.k:
            edge = np.minimum(edge, np.partition(dist, self.k - 1, 1)[:, self.k - 1])
        close = (dist <= edge[:, None]) & np.isfinite(dist)
        some = close.any(1)
        if not some.any():
            return
        open_, dist, weight, close = open_[some], dist[some], weight[some], close[some]
        most = int(close.sum(1).max())
        pick = np.argpartition(dist, most - 1, 1)[:, :most] if most < dist.shape[1] else np.broadcast_to(np.arange(dist.shape[1]), dist.shape)
        dist, weight = np.take_along_axis(dist, pick, 1), np.take_along_axis(weight, pick, 1)
        all_d, all_n, all_w = np.hstack([self.d[open_], dist]), np.hstack([self.n[open_], ids[pick]]), np.hstack([self.w[open_], weight])
        order = np.lexsort((all_n, all_d), axis=1)[:, : self.k]
        self.d[open_], self.n[open_], self.w[open_] = (np.take_along_axis(v, order, 1) for v in (all_d, all_n, all_w))
        self.reach[open_] = self.d[open_, self.full(open_)]

    def full(self, at: np.ndarray) -> np.ndarray:
        """Where the weights of the nearest reach k; the last place if they don't."""
        enough = np.cumsum(np.where(np.isfinite(self.d[at]), self.w[at], 0), 1) >= self.k
        return np.where(enough.any(1), enough.argmax(1), self.k - 1)

    def rows(self) -> pa.RecordBatch:
        before = np.cumsum(self.w, 1) - self.w
        use = np.isfinite(self.d) & (before < self.k)
        weight = np.minimum(self.w, self.k - before)[use]
        dist = self.d[use] if self.metric == "chebyshev" else np.sqrt(self.d[use])
        offsets = np.concatenate([[0], np.cumsum(use.sum(1))]).astype(np.int32)
        items = pa.StructArray.from_arrays([pa.array(dist), pa.array(self.n[use]), pa.array(weight.astype(np.int64))], names=["distance", "id", "w"])
        return pa.RecordBatch.from_arrays([pa.array(self.ids, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), items)], names=["id", "near"])


def positions(df: DataFrame, key: str, vec: str = "vec", **payload: Column) -> DataFrame:
    """Distinct positions: id (the smallest key), vec, w, and further aggregates."""
    clean = F.transform(F.col(vec), lambda x: x + 0.0)  # no negative zeros
    return df.withColumn("vec", clean).groupBy("vec").agg(F.min(F.col(key).cast("long")).alias("id"), F.count(F.lit(1)).alias("w"), *[c.alias(n) for n, c in payload.items()])
