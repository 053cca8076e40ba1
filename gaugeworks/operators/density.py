"""Density clusters (DBSCAN) over any number of features, on the tree of boxes.

A cell whose box is no wider than `eps` from corner to corner holds neighbours only. With `min_points` of them it is dense:
all its points are core points of one cluster, and no pair of them is looked at. What is left are thin points, of which
such a cell holds fewer than `min_points`, and questions between cells: whether two dense cells touch, and how
many points of a dense cell a thin point reaches. Both are settled by halving: pairs of boxes that are too far are dropped,
pairs of boxes near enough as a whole, or with two near points at hand, answer the question and close it, and only the others
are cut in smaller boxes, down to leaves of a few points.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from gaugeworks.operators import space
from gaugeworks.operators.learn import components
from gaugeworks.session import broadcast_if_small, durable

#: Most points of the smallest cells.
LEAF = 16


def square(d: int, a: str, b: str) -> Column:
    """Squared distance of two points."""
    return reduce(lambda x, y: x + y, [(space.at(a, j) - space.at(b, j)) * (space.at(a, j) - space.at(b, j)) for j in range(d)])


def boxed(df: DataFrame, s: str, *more: str) -> DataFrame:
    """Columns of a node table under the side's names."""
    return df.select(F.col("node").alias(s), *[F.col(c).alias(f"{s}{c}") for c in ("lo", "hi", "rep", "leaf", "w", *more)])


def close_pairs(nodes: DataFrame, d: int, limit: float) -> DataFrame:
    """(a, b), a <= b: leaves of the tree whose boxes are within the squared distance `limit`, found from the root down."""
    pairs, depths = None, space.schedule(nodes)
    for before, depth in zip([0, *depths], depths):
        cover = space.frontier(nodes, depth, before, d)
        a, b = (cover.select(F.col("up").alias(f"{s}up"), F.col("node").alias(s), F.col("lo").alias(f"{s}lo"), F.col("hi").alias(f"{s}hi")) for s in "ab")
        if pairs is None:
            pairs = a.join(b, F.col("aup") == F.col("bup"))  # the root alone
        else:
            pairs = pairs.select(F.col("a").alias("aup"), F.col("b").alias("bup")).join(a, "aup").join(b, "bup")
        pairs = durable(pairs.filter((F.col("a") <= F.col("b")) & (space.gap(d, False) <= limit)).select("a", "b"))
    return pairs


def touches(open_: DataFrame, nodes: DataFrame, points: DataFrame, d: int, limit: float, min_points: int) -> DataFrame:
    """(owner, cell, thin, got): how much of `cell` each owner reaches, by recursive halving.

    open_: owner and cell (ids), thin, the owner's node with its box, and the cell's node. A thin owner is a point and gets
    the weight of the cell's points within reach; a question is closed once this is `min_points`. A dense owner asks
    whether any two points are near, and gets `min_points` if so.
    """
    children = nodes.withColumn("up", F.expr(f"substring(node, 1, greatest(depth - 1, 0) * {space.digit_width(d)})")).filter("depth > 0")
    side = lambda s: boxed(children.withColumn(f"{s}up", F.col("up")), s).join(children.select(F.col("node").alias(s), F.col("up").alias(f"{s}up")), s)
    one = W.partitionBy("owner", "cell")
    gained = []
    while True:
        hit = (space.gap(d, True) <= limit) | (~F.col("thin") & (square(d, "arep", "brep") <= limit))
        gain = F.when(hit, F.when(F.col("thin"), F.col("bw")).otherwise(min_points)).otherwise(0)
        judged = open_.filter(space.gap(d, False) <= limit).withColumns({"hit": hit, "gain": gain})
        judged = durable(judged.withColumn("got", F.col("got") + F.sum("gain").over(one)))
        gained.append(judged.filter("hit").groupBy("owner", "cell", "thin").agg(F.sum("gain").alias("got")))
        rest = judged.filter((F.col("got") < min_points) & ~F.col("hit")).drop("hit", "gain")
        ends = rest.filter("aleaf and bleaf")
        left = points.select(F.col("leaf").alias("a"), F.col("vec").alias("avec"))
        own = ends.filter("not thin").join(left, "a").unionByName(ends.filter("thin").withColumn("avec", F.col("arep")))
        met = own.select("owner", "cell", "thin", "avec", "b").join(points.select(F.col("leaf").alias("b"), F.col("vec").alias("bvec"), F.col("w").alias("pw")), "b")
        met = met.filter(square(d, "avec", "bvec") <= limit)
        gained.append(met.groupBy("owner", "cell", "thin").agg(F.sum(F.when(F.col("thin"), F.col("pw")).otherwise(min_points)).alias("got")))
        wide = rest.filter("not (aleaf and bleaf)")
        if wide.isEmpty():
            break
        wide = broadcast_if_small(wide)
        keep = ["owner", "cell", "thin", "got"]
        a_cols, b_cols = ["a", "alo", "ahi", "arep", "aleaf", "aw"], ["b", "blo", "bhi", "brep", "bleaf", "bw"]
        cut_a = wide.filter("not aleaf").select(*keep, F.col("a").alias("aup"), *b_cols).join(side("a"), "aup").select(*keep, *a_cols, *b_cols)
        wide = cut_a.unionByName(wide.filter("aleaf").select(*keep, *a_cols, *b_cols))
        cut_b = wide.filter("not bleaf").select(*keep, *a_cols, F.col("b").alias("bup")).join(side("b"), "bup").select(*keep, *a_cols, *b_cols)
        open_ = cut_b.unionByName(wide.filter("bleaf"))
    out = reduce(lambda x, y: x.unionByName(y), gained)
    return durable(out.groupBy("owner", "cell", "thin").agg(F.sum("got").alias("got")))


def dbscan(df: DataFrame, key: str, cols: Sequence[str], eps: float = 0.5, min_points: int = 5, scale: bool = True) -> DataFrame:
    """Density clusters; `cluster` is the smallest key of the cluster's core points, -1 for noise, null for a row with a null
    feature. Features are standardised first unless `scale` is False. `key` is a unique whole number.

    A point with `min_points` rows within `eps`, itself included, is a core point. A border point joins the cluster of the core
    point near it whose cluster has the smallest number. Copies of a position are one weighted point.
    """
    d, limit, wide = len(cols), float(eps) ** 2, space.digit_width(len(cols))
    known = df.dropna(subset=list(cols))
    placed = space.scaled(known, cols, "_vec") if scale else known.withColumn("_vec", F.array(*[F.col(c).cast("double") for c in cols]))
    placed = durable(placed.withColumn("_vec", F.transform("_vec", lambda x: x + 0.0)))
    points = durable(space.positions(placed.select(key, F.col("_vec").alias("vec")), key))
    points = durable(space.with_leaves(space.along_curve(points, d), d, most=LEAF).select("id", "vec", "w", "leaf"))
    nodes = durable(space.tree(points, d, {"w": F.col("w")}))

    # The unit of a leaf: its widest cell that is narrow enough, else itself. Points of a unit that isn't dense are thin.
    narrow = square(d, "lo", "hi") <= limit
    path = points.select("leaf").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), (F.length("leaf") / wide).cast("int"))))
    path = path.withColumn("node", F.expr(f"substring(leaf, 1, k * {wide})")).join(nodes.filter(narrow).select("node"), "node")
    units = points.select("leaf").distinct().join(path.groupBy("leaf").agg(F.min_by("node", "k").alias("unit")), "leaf", "left")
    dense = nodes.filter(narrow & (F.col("w") >= min_points)).select(F.col("node").alias("unit"), F.lit(True).alias("dense"), F.col("id").alias("cell"))
    units = units.select("leaf", F.coalesce("unit", "leaf").alias("unit")).join(dense, "unit", "left")
    points = durable(points.join(units, "leaf").withColumn("dense", F.coalesce("dense", F.lit(False))))

    pairs = close_pairs(durable(space.tree(points.select("id", "vec", "w", F.col("unit").alias("leaf")), d, {"w": F.col("w")})), d, limit)
    kind = points.select("unit", "dense", "cell").distinct()
    pairs = pairs.join(kind.select(F.col("unit").alias("a"), F.col("dense").alias("adense"), F.col("cell").alias("acell")), "a")
    pairs = durable(pairs.join(kind.select(F.col("unit").alias("b"), F.col("dense").alias("bdense"), F.col("cell").alias("bcell")), "b"))
    thin = points.filter("not dense")
    left, right = (thin.select(F.col("unit").alias(s), F.col("id").alias(f"{s}id"), F.col("vec").alias(f"{s}vec"), F.col("w").alias(f"{s}w")) for s in "ab")
    both = pairs.filter("not adense and not bdense").select("a", "b").join(left, "a").join(right, "b").filter((F.col("a") < F.col("b")) | (F.col("aid") < F.col("bid")))
    both = both.filter(square(d, "avec", "bvec") <= limit).select("aid", "aw", "bid", "bw")
    near = durable(both.select(F.col("aid").alias("id"), F.col("bid").alias("peer"), F.col("bw").alias("pw")).unionByName(both.select(F.col("bid").alias("id"), F.col("aid").alias("peer"), F.col("aw").alias("pw"))))

    # Questions to dense cells: by thin points, and by other dense cells.
    mixed = pairs.filter("adense <> bdense").select(F.when(F.col("adense"), F.col("b")).otherwise(F.col("a")).alias("unit"), F.when(F.col("adense"), F.col("a")).otherwise(F.col("b")).alias("node"), F.coalesce("acell", "bcell").alias("cell"))
    asked = mixed.join(thin.select("unit", F.col("id").alias("owner"), "vec"), "unit").select("owner", "cell", "node", F.lit(True).alias("thin"), *[F.col("vec").alias(c) for c in ("alo", "ahi", "arep")], F.lit("").alias("a"), F.lit(True).alias("aleaf"), F.lit(1).cast("bigint").alias("aw"))
    cells = boxed(nodes, "b").withColumn("node", F.col("b"))
    asked = asked.join(cells, "node").drop("node")
    twins = pairs.filter("adense and bdense and a <> b").select("a", "b", F.col("acell").alias("owner"), F.col("bcell").alias("cell"), F.lit(False).alias("thin")).join(boxed(nodes, "a"), "a").join(boxed(nodes, "b"), "b")
    inside = points.filter("dense").select("leaf", "vec", "w")
    got = touches(asked.unionByName(twins).withColumn("got", F.lit(0).cast("bigint")), nodes, inside, d, limit, min_points)

    reached = near.groupBy("id").agg(F.sum("pw").alias("n")).unionByName(got.filter("thin").groupBy(F.col("owner").alias("id")).agg(F.sum("got").alias("n")))
    reached = reached.unionByName(thin.select("id", F.col("w").alias("n"))).groupBy("id").agg(F.sum("n").alias("n"))
    core = durable(reached.filter(F.col("n") >= min_points).select("id"))
    linked = got.join(core, got["owner"] == core["id"], "left").filter("not thin or id is not null").select(F.col("owner").alias("a"), F.col("cell").alias("b"))
    peers = near.join(core, "id", "left_semi").join(core.select(F.col("id").alias("peer")), "peer", "left_semi").select(F.col("id").alias("a"), F.col("peer").alias("b"))
    alone = points.filter("dense").select(F.col("cell").alias("a")).distinct().unionByName(core.select(F.col("id").alias("a"))).select("a", F.col("a").alias("b"))
    roots = durable(components(alone.unionByName(linked).unionByName(peers).distinct()))

    root_of = lambda c: roots.select(F.col("node").alias(c), F.col("root"))
    in_cells = points.filter("dense").select("id", "vec", "cell").join(root_of("cell"), "cell").select("vec", "root")
    in_core = thin.select("id", "vec").join(core, "id", "left_semi").join(root_of("id"), "id").select("vec", "root")
    to_cell = got.filter("thin").select(F.col("owner").alias("id"), F.col("cell").alias("peer"))
    to_core = near.select("id", "peer").join(core.select(F.col("id").alias("peer")), "peer", "left_semi")
    rim = to_cell.unionByName(to_core.select("id", "peer")).join(core, "id", "left_anti").join(root_of("peer"), "peer").groupBy("id").agg(F.min("root").alias("root"))
    on_rim = thin.select("id", "vec").join(rim, "id").select("vec", "root")
    found = in_cells.unionByName(in_core).unionByName(on_rim).withColumnRenamed("vec", "_vec")
    out = placed.join(found, "_vec", "left").withColumn("cluster", F.coalesce("root", F.lit(-1))).drop("_vec", "root")
    return out.unionByName(df.filter(" or ".join(f"`{c}` is null" for c in cols)).withColumn("cluster", F.lit(None).cast("bigint")))
