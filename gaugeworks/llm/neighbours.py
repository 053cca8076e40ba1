"""Approximate nearest neighbours: NN-descent builds the graph by Spark joins, queries walk it greedily.

Equal vectors are one node. A first graph comes from the leaves of a few random hyperplane trees and from small groups of
nodes drawn by hashes, so that every node has neighbours. Then each round meets the neighbours of every node (those it
names and a sample of those that name it, at first also the drawn ones) with each other: two neighbours of a node are
likely to be neighbours, so whoever finds a closer one than its farthest takes it. Rounds stop when the graph hardly
improves. A query keeps a pool of the nearest nodes it has seen, its own and a few fixed ones first, and looks at the
neighbours of those it has not expanded, until the pool is all expanded. A query whose pool holds too few ids is compared
with all nodes, block by block.

Lists that meet in one group are bounded: leaves and the sampled reverse neighbours are dealt by hashes after a map-side
count, so a vector in a third of all rows, or a node that everyone names, never fills a task. A full leaf is dealt anew
in every tree, so the parts of a tight cluster that no plane divides overlap and grow together. Each round is written to the
shared folder, and all state is keyed rows.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from gaugeworks.llm.frames import kept_table, pick

DEGREE = 24
TREES = 5
LEAF = 64
ROUNDS = 12
DRAWN = 8
ENTRIES = 8
ASKED, HELD = 1024, 4096
POOL = 128


def usable(rows: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, vec): rows that take part, vectors as packed little-endian numbers of their own precision.

    Left out: null ids and vectors, vectors with null, NaN or infinite components, zero vectors, and vectors of another
    length than most have (the longer one of equals). Rows that repeat an id with another vector keep the smallest.
    """
    kind = rows.schema[vector].dataType.elementType
    code = "<f4" if isinstance(kind, T.FloatType) else "<f8"
    r = pick(rows, id=id, v=vector).select("id", F.col("v").cast("array<float>" if code == "<f4" else "array<double>").alias("v"))
    odd = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    r = r.where(F.col("id").isNotNull() & F.col("v").isNotNull() & ~odd & F.exists("v", lambda x: x != 0))
    size = r.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()

    def packed(batches):
        for b in batches:
            a = b.column(1)
            flat, o = a.flatten().to_numpy(zero_copy_only=False).astype(code), np.asarray(a.offsets)
            o = (o - o[0]).tolist()
            yield pa.RecordBatch.from_pydict({"id": b.column(0), "vec": pa.array([(flat[x:y] + 0).tobytes() for x, y in zip(o[:-1], o[1:])], pa.binary())})

    r = r.where(F.size("v") == (size.n if size else 0))
    return r.select(F.col("id").cast("long"), "v").mapInArrow(packed, "id bigint, vec binary").groupBy("id").agg(F.min("vec").alias("vec")).select("id", "vec", F.lit(code).alias("code"))


def distances(a: pd.Series, b: pd.Series, code: str) -> np.ndarray:
    x, y = (np.frombuffer(b"".join(s), code).astype(float).reshape(len(s), -1) for s in (a, b))
    return np.sqrt(((x - y) ** 2).sum(1))


def distance(a, b, code: str):
    """Euclidean distance of packed vectors, in double precision."""

    @F.pandas_udf("double")
    def far(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(distances(x, y, code) if len(x) else [], dtype=float)

    return far(a, b)


def close_pairs(code: str, keep: int):
    """Map lists of (id, vec, radius) to rows (u, v, d): for each member its `keep` nearest others within its radius."""

    def pairs(batches):
        for b in batches:
            for row in b.column(0).to_pylist():
                ids = np.array([r["id"] for r in row], np.int64)
                if len(ids) < 2:
                    continue
                x = np.frombuffer(b"".join(r["vec"] for r in row), code).astype(float).reshape(len(ids), -1)
                square = (x * x).sum(1)
                d = np.sqrt(np.maximum(square[:, None] + square[None] - 2 * x @ x.T, 0))
                np.fill_diagonal(d, np.inf)
                k = min(keep, len(ids) - 1)
                near = np.argpartition(d, k - 1, axis=1)[:, :k]
                # The product rounds differently from list to list; a pair's distance must be the same wherever it meets.
                far = np.sqrt(np.stack([((x - x[j]) ** 2).sum(1) for j in near.T], 1)).ravel()
                u, v = np.repeat(ids, k), ids[near].ravel()
                ok = (far < np.repeat([r["radius"] for r in row], k)) & (u != v)
                if ok.any():
                    yield pa.RecordBatch.from_pydict({"u": pa.array(u[ok]), "v": pa.array(v[ok]), "d": pa.array(far[ok])})

    return pairs


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """(u, near): the k nearest distinct neighbours of every node, nearest first, as structs (d, v).

    Equal pairs share a rank, as their distances are equal. The bound on the rank is applied before the shuffle too, so a
    node that is in very many lists sends its best of every task, not all of its candidates, to the one that ranks them.
    """
    order = Window.partitionBy("u").orderBy("d", "v")
    best = edges.select("u", "v", "d", F.dense_rank().over(order).alias("place")).where(F.col("place") <= k)
    return best.groupBy("u").agg(F.array_sort(F.collect_set(F.struct("d", "v"))).alias("near"))


def leaves(nodes: DataFrame, code: str, trees: int, leaf: int) -> DataFrame:
    """Lists of about `leaf` nodes on the same side of random hyperplanes, `trees` times; a fuller leaf is cut by a hash."""
    n = nodes.count()
    depth = max(0, int(np.ceil(np.log2(max(1, n / leaf)))))

    def sides(batches):
        for b in batches:
            vecs = b.column(1).to_pylist()
            if not vecs:
                continue
            x = np.frombuffer(b"".join(vecs), code).astype(float).reshape(len(vecs), -1)
            for t in range(trees):
                planes = np.random.default_rng([17, t]).normal(size=(x.shape[1], max(1, depth)))
                bits = (x @ planes > 0)[:, :depth]
                yield pa.RecordBatch.from_pydict({"id": b.column(0), "vec": b.column(1), "tree": pa.array([t] * len(x), pa.int32()), "leaf": pa.array(bits @ (1 << np.arange(depth, dtype=np.int64)) if depth else np.zeros(len(x), np.int64))})

    placed = nodes.select("id", "vec").mapInArrow(sides, "id bigint, vec binary, tree int, leaf bigint")
    parts = placed.groupBy("tree", "leaf").agg(F.ceil(F.count("*") / (2 * leaf)).alias("parts"))
    return (
        placed.join(parts, ["tree", "leaf"]).groupBy("tree", "leaf", F.pmod(F.xxhash64("id", "tree"), F.col("parts")).alias("part"))
        .agg(F.collect_list(F.struct("id", "vec", F.lit(float("inf")).alias("radius"))).alias("members")).select("members")
    )


def drawn(nodes: DataFrame, size: int = DRAWN, times: int = 2) -> DataFrame:
    """Lists of about `size` nodes by a hash, `times` times."""
    groups = max(1, nodes.count() // size)
    salted = nodes.withColumn("salt", F.explode(F.array(*[F.lit(k) for k in range(times)])))
    return (
        salted.groupBy("salt", F.pmod(F.xxhash64("id", "salt"), F.lit(groups)).alias("part"))
        .agg(F.collect_list(F.struct("id", "vec", F.lit(float("inf")).alias("radius"))).alias("members")).select("members")
    )


def both_ways(graph: DataFrame, degree: int, salt: int) -> DataFrame:
    """(m, a): for every node those it names, and about `degree` of those that name it, by a hash."""
    named = graph.select(F.col("u").alias("m"), F.explode("near.v").alias("a"))
    back = named.select(F.col("a").alias("m"), F.col("m").alias("a"))
    n = back.groupBy("m").agg(F.count("*").alias("n"))
    some = back.join(n, "m").where(F.pmod(F.xxhash64("m", "a", F.lit(salt)), F.lit(1 << 20)) * F.col("n") < degree * (1 << 20))
    return named.unionByName(some.select("m", "a")).distinct()


def build(nodes: DataFrame, code: str, degree: int = DEGREE, trees: int = TREES, leaf: int = LEAF, rounds: int = ROUNDS) -> DataFrame:
    """The neighbour graph (u, near) of (id, vec) nodes."""
    pairs = leaves(nodes, code, trees, leaf).mapInArrow(close_pairs(code, degree), "u bigint, v bigint, d double")
    strangers = kept_table(drawn(nodes).mapInArrow(close_pairs(code, DRAWN // 2), "u bigint, v bigint, d double"), "drawn")
    graph = kept_table(nearest(pairs.unionByName(strangers), degree), "graph")
    total = None
    for step in range(rounds):
        radius = graph.select(F.col("u").alias("a"), F.when(F.size("near") >= degree, F.element_at("near.d", -1)).otherwise(float("inf")).alias("radius"))
        who = nodes.select(F.col("id").alias("a"), "vec").join(radius, "a", "left").withColumn("radius", F.coalesce("radius", F.lit(float("inf"))))
        links = both_ways(graph, degree, step)
        if not step:
            links = links.unionByName(strangers.select(F.col("u").alias("m"), F.col("v").alias("a"))).distinct()
        met = links.join(who, "a").groupBy("m").agg(F.collect_list(F.struct(F.col("a").alias("id"), "vec", "radius")).alias("members"))
        found = met.select("members").mapInArrow(close_pairs(code, degree // 2), "u bigint, v bigint, d double")
        old = graph.select("u", F.explode("near").alias("e")).select("u", "e.v", "e.d")
        graph = kept_table(nearest(old.unionByName(found.select("u", "v", "d")), degree), "graph")
        now = graph.select(F.aggregate("near.d", F.lit(0.0), lambda s, x: s + x).alias("s"), F.size("near").alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("s"), F.lit(0.0))).first()
        if total and now[0] == total[0] and total[1] - now[1] <= 0.001 * total[1]:
            break
        total = now
    return graph


def block_pairs(code: str, keep: int):
    """Map pairs of lists (asked: s, sv; held: v, vec) to rows (s, e): for each asked its `keep` nearest held nodes."""

    def pairs(batches):
        for b in batches:
            for asked, held in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([r["v"] for r in held], np.int64)
                x = np.frombuffer(b"".join(r["vec"] for r in held), code).astype(float).reshape(len(ids), -1)
                out = []
                for r in asked:
                    d = np.sqrt(((x - np.frombuffer(r["sv"], code).astype(float)) ** 2).sum(1))
                    best = np.lexsort((ids, d))[:keep]
                    out += [(r["s"], {"d": y, "v": v}) for y, v in zip(d[best].tolist(), ids[best].tolist())]
                yield pa.RecordBatch.from_pydict({"s": pa.array([s for s, _ in out], pa.int64()), "e": pa.array([e for _, e in out], pa.struct([("d", pa.float64()), ("v", pa.int64())]))})

    return pairs


def exact(nodes: DataFrame, starts: DataFrame, code: str, keep: int) -> DataFrame:
    """(s, pool): the `keep` nearest nodes of every start (s, sv), from all nodes; blocks of both meet, so no task holds all."""

    def blocks(df, name, size, *columns):
        n = max(1, -(-df.count() // size))
        return df.groupBy(F.pmod(F.xxhash64(columns[0]), F.lit(n)).alias("part")).agg(F.collect_list(F.struct(*columns)).alias(name)).select(name)

    held = blocks(nodes.select(F.col("id").alias("v"), "vec"), "held", HELD, "v", "vec")
    found = blocks(starts, "asked", ASKED, "s", "sv").crossJoin(held).select("asked", "held").mapInArrow(block_pairs(code, keep), "s bigint, e struct<d:double,v:bigint>")
    return found.groupBy("s").agg(F.slice(F.array_sort(F.collect_list("e")), 1, keep).alias("pool"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10, degree: int = DEGREE, pool: int = POOL, trees: int = TREES, leaf: int = LEAF, rounds: int = ROUNDS, steps: int = 40) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of every row of `queries` (id) among all other `vectors`.

    vectors: what `usable` returns. Queries that are none of its ids give no rows. Score is the Euclidean distance in
    double precision; equal scores go by the smaller id. Rows with equal vectors share a node, which lists its k + 1
    smallest ids. Fewer than k other vectors give fewer rows; an empty table gives none.
    """
    first = vectors.select("code").first()
    code = first.code if first else "<f4"
    rows = kept_table(vectors.select("id", "vec"), "vectors")
    groups = rows.groupBy("vec").agg(F.min("id").alias("node"))
    nodes = kept_table(groups.select(F.col("node").alias("id"), "vec"), "nodes")
    of = kept_table(rows.join(groups, "vec").select("id", "node"), "members")
    graph = build(nodes, code, degree, trees, leaf, rounds)
    links = kept_table(both_ways(graph, degree, -1), "links")
    asked = queries.select(F.col("id").cast("long").alias("q")).distinct().join(of.select(F.col("id").alias("q"), "node"), "q")
    starts = kept_table(asked.select(F.col("node").alias("s")).distinct().join(nodes.select(F.col("id").alias("s"), F.col("vec").alias("sv")), "s"), "starts")
    fixed = [r.id for r in nodes.orderBy(F.xxhash64("id"), "id").limit(ENTRIES).select("id").collect()]
    entries = nodes.where(F.col("id").isin(fixed)).select(F.col("id").alias("v"), "vec")
    given = starts.crossJoin(F.broadcast(entries)).where("s <> v").select("s", F.struct(distance(F.col("vec"), F.col("sv"), code).alias("d"), F.col("v")).alias("e"))
    given = given.unionByName(starts.select("s", F.struct(F.lit(0.0).alias("d"), F.col("s").alias("v")).alias("e")))
    state = kept_table(given.groupBy("s").agg(F.array_sort(F.collect_list("e")).alias("pool")).withColumn("done", F.array().cast("array<bigint>")), "pools")
    for _ in range(steps):
        front = state.select("s", F.explode(F.array_except("pool.v", "done")).alias("m"))
        seen = front.join(links, "m").select("s", F.col("a").alias("v")).distinct().join(state.select("s", F.explode("pool.v").alias("v")), ["s", "v"], "left_anti")
        near = seen.join(nodes.select(F.col("id").alias("v"), "vec"), "v").join(starts, "s").select("s", F.struct(distance(F.col("vec"), F.col("sv"), code).alias("d"), F.col("v")).alias("e"))
        more = near.groupBy("s").agg(F.collect_list("e").alias("more"))
        grown = state.join(more, "s", "left").select(
            "s", F.slice(F.array_sort(F.concat("pool", F.coalesce("more", F.array().cast("array<struct<d:double,v:bigint>>")))), 1, pool).alias("pool"),
            F.array_union("done", F.col("pool.v")).alias("done"),
        )
        state = kept_table(grown, "pools")
        if not state.where(F.size(F.array_except("pool.v", "done")) > 0).limit(1).count():
            break
    listed = few_ids(of, k + 1)
    pools = state.select("s", "pool")
    need = min(k + 1, rows.count())
    ids = pools.select("s", F.explode("pool.v").alias("v")).join(listed.select(F.col("node").alias("v"), F.size("ids").alias("n")), "v").groupBy("s").agg(F.sum("n").alias("n"))
    short = kept_table(ids.where(F.col("n") < need).select("s"), "short")
    if short.limit(1).count():
        pools = pools.join(short, "s", "left_anti").unionByName(exact(nodes, starts.join(short, "s"), code, k + 1))
    hits = pools.select("s", F.explode("pool").alias("e")).join(listed.select(F.col("node").alias("v"), "ids"), F.col("e.v") == F.col("v")).select("s", F.col("e.d").alias("d"), F.explode("ids").alias("vec_id"))
    lists = asked.join(hits, F.col("node") == F.col("s")).where("vec_id <> q").groupBy("q").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "vec_id"))), 1, k).alias("best"))
    return lists.select(F.col("q").alias("query_id"), F.posexplode("best").alias("rank", "b")).select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.vec_id").alias("vec_id"), F.col("b.d").alias("score"))


def few_ids(of: DataFrame, k: int) -> DataFrame:
    """(node, ids): the k smallest ids of every node; salted, so that a node in most rows is cut down in many tasks first."""
    part = of.groupBy("node", F.pmod(F.xxhash64("id"), F.lit(64)).alias("salt")).agg(F.slice(F.array_sort(F.collect_list("id")), 1, k).alias("ids"))
    return part.groupBy("node").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, k).alias("ids"))
