"""N-gram Jaccard join: MinHash banding proposes, exact Jaccard similarity of whole shingle sets decides.

A text is the set of its runs of `n` words (A-Z lowered, words as in `decontaminate`). Texts with equal sets are one
node. Every tree hashes one prefix of a node's MinHash values; two nodes meet where they share it. A long prefix meets
few strangers but misses links, so before any data is read the one depth of all trees is shortened from `deepest` until the
chance that nodes of similarity `threshold` share it in some tree reaches `recall`: 1 - (1 - threshold ** depth) ** trees.

Trie nodes with few members give pairs, which pass a check of sizes and of the signatures' agreement (its slack is part of
the target recall) and are then compared exactly. Where a trie node has many members, they form work groups, which are
compared whole, in blocks of bounded size: cells of alike set sizes and hashed parts, one task per pair of cells. There
each node's links are counted inside the task and only a spanning forest of them leaves it, so no group emits all its
pairs; groups of copies are never expanded. The blocks of a group of g different texts are g * g / BLOCK ** 2, as every
link is counted. Classes are the connected components of all links.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeworks.llm import cells
from gaugeworks.llm.arrays import U, byte_class, lower_ascii, mix, run_hashes, runs, span_hashes, utf8
from gaugeworks.llm.frames import components, kept_table

WORDS, THRESHOLD = 5, 0.8
TREES, DEEPEST, RECALL = 32, 8, 0.999999
FEW = 16
BLOCK = 256
PIECE = 1 << 19


def depth_for(threshold: float, trees: int, recall: float, deepest: int = DEEPEST) -> int:
    """The longest prefix that reaches the target recall, found by shortening; at least one value."""
    depth = deepest
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(texts, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(distinct ascending shingle hashes of every text in a row, offsets). Fewer than n words, but not none: one."""
    data, offsets = utf8(texts)
    data = lower_ascii(data)
    out, sizes = [], []
    for a, b in cells.piece_edges(offsets, PIECE):
        d, o = data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        s, e = runs(d, o, byte_class("alnum"))
        w = span_hashes(d, s, e)
        edges = np.searchsorted(s, o)
        count = np.diff(edges)
        of = np.repeat(np.arange(b - a), count)
        number = np.arange(len(w)) - np.repeat(edges[:-1], count)
        at = np.flatnonzero(number + n <= count[of]) if len(w) else np.zeros(0, np.int64)
        h, doc = (run_hashes(w, n)[at], of[at]) if len(at) else (np.zeros(0, U), np.zeros(0, np.int64))
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            h = np.concatenate([h, [run_hashes(w[edges[k] : edges[k + 1]], int(count[k]))[0] for k in short]]).astype(U)
            doc = np.concatenate([doc, short])
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        out.append(h[new])
        sizes.append(np.bincount(doc[new], minlength=b - a))
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    return np.concatenate(out) if out else np.zeros(0, U), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)


def nodes_of(h: np.ndarray, edges: np.ndarray) -> list[bytes | None]:
    """128 bits for every set, equal for equal sets; None for an empty one."""
    n = np.diff(edges)
    out: list = [None] * len(n)
    full = np.flatnonzero(n)
    if len(full):
        at = edges[:-1][full]
        pair = np.stack([mix(np.add.reduceat(mix(h + U(c)), at) + n[full].astype(U)) for c in (11, 77)], 1)
        for k, p in zip(full.tolist(), pair):
            out[k] = p.tobytes()
    return out


def signatures(h: np.ndarray, edges: np.ndarray, trees: int, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For every non-empty set: the hash of its prefix in each tree, and one byte of each MinHash value."""
    full = np.flatnonzero(np.diff(edges))
    at = edges[:-1][full]
    prefix, marks = np.empty((len(full), trees), U), np.empty((len(full), trees * depth), np.uint8)
    for t in range(trees):
        p = np.full(len(full), t + 1, U)
        for k in range(depth):
            seed = mix(np.array([(t * depth + k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1], U))[0]
            m = np.minimum.reduceat((h ^ seed) * (seed | U(1)), at) if len(full) else np.zeros(0, U)
            p = mix(p + mix(m))
            marks[:, t * depth + k] = mix(m) >> U(56)
        prefix[:, t] = p
    return prefix, marks


def signed(rows: DataFrame, n: int, trees: int, depth: int) -> DataFrame:
    """(id, node, size, prefixes, marks) of (id, text); node is null for a text without words."""

    def sign(batches):
        for b in batches:
            lengths = np.concatenate([[0], np.cumsum([len(x or "") for x in b.column(1).to_pylist()])])
            for x, z in cells.piece_edges(lengths, 4 * PIECE):
                h, edges = shingles(b.column(1).slice(x, z - x), n)
                prefix, marks = signatures(h, edges, trees, depth)
                node = nodes_of(h, edges)
                full = np.diff(edges) > 0
                lists, raw = np.zeros((z - x, trees), np.int64), np.zeros((z - x, trees * depth), np.uint8)
                lists[full], raw[full] = prefix.view(np.int64), marks
                yield pa.RecordBatch.from_pydict({
                    "id": b.column(0).slice(x, z - x), "node": pa.array(node, pa.binary()), "size": pa.array(np.diff(edges)),
                    "prefixes": pa.ListArray.from_arrays(pa.array(np.arange(z - x + 1, dtype=np.int32) * trees), pa.array(lists.ravel())), "marks": pa.array([r.tobytes() for r in raw], pa.binary()),
                })

    return rows.mapInArrow(sign, f"id {rows.schema['id'].dataType.simpleString()}, node binary, size bigint, prefixes array<bigint>, marks binary")


def texts_of(rows: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(node, set) of the wanted nodes: the shingle set of one text each. A task passes on one text of each node only."""

    def once(batches):
        seen: set = set()
        for b in batches:
            texts = b.column(1)
            lengths = np.concatenate([[0], np.cumsum([len(x or "") for x in texts.to_pylist()])])
            for x, z in cells.piece_edges(lengths, 4 * PIECE):
                part = texts.slice(x, z - x)
                node = nodes_of(*shingles(part, n))
                keep = [k for k, v in enumerate(node) if v is not None and v not in seen and not seen.add(v)]
                yield pa.RecordBatch.from_pydict({"node": pa.array([node[k] for k in keep], pa.binary()), "text": part.take(pa.array(keep, pa.int64()))})

    # The wanted nodes grow with the documents; a broadcast that only fits small inputs is left alone.
    return rows.mapInArrow(once, "node binary, text string").join(wanted.hint("merge"), "node").dropDuplicates(["node"])


def jaccard(pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """The pairs (a, b, ...) whose `text_a` and `text_b` have similarity of at least the threshold."""

    def judge(batches):
        for b in batches:
            ta, tb = b.column("text_a"), b.column("text_b")
            keep = []
            for k in range(0, b.num_rows, 256):
                (x, ex), (y, ey) = shingles(ta.slice(k, 256), n), shingles(tb.slice(k, 256), n)
                for i in range(len(ex) - 1):
                    p, q = x[ex[i] : ex[i + 1]], y[ey[i] : ey[i + 1]]
                    both = len(np.intersect1d(p, q, assume_unique=True))
                    if both >= threshold * (len(p) + len(q) - both) - 1e-9:
                        keep.append(k + i)
            yield b.select(["a", "b", "copies_a", "copies_b"]).take(pa.array(keep, pa.int64()))

    return pairs.mapInArrow(judge, "a binary, b binary, copies_a bigint, copies_b bigint")


def cell_links(n: int, threshold: float):
    """For one pair of cells: (node, links, other): links counted in documents, `other` a linked node of a spanning forest."""

    def count(key, table):
        left = np.array(table["left"].to_pylist(), bool)
        right = np.array(table["right"].to_pylist(), bool)
        node, copies = table["node"].to_pylist(), table["copies"].to_numpy()
        h, edges = shingles(table["text"], n)
        size = np.diff(edges)
        u, back, times = np.unique(h, return_inverse=True, return_counts=True)
        shared = np.cumsum(times > 1) - 1
        row, col = np.repeat(np.arange(len(size)), size), back
        use = times[col] > 1
        row, col = row[use], shared[col[use]]
        order = np.argsort(col, kind="stable")
        row, col = row[order], col[order]
        both, width = np.zeros((len(size), len(size)), np.float32), 4096
        for c in range(0, int(col[-1]) + 1 if len(col) else 0, width):
            i, j = np.searchsorted(col, [c, c + width])
            m = np.zeros((len(size), width), np.float32)
            m[row[i:j], col[i:j] - c] = 1
            both += m @ m.T
        link = both >= threshold * (size[:, None] + size[None] - both) - 1e-4
        link &= (left[:, None] & right[None]) | (right[:, None] & left[None])
        np.fill_diagonal(link, False)
        links, others = link @ copies, link.sum(1)
        root = np.arange(len(size))
        while True:  # the smallest linked row, until nothing moves
            low = np.minimum(root, np.where(link, root[None], len(size)).min(1, initial=len(size)))
            if (low == root).all():
                break
            root = low
        keep = np.flatnonzero(others)
        return pa.table({"node": pa.array([node[k] for k in keep], pa.binary()), "links": pa.array(links[keep]), "texts": pa.array(others[keep]), "other": pa.array([node[root[k]] for k in keep], pa.binary())})

    return count


def near_classes(docs: DataFrame, id: str = "doc_id", text: str = "text", n: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, few: int = FEW, block: int = BLOCK) -> DataFrame:
    """(id, class_id, n_links, n_texts): one row per row of `docs`.

    class_id: the smallest id of all documents that links of similarity >= threshold join to this one, directly or by
    others. n_links: the other documents linked directly, copies included; n_texts: the different shingle sets among
    them, its own left out. A text without words (null, empty) is a class of its own with no links, repeated rows are
    copies, null ids get the class of their text (null if only null ids are in it). An empty table gives no rows. Further
    columns of `docs` are not read.
    """
    depth = depth_for(threshold, trees, recall)
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    sigs = kept_table(signed(rows, n, trees, depth), "signatures")
    nodes = kept_table(sigs.where("node is not null").groupBy("node").agg(F.count("*").alias("copies"), F.first("size").alias("size"), F.first("prefixes").alias("prefixes"), F.first("marks").alias("marks")), "nodes")
    met = nodes.select("node", F.explode("prefixes").alias("prefix"))
    many = met.groupBy("prefix").agg(F.count("*").alias("members"), F.min("node").alias("head")).where("members > 1")
    met = met.join(many, "prefix")
    groups = kept_table(components(met.where(F.col("members") > few).select(F.col("node").alias("a"), F.col("head").alias("b")).distinct()), "groups")

    def pairs(batches):
        for b in batches:
            out = [(p, q) for row in b.column(0).to_pylist() for i, p in enumerate(sorted(row)) for q in sorted(row)[i + 1 :]]
            yield pa.RecordBatch.from_pydict({"a": pa.array([p for p, _ in out], pa.binary()), "b": pa.array([q for _, q in out], pa.binary())})

    found = met.where(F.col("members") <= few).groupBy("prefix").agg(F.collect_list("node").alias("l")).select("l").mapInArrow(pairs, "a binary, b binary").distinct()
    info = nodes.select("node", "copies", "size", "marks").join(groups.select("node", F.col("root").alias("group")), "node", "left")
    side = lambda s: info.select(*[F.col(c).alias(s if c == "node" else f"{c}_{s}") for c in info.columns])
    found = found.join(side("a"), "a").join(side("b"), "b").where(F.col("group_a").isNull() | F.col("group_b").isNull() | (F.col("group_a") != F.col("group_b")))
    found = found.where(F.least("size_a", "size_b") >= threshold * F.greatest("size_a", "size_b") - 1e-9)
    found = kept_table(alike(found, trees * depth, threshold).select("a", "b", "copies_a", "copies_b"), "candidates")
    wanted = found.select(F.col("a").alias("node")).unionByName(found.select(F.col("b").alias("node"))).unionByName(groups.select("node")).distinct()
    texts = kept_table(texts_of(rows, wanted, n), "texts")
    of = lambda s: texts.select(F.col("node").alias(s), F.col("text").alias(f"text_{s}"))
    sure = kept_table(jaccard(found.join(of("a"), "a").join(of("b"), "b"), n, threshold), "links")
    counted = kept_table(within_groups(texts, info.where(F.col("group").isNotNull()), n, threshold, block), "counted")
    each = sure.select(F.col("a").alias("node"), F.col("copies_b").alias("links"), F.lit(1).cast("long").alias("texts")).unionByName(sure.select(F.col("b").alias("node"), F.col("copies_a").alias("links"), F.lit(1).cast("long").alias("texts"))).unionByName(counted.select("node", "links", "texts"))
    totals = each.groupBy("node").agg(F.sum("links").alias("links"), F.sum("texts").alias("texts"))
    roots = components(sure.select("a", "b").unionByName(counted.select(F.col("node").alias("a"), F.col("other").alias("b")))).select("node", "root")
    about = nodes.select("node", "copies").join(totals, "node", "left").join(roots, "node", "left").select("node", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("texts", F.lit(0)).alias("n_texts"), F.coalesce("root", "node").alias("root"))
    placed = sigs.select("id", "node").join(about, "node", "left")
    named = placed.where("root is not null").groupBy("root").agg(F.min("id").alias("class_id"))
    return placed.join(named, "root", "left").select("id", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("n_texts", F.lit(0)).cast("long").alias("n_texts"))


def alike(pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """Pairs whose signatures agree as those of similar sets do, with a slack of six standard deviations."""
    least = n * (threshold - 6 * (threshold * (1 - threshold) / n) ** 0.5)

    def keep(batches):
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, n) for c in ("marks_a", "marks_b"))
            yield b.select(["a", "b", "copies_a", "copies_b"]).filter(pa.array((x == y).sum(1) >= least))

    return pairs.select("a", "b", "copies_a", "copies_b", "marks_a", "marks_b").mapInArrow(keep, "a binary, b binary, copies_a bigint, copies_b bigint")


def within_groups(texts: DataFrame, info: DataFrame, n: int, threshold: float, block: int) -> DataFrame:
    """All links inside the work groups: (node, links, texts, other), a row per node and pair of cells where it has any."""
    step = float(np.log(1 / threshold))
    g = info.select("node", "copies", "group", F.floor(F.log(F.col("size").cast("double")) / step + 1e-9).alias("level"))
    parts = kept_table(g.groupBy("group", "level").agg(F.ceil(F.count("*") / block).alias("parts")), "parts")
    near = parts.select("group", F.col("level").alias("l"), F.col("parts").alias("p"))
    # A node meets every part of its own level and of both next ones; the lower (level, part) names the pair of cells.
    own = g.join(parts, ["group", "level"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).drop("parts")
    meets = own.withColumn("l", F.explode(F.array(F.col("level") - 1, F.col("level"), F.col("level") + 1))).join(near, ["group", "l"])
    meets = meets.withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("p") - 1)))
    me, you = F.struct(F.col("level").alias("x"), F.col("part").alias("y")), F.struct(F.col("l").alias("x"), F.col("q").alias("y"))
    meets = meets.select("group", "node", "copies", F.least(me, you).alias("low"), F.greatest(me, you).alias("high"), (me <= you).alias("left"), (me >= you).alias("right"))
    rows = meets.join(texts.select("node", "text"), "node")
    return rows.groupBy("group", "low", "high").applyInArrow(cell_links(n, threshold), "node binary, links bigint, texts bigint, other binary")
