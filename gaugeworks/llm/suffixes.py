"""Suffix-array dedup: a byte goes if a string of `length` bytes that covers it also starts earlier.

A longest-previous-factor array names, for every position, the longest match that starts earlier: its matches stand at
the previous and next smaller positions in suffix order. Only suffixes that can have such a match need an order, and only
suffixes with equal beginnings compete, so the suffix array is built sparsely and in slices:

1. Every window of `length` bytes has a canonical anchor, the smallest hashed k-gram in it. Windows with one anchor are a
   run; a run and the bytes it spans are its extent. Blocks ask by hash range which anchors are repeated, and which
   extents were seen whole in an earlier block. An anchor found once clears its windows, an extent seen before removes
   all of its own.
2. What is left are the first copies of differing extents around one anchor. They travel to their anchor's hash range,
   where all their suffixes that start a window are sorted by prefix doubling. Among suffixes with a common prefix of at
   least `length` bytes the previous smaller position in suffix order is an earlier match: the window goes.
   An anchor with more than `hot` differing extents (the edge of a passage in many documents) would fill one range.
   Its windows are dealt by their own hashes instead: a window whose hash comes earlier in its block, or in an earlier
   block, goes.

Blocks are ranges of the id, so that an earlier block is an earlier text. Rows carry one cell per block and hash range
(see `cells`): a string in a third of all documents is one entry per block.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from gaugeworks.llm import cells
from gaugeworks.llm.arrays import U, byte_values, both_powers, mix, pack_sorted, span_hashes, unpack_sorted, utf8

LENGTH = 100
GRAM = 32
PIECE = 1 << 19
#: Differing extents around one anchor, of at most 2 * length bytes each, that are sorted together.
MOST = 1024


def id_blocks(docs: DataFrame, id: str, n: int) -> Column:
    """Blocks 0 .. n - 1 of about equal row counts in order of a numeric id; null ids come first."""
    c = F.col(f"`{id}`")
    cut = docs.select(F.percentile_approx(c, [k / n for k in range(1, n)], 10 * n)).first()[0] if n > 1 else None
    if not cut:
        return F.lit(0)
    edges = np.array(sorted(set(cut)))

    @F.pandas_udf("int")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, ids.to_numpy().astype(edges.dtype), "left").astype(np.int32))

    return F.when(c.isNull(), F.lit(0)).otherwise(place(F.coalesce(c, F.lit(cut[0]))))


def ordered(table: pa.Table) -> pa.Table:
    """A block's texts in order of id, then text; null ids first."""
    table = cells.opened(table)
    return table.take(pc.sort_indices(table, sort_keys=[("id", "ascending"), ("text", "ascending")], null_placement="at_start"))


def window_runs(data: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of successive windows with one anchor: (first window, last window, anchor's hash, extent's hash)."""
    n = len(data)
    if n < length:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, U, U))
    up, down = both_powers(0x9E3779B97F4A7C15 | 5, n)
    h = np.zeros(n + 1, U)
    np.cumsum(byte_values()[data] * up[:n], out=h[1:])
    grams = mix((h[gram:] - h[: n - gram + 1]) * down[: n - gram + 1])
    low = U((1 << max(1, (n - 1).bit_length())) - 1)
    m = (mix(grams ^ U(0xA5A5A5A5A5A5A5A5)) & ~low) | np.arange(len(grams), dtype=U)
    width, done = length - gram + 1, 1
    while done < width:  # the smallest of `width` successive values
        step = min(done, width - done)
        m = np.minimum(m[: len(m) - step], m[step:])
        done += step
    anchor = (m & low).astype(np.int64)
    ok = np.zeros(n + 1, bool)
    size = np.diff(offsets)
    edge = np.zeros(n + 1, np.int64)
    full = size >= length
    np.add.at(edge, offsets[:-1][full], 1)
    np.add.at(edge, offsets[1:][full] - length + 1, -1)
    ok = np.cumsum(edge)[: len(anchor)] > 0
    new = ok.copy()
    new[1:] &= (anchor[1:] != anchor[:-1]) | ~ok[:-1]
    end = ok.copy()
    end[:-1] &= (anchor[1:] != anchor[:-1]) | ~ok[1:]
    a, b = np.flatnonzero(new), np.flatnonzero(end)
    extent = mix((h[b + length] - h[a]) * down[a] + (b - a).astype(U) * U(0xD6E8FEB86659FD93))
    return a, b, grams[anchor[a]], extent


class Block:
    """Runs of a block's texts, and its distinct (anchor, extent) entries in order, with the first run of each."""

    def __init__(self, table: pa.Table, length: int, gram: int):
        self.table = ordered(table)
        self.data, self.offsets = utf8(self.table["text"])
        self.length = length
        found = []
        for x, y in cells.piece_edges(self.offsets, PIECE):
            o = int(self.offsets[x])
            a, b, g, e = window_runs(self.data[o : int(self.offsets[y])], self.offsets[x : y + 1] - o, length, gram)
            found.append((a + o, b + o, g, e))
        self.first, self.last, self.anchor, self.extent = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, t) for t in (np.int64, np.int64, U, U)]
        order = np.lexsort((np.arange(len(self.first)), self.extent, self.anchor))
        g, e = self.anchor[order], self.extent[order]
        new = np.ones(len(order), bool)
        new[1:] = (g[1:] != g[:-1]) | (e[1:] != e[:-1])
        self.entry = np.empty(len(order), np.int64)  # of every run
        self.entry[order] = np.cumsum(new) - 1
        self.head = order[new]  # first run of every entry
        self.g, self.e = g[new], e[new]

    def asked(self, n: int) -> list[tuple[int, bytes]]:
        return [(k, cells.join(b"ask", pack_sorted(self.g[a:b]), self.e[a:b].tobytes())) for k, a, b in cells.split(self.g, n)]

    def said(self, answers: dict[int, bytes], n: int) -> np.ndarray:
        out = np.zeros(len(self.g), np.uint8)
        for k, a, b in cells.split(self.g, n):
            out[a:b] = np.frombuffer(answers[k], np.uint8)
        return out


ALONE, SEEN, TIED, HOT = 0, 1, 2, 3


def judge(blocks: np.ndarray, bodies: list[list[bytes]], hot: int = MOST) -> list[bytes]:
    """For every cell a state per entry: no earlier match, extent seen in an earlier block, first of differing extents, or
    first of more than `hot` of them."""
    g = [unpack_sorted(b[1]) for b in bodies]
    owner = np.repeat(np.arange(len(bodies)), [len(x) for x in g])
    gs = np.concatenate(g) if g else np.zeros(0, U)
    es = np.concatenate([np.frombuffer(b[2], U) for b in bodies]) if bodies else np.zeros(0, U)
    order = np.lexsort((blocks[owner] if len(owner) else owner, es, gs))
    a, e = gs[order], es[order]
    new_a = np.ones(len(order), bool)
    new_a[1:] = a[1:] != a[:-1]
    new_e = new_a.copy()
    new_e[1:] |= e[1:] != e[:-1]
    group = np.cumsum(new_a) - 1
    kinds = np.bincount(group, weights=new_e).astype(np.int64) if len(order) else np.zeros(0, np.int64)
    state = np.where(~new_e, SEEN, np.where(kinds[group] > max(1, hot), HOT, np.where(kinds[group] > 1, TIED, ALONE))) if len(order) else np.zeros(0, np.int64)
    out = np.empty(len(order), np.uint8)
    out[order] = state
    at = np.concatenate([[0], np.cumsum([len(x) for x in g])]).astype(np.int64)
    return [out[x:y].tobytes() for x, y in zip(at[:-1], at[1:])]


def ranks(data: np.ndarray, length: int) -> np.ndarray:
    """Rank of every suffix among all by its first `length` bytes, by prefix doubling; equal ranks share them."""
    r, done = data.astype(np.int64), 1
    while done < length:
        step = min(done, length - done)
        pair = np.full(len(r), -1, np.int64)
        pair[: max(0, len(r) - step)] = r[step:]
        r = np.unique(r * np.int64(len(data) + 257) + pair + 1, return_inverse=True)[1].astype(np.int64)
        done += step
    return r


def previous_smaller(order_rank: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Which suffixes have an earlier match of the whole prefix: in suffix order (rank, then position) the previous
    smaller position shares the prefix just where the neighbour before has the same rank."""
    order = np.lexsort((position, order_rank))
    same = np.zeros(len(order), bool)
    same[1:] = order_rank[order][1:] == order_rank[order][:-1]
    out = np.empty(len(order), bool)
    out[order] = same
    return out


def seen_before(blocks: list[int], hashes: list[np.ndarray]) -> list[np.ndarray]:
    """For every cell which of its distinct hashes an earlier block holds too."""
    h = np.concatenate(hashes)
    order = np.lexsort((np.repeat(blocks, [len(x) for x in hashes]), h))
    same = np.zeros(len(h), bool)
    same[1:] = h[order][1:] == h[order][:-1]
    out = np.empty(len(h), bool)
    out[order] = same
    return np.split(out, np.cumsum([len(x) for x in hashes])[:-1])


def spans(mask_starts: np.ndarray, mask_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Intervals merged where they touch or overlap."""
    if not len(mask_starts):
        return mask_starts, mask_ends
    order = np.argsort(mask_starts, kind="stable")
    s, e = mask_starts[order], np.maximum.accumulate(mask_ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    at = np.flatnonzero(new)
    return s[at], e[np.append(at[1:], len(s)) - 1]


def remove_later_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = LENGTH, gram: int = GRAM, hot: int = MOST) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept): every byte covered by a `length`-byte string that also starts earlier goes.

    Texts are UTF-8 bytes; earlier is a smaller id (a number), or an earlier start in the same text, overlaps included;
    strings are judged on the input. Null ids come before all others; rows with one id are ordered by text, and stay in
    one block. `kept` are the other bytes (binary: a cut may fall inside a character); n_spans counts maximal removed
    runs. Null, empty and shorter texts lose nothing. Further columns of `docs` are not read. An empty table gives no rows.
    """
    n = cells.block_count(docs, text)
    blocks = cells.dealt(docs, id, text, id_blocks(docs, id, n))
    kind = docs.select(f"`{id}`").schema[0].dataType.simpleString()
    gram = min(gram, max(1, length // 3))

    def first(key, table):
        return cells.rows(key[0].as_py(), Block(table, length, gram).asked(n))

    def answer(key, table):
        bodies = [cells.parts(x) for x in table["body"].to_pylist()]
        said = judge(table["block"].to_numpy(), bodies, hot)
        return pa.table({"block": table["block"], "bucket": table["bucket"], "body": pa.array(said, pa.binary())})

    def second(key, table, answers):
        if not table.num_rows:
            return cells.rows(0, [])
        b = Block(table, length, gram)
        state = b.said(dict(zip(answers["bucket"].to_pylist(), answers["body"].to_pylist())), n)
        seen = state[b.entry] == SEEN
        later = np.ones(len(b.first), bool)
        later[b.head] = False
        runs = np.sort(b.head[state == HOT])
        each = b.last[runs] - b.first[runs] + 1
        at = np.repeat(b.first[runs] - np.cumsum(each) + each, each) + np.arange(each.sum())
        h, head = np.unique(span_hashes(b.data, at, at + length), return_index=True)
        again = np.delete(at, head)
        s, e = spans(np.concatenate([b.first[seen | later], again]), np.concatenate([b.last[seen | later], again]) + length)
        own = key[0].as_py()
        out = [(own % n, cells.join(b"note", s.tobytes(), e.tobytes()))]
        out += [(k, cells.join(b"hot", pack_sorted(h[x:y]), at[head[x:y]].tobytes())) for k, x, y in cells.split(h, n)]
        ship = np.flatnonzero(state == TIED)
        raw = memoryview(b.data.tobytes())
        for k, x, y in cells.split(b.g[ship], n):
            runs = np.sort(b.head[ship[x:y]])
            body = b"".join(raw[i:j] for i, j in zip(b.first[runs].tolist(), (b.last[runs] + length).tolist()))
            out.append((k, cells.join(b"ship", b.first[runs].tobytes(), b.last[runs].tobytes(), body)))
        return cells.rows(own, out)

    def match(key, table):
        bodies, owners = [cells.parts(x) for x in table["body"].to_pylist()], table["block"].to_pylist()
        ship = sorted((k for k, x in enumerate(bodies) if x[0] == b"ship"), key=lambda k: owners[k])
        out_block, out_body = [], []
        for k, x in enumerate(bodies):
            if x[0] == b"note":
                out_block.append(owners[k])
                out_body.append(cells.join(*x[1:]))
        many = [k for k, x in enumerate(bodies) if x[0] == b"hot"]
        for k, hit in zip(many, seen_before([owners[k] for k in many], [unpack_sorted(bodies[k][1]) for k in many]) if many else []):
            w = np.sort(np.frombuffer(bodies[k][2], np.int64)[hit])
            s, e = spans(w, w + length)
            out_block.append(owners[k])
            out_body.append(cells.join(s.tobytes(), e.tobytes()))
        if ship:
            lo = [np.frombuffer(bodies[k][1], np.int64) for k in ship]
            hi = [np.frombuffer(bodies[k][2], np.int64) for k in ship]
            data = np.frombuffer(b"".join(bodies[k][3] for k in ship), np.uint8)
            a, b = np.concatenate(lo), np.concatenate(hi)
            owner = np.repeat([owners[k] for k in ship], [len(x) for x in lo])
            base = np.concatenate([[0], np.cumsum(b - a + length)])[:-1]
            each = b - a + 1
            of = np.repeat(np.arange(len(a)), each)
            inside = np.arange(len(of)) - np.repeat(np.cumsum(each) - each, each)
            at = base[of] + inside
            hit = previous_smaller(ranks(data, length)[at], at)
            where, block = a[of][hit] + inside[hit], owner[of][hit]
            cut = np.flatnonzero(np.diff(block)) + 1  # blocks stand in order
            for w, own in zip(np.split(where, cut), block[np.concatenate([[0], cut])].tolist() if len(block) else []):
                s, e = spans(w, w + length)
                out_block.append(own)
                out_body.append(cells.join(s.tobytes(), e.tobytes()))
        return pa.table({"block": pa.array(out_block, pa.int32()), "bucket": pa.array([0] * len(out_block), pa.int32()), "body": pa.array(out_body, pa.binary())})

    def last(key, table, answers):
        t = ordered(table)
        data, offsets = utf8(t["text"])
        got = [cells.parts(x) for x in answers["body"].to_pylist()]
        s, e = [np.concatenate([np.frombuffer(x[i], np.int64) for x in got]) if got else np.zeros(0, np.int64) for i in (0, 1)]
        step = np.zeros(len(data) + 1, np.int32)
        np.add.at(step, s, 1)
        np.add.at(step, e, -1)
        gone = np.cumsum(step[:-1]) > 0
        sums = np.concatenate([[0], np.cumsum(gone)])
        begin = gone.copy()
        begin[1:] &= ~gone[:-1]
        starts = offsets[:-1][np.diff(offsets) > 0]
        begin[starts] = gone[starts]
        counts = np.concatenate([[0], np.cumsum(begin)])
        kept = np.concatenate([[0], np.cumsum(~gone)])[offsets].astype(np.int32)
        body = pa.BinaryArray.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(kept.tobytes()), pa.py_buffer(data[~gone].tobytes())])
        return pa.table({"id": t["id"], "n_bytes": pa.array(np.diff(offsets)), "n_removed": pa.array(np.diff(sums[offsets])), "n_spans": pa.array(np.diff(counts[offsets])), "kept": body})

    asks = blocks.groupBy("block").applyInArrow(first, cells.CELL)
    said = asks.groupBy("bucket").applyInArrow(answer, cells.CELL)
    asks = blocks.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(second, cells.CELL)
    said = asks.groupBy("bucket").applyInArrow(match, cells.CELL)
    return blocks.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(last, f"id {kind}, n_bytes bigint, n_removed bigint, n_spans bigint, kept binary")
