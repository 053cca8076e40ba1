"""Substring dedup over difference-cover anchors.

Of the words of a document only those at cover positions (modulo a period) start an anchor, a short window. Two equal
windows of `window` words, wherever they stand, have some distance d < period at which both positions are cover
positions, so they share an aligned anchor: an anchor found once in all documents clears every window that leans on it
alone. Round one asks which anchors are repeated; round two extends them: it hashes the whole windows around repeated
anchors and asks which of those are repeated. Both rounds carry one row per block and hash range, see `cells`.

A window's 64-bit hash stands for it, after its anchor's independent 64-bit hash has already been found twice.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugeworks.llm import cells
from gaugeworks.llm.arrays import byte_class, in_sorted, run_hashes, runs, span_hashes, utf8

WINDOW = 35
#: Perfect difference sets, every difference modulo the period comes from one pair.
COVERS = {1: (0,), 3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18), 57: (0, 1, 3, 13, 32, 36, 43, 52), 73: (0, 1, 3, 7, 15, 31, 36, 54, 63)}
PIECE = 1 << 20


def period_for(window: int) -> int:
    """The largest period whose anchors still have a third of the window's words."""
    return max(p for p in COVERS if window - p + 1 >= max(1, window / 3))


class Block:
    """Words of a block's texts: hashes, number in their text, and windows that stay inside a text."""

    def __init__(self, table: pa.Table, window: int):
        self.table = cells.opened(table)
        self.data, self.offsets = utf8(self.table["text"])
        found = [runs(self.data[self.offsets[a] : self.offsets[b]], self.offsets[a : b + 1] - self.offsets[a], byte_class("nospace")) for a, b in cells.piece_edges(self.offsets, PIECE)]
        base = [int(self.offsets[a]) for a, _ in cells.piece_edges(self.offsets, PIECE)]
        self.starts = np.concatenate([s + o for (s, _), o in zip(found, base)]) if found else np.zeros(0, np.int64)
        self.ends = np.concatenate([e + o for (_, e), o in zip(found, base)]) if found else np.zeros(0, np.int64)
        self.edges = np.searchsorted(self.starts, self.offsets)
        self.hashes = span_hashes(self.data, self.starts, self.ends)
        n = np.diff(self.edges)
        self.number = np.arange(len(self.starts)) - np.repeat(self.edges[:-1], n)
        self.left = np.repeat(n, n) - self.number  # words from here to the end of the text
        self.window = window
        self.period = period_for(window)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """(words where an anchor starts, its hash)."""
        size = self.window - self.period + 1
        cover = np.zeros(self.period, bool)
        cover[list(COVERS[self.period])] = True
        at = np.flatnonzero(cover[self.number % self.period] & (self.left >= size) & (self.number + self.left >= self.window))
        return at, run_hashes(self.hashes, size)[at] if len(at) else np.zeros(0, np.uint64)

    def candidates(self, anchors: np.ndarray) -> np.ndarray:
        """Words where a whole window starts that holds one of these anchors."""
        some = np.zeros(len(self.starts) + self.period + 1, np.int32)
        some[anchors + 1] = 1
        sums = np.cumsum(some)
        i = np.arange(len(self.starts))
        return np.flatnonzero((self.left >= self.window) & (sums[i + self.period] > sums[i]))

    def windows(self, answers: dict[int, bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
        """(words where a window around a repeated anchor starts, its hash)."""
        at, h = self.anchors()
        u, _ = cells.distinct(h)
        again = u[cells.told(answers, u, n)]
        at = self.candidates(at[in_sorted(h, again)])
        return at, run_hashes(self.hashes, self.window)[at] if len(at) else np.zeros(0, np.uint64)


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """(id, n_words, n_removed, kept): every word covered by a window of `window` words that also starts elsewhere goes.

    Words are runs of anything but ASCII white space, unchanged; windows lie in one text and are judged on the input, so
    all copies of a passage go, the first as well. `kept` has the other words joined by one space. Null and empty texts
    have no words; a text of fewer words than a window keeps all; repeated rows repeat each other; ids (null too) are
    passed through; further columns of `docs` are not read. An empty table gives no rows.
    """
    n = cells.block_count(docs, text)
    blocks = cells.dealt(docs, id, text, cells.by_hash(id, text, n))
    kind = docs.select(f"`{id}`").schema[0].dataType

    def first(key, table):
        b = Block(table, window)
        return cells.rows(key[0].as_py(), cells.asked(key[0].as_py(), *cells.distinct(b.anchors()[1]), n, b"a"))

    def answer(key, table):
        bodies = [cells.parts(x) for x in table["body"].to_pylist()]
        own = [k for k, b in enumerate(bodies) if b[0] != b"note"]
        said = dict(zip(own, cells.repeated([bodies[k] for k in own])))
        out = [cells.join(b[0], said[k]) if k in said else cells.join(b"a", *b[1:]) for k, b in enumerate(bodies)]
        return pa.table({"block": table["block"], "bucket": table["bucket"], "body": pa.array(out, pa.binary())})

    def second(key, table, answers):
        if not table.num_rows:
            return cells.rows(0, [])
        block, got = key[0].as_py(), by_kind(answers)
        _, h = Block(table, window).windows(got[b"a"], n)
        notes = [(k, cells.join(b"note", x)) for k, x in got[b"a"].items()]
        return cells.rows(block, cells.asked(block, *cells.distinct(h), n, b"w") + notes)

    def last(key, table, answers):
        b, got = Block(table, window), by_kind(answers)
        at, h = b.windows(got[b"a"], n)
        u, _ = cells.distinct(h)
        at = at[in_sorted(h, u[cells.told(got[b"w"], u, n)])]
        step = np.zeros(len(b.starts) + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + window, -1)
        gone = np.cumsum(step[:-1]) > 0
        sums = np.concatenate([[0], np.cumsum(gone)])
        return pa.table({"id": b.table["id"], "n_words": pa.array(np.diff(b.edges)), "n_removed": pa.array(np.diff(sums[b.edges])), "kept": joined(b, ~gone)})

    asks = blocks.groupBy("block").applyInArrow(first, cells.CELL)
    said = asks.groupBy("bucket").applyInArrow(answer, cells.CELL)
    asks = blocks.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(second, cells.CELL)
    said = asks.groupBy("bucket").applyInArrow(answer, cells.CELL)
    return blocks.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(last, f"id {kind.simpleString()}, n_words bigint, n_removed bigint, kept string")


def by_kind(answers: pa.Table) -> dict[bytes, dict[int, bytes]]:
    out: dict[bytes, dict[int, bytes]] = {b"a": {}, b"w": {}}
    for bucket, body in zip(answers["bucket"].to_pylist(), answers["body"].to_pylist()):
        kind, flags = cells.parts(body)
        out[kind][bucket] = flags
    return out


def joined(b: Block, keep: np.ndarray) -> pa.Array:
    """The kept words of every text, one space between."""
    size = np.where(keep, b.ends - b.starts + 1, 0)
    total = np.concatenate([[0], np.cumsum(size)])
    s, n = b.starts[keep], size[keep]
    out = np.full(int(total[-1]), 32, np.uint8)
    body = np.repeat(s - total[:-1][keep], n) + np.arange(len(out))
    inner = np.ones(len(out), bool)
    inner[total[1:][keep] - 1] = False
    out[inner] = b.data[body[inner]]
    edges = total[b.edges]
    final = np.zeros(len(out), bool)
    full = edges[1:] > edges[:-1]
    final[edges[1:][full] - 1] = True
    sizes = np.diff(edges) - full
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(offsets.tobytes()), pa.py_buffer(out[~final].tobytes()))
