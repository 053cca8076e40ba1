"""Language-model scoring: stupid backoff over n-gram count tables partitioned by hash.

    S(w | context) = count(context w) / count(context)       if count(context w) >= least, 1 unless stated otherwise
                   = alpha * S(w | shorter context)          else
    S(w)           = count(w) / words of all documents

Counts are over all documents, whole texts, and a document's score is the sum of ln S over its words. Words are runs of
ASCII letters, digits and characters beyond ASCII, A-Z lowered. n-grams stay inside a document; its first words start
with the context they have.

The count tables live in hash ranges: a block of documents sends the distinct n-grams of each length with its own counts
(one packed row per block and range, see `cells`), a range sums them and answers the blocks that asked with what the others add,
where the total is at least `least`, and a block joins the totals to its n-grams and sums per document. With least = 1 all lengths are
asked about at once. With more, words and pairs go first; an n-gram of three or more is asked about only if both of its
parts reached `least`, as it can't otherwise.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from gaugeworks.llm import cells
from gaugeworks.llm.arrays import U, byte_class, lower_ascii, pack_sorted, run_hashes, runs, span_hashes, unpack_sorted, utf8

ORDER, ALPHA, LEAST = 3, 0.4, 1
PIECE = 1 << 20


def pack_counts(n: np.ndarray) -> bytes:
    """Numbers from 0 on as byte planes, compressed: nearly all are the same small one, which then takes far below a byte."""
    width = next(k for k in (1, 2, 4, 8) if not len(n) or int(n.max()) < 1 << 8 * k)
    planes = n.astype(f"<u{width}").view(np.uint8).reshape(-1, width).T
    return cells.join(bytes([width]), len(n).to_bytes(8, "little"), pa.compress(planes.tobytes(), "zstd", asbytes=True))


def unpack_counts(blob: bytes) -> np.ndarray:
    width, size, body = cells.parts(blob)
    n = int.from_bytes(size, "little")
    flat = np.frombuffer(pa.decompress(body, n * width[0], "zstd", asbytes=True), np.uint8)
    return np.ascontiguousarray(flat.reshape(width[0], n).T).view(f"<u{width[0]}").ravel().astype(np.int64)


def pack_hashes(h: np.ndarray) -> bytes:
    """Ascending hashes as `pack_sorted` has them, with the highest bytes of all differences together and compressed: these
    are small, so they need little more than half of their bits. The other bytes are random and stay."""
    flat = pack_sorted(h)
    if len(h) < 2:
        return flat
    width = flat[0]
    planes = np.frombuffer(flat, np.uint8, offset=9).reshape(-1, width)
    high = pa.compress(planes[:, -1].tobytes(), "zstd", asbytes=True)
    return cells.join(flat[:9], len(planes).to_bytes(8, "little"), high, planes[:, :-1].tobytes())


def unpack_hashes(blob: bytes) -> np.ndarray:
    if len(blob) <= 10 + 8:
        return unpack_sorted(blob)
    head, n, high, low = cells.parts(blob)
    n = int.from_bytes(n, "little")
    planes = np.empty((n, head[0]), np.uint8)
    planes[:, -1] = np.frombuffer(pa.decompress(high, n, "zstd", asbytes=True), np.uint8)
    planes[:, :-1] = np.frombuffer(low, np.uint8).reshape(n, -1)
    return unpack_sorted(head + planes.tobytes())


def answered(cells_in: list[list[bytes]], least: int) -> list[bytes]:
    """For each (kind, hashes, counts): flags of the hashes whose total reaches `least` (none if all do), and what the other
    cells add to these counts. An n-gram that only one block holds is thus answered by a zero, and zeros take next to no room."""
    h = [unpack_hashes(c[1]) for c in cells_in]
    own = [unpack_counts(c[2]) for c in cells_in]
    u, back = np.unique(np.concatenate(h) if h else np.zeros(0, U), return_inverse=True)
    total = np.zeros(len(u), np.int64)
    np.add.at(total, back, np.concatenate(own) if own else np.zeros(0, np.int64))
    out, at = [], 0
    for c, x, n in zip(cells_in, h, own):
        t = total[back[at : at + len(x)]]
        at += len(x)
        reached = t >= (1 if c[0] == b"1" else least)
        out.append(cells.join(c[0], b"" if reached.all() else cells.bits(reached), pack_counts((t - n)[reached])))
    return out


class Block:
    def __init__(self, table: pa.Table):
        self.table = cells.opened(table)
        data, offsets = utf8(self.table["text"])
        data = lower_ascii(data)
        starts, ends = [], []
        for a, b in cells.piece_edges(offsets, PIECE):
            o = offsets[a]
            s, e = runs(data[o : offsets[b]], offsets[a : b + 1] - o, byte_class("alnum"))
            starts.append(s + o)
            ends.append(e + o)
        s = np.concatenate(starts) if starts else np.zeros(0, np.int64)
        self.words = span_hashes(data, s, np.concatenate(ends) if ends else s)
        self.edges = np.searchsorted(s, offsets)
        n = np.diff(self.edges)
        self.number = np.arange(len(s)) - np.repeat(self.edges[:-1], n)

    def grams(self, n: int, counts: dict[int, np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
        """(last word of every n-gram that may reach `least`, its hash)."""
        ok = self.number >= n - 1
        if n > 2 and least > 1:
            part = counts[n - 1] >= least
            ok[1:] &= part[1:] & part[:-1]
        at = np.flatnonzero(ok)
        return at, (self.words if n == 1 else run_hashes(self.words, n)[at - n + 1] if len(at) else np.zeros(0, U))

    def ask(self, n: int, counts: dict[int, np.ndarray], least: int, ranges: int) -> list[tuple[int, bytes]]:
        u, c = np.unique(self.grams(n, counts, least)[1], return_counts=True)
        return [(k, cells.join(str(n).encode(), pack_hashes(u[a:b]), pack_counts(c[a:b]))) for k, a, b in cells.split(u, ranges)]

    def totals(self, answers: dict[bytes, dict[int, list[bytes]]], upto: int, least: int, ranges: int) -> dict[int, np.ndarray]:
        """For n up to `upto` the total of the n-gram that ends at each word, 0 where it is not known to reach `least`."""
        out: dict[int, np.ndarray] = {}
        for n in range(1, upto + 1):
            at, h = self.grams(n, out, least)
            u, back, t = np.unique(h, return_inverse=True, return_counts=True)
            for k, a, b in cells.split(u, ranges):
                flags, others = answers[str(n).encode()][k]
                reached = cells.unbits(flags, b - a) if flags else np.ones(b - a, bool)
                part = t[a:b]
                part[reached] += unpack_counts(others)
                part[~reached] = 0
            out[n] = np.zeros(len(self.words), np.int64)
            out[n][at] = t[back]
        return out


def stupid_backoff(docs: DataFrame, id: str = "doc_id", text: str = "text", order: int = ORDER, alpha: float = ALPHA, least: int = LEAST) -> DataFrame:
    """(id, n_words, score): the sum of ln S over the words of every whole text.

    Null, empty and wordless texts have score 0 and no words; repeated rows count as further documents and score alike;
    ids (null too) are passed through; further columns of `docs` are not read. An empty table gives no rows.
    """
    ranges = cells.block_count(docs, text)
    blocks = cells.dealt(docs, id, text, cells.by_hash(id, text, ranges))
    kind = docs.select(f"`{id}`").schema[0].dataType.simpleString()
    at_once = order if least <= 1 else min(order, 2)

    def first(key, table):
        b, own = Block(table), key[0].as_py()
        size = cells.join(b"size", len(b.words).to_bytes(8, "little"))
        return cells.rows(own, [c for n in range(1, at_once + 1) for c in b.ask(n, {}, least, ranges)] + [(0, size)])

    def answer(key, table):
        bodies = [cells.parts(x) for x in table["body"].to_pylist()]
        out: list = [None] * len(bodies)
        size = sum(int.from_bytes(b[1], "little") for b in bodies if b[0] == b"size").to_bytes(8, "little")
        for k, b in enumerate(bodies):
            if b[0] == b"size":
                out[k] = cells.join(b"total", size)
        for n in {b[0] for b in bodies} - {b"size"}:
            mine = [k for k, b in enumerate(bodies) if b[0] == n]
            for k, said in zip(mine, answered([bodies[k] for k in mine], least)):
                out[k] = said
        return pa.table({"block": table["block"], "bucket": table["bucket"], "body": pa.array(out, pa.binary())})

    def read(answers):
        got: dict[bytes, dict[int, list[bytes]]] = {str(n).encode(): {} for n in range(1, order + 1)} | {b"total": {}}
        for bucket, body in zip(answers["bucket"].to_pylist(), answers["body"].to_pylist()):
            name, *rest = cells.parts(body)
            got[name][bucket] = rest
        return got

    def longer(n):
        def ask(key, table, answers):
            if not table.num_rows:
                return cells.rows(0, [])
            b = Block(table)
            return cells.rows(key[0].as_py(), b.ask(n, b.totals(read(answers), n - 1, least, ranges), least, ranges))

        return ask

    def last(key, table, answers):
        b, got = Block(table), read(answers)
        total = int.from_bytes(got[b"total"][0][0], "little")
        c = b.totals(got, order, least, ranges)
        value = np.log(np.maximum(c[1], 1)) - np.log(max(total, 1)) + np.minimum(b.number, order - 1) * np.log(alpha)
        for n in range(2, order + 1):
            at = np.flatnonzero(c[n] >= least)
            value[at] = np.log(c[n][at]) - np.log(c[n - 1][at - 1]) + (np.minimum(b.number[at], order - 1) - n + 1) * np.log(alpha)
        n = np.diff(b.edges)
        score = np.zeros(len(n))
        if len(value):
            score[n > 0] = np.add.reduceat(value, b.edges[:-1][n > 0])
        return pa.table({"id": b.table["id"], "n_words": pa.array(n), "score": pa.array(score)})

    asks = blocks.groupBy("block").applyInArrow(first, cells.CELL)
    said = asks.groupBy("bucket").applyInArrow(answer, cells.CELL)
    for n in range(at_once + 1, order + 1):
        asks = blocks.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(longer(n), cells.CELL)
        said = said.unionByName(asks.groupBy("bucket").applyInArrow(answer, cells.CELL))
    return blocks.groupBy("block").cogroup(said.groupBy("block")).applyInArrow(last, f"id {kind}, n_words bigint, score double")
