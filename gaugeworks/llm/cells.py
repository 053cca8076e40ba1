"""Questions about hashes between blocks of documents and hash ranges, as packed rows.

Documents are dealt into blocks of bounded size. A block asks about the distinct hashes of its texts: one row (cell) per
block and hash range, holding the ascending hashes as packed differences. All cells of a range meet in one group, which
sees every hash of its range once per block that holds it, never once per occurrence, however hot a hash is. It answers
each block with a few bits per hash asked, in the order asked. Nothing passes through the driver, and the text is
shuffled once: later rounds read the same shuffle again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from gaugeworks.llm.arrays import U, pack_sorted, unpack_sorted
from gaugeworks.llm.frames import partitions, text_bytes

#: Most text bytes of a block, on average; bounds the memory of a task.
BLOCK_BYTES = 12 << 20
CELL = "block int, bucket int, body binary"


def block_count(docs: DataFrame, text: str, most: int = BLOCK_BYTES) -> int:
    """Blocks of at most `most` bytes, two per shuffle partition where there is enough text."""
    total = text_bytes(docs, text)
    return max(1, -(-total // max(1 << 20, min(most, total // (2 * partitions(docs.sparkSession))))))


def dealt(docs: DataFrame, id: str, text: str, block: Column) -> DataFrame:
    """(block, body): the (id, text) rows of each block, null texts as empty ones, packed by every task that has some."""
    rows = docs.select(block.cast("int").alias("block"), F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))

    def pack(batches):
        for b in batches:
            order = np.argsort(b.column(0).to_numpy(), kind="stable")
            b = b.take(pa.array(order))
            block = b.column(0).to_numpy()
            at = [0, *(np.flatnonzero(np.diff(block)) + 1).tolist(), len(block)]
            found = [(block[x], b.slice(x, y - x).select(["id", "text"])) for x, y in zip(at[:-1], at[1:]) if y > x]
            yield pa.RecordBatch.from_pydict({"block": pa.array([k for k, _ in found], pa.int32()), "body": pa.array([packed(v) for _, v in found], pa.binary())})

    return rows.mapInArrow(pack, "block int, body binary")


def packed(batch: pa.RecordBatch) -> bytes:
    """A batch as a compressed stream; texts compress far better together than row by row in a shuffle."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=3))) as w:
        w.write_batch(batch)
    return sink.getvalue().to_pybytes()


def opened(table: pa.Table) -> pa.Table:
    """The (id, text) rows of a block's packed bodies."""
    parts_in = [pa.ipc.open_stream(x).read_all() for x in table["body"].to_pylist()]
    return pa.concat_tables(parts_in).combine_chunks()


def by_hash(id: str, text: str, n: int) -> Column:
    """The block of a document by a hash of its id and text, so that equal or null ids are dealt out too."""
    return F.pmod(F.xxhash64(F.col(f"`{id}`"), F.col(f"`{text}`")), F.lit(n))


def edges(n: int) -> np.ndarray:
    """First hash of every range after the first."""
    return np.array([(k << 64) // n for k in range(1, n)], U)


def split(h: np.ndarray, n: int) -> list[tuple[int, int, int]]:
    """(bucket, from, to) of the slices of ascending hashes that lie in the n ranges, without empty ones."""
    at = np.concatenate([[0], np.searchsorted(h, edges(n)), [len(h)]]).tolist()
    return [(k, a, b) for k, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]


def rows(block: int, cells: list[tuple[int, bytes]]) -> pa.Table:
    return pa.table({"block": pa.array([block] * len(cells), pa.int32()), "bucket": pa.array([k for k, _ in cells], pa.int32()), "body": pa.array([b for _, b in cells], pa.binary())})


def join(*parts: bytes) -> bytes:
    """Parts in a row, each with its length before it."""
    return b"".join(len(p).to_bytes(8, "little") + p for p in parts)


def parts(blob: bytes) -> list[bytes]:
    out, at = [], 0
    while at < len(blob):
        n = int.from_bytes(blob[at : at + 8], "little")
        out.append(blob[at + 8 : at + 8 + n])
        at += 8 + n
    return out


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(blob: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(blob, np.uint8), count=n).astype(bool)


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(ascending distinct hashes, which of them come more than once)."""
    u, n = np.unique(h, return_counts=True)
    return u, n > 1


def asked(block: int, h: np.ndarray, many: np.ndarray, n: int, kind: bytes = b"") -> list[tuple[int, bytes]]:
    """Cells asking which of the ascending distinct hashes come more than once anywhere; `many` are known to."""
    return [(k, join(kind, pack_sorted(h[a:b]), bits(many[a:b]))) for k, a, b in split(h, n)]


def repeated(bodies: list[list[bytes]]) -> list[bytes]:
    """For each body (kind, hashes, many) the bits of the hashes that come more than once in the cells together."""
    hashes = [unpack_sorted(b[1]) for b in bodies]
    many = np.concatenate([unbits(b[2], len(h)) for b, h in zip(bodies, hashes)]) if bodies else np.zeros(0, bool)
    u, back, n = np.unique(np.concatenate(hashes) if hashes else np.zeros(0, U), return_inverse=True, return_counts=True)
    flag = n > 1
    np.logical_or.at(flag, back[many], True)
    out, at = [], 0
    for h in hashes:
        out.append(bits(flag[back[at : at + len(h)]]))
        at += len(h)
    return out


def told(answers: dict[int, bytes], h: np.ndarray, n: int) -> np.ndarray:
    """The answered flag of every ascending distinct hash; `answers` by bucket."""
    out = np.zeros(len(h), bool)
    for k, a, b in split(h, n):
        out[a:b] = unbits(answers[k], b - a)
    return out


def piece_edges(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of texts with about `most` bytes, at least one text each."""
    out, a, n = [], 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most, "right")) - 1)
        out.append((a, min(b, n)))
        a = min(b, n)
    return out
