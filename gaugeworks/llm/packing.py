"""Packing by powers of two: every document is cut into pieces of binary lengths, equal lengths share a bucket.

A document of n tokens gives n // 1024 pieces of 1,024 and one piece for every further one-bit of n, longest first.
Each piece is a sequence of its own, so no sequence crosses documents and none is padded; a batch takes sequences of
one bucket (one length). Cutting needs nothing but the document itself, so there is no shuffle and no count of the whole.
"""

import json
import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from gaugeworks.llm import arrays

LENGTH = 1024
#: Parts of texts that a task remembers before it starts anew; bounds its memory.
PARTS = 500_000
#: Texts tokenised at a time: this many bytes of a batch, at least one text.
PIECE = 2 << 20


class Ids:
    """Token ids of whole texts, remembering the ids of the parts that texts share.

    A byte-level vocabulary first cuts a text at changes between letters, digits, white space and the rest; ids never
    depend on what stands beyond such a cut. `cuts` finds cuts that are certain, and a part's ids are found once and
    kept. So the ids of the parts, one after another, are the ids of the whole text.
    """

    def __init__(self, path: str, parts: int = PARTS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs one task per core already
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.model.encode_special_tokens = True
        self.most = parts
        self.cuts = cuts if cuts_hold(self.model) else text_starts
        self.clear()

    def clear(self) -> None:
        """Known parts: ascending hashes, where each one's ids begin, how many, and all ids in a row."""
        self.known, self.first, self.count, self.table = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def learn(self, hashes: np.ndarray, texts: list[str]) -> None:
        got = self.encode(texts)
        count = np.fromiter(map(len, got), np.int64, len(got))
        first = len(self.table) + np.cumsum(count) - count
        self.table = np.concatenate([self.table, np.fromiter(chain.from_iterable(got), np.uint32, int(count.sum()))])
        known = np.concatenate([self.known, hashes])
        order = np.argsort(known, kind="stable")
        self.known, self.first, self.count = known[order], np.concatenate([self.first, first])[order], np.concatenate([self.count, count])[order]

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, ids in each text)."""
        data, offsets = arrays.utf8(texts)
        starts = self.cuts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        hashes, back = np.unique(arrays.span_hashes(data, starts, ends), return_inverse=True)
        new = ~arrays.in_sorted(hashes, self.known)
        if new.any():
            if len(self.known) > self.most:
                self.clear()
                new[:] = True
            where = np.empty(len(hashes), np.int64)
            where[back] = np.arange(len(back))
            raw = data.tobytes()
            self.learn(hashes[new], [raw[a:b].decode() for a, b in zip(starts[where[new]].tolist(), ends[where[new]].tolist())])
        at = np.searchsorted(self.known, hashes)
        n = self.count[at][back]
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.table[np.repeat(self.first[at][back] - total[:-1], n) + np.arange(total[-1])]
        edges = total[np.searchsorted(starts, offsets)]
        return out, np.diff(edges)


def cuts_hold(model) -> bool:
    """Whether `cuts` is right for a tokenizer: a byte-level one with the usual pattern, that changes no text before, and
    whose added tokens are all special (so they are plain text here)."""
    state = json.loads(model.to_str())
    pre = state["pre_tokenizer"] or {}
    return state["normalizer"] is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and all(t["special"] for t in state["added_tokens"])


def text_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the texts that aren't empty: every text is one part."""
    return offsets[:-1][np.diff(offsets) > 0]


#: 0 white space, 1 ASCII letters, 2 digits, 3 other ASCII, 4 beyond ASCII, 5 white space that keeps a text whole.
CLASS = np.full(256, 3, np.uint8)
CLASS[[32, 10]] = 0
CLASS[[9, 11, 12, 13, 28, 29, 30, 31]] = 5
CLASS[65:91] = CLASS[97:123] = 1
CLASS[48:58] = 2
CLASS[128:] = 4


def cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where parts start, in bytes: every text's start; a space or line feed between other characters; after such a line
    feed; where the class of two ASCII characters changes, unless an apostrophe is before. A text in which white space
    meets white space, or with any other white space, is one part."""
    if not len(data):
        return np.zeros(0, np.int64)
    c = CLASS[data]
    gap = c == 0
    cut = np.zeros(len(data), bool)
    cut[1:] = gap[1:] | (data[:-1] == 10) | ((c[1:] != c[:-1]) & (c[1:] < 4) & (c[:-1] < 4) & ~gap[:-1] & (data[:-1] != 39))
    odd = c == 5
    odd[1:] |= gap[1:] & gap[:-1]
    lead = np.flatnonzero((data == 0xC2) | ((data >= 0xE1) & (data <= 0xE3)))
    if len(lead):
        a, b = data[np.minimum(lead + 1, len(data) - 1)], data[np.minimum(lead + 2, len(data) - 1)]
        d = data[lead]
        wide = ((d == 0xC2) & ((a == 0x85) | (a == 0xA0))) | ((d == 0xE1) & (a == 0x9A) & (b == 0x80)) | ((d == 0xE3) & (a == 0x80) & (b == 0x80))
        wide |= (d == 0xE2) & (((a == 0x80) & ((b <= 0x8A) | (b == 0xA8) | (b == 0xA9) | (b == 0xAF))) | ((a == 0x81) & (b == 0x9F)))
        odd[lead[wide]] = True
    if odd.any():
        for k in np.unique(np.searchsorted(offsets, np.flatnonzero(odd), "right") - 1):
            cut[offsets[k] : offsets[k + 1]] = False
    begin = offsets[:-1]
    cut[begin[begin < len(data)]] = True
    return np.flatnonzero(cut)


def pack(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text", length: int = LENGTH, end_id: int = 0, ids: bool = True) -> DataFrame:
    """One row per piece: id, start, length, tokens (array), ids_crc32, doc_tokens, sequence_id, offset, bucket.

    path: the tokenizer's file, on every executor. A document is its ids and `end_id`; a null or empty text is `end_id`
    alone. Null ids stay null; repeated rows are packed once each. Further columns of `docs` are not read. `bucket` is
    the piece's length, so that a writer's partitionBy("bucket") puts equal lengths together. sequence_id is unique: the
    number of the task in the upper 23 bits, a count in the lower 40. ids_crc32 is the checksum of the ids as
    little-endian unsigned 32-bit values. ids=False leaves the column of ids out. An empty table gives no rows.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    tokens = "tokens array<int>, " if ids else ""
    kind = f"id {rows.schema[0].dataType.simpleString()}, start bigint, length bigint, {tokens}ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, bucket bigint"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, task, count = None, TaskContext.get().partitionId(), 0
        for batch in batches:
            model = model or Ids(path)
            for part in slices(batch):
                out = table_of(part, model, length, end_id, (task << 40) + count, ids)
                count += out.num_rows
                yield out
        del model
        arrays.release()

    return rows.mapInArrow(cut, kind)


def slices(batch: pa.RecordBatch, most: int = PIECE) -> Iterator[pa.RecordBatch]:
    """Pieces of a batch of (id, text) with about `most` bytes of text, at least one row."""
    group = np.cumsum(np.asarray(pc.binary_length(batch.column(1)).fill_null(0), np.int64)) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def binary_pieces(n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, size) of all pieces of documents of n tokens, in order."""
    whole, bits = n // length, length.bit_length() - 1
    sizes = 1 << np.arange(bits)[::-1]
    has = (n[:, None] & sizes) > 0
    each = whole + has.sum(1)
    doc = np.repeat(np.arange(len(n)), each)
    size = np.full(len(doc), length, np.int64)
    ends = np.cumsum(each)
    row, bit = np.nonzero(has)
    nth = np.arange(len(row)) - np.searchsorted(row, row)
    size[(ends - has.sum(1))[row] + nth] = sizes[bit]
    after = np.cumsum(size)
    before_doc = np.concatenate([[0], np.cumsum(n)])[:-1]
    return doc, after - size - before_doc[doc], size


def table_of(part: pa.RecordBatch, model: Ids, length: int, end_id: int, first: int, ids: bool) -> pa.RecordBatch:
    flat, n = model.of(part.column(1))
    n = n + 1
    ends = np.cumsum(n)
    full = np.full(int(ends[-1]), end_id, np.dtype("<u4"))
    keep = np.ones(len(full), bool)
    keep[ends - 1] = False
    full[keep] = flat
    doc, start, size = binary_pieces(n, length)
    edges = np.concatenate([[0], np.cumsum(size)])
    raw = memoryview(full.tobytes())
    crc = np.fromiter((zlib.crc32(raw[a:b]) for a, b in zip((edges[:-1] * 4).tolist(), (edges[1:] * 4).tolist())), np.int64, len(size))
    columns = {"id": part.column(0).take(pa.array(doc)), "start": pa.array(start), "length": pa.array(size)}
    if ids:
        columns["tokens"] = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(full.view(np.int32)))
    columns |= {"ids_crc32": pa.array(crc), "doc_tokens": pa.array(n[doc]), "sequence_id": pa.array(first + np.arange(len(doc), dtype=np.int64)), "offset": pa.array(np.zeros(len(doc), np.int64)), "bucket": pa.array(size)}
    return pa.RecordBatch.from_pydict(columns)
