"""Alignment of two tokenizers: byte spans of both sides joined by nearest earlier start, and counts of linked ids.

Both sides cover the same bytes of a document, so every token's start lies in exactly one token of the other side.
`pandas.merge_asof`, keyed by document, finds it from both sides; the union of the two results is every pair of tokens that
overlap. Where both sides end at one byte, a group ends. How many documents hold a pair of ids linked is counted over the
whole corpus: documents are taken in blocks of bounded size, a block asks about its distinct pairs once, and gets their
counts back. So a pair that every document holds is one row per block, never one per occurrence.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from gaugeworks.llm import arrays, packing
from gaugeworks.llm.frames import kept_table

#: Text bytes of a block, at least one document: what a task holds, and how often a pair is asked about.
BLOCK_BYTES = 8 << 20
#: Text bytes aligned at a time.
PIECE = 1 << 20


def byte_letters() -> dict[str, int]:
    """The byte of each letter of a byte-level vocabulary: printable bytes stand for themselves, the rest in turn for U+0100 and on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Side(packing.Ids):
    """Token ids of texts by one tokenizer, and the bytes of every id.

    An id one above the vocabulary stands for a part whose tokens' bytes aren't the part's bytes. `lengths` has the bytes of
    each id. Parts are cut only where no token can reach across, and each distinct part is encoded once.
    """

    def __init__(self, path: str, parts: int = packing.PARTS):
        super().__init__(path, parts)
        letters = byte_letters()
        size = self.model.get_vocab_size()
        entries = [self.model.id_to_token(k) or "" for k in range(size)]
        self.bytes = [bytes(letters[c] for c in e) if all(c in letters for c in e) else e.encode() for e in entries]
        self.finish()

    def finish(self) -> None:
        self.size = len(self.bytes)
        self.lengths = np.array([*map(len, self.bytes), 0], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        out = self.ids_of(texts)
        return [ids if b"".join(map(self.bytes.__getitem__, ids)) == t.encode() else [self.size] for ids, t in zip(out, texts)]

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        return super().encode(texts)


class Pieces(Side):
    """A sentencepiece model that puts a space before a text. A text is cut before a space that follows another character,
    as no piece of such a model holds a space after one; a model with such a piece gets whole texts."""

    def __init__(self, path: str, parts: int = packing.PARTS):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.most = parts
        self.clear()
        names = [self.model.id_to_piece(k) for k in range(self.model.get_piece_size())]
        self.bytes = [bytes([int(p[3:-1], 16)]) if self.model.is_byte(k) else p.replace("▁", " ").encode() for k, p in enumerate(names)]
        self.alone = self.model.piece_to_id("▁")
        self.cuts = packing.text_starts if any("▁" in p.lstrip("▁") for p in names) else space_cuts
        self.finish()

    def ids_of(self, texts: list[str]) -> list[list[int]]:
        out = self.model.encode([t[1:] for t in texts], num_threads=1)
        return [ids or [self.alone] for ids in out]


def space_cuts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the texts, and spaces after another character."""
    cut = np.zeros(len(data), bool)
    cut[1:] = (data[1:] == 32) & (data[:-1] != 32)
    cut[packing.text_starts(data, offsets)] = True
    return np.flatnonzero(cut)


def side(path: str) -> Side:
    return Pieces(path) if path.endswith(".model") else Side(path)


@lru_cache(maxsize=1)
def both(a: str, b: str) -> tuple[Side, Side, pa.Array]:
    """Both tokenizers and the printed ids of `print_codes`, for the tasks that a Python worker runs in turn."""
    x, y = side(a), side(b)
    names = [f"{k}{mark}" for s, marks in ((x, ",|"), (y, ",;")) for mark in marks for k in range(s.size)]
    return x, y, pa.array(names)


class Aligned:
    """Tokens, groups and links of some texts, all as arrays over both sides' tokens in order.

    ok: which texts have tokens. doc, ids, end for each side; last: the token ends a group; left, right: the tokens of every
    overlapping pair.
    """

    def __init__(self, texts: pa.Array, a: Side, b: Side):
        some = np.asarray(pc.fill_null(pc.greater(pc.binary_length(texts), 0), False))
        spaced = pc.binary_join_element_wise(pa.scalar(" ", texts.type), texts.filter(pa.array(some)), pa.scalar("", texts.type))
        got = [s.of(spaced) for s in (a, b)]
        good = np.ones(int(some.sum()), bool)
        for s, (ids, n) in zip((a, b), got):
            good[np.repeat(np.arange(len(n)), n)[ids == s.size]] = False
        self.ok = some.copy()
        self.ok[some] = good
        self.n_a, self.n_b = (self.spread(n[good]) for _, n in got)
        self.ids, self.end, self.doc, frames = [], [], [], []
        for s, (ids, n) in zip((a, b), got):
            ids = ids[np.repeat(good, n)].astype(np.int64)
            size = s.lengths[ids]
            end, doc = np.cumsum(size), np.repeat(np.flatnonzero(self.ok), n[good])
            self.ids.append(ids), self.end.append(end), self.doc.append(doc)
            frames.append(pd.DataFrame({"doc": doc, "start": end - size, "token": np.arange(len(ids))}))
        self.left, self.right = overlaps(*frames)
        self.last = [arrays.in_sorted(x, y) for x, y in (self.end, self.end[::-1])]

    def spread(self, n: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.ok), np.int64)
        out[self.ok] = n
        return out

    def per_text(self, doc: np.ndarray) -> np.ndarray:
        return np.bincount(doc, minlength=len(self.ok))

    def group_texts(self, names: pa.Array, sizes: tuple[int, int]) -> list[memoryview]:
        """`a1,a2|b1;a3|b2,b3` of every text with tokens."""
        (la, lb), (ia, ib) = self.last, self.ids
        first = [np.concatenate([[0], np.flatnonzero(x) + 1]) for x in self.last]
        group = [np.cumsum(x) - x for x in self.last]
        codes = np.empty(len(ia) + len(ib), np.int64)
        codes[np.arange(len(ia)) + first[1][group[0]]] = ia + la * sizes[0]
        codes[np.arange(len(ib)) + first[0][group[1] + 1]] = 2 * sizes[0] + ib + lb * sizes[1]
        data, offsets = arrays.utf8(names.take(pa.array(codes)))
        at = offsets[np.concatenate([[0], np.cumsum((self.n_a + self.n_b)[self.ok])])].tolist()
        raw = memoryview(data)
        return [raw[x : y - 1] for x, y in zip(at[:-1], at[1:])]


def overlaps(a: pd.DataFrame, b: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(tokens of a, tokens of b) of all overlapping pairs: each start finds the token of the other side that covers it."""
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    ab = pd.merge_asof(a, b.rename(columns={"token": "other"}), on="start", by="doc")
    ba = pd.merge_asof(b, a.assign(begin=a["start"]).rename(columns={"token": "other"}), on="start", by="doc")
    ba = ba[ba["begin"] < ba["start"]]  # equal starts are in `ab`
    return np.concatenate([ab["token"], ba["other"]]), np.concatenate([ab["other"], ba["token"]])


def zipped(*columns: np.ndarray) -> bytes:
    return pa.compress(np.concatenate([c.astype(np.int32) for c in columns]).tobytes(), "zstd", asbytes=True)


def unzipped(body: bytes, n: int, parts: int) -> list[np.ndarray]:
    return np.split(np.frombuffer(pa.decompress(body, n * 4, "zstd", asbytes=True), np.int32), parts)


def align(docs: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    a_path: a byte-level tokenizers file, given a space and the text. b_path: a sentencepiece model that adds this space,
    or a second byte-level file. Both must be on every executor. n_links counts overlapping pairs of token occurrences; the
    count of a pair of ids is the number of rows in which it is linked (rows that repeat an id are documents of their own);
    n_best counts links whose count no other partner of their A id exceeds, ties included. Null and empty texts, and texts
    that either side doesn't give back byte by byte, have zeros and an empty digest. An empty table gives no rows; further
    columns are not read. One text is aligned whole: a task's memory grows with the longest text, about 150 bytes a byte.
    """
    blocks, size = aligned_blocks(docs, a_path, b_path, id, text)
    asks = blocks.select("block", F.explode(F.arrays_zip("pairs", "held")).alias("p")).select("block", F.col("p.pairs").alias("pair"), F.col("p.held").alias("n"))
    counts = pair_counts(asks, size)
    answers = asks.select("block", "pair").join(counts.select("pair", "n", "best"), "pair")
    kind = blocks.schema["id"].dataType.elementType.simpleString()
    schema = f"id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string"

    def finish(block: pa.Table, found: pa.Table) -> pa.Table:
        found = found.combine_chunks()
        order = np.argsort(found["pair"].to_numpy())
        n, best = found["n"].to_numpy()[order], found["best"].to_numpy(zero_copy_only=False)[order]
        out = []
        for row in block.to_batches():
            for k in range(row.num_rows):
                each = {c: row.column(c)[k].values for c in ("id", "n_a", "n_b", "n_groups", "n_links", "n_pairs", "sha")}
                total = int(pc.sum(each["n_pairs"]).as_py() or 0)
                at, times = unzipped(row.column("body")[k].as_py(), 2 * total, 2)
                of = np.repeat(np.arange(len(each["id"])), each["n_pairs"].to_numpy())
                sums = [np.bincount(of, weights=v, minlength=len(each["id"])).astype(np.int64) for v in (times * best[at], times * n[at])]
                out.append(pa.table({"id": each["id"]} | {c: each[c] for c in ("n_a", "n_b", "n_groups", "n_links")} | {"n_best": sums[0], "count_sum": sums[1], "groups_sha256": each["sha"]}))
        return pa.concat_tables(out)

    own = blocks.drop("pairs", "held").withColumn("block", F.col("block").alias("own"))
    return own.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, schema)


def pair_counts(asks: DataFrame, size: int) -> DataFrame:
    """(a, b, pair, n, best) for every linked pair of ids: n documents hold it; best: no partner of `a` has more.
    An id has at most as many partners as the other vocabulary has entries, so the window stays small."""
    counts = asks.groupBy("pair").agg(F.sum("n").alias("n")).withColumns({"a": F.expr(f"pair div {size}"), "b": F.col("pair") % size})
    return counts.withColumn("best", F.col("n") == F.max("n").over(Window.partitionBy("a")))


def lexicon(docs: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(a, b, n, best) over the corpus: which ids of both vocabularies are linked, in how many documents."""
    blocks, size = aligned_blocks(docs, a_path, b_path, id, text)
    asks = blocks.select(F.explode(F.arrays_zip("pairs", "held")).alias("p")).select(F.col("p.pairs").alias("pair"), F.col("p.held").alias("n"))
    return pair_counts(asks, size).select("a", "b", "n", "best")


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, id: str, text: str) -> tuple[DataFrame, int]:
    """One row per block of documents, written once, and the size of the second vocabulary. A pair is a * size + b.

    Per document arrays id, n_a, n_b, n_groups, n_links, n_pairs, sha; per block the ascending distinct pairs and in how
    many of its documents each is held; body: for every document's distinct pairs their place among `pairs` and how often.
    """
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    counts = ("n_a", "n_b", "n_groups", "n_links", "n_pairs")
    schema = f"block bigint, id array<{kind}>, {', '.join(f'{c} array<bigint>' for c in counts)}, sha array<string>, pairs array<bigint>, held array<bigint>, body binary"
    size = side(b_path).size

    def blocks(batches):
        task, count, parts, bytes_in = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for piece in packing.slices(batch, PIECE):
                parts.append(block_part(piece, *both(a_path, b_path)))
                bytes_in += piece.nbytes
                if bytes_in >= BLOCK_BYTES:
                    yield block_row((task << 32) + count, parts)
                    count, parts, bytes_in = count + 1, [], 0
        if parts:
            yield block_row((task << 32) + count, parts)

    return kept_table(rows.mapInArrow(blocks, schema), "aligned"), size


def block_part(piece: pa.RecordBatch, a: Side, b: Side, names: pa.Array) -> dict:
    x = Aligned(piece.column(1), a, b)
    sha = np.full(len(x.ok), "", object)
    sha[x.ok] = [hashlib.sha256(t).hexdigest() for t in x.group_texts(names, (a.size, b.size))]
    doc = x.doc[0][x.left]
    pairs = x.ids[0][x.left] * b.size + x.ids[1][x.right]
    order = np.lexsort((pairs, doc))
    doc, pairs = doc[order], pairs[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (pairs[1:] != pairs[:-1])
    at = np.flatnonzero(new)
    times = np.diff(np.append(at, len(doc)))
    return {"id": piece.column(0), "n_a": x.n_a, "n_b": x.n_b, "n_groups": x.per_text(x.doc[0][x.last[0]]), "n_links": x.per_text(doc), "n_pairs": x.per_text(doc[at]), "sha": sha, "pairs": pairs[at], "times": times}


def block_row(block: int, parts: list[dict]) -> pa.RecordBatch:
    whole = {c: np.concatenate([p[c] for p in parts]) for c in parts[0] if c != "id"}
    pairs, at, held = np.unique(whole["pairs"], return_inverse=True, return_counts=True)
    one = lambda v: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v)
    columns = {"block": pa.array([block], pa.int64()), "id": one(pa.concat_arrays([p["id"] for p in parts]))}
    columns |= {c: one(pa.array(whole[c], pa.int64())) for c in ("n_a", "n_b", "n_groups", "n_links", "n_pairs")}
    columns |= {"sha": one(pa.array(whole["sha"], pa.string())), "pairs": one(pa.array(pairs, pa.int64())), "held": one(pa.array(held, pa.int64()))}
    return pa.RecordBatch.from_pydict(columns | {"body": pa.array([zipped(at, whole["times"])], pa.binary())})


def groups(docs: DataFrame, a_path: str, b_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per group: id, start and end in bytes of the text with its space, a and b (arrays of ids)."""
    rows = docs.select(F.col(f"`{id}`").alias("id"), F.col(f"`{text}`").cast("string").alias("text"))

    def cut(batches):
        for batch in batches:
            for piece in packing.slices(batch, PIECE):
                x = Aligned(piece.column(1), *both(a_path, b_path)[:2])
                edge = [np.concatenate([[0], np.flatnonzero(v) + 1]) for v in x.last]
                doc = x.doc[0][x.last[0]]
                end = x.end[0][x.last[0]]
                before = np.concatenate([[0], end])[:-1]
                begin = before[np.searchsorted(doc, doc)] if len(doc) else before  # the document's first byte
                columns = {"id": piece.column(0).take(pa.array(doc)), "start": pa.array(before - begin), "end": pa.array(end - begin)}
                columns |= {c: pa.ListArray.from_arrays(pa.array(e, pa.int32()), pa.array(i, pa.int32())) for c, e, i in zip("ab", edge, x.ids)}
                yield pa.RecordBatch.from_pydict(columns)

    return rows.mapInArrow(cut, f"id {rows.schema['id'].dataType.simpleString()}, start bigint, end bigint, a array<int>, b array<int>")
