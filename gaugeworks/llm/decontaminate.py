"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows, text scanned once.

Texts are normalised alike: A-Z lowered, everything that is neither an ASCII letter or digit nor beyond ASCII taken for
a gap, gaps made one space. The automaton holds every window of `words` successive words of a benchmark item (an item
with fewer, but not none, is one window), with a space at both ends, so that a hit always begins and ends at word
edges. Each text passes through it once; hits are counted in words and mapped back to code points of the original.

The automaton is built from the distinct windows only. They are counted first: more than `per_automaton` of them are
dealt by hash over several automata, each scanned in turn. The driver and every Python worker hold all of
them, so memory grows with the benchmark.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeworks.llm.frames import pick

WORDS = 13
PER_AUTOMATON = 40_000
#: A-Z lowered; every ASCII byte that is no letter or digit becomes a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normal_words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(FOLD).split()


def windows_of(words: list[bytes], size: int) -> list[str]:
    """Windows as strings of one character per byte, a space at both ends."""
    if not words:
        return []
    return [(b" " + b" ".join(words[i : i + size]) + b" ").decode("latin-1") for i in range(max(1, len(words) - size + 1))]


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", words: int = WORDS) -> DataFrame:
    """(window, items) of all benchmark texts; items are the ids as strings. Null texts and items have none."""

    def cut(batches):
        for b in batches:
            found = [(w, i) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if i is not None for w in dict.fromkeys(windows_of(normal_words(t), words))]
            yield pa.RecordBatch.from_pydict({"window": pa.array([w for w, _ in found], pa.string()), "item": pa.array([i for _, i in found], pa.string())})

    rows = pick(benchmark, i=item, t=text).select(F.col("i").cast("string"), F.col("t").cast("string")).mapInArrow(cut, "window string, item string")
    return rows.groupBy("window").agg(F.sort_array(F.collect_set("item")).alias("items"))


def automaton(entries: list[tuple[str, list[str]]]):
    import ahocorasick

    a = ahocorasick.Automaton()
    for window, items in entries:
        a.add_word(window, (len(window), tuple(items)))
    if entries:
        a.make_automaton()
    return a


def scan(text: str | None, machines: list) -> tuple[int, int, list[str], list[tuple[int, int]]]:
    """(words, words hit, items, spans of hit words in code points) of one text."""
    data = (text or "").encode().translate(FOLD)
    words = data.split()
    if not words:
        return 0, 0, [], []
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    found = [(end + 1 - n, end, items) for a in machines if len(a) for end, (n, items) in a.iter(line)]
    if not found:
        return len(words), 0, [], []
    gaps = np.flatnonzero(np.frombuffer(line.encode("latin-1"), np.uint8) == 32)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, np.searchsorted(gaps, [s for s, _, _ in found]), 1)
    np.add.at(edge, np.searchsorted(gaps, [e for _, e, _ in found]), -1)
    hit = np.cumsum(edge[:-1]) > 0
    raw = np.frombuffer(data, np.uint8)
    solid = np.concatenate([[False], raw != 32, [False]])
    starts, ends = np.flatnonzero(solid[1:] & ~solid[:-1]), np.flatnonzero(solid[:-1] & ~solid[1:])
    chars = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    flags = np.concatenate([[False], hit, [False]])
    first, last = np.flatnonzero(flags[1:] & ~flags[:-1]), np.flatnonzero(flags[:-1] & ~flags[1:]) - 1
    spans = list(zip(chars[starts[first]].tolist(), chars[ends[last]].tolist()))
    return len(words), int(hit.sum()), sorted({i for _, _, items in found for i in items}), spans


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", item_text: str = "text", words: int = WORDS, share: float = 0.05, per_automaton: int = PER_AUTOMATON) -> DataFrame:
    """Every row of `docs` with `_scan` = (n_words, n_hit, items, spans, contaminated).

    contaminated: some word is hit and at least `share` of the words are. Spans are [start, end) in code points of the
    original text, maximal runs of hit words. Null and empty texts have no words and are clean; repeated rows are each
    judged; an empty benchmark hits nothing; item ids are told apart as strings. All columns of `docs` stay, whatever
    their names; one called `_scan` is replaced. No shuffle: documents are only read.
    """
    spark = docs.sparkSession
    windows = benchmark_windows(benchmark, item, item_text, words)
    parts = max(1, -(-windows.count() // per_automaton))
    dealt = windows.select("window", "items", F.pmod(F.xxhash64("window"), F.lit(parts)).alias("part"))
    shared = [spark.sparkContext.broadcast([(r.window, r["items"]) for r in dealt.where(F.col("part") == p).collect()]) for p in range(parts)]
    least = 1 / share
    kind = "struct<n_words:bigint,n_hit:bigint,items:array<string>,spans:array<struct<start:bigint,end:bigint>>,contaminated:boolean>"

    @F.pandas_udf(kind)
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        machines = [automaton(s.value) for s in shared]
        for b in batches:
            rows = []
            for t in b:
                n, hit, items, spans = scan(t, machines)
                rows.append((n, hit, items, [{"start": s, "end": e} for s, e in spans], hit > 0 and least * hit >= n))
            yield pd.DataFrame(rows, columns=["n_words", "n_hit", "items", "spans", "contaminated"])

    return docs.withColumn("_scan", judge(F.col(f"`{text}`").cast("string")))


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()
