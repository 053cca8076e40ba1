"""Language identification, word first: known words by their per-language log frequency, the rest by character n-grams.

A word the model knows adds its log frequency in every language. A word it does not know is read character by character:
at every position the longest known n-gram that starts there (five characters, else four, down to one) adds its log
frequency, less a penalty for every character it is shorter; the mean over the positions stands for the word. The
language with the largest sum wins.

Counts come from at most about `sample` labelled rows, tables keep the `vocabulary` most frequent words and as many
n-grams of each length (the documented bounds of the model). Counting is a grouped sum in Spark over rows pre-aggregated
per batch; the driver gets the bounded tables only. Prediction is one map over all documents.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from gaugeworks.llm import cells
from gaugeworks.llm.arrays import U, byte_class, in_sorted, lower_ascii, mix, runs, span_hashes, utf8
from gaugeworks.llm.frames import bounded, pick

SAMPLE = 20_000
VOCABULARY = 100_000
LONGEST = 5
PENALTY = 0.7
LEAST = 2
PIECE = 1 << 20
UNKNOWN = "und"


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each text and their end) of the words of lower-cased bytes, numbers left out."""
    s, e = runs(data, offsets, byte_class("alnum"))
    digit = (data >= 48) & (data <= 57)
    sums = np.concatenate([[0], np.cumsum(digit)])
    real = (sums[e] - sums[s]) < (e - s)
    s, e = s[real], e[real]
    return s, e, np.searchsorted(s, offsets)


def grams(texts: list[str], longest: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Words as `_word_`: (word of each character, is a start inside the word, for n = longest .. 1 the hash of the n
    characters from there, 0 where they would leave the word)."""
    joined = "".join(f"_{t}_" for t in texts)
    c = np.frombuffer(joined.encode("utf-32-le"), np.uint32).astype(U)
    size = np.array([len(t) + 2 for t in texts], np.int64)
    of = np.repeat(np.arange(len(texts)), size)
    left = np.repeat(np.cumsum(size), size) - np.arange(len(c))
    unit = mix(c + U(0x51ED2701))
    h, out = np.zeros(len(c), U), {}
    for n in range(1, longest + 1):
        nxt = np.zeros(len(c), U)
        nxt[: len(c) - n + 1] = unit[n - 1 :]
        h = mix(h * U(0x100000001B3) + nxt + U(n))
        out[n] = np.where(left >= n, h, U(0))
    return of, left > 1, [out[n] for n in range(longest, 0, -1)]


def counted(batches, langs_at: int, longest: int):
    """Rows (kind, h, lang, n): kind 0 for words, n for n-grams, summed per batch piece."""
    for b in batches:
        langs = b.column(langs_at).to_pylist()
        data, offsets = utf8(b.column(0))
        data = lower_ascii(data)
        for lang in dict.fromkeys(langs):
            pick_rows = [k for k, x in enumerate(langs) if x == lang]
            part = np.concatenate([data[offsets[k] : offsets[k + 1]] for k in pick_rows])
            po = np.concatenate([[0], np.cumsum([offsets[k + 1] - offsets[k] for k in pick_rows])])
            for x, z in cells.piece_edges(po, PIECE):
                d = part[po[x] : po[z]]
                s, e, _ = words(d, po[x : z + 1] - po[x])
                if not len(s):
                    continue
                u, at, n = np.unique(span_hashes(d, s, e), return_index=True, return_counts=True)
                raw = d.tobytes()
                of, start, hs = grams([raw[i:j].decode("utf-8", "replace") for i, j in zip(s[at].tolist(), e[at].tolist())], longest)
                tables = [(0, u, n)]
                for k, h in zip(range(longest, 0, -1), hs):
                    ok = start & (h != 0)
                    g, back = np.unique(h[ok], return_inverse=True)
                    tables.append((k, g, np.bincount(back, weights=n[of[ok]], minlength=len(g)).astype(np.int64)))
                for kind, g, m in tables:
                    yield pa.RecordBatch.from_pydict({"kind": pa.array([kind] * len(g), pa.int32()), "h": pa.array(g.view(np.int64)), "lang": pa.array([lang] * len(g), pa.string()), "n": pa.array(m.astype(np.int64))})


class Model:
    """Languages, and for words (0) and each length of n-grams (ascending hashes, log frequency per language)."""

    def __init__(self, langs: list[str], tables: dict[int, tuple[np.ndarray, np.ndarray]], longest: int, penalty: float):
        self.langs, self.tables, self.longest, self.penalty = langs, tables, longest, penalty
        self.floor = min((float(t[1].min()) for t in tables.values() if len(t[1])), default=-20.0) - 1

    def unseen(self, texts: list[str]) -> np.ndarray:
        of, start, hs = grams(texts, self.longest)
        out = np.full((len(of), len(self.langs)), self.floor - self.penalty * self.longest)
        open_ = start.copy()
        for back, (n, h) in enumerate(zip(range(self.longest, 0, -1), hs)):
            table, logs = self.tables[n]
            i = np.flatnonzero(open_ & (h != 0))
            i = i[in_sorted(h[i], table)]
            out[i] = logs[np.searchsorted(table, h[i])] - self.penalty * back
            open_[i] = False
        n = np.bincount(of[start], minlength=len(texts))
        return np.stack([np.bincount(of[start], weights=out[start, k], minlength=len(texts)) for k in range(len(self.langs))], 1) / n[:, None]

    def judge(self, texts) -> tuple[list[str], np.ndarray]:
        """(language, posterior among the languages) of every text."""
        data, offsets = utf8(texts)
        low = lower_ascii(data)
        lang, score = np.full(len(offsets) - 1, -1), np.zeros(len(offsets) - 1)
        for a, b in cells.piece_edges(offsets, PIECE):
            o = offsets[a]
            d = low[o : offsets[b]]
            s, e, edges = words(d, offsets[a : b + 1] - o)
            n = np.diff(edges)
            total = np.zeros((b - a, len(self.langs)))
            if len(s) and self.langs:
                u, at, back = np.unique(span_hashes(d, s, e), return_index=True, return_inverse=True)
                table, logs = self.tables[0]
                hit = in_sorted(u, table)
                each = np.empty((len(u), len(self.langs)))
                each[hit] = logs[np.searchsorted(table, u[hit])]
                if (~hit).any():
                    raw = d.tobytes()
                    each[~hit] = self.unseen([raw[i:j].decode("utf-8", "replace") for i, j in zip(s[at[~hit]].tolist(), e[at[~hit]].tolist())])
                sums = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(each[back], axis=0)])
                total = sums[edges[1:]] - sums[edges[:-1]]
            best = total.argmax(1) if self.langs else np.zeros(b - a, int)
            post = np.exp(total - total.max(1, keepdims=True)) if self.langs else np.zeros((b - a, 1))
            post = post.max(1) / post.sum(1) if self.langs else np.zeros(b - a)
            letters = has_letter(d, offsets[a : b + 1] - o) if self.langs else np.zeros(b - a, bool)
            lang[a:b] = np.where(letters, best, -1)
            score[a:b] = np.where(letters, np.where(n > 0, post, 1 / max(1, len(self.langs))), 0.0)
        return [self.langs[k] if k >= 0 else UNKNOWN for k in lang.tolist()], score


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Which texts (lower-cased) have a letter of any script."""
    sums = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122))])
    out = sums[offsets[1:]] > sums[offsets[:-1]]
    for k in np.flatnonzero(~out):
        out[k] = any(ch.isalpha() for ch in data[offsets[k] : offsets[k + 1]].tobytes().decode("utf-8", "replace"))
    return out


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", sample: int = SAMPLE, vocabulary: int = VOCABULARY, longest: int = LONGEST, least: int = LEAST) -> Model:
    """Learn from rows with a text and a language; without any, every text gets `und`."""
    rows = bounded(pick(docs, text=text, lang=lang, key=key).where("text is not null and lang is not null"), "key", sample)
    rows = rows.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counts = rows.mapInArrow(lambda it: counted(it, 1, longest), "kind int, h bigint, lang string, n bigint").groupBy("kind", "h").agg(F.sum("n").alias("total"), F.collect_list(F.struct("lang", "n")).alias("by"))
    top = counts.where(F.col("total") >= least).withColumn("place", F.row_number().over(Window.partitionBy("kind", F.pmod("h", F.lit(16))).orderBy(F.desc("total"), "h"))).where(F.col("place") <= vocabulary // 16)
    got = top.select("kind", "h", F.explode("by").alias("b")).groupBy("kind", "h", "b.lang").agg(F.sum("b.n").alias("n")).toPandas()
    langs = sorted(got["lang"].unique().tolist())
    tables = {}
    for kind in range(longest + 1):
        part = got[got["kind"] == kind]
        u, back = np.unique(part["h"].to_numpy(np.int64).view(U), return_inverse=True)
        n = np.zeros((len(u), len(langs)))
        np.add.at(n, (back, np.searchsorted(langs, part["lang"].to_numpy(str)) if len(part) else np.zeros(0, int)), part["n"].to_numpy(float))
        tables[kind] = (u, np.log((n + 0.1) / (n.sum(0) + 0.1 * max(1, len(u)))).astype(np.float32))
    return Model(langs, tables, longest, PENALTY)


def identify(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of `docs` with `_language` = (lang, score).

    `und` with score 0 if the text is null, empty or has no letter of any script; else a learned language and its
    posterior among the learned ones (even where no word could be read). Repeated rows get equal results. All columns
    stay; one called `_language` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("struct<lang:string,score:double>")
    def judge(texts: pd.Series) -> pd.DataFrame:
        lang, score = shared.value.judge(pa.array(texts, pa.string(), from_pandas=True))
        return pd.DataFrame({"lang": lang, "score": score})

    return docs.withColumn("_language", judge(F.col(f"`{text}`").cast("string")))
