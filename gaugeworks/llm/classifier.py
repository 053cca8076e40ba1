"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, calibrated probabilities.

A token is a run of letters and digits (case kept), or a run of one other kind of character between spaces. Every token
has a fixed sparse random index vector made from its hash; the vector of a word is the sum of the index vectors of its
neighbours over the training texts. A word outside the vocabulary is told by its shape (case, digits, script, length),
and shapes have vectors of their own. A document is the mean of its tokens' vectors. A two-layer numpy network maps it to
a logit, which a temperature, fitted on training rows the network has not seen, turns into a probability.

Training takes at most about `sample` labelled rows and `vocabulary` words (the two documented bounds); vectors are summed
by Spark in tasks, and what reaches the driver is bounded by these two. Scoring is one map over all documents.
"""

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeworks.llm import cells
from gaugeworks.llm.arrays import U, mix, release, span_hashes, utf8
from gaugeworks.llm.frames import bounded, kept_table, pick

SAMPLE = 20_000
VOCABULARY = 30_000
DIM = 64
NONZERO = 8
REACH = 2
HIDDEN = 24
PIECE = 1 << 18
#: 0 white space, 1 lower case, 2 upper case, 3 digits, 4 beyond ASCII, 5 other
KIND = np.full(256, 5, np.uint8)
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[97:123], KIND[65:91], KIND[48:58], KIND[128:] = 1, 2, 3, 4
WORD = (KIND >= 1) & (KIND <= 4)


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, shape's hash, first token of each text and their end) of all tokens in order."""
    if not len(data):
        return np.zeros(0, U), np.zeros(0, U), np.zeros(len(offsets), np.int64)
    group = np.where(WORD[data], 1, np.where(KIND[data] == 0, 0, 2)).astype(np.int8)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = group[1:] != group[:-1]
    cut[1:-1] |= (group[1:] == 2) & (data[1:] != data[:-1])
    cut[offsets] = True
    at = np.flatnonzero(cut)
    s, e = at[:-1], at[1:]
    solid = group[s] > 0
    s, e = s[solid], e[solid]
    h = span_hashes(data, s, e)
    kind = KIND[data]
    upper, digit, wide = (np.add.reduceat((kind == j).astype(np.int32), at[:-1])[solid] for j in (2, 3, 4))
    size = e - s
    first = KIND[data[s]]
    code = (first == 5) * 64 + np.where(upper == 0, 0, np.where(upper == size, 3, np.where((upper == 1) & (first == 2), 1, 2))) * 16 + (digit > 0) * 8 + (wide > 0) * 4 + np.digitize(size, [4, 8, 16])
    return h, mix(code.astype(U) + U(0x5BD1E995)), np.searchsorted(s, offsets)


def index_vectors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, signs) of the non-zero entries of every hash's index vector."""
    out = np.stack([mix(h + U(k * 0x632BE59BD9B4E019 & (1 << 64) - 1)) for k in range(1, NONZERO + 1)], 1)
    return (out % U(DIM)).astype(np.int32), np.where(out >> U(63), np.float32(1), np.float32(-1))


def known_rows(h: np.ndarray, shape: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Row of every token in the ascending table of words and shapes; -1 where not even the shape is there."""
    at = np.searchsorted(words, h)
    at[at == len(words)] = 0
    hit = words[at] == h if len(words) else np.zeros(len(h), bool)
    by = np.searchsorted(words, shape)
    by[by == len(words)] = 0
    fall = np.where(words[by] == shape, by, -1) if len(words) else np.full(len(h), -1)
    return np.where(hit, at, fall)


def add_contexts(h, shape, edges, words, out: np.ndarray) -> None:
    """Add the index vectors of all neighbours within reach to the rows of `words` in `out`, a flat table. Whole numbers
    below 2 ** 24, so that single precision is exact."""
    row = known_rows(h, shape, words)
    of = np.repeat(np.arange(len(edges) - 1), np.diff(edges))
    place, sign = index_vectors(h)
    for d in range(1, REACH + 1):
        ok = of[d:] == of[:-d]
        for to, frm in ((slice(d, None), slice(None, -d)), (slice(None, -d), slice(d, None))):
            r = row[to]
            good = ok & (r >= 0)
            np.add.at(out, ((r[good] * DIM)[:, None] + place[frm][good]).ravel(), sign[frm][good].ravel())


class Model:
    """Ascending word hashes, each word's share in every hidden unit, the rest of the network, and the temperature."""

    def __init__(self, words, hidden, bias, out, out_bias, temperature):
        self.words, self.hidden, self.bias, self.out, self.out_bias, self.temperature = words, hidden.astype(np.float32), bias, out, out_bias, temperature

    def scores(self, texts) -> np.ndarray:
        data, offsets = utf8(texts)
        parts = []
        for a, b in cells.piece_edges(offsets, PIECE):
            o = offsets[a]
            h, shape, edges = tokens(data[o : offsets[b]], offsets[a : b + 1] - o)
            parts.append(means(self.hidden, known_rows(h, shape, self.words), edges))
        x = np.concatenate(parts) if parts else np.zeros((0, len(self.bias)))
        logit = np.tanh(x + self.bias) @ self.out + self.out_bias
        return 1 / (1 + np.exp(-np.clip(logit / self.temperature, -30, 30)))


def means(table: np.ndarray, row: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Mean of the rows of every text; zero for a text without known tokens."""
    n = np.diff(edges)
    out = np.zeros((len(n), table.shape[1]))
    if len(row) and len(table):
        padded = np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])[row]
        full = n > 0
        out[full] = np.add.reduceat(padded, edges[:-1][full], axis=0) / n[full, None]
    return out


def fit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, vocabulary: int = VOCABULARY) -> Model:
    """Learn from the rows of `docs` that `labels` marks 0 or 1; rows with a null id, text or label are left out, a text
    labelled more than once takes the label it has more often. Without rows of both labels every score is the share of
    ones (0.5 without any)."""
    spark = docs.sparkSession
    y = pick(labels, id=id, y=label).where("id is not null and y in (0, 1)").groupBy("id").agg((F.avg("y") >= 0.5).cast("int").alias("y"))
    y = F.broadcast(bounded(y, "id", sample))  # at most about `sample` rows
    rows = kept_table(pick(docs, id=id, text=text).where("text is not null").join(y, "id").select(F.xxhash64(F.col("id").cast("string")).alias("key"), F.col("text").cast("string").alias("text"), "y"), "labelled")
    rows = rows.coalesce(8)

    def words_in(batches):
        for b in batches:
            data, offsets = utf8(b.column(1))
            for x, z in cells.piece_edges(offsets, PIECE):
                h, shape, _ = tokens(data[offsets[x] : offsets[z]], offsets[x : z + 1] - offsets[x])
                u, n = np.unique(np.concatenate([h, shape]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"h": pa.array(u.view(np.int64)), "n": pa.array(n)})
        release()

    top = rows.mapInArrow(words_in, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where("n >= 5").orderBy(F.desc("n"), "h").limit(vocabulary)
    words = np.sort(np.array([r.h for r in top.select("h").collect()], np.int64).view(U))
    shared = spark.sparkContext.broadcast(words)

    def contexts(batches):
        total = np.zeros(len(shared.value) * DIM, np.float32)
        for b in batches:
            data, offsets = utf8(b.column(1))
            for x, z in cells.piece_edges(offsets, PIECE):
                add_contexts(*tokens(data[offsets[x] : offsets[z]], offsets[x : z + 1] - offsets[x]), shared.value, total)
        step = 4096
        for k in range(0, len(shared.value), step):
            yield pa.RecordBatch.from_pydict({"k": pa.array([k], pa.int64()), "v": pa.array([total[k * DIM : (k + step) * DIM].astype(float).tobytes()], pa.binary())})
        del total
        release()

    def add(key, table):
        return pa.table({"k": pa.array([key[0].as_py()], pa.int64()), "v": pa.array([sum(np.frombuffer(v, float) for v in table["v"].to_pylist()).tobytes()], pa.binary())})

    sums = rows.mapInArrow(contexts, "k bigint, v binary").groupBy("k").applyInArrow(add, "k bigint, v binary").orderBy("k").collect()
    vectors = np.concatenate([np.frombuffer(r.v, float).reshape(-1, DIM) for r in sums]) if sums else np.zeros((0, DIM))
    vectors = np.sign(vectors) * np.log1p(np.abs(vectors))
    vectors -= vectors.mean(0) if len(vectors) else 0
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True) + 1e-9
    table = spark.sparkContext.broadcast(vectors.astype(np.float32))

    def pooled(batches):
        for b in batches:
            data, offsets = utf8(b.column(1))
            for x, z in cells.piece_edges(offsets, PIECE):
                h, shape, edges = tokens(data[offsets[x] : offsets[z]], offsets[x : z + 1] - offsets[x])
                m = means(table.value, known_rows(h, shape, shared.value), edges)
                yield pa.RecordBatch.from_pydict({"key": b.column(0).slice(x, z - x), "y": b.column(2).slice(x, z - x), "x": pa.array([v.astype(np.float32).tobytes() for v in m], pa.binary())})
        release()

    got = rows.mapInArrow(pooled, "key bigint, y int, x binary").orderBy("key", "x").collect()
    x = np.stack([np.frombuffer(r.x, np.float32) for r in got]).astype(float) if got else np.zeros((0, DIM))
    return train(words, vectors, x, np.array([r.y for r in got], float), np.array([r.key for r in got], np.int64))


def train(words: np.ndarray, vectors: np.ndarray, x: np.ndarray, y: np.ndarray, key: np.ndarray, epochs: int = 60, seed: int = 7) -> Model:
    """The network by Adam on four fifths of the rows, the temperature on the rest."""
    if len(set(y.tolist())) < 2:
        p = y.mean() if len(y) else 0.5
        return Model(words, np.zeros((len(words), 1)), np.zeros(1), np.zeros(1), float(np.log((p + 1e-6) / (1 - p + 1e-6))), 1.0)
    mean, std = x.mean(0), x.std(0) + 1e-6
    held = (key % 5 == 0) if 0 < (key % 5 == 0).sum() < len(key) else np.zeros(len(key), bool)
    rng = np.random.default_rng(seed)
    p = [rng.normal(0, 1 / np.sqrt(DIM), (DIM, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v, t = [np.zeros_like(w) for w in p], [np.zeros_like(w) for w in p], 0
    z, target = ((x - mean) / std)[~held], y[~held]
    for _ in range(epochs):
        order = rng.permutation(len(z))
        for i in range(0, len(z), 256):
            a, b = z[order[i : i + 256]], target[order[i : i + 256]]
            hidden = np.tanh(a @ p[0] + p[1])
            g = (1 / (1 + np.exp(-np.clip(hidden @ p[2] + p[3], -30, 30))) - b) / len(b)
            back = np.outer(g, p[2]) * (1 - hidden**2)
            t += 1
            for k, w in enumerate((a.T @ back + 1e-5 * p[0], back.sum(0), hidden.T @ g + 1e-5 * p[2], np.array([g.sum()]))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * w, 0.999 * v[k] + 0.001 * w * w
                p[k] = p[k] - 0.003 * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
    temperature = 1.0
    if held.any():
        logit = np.tanh(((x - mean) / std)[held] @ p[0] + p[1]) @ p[2] + p[3]
        loss = lambda s: float(np.mean(np.logaddexp(0, -np.where(y[held] > 0, 1, -1) * logit / s)))
        temperature = min(np.geomspace(0.3, 8, 60), key=loss)
    return Model(words, vectors @ (p[0] / std[:, None]), p[1] - (mean / std) @ p[0], p[2], float(p[3][0]), float(temperature))


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of `docs` with `_score`, the calibrated probability of label 1; null and empty texts get the score of a
    text without tokens. All columns stay; one called `_score` is replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def judge(texts: pd.Series) -> pd.Series:
        out = pd.Series(shared.value.scores(pa.array(texts, pa.string(), from_pandas=True)))
        release()
        return out

    return docs.withColumn("_score", judge(F.col(f"`{text}`").cast("string")))
