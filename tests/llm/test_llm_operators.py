"""The operators against brute force, round trips and held-out accuracy, on small and on awkward rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from gaugeworks.llm import arrays, cells, classifier, decontaminate, language, lines, near, neighbours, ngrams, packing, substrings, suffixes
from gaugeworks.llm.frames import components

SF = "/root/testdata/sf0.001"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall((text or "").translate(FOLD))


@pytest.fixture(scope="module")
def texts():
    """Repeated rows, ties, null ids and texts, shared passages, lone white space, letters beyond ASCII, a long text."""
    r = random.Random(5)
    vocab = ["".join(r.choice("abcdeé") for _ in range(r.randint(1, 6))) for _ in range(60)]
    prose = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, line = prose(80), "A line that many documents hold, é."
    out = [(k, prose(r.randint(0, 120)) + "\n" + (line if k % 3 == 0 else "own " + prose(3)) + "\n" + (passage if k % 7 == 0 else "")) for k in range(60)]
    copy = out[5][1]
    out += [(60 + k, copy) for k in range(30)] + [(90 + k, copy + " " + vocab[k]) for k in range(25)]
    out += [(200, None), (201, ""), (202, " \n\t "), (203, "xy " * 30), (204, "é" * 150 + " 日本語"), (205, prose(9000)), (206, "12 34"), (None, prose(40)), (None, None), (5, out[5][1]), (5, out[5][1]), (7, "another text with the id of another")]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", None, "fr"][k % 3], "x", k, "clash", 1.0, k) for k, (i, t) in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, id string, block int, node string, d double, _row int")
    return df.repartition(3)


def nothing(docs):
    return docs.where("false")


def bag(rows):
    return Counter(tuple(r) for r in rows)


# --- arrays and cells


def test_hashes_do_not_depend_on_the_place():
    data = np.frombuffer(b"one two one  two\tone", np.uint8)
    s, e = arrays.runs(data, np.array([0, len(data)]), arrays.byte_class("nospace"))
    h = arrays.span_hashes(data, s, e)
    assert h[0] == h[2] == h[4] and h[1] == h[3] and h[0] != h[1]
    items = np.tile(h[:3], 200_000)
    w = arrays.run_hashes(items, 4)
    assert len(np.unique(w)) == 3 and len(w) == len(items) - 3


def test_packed_hashes_come_back():
    for n in (0, 1, 2, 1000):
        h = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n).astype(np.uint64) * np.uint64(2))
        assert np.array_equal(arrays.unpack_sorted(arrays.pack_sorted(h)), h)


def test_components(spark):
    r = random.Random(3)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(200)] + [(k, k + 1) for k in range(400, 460)] + [(9, 9), (None, 3)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((find(a), find(b)))
            root[b] = a
    got = {x.node: x.root for x in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: find(k) for k in root}


# --- 1 n-gram Jaccard join


def expected_classes(texts, n=5, least=0.8):
    sets = [frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if (w := words(t)) else frozenset() for _, t in texts]
    groups = defaultdict(list)
    for k, s in enumerate(sets):
        groups[s].append(k)
    keys = [k for k in groups if k]
    link = [[x for x in range(len(keys)) if x != y and len(keys[x] & keys[y]) >= least * len(keys[x] | keys[y])] for y in range(len(keys))]
    root = list(range(len(keys)))
    moved = True
    while moved:
        moved = False
        for y, l in enumerate(link):
            m = min([root[y], *(root[x] for x in l)])
            moved |= m != root[y]
            root[y] = m
    ids = defaultdict(list)
    for y, k in enumerate(keys):
        ids[root[y]] += [texts[m][0] for m in groups[k] if texts[m][0] is not None]
    out = [(i, i, 0, 0) for (i, t), s in zip(texts, sets) if not s]
    for y, k in enumerate(keys):
        for m in groups[k]:
            out.append((texts[m][0], min(ids[root[y]], default=None), len(groups[k]) - 1 + sum(len(groups[keys[x]]) for x in link[y]), len(link[y])))
    return Counter(out)


@pytest.mark.parametrize("few,block", [(16, 256), (2, 8)])
def test_near_classes(docs, texts, few, block):
    assert bag(near.near_classes(docs, few=few, block=block).collect()) == expected_classes(texts)


def test_near_classes_of_nothing(docs):
    assert near.near_classes(nothing(docs)).collect() == []


def test_prefix_is_shortened_to_the_recall():
    k = near.depth_for(0.8, 32, 0.999999)
    assert 1 - (1 - 0.8**k) ** 32 >= 0.999999 > 1 - (1 - 0.8 ** (k + 1)) ** 32


# --- 2 language-model scores


@pytest.mark.parametrize("order,least", [(1, 2), (2, 2), (3, 2), (4, 1)])
def test_stupid_backoff(docs, texts, order, least):
    all_words = [words(t) for _, t in texts]
    counts = Counter(tuple(w[i : i + n]) for w in all_words for n in range(1, order + 1) for i in range(len(w) - n + 1))
    total = sum(map(len, all_words))

    def score(w):
        s = 0.0
        for i in range(len(w)):
            for k, n in enumerate(range(min(order, i + 1), 0, -1)):
                g = tuple(w[i - n + 1 : i + 1])
                if n == 1 or counts[g] >= least:
                    s += k * np.log(0.4) + np.log(counts[g] / (counts[g[:-1]] if n > 1 else total))
                    break
        return round(s, 5)

    got = Counter((r.id, r.n_words, round(r.score, 5)) for r in ngrams.stupid_backoff(docs, order=order, least=least).collect())
    assert got == Counter((i, len(w), score(w)) for (i, _), w in zip(texts, all_words))
    assert ngrams.stupid_backoff(nothing(docs)).collect() == []


# --- 3 language


def test_language(spark, docs, texts):
    d = spark.read.parquet(f"{SF}/documents.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2
    model = language.fit(d.where(~held))
    got = language.identify(d.where(held), model).select("lang", "_language").collect()
    assert np.mean([r.lang == r._language.lang for r in got]) > 0.95
    rows = language.identify(docs, model).collect()
    assert len(rows) == len(texts) and set(rows[0].asDict()) == set(docs.columns) | {"_language"}
    for r in rows:
        letter = any(c.isalpha() for c in r.text or "")
        assert (r._language.lang == "und") == (not letter) and 0 <= r._language.score <= 1
    none = language.fit(nothing(docs))
    assert {r._language.lang for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(nothing(docs), model).collect() == []


# --- 4 packing


def test_packing_round_trip(docs, texts):
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(TOKENIZER)
    model.encode_special_tokens = True
    rows = packing.pack(docs.withColumn("sequence_id", F.lit(1)), TOKENIZER).collect()
    whole = defaultdict(dict)
    for r in rows:
        assert len(r.tokens) == r.length == r.bucket and r.length & (r.length - 1) == 0 and r.length <= 1024 and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.tokens, "<u4").tobytes())
        whole[r.id].setdefault(r.start, []).append(r.tokens)
    assert len({r.sequence_id for r in rows}) == len(rows)
    for i, t in {i: t for i, t in texts if [x for x, _ in texts].count(i) == 1}.items():
        ids = [x for _, p in sorted(whole[i].items()) for x in p[0]]
        assert ids == model.encode(t or "", add_special_tokens=False).ids + [0]
    assert sum(r.length for r in rows) == sum(len(model.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in texts)
    assert packing.pack(nothing(docs), TOKENIZER).collect() == []


def test_parts_have_the_ids_of_the_whole():
    from tokenizers import Tokenizer

    r = random.Random(1)
    model = Tokenizer.from_file(TOKENIZER)
    model.encode_special_tokens = True
    bits = ["a", "B", "é", "1", " ", "\n", ",", "'s", "'", "ll", " the", "\t", " ", " ", "日", "!", "$%", "\r\n", "<|endoftext|>", "\x1c", "́"]
    made = ["".join(r.choice(bits) for _ in range(r.randint(0, 14))) for _ in range(3000)]
    ids, n = packing.Ids(TOKENIZER, parts=500).of(pa.array(made))
    want = [e.ids for e in model.encode_batch(made, add_special_tokens=False)]
    assert n.tolist() == [len(w) for w in want] and ids.tolist() == [x for w in want for x in w]


# --- 5 nearest neighbours


def test_neighbours(spark):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(700, 16)), np.tile(r.normal(size=(1, 16)), (300, 1)), r.normal(size=(200, 16)) * 0.01 + 3]).astype(np.float32)
    odd = [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] * 16), (2004, [None] + [1.0] * 15), (2005, [1.0] * 3), (2006, [float("inf")] * 16), (None, [1.0] * 16)]
    df = spark.createDataFrame([(k, v.tolist(), "clash", 0.0) for k, v in enumerate(x)] + [(i, v, "clash", 0.0) for i, v in odd], "vec_id long, embedding array<float>, node string, d double")
    v = neighbours.usable(df.unionByName(df.limit(3)))
    got = neighbours.search(v, v.where(F.pmod("id", F.lit(20)) == 0).select("id")).collect()
    by = defaultdict(list)
    for g in sorted(got, key=lambda g: (g.query_id, g.rank)):
        by[g.query_id].append(g)
    y, hit = x.astype(float), 0
    for q in range(0, len(x), 20):
        d = np.sqrt(((y - y[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(len(d)), d))[:10]
        assert [g.rank for g in by[q]] == list(range(1, 11)) and all(g.score == d[g.vec_id] for g in by[q])
        hit += len(set(best) & {g.vec_id for g in by[q]})
    assert hit >= 0.9 * 10 * len(by) and len(by) == len(range(0, len(x), 20))
    few = neighbours.usable(df.where("vec_id < 4"))
    assert len(neighbours.search(few, few.select("id")).collect()) == 12
    none = neighbours.usable(nothing(df))
    assert neighbours.search(none, none.select("id")).collect() == []


def test_neighbours_in_a_dense_cluster(spark):
    """A cluster that no plane divides: its leaf is cut in other parts in every tree, so the parts grow together."""
    r = np.random.default_rng(4)
    x = np.concatenate([r.normal(size=(1, 16)) + r.normal(size=(1500, 16)) * 1e-4, r.normal(size=(300, 16))]).astype(np.float32)
    v = neighbours.usable(spark.createDataFrame([(k, y.tolist()) for k, y in enumerate(x)], "vec_id long, embedding array<float>"))
    by = defaultdict(set)
    for g in neighbours.search(v, v.where("id < 1500 and id % 30 = 0").select("id")).collect():
        by[g.query_id].add(g.vec_id)
    y, hit = x.astype(float), 0
    for q in range(0, 1500, 30):
        d = ((y - y[q]) ** 2).sum(1)
        d[q] = np.inf
        hit += len(set(np.argsort(d, kind="stable")[:10].tolist()) & by[q])
    assert hit >= 0.9 * 10 * 50


def test_nearest_pairs_count_once_and_are_cut_before_the_shuffle(spark):
    edges = spark.createDataFrame([(1, v % 40, float(v % 40)) for v in range(200)] + [(2, 1, 0.5)], "u long, v long, d double")
    ranked = neighbours.nearest(edges, 5)
    got = {r.u: [(e.d, e.v) for e in r.near] for r in ranked.collect()}
    assert got == {1: [(float(v), v) for v in range(5)], 2: [(0.5, 1)]}
    assert "WindowGroupLimit" in ranked._jdf.queryExecution().toString()


def test_neighbours_of_an_outlier(spark):
    """Alone in its leaf in every tree, it has first neighbours all the same; the exact pass gives what brute force gives."""
    r = np.random.default_rng(6)
    x = np.concatenate([np.eye(1, 16) + r.normal(size=(300, 16)) * 0.01, -np.eye(1, 16)]).astype(np.float32)
    v = neighbours.usable(spark.createDataFrame([(k, y.tolist()) for k, y in enumerate(x)], "vec_id long, embedding array<float>"))
    d = np.sqrt(((x.astype(float) - x[300].astype(float)) ** 2).sum(1))
    got = {g.rank: g.vec_id for g in neighbours.search(v, v.where("id = 300").select("id")).collect()}
    assert sorted(got) == list(range(1, 11)) and len(set(got.values()) & set(np.argsort(d[:300])[:10].tolist())) >= 8
    nodes = v.select("id", "vec")
    pool = neighbours.exact(nodes, nodes.where("id = 300").select(F.col("id").alias("s"), F.col("vec").alias("sv")), "<f4", 11).first().pool
    assert [p.v for p in pool] == np.argsort(d, kind="stable")[:11].tolist()


# --- 6 decontamination


def test_decontamination(spark, docs, texts):
    items = [("a", " ".join(words(texts[7][1])[:20])), ("b", "Own!! ANOTHER, text... with the ID"), ("c", None), ("d", " ?! "), (None, "x"), ("e", texts[14][1]), ("e", texts[14][1])]
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id string, text string, window string")
    size = 13
    for per in (40_000, 5):
        for r in decontaminate.decontaminate(docs, bench, per_automaton=per).collect():
            w, hit, who = words(r.text), set(), set()
            for i, t in items:
                v = words(t)
                if i is None or not v:
                    continue
                for k in range(max(1, len(v) - size + 1)):
                    p = v[k : k + size]
                    for j in range(len(w) - len(p) + 1):
                        if w[j : j + len(p)] == p:
                            hit |= set(range(j, j + len(p)))
                            who.add(i)
            s = r._scan
            assert (s.n_words, s.n_hit, s["items"], s.contaminated) == (len(w), len(hit), sorted(who), bool(hit) and 20 * len(hit) >= len(w))
            assert [x for a in s.spans for x in words(r.text[a.start : a.end])] == [w[k] for k in sorted(hit)]
    assert {r._scan.n_hit for r in decontaminate.decontaminate(docs, nothing(bench)).collect()} == {0}
    assert decontaminate.decontaminate(nothing(docs), bench).collect() == []


# --- 7 line dedup


def line_key(x):
    return x.strip(" \t\n\x0b\x0c\r").translate(FOLD)


def kept_lines(texts, least_docs=3, least_chars=20):
    held = defaultdict(list)
    for i, t in texts:
        for k in {line_key(x) for x in (t or "").split("\n")}:
            if len(k) >= least_chars:
                held[k].append(i)
    out = []
    for i, t in texts:
        ls = (t or "").split("\n")
        last = {k: max((x for x in v if x is not None), default=None) for k, v in held.items() if len(v) >= least_docs}
        keep = [x for x in ls if line_key(x) not in last or last[line_key(x)] is None or (i is not None and i >= last[line_key(x)])]
        out.append((i, len(ls), len(ls) - len(keep), "\n".join(keep)))
    return Counter(out)


@pytest.mark.parametrize("batches,fanout", [(1, 4), (5, 2)])
def test_line_dedup(spark, docs, texts, batches, fanout):
    runs = lines.LineRuns(spark, fanout=fanout)
    got = lines.dedup_lines(docs, batches=batches, runs=runs)
    assert got.columns == [*docs.columns, "_lines"]
    assert bag((r.doc_id, *r._lines) for r in got.collect()) == kept_lines(texts)
    assert all(len(level) < fanout for level in runs.levels)


def test_line_runs_give_what_no_earlier_batch_held(spark):
    first = spark.createDataFrame([(1, "a line of more than twenty\nshort"), (2, None)], "doc_id long, text string")
    later = spark.createDataFrame([(3, "A line of more than TWENTY \nanother line of more than twenty")], "doc_id long, text string")
    runs = lines.LineRuns(spark, fanout=2)
    assert runs.fresh(first).count() == 1
    for _ in range(3):
        runs.add(first)
    assert [len(x) for x in runs.levels] == [1, 1] and runs.fresh(first).count() == 0
    assert [bytes(r.mark).hex() for r in runs.fresh(later).collect()] == [hashlib.md5(b"another line of more than twenty").hexdigest()]
    assert lines.merged(runs.held()).first().docs == 3
    assert lines.dedup_lines(nothing(first)).collect() == []


# --- 8 suffix-array dedup


def later_copies(texts, n):
    seen, out = set(), []
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0, (x[1] or "").encode())):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if b[k : k + n] in seen:
                gone[k : k + n] = b"\1" * n
            seen.add(b[k : k + n])
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out.append((i, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return Counter(out)


@pytest.mark.parametrize("n,blocks", [(100, None), (40, 5), (12, 7)])
def test_suffix_array_dedup(docs, texts, n, blocks, monkeypatch):
    if blocks:
        monkeypatch.setattr(cells, "block_count", lambda *a: blocks)
    got = suffixes.remove_later_copies(docs, length=n).collect()
    assert Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == later_copies(texts, n)
    assert suffixes.remove_later_copies(nothing(docs)).collect() == []


def test_suffix_array_dedup_of_hot_anchors(docs, texts, monkeypatch):
    """Extents around one anchor of a passage in many documents don't meet in one group; the result stays the same."""
    ends = np.arange(2000, dtype=np.uint64)
    bodies = [[b"ask", arrays.pack_sorted(np.full(500, 7, np.uint64)), ends[k : k + 500].tobytes()] for k in range(0, 2000, 500)]
    said = np.frombuffer(b"".join(suffixes.judge(np.arange(4), bodies)), np.uint8)
    assert not (said == suffixes.TIED).any()
    monkeypatch.setattr(cells, "block_count", lambda *a: 5)
    got = suffixes.remove_later_copies(docs, length=40, hot=1).collect()
    assert Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got) == later_copies(texts, 40)


# --- 9 substring dedup


@pytest.mark.parametrize("n,blocks", [(35, None), (35, 4), (6, 3), (2, 2), (1, 2)])
def test_substring_dedup(docs, texts, n, blocks, monkeypatch):
    if blocks:
        monkeypatch.setattr(cells, "block_count", lambda *a: blocks)
    split = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts]
    count = Counter(tuple(w[k : k + n]) for _, w in split for k in range(len(w) - n + 1))
    want = Counter()
    for i, w in split:
        gone = {p for k in range(len(w) - n + 1) if count[tuple(w[k : k + n])] > 1 for p in range(k, k + n)}
        want[i, len(w), len(gone), " ".join(x for p, x in enumerate(w) if p not in gone)] += 1
    assert bag(substrings.remove_repeats(docs, window=n).collect()) == want
    assert substrings.remove_repeats(nothing(docs)).collect() == []


@pytest.mark.parametrize("period", substrings.COVERS)
def test_covers_have_every_difference(period):
    d = substrings.COVERS[period]
    assert {(a - b) % period for a in d for b in d} == set(range(period))


# --- 10 quality classifier


def test_quality(spark, docs, texts):
    d, y = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    odd = spark.createDataFrame([(None, 1, 0), (3, None, 0), (4, 7, 0)], "doc_id long, quality int, toxic int")
    model = classifier.fit(d, y.where(~held).unionByName(odd))
    got = classifier.score(d, model).join(y.where(held), "doc_id").select("_score", "quality").collect()
    assert np.mean([(r._score >= 0.3) == (r.quality == 1) for r in got]) > 0.9
    rows = classifier.score(docs, model).collect()
    assert len(rows) == len(texts) and all(0 <= r._score <= 1 for r in rows) and set(rows[0].asDict()) == set(docs.columns) | {"_score"}
    assert len({r._score for r in rows if not (r.text or "").strip()}) == 1
    flat = classifier.fit(nothing(d), y)
    assert {round(r._score, 6) for r in classifier.score(docs, flat).collect()} == {0.5}
    assert classifier.score(nothing(docs), model).collect() == []
