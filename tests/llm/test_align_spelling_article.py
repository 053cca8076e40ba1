"""Tokenizer alignment, spelling variants and main text against plain versions."""

import hashlib
import html
import random
import re
import zlib
from collections import Counter, defaultdict
from html.parser import HTMLParser

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from gaugeworks.llm import align, article, spelling

SF = "/root/testdata/sf0.001"
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def texts():
    """Repeated rows, null ids and texts, letters of many scripts, white space of all kinds, very long texts."""
    r = random.Random(8)
    words = ["the", "signal", "signals", "plasma", "Größe", "naïve", "日本", "x1", "don't", "été", "coeur", "pressure"]
    prose = lambda n: " ".join(r.choice(words) for _ in range(n))
    out = [(k, prose(r.randint(0, 60))) for k in range(40)] + [(k, "a copy of one text") for k in range(40, 70)]
    out += [(100, None), (101, ""), (102, " "), (103, "  two  blanks "), (104, "tab\tand\r\nline\n\n end "), (105, "▁ under"), (106, "<s> <|endoftext|> <0x41>"), (107, "é" * 300), (108, "😀   \x00 z"), (None, prose(9)), (None, None), (7, "another text with the id of another"), (109, prose(20_000)), (110, "ab" * 40_000)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, k, "clash", 1.0, "x") for k, (i, t) in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, block int, pairs string, n double, word string").repartition(3)


# --- 11 alignment


def plain_tokens(text):
    """(ids, end bytes) of both sides, or None."""
    import sentencepiece
    from tokenizers import Tokenizer

    if not text:
        return None
    one = plain_tokens.__dict__
    if "a" not in one:
        one["a"], one["b"] = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
        one["a"].encode_special_tokens = True
        keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
        one["letters"] = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in keep)}
    whole, sides = (" " + text).encode(), []
    ids = one["a"].encode(" " + text, add_special_tokens=False).ids
    sides.append((ids, [bytes(one["letters"][c] for c in one["a"].id_to_token(i)) for i in ids]))
    ids = one["b"].encode(text)
    piece = lambda i: bytes([int(one["b"].id_to_piece(i)[3:5], 16)]) if one["b"].is_byte(i) else one["b"].id_to_piece(i).replace("▁", " ").encode()
    sides.append((ids, [piece(i) for i in ids]))
    if any(b"".join(p) != whole for _, p in sides):
        return None
    out = []
    for ids, parts in sides:
        ends, at = [], 0
        for p in parts:
            at += len(p)
            ends.append(at)
        out.append((ids, ends))
    return out


def plain_alignment(texts):
    found, held = [], Counter()
    for i, t in texts:
        both = plain_tokens(t)
        if both is None:
            found.append((i, 0, 0, 0, [], ""))
            continue
        (ia, ea), (ib, eb) = both
        links, k = [], 0
        for x, (a, e) in enumerate(zip(ia, ea)):
            begin = ea[x - 1] if x else 0
            while k and (eb[k - 1] if k else 0) > begin:
                k -= 1
            while k < len(ib) and (eb[k - 1] if k else 0) < e:
                if eb[k] > begin:
                    links.append((a, ib[k]))
                k += 1
        cuts, groups, pa, pb = sorted(set(ea) & set(eb)), [], 0, 0
        for c in cuts:
            qa, qb = ea.index(c, pa) + 1, eb.index(c, pb) + 1
            groups.append(",".join(map(str, ia[pa:qa])) + "|" + ",".join(map(str, ib[pb:qb])))
            pa, pb = qa, qb
        held.update(set(links))
        found.append((i, len(ia), len(ib), len(cuts), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = defaultdict(int)
    for (a, _), n in held.items():
        best[a] = max(best[a], n)
    return Counter((i, na, nb, ng, len(links), sum(held[p] == best[p[0]] for p in links), sum(held[p] for p in links), sha) for i, na, nb, ng, links, sha in found), held, best


def test_alignment(docs, texts, monkeypatch):
    monkeypatch.setattr(align, "BLOCK_BYTES", 1 << 12)
    want, held, best = plain_alignment(texts)
    got = align.align(docs, A, B)
    assert got.columns == ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == want
    assert {(r.a, r.b): (r.n, r.best) for r in align.lexicon(docs, A, B).collect()} == {p: (n, n == best[p[0]]) for p, n in held.items()}
    assert align.align(docs.where("false"), A, B).collect() == []


def test_groups_cover_every_byte(docs, texts):
    got = defaultdict(list)
    rows = align.groups(docs.where("doc_id < 40 or doc_id > 101").where("doc_id <> 7"), A, B)
    for r in rows.collect():
        got[r.id].append((r.start, r.end, r.a, r.b))
    for i, t in texts:
        if i is not None and i != 7 and (i < 40 or i > 101):
            both = plain_tokens(t)
            spans = sorted(got.get(i, []))
            if both is None:
                assert not spans
                continue
            assert spans[0][0] == 0 and spans[-1][1] == len(t.encode()) + 1 and all(x[1] == y[0] for x, y in zip(spans, spans[1:]))
            assert [k for s in spans for k in s[2]] == both[0][0] and [k for s in spans for k in s[3]] == both[1][0]


# --- 12 spelling


def plain_variants(texts, every=199, letters=6, occurrences=5, factor=5):
    n = Counter()
    for i, t in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            n[w[: h % len(w)] + w[h % len(w) + 1 :] if h % every == 0 else w] += 1
    n = {w: c for w, c in n.items() if len(w) >= letters and c >= occurrences}
    near = defaultdict(set)
    for u in n:
        for k in range(len(u) + 1):
            cut = u[:k] + u[k + 1 :]
            if k < len(u) and cut in n:
                near[u].add(cut), near[cut].add(u)
            for c in {x for w in n for x in w}:
                if k < len(u) and (v := u[:k] + c + u[k + 1 :]) in n and v != u:
                    near[u].add(v)
    form = {}
    for u in n:
        top = min(near[u], key=lambda v: (-n[v], v), default=None)
        form[u] = top if top and n[top] >= factor * n[u] else None
    out = Counter()
    for u in n:
        root = u
        while form[root]:
            root = form[root]
        out[(u, form[u], root, n[u], len(near[u]), n[form[u]] if form[u] else None)] += 1
    return out


@pytest.fixture(scope="module")
def misspelt(spark):
    r = random.Random(4)
    base = ["pressure", "magnetic", "confinement", "größeren", "reaction", "reactions", "traction", "aaaaaa", "aaaaaaa", "aaaaaaaa", "abcabc"]
    rows = []
    for k in range(120):
        words = []
        for _ in range(60):
            w = r.choice(base[:3] * 8 + base)
            if r.random() < 0.2:
                p = r.randrange(len(w))
                w = r.choice([w[:p] + w[p + 1 :], w[:p] + r.choice("aeé") + w[p:], w[:p] + "x" + w[p + 1 :]])
            words.append(w.upper() if r.random() < 0.1 else w)
        rows.append((k if k % 9 else None, r.choice([" ", "1", "-", "\n"]).join(words)))
    return rows + [(500, None), (501, ""), (502, "123 !?"), (3, rows[3][1]), (503, "longword" * 5000)]


@pytest.mark.parametrize("limit", [20_000, 2])
def test_variants(spark, misspelt, limit):
    df = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in misspelt], "doc_id long, text string, word string, n int, side int").repartition(3)
    got = spelling.variants(df, every=7, limit=limit)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    want = plain_variants(misspelt, every=7)
    assert Counter(tuple(r) for r in got.collect()) == want
    assert any(w[1] and w[1] != w[2] for w in want) and any(w[4] == 0 for w in want)
    assert spelling.variants(df.where("false")).collect() == []


def test_acceptor_is_minimal_and_accepts_its_words():
    words = sorted({"".join(random.Random(k).choices("ab", k=6)) for k in range(60)})
    m = spelling.Acceptor(words)
    assert sorted(m.common(m.start, m.start)) == words
    ends = {q: frozenset(m.common(q, q)) for q in range(len(m.arcs))}
    assert len(set(ends.values())) == len(ends)  # no two states accept the same ends


def test_short_words_are_refused(spark):
    with pytest.raises(ValueError):
        spelling.variants(spark.createDataFrame([(1, "a")], "doc_id long, text string"), letters=5)


# --- 13 main text


class Plain(HTMLParser):
    """The blocks inside <article>, by the standard library's parser."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks = 0, [""]

    def handle_starttag(self, tag, attrs):
        self.inside += tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")
        elif tag == "br":
            self.blocks[-1] += " "

    def handle_endtag(self, tag):
        self.inside -= tag == "article"
        if tag in ("p", "h1"):
            self.blocks.append("")

    def handle_data(self, data):
        if self.inside:
            self.blocks[-1] += data


def test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r.text for r in article.extract(pages).collect()}
    for r in pages.collect():
        p = Plain()
        p.feed(r.html)
        p.close()
        assert got[r.page_id] == "\n".join(" ".join(b.split()) for b in p.blocks if b.split())


LONG = "A sentence that is long enough to be text. " * 6
CASES = {
    "<article><h1>Title</h1><p>One.</p><aside>no</aside><form>no <p>no</p></form><p>Two <b>b</b>old<script>var s = '</p>'</script></p></article><footer>no</footer>": "Title\nOne.\nTwo bold",
    "<main><h2>A &amp;amp; B</h2><p>x&nbsp;&nbsp;y &lt;z&gt;<p>w<ul><li>i<li>j</ul><section class='comments'><p>no</p></section></main>": "A &amp; B\nx y <z>\nw\ni\nj",
    "<body class='sidebar'><header><h1>Site</h1></header><article class='post comments-open'><header><h1>T</h1><p>by me</p></header><p>a<div class='ad box'>no</div>b</article>": "T\na\nb",
    f"<div><a href=/>Home</a> <a href=/n>News</a></div><div id=story><div>Head</div><div>{LONG}</div><div class='cookieNotice'>no {LONG}</div><div>Tail</div></div><div id='reader-comments'>{LONG}</div><p>&copy; me</p>": f"Head\n{LONG.strip()}\nTail",
    "<article><p title=\"a>b\">3 < 4 & 5 > 2<!-- no > -->!</p><div hidden>no</div><article class='comment'>no</article>": "3 < 4 & 5 > 2!",
    "<article><table><tr><td>a</td><td>b</td></tr><tr><td>c</td></tr></table><pre>x\n  y</pre>": "a b\nc\nx y",
    "<p>unclosed <b>tags": "unclosed tags",
    "<article></article><p>outside</p>": "outside",
    "": "", "plain words": "plain words", "<nav>a</nav><script>b": "", "<": "<", "<article>" + "<p>" * 3000 + "deep": "deep",
}


@pytest.mark.parametrize("source", CASES)
def test_markup(source):
    assert article.main_text(source) == CASES[source]


def test_extract_keeps_columns(spark):
    rows = [(1, "u", "<article>é</article>", "old", 7), (1, "u", "<article>é</article>", "old", 7), (None, None, None, None, None), (2, "v", "", "old", 8), (3, "w", "<article>" + "<p>x y</p>" * 100_000, "", 0)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string, row int")
    got = article.extract(df)
    assert got.columns == ["page_id", "url", "html", "row", "text"]
    assert Counter((r.page_id, r.url, r.row, r.text) for r in got.collect()) == Counter([(1, "u", 7, "é")] * 2 + [(None, None, None, ""), (2, "v", 8, ""), (3, "w", 0, "\n".join(["x y"] * 100_000))])
    assert article.extract(df.where("false")).collect() == []
    assert html.unescape("&copy;") == "©" and F
