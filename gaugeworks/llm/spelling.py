"""Spelling variants: the vocabulary's acceptor composed with a one-edit transducer and with the acceptor again.

The composed machine accepts a pair of words if they agree up to one inserted, deleted or replaced code point. Its paths
are enumerated per initial state: the state that the acceptor reaches after the first `DEPTH` code points. A pair whose edit
comes later shares that state; a pair whose edit comes earlier agrees in its last code points, and shares a state of the
acceptor of the reversed words. So every pair is met once, in a task that holds one state's words only. A state with more
than `STATE_WORDS` words is not enumerated: its arcs with the edit at this very place are joined on what must be equal
around it, and its words go on to the states one code point further.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from gaugeworks.llm.arrays import release
from gaugeworks.llm.frames import kept_table

#: Code points of an initial state. Half of the shortest word, so that an earlier edit leaves as many equal ones at the end.
DEPTH = 3
#: Most words of one state that a task enumerates.
STATE_WORDS = 20_000
#: Letters that make a word.
LETTERS = "A-Za-zÀ-ÿ"
PAIR = "word string, near string, near_n bigint"


def counted_words(docs: DataFrame, id: str = "doc_id", text: str = "text", every: int = 199) -> DataFrame:
    """(word, n): the runs of letters of all whole texts with A-Z lower-cased, and how often each occurs.

    A run loses a code point where `every` divides h, the crc32 of `<id>:<run>`: the one at h modulo its length. every=0
    keeps all. Null texts have no runs, a null id counts as empty text, rows that repeat an id are texts of their own.
    """
    name = F.coalesce(F.col(f"`{id}`").cast("string"), F.lit(""))
    runs = docs.select(name.alias("id"), F.explode(F.regexp_extract_all(F.col(f"`{text}`").cast("string"), F.lit(f"([{LETTERS}]+)"), F.lit(1))).alias("run"))
    word = runs.select("id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("word"))
    if every:
        h = F.crc32(F.concat_ws(":", "id", "word").cast("binary"))
        at = (F.col("h") % F.char_length("word")).cast("int")
        shorter = F.concat(F.substring(F.col("word"), F.lit(1), at), F.substring(F.col("word"), at + 2, F.char_length("word")))
        word = word.select("word", h.alias("h")).select(F.when(F.col("h") % every == 0, shorter).otherwise(F.col("word")).alias("word"))
    return word.groupBy("word").agg(F.count("*").alias("n"))


class Acceptor:
    """The minimal acceptor of words given in ascending order: equal ends become one state as soon as they are complete."""

    def __init__(self, words: list[str]):
        self.arcs: list[dict[str, int]] = []
        self.final: list[bool] = []
        self.known: dict[tuple, int] = {}
        path, before = [({}, [False])], ""
        for word in words:
            same = 0
            for x, y in zip(word, before):
                if x != y:
                    break
                same += 1
            self.close(path, before, same)
            path += [({}, [False]) for _ in word[same:]]
            path[len(word)][1][0] = True
            before = word
        self.close(path, before, 0)
        self.start = self.state(path[0])
        self.common_ends: dict[tuple[int, int], list[str]] = {}

    def state(self, node) -> int:
        arcs, final = node
        key = (final[0], *arcs.items())
        if key not in self.known:
            self.known[key] = len(self.arcs)
            self.arcs.append(arcs), self.final.append(final[0])
        return self.known[key]

    def close(self, path: list, word: str, depth: int) -> None:
        """Fix the states of `word` beyond `depth`, the last first."""
        for k in range(len(word), depth, -1):
            path[k - 1][0][word[k - 1]] = self.state(path.pop())

    def common(self, p: int, q: int) -> list[str]:
        """Ends accepted from both states, in no order."""
        key = (p, q) if p <= q else (q, p)
        out = self.common_ends.get(key)
        if out is None:
            a, b = self.arcs[p], self.arcs[q]
            out = [""] if self.final[p] and self.final[q] else []
            for c in a if len(a) <= len(b) else b:
                if c in a and c in b:
                    out += [c + end for end in self.common(a[c], b[c])]
            self.common_ends[key] = out
        return out

    def one_edit(self):
        """Every unordered pair of words that the composed machine accepts, once: before the edit both sides take the same
        arc; the edit takes two arcs of one state, or one arc on one side only; then both sides end alike."""
        open_states = [("", self.start)]
        while open_states:
            begin, q = open_states.pop()
            arcs = list(self.arcs[q].items())
            for k, (c, to) in enumerate(arcs):
                for d, other in arcs[:k]:
                    for end in self.common(to, other):
                        yield begin + c + end, begin + d + end
                for end in self.common(to, q):
                    if not end.startswith(c):  # else the same two words agree for longer
                        yield begin + c + end, begin + end
                open_states.append((begin + c, to))


def state_words(rows: DataFrame, limit: int) -> tuple[DataFrame, list[DataFrame]]:
    """(rows whose state is small enough, joined arcs of the states that aren't). Rows: side, state, word, n."""
    ready, arcs, depth = [], [], DEPTH
    while True:
        sizes = rows.groupBy("side", "state").agg(F.count("*").alias("size")).where(F.col("size") > limit)
        large = sizes.select("side", "state").join(rows, ["side", "state"])
        if sizes.isEmpty():
            ready.append(rows)
            break
        ready.append(rows.join(sizes.select("side", "state"), ["side", "state"], "left_anti"))
        large = kept_table(large, "large-states")
        arcs.append(edits_at(large, depth))
        depth += 1
        rows = large.where(F.char_length("word") >= depth).withColumn("state", F.substring("word", 1, depth))
    out = ready[0]
    for more in ready[1:]:
        out = out.unionByName(more)
    return out, arcs


def edits_at(rows: DataFrame, depth: int) -> DataFrame:
    """Pairs of words of one state whose first difference is right behind it, by what must be equal: the state, and the end
    behind the edit. At most one word per letter has both, so no group is large."""
    cut = rows.where(F.char_length("word") > depth).select("side", "state", "word", "n", F.substring("word", depth + 1, 1).alias("letter"), F.expr(f"substring(word, {depth + 2})").alias("end"))
    whole = rows.select("side", "state", F.col("word").alias("near"), F.col("n").alias("near_n"), F.expr(f"substring(word, {depth + 1})").alias("end"))
    other = cut.select("side", "state", "end", F.col("word").alias("near"), F.col("n").alias("near_n"), F.col("letter").alias("near_letter"))
    replaced = cut.join(other, ["side", "state", "end"]).where("letter < near_letter").select("side", "word", "n", "near", "near_n")
    dropped = cut.join(whole, ["side", "state", "end"]).where("end = '' or substring(end, 1, 1) <> letter").select("side", "word", "n", "near", "near_n")
    return replaced.unionByName(dropped)


def near_pairs(words: DataFrame, limit: int = STATE_WORDS) -> DataFrame:
    """(word, near, near_n), each pair in both directions: words that differ by one inserted, deleted or replaced code point.

    words: distinct (word, n), of at least 2 * DEPTH code points each; shorter ones are compared only where they share a state.
    """
    sides = F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("word").alias("word")), F.struct(F.lit(1).alias("side"), F.reverse("word").alias("word"))))
    rows = words.select("n", sides.alias("s")).select("s.side", F.substring("s.word", 1, DEPTH).alias("state"), "s.word", "n")
    small, arcs = state_words(rows, limit)
    parted = small.repartition("side", "state").sortWithinPartitions("side", "state", "word")

    def enumerate_states(batches):
        key, words_in, counts = None, [], {}
        for batch in batches:
            for side, state, word, n in zip(*(c.to_pylist() for c in batch.select(["side", "state", "word", "n"]).columns)):
                if (side, state) != key:
                    yield from pairs_of(key, words_in, counts)
                    key, words_in, counts = (side, state), [], {}
                words_in.append(word)
                counts[word] = n
        yield from pairs_of(key, words_in, counts)
        release()

    found = parted.mapInArrow(enumerate_states, "side int, word string, n bigint, near string, near_n bigint")
    for more in arcs:
        found = found.unionByName(more)
    forward = F.when(F.col("side") == 0, F.col("word")).otherwise(F.reverse("word")).alias("word")
    other = F.when(F.col("side") == 0, F.col("near")).otherwise(F.reverse("near")).alias("near")
    found = found.select("side", forward, "n", other, "near_n")
    found = found.where(f"side = 0 or substring(word, 1, {DEPTH}) <> substring(near, 1, {DEPTH})")
    both = F.explode(F.array(F.struct("word", "near", "near_n"), F.struct(F.col("near").alias("word"), F.col("word").alias("near"), F.col("n").alias("near_n"))))
    return found.select(both.alias("p")).select("p.word", "p.near", "p.near_n")


def pairs_of(key, words: list[str], counts: dict[str, int], most: int = 50_000):
    """Batches of the pairs of one state. The words stand in ascending order of their bytes, hence of their code points."""
    if len(words) < 2:
        return
    out = []
    for u, v in Acceptor(words).one_edit():
        out.append((key[0], u, counts[u], v, counts[v]))
        if len(out) >= most:
            yield batch_of(out)
            out = []
    if out:
        yield batch_of(out)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.string(), pa.int64(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["side", "word", "n", "near", "near_n"])


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text", every: int = 199, letters: int = 6, occurrences: int = 5, factor: int = 5, limit: int = STATE_WORDS) -> DataFrame:
    """One row per word of at least `letters` code points that occurs `occurrences` times: word, form, root, n, n_near, form_n.

    A word's form is its near word with the largest n, the smallest word among ties, if that n is at least `factor` times the
    word's own; else null. root is reached by following forms to the last, and is the word itself if it has none. Words
    are those of `counted_words`. `letters` is at least 2 * DEPTH. No words, or an empty table, give no rows.
    """
    if letters < 2 * DEPTH:
        raise ValueError(f"words need at least {2 * DEPTH} code points")
    words = kept_table(counted_words(docs, id, text, every).where((F.col("n") >= occurrences) & (F.char_length("word") >= letters)), "words")
    best = near_pairs(words, limit).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("n"), F.col("near").alias("word"))).alias("best"))
    best = best.select("word", "n_near", F.col("best.word").alias("near"), (-F.col("best.n")).alias("near_n"))
    fits = F.col("near_n") >= factor * F.col("n")
    forms = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("near")).alias("form"), F.when(fits, F.col("near_n")).alias("form_n"))
    forms = kept_table(forms, "forms")
    roots = last_forms(forms.where("form is not null").select("word", F.col("form").alias("root")))
    return forms.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def last_forms(links: DataFrame) -> DataFrame:
    """(word, root) by pointer doubling: n grows along forms, so they end, after as many rounds as the logarithm of their number."""
    links = kept_table(links, "links")
    while True:
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = kept_table(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "links")
        if links.where("moved").isEmpty():
            return links.drop("moved")
        links = links.drop("moved")
