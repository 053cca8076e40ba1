"""Line dedup over levelled sorted runs of line hashes, DataFrame functions only.

`LineRuns` keeps what earlier batches held as runs in the shared folder: one row per line key with the number of
documents and the last document that hold it, range-partitioned and sorted by the key's hash. A new batch is one more
run at level 0; when a level has `fanout` runs they are merged into one run of the next level, so a batch meets few
runs and every row is rewritten only once per level. `fresh` gives the lines of a batch that no run holds, a merge
anti-join of sorted sides.

A document's lines enter a run as one row per (document, key), and keys are counted by a map-side combined grouping, so
a line in a third of all documents is one row per task. 128-bit hashes stand for the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from gaugeworks.llm.frames import partitions, pick, scratch_dir

LEAST_CHARS = 20
LEAST_DOCS = 3
#: White space stripped from both ends of a line to make its key.
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line stripped of ASCII white space, A-Z lowered; letters beyond ASCII stay."""
    bare = F.trim(line, F.lit(SPACE))
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(F.translate(bare, UPPER, LOWER))


def lines(text: Column) -> Column:
    """The lines of a whole text; a null or empty text is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def marks(text: Column, least_chars: int) -> Column:
    """One hash per line, in order; null for lines whose key is too short to count."""
    return F.transform(lines(text), lambda x: F.when(F.char_length(x) >= least_chars, _mark(line_key(x), least_chars)))


def _mark(key: Column, least_chars: int) -> Column:
    return F.when(F.char_length(key) >= least_chars, F.unhex(F.md5(key)))


class LineRuns:
    """Levels of runs below `folder`, oldest batches deepest. `levels` names the runs of each level."""

    def __init__(self, spark, folder: str | None = None, fanout: int = 4, least_chars: int = LEAST_CHARS):
        self.spark, self.folder, self.fanout, self.least_chars = spark, folder or scratch_dir(spark, "line-runs"), fanout, least_chars
        self.levels: list[list[str]] = []
        self.written = 0

    def _write(self, run: DataFrame, level: int) -> None:
        path = f"{self.folder}/{self.written:06d}"
        self.written += 1
        run.repartitionByRange(partitions(self.spark), "mark").sortWithinPartitions("mark").write.parquet(path)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(path)

    def held(self) -> DataFrame | None:
        """All runs as one table (mark, docs, last), a mark in several rows where several runs hold it."""
        paths = [p for level in self.levels for p in level]
        return self.spark.read.parquet(*paths) if paths else None

    def summary(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
        """The run of one batch: (mark, docs, last) for every key; each row of `docs` is one document."""
        d = pick(docs, id=id, text=text).select("id", F.explode(F.array_distinct(marks(F.col("text"), self.least_chars))).alias("mark"))
        return d.where("mark is not null").groupBy("mark").agg(F.count("*").alias("docs"), F.max("id").alias("last"))

    def add(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> None:
        """Add a batch as a run, then merge full levels."""
        self._write(self.summary(docs, id, text), 0)
        level = 0
        while level < len(self.levels) and len(self.levels[level]) >= self.fanout:
            paths, self.levels[level] = self.levels[level], []
            self._write(merged(self.spark.read.parquet(*paths)), level + 1)
            level += 1

    def fresh(self, docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
        """(id, mark) of the batch's keys that no run holds yet."""
        d = pick(docs, id=id, text=text).select("id", F.explode(F.array_distinct(marks(F.col("text"), self.least_chars))).alias("mark")).where("mark is not null")
        held = self.held()
        return d if held is None else d.join(held.select("mark"), "mark", "left_anti")


def merged(runs: DataFrame) -> DataFrame:
    return runs.groupBy("mark").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))


def id_ranges(docs: DataFrame, id: str, n: int) -> list[DataFrame]:
    """`docs` in n ranges of a numeric id with about equal row counts; null ids are in the first."""
    if n < 2:
        return [docs]
    c = F.col(f"`{id}`")
    cut = docs.select(F.percentile_approx(c, [k / n for k in range(1, n)], 10_000)).first()[0]
    if not cut:
        return [docs]
    cut = sorted(set(cut))
    return [docs.where(c.isNull() | (c <= cut[0])), *(docs.where((c > a) & (c <= b)) for a, b in zip(cut, cut[1:])), docs.where(c > cut[-1])]


def dedup_lines(docs: DataFrame, id: str = "doc_id", text: str = "text", least_docs: int = LEAST_DOCS, least_chars: int = LEAST_CHARS, batches: int = 1, runs: LineRuns | None = None) -> DataFrame:
    """Every row of `docs` with `_lines` = (n_lines, n_dropped, kept).

    A line whose key has at least `least_chars` code points and is found in at least `least_docs` documents is dropped
    from every document but the one with the largest id that holds it. Each row counts as one document, also where ids
    repeat; all rows with the largest id keep the line. Null ids come before all others. Null and empty texts are one
    empty line. An empty table gives no rows. The rows are added to `runs` in `batches` ranges of the id (a number if
    batches > 1), which reach the scan as filters; documents that earlier calls brought to `runs` count too. All columns
    of `docs` stay; one called `_lines` is replaced.
    """
    spark = docs.sparkSession
    runs = runs or LineRuns(spark, least_chars=least_chars)
    for part in id_ranges(docs, id, batches):
        runs.add(part, id, text)
    often = merged(runs.held()).where(F.col("docs") >= least_docs).select("mark", "last")
    # All columns travel in one struct, so that none can clash with the names used here.
    d = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.xxhash64(F.col(f"`{text}`")).alias("_hash"))
    own, said = F.col(f"_doc.`{id}`"), F.col(f"_doc.`{text}`")
    hits = (
        d.select(own.alias("_i"), F.col("_hash").alias("_h"), F.explode(F.array_distinct(marks(said, least_chars))).alias("mark")).where("mark is not null")
        .join(often, "mark").where(F.col("last").isNotNull() & (F.col("_i").isNull() | (F.col("_i") < F.col("last"))))
        .groupBy("_i", "_h").agg(F.collect_set("mark").alias("_drop"))
    )
    joined = d.join(hits, own.eqNullSafe(F.col("_i")) & (F.col("_hash").eqNullSafe(F.col("_h"))), "left")
    whole = lines(said)
    dropped = lambda x: F.coalesce(F.array_contains(F.col("_drop"), F.when(F.char_length(x) >= least_chars, _mark(line_key(x), least_chars))), F.lit(False))
    keep = F.when(F.col("_drop").isNull(), whole).otherwise(F.filter(whole, lambda x: ~dropped(x)))
    found = F.struct(F.size(whole).cast("long").alias("n_lines"), (F.size(whole) - F.size("_kept")).cast("long").alias("n_dropped"), F.array_join("_kept", "\n").alias("kept"))
    return joined.withColumn("_kept", keep).select(*[F.col(f"_doc.`{c}`") for c in docs.columns if c != "_lines"], found.alias("_lines"))
