"""Order-dependent primitives that hold when one key owns a large part of all rows.

A plain ordered window puts a whole key on one task. Every function here first measures the largest
group (one map-side combined count). Below `spark.gaugeworks.groupRows` it is the plain window. Above,
the order axis is cut into ranges with about equal row counts, the window runs per (key, range), and
what crosses a cut travels as a small summary row or as a bounded halo of neighbouring rows.
Rows that share the first order columns are cut along the next ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from gaugeworks.session import broadcast_if_small, durable, group_rows, match, scalar_row

#: Rows of a block that a task works on as arrays.
BLOCK_ROWS = 100_000


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    if not keys:
        return df.count()
    top = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("n")).first()
    return top["n"] or 0


def cut_ranges(df: DataFrame, order: Sequence[str], rows: int, desc: bool = False) -> DataFrame:
    """Add `_seg`, the range of the order columns a row falls in, about `rows` rows per range, numbered in order.

    Spark's range partitioning samples all order columns together, so ties in the first ones are cut along the next,
    of any type, and nulls and NaN take the place the plain window gives them for this direction. A key's share of the
    rows does not matter; only rows equal in every order column stay together. The result is written to the shared
    folder, as another run of the plan might sample other edges.
    """
    n = max(1, math.ceil(df.count() / rows))
    ranged = df.repartitionByRange(n, *_sorted(order, desc)) if n > 1 else df.coalesce(1)
    return durable(ranged.withColumn("_seg", F.spark_partition_id().cast("long")))


def _sorted(order: Sequence[str], desc: bool) -> list[Column]:
    return [F.col(c).desc() if desc else F.col(c).asc() for c in order]


_SUMMARY = {
    "sum": lambda v, o: F.sum(v),
    "count": lambda v, o: F.count(v),
    "max": lambda v, o: F.max(v),
    "min": lambda v, o: F.min(v),
    "last": lambda v, o: F.max_by(v, F.when(v.isNotNull(), o)),
    "first": lambda v, o: F.min_by(v, F.when(v.isNotNull(), o)),
}
_LOCAL = {
    "sum": lambda v: F.sum(v),
    "count": lambda v: F.count(v),
    "max": lambda v: F.max(v),
    "min": lambda v: F.min(v),
    "last": lambda v: F.last(v, ignorenulls=True),
    "first": lambda v: F.first(v, ignorenulls=True),
}
_CARRY = {
    "sum": lambda v: F.sum(v),
    "count": lambda v: F.sum(v),
    "max": lambda v: F.max(v),
    "min": lambda v: F.min(v),
    "last": lambda v: F.last(v, ignorenulls=True),
    "first": lambda v: F.first(v, ignorenulls=True),
}
_JOIN = {
    "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
    "count": lambda a, b: F.coalesce(a, F.lit(0)) + b,
    "max": lambda a, b: F.greatest(a, b),
    "min": lambda a, b: F.least(a, b),
    "last": lambda a, b: F.coalesce(b, a),
    "first": lambda a, b: F.coalesce(a, b),
}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    specs: dict[str, tuple[str, Column]],
    desc: bool = False,
    rows: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Aggregates over all rows up to and with the current one, per key.

    `specs` maps an output name to (kind, input); kinds are sum, count, max, min, last and first (the
    last two skip nulls). One shuffle of the data; above the group limit the rows are first ranged and written once,
    then the window and a small summary follow. A caller that already knows the size of the largest group passes it
    as `largest`.
    """
    keys = list(keys)
    limit = rows or group_rows(df.sparkSession)
    frame = (W.unboundedPreceding, W.currentRow)
    if (largest_group(df, keys) if largest is None else largest) <= limit:
        w = W.partitionBy(*keys).orderBy(*_sorted(order, desc)).rowsBetween(*frame)
        return df.withColumns({n: _LOCAL[k](v).over(w) for n, (k, v) in specs.items()})
    out_cols = [c for c in df.columns if c not in specs]
    cut = cut_ranges(df, order, limit, desc)
    cut = cut.withColumns({f"_in_{n}": v for n, (_, v) in specs.items()})
    at = F.struct(*[F.col(c) for c in order])
    flip = {"last": "first", "first": "last"} if desc else {}
    summary = cut.groupBy(*keys, "_seg").agg(
        *[_SUMMARY[flip.get(k, k)](F.col(f"_in_{n}"), at).alias(f"_sum_{n}") for n, (k, _) in specs.items()]
    )
    before = W.partitionBy(*keys).orderBy("_seg").rowsBetween(W.unboundedPreceding, -1)
    carry = summary.select(
        *keys, "_seg", *[_CARRY[k](F.col(f"_sum_{n}")).over(before).alias(f"_carry_{n}") for n, (k, _) in specs.items()]
    )
    local = W.partitionBy(*keys, "_seg").orderBy(*_sorted(order, desc)).rowsBetween(*frame)
    within = cut.withColumns({f"_loc_{n}": _LOCAL[k](F.col(f"_in_{n}")).over(local) for n, (k, _) in specs.items()})
    return match(within, carry, [*keys, "_seg"]).select(
        *out_cols,
        *[_JOIN[k](F.col(f"_carry_{n}"), F.col(f"_loc_{n}")).alias(n) for n, (k, _) in specs.items()],
    )


def position(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", desc: bool = False, rows: int | None = None, largest: int | None = None
) -> DataFrame:
    """1-based place of a row within its key."""
    return running(df, keys, order, {name: ("count", F.lit(1))}, desc, rows, largest)


def framed(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    before: int,
    after: int,
    build: Callable[[W], dict[str, Column]],
    rows: int | None = None,
    largest: int | None = None,
) -> DataFrame:
    """Window expressions that look at most `before` rows back and `after` rows ahead.

    `build` gets an ordered window. Above the group limit the key is cut into blocks of equal length by
    position, and the rows next to a cut are copied into the neighbouring block.
    """
    keys = list(keys)
    limit = rows or group_rows(df.sparkSession)
    largest = largest_group(df, keys) if largest is None else largest
    if largest <= limit:
        return df.withColumns(build(W.partitionBy(*keys).orderBy(*_sorted(order, False))))
    size = max(limit, before + after, 1)
    spread = haloed(position(df, keys, order, "_pos", rows=limit, largest=largest), size, before, after)
    w = W.partitionBy(*keys, "_block").orderBy("_pos")
    return spread.withColumns(build(w)).filter("_block = _home").drop("_home", "_block", "_pos")


def haloed(placed: DataFrame, size: int, before: int, after: int) -> DataFrame:
    """Rows with `_pos` in blocks of `size` places: `_home` is a row's own block, and it's copied into each `_block` that looks at it."""
    home = F.floor((F.col("_pos") - 1) / size)
    into = (F.col("_pos") - 1) % size
    blocks = F.array_compact(
        F.array(
            home,
            F.when(into >= size - before, home + 1) if before else F.lit(None).cast("bigint"),
            F.when((into < after) & (home > 0), home - 1) if after else F.lit(None).cast("bigint"),
        )
    )
    return placed.withColumns({"_home": home, "_block": blocks}).withColumn("_block", F.explode("_block"))


def in_blocks(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], before: int, after: int, out: T.StructType, run: Callable[[pa.Table], pa.Table], rows: int = BLOCK_ROWS
) -> DataFrame:
    """`run` on the ordered rows of each block of a key, with `before` and `after` rows around it, as Arrow tables.

    For work on arrays that a window expression does row by row. `run` gets `_pos` too, and `_own`, false for copied rows; columns
    that aren't in `out` are dropped.
    """
    keys = list(keys)
    limit = min(rows, group_rows(df.sparkSession))
    placed = position(df, keys, order, "_pos", rows=limit)
    spread = haloed(placed, max(limit, before + after, 1), before, after).withColumn("_own", F.col("_block") == F.col("_home")).drop("_home")
    names = out.fieldNames()

    def each(table: pa.Table) -> pa.Table:
        return run(table.sort_by("_pos")).select(names)

    return spread.groupBy(*keys, "_block").applyInArrow(each, out)


def trailing(
    df: DataFrame, keys: Sequence[str], micros: str, span: int, tie: str, count: str, first: str | None = None, dense: int | None = None
) -> DataFrame:
    """Rows of the last `span` microseconds (both ends included) per row, and the time of the first of them.

    The clock is cut into cells one span wide and a row is copied into the next cell too, so a cell holds all its rows
    can see. A frame that slides costs its length per row; frames that only grow cost one step: the rows up to now less
    those before the span, and the first row of the span as the last one met from the far end. For bursts, cells above
    `dense` rows (half the group limit), both ends of every span become markers among the rows, and counts are
    differences of one running count.
    """
    keys = list(keys)
    dense = group_rows(df.sparkSession) // 2 if dense is None else dense
    celled = df.withColumn("_home", F.floor(F.col(micros) / F.lit(span)))
    if largest_group(celled, [*keys, "_home"]) <= dense:
        spread = celled.withColumn("_cell", F.explode(F.array(F.col("_home"), F.col("_home") + 1)))
        cell = W.partitionBy(*keys, "_cell")
        upto = lambda end: F.count(F.lit(1)).over(cell.orderBy(micros).rangeBetween(W.unboundedPreceding, end))
        since = cell.orderBy(F.col(micros).desc()).rangeBetween(W.unboundedPreceding, span)
        out = {count: upto(0) - upto(-span - 1), **({first: F.min(micros).over(since)} if first else {})}
        return spread.withColumns(out).filter("_cell = _home").drop("_home", "_cell")
    t = F.col(micros)
    marks = F.array(*[F.struct(x.alias("x"), F.lit(k).alias("k")) for x, k in ((t - span, 0), (t, 1), (t, 2))])
    line = df.select(*keys, tie, F.explode(marks).alias("m")).select(*keys, tie, "m.x", "m.k").withColumn("_o", F.col("k"))
    line = running(line, keys, ["x", "_o", tie], {"_c": ("sum", (F.col("k") == 1).cast("int"))})
    line = running(line, keys, ["x", "_o", tie], {"_next": ("last", F.when(F.col("k") == 1, F.col("x")))}, desc=True)
    pick = lambda k, c: F.max(F.when(F.col("k") == k, F.col(c)))
    got = line.groupBy(*keys, tie).agg((pick(2, "_c") - pick(0, "_c")).alias(count), *([pick(0, "_next").alias(first)] if first else []))
    return match(df, got, [*keys, tie])


def frequencies(df: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Long table (keys, `_col`, `_val`, `_n`): every distinct value with its count, combined map-side."""
    pairs = F.array(*[F.struct(F.lit(c).alias("c"), F.col(c).cast("double").alias("v")) for c in cols])
    long = df.select(*keys, F.explode(pairs).alias("p")).select(*keys, F.col("p.c").alias("_col"), F.col("p.v").alias("_val"))
    return long.filter("_val is not null").groupBy(*keys, "_col", "_val").agg(F.count(F.lit(1)).alias("_n"))


def quantiles(
    df: DataFrame, keys: Sequence[str], cols: Sequence[str], probs: Sequence[float], rows: int | None = None
) -> DataFrame:
    """Exact quantiles with linear interpolation: per key an array `q_<col>` in the order of `probs`.

    The built-in keeps all distinct values of a group in one task, so it serves only groups below the
    limit; above, ranks come from running counts over the table of distinct values, which is written once, as several
    passes read it.
    """
    keys = list(keys)
    limit = rows or group_rows(df.sparkSession)
    if largest_group(df, keys) <= limit:
        return df.groupBy(*keys).agg(
            *[F.percentile(F.col(c).cast("double"), [float(p) for p in probs]).alias(f"q_{c}") for c in cols]
        )
    freq = durable(frequencies(df, keys, cols))
    by = [*keys, "_col"]
    cum = running(freq, by, ["_val"], {"_cum": ("sum", F.col("_n"))}, rows=limit)
    total = freq.groupBy(*by).agg(F.sum("_n").alias("_tot"))
    ranked = match(cum, total, by)

    def at(index: Column) -> Column:
        hit = (F.col("_cum") - F.col("_n") <= index) & (index < F.col("_cum"))
        return F.max(F.when(hit, F.col("_val")))

    picks, qs = [], []
    for i, p in enumerate(probs):
        rank = F.lit(float(p)) * (F.col("_tot") - 1)
        picks += [at(F.floor(rank)).alias(f"_lo{i}"), at(F.ceil(rank)).alias(f"_hi{i}")]
        qs.append(F.col(f"_lo{i}") + (rank - F.floor(rank)) * (F.col(f"_hi{i}") - F.col(f"_lo{i}")))
    got = ranked.groupBy(*by, "_tot").agg(*picks).select(*by, F.array(*qs).alias("_q"))
    return got.groupBy(*keys).agg(*[F.max(F.when(F.col("_col") == c, F.col("_q"))).alias(f"q_{c}") for c in cols])


#: Ranges of values between a number and its double, and the ranges a range is cut into, for `quantile`.
OCTAVE = 256
CUTS = 4096


def _span(v: Column) -> Column:
    """The range a number falls in, about 1 / `OCTAVE` of the number wide; larger numbers have no smaller range, NaN the last."""
    far = 1 << 40
    size = F.floor(F.log2(F.abs(v)) * OCTAVE) + 1100 * OCTAVE
    return F.when(F.isnan(v), 2 * far).when(F.abs(v) == math.inf, F.signum(v) * far).when(v == 0, 0).otherwise(F.signum(v) * size).cast("long")


def quantile(df: DataFrame, keys: Sequence[str], col: str, prob: float, name: str, largest: int | None = None, rows: int | None = None) -> DataFrame:
    """The exact quantile of one column with linear interpolation, per key as `name`.

    Above the group limit only counts leave the tasks: the rows of each range of values, and the smallest and the largest value
    in it. The range that holds the ranks is cut again while it has more rows than the limit, then its values are counted one by
    one. The input is computed once for each of these, twice as a rule. A caller that already knows the size of the largest group
    passes it as `largest`.
    """
    keys = list(keys)
    limit = rows or group_rows(df.sparkSession)
    v = F.col("_v")
    data = df.select(*keys, F.col(col).cast("double").alias("_v"))
    if (largest_group(df, keys) if largest is None else largest) <= limit:
        return data.groupBy(*keys).agg(F.percentile(v, float(prob)).alias(name))
    data = data.filter(v.isNotNull())
    by = keys or ["_all"]
    if not keys:
        data = data.withColumn("_all", F.lit(0))
    rank = F.lit(float(prob)) * (F.col("_tot") - 1)

    def counts(df: DataFrame, at: Column) -> DataFrame:
        return durable(df.groupBy(*by, at.alias("_at")).agg(F.count(F.lit(1)).alias("_n"), F.min(v).alias("_lo"), F.max(v).alias("_hi")))

    def holding(ranges: DataFrame) -> DataFrame:
        """A row a group: the ends of the range with both ranks in it, or else, and then not `_open`, the two values."""
        upto = F.col("_base") + F.sum("_n").over(W.partitionBy(*by).orderBy("_lo").rowsBetween(W.unboundedPreceding, W.currentRow))
        has = lambda index: (F.col("_cum") - F.col("_n") <= index) & (index < F.col("_cum"))
        low, high = has(F.floor(rank)), has(F.ceil(rank))
        got = ranges.withColumn("_cum", upto).groupBy(*by, "_tot").agg(
            F.max(F.when(low, F.struct((F.col("_cum") - F.col("_n")).alias("base"), F.col("_n").alias("n"), F.col("_lo").alias("lo"), F.col("_hi").alias("hi"), high.alias("both")))).alias("l"),
            F.max(F.when(high, F.struct(F.col("_lo").alias("lo"), F.col("_hi").alias("hi")))).alias("h"))
        return durable(got.select(
            *by, "_tot", F.col("l.base").alias("_base"), F.col("l.n").alias("_rows"), F.when(F.col("l.both"), F.col("l.lo")).otherwise(F.col("l.hi")).alias("_from"),
            F.when(F.col("l.both"), F.col("h.hi")).otherwise(F.col("h.lo")).alias("_to"), (F.col("l.both") & (F.col("l.lo") < F.col("h.hi"))).alias("_open")))

    spans = counts(data, _span(v))
    found = holding(match(spans, spans.groupBy(*by).agg(F.sum("_n").alias("_tot"), F.lit(0).alias("_base")), by))
    while most := found.agg(F.max(F.when(F.col("_open"), F.col("_rows")))).first()[0]:
        ends = found.filter("_open").drop("_open", "_rows")
        inside = match(data, broadcast_if_small(ends), by).filter(v.between(F.col("_from"), F.col("_to")))
        cut = F.floor((v - F.col("_from")) / (F.col("_to") - F.col("_from")) * CUTS) if most > limit else v
        found = found.filter("not _open").unionByName(holding(match(counts(inside, cut), ends, by)))
    value = F.when(F.col("_from") == F.col("_to"), F.col("_from")).otherwise(F.col("_from") + (rank - F.floor(rank)) * (F.col("_to") - F.col("_from")))
    return found.select(*keys, value.alias(name))


def modes(df: DataFrame, keys: Sequence[str], col: str, name: str = "mode") -> DataFrame:
    """Most frequent value per key with its count `<name>_n`, the smallest on a tie.

    Two map-side combined aggregates; the built-in would hold every distinct value of a group at once.
    """
    freq = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    top = F.min_by(F.struct(F.col(col).alias("v"), F.col("_n").alias("n")), F.struct(-F.col("_n"), F.col(col)))
    return freq.groupBy(*keys).agg(top.alias("_top")).select(*keys, F.col("_top.v").alias(name), F.col("_top.n").alias(f"{name}_n"))


def nearest_rank(df: DataFrame, keys: Sequence[str], col: str, probs: dict[str, float], rows: int | None = None) -> DataFrame:
    """Values at index int(n * p) of the sorted group, without interpolation."""
    keys = list(keys)
    freq = df.filter(F.col(col).isNotNull()).groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    cum = running(freq, keys, [col], {"_cum": ("sum", F.col("_n"))}, rows=rows)
    total = freq.groupBy(*keys).agg(F.sum("_n").alias("_tot"))
    if keys:
        ranked = match(cum, total, keys)
    else:
        ranked = cum.withColumn("_tot", scalar_row(total)["_tot"])

    def at(p: float) -> Column:
        index = F.least(F.floor(F.col("_tot") * F.lit(float(p))), F.col("_tot") - 1)
        return F.max(F.when((F.col("_cum") - F.col("_n") <= index) & (index < F.col("_cum")), F.col(col)))

    return ranked.groupBy(*keys).agg(*[at(p).alias(n) for n, p in probs.items()])


def average_rank(df: DataFrame, keys: Sequence[str], col: str, name: str, rows: int | None = None) -> DataFrame:
    """Rank with ties averaged, from running counts over distinct values; joined back by value."""
    keys = list(keys)
    freq = df.groupBy(*keys, col).agg(F.count(F.lit(1)).alias("_n"))
    cum = running(freq, keys, [col], {"_cum": ("sum", F.col("_n"))}, rows=rows)
    ranks = cum.select(*keys, col, (F.col("_cum") - (F.col("_n") - 1) / 2).alias(name))
    return match(df, ranks, [*keys, col])


def islands(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], flag: Column, name: str = "island", rows: int | None = None
) -> DataFrame:
    """Number the runs of equal `flag` per key: 1 for the first run, rising at every change."""
    size = largest_group(df, keys)
    marked = df.withColumn("_flag", F.coalesce(flag, F.lit(False)))
    changed = framed(
        marked, keys, order, 1, 0,
        lambda w: {"_turn": F.when(F.col("_flag") == F.lag("_flag").over(w), 0).otherwise(1)}, rows, size,
    )
    return running(changed, keys, order, {name: ("sum", F.col("_turn"))}, rows=rows, largest=size).drop("_flag", "_turn")


Step = Callable[[pd.DataFrame, list[float]], tuple[dict[str, list], list[float]]]


def fold(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    step: Step,
    init: Sequence[float],
    outputs: str,
    rows: int | None = None,
) -> DataFrame:
    """A state machine over the rows of a key in order, for rules that depend on their own output.

    `step(rows, state)` gets ordered rows and the state before them and returns the output columns and
    the state after them. A key above the limit is cut into blocks that all run at once from a guessed
    entry state; a block whose predecessor ended elsewhere runs again, until no entry state changes, so
    the result is that of one pass. Rules that forget their past settle within a few rounds.
    """
    keys, order = list(keys), list(order)
    limit = rows or group_rows(df.sparkSession)
    base = df.schema
    added = T._parse_datatype_string(outputs)
    result = T.StructType([*base.fields, *added.fields])
    names = base.fieldNames()
    first = [float(v) for v in init]

    def emit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        start = list(pdf["_state"].iloc[0]) if "_state" in pdf.columns else first
        cols, _ = step(pdf, start)
        out = pdf[names].copy()
        for f in added.fields:
            out[f.name] = cols[f.name]
        return out

    largest = largest_group(df, keys)
    if largest <= limit:
        grouped = df.groupBy(*keys) if keys else df.groupBy(F.lit(0))
        return grouped.applyInPandas(emit, result)

    placed = position(df, keys, order, "_pos", rows=limit, largest=largest)
    placed = durable(placed.withColumn("_block", F.floor((F.col("_pos") - 1) / limit).cast("long")).drop("_pos"))
    by = [*keys, "_block"]
    state_type = "array<double>"
    key_fields = [placed.schema[k] for k in by]
    exit_type = T.StructType([*key_fields, T.StructField("_exit", T.ArrayType(T.DoubleType()))])

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable").reset_index(drop=True)
        _, state = step(pdf, list(pdf["_state"].iloc[0]))
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in by}, "_exit": [[float(v) for v in state]]})

    chain = W.partitionBy(*keys).orderBy("_block")
    entry0 = F.array(*[F.lit(v) for v in first]).cast(state_type)
    # Only blocks that have a successor need an exit state: at most rows/limit of them.
    table = placed.select(*by).distinct().withColumn("_next", F.lead("_block").over(chain))
    table = durable(table.withColumns({"_state": entry0, "_exit": F.lit(None).cast(state_type), "_todo": F.lit(True)}))
    while True:
        todo = table.filter("_todo and _next is not null").select(*by, "_state")
        if todo.isEmpty():
            break
        ran = match(placed, broadcast_if_small(todo), by).groupBy(*by).applyInPandas(leave, exit_type)
        merged = match(table.drop("_todo"), ran.withColumnRenamed("_exit", "_new"), by, "left")
        merged = merged.withColumn("_exit", F.coalesce("_new", "_exit")).drop("_new")
        entry = F.coalesce(F.lag("_exit").over(chain), entry0)
        moved = merged.withColumn("_entry", entry)
        table = durable(moved.withColumn("_todo", F.col("_entry") != F.col("_state")).withColumn("_state", F.col("_entry")).drop("_entry"))
    ready = match(placed, table.select(*by, "_state"), by)
    return ready.groupBy(*by).applyInPandas(emit, result)


def chain(df: DataFrame, keys: Sequence[str], pos: str, follows: str, rows: int | None = None) -> DataFrame:
    """(keys, pos): the rows met from the first row of each key by going from each to the later row that `follows` names.

    Rows are cut into blocks of places. Within a block one pass finds where a walk from each row leaves it; only rows that some
    walk enters a block at, go on. Their jumps are doubled until none is left, then taken from the longest to the
    shortest, so the rounds grow with twice the logarithm of the number of blocks. A last pass marks the rows within each
    block. No row of `follows` may name a place that isn't in `df`.
    """
    keys, limit = list(keys), rows or group_rows(df.sparkSession)
    at = durable(df.select(*keys, F.col(pos).alias("_p"), F.col(follows).alias("_f")).withColumn("_block", F.floor((F.col("_p") - 1) / limit).cast("bigint")))
    kinds = [at.schema[k] for k in keys] + [T.StructField("_p", T.LongType())]

    def local(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
        """Places in order, and the row of the block each one names, or -1."""
        pdf.sort_values("_p", inplace=True)
        p, f = pdf["_p"].to_numpy(np.int64), pdf["_f"].fillna(-1).to_numpy(np.int64)
        return p, np.where((f >= 0) & (f <= p[-1]), np.searchsorted(p, f), -1)

    def leave(pdf: pd.DataFrame) -> pd.DataFrame:
        _, to = local(pdf)
        last = np.arange(len(to))
        step = np.where(to >= 0, to, last)
        while (step[step] != step).any():
            step = step[step]
        return pd.DataFrame({**{c: pdf[c].to_numpy() for c in (*keys, "_p")}, "_e": pdf["_f"].to_numpy()[step]}).dropna(subset=["_e"]).astype({"_e": "int64"})

    exits = durable(at.groupBy(*keys, "_block").applyInPandas(leave, T.StructType([*kinds, T.StructField("_e", T.LongType())])))
    reached = durable(at.groupBy(*keys).agg(F.min("_p").alias("_p")))
    entered = exits.select(*keys, F.col("_e").alias("_p")).unionByName(reached).distinct()
    jump, jumps = durable(match(exits, entered, [*keys, "_p"])), []
    while not jump.isEmpty():
        jumps.append(jump)
        further = jump.select(*keys, F.col("_p").alias("_e"), F.col("_e").alias("_to"))
        jump = durable(match(jump, further, [*keys, "_e"]).select(*keys, "_p", F.col("_to").alias("_e")))
    for jump in reversed(jumps):
        more = match(reached, jump, [*keys, "_p"]).select(*keys, F.col("_e").alias("_p"))
        reached = durable(reached.unionByName(more).distinct())

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        p, to = local(pdf)
        met, i = [], int(np.argmax(pdf["_in"].to_numpy())) if pdf["_in"].any() else -1
        while i >= 0:
            met.append(i)
            i = int(to[i])
        return pdf.iloc[met][[*keys, "_p"]]

    marked = match(at, reached.withColumn("_in", F.lit(True)), [*keys, "_p"], "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    return marked.groupBy(*keys, "_block").applyInPandas(walk, T.StructType(kinds)).withColumnRenamed("_p", pos)


def first_after(df: DataFrame, probes: DataFrame, keys: Sequence[str], at: str, tie: str, info: Column, inclusive: bool) -> DataFrame:
    """Probes with `_hit`, the `info` of the first row of the key whose `at` is beyond (or, inclusive, not before) the probe's."""
    keys = list(keys)
    own = df.select(*keys, F.col(at).alias("_t"), F.lit(1).alias("_kind"), F.col(tie).alias("_tie"), info.alias("_hit"), F.lit(None).cast(probes.schema["_pos"].dataType).alias("_pos"))
    ask = probes.select(*keys, F.col(at).alias("_t"), F.lit(0 if inclusive else 2).alias("_kind"), F.col(tie).alias("_tie"), F.lit(None).cast(own.schema["_hit"].dataType).alias("_hit"), "_pos")
    line = running(own.unionByName(ask), keys, ["_t", "_kind", "_tie", "_pos"], {"_hit": ("last", F.col("_hit"))}, desc=True)
    return line.filter("_kind <> 1").select(*keys, "_pos", "_hit")
