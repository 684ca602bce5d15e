"""Half-open intervals [beg, end): joins, unions, coverage, windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .lineage import cut

#: Each level's bins are so many times as wide as those of the level below.
WIDENING, LEVELS = 32, 5


def _level(begin: Column, end: Column, width: int) -> Column:
    """The narrowest level where the interval is no longer than ``WIDENING`` bins."""
    level = F.lit(LEVELS - 1)
    for n in reversed(range(LEVELS - 1)):
        level = F.when(end - begin <= width * WIDENING ** (n + 1), F.lit(n)).otherwise(level)
    return level


def levels_of(df: DataFrame, begin: str, end: str, width: int = 128) -> list[int]:
    """Levels on which intervals of ``df`` live: one pass over it, for rows that are there already (``cut``)."""
    found = df.where(F.col(begin) < F.col(end)).agg(F.collect_set(_level(F.col(begin), F.col(end), width))).first()[0]
    return sorted(found)


def levels_up_to(longest: int, width: int = 128) -> list[int]:
    """Levels on which intervals no longer than ``longest`` live."""
    return [n for n in range(LEVELS) if n == 0 or longest > width * WIDENING**n]


def _bins(begin: Column, end: Column, width: int, own: Sequence[int], other: Sequence[int]) -> tuple[Column, Column]:
    """(level of the interval, its bins on that level and on those wider ones where the other side has any).

    It has at most one bin more than ``WIDENING`` on its own level, and one or two on each wider one:
    however long intervals are, they aren't blown up. A level that isn't among ``own`` is an error.
    """
    level = _level(begin, end, width)
    if len(own) < LEVELS:
        stray = F.raise_error(F.concat(F.lit("an interval longer than told: "), (end - begin).cast("string"))).cast("int")
        level = F.when(level.isin(*own), level).otherwise(stray) if own else stray

    def keys(n: int) -> Column:
        w = width * WIDENING**n
        bins = F.transform(F.sequence(F.floor(begin / w), F.floor((end - 1) / w)), lambda b: F.struct(F.lit(n).alias("level"), b.alias("bin")))
        lives, met = F.lit(n in own and min(other, default=LEVELS) <= n) & (F.col("_at") == n), F.lit(n in other) & (F.col("_at") < n)
        return F.when(lives | met, bins).otherwise(F.array().cast("array<struct<level:int,bin:bigint>>"))

    used = [n for n in range(LEVELS) if (n in own and min(other, default=LEVELS) <= n) or (n in other and min(own, default=LEVELS) < n)]
    return level, F.concat(F.array().cast("array<struct<level:int,bin:bigint>>"), *[keys(n) for n in used])


def overlap_join(  # noqa: E741
    left: DataFrame, right: DataFrame, on: Sequence[str], l: tuple[str, str], r: tuple[str, str], width: int = 128, levels: tuple[Sequence[int] | None, Sequence[int] | None] = (None, None),  # noqa: E741
) -> DataFrame:
    """All pairs with equal ``on`` columns whose intervals overlap; columns of both sides.

    An equi-join on (on, level, bin) with an exact recheck; a pair is taken at the wider of its
    two levels, in the bin where the overlap begins, so it comes up once. Empty intervals and
    nulls match nothing. Column names must not clash, other than ``on``.

    ``levels``: on which levels each side's intervals live (``levels_of``, ``levels_up_to``), None for
    all. Rows go to no wider level than those where the other side has any: short intervals on
    both sides come to about a row each instead of one for each level.
    """
    (lb, le), (rb, re) = l, r
    lv, rv = (list(range(LEVELS)) if x is None else list(x) for x in levels)

    def keyed(df: DataFrame, b: str, e: str, own: list[int], other: list[int], name: str) -> DataFrame:
        level, bins = _bins(F.col(b), F.col(e), width, own, other)
        each = df.where(F.col(b) < F.col(e)).withColumn("_at", level).withColumn("_k", F.explode(bins))
        return each.select("*", F.col("_k.level").alias("_level"), F.col("_k.bin").alias("_bin")).withColumnRenamed("_at", name).drop("_k")

    a, b = keyed(left, lb, le, lv, rv, "_ll"), keyed(right, rb, re, rv, lv, "_rl")
    w = F.element_at(F.array(*[F.lit(width * WIDENING**n).cast("long") for n in range(LEVELS)]), F.col("_level") + 1)
    return (
        a.join(b, [*on, "_level", "_bin"])
        .where((F.col(lb) < F.col(re)) & (F.col(rb) < F.col(le)))
        .where((F.col("_level") == F.greatest("_ll", "_rl")) & (F.col("_bin") == F.floor(F.greatest(lb, rb) / w)))
        .drop("_level", "_bin", "_ll", "_rl")
    )


def islands(df: DataFrame, keys: Sequence[str], begin: str = "beg", end: str = "end", gap: int = 0) -> DataFrame:
    """Union of the intervals of each key: keys, beg, end, n. Touching intervals merge, as do those
    no more than ``gap`` apart."""
    order = Window.partitionBy(*keys).orderBy(begin, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.where(F.col(begin) < F.col(end)).withColumn("_new", (before.isNull() | (F.col(begin) > before + gap)).cast("int"))
    numbered = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "_island").agg(F.min(begin).alias("beg"), F.max(end).alias("end"), F.count(F.lit(1)).alias("n")).drop("_island")


def covered_length(queries: DataFrame, merged: DataFrame, on: Sequence[str], q: tuple[str, str], m: tuple[str, str] = ("beg", "end"), width: int = 128) -> DataFrame:
    """Columns of ``queries`` and ``covered``: the length of each row that merged intervals cover, 0
    where none does. Rows that repeat count each."""
    lo, hi = m
    numbered = cut(queries.withColumn("_q", F.monotonically_increasing_id()))
    known = (levels_of(numbered, *q, width), None)
    hit = overlap_join(numbered.select("_q", *on, *q), merged.select(*on, F.col(lo).alias("_mb"), F.col(hi).alias("_me")), on, q, ("_mb", "_me"), width, known)
    sums = hit.groupBy("_q").agg(F.sum(F.least(q[1], "_me") - F.greatest(q[0], "_mb")).alias("covered"))
    return numbered.join(sums, "_q", "left").select(*queries.columns, F.coalesce("covered", F.lit(0)).cast("long").alias("covered"))


def coverage_runs(df: DataFrame, keys: Sequence[str], begin: str = "beg", end: str = "end") -> DataFrame:
    """Runs of equal depth above 0: keys, beg, end, depth. Neighbouring runs differ in depth.

    Ends are events of +1 and -1, summed by place first; no row is made for a base.
    """
    ok = df.where(F.col(begin) < F.col(end))
    ends = ok.select(*keys, F.col(begin).alias("at"), F.lit(1).alias("d")).unionByName(ok.select(*keys, F.col(end).alias("at"), F.lit(-1).alias("d")))
    steps = ends.groupBy(*keys, "at").agg(F.sum("d").alias("d")).where("d <> 0")
    order = Window.partitionBy(*keys).orderBy("at")
    depth = F.sum("d").over(order.rowsBetween(Window.unboundedPreceding, 0))
    return (
        steps.select(*keys, F.col("at").alias("beg"), F.lead("at").over(order).alias("end"), depth.cast("long").alias("depth")).where("depth > 0")
    )


def all_runs(runs: DataFrame, sizes: DataFrame, keys: Sequence[str], length: str) -> DataFrame:
    """Runs of equal depth (as ``coverage_runs`` gives them, inside 0 to ``length``) with those of
    depth 0 between them: keys, beg, end, depth; every place of each key in ``sizes`` is in one."""
    ends = runs.select(*keys, F.col("end").alias("_at")).unionByName(sizes.where(F.col(length) > 0).select(*keys, F.lit(0).cast("long").alias("_at")))
    begins = runs.select(*keys, F.col("beg").alias("_to")).unionByName(sizes.where(F.col(length) > 0).select(*keys, F.col(length).alias("_to")))
    n = lambda c: F.row_number().over(Window.partitionBy(*keys).orderBy(c))
    # Sorted ends and begins pair up: each gap lies between one run's end and the next one's begin.
    gaps = ends.withColumn("_n", n("_at")).join(begins.withColumn("_n", n("_to")), [*keys, "_n"]).where("_at < _to")
    return runs.select(*keys, "beg", "end", "depth").unionByName(gaps.select(*keys, F.col("_at").alias("beg"), F.col("_to").alias("end"), F.lit(0).cast("long").alias("depth")))


def run_lengths(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], value: str) -> DataFrame:
    """Runs of one value in the order of ``order_by``: keys, run, value, n."""
    order = Window.partitionBy(*keys).orderBy(*order_by)
    change = F.coalesce((~F.col(value).eqNullSafe(F.lag(value).over(order))).cast("int"), F.lit(1))
    first = F.when(F.row_number().over(order) == 1, 1).otherwise(change)
    numbered = df.withColumn("_c", first).withColumn("run", F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "run").agg(F.first(value).alias(value), F.count(F.lit(1)).alias("n"))


def windows(df: DataFrame, length: str, size: int, step: int) -> DataFrame:
    """Columns of ``df`` and beg, end: windows of ``size`` every ``step``, the last cut at ``length``."""
    starts = F.explode(F.when(F.col(length) > 0, F.sequence(F.lit(0).cast("long"), F.col(length) - 1, F.lit(step).cast("long"))))
    return df.withColumn("beg", starts).withColumn("end", F.least(F.col("beg") + size, F.col(length)))


def offsets(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], length: str, name: str = "offset") -> DataFrame:
    """Sum of the lengths before each row."""
    order = Window.partitionBy(*keys).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, (F.sum(length).over(order) - F.col(length)).cast("long"))
