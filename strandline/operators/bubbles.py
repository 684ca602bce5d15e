"""Bubbles of a sequence graph: sources whose branches meet again in one sink.

arcs: v, w. A bubble's paths are rows (bubble, path, pos, v), its source at pos 0, its sink last.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import segment
from .lineage import cut

#: Steps that a branch may take to lead to a sink without a choice.
TUNNEL = 4


def _real(arcs: DataFrame) -> DataFrame:
    return arcs.where("v <> w").select("v", "w").distinct()


def leaks(arcs: DataFrame, tunnel: int = TUNNEL) -> DataFrame:
    """w, v: arcs whose source has several ways out, not all of which lead to w without a choice in at
    most ``tunnel`` further steps."""
    real = cut(_real(arcs))
    ways = real.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    only = real.join(ways.where("n = 1").select("v"), "v", "left_semi").select(F.col("v").alias("_u"), F.col("w").alias("_n"))
    several = real.join(ways.where("n > 1").select("v"), "v", "left_semi")
    # Each way out with all that it leads to without a choice.
    ahead = several.select("v", F.col("w").alias("x"), F.col("w").alias("at"), F.array("w").alias("sees"))
    for _ in range(tunnel):
        ahead = ahead.join(only, F.col("at") == F.col("_u"), "left").select("v", "x", F.col("_n").alias("at"), F.when(F.col("_n").isNull(), F.col("sees")).otherwise(F.concat("sees", F.array("_n"))).alias("sees"))
    missed = several.join(ahead.select("v", "sees"), "v").where(~F.array_contains("sees", F.col("w")))
    return missed.select("w", "v").distinct()


def strict_sinks(arcs: DataFrame, pairs: DataFrame, tunnel: int = TUNNEL) -> DataFrame:
    """Of pairs (source, sink) those whose sink no vertex but the source leaks past (``leaks``)."""
    return _strict(pairs.withColumnRenamed("sink", "v"), leaks(arcs, tunnel)).withColumnRenamed("v", "sink")


def branches(arcs: DataFrame, most: int = 64) -> DataFrame:
    """source, branch, v: the first vertex of each target segment, in order of the vertices, of sources
    with 2 to ``most`` of them."""
    one = _real(arcs).groupBy(F.col("v").alias("source"), segment("w").alias("_s")).agg(F.min("w").alias("v"))
    n = Window.partitionBy("source")
    ranked = one.withColumn("branch", F.row_number().over(n.orderBy("v")) - 1).withColumn("_n", F.count(F.lit(1)).over(n))
    return ranked.where(F.col("_n").between(2, most)).select("source", "branch", "v", F.col("_n").alias("n_branches"))


def complex_sources(arcs: DataFrame, sources: DataFrame, hub: int, depth: int, most_nodes: int, most_forks: int, fork: int = 3) -> DataFrame:
    """source: those beside a hub (the source, or a vertex behind it, with ``hub`` ways out or more), or
    with more than ``most_nodes`` vertices, or more than ``most_forks`` of ``fork`` ways out or
    more, within ``depth`` arcs."""
    real = cut(_real(arcs))
    ways = real.groupBy("v").agg(F.count(F.lit(1)).alias("n"))
    seen = front = cut(sources.select("source", F.col("source").alias("v"), F.lit(0).alias("d")).distinct())
    for d in range(1, depth + 1):
        front = cut(front.join(real, "v").select("source", F.col("w").alias("v")).distinct().join(seen.select("source", "v"), ["source", "v"], "left_anti").withColumn("d", F.lit(d)))
        seen = seen.unionByName(front)
    told = seen.join(ways, "v", "left").groupBy("source").agg(
        F.count(F.lit(1)).alias("nodes"), F.count_if(F.col("n") >= fork).alias("forks"), F.max(F.when(F.col("d") <= 1, F.col("n"))).alias("near")
    )
    return told.where((F.col("near") >= hub) | (F.col("nodes") > most_nodes) | (F.col("forks") > most_forks)).select("source")


def closed(arcs: DataFrame, limit: int, most: int = 64, skip: DataFrame | None = None) -> DataFrame:
    """source, sink, depth: for each source the first vertex that all its branches reach within
    ``limit`` arcs from their first vertices and that is a strict sink.

    Branches go breadth first side by side. What comes first is told by depth, then branch, then the
    ways taken in order of their targets, so that no queue is needed: each state (source, branch,
    vertex) keeps its first arrival, a vertex is met when the last branch arrives, and the strict
    sink that is met first wins. Sources in ``skip`` (column source) are left out.
    """
    real = cut(_real(arcs))
    turn = F.row_number().over(Window.partitionBy("v").orderBy("w"))
    step = cut(real.select("v", F.col("w").alias("_to"), turn.alias("_i")))
    start = branches(arcs, most)
    start = start if skip is None else start.join(skip, "source", "left_anti")
    seen = front = cut(start.select("source", "branch", "v", "n_branches", F.lit(0).alias("depth"), F.array(F.col("branch").cast("int")).alias("key")))
    bad = cut(leaks(arcs))
    found = None
    for depth in range(1, limit + 1):
        arrive = front.where("v <> source").join(step, "v").select("source", "branch", F.col("_to").alias("v"), "n_branches", F.lit(depth).alias("depth"), F.concat("key", F.array("_i")).alias("key"))
        first = arrive.groupBy("source", "branch", "v", "n_branches", "depth").agg(F.min("key").alias("key"))
        front = cut(first.join(seen.select("source", "branch", "v"), ["source", "branch", "v"], "left_anti"))
        seen = cut(seen.unionByName(front.select(*seen.columns)))
        met = seen.where("v <> source").groupBy("source", "v", "n_branches").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("depth", "key")).alias("last")).where((F.col("n") == F.col("n_branches")) & (F.col("last.depth") == depth))
        sinks = cut(_strict(met, bad).groupBy("source").agg(F.min(F.struct("last", "v")).alias("x")).select("source", F.col("x.v").alias("sink"), F.lit(depth).alias("depth")))
        found = sinks if found is None else found.unionByName(sinks)
        front, seen = (x.join(sinks.select("source"), "source", "left_anti") for x in (front, seen))
        if not front.limit(1).count():
            break
    return found


def _strict(met: DataFrame, bad: DataFrame) -> DataFrame:
    leak = bad.select(F.col("w").alias("_sink"), F.col("v").alias("_by"))
    return met.join(leak, (F.col("_sink") == F.col("v")) & (F.col("_by") != F.col("source")), "left_anti")


def once(bubbles: DataFrame) -> DataFrame:
    """Of bubbles between the same two segments, either way round, that of the least source."""
    a, b = segment("source"), segment("sink")
    best = Window.partitionBy(F.least(a, b), F.greatest(a, b)).orderBy("source", "sink")
    return bubbles.withColumn("_r", F.row_number().over(best)).where("_r = 1").drop("_r")


def paths(arcs: DataFrame, bubbles: DataFrame, longest: int) -> DataFrame:
    """bubble, path, pos, v: the ways from source to sink of at most ``longest`` arcs that meet no
    segment twice, in order (bubbles: bubble, source, sink)."""
    real = cut(_real(arcs))
    walk = bubbles.select("bubble", "sink", F.col("source").alias("v"), F.array("source").alias("way"))
    done = None
    for _ in range(longest):
        walk = cut(walk.join(real, "v").where(~F.exists("way", lambda x: F.shiftright(x, 1) == segment("w"))).select("bubble", "sink", F.col("w").alias("v"), F.concat("way", F.array("w")).alias("way")))
        ended = walk.where("v = sink").select("bubble", "way")
        done = ended if done is None else done.unionByName(ended)
        walk = walk.where("v <> sink")
        if not walk.limit(1).count():
            break
    numbered = done.withColumn("path", F.row_number().over(Window.partitionBy("bubble").orderBy(F.size("way"), "way")))
    return numbered.select("bubble", "path", F.posexplode("way").alias("pos", "v"))


def inner_counts(ways: DataFrame, bubbles: DataFrame, sizes: DataFrame) -> DataFrame:
    """bubble, inner_nodes, inner_bp: segments on a bubble's paths but the source's and the sink's
    (sizes: seg_id, length)."""
    segs = ways.select("bubble", segment("v").alias("seg_id")).distinct().join(bubbles, "bubble").where((F.col("seg_id") != segment("source")) & (F.col("seg_id") != segment("sink")))
    told = segs.join(sizes, "seg_id", "left").groupBy("bubble").agg(F.count(F.lit(1)).alias("inner_nodes"), F.sum(F.coalesce("length", F.lit(0))).cast("long").alias("inner_bp"))
    return bubbles.select("bubble").join(told, "bubble", "left").select("bubble", F.coalesce("inner_nodes", F.lit(0)).cast("long").alias("inner_nodes"), F.coalesce("inner_bp", F.lit(0)).cast("long").alias("inner_bp"))


def local(arcs: DataFrame, ways: DataFrame) -> DataFrame:
    """bubble: those whose vertices, but the source and the paths' ends, have no arc, in or out, with a
    segment that is on none of the bubble's paths."""
    real = cut(_real(arcs))
    ends = ways.groupBy("bubble", "path").agg(F.max_by("v", "pos").alias("v"))
    inner = ways.where("pos > 0").select("bubble", "v").distinct().join(ends.select("bubble", "v").distinct(), ["bubble", "v"], "left_anti").join(ways.where("pos = 0").select("bubble", "v").distinct(), ["bubble", "v"], "left_anti")
    beside = inner.join(real, "v").select("bubble", segment("w").alias("s")).unionByName(inner.join(real.select(F.col("w").alias("v"), F.col("v").alias("u")), "v").select("bubble", segment("u").alias("s")))
    leaky = beside.distinct().join(ways.select("bubble", segment("v").alias("s")).distinct(), ["bubble", "s"], "left_anti").select("bubble").distinct()
    return ways.select("bubble").distinct().join(leaky, "bubble", "left_anti")


def profiles(ways: DataFrame, sizes: DataFrame) -> DataFrame:
    """bubble, path, profile (bases by segment), bp: what each path is made of."""
    each = ways.join(sizes.select("seg_id", "length"), segment("v") == F.col("seg_id")).groupBy("bubble", "path", "seg_id").agg(F.sum("length").cast("long").alias("n"))
    return each.groupBy("bubble", "path").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("seg_id", "n")))).alias("profile"), F.sum("n").cast("long").alias("bp"))


def difference(a: Column, a_bp: Column, b: Column, b_bp: Column) -> Column:
    """1 less the bases that two profiles share for each base that either has; 1 where one has none."""
    shared = F.aggregate(F.map_entries(a), F.lit(0).cast("long"), lambda acc, e: acc + F.least(e["value"], F.coalesce(F.try_element_at(b, e["key"]), F.lit(0))))
    return F.when((a_bp == 0) | (b_bp == 0), F.lit(1.0)).otherwise(1 - shared / (a_bp + b_bp - shared))


def representatives(told: DataFrame, most: float) -> DataFrame:
    """bubble, path: the longest of each group of alike paths. Longest first, a path joins the first
    representative that it differs from by at most ``most``, or becomes one; paths without bases
    stand for nothing, unless the bubble has one path alone. A bubble's paths, bounded by their
    enumeration, are folded in one expression."""
    item = F.struct((-F.col("bp")).alias("back"), F.col("path").alias("path"), F.col("bp").alias("bp"), F.col("profile").alias("profile"))
    listed = told.groupBy("bubble").agg(F.collect_list(item).alias("x"))
    ordered = F.array_sort("x", lambda a, b: F.when(a["back"] != b["back"], F.signum(a["back"] - b["back"])).otherwise(F.signum(a["path"] - b["path"])).cast("int"))
    none = F.slice("x", F.lit(1), F.lit(0))
    alike = lambda acc, p: F.exists(acc, lambda r: difference(p["profile"], p["bp"], r["profile"], r["bp"]) <= most)
    kept = F.aggregate(ordered, none, lambda acc, p: F.when((p["bp"] == 0) | alike(acc, p), acc).otherwise(F.concat(acc, F.array(p))))
    return listed.select("bubble", F.explode(F.when(F.size("x") == 1, F.col("x")).otherwise(kept)).alias("r")).select("bubble", "r.path")


def nearest_tips(reach: DataFrame) -> DataFrame:
    """a, b, node, most, total: tips that are each other's nearest (a < b), and the vertex where they meet;
    reach: tip, v, dist (the way back from each tip).

    Nearness is the greater of both distances, then their sum, then the other tip, then the vertex. At a
    vertex a tip's nearest is the one that is least far from it, so the two least far suffice there
    and no vertex that many tips lead to makes all their pairs.
    """
    near = reach.groupBy("v").agg(F.min(F.struct("dist", "tip")).alias("one"))
    rest = reach.join(near, "v").where(F.col("tip") != F.col("one.tip")).groupBy("v").agg(F.min(F.struct("dist", "tip")).alias("two"))
    told = reach.join(near, "v").join(rest, "v", "left").withColumn("o", F.when(F.col("tip") == F.col("one.tip"), F.col("two")).otherwise(F.col("one"))).where("o IS NOT NULL")
    key = F.struct(F.greatest("dist", "o.dist").alias("most"), (F.col("dist") + F.col("o.dist")).alias("total"), F.col("o.tip").alias("other"), F.col("v").alias("node"))
    best = cut(told.groupBy("tip").agg(F.min(key).alias("x")).select("tip", "x.*"))
    back = best.select(F.col("tip").alias("other"), F.col("other").alias("tip"))
    return best.where("tip < other").join(back, ["tip", "other"], "left_semi").select(F.col("tip").alias("a"), F.col("other").alias("b"), "node", "most", "total")


def back_reach(arcs: DataFrame, tips: DataFrame, limit: int) -> DataFrame:
    """tip, v, dist: vertices that lead to a tip (column v) in at most ``limit`` arcs, fewest first."""
    from .graph import reach

    turned = _real(arcs).select(F.col("w").alias("v"), F.col("v").alias("w"))
    return reach(turned, tips, limit).select(F.col("start").alias("tip"), "v", F.col("hops").alias("dist"))


def open_bubbles(arcs: DataFrame, tips: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Bubbles that end in two tips: bubble (the lesser tip), source, a, b; and the ways from the source to
    each of them (bubble, path, pos, v) of at most ``limit`` arcs."""
    pairs = cut(nearest_tips(back_reach(arcs, tips, limit)).select(F.col("a").alias("bubble"), F.col("node").alias("source"), "a", "b"))
    key = F.struct("bubble", "end")
    ends = pairs.select("bubble", "source", F.explode(F.array("a", "b")).alias("end")).where("source <> end")
    ways = paths(arcs, ends.select(key.alias("bubble"), "source", F.col("end").alias("sink")), limit)
    number = F.dense_rank().over(Window.partitionBy("bubble.bubble").orderBy("bubble.end", "path"))
    return pairs, ways.withColumn("_n", number).select(F.col("bubble.bubble").alias("bubble"), F.col("_n").alias("path"), "pos", "v")
