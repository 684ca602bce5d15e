"""What stands beside a vertex of a sequence graph: greedy walks to either side."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import dna, names

from .graph import segment
from .lineage import cut

#: Steps of a walk, at most.
STEPS = 10_000


def best_neighbours(segments: DataFrame, arcs: DataFrame, left: bool) -> DataFrame:
    """v, to, new, skip: where a walk goes on from each vertex, to its right over out-arcs or to its left
    over in-arcs. ``new`` is what the neighbour adds (its length less the overlap; unknown
    overlaps are none), ``skip`` the overlap on the neighbour.

    A neighbour that shares a root of its name goes before others, then more new bases, then the
    arc with the lesser number (link_id); neighbours that add nothing are not taken.
    """
    here, there, lap = ("w", "v", "ov") if left else ("v", "w", "ow")
    size = segments.select(F.col("seg_id").alias("_t"), F.col("length").alias("_n"), names.roots(F.col("name")).alias("_tr"))
    own = segments.select(F.col("seg_id").alias("_h"), names.roots(F.col("name")).alias("_hr"))
    near = arcs.select(F.col(here).alias("v"), F.col(there).alias("to"), F.coalesce(F.greatest(F.col(lap), F.lit(0)), F.lit(0)).alias("skip"), "link_id")
    known = near.join(size, segment("to") == F.col("_t")).join(own, segment("v") == F.col("_h")).withColumn("new", F.col("_n") - F.col("skip")).where("new > 0")
    order = Window.partitionBy("v").orderBy(F.desc(F.arrays_overlap("_hr", "_tr")), F.desc("new"), "link_id", "to")
    return known.withColumn("_r", F.row_number().over(order)).where("_r = 1").select("v", "to", "new", "skip")


def flanks(segments: DataFrame, arcs: DataFrame, starts: DataFrame, left: bool) -> DataFrame:
    """start, seq: bases beside each start (column start, a vertex, and need), ``need`` of them where
    the graph has so many. To the left the ends next to the boundary are taken, to the right what
    follows the overlaps. A walk stops at a segment without sequence, or after ``STEPS`` steps.
    All walks go on together, a join a step, so there are as many rounds as the longest has steps.
    Rounds move numbers alone, and no side of theirs goes by way of the driver, however small it gets: there may be
    many of them. Sequences are joined once, behind the last step.
    """
    known = segments.where("seq IS NOT NULL AND seq <> '*'").select(F.col("seg_id").alias("_s"), "seq")
    best = cut(best_neighbours(segments, arcs, left).join(known.select("_s"), segment("to") == F.col("_s"), "left_semi"))
    front = starts.select("start", "need", F.col("start").alias("v"), F.lit(0).cast("long").alias("have"))
    found = None
    for step in range(STEPS):
        take = F.least(F.col("new"), F.col("need") - F.col("have"))
        first = F.when(F.lit(left), F.col("new") - take).otherwise(F.col("skip"))
        on = front.where("have < need").join(best.hint("merge"), "v")
        on = cut(on.select("start", "need", F.col("to").alias("v"), (F.col("have") + take).alias("have"), first.alias("first"), take.alias("take")))
        way = on.select("start", F.lit(-step if left else step).alias("at"), "v", "first", "take")
        found = way if found is None else found.unionByName(way)
        front = on.select("start", "need", "v", "have")
        if not front.limit(1).count():
            break
    whole = dna.oriented(F.col("seq"), F.col("v").bitwiseAND(F.lit(1).cast("long")) == 1)
    pieces = found.join(known, segment("v") == F.col("_s")).select("start", "at", F.substr(whole, (F.col("first") + 1).cast("int"), F.col("take").cast("int")).alias("piece"))
    return pieces.groupBy("start").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "piece"))), lambda x: x["piece"]), "").alias("seq"))


def with_flanks(segments: DataFrame, arcs: DataFrame, flank: int, short: int) -> DataFrame:
    """name, seq of segments; those shorter than ``short`` get up to ``flank`` bases on either side."""
    starts = segments.where((F.col("length") < short) & F.col("seq").isNotNull()).select((F.col("seg_id") * 2).alias("start"), F.lit(flank).cast("long").alias("need"))
    sides = [flanks(segments, arcs, starts, side).select(F.shiftright("start", 1).alias("seg_id"), F.col("seq").alias(c)) for side, c in ((True, "_l"), (False, "_r"))]
    both = segments.where("seq IS NOT NULL").join(sides[0], "seg_id", "left").join(sides[1], "seg_id", "left")
    return both.select("name", F.concat(F.coalesce("_l", F.lit("")), "seq", F.coalesce("_r", F.lit(""))).alias("seq"))


def with_right_context(segments: DataFrame, arcs: DataFrame, k: int) -> DataFrame:
    """name, seq, length: sequences with the k - 1 bases to their right, so that k-mers over the junction
    are whole; length is the segment's own."""
    starts = segments.where("seq IS NOT NULL").select((F.col("seg_id") * 2).alias("start"), F.lit(k - 1).cast("long").alias("need"))
    right = flanks(segments, arcs, starts, False).select(F.shiftright("start", 1).alias("seg_id"), F.col("seq").alias("_r"))
    return segments.where("seq IS NOT NULL").join(right, "seg_id", "left").select("name", F.concat("seq", F.coalesce("_r", F.lit(""))).alias("seq"), "length")
