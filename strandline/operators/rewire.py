"""Graphs rewired by rules, rules thinned out, and alignments of paths as alignments of their nodes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import cigar, dna, names, spans

from .lineage import cut


def _toggled(c: str) -> Column:
    return spans.toggled(F.col(c))


def junction_losers(ends: DataFrame) -> DataFrame:
    """seg, beg, end, rev: of each two neighbouring keys (in order of segment, begin, end, strand) that touch and
    whose expansions share the part at the junction the one with fewer parts; of equally many
    the shorter, or else the later. ends: a row for each key, with n, first and last (structs
    seg, beg, end, rev)."""
    order = Window.partitionBy("seg").orderBy("beg", "end", "rev")
    here = F.struct("beg", "end", "rev", "n", F.when(F.col("rev"), _toggled("first")).otherwise(F.col("last")).alias("out"))
    both = ends.withColumn("_p", F.lag(here).over(order)).withColumn("_in", F.when(F.col("rev"), _toggled("last")).otherwise(F.col("first")))
    met = both.where((F.col("_p.end") == F.col("beg")) & (F.col("_p.out") == F.col("_in")))
    size, before = F.col("end") - F.col("beg"), F.col("_p.end") - F.col("_p.beg")
    former = F.when(F.col("_p.n") != F.col("n"), F.col("_p.n") < F.col("n")).otherwise(before < size)
    own = F.struct("beg", "end", "rev")
    lost = F.when(former, F.struct("_p.beg", "_p.end", "_p.rev")).otherwise(own)
    return met.select("seg", lost.alias("x")).select("seg", "x.beg", "x.end", "x.rev").distinct()


def without_junctions(rules: DataFrame) -> DataFrame:
    """Rules (seg, beg, end, rev, ord, part: struct seg, beg, end, rev) without ``junction_losers``, until there are none.
    Each round drops a key at least, so rounds end."""
    key = ["seg", "beg", "end", "rev"]
    ends = cut(rules.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min_by("part", "ord").alias("first"), F.max_by("part", "ord").alias("last")))
    while True:
        lost = cut(junction_losers(ends))
        if not lost.limit(1).count():
            return rules.join(ends.select(*key), key, "left_semi")
        ends = cut(ends.join(lost, key, "left_anti"))


def vertex_parts(cuts: DataFrame, rules: DataFrame) -> DataFrame:
    """v, pos, n, part: what each oriented vertex becomes: the windows between a segment's cuts (seg, pos), each
    as its rule (seg, beg, end, ord, part) says or as itself; read backwards for the reversed one."""
    after = F.lead("pos").over(Window.partitionBy("seg").orderBy("pos"))
    windows = cuts.select("seg", "pos").distinct().select("seg", F.col("pos").alias("beg"), after.alias("end")).where("end IS NOT NULL")
    itself = F.struct("seg", "beg", "end", F.lit(False).alias("rev"))
    said = windows.join(rules.select("seg", "beg", "end", "ord", "part"), ["seg", "beg", "end"], "left").withColumn("part", F.coalesce("part", itself))
    seg = Window.partitionBy("seg")
    up = said.select("seg", (F.row_number().over(seg.orderBy("beg", "ord")) - 1).alias("pos"), F.count(F.lit(1)).over(seg).alias("n"), "part")
    forward = up.select((F.col("seg") * 2).alias("v"), F.col("pos").cast("long").alias("pos"), "n", "part")
    back = up.select((F.col("seg") * 2 + 1).alias("v"), (F.col("n") - 1 - F.col("pos")).alias("pos"), "n", _toggled("part").alias("part"))
    return forward.unionByName(back)


def rewired(arcs: DataFrame, parts: DataFrame) -> DataFrame:
    """a, b: distinct arcs between parts (structs seg, beg, end, rev) that follow one another in the expansions of arcs
    (v, w) without overlap, source and target end to end.

    What follows inside a vertex is the same for all its arcs, so it is taken once for each vertex that has
    an arc; only the last and first parts meet by arc. An arc with an overlap is an error.
    """
    bad = (F.col("ov") > 0) | (F.col("ow") > 0)
    plain = arcs.select("v", F.when(bad, F.raise_error(F.lit("an arc still overlaps"))).otherwise(F.col("w")).cast("long").alias("w"))
    used = plain.select("v").unionByName(plain.select(F.col("w").alias("v"))).distinct()
    after = F.lead("part").over(Window.partitionBy("v").orderBy("pos"))
    inside = parts.join(used, "v", "left_semi").select(F.col("part").alias("a"), after.alias("b")).where("b IS NOT NULL")
    last = parts.where("pos = n - 1").select("v", F.col("part").alias("a"))
    first = parts.where("pos = 0").select(F.col("v").alias("w"), F.col("part").alias("b"))
    return inside.unionByName(plain.join(last, "v").join(first, "w").select("a", "b")).distinct()


def part_segments(arcs: DataFrame, segments: DataFrame) -> DataFrame:
    """seg, beg, end, name, seq: the parts of ``rewired`` as segments, named by their interval, with the forward
    slice of their segment (seg_id, name, seq)."""
    each = arcs.select(F.col("a").alias("x")).unionByName(arcs.select(F.col("b").alias("x"))).select("x.seg", "x.beg", "x.end").distinct()
    known = each.join(segments.select(F.col("seg_id").alias("seg"), F.col("name").alias("_n"), F.col("seq").alias("_s")), "seg")
    return known.select("seg", "beg", "end", names.interval_name(F.col("_n"), F.col("beg"), F.col("end"), F.lit(False)).alias("name"), dna.slice_of(F.col("_s"), F.col("beg"), F.col("end"), F.lit(False)).alias("seq"))


def split_at_nodes(aligns: DataFrame, path_a: DataFrame, path_b: DataFrame) -> DataFrame:
    """aln, part, v_a, beg_a, end_a, v_b, beg_b, end_b, cigar: alignments (aln, beg_a, beg_b, cigar) of two paths (aln,
    pos, v, length: nodes end to end) cut where either reaches the end of a node; places count on
    the forward node. D moves along a alone, I along b alone.

    Each operation is cut at the borders that it passes; a window over an alignment's pieces counts the ends
    of nodes reached before. What moves along one side stands on the node of the other that comes next.
    An operation ends where a path that it moves along does.
    """
    side = lambda p, x: p.groupBy("aln").agg(F.array_sort(F.collect_list(F.struct("pos", "v", F.col("length").cast("long").alias("n")))).alias(f"_{x}"))
    offsets = lambda c: F.aggregate(c, F.array(F.lit(0).cast("long")), lambda acc, y: F.concat(acc, F.array(F.element_at(acc, -1) + y["n"])))
    own = aligns.join(side(path_a, "a"), "aln").join(side(path_b, "b"), "aln").withColumn("_oa", offsets(F.col("_a"))).withColumn("_ob", offsets(F.col("_b")))
    zero = F.struct(F.col("beg_a").cast("long").alias("a"), F.col("beg_b").cast("long").alias("b"), F.array().cast("array<struct<a:bigint,b:bigint,len:bigint,op:string,on_a:boolean,on_b:boolean>>").alias("done"))

    def walk(acc: Column, x: Column) -> Column:
        both = x["op"].isin("M", "=", "X")
        on_a, on_b = both | (x["op"] == "D"), both | (x["op"] == "I")
        left = lambda s, on: F.when(on, F.element_at(F.col(f"_o{s}"), -1) - acc[s])  # noqa: E731  what the path still holds
        n = F.greatest(F.least(x["len"], left("a", on_a), left("b", on_b)), F.lit(0))
        one = F.struct(acc["a"].alias("a"), acc["b"].alias("b"), n.alias("len"), x["op"].alias("op"), on_a.alias("on_a"), on_b.alias("on_b"))
        return F.struct((acc["a"] + F.when(on_a, n).otherwise(0)).alias("a"), (acc["b"] + F.when(on_b, n).otherwise(0)).alias("b"), F.when((n > 0) & (on_a | on_b), F.concat(acc["done"], F.array(one))).otherwise(acc["done"]).alias("done"))

    runs = own.select("aln", "_a", "_b", "_oa", "_ob", F.posexplode(F.aggregate(cigar.ops(F.col("cigar")), zero, walk, lambda acc: acc["done"])).alias("_i", "x"))
    inside = lambda offs, at, on: F.filter(F.transform(offs, lambda o: o - at), lambda d: on & (d > 0) & (d < F.col("x.len")))
    at = F.array_distinct(F.array_sort(F.concat(F.array(F.lit(0).cast("long"), F.col("x.len")), inside(F.col("_oa"), F.col("x.a"), F.col("x.on_a")), inside(F.col("_ob"), F.col("x.b"), F.col("x.on_b")))))
    cutted = runs.withColumn("_at", at).withColumn("_d", F.explode(F.transform(F.slice("_at", F.lit(1), F.size("_at") - 1), lambda d, i: F.struct(d.alias("from"), F.get(F.col("_at"), i + 1).alias("to")))))
    step = F.col("_d.to") - F.col("_d.from")
    moved = lambda s: F.col(f"x.{s}") + F.when(F.col(f"x.on_{s}"), F.col("_d.from")).otherwise(0)
    piece = cutted.select("aln", "_a", "_b", "_oa", "_ob", "_i", F.col("_d.from").alias("_j"), F.col("x.op").alias("op"), step.alias("len"), moved("a").alias("a"), moved("b").alias("b"), F.when(F.col("x.on_a"), step).otherwise(0).alias("da"), F.when(F.col("x.on_b"), step).otherwise(0).alias("db"))
    node = lambda s: F.least(F.size(F.filter(F.col(f"_o{s}"), lambda o: o <= F.col(s))) - 1, F.size(f"_{s}") - 1)
    on = piece.withColumn("_na", node("a")).withColumn("_nb", node("b"))
    border = lambda s: (F.col(f"d{s}") > 0) & (F.get(F.col(f"_o{s}"), F.col(f"_n{s}") + 1) == F.col(s) + F.col(f"d{s}"))
    order = Window.partitionBy("aln").orderBy("_i", "_j").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.coalesce(F.sum((border("a") | border("b")).cast("long")).over(order), F.lit(0))
    told = on.withColumn("_g", ended)
    each = told.groupBy("aln", "_g").agg(
        *[F.min_by(F.struct(F.get(F.col(f"_{s}"), F.col(f"_n{s}"))["v"].alias("v"), F.get(F.col(f"_{s}"), F.col(f"_n{s}"))["n"].alias("n"), (F.col(s) - F.get(F.col(f"_o{s}"), F.col(f"_n{s}"))).alias("at")), F.struct("_i", "_j")).alias(f"s{s}") for s in "ab"],
        F.sum("da").alias("na"), F.sum("db").alias("nb"), F.transform(F.array_sort(F.collect_list(F.struct("_i", "_j", "len", "op"))), lambda y: F.struct(y["len"].alias("len"), y["op"].alias("op"))).alias("ops"),
    )

    def ends(s: str) -> list[Column]:
        n, lo, hi = F.col(f"s{s}.n"), F.col(f"s{s}.at"), F.col(f"s{s}.at") + F.col(f"n{s}")
        back = F.col(f"s{s}.v").bitwiseAND(F.lit(1).cast("long")) == 1
        return [F.col(f"s{s}.v").alias(f"v_{s}"), F.when(back, n - hi).otherwise(lo).alias(f"beg_{s}"), F.when(back, n - lo).otherwise(hi).alias(f"end_{s}")]

    number = F.row_number().over(Window.partitionBy("aln").orderBy("_g")) - 1
    return each.select("aln", number.alias("part"), *ends("a"), *ends("b"), cigar.pack(cigar.merge_runs(F.col("ops"))).alias("cigar"))
