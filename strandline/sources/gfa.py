"""Graph files: S, L, P and A lines; others are passed over."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import cigar
from strandline.operators import graph
from strandline.operators.lineage import cut

from .lines import lines, rest, tag, tag_text, tags, write_lines


@dataclass
class Graph:
    """segments: seg_id, name, seq (null: unknown), length, tags. arcs: v, w, ov, ow, lv, link_id,
    comp, rank. paths: name, pos, seg_id, rev. placements: seg_id, pos, read_rev, read_name,
    read_start, read_end, tags (as text). ranks: max_rank of segments and links, one row. Segment
    ids rise in order of first mention; they are not dense."""

    segments: DataFrame
    arcs: DataFrame
    paths: DataFrame
    placements: DataFrame
    ranks: DataFrame


def _overlap(text: Column) -> tuple[Column, Column]:
    """(ov, ow) of an overlap field: *, N, :OW, OV:OW or a CIGAR."""
    number, pair = F.rlike(text, F.lit("^[0-9]+$")), F.rlike(text, F.lit("^[0-9]*:[0-9]+$"))
    parsed = cigar.ops(text)
    parts = F.split(text, ":")
    whole = F.rlike(text, F.lit("^([0-9]+[MIDNSHP=X])+$"))
    ov = F.when(number, text.cast("long")).when(pair, F.when(parts[0] != "", parts[0].try_cast("long"))).when(whole, cigar.ref_span(parsed))
    ow = F.when(number, text.cast("long")).when(pair, F.get(parts, F.lit(1)).try_cast("long")).when(whole, cigar.query_span_aligned(parsed))
    return ov, ow


def read_gfa(spark: SparkSession, path: str | list[str], finalise: bool = True) -> Graph:
    return parse_gfa(lines(spark, path), finalise)


def parse_gfa(text: DataFrame, finalise: bool = True) -> Graph:
    """A graph from lines (value, ord). LN gives the length where it is present; L1 and L2 of links lengthen their
    segments; names in P and A lines that no S or L line has are passed over. ``finalise`` makes the
    graph consistent (``operators.graph.finalise``)."""
    rows = cut(text.where(F.rlike("value", F.lit("^[SLPA]\t"))).select("ord", F.split(F.rtrim("value", F.lit("\r")), "\t").alias("f")))
    s = rows.where(F.get("f", F.lit(0)) == "S").select("ord", F.get("f", F.lit(1)).alias("name"), F.get("f", F.lit(2)).alias("seq"), tags(rest(F.col("f"), 3)).alias("tags"))
    l = rows.where((F.get("f", F.lit(0)) == "L") & (F.size("f") >= 5)).select(  # noqa: E741
        "ord", F.get("f", F.lit(1)).alias("a"), F.get("f", F.lit(2)).alias("ao"), F.get("f", F.lit(3)).alias("b"), F.get("f", F.lit(4)).alias("bo"), F.coalesce(F.get("f", F.lit(5)), F.lit("*")).alias("o"), tags(rest(F.col("f"), 6)).alias("tags")
    )
    far = F.lit(1 << 60).cast("long")
    named = s.select("name", F.col("ord").alias("at")).unionByName(l.select(F.explode(F.array(F.struct(F.col("a").alias("name"), (F.col("ord") * 2 + far).alias("at")), F.struct(F.col("b").alias("name"), (F.col("ord") * 2 + 1 + far).alias("at")))).alias("x")).select("x.*"))
    ids = named.groupBy("name").agg(F.min("at").alias("seg_id"))
    first = s.groupBy("name").agg(F.min_by(F.struct("seq", "tags"), "ord").alias("x")).select("name", "x.*")
    more = l.select(F.explode(F.array(F.struct(F.col("a").alias("name"), tag(F.col("tags"), "L1").try_cast("long").alias("n")), F.struct(F.col("b").alias("name"), tag(F.col("tags"), "L2").try_cast("long").alias("n")))).alias("x")).select("x.*")
    more = more.where("n IS NOT NULL").groupBy("name").agg(F.max("n").alias("grown"))
    known = F.when(F.col("seq") != "*", F.char_length("seq"))
    own = F.coalesce(tag(F.col("tags"), "LN").try_cast("long"), known.cast("long"), F.lit(0).cast("long"))
    segments = ids.join(first, "name", "left").join(more, "name", "left").select(
        "seg_id", "name", F.when(F.col("seq") != "*", F.col("seq")).alias("seq"), F.greatest(own, F.coalesce("grown", F.lit(0))).cast("long").alias("length"),
        F.map_filter(F.coalesce("tags", F.create_map().cast("map<string,struct<type:string,value:string>>")), lambda k, _: ~k.isin("LN", "SR")).alias("tags"),
    )
    ov, ow = _overlap(F.col("o"))
    v, w = ids.select(F.col("name").alias("a"), F.col("seg_id").alias("_v")), ids.select(F.col("name").alias("b"), F.col("seg_id").alias("_w"))
    arcs = l.join(v, "a").join(w, "b").select(
        (F.col("_v") * 2 + (F.col("ao") == "-").cast("long")).alias("v"), (F.col("_w") * 2 + (F.col("bo") == "-").cast("long")).alias("w"), ov.alias("ov"), ow.alias("ow"), F.col("ord").alias("link_id")
    )
    steps = rows.where(F.get("f", F.lit(0)) == "P").select(F.get("f", F.lit(1)).alias("path"), F.posexplode(F.split(F.get("f", F.lit(2)), ",")).alias("pos", "step"))
    steps = steps.select("path", "pos", F.expr("left(step, length(step) - 1)").alias("name"), F.endswith("step", F.lit("-")).alias("rev"))
    paths = steps.join(ids, "name").select(F.col("path").alias("name"), "pos", "seg_id", "rev")
    a = rows.where(F.get("f", F.lit(0)) == "A").select(
        F.get("f", F.lit(1)).alias("name"), F.get("f", F.lit(2)).try_cast("long").alias("pos"), (F.get("f", F.lit(3)) == "-").alias("read_rev"), F.get("f", F.lit(4)).alias("read_name"), F.get("f", F.lit(5)).try_cast("long").alias("read_start"), F.get("f", F.lit(6)).try_cast("long").alias("read_end"), F.array_join(rest(F.col("f"), 7), "\t").alias("tags")
    )
    placements = a.join(ids, "name").drop("name")
    rank = l.select(F.col("ord").alias("link_id"), tag(F.col("tags"), "SR").try_cast("int").alias("rank"))
    if finalise:
        segments, arcs = graph.finalise(segments, arcs)
    ranks = s.select(tag(F.col("tags"), "SR").try_cast("int").alias("rank")).unionByName(rank.select("rank")).agg(F.max("rank").alias("max_rank"))
    return Graph(segments, arcs.join(rank, "link_id", "left"), paths, placements, ranks)


def overlap_field(ov: Column, ow: Column) -> Column:
    return F.when(ov.isNull() | ow.isNull(), F.lit("*")).when(ov == ow, F.concat(ov.cast("string"), F.lit("M"))).otherwise(F.concat_ws(":", ov.cast("string"), ow.cast("string")))


def gfa_lines(g: Graph, sequences: bool = True) -> DataFrame:
    """line, section, ord: S lines (always with LN), then L lines of arcs that are no complements,
    then P and A lines."""
    seq = F.coalesce("seq", F.lit("*")) if sequences else F.lit("*")
    s = g.segments.select(F.concat_ws("\t", F.lit("S"), "name", seq, F.concat(F.lit("LN:i:"), F.col("length")), F.nullif(tag_text(F.col("tags")), F.lit(""))).alias("line"), F.lit(0).alias("section"), F.col("seg_id").alias("ord"))
    name = lambda c: g.segments.select(F.col("seg_id").alias(f"_{c}"), F.col("name").alias(f"n{c}"))
    sign = lambda c: F.when(F.col(c).bitwiseAND(F.lit(1).cast("long")) == 1, "-").otherwise("+")
    real = g.arcs.where("NOT comp").withColumn("_v", graph.segment("v")).withColumn("_w", graph.segment("w")).join(name("v"), "_v").join(name("w"), "_w")
    l = real.select(F.concat_ws("\t", F.lit("L"), "nv", sign("v"), "nw", sign("w"), overlap_field(F.col("ov"), F.col("ow"))).alias("line"), F.lit(1).alias("section"), F.col("link_id").alias("ord"))  # noqa: E741
    named = g.paths.join(g.segments.select("seg_id", F.col("name").alias("n")), "seg_id").withColumn("step", F.concat("n", F.when(F.col("rev"), "-").otherwise("+")))
    listed = named.groupBy("name").agg(F.array_sort(F.collect_list(F.struct("pos", "step"))).alias("x"))
    p = listed.select(F.concat_ws("\t", F.lit("P"), "name", F.array_join(F.transform("x", lambda y: y["step"]), ","), F.lit("*")).alias("line"), F.lit(2).alias("section"), F.xxhash64("name").alias("ord"))
    read = F.concat_ws("\t", F.lit("A"), "n", F.col("pos"), F.when(F.col("read_rev"), "-").otherwise("+"), "read_name", "read_start", "read_end", F.nullif("tags", F.lit("")))
    a = g.placements.join(g.segments.select("seg_id", F.col("name").alias("n")), "seg_id").select(read.alias("line"), F.lit(3).alias("section"), F.col("seg_id").alias("ord"))
    return s.unionByName(l).unionByName(p).unionByName(a)


def write_gfa(g: Graph, path: str, sequences: bool = True) -> None:
    write_lines(gfa_lines(g, sequences), path, ["section", "ord", "line"])


def bubble_lines(g: Graph, bubbles: DataFrame, ways: DataFrame, min_bases: int = 0, min_nodes: int = 0) -> DataFrame:
    """line, section, ord: bubbles (bubble, source, sink, kind, inner_nodes, inner_bp) with at least so much inside,
    as a graph: an H line for each, S and L lines of the segments on their ways (bubble, path from 1,
    pos, v), and P lines of what the ways hold between source and sink, spelled."""
    live = cut(bubbles.where((F.col("inner_nodes") >= min_nodes) & (F.col("inner_bp") >= min_bases)))
    on = cut(ways.join(live.select("bubble", "source", "sink"), "bubble"))
    name = lambda c: g.segments.select(F.col("seg_id").alias(f"_{c}"), F.col("name").alias(f"n_{c}"))
    sign = lambda c, fwd="+", back="-": F.when(F.col(c).bitwiseAND(F.lit(1).cast("long")) == 1, back).otherwise(fwd)
    told = live.withColumn("_source", graph.segment("source")).withColumn("_sink", graph.segment("sink")).join(name("source"), "_source").join(name("sink"), "_sink")
    head = F.concat_ws(
        "\t", F.lit("H"), F.concat(F.lit("bubble:i:"), "bubble"), F.concat(F.lit("source:"), "n_source", sign("source")), F.concat(F.lit("sink:"), "n_sink", sign("sink")),
        F.concat(F.lit("BT:Z:"), "kind"), F.concat(F.lit("BL:i:"), "inner_bp"), F.concat(F.lit("BN:i:"), "inner_nodes"),
    )
    top = g.segments.sparkSession.range(1).select(F.lit("H\tVN:Z:1.0").alias("line"), F.lit(-2).alias("section"), F.lit(0).cast("long").alias("ord"))
    h = told.select(head.alias("line"), F.lit(-1).alias("section"), F.col("bubble").cast("long").alias("ord"))
    used = on.select(graph.segment("v").alias("seg_id")).distinct()
    segs = g.segments.join(used, "seg_id", "left_semi")
    arcs = g.arcs.join(used, graph.segment("v") == used["seg_id"], "left_semi").join(used, graph.segment("w") == used["seg_id"], "left_semi")
    body = gfa_lines(Graph(segs.withColumn("tags", F.lit(None).cast("map<string,struct<type:string,value:string>>")), arcs, g.paths.limit(0), g.placements.limit(0), g.ranks))
    inner = on.where((graph.segment("v") != graph.segment("source")) & (graph.segment("v") != graph.segment("sink"))).select("bubble", "path", "pos", "v")
    key = F.struct("bubble", "path")
    text = graph.spell(inner.select(key.alias("path_id"), "pos", "v"), g.segments, g.arcs)
    step = inner.withColumn("_v", graph.segment("v")).join(name("v"), "_v").withColumn("_step", F.concat(sign("v", ">", "<"), "n_v"))
    listed = step.groupBy(key.alias("path_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "_step"))), lambda x: x["_step"]), "").alias("steps")).join(text, "path_id")
    b, p = F.col("path_id.bubble").cast("string"), (F.col("path_id.path") - 1).cast("string")
    spelled = F.when(F.col("seq") == "", F.lit("*")).otherwise(F.col("seq"))
    line = F.concat_ws("\t", F.lit("P"), F.concat(F.lit("b"), b, F.lit(".p"), p), "steps", F.lit("*"), F.concat(F.lit("BI:i:"), b), F.concat(F.lit("PI:i:"), p), F.concat(F.lit("PL:i:"), F.char_length("seq").cast("string")), F.concat(F.lit("SEQ:Z:"), spelled))
    return top.unionByName(h).unionByName(body).unionByName(listed.select(line.alias("line"), F.lit(2).alias("section"), F.col("path_id.bubble").cast("long").alias("ord")))
