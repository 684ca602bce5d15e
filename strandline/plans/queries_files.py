"""Queries that read and write file formats: lines are made of the driver's tables, so that the SQL
can tell what must come out of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import cigar, cigarkernel, dna
from strandline.operators import graph, paf, scores
from strandline.sources import alignments, fasta, gfa, lines, maps

from . import fixtures as fx
from . import tasks
from .queries import query

TAB = "\t"


def _text(*parts: object) -> F.Column:
    """Tab-separated fields; a string is a constant."""
    return F.concat_ws("\t", *[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _c(*parts: object) -> F.Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


_FULL = "(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice)"


def _numbered(spark: SparkSession, d: str) -> DataFrame:
    """Lines with their number ``id`` in the order of their full key."""
    line = fx.table(spark, d, "lineitem")
    # The place within an order, so that no task sorts all lines.
    at = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*fx._LINE[1:]))
    return line.select(
        (F.col("l_orderkey") * 1000 + at).alias("id"), F.col("l_orderkey").alias("o"), F.col("l_partkey").alias("p"), F.col("l_suppkey").alias("s"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").cast("long").alias("q"),
        (F.col("l_returnflag") == "R").alias("rev"),
    )


_N = """n AS (
  SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS id,
         l_orderkey AS o, l_partkey AS p, l_suppkey AS s, l_linenumber::BIGINT AS n, l_quantity::BIGINT AS q, l_returnflag = 'R' AS rev FROM lineitem)"""


# ---- graph files --------------------------------------------------------------------------------


@query("""SELECT 'p' || p_partkey AS name, CASE p_partkey % 4 WHEN 0 THEN 'ACGT' WHEN 3 THEN 'AC' END AS seq,
  CASE p_partkey % 4 WHEN 0 THEN 4 WHEN 1 THEN p_size WHEN 3 THEN 10 END::BIGINT AS length, 'XX:Z:' || p_brand AS tags, (SELECT max(p_partkey % 7) FROM part)::INTEGER AS max_rank
FROM part WHERE p_partkey % 4 <> 2""")
def gfa_segments(spark: SparkSession, d: str) -> DataFrame:
    """S lines: LN beats the sequence's length, neither makes it 0 and the segment goes; SR is kept as the greatest rank."""
    k = F.col("p_partkey")
    seq = F.when(k % 4 == 0, "ACGT").when(k % 4 == 3, "AC").otherwise("*")
    size = F.when(k % 4 == 1, _c("LN:i:", F.col("p_size"))).when(k % 4 == 3, F.lit("LN:i:10"))
    text = fx.table(spark, d, "part").select(_text("S", _c("p", k), seq, size, _c("SR:i:", k % 7), _c("XX:Z:", F.col("p_brand"))).alias("value"), k.alias("ord"))
    g = gfa.parse_gfa(text.unionByName(spark.createDataFrame([("H\tVN:Z:1.0", -1), ("", -2)], "value string, ord long")))
    return g.segments.select("name", "seq", "length", lines.tag_text(F.col("tags")).alias("tags")).crossJoin(g.ranks)  # one row


def _part_lines(spark: SparkSession, d: str, length: F.Column) -> DataFrame:
    k = F.col("p_partkey")
    return fx.table(spark, d, "part").select(_text("S", _c("p", k), "*", _c("LN:i:", length)).alias("value"), k.alias("ord"))


def _arc_lines(spark: SparkSession, d: str, overlap: F.Column) -> DataFrame:
    sign = lambda c: F.when(F.col(c) % 2 == 1, "-").otherwise("+")
    a = fx.part_arcs(spark, d)
    return a.select(
        _text("L", _c("p", F.shiftright("v", 1)), sign("v"), _c("p", F.shiftright("w", 1)), sign("w"), overlap, F.when(F.col("v") % 7 == 0, _c("L1:i:", F.col("ov") + 45)), F.when(F.col("w") % 9 == 0, _c("SR:i:", F.col("w") % 4))).alias("value"),
        (F.shiftleft("v", 28) + F.col("w") + 10**12).alias("ord"),  # one number for each arc, however many parts
    )


def _ov() -> F.Column:
    return F.when(F.col("v") % 5 == 0, "*").when(F.col("v") % 5 == 1, F.col("ov").cast("string")).when(F.col("v") % 5 == 2, _c(F.col("ov"), ":", F.col("ov") + 1)).when(F.col("v") % 5 == 3, _c(F.col("ov"), "M2I1D")).otherwise(_c(":", F.col("ov")))


@query(f"""WITH {fx.ARCS_SQL.strip()}
SELECT v, w, CASE v % 5 WHEN 1 THEN ov WHEN 2 THEN ov WHEN 3 THEN ov + 1 END AS ov, CASE v % 5 WHEN 1 THEN ov WHEN 2 THEN ov + 1 WHEN 3 THEN ov + 2 WHEN 4 THEN ov END AS ow,
  CASE WHEN w % 9 = 0 THEN (w % 4)::INTEGER END AS rank FROM arcs""")
def gfa_links(spark: SparkSession, d: str) -> DataFrame:
    """L lines: the grammar of overlaps, ranks, and names looked up."""
    g = gfa.parse_gfa(_part_lines(spark, d, F.col("p_size")).unionByName(_arc_lines(spark, d, _ov())), finalise=False)
    number = g.segments.select("seg_id", F.substr("name", F.lit(2)).cast("long").alias("k"))
    at = lambda c: number.select(F.col("seg_id").alias(f"_{c}"), F.col("k").alias(f"k{c}"))
    named = g.arcs.withColumn("_v", graph.segment("v")).withColumn("_w", graph.segment("w")).join(at("v"), "_v").join(at("w"), "_w")
    return named.select((F.col("kv") * 2 + F.col("v") % 2).alias("v"), (F.col("kw") * 2 + F.col("w") % 2).alias("w"), "ov", "ow", "rank")


@query(f"""WITH {fx.ARCS_SQL.strip()}, g AS (SELECT v // 2 AS k, max(ov + 45) AS n FROM arcs WHERE v % 7 = 0 GROUP BY 1)
SELECT 'p' || p_partkey AS name, greatest(p_size, coalesce(n, 0))::BIGINT AS length FROM part LEFT JOIN g ON k = p_partkey""")
def gfa_grown_segments(spark: SparkSession, d: str) -> DataFrame:
    """L1 of links lengthens segments."""
    return gfa.parse_gfa(_part_lines(spark, d, F.col("p_size")).unionByName(_arc_lines(spark, d, _ov()))).segments.select("name", "length")


_FINAL = f"""WITH {fx.ARCS_SQL.strip()},
a AS (SELECT v, w, CASE WHEN v % 5 <> 0 THEN ov END AS ov, CASE WHEN v % 5 <> 0 THEN ov + w % 2 END AS ow, v * 1000000 + w AS link FROM arcs),
seg AS (SELECT p_partkey AS k, p_size::BIGINT - 5 AS n FROM part WHERE p_size > 5),
c AS (SELECT xor(w, 1) AS v, xor(v, 1) AS w, count(*) AS n, min(ow) AS ov, min(ov) AS ow FROM a WHERE ov IS NOT NULL AND ow IS NOT NULL GROUP BY ALL),
f AS (SELECT v, w, ov, ow, link FROM a WHERE ov IS NOT NULL AND ow IS NOT NULL UNION ALL SELECT a.v, a.w, c.ov, c.ow, link FROM a JOIN c USING (v, w) WHERE (a.ov IS NULL OR a.ow IS NULL) AND c.n = 1),
t AS (SELECT f.*, (SELECT min(o.link) FROM f o WHERE o.v = xor(f.w, 1) AND o.w = xor(f.v, 1) AND o.ov = f.ow AND o.ow = f.ov) AS other FROM f),
e AS (SELECT v, w, ov, ow, least(link, coalesce(other, link)) AS link_id, coalesce(other <= link, false) AS comp FROM t UNION ALL SELECT xor(w, 1), xor(v, 1), ow, ov, link, true FROM t WHERE other IS NULL),
final AS (SELECT v, w, least(ov, x.n) AS ov, least(ow, y.n) AS ow, x.n - least(ov, x.n) AS lv, link_id, comp FROM e JOIN seg x ON x.k = v // 2 JOIN seg y ON y.k = w // 2)"""


def _finalised(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    known = F.col("v") % 5 != 0
    arcs = fx.part_arcs(spark, d).select("v", "w", F.when(known, F.col("ov")).alias("ov"), F.when(known, F.col("ov") + F.col("w") % 2).alias("ow"), (F.col("v") * 1_000_000 + F.col("w")).alias("link_id"))
    segs = fx.table(spark, d, "part").select(F.col("p_partkey").alias("seg_id"), (F.col("p_size").cast("long") - 5).alias("length"))
    return graph.finalise(segs, arcs)


@query(f"{_FINAL} SELECT * FROM final")
def graph_finalise(spark: SparkSession, d: str) -> DataFrame:
    return _finalised(spark, d)[1]


@query("""WITH l AS (SELECT l_orderkey AS o, l_partkey AS p, l_returnflag = 'R' AS rev, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1 AS pos FROM lineitem)
SELECT 'o' || o AS name, pos::INTEGER AS pos, 'p' || p AS seg, rev FROM l WHERE p % 13 <> 4""")
def gfa_paths(spark: SparkSession, d: str) -> DataFrame:
    """P lines; names that no segment has are passed over."""
    n = _numbered(spark, d)
    step = _c(F.when(F.col("p") % 13 == 4, "nobody").otherwise("p"), F.col("p"), F.when(F.col("rev"), "-").otherwise("+"))
    listed = n.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("id", step.alias("s")))).alias("x"))
    text = listed.select(_text("P", _c("o", F.col("o")), F.array_join(F.transform("x", lambda y: y["s"]), ","), "*").alias("value"), (F.col("o") + 10**12).alias("ord"))
    g = gfa.parse_gfa(_part_lines(spark, d, F.col("p_size")).unionByName(text), finalise=False)
    return g.paths.join(g.segments.select("seg_id", F.col("name").alias("seg")), "seg_id").select("name", "pos", "seg", "rev")


def _placed_graph(spark: SparkSession, d: str) -> gfa.Graph:
    n = _numbered(spark, d)
    name = F.when(F.col("p") % 11 == 3, "nobody").otherwise(_c("p", F.col("p")))
    text = n.select(_text("A", name, F.col("n") * 5, F.when(F.col("rev"), "-").otherwise("+"), _c("r", F.col("o")), F.col("n"), F.col("n") + F.col("q"), _c("id:i:", F.col("s"))).alias("value"), (F.col("id") + 10**12).alias("ord"))
    return gfa.parse_gfa(_part_lines(spark, d, F.col("p_size") * 10).unionByName(text))


@query(f"WITH {_N} SELECT 'p' || p AS name, n * 5 AS pos, rev AS read_rev, 'r' || o AS read_name, n AS read_start, n + q AS read_end, 'id:i:' || s AS tags FROM n WHERE p % 11 <> 3")
def gfa_placements(spark: SparkSession, d: str) -> DataFrame:
    """A lines; those of a segment that isn't there go."""
    g = _placed_graph(spark, d)
    return g.placements.join(g.segments.select("seg_id", "name"), "seg_id").select("name", "pos", "read_rev", "read_name", "read_start", "read_end", "tags")


@query(f"""WITH {_N} SELECT a_ctg, a_beg, a_end, b_ctg, b_beg, b_end, rev FROM (
  SELECT 'p' || p AS a_ctg, n * 5 AS a_beg, n * 5 + q AS a_end, 'r' || o AS b_ctg, n AS b_beg, n + q AS b_end, rev FROM n WHERE p % 11 <> 3 AND q > 0)""")
def placements_to_map(spark: SparkSession, d: str) -> DataFrame:
    return tasks.map_of_placements(_placed_graph(spark, d))


@query(f"""{_FINAL}, pl AS ({{P}}),
sign AS (SELECT unnest([0, 1]) AS r, unnest(['+', '-']) AS c)
SELECT 'S' || chr(9) || 'p' || k || chr(9) || '*' || chr(9) || 'LN:i:' || n AS line FROM seg
UNION ALL SELECT 'L' || chr(9) || 'p' || v // 2 || chr(9) || x.c || chr(9) || 'p' || w // 2 || chr(9) || y.c || chr(9) || CASE WHEN ov = ow THEN ov || 'M' ELSE ov || ':' || ow END FROM final JOIN sign x ON x.r = v % 2 JOIN sign y ON y.r = w % 2 WHERE NOT comp
UNION ALL SELECT 'A' || chr(9) || 'p' || p || chr(9) || pos || chr(9) || '-' || chr(9) || 'r' || p || chr(9) || 0 || chr(9) || pos FROM pl JOIN seg ON k = p""".replace("{P}", "SELECT p_partkey AS p, p_size::BIGINT AS pos FROM part"))
def gfa_written(spark: SparkSession, d: str) -> DataFrame:
    """S, L and A lines of a finalised graph; links once, without their complements."""
    segs, arcs = _finalised(spark, d)
    named = segs.withColumn("name", _c("p", F.col("seg_id"))).withColumn("seq", F.lit(None).cast("string")).withColumn("tags", F.create_map().cast("map<string,struct<type:string,value:string>>"))
    size = fx.table(spark, d, "part").select(F.col("p_partkey").alias("seg_id"), F.col("p_size").cast("long").alias("pos"))
    placed = size.select("seg_id", "pos", F.lit(True).alias("read_rev"), _c("r", F.col("seg_id")).alias("read_name"), F.lit(0).cast("long").alias("read_start"), F.col("pos").alias("read_end"), F.lit("").alias("tags"))
    none = spark.createDataFrame([], "name string, pos int, seg_id long, rev boolean")
    return gfa.gfa_lines(gfa.Graph(named, arcs, none, placed, spark.createDataFrame([], "max_rank int"))).select("line")


@query("""SELECT p_partkey AS k, p_brand AS brand, (p_size::BIGINT)::VARCHAR AS size, 'XA:A:' || p_size % 10 || chr(9) || 'BB:Z:' || p_brand || chr(9) || 'nw:i:' || p_partkey * 2 AS text, p_size::BIGINT AS n FROM part""")
def aux_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tags parsed (the first of a key counts, other fields are passed over), looked up, deleted, added and written."""
    field = F.array(_c("XA:A:", F.col("p_size") % 10), F.lit("no tag"), _c("BB:Z:", F.col("p_brand")), _c("LN:i:", F.col("p_size")), F.lit("BB:Z:second"), F.lit("nw:i:0"))
    t = fx.table(spark, d, "part").select("p_partkey", lines.tags(field).alias("t"))
    less = lines.with_tag(lines.without_tags(F.col("t"), "LN"), "nw", "i", F.col("p_partkey") * 2)
    return t.select(F.col("p_partkey").alias("k"), lines.tag(F.col("t"), "BB").alias("brand"), lines.tag(F.col("t"), "LN").alias("size"), lines.tag_text(less).alias("text"), lines.u32(lines.tag(F.col("t"), "LN")).alias("n"))


# ---- alignment files ----------------------------------------------------------------------------

_PAF_SQL = f"""WITH {_N}, paf AS (
  SELECT id, 'q' || o AS qname, 5000::BIGINT AS qlen, n * 100 AS qstart, n * 100 + 2 * q + 9 AS qend, CASE WHEN rev THEN '-' ELSE '+' END AS strand, 't' || p AS tname, 90000::BIGINT AS tlen,
         s * 10 AS tstart, s * 10 + 2 * q + 10 AS tend, q AS nmatch, 2 * q + 12 AS alen, (id * 7) % 61 AS mapq, ['P', 'S', 'I'][1 + id % 3] AS tp,
         q || '=' || 4 || 'X' || 2 || 'I' || 3 || 'M' || 3 || 'D' || q || 'M' AS cg, q, rev FROM n)"""


def _paf(spark: SparkSession, d: str) -> DataFrame:
    """Lines of alignments: q = 4X 2I 3M 3D q M."""
    n = _numbered(spark, d)
    q, start, t = F.col("q"), F.col("n") * 100, F.col("s") * 10
    kind = F.element_at(F.array(F.lit("P"), F.lit("S"), F.lit("I")), (F.col("id") % 3 + 1).cast("int"))
    return n.select(
        _text(_c("q", F.col("o")), "5000", start, start + 2 * q + 9, F.when(F.col("rev"), "-").otherwise("+"), _c("t", F.col("p")), "90000", t, t + 2 * q + 10, q, 2 * q + 12, F.col("id") * 7 % 61, _c("tp:A:", kind), _c("cg:Z:", q, "=4X2I3M3D", q, "M")).alias("value"),
        F.col("id").alias("ord"),
    )


@query(f"{_PAF_SQL} SELECT qname, qlen, qstart, qend, strand, tname, tlen, tstart, tend, nmatch, alen, mapq, tp, cg FROM paf")
def paf_records(spark: SparkSession, d: str) -> DataFrame:
    """Read, written and read again."""
    once = alignments.parse_paf(_paf(spark, d))
    again = alignments.parse_paf(alignments.paf_lines(once).select(F.col("line").alias("value"), F.monotonically_increasing_id().alias("ord")))
    return again.select(*[c for c, _ in alignments.PAF], lines.tag(F.col("tags"), "tp").alias("tp"), lines.tag(F.col("tags"), "cg").alias("cg"))


@query(f"""{_PAF_SQL}, k AS (SELECT * FROM paf WHERE tp = 'P' AND mapq >= 5 AND greatest(tlen, qlen) >= 50000),
b AS (SELECT *, unnest([0, q + 6, q + 9]) AS y, unnest([0, q + 4, q + 10]) AS x, unnest([q + 4, 3, q]) AS len FROM k)
SELECT tname AS a_ctg, tstart + x AS a_beg, tstart + x + len AS a_end, qname AS b_ctg, CASE WHEN rev THEN qend - y - len ELSE qstart + y END AS b_beg, CASE WHEN rev THEN qend - y ELSE qstart + y + len END AS b_end, rev FROM b""")
def paf_to_map(spark: SparkSession, d: str) -> DataFrame:
    return tasks.map_of_paf(alignments.parse_paf(_paf(spark, d)))


_LIFT_PAF = f"""{_PAF_SQL}, good AS (SELECT *, [{{'l': q, 'o': '='}}, {{'l': 4, 'o': 'X'}}, {{'l': 2, 'o': 'I'}}, {{'l': 3, 'o': 'M'}}, {{'l': 3, 'o': 'D'}}, {{'l': q, 'o': 'M'}}] AS ops FROM paf WHERE mapq >= 5 AND alen >= 30 AND tp IN ('P', 'I')),
twins AS (
  SELECT id, qname, qlen, qstart, qend, strand, tname, tlen, tstart, tend, rev, ops FROM good UNION ALL
  SELECT id, tname, tlen, tstart, tend, strand, qname, qlen, qstart, qend, rev,
         list_transform(CASE WHEN rev THEN list_reverse(ops) ELSE ops END, lambda x: {{'l': x.l, 'o': translate(x.o, 'ID', 'DI')}}) FROM good),
blocks AS (
  SELECT *, unnest(range(1, 7)) AS i FROM twins),
spans AS (
  SELECT *, CASE WHEN rev THEN qlen - qend ELSE qstart END + coalesce(list_sum(list_transform(list_filter(ops[1:i - 1], lambda x: x.o <> 'D'), lambda x: x.l)), 0) AS y,
         tstart + coalesce(list_sum(list_transform(list_filter(ops[1:i - 1], lambda x: x.o <> 'I'), lambda x: x.l)), 0) AS x, ops[i].l AS len, ops[i].o AS op FROM blocks),
bed AS (SELECT 't' || p_partkey AS ctg, (p_partkey % 90) AS beg, (p_partkey % 90 + p_size)::BIGINT AS "end" FROM part UNION ALL SELECT 'q' || o_orderkey, 105, 140 FROM orders),
hit AS (SELECT bed.*, t.* FROM bed JOIN twins t ON bed.ctg = t.qname AND bed.beg < t.qend AND t.qstart < bed."end"),
ends AS (
  SELECT *, CASE WHEN rev THEN qlen - "end" ELSE beg END AS p0, CASE WHEN rev THEN qlen - 1 - beg ELSE "end" - 1 END AS p1 FROM hit),
found AS (
  SELECT a.*, min(CASE WHEN s.op <> 'D' AND p0 >= s.y AND p0 < s.y + s.len THEN CASE WHEN s.op = 'I' THEN s.x ELSE s.x + p0 - s.y END END) AS t0,
         min(CASE WHEN s.op <> 'D' AND p1 >= s.y AND p1 < s.y + s.len THEN CASE WHEN s.op = 'I' THEN s.x ELSE s.x + p1 - s.y END END) AS t1
  FROM ends a JOIN spans s ON s.id = a.id AND s.qname = a.qname GROUP BY ALL),
r AS (SELECT *, coalesce(t0, tstart) AS lo, coalesce(t1, tend - 1) + 1 AS hi FROM found)"""


@query(f"""{_LIFT_PAF} SELECT tname, least(lo, tlen)::BIGINT AS tbeg, least(hi, tlen)::BIGINT AS tend, ctg || '_' || beg || '_' || "end" || CASE WHEN t0 IS NULL THEN '_t5' ELSE '' END || CASE WHEN t1 IS NULL THEN '_t3' ELSE '' END AS name, strand FROM r WHERE lo < hi""")
def paf_liftover(spark: SparkSession, d: str) -> DataFrame:
    rows = paf.with_twins(paf.usable(alignments.parse_paf(_paf(spark, d)), lines.tag, min_mapq=5, min_len=30))
    part, orders = fx.table(spark, d, "part"), fx.table(spark, d, "orders")
    bed = part.select(_c("t", F.col("p_partkey")).alias("ctg"), (F.col("p_partkey") % 90).alias("beg"), (F.col("p_partkey") % 90 + F.col("p_size")).alias("end"))
    bed = bed.unionByName(orders.select(_c("q", F.col("o_orderkey")).alias("ctg"), F.lit(105).cast("long").alias("beg"), F.lit(140).cast("long").alias("end")))
    return paf.lift(bed.withColumn("query_id", _c(F.col("ctg"))).withColumn("rest", F.lit("")), rows).select("tname", "tbeg", "tend", "name", "strand")


def _gaf(spark: SparkSession, d: str) -> DataFrame:
    """Alignments to paths of two parts, q matched, 2 left out, 3 mismatched; some lines are broken."""
    n = _numbered(spark, d)
    nxt = F.coalesce(F.lead("p").over(Window.partitionBy("o").orderBy("id")), F.col("p"))
    q, path = F.col("q"), _c(">", "p", F.col("p"), "<", F.when(F.col("s") % 6 == 5, "nobody").otherwise("p"), nxt)
    start = F.col("n") * 5
    row = _text(_c("r", F.col("o")), "60", "0", q + 3, "+", path, "1000", start, start + q + 5, q, q + 5, F.col("id") % 61, _c("cg:Z:", q, "=2D3X"))
    return n.select(F.when(F.col("id") % 17 == 0, "broken\tline").otherwise(row).alias("value"), F.col("id").alias("ord"))


_GAF_SQL = f"""WITH {_N}, g AS (SELECT *, coalesce(lead(p) OVER (PARTITION BY o ORDER BY id), p) AS nx FROM n), good AS (SELECT * FROM g WHERE id % 17 <> 0)"""


@query(f"""{_GAF_SQL} SELECT id, 0 AS pos, 'p' || p AS name, false AS rev, 5 * n AS tstart, true AS ok FROM good
UNION ALL SELECT id, 1, CASE WHEN s % 6 = 5 THEN 'nobody' ELSE 'p' END || nx, true, 5 * n, true FROM good UNION ALL SELECT -1, -1, 'broken' || chr(9) || 'line', false, 0, false FROM g WHERE id % 17 = 0""")
def gaf_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of paths; lines that can't be read are set aside, not the end."""
    good, bad = alignments.parse_gaf(_gaf(spark, d))
    steps = good.select(F.col("ord").alias("id"), F.posexplode("steps").alias("pos", "x"), "tstart").select("id", "pos", "x.name", "x.rev", "tstart", F.lit(True).alias("ok"))
    return steps.unionByName(bad.select(F.lit(-1).cast("long").alias("id"), F.lit(-1).alias("pos"), F.col("value").alias("name"), F.lit(False).alias("rev"), F.lit(0).cast("long").alias("tstart"), F.lit(False).alias("ok")))


@query(f"""{_GAF_SQL}, k AS (SELECT * FROM good WHERE id % 61 >= 20 AND (q + 3) / 60 >= 0.3 AND s % 6 <> 5),
b AS (SELECT *, unnest([5 * n, 5 * n + q + 2]) AS bb, unnest([5 * n + q, 5 * n + q + 5]) AS be FROM k),
z AS (SELECT p_partkey AS k, p_size::BIGINT * 10 AS n FROM part),
h AS (
  SELECT x.k, bb AS beg, least(be, x.n) AS "end" FROM b JOIN z x ON x.k = p WHERE bb < x.n
  UNION ALL SELECT y.k, y.n - least(be - x.n, y.n), y.n - greatest(bb - x.n, 0) FROM b JOIN z x ON x.k = p JOIN z y ON y.k = nx WHERE be > x.n AND bb < x.n + y.n),
e AS (SELECT k, pt, sum(d) AS d FROM (SELECT k, beg AS pt, 1 AS d FROM h UNION ALL SELECT k, "end", -1 FROM h) GROUP BY k, pt HAVING sum(d) <> 0),
r AS (SELECT k, pt AS beg, lead(pt) OVER (PARTITION BY k ORDER BY pt) AS "end", sum(d) OVER (PARTITION BY k ORDER BY pt ROWS UNBOUNDED PRECEDING)::BIGINT AS depth FROM e)
SELECT 'p' || k AS name, beg, "end", least(depth, 255)::BIGINT AS depth FROM r WHERE depth > 0""")
def gaf_coverage(spark: SparkSession, d: str) -> DataFrame:
    g = gfa.parse_gfa(_part_lines(spark, d, F.col("p_size") * 10))
    good, _ = alignments.parse_gaf(_gaf(spark, d))
    runs = tasks.gaf_runs(g, good, min_mapq=20, min_frac=0.3 * 60 / 60)
    return runs.join(g.segments.select("seg_id", "name"), "seg_id").select("name", "beg", "end", "depth")


@query(f"""WITH {_N}, x AS (SELECT *, least(n * 10, n * 10 + (s % 5 - 2) * 4) AS beg, greatest(n * 10, n * 10 + (s % 5 - 2) * 4) AS "end" FROM n WHERE id % 10 <> 0)
SELECT 'p' || p AS ctg, beg, "end", 'gene ' || id AS rest FROM x WHERE beg < "end" """)
def bed_rows(spark: SparkSession, d: str) -> DataFrame:
    n = _numbered(spark, d)
    row = _c("  p", F.col("p"), "  ", F.col("n") * 10, TAB, F.col("n") * 10 + (F.col("s") % 5 - 2) * 4, " gene ", F.col("id"), " ")
    text = n.select(F.when(F.col("id") % 20 == 0, "# p1 0 5").when(F.col("id") % 20 == 10, "p1 x 5").otherwise(row).alias("value"), F.col("id").alias("ord"))
    return alignments.parse_bed(text).drop("query_id")


@query(f"""WITH {_N}
SELECT 'o' || o AS a_ctg, n AS a_beg, n + q AS a_end, 'p' || p AS b_ctg, CASE WHEN rev THEN q ELSE 0 END AS b_beg, CASE WHEN rev THEN 2 * q ELSE q END AS b_end, rev FROM n WHERE s % 2 = 0
UNION ALL SELECT 'z' || o, 100, 100 + q, 'p' || p, CASE WHEN rev THEN 0 ELSE q END, CASE WHEN rev THEN q ELSE 2 * q END, false FROM n WHERE s % 2 = 0
UNION ALL SELECT 'o' || o, 10, 50, 'p' || p, 0, 40, false FROM n WHERE s % 2 = 1 UNION ALL SELECT 'z' || o, 100, 110, 'p' || p, 40, 50, false FROM n WHERE s % 2 = 1""")
def map_lines(spark: SparkSession, d: str) -> DataFrame:
    """Sides of two stretches, read backwards or cut as a whole, against one: zipped into records."""
    n = _numbered(spark, d)
    q, rev = F.col("q"), F.col("rev")
    second = F.when(rev, _c(q + 100, "-100")).otherwise(_c("100-", q + 100))
    two = _c("o", F.col("o"), ":", F.col("n"), "-", F.col("n") + q, ";z", F.col("o"), ":", second, TAB, "p", F.col("p"), ":0-", 2 * q, F.when(rev, "-").otherwise("+"), " more")
    sliced = _c("o", F.col("o"), ":0-50;z", F.col("o"), ":100-200:10-60+", " p", F.col("p"), ":0-50")
    return maps.parse_map(n.select(F.when(F.col("s") % 2 == 0, two).otherwise(sliced).alias("value"), F.col("id").alias("ord")))


@query(f"""WITH {_N} SELECT 'o' || o || ':' || n || '-' || n + q || '+' || chr(9) || 'p' || p || ':' || n || '-' || n + q || CASE WHEN rev THEN '-' ELSE '+' END AS line FROM n""")
def map_written(spark: SparkSession, d: str) -> DataFrame:
    n = _numbered(spark, d)
    return n.select(maps.map_line(_c("o", F.col("o")), F.col("n"), F.col("n") + F.col("q"), _c("p", F.col("p")), F.col("n"), F.col("n") + F.col("q"), F.col("rev")).alias("line"))


def _sam(spark: SparkSession, d: str) -> DataFrame:
    n = _numbered(spark, d)
    nm = F.when(F.col("s") % 3 == 0, _c("NM:i:", F.col("s") % 5)).when(F.col("s") % 3 == 1, _c("nM:i:", F.col("s") % 5 - 1))
    flag = F.element_at(F.array(*[F.lit(x) for x in (0, 16, 4, 256, 2048, 65, 129)]), (F.col("id") % 7 + 1).cast("int"))
    row = _text(_c("r", F.col("o")), flag, _c("p", F.col("p")), F.col("n") * 3, F.col("id") % 61, _c(F.col("q"), "M"), "*", "0", "0", "*", "*", nm, _c("AS:i:", F.col("q")))
    return n.select(row.alias("value"), F.col("id").alias("ord"))


@query(f"""WITH {_N}, f AS (SELECT *, [0, 16, 4, 256, 2048, 65, 129][1 + id % 7] AS flag FROM n)
SELECT id, flag, 'p' || p AS rname, n * 3 - 1 AS pos0, flag & 4 = 0 AS mapped, flag & 2304 = 0 AS is_primary, (flag // 64 % 4)::BIGINT AS read_end, CASE s % 3 WHEN 0 THEN s % 5 WHEN 1 THEN greatest(s % 5 - 1, -1) ELSE -1 END::INTEGER AS nm,
  'r' || o || chr(9) || flag || chr(9) || 'p' || p || chr(9) || n * 3 || chr(9) || id % 61 || chr(9) || q || 'M' || chr(9) || '*' || chr(9) || 0 || chr(9) || 0 || chr(9) || '*' || chr(9) || '*' ||
  CASE s % 3 WHEN 0 THEN chr(9) || 'NM:i:' || s % 5 WHEN 1 THEN chr(9) || 'nM:i:' || s % 5 - 1 ELSE '' END || chr(9) || 'AS:i:' || q AS line FROM f""")
def sam_records(spark: SparkSession, d: str) -> DataFrame:
    records, _ = alignments.parse_sam(_sam(spark, d))
    line = alignments.sam_lines(records).withColumnRenamed("ord", "id")
    f = records.select(
        F.col("ord").alias("id"), "flag", "rname", "pos0", (F.col("flag").bitwiseAND(4) == 0).alias("mapped"), (F.col("flag").bitwiseAND(0x900) == 0).alias("is_primary"), (F.floor(F.col("flag") / 64) % 4).alias("read_end"),
        scores.edit_distance(F.transform_values("tags", lambda _, v: v["value"])).alias("nm"),
    )
    return f.join(line, "id")


_BASES = "translate(md5(p_partkey::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT')"


@query(f"""WITH {_N}, {fx.ARCS_SQL.strip()},
seg AS (SELECT p_partkey AS k, {_BASES} AS seq FROM part WHERE p_partkey % 23 <> 5),
st AS (SELECT *, p * 2 + rev::INT AS v, lag(p * 2 + rev::INT) OVER (PARTITION BY o ORDER BY id) AS u FROM n),
t AS (SELECT st.o, st.id, CASE WHEN seq IS NULL THEN NULL ELSE substr(CASE WHEN rev THEN reverse(translate(seq, 'ACGT', 'TGCA')) ELSE seq END, 1 + coalesce(a.ov, 0)) END AS part FROM st LEFT JOIN arcs a ON a.v = st.u AND a.w = st.v LEFT JOIN seg ON k = p)
SELECT 'o' || o AS path, CASE WHEN bool_or(part IS NULL) THEN '*' ELSE string_agg(part, '' ORDER BY id) END AS seq FROM t GROUP BY o""")
def path_spelling(spark: SparkSession, d: str) -> DataFrame:
    """Paths as text, two ways of writing them, parsed and spelled without overlaps; '*' where a segment isn't known."""
    n = _numbered(spark, d)
    step = F.when(F.col("o") % 2 == 0, _c(F.when(F.col("rev"), "<").otherwise(">"), "p", F.col("p"))).otherwise(_c("p", F.col("p"), F.when(F.col("rev"), "-").otherwise("+")))
    listed = n.groupBy("o").agg(F.array_sort(F.collect_list(F.struct("id", step.alias("s")))).alias("x"))
    text = listed.select(F.col("o").alias("ord"), _c(" ", F.when(F.col("o") % 2 == 0, F.array_join(F.transform("x", lambda y: y["s"]), "")).otherwise(F.array_join(F.transform("x", lambda y: y["s"]), ","))).alias("value"))
    bases = F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    segs = fx.table(spark, d, "part").where("p_partkey % 23 <> 5").select(F.col("p_partkey").alias("seg_id"), _c("p", F.col("p_partkey")).alias("name"), bases.alias("seq"))
    g = gfa.Graph(segs, fx.part_arcs(spark, d).withColumn("ow", F.col("ov")), None, None, None)
    paths = alignments.parse_paths(text)
    return tasks.path_sequences(g, paths).select(_c("o", F.col("path_id")).alias("path"), "seq")


@query(f"""WITH s AS (SELECT p_partkey, {_BASES} AS seq FROM part) SELECT '>p' || p_partkey || chr(10) || substr(seq, 1, 12) || chr(10) || substr(seq, 13, 12) || chr(10) || substr(seq, 25) AS line FROM s""")
def fasta_wrapped(spark: SparkSession, d: str) -> DataFrame:
    bases = F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    return fasta.fasta_lines(fx.table(spark, d, "part").select(_c("p", F.col("p_partkey")).alias("name"), bases.alias("seq")), 12)


@query(f"""WITH s AS (SELECT p_partkey AS k, {_BASES} AS seq, p_size % 20 AS b, p_size % 20 + 7 AS e FROM part)
SELECT k, CASE WHEN k % 9 = 0 THEN '*' WHEN k % 2 = 1 THEN reverse(translate(substr(seq, b + 1, 7), 'ACGT', 'TGCA')) ELSE substr(seq, b + 1, 7) END AS slice,
  reverse(translate(upper(lower(replace(seq, 'AC', 'RK'))), 'ACGTURYSWKMBDHVN', 'TGCAAYRSWMKVHDBN')) AS iupac FROM s""")
def oriented_slices(spark: SparkSession, d: str) -> DataFrame:
    bases = F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    s = fx.table(spark, d, "part").select(F.col("p_partkey").alias("k"), bases.alias("seq"), (F.col("p_size") % 20).alias("b"))
    known = F.when(F.col("k") % 9 != 0, F.col("seq"))
    return s.select("k", dna.slice_of(known, F.col("b"), F.col("b") + 7, F.col("k") % 2 == 1).alias("slice"), dna.revcomp_iupac(F.lower(F.replace("seq", F.lit("AC"), F.lit("RK")))).alias("iupac"))


@query(f"""WITH {_N} SELECT id, (q + n) || 'M' || n || 'I' || (q + s + 1) || '=' AS merged, (q + n + q + s + 1)::BIGINT AS bases, s % 4 <> 0 AS plain,
  ['h1', 'h2', '', ''][1 + s % 4] AS hap, CASE WHEN n < q THEN round((q - n) / least(q, q), 9) ELSE 0 END::DOUBLE AS share, CASE WHEN s % 2 = 0 THEN q END AS n32 FROM n""")
def small_functions(spark: SparkSession, d: str) -> DataFrame:
    """Runs of one operation merged, bases of blocks, the plain alphabet, haplotypes, shares of overlap, strict numbers."""
    n = _numbered(spark, d)
    q, s, at = F.col("q"), F.col("s"), F.col("n")
    own = _c(q, "M", at, "M", at, "I", q, "=", s, "=1=")
    text = F.when(s % 4 == 0, _c(q, "M3S")).otherwise(_c(q, "M2X3D1I4="))
    name = F.element_at(F.array(F.lit("h1tg"), F.lit("h2_x"), F.lit("h3"), F.lit("xh1")), (s % 4 + 1).cast("int"))
    number = F.when(s % 2 == 0, q.cast("string")).when(s % 3 == 0, "4294967296").when(s % 5 == 0, "-1").otherwise("7x")
    return n.select(
        "id", cigarkernel.merged(own).alias("merged"), cigarkernel.block_bases(own).alias("bases"), cigar.is_plain(text).alias("plain"), scores.haplotype(name).alias("hap"),
        F.round(scores.overlap_of_shorter(F.lit(0).cast("long"), q, at, at + q), 9).alias("share"), lines.u32(number).alias("n32"),
    )
