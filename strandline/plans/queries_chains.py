"""Queries of chains, flanking lifts, record writers, tips and rule records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.functions import cigar, cigarkernel, spans
from strandline.operators import bubbles, chains, rewire, rewrite, scores, sketches
from strandline.sources import alignments, gfa, maps

from . import fixtures as fx
from . import tasks
from .queries import query
from .queries_files import _BASES, _N, _c, _numbered
from .queries_more import _CLOSED, _PS_NORM, _REAL, _bubbles, _sizes

# ---- functions and paths -----------------------------------------------------------------------------


@query(f"""WITH {_N} SELECT id, CASE WHEN q = 7 THEN '*' ELSE q || 'M' || n || ['I', 'D', 'N', 'S', 'H', 'P', '=', 'X', '?'][1 + s % 9] || (p % 40 + 1) || '=' END AS cigar,
  CASE WHEN q <> 7 THEN (p % 40 + 1) + CASE WHEN s % 9 = 6 THEN n ELSE 0 END ELSE 0 END::BIGINT AS matches, CASE WHEN q <> 7 THEN q + (p % 40 + 1) + CASE WHEN s % 9 IN (6, 7) THEN n ELSE 0 END ELSE 0 END::BIGINT AS block FROM n""")
def packed_cigars(spark: SparkSession, d: str) -> DataFrame:
    """CIGARs from packed operations, and what of them counts in a PAF record."""
    n = _numbered(spark, d)
    packed = F.when(F.col("q") == 7, F.array().cast("array<bigint>")).otherwise(F.array(F.col("q") * 16, F.col("n") * 16 + F.col("s") % 9 + 1, (F.col("p") % 40 + 1) * 16 + 7))
    told = n.select("id", cigar.unpack(packed).alias("cigar"))
    size = cigar.paf_lengths(cigar.ops(F.col("cigar")))
    return told.select("id", "cigar", size["matches"].alias("matches"), size["block"].alias("block"))


@query(f"""WITH {_N}, a AS (SELECT o, row_number() OVER (PARTITION BY o ORDER BY id) - 1 AS i, p % 5 AS v FROM n), b AS (SELECT o, row_number() OVER (PARTITION BY o ORDER BY s, id) - 1 AS j, p % 5 AS v FROM n),
l AS (SELECT o, v, max(j) AS j FROM b GROUP BY ALL), x AS (SELECT o, i, j, max(j) OVER (PARTITION BY o ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM a JOIN l USING (o, v)),
c AS (SELECT o, i, j FROM x WHERE h IS NULL OR j > h UNION ALL SELECT o, count(*), count(*) FROM n GROUP BY o),
d AS (SELECT o, coalesce(lag(i) OVER w, -1) + 1 AS a_beg, i AS a_end, coalesce(lag(j) OVER w, -1) + 1 AS b_beg, j AS b_end FROM c WINDOW w AS (PARTITION BY o ORDER BY i))
SELECT o, a_beg::INTEGER AS a_beg, a_end::INTEGER AS a_end, b_beg::INTEGER AS b_beg, b_end::INTEGER AS b_end FROM d WHERE a_beg < a_end AND b_beg < b_end""")
def path_pieces(spark: SparkSession, d: str) -> DataFrame:
    """An order's lines by number and by supplier as two paths, between vertices that both pass."""
    n = _numbered(spark, d)
    way = lambda *by: n.select("o", F.row_number().over(chains.Window.partitionBy("o").orderBy(*by)).alias("pos"), (F.col("p") % 5).alias("v")).withColumn("pos", F.col("pos") - 1)
    return chains.path_pieces(way("id"), way("s", "id"), ["o"])


@query(f"""WITH {_N}, r AS (SELECT o % 50 AS cand, p % 60 AS a, s % 40 AS b FROM n),
y AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY least(a, b), greatest(a, b) ORDER BY cand, bases) = 1 THEN 1 ELSE 0 END AS new FROM (SELECT cand, a, b, 1 + a % 7 + b % 7 + CASE WHEN a = b THEN 2 ELSE 0 END AS bases FROM r))
SELECT cand FROM y GROUP BY cand HAVING sum(new * (1 + (least(a, b) % 7) + (greatest(a, b) % 7) + CASE WHEN a = b THEN 2 ELSE 0 END)) >= 0.05 * sum(bases)""")
def candidates_to_align(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that bring enough new pairs of segments."""
    n = _numbered(spark, d)
    rows = n.select((F.col("o") % 50).alias("cand"), (F.col("p") % 60).alias("a"), (F.col("s") % 40).alias("b"))
    return chains.worth_aligning(rows.withColumn("bases", 1 + F.col("a") % 7 + F.col("b") % 7 + F.when(F.col("a") == F.col("b"), 2).otherwise(0)), 0.05)


_GREEDY = f"""WITH RECURSIVE {_N}, al AS (SELECT o, id, n * 20 AS r1, n * 20 + q AS r2, (s * 7) % 150 AS q1, (s * 7) % 150 + q - 3 AS q2 FROM n)"""


@query(f"""{_GREEDY}, sd AS (SELECT o, id, least(r1, r2) AS rb, greatest(r1, r2) AS re, least(q1, q2) AS qb, greatest(q1, q2) AS qe FROM al WHERE r1 <> r2 AND q1 <> q2),
t AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY rb - re, rb, re, qb, qe, id) AS k FROM sd),
g AS (SELECT o, 0::BIGINT AS k, []::STRUCT(id BIGINT, rb BIGINT, re BIGINT, qb BIGINT, qe BIGINT)[] AS kept FROM (SELECT DISTINCT o FROM t) UNION ALL
  SELECT g.o, t.k, CASE WHEN len(list_filter(kept, lambda x: (t.rb < x.re AND x.rb < t.re) OR (t.qb < x.qe AND x.qb < t.qe) OR (t.rb > x.rb AND t.qb <= x.qb) OR (t.rb < x.rb AND t.qb >= x.qb))) > 0 THEN kept
    ELSE list_append(kept, {{'id': t.id, 'rb': t.rb, 're': t.re, 'qb': t.qb, 'qe': t.qe}}) END FROM g JOIN t ON t.o = g.o AND t.k = g.k + 1)
SELECT o, unnest(arg_max(kept, k)).id AS id FROM g GROUP BY o""")
def colinear_alignments(spark: SparkSession, d: str) -> DataFrame:
    """Of an order's stretches those that don't cross, the longest first."""
    q = F.col("q")
    rows = _numbered(spark, d).select("o", "id", (F.col("n") * 20).alias("r1"), (F.col("n") * 20 + q).alias("r2"), (F.col("s") * 7 % 150).alias("q1"), (F.col("s") * 7 % 150 + q - 3).alias("q2"))
    return chains.colinear(rows, ["o"], ("r1", "r2"), ("q1", "q2")).select("o", "id")


@query(f"""{_GREEDY}, sd AS (SELECT o, id, p % 9 AS sc, n * 12 AS qb, n * 12 + q AS qe FROM n),
t AS (SELECT *, row_number() OVER (PARTITION BY o ORDER BY sc DESC, qb - qe, qb, qe, id) AS k FROM sd),
g AS (SELECT o, 0::BIGINT AS k, []::STRUCT(id BIGINT, qb BIGINT, qe BIGINT)[] AS kept, NULL::BIGINT AS id, NULL::BIGINT AS leader FROM (SELECT DISTINCT o FROM t) UNION ALL
  SELECT o, k, CASE WHEN m IS NULL THEN list_append(kept, {{'id': id, 'qb': qb, 'qe': qe}}) ELSE kept END, id, coalesce(m, id) FROM (
    SELECT g.o, t.k, kept, t.id, t.qb, t.qe, list_filter(kept, lambda x: least(t.qe, x.qe) > greatest(t.qb, x.qb) AND least(t.qe, x.qe) - greatest(t.qb, x.qb) >= 0.5 * least(t.qe - t.qb, x.qe - x.qb))[1].id AS m FROM g JOIN t ON t.o = g.o AND t.k = g.k + 1))
SELECT o, id, leader FROM g WHERE k > 0""")
def chain_groups(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of an order led by the best that they share half with."""
    rows = _numbered(spark, d).select("o", "id", (F.col("p") % 9).alias("score"), (F.col("n") * 12).alias("q_beg"), (F.col("n") * 12 + F.col("q")).alias("q_end"))
    return chains.leader_groups(rows, ["o"], 0.5)


# ---- rules -----------------------------------------------------------------------------------------


@query(f"""WITH {_N}, x AS (SELECT *, coalesce(sum(q - 1) OVER (PARTITION BY o ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre FROM n WHERE q > 1),
y AS (SELECT *, 60 + o % 40 AS size, least(60 + o % 40 - pre, q - 1) AS take FROM x WHERE pre < 60 + o % 40)
SELECT 'o' || o || ':' || (o % 9 + pre) || '-' || (o % 9 + pre + take) || '+' || chr(9) || 'p' || p || ':' || CASE WHEN rev THEN n + q - 1 - take || '-' || n + q - 1 || '-' ELSE n || '-' || n + take || '+' END AS line FROM y""")
def rules_to_map(spark: SparkSession, d: str) -> DataFrame:
    """Orders spelled by their lines' parts, as lines of a map file."""
    n = _numbered(spark, d)
    lo = F.col("o") % 9
    root = F.struct(_c("o", F.col("o")).alias("ctg"), lo.alias("beg"), (lo + 60 + F.col("o") % 40).alias("end"), F.lit(False).alias("rev"))
    parts = n.select(root.alias("root"), F.col("id").alias("ord"), _c("p", F.col("p")).alias("ctg"), F.col("n").alias("beg"), (F.col("n") + F.col("q") - 1).alias("end"), "rev")
    r = rewrite.expansion_records(parts)
    return r.select(maps.map_line(*[F.col(c) for c in ("a_ctg", "a_beg", "a_end", "b_ctg", "b_beg", "b_end")], F.col("rev")).alias("line"))


_OVERLAPS = f"""WITH {fx.ARCS_SQL.strip()}, z AS (SELECT p_partkey AS k, p_size::BIGINT + 10 AS len FROM part),
x AS (SELECT v, w, v * 1000000 + w AS link, a.len AS lv, b.len AS lw, least(ov, a.len) AS ov, least(ov + w % 3 - 1, b.len) AS ow FROM arcs JOIN z a ON a.k = v // 2 JOIN z b ON b.k = w // 2 WHERE (v + w) % 5 <> 0),
win AS (SELECT v, w, link, CASE WHEN v % 2 = 1 THEN 0 ELSE lv - ov END AS vb, CASE WHEN v % 2 = 1 THEN ov ELSE lv END AS ve, CASE WHEN w % 2 = 1 THEN lw - ow ELSE 0 END AS wb, CASE WHEN w % 2 = 1 THEN lw ELSE ow END AS we FROM x WHERE ov > 0 AND ow > 0)"""


def _windows(spark: SparkSession, d: str) -> DataFrame:
    a = fx.part_arcs(spark, d)
    arcs = a.select("v", "w", "ov", (F.col("ov") + F.col("w") % 3 - 1).alias("ow"), (F.col("v") * 1_000_000 + F.col("w")).alias("link_id"), ((F.col("v") + F.col("w")) % 5 == 0).alias("comp"))
    return rewrite.overlap_windows(arcs, fx.table(spark, d, "part").select(F.col("p_partkey").alias("seg_id"), (F.col("p_size").cast("long") + 10).alias("length")))


@query(f"{_OVERLAPS} SELECT DISTINCT v // 2 AS seg, unnest([vb, ve]) AS pos FROM win UNION SELECT w // 2, unnest([wb, we]) FROM win")
def overlap_cuts(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.overlap_cuts(_windows(spark, d))


@query(f"""{_OVERLAPS} SELECT v, w, vb, ve, wb, we FROM (SELECT *, row_number() OVER (PARTITION BY least(v // 2, w // 2), greatest(v // 2, w // 2) ORDER BY link, v, w) AS r FROM win) WHERE r = 1""")
def overlaps_to_align(spark: SparkSession, d: str) -> DataFrame:
    return rewrite.overlaps_to_align(_windows(spark, d)).select("v", "w", "vb", "ve", "wb", "we")


# ---- bubbles ---------------------------------------------------------------------------------------

_TIPS = f"""{_REAL}, tip AS (SELECT DISTINCT w AS v FROM real WHERE w NOT IN (SELECT v FROM real)),
walk AS (SELECT v AS tip, v, 0 AS d FROM tip UNION SELECT tip, r.v, d + 1 FROM walk JOIN real r ON r.w = walk.v WHERE d < 5),
far AS (SELECT tip, v, min(d) AS d FROM walk GROUP BY ALL),
pr AS (SELECT a.tip, b.tip AS other, a.v AS node, greatest(a.d, b.d) AS most, a.d + b.d AS total FROM far a JOIN far b ON a.v = b.v AND a.tip <> b.tip),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY tip ORDER BY most, total, other, node) AS k FROM pr) WHERE k = 1)"""


@query(f"{_TIPS} SELECT x.tip AS a, x.other AS b, x.node, x.most, x.total FROM best x JOIN best y ON x.tip = y.other AND x.other = y.tip WHERE x.tip < x.other")
def nearest_tips(spark: SparkSession, d: str) -> DataFrame:
    """Ends of the sparse graph that are each other's nearest, over what leads to both."""
    arcs = fx.sparse_arcs(spark, d)
    ends = arcs.select(F.col("w").alias("v")).distinct().join(arcs.select("v"), "v", "left_anti")
    return bubbles.nearest_tips(bubbles.back_reach(arcs, ends, 5))


_SEQ4 = "substr(translate(md5({0}::VARCHAR), '0123456789abcdef', 'ACGTACGTACGTACGT'), 1, 4)"
_SIGN = "CASE WHEN {0} % 2 = 1 THEN '-' ELSE '+' END"


@query(f"""{_CLOSED}, inn AS (SELECT DISTINCT bubble, v // 2 AS s FROM steps JOIN once ON source = bubble WHERE v // 2 <> source // 2 AND v // 2 <> sink // 2),
st2 AS (SELECT source AS bubble, source, sink, count(s) AS nodes, coalesce(sum(s % 50 + 1), 0)::BIGINT AS bp FROM once LEFT JOIN inn ON bubble = source GROUP BY source, sink),
keep AS (SELECT * FROM st2 WHERE nodes >= 2 AND bp >= 40), us AS (SELECT DISTINCT v // 2 AS s FROM steps WHERE bubble IN (SELECT bubble FROM keep)),
ps AS (SELECT t.bubble, path, pos, v, CASE WHEN v % 2 = 1 THEN reverse(translate({_SEQ4.format('(v // 2)')}, 'ACGT', 'TGCA')) ELSE {_SEQ4.format('(v // 2)')} END AS x FROM steps t JOIN keep k ON k.bubble = t.bubble WHERE v // 2 <> source // 2 AND v // 2 <> sink // 2),
pt AS (SELECT bubble, path, string_agg(CASE WHEN v % 2 = 1 THEN '<' ELSE '>' END || 'o' || v // 2, '' ORDER BY pos) AS way, string_agg(x, '' ORDER BY pos) AS seq FROM ps GROUP BY ALL)
SELECT concat_ws(chr(9), 'H', 'VN:Z:1.0') AS line UNION ALL
SELECT concat_ws(chr(9), 'H', 'bubble:i:' || bubble, 'source:o' || source // 2 || {_SIGN.format('source')}, 'sink:o' || sink // 2 || {_SIGN.format('sink')}, 'BT:Z:closed', 'BL:i:' || bp, 'BN:i:' || nodes) FROM keep UNION ALL
SELECT concat_ws(chr(9), 'S', 'o' || s, {_SEQ4.format('s')}, 'LN:i:' || (s % 50 + 1)) FROM us UNION ALL
SELECT concat_ws(chr(9), 'L', 'o' || v // 2, {_SIGN.format('v')}, 'o' || w // 2, {_SIGN.format('w')}, '0M') FROM real WHERE v // 2 IN (SELECT s FROM us) AND w // 2 IN (SELECT s FROM us) UNION ALL
SELECT concat_ws(chr(9), 'P', 'b' || bubble || '.p' || path - 1, way, '*', 'BI:i:' || bubble, 'PI:i:' || path - 1, 'PL:i:' || len(seq), 'SEQ:Z:' || seq) FROM pt""")
def bubble_graph(spark: SparkSession, d: str) -> DataFrame:
    """Bubbles with two segments and 40 bases inside, as lines of a graph file."""
    arcs, found, ways = _bubbles(spark, d)
    base = F.substring(F.translate(F.md5(F.col("seg_id").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 4)
    segs = _sizes(spark, d).select("seg_id", _c("o", F.col("seg_id")).alias("name"), base.alias("seq"), "length")
    real = arcs.where("v <> w").distinct().select("v", "w", F.lit(0).cast("long").alias("ov"), F.lit(0).cast("long").alias("ow"), F.lit(False).alias("comp"), (F.col("v") * 1_000_000 + F.col("w")).alias("link_id"))
    none = spark.createDataFrame([], "name string, pos int, seg_id long, rev boolean")
    reads = spark.createDataFrame([], "seg_id long, pos long, read_rev boolean, read_name string, read_start long, read_end long, tags string")
    told = found.select("bubble", "source", "sink", F.lit("closed").alias("kind")).join(bubbles.inner_counts(ways, found.select("bubble", "source", "sink"), _sizes(spark, d)), "bubble")
    return gfa.bubble_lines(gfa.Graph(segs, real, none, reads, none), told, ways, 40, 2).select("line")


# ---- records of alignments ----------------------------------------------------------------------------

_ALIGNED = f"""WITH {_N}, al AS (
  SELECT id, 'r' || o AS qname, o % 13 + n AS cs0, q % 9 AS AS_, 'p' || p AS rname, n * 10 AS r_beg, n * 10 + 20 AS r_end, s % 7 + 1 AS cm, s % 5 AS nm, q * 6 AS mapq, rev, substr({_BASES.replace('p_partkey', 'o')}, 1, 30) AS rd, md5(o::VARCHAR) AS ql,
         CASE WHEN n = 1 THEN '5S20M5S' WHEN n % 2 = 0 THEN '5H9=2X9M5H' ELSE '*' END AS cigar, CASE WHEN n = 1 THEN 'P' ELSE '' END AS tp, CASE WHEN p % 3 = 0 THEN 'x,' || n END AS sa, CASE WHEN rev THEN 16 ELSE 0 END AS flag FROM n),
rk AS (SELECT *, row_number() OVER w - 1 AS place, first_value(cm) OVER w AS s1, coalesce(nth_value(cm, 2) OVER (PARTITION BY qname ORDER BY cs0 DESC, AS_ DESC, rname, r_beg, r_end, flag ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 0) AS s2 FROM al
  WINDOW w AS (PARTITION BY qname ORDER BY cs0 DESC, AS_ DESC, rname, r_beg, r_end, flag)),
sq AS (SELECT *, CASE WHEN rev THEN reverse(translate(rd, 'ACGT', 'TGCA')) ELSE rd END AS s0, CASE WHEN rev THEN reverse(substr(ql, 1, 30)) ELSE substr(ql, 1, 30) END AS q0 FROM rk)"""


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    n = _numbered(spark, d)
    o, at = F.col("o"), F.col("n")
    text = F.when(at == 1, "5S20M5S").when(at % 2 == 0, "5H9=2X9M5H").otherwise("*")
    rows = n.select(
        _c("r", o).alias("qname"), (o % 13 + at).alias("chain_score"), (F.col("q") % 9).alias("AS"), _c("p", F.col("p")).alias("rname"), (at * 10).alias("r_beg"), (at * 10 + 20).alias("r_end"), (F.col("s") % 7 + 1).alias("cm"), F.lit(3).alias("cs"),
        (F.col("s") % 5).alias("NM"), (F.col("q") * 6).alias("mapq"), "rev", F.substring(F.translate(F.md5(o.cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT"), 1, 30).alias("read"), F.substring(F.md5(o.cast("string")), 1, 30).alias("qual"), text.alias("cigar"),
        F.when(at == 1, "P").otherwise("").alias("tp"), F.when(F.col("p") % 3 == 0, _c("x,", at)).alias("SA"), F.when(F.col("rev"), 16).otherwise(0).alias("flag"), F.lit(5).cast("long").alias("q_beg"), F.lit(24).cast("long").alias("q_end"), F.lit(500).cast("long").alias("tlen"),
    )
    return alignments.ranked(rows)


@query(f"""{_ALIGNED} SELECT concat_ws(chr(9), qname, flag, rname, r_beg + 1, mapq, cigar, '*', 0, 0, CASE WHEN cigar LIKE '%H' THEN substr(s0, 6, 20) ELSE s0 END, CASE WHEN cigar LIKE '%H' THEN substr(q0, 6, 20) ELSE q0 END,
  'AS:i:' || AS_, 'NM:i:' || nm, 'cm:i:' || cm, 'cs:i:3', 'tp:A:' || tp, CASE WHEN place = 0 THEN 's1:i:' || s1 END, CASE WHEN place = 0 AND s2 > 0 THEN 's2:i:' || s2 END, 'SA:Z:' || sa) AS line FROM sq""")
def aligned_sam(spark: SparkSession, d: str) -> DataFrame:
    return alignments.aligned_sam_lines(_aligned(spark, d)).select("line")


@query(f"""{_ALIGNED}, tpd AS (SELECT *, CASE WHEN tp = 'P' THEN 'P' WHEN place = 0 THEN 'P' ELSE 'S' END AS t FROM sq)
SELECT concat_ws(chr(9), qname, 30, CASE WHEN rev THEN 6 ELSE 5 END, CASE WHEN rev THEN 25 ELSE 24 END, CASE WHEN rev THEN '-' ELSE '+' END, rname, 500, r_beg, r_end, CASE cigar WHEN '*' THEN 0 WHEN '5S20M5S' THEN 20 ELSE 9 END,
  CASE cigar WHEN '*' THEN 0 ELSE 20 END, least(255, mapq), 'tp:A:' || t, 'cm:i:' || cm, 'cs:i:3', 'NM:i:' || nm, 'AS:i:' || AS_, CASE WHEN t = 'P' THEN 's1:i:' || s1 END, CASE WHEN t = 'P' AND s2 > 0 THEN 's2:i:' || s2 END, CASE WHEN cigar <> '*' THEN 'cg:Z:' || cigar END) AS line FROM tpd""")
def aligned_paf(spark: SparkSession, d: str) -> DataFrame:
    return alignments.aligned_paf_lines(_aligned(spark, d)).select("line")


# ---- lifting and chaining -----------------------------------------------------------------------------


@query(f"""WITH line AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity::BIGINT AS q FROM lineitem), {_PS_NORM},
bed AS (SELECT 'p' || p_partkey AS ctg, p_size::BIGINT + 30 AS beg, p_size::BIGINT + 70 AS "end", p_brand AS rest FROM part),
h AS (SELECT bed.*, b_ctg AS t, greatest(beg, a_beg) AS qb, least("end", a_end) AS qe, greatest(beg, a_beg) - dg AS tb, least("end", a_end) - dg AS te FROM bed JOIN pn ON ctg = a_ctg AND beg < a_end AND a_beg < "end" WHERE b_ctg <> ctg),
norm AS (SELECT ctg, rest, t, tb, te + CASE WHEN qe < "end" THEN 1 ELSE 0 END AS te, ctg || '_' || beg || '_' || "end" || CASE WHEN qb > beg THEN '_t5' ELSE '' END || CASE WHEN qe < "end" THEN '_t3' ELSE '' END AS name, ctg || ':' || qb || '-' || qe AS qs FROM h WHERE qe - qb >= 0.9 * ("end" - beg)),
wn AS (SELECT ctg, beg, "end", rest, side, r, CASE side WHEN 'L' THEN greatest(beg - r * 20 - 20, 0) ELSE "end" + r * 20 END AS wb, CASE side WHEN 'L' THEN greatest(beg - r * 20, 0) ELSE "end" + r * 20 + 20 END AS we FROM bed, (VALUES ('L'), ('R')) z(side), range(3) y(r)),
fh AS (SELECT wn.*, b_ctg AS t, greatest(wb, a_beg) AS qb, least(we, a_end) AS qe, greatest(wb, a_beg) - dg AS tb, least(we, a_end) - dg AS te FROM wn JOIN pn ON ctg = a_ctg AND wb < a_end AND a_beg < we WHERE wb < we AND b_ctg <> ctg),
fr AS (SELECT *, CASE side WHEN 'L' THEN abs(beg - qe) ELSE abs(qb - "end") END AS gap FROM (SELECT *, min(r) OVER (PARTITION BY ctg, side) AS r0 FROM fh) WHERE r = r0),
ft AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY ctg, side ORDER BY gap, qe - qb DESC, t, qb, tb, te) AS k FROM fr) WHERE k <= 2),
pr AS (SELECT * FROM (SELECT l.ctg, l.beg, l."end", l.rest, l.t, l.gap + r.gap AS gap, l.te AS tb, CASE WHEN l.te = r.tb THEN r.tb + 1 ELSE r.tb END AS te, l.ctg || ':' || l.qb || '-' || l.qe || '|' || r.qb || '-' || r.qe AS qs, l.t || ':' || l.tb || '-' || l.te || '|' || r.tb || '-' || r.te AS ts,
    row_number() OVER (PARTITION BY l.ctg ORDER BY l.gap + r.gap, l.t, l.qb, l.tb, r.qb, r.tb, r.te) AS k
  FROM ft l JOIN ft r ON l.ctg = r.ctg AND l.t = r.t WHERE l.side = 'L' AND r.side = 'R' AND r.tb >= l.te AND r.qb >= l.qe AND abs((r.tb - l.te) - (r.qb - l.qe)) <= 40) WHERE k <= 2),
ex AS (SELECT *, row_number() OVER (PARTITION BY ctg ORDER BY gap, t, qs, ts) AS i FROM pr WHERE NOT EXISTS (SELECT 1 FROM norm n WHERE n.ctg = pr.ctg AND n.t = pr.t AND n.tb < pr.te AND pr.tb < n.te)),
ok AS (SELECT * FROM ex WHERE NOT EXISTS (SELECT 1 FROM ex y WHERE y.ctg = ex.ctg AND y.t = ex.t AND y.i < ex.i AND y.tb < ex.te AND ex.tb < y.te))
SELECT t AS tname, tb AS tbeg, te AS tend, rest, name, '+' AS strand, qs AS query_span, t || ':' || tb || '-' || te AS target_span FROM norm UNION ALL
SELECT t, tb, te, rest, ctg || '_' || beg || '_' || "end" || '_ext', '+', qs, ts FROM ok""")
def map_liftover_extended(spark: SparkSession, d: str) -> DataFrame:
    """Rows of parts lifted to suppliers, and by their flanks where they have hits on both sides."""
    p = fx.table(spark, d, "part")
    size = F.col("p_size").cast("long")
    bed = p.select(F.col("p_partkey").alias("query_id"), _c("p", F.col("p_partkey")).alias("ctg"), (size + 30).alias("beg"), (size + 70).alias("end"), F.col("p_brand").alias("rest"))
    return tasks.liftover_all(bed, fx.part_supplier(spark, d), min_frac=0.9, max_flank=60, flank_win=20, max_gap=40, max_hit=2, max_hops=0)


@query()
def hit_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains of each order's stretches of parts modulo five."""
    ctg = F.substr("b_ctg", F.lit(2)).cast("long") % 5
    r = fx.order_part(spark, d).select(F.col("a_ctg").alias("query_id"), "rev", ctg.alias("ctg"), F.col("a_beg").alias("qbeg"), F.col("a_end").alias("qend"), (F.col("b_beg") % 400).alias("beg"), (F.col("b_beg") % 400 + F.col("a_end") - F.col("a_beg")).alias("end"))
    return chains.hit_chains(r, max_gap=300, max_shift=80)


@query()
def seed_chains(spark: SparkSession, d: str) -> DataFrame:
    """Documents against the benchmark: minimizers, seeds, chains, and chains joined."""
    docs, bench = fx.sequences(spark, d), fx.benchmark_sequences(spark, d)
    q = sketches.minimizers(docs, 9, 6, length=True)
    found = chains.seed_chains(sketches.seeds(q, sketches.minimizers(bench, 9, 6), 9, 0.01), 9, {"min_sc": 18, "min_cnt": 2, "max_dist": 500, "bw": 100})
    return chains.join_chains(found, 200, 50)


# ---- rewiring ----------------------------------------------------------------------------------------


def _junction_rounds(rounds: int) -> str:
    """Rounds of the rule filter, unrolled; each drops what the one before left."""
    out = []
    for i in range(rounds):
        out.append(f"""l{i} AS (SELECT seg, CASE WHEN n0 < n OR (n0 = n AND e0 - b0 < e - b) THEN b0 ELSE b END AS b FROM (
  SELECT *, lag(b) OVER w AS b0, lag(e) OVER w AS e0, lag(n) OVER w AS n0, lag(CASE WHEN rev THEN (f // 2) * 2 + 1 - f % 2 ELSE l END) OVER w AS out_, CASE WHEN rev THEN (l // 2) * 2 + 1 - l % 2 ELSE f END AS in_ FROM k{i} WINDOW w AS (PARTITION BY seg ORDER BY b, e)) WHERE e0 = b AND out_ = in_),
k{i + 1} AS (SELECT * FROM k{i} WHERE (seg, b) NOT IN (SELECT seg, b FROM l{i}))""")
    return ",\n".join(out)


@query(f"""WITH {_N}, k0 AS (SELECT p % 40 AS seg, n * n AS b, (n + 1) * (n + 1) AS e, p % 40 % 2 = 1 AS rev, count(*) AS n, arg_min(s % 2 * 2 + CASE WHEN rev THEN 1 ELSE 0 END, id) AS f, arg_max(s % 2 * 2 + CASE WHEN rev THEN 1 ELSE 0 END, id) AS l FROM n GROUP BY p % 40, n.n),
{_junction_rounds(8)} SELECT seg, b AS beg, e AS "end", n AS parts FROM k8""")
def rules_without_junctions(spark: SparkSession, d: str) -> DataFrame:
    """Rules whose neighbours don't end in the part that they begin with."""
    part = F.struct((F.col("s") % 2).alias("seg"), F.lit(0).cast("long").alias("beg"), F.lit(5).cast("long").alias("end"), "rev")
    n = _numbered(spark, d).select((F.col("p") % 40).alias("seg"), (F.col("n") * F.col("n")).alias("beg"), ((F.col("n") + 1) * (F.col("n") + 1)).alias("end"), (F.col("p") % 40 % 2 == 1).alias("key_rev"), F.col("id").alias("ord"), part.alias("part"))
    rules = n.withColumnRenamed("key_rev", "rev")
    return rewire.without_junctions(rules).groupBy("seg", "beg", "end").agg(F.count(F.lit(1)).alias("parts"))


_PARTS = f"""WITH {fx.ARCS_SQL.strip()}, z AS (SELECT p_partkey AS k, p_size::BIGINT AS s FROM part),
fw AS (SELECT k, CASE WHEN k % 3 = 0 THEN [{{'s': k % 7 + 1, 'b': 0, 'e': 5, 'r': 0}}, {{'s': k % 11 + 2, 'b': 3, 'e': 9, 'r': 1}}] ELSE [{{'s': k, 'b': 0, 'e': s, 'r': 0}}] END || [{{'s': k, 'b': s, 'e': 2 * s, 'r': 0}}] AS l FROM z),
vp AS (SELECT k * 2 AS v, l FROM fw UNION ALL SELECT k * 2 + 1, list_transform(list_reverse(l), lambda x: {{'s': x.s, 'b': x.b, 'e': x.e, 'r': 1 - x.r}}) FROM fw),
us AS (SELECT v FROM arcs UNION SELECT w FROM arcs),
ed AS (SELECT l[i] AS a, l[i + 1] AS b FROM (SELECT l, unnest(range(1, len(l))) AS i FROM vp WHERE v IN (SELECT v FROM us)) UNION SELECT x.l[-1], y.l[1] FROM arcs JOIN vp x ON x.v = arcs.v JOIN vp y ON y.v = arcs.w)"""


def _rewired(spark: SparkSession, d: str) -> DataFrame:
    z = fx.table(spark, d, "part").select(F.col("p_partkey").alias("seg"), F.col("p_size").cast("long").alias("s"))
    zero = F.lit(0).cast("long")
    cuts = z.select("seg", F.explode(F.array(zero, F.col("s"), 2 * F.col("s"))).alias("pos"))
    part = lambda o, s, b, e, r: F.struct(F.lit(o).alias("ord"), F.struct(s.alias("seg"), F.lit(b).cast("long").alias("beg"), F.lit(e).cast("long").alias("end"), F.lit(r).alias("rev")).alias("part"))
    rules = z.where("seg % 3 = 0").select("seg", zero.alias("beg"), F.col("s").alias("end"), F.explode(F.array(part(1, F.col("seg") % 7 + 1, 0, 5, False), part(2, F.col("seg") % 11 + 2, 3, 9, True))).alias("x")).select("seg", "beg", "end", "x.ord", "x.part")
    arcs = fx.part_arcs(spark, d).select("v", "w", zero.alias("ov"), zero.alias("ow"))
    return rewire.rewired(arcs, rewire.vertex_parts(cuts, rules))


@query(f"{_PARTS} SELECT a.s || ':' || a.b || '-' || a.e || CASE WHEN a.r = 1 THEN '-' ELSE '+' END AS a, b.s || ':' || b.b || '-' || b.e || CASE WHEN b.r = 1 THEN '-' ELSE '+' END AS b FROM ed")
def rewired_arcs(spark: SparkSession, d: str) -> DataFrame:
    """Parts of a graph that follow one another once rules have replaced a third of its segments' halves."""
    return _rewired(spark, d).select(spans.text(F.col("a")).alias("a"), spans.text(F.col("b")).alias("b"))


@query(f"""{_PARTS}, x AS (SELECT DISTINCT t.s, t.b, t.e FROM (SELECT a AS t FROM ed UNION ALL SELECT b FROM ed))
SELECT 'p' || s || ':' || b || '-' || e AS name, substr({_BASES}, b + 1, e - b) AS seq FROM x JOIN part ON p_partkey = s""")
def rewired_segments(spark: SparkSession, d: str) -> DataFrame:
    base = F.translate(F.md5(F.col("p_partkey").cast("string")), "0123456789abcdef", "ACGTACGTACGTACGT")
    segs = fx.table(spark, d, "part").select(F.col("p_partkey").alias("seg_id"), _c("p", F.col("p_partkey")).alias("name"), base.alias("seq"))
    return rewire.part_segments(_rewired(spark, d), segs).select("name", "seq")


@query(f"""WITH {_N}, x AS (SELECT id, n, q, CASE WHEN n = 1 THEN 4 ELSE 0 END AS lead, CASE WHEN rev THEN 3 ELSE 0 END AS trail, s % 5 AS dl FROM n)
SELECT id, 100 + CASE WHEN n = 1 THEN 4 ELSE 0 END AS r_beg, 100 + 4 * (n = 1)::INT + q + 2 + dl + q + 5 + 2 * rev_ AS r_end,
  n || 'S' || (q || '=' || CASE WHEN dl > 0 THEN (dl + 2) || 'D' ELSE '2D' END) || (q + 5) || '=' || '1I' || CASE WHEN rev_ = 1 THEN '2X' ELSE '' END || '7S' AS cigar FROM (SELECT *, (trail > 0)::INT AS rev_ FROM x)""")
def finished_cigars(spark: SparkSession, d: str) -> DataFrame:
    """Two blocks and the gap between them made one CIGAR, without deletions at its ends, clipped."""
    n = _numbered(spark, d)
    q, at, dl = F.col("q"), F.col("n"), F.col("s") % 5
    zero = F.lit(0).cast("long")
    block = lambda r, x, z, w: F.struct(r.alias("r_beg"), x.alias("r_end"), z.alias("q_beg"), w.alias("q_end"))
    # The first block has two places more on the reference, the second one more on the read; a gap of dl places.
    blocks = F.array(block(zero, q + 2, zero, q), block(zero, q + 5, zero, q + 6))
    gap = F.when(dl > 0, _c(dl, "D")).otherwise("*")
    lead = F.when(at == 1, "4D").otherwise("*")
    trail = F.when(F.col("rev"), "2X1D").otherwise("*")
    two = F.when(F.col("rev"), 2).otherwise(0)
    span_r = F.when(at == 1, 4).otherwise(0) + 2 * q + 7 + dl + F.when(F.col("rev"), 3).otherwise(0)
    span_q = 2 * q + 6 + two
    x = cigarkernel.finished(lead, blocks, F.array(gap), trail, F.lit(100), 100 + span_r, at, at + span_q, at + span_q + 7)
    return n.select("id", x.alias("x")).select("id", "x.r_beg", "x.r_end", "x.cigar")


@query(f"""WITH {_N}, x AS (SELECT id, s, lag(s) OVER (ORDER BY id) AS b FROM n) SELECT id AS ord FROM x WHERE s < b""")
def names_out_of_order(spark: SparkSession, d: str) -> DataFrame:
    """Lines whose read name comes before the last line's, numbers as numbers."""
    return scores.out_of_order(_numbered(spark, d).select(F.col("id").alias("ord"), _c("run", F.col("s"), "/x").alias("qname")), chunk=100_000).select("ord")
