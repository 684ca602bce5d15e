import pytest
from pyspark.sql import functions as F

from strandline.functions import cigar, dna
from strandline.operators import graph, lift
from strandline.plans import tasks
from strandline.sources import read_bed, read_fasta, read_fastq, read_gaf, read_gfa, read_map, read_paf, read_paths, read_sam, write_fasta, write_gfa, write_map, write_sam


@pytest.fixture
def put(tmp_path):
    def f(name, text):
        p = tmp_path / name
        p.write_text(text)
        return str(p)

    return f


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])


def test_cigar_vectors(spark):
    c = one(spark, c="10M5I10M2D3M").withColumn("o", cigar.ops(F.col("c")))
    r = c.select(
        cigar.ref_span(F.col("o")), cigar.match_len(F.col("o")), cigar.query_span(F.col("o")), cigar.pack(cigar.swap(F.col("o"), F.lit(True))), cigar.pack(cigar.swap(F.col("o"), F.lit(False)))
    ).first()
    assert tuple(r) == (25, 23, 28, "3M2I10M5D10M", "10M5D10M2I3M")
    b = one(spark, c="5M2D3M10N4M").select(cigar.ref_blocks(F.lit(100), cigar.ops(F.col("c"))).alias("b")).first().b
    assert [tuple(x) for x in b] == [(100, 110), (120, 124)]
    q = one(spark, c="3S5M2H").select(cigar.query_interval_fwd(cigar.ops(F.col("c")), F.lit(False)).alias("f"), cigar.query_interval_fwd(cigar.ops(F.col("c")), F.lit(True)).alias("r")).first()
    assert tuple(q.f) == (3, 8) and tuple(q.r) == (2, 7)
    m = one(spark, c="3M2M1I1I4M").select(cigar.pack(cigar.merge_runs(cigar.ops(F.col("c")))).alias("p"), cigar.pack(cigar.ops(F.lit("*"))).alias("e")).first()
    assert (m.p, m.e) == ("5M2I4M", "*")
    assert one(spark, s="ACGTNacgt").select(dna.revcomp(F.col("s"))).first()[0] == "acgtNACGT"


def test_map_sides(spark, put):
    path = put("x.map", "# a comment\nA1:100-110;A2:206-200\tB1:500-508;B2:900-908\n\nq:0-20+ A:100-110;B:208-200;C:50-70:6-26 more\nm:0-18+ A:100-110;B:200-208-\n")
    got = sorted(tuple(r) for r in read_map(spark, path).collect())
    assert {t for t in got if t[0][0] == "A"} == {("A1", 100, 108, "B1", 500, 508, False), ("A1", 108, 110, "B2", 900, 902, False), ("A2", 200, 206, "B2", 902, 908, True)}
    assert [t[3:6] for t in got if t[0] == "q"] == [("A", 106, 110), ("B", 200, 208), ("C", 50, 58)]
    assert [(t[3:6], t[6]) for t in got if t[0] == "m"] == [(("B", 200, 208), True), (("A", 100, 110), True)]
    for bad in ("A:0-5 B:0-6\n", "A:3-3 B:3-3\n", "A B:1-2\n"):
        with pytest.raises(Exception):
            read_map(spark, put("bad.map", bad)).collect()


MAP = "ctgA:0-100+ readR:0-100+\nreadR:0-100+ utgU:500-600-\n"


def test_two_hop_lift(spark, put, tmp_path):
    m, bed = read_map(spark, put("x.map", MAP)), read_bed(spark, put("x.bed", "#h\nctgA 10 20 geneX\nctgA 30 30\nbad line\nctgA 40 35\n"))
    assert sorted(tuple(r)[1:] for r in bed.collect()) == [("ctgA", 10, 20, "geneX"), ("ctgA", 35, 40, "")]
    gene = bed.where("rest = 'geneX'")
    out = {tuple(r) for r in tasks.liftover(gene, m, max_hops=1).collect()}
    assert out == {
        ("readR", 10, 20, "geneX", "ctgA_10_20", "+", "ctgA:10-20", "readR:10-20"), ("utgU", 580, 590, "geneX", "ctgA_10_20", "-", "ctgA:10-20", "utgU:580-590"),
    }
    assert {r.tname for r in tasks.liftover(gene, m, max_hops=0).collect()} == {"readR"}
    back = read_map(spark, (write_map(m, str(tmp_path / "out.map")), str(tmp_path / "out.map"))[1])
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, m.collect()))
    tasks.lift_files(spark, put("y.map", MAP), put("y.bed", "ctgA 10 20 geneX\n"), str(tmp_path / "lift"), max_hops=1)
    assert spark.read.text(str(tmp_path / "lift")).count() == 2


def walk(q, records, hops):
    """map_range by a queue, without limits."""
    both = [(a, b, c, d, e, f, g) for a, b, c, d, e, f, g in records] + [(d, e, f, a, b, c, g) for a, b, c, d, e, f, g in records]
    seen, out, queue = set(), [], [(q[0], q[1], q[2], q[1], q[2], False, 0)]
    while queue:
        ctg, beg, end, sb, se, rev, depth = queue.pop(0)
        hits = []
        for c, b, e, t, tb, te, r in both:
            lo, hi = max(beg, b), min(end, e)
            if c == ctg and lo < hi:
                hits.append((r, t, lo, hi, te - (hi - b) if r else tb + lo - b, te - (lo - b) if r else tb + hi - b))
        size = end - beg
        need = min(size, max(15, -(-size // 10)))
        hits = [h for h in hits if not depth or (h[3] - h[2] >= need and h[5] - h[4] >= need)]
        for r, t, lo, hi, tb, te in merged(hits):
            if t in (q[0], ctg) or (t, tb, te, rev != r) in seen:
                continue
            seen.add((t, tb, te, rev != r))
            s = (se - (hi - beg), se - (lo - beg)) if rev else (sb + lo - beg, sb + hi - beg)
            out.append((rev != r, t, *s, tb, te))
            if depth < hops:
                queue.append((t, tb, te, *s, rev != r, depth + 1))
    return merged(out)


def merged(hits):
    out = []
    for h in sorted(hits):
        if out:
            p = out[-1]
            q, t = p[3] - h[2], (h[5] - p[4] if h[0] else p[5] - h[4])
            if p[:2] == h[:2] and q == t >= 0:
                out[-1] = (h[0], h[1], p[2], max(p[3], h[3]), min(p[4], h[4]), max(p[5], h[5]))
                continue
        out.append(h)
    return out


def test_map_range_against_a_queue(spark):
    import random

    r = random.Random(7)
    records = []
    for _ in range(60):
        n = r.choice([20, 40, 60])
        a, b = r.sample(range(8), 2)
        x, y = r.randrange(0, 200, 10), r.randrange(0, 200, 10)
        records.append((f"c{a}", x, x + n, f"c{b}", y, y + n, r.random() < 0.4))
    df = spark.createDataFrame(records, lift.MAP)
    queries = [(i, f"c{i % 8}", 10 * i, 10 * i + 50) for i in range(10)]
    got = lift.map_range(spark.createDataFrame(queries, "query_id long, ctg string, beg long, end long"), df, max_hops=2, max_fanout=10**6, max_nodes=10**6).collect()
    mine = sorted((x.query_id, x.rev, x.ctg, x.qbeg, x.qend, x.beg, x.end) for x in got)
    assert mine == sorted((i, *h) for i, *q in queries for h in walk(tuple(q), records, 2))


def test_mapq_boost(spark, put, tmp_path):
    sam = "@HD\tVN:1.6\nr1\t0\tctgA\t11\t0\t10M\t*\t0\t0\tACGTACGTAC\t*\tNM:i:0\nr1\t272\tutgU\t581\t0\t10M\t*\t0\t0\t*\t*\tNM:i:0\nr2\t0\tctgA\t50\t1\t10M\t*\t0\t0\tACGTACGTAC\t*\tNM:i:0\tXA:Z:utgU,-542,10M,0;\nr3\t4\t*\t0\t0\t*\t*\t0\t0\tA\t*\nr4\t0\tctgA\t50\t1\t10M\t*\t0\t0\tACGTACGTAC\t*\tNM:i:0\tXA:Z:utgU,-100,10M,0;\n"
    records, head = read_sam(spark, put("x.sam", sam))
    m = read_map(spark, put("x.map", MAP))
    up = {(r.qname, r.flag): r.mapq for r in tasks.mapq_boost(records, m).collect()}
    assert up == {("r1", 0): 60, ("r1", 272): 0, ("r2", 0): 60, ("r3", 4): 0, ("r4", 0): 1}
    none = tasks.mapq_boost(records, m.where("false"))
    assert {(r.qname, r.flag): r.mapq for r in none.collect()} == {("r1", 0): 0, ("r1", 272): 0, ("r2", 0): 1, ("r3", 4): 0, ("r4", 0): 1}
    write_sam(records, head, str(tmp_path / "out"))
    assert "\n".join(r.value for r in spark.read.text(str(tmp_path / "out")).collect()) + "\n" == sam


GFA = "H\tVN:Z:1.0\nS\ta\tACGT\tLN:i:4\nS\tb\tGTTT\nS\tc\t*\tLN:i:5\nS\te\t*\nL\ta\t+\tb\t+\t2M\nL\tb\t+\tc\t-\t0M\nP\tp1\ta+,b+\t*\nA\tb\t0\t+\tr1\t0\t3\tid:i:1\nA\tb\t2\t-\tr2\t0\t5\nA\tzz\t0\t+\tr3\t0\t1\n"


def test_graph_file(spark, put, tmp_path):
    g = read_gfa(spark, put("x.gfa", GFA))
    assert {(r.name, r.length) for r in g.segments.collect()} == {("a", 4), ("b", 4), ("c", 5)}
    s = tasks.stat(g).first()
    assert (s.nodes, s.links, s.arcs, s.total_length, s.max_degree) == (3, 2, 4, 13, 1)
    d = {r.name: r.depth for r in tasks.depth_of_placements(g).collect()}
    assert d == {"a": 0.0, "b": 1.25, "c": 0.0}
    assert [r.depth for r in tasks.base_depth(g, tasks.placement_runs(g)).where("name = 'b'").orderBy("pos").collect()] == [1, 1, 2, 1]
    p = tasks.path_sequences(g, read_paths(spark, put("p.txt", "# none\n>a>b\nb-,a-\n>a>c\n>a>nobody\n"))).collect()
    assert {r.path: r.seq for r in p} == {">a>b": "ACGTTT", "b-,a-": "AAACGT", ">a>c": "*", ">a>nobody": "*"}
    write_gfa(g, str(tmp_path / "g"))
    again = read_gfa(spark, str(tmp_path / "g"))
    assert tuple(tasks.stat(again).first()) == tuple(s) and again.paths.count() == 2
    assert {r.name for r in tasks.fasta_of(g).collect()} == {"a", "b"}
    assert {tuple(r)[:6] for r in tasks.map_of_placements(g).collect()} == {("b", 0, 3, "r1", 0, 3), ("b", 2, 7, "r2", 0, 5)}


def test_unitigs_forks_tips(spark, put):
    g = read_gfa(spark, put("u.gfa", "S\ta\tAC\nS\tb\tGG\nS\tc\tTT\nL\ta\t+\tb\t+\t0M\nL\tb\t+\tc\t+\t0M\n"))
    u = tasks.collapse_unitigs(g).collect()
    assert len(u) == 1 and (u[0].members, u[0].seq) in {("a+,b+,c+", "ACGGTT"), ("c-,b-,a-", "AACCGT")}
    ring = read_gfa(spark, put("r.gfa", "S\ta\tAC\nS\tb\tGG\nL\ta\t+\tb\t+\t0M\nL\tb\t+\ta\t+\t0M\n"))
    assert tasks.collapse_unitigs(ring).count() == 0
    f = read_gfa(spark, put("f.gfa", "S\ta\tAC\nS\tb\tGG\nS\tc\tTT\nL\ta\t+\tb\t+\t*\nL\ta\t+\tc\t+\t0M\nL\ta\t+\tb\t+\t0M\n"))
    assert [len(r.branches) for r in graph.forks(f.arcs).collect()] == [2]


def test_gaf_depth_and_paf_map(spark, put):
    g = read_gfa(spark, put("x.gfa", "S\ta\tACGTACGT\nS\tb\tGGGG\n"))
    gaf, bad = read_gaf(spark, put("x.gaf", "r\t8\t0\t8\t+\t>a<b\t12\t6\t12\t6\t6\t60\tcg:Z:4M1D1M\nr2\t8\t0\t8\t+\t>zz\t12\t6\t12\t6\t6\t60\tcg:Z:4M\nbroken line\nr3\t8\t0\t2\t+\t>a\t8\t0\t2\t2\t2\t60\tcg:Z:2M\n"))
    assert bad.count() == 1 and gaf.count() == 3
    names = {r.seg_id: r.name for r in g.segments.collect()}
    runs = {(names[r.seg_id], r.beg, r.end, r.depth) for r in tasks.gaf_runs(g, gaf).collect()}
    assert runs == {("a", 6, 8, 1), ("b", 2, 4, 1), ("b", 0, 1, 1)}
    paf = read_paf(spark, put("x.paf", "q\t100\t10\t40\t-\tt\t100\t0\t33\t30\t33\t60\ttp:A:P\tcg:Z:10=3D5=2X13M\n"))
    rows = {tuple(r) for r in tasks.map_of_paf(paf, min_len=50).collect()}
    assert rows == {("t", 0, 10, "q", 30, 40, True), ("t", 13, 33, "q", 10, 30, True)}
    with pytest.raises(Exception):
        read_paf(spark, put("bad.paf", "q\t1\n")).collect()
    with pytest.raises(Exception):
        tasks.map_of_paf(paf.withColumn("tname", F.lit("q")), primary_only=False).collect()


def test_sequences_files(spark, put, tmp_path):
    fa = read_fasta(spark, put("x.fa", ">a one\nACG\nT\n>b\nGG\n"))
    assert sorted(map(tuple, fa.collect())) == [("a", "ACGT"), ("b", "GG")]
    write_fasta(fa, str(tmp_path / "fa"), 3)
    assert sorted(map(tuple, read_fasta(spark, str(tmp_path / "fa")).collect())) == [("a", "ACGT"), ("b", "GG")]
    fq = read_fastq(spark, put("x.fq", "@r1 x\nACGT\n+\n@III\n@r2\nGG\n+r2\nII\n"))
    assert sorted(map(tuple, fq.collect())) == [("r1", "ACGT", "@III"), ("r2", "GG", "II")]
