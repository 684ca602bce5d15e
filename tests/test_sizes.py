"""What must not grow with the tables: keys a row, readings of a line, numbers that collide."""

import datetime
import random
import time

import pytest
from pyspark.sql import functions as F

from strandline.operators import flanks, graph, intervals, lift, paf, sketches
from strandline.plans import queries
from strandline.sources import alignments, lines


def test_overlap_join_levels(spark):
    rng = random.Random(5)
    rows = lambda longest: [(i % 3, b, b + rng.choice([1, 40, longest])) for i, b in ((i, rng.randrange(9000)) for i in range(60))]
    for most in (50, 9000, 3_000_000):
        x, y = rows(most), rows(50)
        a, b = spark.createDataFrame(x, "k int, b long, e long"), spark.createDataFrame(y, "k int, c long, f long")
        want = sorted((k, p, q, r, s) for k, p, q in x for n, r, s in y if k == n and p < s and r < q)
        known = intervals.levels_of(a, "b", "e"), intervals.levels_of(b, "c", "f")
        for levels in (known, (None, known[1]), (known[0], None), (None, None)):
            got = intervals.overlap_join(a, b, ["k"], ("b", "e"), ("c", "f"), levels=levels)
            assert sorted(map(tuple, got.select("k", "b", "e", "c", "f").collect())) == want
    # Short intervals on both sides have no key on wider levels.
    level, bins = intervals._bins(F.col("c"), F.col("f"), 128, [0], [0])
    assert b.withColumn("_at", level).select(F.max(F.size(bins))).first()[0] <= 2
    assert intervals.levels_up_to(4096) == [0] and intervals.levels_up_to(4097) == [0, 1]


def test_longer_than_told(spark):
    a, b = spark.createDataFrame([(1, 0, 5000)], "k int, b long, e long"), spark.createDataFrame([(1, 0, 10)], "k int, c long, f long")
    with pytest.raises(Exception, match="longer than told"):
        intervals.overlap_join(a, b, ["k"], ("b", "e"), ("c", "f"), levels=([0], [0])).collect()


def test_keep_best_one_exchange(spark):
    rows = spark.createDataFrame([(1, "c", False, 0, 9, 0), (1, "c", False, 5, 20, 1), (1, "c", False, 9, 12, 2), (1, "c", False, 11, 30, 3), (1, "d", False, 11, 30, 4)], "query_id int, ctg string, rev boolean, beg long, end long, win int")
    kept = lift.keep_best(rows.where("win = 0"), rows.where("win > 0"), [F.desc(F.col("end") - F.col("beg"))])
    assert sorted(r.win for r in kept.collect()) == [0, 3, 4]
    assert kept._jdf.queryExecution().sparkPlan().toString().count("Join") == 0


def test_lines_are_read_once(spark):
    text = spark.createDataFrame([("q\t9\t0\t9\t+\tt\t9\t0\t9\t9\t9\t60\ttp:A:P\tcg:Z:9M", 1)], "value string, ord long")
    usable = paf.with_twins(paf.usable(alignments.parse_paf(text), lines.tag, min_len=1))
    assert sorted(r.qname for r in usable.collect()) == ["q", "t"]
    plan = usable._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(value") == 1


def _tables(tmp_path, spark, parts, lines_):
    day = datetime.datetime(2020, 1, 1)
    spark.createDataFrame([(p, s) for p, s in parts], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(o, n, p, 1, day, float(n), 5.0, "N") for o, n, p in lines_], "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate timestamp_ntz, l_extendedprice double, l_quantity double, l_returnflag string").write.parquet(f"{tmp_path}/lineitem.parquet")
    return str(tmp_path)


def _same_as_sql(spark, name, d):
    import duckdb

    c = duckdb.connect()
    for t in ("part", "lineitem"):
        c.execute(f"create view {t} as select * from '{d}/{t}.parquet/*.parquet'")
    df = queries.QUERIES[name](spark, d)
    names = ", ".join(f'"{x}"' for x in df.columns)
    assert sorted(str(tuple(r)) for r in df.collect()) == sorted(map(str, c.execute(f"select {names} from ({queries.ORACLES[name]})").fetchall()))


def test_gfa_links_of_many_parts(spark, tmp_path):
    # v * 1,000,000 + w is the same for both arcs.
    d = _tables(tmp_path, spark, [(1, 9), (500_009, 9), (2, 9), (9, 9)], [(1, 1, 1), (1, 2, 500_009), (2, 1, 2), (2, 2, 9)])
    _same_as_sql(spark, "gfa_links", d)
    d = _tables(tmp_path / "more", spark, [(7, 9), (1_000_009, 9), (8, 9), (9, 9)], [(1, 1, 7), (1, 2, 1_000_009), (2, 1, 8), (2, 2, 9)])
    _same_as_sql(spark, "gfa_links", d)


def test_graph_edits_of_many_parts(spark, tmp_path):
    # The segment that comes in is there already, with an arc that is joined once more.
    d = _tables(tmp_path, spark, [(1, 9), (1_000_001, 30), (3, 7)], [(1, 1, 1), (1, 2, 1_000_001), (1, 3, 3)])
    _same_as_sql(spark, "graph_edits", d)


def test_edit_adds_no_arc_again(spark):
    s = spark.createDataFrame([(1,), (2,)], "seg_id long")
    had = spark.createDataFrame([(2, 4, 0, 0, 0, 9, False)], "v long, w long, ov long, ow long, rank int, link_id long, comp boolean")
    assert graph.edit(s, had, join=had.drop("comp"))[1].count() == 2
    assert graph.edit(s, had, join=had.drop("comp"), parallel=True)[1].count() == 3


def test_kmers_of_long_sequences(spark, monkeypatch):
    def plain(seq, k, palindromes):
        turned = lambda x: x[::-1].translate(str.maketrans("ACGT", "TGCA"))
        each = ((i, seq[i : i + k].upper()) for i in range(len(seq) - k + 1))
        return [(i, min(x, turned(x))) for i, x in each if set(x) <= set("ACGT") and (palindromes or x != turned(x))]

    rng = random.Random(3)
    monkeypatch.setattr(sketches, "_PLACES", 50)
    texts = ["", "ACG", "acgtACGT", "NNNN", "AC\u00dfGTACGTT"] + ["".join(rng.choice("ACGTACGTACGTNact") for _ in range(n)) for n in (7, 60, 700)]
    seqs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "name long, seq string").repartition(1)
    for k in (4, 11, 40):
        for whole in (False, True):
            want = sorted((i, *x) for i, t in enumerate(texts) for x in plain(t, k, whole))
            assert sorted(map(tuple, sketches.kmer_rows(seqs, k, whole).collect())) == want
    # One sequence of 200,000 bases: its square was the work before.
    long = spark.createDataFrame([(1, "ACGTTGCAAC" * 20_000)], "name long, seq string")
    start = time.perf_counter()
    assert sketches.kmer_rows(long, 13, True).count() == 199_988
    assert time.perf_counter() - start < 20


def test_walks_send_nothing_by_the_driver(spark, monkeypatch):
    plans = []
    keep = lambda df: (real(df), plans.append(df._jdf.queryExecution().executedPlan().toString()))[0]  # noqa: E731  as it was run
    real = flanks.cut
    monkeypatch.setattr(flanks, "cut", keep)
    segs = spark.createDataFrame([(i, f"s{i}", "ACGT"[i % 4] * 3 if i != 5 else "*", 3) for i in range(8)], "seg_id long, name string, seq string, length long")
    arcs = spark.createDataFrame([(2 * i, 2 * i + 2, 1, 1, i) for i in range(7)], "v long, w long, ov long, ow long, link_id long")
    starts = spark.createDataFrame([(0, 5), (4, 9), (12, 9)], "start long, need long")
    assert {r.start: r.seq for r in flanks.flanks(segs, arcs, starts, False).collect()} == {0: "CCGGT"[:5], 4: "TTAA", 12: "TT"}
    assert len(plans) > 3 and all("isFinalPlan=true" in p and "Broadcast" not in p for p in plans[1:])


def test_searches_share_the_map(spark, monkeypatch):
    from strandline.plans import tasks

    made = []
    real = lift.cut
    monkeypatch.setattr(lift, "cut", lambda df: (made.append(tuple(df.columns)), real(df))[1])
    monkeypatch.setattr(tasks, "cut", lambda df: (made.append(tuple(df.columns)), real(df))[1])
    m = spark.createDataFrame([("p", 0, 30, "s", 0, 30, False), ("p", 70, 90, "s", 75, 95, False)], lift.MAP)
    bed = spark.createDataFrame([(1, "p", 40, 60, "x")], "query_id long, ctg string, beg long, end long, rest string")
    got = tasks.liftover_all(bed, m, min_frac=0.9, max_flank=60, flank_win=20, max_gap=40, max_hit=2, max_hops=0).collect()
    assert [(r.tname, r.tbeg, r.tend, r.name) for r in got] == [("s", 30, 75, "p_40_60_ext")]
    assert sum("a_beg" in c for c in made) == 1
    # A side is left out only where direct hits alone are asked for and it has none of the contigs.
    assert [lift.known(m, 128, c).both.count() for c in (None, bed, bed.selectExpr("'s' AS ctg"), bed.selectExpr("explode(array('s', 'p')) AS ctg"), bed.selectExpr("'z' AS ctg"))] == [4, 2, 2, 4, 0]
