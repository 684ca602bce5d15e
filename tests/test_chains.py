import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import bubbles, chains, sketches
from strandline.plans import tasks


def best_chain(hits, back, gap, shift):
    """The best chain of the hits that are left, over all hits in order: (its hits' places), by recursion."""
    alive = sorted(hits)
    memo = {}

    def best(i):
        if i not in memo:
            h = hits[i]
            top = (max(h[1] - h[0], 30), (i,))
            for j in range(i - 1, max(-1, i - back - 1), -1):
                if j not in alive:
                    continue
                g = hits[j]
                q = h[0] - g[1]
                t = g[2] - h[3] if h[4] else h[2] - g[3]
                diag = lambda x: x[3] + x[0] if x[4] else x[2] - x[0]
                if min(q, t) < 0 or max(q, t) > gap or (q and t and abs(diag(h) - diag(g)) > shift):
                    continue
                pay = 0.1 * (q + t) if q and t else 0.1 * math.sqrt(q + t)
                got = best(j)[0] + max(h[1] - h[0], 30) - int(pay + 0.5)
                if got > top[0]:
                    top = (got, best(j)[1] + (i,))
            memo[i] = top
        return memo[i]

    return best, memo, alive


def naive_chains(rows, back, gap, shift):
    hits = dict(enumerate(rows))
    out = []
    while hits:
        best, _, alive = best_chain(hits, back, gap, shift)
        i = max(alive, key=lambda n: (best(n)[0], -n))
        way = [hits[j] for j in best(i)[1]]
        out.append((min(w[0] for w in way), max(w[1] for w in way), min(w[2] for w in way), max(w[3] for w in way)))
        for j in best(i)[1]:
            del hits[j]
    return sorted(out)


@pytest.mark.parametrize("seed", range(3))
def test_hit_chains(spark, seed):
    rnd = random.Random(seed)
    rows, want = [], []
    for query in range(6):
        for rev in (False, True):
            own = []
            for _ in range(rnd.choice([1, 5, 40])):
                q, t, n = rnd.randrange(600), rnd.randrange(600), rnd.randrange(1, 60)
                own.append((q, q + n, t, t + n + rnd.randrange(3), rev))
            own.sort(key=lambda h: (h[0], h[1], h[3] if rev else h[2], h[2], h[3]))
            rows += [(query, rev, "c", *h[:4]) for h in own]
            want += [(query, rev, *c) for c in naive_chains(own, 10, 50, 20)]
    df = spark.createDataFrame(rows, "query_id long, rev boolean, ctg string, qbeg long, qend long, beg long, end long")
    got = chains.hit_chains(df, max_gap=50, max_shift=20)
    assert sorted((r.query_id, r.rev, r.qbeg, r.qend, r.beg, r.end) for r in got.collect()) == sorted(want)
    assert chains.hit_chains(df.limit(0)).count() == 0


def test_best_links_against_all_chains():
    o = {**chains.BASE, "bw": 6, "max_dist": 30, "pen_gap": 0.7, "pen_skip": 0.1}
    for seed in range(20):
        rnd = random.Random(seed)
        at = sorted({(rnd.randrange(40), rnd.randrange(40)) for _ in range(9)})
        score, _ = chains.best_links(at, 5, o)
        want = [5] * len(at)
        for n in range(2, len(at) + 1):
            for way in itertools.combinations(range(len(at)), n):
                steps = [chains.step_score(at[b][1] - at[a][1], at[b][0] - at[a][0], 5, o) for a, b in itertools.pairwise(way)]
                if None not in steps:
                    want[way[-1]] = max(want[way[-1]], 5 + sum(steps))
        assert score == want


@pytest.mark.parametrize("batch", [3, 10_000])
def test_seed_chains_of_many_parts(spark, monkeypatch, batch):
    monkeypatch.setattr(chains, "_ROWS", batch)
    rnd = random.Random(batch)
    rows = []
    for q in (None, *range(30)):
        for r in ("a", "b"):
            n, wide = rnd.choice([1, 2, 5, 40]), rnd.choice([60, 1500])
            rows += [(q, r, rnd.random() < 0.2, y, x) for x, y in {(rnd.randrange(wide), rnd.randrange(wide)) for _ in range(n)}]
            rows += [(q, r, False, 7 + x, x) for x in range(0, rnd.choice([0, 50]), 5)]
    preset = {"min_sc": 18, "min_cnt": 2, "max_dist": 100, "bw": 20, "pen_skip": 0.1}
    o, want, groups = {**chains.BASE, **preset}, [], {}
    for q, r, rev, y, x in rows:
        groups.setdefault((q, r, rev), []).append((x, y))
    for key, at in groups.items():
        at.sort()
        cuts = [0, *(i for i in range(1, len(at)) if at[i][0] - at[i - 1][0] > 100), len(at)]
        for beg, end in itertools.pairwise(cuts):
            part = at[beg:end]
            want += [(*key, s, len(w), chains.seed_blocks([part[i] for i in w], 9)) for s, w in chains.walk_back(*chains.best_links(part, 9, o), o)]
    df = spark.createDataFrame(rows, "q_name long, r_name string, rev boolean, q_pos long, r_pos long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = [(x.q_name, x.r_name, x.rev, x.score, x.n_seeds, [b.asDict() for b in x.blocks]) for x in chains.seed_chains(df, 9, preset).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(want) > 20 and sorted(got, key=str) == sorted(want, key=str)


def test_minimizers_tell_lengths(spark):
    # Sequences aren't read again for their lengths.
    seqs = spark.createDataFrame([(1, "ACGTTGCAACGGTA"), (2, "ACG"), (3, None), (4, "GATTACAGATTACAGG")], "name long, seq string")
    got = sketches.minimizers(seqs, 5, 3, length=True)
    assert {(r.name, r.length) for r in got.collect()} == {(1, 14), (4, 16)}
    assert sorted(map(tuple, got.drop("length").collect())) == sorted(map(tuple, sketches.minimizers(seqs, 5, 3).collect()))


def test_parts_that_cannot_chain():
    # No part reaches 18 but the last; they aren't walked seed by seed.
    parts = [[(0, 0)], [(0, 50), (1, 10), (2, 90)], [(0, 0), (3, 3)], [(x, x) for x in range(0, 40, 5)]]
    first = [0, 1, 4, 6]
    r, q = (np.array([x[c] for p in parts for x in p]) for c in (0, 1))
    assert chains.may_chain(r, q, np.array(first), 9, {**chains.BASE, "min_sc": 18, "min_cnt": 2}).tolist() == [False, False, False, True]
    assert chains.may_chain(r, q, np.array(first), 9, {**chains.BASE, "min_sc": 9, "min_cnt": 1}).all()


def test_walk_back_takes_each_seed_once():
    at = [(x, x) for x in range(0, 60, 5)] + [(500 + x, 100 + x) for x in range(0, 40, 5)]
    o = {**chains.BASE, "min_sc": 10}
    found = chains.walk_back(*chains.best_links(at, 10, {**o, "max_dist": 100}), o)
    assert [len(w) for _, w in found] == [12, 8]
    assert found[0][0] == 10 + 11 * 5
    assert chains.walk_back([], [], o) == []


def test_seed_blocks():
    assert chains.seed_blocks([(0, 0), (5, 5), (10, 10), (12, 30), (25, 40)], 5) == [{"r_beg": 0, "r_end": 15, "q_beg": 0, "q_end": 15}, {"r_beg": 25, "r_end": 30, "q_beg": 40, "q_end": 45}]
    assert chains.seed_blocks([(0, 0), (3, 3), (7, 5)], 5) == [{"r_beg": 0, "r_end": 5, "q_beg": 0, "q_end": 5}, {"r_beg": 7, "r_end": 12, "q_beg": 5, "q_end": 10}]


def test_join_chains(spark):
    b = lambda *x: [dict(zip(("r_beg", "r_end", "q_beg", "q_end"), x))]
    rows = [
        ("q", "r", False, 30, 3, b(0, 50, 0, 50)), ("q", "r", False, 20, 2, b(60, 90, 65, 95)),  # shortly behind
        ("q", "r", False, 15, 2, b(80, 120, 85, 125)),  # meets it on the diagonal
        ("q", "r", False, 10, 2, b(500, 520, 510, 530)),  # too far
        ("q", "r", True, 9, 1, b(60, 90, 65, 95)),
    ]
    kind = f"q_name string, r_name string, rev boolean, score long, n_seeds long, blocks {chains._BLOCKS}"
    got = sorted((r.rev, r.score, r.n_seeds, [tuple(x) for x in r.blocks]) for r in chains.join_chains(spark.createDataFrame(rows, kind), 100, 20).collect())
    assert got == [(False, 10, 2, [(500, 520, 510, 530)]), (False, 65, 7, [(0, 50, 0, 50), (60, 120, 65, 125)]), (True, 9, 1, [(60, 90, 65, 95)])]


def test_worth_aligning(spark):
    rows = [(1, 1, 2, 10), (2, 2, 1, 10), (2, 3, 4, 1), (3, 3, 4, 1), (4, 5, 6, 0)]
    df = spark.createDataFrame(rows, "cand long, a long, b long, bases long")
    assert [r.cand for r in chains.worth_aligning(df, 0.1).collect()] == [1]
    assert sorted(r.cand for r in chains.worth_aligning(df, 0.05).collect()) == [1, 2]


def test_open_bubbles(spark):
    # 2 -> 4 -> 6 (tip), 2 -> 8 (tip), and a tip of another part.
    arcs = spark.createDataFrame([(2, 4), (4, 6), (2, 8), (20, 22)], "v long, w long")
    tips = spark.createDataFrame([(6,), (8,), (22,)], "v long")
    pairs, ways = bubbles.open_bubbles(arcs, tips, 4)
    assert [tuple(r) for r in pairs.collect()] == [(6, 2, 6, 8)]
    assert sorted((r.path, r.pos, r.v) for r in ways.collect()) == [(1, 0, 2), (1, 1, 4), (1, 2, 6), (2, 0, 2), (2, 1, 8)]


def test_liftover_all(spark):
    records = spark.createDataFrame([("a", 0, 40, "b", 100, 140, False), ("a", 60, 100, "b", 160, 200, False), ("a", 0, 40, "z", 60, 100, True), ("a", 60, 100, "z", 0, 40, True)], "a_ctg string, a_beg long, a_end long, b_ctg string, b_beg long, b_end long, rev boolean")
    bed = spark.createDataFrame([(1, "a", 45, 55, "x"), (2, "a", 10, 20, "y"), (3, "none", 1, 5, "")], "query_id long, ctg string, beg long, end long, rest string")
    got = sorted((r.tname, r.tbeg, r.tend, r.rest, r.name, r.strand, r.query_span, r.target_span) for r in tasks.liftover_all(bed, records, max_hops=0, flank_win=20, max_flank=60).collect())
    assert got == [
        ("b", 110, 120, "y", "a_10_20", "+", "a:10-20", "b:110-120"), ("b", 140, 160, "x", "a_45_55_ext", "+", "a:25-40|60-75", "b:125-140|160-175"),
        ("z", 40, 60, "x", "a_45_55_ext", "-", "a:25-40|60-75", "z:60-75|25-40"), ("z", 80, 90, "y", "a_10_20", "-", "a:10-20", "z:80-90"),
    ]
    assert {r.name for r in tasks.liftover_all(bed, records, max_hops=0, max_flank=0, regex="^b").collect()} == {"a_10_20"}
    rows = spark.createDataFrame([("a", 100, 0, 100, "+", "b", 300, 100, 200, "100M")], "qname string, qlen long, qstart long, qend long, strand string, tname string, tlen long, tstart long, tend long, cg string")
    both = tasks.liftover_all(bed, records, rows, max_hops=0, flank_win=20, max_flank=60)
    # Alignments' results stay, the map's go where they overlap them.
    assert sorted((r.tname, r.tbeg, r.tend, r.query_span) for r in both.collect() if r.tname == "b") == [("b", 110, 120, None), ("b", 145, 155, None)]
    assert both.where(F.col("tname") == "z").count() == 2
