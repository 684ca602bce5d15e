import random

import pytest

from strandline.functions import cigar
from strandline.operators import rewire
from strandline.plans import options


def split(ops, beg_a, beg_b, a, b):
    """Base by base: the node of either side at each step; a new alignment after each end of a node."""
    def places(path):
        return [(k, i) for k, (_, n) in enumerate(path) for i in range(n)]

    pa, pb = places(a), places(b)
    ia, ib, out, cur = beg_a, beg_b, [], []
    for n, op in ops:
        for _ in range(n):
            on_a, on_b = op in "M=XD", op in "M=XI"
            if (on_a and ia >= len(pa)) or (on_b and ib >= len(pb)):
                continue
            na = pa[ia] if ia < len(pa) else (len(a) - 1, a[-1][1])
            nb = pb[ib] if ib < len(pb) else (len(b) - 1, b[-1][1])
            cur.append((op, na, nb, on_a, on_b))
            ia, ib = ia + on_a, ib + on_b
            if (on_a and na[1] + 1 == a[na[0]][1]) or (on_b and nb[1] + 1 == b[nb[0]][1]):
                out.append(cur)
                cur = []
    out += [cur] if cur else []
    rows = []
    for part, steps in enumerate(out):
        row = [part]
        for at, on, path in ((1, 3, a), (2, 4, b)):
            v, size = path[steps[0][at][0]]
            lo = steps[0][at][1]
            hi = lo + sum(s[on] for s in steps)
            row += [v, *((size - hi, size - lo) if v % 2 else (lo, hi))]
        text, runs = "", []
        for s in steps:
            if runs and runs[-1][1] == s[0]:
                runs[-1][0] += 1
            else:
                runs.append([1, s[0]])
        text = "".join(f"{n}{op}" for n, op in runs)
        rows.append((*row, text))
    return rows


def test_split_at_nodes(spark):
    rnd = random.Random(5)
    aligns, path_a, path_b, want = [], [], [], []
    for aln in range(25):
        a, b = ([(rnd.randrange(20), rnd.randrange(1, 9)) for _ in range(rnd.randrange(1, 5))] for _ in range(2))
        ops = [(rnd.randrange(1, 8), rnd.choice("M=XDI")) for _ in range(6)]
        beg_a, beg_b = rnd.randrange(2), rnd.randrange(2)
        beg_a, beg_b = min(beg_a, sum(n for _, n in a) - 1), min(beg_b, sum(n for _, n in b) - 1)
        aligns.append((aln, beg_a, beg_b, "".join(f"{n}{o}" for n, o in ops)))
        path_a += [(aln, i, v, n) for i, (v, n) in enumerate(a)]
        path_b += [(aln, i, v, n) for i, (v, n) in enumerate(b)]
        want += [(aln, *r) for r in split(ops, beg_a, beg_b, a, b)]
    kind = "aln long, pos int, v long, length long"
    got = rewire.split_at_nodes(spark.createDataFrame(aligns, "aln long, beg_a long, beg_b long, cigar string"), spark.createDataFrame(path_a, kind), spark.createDataFrame(path_b, kind))
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_finished_rejects_what_does_not_spell_the_read(spark):
    from pyspark.sql import functions as F

    n = lambda x: F.lit(x).cast("long")
    one = lambda text, size: spark.range(1).select(cigar.finished(cigar.ops(F.lit(text)), n(10), n(20), n(1), n(5), n(size)).alias("x")).collect()[0].x
    assert tuple(one("2D4=3D", 7)) == (12, 17, "1S4=2S")
    with pytest.raises(Exception, match="doesn't spell"):
        one("3=", 7)


def test_options():
    assert options.checked("liftover", max_hit=2)["max_hit"] == 2
    assert options.checked("collapse")["cx_depth"] == 6
    for command, bad in (("liftover", {"min_frac": 1.5}), ("bubble", {"depth": 0}), ("align", {"secondary": 0.0}), ("mapq_boost", {"cm_max_hops": 0}), ("depth", {"win": 3}), ("file2map", {"min_mapq": 61})):
        with pytest.raises(ValueError):
            options.checked(command, **bad)
    options.check_words(61, 255, wide=True)
    with pytest.raises(ValueError):
        options.check_words(29, 10)


def test_map_of_file(spark, tmp_path):
    from strandline.plans import tasks

    (tmp_path / "x.gfa").write_text("S\tu\tACGTACGTAC\nA\tu\t2\t+\tread\t1\t6\n")
    (tmp_path / "x.paf").write_text("q\t60\t0\t10\t+\tt\t90\t5\t15\t10\t10\t60\tcg:Z:10M\n")
    assert [tuple(r)[:6] for r in tasks.map_of_file(spark, str(tmp_path / "x.gfa")).collect()] == [("u", 2, 7, "read", 1, 6)]
    assert [tuple(r)[:6] for r in tasks.map_of_file(spark, str(tmp_path / "x.paf"), min_len=10).collect()] == [("t", 5, 15, "q", 0, 10)]
    assert tasks.map_of_file(spark, str(tmp_path / "x.paf")).count() == 0
