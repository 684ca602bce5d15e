import random
from pathlib import Path
from urllib.parse import urlparse

import pytest
from pyspark.sql import functions as F

from strandline import streaming
from strandline.functions import names, spans
from strandline.operators import bubbles, flanks, intervals, rewrite


def one(spark, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()])


def test_composite_names(spark):
    base = "utg000657l:1715746-1748768;utg001413l:68019-69628"
    got = one(spark, n=base).select(names.interval_name(F.col("n"), F.lit(0).cast("long"), F.lit(34630).cast("long"), F.lit(False))).first()[0]
    assert got == "utg000657l:1715746-1748768;utg001413l:68019-69627"
    for bad in (names.interval_name(F.lit("a:0-5"), F.lit(0).cast("long"), F.lit(6).cast("long"), F.lit(False)), names.chain_name(F.array(F.lit("a:0-9"), F.lit("a:5-12"))), names.interval_name(F.lit("a"), F.lit(3).cast("long"), F.lit(3).cast("long"), F.lit(False))):
        with pytest.raises(Exception):
            spark.range(1).select(bad).collect()


def test_offsets_of_trunk_and_leaf(spark):
    t = spark.createDataFrame([(1, x) for x in (0, 30, 50, 70, 120)], "k long, off long")
    leaf = spark.createDataFrame([(1, x) for x in (0, 30, 70, 120)], "k long, off long")
    assert sorted((r.beg, r.end) for r in rewrite.matched_windows(t, leaf, ["k"]).collect()) == [(0, 30), (30, 70), (70, 120)]


def test_deep_rules_are_no_cycles(spark):
    deep = rewrite.expand(spark.createDataFrame([(i, 1, i + 1) for i in range(20)], "key long, ord int, part long")).collect()
    assert {(r.root, r.part) for r in deep} == {(i, 20) for i in range(20)}
    with pytest.raises(Exception):
        rewrite.expand(spark.createDataFrame([(1, 1, 2), (2, 1, 1)], "key long, ord int, part long")).collect()


def _expanded(rules):
    """Rows of each key's expansion, by recursion."""
    down = {}
    for key, n, part in rules:
        down.setdefault(key, []).append((n, part))

    def ways(part):
        return [(n, *way) for n, nxt in down[part] for way in ways(nxt)] if part in down else [(part,)]

    return sorted((key, way[-1], list(way[:-1])) for key in down for way in ways(key))


@pytest.mark.parametrize("listed", [2, 128])
def test_expand_by_lists(spark, monkeypatch, listed):
    monkeypatch.setattr(rewrite, "_LISTED", listed)
    rnd = random.Random(listed)
    # Keys 0 to 11 lead up, some to ends; one rule is there twice, and 5 has more rules than a list has places.
    rules = [(k, n, rnd.choice([k + 1, k + 3, 50 + k])) for k in range(12) for n in range(rnd.choice([1, 2]))]
    rules += [rules[0], *((5, n, rnd.choice([7, 60 + n])) for n in range(3, 9))]
    df = spark.createDataFrame(rules, "key long, ord int, part long")
    got = rewrite.expand(df)
    assert got.dtypes == [("root", "bigint"), ("part", "bigint"), ("path", "array<int>")]
    assert sorted((r.root, r.part, list(r.path)) for r in got.collect()) == _expanded(rules)
    told = sorted((r.root, r.part, [int(x) for x in r.path.split(".")]) for r in rewrite.expand(df, text=True).collect())
    assert told == _expanded(rules)


def test_expansions_are_not_written(spark):
    size = lambda: sum(f.stat().st_size for f in Path(urlparse(spark.sparkContext.getCheckpointDir()).path).rglob("part-*"))
    before = size() if spark.sparkContext.getCheckpointDir() else 0
    rules = spark.createDataFrame([(k, n, k + 1) for k in range(4) for n in range(12)], "key long, ord int, part long")
    assert rewrite.expand(rules).count() == 12 + 12**2 + 12**3 + 12**4
    assert size() - before < 200_000


def test_covered_length_of_repeated_rows(spark):
    q = spark.createDataFrame([("c", 0, 10), ("c", 0, 10), ("c", 100, 110)], "ctg string, b long, e long")
    m = spark.createDataFrame([("c", 2, 6)], "ctg string, beg long, end long")
    assert sorted(r.covered for r in intervals.covered_length(q, m, ["ctg"], ("b", "e")).collect()) == [0, 4, 4]


def test_representatives_and_flanks(spark):
    ways = [(1, 1, [0, 2, 4, 8]), (1, 2, [0, 2, 6, 8]), (1, 3, [0, 10, 8])]
    rows = [(b, p, i, v) for b, p, way in ways for i, v in enumerate(way)]
    sizes = spark.createDataFrame([(0, 10), (1, 100), (2, 3), (3, 2), (4, 10), (5, 90)], "seg_id long, length long")
    told = bubbles.profiles(spark.createDataFrame(rows, "bubble long, path int, pos int, v long"), sizes)
    assert sorted(r.path for r in bubbles.representatives(told, 0.1).collect()) == [1, 3]
    segs = spark.createDataFrame([(0, "a:0-4", "ACGT", 4), (1, "b:0-6", "TTGGCC", 6), (2, "a:4-8", "GGGG", 4)], "seg_id long, name string, seq string, length long")
    arcs = spark.createDataFrame([(0, 2, 1, 1, 1), (0, 4, 0, 0, 2), (4, 2, 2, 2, 3)], "v long, w long, ov long, ow long, link_id long")
    got = {r.name: r.seq for r in flanks.with_flanks(segs, arcs, 6, 5).collect()}
    # a goes on to its own root first (GGGG), then to b behind an overlap of 2; to the left of the second a stands the first.
    assert got == {"a:0-4": "ACGT" + "GGGG" + "GG", "b:0-6": "TTGGCC", "a:4-8": "ACGT" + "GGGG" + "GGCC"}


def test_natural_order_and_windows(spark, tmp_path):
    names_ = ["r10", "r9", "r009", "a2b10", "a2b9", "a10"]
    got = [r.n for r in spark.createDataFrame([(n,) for n in names_], "n string").orderBy(spans.natural_key(F.col("n"))).collect()]
    assert got == ["a2b9", "a2b10", "a10", "r9", "r009", "r10"]
    path = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(path)
    events.write.parquet(str(tmp_path / "in"))
    out = streaming.window_counts(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="0 seconds")
    q = out.writeStream.format("memory").queryName("counts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    want = {(r.w.start, r.event_type): r.n for r in events.withColumn("ts", F.col("ts").cast("timestamp")).groupBy(F.window("ts", "1 day", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n")).collect()}
    seen = spark.sql("select * from counts").collect()
    assert seen and all(want[r.beg, r.event_type] == r.n for r in seen)
