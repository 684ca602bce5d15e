"""CIGARs by batches give what the column functions give."""

import random
import time

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strandline.functions import cigar, cigarkernel


def _text(rng):
    return rng.choice([None, "*", "", "M", "3", "12", "0M5", "5Mß3I", "007M1M", "0000000000000000000012D", "".join(f"{rng.choice(['', rng.randrange(300)])}{rng.choice('MIDNSHP=X?')}" for _ in range(rng.randrange(9)))])


def test_texts_as_columns_tell(spark):
    rng = random.Random(7)
    rows = spark.createDataFrame([(i, _text(rng)) for i in range(400)], "id int, t string")
    ops = cigar.ops(F.col("t"))
    told = rows.select("t", cigarkernel.merged(F.col("t")).alias("a"), cigar.pack(cigar.merge_runs(ops)).alias("b"), cigarkernel.block_bases(F.col("t")).alias("c"), cigar.total_block_bases(cigar.ref_blocks(F.lit(3), ops)).alias("d")).collect()
    assert [(r.t, r.a, r.c) for r in told] == [(r.t, r.b, r.d) for r in told]


def test_finished_as_columns_tell(spark):
    rng = random.Random(8)
    part = lambda: "".join(f"{rng.randrange(1, 4)}{rng.choice('D=XI')}" for _ in range(rng.randrange(3))) or rng.choice([None, "*"])
    rows = []
    for i in range(300):
        n = rng.randrange(4)
        rows.append((i, part(), [(0, rng.randrange(4), 5, 5 + rng.randrange(4)) for _ in range(n)], [part() for _ in range(rng.randrange(n + 2))], part(), rng.randrange(3), rng.randrange(3)))
    block = "struct<r_beg:bigint,r_end:bigint,q_beg:bigint,q_end:bigint>"
    df = spark.createDataFrame(rows, f"id int, lead string, blocks array<{block}>, gaps array<string>, trail string, q0 long, q1 long")
    parsed = cigar.assembled(F.col("lead"), F.col("blocks"), F.col("gaps"), F.col("trail"))
    df = df.withColumn("p", parsed).withColumn("to", F.col("q0") + cigar.query_span(F.col("p"))).withColumn("size", F.col("to") + F.col("q1"))
    own = [F.lit(50).cast("long"), F.lit(90).cast("long"), F.col("q0"), F.col("to"), F.col("size")]
    for hard in (False, True):
        told = df.select(cigarkernel.finished(F.col("lead"), F.col("blocks"), F.col("gaps"), F.col("trail"), *own, hard=hard).alias("a"), cigar.finished(F.col("p"), *own, hard=hard).alias("b")).collect()
        assert [tuple(r.a) for r in told] == [tuple(r.b) for r in told]
    with pytest.raises(Exception, match="doesn't spell the read"):
        df.select(cigarkernel.finished(F.col("lead"), F.col("blocks"), F.col("gaps"), F.col("trail"), *own[:2], F.col("q0") + 1, *own[3:])).collect()


def test_many_texts_in_little_time():
    texts = pa.array([f"{i % 50 + 1}M{i % 7}M{i % 7}I{i % 50}={i % 999}=1=" for i in range(200_000)])
    start = time.process_time()
    assert cigarkernel.text(cigarkernel.merge(cigarkernel.parse(texts)), len(texts))[1].as_py() == "3M1I3="
    assert time.process_time() - start < 5


def test_operations_are_packed_once(spark):
    plan = spark.range(1).select(cigar.pack(cigar.ops(F.lit("3M").substr(F.lit(1), F.col("id").cast("int")))).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
