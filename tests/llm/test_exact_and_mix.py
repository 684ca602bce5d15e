import duckdb
import pytest
from pyspark.sql import functions as F

from strandline.llm import exact_dedup, mixing, registry


def test_exact_dedup_cases(odd_docs):
    out = exact_dedup.exact_dedup(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert by[2][0].keep_id == 1 and by[2][0].group_size == 2 and not by[2][0].kept and by[1][0].kept
    assert by[3][0].keep_id == 3 and by[3][0].group_size == 3 and by[4][0].keep_id == 3  # null and empty are equal
    assert [r.kept for r in by[7]].count(True) == 1 and by[7][0].group_size == 2
    assert by[6][0].keep_id == 5
    assert sum(r.kept for r in out) == len({r.text_sha256 for r in out})


def test_exact_dedup_salts_do_not_matter(odd_docs):
    key = lambda r: tuple(map(str, r))
    assert sorted(map(key, exact_dedup.exact_dedup(odd_docs, n_salts=1).collect())) == sorted(map(key, exact_dedup.exact_dedup(odd_docs, n_salts=97).collect()))


def test_exact_dedup_stays_native(odd_docs):
    plan = exact_dedup.exact_dedup(odd_docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_kept_documents(odd_docs, no_docs):
    out = exact_dedup.kept_documents(odd_docs.where("doc_id IS NOT NULL"))
    assert out.columns == odd_docs.columns
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 5, 7, 8, 9, 10]
    assert exact_dedup.exact_dedup(no_docs).count() == 0 and exact_dedup.kept_documents(no_docs).count() == 0


def test_mix_cases(odd_docs, no_docs):
    out = mixing.mix(odd_docs).collect()
    assert len(out) == odd_docs.count() and mixing.mix(no_docs).count() == 0
    assert all(0 <= r.taken <= 2 * r.size for r in out)
    assert all(r.taken == 0 for r in out if r.doc_id in (3, 4))
    assert sorted(map(str, out)) == sorted(map(str, mixing.mix(odd_docs).collect()))
    copies = mixing.mixed_documents(odd_docs)
    assert copies.columns == odd_docs.columns and mixing.mixed_documents(no_docs).count() == 0
    assert copies.where("doc_id IN (3, 4)").count() == 0


def test_mix_targets_and_refinement(spark, monkeypatch):
    """Whatever the size of the boundary bucket, the same documents go in."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(1 + id % 17))").alias("text"), F.expr("case when id % 3 < 2 then 'big' when id % 50 = 2 then null else 's' || id % 7 end").alias("source"))
    first = sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    monkeypatch.setattr(mixing, "BOUNDARY_ROWS", 1)
    assert sorted(map(tuple, mixing.mix(docs).collect()), key=str) == first
    total = sum(r[1] for r in first)
    near = {}
    for _, size, s, target, taken in first:
        x = near.setdefault((s, target), [0, 0])
        x[0] += taken
        x[1] = max(x[1], size)
    assert all(abs(x[0] - t) <= x[1] for (_, t), x in near.items())
    assert abs(sum(t for _, t in near) - 1.5 * total) < 1e-6 * total


@pytest.mark.parametrize("name", [n for n in registry.ORACLES if n != "op7_jaccard_join"])
def test_against_sql(spark, corpus, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "labels"):
        c.execute(f"create view {t} as select * from '{corpus}/{t}.parquet'")
    df = registry.QUERIES[name](spark, corpus)
    cols = sorted(df.columns)
    want = c.execute(f"select {', '.join(cols)} from ({registry.ORACLES[name]})").fetchall()
    assert sorted(map(str, (tuple(r) for r in df.select(*cols).collect()))) == sorted(map(str, want))
