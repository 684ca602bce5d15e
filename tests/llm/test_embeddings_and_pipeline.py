import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import common, covertree, langid, mixing, pieces

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(rows, cosine):
    ok = [v is not None and None not in v and bool(np.isfinite(v).all()) and bool(np.any(v)) for _, v in rows]
    x = np.array([v if k else [1e-9] + [0.0] * (len(rows[0][1]) - 1) for (_, v), k in zip(rows, ok)], float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = (x @ x.T >= cosine) & np.array(ok)[:, None] & np.array(ok)[None]
    np.fill_diagonal(hit, False)
    label = np.array([i for i, _ in rows])
    while True:
        new = np.minimum(label, np.where(hit, label[None], label.max() + 1).min(1))
        if (new == label).all():
            return sorted(zip((i for i, _ in rows), hit.sum(1).tolist(), label.tolist()))
        label = new


def clustered(n, dim, groups, noise, seed):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(groups, dim))
    x = r.normal(size=(n, dim))
    x[: n // 2] = centre[r.integers(0, groups, n // 2)] + noise * r.normal(size=(n // 2, dim))
    x[n // 3 : n // 3 + 20] = x[n // 3]
    return [(int(i), v.tolist()) for i, v in zip(r.permutation(n), x)]


@pytest.mark.parametrize("n,dim,groups,noise,block", [(900, 16, 3, 0.25, 128), (700, 4, 4, 0.1, 8192), (600, 64, 40, 0.05, 64)])
def test_near_pairs(spark, monkeypatch, n, dim, groups, noise, block):
    monkeypatch.setattr(covertree, "BLOCK", block)
    monkeypatch.setattr(covertree, "UPPER_NODES", 5)
    rows = clustered(n, dim, groups, noise, n)
    got = covertree.near_pairs(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == brute(rows, 0.9)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_near_pairs_cases(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 1e-9]), (3, None), (4, [0.0, 0.0]), (5, [1.0, None]), (6, [inf, 1.0]), (7, [nan, 1.0]), (8, [1.0, 0.0]), (9, [-1.0, 0.0]), (10, [1e-200, 0.0]), (11, [1.0, 0.0, 0.0]), (None, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit(1)).withColumn("label", F.lit(None).cast("int")).withColumn("x", F.lit("y"))
    by = {r.vec_id: r for r in covertree.near_pairs(df).collect()}
    assert len(by) == 12
    assert {i for i in by if i and by[i].component_id == 1} == {1, 2, 8, 10} and by[1].n_links == 3
    assert all(by[i].n_links == 0 and by[i].component_id == i and by[i].kept for i in (3, 4, 5, 6, 7, 9, 11))
    assert covertree.near_pairs(df.where("false")).count() == 0
    assert covertree.near_pairs(df.where("vec_id = 3")).count() == 1


def test_near_pairs_of_several_lengths_and_ids(spark, monkeypatch):
    """Each length is searched, in blocks or all at once; rows that repeat an id are rows of their own."""
    monkeypatch.setattr(covertree, "BLOCK", 20)
    g = np.random.default_rng(3)
    rows = []
    for dim, n in ((2, 60), (3, 8), (5, 30), (700, 12)):
        x = g.normal(size=(n, dim))
        x[n // 2 :] = x[: n - n // 2] + 0.05 * g.normal(size=(n - n // 2, dim))
        rows += [(len(rows) + i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: r for r in covertree.near_pairs(df).collect()}
    at = 0
    for n in (60, 8, 30, 12):
        want = brute(rows[at : at + n], 0.9)
        assert [(i, got[i].n_links, got[i].component_id) for i, _, _ in want] == want
        at += n
    again = covertree.near_pairs(spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 1.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<double>")).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in again) == [(1, 2, 1), (1, 2, 1), (2, 0, 2), (2, 2, 1)]


@pytest.mark.parametrize("dim", [8, 64, 4096])
def test_rough_cosines_rule_no_link_out(dim):
    g = np.random.default_rng(dim)
    x, y = (v / np.linalg.norm(v, axis=1)[:, None] for v in (g.normal(size=(200, dim)), g.normal(size=(200, dim))))
    off = np.abs((x.astype(np.float32) @ y.astype(np.float32).T).astype(np.float64) - x @ y.T).max()
    assert off <= covertree.rough(dim)


def test_components(spark):
    r = np.random.default_rng(4)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 400, (300, 2))] + [(i, i + 1) for i in range(1000, 1060)] + [(5000, 5000 + i) for i in range(1, 50)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            up[y] = x
    got = {r.node: r.component for r in common.components(spark.createDataFrame([*edges, (None, 3)], "a long, b long")).collect()}
    assert got == {x: find(x) for x in up}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0


def brute_targets(sizes, weights=(3, 1, 2), share=1.5, cap=2):
    """Targets by water-filling: full sources leave, and what is left is shared anew."""
    order = sorted(sizes, key=lambda x: (x is None, x or ""))
    weight = {x: weights[i % len(weights)] for i, x in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        level = left / sum(weight[x] for x in open_)
        full = {x for x in open_ if weight[x] * level >= cap * sizes[x]}
        for x in full or open_:
            target[x] = cap * sizes[x] if full else weight[x] * level
        left -= sum(target[x] for x in full)
        open_ = open_ - full if full else set()
    return target


def brute_taken(rows):
    """How often each (id, text, source) is taken."""
    words = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sizes = {}
    for (_, _, s), n in zip(rows, words):
        sizes[s] = sizes.get(s, 0) + n
    target, times = brute_targets(sizes), [0] * len(rows)
    for s, size in sizes.items():
        own = [i for i, r in enumerate(rows) if r[2] == s]
        passes = int(target[s] // size) if size else 0
        need = target[s] - passes * size
        h = {i: int(hashlib.md5(str("" if rows[i][0] is None else rows[i][0]).encode()).hexdigest()[:15], 16) for i in own}
        best, limit, total = need, -1, 0
        for x in sorted(set(h.values())):
            total += sum(words[i] for i in own if h[i] == x)
            if abs(total - need) < best:
                best, limit = abs(total - need), x
        for i in own:
            times[i] = (passes + (h[i] <= limit)) if words[i] else 0
    return times


def test_mix_against_water_filling(spark):
    r = random.Random(6)
    rows = [(i if i % 40 else None, " ".join("w" * (1 + i % 3) for _ in range(r.choice([0, 1, 5, 30, 400]))), r.choice(["a", "a", "a", "b", "c", "d", None, "Z"])) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    target = brute_targets({s: sum(len(WORD.findall(t)) for _, t, x in rows if x == s) for s in {x for _, _, x in rows}})
    got = sorted((str(x.doc_id), x.size, x.taken, round(x.target, 6)) for x in mixing.mix(docs).collect())
    assert got == sorted((str(i), len(WORD.findall(t)), n * len(WORD.findall(t)), round(target[s], 6)) for (i, t, s), n in zip(rows, brute_taken(rows)))
    copies = Counter(tuple(x) for x in mixing.mixed_documents(docs).collect())
    want = Counter()
    for row, n in zip(rows, brute_taken(rows)):
        want[row] += n
    assert copies == +want


def test_mix_of_many_sources(spark, monkeypatch):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', int(1 + id % 17))").alias("text"), F.expr("'s' || id % 23").alias("source"))
    first = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 3)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == first


def small_corpus(seed=11):
    """Documents in two languages with junk, exact and near copies, shared passages, repeated ids and nulls."""
    r = random.Random(seed)
    words = {"en": ["the", "quick", "river", "of", "stone", "and", "bright", "window", "walking", "through", "which", "there"], "de": ["der", "schnelle", "fluss", "und", "stein", "fenster", "durch", "welche", "nicht", "gehen", "zwischen", "aber"]}
    rows = []
    for i in range(160):
        lang = ("en", "de")[i % 2]
        rows.append((i, " ".join(r.choice(words[lang]) + r.choice(["", "", "er", "s"]) for _ in range(r.choice([8, 40, 120]))), lang, r.choice(["web", "web", "book", None]), i))
    for i in range(160, 220):
        d = r.choice(rows[:160])
        w = d[1].split()
        if i % 3:
            w[r.randrange(len(w))] = "changed"
        rows.append((i, ("  " if i % 2 else "\n").join(w), d[2], d[3], None))
    rows += [(300, "12345 ---- 999", "en", "web", 1), (301, None, None, None, None), (302, "", "de", "book", 0), (5, "an other text that has an id of its own twice over and over", "en", "web", 1), (303, "\u4e2d\u6587" * 40, None, "web", 1)]
    return rows


def test_pipeline_against_brute_force(spark):
    """Each stage on what the one before it kept."""
    import corpus_pipeline

    docs = spark.createDataFrame(small_corpus(), "doc_id long, text string, lang string, source string, n_chars long").repartition(4)
    key = lambda x: (x[0], x[1])
    before = sorted(map(tuple, docs.collect()), key=str)
    judged = {}
    for x in langid.identify(docs.select("doc_id", "text", "lang").withColumn("own", F.col("text"))).join(docs.select("doc_id", "text"), "doc_id").groupBy("doc_id").agg(F.count("*").alias("n"), F.first("lang_pred").alias("p"), F.first("unknown_share").alias("u")).collect():
        judged[x.doc_id] = (x.n, x.p != langid.UNKNOWN and x.u <= 1 - langid.LEAST_KNOWN)
    out = common.stored(corpus_pipeline.STAGES[0][1](spark, docs, ""))
    kept = sorted(map(tuple, out.collect()), key=str)
    assert {x[0] for x in kept} >= {d for d, (n, good) in judged.items() if good and n == 1}
    assert not {x[0] for x in kept} & {d for d, (n, good) in judged.items() if not good and n == 1}
    assert not {x[0] for x in kept} & {300, 301, 302, 303} and len(kept) >= 0.97 * (len(before) - 4)

    out = common.stored(corpus_pipeline.STAGES[1][1](spark, out, ""))
    least = {}
    for x in kept:
        t = re.sub(r"[\x20\x09-\x0D]+", " ", x[1])
        least[t] = min(least.get(t, x), x, key=key)
    kept = sorted(map(tuple, out.collect()), key=str)
    assert sorted(map(key, kept)) == sorted(map(key, least.values()))

    out = common.stored(corpus_pipeline.STAGES[2][1](spark, out, ""))
    sets = [(lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 4 else {tuple(w)})(WORD.findall(x[1].lower())) for x in kept]
    group = list(range(len(kept)))
    while True:
        new = [min([group[i]] + [group[j] for j in range(len(kept)) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]) for i in range(len(kept))]
        if new == group:
            break
        group = new
    first = {}
    for g, x in zip(group, kept):
        first.setdefault(g, []).append(x)
    got = sorted(map(tuple, out.collect()), key=str)
    assert len(got) == len(first) and len(got) < len(kept)
    for own in first.values():
        assert sum(x in got for x in own) == 1 and next(x for x in own if x in got)[0] == min(x[0] for x in own)
    kept = got

    out = common.stored(corpus_pipeline.STAGES[3][1](spark, out, ""))
    want = Counter()
    for x, n in zip(kept, brute_taken([(x[0], x[1], x[3]) for x in kept])):
        want[x] += n
    assert Counter(tuple(x) for x in out.collect()) == +want

    last = corpus_pipeline.STAGES[4][1](spark, out, "")
    assert sorted((x.doc_id, x.text) for x in pieces.decode(last).collect()) == sorted((x.doc_id, x.text) for x in out.collect())


def test_pipeline_stages(spark, corpus):
    import corpus_pipeline

    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    sizes, columns = [docs.count()], docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = common.stored(stage(spark, docs, corpus))
        sizes.append(docs.count())
        if name != "sentencepiece":
            assert docs.columns == columns
    assert sizes[1] >= 0.98 * sizes[0] and sizes[3] <= sizes[2] <= sizes[1] and sizes[5] == sizes[4]
    assert docs.where("NOT lossless").count() == 0


def test_pipeline_odd_rows(spark, odd_docs, no_docs, corpus):
    import corpus_pipeline

    for start in (odd_docs, no_docs):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = common.stored(stage(spark, docs, corpus))
        seen = [r.doc_id for r in docs.collect()]
        assert all(r.lossless for r in docs.collect()) and not {3, 4, 8} & set(seen) and bool(seen) == (start is odd_docs)
