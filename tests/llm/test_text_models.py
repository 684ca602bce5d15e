import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandline.llm import common, jaccard, langid, ngramlm, pieces, registry, textkernel, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({i: i + 32 for i in range(65, 91)})


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute_components(rows, k, percent):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), d), d)
    return [(d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows)]


def near_copies(seed, n):
    r = random.Random(seed)
    words = ["w%d" % i for i in range(60)]
    base = [[r.choice(words) for _ in range(r.choice([2, 9, 25, 60, 200]))] for _ in range(n // 6)]
    out = []
    for i in range(n):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 5, 20])):
            w[r.randrange(len(w))] = r.choice(words).upper()
        out.append((i, r.choice([" ", "\n", "\t "]).join(w)))
    return out


@pytest.mark.parametrize("k,percent,seed", [(3, 90, 1), (5, 80, 2), (1, 50, 3)])
def test_jaccard_against_brute_force(spark, k, percent, seed):
    rows = near_copies(seed, 260)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), k, percent).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, k, percent))


@pytest.mark.parametrize("small,block,leaders", [(1, 16, 2), (4, 30, 5), (2, 1 << 20, 16)])
def test_jaccard_large_buckets(spark, monkeypatch, small, block, leaders):
    """Buckets searched by leaders and dealt out in blocks give the same components."""
    monkeypatch.setattr(jaccard, "SMALL", small)
    monkeypatch.setattr(jaccard, "BLOCK", block)
    monkeypatch.setattr(jaccard, "LEADERS", leaders)
    monkeypatch.setattr(jaccard, "FOLLOWERS", 3)
    monkeypatch.setattr(common, "HUB", 2)
    rows = near_copies(5, 200)
    got = jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_components(rows, 3, 80))


def test_jaccard_family_and_shared_passage(spark, monkeypatch):
    """A family of near copies and many texts that share a passage: all links, and few pairs."""
    monkeypatch.setattr(jaccard, "SMALL", 4)
    r = random.Random(8)
    word = lambda: "w%d" % r.randrange(3000)
    base, passage = [word() for _ in range(150)], [word() for _ in range(60)]
    rows = []
    for i in range(250):
        w = list(base)
        w[r.randrange(150)] = word()
        rows.append((i, " ".join(w)))
    rows += [(250 + i, " ".join([word() for _ in range(60)] + passage + [word() for _ in range(60)])) for i in range(250)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard.jaccard_components(docs, 5, 80).collect()
    assert sorted((x.doc_id, x.n_shingles, x.component_id) for x in got) == sorted(brute_components(rows, 5, 80))
    join = jaccard._Join(docs, 5, 80, "doc_id", "text")
    assert join.candidates(join.buckets(), False).count() < 10 * 250


@pytest.mark.parametrize("k,percent,seed", [(3, 90, 4), (5, 80, 5), (2, 50, 6)])
def test_jaccard_links(spark, k, percent, seed):
    """Every link, counted for each row, against all pairs."""
    rows = near_copies(seed, 200)
    sets = [shingles(t, k) for _, t in rows]
    want = [sum(i != j and bool(sets[i]) and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) for j in range(200)) for i in range(200)]
    pairs, links = jaccard.jaccard_links(spark.createDataFrame(rows, "doc_id long, text string"), k, percent)
    got = {r.doc_id: r for r in links.collect()}
    assert [got[i].n_links for i in range(200)] == want
    classes = {tuple(sorted((got[i].class_id, got[j].class_id))) for i in range(200) for j in range(i) if sets[i] != sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])}
    assert {(r.class_a, r.class_b) for r in pairs.collect()} == classes


def test_jaccard_keys_meet():
    """Sets at the very edge of the threshold share a key, however their parts fall."""
    g = np.random.default_rng(1)
    for percent in (50, 60, 80, 90):
        for n in (1, 2, 3, 5, 9, 10, 19, 40, 133, 300):
            for _ in range(30):
                u = np.unique(g.integers(0, 1 << 62, n + 1).astype(np.uint64))[:n]
                out = int(g.integers(0, n))
                more = n * 100 // percent - n if not out else 0
                v = np.unique(np.concatenate([u[out:], g.integers(0, 1 << 62, more).astype(np.uint64)]))
                a, b = len(np.intersect1d(u, v)), len(np.union1d(u, v))
                if 100 * a >= percent * b and a < b:
                    assert len(np.intersect1d(jaccard.keys_of(u, percent), jaccard.keys_of(v, percent)))


def test_first_of_each_with_one_id(spark):
    """Near copies that share an id: one stays; a clean text with the id of a copy stays."""
    text = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen " * 3
    rows = [(1, text), (1, text + "more"), (2, text + "again"), (2, "a clean text of its own with words enough"), (None, text + "last"), (None, "without an id but clean words too")]
    left = jaccard.first_of_each(spark.createDataFrame(rows, "doc_id long, text string").withColumn("digest", F.lit(1))).collect()
    assert sum(r.text.startswith("one two") and r.doc_id == 1 for r in left) == 1 and len(left) == 3


def test_jaccard_cases(odd_docs, no_docs):
    got = jaccard.jaccard_components(odd_docs).collect()
    assert len(got) == odd_docs.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[2].component_id == 1 and by[6].component_id == 5 and by[7].component_id == 7
    assert by[3].n_shingles == by[4].n_shingles == 0 and by[3].component_id == 3 and by[10].n_shingles == 1
    assert all(r.component_id is None for r in got if r.doc_id is None)
    assert jaccard.jaccard_components(no_docs).count() == 0 and jaccard.first_of_each(no_docs).count() == 0
    assert jaccard.first_of_each(odd_docs).columns == odd_docs.columns


def test_parity_distance_is_a_lower_bound():
    r = np.random.default_rng(0)
    for _ in range(50):
        a, b = (np.unique(r.integers(0, 400, 200).astype(np.uint64)) for _ in range(2))
        s = np.stack([jaccard.sketch_of(x, 512) for x in (a, b)])
        far = [np.bitwise_count(x[0] ^ x[1]).sum() for x in (jaccard.folded(s, 128), s)]
        assert far[0] <= far[1] <= len(np.setxor1d(a, b))
        assert (jaccard.folded(s, 128)[0] == jaccard.sketch_of(a, 128)).all()


def test_words_and_hashes():
    texts = ["", None, "A b\tc", "x" * 70_000, " lead", "é É"]
    got = [list(h[f[i] : f[i + 1]]) for lo, hi, h, f in textkernel.words(texts) for i in range(hi - lo)]
    assert [len(g) for g in got] == [0, 0, 3, 1, 1, 2]
    assert got[2] == next(list(h) for _, _, h, _ in textkernel.words(["a B C"]))


def test_language_id(spark, corpus, odd_docs, no_docs):
    out = registry.QUERIES["op4_language_id"](spark, corpus).join(spark.read.parquet(f"{corpus}/documents.parquet").select(F.col("doc_id").alias("d"), "lang"), F.col("d") == F.col("doc_id")).collect()
    held = [r for r in out if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in out)
    odd = langid.identify(odd_docs).collect()
    assert len(odd) == odd_docs.count()
    assert {r.lang_pred for r in odd if r.doc_id in (3, 4, 8)} == {"und"}
    assert langid.identify(no_docs).count() == 0
    assert sorted(str(r.doc_id) for r in langid.known_documents(odd_docs).select("doc_id").collect() if r.doc_id in (3, 4, 8)) == []
    assert {r.lang_pred for r in langid.identify(odd_docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_mixture_shares():
    r = np.random.default_rng(0)
    p = r.dirichlet(np.ones(200) * 0.2, 3).T
    table = np.column_stack([p, np.full(200, 1 / 200)])
    n = r.multinomial(4000, 0.7 * p[:, 0] + 0.3 * p[:, 2]).astype(float)
    share = langid.mixture(np.maximum(table, 1e-9), n, 3)
    assert abs(share[0] - 0.7) < 0.06 and abs(share[2] - 0.3) < 0.06 and share[1] == 0
    alone = langid.mixture(np.maximum(table, 1e-9), r.multinomial(500, p[:, 1]).astype(float), 3)
    assert alone[1] > 0.95 and alone[0] == alone[2] == 0


def test_toxicity(spark, corpus, odd_docs, no_docs):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    known = labels.join(docs, "doc_id").select("doc_id", "text", "toxic")
    out = toxicity.score(known.select("doc_id", "text"), labels).join(labels, "doc_id").where("held_out").collect()
    bad, good = [r for r in out if r.toxic], [r for r in out if not r.toxic]
    assert sum(r.predicted for r in bad) > 0.75 * len(bad) and sum(r.predicted for r in good) < 0.03 * len(good)
    odd = toxicity.score(odd_docs, labels).collect()
    assert len(odd) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in odd)
    assert toxicity.score(no_docs, labels).count() == 0
    assert toxicity.score(odd_docs, labels.where("false")).count() == odd_docs.count()
    assert toxicity.score(odd_docs, labels.select("doc_id", F.lit(None).cast("int").alias("toxic"))).count() == odd_docs.count()


def test_offending_sentences():
    mask = (1 << toxicity.FEATURE_BITS) - 1
    texts = ["good day. you fool! fine", "nice.", "a fool", "all is well here", "fool again", "so good"] * 20
    bags = []
    for lo, hi, _, f, s, row, *_ in toxicity._sentences(texts):
        first = np.searchsorted(row, np.arange(hi - lo))
        bags += [np.unique(((s[row[s] == r] - first[r]) << toxicity.FEATURE_BITS) | f[row[s] == r]) for r in range(hi - lo)]
    ids, w, leak = toxicity.fit_noisy_or(np.array([1, 0, 1, 0, 1, 0] * 20), bags)
    assert len(ids) >= 1 and (w > 5).any() and leak < 0.05 and (ids <= mask).all()


def brute_base(rows, fold=10):
    toks = [WORD.findall((t or "").translate(LOWER)) + [" "] for _, t in rows]  # no word is a space: it stands for the end
    held = [zlib.crc32(str("" if d is None else d).encode()) % fold == 0 for d, _ in rows]
    c = Counter(w for t, h in zip(toks, held) if not h for w in t)
    n, v = sum(c.values()), len(c)
    return [(d, h, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)) for (d, _), t, h in zip(rows, toks, held)]


@pytest.mark.parametrize("head", [1 << 18, 40])
def test_class_lm_base(spark, corpus, odd_docs, no_docs, monkeypatch, head):
    """The base score is the same whichever words every task holds."""
    monkeypatch.setattr(ngramlm, "HEAD_WORDS", head)
    monkeypatch.setattr(ngramlm, "CLUSTERED_WORDS", 30)
    for docs in (spark.read.parquet(f"{corpus}/documents.parquet"), odd_docs):
        rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
        got = ngramlm.score(docs).collect()
        key = lambda x: (str(x[0]), x[1], x[2], x[3], x[4], round(x[5], 5))
        assert sorted(map(key, ((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got))) == sorted(map(key, brute_base(rows)))
        assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert ngramlm.score(no_docs).count() == 0


def test_class_lm_beats_words_and_sums_to_one(spark):
    """Words come in two alternating kinds: classes see that, single words don't."""
    r = random.Random(3)
    a, b = [f"a{i}" for i in range(30)], [f"b{i}" for i in range(30)]
    rows = [(i, " ".join(r.choice(a if j % 2 else b) for j in range(60))) for i in range(300)]
    got = ngramlm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b")).first()
    assert got.s > got.b + 0.1 * abs(got.b)
    g = np.random.default_rng(1)
    pairs = g.integers(0, 50, (22, 22)).astype(float)
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())

    def likelihood(cls):
        hot = np.eye(int(cls.max()) + 1)[cls]
        grid = hot.T @ pairs @ hot
        return f(grid) - f(grid.sum(0)) - f(grid.sum(1))

    before = np.concatenate([np.arange(20) % 4, [4, 5]])
    after = ngramlm.exchange_classes(pairs, 20, clusters=4, sweeps=50)
    assert likelihood(after) > likelihood(before)
    for w in range(20):  # no single exchange does better
        for c in range(4):
            other = after.copy()
            other[w] = c
            assert likelihood(other) <= likelihood(after) + 1e-6


def test_class_lm_places_every_word(spark, monkeypatch):
    """Rare words of two alternating kinds, far beyond the clustered ones, get the kinds' classes."""
    monkeypatch.setattr(ngramlm, "CLUSTERED_WORDS", 20)
    monkeypatch.setattr(ngramlm, "CLUSTERS", 2)
    r = random.Random(5)
    kinds = [[f"{x}{i}" for i in range(10)] for x in "ab"], [[f"rare{x}{i}" for i in range(400)] for x in "ab"]
    text = lambda: " ".join(r.choice(kinds[j % 10 == 4 or j % 10 == 7][j % 2]) for j in range(60))
    rows = [(i, text()) for i in range(300)]
    got = ngramlm.score(spark.createDataFrame(rows, "doc_id long, text string")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    assert got.s > got.b + 0.2 * got.n
    grid = np.array([[0.0, 90, 5], [90, 0, 5], [5, 5, 0]])
    count, cls = ngramlm.Placement(grid, 2).best(np.array([0, 2]), np.array([0, 3, 1, 4]), np.array([1, 1, 2, 2]))
    assert count.tolist() == [1, 2] and cls.tolist() == [1, 0]
    assert ngramlm._sizes(10**8)[1] > ngramlm._sizes(10**4)[1]


def test_class_lm_score_for_any_bound(spark, corpus, monkeypatch):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    seen = []
    for head in (0, 700, 1 << 18):
        monkeypatch.setattr(ngramlm, "HEAD_WORDS", head)
        seen.append(sorted((r.doc_id, r.n_known, round(r.score, 6), round(r.base_score, 6)) for r in ngramlm.score(docs).collect()))
    assert seen[0] == seen[1] == seen[2]


def test_piece_sampling_is_exact_and_lossless(odd_docs, no_docs, spark):
    v = pieces.Vocabulary(pieces.DEFAULT_MODEL)
    out = pieces.encode(odd_docs).collect()
    assert len(out) == odd_docs.count() and all(r.lossless and r.n_pieces == len(r.ids) for r in out)
    assert all(r.n_pieces == 0 for r in out if r.doc_id in (3, 4)) and pieces.encode(no_docs).count() == 0
    again = {(str(r.doc_id), tuple(r.ids)) for r in pieces.encode(odd_docs.repartition(7)).collect()}
    assert again == {(str(r.doc_id), tuple(r.ids)) for r in out}
    texts = {str(r.doc_id): r.text for r in odd_docs.where("doc_id IS NOT NULL").select("doc_id", "text").collect()}
    back = pieces.decode(pieces.encode(odd_docs)).where("doc_id IS NOT NULL").collect()
    assert all(r.text == (texts[str(r.doc_id)] or "") for r in back)

    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    logs = {sp.id_to_piece(i): -math.log(2.7 - sp.get_score(i)) for i in range(259, sp.vocab_size())}

    def paths(s):
        if not s:
            yield (), 0.0
        for n in range(1, len(s) + 1):
            if s[:n] in logs:
                for rest, w in paths(s[n:]):
                    yield (s[:n], *rest), logs[s[:n]] + w

    every = {p: math.exp(w) for p, w in paths("▁then")}
    total, n = sum(every.values()), 20_000
    ids, counts = pieces.segment(v, ["then"] * n, np.arange(n, dtype=np.uint64))
    seen, at = Counter(), 0
    for c in counts:
        seen[tuple(sp.id_to_piece(int(i)) for i in ids[at : at + c])] += 1
        at += c
    assert all(abs(seen[p] / n - w / total) < 0.02 for p, w in every.items())


def test_piece_sampling_is_exact_in_long_words():
    """How often pieces end at each place of a word of 200 characters, against sums over all paths."""
    import sentencepiece

    v = pieces.Vocabulary(pieces.DEFAULT_MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    weight = {sp.id_to_piece(i): 1 / (2.7 - sp.get_score(i)) for i in range(259, sp.vocab_size())}
    longest = max(map(len, weight))
    word = ("internationalthenother" * 10)[:200]
    marked = "▁" + word
    ahead, behind = [1.0] + [0.0] * len(marked), [0.0] * len(marked) + [1.0]
    for j in range(1, len(marked) + 1):
        ahead[j] = sum(ahead[i] * weight.get(marked[i:j], 0) for i in range(max(0, j - longest), j))
    for i in range(len(marked) - 1, -1, -1):
        behind[i] = sum(weight.get(marked[i:j], 0) * behind[j] for j in range(i + 1, min(len(marked), i + longest) + 1))
    exact = np.array([a * b / ahead[-1] for a, b in zip(ahead, behind, strict=True)])
    n = 4000
    ids, counts = pieces.segment(v, [word] * n, np.arange(n, dtype=np.uint64))
    seen, at = np.zeros(len(marked) + 1), 0
    for c in counts:
        seen[np.cumsum([len(sp.id_to_piece(int(i))) for i in ids[at : at + c]])] += 1
        at += c
    assert np.abs(seen[1:] / n - exact[1:]).max() < 0.04
    assert exact[64] < 0.9  # where words were once parted
    texts = ["x" * 70_000, "日本語" * 500, " " * 300 + "a"]
    ids, counts = pieces.segment(v, texts, np.arange(3, dtype=np.uint64))
    raw, size = pieces.spell(v, ids, counts)
    assert raw.tobytes() == "".join(texts).encode() and size.tolist() == [len(x.encode()) for x in texts]


def test_piece_ids_agree_with_the_library(spark, corpus):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)
    rows = pieces.encode(spark.read.parquet(f"{corpus}/documents.parquet")).collect()
    texts = dict(zip(*[c.to_pylist() for c in pq.read_table(f"{corpus}/documents.parquet").select(["doc_id", "text"]).columns]))
    assert all(sp.decode(list(r.ids)) == texts[r.doc_id] for r in rows if not texts[r.doc_id].startswith(" "))


def test_decode_odd_ids(spark):
    rows = [(1, [400, 500]), (2, [400, None, 500, -3, 10**8]), (3, None), (4, []), (5, [3 + 0xC3])]
    got = {r.doc_id: r.text for r in pieces.decode(spark.createDataFrame(rows, "doc_id long, ids array<int>").withColumn("text", F.lit("old"))).collect()}
    assert got[1] == got[2] and got[3] is None and got[4] == "" and got[5] == "\ufffd"


def test_samples_do_not_hang_on_neighbours(spark, corpus):
    """A text gets the same pieces alone as among others."""
    v = pieces.Vocabulary(pieces.DEFAULT_MODEL)
    texts = [t or "" for t in pq.read_table(f"{corpus}/documents.parquet")["text"].to_pylist()[:60]]
    keys = np.arange(60, dtype=np.uint64)
    ids, counts = pieces.segment(v, texts, keys)
    edge = np.cumsum(counts)
    for i in range(0, 60, 7):
        alone, n = pieces.segment(v, texts[i : i + 1], keys[i : i + 1])
        assert n[0] == counts[i] and (alone == ids[edge[i] - n[0] : edge[i]]).all()
