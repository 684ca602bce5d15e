import base64
import hashlib
import math
import random
import re

from pyspark.sql import functions as F

from strandline.llm import chat, secrets

ASSIGN = re.compile(secrets.ASSIGN, re.A)


def base_spans(t):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer(secrets.ACCESS, t) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer(secrets.HEX, t) if len(m[0]) >= 16]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))


def test_base_spans_match_a_plain_search(spark, odd_docs, no_docs):
    r = random.Random(1)
    words = ["password", "Secret", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef0", "é", "日", "\n", "x", "secret: abc", "hunter2hunter2", "ſecret"]
    texts = ["".join(r.choice(words) for _ in range(r.randrange(30))) for _ in range(400)]
    out = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert len(out) == 400
    for x in out:
        assert x.base_sha256 == hashlib.sha256(base_spans(texts[x.doc_id]).encode()).hexdigest(), texts[x.doc_id]
        assert set(filter(None, base_spans(texts[x.doc_id]).split(","))) <= set(x.spans.split(","))
    odd = secrets.scan(odd_docs).collect()
    assert len(odd) == odd_docs.count() and all(x.n_assign + x.n_access + x.n_hex == 0 and x.spans == "" for x in odd)
    assert secrets.scan(no_docs).count() == 0


def test_battery_tells_random_runs_from_names(spark):
    r = random.Random(2)
    rows, kinds = [], []
    for i in range(300):
        if i % 2:
            token = base64.b64encode(r.randbytes(36)).decode()
        else:
            token = "".join(r.choice(["Get", "Value", "Map", "Entry", "List", "Node", "Item", "Test"]) for _ in range(9)) + str(r.randrange(10))
        kinds.append(i % 2)
        rows.append((i, f"see {token} there"))
    out = {x.doc_id: x for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    found = [out[i].n_random > 0 for i in range(300)]
    assert sum(f for f, k in zip(found, kinds) if k) > 0.8 * sum(kinds)
    assert sum(f for f, k in zip(found, kinds) if not k) < 15


def test_tokens_behind_names_and_foreign_separators(spark):
    r = random.Random(4)
    lower, upper, letters = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    forms = [
        ("AWS_SECRET_ACCESS_KEY=", letters + "0123456789+/", ""), ("client_key=", letters + "0123456789", "&x=1"), ("path/to-the/", letters + "0123456789-_", "/x"), ("a-b_c/d-", letters + "0123456789+/", "== end"),
        ("é id=", lower + "0123456789", ""), ("my_", lower + "0123456789", ""), ("see ", upper + "0123456789", "."),
    ]
    rows, spans = [], []
    for i in range(420):
        before, alphabet, behind = forms[i % len(forms)]
        token = "".join(r.choice(alphabet) for _ in range(40))
        while not (any(map(str.isdigit, token)) and token[0].isalnum() and token[-1].isalnum() and (len(alphabet) < 64 or set(token) & set(alphabet[-2:]))):
            token = "".join(r.choice(alphabet) for _ in range(40))
        pad = len(behind) - len(behind.lstrip("="))
        rows.append((i, before + token + behind))
        spans.append(f"random:{len(before)}:{len(before) + 40 + pad}")
    out = {x.doc_id: x.spans for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for f in range(len(forms)):
        own = range(f, 420, len(forms))
        assert sum(spans[i] in out[i].split(",") for i in own) > 0.75 * len(own), (forms[f], [(rows[i], spans[i], out[i]) for i in own][:5])


def test_thresholds():
    assert secrets._thresholds([], []) == {}
    # Runs that all look random are taken, up to where names begin.
    assert 0 < secrets._thresholds([("hex", 3, s, 10) for s in range(0, 60, 5)], [(3, 200, 5000)])["hex", 3] < 200
    # One that looks random among many that don't is not, with few names to go by.
    assert ("hex", 3) not in secrets._thresholds([("hex", 3, 0, 1), ("hex", 3, 400, 99)], [(3, 300, 50)])
    # The same with names enough to tell.
    assert secrets._thresholds([("hex", 3, 0, 1), ("hex", 3, 400, 99)], [(3, 300, 5000)])["hex", 3] < 300
    # Short names that look random themselves keep runs back.
    assert ("hex", 2) not in secrets._thresholds([("hex", 2, 10, 50), ("hex", 2, 90, 50)], [(2, s, 100) for s in range(100)])


def brute_step(token, alphabet):
    """-ln p by the three tests, written out."""
    v = [alphabet.index(c) for c in token]
    n, size = len(v), len(alphabet)
    tail = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    chi = sum((v.count(i) - n / size) ** 2 / (n / size) for i in range(size))
    p = [tail((chi - (size - 1)) / math.sqrt(2 * (size - 1) * (n - 1) / n))]
    high = [x >= size / 2 for x in v]
    n1 = sum(high)
    runs, mean = 1 + sum(a != b for a, b in zip(high, high[1:])), 2 * n1 * (n - n1) / n + 1
    p.append(min(1, 2 * tail(abs(runs - mean) / math.sqrt((mean - 1) * (mean - 2) / (n - 1)))))
    c = (size - 1) / 2
    serial = sum((a - c) * (b - c) for a, b in zip(v, v[1:])) / ((size * size - 1) / 12)
    p.append(min(1, 2 * tail(abs(serial) / math.sqrt(n - 1))))
    f = -sum(math.log(x) for x in p)
    return min(max(f - math.log(1 + f + f * f / 2), 0) / secrets.STEP, secrets.STEPS)


def test_battery_against_brute_force(spark):
    r = random.Random(7)
    rows = []
    for name, _, alphabet in secrets.ENCODINGS:
        for n in (24, 40, 64, 150):
            rows.append((name, alphabet, "".join(r.choice(alphabet) for _ in range(n))))
            rows.append((name, alphabet, "".join(r.choice(alphabet[: len(alphabet) // 2 + 3]) for _ in range(n))))
    got = spark.createDataFrame([(t,) for _, _, t in rows], "t string").select("t", secrets._battery(F.col("t")).alias("x")).collect()
    seen = 0
    for (name, alphabet, token), x in zip(rows, got):
        if x.x is not None and x.x.encoding == name:
            seen += 1
            assert abs(x.x.step - brute_step(token, alphabet)) <= 1.01, (name, token)
            assert x.x.band == min(len(token) // secrets.BAND, secrets.BANDS)
    assert seen > 0.6 * len(rows)


def test_names_keep_look_alikes_back(spark):
    """Where names of a length pass for random, runs of that length aren't reported; long ones are."""
    r = random.Random(9)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, "".join(r.choice(letters) for _ in range(22))) for i in range(300)]
    rows += [(300 + i, "x " + "".join(r.choice(letters + "0123456789") for _ in range(22))) for i in range(100)]
    rows += [(400 + i, "x " + "".join(r.choice(letters + "0123456789") for _ in range(44))) for i in range(100)]
    out = {x.doc_id: x.n_random for x in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(out[i] for i in range(300, 400)) == 0 and sum(out[i] for i in range(400, 500)) > 70


def test_many_matches_in_one_text(spark):
    text = "secret: abcdefghijkl " * 20_000
    got = secrets.scan(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_assign == 20_000 and got.base_sha256 == hashlib.sha256(base_spans(text).encode()).hexdigest()


def turns(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_preferences(spark):
    rows = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "more"), (0, 3, "assistant", "<|end|> é"),
        (1, 0, "user", "hi"), (1, 1, "assistant", "no"),
        (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, 1, "assistant", "b"), (3, 0, "user", "a"),
        (4, 0, "user", "alone"), (4, 1, "assistant", "x"), (None, 0, "user", "lost"), (5, None, None, None), (7, 0, "user", "only user"),
    ]
    out = {r.pair_id: r for r in chat.neighbours(turns(spark, rows)).collect()}
    p = out[0]
    assert p.prompt == "<|user|>\nhi<|end|>\n" and p.prompt_turns == 1
    assert p.rejected == "<|assistant|>\nno<|end|>\n" and "<\\|end|>" in p.chosen
    spans = [tuple(map(int, s.split(":"))) for s in p.chosen_mask.split(",")]
    assert [p.chosen[a:b] for a, b in spans] == ["yes<|end|>\n", "<\\|end|> é<|end|>\n"]
    assert out[1].chosen == "" == out[1].rejected and out[1].prompt_turns == 2 and out[1].chosen_mask == ""
    assert out[2].prompt_turns == 0 and out[2].rejected == "<|unknown|>\n<|end|>\n"
    assert out[3].chosen is None and out[3].prompt == "<|user|>\nonly user<|end|>\n"
    assert chat.neighbours(turns(spark, [])).count() == 0
    plan = chat.neighbours(turns(spark, rows))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_preferences_of_large_and_odd_ids(spark):
    big = 2**62
    rows = [(big + 2, 0, "user", "a"), (big + 3, 0, "user", "b"), (big + 4, 0, "user", "c"), (big + 6, 0, "user", "d"), (-1, 0, "user", "e"), (-2, 0, "user", "f")]
    df = turns(spark, rows)
    for c in ("at", "turns", "pair_id", "c", "r", "odd", "head"):
        df = df.withColumn(c, F.lit("other"))
    out = {r.pair_id: r for r in chat.neighbours(df).collect()}
    assert sorted(out) == [-1, big // 2 + 1, big // 2 + 2, big // 2 + 3]
    assert "a" in out[big // 2 + 1].chosen and "b" in out[big // 2 + 1].rejected and "f" in out[-1].chosen and out[big // 2 + 2].rejected is None


def test_preferences_of_long_and_repeated_turns(spark):
    many = [(0, i, ("user", "assistant")[i % 2], f"t{i}") for i in range(4000)] + [(1, i, ("user", "assistant")[i % 2], f"t{i}" if i < 3999 else "other") for i in range(4000)]
    twice = [(2, 0, "assistant", "x"), (2, 0, "assistant", "x"), (3, 0, "assistant", "y" * 300_000)]
    out = {r.pair_id: r for r in chat.neighbours(turns(spark, many + twice)).collect()}
    assert out[0].prompt_turns == 3999 and out[0].chosen == "<|assistant|>\nt3999<|end|>\n" and out[0].chosen_mask == "14:27"
    assert out[1].chosen == "<|assistant|>\nx<|end|>\n" * 2 and out[1].chosen_mask == "14:23,37:46"
    a, b = map(int, out[1].rejected_mask.split(":"))
    assert out[1].rejected[a:b] == "y" * 300_000 + "<|end|>\n"
