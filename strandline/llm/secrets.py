"""Operator 3: secret scans, patterns and a battery of randomness tests. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

#: The base patterns, leftmost and without overlap, and what length a match needs.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16
#: Matches of these are the matches of the patterns above that are long enough: both take whole runs.
ACCESS_LONG = rf"AKIA[A-Z0-9]{{{ACCESS_LEAST - 4},}}"
HEX_LONG = rf"[0-9a-f]{{{HEX_LEAST},}}"
#: What may be an encoded secret: a whole run of these characters, long enough to judge; '=' pads
#: its end, and parts a name from its value elsewhere.
RUN = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}(?:=++(?![A-Za-z0-9+/_-]))?"
#: Parts of a run that as a whole is in no encoding: without '+' and '/', without '-' and '_', without all four.
PARTS = (r"[A-Za-z0-9_-]{20,}=*", r"[A-Za-z0-9+/]{20,}=*", r"[A-Za-z0-9]{20,}=*")
#: Encodings by preference: name, what its tokens look like, its alphabet in order of value. All mix
#: digits and letters: of letters alone, twenty or thirty don't tell random ones from words.
ENCODINGS = (
    ("hex", r"^(?=.*[0-9])(?=.*[a-f])[0-9a-f]+=*$", "0123456789abcdef"),
    ("HEX", r"^(?=.*[0-9])(?=.*[A-F])[0-9A-F]+=*$", "0123456789ABCDEF"),
    ("base32", r"^(?=.*[2-7])(?=.*[A-Z])[A-Z2-7]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("lower", r"^(?=.*[0-9])(?=.*[a-z])[a-z0-9]+=*$", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("upper", r"^(?=.*[0-9])(?=.*[A-Z])[A-Z0-9]+=*$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("base62", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9]+=*$", "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
    ("base64", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9+/]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", r"^(?=.*[0-9])(?=.*[A-Z])(?=.*[a-z])[A-Za-z0-9_-]+=*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
)
ENCODED = "|".join(look for _, look, _ in ENCODINGS)
#: Names and words: runs without a digit, what is left of them without separators, and its alphabet.
NAMES = (
    ("lower", r"^[a-z]{20,}$", "abcdefghijklmnopqrstuvwxyz"),
    ("upper", r"^[A-Z]{20,}$", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("mixed", r"^[A-Za-z]{20,}$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"),
)
#: Tokens of alike length are judged together: length / 8, up to so many bands.
BAND, BANDS = 8, 16
#: Share of the reported tokens that may be names, and steps of -ln(p) that p-values are counted in.
FALSE_DISCOVERIES = 0.05
STEP, STEPS = 0.05, 1024
#: What is assumed of names before any are seen: so many, none of which passes for random at 5 %.
PRIOR_NAMES, PRIOR_STEP = 100, 60
#: Matches of a text whose places are added up together.
PLACES = 256


def _spans(text: Column, pattern: str, kind: int, group: int = 0, least: int = 0) -> Column:
    """Spans of all matches as (begin, kind, end, match), in order; matches whose ``group`` has
    fewer than ``least`` code points are passed over. The pieces between the matches and the
    matches themselves give the places."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    judged = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    spans = "array<struct<b:bigint,k:int,e:bigint,m:string>>"
    # The piece after the last match has no match behind it; zip_with pads with nulls.
    steps = F.zip_with(F.arrays_zip(found.alias("m"), judged.alias("g")), F.split(text, pattern, -1), lambda x, gap: F.struct(x["m"].alias("m"), x["g"].alias("g"), gap.alias("gap")))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.char_length(x["gap"])
        end = begin + F.coalesce(F.char_length(x["m"]), F.lit(0))
        own = F.struct(begin.alias("b"), F.lit(kind).alias("k"), end.alias("e"), x["m"].alias("m"))
        keep = x["m"].isNotNull() & (F.char_length(x["g"]) >= least)
        return F.struct(end.cast("long").alias("at"), F.when(keep, F.concat(acc["s"], F.array(own))).otherwise(acc["s"]).alias("s"))

    def chunk(acc: Column, xs: Column) -> Column:
        # A fold that lengthens its list copies it each time, so lists stay short: one for each chunk.
        start = F.struct(acc["at"].alias("at"), F.array().cast(spans).alias("s"))
        return _let(F.aggregate(xs, start, step), lambda own: F.struct(own["at"].alias("at"), F.concat(acc["s"], F.array(own["s"])).alias("s")))

    chunks = F.transform(F.sequence(F.lit(1), F.size(steps), F.lit(PLACES)), lambda i: F.slice(steps, i, F.lit(PLACES)))
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{spans}>").alias("s"))
    return F.when(F.rlike(text, F.lit(pattern)), F.flatten(F.aggregate(chunks, zero, chunk)["s"])).otherwise(F.array().cast(spans))


def _tokens(run: Column) -> Column:
    """The tokens of a run: itself if an encoding has it, else those of its parts that one has, the
    longest first and without overlap, so that separators foreign to a token part it."""

    def parted(m: Column) -> Column:
        parts = F.filter(F.concat(*[_spans(m, p, 3) for p in PARTS]), lambda y: F.rlike(y["m"], F.lit(ENCODED)))
        longest = F.array_sort(F.transform(parts, lambda y: F.struct((y["b"] - y["e"]).alias("short"), y["b"].alias("b"), y["k"].alias("k"), y["e"].alias("e"), y["m"].alias("m"))))
        none = F.array().cast("array<struct<b:bigint,k:int,e:bigint,m:string>>")
        own = lambda y: F.array(F.struct(y["b"].alias("b"), y["k"].alias("k"), y["e"].alias("e"), y["m"].alias("m")))
        return F.aggregate(longest, none, lambda acc, y: F.when(F.exists(acc, lambda z: (z["b"] < y["e"]) & (y["b"] < z["e"])), acc).otherwise(F.concat(acc, own(y))))

    moved = F.transform(parted(run["m"]), lambda y: F.struct((run["b"] + y["b"]).alias("b"), y["k"].alias("k"), (run["b"] + y["e"]).alias("e"), y["m"].alias("m")))
    return F.when(F.rlike(run["m"], F.lit(ENCODED)), F.array(run)).otherwise(moved)


def _tail(z: Column) -> Column:
    """P(Z > z) of a standard normal, by the rational approximation with error below 1e-7."""


    def half(a: Column) -> Column:
        x, t = a["x"], a["t"]
        poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
        own = F.greatest(poly * F.exp(-x * x) / 2, F.lit(1e-300))
        return F.when(a["up"], own).otherwise(1 - own)

    def of(y: Column) -> Column:
        x = F.abs(y) / 2**0.5
        return _let(F.struct(x.alias("x"), (1.0 / (1.0 + 0.3275911 * x)).alias("t"), (y >= 0).alias("up")), half)

    return _let(z, of)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def _battery(token: Column, encodings: tuple = ENCODINGS) -> Column:
    """(encoding, band, step), or null for a token in no encoding: step counts -ln(p) of
    Fisher's combination of three p-values that a token of random characters would have:
    chi-squared of its alphabet, runs above and below the alphabet's middle, and serial
    correlation of neighbouring values."""
    form = None
    for name, look, alphabet in encodings:
        own = F.struct(F.lit(name).alias("name"), F.lit(alphabet).alias("abc"), F.lit(float(len(alphabet))).alias("size"))
        form = F.when(F.rlike(token, F.lit(look)), own) if form is None else form.when(F.rlike(token, F.lit(look)), own)
    zero = lambda: F.lit(0.0)

    def measured(e: Column) -> Column:
        bare = F.rtrim(token, F.lit("="))
        return F.struct(
            e["name"].alias("name"), e["abc"].alias("abc"), e["size"].alias("size"), bare.alias("bare"), F.char_length(bare).cast("double").alias("n"),
            F.transform(F.split(bare, ""), lambda c: (F.instr(e["abc"], c) - 1).cast("double")).alias("v"),
        )

    def summed(x: Column) -> Column:
        v, half, centre = x["v"], x["size"] / 2, (x["size"] - 1) / 2
        pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.struct(
            F.when((a >= half) != (b >= half), 1.0).otherwise(0.0).alias("turn"), ((a - centre) * (b - centre)).alias("both")))
        squares = F.aggregate(F.split(x["abc"], ""), zero(), lambda acc, c: acc + F.pow(x["n"] - F.char_length(F.replace(x["bare"], c, F.lit(""))), F.lit(2.0)))
        start = F.struct(zero().alias("turns"), zero().alias("both"))
        return F.struct(
            x["name"].alias("name"), x["size"].alias("size"), x["n"].alias("n"), squares.alias("squares"),
            F.aggregate(v, zero(), lambda acc, a: acc + F.when(a >= half, 1.0).otherwise(0.0)).alias("high"),
            F.aggregate(pairs, start, lambda acc, q: F.struct((acc["turns"] + q["turn"]).alias("turns"), (acc["both"] + q["both"]).alias("both"))).alias("q"),
        )

    def scored(x: Column) -> Column:
        n, size = x["n"], x["size"]
        mean = 2 * x["high"] * (n - x["high"]) / n + 1
        return F.struct(
            x["name"].alias("name"), size.alias("size"), n.alias("n"), mean.alias("mean"), ((mean - 1) * (mean - 2) / (n - 1)).alias("spread"), (1.0 + x["q"]["turns"]).alias("runs"),
            ((size / n * x["squares"] - n - (size - 1)) / F.sqrt(2.0 * (size - 1) * (n - 1) / n)).alias("z_chi"),
            # Under uniformity a value has variance (size ** 2 - 1) / 12.
            (F.abs(x["q"]["both"]) / ((size * size - 1) / 12) / F.sqrt(n - 1)).alias("z_serial"),
        )

    def combined(x: Column) -> Column:
        p_runs = F.when(x["spread"] > 0, F.least(F.lit(1.0), 2 * _tail(F.abs(x["runs"] - x["mean"]) / F.sqrt(x["spread"])))).otherwise(F.lit(1e-12))
        return F.struct(
            x["name"].alias("name"), x["size"].alias("size"), x["n"].alias("n"),
            # Half of Fisher's statistic, which has 6 degrees of freedom.
            (-(F.log(_tail(x["z_chi"])) + F.log(p_runs) + F.log(F.least(F.lit(1.0), 2 * _tail(x["z_serial"]))))).alias("f"),
        )

    def judged(x: Column) -> Column:
        minus_log = x["f"] - F.log(1 + x["f"] + x["f"] * x["f"] / 2)
        return F.struct(
            x["name"].alias("encoding"),
            F.least(F.floor(x["n"] / BAND), F.lit(BANDS)).cast("int").alias("band"),
            F.least(F.floor(F.greatest(minus_log, zero()) / STEP), F.lit(STEPS)).cast("int").alias("step"),
        )

    whole = _let(form, lambda e: F.when(e.isNotNull(), _let(_let(_let(_let(measured(e), summed), scored), combined), judged)))
    return whole


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans by row.

    Base spans come from the three patterns, over whole texts. The method adds spans of kind
    'random': runs that look like an encoding and pass for random characters in it (``_tokens``:
    '=' between a name and its value and separators foreign to the encoding part them). The
    battery measures how far a run is from random characters. What names and words measure is
    taken from the corpus: the runs without a digit, by length band. A run's p-value is the share
    of names in its band that look as random as it does; per encoding and band Benjamini and
    Hochberg's step-up then takes as many runs as keep the share of names among those reported
    at ``FALSE_DISCOVERIES``. Short names look more random than long ones, so short bands ask for
    more. Where names are few, ``PRIOR_NAMES`` count. All counts are histograms over all
    documents; nothing is sorted, and what reaches the driver is a count for each encoding, band
    and step. Runs that overlap a base span are left out.

    spans lists all spans as kind:begin:end (code points, end exclusive) by begin, then kind;
    base_sha256 is the digest of the base ones listed likewise. Null and empty texts have none.
    Repeated rows are scanned each. An empty table gives no rows. Other columns are not looked at.
    """
    text = F.coalesce(F.col("t"), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).select("doc_id", text.alias("t"))
    base = F.concat(_spans(F.col("t"), ASSIGN, 0, 2, ASSIGN_LEAST), _spans(F.col("t"), ACCESS_LONG, 1), _spans(F.col("t"), HEX_LONG, 2))
    found = rows.select(
        "doc_id",
        F.array_sort(F.transform(base, lambda x: F.struct(x["b"], x["k"], x["e"]))).alias("base"),
        _spans(F.col("t"), RUN, 3).alias("all"),
    ).select("doc_id", "base", F.flatten(F.transform("all", _tokens)).alias("runs"), F.filter("all", lambda x: ~F.rlike(x["m"], F.lit("[0-9]"))).alias("names"))
    apart = F.filter("runs", lambda x: ~F.exists("base", lambda y: (y["b"] < x["e"]) & (x["b"] < y["e"])))
    judged = F.filter(F.transform(apart, lambda x: F.struct(x["b"], x["k"], x["e"], _battery(x["m"]).alias("t"))), lambda x: x["t"].isNotNull())
    wordy = F.filter(F.transform("names", lambda x: _battery(F.regexp_replace(x["m"], "[^A-Za-z]", ""), NAMES)), lambda x: x.isNotNull())
    kept = cut(found.select("doc_id", "base", judged.alias("runs"), wordy.alias("names")))
    counts = kept.select(F.explode("runs").alias("x")).groupBy("x.t.encoding", "x.t.band", "x.t.step").count().collect()
    names = kept.select(F.explode("names").alias("x")).groupBy("x.band", "x.step").count().collect()
    strictest = _thresholds([(r["encoding"], r["band"], r["step"], r["count"]) for r in counts], [(r["band"], r["step"], r["count"]) for r in names])
    limit = F.create_map(*[F.lit(y) for (e, b), s in sorted(strictest.items()) for y in (f"{e}:{b}", s)]) if strictest else F.create_map().cast("map<string,int>")
    random = F.filter("runs", lambda x: x["t"]["step"] <= F.coalesce(limit[F.concat_ws(":", x["t"]["encoding"], x["t"]["band"].cast("string"))], F.lit(-1)))
    names = F.array(*[F.lit(k) for k in ("assign", "access", "hex", "random")])
    write = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["b"].cast("string"), x["e"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return kept.select("doc_id", "base", F.transform(random, lambda x: F.struct(x["b"], x["k"], x["e"])).alias("random")).select(
        "doc_id",
        count(0).alias("n_assign"),
        count(1).alias("n_access"),
        count(2).alias("n_hex"),
        F.size("random").cast("long").alias("n_random"),
        F.sha2(write(F.col("base")), 256).alias("base_sha256"),
        write(F.array_sort(F.concat("base", "random"))).alias("spans"),
    )


def _thresholds(counts: list[tuple[str, int, int, int]], names: list[tuple[int, int, int]]) -> dict[tuple[str, int], int]:
    """The greatest step of -ln(p) up to which a run is reported, by encoding and band (none: no key).

    counts: (encoding, band, step, runs); names: (band, step, names). A run's p-value is (1 + names
    of its band with as low a step) / (1 + names of its band); the step-up takes the greatest step
    whose p-value is at most ``FALSE_DISCOVERIES`` * (runs up to it) / (all runs).
    """
    usual: dict[int, dict[int, int]] = {}
    for band, step, n in names:
        usual.setdefault(band, {})[step] = n
    cells: dict[tuple[str, int], dict[int, int]] = {}
    for encoding, band, step, n in counts:
        cells.setdefault((encoding, band), {})[step] = n
    out = {}
    for cell, hist in cells.items():
        known = usual.get(cell[1], {})
        total, all_names, taken, alike = sum(hist.values()), sum(known.values()) + PRIOR_NAMES, 0, 0
        for step in range(STEPS + 1):
            taken += hist.get(step, 0)
            alike += known.get(step, 0) + (PRIOR_NAMES if step == PRIOR_STEP else 0)
            if taken and (1 + alike) / (1 + all_names) <= FALSE_DISCOVERIES * taken / total:
                out[cell] = step
    return out
