"""Composite names: stretches ``root:beg-end`` one after the other, parted by ; or +; a stretch whose
first number is the greater one runs backwards."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PIECE = "struct<root:string,a:bigint,b:bigint>"
_TOKEN = r"^\s*([^:]*[^:\s])\s*:\s*([0-9]+)\s*-\s*([0-9]+)\s*$"


def delimiter(name: Column) -> Column:
    """';' where the name has one, else '+'."""
    return F.when(F.contains(name, F.lit(";")), ";").otherwise("+")


def _tokens(name: Column) -> Column:
    parts = F.when(F.contains(name, F.lit(";")), F.split(name, ";")).otherwise(F.split(name, "[+]"))
    return F.filter(F.transform(parts, lambda t: F.trim(t)), lambda t: t != "")


def _piece(token: Column) -> Column:
    return F.struct(F.regexp_extract(token, _TOKEN, 1).alias("root"), F.regexp_extract(token, _TOKEN, 2).cast("long").alias("a"), F.regexp_extract(token, _TOKEN, 3).cast("long").alias("b"))


def pieces(name: Column) -> Column:
    """array<struct<root,a,b>> of a name, from a to b; none for a plain one. Of a name of several, a
    stretch that can't be read is an error."""
    tokens = _tokens(name)
    good = lambda t: F.rlike(t, F.lit(_TOKEN))
    read = F.transform(tokens, lambda t: F.when(good(t), _piece(t)).otherwise(F.raise_error(F.concat(F.lit("bad stretch in "), name)).cast(_PIECE)))
    none = F.array().cast(f"array<{_PIECE}>")
    return F.when(~F.contains(name, F.lit(":")) | ((F.size(tokens) == 1) & ~good(name)), none).otherwise(read)


def render(parts: Column) -> Column:
    return F.array_join(F.transform(parts, lambda p: F.concat(p["root"], F.lit(":"), p["a"].cast("string"), F.lit("-"), p["b"].cast("string"))), ";")


def merged(parts: Column) -> Column:
    """Neighbours of one root that touch become one, in the direction of the first; neighbours of one
    root that overlap are an error."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        low, high = F.least(last["a"], last["b"]), F.greatest(last["a"], last["b"])
        lo, hi = F.least(x["a"], x["b"]), F.greatest(x["a"], x["b"])
        one = last["root"] == x["root"]
        clash = one & (F.greatest(low, lo) < F.least(high, hi))
        fits = one & ((last["b"] == x["a"]) | (last["a"] == x["b"]))
        least, most = F.least(low, lo), F.greatest(high, hi)
        up = last["a"] < last["b"]
        both = F.struct(last["root"].alias("root"), F.when(up, least).otherwise(most).alias("a"), F.when(up, most).otherwise(least).alias("b"))
        stop = F.raise_error(F.concat(F.lit("overlapping stretches of "), x["root"])).cast(f"array<{_PIECE}>")
        return F.when(clash, stop).when(fits, F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(both))).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), F.slice(parts, F.lit(1), F.lit(1)), step)


def sliced(parts: Column, begin: Column, end: Column) -> Column:
    """What [begin, end) of the stretches laid end to end holds of each."""
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{_PIECE}>").alias("out"))

    def step(acc: Column, p: Column) -> Column:
        size = F.abs(p["b"] - p["a"])
        lo, hi = F.greatest(begin - acc["at"], F.lit(0).cast("long")), F.least(end - acc["at"], size)
        up = p["a"] <= p["b"]
        own = F.struct(p["root"].alias("root"), F.when(up, p["a"] + lo).otherwise(p["a"] - lo).alias("a"), F.when(up, p["a"] + hi).otherwise(p["a"] - hi).alias("b"))
        return F.struct((acc["at"] + size).alias("at"), F.when(lo < hi, F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"))

    return F.aggregate(parts, zero, step, lambda acc: acc["out"])


def interval_name(base: Column, begin: Column, end: Column, reverse: Column) -> Column:
    """The name of [begin, end) of what ``base`` names. Of a plain root the direction shows in the
    order of the numbers; stretches of a composite one keep their own. An empty interval, or one
    beyond the end, is an error."""
    own = pieces(base)
    total = F.aggregate(own, F.lit(0).cast("long"), lambda acc, p: acc + F.abs(p["b"] - p["a"]))
    plain = F.concat(base, F.lit(":"), F.when(reverse, end).otherwise(begin).cast("string"), F.lit("-"), F.when(reverse, begin).otherwise(end).cast("string"))
    bad = F.raise_error(F.concat(F.lit("no such interval of "), base)).cast("string")
    return F.when(begin >= end, bad).when(F.size(own) == 0, plain).when(end > total, bad).otherwise(render(merged(sliced(own, begin, end))))


def chain_name(names: Column) -> Column:
    """The name of several laid end to end; a plain one counts as a stretch of no length."""
    each = F.transform(names, lambda n: F.when(F.size(pieces(n)) > 0, pieces(n)).otherwise(F.array(F.struct(n.alias("root"), F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b")))))
    return render(merged(F.flatten(each)))


def directed(name: Column, reverse: Column) -> Column:
    """The name read forwards, or backwards: stretches in contrary order, each turned round. What is
    no stretch stays as it is."""
    token = lambda t: F.rlike(t, F.lit(_TOKEN))

    def turned(t: Column) -> Column:
        p = _piece(t)
        return F.when(token(t), F.concat(p["root"], F.lit(":"), p["b"].cast("string"), F.lit("-"), p["a"].cast("string"))).otherwise(t)

    def kept(t: Column) -> Column:
        p = _piece(t)
        return F.when(token(t), F.concat(p["root"], F.lit(":"), p["a"].cast("string"), F.lit("-"), p["b"].cast("string"))).otherwise(t)

    parts = _tokens(name)
    return F.when(reverse, F.array_join(F.transform(F.reverse(parts), turned), ";")).otherwise(F.array_join(F.transform(parts, kept), ";"))


def roots(name: Column) -> Column:
    """Distinct roots, in order."""
    return F.array_distinct(F.transform(_tokens(name), lambda t: F.trim(F.substring_index(t, ":", 1))))


def share_root(a: Column, b: Column) -> Column:
    return F.arrays_overlap(roots(a), roots(b))


def info(name: Column) -> Column:
    """struct<base,beg,end> of ``base:beg-end``; a name of another form is its own base, from 0 to 0."""
    form = r"^(.*):([0-9]+)-([0-9]+)$"
    ok = F.rlike(name, F.lit(form))
    n = lambda i: F.when(ok, F.regexp_extract(name, form, i).cast("long")).otherwise(0)
    return F.struct(F.when(ok, F.regexp_extract(name, form, 1)).otherwise(name).alias("base"), n(2).alias("beg"), n(3).alias("end"))
