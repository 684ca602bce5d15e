"""Intervals of segments: struct<seg,beg,end,rev>, cut lists, and overlap windows of arcs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span(seg: Column, begin: Column, end: Column, reverse: Column) -> Column:
    """struct<seg,beg,end,rev>; one that holds nothing is an error."""
    ok = F.when(begin < end, begin).otherwise(F.raise_error(F.lit("an interval must hold something")).cast("long"))
    return F.struct(seg.alias("seg"), ok.alias("beg"), end.alias("end"), reverse.alias("rev"))


def toggled(x: Column) -> Column:
    return F.struct(x["seg"].alias("seg"), x["beg"].alias("beg"), x["end"].alias("end"), (~x["rev"]).alias("rev"))


def canonical(x: Column) -> Column:
    """The same interval forwards."""
    return F.struct(x["seg"].alias("seg"), x["beg"].alias("beg"), x["end"].alias("end"), F.lit(False).alias("rev"))


def toggled_chain(xs: Column) -> Column:
    """A chain read from its end: contrary order, each interval turned."""
    return F.transform(F.reverse(xs), toggled)


def text(x: Column, name: Column | None = None) -> Column:
    """``name:beg-end`` and the strand; without a name the segment's number."""
    head = x["seg"].cast("string") if name is None else F.coalesce(name, x["seg"].cast("string"))
    return F.concat(head, F.lit(":"), x["beg"].cast("string"), F.lit("-"), x["end"].cast("string"), F.when(x["rev"], "-").otherwise("+"))


def touch(a: Column, b: Column) -> Column:
    """Whether two intervals of one segment and strand stand end to end."""
    return (a["seg"] == b["seg"]) & (a["rev"] == b["rev"]) & ((a["end"] == b["beg"]) | (b["end"] == a["beg"]))


def is_itself(parts: Column, key: Column) -> Column:
    """Whether an expansion is its key and nothing else."""
    return (F.size(parts) == 1) & F.coalesce(F.get(parts, F.lit(0)) == key, F.lit(False))


def source_window(length: Column, overlap: Column, reverse: Column) -> Column:
    """What of its source an arc's overlap covers: the end, of a reversed one the beginning."""
    return F.struct(F.when(reverse, 0).otherwise(length - overlap).alias("beg"), F.when(reverse, overlap).otherwise(length).alias("end"))


def target_window(length: Column, overlap: Column, reverse: Column) -> Column:
    return F.struct(F.when(reverse, length - overlap).otherwise(0).alias("beg"), F.when(reverse, length).otherwise(overlap).alias("end"))


def leaf_of(v: Column, w: Column) -> Column:
    """The leaf of two homologous segments (ids or names): the lesser; null for one and the same."""
    return F.when(v != w, F.least(v, w))


def edge_key(v: Column, w: Column) -> Column:
    """Two 32-bit vertices as one number."""
    return F.shiftleft(v, 32).bitwiseOR(w)


def edge_of(key: Column) -> Column:
    return F.struct(F.shiftrightunsigned(key, 32).alias("v"), key.bitwiseAND(F.lit(0xFFFFFFFF).cast("long")).alias("w"))


def merged_cuts(cuts: Column, more: Column) -> Column:
    """Both lists as one without repeats, in the direction that ``cuts`` has."""
    every = F.array_sort(F.array_distinct(F.concat(cuts, more)))
    falls = (F.size(cuts) >= 2) & (F.get(cuts, F.lit(0)) > F.element_at(cuts, -1))
    return F.when(F.size(more) == 0, cuts).when(falls, F.reverse(every)).otherwise(every)


def natural_key(name: Column) -> Column:
    """A text whose order is the natural one of read names: runs of digits compare as numbers, the
    rest as text; equal numbers with more leading zeros come later."""
    runs = F.regexp_extract_all(name, F.lit("[0-9]+|[^0-9]+"), F.lit(0))

    def part(x: Column) -> Column:
        bare = F.regexp_replace(x, "^0+(?=[0-9])", "")
        number = F.concat(F.lit("0"), F.lpad(F.char_length(bare).cast("string"), 9, "0"), bare, F.lpad((F.char_length(x) - F.char_length(bare)).cast("string"), 9, "0"))
        return F.when(F.rlike(x, F.lit("^[0-9]")), number).otherwise(x)

    return F.array_join(F.transform(runs, part), "")
