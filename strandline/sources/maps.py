"""Coordinate-map files: two sides a line, each a chain of contig stretches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import lines, records, write_lines

_PIECES = "array<struct<ctg:string,beg:bigint,end:bigint,fwd:boolean>>"


def _pieces(side: Column) -> Column:
    """The stretches of ``name:x-y[;name:x-y...][:s-e][+|-]`` in reading order: x above y runs
    backwards, s-e cuts the chain as a whole, a minus reads it from its end."""
    signed = F.rlike(side, F.lit(r"[0-9][+-]$"))
    minus = signed & F.endswith(side, F.lit("-"))
    bare = F.when(signed, F.left(side, F.char_length(side) - 1)).otherwise(side)
    cut = F.regexp_extract(bare, r"^.*:[0-9]+-[0-9]+:([0-9]+)-([0-9]+)$", 1), F.regexp_extract(bare, r"^.*:[0-9]+-[0-9]+:([0-9]+)-([0-9]+)$", 2)
    chain = F.regexp_replace(bare, r"(:[0-9]+-[0-9]+):[0-9]+-[0-9]+$", "$1")

    def piece(t: Column) -> Column:
        x, y = (F.regexp_extract(t, r"^(.*):([0-9]+)-([0-9]+)$", i).cast("long") for i in (2, 3))
        ok = F.rlike(t, F.lit(r"^.+:[0-9]+-[0-9]+$"))
        own = F.struct(F.regexp_extract(t, r"^(.*):([0-9]+)-([0-9]+)$", 1).alias("ctg"), F.least(x, y).alias("beg"), F.greatest(x, y).alias("end"), (x < y).alias("fwd"))
        return F.when(ok & (x != y), own).otherwise(F.raise_error(F.concat(F.lit("bad stretch: "), t)).cast("struct<ctg:string,beg:bigint,end:bigint,fwd:boolean>"))

    whole = F.transform(F.split(chain, ";"), piece)
    lo = F.when(cut[0] != "", cut[0].cast("long")).otherwise(0)
    hi = F.when(cut[1] != "", cut[1].cast("long")).otherwise(F.lit((1 << 62)))

    def clip(acc: Column, p: Column) -> Column:
        size = p["end"] - p["beg"]
        a, b = F.greatest(lo - acc["at"], F.lit(0).cast("long")), F.least(hi - acc["at"], size)
        own = F.struct(
            p["ctg"].alias("ctg"), F.when(p["fwd"], p["beg"] + a).otherwise(p["end"] - b).alias("beg"), F.when(p["fwd"], p["beg"] + b).otherwise(p["end"] - a).alias("end"), p["fwd"].alias("fwd")
        )
        return F.struct((acc["at"] + size).alias("at"), F.when(a < b, F.concat(acc["out"], F.array(own))).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(_PIECES).alias("out"))
    kept = F.aggregate(whole, start, clip, lambda acc: acc["out"])
    turned = F.transform(F.reverse(kept), lambda p: F.struct(p["ctg"].alias("ctg"), p["beg"].alias("beg"), p["end"].alias("end"), (~p["fwd"]).alias("fwd")))
    return F.when(minus, turned).otherwise(kept)


def _steps(pieces: Column) -> Column:
    """Pieces with where each starts in the chain."""
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<o:bigint,ctg:string,beg:bigint,end:bigint,fwd:boolean>>").alias("out"))
    step = lambda acc, p: F.struct(
        (acc["at"] + p["end"] - p["beg"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct(acc["at"].alias("o"), p["ctg"].alias("ctg"), p["beg"].alias("beg"), p["end"].alias("end"), p["fwd"].alias("fwd")))).alias("out"),
    )
    return F.aggregate(pieces, start, step, lambda acc: acc["out"])


def zip_sides(a: Column, b: Column) -> Column:
    """Both chains cut at the borders of either: array of (a_ctg, a_beg, a_end, b_ctg, b_beg, b_end, rev)."""
    sa, sb = _steps(a), _steps(b)

    def one(x: Column, y: Column) -> Column:
        lo = F.greatest(x["o"], y["o"])
        hi = F.least(x["o"] + x["end"] - x["beg"], y["o"] + y["end"] - y["beg"])
        side = lambda p: (F.when(p["fwd"], p["beg"] + lo - p["o"]).otherwise(p["end"] - (hi - p["o"])), F.when(p["fwd"], p["beg"] + hi - p["o"]).otherwise(p["end"] - (lo - p["o"])))
        (ab, ae), (bb, be) = side(x), side(y)
        return F.struct(lo.alias("lo"), hi.alias("hi"), x["ctg"].alias("a_ctg"), ab.alias("a_beg"), ae.alias("a_end"), y["ctg"].alias("b_ctg"), bb.alias("b_beg"), be.alias("b_end"), (x["fwd"] != y["fwd"]).alias("rev"))

    return F.filter(F.flatten(F.transform(sa, lambda x: F.transform(sb, lambda y: one(x, y)))), lambda z: z["lo"] < z["hi"])


def _length(pieces: Column) -> Column:
    return F.aggregate(pieces, F.lit(0).cast("long"), lambda acc, p: acc + p["end"] - p["beg"])


def read_map(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return parse_map(lines(spark, path))


def parse_map(text: DataFrame) -> DataFrame:
    """Records a_ctg, a_beg, a_end, b_ctg, b_beg, b_end, rev. Both sides of a line must be equally
    long; lines of no length are passed over."""
    f = F.split(F.trim("value"), r"\s+")
    rows = records(text).select(_pieces(f[0]).alias("a"), _pieces(f[1]).alias("b"), "value")
    checked = F.when(_length(F.col("a")) == _length(F.col("b")), zip_sides(F.col("a"), F.col("b"))).otherwise(
        F.raise_error(F.concat(F.lit("sides differ in length: "), F.col("value"))).cast("array<struct<lo:bigint,hi:bigint,a_ctg:string,a_beg:bigint,a_end:bigint,b_ctg:string,b_beg:bigint,b_end:bigint,rev:boolean>>")
    )
    return rows.select(F.explode(checked).alias("x")).select("x.a_ctg", "x.a_beg", "x.a_end", "x.b_ctg", "x.b_beg", "x.b_end", "x.rev")


def map_line(a_ctg: Column, a_beg: Column, a_end: Column, b_ctg: Column, b_beg: Column, b_end: Column, rev: Column) -> Column:
    return F.concat(a_ctg, F.lit(":"), a_beg, F.lit("-"), a_end, F.lit("+\t"), b_ctg, F.lit(":"), b_beg, F.lit("-"), b_end, F.when(rev, "-").otherwise("+"))


def write_map(df: DataFrame, path: str) -> None:
    order = ["a_ctg", "a_beg", "a_end", "b_ctg", "b_beg", "b_end"]
    line = map_line(*[F.col(c) for c in order], F.col("rev")).alias("line")
    write_lines(df.select(line, *order), path, order)
