"""CIGAR algebra. A CIGAR is text such as ``10M2I5M``; ops are array<struct<len,op>>."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Which operations consume what.
REFERENCE, ALIGNED_QUERY, QUERY, MATCH = "MDN=X", "MI=X", "MISH=X", "M=X"
_OPS = "array<struct<len:bigint,op:string>>"


def ops(cigar: Column) -> Column:
    """Parsed operations; null and '*' have none, text between operations is passed over."""
    found = F.regexp_extract_all(F.coalesce(cigar, F.lit("")), F.lit("[0-9]+[MIDNSHP=X]"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.left(x, F.char_length(x) - 1).cast("long").alias("len"), F.right(x, F.lit(1)).alias("op")))


def pack(parsed: Column) -> Column:
    text = F.array_join(F.transform(parsed, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")
    return F.regexp_replace(text, "^$", "*")  # a case would make the text twice


def merge_runs(parsed: Column) -> Column:
    """Neighbouring operations of one kind become one."""

    def step(acc: Column, x: Column) -> Column:
        last = F.element_at(acc, -1)
        joined = F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.struct((last["len"] + x["len"]).alias("len"), x["op"].alias("op"))))
        return F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1)["op"] == x["op"]), joined).otherwise(F.concat(acc, F.array(x)))

    return F.aggregate(parsed, F.array().cast(_OPS), lambda acc, x: F.when(F.size(acc) == 0, F.array(x)).otherwise(step(acc, x)))


def _span(parsed: Column, kinds: str) -> Column:
    return F.aggregate(parsed, F.lit(0).cast("long"), lambda acc, x: acc + F.when(F.instr(F.lit(kinds), x["op"]) > 0, x["len"]).otherwise(0))


def ref_span(parsed: Column) -> Column:
    return _span(parsed, REFERENCE)


def query_span_aligned(parsed: Column) -> Column:
    return _span(parsed, ALIGNED_QUERY)


def query_span(parsed: Column) -> Column:
    return _span(parsed, QUERY)


def match_len(parsed: Column) -> Column:
    return _span(parsed, MATCH)


def ref_blocks(begin: Column, parsed: Column) -> Column:
    """Reference blocks array<struct<beg,end>>: M D = X extend one, N parts them."""
    zero = F.struct(begin.cast("long").alias("at"), begin.cast("long").alias("open"), F.array().cast("array<struct<beg:bigint,end:bigint>>").alias("done"))

    def close(acc: Column) -> Column:
        return F.when(acc["at"] > acc["open"], F.concat(acc["done"], F.array(F.struct(acc["open"].alias("beg"), acc["at"].alias("end"))))).otherwise(acc["done"])

    def step(acc: Column, x: Column) -> Column:
        return (
            F.when(F.instr(F.lit("MD=X"), x["op"]) > 0, F.struct((acc["at"] + x["len"]).alias("at"), acc["open"].alias("open"), acc["done"].alias("done")))
            .when(x["op"] == "N", F.struct((acc["at"] + x["len"]).alias("at"), (acc["at"] + x["len"]).alias("open"), close(acc).alias("done")))
            .otherwise(acc)
        )

    return F.aggregate(parsed, zero, step, close)


def blocks(begin: Column, parsed: Column, kinds: str = MATCH) -> Column:
    """array<struct<q,t,len,op>>: where in query and reference each operation of ``kinds`` starts."""
    zero = F.struct(F.lit(0).cast("long").alias("q"), begin.cast("long").alias("t"), F.array().cast("array<struct<q:bigint,t:bigint,len:bigint,op:string>>").alias("done"))

    def step(acc: Column, x: Column) -> Column:
        own = F.struct(acc["q"].alias("q"), acc["t"].alias("t"), x["len"].alias("len"), x["op"].alias("op"))
        return F.struct(
            (acc["q"] + F.when(F.instr(F.lit("MIS=X"), x["op"]) > 0, x["len"]).otherwise(0)).alias("q"),
            (acc["t"] + F.when(F.instr(F.lit(REFERENCE), x["op"]) > 0, x["len"]).otherwise(0)).alias("t"),
            F.when(F.instr(F.lit(kinds), x["op"]) > 0, F.concat(acc["done"], F.array(own))).otherwise(acc["done"]).alias("done"),
        )

    return F.aggregate(parsed, zero, step, lambda acc: acc["done"])


def total_block_bases(found: Column) -> Column:
    return F.aggregate(found, F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["beg"])


def query_interval_fwd(parsed: Column, reverse: Column) -> Column:
    """struct<beg,end> of the aligned part in coordinates of the forward read; clips count."""
    clip = lambda x: F.instr(F.lit("SH"), x["op"]) > 0
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(True).alias("on"))
    lead = lambda p: F.aggregate(p, zero, lambda a, x: F.struct((a["n"] + F.when(a["on"] & clip(x), x["len"]).otherwise(0)).alias("n"), (a["on"] & clip(x)).alias("on")), lambda a: a["n"])
    head, tail, total = lead(parsed), lead(F.reverse(parsed)), query_span(parsed)
    first, last = F.when(reverse, tail).otherwise(head), F.when(reverse, head).otherwise(tail)
    return F.struct(first.alias("beg"), (total - last).alias("end"))


def swap(parsed: Column, reverse: Column) -> Column:
    """The CIGAR seen from the other sequence: I and D change places; a reverse match turns round."""
    other = F.transform(parsed, lambda x: F.struct(x["len"].alias("len"), F.translate(x["op"], "ID", "DI").alias("op")))
    return F.when(reverse, F.reverse(other)).otherwise(other)


def is_plain(cigar: Column) -> Column:
    return F.rlike(cigar, F.lit("^([0-9]+[MID=X])*$"))


def stats(parsed: Column) -> Column:
    """struct of matches, mismatches, inserted, deleted, aln_len, full_len, and the identities
    local (of matches and mismatches), gapped (of the alignment) and full (clips count too)."""
    n = lambda kinds: _span(parsed, kinds)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
    match, mis, ins, dele, clip = n("M="), n("X"), n("I"), n("D"), n("SH")
    aligned = match + mis + ins + dele
    return F.struct(
        match.alias("matches"), mis.alias("mismatches"), ins.alias("inserted"), dele.alias("deleted"), aligned.alias("aln_len"), (aligned + clip).alias("full_len"),
        share(match, match + mis).alias("local_identity"), share(match, aligned).alias("gapped_identity"), share(match, aligned + clip).alias("full_identity"),
    )


#: Fixed value: operations in the order of their packed codes.
CODES = "MIDNSHP=X"


def unpack(packed: Column) -> Column:
    """Text of packed operations (length * 16 + code); '*' where there are none, '?' for no code."""
    one = lambda x: F.concat(F.shiftright(x, 4).cast("string"), F.coalesce(F.nullif(F.substr(F.lit(CODES), (x.bitwiseAND(F.lit(15).cast("long")) + 1).cast("int"), F.lit(1)), F.lit("")), F.lit("?")))
    return F.when(packed.isNull() | (F.size(packed) == 0), F.lit("*")).otherwise(F.array_join(F.transform(packed, one), ""))


def paf_lengths(parsed: Column) -> Column:
    """struct<matches,block>: an M counts as matched where neither = nor X tells matches."""
    told = F.exists(parsed, lambda x: x["op"].isin("=", "X"))
    return F.struct(F.when(told, _span(parsed, "=")).otherwise(_span(parsed, "M")).alias("matches"), _span(parsed, MATCH).alias("block"))


def _block_ops(block: Column) -> Column:
    """A block (r_beg, r_end, q_beg, q_end) as = over what both sides have, and D or I for the rest of either."""
    r, q = block["r_end"] - block["r_beg"], block["q_end"] - block["q_beg"]
    one = lambda n, op: F.struct(n.alias("len"), F.lit(op).alias("op"))
    every = F.array(one(F.least(r, q), "="), one(r - F.least(r, q), "D"), one(q - F.least(r, q), "I"))
    return F.filter(every, lambda x: x["len"] > 0)


def assembled(lead: Column, blocks: Column, gaps: Column, trail: Column) -> Column:
    """Operations of an alignment: what leads to the first block, blocks with the CIGARs between them, what trails.
    lead and trail are CIGAR texts ('*' or null: nothing), gaps an array of them, the nth behind
    the nth block."""
    inner = F.transform(blocks, lambda b, i: F.concat(_block_ops(b), ops(F.get(gaps, i))))
    return merge_runs(F.concat(ops(lead), F.flatten(inner), ops(trail)))


def finished(parsed: Column, r_beg: Column, r_end: Column, q_beg: Column, q_end: Column, read_len: Column, hard: bool = False) -> Column:
    """struct<r_beg,r_end,cigar> of an alignment: deletions at its ends go, what of the read it lacks is clipped. A
    CIGAR that then doesn't spell the whole read is an error."""
    hold = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))  # noqa: E731  x is computed once
    lost = lambda p, i: F.when(F.get(p, i)["op"] == "D", F.get(p, i)["len"]).otherwise(0)
    clip = lambda n: F.filter(F.array(F.struct(n.cast("long").alias("len"), F.lit("H" if hard else "S").alias("op"))), lambda x: x["len"] > 0)

    def read(p: Column) -> Column:
        text = F.when(query_span(p) == read_len, pack(p))
        return F.coalesce(text, F.raise_error(F.concat(F.lit("the CIGAR doesn't spell the read: "), pack(p))).cast("string"))

    def bare(p: Column) -> Column:
        left = lost(p, F.lit(0))
        right = F.when((F.size(p) > 1) | (left == 0), lost(p, F.size(p) - 1)).otherwise(0)
        kept = F.slice(p, F.when(left > 0, 2).otherwise(1), F.greatest(F.size(p) - (left > 0).cast("int") - (right > 0).cast("int"), F.lit(0)))
        text = hold(merge_runs(F.concat(clip(q_beg), kept, clip(read_len - q_end))), read)
        return F.struct((r_beg + left).alias("r_beg"), (r_end - right).alias("r_end"), text.alias("cigar"))

    return hold(parsed, bare)
