"""CIGAR algebra by Arrow batches: what ``cigar`` tells with higher-order functions, for whole columns of texts.

A batch's operations lie end to end in three arrays: row, length, letter. Numpy works on these, so no
expression is interpreted for each operation.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import cigar

Ops = tuple[np.ndarray, np.ndarray, np.ndarray]
_LETTER = np.zeros(256, bool)
_LETTER[list(cigar.CODES.encode())] = True
#: Digits that a 64-bit number holds in any case.
_DIGITS = 18


def _kinds(letters: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(letters.encode())] = True
    return out


def parse(texts: pa.Array) -> Ops:
    """Operations of texts, as ``cigar.ops``."""
    texts = pc.fill_null(texts, "").cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
    off = off - off[0]
    at = np.flatnonzero(_LETTER[data])
    row = np.searchsorted(off, at, "right") - 1
    bare = np.where((data >= 48) & (data <= 57), 0, np.arange(1, len(data) + 1))
    begin = np.maximum(np.concatenate([[0], np.maximum.accumulate(bare)])[at], off[row])
    told = begin < at
    at, row, width = at[told], row[told], (at - begin)[told]
    size = np.zeros(len(at), np.int64)
    if width.max(initial=0) > _DIGITS:
        for i in np.flatnonzero(width > _DIGITS):  # zeros in front, or a number too large
            size[i] = np.int64(int(bytes(data[at[i] - width[i] : at[i]])))
    for n in range(min(width.max(initial=0), _DIGITS)):
        live = np.flatnonzero((width > n) & (width <= _DIGITS))
        size[live] += (data[at[live] - 1 - n].astype(np.int64) - 48) * 10**n
    return row, size, data[at]


def merge(found: Ops) -> Ops:
    """Neighbouring operations of one row and kind as one, as ``cigar.merge_runs``."""
    row, size, letter = found
    if not len(row):
        return found
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (letter[1:] != letter[:-1])]))
    return row[first], np.add.reduceat(size, first), letter[first]


def text(found: Ops, rows: int) -> pa.Array:
    """Texts of ``rows`` rows, as ``cigar.pack``."""
    row, size, letter = found
    names = pa.array(["*", *cigar.CODES])
    place = np.zeros(256, np.int32)
    place[list(cigar.CODES.encode())] = np.arange(1, len(cigar.CODES) + 1)
    each = pc.binary_join_element_wise(pa.array(size).cast(pa.string()), names.take(pa.array(place[letter])), "")
    off = pa.array(np.searchsorted(row, np.arange(rows + 1)).astype(np.int32))
    out = pc.binary_join(pa.ListArray.from_arrays(off, each), "")
    return pc.if_else(pc.equal(out, ""), "*", out)


def span(found: Ops, rows: int, kinds: str) -> np.ndarray:
    """For each row the summed lengths of its operations of ``kinds``."""
    row, size, letter = found
    sums = np.concatenate([[0], np.cumsum(np.where(_kinds(kinds)[letter], size, 0))])
    off = np.searchsorted(row, np.arange(rows + 1))
    return sums[off[1:]] - sums[off[:-1]]


def _joined(parts: list[tuple[np.ndarray, Ops]]) -> Ops:
    """Operations with their places in a row, in order of row and place; those of one place keep theirs."""
    place, row, size, letter = (np.concatenate([p if i < 0 else o[i] for p, o in parts]) for i in (-1, 0, 1, 2))
    order = np.lexsort((place, row))
    return row[order], size[order], letter[order]


def assemble(lead: pa.Array, blocks: pa.Array, gaps: pa.Array, trail: pa.Array) -> Ops:
    """Merged operations of alignments, as ``cigar.assembled``."""
    rows = len(lead)
    flat = blocks.flatten()
    many = pc.fill_null(pc.list_value_length(blocks), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(rows), many)
    place = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
    rb, re, qb, qe = (pc.struct_field(flat, n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("r_beg", "r_end", "q_beg", "q_end"))
    r, q = re - rb, qe - qb
    both = np.minimum(r, q)
    parts = []
    for n, (size, letter) in enumerate(((both, "="), (r - both, "D"), (q - both, "I"))):
        live = size > 0
        parts.append((4 * place[live] + n, (row[live], size[live], np.full(live.sum(), ord(letter), np.uint8))))
    known = pc.fill_null(pc.list_value_length(gaps), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    owner, nth = np.repeat(np.arange(rows), known), np.arange(known.sum()) - np.repeat(np.cumsum(known) - known, known)
    at, size, letter = parse(gaps.flatten())
    live = nth[at] < many[owner[at]]
    parts.append((4 * nth[at][live] + 3, (owner[at][live], size[live], letter[live])))
    for texts, where in ((lead, -1), (trail, 4 * many.max(initial=0))):
        found = parse(texts)
        parts.append((np.full(len(found[0]), where), found))
    return merge(_joined(parts))


def finish(found: Ops, r_beg: np.ndarray, r_end: np.ndarray, q_beg: np.ndarray, q_end: np.ndarray, size: np.ndarray, hard: bool) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(r_beg, r_end, text) of alignments, as ``cigar.finished``."""
    row, length, letter = found
    rows = len(r_beg)
    off = np.searchsorted(row, np.arange(rows + 1))
    some = np.flatnonzero(off[1:] > off[:-1])
    first, last = off[:-1][some], off[1:][some] - 1
    lost = letter == ord("D")
    left, right = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    left[some] = np.where(lost[first], length[first], 0)
    right[some] = np.where(lost[last] & ((last > first) | (left[some] == 0)), length[last], 0)
    keep = np.ones(len(row), bool)
    keep[first[left[some] > 0]] = False
    keep[last[right[some] > 0]] = False
    parts = [(np.zeros(keep.sum(), np.int64), (row[keep], length[keep], letter[keep]))]
    for n, where in ((q_beg, -1), (size - q_end, 1)):
        live = np.flatnonzero(n > 0)
        parts.append((np.full(len(live), where), (live, n[live], np.full(len(live), ord("H" if hard else "S"), np.uint8))))
    whole = merge(_joined(parts))
    out = text(whole, rows)
    wrong = np.flatnonzero(span(whole, rows, cigar.QUERY) != size)
    if len(wrong):
        raise ValueError(f"the CIGAR doesn't spell the read: {out[wrong[0]]}")
    return r_beg + left, r_end - right, out


# ---- as columns ------------------------------------------------------------------------------------


@cache
def _merged():
    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        return text(merge(parse(texts)), len(texts))

    return run


def merged(texts: Column) -> Column:
    """Texts with neighbouring operations of one kind as one: ``pack(merge_runs(ops(texts)))``."""
    return _merged()(texts)


@cache
def _block_bases():
    @F.arrow_udf("long")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(span(parse(texts), len(texts), "MD=X"))

    return run


def block_bases(texts: Column) -> Column:
    """Bases of the reference blocks: ``total_block_bases(ref_blocks(0, ops(texts)))``; N parts blocks and is in none."""
    return _block_bases()(texts)


@cache
def _finished(hard: bool):
    @F.arrow_udf("r_beg long, r_end long, cigar string")
    def run(lead: pa.Array, blocks: pa.Array, gaps: pa.Array, trail: pa.Array, r_beg: pa.Array, r_end: pa.Array, q_beg: pa.Array, q_end: pa.Array, size: pa.Array) -> pa.Array:
        numbers = [x.to_numpy(zero_copy_only=False).astype(np.int64) for x in (r_beg, r_end, q_beg, q_end, size)]
        lo, hi, out = finish(assemble(lead, blocks, gaps, trail), *numbers, hard)
        return pa.StructArray.from_arrays([pa.array(lo), pa.array(hi), out], ["r_beg", "r_end", "cigar"])

    return run


def finished(lead: Column, blocks: Column, gaps: Column, trail: Column, r_beg: Column, r_end: Column, q_beg: Column, q_end: Column, read_len: Column, hard: bool = False) -> Column:
    """``cigar.finished`` of what ``cigar.assembled`` makes of lead, blocks, gaps and trail; nulls there are nothing."""
    return _finished(hard)(lead, blocks, gaps, trail, *[x.cast("long") for x in (r_beg, r_end, q_beg, q_end, read_len)])
