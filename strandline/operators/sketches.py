"""k-mers and minimizers of sequences (name, seq), and similarity of their sets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Upper-case A, C, G, T of bytes, 0 for all else; and complements of those.
_BASE, _OTHER = np.zeros(256, np.uint8), np.zeros(256, np.uint8)
for _x, _y in zip(b"ACGTacgt", b"ACGTACGT", strict=True):
    _BASE[_x] = _y
_OTHER[list(b"ACGT")] = list(b"TGCA")
#: Places of a sequence that are looked at together, and k-mers in a batch.
_PLACES = 1 << 17


def canonical_kmers(seq: np.ndarray, k: int, palindromes: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(places, k-mers as rows of bytes) of a sequence's bytes: the lesser of either strand, of A, C, G
    and T alone. Work rises with the sequence's length, not with its square."""
    if len(seq) < k:
        return np.empty(0, np.int64), np.empty((0, k), np.uint8)
    base = _BASE[seq]
    other = np.concatenate([[0], np.cumsum(base == 0)])
    at = np.flatnonzero(other[k:] == other[:-k])
    forward = np.lib.stride_tricks.sliding_window_view(base, k)[at]
    back = np.lib.stride_tricks.sliding_window_view(_OTHER[base][::-1], k)[len(seq) - k - at]
    differ = forward != back
    first = differ.argmax(axis=1)[:, None]
    less = np.take_along_axis(back, first, 1) < np.take_along_axis(forward, first, 1)
    least = np.where(less, back, forward)
    keep = slice(None) if palindromes else differ.any(axis=1)
    return at[keep], least[keep]


def kmer_rows(seqs: DataFrame, k: int, palindromes: bool = False) -> DataFrame:
    """name, pos, kmer: canonical k-mers (the lesser of either strand) of A, C, G and T; an index
    leaves palindromes out, a sketch keeps them. By Arrow batches."""
    kind = seqs.schema["name"].dataType.simpleString()

    def told(names: pa.Array, parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        name = names.take(pa.array(np.repeat([i for i, _, _ in parts], [len(at) for _, at, _ in parts]).astype(np.int64)))
        at, text = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
        ends = pa.py_buffer(np.arange(0, (len(at) + 1) * k, k, dtype=np.int32))
        kmer = pa.Array.from_buffers(pa.string(), len(at), [None, ends, pa.py_buffer(np.ascontiguousarray(text))])
        return pa.RecordBatch.from_arrays([name, pa.array(at.astype(np.int32)), kmer], names=["name", "pos", "kmer"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, n = [], 0
            for i, seq in enumerate(batch.column(1)):
                code = np.frombuffer((seq.as_py() or "").encode("ascii", "replace"), np.uint8)
                for begin in range(0, max(len(code) - k + 1, 0), _PLACES):
                    at, text = canonical_kmers(code[begin : begin + _PLACES + k - 1], k, palindromes)
                    parts.append((i, at + begin, text))
                    n += len(at)
                    if n >= _PLACES:
                        yield told(batch.column(0), parts)
                        parts, n = [], 0
            if parts:
                yield told(batch.column(0), parts)

    return seqs.select("name", "seq").mapInArrow(run, f"name {kind}, pos int, kmer string")


def kmer_depth(index: DataFrame, reads: DataFrame, k: int, most: int = 65535) -> DataFrame:
    """kmer, multiplicity (places in the index), depth (occurrences in reads, saturating)."""
    a = kmer_rows(index, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("multiplicity"))
    b = kmer_rows(reads, k).groupBy("kmer").agg(F.count(F.lit(1)).alias("n"))
    return a.join(b, "kmer", "left").select("kmer", "multiplicity", F.least(F.coalesce("n", F.lit(0)), F.lit(most)).cast("long").alias("depth"))


def containment(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """l_name, r_name, common, l_size, r_size: shared distinct k-mers of all pairs that share any.

    An equi-join on the k-mer of distinct (name, k-mer) rows; sizes are joined after the count.
    """
    a = kmer_rows(left, k, True).select(F.col("name").alias("l_name"), "kmer").distinct()
    b = kmer_rows(right, k, True).select(F.col("name").alias("r_name"), "kmer").distinct()
    la = a.groupBy("l_name").agg(F.count(F.lit(1)).alias("l_size"))
    lb = b.groupBy("r_name").agg(F.count(F.lit(1)).alias("r_size"))
    return a.join(b, "kmer").groupBy("l_name", "r_name").agg(F.count(F.lit(1)).alias("common")).join(la, "l_name").join(lb, "r_name")


#: The increment and multipliers of SplitMix64.
_SPLIT = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_CODE = np.full(256, 4, np.uint8)
_CODE[[ord(c) for c in "ACGTacgt"]] = [0, 1, 2, 3, 0, 1, 2, 3]


def split_mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64 of unsigned 64-bit numbers."""
    step, first, second = (np.uint64(c) for c in _SPLIT)
    x = x + step
    x = (x ^ (x >> np.uint64(30))) * first
    x = (x ^ (x >> np.uint64(27))) * second
    return x ^ (x >> np.uint64(31))


def _packed(code: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(code) - k + 1, np.uint64)
    for j in range(k):
        out = (out << np.uint64(2)) | code[j : len(code) - k + 1 + j].astype(np.uint64)
    return out


def minimizers_of(seq: str, k: int, w: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, 2-bit code, whether it is the reverse strand's) of a sequence's minimizers.

    Of the k-mers that end in the last w places the one with the least SplitMix64 hash, the later
    one of equal ones. k is at most 31. Another base than A, C, G, T parts the sequence; where a
    palindrome ends nothing is reported, and it is no candidate. What was reported last isn't again.
    """
    code = _CODE[np.frombuffer(seq.encode("ascii", "replace"), np.uint8)]
    none = np.empty(0, np.int64)
    if len(code) < k:
        return none, np.empty(0, np.uint64), np.empty(0, bool)
    other = code > 3
    run = np.cumsum(other)
    own = np.where(other, 0, code).astype(np.uint8)
    forward, back = _packed(own, k), _packed((3 - own)[::-1], k)[::-1]
    ends = np.arange(k - 1, len(code))
    whole = (run[ends] == run[ends - k + 1]) & ~other[ends - k + 1]
    ok = whole & (forward != back)
    key = np.minimum(forward, back)
    worst = np.uint64(0xFFFFFFFFFFFFFFFF)
    h = np.where(ok, split_mix(key), worst)
    best, at = h.copy(), np.arange(len(h))
    part = run[ends]
    for d in range(1, min(w, len(h))):
        less = (h[:-d] < best[d:]) & (part[:-d] == part[d:]) & ok[:-d]
        best[d:] = np.where(less, h[:-d], best[d:])
        at[d:] = np.where(less, np.arange(len(h) - d), at[d:])
    told = at[ok & (ends + 1 >= w)]
    told = told[np.concatenate([[True], told[1:] != told[:-1]])] if len(told) else told
    return told, key[told], (forward > back)[told]


def minimizers(seqs: DataFrame, k: int, w: int, length: bool = False) -> DataFrame:
    """name, pos, key, rev: minimizers (``minimizers_of``) of sequences, by Arrow batches, so that a
    sequence's k-mers are never rows of their own. With ``length`` also that of the sequence."""
    kind = seqs.schema["name"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [s or "" for s in batch.column(1).to_pylist()]
            found = [minimizers_of(s, k, w) for s in texts]
            counts = np.array([len(f[0]) for f in found], np.int64)
            name = batch.column(0).take(pa.array(np.repeat(np.arange(len(found)), counts)))
            size = [pa.array(np.repeat(np.array([len(s) for s in texts], np.int64), counts))] if length else []
            pos, key, rev = (np.concatenate([f[i] for f in found]) if found else np.empty(0) for i in range(3))
            yield pa.RecordBatch.from_arrays([name, pa.array(pos.astype(np.int64)), pa.array(key.astype(np.uint64).view(np.int64)), pa.array(rev.astype(bool)), *size], names=["name", "pos", "key", "rev", "length"][: 4 + len(size)])

    return seqs.select("name", "seq").mapInArrow(run, f"name {kind}, pos long, key long, rev boolean{', length long' if length else ''}")


def occurrence_limit(rows: DataFrame, key: str, fraction: float) -> DataFrame:
    """limit: one more than the occurrences of the key that stands at (1 - fraction) of all keys, by
    rising occurrences; a histogram of occurrences tells it, so keys aren't sorted."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).groupBy("_n").agg(F.count(F.lit(1)).alias("_keys"))
    rising = Window.orderBy("_n").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # a row for each number of occurrences
    placed = n.withColumn("_upto", F.sum("_keys").over(rising)).withColumn("_all", F.sum("_keys").over(every))
    kth = F.least(F.floor(F.lit(1 - fraction) * F.col("_all")), F.col("_all") - 1)
    return placed.where(F.col("_upto") > kth).agg((F.min("_n") + 1).alias("limit"))


def high_occurrence(rows: DataFrame, key: str, fraction: float) -> DataFrame:
    """Rows without the keys that occur more often than ``occurrence_limit``."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    limit = occurrence_limit(rows, key, fraction)
    return rows.join(n.crossJoin(F.broadcast(limit)).where("_n <= limit").select(key), key, "left_semi")  # one row


def seeds(queries: DataFrame, index: DataFrame, k: int, fraction: float = 0.0, same_strand: bool = False) -> DataFrame:
    """q_name, r_name, rev, q_pos, r_pos: minimizers (name, pos, key, rev; queries also length) that a
    query shares with the index. On contrary strands q_pos counts from the query's end, so that
    it rises with r_pos along a match. Keys more frequent than ``occurrence_limit`` are passed
    over where ``fraction`` is above 0."""
    held = high_occurrence(index, "key", fraction) if fraction > 0 else index
    r = held.select(F.col("name").alias("r_name"), F.col("pos").alias("r_pos"), F.col("rev").alias("_r"), "key")
    q = queries.select(F.col("name").alias("q_name"), F.col("pos").alias("_q"), F.col("rev").alias("_qr"), "length", "key")
    hit = q.join(r, "key").withColumn("rev", F.col("_qr") != F.col("_r"))
    hit = hit.where(~F.col("rev")) if same_strand else hit
    return hit.select("q_name", "r_name", "rev", F.when(F.col("rev"), F.col("length") - F.col("_q") - k).otherwise(F.col("_q")).alias("q_pos"), "r_pos")


def spread_depth(rows: DataFrame, depths: DataFrame, sizes: DataFrame) -> DataFrame:
    """name, depth: of each sequence (name, length) the mean over its places of depth / multiplicity
    of the k-mer there (rows: name, pos, kmer; depths as ``kmer_depth``); places without are 0."""
    each = rows.join(depths, "kmer").groupBy("name").agg(F.sum(F.col("depth") / F.col("multiplicity")).alias("_s"))
    return sizes.join(each, "name", "left").select("name", F.when(F.col("length") > 0, F.coalesce("_s", F.lit(0.0)) / F.col("length")).otherwise(0.0).alias("depth"))


def index_stats(rows: DataFrame, key: str, bases: int | None = None) -> DataFrame:
    """keys, singletons, n_rows, avg_occurrence; with ``bases``, the length of all sequences, also
    avg_spacing, the bases for each row."""
    n = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    spacing = [] if bases is None else [(F.lit(float(bases)) / F.sum("_n")).alias("avg_spacing")]
    return n.agg(*spacing, F.count(F.lit(1)).alias("keys"), F.count_if(F.col("_n") == 1).alias("singletons"), F.sum("_n").alias("n_rows"), F.avg("_n").alias("avg_occurrence"))
