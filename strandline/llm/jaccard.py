"""Operator 7: exact n-gram Jaccard join by parity sketches."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textkernel
from .common import components, cut, release
from .textkernel import mix64

#: All pairs of a bucket (the sets that share a key) of at most so many sets are looked at one by
#: one; larger buckets are searched by leaders first.
SMALL = 16
#: Sets that a task holds of one side of a bucket; a larger bucket is dealt out by pairs of blocks.
BLOCK = 4096
#: Sets compared with one leader in one task.
FOLLOWERS = 1 << 16
#: Bits of a sketch: the power of two from twice the band's largest set, within these.
LEAST_BITS, MOST_BITS = 128, 4096
#: Cells of pair comparisons held at once.
_CELLS = 1 << 21
#: Deals of elements to parts before a set's elements themselves become keys.
ROUNDS = 4
#: Sets that are tried as leaders at once.
LEADERS = 16


def may_differ(percent: int, total: int) -> int:
    """The greatest symmetric difference of two sets with so many elements together whose Jaccard
    similarity is ``percent`` / 100 or more."""
    return (100 - percent) * total // (100 + percent)


@lru_cache(maxsize=8)
def bands(percent: int) -> np.ndarray:
    """First size of each size band: similar sets lie in the same or in neighbouring bands."""
    first = [1]
    while first[-1] < 1 << 40:
        first.append(first[-1] * 100 // percent + 1)
    return np.array(first, dtype=np.int64)


def band_of(n: np.ndarray, percent: int) -> np.ndarray:
    return np.searchsorted(bands(percent), n, side="right") - 1


@lru_cache(maxsize=4096)
def layout(percent: int, band: int) -> tuple[int, int, int]:
    """(differences d, parts, largest size) of the pairs whose smaller set lies in ``band``.

    d + 1 parts that hold elements are needed, so that one of them is left alone by d differences.
    Parts that are empty tell nothing, so as many more are added as are likely to be empty (mean
    and two standard deviations); ``keys_of`` sees to the sets that this isn't enough for.
    """
    low, high = int(bands(percent)[band]), int(bands(percent)[band + 1]) - 1
    most = high * 100 // percent
    d = may_differ(percent, high + most)
    parts = d + 1
    for _ in range(20):
        empty = parts * np.exp(-low / parts)
        parts = max(parts, d + 1 + int(np.ceil(empty + 2 * np.sqrt(empty))))
    return d, parts, most


def sketch_bits(percent: int, band: int) -> int:
    high = int(bands(percent)[band + 1]) - 1
    return min(MOST_BITS, max(LEAST_BITS, 1 << (2 * high - 1).bit_length()))


def part_words(u: np.ndarray, salt: int, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """The parts that hold elements, and each one's word: the XOR of its elements' hashes.

    One element that two sets don't share changes one word, so the number of words in which two
    sets differ is at most their symmetric difference.
    """
    part = (mix64(u + np.uint64(salt)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    return part[first], np.bitwise_xor.reduceat(u[order], first)


def keys_of(u: np.ndarray, percent: int) -> np.ndarray:
    """The join keys of a set, for pairs in which it is the smaller one and the larger one. The
    lowest bit tells the band that the pair's smaller set lies in from its neighbours.

    Each round deals the elements to parts anew, and rounds go on until more parts hold elements
    than a similar set may differ in; a set that no round ends has its elements for keys as well.
    Of two similar sets take the round that ends the one that ends first: both have its keys, and
    one of its parts is left alone by all differences. Where none ends, both have their elements.
    So the pair shares a key, always.
    """
    n = len(u)
    own = int(band_of(np.array([n]), percent)[0])
    out = []
    for band, partner in ((own, n * 100 // percent), (own - 1, int(bands(percent)[own]) - 1)):
        if band < 0:
            continue
        d, parts, most = layout(percent, band)
        if d == 0 or n > most:
            continue
        differ = may_differ(percent, n + partner)
        seal = np.uint64(band) << np.uint64(32)
        for turn in range(ROUNDS):
            at, word = part_words(u, band + 1 + (turn << 20), parts)
            out.append(_marked(word ^ mix64(at.astype(np.uint64) + seal + np.uint64(turn << 48)), band))
            if len(at) > differ:
                break
        else:
            out.append(_marked(u + mix64(seal + np.uint64(ROUNDS << 48)), band))
    return np.concatenate(out) if out else np.empty(0, np.uint64)


def _marked(key: np.ndarray, band: int) -> np.ndarray:
    return (mix64(key) & ~np.uint64(1)) | np.uint64(band & 1)


def sketch_of(u: np.ndarray, bits: int) -> np.ndarray:
    """Bit sketch: each element flips one bit. The Hamming distance of two is at most their sets'
    symmetric difference, also when both are folded to fewer bits."""
    at = (mix64(u ^ np.uint64(0xA5A5)) & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(np.uint8), bitorder="little").view(np.uint64)


def folded(sketch: np.ndarray, bits: int) -> np.ndarray:
    """Sketches (one a row) with fewer bits."""
    return np.bitwise_xor.reduce(sketch.reshape(len(sketch), -1, bits // 64), axis=1)


def _stats(k: int, percent: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            n, cls, check = np.zeros(rows, np.int64), np.zeros(rows, np.uint64), np.zeros(rows, np.uint64)
            sketch: list[bytes | None] = [None] * rows
            for i, u in textkernel.shingle_sets(batch.column(2).to_pylist(), k):
                n[i], cls[i], check[i] = len(u), textkernel.set_hash(u), textkernel.set_hash(u, 1)
                if len(u):
                    sketch[i] = sketch_of(u, sketch_bits(percent, int(band_of(n[i : i + 1], percent)[0]))).tobytes()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(n), pa.array(cls.view(np.int64)), pa.array(check.view(np.int64)), pa.array(sketch, pa.binary())], names=["doc_id", "digest", "n", "cls", "chk", "sketch"]
            )

    return run


def _class(u: np.ndarray, clashes: frozenset[int]) -> int:
    c = int(textkernel.set_hash(u).view(np.int64))
    return c if c not in clashes else c ^ int(textkernel.set_hash(u, 1).view(np.int64))


def _keys(k: int, percent: int, clashes: frozenset[int]) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: set[int] = set()
            keys, owners, held = [], [], 0
            for _, u in textkernel.shingle_sets(batch.column(0).to_pylist(), k):
                c = _class(u, clashes)
                if c in seen or not len(u):
                    continue
                seen.add(c)
                own = keys_of(u, percent)
                keys.append(own)
                owners.append(np.full(len(own), c, np.int64))
                held += len(own)
                if held > 500_000:
                    yield _columns(key=np.concatenate(keys).view(np.int64), cls=np.concatenate(owners))
                    keys, owners, held = [], [], 0
            if held:
                yield _columns(key=np.concatenate(keys).view(np.int64), cls=np.concatenate(owners))

    return run


def _columns(**columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], names=list(columns))


def _sets(k: int, clashes: frozenset[int]) -> object:
    """Classes with their sets; a row whose text isn't its class's (ids repeat) is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            expected = batch.column(0).to_numpy(zero_copy_only=False)
            rows, sets, held = [], [], 0
            for i, u in textkernel.shingle_sets(batch.column(1).to_pylist(), k):
                if _class(u, clashes) == expected[i]:
                    rows.append(int(expected[i]))
                    sets.append(u.tobytes())
                    held += len(u)
                    if held > _CELLS:
                        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "set"])
                        rows, sets, held = [], [], 0
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(sets, pa.binary())], names=["cls", "set"])

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(rows of groups that are complete, where each group begins) of batches sorted by ``columns``."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
        new = _starts(table, columns)
        if new[-1]:
            yield table.slice(0, new[-1]), new[:-1]
        rest = table.slice(new[-1])
    if rest is not None:
        yield rest, np.zeros(1, np.int64)


def _starts(table: pa.Table, columns: list[str]) -> np.ndarray:
    change = np.zeros(table.num_rows, bool)
    change[0] = True
    for c in columns:
        x = table[c].to_numpy()
        change[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(change)


class _Bucketed:
    """Rows of buckets: the sketches of each, at the width of its bucket's band."""

    def __init__(self, table: pa.Table, percent: int):
        self.percent = percent
        self.cls, self.n = table["cls"].to_numpy(), table["n"].to_numpy()
        own = band_of(self.n, percent)
        band = own - ((own ^ table["key"].to_numpy()) & 1)
        need = np.array([sketch_bits(percent, b) // 64 for b in range(int(band.max()) + 1)])
        self.words = need[band]
        column = table["sketch"].combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = column.chunk(0)
        off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
        raw, has = np.frombuffer(column.buffers()[2], np.uint8), np.diff(off) // 8
        self.at, self.sketch = np.zeros(len(self.n), np.int64), {}
        for w in np.unique(self.words).tolist():
            parts, places = [], []
            for h in np.unique(has[self.words == w]).tolist():
                rows = np.flatnonzero((self.words == w) & (has == h))
                whole = raw[(off[rows, None] + np.arange(8 * h))].view(np.uint64)
                parts.append(folded(whole, 64 * w))
                places.append(rows)
            self.sketch[w] = np.concatenate(parts)
            self.at[np.concatenate(places)] = np.arange(len(self.sketch[w]))

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether sizes and sketches let the pairs of rows a, b link (both in one bucket)."""
        total = self.n[a] + self.n[b]
        ok = 100 * np.minimum(self.n[a], self.n[b]) >= self.percent * np.maximum(self.n[a], self.n[b])
        for w, sketch in self.sketch.items():
            own = np.flatnonzero(ok & (self.words[a] == w))
            step = max(1, _CELLS // w)
            for lo in range(0, len(own), step):
                x = own[lo : lo + step]
                far = np.bitwise_count(sketch[self.at[a[x]]] ^ sketch[self.at[b[x]]]).sum(1, dtype=np.int64)
                ok[x] = far <= (100 - self.percent) * total[x] // (100 + self.percent)
        return ok


def _candidates(percent: int, every: bool) -> object:
    """Pairs of classes that share a bucket and that sizes and sketches let link.

    ``every``: all of them whose components ``comp`` differ. Else, in a bucket of more than
    ``SMALL``, each class meets the leaders before it alone: the first class of those that no
    leader is near to is the next leader.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, first in _whole_groups(batches, ["key", "i", "j"]):
            rows = _Bucketed(table, percent)
            comp, block = table["comp"].to_numpy(), table["block"].to_numpy()
            cross = (table["i"].to_numpy() != table["j"].to_numpy())[first]
            size = np.diff(np.append(first, table.num_rows))
            found = []
            for m in np.unique(size[(size > 1) & ((size <= SMALL) & ~cross)]).tolist():
                x, y = np.triu_indices(m, 1)
                begin = first[(size == m) & ~cross]
                step = max(1, _CELLS // 8 // len(x))
                for lo in range(0, len(begin), step):
                    at = begin[lo : lo + step, None]
                    found.append(_kept(rows, comp, (at + x).ravel(), (at + y).ravel(), every))
            for g in np.flatnonzero((size > SMALL) | ((size > 1) & cross)).tolist():
                own = np.arange(first[g], first[g] + size[g])
                found += _in_bucket(rows, comp, block, own, bool(cross[g]), every)
            pairs = [p for p in found if len(p[0])]
            if pairs:
                a, b = (np.concatenate(z) for z in zip(*pairs, strict=True))
                both = np.unique(np.stack([np.minimum(rows.cls[a], rows.cls[b]), np.maximum(rows.cls[a], rows.cls[b])], 1), axis=0)
                yield _columns(a=np.ascontiguousarray(both[:, 0]), b=np.ascontiguousarray(both[:, 1]))

    return run


def _kept(rows: _Bucketed, comp: np.ndarray, a: np.ndarray, b: np.ndarray, every: bool) -> tuple[np.ndarray, np.ndarray]:
    if every:
        other = comp[a] != comp[b]
        a, b = a[other], b[other]
    ok = rows.near(a, b)
    return a[ok], b[ok]


def _in_bucket(rows: _Bucketed, comp: np.ndarray, block: np.ndarray, own: np.ndarray, cross: bool, every: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of one large bucket, or of two blocks of it (``cross``: of different blocks alone)."""
    if not every:
        return _led(rows, block, own, cross)
    if (comp[own] == comp[own[0]]).all():
        return []
    own = own[np.argsort(rows.n[own], kind="stable")]
    last = np.searchsorted(rows.n[own], rows.n[own] * 100 // rows.percent, side="right")
    found, lo = [], 0
    while lo < len(own):  # so many rows at once that their comparisons fit
        hi = lo + 1
        while hi < len(own) and (hi + 1 - lo) * (last[hi] - lo) <= _CELLS // 8:
            hi += 1
        span = np.arange(lo, int(last[hi - 1]))
        x, y = np.repeat(np.arange(lo, hi), len(span)), np.tile(span, hi - lo)
        ok = (y > x) & (y < last[x])
        if cross:
            ok &= block[own[x]] != block[own[y]]
        found.append(_kept(rows, comp, own[x[ok]], own[y[ok]], every))
        lo = hi
    return found


def _led(rows: _Bucketed, block: np.ndarray, own: np.ndarray, cross: bool) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a leader and a row near to it that no leader before has. Rows lead in the order of
    their names, so that buckets with much the same rows have much the same leaders."""
    rest, found = own[np.argsort(rows.cls[own])], []
    while len(rest) > 1:
        head = min(LEADERS, len(rest))
        x, y = np.repeat(np.arange(head), len(rest)), np.tile(np.arange(len(rest)), head)
        ok = y > x
        if cross:
            ok &= block[rest[x]] != block[rest[y]]
        x, y = x[ok], y[ok]
        ok = rows.near(rest[x], rest[y])
        x, y = x[ok], y[ok]
        taken = np.zeros(len(rest), bool)
        for i in np.unique(x).tolist():
            if not taken[i]:
                near = y[x == i]
                near = near[~taken[near]]
                found.append((np.full(len(near), rest[i]), rest[near]))
                taken[near] = True
        taken[:head] = True
        rest = rest[~taken]
    return found


def _linked(percent: int) -> object:
    """Of rows (a, salt, b, set), where the row of a itself comes first (b null), the pairs that link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leader, u = None, np.empty(0, np.uint64)
        for batch in batches:
            left, right = [], []
            for a, salt, b, raw in zip(*(batch.column(c).to_pylist() for c in ("a", "salt", "b", "set")), strict=True):
                own = np.frombuffer(raw, np.uint64)
                if b is None:
                    leader, u = (a, salt), own.copy()
                elif leader == (a, salt):
                    small, large = (own, u) if len(own) <= len(u) else (u, own)
                    at = np.searchsorted(large, small)
                    common = int((large[np.minimum(at, len(large) - 1)] == small).sum())
                    if 100 * common >= percent * (len(own) + len(u) - common):
                        left.append(a)
                        right.append(b)
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["a", "b"])

    return run


class _Join:
    """The steps of the join over one table; ``jaccard_components`` tells them."""

    def __init__(self, docs: DataFrame, k: int, percent: int, id_col: str, text_col: str):
        self.k, self.percent = k, percent
        self.rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        digest = F.xxhash64(F.col("text"), F.length("text"))
        told = cut(self.rows.select("doc_id", digest.alias("digest"), "text").mapInArrow(_stats(k, percent), "doc_id long, digest long, n long, cls long, chk long, sketch binary"))
        worded = told.where("n > 0")
        # Different sets with one 64-bit hash are expected ten times in 2 * 10^10 sets.
        clash = worded.groupBy("cls").agg(F.min("chk").alias("lo"), F.max("chk").alias("hi")).where("lo <> hi").select("cls").collect()
        self.clashes = frozenset(r["cls"] for r in clash)
        cls = F.when(F.col("cls").isin(list(self.clashes)), F.col("cls").bitwiseXOR("chk")).otherwise(F.col("cls")) if clash else F.col("cls")
        self.stats = told.withColumn("cls", cls).drop("chk", "sketch")
        self.classes = cut(told.where("n > 0").withColumn("cls", cls).groupBy("cls").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))

    def buckets(self) -> DataFrame:
        """key, cls, m: the keys that several classes share, and how many do."""
        keyed = self.rows.select("text").mapInArrow(_keys(self.k, self.percent, self.clashes), "key long, cls long")
        order, whole = Window.partitionBy("key").orderBy("cls"), Window.partitionBy("key")
        beside = F.coalesce(F.lag("cls").over(order) != F.col("cls"), F.lit(False)) | F.coalesce(F.lead("cls").over(order) != F.col("cls"), F.lit(False))
        shared = keyed.withColumn("beside", beside).where("beside").select("key", "cls").distinct()
        return cut(shared.withColumn("m", F.count(F.lit(1)).over(whole)))

    def candidates(self, buckets: DataFrame, every: bool, comps: DataFrame | None = None) -> DataFrame:
        rows = buckets.join(self.classes.select("cls", "n", "sketch"), "cls")
        if comps is not None:
            rows = rows.join(comps, F.col("cls") == F.col("node"), "left")
        comp = F.col("cls") if comps is None else F.coalesce("component", "cls")
        blocks = F.ceil(F.col("m") / BLOCK).cast("int")
        dealt = (
            rows.select("key", "cls", "n", "sketch", comp.alias("comp"), F.pmod(F.xxhash64("cls"), blocks).cast("int").alias("block"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
            .select("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "cls", "n", "comp", "sketch")
            .repartition("key", "i", "j")
            .sortWithinPartitions("key", "i", "j")
        )
        return dealt.mapInArrow(_candidates(self.percent, every), "a long, b long").distinct()

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose whole sets link."""
        need = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
        named = self.classes.select("cls", "least").join(need, "cls", "left_semi")
        texts = self.rows.join(named, F.col("doc_id").eqNullSafe(F.col("least"))).select("cls", "text")
        # Rows that repeat an id and a text give a set several times.
        sets = cut(texts.mapInArrow(_sets(self.k, self.clashes), "cls long, set binary").dropDuplicates(["cls"]))
        # One row for each leader of more than FOLLOWERS pairs: a small share of the pairs.
        hot = pairs.groupBy("a").count().where(F.col("count") > FOLLOWERS).select(F.col("a").alias("hot"), F.ceil(F.col("count") / FOLLOWERS).cast("int").alias("salts"))
        salted = pairs.join(F.broadcast(hot), F.col("a") == F.col("hot"), "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
        followers = salted.join(sets, F.col("b") == F.col("cls")).select("a", F.pmod(F.xxhash64("b"), F.col("salts")).cast("int").alias("salt"), "b", "set")
        leaders = salted.select("a", "salts").distinct().join(sets, F.col("a") == F.col("cls")).select("a", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("b"), "set")
        met = leaders.unionByName(followers).repartition("a", "salt").sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())
        return met.mapInArrow(_linked(self.percent), "a long, b long")

    def links(self) -> DataFrame:
        """All pairs (a, b) of classes that link, a < b."""
        return cut(self.verified(cut(self.candidates(self.buckets(), True))))

    def groups(self) -> DataFrame:
        """node, component of the classes that link with others."""
        buckets = self.buckets()
        release(self.rows.sparkSession)
        tried = cut(self.candidates(buckets, False))
        release(self.rows.sparkSession)
        linked = cut(self.verified(tried))
        comps = components(linked)
        if buckets.where(F.col("m") > SMALL).limit(1).count():
            rest = self.candidates(buckets.where(F.col("m") > SMALL), True, comps).join(tried, ["a", "b"], "left_anti")
            more = cut(self.verified(cut(rest)))
            if more.limit(1).count():
                comps = components(comps.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
        release(self.rows.sparkSession)
        return comps

    def grouped(self) -> DataFrame:
        """doc_id, digest, n, cls, component (of classes; null without words), least of the class."""
        found = self.groups().select(F.col("node").alias("cls"), "component")
        known = self.classes.select("cls", "least").join(found, "cls", "left").select(F.col("cls").alias("k_cls"), "least", F.coalesce("component", "cls").alias("component"))
        return self.stats.join(known, (F.col("cls") == F.col("k_cls")) & (F.col("n") > 0), "left").drop("k_cls")


def jaccard_components(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, class_doc_id by row.

    Two documents link when the Jaccard similarity of their sets of distinct k-word shingles
    (A-Z in lower case; all words where there are fewer than k) is percent / 100 or more. No link
    is lost: sets are held as 64-bit hashes of their shingles, all comparisons are exact.

    1. Equal sets become one class (class_id, its least doc_id class_doc_id), which has a parity
       sketch: each element flips one of about twice as many bits as the set may have elements.
    2. Each class's set is cut by hash into parts, d + 1 and a few, where d is the greatest
       difference that similar sets of its size band can have; the XOR of a part's hashes is its
       word. Of two similar sets one part at least is equal (``keys_of``), so its word is, and
       the classes that share a word are a bucket.
    3. In a bucket sizes and the Hamming distance of sketches, at most the symmetric difference,
       rule pairs out before any set is moved. Buckets above ``SMALL`` are searched by leaders
       first, so a family of n alike texts gives about n pairs; those above ``BLOCK`` are dealt
       out by pairs of blocks. The pairs left are compared by their whole sets.
    4. Components of the links. Then the large buckets are gone through again for pairs of
       different components, and those are compared as well: no pair that shares a bucket, passes
       its sketch and isn't connected already is left out.

    Null and empty texts have n_shingles 0 and are their own component, as is a row with null id
    for itself. Rows that repeat an id count each. An empty table gives no rows. Other columns
    are not looked at.
    """
    rows = _Join(docs, k, percent, id_col, text_col).grouped()
    least = rows.where("n > 0").groupBy(F.col("component").alias("of")).agg(F.min("least").alias("component_id"))
    return rows.join(least, F.col("component") == F.col("of"), "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"),
        F.col("cls").alias("class_id"),
        F.coalesce("least", "doc_id").alias("class_doc_id"),
    )


def jaccard_links(docs: DataFrame, k: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The join itself: all links, not only those that connect components.

    First (class_a, class_b), class_a < class_b: the pairs of different sets that link. Second by
    row doc_id, class_id, n_shingles, n_links: the other rows that it links with, those of its own
    class (equal sets) and those of linked classes; rows without words have none. Rows as
    ``jaccard_components`` takes them. All pairs of a bucket that pass their sketches are
    compared here, so a family of n alike texts costs up to n * n / 2 rows: those are the result.
    """
    join = _Join(docs, k, percent, id_col, text_col)
    pairs = join.links()
    size = join.stats.where("n > 0").groupBy(F.col("cls").alias("of")).agg(F.count(F.lit(1)).alias("rows"))
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(pairs.select(F.col("b").alias("x"), F.col("a").alias("y")))
    beside = ends.join(size, F.col("y") == F.col("of")).groupBy("x").agg(F.sum("rows").alias("others"))
    every = size.join(beside, F.col("of") == F.col("x"), "left").select("of", (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    rows = join.stats.join(every, (F.col("cls") == F.col("of")) & (F.col("n") > 0), "left")
    return pairs.select(F.col("a").alias("class_a"), F.col("b").alias("class_b")), rows.select("doc_id", F.col("cls").alias("class_id"), F.col("n").alias("n_shingles"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def first_of_each(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are the first of their component, all columns: the least id, null
    ids last, and the least digest of the text where near copies share an id.

    Rows are told apart by id and text: those that repeat both are one document and stay or go
    together. Texts without words stay.
    """
    rows = _Join(docs, k, percent, id_col, text_col).grouped().where("n > 0")
    place = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("digest").alias("digest"))
    first = rows.groupBy(F.col("component").alias("of")).agg(F.min(place).alias("first"), F.max(place).alias("last")).where(F.col("first") < F.col("last"))
    gone = cut(rows.join(first, F.col("component") == F.col("of")).where(place > F.col("first")).select(F.col("doc_id").alias("_gone_id"), F.col("digest").alias("_gone_digest")).distinct())
    release(docs.sparkSession)
    return docs.join(gone, F.col(id_col).cast("long").eqNullSafe(F.col("_gone_id")) & (F.xxhash64(F.col(text_col), F.length(text_col)) == F.col("_gone_digest")), "left_anti")


SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 3 THEN list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i:i + 2], ' '))
                                      WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, min(r.b) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN r ON r.a = w.doc_id GROUP BY w.doc_id, n.n
"""
