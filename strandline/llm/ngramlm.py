"""Operator 9: score texts with a Brown class bigram model learnt from all training documents."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel
from .common import crc32_mod, cut

#: Words whose counts and classes every task holds; all others meet theirs in a join.
HEAD_WORDS = 1 << 18
#: Classes, and the most frequent words that exchange clustering deals into them, at least: both
#: grow with the vocabulary (``_sizes``). All other words are placed by their neighbours.
CLUSTERED_WORDS, CLUSTERS = 1024, 64
SMOOTH = 0.1
SWEEPS = 12
_END = np.uint64(0x0E0D0E0D0E0D0E0D)
_MERGE_AT = 4_000_000
_BLOCK = 20_000


def _unique_sum(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fresh: list[np.ndarray] = []
    keys, counts, waiting = np.empty(0, np.uint64), np.empty(0, np.int64), 0

    def merged():
        u, c = np.unique(np.concatenate(fresh), return_counts=True) if fresh else (np.empty(0, np.uint64), np.empty(0, np.int64))
        k, n = np.concatenate([keys, u]), np.concatenate([counts, c])
        return _unique_sum(k, n) if len(k) else (k, n)

    def out(k, c):
        return pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(c.astype(np.int64))], names=["w", "c"])

    for batch in batches:
        for lo, hi, h, _ in textkernel.words(batch.column(0).to_pylist()):
            fresh += [h, np.full(hi - lo, _END)]
            waiting += len(h) + hi - lo
            if waiting > _MERGE_AT:
                keys, counts = merged()
                fresh, waiting = [], 0
                if len(keys) > _MERGE_AT:  # memory stays bounded; the sum after the shuffle is the same
                    yield out(keys, counts)
                    keys, counts = keys[:0], counts[:0]
    keys, counts = merged()
    if len(keys):
        yield out(keys, counts)


def _sizes(n_distinct: int) -> tuple[int, int]:
    """(words to cluster by exchange, classes) for a vocabulary: its fourth root, twice."""
    clusters = max(CLUSTERS, int(np.ceil(2 * n_distinct**0.25)))
    return CLUSTERED_WORDS * clusters // CLUSTERS, clusters


class Symbols:
    """Maps word hashes to symbols; words that aren't among ``words`` have ``other``."""

    def __init__(self, words: np.ndarray, symbol: np.ndarray, other: int, end: int, counts: np.ndarray | None = None):
        order = np.argsort(words)
        self.words, self.symbol, self.other, self.end = words[order], symbol[order].astype(np.int32), other, end
        self.counts = None if counts is None else counts[order]

    def find(self, h: np.ndarray) -> np.ndarray:
        """Places among the words, -1 for others."""
        if not len(self.words):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.words, h), len(self.words) - 1)
        return np.where(self.words[at] == h, at, -1)

    def sequence(self, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of all rows, each with its end, and where each word stands in them."""
        rows = len(first) - 1
        at = np.arange(len(place)) + np.repeat(np.arange(rows), np.diff(first))
        seq = np.full(len(place) + rows, self.end, dtype=np.int32)
        seq[at] = np.where(place >= 0, self.symbol[place] if len(self.symbol) else self.other, self.other)
        return seq, at


def _cells(total: np.ndarray) -> pa.RecordBatch:
    cells = np.flatnonzero(total)
    return pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int64)), pa.array(total[cells])], names=["cell", "n"])


def _grid(cells: DataFrame, size: int) -> np.ndarray:
    found = cells.groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    grid = np.zeros(size * size)
    grid[found["cell"].to_numpy()] = found["n"].to_numpy()
    return grid.reshape(size, size)


def _pair_counts(symbols) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = symbols.value
        size = s.end + 1
        total = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            for _, _, h, first in textkernel.words(batch.column(0).to_pylist()):
                seq, _ = s.sequence(s.find(h), first)
                before = np.concatenate([[s.end], seq[:-1]])
                total += np.bincount(before.astype(np.int64) * size + seq, minlength=len(total))
        yield _cells(total)

    return run


def _summed(w: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts by word and code, in their order."""
    order = np.lexsort((code, w))
    w, code, n = w[order], code[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (code[1:] != code[:-1])]))
    return w[new], code[new], np.add.reduceat(n, new)


def _starts(w: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))


def _neighbours(symbols) -> object:
    """Of each word that isn't clustered, how often each class stands before (code: the class) and
    behind it (code: the number of classes and the class), packed as pairs of code and count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = symbols.value
        size = s.end + 1
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def out():
            w, code = (np.concatenate(x) for x in zip(*held, strict=True))
            w, code, n = _summed(w.view(np.int64), code, np.ones(len(w), np.int64))
            new = _starts(w)
            packed = np.stack([code, n], 1).astype(np.int32)
            off = (np.append(new, len(w)) * 8).astype(np.int32)
            v = pa.BinaryArray.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(packed.tobytes())])
            return pa.RecordBatch.from_arrays([pa.array(w[new]), v], names=["w", "v"])

        for batch in batches:
            for _, _, h, first in textkernel.words(batch.column(0).to_pylist()):
                place = s.find(h)
                seq, at = s.sequence(place, first)
                before = np.concatenate([[s.end], seq[:-1]])
                own = place < 0
                at, h = at[own], h[own]
                if len(h):
                    held += [(h, before[at]), (h, size + seq[at + 1])]
                    waiting += 2 * len(h)
                if waiting > _MERGE_AT:
                    yield out()
                    held, waiting = [], 0
        if held:
            yield out()

    return run


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


class Placement:
    """The best class of words outside the clustered ones: that whose class bigram likelihood rises
    most when the word joins it, by the exchange's own gain over the clustered words' grid."""

    def __init__(self, grid: np.ndarray, k: int):
        self.size, self.k = len(grid), k
        self.table = np.concatenate([grid[:, :k], grid.T[:, :k]])
        self.logs = _xlogx(self.table)
        self.once = _xlogx(self.table + 1) - self.logs
        self.rows, self.cols = grid[:k].sum(1), grid[:, :k].sum(0)

    def best(self, start: np.ndarray, code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(count, class) of the words whose codes and counts begin at ``start``."""
        part = self.once[code]
        many = np.flatnonzero(n > 1)
        part[many] = _xlogx(self.table[code[many]] + n[many, None]) - self.logs[code[many]]
        gain = np.add.reduceat(part, start)
        count = np.add.reduceat(np.where(code < self.size, n, 0), start)
        each, back = np.unique(count, return_inverse=True)
        x = each[:, None].astype(np.float64)
        own = _xlogx(self.rows + x) - _xlogx(self.rows) + _xlogx(self.cols + x) - _xlogx(self.cols)
        return count, np.argmax(gain - own[back], axis=1).astype(np.int32)


def _place(placement) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = placement.value
        rest = None

        def out(w, code, n):
            w, code, n = _summed(w, code, n)
            start = _starts(w)
            edge = np.append(start, len(w))
            lo = 0
            while lo < len(start):
                hi = max(lo + 1, int(np.searchsorted(edge, edge[lo] + _BLOCK, side="right")) - 1)
                own = slice(edge[lo], edge[hi])
                count, cls = p.best(start[lo:hi] - edge[lo], code[own], n[own])
                yield pa.RecordBatch.from_arrays([pa.array(w[start[lo:hi]]), pa.array(count), pa.array(cls)], names=["w", "c", "cls"])
                lo = hi

        for batch in batches:
            v = batch.column(1)
            if not len(v):
                continue
            off = np.frombuffer(v.buffers()[1], np.int32)[v.offset : v.offset + len(v) + 1]
            pair = np.frombuffer(v.buffers()[2], np.uint8)[off[0] : off[-1]].view(np.int32).reshape(-1, 2)
            own = (np.repeat(batch.column(0).to_numpy(), np.diff(off) // 8), pair[:, 0].astype(np.int64), pair[:, 1].astype(np.int64))
            w, code, n = own if rest is None else (np.concatenate(x) for x in zip(rest, own, strict=True))
            last = int(np.searchsorted(w, w[-1]))  # the last word may go on in the next batch
            if last:
                yield from out(w[:last], code[:last], n[:last])
            rest = tuple(x.copy() for x in (_summed(w[last:], code[last:], n[last:])))
        if rest is not None:
            yield from out(*rest)

    return run


def exchange_classes(pairs: np.ndarray, clustered: int, clusters: int = CLUSTERS, sweeps: int = SWEEPS) -> np.ndarray:
    """The class of each symbol: exchange clustering of the first ``clustered`` symbols.

    Each symbol in turn moves to the class that raises the class bigram likelihood most, until a
    sweep moves none. Symbols that aren't clustered are classes of their own.
    """
    size, k = len(pairs), min(clusters, max(clustered, 1))
    cls = np.concatenate([np.arange(clustered) % k, k + np.arange(size - clustered)]).astype(np.int64)
    n = int(cls.max()) + 1 if size else 0

    def f(x):
        return x * np.log(np.maximum(x, 1))

    hot = np.zeros((size, n))
    hot[np.arange(size), cls] = 1
    grid = hot.T @ pairs @ hot
    for _ in range(sweeps):
        moved = 0
        for w in range(clustered):
            a, own = cls[w], pairs[w, w]
            left, right = hot.T @ pairs[:, w], pairs[w] @ hot
            left[a] -= own
            right[a] -= own
            nl, nr = left.sum() + own, right.sum() + own
            grid[:, a] -= left
            grid[a] -= right
            grid[a, a] -= own
            # Links with w stay in the sums of the others' classes wherever w goes.
            rows, cols, diag = grid[:k].sum(1) + left[:k], grid[:, :k].sum(0) + right[:k], np.diag(grid)[:k]
            gain = (f(grid[:, :k] + left[:, None]) - f(grid[:, :k])).sum(0) + (f(grid[:k] + right[None]) - f(grid[:k])).sum(1)
            gain += f(diag + left[:k] + right[:k] + own) - f(diag) - (f(diag + left[:k]) - f(diag)) - (f(diag + right[:k]) - f(diag))
            gain -= f(rows + nr) - f(rows) + f(cols + nl) - f(cols)
            b = int(np.argmax(gain))
            b = int(a) if gain[b] <= gain[a] + 1e-9 else b
            grid[:, b] += left
            grid[b] += right
            grid[b, b] += own
            hot[w, a], hot[w, b], cls[w] = 0, 1, b
            moved += b != a
        if not moved:
            break
    return cls


class ClassModel:
    """log10 tables: class transition by class pair, emission by class and count. The last two
    classes are the end's and that of words the training corpus doesn't have."""

    def __init__(self, grid: np.ndarray, words: np.ndarray, mass: np.ndarray):
        n = len(grid)
        alone = (grid.sum(0) + SMOOTH) / (grid.sum() + SMOOTH * n)
        # A prior of n pseudo-counts spread by class frequency.
        self.step = np.log10((grid + n * alone[None]) / (grid.sum(1, keepdims=True) + n))
        self.emit_base = np.log10(mass + SMOOTH * np.maximum(words, 1))
        self.emit_base[n - 2] = 0


def _packed(values: np.ndarray, first: np.ndarray) -> pa.Array:
    """Each row's values as bytes."""
    off = (first * values.itemsize).astype(np.int32)
    return pa.BinaryArray.from_buffers(pa.binary(), len(first) - 1, [None, pa.py_buffer(off.tobytes()), pa.py_buffer(values.tobytes())])


def _unpacked(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(values of all rows, where each row's begin)."""
    off = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    values = np.frombuffer(raw, np.uint8)[off[0] : off[-1]].view(kind) if raw and off[-1] > off[0] else np.empty(0, kind)
    return values, (off - off[0]) // np.dtype(kind).itemsize


_TAIL = -1


def _classes(head) -> object:
    """Rows as sequences of classes; words outside the head stay ``_TAIL``, listed in ``tw`` once a
    row and by their places there in ``ti``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = head.value
        logs = np.log10(s.counts + SMOOTH)
        for batch in batches:
            ids, held = batch.column(0), batch.column(1)
            for lo, hi, h, first in textkernel.words(batch.column(2).to_pylist()):
                rows = hi - lo
                place = s.find(h)
                seq, _ = s.sequence(place, first)
                known, wrow = place >= 0, np.repeat(np.arange(rows), np.diff(first))
                base = np.bincount(wrow[known], weights=logs[place[known]], minlength=rows)
                trow, th = wrow[~known], h[~known]
                order = np.lexsort((th, trow))
                srow, sh = trow[order], th[order]
                new = np.concatenate([[True], (sh[1:] != sh[:-1]) | (srow[1:] != srow[:-1])]) if len(th) else np.empty(0, bool)
                off = np.searchsorted(srow[new], np.arange(rows + 1)).astype(np.int32)
                ti = np.empty(len(th), np.int32)
                ti[order] = np.cumsum(new) - 1 - off[srow]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, rows), held.slice(lo, rows), pa.array(np.diff(first) + 1, pa.int64()), pa.array(np.bincount(wrow[known], minlength=rows).astype(np.int64)), pa.array(base),
                        _packed(seq.astype(np.int16), first + np.arange(rows + 1)), _packed(ti, np.searchsorted(trow, np.arange(rows + 1))),
                        pa.ListArray.from_arrays(pa.array(off), pa.array(sh[new].view(np.int64))),
                    ],
                    names=["doc_id", "held_out", "n_tokens", "known", "base", "seq", "ti", "tw"],
                )

    return run


def _resolve(unknown: int) -> object:
    """Put the joined classes of tail words in their places and add up their counts' logs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            known, base = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("known", "base"))
            seq, first = _unpacked(batch.column("seq"), np.int16)
            ti, _ = _unpacked(batch.column("ti"), np.int32)
            size = batch.column("nt").to_numpy().astype(np.int64)
            begin = np.cumsum(size) - size
            cls, count = np.full(int(size.sum()), unknown, np.int16), np.zeros(int(size.sum()))
            m = batch.column("m")
            met, row = m.flatten(), np.repeat(np.arange(len(m)), m.value_lengths().fill_null(0).to_numpy())
            at = begin[row] + met.field("i").to_numpy()
            cls[at], count[at] = met.field("cls").to_numpy(), met.field("c").to_numpy()
            seq, hole = seq.copy(), np.flatnonzero(seq == _TAIL)
            row = np.searchsorted(first, hole, side="right") - 1
            at = begin[row] + ti
            seq[hole] = cls[at]
            base += np.bincount(row, weights=np.log10(count[at] + SMOOTH), minlength=len(base))
            known += np.bincount(row, weights=count[at] > 0, minlength=len(base)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), batch.column("n_tokens"), pa.array(known), pa.array(base), _packed(seq, first)], names=["doc_id", "held_out", "n_tokens", "known", "base", "seq"]
            )

    return run


def _class_pairs(size: int) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size * size, dtype=np.int64)
        for batch in batches:
            if batch.num_rows:
                seq = _unpacked(batch.column(0), np.int16)[0].astype(np.int64)
                total += np.bincount(np.concatenate([[size - 2], seq[:-1]]) * size + seq, minlength=len(total))
        yield _cells(total)

    return run


def _score(model) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            if not batch.num_rows:
                continue
            seq, first = _unpacked(batch.column("seq"), np.int16)
            before = np.concatenate([[len(m.step) - 2], seq[:-1]])
            total = batch.column("base").to_numpy() + np.add.reduceat(m.step[before, seq] - m.emit_base[seq], first[:-1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "held_out", "n_tokens", "known", "base")), pa.array(total)], names=["doc_id", "held_out", "n_tokens", "known", "base", "score"])

    return run


def _head(counts: DataFrame) -> DataFrame:
    """The most frequent words, at most ``HEAD_WORDS``: all whose count is in one of the top steps.

    Counts are grouped in steps of three leading digits, of which there are few thousand whatever
    the corpus, so that the bound is found without sorting words or sending more of them than it.
    """
    scale = F.pow(F.lit(10.0), F.greatest(F.floor(F.log10(F.col("c") + 0.5)) - 2, F.lit(0)))
    step = (F.floor(F.col("c") / scale) * scale).cast("long")
    room, least = HEAD_WORDS, None
    for r in sorted(counts.groupBy(step.alias("step")).count().collect(), key=lambda r: -r["step"]):
        room -= r["count"]
        if room < 0:
            break
        least = r["step"]
    return counts.where(F.lit(False)) if least is None else counts.where(step >= least)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", fold: int = 10, held: int = 0) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity by row.

    Documents whose crc32(id) mod ``fold`` is not ``held`` are the training corpus; all of them
    are counted, in full. base_score is the additively smoothed unigram log10 probability. score is
    the class bigram model's: log10 P(class | class before) + log10 P(word | class), smoothed.

    Every training word has a class. Exchange clustering deals the most frequent words into
    classes, more of both for a larger vocabulary (``_sizes``); each other word then joins the
    class that its neighbours' classes favour most (``Placement``). Transitions are counted over
    the classes of all words. A word that no training document has is in a class of its own.

    Counts and classes of all words live in a table; the ``HEAD_WORDS`` most frequent go to every
    task, and the rest meet theirs in a join, so memory is bounded whatever the vocabulary and
    the result is the same for any bound. Words are told apart by 64-bit hashes.

    Null texts are empty (one token, the end); a null id counts as the id ''. Repeated rows are
    counted and scored each. Without training documents all counts are 0. Other columns are not
    looked at.
    """
    sc = docs.sparkSession.sparkContext
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), (crc32_mod(id_col, fold) == held).alias("held_out"), F.col(text_col).alias("text"))
    train = rows.where(~F.col("held_out")).select("text")
    counts = cut(train.mapInArrow(_count_words, "w long, c long").groupBy("w").agg(F.sum("c").alias("c")))
    end = int(_END.view(np.int64))
    total = counts.agg(F.sum("c"), F.count(F.lit(1))).first()
    n_tokens, n_distinct = int(total[0] or 0), int(total[1])
    clustered, clusters = _sizes(n_distinct)
    top = counts.where(F.col("w") != end).orderBy(F.desc("c"), "w").limit(clustered).toPandas()
    words, freq = top["w"].to_numpy(np.int64).view(np.uint64), top["c"].to_numpy(np.int64)
    ends = counts.where(F.col("w") == end).agg(F.sum("c")).first()[0] or 0
    # Symbols: the clustered words, all other words, the end.
    n = len(words)
    pairs = _grid(train.mapInArrow(_pair_counts(sc.broadcast(Symbols(words, np.arange(n), n, n + 1))), "cell long, n long"), n + 2)
    cls = exchange_classes(pairs, n, clusters)
    k = min(clusters, max(n, 1))
    hot = np.zeros((n + 2, k + 2))
    hot[np.arange(n + 2), cls] = 1
    near = train.mapInArrow(_neighbours(sc.broadcast(Symbols(words, cls[:n], k, k + 1))), "w long, v binary").repartition("w").sortWithinPartitions("w")
    placed = cut(near.mapInArrow(_place(sc.broadcast(Placement(hot.T @ pairs @ hot, k))), "w long, c long, cls int"))
    # Classes from here on: those of words, the end, words not in the training corpus.
    more = _head(placed).toPandas()
    head = Symbols(
        np.concatenate([words, more["w"].to_numpy(np.int64).view(np.uint64)]), np.concatenate([cls[:n], more["cls"].to_numpy(np.int64)]), _TAIL, k, np.concatenate([freq, more["c"].to_numpy(np.int64)])
    )
    size, mass = np.bincount(cls[:n], minlength=k + 2).astype(float), np.bincount(cls[:n], weights=freq, minlength=k + 2)
    for r in placed.groupBy("cls").agg(F.count(F.lit(1)).alias("n"), F.sum("c").alias("c")).collect():
        size[r["cls"]] += r["n"]
        mass[r["cls"]] += r["c"]
    told = cut(
        rows.mapInArrow(_classes(sc.broadcast(head)), "doc_id long, held_out boolean, n_tokens long, known long, base double, seq binary, ti binary, tw array<long>")
        .withColumn("row", F.monotonically_increasing_id())
    )
    tail = told.select("row", F.posexplode("tw").alias("i", "w"))
    met = tail.join(placed, "w").groupBy("row").agg(F.collect_list(F.struct("i", "c", "cls")).alias("m"))
    whole = cut(
        told.withColumn("nt", F.size("tw")).drop("tw").join(met, "row", "left").drop("row")
        .mapInArrow(_resolve(k + 1), "doc_id long, held_out boolean, n_tokens long, known long, base double, seq binary")
    )
    grid = _grid(whole.where(~F.col("held_out")).select("seq").mapInArrow(_class_pairs(k + 2), "cell long, n long"), k + 2)
    model = sc.broadcast(ClassModel(grid, size, mass))
    norm = float(np.log10(n_tokens + SMOOTH * (n_distinct + 1)))
    out = whole.mapInArrow(_score(model), "doc_id long, held_out boolean, n_tokens long, known long, base double, score double").select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + int(ends > 0)).cast("long").alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("base") + float(np.log10(ends + SMOOTH)) - F.col("n_tokens") * norm).alias("base_score"),
        "score",
    )
    return out.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
