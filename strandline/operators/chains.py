"""Chains: hits and seeds that follow one another on both sides, and the anchors of two paths.

Dynamic programs over a group's rows need them in order and look back a bounded way. A group is first
parted, by a window, where nothing can reach across; the parts are sorted within partitions and go
through Python by Arrow batches, so that no call is made for each group.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stretches(rows: DataFrame, keys: list[str], beg: str, end: str, reach: int) -> DataFrame:
    """``rows`` with _part: its number changes where a row begins more than ``reach`` after all rows
    before it in its group have ended."""
    order = Window.partitionBy(*keys).orderBy(beg, end)
    before = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = rows.withColumn("_new", (before.isNull() | (F.col(beg) > before + reach)).cast("long"))
    return marked.withColumn("_part", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_new")


def by_group(rows: DataFrame, keys: list[str], order: list, fold: Callable[[list[dict]], list[dict]], schema: str) -> DataFrame:
    """What ``fold`` makes of each group's rows, in order. Groups follow one another in sorted
    partitions; one that a batch ends in is kept until the next."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                own = tuple(row[k] for k in keys)
                if own != key and group:
                    out += fold(group)
                    group = []
                key = own
                group.append(row)
            if out:
                yield pa.RecordBatch.from_pylist(out, schema=arrow)
        if group:
            yield pa.RecordBatch.from_pylist(fold(group), schema=arrow)

    return rows.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(run, schema)


# ---- hits ----------------------------------------------------------------------------------------


def _gaps(a: dict, b: dict) -> tuple[int, int]:
    """What lies between hit a and a later hit b, on the query and on the target."""
    return b["qbeg"] - a["qend"], (a["beg"] - b["end"]) if b["rev"] else (b["beg"] - a["end"])


def _diagonal(h: dict) -> int:
    return h["end"] + h["qbeg"] if h["rev"] else h["beg"] - h["qbeg"]


def chain_hits(rows: list[dict], look_back: int, max_gap: int, max_shift: int, cost: float, least: int) -> list[dict]:
    """Boxes of the chains of one query, contig and strand; rows in order (see ``hit_chains``)."""
    value = [max(h["qend"] - h["qbeg"], least) for h in rows]
    before: list[list[tuple[int, int]]] = []  # (earlier hit, what the step to it costs), nearest first
    root = list(range(len(rows)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, h in enumerate(rows):
        own = []
        for j in range(i - 1, max(i - look_back, 0) - 1, -1):
            q, t = _gaps(rows[j], h)
            if not (0 <= q <= max_gap and 0 <= t <= max_gap) or (q and t and abs(_diagonal(h) - _diagonal(rows[j])) > max_shift):
                continue
            price = cost * (q + t) if q and t else 0.1 * math.sqrt(q + t)
            own.append((j, math.floor(price + 0.5)))
            root[find(i)] = find(j)
        before.append(own)

    linked: dict[int, list[int]] = {}
    for i in range(len(rows)):
        linked.setdefault(find(i), []).append(i)
    boxes = []
    for left in linked.values():
        while left:
            total, via, live = {}, {}, set(left)
            for i in left:
                total[i], via[i] = value[i], None
                for j, price in before[i]:
                    if j in live and total[j] + value[i] - price > total[i]:
                        total[i], via[i] = total[j] + value[i] - price, j
            i = max(left, key=lambda n: (total[n], -n))
            chain = []
            while i is not None:
                chain.append(i)
                i = via[i]
            of = [rows[i] for i in chain]
            boxes.append({**of[0], "qbeg": min(h["qbeg"] for h in of), "qend": max(h["qend"] for h in of), "beg": min(h["beg"] for h in of), "end": max(h["end"] for h in of)})
            gone = set(chain)
            left = [i for i in left if i not in gone]
    return boxes


def hit_chains(hits: DataFrame, look_back: int = 10, max_gap: int = 20_000, max_shift: int = 500, cost: float = 0.1, least: int = 30) -> DataFrame:
    """query_id, rev, ctg, qbeg, qend, beg, end: boxes round chains of hits (same columns).

    Hits of a query, contig and strand in the order of the query may follow one another when they
    overlap on neither side, both gaps are at most ``max_gap`` and, where both are above 0, the
    diagonals differ by at most ``max_shift``; only the ``look_back`` hits before count. A hit is
    worth its length on the query (``least`` at least), a step costs ``cost`` for each base of
    both gaps, or a tenth of the root where one of them is 0, rounded. The best chain is taken, then
    the best of what is left, until nothing is; taken hits still count in the look-back. Equal
    chains: the one that ends first; equal steps: the nearest hit.
    """
    keys = ["query_id", "ctg", "rev", "_part"]
    kept = hits.select("query_id", "rev", "ctg", "qbeg", "qend", "beg", "end")
    parted = stretches(kept, keys[:3], "qbeg", "qend", max_gap).withColumn("_side", F.when(F.col("rev"), F.col("end")).otherwise(F.col("beg")))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kept.schema)
    names = kept.columns
    fold = lambda rows: [{c: b[c] for c in names} for b in chain_hits(rows, look_back, max_gap, max_shift, cost, least)]
    return by_group(parted, keys, ["qbeg", "qend", "_side", "beg", "end"], fold, schema)


# ---- seeds ---------------------------------------------------------------------------------------

#: Chaining presets. bw: greatest shift of diagonals; pen: price of a shifted base.
BASE = {"bw": 500, "max_skip": 25, "max_iter": 500, "max_dist": 50_000, "min_cnt": 3, "min_sc": 40, "pen_gap": 0.8, "pen_skip": 0.0}
PRESETS = {
    "base": BASE,
    "hifi": {**BASE, "bw": 10, "pen_gap": 5.0},
    "ont": {**BASE, "bw": 10, "pen_gap": 5.0},
    "illumina": {**BASE, "bw": 10, "pen_gap": 4.0},
    "other": {**BASE, "bw": 500, "pen_gap": 5.0},
    "asm5": {**BASE, "bw": 20_000, "max_dist": 30_000, "max_iter": 100_000, "max_skip": 500, "min_sc": 10, "pen_gap": 3.0},
}


def step_score(dq: int, dr: int, k: int, o: dict) -> int | None:
    """What a seed adds that lies dq further on the query and dr on the reference; None: not allowed."""
    shift, near = abs(dr - dq), min(dr, dq)
    if not 0 < dq <= o["max_dist"] or dr == 0 or shift > o["bw"]:
        return None
    gain = min(k, near)
    if shift or near > k:
        gain -= int(o["pen_gap"] * shift + o["pen_skip"] * near + 0.5 * (math.floor(math.log2(shift + 1)) if shift else 0))
    return gain


def best_links(at: list[tuple[int, int]], k: int, o: dict) -> tuple[list[int], list[int]]:
    """Of seeds (r_pos, q_pos) in order: the best score of a chain that ends in each, and the seed before
    it (-1: none). The search looks back over ``max_dist`` and ``max_iter`` seeds, nearest
    first, and stops after ``max_skip`` that are passed over although they lead to one already
    seen; the best seed in reach is tried even so."""
    score, via = [], []
    low, top = 0, -1
    seen = [-1] * len(at)
    for i, (r, q) in enumerate(at):
        while at[low][0] + o["max_dist"] < r:
            low += 1
        low = max(low, i - o["max_iter"])
        best, link, idle, j = k, -1, 0, i - 1
        while j >= low:
            gain = step_score(q - at[j][1], r - at[j][0], k, o)
            if gain is not None:
                if gain + score[j] > best:
                    best, link, idle = gain + score[j], j, max(idle - 1, 0)
                elif seen[j] == i:
                    idle += 1
                    if idle > o["max_skip"]:
                        break
                if via[j] >= 0:
                    seen[via[j]] = i
            j -= 1
        if top < 0 or at[top][0] + o["max_dist"] < r:
            top = max(range(i - 1, low - 1, -1), key=score.__getitem__, default=-1)
        if 0 <= top < j:
            gain = step_score(q - at[top][1], r - at[top][0], k, o)
            if gain is not None and gain + score[top] > best:
                best, link = gain + score[top], top
        score.append(best)
        via.append(link)
        if top < 0 or (r - at[top][0] <= o["max_dist"] and score[top] < best):
            top = i
    return score, via


def walk_back(score: list[int], via: list[int], o: dict) -> list[tuple[int, list[int]]]:
    """(score, seeds in order) of the chains, from the highest end down (ties: the later seed). A chain
    goes back to seeds that are free, and ends where its score is greatest once it has dropped
    by more than ``bw``."""
    taken, found = [False] * len(score), []
    for end in sorted((i for i in range(len(score)) if score[i] >= o["min_sc"]), key=lambda i: (-score[i], -i)):
        if taken[end]:
            continue
        way, best, stop, i = [end], 0, 0, end
        while True:
            i = via[i]
            now = score[end] - (score[i] if i >= 0 else 0)
            if now > best:
                best, stop = now, len(way)
            elif best - now > o["bw"]:
                break
            if i < 0 or taken[i]:
                break
            way.append(i)
        way = way[:stop]
        for i in way:
            taken[i] = True
        if best >= o["min_sc"] and len(way) >= max(o["min_cnt"], 1):
            found.append((best, way[::-1]))
    return found


def seed_blocks(at: list[tuple[int, int]], k: int) -> list[dict]:
    """Blocks of a chain's seeds: those that stand end to end on both sides are one, those that overlap
    the block before on either side are passed over."""
    out: list[dict] = []
    for r, q in at:
        gap = (r - out[-1]["r_end"], q - out[-1]["q_end"]) if out else None
        if gap == (0, 0):
            out[-1] |= {"r_end": r + k, "q_end": q + k}
        elif gap is None or min(gap) >= 0:
            out.append({"r_beg": r, "r_end": r + k, "q_beg": q, "q_end": q + k})
    return out


_BLOCKS = "array<struct<r_beg:bigint,r_end:bigint,q_beg:bigint,q_end:bigint>>"


#: Seeds and pairs of seeds that are weighed at once, and rounds in which scores may still rise.
_ROWS, _PAIRS, _ROUNDS = 1 << 16, 1 << 20, 32


def may_chain(r: np.ndarray, q: np.ndarray, first: np.ndarray, k: int, o: dict) -> np.ndarray:
    """Of parts (seeds in order; ``first``: where each begins) those in which a chain may reach ``min_sc``; the
    others have none. Scores over all seeds in reach, whatever ``max_skip`` says, bound those of
    ``best_links`` from above. Where more than eight times ``_PAIRS`` may follow one another, parts count as such."""
    size = np.diff(np.append(first, len(r)))
    if o["min_sc"] <= k and o["min_cnt"] <= 1:
        return np.ones(len(first), bool)
    live = np.zeros(len(first), bool)
    pairs = size * np.minimum(size - 1, o["max_iter"])
    shifts = range(o["bw"] + 1)
    gap, steps = np.array([o["pen_gap"] * x for x in shifts]), np.array([0.5 * (math.floor(math.log2(x + 1)) if x else 0) for x in shifts])
    weighed = np.flatnonzero(size > 1)
    for some in np.split(weighed, np.flatnonzero(np.diff(np.cumsum(pairs[weighed]) // _PAIRS)) + 1):
        part = np.repeat(some, size[some])  # the part of each seed, and the seed's place in it
        rank = np.arange(len(part)) - np.repeat(np.cumsum(size[some]) - size[some], size[some])
        at = first[part] + rank
        at = at[np.lexsort((q[at], part))]  # by the query, which is often the longer side
        x, y, found, n, back = r[at], q[at], [], 0, 0
        late = np.arange(len(part))
        while len(late) and n <= 8 * _PAIRS:
            back += 1
            late = late[rank[late] >= back]
            dq = y[late] - y[late - back]
            late = late[dq <= o["max_dist"]]  # earlier seeds lie further still
            dr, dq = x[late] - x[late - back], y[late] - y[late - back]
            ok = (dq > 0) & (dr > 0) & (dr <= o["max_dist"]) & (np.abs(dr - dq) <= o["bw"])
            i, dr, dq = late[ok], dr[ok], dq[ok]
            shift, near = np.abs(dr - dq), np.minimum(dr, dq)
            price = (gap[shift] + o["pen_skip"] * near + steps[shift]).astype(np.int64)
            found.append((i, i - back, np.minimum(k, near) - np.where((shift > 0) | (near > k), price, 0)))
            n += len(i)
        if len(late):  # too many pairs
            live[some] = True
            continue
        if not found:
            continue
        i, j, gain = (np.concatenate(c) for c in zip(*found, strict=True))
        score, rising = np.full(len(part), k, np.int64), np.empty(0, np.int64)
        for _ in range(_ROUNDS):
            told = score.copy()
            np.maximum.at(told, i, score[j] + gain)
            rising = np.flatnonzero(told > score)
            score = told
            if not len(rising):
                break
        live[part[score >= o["min_sc"]]] = True
        live[part[rising]] = True
    return live


def seed_chains(seeds: DataFrame, k: int, preset: str | dict = "base") -> DataFrame:
    """q_name, r_name, rev, score, n_seeds, blocks: chains of seeds (q_name, r_name, rev, q_pos, r_pos as
    ``sketches.seeds``). ``preset`` names one of ``PRESETS`` or gives its entries. No chain
    crosses a part of the reference longer than ``max_dist`` without seeds. Seeds are sorted once
    and parted in Arrow batches; only parts that ``may_chain`` are walked seed by seed."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    o = PRESETS[preset] if isinstance(preset, str) else {**BASE, **preset}
    o = {**o, "max_dist": max(o["max_dist"], o["bw"])}
    keys, places = ["q_name", "r_name", "rev"], ["r_pos", "q_pos"]
    kind = dict(seeds.dtypes)
    schema = f"q_name {kind['q_name']}, r_name {kind['r_name']}, rev boolean, score long, n_seeds long, blocks {_BLOCKS}"
    arrow = to_arrow_schema(StructType.fromDDL(schema))

    def starts(rows: pa.Table) -> np.ndarray:
        r = rows["r_pos"].to_numpy()
        new = np.diff(r) > o["max_dist"]
        for c in keys:
            x, y = rows[c].slice(1), rows[c].slice(0, rows.num_rows - 1)
            other = pc.or_(pc.fill_null(pc.not_equal(x, y), False), pc.xor(pc.is_null(x), pc.is_null(y)))
            new |= other.to_numpy().astype(bool)
        return np.concatenate([[0], np.flatnonzero(new) + 1])

    def told(rows: pa.Table, first: np.ndarray) -> pa.RecordBatch:
        r, q = (rows[c].to_numpy().astype(np.int64) for c in places)
        out, ends = [], np.append(first[1:], rows.num_rows)
        for n in np.flatnonzero(may_chain(r, q, first, k, o)):
            at = list(zip(r[first[n] : ends[n]].tolist(), q[first[n] : ends[n]].tolist(), strict=True))
            head = {c: rows[c][int(first[n])].as_py() for c in keys}
            out += [{**head, "score": s, "n_seeds": len(way), "blocks": seed_blocks([at[i] for i in way], k)} for s, way in walk_back(*best_links(at, k, o), o)]
        return pa.RecordBatch.from_pylist(out, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, want = [], 0, _ROWS  # the last part goes on in the next batch
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n < want:
                continue
            rows = pa.Table.from_batches(held).combine_chunks()
            first = starts(rows)
            if len(first) > 1:
                yield told(rows.slice(0, first[-1]), first[:-1])
            held = rows.slice(first[-1]).to_batches()
            n = rows.num_rows - int(first[-1])
            want = max(_ROWS, 2 * n)
        if n:
            rows = pa.Table.from_batches(held).combine_chunks()
            yield told(rows, starts(rows))

    return seeds.select(*keys, *places).repartition(*keys).sortWithinPartitions(*keys, *places).mapInArrow(run, schema)


# ---- choices among alignments -----------------------------------------------------------------------


def colinear(aligns: DataFrame, on: list[str], r: tuple[str, str], q: tuple[str, str]) -> DataFrame:
    """Of each group's alignments, longest on r first (ties: the earlier on r, then on q), those that
    overlap none kept on either side and lie on the same side of it on both; empty ones go. What
    is kept depends on what was, so a pair's alignments are folded in one expression."""
    sides = [F.least(*r), F.greatest(*r), F.least(*q), F.greatest(*q)]
    item = F.struct((sides[0] - sides[1]).alias("back"), *[s.alias(n) for s, n in zip(sides, ("rb", "re", "qb", "qe"))], F.struct(*[c for c in aligns.columns if c not in on]).alias("row"))
    listed = aligns.where((sides[0] < sides[1]) & (sides[2] < sides[3])).groupBy(*on).agg(F.array_sort(F.collect_list(item)).alias("x"))

    def clash(k: Column, c: Column) -> Column:
        over = lambda a, b: (c[a] < k[b]) & (k[a] < c[b])
        crossed = ((c["rb"] > k["rb"]) & (c["qb"] <= k["qb"])) | ((c["rb"] < k["rb"]) & (c["qb"] >= k["qb"]))
        return over("rb", "re") | over("qb", "qe") | crossed

    kept = F.aggregate("x", F.slice("x", F.lit(1), F.lit(0)), lambda acc, c: F.when(F.exists(acc, lambda k: clash(k, c)), acc).otherwise(F.concat(acc, F.array(c))))
    return listed.select(*on, F.explode(kept).alias("y")).select(*on, "y.row.*")


def path_pieces(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """on, a_beg, a_end, b_beg, b_end: what lies between the anchors of two paths (on, pos from 0, v), where
    both hold something there; without anchors all of both.

    A vertex of a is an anchor when b has it (its last place counts) behind all anchors before: those
    are the places that rise above all before them, which one window tells.
    """
    last = b.groupBy(*on, "v").agg(F.max("pos").alias("j"))
    both = a.select(*on, F.col("pos").alias("i"), "v").join(last, [*on, "v"])
    rising = Window.partitionBy(*on).orderBy("i")
    high = F.max("j").over(rising.rowsBetween(Window.unboundedPreceding, -1))
    anchors = both.withColumn("_h", high).where(F.col("_h").isNull() | (F.col("j") > F.col("_h"))).select(*on, "i", "j")
    ends = a.groupBy(*on).agg((F.max("pos") + 1).alias("i")).join(b.groupBy(*on).agg((F.max("pos") + 1).alias("j")), on)
    every = anchors.unionByName(ends.select(*on, "i", "j"))
    cuts = every.select(*on, (F.coalesce(F.lag("i").over(rising), F.lit(-1)) + 1).alias("a_beg"), F.col("i").alias("a_end"), (F.coalesce(F.lag("j").over(rising), F.lit(-1)) + 1).alias("b_beg"), F.col("j").alias("b_end"))
    return cuts.where("a_beg < a_end AND b_beg < b_end")


def worth_aligning(pieces: DataFrame, min_new: float) -> DataFrame:
    """cand: candidates (in rising order) whose segment pairs (cand, a, b, bases; a and b in either order)
    that didn't come before hold at least ``min_new`` of all their bases. Pairs count as seen even
    if their candidate is passed over, so a pair is new where it comes first."""
    first = Window.partitionBy(F.least("a", "b"), F.greatest("a", "b")).orderBy("cand")
    told = pieces.withColumn("_n", F.when(F.row_number().over(first) == 1, F.col("bases")).otherwise(0)).groupBy("cand").agg(F.sum("_n").alias("new"), F.sum("bases").alias("every"))
    return told.where((F.col("every") > 0) & (F.col("new") >= min_new * F.col("every"))).select("cand")


# ---- chains among one another ------------------------------------------------------------------------


def tidy_blocks(blocks: list[dict]) -> list[dict]:
    """Blocks in order of both beginnings: one that reaches into (or touches) the one before on both sides
    widens it, one that does so on one side alone goes."""
    out: list[dict] = []
    for b in sorted(blocks, key=lambda x: (x["r_beg"], x["q_beg"])):
        if not out:
            out.append(dict(b))
            continue
        last = out[-1]
        on_r, on_q = last["r_end"] >= b["r_beg"], last["q_end"] >= b["q_beg"]
        if on_r and on_q:
            last |= {"r_end": max(last["r_end"], b["r_end"]), "q_beg": min(last["q_beg"], b["q_beg"]), "q_end": max(last["q_end"], b["q_end"])}
        elif not on_r and not on_q:
            out.append(dict(b))
    return out


def join_chains(chains: DataFrame, small_gap: int, small_slop: int) -> DataFrame:
    """``chains`` (as ``seed_chains``) of one query, reference and strand, by their first place on the reference,
    joined to the one before where it ends shortly before on both sides (gaps above 0, at most
    ``small_gap``, and apart by at most ``small_slop``), or where its last block and this one's first
    lie on one diagonal and meet, and then their blocks are tidied. Scores and seeds add up. A
    first block further than ``small_gap`` behind all that came before never joins."""
    keys = ["q_name", "r_name", "rev", "_part"]
    far = F.array_max(F.transform("blocks", lambda b: b["r_end"]))
    parted = stretches(chains.withColumn("_at", F.get("blocks", F.lit(0))["r_beg"]).withColumn("_to", far), keys[:3], "_at", "_to", small_gap)

    def fold(rows: list[dict]) -> list[dict]:
        out: list[dict] = []
        for x in rows:
            own = {**{c: x[c] for c in ("q_name", "r_name", "rev", "score", "n_seeds")}, "blocks": [dict(b) for b in x["blocks"]]}
            if not out:
                out.append(own)
                continue
            last, end, first = out[-1], out[-1]["blocks"][-1], own["blocks"][0]
            r, q = first["r_beg"] - end["r_end"], first["q_beg"] - end["q_end"]
            behind = 0 < r <= small_gap and 0 < q <= small_gap and abs(r - q) <= small_slop
            meets = r == q <= 0 and first["r_beg"] >= end["r_beg"] and first["q_beg"] >= end["q_beg"]
            if not behind and not meets:
                out.append(own)
                continue
            both = last["blocks"] + own["blocks"]
            last |= {"score": last["score"] + own["score"], "n_seeds": last["n_seeds"] + own["n_seeds"], "blocks": tidy_blocks(both) if meets else both}
        return out

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chains.select("q_name", "r_name", "rev", "score", "n_seeds", "blocks").schema)
    return by_group(parted, keys, ["_at", F.desc("score"), "_to"], fold, schema)


def leader_groups(chains: DataFrame, on: list[str], min_frac: float) -> DataFrame:
    """``chains`` (on, id, score, q_beg, q_end) with leader: the id of the first, best score first (ties: the
    longer, the earlier begin, then end, then id), that no leader before shares the query with and
    that shares it with this one. Sharing is an overlap of at least ``min_frac`` of the shorter, or
    any where that is 0. A query's chains are folded in one expression; empty ones go."""
    size = F.col("q_end") - F.col("q_beg")
    item = F.struct((-F.col("score")).alias("s"), (-size).alias("l"), F.col("q_beg").alias("qb"), F.col("q_end").alias("qe"), F.col("id").alias("id"))
    live = chains.where("q_beg < q_end")
    listed = live.groupBy(*on).agg(F.array_sort(F.collect_list(item)).alias("x"))

    def share(a: Column, b: Column) -> Column:
        over = F.least(a["qe"], b["qe"]) - F.greatest(a["qb"], b["qb"])
        return (over > 0) & (over >= min_frac * F.least(a["qe"] - a["qb"], b["qe"] - b["qb"]))

    led = listed.withColumn("_l", F.aggregate("x", F.slice("x", F.lit(1), F.lit(0)), lambda acc, c: F.when(F.exists(acc, lambda k: share(k, c)), acc).otherwise(F.concat(acc, F.array(c)))))
    told = led.select(*on, F.explode(F.transform("x", lambda c: F.struct(c["id"].alias("id"), F.get(F.filter("_l", lambda k: share(k, c)), F.lit(0))["id"].alias("leader")))).alias("y"))
    return told.select(*on, "y.id", "y.leader")
