"""Operator 10: exact cosine threshold pairs by dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, cut, release

#: Vectors in one block; a task holds two.
BLOCK = 8192
#: Nodes of the tree's upper level: centres taken from a sample of about 128 vectors for each, at
#: most so many.
UPPER_NODES = 64
#: Below so many vectors a node isn't split; two nodes with so many pairs are compared directly.
LEAF, DENSE_PAIRS = 24, 1 << 20
#: Distances are taken as uncertain by this much when whole nodes are ruled out or in.
SLACK = 1e-9


def rough(dim: int) -> float:
    """How far a cosine of two rounded unit vectors of so many numbers may be off in single
    precision, in whatever order it is summed; such cosines only rule pairs out."""
    unit = 2.0**-24
    return 1.01 * (dim + 4) * unit / (1 - (dim + 4) * unit)


def _unit(raw: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), np.float64).reshape(len(raw), -1)
    return x / np.linalg.norm(x, axis=1)[:, None]


class Tree:
    """A cover tree over unit vectors, in arrays.

    A node stands for a run of ``order``: it has a centre, the greatest distance of its vectors
    from it (its covering radius), and children. The children of a node cover it with balls of
    half its nominal radius around some of its own vectors, the node's centre first, so centres
    nest from level to level. Nodes of few vectors have single vectors as children.
    """

    def __init__(self, x: np.ndarray):
        self.x, n = x, len(x)
        self.rough = x.astype(np.float32)
        self.order = np.arange(n)
        self.centre, self.radius, self.lo, self.hi, self.children = [], [], [], [], []
        todo = [(self._node(0, n, 0, x), 2.0)]
        while todo:
            node, reach = todo.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo == 1 or self.radius[node] == 0:
                continue
            rows = self.order[lo:hi]
            if hi - lo <= LEAF:
                self.children[node] = [self._node(i, i + 1, self.order[i], x) for i in range(lo, hi)]
                continue
            half = reach / 2
            while half > self.radius[node]:
                half /= 2
            owner, centres = _net(self.rough, rows, self.centre[node], half)
            by = np.argsort(owner, kind="stable")
            self.order[lo:hi] = rows[by]
            edge = lo + np.searchsorted(owner[by], np.arange(len(centres) + 1))
            kids = [self._node(int(a), int(b), c, x) for a, b, c in zip(edge[:-1], edge[1:], centres, strict=True)]
            self.children[node] = kids
            todo += [(k, half) for k in kids]
        self.centre, self.radius = np.array(self.centre), np.array(self.radius)
        self.lo, self.hi = np.array(self.lo), np.array(self.hi)

    def _node(self, lo: int, hi: int, centre: int, x: np.ndarray) -> int:
        self.centre.append(int(centre))
        self.radius.append(float(np.sqrt(((x[self.order[lo:hi]] - x[centre]) ** 2).sum(1).max())) if hi - lo > 1 else 0.0)
        self.lo.append(lo)
        self.hi.append(hi)
        self.children.append([])
        return len(self.centre) - 1


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def _net(x: np.ndarray, rows: np.ndarray, first: int, reach: float) -> tuple[np.ndarray, list[int]]:
    """(which centre covers each row, centres): every row lies within about ``reach`` of its centre.

    Single precision will do: covering radii are measured afterwards.
    """
    centres, owner, inside = [int(first)], np.full(len(rows), -1), 1 - reach * reach / 2
    for lo in range(0, len(rows), 512):
        own = x[rows[lo : lo + 512]]
        g = own @ x[np.array(centres)].T
        best = g.argmax(1)
        near = g[np.arange(len(own)), best] >= inside
        owner[lo : lo + 512] = np.where(near, best, -1)
        left = np.flatnonzero(~near)
        if len(left):
            g = own[left] @ own[left].T >= inside
            alone = g.sum(1) <= 1
            free = np.ones(len(left), bool)
            for i in range(len(left)):
                if free[i]:
                    if alone[i]:
                        owner[lo + left[i]] = len(centres)
                    else:
                        take = free & g[i]
                        take[i] = True
                        owner[lo + left[take]] = len(centres)
                        free &= ~take
                    centres.append(int(rows[lo + left[i]]))
    used = np.unique(owner)
    return np.searchsorted(used, owner), [centres[u] for u in used]


class Links:
    """Counts links of the vectors of two blocks, and gathers edges that connect all that link."""

    def __init__(self, n: int, cosine: float):
        self.count, self.cosine = np.zeros(n, np.int64), cosine
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = int(self.up[i])
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)

    def all_of(self, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Every pair of a and b links (with ``same``, b is a)."""
        if same:
            self.count[a] += len(a) - 1
        else:
            self.count[a] += len(b)
            self.count[b] += len(a)
        for i in a:
            self.join(int(i), int(b[0]))
        for j in b:
            self.join(int(j), int(a[0]))

    def pairs(self, x: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Compare the pairs a[i], b[i] by their cosines; a vector with itself doesn't count."""
        hit = (np.einsum("ij,ij->i", x[a], x[b]) >= self.cosine) & (a != b)
        np.add.at(self.count, a[hit], 1)
        np.add.at(self.count, b[hit], 1)
        for i, j in zip(a[hit].tolist(), b[hit].tolist(), strict=True):
            self.join(i, j)

    def compare(self, x: np.ndarray, a: np.ndarray, b: np.ndarray, same: bool) -> None:
        """Compare all pairs by their cosines."""
        hit = x[a] @ x[b].T >= self.cosine
        if same:
            np.fill_diagonal(hit, False)
        if not hit.any():
            return
        self.count[a] += hit.sum(1)
        if not same:
            self.count[b] += hit.sum(0)
        if int(hit.sum()) <= 4 * (len(a) + len(b)):
            for i, j in zip(*np.nonzero(hit), strict=True):
                self.join(int(a[i]), int(b[j]))
            return
        # Breadth first over the dense block: each row and column is expanded once.
        rows, cols = hit.any(1), np.ones(len(b), bool)
        for i in np.flatnonzero(rows):
            if not rows[i]:
                continue
            front = np.array([i])
            rows[i] = False
            while len(front):
                reached = np.flatnonzero(hit[front].any(0) & cols)
                cols[reached] = False
                for j in reached:
                    self.join(int(a[i]), int(b[j]))
                front = np.flatnonzero(hit[:, reached].any(1) & rows) if len(reached) else np.empty(0, np.int64)
                rows[front] = False
                for k in front:
                    self.join(int(a[i]), int(a[k]))


def _opened(t: Tree, nodes: np.ndarray) -> np.ndarray:
    """The children of all nodes; a node without children stands for itself."""
    return np.concatenate([np.array(t.children[n] or [n]) for n in nodes.tolist()])


def traverse(s: Tree, t: Tree, base: int, links: Links, same: bool) -> None:
    """Find all links between two trees (of one tree with itself: ``same``).

    ``base``: where t's vectors start in the counts of ``links``. Sets of nodes are taken against
    each other. Node pairs farther apart than the threshold and both covering radii hold no link;
    pairs nearer than the threshold less the radii hold nothing but links. Where the radii rule
    out little, a whole set is opened; otherwise each pair that is left is opened, the larger node
    first, or compared directly where it is small.
    """
    reach = float(np.sqrt(2 - 2 * links.cosine))
    both = s.x if same else np.concatenate([s.x, t.x])
    root = np.array([0])
    stack = [(root, root, same)]  # the last item: both sides are one set
    while stack:
        p, q, one_set = stack.pop()
        if len(p) * len(q) > DENSE_PAIRS:
            if one_set:
                u, w = np.array_split(p, 2)
                stack += [(u, u, True), (w, w, True), (u, w, False)]
            elif len(p) >= len(q):
                stack += [(u, q, False) for u in np.array_split(p, 2)]
            else:
                stack += [(p, w, False) for w in np.array_split(q, 2)]
            continue
        lone_p, lone_q = s.hi[p] - s.lo[p] == 1, t.hi[q] - t.lo[q] == 1
        if lone_p.any() != lone_p.all() or lone_q.any() != lone_q.all():
            if one_set:
                stack += [(p[lone_p], p[lone_p], True), (p[~lone_p], p[~lone_p], True), (p[lone_p], p[~lone_p], False)]
            else:
                stack += [(u, w, False) for u in (p[lone_p], p[~lone_p]) for w in (q[lone_q], q[~lone_q]) if len(u) and len(w)]
            continue
        wide = min(2.0, reach + float(s.radius[p].max()) + float(t.radius[q].max()))
        i, j = np.nonzero(s.rough[s.centre[p]] @ t.rough[t.centre[q]].T >= np.float32(1 - wide * wide / 2 - rough(s.x.shape[1])))
        if one_set:
            i, j = i[i <= j], j[i <= j]
        if not len(i):
            continue
        if lone_p.all() and lone_q.all():
            a, b = s.centre[p], t.centre[q] + base
            if len(i) > 4 * (len(a) + len(b)):
                links.compare(both, a, b, one_set)
            else:
                links.pairs(both, a[i], b[j])
            continue
        if len(i) > 64 + len(p) * len(q) // 10 and wide > reach:
            # The set with the greater radii is opened as a whole.
            if one_set:
                more = _opened(s, p)
                stack.append((more, more, True))
            elif s.radius[p].max() >= t.radius[q].max():
                stack.append((_opened(s, p), q, False))
            else:
                stack.append((p, _opened(t, q), False))
            continue
        u, w = p[i], q[j]
        d = np.sqrt(np.maximum(2 - 2 * np.einsum("ij,ij->i", s.x[s.centre[u]], t.x[t.centre[w]]), 0))
        r = s.radius[u] + t.radius[w]
        ok = d <= reach + r + SLACK
        for m, n, far, ends in zip(u[ok].tolist(), w[ok].tolist(), d[ok].tolist(), r[ok].tolist(), strict=True):
            x, y = s.order[s.lo[m] : s.hi[m]], t.order[t.lo[n] : t.hi[n]]
            itself = one_set and m == n
            if far + ends <= reach - SLACK:
                links.all_of(x, x if itself else y + base, itself)
            elif len(x) * len(y) <= DENSE_PAIRS and (len(x) + len(y) <= 4 * LEAF or ends >= reach / 4):
                links.compare(both, x, y + base, itself)
            elif not (s.children[m] or t.children[n]):  # two great sets of equal vectors, on the verge
                for part in np.array_split(x, -(-len(x) * len(y) // DENSE_PAIRS)):
                    links.compare(both, part, y + base, False)
            elif itself:
                kids = _opened(s, np.array([m]))
                stack.append((kids, kids, True))
            elif s.children[m] and (len(x) >= len(y) or not t.children[n]):
                stack.append((np.array(s.children[m]), np.array([n]), False))
            else:
                stack.append((np.array([m]), np.array(t.children[n]), False))


def _join(cosine: float) -> object:
    def run(table: pa.Table) -> pa.Table:
        row = table["row"].to_numpy()
        first = table["first"].to_numpy(zero_copy_only=False)
        same = bool(table["same"][0].as_py())
        order = np.lexsort((row, ~first))
        x, row = _unit(table["v"].to_pylist())[order], row[order]
        n = int(first.sum())
        links = Links(len(row), cosine)
        if same:
            tree = Tree(x)
            traverse(tree, tree, 0, links, True)
        elif 0 < n < len(row):
            traverse(Tree(x[:n]), Tree(x[n:]), n, links, False)
        root = np.array([links.find(i) for i in range(len(row))])
        at = np.flatnonzero((links.count > 0) | (root != np.arange(len(row))))
        return pa.table({"row": row[at], "links": links.count[at], "root": row[root[at]]})

    return run


def _valid(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The vectors that have a direction, as bytes of numbers of at most 1."""
    for batch in batches:
        out = []
        for v in batch.column(1).to_pylist():
            x = None
            if v and None not in v:
                x = np.array(v, np.float64)
                x = x / np.abs(x).max() if np.isfinite(x).all() and x.any() else None
            out.append(None if x is None else x.tobytes())
        size = [None if x is None else len(x) // 8 for x in out]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(out, pa.binary()), pa.array(size, pa.int32())], names=["vec_id", "row", "v", "dim"])


def _assign(centres: np.ndarray) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _unit(batch.column(1).to_pylist()) if batch.num_rows else np.empty((0, centres.shape[1]))
            d = _distance(x, centres)
            at = d.argmin(1) if len(x) else np.empty(0, np.int64)
            far = np.sqrt(((x - centres[at]) ** 2).sum(1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32)), pa.array(far)], names=["row", "v", "node", "far"])

    return run


def near_pairs(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept by row: links are pairs with a cosine of at least
    ``cosine``, taken in double precision. No link is lost and no other is made.

    The upper level of the tree is spread over the cluster: at most ``UPPER_NODES`` centres, from a
    bounded sample, so many that a node has about a block of vectors; each vector joins its
    nearest centre, and the node's covering radius is the greatest distance found. Pairs of nodes
    that their centres and radii keep apart by more than the threshold are dropped. A node of
    more than ``BLOCK`` vectors is several blocks, so no task holds more than about two, however
    many vectors are alike. Each pair of blocks left is one task, which builds cover trees with
    halving radii over both and traverses them together.

    Vectors that are null, empty, zero, or that hold null or non-finite numbers link with
    nothing; vectors of different lengths don't link, each length is searched by itself. A null id
    is its own component (null). Rows that repeat an id are vectors of their own. An empty table gives no rows; other columns are not looked at.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("x")).withColumn("row", F.monotonically_increasing_id())
    own = cut(rows.select("vec_id", "x", "row").mapInArrow(_valid, "vec_id long, row long, v binary, dim int"))
    # Each length is a space of its own; those that fill no block take a task each, all together.
    size = own.where("v IS NOT NULL").groupBy("dim").count()
    few = F.broadcast(size.where(F.col("count") > BLOCK).select("dim"))
    small = own.where("v IS NOT NULL").join(few, "dim", "left_anti").select(F.col("dim").alias("task"), "row", "v", F.lit(True).alias("first"), F.lit(True).alias("same"))
    found = small.groupBy("task").applyInArrow(_join(cosine), "row long, links long, root long")
    for r in size.where(F.col("count") > BLOCK).orderBy("dim").collect():
        found = found.unionByName(_found(spark, own.where((F.col("dim") == r["dim"]) & F.col("v").isNotNull()).select("row", "v"), r["count"], cosine))
    found = cut(found)
    release(spark)
    links = found.groupBy("row").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("row").alias("a"), F.col("root").alias("b")))
    named = groups.join(own.select(F.col("row").alias("node"), "vec_id"), "node")
    least = named.groupBy("component").agg(F.min("vec_id").alias("component_id"))
    ids = named.join(least, "component").select(F.col("node").alias("row"), "component_id")
    return (
        own.select("vec_id", "row").join(links, "row", "left").join(ids, "row", "left")
        .select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))
    )


def _found(spark: SparkSession, valid: DataFrame, n: int, cosine: float) -> DataFrame:
    """row, links, root of the vectors of one length: how many links a task found, and a row that
    the vector is connected with."""
    k = int(min(UPPER_NODES, max(1, -(-n // BLOCK))))
    part = min(1.0, 128 * k / n)  # a share by hash that holds about 128 a node
    some = valid.where(F.pmod(F.xxhash64("v"), F.lit(1 << 30)) <= int(part * (1 << 30))).select("v").distinct()
    sample = _unit(sorted(r["v"] for r in some.collect()) or [valid.first()["v"]])
    centres = sample[_spread(sample, k)]
    placed = cut(valid.mapInArrow(_assign(centres), "row long, v binary, node int, far double"))
    nodes = {r["node"]: (r["far"], r["n"]) for r in placed.groupBy("node").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect()}
    blocks = {a: -(-m // BLOCK) for a, (_, m) in nodes.items()}
    reach = float(np.sqrt(2 - 2 * cosine))
    apart = _distance(centres, centres)
    near = [(a, b) for a in sorted(nodes) for b in sorted(nodes) if a <= b and (a == b or apart[a, b] <= reach + nodes[a][0] + nodes[b][0] + SLACK)]
    meets = spark.createDataFrame([(x, a, b, x == a, blocks[b if x == a else a]) for a, b in near for x in {a, b}], "node int, a int, b int, left boolean, other int")
    count = F.create_map(*[F.lit(int(y)) for a, m in blocks.items() for y in (a, m)])
    dealt = (
        placed.withColumn("block", F.pmod(F.xxhash64("row"), count[F.col("node")]).cast("int"))
        .join(F.broadcast(meets), "node")  # one row for each pair of upper nodes: bounded by their number
        .withColumn("with", F.explode(F.sequence(F.lit(0), F.col("other") - 1)))
    )
    inside = F.col("a") == F.col("b")
    task = F.when(inside, F.struct("a", F.least("block", "with").alias("i"), "b", F.greatest("block", "with").alias("j"))).otherwise(
        F.struct("a", F.when(F.col("left"), F.col("block")).otherwise(F.col("with")).alias("i"), "b", F.when(F.col("left"), F.col("with")).otherwise(F.col("block")).alias("j"))
    )
    dealt = dealt.withColumn("task", task).select(
        "task", "row", "v",
        F.when(inside, F.col("block") == F.col("task.i")).otherwise(F.col("left")).alias("first"),
        (inside & (F.col("task.i") == F.col("task.j"))).alias("same"),
    )
    return dealt.groupBy("task").applyInArrow(_join(cosine), "row long, links long, root long")


def _spread(x: np.ndarray, k: int) -> list[int]:
    """Rows of x far from one another: each next one is the farthest from those before."""
    chosen = [0]
    far = _distance(x, x[:1])[:, 0]
    while len(chosen) < min(k, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distance(x, x[chosen[-1:]])[:, 0])
    return chosen


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, CASE WHEN len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                      AND list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) > 0
                      THEN embedding::DOUBLE[] END AS e FROM embeddings),
l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM r GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT c.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON n.vec_id = c.vec_id
"""
