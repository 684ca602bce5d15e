"""Operator 6: mix sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

#: The hash of a document has 60 bits, looked at 12 at a time.
HASH_BITS, STEP_BITS = 60, 12
#: A boundary bucket is refined until no source has more rows in it than this.
BOUNDARY_ROWS = 4096
#: A table of so many sources (about 100 bytes each) may go to every task; beyond, rows are dealt
#: out by source and so many salts.
FEW_SOURCES, SALTS = 50_000, 32


def _hash(id_col: str) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _source(source_col: str) -> tuple[Column, Column]:
    """The source as (none, src)."""
    return F.col(source_col).isNull(), F.coalesce(F.col(source_col).cast("string"), F.lit(""))


def _meet(rows: DataFrame, small: DataFrame, n_sources: int) -> DataFrame:
    """``rows`` joined with one row for each source (columns p_none, p_src and others).

    Up to ``FEW_SOURCES`` sources go to every task; with more of them, rows of a source are
    dealt out to ``SALTS`` tasks, so that a source of a third of all rows fills none.
    """
    same = (F.col("none") == F.col("p_none")) & (F.col("src") == F.col("p_src"))
    if n_sources <= FEW_SOURCES:
        return rows.join(F.broadcast(small), same).drop("p_none", "p_src")
    salted = small.withColumn("p_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("salt", F.pmod(F.xxhash64("h"), F.lit(SALTS)).cast("int")).join(salted, same & (F.col("salt") == F.col("p_salt"))).drop("p_none", "p_src", "p_salt", "salt")


def _as_small(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"none": "p_none", "src": "p_src"})


def _planned(docs: DataFrame, weights: Sequence[int], share: float, cap: int, id_col: str, text_col: str, source_col: str) -> tuple[DataFrame, DataFrame, int]:
    """(doc_id, none, src, size, h of each row; p_none, p_src, source_size, target, passes, upto of
    each source; number of sources)."""
    none, src = _source(source_col)
    rows = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), none.alias("none"), src.alias("src"), F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD)).cast("long").alias("size"), _hash(id_col).alias("h")
        )
    )
    by = ["none", "src"]
    # From here to `plan` there is one row for each source; its windows take them all in one task.
    each = rows.groupBy(*by).agg(F.sum("size").alias("s"))
    named = each.withColumn("n", F.row_number().over(Window.orderBy("none", "src"))).withColumn(
        "w", F.element_at(F.array(*[F.lit(int(x)) for x in weights]), F.pmod(F.col("n") - 1, F.lit(len(weights))).cast("int") + 1).cast("long")
    )
    rising = Window.orderBy((F.lit(float(cap)) * F.col("s") / F.col("w")), "n")
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.col("total") - F.col("full").cast("double")) / F.col("rest").cast("double")
    plan = (
        named.withColumn("total", F.sum("s").over(every))
        .withColumn("full", F.coalesce(F.sum(F.col("s") * cap).over(rising.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("rest", F.sum("w").over(rising.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max(level).over(every))
        .withColumn("target", F.least(F.lit(float(cap)) * F.col("s"), F.col("w") * F.col("level")))
        .withColumn("passes", F.when(F.col("s") > 0, F.floor(F.col("target") / F.col("s"))).otherwise(F.lit(0)).cast("long"))
        .withColumn("need", F.col("target") - F.col("passes") * F.col("s"))
        .select(*by, F.col("s").alias("source_size"), "target", "passes", "need")
    )
    plan = cut(plan)
    n_sources = plan.count()

    shift = HASH_BITS - STEP_BITS
    inside = _meet(rows, _as_small(plan.select(*by, "need")), n_sources).withColumn("before", F.lit(0).cast("long"))
    while True:
        order = Window.partitionBy(*by).orderBy("b")
        sums = inside.groupBy(*by, "need", "before", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        edge = cut(
            sums.withColumn("end", F.col("before") + F.sum("words").over(order))
            .where(F.col("end") > F.col("need"))
            .withColumn("k", F.row_number().over(order))
            .where("k = 1")
            .select(*by, "need", (F.col("end") - F.col("words")).alias("before"), "b", "n")
        )
        inside = _meet(rows, _as_small(edge), n_sources).where(F.shiftright("h", shift) == F.col("b"))
        most = edge.agg(F.max("n")).first()[0] or 0
        if most <= BOUNDARY_ROWS or shift == 0:
            break
        shift -= STEP_BITS
        inside = inside.drop("b", "n")
    # Rows of equal hash, which go in or out together, first: what is left to sort is one row a hash.
    equal = inside.groupBy(*by, "h", "before", "need").agg(F.sum("size").alias("size"))
    reach = Window.partitionBy(*by).orderBy("h").rowsBetween(Window.unboundedPreceding, 0)
    steps = equal.withColumn("sum", F.col("before") + F.sum("size").over(reach)).select(*by, "h", F.abs(F.col("sum") - F.col("need")).alias("off"))
    start = edge.select(*by, (F.shiftleft("b", shift) - 1).alias("h"), F.abs(F.col("before") - F.col("need")).alias("off"))
    limit = steps.unionByName(start).groupBy(*by).agg(F.min(F.struct("off", "h"))["h"].alias("upto"))
    return rows, cut(_as_small(plan.join(limit, by, "left").drop("need"))), n_sources


def _passes() -> Column:
    """How often a row's text is taken."""
    return F.col("passes") + F.when(F.col("h") <= F.col("upto"), 1).otherwise(0)


def mix(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """doc_id, size, source_size, target, taken for each row.

    size counts the words of the text (null: 0). Sources in code point order, null last, get
    ``weights`` in turn, which divide ``share`` times all words; no target exceeds ``cap`` times
    its source, and what is above is shared again by weight: target = least(cap * size, weight *
    level), where the level is the greatest that any set of capped sources leaves.

    A source's whole passes take every document so many times. The rest of the target is taken
    by a threshold on the hash of the id: words are summed per source and hash bucket, the bucket
    that the budget ends in is split by the next bits until few rows are left in it, and the
    threshold whose sum is nearest to the budget wins. Documents at or below it are taken once
    more; nothing is sorted but the rows of boundary buckets. ids with equal hashes (repeated
    rows, null ids) go in or out together. Documents without words take nothing.

    An empty table gives no rows; other columns are not looked at.
    """
    rows, plan, n = _planned(docs, weights, share, cap, id_col, text_col, source_col)
    return _meet(rows, plan, n).select("doc_id", "size", "source_size", "target", (F.col("size") * _passes()).cast("long").alias("taken"))


def mixed_documents(
    docs: DataFrame,
    weights: Sequence[int] = (3, 1, 2),
    share: float = 1.5,
    cap: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it (0 to ``cap`` times), all columns."""
    _, plan, n = _planned(docs, weights, share, cap, id_col, text_col, source_col)
    none, src = _source(source_col)
    # What a row takes hangs on its source and the hash of its id alone, so rows need not meet again.
    worded = F.regexp_like(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD))
    own = docs.where(worded).select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), none.alias("none"), src.alias("src"), _hash(id_col).alias("h"))
    copies = _meet(own, plan, n).withColumn("copies", _passes()).where("copies > 0")
    return copies.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("doc.*")


SQL = """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h
  FROM documents),
e AS (SELECT source, sum(size)::BIGINT AS s FROM d GROUP BY source),
n AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS n FROM e),
w AS (SELECT *, [3, 1, 2][(n - 1) % 3 + 1]::BIGINT AS w FROM n),
f AS (
  SELECT *, sum(s) OVER ()::BIGINT AS total,
         coalesce(sum(2 * s) OVER (ORDER BY 2.0::DOUBLE * s / w, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS full_words,
         sum(w) OVER (ORDER BY 2.0::DOUBLE * s / w, n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest
  FROM w),
g AS (SELECT *, max((1.5::DOUBLE * total - full_words::DOUBLE) / rest::DOUBLE) OVER () AS level FROM f),
t AS (SELECT source, s, least(2.0::DOUBLE * s, w * level) AS target FROM g),
p AS (SELECT *, CASE WHEN s > 0 THEN floor(target / s)::BIGINT ELSE 0 END AS passes FROM t),
q AS (SELECT *, target - passes * s AS need FROM p),
c AS (
  SELECT d.doc_id, d.size, d.h, q.s, q.target, q.passes, q.need, d.source,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h)::BIGINT AS upto
  FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source),
l AS (
  SELECT source, arg_min(h, off) AS h FROM (
    SELECT source, min(h) AS h, off FROM (
      SELECT source, h, abs(upto - need) AS off FROM c UNION ALL SELECT source, -1, need FROM q)
    GROUP BY source, off)
  GROUP BY source)
SELECT c.doc_id, c.size, c.s AS source_size, c.target,
       (c.size * (c.passes + CASE WHEN c.h <= l.h THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c JOIN l ON c.source IS NOT DISTINCT FROM l.source
"""
