"""Interval, graph and sequence tables derived from the driver's tables, and the SQL that does the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.operators import intervals


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_LINE = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")


def _running(line: DataFrame, key: str) -> F.Column:
    order = Window.partitionBy(key).orderBy(*[c for c in _LINE if c != key]).rowsBetween(Window.unboundedPreceding, 0)
    return F.sum("q").over(order).cast("long")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(*_LINE, F.col("l_quantity").cast("long").alias("q"), (F.col("l_returnflag") == "R").alias("rev"))


def order_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and part coordinates of each line: quantities laid end to end within either."""
    line = _lines(spark, sf_dir)
    a, b = _running(line, "l_orderkey"), _running(line, "l_partkey")
    return line.withColumn("a_end", a).withColumn("b_end", b).select(
        F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("a_ctg"), (F.col("a_end") - F.col("q")).alias("a_beg"), "a_end",
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("b_ctg"), (F.col("b_end") - F.col("q")).alias("b_beg"), "b_end", "rev",
    )


def part_supplier(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = _lines(spark, sf_dir)
    a, b = _running(line, "l_partkey"), _running(line, "l_suppkey")
    return line.withColumn("a_end", a).withColumn("b_end", b).select(
        F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("a_ctg"), (F.col("a_end") - F.col("q")).alias("a_beg"), "a_end",
        F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("b_ctg"), (F.col("b_end") - F.col("q")).alias("b_beg"), "b_end", F.lit(False).alias("rev"),
    )


_OP = """
line AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity::BIGINT AS q, l_returnflag = 'R' AS rev FROM lineitem),
op AS (
  SELECT 'o' || l_orderkey AS a_ctg, a_end - q AS a_beg, a_end, 'p' || l_partkey AS b_ctg, b_end - q AS b_beg, b_end, rev FROM (
    SELECT *, sum(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice ROWS UNBOUNDED PRECEDING)::BIGINT AS a_end,
              sum(q) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice ROWS UNBOUNDED PRECEDING)::BIGINT AS b_end FROM line))"""
_PS = """
ps AS (
  SELECT 'p' || l_partkey AS a_ctg, a_end - q AS a_beg, a_end, 's' || l_suppkey AS b_ctg, b_end - q AS b_beg, b_end, false AS rev FROM (
    SELECT *, sum(q) OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, l_suppkey, l_shipdate, l_extendedprice ROWS UNBOUNDED PRECEDING)::BIGINT AS a_end,
              sum(q) OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_shipdate, l_extendedprice ROWS UNBOUNDED PRECEDING)::BIGINT AS b_end FROM line))"""
_W = """
w AS (
  SELECT ctg, beg, least(beg + 120, n) AS "end" FROM (
    SELECT b_ctg AS ctg, n, unnest(range(0, n, 120)) AS beg FROM (SELECT b_ctg, max(b_end) AS n FROM op GROUP BY b_ctg)))"""
ORDER_PART_SQL, PART_SUPPLIER_SQL, WINDOWS_SQL = _OP, _PS, _W


def part_windows(records: DataFrame) -> DataFrame:
    """ctg, beg, end: windows of 120 along each part."""
    return intervals.windows(records.groupBy(F.col("b_ctg").alias("ctg")).agg(F.max("b_end").alias("n")), "n", 120, 120).drop("n")


def window_levels(spark: SparkSession, sf_dir: str) -> tuple[list[int], list[int]]:
    """Levels (``intervals.overlap_join``) of ``part_windows`` and of records, which are as long as
    a line's quantity: one column tells the longest."""
    longest = table(spark, sf_dir, "lineitem").agg(F.max(F.col("l_quantity").cast("long"))).first()[0]
    return intervals.levels_up_to(120), intervals.levels_up_to(longest or 0)


def part_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v, w, ov: from the part of a line to that of the order's next line, turned where the line
    was returned; oriented vertices are 2 * part + (1 if turned)."""
    line = table(spark, sf_dir, "lineitem").select(*_LINE, "l_quantity", (F.col("l_returnflag") == "R").cast("long").alias("turn"))
    order = Window.partitionBy("l_orderkey").orderBy(*_LINE[1:])
    v = F.col("l_partkey") * 2 + F.col("turn")
    arcs = line.select(v.alias("v"), F.lead(v).over(order).alias("w"), F.col("l_quantity").cast("long").alias("ov"))
    return arcs.where("w IS NOT NULL").groupBy("v", "w").agg(F.min("ov").alias("ov"))


ARCS_SQL = """
arcs AS (
  SELECT v, w, min(ov) AS ov FROM (
    SELECT v, lead(v) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) AS w, ov FROM (
      SELECT *, l_partkey * 2 + CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS v, l_quantity::BIGINT AS ov FROM lineitem))
  WHERE w IS NOT NULL GROUP BY v, w)"""


def sparse_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v, w, ov: a sparse graph of customers and orders, from each order to the customer's next one;
    oriented vertices are 2 * order + (1 if its status is F)."""
    o = table(spark, sf_dir, "orders")
    v = F.col("o_orderkey") * 2 + (F.col("o_orderstatus") == "F").cast("long")
    order = Window.partitionBy(F.col("o_custkey") % 997).orderBy("o_orderdate", "o_orderkey")
    nxt = o.select(v.alias("v"), F.lead(v).over(order).alias("w"), F.lit(0).cast("long").alias("ov"))
    skip = o.where("o_orderkey % 7 = 0").select(v.alias("v"), (F.floor(F.col("o_orderkey") / 14) * 2).alias("w"), F.lit(0).cast("long").alias("ov"))
    real = o.select((F.col("o_orderkey") * 2).alias("w"))
    return nxt.where("w IS NOT NULL").unionByName(skip.join(real, "w", "left_semi").select("v", "w", "ov")).where("(v div 2) <> (w div 2)").distinct()


SPARSE_SQL = """
sparse AS (
  SELECT DISTINCT * FROM (
    SELECT v, lead(v) OVER (PARTITION BY c ORDER BY o_orderdate, o_orderkey) AS w, 0::BIGINT AS ov FROM (
      SELECT o_orderkey * 2 + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS v, o_custkey % 997 AS c, o_orderdate, o_orderkey FROM orders)
    UNION ALL
    SELECT o_orderkey * 2 + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, (o_orderkey // 14) * 2, 0 FROM orders
    WHERE o_orderkey % 7 = 0 AND o_orderkey // 14 IN (SELECT o_orderkey FROM orders))
  WHERE w IS NOT NULL AND v // 2 <> w // 2)"""


def placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part, beg, end: where lines lie on their part, which has p_size * 10 places; what is beyond is cut."""
    line = table(spark, sf_dir, "lineitem").select("l_partkey", (F.col("l_linenumber") * 5).cast("long").alias("beg"), F.col("l_quantity").cast("long").alias("q"))
    part = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 10).cast("long").alias("n"))
    return line.join(part, line["l_partkey"] == part["p_partkey"]).select(F.col("p_partkey").alias("part"), "n", "beg", F.least(F.col("beg") + F.col("q"), F.col("n")).alias("end")).where("beg < n")


PLACEMENTS_SQL = """
placed AS (
  SELECT p_partkey AS part, n, beg, least(beg + q, n) AS "end" FROM (
    SELECT p_partkey, p_size::BIGINT * 10 AS n, l_linenumber::BIGINT * 5 AS beg, l_quantity::BIGINT AS q FROM lineitem JOIN part ON l_partkey = p_partkey)
  WHERE beg < n)"""


def cigars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct CIGARs made of line numbers and quantities, with a place and a strand."""
    q, n, z = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long"), F.col("l_suppkey")
    text = F.concat(n.cast("string"), F.lit("S"), q.cast("string"), F.lit("M"), n.cast("string"), F.lit("I"), (q % 5 + 1).cast("string"), F.lit("="), (z % 4 + 1).cast("string"), F.lit("D"), (q % 3 + 1).cast("string"), F.lit("X"), (n + 2).cast("string"), F.lit("N"), (z % 9 + 1).cast("string"), F.lit("M"), (n % 2 + 1).cast("string"), F.lit("H"))
    return table(spark, sf_dir, "lineitem").select(text.alias("cigar"), (F.col("l_partkey") % 1000).alias("pos"), (F.col("l_returnflag") == "R").alias("rev")).distinct()


CIGARS_SQL = """
cig AS (
  SELECT DISTINCT n || 'S' || q || 'M' || n || 'I' || (q % 5 + 1) || '=' || (z % 4 + 1) || 'D' || (q % 3 + 1) || 'X' || (n + 2) || 'N' || (z % 9 + 1) || 'M' || (n % 2 + 1) || 'H' AS cigar, pos, rev FROM (
    SELECT l_linenumber::BIGINT AS n, l_quantity::BIGINT AS q, l_suppkey AS z, l_partkey % 1000 AS pos, l_returnflag = 'R' AS rev FROM lineitem)),
cops AS (
  SELECT cigar, pos, rev, list_transform(regexp_extract_all(cigar, '[0-9]+[A-Z=]'), lambda x: {'len': x[:-2]::BIGINT, 'op': x[-1]}) AS ops FROM cig)"""


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """name, seq: what letters A, C, G, T documents hold, and N, an unknown base, for each K."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"), F.regexp_replace(F.translate(F.upper("text"), "NK", "_N"), "[^ACGTN]+", "").alias("seq"))


SEQUENCES_SQL = "seqs AS (SELECT doc_id AS name, regexp_replace(translate(upper(text), 'NK', '_N'), '[^ACGTN]', '', 'g') AS seq FROM documents)"
BENCH_SEQUENCES_SQL = "bseqs AS (SELECT item_id AS name, regexp_replace(translate(upper(text), 'NK', '_N'), '[^ACGTN]', '', 'g') AS seq FROM benchmark)"


def benchmark_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("name"), F.regexp_replace(F.translate(F.upper("text"), "NK", "_N"), "[^ACGTN]+", "").alias("seq"))


def ladder_arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """v, w: chains of orders with places where two ways part and meet again: a diamond, then a way
    round two orders, every eight orders."""
    o = table(spark, sf_dir, "orders")
    v = F.col("o_orderkey") * 2 + (F.col("o_orderstatus") == "F").cast("long")
    order = Window.partitionBy(F.col("o_custkey") % 97).orderBy("o_orderdate", "o_orderkey")
    at = o.select(v.alias("v"), ((F.row_number().over(order) - 1) % 8).alias("r"), *[F.lead(v, n).over(order).alias(f"w{n}") for n in (1, 2, 3)])
    ahead = F.when(F.col("r") == 0, F.array("w1", "w2")).when(F.col("r") == 1, F.array("w2")).when(F.col("r") == 3, F.array("w1", "w3")).otherwise(F.array("w1"))
    return at.select("v", F.explode(ahead).alias("w")).where("w IS NOT NULL")


LADDER_SQL = """
ladder AS (
  SELECT v, w FROM (
    SELECT v, unnest(CASE r WHEN 0 THEN [w1, w2] WHEN 1 THEN [w2] WHEN 3 THEN [w1, w3] ELSE [w1] END) AS w FROM (
      SELECT v, (row_number() OVER x - 1) % 8 AS r, lead(v) OVER x AS w1, lead(v, 2) OVER x AS w2, lead(v, 3) OVER x AS w3 FROM (
        SELECT o_orderkey * 2 + CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS v, o_custkey % 97 AS c, o_orderdate, o_orderkey FROM orders) WINDOW x AS (PARTITION BY c ORDER BY o_orderdate, o_orderkey)))
  WHERE w IS NOT NULL)"""
