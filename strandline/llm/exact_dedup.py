"""Operator 2: exact deduplication by skew-safe combining. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, release

#: Rows that one salt is meant for, if a single text filled the whole table.
ROWS_PER_SALT = 1_000_000


def normalised(text: Column) -> Column:
    """The text that is compared: null as empty, each run of white space as one space."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n_salts: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Three combining steps, all grouping by digest *and* full text, so that equal digests of
    different texts stay apart:

    1. locally, before the first shuffle, each task merges its equal texts;
    2. the salted groups (digest, text, salt of the id) merge, so a text that fills a third of the
       table is met by ``n_salts`` tasks, none of which sees more than its share;
    3. the salt winners, at most ``n_salts`` a text, merge globally.

    Members then learn their group through the winner of their salt, joined on digest and winner.

    Null texts equal the empty text. Null ids take part and lose to any other; where a group has
    only null ids, keep_id is null. Rows that repeat an id and a text count each, and one of them
    is kept. An empty table gives no rows. Other columns are not looked at.
    """
    salts = n_salts or max(16, -(-docs.count() // ROWS_PER_SALT))
    rows = (
        docs.select(F.col(id_col).cast("long").alias("i"), normalised(F.col(text_col)).alias("t"))
        .withColumn("h", F.sha2("t", 256))
        .withColumn("s", F.pmod(F.xxhash64("i"), F.lit(salts)).cast("int"))
    )
    salted = rows.groupBy("h", "s", "t").agg(
        F.sort_array(F.collect_list(F.struct(F.col("i").isNull().alias("no"), F.col("i").alias("i")))).alias("ids")
    ).withColumn("w", F.col("ids")[0]["i"])
    winners = salted.groupBy("h", "t").agg(
        F.min("w").alias("keep_id"),
        F.sum(F.size("ids")).cast("long").alias("group_size"),
        F.collect_list(F.struct("w")).alias("ws"),
    ).select("h", "keep_id", "group_size", F.explode("ws").alias("x")).select("h", "keep_id", "group_size", F.col("x.w").alias("wk"))
    members = salted.select(F.col("h").alias("mh"), F.col("w").alias("mw"), F.posexplode("ids").alias("pos", "m"))
    return members.join(winners, (F.col("mh") == F.col("h")) & F.col("mw").eqNullSafe(F.col("wk"))).select(
        F.col("m.i").alias("doc_id"),
        "keep_id",
        "group_size",
        ((F.col("pos") == 0) & F.col("mw").eqNullSafe(F.col("keep_id"))).alias("kept"),
        F.col("h").alias("text_sha256"),
    )


def kept_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``exact_dedup`` keeps, all columns, one row for each text.

    Survivors are found by id and digest. Ids are expected to be present and one row each; of rows
    that repeat both id and text, one stays.
    """
    key = lambda i, h: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("")), h)
    keep = cut(exact_dedup(docs, id_col, text_col).where("kept").select(key(F.col("doc_id"), F.col("text_sha256")).alias("_own_k")))
    release(docs.sparkSession)  # the texts that were shuffled to find them
    marked = docs.withColumn("_own_k", key(F.col(id_col), F.sha2(normalised(F.col(text_col)), 256)))
    # One key for both, so that rows are dealt out once.
    return marked.join(keep, "_own_k", "left_semi").dropDuplicates(["_own_k"]).drop("_own_k")


SQL = """
SELECT doc_id,
       min(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept,
       sha256(t) AS text_sha256
FROM (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents)
"""
