"""What several operators of this subpackage share: table access, checkpoints, components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and written to the shared checkpoint folder, its lineage cut.

    The folder is the one the session names; only a session that names none (a test) gets a
    temporary one.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession) -> str:
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to a new Parquet table in the shared folder, and read again."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``stored`` gave."""
    spark = df.sparkSession
    jvm = spark.sparkContext._jvm
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if folder.rsplit("/", 1)[-1].startswith("table-"):
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let the driver drop shuffle and checkpoint files that nothing refers to any more.

    The gateway to the JVM hands dropped references over once a second, so it is waited for.
    """
    gc.collect()
    time.sleep(1.2)
    spark.sparkContext._jvm.System.gc()


def crc32_mod(doc_id: str, n: int) -> Column:
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % n


#: Edges of one node that a task takes; a node with more is dealt out to several.
HUB = 1 << 20


def _met(both: DataFrame, least: DataFrame) -> DataFrame:
    """Edges (u, v) with the ``m`` of their u; u's edges are dealt out to a task for each ``HUB`` of
    them (``least`` has their number n). Nodes with more go to every task: a row for each
    ``HUB`` edges at most."""
    tasks = F.ceil(F.col("n") / HUB).cast("int")
    hubs = least.where(F.col("n") > HUB).select(F.col("u").alias("hub"), tasks.alias("tasks"))
    dealt = both.join(F.broadcast(hubs), F.col("u") == F.col("hub"), "left").select("u", "v", F.when(F.col("hub").isNull(), 0).otherwise(F.pmod(F.xxhash64("v"), F.col("tasks"))).cast("int").alias("part"))
    return dealt.join(least.select("u", "m", F.explode(F.sequence(F.lit(0), tasks - 1)).alias("part")), ["u", "part"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of an undirected graph.

    edges: two long columns ``a`` and ``b``. Returns ``node`` and ``component``, the smallest node
    reachable; a node in no edge has no row. Null ends and loops are ignored.

    Alternating large-star and small-star steps: each round links every node's larger neighbours,
    then its smaller ones, to the least of them, which at least halves the depth of the trees.
    Every step is a ``min`` per node (combined before the shuffle) and one equi-join. The loop
    ends when the forest is a set of stars, which one count tells.
    """
    e = cut(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .where("a IS NOT NULL AND b IS NOT NULL AND u > v")
        .distinct()
    )
    for _ in range(max_rounds):
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n")).withColumn("m", F.least("m", "u"))
        large = (
            _met(both, least)
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u > v")
            .distinct()
        )
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = (
            _met(large, low)
            .select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .where("u > v")
            .distinct()
        )
        new = cut(small)
        # A forest of stars: every node has one parent, and no parent has a parent.
        heads = new.select(F.col("v").alias("u")).distinct()
        left = new.groupBy("u").count().where("count > 1").select("u").unionByName(new.select("u").join(heads, "u", "left_semi")).limit(1).count()
        e = new
        if not left:
            break
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
