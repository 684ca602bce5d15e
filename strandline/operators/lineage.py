"""Cutting the lineage of loops."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def once(df: DataFrame, *columns: Column | str) -> DataFrame:
    """``df.select(*columns)``, each computed once a row. What reads them later (a filter, above all)
    would get a copy of their expressions, which costs where they parse text; it doesn't pass a generator."""
    return df.select(F.explode(F.array(F.struct(*columns))).alias("_once")).select("_once.*")


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once, its plan replaced by the result.

    A loop that uses its last result several times would double its plan each round. The result
    is written to the session's checkpoint folder, which executors share, so a lost executor loses
    nothing; only where the session names none (tests) a temporary folder is set.
    """
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="checkpoint-"))
    return df.checkpoint(eager=True)
