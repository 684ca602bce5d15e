"""FASTA and FASTQ."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .lines import numbered, write_lines


def read_fasta(spark: SparkSession, path: str | list[str], upper: bool = False) -> DataFrame:
    """name, seq: records end where the next '>' begins a line; the name ends at white space."""
    rows = spark.read.option("lineSep", "\n>").text(path).where("trim(value) <> ''")
    text = F.regexp_replace("value", "^>", "")
    seq = F.regexp_replace(F.regexp_replace(text, r"^[^\n]*", ""), r"\s", "")
    return rows.select(F.regexp_extract(text, r"^(\S*)", 1).alias("name"), (F.upper(seq) if upper else seq).alias("seq"))


def read_fastq(spark: SparkSession, path: str | list[str], upper: bool = False) -> DataFrame:
    """name, seq, qual of four-line records; a quality line that begins with '@' starts no record.
    Lines are told by their number in the file, so files are split however large they are."""
    rows = numbered(spark, path)
    at = F.col("n") % 4
    four = rows.groupBy("file", F.floor(F.col("n") / 4).alias("record")).agg(*[F.max(F.when(at == i, F.rtrim("value", F.lit("\r")))).alias(c) for i, c in ((0, "head"), (1, "seq"), (3, "qual"))])
    whole = four.where(F.startswith("head", F.lit("@")) & F.col("qual").isNotNull())
    return whole.select(F.regexp_extract("head", r"^@(\S*)", 1).alias("name"), (F.upper("seq") if upper else F.col("seq")).alias("seq"), "qual")


def fasta_lines(seqs: DataFrame, wrap: int = 60) -> DataFrame:
    """line: a record of each name and seq, in lines of ``wrap`` characters, 0 for one line each."""
    body = F.rtrim(F.regexp_replace("seq", f"(.{{{wrap}}})", "$1\n"), F.lit("\n")) if wrap else F.col("seq")
    return seqs.select(F.concat(F.lit(">"), F.col("name"), F.lit("\n"), body).alias("line"))


def write_fasta(seqs: DataFrame, path: str, wrap: int = 60) -> None:
    write_lines(fasta_lines(seqs, wrap), path)
