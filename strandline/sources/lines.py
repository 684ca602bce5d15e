"""Lines of text files with their order, and what all line formats share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, ord: lines without line ends; ord rises along each file."""
    return spark.read.text(path).select("value", F.monotonically_increasing_id().alias("ord"))


def records(rows: DataFrame) -> DataFrame:
    """Of lines (value, ord) those that are neither blank nor comments."""
    return rows.where((F.trim("value") != "") & ~F.startswith(F.ltrim("value"), F.lit("#")))


def numbered(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, file, n: lines and their number, from 0, in their file. Files are split as Spark likes;
    one row for each part of a file tells how many lines come before it."""
    rows = lines(spark, path).withColumn("file", F.input_file_name()).withColumn("part", F.shiftright("ord", 33))
    parts = rows.groupBy("file", "part").agg(F.count(F.lit(1)).alias("lines"), F.min("ord").alias("first"))
    before = F.sum("lines").over(Window.partitionBy("file").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("lines")
    starts = parts.select(F.col("file").alias("_f"), F.col("part").alias("_p"), "first", before.alias("before"))
    return rows.join(F.broadcast(starts), (F.col("file") == F.col("_f")) & (F.col("part") == F.col("_p"))).select("value", "file", (F.col("ord") - F.col("first") + F.col("before")).alias("n"))


def tags(fields: Column) -> Column:
    """A map of KEY to struct(type, value) from fields KEY:type:value; the first of a key counts."""
    ok = F.filter(fields, lambda x: F.rlike(x, F.lit("^[A-Za-z][A-Za-z0-9]:.:")))
    key = lambda x: F.substring(x, 1, 2)
    # Zipped by key, each distinct one with the place of its first field.
    names = F.transform(ok, key)
    first = F.array_distinct(names)
    value = F.transform(first, lambda k: F.get(ok, (F.array_position(names, k) - 1).cast("int")))
    return F.map_from_arrays(first, F.transform(value, lambda x: F.struct(F.substring(x, 4, 1).alias("type"), F.substr(x, F.lit(6)).alias("value"))))


def tag(of: Column, key: str) -> Column:
    return F.try_element_at(of, F.lit(key))["value"]


def without_tags(of: Column, *keys: str) -> Column:
    return F.map_filter(of, lambda k, _: ~k.isin(*keys))


def with_tag(of: Column, key: str, kind: str, value: Column) -> Column:
    """``of`` with a tag at its end, instead of one of the same key."""
    return F.map_concat(without_tags(of, key), F.create_map(F.lit(key), F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"))))


def u32(text: Column) -> Column:
    """A whole number of 32 bits without sign, or null."""
    n = F.when(F.rlike(text, F.lit("^[0-9]{1,10}$")), text.cast("long"))
    return F.when(n <= 0xFFFFFFFF, n)


def tag_text(of: Column) -> Column:
    """Tags as tab-separated KEY:type:value, '' for none."""
    return F.array_join(F.transform(F.map_entries(of), lambda e: F.concat(e["key"], F.lit(":"), e["value"]["type"], F.lit(":"), e["value"]["value"])), "\t")


def rest(fields: Column, n: int) -> Column:
    return F.slice(fields, F.lit(n + 1), F.greatest(F.size(fields) - n, F.lit(0)))


def write_lines(df: DataFrame, path: str, order: list | None = None) -> None:
    """Write the one string column; gzip where the path ends in .gz."""
    out = df.orderBy(*order).select(df.columns[0]) if order else df
    out.write.mode("overwrite").option("compression", "gzip" if path.endswith(".gz") else "none").text(path)
