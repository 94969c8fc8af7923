"""Unions, differences and comparisons of whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_segments(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b, allowMissingColumns=True)


def except_keys(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    return a.select(*keys).join(b.select(*keys), keys, "left_anti").distinct()


def set_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of one set only, tagged with the side; empty if and only if the sets are equal."""
    return a.subtract(b).withColumn("side", F.lit("left")).unionByName(b.subtract(a).withColumn("side", F.lit("right")))


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.intersect(b)


def corpus_union_check(parts: list[DataFrame], whole: DataFrame) -> DataFrame:
    """What tells the union of parts from the whole."""
    union = parts[0]
    for p in parts[1:]:
        union = union.unionByName(p)
    return set_diff(union.distinct(), whole.distinct())


def version_line_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, line, mark, n): lines gone (-) and come (+), with how many times, between two versions of a text."""

    def counted(df: DataFrame, sign: int) -> DataFrame:
        lines = df.select(key, F.explode(F.split("text", "\n", -1)).alias("line"))
        return lines.groupBy(key, "line").agg((F.count("*") * sign).alias("n"))

    net = counted(old, -1).unionByName(counted(new, 1)).groupBy(key, "line").agg(F.sum("n").alias("n")).where("n <> 0")
    return net.select(key, "line", F.when(F.col("n") > 0, "+").otherwise("-").alias("mark"), F.abs("n").alias("n"))
