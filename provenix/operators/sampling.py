"""Samples, splits, ranks and top rows per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(df: DataFrame, by: list[str], order: list[Column], n: int, salts: int = 16) -> DataFrame:
    """The first ``n`` rows of each group; cut within salted parts first, so no group meets whole in one task."""
    salted = df.withColumn("_salt", F.spark_partition_id() % salts)
    first = salted.withColumn("_r", F.row_number().over(Window.partitionBy(*by, "_salt").orderBy(*order))).where(F.col("_r") <= n)
    return first.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_r") <= n).drop("_r", "_salt")


def mean_ranks(df: DataFrame, group: str, value: str) -> DataFrame:
    """``df`` with ``mean_rank``: rank of the value in its group, ties sharing the mean; nulls rank as the greatest."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(group).orderBy(F.asc_nulls_last(value)).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select(F.col(group).alias("_g"), F.col(value).alias("_v"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) + 1 + (F.col("_n") - 1) / 2).alias("mean_rank"))
    return df.join(ranks, F.col(group).eqNullSafe(F.col("_g")) & F.col(value).eqNullSafe(F.col("_v")), "left").drop("_g", "_v")


def hash_split(df: DataFrame, key: Column, shares: dict[str, int], seed: int) -> DataFrame:
    """``df`` with ``part``: parts of the given per cent by a seeded hash of the key, so equal keys stay together."""
    bucket = F.conv(F.substring(F.md5(F.concat(F.lit(str(seed)), F.coalesce(key, F.lit("")))), 1, 8), 16, 10).cast("bigint") % 100
    names = list(shares)
    out, upto = F.lit(names[-1]), 100
    for name in reversed(names[:-1]):
        upto = sum(shares[n] for n in names[: names.index(name) + 1])
        out = F.when(bucket < upto, name).otherwise(out)
    return df.withColumn("part", out)
