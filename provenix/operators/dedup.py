"""Exact and order-dependent deduplication."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenix.functions import hashing
from provenix.session import cut


def keep_first(df: DataFrame, key: Column, order: str) -> DataFrame:
    """The row of smallest ``order`` for each key; only keys and order travel, and only first ones after the map side."""
    first = df.groupBy(key.alias("_k")).agg(F.min(order).alias(order)).select(order)
    return df.join(first, order, "left_semi")


def close_codes(codes: DataFrame, radius: int) -> DataFrame:
    """(a, b): pairs a < b of different 64-bit codes within ``radius`` bits.

    The code is cut into ``radius + 1`` blocks, of which two near codes share one; a pair counts in its first block only.
    """
    n = radius + 1
    cut_at = [64 * i // n for i in range(n + 1)]
    block = lambda c, k: F.shiftrightunsigned(c, cut_at[k]).bitwiseAND(F.lit((1 << (cut_at[k + 1] - cut_at[k])) - 1))
    keyed = codes.select("code", F.posexplode(F.array(*[block(F.col("code"), k) for k in range(n)])).alias("k", "v"))
    other = keyed.select(F.col("code").alias("b"), "k", "v")
    j = keyed.withColumnRenamed("code", "a").join(other, ["k", "v"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius))
    earlier = F.lit(False)
    for k in range(n):
        earlier = earlier | ((F.col("k") > k) & (block(F.col("a"), k) == block(F.col("b"), k)))
    return j.where(~earlier).select("a", "b")


def greedy_near(df: DataFrame, order: str, hash_: str, radius: int) -> DataFrame:
    """(order, kept): in order, each row is kept unless its hash is within ``radius`` bits of a kept one; unusable hashes are kept.

    The first row of each code decides for the code. A code is settled once all earlier near codes are: kept if none of
    them is, dropped if one is. Rounds settle many codes at once and end when none is open; chains of near codes take as
    many rounds as they are long.
    """
    rows = cut(df.select(F.col(order).alias("o"), hashing.code(hash_).alias("code")))
    first = cut(rows.where("code is not null").groupBy("code").agg(F.min("o").alias("o")))
    near = close_codes(first.select("code"), radius)
    both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    rank = lambda c, o: first.select(F.col("code").alias(c), F.col("o").alias(o))
    edges = cut(both.join(rank("a", "oa"), "a").join(rank("b", "ob"), "b").where("ob < oa").select("a", "b"))  # b comes before a
    open_ = cut(first.select("code"))
    kept = dropped = None
    while open_.limit(1).count():
        waiting = edges.join(open_.withColumnRenamed("code", "a"), "a", "left_semi").join(open_.withColumnRenamed("code", "b"), "b", "left_semi")
        free = open_.join(waiting.select(F.col("a").alias("code")).distinct(), "code", "left_anti")
        kept = cut(free if kept is None else kept.unionByName(free))
        lose = edges.join(kept.withColumnRenamed("code", "b"), "b", "left_semi").select(F.col("a").alias("code")).distinct()
        dropped = cut(lose)
        open_ = cut(open_.join(kept, "code", "left_anti").join(dropped, "code", "left_anti"))
    if kept is None:
        return rows.select(F.col("o").alias(order), F.lit(True).alias("kept"))
    winners = first.join(kept, "code", "left_semi").select("o", F.lit(True).alias("w"))
    return rows.join(winners, "o", "left").select(F.col("o").alias(order), (F.col("code").isNull() | F.coalesce("w", F.lit(False))).alias("kept"))


