"""Changes of a table as new snapshots: Parquet has no update in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def update(base: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """``base`` with the columns of ``change`` taken over where the key is in it; other keys of ``change`` are ignored."""
    cols = [c for c in change.columns if c != key]
    hit = change.select(key, *[F.col(c).alias(f"_{c}") for c in cols], F.lit(True).alias("_hit"))
    joined = base.join(hit, key, "left")
    return joined.select(*[F.when(F.col("_hit"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c) for c in base.columns])


def delete_keys(base: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """``base`` without the rows whose key is in ``keys``; null keys stay."""
    return base.join(keys.select(key).distinct(), key, "left_anti")


def replace_keys(base: DataFrame, fresh: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """The rows of the named keys replaced by ``fresh``."""
    return delete_keys(base, keys, key).unionByName(fresh.select(*base.columns))


def upsert(base: DataFrame, change: DataFrame, key: str) -> DataFrame:
    """``change`` wins over ``base`` by key; both have the same columns and each key once."""
    return replace_keys(base, change, change, key)
