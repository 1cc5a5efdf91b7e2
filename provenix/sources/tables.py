"""Readers. Every reader leaves column pruning and filter push-down to the Parquet scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One table of a data folder (a Parquet file or a folder of them)."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def once_by_id(df: DataFrame, key: str, *columns: str) -> DataFrame:
    """One row per ``key`` with the named columns; a record delivered twice counts once.

    Repeated rows are equal in full by contract. Should they differ, the column-wise smallest struct is kept, so the
    result is the same in every run. Rows with a null key are dropped. The aggregation combines on the map side.
    """
    if not columns:
        return df.select(key).where(F.col(key).isNotNull()).distinct()
    packed = F.min(F.struct(*[F.col(c) for c in columns])).alias("_r")
    return (
        df.select(key, *columns).where(F.col(key).isNotNull()).groupBy(key).agg(packed)
        .select(key, *[F.col(f"_r.{c}").alias(c) for c in columns])
    )
