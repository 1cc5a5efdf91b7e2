"""What several query modules share: the media table with each record once, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenix.sources.tables import table

_FLAT = {"width": "metadata_sig.width", "height": "metadata_sig.height", "format": "metadata_sig.format", "exif": "metadata_sig.exif"}


def items(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    """The named columns of each media item once; width, height, format and exif are taken out of metadata_sig."""
    raw = table(spark, folder, "media_items").where("id is not null")
    picked = raw.select("id", *[F.col(_FLAT.get(c, c)).alias(c) for c in columns])
    return picked.dropDuplicates(["id"])


def mi(*columns: str) -> str:
    """SQL: WITH mi AS (the same)."""
    cols = ", ".join(f"{_FLAT[c]} AS {c}" if c in _FLAT else c for c in columns)
    return f"WITH mi AS (SELECT DISTINCT ON (id) id{', ' if cols else ''}{cols} FROM media_items WHERE id IS NOT NULL)"
