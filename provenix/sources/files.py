"""File formats, directory scans and predicates on paths."""

from __future__ import annotations

from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions of pictures.
PICTURES = ("jpg", "jpeg", "png", "webp", "tif", "tiff")


def extension(path: str) -> Column:
    """Lower-case extension of a path; empty if it has none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(path), F.lit("")), r"\.([A-Za-z0-9]+)$", 1))


def pictures(df: DataFrame, path: str) -> DataFrame:
    """The rows whose path ends like a picture's."""
    return df.where(extension(path).isin(*PICTURES))


def binary_files(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, modificationTime, length, content) of the pictures below a folder that are not empty; content is read only if selected."""
    glob = "*.{" + ",".join(x for e in PICTURES for x in (e, e.upper())) + "}"
    return spark.read.format("binaryFile").option("recursiveFileLookup", recursive).option("pathGlobFilter", glob).load(folder)


def digests(binary: DataFrame) -> DataFrame:
    """(path, length, sha256) of files."""
    return binary.select("path", "length", F.sha2("content", 256).alias("sha256"))


def optional(df: DataFrame, **wanted: object) -> DataFrame:
    """``df`` filtered by the given values; None stands for no filter."""
    tests = [F.col(c) == v for c, v in wanted.items() if v is not None]
    return df.where(reduce(and_, tests)) if tests else df


def contains_any(needle: str, *columns: str) -> Column:
    """Whether any column contains the text, ignoring letter case; % and _ stand for themselves."""
    safe = needle.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return reduce(or_, [F.coalesce(F.col(c).ilike(f"%{safe}%"), F.lit(False)) for c in columns])


def round_trip(df: DataFrame, kind: str, path: str) -> DataFrame:
    """Write a table and read it back with its own schema: csv, json or parquet."""
    writer = df.write.mode("overwrite")
    reader = df.sparkSession.read.schema(df.schema)
    if kind == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
        return reader.option("header", True).option("escape", '"').csv(path)
    getattr(writer, kind)(path)
    return getattr(reader, kind)(path)
