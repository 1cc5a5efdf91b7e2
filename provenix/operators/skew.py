"""Equi-joins whose key may be hot: one key may hold a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows from which a key is hot, and about how many of its rows go to one salt: salts follow the size of the key.
HOT_ROWS = 50_000
#: Most hot keys: 16 MB on the driver and in a broadcast. The largest are taken, so every other key has less than
#: 1/MOST_HOT of all rows.
MOST_HOT = 1_000_000


def hot_keys(df: DataFrame, key: str, least: int | None = None) -> list[tuple[object, int]]:
    """The keys with more than ``least`` (else HOT_ROWS) rows, with their counts, largest first; at most MOST_HOT.

    Counted over all rows with a map-side combine.
    """
    counts = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    top = counts.where(F.col("_n") > (HOT_ROWS if least is None else least)).orderBy(F.desc("_n"), key).limit(MOST_HOT)
    return [(r[0], r[1]) for r in top.collect()]


def hot_hashes(df: DataFrame, key: str, least: int | None = None) -> list[tuple[int, int]]:
    """(hash, salts) of the hot keys, whatever their type; keys that share such a hash are merely salted along."""
    least = HOT_ROWS if least is None else least
    hashed = df.where(F.col(key).isNotNull()).select(F.xxhash64(F.col(key)).alias("_h"))
    return [(k, max(2, -(-n // max(1, least)))) for k, n in hot_keys(hashed, "_h", least)]


def _marked(df: DataFrame, key: str, hot: list[tuple[int, int]]) -> DataFrame:
    """``df`` with ``_salts``: how many salts the key of a row has, null if it is not hot."""
    table = df.sparkSession.createDataFrame(hot, "_hash bigint, _salts int")
    return df.withColumn("_hash", F.xxhash64(F.col(key))).join(F.broadcast(table), "_hash", "left").drop("_hash")  # at most MOST_HOT rows


def salt_many(df: DataFrame, key: str, hot: list[tuple[int, int]]) -> DataFrame:
    """``df`` with ``_salt``: one of the key's salts for rows of hot keys, 0 for others.

    The salt is a hash of the row, so a task that runs again after a loss deals its rows out alike.
    """
    hashed = [F.col(c) for c, kind in df.dtypes if "map<" not in kind and kind not in ("variant", "void")]
    salt = F.pmod(F.xxhash64(*hashed, F.lit(7)), F.coalesce("_salts", F.lit(1)))
    return _marked(df, key, hot).withColumn("_salt", salt.cast("int")).drop("_salts")


def salt_all(df: DataFrame, key: str, hot: list[tuple[int, int]]) -> DataFrame:
    """``df`` with ``_salt``: rows of hot keys once for each of the key's salts, others once with 0."""
    return _marked(df, key, hot).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1))).drop("_salts")


def salted_lookup(many: DataFrame, one: DataFrame, key: str, how: str = "left", hot: list[tuple[int, int]] | None = None) -> DataFrame:
    """Join ``many`` with ``one`` on ``key`` where ``one`` has each key once.

    Rows of a hot key in ``many`` are spread over one salt per HOT_ROWS of them and the single row of ``one`` is repeated
    as often; all other rows join as usual. Null keys find nothing. ``many`` is never repeated or dropped. ``hot`` are the
    hot keys as from :func:`hot_hashes`, if known.
    """
    hot = hot_hashes(many, key) if hot is None else hot
    if not hot:
        return many.join(one, key, how)
    return salt_many(many, key, hot).join(salt_all(one, key, hot), [key, "_salt"], how).drop("_salt")


def salted_pairs(left: DataFrame, right: DataFrame, key: str, condition=None, hot: list[tuple[int, int]] | None = None) -> DataFrame:
    """left join right on ``key`` where both sides may repeat it; hot keys of ``left`` are spread over their salts.

    Rows of ``left`` are dealt to one salt each, those of ``right`` with a hot key go to all salts, so every pair meets
    exactly once. The columns of both sides but the key must differ. ``hot`` are the hot keys of ``left``, if known; a
    left side of at most HOT_ROWS rows has none.
    """
    hot = hot_hashes(left, key) if hot is None else hot
    if not hot:
        out = left.join(right, key)
    else:
        out = salt_many(left, key, hot).join(salt_all(right, key, hot), [key, "_salt"]).drop("_salt")
    return out if condition is None else out.where(condition)


def spread(df: DataFrame, *columns: str, partitions: int | None = None) -> DataFrame:
    """``df`` hashed by the columns over ``partitions`` (else ``spark.sql.shuffle.partitions``), which are not merged afterwards.

    For stages that compute much per row: merging partitions by their bytes would leave a few long tasks.
    """
    return df.repartition(partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
