"""References to records that do not exist, are deleted, or arrive later.

Keys are cut into ranges of RANGE consecutive values, so a range never holds more than RANGE parents however many rows
the table has. Each range keeps its parents as one sorted array. References travel to their range, hot ranges spread
over several salts, and are probed batch by batch with a binary search; parents of a range precede its references in the
sorted partition, so a task holds one array and one batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenix.operators.skew import hot_hashes, salt_all, salt_many

#: Consecutive key values to a range: the most parents one array can hold.
RANGE = 8_192

_OUT = "ref_table string, ref_column string, row_id bigint, target_id bigint, at timestamp_ntz, missing boolean, deleted boolean, later boolean"
_NONE = np.iinfo(np.int64).min


def parents(items: DataFrame, deletions: DataFrame) -> DataFrame:
    """(key, since, deleted): one row per present item or key with an open deletion.

    ``since`` is the earliest ingested_at (null if unknown), ``present`` whether the item table has the key, ``deleted``
    whether a deletion without restored_at names it.
    """
    here = items.select(F.col("id").alias("key"), F.col("ingested_at").cast("timestamp_ntz").alias("since"), F.lit(True).alias("present"), F.lit(False).alias("deleted"))
    gone = deletions.where(F.col("restored_at").isNull()).select(F.col("media_id").alias("key"), F.lit(None).cast("timestamp_ntz").alias("since"), F.lit(False).alias("present"), F.lit(True).alias("deleted"))
    both = here.unionByName(gone).where(F.col("key").isNotNull())
    return both.groupBy("key").agg(F.min("since").alias("since"), F.max("present").alias("present"), F.max("deleted").alias("deleted"))


def reference_rows(df: DataFrame, name: str, row_id: str, columns: list[str], at: str) -> DataFrame:
    """(ref_table, ref_column, row_id, key, at): the non-null references of a table, each record once."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("ref_column"), F.col(c).alias("key")) for c in columns])).alias("r")
    rows = df.select(F.col(row_id).alias("row_id"), F.col(at).cast("timestamp_ntz").alias("at"), pairs).where(F.col("r.key").isNotNull())
    one = rows.groupBy("row_id", "r.ref_column", "r.key").agg(F.min("at").alias("at"))
    return one.select(F.lit(name).alias("ref_table"), "ref_column", "row_id", "key", "at")


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    where, keys, since, flags = None, np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "i1")
    for batch in batches:
        t = pa.Table.from_batches([batch])
        ranges, blob = t["range"].to_numpy(), t["keys"]
        has = np.flatnonzero(~np.asarray(blob.is_null()))
        cuts = np.flatnonzero(np.diff(ranges)) + 1
        starts = np.unique(np.concatenate(([0], cuts, has, has + 1)))
        starts = starts[starts < len(ranges)]
        for a, b in zip(starts, [*starts[1:], len(ranges)]):
            if blob[int(a)].is_valid:
                where = ranges[a]
                keys = np.array(t["keys"][int(a)].as_py(), "i8")
                since = np.array(t["since"][int(a)].as_py(), "i8")
                flags = np.array(t["flags"][int(a)].as_py(), "i1")
                order = np.argsort(keys, kind="stable")
                keys, since, flags = keys[order], since[order], flags[order]
                continue
            refs = t.slice(a, b - a)
            wanted = refs["key"].to_numpy()
            if where != ranges[a]:  # no parent at all in this range
                where, keys, since, flags = ranges[a], np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0, "i1")
            if len(keys):
                pos = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
                found = keys[pos] == wanted
                flag, begin = np.where(found, flags[pos], 0), np.where(found, since[pos], _NONE)
            else:
                flag, begin = np.zeros(len(wanted), "i1"), np.full(len(wanted), _NONE)
            at = refs["at"].cast(pa.timestamp("us")).cast(pa.int64()).fill_null(_NONE).to_numpy()
            missing, deleted = (flag & 1) == 0, (flag & 2) != 0
            later = (begin != _NONE) & (at != _NONE) & (begin > at)
            bad = missing | deleted | later
            if bad.any():
                hit = refs.filter(pa.array(bad))
                yield from pa.table({
                    "ref_table": hit["ref_table"], "ref_column": hit["ref_column"], "row_id": hit["row_id"], "target_id": hit["key"], "at": hit["at"].cast(pa.timestamp("us")),
                    "missing": missing[bad], "deleted": deleted[bad], "later": later[bad]}).combine_chunks().to_batches()


def orphans(refs: DataFrame, parent: DataFrame) -> DataFrame:
    """The references that do not hold, with the reasons: missing, deleted, later (arrives after the reference).

    ``refs`` as from :func:`reference_rows`, ``parent`` as from :func:`parents`. A null ``at`` or ``since`` is never
    "later". No references give no rows; without parents every reference is missing.
    """
    span = lambda c: F.expr(f"{c} div {RANGE} - if({c} < 0 and {c} % {RANGE} != 0, 1, 0)")
    asked = refs.withColumn("range", span("key"))
    packed = parent.withColumn("range", span("key")).groupBy("range").agg(F.collect_list(F.struct(
        "key", F.coalesce(F.unix_micros(F.col("since").cast("timestamp")), F.lit(_NONE)).alias("since"),
        (F.when(F.col("present"), 1).otherwise(0) + F.when(F.col("deleted"), 2).otherwise(0)).cast("tinyint").alias("flags"))).alias("p"))
    hot = hot_hashes(asked, "range")
    asked = salt_many(asked, "range", hot).withColumnRenamed("_salt", "salt") if hot else asked.withColumn("salt", F.lit(0))
    packed = salt_all(packed, "range", hot).withColumnRenamed("_salt", "salt") if hot else packed.withColumn("salt", F.lit(0))
    cols = ["range", "salt"]
    none = lambda kind: F.lit(None).cast(kind)
    rows = asked.select(*cols, "ref_table", "ref_column", "row_id", "key", "at", none("array<bigint>").alias("keys"), none("array<bigint>").alias("since"), none("array<tinyint>").alias("flags"))
    arrays = packed.select(*cols, none("string").alias("ref_table"), none("string").alias("ref_column"), none("bigint").alias("row_id"), F.lit(0).cast("bigint").alias("key"), none("timestamp_ntz").alias("at"),
                           F.col("p.key").alias("keys"), F.col("p.since").alias("since"), F.col("p.flags").alias("flags"))
    both = rows.unionByName(arrays).repartition(*cols).sortWithinPartitions("range", "salt", F.isnull("keys"))
    return both.mapInArrow(_probe, _OUT)


def media_orphans(items: DataFrame, deletions: DataFrame, relationships: DataFrame, keyframes: DataFrame) -> DataFrame:
    """Bad references of media_relationships (source_id, target_id) and keyframes (media_id) to media items."""
    refs = reference_rows(relationships, "media_relationships", "id", ["source_id", "target_id"], "created_at").unionByName(
        reference_rows(keyframes, "keyframes", "id", ["media_id"], "extracted_at"))
    return orphans(refs, parents(items, deletions))


def by_month(bad: DataFrame) -> DataFrame:
    """Bad references per table, column and month of the reference; ``month`` is null where its time is unknown."""
    month = F.date_format("at", "yyyy-MM")
    count = lambda c: F.count_if(F.col(c)).alias(f"n_{c}")
    return bad.groupBy("ref_table", "ref_column", month.alias("month")).agg(F.count(F.lit(1)).alias("n_bad"), count("missing"), count("deleted"), count("later"))
