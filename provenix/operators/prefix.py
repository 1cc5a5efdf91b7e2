"""Running totals over a whole table without a window in a single partition."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from provenix.session import cut

#: Ranges of values whose totals are summed on their own; bounds the only unpartitioned window.
RANGES = 512


def cumulative(df: DataFrame, value: str, *sums: str) -> DataFrame:
    """``df``, one row per ``value``, with ``c_<sum>``: the total of each column over all rows up to and with this value.

    Values are cut into RANGES ranges at approximate quantiles (where exactly changes nothing in the result); totals are
    summed over the ranges first, then within each range.
    """
    df = cut(df)
    at = df.approxQuantile(value, [i / RANGES for i in range(1, RANGES)], 0.001) if df.limit(RANGES + 1).count() > RANGES else []
    edges = sorted(set(at))
    place = F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: e < F.col(value))) if edges else F.lit(0)
    ranged = df.withColumn("_range", place)
    totals = ranged.groupBy("_range").agg(*[F.sum(s).alias(s) for s in sums])
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # at most RANGES rows
    base = totals.select("_range", *[F.coalesce(F.sum(s).over(before), F.lit(0)).alias(f"b_{s}") for s in sums])
    upto = Window.partitionBy("_range").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    out = ranged.join(F.broadcast(base), "_range")
    return out.select(*df.columns, *[(F.sum(s).over(upto) + F.col(f"b_{s}")).alias(f"c_{s}") for s in sums])
