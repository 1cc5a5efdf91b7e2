"""Vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def nonzero(v: Column | str) -> Column:
    """Whether any element differs from zero; null and empty arrays have none."""
    c = F.col(v) if isinstance(v, str) else v
    return F.coalesce(F.exists(c, lambda x: F.coalesce(x, F.lit(0.0)) != 0), F.lit(False))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two vectors; 0 for null, empty, unequal length, missing or not-a-number elements or zero norm."""
    x, y = (F.col(c) if isinstance(c, str) else c for c in (a, b))
    ok = (F.size(x) > 0) & (F.size(x) == F.size(y))
    # One pass over both: dot product and squared norms; a null or NaN element makes all of them useless.
    d = lambda e: F.coalesce(e.cast("double"), F.lit(float("nan")))
    zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("p"), F.lit(0.0).alias("q"))
    add = lambda s, e: F.struct((s["d"] + e["u"] * e["v"]).alias("d"), (s["p"] + e["u"] * e["u"]).alias("p"), (s["q"] + e["v"] * e["v"]).alias("q"))
    end = lambda s: F.when(~F.isnan(s["d"] + s["p"] + s["q"]) & (s["p"] > 0) & (s["q"] > 0), s["d"] / (F.sqrt(s["p"]) * F.sqrt(s["q"]))).otherwise(0.0)
    pairs = F.zip_with(x, y, lambda u, v: F.struct(d(u).alias("u"), d(v).alias("v")))
    return F.coalesce(F.when(ok, F.aggregate(pairs, zero, add, end)), F.lit(0.0))


def audio_similarity(has1: Column, frames1: Column, mean1: Column, has2: Column, frames2: Column, mean2: Column) -> Column:
    """Best alignment of two chroma profiles: the greatest mean frame cosine over all offsets of the shorter one.

    Frames of zero norm are left out of the mean. Without frames on a side the mean chromas are compared; without audio
    on a side the result is 0.
    """
    empty = F.coalesce((F.size(frames1) <= 0) | (F.size(frames2) <= 0), F.lit(True))
    first_longer = F.size(frames1) > F.size(frames2)
    long_, short = F.when(first_longer, frames1).otherwise(frames2), F.when(first_longer, frames2).otherwise(frames1)
    n = F.size(short)

    def at(offset: Column) -> Column:
        pairs = F.zip_with(F.slice(long_, offset + 1, n), short, lambda x, y: F.struct(cosine(x, y).alias("c"), (nonzero(x) & nonzero(y)).alias("ok")))
        kept = F.transform(F.filter(pairs, lambda p: p["ok"]), lambda p: p["c"])
        return F.when(F.size(kept) > 0, F.aggregate(kept, F.lit(0.0), lambda s, e: s + e) / F.size(kept)).otherwise(0.0)

    best = F.greatest(F.lit(0.0), F.array_max(F.transform(F.sequence(F.lit(0), F.size(long_) - n), at)))
    heard = F.coalesce(has1, F.lit(False)) & F.coalesce(has2, F.lit(False))
    return F.when(~heard, F.lit(0.0)).when(empty, cosine(mean1, mean2)).otherwise(best)
