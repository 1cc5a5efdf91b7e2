"""Families of media items: groups by stored cluster, their diagnostics, origins and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from provenix.functions import forensics
from provenix.operators.skew import salted_lookup

_GROUP = ["case_id", "cluster_id"]


def families(items: DataFrame) -> DataFrame:
    """Per case and cluster: size, earliest time, truncated mean integrity (90 if unknown) with its level, first name."""
    family = F.coalesce("cluster_id", F.lit("unclustered")).alias("family")
    g = items.groupBy("case_id", family).agg(F.count(F.lit(1)).alias("n_items"), F.min("created_at").alias("first_seen"), F.coalesce(F.avg("integrity_score"), F.lit(90.0)).cast("int").alias("confidence"), F.min_by("filename", "id").alias("first_name"))
    c = F.col("confidence")
    return g.withColumn("level", F.when(c >= 80, "High").when(c >= 60, "Medium").otherwise("Low"))


def diagnostics(matches: DataFrame, items: DataFrame, origin_confidence: int = 50) -> DataFrame:
    """Per cluster, over the matches within it: mean similarities, contamination (share of semantic below 0.75) and health."""
    side = lambda end, p: items.select(F.col("id").alias(end), F.col("case_id").alias(f"{p}_case"), F.col("cluster_id").alias(f"{p}_cluster"))
    e = salted_lookup(salted_lookup(matches, side("source_id", "s"), "source_id", how="inner"), side("target_id", "t"), "target_id", how="inner")
    e = e.where("s_case = t_case and s_cluster = t_cluster")
    g = e.groupBy(F.col("s_case").alias("case_id"), F.col("s_cluster").alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("n_matches"), F.coalesce(F.avg("visual_similarity"), F.lit(1.0)).alias("v"), F.coalesce(F.avg("semantic_similarity"), F.lit(1.0)).alias("m"), F.count_if(F.col("semantic_similarity") < 0.75).alias("low"))
    dirt = F.expr("cast(low * 100 div n_matches as int)")
    return g.withColumn("contamination", dirt).select(
        *_GROUP, "n_matches", F.round("v", 9).alias("avg_visual"), F.round("m", 9).alias("avg_semantic"), "contamination",
        F.when(F.col("contamination") <= 20, "Healthy").when(F.col("contamination") <= 50, "Review Recommended").otherwise("Possible Contamination").alias("health"),
        F.round(0.4 * (100 - F.col("contamination")) + 0.4 * origin_confidence + 20 * F.col("v"), 9).alias("reliability"))


def shares(items: DataFrame) -> DataFrame:
    """Each item's pixels, tags and size as shares of the greatest of its cluster (1, 0 and 1 where that is 0).

    The greatest values are aggregated and looked up, not taken over a window, so a cluster may be any size.
    """
    px = F.coalesce("width", F.lit(0)).cast("bigint") * F.coalesce("height", F.lit(0))
    x = items.withColumns({"px": px, "tags": forensics.exif_count(F.col("exif")), "sz": F.coalesce("file_size", F.lit(0)), "_k": F.struct(*_GROUP)})
    top = x.groupBy("_k").agg(F.max("px").alias("_px"), F.max("tags").alias("_tags"), F.max("sz").alias("_sz"))
    j = salted_lookup(x, top, "_k", how="left")
    part = lambda c, d: F.coalesce(F.try_divide(F.col(c).cast("double"), F.col(f"_{c}")), F.lit(d))
    return j.withColumns({"px_share": part("px", 1.0), "tag_share": part("tags", 0.0), "size_share": part("sz", 1.0)}).drop("_k", "_px", "_tags", "_sz")


def origin_score() -> Column:
    """40, 20 and 15 times the shares, less what the name says was done, at most 60 off."""
    f = forensics.name_flags(F.col("filename"))
    off = lambda c, n: F.when(c, -n).otherwise(0)
    less = off(f["cropped"], 30) + off(f["resized"], 25) + off(f["watermarked"], 35) + off(f["compressed"], 10) + off(f["screenshot"], 15) + off(F.col("tags") == 0, 5)
    return F.round(40 * F.col("px_share") + 20 * F.col("tag_share") + 15 * F.col("size_share") + F.greatest(F.lit(-60), less), 6)


def _stats(scored: DataFrame) -> DataFrame:
    """Per cluster: items, least score, sum of the scores, and the two best as (-score, id), merged by partial sums."""
    first = F.min(F.struct((-F.col("score")).alias("s"), "id"))
    g = scored.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("lo"), F.sum("score").alias("total"), first.alias("a"))
    rest = salted_lookup(scored.withColumn("_k", F.struct(*_GROUP)), g.select(F.struct(*_GROUP).alias("_k"), F.col("a.id").alias("_best")), "_k", how="inner").where(F.col("id") != F.col("_best"))
    second = rest.groupBy("_k").agg((-F.min(-F.col("score"))).alias("nxt"))
    return g.withColumn("_k", F.struct(*_GROUP)).join(second, "_k", "left").drop("_k")


def origins(items: DataFrame) -> DataFrame:
    """Per cluster: best and next score, whether the margin decides (a tenth, or ten points below zero), origin and probability."""
    t = _stats(shares(items).withColumn("score", origin_score()))
    best = -F.col("a.s")
    decided = F.when(F.col("n") == 1, False).when(F.col("nxt") > 0, best >= F.col("nxt") * 1.10).otherwise(best - F.col("nxt") >= 10)
    p = (best - F.col("lo") + 10) / (F.col("total") - F.col("n") * F.col("lo") + F.col("n") * 10)
    out = t.select(*_GROUP, F.col("n").alias("n_items"), best.alias("best"), "nxt", decided.alias("decided"), F.col("a.id").alias("id"), F.round(p * 100, 6).cast("int").alias("p"))
    return out.select(*_GROUP, "n_items", F.round("best", 4).alias("best_score"), F.round("nxt", 4).alias("next_score"), "decided", F.when(F.col("decided"), F.col("id")).alias("origin_id"),
                      F.when(F.col("decided"), F.col("p")).when(F.col("n_items") == 1, 100).otherwise(50).alias("probability"))


def ranked(items: DataFrame) -> DataFrame:
    """Items with their place in the cluster and their share of the shifted scores."""
    s = shares(items).withColumn("score", origin_score())
    order = Window.partitionBy(*_GROUP).orderBy(F.desc("score"), "id")
    whole = Window.partitionBy(*_GROUP)
    n, lo = F.count(F.lit(1)).over(whole), F.min("score").over(whole)
    share = (F.col("score") - lo + 10) / (F.sum("score").over(whole) - n * lo + n * 10)
    return s.select("*", F.row_number().over(order).alias("place"), share.alias("share"))


def chronology(items: DataFrame) -> DataFrame:
    """Items in order of the chronology score within their cluster; ties by id."""
    px = F.coalesce("width", F.lit(0)).cast("bigint") * F.coalesce("height", F.lit(0))
    seconds = F.unix_micros(F.col("created_at").cast("timestamp")) / 1e6
    score = -seconds / 86400 * 10 + px / 1e6 * 50 + F.coalesce("file_size", F.lit(0)) / 1048576.0 * 20 + forensics.exif_count(F.col("exif")) * 5 - 15
    w = Window.partitionBy(*_GROUP).orderBy(F.desc("score"), "id")
    return items.withColumn("score", F.round(score, 3)).withColumn("place", F.row_number().over(w))
