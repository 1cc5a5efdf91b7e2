"""Online clustering as a forest of pointers, merges, depths and lineage payloads.

An item that arrives joins the cluster of its best earlier match, and clusters never merge by themselves. So every item
points to its best earlier match, and its cluster is the root of that pointer tree: the sequential rule, computed for all
items at once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenix.operators import hierarchy
from provenix.operators.skew import salted_lookup
from provenix.session import cut

#: Least score of a match.
MATCH = 0.58


def earlier_matches(items: DataFrame, matches: DataFrame, least: float = MATCH) -> DataFrame:
    """(id, other, score): for each item its matches of the same case with a smaller id, best score per pair."""
    m = matches.where((F.col("combined_score") >= least) & ~F.isnan("combined_score") & (F.col("source_id") != F.col("target_id")))
    m = m.groupBy(F.greatest("source_id", "target_id").alias("id"), F.least("source_id", "target_id").alias("other")).agg(F.max("combined_score").alias("score"))
    case = items.select("id", "case_id")
    j = salted_lookup(m, case, "id", how="inner")
    j = salted_lookup(j, case.select(F.col("id").alias("other"), F.col("case_id").alias("_c")), "other", how="inner")
    return j.where("case_id = _c").select("id", "other", "score", "case_id")


def online_clusters(items: DataFrame, matches: DataFrame, least: float = MATCH) -> DataFrame:
    """(id, cluster, parent_id, depth): the cluster is named by the id of the item that founded it."""
    m = cut(earlier_matches(items, matches, least))
    best = m.groupBy("id").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("other").alias("o"))).alias("b")).select(F.col("id").alias("node"), F.col("b.o").alias("parent"))
    best = cut(best)
    solved = hierarchy.resolve(best)
    full = items.select("id").join(solved.select(F.col("node").alias("id"), "root", "depth"), "id", "left").join(best.select(F.col("node").alias("id"), F.col("parent").alias("parent_id")), "id", "left")
    return full.select("id", F.coalesce("root", "id").alias("cluster"), "parent_id", F.coalesce("depth", F.lit(0)).cast("bigint").alias("depth"))


def merge_recommendations(items: DataFrame, matches: DataFrame, least: float = MATCH) -> DataFrame:
    """(case_id, source_cluster, target_cluster, confidence): other clusters an item matched when it joined its own.

    One per pair of clusters in either direction: that of the earliest item; its confidence is the item's best score.
    """
    clusters = cut(online_clusters(items, matches, least)).select("id", "cluster")
    m = earlier_matches(items, matches, least)
    m = salted_lookup(m, clusters.withColumnRenamed("cluster", "mine"), "id", how="inner")
    m = salted_lookup(m, clusters.select(F.col("id").alias("other"), F.col("cluster").alias("theirs")), "other", how="inner")
    best = m.groupBy("id").agg(F.max("score").alias("confidence"))
    cross = m.where("mine <> theirs").select("id", "case_id", "mine", "theirs").distinct().join(best, "id")
    first = F.min(F.struct("id", F.col("theirs").alias("s"), F.col("mine").alias("t"), "confidence")).alias("f")
    one = cross.groupBy("case_id", F.least("mine", "theirs").alias("a"), F.greatest("mine", "theirs").alias("b")).agg(first)
    return one.select("case_id", F.col("f.s").alias("source_cluster"), F.col("f.t").alias("target_cluster"), F.col("f.confidence").alias("confidence"))


def approve(clusters: DataFrame, recommendations: DataFrame) -> DataFrame:
    """Clusters with each source of the recommendations renamed to its target; chains of renames follow to their end.

    A source with several recommendations takes the most confident; of two that rename into each other the smaller stays.
    """
    r = recommendations.where("source_cluster <> target_cluster").groupBy(F.col("source_cluster").alias("node")).agg(F.min(F.struct((-F.col("confidence")).alias("c"), F.col("target_cluster").alias("t"))).alias("m"))
    links = cut(r.select("node", F.col("m.t").alias("parent")))
    end = hierarchy.resolve(links).select(F.col("node").alias("cluster"), F.col("root").alias("_to"))
    return salted_lookup(clusters, end, "cluster").withColumn("cluster", F.coalesce("_to", "cluster")).drop("_to")


def payload(items: DataFrame, links: DataFrame) -> DataFrame:
    """Per case and cluster: nodes, links, unresolved, truncated mean confidence (10 without links), and how to draw it."""
    j = items.join(links.select("id", "score"), "id", "left")
    g = j.groupBy("case_id", "cluster_id").agg(F.count(F.lit(1)).alias("n_nodes"), F.count("score").alias("n_links"), F.coalesce((F.avg("score") * 100).cast("int"), F.lit(10)).alias("confidence"))
    n = F.col("n_nodes")
    return g.select("case_id", "cluster_id", "n_nodes", "n_links", (n - F.col("n_links")).alias("n_unresolved"), "confidence", ((F.col("confidence") < 40) | (F.col("n_links") == 0)).alias("inconclusive"),
                    F.when(n < 20, "full").when(n <= 100, "collapsible").otherwise("summary").alias("graph_type"))
