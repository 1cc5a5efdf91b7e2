"""Connected groups of pairwise matches by deterministic Borůvka hooking.

Every component picks its smallest outgoing edge; as edges are totally ordered, the picks form trees whose only cycles
are two components that pick the same edge, of which the smaller becomes the root. Trees collapse by pointer doubling,
edges are relabelled and deduplicated, and rounds go on until no edge is left. Each round at least halves the components
that have edges.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenix.operators.skew import HOT_ROWS, salted_lookup
from provenix.session import cut


def _lookup(many: DataFrame, one: DataFrame, key: str, rows: int, how: str = "inner") -> DataFrame:
    return salted_lookup(many, one, key, how=how, hot=[] if rows <= HOT_ROWS else None)


def _hook(edges: DataFrame, n: int) -> DataFrame:
    """(node, root) for every end of an edge."""
    both = edges.select(F.col("u").alias("node"), F.struct("u", "v").alias("e")).unionByName(edges.select(F.col("v").alias("node"), F.struct("u", "v").alias("e")))
    pick = both.groupBy("node").agg(F.min("e").alias("e")).select("node", "e", F.when(F.col("e.u") == F.col("node"), F.col("e.v")).otherwise(F.col("e.u")).alias("ptr"))
    pick = cut(pick)
    mutual = pick.select(F.col("node").alias("ptr"), F.col("e").alias("_e"))
    # Two components that pick the same edge point at each other; the smaller is the root of their tree.
    ptr = F.when((F.col("e") == F.col("_e")) & (F.col("node") < F.col("ptr")), F.col("node")).otherwise(F.col("ptr"))
    tree = cut(_lookup(pick, mutual, "ptr", n).select("node", ptr.alias("ptr")))
    while True:
        up = tree.select(F.col("node").alias("ptr"), F.col("ptr").alias("_p"))
        nxt = cut(_lookup(tree, up, "ptr", n).select("node", F.col("_p").alias("ptr"), (F.col("_p") != F.col("ptr")).alias("moved")))
        tree = nxt.select("node", "ptr")
        if not nxt.where("moved").limit(1).count():
            return tree.select("node", F.col("ptr").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """(node, group_id): the smallest id among all nodes linked to ``node`` directly or over others.

    ``edges``: two bigint columns, first and second end; repeated edges, both directions and self-links may occur, null
    ends are dropped. Nodes whose only links are to themselves have no row. No edges, no rows.
    """
    a, b = edges.columns[:2]
    left = edges.where(F.col(a) != F.col(b)).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()
    left = cut(left)
    maps: list[tuple[DataFrame, int]] = []
    n = left.count()
    while n:
        roots = _hook(left, 2 * n)
        maps.append((roots, 2 * n))
        to = lambda end, new: roots.select(F.col("node").alias(end), F.col("root").alias(new))
        moved = _lookup(_lookup(left, to("u", "ru"), "u", n), to("v", "rv"), "v", n)
        left = cut(moved.where("ru <> rv").select(F.least("ru", "rv").alias("u"), F.greatest("ru", "rv").alias("v")).distinct())
        n = left.count()
    if not maps:
        return edges.select(F.col(a).alias("node"), F.col(a).alias("group_id")).limit(0)
    label = maps[-1][0]
    for roots, rows in reversed(maps[:-1]):
        up = label.select(F.col("node").alias("root"), F.col("root").alias("_r"))
        label = _lookup(roots, up, "root", rows, "left").select("node", F.coalesce("_r", "root").alias("root"))
    if len(maps) > 1:
        label = cut(label)
    least = label.groupBy("root").agg(F.min("node").alias("group_id"))
    return _lookup(label, least, "root", maps[0][1]).select("node", "group_id")


#: A match of at least this combined score links its two items.
SCORE = 0.58


def media_edges(items: DataFrame, relationships: DataFrame, score: float = SCORE) -> DataFrame:
    """(u, v): matches between present items, and each item with the smallest id of its case and stored cluster.

    Repeated rows, self-pairs, null scores and absent items make no link; NaN scores do not count as high.
    """
    one = items.where("id is not null").select("id", "case_id", "cluster_id").distinct()
    here = one.select("id").distinct()
    match = relationships.where((F.col("combined_score") >= score) & ~F.isnan("combined_score")).select(F.col("source_id").alias("u"), F.col("target_id").alias("v")).where("u <> v")
    match = match.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    match = salted_lookup(match, here.withColumnRenamed("id", "u"), "u", how="inner")
    match = salted_lookup(match, here.withColumnRenamed("id", "v"), "v", how="inner")
    stored = one.where("case_id is not null and cluster_id is not null").withColumn("k", F.struct("case_id", "cluster_id"))
    first = stored.groupBy("k").agg(F.min("id").alias("v"))
    star = salted_lookup(stored.select("k", F.col("id").alias("u")), first, "k", how="inner").select("u", "v").where("u <> v")
    return match.select("u", "v").unionByName(star)


def media_groups(items: DataFrame, relationships: DataFrame, score: float = SCORE) -> DataFrame:
    """(media_id, group_id) for every present item that is linked to another."""
    return components(media_edges(items, relationships, score)).select(F.col("node").alias("media_id"), "group_id")


def group_report(items: DataFrame, relationships: DataFrame, score: float = SCORE) -> DataFrame:
    """Per group: items, cases, stored clusters, and items without a stored cluster."""
    stored = items.where("id is not null").select(F.col("id").alias("media_id"), "case_id", "cluster_id").distinct()
    g = media_groups(items, relationships, score).join(stored, "media_id")
    per = g.groupBy("group_id", "case_id", "cluster_id").agg(F.count_distinct("media_id").alias("n"))
    case = per.groupBy("group_id", "case_id").agg(F.sum("n").alias("n"), F.count("cluster_id").alias("c"), F.sum(F.when(F.col("cluster_id").isNull(), F.col("n")).otherwise(0)).alias("bare"))
    return case.groupBy("group_id").agg(F.sum("n").alias("n_items"), F.count(F.lit(1)).alias("n_cases"), F.sum("c").alias("n_stored_clusters"), F.sum("bare").alias("n_without_cluster"))
