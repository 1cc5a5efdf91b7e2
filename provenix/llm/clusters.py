"""Clusters of mutually similar vectors by bisecting k-means.

The upper splits are those of the router in :mod:`provenix.llm.vectors`: the node of largest dispersion is split until
there is one leaf per LEAF_ROWS rows; every row is routed, near ones of a border to both sides. Below that, each leaf is
bisected in its task, all nodes of a level at once, until every node is compact: no two members less similar than
COSINE. Nodes that a split cut apart are joined again where members of both are that similar (an exact check, within a
leaf by centres and radii, across leaves by the rows on both sides). Sizes, centres and typical members come from all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenix.llm import vectors
from provenix.llm.components import components
from provenix.operators.skew import salted_lookup, spread
from provenix.session import cut

#: Least cosine of any two members of a compact node.
COSINE = 0.90
#: Typical members reported for a cluster.
TYPICAL = 3


def _compact(x: np.ndarray, cosine: float, step: int = 1024) -> bool:
    return all((x[i:i + step] @ x.T).min() >= cosine for i in range(0, len(x), step))


def bisect(x: np.ndarray, cosine: float = COSINE, rounds: int = 2) -> np.ndarray:
    """Node of each unit vector after splitting every node that is not compact, level by level."""
    label = np.zeros(len(x), "i8")
    open_ = np.arange(len(x))
    used = 1
    sure = np.cos(np.arccos(cosine) / 2)
    while len(open_):
        open_ = open_[np.argsort(label[open_], kind="stable")]
        seg = label[open_]
        first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
        size = np.diff(np.r_[first, len(seg)])
        which = np.repeat(np.arange(len(first)), size)
        y = x[open_]
        centre = np.add.reduceat(y, first)
        centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
        cos = np.einsum("ij,ij->i", y, centre[which])
        low = np.minimum.reduceat(cos, first)
        split = (size > 1) & (low < sure)
        for k in np.flatnonzero(split & (low >= cosine)):
            split[k] = not _compact(y[first[k]:first[k] + size[k]], cosine)
        keep = split[which]
        if not keep.any():
            break
        open_, y, which, cos = open_[keep], y[keep], np.cumsum(split)[which[keep]] - 1, cos[keep]
        first = np.flatnonzero(np.r_[True, which[1:] != which[:-1]])
        n = len(first)

        def far(value: np.ndarray) -> np.ndarray:  # first member with the lowest value of each node
            at = np.flatnonzero(value == np.minimum.reduceat(value, first)[which])
            return at[np.unique(which[at], return_index=True)[1]]

        a = far(cos)
        to_a = np.einsum("ij,ij->i", y, y[a][which])
        b = far(to_a)
        side = to_a < np.einsum("ij,ij->i", y, y[b][which])
        for _ in range(rounds):
            part = which * 2 + side
            order = np.argsort(part, kind="stable")
            ends = np.flatnonzero(np.r_[True, np.diff(part[order]) != 0])
            sums = np.zeros((2 * n, x.shape[1]))
            sums[part[order][ends]] = np.add.reduceat(y[order], ends)
            both = np.bincount(part, minlength=2 * n).reshape(n, 2).all(1)
            sums /= np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
            new = np.einsum("ij,ij->i", y, sums[2 * which]) < np.einsum("ij,ij->i", y, sums[2 * which + 1])
            side = np.where(both[which], new, side)
        count = np.bincount(which * 2 + side, minlength=2 * n).reshape(n, 2)
        whole = ~count.all(1)
        if whole.any():  # rounding may leave a side empty: the farthest member then stands alone
            side[np.isin(which, np.flatnonzero(whole))] = False
            side[a[whole]] = True
        label[open_[side]] = used + which[side]
        used += n
    return np.unique(label, return_inverse=True)[1]


def join_nodes(x: np.ndarray, node: np.ndarray, cosine: float = COSINE, step: int = 512) -> np.ndarray:
    """Group of each vector: compact nodes joined where members of two have at least ``cosine``.

    With the radius of each node, two centres tell whether that is possible at all; what is possible is looked up.
    """
    order = np.argsort(node, kind="stable")
    first = np.flatnonzero(np.r_[True, np.diff(node[order]) != 0])
    last = np.r_[first[1:], len(order)]
    centre = np.add.reduceat(x[order], first)
    centre /= np.maximum(np.linalg.norm(centre, axis=1, keepdims=True), 1e-12)
    cos = np.einsum("ij,ij->i", x[order], centre[node[order]])
    radius = np.arccos(np.clip(np.minimum.reduceat(cos, first), -1, 1))
    up = np.arange(len(first))

    def top(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for s in range(0, len(first), step):
        reach = np.minimum(radius[s:s + step, None] + radius[None] + np.arccos(cosine), np.pi)
        for i, j in zip(*np.nonzero(centre[s:s + step] @ centre.T >= np.cos(reach) - 1e-9)):
            i += s
            if i < j and top(i) != top(j):
                left, right = x[order[first[i]:last[i]]], x[order[first[j]:last[j]]]
                if any((left[k:k + 1024] @ right.T).max() >= cosine - 1e-12 for k in range(0, len(left), 1024)):
                    lo, hi = sorted((top(i), top(j)))
                    up[hi] = lo
    return np.array([top(i) for i in range(len(first))])[node]


def _leaf(cls: list[bytes], vec: list[bytes], ids: list[list[int]], cosine: float) -> pa.RecordBatch:
    at: dict[bytes, list[int]] = {}
    keep = []
    for i, c in enumerate(cls):
        if c in at:
            at[c][:] = sorted({*at[c], *ids[i]})[:2]
        else:
            at[c] = ids[i]
            keep.append(i)
    x = vectors.unit(vectors.unpack([vec[i] for i in keep]))
    group = join_nodes(x, bisect(x, cosine), cosine)
    low = np.array([at[cls[i]][0] for i in keep], "i8")
    n = np.bincount(group, weights=[len(at[cls[i]]) for i in keep])
    root = np.full(len(n), np.iinfo("i8").max)
    np.minimum.at(root, group, low)
    real = np.flatnonzero(n[group] > 1)
    return pa.RecordBatch.from_arrays([pa.array([cls[keep[i]] for i in real], pa.binary()), pa.array(root[group[real]])], ["cls", "root"])


def cluster_classes(items: DataFrame, cosine: float = COSINE, margin: float = vectors.MARGIN) -> DataFrame:
    """(cls, group_id) of the classes of equal vectors that lie in a group of two or more items."""
    source = items.select("id", "embedding")
    total = source.count()
    leaves = vectors.leaf_count(total)
    sample = vectors.packed_sample(source, max(vectors.LEAST_SAMPLE, vectors.SAMPLE_PER_LEAF * leaves), total=total)
    router = vectors.fit_router(sample, total, margin, last=vectors.depth(total) == 1)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, x = vectors.usable_rows(b.column(1))
            if not len(pos):
                continue
            blobs = vectors.pack(x)
            cls = vectors.class_of(blobs)
            first, kept, _ = vectors.keep_ids(cls, np.asarray(b.column(0))[pos], 2)
            row, leaf, _ = vectors.route(vectors.unit(x[first]), [cls[i] for i in first], router, margin)
            yield pa.RecordBatch.from_arrays([pa.array(leaf), pa.array([cls[first[r]] for r in row], pa.binary()), pa.array([blobs[first[r]] for r in row], pa.binary()),
                                              pa.array([kept[r] for r in row], pa.list_(pa.int64()))], ["leaf", "cls", "vec", "ids"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in vectors.by_leaf(batches):
            yield _leaf(t["cls"].to_pylist(), t["vec"].to_pylist(), t["ids"].to_pylist(), cosine)

    rows = source.where(F.col("id").isNotNull() & (F.size("embedding") == vectors.DIM)).select("id", F.col("embedding").cast("array<double>"))
    routed = vectors.deepen(rows.mapInArrow(route, "leaf bigint, cls binary, vec binary, ids array<bigint>"), total, margin)
    local = spread(routed, "leaf", partitions=vectors.partitions(items.sparkSession, router.copies)).sortWithinPartitions("leaf").mapInArrow(work, "cls binary, root bigint")
    roots = cut(local.groupBy("cls").agg(F.min("root").alias("root"), F.collect_set("root").alias("all")))
    clash = roots.where(F.size("all") > 1).select("root", F.explode("all").alias("other")).where("other <> root")
    joined = components(clash).select(F.col("node").alias("root"), F.col("group_id").alias("_g"))
    return salted_lookup(roots.select("cls", "root"), joined, "root").select("cls", F.coalesce("_g", "root").alias("group_id"))


def clusters(items: DataFrame, cosine: float = COSINE, margin: float = vectors.MARGIN) -> DataFrame:
    """(media_id, group_id): every item in a group of two or more similar vectors, and the smallest id of the group.

    Vectors that are not usable are in no group; equal vectors are one point however often they occur; an item delivered
    twice counts once. Where similarity isn't transitive a group is all that is linked over pairs of at least ``cosine``.
    """
    label = cluster_classes(items, cosine, margin)
    return salted_lookup(vectors.members(items), label, "cls", how="inner").select(F.col("id").alias("media_id"), "group_id")


def cluster_report(items: DataFrame, cosine: float = COSINE, typical: int = TYPICAL) -> DataFrame:
    """Per cluster: size, least and mean cosine to the centre, its typical members, and the stored clusters it mixes."""
    label = cut(clusters(items, cosine))
    wide = items.select(F.col("id").alias("media_id"), F.col("embedding").cast("array<double>").alias("v"), F.concat_ws(":", "case_id", "cluster_id").alias("stored"), F.col("cluster_id").isNotNull().alias("has"))
    one = wide.where("media_id is not null and size(v) = 64").dropDuplicates(["media_id"])
    rows = label.join(one, "media_id")
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, e: s + e * e))
    rows = cut(rows.withColumn("u", F.transform("v", lambda e: e / norm)).select("media_id", "group_id", "u", F.when(F.col("has"), F.col("stored")).alias("stored")))
    centre = rows.groupBy("group_id").agg(F.array(*[F.sum(F.col("u")[i]) for i in range(vectors.DIM)]).alias("c"))
    size = F.sqrt(F.aggregate("c", F.lit(0.0), lambda s, e: s + e * e))
    centre = centre.withColumn("c", F.transform("c", lambda e: e / size))
    dot = F.aggregate(F.zip_with("u", "c", lambda a, b: a * b), F.lit(0.0), lambda s, e: s + e)
    near = cut(salted_lookup(rows, centre, "group_id", how="inner").select("group_id", "media_id", "stored", F.round(dot, 6).alias("cos")))
    stats = near.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_items"), F.min("cos").alias("least_cosine"), F.round(F.avg("cos"), 6).alias("mean_cosine"))
    mixed = near.where("stored is not null").groupBy("group_id", "stored").agg(F.count(F.lit(1)).alias("n"))
    mixed = mixed.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_stored_clusters"), F.max("n").alias("largest_stored_cluster"))
    from pyspark.sql import Window

    def best(by: list[str], df: DataFrame) -> DataFrame:
        w = Window.partitionBy(*by).orderBy(F.desc("cos"), "media_id")
        return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= typical)

    first = best(["group_id", "salt"], near.withColumn("salt", F.pmod(F.xxhash64("media_id"), F.lit(32))))  # no group is ranked whole in one task
    top = best(["group_id"], first).groupBy("group_id").agg(F.array_sort(F.collect_list(F.struct("_r", "media_id"))).alias("t"))
    top = top.select("group_id", F.concat_ws(",", F.transform("t", lambda s: s["media_id"].cast("string"))).alias("typical_members"))
    return stats.join(top, "group_id").join(mixed, "group_id", "left").select(
        "group_id", "n_items", "least_cosine", "mean_cosine", "typical_members", F.coalesce("n_stored_clusters", F.lit(0)).alias("n_stored_clusters"), F.coalesce("largest_stored_cluster", F.lit(0)).alias("largest_stored_cluster"))
