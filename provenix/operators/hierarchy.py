"""Parent-child links to full hierarchies.

Nodes point to at most one parent, so the table is a functional graph. A fixed share of the nodes, chosen by a hash of
their id, are *splitters*. Every node first walks up to its next stop (a splitter or a root) by pointer doubling; as the
distance to the next splitter is short whatever the depth of the tree, few rounds do. The splitters form a reduced
pointer graph that is solved in the same way, and its answers are expanded to all nodes. Nodes that never meet a stop,
and nodes whose splitters never meet a root, lie on or below a cycle; they are set apart and solved on their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenix.operators.skew import salted_lookup
from provenix.session import cut

#: One node in SPLITTER_EVERY is a splitter.
SPLITTER_EVERY = 16


def _is_splitter(col: str):
    return F.pmod(F.xxhash64(F.col(col), F.lit(41)), F.lit(SPLITTER_EVERY)) == 0


def _jump(open_: DataFrame, state: DataFrame, paths: bool) -> DataFrame:
    """Every open node takes over the pointer of the node it points to."""
    via = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("_p"), F.col("d").alias("_d"), F.col("mn").alias("_m"),
                       F.col("done").alias("_e"), *([F.col("path").alias("_w")] if paths else []))
    j = salted_lookup(open_, via, "ptr", how="inner")
    out = [F.col("node"), F.col("_p").alias("ptr"), (F.col("d") + F.col("_d")).alias("d"), F.least("mn", "_m").alias("mn"), F.col("_e").alias("done")]
    return j.select(*out, *([F.concat("path", "_w").alias("path")] if paths else []))


def _walk(state: DataFrame, paths: bool) -> tuple[DataFrame, DataFrame | None]:
    """Pointer doubling until every node points at a stop. Returns (arrived, never arriving or None).

    While any node that can arrive is still open, so is one that arrives in the next round (the nodes on its way are at
    every smaller distance); a round in which none arrives therefore proves that the rest never will.
    """
    state = cut(state)
    left = state.where(~F.col("done")).count()
    while left:
        moved = _jump(state.where(~F.col("done")), state, paths)
        state = cut(state.where(F.col("done")).unionByName(moved))
        now = state.where(~F.col("done")).count()
        if now == left:
            return state.where(F.col("done")), state.where(~F.col("done"))
        left = now
    return state, None


def _cycles(state: DataFrame) -> DataFrame:
    """(node, root, on_cycle) of (node, ptr, mn), nodes that all lead to cycles; root is the smallest id on the cycle.

    Doubling shrinks the set of nodes pointed at until it is exactly the cycles' nodes; two rounds of equal size prove
    that. The minimum over the window walked so far, taken at a cycle node, is final when no window changes any more.
    """
    state = state.select("node", "ptr", "mn")
    size = -1
    while True:
        image = state.select("ptr").distinct().count()
        via = state.select(F.col("node").alias("ptr"), F.col("ptr").alias("_p"), F.col("mn").alias("_m"))
        nxt = cut(salted_lookup(state, via, "ptr", how="inner").select("node", F.col("_p").alias("ptr"), F.least("mn", "_m").alias("mn"), (F.col("_m") < F.col("mn")).alias("changed")))
        onto = nxt.join(state.select(F.col("ptr").alias("node")).distinct(), "node", "left_semi")
        if image == size and onto.where("changed").limit(1).count() == 0:
            break
        state, size = nxt.drop("changed"), image
    cycle = state.select(F.col("ptr").alias("node")).distinct()
    on = state.join(cycle, "node", "left_semi").select(F.col("node").alias("ptr"), F.col("mn").alias("root"))
    marked = state.join(cycle.withColumn("on_cycle", F.lit(True)), "node", "left")
    return salted_lookup(marked, on, "ptr", how="inner").select("node", "root", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def resolve(links: DataFrame, paths: bool = False) -> DataFrame:
    """Root, depth and, if asked for, path of every node that has a parent.

    ``links``: (node, parent), one row per node, every parent a node of the same population. Nodes that never occur as
    ``node`` are roots; a root gets no row here.

    Result: node, root, depth (null on or below a cycle), status ``tree``, ``cycle`` or ``below_cycle``, and with
    ``paths`` the ids from the root down to the node (null on or below a cycle). On and below a cycle the root is the
    smallest id on the cycle; a node that is its own parent is a cycle of one. Empty input gives no rows.
    """
    stop = links.select(F.col("node").alias("parent")).withColumn("_has", F.lit(True))
    first = salted_lookup(links.select("node", "parent"), stop, "parent")
    state = first.select("node", F.col("parent").alias("ptr"), F.lit(1).cast("bigint").alias("d"), F.col("node").alias("mn"),
                         (F.col("_has").isNull() | _is_splitter("parent")).alias("done"), F.col("_has").isNull().alias("top"),
                         *([F.array("node").alias("path")] if paths else []))
    # A stop that is a root ends the walk; which stops are roots is asked again once the walk is over.
    arrived, lost = _walk(state.drop("top"), paths)
    tops = stop.select(F.col("parent").alias("ptr"), "_has")
    arrived = cut(salted_lookup(arrived, tops, "ptr").withColumn("top", F.col("_has").isNull()).drop("_has"))

    # The reduced graph: splitters that have a parent, each pointing to its next stop.
    reduced = arrived.where(_is_splitter("node")).drop("done").withColumnRenamed("top", "done")
    solved, circling = _walk(reduced, paths)

    def shape(root, depth, *way):
        return [F.col("node"), root.alias("root"), depth.alias("depth"), F.lit("tree").alias("status"), *(w.alias("path") for w in way if paths)]

    direct = arrived.where("top").select(*shape(F.col("ptr"), F.col("d"), F.reverse(F.concat("path", F.array("ptr"))) if paths else None))
    table = solved.select(F.col("node").alias("ptr"), F.col("ptr").alias("_root"), F.col("d").alias("_d"), *([F.col("path").alias("_w")] if paths else []))
    via = salted_lookup(arrived.where(~F.col("top")), table, "ptr")
    tree = via.where(F.col("_root").isNotNull())
    out = direct.unionByName(tree.select(*shape(F.col("_root"), F.col("d") + F.col("_d"), F.reverse(F.concat("path", "_w", F.array("_root"))) if paths else None)))
    rest = None
    if circling is not None or lost is not None:
        # A splitter may itself lead to a splitterless cycle; then it is lost, and so is what stopped at it.
        rest = via.where(F.col("_root").isNull()).select("node")
        rest = rest if lost is None else rest.unionByName(lost.select("node"))
    if rest is not None:
        ring = rest.join(links, "node").select("node", F.col("parent").alias("ptr"), F.col("node").alias("mn"))
        out = out.unionByName(_cycles(cut(ring)).select(
            "node", "root", F.lit(None).cast("bigint").alias("depth"), F.when(F.col("on_cycle"), "cycle").otherwise("below_cycle").alias("status"),
            *([F.lit(None).cast("array<bigint>").alias("path")] if paths else [])))
    return out


def media_links(items: DataFrame) -> DataFrame:
    """(node, parent) of a media table: ``parent_id``, else ``estimated_origin_id`` unless it is the item itself.

    Only links between present items stay. Repeated rows count once; rows with a null id are dropped.
    """
    from provenix.sources.tables import once_by_id

    one = once_by_id(items, "id", "parent_id", "estimated_origin_id")
    guess = F.when(F.col("estimated_origin_id") != F.col("id"), F.col("estimated_origin_id"))
    links = one.select(F.col("id").alias("node"), F.coalesce("parent_id", guess).alias("parent")).where(F.col("parent").isNotNull())
    present = one.select(F.col("id").alias("parent")).withColumn("_here", F.lit(True))
    return salted_lookup(links, present, "parent", how="inner").select("node", "parent")


def hierarchy(items: DataFrame) -> DataFrame:
    """One row per present item: media_id, parent_id, root_id, depth, path, status, n_descendants.

    ``status`` is ``root`` for items without a present parent (depth 0, their own root), else as in :func:`resolve`.
    ``path`` reads ``root/.../item``. On and below a cycle depth and path are null; ``n_descendants`` counts the nodes
    whose path runs through the item and is null on a cycle, where every item is below every other.
    """
    links = cut(media_links(items))
    solved = cut(resolve(links, paths=True))
    below = solved.where("status = 'tree'").select(F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("node"))
    down = below.groupBy("node").agg(F.count(F.lit(1)).alias("n"))
    tails = _tails(solved, links)
    down = down.unionByName(tails).groupBy("node").agg(F.sum("n").alias("n"))
    every = items.select(F.col("id").alias("node")).where(F.col("node").isNotNull()).distinct()
    full = every.join(solved, "node", "left").join(links, "node", "left").join(down, "node", "left")
    status = F.coalesce("status", F.lit("root"))
    return full.select(
        F.col("node").alias("media_id"), F.col("parent").alias("parent_id"), F.coalesce("root", "node").alias("root_id"),
        F.when(status == "root", F.lit(0).cast("bigint")).otherwise(F.col("depth")).alias("depth"),
        F.when(status == "root", F.col("node").cast("string")).otherwise(F.concat_ws("/", F.when(status == "tree", F.col("path")))).alias("path_"),
        status.alias("status"), F.when(status != "cycle", F.coalesce("n", F.lit(0))).alias("n_descendants"),
    ).withColumn("path", F.when(F.col("status").isin("root", "tree"), F.col("path_"))).drop("path_")


def _low_paths(solved: DataFrame, links: DataFrame) -> DataFrame | None:
    """(node, path) of the nodes below a cycle, from the node that hangs on the cycle; None if there are none.

    Without their cycle they are trees, and are solved as such.
    """
    low = solved.where("status = 'below_cycle'").select("node")
    if not low.limit(1).count():
        return None
    inner = low.join(links, "node").join(low.select(F.col("node").alias("parent")), "parent", "left_semi").select("node", "parent")
    return resolve(cut(inner), paths=True).select("node", "path")


def _tails(solved: DataFrame, links: DataFrame) -> DataFrame:
    """(node, n): descendants of the nodes below a cycle."""
    part = _low_paths(solved, links)
    if part is None:
        return solved.sparkSession.createDataFrame([], "node bigint, n bigint")
    below = part.select(F.explode(F.slice("path", F.lit(1), F.size("path") - 1)).alias("node"))
    return below.groupBy("node").agg(F.count(F.lit(1)).alias("n"))


def descendants(items: DataFrame) -> DataFrame:
    """(ancestor_id, descendant_id, distance, over_cycle): every item and each item above it.

    A cycle stands for its members by its smallest id: every other item on it or below it has one row with that id as
    ancestor, ``over_cycle`` true and no distance; the cycle's other members are ancestors just the same. Below a cycle
    items are ancestors of one another as in a tree.
    """
    links = cut(media_links(items))
    solved = cut(resolve(links, paths=True))
    paths = solved.where("status = 'tree'").select("node", "path")
    low = _low_paths(solved, links)
    walk = (paths if low is None else paths.unionByName(low)).select(F.col("node").alias("descendant_id"), F.size("path").alias("n"), F.posexplode("path").alias("pos", "ancestor_id"))
    walk = walk.where(F.col("pos") < F.col("n") - 1).select("ancestor_id", "descendant_id", (F.col("n") - 1 - F.col("pos")).cast("bigint").alias("distance"), F.lit(False).alias("over_cycle"))
    ring = solved.where("status <> 'tree' and root <> node").select(F.col("root").alias("ancestor_id"), F.col("node").alias("descendant_id"), F.lit(None).cast("bigint").alias("distance"), F.lit(True).alias("over_cycle"))
    return walk.unionByName(ring)
