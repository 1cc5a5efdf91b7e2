"""Vectors in columns: which are usable, a lossless short form, and routing to neighbourhoods.

A router is a set of centres fitted by bisecting on a bounded sample: the node of largest dispersion is split in two
until there is one leaf per LEAF_ROWS rows, or MAX_LEAVES. Every row of the table is then sent to its nearest centre and to
every other centre that is less than MARGIN worse, so that two vectors of cosine 0.9 or more almost surely share a leaf.
Where MAX_LEAVES leaves would be too large, each leaf is bisected again by a router fitted to a sample of its own rows, in
its own task, and so on: the leaves stay at LEAF_ROWS rows however large the table is (:func:`deepen`).

Where a large share of all rows lies in one tight bundle, a row is near very many leaves. Such leaves are put together to
one group, which gets a row once however many of its leaves are near; a group too large for one task is cut into parts,
and each pair of parts goes to its own task. Rows that share a leaf thus always meet, whatever the groups are.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenix.operators.skew import salted_lookup, spread
from provenix.session import cut

#: Values of a vector.
DIM = 64
#: Wanted rows to a leaf, and the most leaves of one router: what bounds the centres sent to every task (1 MB) and its sample.
LEAF_ROWS, MAX_LEAVES = 1000, 4000
#: Routed rows to a partition of the work on leaves, as estimated on the rows that a router was fitted to, which is about 2.5 times too low.
TASK_ROWS = 16_000
#: Rows of the sample per leaf, and the least sample. At most 10 * MAX_LEAVES rows come to the driver.
SAMPLE_PER_LEAF, LEAST_SAMPLE = 10, 8000
#: How much less similar than the nearest centre another centre may be and still get a copy.
MARGIN = 0.06
#: Rows of one group that a task compares with as many others; larger groups are cut into such parts.
PART_ROWS = 60_000
#: Rows of the sample that tell which leaves overlap.
OVERLAP_ROWS = 8000
#: Seconds to move one copy of a row, and to compare one pair: only the groups depend on them, never who meets.
_COPY_S, _PAIR_S = 2e-5, 1e-8


def usable_rows(column: pa.Array, dim: int = DIM) -> tuple[np.ndarray, np.ndarray]:
    """(positions, matrix) of the vectors with ``dim`` finite values that are not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    size = np.asarray(pc.fill_null(pc.list_value_length(column), -1))
    pos = np.flatnonzero(size == dim)
    if not len(pos):
        return pos, np.empty((0, dim))
    start = np.asarray(column.offsets)[:n][pos].astype("i8")
    flat = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    x = flat[start[:, None] + np.arange(dim)]
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return pos[good], x[good]


def pack(x: np.ndarray) -> list[bytes]:
    """Two bytes a value where all are multiples of 1/10000 below 3.2768, else the eight of a double; always lossless."""
    with np.errstate(all="ignore"):
        k = np.rint(x * 1e4)
        short = ((k / 1e4 == x) & (np.abs(k) < 32768)).all(1)
    small = np.where(short[:, None], k, 0).astype("<i2")
    return [small[i].tobytes() if short[i] else (x[i] + 0.0).astype("<f8").tobytes() for i in range(len(x))]


def unpack(blobs: list[bytes], dim: int = DIM) -> np.ndarray:
    size = np.fromiter((len(b) for b in blobs), "i8", len(blobs))
    out = np.empty((len(blobs), dim))
    short = size == 2 * dim
    if short.any():
        out[short] = np.frombuffer(b"".join(b for b, s in zip(blobs, short) if s), "<i2").reshape(-1, dim) / 1e4
    if not short.all():
        out[~short] = np.frombuffer(b"".join(b for b, s in zip(blobs, short) if not s), "<f8").reshape(-1, dim)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(1, keepdims=True)  # squares of very small or large values would vanish or overflow
    y = x / big
    return y / np.sqrt(np.einsum("ij,ij->i", y, y))[:, None]


def class_of(blobs: list[bytes]) -> list[bytes]:
    """16-byte names of classes of equal vectors."""
    return [hashlib.blake2b(b, digest_size=16).digest() for b in blobs]


def members(items: DataFrame, key: str = "id", column: str = "embedding") -> DataFrame:
    """(id, cls) of every usable vector, repeated rows once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, x = usable_rows(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(pos)), pa.array(class_of(pack(x)), pa.binary())], ["id", "cls"])

    rows = items.where(F.col(key).isNotNull() & (F.size(column) == DIM)).select(F.col(key).alias("id"), F.col(column).cast("array<double>"))
    return rows.mapInArrow(run, "id bigint, cls binary").distinct()


def packed_sample(items: DataFrame, rows: int, key: str = "id", column: str = "embedding", total: int | None = None) -> np.ndarray:
    """Unit vectors of about ``rows`` usable rows, chosen by a hash of the key; comes to the driver."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = usable_rows(b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(pack(x), pa.binary())], ["vec"])

    total = items.count() if total is None else total
    share = min(1.0, rows / max(total, 1))
    some = items.where(F.col(key).isNotNull() & (F.size(column) == DIM) & (F.pmod(F.xxhash64(F.col(key), F.lit(5)), F.lit(1_000_000)) < int(share * 1_000_000)))
    got = some.select(F.col(column).cast("array<double>")).mapInArrow(run, "vec binary").toArrow()["vec"].to_pylist()
    return unit(unpack(sorted(got))) if got else np.empty((0, DIM))


def split_in_two(x: np.ndarray, rounds: int = 6) -> np.ndarray:
    """Side (bool) of each unit vector after 2-means from the vector farthest from the centre and the farthest from that."""
    a = x[(x @ x.mean(0)).argmin()]
    b = x[(x @ a).argmin()]
    side = x @ a < x @ b
    for _ in range(rounds):
        if side.all() or not side.any():
            return side
        a, b = x[~side].mean(0), x[side].mean(0)
        new = x @ (a / np.linalg.norm(a)) < x @ (b / np.linalg.norm(b))
        if (new == side).all():
            break
        side = new
    return side


def fit_centres(x: np.ndarray, leaves: int) -> np.ndarray:
    """Centres of the leaves after splitting the node of largest dispersion again and again; then two joint rounds."""
    if not len(x):
        return np.zeros((1, x.shape[1]), "f4")
    x = x.astype("f4")
    def dispersion(idx: np.ndarray) -> float:
        return float(len(idx) - np.linalg.norm(x[idx].sum(0)))

    heap, done = [(-dispersion(np.arange(len(x))), 0, np.arange(len(x)))], []
    count = 1
    while heap and len(heap) + len(done) < leaves:
        d, _, idx = heapq.heappop(heap)
        side = split_in_two(x[idx]) if len(idx) > 1 and d < -1e-6 else np.zeros(len(idx), bool)
        if side.all() or not side.any():
            done.append(idx)
            continue
        for part in (idx[side], idx[~side]):
            heapq.heappush(heap, (-dispersion(part), count, part))
            count += 1
    c = np.stack([x[i].mean(0) for i in [*done, *(h[2] for h in heap)]])
    for _ in range(3):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)
        near = nearest(x, c)
        order = np.argsort(near, kind="stable")
        who, first = np.unique(near[order], return_index=True)
        c[who] = np.add.reduceat(x[order], first)
    return c / np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-9)


def nearest(x: np.ndarray, c: np.ndarray, step: int = 4096) -> np.ndarray:
    return np.concatenate([(x[i:i + step] @ c.T).argmax(1) for i in range(0, len(x), step)])


class Router(NamedTuple):
    """Centres of the leaves in order of their group, the first leaf of each group, its parts and its first key; about how many rows are sent."""

    centres: np.ndarray
    starts: np.ndarray
    parts: np.ndarray
    keys: np.ndarray
    copies: int


def near_leaves(x: np.ndarray, c: np.ndarray, margin: float) -> np.ndarray:
    """Whether (row, leaf) is the nearest centre of the row or less than ``margin`` worse."""
    s = x.astype("f4") @ c.T
    return s >= s.max(1, keepdims=True) - np.float32(margin)


def _seconds(rows: float) -> float:
    return rows * rows * _PAIR_S + rows * np.ceil(rows / PART_ROWS) * _COPY_S


def group_leaves(near: np.ndarray, scale: float) -> np.ndarray:
    """Group of each leaf: leaves that share many rows of the sample are put together where that is cheaper than apart."""
    both = near.T.astype("f4") @ near.astype("f4")
    size = np.diag(both)
    share = both / np.maximum(size[:, None] + size[None] - both, 1)
    group = np.arange(near.shape[1])
    free = np.ones(len(group), bool)
    for least in (0.1, 0.2, 0.35, 0.5, 0.7, 0.9):
        tied = (share >= least) & free[:, None] & free[None]
        seen = ~free
        for k in range(len(group)):
            if seen[k]:
                continue
            reach = np.zeros(len(group), bool)
            reach[k] = True
            edge = reach
            while edge.any():
                edge = tied[edge].any(0) & ~reach
                reach |= edge
            seen |= reach
            leaves = np.flatnonzero(reach)
            apart = sum(_seconds(n * scale) for n in size[leaves])
            if len(leaves) > 1 and _seconds(near[:, leaves].any(1).sum() * scale) < apart:
                group[leaves] = k
                free[leaves] = False
    return np.unique(group, return_inverse=True)[1]


def depth(total: int) -> int:
    """Levels of routers, of at most MAX_LEAVES leaves each, until a leaf holds about LEAF_ROWS of ``total`` rows."""
    levels, leaves = 1, MAX_LEAVES
    while leaves * LEAF_ROWS < total:
        levels, leaves = levels + 1, leaves * MAX_LEAVES
    return levels


def fit_router(sample: np.ndarray, total: int, margin: float, last: bool = True, leaves: int | None = None) -> Router:
    """Leaves fitted to the sample of ``total`` rows, their groups, and in how many parts each group is dealt out.

    If leaves are routed on (not ``last``), groups stay whole: their rows are spread over tasks as they are.
    """
    c = fit_centres(sample, leaves or leaf_count(total))
    some = sample[:: max(1, -(-len(sample) // OVERLAP_ROWS))]
    if not len(some):
        return Router(c, np.zeros(1, "i8"), np.ones(1, "i8"), np.zeros(1, "i8"), total)
    near = np.concatenate([near_leaves(some[i:i + 1024], c, margin) for i in range(0, len(some), 1024)])
    scale = total / len(some)
    group = group_leaves(near, scale)
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.r_[True, np.diff(group[order]) != 0])
    rows = np.logical_or.reduceat(near[:, order], starts, axis=1).sum(0) * scale
    parts = np.maximum(1, np.ceil(rows / PART_ROWS)).astype("i8") if last else np.ones(len(starts), "i8")
    return Router(c[order], starts, parts, np.r_[0, np.cumsum(parts * parts)[:-1]], int((rows * parts).sum()))


def route(x: np.ndarray, cls: list[bytes], router: Router, margin: float, step: int = 1024) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, key, part) of every task a row goes to: one for each near group, or one for each pair of parts with its own."""
    rows, groups = [], []
    for i in range(0, len(x), step):
        a, b = np.nonzero(np.logical_or.reduceat(near_leaves(x[i:i + step], router.centres, margin), router.starts, axis=1))
        rows.append(a + i)
        groups.append(b)
    row, group = np.concatenate(rows), np.concatenate(groups)
    n = router.parts[group]
    part = (np.frombuffer(b"".join(c[:8] for c in cls), "<u8")[row] % n.astype("u8")).astype("i8")
    other = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    row, group, part, n = (np.repeat(v, n) for v in (row, group, part, n))
    return row, router.keys[group] + np.minimum(part, other) * n + np.maximum(part, other), part


def partitions(spark: SparkSession, rows: int) -> int:
    """Shuffle partitions for work on so many routed rows: as set, or more where these would hold over TASK_ROWS rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS))


def deepen(routed: DataFrame, total: int, margin: float) -> DataFrame:
    """``routed`` (leaf, part where there are any, cls, vec, ...) with every leaf routed on until leaves hold about LEAF_ROWS of ``total`` rows.

    The rows of a leaf are spread over tasks by a hash of their class, and the leaf's router comes to each as the first
    row, so no leaf is held in one task. With at most MAX_LEAVES * LEAF_ROWS rows there is nothing to do.
    """
    spark = routed.sparkSession
    names = routed.columns

    def fit(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        for t in by_leaf(batches):
            router = fit_router(unit(unpack(t["vec"].to_pylist())), t["n"][0].as_py(), margin, last, t["leaves"][0].as_py())
            yield pa.RecordBatch.from_arrays([pa.array([t["leaf"][0].as_py()]), pa.array([pickle.dumps(tuple(router))], pa.binary())], ["leaf", "router"])

    def go_on(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        router = None
        for b in batches:
            given = b.column(b.schema.get_field_index("router"))
            ends = [*np.flatnonzero(np.asarray(given.is_valid())), b.num_rows]
            if ends[0]:
                ends = [-1, *ends]
            for a, e in zip(ends, ends[1:]):
                if a >= 0:
                    router = Router(*pickle.loads(given[int(a)].as_py()))
                some = pa.Table.from_batches([b.slice(a + 1, e - a - 1)]).select(names)
                if not some.num_rows:
                    continue
                cls = some["cls"].to_pylist()
                row, key, part = route(unit(unpack(some["vec"].to_pylist())), cls, router, margin)
                out = some.take(pa.array(row))
                leaf = (np.asarray(out["leaf"]) << 24) + key
                for name, value in (("leaf", leaf), ("part", part)):
                    if name in names:
                        out = out.set_column(names.index(name), name, pa.array(value, pa.int64()))
                yield from out.combine_chunks().to_batches()

    for level in range(1, depth(total)):
        routed = cut(routed)
        count = cut(routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")))
        rows = routed.join(F.broadcast(count), "leaf") if level == 1 else salted_lookup(routed, count, "leaf")  # at most MAX_LEAVES leaves after the first level
        leaves = F.greatest(F.lit(1), F.least(F.lit(MAX_LEAVES), F.floor(F.col("n") / LEAF_ROWS))).cast("int")
        share = F.greatest(F.lit(2 * LEAF_ROWS), leaves * SAMPLE_PER_LEAF) / F.col("n")
        some = rows.where(F.pmod(F.xxhash64("cls", F.lit(9)), F.lit(1_000_000)) < share * 1_000_000).select("leaf", "vec", "n", leaves.alias("leaves"))
        schema = "leaf bigint, router binary"
        last = level == depth(total) - 1
        routers = spread(some, "leaf").sortWithinPartitions("leaf").mapInArrow(lambda batches, last=last: fit(batches, last), schema)
        tasks = F.ceil(F.col("n") / TASK_ROWS)
        ready = rows.withColumn("router", F.lit(None).cast("binary")).withColumn("salt", F.pmod(F.xxhash64("cls"), tasks).cast("bigint")).drop("n")
        first = routers.join(count, "leaf").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("bigint"), tasks - 1))).drop("n")
        both = ready.unionByName(first, allowMissingColumns=True)
        wide = both.repartition(partitions(spark, routed.count()), "leaf", "salt").sortWithinPartitions("leaf", "salt", F.col("router").isNull())
        routed = wide.mapInArrow(go_on, routed.schema)
    return routed


def leaf_count(rows: int) -> int:
    return int(min(MAX_LEAVES, max(1, rows // LEAF_ROWS)))


def keep_ids(cls: list[bytes], ids: np.ndarray, most: int) -> tuple[np.ndarray, list[list[int]], np.ndarray]:
    """Per class: the row that stands for it, its ``most`` smallest different ids, and whether it has more than one."""
    order = sorted(range(len(cls)), key=lambda i: (cls[i], ids[i]))
    first, kept, last = [], [], None
    for i in order:
        if cls[i] != last:
            first.append(i)
            kept.append([])
            last = cls[i]
        if len(kept[-1]) < most and (not kept[-1] or kept[-1][-1] != ids[i]):
            kept[-1].append(int(ids[i]))
    return np.array(first, "i8"), kept, np.fromiter((len(k) for k in kept), "i8", len(kept))


def by_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of one leaf after the other; the batches are sorted by their first column, the leaf."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        where = np.asarray(batch.column(0))
        if not len(where):
            continue
        ends = np.flatnonzero(np.diff(where)) + 1
        for a, b in zip([0, *ends], [*ends, len(where)]):
            if where[a] != at and held:
                yield pa.Table.from_batches(held)
                held = []
            at = where[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)
