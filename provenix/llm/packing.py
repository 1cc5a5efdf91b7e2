"""Filling containers of fixed capacity along a space-filling curve.

Hashed token vectors are projected to three dimensions; a document's place on the Hilbert curve through them is its key.
Documents are range-partitioned and sorted by the key and packed in that order, so neighbours on the curve share
containers. A packer holds at most OPEN containers; a document goes where it leaves the least room, and when too many
are open the fullest is closed. What a partition leaves in containers below GOOD is packed again over fewer partitions,
until one is left or nothing.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenix.llm import tokens
from provenix.session import cut

#: Dimensions of the curve and bits of each.
DIMS, BITS = 3, 10
#: Containers a packer keeps open.
OPEN = 128
#: Fill from which a container left open at the end of a partition stays as it is.
GOOD = 0.98
#: Most capacities in one call; every document is repeated for each.
MOST_LIMITS = 100
#: Partitions whose leftovers meet in one partition of the next pass.
FAN_IN = 16


def projection(seed: int = 17) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((tokens.HASHED, DIMS))


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place on the Hilbert curve of integer points (n, dims) with ``bits`` bits to a coordinate."""
    x = points.astype("i8").T.copy()
    dims = len(x)
    step = 1 << (bits - 1)
    while step > 1:  # undo the turns of the cells from the coarsest down
        low = step - 1
        for i in range(dims):
            turned = (x[i] & step) != 0
            swap = np.where(turned, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turned, low, swap)
            x[i] ^= swap
        step >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    step = 1 << (bits - 1)
    while step > 1:
        flip ^= np.where((x[-1] & step) != 0, step - 1, 0)
        step >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def _cells(projected: np.ndarray) -> np.ndarray:
    """Coordinates in cells: a logistic curve spreads sums of random weights evenly."""
    even = 1 / (1 + np.exp(-1.702 * projected))
    return np.clip((even * (1 << BITS)).astype("i8"), 0, (1 << BITS) - 1)


def sized(documents: DataFrame, tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens, curve) of every document with at least one token."""
    weights = projection()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            ids = [tokens.token_ids(t, tokenizer) for t in texts]
            at = np.array([tokens.hashed_vector(i) @ weights for i in ids]).reshape(-1, DIMS)
            n = np.array([len(i) for i in ids], "i8")
            keep = n > 0
            yield pa.RecordBatch.from_arrays([b.column(0).filter(pa.array(keep)), pa.array(n[keep]), pa.array(hilbert_key(_cells(at[keep])))], ["doc_id", "n_tokens", "curve"])

    rows = documents.where("doc_id is not null and text is not null and text <> ''").select("doc_id", "text")
    return rows.mapInArrow(run, "doc_id bigint, n_tokens bigint, curve bigint")


class Packer:
    """Best fit over a bounded number of open containers."""

    def __init__(self, capacity: int, prefix: int) -> None:
        self.capacity, self.prefix, self.serial = capacity, prefix, 0
        self.open: list[tuple[int, int]] = []  # (room, container), sorted
        self.held: dict[int, list[tuple]] = {}

    def put(self, item: tuple, size: int) -> list[tuple]:
        """Place an item; returns the rows of a container that had to be closed."""
        at = bisect_left(self.open, (size, -1))
        if at < len(self.open):
            room, box = self.open.pop(at)
        else:
            room, box = self.capacity, self.prefix + self.serial
            self.serial += 1
            self.held[box] = []
        self.held[box].append((*item, size))
        room -= size
        if room == 0:
            return self.close(box, room)
        insort(self.open, (room, box))
        if len(self.open) > OPEN:
            room, box = self.open.pop(0)
            return self.close(box, room)
        return []

    def close(self, box: int, room: int) -> list[tuple]:
        fill = (self.capacity - room) / self.capacity
        return [(*item, box, fill) for item in self.held.pop(box)]


_PACKED = "pack_name string, capacity_tokens int, doc_id bigint, piece int, curve bigint, n_tokens bigint, container bigint, fill double, final boolean"


def _packer(step: int, last: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packers: dict[tuple[str, int], Packer] = {}

        def table(rows: list[tuple], name: str, capacity: int, final) -> pa.RecordBatch:
            doc, piece, curve, size, box, fill = zip(*rows)
            n = len(rows)
            return pa.RecordBatch.from_pydict({"pack_name": [name] * n, "capacity_tokens": pa.array([capacity] * n, pa.int32()), "doc_id": doc, "piece": pa.array(piece, pa.int32()), "curve": curve,
                                               "n_tokens": size, "container": box, "fill": fill, "final": final if isinstance(final, list) else [final] * n})

        for b in batches:
            cols = b.to_pydict()
            done: dict[tuple[str, int], list[tuple]] = {}
            for name, capacity, part, doc, piece, curve, size in zip(*(cols[c] for c in ("pack_name", "capacity_tokens", "part", "doc_id", "piece", "curve", "n_tokens"))):
                key = (name, capacity)
                if key not in packers:
                    packers[key] = Packer(capacity, (step << 56) | (part << 32))
                closed = packers[key].put((doc, piece, curve), size)
                if closed:
                    done.setdefault(key, []).extend(closed)
            for (name, capacity), rows in done.items():
                yield table(rows, name, capacity, True)
        for (name, capacity), p in packers.items():
            for room, box in list(p.open):
                rows = p.close(box, room)
                yield table(rows, name, capacity, last or rows[0][-1] >= GOOD)

    return run


def pack(documents: DataFrame, limits: DataFrame, tokenizer: str = tokens.TOKENIZER) -> DataFrame:
    """(pack_name, capacity_tokens, doc_id, piece, n_tokens, container, fill) for every document and capacity.

    A document larger than the capacity is cut into full containers and a rest, numbered by ``piece``; no other document
    is split. ``fill`` is the filled share of the container. Documents without tokens (null or empty text) need no room
    and have no row; capacities below one are left out, more than MOST_LIMITS are an error. Container ids are unique within a pack.
    """
    size = cut(sized(documents, tokenizer))
    caps = limits.where("pack_name is not null and capacity_tokens > 0").select("pack_name", F.col("capacity_tokens").cast("int")).distinct().orderBy("pack_name", "capacity_tokens").limit(MOST_LIMITS + 1).collect()
    if len(caps) > MOST_LIMITS:
        raise ValueError(f"more than {MOST_LIMITS} capacities")
    each_cap = F.array(*[F.struct(F.lit(c[0]).alias("pack_name"), F.lit(c[1]).alias("capacity_tokens")) for c in caps]) if caps else F.expr("cast(array() as array<struct<pack_name:string,capacity_tokens:int>>)")
    each = size.select("*", F.inline(each_cap))
    full = F.floor((F.col("n_tokens") - 1) / F.col("capacity_tokens")).cast("int")
    pieces = each.withColumn("piece", F.explode(F.sequence(F.lit(0), full)))
    pieces = pieces.withColumn("n_tokens", F.when(F.col("piece") < full, F.col("capacity_tokens").cast("bigint")).otherwise(F.col("n_tokens") - full.cast("bigint") * F.col("capacity_tokens")))
    spark = documents.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = pieces.select("pack_name", "capacity_tokens", "doc_id", "piece", "curve", "n_tokens")
    results, step = [], 1
    while True:
        # Equal keys are common (copies of one text), so a hash of the id breaks ties and lets ranges cut through them.
        tie = F.xxhash64("doc_id", "piece")
        ranged = rows.withColumn("tie", tie).repartitionByRange(parts, "curve", "tie").sortWithinPartitions("curve", "tie", "doc_id", "piece", "pack_name")
        ranged = ranged.withColumn("part", F.spark_partition_id().cast("bigint")).drop("tie")
        packed = cut(ranged.mapInArrow(_packer(step, parts == 1), _PACKED))
        results.append(packed.where("final"))
        if parts == 1:
            break
        rows = packed.where("not final").select("pack_name", "capacity_tokens", "doc_id", "piece", "curve", "n_tokens")
        if not rows.limit(1).count():
            break
        parts, step = -(-parts // FAN_IN), step + 1
    out = results[0]
    for r in results[1:]:
        out = out.unionByName(r)
    return out.select("pack_name", "capacity_tokens", "doc_id", "piece", "n_tokens", "container", F.round("fill", 6).alias("fill"))


def pack_report(packed: DataFrame) -> DataFrame:
    """Per pack: containers, documents, tokens, mean fill and the unused share."""
    boxes = packed.groupBy("pack_name", "capacity_tokens", "container").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("n"))
    used = F.sum("t") / (F.count(F.lit(1)) * F.col("capacity_tokens"))
    return boxes.groupBy("pack_name", "capacity_tokens").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("t").alias("n_tokens"), F.round(used, 6).alias("mean_fill"), F.round(1 - used, 6).alias("unused_share"))
