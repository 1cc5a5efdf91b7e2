"""Exact joins of 64-bit codes within a Hamming radius, on segmented code blocks.

The code is cut into ``radius + r`` blocks. Two codes within the radius agree in at least ``r`` whole blocks, so every
such pair meets in a bucket named by ``r`` blocks and their values. All pairs of a bucket are compared as vectors, and a
pair is reported only in the first bucket in which it meets, so no pair comes out twice and none is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provenix.functions.hashing import code, usable
from provenix.operators.skew import hot_keys, spread

__all__ = ["blocks", "close_pairs", "code", "keys", "matching_blocks", "usable", "with_keys"]

#: Rows of one bucket that a task compares with as many others; larger buckets are cut into such chunks.
CHUNK = 60_000
#: Elements of one comparison matrix held at a time.
_CELLS = 1 << 20
#: Seconds to move one row to its bucket, and to compare one pair: only the number of blocks depends on them, never the result.
_ROW_S, _PAIR_S = 1.5e-6, 4e-9


def blocks(radius: int, r: int) -> list[tuple[int, int]]:
    """(first bit, bits) of ``radius + r`` blocks that cover 64 bits."""
    n = radius + r
    edges = [64 * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def matching_blocks(rows: int, radius: int) -> int:
    """How many blocks must agree: the cheapest for so many codes; the result is the same for each."""
    def cost(r: int) -> float:
        cut = blocks(radius, r)
        buckets = math.comb(len(cut), r)
        return rows * buckets * _ROW_S + rows * rows / 2 * buckets / 2 ** (64 * r / len(cut)) * _PAIR_S

    return min((1, 2, 3), key=cost)


def _key_bits(cut: list[tuple[int, int]], r: int) -> int:
    """Bits of the widest ``r`` blocks: where the number of the combination stands in every key, as widths differ."""
    return sum(sorted(bits for _, bits in cut)[-r:])


def keys(column: str, radius: int, r: int) -> Column:
    """array<bigint> of the bucket keys of a code: the number of the combination, then the values of its blocks."""
    cut = blocks(radius, r)
    width = _key_bits(cut, r)
    out = []
    for k, combo in enumerate(combinations(range(len(cut)), r)):
        value = F.lit(0).cast("bigint")
        for b in combo:
            first, bits = cut[b]
            part = F.shiftrightunsigned(F.col(column), first).bitwiseAND(F.lit((1 << bits) - 1))
            value = F.shiftleft(value, bits).bitwiseOR(part)
        out.append(value.bitwiseOR(F.lit(k << width).cast("bigint")))
    return F.array(*out)


def with_keys(classes: DataFrame, radius: int, r: int) -> DataFrame:
    """The blocking-key table: one row per bucket of each (p, d)."""
    return classes.withColumn("bucket", F.explode(keys("p", radius, r)))


def _compare(radius: int, r: int, radius_d: int):
    cut = blocks(radius, r)
    combos = list(combinations(range(len(cut)), r))
    width = _key_bits(cut, r)
    masks = [np.uint64(((1 << bits) - 1) << first) for first, bits in cut]

    def first_meeting(x: np.ndarray, bucket: int) -> np.ndarray:
        """Whether the lowest ``r`` agreeing blocks of the pairs with these xors are the bucket's."""
        own = combos[bucket >> width]
        ok = np.ones(len(x), bool)
        for b in range(own[-1]):
            if b not in own:
                ok &= (x & masks[b]) != 0
        return ok

    def pairs(bucket: int, p: np.ndarray, d: np.ndarray, side: np.ndarray, chunk: np.ndarray):
        order = np.lexsort((d, p))
        p, d, side, chunk = p[order], d[order], side[order], chunk[order]
        left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
        if not len(left) or not len(right):
            return
        step = max(1, _CELLS // len(right))
        pr, dr = p[right].view("u8"), d[right].view("u8")
        both = len(left) == len(right) == len(p)
        for i in range(0, len(left), step):
            li = left[i:i + step]
            k = i if both else 0
            hit = np.bitwise_count(p[li].view("u8")[:, None] ^ pr[None, k:]) <= radius
            a, b = np.nonzero(hit)
            a, b = li[a], right[b + k]
            twice = (side[a] & 2 != 0) & (side[b] & 1 != 0)
            keep = np.where(twice, a < b, a != b)
            keep &= (chunk[a] != chunk[b]) | (chunk.min() == chunk.max())  # of two chunks, only pairs across; of one chunk with itself, all
            a, b = a[keep], b[keep]
            x, y = p[a].view("u8") ^ p[b].view("u8"), d[a].view("u8") ^ d[b].view("u8")
            keep = (np.bitwise_count(y) <= radius_d) & first_meeting(x, bucket)
            if keep.any():
                a, b, x, y = a[keep], b[keep], x[keep], y[keep]
                yield pa.RecordBatch.from_pydict({"p_a": p[a], "d_a": d[a], "p_b": p[b], "d_b": d[b],
                                                  "dist_p": np.bitwise_count(x).astype("i4"), "dist_d": np.bitwise_count(y).astype("i4")})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        at = None
        for batch in batches:
            col = [batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("bucket", "part", "p", "d", "side", "chunk")]
            if not len(col[0]):
                continue
            ends = np.flatnonzero((np.diff(col[0]) != 0) | (np.diff(col[1]) != 0)) + 1
            for a, b in zip([0, *ends], [*ends, len(col[0])]):
                here = (int(col[0][a]), int(col[1][a]))
                if here != at and held:
                    yield from pairs(at[0], *(np.concatenate(x) for x in zip(*held)))
                    held = []
                at = here
                held.append([c[a:b] for c in col[2:]])
        if held:
            yield from pairs(at[0], *(np.concatenate(x) for x in zip(*held)))

    return run


def close_pairs(keyed: DataFrame, radius: int, r: int, radius_d: int = 64) -> DataFrame:
    """Pairs of different (p, d) with p within ``radius`` and d within ``radius_d`` bits.

    ``keyed``: bucket, p, d, side, from :func:`with_keys`, each (p, d) with one ``side``. A pair is compared if one has
    bit 1 in ``side`` and the other bit 2. Every unordered pair comes out once. Buckets above CHUNK rows are cut into
    chunks and each pair of chunks goes to its own task, so no bucket is too large for one.
    """
    rows = keyed.select("bucket", "p", "d", "side")
    heavy = [(k, -(-n // CHUNK)) for k, n in hot_keys(keyed, "bucket", CHUNK)]
    if heavy:
        table = keyed.sparkSession.createDataFrame(heavy, "bucket bigint, _n int")
        rows = rows.join(F.broadcast(table), "bucket", "left").withColumn("_n", F.coalesce("_n", F.lit(1)))
        rows = rows.withColumn("chunk", F.pmod(F.xxhash64("p", "d"), F.col("_n")).cast("int"))
        rows = rows.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
        rows = rows.withColumn("part", (F.least("chunk", "_o") * F.col("_n") + F.greatest("chunk", "_o")).cast("int")).drop("_n", "_o")
    else:
        rows = rows.withColumn("chunk", F.lit(0)).withColumn("part", F.lit(0))
    sorted_ = spread(rows, "bucket", "part").sortWithinPartitions("bucket", "part")
    return sorted_.mapInArrow(_compare(radius, r, radius_d), "p_a bigint, d_a bigint, p_b bigint, d_b bigint, dist_p int, dist_d int")
