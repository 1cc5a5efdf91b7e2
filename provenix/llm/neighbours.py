"""The k most similar vectors of every vector.

Equal vectors are one class. Each class goes to the leaves of :mod:`provenix.llm.vectors` with its anisotropic four-bit
codes. In a leaf every class is a query: its tables are scanned over all codes, what may reach the least cosine is
reranked exactly. The scan loses nothing: with q.x >= c the error of the approximate score is at most the error along x
plus sqrt(1 - c*c) times the error across x, and both are stored with the code. What can be lost are pairs that share no
leaf; README gives the measured recall.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from provenix.llm import quantise, vectors
from provenix.operators.skew import salted_lookup, spread

#: Neighbours per vector, and the least cosine of a neighbour.
K, COSINE = 5, 0.90
#: Queries and rows of one scanned block.
QUERIES, ROWS = 128, 1024
#: Candidates whose exact similarities are held at a time.
_COLS = 4096

_ROUTED = "leaf bigint, part bigint, cls binary, vec binary, code binary, slack float, ids array<bigint>"


def _route(router: vectors.Router, book: np.ndarray, k: int, cosine: float, margin: float):
    sine = float(np.sqrt(1 - cosine * cosine))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pos, x = vectors.usable_rows(b.column(1))
            if not len(pos):
                continue
            ids = np.asarray(b.column(0))[pos]
            blobs = vectors.pack(x)
            cls = vectors.class_of(blobs)
            first, kept, _ = vectors.keep_ids(cls, ids, k + 1)
            u = vectors.unit(x[first])
            codes = quantise.encode(u, book)
            par, across = quantise.residuals(u, codes, book)
            slack = (par + sine * across + 1e-4).astype("f4")
            byte = quantise.fused(codes)
            row, leaf, part = vectors.route(u, [cls[i] for i in first], router, margin)
            yield pa.RecordBatch.from_arrays([
                pa.array(leaf), pa.array(part), pa.array([cls[first[r]] for r in row], pa.binary()), pa.array([blobs[first[r]] for r in row], pa.binary()),
                pa.array([byte[r].tobytes() for r in row], pa.binary()), pa.array(slack[row]), pa.array([kept[r] for r in row], pa.list_(pa.int64()))],
                ["leaf", "part", "cls", "vec", "code", "slack", "ids"])

    return run


def _search(book: np.ndarray, k: int, cosine: float):
    def best(x: np.ndarray, ids: list[list[int]], alone: np.ndarray, rows: np.ndarray, cols: np.ndarray):
        """Per row the k + 1 best ids of the candidate classes ``cols``."""
        most = k + 1
        low = np.array([i[0] for i in ids], "i8")
        least = np.full(len(rows), cosine)
        a, b, value = np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0)
        for i in range(0, len(cols), _COLS):
            some = cols[i:i + _COLS]
            cos = x[rows] @ x[some].T
            own = np.nonzero(rows[:, None] == some[None, :])
            cos[own] = np.where(alone[rows[own[0]]], -2.0, 1.0)
            ok = cos >= least[:, None] - 1e-9
            if ok.sum() > 4 * most * len(rows) and len(some) > 4 * most:
                ok &= cos >= np.partition(cos, -most, axis=1)[:, -most, None] - 1e-9
            r, c = np.nonzero(ok)
            v = np.round(cos[r, c], 9)
            keep = v >= least[r]
            a, b, value = np.r_[a, r[keep]], np.r_[b, some[c[keep]]], np.r_[value, v[keep]]
            order = np.lexsort((low[b], -value, a))
            a, b, value = a[order], b[order], value[order]
            rank = np.arange(len(a)) - np.searchsorted(a, a)
            a, b, value = a[rank < most], b[rank < most], value[rank < most]
            full = np.flatnonzero(rank[rank < most] == most - 1)
            least[a[full]] = value[full]
        start = np.searchsorted(a, np.arange(len(rows) + 1))
        for i in range(len(rows)):
            s, e = start[i], start[i + 1]
            if s < e:
                got = sorted((-value[j], x) for j in range(s, e) for x in ids[b[j]])[:most]
                yield rows[i], [x for _, x in got], [-v for v, _ in got]

    def leaf(part: np.ndarray, cls: list[bytes], vec: list[bytes], code: list[bytes], slack: np.ndarray, ids: list[list[int]]) -> pa.RecordBatch:
        at: dict[bytes, int] = {}
        keep = []
        for i, c in enumerate(cls):  # a class met in several batches
            if c in at:
                j = at[c]
                ids[j] = sorted({*ids[j], *ids[i]})[:k + 1]
            else:
                at[c] = i
                keep.append(i)
        ids = [ids[i] for i in keep]
        x = vectors.unit(vectors.unpack([vec[i] for i in keep]))
        # Neighbours side by side keep the candidates of a block few.
        order = np.argsort(vectors.nearest(x, vectors.fit_centres(x[:: max(1, len(x) // 512)], max(1, min(32, len(x) // QUERIES)))), kind="stable")
        x, keep, ids = x[order], [keep[i] for i in order], [ids[i] for i in order]
        codes = np.frombuffer(b"".join(code[i] for i in keep), "u1").reshape(len(keep), -1)
        least = np.float32(cosine) - slack[keep]
        alone = np.array([len(i) < 2 for i in ids])
        out_cls, out_ids, out_cos = [], [], []
        side = part[keep] != part.min()
        one, two = np.flatnonzero(~side), np.flatnonzero(side)
        for asked, stock in ((one, two), (two, one)) if len(two) else ((one, one),):  # of two parts, only pairs across
            stored, bound = codes[stock], least[stock]
            dense = False
            for q in range(0, len(asked), QUERIES):
                rows = asked[q:q + QUERIES]
                cols = stock
                if not dense:  # where most rows are candidates the scan is no use
                    table = quantise.tables(x[rows], book)
                    hit = np.concatenate([(quantise.scan(table, stored[i:i + ROWS]) >= bound[i:i + ROWS, None]).any(1) for i in range(0, len(stock), ROWS)])
                    cols = stock[hit]
                    dense = len(stock) > 8 * ROWS and len(cols) > len(stock) / 2
                for row, i, c in best(x, ids, alone, rows, cols):
                    out_cls.append(cls[keep[row]])
                    out_ids.append(i)
                    out_cos.append(c)
        return pa.RecordBatch.from_arrays([pa.array(out_cls, pa.binary()), pa.array(out_ids, pa.list_(pa.int64())), pa.array(out_cos, pa.list_(pa.float64()))], ["cls", "ids", "cos"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in vectors.by_leaf(batches):
            yield leaf(t["part"].to_numpy(), t["cls"].to_pylist(), t["vec"].to_pylist(), t["code"].to_pylist(), t["slack"].to_numpy(), t["ids"].to_pylist())

    return run


def neighbours(items: DataFrame, k: int = K, cosine: float = COSINE, margin: float = vectors.MARGIN) -> DataFrame:
    """(id, neighbour_id, cosine, rank): the ``k`` most similar other items with at least ``cosine``.

    Cosines are rounded to nine decimals; ties go to the smaller id. Vectors that are not usable neither ask nor are
    found. An item delivered twice counts once. No usable vector gives no rows.
    """
    source = items.select("id", F.col("embedding"))
    n = source.count()
    leaves = vectors.leaf_count(n)
    sample = vectors.packed_sample(source, max(vectors.LEAST_SAMPLE, vectors.SAMPLE_PER_LEAF * leaves), total=n)
    router = vectors.fit_router(sample, n, margin, last=vectors.depth(n) == 1)
    book = quantise.fit(sample[:: max(1, len(sample) // vectors.LEAST_SAMPLE)])
    rows = source.where(F.col("id").isNotNull() & (F.size("embedding") == vectors.DIM)).select("id", F.col("embedding").cast("array<double>"))
    routed = vectors.deepen(rows.mapInArrow(_route(router, book, k, cosine, margin), _ROUTED), n, margin)
    near = spread(routed, "leaf", partitions=vectors.partitions(items.sparkSession, router.copies)).sortWithinPartitions("leaf").mapInArrow(_search(book, k, cosine), "cls binary, ids array<bigint>, cos array<double>")
    best = near.select("cls", F.arrays_zip(F.transform("cos", lambda c: -c).alias("c"), F.col("ids").alias("i")).alias("z"))
    best = best.groupBy("cls").agg(F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("z")))), 1, k + 1).alias("z"))
    asked = salted_lookup(vectors.members(items), best, "cls", how="inner")
    others = F.slice(F.filter("z", lambda s: s["i"] != F.col("id")), 1, k)
    flat = asked.select("id", F.posexplode(others).alias("rank", "s"))
    return flat.select("id", F.col("s.i").alias("neighbour_id"), (-F.col("s.c")).alias("cosine"), (F.col("rank") + 1).cast("int").alias("rank"))
