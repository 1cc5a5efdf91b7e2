"""Core operators on hand-made rows: nulls, ties, repeats, empty tables, hot keys and clashing columns."""

from __future__ import annotations

import itertools
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from provenix.functions import binary, forensics, hashing, pixels, scoring, vectors
from provenix.operators import dedup, evaluation, hierarchy, lineage, mutate, pairs, prefix, references, sampling, skew
from provenix.sources import files
from provenix.sources.tables import once_by_id


def one(spark, expr, **values):
    cols = [F.lit(v).alias(k) if not isinstance(v, (list, dict)) else F.array(*[F.lit(x) for x in v]).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(expr.alias("x")).first()[0]


# ---- hierarchies ----
def brute(par, nodes):
    out = {}
    for n in nodes:
        if n not in par:
            continue
        seen, x = [], n
        while x in par and x not in seen:
            seen.append(x)
            x = par[x]
        if x in par:
            ring = seen[seen.index(x):]
            out[n] = (min(ring), None, "cycle" if n in ring else "below_cycle")
        else:
            out[n] = (x, len(seen), "tree")
    return out


def test_hierarchy_shapes(spark):
    rng = random.Random(1)
    par = {i: i - 1 for i in range(1, 300)}  # one deep chain
    par |= {1000 + i: 1000 for i in range(1, 200)}  # a hot parent
    par |= {2000 + i: 2000 + (i + 1) % 40 for i in range(40)} | {2100: 2003, 2101: 2100}  # a long cycle and a tail
    par |= {3000: 3000, 3001: 3000, 3002: 3003, 3003: 3002}  # short cycles
    par |= {4000 + i: rng.randint(4000, 4000 + max(0, i - 1)) for i in range(1, 150)}
    links = spark.createDataFrame(list(par.items()), "node bigint, parent bigint")
    rows = hierarchy.resolve(links, paths=True).collect()
    assert len(rows) == len(par)
    assert {r.node: (r.root, r.depth, r.status) for r in rows} == brute(par, par)
    for r in rows:
        if r.status == "tree":
            assert r.path[0] == r.root and r.path[-1] == r.node and all(par[b] == a for a, b in itertools.pairwise(r.path))
        else:
            assert r.path is None
    assert hierarchy.resolve(links.limit(0)).count() == 0


def test_media_hierarchy(spark):
    rows = [(1, None, None), (2, 1, 9), (2, 1, 9), (3, None, 2), (4, None, 4), (5, 99, 1), (6, 6, None), (7, 6, None), (8, 7, None), (None, 1, 1)]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], "id bigint, parent_id bigint, estimated_origin_id bigint, node string, root int")
    got = {r.media_id: (r.root_id, r.depth, r.path, r.status, r.n_descendants) for r in hierarchy.hierarchy(df).collect()}
    assert got == {1: (1, 0, "1", "root", 2), 2: (1, 1, "1/2", "tree", 1), 3: (1, 2, "1/2/3", "tree", 0), 4: (4, 0, "4", "root", 0), 5: (5, 0, "5", "root", 0),
                   6: (6, None, None, "cycle", None), 7: (6, None, None, "below_cycle", 1), 8: (6, None, None, "below_cycle", 0)}
    assert {tuple(r) for r in hierarchy.descendants(df).collect()} == {(1, 2, 1, False), (1, 3, 2, False), (2, 3, 1, False), (7, 8, 1, False), (6, 7, None, True), (6, 8, None, True)}


@settings(max_examples=3, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=31, max_size=31))
def test_any_pointer_graph(spark, targets):
    par = {i: t for i, t in enumerate(targets) if t != 30}
    links = spark.createDataFrame([(n, p) for n, p in par.items()], "node bigint, parent bigint").coalesce(1)
    got = {r.node: (r.root, r.depth, r.status) for r in hierarchy.resolve(links).collect()}
    assert got == brute(par, par)


# ---- references ----
def test_orphans(spark):
    import datetime as dt

    t = lambda d: dt.datetime(2024, 1, d)
    items = spark.createDataFrame([(1, t(5)), (1, t(5)), (2, None), (-3, t(1)), (70_000, t(1)), (None, t(1))], "id bigint, ingested_at timestamp_ntz")
    gone = spark.createDataFrame([(2, None), (1, t(3)), (500, None)], "media_id bigint, restored_at timestamp_ntz")
    rel = spark.createDataFrame([(10, 1, 2, t(6)), (10, 1, 2, t(6)), (11, 1, None, t(4)), (12, -3, 70_000, t(2)), (13, 404, -70_000, None), (14, 500, 1, None)], "id bigint, source_id bigint, target_id bigint, created_at timestamp_ntz")
    frames = spark.createDataFrame([(20, 1, t(4)), (21, None, t(1))], "id bigint, media_id bigint, extracted_at timestamp_ntz")
    got = {(r.ref_table[0], r.ref_column, r.row_id): (r.missing, r.deleted, r.later) for r in references.media_orphans(items, gone, rel, frames).collect()}
    assert got == {("m", "target_id", 10): (False, True, False), ("m", "source_id", 11): (False, False, True), ("m", "source_id", 13): (True, False, False), ("m", "target_id", 13): (True, False, False),
                   ("m", "source_id", 14): (True, True, False), ("k", "media_id", 20): (False, False, True)}
    assert references.media_orphans(items.limit(0), gone.limit(0), rel, frames).count() == 10
    assert references.media_orphans(items, gone, rel.limit(0), frames.limit(0)).count() == 0
    months = {(r.ref_column, r.month): r.n_bad for r in references.by_month(references.media_orphans(items, gone, rel, frames)).collect()}
    assert months[("source_id", None)] == 2


def test_orphans_with_a_hot_range(spark, monkeypatch):
    monkeypatch.setattr(skew, "HOT_ROWS", 100)
    items = spark.range(0, 5000, 2).select(F.col("id"), F.lit(None).cast("timestamp_ntz").alias("ingested_at"))
    gone = spark.createDataFrame([], "media_id bigint, restored_at timestamp_ntz")
    rel = spark.range(3000).select("id", F.col("id").alias("source_id"), F.lit(None).cast("bigint").alias("target_id"), F.lit(None).cast("timestamp_ntz").alias("created_at"))
    frames = spark.createDataFrame([], "id bigint, media_id bigint, extracted_at timestamp_ntz")
    assert sorted(r.row_id for r in references.media_orphans(items, gone, rel, frames).collect()) == list(range(1, 3000, 2))


# ---- skew, prefix sums, tables ----
def test_salted_lookup_keeps_every_row(spark):
    many = spark.range(4000).select(F.when(F.col("id") < 3000, 7).otherwise(F.col("id") % 50).alias("k"), "id")
    dim = spark.range(0, 60, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    for how in ("left", "inner"):
        plain = sorted((r.id, r.k, r.v) for r in many.join(dim, "k", how).collect() if True) if how == "inner" else None
        got = skew.salted_lookup(many, dim, "k", how=how, hot=skew.hot_hashes(many, "k", least=100))
        assert got.count() == many.join(dim, "k", how).count()
        if plain:
            assert sorted((r.id, r.k, r.v) for r in got.collect()) == plain
    assert skew.hot_keys(many, "k", least=100)[0][:2] == (7, 3020)


def test_cumulative(spark, monkeypatch):
    monkeypatch.setattr(prefix, "RANGES", 8)
    rng = random.Random(3)
    vals = sorted({rng.uniform(-5, 5) for _ in range(300)})
    df = spark.createDataFrame([(v, i) for i, v in enumerate(vals)], "v double, n bigint")
    got = sorted((r.v, r.c_n) for r in prefix.cumulative(df, "v", "n").collect())
    assert got == [(v, sum(range(i + 1))) for i, v in enumerate(vals)]


def test_once_by_id(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, None), (None, "z")], "id bigint, x string")
    assert sorted(tuple(r) for r in once_by_id(df, "id", "x").collect()) == [(1, "a"), (2, None)]


def test_snapshots(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b"), (None, "c")], "k int, v string")
    change = spark.createDataFrame([(2, "B"), (3, "C")], "k int, v string")
    rows = lambda df: sorted(map(tuple, df.collect()), key=repr)
    assert rows(mutate.update(base, change, "k")) == [(1, "a"), (2, "B"), (None, "c")]
    assert rows(mutate.upsert(base, change, "k")) == [(1, "a"), (2, "B"), (3, "C"), (None, "c")]
    assert rows(mutate.delete_keys(base, change, "k")) == [(1, "a"), (None, "c")]


# ---- hashes, vectors, scores ----
@settings(max_examples=8, deadline=None)
@given(st.integers(0, 2**64 - 1), st.integers(0, 2**64 - 1))
def test_hamming_is_a_metric(spark, a, b):
    d = one(spark, hashing.hamming64("a", "b"), a=f"{a:016x}", b=f" {b:016X} ")
    assert d == (a ^ b).bit_count() and d == one(spark, hashing.hamming64("b", "a"), a=f"{a:016x}", b=f"{b:016x}")


@pytest.mark.parametrize("a,b,d", [(None, "0" * 16, 64), ("", "0" * 16, 64), ("zz", "0" * 16, 64), ("0" * 16, "f" * 16, 64), ("f" * 16, "f" * 16, 0)])
def test_hamming_edges(spark, a, b, d):
    assert one(spark, hashing.hamming64(F.lit(a), F.lit(b))) == d


def test_grid_hash(spark):
    v = [float(x) for x in range(64)]
    assert one(spark, hashing.hash_of_grid("v", "p"), v=v) == "00000000ffffffff"
    assert one(spark, hashing.hash_of_grid("v", "d"), v=v) == "0000000000000001"
    assert one(spark, hashing.hash_of_grid("v", "a"), v=v[:63]) is None


@pytest.mark.parametrize("a,b,c", [([1.0, 0.0], [-1.0, 0.0], -1.0), ([0.0, 0.0], [1.0, 1.0], 0.0), ([1.0], [1.0, 2.0], 0.0), ([3.0, 4.0], [3.0, 4.0], 1.0), ([float("nan")], [1.0], 0.0)])
def test_cosine(spark, a, b, c):
    assert one(spark, vectors.cosine("a", "b"), a=a, b=b) == pytest.approx(c)


def test_scores_at_their_edges(spark):
    f = lambda x: F.lit(x)
    for s, level in ((0.85, "High Match"), (0.58, "Possible Match"), (0.5799, "No Significant Match")):
        assert one(spark, scoring.match_level(f(s))) == level
    assert one(spark, F.array_join(scoring.gate_reasons(f(False), f(0.30), f(0.35), f(1), f(0.0)), ",")) == ""
    assert one(spark, F.array_join(scoring.gate_reasons(f(True), f(0.39), f(0.40), f(9), f(0.59)), ",")) == "ssim,inliers,semantic"
    assert one(spark, scoring.aspect_similarity(f(0), f(5), f(5), f(0))) == 1.0
    assert one(spark, scoring.jpeg_similarity(f(None).cast("int"), f(5))) == 1.0
    assert one(spark, forensics.compression_status(f(None).cast("int"), f(None).cast("double"))) == "CLEAN"


# ---- evaluation ----
def test_measures_without_a_class(spark):
    df = spark.createDataFrame([(0.3, 1), (0.6, 1), (1.0, 1), (None, 1)], "p double, y int")
    assert evaluation.auc(df, "p", "y").first()[0] == 0.0
    assert [r.n for r in evaluation.reliability(df, "p", "y").orderBy("bin").collect()] == [0, 0, 1, 0, 0, 1, 0, 0, 0, 1]
    empty = df.limit(0)
    assert evaluation.auc(empty, "p", "y", 0.5).first()[0] == 0.5
    assert evaluation.roc(empty, "p", "y").count() == 0 and evaluation.pr_auc(empty, "p", "y").first()[0] == 0.0
    r = evaluation.rates(empty.agg(*evaluation.confusion(F.col("p") > 0.5, F.col("y")))).first()
    assert r.accuracy == 0.0 and r.f1 == 0.0


def test_auc_with_ties(spark):
    rng = random.Random(5)
    rows = [(float(rng.randint(0, 20)), rng.randint(0, 1)) for _ in range(400)]
    pos, neg = [s for s, y in rows if y], [s for s, y in rows if not y]
    want = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    assert evaluation.auc(spark.createDataFrame(rows, "s double, y int"), "s", "y").first()[0] == pytest.approx(want, abs=1e-6)


# ---- duplicates, samples, pairs, lineage ----
def test_greedy_near_duplicates(spark):
    rng = random.Random(7)
    codes = [rng.getrandbits(64) for _ in range(30)]
    rows = []
    for i in range(300):
        c = rng.choice(codes)
        for b in rng.sample(range(64), rng.choice([0, 1, 2, 3])):
            c ^= 1 << b
        rows.append((i, f"{c:016x}"))
    rows += [(900, None), (901, "junk")]
    kept, want = [], {}
    for i, h in rows:
        ok = h is None or len(h) != 16 or all((int(h, 16) ^ k).bit_count() > 2 for k in kept)
        want[i] = ok
        if ok and h and len(h) == 16:
            kept.append(int(h, 16))
    got = {r.id: r.kept for r in dedup.greedy_near(spark.createDataFrame(rows, "id bigint, h string"), "id", "h", 2).collect()}
    assert got == want


def test_splits_keep_groups_together(spark):
    df = spark.createDataFrame([(i, f"g{i % 40}") for i in range(400)], "id bigint, g string")
    out = sampling.hash_split(df, F.col("g"), {"train": 80, "test": 20}, 1)
    assert out.groupBy("g").agg(F.count_distinct("part").alias("n")).where("n > 1").count() == 0
    assert {r.part for r in out.collect()} == {"train", "test"}


def test_probe_join_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PROBE_BLOCK", 7)
    rng = random.Random(2)
    h = lambda: f"{rng.getrandbits(64):016x}"
    base = h()
    rows = [(i, base if i % 3 == 0 else h(), h() if i % 4 else None, h()) for i in range(60)] + [(99, None, None, None)]
    df = spark.createDataFrame(rows, "id bigint, phash string, dhash string, ahash string")
    sim = lambda a, b: sum(w * (1 - (64 if a[k] is None or b[k] is None else (int(a[k], 16) ^ int(b[k], 16)).bit_count()) / 64) for k, w in ((1, 0.5), (2, 0.3), (3, 0.2)))
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] % 2 == 0 and a[0] != b[0] and a[1] and b[1] and sim(a, b) >= 0.6}
    assert {(r.probe_id, r.id) for r in pairs.probe_join(df, df.where("id % 2 = 0"), 0.6).collect()} == want


def test_probe_join_memory(spark, monkeypatch):
    """a batch of items is compared in small blocks, whatever it and the probes hold."""
    h = lambda n, seed: [f"{random.Random(seed + i).getrandbits(64):016x}" for i in range(n)]
    df = spark.createDataFrame(list(zip(range(2000), h(2000, 1), h(2000, 10_000), h(2000, 20_000))), "id bigint, phash string, dhash string, ahash string")
    caught = []
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, f, schema: caught.append(f) or self)
    pairs.probe_join(df, df, 0.5)
    code = lambda v: pa.array(np.array([int(x, 16) for x in v], "u8").view("i8"))
    got = df.toArrow()
    yes = pa.array([True] * 2000)
    batch = pa.RecordBatch.from_arrays([pa.array(range(2000)), *[code(got[f"{c}hash"].to_pylist()) for c in "pda"], yes, yes, yes], ["id", "p", "d", "a", "has_p", "has_d", "has_a"])
    tracemalloc.start()
    n = sum(b.num_rows for b in caught[0](iter([batch])))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert 1_800_000 < n < 2_300_000
    assert peak < 16 << 20


def test_probe_join_meets_least_as_sql_does(spark):
    """Of pairs whose exact similarity is 0.5, those that fall short in floating point are left out, others are kept."""
    mask = lambda n: f"{(1 << n) - 1:016x}"
    rows = [(0, mask(0), mask(0), mask(0))] + [(1 + i, mask(p), mask(d), mask(a)) for i, (p, d, a) in enumerate((p, d, a) for p in range(0, 65, 3) for d in range(65) for a in range(65) if 5 * p + 3 * d + 2 * a == 320)]
    df = spark.createDataFrame(rows, "id bigint, phash string, dhash string, ahash string")
    bits = lambda r: [int(x, 16).bit_count() for x in r[1:]]
    want = {r[0] for r in rows[1:] if 0.5 * (1 - bits(r)[0] / 64) + 0.3 * (1 - bits(r)[1] / 64) + 0.2 * (1 - bits(r)[2] / 64) >= 0.5}
    got = pairs.probe_join(df, df.where("id = 0"), 0.5).collect()
    assert 0 < len(want) < len(rows) - 1
    assert {r.id for r in got} == want and {r.visual_similarity for r in got} == {0.5}


def test_probe_join_takes_little_disk(spark, tmp_path):
    """F1: a probe's pairs are written next to each other, the most similar first; item by item they took 2.3 bytes a row."""
    h = lambda i: f"{random.Random(i).getrandbits(64):016x}"
    df = spark.createDataFrame([(i, h(i), h(i + 10_000), h(i + 20_000)) for i in range(1600)], "id bigint, phash string, dhash string, ahash string")
    pairs.probe_join(df, df, 0.5).write.parquet(to := str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*.parquet"))
    assert sum(f.stat().st_size for f in files) < 2 * spark.read.parquet(to).count() > 2_000_000


@pytest.mark.parametrize("pair_block", [1, 7, 150, 40_000])
def test_probe_join_in_blocks_of_items_and_probes(spark, monkeypatch, pair_block):
    """the same pairs and similarities wherever items and probes are cut, each once."""
    monkeypatch.setattr(pairs, "PAIR_BLOCK", pair_block)
    rng = random.Random(3)
    h = lambda: rng.choice([None, "x", *[f"{rng.getrandbits(64):016x}"] * 8])
    rows = [(i, h(), h(), h()) for i in range(60 if pair_block < 40_000 else 600)]
    df = spark.createDataFrame(rows, "id bigint, phash string, dhash string, ahash string")
    code = lambda v: int(v, 16) if v and len(v) == 16 else None
    part = lambda a, b, k: 1 - (64 if a[k] is None or b[k] is None else (a[k] ^ b[k]).bit_count()) / 64
    coded = [(i, *map(code, x)) for i, *x in rows]
    sim = lambda a, b: 0.5 * part(a, b, 1) + 0.3 * part(a, b, 2) + 0.2 * part(a, b, 3)
    want = {(a[0], b[0]): round(sim(a, b), 9) for a in coded for b in coded if a[0] % 3 == 0 and a[0] != b[0] and a[1] is not None and b[1] is not None and sim(a, b) >= 0.5}
    got = pairs.probe_join(df, df.where("id % 3 = 0"), 0.5).collect()
    assert {(r.probe_id, r.id): r.visual_similarity for r in got} == want and len(got) == len(want) > 50


@pytest.mark.parametrize("block_from", [1, 40, 10**6])
def test_probe_join_within_a_column(spark, monkeypatch, block_from):
    """the same pairs whether groups are compared in blocks or lined up, also without hashes, values or probes."""
    for name, n in (("PROBE_BLOCK", 3), ("PAIR_BLOCK", 11), ("BLOCK_FROM", block_from)):
        monkeypatch.setattr(pairs, name, n)
    rng = random.Random(5)
    h = lambda: rng.choice([None, "x", *[f"{rng.getrandbits(64):016x}"] * 8])
    rows = [(i, rng.choice(["a"] * 9 + ["b", "b", "c", "d", None]) if i < 150 else f"e{i}", h(), h(), h()) for i in range(160)]
    df = spark.createDataFrame(rows, "id bigint, place string, phash string, dhash string, ahash string")
    code = lambda v: int(v, 16) if v and len(v) == 16 else None
    dist = lambda x, y: 64 if x is None or y is None else (x ^ y).bit_count()
    part = lambda a, b, k: 1 - dist(code(a[k]), code(b[k])) / 64
    sim = lambda a, b: 0.5 * part(a, b, 2) + 0.3 * part(a, b, 3) + 0.2 * part(a, b, 4)  # noqa: E731  # sum() would correct its rounding
    want = {(a[0], b[0]): round(sim(a, b), 9) for a in rows for b in rows if a[0] % 3 == 0 and a[0] != b[0] and a[1] and a[1] == b[1] and code(a[2]) is not None and code(b[2]) is not None and sim(a, b) >= 0.5}
    got = pairs.probe_join_within(df, df.where("id % 3 = 0"), "place", 0.5).collect()
    assert {(r.probe_id, r.id): r.visual_similarity for r in got} == want and len(got) == len(want) > 100
    assert pairs.probe_join_within(df, df.limit(0), "place").count() == 0


def test_probe_join_within_spreads_a_hot_value(spark):
    """the pairs of one value are compared in all tasks; an equi-join had them in one."""
    h = lambda i: f"{random.Random(i).getrandbits(64):016x}"
    df = spark.createDataFrame([(i, 17, h(i), h(i + 1000), h(i + 2000)) for i in range(400)], "id bigint, place bigint, phash string, dhash string, ahash string").dropDuplicates(["id"])
    n = [r["count"] for r in pairs.probe_join_within(df, df.where("id % 2 = 0"), "place", 0.5).groupBy(F.spark_partition_id()).count().collect()]
    assert max(n) < 0.5 * sum(n)


def test_vector_probe_and_mutual_nearest(spark, monkeypatch):
    monkeypatch.setattr(pairs, "PROBE_BLOCK", 3)
    monkeypatch.setattr(pairs, "PASS_BYTES", 500)
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(6).round(2).tolist()) for i in range(40)] + [(50, [1.0] * 6), (51, [2.0] * 6), (52, [1.0] * 6), (60, None), (61, []), (62, [0.0] * 6), (63, [1.0, None] + [1.0] * 4), (64, [1.0] * 5)]
    df = spark.createDataFrame(rows, "vec_id bigint, e array<double>")
    good = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and len(v) == 6 and None not in v and any(v)}
    cos = {(a, b): round(float(good[a] @ good[b]), 6) for a in good for b in good if a != b}
    got = {(r.probe_id, r.id) for r in pairs.vector_probe(df, df.where("vec_id % 5 = 0"), "vec_id", "e", 0.4).collect()}
    assert got == {(a, b) for (a, b), x in cos.items() if a % 5 == 0 and x >= 0.4}
    best = {a: min((b for b in good if b != a), key=lambda b: (-cos[a, b], b)) for a in good}
    assert {(r.a, r.b) for r in pairs.mutual_nearest(df, df.where("vec_id % 5 = 0"), "vec_id", "e").collect()} == {(a, b) for a, b in best.items() if a % 5 == 0 and best[b] == a}
    assert pairs.vector_probe(df, df.limit(0), "vec_id", "e").count() == 0


def test_online_clusters_equal_the_sequential_rule(spark):
    rng = random.Random(4)
    items = [(i, i % 3) for i in range(1, 90)]
    rel = [(rng.randint(1, 89), rng.randint(1, 89), round(rng.random(), 2)) for _ in range(300)]
    case = dict(items)
    cluster = {}
    for i in range(1, 90):
        best = {}
        for a, b, s in rel:
            lo, hi = sorted((a, b))
            if hi == i and lo != hi and s >= 0.58 and case[lo] == case[i]:
                best[lo] = max(s, best.get(lo, 0))
        cluster[i] = cluster[min(best, key=lambda o: (-best[o], o))] if best else i
    got = {r.id: r.cluster for r in lineage.online_clusters(spark.createDataFrame(items, "id bigint, case_id bigint"), spark.createDataFrame(rel, "source_id bigint, target_id bigint, combined_score double")).collect()}
    assert got == cluster


# ---- bytes, pixels, files ----
def test_bytes(spark, tmp_path):
    head = b"\xff\xd8\xff\xdb\x00\x43\x00" + bytes(binary.STANDARD)
    two = head + b"\xff\xdb\x00\x43\x01" + bytes([7] * 64) + b"\xff\xda"
    wide = b"\xff\xd8\xff\xdb\x00\x83\x12" + bytes(128) + b"\xff\xda"
    late = b"\xff\xd8\xff\xda" + head[2:]
    rows = [(1, two), (2, b""), (3, None), (4, wide), (5, late)]
    t = {r.id: r.t for r in spark.createDataFrame(rows, "id int, b binary").select("id", binary.quantisation_tables("b").alias("t")).collect()}
    assert t[1] == {0: binary.STANDARD, 1: [7] * 64} and t[2] == {} and t[3] == {} and len(t[4][2]) == 128 and t[5] == {}
    q = lambda v: one(spark, binary.jpeg_quality(F.array(*map(F.lit, v))))
    assert q(binary.STANDARD) == 50 and q([1] * 64) == 99 and q([255] * 64) >= 1 and q([1] * 10) is None
    assert binary.entropy(b"") == 0 and binary.entropy(bytes(range(256))) == pytest.approx(8) and binary.entropy(b"aaaa") == 0
    for tail, found in ((16, 0), (17, 17)):
        assert binary._tail(head + b"\xff\xd9" + b"x" * tail, ".JPG")[0] == found
    assert binary._tail(b"\x89PNG..IEND\xaeB`\x82PK\x03\x04" + b"z" * 20, "png")[:3] == (24, True, False) and binary._tail(None, None)[0] == 0
    points = lambda size, kinds, e, trusted, bits=None: one(spark, binary.appended_suspicion(F.struct(F.lit(size).alias("tail_bytes"), *[F.lit(k in kinds).alias(k) for k in binary.SIGNATURES], F.lit(e).alias("entropy")), F.lit(trusted), None, F.lit(bits).cast("double")))
    assert [points(0, (), 7.6, False), points(0, (), 7.93, None), points(200_000, ("jpeg",), 0.0, True), points(200_000, ("archive", "program", "png", "jpeg"), 8.0, True), points(0, (), 1.0, False, 0.99)] == [10, 30, 60, 99, 25]
    (tmp_path / "in").mkdir()
    (tmp_path / "a.JPG").write_bytes(two)
    (tmp_path / "in" / "b.png").write_bytes(b"")
    (tmp_path / "c.txt").write_bytes(b"no")
    got = {r.path.rsplit("/", 1)[1]: r.length for r in files.digests(files.binary_files(spark, str(tmp_path))).collect()}
    assert got == {"a.JPG": len(two)}  # the scan leaves out empty files


def test_pixels():
    rng = np.random.default_rng(0)
    g = rng.integers(0, 256, (64, 96)).astype("f8")
    assert len(pixels.phash(g)) == 16 and pixels.ssim(g, g) == pytest.approx(1)
    assert pixels.ssim(g, 255 - g) < 0.2 and pixels.blockiness(np.ones((8, 8))) == 1.0
    blocks = np.kron(rng.integers(0, 256, (8, 8)), np.ones((8, 8)))
    assert pixels.blockiness(blocks) > 5 and pixels.sharpness(np.ones((16, 16)))[0] == 0
    x = rng.integers(0, 180, (500, 3))
    assert pixels.histogram_correlation(x, x) == pytest.approx(1) and 0 <= pixels.histogram_correlation(x, rng.integers(0, 180, (500, 3))) <= 1
    assert np.allclose(pixels.dct_matrix(32) @ pixels.dct_matrix(32).T, np.eye(32))
    assert pixels.merged_boxes([(0, 0, 10, 10, 0.3), (0, 50, 10, 10, 0.5), (500, 500, 10, 10, 0.4)]) == [(0, 0, 10, 60, 0.5), (500, 500, 10, 10, 0.4)]
    assert pixels.variant(g, "cropped").shape == (64 - 2 * 9, 96 - 2 * 14) and pixels.variant(g, "resized").shape == (32, 32)
    assert pixels._grid(None) is None and pixels._grid([[1, 2], [3]]) is None


def test_audio(spark):
    a = F.array(*[F.array(*map(F.lit, v)) for v in ([1.0, 0.0], [0.0, 1.0], [1.0, 1.0])])
    b = F.array(*[F.array(*map(F.lit, v)) for v in ([0.0, 2.0], [3.0, 3.0])])
    m, yes, none = F.array(F.lit(1.0), F.lit(0.0)), F.lit(True), F.array().cast("array<array<double>>")
    sim = lambda *x: spark.range(1).select(vectors.audio_similarity(*x).alias("s")).first()[0]
    assert sim(yes, a, m, yes, b, m) == pytest.approx(1) and sim(yes, none, m, yes, b, m) == pytest.approx(1) and sim(F.lit(None).cast("boolean"), a, m, yes, b, m) == 0


def test_forest(spark):
    from provenix.operators.forest import train_and_rate

    rng = random.Random(1)
    df = spark.createDataFrame([(x := rng.random(), rng.random(), int(x > 0.5)) for _ in range(400)], "a double, b double, y int")
    got = {r.name: r.value for r in train_and_rate(df, ["a", "b"], "y").collect()}
    assert got["importance of a"] > got["importance of b"] and got["accuracy"] > 0.9


def test_package_stands_without_llm():
    import ast
    import pathlib

    root = pathlib.Path(__file__).parent.parent / "provenix"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert not any("llm" in (getattr(n, "module", None) or "") or any("llm" in a.name for a in getattr(n, "names", [])) for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, (ast.Import, ast.ImportFrom)))
    assert math.isfinite(1.0)
