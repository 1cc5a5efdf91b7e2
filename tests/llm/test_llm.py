"""Training-data operators against brute force on small tables with nulls, blanks, ties, repeats and clashing columns."""

from __future__ import annotations

import datetime as dt
import importlib.util
import random

import numpy as np
import pytest

pytestmark = pytest.mark.skipif(importlib.util.find_spec("provenix.llm") is None, reason="subpackage not installed")

if importlib.util.find_spec("provenix.llm") is not None:
    from provenix.llm import clusters, components, garble, hamming, linkage, mixing, neighbours, overlap, packing, quantise, tokens, vectors

from conftest import SF


def _hex(x: int) -> str:
    return f"{x & (2**64 - 1):016x}"


def _near(rng: random.Random, x: int, bits: int) -> int:
    for b in rng.sample(range(64), bits):
        x ^= 1 << b
    return x


@pytest.mark.parametrize("r", [1, 2])
def test_close_pairs_finds_every_pair_once(spark, r):
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    codes = sorted({c for b in base for c in (b, _near(rng, b, 1), _near(rng, b, 3), _near(rng, b, 6), _near(rng, b, 7))})
    signed = [c - 2**64 if c >= 2**63 else c for c in codes]
    df = spark.createDataFrame([(c, 0, 3) for c in signed], "p bigint, d bigint, side int")
    got = [tuple(sorted((x.p_a, x.p_b))) for x in hamming.close_pairs(hamming.with_keys(df, 6, r), 6, r).collect()]
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(codes)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 6}
    assert len(got) == len(set(got)) and set(got) == want


def test_close_pairs_with_blocks_of_unequal_width(spark):
    """Three of nine blocks, as for very many codes: the last block is wider than the others."""
    test_close_pairs_finds_every_pair_once(spark, 3)


def test_close_pairs_cuts_hot_buckets(spark, monkeypatch):
    monkeypatch.setattr(hamming, "CHUNK", 50)
    rng = random.Random(6)
    codes = sorted({(0xABCD << 48) | rng.getrandbits(12) for _ in range(400)})
    signed = [c - 2**64 for c in codes]
    df = spark.createDataFrame([(c, 0, 3) for c in signed], "p bigint, d bigint, side int")
    keyed = hamming.with_keys(df, 6, 1)
    got = [tuple(sorted((x.p_a, x.p_b))) for x in hamming.close_pairs(keyed, 6, 1).collect()]
    want = {tuple(sorted((signed[i], signed[j]))) for i in range(len(codes)) for j in range(i) if (codes[i] ^ codes[j]).bit_count() <= 6}
    assert len(got) == len(set(got)) and set(got) == want


AUDIT = "audit_id bigint, filepath string, filename string, split string, sha256 string, phash string, width int, height int, source string, part string, name string"


def test_overlaps(spark):
    h = 0x0123456789ABCDEF
    rows = [
        (1, "d/a/train/x/f.jpg", "f.jpg", "Train ", "AA", _hex(h), 10, 10, "A", "x", "y"),
        (1, "d/a/train/x/f.jpg", "f.jpg", "Train ", "AA", _hex(h), 10, 10, "A", "x", "y"),  # delivered twice
        (2, "d/a/Test_set/x/g.jpg", "g.jpg", None, " aa ", None, None, None, "b", None, None),  # by sha, split from the folder
        (3, None, "h.jpg", "val", None, " " + _hex(h ^ 0b111111).upper() + " ", 1, 1, None, None, None),  # 6 bits
        (4, None, "i.jpg", "val", "", _hex(h ^ 0b1111111), 1, 1, None, None, None),  # 7 bits
        (5, None, "Copy of G (2).png.bak", "test", None, "n/a", 10, 10, None, None, None),  # another name
        (6, None, "Copy of F (2).png.bak", "test", None, "n/a", 10, 10, None, None, None),  # the same name
        (7, None, "F_512px.JPG", "test", None, "", 10, 11, None, None, None),  # another size
        (8, None, "f.jpg", "unknown", "aa", _hex(h), 10, 10, None, None, None),  # no split
        (9, None, None, None, None, None, None, None, None, None, None),
    ]
    got = {(r.train_id, r.eval_id): (r.same_sha, r.dist, r.same_name) for r in overlap.overlaps(spark.createDataFrame(rows, AUDIT)).collect()}
    assert got == {(1, 2): (True, None, False), (1, 3): (False, 6, False), (1, 6): (False, None, True)}
    assert overlap.overlaps(spark.createDataFrame([], AUDIT)).count() == 0
    report = {(r.split, r.source): (r.n_records, r.n_overlapping, r.n_pairs) for r in overlap.overlap_report(spark.createDataFrame(rows, AUDIT)).collect()}
    assert report[("test", "b")] == (1, 1, 1) and report[("val", None)] == (2, 1, 1)


@pytest.mark.parametrize("name", ["f_copy.jpg", " F .jpeg", "thumb_f.png", "f-edited.png", "f_resized.jpg", "f_q75.webp", "f.jpg.bak", "f_src_IPHONE.jpg", "Copy of f (3)_copy.jpg"])
def test_name_key(spark, name):
    assert spark.createDataFrame([(name,)], "f string").select(overlap.name_key("f")).first()[0] == "f"


def _brute_groups(edges):
    up = {}

    def top(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None and a != b:
            a, b = sorted((top(a), top(b)))
            up[b] = a
    return {(x, top(x)) for x in up}


def test_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(50)] + [(rng.randint(200, 400), rng.randint(200, 400)) for _ in range(90)] + [(7, 7), (None, 3), (5, 4), (4, 5)]
    edges += [(-5, 900), (900, 901), (500, 500)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    got = [tuple(r) for r in components.components(df).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute_groups(edges)
    assert components.components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def test_media_groups(spark):
    items = spark.createDataFrame([(1, 1, "a"), (1, 1, "a"), (2, 1, "a"), (3, 2, "a"), (4, 2, None), (5, 2, None), (6, None, "z"), (7, None, "z"), (None, 1, "a")], "id bigint, case_id bigint, cluster_id string")
    rel = spark.createDataFrame([(2, 3, 0.58), (4, 5, 0.57), (4, 4, 0.9), (4, 99, 0.9), (5, 4, None), (6, 7, float("nan"))], "source_id bigint, target_id bigint, combined_score double")
    assert {tuple(r) for r in components.media_groups(items, rel).collect()} == {(1, 1), (2, 1), (3, 1)}


def _vectors(rng, groups):
    out = []
    for n in groups:
        c = rng.standard_normal(64)
        c /= np.linalg.norm(c)
        for _ in range(n):
            v = c + rng.standard_normal(64) * 0.02
            out.append([round(float(x), 4) for x in v / np.linalg.norm(v)])
    return out


def _items(spark):
    rng = np.random.default_rng(8)
    v = _vectors(rng, [1] * 60 + [2] * 30 + [3] * 20 + [9] * 5 + [40])
    rows = [(i + 1, x) for i, x in enumerate(v)]
    rows += [(1001, v[60]), (1002, v[60]), (1003, [5 * x for x in v[62]]), (1004, [x / 7 for x in v[64]])]  # copies, other scales
    rows += [(1001, v[60])]  # delivered twice
    rows += [(2000, None), (2001, []), (2002, [0.0] * 64), (2003, [1.0] * 48), (2004, [float("nan")] + [1.0] * 63), (2005, [None] + [1.0] * 63), (None, v[60])]
    good = {i: np.array(x) for i, x in rows if i is not None and x is not None and len(x) == 64 and all(y is not None for y in x) and np.isfinite(x).all() and any(x)}
    ids = np.array(sorted(good))
    m = np.stack([good[i] for i in ids])
    m = m / np.linalg.norm(m, axis=1, keepdims=True)
    return spark.createDataFrame(rows, "id bigint, embedding array<double>"), ids, np.round(m @ m.T, 9)


def test_neighbours_against_brute_force(spark):
    df, ids, s = _items(spark)
    want = set()
    for i in range(len(ids)):
        near = sorted((-s[i, j], ids[j]) for j in range(len(ids)) if j != i and s[i, j] >= 0.9)[:5]
        want |= {(int(ids[i]), int(x), k + 1) for k, (_, x) in enumerate(near)}
    got = {(r.id, r.neighbour_id, r.rank) for r in neighbours.neighbours(df).collect()}
    assert got == want
    assert neighbours.neighbours(df.limit(0)).count() == 0


def test_clusters_against_brute_force(spark):
    df, ids, s = _items(spark)
    pairs = [(int(ids[i]), int(ids[j])) for i in range(len(ids)) for j in range(i) if s[i, j] >= 0.9]
    assert {tuple(r) for r in clusters.clusters(df).collect()} == _brute_groups(pairs)
    assert clusters.clusters(df.limit(0)).count() == 0


@pytest.mark.parametrize("most", [4000, 6])
def test_recall_with_many_leaves(spark, monkeypatch, most):
    """Neighbours and clusters when the table is spread over leaves, of one or two routers: recall of pairs that must share one."""
    monkeypatch.setattr(vectors, "LEAF_ROWS", 100)
    monkeypatch.setattr(vectors, "MAX_LEAVES", most)
    monkeypatch.setattr(vectors, "TASK_ROWS", 500)
    assert vectors.depth(3000) == (1 if most == 4000 else 2)
    rng = np.random.default_rng(4)
    v = _vectors(rng, [3] * 1000)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "id bigint, embedding array<double>")
    got = {(r.id, r.neighbour_id) for r in neighbours.neighbours(df).collect()}
    want = {(i, j) for i in range(3000) for j in range(i // 3 * 3, i // 3 * 3 + 3) if i != j}
    assert len(got & want) / len(want) >= 0.99 and got <= want
    found = {tuple(r) for r in clusters.clusters(df).collect()}
    assert len(found & {(i, i // 3 * 3) for i in range(3000)}) >= 2970


@pytest.mark.parametrize("part, most", [(None, 4000), (700, 4000), (None, 30)])
def test_tight_bundle_with_a_third_of_the_rows(spark, monkeypatch, part, most):
    """All rows of the bundle are near all its leaves; every row must still meet its neighbours, also over parts and routers."""
    monkeypatch.setattr(vectors, "LEAF_ROWS", 10)
    monkeypatch.setattr(vectors, "MAX_LEAVES", most)
    if part:
        monkeypatch.setattr(vectors, "PART_ROWS", part)
    rng = np.random.default_rng(9)
    centres = vectors.unit(rng.standard_normal((41, 64)))
    x = centres[np.repeat(np.arange(41), [2000] + [100] * 40)] + 0.03 * rng.standard_normal((6000, 64))
    x = np.round(vectors.unit(x), 4)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id bigint, embedding array<double>")
    u = vectors.unit(x)
    cos = np.round(u @ u.T, 9)
    np.fill_diagonal(cos, -2)
    want = {(i, int(j)) for i in range(len(x)) for j in np.lexsort((np.arange(len(x)), -cos[i]))[:5] if cos[i, j] >= 0.9}
    got = [(r.id, r.neighbour_id) for r in neighbours.neighbours(df).collect()]
    assert len(want) > 28000 and len(got) == len(set(got)) and set(got) == want
    pairs = list(zip(*(k.tolist() for k in np.nonzero(np.triu(cos >= 0.9)))))
    assert {tuple(r) for r in clusters.clusters(df).collect()} == _brute_groups(pairs)


def test_bisect_gives_compact_nodes():
    rng = np.random.default_rng(1)
    x = vectors.unit(np.array(_vectors(rng, [5] * 40 + [1] * 30)))
    node = clusters.bisect(x)
    for k in np.unique(node):
        assert (x[node == k] @ x[node == k].T).min() >= 0.9
    assert len(np.unique(clusters.join_nodes(x, node))) == 70


def test_quantised_scores_are_within_their_bound():
    rng = np.random.default_rng(3)
    x = vectors.unit(rng.standard_normal((800, 64)))
    book = quantise.fit(x)
    codes = quantise.encode(x, book)
    par, across = quantise.residuals(x, codes, book)
    q = vectors.unit(x[:50] + 0.04 * rng.standard_normal((50, 64)))
    s = quantise.scan(quantise.tables(q, book), quantise.fused(codes)).T
    exact = q @ x.T
    assert np.abs(s - q @ quantise.decode(codes, book).T).max() < 1e-4
    ok = exact >= 0.9
    assert ok.any() and (np.abs(s - exact) <= par + np.sqrt(1 - 0.81) * across + 1e-4)[ok].all()


def test_pack_is_lossless():
    x = np.array([[0.1234] * 64, [1 / 3] * 64, [-3.2768] + [0.0] * 63, [1e-300] * 64, [-0.0] * 64])
    assert (vectors.unpack(vectors.pack(x)) == x).all()


ITEM = "id bigint, batch_id int, sha256 string, phash string, dhash string, sha string"


def test_linkage_equals_brute_force(spark):
    rng = random.Random(9)
    rows = []
    for i in range(150):
        p, d = rng.getrandbits(64), rng.getrandbits(64)
        for _ in range(rng.choice([1, 1, 2, 3])):
            rows.append((len(rows) + 1, rng.randint(1, 12), rng.choice(["", None, f" S{i % 140} ", f"s{i}"]), _hex(_near(rng, p, rng.randint(0, 7))), _hex(_near(rng, d, rng.randint(0, 7))), "x"))
    rows += [(900, 1, None, "zz", _hex(1), None), (901, 2, "q", None, None, None), (902, 2, "Q ", "", "", None), (903, None, "q", None, None, None), (904, 9, "q", None, None, None)]
    df = spark.createDataFrame(rows + rows[:20], ITEM)
    ok = lambda h: h is not None and len(h) == 16
    want = set()
    for a in rows:
        for b in rows:
            if a[0] < b[0] and a[1] is not None and b[1] is not None and a[1] != b[1]:
                sha = (a[2] or "").strip().lower()
                same = sha and sha == (b[2] or "").strip().lower()
                near = all(map(ok, (a[3], a[4], b[3], b[4]))) and (int(a[3], 16) ^ int(b[3], 16)).bit_count() <= 6 and (int(a[4], 16) ^ int(b[4], 16)).bit_count() <= 6
                if same or near:
                    want.add((a[0], b[0]))
    linker = linkage.run_deliveries(df)
    links = linker.links()
    got = [(r.id_a, r.id_b) for r in links.collect()]
    assert len(got) == len(set(got)) and set(got) == want
    for k in range(linker.deliveries):
        linker.update_clusters(k)
    reps = {r.media_id: r.cluster_rep for r in linker.clusters().collect()}
    assert {(x, r) for x, r in reps.items() if x in {i for pair in want for i in pair}} == _brute_groups(want)
    scored = linkage.score(links, linkage.weights(linkage.agreements(links)))
    assert scored.where("same_sha and weight <= 0").count() == 0
    assert linkage.run_deliveries(df.limit(0)).links().count() == 0


def _docs(spark):
    rng = random.Random(3)
    words = "stone river bridge window market lantern harbour north quiet signal archive frame".split()
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([3, 20, 90, 300]))), rng.choice(["a-x", "A_X ", "b", "c", None])) for i in range(300)]
    rows += [(500 + i, "the same text under many ids", "b") for i in range(150)]
    rows += [(900, None, "b"), (901, "", "b"), (902, "long " * 3000, "c")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string"), rows


def test_packing(spark):
    df, rows = _docs(spark)
    limits = spark.createDataFrame([("s", 64), ("l", 1000), ("none", 0), (None, 5)], "pack_name string, capacity_tokens int")
    n = {i: len(tokens.token_ids(t)) for i, t, _ in rows if t}
    got = packing.pack(df, limits).collect()
    assert {r.pack_name for r in got} == {"s", "l"}
    for name, cap in (("s", 64), ("l", 1000)):
        boxes, sizes, pieces = {}, {}, {}
        for r in (r for r in got if r.pack_name == name):
            boxes[r.container] = boxes.get(r.container, 0) + r.n_tokens
            sizes[r.doc_id] = sizes.get(r.doc_id, 0) + r.n_tokens
            pieces.setdefault(r.doc_id, []).append(r.piece)
        assert sizes == n and max(boxes.values()) <= cap
        assert all(sorted(p) == list(range(-(-n[i] // cap))) for i, p in pieces.items())
        assert sum(n.values()) / (len(boxes) * cap) > 0.95
        assert all(abs(r.fill - boxes[r.container] / cap) < 1e-5 for r in got if r.pack_name == name)
    assert packing.pack(df.limit(0), limits).count() == 0


def test_hilbert_curve_visits_neighbours():
    grid = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    key = packing.hilbert_key(grid, 3)
    assert sorted(key) == list(range(512))
    assert (np.abs(np.diff(grid[np.argsort(key)], axis=0)).sum(1) == 1).all()


@pytest.mark.parametrize("edge", [100_000, 5])
def test_mixing(spark, monkeypatch, edge):
    """With few rows left to sort, a budget's end is narrowed down over several rounds of quantiles."""
    monkeypatch.setattr(mixing, "EDGE_ROWS", edge)
    monkeypatch.setattr(mixing, "PARTS", 4 if edge == 5 else 64)
    df, rows = _docs(spark)
    targets = spark.createDataFrame([("a_x", 0.5, 2), ("B", 0.3, 3), ("c", 0.15, 1), ("absent", 0.05, 4)], "source string, target_share double, max_repeat int")
    n = {i: len(tokens.token_ids(t)) for i, t, _ in rows if t}
    src = {i: s.strip().lower().replace("-", "_") for i, t, s in rows if t and s}
    for total in (None, 5_000, 10**7):
        chosen, report = mixing.mix(df, targets, total)
        got = chosen.collect()
        assert len({r.doc_id for r in got}) == len(got)
        rep = {r.source: r for r in report.collect()}
        used = {s: sum(r.n_tokens * r.uses for r in got if r.source == s) for s in rep}
        for s, r in rep.items():
            assert r.tokens == used[s] and max([0, *(x.uses for x in got if x.source == s)]) <= r.max_repeat
            biggest = max([0, *(n[i] for i in src if src[i] == s)])
            assert abs(r.tokens - min(r.budget, r.available * r.max_repeat)) <= biggest
            assert r.available == sum(n[i] for i in src if src[i] == s)
            uses = [next((x.uses for x in got if x.doc_id == i), 0) for i in src if src[i] == s]
            assert not uses or max(uses) - min(uses) <= 1  # complete epochs first
        if sum(used.values()):
            assert abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-4
    a, b = (sorted(tuple(r) for r in mixing.mix(df, targets, 5_000)[0].collect()) for _ in range(2))
    assert a == b


CLEAN = [("fr", "Le témoin a été entendu près du marché, il répète « rien n’a été modifié »."), ("de", "Für die Prüfung wurden Bilder geöffnet; die Straße läßt sich größer zeigen."),
         ("en", "They aren’t variants of each other – the façade at 90° says “no”."), ("ru", "Изображение обрезано и повторно сжато, разница составляет пять бит."), ("pl", "Źródło nie jest pewne, znak wodny nałożono później, proszę zachować ślad.")]


def _wrong(text, stored, read):
    return text.encode(stored).decode(read) if read != "sloppy" else "".join(chr(b) if b in (0x81, 0x8D, 0x8F, 0x90, 0x9D) else bytes([b]).decode("cp1252") for b in text.encode(stored))


def test_garbled_text(spark):
    rows, truth = [], {}
    for k in range(40):
        for lang, text in CLEAN:
            rows.append((len(rows), f"{text} No {k}."))
    cases = [(0, "utf-8", "sloppy"), (1, "utf-8", "latin-1"), (2, "utf-8", "sloppy"), (2, "cp1252", "mac_roman"), (3, "utf-8", "cp1251"), (3, "cp866", "cp1251"), (4, "utf-8", "cp1250"), (4, "cp1250", "cp1252"), (1, "cp1252", "cp437")]
    for which, stored, read in cases:
        try:
            bad = _wrong(CLEAN[which][1], stored, read)
        except (UnicodeDecodeError, UnicodeEncodeError):
            continue
        truth[len(rows)] = CLEAN[which][1]
        rows.append((len(rows), bad))
    for bad, good in (("caf&#195;&#169; près du marché", "café près du marché"), (_wrong(_wrong(CLEAN[0][1], "utf-8", "sloppy"), "utf-8", "sloppy"), CLEAN[0][1]), (_wrong(CLEAN[0][1], "utf-8", "sloppy").lower(), CLEAN[0][1].lower())):
        truth[len(rows)] = good
        rows.append((len(rows), bad))
    lost = len(rows)
    rows.append((lost, "Der Stra�e nach"))
    quiet = [None, "", "plain ASCII only", "The caf&eacute; page writes its name with an entity.", "It prints “Ã©” wherever the caption has é.", "The list holds the signs Ã, Â, ï¿½ and Ð, one per line.", "ÁÉÍ ÓÚÝ ÞÐ: sample row", "日本語の文", "é" * 5000]
    first_quiet = len(rows)
    rows += [(first_quiet + i, t) for i, t in enumerate(quiet)]
    got = {r.doc_id: r for r in garble.repairs(spark.createDataFrame([(*r, "x") for r in rows], "doc_id bigint, text string, source string")).collect()}
    assert set(got) == {*truth, lost}
    right = sum(got[i].restored_text == t for i, t in truth.items())
    assert right >= len(truth) - 1
    assert got[lost].n_lost == 1 and got[lost].n_restored == 0
    assert garble.repairs(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


CLEAN_WIDE = ["文件于五月从当地网页收到，并归入案卷。", "图像经过裁剪和再次压缩，差异为十四位。", "画像は切り抜き後に再圧縮され、差は五ビットである。", "사진은 잘린 뒤 다시 압축되었고 차이는 다섯 비트이다."]


def _garbled_wide(stored="utf-8"):
    """(wrong, right) for every encoding with several bytes to a character that reads the text without loss."""
    for text in CLEAN_WIDE:
        for word in {text, *text.replace("，", " ").replace("、", " ").replace("。", "").split()}:
            for e in ("gb18030", "cp932", "euc_kr", "euc_jp", "big5"):
                try:
                    yield word.encode(stored).decode(e), word
                except UnicodeDecodeError:
                    pass


def test_garbled_text_read_as_wide_characters(spark):
    rows = [(k, f"{t} {k}") for k, t in enumerate([*CLEAN_WIDE, *(t for _, t in CLEAN)] * 30)]
    cases = list(_garbled_wide())
    assert len(cases) >= 5
    truth = {1000 + k: f"No 5 {right} end" for k, (_, right) in enumerate(cases)}
    rows += [(1000 + k, f"No 5 {wrong} end") for k, (wrong, _) in enumerate(cases)]
    rows.append((2000, f"{CLEAN_WIDE[2]}{'投稿は'.encode().decode('cp932')}"))
    truth[2000] = CLEAN_WIDE[2] + "投稿は"
    got = {r.doc_id: r.restored_text for r in garble.repairs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == truth


@pytest.mark.parametrize("letters", [150, 500, 5000])
def test_long_garbled_run_without_blanks(spark, letters):
    """A cut at a fixed length would part the bytes of a character; a run may also hold right and wrong parts."""
    rows = [(k, f"{t} {k}") for k, t in enumerate(CLEAN_WIDE * 30)]
    long = "".join(random.Random(k).choice(CLEAN_WIDE[:2]) for k in range(letters // 15))[:letters]
    truth = {}
    for e in ("mac_roman", "cp437", "cp866", "koi8-r", "latin-1"):
        truth[1000 + len(truth)] = long
        rows.append((999 + len(truth), long.encode().decode(e)))
    for e in ("mac_roman", "cp437", "latin-1"):  # a character between that the encoding has not
        truth[1000 + len(truth)] = f"{long}\u05d0{long}"
        rows.append((999 + len(truth), f"{long.encode().decode(e)}\u05d0{long.encode().decode(e)}"))
    got = {r.doc_id: r.restored_text for r in garble.repairs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == truth


def test_signs_that_are_only_named(spark):
    rows = [(k, f"{t} {k}") for k, (_, t) in enumerate(CLEAN * 30)]
    rows += [(1000, "Captions with â€™ in them were read wrongly, ours was not."), (1001, "It writes (“Ã©”) where é stood."), (1002, "The name SÃ¸ren was read wrongly."), (1002, "The name SÃ¸ren was read wrongly."), (None, "SÃ¸ren")]
    assert [r.doc_id for r in garble.repairs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()] == [1002]


def test_common_garble_is_found(spark):
    """A third of all texts is read wrongly in the same way, so its words are as common as right ones."""
    rows, truth = [], {}
    for k in range(200):
        for _, text in CLEAN[:3]:
            rows.append((len(rows), f"{text} {k}"))
            if k % 2:
                truth[len(rows)] = f"{text} {k}"
                rows.append((len(rows), f"{_wrong(text, 'utf-8', 'sloppy')} {k}"))
    got = {r.doc_id: r.restored_text for r in garble.repairs(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got == truth


def test_queries_equal_their_sql(compare):
    from provenix.llm.queries import REG

    for name, text in REG.sql.items():
        assert compare(REG.plans[name], text) > 0, name


def test_other_queries_run(spark):
    from provenix.llm.queries import REG

    for name, plan in REG.plans.items():
        if name in REG.sql:
            continue
        df = plan(spark, SF)
        assert df.columns and df.count() >= 0, name


@pytest.fixture()
def hot(monkeypatch):
    """Keys with more than 20 rows count as hot, so the salted paths run on small tables."""
    from provenix.operators import skew

    monkeypatch.setattr(skew, "HOT_ROWS", 20)
    monkeypatch.setattr(components, "HOT_ROWS", 0)


def test_hot_groups_lose_and_repeat_nothing(spark, hot):
    """A third of all rows in one group: components, overlaps, linkage and neighbours with salted keys."""
    edges = [(1, i) for i in range(2, 120)] + [(500 + i, 501 + i) for i in range(40)]
    df = spark.createDataFrame(edges, "u bigint, v bigint")
    assert sorted(tuple(r) for r in components.components(df).collect()) == sorted(_brute_groups(edges))

    rows = [(i, None, f"n{i}.jpg", "train" if i % 3 else "test", "same" if i < 60 else f"s{i}", _hex(7 if i < 60 else i * 0x9E3779B97F4A7C15), 1, 1, None, None, None) for i in range(120)]
    audit = spark.createDataFrame(rows, AUDIT)
    want = {(a[0], b[0]) for a in rows for b in rows if a[3] == "train" and b[3] == "test" and (a[4] == b[4] or (int(a[5], 16) ^ int(b[5], 16)).bit_count() <= 6)}
    got = [(r.train_id, r.eval_id) for r in overlap.overlaps(audit).collect()]
    assert len(got) == len(set(got)) and set(got) == want

    items = [(i, i % 9, "same" if i < 40 else f"s{i}", _hex(5), _hex(6 if i < 60 else i * 0x9E3779B97F4A7C15), None) for i in range(90)]
    links = linkage.run_deliveries(spark.createDataFrame(items, ITEM)).links().collect()
    near = lambda a, b: a[2] == b[2] or (int(a[4], 16) ^ int(b[4], 16)).bit_count() <= 6
    want = {(a[0], b[0]) for a in items for b in items if a[0] < b[0] and a[1] != b[1] and near(a, b)}
    assert len(links) == len(want) and {(r.id_a, r.id_b) for r in links} == want

    rng = np.random.default_rng(2)
    v = [round(float(x), 4) for x in rng.standard_normal(64) / 8]
    rows = [(i, v if i < 60 else [round(float(x), 4) for x in rng.standard_normal(64) / 8]) for i in range(150)]
    near = neighbours.neighbours(spark.createDataFrame(rows, "id bigint, embedding array<double>")).collect()
    assert {(r.id, r.neighbour_id) for r in near} == {(i, j) for i in range(60) for j in sorted(set(range(60)) - {i})[:5]}
    assert {tuple(r) for r in clusters.clusters(spark.createDataFrame(rows, "id bigint, embedding array<double>")).collect()} == {(i, 0) for i in range(60)}
