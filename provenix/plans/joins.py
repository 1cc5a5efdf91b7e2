"""Joins (J of the inventory), semi and anti joins, and pair scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenix.functions import scoring
from provenix.operators import pairs
from provenix.plans.common import items, mi
from provenix.plans.registry import Registry
from provenix.sources.tables import table

REG = Registry()

#: SQL: distance of two hashes of the joined items x and y, 64 where one is not usable.
_CODE = "CASE WHEN regexp_full_match(trim({0}), '[0-9A-Fa-f]{{16}}') THEN ('0x' || trim({0}))::UBIGINT END"


def _dist(h: str, x: str = "x", y: str = "y") -> str:
    return f"coalesce(bit_count(xor({x}.{h}, {y}.{h})), 64)::INT"


_HASHED = mi("case_id", "phash", "dhash", "ahash", "filename") + f""", h AS (SELECT id, case_id, {_CODE.format('phash')} AS p, {_CODE.format('dhash')} AS d, {_CODE.format('ahash')} AS a FROM mi)"""
_VIS = f"0.5 * (1 - {_dist('p')} / 64.0::DOUBLE) + 0.3 * (1 - {_dist('d')} / 64.0::DOUBLE) + 0.2 * (1 - {_dist('a')} / 64.0::DOUBLE)"


@REG.query(_HASHED + f"""SELECT x.id AS probe_id, y.id AS id, round({_VIS}, 9) AS visual_similarity FROM h x JOIN h y ON x.id <> y.id
WHERE x.id % 50 = 0 AND x.p IS NOT NULL AND y.p IS NOT NULL AND {_VIS} >= 0.5""")
def j1_probe_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir, "phash", "dhash", "ahash")
    return pairs.probe_join(d, d.where("id % 50 = 0"), 0.5)


@REG.query(_HASHED + f"""SELECT x.id AS probe_id, y.id AS id, round({_VIS}, 9) AS visual_similarity FROM h x JOIN h y ON x.case_id = y.case_id AND x.id <> y.id
WHERE x.id % 50 = 0 AND x.p IS NOT NULL AND y.p IS NOT NULL AND {_VIS} >= 0.5""")
def j2_case_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir, "case_id", "phash", "dhash", "ahash")
    return pairs.probe_join_within(d, d.where("id % 50 = 0"), "case_id", 0.5)


_COS = "CASE WHEN len(x.embedding) = len(y.embedding) AND len(x.embedding) > 0 AND x.ok AND y.ok THEN list_cosine_similarity(x.embedding, y.embedding) END"
def _mean(weights: dict[str, float]) -> str:
    """SQL of the weighted mean of the signals that are not null."""
    return f"({' + '.join(f'coalesce(s_{k} * {w}::DOUBLE, 0)' for k, w in weights.items())}) / nullif({' + '.join(f'(s_{k} IS NOT NULL)::INT * {w}::DOUBLE' for k, w in weights.items())}, 0)"


_T = scoring.DEFAULT
_NAME = "lower(coalesce(filename, ''))"
_SIDES = mi("phash", "dhash", "ahash", "sha256", "width", "height", "embedding", "filename", "case_id", "cluster_id", "integrity_score", "created_at", "risk_score") + f""",
it AS (SELECT id, {_CODE.format('phash')} AS p, {_CODE.format('dhash')} AS d, {_CODE.format('ahash')} AS a, lower(trim(sha256)) AS sha, width, height, embedding, filename, case_id, cluster_id, integrity_score, created_at, 50 + risk_score % 50 AS quality,
 embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR isnan(v))) = 0 AND len(list_filter(embedding, lambda v: v <> 0)) > 0 AS ok FROM mi),
rel AS (SELECT least(source_id, target_id) AS source_id, greatest(source_id, target_id) AS target_id, max(combined_score) AS stored, max(visual_similarity) AS s_ssim, max(semantic_similarity) AS s_features, bool_or(coalesce(lower(trim(relationship_type)) IN ('cropped', 'screenshot'), FALSE)) AS contained FROM media_relationships WHERE source_id <> target_id GROUP BY 1, 2),
pr AS (SELECT r.source_id, r.target_id, r.stored, r.stored AS s_color, r.s_ssim, r.s_features, r.contained, 1 - abs(x.quality - y.quality) / 100.0::DOUBLE AS s_jpeg, x.sha <> '' AND x.sha = y.sha AS same_sha, y.filename, x.width AS w1, x.height AS h1, y.width AS w2, y.height AS h2, x.case_id AS c1, y.case_id AS c2, x.cluster_id AS k1, y.cluster_id AS k2,
 {_dist('p')} AS dp, {_dist('d')} AS dd, {_dist('a')} AS da, CASE WHEN x.p IS NOT NULL AND y.p IS NOT NULL THEN {_VIS} END AS vis, {_COS} AS cos0,
 CASE WHEN x.width > 0 AND x.height > 0 AND y.width > 0 AND y.height > 0 THEN 1 - least(1.0::DOUBLE, abs(x.width / x.height::DOUBLE - y.width / y.height::DOUBLE)) END AS ar
 FROM rel r JOIN it x ON x.id = r.source_id JOIN it y ON y.id = r.target_id),
sc AS (SELECT *, CASE WHEN round(cos0, 9) <> 0 THEN cos0 END AS sem FROM pr),
kd AS (SELECT *, vis AS s_hashes, sem AS s_semantic, ar AS s_aspect, coalesce(w1 <> w2 OR h1 <> h2, FALSE) AS differ, CASE WHEN coalesce(same_sha, FALSE) THEN 'Duplicate' WHEN contains({_NAME}, 'watermark') THEN 'Watermarked Variant' WHEN regexp_matches({_NAME}, 'compress(ed|ion)') THEN 'Recompressed'
 WHEN coalesce(s_ssim >= 0.98 AND s_color >= 0.98, FALSE) AND NOT differ THEN 'Duplicate' WHEN contained AND regexp_matches({_NAME}, 'screenshot|capture') AND NOT contains({_NAME}, 'crop') THEN 'Screenshot' WHEN contained THEN 'Crop' WHEN differ THEN 'Resize' WHEN s_jpeg <= 0.85 THEN 'Recompressed' ELSE 'Duplicate' END AS kind FROM sc),
fu AS (SELECT *, CASE WHEN kind IN {scoring.CONTAINED_KINDS} THEN {_mean(_T.containment)} WHEN kind IN {scoring.SAME_FRAME_KINDS} THEN {_mean(_T.same_frame)} ELSE {_mean(_T.full_frame)} END AS raw,
 list_filter([CASE WHEN s_ssim < CASE WHEN contained THEN {_T.cropped_ssim} ELSE {_T.ssim} END THEN 'ssim' END, CASE WHEN s_color < CASE WHEN contained THEN {_T.cropped_color} ELSE {_T.color} END THEN 'color' END, CASE WHEN sem > 0 AND sem < {_T.semantic} THEN 'semantic' END], lambda r: r IS NOT NULL) AS failed FROM kd),
sg AS (SELECT *, round(CASE WHEN len(failed) > 0 THEN greatest(0.05, least(0.29, raw * 0.3)) ELSE raw END, 12) AS score FROM fu)
"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Given matches with both items, all signals, kind, failed gates and score.

    Signals that need pixels are inputs; the stored similarities stand in for them: visual for structure, combined for
    colour, semantic for features, cropped and screenshot matches for containment, a number from the risk score for quality.
    """
    rel = table(spark, sf_dir, "media_relationships").where("source_id <> target_id")
    inside = F.bool_or(F.coalesce(F.lower(F.trim("relationship_type")).isin("cropped", "screenshot"), F.lit(False)))
    rel = rel.groupBy(F.least("source_id", "target_id").alias("source_id"), F.greatest("source_id", "target_id").alias("target_id")).agg(
        F.max("combined_score").alias("stored"), F.max("visual_similarity").alias("ssim"), F.max("semantic_similarity").alias("features"), inside.alias("contained"))
    d = items(spark, sf_dir, "phash", "dhash", "ahash", "sha256", "width", "height", "embedding", "filename", "case_id", "cluster_id", "integrity_score", "created_at", "risk_score")
    both = pairs.with_sides(rel, d, "source_id", "target_id")
    sig = pairs.pair_signals()
    dist = pairs.distances()
    c = F.col
    sha = lambda s: F.lower(F.trim(c(f"{s}.sha256")))
    quality = lambda s: 50 + c(f"{s}.risk_score") % 50
    out = both.select("source_id", "target_id", "stored", "ssim", "features", "contained", "s", "t", dist["phash"].alias("dp"), dist["dhash"].alias("dd"), dist["ahash"].alias("da"), sig["hashes"].alias("vis"),
                      F.when(F.round(sig["semantic"], 9) != 0, sig["semantic"]).alias("sem"), sig["aspect"].alias("ar"), ((sha("s") != "") & (sha("s") == sha("t"))).alias("same_sha"),
                      (1 - F.abs(quality("s") - quality("t")) / 100.0).alias("jpeg"))
    none = F.lit(None)
    kind = scoring.relationship(c("same_sha"), c("t.filename"), c("ssim"), c("stored"), c("s.width"), c("s.height"), c("t.width"), c("t.height"), c("contained"), F.lit("Other"), F.lit(0.0), c("jpeg"))
    signals = {"hashes": c("vis"), "ssim": c("ssim"), "color": c("stored"), "aspect": c("ar"), "semantic": c("sem"), "jpeg": c("jpeg"), "features": c("features")}
    out = out.withColumn("kind", kind).withColumn("failed", scoring.gate_reasons(c("contained"), c("ssim"), c("stored"), none.cast("int"), c("sem")))
    return out.withColumn("score", F.round(scoring.gated(scoring.fused(c("kind"), signals), c("failed")), 12))


@REG.query(_SIDES + """SELECT source_id, target_id, dp, dd, da, least(dp, dd, da) <= 24 OR coalesce(sem, 0) >= 0.60 OR coalesce((w1 < w2 AND h1 < h2) OR (w2 < w1 AND h2 < h1), FALSE) AS candidate FROM sc""")
def j3_stage0(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    c = F.col
    ok = scoring.is_candidate(c("dp"), c("dd"), c("da"), c("sem"), scoring.subframe(c("s.width"), c("s.height"), c("t.width"), c("t.height")))
    return p.select("source_id", "target_id", "dp", "dd", "da", ok.alias("candidate"))


@REG.query(_SIDES + """SELECT source_id, target_id, round(vis, 9) AS visual, round(sem, 9) AS semantic, round(ar, 9) AS aspect, round(s_jpeg, 9) AS jpeg, kind, score,
CASE WHEN score >= 0.85 THEN 'High Match' WHEN score >= 0.58 THEN 'Possible Match' ELSE 'No Significant Match' END AS level,
CASE WHEN score >= 0.95 THEN 'Highly Correlated Match' WHEN score >= 0.85 THEN 'Strong Relationship' WHEN score >= 0.70 THEN 'Moderately Altered Variation' ELSE 'Weak Similarity Match' END AS strength FROM sg WHERE score >= 0.58""")
def j4_pair_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).where(F.col("score") >= scoring.DEFAULT.match)
    return p.select("source_id", "target_id", F.round("vis", 9).alias("visual"), F.round("sem", 9).alias("semantic"), F.round("ar", 9).alias("aspect"), F.round("jpeg", 9).alias("jpeg"), "kind", "score",
                    scoring.match_level(F.col("score")).alias("level"), scoring.match_strength(F.col("score")).alias("strength"))


_BOTH = """, edge AS (SELECT source_id AS id, target_id AS other, score FROM sg WHERE c1 = c2 AND k1 = k2 UNION ALL SELECT target_id, source_id, score FROM sg WHERE c1 = c2 AND k1 = k2)
"""


@REG.query(_SIDES + _BOTH + """, cand AS (SELECT e.id, e.other, e.score, o.width * o.height::BIGINT AS px, row_number() OVER (PARTITION BY e.id ORDER BY e.score DESC, e.other) AS rn
 FROM edge e JOIN it m ON m.id = e.id JOIN it o ON o.id = e.other WHERE e.score IS NOT NULL AND coalesce(o.width * o.height::BIGINT, 0) >= coalesce(m.width * m.height::BIGINT, 0))
SELECT id, other AS parent_id, score FROM cand WHERE rn = 1""")
def j5_best_parent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best parent of a cluster member among the members it has a match with: highest score, at least its pixels."""
    p = _pairs(spark, sf_dir).where("s.case_id = t.case_id and s.cluster_id = t.cluster_id and score is not null")
    px = lambda s: F.coalesce(F.col(f"{s}.width").cast("bigint") * F.col(f"{s}.height"), F.lit(0))
    one = lambda a, b: p.where(px(b) >= px(a)).select(F.col(f"{a}.id").alias("id"), F.struct((-F.col("score")).alias("s"), F.col(f"{b}.id").alias("o")).alias("c"))
    return one("s", "t").unionByName(one("t", "s")).groupBy("id").agg(F.min("c").alias("c")).select("id", F.col("c.o").alias("parent_id"), (-F.col("c.s")).alias("score"))


@REG.query(_SIDES + """, e AS (SELECT source_id AS a, target_id AS b, score, dp FROM sg WHERE c1 = c2 AND k1 = k2 AND score IS NOT NULL),
ord AS (SELECT x.id AS id, y.id AS other, e.score, list_filter([CASE WHEN x.width < y.width AND x.height < y.height AND x.width > 0 THEN 'Dimension reduction' END, CASE WHEN e.dp <= 8 THEN 'pHash similarity' END], lambda r: r IS NOT NULL) AS reasons
 FROM e JOIN it x ON x.id IN (e.a, e.b) JOIN it y ON y.id IN (e.a, e.b) AND y.id <> x.id WHERE y.created_at < x.created_at OR (y.created_at = x.created_at AND y.id < x.id)),
best AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rn FROM ord WHERE len(reasons) > 0)
SELECT id, other AS parent_id, score, array_to_string(reasons, ' + ') AS reason FROM best WHERE rn = 1""")
def j6_chronology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best earlier match with at least one reason to believe in it; ties go to the smaller id."""
    p = _pairs(spark, sf_dir).where("s.case_id = t.case_id and s.cluster_id = t.cluster_id and score is not null")
    first = F.struct("s.created_at", "s.id") < F.struct("t.created_at", "t.id")
    x = p.where("s.created_at is not null and t.created_at is not null").select(F.when(first, F.col("t")).otherwise(F.col("s")).alias("x"), F.when(first, F.col("s")).otherwise(F.col("t")).alias("y"), "score", "dp")
    smaller = (F.col("x.width") < F.col("y.width")) & (F.col("x.height") < F.col("y.height")) & (F.col("x.width") > 0)
    reasons = F.array_compact(F.array(F.when(smaller, "Dimension reduction"), F.when(F.col("dp") <= 8, "pHash similarity")))
    c = x.withColumn("reasons", reasons).where(F.size("reasons") > 0)
    best = c.groupBy(F.col("x.id").alias("id")).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("y.id").alias("o"), F.array_join("reasons", " + ").alias("r"))).alias("c"))
    return best.select("id", F.col("c.o").alias("parent_id"), (-F.col("c.s")).alias("score"), F.col("c.r").alias("reason"))


@REG.query(mi("parent_id", "case_id", "filename") + """ SELECT mi.id, mi.filename, p.filename AS parent_name, c.name AS case_name FROM mi LEFT JOIN mi p ON p.id = mi.parent_id LEFT JOIN cases c ON c.id = mi.case_id""")
def j7_self_fk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir, "parent_id", "case_id", "filename")
    parent = d.select(F.col("id").alias("parent_id"), F.col("filename").alias("parent_name"))
    case = table(spark, sf_dir, "cases").select(F.col("id").alias("case_id"), F.col("name").alias("case_name"))
    return d.join(parent, "parent_id", "left").join(case, "case_id", "left").select("id", "filename", "parent_name", "case_name")


_AUDIT = """WITH au AS (SELECT DISTINCT ON (audit_id) audit_id, filename, lower(trim(split)) AS split, lower(trim(sha256)) AS sha, source, dataset, width, height, exif, filepath, is_fake, file_size, phash FROM dataset_audit)"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "dataset_audit").dropDuplicates(["audit_id"])
    return a.withColumns({"split": F.lower(F.trim("split")), "sha": F.lower(F.trim("sha256"))})


@REG.query(_AUDIT + " SELECT audit_id, filename FROM au WHERE split IN ('test', 'val') AND sha <> '' AND sha IN (SELECT sha FROM au WHERE split = 'train' AND sha IS NOT NULL)")
def j8_leaked_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = audit(spark, sf_dir)
    train = a.where("split = 'train'").select("sha").distinct()
    return a.where("split in ('test', 'val') and sha <> ''").join(train, "sha", "left_semi").select("audit_id", "filename")


@REG.query(_AUDIT + """, v AS (SELECT DISTINCT split_part(filename, '_src_', 1) AS base FROM au WHERE split = 'val' AND filename IS NOT NULL)
SELECT audit_id, filename FROM au WHERE split = 'train' AND (filename IS NULL OR split_part(filename, '_src_', 1) NOT IN (SELECT base FROM v))""")
def j9_exclude_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = audit(spark, sf_dir).withColumn("base", F.split_part("filename", F.lit("_src_"), F.lit(1)))
    return a.where("split = 'train'").join(a.where("split = 'val'").select("base").distinct(), "base", "left_anti").select("audit_id", "filename")


@REG.query("""WITH r AS (SELECT DISTINCT id, source_id, target_id, combined_score FROM media_relationships), old AS (SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM r WHERE id % 2 = 0)
SELECT id, source_id, target_id FROM r WHERE id % 2 = 1 AND source_id IS NOT NULL AND target_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM old WHERE a = least(source_id, target_id) AND b = greatest(source_id, target_id))""")
def j10_symmetric_exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recommendations not yet there in either direction: the odd rows against the even ones."""
    r = table(spark, sf_dir, "media_relationships").select("id", "source_id", "target_id").distinct().withColumns({"a": F.least("source_id", "target_id"), "b": F.greatest("source_id", "target_id")})
    new = r.where("id % 2 = 1 and source_id is not null and target_id is not null")
    return new.join(r.where("id % 2 = 0").select("a", "b").distinct(), ["a", "b"], "left_anti").select("id", "source_id", "target_id")


@REG.query(_HASHED.replace(" FROM mi)", ", regexp_extract(lower(filename), '^(.*?)_(compressed|resized|watermarked|crop|cropped|screenshot)(_[0-9]+)?\\.[a-z0-9]+$', 1) AS base, regexp_extract(lower(filename), '^(.*?)_(compressed|resized|watermarked|crop|cropped|screenshot)(_[0-9]+)?\\.[a-z0-9]+$', 2) AS kind, regexp_replace(lower(filename), '\\.[a-z0-9]+$', '') AS stem FROM mi)", 1) + f"""
SELECT x.id AS original_id, y.id AS variant_id, y.kind AS kind, {_dist('p')} AS phash_distance, {_dist('d')} AS dhash_distance, {_dist('a')} AS ahash_distance FROM h x JOIN h y ON x.stem = y.base AND x.case_id = y.case_id WHERE y.base <> '' AND x.base = ''""")
def j11_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Originals with their variants by the key in the file name, with the three distances."""
    d = items(spark, sf_dir, "case_id", "phash", "dhash", "ahash", "filename")
    shape = r"^(.*?)_(compressed|resized|watermarked|crop|cropped|screenshot)(_[0-9]+)?\.[a-z0-9]+$"
    name = F.lower("filename")
    d = d.withColumns({"base": F.regexp_extract(name, shape, 1), "kind": F.regexp_extract(name, shape, 2), "stem": F.regexp_replace(name, r"\.[a-z0-9]+$", "")})
    x = d.where("base = ''").select("case_id", F.col("stem").alias("key"), F.struct("id", "phash", "dhash", "ahash").alias("s"))
    y = d.where("base <> ''").select("case_id", F.col("base").alias("key"), "kind", F.struct("id", "phash", "dhash", "ahash").alias("t"))
    dist = pairs.distances()
    return x.join(y, ["case_id", "key"]).select(F.col("s.id").alias("original_id"), F.col("t.id").alias("variant_id"), "kind", dist["phash"].alias("phash_distance"), dist["dhash"].alias("dhash_distance"), dist["ahash"].alias("ahash_distance"))


@REG.query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
d AS (SELECT q.vec_id AS a, e.vec_id AS b, round(list_cosine_similarity(q.v, e.v), 6) AS c FROM e q JOIN e ON q.vec_id % 50 = 0 AND q.vec_id <> e.vec_id),
f AS (SELECT a, b, c FROM d QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) = 1),
g AS (SELECT q.vec_id AS b, e.vec_id AS a, round(list_cosine_similarity(q.v, e.v), 6) AS c FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id IN (SELECT b FROM f)),
h AS (SELECT a, b FROM g QUALIFY row_number() OVER (PARTITION BY b ORDER BY c DESC, a) = 1)
SELECT a, b, c AS cosine FROM f JOIN h USING (a, b)""")
def j12_mutual_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-checked nearest neighbours: descriptors divisible by 50 and the one of all others that each has for its best, if that is mutual."""
    e = table(spark, sf_dir, "embeddings")
    return pairs.mutual_nearest(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding")


@REG.query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings) SELECT x.vec_id AS probe_id, y.vec_id AS id, round(list_cosine_similarity(x.v, y.v), 6) AS cosine FROM e x JOIN e y ON x.vec_id % 50 = 0 AND x.vec_id <> y.vec_id WHERE list_cosine_similarity(x.v, y.v) >= 0.30")
def e2_cosine_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return pairs.vector_probe(e, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 0.30).withColumn("cosine", F.round("cosine", 6))
