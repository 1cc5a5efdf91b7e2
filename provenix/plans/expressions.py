"""Scalar, array and binary expressions (E of the inventory)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from provenix.functions import binary, forensics, hashing, pixels, scoring, text, vectors
from provenix.plans.common import items, mi
from provenix.plans.joins import _AUDIT, _CODE, _SIDES, _pairs, audit
from provenix.plans.registry import Registry
from provenix.sources.tables import table

REG = Registry()

_ITEM = ("filename", "width", "height", "format", "exif", "file_size", "created_at", "risk_score", "integrity_score", "phash", "dhash", "ahash", "embedding", "parent_id", "mime_type")
_MI = mi(*_ITEM)


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir, *_ITEM)


c = F.col


@REG.query(_SIDES + "SELECT source_id, target_id, dp AS p_distance, dd AS d_distance, da AS a_distance, round(coalesce(vis, 0), 9) AS visual_similarity FROM sc")
def e1_e3_hash_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.select("source_id", "target_id", c("dp").alias("p_distance"), c("dd").alias("d_distance"), c("da").alias("a_distance"), F.round(F.coalesce("vis", F.lit(0.0)), 9).alias("visual_similarity"))


@REG.query(_SIDES + "SELECT source_id, target_id, round(coalesce(cos0, 0), 6) AS cosine FROM sc")
def e2_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    return p.select("source_id", "target_id", F.round(vectors.cosine("s.embedding", "t.embedding"), 6).alias("cosine"))


@REG.query("WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), m AS (SELECT vec_id, v, median(x) AS med FROM (SELECT vec_id, v, unnest(v) AS x FROM e) GROUP BY ALL) SELECT vec_id, " + ", ".join(
    f"array_to_string(list_transform(range(16), lambda k: substr('0123456789abcdef', 1 + {w}, 1)), '') AS {n}" for n, w in (
        ("phash", "8 * (v[4*k+1] > med)::INT + 4 * (v[4*k+2] > med)::INT + 2 * (v[4*k+3] > med)::INT + (v[4*k+4] > med)::INT"),
        ("ahash", "8 * (v[4*k+1] > list_sum(v) / 64)::INT + 4 * (v[4*k+2] > list_sum(v) / 64)::INT + 2 * (v[4*k+3] > list_sum(v) / 64)::INT + (v[4*k+4] > list_sum(v) / 64)::INT"),
        ("dhash", "8 * (v[4*k+1] > v[4*k+2])::INT + 4 * (v[4*k+2] > v[4*k+3])::INT + 2 * (v[4*k+3] > v[4*k+4])::INT + (v[4*k+4] > v[(4*k+4) % 64 + 1])::INT"))) + " FROM m")
def e34_grid_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of 8 x 8 grids: above the median, above the mean, above the next value."""
    return table(spark, sf_dir, "embeddings").select("vec_id", *[hashing.hash_of_grid("embedding", k).alias(f"{k}hash") for k in "pad"])


@REG.query(_SIDES + ", x AS (SELECT r.source_id, r.target_id, x.p AS p1, y.p AS p2 FROM rel r JOIN it x ON x.id = r.source_id JOIN it y ON y.id = r.target_id WHERE x.p IS NOT NULL AND y.p IS NOT NULL) SELECT source_id, target_id, array_to_string(list_filter(range(64), lambda i: ((xor(p1, p2) >> (63 - i)::UBIGINT) & 1::UBIGINT) = 1), ',') AS positions, trunc((64 - bit_count(xor(p1, p2))::INT) * 100 / 64)::INT AS percent, CASE WHEN bit_count(xor(p1, p2)) <= 4 THEN 'near-identical' WHEN bit_count(xor(p1, p2)) <= 12 THEN 'similar' ELSE 'different' END AS band FROM x")
def e35_bit_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).where(hashing.usable("s.phash") & hashing.usable("t.phash"))
    return p.select("source_id", "target_id", F.array_join(hashing.differing_bits("s.phash", "t.phash"), ",").alias("positions"), ((64 - c("dp")) * 100 / 64).cast("int").alias("percent"), hashing.match_band(c("dp")).alias("band"))


@REG.query("""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), a AS (SELECT vec_id, list_transform(range(5), lambda i: v[12 * i + 1:12 * i + 12]) AS f FROM e), x AS (SELECT p.vec_id AS a, q.vec_id AS b, p.f AS l, q.f[2:4] AS s FROM a p JOIN a q ON q.vec_id = p.vec_id + 1)
SELECT a, b, round(greatest(0, list_max(list_transform(range(3), lambda o: (list_cosine_similarity(l[o + 1], s[1]) + list_cosine_similarity(l[o + 2], s[2]) + list_cosine_similarity(l[o + 3], s[3])) / 3))), 6) AS audio_similarity FROM x""")
def e4_audio_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best alignment of five frames of twelve values with three of the next row."""
    frames = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.transform(F.slice("embedding", i * 12 + 1, 12), lambda x: x.cast("double")))
    e = table(spark, sf_dir, "embeddings").select("vec_id", frames.alias("f"))
    x = e.select(c("vec_id").alias("a"), c("f").alias("l")).join(e.select((c("vec_id") - 1).alias("a"), c("vec_id").alias("b"), F.slice("f", 2, 3).alias("s")), "a")
    yes, mean = F.lit(True), F.array().cast("array<double>")
    return x.select("a", "b", F.round(vectors.audio_similarity(yes, c("l"), mean, yes, c("s"), mean), 6).alias("audio_similarity"))


@REG.query(_SIDES + "SELECT source_id, target_id, round(coalesce(ar, 1), 6) AS aspect, coalesce((w1 < w2 AND h1 < h2) OR (w2 < w1 AND h2 < h1), FALSE) AS subframe FROM sc")
def e7_aspect(spark: SparkSession, sf_dir: str) -> DataFrame:
    w1, h1, w2, h2 = c("s.width"), c("s.height"), c("t.width"), c("t.height")
    return _pairs(spark, sf_dir).select("source_id", "target_id", F.round(scoring.aspect_similarity(w1, h1, w2, h2), 6).alias("aspect"), scoring.subframe(w1, h1, w2, h2).alias("subframe"))


@REG.query("WITH r AS (SELECT DISTINCT id, visual_similarity v, semantic_similarity s, combined_score k FROM media_relationships) SELECT id, round(coalesce(1 - abs(v * 100 - s * 100) / 100, 1), 6) AS jpeg_similarity FROM r")
def e8_jpeg_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "media_relationships").select("id", "visual_similarity", "semantic_similarity", "combined_score").distinct()
    return r.select("id", F.round(scoring.jpeg_similarity(c("visual_similarity") * 100, c("semantic_similarity") * 100), 6).alias("jpeg_similarity"))


_Q = "(50 + risk_score % 50)"
_PLATFORM = _MI + f""", q AS (SELECT id, coalesce(cardinality(exif), 0) = 0 AS bare, coalesce(greatest(width, height), 0) AS edge, coalesce({_Q}, 75) AS q FROM mi), r AS (SELECT id,
CASE WHEN bare THEN (CASE WHEN edge IN (1280, 1600) THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN q BETWEEN 50 AND 75 THEN 0.3 ELSE 0.1 END) ELSE 0 END AS wa,
CASE WHEN bare THEN (CASE WHEN edge <= 1280 AND edge NOT IN (1280, 1600) THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN q BETWEEN 50 AND 80 THEN 0.3 ELSE 0.1 END) ELSE 0 END AS tg,
CASE WHEN bare THEN (CASE WHEN edge IN (960, 1080, 2048) THEN 0.4::DOUBLE ELSE 0 END + CASE WHEN q BETWEEN 70 AND 85 THEN 0.3 ELSE 0.1 END) ELSE 0 END AS sm,
CASE WHEN NOT bare THEN 0.6::DOUBLE + CASE WHEN q >= 90 THEN 0.3 ELSE 0 END ELSE 0 END AS em FROM q), n AS (SELECT id, round_even(wa / (wa + tg + sm + em + 0.1), 3) AS wa, round_even(tg / (wa + tg + sm + em + 0.1), 3) AS tg, round_even(sm / (wa + tg + sm + em + 0.1), 3) AS sm, round_even(em / (wa + tg + sm + em + 0.1), 3) AS em FROM r)"""


@REG.query(_PLATFORM + " SELECT id, round(wa, 2) AS whatsapp, round(em, 2) AS email, CASE WHEN wa >= greatest(tg, sm, em) AND wa > 0 THEN 'WhatsApp' WHEN tg >= greatest(sm, em) AND tg > 0 THEN 'Telegram' WHEN sm >= em AND sm > 0 THEN 'Social Media' ELSE 'Email' END AS best FROM n")
def e11_platform(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.platform_scores(forensics.exif_count(c("exif")), c("width"), c("height"), 50 + c("risk_score") % 50)
    d = _items(spark, sf_dir).select("id", s.alias("s"))
    return d.select("id", F.round(c("s.WhatsApp"), 2).alias("whatsapp"), F.round(c("s.Email"), 2).alias("email"), scoring.best_platform(c("s")).alias("best"))


_G = "WITH r AS (SELECT DISTINCT id, visual_similarity v, semantic_similarity s, combined_score k, id % 3 = 0 AS inside FROM media_relationships), g AS (SELECT *, list_filter([CASE WHEN v < CASE WHEN inside THEN 0.4 ELSE 0.3 END THEN 'ssim' END, CASE WHEN k < CASE WHEN inside THEN 0.4 ELSE 0.35 END THEN 'color' END, CASE WHEN inside AND id % 20 < 10 THEN 'inliers' END, CASE WHEN s > 0 AND s < 0.6 THEN 'semantic' END], lambda x: x IS NOT NULL) AS f FROM r)"


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "media_relationships").select("id", "visual_similarity", "semantic_similarity", "combined_score").distinct()
    return r.withColumn("f", scoring.gate_reasons(c("id") % 3 == 0, c("visual_similarity"), c("combined_score"), c("id") % 20, c("semantic_similarity")))


@REG.query(_G + " SELECT id, array_to_string(f, ',') AS failed, round(CASE WHEN len(f) > 0 THEN greatest(0.05, least(0.29, k * 0.3)) ELSE k END, 6) AS score FROM g")
def e12_e15_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gates with the stored similarities as pixel signals, and the score they leave."""
    return _gated(spark, sf_dir).select("id", F.array_join("f", ",").alias("failed"), F.round(scoring.gated(c("combined_score"), c("f")), 6).alias("score"))


@REG.query("WITH r AS (SELECT DISTINCT id, combined_score k FROM media_relationships) SELECT id, CASE WHEN k >= 0.85 THEN 'High Match' WHEN k >= 0.58 THEN 'Possible Match' ELSE 'No Significant Match' END AS level, CASE WHEN k >= 0.95 THEN 'Highly Correlated Match' WHEN k >= 0.85 THEN 'Strong Relationship' WHEN k >= 0.70 THEN 'Moderately Altered Variation' ELSE 'Weak Similarity Match' END AS strength, 'Attributed at ' || coalesce(trunc(k * 100)::INT::VARCHAR, '0') || '% confidence' AS explanation FROM r")
def e16_e49_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = c("combined_score")
    r = table(spark, sf_dir, "media_relationships").select("id", "combined_score").distinct()
    return r.select("id", scoring.match_level(k).alias("level"), scoring.match_strength(k).alias("strength"), F.format_string("Attributed at %d%% confidence", F.coalesce((k * 100).cast("int"), F.lit(0))).alias("explanation"))


@REG.query(_SIDES + "SELECT source_id, target_id, kind, array_to_string(failed, ',') AS failed, score FROM sg")
def e13_relationship_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kind of every given match, gates it fails, and its score by the weights for its kind (three sets), clamped where a gate failed."""
    return _pairs(spark, sf_dir).select("source_id", "target_id", "kind", F.array_join("failed", ",").alias("failed"), "score")


@REG.query("WITH r AS (SELECT DISTINCT id, visual_similarity v, semantic_similarity s FROM media_relationships) SELECT id, CASE WHEN id % 7 = 0 THEN 100.0::DOUBLE WHEN coalesce(v * 100 > 85 AND s * 100 > 50 AND id % 200 <= greatest(50, 2000 * 0.05), FALSE) THEN greatest(50, 100 - (id % 200) / 2.0::DOUBLE) ELSE 0 END AS containment FROM r")
def e14_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "media_relationships").select("id", "visual_similarity", "semantic_similarity").distinct()
    return r.select("id", scoring.containment(c("id") % 7 == 0, c("visual_similarity") * 100, c("semantic_similarity") * 100, c("id") % 200, F.lit(2000)).alias("containment"))


@REG.query(_MI + """, t AS (SELECT id, created_at, trim(coalesce(nullif(trim(exif['DateTimeOriginal']), ''), nullif(trim(exif['DateTime']), ''), nullif(trim(exif['DateTimeDigitized']), ''))) AS x FROM mi)
SELECT id, coalesce(CASE WHEN regexp_matches(x, '^\\d{4}:\\d{2}:\\d{2} \\d{2}:\\d{2}:\\d{2}$') THEN try_strptime(x, '%Y:%m:%d %H:%M:%S') WHEN regexp_matches(x, '^\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2}$') THEN try_strptime(x, '%Y-%m-%d %H:%M:%S')
WHEN regexp_matches(x, '^\\d{4}-\\d{2}-\\d{2}T\\d{2}:\\d{2}:\\d{2}$') THEN try_strptime(x, '%Y-%m-%dT%H:%M:%S') END, created_at) AS taken_at FROM t""")
def e17_capture_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("id", forensics.exif_time(c("exif"), c("created_at")).alias("taken_at"))


_HAS = lambda *k: "(" + " OR ".join(f"coalesce(trim(exif['{x}']) <> '', FALSE)" for x in k) + ")"
_TRUST = f"""CASE WHEN coalesce(cardinality(exif), 0) = 0 THEN 15 ELSE greatest(10, 100 - 30 * (NOT {_HAS('Make', 'Model')})::INT - 30 * (NOT {_HAS('DateTimeOriginal', 'DateTime')})::INT - 30 * {_HAS('Software')}::INT - 10 * (NOT {_HAS('GPSInfo')})::INT) END"""
_FLAGS = "contains(lower(filename), 'crop') AS fc, contains(lower(filename), 'resize') AS fr, contains(lower(filename), 'watermark') AS fw, regexp_matches(lower(filename), 'compress(ed|ion)') AS fz, regexp_matches(lower(filename), 'screenshot|capture') AS fs"
_RISK = _MI + f", t AS (SELECT id, {_TRUST} AS trust, coalesce(cardinality(exif), 0) = 0 AS stripped, risk_score AS forest, {_FLAGS} FROM mi), b AS (SELECT *, CASE WHEN trust < 30 THEN 20 WHEN trust < 60 THEN 10 WHEN trust < 90 THEN 5 ELSE 0 END AS band, CASE WHEN forest >= 75 THEN 30 WHEN forest >= 50 THEN 20 WHEN forest >= 30 THEN 10 ELSE 0 END AS extra FROM t)"


@REG.query(_MI + f" SELECT id, ({_TRUST})::INT AS trust FROM mi")
def e19_metadata_trust(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("id", forensics.metadata_trust(c("exif"), forensics.has(c("exif"), "Software")).alias("trust"))


@REG.query(_RISK + """ SELECT id, greatest(10, least(100, greatest(10, least(100, 100 - 15 * fc::INT - 10 * fr::INT - 15 * fw::INT - 20 * fz::INT - 25 * fs::INT - band)) - extra))::INT AS integrity,
greatest(0, least(95, greatest(0, least(95, 15 * fc::INT + 10 * fr::INT + 20 * fw::INT + 25 * fz::INT + 15 * fs::INT + 10 * stripped::INT + band)) + extra))::INT AS risk FROM b""")
def e21_integrity_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _items(spark, sf_dir)
    f, trust = forensics.name_flags(c("filename")), forensics.metadata_trust(c("exif"), forensics.has(c("exif"), "Software"))
    none = F.lit(None).cast("int")
    return d.select("id", forensics.integrity(f, trust, none, c("risk_score"), none, none).alias("integrity"), forensics.risk(f, trust, forensics.exif_count(c("exif")) == 0, c("risk_score"), none, none).alias("risk"))


@REG.query(_MI + " SELECT id, CASE WHEN coalesce(integrity_score < 30, FALSE) OR coalesce(risk_score / 50.0 > 1.8, FALSE) THEN 'HEAVY' WHEN coalesce(integrity_score < 90, FALSE) OR coalesce(risk_score / 50.0 > 1.3, FALSE) THEN 'LOW' ELSE 'CLEAN' END AS status FROM mi")
def e22_compression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity stands in for the JPEG quality and risk for blockiness, which need pixels."""
    return _items(spark, sf_dir).select("id", forensics.compression_status(c("integrity_score"), c("risk_score") / 50.0).alias("status"))


_CONS = _MI + f", t AS (SELECT id, risk_score AS ai, (100 - integrity_score) AS rf, {_TRUST} AS trust, (id % 50) AS ss, (id % 30) AS st, coalesce(cardinality(exif), 0) = 0 AS stripped FROM mi)"


@REG.query(_CONS + """ SELECT id, CASE WHEN ai >= 90 AND rf >= 70 AND trust <= 30 THEN 'HIGH_CONFIDENCE_AI_GENERATED' WHEN ai >= 80 AND stripped AND rf < 40 AND ss < 25 AND st < 20 THEN 'MIXED_SIGNALS'
WHEN ai >= 80 AND (rf >= 40 OR ss >= 25 OR st >= 25 OR (trust <= 50 AND rf >= 25)) THEN 'LIKELY_AI_GENERATED' WHEN ai >= 80 AND trust >= 80 AND rf < 40 AND ss < 25 AND st < 20 THEN 'MIXED_SIGNALS'
WHEN ai < 30 AND rf < 20 AND trust >= 90 AND st < 15 AND ss < 15 THEN 'VERIFIED_AUTHENTIC' WHEN ai < 50 AND rf < 30 AND trust >= 80 THEN 'LIKELY_AUTHENTIC' ELSE 'INVESTIGATE_FURTHER' END AS state FROM t""")
def e23_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _items(spark, sf_dir)
    return d.select("id", forensics.consensus(c("risk_score"), 100 - c("integrity_score"), forensics.metadata_trust(c("exif"), forensics.has(c("exif"), "Software")), c("id") % 50, c("id") % 30, forensics.exif_count(c("exif")) == 0).alias("state"))


@REG.query("""WITH r AS (SELECT DISTINCT id, visual_similarity * 100 AS v, semantic_similarity * 100 AS s, combined_score * 100 AS k FROM media_relationships), w AS (SELECT *, 35 * (v IS NOT NULL)::INT + 15 * (s IS NOT NULL)::INT + 15 * (k IS NOT NULL)::INT AS w FROM r),
x AS (SELECT id, w, CASE WHEN w = 0 THEN 0 ELSE least(98, round_even((coalesce(v * 35, 0) + coalesce(s * 15, 0) + coalesce(k * 15, 0)) / w, 0)::INT) END AS confidence FROM w)
SELECT id, confidence, CASE WHEN w = 0 THEN 'Low' WHEN confidence >= 80 THEN 'High' WHEN confidence >= 60 THEN 'Medium' ELSE 'Low' END AS level, CASE WHEN w >= 80 THEN 'Strong' WHEN w >= 50 THEN 'Moderate' WHEN w >= 35 THEN 'Weak' ELSE 'Insufficient' END AS sufficiency FROM x""")
def e24_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "media_relationships").select("id", "visual_similarity", "semantic_similarity", "combined_score").distinct()
    e = forensics.evidence_confidence({"visual": c("visual_similarity") * 100, "semantic": c("semantic_similarity") * 100, "metadata": c("combined_score") * 100})
    return r.select("id", e.alias("e")).select("id", "e.*")


@REG.query(_MI + f", t AS (SELECT id, {_TRUST} AS trust, risk_score FROM mi) SELECT id, array_to_string(list_filter([CASE WHEN trust < 30 THEN 'metadata missing' END, CASE WHEN risk_score > 65 THEN 'high risk' END, CASE WHEN trust >= 60 AND risk_score <= 35 THEN 'consistent' END], lambda x: x IS NOT NULL), '; ') AS findings FROM t")
def e25_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    trust = forensics.metadata_trust(c("exif"), forensics.has(c("exif"), "Software"))
    f = F.array_compact(F.array(F.when(trust < 30, "metadata missing"), F.when(c("risk_score") > 65, "high risk"), F.when((trust >= 60) & (c("risk_score") <= 35), "consistent")))
    return _items(spark, sf_dir).select("id", F.array_join(f, "; ").alias("findings"))


@REG.query(_MI + " SELECT id, greatest(2, least(98, trunc(100 / (1 + exp(-(0.014536 * (risk_score - 50) / 20 - 1.488286 * (coalesce(cardinality(exif), 0) > 0)::INT - 0.64545 * (id % 2) - 0.413436 * (integrity_score / 100.0) + 1.558882))))))::INT AS ai_probability FROM mi")
def e30_ai_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = forensics.ai_fusion(c("risk_score") - 50, (forensics.exif_count(c("exif")) > 0).cast("int"), c("id") % 2, c("integrity_score") / 100.0)
    return _items(spark, sf_dir).select("id", z.alias("ai_probability"))


@REG.query(_MI + " SELECT id, greatest(10, least(100, 100 - trunc(0.4 * (risk_score % 60))::INT - trunc(0.3 * (100 - integrity_score))::INT)) AS score FROM mi")
def e36_playground(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integrity of a simulated crop (per cent off) and requality."""
    crop, q = c("risk_score") % 60, c("integrity_score")
    return _items(spark, sf_dir).select("id", F.greatest(F.lit(10), F.least(F.lit(100), 100 - (0.4 * crop).cast("int") - (0.3 * (100 - q)).cast("int"))).alias("score"))


_TAGS = "MAP {" + ", ".join(f"'{k}': {list(v)}" for k, v in text.TAGS.items()) + "}"
_WORD_TAGS = f"flatten(list_filter(list_transform(regexp_extract_all(lower(coalesce(filename, '')), '[a-z0-9]+'), lambda w: {_TAGS}[w]), lambda x: x IS NOT NULL))"


@REG.query(mi("filename", "format", "mime_type") + f""" SELECT id, array_to_string(list_sort(list_distinct(list_filter({_WORD_TAGS} || ['Format: ' || nullif(format, ''), CASE WHEN starts_with(coalesce(mime_type, ''), 'video/') THEN 'Video Format' ELSE 'Image Format' END], lambda x: x IS NOT NULL)))[1:5], ',') AS tags FROM mi""")
def e37_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir, "filename", "format", "mime_type").select("id", F.array_join(text.tags(c("filename"), c("format"), c("mime_type")), ",").alias("tags"))


@REG.query(_MI + " SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(filename, ''), '\\.[^.]*$', ''), '[_|\\-]', ' ', 'g'), '(?i)\\b(copy|final|edited|img)\\b', ' ', 'g'), '\\s+', ' ', 'g')) AS query FROM mi")
def e38_cleaned_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("id", text.cleaned_query(c("filename")).alias("query"))


@REG.query(_MI + f", t AS (SELECT id, filename, list_sort(list_distinct({_WORD_TAGS}))[1:5] AS t FROM mi) SELECT id, CASE WHEN len(t) >= 2 THEN array_to_string(t[1:3], ' ') ELSE trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(filename, ''), '\\.[^.]*$', ''), '[_|\\-]', ' ', 'g'), '(?i)\\b(copy|final|edited|img)\\b', ' ', 'g'), '\\s+', ' ', 'g')) END AS query, least(95, 55 + 12 * len(t))::INT AS confidence FROM t")
def e39_e40_semantic_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = text.tags(c("filename"))
    return _items(spark, sf_dir).select("id", F.when(F.size(t) >= 2, F.array_join(F.slice(t, 1, 3), " ")).otherwise(text.cleaned_query(c("filename"))).alias("query"), text.match_confidence(F.size(t)).alias("confidence"))


_URL = "'https://' || CASE id % 4 WHEN 0 THEN 'www.reddit.com' WHEN 1 THEN 'www.daily-news.org' WHEN 2 THEN 'images.example.net' ELSE 'archive.example.org' END || '/' || coalesce(filename, '')"


@REG.query(_MI + f", u AS (SELECT id, {_URL} AS url, strftime(created_at, '%Y-%m-%d') AS d FROM mi) SELECT id, regexp_replace(regexp_extract(url, 'https?://([^/]+)', 1), '^www\\.', '') AS domain, CASE WHEN contains(url, 'reddit') THEN 'reddit' WHEN regexp_matches(regexp_extract(url, 'https?://([^/]+)', 1), 'news|times|post') THEN 'news' ELSE 'other' END AS source, coalesce(d, '2026-01-01') AS found FROM u")
def e41_e42_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.element_at(F.array(*map(F.lit, ("www.reddit.com", "www.daily-news.org", "images.example.net", "archive.example.org"))), (c("id") % 4 + 1).cast("int"))
    u = _items(spark, sf_dir).select("id", F.concat(F.lit("https://"), host, F.lit("/"), F.coalesce("filename", F.lit(""))).alias("url"), F.concat(F.lit("seen on "), F.date_format("created_at", "yyyy-MM-dd"), F.lit(" there")).alias("note"))
    return u.select("id", text.domain(c("url")).alias("domain"), text.url_source(c("url")).alias("source"), text.found_date(c("note"), "2026-01-01").alias("found"))


@REG.query("SELECT doc_id, CASE WHEN regexp_matches(text, '[\\x{0400}-\\x{04FF}]') THEN 'Cyrillic' WHEN regexp_matches(text, '[\\x{0900}-\\x{097F}]') THEN 'Devanagari' WHEN regexp_matches(text, '[\\x{0600}-\\x{06FF}]') THEN 'Arabic' ELSE 'Latin or other' END AS script FROM documents")
def e43_script(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.script(c("text")).alias("script"))


def _cases(rules: tuple, column: str = "n") -> str:
    return " ".join(f"WHEN {' OR '.join(f'contains({column}, {part!r})' for part in parts)} THEN '{name}'" for parts, name in rules)


@REG.query(_MI + f""", x AS (SELECT id, lower(coalesce(filename, '')) AS n FROM mi) SELECT id, CASE {_cases(text.SUBJECTS)} {_cases(text.SETTINGS)} ELSE '{text.NO_SCENE}' END AS scene,
CASE WHEN {' OR '.join(f"contains(n, '{w}')" for w in text.PLAIN_NAMES)} THEN {text.SURE} ELSE {text.UNSURE} END AS confidence FROM x""")
def e44_filename_clues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items(spark, sf_dir).select("id", text.scene(c("filename")).alias("s")).select("id", "s.*")


@REG.query("SELECT doc_id, sha256(text) AS sha FROM documents WHERE text IS NOT NULL")
def e45_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.sha2("text", 256).alias("sha"))


def _hash_mod(n: int) -> str:
    return f"list_reduce(list_transform(range(8), lambda i: ('0x' || substr(md5(coalesce(filename, '')), i::INT * 4 + 1, 4))::BIGINT), lambda r, x: (r * 65536 + x) % {n}) % {n}"


_ORIGIN = f"""CASE {' '.join(f"WHEN contains(coalesce(filename, ''), '_src_{t}_') THEN '{t}'" for t in text.SOURCE_TAGS)}
WHEN coalesce(is_fake, FALSE) THEN CASE {_cases(tuple((p, g) for g, p in text.GENERATORS))} ELSE {[g for g, _ in text.GENERATORS]}[{_hash_mod(4)} + 1] END
WHEN contains(n, 'screenshot') OR contains(f, 'screenshot') OR ends_with(f, '.png') OR (make = '' AND ({' OR '.join(f'(greatest(width, height) = {a} AND least(width, height) = {b})' for a, b in text.SCREEN_SIZES)})) THEN 'SCREENSHOT'
WHEN contains(n, 'whatsapp') OR contains(f, 'whatsapp') THEN 'WHATSAPP' WHEN contains(n, 'insta') OR contains(n, 'fb') THEN 'INSTAGRAM'
WHEN {' OR '.join(f"contains(make, '{b}') OR contains(model, '{b}')" for b in text.PHONES)} THEN CASE WHEN contains(make, 'apple') OR contains(model, 'iphone') THEN 'IPHONE' ELSE 'ANDROID' END
WHEN {' OR '.join(f"contains(make, '{b}') OR contains(model, '{b}')" for b in text.CAMERAS)} THEN 'DSLR'
{' '.join(f"WHEN h < {upto} THEN '{source}'" for source, upto in text.SOURCE_SHARES)} END"""


@REG.query(_AUDIT + f""", x AS (SELECT *, lower(coalesce(filename, '')) AS n, lower(coalesce(filepath, '')) AS f, lower(coalesce(exif['Make'], '')) AS make, lower(coalesce(exif['Model'], '')) AS model, {_hash_mod(100)} AS h FROM au)
SELECT audit_id, {_ORIGIN} AS origin, lower(regexp_replace(regexp_replace(coalesce(filename, ''), '\\.[^.]*$', ''), '(?i)_(src|copy|resized|compressed|crop|cropped|watermark|watermarked|screenshot)(_.*)?$', '')) AS identity FROM x""")
def e46_e47_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    origin = text.file_source(c("filepath"), c("filename"), F.element_at("exif", "Make"), F.element_at("exif", "Model"), c("width"), c("height"), c("is_fake"))
    return audit(spark, sf_dir).select("audit_id", origin.alias("origin"), text.source_identity(c("filename")).alias("identity"))


@REG.query("WITH g AS (SELECT event_id, (event_id % 90)::INT AS d, (event_id % 60)::INT AS m, (event_id % 59)::INT AS s, CASE WHEN event_id % 2 = 0 THEN 'N' ELSE 'S' END AS r FROM events) SELECT event_id, round((d + m / 60.0::DOUBLE + s / 3600.0::DOUBLE) * CASE WHEN r = 'S' THEN -1 ELSE 1 END, 6) AS degrees FROM g")
def e48_dms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Degrees of positions written as 12° 30' 5" N, taken apart by pattern."""
    e = table(spark, sf_dir, "events").select("event_id", F.format_string("%d° %d' %d\" %s", c("event_id") % 90, c("event_id") % 60, c("event_id") % 59, F.when(c("event_id") % 2 == 0, "N").otherwise("S")).alias("gps"))
    part = lambda k: F.regexp_extract("gps", r"^(\d+)° (\d+)' (\d+)\" ([NSEW])$", k)
    n = lambda k: part(k).cast("int")
    return e.select("event_id", F.round((n(1) + n(2) / 60.0 + n(3) / 3600.0) * F.when(part(4).isin("S", "W"), -1).otherwise(1), 6).alias("degrees"))


@REG.query(_MI + " SELECT id, embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NOT NULL AND v <> 0)) > 0 AS has_vector, (regexp_full_match(trim(coalesce(phash, '')), '[0-9A-Fa-f]{16}'))::INT + (regexp_full_match(trim(coalesce(dhash, '')), '[0-9A-Fa-f]{16}'))::INT + (regexp_full_match(trim(coalesce(ahash, '')), '[0-9A-Fa-f]{16}'))::INT AS n_hashes FROM mi")
def e52_presence(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = hashing.usable("phash").cast("int") + hashing.usable("dhash").cast("int") + hashing.usable("ahash").cast("int")
    return _items(spark, sf_dir).select("id", vectors.nonzero("embedding").alias("has_vector"), n.alias("n_hashes"))


@REG.query("SELECT doc_id, created_at AS parsed FROM (SELECT doc_id, date_trunc('second', created_at) AS created_at FROM documents)")
def e53_iso_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ISO text with or without a trailing Z back to a timestamp; anything else is null."""
    iso = F.concat(F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss"), F.when(c("doc_id") % 2 == 0, "Z").otherwise(""))
    plain = F.regexp_replace("iso", "Z$", "")
    return table(spark, sf_dir, "documents").select("doc_id", iso.alias("iso")).select("doc_id", F.try_to_timestamp(plain, F.lit("yyyy-MM-dd'T'HH:mm:ss")).cast("timestamp_ntz").alias("parsed"))


@REG.query(_MI + f" SELECT id, CASE WHEN coalesce(cardinality(exif), 0) > 0 THEN CASE WHEN {_HAS('Make', 'Model')} THEN 'Camera' ELSE 'Editor' END WHEN coalesce(integrity_score < 75, FALSE) THEN 'Messaging,Social Media' WHEN coalesce(risk_score > 40, FALSE) THEN 'Screenshot' ELSE 'Web' END AS channel, CASE WHEN risk_score > 65 THEN 'Manipulated' WHEN risk_score > 35 THEN 'Suspicious' ELSE 'Authentic' END AS verdict FROM mi")
def e54_e55_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    ch = forensics.likely_channel(c("exif"), c("integrity_score"), F.lit(None).cast("double"), c("risk_score"))
    return _items(spark, sf_dir).select("id", F.array_join(ch, ",").alias("channel"), forensics.verdict(c("risk_score")).alias("verdict"))


@REG.query(_MI + """, t AS (SELECT id, parent_id IS NOT NULL AS y, risk_score > 35 AS p, coalesce(cardinality(exif), 0) = 0 AS bare, risk_score, integrity_score FROM mi), w AS (SELECT id, CASE WHEN p THEN 'FP' ELSE 'FN' END AS error,
CASE WHEN p THEN list_filter([CASE WHEN bare THEN 'stripped EXIF' END, CASE WHEN integrity_score < 60 THEN 'low integrity' END], lambda x: x IS NOT NULL) ELSE list_filter([CASE WHEN risk_score < 20 THEN 'low score' END, CASE WHEN NOT bare THEN 'camera tags' END], lambda x: x IS NOT NULL) END AS c FROM t WHERE p <> y)
SELECT id, error, CASE WHEN len(c) = 0 THEN 'unexplained' ELSE array_to_string(c, ', ') END AS causes FROM w""")
def e56_root_causes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _items(spark, sf_dir).withColumns({"y": c("parent_id").isNotNull(), "p": c("risk_score") > 35, "bare": forensics.exif_count(c("exif")) == 0}).where("p <> y")
    fp = F.array_compact(F.array(F.when(c("bare"), "stripped EXIF"), F.when(c("integrity_score") < 60, "low integrity")))
    fn = F.array_compact(F.array(F.when(c("risk_score") < 20, "low score"), F.when(~c("bare"), "camera tags")))
    causes = F.when(c("p"), fp).otherwise(fn)
    return d.select("id", F.when(c("p"), "FP").otherwise("FN").alias("error"), F.when(F.size(causes) == 0, "unexplained").otherwise(F.array_join(causes, ", ")).alias("causes"))


@REG.query(_AUDIT + " SELECT audit_id, CASE WHEN coalesce(exif['Make'], '') <> '' AND NOT coalesce(is_fake, FALSE) THEN 'HIGH' WHEN is_fake IS NOT NULL AND lower(regexp_extract(filepath, '/(real|fake)/', 1)) = CASE WHEN is_fake THEN 'fake' ELSE 'real' END THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM au")
def e57_provenance_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = F.lower(F.regexp_extract("filepath", "/(real|fake)/", 1))
    high = (F.coalesce(F.element_at("exif", "Make"), F.lit("")) != "") & ~F.coalesce("is_fake", F.lit(False))
    return audit(spark, sf_dir).select("audit_id", F.when(high, "HIGH").when(F.coalesce(folder == F.when(c("is_fake"), "fake").otherwise("real"), F.lit(False)) & c("is_fake").isNotNull(), "MEDIUM").otherwise("LOW").alias("confidence"))


@REG.query("WITH r AS (SELECT DISTINCT id, initcap(lower(trim(relationship_type))) AS k FROM (SELECT id, relationship_type FROM media_relationships)) SELECT k AS kind, CASE WHEN k IN ('Crop', 'Cropped Variant') THEN 'Cropped Variant' WHEN k IN ('Screenshot') THEN 'Screenshot-Derived Variant' WHEN k IN ('Resize') THEN 'Resized Variant' WHEN k IN ('Watermark') THEN 'Watermarked Variant' WHEN k IN ('Recompressed') THEN 'Compressed Variant' WHEN k = 'Duplicate' THEN 'Duplicate' ELSE 'Modified Variant' END AS class, count(*) AS n FROM r GROUP BY ALL".replace("initcap(lower(trim(relationship_type)))", "upper(substr(lower(trim(relationship_type)), 1, 1)) || substr(lower(trim(relationship_type)), 2)"))
def e58_variant_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower(F.trim("relationship_type"))
    r = table(spark, sf_dir, "media_relationships").select("id", F.concat(F.upper(F.substring(low, 1, 1)), F.substring(low, 2, 1000)).alias("kind")).distinct()
    return r.groupBy("kind", scoring.asset_class(c("kind")).alias("class")).agg(F.count(F.lit(1)).alias("n"))


# ---- bytes and pixels: texts as file contents, numbers of the embeddings as grids ----
def _bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.encode("text", "utf-8").alias("content"))


def _hex(value: str | Column) -> Column:
    return F.unhex(F.lit(value) if isinstance(value, str) else value)


_SCALE = "CASE WHEN doc_id % 100 + 1 < 50 THEN 5000 // (doc_id % 100 + 1) ELSE 200 - 2 * (doc_id % 100 + 1) END"


@REG.query(f"""WITH s AS (SELECT doc_id, {_SCALE} AS s FROM documents WHERE text IS NOT NULL), r AS (SELECT doc_id, list_sort(list_transform({binary.STANDARD}, lambda v: greatest(1, least(255, (v * s + 50) // 100)) * 100.0::DOUBLE / v)) AS r FROM s),
m AS (SELECT doc_id, (r[32] + r[33]) / 2 AS m FROM r) SELECT doc_id, greatest(1, least(100, round_even(CASE WHEN m <= 100 THEN (200 - m) / 2 ELSE 5000 / m END, 0)))::INT AS quality, (1 + doc_id % 2)::INT AS n_tables FROM m""")
def e9_e10_jpeg_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files with the tables of quality 1 to 100, a second table in every other, a comment before and the text after them, parsed back."""
    want = (c("doc_id") % 100 + 1).cast("int")
    scale = F.when(want < 50, F.expr("5000 div (doc_id % 100 + 1)")).otherwise(200 - 2 * want)
    entry = lambda v: F.lpad(F.hex(F.greatest(F.lit(1), F.least(F.lit(255), F.floor((v * scale + 50) / 100))).cast("bigint")), 2, "0")
    one = F.array_join(F.transform(F.array(*map(F.lit, binary.STANDARD)), entry), "")
    two = F.when(c("doc_id") % 2 == 1, F.concat(F.lit("FFDB004301"), F.lit("07" * 64))).otherwise("")
    file = F.concat(_hex("FFD8FFFE0006FFDBFFDA"), _hex(F.concat(F.lit("FFDB004300"), one, two, F.lit("FFDA"))), c("content"), _hex("FFD9"))
    t = _bytes(spark, sf_dir).select("doc_id", binary.quantisation_tables(file).alias("t"))
    return t.select("doc_id", binary.jpeg_quality(F.element_at("t", 0)).alias("quality"), F.size("t").alias("n_tables"))


@REG.query("""WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, substr(h, 2 * i - 1, 2) AS v FROM (SELECT doc_id, h, unnest(range(1, len(h) // 2 + 1)) AS i FROM b)), n AS (SELECT doc_id, v, count(*) AS n FROM x GROUP BY ALL),
p AS (SELECT doc_id, n / sum(n) OVER (PARTITION BY doc_id)::DOUBLE AS p FROM n), e AS (SELECT doc_id, -sum(p * log2(p)) AS e FROM p GROUP BY 1) SELECT b.doc_id, round(coalesce(e, 0), 5) + 0 AS entropy FROM b LEFT JOIN e USING (doc_id)""")
def e26_byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bytes(spark, sf_dir).select("doc_id", F.round(binary.byte_entropy("content"), 5).alias("entropy"))


#: What is appended to a file: extension, tail in hex, whether a trusted camera took it; then bytes that count and points.
_CASES = (
    ("jpg", "", False, 0, 0), ("jpg", "41" * 16, False, 0, 0), ("jpg", "41" * 17, False, 17, 40), ("jpg", "504B0304" + "41" * 20, False, 24, 65), ("jpg", "504B0304" + "4D5A" + "41" * 20, False, 26, 90),
    ("jpg", "FFD8" + "41" * 30, True, 32, 0), ("jpg", "FFD8" + "41" * 30, False, 32, 40), ("jpg", "504B0304" + "FFD8" + "41" * 30, False, 36, 85), ("jpg", "504B0304" + "41" * 20, True, 24, 25),
    ("png", "41" * 16, False, 0, 0), ("png", "504E47" + "41" * 20, False, 23, 40), ("png", "504E47" + "7F454C46" + "41" * 20, False, 27, 85), ("gif", "504B0304" + "41" * 20, False, 0, 0),
)


@REG.query("SELECT doc_id, " + ", ".join(f"{[k[i] for k in _CASES]}[(doc_id % {len(_CASES)})::INT + 1]::INT AS {name}" for i, name in ((3, "tail_bytes"), (4, "suspicion"))) + " FROM documents WHERE text IS NOT NULL")
def e27_appended_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tails of many kinds behind the end mark of files whose contents are texts; points without those for entropy."""
    pick = lambda i: F.element_at(F.array(*[F.lit(k[i]) for k in _CASES]), (c("doc_id") % len(_CASES)).cast("int") + 1)
    start = F.when(pick(0) == "png", _hex("89504E470D0A1A0A")).otherwise(_hex("FFD8"))
    end = F.when(pick(0) == "png", _hex("0000000049454E44AE426082")).otherwise(_hex("FFD9"))
    d = _bytes(spark, sf_dir).select("doc_id", binary.appended(F.concat(start, "content", end, F.unhex(pick(1))), pick(0)).alias("t"), pick(2).alias("trusted"))
    return d.select("doc_id", c("t.tail_bytes").alias("tail_bytes"), binary.appended_suspicion(c("t"), c("trusted"), F.lit(0.0)).alias("suspicion"))


@REG.query()
def e28_e32_pixel_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash, blockiness, Laplacian variance, spectrum peaks and self-similarity of 8 x 8 grids grown from the vectors."""
    row = lambda i: F.transform(F.slice("embedding", i * 8 + 1, 8), lambda x: (x * 255).cast("double"))
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(7)), row).alias("g"))
    return e.select("vec_id", pixels.grid_phash("g").alias("phash"), F.round(pixels.grid_blockiness("g"), 6).alias("blockiness"), F.round(pixels.grid_laplacian("g"), 3).alias("laplacian"), pixels.grid_peaks("g").alias("peaks"), F.round(pixels.grid_ssim("g", "g"), 6).alias("self_ssim"), F.size(pixels.edited_regions("g")).alias("n_regions"))


_ = _CODE
