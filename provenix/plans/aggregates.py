"""Aggregates, families, windows, set operations, deduplication and sampling (A, W and O of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from provenix.functions import forensics, hashing, text
from provenix.operators import dedup, families, sampling
from provenix.plans.common import items, mi
from provenix.plans.joins import _AUDIT, _CODE, audit
from provenix.plans.registry import Registry
from provenix.sources.tables import table

REG = Registry()


@REG.query(mi("case_id", "mime_type", "risk_score") + """ SELECT count(*) AS n_items, count(DISTINCT case_id) AS n_cases, count_if(starts_with(mime_type, 'video/'))::BIGINT AS n_videos, count_if(risk_score > 65)::BIGINT AS n_risky FROM mi""")
def a1_dashboard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir, "case_id", "mime_type", "risk_score")
    return d.agg(F.count(F.lit(1)).alias("n_items"), F.count_distinct("case_id").alias("n_cases"), F.count_if(F.col("mime_type").startswith("video/")).alias("n_videos"), F.count_if(F.col("risk_score") > 65).alias("n_risky"))


@REG.query("WITH r AS (SELECT DISTINCT id, combined_score, lower(trim(relationship_type)) AS kind FROM media_relationships) SELECT kind, count(*) AS n, round(coalesce(avg(combined_score), 0), 6) AS mean_score FROM r GROUP BY 1")
def a2_mean_or_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "media_relationships").select("id", "combined_score", F.lower(F.trim("relationship_type")).alias("kind")).distinct()
    return r.groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.round(F.coalesce(F.avg("combined_score"), F.lit(0.0)), 6).alias("mean_score"))


_FAM = mi("case_id", "cluster_id", "integrity_score", "created_at", "filename", "mime_type")
_FAM_SQL = """, f AS (SELECT case_id, coalesce(cluster_id, 'unclustered') AS family, count(*) AS n_items, min(created_at) AS first_seen, trunc(coalesce(avg(integrity_score), 90))::INT AS confidence, arg_min(filename, id) AS first_name FROM mi {w} GROUP BY 1, 2)
SELECT *, CASE WHEN confidence >= 80 THEN 'High' WHEN confidence >= 60 THEN 'Medium' ELSE 'Low' END AS level FROM f"""


@REG.query(_FAM + _FAM_SQL.format(w="WHERE case_id = 17"))
def a3_case_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.families(items(spark, sf_dir, "case_id", "cluster_id", "integrity_score", "created_at", "filename").where("case_id = 17"))


@REG.query(_FAM + _FAM_SQL.format(w=""))
def a4_all_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of all cases; items without a cluster stay apart by case."""
    return families.families(items(spark, sf_dir, "case_id", "cluster_id", "integrity_score", "created_at", "filename"))


@REG.query(mi("exif") + " SELECT coalesce(exif['Make'], 'none') AS make, count(*) AS n FROM mi GROUP BY 1")
def a5_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir, "exif").groupBy(F.coalesce(F.element_at("exif", "Make"), F.lit("none")).alias("make")).agg(F.count(F.lit(1)).alias("n"))


@REG.query(mi("case_id", "cluster_id") + """, r AS (SELECT DISTINCT id, source_id, target_id, visual_similarity, semantic_similarity FROM media_relationships),
e AS (SELECT s.case_id, s.cluster_id, r.visual_similarity AS v, r.semantic_similarity AS m FROM r JOIN mi s ON s.id = r.source_id JOIN mi t ON t.id = r.target_id AND t.case_id = s.case_id AND t.cluster_id = s.cluster_id),
g AS (SELECT case_id, cluster_id, count(*) AS n_matches, coalesce(avg(v), 1) AS avg_visual, coalesce(avg(m), 1) AS avg_semantic, count_if(m < 0.75) AS low FROM e GROUP BY 1, 2)
SELECT case_id, cluster_id, n_matches, round(avg_visual, 9) AS avg_visual, round(avg_semantic, 9) AS avg_semantic, trunc(low * 100 / n_matches)::INT AS contamination,
CASE WHEN trunc(low * 100 / n_matches) <= 20 THEN 'Healthy' WHEN trunc(low * 100 / n_matches) <= 50 THEN 'Review Recommended' ELSE 'Possible Contamination' END AS health,
round(0.4 * (100 - trunc(low * 100 / n_matches)) + 0.4 * 50 + 20 * avg_visual, 9) AS reliability FROM g""")
def a6_cluster_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "media_relationships").select("id", "source_id", "target_id", "visual_similarity", "semantic_similarity").distinct()
    return families.diagnostics(r, items(spark, sf_dir, "case_id", "cluster_id"))


@REG.query("WITH r AS (SELECT DISTINCT id, visual_similarity v, semantic_similarity s, combined_score c FROM media_relationships), l AS (SELECT id, list_filter([v, s, c], lambda x: x IS NOT NULL) AS m FROM r) SELECT id, round(greatest(0, 1 - CASE WHEN len(m) > 0 THEN list_var_pop(m) ELSE 0 END), 6) AS stability FROM l")
def a7_row_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    from provenix.functions.scoring import variance

    r = table(spark, sf_dir, "media_relationships").select("id", "visual_similarity", "semantic_similarity", "combined_score").distinct()
    v = variance([F.col("visual_similarity"), F.col("semantic_similarity"), F.col("combined_score")])
    return r.select("id", F.round(F.greatest(F.lit(0.0), 1 - v), 6).alias("stability"))


@REG.query(mi("mime_type", "file_size", "risk_score") + " SELECT mime_type, median(file_size::DOUBLE) AS median_size, round(stddev_pop(risk_score), 6) AS std_risk, round(var_pop(risk_score), 6) AS var_risk FROM mi GROUP BY 1")
def a8_exact_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir, "mime_type", "file_size", "risk_score").groupBy("mime_type").agg(F.median("file_size").alias("median_size"), F.round(F.stddev_pop("risk_score"), 6).alias("std_risk"), F.round(F.var_pop("risk_score"), 6).alias("var_risk"))


@REG.query("""WITH d AS (SELECT sha256(text) AS h, count(*) AS c FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT coalesce(sum(c - 1), 0)::BIGINT AS n_duplicates, count_if(c > 1)::BIGINT AS n_groups, round(coalesce(sum(c - 1) / sum(c)::DOUBLE, 0), 6) AS ratio FROM d""")
def a23_duplicate_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("c"))
    return d.agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n_duplicates"), F.count_if(F.col("c") > 1).alias("n_groups"), F.round(F.coalesce(F.sum(F.col("c") - 1) / F.sum("c"), F.lit(0.0)), 6).alias("ratio"))


@REG.query(_AUDIT + """ SELECT CASE WHEN width < 64 OR height < 64 THEN 'tiny' WHEN width < 256 AND height < 256 THEN 'small' WHEN width <= 1024 AND height <= 1024 THEN 'medium' ELSE 'large' END AS bucket, count(*) AS n FROM au GROUP BY 1""")
def a24_resolution_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h = F.col("width"), F.col("height")
    b = F.when((w < 64) | (h < 64), "tiny").when((w < 256) & (h < 256), "small").when((w <= 1024) & (h <= 1024), "medium").otherwise("large")
    return audit(spark, sf_dir).groupBy(b.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@REG.query(_AUDIT + """, g AS (SELECT count(*) AS n, count_if(sha IS NULL OR sha = '') AS bare, count(DISTINCT sha) AS shas, count_if(width < 64 OR height < 64) AS tiny, count_if(is_fake) AS fake, count(DISTINCT split) AS splits FROM au),
c AS (SELECT list_filter([CASE WHEN bare > n * 0.05 THEN 'hashes missing' END, CASE WHEN tiny > n * 0.01 THEN 'tiny pictures' END, CASE WHEN fake < n * 0.2 OR fake > n * 0.8 THEN 'unbalanced' END, CASE WHEN splits < 3 THEN 'splits missing' END], lambda x: x IS NOT NULL) AS failed FROM g)
SELECT CASE WHEN len(failed) = 0 THEN 'PASSED' ELSE 'FAILED' END AS status, array_to_string(failed, '; ') AS failed FROM c""")
def a25_quality_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    sha = F.col("sha")
    g = audit(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(sha.isNull() | (sha == "")).alias("bare"), F.count_if((F.col("width") < 64) | (F.col("height") < 64)).alias("tiny"), F.count_if("is_fake").alias("fake"), F.count_distinct("split").alias("splits"))
    gates = F.array_compact(F.array(F.when(F.col("bare") > F.col("n") * 0.05, "hashes missing"), F.when(F.col("tiny") > F.col("n") * 0.01, "tiny pictures"),
                                    F.when((F.col("fake") < F.col("n") * 0.2) | (F.col("fake") > F.col("n") * 0.8), "unbalanced"), F.when(F.col("splits") < 3, "splits missing")))
    return g.select(F.when(F.size(gates) == 0, "PASSED").otherwise("FAILED").alias("status"), F.array_join(gates, "; ").alias("failed"))


_DOC = "WITH d AS (SELECT doc_id, replace(lower(trim(source)), '-', '_') AS source, created_at, loaded_at, n_chars, lang, doc_kind, text FROM documents)"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").withColumn("source", F.regexp_replace(F.lower(F.trim("source")), "-", "_"))


@REG.query(_DOC + """ SELECT coalesce(source, 'unknown') AS source, count(*) AS n, min(created_at) AS first_seen, max(created_at) AS last_seen, trunc(coalesce(avg(n_chars), 50))::BIGINT AS mean_size, count(DISTINCT lang) AS n_langs FROM d GROUP BY 1""")
def a26_source_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(F.count(F.lit(1)).alias("n"), F.min("created_at").alias("first_seen"), F.max("created_at").alias("last_seen"), F.coalesce(F.avg("n_chars"), F.lit(50.0)).cast("bigint").alias("mean_size"), F.count_distinct("lang").alias("n_langs"))


@REG.query(_DOC + """ SELECT case_id, min(d.created_at) AS earliest, arg_min(d.source, struct_pack(a := d.created_at, b := d.doc_id)) AS first_source, count(DISTINCT d.source) AS n_sources, trunc(coalesce(avg(n_chars * w), 50))::BIGINT AS weighted_size
FROM (SELECT d.*, o.case_id, CASE d.source WHEN 'case_reports' THEN 1.0 WHEN 'analyst_notes' THEN 0.8 ELSE 0.5 END AS w FROM d JOIN documents o USING (doc_id) WHERE d.source IS NOT NULL AND d.created_at IS NOT NULL) d GROUP BY 1""")
def a27_provider_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of several sources on one case merged: earliest, first source, sources, mean of size times trust."""
    d = _docs(spark, sf_dir).where("source is not null and created_at is not null")
    w = F.when(F.col("source") == "case_reports", 1.0).when(F.col("source") == "analyst_notes", 0.8).otherwise(0.5)
    return d.groupBy("case_id").agg(F.min("created_at").alias("earliest"), F.min(F.struct("created_at", "doc_id", "source"))["source"].alias("first_source"), F.count_distinct("source").alias("n_sources"), F.coalesce(F.avg(F.col("n_chars") * w), F.lit(50.0)).cast("bigint").alias("weighted_size"))


@REG.query(_AUDIT + """ SELECT replace(lower(trim(dataset)), '-', '_') AS dataset, count(*) AS n, min(width * height) AS min_px, max(width * height) AS max_px, round(avg(width * height), 2) AS mean_px, round(avg((coalesce(cardinality(exif), 0) > 0)::INT), 6) AS exif_rate FROM au GROUP BY 1""")
def a28_dataset_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    px = F.col("width") * F.col("height")
    return audit(spark, sf_dir).groupBy(F.regexp_replace(F.lower(F.trim("dataset")), "-", "_").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n"), F.min(px).alias("min_px"), F.max(px).alias("max_px"), F.round(F.avg(px), 2).alias("mean_px"), F.round(F.avg((forensics.exif_count(F.col("exif")) > 0).cast("int")), 6).alias("exif_rate"))


@REG.query(mi("exif", "format", "width") + """ SELECT count_if(exif['Make'] IS NOT NULL)::BIGINT AS with_camera, count_if(exif['Software'] IS NOT NULL)::BIGINT AS edited, count_if(format = 'PNG')::BIGINT AS png, count_if(width >= 3000)::BIGINT AS large FROM mi""")
def a29_dataset_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir, "exif", "format", "width")
    there = lambda k: F.element_at("exif", k).isNotNull()
    return d.agg(F.count_if(there("Make")).alias("with_camera"), F.count_if(there("Software")).alias("edited"), F.count_if(F.col("format") == "PNG").alias("png"), F.count_if(F.col("width") >= 3000).alias("large"))


@REG.query("""WITH r AS (SELECT DISTINCT id, source_id, combined_score FROM media_relationships), t AS (SELECT source_id, combined_score, row_number() OVER (PARTITION BY source_id ORDER BY combined_score DESC, id) AS rn FROM r WHERE combined_score IS NOT NULL AND source_id IS NOT NULL)
SELECT source_id, greatest(2, least(98, trunc(avg(combined_score) * 100)))::INT AS top3 FROM t WHERE rn <= 3 GROUP BY 1""")
def a30_top_k_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "media_relationships").select("id", "source_id", "combined_score").distinct().where("combined_score is not null and source_id is not null")
    w = Window.partitionBy("source_id").orderBy(F.desc("combined_score"), "id")
    top = r.withColumn("rn", F.row_number().over(w)).where("rn <= 3").groupBy("source_id").agg(F.avg("combined_score").alias("m"))
    return top.select("source_id", F.greatest(F.lit(2), F.least(F.lit(98), (F.col("m") * 100).cast("int"))).alias("top3"))


# ---- windows ----
_W = mi("case_id", "cluster_id", "width", "height", "file_size", "exif", "created_at", "filename", "risk_score", "integrity_score", "mime_type")


@REG.query(_W + """, x AS (SELECT id, case_id, cluster_id, coalesce(width, 0) * coalesce(height, 0)::BIGINT AS px, coalesce(cardinality(exif), 0) AS tags, coalesce(file_size, 0) AS sz FROM mi WHERE cluster_id IS NOT NULL)
SELECT id, round(coalesce(px / nullif(max(px) OVER w, 0)::DOUBLE, 1), 6) AS px_share, round(coalesce(tags / nullif(max(tags) OVER w, 0)::DOUBLE, 0), 6) AS tag_share, round(coalesce(sz / nullif(max(sz) OVER w, 0)::DOUBLE, 1), 6) AS size_share FROM x WINDOW w AS (PARTITION BY case_id, cluster_id)""")
def w1_group_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.shares(items(spark, sf_dir, "case_id", "cluster_id", "width", "height", "file_size", "exif").where("cluster_id is not null")).select("id", *[F.round(c, 6).alias(c) for c in ("px_share", "tag_share", "size_share")])


_RANK = _W + """, x AS (SELECT id, case_id, cluster_id, filename, coalesce(width, 0) * coalesce(height, 0)::BIGINT AS px, coalesce(cardinality(exif), 0) AS tags, coalesce(file_size, 0) AS sz FROM mi WHERE cluster_id IS NOT NULL),
n AS (SELECT *, coalesce(px / nullif(max(px) OVER w, 0)::DOUBLE, 1) AS a, coalesce(tags / nullif(max(tags) OVER w, 0)::DOUBLE, 0) AS b, coalesce(sz / nullif(max(sz) OVER w, 0)::DOUBLE, 1) AS c FROM x WINDOW w AS (PARTITION BY case_id, cluster_id)),
s AS (SELECT id, case_id, cluster_id, round(40 * a + 20 * b + 15 * c + greatest(-60, -30 * contains(lower(filename), 'crop')::INT - 25 * contains(lower(filename), 'resize')::INT - 35 * contains(lower(filename), 'watermark')::INT
 - 10 * regexp_matches(lower(filename), 'compress(ed|ion)')::INT - 15 * regexp_matches(lower(filename), 'screenshot|capture')::INT - 5 * (tags = 0)::INT), 6) AS score FROM n),
r AS (SELECT *, row_number() OVER o AS rn, lead(score) OVER o AS nxt, min(score) OVER g AS lo, sum(score) OVER g AS total, count(*) OVER g AS n FROM s WINDOW o AS (PARTITION BY case_id, cluster_id ORDER BY score DESC, id), g AS (PARTITION BY case_id, cluster_id)),
top AS (SELECT case_id, cluster_id, id, n, score, nxt, CASE WHEN n = 1 THEN FALSE WHEN nxt > 0 THEN score >= nxt * 1.10 ELSE score - nxt >= 10 END AS decided, (score - lo + 10) / (total - n * lo + n * 10) AS p FROM r WHERE rn = 1)
"""


@REG.query(_RANK + "SELECT case_id, cluster_id, n AS n_items, round(score, 4) AS best_score, round(nxt, 4) AS next_score, decided, CASE WHEN decided THEN id END AS origin_id, CASE WHEN decided THEN trunc(round(p * 100, 6))::INT WHEN n = 1 THEN 100 ELSE 50 END AS probability FROM top")
def g5_origin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Origin of each stored cluster by ranked score, margin over the next and share of the shifted scores."""
    return families.origins(items(spark, sf_dir, "case_id", "cluster_id", "width", "height", "file_size", "exif", "filename").where("cluster_id is not null"))


@REG.query(_RANK + "SELECT id, rn::INT AS place, round(score, 4) AS score, round((score - lo + 10) / (total - n * lo + n * 10), 6) AS share FROM r")
def w3_rank_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.ranked(items(spark, sf_dir, "case_id", "cluster_id", "width", "height", "file_size", "exif", "filename").where("cluster_id is not null")).select("id", "place", F.round("score", 4).alias("score"), F.round("share", 6).alias("share"))


@REG.query(_W + """, x AS (SELECT id, case_id, cluster_id, round(-epoch(created_at) / 86400 * 10 + coalesce(width, 0) * coalesce(height, 0)::BIGINT / 1000000.0 * 50 + coalesce(file_size, 0) / 1048576.0 * 20 + coalesce(cardinality(exif), 0) * 5 - 15, 3) AS score FROM mi WHERE cluster_id IS NOT NULL)
SELECT id, row_number() OVER (PARTITION BY case_id, cluster_id ORDER BY score DESC, id)::INT AS place FROM x""")
def w4_chronology_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir, "case_id", "cluster_id", "width", "height", "file_size", "exif", "created_at").where("cluster_id is not null")
    return families.chronology(d).select("id", "place")


@REG.query(mi("created_at", "filename") + " SELECT id, filename, created_at FROM mi ORDER BY created_at DESC, id LIMIT 5")
def w5_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir, "created_at", "filename").orderBy(F.desc("created_at"), "id").limit(5)


@REG.query(mi("mime_type", "file_size") + ", r AS (SELECT id, mime_type, file_size, row_number() OVER (PARTITION BY mime_type ORDER BY file_size DESC NULLS LAST, id) AS rn FROM mi) SELECT id, mime_type, file_size FROM r WHERE rn <= 20")
def w5_largest_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.top_per_group(items(spark, sf_dir, "mime_type", "file_size"), ["mime_type"], [F.desc_nulls_last("file_size"), F.col("id")], 20).select("id", "mime_type", "file_size")


@REG.query(mi("mime_type", "risk_score") + " SELECT id, rank() OVER w + (count(*) OVER (PARTITION BY mime_type, risk_score) - 1) / 2.0::DOUBLE AS mean_rank FROM mi WINDOW w AS (PARTITION BY mime_type ORDER BY risk_score)")
def w6_mean_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks within a type, equal values sharing the mean of theirs: counted per value first, so no group is sorted whole."""
    return sampling.mean_ranks(items(spark, sf_dir, "mime_type", "risk_score"), "mime_type", "risk_score").select("id", "mean_rank")


# ---- sets, duplicates, samples ----
@REG.query("WITH r AS (SELECT DISTINCT id, combined_score FROM media_relationships) SELECT id, combined_score FROM r WHERE combined_score IS NOT NULL ORDER BY combined_score DESC, id")
def o1_sort_desc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "media_relationships").select("id", "combined_score").distinct().where("combined_score is not null").orderBy(F.desc("combined_score"), "id")


@REG.query("SELECT doc_id, created_at FROM documents WHERE created_at IS NOT NULL ORDER BY created_at DESC, doc_id LIMIT 1")
def o2_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "created_at").where("created_at is not null").orderBy(F.desc("created_at"), "doc_id").limit(1)


@REG.query(_AUDIT + " SELECT sha FROM au WHERE split = 'train' AND sha <> '' INTERSECT SELECT sha FROM au WHERE split = 'test'")
def o3_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = audit(spark, sf_dir)
    return a.where("split = 'train' and sha <> ''").select("sha").intersect(a.where("split = 'test'").select("sha"))


@REG.query(_DOC + mi("filename").replace("WITH", ",") + " SELECT 'document' AS kind, doc_id AS id, source AS label FROM d UNION ALL SELECT 'media', id, filename FROM mi")
def o4_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select(F.lit("document").alias("kind"), F.col("doc_id").alias("id"), F.col("source").alias("label")).unionByName(items(spark, sf_dir, "filename").select(F.lit("media").alias("kind"), "id", F.col("filename").alias("label")))


@REG.query(_DOC + " SELECT DISTINCT source, doc_kind FROM d")
def o5_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("source", "doc_kind").distinct()


@REG.query("SELECT doc_id FROM (SELECT doc_id, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) AS rn FROM documents WHERE text IS NOT NULL) WHERE rn = 1")
def o6_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_first(table(spark, sf_dir, "documents").where("text is not null"), F.sha2("text", 256), "doc_id").select("doc_id")


@REG.query()
def o7_greedy_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items kept when each is dropped that is within two bits (ahash) of one kept before it, in order of id."""
    return dedup.greedy_near(items(spark, sf_dir, "ahash"), "id", "ahash", 2)


@REG.query(_AUDIT + f""", s AS (SELECT audit_id, filename, lower(regexp_replace(regexp_replace(coalesce(filename, ''), '\\.[^.]*$', ''), '(?i)_(src|copy|resized|compressed|crop|cropped|watermark|watermarked|screenshot)(_.*)?$', '')) AS grp FROM au)
SELECT audit_id, CASE WHEN ('0x' || substr(md5('42' || grp), 1, 8))::UBIGINT % 100 < 80 THEN 'train' ELSE 'test' END AS part FROM s""")
def o8_group_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """80/20 by original, so all variants of one original are on one side."""
    return sampling.hash_split(audit(spark, sf_dir), text.source_identity(F.col("filename")), {"train": 80, "test": 20}, 42).select("audit_id", "part")


@REG.query(_AUDIT + """ SELECT audit_id, CASE WHEN b < 70 THEN 'train' WHEN b < 85 THEN 'val' ELSE 'test' END AS part FROM (SELECT audit_id, ('0x' || substr(md5('7' || audit_id::VARCHAR), 1, 8))::UBIGINT % 100 AS b FROM au)""")
def o9_three_way_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.hash_split(audit(spark, sf_dir), F.col("audit_id").cast("string"), {"train": 70, "val": 15, "test": 15}, 7).select("audit_id", "part")


@REG.query(_AUDIT + """, r AS (SELECT audit_id, lower(trim(dataset)) AS ds, row_number() OVER (PARTITION BY lower(trim(dataset)) ORDER BY md5('11' || audit_id::VARCHAR), audit_id) AS rn FROM au) SELECT audit_id, ds FROM r WHERE rn <= 30""")
def o10_seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """At most 30 rows per data set in the order of a seeded hash; a sampling operator."""
    a = audit(spark, sf_dir).withColumn("ds", F.lower(F.trim("dataset")))
    return sampling.top_per_group(a, ["ds"], [F.md5(F.concat(F.lit("11"), F.col("audit_id").cast("string"))), F.col("audit_id")], 30).select("audit_id", "ds")


@REG.query(_AUDIT + " SELECT audit_id, (('0x' || substr(md5(coalesce(filename, '')), 32, 1))::INT % 4) AS bucket, (list_reduce(list_transform(range(8), lambda i: ('0x' || substr(md5(coalesce(filename, '')), i::INT * 4 + 1, 4))::BIGINT), lambda r, x: (r * 65536 + x) % 100) % 100)::INT AS percentile FROM au")
def o11_md5_bucket(spark: SparkSession, sf_dir: str) -> DataFrame:
    digit = F.conv(F.substring(F.md5(F.coalesce("filename", F.lit(""))), 32, 1), 16, 10).cast("int")
    return audit(spark, sf_dir).select("audit_id", F.pmod(digit, F.lit(4)).alias("bucket"), hashing.md5_mod(F.col("filename"), 100).alias("percentile"))


_ = (hashing, _CODE)
