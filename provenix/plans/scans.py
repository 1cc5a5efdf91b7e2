"""Scans, sinks, filters and projections (S and F of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenix.functions import forensics, text
from provenix.operators import mutate
from provenix.plans.common import items, mi
from provenix.plans.registry import Registry
from provenix.session import shared_table
from provenix.sources import files
from provenix.sources.tables import table

REG = Registry()


@REG.query("SELECT id, name, description, created_at, lower(trim(status)) AS status FROM cases")
def s1_table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "cases").withColumn("status", F.lower(F.trim("status")))


@REG.query(mi("filename", "case_id", "risk_score") + " SELECT * FROM mi WHERE id = 1042")
def s2_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir, "filename", "case_id", "risk_score").where("id = 1042")


@REG.query(mi("file_size", "batch_id") + """, del AS (SELECT media_id, max(deleted_at) AS deleted_at FROM media_deletions WHERE restored_at IS NULL GROUP BY 1)
SELECT id, file_size, CASE WHEN del.media_id IS NOT NULL THEN 'deleted' ELSE 'present' END AS state, del.deleted_at FROM mi LEFT JOIN del ON del.media_id = mi.id""")
def s3_snapshot_update(spark: SparkSession, sf_dir: str) -> DataFrame:
    gone = table(spark, sf_dir, "media_deletions").where("restored_at is null").groupBy(F.col("media_id").alias("id")).agg(F.max("deleted_at").alias("deleted_at"))
    base = items(spark, sf_dir, "file_size").withColumns({"state": F.lit("present"), "deleted_at": F.lit(None).cast("timestamp_ntz")})
    return mutate.update(base, gone.withColumn("state", F.lit("deleted")), "id")


@REG.query("""WITH k AS (SELECT DISTINCT id, media_id, frame_ts, phash FROM keyframes)
SELECT id, media_id, frame_ts, phash FROM k WHERE media_id IS NULL OR media_id % 50 <> 0
UNION ALL SELECT -id, media_id, frame_ts, phash FROM k WHERE media_id % 50 = 0 AND frame_ts < 4""")
def s4_replace_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "keyframes").select("id", "media_id", "frame_ts", "phash").distinct()
    rescanned = k.where("media_id % 50 = 0")
    fresh = rescanned.where("frame_ts < 4").withColumn("id", -F.col("id"))
    return mutate.replace_keys(k, fresh, rescanned.select("media_id"), "media_id")


@REG.query(mi("case_id") + """, dead AS (SELECT id FROM cases WHERE lower(trim(status)) = 'closed'), kept AS (SELECT * FROM mi WHERE case_id IS NULL OR case_id NOT IN (SELECT id FROM dead)),
lost AS (SELECT id FROM mi WHERE case_id IN (SELECT id FROM dead)), k AS (SELECT DISTINCT id, media_id FROM keyframes), r AS (SELECT DISTINCT id, source_id, target_id FROM media_relationships)
SELECT 'media_items' AS tbl, count(*) AS n FROM kept UNION ALL SELECT 'keyframes', count(*) FROM k WHERE media_id IS NULL OR media_id NOT IN (SELECT id FROM lost)
UNION ALL SELECT 'media_relationships', count(*) FROM r WHERE (source_id IS NULL OR source_id NOT IN (SELECT id FROM lost)) AND (target_id IS NULL OR target_id NOT IN (SELECT id FROM lost))""")
def s5_cascade_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = table(spark, sf_dir, "cases").where(F.lower(F.trim("status")) == "closed").select(F.col("id").alias("case_id"))
    every = items(spark, sf_dir, "case_id")
    kept, lost = mutate.delete_keys(every, dead, "case_id"), every.join(dead, "case_id", "left_semi")
    gone = lambda c: lost.select(F.col("id").alias(c))
    frames = mutate.delete_keys(table(spark, sf_dir, "keyframes").select("id", "media_id").distinct(), gone("media_id"), "media_id")
    rel = table(spark, sf_dir, "media_relationships").select("id", "source_id", "target_id").distinct()
    rel = mutate.delete_keys(mutate.delete_keys(rel, gone("source_id"), "source_id"), gone("target_id"), "target_id")
    count = lambda df, n: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("tbl"), "n")
    return count(kept, "media_items").unionByName(count(frames, "keyframes")).unionByName(count(rel, "media_relationships"))


@REG.query("""WITH a AS (SELECT DISTINCT ON (audit_id) audit_id, filepath, file_size FROM dataset_audit)
SELECT lower(regexp_extract(filepath, '\\.([A-Za-z0-9]+)$', 1)) AS ext, count(*) AS n_files, sum(file_size)::BIGINT AS n_bytes FROM a
WHERE regexp_matches(filepath, '(?i)\\.(jpg|jpeg|png|webp|tif|tiff)$') GROUP BY 1""")
def s6_file_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "dataset_audit").select("audit_id", "filepath", "file_size").dropDuplicates(["audit_id"])
    return files.pictures(a, "filepath").groupBy(files.extension("filepath").alias("ext")).agg(F.count(F.lit(1)).alias("n_files"), F.sum("file_size").alias("n_bytes"))


_VECTORS = mi("risk_score", "integrity_score", "file_size", "filename") + " SELECT id, risk_score, integrity_score, file_size, filename FROM mi"


@REG.query(_VECTORS)
def s7_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.round_trip(items(spark, sf_dir, "risk_score", "integrity_score", "file_size", "filename"), "csv", shared_table(spark, "csv"))


@REG.query(_VECTORS)
def s8_json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.round_trip(items(spark, sf_dir, "risk_score", "integrity_score", "file_size", "filename"), "json", shared_table(spark, "json"))


@REG.query(_VECTORS)
def s9_feature_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.round_trip(items(spark, sf_dir, "risk_score", "integrity_score", "file_size", "filename"), "parquet", shared_table(spark, "cache"))


@REG.query(mi("duration", "mime_type") + """, k AS (SELECT media_id, count(DISTINCT id) AS n FROM keyframes GROUP BY 1)
SELECT mi.id, CAST(floor(duration / 2) AS INT) + 1 AS expected, coalesce(k.n, 0) AS stored FROM mi LEFT JOIN k ON k.media_id = mi.id WHERE starts_with(mime_type, 'video/') AND duration >= 0""")
def s10_keyframe_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One frame every two seconds, as the demultiplexer would keep; decoding itself needs a codec."""
    k = table(spark, sf_dir, "keyframes").groupBy(F.col("media_id").alias("id")).agg(F.count_distinct("id").alias("stored"))
    v = items(spark, sf_dir, "duration", "mime_type").where(F.col("mime_type").startswith("video/") & (F.col("duration") >= 0))
    return v.join(k, "id", "left").select("id", (F.floor(F.col("duration") / 2).cast("int") + 1).alias("expected"), F.coalesce("stored", F.lit(0)).alias("stored"))


@REG.query(mi("filename", "mime_type") + """, t AS (SELECT *, CASE lower(regexp_extract(filename, '\\.([A-Za-z0-9]+)$', 1)) WHEN 'jpg' THEN 'image/jpeg' WHEN 'jpeg' THEN 'image/jpeg' WHEN 'png' THEN 'image/png' WHEN 'webp' THEN 'image/webp'
 WHEN 'tif' THEN 'image/tiff' WHEN 'tiff' THEN 'image/tiff' WHEN 'mp4' THEN 'video/mp4' WHEN 'mov' THEN 'video/quicktime' END AS told FROM mi)
SELECT told, mime_type, CASE WHEN told IS NULL THEN 'unsupported' WHEN told = mime_type THEN 'ok' ELSE 'mismatch' END AS outcome, count(*) AS n FROM t GROUP BY ALL""")
def s11_upload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = items(spark, sf_dir, "filename", "mime_type").withColumn("told", text.mime_class(F.col("filename")))
    outcome = F.when(F.col("told").isNull(), "unsupported").when(F.col("told") == F.col("mime_type"), "ok").otherwise("mismatch")
    return t.groupBy("told", "mime_type", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@REG.query("""WITH scans AS (SELECT DISTINCT media_id, 'Pending' AS status FROM keyframes WHERE media_id % 10 = 0), incoming AS (SELECT DISTINCT media_id, 'Running' AS status FROM keyframes WHERE media_id % 15 = 0)
SELECT coalesce(i.media_id, s.media_id) AS media_id, coalesce(i.status, s.status) AS status FROM scans s FULL JOIN incoming i ON i.media_id = s.media_id""")
def s16_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = table(spark, sf_dir, "keyframes").where("media_id is not null").select("media_id").distinct()
    return mutate.upsert(k.where("media_id % 10 = 0").withColumn("status", F.lit("Pending")), k.where("media_id % 15 = 0").withColumn("status", F.lit("Running")), "media_id")


@REG.query(mi() + """, d AS (SELECT media_id, count(DISTINCT deletion_id) AS n FROM media_deletions GROUP BY 1)
SELECT id, CASE WHEN d.n IS NULL THEN 'Not Started' ELSE 'Deleted' END AS status, coalesce(d.n, 0) AS n_deletions FROM mi LEFT JOIN d ON d.media_id = mi.id""")
def s17_default_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "media_deletions").groupBy(F.col("media_id").alias("id")).agg(F.count_distinct("deletion_id").alias("n"))
    return items(spark, sf_dir).join(d, "id", "left").select("id", F.when(F.col("n").isNull(), "Not Started").otherwise("Deleted").alias("status"), F.coalesce("n", F.lit(0)).alias("n_deletions"))


@REG.query(mi("phash", "filename") + " SELECT id, substr(md5(coalesce(phash, filename, '')), 1, 8) AS answer, TRUE AS simulated FROM mi")
def s18_simulated_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.coalesce("phash", "filename", F.lit(""))
    return items(spark, sf_dir, "phash", "filename").select("id", F.substring(F.md5(key), 1, 8).alias("answer"), F.lit(True).alias("simulated"))


@REG.query("""WITH a AS (SELECT DISTINCT ON (audit_id) audit_id, filepath FROM dataset_audit)
SELECT regexp_extract(filepath, '/(real|fake)/', 1) AS category, count(*) AS n FROM a GROUP BY 1""")
def s20_category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = table(spark, sf_dir, "dataset_audit").select("audit_id", "filepath").dropDuplicates(["audit_id"])
    return a.groupBy(F.regexp_extract("filepath", "/(real|fake)/", 1).alias("category")).agg(F.count(F.lit(1)).alias("n"))


# ---- filters and projections ----
@REG.query(mi("case_id", "cluster_id", "filename") + " SELECT id, cluster_id, filename FROM mi WHERE case_id = 17 AND cluster_id IS NOT NULL")
def f1_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir, "case_id", "cluster_id", "filename").where("case_id = 17 and cluster_id is not null").select("id", "cluster_id", "filename")


@REG.query(mi("case_id", "filename") + " SELECT id, case_id, filename FROM mi")
def f2_optional_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A filter that is not given doesn't narrow the scan; zero is a value, not its absence."""
    return files.optional(items(spark, sf_dir, "case_id", "filename"), case_id=None)


@REG.query(mi("filename", "sha256", "phash") + " SELECT id, filename FROM mi WHERE filename ILIKE '%harbor\\_%' ESCAPE '\\' OR sha256 ILIKE '%harbor\\_%' ESCAPE '\\' OR phash ILIKE '%harbor\\_%' ESCAPE '\\'")
def f3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir, "filename", "sha256", "phash").where(files.contains_any("harbor_", "filename", "sha256", "phash")).select("id", "filename")


@REG.query(mi("mime_type", "duration") + " SELECT id, mime_type, duration FROM mi WHERE starts_with(mime_type, 'video/')")
def f4_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir, "mime_type", "duration").where(F.col("mime_type").startswith("video/"))


@REG.query(mi("case_id", "risk_score") + " SELECT id, case_id, risk_score FROM mi WHERE case_id IN (3, 17, 40)")
def f5_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir, "case_id", "risk_score").where(F.col("case_id").isin(3, 17, 40))


@REG.query(mi("filename", "mime_type", "risk_score", "integrity_score", "width", "height") + """ SELECT id, filename, mime_type, risk_score, integrity_score,
CASE WHEN width > 0 AND height > 0 THEN width::VARCHAR || 'x' || height::VARCHAR END AS resolution FROM mi""")
def f6_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.when((F.col("width") > 0) & (F.col("height") > 0), F.concat_ws("x", "width", "height"))
    return items(spark, sf_dir, "filename", "mime_type", "risk_score", "integrity_score", "width", "height").select("id", "filename", "mime_type", "risk_score", "integrity_score", size.alias("resolution"))


@REG.query(mi("width", "height", "exif") + " SELECT id, coalesce(width, 0) AS width, coalesce(height, 0) AS height, coalesce(exif['Make'], 'unknown') AS make, coalesce(cardinality(exif), 0)::INT AS n_tags FROM mi")
def f7_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir, "width", "height", "exif")
    return d.select("id", F.coalesce("width", F.lit(0)).alias("width"), F.coalesce("height", F.lit(0)).alias("height"), F.coalesce(F.element_at("exif", "Make"), F.lit("unknown")).alias("make"), forensics.exif_count(F.col("exif")).alias("n_tags"))


@REG.query(mi("format", "exif", "risk_score", "width") + """, t AS (SELECT id, unnest(list_filter([CASE WHEN exif['Make'] IS NOT NULL THEN 'camera' END, CASE WHEN coalesce(cardinality(exif), 0) = 0 THEN 'stripped' END,
 CASE WHEN format = 'PNG' THEN 'lossless' END, CASE WHEN risk_score > 65 THEN 'risky' END, CASE WHEN width >= 3000 THEN 'large' END], lambda x: x IS NOT NULL)) AS category FROM mi)
SELECT category, count(*) AS n FROM t GROUP BY 1""")
def f8_multi_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir, "format", "exif", "risk_score", "width")
    labels = F.array_compact(F.array(F.when(F.element_at("exif", "Make").isNotNull(), "camera"), F.when(forensics.exif_count(F.col("exif")) == 0, "stripped"),
                                     F.when(F.col("format") == "PNG", "lossless"), F.when(F.col("risk_score") > 65, "risky"), F.when(F.col("width") >= 3000, "large")))
    return d.select(F.explode(labels).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@REG.query(mi("risk_score", "integrity_score") + """ SELECT CASE WHEN risk_score > 65 THEN 'Manipulated' WHEN risk_score > 35 THEN 'Suspicious' ELSE 'Authentic' END AS verdict, count(*) AS n, min(integrity_score) AS least_integrity FROM mi GROUP BY 1""")
def f9_rule_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir, "risk_score", "integrity_score").groupBy(forensics.verdict(F.col("risk_score")).alias("verdict")).agg(F.count(F.lit(1)).alias("n"), F.min("integrity_score").alias("least_integrity"))


@REG.query(mi("filename", "risk_score", "parent_id") + """ SELECT lower(regexp_extract(filename, '\\.([A-Za-z0-9]+)$', 1)) AS ext, (parent_id IS NOT NULL)::INT AS label, (risk_score > 35)::INT AS predicted, count(*) AS n FROM mi
WHERE lower(regexp_extract(filename, '\\.([A-Za-z0-9]+)$', 1)) IN ('jpg', 'jpeg') GROUP BY ALL""")
def f10_extension_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    ext = files.extension("filename")
    d = items(spark, sf_dir, "filename", "risk_score", "parent_id").where(ext.isin("jpg", "jpeg"))
    return d.groupBy(ext.alias("ext"), F.col("parent_id").isNotNull().cast("int").alias("label"), (F.col("risk_score") > 35).cast("int").alias("predicted")).agg(F.count(F.lit(1)).alias("n"))


@REG.query(mi("filename", "risk_score", "exif", "width", "height", "parent_id") + """ SELECT id, (parent_id IS NOT NULL)::INT AS label, risk_score, coalesce(cardinality(exif), 0)::INT AS exif_count,
contains(lower(filename), 'crop')::INT AS crop_detected, contains(lower(filename), 'resize')::INT AS resize_detected, contains(lower(filename), 'watermark')::INT AS watermark_detected,
CASE WHEN width IS NULL OR height IS NULL OR width <= 0 OR height <= 0 THEN 'no dimensions' END AS error FROM mi""")
def f11_feature_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = items(spark, sf_dir, "filename", "risk_score", "exif", "width", "height", "parent_id")
    flags = forensics.name_flags(F.col("filename"))
    bad = F.col("width").isNull() | F.col("height").isNull() | (F.col("width") <= 0) | (F.col("height") <= 0)
    return d.select("id", F.col("parent_id").isNotNull().cast("int").alias("label"), "risk_score", forensics.exif_count(F.col("exif")).alias("exif_count"), flags["cropped"].cast("int").alias("crop_detected"),
                    flags["resized"].cast("int").alias("resize_detected"), flags["watermarked"].cast("int").alias("watermark_detected"), F.when(bad, "no dimensions").alias("error"))
