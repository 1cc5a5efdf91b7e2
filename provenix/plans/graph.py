"""Clustering, lineage and streams (G of the inventory, and the natural reading of its asynchronous parts)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenix.functions import forensics
from provenix.operators import lineage
from provenix.plans.common import items, mi
from provenix.plans.joins import _SIDES, j6_chronology
from provenix.plans.registry import Registry
from provenix.sources.tables import table
from provenix.streaming import ingest

REG = Registry()

_G1 = mi("case_id").replace("WITH", "WITH RECURSIVE") + """, m AS (SELECT greatest(source_id, target_id) AS id, least(source_id, target_id) AS other, max(combined_score) AS score FROM media_relationships WHERE combined_score >= 0.58 AND source_id <> target_id GROUP BY 1, 2),
e AS (SELECT m.*, x.case_id FROM m JOIN mi x ON x.id = m.id JOIN mi y ON y.id = m.other AND y.case_id = x.case_id), b AS (SELECT id, other AS parent FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS rn FROM e) WHERE rn = 1),
w AS (SELECT id, id AS cur, 0 AS depth FROM mi UNION ALL SELECT w.id, b.parent, w.depth + 1 FROM w JOIN b ON b.id = w.cur), oc AS (SELECT id, cur AS cluster, depth FROM w WHERE cur NOT IN (SELECT id FROM b))
"""


def _rel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "media_relationships").select("source_id", "target_id", "combined_score")


@REG.query(_G1 + "SELECT oc.id, oc.cluster, b.parent AS parent_id, oc.depth::BIGINT AS depth FROM oc LEFT JOIN b ON b.id = oc.id")
def g1_g4_online_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.online_clusters(items(spark, sf_dir, "case_id"), _rel(spark, sf_dir))


_G2 = _G1 + """, x AS (SELECT e.id, e.case_id, e.score, a.cluster AS mine, o.cluster AS theirs, max(e.score) OVER (PARTITION BY e.id) AS confidence FROM e JOIN oc a ON a.id = e.id JOIN oc o ON o.id = e.other),
r AS (SELECT case_id, theirs AS source_cluster, mine AS target_cluster, confidence, row_number() OVER (PARTITION BY case_id, least(mine, theirs), greatest(mine, theirs) ORDER BY id, theirs, mine) AS rn FROM x WHERE mine <> theirs)
"""


@REG.query(_G2 + "SELECT case_id, source_cluster, target_cluster, confidence FROM r WHERE rn = 1")
def g2_merge_recommendations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.merge_recommendations(items(spark, sf_dir, "case_id"), _rel(spark, sf_dir))


@REG.query(_G2 + """, top AS (SELECT source_cluster, target_cluster FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY confidence DESC, source_cluster, target_cluster) AS k FROM r WHERE rn = 1) WHERE k = 1)
SELECT oc.id, coalesce(top.target_cluster, oc.cluster) AS cluster FROM oc LEFT JOIN top ON top.source_cluster = oc.cluster""")
def g3_approve_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most confident recommendation of each case carried out; a rejected one is simply not passed."""
    d, rel = items(spark, sf_dir, "case_id"), _rel(spark, sf_dir)
    r = lineage.merge_recommendations(d, rel)
    top = r.groupBy("case_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "source_cluster", "target_cluster")).alias("m")).select("m.source_cluster", "m.target_cluster", (-F.col("m.c")).alias("confidence"))
    return lineage.approve(lineage.online_clusters(d, rel).select("id", "cluster"), top)


@REG.query(_SIDES + """, e AS (SELECT source_id AS a, target_id AS b, score, dp FROM sg WHERE c1 = c2 AND k1 = k2 AND score IS NOT NULL),
o AS (SELECT x.id AS id, e.score, (x.width < y.width AND x.height < y.height AND x.width > 0) OR e.dp <= 8 AS ok FROM e JOIN it x ON x.id IN (e.a, e.b) JOIN it y ON y.id IN (e.a, e.b) AND y.id <> x.id WHERE y.created_at < x.created_at OR (y.created_at = x.created_at AND y.id < x.id)),
l AS (SELECT id, max(score) AS score FROM o WHERE ok GROUP BY 1), g AS (SELECT m.case_id, m.cluster_id, count(*) AS n_nodes, count(l.id) AS n_links, coalesce(trunc(avg(l.score) * 100)::INT, 10) AS confidence FROM mi m LEFT JOIN l ON l.id = m.id WHERE m.cluster_id IS NOT NULL GROUP BY 1, 2)
SELECT case_id, cluster_id, n_nodes, n_links, n_nodes - n_links AS n_unresolved, confidence, confidence < 40 OR n_links = 0 AS inconclusive, CASE WHEN n_nodes < 20 THEN 'full' WHEN n_nodes <= 100 THEN 'collapsible' ELSE 'summary' END AS graph_type FROM g""")
def g6_lineage_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lineage.payload(items(spark, sf_dir, "case_id", "cluster_id").where("cluster_id is not null"), j6_chronology(spark, sf_dir))


@REG.query(mi("mime_type") + " SELECT split_part(mime_type, '/', 2) AS subtype, count(*) AS n FROM mi GROUP BY 1")
def g7_by_subtype(spark: SparkSession, sf_dir: str) -> DataFrame:
    return items(spark, sf_dir, "mime_type").groupBy(F.split_part("mime_type", F.lit("/"), F.lit(2)).alias("subtype")).agg(F.count(F.lit(1)).alias("n"))


_RATIO = "[" + ", ".join(repr(r) for r in forensics.RATIOS) + "]::DOUBLE[]"
_SCREEN = " OR ".join(f"(greatest(width, height) = {a} AND least(width, height) = {b})" for a, b in forensics.SCREENS)
_CAM = " OR ".join(f"coalesce(trim(exif['{k}']) <> '', FALSE)" for k in ("Make", "Model", "LensModel", "DateTimeOriginal"))


@REG.query(mi("format", "exif", "width", "height", "parent_id") + f""", s AS (SELECT id, 15 * coalesce(upper(format) = 'PNG', FALSE)::INT + 20 * (NOT ({_CAM}))::INT + 15 * coalesce({_SCREEN}, FALSE)::INT
+ 10 * (width > 0 AND height > 0 AND len(list_filter({_RATIO}, lambda r: abs(width / height::DOUBLE - r) < 0.05 OR abs(height / width::DOUBLE - r) < 0.05)) > 0)::INT + 25 * (parent_id IS NOT NULL)::INT AS score FROM mi)
SELECT id, score, CASE WHEN score >= 60 THEN 'Likely Screenshot' WHEN score >= 30 THEN 'Possible Screenshot' ELSE 'Inconclusive' END AS status FROM s""")
def e20_screenshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    none = F.lit(None)
    size = lambda x: F.when((c("width") > 0) & (c("height") > 0), c(x))
    s = forensics.screenshot_score(c("format"), c("exif"), size("width"), size("height"), c("parent_id").isNotNull(), none.cast("boolean"), none.cast("int"))
    d = items(spark, sf_dir, "format", "exif", "width", "height", "parent_id").select("id", s.alias("score"))
    return d.select("id", "score", forensics.screenshot_band(c("score")).alias("status"))


@REG.query("WITH e AS (SELECT event_id, event_type, (props::JSON ->> '$.k')::INT AS k FROM events) SELECT event_type, count(*) AS n, sum(k)::BIGINT AS total, max(k) AS top FROM e GROUP BY 1")
def s12_nested_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a connector: JSON text taken apart by a schema, then aggregated."""
    e = table(spark, sf_dir, "events").select("event_type", F.from_json("props", "k int")["k"].alias("k"))
    return e.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("k").alias("total"), F.max("k").alias("top"))


@REG.query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1")
def s13_report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@REG.query("SELECT i + 1 AS id, 1 AS case_id, CASE WHEN i % 5 = 0 THEN 'original' ELSE ['cropped', 'resized', 'compressed', 'watermarked'][(i % 5)::INT] END AS kind, (i // 5)::INT AS family FROM range(15) r(i)")
def s14_seed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One case of three originals with four variants each."""
    kinds = F.array(*map(F.lit, ("original", "cropped", "resized", "compressed", "watermarked")))
    i = F.col("id")
    return spark.range(15).select((i + 1).alias("id"), F.lit(1).alias("case_id"), F.element_at(kinds, (i % 5 + 1).cast("int")).alias("kind"), F.expr("cast(id div 5 as int)").alias("family"))


@REG.query("SELECT unnest(['lens', 'visual', 'reverse', 'search']) AS provider, FALSE AS available, 'disabled' AS status")
def s19_providers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without keys every provider answers with a status record instead of rows."""
    p = spark.range(1).select(F.explode(F.array(*map(F.lit, ("lens", "visual", "reverse", "search")))).alias("provider"))
    return p.withColumns({"available": F.lit(False), "status": F.lit("disabled")})


@REG.query("SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2")
def st1_hourly_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.run_to_table(ingest.hourly(ingest.stream_table(spark, sf_dir, "events")), "complete", "hourly")
    return out.withColumn("hour", F.col("hour").cast("timestamp_ntz"))


@REG.query("SELECT case_id, count(DISTINCT id) AS n_items, max(risk_score) AS max_risk FROM media_items WHERE case_id IS NOT NULL AND risk_score IS NOT NULL AND id IS NOT NULL GROUP BY 1")
def st2_case_state_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Running totals per case as keyed state; a record delivered again counts once."""
    u = ingest.run_to_table(ingest.case_totals(ingest.stream_table(spark, sf_dir, "media_items")), "update", "cases")
    return ingest.latest(u.select("case_id", "n_items", "max_risk"), "case_id", "n_items")

