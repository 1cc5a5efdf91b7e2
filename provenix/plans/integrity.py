"""Queries on hierarchies (p2) and on references that do not hold (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provenix.operators import hierarchy, references
from provenix.plans.registry import Registry
from provenix.sources.tables import table

REG = Registry()

_LINKS = """
WITH RECURSIVE one AS (
  SELECT id, min(parent_id) AS parent_id, min(estimated_origin_id) AS guess FROM media_items WHERE id IS NOT NULL GROUP BY id
), links AS (
  SELECT a.id AS node, coalesce(a.parent_id, CASE WHEN a.guess <> a.id THEN a.guess END) AS parent FROM one a
), present AS (
  SELECT l.node, l.parent FROM links l JOIN one o ON o.id = l.parent
), walk AS (
  SELECT node, parent AS cur, [node] AS seen, FALSE AS ring FROM present
  UNION ALL
  SELECT w.node, p.parent, list_append(w.seen, w.cur), list_contains(w.seen, w.cur) FROM walk w JOIN present p ON p.node = w.cur WHERE NOT w.ring
), ends AS (
  SELECT node, cur, seen FROM walk w WHERE NOT ring AND cur NOT IN (SELECT node FROM present)
), rings AS (
  SELECT node, seen[len(seen)] AS hit, seen FROM walk WHERE ring
), solved AS (
  SELECT node, cur AS root, len(seen) AS depth, 'tree' AS status, list_reverse(list_append(seen, cur)) AS path FROM ends
  UNION ALL
  SELECT node, list_min(seen[list_position(seen, hit):]), NULL, CASE WHEN list_position(seen, hit) = 1 THEN 'cycle' ELSE 'below_cycle' END, NULL FROM rings
)
"""


@REG.query(_LINKS + "SELECT node AS media_id, root AS root_id FROM solved")
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = hierarchy.cut(hierarchy.media_links(table(spark, sf_dir, "media_items")))
    return hierarchy.resolve(links).select(F.col("node").alias("media_id"), F.col("root").alias("root_id"))


@REG.query(_LINKS + """, down AS (
  SELECT anc AS node, count(*) AS n FROM (SELECT unnest(path[:len(path) - 1]) AS anc FROM solved WHERE status = 'tree') GROUP BY 1
), low AS (
  SELECT anc AS node, count(*) AS n FROM (
    SELECT unnest(seen[2:list_position(seen, hit) - 1]) AS anc FROM rings WHERE list_position(seen, hit) > 1) GROUP BY 1
)
SELECT o.id AS media_id, p.parent AS parent_id, coalesce(s.root, o.id) AS root_id,
       CASE WHEN s.node IS NULL THEN 0 ELSE s.depth END AS depth,
       CASE WHEN s.node IS NULL THEN o.id::VARCHAR ELSE array_to_string(s.path, '/') END AS path,
       coalesce(s.status, 'root') AS status,
       CASE WHEN s.status = 'cycle' THEN NULL ELSE coalesce(d.n, w.n, 0) END AS n_descendants
FROM one o LEFT JOIN solved s ON s.node = o.id LEFT JOIN present p ON p.node = o.id
LEFT JOIN down d ON d.node = o.id LEFT JOIN low w ON w.node = o.id""")
def p2_hierarchy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, sf_dir, "media_items"))


@REG.query(_LINKS + """SELECT path[i] AS ancestor_id, node AS descendant_id, (len(path) - i)::BIGINT AS distance, FALSE AS over_cycle
FROM (SELECT node, path, unnest(range(1, len(path))) AS i FROM solved WHERE status = 'tree')
UNION ALL SELECT seen[i], node, i - 1, FALSE FROM (SELECT node, seen, unnest(range(2, list_position(seen, hit))) AS i FROM rings WHERE list_position(seen, hit) > 2)
UNION ALL SELECT root, node, NULL, TRUE FROM solved WHERE status <> 'tree' AND root <> node""")
def p2_descendants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hierarchy.descendants(table(spark, sf_dir, "media_items"))


_BAD = """
WITH m AS (SELECT id, min(ingested_at) AS since FROM media_items GROUP BY id),
gone AS (SELECT DISTINCT media_id FROM media_deletions WHERE restored_at IS NULL),
refs AS (
  SELECT ref_table, ref_column, row_id, k, min(t_at) AS t_at FROM (
    SELECT 'media_relationships' AS ref_table, 'source_id' AS ref_column, id AS row_id, source_id AS k, created_at AS t_at FROM media_relationships
    UNION ALL SELECT 'media_relationships', 'target_id', id, target_id, created_at FROM media_relationships
    UNION ALL SELECT 'keyframes', 'media_id', id, media_id, extracted_at FROM keyframes) WHERE k IS NOT NULL GROUP BY ALL
), bad AS (
  SELECT r.*, m.id IS NULL AS missing, g.media_id IS NOT NULL AS deleted, coalesce(m.since > r.t_at, FALSE) AS later
  FROM refs r LEFT JOIN m ON m.id = r.k LEFT JOIN gone g ON g.media_id = r.k
  WHERE m.id IS NULL OR g.media_id IS NOT NULL OR m.since > r.t_at
)
"""


def _bad(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.media_orphans(*(table(spark, sf_dir, t) for t in ("media_items", "media_deletions", "media_relationships", "keyframes")))


@REG.query(_BAD + "SELECT ref_table, ref_column, row_id FROM bad")
def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bad(spark, sf_dir).select("ref_table", "ref_column", "row_id")


@REG.query(_BAD + """SELECT ref_table, ref_column, strftime(t_at, '%Y-%m') AS month, count(*) AS n_bad, count_if(missing)::BIGINT AS n_missing,
count_if(deleted)::BIGINT AS n_deleted, count_if(later)::BIGINT AS n_later FROM bad GROUP BY ALL""")
def p5_orphans_by_month(spark: SparkSession, sf_dir: str) -> DataFrame:
    return references.by_month(_bad(spark, sf_dir))
