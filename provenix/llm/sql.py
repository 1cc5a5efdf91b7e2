"""SQL of the training-data queries that SQL can answer on whole tables of the smaller sizes, by comparing all rows."""

from __future__ import annotations

_BITS = "CASE WHEN regexp_full_match(trim({0}), '[0-9A-Fa-f]{{16}}') THEN ('0x' || trim({0}))::UBIGINT END"

_NAME = "regexp_replace(lower(trim(replace(filename, '%20', ' '))), '(\\s*\\.(jpe?g|png|webp|gif|tiff?|bmp|bak))+$', '')"
_NAME = f"regexp_replace(trim({_NAME}), '[\\s_\\-]+', '_', 'g')"
_NAME = f"regexp_replace({_NAME}, '^((copy_of|thumb)_)+', '')"
_NAME = f"regexp_replace({_NAME}, '(_(copy|edited|resized|\\(\\d+\\)|\\d+px|q\\d+|src_[a-z]+))+$', '')"

_P1 = f"""WITH raw AS (SELECT DISTINCT ON (audit_id) *, lower(regexp_replace(split, '\\s+', '', 'g')) AS said, lower(trim(regexp_extract(filepath, '^[^/]*/[^/]*/([^/]*)/', 1))) AS folder FROM dataset_audit WHERE audit_id IS NOT NULL),
a AS (SELECT audit_id AS id, nullif(lower(trim(sha256)), '') AS sha, {_BITS.format('phash')} AS p, nullif({_NAME}, '') AS name, width, height, lower(regexp_replace(trim(source), '-', '_', 'g')) AS source,
 CASE WHEN split IS NOT NULL THEN said WHEN starts_with(folder, 'train') THEN 'train' WHEN starts_with(folder, 'val') THEN 'val' WHEN starts_with(folder, 'test') THEN 'test' END AS part FROM raw),
f AS (SELECT x.id AS a, y.id AS b, coalesce(x.sha = y.sha, FALSE) AS same, coalesce(bit_count(xor(x.p, y.p)) <= 6, FALSE) AS near, coalesce((x.p IS NULL OR y.p IS NULL) AND x.width = y.width AND x.height = y.height AND x.name = y.name, FALSE) AS named
 FROM a x JOIN a y ON x.part = 'train' AND y.part IN ('val', 'test') WHERE x.sha = y.sha OR bit_count(xor(x.p, y.p)) <= 6 OR ((x.p IS NULL OR y.p IS NULL) AND x.width = y.width AND x.height = y.height AND x.name = y.name))
"""

P1 = _P1 + "SELECT least(a, b) AS id_a, greatest(a, b) AS id_b FROM f"

P1_REPORT = _P1 + """, e AS (SELECT b, count(*) AS n, sum(same::INT) AS s, sum(near::INT) AS d, sum(named::INT) AS m FROM f GROUP BY 1)
SELECT a.part AS split, a.source, count(*) AS n_records, count(e.n) AS n_overlapping, coalesce(sum(e.n), 0)::BIGINT AS n_pairs, coalesce(sum(e.s), 0)::BIGINT AS n_sha, coalesce(sum(e.d), 0)::BIGINT AS n_near, coalesce(sum(e.m), 0)::BIGINT AS n_name
FROM a LEFT JOIN e ON e.b = a.id WHERE a.part IN ('val', 'test') GROUP BY 1, 2"""

P4 = f"""WITH a AS (SELECT DISTINCT ON (id) id, batch_id, nullif(lower(trim(sha256)), '') AS sha, {_BITS.format('phash')} AS p, {_BITS.format('dhash')} AS d FROM media_items WHERE id IS NOT NULL)
SELECT x.id AS id_a, y.id AS id_b FROM a x JOIN a y ON x.id < y.id AND x.batch_id <> y.batch_id WHERE x.sha = y.sha OR (bit_count(xor(x.p, y.p)) <= 6 AND bit_count(xor(x.d, y.d)) <= 6)"""

_NEAR = """WITH v AS (SELECT DISTINCT ON (id) id, embedding AS e FROM media_items WHERE id IS NOT NULL AND len(embedding) = 64),
u AS (SELECT id, e FROM v WHERE len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
n AS (SELECT x.id AS a, y.id AS b, round(list_cosine_similarity(x.e, y.e), 9) AS c FROM u x JOIN u y ON x.id <> y.id WHERE list_cosine_similarity(x.e, y.e) >= 0.8999)
"""

P6 = _NEAR + """, r AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM n WHERE c >= 0.90) SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM r WHERE k <= 5"""

P3 = _NEAR + "SELECT a AS media_id, least(a, min(b)) AS group_id FROM n WHERE c >= 0.90 GROUP BY a"

_P7 = """WITH RECURSIVE m AS (SELECT DISTINCT id, case_id, cluster_id FROM media_items WHERE id IS NOT NULL),
e0 AS (SELECT source_id AS a, target_id AS b FROM media_relationships WHERE combined_score >= 0.58 AND source_id IN (SELECT id FROM m) AND target_id IN (SELECT id FROM m)
 UNION SELECT id, min(id) OVER (PARTITION BY case_id, cluster_id) FROM m WHERE case_id IS NOT NULL AND cluster_id IS NOT NULL),
e AS (SELECT a, b FROM e0 WHERE a <> b UNION SELECT b, a FROM e0 WHERE a <> b), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b),
g AS (SELECT a AS media_id, min(b) AS group_id FROM r GROUP BY a)
"""

P7 = _P7 + "SELECT media_id, group_id FROM g"

P7_REPORT = _P7 + """SELECT group_id, count(*) AS n_items, count(DISTINCT coalesce(case_id, -1)) AS n_cases, count(DISTINCT CASE WHEN cluster_id IS NOT NULL THEN coalesce(case_id, -1)::VARCHAR || ':' || cluster_id END) AS n_stored_clusters, count_if(cluster_id IS NULL) AS n_without_cluster FROM g JOIN m ON m.id = g.media_id GROUP BY 1"""
