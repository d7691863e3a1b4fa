"""Queries of problem 1."""

from __future__ import annotations

from .operators.references import dangling, dangling_counts, scene_references
from .util import table


def _found(spark, d):
    return dangling(*scene_references(table(spark, d, "cameras"), table(spark, d, "images"), table(spark, d, "sparse_points")))


def p1_found(spark, d):
    return _found(spark, d).select("src_field", "src_id", "ref_id", "ref_state")


def p1_counts(spark, d):
    return dangling_counts(_found(spark, d))


QUERIES = {"p1_found": p1_found, "p1_counts": p1_counts}

_FOUND = """
WITH st AS (
  SELECT 'cameras' AS t, camera_id::BIGINT AS k, min(loaded_at) AS since, max_by(deleted_at IS NOT NULL, loaded_at) AS del FROM cameras WHERE camera_id IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'images', image_id::BIGINT, min(loaded_at), max_by(deleted_at IS NOT NULL, loaded_at) FROM images WHERE image_id IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'sparse_points', point3d_id, min(loaded_at), max_by(deleted_at IS NOT NULL, loaded_at) FROM sparse_points WHERE point3d_id IS NOT NULL GROUP BY 2),
refs AS (
  SELECT DISTINCT 'images.camera_id' AS src_field, 'images' AS src_table, 'cameras' AS ref_table, image_id::BIGINT AS src_id, camera_id::BIGINT AS ref_id FROM images
  UNION SELECT DISTINCT 'images.points2d', 'images', 'sparse_points', image_id::BIGINT, p.point3d_id FROM (SELECT image_id, unnest(points2d) AS p FROM images)
  UNION SELECT DISTINCT 'sparse_points.track', 'sparse_points', 'images', point3d_id, p.image_id::BIGINT FROM (SELECT point3d_id, unnest(track) AS p FROM sparse_points)),
found AS (
  SELECT r.src_field, r.src_id, r.ref_table, r.ref_id, c.since,
    CASE WHEN p.k IS NULL THEN 'missing' WHEN p.del THEN 'deleted' WHEN p.since > c.since THEN 'late' END AS ref_state
  FROM refs r JOIN st c ON c.t = r.src_table AND c.k = r.src_id AND NOT c.del
  LEFT JOIN st p ON p.t = r.ref_table AND p.k = r.ref_id
  WHERE r.ref_id IS NOT NULL AND r.ref_id <> -1)
"""

ORACLES = {
    "p1_found": _FOUND + "SELECT src_field, src_id, ref_id, ref_state FROM found WHERE ref_state IS NOT NULL",
    "p1_counts": _FOUND
    + "SELECT src_field, ref_table, ref_state, strftime(since, '%Y-%m') AS month, count(*)::BIGINT AS n_refs, count(DISTINCT ref_id)::BIGINT AS n_keys FROM found WHERE ref_state IS NOT NULL GROUP BY ALL",
}
