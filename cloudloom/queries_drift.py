"""Queries of problem 3."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators.drift import changes, consistent, files, lineage, type_statistics, vertex_maps
from .util import cut, table

#: Fields of the consistent vertex table that get a column of their own type; all others stay in the map ``rest``.
FLOATS = ["x", "y", "z", "opacity", "f_dc_0", "f_dc_1", "f_dc_2", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]
WHOLE = ["red", "green", "blue"]


def _inputs(spark, d):
    return cut(files(table(spark, d, "ply_files"))), table(spark, d, "ply_vertices")


def _long(spark, d):
    fs, vertices = _inputs(spark, d)
    return consistent(vertex_maps(vertices, fs), lineage(fs, cut(changes(fs, vertices))))


def p3_found(spark, d):
    return changes(*_inputs(spark, d)).select("file_id", "change_kind", "old_field", "new_field")


def p3_types(spark, d):
    fs, vertices = _inputs(spark, d)
    return type_statistics(vertex_maps(vertices, fs), fs).withColumns({c: F.round(c, 4) for c in ("min_value", "max_value")})


def p3_vertices(spark, d):
    """The consistent table: one row a vertex, typed columns, other fields in a map."""
    one = _long(spark, d).groupBy("file_id", "vertex_idx").agg(F.map_from_entries(F.collect_list(F.struct("path", "value"))).alias("m"))
    at = lambda c, kind: F.try_element_at("m", F.lit(c)).cast(kind).alias(c)
    return one.select("file_id", "vertex_idx", *[at(c, "double") for c in FLOATS], *[at(c, "int") for c in WHOLE], F.map_filter("m", lambda k, _: ~k.isin(FLOATS + WHOLE)).alias("rest"))


def p3_casts(spark, d):
    """Per file and path: the lineage's type, its values, and those that could not be cast to it."""
    return _long(spark, d).groupBy("file_id", "path", "kind").agg(F.count("*").alias("n_values"), F.count_if("failed").alias("n_failed"))


def p3_change_counts(spark, d):
    return changes(*_inputs(spark, d)).groupBy("change_kind", "new_type").agg(F.count("*").alias("n_changes"), F.countDistinct("file_id").alias("n_files"))


QUERIES = {"p3_found": p3_found, "p3_types": p3_types, "p3_vertices": p3_vertices, "p3_casts": p3_casts, "p3_change_counts": p3_change_counts}
ORACLES = {
    "p3_types": " ".join(
        r"""WITH f AS (SELECT file_id, ply_header AS h FROM ply_files WHERE file_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY loaded_at DESC NULLS LAST, ply_header DESC NULLS LAST)=1),
 b AS (SELECT file_id, regexp_extract(h, '(?ms)^\s*element\s+vertex\b[^\r\n]*[\r\n]+(.*?)(?:^\s*element\b|^\s*end_header\b|\z)', 1) AS blk FROM f),
 p AS (SELECT file_id, unnest(regexp_extract_all(blk, '(?m)^[ \t]*property[ \t]+(\S.*?)[ \t]+(\S+)[ \t]*\r?$', 2)) AS field, lower(unnest(regexp_extract_all(blk, '(?m)^[ \t]*property[ \t]+(\S.*?)[ \t]+(\S+)[ \t]*\r?$', 1))) AS t, generate_subscripts(regexp_extract_all(blk, '(?m)^[ \t]*property[ \t]+(\S.*?)[ \t]+(\S+)[ \t]*\r?$', 2), 1) AS pos FROM b),
 ty AS (SELECT file_id, field, pos, CASE t WHEN 'int8' THEN 'char' WHEN 'uint8' THEN 'uchar' WHEN 'int16' THEN 'short' WHEN 'uint16' THEN 'ushort' WHEN 'int32' THEN 'int' WHEN 'uint32' THEN 'uint' WHEN 'float32' THEN 'float' WHEN 'float64' THEN 'double' ELSE t END AS type FROM p QUALIFY row_number() OVER (PARTITION BY file_id, field ORDER BY pos)=1),
 v AS (SELECT file_id, vertex_idx, string_split_regex(trim(regexp_replace(max(record_text),'\s+',' ','g')),' ') AS w FROM ply_vertices WHERE record_text IS NOT NULL GROUP BY ALL),
 l AS (SELECT v.file_id, field, type, w[pos] AS txt FROM v JOIN ty USING (file_id) WHERE pos <= len(w)), n AS (SELECT *, lower(trim(txt)) IN ('','na','n/a','nan','null','none','-') AS miss, CASE WHEN lower(replace(txt,',','.')) IN ('','na','n/a','nan','null','none','-') THEN NULL ELSE try_cast(replace(txt,',','.') AS DOUBLE) END AS x FROM l),
 r AS (SELECT * FROM (VALUES ('char',-128,127),('uchar',0,255),('short',-32768,32767),('ushort',0,65535),('int',-2147483648,2147483647),('uint',0,4294967295)) t(type,lo,hi))
 SELECT file_id, field, type, count(*)::BIGINT AS n_values, sum(miss::INT)::BIGINT AS n_missing, sum((NOT miss AND (x IS NULL OR (lo IS NOT NULL AND (x<>floor(x) OR x<lo OR x>hi))))::INT)::BIGINT AS n_failed_cast, round(min(x),4) AS min_value, round(max(x),4) AS max_value FROM n LEFT JOIN r USING (type) GROUP BY file_id, field, type""".split()
    )
}
