"""Header and grid queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelcohort.functions import closed_round
from voxelcohort.operators import geometry
from voxelcohort.plans.registry import query
from voxelcohort.plans.views import cte, table, view


def headers(spark, sf):
    """Header arrays derived from the supplier table; channel 0 is the reference."""
    wide = F.when((F.col("case_id") % 13 == 5) & (F.col("channel") == 3), 33).otherwise(32)
    return view(spark, sf, "hdr").select(
        "case_id", "channel",
        F.array(F.lit(16), F.lit(32), wide).alias("shape"),
        F.array(F.col("sp"), F.col("sp"), F.lit(2.0)).alias("spacing"),
        F.array(F.lit(0.0), F.col("case_id") * 1.0, F.lit(-5.0)).alias("origin"),
        F.array(F.lit(1.0), F.col("skew"), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)).alias("direction"),
        F.array(
            F.col("sp"), F.col("skew"), F.lit(0.0), F.lit(0.0),
            F.lit(0.0), F.col("sp"), F.lit(0.0), F.col("case_id") * 1.0,
            F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(-5.0),
            F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0),
        ).alias("affine"),
    )


MATCH_SQL = cte("hdr") + """,
m AS (SELECT case_id, channel, NOT (case_id % 13 = 5 AND channel = 3) AS same_size, abs(skew) AS max_delta,
  NOT (case_id % 13 = 5 AND channel = 3) AND abs(skew) <= 2e-5 AS matches FROM hdr)"""


@query("geometry_matches", MATCH_SQL + " SELECT case_id, channel, same_size, matches, round(max_delta, 9) AS max_delta FROM m")
def geometry_matches(spark, sf):
    out = geometry.geometry_matches(headers(spark, sf), 0, geometry.COHORT_2024_ATOL)
    return out.withColumn("max_delta", closed_round(F.col("max_delta"), 9))


@query("geometry_summary", MATCH_SQL + """
SELECT channel, count(*) AS cases, count(*) FILTER (matches) AS cases_matching FROM m GROUP BY channel""")
def geometry_summary(spark, sf):
    return geometry.geometry_summary(geometry.geometry_matches(headers(spark, sf), 0, geometry.COHORT_2024_ATOL))


@query("presence_counters", """
SELECT 'dwi' AS file, count(*) FILTER (o_orderstatus = 'F') AS cases FROM orders
UNION ALL SELECT 'adc', count(*) FILTER (o_totalprice > 100000) FROM orders
UNION ALL SELECT 'lesion', count(*) FILTER (o_custkey % 3 = 0) FROM orders""")
def presence_counters(spark, sf):
    cases = table(spark, sf, "orders").selectExpr(
        "if(o_orderstatus = 'F', 'f', null) as dwi", "if(o_totalprice > 100000, 'f', null) as adc",
        "if(o_custkey % 3 = 0, 'f', null) as lesion")
    return geometry.presence_counters(cases, ["dwi", "adc", "lesion"])


@query("stage_gate", MATCH_SQL + """,
n AS (SELECT case_id, channel FROM hdr UNION ALL SELECT DISTINCT case_id, 5 FROM hdr),
p AS (SELECT n.case_id, CASE WHEN m.matches IS NULL OR (n.case_id % 11 = 6 AND n.channel = 2) THEN n.channel || ':missing'
  WHEN NOT m.matches THEN CAST(n.channel AS VARCHAR) END AS problem
  FROM n LEFT JOIN m ON m.case_id = n.case_id AND m.channel = n.channel)
SELECT case_id, string_agg(problem, ',' ORDER BY problem) AS problems FROM p WHERE problem IS NOT NULL GROUP BY case_id""")
def stage_gate(spark, sf):
    present = headers(spark, sf).where("not (case_id % 11 = 6 and channel = 2)")
    return geometry.stage_gate(present, range(6), 0, geometry.COHORT_2024_ATOL)


@query("channel_gate", """
WITH r AS (SELECT o_custkey AS request, CASE o_orderpriority WHEN '1-URGENT' THEN 'ncct' WHEN '2-HIGH' THEN 'tmax'
  WHEN '3-MEDIUM' THEN 'cbf' WHEN '4-NOT SPECIFIED' THEN NULL ELSE 'dwi_followup' END AS channel FROM orders),
p AS (SELECT request, channel, count(*) AS n FROM r WHERE channel IS NOT NULL GROUP BY ALL)
SELECT 'no_channels' AS "check", CAST(request AS VARCHAR) AS key, '' AS detail FROM r GROUP BY request HAVING count(channel) = 0
UNION ALL SELECT 'channel_repeated', request || '/' || channel, CAST(n AS VARCHAR) FROM p WHERE n > 1
UNION ALL SELECT 'channel_not_allowed', request || '/' || channel, '' FROM p WHERE channel = 'dwi_followup'""")
def channel_gate(spark, sf):
    requested = table(spark, sf, "orders").selectExpr(
        "o_custkey as request",
        "case o_orderpriority when '1-URGENT' then 'ncct' when '2-HIGH' then 'tmax' when '3-MEDIUM' then 'cbf' "
        "when '4-NOT SPECIFIED' then null else 'dwi_followup' end as channel")
    return geometry.channel_gate(requested, ["ncct", "tmax", "cbf", "cbv", "mtt"])


@query("header_violations", """
WITH h AS (SELECT p_partkey AS id, p_size, p_retailprice AS price FROM part)
SELECT 'dimension_too_small' AS "check", id || '/ncct' AS key, CAST(p_size AS VARCHAR) AS detail FROM h WHERE p_size < 8
UNION ALL SELECT 'spacing_not_finite', id || '/ncct', '' FROM h WHERE id % 19 = 4
UNION ALL SELECT 'spacing_not_positive', id || '/ncct', '' FROM h WHERE id % 19 <> 4 AND id % 23 = 1
UNION ALL SELECT 'affine_not_finite', id || '/ncct', '' FROM h WHERE id % 29 = 2
UNION ALL SELECT 'affine_singular', id || '/ncct', '' FROM h WHERE id % 29 <> 2 AND id % 31 = 3
UNION ALL SELECT 'not_3d', id || '/ncct', '4' FROM h WHERE id % 37 = 6""")
def header_violations(spark, sf):
    h = table(spark, sf, "part").selectExpr(
        "p_partkey as case_id", "'ncct' as channel",
        "if(p_partkey % 37 = 6, array(64, 64, p_size, 8), array(64, 64, p_size)) as shape",
        "array(1D, if(p_partkey % 19 = 4, double('NaN'), if(p_partkey % 23 = 1, 0D, 2D)), p_retailprice) as spacing",
        "array(1D, 0D, 0D, if(p_partkey % 29 = 2, double('Infinity'), 4D), 0D, if(p_partkey % 31 = 3, 0D, 2D), 0D, 1D, "
        "0D, 0D, p_retailprice, 1D, 0D, 0D, 0D, 1D) as affine")
    return geometry.header_violations(h)


@query("canonicalize_label_headers", cte("hdr") + """
SELECT case_id, channel, round(sp, 6) AS spacing_y, CAST(0 AS DOUBLE) AS skew FROM hdr
WHERE channel > 0 AND NOT (case_id % 13 = 5 AND channel = 3)""")
def canonicalize_label_headers(spark, sf):
    h = headers(spark, sf)
    fixed, _ = geometry.canonicalize_label_headers(h.where("channel > 0"), h.where("channel = 0"))
    return fixed.select("case_id", "channel", closed_round(F.col("spacing")[1]).alias("spacing_y"), F.col("direction")[1].alias("skew"))


@query("label_size_violations", cte("hdr") + """
SELECT 'label_size' AS "check", CAST(case_id AS VARCHAR) AS key, '16x32x33' AS detail FROM hdr WHERE case_id % 13 = 5 AND channel = 3""")
def label_size_violations(spark, sf):
    h = headers(spark, sf)
    return geometry.canonicalize_label_headers(h.where("channel > 0"), h.where("channel = 0"))[1]


def grid_shapes(spark, sf):
    return view(spark, sf, "vox3").groupBy("case_id").agg(
        (F.max("z") + 1).alias("depth"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"))


BBOX_SQL = cte("vox3") + """,
b AS (SELECT case_id, min(z) AS z_min, max(z) AS z_max, min(y) AS y_min, max(y) AS y_max, min(x) AS x_min, max(x) AS x_max, count(*) AS n_support
  FROM vox3 WHERE ref GROUP BY case_id)"""


@query("support_bbox", BBOX_SQL + " SELECT * FROM b")
def support_bbox(spark, sf):
    return geometry.support_bbox(view(spark, sf, "vox3").where("ref"))


@query("roi_crop", BBOX_SQL + """,
s AS (SELECT case_id, max(z) + 1 AS d, max(y) + 1 AS h, max(x) + 1 AS w FROM vox3 GROUP BY case_id),
r AS (SELECT b.case_id, greatest(0, least((z_min + z_max) // 2 - least(d, 5) // 2, d - least(d, 5))) AS z0, least(d, 5) AS zl,
  greatest(0, least((y_min + y_max) // 2 - least(h, 4) // 2, h - least(h, 4))) AS y0, least(h, 4) AS yl,
  greatest(0, least((x_min + x_max) // 2 - least(w, 20) // 2, w - least(w, 20))) AS x0, least(w, 20) AS xl
  FROM b JOIN s ON b.case_id = s.case_id WHERE n_support >= 16)
SELECT v.case_id, z - z0 AS z, y - y0 AS y, x - x0 AS x, ncct FROM vox3 v JOIN r ON v.case_id = r.case_id
WHERE z >= z0 AND z < z0 + zl AND y >= y0 AND y < y0 + yl AND x >= x0 AND x < x0 + xl""")
def roi_crop(spark, sf):
    voxels = view(spark, sf, "vox3")
    bbox = geometry.support_bbox(voxels.where("ref"))
    roi = geometry.roi_starts(bbox, grid_shapes(spark, sf), (5, 4, 20), min_support=16)
    return geometry.roi_crop(voxels.select("case_id", "z", "y", "x", "ncct"), roi)


@query("shift_affine", cte("hdr") + """
SELECT case_id, channel, round(sp * (case_id % 3) + skew * 2, 6) AS t0, round(case_id + sp * 2, 6) AS t1,
  round(CAST(-5 AS DOUBLE) + 2 * (case_id % 5), 6) AS t2 FROM hdr""")
def shift_affine(spark, sf):
    starts = F.array(F.col("case_id") % 3, F.lit(2).cast("long"), F.col("case_id") % 5)
    out = geometry.shift_affine(headers(spark, sf), starts)
    return out.select("case_id", "channel", *[closed_round(F.col("affine")[4 * i + 3]).alias(f"t{i}") for i in range(3)])


@query("storage_estimate", """
WITH t AS (SELECT count(*) AS cases, CAST(sum(64 * 64 * p_size) * 5 * 6 * 4 AS BIGINT) AS image_bytes,
  CAST(sum(p_partkey * 8) * 8 AS BIGINT) AS label_bytes FROM part)
SELECT *, image_bytes + label_bytes AS combined_bytes, (image_bytes + label_bytes) * 2 AS reserved_bytes,
  image_bytes // 5 + label_bytes // 4 AS per_fold_bytes, (image_bytes // 5 + label_bytes // 4) * 2 AS per_fold_reserved_bytes,
  image_bytes % 5 = 0 AND label_bytes % 4 = 0 AS divisible FROM t""")
def storage_estimate(spark, sf):
    h = table(spark, sf, "part").selectExpr("array(64, 64, p_size) as shape", "p_partkey * 8 as label_bytes")
    return geometry.storage_estimate(h)
