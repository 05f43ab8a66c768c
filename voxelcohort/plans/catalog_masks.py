"""Component, mask and morphology queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelcohort.functions import closed_round
from voxelcohort.operators import components, masks
from voxelcohort.plans.registry import query
from voxelcohort.plans.views import cte, table, view


def recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def reach_sql(name: str, source: str, near: str) -> str:
    """Reachability of every voxel pair of one component; the smallest k names it."""
    return f"""{name}_r(case_id, s, z, y, x, k) AS (
  SELECT case_id, k, z, y, x, k FROM {source}
  UNION SELECT r.case_id, r.s, n.z, n.y, n.x, n.k FROM {name}_r r JOIN {source} n ON n.case_id = r.case_id AND {near}),
{name} AS (SELECT case_id, s AS k, min(k) AS label FROM {name}_r GROUP BY case_id, s)"""


NEAR26 = "abs(n.z - r.z) <= 1 AND abs(n.y - r.y) <= 1 AND abs(n.x - r.x) <= 1"
NEAR18 = NEAR26 + " AND abs(n.z - r.z) + abs(n.y - r.y) + abs(n.x - r.x) <= 2"
NEAR6 = "abs(n.z - r.z) + abs(n.y - r.y) + abs(n.x - r.x) <= 1"


def components_sql(near: str) -> str:
    return recursive(cte("vox3")) + f""", fg AS (SELECT case_id, z, y, x, k FROM vox3 WHERE ref),
{reach_sql("lab", "fg", near)}
SELECT lab.case_id, v.z, v.y, v.x, voxels FROM (SELECT case_id, label, count(*) AS voxels FROM lab GROUP BY ALL) lab JOIN vox3 v ON v.k = lab.label"""


def _component_query(connectivity):
    def run(spark, sf):
        labels = components.label_components(view(spark, sf, "vox3").where("ref"), connectivity)
        return components.component_table(labels).drop("component")
    return run


for _n, _near in ((26, NEAR26), (18, NEAR18), (6, NEAR6)):
    query(f"label_components_{_n}", components_sql(_near))(_component_query(_n))


@query("label_components_2d", recursive(cte("img2")) + """, fg AS (SELECT case_id, 0 AS z, "row" AS y, col AS x, "row" * 16 + col AS k FROM img2 WHERE label),
""" + reach_sql("lab", "fg", NEAR26) + """
SELECT case_id, label // 16 AS "row", label % 16 AS col, count(*) AS voxels FROM lab GROUP BY case_id, label""")
def label_components_2d(spark, sf):
    mask = view(spark, sf, "img2").where("label").selectExpr("case_id", "0L as z", "row as y", "col as x")
    return components.component_table(components.label_components(mask, 8)).selectExpr(
        "case_id", "y as row", "x as col", "voxels")


HOLES_SQL = """
bgbox AS (SELECT case_id, min(z) - 1 AS z0, max(z) + 1 AS z1, min(y) - 1 AS y0, max(y) + 1 AS y1, min(x) - 1 AS x0, max(x) + 1 AS x1 FROM {fg} GROUP BY case_id),
cells AS (SELECT case_id, z, y, x, z0, z1, y0, y1, x0, x1, ((z + 1) * 16 + y + 1) * 16 + x + 1 AS k
  FROM (SELECT *, unnest(range(y0, y1 + 1)) AS y FROM (SELECT *, unnest(range(z0, z1 + 1)) AS z FROM bgbox)) q, range(-1, 9) t(x)
  WHERE x BETWEEN x0 AND x1),
bg AS (SELECT c.* FROM cells c LEFT JOIN {fg} f ON f.case_id = c.case_id AND f.z = c.z AND f.y = c.y AND f.x = c.x WHERE f.k IS NULL),
outside(case_id, z, y, x, k) AS (
  SELECT case_id, z, y, x, k FROM bg WHERE z IN (z0, z1) OR y IN (y0, y1) OR x IN (x0, x1)
  UNION SELECT n.case_id, n.z, n.y, n.x, n.k FROM outside r JOIN bg n ON n.case_id = r.case_id AND """ + NEAR6 + """),
holes AS (SELECT bg.case_id, bg.z, bg.y, bg.x FROM bg LEFT JOIN outside o ON o.case_id = bg.case_id AND o.k = bg.k WHERE o.k IS NULL)"""


@query("fill_holes", recursive(cte("vox3")) + """, fg AS (SELECT case_id, z, y, x, k FROM vox3 WHERE ncct > -500),
""" + HOLES_SQL.replace("{fg}", "fg") + """
SELECT case_id, z, y, x FROM fg UNION ALL SELECT case_id, z, y, x FROM holes""")
def fill_holes(spark, sf):
    return components.fill_holes(view(spark, sf, "vox3").where("ncct > -500"))


HEAD_SQL = recursive(cte("vox3")) + """, env AS (SELECT case_id, z, y, x, k FROM vox3 WHERE ncct > -500),
""" + reach_sql("lab", "env", NEAR6) + """,
big AS (SELECT case_id, arg_min(label, (-n, label)) AS label FROM (SELECT case_id, label, count(*) AS n FROM lab GROUP BY ALL) GROUP BY case_id),
main AS (SELECT e.* FROM env e JOIN lab ON lab.case_id = e.case_id AND lab.k = e.k JOIN big ON big.case_id = lab.case_id AND big.label = lab.label),
""" + HOLES_SQL.replace("{fg}", "main") + """,
head AS (SELECT case_id, z, y, x FROM main UNION ALL SELECT case_id, z, y, x FROM holes),
support AS (SELECT v.* FROM vox3 v JOIN head h ON h.case_id = v.case_id AND h.z = v.z AND h.y = v.y AND h.x = v.x WHERE v.ncct BETWEEN -100 AND 150)"""


def ncct_of(spark, sf):
    return view(spark, sf, "vox3").selectExpr("case_id", "z", "y", "x", "ncct as value")


@query("head_support", HEAD_SQL + """,
shp AS (SELECT case_id, max(z) + 1 AS depth, max(y) + 1 AS height, max(x) + 1 AS width FROM vox3 GROUP BY case_id),
s AS (SELECT s.case_id, count(*) AS n_support, min(z) AS z_min, max(z) AS z_max, min(y) AS y_min, max(y) AS y_max, min(x) AS x_min, max(x) AS x_max,
  CAST(sum((z = 0)::INT + (z = depth - 1)::INT + (y = 0)::INT + (y = height - 1)::INT + (x = 0)::INT + (x = width - 1)::INT) AS BIGINT) AS border_voxels
  FROM support s JOIN shp ON shp.case_id = s.case_id GROUP BY s.case_id)
SELECT s.*, (SELECT count(*) FROM head h WHERE h.case_id = s.case_id) AS head_voxels,
  round(n_support / (depth * height * width), 6) AS coverage FROM s JOIN shp ON shp.case_id = s.case_id""")
def head_support(spark, sf):
    ncct = ncct_of(spark, sf)
    support, head = masks.head_support(ncct)
    qc = masks.support_qc(support, head, masks.grid_shapes(ncct))
    return qc.drop("depth", "height", "width", "voxels").withColumn("coverage", closed_round(F.col("coverage")))


@query("support_violations", """
WITH v AS (SELECT o_orderkey // 512 AS case_id, o_orderkey % 512 // 64 AS z, o_custkey, o_orderkey, o_totalprice FROM orders)
SELECT 'ncct_not_finite' AS "check", CAST(case_id AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM v WHERE o_orderkey % 97 = 0 GROUP BY case_id
UNION ALL SELECT 'grid_too_small', CAST(case_id AS VARCHAR), CAST(max(z) + 1 AS VARCHAR) FROM v GROUP BY case_id HAVING max(z) < 7
UNION ALL SELECT 'coverage', CAST(case_id AS VARCHAR), '1.0000' FROM v WHERE case_id % 5 = 1 GROUP BY case_id""")
def support_violations(spark, sf):
    voxels = view(spark, sf, "vox3")
    ncct = voxels.selectExpr("case_id", "z", "y", "x", "if(k % 97 = 0, double('NaN'), ncct) as value")
    total = F.col("depth") * F.col("height") * F.col("width")
    qc = masks.grid_shapes(ncct).withColumn("head_voxels", F.lit(100)).withColumn(
        "n_support", F.when(F.col("case_id") % 5 == 1, total).otherwise(F.floor(total / 2))
    ).withColumn("coverage", F.col("n_support") / total)
    return masks.support_violations(ncct, qc)


@query("dense_violations", cte("vox3") + """
SELECT 'grid_not_dense' AS "check", CAST(case_id AS VARCHAR) AS key, CAST(count(*) AS VARCHAR) AS detail FROM vox3 GROUP BY case_id HAVING count(*) <> (max(z) + 1) * (max(y) + 1) * (max(x) + 1)""")
def dense_violations(spark, sf):
    return masks.dense_violations(view(spark, sf, "vox3"))


@query("brain_mask", cte("vox3") + """
SELECT case_id, count(*) FILTER (isfinite(mtt) AND mtt > 0) AS brain, count(*) FILTER (NOT (isfinite(mtt) AND mtt > 0)) AS other
FROM vox3 GROUP BY case_id""")
def brain_mask(spark, sf):
    inside = masks.brain_mask(F.col("mtt"))
    return view(spark, sf, "vox3").groupBy("case_id").agg(F.count_if(inside).alias("brain"), F.count_if(~inside).alias("other"))


@query("mask_intersect", cte("vox3") + " SELECT case_id, z, y, x FROM vox3 WHERE pred AND ncct > 0")
def mask_intersect(spark, sf):
    voxels = view(spark, sf, "vox3")
    brain = masks.foreground(voxels, "ncct")
    return masks.mask_intersect(voxels.where("pred").select("case_id", "z", "y", "x"), brain)


@query("shape_violations", cte("vox3") + """,
s AS (SELECT case_id, max(z) + 1 AS d, max(y) + 1 AS h, max(x) + 1 AS w FROM vox3 GROUP BY case_id)
SELECT 'shape' AS "check", CAST(case_id AS VARCHAR) AS key, concat(d, 'x', h, 'x', w, ' vs ', d + 1, 'x', h, 'x', w) AS detail FROM s WHERE case_id % 4 = 1""")
def shape_violations(spark, sf):
    shapes = masks.grid_shapes(view(spark, sf, "vox3"))
    moved = shapes.withColumn("depth", F.col("depth") + F.when(F.col("case_id") % 4 == 1, 1).otherwise(0))
    return masks.shape_violations(shapes, moved)


@query("label_values", """
WITH l AS (SELECT l_suppkey AS case_id, CASE WHEN l_linenumber = 7 THEN CAST('NaN' AS DOUBLE) WHEN l_quantity = 50 THEN CAST(2 AS DOUBLE)
  WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS v FROM lineitem)
SELECT case_id, count(*) FILTER (v = 0) AS background, count(*) FILTER (v = 1) AS foreground, count(*) FILTER (v = 2) AS unexpected,
  count(*) FILTER (isnan(v)) AS non_finite FROM l GROUP BY case_id""")
def label_values(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_suppkey as case_id",
        "case when l_linenumber = 7 then double('NaN') when l_quantity = 50 then 2D when l_returnflag = 'R' then 1D else 0D end as value")
    return masks.label_values(rows)


def close_sql(radius: int) -> str:
    r2 = radius * radius
    return cte("img2") + f""",
shp AS (SELECT case_id, max("row") + 1 AS h, max(col) + 1 AS w FROM img2 GROUP BY case_id),
o AS (SELECT a.range AS dy, b.range AS dx FROM range(-{radius}, {radius + 1}) a, range(-{radius}, {radius + 1}) b WHERE a.range * a.range + b.range * b.range <= {r2}),
dil AS (SELECT DISTINCT m.case_id, "row" + dy AS r, col + dx AS c FROM img2 m, o JOIN shp ON true
  WHERE label AND shp.case_id = m.case_id AND "row" + dy BETWEEN 0 AND h - 1 AND col + dx BETWEEN 0 AND w - 1),
ero AS (SELECT case_id, r + dy AS r, c + dx AS c, count(*) AS n FROM dil, o GROUP BY ALL)
SELECT case_id, r AS "row", c AS col FROM ero WHERE n = (SELECT count(*) FROM o)"""


@query("close_2d", close_sql(2))
def close_2d(spark, sf):
    pixels = view(spark, sf, "img2")
    return masks.close_2d(pixels.where("label"), image_shapes(pixels), 2)


def image_shapes(pixels):
    return pixels.groupBy("case_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))


@query("restore_mask", close_sql(1).replace('SELECT case_id, r AS "row", c AS col FROM ero WHERE', """
SELECT ero.case_id, r AS "row", c AS col FROM ero JOIN img2 b ON b.case_id = ero.case_id AND b."row" = r AND b.col = c AND b.value > 0 WHERE"""))
def restore_mask(spark, sf):
    pixels = view(spark, sf, "img2")
    predictions = pixels.selectExpr("case_id", "row", "col", "cast(label as int) as prediction")
    return masks.restore_mask(predictions, pixels.where("value > 0"), image_shapes(pixels), 1)


@query("restore_violations", cte("img2") + """
SELECT 'prediction_count' AS "check", CAST(case_id AS VARCHAR) AS key,
  concat(count(*) FILTER (label), ' vs ', count(*) FILTER (value > 10)) AS detail FROM img2 GROUP BY case_id
HAVING count(*) FILTER (label) <> count(*) FILTER (value > 10)""")
def restore_violations(spark, sf):
    pixels = view(spark, sf, "img2")
    return masks.restore_violations(pixels.where("label"), pixels.where("value > 10"))
