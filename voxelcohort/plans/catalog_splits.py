"""Split and sampling queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelcohort.operators import splits
from voxelcohort.plans.registry import query
from voxelcohort.plans.views import cte, table, view
from voxelcohort.session import cut_lineage

SEED = 2026
FOLDS_SQL = f"""folds0 AS (SELECT c_custkey AS case_id,
  CAST(ntile(5) OVER (ORDER BY md5(concat_ws('|', c_custkey, '{SEED}')), c_custkey) - 1 AS INTEGER) AS fold FROM customer),
folds AS (SELECT f.i AS fold, CASE WHEN f.i = fold THEN 'val' ELSE 'train' END AS role, case_id
  FROM folds0, (SELECT CAST(range AS INTEGER) AS i FROM range(5)) f)"""


def customers(spark, sf):
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"))


def folds_of(spark, sf):
    return splits.expand_folds(splits.kfold(customers(spark, sf), 5, SEED), 5)


@query("holdout_split", f"""
SELECT case_id, CASE WHEN position <= n - greatest(1, CAST(round_even(n * CAST(0.3 AS DOUBLE), 0) AS BIGINT)) THEN 'train' ELSE 'test' END AS role,
  position FROM (SELECT c_custkey AS case_id, count(*) OVER () AS n,
  row_number() OVER (ORDER BY md5(concat_ws('|', c_custkey, '{SEED}')), c_custkey) AS position FROM customer)""")
def holdout_split(spark, sf):
    return splits.holdout_split(customers(spark, sf), seed=SEED)


@query("kfold", f"""
SELECT c_custkey AS case_id,
  CAST(ntile(5) OVER (ORDER BY md5(concat_ws('|', c_custkey, '{SEED}')), c_custkey) - 1 AS INTEGER) AS fold FROM customer""")
def kfold(spark, sf):
    return splits.kfold(customers(spark, sf), 5, SEED)


@query("expand_folds", f"WITH {FOLDS_SQL} SELECT fold, role, case_id FROM folds")
def expand_folds(spark, sf):
    return folds_of(spark, sf)


TAMPERED_SQL = f"""{FOLDS_SQL},
tampered AS (
  SELECT fold, role, case_id FROM folds WHERE NOT (case_id % 97 = 5)
  UNION ALL SELECT (fold + 1) % 5, role, case_id FROM folds WHERE role = 'val' AND case_id % 89 = 3
  UNION ALL SELECT fold, 'train', case_id FROM folds WHERE case_id % 83 = 7
  UNION ALL SELECT fold, role, -case_id FROM folds WHERE role = 'val' AND case_id % 101 = 9)"""


def tampered_folds(spark, sf):
    good = cut_lineage(folds_of(spark, sf))
    val = good.where("role = 'val'")
    return (
        good.where("not (case_id % 97 = 5)")
        .unionByName(val.where("case_id % 89 = 3").withColumn("fold", ((F.col("fold") + 1) % 5).cast("int")))
        .unionByName(good.where("case_id % 83 = 7").withColumn("role", F.lit("train")))
        .unionByName(val.where("case_id % 101 = 9").withColumn("case_id", -F.col("case_id")))
    )


@query("check_folds", f"""
WITH {TAMPERED_SQL},
pc AS (SELECT case_id, count(*) FILTER (role = 'val') AS n_val,
  string_agg(DISTINCT CAST(fold AS VARCHAR), ',' ORDER BY CAST(fold AS VARCHAR)) FILTER (role = 'val') AS val_folds FROM tampered GROUP BY 1),
pfc AS (SELECT fold, case_id, count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'val') AS n_val FROM tampered GROUP BY 1, 2)
SELECT 'val_repeated' AS "check", CAST(case_id AS VARCHAR) AS key, val_folds AS detail FROM pc WHERE n_val > 1
UNION ALL SELECT 'val_missing', CAST(c_custkey AS VARCHAR), '' FROM customer LEFT JOIN pc ON c_custkey = case_id WHERE coalesce(n_val, 0) = 0
UNION ALL SELECT 'case_unexpected', CAST(case_id AS VARCHAR), '' FROM pc WHERE case_id NOT IN (SELECT c_custkey FROM customer)
UNION ALL SELECT 'train_repeated', fold || '/' || case_id, CAST(n_train AS VARCHAR) FROM pfc WHERE n_train > 1
UNION ALL SELECT 'train_val_overlap', fold || '/' || case_id, '' FROM pfc WHERE n_train > 0 AND n_val > 0
UNION ALL SELECT 'train_not_complement', f.range || '/' || c_custkey, '' FROM customer, range(5) f
  WHERE NOT EXISTS (SELECT 1 FROM pfc WHERE pfc.case_id = c_custkey AND pfc.fold = f.range)
UNION ALL SELECT 'val_size', CAST(fold AS VARCHAR), CAST(count(*) FILTER (role = 'val') AS VARCHAR) FROM tampered GROUP BY fold
  HAVING count(*) FILTER (role = 'val') <> 300""")
def check_folds(spark, sf):
    return splits.check_folds(tampered_folds(spark, sf), customers(spark, sf), 5, [300] * 5)


@query("compare_folds", f"""
WITH {FOLDS_SQL},
a AS (SELECT *, row_number() OVER (PARTITION BY fold, role ORDER BY case_id) AS pos FROM folds),
b AS (SELECT fold, role, case_id + CASE WHEN case_id % 61 = 4 THEN 1000000 ELSE 0 END AS case_id,
  CASE WHEN case_id % 53 = 2 THEN pos + 1 ELSE pos END AS pos FROM a)
SELECT coalesce(a.fold, b.fold) AS fold, coalesce(a.role, b.role) AS role, coalesce(a.case_id, b.case_id) AS case_id,
  CASE WHEN b.pos IS NULL THEN 'missing' WHEN a.pos IS NULL THEN 'extra' ELSE 'order' END AS kind,
  coalesce(a.pos, -1) AS left_pos, coalesce(b.pos, -1) AS right_pos
FROM a FULL OUTER JOIN b ON a.fold = b.fold AND a.role = b.role AND a.case_id = b.case_id
WHERE a.pos IS NULL OR b.pos IS NULL OR a.pos <> b.pos""")
def compare_folds(spark, sf):
    from voxelcohort.functions import value_bucket, with_rank

    a = with_rank(folds_of(spark, sf), ["fold", "role"], ["case_id"], value_bucket(F.col("case_id").cast("double")), "pos")
    b = a.select(
        "fold", "role",
        (F.col("case_id") + F.when(F.col("case_id") % 61 == 4, 1000000).otherwise(0)).alias("case_id"),
        F.when(F.col("case_id") % 53 == 2, F.col("pos") + 1).otherwise(F.col("pos")).alias("pos"),
    )
    return splits.compare_folds(a, b).fillna(-1, ["left_pos", "right_pos"])


@query("pixel_partition", cte("img2") + f""",
r AS (SELECT case_id, "row", col, count(*) OVER (PARTITION BY case_id) AS n,
  row_number() OVER (PARTITION BY case_id ORDER BY md5(concat_ws('|', case_id, "row", col, '{SEED}')), "row", col) AS p FROM img2)
SELECT case_id, "row", col, CASE WHEN p <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
  WHEN p <= floor(n * CAST(0.7 AS DOUBLE)) + floor(n * CAST(0.15 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS role FROM r""")
def pixel_partition(spark, sf):
    pixels = view(spark, sf, "img2").select("case_id", "row", "col")
    return splits.pixel_partition(pixels, ["row", "col"], 0.7, 0.15, SEED)


@query("balanced_sample", cte("img2") + f""",
r AS (SELECT case_id, "row", col, label, row_number() OVER (PARTITION BY label
  ORDER BY md5(concat_ws('|', case_id, "row", col, '{SEED}')), case_id, "row", col) AS p FROM img2)
SELECT case_id, "row", col, label FROM r WHERE p <= (SELECT least(2000, count(*) FILTER (label), count(*) FILTER (NOT label)) FROM img2)""")
def balanced_sample(spark, sf):
    pixels = view(spark, sf, "img2").select("case_id", "row", "col", "label")
    return splits.balanced_sample(pixels, "label", ["case_id", "row", "col"], 2000, SEED)


def channel_voxels(spark, sf, channels=("ncct", "tmax", "cbf", "cbv", "mtt"), extra=()):
    """Long (case_id, channel, z, y, x, value) rows of the voxel view."""
    pairs = ", ".join(f"'{c}', {c}" for c in channels)
    return view(spark, sf, "vox3").selectExpr(
        "case_id", "z", "y", "x", *extra, f"stack({len(channels)}, {pairs}) as (channel, value)"
    )


LONG_SQL = cte("vox3") + """,
long AS (SELECT case_id, z, y, x, k, ncct AS base, 'ncct' AS channel, ncct AS value FROM vox3
  UNION ALL SELECT case_id, z, y, x, k, ncct, 'tmax', tmax FROM vox3 UNION ALL SELECT case_id, z, y, x, k, ncct, 'cbf', cbf FROM vox3
  UNION ALL SELECT case_id, z, y, x, k, ncct, 'cbv', cbv FROM vox3 UNION ALL SELECT case_id, z, y, x, k, ncct, 'mtt', mtt FROM vox3)"""


@query("support_sample", LONG_SQL + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, channel
  ORDER BY md5(concat_ws('|', case_id, channel, z, y, x, '{SEED}')), z, y, x) AS p
  FROM long WHERE base BETWEEN -100 AND 150 AND isfinite(value))
SELECT case_id, channel, z, y, x, value FROM r WHERE p <= 4096""")
def support_sample(spark, sf):
    rows = channel_voxels(spark, sf, extra=("ncct as base",)).where("base between -100 and 150").drop("base")
    return splits.support_sample(rows, seed=SEED)


@query("stride_sample_finite", cte("vox3") + """,
r AS (SELECT case_id, z, y, x, mtt AS value, row_number() OVER (PARTITION BY case_id ORDER BY k) AS p,
  count(*) OVER (PARTITION BY case_id) AS n FROM vox3 WHERE isfinite(mtt))
SELECT case_id, z, y, x, value FROM r WHERE (p - 1) % greatest(1, CAST(ceil(n / 100.0) AS BIGINT)) = 0""")
def stride_sample_finite(spark, sf):
    return splits.stride_sample(channel_voxels(spark, sf, ("mtt",)), 100, "finite").drop("channel")


@query("stride_sample_grid", cte("vox3") + """
SELECT case_id, z, y, x, mtt AS value FROM vox3 WHERE isfinite(mtt) AND (z * 64 + y * 8 + x) % 6 = 0""")
def stride_sample_grid(spark, sf):
    return splits.stride_sample(channel_voxels(spark, sf, ("mtt",)), 100, "grid", (8, 8, 8)).drop("channel")


@query("evenly_spaced_pick", """
WITH r AS (SELECT c_custkey AS case_id, row_number() OVER (ORDER BY c_custkey) - 1 AS position, count(*) OVER () AS m FROM customer)
SELECT case_id, position FROM r WHERE position IN (SELECT range * (m - 1) // 36 FROM range(37))""")
def evenly_spaced_pick(spark, sf):
    return splits.evenly_spaced_pick(customers(spark, sf), 37)


PLAN_SQL = f"""{FOLDS_SQL},
plan AS (SELECT fold, arm, case_id, CASE WHEN role = 'train' THEN 'imagesTr' ELSE 'imagesTs' END AS "group",
  case_id || '_' || lpad(CAST(i AS VARCHAR), 4, '0') || '.nii.gz' AS file_name
  FROM folds, (SELECT 'single' AS arm, 0 AS i UNION ALL SELECT 'multi', CAST(range AS INTEGER) FROM range(5)) a
  UNION ALL SELECT fold, arm, case_id, 'labelsTr', case_id || '.nii.gz'
  FROM folds, (SELECT 'single' AS arm UNION ALL SELECT 'multi') a WHERE role = 'train')"""
ARMS = [("single", 1), ("multi", 5)]


@query("fold_file_plan", f"WITH {PLAN_SQL} SELECT fold, arm, case_id, \"group\", file_name FROM plan")
def fold_file_plan(spark, sf):
    return splits.fold_file_plan(folds_of(spark, sf), ARMS)


ACTUAL_SQL = f"""{PLAN_SQL},
actual AS (SELECT fold, arm, case_id, CASE WHEN "group" = 'imagesTs' AND case_id % 37 = 3 THEN 'imagesTr' ELSE "group" END AS "group", file_name
  FROM plan WHERE NOT (case_id % 41 = 1 AND arm = 'single')
  UNION ALL SELECT fold, arm, case_id, "group", file_name FROM plan WHERE case_id % 43 = 2 AND "group" = 'labelsTr'
  UNION ALL SELECT fold, 'multi', case_id, 'labelsTr', case_id || '.nii.gz' FROM folds WHERE role = 'val' AND case_id % 47 = 5)"""


def actual_files(folds):
    plan = splits.fold_file_plan(folds, ARMS)
    moved = F.when((F.col("group") == "imagesTs") & (F.col("case_id") % 37 == 3), "imagesTr").otherwise(F.col("group"))
    leaked = folds.where("role = 'val' and case_id % 47 = 5").selectExpr(
        "fold", "'multi' as arm", "case_id", "'labelsTr' as `group`", "concat(case_id, '.nii.gz') as file_name")
    return (
        plan.where("not (case_id % 41 = 1 and arm = 'single')").withColumn("group", moved)
        .unionByName(plan.where("case_id % 43 = 2 and `group` = 'labelsTr'"))
        .unionByName(leaked)
    )


@query("reconcile_inventory", f"""
WITH {ACTUAL_SQL},
present AS (SELECT fold, arm, file_name, "group", case_id, count(*) AS copies FROM actual GROUP BY ALL),
j AS (SELECT coalesce(a.fold, p.fold) AS fold, coalesce(a.arm, p.arm) AS arm, coalesce(a.file_name, p.file_name) AS file_name,
  p."group" AS planned, a."group" AS got FROM plan p FULL OUTER JOIN present a ON p.fold = a.fold AND p.arm = a.arm AND p.file_name = a.file_name),
l AS (SELECT present.* FROM present JOIN folds ON folds.fold = present.fold AND folds.case_id = present.case_id WHERE role = 'val')
SELECT 'missing' AS "check", concat_ws('/', fold, arm, file_name) AS key, planned AS detail FROM j WHERE got IS NULL
UNION ALL SELECT 'extra', concat_ws('/', fold, arm, file_name), got FROM j WHERE planned IS NULL
UNION ALL SELECT 'wrong_group', concat_ws('/', fold, arm, file_name), got FROM j WHERE planned <> got
UNION ALL SELECT 'duplicate', concat_ws('/', fold, arm, file_name), CAST(copies AS VARCHAR) FROM present WHERE copies > 1
UNION ALL SELECT 'heldout_label', concat_ws('/', fold, arm, file_name), "group" FROM l WHERE "group" = 'labelsTr'
UNION ALL SELECT 'heldout_image', concat_ws('/', fold, arm, file_name), "group" FROM l WHERE "group" = 'imagesTr'""")
def reconcile_inventory(spark, sf):
    folds = cut_lineage(folds_of(spark, sf))
    return splits.reconcile_inventory(splits.fold_file_plan(folds, ARMS), actual_files(folds), folds)


@query("inventory_count_violations", f"""
WITH {ACTUAL_SQL},
d AS (SELECT fold, arm, "group", count(*) AS declared FROM plan GROUP BY ALL),
c AS (SELECT fold, arm, "group", count(*) AS n FROM actual GROUP BY ALL)
SELECT 'declared_count' AS "check", concat_ws('/', coalesce(d.fold, c.fold), coalesce(d.arm, c.arm), coalesce(d."group", c."group")) AS key,
  CAST(coalesce(n, 0) AS VARCHAR) AS detail
FROM d FULL OUTER JOIN c ON d.fold = c.fold AND d.arm = c.arm AND d."group" = c."group" WHERE declared IS DISTINCT FROM n""")
def inventory_count_violations(spark, sf):
    folds = cut_lineage(folds_of(spark, sf))
    declared = splits.fold_file_plan(folds, ARMS).groupBy("fold", "arm", "group").agg(F.count(F.lit(1)).alias("declared"))
    return splits.inventory_count_violations(actual_files(folds), declared)


@query("missing_artifacts", """
WITH f AS (SELECT o_custkey AS case_id, CASE o_orderstatus WHEN 'F' THEN '.nii.gz' WHEN 'O' THEN '.npz' ELSE '.json' END AS suffix,
  CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 1 END AS length FROM orders)
SELECT c_custkey AS case_id, suffix FROM customer, (SELECT unnest(['.nii.gz', '.npz', '.json']) AS suffix) s
WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.case_id = c_custkey AND f.suffix = s.suffix AND length > 0)""")
def missing_artifacts(spark, sf):
    files = table(spark, sf, "orders").selectExpr(
        "o_custkey as case_id",
        "case o_orderstatus when 'F' then '.nii.gz' when 'O' then '.npz' else '.json' end as suffix",
        "if(o_orderkey % 7 = 0, 0, 1) as length")
    return splits.missing_artifacts(customers(spark, sf), [".nii.gz", ".npz", ".json"], files)


@query("shard_plan", cte("files") + """,
r AS (SELECT case_id, (dense_rank() OVER (ORDER BY case_id) - 1) // 10 AS shard, size FROM files)
SELECT shard, count(DISTINCT case_id) AS subjects, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes,
  (SELECT string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FROM (SELECT DISTINCT case_id AS c FROM r r2 WHERE r2.shard = r.shard)) AS subject_list
FROM r GROUP BY shard""")
def shard_plan(spark, sf):
    return splits.shard_plan(view(spark, sf, "files"), 10)
