"""Inventory, document, volume and sink queries over the given tables."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from voxelcohort.functions import closed_round
from voxelcohort.operators.splits import expand_folds, kfold
from voxelcohort.plans.catalog_metrics import rounded
from voxelcohort.plans.catalog_splits import FOLDS_SQL, SEED, customers
from voxelcohort.plans.registry import query
from voxelcohort.plans.views import cte, table, view
from voxelcohort.session import scratch_path
from voxelcohort.sources import documents, inventory, sinks, volumes


@query("inventory_scan")
def inventory_scan(spark, sf):
    files = inventory.inventory_scan(spark, sf, (".parquet",))
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length")


PATHS_SQL = """WITH p AS (SELECT o_orderkey, o_custkey,
  concat(CASE o_orderkey % 4 WHEN 0 THEN 'train/rawdata' WHEN 1 THEN './train\\derivatives' WHEN 2 THEN 'train/derivatives' ELSE '__MACOSX/x/derivatives' END,
  '/sub-stroke', o_custkey, '/ses-', CASE o_orderkey % 3 WHEN 0 THEN '01' WHEN 1 THEN '0001' ELSE '02' END, '/s_',
  CASE o_orderpriority WHEN '1-URGENT' THEN 'ncct' WHEN '2-HIGH' THEN 'space-ncct_Tmax' WHEN '3-MEDIUM' THEN 'space-ncct_cbf'
  WHEN '5-LOW' THEN 'lesion-msk' ELSE 'space-ncct_cta' END, '.nii.gz') AS path FROM orders),
n AS (SELECT *, '/' || regexp_replace(replace(path, '\\', '/'), '^[./]+', '') AS np FROM p),
c AS (SELECT *, CASE WHEN regexp_matches(np, '/raw_?data/sub-[^/]+/ses-0*1/[^/]*_ncct\\.nii\\.gz$', 'i') THEN 'ncct'
  WHEN regexp_matches(np, '/derivatives/sub-[^/]+/ses-0*1/.*/?[^/]*space-ncct_cta\\.nii\\.gz$', 'i') THEN 'cta'
  WHEN regexp_matches(np, '/derivatives/sub-[^/]+/ses-0*1/.*/?[^/]*space-ncct_tmax\\.nii\\.gz$', 'i') THEN 'tmax'
  WHEN regexp_matches(np, '/derivatives/sub-[^/]+/ses-0*1/.*/?[^/]*space-ncct_cbf\\.nii\\.gz$', 'i') THEN 'cbf'
  WHEN regexp_matches(np, '/derivatives/sub-[^/]+/ses-0*2/[^/]*_lesion-msk\\.nii\\.gz$', 'i') THEN 'lesion_mask' END AS category FROM n)"""


def release_paths(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.concat(
        F.expr(r"CASE o_orderkey % 4 WHEN 0 THEN 'train/rawdata' WHEN 1 THEN './train\\derivatives' WHEN 2 THEN 'train/derivatives' ELSE '__MACOSX/x/derivatives' END"),
        F.lit("/sub-stroke"), F.col("o_custkey"), F.lit("/ses-"),
        F.expr("CASE o_orderkey % 3 WHEN 0 THEN '01' WHEN 1 THEN '0001' ELSE '02' END"), F.lit("/s_"),
        F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'ncct' WHEN '2-HIGH' THEN 'space-ncct_Tmax' WHEN '3-MEDIUM' THEN 'space-ncct_cbf' "
               "WHEN '5-LOW' THEN 'lesion-msk' ELSE 'space-ncct_cta' END"), F.lit(".nii.gz")).alias("path"))


def classified(spark, sf):
    return inventory.classify_paths(release_paths(spark, sf), inventory.CT_2024_RULES)


@query("classify_paths", PATHS_SQL + " SELECT o_orderkey, coalesce(category, 'none') AS category FROM c")
def classify_paths(spark, sf):
    return classified(spark, sf).select("o_orderkey", F.coalesce("category", F.lit("none")).alias("category"))


@query("classify_paths_mri", """
WITH p AS (SELECT l_orderkey, l_linenumber, concat('set/case_', l_suppkey, '/VSD.Brain.XX.O.MR_', CASE l_returnflag WHEN 'R' THEN 'Flair' WHEN 'A' THEN 'T2' ELSE 'DWI' END,
  '/', CASE l_linenumber WHEN 1 THEN 'OT' WHEN 2 THEN 'ground_truth' ELSE 'img' END, '.nii') AS path FROM lineitem)
SELECT CASE WHEN regexp_matches(path, '(^|[./_-])ot([./_-]|$)|ground_truth', 'i') THEN 'ot' WHEN path ILIKE '%flair%' THEN 'flair' WHEN path ILIKE '%mr_dwi%' THEN 'dwi' ELSE 't2' END AS category,
  count(*) AS n FROM p GROUP BY 1""")
def classify_paths_mri(spark, sf):
    paths = table(spark, sf, "lineitem").selectExpr(
        "concat('set/case_', l_suppkey, '/VSD.Brain.XX.O.MR_', CASE l_returnflag WHEN 'R' THEN 'Flair' WHEN 'A' THEN 'T2' ELSE 'DWI' END, '/', "
        "CASE l_linenumber WHEN 1 THEN 'OT' WHEN 2 THEN 'ground_truth' ELSE 'img' END, '.nii') as path")
    out = inventory.classify_paths(paths, inventory.MRI_2015_RULES, inventory.tail_parts(F.col("path")))
    return out.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("keep_images", PATHS_SQL + " SELECT o_orderkey FROM p WHERE NOT path LIKE '%__MACOSX%'")
def keep_images(spark, sf):
    return inventory.keep_images(release_paths(spark, sf)).select("o_orderkey")


@query("category_counts", PATHS_SQL + """
SELECT 'category_count' AS "check", e.category AS key, CAST((SELECT count(*) FROM c WHERE c.category = e.category) AS VARCHAR) AS detail
FROM (SELECT unnest(['ncct', 'cta', 'tmax', 'cbf', 'cbv', 'mtt', 'lesion_mask']) AS category) e""")
def category_counts(spark, sf):
    names = ("ncct", "cta", "tmax", "cbf", "cbv", "mtt", "lesion_mask")
    return inventory.category_counts(classified(spark, sf), {c: 149 for c in names})


ASSEMBLE_SQL = PATHS_SQL + """,
g AS (SELECT o_custkey AS case_id, category, min(path) AS path, count(*) AS n FROM c WHERE category IN ('cta', 'cbf', 'tmax') GROUP BY ALL),
w AS (SELECT case_id, max(path) FILTER (category = 'cta') AS cta, max(path) FILTER (category = 'cbf') AS cbf, max(path) FILTER (category = 'tmax') AS tmax,
  coalesce(max(n) FILTER (category = 'cta'), 0) AS n1, coalesce(max(n) FILTER (category = 'cbf'), 0) AS n2, coalesce(max(n) FILTER (category = 'tmax'), 0) AS n3 FROM g GROUP BY case_id)"""


def assembled(spark, sf):
    files = classified(spark, sf).withColumnRenamed("o_custkey", "case_id")
    return inventory.assemble_cases(files, ["cta", "cbf"], ["tmax"])


@query("assemble_cases", ASSEMBLE_SQL + " SELECT case_id, cta, cbf, coalesce(tmax, '') AS tmax FROM w WHERE n1 = 1 AND n2 = 1 AND n3 <= 1")
def assemble_cases(spark, sf):
    return assembled(spark, sf)[0].fillna("", ["tmax"])


@query("assemble_violations", ASSEMBLE_SQL + """
SELECT 'category_repeated' AS "check", CAST(case_id AS VARCHAR) AS key, 'cta' AS detail FROM w WHERE n1 > 1
UNION ALL SELECT 'category_repeated', CAST(case_id AS VARCHAR), 'cbf' FROM w WHERE n2 > 1
UNION ALL SELECT 'category_repeated', CAST(case_id AS VARCHAR), 'tmax' FROM w WHERE n3 > 1
UNION ALL SELECT 'category_missing', CAST(case_id AS VARCHAR), 'cta' FROM w WHERE n1 = 0
UNION ALL SELECT 'category_missing', CAST(case_id AS VARCHAR), 'cbf' FROM w WHERE n2 = 0""")
def assemble_violations(spark, sf):
    return assembled(spark, sf)[1]


@query("acute_model_inputs", ASSEMBLE_SQL + """,
k AS (SELECT * FROM w WHERE n1 = 1 AND n2 = 1 AND n3 <= 1)
SELECT case_id, 'cta' AS channel, cta AS path FROM k UNION ALL SELECT case_id, 'tmax', tmax FROM k WHERE tmax IS NOT NULL""")
def acute_model_inputs(spark, sf):
    return inventory.acute_model_inputs(assembled(spark, sf)[0], ["cta", "tmax"])


@query("subject_of", PATHS_SQL + """
SELECT regexp_extract(path, '(sub-[^/]+)', 1) AS subject, replace(regexp_extract(path, '(sub-[^/]+)', 1), '-', '_') AS training_id,
  replace(regexp_replace(path, '/[^/]*$', ''), '/', '__') AS case_key FROM p""")
def subject_of(spark, sf):
    path = F.col("path")
    return release_paths(spark, sf).select(
        inventory.subject_of(path).alias("subject"), inventory.training_id(inventory.subject_of(path)).alias("training_id"),
        inventory.case_key(path).alias("case_key"))


@query("id_collisions", """
WITH i AS (SELECT DISTINCT concat('sub', CASE WHEN o_orderstatus = 'F' THEN '-' ELSE '_' END, o_custkey) AS c FROM orders)
SELECT 'training_id_collision' AS "check", replace(c, '-', '_') AS key, CAST(count(*) AS VARCHAR) AS detail FROM i GROUP BY 2 HAVING count(*) > 1""")
def id_collisions(spark, sf):
    return inventory.id_collisions(table(spark, sf, "orders").selectExpr(
        "concat('sub', if(o_orderstatus = 'F', '-', '_'), o_custkey) as case_id"))


@query("session_resolve", PATHS_SQL + """,
s AS (SELECT o_custkey AS case_id, category, path, CASE WHEN path LIKE '%/ses-01/%' THEN 1 WHEN path LIKE '%/ses-0001/%' THEN 2 END AS r FROM c WHERE category IS NOT NULL)
SELECT case_id, category, arg_min(path, (r, path)) AS path FROM s WHERE r IS NOT NULL GROUP BY ALL""")
def session_resolve(spark, sf):
    files = classified(spark, sf).where("category is not null").withColumnRenamed("o_custkey", "case_id")
    return inventory.session_resolve(files, 1)


@query("keyed_table_violations", """
WITH r AS (SELECT l_suppkey AS case_id, CASE l_linenumber WHEN 1 THEN 'ncct' WHEN 2 THEN 'tmax' WHEN 3 THEN 'cbf' ELSE 'other' END AS channel FROM lineitem),
h AS (SELECT case_id, channel, count(*) AS n FROM r GROUP BY ALL),
e AS (SELECT s_suppkey AS case_id, channel FROM supplier, (SELECT unnest(['ncct', 'tmax', 'cbf', 'mtt']) AS channel) c)
SELECT 'key_missing' AS "check", concat(e.case_id, '/', e.channel) AS key, '' AS detail FROM e LEFT JOIN h ON h.case_id = e.case_id AND h.channel = e.channel WHERE h.n IS NULL
UNION ALL SELECT 'key_unexpected', concat(h.case_id, '/', h.channel), '' FROM h LEFT JOIN e ON h.case_id = e.case_id AND h.channel = e.channel WHERE e.case_id IS NULL
UNION ALL SELECT 'key_repeated', concat(case_id, '/', channel), CAST(n AS VARCHAR) FROM h WHERE n > 1
UNION ALL SELECT 'row_count', 'table', CAST(count(*) AS VARCHAR) FROM r HAVING count(*) <> 745""")
def keyed_table_violations(spark, sf):
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_suppkey as case_id", "case l_linenumber when 1 then 'ncct' when 2 then 'tmax' when 3 then 'cbf' else 'other' end as channel")
    cases = table(spark, sf, "supplier").selectExpr("s_suppkey as case_id")
    return inventory.keyed_table_violations(rows, cases, ["ncct", "tmax", "cbf", "mtt"], 745)


PAIR_SQL = """WITH n AS (SELECT concat('sub-s', o_custkey) AS case_id, count(*) FILTER (o_orderstatus = 'F') AS l, count(*) FILTER (o_orderstatus = 'P') AS r,
  min(CAST(o_orderkey AS VARCHAR)) FILTER (o_orderstatus = 'F') AS left_path, min(CAST(o_orderkey AS VARCHAR)) FILTER (o_orderstatus = 'P') AS right_path FROM orders GROUP BY o_custkey)"""


def paired(spark, sf):
    files = table(spark, sf, "orders").selectExpr(
        "concat('SUB-s', o_custkey) as subject", "case o_orderstatus when 'F' then 'ncct' when 'P' then 'mask' else 'other' end as category",
        "cast(o_orderkey as string) as path")
    return inventory.paired_files(files, "ncct", "mask")


@query("paired_files", PAIR_SQL + " SELECT case_id, left_path, right_path FROM n WHERE l = 1 AND r = 1")
def paired_files(spark, sf):
    return paired(spark, sf)[0]


@query("paired_file_violations", PAIR_SQL + """
SELECT 'repeated' AS "check", case_id AS key, 'ncct' AS detail FROM n WHERE l > 1 UNION ALL SELECT 'repeated', case_id, 'mask' FROM n WHERE r > 1
UNION ALL SELECT 'one_sided', case_id, 'ncct' FROM n WHERE l > 0 AND r = 0 UNION ALL SELECT 'one_sided', case_id, 'mask' FROM n WHERE l = 0 AND r > 0""")
def paired_file_violations(spark, sf):
    return paired(spark, sf)[1]


# One JSON document per order date, built by Spark from the orders and parsed back.
def summary_documents(spark, sf):
    case = F.struct(
        F.concat(F.lit("/data/preds/"), F.col("o_orderkey"), F.lit(".nii.gz")).alias("reference_file"),
        F.create_map(F.lit("1"), F.struct((F.col("o_totalprice") / 600000).alias("Dice"), F.col("o_custkey").alias("n_pred"), F.col("o_orderkey").alias("n_ref"))).alias("metrics"))
    docs = table(spark, sf, "orders").withColumn("fold", (F.col("o_orderkey") % 5).cast("int")).groupBy("fold", "o_orderdate").agg(
        F.collect_list(case).alias("metric_per_case"))
    return docs.select("fold", F.to_json(F.struct("metric_per_case")).alias("value"))


@query("fold_summaries", """
SELECT CAST(o_orderkey % 5 AS INTEGER) AS fold, CAST(o_orderkey AS VARCHAR) AS case_id, round(o_totalprice / 600000, 9) AS dice, o_custkey AS n_pred, o_orderkey AS n_ref FROM orders""")
def fold_summaries(spark, sf):
    return rounded(documents.parse_fold_summaries(summary_documents(spark, sf)), "dice", places=9)


@query("summary_violations", """
WITH k AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS c FROM lineitem UNION SELECT CAST(-c_custkey - 1 AS VARCHAR) FROM customer)
SELECT 'case_unknown' AS "check", CAST(o_orderkey AS VARCHAR) AS key, '' AS detail FROM orders WHERE CAST(o_orderkey AS VARCHAR) NOT IN (SELECT c FROM k)
UNION ALL SELECT 'case_missing', c, '' FROM k WHERE c NOT IN (SELECT CAST(o_orderkey AS VARCHAR) FROM orders)""")
def summary_violations(spark, sf):
    known = table(spark, sf, "lineitem").selectExpr("l_orderkey as case_id").unionByName(
        table(spark, sf, "customer").selectExpr("-c_custkey - 1 as case_id"))
    return documents.summary_violations(documents.parse_fold_summaries(summary_documents(spark, sf)), known)


# One split document per market segment, so no document holds the whole cohort.
def split_documents(spark, sf):
    seg = table(spark, sf, "customer").selectExpr("c_custkey as case_id", "concat(c_mktsegment, '-', c_nationkey) as site")
    folds = expand_folds(kfold(customers(spark, sf), 5, SEED), 5).join(seg, "case_id")
    ids = lambda role: F.array_sort(F.collect_list(F.when(F.col("role") == role, F.lpad(F.col("case_id").cast("string"), 12, "0"))))
    per_fold = folds.groupBy("site", "fold").agg(ids("train").alias("train"), ids("val").alias("val"))
    listed = per_fold.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("fold", "train", "val"))).alias("f"))
    return listed.select("site", F.to_json(F.transform("f", lambda x: F.struct(x["train"].alias("train"), x["val"].alias("val")))).alias("value"))


SPLITDOC_SQL = f"""WITH {FOLDS_SQL}, sites AS (SELECT c_custkey, concat(c_mktsegment, '-', c_nationkey) AS site FROM customer),
fr AS (SELECT site, fold, role, lpad(CAST(case_id AS VARCHAR), 12, '0') AS case_id FROM folds JOIN sites ON c_custkey = case_id)"""


@query("split_documents", SPLITDOC_SQL + """,
fi AS (SELECT site, fold, dense_rank() OVER (PARTITION BY site ORDER BY fold) - 1 AS fi, role, case_id FROM fr)
SELECT site, CAST(fi AS INTEGER) AS fold, role, CAST(row_number() OVER (PARTITION BY site, fold, role ORDER BY case_id) - 1 AS INTEGER) AS pos, case_id FROM fi""")
def split_documents_rows(spark, sf):
    return documents.parse_splits(split_documents(spark, sf), keep=("site",))


@query("split_document_violations", SPLITDOC_SQL + """,
g AS (SELECT site, fold, dense_rank() OVER (PARTITION BY site ORDER BY fold) - 1 AS fi, count(*) FILTER (role = 'val') AS n FROM fr GROUP BY site, fold)
SELECT 'val_empty' AS "check", concat(site, '/', fi) AS key, '' AS detail FROM g WHERE n = 0""")
def split_document_violations(spark, sf):
    return documents.split_file_violations(split_documents(spark, sf), key="site")


@query("parse_progress_log", """
WITH l AS (SELECT o_orderkey, o_custkey, o_orderkey % 97 / 10.0 AS p FROM orders WHERE o_orderstatus <> 'O')
SELECT concat('sub_', o_custkey) AS case_id, round(CAST(arg_max(p, o_orderkey) AS DOUBLE), 6) AS support_percent, count(*) AS mentions FROM l GROUP BY o_custkey""")
def parse_progress_log(spark, sf):
    lines = table(spark, sf, "orders").selectExpr(
        "o_orderkey as line_no",
        "case when o_orderstatus = 'O' then concat('warning on ', o_custkey) else concat('[', o_orderkey, '/149] sub_', o_custkey, "
        "if(o_orderstatus = 'F', ' COMPUTED', ' CACHED'), ' support=', cast(o_orderkey % 97 / 10 as decimal(6,1)), '%') end as value")
    return rounded(documents.parse_progress_log(lines), "support_percent")


@query("write_tables", """
SELECT l_suppkey AS case_id, CAST(l_suppkey % 5 AS INTEGER) AS fold, count(*) AS n, round(avg(l_tax), 6) AS dice FROM lineitem GROUP BY l_suppkey""")
def write_tables(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("case_id")).agg(
        F.count(F.lit(1)).alias("n"), closed_round(F.avg("l_tax")).alias("dice")).withColumn("fold", (F.col("case_id") % 5).cast("int"))
    path = scratch_path(spark, "case-metrics")
    sinks.write_tables(rows, path, ["fold"])
    return spark.read.schema("case_id long, n long, dice double, fold int").parquet(path)


def _nifti(pdf: pd.DataFrame) -> pd.DataFrame:
    """One single-slice NIfTI-1 file of a (case, slice) group of at most a grid plane."""
    plane = np.zeros((8, 8), dtype="<f4")
    plane[pdf["y"], pdf["x"]] = pdf["value"]
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 8, 8, 1, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, 16, 32)
    struct.pack_into("<8f", head, 76, 1, 2, 2, 5, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, 1, 0)
    head[344:348] = b"n+1\0"
    name = f"{pdf['case_id'].iloc[0]}/{pdf['z'].iloc[0]}.nii"
    return pd.DataFrame({"path": [name], "content": [bytes(head) + plane.tobytes()]})


def slice_files(spark, sf):
    rows = view(spark, sf, "vox3").selectExpr("case_id", "z", "y", "x", "cbf as value")
    return rows.groupBy("case_id", "z").applyInPandas(_nifti, "path string, content binary")


@query("ingest_volumes", cte("vox3") + """
SELECT concat(case_id, '/', z, '.nii') AS path, CAST(64 AS BIGINT) AS voxels, round(sum(cbf), 6) AS total, round(max(cbf), 6) AS peak,
  round(sum(cbf * (y * 8 + x)), 6) AS moment FROM vox3 GROUP BY case_id, z""")
def ingest_volumes(spark, sf):
    voxels = volumes.explode_slabs(volumes.ingest_volumes(slice_files(spark, sf)))
    out = voxels.groupBy("path").agg(
        F.count(F.lit(1)).alias("voxels"), F.sum("value").alias("total"), F.max("value").alias("peak"),
        F.sum(F.col("value") * (F.col("y") * 8 + F.col("x"))).alias("moment"))
    return rounded(out, "total", "peak", "moment")


@query("ingest_headers", cte("vox3") + """
SELECT DISTINCT concat(case_id, '/', z, '.nii') AS path, '8x8x1' AS shape, '2.0x2.0x5.0' AS spacing, 'float32' AS dtype FROM vox3""")
def ingest_headers(spark, sf):
    h = volumes.ingest_headers(slice_files(spark, sf))
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), "x")
    return h.select("path", text("shape").alias("shape"), text("spacing").alias("spacing"), "dtype")
