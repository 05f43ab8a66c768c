"""Imaging-shaped views over the given tables, for Spark and for the SQL checks.

``{div}`` is integer division (``div`` in Spark, ``//`` in DuckDB). Whole tables are
used: the last case of a grid may be incomplete, as a cropped acquisition would be.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelcohort.session import cut_lineage, small_side

VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "vox3": (("orders",), """
SELECT k {div} 512 AS case_id, (k % 512) {div} 64 AS z, (k % 64) {div} 8 AS y, k % 8 AS x, k,
  CASE WHEN cu % 3 = 0 THEN CAST(-1000 AS DOUBLE) ELSE p / 1000 - 250 END AS ncct,
  p / 5000 AS tmax, CAST(cu % 100 AS DOUBLE) AS cbf, p / 100000 AS cbv,
  CASE WHEN k % 97 = 0 THEN CAST('NaN' AS DOUBLE) WHEN k % 101 = 0 THEN CAST('Infinity' AS DOUBLE)
       WHEN k % 103 = 0 THEN CAST(-20000 AS DOUBLE) ELSE p / 50000 END AS mtt,
  (s = 'F' AND cu % 5 = 0) AS ref,
  ((s = 'F' AND cu % 10 = 0) OR (s = 'P' AND cu % 11 = 0)) AS pred, p AS score
FROM (SELECT o_orderkey k, o_custkey cu, o_totalprice p, o_orderstatus s FROM {orders}) o"""),
    "img2": (("orders",), """
SELECT k {div} 256 AS case_id, (k % 256) {div} 16 AS "row", k % 16 AS col,
  CASE WHEN cu % 7 = 0 THEN CAST(0 AS DOUBLE) ELSE p / 15000 END AS value,
  (s = 'F' AND cu % 3 = 0) AS label, p AS score
FROM (SELECT o_orderkey k, o_custkey cu, o_totalprice p, o_orderstatus s FROM {orders}) o"""),
    "arms": (("lineitem",), """
SELECT l_suppkey AS case_id, l_suppkey % 5 AS fold, sum(l_quantity) / 1000 AS reference_volume_ml,
  avg(l_discount) * 10 AS a_dice, avg(l_tax) * 12 AS b_dice,
  abs(sum(l_extendedprice * (l_discount - CAST(0.05 AS DOUBLE)))) / 1000 AS a_avd,
  abs(sum(l_extendedprice * (l_tax - CAST(0.04 AS DOUBLE)))) / 1000 AS b_avd
FROM {lineitem} GROUP BY l_suppkey"""),
    "trace": (("events",), """
SELECT user_id AS run_id, event_id AS seq, ts,
  CASE event_type WHEN 'view' THEN 'train_image_open' WHEN 'click' THEN 'train_label_open'
       WHEN 'purchase' THEN 'archive_receipt' WHEN 'signup' THEN 'outer_inference_image_open'
       ELSE 'prohibited' END AS type, event_id % 149 AS case_id FROM {events}"""),
    "hdr": (("supplier",), """
SELECT s_suppkey AS case_id, c AS channel, CAST(1 AS DOUBLE) + s_nationkey / CAST(100 AS DOUBLE) AS sp,
  CASE WHEN s_suppkey % 4 = c AND c > 0 THEN CAST(0.0000158 AS DOUBLE)
       WHEN s_suppkey % 7 = c AND c > 0 THEN CAST(0.001 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS skew
FROM {supplier} CROSS JOIN (SELECT 0 AS c UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4) ch"""),
    "files": (("orders",), """
SELECT o_custkey AS case_id, o_orderkey AS name, CAST(floor(o_totalprice * 100) AS BIGINT) AS size,
  o_orderdate AS mtime FROM {orders}"""),
    "paths": (("customer",), """
SELECT c_custkey, concat('train/rawdata/sub-strokecase', lpad(CAST(c_custkey AS STRING), 6, '0'), '/ses-0001/a_',
  CASE c_mktsegment WHEN 'BUILDING' THEN 'ncct' WHEN 'MACHINERY' THEN 'ctp' ELSE 'dwi' END, '.nii.gz') AS path
FROM {customer}"""),
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view as a DataFrame. ``hdr`` repeats a row per channel without a cross join."""
    if name == "hdr":
        return table(spark, sf_dir, "supplier").selectExpr(
            "s_suppkey AS case_id", "explode(sequence(0, 4)) AS channel",
            "1D + s_nationkey / 100D AS sp", "s_suppkey",
        ).selectExpr(
            "case_id", "channel", "sp",
            "CASE WHEN s_suppkey % 4 = channel AND channel > 0 THEN 0.0000158D "
            "WHEN s_suppkey % 7 = channel AND channel > 0 THEN 0.001D ELSE 0D END AS skew",
        )
    tables, text = VIEW_SQL[name]
    frames = {t: table(spark, sf_dir, t) for t in tables}
    text = text.replace("{div}", "div").replace('"row"', "row")
    return spark.sql(text, **frames)


def settled_arms(spark: SparkSession, sf_dir: str, near: Column) -> DataFrame:
    """The view ``arms`` for comparisons with a bound: cases ``near`` it are summed in the order of the table's rows.

    A sum of doubles depends on the order of its rows, by which an exact tie falls on either side. Partial sums follow the
    layout of files and tasks; the order of the rows in the files does not.
    """
    arms = cut_lineage(view(spark, sf_dir, "arms"))
    cases = small_side(arms.where(near).select("case_id"))
    tables, text = VIEW_SQL["arms"]
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    rows = table(spark, sf_dir, *tables).select("*", *place).join(cases, F.col("l_suppkey") == F.col("case_id"), "left_semi")
    ordered = rows.repartition("l_suppkey").sortWithinPartitions("l_suppkey", "_file", "_row")
    return arms.join(cases, "case_id", "left_anti").unionByName(spark.sql(text, **{tables[0]: ordered}))


def cte(*names: str) -> str:
    """``WITH`` prefix that defines the named views in DuckDB."""
    parts = []
    for name in names:
        tables, text = VIEW_SQL[name]
        text = text.replace("{div}", "//").replace("STRING", "VARCHAR")
        for t in tables:
            text = text.replace("{" + t + "}", t)
        parts.append(f"{name} AS ({text})")
    return "WITH " + ", ".join(parts)
