"""Structured text inputs: fold summaries, split files, keyed CSV and progress logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelcohort.functions import finite, violations_of

METRIC = T.StructType([
    T.StructField("Dice", T.DoubleType()), T.StructField("n_pred", T.LongType()), T.StructField("n_ref", T.LongType()),
])
SUMMARY_SCHEMA = T.StructType([
    T.StructField("metric_per_case", T.ArrayType(T.StructType([
        T.StructField("prediction_file", T.StringType()),
        T.StructField("reference_file", T.StringType()),
        T.StructField("metrics", T.MapType(T.StringType(), METRIC)),
    ]))),
])
SPLIT_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("train", T.ArrayType(T.StringType())), T.StructField("val", T.ArrayType(T.StringType())),
]))
PROGRESS_PATTERN = r"\[(\d+)/\d+\] (\S+) (?:COMPUTED|CACHED) support=([0-9.]+)%"


def file_case_id(path: Column) -> Column:
    """File name without its folders and ``.nii.gz``."""
    return F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.nii\.gz$", "")


def read_fold_summaries(spark: SparkSession, path: str) -> DataFrame:
    """Per-case rows of nested fold summary files (one JSON document a file)."""
    text = spark.read.text(path, wholetext=True)
    return parse_fold_summaries(text.withColumn("fold", F.regexp_extract(F.input_file_name(), r"fold_?(\d+)", 1).try_cast("int")))


def parse_fold_summaries(documents: DataFrame, text: str = "value") -> DataFrame:
    """``(fold, value)`` JSON text to ``(fold, case_id, dice, n_pred, n_ref)`` of class 1."""
    doc = documents.withColumn("_doc", F.from_json(text, SUMMARY_SCHEMA))
    row = doc.select("fold", F.explode("_doc.metric_per_case").alias("_r"))
    one = F.try_element_at(F.col("_r.metrics"), F.lit("1"))
    return row.select(
        "fold", file_case_id(F.coalesce("_r.reference_file", "_r.prediction_file")).alias("case_id"),
        one["Dice"].alias("dice"), one["n_pred"].alias("n_pred"), one["n_ref"].alias("n_ref"),
    )


def summary_violations(rows: DataFrame, known: DataFrame) -> DataFrame:
    """Repeated, unknown or missing ids and non-finite scores of parsed summaries."""
    per_case = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(~finite(F.col("dice"))).alias("bad"))
    both = per_case.join(known.select(F.col("case_id").cast("string")).distinct().withColumn("_k", F.lit(1)), "case_id", "full_outer")
    case = F.col("case_id")
    return violations_of(both, [
        (F.col("n") > 1, "case_repeated", case, F.col("n")),
        (F.col("_k").isNull(), "case_unknown", case, F.lit("")),
        (F.col("n").isNull(), "case_missing", case, F.lit("")),
        (F.col("bad") > 0, "score_not_finite", case, F.col("bad")),
    ])


def read_splits(spark: SparkSession, path: str) -> DataFrame:
    """Split file ``[{train: [], val: []}]`` as ``(fold, role, pos, case_id)``."""
    return parse_splits(spark.read.text(path, wholetext=True))


def parse_splits(documents: DataFrame, text: str = "value", keep: Sequence[str] = ()) -> DataFrame:
    folds = documents.select(*keep, F.posexplode(F.from_json(text, SPLIT_SCHEMA)).alias("fold", "_f"))
    roles = folds.select(*keep, "fold", F.explode(F.array(
        F.struct(F.lit("train").alias("role"), F.col("_f.train").alias("ids")),
        F.struct(F.lit("val").alias("role"), F.col("_f.val").alias("ids")),
    )).alias("_r"))
    return roles.select(*keep, "fold", F.col("_r.role").alias("role"), F.posexplode("_r.ids").alias("pos", "case_id"))


def split_file_violations(documents: DataFrame, text: str = "value", key: str | None = None) -> DataFrame:
    """Folds whose validation list is empty or absent."""
    folds = documents.select(F.col(key) if key else F.lit("splits").alias("_k"), F.posexplode(F.from_json(text, SPLIT_SCHEMA)).alias("fold", "_f"))
    name = F.concat_ws("/", folds.columns[0], "fold")
    return violations_of(folds, [(F.coalesce(F.size("_f.val"), F.lit(0)) <= 0, "val_empty", name, F.lit(""))])


def read_keyed_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """CSV with a declared schema; a row that does not fit fails the read."""
    return spark.read.schema(schema).option("header", "true").option("mode", "FAILFAST").option("enforceSchema", "false").csv(path)


def parse_progress_log(lines: DataFrame, pattern: str = PROGRESS_PATTERN) -> DataFrame:
    """Last reported percentage per case from ``(line_no, value)`` text lines."""
    got = lines.withColumn("case_id", F.regexp_extract("value", pattern, 2)).where("case_id <> ''")
    percent = F.regexp_extract("value", pattern, 3).try_cast("double")
    return got.groupBy("case_id").agg(F.max_by(percent, "line_no").alias("support_percent"), F.count(F.lit(1)).alias("mentions"))


def progress_count_violations(progress: DataFrame, expected: int) -> DataFrame:
    n = progress.agg(F.count(F.lit(1)).alias("n"))
    return violations_of(n, [(F.col("n") != expected, "case_count", F.lit("log"), F.col("n"))])
