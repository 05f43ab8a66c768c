"""Classifier queries over the given tables, with the grids, iterations and components of the operators' defaults."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelcohort.operators import models, splits
from voxelcohort.operators.batch_models import Condition
from voxelcohort.plans import classifier
from voxelcohort.plans.catalog_metrics import rounded
from voxelcohort.plans.catalog_pixels import PREPARED_SQL
from voxelcohort.plans.registry import query
from voxelcohort.plans.views import view
from voxelcohort.session import cut_lineage, scratch_path

TARGET = 2000
MLP = models.MlpConfig()
SVM = models.RbfSvmConfig()


def fit_mlp(sample):
    return models.mlp_classifier(sample, MLP)


def fit_svm(sample):
    return models.rbf_svm_classifier(sample, SVM)


def pixels_of(spark, sf):
    return view(spark, sf, "img2").select("case_id", "row", "col", "value", "label")


def split_of(pixels):
    return splits.holdout_split(pixels.select("case_id"))


@query("scaler", f"""WITH pp AS ({PREPARED_SQL})
SELECT round(avg(intensity), 6) AS shift_intensity, round(stddev_pop(intensity), 6) AS scale_intensity,
  round(avg(run_45deg), 6) AS shift_run_45deg, round(stddev_pop(run_45deg), 6) AS scale_run_45deg FROM pp""")
def scaler(spark, sf):
    prepared = classifier.prepare_pixels(pixels_of(spark, sf))
    cols = [f"{p}_{f}" for f in ("intensity", "run_45deg") for p in ("shift", "scale")]
    return rounded(models.scaler_table(prepared, ["intensity", "run_45deg"], "standard").select(*cols), *cols)


@query("scaler_minmax", f"""WITH pp AS ({PREPARED_SQL})
SELECT round(min(intensity), 6) AS shift_intensity, round(max(intensity) - min(intensity), 6) AS scale_intensity FROM pp""")
def scaler_minmax(spark, sf):
    prepared = classifier.prepare_pixels(pixels_of(spark, sf))
    return rounded(models.scaler_table(prepared, ["intensity"], "minmax"), "shift_intensity", "scale_intensity")


def held_out(spark, sf):
    """A balanced sample of the training cases, and the pixels of the test cases."""
    pixels = pixels_of(spark, sf)
    prepared = cut_lineage(classifier.with_roles(classifier.prepare_pixels(pixels), split_of(pixels)))
    sample = splits.balanced_sample(prepared.where("role = 'train'"), "label", ["case_id", "row", "col"], TARGET)
    return cut_lineage(sample), prepared.where("role = 'test'")


@query("mlp_score")
def mlp_score(spark, sf):
    sample, test = held_out(spark, sf)
    return fit_mlp(sample).score(test).select("case_id", "row", "col", "score", "prediction")


@query("svm_score")
def svm_score(spark, sf):
    sample, test = held_out(spark, sf)
    return fit_svm(sample).score(test).select("case_id", "row", "col", "score", "prediction")


@query("train_eval")
def train_eval(spark, sf):
    pixels = pixels_of(spark, sf)
    rows = classifier.train_eval(pixels, split_of(pixels), {"mlp": fit_mlp, "svm": fit_svm}, target=TARGET)
    return rounded(classifier.summarize(rows), *[f"{m}_{s}" for m in classifier.SCORES for s in ("mean", "std")])


@query("pixel_leakage_eval")
def pixel_leakage_eval(spark, sf):
    return classifier.summarize(classifier.pixel_leakage_eval(pixels_of(spark, sf), fit_svm, 0.7, 0.15, TARGET))


@query("histogram_eval")
def histogram_eval(spark, sf):
    pixels = pixels_of(spark, sf)
    return classifier.summarize(classifier.histogram_eval(pixels, split_of(pixels), fit_svm, "median_nearest", TARGET))


@query("morphology_sweep")
def morphology_sweep(spark, sf):
    pixels = pixels_of(spark, sf)
    conditions = [Condition(s, "all", models.RbfSvmConfig(scaler=s)) for s in classifier.MORPHOLOGY_SCALERS]
    scored = classifier.score_held_out(pixels, split_of(pixels), {"all": classifier.prepare_pixels}, conditions, TARGET)
    return classifier.morphology_sweep(scored, classifier.image_shapes(pixels))


@query("split_sweep")
def split_sweep(spark, sf):
    return classifier.split_sweep(spark, pixels_of(spark, sf), SVM, scratch_path(spark, "split-sweep"), target=TARGET)


@query("svm_sweep")
def svm_sweep(spark, sf):
    pixels = pixels_of(spark, sf)
    return classifier.svm_sweep(spark, pixels, split_of(pixels), scratch_path(spark, "svm-sweep"), target=TARGET)


@query("feature_sweep")
def feature_sweep(spark, sf):
    pixels = pixels_of(spark, sf)
    return classifier.feature_sweep(spark, pixels, split_of(pixels), SVM, scratch_path(spark, "feature-sweep"), TARGET)


@query("leakage_sweep")
def leakage_sweep(spark, sf):
    return classifier.leakage_sweep(spark, pixels_of(spark, sf), scratch_path(spark, "leakage-sweep"), TARGET)


@query("histogram_sweep")
def histogram_sweep(spark, sf):
    pixels = pixels_of(spark, sf)
    return classifier.histogram_sweep(spark, pixels, split_of(pixels), scratch_path(spark, "histogram-sweep"))


@query("choose_slices", """
WITH v AS (SELECT o_orderkey // 512 AS case_id, (o_orderkey % 512) // 64 AS z, (o_orderkey % 64) // 8 AS y, o_orderkey % 8 AS x, o_custkey, o_orderstatus = 'F' AND o_custkey % 5 = 0 AS ref FROM orders),
a AS (SELECT case_id, z, count(*) FILTER (ref) AS area FROM v GROUP BY ALL), p AS (SELECT case_id, arg_min(z, (-area, z)) AS z FROM a GROUP BY case_id)
SELECT v.case_id, y AS "row", x AS col, CAST(o_custkey % 100 AS DOUBLE) AS value, ref AS label FROM v JOIN p ON p.case_id = v.case_id AND p.z = v.z""")
def choose_slices(spark, sf):
    voxels = view(spark, sf, "vox3").select("case_id", "z", "y", "x", F.col("cbf").alias("value"), F.col("ref").alias("label"))
    return classifier.choose_slices(voxels)


