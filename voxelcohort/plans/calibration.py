"""Fold-isolated calibration and evaluation jobs composed from operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelcohort.operators import audits, incremental, masks, metrics, preprocess, splits
from voxelcohort.session import cut_lineage


def calibrate(
    volumes: DataFrame, val_folds: DataFrame, n_splits: int = 5, samples_per_case: int = 4096, seed: int = 2026,
    ct_channel: str = "ncct",
) -> dict[str, DataFrame]:
    """Head support, per-case samples, fold parameters, QC and violations of a cohort.

    ``volumes``: ``(case_id, channel, z, y, x, value)``. Cases that fail support QC block the fit.
    """
    ct = volumes.where(F.col("channel") == ct_channel).select("case_id", "z", "y", "x", "value")
    support, head = masks.head_support(ct)
    support = cut_lineage(support)
    qc = cut_lineage(masks.support_qc(support, head, masks.grid_shapes(ct)))
    found = masks.support_violations(ct, qc)
    inside = cut_lineage(volumes.join(support, ["case_id", "z", "y", "x"], "left_semi"))  # the sample passes over it more than once
    sample = cut_lineage(splits.support_sample(inside, samples_per_case, seed))
    params = preprocess.fit_normalization(sample, val_folds, n_splits, ct_channel)
    return {"support": support, "qc": qc, "violations": found, "sample": sample, "params": params}


def evaluate_stale(
    current: DataFrame, checkpoint: DataFrame, ref: DataFrame, pred: DataFrame, headers: DataFrame, schema_version: str
) -> DataFrame:
    """Metrics of the cases whose inputs changed since their checkpoint; only those masks are labelled.

    ``current``: signatures ``(case_id, signature)``.
    """
    todo = cut_lineage(incremental.stale_cases(current.select("case_id", "signature"), checkpoint, schema_version))
    only = lambda df: df.join(todo.select("case_id"), "case_id", "left_semi")
    rows = metrics.evaluate_cases(only(ref), only(pred), only(headers))
    return rows.join(todo, "case_id").withColumn("schema", F.lit(schema_version)).withColumn("status", F.lit("complete"))


def review_plan(qc: DataFrame, mtt_counts: DataFrame, priority: list, k: int = 6, limit: int = 16) -> tuple[DataFrame, DataFrame]:
    """Cohort coverage summary and the cases a reviewer should see."""
    joined = qc.select("case_id", "coverage").join(mtt_counts, "case_id", "left").fillna(0, ["mtt_nonfinite"])
    return audits.coverage_rollup(joined), audits.select_for_review(joined, priority, k, limit)
