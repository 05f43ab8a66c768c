"""Intensity, tensor and quality audits, review gates and public aggregates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelcohort.functions import (
    exact_quantiles,
    finite,
    violation,
    violations_of,
    violations_union,
)
from voxelcohort.operators.splits import stride_sample

VOLUME = ["case_id", "channel"]
QUANTILE_SAMPLE = 1_000_000
TENSOR_SAMPLE = 50_000
ABS_LIMITS = (6, 10, 30, 100, 1000)
NEAR_CONSTANT_STD = 1e-6
EXTREME = 10_000
ARM_TOLERANCE, ARM_CAP = 1e-5, 8.0001


def intensity_audit(voxels: DataFrame, sample: int | None = None, group: Sequence[str] = VOLUME) -> DataFrame:
    """Counts, extremes, population moments and quantiles of each volume.

    Quantiles are exact by default; ``sample`` takes every s-th finite voxel first.
    """
    v = F.col("value")
    ok = finite(v)
    good = F.when(ok, v)
    stats = voxels.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_voxels"),
        F.count_if(ok).alias("n_finite"),
        F.count_if(~ok).alias("n_nonfinite"),
        F.min(good).alias("min"),
        F.max(good).alias("max"),
        F.count_if(ok & (v < 0)).alias("n_negative"),
        F.count_if(ok & (v < -1000)).alias("n_below_minus_1000"),
        F.count_if(ok & (v < -EXTREME)).alias("n_below_minus_10000"),
        F.count_if(ok & (v > EXTREME)).alias("n_above_plus_10000"),
        F.avg(good).alias("mean"),
        F.stddev_pop(good).alias("std"),
    ).withColumn(
        "percent_negative", F.when(F.col("n_finite") > 0, F.round(100.0 * F.col("n_negative") / F.col("n_finite"), 6))
    )
    rows = voxels if sample is None else stride_sample(voxels, sample, "finite")
    quantiles = exact_quantiles(
        rows, group, "value", {"q001": 0.001, "q005": 0.005, "median": 0.5, "q995": 0.995, "q999": 0.999}
    )
    return stats.join(quantiles, list(group), "left")


def intensity_violations(audit: DataFrame) -> DataFrame:
    """Volumes without a finite voxel, and cases whose channels differ in size."""
    extents = audit.groupBy("case_id").agg(F.min("n_voxels").alias("lo"), F.max("n_voxels").alias("hi"))
    return violations_union([
        violation(audit.where("n_finite = 0"), "no_finite_voxel", F.concat_ws("/", *VOLUME), F.col("n_voxels")),
        violation(extents.where("lo <> hi"), "channel_extent", F.col("case_id"), F.concat_ws(" vs ", "lo", "hi")),
    ])


def audit_rollup(audit: DataFrame) -> DataFrame:
    """Per channel: patients, extremes and how many cases show each anomaly."""
    return audit.groupBy("channel").agg(
        F.count(F.lit(1)).alias("patients"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.count_if(F.col("n_nonfinite") > 0).alias("cases_nonfinite"),
        F.count_if(F.col("n_below_minus_10000") > 0).alias("cases_below_minus_10000"),
        F.sum("n_below_minus_10000").alias("voxels_below_minus_10000"),
        F.count_if(F.col("n_below_minus_1000") > 0).alias("cases_below_minus_1000"),
    )


def tensor_audit(
    voxels: DataFrame, shape: tuple[int, int, int] | None = None, sample: int = TENSOR_SAMPLE, group: Sequence[str] = VOLUME
) -> DataFrame:
    """Exact counts and moments of preprocessed tensors; grid-sampled quantiles when ``shape`` is given."""
    v = F.col("value")
    ok = finite(v)
    good = F.when(ok, v)
    std = F.stddev_pop(good)
    stats = voxels.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n_voxels"),
        F.count_if(ok).alias("n_finite"),
        F.count_if(F.isnan(v)).alias("n_nan"),
        F.count_if(v == float("inf")).alias("n_posinf"),
        F.count_if(v == float("-inf")).alias("n_neginf"),
        F.count_if(ok & (v == 0)).alias("n_zero"),
        *[F.count_if(ok & (F.abs(v) > t)).alias(f"n_abs_gt_{t}") for t in ABS_LIMITS],
        F.min(good).alias("min"),
        F.max(good).alias("max"),
        F.avg(good).alias("mean"),
        std.alias("std"),
        F.coalesce(std < NEAR_CONSTANT_STD, F.lit(False)).alias("near_constant"),
    )
    stats = stats.withColumn("n_nonfinite", F.col("n_voxels") - F.col("n_finite")).withColumn(
        "all_nonfinite", F.col("n_finite") == 0
    )
    rows = voxels if shape is None else stride_sample(voxels, sample, "grid", shape)
    quantiles = exact_quantiles(rows, group, "value", {"q001": 0.001, "q01": 0.01, "median": 0.5, "q99": 0.99, "q999": 0.999})
    return stats.join(quantiles, list(group), "left")


def join_raw_and_pre(raw: DataFrame, pre: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Raw and preprocessed audits side by side with prefixed columns; unmatched keys as violations."""
    named = lambda df, p: df.select(*VOLUME, *[F.col(c).alias(p + c) for c in df.columns if c not in VOLUME])
    joined = named(raw, "raw_").withColumn("_r", F.lit(1)).join(named(pre, "pre_").withColumn("_p", F.lit(1)), VOLUME, "full_outer")
    key = F.concat_ws("/", *VOLUME)
    found = violations_of(joined, [
        (F.col("_r").isNull(), "raw_missing", key, F.lit("")), (F.col("_p").isNull(), "pre_missing", key, F.lit("")),
    ])
    return joined.where("_r = 1 and _p = 1").drop("_r", "_p"), found


def qc_rollup(joined: DataFrame) -> DataFrame:
    """Per channel: raw and preprocessed anomaly counts."""
    return joined.groupBy("channel").agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(F.col("raw_n_nonfinite") > 0).alias("raw_cases_nonfinite"),
        F.count_if(F.col("pre_n_nonfinite") > 0).alias("pre_cases_nonfinite"),
        F.sum("pre_n_nonfinite").alias("pre_voxels_nonfinite"),
        F.count_if(F.col("pre_n_abs_gt_10") > 0).alias("pre_cases_abs_gt_10"),
        F.count_if(F.col("pre_n_abs_gt_100") > 0).alias("pre_cases_abs_gt_100"),
        F.sum("pre_n_abs_gt_100").alias("pre_voxels_abs_gt_100"),
        F.count_if("pre_near_constant").alias("pre_cases_near_constant"),
        F.count_if("pre_all_nonfinite").alias("pre_cases_all_nonfinite"),
        F.count_if(F.col("raw_n_below_minus_10000") > 0).alias("raw_cases_below_minus_10000"),
        F.min("pre_min").alias("pre_min"),
        F.max("pre_max").alias("pre_max"),
    )


def watchlist(joined: DataFrame, case_ids: Sequence, channel: str, columns: Sequence[str]) -> DataFrame:
    """Fixed priority cases of one channel with chosen columns, numbered in list order."""
    position = F.array_position(F.array(*[F.lit(c) for c in case_ids]), F.col("case_id"))
    return joined.where((F.col("channel") == channel) & F.col("case_id").isin(list(case_ids))).select(
        position.alias("position"), "case_id", *columns
    )


def support_anomalies(voxels: DataFrame, support: Column) -> DataFrame:
    """Non-finite and extreme raw values, in total and inside the support."""
    v = F.col("value")
    bad, low, high = ~finite(v), finite(v) & (v < -EXTREME), finite(v) & (v > EXTREME)
    return voxels.groupBy(*VOLUME).agg(
        F.count(F.lit(1)).alias("n_voxels"),
        F.count_if(bad).alias("nonfinite"),
        F.count_if(bad & support).alias("nonfinite_inside"),
        F.count_if(bad & ~support).alias("nonfinite_outside"),
        F.count_if(low).alias("below"),
        F.count_if(low & support).alias("below_inside"),
        F.count_if(high).alias("above"),
        F.count_if(high & support).alias("above_inside"),
    )


def flag_support(voxels: DataFrame, support: DataFrame) -> DataFrame:
    """Boolean ``support`` column from a sparse support mask."""
    key = ["case_id", "z", "y", "x"]
    inside = support.select(*key, F.lit(True).alias("support"))
    return voxels.join(inside, key, "left").withColumn("support", F.coalesce("support", F.lit(False)))


def compare_arms(single: DataFrame, multi: DataFrame, shared: str, tol: float = ARM_TOLERANCE, cap: float = ARM_CAP) -> DataFrame:
    """Per case: largest shared-channel difference, extents, finiteness and perfusion overshoot.

    ``single``: ``(case_id, z, y, x, value)``; ``multi`` adds ``channel``. One union and one
    voxel-keyed aggregation bring both arms together.
    """
    key = ["case_id", "z", "y", "x"]
    none = F.lit(None).cast("double")
    is_shared = F.col("channel") == shared
    rows = single.select(*key, F.lit(1).alias("a"), F.lit(0).alias("b"), F.col("value").alias("va"), none.alias("vb")).unionByName(
        multi.where(is_shared).select(*key, F.lit(0).alias("a"), F.lit(1).alias("b"), none.alias("va"), F.col("value").alias("vb"))
    )
    per_voxel = rows.groupBy(*key).agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.max("va").alias("va"), F.max("vb").alias("vb"))
    both_finite = finite(F.col("va")) & finite(F.col("vb"))
    shared_stats = per_voxel.groupBy("case_id").agg(
        F.max(F.when(both_finite, F.abs(F.col("va") - F.col("vb")))).alias("max_difference"),
        F.count_if((F.col("a") == 0) | (F.col("b") == 0)).alias("unpaired_voxels"),
        F.count_if((F.col("a") > 0) & ~finite(F.col("va"))).alias("nonfinite_single"),
    )
    v = F.col("value")
    extra = multi.groupBy("case_id").agg(
        F.count_if(~finite(v)).alias("nonfinite_multi"),
        F.max(F.when(~is_shared & finite(v), F.abs(v))).alias("max_abs"),
        F.count_if(~is_shared & finite(v) & (F.abs(v) > cap)).alias("over_cap"),
    )
    return shared_stats.join(extra, "case_id", "full_outer").withColumn("needs_review", F.col("over_cap") > 0).withColumn(
        "shared_equal", F.coalesce(F.col("max_difference") <= tol, F.lit(False))
    )


def arm_violations(compared: DataFrame) -> DataFrame:
    case = F.col("case_id")
    return violations_of(compared, [
        (~F.col("shared_equal"), "shared_channel_differs", case, F.lit("")),
        (F.coalesce("unpaired_voxels", F.lit(1)) > 0, "extent", case, F.col("unpaired_voxels")),
        (F.coalesce("nonfinite_single", F.lit(0)) + F.coalesce("nonfinite_multi", F.lit(0)) > 0, "not_finite", case, F.lit("")),
    ])


def coverage_rollup(qc: DataFrame, low: float = 0.10, high: float = 0.40) -> DataFrame:
    """Cohort coverage spread; ``qc``: ``(case_id, coverage, mtt_nonfinite)``."""
    one = qc.withColumn("_g", F.lit(0))
    stats = one.groupBy("_g").agg(
        F.count(F.lit(1)).alias("cases"),
        F.min("coverage").alias("coverage_min"),
        F.max("coverage").alias("coverage_max"),
        F.count_if(F.col("coverage") < low).alias("below_low"),
        F.count_if(F.col("coverage") > high).alias("above_high"),
        F.count_if(F.col("mtt_nonfinite") > 0).alias("cases_mtt_nonfinite"),
    )
    return stats.join(exact_quantiles(one, ["_g"], "coverage", {"coverage_median": 0.5}), "_g").drop("_g")


def select_for_review(qc: DataFrame, priority: Sequence, k: int = 6, limit: int = 16) -> DataFrame:
    """Priority cases, then the k lowest and k highest coverages, without repeats, at most ``limit``."""
    if limit < len(priority):
        raise ValueError("limit must keep every priority case")
    listed = F.array_position(F.array(*[F.lit(c) for c in priority]), F.col("case_id"))
    first = qc.where(F.col("case_id").isin(list(priority))).select("case_id", listed.cast("double").alias("o"), F.lit(0).alias("source"))
    lowest = qc.orderBy("coverage", "case_id").limit(k).select("case_id", F.col("coverage").alias("o"), F.lit(1).alias("source"))
    highest = qc.orderBy(F.col("coverage").desc(), F.col("case_id").desc()).limit(k).select(
        "case_id", F.col("coverage").alias("o"), F.lit(2).alias("source")
    )
    ranked = first.unionByName(lowest).unionByName(highest).groupBy("case_id").agg(F.min(F.struct("source", "o")).alias("_s"))
    return ranked.orderBy("_s", "case_id").limit(limit).select("case_id", F.col("_s.source").alias("source"))


REVIEW_COLUMNS = (
    "case_id", "overlay_filename", "decision", "brain_tissue_preserved", "extracranial_tissue_included",
    "correction_required", "reviewer", "review_date", "notes",
)


def review_violations(
    review: DataFrame, roster: DataFrame, today: Column | None = None, id_pattern: str = r"^sub_stroke\d{4}$", key: str = "case_id"
) -> DataFrame:
    """Everything that blocks a review worksheet: roster, file names, ids, decisions, sign-off.

    ``roster``: ``(case_id, overlay_filename)``; all review fields are strings. ``key`` names the column of both tables that
    tells cases apart, where written case ids are cut to a width and may be shared.
    """
    lacking = [c for c in REVIEW_COLUMNS if c not in review.columns]
    if lacking:
        raise ValueError(f"review lacks columns {lacking}")
    now = F.current_date() if today is None else today
    text = lambda c: F.upper(F.trim(F.coalesce(F.col(c), F.lit(""))))
    expected = roster.select(F.col(key).alias("_key"), F.col("case_id").alias("_id"), F.col("overlay_filename").alias("_file"))
    counts = review.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n"))
    rows = review.withColumn("_key", F.col(key))
    both = rows.join(expected, "_key", "full_outer").join(counts, "_key", "left").withColumn("case_id", F.coalesce("case_id", "_id"))
    case = F.col("case_id")
    reviewed, listed = F.col("_n").isNotNull(), F.col("_file").isNotNull()
    decision = text("decision")
    approved = reviewed & (decision == "APPROVED")
    fields = (
        (text("brain_tissue_preserved") == "YES") & (text("correction_required") == "NO")
        & text("extracranial_tissue_included").isin("NO", "ACCEPTABLE")
    )
    signed = (text("reviewer") != "") & (text("review_date") != "")
    day = F.when(F.trim("review_date").rlike(r"^\d{4}-\d{2}-\d{2}$"), F.expr("try_to_date(trim(review_date), 'yyyy-MM-dd')"))
    return violations_of(both.distinct(), [
        (~reviewed, "review_missing", case, F.lit("")),
        (reviewed & ~listed, "review_unexpected", case, F.lit("")),
        (F.col("_n") > 1, "review_repeated", case, F.col("_n")),
        (reviewed & listed & ~F.col("overlay_filename").eqNullSafe(F.col("_file")), "overlay_filename", case, F.col("overlay_filename")),
        (reviewed & ~case.cast("string").rlike(id_pattern), "case_id_form", case, F.lit("")),
        (reviewed & ~approved, "decision", case, F.when(decision == "", F.lit("(blank)")).otherwise(decision)),
        (approved & ~fields, "approval_fields", case, F.lit("")),
        (approved & ~signed, "sign_off_missing", case, F.lit("")),
        (approved & signed & day.isNull(), "review_date_invalid", case, F.col("review_date")),
        (approved & signed & (day > now), "review_date_future", case, F.col("review_date")),
    ])


def review_decisions(review: DataFrame) -> DataFrame:
    return review.groupBy(F.upper(F.trim(F.coalesce(F.col("decision"), F.lit("")))).alias("decision")).agg(
        F.count(F.lit(1)).alias("cases")
    )


def param_violations(params: DataFrame, folds: DataFrame, channels: Sequence[str], samples_per_case: int = 4096) -> DataFrame:
    """Fitted parameters against the folds they claim: channels, case counts, samples, ranges.

    ``params``: ``(fold, channel, clip_low, clip_high, center, scale, n_cases, n_samples)``.
    """
    n_train = folds.where("role = 'train'").groupBy("fold").agg(F.count_distinct("case_id").alias("n_train"))
    need = n_train.select("fold", "n_train", F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel"))
    both = need.join(params, ["fold", "channel"], "full_outer")
    key, none = F.concat_ws("/", "fold", "channel"), F.lit("")
    there = F.col("n_cases").isNotNull()
    all_finite = finite(F.col("clip_low")) & finite(F.col("clip_high")) & finite(F.col("center")) & finite(F.col("scale"))
    return violations_of(both, [
        (~there, "channel_missing", key, none),
        (F.col("n_train").isNull(), "channel_unexpected", key, none),
        (there & (F.col("n_cases") != F.col("n_train")), "training_cases", key, F.col("n_cases")),
        (there & (F.col("n_samples") != F.col("n_train") * samples_per_case), "sample_count", key, F.col("n_samples")),
        (there & ~all_finite, "parameter_not_finite", key, none),
        (there & all_finite & ~(F.col("clip_low") < F.col("clip_high")), "clip_bounds", key, none),
        (there & all_finite & ~(F.col("scale") > 0), "scale", key, none),
    ])


def training_id_violations(used: DataFrame, folds: DataFrame) -> DataFrame:
    """Ids a fit used ``(fold, case_id)`` must be exactly the fold's training ids."""
    train = folds.where("role = 'train'").select("fold", "case_id").distinct().withColumn("_t", F.lit(1))
    both = used.select("fold", "case_id").distinct().withColumn("_u", F.lit(1)).join(train, ["fold", "case_id"], "full_outer")
    key = F.concat_ws("/", "fold", "case_id")
    return violations_of(both, [
        (F.col("_t").isNull(), "fit_used_other_case", key, F.lit("")), (F.col("_u").isNull(), "fit_missed_case", key, F.lit("")),
    ])


def param_ranges(params: DataFrame) -> DataFrame:
    """Spread of each fitted parameter across folds."""
    names = ("clip_low", "clip_high", "center", "scale")
    pairs = ", ".join(f"'{n}', {n}" for n in names)
    long = params.selectExpr("channel", f"stack({len(names)}, {pairs}) as (parameter, value)")
    return long.groupBy("channel", "parameter").agg(F.min("value").alias("low"), F.max("value").alias("high"))


def expectation_violations(report: DataFrame, expected: DataFrame) -> DataFrame:
    """Declared values ``(name, value)`` that an earlier report does not repeat exactly."""
    got = report.select("name", F.col("value").cast("string").alias("got"), F.lit(1).alias("_r"))
    both = expected.select("name", F.col("value").cast("string").alias("want")).join(got, "name", "left")
    return violations_of(both, [
        (F.col("_r").isNull(), "value_missing", F.col("name"), F.col("want")),
        (F.col("_r").isNotNull() & ~F.col("want").eqNullSafe(F.col("got")), "value_differs", F.col("name"), F.concat_ws(" vs ", "got", "want")),
    ])


def release_gate(violations: Sequence[DataFrame]) -> DataFrame:
    """Blockers by check, with a last row that says whether the release is ready."""
    per_check = violations_union(violations).groupBy("check").agg(F.count(F.lit(1)).alias("blockers"))
    total = per_check.agg(F.coalesce(F.sum("blockers"), F.lit(0)).alias("blockers")).select(F.lit("total").alias("check"), "blockers")
    return per_check.unionByName(total).withColumn("ready", F.col("blockers") == 0)


def transform_qc(before: DataFrame, after: DataFrame, roles: DataFrame, cap: float = ARM_CAP) -> DataFrame:
    """Per case and channel: anomalies before, range after, values over the cap, split role.

    Both: ``(case_id, channel, z, y, x, value)``; ``before`` also has ``support``.
    """
    raw = support_anomalies(before, F.col("support")).select("case_id", "channel", "n_voxels", "nonfinite", "nonfinite_inside")
    v = F.col("value")
    done = after.groupBy(*VOLUME).agg(
        F.min(v).alias("after_min"), F.max(v).alias("after_max"), F.count_if(F.abs(v) > cap).alias("after_over_cap"),
        F.count_if(~finite(v)).alias("after_nonfinite"),
    )
    return raw.join(done, VOLUME).join(roles.select("case_id", "role"), "case_id")


def redact(df: DataFrame, public_keys: Sequence[str], private: Sequence[str], min_group: int | None = None) -> DataFrame:
    """Counts by public keys only; private columns never reach the output.

    Small groups are kept unless ``min_group`` is given.
    """
    leaked = set(public_keys) & set(private)
    if leaked:
        raise ValueError(f"private columns requested: {sorted(leaked)}")
    out = df.drop(*private).groupBy(*public_keys).agg(F.count(F.lit(1)).alias("cases"))
    return out if min_group is None else out.where(F.col("cases") >= min_group)


def refresh_roster(required: DataFrame, existing: DataFrame, fields: Mapping[str, str]) -> tuple[DataFrame, DataFrame]:
    """Worksheet rows for the required roster; reviewers' edits stay, new rows get the defaults.

    An existing worksheet over another case set is reported.
    """
    old = existing.select("case_id", *[F.col(f).alias(f"_{f}") for f in fields], F.lit(1).alias("_o"))
    both = required.select("case_id", F.lit(1).alias("_n")).join(old, "case_id", "full_outer")
    rows = both.where("_n = 1").select("case_id", *[F.coalesce(F.col(f"_{f}"), F.lit(v)).alias(f) for f, v in fields.items()])
    found = violations_of(both, [
        (F.col("_n").isNull(), "roster_dropped", F.col("case_id"), F.lit("")),
        (F.col("_o").isNull(), "roster_added", F.col("case_id"), F.lit("")),
    ])
    return rows, found
