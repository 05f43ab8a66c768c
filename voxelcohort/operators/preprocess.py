"""Image preprocessing, slice choice, histogram matching and fold-isolated normalisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelcohort.functions import (
    exact_quantiles,
    finite,
    prefix_sums,
    value_bucket,
    violation,
    violations_of,
    violations_union,
)
from voxelcohort.operators.masks import brain_mask
from voxelcohort.session import small_side

# Fixed values of the normalisation rule.
CLIP_LOW_Q, CLIP_HIGH_Q = 0.005, 0.995
IQR_TO_SIGMA = 1.349
MIN_SCALE = 1e-6
MIN_CASE_SAMPLES = 16
Z_CAP = 8.0
Z_AUDIT = 8.000001


def median_filter(pixels: DataFrame, size: int = 3, image: Sequence[str] = ("case_id",)) -> DataFrame:
    """Square median filter with the nearest edge repeated; zero outside the brain.

    Adds ``brain`` and replaces ``value``.
    """
    if size < 1 or size % 2 == 0:
        raise ValueError("size must be a positive odd number")
    r = size // 2

    def neighbours(column: str, line_key: str, order: str):
        ahead = W.partitionBy(*image, line_key).orderBy(order)
        whole = ahead.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        cells = [F.coalesce(F.lag(column, k).over(ahead), F.first(column).over(whole)) for k in range(r, 0, -1)]
        cells.append(F.col(column))
        cells += [F.coalesce(F.lead(column, k).over(ahead), F.last(column).over(whole)) for k in range(1, r + 1)]
        return F.array(*cells)

    block = F.array_sort(F.flatten(F.col("_block")))
    brain = brain_mask(F.col("value"))
    return (
        pixels.withColumn("_strip", neighbours("value", "row", "col"))
        .withColumn("_block", neighbours("_strip", "col", "row"))
        .withColumn("brain", brain)
        .withColumn("value", F.when(brain, F.get(block, F.lit(size * size // 2))).otherwise(0.0))
        .drop("_strip", "_block")
    )


def rescale_uint8(
    pixels: DataFrame, low: float = 1.0, high: float = 99.0, image: Sequence[str] = ("case_id",)
) -> DataFrame:
    """Brain percentiles mapped to 0..255, clipped; zero outside and in flat images."""
    bounds = exact_quantiles(pixels.where("brain"), image, "value", {"_lo": low / 100, "_hi": high / 100})
    unit = (F.col("value") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
    scaled = F.when(F.col("brain") & (F.col("_hi") > F.col("_lo")), F.least(F.greatest(unit, F.lit(0.0)), F.lit(1.0)) * 255.0)
    return (
        pixels.join(small_side(bounds), list(image), "left")
        .withColumn("value", F.coalesce(scaled, F.lit(0.0)))
        .drop("_lo", "_hi")
    )


def zscore_brain(pixels: DataFrame, image: Sequence[str] = ("case_id",)) -> DataFrame:
    """Brain pixels standardised by their population deviation; zero outside and in flat images."""
    stats = pixels.where("brain").groupBy(*image).agg(F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    z = F.when(F.col("brain") & (F.col("_s") > 0), (F.col("value") - F.col("_m")) / F.col("_s"))
    return pixels.join(small_side(stats), list(image), "left").withColumn("value", F.coalesce(z, F.lit(0.0))).drop("_m", "_s")


def preprocess(pixels: DataFrame, mode: str = "paper_minimal", size: int = 3, image: Sequence[str] = ("case_id",)) -> DataFrame:
    """Median filter, then the intensity rule named by ``mode``."""
    filtered = median_filter(pixels, size, image)
    if mode == "paper_minimal":
        return filtered
    if mode == "robust_uint8":
        return rescale_uint8(filtered, image=image)
    if mode == "zscore_brain":
        return zscore_brain(filtered, image)
    raise ValueError(f"unknown mode {mode}")


def pick_slice(voxels: DataFrame, mode: str = "max_lesion") -> DataFrame:
    """One slice a case: largest lesion (``label``), or the middle non-empty slice (``value``)."""
    if mode == "max_lesion":
        area = voxels.groupBy("case_id", "z").agg(F.count_if(F.col("label").cast("int") > 0).alias("area"))
        return area.groupBy("case_id").agg(
            F.min_by("z", F.struct((-F.col("area")).alias("a"), F.col("z").alias("z"))).alias("z")
        )
    if mode == "middle_brain":
        filled = voxels.groupBy("case_id", "z").agg(F.bool_or(brain_mask(F.col("value"))).alias("any"))
        listed = filled.groupBy("case_id").agg(  # one entry a slice
            F.array_sort(F.collect_list(F.when(F.col("any"), F.col("z")))).alias("zs"), (F.max("z") + 1).alias("depth")
        )
        middle = F.get("zs", F.expr("int(size(zs) div 2)"))
        return listed.select("case_id", F.coalesce(middle, F.expr("depth div 2")).alias("z"))
    raise ValueError(f"unknown mode {mode}")


def histogram_match(source: DataFrame, reference: DataFrame, bins: int = 4096) -> DataFrame:
    """Source values ``(case_id, .., value)`` mapped onto the reference ``(value)`` distribution.

    Both sides shrink to counted values. The as-of lookup of each source quantile among the
    reference quantiles runs inside quantile bins, so neither a large case nor the reference
    lands in one task; bins pass their edge points on through a table of ``bins`` rows.
    """
    counted = source.groupBy("case_id", "value").agg(F.count(F.lit(1)).alias("_n"))
    src = prefix_sums(counted, ["case_id"], "value", value_bucket(F.col("value")), {"_below": "_n"}, {"_all": "_n"})
    ref_counted = reference.groupBy("value").agg(F.count(F.lit(1)).alias("_n"))
    ref = prefix_sums(ref_counted, [], "value", value_bucket(F.col("value")), {"_below": "_n"}, {"_all": "_n"})
    q = ((F.col("_below") + F.col("_n")) / F.col("_all")).alias("q")
    point = F.struct(F.col("q"), F.col("value").alias("v"))
    rows = ref.select(F.lit(0).alias("kind"), F.lit(None).cast(source.schema["case_id"].dataType).alias("case_id"), q, "value")
    rows = rows.unionByName(src.select(F.lit(1).alias("kind"), "case_id", q, "value"))
    rows = rows.withColumn("_bin", F.floor(F.col("q") * bins)).withColumn("_pt", F.when(F.col("kind") == 0, point))
    edges = rows.groupBy("_bin").agg(F.min("_pt").alias("_lo"), F.max("_pt").alias("_hi"))
    by_bin = W.orderBy("_bin")
    edges = edges.select(
        "_bin",
        F.last("_hi", ignorenulls=True).over(by_bin.rowsBetween(W.unboundedPreceding, -1)).alias("_carry_lo"),
        F.last("_lo", ignorenulls=True).over(W.orderBy(F.col("_bin").desc()).rowsBetween(W.unboundedPreceding, -1)).alias("_carry_hi"),
    )
    up = W.partitionBy("_bin").orderBy("q", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    down = W.partitionBy("_bin").orderBy(F.col("q").desc(), F.col("kind").desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    placed = (
        rows.join(edges, "_bin")
        .withColumn("_a", F.coalesce(F.last("_pt", ignorenulls=True).over(up), F.col("_carry_lo")))
        .withColumn("_b", F.coalesce(F.last("_pt", ignorenulls=True).over(down), F.col("_carry_hi")))
        .where("kind = 1")
    )
    a, b = F.col("_a"), F.col("_b")
    between = a["v"] + (b["v"] - a["v"]) * (F.col("q") - a["q"]) / (b["q"] - a["q"])
    mapped = F.when(a.isNull(), b["v"]).when(b.isNull(), a["v"]).otherwise(between)
    return source.join(placed.select("case_id", "value", mapped.alias("matched")), ["case_id", "value"])


def histogram_violations(source: DataFrame, reference: DataFrame) -> DataFrame:
    """Matching needs non-empty, finite inputs on both sides."""
    bad = source.groupBy("case_id").agg(F.count_if(~finite(F.col("value"))).alias("n")).where("n > 0")
    ref = reference.agg(F.count(F.lit(1)).alias("n"), F.count_if(~finite(F.col("value"))).alias("bad"))
    return violations_union([
        violation(bad, "source_not_finite", F.col("case_id"), F.col("n")),
        violation(ref.where("n = 0"), "reference_empty", F.lit("reference"), F.col("n")),
        violation(ref.where("bad > 0"), "reference_not_finite", F.lit("reference"), F.col("bad")),
    ])


def reference_case(pixels: DataFrame, train: DataFrame, mode: str = "median_nearest") -> DataFrame:
    """The histogram reference: first training case, or the one with the most typical brain median."""
    ids = train.select("case_id").distinct()
    if mode == "first":
        return ids.agg(F.min("case_id").alias("case_id"))
    if mode != "median_nearest":
        raise ValueError(f"unknown mode {mode}")
    brain = pixels.where(brain_mask(F.col("value"))).join(ids, "case_id", "left_semi")
    medians = exact_quantiles(brain, ["case_id"], "value", {"median": 0.5}).withColumn("_g", F.lit(0))
    centre = exact_quantiles(medians, ["_g"], "median", {"_c": 0.5})
    distance = F.struct(F.abs(F.col("median") - F.col("_c")).alias("d"), F.col("case_id").alias("c"))
    return medians.join(F.broadcast(centre), "_g").groupBy("_g").agg(  # centre is one row
        F.min_by("case_id", distance).alias("case_id")
    ).select("case_id")


def fit_normalization(samples: DataFrame, val_folds: DataFrame, n_splits: int = 5, ct_channel: str = "ncct") -> DataFrame:
    """Clip bounds, centre and scale per fold and channel from that fold's training cases only.

    ``samples``: ``(case_id, channel, value)``; ``val_folds``: ``(case_id, fold)``. Values are
    counted per validation fold before they are repeated for the folds that train on them.
    """
    tagged = samples.where(finite(F.col("value"))).join(val_folds.select("case_id", F.col("fold").alias("_val")), "case_id")
    others = F.filter(F.sequence(F.lit(0), F.lit(n_splits - 1)), lambda f: f != F.col("_val"))
    counted = tagged.groupBy("_val", "channel", "value").agg(F.count(F.lit(1)).alias("_w")).withColumn("fold", F.explode(others))
    q = exact_quantiles(
        counted, ["fold", "channel"], "value",
        {"clip_low": CLIP_LOW_Q, "_q25": 0.25, "_q50": 0.5, "_q75": 0.75, "clip_high": CLIP_HIGH_Q}, weight="_w",
    )
    moments = tagged.withColumn("fold", F.explode(others)).groupBy("fold", "channel").agg(
        F.avg("value").alias("_mean"), F.stddev_pop("value").alias("_sd"), F.count(F.lit(1)).alias("n_samples"),
    )
    n_cases = val_folds.select("case_id", F.col("fold").alias("_val")).withColumn("fold", F.explode(others)).groupBy("fold").agg(
        F.count(F.lit(1)).alias("n_cases")
    )
    ct = F.col("channel") == ct_channel
    return q.join(moments, ["fold", "channel"]).join(n_cases, "fold").select(
        "fold", "channel", "clip_low", "clip_high",
        F.when(ct, F.col("_mean")).otherwise(F.col("_q50")).alias("center"),
        F.when(ct, F.col("_sd")).otherwise((F.col("_q75") - F.col("_q25")) / IQR_TO_SIGMA).alias("scale"),
        "n_cases", "n_samples", F.when(~ct, F.lit(Z_CAP)).alias("z_cap"),
    )


def fit_normalization_sketch(samples: DataFrame, val_folds: DataFrame, n_splits: int = 5, k: int = 800) -> DataFrame:
    """Approximate clip bounds and median per fold and channel, reading the data once.

    One quantile sketch per validation fold and channel; a fold's training sketch merges the
    other folds' sketches, so nothing is repeated per fold. Rank error is about 1/k.
    """
    tagged = samples.where(finite(F.col("value"))).join(val_folds.select("case_id", F.col("fold").alias("_val")), "case_id")
    parts = tagged.groupBy("_val", "channel").agg(
        F.kll_sketch_agg_double("value", F.lit(k)).alias("_sk"), F.count(F.lit(1)).alias("_n")
    )
    others = F.filter(F.sequence(F.lit(0), F.lit(n_splits - 1)), lambda f: f != F.col("_val"))
    merged = parts.withColumn("fold", F.explode(others)).groupBy("fold", "channel").agg(
        F.kll_merge_agg_double("_sk", F.lit(k)).alias("_sk"), F.sum("_n").alias("n_samples")
    )
    at = lambda p: F.kll_sketch_get_quantile_double("_sk", F.lit(p))
    return merged.select(
        "fold", "channel", at(CLIP_LOW_Q).alias("clip_low"), at(CLIP_HIGH_Q).alias("clip_high"), at(0.5).alias("median"),
        ((at(0.75) - at(0.25)) / IQR_TO_SIGMA).alias("robust_scale"), "n_samples",
    )


def fit_violations(samples: DataFrame, val_folds: DataFrame, params: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Too few samples in a case, cases outside the folds or without samples, degenerate parameters."""
    per_case = samples.groupBy("case_id", "channel").agg(F.count_if(finite(F.col("value"))).alias("n"))
    need = val_folds.select("case_id", F.explode(F.array(*[F.lit(c) for c in channels])).alias("channel")).withColumn("_e", F.lit(1))
    both = need.join(per_case, ["case_id", "channel"], "full_outer")
    key = F.concat_ws("/", "case_id", "channel")
    fold_key = F.concat_ws("/", "fold", "channel")
    return violations_union([
        violations_of(both, [
            (F.col("_e").isNull(), "case_not_in_folds", key, F.lit("")),
            (F.col("n").isNull(), "case_without_samples", key, F.lit("")),
            (F.col("_e").isNotNull() & (F.col("n") < MIN_CASE_SAMPLES), "too_few_samples", key, F.col("n")),
        ]),
        violations_of(params, [
            (~(F.col("clip_low") < F.col("clip_high")), "clip_bounds", fold_key, F.lit("")),
            (~finite(F.col("scale")) | (F.col("scale") < MIN_SCALE), "scale", fold_key, F.lit("")),
        ]),
    ])


def apply_normalization(voxels: DataFrame, params: DataFrame, ct_channel: str = "ncct") -> DataFrame:
    """Normalised ``value`` of ``(fold, case_id, channel, z, y, x, value, support)`` rows.

    Map-only: the parameters (folds times channels) are broadcast after their size is counted.
    """
    v = F.when(finite(F.col("value")), F.col("value")).otherwise(F.col("center"))
    z = (F.least(F.greatest(v, F.col("clip_low")), F.col("clip_high")) - F.col("center")) / F.col("scale")
    capped = F.when(F.col("channel") == ct_channel, z).otherwise(F.least(F.greatest(z, F.lit(-Z_CAP)), F.lit(Z_CAP)))
    keep = params.select("fold", "channel", "clip_low", "clip_high", "center", "scale")
    return (
        voxels.join(small_side(keep), ["fold", "channel"])
        .withColumn("was_finite", finite(F.col("value")))
        .withColumn("value", F.when(F.col("support"), capped).otherwise(0.0))
        .drop("clip_low", "clip_high", "center", "scale")
    )


def normalization_audit(normalized: DataFrame, ct_channel: str = "ncct") -> DataFrame:
    """Per channel: non-finite inputs, outputs beyond the cap, non-finite outputs."""
    return normalized.groupBy("fold", "channel").agg(
        F.count_if(~F.col("was_finite")).alias("nonfinite_in"),
        F.count_if((F.col("channel") != ct_channel) & (F.abs("value") > Z_AUDIT)).alias("over_cap_out"),
        F.count_if(~finite(F.col("value"))).alias("nonfinite_out"),
    )


def normalization_input_violations(voxels: DataFrame, ct_channel: str = "ncct") -> DataFrame:
    """A CT channel must be finite before it is normalised."""
    bad = voxels.where(F.col("channel") == ct_channel).groupBy("case_id").agg(
        F.count_if(~finite(F.col("value"))).alias("n")
    ).where("n > 0")
    return violation(bad, "ct_not_finite", F.col("case_id"), F.col("n"))
