"""Grid-compatibility gates, header checks, cropping and storage planning.

Header rows: ``(case_id, channel, shape array<int>, spacing, origin, direction array<double>,
affine array<double> row-major 4x4)``. A case has a handful of channels, so a self-join
on case never multiplies rows beyond that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelcohort.functions import (
    allclose,
    constant_rows,
    finite,
    violation,
    violations_of,
    violations_union,
)
from voxelcohort.session import small_side

GEOMETRY_ATOL = 1e-5
COHORT_2024_ATOL = 2e-5
AFFINE_ATOL = 1e-4
MIN_DIMENSION = 8
MIN_ABS_DETERMINANT = 1e-10


def geometry_matches(
    headers: DataFrame,
    reference_channel: object,
    atol: float = GEOMETRY_ATOL,
    rtol: float = 0.0,
    fields: Sequence[str] = ("spacing", "origin", "direction"),
) -> DataFrame:
    """Per case and channel: same size as the reference channel and every field within tolerance."""
    ref = headers.where(F.col("channel") == F.lit(reference_channel)).select(
        "case_id", F.col("shape").alias("_shape"), *[F.col(f).alias(f"_{f}") for f in fields]
    )
    near = F.lit(True)
    deltas = []
    for f in fields:
        near = near & allclose(F.col(f), F.col(f"_{f}"), atol, rtol)
        deltas.append(F.array_max(F.zip_with(F.col(f), F.col(f"_{f}"), lambda a, b: F.abs(a - b))))
    return headers.join(ref, "case_id", "left").select(
        "case_id",
        "channel",
        F.coalesce(F.col("shape") == F.col("_shape"), F.lit(False)).alias("same_size"),
        F.coalesce((F.col("shape") == F.col("_shape")) & near, F.lit(False)).alias("matches"),
        F.greatest(*deltas).alias("max_delta") if len(deltas) > 1 else deltas[0].alias("max_delta"),
    )


def geometry_summary(matches: DataFrame) -> DataFrame:
    """Per channel: cases present and cases matching the reference grid."""
    return matches.groupBy("channel").agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("matches").alias("cases_matching")
    )


def presence_counters(cases: DataFrame, optional: Sequence[str]) -> DataFrame:
    """How many cases carry each optional file."""
    counts = cases.agg(*[F.count(c).alias(c) for c in optional])
    pairs = ", ".join(f"'{c}', `{c}`" for c in optional)
    return counts.selectExpr(f"stack({len(optional)}, {pairs}) as (file, cases)")


def stage_gate(
    headers: DataFrame, channels: Sequence, reference_channel: object, atol: float = GEOMETRY_ATOL
) -> DataFrame:
    """Cases that may not be staged, with their mismatching and missing channels."""
    matches = geometry_matches(headers, reference_channel, atol).select("case_id", "channel", "matches")
    need = constant_rows(headers.select("case_id").distinct(), channels, "channel")
    problem = F.when(F.col("matches").isNull(), F.concat(F.col("channel").cast("string"), F.lit(":missing"))).when(
        ~F.col("matches"), F.col("channel").cast("string")
    )
    return (
        need.join(matches, ["case_id", "channel"], "left")
        .groupBy("case_id")
        .agg(F.array_join(F.array_sort(F.collect_list(problem)), ",").alias("problems"))
        .where("problems <> ''")
    )


def channel_gate(requested: DataFrame, allowed: Sequence[str]) -> DataFrame:
    """Requested model inputs per ``request``: none, repeated, or not on the allow list."""
    per_name = requested.where(F.col("channel").isNotNull()).groupBy("request", "channel").agg(F.count(F.lit(1)).alias("n"))
    per_request = requested.groupBy("request").agg(F.count("channel").alias("n"))
    key = F.concat_ws("/", "request", "channel")
    return violations_union([
        violation(per_request.where("n = 0"), "no_channels", F.col("request"), F.lit("")),
        violations_of(per_name, [
            (F.col("n") > 1, "channel_repeated", key, F.col("n")),
            (~F.col("channel").isin(*allowed), "channel_not_allowed", key, F.lit("")),
        ]),
    ])


def _determinant(a: Column) -> Column:
    m = [[F.get(a, F.lit(4 * r + c)) for c in range(3)] for r in range(3)]
    return (
        m[0][0] * (m[1][1] * m[2][2] - m[1][2] * m[2][1])
        - m[0][1] * (m[1][0] * m[2][2] - m[1][2] * m[2][0])
        + m[0][2] * (m[1][0] * m[2][1] - m[1][1] * m[2][0])
    )


def header_violations(headers: DataFrame) -> DataFrame:
    """3-D, large enough, finite and positive spacing, finite and invertible affine."""
    all_finite = lambda name: F.forall(name, finite)
    key = F.concat_ws("/", "case_id", "channel")
    return violations_of(headers, [
        (F.size("shape") != 3, "not_3d", key, F.size("shape")),
        (F.exists("shape", lambda d: d < MIN_DIMENSION), "dimension_too_small", key, F.array_min("shape")),
        (~all_finite("spacing"), "spacing_not_finite", key, F.lit("")),
        (F.exists("spacing", lambda s: finite(s) & (s <= 0)), "spacing_not_positive", key, F.lit("")),
        (~all_finite("affine"), "affine_not_finite", key, F.lit("")),
        (all_finite("affine") & (F.abs(_determinant(F.col("affine"))) <= MIN_ABS_DETERMINANT), "affine_singular", key, F.lit("")),
    ])


def canonicalize_label_headers(labels: DataFrame, reference: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Labels with the reference grid's physical header; size mismatches as violations."""
    ref = reference.select(
        "case_id", F.col("shape").alias("_shape"),
        *[F.col(f).alias(f"_{f}") for f in ("spacing", "origin", "direction")],
    )
    joined = labels.join(ref, "case_id")
    same = F.col("shape") == F.col("_shape")
    fixed = joined.where(same).select(
        "case_id", "channel", "shape", *[F.col(f"_{f}").alias(f) for f in ("spacing", "origin", "direction")]
    )
    bad = violation(
        joined.where(~same), "label_size", F.col("case_id"),
        F.array_join(F.transform("shape", lambda d: d.cast("string")), "x"),
    )
    return fixed, bad


def support_bbox(mask: DataFrame) -> DataFrame:
    """Smallest box around the foreground rows ``(case_id, z, y, x)`` of each case."""
    ends = [f(F.col(a)).alias(f"{a}_{n}") for a in ("z", "y", "x") for f, n in ((F.min, "min"), (F.max, "max"))]
    return mask.groupBy("case_id").agg(*ends, F.count(F.lit(1)).alias("n_support"))


def roi_starts(bbox: DataFrame, shapes: DataFrame, max_shape: Sequence[int], min_support: int = 128) -> DataFrame:
    """ROI of at most ``max_shape`` centred on the box and clamped to the grid.

    ``shapes``: ``(case_id, depth, height, width)``.
    """
    out = bbox.where(F.col("n_support") >= min_support).join(shapes, "case_id")
    for axis, dim, limit in zip(("z", "y", "x"), ("depth", "height", "width"), max_shape, strict=True):
        length = F.least(F.col(dim), F.lit(limit))
        center = F.floor((F.col(f"{axis}_min") + F.col(f"{axis}_max")) / 2)
        start = F.greatest(F.lit(0), F.least(center - F.floor(length / 2), F.col(dim) - length))
        out = out.withColumn(f"{axis}_start", start).withColumn(f"{axis}_len", length)
    return out.select("case_id", *[f"{a}_{p}" for a in ("z", "y", "x") for p in ("start", "len")])


def roi_violations(bbox: DataFrame, min_support: int = 128) -> DataFrame:
    return violation(bbox.where(F.col("n_support") < min_support), "support_too_small", F.col("case_id"), F.col("n_support"))


def roi_crop(voxels: DataFrame, roi: DataFrame) -> DataFrame:
    """Voxels inside the ROI, re-indexed from its start. The ROI table (one row a case) is
    broadcast only when its counted size allows."""
    inside = F.lit(True)
    for a in ("z", "y", "x"):
        inside = inside & (F.col(a) >= F.col(f"{a}_start")) & (F.col(a) < F.col(f"{a}_start") + F.col(f"{a}_len"))
    out = voxels.join(small_side(roi), "case_id").where(inside)
    for a in ("z", "y", "x"):
        out = out.withColumn(a, F.col(a) - F.col(f"{a}_start"))
    return out.drop(*[f"{a}_{p}" for a in ("z", "y", "x") for p in ("start", "len")])


def shift_affine(headers: DataFrame, starts: Column) -> DataFrame:
    """Affine of a crop: the translation moves by rotation-scale times the start index."""
    a = F.col("affine")
    at = lambda r, c: F.get(a, F.lit(4 * r + c))
    moved = []
    for r in range(4):
        for c in range(4):
            cell = at(r, c)
            if c == 3 and r < 3:
                cell = cell + sum((at(r, i) * F.get(starts, F.lit(i)) for i in range(3)), F.lit(0.0))
            moved.append(cell)
    return headers.withColumn("affine", F.array(*moved))


def storage_estimate(
    headers: DataFrame, folds: int = 5, arm_channels: Sequence[int] = (1, 5), label_copies_per_case: int = 8,
    bytes_per_voxel: int = 4,
) -> DataFrame:
    """Uncompressed bytes of staging every fold and arm, with a doubled reservation.

    ``headers``: one row a case with ``shape`` and ``label_bytes``. A case's label is staged
    in the ``folds - 1`` folds that train on it, once an arm.
    """
    voxels = F.aggregate("shape", F.lit(1).cast("long"), lambda acc, d: acc * d)
    image = F.sum(voxels) * folds * sum(arm_channels) * bytes_per_voxel
    label = F.sum("label_bytes") * label_copies_per_case
    total = headers.agg(F.count(F.lit(1)).alias("cases"), image.alias("image_bytes"), label.alias("label_bytes"))
    per_fold = F.expr(f"image_bytes div {folds} + label_bytes div {folds - 1}")
    return (
        total.withColumn("combined_bytes", F.col("image_bytes") + F.col("label_bytes"))
        .withColumn("reserved_bytes", F.col("combined_bytes") * 2)
        .withColumn("per_fold_bytes", per_fold)
        .withColumn("per_fold_reserved_bytes", F.col("per_fold_bytes") * 2)
        .withColumn("divisible", (F.col("image_bytes") % folds == 0) & (F.col("label_bytes") % (folds - 1) == 0))
    )
