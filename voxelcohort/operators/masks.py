"""Brain masks, head-tissue support, mask intersection, label checks and morphology."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelcohort.functions import finite, violation, violations_of, violations_union
from voxelcohort.operators import components
from voxelcohort.session import small_side

# Fixed values of the head-tissue support rule (Hounsfield units, coverage limits).
ENVELOPE_ABOVE = -500.0
TISSUE_LOW, TISSUE_HIGH = -100.0, 150.0
MIN_COVERAGE, MAX_COVERAGE = 0.015, 0.75
MIN_SUPPORT_VOXELS = 32
MIN_DIMENSION = 8

VOXEL_KEY = ["case_id", "z", "y", "x"]


def brain_mask(value: Column) -> Column:
    """Skull-stripped support: finite and strictly positive intensity."""
    return finite(value) & (value > 0)


def foreground(df: DataFrame, value: str) -> DataFrame:
    """Sparse mask of strictly positive voxels."""
    return df.where(finite(F.col(value)) & (F.col(value) > 0)).select(*VOXEL_KEY)


def grid_shapes(voxels: DataFrame) -> DataFrame:
    """Grid size of each case from its voxel rows."""
    return voxels.groupBy("case_id").agg(
        (F.max("z") + 1).alias("depth"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"),
        F.count(F.lit(1)).alias("voxels"),
    )


def dense_violations(voxels: DataFrame) -> DataFrame:
    """Cases whose rows do not fill their grid exactly once, as offset stencils need."""
    gaps = grid_shapes(voxels).where("voxels <> depth * height * width")
    return violation(gaps, "grid_not_dense", F.col("case_id"), F.col("voxels"))


def head_support(ncct: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Head-tissue voxels of an NCCT table ``(case_id, z, y, x, value)`` and the head itself.

    Returns ``(support, head)``: largest face-connected component above the envelope
    threshold, holes filled, then limited to tissue intensities.
    """
    envelope = ncct.where(finite(F.col("value")) & (F.col("value") > ENVELOPE_ABOVE))
    head_runs = components.cut_lineage(components.largest_component(components.to_runs(envelope), 6))
    filled = head_runs.select("case_id", "z", "y", "x0", "x1").unionByName(components.hole_runs(head_runs, 6))
    head = components.runs_to_voxels(filled).select(*VOXEL_KEY)
    tissue = ncct.where(F.col("value").between(TISSUE_LOW, TISSUE_HIGH)).select(*VOXEL_KEY)
    return tissue.join(head, VOXEL_KEY, "left_semi"), head


def support_qc(support: DataFrame, head: DataFrame, shapes: DataFrame) -> DataFrame:
    """Coverage, box, head size and border count (a voxel on two faces counts twice)."""
    faces = sum(
        ((F.col(a) == 0).cast("int") + (F.col(a) == F.col(d) - 1).cast("int"))
        for a, d in (("z", "depth"), ("y", "height"), ("x", "width"))
    )
    per_case = support.join(small_side(shapes), "case_id").groupBy("case_id").agg(
        F.count(F.lit(1)).alias("n_support"),
        *[f(F.col(a)).alias(f"{a}_{n}") for a in ("z", "y", "x") for f, n in ((F.min, "min"), (F.max, "max"))],
        F.sum(faces).alias("border_voxels"),
    )
    envelope = head.groupBy("case_id").agg(F.count(F.lit(1)).alias("head_voxels"))
    total = F.col("depth") * F.col("height") * F.col("width")
    return (
        shapes.join(per_case, "case_id", "left").join(envelope, "case_id", "left")
        .fillna(0, ["n_support", "border_voxels", "head_voxels"])
        .withColumn("coverage", F.col("n_support") / total)
    )


def support_violations(ncct: DataFrame, qc: DataFrame) -> DataFrame:
    """Cases whose support must not be used: raw defects, small grids, implausible coverage."""
    bad = ncct.groupBy("case_id").agg(F.count_if(~finite(F.col("value"))).alias("n")).where("n > 0")
    smallest = F.least("depth", "height", "width")
    shown = F.format_string("%.4f", F.col("coverage"))
    return violations_union([
        violation(bad, "ncct_not_finite", F.col("case_id"), F.col("n")),
        violations_of(qc, [
            (smallest < MIN_DIMENSION, "grid_too_small", F.col("case_id"), smallest),
            (F.col("head_voxels") == 0, "no_head", F.col("case_id"), F.lit("")),
            (F.col("n_support") < MIN_SUPPORT_VOXELS, "support_too_small", F.col("case_id"), F.col("n_support")),
            (~F.col("coverage").between(MIN_COVERAGE, MAX_COVERAGE), "coverage", F.col("case_id"), shown),
        ]),
    ])


def mask_intersect(mask: DataFrame, brain: DataFrame | None) -> DataFrame:
    """Mask limited to the brain mask when there is one."""
    return mask if brain is None else mask.join(brain.select(*VOXEL_KEY), VOXEL_KEY, "left_semi")


def shape_violations(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cases whose two masks do not share a grid, from their ``grid_shapes``."""
    dims = ["depth", "height", "width"]
    text = lambda p: F.concat_ws("x", *[F.col(p + d) for d in dims])
    other = right.select("case_id", *[F.col(d).alias(f"r_{d}") for d in dims])
    joined = left.select("case_id", *dims).join(other, "case_id", "full_outer")
    same = F.lit(True)
    for d in dims:
        same = same & F.col(d).eqNullSafe(F.col(f"r_{d}"))
    return violation(joined.where(~same), "shape", F.col("case_id"), F.concat_ws(" vs ", text(""), text("r_")))


def label_values(labels: DataFrame) -> DataFrame:
    """Per case: the distinct classes and whether any value is outside {0, 1} or not finite."""
    v = F.col("value")
    return labels.groupBy("case_id").agg(
        F.count_if(finite(v) & (v == 0)).alias("background"),
        F.count_if(finite(v) & (v == 1)).alias("foreground"),
        F.count_if(finite(v) & ~v.isin(0.0, 1.0)).alias("unexpected"),
        F.count_if(~finite(v)).alias("non_finite"),
    )


def label_violations(labels: DataFrame) -> DataFrame:
    return violations_of(label_values(labels), [
        (F.col("unexpected") > 0, "label_value", F.col("case_id"), F.col("unexpected")),
        (F.col("non_finite") > 0, "label_not_finite", F.col("case_id"), F.col("non_finite")),
    ])


def disk(radius: int) -> list[tuple[int, int]]:
    return [
        (dy, dx) for dy in range(-radius, radius + 1) for dx in range(-radius, radius + 1)
        if dy * dy + dx * dx <= radius * radius
    ]


def close_2d(mask: DataFrame, shapes: DataFrame, radius: int) -> DataFrame:
    """Disk closing of ``(case_id, row, col)`` masks; everything outside the grid is background,
    so pixels near the border can disappear. ``shapes``: ``(case_id, height, width)``."""
    keys = ["case_id", "row", "col"]
    pixels = mask.select(*keys)
    if radius < 0:
        raise ValueError("radius must not be negative")
    if radius == 0:
        return pixels
    offsets = disk(radius)
    stamp = F.explode(F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets]))
    shift = lambda df: df.withColumn("_o", stamp).select(
        "case_id", (F.col("row") + F.col("_o.dy")).alias("row"), (F.col("col") + F.col("_o.dx")).alias("col")
    )
    dilated = shift(pixels).distinct().join(small_side(shapes.select("case_id", "height", "width")), "case_id").where(
        "`row` >= 0 and `row` < height and col >= 0 and col < width"
    )
    votes = shift(dilated.select(*keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return votes.where(F.col("_n") == len(offsets)).select(*keys)


def restore_mask(predictions: DataFrame, brain: DataFrame, shapes: DataFrame, radius: int = 0) -> DataFrame:
    """Positive pixel predictions back on the grid, closed, limited to the brain."""
    positive = predictions.where("prediction > 0").select("case_id", "row", "col")
    return close_2d(positive, shapes, radius).join(
        brain.select("case_id", "row", "col"), ["case_id", "row", "col"], "left_semi"
    )


def restore_violations(predictions: DataFrame, brain: DataFrame) -> DataFrame:
    """Every brain pixel needs exactly one prediction."""
    n = (
        brain.select("case_id", F.lit(1).alias("b"), F.lit(0).alias("p"))
        .unionByName(predictions.select("case_id", F.lit(0).alias("b"), F.lit(1).alias("p")))
        .groupBy("case_id").agg(F.sum("b").alias("b"), F.sum("p").alias("p"))
    )
    return violation(n.where("b <> p"), "prediction_count", F.col("case_id"), F.concat_ws(" vs ", "p", "b"))
