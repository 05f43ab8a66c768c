"""Nine-value pixel features of 2-D images ``(<image keys>, row, col, value)``.

Every window is partitioned by one line of one image (row, column or diagonal), so no
task ever holds more than a line at a time per window group, and there is no join.
Images must be dense rectangles (see ``masks.dense_violations``).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelcohort.functions import finite, violation

DIRECTIONS = {"run_horizontal": (0, 1), "run_vertical": (1, 0), "run_45deg": (1, 1), "run_135deg": (1, -1)}
RUN_MODES = ("threshold_count", "centered_run", "max_run")
FEATURE_NAMES = ("row_coord", "col_coord", "intensity", "box_mean", "binomial_mean", *DIRECTIONS)


def coordinates(pixels: DataFrame, mode: str = "raw", image: Sequence[str] = ("case_id",)) -> DataFrame:
    """``row_coord`` and ``col_coord``: indices, or indices divided by the last index."""
    if mode not in ("raw", "normalized"):
        raise ValueError(f"no coordinates of kind {mode!r}; raw and normalized exist")
    if mode == "raw":
        return pixels.withColumn("row_coord", F.col("row").cast("double")).withColumn("col_coord", F.col("col").cast("double"))
    ends = pixels.groupBy(*image).agg(F.max("row").alias("_rmax"), F.max("col").alias("_cmax"))
    scaled = lambda c, m: F.when(F.col(m) > 0, F.col(c) / F.col(m)).otherwise(F.col(c).cast("double"))
    return (
        pixels.join(ends, list(image))
        .withColumn("row_coord", scaled("row", "_rmax")).withColumn("col_coord", scaled("col", "_cmax"))
        .drop("_rmax", "_cmax")
    )


def _weighted_triplet(value: Column, line, weights: tuple[int, int], boundary: str) -> Column:
    """side*left + middle*value + side*right; for one pixel, nearest and reflect repeat the edge."""
    if boundary not in ("nearest", "reflect", "constant"):
        raise ValueError(f"no boundary {boundary!r}; nearest, reflect and constant exist")
    side, middle = weights
    edge = F.lit(0.0) if boundary == "constant" else value
    left = F.coalesce(F.lag(value).over(line), edge)
    right = F.coalesce(F.lead(value).over(line), edge)
    return side * left + middle * value + side * right


def local_means(pixels: DataFrame, boundary: str = "nearest", image: Sequence[str] = ("case_id",)) -> DataFrame:
    """``box_mean`` (3x3 mean) and ``binomial_mean`` (1-2-1 by 1-2-1 over 16), separable passes."""
    along_row = W.partitionBy(*image, "row").orderBy("col")
    along_col = W.partitionBy(*image, "col").orderBy("row")
    v = F.col("value")
    return (
        pixels.withColumn("_box", _weighted_triplet(v, along_row, (1, 1), boundary))
        .withColumn("_bin", _weighted_triplet(v, along_row, (1, 2), boundary))
        .withColumn("box_mean", _weighted_triplet(F.col("_box"), along_col, (1, 1), boundary) / 9.0)
        .withColumn("binomial_mean", _weighted_triplet(F.col("_bin"), along_col, (1, 2), boundary) / 16.0)
        .drop("_box", "_bin")
    )


def box_mean_3x3(pixels: DataFrame, boundary: str = "nearest", image: Sequence[str] = ("case_id",)) -> DataFrame:
    return local_means(pixels, boundary, image).drop("binomial_mean")


def binomial_mean_3x3(pixels: DataFrame, boundary: str = "nearest", image: Sequence[str] = ("case_id",)) -> DataFrame:
    return local_means(pixels, boundary, image).drop("box_mean")


def _line(direction: tuple[int, int], image: Sequence[str]) -> tuple[list[Column], Column]:
    """Partition keys of the lines along a direction and the coordinate that moves."""
    row, col = F.col("row"), F.col("col")
    keys = [F.col(i) for i in image]
    moving = {(0, 1): ([row], col), (1, 0): ([col], row), (1, 1): ([col - row], row), (1, -1): ([col + row], row)}
    if direction not in moving:
        raise ValueError(f"unsupported direction {direction}")
    line, coordinate = moving[direction]
    return keys + line, coordinate


def directional_runs(
    pixels: DataFrame, direction: tuple[int, int], runs: Mapping[str, tuple[str, float]], window: int = 25,
    image: Sequence[str] = ("case_id",),
) -> DataFrame:
    """Adds a column for each ``{name: (mode, threshold)}``, as ``directional_run``; a direction's lines are sorted once for all.

    Only ``centered_run`` needs them in reverse order as well.
    """
    for mode, _ in runs.values():
        if mode not in RUN_MODES or window < 1 or window % 2 == 0:
            raise ValueError(f"a run needs an odd window and a mode of {RUN_MODES}, not {window} and {mode!r}")
    (*_, line), c = _line(direction, image)
    r = window // 2
    ahead = W.partitionBy(*image, "_line").orderBy(c)
    near, forward = ahead.rangeBetween(-r, r), ahead.rowsBetween(W.unboundedPreceding, W.currentRow)
    backward = W.partitionBy(*image, "_line").orderBy(c.desc()).rowsBetween(W.unboundedPreceding, W.currentRow)
    high = {name: F.col("value") >= threshold for name, (_, threshold) in runs.items()}
    of = lambda mode: [name for name, (m, _) in runs.items() if m == mode]
    start = lambda name: F.coalesce(F.last(F.when(~high[name], c), ignorenulls=True).over(forward) + 1, F.min(c).over(forward))
    end = lambda name: F.coalesce(F.last(F.when(~high[name], c), ignorenulls=True).over(backward) - 1, F.max(c).over(backward))
    out = pixels.withColumn("_line", line).withColumns(
        {name: F.count_if(high[name]).over(near).cast("int") for name in of("threshold_count")}
        | {f"_s_{name}": start(name) for name in [*of("centered_run"), *of("max_run")]}
    )
    if of("max_run"):
        out = out.withColumn("_p", c).withColumns({f"_cur_{n}": F.when(high[n], c - F.col(f"_s_{n}") + 1).otherwise(0) for n in of("max_run")})
        around = {f"_w_{n}": F.collect_list(F.struct("_p", F.col(f"_cur_{n}").alias("_cur"))).over(near) for n in of("max_run")}  # at most ``window`` items
        inside = lambda q: F.least(q["_cur"], q["_p"] - F.col("_p") + r + 1)
        out = out.withColumns(around).withColumns({n: F.array_max(F.transform(f"_w_{n}", inside)).cast("int") for n in of("max_run")})
        out = out.drop("_p", *[f"{p}_{n}" for n in of("max_run") for p in ("_s", "_cur", "_w")])
    if of("centered_run"):
        out = out.withColumns({f"_e_{n}": end(n) for n in of("centered_run")})
        run = lambda n: F.least(F.col(f"_e_{n}"), c + r) - F.greatest(F.col(f"_s_{n}"), c - r) + 1
        out = out.withColumns({n: F.when(high[n], run(n)).otherwise(0).cast("int") for n in of("centered_run")})
        out = out.drop(*[f"{p}_{n}" for n in of("centered_run") for p in ("_s", "_e")])
    return out.drop("_line")


def directional_run(
    pixels: DataFrame, direction: tuple[int, int], name: str, threshold: float = 20.0, window: int = 25,
    mode: str = "threshold_count", image: Sequence[str] = ("case_id",),
) -> DataFrame:
    """Adds ``name``: pixels at or above the threshold in the centered window along a direction.

    ``threshold_count`` counts them, ``centered_run`` is the run through the pixel clipped to
    the window, ``max_run`` the longest run inside it. Outside the image counts as below.
    """
    return directional_runs(pixels, direction, {name: (mode, threshold)}, window, image)


def run_columns(place: int) -> list[str]:
    """Feature columns of the variant at ``place`` in ``variant_features``, in the order of ``FEATURE_NAMES``."""
    return [f"{name}_{place}" if name in DIRECTIONS else name for name in FEATURE_NAMES]


def variant_features(
    pixels: DataFrame, variants: Sequence[tuple[str, float]], image: Sequence[str] = ("case_id",), window: int = 25,
) -> DataFrame:
    """``nine_features`` of several variants ``(mode, threshold)`` side by side: what they share is computed once."""
    out = pixels
    for name, direction in DIRECTIONS.items():
        out = directional_runs(out, direction, {f"{name}_{i}": run for i, run in enumerate(variants)}, window, image)
        out = local_means(out, image=image) if name == "run_horizontal" else out  # its lines are sorted already
    return coordinates(out, "raw", image).withColumn("intensity", F.col("value"))


def nine_features(
    pixels: DataFrame, image: Sequence[str] = ("case_id",), boundary: str = "nearest", coordinate_mode: str = "raw", **run_options,
) -> DataFrame:
    """All nine features of every pixel; other columns pass through.

    Window order lets row-line and column-line stages share their exchange. A table already
    distributed by image (bucketed, or repartitioned by a caller who knows images are
    small) needs no exchange at all, since every window key contains the image keys.
    ``run_options`` are those of ``directional_run``.
    """
    out = directional_run(pixels, DIRECTIONS["run_horizontal"], "run_horizontal", image=image, **run_options)
    out = local_means(out, boundary, image)
    for name in ("run_vertical", "run_45deg", "run_135deg"):
        out = directional_run(out, DIRECTIONS[name], name, image=image, **run_options)
    return coordinates(out, coordinate_mode, image).withColumn("intensity", F.col("value"))


def feature_input_violations(pixels: DataFrame, image: Sequence[str] = ("case_id",)) -> DataFrame:
    """Images with non-finite pixels, which features must reject."""
    bad = pixels.groupBy(*image).agg(F.count_if(~finite(F.col("value"))).alias("n")).where("n > 0")
    return violation(bad, "pixel_not_finite", F.concat_ws("/", *image), F.col("n"))
