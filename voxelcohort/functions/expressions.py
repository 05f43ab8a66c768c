"""Column expressions shared by every operator."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXIS_BITS = 21


def finite(value: Column) -> Column:
    """True for ordinary numbers only. Spark sorts NaN above all numbers, so every
    comparison on raw intensities has to pass through this guard first."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def allclose(left: Column, right: Column, atol: float, rtol: float = 0.0) -> Column:
    """Element-wise closeness of two double arrays of equal length (``right`` is the reference)."""
    near = F.zip_with(left, right, lambda a, b: F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b))
    return (F.size(left) == F.size(right)) & F.forall(near, lambda ok: F.coalesce(ok, F.lit(False)))


def hash_key(columns: Sequence[str | Column], seed: int) -> Column:
    """Deterministic pseudo-random order: md5 text of ``key|seed``, independent of partitioning."""
    parts = [(F.col(c) if isinstance(c, str) else c).cast("string") for c in columns]
    return F.md5(F.concat_ws("|", *parts, F.lit(str(seed))))


def closed_round(value: Column, places: int = 6) -> Column:
    """Rounded double without negative zero."""
    return F.round(value, places) + F.lit(0.0)


def pack_voxel(z: Column, y: Column, x: Column) -> Column:
    """One long whose order is raster order, whatever the grid size (21 bits an axis)."""
    return (
        F.shiftleft(z.cast("long"), 2 * AXIS_BITS)
        + F.shiftleft(y.cast("long"), AXIS_BITS)
        + x.cast("long")
    )


def unpack_voxel(packed: Column) -> tuple[Column, Column, Column]:
    mask = F.lit((1 << AXIS_BITS) - 1)
    return (
        F.shiftright(packed, 2 * AXIS_BITS),
        F.shiftright(packed, AXIS_BITS).bitwiseAND(mask),
        packed.bitwiseAND(mask),
    )


def constant_rows(df: DataFrame, values: Iterable, name: str) -> DataFrame:
    """Repeat every row for each value of a fixed, short parameter list."""
    return df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))


def violation(df: DataFrame, check: str, key: Column, detail: Column) -> DataFrame:
    """Rows of the common violation schema ``(check, key, detail)``."""
    return df.select(
        F.lit(check).alias("check"),
        key.cast("string").alias("key"),
        F.coalesce(detail.cast("string"), F.lit("")).alias("detail"),
    )


def violations_of(df: DataFrame, rules: Iterable[tuple[Column, str, Column, Column]]) -> DataFrame:
    """All broken rules ``(condition, check, key, detail)`` of a frame in one pass over it."""
    found = [
        F.when(
            F.coalesce(condition, F.lit(False)),
            F.struct(
                F.lit(check).alias("check"),
                key.cast("string").alias("key"),
                F.coalesce(detail.cast("string"), F.lit("")).alias("detail"),
            ),
        )
        for condition, check, key, detail in rules
    ]
    return df.select(F.explode(F.filter(F.array(*found), lambda v: v.isNotNull())).alias("_v")).select("_v.*")


def violations_union(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, list(frames))


def require_empty(violations: DataFrame) -> None:
    """Raise with the first few violations; an empty frame means the check passed."""
    found = violations.take(5)
    if found:
        raise ValueError("; ".join(f"{r['check']}[{r['key']}] {r['detail']}".strip() for r in found))
