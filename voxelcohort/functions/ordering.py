"""Ranks, running totals and exact quantiles that never sort a whole group in one task.

A case may hold a third of all voxels, so a window partitioned by case alone would
put those rows in one task. Every helper here splits a group into ordered buckets,
adds up the buckets (partial aggregation, a few thousand rows a group), and runs the
window inside ``(group, bucket)`` only.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegralType, NumericType

from voxelcohort.functions.expressions import finite
from voxelcohort.session import small_side

BUCKETS_PER_E_FOLD = 64
SMALLEST_MAGNITUDE = 1e-30
BEYOND = 1 << 40
ID_BUCKETS, ID_SAMPLE, ID_SPLITS = 4_096, 4_096, 256
SPREAD_SPLITS, SPREAD_K = 1_024, 8_192
_SHIFT = 4423  # makes the bucket of SMALLEST_MAGNITUDE positive


def value_bucket(value: Column) -> Column:
    """Bucket number that never decreases as a finite number grows (signed log scale).

    float32 data has at most about 12 million distinct values per e-fold, hence under
    200 thousand per bucket after equal values are merged.

    Null stays null (the first bucket in Spark's order); negative infinity comes before, infinity and NaN after all
    finite numbers, as in Spark's order.
    """
    size = F.floor(F.log(F.greatest(F.abs(value), F.lit(SMALLEST_MAGNITUDE))) * BUCKETS_PER_E_FOLD) + _SHIFT
    return (
        F.when(value.isNull(), F.lit(None).cast("long")).when(F.isnan(value), F.lit(BEYOND + 1)).when(value == float("inf"), F.lit(BEYOND))
        .when(value == float("-inf"), F.lit(-BEYOND)).when(value > 0, size).when(value < 0, -size).otherwise(F.lit(0).cast("long"))
    )


def spread_bucket(df: DataFrame, column: str) -> Column:
    """Bucket number that never decreases as the number in ``column`` grows and follows where the values of ``df`` lie.

    A quantile sketch, merged from the tasks in one pass, gives up to ``SPREAD_SPLITS`` split points, so scores close to 1
    or ids within a narrow range spread over many buckets; a value met very often becomes a split point and begins a bucket.
    Within a split the log scale of ``value_bucket`` goes on. Any split points give the same ranks.
    """
    value = F.col(column).cast("double")
    found = df.where(finite(value)).agg(F.kll_sketch_agg_double(value, F.lit(SPREAD_K)).alias("_s"), F.count(F.lit(1)).alias("_n"))
    numbers = lambda values: F.split(F.lit(",".join(map(repr, values))), ",").cast("array<double>")
    ranks = numbers([i / SPREAD_SPLITS for i in range(1, SPREAD_SPLITS)])
    points = found.select(F.when(F.col("_n") > 0, F.array_distinct(F.kll_sketch_get_quantile_double("_s", ranks)))).first()[0]
    if not points:
        return value_bucket(value)
    splits = numbers(points)
    steps = F.lit([1 << b for b in reversed(range((SPREAD_SPLITS - 1).bit_length()))])
    passed = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when(F.get(splits, at + step - 1) <= value, step).otherwise(0))
    return F.struct(F.when(value.isNotNull(), passed).alias("split"), value_bucket(value).alias("step"))


def order_bucket(df: DataFrame, column: str) -> Column:
    """Monotone bucket for the natural order of an id column, numeric or text.

    Whole numbers get equal steps between the smallest and the largest. Text ids get split points from a bounded sample
    by hash, so ids of several naming schemes spread as they come.
    """
    kind = df.schema[column].dataType
    if isinstance(kind, IntegralType):
        ends = df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
        if ends["lo"] is None:
            return F.lit(None).cast("long")
        step = max(1, -(-(ends["hi"] - ends["lo"] + 1) // ID_BUCKETS))
        return F.floor((F.col(column).cast("decimal(20,0)") - F.lit(ends["lo"])) / F.lit(step)).cast("long")
    if isinstance(kind, NumericType):
        return value_bucket(F.col(column).cast("double"))
    sample = df.select(column).dropna().distinct().orderBy(F.md5(F.col(column).cast("string")), column).limit(ID_SAMPLE)
    found = sorted((r[0] for r in sample.collect()), key=lambda x: x.encode())  # Spark orders strings by their bytes
    splits = found[ID_SAMPLE // ID_SPLITS::ID_SAMPLE // ID_SPLITS] if len(found) == ID_SAMPLE else found[1:ID_SPLITS]
    if not splits:
        return F.when(F.col(column).isNotNull(), F.lit(0).cast("long"))
    return F.when(F.col(column).isNotNull(), F.size(F.filter(F.lit(splits), lambda x: x <= F.col(column))).cast("long"))


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on equal keys where null meets null, so rows of a null group or bucket are not lost."""
    named = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    met = reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"_same_{k}")) for k in keys])
    return left.join(named, met).drop(*[f"_same_{k}" for k in keys])


def _bucket_offsets(totals: DataFrame, group: Sequence[str], sums: Sequence[str]) -> DataFrame:
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group)
    out = totals
    for s in sums:
        out = out.withColumn(f"_off{s}", F.coalesce(F.sum(s).over(before), F.lit(0)))
        out = out.withColumn(f"_all{s}", F.sum(s).over(whole))
    return out.drop(*sums)


def with_rank(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str | Column],
    bucket: Column,
    name: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """1-based position of each row in its group; ``bucket`` must be monotone in ``order``."""
    keyed = df.withColumn("_b", bucket)
    totals = keyed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    offsets = _bucket_offsets(totals, group, ["_n"])
    local = W.partitionBy(*group, "_b").orderBy(*order)
    out = join_same(keyed, offsets, [*group, "_b"]).withColumn(name, F.row_number().over(local) + F.col("_off_n"))
    if total:
        out = out.withColumn(total, F.col("_all_n"))
    return out.drop("_b", "_off_n", "_all_n")


def prefix_sums(
    df: DataFrame,
    group: Sequence[str],
    order: str,
    bucket: Column,
    sums: Mapping[str, str],
    totals: Mapping[str, str] | None = None,
) -> DataFrame:
    """Exclusive running totals ``{output: input}`` in ``order``; ``order`` is unique in a group."""
    keyed = df.withColumn("_b", bucket)
    inputs = sorted(set(sums.values()) | set((totals or {}).values()))
    per_bucket = keyed.groupBy(*group, "_b").agg(*[F.sum(c).alias(f"_t{i}") for i, c in enumerate(inputs)])
    offsets = _bucket_offsets(per_bucket, group, [f"_t{i}" for i in range(len(inputs))])
    local = W.partitionBy(*group, "_b").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    out = join_same(keyed, offsets, [*group, "_b"])
    for alias, source in sums.items():
        i = inputs.index(source)
        out = out.withColumn(alias, F.coalesce(F.sum(source).over(local), F.lit(0)) + F.col(f"_off_t{i}"))
    for alias, source in (totals or {}).items():
        out = out.withColumn(alias, F.col(f"_all_t{inputs.index(source)}"))
    return out.drop("_b", *[f"{p}_t{i}" for p in ("_off", "_all") for i in range(len(inputs))])


def take_lowest(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    ties: Sequence[str],
    limit: int | Callable[[DataFrame], Column],
    digits: int = 3,
) -> DataFrame:
    """The ``limit`` rows of each group with the smallest md5 ``key``.

    Buckets of the key's first hex digits that lie wholly beyond the limit are dropped
    before anything is shuffled, so about ``limit`` rows a group move, not the group
    (the kept buckets are broadcast once their counted number allows it).
    ``limit`` may be an expression over the per-bucket counts ``(group, _b, _n)``.
    """
    keyed = df.withColumn("_b", F.substring(key, 1, digits))
    totals = keyed.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    want = F.lit(limit) if isinstance(limit, int) else limit(totals)
    kept = (
        totals.withColumn("_limit", want)
        .withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .where(F.col("_off") < F.col("_limit"))
        .drop("_n")
    )
    local = W.partitionBy(*group, "_b").orderBy(key, *ties)
    return (
        join_same(keyed, small_side(kept, 1_000_000), [*group, "_b"])
        .withColumn("_r", F.row_number().over(local) + F.col("_off"))
        .where(F.col("_r") <= F.col("_limit"))
        .drop("_b", "_off", "_limit", "_r")
    )


def exact_quantiles(
    df: DataFrame,
    group: Sequence[str],
    value: str | Column,
    probs: Mapping[str, float],
    weight: str | None = None,
) -> DataFrame:
    """Exact linear-interpolation quantiles of the finite values, one row a group.

    Equal values are merged first (map-side), bucket totals locate the wanted ranks,
    and only the buckets that hold a wanted rank are sorted. ``weight`` counts a row
    several times.
    """
    column = F.col(value) if isinstance(value, str) else value
    merged = (
        df.where(finite(column))
        .groupBy(*group, column.alias("_v"))
        .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_n"))
        .withColumn("_b", value_bucket(F.col("_v")))
    )
    totals = merged.groupBy(*group, "_b").agg(F.sum("_n").alias("_t"))
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    ranks = F.explode(
        F.array(*[
            F.struct(F.lit(i).alias("i"), F.lit(side).alias("side"), F.lit(float(p)).alias("p"))
            for i, p in enumerate(probs.values())
            for side in (0, 1)
        ])
    )
    position = (F.col("_all") - 1) * F.col("_q.p")
    wanted = (
        totals.withColumn("_off", F.coalesce(F.sum("_t").over(before), F.lit(0)))
        .withColumn("_all", F.sum("_t").over(W.partitionBy(*group)))
        .withColumn("_q", ranks)
        .withColumn("_rank", F.when(F.col("_q.side") == 0, F.floor(position)).otherwise(F.ceil(position)))
        .where((F.col("_rank") >= F.col("_off")) & (F.col("_rank") < F.col("_off") + F.col("_t")))
        .groupBy(*group, "_b")
        .agg(F.collect_list(F.struct(
            F.col("_q.i").alias("i"),
            F.col("_q.side").alias("side"),
            (position - F.floor(position)).alias("frac"),
            (F.col("_rank") - F.col("_off")).alias("rank"),
        )).alias("_want"))
    )
    inside = W.partitionBy(*group, "_b").orderBy("_v")
    hits = (
        join_same(merged, wanted, [*group, "_b"])
        .withColumn("_cum", F.sum("_n").over(inside))
        .withColumn("_want", F.filter("_want", lambda q: (q["rank"] < F.col("_cum")) & (q["rank"] >= F.col("_cum") - F.col("_n"))))
        .where(F.size("_want") > 0)
        .withColumn("_q", F.explode("_want"))
    )
    picks = []
    for i, name in enumerate(probs):
        mine = F.col("_q.i") == i
        low = F.max(F.when(mine & (F.col("_q.side") == 0), F.col("_v")))
        high = F.max(F.when(mine & (F.col("_q.side") == 1), F.col("_v")))
        frac = F.max(F.when(mine, F.col("_q.frac")))
        picks.append((low + (high - low) * frac).alias(name))
    return hits.groupBy(*group).agg(*picks)
