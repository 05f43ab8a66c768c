"""Resampling statistics and paired comparison of two arms.

Resampling is hash-driven: the draw for (repetition, position) is a function of the
seed only, so results do not depend on partitioning or on lost executors.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from voxelcohort.functions import (
    exact_quantiles,
    finite,
    hash_key,
    order_bucket,
    violation,
    violations_of,
    violations_union,
    with_rank,
)
from voxelcohort.functions.digests import numbered_md5
from voxelcohort.functions.ordering import join_same
from voxelcohort.session import cut_lineage

REP_BLOCK = 250  # repetitions one row expands at a time; blocks spread over tasks
DRAW_BLOCK = 125  # repetitions one task draws while it holds the values of a group
DRAW_ROWS = 2_000_000  # largest group whose values such a task may hold; larger ones join their draws by shuffle
DRAW_TILE = 4_096  # rows of a group that move as one
FLIP_BLOCK = 8_192  # repetitions whose sums a task holds while rows with a hash a sign pass
TIE = 1e-12
SCORE_ENDPOINTS = ("dice", "lesion_f1")


def _spread_repetitions(df: DataFrame, reps: int, key: str) -> DataFrame:
    """Every row once per repetition, the work split by blocks of repetitions and by rows.

    The shuffle moves ``rows * reps / REP_BLOCK`` rows; the rest is expanded locally and
    summed per repetition before the next shuffle. The number of parts is stated, since
    adaptive execution would merge the small parts that are about to grow.
    """
    blocks = -(-reps // REP_BLOCK)
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    spread = df.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(parts, "_blk", key)
    first = F.col("_blk") * REP_BLOCK
    return spread.withColumn(
        "rep", F.explode(F.sequence(first, F.least(first + REP_BLOCK, F.lit(reps)) - 1))
    ).drop("_blk")


def bootstrap_means(
    df: DataFrame, values: Sequence[str], key: str = "case_id", reps: int = 10_000, seed: int = 2026,
    group: Sequence[str] = (), held: int = DRAW_ROWS,
) -> DataFrame:
    """Means of ``values`` in each resample of n rows with replacement: ``(<group>, rep, <values>)``.

    Draw i of a repetition picks row ``md5(rep|i|seed) mod n`` of its group; all value columns share draws. Where the
    largest group has at most ``held`` rows, which is counted, a task draws a block of repetitions from the group's values
    and only means leave it; otherwise draws are counted a row and meet the values in a join. Both draw the same.
    """
    group = list(group)
    rows = cut_lineage(df.select(*group, key, *values))
    numbered = with_rank(rows, group, [key], order_bucket(rows, key), name="_i", total="_n").withColumn("_i", F.col("_i") - 1)
    numbered = cut_lineage(numbered)
    largest = numbered.agg(F.max("_n")).first()[0] or 0
    means = _drawn_in_tasks if largest <= held else _drawn_by_join
    return means(numbered, list(values), reps, seed, group)


def _drawn_by_join(numbered: DataFrame, values: list[str], reps: int, seed: int, group: list[str]) -> DataFrame:
    draws = _spread_repetitions(numbered.select(*group, "_i", "_n"), reps, "_i")
    picked = F.conv(F.substring(hash_key(["rep", "_i"], seed), 1, 12), 16, 10).cast("long") % F.col("_n")
    counted = draws.select(*group, "rep", picked.alias("_i")).groupBy(*group, "rep", "_i").agg(F.count(F.lit(1)).alias("_k"))
    return (
        join_same(counted, numbered.select(*group, "_i", *values), [*group, "_i"])
        .groupBy(*group, "rep")
        .agg(*[(F.sum(F.col(v) * F.col("_k")) / F.sum("_k")).alias(v) for v in values])
    )


def _drawn_in_tasks(numbered: DataFrame, values: list[str], reps: int, seed: int, group: list[str]) -> DataFrame:
    """A group's values travel to each block of repetitions as arrays of ``DRAW_TILE`` rows; absent values count nothing."""
    fields = [F.coalesce(F.col(v).cast("double"), F.lit(0.0)).alias(f"v{j}") for j, v in enumerate(values)]
    fields += [F.col(v).isNotNull().alias(f"h{j}") for j, v in enumerate(values)]
    tiles = numbered.groupBy(*group, "_n", F.floor(F.col("_i") / DRAW_TILE).alias("_tile")).agg(
        F.array_sort(F.collect_list(F.struct("_i", *fields))).alias("_r"))
    arrays = [F.col(f"_r.{kind}{j}").alias(f"_{kind}{j}") for kind in "vh" for j in range(len(values))]
    blocks = -(-reps // DRAW_BLOCK)
    parts = max(int(numbered.sparkSession.conf.get("spark.sql.shuffle.partitions")), numbered.sparkSession.sparkContext.defaultParallelism, blocks)
    spread = tiles.select(*group, "_n", "_tile", *arrays).withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    schema = T.StructType([*[numbered.schema[c] for c in group], T.StructField("rep", T.LongType()), *[T.StructField(v, T.DoubleType()) for v in values]])

    def drawn(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("_tile")
        n, first = int(frame["_n"].iloc[0]), int(frame["_blk"].iloc[0]) * DRAW_BLOCK
        last = min(first + DRAW_BLOCK, reps)
        held = [np.concatenate(frame[f"_v{j}"].to_list()) for j in range(len(values))]
        known = [np.concatenate(frame[f"_h{j}"].to_list()) for j in range(len(values))]
        sums, met = np.zeros((len(values), last - first)), np.zeros((len(values), last - first), dtype=bool)
        for begin in range(0, n, 16 * DRAW_TILE):
            tails = [f"|{i}|{seed}".encode() for i in range(begin, min(n, begin + 16 * DRAW_TILE))]
            for number, _, a, b in numbered_md5(first, last, tails):
                twelve = a.byteswap().astype(np.uint64) << np.uint64(16) | b.astype(np.uint16).byteswap()  # hex digits of the md5
                at = (twelve - twelve // np.uint64(n) * np.uint64(n)).astype(np.int64)
                own = slice(number - first, number - first + len(a))
                for j in range(len(values)):
                    sums[j, own] += held[j][at].sum(axis=1)
                    met[j, own] |= True if known[j].all() else known[j][at].any(axis=1)
        out = frame[group].iloc[np.zeros(last - first, dtype=int)].reset_index(drop=True)
        means = {v: pd.Series(sums[j] / n).where(met[j]) for j, v in enumerate(values)}
        return out.assign(rep=np.arange(first, last), **means)

    return spread.repartition(parts, *group, "_blk").groupBy(*group, "_blk").applyInPandas(drawn, schema)


def bootstrap_mean_ci(
    df: DataFrame, values: Sequence[str], key: str = "case_id", reps: int = 10_000, alpha: float = 0.05, seed: int = 2026,
    group: Sequence[str] = (),
) -> DataFrame:
    """Percentile interval of the mean per value column: ``(<group>, metric, ci_low, ci_high)``."""
    if reps < 1:
        raise ValueError("reps must be positive")
    means = bootstrap_means(df, values, key, reps, seed, group)
    pairs = ", ".join(f"'{v}', `{v}`" for v in values)
    long = means.selectExpr(*group, f"stack({len(values)}, {pairs}) as (metric, value)")
    return exact_quantiles(long, [*group, "metric"], "value", {"ci_low": alpha / 2, "ci_high": 1 - alpha / 2})


# Poisson(1) weights from 16 hash bits: a weight is the number of these bounds at or below them.
POISSON_BOUNDS = tuple(int(65_536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8))
HASH_BLOCK = 64  # hashes of a row that one task turns into weights together


def _poisson(digests: np.ndarray) -> np.ndarray:
    """Eight weights from each 16-byte digest."""
    return np.searchsorted(POISSON_BOUNDS, digests.view(">u2"), side="right").astype(float)


def _signs(digests: np.ndarray) -> np.ndarray:
    """128 signs from each 16-byte digest; a set bit is minus."""
    return 1.0 - 2.0 * np.unpackbits(digests, axis=1)


def resampled_sums(
    df: DataFrame, values: Sequence[str], key: str, reps: int, seed: int, weights: Callable, per_hash: int, group: Sequence[str] = ()
) -> DataFrame:
    """``(<group>, rep, _w, <values>)``: the sum of weights and of weighted values in each repetition.

    Repetitions ``per_hash * k`` and following take their weights from ``md5(k|key|seed)``, so a weight depends on nothing
    but the row and the repetition. Tasks hold arrays of sums, one entry a repetition; only these sums are shuffled.
    """
    hashes = -(-reps // per_hash)
    blocks = -(-hashes // HASH_BLOCK)
    group, values = list(group), list(values)
    rows = df.select(*group, F.col(key).cast("string").alias("_key"), *[F.col(v).cast("double").alias(v) for v in values])
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    spread = rows.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(parts, "_blk", "_key")
    names = [*group, "rep", "_w", *values]
    kinds = {c: spread.schema[c].dataType for c in group} | {"rep": T.LongType()}
    schema = T.StructType([T.StructField(c, kinds.get(c, T.DoubleType())) for c in names])

    def summed(frames):
        held: dict = {}
        for frame in frames:
            for name, own in frame.groupby([*group, "_blk"], dropna=False, sort=False):
                own = own[own["_key"].notna()]
                table = np.column_stack([np.ones(len(own)), own[values].to_numpy(dtype=float)])
                keys = [f"|{k}|{seed}".encode() for k in own["_key"]]
                total = held.setdefault(name, np.zeros((HASH_BLOCK, per_hash, table.shape[1])))
                for at in range(min(HASH_BLOCK, hashes - HASH_BLOCK * name[-1])):
                    number = str(HASH_BLOCK * name[-1] + at).encode()
                    raw = b"".join([hashlib.md5(number + k, usedforsecurity=False).digest() for k in keys])
                    total[at] += weights(np.frombuffer(raw, dtype=np.uint8).reshape(-1, 16)).T @ table
        for name, total in held.items():
            flat = total.reshape(-1, total.shape[2])
            rep = np.arange(len(flat)) + HASH_BLOCK * per_hash * name[-1]
            out = pd.DataFrame(flat, columns=["_w", *values]).assign(rep=rep, **dict(zip(group, name)))
            yield out.loc[rep < reps, names]

    sums = spread.mapInPandas(summed, schema)
    return sums.groupBy(*group, "rep").agg(*[F.sum(c).alias(c) for c in ("_w", *values)])


def poisson_mean_ci(
    df: DataFrame, values: Sequence[str], key: str = "case_id", reps: int = 10_000, alpha: float = 0.05, seed: int = 2026,
    group: Sequence[str] = (),
) -> DataFrame:
    """Percentile interval of the mean per value column, ``(<group>, metric, ci_low, ci_high)``, by Poisson resampling: every
    row is drawn Poisson(1) times instead of n rows being drawn, which needs no join and no ranks.

    Rows with null key take no part; a repetition that draws nothing has no mean and is left out.
    """
    if reps < 1:
        raise ValueError("reps must be positive")
    sums = resampled_sums(df, values, key, reps, seed, _poisson, 8, group).where("_w > 0")
    pairs = ", ".join(f"'{v}', `{v}` / _w" for v in values)
    long = sums.selectExpr(*group, f"stack({len(values)}, {pairs}) as (metric, value)")
    return exact_quantiles(long, [*group, "metric"], "value", {"ci_low": alpha / 2, "ci_high": 1 - alpha / 2})


def flipped_sums(df: DataFrame, values: Sequence[str], key: str, reps: int, seed: int) -> DataFrame:
    """``(rep, <values>)``: sums of values whose sign in a repetition is minus if ``md5(rep|key|seed)`` begins with 8 to f.

    One hash a sign. Tasks hold arrays of sums, one entry a repetition; only these sums are shuffled.
    """
    values, blocks = list(values), -(-reps // FLIP_BLOCK)
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias("_key"), *[F.col(v).cast("double").alias(v) for v in values])
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), df.sparkSession.sparkContext.defaultParallelism)
    spread = rows.withColumn("_blk", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).repartition(parts, "_blk", "_key")

    def summed(frames):
        held: dict = {}
        for frame in frames:
            for blk, own in frame.groupby("_blk", sort=False):
                table = own[values].to_numpy(dtype=float)
                first = int(blk) * FLIP_BLOCK
                total = held.setdefault(first, np.zeros((min(FLIP_BLOCK, reps - first), len(values))))
                for number, at, a, _ in numbered_md5(first, first + len(total), [f"|{k}|{seed}".encode() for k in own["_key"]]):
                    signs = 1.0 - 2.0 * (a >> np.uint32(7) & np.uint32(1))
                    total[number - first:number - first + len(a)] += signs @ table[at]
        for first, total in held.items():
            yield pd.DataFrame(total, columns=values).assign(rep=np.arange(first, first + len(total)))[["rep", *values]]

    schema = T.StructType([T.StructField("rep", T.LongType()), *[T.StructField(v, T.DoubleType()) for v in values]])
    return spread.mapInPandas(summed, schema).groupBy("rep").agg(*[F.sum(v).alias(v) for v in values])


def sign_flip_p(
    df: DataFrame, deltas: Sequence[str], key: str = "case_id", reps: int = 100_000, seed: int = 2026, hash_each: bool = False
) -> DataFrame:
    """Two-sided sign-flip p-value of a zero mean delta: ``(metric, p)``, never exactly zero.

    Signs are the 128 bits of a hash, or with ``hash_each`` each from a hash of its own.
    """
    flipped = flipped_sums(df, deltas, key, reps, seed) if hash_each else resampled_sums(df, deltas, key, reps, seed, _signs, 128)
    n = df.where(F.col(key).isNotNull()).agg(F.count(F.lit(1)).alias("_n"), *[F.abs(F.avg(d)).alias(f"_o_{d}") for d in deltas])
    pairs = ", ".join(f"'{d}', abs(`{d}` / _n), `_o_{d}`" for d in deltas)
    long = flipped.crossJoin(F.broadcast(n)).selectExpr(f"stack({len(deltas)}, {pairs}) as (metric, value, observed)")  # n is one row
    tail = F.count_if(F.col("value") >= F.col("observed") - TIE)
    return long.groupBy("metric").agg(((tail + 1) / F.lit(float(reps + 1))).alias("p"))


def holm_adjust(df: DataFrame, p: str = "p", key: str = "metric") -> DataFrame:
    """Step-down family-wise adjusted p-values, one row an endpoint."""
    order = W.orderBy(p, key)
    everything = W.partitionBy()
    step = (F.count(F.lit(1)).over(everything) - F.row_number().over(order) + 1) * F.col(p)
    return (
        df.withColumn("_step", step)
        .withColumn("holm_p", F.least(F.max("_step").over(order.rowsBetween(W.unboundedPreceding, 0)), F.lit(1.0)))
        .drop("_step")
    )


def _close(a: Column, b: Column, atol: float, rtol: float) -> Column:
    return F.abs(a - b) <= F.lit(atol) + F.lit(rtol) * F.abs(b)


def pair_arms(
    left: DataFrame, right: DataFrame, metrics: Sequence[str], fold_sizes: Mapping[int, int] | None = None
) -> tuple[DataFrame, DataFrame]:
    """Paired rows with deltas (right minus left) and every broken pairing rule.

    Both arms: ``(case_id, fold, reference_volume_ml, voxel_volume_ml, reference_lesion_count, <metrics>)``.
    """
    shared = ["fold", "reference_volume_ml", "voxel_volume_ml", "reference_lesion_count"]
    side = lambda df, p: df.select("case_id", *[F.col(c).alias(p + c) for c in (*shared, *metrics)], F.lit(1).alias(p))
    both = side(left, "a_").join(side(right, "b_"), "case_id", "full_outer")
    case, none = F.col("case_id"), F.lit("")
    paired = F.col("a_").isNotNull() & F.col("b_").isNotNull()
    a, b = (lambda c: F.col(f"a_{c}")), (lambda c: F.col(f"b_{c}"))
    rules = [
        (F.col("b_").isNull(), "missing_in_right", case, none),
        (F.col("a_").isNull(), "missing_in_left", case, none),
        (paired & (a("fold") != b("fold")), "fold", case, none),
        (paired & ~_close(a("reference_volume_ml"), b("reference_volume_ml"), 1e-5, 1e-6), "reference_volume_ml", case, none),
        (paired & ~_close(a("voxel_volume_ml"), b("voxel_volume_ml"), 1e-9, 1e-6), "voxel_volume_ml", case, none),
        (paired & (a("reference_lesion_count") != b("reference_lesion_count")), "reference_lesion_count", case, none),
    ]
    for m in metrics:
        ok = finite(a(m)) & finite(b(m))
        rules.append((paired & ~ok, "not_finite", case, F.lit(m)))
        if m in SCORE_ENDPOINTS:
            rules.append((paired & ok & ~(a(m).between(0, 1) & b(m).between(0, 1)), "score_range", case, F.lit(m)))
        else:
            rules.append((paired & ok & ((a(m) < 0) | (b(m) < 0)), "negative_error", case, F.lit(m)))
    pairs = both.where(paired).select(
        "case_id", a("fold").alias("fold"), a("reference_volume_ml").alias("reference_volume_ml"),
        *[a(m).alias(f"a_{m}") for m in metrics], *[b(m).alias(f"b_{m}") for m in metrics],
        *[(b(m) - a(m)).alias(f"delta_{m}") for m in metrics],
    )
    found = [violations_of(both, rules)]
    if fold_sizes is not None:
        want = F.create_map(*[F.lit(int(x)) for kv in fold_sizes.items() for x in kv])
        n = pairs.groupBy("fold").agg(F.count(F.lit(1)).alias("n"))
        off = n.where(~F.col("n").eqNullSafe(F.element_at(want, F.col("fold").cast("int"))))
        found.append(violation(off, "fold_size", F.col("fold"), F.col("n")))
    return pairs, violations_union(found)


def long_pairs(pairs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """One row per case and metric: ``(case_id, fold, reference_volume_ml, metric, a, b, delta)``."""
    parts = ", ".join(f"'{m}', `a_{m}`, `b_{m}`, `delta_{m}`" for m in metrics)
    return pairs.selectExpr(
        "case_id", "fold", "reference_volume_ml", f"stack({len(metrics)}, {parts}) as (metric, a, b, delta)"
    )


def paired_summary(
    pairs: DataFrame, metrics: Sequence[str], bootstrap_reps: int = 20_000, flip_reps: int = 100_000, seed: int = 2026
) -> DataFrame:
    """Per metric: arm means, delta statistics, paired effect size, interval (n draws a resample) and p-values (a hash a sign)."""
    pairs = cut_lineage(pairs)
    long = long_pairs(pairs, metrics)
    sd = F.stddev_samp("delta")
    stats = long.groupBy("metric").agg(
        F.count(F.lit(1)).alias("n"), F.avg("a").alias("a_mean"), F.avg("b").alias("b_mean"),
        F.avg("delta").alias("delta_mean"), F.when(sd > 0, F.avg("delta") / sd).alias("cohens_dz"),
    )
    quartiles = exact_quantiles(long, ["metric"], "delta", {"delta_q1": 0.25, "delta_median": 0.5, "delta_q3": 0.75})
    deltas = pairs.select("case_id", *[F.col(f"delta_{m}").alias(m) for m in metrics])
    interval = bootstrap_mean_ci(deltas, metrics, reps=bootstrap_reps, seed=seed)
    p = holm_adjust(sign_flip_p(deltas, metrics, reps=flip_reps, seed=seed + 100, hash_each=True))
    return stats.join(quartiles, "metric").join(interval, "metric").join(p, "metric")


def win_loss(pairs: DataFrame, metrics: Mapping[str, str]) -> DataFrame:
    """Cases improved, worsened and unchanged; ``metrics`` maps a metric to ``higher`` or ``lower``."""
    higher = [m for m, direction in metrics.items() if direction == "higher"]
    gain = F.when(F.col("metric").isin(higher), F.col("b") - F.col("a")).otherwise(F.col("a") - F.col("b"))
    return long_pairs(pairs, list(metrics)).withColumn("_g", gain).groupBy("metric").agg(
        F.count_if(F.col("_g") > 0).alias("improved"),
        F.count_if(F.col("_g") < 0).alias("worsened"),
        F.count_if(F.abs(F.col("_g")) <= TIE).alias("unchanged"),
    )


def volume_quartiles(pairs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Means by reference-volume quartile; a value on a bound falls in the lower bin."""
    bounds = exact_quantiles(
        pairs.withColumn("_g", F.lit(0)), ["_g"], "reference_volume_ml", {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    )
    v = F.col("reference_volume_ml")
    quartile = F.when(v <= F.col("q25"), 1).when(v <= F.col("q50"), 2).when(v <= F.col("q75"), 3).otherwise(4)
    binned = pairs.withColumn("_g", F.lit(0)).join(F.broadcast(bounds), "_g").withColumn("quartile", quartile)  # one row
    parts = ", ".join(f"'{m}', `a_{m}`, `b_{m}`, `delta_{m}`" for m in metrics)
    return binned.selectExpr(
        "quartile", "reference_volume_ml", f"stack({len(metrics)}, {parts}) as (metric, a, b, delta)"
    ).groupBy("metric", "quartile").agg(
        F.count(F.lit(1)).alias("n"), F.avg("reference_volume_ml").alias("mean_reference_volume_ml"),
        F.avg("a").alias("a_mean"), F.avg("b").alias("b_mean"), F.avg("delta").alias("delta_mean"),
    )


def fold_means(pairs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    return long_pairs(pairs, metrics).groupBy("metric", "fold").agg(
        F.count(F.lit(1)).alias("n"), F.avg("a").alias("a_mean"), F.avg("b").alias("b_mean")
    )


def leave_one_fold_out(pairs: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """Mean delta without each fold, as total minus the fold's own sum: one pass over the pairs."""
    per_fold = long_pairs(pairs, metrics).groupBy("metric", "fold").agg(
        F.sum("delta").alias("_s"), F.count(F.lit(1)).alias("_n")
    )
    every = W.partitionBy("metric")
    rest_n = F.sum("_n").over(every) - F.col("_n")
    rest = F.sum("_s").over(every) - F.col("_s")
    return per_fold.select("metric", "fold", rest_n.alias("n"), F.when(rest_n > 0, rest / rest_n).alias("delta_mean"))


def report_lines(summary: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Markdown table rows of a paired summary, in the order of ``names``: ``(line_no, line)``."""
    order = list(names)
    number = F.array_position(F.array(*[F.lit(m) for m in order]), F.col("metric")).cast("int")
    label = F.element_at(F.array(*[F.lit(names[m]) for m in order]), number)
    line = F.format_string(
        "| %s | %.5f | %.5f | %+.5f | [%+.5f, %+.5f] | %.5f | %.5f |",
        label, "a_mean", "b_mean", "delta_mean", "ci_low", "ci_high", "p", "holm_p",
    )
    return summary.where(F.col("metric").isin(order)).select(number.alias("line_no"), line.alias("line"))


def sensitivity_lines(rows: DataFrame, key: str, value: str = "delta_mean", prefix: str = "") -> DataFrame:
    """Markdown rows ``| metric | key | n | value |`` of fold or quartile sensitivity tables."""
    line = F.format_string(f"| %s | {prefix}%d | %d | %+.5f |", F.col("metric"), F.col(key), F.col("n"), F.col(value))
    return rows.select("metric", F.col(key).cast("int").alias("line_no"), line.alias("line"))
