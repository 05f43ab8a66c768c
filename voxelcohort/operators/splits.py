"""Leakage-safe cohort splits, fold audits and hash-ordered sampling."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from voxelcohort.functions import (
    constant_rows,
    finite,
    hash_key,
    order_bucket,
    pack_voxel,
    take_lowest,
    violation,
    violations_of,
    violations_union,
    with_rank,
)
from voxelcohort.functions.ordering import join_same
from voxelcohort.session import cut_lineage, small_side

HASH_DIGITS = 3  # 4,096 hash buckets


def _hash_ranked(df: DataFrame, group: Sequence[str], keys: Sequence[str], seed: int) -> DataFrame:
    keyed = df.withColumn("_h", hash_key(keys, seed))
    return with_rank(
        keyed, group, ["_h", *keys], F.substring("_h", 1, HASH_DIGITS), name="_rank", total="_total"
    ).drop("_h")


def holdout_split(
    cases: DataFrame, train_size: int | None = None, test_fraction: float = 0.3, seed: int = 2026
) -> DataFrame:
    """Each unique case gets role ``train`` or ``test``; the test share rounds half to even."""
    ranked = _hash_ranked(cases.select("case_id").distinct(), [], ["case_id"], seed)
    if train_size is None:
        if not 0.0 < test_fraction < 1.0:
            raise ValueError("test_fraction must lie strictly between 0 and 1")
        n_train = F.col("_total") - F.greatest(F.lit(1), F.rint(F.col("_total") * test_fraction).cast("long"))
    else:
        if train_size < 1:
            raise ValueError("train_size must be positive")
        n_train = F.lit(train_size)
    return ranked.select(
        "case_id",
        F.when(F.col("_rank") <= n_train, "train").otherwise("test").alias("role"),
        F.col("_rank").alias("position"),
    )


def holdout_splits(cases: DataFrame, seeds: Mapping[str, int], test_fraction: float = 0.3) -> DataFrame:
    """``holdout_split`` under every seed of ``{name: seed}`` in one pass: ``(data, case_id, role)``."""
    named = F.explode(F.array(*[F.struct(F.lit(n).alias("data"), F.lit(str(s)).alias("_seed")) for n, s in seeds.items()]))
    every = cases.select("case_id").distinct().select("case_id", named.alias("_s")).select("case_id", "_s.data", "_s._seed")
    keyed = every.withColumn("_h", F.md5(F.concat_ws("|", F.col("case_id").cast("string"), "_seed")))
    ranked = with_rank(keyed, ["data"], ["_h", "case_id"], F.substring("_h", 1, HASH_DIGITS), name="_rank", total="_total")
    n_train = F.col("_total") - F.greatest(F.lit(1), F.rint(F.col("_total") * test_fraction).cast("long"))
    return ranked.select("data", "case_id", F.when(F.col("_rank") <= n_train, "train").otherwise("test").alias("role"))


def split_violations(split: DataFrame) -> DataFrame:
    """Both sides of a holdout need at least one case, and no case may sit on both."""
    sides = split.agg(
        F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "test").alias("n_test")
    )
    both = split.groupBy("case_id").agg(F.count_distinct("role").alias("n")).where("n > 1")
    return violations_union([
        violation(sides.where("n_train < 1"), "empty_train", F.lit("split"), F.col("n_train")),
        violation(sides.where("n_test < 1"), "empty_test", F.lit("split"), F.col("n_test")),
        violation(both, "case_on_both_sides", F.col("case_id"), F.col("n")),
    ])


def kfold(cases: DataFrame, n_splits: int = 5, seed: int = 2026) -> DataFrame:
    """Validation fold of every case: disjoint, exhaustive, first folds one larger."""
    if n_splits < 2:
        raise ValueError("n_splits must be at least 2")
    ranked = _hash_ranked(cases.select("case_id").distinct(), [], ["case_id"], seed)
    r, n, k = F.col("_rank") - 1, F.col("_total"), n_splits
    small = F.floor(n / k)
    large_rows = (n % k) * (small + 1)
    fold = F.when(r < large_rows, F.floor(r / (small + 1))).otherwise(
        n % k + F.floor((r - large_rows) / F.greatest(small, F.lit(1)))
    )
    return ranked.select("case_id", fold.cast("int").alias("fold"))


def expand_folds(val_folds: DataFrame, n_splits: int = 5) -> DataFrame:
    """Long roles: a case validates in its own fold and trains in every other."""
    rows = val_folds.withColumnRenamed("fold", "_val")
    rows = constant_rows(rows, range(n_splits), "fold")
    return rows.select(
        "fold", F.when(F.col("fold") == F.col("_val"), "val").otherwise("train").alias("role"), "case_id"
    )


def check_folds(
    folds: DataFrame, expected: DataFrame, n_splits: int = 5, sizes: Sequence[int] | None = None
) -> DataFrame:
    """Violations of out-of-fold isolation: coverage, overlap, duplicates, complement, sizes."""
    wanted = expected.select("case_id").distinct()
    per_case = folds.groupBy("case_id").agg(
        F.count_if(F.col("role") == "val").alias("n_val"),
        F.concat_ws(",", F.array_sort(F.collect_set(F.when(F.col("role") == "val", F.col("fold"))))).alias("val_folds"),
    )
    coverage = wanted.withColumn("_e", F.lit(1)).join(per_case, "case_id", "full_outer")
    per_fold_case = folds.groupBy("fold", "case_id").agg(
        F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "val").alias("n_val")
    )
    fold_case = F.concat_ws("/", F.col("fold"), F.col("case_id"))
    n_train, n_val = F.coalesce("n_train", F.lit(0)), F.coalesce("n_val", F.lit(0))
    planned = constant_rows(wanted, range(n_splits), "fold").withColumn("_e", F.lit(1))
    roles = planned.join(per_fold_case, ["fold", "case_id"], "full_outer")
    none = F.lit("")
    out = [
        violations_of(coverage, [
            (F.col("n_val") > 1, "val_repeated", F.col("case_id"), F.col("val_folds")),
            (F.col("_e").isNotNull() & (n_val == 0), "val_missing", F.col("case_id"), none),
            (F.col("_e").isNull(), "case_unexpected", F.col("case_id"), none),
        ]),
        violations_of(roles, [
            (n_train > 1, "train_repeated", fold_case, n_train),
            ((n_train > 0) & (n_val > 0), "train_val_overlap", fold_case, none),
            (n_train + n_val == 0, "train_not_complement", fold_case, none),
        ]),
    ]
    if sizes is not None:
        expected_size = F.element_at(F.array(*[F.lit(int(s)) for s in sizes]), F.col("fold") + 1)
        n_val = folds.groupBy("fold").agg(F.count_if(F.col("role") == "val").alias("n"))
        out.append(violation(n_val.where(F.col("n") != expected_size), "val_size", F.col("fold"), F.col("n")))
    return violations_union(out)


def compare_folds(left: DataFrame, right: DataFrame) -> DataFrame:
    """Ids missing from or added to ``right``, and ids present in both at another position."""
    a = left.select("fold", "role", "case_id", F.col("pos").alias("left_pos"))
    b = right.select("fold", "role", "case_id", F.col("pos").alias("right_pos"))
    kind = (
        F.when(F.col("right_pos").isNull(), "missing")
        .when(F.col("left_pos").isNull(), "extra")
        .when(F.col("left_pos") != F.col("right_pos"), "order")
    )
    return (
        a.join(b, ["fold", "role", "case_id"], "full_outer")
        .withColumn("kind", kind)
        .where(F.col("kind").isNotNull())
        .select("fold", "role", "case_id", "kind", "left_pos", "right_pos")
    )


def pixel_partition(
    pixels: DataFrame,
    keys: Sequence[str],
    train_fraction: float,
    validation_fraction: float = 0.0,
    seed: int = 2026,
) -> DataFrame:
    """Random pixel roles inside each case. A leakage diagnostic, never an evaluation split."""
    if not 0.0 < train_fraction < 1.0 or not 0.0 <= validation_fraction < 1.0:
        raise ValueError("fractions must lie between 0 and 1")
    if train_fraction + validation_fraction >= 1.0:
        raise ValueError("a test share must remain")
    ranked = _hash_ranked(pixels, ["case_id"], ["case_id", *keys], seed)
    n_train = F.floor(F.col("_total") * train_fraction)
    n_val = F.floor(F.col("_total") * validation_fraction)
    role = (
        F.when(F.col("_rank") <= n_train, "train")
        .when(F.col("_rank") <= n_train + n_val, "validation")
        .otherwise("test")
    )
    return ranked.withColumn("role", role).drop("_rank", "_total")


def balanced_sample(
    df: DataFrame, label: str, keys: Sequence[str], target: int = 15_000, seed: int = 2026, group: Sequence[str] = ()
) -> DataFrame:
    """Equal numbers of both classes, at most ``target`` each, without replacement, in each ``group`` by itself."""
    if target < 1:
        raise ValueError("target must be positive")
    everything = W.partitionBy(*group)

    def per_class(totals: DataFrame) -> Column:
        sizes = [F.sum(F.when(F.col("_class") == c, F.col("_n")).otherwise(0)).over(everything) for c in (1, 0)]
        return F.least(F.lit(target), *sizes)

    flagged = df.withColumn("_class", F.col(label).cast("int")).withColumn("_h", hash_key(keys, seed))
    return take_lowest(flagged, [*group, "_class"], "_h", keys, per_class).drop("_class", "_h")


def thinned(df: DataFrame, sizes: Mapping[tuple[str, int | None], int], keys: Sequence[str], target: int, seed: int = 2026) -> DataFrame:
    """Rows ``(data, label, <keys>)`` in which ``balanced_sample`` by ``data`` finds the same sample as in all of ``df``.

    ``sizes`` counts the rows of each ``(data, label)``. A row is hashed once and stays below a bound that leaves eight
    deviations more rows than the sample takes; should a class keep too few, all rows are returned.
    """
    wants = {data: min(target, *(sizes.get((data, c), 0) for c in (0, 1))) for data, _ in sizes}
    shares = {key: (wants[key[0]] + 8 * wants[key[0]] ** 0.5 + 64) / n for key, n in sizes.items()}
    bounds = [F.lit(x) for (data, c), share in shares.items() for x in (f"{data}|{c}", f"{int(share * 16 ** 8):08x}" if share < 1 else "g")]
    bound = F.element_at(F.create_map(*bounds), F.concat_ws("|", "data", F.coalesce(F.col("label").cast("string"), F.lit("None"))))
    kept = cut_lineage(df.where(hash_key(keys, seed) < bound))
    found = {(r["data"], r["label"]): r["count"] for r in kept.groupBy("data", "label").count().collect()}  # two a data set
    return kept if all(found.get(key, 0) >= min(wants[key[0]], n) for key, n in sizes.items()) else df


def class_violations(df: DataFrame, label: str) -> DataFrame:
    """Balanced sampling needs both classes."""
    n = df.agg(F.count_if(F.col(label).cast("int") == 1).alias("pos"), F.count_if(F.col(label).cast("int") == 0).alias("neg"))
    return violations_union([
        violation(n.where("pos = 0"), "class_missing", F.lit("1"), F.col("neg")),
        violation(n.where("neg = 0"), "class_missing", F.lit("0"), F.col("pos")),
    ])


def support_sample(voxels: DataFrame, max_samples: int = 4096, seed: int = 2026) -> DataFrame:
    """Up to ``max_samples`` finite voxels of each case and channel, uniform without replacement.

    ``voxels`` holds support voxels only: ``(case_id, channel, z, y, x, value)``.
    """
    if max_samples < 16:
        raise ValueError("max_samples must be at least 16")
    group, rows = ["case_id", "channel"], voxels.where(finite(F.col("value")))
    sizes = cut_lineage(rows.groupBy(*group).agg(F.count(F.lit(1)).alias("_n")))
    of = lambda rule: join_same(rows, small_side(sizes.where(rule).select(*group), 1_000_000), group)
    whole = of(F.col("_n") <= max_samples)  # such a group is its own sample: nothing to hash, to count by hash or to rank
    larger = F.col("_n") > max_samples
    if sizes.where(larger).isEmpty():
        return whole
    keyed = of(larger).withColumn("_h", hash_key(["case_id", "channel", "z", "y", "x"], seed))
    return whole.unionByName(take_lowest(keyed, group, "_h", ["z", "y", "x"], max_samples).drop("_h"))


def support_sample_violations(voxels: DataFrame, minimum: int = 16) -> DataFrame:
    """Case and channel pairs with too few finite support voxels."""
    few = voxels.groupBy("case_id", "channel").agg(F.count_if(finite(F.col("value"))).alias("n")).where(F.col("n") < minimum)
    return violation(few, "too_few_samples", F.concat_ws("/", "case_id", "channel"), F.col("n"))


def stride_sample(
    voxels: DataFrame, max_n: int, mode: str, shape: tuple[int, int, int] | None = None
) -> DataFrame:
    """Every s-th voxel. ``finite``: among finite values in raster order; ``grid``: by flat offset."""
    if mode == "grid":
        depth, height, width = shape
        step = max(1, -(-depth * height * width // max_n))
        flat = (F.col("z") * height + F.col("y")) * width + F.col("x")
        return voxels.where((flat % step == 0) & finite(F.col("value")))
    if mode != "finite":
        raise ValueError("mode must be 'finite' or 'grid'")
    ranked = with_rank(
        voxels.where(finite(F.col("value"))), ["case_id", "channel"], ["z", "y", "x"],
        pack_voxel(F.col("z"), F.col("y"), F.lit(0)), name="_rank", total="_n",
    )
    step = F.greatest(F.lit(1), F.ceil(F.col("_n") / max_n))
    return ranked.where((F.col("_rank") - 1) % step == 0).drop("_rank", "_n")


def evenly_spaced_pick(cases: DataFrame, n: int) -> DataFrame:
    """``n`` sorted ids at positions ``i*(m-1) div (n-1)``, by integer arithmetic."""
    ids = cases.select("case_id").distinct()
    ranked = with_rank(ids, [], ["case_id"], order_bucket(ids, "case_id"), name="_r", total="_m")
    r, gaps = F.col("_r") - 1, F.greatest(F.col("_m") - 1, F.lit(1))
    i = F.ceil(r * (n - 1) / gaps)
    chosen = (r == 0) if n == 1 else (F.floor(i * gaps / (n - 1)) == r) & (i <= n - 1)
    return ranked.where(chosen).select(F.col("case_id"), r.alias("position"))


def fold_file_plan(folds: DataFrame, arms: Sequence[tuple[str, int]]) -> DataFrame:
    """Expected files: images for every case, labels for training cases, none for held-out ones."""
    arm = F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), F.lit(c).alias("n")) for a, c in arms]))
    rows = folds.select("fold", "role", "case_id", arm.alias("_a")).select("fold", "role", "case_id", "_a.arm", "_a.n")
    group = F.when(F.col("role") == "train", "imagesTr").otherwise("imagesTs")
    images = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select(
        "fold", "arm", "case_id", group.alias("group"),
        F.format_string("%s_%04d.nii.gz", F.col("case_id").cast("string"), F.col("_i")).alias("file_name"),
    )
    labels = rows.where("role = 'train'").select(
        "fold", "arm", "case_id", F.lit("labelsTr").alias("group"),
        F.format_string("%s.nii.gz", F.col("case_id").cast("string")).alias("file_name"),
    )
    return images.unionByName(labels)


def reconcile_inventory(expected: DataFrame, actual: DataFrame, folds: DataFrame) -> DataFrame:
    """Differences between planned and present files, with held-out leaks named as such.

    Both file tables: ``(fold, arm, case_id, group, file_name)``.
    """
    key = ["fold", "arm", "file_name"]
    present = actual.groupBy(*key, "group", "case_id").agg(F.count(F.lit(1)).alias("copies"))
    plan = expected.select(*key, F.col("group").alias("planned"))
    held_out = folds.where("role = 'val'").select("fold", "case_id").distinct().withColumn("_held", F.lit(True))
    both = plan.join(present, key, "full_outer").join(held_out, ["fold", "case_id"], "left")
    name = F.concat_ws("/", "fold", "arm", "file_name")
    group, planned, held = F.col("group"), F.col("planned"), F.col("_held")
    return violations_of(both, [
        (group.isNull(), "missing", name, planned),
        (planned.isNull(), "extra", name, group),
        (planned != group, "wrong_group", name, group),
        (F.col("copies") > 1, "duplicate", name, F.col("copies")),
        (held & (group == "labelsTr"), "heldout_label", name, group),
        (held & (group == "imagesTr"), "heldout_image", name, group),
    ])


def inventory_count_violations(actual: DataFrame, declared: DataFrame) -> DataFrame:
    """Declared file counts per ``(fold, arm, group)`` must equal the counted ones."""
    key = ["fold", "arm", "group"]
    counted = actual.groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    off = declared.join(counted, key, "full_outer").where(~F.col("declared").eqNullSafe(F.col("n")))
    return violation(off, "declared_count", F.concat_ws("/", *key), F.coalesce("n", F.lit(0)))


def missing_artifacts(cases: DataFrame, suffixes: Sequence[str], files: DataFrame) -> DataFrame:
    """Cases lacking a non-empty file for any required suffix."""
    need = constant_rows(cases.select("case_id").distinct(), suffixes, "suffix")
    have = files.where("length > 0").select("case_id", "suffix")
    return need.join(have, ["case_id", "suffix"], "left_anti")


def shard_plan(files: DataFrame, per_shard: int = 10) -> DataFrame:
    """Consecutive groups of sorted subjects with file count, bytes and subject list."""
    per_case = files.groupBy("case_id").agg(F.count(F.lit(1)).alias("_files"), F.sum("size").alias("_bytes"))
    ranked = with_rank(per_case, [], ["case_id"], order_bucket(per_case, "case_id"), name="_r")
    return (
        ranked.withColumn("shard", F.floor((F.col("_r") - 1) / per_shard))
        .groupBy("shard")
        .agg(
            F.count(F.lit(1)).alias("subjects"),
            F.sum("_files").alias("files"),
            F.sum("_bytes").alias("bytes"),
            F.array_join(F.transform(F.array_sort(F.collect_list("case_id")), lambda c: c.cast("string")), ",").alias("subject_list"),
        )
    )
