"""Pixel-classifier jobs: features for every case in one frame, one fit, grouped metrics."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import partial, reduce
from itertools import product

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelcohort.operators import masks, metrics, models, preprocess, splits
from voxelcohort.operators.batch_models import Condition, evaluate_svms, fit_svms, score_svms
from voxelcohort.operators.features import FEATURE_NAMES, nine_features, run_columns, variant_features
from voxelcohort.session import cut_lineage, read_if_present, small_side

# Fixed sensitivity grids.
FEATURE_VARIANTS = {
    "minimal_count_t20": ("paper_minimal", "threshold_count", 20.0),
    "minimal_centered_t20": ("paper_minimal", "centered_run", 20.0),
    "minimal_max_t20": ("paper_minimal", "max_run", 20.0),
    **{
        f"uint8_{short}_t{t}": ("robust_uint8", mode, float(t))
        for short, mode in (("count", "threshold_count"), ("centered", "centered_run"), ("max", "max_run"))
        for t in (10, 20, 40)
    },
}
SPLIT_SEEDS = tuple(range(20))
SVM_GRID = tuple(product(("standard", "minmax", "none"), (0.1, 1.0, 10.0), ("scale", 0.01, 0.1)))
MORPHOLOGY_RADII, MORPHOLOGY_SCALERS = (0, 1, 2, 3, 5), ("standard", "none")
LEAKAGE_SPLITS = {"pixel_70_30": (0.70, 0.0), "pixel_70_15_15": (0.70, 0.15)}
HISTOGRAM_MODES = ("none", "first", "median_nearest")
SCORES = ("dice", "precision", "recall", "auc")
CASES = 1_000_000  # rows of a case and some small numbers that are broadcast
IMAGE_PIXELS = 1 << 20  # images up to this size are evaluated in one task, larger ones by distributed steps

Fit = Callable[[DataFrame], models.PixelModel]


def choose_slices(voxels: DataFrame, strategy: str = "max_lesion") -> DataFrame:
    """Pixels ``(case_id, row, col, value, label)`` of one chosen slice a case."""
    chosen = preprocess.pick_slice(voxels, strategy)
    return voxels.join(chosen, ["case_id", "z"], "left_semi").select(
        "case_id", F.col("y").alias("row"), F.col("x").alias("col"), "value", "label"
    )


def prepare_pixels(
    pixels: DataFrame, mode: str = "paper_minimal", options: Mapping[str, object] | None = None,
    image: Sequence[str] = ("case_id",), median_size: int = 3,
) -> DataFrame:
    """Preprocess, nine features, then brain pixels only; ``label`` becomes 0 or 1.

    The brain filter stays behind the windows, which need whole images. Images are single slices, so pixels move once, dealt
    by image, and every window finds its line in place.
    """
    return _featured(preprocess.preprocess(dealt(pixels, image), mode, median_size, image), options, image)


def dealt(pixels: DataFrame, image: Sequence[str] = ("case_id",)) -> DataFrame:
    """Pixels by image in as many tasks as the session's shuffles have: few bytes here are much work, so they are not merged."""
    return pixels.repartition(int(pixels.sparkSession.conf.get("spark.sql.shuffle.partitions")), *image)


def _featured(filtered: DataFrame, options: Mapping[str, object] | None, image: Sequence[str] = ("case_id",)) -> DataFrame:
    return brain_rows(nine_features(filtered, image, **(options or {})))


def brain_rows(featured: DataFrame) -> DataFrame:
    return featured.where("brain").withColumn("label", (F.col("label").cast("int") > 0).cast("int"))


def prepare_variants(pixels: DataFrame, mode: str, variants: Sequence[tuple[str, float]]) -> DataFrame:
    """``prepare_pixels`` of several run variants side by side, in the columns ``run_columns`` names."""
    return brain_rows(variant_features(preprocess.preprocess(dealt(pixels), mode), variants))


def image_shapes(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("case_id").agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))


def closed_overlap(scored: DataFrame, shapes: DataFrame, close_radius: int) -> DataFrame:
    """Per-case overlap of scored brain pixels after closing the predicted mask; what closing adds outside them is no row."""
    pixel = ["case_id", "row", "col"]
    closed = masks.close_2d(scored.where("prediction > 0").select(*pixel), shapes, close_radius).select(*pixel, F.lit(1).alias("_closed"))
    return metrics.overlap_metrics_dense(scored.join(closed, pixel, "left"), F.col("label") == 1, F.col("_closed").isNotNull())


def evaluate_scored(scored: DataFrame, shapes: DataFrame, close_radius: int, model: str) -> DataFrame:
    """Per-case metrics of scored brain pixels after closing the predicted mask."""
    auc = metrics.roc_auc(scored, "score", "label").select("case_id", "auc")
    return closed_overlap(scored, shapes, close_radius).join(auc, "case_id", "left").withColumn("model", F.lit(model))


def train_eval(
    pixels: DataFrame, split: DataFrame, fits: Mapping[str, Fit], mode: str = "paper_minimal",
    options: Mapping[str, object] | None = None, target: int = 15_000, close_radius: int = 1, seed: int = 2026,
    prepared: DataFrame | None = None,
) -> DataFrame:
    """Case metrics of each model on held-out cases; ``split``: ``(case_id, role)``.

    Features are computed and materialised once; fitting sees only the balanced sample.
    """
    feats = cut_lineage(prepare_pixels(pixels, mode, options)) if prepared is None else prepared
    train = feats.join(split.where("role = 'train'"), "case_id", "left_semi")
    sample = cut_lineage(splits.balanced_sample(train, "label", ["case_id", "row", "col"], target, seed))
    test = feats.join(split.where("role = 'test'"), "case_id", "left_semi")
    shapes = image_shapes(pixels)
    parts = [
        evaluate_scored(cut_lineage(fit(sample).score(test).select("case_id", "row", "col", "label", "score", "prediction")),
                        shapes, close_radius, name)
        for name, fit in fits.items()
    ]
    return reduce(DataFrame.unionByName, parts)


def pixel_leakage_eval(
    pixels: DataFrame, fit: Fit, train_fraction: float, validation_fraction: float = 0.0, target: int = 2_000, seed: int = 2026
) -> DataFrame:
    """Random pixels of the same case on both sides: a leakage diagnostic, invalid as evaluation by design."""
    feats = cut_lineage(prepare_pixels(pixels))
    roles = cut_lineage(splits.pixel_partition(feats, ["row", "col"], train_fraction, validation_fraction, seed))
    sample = cut_lineage(splits.balanced_sample(roles.where("role = 'train'"), "label", ["case_id", "row", "col"], target, seed))
    scored = cut_lineage(fit(sample).score(roles.where("role = 'test'")).select("case_id", "label", "score", "prediction"))
    rows = metrics.overlap_metrics_dense(scored, F.col("label") == 1, F.col("prediction") == 1)
    return rows.join(metrics.roc_auc(scored, "score", "label").select("case_id", "auc"), "case_id").withColumn(
        "model", F.lit("pixel_leakage")
    )


def histogram_matched(pixels: DataFrame, split: DataFrame, mode: str, options: Mapping[str, object] | None = None) -> DataFrame:
    """Features after matching every brain histogram to a training reference case."""
    filtered = preprocess.preprocess(pixels)
    if mode != "none":
        filtered = cut_lineage(filtered)
        reference = preprocess.reference_case(filtered, split.where("role = 'train'"), mode)
        brain = filtered.where("brain")
        matched = preprocess.histogram_match(brain, brain.join(reference, "case_id", "left_semi").select("value"))
        moved = matched.select("case_id", "row", "col", "matched")
        filtered = filtered.join(moved, ["case_id", "row", "col"], "left").withColumn(
            "value", F.coalesce("matched", F.lit(0.0))
        ).drop("matched")
    return cut_lineage(_featured(filtered, options))


def histogram_eval(pixels: DataFrame, split: DataFrame, fit: Fit, mode: str, target: int = 15_000, seed: int = 2026) -> DataFrame:
    prepared = histogram_matched(pixels, split, mode)
    return train_eval(pixels, split, {f"histogram_{mode}": fit}, target=target, seed=seed, prepared=prepared)


def summarize(rows: DataFrame) -> DataFrame:
    """Mean and deviation of each score per model, one row a model."""
    stats = metrics.finite_summary(rows, SCORES)
    return stats.groupBy("model").agg(
        F.max("n").alias("cases"),
        *[F.max(F.when(F.col("metric") == m, F.col(s))).alias(f"{m}_{s}") for m in SCORES for s in ("mean", "std")],
    )


def evaluate_conditions(scored: DataFrame, shapes: DataFrame, radii: Sequence[int] = (1,)) -> DataFrame:
    """Case metrics of ``(condition, case_id, row, col, label, score, prediction)``, all conditions in one plan.

    Every (condition, case) is an image of its own. With several ``radii`` the closing radius joins the condition's name.
    Scored pixels are stored once, dealt by image, which the steps per image need.
    """
    image = F.concat_ws("|", "condition", "case_id")
    images = cut_lineage(scored.withColumn("_case", F.col("case_id")).withColumn("case_id", image).drop("condition").repartition("case_id"))
    sized = images.select("case_id", "_case").distinct().join(shapes.withColumnRenamed("case_id", "_case"), "_case").drop("_case")
    sized = cut_lineage(sized) if len(radii) > 1 else sized
    auc = metrics.roc_auc(images, "score", "label").select("case_id", "auc")
    auc = cut_lineage(auc) if len(radii) > 1 else auc  # the same under every radius
    parts = []
    for radius in radii:
        rows = closed_overlap(images, sized, radius).join(auc, "case_id", "left")
        name = F.substring_index("case_id", "|", 1)
        rows = rows.withColumn("model", name if len(radii) == 1 else F.concat(name, F.lit(f"_close_{radius}")))
        parts.append(rows.withColumn("case_id", F.expr("substr(case_id, instr(case_id, '|') + 1)")))
    return reduce(DataFrame.unionByName, parts)


def morphology_sweep(scored: DataFrame, shapes: DataFrame, radii: Sequence[int] = MORPHOLOGY_RADII) -> DataFrame:
    """Scored conditions evaluated under every closing radius, no refit."""
    return summarize(evaluate_conditions(scored, shapes, radii)).withColumnRenamed("model", "condition")


def best_first(summaries: DataFrame) -> DataFrame:
    return summaries.orderBy(F.col("dice_mean").desc(), "condition")


def _finished(spark: SparkSession, path: str) -> set[str]:
    saved = read_if_present(spark, path)
    return set() if saved is None else {r["condition"] for r in saved.select("condition").distinct().collect()}  # grid-sized


def run_sweep(spark: SparkSession, conditions: Mapping[str, Callable[[], DataFrame]], path: str) -> DataFrame:
    """Run conditions that share nothing one by one, each appended as its own partition; finished ones are skipped.

    Returns all summaries, best dice first, then by name.
    """
    done = _finished(spark, path)
    for name, run in conditions.items():
        if name not in done:
            run().withColumn("condition", F.lit(name)).write.mode("append").partitionBy("condition").parquet(path)
    return best_first(spark.read.parquet(path))


def run_grid(spark: SparkSession, names: Sequence[str], run: Callable[[list[str]], DataFrame], path: str) -> DataFrame:
    """Run the predeclared conditions that ``path`` does not hold yet, all in one job; returns all summaries, best first.

    ``run`` takes names and gives summaries ``(condition, ...)``, which land in one partition a condition.
    """
    done = _finished(spark, path)
    todo = [n for n in names if n not in done]
    if todo:
        run(todo).write.mode("append").partitionBy("condition").parquet(path)
    return best_first(spark.read.parquet(path))


def scored_conditions(data: DataFrame, conditions: Sequence[Condition], target: int, seed: int = 2026) -> DataFrame:
    """Held-out scores of every condition; ``data``: ``(data, role, case_id, row, col, label, <features>)``."""
    train = data.where("role = 'train'")
    sample = splits.balanced_sample(train, "label", ["data", "case_id", "row", "col"], target, seed, group=["data"])
    fitted = fit_svms(sample, conditions)
    return score_svms(data.where("role = 'test'"), conditions, fitted, ["case_id", "row", "col", "label"])


def score_held_out(
    pixels: DataFrame, split: DataFrame, prepare: Mapping[str, Callable[[DataFrame], DataFrame]], conditions: Sequence[Condition],
    target: int, seed: int = 2026,
) -> DataFrame:
    """Held-out scores of every condition, as ``scored_conditions``; ``prepare`` gives the features of each data set.

    The sample is drawn from keys and labels before there are features, so these are made for the images of sampled and of
    held-out pixels only, and only those pixels are stored.
    """
    needed = [n for n in prepare if n in {c.data for c in conditions}]
    roles = with_roles(pixels, split)
    train = roles.where("role = 'train'").where(masks.brain_mask(F.col("value")))
    keys = train.select("case_id", "row", "col", (F.col("label").cast("int") > 0).cast("int").alias("label"))
    named = keys.withColumn("data", F.explode(F.array(*[F.lit(n) for n in needed])))
    pixel, parts = ["case_id", "row", "col"], []
    drawn = cut_lineage(splits.balanced_sample(named, "label", ["data", *pixel], target, seed, group=["data"]).select("data", *pixel))
    for name in needed:
        own = drawn.where(F.col("data") == name).select(*pixel, F.lit(True).alias("drawn"))  # at most 2 * target rows
        images = F.broadcast(own.select("case_id", F.lit(True).alias("_any")).distinct())
        wanted = roles.join(images, "case_id", "left").where("role = 'test' or _any").drop("_any")
        feats = prepare[name](wanted).join(F.broadcast(own), pixel, "left").where("role = 'test' or drawn")
        parts.append(feats.withColumn("data", F.lit(name)))
    data = cut_lineage(reduce(DataFrame.unionByName, parts))
    fitted = fit_svms(data.where("drawn"), conditions)
    return score_svms(data.where("role = 'test'"), conditions, fitted, [*pixel, "label"])


def roles_of(split: DataFrame, names: Sequence[str]) -> DataFrame:
    """``(case_id, train, held)`` where all data sets share one split."""
    every, none = F.array(*[F.lit(n) for n in names]), F.array().cast("array<string>")
    of = lambda role: F.when(F.col("role") == role, every).otherwise(none)
    return split.select("case_id", of("train").alias("train"), of("test").alias("held"))


def evaluate_sets(
    pixels: DataFrame, roles: DataFrame, prepare: Callable[[DataFrame], DataFrame], columns: Mapping[str, Sequence[str]],
    conditions: Sequence[Condition], target: int, seed: int = 2026,
) -> DataFrame:
    """Case metrics ``(model, case_id, <scores>)`` of every condition on the images that its data set holds out.

    ``roles``: ``(case_id, train, held)``, the data sets that train on an image and those that hold it out; ``columns``: the
    feature columns of each set in what ``prepare`` makes. The sample is drawn from keys and labels, so only its rows are
    stored; held-out pixels move once, to the task of their image, which emits the image's metrics.
    """
    names, pixel = list(columns), ["case_id", "row", "col"]
    known = F.array(*[F.lit(n) for n in names])
    places = lambda c: F.transform(c, lambda d: (F.array_position(known, d) - 1).cast("short"))
    roles = small_side(roles.select("case_id", places("train").alias("train"), places("held").alias("held")), CASES)
    train = pixels.where(masks.brain_mask(F.col("value"))).join(roles.select("case_id", "train"), "case_id")
    keys = train.select(*pixel, (F.col("label").cast("int") > 0).cast("int").alias("label"), F.explode("train").alias("_i"))
    keys = keys.withColumn("data", F.get(known, F.col("_i"))).drop("_i")
    per_case = train.groupBy("case_id", "train", (F.col("label").cast("int") > 0).cast("int").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    per_set = per_case.select("label", "n", F.explode("train").alias("_i"))
    sizes = {(names[r["_i"]], r["label"]): r["n"] for r in per_set.groupBy("_i", "label").agg(F.sum("n").alias("n")).collect()}  # two a set
    keys = splits.thinned(keys, sizes, ["data", *pixel], target, seed) if sizes else keys
    drawn = cut_lineage(splits.balanced_sample(keys, "label", ["data", *pixel], target, seed, group=["data"]).select("data", *pixel))
    own = F.broadcast(drawn.groupBy(*pixel).agg(F.collect_set("data").alias("drawn")))  # at most 2 * target rows a set
    images = F.broadcast(drawn.select("case_id").distinct())
    made = [F.when(F.array_contains("drawn", d), F.struct(F.lit(d).alias("data"), *[F.col(c).cast("double").alias(f) for c, f in zip(columns[d], FEATURE_NAMES)])) for d in names]
    sampled = prepare(pixels.join(images, "case_id", "left_semi")).join(own, pixel)
    sample = sampled.select("label", F.explode(F.filter(F.array(*made), lambda s: s.isNotNull())).alias("_s")).select("label", "_s.*")
    fitted = fit_svms(sample, conditions)

    lowest = pixels.groupBy("case_id").agg(F.least(F.min("row"), F.min("col")).alias("low"))
    sizes = image_shapes(pixels).join(lowest, "case_id").withColumn("fits", (F.col("height") * F.col("width") <= IMAGE_PIXELS) & (F.col("low") >= 0))
    held = F.array_join(F.transform("held", lambda i: i.cast("string")), ",").alias("held")
    cases = small_side(roles.where(F.size("held") > 0).join(sizes, "case_id").select("case_id", held, "height", "width", "fits"), CASES)
    test = lambda rule: prepare(pixels.join(cases.where(rule).drop("fits"), "case_id"))
    rows = [metrics.with_overlap_scores(evaluate_svms(test("fits"), conditions, fitted, columns))]
    if not cases.where("not fits").isEmpty():
        large = cut_lineage(test("not fits"))
        named = [
            large.where(F.array_contains(F.split("held", ","), str(i))).select(
                F.lit(d).alias("data"), *pixel, "label", *[F.col(c).cast("double").alias(f) for c, f in zip(columns[d], FEATURE_NAMES)])
            for i, d in enumerate(names)
        ]
        scored = score_svms(reduce(DataFrame.unionByName, named), conditions, fitted, [*pixel, "label"])
        rows.append(evaluate_conditions(scored, cases.select("case_id", "height", "width")))
    return reduce(DataFrame.unionByName, [r.select("model", F.col("case_id").cast("string"), *SCORES) for r in rows])


def _grid(data: DataFrame, shapes: DataFrame, conditions: Sequence[Condition], target: int, todo: Sequence[str]) -> DataFrame:
    wanted = [c for c in conditions if c.name in todo]
    needed = [c.data for c in wanted]
    scored = scored_conditions(data.where(F.col("data").isin(needed)), wanted, target)
    return summarize(evaluate_conditions(scored, shapes)).withColumnRenamed("model", "condition")


def with_roles(feats: DataFrame, split: DataFrame) -> DataFrame:
    return feats.join(split.select("case_id", "role"), "case_id")


def feature_sweep(
    spark: SparkSession, pixels: DataFrame, split: DataFrame, config: models.RbfSvmConfig, path: str, target: int = 2_000,
    variants: Mapping[str, tuple[str, str, float]] = FEATURE_VARIANTS,
) -> DataFrame:
    """Every feature variant; variants of one preprocessing share its images and all features but the runs."""
    def run(todo: list[str]) -> DataFrame:
        parts = []
        for mode in dict.fromkeys(variants[n][0] for n in todo):
            runs = {n: variants[n][1:] for n in variants if n in todo and variants[n][0] == mode}
            columns = {n: run_columns(i) for i, n in enumerate(runs)}
            prepare = partial(prepare_variants, mode=mode, variants=list(runs.values()))
            parts.append(evaluate_sets(pixels, roles_of(split, list(runs)), prepare, columns, [Condition(n, n, config) for n in runs], target))
        return summarize(reduce(DataFrame.unionByName, parts)).withColumnRenamed("model", "condition")

    return run_grid(spark, list(variants), run, path)


def split_sweep(
    spark: SparkSession, pixels: DataFrame, config: models.RbfSvmConfig, path: str, seeds: Sequence[int] = SPLIT_SEEDS, target: int = 2_000
) -> DataFrame:
    """The same model under many patient splits; features are shared by all of them."""
    names = {f"seed_{s:02d}": s for s in seeds}

    def run(todo: list[str]) -> DataFrame:
        every = cut_lineage(splits.holdout_splits(pixels.select("case_id"), {n: names[n] for n in todo}))
        of = lambda role: F.sort_array(F.collect_list(F.when(F.col("role") == role, F.col("data"))))
        roles = every.groupBy("case_id").agg(of("train").alias("train"), of("test").alias("held"))
        rows = evaluate_sets(pixels, roles, prepare_pixels, dict.fromkeys(todo, FEATURE_NAMES), [Condition(n, n, config) for n in todo], target)
        return summarize(rows).withColumnRenamed("model", "condition")

    return run_grid(spark, list(names), run, path)


def svm_sweep(
    spark: SparkSession, pixels: DataFrame, split: DataFrame, path: str, grid: Sequence[tuple] = SVM_GRID,
    target: int = 2_000, components: int = 256, max_iter: int = 100,
) -> DataFrame:
    """Scaler, C and gamma settings over shared features."""
    conditions = [
        Condition(f"{s}_C{c}_gamma{g}", "all", models.RbfSvmConfig(c=c, gamma=g, scaler=s, components=components, max_iter=max_iter))
        for s, c, g in grid
    ]

    def run(todo: list[str]) -> DataFrame:
        wanted = [c for c in conditions if c.name in todo]
        rows = evaluate_sets(pixels, roles_of(split, ["all"]), prepare_pixels, {"all": FEATURE_NAMES}, wanted, target)
        return summarize(rows).withColumnRenamed("model", "condition")

    return run_grid(spark, [c.name for c in conditions], run, path)


def _scalers(data: Sequence[str], scalers: Sequence[str], components: int, max_iter: int) -> list[Condition]:
    return [Condition(f"{d}_{s}", d, models.RbfSvmConfig(scaler=s, components=components, max_iter=max_iter)) for d in data for s in scalers]


def leakage_sweep(
    spark: SparkSession, pixels: DataFrame, path: str, target: int = 2_000, components: int = 256, max_iter: int = 100,
    partitions: Mapping[str, tuple[float, float]] = LEAKAGE_SPLITS, scalers: Sequence[str] = ("standard", "none"),
) -> DataFrame:
    """Every pixel split under every scaler; labelled invalid by design like the single run."""
    conditions = _scalers(list(partitions), scalers, components, max_iter)

    def run(todo: list[str]) -> DataFrame:
        feats = cut_lineage(prepare_pixels(pixels))
        parts = [splits.pixel_partition(feats, ["row", "col"], *fractions).withColumn("data", F.lit(name)) for name, fractions in partitions.items()]
        data = cut_lineage(reduce(DataFrame.unionByName, parts))
        scored = cut_lineage(scored_conditions(data, [c for c in conditions if c.name in todo], target))
        image = F.concat_ws("|", "condition", "case_id")
        images = scored.withColumn("case_id", image)
        rows = metrics.overlap_metrics_dense(images, F.col("label") == 1, F.col("prediction") == 1)
        rows = rows.join(metrics.roc_auc(images, "score", "label").select("case_id", "auc"), "case_id")
        return summarize(rows.withColumn("model", F.substring_index("case_id", "|", 1))).withColumnRenamed("model", "condition")

    return run_grid(spark, [c.name for c in conditions], run, path)


def histogram_sweep(
    spark: SparkSession, pixels: DataFrame, split: DataFrame, path: str, target: int = 15_000, components: int = 256,
    max_iter: int = 100, modes: Sequence[str] = HISTOGRAM_MODES, scalers: Sequence[str] = ("standard", "none"),
) -> DataFrame:
    """Every histogram reference rule under every scaler; matched features are shared by the scalers."""
    conditions = _scalers(modes, scalers, components, max_iter)

    def run(todo: list[str]) -> DataFrame:
        parts = [histogram_matched(pixels, split, mode).withColumn("data", F.lit(mode)) for mode in modes]
        data = with_roles(reduce(DataFrame.unionByName, parts), split)
        return _grid(data, image_shapes(pixels), conditions, target, todo)

    return run_grid(spark, [c.name for c in conditions], run, path)
