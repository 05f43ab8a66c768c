from pathlib import Path

import numpy as np
import pytest

from pyspark.sql import functions as F

from voxelcohort.operators import models
from voxelcohort.operators.batch_models import Condition, closed, fit_svms, fourier_features, rank_auc, scaling, score_svms
from voxelcohort.operators.features import FEATURE_NAMES, RUN_MODES, nine_features, run_columns, variant_features
from voxelcohort.plans import classifier
from voxelcohort.session import scratch_path, shared_dir


@pytest.fixture(scope="module")
def rings(spark):
    """Two classes a linear model cannot separate: radius inside or outside one."""
    rng = np.random.default_rng(0)
    p = rng.normal(size=(600, 2)) * 1.2
    rows = [(float(a), float(b), 7.0, int(a * a + b * b > 1.4)) for a, b in p]
    return rows, spark.createDataFrame(rows, "f1 double, f2 double, constant double, label int").cache()


def accuracy(model, df):
    return model.score(df).selectExpr("avg(double(prediction = label)) as a").first()["a"]


def test_scaler_uses_population_deviation_and_keeps_constants(spark, rings):
    rows, df = rings
    got = models.fit_scaler(df, ["f1", "constant"], "standard")
    values = np.array([r[0] for r in rows])
    assert got["f1"] == (pytest.approx(values.mean()), pytest.approx(values.std())) and got["constant"] == (7.0, 1.0)
    assert models.fit_scaler(df, ["f1"], "minmax")["f1"] == (pytest.approx(values.min()), pytest.approx(values.max() - values.min()))
    assert models.fit_scaler(df, ["f1"], "none")["f1"] == (0.0, 1.0)
    with pytest.raises(ValueError):
        models.fit_scaler(df, ["f1"], "robust")


def test_fourier_svm_separates_rings(rings):
    _, df = rings
    model = models.rbf_svm_classifier(df, models.RbfSvmConfig(components=200, max_iter=60), ["f1", "f2"])
    assert accuracy(model, df) > 0.93
    row = model.score(df).selectExpr("min(if(score > 0, prediction, 1)) as p", "max(if(score <= 0, prediction, 0)) as n").first()
    assert row["p"] == 1 and row["n"] == 0


def test_gamma_scale(rings):
    rows, df = rings
    x = np.array([[r[0], r[1]] for r in rows])
    scaler = {"f1": (0.0, 1.0), "f2": (0.0, 1.0)}
    assert models.resolve_gamma(df, models.scaled_array(scaler), 2, "scale") == pytest.approx(1 / (2 * x.var()))
    assert models.resolve_gamma(df, models.scaled_array(scaler), 2, 0.1) == 0.1


def test_mlp_learns(rings):
    _, df = rings
    model = models.mlp_classifier(df, models.MlpConfig(hidden=(20,), max_iter=200), ["f1", "f2"])
    assert accuracy(model, df) > 0.93
    assert models.MlpConfig().hidden == (100, 100, 100) and models.MlpConfig().max_iter == 500


@pytest.fixture(scope="module")
def lesions(spark):
    rng = np.random.default_rng(1)
    rows = []
    for case in range(5):
        lesion = (int(rng.integers(2, 7)), int(rng.integers(2, 7)))
        for r in range(10):
            for c in range(10):
                hit = abs(r - lesion[0]) <= 1 and abs(c - lesion[1]) <= 1
                rows.append((f"c{case}", r, c, 60.0 + float(rng.random()) if hit else 10.0 + float(rng.random()), int(hit)))
    pixels = spark.createDataFrame(rows, "case_id string, row int, col int, value double, label int")
    return pixels, spark.createDataFrame([(f"c{i}", "train" if i < 3 else "test") for i in range(5)], "case_id string, role string")


def test_train_eval_scores_held_out_cases_only(lesions):
    pixels, split = lesions
    fit = lambda s: models.rbf_svm_classifier(s, models.RbfSvmConfig(components=64, max_iter=40))
    out = classifier.train_eval(pixels, split, {"svm": fit}, target=100).collect()
    assert {r["case_id"] for r in out} == {"c3", "c4"} and all(r["dice"] > 0.5 and r["auc"] > 0.9 for r in out)


def test_diagnostic_sweeps(spark, lesions):
    pixels, split = lesions
    leak = classifier.leakage_sweep(spark, pixels, scratch_path(spark, "leak"), 50, 32, 10, {"pixel_70_30": (0.7, 0.0)}, ["none"]).collect()
    assert [r["condition"] for r in leak] == ["pixel_70_30_none"] and leak[0]["cases"] == 5
    hist = classifier.histogram_sweep(spark, pixels, split, scratch_path(spark, "hist"), 50, 32, 10, ["first"], ["none"]).collect()
    assert [r["condition"] for r in hist] == ["first_none"] and hist[0]["cases"] == 2


def test_batched_svms_reach_the_hinge_loss_of_single_fits(spark, rings):
    rows, df = rings
    grid = [Condition(f"{s}_{g}", d, models.RbfSvmConfig(components=60, max_iter=200, scaler=s, gamma=g)) for s in ("standard", "minmax", "none") for g in ("scale", 0.5) for d in ("all",)]
    grid.append(Condition("half", "half", models.RbfSvmConfig(components=60, max_iter=200)))
    data = df.withColumn("data", F.lit("all")).unionByName(df.where("f1 < 0.3").withColumn("data", F.lit("half")))
    fitted = fit_svms(data.repartition(5), grid, ["f1", "f2"])
    assert sorted(m["condition"] for m in fitted) == sorted(c.name for c in grid)
    scored = score_svms(data, grid, fitted, ["f1", "f2", "label"], ["f1", "f2"])
    counts = {r["condition"]: (r["n"], r["a"]) for r in scored.groupBy("condition").agg(F.count("*").alias("n"), F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("a")).collect()}
    assert counts["half"][0] == df.where("f1 < 0.3").count() and counts["none_0.5"] == (600, pytest.approx(counts["none_0.5"][1]))
    assert counts["standard_scale"][1] > 0.93 and counts["none_0.5"][1] > 0.93
    # the linear SVM of the library minimises the same loss on the same lifted inputs
    x = np.array([r[:2] for r in rows])
    shift, scale = scaling(x, "standard")
    model = next(m for m in fitted if m["condition"] == "standard_scale")
    assert np.allclose(model["shift"], shift) and np.allclose(model["scale"], scale)
    table = fourier_features((x - shift) / scale, model["gamma"], 60, grid[0].config.seed)
    sign = np.where([r[3] for r in rows], 1.0, -1.0)
    loss = lambda w, b: np.maximum(1 - sign * (table @ w + b), 0).mean() + w @ w / (2 * len(sign))
    single = models.rbf_svm_classifier(df, grid[0].config, ["f1", "f2"]).model
    w = np.array(model["weights"])
    assert loss(w[:-1], w[-1]) <= 1.03 * loss(np.array(single.coefficients), single.intercept) + 0.005


def test_batched_fit_does_not_depend_on_partitions(rings):
    _, df = rings
    grid = [Condition("a", "all", models.RbfSvmConfig(components=20, max_iter=50))]
    one, two = (fit_svms(df.withColumn("data", F.lit("all")).repartition(n), grid, ["f1", "f2"])[0] for n in (1, 7))
    assert one["weights"] == two["weights"]
    with pytest.raises(ValueError):
        fit_svms(df, [*grid, *grid], ["f1", "f2"])


def test_sweep_runs_only_what_is_missing(spark, lesions):
    pixels, split = lesions
    path, small = scratch_path(spark, "svm"), dict(target=50, components=32, max_iter=20)
    first = classifier.svm_sweep(spark, pixels, split, path, [("none", 1.0, "scale")], **small).collect()
    both = classifier.svm_sweep(spark, pixels, split, path, [("none", 1.0, "scale"), ("standard", 1.0, 0.1)], **small).collect()
    assert len(first) == 1 and {r["condition"] for r in both} == {"none_C1.0_gammascale", "standard_C1.0_gamma0.1"}
    assert first[0] in both and all(r["cases"] == 2 for r in both)
    assert [r["dice_mean"] for r in both] == sorted((r["dice_mean"] for r in both), reverse=True)


def test_conditions_are_evaluated_like_single_runs(spark, lesions):
    pixels, split = lesions
    data = classifier.with_roles(classifier.prepare_pixels(pixels), split).withColumn("data", F.lit("all"))
    grid = [Condition(s, "all", models.RbfSvmConfig(scaler=s, components=32, max_iter=30)) for s in ("standard", "none")]
    scored = classifier.scored_conditions(data, grid, 100)
    shapes = classifier.image_shapes(pixels)
    together = {(r["model"], r["case_id"]): (r["dice"], r["auc"]) for r in classifier.evaluate_conditions(scored, shapes, (0, 2)).collect()}
    for s in ("standard", "none"):
        for radius in (0, 2):
            alone = classifier.evaluate_scored(scored.where(F.col("condition") == s), shapes, radius, s).collect()
            assert {(f"{s}_close_{radius}", r["case_id"]): (r["dice"], r["auc"]) for r in alone}.items() <= together.items()
    assert len(together) == 8


def test_held_out_scores_without_stored_features(lesions):
    """Drawing the sample from keys first fits and scores the same as features of every image."""
    pixels, split = lesions
    conditions = [Condition("a", "all", models.RbfSvmConfig(components=16, max_iter=5))]
    data = classifier.with_roles(classifier.prepare_pixels(pixels), split).withColumn("data", F.lit("all"))
    seen = []
    prepare = {"all": lambda images: seen.append(images.select("case_id").distinct().count()) or classifier.prepare_pixels(images)}
    held = classifier.score_held_out(pixels, split, prepare, conditions, 1)
    assert sorted(map(tuple, held.collect())) == sorted(map(tuple, classifier.scored_conditions(data, conditions, 1).collect()))
    assert seen[0] <= split.where("role = 'test'").count() + 2


def stored(spark, run):
    """Bytes that ``run`` leaves in the shared folder."""
    size = lambda: sum(p.stat().st_size for p in Path(shared_dir(spark)).rglob("part-*"))
    before = size()
    run()
    return size() - before


@pytest.fixture(scope="module")
def dealt_lesions(lesions):
    pixels, split = lesions
    again = lambda df: df.unionByName(df.withColumn("case_id", F.concat("case_id", F.lit("x"))))
    return again(pixels), again(split)


def test_svm_sweep_stores_no_score_a_condition(spark, dealt_lesions):
    pixels, split = dealt_lesions
    grid = [("none", c, 0.1) for c in (0.1, 0.3, 1.0, 3.0, 5.0, 7.0, 10.0, 20.0)]
    run = lambda g: classifier.svm_sweep(spark, pixels, split, scratch_path(spark, "kept"), g, 5, 8, 3).collect()
    one, eight = stored(spark, lambda: run(grid[:1])), stored(spark, lambda: run(grid))
    assert eight - one < 8 * 4_000  # a row of summary a condition, no row a pixel


@pytest.mark.parametrize("limit", [1 << 20, 0])
def test_sets_are_evaluated_like_scored_rows(monkeypatch, dealt_lesions, limit):
    """In one task an image or, where it is too large, by distributed steps: as rows scored, closed and ranked by themselves."""
    monkeypatch.setattr(classifier, "IMAGE_PIXELS", limit)
    pixels, split = dealt_lesions
    grid = [Condition(s, "all", models.RbfSvmConfig(scaler=s, components=32, max_iter=30)) for s in ("standard", "none")]
    data = classifier.with_roles(classifier.prepare_pixels(pixels), split).withColumn("data", F.lit("all"))
    want = classifier.evaluate_conditions(classifier.scored_conditions(data, grid, 20), classifier.image_shapes(pixels))
    got = classifier.evaluate_sets(pixels, classifier.roles_of(split, ["all"]), classifier.prepare_pixels, {"all": FEATURE_NAMES}, grid, 20)
    rows = lambda df: sorted(tuple(r) for r in df.select("model", "case_id", *classifier.SCORES).collect())
    got, want = rows(got), rows(want)
    assert len(got) == 8 and [r[:2] for r in got] == [r[:2] for r in want]
    assert np.allclose(np.array([r[2:] for r in got], float), np.array([r[2:] for r in want], float), equal_nan=True)


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_dense_closing_equals_the_distributed_one(spark, radius):
    rng = np.random.default_rng(radius)
    mask = rng.random((3, 9, 7)) < 0.35
    rows = [(str(i), int(r), int(c)) for i, r, c in zip(*np.nonzero(mask))]
    shapes = spark.createDataFrame([(str(i), 9, 7) for i in range(3)], "case_id string, height int, width int")
    want = classifier.masks.close_2d(spark.createDataFrame(rows, "case_id string, row int, col int"), shapes, radius).collect()
    assert sorted(map(tuple, want)) == [(str(i), int(r), int(c)) for i, r, c in zip(*np.nonzero(closed(mask, radius)))]


def test_rank_auc_counts_ties_half_and_needs_both_classes():
    score, positive = np.array([1.0, 2.0, 2.0, 3.0, np.nan]), np.array([False, True, False, True, True])
    assert rank_auc(score, positive, ~positive) == pytest.approx(3.5 / 4) and rank_auc(score, positive, positive & False) is None


def test_split_sweep_stores_no_score_a_seed(spark, dealt_lesions):
    pixels, _ = dealt_lesions
    run = lambda n: classifier.split_sweep(spark, pixels, models.RbfSvmConfig(components=8, max_iter=3), scratch_path(spark, "seeds"), range(n), 1).collect()
    one, eight = stored(spark, lambda: run(1)), stored(spark, lambda: run(8))
    assert eight - one < 7 * 6_000  # summary, roles, keys and two sampled pixels a seed, no row a held-out pixel


def test_feature_variants_share_their_preprocessing(spark, monkeypatch, dealt_lesions):
    pixels, split = dealt_lesions
    seen, real = [], classifier.preprocess.preprocess
    monkeypatch.setattr(classifier.preprocess, "preprocess", lambda *a, **k: seen.append(a[1]) or real(*a, **k))
    variants = {f"v{t}_{m}": ("paper_minimal", m, t) for t in (20.0, 60.5) for m in RUN_MODES}
    got = classifier.feature_sweep(spark, pixels, split, models.RbfSvmConfig(components=8, max_iter=3), scratch_path(spark, "variants"), 5, variants).collect()
    assert len(got) == 6 and len(seen) <= 2  # the sampled and the held-out images
    wide = {(r["case_id"], r["row"], r["col"]): r for r in variant_features(pixels.where("case_id = 'c0'"), [v[1:] for v in variants.values()]).collect()}
    for name in ("v20.0_max_run", "v60.5_centered_run"):
        for r in nine_features(pixels.where("case_id = 'c0'"), threshold=variants[name][2], mode=variants[name][1]).collect():
            assert [r[f] for f in FEATURE_NAMES] == [wide[r["case_id"], r["row"], r["col"]][c] for c in run_columns(list(variants).index(name))]
