import itertools

import numpy as np
import pytest
from conftest import checks
from pyspark.sql import functions as F

from voxelcohort.operators import masks, metrics
from voxelcohort.operators.components import label_components

VOX = "case_id string, z int, y int, x int"


def mask(spark, pts, case="a"):
    return spark.createDataFrame([(case, *p) for p in pts], VOX)


def cases(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "case_id string")


def contacts(spark, ref, pred):
    return metrics.contact_table(label_components(mask(spark, ref)), label_components(mask(spark, pred)))


def test_empty_masks_score_one(spark):
    row = metrics.overlap_metrics(mask(spark, []), mask(spark, []), cases(spark, "a")).first()
    assert (row["dice"], row["precision"], row["recall"]) == (1.0, 1.0, 1.0)
    c = contacts(spark, [], [])
    assert metrics.lesion_f1_overlap(c, cases(spark, "a")).first()["lesion_f1"] == 1.0
    assert metrics.lesion_f1_matched(c, cases(spark, "a")).first()["lesion_f1"] == 1.0
    assert metrics.lesion_counts(c, cases(spark, "a")).first()["lesion_count_difference"] == 0


def test_published_overlap_f1(spark):
    c = contacts(spark, [(1, 1, 1), (6, 6, 6)], [(1, 1, 1), (1, 1, 2), (4, 4, 4)])
    row = metrics.lesion_f1_overlap(c, cases(spark, "a")).first()
    assert row["lesion_f1"] == 0.5 and (row["tp"], row["fp"], row["fn"]) == (1, 1, 1)
    assert metrics.lesion_counts(c, cases(spark, "a")).first()["lesion_count_difference"] == 0


def test_volumes(spark):
    counts = spark.createDataFrame([("a", 3, 1), ("b", 1, 0)], "case_id string, n_ref long, n_pred long")
    headers = spark.createDataFrame([("a", [5.0, 5.0, 5.0]), ("b", [2.0, 2.0, 5.0])], "case_id string, spacing array<double>")
    got = {r["case_id"]: r["absolute_volume_difference_ml"] for r in metrics.volume_metrics(counts, headers).collect()}
    assert got == {"a": pytest.approx(0.25), "b": pytest.approx(0.02)}
    bad = spark.createDataFrame([("x", [1.0, 0.0, 1.0]), ("y", [1.0, 1.0]), ("z", [1.0, 1.0, 2.0])], "case_id string, spacing array<double>")
    assert checks(metrics.spacing_violations(bad)) == [("spacing", "x"), ("spacing", "y")]


def test_auc_published_ties_and_single_class(spark):
    rows = [("a", s, g) for s, g in zip((0.1, 0.4, 0.8, 0.9), (0, 0, 1, 1))] + [("one", 0.5, 1), ("tie", 0.5, 1), ("tie", 0.5, 0)]
    df = spark.createDataFrame(rows, "case_id string, s double, g int")
    got = {r["case_id"]: r["auc"] for r in metrics.roc_auc(df, "s", "g").collect()}
    assert got == {"a": 1.0, "one": None, "tie": 0.5}


def test_auc_matches_brute_force(spark):
    rng = np.random.default_rng(0)
    s, g = rng.integers(-20, 20, 300) / 7.0, rng.random(300) < 0.3
    df = spark.createDataFrame([("a", float(a), int(b)) for a, b in zip(s, g)], "case_id string, s double, g int")
    pos, neg = s[g], s[~g]
    want = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert metrics.roc_auc(df, "s", "g").first()["auc"] == pytest.approx(want)


def greedy(pairs):
    used_r, used_p, out = set(), set(), set()
    for iou, r, p in sorted(pairs, key=lambda t: (-t[0], t[1], t[2])):
        if r not in used_r and p not in used_p:
            used_r.add(r)
            used_p.add(p)
            out.add((r, p))
    return out


def test_matching_equals_sequential_greedy_on_chains(spark):
    rng = np.random.default_rng(11)
    rows = []
    for case in range(6):
        for r, p in itertools.product(range(6), range(6)):
            if rng.random() < 0.5:
                rows.append((f"c{case}", r, p, int(rng.integers(1, 5))))
    df = spark.createDataFrame(rows, "case_id string, ref_id long, pred_id long, n long")
    got = {(r["case_id"], r["ref_id"], r["pred_id"]) for r in metrics.match_components(df, 0.05).collect()}
    want = set()
    for case in {r[0] for r in rows}:
        mine = [r[1:] for r in rows if r[0] == case]
        size_r = {a: sum(n for x, _, n in mine if x == a) for a, _, _ in mine}
        size_p = {b: sum(n for _, x, n in mine if x == b) for _, b, _ in mine}
        pairs = [(n / (size_r[a] + size_p[b] - n), a, b) for a, b, n in mine]
        want |= {(case, *t) for t in greedy([t for t in pairs if t[0] >= 0.05])}
    assert got == want


def test_evaluate_cases_keeps_empty_cases_and_brain(spark):
    ref = mask(spark, [(0, 0, 0), (0, 0, 1), (3, 3, 3)])
    pred = mask(spark, [(0, 0, 0), (3, 3, 3), (5, 5, 5)])
    headers = spark.createDataFrame([("a", 0, [1.0, 1.0, 1.0]), ("empty", 1, [1.0, 1.0, 1.0])], "case_id string, fold int, spacing array<double>")
    rows = {r["case_id"]: r for r in metrics.evaluate_cases(ref, pred, headers).collect()}
    assert rows["a"]["dice"] == pytest.approx(2 * 2 / 6) and rows["a"]["lesion_f1"] == pytest.approx(2 / 2.5)
    assert rows["empty"]["dice"] == 1.0 and rows["empty"]["lesion_f1"] == 1.0 and rows["empty"]["reference_volume_ml"] == 0.0
    brain = mask(spark, [(0, 0, 0), (0, 0, 1), (3, 3, 3)])
    assert metrics.evaluate_cases(ref, pred, headers, brain).where("case_id = 'a'").first()["pred_lesions"] == 2
    assert checks(metrics.missing_predictions(headers, cases(spark, "a"))) == [("prediction_missing", "empty")]


def test_metric_summary_against_numpy(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 3, float(v)) for i, v in enumerate(rng.random(50))] + [(9, 0.5)]
    df = spark.createDataFrame(rows, "fold int, dice double")
    got = {r["scope"]: r for r in metrics.metric_summary(df, ["dice"]).collect()}
    allv = np.array([v for _, v in rows])
    assert got[-1]["std"] == pytest.approx(allv.std(ddof=1)) and got[-1]["q3"] == pytest.approx(np.quantile(allv, 0.75))
    assert got[9]["std"] == 0.0 and got[9]["n"] == 1


def test_finite_summary_edge_cases(spark):
    nan = float("nan")
    df = spark.createDataFrame([("m", 1.0, nan), ("m", nan, nan), ("k", 2.0, 3.0), ("k", 4.0, nan)], "model string, dice double, auc double")
    got = {(r["model"], r["metric"]): (r["n"], r["mean"], r["std"]) for r in metrics.finite_summary(df, ["dice", "auc"]).collect()}
    assert got[("m", "dice")] == (1, 1.0, 0.0) and got[("m", "auc")] == (0, None, None)
    assert got[("k", "dice")] == (2, 3.0, pytest.approx(2 ** 0.5))


def test_mask_decode_and_labels(spark):
    df = spark.createDataFrame([("a", 0, 0, i, float(v)) for i, v in enumerate((0, 1, -2, 0))], VOX + ", v double")
    assert [r["x"] for r in masks.foreground(df, "v").collect()] == [1]
    labels = spark.createDataFrame([("ok", 0.0), ("ok", 1.0), ("two", 2.0), ("nan", float("nan"))], "case_id string, value double")
    assert checks(masks.label_violations(labels)) == [("label_not_finite", "nan"), ("label_value", "two")]


def test_closing(spark):
    block = [(r, c) for r in range(2, 5) for c in range(2, 5) if (r, c) != (3, 3)]
    df = spark.createDataFrame([("a", r, c) for r, c in block], "case_id string, row int, col int")
    shapes = spark.createDataFrame([("a", 7, 7)], "case_id string, height int, width int")
    assert {(r["row"], r["col"]) for r in masks.close_2d(df, shapes, 0).collect()} == set(block)
    assert (3, 3) in {(r["row"], r["col"]) for r in masks.close_2d(df, shapes, 1).collect()}
    assert len(masks.disk(2)) == 13 and (2, 2) not in masks.disk(2)
    corner = spark.createDataFrame([("a", 0, 0)], "case_id string, row int, col int")
    assert masks.close_2d(corner, shapes, 1).count() == 0  # outside counts as background
    with pytest.raises(ValueError):
        masks.close_2d(df, shapes, -1)


def test_head_support(spark):
    a = np.full((13, 26, 26), -1000.0)
    a[1:12, 2:24, 2:24] = 30.0
    a[6, 12, 12] = -900.0  # an air pocket is filled as head but is no tissue
    a[0, 0, 0] = 10.0  # a separate speck loses against the head
    rows = [("a", *map(int, p), float(a[tuple(p)])) for p in np.ndindex(a.shape)]
    ncct = spark.createDataFrame(rows, VOX + ", value double").cache()
    support, head = masks.head_support(ncct)
    qc = masks.support_qc(support, head, masks.grid_shapes(ncct)).first()
    assert qc["n_support"] == 11 * 22 * 22 - 1 and qc["head_voxels"] == 11 * 22 * 22 and qc["border_voxels"] == 0
    assert checks(masks.support_violations(ncct, masks.support_qc(support, head, masks.grid_shapes(ncct)))) == []
    bad = ncct.withColumn("value", F.when((F.col("z") == 0) & (F.col("x") == 3), F.lit(float("nan"))).otherwise(F.lit(-1000.0)))
    s, h = masks.head_support(bad)
    kinds = {c for c, _ in checks(masks.support_violations(bad, masks.support_qc(s, h, masks.grid_shapes(bad))))}
    assert kinds == {"ncct_not_finite", "no_head", "support_too_small", "coverage"}
