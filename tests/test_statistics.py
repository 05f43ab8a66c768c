import hashlib

import numpy as np
import pytest
from conftest import checks
from pyspark.sql import functions as F

from voxelcohort.functions.digests import numbered_md5
from voxelcohort.operators import statistics as st

METRICS = ["dice", "absolute_volume_difference_ml", "lesion_f1", "absolute_lesion_count_difference"]
DELTAS = dict(zip(METRICS, (0.05, -1.0, 0.02, 1.0)))


def pick(rep, i, n, seed):
    return int(hashlib.md5(f"{rep}|{i}|{seed}".encode()).hexdigest()[:12], 16) % n


@pytest.fixture(scope="module")
def arms(spark):
    rows = []
    for i in range(149):
        base = (0.2 + 0.002 * i, 5.0 + i % 7, 0.3 + 0.001 * i, 2.0 + i % 3)
        rows.append((f"c{i:03d}", min(i // 30, 4), 1.0 + i * 0.5, 0.008, i % 4, *base))
    schema = "case_id string, fold int, reference_volume_ml double, voxel_volume_ml double, reference_lesion_count int, " + ", ".join(f"{m} double" for m in METRICS)
    left = spark.createDataFrame(rows, schema)
    right = left
    for m, d in DELTAS.items():
        right = right.withColumn(m, F.col(m) + d)
    return left, right


def test_bootstrap_is_deterministic_and_matches_hash_draws(spark):
    values = [0.0, 0.25, 0.5, 1.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "case_id long, v double")
    means = [np.mean([values[pick(r, i, 4, 2026)] for i in range(4)]) for r in range(500)]
    want = np.quantile(means, [0.025, 0.975])
    for parts in (1, 7):
        row = st.bootstrap_mean_ci(df.repartition(parts), ["v"], reps=500).first()
        assert np.allclose([row["ci_low"], row["ci_high"]], want) and 0 <= row["ci_low"] <= row["ci_high"] <= 1
    with pytest.raises(ValueError):
        st.bootstrap_mean_ci(df, ["v"], reps=0)


def test_draws_in_tasks_equal_draws_by_join(spark):
    """Groups of two sizes, a null group, null values, more repetitions than a block and more rows than a tile."""
    df = spark.range(2 * st.DRAW_TILE).selectExpr("id as case_id", "case when id < 7 then 'a' when id > 20 then 'b' end as g", "double(id % 101) as v", "if(id % 3 = 0, null, id * 0.5D) as u")
    found = [{(r["g"], r["rep"]): (r["v"], r["u"]) for r in st.bootstrap_means(df, ["v", "u"], reps=st.DRAW_BLOCK + 3, group=["g"], held=held).collect()} for held in (10**6, 0)]
    assert len(found[0]) == 3 * (st.DRAW_BLOCK + 3) and found[0].keys() == found[1].keys()
    for key, (v, u) in found[0].items():
        assert v == pytest.approx(found[1][key][0]) and (u is None) == (found[1][key][1] is None) and (u is None or u == pytest.approx(found[1][key][1]))


def test_numbered_md5_equals_hashlib():
    tails = [f"|{t}|7".encode() for t in (*range(98, 102), "x" * 46, "x" * 70, "\u00e9", "")]
    seen = {}
    for number, at, a, b in numbered_md5(7, 103, tails):
        seen |= {(number + r, t): (int(a[r, c]), int(b[r, c])) for r in range(len(a)) for c, t in enumerate(at)}
    words = lambda raw: tuple(int.from_bytes(raw[i:i + 4], "little") for i in (0, 4))
    assert seen == {(k, t): words(hashlib.md5(str(k).encode() + tails[t]).digest()) for k in range(7, 103) for t in range(len(tails))}


def test_summary_draws_n_rows_and_hashes_each_sign(spark):
    d = [0.3, -0.1, 0.4, 0.2, 0.05]
    pairs = spark.createDataFrame([(i, 0, 1.0, 0.0, v, v) for i, v in enumerate(d)], "case_id long, fold int, reference_volume_ml double, a_v double, b_v double, delta_v double")
    row = st.paired_summary(pairs, ["v"], 300, 400).first()
    means = [np.mean([d[pick(r, i, 5, 2026)] for i in range(5)]) for r in range(300)]
    assert np.allclose([row["ci_low"], row["ci_high"]], np.quantile(means, [0.025, 0.975]))
    sign = lambda r, i: 1 if hashlib.md5(f"{r}|{i}|2126".encode()).hexdigest()[0] < "8" else -1
    tail = sum(abs(np.mean([sign(r, i) * v for i, v in enumerate(d)])) >= abs(np.mean(d)) - 1e-12 for r in range(400))
    assert row["p"] == pytest.approx((tail + 1) / 401)


def test_sign_flip_matches_enumeration(spark):
    d = [0.3, -0.1, 0.4, 0.2, 0.05]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(d)], "case_id long, v double")
    bits = lambda k, i: bin(int(hashlib.md5(f"{k}|{i}|2026".encode()).hexdigest(), 16) | 1 << 128)[3:]
    sign = lambda r, i: 1 if bits(r // 128, i)[r % 128] == "0" else -1
    tail = sum(abs(np.mean([sign(r, i) * v for i, v in enumerate(d)])) >= abs(np.mean(d)) - 1e-12 for r in range(600))
    assert st.sign_flip_p(df, ["v"], reps=600).first()["p"] == pytest.approx((tail + 1) / 601)


def poisson_weight(rep, key, seed):
    u = int(hashlib.md5(f"{rep // 8}|{key}|{seed}".encode()).hexdigest()[4 * (rep % 8):][:4], 16)
    return sum(u >= bound for bound in st.POISSON_BOUNDS)


@pytest.mark.parametrize("parts", [1, 7])
def test_poisson_means_equal_keyed_weights(spark, parts):
    """Groups, a null key, a null group and more repetitions than one block holds."""
    rows = [(k, None if k % 5 == 0 else k % 2, 0.1 * k, float(k * k % 7)) for k in range(40)] + [(None, 1, 99.0, 99.0)]
    df = spark.createDataFrame(rows, "case_id long, side int, a double, b double").repartition(parts)
    reps = 8 * st.HASH_BLOCK + 13
    got = {(r["side"], r["metric"]): (r["ci_low"], r["ci_high"]) for r in st.poisson_mean_ci(df, ["a", "b"], reps=reps, seed=7, group=["side"]).collect()}
    for side in (None, 0, 1):
        own = [r for r in rows if r[1] == side and r[0] is not None]
        w = np.array([[poisson_weight(rep, r[0], 7) for r in own] for rep in range(reps)], dtype=float)
        w = w[w.sum(axis=1) > 0]
        for c, metric in ((2, "a"), (3, "b")):
            means = w @ np.array([r[c] for r in own]) / w.sum(axis=1)
            assert got[side, metric] == pytest.approx(tuple(np.quantile(means, [0.025, 0.975])))
    assert len(got) == 6


def test_poisson_weights_have_mean_and_variance_one():
    w = st._poisson(np.frombuffer(b"".join(hashlib.md5(str(k).encode()).digest() for k in range(20_000)), dtype=np.uint8).reshape(-1, 16))
    assert w.shape == (20_000, 8) and abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02
    assert abs(np.corrcoef(w.T) - np.eye(8)).max() < 0.03


def test_resampling_shuffles_sums_not_draws(spark):
    df = spark.range(2000).selectExpr("id as case_id", "double(id) as v")
    plan = st.resampled_sums(df, ["v"], "case_id", 1024, 1, st._poisson, 8)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInPandas") == 1 and "Join" not in plan and plan.count("Exchange") == 2
    assert st.resampled_sums(df, ["v"], "case_id", 1024, 1, st._poisson, 8).count() == 1024
    assert st.poisson_mean_ci(df.limit(0), ["v"], reps=10).count() == 0


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.5)], "metric string, p double")
    got = {r["metric"]: r["holm_p"] for r in st.holm_adjust(df).collect()}
    assert got == {"a": pytest.approx(0.04), "c": pytest.approx(0.09), "b": pytest.approx(0.09), "d": pytest.approx(0.5)}


def test_paired_comparison_of_149_cases(spark, arms):
    sizes = {0: 30, 1: 30, 2: 30, 3: 30, 4: 29}
    pairs, found = st.pair_arms(*arms, METRICS, sizes)
    assert checks(found) == []
    rows = {r["metric"]: r for r in st.paired_summary(pairs, METRICS, 300, 300).collect()}
    assert len(rows) == 4
    for m, d in DELTAS.items():
        assert rows[m]["delta_mean"] == pytest.approx(d) and rows[m]["delta_median"] == pytest.approx(d)
        assert 0 <= rows[m]["holm_p"] <= 1 and rows[m]["ci_low"] == pytest.approx(d)
    quart = st.volume_quartiles(pairs, METRICS).where("metric = 'dice'").collect()
    assert sum(r["n"] for r in quart) == 149 and sorted(r["quartile"] for r in quart) == [1, 2, 3, 4]
    wins = {r["metric"]: (r["improved"], r["worsened"], r["unchanged"]) for r in st.win_loss(
        pairs, dict(zip(METRICS, ("higher", "lower", "higher", "lower")))).collect()}
    assert wins["dice"] == (149, 0, 0) and wins["absolute_lesion_count_difference"] == (0, 149, 0)
    lofo = st.leave_one_fold_out(pairs, METRICS).where("metric = 'dice' and fold = 4").first()
    assert lofo["n"] == 120 and lofo["delta_mean"] == pytest.approx(0.05)
    assert st.fold_means(pairs, METRICS).count() == 20


def test_constant_deltas_have_no_effect_size(spark):
    a = spark.createDataFrame([(i, 0, 1.0, 1.0, 1, 0.25) for i in range(4)], "case_id int, fold int, reference_volume_ml double, voxel_volume_ml double, reference_lesion_count int, dice double")
    pairs, _ = st.pair_arms(a, a.withColumn("dice", F.lit(0.5)), ["dice"])
    row = st.paired_summary(pairs, ["dice"], 20, 20).first()
    assert row["cohens_dz"] is None and row["delta_mean"] == 0.25


@pytest.mark.parametrize("change,kind", [
    ("case when case_id = 'c007' then fold + 1 else fold end as fold", "fold"),
    ("if(case_id = 'c007', reference_volume_ml + 0.1, reference_volume_ml) as reference_volume_ml", "reference_volume_ml"),
    ("if(case_id = 'c007', voxel_volume_ml * 2, voxel_volume_ml) as voxel_volume_ml", "voxel_volume_ml"),
    ("if(case_id = 'c007', 99, reference_lesion_count) as reference_lesion_count", "reference_lesion_count"),
    ("if(case_id = 'c007', double('Infinity'), dice) as dice", "not_finite"),
    ("if(case_id = 'c007', 1.5D, dice) as dice", "score_range"),
    ("if(case_id = 'c007', -1D, absolute_volume_difference_ml) as absolute_volume_difference_ml", "negative_error"),
])
def test_pairing_tampering(arms, change, kind):
    left, right = arms
    target = change.split(" as ")[-1]
    bad = right.selectExpr(*[change if c == target else c for c in right.columns])
    assert checks(st.pair_arms(left, bad, METRICS)[1]) == [(kind, "c007")]


def test_pairing_missing_sides_and_sizes(arms):
    left, right = arms
    _, found = st.pair_arms(left.where("case_id <> 'c000'"), right.where("case_id <> 'c001'"), METRICS, {f: 30 for f in range(5)})
    assert checks(found) == [("fold_size", "0"), ("fold_size", "4"), ("missing_in_left", "c000"), ("missing_in_right", "c001")]


def test_report_lines(spark):
    df = spark.createDataFrame([("dice", 0.17383, 0.22083, 0.047, 0.01, -0.002, 0.03, 0.1225)], "metric string, a_mean double, b_mean double, delta_mean double, ci_high double, ci_low double, p double, holm_p double")
    assert st.report_lines(df, {"dice": "Dice"}).first()["line"] == "| Dice | 0.17383 | 0.22083 | +0.04700 | [-0.00200, +0.01000] | 0.03000 | 0.12250 |"


def test_repetitions_are_spread_over_tasks(spark):
    rows = spark.range(50).select(F.col("id").alias("case_id"))
    spread = st._spread_repetitions(rows, 10_000, "case_id").groupBy(F.spark_partition_id().alias("p")).count().collect()
    assert len(spread) >= 6 and sum(r["count"] for r in spread) == 50 * 10_000
