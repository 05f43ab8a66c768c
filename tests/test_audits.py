import gzip
import hashlib
import math
import random

import pytest
from conftest import checks
from pyspark.sql import functions as F

from voxelcohort.functions.running import RunningDigest, resumable
from voxelcohort.operators import audits, geometry, incremental

NAN, INF = float("nan"), float("inf")
SCHEMA = "case_id string, channel string, z int, y int, x int, value double"


def volume(spark, values, case="a", channel="MTT"):
    return spark.createDataFrame([(case, channel, 0, 0, i, float(v)) for i, v in enumerate(values)], SCHEMA)


def test_published_intensity_audit(spark):
    row = audits.intensity_audit(volume(spark, [0, 0, 1, 2, -29691790, 15, NAN, INF])).first()
    assert (row["n_voxels"], row["n_nonfinite"], row["n_below_minus_10000"], row["n_negative"]) == (8, 2, 1, 1)
    assert (row["min"], row["max"]) == (-29691790, 15) and row["percent_negative"] == pytest.approx(16.666667)


def test_all_nonfinite_and_extent(spark):
    rows = volume(spark, [NAN, INF]).unionByName(volume(spark, [1.0], channel="CBF")).unionByName(volume(spark, [1.0, 2.0], "b"))
    assert checks(audits.intensity_violations(audits.intensity_audit(rows))) == [("channel_extent", "a"), ("no_finite_voxel", "a/MTT")]


def test_published_tensor_audit(spark):
    values = list(range(60))
    values[3], values[4], values[5], values[6], values[7] = NAN, -INF, INF, -1000.5, 1001.2
    row = audits.tensor_audit(volume(spark, values), (1, 1, 60)).first()
    assert (row["n_voxels"], row["n_nonfinite"], row["n_abs_gt_1000"]) == (60, 3, 2)
    assert (row["n_nan"], row["n_posinf"], row["n_neginf"]) == (1, 1, 1)
    flat = audits.tensor_audit(volume(spark, [1.0] * 9)).first()
    assert flat["near_constant"] and flat["mean"] == 1 and flat["std"] == 0
    none = audits.tensor_audit(volume(spark, [NAN])).first()
    assert none["all_nonfinite"] and not none["near_constant"] and none["median"] is None


def test_published_support_anomalies(spark):
    rows = volume(spark, [-50000, 20000, INF, NAN, 4, -10001, -2, 40000])
    row = audits.support_anomalies(rows, F.col("x").isin(0, 2, 3, 6)).first()
    assert (row["nonfinite"], row["nonfinite_inside"], row["nonfinite_outside"]) == (2, 2, 0)
    assert (row["below"], row["below_inside"], row["above"], row["above_inside"]) == (2, 1, 2, 0)


def test_published_arm_comparison(spark):
    single = volume(spark, [0.0] * 8).drop("channel")
    multi = volume(spark, [0.0] * 8, channel="NCCT").unionByName(volume(spark, [0.0] * 8))
    run = lambda a, b: audits.compare_arms(a, b, "NCCT")
    ok = run(single, multi).first()
    assert ok["max_difference"] == 0 and not ok["needs_review"] and checks(audits.arm_violations(run(single, multi))) == []
    high = multi.withColumn("value", F.when((F.col("channel") == "MTT") & (F.col("x") == 3), 8.5).otherwise(F.col("value")))
    assert run(single, high).first()["over_cap"] == 1 and run(single, high).first()["needs_review"]
    off = single.withColumn("value", F.when(F.col("x") == 1, 0.01).otherwise(F.col("value")))
    assert checks(audits.arm_violations(run(off, multi))) == [("shared_channel_differs", "a")]
    bad = high.withColumn("value", F.when(F.col("value") > 8, F.lit(INF)).otherwise(F.col("value")))
    assert checks(audits.arm_violations(run(single, bad))) == [("not_finite", "a")]
    assert checks(audits.arm_violations(run(single.where("x > 0"), multi))) == [("extent", "a")]


def test_review_gate(spark):
    columns = ", ".join(f"{c} string" for c in audits.REVIEW_COLUMNS)
    name = lambda i: f"sub_stroke{i:04d}"
    row = lambda i, **kw: tuple({**{"case_id": name(i), "overlay_filename": f"{name(i)}.png", "decision": "approved", "brain_tissue_preserved": "yes", "extracranial_tissue_included": "acceptable", "correction_required": "no", "reviewer": "r", "review_date": "2024-02-29", "notes": ""}, **kw}[c] for c in audits.REVIEW_COLUMNS)
    roster = spark.createDataFrame([(name(i), f"{name(i)}.png") for i in range(9)], "case_id string, overlay_filename string")
    good = [row(i) for i in range(9)]
    today = F.to_date(F.lit("2025-01-01"))
    run = lambda rows: checks(audits.review_violations(spark.createDataFrame(rows, columns), roster, today))
    assert run(good) == []
    bad = [row(0, decision="PENDING"), row(1, brain_tissue_preserved="no"), row(2, reviewer=" "), row(3, review_date="2025-06-01"),
           row(4, review_date="2023-02-29"), row(5, overlay_filename="x.png"), row(6), row(6), row(8), row(77)]
    assert run(bad) == [("approval_fields", name(1)), ("decision", name(0)), ("overlay_filename", name(5)), ("review_date_future", name(3)),
                        ("review_date_invalid", name(4)), ("review_missing", name(7)), ("review_repeated", name(6)), ("review_unexpected", name(77)), ("sign_off_missing", name(2))]
    with pytest.raises(ValueError):
        audits.review_violations(roster, roster)


def test_review_of_cases_that_share_a_written_id(spark):
    """Ids cut to four digits name several cases; each is judged by itself."""
    columns = "k long, " + ", ".join(f"{c} string" for c in audits.REVIEW_COLUMNS)
    row = lambda k, decision: (k, "sub_stroke1000", "a.png", decision, "yes", "no", "no", "r", "2024-05-06", "")
    roster = spark.createDataFrame([(k, "sub_stroke1000", "a.png") for k in (1000, 10000, 10001, 10002)], "k long, case_id string, overlay_filename string")
    review = spark.createDataFrame([row(1000, "approved"), row(10000, "no"), row(10001, "no")], columns)
    found = audits.review_violations(review, roster, F.to_date(F.lit("2025-01-01")), key="k")
    assert checks(found) == [("decision", "sub_stroke1000"), ("decision", "sub_stroke1000"), ("review_missing", "sub_stroke1000")]


def test_selection_and_redaction(spark):
    qc = spark.range(40).selectExpr("id as case_id", "id / 100 as coverage")
    got = [r["case_id"] for r in audits.select_for_review(qc, [20, 0], 6, 16).collect()]
    assert got[:2] == [20, 0] and set(got) == {20, 0, 1, 2, 3, 4, 5, 34, 35, 36, 37, 38, 39} and len(got) == 13
    with pytest.raises(ValueError):
        audits.select_for_review(qc, list(range(20)), 6, 16)
    with pytest.raises(ValueError):
        audits.redact(qc, ["case_id"], ["case_id"])


def test_release_gate(spark):
    empty = spark.createDataFrame([], "check string, key string, detail string")
    one = spark.createDataFrame([("a", "k", "")], "check string, key string, detail string")
    assert [tuple(r) for r in audits.release_gate([empty]).collect()] == [("total", 0, True)]
    assert ("total", 1, False) in [tuple(r) for r in audits.release_gate([empty, one]).collect()]


def test_roster_keeps_edits(spark):
    old = spark.createDataFrame([("a", "APPROVED"), ("x", "APPROVED")], "case_id string, decision string")
    rows, found = audits.refresh_roster(spark.createDataFrame([("a",), ("b",)], "case_id string"), old, {"decision": "PENDING"})
    assert sorted(map(tuple, rows.collect())) == [("a", "APPROVED"), ("b", "PENDING")]
    assert checks(found) == [("roster_added", "b"), ("roster_dropped", "x")]


def test_signature_changes_with_any_input_but_not_order(spark):
    schema = "case_id string, name string, size long, mtime string"
    rows = [("a", f"f{i}", i, "t") for i in range(50)]
    sig = lambda r: incremental.input_signature(spark.createDataFrame(r, schema)).first()["signature"]
    base = sig(rows)
    assert sig(rows[::-1]) == base
    for changed in (rows[:-1], rows[:-1] + [("a", "f49", 49, "u")], rows[:-1] + [("a", "f49", 50, "t")], rows + rows[:1]):
        assert sig(changed) != base


@pytest.mark.parametrize("algorithm", ["sha256", "md5"])
def test_half_done_digest_goes_on_elsewhere(algorithm):
    assert resumable(algorithm)
    data = random.Random(3).randbytes(1_000)
    for cut in (0, 1, 55, 56, 63, 64, 65, 500, 1_000):
        first = RunningDigest(algorithm)
        first.update(data[:cut])
        second = RunningDigest(algorithm, first.state())
        second.update(data[cut:])
        assert first.hexdigest() == hashlib.new(algorithm, data[:cut]).hexdigest()
        assert second.hexdigest() == hashlib.new(algorithm, data).hexdigest()


@pytest.mark.parametrize("algorithm, handed_on", [("sha256", True), ("sha256", False), ("md5", True)])
def test_files_longer_than_a_row(spark, tmp_path, monkeypatch, algorithm, handed_on):
    some, mark = random.Random(5).randbytes, b"\xef\xbb\xbf"
    files = {
        "random.bin": some(150_000), "ended.bin": some(50_000) + b"\n", "breaks.bin": b"\r\n\n\r" * 12_000, "feeds.bin": b"\n" * 41_000, "zeros.bin": bytes(90_000),
        "marked.bin": mark + some(60_000), "twice.bin": mark + mark + b"x\n" * 25_000, "with space%20.bin": some(45_000),
        "packed.gz": gzip.compress(some(20_000)), "edge.bin": some(10_000), "over.bin": some(10_001), "short.bin": b"abc",
    }
    for name, content in files.items():
        (tmp_path / name).write_bytes(content)
    if not handed_on:
        monkeypatch.setattr(incremental, "resumable", lambda algorithm: False)
    small = {"spark.sql.files.maxPartitionBytes": "7001", "spark.sql.sources.binaryFile.maxLength": "40000"}
    try:
        for key, value in small.items():
            spark.conf.set(key, value)
        got = incremental.file_digests(spark, str(tmp_path), algorithm=algorithm, whole=10_000, span=25_000).collect()
    finally:
        for key in small:
            spark.conf.unset(key)
    assert {r["path"].rsplit("/", 1)[1]: (r["bytes"], r["digest"]) for r in got} == {
        name: (len(content), hashlib.new(algorithm, content).hexdigest()) for name, content in files.items()}
    assert len(got) == len(files)


def test_stale_and_progress(spark):
    current = spark.createDataFrame([(c, "s") for c in "abcd"], "case_id string, signature string")
    saved = spark.createDataFrame([("a", "s", "v1", "complete"), ("b", "s", "v0", "complete"), ("c", "old", "v1", "complete"), ("d", "s", "v1", "running")], "case_id string, signature string, schema string, status string")
    assert sorted(r["case_id"] for r in incremental.stale_cases(current, saved, "v1").collect()) == ["b", "c", "d"]
    status = spark.createDataFrame([("a", "complete", 1), ("b", "complete", 5), ("c", "failed", 9)], "case_id string, status string, updated int")
    row = incremental.progress(status).first()
    assert (row["completed"], row["failed"], row["percent"], row["last_case"]) == (2, 1, 66.67, "b")


HEADER = "case_id string, channel string, shape array<int>, spacing array<double>, origin array<double>, direction array<double>, affine array<double>"


def header(case, channel, shape=(16, 16, 16), skew=0.0, spacing=(1.0, 1.0, 2.0), affine=None):
    direction = [1.0, skew, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    return (case, channel, list(shape), list(spacing), [0.0, 0.0, 0.0], direction, [float(v) for v in affine or (2, 0, 0, 1, 0, 3, 0, 2, 0, 0, 4, 3, 0, 0, 0, 1)])


def test_geometry_tolerance(spark):
    df = spark.createDataFrame([header("a", "r"), header("a", "ok", skew=1.58e-5), header("a", "bad", skew=1e-3), header("a", "size", (16, 16, 17))], HEADER)
    got = {r["channel"]: (r["same_size"], r["matches"]) for r in geometry.geometry_matches(df, "r", geometry.COHORT_2024_ATOL).collect()}
    assert got == {"r": (True, True), "ok": (True, True), "bad": (True, False), "size": (False, False)}
    assert geometry.stage_gate(df, ["r", "ok", "bad", "gone"], "r", 2e-5).first()["problems"] == "bad,gone:missing"


def test_header_rules(spark):
    flat = [0.0] * 16
    df = spark.createDataFrame([header("ok", "c"), header("small", "c", (7, 16, 16)), header("four", "c", (16, 16, 16, 2)), header("zero", "c", spacing=(0.0, 1.0, 1.0)),
                                header("nan", "c", spacing=(NAN, 1.0, 1.0)), header("flat", "c", affine=flat), header("inf", "c", affine=[INF] + flat[1:])], HEADER)
    assert checks(geometry.header_violations(df)) == [("affine_not_finite", "inf/c"), ("affine_singular", "flat/c"), ("dimension_too_small", "four/c"), ("dimension_too_small", "small/c"),
                                                     ("not_3d", "four/c"), ("spacing_not_finite", "nan/c"), ("spacing_not_positive", "zero/c")]


def test_shift_affine(spark):
    df = spark.createDataFrame([header("a", "c")], HEADER)
    moved = geometry.shift_affine(df, F.array(F.lit(1), F.lit(2), F.lit(3))).first()["affine"]
    assert [moved[3], moved[7], moved[11]] == [1 + 2 * 1, 2 + 3 * 2, 3 + 4 * 3]


def test_storage_formula(spark):
    df = spark.createDataFrame([([32, 32, 16], 800)] * 149, "shape array<int>, label_bytes long")
    row = geometry.storage_estimate(df).first()
    image, label = 149 * 32 * 32 * 16 * 5 * 6 * 4, 149 * 800 * 8
    assert (row["image_bytes"], row["label_bytes"], row["reserved_bytes"]) == (image, label, 2 * (image + label))
    assert row["per_fold_bytes"] == image // 5 + label // 4 and math.isclose(row["cases"], 149)
