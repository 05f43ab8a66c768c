"""Inventory, documents, volumes on disk, sinks, file-stream evaluation and resumable sweeps."""

import gzip
import json
import os
import struct

import numpy as np
import pandas as pd
import pytest
from conftest import checks
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelcohort.operators import metrics
from voxelcohort.plans import classifier
from voxelcohort.session import scratch_path
from voxelcohort.sources import documents, inventory, sinks, volumes
from voxelcohort.streaming.evaluate_stream import current_rows, evaluate_new_cases_stream


def paths(spark, names):
    return spark.createDataFrame([(n,) for n in names], "path string")


def test_scan_drops_side_files(spark, tmp_path):
    for name in ("case1/a.nii.gz", "case1/b.MHA", "case1/._a.nii.gz", "__MACOSX/case1/a.nii.gz", "case1/notes.txt"):
        f = tmp_path / name
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_bytes(b"xy")
    got = inventory.inventory_scan(spark, str(tmp_path))
    assert sorted("/".join(r["path"].split("/")[-2:]) for r in got.collect()) == ["case1/a.nii.gz", "case1/b.MHA"]
    assert "content" not in got.columns


def test_release_categories(spark):
    want = {
        "train\\rawdata\\sub-stroke0001\\ses-01\\sub-stroke0001_ses-01_ncct.nii.gz": "ncct",
        "./train/raw_data/sub-stroke0001/ses-0001/x_NCCT.nii.gz": "ncct",
        "train/derivatives/sub-stroke0001/ses-01/perfusion-maps/x_space-ncct_tmax.nii.gz": "tmax",
        "train/derivatives/sub-stroke0001/ses-01/x_space-ncct_cta.nii.gz": "cta",
        "train/derivatives/sub-stroke0001/ses-02/x_lesion-msk.nii.gz": "lesion_mask",
        "train/phenotype/ses-01/x_demographic_baseline.csv": "baseline_csv",
        "train/derivatives/sub-stroke0001/ses-02/x_space-ncct_tmax.nii.gz": None,
        "train/rawdata/sub-stroke0001/ses-02/x_dwi.nii.gz": None,
    }
    got = inventory.classify_paths(paths(spark, list(want)), inventory.CT_2024_RULES)
    assert {r["path"]: r["category"] for r in got.collect()} == want


def test_modality_order_matters(spark):
    want = {"c/VSD.Brain.XX.O.OT.1/VSD.Brain.XX.O.OT.1.mha": "ot", "c/MR_Flair.1/x.mha": "flair", "c/MR_DWI.2/x.mha": "dwi",
            "c/MR_T2.3/x.mha": "t2", "c/MR_T1.4/x.mha": "t1", "c/groundtruth_flair.nii": "ot", "c/other.nii": None}
    got = inventory.classify_paths(paths(spark, list(want)), inventory.MRI_2015_RULES, inventory.tail_parts(F.col("path")))
    assert {r["path"]: r["category"] for r in got.collect()} == want


def test_case_assembly(spark):
    rows = [("full", "flair"), ("full", "ot"), ("dup", "flair"), ("dup", "flair"), ("dup", "ot"), ("part", "flair"), ("full", "t1")]
    df = spark.createDataFrame([(c, m, f"{c}/{m}{i}") for i, (c, m) in enumerate(rows)], "case_id string, category string, path string")
    cases, found = inventory.assemble_cases(df, ["flair", "ot"], ["t1"])
    assert [(r["case_id"], r["t1"]) for r in cases.collect()] == [("full", "full/t16")]
    assert checks(found) == [("category_missing", "part"), ("category_repeated", "dup")]
    assert [r["channel"] for r in inventory.acute_model_inputs(cases, ["t1", "t2"]).collect()] == ["t1"]


def test_ids_and_sessions(spark):
    df = paths(spark, ["/r/site/sub-a1/ses-1/x.nii"]).select(
        inventory.subject_of(F.col("path")).alias("s"), inventory.case_key(F.col("path"), "/r").alias("k"), inventory.training_id(F.lit("a-b")).alias("t"))
    assert tuple(df.first()) == ("sub-a1", "site__sub-a1__ses-1", "a_b")
    files = spark.createDataFrame([("a", "ncct", "/s/ses-1/a"), ("a", "ncct", "/s/ses-0001/a"), ("a", "ncct", "/s/ses-02/a"), ("b", "ncct", "/s/ses-1/b")], "case_id string, category string, path string")
    assert {r["case_id"]: r["path"] for r in inventory.session_resolve(files, 1).collect()} == {"a": "/s/ses-0001/a", "b": "/s/ses-1/b"}
    clash = spark.createDataFrame([("a-1",), ("a_1",), ("b",)], "case_id string")
    assert checks(inventory.id_collisions(clash)) == [("training_id_collision", "a_1")]


def test_fold_summary_files(spark, tmp_path):
    for fold in (0, 1):
        d = tmp_path / f"fold_{fold}"
        d.mkdir()
        rows = [{"prediction_file": f"/p/c{fold}{i}.nii.gz", "reference_file": f"/r/c{fold}{i}.nii.gz", "metrics": {"1": {"Dice": 0.5 * i, "n_pred": i, "n_ref": 2}}} for i in range(2)]
        (d / "summary.json").write_text(json.dumps({"metric_per_case": rows, "mean": {"1": {"Dice": 0.2}}}, indent=1))
    rows = documents.read_fold_summaries(spark, str(tmp_path / "*" / "summary.json"))
    assert sorted((r["fold"], r["case_id"], r["dice"]) for r in rows.collect()) == [(0, "c00", 0.0), (0, "c01", 0.5), (1, "c10", 0.0), (1, "c11", 0.5)]
    known = spark.createDataFrame([("c00",), ("c01",), ("c10",), ("zz",)], "case_id string")
    assert checks(documents.summary_violations(rows, known)) == [("case_missing", "zz"), ("case_unknown", "c11")]


def test_split_files(spark, tmp_path):
    f = tmp_path / "splits.json"
    f.write_text(json.dumps([{"train": ["a", "b"], "val": ["c"]}, {"train": ["c"], "val": []}], indent=2))
    rows = documents.read_splits(spark, str(f))
    assert (0, "train", 1, "b") in [tuple(r) for r in rows.collect()] and rows.count() == 4
    assert checks(documents.split_file_violations(spark.read.text(str(f), wholetext=True))) == [("val_empty", "splits/1")]


def test_progress_log(spark):
    lines = spark.createDataFrame([(1, "[1/149] sub_a COMPUTED support=12.5%"), (2, "noise"), (3, "[2/149] sub_b CACHED support=7%"), (4, "[1/149] sub_a CACHED support=13%")], "line_no int, value string")
    got = documents.parse_progress_log(lines)
    assert {(r["case_id"], r["support_percent"]) for r in got.collect()} == {("sub_a", 13.0), ("sub_b", 7.0)}
    assert checks(documents.progress_count_violations(got, 149)) == [("case_count", "log")]


def nifti(array, dtype="<i2", code=4, slope=1.0, inter=0.0, magic=b"n+1\0"):
    head = bytearray(352)
    depth, height, width = array.shape
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, width, height, depth, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, code, np.dtype(dtype).itemsize * 8)
    struct.pack_into("<8f", head, 76, 1, 0.5, 0.5, 2.0, 1, 1, 1, 1)
    struct.pack_into("<3f", head, 108, 352, slope, inter)
    struct.pack_into("<h", head, 254, 1)
    struct.pack_into("<12f", head, 280, 0.5, 0, 0, 1, 0, 0.5, 0, 2, 0, 0, 2, 3)
    head[344:348] = magic
    return bytes(head) + array.astype(dtype).tobytes()


def test_volume_files_to_voxels(spark, tmp_path):
    a = np.random.default_rng(0).integers(-1000, 1000, (5, 4, 3))
    (tmp_path / "int.nii.gz").write_bytes(gzip.compress(nifti(a)))
    (tmp_path / "float.nii").write_bytes(nifti(a / 7, "<f4", 16, slope=2.0, inter=1.0))
    (tmp_path / "cut.nii").write_bytes(nifti(a)[:-9])
    (tmp_path / "junk.nii").write_bytes(b"hello" * 100)
    files = volumes.volume_files(spark, str(tmp_path))
    slabs = volumes.ingest_volumes(files)
    vox = volumes.explode_slabs(slabs)
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    got = {(r["n"], r["z"], r["y"], r["x"]): r["value"] for r in vox.select(name.alias("n"), "z", "y", "x", "value").collect()}
    for idx in np.ndindex(a.shape):
        assert got[("int.nii.gz", *idx)] == a[idx]
        assert got[("float.nii", *idx)] == pytest.approx(a[idx] / 7 * 2 + 1, rel=1e-5)
    assert {k.rsplit("/", 1)[-1] for _, k in checks(volumes.ingest_violations(slabs))} == {"cut.nii", "junk.nii"}
    head = volumes.ingest_headers(files).where("path like '%int.nii.gz'").first()
    assert head["shape"] == [3, 4, 5] and head["spacing"] == [0.5, 0.5, 2.0] and head["origin"] == [1.0, 2.0, 3.0] and head["dtype"] == "int16"


def test_keyed_csv_and_sinks(spark):
    df = spark.createDataFrame([("a", "NCCT", 1, 0.5), ("b", "NCCT", 0, 0.25)], "case_id string, channel string, fold int, dice double")
    path = scratch_path(spark, "csv")
    sinks.write_tables(df, path, fmt="csv")
    schema = T.StructType([T.StructField("case_id", T.StringType()), T.StructField("fold", T.IntegerType()), T.StructField("channel", T.StringType()), T.StructField("dice", T.DoubleType())])
    back = documents.read_keyed_csv(spark, path, schema)
    assert sorted(map(tuple, back.collect())) == [("a", 1, "NCCT", 0.5), ("b", 0, "NCCT", 0.25)]
    assert checks(inventory.keyed_table_violations(back, back.select("case_id"), ["NCCT", "MTT"], 4)) == [("key_missing", "a/MTT"), ("key_missing", "b/MTT"), ("row_count", "table")]
    assert inventory.required_columns(back, ["dice", "auc"]) == ["auc"]
    table = scratch_path(spark, "cases")
    sinks.overwrite_partitions(df, table, ["fold"])
    sinks.overwrite_partitions(df.where("fold = 1").withColumn("dice", F.lit(0.75)), table, ["fold"])
    assert sorted((r["case_id"], r["dice"]) for r in spark.read.parquet(table).collect()) == [("a", 0.75), ("b", 0.25)]
    lines = spark.createDataFrame([(2, "b"), (1, "a")], "line_no int, line string")
    text = scratch_path(spark, "txt")
    sinks.write_lines(lines, text)
    assert sorted(r["value"] for r in spark.read.text(text).collect()) == ["a", "b"]
    with pytest.raises(ValueError):
        sinks.write_tables(df, path, fmt="xls")


def test_new_predictions_are_evaluated_once(spark):
    vox = "case_id long, z long, y long, x long"
    ref = spark.createDataFrame([(1, 0, 0, 0), (1, 0, 0, 1), (2, 5, 5, 5)], vox)
    headers = spark.createDataFrame([(c, c % 5, [1.0, 1.0, 1.0]) for c in (1, 2, 3)], "case_id long, fold long, spacing array<double>")
    incoming, out, state = (scratch_path(spark, n) for n in ("in", "out", "cp"))
    run = lambda: evaluate_new_cases_stream(spark, incoming, ref, headers, out, state).awaitTermination()
    first = spark.createDataFrame([(1, 0, 0, 0), (2, 5, 5, 5)], vox)
    first.write.mode("append").parquet(incoming)
    run()
    first.where("case_id = 1").write.mode("append").parquet(incoming)  # same mask again: nothing to do
    spark.createDataFrame([(3, None, None, None)], vox).write.mode("append").parquet(incoming)
    run()
    rows = spark.read.parquet(out).collect()
    assert sorted(r["case_id"] for r in rows) == [1, 2, 3]
    got = {r["case_id"]: r["dice"] for r in rows}
    assert got == {1: pytest.approx(2 / 3), 2: 1.0, 3: 1.0}
    batch = {r["case_id"]: r["dice"] for r in metrics.evaluate_cases(ref, first, headers).collect()}
    assert got == batch


def test_sweep_skips_finished_conditions(spark):
    calls = []

    def make(name, dice):
        def run():
            calls.append(name)
            return spark.createDataFrame([("svm", dice)], "model string, dice_mean double")
        return run

    path = scratch_path(spark, "sweep")
    classifier.run_sweep(spark, {"a": make("a", 0.1), "b": make("b", 0.3)}, path)
    out = classifier.run_sweep(spark, {"a": make("a", 0.9), "b": make("b", 0.9), "c": make("c", 0.3)}, path)
    assert calls == ["a", "b", "c"] and [r["condition"] for r in out.collect()] == ["b", "c", "a"]
    assert len(classifier.FEATURE_VARIANTS) == 12 and len(classifier.SVM_GRID) == 27 and len(classifier.SPLIT_SEEDS) == 20


def test_redelivered_case_leaves_one_row_and_a_repeated_batch_changes_nothing(spark, tmp_path):
    ref = spark.createDataFrame([(c, 0, 0, x) for c in (1, 2) for x in (0, 1)], "case_id long, z long, y long, x long")
    headers = spark.createDataFrame([(c, 0, [1.0, 1.0, 1.0]) for c in (1, 2)], "case_id long, fold int, spacing array<double>")
    incoming, out, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    deliver = lambda rows: spark.createDataFrame(rows, "case_id long, z long, y long, x long").coalesce(1).write.mode("append").parquet(incoming)
    run = lambda: evaluate_new_cases_stream(spark, incoming, ref, headers, out, state).awaitTermination()
    dice = lambda: {r["case_id"]: round(r["dice"], 3) for r in current_rows(spark, out).collect()}
    assert current_rows(spark, out) is None
    deliver([(1, 0, 0, 0), (1, 0, 0, 1), (2, 0, 0, 0)])
    run()
    assert dice() == {1: 1.0, 2: 0.667} and current_rows(spark, out).count() == 2
    deliver([(2, 0, 0, 0), (2, 0, 0, 1)])  # another mask of case 2
    run()
    assert dice() == {1: 1.0, 2: 1.0} and current_rows(spark, out).count() == 2
    before = sorted(map(str, current_rows(spark, out).collect()))
    deliver([(2, 0, 0, 1), (2, 0, 0, 0)])  # the same mask once more
    run()
    assert sorted(map(str, current_rows(spark, out).collect())) == before
    # the second batch as if it had failed before it was marked as done
    os.remove(os.path.join(state, "commits", "2"))
    os.remove(os.path.join(state, "commits", "1"))
    for name in (".1.crc", ".2.crc"):
        path = os.path.join(state, "commits", name)
        if os.path.exists(path):
            os.remove(path)
    run()
    assert sorted(map(str, current_rows(spark, out).collect())) == before


def test_slabs_of_many_small_files_share_a_table():
    head = bytearray(352)
    for form, at, numbers in (("<i", 0, (348,)), ("<8h", 40, (3, 2, 2, 1, 1, 1, 1, 1)), ("<2h", 70, (16, 32)), ("<8f", 76, (1,) * 8), ("<3f", 108, (352, 1, 0))):
        struct.pack_into(form, head, at, *numbers)
    head[344:348] = b"n+1\0"
    files = pd.DataFrame({"path": [str(i) for i in range(50)], "content": [bytes(head) + np.full(4, i, "<f4").tobytes() for i in range(49)] + [b"short"]})
    made = list(volumes._read_slabs(iter([files])))
    assert len(made) == 1 and list(made[0]["path"]) == list(files["path"]) and made[0]["error"].notna().sum() == 1
    assert [float(v[0]) for v in made[0]["values"][:49]] == list(range(49))
