import pytest
from conftest import checks
from pyspark.sql import functions as F

from voxelcohort.operators import splits


def ids(spark, n):
    return spark.range(n).select(F.format_string("case%03d", "id").alias("case_id"))


def test_holdout_counts_and_determinism(spark):
    cases = ids(spark, 28)
    a = {(r["case_id"], r["role"]) for r in splits.holdout_split(cases, train_size=19).collect()}
    b = {(r["case_id"], r["role"]) for r in splits.holdout_split(cases.repartition(17), train_size=19).collect()}
    assert a == b and sum(r == "train" for _, r in a) == 19 and len(a) == 28
    with pytest.raises(ValueError):
        splits.holdout_split(cases, test_fraction=1.0)
    assert checks(splits.split_violations(splits.holdout_split(cases, train_size=28))) == [("empty_test", "split")]


def test_holdout_rounds_half_to_even(spark):
    # 5 * 0.3 = 1.5 and 15 * 0.3 = 4.5: both round to the even neighbour
    for n, test in ((5, 2), (15, 4)):
        roles = [r["role"] for r in splits.holdout_split(ids(spark, n), test_fraction=0.3).collect()]
        assert roles.count("test") == test


def test_kfold_sizes_and_expansion(spark):
    folds = splits.kfold(ids(spark, 149), 5)
    sizes = {r["fold"]: r["count"] for r in folds.groupBy("fold").count().collect()}
    assert [sizes[f] for f in range(5)] == [30, 30, 30, 30, 29]
    roles = splits.expand_folds(folds, 5)
    assert roles.where("role = 'train' and fold = 4").count() == 120
    assert checks(splits.check_folds(roles, ids(spark, 149), 5, [30, 30, 30, 30, 29])) == []


@pytest.fixture(scope="module")
def leave_one_out(spark):
    rows = [(f, "val" if c == v else "train", c) for f, v in enumerate("abc") for c in "abc"]
    return rows, spark.createDataFrame([(c,) for c in "abc"], "case_id string")


def folds(spark, rows):
    return spark.createDataFrame(rows, "fold int, role string, case_id string")


def test_fold_tampering_yields_one_kind_each(spark, leave_one_out):
    rows, cases = leave_one_out
    kinds = lambda r: {c for c, _ in checks(splits.check_folds(folds(spark, r), cases, 3))}
    assert kinds(rows) == set()
    assert kinds(rows + [(0, "train", "b")]) == {"train_repeated"}
    assert kinds(rows + [(0, "train", "a")]) == {"train_val_overlap"}
    assert kinds([r for r in rows if r != (0, "train", "c")]) == {"train_not_complement"}
    swapped = [r for r in rows if r not in ((0, "train", "b"),)] + [(0, "val", "b")]
    assert kinds(swapped) == {"val_repeated"}
    gone = [r for r in rows if r != (2, "val", "c")]
    assert kinds(gone) == {"val_missing", "train_not_complement"}
    assert "case_unexpected" in kinds(rows + [(1, "train", "x")])


def test_compare_folds_kinds(spark):
    schema = "fold int, role string, case_id string, pos int"
    a = spark.createDataFrame([(0, "val", "a", 0), (0, "val", "b", 1), (0, "val", "c", 2)], schema)
    b = spark.createDataFrame([(0, "val", "a", 1), (0, "val", "b", 0), (0, "val", "d", 2)], schema)
    got = {(r["case_id"], r["kind"]) for r in splits.compare_folds(a, b).collect()}
    assert got == {("a", "order"), ("b", "order"), ("c", "missing"), ("d", "extra")}


@pytest.mark.parametrize("n,val,want", [(100, 0.15, (70, 15, 15)), (101, 0.0, (70, 0, 31))])
def test_pixel_partition_counts(spark, n, val, want):
    pixels = spark.range(n).selectExpr("'a' as case_id", "id as p")
    roles = [r["role"] for r in splits.pixel_partition(pixels, ["p"], 0.70, val).collect()]
    assert tuple(roles.count(k) for k in ("train", "validation", "test")) == want


def test_balanced_sample(spark):
    df = spark.range(20).selectExpr("id", "if(id < 6, 1, 0) as label")
    got = splits.balanced_sample(df, "label", ["id"], 5)
    assert sorted(r["label"] for r in got.collect()) == [0] * 5 + [1] * 5
    assert splits.balanced_sample(df, "label", ["id"], 100).count() == 12
    assert checks(splits.class_violations(df.where("label = 0"), "label")) == [("class_missing", "1")]


def test_support_sample_limits_and_minimum(spark):
    df = spark.range(200).selectExpr(
        "if(id < 190, 'hot', 'few') as case_id", "'mtt' as channel", "0 as z", "0 as y", "id as x", "if(id % 10 = 0, double('NaN'), double(id)) as value")
    got = splits.support_sample(df, 50)
    assert got.where("case_id = 'hot'").count() == 50 and got.where("isnan(value)").count() == 0
    assert checks(splits.support_sample_violations(df)) == [("too_few_samples", "few/mtt")]


def test_support_sample_takes_small_groups_whole(spark, capsys):
    """Groups within the limit, null ones too, are not ranked; beside larger ones the sample is the same."""
    small = spark.range(90).selectExpr("if(id < 60, 'a', null) as case_id", "'mtt' as channel", "0 as z", "0 as y", "id as x", "double(id) as value")
    got = splits.support_sample(small, 64)
    got.explain()
    assert "row_number" not in capsys.readouterr().out
    assert sorted(r["x"] for r in got.collect()) == list(range(90))
    large = spark.range(500).selectExpr("'b' as case_id", "'mtt' as channel", "0 as z", "0 as y", "id as x", "double(id) as value")
    both = splits.support_sample(small.unionByName(large), 64)
    rank = "row_number() over (order by md5(concat_ws('|', case_id, channel, z, y, x, '2026')), z, y, x) as p"
    want = large.selectExpr("*", rank).where("p <= 64").drop("p").unionByName(small)
    assert sorted(map(str, both.collect())) == sorted(map(str, want.collect()))


def test_stride_samples(spark):
    df = spark.range(60).selectExpr("'a' as case_id", "'c' as channel", "id div 20 as z", "(id % 20) div 5 as y", "id % 5 as x",
                                    "if(id = 4, double('NaN'), double(id)) as value")
    finite = [r["value"] for r in splits.stride_sample(df, 10, "finite").orderBy("value").collect()]
    values = [float(i) for i in range(60) if i != 4]
    assert finite == values[::6]
    grid = [r["value"] for r in splits.stride_sample(df, 15, "grid", (3, 4, 5)).orderBy("value").collect()]
    assert grid == [float(i) for i in range(0, 60, 4) if i != 4]


def test_evenly_spaced_pick(spark):
    for m, n in ((149, 16), (10, 10), (30, 1), (7, 3)):
        got = sorted(r["case_id"] for r in splits.evenly_spaced_pick(spark.range(m).selectExpr("id * 3 as case_id"), n).collect())
        assert got == [3 * (0 if n == 1 else i * (m - 1) // (n - 1)) for i in range(n)]


def test_file_plan_and_leaks(spark):
    roles = folds(spark, [(0, "train", "a"), (0, "val", "b")])
    plan = splits.fold_file_plan(roles, [("single", 1), ("multi", 5)])
    assert plan.where("`group` = 'labelsTr'").count() == 2 and plan.count() == 14
    assert plan.where("case_id = 'b' and `group` <> 'imagesTs'").count() == 0
    leak = spark.createDataFrame([(0, "multi", "b", "labelsTr", "b.nii.gz")], "fold int, arm string, case_id string, `group` string, file_name string")
    found = splits.reconcile_inventory(plan, plan.unionByName(leak), roles)
    assert checks(found) == [("extra", "0/multi/b.nii.gz"), ("heldout_label", "0/multi/b.nii.gz")]


def test_missing_artifacts_and_shards(spark):
    cases = spark.createDataFrame([(1,), (2,)], "case_id long")
    files = spark.createDataFrame([(1, ".npz", 5), (1, ".pkl", 0), (2, ".npz", 1), (2, ".pkl", 2)], "case_id long, suffix string, length long")
    assert [tuple(r) for r in splits.missing_artifacts(cases, [".npz", ".pkl"], files).collect()] == [(1, ".pkl")]
    shards = splits.shard_plan(spark.range(23).selectExpr("id as case_id", "2L as size"), 10).orderBy("shard").collect()
    assert [(r["subjects"], r["bytes"]) for r in shards] == [(10, 20), (10, 20), (3, 6)]
    assert shards[2]["subject_list"] == "20,21,22"


def test_thinned_rows_and_shared_splits_give_the_same_draws(spark):
    rows = spark.range(6000).selectExpr("if(id % 2 = 0, 'a', 'b') as data", "id as case_id", "cast(id % 7 = 0 as int) as label")
    sizes = {(r["data"], r["label"]): r["count"] for r in rows.groupBy("data", "label").count().collect()}
    few = splits.thinned(rows, sizes, ["data", "case_id"], 20)
    draw = lambda df: sorted(map(tuple, splits.balanced_sample(df, "label", ["data", "case_id"], 20, group=["data"]).collect()))
    assert few.count() < 1000 and draw(few) == draw(rows) and len(draw(few)) == 80
    cases = spark.range(50).select(F.col("id").alias("case_id"))
    got = {(r["data"], r["case_id"]): r["role"] for r in splits.holdout_splits(cases, {"x": 3, "y": 4}).collect()}
    for name, seed in (("x", 3), ("y", 4)):
        assert {(name, r["case_id"]): r["role"] for r in splits.holdout_split(cases, seed=seed).collect()}.items() <= got.items()
