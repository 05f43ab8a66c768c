"""Registered queries: complete registry, SQL checks at the smallest scale, and plan shapes."""

import os
import random

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from tools.check import TABLES, canonical
from voxelcohort.plans import catalog
from voxelcohort.functions import exact_quantiles, hash_key, take_lowest, value_bucket, with_rank
from voxelcohort.operators import components, features, masks, metrics, preprocess

SF = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_registry():
    queries, oracles = contract.queries(), contract.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 110
    unchecked = set(catalog.QUERIES) - set(catalog.ORACLES)  # corpus operators have brute-force tests of their own
    assert unchecked == {"inventory_scan", "content_digest", "mlp_score", "svm_score", "train_eval", "pixel_leakage_eval", "histogram_eval",
                         "fit_normalization_sketch", "morphology_sweep", "split_sweep", "svm_sweep", "feature_sweep", "leakage_sweep", "histogram_sweep"}


def close(x, y):
    """Rounded numbers may differ by one unit of the last place."""
    try:
        return abs(float(x.lstrip("f")) - float(y.lstrip("f"))) <= 1.01e-6
    except ValueError:
        return False


@needs_data
def test_entry(spark):
    assert contract.entry(spark).count() > 0


@needs_data
@pytest.mark.parametrize("name", sorted(contract.oracle_sql()))
def test_query_equals_sql(spark, db, name):
    got = contract.queries()[name](spark, SF).toPandas()
    want = db.sql(contract.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = canonical(got), canonical(want)
    assert len(a) == len(b)
    for left, right in zip(a, b, strict=True):
        assert all(x == y or close(x, y) for x, y in zip(left, right, strict=True)), (left, right)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def pixels(spark):
    return spark.range(4096).selectExpr("id div 256 as case_id", "id % 256 div 16 as row", "id % 16 as col", "double(id % 37) as value", "true as brain")


def test_pixel_stages_stay_in_the_jvm_and_spread(spark, pixels):
    vox = pixels.selectExpr("case_id", "0 as z", "row as y", "col as x", "value", "'c' as channel")
    plans = {
        "features": features.nine_features(pixels), "median": preprocess.median_filter(pixels),
        "quantiles": exact_quantiles(vox, ["case_id"], "value", {"m": 0.5}),
        "runs": components.to_runs(vox), "edges": components.touching_runs(components.to_runs(vox), 26),
        "overlap": metrics.overlap_metrics(vox, vox.where("value > 5"), vox),
        "auc": metrics.roc_auc(pixels.withColumn("label", F.col("value") > 9), "value", "label"),
        "rank": with_rank(vox, ["case_id"], ["value"], value_bucket(F.col("value"))),
        "intersect": masks.mask_intersect(vox, vox),
    }
    for name, df in plans.items():
        plan = plan_of(df)
        for bad in ("SinglePartition", "CartesianProduct", "BroadcastNestedLoopJoin", "Python"):
            assert bad not in plan, (name, bad)


def test_windows_are_never_partitioned_by_case_alone(spark, pixels):
    """Row windows on pixels carry a line or bucket key next to the case."""
    ranked = with_rank(pixels.withColumn("h", hash_key(["case_id", "row", "col"], 1)), ["case_id"], ["h"], F.substring("h", 1, 3))
    plan = plan_of(ranked)
    assert "row_number() windowspecdefinition(case_id" in plan and "_b" in plan.split("row_number() windowspecdefinition(")[1].split(")")[0]


def test_sampling_drops_buckets_before_the_shuffle(spark, pixels):
    keyed = pixels.withColumn("h", hash_key(["case_id", "row", "col"], 1))
    plan = plan_of(take_lowest(keyed, ["case_id"], "h", ["row", "col"], 10))
    assert "BroadcastHashJoin" in plan


@needs_data
def test_filters_and_columns_reach_the_scan(spark):
    from voxelcohort.plans.views import view

    plan = plan_of(view(spark, SF, "vox3").where("ref").select("case_id", "z"))
    read = plan.split("ReadSchema: ")[1].split("\n")[0]
    assert "o_totalprice" not in read and "o_orderdate" not in read
    assert "EqualTo(o_orderstatus,F)" in plan


def ties(folder, spark):
    """``lineitem`` of 40 suppliers whose scores tie exactly at 0.5, its rows mixed over five files."""
    rng, rows = random.Random(3), []
    for supplier in range(40):
        discount, tax = [rng.choice((2, 8)) for _ in range(60)], [rng.choice((1, 7)) for _ in range(60)]
        for cents, most, total in ((discount, 10, 300), (tax, 8, 250)):
            while sum(cents) != total:
                i, step = rng.randrange(60), 1 if sum(cents) < total else -1
                cents[i] = min(max(cents[i] + step, 0), most)
        rows += [(supplier, 1.0, 100.0 + i, d / 100, t / 100) for i, (d, t) in enumerate(zip(discount, tax))]
    rng.shuffle(rows)
    for i in range(5):
        part = spark.createDataFrame(rows[i::5], "l_suppkey long, l_quantity double, l_extendedprice double, l_discount double, l_tax double")
        part.coalesce(1).write.parquet(f"{folder}/lineitem.parquet/part={i}")
    con = duckdb.connect()
    con.execute("SET threads = 1")  # its sums follow the order of the rows then
    con.execute(f"CREATE VIEW lineitem AS SELECT * EXCLUDE (part) FROM read_parquet('{folder}/lineitem.parquet/*/*.parquet', hive_partitioning = true)")
    return con


def test_exact_ties_fall_as_in_sql_whatever_the_files(spark, tmp_path):
    con = ties(tmp_path, spark)
    for name in ("win_loss", "score_snapshot"):
        got = contract.queries()[name](spark, str(tmp_path)).toPandas()
        assert canonical(got) == canonical(con.sql(contract.oracle_sql()[name]).df()), name
