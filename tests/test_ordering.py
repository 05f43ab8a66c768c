import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelcohort.functions import (
    exact_quantiles,
    finite,
    order_bucket,
    pack_voxel,
    prefix_sums,
    require_empty,
    spread_bucket,
    take_lowest,
    unpack_voxel,
    value_bucket,
    with_rank,
)


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one group; values mix signs, ties, NaN and infinities."""
    rng = np.random.default_rng(1)
    rows = []
    for i in range(900):
        group = "hot" if i % 3 == 0 else f"g{i % 7}"
        value = float(np.round(rng.normal(0, 50), 1)) if i % 11 else float(rng.choice([np.nan, np.inf, -np.inf, 0.0, -3e7]))
        rows.append((group, i, value))
    return spark.createDataFrame(rows, "g string, i long, v double"), rows


def test_quantiles_equal_numpy(skewed):
    df, rows = skewed
    probs = {"lo": 0.005, "q1": 0.25, "mid": 0.5, "hi": 0.995, "max": 1.0}
    got = {r["g"]: r for r in exact_quantiles(df, ["g"], "v", probs).collect()}
    for g in {r[0] for r in rows}:
        values = [v for gg, _, v in rows if gg == g and np.isfinite(v)]
        want = np.quantile(values, list(probs.values()))
        assert np.allclose([got[g][n] for n in probs], want, rtol=0, atol=1e-9)


def test_quantiles_without_group_and_with_weight(spark):
    df = spark.createDataFrame([(1.0, 3), (5.0, 1), (9.0, 2)], "v double, w long")
    row = exact_quantiles(df, [], "v", {"m": 0.5, "q": 0.9}, weight="w").first()
    assert np.allclose([row["m"], row["q"]], np.quantile([1, 1, 1, 5, 9, 9], [0.5, 0.9]))


def test_rank_matches_sort_for_any_partitioning(skewed):
    df, rows = skewed
    clean = df.where(finite(F.col("v")))
    want = {}
    for g in {r[0] for r in rows}:
        members = sorted((v, i) for gg, i, v in rows if gg == g and np.isfinite(v))
        want.update({(g, i): n + 1 for n, (v, i) in enumerate(members)})
    for parts in (1, 17):
        ranked = with_rank(clean.repartition(parts), ["g"], ["v", "i"], value_bucket(F.col("v")), "r", "n")
        assert {(r["g"], r["i"]): r["r"] for r in ranked.collect()} == want


def test_value_bucket_is_monotone(spark):
    values = sorted([-1e30, -2.9e7, -10.0, -1e-3, -1e-31, 0.0, 1e-300, 1e-31, 1e-9, 0.5, 0.50001, 1.0, 3.5, 1e9, 1e300])
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", value_bucket(F.col("v")).alias("b"))
    buckets = [r["b"] for r in df.orderBy("v").collect()]
    assert buckets == sorted(buckets)


def test_prefix_sums(spark):
    df = spark.createDataFrame([("a", float(i), i) for i in range(1, 40)], "g string, v double, n long")
    out = prefix_sums(df, ["g"], "v", value_bucket(F.col("v")), {"before": "n"}, {"total": "n"}).collect()
    assert all(r["before"] == r["n"] * (r["n"] - 1) // 2 and r["total"] == 780 for r in out)


def test_take_lowest_keeps_exactly_the_limit(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("g"), "id", F.md5(F.col("id").cast("string")).alias("h"))
    got = take_lowest(df, ["g"], "h", ["id"], 100)
    rows = [(r["g"], r["h"]) for r in df.collect()]
    want = {x for g in ("hot", "cold") for x in sorted(r for r in rows if r[0] == g)[:100]}
    assert {(r["g"], r["h"]) for r in got.collect()} == want


def test_pack_voxel_round_trip(spark):
    df = spark.createDataFrame([(0, 0, 0), (5, 511, 300), (200, 0, 2097151)], "z int, y int, x int")
    z, y, x = unpack_voxel(pack_voxel(F.col("z"), F.col("y"), F.col("x")))
    rows = df.select("z", "y", "x", z.alias("a"), y.alias("b"), x.alias("c")).collect()
    assert all((r[0], r[1], r[2]) == (r[3], r[4], r[5]) for r in rows)


def test_require_empty(spark):
    schema = "check string, key string, detail string"
    require_empty(spark.createDataFrame([], schema))
    with pytest.raises(ValueError, match="dup"):
        require_empty(spark.createDataFrame([("dup", "1", "")], schema))


def test_order_bucket_for_text_ids(spark):
    ids = [f"sub-stroke{i:04d}" for i in range(0, 3000, 7)] + ["sub-stroke", "sub-strokeX"]
    df = spark.createDataFrame([(i,) for i in ids], "c string")
    ranked = with_rank(df, [], ["c"], order_bucket(df, "c"), "r")
    assert [r["c"] for r in ranked.orderBy("r").collect()] == sorted(ids)


def test_null_groups_and_values_keep_their_rows(spark):
    rows = [(None, 1.0), (None, 2.0), (1, None), (1, float("inf")), (1, float("-inf")), (1, float("nan")), (1, 0.5)]
    df = spark.createDataFrame(rows, "g long, v double")
    ranked = with_rank(df, ["g"], ["v"], value_bucket(F.col("v"))).collect()
    assert sorted((r["g"] or 0, r["rank"], str(r["v"])) for r in ranked) == [
        (0, 1, "1.0"), (0, 2, "2.0"), (1, 1, "None"), (1, 2, "-inf"), (1, 3, "0.5"), (1, 4, "inf"), (1, 5, "nan")]


def test_id_buckets_spread_and_follow_the_order(spark):
    numbers = spark.range(9_000_000_000, 9_000_060_000).withColumnRenamed("id", "k")
    texts = spark.range(60_000).select(F.expr("concat(if(id % 2 = 0, 'sub-', 'patient'), lpad(id, 6, '0'))").alias("k"))
    for df, least in ((numbers, 2_000), (texts, 200)):
        sizes = df.groupBy(order_bucket(df, "k").alias("b")).agg(F.count("*").alias("n"), F.min("k").alias("lo"), F.max("k").alias("hi")).orderBy("b").collect()
        assert len(sizes) >= least and max(r["n"] for r in sizes) < 3_000
        assert all(a["hi"] < b["lo"] for a, b in zip(sizes, sizes[1:]))


def test_spread_buckets_follow_the_values(spark):
    near_one = spark.range(60_000).select((1 - F.col("id") / 6e8).alias("v"))
    times = spark.range(60_000).select((F.col("id") * 1_000 + 1_700_000_000_000).alias("v"))
    heavy = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, 0.5).otherwise(0.5 + F.col("id") / 1e9).alias("v"))
    for df, most in ((near_one, 200), (times, 200), (heavy, 20_200)):
        bucketed = df.groupBy(spread_bucket(df, "v").alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("b").collect()
        assert len(bucketed) > 600 and max(r["n"] for r in bucketed) <= most
        assert all(a["hi"] < b["lo"] for a, b in zip(bucketed, bucketed[1:]))


def test_spread_buckets_give_ranks_of_any_value(spark):
    rows = [(None, 1.0), (None, 2.0), (1, None), (1, float("inf")), (1, float("-inf")), (1, float("nan")), (1, 0.5)]
    df = spark.createDataFrame(rows, "g long, v double")
    want = [(0, 1, "1.0"), (0, 2, "2.0"), (1, 1, "None"), (1, 2, "-inf"), (1, 3, "0.5"), (1, 4, "inf"), (1, 5, "nan")]
    for part, kept in ((df, want), (df.where("v is null"), want[2:3]), (df.where("false"), [])):
        ranked = with_rank(part, ["g"], ["v"], spread_bucket(part, "v")).collect()
        assert sorted((r["g"] or 0, r["rank"], str(r["v"])) for r in ranked) == kept
