"""Segmentation metric queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelcohort.functions import closed_round
from voxelcohort.operators import components, masks, metrics
from voxelcohort.plans.catalog_masks import NEAR26, reach_sql, recursive
from voxelcohort.plans.registry import query
from voxelcohort.plans.views import cte, settled_arms, view


def rounded(df, *names, places=6):
    for n in names:
        df = df.withColumn(n, closed_round(F.col(n), places))
    return df


def masks_of(spark, sf):
    voxels = view(spark, sf, "vox3")
    keys = ["case_id", "z", "y", "x"]
    return voxels, voxels.where("ref").select(*keys), voxels.where("pred").select(*keys), voxels.select("case_id").distinct()


OVERLAP_SQL = cte("vox3") + """,
c AS (SELECT case_id, count(*) FILTER (ref AND pred) AS tp, count(*) FILTER (ref) AS n_ref, count(*) FILTER (pred) AS n_pred FROM vox3 GROUP BY case_id)"""
OVERLAP_SCORES = """case_id, tp, n_ref, n_pred,
  round(CASE WHEN n_ref + n_pred = 0 THEN 1.0 ELSE 2.0 * tp / (n_ref + n_pred) END, 6) AS dice,
  round(CASE WHEN n_ref + n_pred = 0 THEN 1.0 ELSE tp / greatest(n_pred, 1) END, 6) AS precision,
  round(CASE WHEN n_ref + n_pred = 0 THEN 1.0 ELSE tp / greatest(n_ref, 1) END, 6) AS recall"""


@query("overlap_metrics", OVERLAP_SQL + f" SELECT {OVERLAP_SCORES} FROM c")
def overlap_metrics(spark, sf):
    _, ref, pred, cases = masks_of(spark, sf)
    return rounded(metrics.overlap_metrics(ref, pred, cases), "dice", "precision", "recall")


@query("overlap_metrics_dense", OVERLAP_SQL + f" SELECT {OVERLAP_SCORES} FROM c")
def overlap_metrics_dense(spark, sf):
    out = metrics.overlap_metrics_dense(view(spark, sf, "vox3"), F.col("ref"), F.col("pred"))
    return rounded(out, "dice", "precision", "recall")


@query("roc_auc", cte("img2") + """,
t AS (SELECT case_id, floor(score / 5000) AS s, count(*) FILTER (label) AS p, count(*) FILTER (NOT label) AS q FROM img2 GROUP BY ALL),
w AS (SELECT *, coalesce(sum(q) OVER (PARTITION BY case_id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM t)
SELECT case_id, CAST(sum(p) AS BIGINT) AS n_pos, CAST(sum(q) AS BIGINT) AS n_neg,
  round(CAST(sum(p * (below + q * 0.5)) AS DOUBLE) / (CAST(sum(p) AS DOUBLE) * CAST(sum(q) AS DOUBLE)), 6) AS auc FROM w GROUP BY case_id""")
def roc_auc(spark, sf):
    scored = view(spark, sf, "img2").selectExpr("case_id", "label", "double(floor(score / 5000)) as score")
    return rounded(metrics.roc_auc(scored, "score", "label"), "auc")


def case_headers(spark, sf):
    return view(spark, sf, "vox3").groupBy("case_id").agg(F.lit(0).alias("_")).select(
        "case_id", (F.col("case_id") % 5).alias("fold"),
        F.array(F.lit(2.0), F.lit(2.0), (F.lit(1.0) + F.col("case_id") % 7)).alias("spacing"))


VOLUME_SQL = """round(n_ref * 4.0 * (1 + case_id % 7) / 1000, 6) AS reference_volume_ml,
  round(n_pred * 4.0 * (1 + case_id % 7) / 1000, 6) AS prediction_volume_ml,
  round(abs(n_ref - n_pred) * 4.0 * (1 + case_id % 7) / 1000, 6) AS absolute_volume_difference_ml"""
VOLUME_SQL = VOLUME_SQL.replace("4.0", "CAST(4 AS DOUBLE)")
VOLUMES = ("reference_volume_ml", "prediction_volume_ml", "absolute_volume_difference_ml")


@query("abs_volume_difference", OVERLAP_SQL + f" SELECT case_id, {VOLUME_SQL} FROM c")
def abs_volume_difference(spark, sf):
    _, ref, pred, cases = masks_of(spark, sf)
    counts = metrics.overlap_metrics(ref, pred, cases).select("case_id", "n_ref", "n_pred")
    return rounded(metrics.volume_metrics(counts, case_headers(spark, sf)), *VOLUMES).drop("n_ref", "n_pred")


CONTACT_SQL = recursive(cte("vox3")) + f""", a AS (SELECT case_id, z, y, x, k FROM vox3 WHERE ref),
b AS (SELECT case_id, z, y, x, k FROM vox3 WHERE pred),
{reach_sql("la", "a", NEAR26)}, {reach_sql("lb", "b", NEAR26)},
contacts AS (SELECT coalesce(la.case_id, lb.case_id) AS case_id, la.label AS r, lb.label AS p, count(*) AS n
  FROM la FULL OUTER JOIN lb ON la.case_id = lb.case_id AND la.k = lb.k GROUP BY ALL),
cases AS (SELECT DISTINCT case_id FROM vox3),
cnt AS (SELECT c.case_id, count(DISTINCT r) AS ref_lesions, count(DISTINCT p) AS pred_lesions FROM cases c LEFT JOIN contacts t ON t.case_id = c.case_id GROUP BY c.case_id)"""


def contacts_of(spark, sf):
    _, ref, pred, cases = masks_of(spark, sf)
    return metrics.contact_table(components.label_components(ref), components.label_components(pred)), cases


@query("lesion_count_difference", CONTACT_SQL + " SELECT *, abs(ref_lesions - pred_lesions) AS lesion_count_difference FROM cnt")
def lesion_count_difference(spark, sf):
    return metrics.lesion_counts(*contacts_of(spark, sf))


@query("lesion_f1_overlap", CONTACT_SQL + """,
s AS (SELECT cnt.case_id, ref_lesions AS r, pred_lesions AS p, count(DISTINCT t.r) FILTER (t.p IS NOT NULL) AS tp, count(DISTINCT t.p) FILTER (t.r IS NOT NULL) AS pm
  FROM cnt LEFT JOIN contacts t ON t.case_id = cnt.case_id GROUP BY ALL)
SELECT case_id, tp, p - pm AS fp, r - tp AS fn, round(CASE WHEN r + p = 0 THEN 1.0 ELSE tp / (tp + (p - pm + r - tp) / 2.0) END, 6) AS lesion_f1 FROM s""")
def lesion_f1_overlap(spark, sf):
    return rounded(metrics.lesion_f1_overlap(*contacts_of(spark, sf)), "lesion_f1")


MATCHED_SQL = CONTACT_SQL + """,
rs AS (SELECT case_id, r, sum(n) AS sz FROM contacts WHERE r IS NOT NULL GROUP BY ALL),
ps AS (SELECT case_id, p, sum(n) AS sz FROM contacts WHERE p IS NOT NULL GROUP BY ALL),
pairs AS (SELECT t.case_id, t.r, t.p, row_number() OVER (PARTITION BY t.case_id ORDER BY n / (rs.sz + ps.sz - n) DESC, t.r, t.p) AS i
  FROM contacts t JOIN rs ON rs.case_id = t.case_id AND rs.r = t.r JOIN ps ON ps.case_id = t.case_id AND ps.p = t.p WHERE n / (rs.sz + ps.sz - n) >= 0.2),
greedy(case_id, i, ur, up) AS (SELECT case_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]) FROM cases
  UNION ALL SELECT g.case_id, q.i, CASE WHEN list_contains(ur, q.r) OR list_contains(up, q.p) THEN ur ELSE list_append(ur, q.r) END,
    CASE WHEN list_contains(ur, q.r) OR list_contains(up, q.p) THEN up ELSE list_append(up, q.p) END
  FROM greedy g JOIN pairs q ON q.case_id = g.case_id AND q.i = g.i + 1),
tp AS (SELECT case_id, max(len(ur)) AS tp FROM greedy GROUP BY case_id),
f1 AS (SELECT cnt.*, tp, CASE WHEN ref_lesions = 0 AND pred_lesions = 0 THEN 1.0 WHEN ref_lesions = 0 OR pred_lesions = 0 THEN 0.0
  ELSE tp / (tp + (pred_lesions - tp + ref_lesions - tp) / 2.0) END AS f1 FROM cnt JOIN tp ON tp.case_id = cnt.case_id)"""


@query("lesion_f1_matched", MATCHED_SQL + """
SELECT case_id, tp, pred_lesions - tp AS fp, ref_lesions - tp AS fn, round(f1, 6) AS lesion_f1 FROM f1""")
def lesion_f1_matched(spark, sf):
    return rounded(metrics.lesion_f1_matched(*contacts_of(spark, sf)), "lesion_f1")


EVAL_SQL = MATCHED_SQL + f""",
c AS (SELECT case_id, count(*) FILTER (ref AND pred) AS tp, count(*) FILTER (ref) AS n_ref, count(*) FILTER (pred) AS n_pred FROM vox3 GROUP BY case_id),
ev AS (SELECT c.case_id, c.case_id % 5 AS fold, CASE WHEN n_ref + n_pred = 0 THEN 1.0 ELSE 2.0 * c.tp / (n_ref + n_pred) END AS dice, f1 AS lesion_f1,
  ref_lesions, pred_lesions, abs(ref_lesions - pred_lesions) AS lesion_count_difference, n_ref, n_pred FROM c JOIN f1 ON f1.case_id = c.case_id)"""


@query("evaluate_cases", EVAL_SQL + f"""
SELECT case_id, fold, round(dice, 6) AS dice, round(lesion_f1, 6) AS lesion_f1, ref_lesions, pred_lesions, lesion_count_difference, {VOLUME_SQL},
  ref_lesions AS reference_lesion_count, CAST(4 AS DOUBLE) * (1 + case_id % 7) / 1000 AS voxel_volume_ml FROM ev""")
def evaluate_cases(spark, sf):
    _, ref, pred, _ = masks_of(spark, sf)
    return rounded(metrics.evaluate_cases(ref, pred, case_headers(spark, sf)), "dice", "lesion_f1", *VOLUMES)


@query("evaluate_violations", """
WITH h AS (SELECT c_custkey AS case_id, c_custkey % 17 AS side FROM customer), dl AS (SELECT DISTINCT o_custkey AS case_id FROM orders WHERE o_orderstatus <> 'O' UNION SELECT -1)
SELECT 'prediction_missing' AS "check", CAST(case_id AS VARCHAR) AS key, '' AS detail FROM h WHERE case_id NOT IN (SELECT case_id FROM dl)
UNION ALL SELECT 'prediction_unknown', CAST(case_id AS VARCHAR), '' FROM dl WHERE case_id NOT IN (SELECT case_id FROM h)
UNION ALL SELECT 'spacing', CAST(case_id AS VARCHAR), '0.0,1.0,1.0' FROM h WHERE side = 0
UNION ALL SELECT 'grid_mismatch', CAST(o_custkey AS VARCHAR), CAST(count(DISTINCT o_orderkey % 3) AS VARCHAR) FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderkey % 3) > 1""")
def evaluate_violations(spark, sf):
    from voxelcohort.plans.views import table
    cases = table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), F.array((F.col("c_custkey") % 17).cast("double"), F.lit(1.0), F.lit(1.0)).alias("spacing"))
    orders = table(spark, sf, "orders")
    delivered = orders.where("o_orderstatus <> 'O'").selectExpr("o_custkey as case_id").unionByName(spark.range(-1, 0).withColumnRenamed("id", "case_id"))
    grids = orders.selectExpr("o_custkey as case_id", "o_orderkey as image", "o_orderkey % 3 as shape")
    return metrics.evaluate_violations(cases, delivered, grids)


@query("pair_evaluated", EVAL_SQL + """
SELECT case_id, fold, round(n_ref * CAST(4 AS DOUBLE) * (1 + case_id % 7) / 1000, 6) AS reference_volume_ml, round(dice, 6) AS a_dice, CAST(1 AS DOUBLE) AS b_dice,
  round(1 - dice, 6) AS delta_dice FROM ev""")
def pair_evaluated(spark, sf):
    """Scored predictions against scored references as second arm, from the evaluation straight into the pairing."""
    from voxelcohort.operators import statistics
    _, ref, pred, _ = masks_of(spark, sf)
    arms = [metrics.evaluate_cases(ref, m, case_headers(spark, sf)) for m in (pred, ref)]
    pairs, _ = statistics.pair_arms(*arms, ["dice"])
    return rounded(pairs, "a_dice", "b_dice", "delta_dice", "reference_volume_ml")


@query("missing_predictions", """
SELECT 'prediction_missing' AS "check", CAST(c_custkey AS VARCHAR) AS key, '' AS detail FROM customer
WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def missing_predictions(spark, sf):
    from voxelcohort.plans.views import table
    cases = table(spark, sf, "customer").selectExpr("c_custkey as case_id")
    delivered = table(spark, sf, "orders").where("o_orderstatus = 'F'").selectExpr("o_custkey as case_id")
    return metrics.missing_predictions(cases, delivered)


@query("cross_check", OVERLAP_SQL + """,
d AS (SELECT case_id, CASE WHEN n_ref + n_pred = 0 THEN CAST(1 AS DOUBLE) ELSE CAST(2 AS DOUBLE) * tp / (n_ref + n_pred) END AS dice FROM c)
SELECT case_id, round(dice, 6) AS recomputed, round(dice + case_id / 1e7, 6) AS recorded, round(case_id / 1e7, 9) AS delta FROM d WHERE case_id / 1e7 > 1.05e-6""")
def cross_check(spark, sf):
    mine = metrics.overlap_metrics_dense(view(spark, sf, "vox3"), F.col("ref"), F.col("pred"))
    theirs = mine.withColumn("dice", F.col("dice") + F.col("case_id") / 1e7)
    out = rounded(metrics.cross_check(mine, theirs, tol=1.05e-6), "recomputed", "recorded")
    return rounded(out, "delta", places=9)


@query("cross_check_summary", OVERLAP_SQL + """
SELECT count(*) AS compared, count(*) FILTER (case_id / 1e7 > 1.05e-6) AS over_tolerance, round(max(case_id / 1e7), 6) AS max_delta FROM c""")
def cross_check_summary(spark, sf):
    mine = metrics.overlap_metrics_dense(view(spark, sf, "vox3"), F.col("ref"), F.col("pred"))
    theirs = mine.withColumn("dice", F.col("dice") + F.col("case_id") / 1e7)
    return rounded(metrics.cross_check_summary(mine, theirs, tol=1.05e-6), "max_delta")


STATS = ("mean", "std", "min", "max", "q1", "median", "q3")


def summary_sql(source: str, metric_names, fold: str = "fold") -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{m}' AS metric, CAST({s} AS BIGINT) AS scope, CAST({m} AS DOUBLE) AS v FROM {source}"
        for m in metric_names for s in ("-1", fold))
    return f"""SELECT metric, scope, count(*) AS n, round(avg(v), 6) AS mean, round(coalesce(stddev_samp(v), 0), 6) AS std,
  round(min(v), 6) AS min, round(max(v), 6) AS max, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS median,
  round(quantile_cont(v, 0.75), 6) AS q3 FROM ({parts}) GROUP BY metric, scope"""


@query("metric_summary", cte("arms") + " " + summary_sql("arms", ("a_dice", "b_dice", "a_avd", "b_avd")))
def metric_summary(spark, sf):
    return rounded(metrics.metric_summary(view(spark, sf, "arms"), ("a_dice", "b_dice", "a_avd", "b_avd")), *STATS)


@query("metric_summary_ci", cte("arms") + """,
sc AS (SELECT case_id, a_dice, b_dice, unnest([-1, fold]) AS scope FROM arms),
num AS (SELECT *, row_number() OVER (PARTITION BY scope ORDER BY case_id) - 1 AS i, count(*) OVER (PARTITION BY scope) AS n FROM sc),
dr AS (SELECT scope, r.range AS rep, CAST(('0x' || substr(md5(concat_ws('|', r.range, i, '2026')), 1, 12)) AS BIGINT) % n AS i FROM num, range(10000) r),
bm AS (SELECT dr.scope, rep, avg(a_dice) AS a_dice, avg(b_dice) AS b_dice FROM dr JOIN num ON num.scope = dr.scope AND num.i = dr.i GROUP BY dr.scope, rep),
u AS (SELECT 'a_dice' AS metric, scope, a_dice AS v FROM bm UNION ALL SELECT 'b_dice', scope, b_dice FROM bm)
SELECT metric, CAST(scope AS BIGINT) AS scope, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high FROM u GROUP BY ALL""")
def metric_summary_ci(spark, sf):
    out = metrics.metric_summary(view(spark, sf, "arms"), ("a_dice", "b_dice"), bootstrap_reps=10_000)
    return rounded(out, "ci_low", "ci_high").select("metric", "scope", "ci_low", "ci_high")


FLAGSHIP_METRICS = ("dice", "reference_volume_ml", "absolute_volume_difference_ml")


@query("flagship_cohort_summary", OVERLAP_SQL + f""",
fc AS (SELECT case_id, case_id % 5 AS fold, CASE WHEN n_ref + n_pred = 0 THEN 1.0 ELSE 2.0 * tp / (n_ref + n_pred) END AS dice,
  n_ref * CAST(4 AS DOUBLE) * (1 + case_id % 7) / 1000 AS reference_volume_ml,
  abs(n_ref - n_pred) * CAST(4 AS DOUBLE) * (1 + case_id % 7) / 1000 AS absolute_volume_difference_ml FROM c)
""" + summary_sql("fc", FLAGSHIP_METRICS))
def flagship_cohort_summary(spark, sf):
    _, ref, pred, _ = masks_of(spark, sf)
    headers = case_headers(spark, sf)
    scored = metrics.volume_metrics(metrics.overlap_metrics(ref, pred, headers), headers)
    scored = scored.withColumn("fold", F.col("case_id") % 5)
    return rounded(metrics.metric_summary(scored, FLAGSHIP_METRICS), *STATS)


@query("finite_summary", """
WITH r AS (SELECT l_suppkey % 7 AS model, CASE WHEN l_linenumber = 7 THEN CAST('NaN' AS DOUBLE) ELSE l_discount END AS dice,
  CASE WHEN l_suppkey % 7 = 3 THEN CAST('NaN' AS DOUBLE) ELSE l_tax END AS auc FROM lineitem),
u AS (SELECT model, 'dice' AS metric, dice AS v FROM r UNION ALL SELECT model, 'auc', auc FROM r)
SELECT model, metric, count(*) FILTER (isfinite(v)) AS n, coalesce(round(avg(v) FILTER (isfinite(v)), 6), -1) AS mean,
  coalesce(round(stddev_samp(v) FILTER (isfinite(v)), 6), -1) AS std FROM u GROUP BY model, metric""")
def finite_summary(spark, sf):
    from voxelcohort.plans.views import table
    rows = table(spark, sf, "lineitem").selectExpr(
        "l_suppkey % 7 as model", "if(l_linenumber = 7, double('NaN'), l_discount) as dice",
        "if(l_suppkey % 7 = 3, double('NaN'), l_tax) as auc")
    out = rounded(metrics.finite_summary(rows, ["dice", "auc"]), "mean", "std")
    return out.fillna(-1.0, ["mean", "std"])


SEED_SQL = """WITH r AS (SELECT l_suppkey % 20 AS seed, CASE WHEN l_returnflag = 'R' THEN 0 ELSE l_discount * 10 END AS dice FROM lineitem),
s AS (SELECT seed, count(*) AS n, avg(dice) AS mean, count(*) FILTER (dice = 0) AS zero_cases, quantile_cont(dice, 0.5) AS median FROM r GROUP BY seed)"""


def seed_rows(spark, sf):
    from voxelcohort.plans.views import table
    return table(spark, sf, "lineitem").selectExpr("l_suppkey % 20 as seed", "if(l_returnflag = 'R', 0D, l_discount * 10) as dice")


@query("seed_summary", SEED_SQL + " SELECT seed, n, round(mean, 6) AS mean, zero_cases, round(median, 6) AS median FROM s")
def seed_summary(spark, sf):
    return rounded(metrics.seed_summary(seed_rows(spark, sf)), "mean", "median")


@query("distribution_summary", SEED_SQL + """
SELECT count(*) AS n, round(avg(mean), 6) AS mean, round(stddev_samp(mean), 6) AS std, round(min(mean), 6) AS min, round(max(mean), 6) AS max,
  round(quantile_cont(mean, 0.025), 6) AS q025, round(quantile_cont(mean, 0.5), 6) AS median, round(quantile_cont(mean, 0.975), 6) AS q975 FROM s""")
def distribution_summary(spark, sf):
    out = metrics.distribution_summary(metrics.seed_summary(seed_rows(spark, sf)))
    return rounded(out, "mean", "std", "min", "max", "q025", "median", "q975")


@query("score_snapshot", cte("arms") + """
SELECT coalesce(CAST(fold AS VARCHAR), 'all') AS fold, count(*) AS cases, round(avg(a_dice), 6) AS mean,
  count(*) FILTER (a_dice = 0) AS zero_cases, count(*) FILTER (a_dice >= 0.5) AS good_cases FROM arms GROUP BY ROLLUP (fold)""")
def score_snapshot(spark, sf):
    score = F.col("a_dice")
    out = metrics.score_snapshot(settled_arms(spark, sf, F.least(F.abs(score), F.abs(score - 0.5)) <= 1e-6), "a_dice")
    return rounded(out, "mean").withColumn("fold", F.coalesce(F.col("fold").cast("string"), F.lit("all")))
