"""Resampling and paired-comparison queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelcohort.operators import statistics as st
from voxelcohort.plans.catalog_metrics import rounded
from voxelcohort.plans.registry import query
from voxelcohort.plans.views import cte, settled_arms, table, view

SEED = 2026
METRICS = ("dice", "avd")
BOOT, FLIPS = 20_000, 100_000

DELTAS_SQL = cte("arms") + """,
d AS (SELECT case_id, fold, reference_volume_ml, a_dice, b_dice, a_avd, b_avd, b_dice - a_dice AS dice, b_avd - a_avd AS avd FROM arms)"""
BOOT_SQL = f"""
num AS (SELECT *, row_number() OVER (ORDER BY case_id) - 1 AS i, count(*) OVER () AS n FROM d),
dr AS (SELECT r.range AS rep, CAST(('0x' || substr(md5(concat_ws('|', r.range, i, '{SEED}')), 1, 12)) AS BIGINT) % n AS i FROM num, range({BOOT}) r),
bm AS (SELECT rep, avg(dice) AS dice, avg(avd) AS avd FROM dr JOIN num ON num.i = dr.i GROUP BY rep),
ci AS (SELECT 'dice' AS metric, quantile_cont(dice, 0.025) AS ci_low, quantile_cont(dice, 0.975) AS ci_high FROM bm
  UNION ALL SELECT 'avd', quantile_cont(avd, 0.025), quantile_cont(avd, 0.975) FROM bm)"""


# The same keyed weights: a weight counts the bounds at or below 16 bits of md5(block|case|seed), eight a hash.
POISSON_SQL = f"""
ph AS (SELECT d.*, r.range AS blk, md5(concat_ws('|', r.range, case_id, '{SEED}')) AS m FROM d, range({BOOT // 8}) r),
pu AS (SELECT blk * 8 + j.range AS rep, dice, avd, CAST(('0x' || substr(m, 4 * j.range + 1, 4)) AS INTEGER) AS u FROM ph, range(8) j),
pw AS (SELECT rep, dice, avd, {' + '.join(f'(u >= {b})::INT' for b in st.POISSON_BOUNDS)} AS w FROM pu),
pm AS (SELECT rep, sum(w * dice) / sum(w) AS dice, sum(w * avd) / sum(w) AS avd FROM pw GROUP BY rep HAVING sum(w) > 0),
ci AS (SELECT 'dice' AS metric, quantile_cont(dice, 0.025) AS ci_low, quantile_cont(dice, 0.975) AS ci_high FROM pm
  UNION ALL SELECT 'avd', quantile_cont(avd, 0.025), quantile_cont(avd, 0.975) FROM pm)"""


def flip_sql(seed: int) -> str:
    return f"""
fh AS (SELECT d.*, r.range AS blk, md5(concat_ws('|', r.range, case_id, '{seed}')) AS m FROM d, range({-(-FLIPS // 128)}) r),
fs AS (SELECT blk * 128 + j.range AS rep, dice, avd,
  1 - 2 * (((strpos('0123456789abcdef', substr(m, CAST(j.range // 4 + 1 AS BIGINT), 1)) - 1) >> CAST(3 - j.range % 4 AS BIGINT)) & 1) AS s FROM fh, range(128) j),
fl AS (SELECT rep, abs(avg(s * dice)) AS dice, abs(avg(s * avd)) AS avd FROM fs WHERE rep < {FLIPS} GROUP BY 1),""" + P_SQL


def flip_each_sql(seed: int) -> str:
    return f"""
fl AS (SELECT r.range AS rep, abs(avg(s * dice)) AS dice, abs(avg(s * avd)) AS avd FROM (
  SELECT d.*, CASE WHEN substr(md5(concat_ws('|', r.range, case_id, '{seed}')), 1, 1) < '8' THEN 1 ELSE -1 END AS s, r.range FROM d, range({FLIPS}) r) r GROUP BY 1),""" + P_SQL


P_SQL = f"""
pv AS (SELECT 'dice' AS metric, (count(*) FILTER (dice >= (SELECT abs(avg(dice)) FROM d) - 1e-12) + 1) / CAST({FLIPS + 1} AS DOUBLE) AS p FROM fl
  UNION ALL SELECT 'avd', (count(*) FILTER (avd >= (SELECT abs(avg(avd)) FROM d) - 1e-12) + 1) / CAST({FLIPS + 1} AS DOUBLE) FROM fl),
holm AS (SELECT metric, p, least(1.0, max(step) OVER (ORDER BY p, metric ROWS UNBOUNDED PRECEDING)) AS holm_p
  FROM (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, metric) + 1) * p AS step FROM pv))"""


def deltas(spark, sf):
    return view(spark, sf, "arms").selectExpr("case_id", "b_dice - a_dice as dice", "b_avd - a_avd as avd")


def arm(spark, sf, side, arms=None):
    return (view(spark, sf, "arms") if arms is None else arms).selectExpr(
        "case_id", "fold", "reference_volume_ml", "double(0.008) as voxel_volume_ml", "case_id % 9 as reference_lesion_count",
        f"{side}_dice as dice", f"{side}_avd as avd")


def pairs_of(spark, sf, arms=None):
    return st.pair_arms(arm(spark, sf, "a", arms), arm(spark, sf, "b", arms), METRICS)[0]


@query("bootstrap_mean_ci", DELTAS_SQL + "," + BOOT_SQL + " SELECT metric, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM ci")
def bootstrap_mean_ci(spark, sf):
    return rounded(st.bootstrap_mean_ci(deltas(spark, sf), METRICS, reps=BOOT, seed=SEED), "ci_low", "ci_high")


@query("poisson_mean_ci", DELTAS_SQL + "," + POISSON_SQL + " SELECT metric, round(ci_low, 6) AS ci_low, round(ci_high, 6) AS ci_high FROM ci")
def poisson_mean_ci(spark, sf):
    return rounded(st.poisson_mean_ci(deltas(spark, sf), METRICS, reps=BOOT, seed=SEED), "ci_low", "ci_high")


@query("sign_flip_p", DELTAS_SQL + "," + flip_sql(SEED) + " SELECT metric, round(p, 6) AS p FROM pv")
def sign_flip_p(spark, sf):
    return rounded(st.sign_flip_p(deltas(spark, sf), METRICS, reps=FLIPS, seed=SEED), "p")


@query("holm_adjust", """
WITH e AS (SELECT o_orderpriority AS metric, avg(o_totalprice) / 4000000 AS p FROM orders GROUP BY 1),
s AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, metric) + 1) * p AS step FROM e)
SELECT metric, round(p, 6) AS p, round(least(1.0, max(step) OVER (ORDER BY p, metric ROWS UNBOUNDED PRECEDING)), 6) AS holm_p FROM s""")
def holm_adjust(spark, sf):
    p = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("metric")).agg((F.avg("o_totalprice") / 4000000).alias("p"))
    return rounded(st.holm_adjust(p), "p", "holm_p")


@query("pair_arms", DELTAS_SQL + """
SELECT case_id, fold, round(reference_volume_ml, 6) AS reference_volume_ml, round(a_dice, 6) AS a_dice, round(b_dice, 6) AS b_dice,
  round(a_avd, 6) AS a_avd, round(b_avd, 6) AS b_avd, round(dice, 6) + 0.0 AS delta_dice, round(avd, 6) + 0.0 AS delta_avd FROM d""")
def pair_arms(spark, sf):
    return rounded(pairs_of(spark, sf), "reference_volume_ml", "a_dice", "b_dice", "a_avd", "b_avd", "delta_dice", "delta_avd")


@query("pair_arms_violations", cte("arms") + """,
fs AS (SELECT CASE WHEN case_id % 23 = 0 THEN -1 ELSE fold END AS fold, count(*) AS n FROM arms WHERE case_id % 31 <> 3 AND case_id % 37 <> 5 GROUP BY 1)
SELECT 'missing_in_right' AS "check", CAST(case_id AS VARCHAR) AS key, '' AS detail FROM arms WHERE case_id % 31 = 3 AND case_id % 37 <> 5
UNION ALL SELECT 'missing_in_left', CAST(case_id AS VARCHAR), '' FROM arms WHERE case_id % 37 = 5 AND case_id % 31 <> 3
UNION ALL SELECT 'fold', CAST(case_id AS VARCHAR), '' FROM arms WHERE case_id % 31 <> 3 AND case_id % 37 <> 5 AND case_id % 23 = 0
UNION ALL SELECT 'reference_volume_ml', CAST(case_id AS VARCHAR), '' FROM arms WHERE case_id % 31 <> 3 AND case_id % 37 <> 5 AND case_id % 19 = 1
UNION ALL SELECT 'reference_lesion_count', CAST(case_id AS VARCHAR), '' FROM arms WHERE case_id % 31 <> 3 AND case_id % 37 <> 5 AND case_id % 17 = 2
UNION ALL SELECT 'not_finite', CAST(case_id AS VARCHAR), 'dice' FROM arms WHERE case_id % 31 <> 3 AND case_id % 37 <> 5 AND case_id % 13 = 4
UNION ALL SELECT 'score_range', CAST(case_id AS VARCHAR), 'dice' FROM arms WHERE case_id % 31 <> 3 AND case_id % 37 <> 5 AND case_id % 13 <> 4 AND case_id % 11 = 6
UNION ALL SELECT 'negative_error', CAST(case_id AS VARCHAR), 'avd' FROM arms WHERE case_id % 31 <> 3 AND case_id % 37 <> 5 AND case_id % 29 = 7
UNION ALL SELECT 'fold_size', CAST(fold AS VARCHAR), CAST(n AS VARCHAR) FROM fs WHERE fold < 0 OR n <> 18""")
def pair_arms_violations(spark, sf):
    left = arm(spark, sf, "a").where("case_id % 37 <> 5").withColumn("fold", F.expr("if(case_id % 23 = 0, -1, fold)"))
    right = (
        arm(spark, sf, "b").where("case_id % 31 <> 3")
        .withColumn("reference_volume_ml", F.expr("if(case_id % 19 = 1, reference_volume_ml + 1, reference_volume_ml)"))
        .withColumn("reference_lesion_count", F.expr("if(case_id % 17 = 2, -1, reference_lesion_count)"))
        .withColumn("dice", F.expr("case when case_id % 13 = 4 then double('NaN') when case_id % 11 = 6 then 1.5D else dice end"))
        .withColumn("avd", F.expr("if(case_id % 29 = 7, -1D, avd)"))
    )
    return st.pair_arms(left, right, METRICS, {f: 18 for f in range(5)})[1]


PAIRED_SQL = DELTAS_SQL + "," + BOOT_SQL + "," + flip_each_sql(SEED + 100) + """,
l AS (SELECT 'dice' AS metric, a_dice AS a, b_dice AS b, dice AS delta FROM d UNION ALL SELECT 'avd', a_avd, b_avd, avd FROM d),
ps AS (SELECT l.metric, count(*) AS n, avg(a) AS a_mean, avg(b) AS b_mean, avg(delta) AS delta_mean, avg(delta) / stddev_samp(delta) AS cohens_dz,
  quantile_cont(delta, 0.25) AS delta_q1, quantile_cont(delta, 0.5) AS delta_median, quantile_cont(delta, 0.75) AS delta_q3 FROM l GROUP BY l.metric),
paired AS (SELECT ps.*, ci_low, ci_high, p, holm_p FROM ps JOIN ci ON ci.metric = ps.metric JOIN holm ON holm.metric = ps.metric)"""
PAIRED_COLS = ("a_mean", "b_mean", "delta_mean", "cohens_dz", "delta_q1", "delta_median", "delta_q3", "ci_low", "ci_high", "p", "holm_p")


def paired(spark, sf):
    return st.paired_summary(pairs_of(spark, sf), METRICS, BOOT, FLIPS, SEED)


@query("paired_summary", PAIRED_SQL + " SELECT metric, n, " + ", ".join(f"round({c}, 6) AS {c}" for c in PAIRED_COLS) + " FROM paired")
def paired_summary(spark, sf):
    return rounded(paired(spark, sf), *PAIRED_COLS)


@query("report_lines", PAIRED_SQL + """
SELECT CASE metric WHEN 'dice' THEN 1 ELSE 2 END AS line_no, printf('| %s | %.5f | %.5f | %+.5f | [%+.5f, %+.5f] | %.5f | %.5f |',
  CASE metric WHEN 'dice' THEN 'Dice' ELSE 'Absolute volume difference (mL)' END, a_mean, b_mean, delta_mean, ci_low, ci_high, p, holm_p) AS line FROM paired""")
def report_lines(spark, sf):
    return st.report_lines(paired(spark, sf), {"dice": "Dice", "avd": "Absolute volume difference (mL)"})


@query("win_loss", DELTAS_SQL + """
SELECT 'dice' AS metric, count(*) FILTER (dice > 0) AS improved, count(*) FILTER (dice < 0) AS worsened, count(*) FILTER (abs(dice) <= 1e-12) AS unchanged FROM d
UNION ALL SELECT 'avd', count(*) FILTER (avd < 0), count(*) FILTER (avd > 0), count(*) FILTER (abs(avd) <= 1e-12) FROM d""")
def win_loss(spark, sf):
    arms = settled_arms(spark, sf, F.least(*[F.abs(F.col(f"b_{m}") - F.col(f"a_{m}")) for m in METRICS]) <= 1e-6)
    return st.win_loss(pairs_of(spark, sf, arms), {"dice": "higher", "avd": "lower"})


QUARTILE_SQL = DELTAS_SQL + """,
q AS (SELECT quantile_cont(reference_volume_ml, 0.25) AS q25, quantile_cont(reference_volume_ml, 0.5) AS q50, quantile_cont(reference_volume_ml, 0.75) AS q75 FROM d),
b AS (SELECT d.*, CASE WHEN reference_volume_ml <= q25 THEN 1 WHEN reference_volume_ml <= q50 THEN 2 WHEN reference_volume_ml <= q75 THEN 3 ELSE 4 END AS quartile FROM d, q),
u AS (SELECT 'dice' AS metric, quartile, reference_volume_ml AS v, a_dice AS a, b_dice AS b, dice AS x FROM b UNION ALL SELECT 'avd', quartile, reference_volume_ml, a_avd, b_avd, avd FROM b)
SELECT metric, quartile, count(*) AS n, round(avg(v), 6) AS mean_reference_volume_ml, round(avg(a), 6) AS a_mean, round(avg(b), 6) AS b_mean, round(avg(x), 6) AS delta_mean FROM u GROUP BY ALL"""


@query("volume_quartiles", QUARTILE_SQL)
def volume_quartiles(spark, sf):
    out = st.volume_quartiles(pairs_of(spark, sf), METRICS)
    return rounded(out, "mean_reference_volume_ml", "a_mean", "b_mean", "delta_mean")


LOFO_SQL = DELTAS_SQL + """,
u AS (SELECT 'dice' AS metric, fold, a_dice AS a, b_dice AS b, dice AS x FROM d UNION ALL SELECT 'avd', fold, a_avd, b_avd, avd FROM d),
f AS (SELECT DISTINCT fold FROM d)"""


@query("leave_one_fold_out", LOFO_SQL + """
SELECT metric, f.fold, count(*) AS n, round(avg(x), 6) AS delta_mean FROM f JOIN u ON u.fold <> f.fold GROUP BY ALL""")
def leave_one_fold_out(spark, sf):
    return rounded(st.leave_one_fold_out(pairs_of(spark, sf), METRICS), "delta_mean")


@query("fold_means", LOFO_SQL + """
SELECT metric, fold, count(*) AS n, round(avg(a), 6) AS a_mean, round(avg(b), 6) AS b_mean FROM u GROUP BY ALL""")
def fold_means(spark, sf):
    return rounded(st.fold_means(pairs_of(spark, sf), METRICS), "a_mean", "b_mean")


@query("sensitivity_lines", LOFO_SQL + """
SELECT metric, CAST(f.fold AS INTEGER) AS line_no, printf('| %s | %d | %d | %+.5f |', metric, f.fold, count(*), avg(x)) AS line
FROM f JOIN u ON u.fold <> f.fold GROUP BY metric, f.fold""")
def sensitivity_lines(spark, sf):
    return st.sensitivity_lines(st.leave_one_fold_out(pairs_of(spark, sf), METRICS), "fold")
