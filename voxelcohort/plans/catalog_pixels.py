"""Preprocessing, feature and normalisation queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelcohort.operators import features, preprocess, splits
from voxelcohort.plans.catalog_metrics import rounded
from voxelcohort.plans.catalog_splits import LONG_SQL, SEED, channel_voxels
from voxelcohort.plans.registry import query
from voxelcohort.plans.views import cte, view

IMG = cte("img2")
ROWW = 'PARTITION BY case_id, "row" ORDER BY col'
COLW = 'PARTITION BY case_id, col ORDER BY "row"'


def pixels_of(spark, sf):
    return view(spark, sf, "img2").select("case_id", "row", "col", "value")


MEDIAN_SQL = IMG + f""",
m1 AS (SELECT *, [coalesce(lag(value) OVER ({ROWW}), value), value, coalesce(lead(value) OVER ({ROWW}), value)] AS s FROM img2),
m2 AS (SELECT *, list_sort(list_concat(list_concat(coalesce(lag(s) OVER ({COLW}), s), s), coalesce(lead(s) OVER ({COLW}), s)))[5] AS med FROM m1),
med AS (SELECT case_id, "row", col, value > 0 AS brain, CASE WHEN value > 0 THEN med ELSE 0 END AS value, label FROM m2)"""


@query("median_filter", MEDIAN_SQL + ' SELECT case_id, "row", col, brain, round(value, 6) AS value FROM med')
def median_filter(spark, sf):
    return rounded(preprocess.median_filter(pixels_of(spark, sf)), "value")


RESCALE_SQL = MEDIAN_SQL + """,
rb AS (SELECT case_id, quantile_cont(value, 0.01) AS lo, quantile_cont(value, 0.99) AS hi FROM med WHERE brain GROUP BY case_id),
rs AS (SELECT m.case_id, "row", col, brain, CASE WHEN brain AND hi > lo THEN least(greatest((value - lo) / (hi - lo), 0), 1) * 255 ELSE 0 END AS value
  FROM med m LEFT JOIN rb ON rb.case_id = m.case_id)"""


@query("rescale_uint8", RESCALE_SQL + ' SELECT case_id, "row", col, brain, round(value, 6) AS value FROM rs')
def rescale_uint8(spark, sf):
    return rounded(preprocess.preprocess(pixels_of(spark, sf), "robust_uint8"), "value")


@query("zscore_brain", MEDIAN_SQL + """,
rb AS (SELECT case_id, avg(value) AS m, stddev_pop(value) AS s FROM med WHERE brain GROUP BY case_id)
SELECT med.case_id, "row", col, brain, round(CASE WHEN brain AND s > 0 THEN (value - m) / s ELSE 0 END, 6) + 0.0 AS value FROM med LEFT JOIN rb ON rb.case_id = med.case_id""")
def zscore_brain(spark, sf):
    return rounded(preprocess.preprocess(pixels_of(spark, sf), "zscore_brain"), "value")


@query("pick_slice_max_lesion", cte("vox3") + """,
a AS (SELECT case_id, z, count(*) FILTER (ref) AS area FROM vox3 GROUP BY ALL)
SELECT case_id, arg_min(z, (-area, z)) AS z FROM a GROUP BY case_id""")
def pick_slice_max_lesion(spark, sf):
    return preprocess.pick_slice(view(spark, sf, "vox3").selectExpr("case_id", "z", "ref as label"), "max_lesion")


@query("pick_slice_middle_brain", cte("vox3") + """,
a AS (SELECT case_id, list(DISTINCT z ORDER BY z) FILTER (isfinite(mtt) AND mtt > 9.5) AS zs, max(z) + 1 AS d FROM vox3 GROUP BY case_id)
SELECT case_id, coalesce(zs[len(zs) // 2 + 1], d // 2) AS z FROM a""")
def pick_slice_middle_brain(spark, sf):
    rows = view(spark, sf, "vox3").selectExpr("case_id", "z", "mtt - 9.5D as value")
    return preprocess.pick_slice(rows, "middle_brain")


MATCH_SQL = IMG + """,
s AS (SELECT case_id, "row", col, floor(value) AS value FROM img2),
sc AS (SELECT case_id, value, count(*) AS n FROM s GROUP BY ALL),
sq AS (SELECT case_id, value, sum(n) OVER (PARTITION BY case_id ORDER BY value) / sum(n) OVER (PARTITION BY case_id) AS q FROM sc),
rc AS (SELECT value, count(*) AS n FROM s WHERE case_id % 2 = 0 GROUP BY ALL),
rq AS (SELECT value, sum(n) OVER (ORDER BY value) / sum(n) OVER () AS q FROM rc),
m AS (SELECT sq.*, (SELECT max(q) FROM rq WHERE rq.q <= sq.q) AS qa, (SELECT min(q) FROM rq WHERE rq.q > sq.q) AS qb FROM sq),
mm AS (SELECT m.*, a.value AS va, b.value AS vb FROM m LEFT JOIN rq a ON a.q = qa LEFT JOIN rq b ON b.q = qb)
SELECT s.case_id, "row", col, s.value, round(CASE WHEN va IS NULL THEN vb WHEN vb IS NULL THEN va ELSE va + (vb - va) * (mm.q - qa) / (qb - qa) END, 6) AS matched
FROM s JOIN mm ON mm.case_id = s.case_id AND mm.value = s.value"""


@query("histogram_match", MATCH_SQL)
def histogram_match(spark, sf):
    source = pixels_of(spark, sf).withColumn("value", F.floor("value").cast("double"))
    return rounded(preprocess.histogram_match(source, source.where("case_id % 2 = 0").select("value")), "matched")


@query("reference_case", IMG + """,
m AS (SELECT case_id, quantile_cont(value, 0.5) AS med FROM img2 WHERE value > 0 AND case_id % 3 <> 0 GROUP BY case_id)
SELECT arg_min(case_id, (abs(med - (SELECT quantile_cont(med, 0.5) FROM m)), case_id)) AS case_id FROM m""")
def reference_case(spark, sf):
    pixels = pixels_of(spark, sf)
    return preprocess.reference_case(pixels, pixels.where("case_id % 3 <> 0"))


MEANS_SQL = """
b1 AS (SELECT *, {l} + value + {r} AS box, {l} + 2 * value + {r} AS bin FROM {source}),
b2 AS (SELECT *, ({lb} + box + {rb}) / 9 AS box_mean, ({ln} + 2 * bin + {rn}) / 16 AS binomial_mean FROM b1)"""


def means_sql(edge: str | None, source: str = "img2") -> str:
    e = lambda c: c if edge is None else edge
    pick = lambda f, c, w: f"coalesce({f}({c}) OVER ({w}), {e(c)})"
    return MEANS_SQL.format(
        source=source,
        l=pick("lag", "value", ROWW), r=pick("lead", "value", ROWW), lb=pick("lag", "box", COLW), rb=pick("lead", "box", COLW),
        ln=pick("lag", "bin", COLW), rn=pick("lead", "bin", COLW))


@query("box_mean_3x3", IMG + "," + means_sql(None) + ' SELECT case_id, "row", col, round(box_mean, 9) AS box_mean FROM b2')
def box_mean_3x3(spark, sf):
    return rounded(features.box_mean_3x3(pixels_of(spark, sf)), "box_mean", places=9).drop("value")


@query("binomial_mean_3x3", IMG + "," + means_sql("0") + ' SELECT case_id, "row", col, round(binomial_mean, 9) AS binomial_mean FROM b2')
def binomial_mean_3x3(spark, sf):
    return rounded(features.binomial_mean_3x3(pixels_of(spark, sf), "constant"), "binomial_mean", places=9).drop("value")


@query("coordinates", IMG + """,
e AS (SELECT case_id, max("row") AS rm, max(col) AS cm FROM img2 GROUP BY case_id)
SELECT i.case_id, "row", col, round("row" / rm, 6) AS row_coord, round(col / cm, 6) AS col_coord FROM img2 i JOIN e ON e.case_id = i.case_id""")
def coordinates(spark, sf):
    return rounded(features.coordinates(pixels_of(spark, sf), "normalized"), "row_coord", "col_coord").drop("value")


LINES = {"run_horizontal": ('"row"', "col"), "run_vertical": ("col", '"row"'), "run_45deg": ('col - "row"', '"row"'), "run_135deg": ('col + "row"', '"row"')}
THRESHOLD, WINDOW = 20.0, 7


def islands_sql(source: str = "img2", threshold=THRESHOLD, window=WINDOW) -> str:
    """Runs of every direction by gaps and islands: w(case_id, row, col, name, c, high, s, e)."""
    r = window // 2
    parts = " UNION ALL ".join(
        f"SELECT case_id, \"row\", col, '{n}' AS name, {line} AS line, {c} AS c, value >= {threshold} AS high FROM {source}"
        for n, (line, c) in LINES.items())
    return f"""w0 AS ({parts}),
wi AS (SELECT *, c - row_number() OVER (PARTITION BY case_id, name, line, high ORDER BY c) AS isl FROM w0),
w AS (SELECT *, min(c) OVER (PARTITION BY case_id, name, line, high, isl) AS s, max(c) OVER (PARTITION BY case_id, name, line, high, isl) AS e FROM wi),
centered AS (SELECT case_id, "row", col, name, CASE WHEN high THEN least(e, c + {r}) - greatest(s, c - {r}) + 1 ELSE 0 END AS v FROM w),
counted AS (SELECT case_id, "row", col, name, count(*) FILTER (high) OVER (PARTITION BY case_id, name, line ORDER BY c RANGE BETWEEN {r} PRECEDING AND {r} FOLLOWING) AS v FROM w),
longest AS (SELECT a.case_id, a."row", a.col, a.name, coalesce(max(CASE WHEN b.high THEN least(b.e, a.c + {r}) - greatest(b.s, a.c - {r}) + 1 END), 0) AS v
  FROM w a LEFT JOIN w b ON b.case_id = a.case_id AND b.name = a.name AND b.line = a.line AND b.high AND b.c BETWEEN a.c - {r} AND a.c + {r} GROUP BY ALL)"""


def wide_runs(source: str) -> str:
    cols = ", ".join(f"CAST(max(v) FILTER (name = '{n}') AS INTEGER) AS {n}" for n in LINES)
    return f'SELECT case_id, "row", col, {cols} FROM {source} GROUP BY ALL'


def _runs(mode):
    def run(spark, sf):
        out = pixels_of(spark, sf)
        for name, direction in features.DIRECTIONS.items():
            out = features.directional_run(out, direction, name, THRESHOLD, WINDOW, mode)
        return out.drop("value")
    return run


query("run_threshold_count", IMG + ", " + islands_sql() + " " + wide_runs("counted"))(_runs("threshold_count"))
query("run_centered", IMG + ", " + islands_sql() + " " + wide_runs("centered"))(_runs("centered_run"))
query("run_max", IMG + ", " + islands_sql() + " " + wide_runs("longest"))(_runs("max_run"))

NINE_SQL = IMG + "," + means_sql(None) + ", " + islands_sql("img2", 20.0, 25) + f""",
rw AS ({wide_runs("counted")})
SELECT b2.case_id, b2."row", b2.col, CAST(b2."row" AS DOUBLE) AS row_coord, CAST(b2.col AS DOUBLE) AS col_coord, round(value, 9) AS intensity,
  round(box_mean, 9) AS box_mean, round(binomial_mean, 9) AS binomial_mean, {", ".join(LINES)}
FROM b2 JOIN rw ON rw.case_id = b2.case_id AND rw."row" = b2."row" AND rw.col = b2.col"""


@query("nine_features", NINE_SQL)
def nine_features(spark, sf):
    return rounded(features.nine_features(pixels_of(spark, sf)), "intensity", "box_mean", "binomial_mean", places=9).drop("value")


PREPARED_SQL = MEDIAN_SQL + ", " + means_sql(None, "med") + ", " + islands_sql("med", 20.0, 25) + f""",
rw AS ({wide_runs("counted")})
SELECT b2.case_id, b2."row", b2.col, CAST(b2."row" AS DOUBLE) AS row_coord, CAST(b2.col AS DOUBLE) AS col_coord, round(value, 9) AS intensity,
  round(box_mean, 9) AS box_mean, round(binomial_mean, 9) AS binomial_mean, {", ".join(LINES)}, CAST(label AS INTEGER) AS label
FROM b2 JOIN rw ON rw.case_id = b2.case_id AND rw."row" = b2."row" AND rw.col = b2.col WHERE brain"""


@query("prepare_pixels", PREPARED_SQL)
def prepare_pixels(spark, sf):
    from voxelcohort.plans.classifier import prepare_pixels as prepare

    pixels = view(spark, sf, "img2").select("case_id", "row", "col", "value", "label")
    out = prepare(pixels).select("case_id", "row", "col", *features.FEATURE_NAMES, "label")
    return rounded(out, "intensity", "box_mean", "binomial_mean", places=9)


@query("feature_input_violations", cte("vox3") + """
SELECT 'pixel_not_finite' AS "check", concat(case_id, '/', z) AS key, CAST(count(*) FILTER (NOT isfinite(mtt)) AS VARCHAR) AS detail
FROM vox3 GROUP BY case_id, z HAVING count(*) FILTER (NOT isfinite(mtt)) > 0""")
def feature_input_violations(spark, sf):
    rows = view(spark, sf, "vox3").selectExpr("case_id", "z", "y as row", "x as col", "mtt as value")
    return features.feature_input_violations(rows, ("case_id", "z"))


# Per-fold normalisation over brain-tissue voxels; validation fold = case_id % 5.
FIT_SQL = LONG_SQL + """,
smp AS (SELECT case_id, channel, value, case_id % 5 AS vf FROM long WHERE base BETWEEN -100 AND 150 AND isfinite(value)),
ex AS (SELECT f.range AS fold, smp.* FROM smp JOIN range(5) f ON f.range <> vf),
par AS (SELECT fold, channel, quantile_cont(value, 0.005) AS clip_low, quantile_cont(value, 0.995) AS clip_high,
  CASE WHEN channel = 'ncct' THEN avg(value) ELSE quantile_cont(value, 0.5) END AS center,
  CASE WHEN channel = 'ncct' THEN stddev_pop(value) ELSE (quantile_cont(value, 0.75) - quantile_cont(value, 0.25)) / 1.349 END AS scale,
  count(*) AS n_samples FROM ex GROUP BY fold, channel)"""


def support_samples(spark, sf):
    return channel_voxels(spark, sf, extra=("ncct as base",)).where("base between -100 and 150")


def val_folds_of(spark, sf):
    return view(spark, sf, "vox3").select("case_id").distinct().select("case_id", (F.col("case_id") % 5).cast("int").alias("fold"))


@query("fit_normalization", FIT_SQL + """
SELECT CAST(fold AS INTEGER) AS fold, channel, round(clip_low, 6) AS clip_low, round(clip_high, 6) AS clip_high, round(center, 6) AS center, round(scale, 6) AS scale,
  n_cases, n_samples,
  CASE WHEN channel = 'ncct' THEN CAST(-1 AS DOUBLE) ELSE CAST(8 AS DOUBLE) END AS z_cap
FROM par JOIN (SELECT f.range AS f, count(DISTINCT case_id) AS n_cases FROM vox3 JOIN range(5) f ON case_id % 5 <> f.range GROUP BY 1) nc ON nc.f = par.fold""")
def fit_normalization(spark, sf):
    out = preprocess.fit_normalization(support_samples(spark, sf), val_folds_of(spark, sf))
    return rounded(out, "clip_low", "clip_high", "center", "scale").fillna(-1.0, ["z_cap"])


@query("fit_normalization_sketch")
def fit_normalization_sketch(spark, sf):
    return preprocess.fit_normalization_sketch(support_samples(spark, sf), val_folds_of(spark, sf))


NORM_SQL = FIT_SQL + """,
nz AS (SELECT l.case_id, l.channel, z, y, x, isfinite(value) AS was_finite, base BETWEEN -100 AND 150 AS support, par.fold,
  (least(greatest(CASE WHEN isfinite(value) THEN value ELSE center END, clip_low), clip_high) - center) / scale AS zz
  FROM long l JOIN par ON par.channel = l.channel AND par.fold = l.case_id % 5),
nv AS (SELECT *, CASE WHEN NOT support THEN 0 WHEN channel = 'ncct' THEN zz ELSE least(greatest(zz, -8), 8) END AS value FROM nz)"""


def normalized(spark, sf):
    params = preprocess.fit_normalization(support_samples(spark, sf), val_folds_of(spark, sf))
    voxels = channel_voxels(spark, sf, extra=("ncct as base", "cast(case_id % 5 as int) as fold")).withColumn(
        "support", F.col("base").between(-100, 150)).drop("base")
    return preprocess.apply_normalization(voxels, params)


@query("apply_normalization", NORM_SQL + """
SELECT case_id, channel, z, y, x, CAST(fold AS INTEGER) AS fold, support, was_finite, round(value, 6) + 0.0 AS value FROM nv""")
def apply_normalization(spark, sf):
    return rounded(normalized(spark, sf), "value")


@query("normalization_audit", NORM_SQL + """
SELECT CAST(fold AS INTEGER) AS fold, channel, count(*) FILTER (NOT was_finite) AS nonfinite_in,
  count(*) FILTER (channel <> 'ncct' AND abs(value) > 8.000001) AS over_cap_out, count(*) FILTER (NOT isfinite(value)) AS nonfinite_out FROM nv GROUP BY ALL""")
def normalization_audit(spark, sf):
    return preprocess.normalization_audit(normalized(spark, sf))


@query("fit_violations", FIT_SQL + """
SELECT 'case_without_samples' AS "check", concat(c.case_id, '/', ch.channel) AS key, '' AS detail
FROM (SELECT DISTINCT case_id FROM vox3) c, (SELECT DISTINCT channel FROM long) ch WHERE c.case_id % 7 = 2 AND c.case_id % 9 <> 1
UNION ALL SELECT 'case_not_in_folds', concat(case_id, '/', channel), '' FROM (SELECT DISTINCT case_id, channel FROM smp)
WHERE case_id % 7 <> 2 AND case_id % 9 = 1""")
def fit_violations(spark, sf):
    samples = support_samples(spark, sf).where("case_id % 7 <> 2")
    folds = val_folds_of(spark, sf).where("case_id % 9 <> 1")
    params = preprocess.fit_normalization(samples, folds)
    return preprocess.fit_violations(samples, folds, params, ["ncct", "tmax", "cbf", "cbv", "mtt"])


@query("normalization_from_sample", LONG_SQL + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, channel ORDER BY md5(concat_ws('|', case_id, channel, z, y, x, '{SEED}')), z, y, x) AS p
  FROM long WHERE base BETWEEN -100 AND 150 AND isfinite(value)),
ex AS (SELECT f.range AS fold, channel, value FROM r JOIN range(5) f ON f.range <> case_id % 5 WHERE p <= 4096)
SELECT CAST(fold AS INTEGER) AS fold, channel, round(CASE WHEN channel = 'ncct' THEN avg(value) ELSE quantile_cont(value, 0.5) END, 6) AS center, count(*) AS n_samples FROM ex GROUP BY fold, channel""")
def normalization_from_sample(spark, sf):
    sample = splits.support_sample(support_samples(spark, sf), seed=SEED)
    return rounded(preprocess.fit_normalization(sample, val_folds_of(spark, sf)).select("fold", "channel", "center", "n_samples"), "center")
