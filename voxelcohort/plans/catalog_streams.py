"""Streaming and composed-job queries over the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelcohort.operators import incremental
from voxelcohort.plans import calibration
from voxelcohort.plans.catalog_masks import HEAD_SQL
from voxelcohort.plans.catalog_metrics import EVAL_SQL, VOLUME_SQL, VOLUMES, case_headers, masks_of, rounded
from voxelcohort.plans.catalog_pixels import val_folds_of
from voxelcohort.plans.catalog_splits import SEED, channel_voxels
from voxelcohort.plans.catalog_trace import EPOCHS, MISSING_SQL, ROW_RULES_SQL, TRACE_COLUMNS, TRACE_SQL, roles_of, trace_rows
from voxelcohort.plans.registry import query
from voxelcohort.plans.views import table
from voxelcohort.session import scratch_path
from voxelcohort.streaming.evaluate_stream import current_rows, evaluate_new_cases_stream
from voxelcohort.streaming.trace_state import violations_so_far, watch_trace_stream
from voxelcohort.streaming.trace_stream import judge_trace_stream, latest_violations


@query("trace_violations_stream", TRACE_SQL + ROW_RULES_SQL + MISSING_SQL)
def trace_violations_stream_query(spark, sf):
    """The whole event table in four arrivals that ignore event order, so most events of a run arrive late."""
    events = trace_rows(table(spark, sf, "events"))
    incoming, path, state = (scratch_path(spark, f"trace-{name}") for name in ("incoming", "judged", "state"))
    events.repartition(4, F.md5(F.concat_ws("|", "run_id", "seq"))).write.parquet(incoming)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    judge_trace_stream(stream, roles_of(events), EPOCHS, path, state).awaitTermination()
    return latest_violations(spark, path)


# Events of the first half that are delivered last, behind the watermark.
LATE = "event_id % 97 = 5 AND 2 * event_id < (SELECT max(event_id) FROM events)"


@query("trace_violations_state", TRACE_SQL.replace("FROM events)", f"FROM events WHERE NOT ({LATE}))", 1) + ROW_RULES_SQL + MISSING_SQL + f"""
UNION ALL SELECT 'late_event', concat(user_id, '/', event_id), {TRACE_COLUMNS[3].rsplit(" AS ", 1)[0]} FROM events WHERE {LATE}""")
def trace_violations_state_query(spark, sf):
    """The event table in five arrivals that overlap in time, a sixth with late events, then a mark that time has passed."""
    events = table(spark, sf, "events")
    last = events.agg(F.max("event_id")).first()[0]
    rows = events.selectExpr(*TRACE_COLUMNS, "timestamp_seconds(event_id * 60) as ts", f"event_id % 97 = 5 and 2 * event_id < {last} as late")
    incoming, path, state = (scratch_path(spark, f"trace-{name}") for name in ("incoming", "found", "state"))
    part = F.least(F.floor((F.col("seq") + F.pmod(F.xxhash64("seq"), F.lit(40))) * 5 / (last + 1)), F.lit(4))
    for k in range(5):
        rows.where(~F.col("late") & (part == k)).drop("late").repartition(1).write.mode("append").parquet(incoming)
    rows.where("late").drop("late").repartition(1).write.mode("append").parquet(incoming)
    passed_at = max(2_000_000_000, last * 60 + 4_000 * 86_400)  # silent for longer than idle, however many events there are
    passed = rows.drop("late").limit(1).selectExpr("cast(null as long) as run_id", *rows.columns[1:-2], f"timestamp_seconds({passed_at}) as ts")
    passed.coalesce(1).write.mode("append").parquet(incoming)
    stream = spark.readStream.schema(passed.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    roles = roles_of(rows.where("not late"))
    watch_trace_stream(stream, roles, EPOCHS, path, state, delay="1 hour", idle="3650 days").awaitTermination()
    return violations_so_far(spark, path)


@query("evaluate_new_cases_stream", EVAL_SQL + f"""
SELECT case_id, fold, round(dice, 6) AS dice, round(lesion_f1, 6) AS lesion_f1, ref_lesions, pred_lesions, lesion_count_difference, {VOLUME_SQL},
  ref_lesions AS reference_lesion_count, CAST(4 AS DOUBLE) * (1 + case_id % 7) / 1000 AS voxel_volume_ml FROM ev""")
def evaluate_new_cases_stream_query(spark, sf):
    _, ref, pred, cases = masks_of(spark, sf)
    incoming, out = scratch_path(spark, "incoming"), scratch_path(spark, "evaluated")
    delivered = cases.join(pred, "case_id", "left")  # a null voxel row delivers an empty mask
    delivered.repartition("case_id").write.parquet(incoming)
    evaluate_new_cases_stream(spark, incoming, ref, case_headers(spark, sf), out, scratch_path(spark, "eval-state")).awaitTermination()
    return rounded(current_rows(spark, out).drop("signature", "schema", "status", "batch"), "dice", "lesion_f1", *VOLUMES)


@query("evaluate_stale", EVAL_SQL + f"""
SELECT case_id, fold, round(dice, 6) AS dice, round(lesion_f1, 6) AS lesion_f1, ref_lesions, pred_lesions, lesion_count_difference, {VOLUME_SQL},
  ref_lesions AS reference_lesion_count, CAST(4 AS DOUBLE) * (1 + case_id % 7) / 1000 AS voxel_volume_ml FROM ev WHERE case_id % 4 = 1""")
def evaluate_stale(spark, sf):
    voxels, ref, pred, _ = masks_of(spark, sf)
    current = incremental.input_signature(voxels.selectExpr("case_id", "k as name", "cast(pred as int) as size", "'' as mtime"))
    saved = current.select("case_id", F.expr("if(case_id % 4 = 1, 'old', signature)").alias("signature"), F.lit("v1").alias("schema"), F.lit("complete").alias("status"))
    rows = calibration.evaluate_stale(current, saved, ref, pred, case_headers(spark, sf), "v1")
    return rounded(rows.drop("signature", "schema", "status"), "dice", "lesion_f1", *VOLUMES)


@query("calibrate", HEAD_SQL + f""",
long AS (SELECT case_id, z, y, x, 'ncct' AS channel, ncct AS value FROM support UNION ALL SELECT case_id, z, y, x, 'tmax', tmax FROM support
  UNION ALL SELECT case_id, z, y, x, 'cbf', cbf FROM support UNION ALL SELECT case_id, z, y, x, 'cbv', cbv FROM support UNION ALL SELECT case_id, z, y, x, 'mtt', mtt FROM support),
r AS (SELECT *, row_number() OVER (PARTITION BY case_id, channel ORDER BY md5(concat_ws('|', case_id, channel, z, y, x, '{SEED}')), z, y, x) AS p FROM long WHERE isfinite(value)),
ex AS (SELECT f.range AS fold, channel, value FROM r JOIN range(5) f ON f.range <> case_id % 5 WHERE p <= 4096)
SELECT CAST(fold AS INTEGER) AS fold, channel, round(quantile_cont(value, 0.005), 6) AS clip_low, round(quantile_cont(value, 0.995), 6) AS clip_high,
  round(CASE WHEN channel = 'ncct' THEN avg(value) ELSE quantile_cont(value, 0.5) END, 6) AS center, count(*) AS n_samples FROM ex GROUP BY fold, channel""")
def calibrate(spark, sf):
    made = calibration.calibrate(channel_voxels(spark, sf), val_folds_of(spark, sf), seed=SEED)
    out = made["params"].select("fold", "channel", "clip_low", "clip_high", "center", "n_samples")
    return rounded(out, "clip_low", "clip_high", "center")
