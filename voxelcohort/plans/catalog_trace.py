"""Ordered-event contract queries over the event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelcohort.operators import trace as contract
from voxelcohort.plans.registry import query
from voxelcohort.plans.views import table

EPOCHS = 3

# Events as a training trace; the same expressions run in both engines.
TRACE_COLUMNS = (
    "user_id AS run_id",
    "event_id AS seq",
    "event_id % 149 AS case_id",
    """CASE WHEN event_type = 'view' THEN CASE WHEN event_id % 3 = 0 THEN 'train_step' ELSE 'train_image_open' END
       WHEN event_type = 'click' THEN 'train_label_open'
       WHEN event_type = 'purchase' THEN CASE WHEN event_id % 2 = 0 THEN 'checkpoint_final_written' ELSE 'archive_receipt' END
       WHEN event_type = 'signup' THEN CASE event_id % 3 WHEN 0 THEN 'predictions_sealed' WHEN 1 THEN 'outer_inference_image_open' ELSE 'outer_evaluation_label_open' END
       ELSE 'prohibited' END AS type""",
    "CAST(CASE WHEN event_type IN ('view', 'purchase') THEN event_id % 4 + 1 END AS INT) AS epoch",
)

TRACE_SQL = f"""WITH tr AS (SELECT {', '.join(TRACE_COLUMNS)} FROM events),
ro AS (SELECT DISTINCT case_id, CASE WHEN case_id % 5 = 0 THEN 'val' ELSE 'train' END AS role FROM tr),
wn AS (SELECT count(*) FILTER (role = 'train') AS n_train, count(*) FILTER (role = 'val') AS n_outer FROM ro),
ms AS (SELECT run_id, min(seq) FILTER (type = 'checkpoint_final_written') AS ck, min(seq) FILTER (type = 'archive_receipt') AS ar, min(seq) FILTER (type = 'predictions_sealed') AS se FROM tr GROUP BY run_id),
rw AS (SELECT tr.*, role, ck, ar, se, concat(tr.run_id, '/', seq) AS key FROM tr JOIN ro ON ro.case_id = tr.case_id JOIN ms ON ms.run_id = tr.run_id),
sk AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS kk FROM rw WHERE type = 'train_step'),
rs AS (SELECT ms.run_id, ck, ar, se, n_train, n_outer,
  count(DISTINCT case_id) FILTER (type = 'train_label_open' AND role = 'train' AND seq < ck) AS labels,
  count(DISTINCT case_id) FILTER (type = 'outer_inference_image_open' AND role = 'val' AND seq < se) AS images,
  count(*) FILTER (type = 'train_step' AND seq < ck) AS steps
  FROM ms JOIN (SELECT run_id, case_id, type, seq, role FROM rw) t ON t.run_id = ms.run_id, wn GROUP BY ALL)"""

ROW_RULES_SQL = f"""
SELECT 'event_prohibited' AS "check", key, type AS detail FROM rw WHERE type = 'prohibited'
UNION ALL SELECT 'train_open_after_checkpoint', key, CAST(case_id AS VARCHAR) FROM rw WHERE type IN ('train_image_open', 'train_label_open') AND seq > ck
UNION ALL SELECT 'train_case_outside', key, CAST(case_id AS VARCHAR) FROM rw WHERE type IN ('train_image_open', 'train_label_open') AND role <> 'train'
UNION ALL SELECT 'step_after_checkpoint', key, CAST(epoch AS VARCHAR) FROM rw WHERE type = 'train_step' AND seq > ck
UNION ALL SELECT 'step_order', key, CAST(epoch AS VARCHAR) FROM sk WHERE epoch <> kk OR epoch > {EPOCHS}
UNION ALL SELECT 'checkpoint_repeated', key, '' FROM rw WHERE type = 'checkpoint_final_written' AND seq > ck
UNION ALL SELECT 'checkpoint_epoch', key, CAST(epoch AS VARCHAR) FROM rw WHERE type = 'checkpoint_final_written' AND epoch <> {EPOCHS}
UNION ALL SELECT 'archive_before_checkpoint', key, '' FROM rw WHERE type = 'archive_receipt' AND (ck IS NULL OR seq < ck)
UNION ALL SELECT 'archive_repeated', key, '' FROM rw WHERE type = 'archive_receipt' AND seq > ar
UNION ALL SELECT 'inference_before_archive', key, CAST(case_id AS VARCHAR) FROM rw WHERE type = 'outer_inference_image_open' AND (ck IS NULL OR seq < ck OR ar IS NULL OR seq < ar)
UNION ALL SELECT 'inference_after_seal', key, CAST(case_id AS VARCHAR) FROM rw WHERE type = 'outer_inference_image_open' AND seq > se
UNION ALL SELECT 'inference_case_outside', key, CAST(case_id AS VARCHAR) FROM rw WHERE type = 'outer_inference_image_open' AND role <> 'val'
UNION ALL SELECT 'seal_before_archive', key, '' FROM rw WHERE type = 'predictions_sealed' AND (ar IS NULL OR seq < ar)
UNION ALL SELECT 'seal_repeated', key, '' FROM rw WHERE type = 'predictions_sealed' AND seq > se
UNION ALL SELECT 'label_before_seal', key, CAST(case_id AS VARCHAR) FROM rw WHERE type = 'outer_evaluation_label_open' AND (se IS NULL OR seq < se)
UNION ALL SELECT 'label_case_outside', key, CAST(case_id AS VARCHAR) FROM rw WHERE type = 'outer_evaluation_label_open' AND role <> 'val'
UNION ALL SELECT 'checkpoint_incomplete', concat(run_id, '/', ck), concat(labels, '+', steps) FROM rs WHERE ck IS NOT NULL AND (labels < n_train OR steps <> {EPOCHS})
UNION ALL SELECT 'seal_incomplete', concat(run_id, '/', se), CAST(images AS VARCHAR) FROM rs WHERE se IS NOT NULL AND images < n_outer"""
MISSING_SQL = """
UNION ALL SELECT 'milestone_missing', CAST(run_id AS VARCHAR), 'checkpoint_final_written' FROM ms WHERE ck IS NULL
UNION ALL SELECT 'milestone_missing', CAST(run_id AS VARCHAR), 'archive_receipt' FROM ms WHERE ar IS NULL
UNION ALL SELECT 'milestone_missing', CAST(run_id AS VARCHAR), 'predictions_sealed' FROM ms WHERE se IS NULL"""


def trace_rows(events):
    return events.selectExpr(*TRACE_COLUMNS)


def roles_of(trace):
    return trace.select("case_id").distinct().withColumn("role", F.when(F.col("case_id") % 5 == 0, "val").otherwise("train"))


@query("trace_violations", TRACE_SQL + ROW_RULES_SQL + MISSING_SQL)
def trace_violations(spark, sf):
    rows = trace_rows(table(spark, sf, "events"))
    return contract.trace_violations(rows, roles_of(rows), EPOCHS)


@query("trace_inputs_violations", """
WITH r AS (SELECT o_custkey AS case_id, CASE WHEN o_orderstatus = 'P' THEN 'val' ELSE 'train' END AS role FROM orders),
p AS (SELECT case_id, count(DISTINCT role) AS n FROM r GROUP BY case_id)
SELECT 'case_in_both_roles' AS "check", CAST(case_id AS VARCHAR) AS key, '' AS detail FROM p WHERE n > 1
UNION ALL SELECT 'case_count', 'roles', CAST(count(*) AS VARCHAR) FROM p HAVING count(*) <> 149""")
def trace_inputs_violations(spark, sf):
    roles = table(spark, sf, "orders").selectExpr("o_custkey as case_id", "if(o_orderstatus = 'P', 'val', 'train') as role")
    return contract.trace_inputs_violations(roles, 149)
