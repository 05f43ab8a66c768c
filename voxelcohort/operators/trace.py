"""Ordered-event contract of a training run, in batch.

A run trains on its training cases only, writes one final checkpoint after every epoch
and every training label, archives it once, predicts held-out cases, seals the
predictions when all are present, and only then opens held-out labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelcohort.functions import spread_bucket, violations_of, violations_union, with_rank

# Fixed event names.
TRAIN_IMAGE, TRAIN_LABEL, STEP = "train_image_open", "train_label_open", "train_step"
CHECKPOINT, ARCHIVE, SEAL = "checkpoint_final_written", "archive_receipt", "predictions_sealed"
OUTER_IMAGE, OUTER_LABEL = "outer_inference_image_open", "outer_evaluation_label_open"
ALLOWED = (TRAIN_IMAGE, TRAIN_LABEL, STEP, CHECKPOINT, OUTER_IMAGE, SEAL, OUTER_LABEL, ARCHIVE)


def milestones(trace: DataFrame) -> DataFrame:
    """First position of each milestone per run (partial aggregation, one row a run)."""
    first = lambda t: F.min(F.when(F.col("type") == t, F.col("seq")))
    return trace.groupBy("run_id").agg(
        first(CHECKPOINT).alias("ckpt"), first(ARCHIVE).alias("arch"), first(SEAL).alias("seal")
    )


def trace_violations(trace: DataFrame, roles: DataFrame, epochs: int) -> DataFrame:
    """Every broken rule of ``(run_id, seq, type, case_id, epoch)``, not only the first.

    ``roles``: ``(case_id, role)`` with ``train`` or ``val``. No window runs over a whole run:
    milestones are minima joined back, epochs use bucketed ranks, and completeness counts
    distinct (run, case) pairs.
    """
    role = roles.select("case_id", "role").distinct()
    wanted = role.agg(F.count_if(F.col("role") == "train").alias("n_train"), F.count_if(F.col("role") == "val").alias("n_outer"))
    wanted = wanted.withColumn("_g", F.lit(0))
    marks = milestones(trace)
    rows = trace.join(role, "case_id", "left").join(marks, "run_id")
    t, seq = F.col("type"), F.col("seq")
    key = F.concat_ws("/", "run_id", "seq")
    case = F.col("case_id")
    before = lambda mark: F.col(mark).isNull() | (seq < F.col(mark))
    after = lambda mark: seq > F.col(mark)
    opens_train, none = t.isin(TRAIN_IMAGE, TRAIN_LABEL), F.lit("")
    is_role = lambda r: F.col("role").eqNullSafe(F.lit(r))
    row_rules = violations_of(rows, [
        (~t.isin(*ALLOWED), "event_prohibited", key, t),
        (opens_train & after("ckpt"), "train_open_after_checkpoint", key, case),
        (opens_train & ~is_role("train"), "train_case_outside", key, case),
        ((t == STEP) & after("ckpt"), "step_after_checkpoint", key, F.col("epoch")),
        ((t == CHECKPOINT) & after("ckpt"), "checkpoint_repeated", key, none),
        ((t == CHECKPOINT) & ~F.col("epoch").eqNullSafe(F.lit(epochs)), "checkpoint_epoch", key, F.col("epoch")),
        ((t == ARCHIVE) & before("ckpt"), "archive_before_checkpoint", key, none),
        ((t == ARCHIVE) & after("arch"), "archive_repeated", key, none),
        ((t == OUTER_IMAGE) & (before("ckpt") | before("arch")), "inference_before_archive", key, case),
        ((t == OUTER_IMAGE) & after("seal"), "inference_after_seal", key, case),
        ((t == OUTER_IMAGE) & ~is_role("val"), "inference_case_outside", key, case),
        ((t == SEAL) & before("arch"), "seal_before_archive", key, none),
        ((t == SEAL) & after("seal"), "seal_repeated", key, none),
        ((t == OUTER_LABEL) & before("seal"), "label_before_seal", key, case),
        ((t == OUTER_LABEL) & ~is_role("val"), "label_case_outside", key, case),
    ])
    steps = trace.where(t == STEP)
    steps = with_rank(steps, ["run_id"], ["seq"], spread_bucket(steps, "seq"), name="_k")
    step_rules = violations_of(steps, [
        (~F.col("epoch").eqNullSafe(F.col("_k").cast("int")) | (F.col("epoch") > epochs), "step_order", key, F.col("epoch")),
    ])
    seen = rows.where(
        ((t == TRAIN_LABEL) & is_role("train") & (seq < F.col("ckpt"))) | ((t == OUTER_IMAGE) & is_role("val") & (seq < F.col("seal")))
    ).groupBy("run_id", "type").agg(F.count_distinct("case_id").alias("n"))
    seen = seen.groupBy("run_id").agg(
        F.sum(F.when(t == TRAIN_LABEL, F.col("n"))).alias("labels_seen"), F.sum(F.when(t == OUTER_IMAGE, F.col("n"))).alias("images_seen")
    )
    done = rows.groupBy("run_id").agg(F.count_if((t == STEP) & (seq < F.col("ckpt"))).alias("steps"))
    runs = marks.join(seen, "run_id", "left").join(done, "run_id").withColumn("_g", F.lit(0))
    runs = runs.join(F.broadcast(wanted), "_g")  # wanted is one row
    run = F.col("run_id")
    labels, images = F.coalesce("labels_seen", F.lit(0)), F.coalesce("images_seen", F.lit(0))
    run_rules = violations_of(runs, [
        (F.col("ckpt").isNotNull() & ((labels < F.col("n_train")) | (F.col("steps") != epochs)), "checkpoint_incomplete",
         F.concat_ws("/", "run_id", "ckpt"), F.concat_ws("+", labels, "steps")),
        (F.col("seal").isNotNull() & (images < F.col("n_outer")), "seal_incomplete", F.concat_ws("/", "run_id", "seal"), images),
        (F.col("ckpt").isNull(), "milestone_missing", run, F.lit(CHECKPOINT)),
        (F.col("arch").isNull(), "milestone_missing", run, F.lit(ARCHIVE)),
        (F.col("seal").isNull(), "milestone_missing", run, F.lit(SEAL)),
    ])
    return violations_union([row_rules, step_rules, run_rules])


def trace_inputs_violations(roles: DataFrame, expected_cases: int | None = None) -> DataFrame:
    """Training and held-out ids must both exist and stay apart."""
    has = lambda r: F.bool_or(F.col("role") == r)
    per_case = roles.groupBy("case_id").agg(has("train").alias("t"), has("val").alias("v"))
    n = per_case.agg(F.count_if("t").alias("train"), F.count_if("v").alias("val"), F.count(F.lit(1)).alias("all"))
    rules = [
        (F.col("train") == 0, "no_training_case", F.lit("roles"), F.lit("")),
        (F.col("val") == 0, "no_held_out_case", F.lit("roles"), F.lit("")),
    ]
    if expected_cases is not None:
        rules.append((F.col("all") != expected_cases, "case_count", F.lit("roles"), F.col("all")))
    both = violations_of(per_case, [(F.col("t") & F.col("v"), "case_in_both_roles", F.col("case_id"), F.lit(""))])
    return violations_union([violations_of(n, rules), both])
