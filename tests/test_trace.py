"""Ordered-event contract: tampering in batch, and stream replay equal to batch."""

import pytest
from conftest import checks
from pyspark.sql import functions as F

from voxelcohort.operators import trace as contract
from voxelcohort.session import scratch_path
from voxelcohort.streaming.trace_state import SHARDS, violations_so_far, watch_trace_stream
from voxelcohort.streaming.trace_stream import judge_trace_stream, latest_violations

EPOCHS, TRAIN, OUTER = 5, list(range(8)), list(range(100, 103))
SCHEMA = "run_id long, seq long, type string, case_id long, epoch int"


def good():
    events = [(contract.TRAIN_LABEL, c, None) for c in TRAIN] + [(contract.STEP, None, e) for e in range(1, EPOCHS + 1)]
    events += [(contract.CHECKPOINT, None, EPOCHS), (contract.ARCHIVE, None, None)]
    events += [(contract.OUTER_IMAGE, c, None) for c in OUTER] + [(contract.SEAL, None, None)]
    return events + [(contract.OUTER_LABEL, c, None) for c in OUTER]


def frame(spark, runs):
    rows = [(run, i, *e) for run, events in runs.items() for i, e in enumerate(events)]
    return spark.createDataFrame(rows, SCHEMA)


def roles(spark):
    return spark.createDataFrame([(c, "train") for c in TRAIN] + [(c, "val") for c in OUTER], "case_id long, role string")


def swap(events, a, b):
    events = list(events)
    events[a], events[b] = events[b], events[a]
    return events


N = len(TRAIN)
CK = N + EPOCHS
TAMPERINGS = {
    "outside_case": (lambda e: [(contract.TRAIN_LABEL, OUTER[0], None)] + e, {"train_case_outside"}),
    "skipped_epoch": (lambda e: e[: N + 1] + e[N + 2:], {"step_order", "checkpoint_incomplete"}),
    "missing_label": (lambda e: e[1:], {"checkpoint_incomplete"}),
    "late_training": (lambda e: e[: CK + 1] + [(contract.TRAIN_IMAGE, 1, None)] + e[CK + 1:], {"train_open_after_checkpoint"}),
    "second_checkpoint": (lambda e: e[: CK + 1] + [e[CK]] + e[CK + 1:], {"checkpoint_repeated"}),
    "archive_first": (lambda e: swap(e, CK, CK + 1), {"archive_before_checkpoint"}),
    "early_inference": (lambda e: swap(e, CK + 1, CK + 2), {"inference_before_archive"}),
    "early_label": (lambda e: e[: CK + 5] + [(contract.OUTER_LABEL, OUTER[0], None)] + e[CK + 5:], {"label_before_seal"}),
    "incomplete_seal": (lambda e: e[: CK + 2] + e[CK + 3:], {"seal_incomplete"}),
    "no_seal": (lambda e: [x for x in e if x[0] not in (contract.SEAL, contract.OUTER_LABEL)], {"milestone_missing"}),
    "prohibited": (lambda e: e + [("network_open", None, None)], {"event_prohibited"}),
    "wrong_final_epoch": (lambda e: e[:CK] + [(contract.CHECKPOINT, None, 3)] + e[CK + 1:], {"checkpoint_epoch"}),
}


def test_each_tampering_breaks_its_own_rules(spark):
    runs = {0: good(), **{i + 1: f(good()) for i, (f, _) in enumerate(TAMPERINGS.values())}}
    found = contract.trace_violations(frame(spark, runs).repartition(7), roles(spark), EPOCHS).collect()
    by_run = {}
    for r in found:
        by_run.setdefault(int(r["key"].split("/")[0]), set()).add(r["check"])
    assert 0 not in by_run
    for i, (name, (_, want)) in enumerate(TAMPERINGS.items()):
        assert by_run[i + 1] == want, name


def test_role_checks(spark):
    bad = roles(spark).unionByName(spark.createDataFrame([(0, "val")], "case_id long, role string"))
    assert checks(contract.trace_inputs_violations(bad, 149)) == [("case_count", "roles"), ("case_in_both_roles", "0")]


@pytest.mark.parametrize("text", [False, True])
def test_stream_equals_batch_however_events_arrive(spark, text):
    runs = {0: good(), **{i + 1: f(good()) for i, (f, _) in enumerate(TAMPERINGS.values())}}
    df, role = frame(spark, runs), roles(spark)
    if text:
        df = df.withColumn("run_id", F.concat(F.lit("site/run-"), "run_id")).withColumn("case_id", F.concat(F.lit("sub-"), "case_id"))
        role = role.withColumn("case_id", F.concat(F.lit("sub-"), "case_id"))
    incoming, path = scratch_path(spark, "trace-in"), scratch_path(spark, "trace-out")
    for part in range(3):  # arrivals that ignore event order
        df.where(F.pmod(F.xxhash64("seq"), F.lit(3)) == part).coalesce(1).write.mode("append").parquet(incoming)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    judge_trace_stream(stream, role, EPOCHS, path, scratch_path(spark, "trace-cp")).awaitTermination()
    got = sorted(map(tuple, latest_violations(spark, path).collect()))
    assert got == sorted(map(tuple, contract.trace_violations(df, role, EPOCHS).collect())) and got


def test_state_judges_each_event_once_and_equals_batch(spark):
    """Files in time order with neighbours swapped across them, late events reported, missing milestones after silence."""
    runs = {0: good(), **{i + 1: f(good()) for i, (f, _) in enumerate(TAMPERINGS.values())}}
    at = F.timestamp_seconds(F.col("seq") * 60)
    df = frame(spark, runs).withColumn("run_id", F.concat(F.lit("site/run-"), "run_id")).withColumn("case_id", F.concat(F.lit("sub-"), "case_id"))
    role = roles(spark).withColumn("case_id", F.concat(F.lit("sub-"), "case_id"))
    want = sorted(map(tuple, contract.trace_violations(df, role, EPOCHS).collect()))
    df = df.withColumn("ts", at)
    late = df.where("seq = 2").limit(1).withColumn("seq", F.lit(-1).cast("long"))
    beat = df.limit(1).withColumn("run_id", F.lit(None).cast("string")).withColumn("ts", F.timestamp_seconds(F.lit(10**7)))
    incoming, path, state = (scratch_path(spark, f"state-{x}") for x in ("in", "out", "cp"))
    slot = F.floor((F.col("seq") + F.pmod(F.xxhash64("run_id", "seq"), F.lit(4))) / 6)  # up to four minutes out of order
    for part in range(6):
        df.where((slot == part) if part < 5 else slot >= part).coalesce(1).write.mode("append").parquet(incoming)
    for last in (late, beat):
        last.coalesce(1).write.mode("append").parquet(incoming)
    source = lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    query = watch_trace_stream(source(), role, EPOCHS, path, state, delay="6 minutes", idle="3 hours")
    query.awaitTermination()
    got = [tuple(r) for r in violations_so_far(spark, path).collect()]
    late_rows = [r for r in got if r[0] == "late_event"]
    assert len(late_rows) == 1 and late_rows[0][1].endswith("/-1")
    assert sorted(r for r in got if r[0] != "late_event") == want
    assert query.recentProgress[-1]["stateOperators"][0]["numRowsTotal"] == 0  # every run's state is gone
    watch_trace_stream(source(), role, EPOCHS, path, state, delay="6 minutes", idle="3 hours").awaitTermination()
    assert violations_so_far(spark, path).count() == len(got)  # a restart judges nothing again


def test_state_of_an_empty_stream_and_unread_order(spark):
    schema = "run_id string, seq long, ts timestamp, type string, case_id string, epoch int"
    role = spark.createDataFrame([("a", "train"), ("b", "val")], "case_id string, role string")
    incoming, path = scratch_path(spark, "state-in"), scratch_path(spark, "state-out")
    rows = [("r", 5, 100, "train_step", None, 1), ("r", 3, 4000, "train_step", None, 2), ("r", None, 100, "train_step", None, 3), (None, None, 10**6, None, None, None)]
    for row in rows[:1], rows[1:3], rows[3:]:
        spark.createDataFrame(row, "run_id string, seq long, s long, type string, case_id string, epoch int").selectExpr(
            "run_id", "seq", "timestamp_seconds(s) as ts", "type", "case_id", "epoch").coalesce(1).write.mode("append").parquet(incoming)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    watch_trace_stream(stream, role, 1, path, scratch_path(spark, "state-cp"), delay="1 minute", idle="1 hour").awaitTermination()
    got = sorted(map(tuple, violations_so_far(spark, path).collect()))
    assert [r for r in got if r[0] == "sequence"] == [("sequence", "r/", ""), ("sequence", "r/3", "train_step")]
    assert sum(r[0] == "milestone_missing" for r in got) == 3
    assert violations_so_far(spark, scratch_path(spark, "nothing")).count() == 0


def test_state_serves_many_runs_by_few_keys(spark):
    """The state of a shard's runs is read and written together: rows and timers do not grow with the runs."""
    events = spark.range(4_000).selectExpr("cast(id as string) as run_id", "id as seq", "timestamp_seconds(1000 + id) as ts", f"'{contract.STEP}' as type", "'0' as case_id", "2 as epoch")
    beat = events.limit(1).withColumn("run_id", F.lit(None).cast("string")).withColumn("ts", F.timestamp_seconds(F.lit(9_000)))
    incoming, path = scratch_path(spark, "many-in"), scratch_path(spark, "many-out")
    for part in (events, beat):
        part.coalesce(1).write.mode("append").parquet(incoming)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    role = spark.createDataFrame([("0", "train")], "case_id string, role string")
    query = watch_trace_stream(stream, role, 1, path, scratch_path(spark, "many-cp"), delay="1 minute", idle="1 day")
    query.awaitTermination()
    operators = [p["stateOperators"][0] for p in query.recentProgress]
    assert max(o["numRowsTotal"] for o in operators) <= 4 * SHARDS and max(o["customMetrics"]["numRegisteredTimers"] for o in operators) <= 2 * SHARDS
    got = violations_so_far(spark, path)
    assert got.count() == got.where("check = 'step_order'").count() == 4_000
