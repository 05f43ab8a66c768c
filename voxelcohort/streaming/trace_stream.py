"""The ordered-event contract on an unbounded stream: every arrival judges its runs anew by the batch rules.

Events are kept as they arrive; a micro-batch judges the runs it touches on all their events so far. So the answer does
not depend on how arrivals were cut into batches, late events are judged like others, milestones are missing exactly as
long as they are, and run and case ids may be of any type. Nothing is held in streaming state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxelcohort.operators import trace as contract

# Events are filed by this many buckets of runs, so that a batch reads back the buckets of its runs only.
RUN_BUCKETS = 64
EVENT_COLUMNS = ("run_id", "seq", "type", "case_id", "epoch")


def judge_trace_stream(
    stream: DataFrame, roles: DataFrame, epochs: int, path: str, checkpoint: str, once: bool = True
) -> StreamingQuery:
    """Judge ``(run_id, seq, type, case_id, epoch)`` events as they arrive; results are read by ``latest_violations``.

    A micro-batch writes its own folders under ``path``, so one that is repeated after a failure replaces them.
    ``once`` takes what is there and ends.
    """
    id_type = stream.schema["run_id"].dataType

    def judge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        arrived = batch.select(*EVENT_COLUMNS, F.pmod(F.xxhash64("run_id"), F.lit(RUN_BUCKETS)).alias("bucket"))
        arrived.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/events/batch={number}")
        events = spark.read.schema(arrived.drop("bucket").schema.add("batch", "long").add("bucket", "long")).parquet(f"{path}/events")
        mine = events.where(F.col("batch") == number)
        buckets = [r["bucket"] for r in mine.select("bucket").distinct().collect()]  # RUN_BUCKETS at most
        runs = mine.select("run_id").distinct()
        known = events.where(F.col("bucket").isin(buckets) & (F.col("batch") <= number)).join(runs, "run_id", "left_semi")
        found = contract.trace_violations(known.select(*EVENT_COLUMNS), roles, epochs)
        owner = F.when(F.col("check") == "milestone_missing", F.col("key")).otherwise(F.regexp_replace("key", "/[^/]*$", ""))
        found.withColumn("run_id", owner.cast(id_type)).write.mode("overwrite").parquet(f"{path}/found/batch={number}")
        runs.write.mode("overwrite").parquet(f"{path}/judged/batch={number}")

    started = stream.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint)
    return (started.trigger(availableNow=True) if once else started).start()


def latest_violations(spark: SparkSession, path: str) -> DataFrame:
    """Violation rows of every run by its latest judgement."""
    newest = spark.read.parquet(f"{path}/judged").groupBy("run_id").agg(F.max("batch").alias("batch"))
    return spark.read.parquet(f"{path}/found").join(newest, ["run_id", "batch"], "left_semi").select("check", "key", "detail")
