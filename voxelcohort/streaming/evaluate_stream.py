"""Evaluate prediction files as they arrive; finished cases are never recomputed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voxelcohort.operators import incremental, metrics
from voxelcohort.session import cut_lineage, read_if_present

PREDICTION_SCHEMA = "case_id long, z long, y long, x long"


def current_rows(spark: SparkSession, out: str, before: int | None = None) -> DataFrame | None:
    """The latest row of each case, of batches ``before`` one if it is given; nothing where none was written yet."""
    rows = read_if_present(spark, out)
    if rows is None:
        return None
    rows = rows if before is None else rows.where(F.col("batch") < before)
    newest = rows.groupBy("case_id").agg(F.max("batch").alias("batch"))
    return rows.join(newest, ["case_id", "batch"], "left_semi")


def evaluate_new_cases_stream(
    spark: SparkSession, incoming: str, reference: DataFrame, headers: DataFrame, out: str, checkpoint: str,
    schema_version: str = "v1", schema: str = PREDICTION_SCHEMA,
) -> StreamingQuery:
    """File stream of sparse predictions; each micro-batch evaluates only its own unfinished cases.

    A case's file must arrive whole. A row with null coordinates delivers an empty mask. A micro-batch writes its own folder
    under ``out`` and compares with earlier batches only, so one that is repeated after a failure replaces itself; a case
    that is delivered again with another mask is evaluated again. ``current_rows`` reads one row a case, its latest.
    """

    def evaluate(batch: DataFrame, batch_id: int) -> None:
        batch = cut_lineage(batch)
        # The voxel multiset identifies a delivered mask.
        inputs = batch.select(
            "case_id", F.concat_ws(",", "z", "y", "x").alias("name"), F.lit(1).alias("size"), F.lit("").alias("mtime")
        )
        current = incremental.input_signature(inputs).select("case_id", "signature")
        saved = current_rows(spark, out, batch_id)
        todo = cut_lineage(current if saved is None else incremental.stale_cases(current, saved, schema_version))
        if todo.isEmpty():
            return
        only = lambda df: df.join(todo.select("case_id"), "case_id", "left_semi")
        rows = metrics.evaluate_cases(only(reference), only(batch.where("z is not null")), only(headers))
        done = rows.join(todo, "case_id").withColumn("schema", F.lit(schema_version)).withColumn("status", F.lit("complete"))
        done.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    stream = spark.readStream.schema(schema).parquet(incoming)
    return (
        stream.writeStream.foreachBatch(evaluate).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
