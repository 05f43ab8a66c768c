"""Texts written once to the shared folder, so that later passes join small tables to them without moving a text."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT_SHIFT = 33


def unit_of(rid: Column) -> Column:
    return F.shiftright(rid, UNIT_SHIFT)


def hold(docs: DataFrame, doc: str, text: str, path: str, whole: bool = False) -> DataFrame:
    """(id, text, rid, unit): a row number ``rid``, and the reading task ``unit`` as the table's bucket; ``whole`` adds
    the struct ``row`` of all columns. A null text reads as "".

    What one task reads it writes as one bucketed file, so nothing is shuffled here or in later joins on ``unit``.
    """
    kept = F.struct(*[F.col(c) for c in docs.columns]) if whole else F.struct(F.col(text).cast("string").alias(text))
    numbered = docs.select(F.col(doc).cast("long").alias("id"), kept.alias("row"), F.monotonically_increasing_id().alias("rid"))
    # a table bucketed by unit serves joins on (unit, rid) as it lies, if it has no fewer buckets than a shuffle has parts
    conf = docs.sparkSession.conf
    conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    buckets = max(docs.rdd.getNumPartitions(), int(conf.get("spark.sql.shuffle.partitions")))
    name = f"units_{uuid.uuid4().hex}"
    (numbered.withColumn("unit", unit_of(F.col("rid"))).write.option("path", path).option("compression", "zstd")
     .bucketBy(buckets, "unit").sortBy("unit", "rid").saveAsTable(name))
    held = docs.sparkSession.table(name).withColumn("text", F.coalesce(F.col("row")[text].cast("string"), F.lit("")))
    return held if whole else held.drop("row")


def without(held: DataFrame, gone: DataFrame, columns: list[str]) -> DataFrame:
    """The held rows, as they came, but those whose ``rid`` is in ``gone``; texts stay where they are."""
    marked = gone.select(unit_of(F.col("rid")).alias("unit"), "rid").distinct()
    return held.join(marked.hint("shuffle_merge"), ["unit", "rid"], "left_anti").select(*[F.col("row")[c].alias(c) for c in columns])


def with_lists(held: DataFrame, rows: DataFrame, value: Column, name: str, how: str) -> DataFrame:
    """Held documents with the list ``name`` of their values; only the rows move."""
    lists = rows.select(unit_of(F.col("rid")).alias("unit"), "rid", value.alias("_value")).groupBy("unit", "rid").agg(F.collect_list("_value").alias(name))
    return held.join(lists.hint("shuffle_merge"), ["unit", "rid"], how)
