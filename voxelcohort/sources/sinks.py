"""Table sinks with a stable column order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_tables(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), fmt: str = "parquet", mode: str = "overwrite"
) -> None:
    """Write parquet, csv or json; key columns lead, partition columns come last as Spark keeps them."""
    if fmt not in ("parquet", "csv", "json"):
        raise ValueError("fmt must be parquet, csv or json")
    lead = [c for c in ("case_id", "fold", "channel", "metric") if c in df.columns and c not in partition_by]
    rest = [c for c in df.columns if c not in lead and c not in partition_by]
    writer = df.select(*lead, *rest, *partition_by).write.mode(mode).partitionBy(*partition_by)
    if fmt == "csv":
        writer = writer.option("header", "true")
    writer.format(fmt).save(path)


def write_lines(lines: DataFrame, path: str, order: str = "line_no", text: str = "line") -> None:
    """Report lines as text files in reading order across part files."""
    lines.orderBy(order).select(text).write.mode("overwrite").text(path)


def overwrite_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Replace only the partitions present in ``df``, so recomputed cases supersede their old rows."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)
