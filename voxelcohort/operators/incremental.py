"""Input signatures, content digests, stale work and progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from voxelcohort.functions import violation, violations_of
from voxelcohort.functions.running import RunningDigest, WholeDigest, resumable
from voxelcohort.session import cut_lineage, scratch_path, small_side

LIMBS, LIMB_DIGITS = 4, 12
# Bytes: longest file digested as one row; part of a longer one that a task passes over; longest row of a part, and of
# rows that a task writes or reads at once.
WHOLE, SPAN, PIECE, GROUP = 64 << 20, 128 << 20, 64 << 10, 16 << 20
PACKED = r"(?i)\.(gz|bz2|deflate|snappy|lz4|zst|passthrough)$"  # the line reader would unpack these
MARK = "X'EFBBBF'"  # the line reader drops this mark at the start of a file
PIECES = "path string, size long, start long, number long, bytes long, content binary"
STATES = "file int, content binary, left long, digest string"


def input_signature(files: DataFrame) -> DataFrame:
    """One digest a case over all its inputs ``(case_id, name, size, mtime)``, in any order.

    Per-file sha256 limbs are added modulo 2**48 and digested again, so the aggregation is
    map-side and a case with very many files never gathers them in one task.
    """
    line = F.sha2(F.concat_ws("|", F.col("name").cast("string"), F.col("size").cast("string"), F.col("mtime").cast("string")), 256)
    limb = lambda i: F.conv(F.substring("_h", 1 + i * LIMB_DIGITS, LIMB_DIGITS), 16, 10).cast("decimal(20,0)")
    sums = [
        (F.sum(limb(i)) % F.lit(1 << (4 * LIMB_DIGITS)).cast("decimal(20,0)")).cast("long").cast("string").alias(f"_l{i}")
        for i in range(LIMBS)
    ]
    per_case = files.withColumn("_h", line).groupBy("case_id").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), *sums)
    return per_case.select(
        "case_id", "files", "bytes",
        F.sha2(F.concat_ws("|", F.col("files").cast("string"), *[f"_l{i}" for i in range(LIMBS)]), 256).alias("signature"),
    )


def input_violations(files: DataFrame, cases: DataFrame) -> DataFrame:
    """Empty files and cases without any input."""
    empty = violation(files.where("size is null or size <= 0"), "file_empty", F.concat_ws("/", "case_id", "name"), F.col("size"))
    none = cases.select("case_id").join(files.select("case_id"), "case_id", "left_anti")
    return empty.unionByName(violation(none, "input_missing", F.col("case_id"), F.lit("")))


def content_digest(files: DataFrame, algorithm: str = "sha256") -> DataFrame:
    """Digest of each file's bytes ``(path, content)``, spread over files."""
    digest = F.sha2(F.col("content"), 256) if algorithm == "sha256" else F.md5("content")
    return files.select("path", F.length("content").cast("long").alias("bytes"), digest.alias("digest"))


def file_digests(
    spark: SparkSession, root: str, pattern: str = "*", algorithm: str = "sha256", whole: int = WHOLE, span: int = SPAN
) -> DataFrame:
    """Digest of each file's bytes in ``root`` ``(path, bytes, digest)``, spread over files and over parts of long files.

    A file up to ``whole`` bytes is one row. Longer ones are read in splits as lines, whose bytes Spark leaves as they are,
    and kept as pieces by part of ``span`` bytes; a round digests one part of every long file and hands the half-done
    digests to the next round's tasks, so neither rows nor what a task reads grow with a file. Where Python lacks OpenSSL's
    digests, the pieces of a file meet in one task. Packed files stay one row, and Spark's listing leaves out empty files.
    """
    size = F.col("_metadata.file_size")
    long = (size > whole) & ~F.col("_metadata.file_name").rlike(PACKED)
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(root)
    short = content_digest(found.where(~long), algorithm)
    listed = found.where(long).select(F.col("path").alias("name"), "length", F.col("_metadata.file_path").alias("path"))
    files, longest = listed.agg(F.count(F.lit(1)), F.max("length")).first()
    if not files:
        return short
    names = small_side(listed.withColumn("file", F.row_number().over(Window.orderBy("path"))))
    handed_on = resumable(algorithm)
    pieces = (
        spark.read.option("pathGlobFilter", pattern).text(root, lineSep="\n").where(long)
        .select(F.col("_metadata.file_path").alias("path"), size.alias("size"),
                F.col("_metadata.file_block_start").alias("start"), F.col("value").cast("binary").alias("content"))
        .mapInArrow(_pieces, PIECES)
    )
    scratch = scratch_path(spark, "pieces")
    part = F.expr(f"start div {span}") if handed_on else F.lit(0)
    pieces = pieces.join(names.select("path", "file"), "path").withColumn("part", part)
    pieces.write.partitionBy("part").option("parquet.block.size", GROUP).parquet(scratch)
    kept = spark.read.schema(PIECES + ", file int, part long").parquet(scratch)
    state, rows = None, _begin(kept)
    for k in range(longest // span + 1 if handed_on else 1):
        if state is not None:
            rows = state.selectExpr("file", "-1L as start", "0L as number", "content", "left")
        rows = rows.unionByName(kept.where(F.col("part") == k).selectExpr("file", "start", "number", "content", "cast(null as long) as left"))
        ordered = rows.repartitionById(files, "file").sortWithinPartitions("file", "start", "number")
        state = cut_lineage(ordered.mapInArrow(_go_on(algorithm, RunningDigest if handed_on else WholeDigest), STATES))
    done = names.join(state.select("file", "digest"), "file")
    return short.unionByName(done.select(F.col("name").alias("path"), F.col("length").alias("bytes"), "digest"))


def _begin(pieces: DataFrame) -> DataFrame:
    """Empty digests of the files, in front of the pieces, with the mark the reader dropped as first piece.

    With it the lines, each ended by a line feed, are as long as the file, or one byte longer if its last line has no end.
    """
    total = pieces.groupBy("file", "path", "size").agg(F.sum("bytes").alias("n")).withColumn("marked", F.col("n") < F.col("size"))
    changed = F.raise_error(F.concat(F.lit("bytes read differ from the size of "), "path"))
    over = F.col("n") + F.when(F.col("marked"), 3).otherwise(0) - F.col("size")
    first = F.expr(f"if(marked, array(X'', {MARK}), array(X''))")
    return total.select(
        "file", F.lit(-1).cast("long").alias("start"), F.when(over.isin(0, 1), F.col("size")).otherwise(changed).alias("left"), F.posexplode(first).alias("number", "content")
    ).select("file", "start", F.col("number").cast("long").alias("number"), "content", "left")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a batch joined again, in rows that each hold bytes of one split; ``number`` keeps their order."""
    number = 0
    for batch in batches:
        path, size, start, content = batch.columns
        n = len(batch)
        turn = pc.or_(pc.not_equal(path.slice(1), path.slice(0, n - 1)), pc.not_equal(start.slice(1), start.slice(0, n - 1))) if n else []
        for a, b in pairwise([0, *(np.flatnonzero(turn) + 1).tolist(), n]):
            if a < b:
                lines = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), content.slice(a, b - a))
                joined = pc.binary_join(lines, b"\n")[0].as_py() + b"\n"
                pieces = [joined[i:i + PIECE] for i in range(0, len(joined), PIECE)]
                same = pa.array([a] * len(pieces))
                yield pa.RecordBatch.from_arrays(
                    [path.take(same), size.take(same), start.take(same), pa.array(range(number, number + len(pieces)), pa.int64()),
                     pa.array([len(p) for p in pieces], pa.int64()), pa.array(pieces, pa.binary())],
                    names=["path", "size", "start", "number", "bytes", "content"])
                number += len(pieces)


def _go_on(algorithm: str, digest: type) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Takes up each file's digest, its first row, and goes on with the pieces behind it until no byte is left."""

    def step(batches):
        file = run = left = None

        def row():
            return pa.RecordBatch.from_pylist(
                [{"file": file, "content": run.state(), "left": left, "digest": None if left else run.hexdigest()}],
                pa.schema([("file", pa.int32()), ("content", pa.binary()), ("left", pa.int64()), ("digest", pa.string())]))

        for batch in batches:
            for f, start, number, content, open_ in zip(*batch.columns):
                if (start.as_py(), number.as_py()) == (-1, 0):
                    if run:
                        yield row()
                    file, run, left = f.as_py(), digest(algorithm, content.as_py()), open_.as_py()
                else:
                    data = content.as_py()[:left]
                    run.update(data)
                    left -= len(data)
        if run:
            yield row()

    return step


def verify_digests(digests: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files whose digest differs from, or which are absent on one side of, the manifest."""
    both = manifest.select("path", F.col("digest").alias("want"), F.lit(1).alias("_m")).join(
        digests.select("path", "digest", F.lit(1).alias("_d")), "path", "full_outer"
    )
    path = F.col("path")
    return violations_of(both, [
        (F.col("_d").isNull(), "file_missing", path, F.lit("")),
        (F.col("_m").isNull(), "file_unlisted", path, F.lit("")),
        (F.col("want") != F.col("digest"), "digest", path, F.col("digest")),
    ])


def stale_cases(current: DataFrame, checkpoint: DataFrame, schema_version: str) -> DataFrame:
    """Cases to recompute: no finished checkpoint with this schema and the same signature."""
    done = checkpoint.where((F.col("status") == "complete") & (F.col("schema") == schema_version)).select("case_id", "signature")
    return current.join(done, ["case_id", "signature"], "left_anti")


def checkpoint_violations(checkpoint: DataFrame) -> DataFrame:
    """Checkpoint rows whose stored metrics belong to another case or fold."""
    same = F.col("case_id").eqNullSafe(F.col("metric_case_id")) & F.col("fold").eqNullSafe(F.col("metric_fold"))
    return violation(checkpoint.where(~same), "checkpoint_identity", F.col("case_id"), F.concat_ws("/", "metric_case_id", "metric_fold"))


def progress(status: DataFrame) -> DataFrame:
    """Totals of ``(case_id, status, updated)``: completed, failed, percent, last finished case."""
    done = F.col("status") == "complete"
    totals = status.agg(
        F.count_if(done).alias("completed"), F.count(F.lit(1)).alias("total"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.max_by(F.when(done, F.col("case_id")), F.when(done, F.struct("updated", "case_id"))).alias("last_case"),
    )
    return totals.withColumn("percent", F.when(F.col("total") > 0, F.round(100.0 * F.col("completed") / F.col("total"), 2)))
