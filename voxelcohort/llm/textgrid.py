"""Arrow text columns seen as flat byte arrays, so that tasks count and hash words without a Python loop per row.

Every function works on one block of rows at a time. Blocks are cut by bytes, so memory in a task stays bounded by
``BLOCK_BYTES`` (or by the longest single text, whichever is larger), whatever the Arrow batch size is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

BLOCK_BYTES = 1 << 20

_rng = np.random.default_rng(20240501)
BYTE_WORD = _rng.integers(1, 2**63 - 1, size=256, dtype=np.int64).astype(np.uint64)
PLACE_WORD = _rng.integers(1, 2**63 - 1, size=256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
PLACE_STEP = np.uint64(0x9E3779B97F4A7C15)

IS_SPACE = np.zeros(256, dtype=bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit words so that every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def blocks(texts: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets into them) for runs of rows of about ``size`` bytes; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks() if texts.num_chunks != 1 else texts.chunk(0)
    texts = texts.fill_null("") if texts.null_count else texts
    n = len(texts)
    if not n:
        return
    wide = pa.types.is_large_string(texts.type)
    _, at, held = texts.buffers()
    offsets = np.frombuffer(at, dtype=np.int64 if wide else np.int32)[texts.offset:texts.offset + n + 1].astype(np.int64)
    data = np.frombuffer(held, dtype=np.uint8) if held is not None else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + size, side="right")) - 1
        end = min(n, max(end, row + 1))
        yield row, end, data[offsets[row]:offsets[end]], offsets[row:end + 1] - offsets[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, word ends and the row of each word; words are runs without ASCII white space and stay in a row."""
    if not len(data):
        none = np.zeros(0, dtype=np.int64)
        return none, none, none
    solid = ~IS_SPACE[data]
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    before = np.empty_like(solid)
    before[0] = False
    before[1:] = solid[:-1]
    after = np.empty_like(solid)
    after[-1] = False
    after[:-1] = solid[1:]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each of the ascending, disjoint byte spans; equal bytes give equal hashes in every task."""
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum()), dtype=np.int64) - np.repeat(first, lengths)
    flat = data[place + np.repeat(starts, lengths)]
    weight = PLACE_WORD[place & 255]
    if int(lengths.max()) > 256:
        weight = weight + (place >> 8).astype(np.uint64) * PLACE_STEP
    return mix(np.add.reduceat(BYTE_WORD[flat] * weight, first) + lengths.astype(np.uint64))


def per_span(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each span; spans may be empty."""
    total = np.zeros(len(values) + 1, dtype=np.int64)
    np.cumsum(values, out=total[1:])
    return total[ends] - total[starts]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def need(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns alone, cast to the named types, so that extra or clashing columns never reach an operator."""
    return df.select(*[df[c].cast(t).alias(c) for c, t in columns.items()])


def schema_of(text: str) -> T.StructType:
    return T.StructType.fromDDL(text)
