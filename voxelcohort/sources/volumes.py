"""NIfTI-1 volumes to slab rows. Python runs per file batch; Spark spreads the files."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelcohort.functions import violation

HEADER_BYTES = 352
# Public NIfTI-1 datatype codes.
DTYPES = {2: "uint8", 4: "int16", 8: "int32", 16: "float32", 64: "float64", 256: "int8", 512: "uint16", 768: "uint32"}

TABLE_VALUES = 1 << 18

HEADER_SCHEMA = (
    "path string, shape array<int>, spacing array<double>, origin array<double>, direction array<double>, "
    "affine array<double>, dtype string, error string"
)
SLAB_SCHEMA = "path string, z int, height int, width int, values array<float>, error string"


def _chunks(content: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """Plain bytes of a possibly gzipped file, piece by piece."""
    if content[:2] != b"\x1f\x8b":
        yield content
        return
    inflate = zlib.decompressobj(wbits=31)
    data = content
    while data and not inflate.eof:
        yield inflate.decompress(data, size)
        data = inflate.unconsumed_tail


def _header(raw: bytes) -> dict:
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    if struct.unpack(order + "i", raw[:4])[0] != 348 or raw[344:347] not in (b"n+1", b"ni1"):
        raise ValueError("not a NIfTI-1 header")
    dim = struct.unpack(order + "8h", raw[40:56])
    code = struct.unpack(order + "h", raw[70:72])[0]
    pixdim = struct.unpack(order + "8f", raw[76:108])
    offset, slope, inter = struct.unpack(order + "3f", raw[108:120])
    rows = np.array(struct.unpack(order + "12f", raw[280:328]), dtype=float).reshape(3, 4)
    if struct.unpack(order + "h", raw[254:256])[0] <= 0:
        rows = np.column_stack([np.diag(pixdim[1:4]), np.zeros(3)])
    if code not in DTYPES:
        raise ValueError(f"unsupported datatype {code}")
    shape = [int(d) for d in dim[1 : 1 + max(dim[0], 0)]]
    while len(shape) > 3 and shape[-1] == 1:
        shape.pop()
    spacing = [float(p) for p in pixdim[1 : 1 + len(shape)]]
    scale = np.where(np.linalg.norm(rows[:, :3], axis=0) > 0, np.linalg.norm(rows[:, :3], axis=0), 1.0)
    return {
        "shape": shape, "spacing": spacing, "origin": [float(v) for v in rows[:, 3]],
        "direction": [float(v) for v in (rows[:, :3] / scale).ravel()],
        "affine": [round(float(v), 7) for v in np.vstack([rows, [0, 0, 0, 1]]).ravel()],
        "dtype": DTYPES[code], "order": order, "offset": int(offset),
        "slope": slope if np.isfinite(slope) and slope != 0 else 1.0, "inter": inter if np.isfinite(inter) else 0.0,
    }


def _read_headers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = []
        for path, content in zip(batch["path"], batch["content"]):
            try:
                h = _header(next(_chunks(content, HEADER_BYTES)))
                out.append((path, h["shape"], h["spacing"], h["origin"], h["direction"], h["affine"], h["dtype"], None))
            except Exception as exc:  # one bad file becomes a row, not a failed job
                out.append((path, None, None, None, None, None, None, str(exc)))
        yield pd.DataFrame(out, columns=["path", "shape", "spacing", "origin", "direction", "affine", "dtype", "error"])


def _slabs(path: str, content: bytes) -> Iterator[tuple]:
    pieces = _chunks(content)
    buffer = bytearray(next(pieces))
    h = _header(bytes(buffer[:HEADER_BYTES]))
    if len(h["shape"]) != 3:
        raise ValueError(f"expected a 3-D volume, found {len(h['shape'])} dimensions")
    width, height, depth = h["shape"]
    dtype = np.dtype(h["dtype"]).newbyteorder(h["order"])
    need = width * height * dtype.itemsize
    skip = h["offset"]
    for z in range(depth):
        while len(buffer) < skip + need:
            piece = next(pieces, b"")
            if not piece:
                raise ValueError("file ends inside the volume")
            buffer += piece
        plane = np.frombuffer(bytes(buffer[skip : skip + need]), dtype=dtype).astype(np.float32)
        del buffer[: skip + need]
        skip = 0
        yield path, z, height, width, plane * np.float32(h["slope"]) + np.float32(h["inter"]), None


def _read_slabs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Slabs of large and small files alike leave in tables of about ``TABLE_VALUES`` values."""
    columns = ["path", "z", "height", "width", "values", "error"]
    out, held = [], 0
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            try:
                for slab in _slabs(path, content):
                    out.append(slab)
                    held += len(slab[4]) + 1
                    if held >= TABLE_VALUES:
                        yield pd.DataFrame(out, columns=columns)
                        out, held = [], 0
            except Exception as exc:
                out.append((path, None, None, None, None, str(exc)))
    if out:
        yield pd.DataFrame(out, columns=columns)


def volume_files(spark: SparkSession, path: str) -> DataFrame:
    """Volume files with their bytes; Spark plans the files over tasks."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def ingest_headers(files: DataFrame) -> DataFrame:
    """Header row of each file; only the first bytes are decompressed."""
    return files.select("path", "content").mapInPandas(_read_headers, HEADER_SCHEMA)


def ingest_volumes(files: DataFrame) -> DataFrame:
    """Slab rows ``(path, z, height, width, values)``; a slab at a time is held in memory."""
    return files.select("path", "content").mapInPandas(_read_slabs, SLAB_SCHEMA)


def ingest_violations(ingested: DataFrame) -> DataFrame:
    return violation(ingested.where("error is not null"), "volume_unreadable", F.col("path"), F.col("error"))


def explode_slabs(slabs: DataFrame) -> DataFrame:
    """One row a voxel: ``(path, z, y, x, value)``."""
    return slabs.where("error is null").select(
        "path", "z", "width", F.posexplode("values").alias("_i", "value")
    ).select(
        "path", "z", F.expr("int(_i div width)").alias("y"), (F.col("_i") % F.col("width")).alias("x"),
        F.col("value").cast("double").alias("value"),
    )
