"""Nearest neighbours by cosine through multi-index hashing of learned rotated binary codes.

Unit vectors are rotated so that their signs lose little (rotations learned on a bounded sample), and the signs make a
code. A code is split into byte-wide substrings, each with its own inverted table. Two codes within Hamming distance
``r`` agree up to ``r // m`` in one of ``m`` substrings, so probing every table within that small distance retrieves
every code within ``r``; the retrieved vectors are then ranked by exact cosine. The radius is learned from the exact
neighbours of a few probe queries among all rows. Queries with too few hits are searched again at full radius.

Defined results: vectors that are null, zero, or hold null or non-finite components, or whose length is not the most
frequent one, take no part; rows sharing an id count once, by their smallest vector; ties go to the smaller id; an
empty table or a single vector gives no rows; other columns are ignored.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelcohort.session import cut_lineage

# Bounds: vectors that teach the rotations, queries that teach the radius, rows of an index block and of a query block.
SAMPLE_VECTORS = 8_000
PROBE_QUERIES = 120
INDEX_BLOCK = 4_096
QUERY_BLOCK = 2_048
CODE_BITS = 128
COVERED = 0.985
PAIR_CHUNK = 1 << 16
_POP8 = np.array([bin(v).count("1") for v in range(256)], dtype=np.uint8)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v) with doubles, one row for each id."""
    v = F.col(vector).cast("array<double>")
    sound = (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    return vectors.filter(F.col(key).isNotNull() & F.coalesce(sound, F.lit(False))).select(F.col(key).alias("id"), v.alias("v")).groupBy("id").agg(F.min("v").alias("v"))


def learn_rotations(sample: np.ndarray, bits: int = CODE_BITS, rounds: int = 25) -> np.ndarray:
    """(dimension, bits): orthogonal rotations that bring unit vectors close to their signs, several for long codes."""
    d = sample.shape[1]
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    found = []
    for k in range(ceil(bits / d)):
        turn, _ = np.linalg.qr(np.random.default_rng(100 + k).standard_normal((d, d)))
        for _ in range(rounds):
            signs = np.where(unit @ turn >= 0, 1.0, -1.0)
            u, _, w = np.linalg.svd(unit.T @ signs)
            turn = u @ w
        found.append(turn)
    return np.hstack(found)[:, :bits]


def encode(v: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """(rows, bytes) sign codes, padded with zero bits to whole 64-bit words."""
    code = np.packbits(v @ turn >= 0, axis=1)
    return np.ascontiguousarray(np.pad(code, ((0, 0), (0, -code.shape[1] % 8))))


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a[:, None, :] ^ b[None, :, :]).sum(axis=2, dtype=np.uint16)


def candidates(q_code: np.ndarray, x_code: np.ndarray, radius: int, substrings: int):
    """(query, row) index pairs of all codes within ``radius``, found by probing one inverted table per substring."""
    q_word, x_word = q_code.view(np.uint64), x_code.view(np.uint64)
    near = radius // substrings
    found = []
    for j in range(substrings):
        order = np.argsort(x_code[:, j], kind="stable")
        head = np.searchsorted(x_code[order, j], np.arange(257))
        q_order = np.argsort(q_code[:, j], kind="stable")
        q_head = np.searchsorted(q_code[q_order, j], np.arange(257))
        for value in np.flatnonzero(np.diff(q_head)):
            probes = np.flatnonzero(_POP8[np.arange(256) ^ value] <= near)
            rows = np.concatenate([order[head[p]:head[p + 1]] for p in probes])
            asked = q_order[q_head[value]:q_head[value + 1]]
            if len(rows):
                a, b = np.nonzero(_distance(q_word[asked], x_word[rows]) <= radius)
                found.append(asked[a] * len(x_code) + rows[b])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)
    return pairs // max(len(x_code), 1), pairs % max(len(x_code), 1)


def _best(query: np.ndarray, ident: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` best of each query: larger score first, then the smaller id."""
    order = np.lexsort((ident, -score, query))
    head = np.flatnonzero(np.diff(query[order], prepend=-1))
    rank = np.arange(len(order)) - np.repeat(head, np.diff(np.append(head, len(order))))
    return order[rank < k]


def _matrix(column) -> np.ndarray:
    held = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return held.flatten().to_numpy(zero_copy_only=False).reshape(len(held), -1)


def _ranked(pairs: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _probe(vectors: DataFrame, ids: np.ndarray, v: np.ndarray, turn: np.ndarray, k: int) -> np.ndarray:
    """Hamming distances from the probe queries to their exact ``k`` nearest among all rows."""
    q_code, q_norm = encode(v, turn).view(np.uint64), np.linalg.norm(v, axis=1)

    def scanned(batches):
        for batch in batches:
            own, x = batch.column(0).to_numpy(), _matrix(batch.column(1)) if batch.num_rows else None
            for a in range(0, batch.num_rows, INDEX_BLOCK):
                part, part_ids = x[a:a + INDEX_BLOCK], own[a:a + INDEX_BLOCK]
                score = (v @ part.T) / q_norm[:, None] / np.linalg.norm(part, axis=1)
                score[ids[:, None] == part_ids[None, :]] = -2
                top = np.argpartition(-score, min(k, score.shape[1]) - 1, axis=1)[:, :k]
                far = _distance(q_code, encode(part, turn).view(np.uint64))
                q = np.repeat(np.arange(len(ids)), top.shape[1])
                rows = top.ravel()
                keep = score[q, rows] > -2
                yield pa.RecordBatch.from_pydict({
                    "query_id": pa.array(ids[q][keep]), "vec_id": pa.array(part_ids[rows][keep]), "score": pa.array(score[q, rows][keep]),
                    "far": pa.array(far[q, rows][keep].astype(np.int32))})

    got = _ranked(vectors.mapInArrow(scanned, "query_id long, vec_id long, score double, far int"), k).select("far").toPandas()
    return got["far"].to_numpy()


def _search(vectors: DataFrame, queries: DataFrame, n: int, n_queries: int, turn: np.ndarray, radius: int, k: int) -> DataFrame:
    """Best rows of every (query, index block); each block holds one inverted table per substring."""
    index_blocks, query_blocks = ceil(n / INDEX_BLOCK), max(1, ceil(n_queries / QUERY_BLOCK))
    substrings = turn.shape[1] // 8
    block = lambda blocks: F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    rows = vectors.select(block(index_blocks).alias("xb"), every(query_blocks).alias("qb"), "id", "v")
    asked = queries.select(every(index_blocks).alias("xb"), block(query_blocks).alias("qb"), "id", "v")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def searched(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        x_id, x, q_id, q = left["id"].to_numpy(), _matrix(left["v"]), right["id"].to_numpy(), _matrix(right["v"])
        a, b = candidates(encode(q, turn), encode(x, turn), radius, substrings)
        other = q_id[a] != x_id[b]
        a, b = a[other], b[other]
        x_norm, q_norm = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
        score = np.empty(len(a))
        for s in range(0, len(a), PAIR_CHUNK):
            i, j = a[s:s + PAIR_CHUNK], b[s:s + PAIR_CHUNK]
            score[s:s + PAIR_CHUNK] = np.einsum("ij,ij->i", q[i], x[j]) / (q_norm[i] * x_norm[j])
        best = _best(a, x_id[b], score, k)
        return pa.Table.from_arrays([pa.array(q_id[a[best]]), pa.array(x_id[b[best]]), pa.array(score[best])], schema=schema)

    return rows.groupBy("xb", "qb").cogroup(asked.groupBy("xb", "qb")).applyInArrow(searched, "query_id long, vec_id long, score double")


def _sample(rows: DataFrame, n: int) -> pa.Table:
    """``n`` rows by the hash of their id, in the order of the ids; only ids are sorted."""
    chosen = rows.select("id").orderBy(F.xxhash64("id"), "id").limit(n)
    return rows.join(F.broadcast(chosen), "id").select("id", "v").toArrow().sort_by("id")


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", bits: int = CODE_BITS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for every row for which ``is_query`` holds.

    ``is_query`` may name the columns ``id`` and ``v``. Only the sample, the probes and counts reach the driver.
    """
    spark = vectors.sparkSession
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    held = cut_lineage(usable(vectors, key, vector))
    sizes = held.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.sum(is_query.cast("long")).alias("q")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes or sizes[0]["n"] < 2 or not sizes[0]["q"]:
        return nothing
    d, n, n_queries = sizes[0]["d"], sizes[0]["n"], sizes[0]["q"]
    held = held.filter(F.size("v") == d)
    queries = held.filter(is_query)
    turn = learn_rotations(_matrix(_sample(held, SAMPLE_VECTORS)["v"]), bits)
    probes = _sample(queries, PROBE_QUERIES)
    far = _probe(held, probes["id"].to_numpy(), _matrix(probes["v"]), turn, k)
    radius = int(np.quantile(far, COVERED, method="higher")) if len(far) else bits
    first = cut_lineage(_ranked(_search(held, queries, n, n_queries, turn, radius, k), k))
    full = first.groupBy("query_id").agg(F.count("*").alias("c")).filter(F.col("c") >= min(k, n - 1))
    short = cut_lineage(queries.join(full, queries["id"] == full["query_id"], "left_anti"))
    n_short = short.count()
    found = first
    if n_short:
        again = _ranked(_search(held, short, n, n_short, turn, turn.shape[1], k), k)
        found = first.join(full.select("query_id"), "query_id", "left_semi").unionByName(again)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
