"""Sampled segmentation into pieces of a public SentencePiece vocabulary, by forward filtering and backward sampling.

All segmentations of a text form a lattice of pieces. Forward filtering sums the weights of every path to each byte;
backward sampling draws pieces from the end with these sums, so each segmentation comes up in proportion to its weight.
Draws follow from the row key, the place in the text and a seed alone: they do not depend on partitions or retries.
Spaces are the vocabulary's space marks, characters outside the vocabulary fall back to bytes, and no mark is added in
front, so decoding returns exactly the original text.

No piece continues past a space behind a letter, so the lattice falls apart into chunks (spaces and the word behind
them); each distinct chunk of a block is filtered once and sampled for every occurrence.

Defined results: null and empty texts have no pieces and decode to ""; equal keys with equal texts are sampled alike;
empty tables give empty results; other columns pass through or are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelcohort.llm import textgrid

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
BLOCK = 2 << 20  # a block needs about 150 bytes of memory for each of its own
FILTER_BITS = 20
BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
SPACE_MARK = "▁"


@dataclass(frozen=True)
class Vocabulary:
    """Pieces as bytes with log weights, found by two hashes of their bytes; ids of the 256 byte pieces."""

    flat: np.ndarray  # bytes of all pieces behind each other
    begin: np.ndarray  # piece -> its first byte in flat; one more entry at the end
    weight: np.ndarray  # piece -> log weight
    byte_ids: np.ndarray  # byte -> piece
    lengths: tuple[int, ...]
    key: np.ndarray  # sorted first hashes of the searchable pieces
    check: np.ndarray  # their second hashes
    ids: np.ndarray  # their pieces
    sieve: np.ndarray  # whether any key starts with these FILTER_BITS bits
    loner: np.ndarray  # byte -> it stands in no searchable piece


def _prefix_hash(data: np.ndarray, base: np.uint64) -> np.ndarray:
    """h[i] = sum of (data[j] + 1) * base^(-j) for j < i, so that spans compare after one multiplication."""
    inverse = np.uint64(pow(int(base), -1, 1 << 64))
    power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(len(data), inverse)]).astype(np.uint64), dtype=np.uint64)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=out[1:], dtype=np.uint64)
    return out


def _powers(n: int, base: np.uint64) -> np.ndarray:
    return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, base)]).astype(np.uint64), dtype=np.uint64)


def _span_keys(prefix: np.ndarray, power: np.ndarray, start: np.ndarray, length: int | np.ndarray) -> np.ndarray:
    """Hashes of the spans [start, start + length): the same wherever the same bytes stand."""
    return textgrid.mix((prefix[start + length] - prefix[start]) * power[start] + np.asarray(length).astype(np.uint64))


def load_vocabulary(path: str = MODEL, temperature: float = 1.0) -> Vocabulary:
    """Read the public model file on the driver; tasks get the table with the job.

    The model ranks its pieces by merge order; their weight is the inverse rank to the power of ``temperature``.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    texts, weight, byte_ids, searchable = [], [], np.zeros(256, dtype=np.int32), []
    for k in range(model.get_piece_size()):
        piece, rank = model.id_to_piece(k), -model.get_score(k)
        weight.append(-temperature * np.log(10 + min(rank, model.get_piece_size())))
        if model.is_byte(k):
            byte_ids[int(piece[3:5], 16)] = k
            texts.append(bytes([int(piece[3:5], 16)]))
        elif model.is_control(k) or model.is_unknown(k) or model.is_unused(k):
            texts.append(b"")
        else:
            texts.append(piece.replace(SPACE_MARK, " ").encode())
            searchable.append(k)
    begin = np.concatenate([[0], np.cumsum([len(x) for x in texts])])
    flat = np.frombuffer(b"".join(texts), dtype=np.uint8)
    ids = np.array(searchable, dtype=np.int32)
    size = (begin[1:] - begin[:-1])[ids]
    keys, checks = (_span_keys(_prefix_hash(flat, b), _powers(len(flat), b), begin[ids], size) for b in BASES)
    order = np.argsort(keys)
    sieve = np.zeros(1 << FILTER_BITS, dtype=bool)
    sieve[keys >> np.uint64(64 - FILTER_BITS)] = True
    loner = np.ones(256, dtype=bool)
    for k in searchable:
        if len(texts[k]) > 1:
            loner[list(texts[k])] = False
        if b" " in texts[k].lstrip(b" "):
            raise ValueError("a piece of this vocabulary continues past a space")
    return Vocabulary(flat, begin, np.array(weight), byte_ids, tuple(sorted({int(x) for x in size})), keys[order], checks[order], ids[order], sieve, loner)


def _edges(v: Vocabulary, data: np.ndarray, end_of: np.ndarray):
    """(start, end, piece) of every piece that stands in a chunk, ordered by end and then by length."""
    prefixes = [_prefix_hash(data, b) for b in BASES]
    powers = [_powers(len(data), b) for b in BASES]
    found = []
    start = np.arange(len(data), dtype=np.int32)
    for length in v.lengths:
        start = start[start + length <= end_of[start]]
        if not len(start):
            break
        keys = _span_keys(prefixes[0], powers[0], start, length)
        maybe = v.sieve[keys >> np.uint64(64 - FILTER_BITS)]
        keys, at = keys[maybe], start[maybe]
        place = np.minimum(np.searchsorted(v.key, keys), len(v.key) - 1)
        hit = v.key[place] == keys
        at, place = at[hit], place[hit]
        sure = v.check[place] == _span_keys(prefixes[1], powers[1], at, length)
        found.append((at[sure], np.full(int(sure.sum()), length, dtype=np.int32), v.ids[place[sure]]))
    # characters without a piece of their own fall back to their bytes
    lead = (data & 0xC0) != 0x80
    width = np.where(data < 0x80, 1, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, 4)))
    known = np.zeros(len(data) + 4, dtype=bool)
    for at, size, _ in found:
        whole = at[(size == width[at]) & lead[at]]
        for k in range(4):
            known[whole[width[whole] > k] + k] = True
    loose = np.flatnonzero(~known[:len(data)]).astype(np.int32)
    found.append((loose, np.ones(len(loose), dtype=np.int32), v.byte_ids[data[loose]]))
    at, size, piece = (np.concatenate([f[k] for f in found]) for k in range(3))
    order = np.argsort(at + size, kind="stable")
    return at[order], (at + size)[order], piece[order]


def _ranges(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[0], begin[0] + 1, ... for ``count[0]`` numbers, then those of the next range."""
    first = np.cumsum(count) - count
    return np.arange(int(count.sum())) + np.repeat(begin - first, count)


def forward_filter(v: Vocabulary, data: np.ndarray, head: np.ndarray):
    """Lattice of the chunks that start at ``head`` in ``data``: (first edge of every end position, cumulated probability
    of the last piece as a share of 2^31, start, piece); the last edge of a position has the whole share."""
    tail = np.append(head[1:], len(data))
    length = tail - head
    end_of = np.repeat(tail, length)
    start, end, piece = _edges(v, data, end_of)
    first = np.searchsorted(end, np.arange(len(data) + 2))
    count = np.diff(first)
    weight = v.weight[piece]
    total = np.zeros(len(data) + 1)
    score = np.empty(len(end))
    order = np.argsort(-length, kind="stable")
    heads, lengths = head[order], length[order]
    alive = np.searchsorted(-lengths, -np.arange(1, lengths[0] + 1), side="right") if len(lengths) else []
    for t in range(1, int(lengths[0]) + 1 if len(lengths) else 0):
        at = heads[:alive[t - 1]] + t
        at = at[count[at] > 0]  # no piece ends inside a character
        mine = _ranges(first[at], count[at])
        origin = start[mine]
        # the sum before a chunk's first byte is 1, whatever the previous chunk left at that position
        value = np.where(origin == np.repeat(at - t, count[at]), 0.0, total[origin]) + weight[mine]
        cut = np.cumsum(count[at]) - count[at]
        total_here = np.logaddexp.reduceat(value, cut)
        score[mine] = np.exp(value - np.repeat(total_here, count[at]))
        total[at] = total_here
    share = score
    rank = np.arange(len(end)) - first[end]
    for k in range(1, int(count.max()) if len(count) else 0):
        late = np.flatnonzero(rank == k)
        share[late] += share[late - 1]
    last = np.ones(len(end), dtype=bool)
    last[:-1] = end[1:] != end[:-1]
    limit = np.minimum((share * (1 << 31)).astype(np.int64), 1 << 31)
    limit[last] = 1 << 31
    return first, limit, start, piece


def sample_block(v: Vocabulary, data: np.ndarray, offsets: np.ndarray, keys: np.ndarray, seed: int):
    """(pieces of all rows behind each other, number of pieces of each row)."""
    n = len(offsets) - 1
    if not len(data):
        return np.zeros(0, dtype=np.int32), np.zeros(n, dtype=np.int64)
    space, loner = data == 32, v.loner[data]
    cut = np.zeros(len(data), dtype=bool)
    cut[0] = True
    cut[1:] = (space[1:] & ~space[:-1]) | loner[1:] | loner[:-1]
    cut[offsets[:-1][offsets[:-1] < len(data)]] = True
    begin = np.flatnonzero(cut)
    end = np.append(begin[1:], len(data))
    row = np.searchsorted(offsets, begin, side="right") - 1
    _, shown, which = np.unique(textgrid.spans_hash(data, begin, end), return_index=True, return_inverse=True)
    size = (end - begin)[shown]
    chunks = data[_ranges(begin[shown], size)]
    head = np.cumsum(size) - size
    first_edge, limit, origin, piece = forward_filter(v, chunks, head)
    first_of_row = np.searchsorted(row, np.arange(n))
    stream = textgrid.mix(keys.astype(np.int64).view(np.uint64) + np.uint64(seed))[row]
    stream = stream + (np.arange(len(begin)) - first_of_row[row]).astype(np.uint64) * textgrid.PLACE_STEP
    who = np.argsort(which, kind="stable")  # equal chunks next to each other read the same part of the lattice
    at, stop = (head + size)[which[who]], head[which[who]]
    drawn, step = [], 0
    while len(who):
        u = textgrid.mix(stream[who] + np.uint64(step << 40)) >> np.uint64(33)
        u, edge = u.astype(np.int64), first_edge[at]
        short = np.flatnonzero(limit[edge] <= u)
        while len(short):
            edge[short] += 1
            short = short[limit[edge[short]] <= u[short]]
        drawn.append((who, piece[edge].astype(np.int32)))
        left = origin[edge] > stop
        at, stop, who, step = origin[edge][left], stop[left], who[left], step + 1
    count = np.zeros(len(begin), dtype=np.int64)
    for who, _ in drawn:
        count[who] += 1
    last = np.cumsum(count) - 1
    out = np.empty(int(count.sum()), dtype=np.int32)
    for step, (who, got) in enumerate(drawn):
        out[last[who] - step] = got
    return out, np.bincount(row, count, minlength=n).astype(np.int64)


def decode_block(v: Vocabulary, pieces: np.ndarray) -> np.ndarray:
    """Bytes of the pieces behind each other."""
    return v.flat[_ranges(v.begin[pieces], v.begin[pieces + 1] - v.begin[pieces])]


def _sampled(batch, text: str, v: Vocabulary, seed: int):
    keys = batch.column("_key").to_numpy()
    for begin, end, data, offsets in textgrid.blocks(batch.column(text), BLOCK):
        pieces, count = sample_block(v, data, offsets, keys[begin:end], seed)
        decoded = decode_block(v, pieces)
        if len(decoded) != len(data) or not (decoded == data).all():
            raise RuntimeError("pieces do not give back the text: two chunks of a block share a 64-bit hash")
        yield begin, end, pieces, count


def encode(docs: DataFrame, v: Vocabulary, key: Column, seed: int = 0, text: str = "text", keep: tuple[str, ...] = ("doc_id",), out: str = "pieces") -> DataFrame:
    """The columns ``keep`` and the array ``out`` of sampled piece ids. One pass, no shuffle."""
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField(out, T.ArrayType(T.IntegerType(), False))])

    def encoded(batches):
        for batch in batches:
            for begin, end, pieces, count in _sampled(batch, text, v, seed):
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(pieces))
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(begin, end - begin) for c in keep], lists], names=schema.names)

    return docs.select(*keep, *([] if text in keep else [text]), F.xxhash64(key).alias("_key")).mapInArrow(encoded, schema)


def encode_digest(docs: DataFrame, v: Vocabulary, key: Column, seed: int = 0, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep``, ``n_pieces``, ``pieces_sha256`` (of the ids as 32-bit little-endian) and ``text_sha256`` of
    the decoded pieces, which equals that of the text."""
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("n_pieces", T.LongType()), T.StructField("pieces_sha256", T.StringType()),
                           T.StructField("text_sha256", T.StringType())])

    def digested(batches):
        for batch in batches:
            for begin, end, pieces, count in _sampled(batch, text, v, seed):
                cut = np.concatenate([[0], np.cumsum(count)])
                raw = pieces.astype("<i4")
                decoded, place = decode_block(v, pieces), np.concatenate([[0], np.cumsum(v.begin[pieces + 1] - v.begin[pieces])])
                digest = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(cut, cut[1:])]
                texts = [hashlib.sha256(decoded[place[a]:place[b]]).hexdigest() for a, b in zip(cut, cut[1:])]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(begin, end - begin) for c in keep], pa.array(count), pa.array(digest), pa.array(texts)], names=schema.names)

    return docs.select(*keep, *([] if text in keep else [text]), F.xxhash64(key).alias("_key")).mapInArrow(digested, schema)


def decode(encoded: DataFrame, v: Vocabulary, pieces: str = "pieces", keep: tuple[str, ...] = ("doc_id",), out: str = "text") -> DataFrame:
    """The columns ``keep`` and the text ``out`` that the piece ids spell; null ids give ""."""
    schema = T.StructType([*[encoded.schema[c] for c in keep], T.StructField(out, T.StringType())])

    def decoded(batches):
        for batch in batches:
            texts = [decode_block(v, np.array(x or [], dtype=np.int64)).tobytes().decode() for x in batch.column(pieces).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], pa.array(texts, pa.string())], names=schema.names)

    return encoded.select(*keep, pieces).mapInArrow(decoded, schema)
