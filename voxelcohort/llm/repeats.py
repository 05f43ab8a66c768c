"""Substring dedup by recompression: rounds name runs and pairs of tokens everywhere alike, so equal substrings carry
equal symbols inside, and shared symbols reveal and prove repeats.

A window is ``WINDOW`` consecutive words of one document. A word goes if some window over it also starts in a document
with a smaller id. Three steps, each cheaper than comparing all windows:

1. After ``ROUNDS`` rounds, neighbouring symbols (about 20 words) that an earlier document has too prove all windows
   inside them. Proven windows need no further look, neither as repeats nor as evidence: an earlier document has them.
2. Symbol borders after two pair rounds depend on four words only, so equal windows have equal borders. Each unproven
   window elects one border inside it by the hash of the six words around; borders elected in one document only clear
   their windows.
3. The windows left are named whole, and those that an earlier document has are repeats.

Names are 64-bit hashes, the same in every task, so a round needs no exchange of names; two different sequences share a
name with odds of about (number of names)^2 / 2^65. Only names, ids and positions are shuffled, never texts: the documents
are written once to the shared folder, bucketed by their unit of reading, and joined there without an exchange.

Defined results: null, empty and short texts keep all their words; a document without id keeps its words and is no
evidence; rows sharing an id are compared with smaller ids only; empty tables give empty results; other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelcohort.llm import textgrid, units
from voxelcohort.llm.piece_sampling import _ranges
from voxelcohort.llm.textgrid import PLACE_STEP, mix
from voxelcohort.session import scratch_path

WINDOW = 13
ROUNDS = 8
REACH = 3  # words on each side of a border that name it
_SALT = [np.uint64(x) for x in np.random.default_rng(9).integers(1, 2**63 - 1, size=64)]


def run_round(symbol: np.ndarray, first: np.ndarray, row: np.ndarray):
    """Maximal runs of one symbol in one document become one symbol named after it and its number."""
    head = np.ones(len(symbol), dtype=bool)
    head[1:] = (symbol[1:] != symbol[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(head)
    n = np.diff(np.append(at, len(symbol))).astype(np.uint64)
    return np.where(n > 1, mix(symbol[at] + n * PLACE_STEP), symbol[at]), first[at], row[at]


def pair_round(symbol: np.ndarray, first: np.ndarray, row: np.ndarray, number: int):
    """A symbol that this round calls left and its neighbour that it calls right become one symbol."""
    right = mix(symbol ^ _SALT[number]) >> np.uint64(63) == 1
    joined = np.zeros(len(symbol), dtype=bool)
    joined[:-1] = ~right[:-1] & right[1:] & (row[1:] == row[:-1])
    at = np.flatnonzero(joined)
    symbol = symbol.copy()
    symbol[at] = mix(symbol[at] * _SALT[32] + symbol[at + 1])
    keep = np.ones(len(symbol), dtype=bool)
    keep[at + 1] = False
    return symbol[keep], first[keep], row[keep]


def _tail(offset: np.ndarray, row: np.ndarray) -> np.ndarray:
    return offset[row + 1]


def high_symbols(hashes: np.ndarray, row: np.ndarray, offset: np.ndarray):
    """(name, first word, words, row) of neighbouring high-level symbols that hold at least one window."""
    symbol, first, of = hashes, np.arange(len(hashes)), row
    for number in range(ROUNDS):
        symbol, first, of = run_round(symbol, first, of)
        symbol, first, of = pair_round(symbol, first, of, number)
    if not len(symbol):
        return symbol, first, first, of
    last = np.append(first[1:], len(hashes))
    paired = np.append(of[1:] == of[:-1], False)
    alone = ~paired & (np.append(True, of[1:] != of[:-1]))
    after = np.append(symbol[1:], np.uint64(0))
    name = np.where(paired, mix(symbol * _SALT[33] + after), mix(symbol * _SALT[34]))
    end = np.where(paired, np.append(last[1:], 0), last)
    use = (paired | alone) & (end - first >= WINDOW)
    return name[use], first[use], (end - first)[use], of[use]


def _rolled(hashes: np.ndarray, n: int, salt: np.uint64) -> np.ndarray:
    """Name of the ``n`` words from each place on; the last n - 1 places are not valid."""
    out = np.zeros(len(hashes), dtype=np.uint64)
    for k in range(n):
        out[:len(hashes) - k] = (out[:len(hashes) - k] ^ (out[:len(hashes) - k] >> np.uint64(29))) * salt + hashes[k:]
    return mix(out)


def elected_borders(hashes: np.ndarray, row: np.ndarray, offset: np.ndarray):
    """(border elected by the window from each word on, name of the words around each border)."""
    n = len(hashes)
    symbol, first, of = hashes, np.arange(n), row
    for number in (0, 1):
        symbol, first, of = pair_round(symbol, first, of, 40 + number)
    name = np.zeros(n, dtype=np.uint64)
    around = _rolled(hashes, 2 * REACH, _SALT[35] | np.uint64(1))
    inside = first[(first - REACH >= offset[of]) & (first + REACH <= _tail(offset, of))]
    name[inside] = around[inside - REACH]
    rank = np.full(n + 16, np.uint64(2**64 - 1))
    rank[inside] = np.minimum(name[inside], np.uint64(2**64 - 2))
    # least name among the borders at least REACH words inside the window, by doubling: 2, 4, 8 places
    best = np.arange(n + 16)
    for width in (1, 2, 4):
        other = best[width:]
        mine = best[:-width]
        best = np.where(rank[mine] <= rank[other], mine, other)
    place = np.minimum(np.arange(n) + REACH, len(best) - 1)
    return best[place], name


def _span_flags(n: int, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, begin, 1)
    np.add.at(change, end, -1)
    return np.cumsum(change[:-1]) > 0


class _Block:
    """Words of one block of documents with the marks found so far: spans that are repeats, and elected borders."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, marks: pa.Array | None):
        self.data = data
        self.starts, self.ends, self.row = textgrid.words(data, offsets)
        self.hashes = textgrid.spans_hash(data, self.starts, self.ends)
        self.offset = np.searchsorted(self.row, np.arange(len(offsets)))
        n = len(self.starts)
        self.windows = np.arange(n) + WINDOW <= self.offset[self.row + 1] if n else np.zeros(0, dtype=bool)
        self.span = self.size = np.zeros(0, dtype=np.int64)
        if marks is not None:
            marks = marks.fill_null([]) if marks.null_count else marks
            bounds = marks.offsets.to_numpy().astype(np.int64)
            code = marks.values.to_numpy()[bounds[0]:bounds[-1]]
            of = np.repeat(np.arange(len(marks)), np.diff(bounds))
            self.span, self.size = (code >> 32) + self.offset[of], code & 0xFFFFFFFF
        long = self.size > 0
        self.repeat = _span_flags(n, self.span[long], (self.span + self.size)[long])
        self.proven = _span_flags(n, self.span[long], (self.span + self.size - WINDOW + 1)[long])
        self.borders = self.span[~long]


def _in_document(name: np.ndarray, row: np.ndarray) -> np.ndarray:
    return mix(name ^ (row.astype(np.uint64) * _SALT[37]))


def _emit(name: np.ndarray, place: np.ndarray, size: np.ndarray | int, row: np.ndarray, offset: np.ndarray, ids: pa.Array, rids: np.ndarray):
    known = ~np.isnan(ids.to_numpy(zero_copy_only=False).astype(float))[row] if ids.null_count else np.ones(len(row), dtype=bool)
    code = ((place - offset[row]) << 32) + size
    of = row[known]
    return pa.RecordBatch.from_arrays(
        [pa.array(name[known].view(np.int64)), ids.take(pa.array(of)), pa.array(rids[of]), pa.array(code[known])], names=["name", "id", "rid", "mark"])


_ROW = "name long, id long, rid long, mark long"


def _named(held: DataFrame, what: str) -> DataFrame:
    """Names of one step with the document, its row and the place in it."""
    with_marks = what != "high"

    def named(batches):
        for batch in batches:
            ids, rids = batch.column("id"), batch.column("rid").to_numpy()
            for begin, end, data, offsets in textgrid.blocks(batch.column("text")):
                block = _Block(data, offsets, batch.column("marks").slice(begin, end - begin) if with_marks else None)
                own_ids, own_rids = ids.slice(begin, end - begin), rids[begin:end]
                if what == "high":
                    name, place, size, row = high_symbols(block.hashes, block.row, block.offset)
                    yield _emit(name, place, size, row, block.offset, own_ids, own_rids)
                    continue
                open_ = np.flatnonzero(block.windows & ~block.proven)
                border, around = elected_borders(block.hashes, block.row, block.offset)
                if what == "borders":
                    # one row for each name and document, however often a run repeats it
                    place = np.unique(border[open_])
                    place = place[np.unique(_in_document(around[place], block.row[place]), return_index=True)[1]]
                    # a border only selects what is looked at next, so 48 bits of its name are enough
                    yield _emit(around[place] >> np.uint64(16), place, 0, block.row[place], block.offset, own_ids, own_rids)
                else:
                    met = _in_document(around[block.borders], block.row[block.borders])
                    place = open_[np.isin(_in_document(around[border[open_]], block.row[open_]), met)]
                    name = _rolled(block.hashes, WINDOW, _SALT[36] | np.uint64(1))[place]
                    # equal windows next to each other, as in runs of one word, are one row over all their words
                    head = np.ones(len(place), dtype=bool)
                    head[1:] = (name[1:] != name[:-1]) | (place[1:] != place[:-1] + 1) | (block.row[place[1:]] != block.row[place[:-1]])
                    at = np.flatnonzero(head)
                    size = WINDOW - 1 + np.diff(np.append(at, len(place)))
                    yield _emit(name[at], place[at], size, block.row[place[at]], block.offset, own_ids, own_rids)

    return held.select("id", "rid", "text", *(["marks"] if with_marks else [])).mapInArrow(named, _ROW)


def _met(names: DataFrame, path: str, later: bool) -> DataFrame:
    """(rid, mark) of names that several documents have (``later``: that a document with a smaller id has).

    Totals are formed before the exchange, and the join back may split a frequent name over many tasks.
    """
    totals = names.groupBy("name").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    met = names.join(totals.select("name", "least"), "name")
    (met.filter("id > least") if later else met).select("rid", "mark").write.parquet(path)
    return names.sparkSession.read.parquet(path)


def _marked(held: DataFrame, marks: DataFrame, how: str) -> DataFrame:
    return units.with_lists(held, marks, F.col("mark"), "marks", how)


def remove_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_words, n_removed, kept): the words that stay, joined by one space."""
    return _final(docs, doc, text, False)


def digest_repeats(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_words, n_removed, kept_sha256): as ``remove_repeats`` with the SHA-256 of the kept text."""
    return _final(docs, doc, text, True)


def _final(docs: DataFrame, doc: str, text: str, digest: bool) -> DataFrame:
    spark = docs.sparkSession
    root = scratch_path(spark, "repeats")
    held = units.hold(docs, doc, text, f"{root}/units")
    high = _met(_named(held, "high"), f"{root}/high", later=True)
    borders = _met(_named(_marked(held, high, "left"), "borders"), f"{root}/borders", later=False)
    whole = _met(_named(_marked(held, high.unionByName(borders), "inner"), "windows"), f"{root}/windows", later=True)
    kept_column = "kept_sha256" if digest else "kept"

    def finished(batches):
        for batch in batches:
            for begin, end, data, offsets in textgrid.blocks(batch.column("text")):
                block = _Block(data, offsets, batch.column("marks").slice(begin, end - begin))
                stays = np.flatnonzero(~block.repeat)
                size = (block.ends - block.starts)[stays]
                out = np.full(int(size.sum()) + len(size), 32, dtype=np.uint8)
                target = np.cumsum(size + 1) - size - 1
                out[_ranges(target, size)] = data[_ranges(block.starts[stays], size)]
                cut = np.searchsorted(block.row[stays], np.arange(end - begin + 1))
                at = np.append(target, len(out))
                texts = [out[at[a]:max(at[a], at[b] - 1)].tobytes() for a, b in zip(cut, cut[1:])]
                n_words = np.diff(block.offset)
                values = pa.array([hashlib.sha256(x).hexdigest() for x in texts] if digest else [x.decode() for x in texts], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [batch.column("id").slice(begin, end - begin), pa.array(n_words), pa.array(n_words - np.diff(cut)), values],
                    names=[doc, "n_words", "n_removed", kept_column])

    return _marked(held, high.unionByName(whole), "left").select("id", "text", "marks").mapInArrow(
        finished, f"`{doc}` long, n_words long, n_removed long, {kept_column} string")
