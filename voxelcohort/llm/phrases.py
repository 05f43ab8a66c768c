"""Collocations: phrases of two to five words counted by multikey quicksort of suffix pointers, scored by their best cut.

Words are compared by 64-bit hashes. Three passes read the texts, each adding up map-side before it shuffles:

1. the occurrences of all phrases of one to five words, added up in 2^32 buckets of their hashes. A bucket travels as the
   low 16 bits of its number and its count, in blocks of neighbouring buckets, so what moves grows as the texts do;
2. words and pairs in buckets that reach the least count, each language with its number of words;
3. the suffix pointers, cut behind their longest beginning in such buckets. They are routed by their leading words, so
   that all pointers with the same beginning meet in one task. There a three-way multikey quicksort splits them by one word
   after the other: the size of a part with equal words is the count of that beginning, and parts below the least count
   are abandoned at once.

Which buckets reach the least count is known to tasks through a filter of at most ``FILTER_BITS`` bits; what it or a bucket
shared by several phrases lets through by mistake is counted by its words and then dropped. Pointers whose leading pair is
very common are routed by all their words instead, sorted without abandoning, and their partial counts are added up, so no
task gets a hot beginning.

Defined results: null texts are empty, null languages ``und``; empty texts hold no words; very long texts are cut between
pieces, so memory is bounded by ``BLOCK_BYTES`` or the longest piece; repeated rows count again; ties follow the order of
the result; empty tables give empty results; other columns are ignored. Equal hashes of different words are not detected:
their odds are below one in 10,000 for 50 million different words.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from voxelcohort.llm import textgrid
from voxelcohort.llm.textgrid import PLACE_STEP, mix
from voxelcohort.session import cut_lineage

LONGEST = 5
LEAST = 100
TOP = 2_000
BLOCK_BYTES = 1_048_576
FILTER_BITS = 1 << 27
# Buckets are dealt in parts of 2^PART_BITS, their places written in 16 bits by runs; occurrences held before they are added up.
PART_BITS = 22
RUN_BITS = 16
HELD_PHRASES = 6_000_000
# Parts in which the entries of a tally travel.
ENTRY_PARTS = 256
# A leading pair met more often than this is routed by all words; pointers sorted at once; entries held before emission.
HOT_PAIR = 200_000
SORTED_ROWS = 400_000
HELD_ROWS = 250_000
RANK_PARTS = 64

_ENDS = np.zeros(256, dtype=bool)
_ENDS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = True
_GAPS = _ENDS.copy()
_GAPS[[0x20, 0x09]] = True


def _parts(texts: pa.Array):
    """(row, bytes, offsets) blocks as of ``textgrid.blocks``; texts longer than a block are cut after an end of a piece."""
    for first, end, data, offsets in textgrid.blocks(texts, BLOCK_BYTES):
        if end - first > 1 or len(data) <= BLOCK_BYTES:
            yield np.arange(first, end), data, offsets
            continue
        ends = np.flatnonzero(_ENDS[data]) + 1
        start = 0
        while start < len(data):
            at = np.searchsorted(ends, start + BLOCK_BYTES)
            stop = int(ends[at]) if at < len(ends) else len(data)
            yield np.array([first]), data[start:stop], np.array([0, stop - start])
            start = stop


def words_of(data: np.ndarray, offsets: np.ndarray):
    """(hash, start, end, row, left) of each word; ``left`` counts the words from it to the end of its piece."""
    low = textgrid.LOWER[data]
    solid = np.where(_GAPS[data], np.uint8(32), np.uint8(97))
    starts, ends, row = textgrid.words(solid, offsets)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64), starts, ends, row, starts
    breaks = np.concatenate([[0], np.cumsum(_ENDS[data])])
    last = np.ones(len(starts), dtype=bool)
    last[:-1] = (row[1:] != row[:-1]) | (breaks[starts[1:]] != breaks[ends[:-1]])
    final = np.flatnonzero(last)
    left = final[np.searchsorted(final, np.arange(len(starts)))] - np.arange(len(starts)) + 1
    return textgrid.spans_hash(low, starts, ends), starts, ends, row, left


def _languages(column: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Names, their hashes, and the name of each row."""
    code = column.fill_null("und").dictionary_encode()
    names = code.dictionary
    data = np.frombuffer("".join(f"{x}\n" for x in names.to_pylist()).encode(), dtype=np.uint8)
    ends = np.cumsum([len(x.encode()) + 1 for x in names.to_pylist()]) if len(names) else np.zeros(0, dtype=np.int64)
    hashes = textgrid.spans_hash(data, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends) if len(names) else np.zeros(0, dtype=np.uint64)
    return names, hashes, code.indices.to_numpy()


def passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether each key may be in the filter; never false for a key that is."""
    last = np.uint64(64 * len(bits) - 1)
    a, b = keys & last, (keys >> np.uint64(32)) & last
    inside = lambda slot: (bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1)
    return (inside(a) & inside(b)).astype(bool)


def _filter(keys: DataFrame) -> np.ndarray:
    """Filter of the column ``key``; its ones are formed by Spark, at most ``FILTER_BITS`` / 64 words reach the driver."""
    size = max(64, min(FILTER_BITS, 1 << (16 * keys.count()).bit_length()))
    slot = F.explode(F.array(F.col("key").bitwiseAND(size - 1), F.shiftrightunsigned("key", 32).bitwiseAND(size - 1)))
    words = keys.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(slot & 63 AS INT))")).alias("bits")).toArrow()
    bits = np.zeros(size // 64, dtype=np.uint64)
    bits[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return bits


def growing(h: np.ndarray, own: np.ndarray, left: np.ndarray, often: np.ndarray | None = None):
    """(places, keys) of the phrases of one word, of two, up to ``LONGEST``; a place whose phrase is in no bucket of the
    filter ``often`` is left out from there on."""
    at, key = np.arange(len(h)), mix(h ^ own)
    for width in range(1, LONGEST + 1):
        if width > 1:
            inside = left[at] >= width
            at = at[inside]
            key = mix((key[inside] * PLACE_STEP) ^ h[at + width - 1])
        if often is not None:
            kept = passes(often, mix(key >> np.uint64(32)))
            at, key = at[kept], key[kept]
        yield at, key


def _often(docs: DataFrame, least: int) -> DataFrame:
    """(key) of the buckets in which phrases of one to ``LONGEST`` words occur ``least`` times, by a mixed bucket number."""
    runs, inside = 1 << (PART_BITS - RUN_BITS), (1 << RUN_BITS) - 1

    def blocks(batches):
        held, size = [], 0

        def closed():
            buckets, counts = np.unique(np.concatenate(held), return_counts=True)
            run = np.searchsorted(buckets, np.arange(0, (1 << 32) + 1, 1 << RUN_BITS))
            low, times = (buckets & inside).astype(np.uint16), np.minimum(counts, least).astype(np.int32)
            cut = run[::runs]
            parts = np.flatnonzero(np.diff(cut))
            per = np.diff(run).astype(np.int32).reshape(-1, runs)
            binary = lambda values: pa.array([values[cut[k]:cut[k + 1]].tobytes() for k in parts], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(parts.astype(np.int32)), pa.array([per[k].tobytes() for k in parts], pa.binary()), binary(low), binary(times)], names=["part", "per", "low", "times"])

        for batch in batches:
            _, hashes, of = _languages(batch.column(0))
            for rows, data, offsets in _parts(batch.column(1)):
                h, _, _, row, left = words_of(data, offsets)
                for _, key in growing(h, hashes[of[rows][row]], left):
                    held.append((key >> np.uint64(32)).astype(np.uint32))
                    size += len(key)
                if size >= HELD_PHRASES:
                    yield closed()
                    held, size = [], 0
        if size:
            yield closed()

    def summed(batches):
        part, total = None, np.zeros(1 << PART_BITS, dtype=np.int32)

        def closed():
            found = np.flatnonzero(total >= least).astype(np.uint64)
            return pa.RecordBatch.from_arrays([pa.array(mix(found + np.uint64((part or 0) << PART_BITS)).view(np.int64))], names=["key"])

        for batch in batches:
            for own, per, low, times in zip(*[batch.column(k).to_pylist() for k in range(4)]):
                if own != part:
                    yield closed()
                    part = own
                    total[:] = 0
                place = (np.repeat(np.arange(runs), np.frombuffer(per, dtype=np.int32)) << RUN_BITS) + np.frombuffer(low, dtype=np.uint16)
                total[place] = np.minimum(total[place] + np.frombuffer(times, dtype=np.int32), least)  # a block names a bucket once
        yield closed()

    dealt = docs.mapInArrow(blocks, "part int, per binary, low binary, times binary").repartition("part").sortWithinPartitions("part")
    return dealt.mapInArrow(summed, "key long")


class Tally:
    """Counts by 64-bit key with one example row a key, merged whenever many entries have gathered."""

    def __init__(self):
        self.parts, self.rows = [], 0

    def add(self, keys: np.ndarray, counts: np.ndarray, rows: pa.Table):
        """Full tallies come back as (keys, counts, rows)."""
        self.parts.append((keys, counts, rows))
        self.rows += len(keys)
        if self.rows > 2 * HELD_ROWS:
            full = self.merged()
            if self.rows > HELD_ROWS:
                self.parts, self.rows = [], 0
                yield full

    def merged(self):
        if not self.parts:
            return None
        keys, counts = (np.concatenate([p[k] for p in self.parts]) for k in (0, 1))
        keys, first, of = np.unique(keys, return_index=True, return_inverse=True)
        counts = np.bincount(of, counts).astype(np.int64)
        rows = pa.concat_tables([p[2] for p in self.parts]).take(first).combine_chunks()
        self.parts, self.rows = [(keys, counts, rows)], len(keys)
        return keys, counts, rows


def _tallied(docs: DataFrame, found, schema: str) -> DataFrame:
    """Rows of ``found(names, name hashes, name of row, data, offsets)`` -> (keys, counts, row table) blocks, added up in
    each task and again where the entries of a part of the keys meet; the schema ends with the count."""
    names = [c.split()[0] for c in schema.split(", ")]

    def counted(batches):
        tally = Tally()

        def batch_of(full):
            keys, counts, rows = full
            part = (keys % np.uint64(ENTRY_PARTS)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            cut = np.searchsorted(part[order], np.arange(ENTRY_PARTS + 1)).astype(np.int32)
            columns = [pa.array(keys.view(np.int64)), *[c.combine_chunks() for c in rows.columns], pa.array(counts)]
            entries = pa.StructArray.from_arrays([c.take(pa.array(order)) for c in columns], names=["whole", *names])
            parts = np.flatnonzero(np.diff(cut))
            return pa.RecordBatch.from_arrays(
                [pa.array(parts.astype(np.int32)), pa.ListArray.from_arrays(pa.array(np.append(cut[parts], cut[-1])), entries)], names=["part", "entries"])

        for batch in batches:
            langs, hashes, of = _languages(batch.column(0))
            for row, data, offsets in _parts(batch.column(1)):
                for full in tally.add(*found(langs, hashes, of[row], data, offsets)):
                    yield batch_of(full)
        last = tally.merged()
        if last and len(last[0]):
            yield batch_of(last)

    def added(batches):
        tally = Tally()

        def batch_of(full):
            _, counts, rows = full
            return pa.RecordBatch.from_arrays([*[c.combine_chunks() for c in rows.columns], pa.array(counts)], names=names)

        for batch in batches:
            for first in range(0, len(batch), 64):
                whole, *columns, counts = batch.column("entries").slice(first, 64).flatten().flatten()
                for full in tally.add(whole.to_numpy().view(np.uint64), counts.to_numpy(), pa.table(columns, names=names[:-1])):
                    yield batch_of(full)
        last = tally.merged()
        if last:
            yield batch_of(last)

    entry = ", ".join(f"{c.split()[0]}: {c.split()[1]}" for c in schema.split(", "))
    blocks = docs.mapInArrow(counted, f"part int, entries array<struct<whole: long, {entry}>>")
    return blocks.repartition("part").select("entries").mapInArrow(added, schema)


def _unique(keys: np.ndarray):
    keys, first, counts = np.unique(keys, return_index=True, return_counts=True)
    return keys, first, counts.astype(np.int64)


def _bytes(matrix: np.ndarray, width: np.ndarray) -> pa.Array:
    """Row paths as binary: the first ``width`` of each row's hashes, eight bytes each."""
    keep = np.arange(matrix.shape[1])[None, :] < width[:, None]
    offsets = np.concatenate([[0], np.cumsum(width) * 8]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(width), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(matrix[keep]))])


def _short_counts(docs: DataFrame, often) -> DataFrame:
    """(lang, word, path, key, c) of words and of pairs, whose word is null, in the buckets of the filter; the row with an
    empty path counts all words of the language."""

    def found(langs, hashes, of, data, offsets):
        h, starts, ends, row, left = words_of(data, offsets)
        levels = growing(h, hashes[of[row]], left, often.value)
        (at, one), (two_at, two) = next(levels), next(levels)
        (one, first, c1), (two, two_first, c2) = _unique(one), _unique(two)
        at, two_at = at[first], two_at[two_first]
        low = textgrid.LOWER[data]
        size = ends[at] - starts[at]
        cut = np.concatenate([[0], np.cumsum(size)]).astype(np.int64)
        flat = low[np.arange(cut[-1]) - np.repeat(cut[:-1], size) + np.repeat(starts[at], size)]
        text = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(cut.astype(np.int32)), pa.py_buffer(flat)])
        total = np.bincount(of[row], minlength=len(langs)).astype(np.int64)
        path = np.zeros((len(at) + len(two_at) + len(langs), 2), dtype=np.uint64)
        path[:len(at), 0] = h[at]
        path[len(at):len(at) + len(two_at)] = np.column_stack([h[two_at], h[two_at + 1]])
        keys = np.concatenate([one, two, hashes])
        rows = pa.table({
            "lang": pa.concat_arrays([langs.take(pa.array(of[row[np.concatenate([at, two_at])]])), langs]),
            "word": pa.concat_arrays([text, pa.nulls(len(two_at) + len(langs), pa.string())]),
            "path": _bytes(path, np.repeat([1, 2, 0], [len(at), len(two_at), len(langs)])), "key": keys.view(np.int64)})
        return keys, np.concatenate([c1, c2, total]), rows

    counted = _tallied(docs, found, "lang string, word string, path binary, key long, c long")
    return counted.groupBy("lang", "word", "path").agg(F.min("key").alias("key"), F.sum("c").alias("c"))


def _pointers(docs: DataFrame, often, hot) -> DataFrame:
    """(lang, path, route, hot, c): suffix pointers of three words and more, cut behind the last beginning in a bucket of
    the filter."""

    def found(langs, hashes, of, data, offsets):
        h, _, _, row, left = words_of(data, offsets)
        width, pair = np.ones(len(h), dtype=np.int64), np.zeros(len(h), dtype=np.uint64)
        for words, (at, key) in enumerate(growing(h, hashes[of[row]], left, often.value), 1):
            width[at] = words
            if words == 2:
                pair[at] = key
        at = np.flatnonzero(width > 2)
        width, pair = width[at], pair[at]
        path = np.zeros((len(at), LONGEST), dtype=np.uint64)
        for k in range(LONGEST):
            path[:, k] = np.where(k < width, h[np.minimum(at + k, len(h) - 1)], 0) if len(at) else 0
        common = passes(hot.value, pair)
        route = mix(pair * PLACE_STEP ^ path[:, 2])
        whole = mix(mix(route * PLACE_STEP ^ path[:, 3]) * PLACE_STEP ^ path[:, 4])
        keys, first, counts = _unique(whole)
        rows = pa.table({
            "lang": langs.take(pa.array(of[row[at[first]]])), "path": _bytes(path[first], width[first]),
            "route": np.where(common, whole, route)[first].view(np.int64), "hot": pa.array(common[first])})
        return keys, counts, rows

    return _tallied(docs, found, "lang string, path binary, route long, hot boolean, c long")


def quicksorted(keys: np.ndarray, weights: np.ndarray, least: int):
    """Three-way multikey quicksort of pointers, one column a word, zero behind the last one.

    Yields (pointer, words, count) of every beginning of at least ``least`` occurrences; other parts are abandoned.
    """
    open_ = [(np.arange(len(keys)), 0)]
    while open_:
        rows, depth = open_.pop()
        if not len(rows) or weights[rows].sum() < least:
            continue
        here = keys[rows, depth]
        pivot = np.sort(here[[0, len(here) // 2, -1]])[1]
        below, same = here < pivot, here == pivot
        equal = rows[same]
        open_ += [(rows[below], depth), (rows[~below & ~same], depth)]
        if pivot and (count := int(weights[equal].sum())) >= least:
            yield int(equal[0]), depth + 1, count
            if depth + 1 < keys.shape[1]:
                open_.append((equal, depth + 1))


def beginnings(keys: np.ndarray, weights: np.ndarray):
    """The same for all beginnings, however rare, by sorting hashes of them."""
    rolled = np.zeros(len(keys), dtype=np.uint64)
    for depth in range(keys.shape[1]):
        rolled = mix(rolled * PLACE_STEP ^ keys[:, depth])
        there = np.flatnonzero(keys[:, depth])
        if len(there):
            _, first, of = np.unique(rolled[there], return_index=True, return_inverse=True)
            yield there[first], np.full(len(first), depth + 1), np.bincount(of, weights[there]).astype(np.int64)


def _sorted_counts(pointers: DataFrame, least: int) -> DataFrame:
    """(lang, path, c) of phrases of three words and more."""

    def counted(batches):
        held, rows = [], 0

        def closed(table: pa.Table):
            langs, hashes, of = _languages(table["lang"].combine_chunks())
            path = table["path"].combine_chunks()
            cut = np.frombuffer(path.buffers()[1], dtype=np.int32)[path.offset:path.offset + len(path) + 1] // 8
            width = np.diff(cut)
            flat = np.frombuffer(path.buffers()[2], dtype=np.uint64)[cut[0]:cut[-1]] if len(path) else np.zeros(0, dtype=np.uint64)
            keys = np.zeros((len(path), LONGEST), dtype=np.uint64)
            keys[np.arange(LONGEST)[None, :] < width[:, None]] = flat
            keys = np.column_stack([hashes[of], keys])
            weights, hot = table["c"].to_numpy(), table["hot"].to_numpy(zero_copy_only=False)
            some = np.flatnonzero(~hot)
            found = list(quicksorted(keys[some], weights[some], least))
            out = [(some[[f[0] for f in found]], np.array([f[1] for f in found]), np.array([f[2] for f in found]))] if found else []
            some = np.flatnonzero(hot)
            out += [(some[p], d, c) for p, d, c in beginnings(keys[some], weights[some])]
            for pointer, depth, count in out:
                deep = depth > 3  # the first column is the language
                pointer, depth = pointer[deep], depth[deep] - 1
                yield pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(of[pointer])), _bytes(keys[pointer, 1:], depth), pa.array(count[deep].astype(np.int64))], names=["lang", "path", "c"])

        for batch in batches:
            held.append(pa.Table.from_batches([batch]))
            rows += len(batch)
            if rows >= SORTED_ROWS:
                table = pa.concat_tables(held).combine_chunks()
                route = table["route"].to_numpy()
                whole = int(np.searchsorted(route, route[-1]))  # pointers of one route stay together
                if whole:
                    yield from closed(table.slice(0, whole))
                    held, rows = [table.slice(whole)], len(table) - whole
        if rows:
            yield from closed(pa.concat_tables(held).combine_chunks())

    dealt = pointers.repartition("route").sortWithinPartitions("route")
    return dealt.mapInArrow(counted, "lang string, path binary, c long").groupBy("lang", "path").agg(F.sum("c").alias("c")).filter(F.col("c") >= least)


def _cut(path: Column, start: Column | int, words: Column | int) -> Column:
    return F.substring(path, 8 * (F.lit(start) if isinstance(start, int) else start) + 1, 8 * (F.lit(words) if isinstance(words, int) else words))


def phrase_counts(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Totals (lang, n), words (path, word) and counts (lang, path, words, f) of phrases of one to ``LONGEST`` words that occur
    ``least`` times. A path is the eight-byte hashes of its words."""
    context = docs.sparkSession.sparkContext
    docs = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.col(text).cast("string").alias("text"))
    often = context.broadcast(_filter(cut_lineage(_often(docs, least))))
    found = cut_lineage(_short_counts(docs, often).filter((F.col("c") >= least) | (F.length("path") == 0)))
    totals, words, pairs = (found.filter(F.length("path") == 8 * k) for k in range(3))
    hot = context.broadcast(_filter(pairs.filter(F.col("c") > HOT_PAIR)))
    longer = cut_lineage(_sorted_counts(_pointers(docs, often, hot), least))
    totals = totals.select("lang", F.col("c").alias("n"))
    counts = reduce(DataFrame.unionByName, [t.select("lang", "path", "c") for t in (words, pairs, longer)])
    return totals, words.select("path", "word").distinct(), counts.select("lang", "path", (F.length("path") / 8).cast("int").alias("words"), F.col("c").alias("f"))


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of each language by the score of their worst cut.

    A phrase that only ever occurs inside one longer phrase gives way to it. ``a`` counts the phrase, ``l`` and ``r`` its
    parts before and after the cut, ``n`` the words of the language; the score is 1000 * a * n / (l * r), rounded down.
    """
    totals, words, counts = phrase_counts(docs, least, text, lang)
    phrases = counts.filter("words > 1").withColumnRenamed("f", "a")
    inner = phrases.filter("words > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("words") - F.col("size"))))
    inner = inner.groupBy("lang", _cut(F.col("path"), F.col("start"), F.col("size")).alias("path")).agg(F.max("a").alias("inside"))
    kept = phrases.join(inner, ["lang", "path"], "left").filter("inside is null or inside < a")
    cuts = kept.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    for side, part in (("l", _cut(F.col("path"), 0, F.col("k"))), ("r", _cut(F.col("path"), F.col("k"), F.col("words") - F.col("k")))):
        sizes = counts.select(F.col("lang"), F.col("path").alias("part"), F.col("f").alias(side))
        cuts = cuts.withColumn("part", part).join(sizes, ["lang", "part"]).drop("part")
    big = lambda name: f"cast({name} as decimal(18, 0))"
    score = F.expr(f"({big('a')} * {big('n')} * 1000) div ({big('l')} * {big('r')})")
    scored = cuts.join(totals, "lang").withColumn("score", score).groupBy("lang", "path", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = cut_lineage(scored.select("lang", "path", "a", "cut.l", "cut.r", "n", "cut.score"))
    spelt = scored.select("lang", F.col("path").alias("whole"), F.posexplode(F.transform(F.sequence(F.lit(0), (F.length("path") / 8).cast("int") - 1), lambda x: _cut(F.col("path"), x, 1))).alias("at", "path"))
    spelt = spelt.join(words, "path").groupBy("lang", "whole").agg(F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    named = scored.join(spelt.withColumnRenamed("whole", "path"), ["lang", "path"]).withColumn("phrase", F.array_join("w.word", " "))
    order = [F.desc("score"), F.desc("a"), F.col("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    few = named.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


OP12_SQL = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\f\r]')) AS piece FROM documents
), worded AS (
  SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS ws FROM pieces
), sized AS (
  SELECT lang, ws, unnest(range(1, 6)) AS k FROM worded
), placed AS (
  SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM sized WHERE len(ws) >= k
), f AS (
  SELECT lang, k, array_to_string(list_slice(ws, i, i + k - 1), ' ') AS phrase, count(*) AS f FROM placed GROUP BY ALL HAVING count(*) >= 100
), n AS (
  SELECT lang, sum(len(ws)) AS n FROM worded GROUP BY lang
), candidate AS (
  SELECT lang, k, phrase, string_split(phrase, ' ') AS ws, f AS a FROM f WHERE k > 1
), longer AS (
  SELECT lang, ws, k, a, unnest(range(2, k)) AS size FROM candidate
), inner_part AS (
  SELECT lang, ws, size, a, unnest(range(1, k - size + 2)) AS i FROM longer
), inside AS (
  SELECT lang, array_to_string(list_slice(ws, i, i + size - 1), ' ') AS phrase, max(a) AS most FROM inner_part GROUP BY ALL
), kept AS (
  SELECT c.* FROM candidate c LEFT JOIN inside i USING (lang, phrase) WHERE i.most IS NULL OR 100 * i.most < 100 * c.a
), cut AS (
  SELECT lang, phrase, ws, k, a, unnest(range(1, k)) AS cutk FROM kept
), scored AS (
  SELECT c.lang, c.phrase, c.a, l.f AS l, r.f AS r, n.n, c.cutk,
    (1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS score
  FROM cut c JOIN n USING (lang)
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(list_slice(c.ws, 1, c.cutk), ' ')
  JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(list_slice(c.ws, c.cutk + 1, c.k), ' ')
), worst AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cutk) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r,
  n::BIGINT AS n, score::BIGINT AS score FROM worst QUALIFY rank <= 2000
"""
