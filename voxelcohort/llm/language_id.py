"""Language identification: multinomial naive Bayes over hashed character n-grams.

Texts become sequences of lower-cased letters in which every run of other characters is one blank, so digits, marks and
layout say nothing. All n-grams of one to four of these characters that hold a letter are hashed into ``FEATURES`` slots.
Slot counts of each language are summed over the learning rows by Spark; the smoothed log-probabilities, one column a
language, are broadcast (``FEATURES`` x ``MOST_LANGUAGES`` x 4 bytes at most), and texts are scored by sums of rows of
that matrix, ``SLICE`` characters at a time.

Learning takes all rows marked for it up to about ``SAMPLE_DOCS`` a language, chosen by a hash of the id before any text
is read; only slot counts reach the driver. The ``MOST_LANGUAGES`` languages with most rows are learned.

Defined results: null texts and texts without letters are ``und`` with score 0; rows with null language are not learned
from; equal texts are scored alike, ties go to the first language in name order; without a learned language everything
is ``und``; very long texts are read whole, in slices; empty tables give empty results; other columns are ignored, kept
ones may have any names but ``lang_pred`` and ``score``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelcohort.llm import textgrid
from voxelcohort.llm.textgrid import PLACE_STEP, mix

FEATURES = 1 << 16
LONGEST = 4
SAMPLE_DOCS = 20_000
MOST_LANGUAGES = 256
SMOOTHING = 0.5
SLICE = 1 << 17
UNKNOWN = "und"
BLANK = 32
LETTERS_END = 0x34000


def _fold() -> np.ndarray:
    """Lower-cased code point of every letter, a blank for everything else; no letter lies at or above ``LETTERS_END``."""
    fold = np.full(LETTERS_END, BLANK, dtype=np.uint32)
    for point in range(LETTERS_END):
        char = chr(point)
        if char.isalpha():
            low = char.lower()
            fold[point] = ord(low) if len(low) == 1 else point
    return fold


def _letters(data: np.ndarray, offsets: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded code points of a block, runs of blanks shortened to one, and where each row begins in them.

    Every row is followed by one blank, so no n-gram needs the row after it to know that its last word ends.
    """
    raw = data.tobytes()
    lead = (data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(lead)])[offsets]
    points = np.frombuffer(raw.decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    marked = np.insert(fold[np.minimum(points, LETTERS_END - 1)], chars[1:], BLANK)
    begin = chars + np.arange(len(chars))
    blank = marked == BLANK
    first = np.zeros(len(marked), dtype=bool)
    first[begin[:-1]] = True
    keep = ~blank
    keep[1:] |= ~blank[:-1] & ~first[1:]  # the first blank after a letter; rows never begin with one
    return marked[keep], np.concatenate([[0], np.cumsum(keep)])[begin]


def _slots(points: np.ndarray, begin: np.ndarray):
    """(slot, row) arrays of all n-grams, one pair for each length and slice; n-grams stay within a row."""
    for start in range(0, len(points), SLICE):
        some = points[start:start + SLICE + LONGEST - 1].astype(np.uint64)
        end = min(SLICE, len(points) - start)
        row = np.searchsorted(begin, np.arange(start, start + end), side="right") - 1
        last = begin[row + 1] - start
        rolled = np.zeros(end, dtype=np.uint64)
        for n in range(1, LONGEST + 1):
            whole = np.arange(end) + n <= last
            reach = max(0, min(end, len(some) - n + 1))
            rolled[:reach] = (rolled[:reach] ^ (rolled[:reach] >> np.uint64(29))) * PLACE_STEP + some[n - 1:n - 1 + reach]
            whole[reach:] = False
            if n == 1:
                whole &= some[:end] != BLANK
            slot = mix(rolled[whole] + np.uint64(n)) & np.uint64(FEATURES - 1)
            yield slot.astype(np.int64), row[whole]


@dataclass(frozen=True)
class LanguageModel:
    """Languages in name order, log-probabilities of slots (rows) in them (columns), log shares of the languages."""

    languages: tuple[str, ...]
    weights: np.ndarray
    prior: np.ndarray


def fit(docs: DataFrame, learn: Column, doc: str = "doc_id", text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS) -> LanguageModel:
    """Learn from the rows marked by ``learn`` whose language is not null."""
    known = docs.filter(learn).select(F.col(doc).cast("string").alias("id"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")).filter("lang is not null")
    shares = known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MOST_LANGUAGES).collect()
    sizes = {r["lang"]: r["count"] for r in sorted(shares, key=lambda r: r["lang"])}
    names = tuple(sizes)
    code = {name: k for k, name in enumerate(names)}
    width = len(names)
    share = F.coalesce(*[F.when(F.col("lang") == F.lit(k), min(1.0, sample_docs / n)) for k, n in sizes.items()]) if names else F.lit(0.0)
    drawn = F.pmod(F.xxhash64(F.coalesce("id", F.lit(""))), F.lit(1 << 30)) < share * (1 << 30)

    def counted(batches):
        fold, total = _fold(), np.zeros(FEATURES * width, dtype=np.int64)
        for batch in batches:
            of = np.array([code[x] for x in batch.column("lang").to_pylist()], dtype=np.int64)
            for first, _, data, offsets in textgrid.blocks(batch.column("text")):
                for slot, row in _slots(*_letters(data, offsets, fold)):
                    total += np.bincount(slot * width + of[row + first], minlength=len(total))
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], names=["cell", "c"])

    totals = known.filter(drawn).select("text", "lang").mapInArrow(counted, "cell long, c long").groupBy("cell").agg(F.sum("c").alias("c")).toArrow()
    table = np.zeros(FEATURES * width)
    table[totals["cell"].to_numpy()] = totals["c"].to_numpy()
    table = table.reshape(FEATURES, width) + SMOOTHING
    seen = np.array(list(sizes.values()), dtype=float)
    return LanguageModel(names, np.log(table / table.sum(axis=0)).astype(np.float32), np.log(seen / seen.sum()) if width else seen)


def sums(data: np.ndarray, offsets: np.ndarray, weights: np.ndarray, fold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-likelihood of each row in each language, and whether the row has a letter."""
    n_rows = len(offsets) - 1
    points, begin = _letters(data, offsets, fold)
    out = np.zeros((n_rows, weights.shape[1]))
    for slot, row in _slots(points, begin):
        if len(slot):
            starts = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
            out[row[starts]] += np.add.reduceat(weights[slot], starts, axis=0, dtype=np.float64)
    return out, np.diff(begin) > 0


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns with ``lang_pred`` and ``score``, the probability of that language given the text."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.prior))
    names = np.array([*model.languages, UNKNOWN], dtype=object)
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predicted(batches):
        (weights, prior), fold = shared.value, _fold()
        width = len(prior)
        for batch in batches:
            best, score = np.full(len(batch), width), np.zeros(len(batch))
            for first, end, data, offsets in textgrid.blocks(batch.column(batch.num_columns - 1)):
                if not width:
                    continue
                found, lettered = sums(data, offsets, weights, fold)
                found += prior
                top = found.argmax(axis=1)
                odds = np.exp(found - found.max(axis=1, keepdims=True))
                best[first:end] = np.where(lettered, top, width)
                score[first:end] = np.where(lettered, 1 / odds.sum(axis=1), 0.0)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(k) for k in range(len(keep))], pa.array(names[best], pa.string()), pa.array(score)], names=schema.names)

    return docs.select(*keep, F.col(text).cast("string").alias("_text")).mapInArrow(predicted, schema)
