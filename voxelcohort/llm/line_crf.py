"""Document quality from a linear-chain conditional random field over lines.

Each line carries dense counts (letters, capitals, symbols, repeated words ...) of itself and of the lines before and
after it. A two-state chain (good, bad) gives every line a forward-backward marginal; a document's quality is the mean
of its lines' marginals, weighted by their length, passed through a fitted logistic curve.

Defined results: a null, empty or blank text has no line and scores 0; a blank line is no line; repeated rows are
scored alike; empty tables give empty results; columns other than the named ones are passed through or ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelcohort.llm import textgrid

# Bounds of the fitting sample: labelled documents taken by hash, and the longest of them that may take part.
SAMPLE_DOCS = 4_000
SAMPLE_LINES = 400
THRESHOLD = 0.5

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,;:?'\"-()")] = True
_BANG = np.zeros(256, dtype=bool)
_BANG[33] = True
_SYMBOL = ~(_LETTER | _DIGIT | _STOP | _BANG | textgrid.IS_SPACE)
N_OWN = 12


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a / np.maximum(b, 1)


def line_counts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(line features, row of each line, byte length of each line) of one block of texts."""
    starts, ends, row = textgrid.words(data, offsets)
    if not len(starts):
        return np.zeros((0, N_OWN)), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    heads = np.unique(np.concatenate([offsets[:-1], np.flatnonzero(data == 10) + 1]))
    of_word = np.searchsorted(heads, starts, side="right") - 1
    new = np.flatnonzero(np.diff(of_word, prepend=-1))
    line = np.repeat(np.arange(len(new)), np.diff(np.append(new, len(starts))))
    first, last = starts[new], ends[np.append(new[1:], len(starts)) - 1]
    n_words, n_bytes = np.diff(np.append(new, len(starts))), last - first
    count = lambda kind: textgrid.per_span(kind[data], first, last)
    letters, upper, digits = count(_LETTER), count(_UPPER), count(_DIGIT)
    symbols, bangs, stops = count(_SYMBOL), count(_BANG), count(_STOP)
    lengths = ends - starts
    hashes = textgrid.spans_hash(textgrid.LOWER[data], starts, ends)
    tagged = textgrid.mix(hashes + line.astype(np.uint64) * textgrid.PLACE_STEP)
    order = np.argsort(tagged)
    fresh = np.ones(len(order), dtype=bool)
    fresh[1:] = tagged[order][1:] != tagged[order][:-1]
    distinct = np.bincount(line[order][fresh], minlength=len(new))
    again = np.zeros(len(starts), dtype=bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & (line[1:] == line[:-1])
    features = np.column_stack([
        np.log1p(n_bytes) / 5,
        np.log1p(n_words) / 4,
        _ratio(upper, letters) * 3,
        _ratio(digits, n_bytes) * 10,
        np.minimum(_ratio(symbols, n_words), 4),
        np.minimum(_ratio(bangs, n_words), 3),
        np.minimum(_ratio(stops, n_words), 3),
        np.minimum(_ratio(n_bytes, n_words) / 8, 4),
        1 - _ratio(distinct, n_words),
        _ratio(np.bincount(line[again], minlength=len(new)), n_words) * 3,
        _ratio(np.bincount(line[lengths <= 3], minlength=len(new)), n_words) * 2,
        np.minimum(np.maximum.reduceat(lengths, new) / 20, 5),
    ])
    return features, row[new], n_bytes


def with_neighbours(own: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Constant, own features, and those of the previous and next line of the same document, with flags for its ends."""
    n = len(own)
    linked = np.zeros(n + 1, dtype=bool)
    linked[1:-1] = row[1:] == row[:-1]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:] = own[:-1]
    after[:-1] = own[1:]
    has_before, has_after = linked[:-1, None], linked[1:, None]
    return np.hstack([np.ones((n, 1)), own, before * has_before, after * has_after, ~has_before, ~has_after])


def _log_odds_step(a: np.ndarray, turn: np.ndarray) -> np.ndarray:
    """log(P(next good)/P(next bad)) from log-odds ``a`` of the present state; ``turn`` [from, to] are log potentials."""
    return np.logaddexp(a + turn[1, 1], turn[0, 1]) - np.logaddexp(a + turn[1, 0], turn[0, 0])


def forward_backward(emit: np.ndarray, row: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log-odds of "good" for every line; all chains advance one line at a time together."""
    forward, backward = emit.copy(), np.zeros_like(emit)
    if not len(emit):
        return forward, backward
    head = np.flatnonzero(np.diff(row, prepend=-1))
    length = np.diff(np.append(head, len(row)))
    order = np.argsort(-length, kind="stable")
    head, length = head[order], length[order]
    alive = np.searchsorted(-length, -np.arange(1, length[0] + 1), side="right")
    for t in range(1, length[0]):
        at = head[:alive[t]] + t
        forward[at] += _log_odds_step(forward[at - 1], turn)
    for t in range(length[0] - 2, -1, -1):
        at = head[:alive[t + 1]] + t
        backward[at] = _log_odds_step(emit[at + 1] + backward[at + 1], turn.T)
    return forward, backward


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


@dataclass(frozen=True)
class LineCrf:
    """Emission weights, transition log potentials [from, to] and the logistic curve over the aggregated marginal."""

    weights: np.ndarray
    turn: np.ndarray
    slope: float
    offset: float

    def marginals(self, own: np.ndarray, row: np.ndarray) -> np.ndarray:
        forward, backward = forward_backward(with_neighbours(own, row) @ self.weights, row, self.turn)
        return _sigmoid(forward + backward)

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        own, row, size = line_counts(data, offsets)
        return self.curve(_aggregate(self.marginals(own, row), row, size, len(offsets) - 1))

    def curve(self, mean: np.ndarray) -> np.ndarray:
        inner = np.clip(np.nan_to_num(mean, nan=0.5), 1e-6, 1 - 1e-6)
        return np.where(np.isnan(mean), 0.0, _sigmoid(self.slope * np.log(inner / (1 - inner)) + self.offset))


def _aggregate(good: np.ndarray, row: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    weight = np.bincount(row, size, minlength=n)
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.bincount(row, size * good, minlength=n) / weight


def fit_chain(own: np.ndarray, row: np.ndarray, size: np.ndarray, label: np.ndarray, rounds: int = 150) -> LineCrf:
    """Maximise the penalised conditional likelihood by Adam steps; every line starts with its document's label."""
    x = with_neighbours(own, row)
    y = label[row].astype(float)
    chained = np.flatnonzero(row[1:] == row[:-1])
    theta = np.zeros(x.shape[1] + 4)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    seen = np.bincount((2 * y[chained] + y[chained + 1]).astype(int), minlength=4)
    n = max(len(y), 1)
    for step in range(1, rounds + 1):
        turn = theta[-4:].reshape(2, 2)
        emit = x @ theta[:-4]
        forward, backward = forward_backward(emit, row, turn)
        good = _sigmoid(forward + backward)
        ahead = emit[chained + 1] + backward[chained + 1]
        pair = np.stack([turn[0, 0] + 0 * ahead, turn[0, 1] + ahead, forward[chained] + turn[1, 0], forward[chained] + turn[1, 1] + ahead])
        pair = np.exp(pair - pair.max(axis=0)) if len(chained) else np.zeros((4, 0))
        expected = (pair / pair.sum(axis=0)).sum(axis=1) if len(chained) else np.zeros(4)
        gradient = np.concatenate([x.T @ (y - good), seen - expected]) / n
        gradient -= np.concatenate([np.full(x.shape[1], 1e-3), np.full(4, 2e-2)]) * theta
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        theta = theta + 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-9)
    chain = LineCrf(theta[:-4], theta[-4:].reshape(2, 2), 1.0, 0.0)
    mean = _aggregate(chain.marginals(own, row), row, size, len(label))
    keep = ~np.isnan(mean)
    inner = np.clip(mean[keep], 1e-6, 1 - 1e-6)
    z, target = np.log(inner / (1 - inner)), label[keep].astype(float)
    design, curve = np.column_stack([z, np.ones_like(z)]), np.array([1.0, 0.0])
    for _ in range(25):  # Newton steps of a logistic fit with a little ridge, so that separable samples stay finite
        p = _sigmoid(design @ curve)
        pull = design.T @ (target - p) - 0.1 * (curve - [1.0, 0.0])
        bend = (design * (p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        curve = curve + np.linalg.solve(bend, pull)
    return LineCrf(chain.weights, chain.turn, float(max(curve[0], 1e-3)), float(curve[1]))


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample_docs: int = SAMPLE_DOCS, doc: str = "doc_id",
        text: str = "text", label: str = "quality") -> LineCrf:
    """Fit on at most ``sample_docs`` labelled documents for which ``learn`` holds, taken in the order of a hash.

    A document labelled both ways counts as bad. Only line features of the bounded sample reach the driver. Without a
    usable label the model scores every line 0.5.
    """
    chosen = (
        labels.filter(learn).filter(F.col(label).isin(0, 1)).groupBy(F.col(doc).alias("_doc")).agg(F.min(label).alias("_label"))
        .orderBy(F.xxhash64("_doc"), "_doc").limit(sample_docs)
    )
    sample = docs.select(F.col(doc).alias("_doc"), F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), "_doc")

    def counted(batches):
        for batch in batches:
            kind = batch.column("_label").to_numpy(zero_copy_only=False)
            for begin, end, data, offsets in textgrid.blocks(batch.column("_text")):
                own, row, size = line_counts(data, offsets)
                per_doc = np.bincount(row, minlength=end - begin)
                small = np.flatnonzero((per_doc > 0) & (per_doc <= SAMPLE_LINES))
                parts = [np.flatnonzero(row == r) for r in small]
                yield pa.RecordBatch.from_pydict({
                    "label": pa.array(kind[begin:end][small].astype(np.int32), pa.int32()),
                    "size": pa.array([size[p].astype(float) for p in parts], pa.list_(pa.float64())),
                    "own": pa.array([own[p].ravel() for p in parts], pa.list_(pa.float64())),
                })

    got = sample.select("_text", "_label").mapInArrow(counted, "label int, size array<double>, own array<double>").toArrow()
    label_of = got["label"].to_numpy() if got.num_rows else np.zeros(0, dtype=np.int32)
    if not len(label_of):
        return LineCrf(np.zeros(3 + 3 * N_OWN), np.zeros((2, 2)), 1.0, 0.0)
    size = got["size"].combine_chunks()
    row = np.repeat(np.arange(len(label_of)), np.diff(size.offsets.to_numpy()))
    own = got["own"].combine_chunks().values.to_numpy().reshape(-1, N_OWN)
    head = np.searchsorted(row, np.arange(len(label_of) + 1))
    order = np.lexsort((np.add.reduceat(own.sum(axis=1), head[:-1]), label_of))  # the same whatever task came first
    take = np.concatenate([np.arange(head[r], head[r + 1]) for r in order])
    return fit_chain(own[take], np.repeat(np.arange(len(order)), np.diff(head)[order]), size.values.to_numpy()[take], label_of[order])


def score(docs: DataFrame, model: LineCrf, text: str = "text", out: str = "score", drop: tuple[str, ...] = ()) -> DataFrame:
    """All columns of ``docs`` but those in ``drop``, and ``out``: the probability that the document is good.

    A column already named ``out`` is replaced. One pass over the rows, no shuffle.
    """
    kept = [f for f in docs.schema.fields if f.name not in (*drop, out)]
    schema = T.StructType([*kept, T.StructField(out, T.DoubleType(), False)])

    def scored(batches):
        for batch in batches:
            got = [model.score(data, offsets) for _, _, data, offsets in textgrid.blocks(batch.column(text))]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(f.name) for f in kept], pa.array(np.concatenate(got) if got else np.zeros(0))], names=schema.names)

    return docs.select(*{text: None, **{f.name: None for f in kept}}).mapInArrow(scored, schema)


def label_lines(docs: DataFrame, model: LineCrf, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, line, good): the marginal of every line that is not blank; lines count from 0 without the blank ones."""

    def labelled(batches):
        for batch in batches:
            ids = batch.column(doc)
            for begin, _, data, offsets in textgrid.blocks(batch.column(text)):
                own, row, _ = line_counts(data, offsets)
                head = np.flatnonzero(np.diff(row, prepend=-1))
                number = np.arange(len(row)) - np.repeat(head, np.diff(np.append(head, len(row))))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row + begin)), pa.array(number.astype(np.int32)), pa.array(model.marginals(own, row))],
                    names=[doc, "line", "good"])

    kind = docs.schema[doc].dataType
    schema = T.StructType([T.StructField(doc, kind), T.StructField("line", T.IntegerType()), T.StructField("good", T.DoubleType())])
    return docs.select(doc, text).mapInArrow(labelled, schema)
