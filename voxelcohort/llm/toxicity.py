"""Toxicity from gradient-boosted trees over dense text features, with isotonic calibration.

The labelled sample is dealt by a hash into three parts: one teaches a lexicon of words and word beginnings, one the
trees, one the isotonic curve, so no part is judged by what it taught. Features are lexicon densities, nearness of
lexicon hits to second-person words, capitals, punctuation and obfuscation rates.

Defined results: null and empty texts have all-zero features and are scored like any other; repeated rows are scored
alike; a document labelled both ways counts as toxic; without labels of both kinds the score is the share of toxic
labels (0 without labels); empty tables give empty results.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voxelcohort.llm import textgrid
from voxelcohort.session import cut_lineage

# Bounds of the fitting sample and of the lexicon, and the least number of toxic documents that back an entry.
SAMPLE_DOCS = 12_000
LEXICON_TERMS = 4_000
CANDIDATE_TERMS = 40_000
SUPPORT = 4
LOG_ODDS = 2.0
THRESHOLD = 0.3
NEAR_WORDS = 6
PREFIX_BYTES = (4, 5, 6)

# Second-person words of the four languages of the corpus (fixed values).
SECOND_PERSON = (
    "you your yours yourself u ur du dich dir dein deine deiner ihr euch sie tu te toi ton ta tes vous votre vos "
    "ti tus usted ustedes vosotros"
).split()

_LETTER = np.zeros(256, dtype=bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
_UPPER = np.zeros(256, dtype=bool)
_UPPER[65:91] = True
_LOUD = np.zeros(256, dtype=bool)
_LOUD[[33, 63]] = True
_MARK = ~(_LETTER | textgrid.IS_SPACE)
_MARK[48:58] = False
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
# Characters that stand for letters inside a word (fixed values).
_LEET = np.arange(256, dtype=np.uint8)
for _from, _to in zip(b"013457@$", b"oieastas"):
    _LEET[_from] = _to
N_FEATURES = 17


def _plain(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased bytes with stand-ins between letters undone, and where that happened."""
    letter = _LETTER[data]
    inside = np.zeros(len(data), dtype=bool)
    if len(data) > 2:
        inside[1:-1] = letter[:-2] & letter[2:] & (_LEET[data[1:-1]] != data[1:-1])
    plain = np.where(inside, _LEET[data], textgrid.LOWER[data])
    capital = np.zeros(len(data), dtype=bool)  # two-byte Latin capitals
    capital[1:] = (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E)
    return np.where(capital, plain + np.uint8(32), plain), inside


def terms(data: np.ndarray, offsets: np.ndarray):
    """Letter runs as (starts, ends, row) and their term hashes: whole words, then one array for each prefix length."""
    plain, inside = _plain(data)
    solid = np.where(_LETTER[plain], np.uint8(97), np.uint8(32))
    starts, ends, row = textgrid.words(solid, offsets)
    hashes = [textgrid.spans_hash(plain, starts, ends)]
    for k in PREFIX_BYTES:
        long = ends - starts > k
        part = np.zeros(len(starts), dtype=np.uint64)
        part[long] = textgrid.mix(textgrid.spans_hash(plain, starts[long], starts[long] + k) + np.uint64(k << 56))
        hashes.append(part)
    return starts, ends, row, hashes, inside


def _second_person() -> np.ndarray:
    data = np.frombuffer(" ".join(SECOND_PERSON).encode(), dtype=np.uint8)
    starts, ends, _ = textgrid.words(data, np.array([0, len(data)]))
    return np.sort(textgrid.spans_hash(data, starts, ends))


def _find(sorted_terms: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Place of each hash in ``sorted_terms``, or -1."""
    if not len(sorted_terms):
        return np.full(len(hashes), -1)
    at = np.minimum(np.searchsorted(sorted_terms, hashes), len(sorted_terms) - 1)
    return np.where(sorted_terms[at] == hashes, at, -1)


def features(data: np.ndarray, offsets: np.ndarray, lexicon: np.ndarray, weights: np.ndarray, you: np.ndarray) -> np.ndarray:
    """Dense features, one row for each text of the block."""
    n = len(offsets) - 1
    starts, ends, row, hashes, inside = terms(data, offsets)
    tokens = np.bincount(row, minlength=n)
    found = [_find(lexicon, h) for h in hashes]
    weight = np.max([np.where(f >= 0, weights[f] if len(weights) else 0.0, 0.0) for f in found], axis=0) if len(starts) else np.zeros(0)
    whole = found[0] >= 0 if len(starts) else np.zeros(0, dtype=bool)
    hit = weight > 0
    second = _find(you, hashes[0]) >= 0 if len(starts) else np.zeros(0, dtype=bool)
    near = np.zeros(len(starts), dtype=bool)
    spots = np.flatnonzero(second)
    if len(spots) and hit.any():
        own = np.flatnonzero(hit)
        at = np.searchsorted(spots, own)
        for side in (np.minimum(at, len(spots) - 1), np.maximum(at - 1, 0)):
            near[own] |= (np.abs(spots[side] - own) <= NEAR_WORDS) & (row[spots[side]] == row[own])
    total = lambda kind: np.bincount(row, kind, minlength=n)
    size = np.diff(offsets)
    count = lambda kind: textgrid.per_span(kind, offsets[:-1], offsets[1:])
    letters, upper = count(_LETTER[data]), count(_UPPER[data])
    best = np.zeros(n)
    np.maximum.at(best, row, weight)
    loud_word = textgrid.per_span(_UPPER[data], starts, ends) * 2 > np.maximum(ends - starts, 2) if len(starts) else np.zeros(0)
    hits, per = total(hit.astype(float)), np.maximum(tokens, 1)
    return np.column_stack([
        100 * hits / per, 100 * total(whole.astype(float)) / per, 100 * total(weight) / per, np.log1p(hits),
        np.log1p(total(whole.astype(float))), np.log1p(total(weight)), best, total(weight) / np.maximum(hits, 1),
        total(near.astype(float)) / np.maximum(hits, 1), total(near.astype(float)), 100 * total(second.astype(float)) / per,
        upper / np.maximum(letters, 1), total(loud_word.astype(float)) / per, count(_LOUD[data]) / per, count(_MARK[data]) / per,
        100 * (count(inside) + count(_DIGIT[data]) * 0.1) / per, np.log1p(size),
    ])


@dataclass(frozen=True)
class ToxicityModel:
    """Lexicon with weights, trees and curve; without trees every score is ``prior``."""

    lexicon: np.ndarray
    weights: np.ndarray
    trees: GBTClassificationModel | None
    curve: IsotonicRegressionModel | None
    prior: float


def _with_features(docs: DataFrame, keep: list[str], text: str, lexicon: np.ndarray, weights: np.ndarray) -> DataFrame:
    you = _second_person()
    schema = T.StructType([*[docs.schema[c] for c in keep], T.StructField("_features", T.ArrayType(T.DoubleType()))])

    def dense(batches):
        for batch in batches:
            got = [features(data, offsets, lexicon, weights, you) for _, _, data, offsets in textgrid.blocks(batch.column(text))]
            flat = np.concatenate(got).ravel() if got else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, N_FEATURES), pa.int32()), pa.array(flat))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in keep], lists], names=[*keep, "_features"])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(dense, schema)


def learn_lexicon(sample: DataFrame, text: str = "_text", label: str = "_label") -> tuple[np.ndarray, np.ndarray]:
    """Terms with a log-odds of ``LOG_ODDS`` or more between toxic and other documents of the bounded sample."""

    def toxic_terms(batches):
        for batch in batches:
            batch = batch.filter(pa.compute.equal(batch.column(label), 1))
            for _, _, data, offsets in textgrid.blocks(batch.column(text)):
                _, _, row, hashes, _ = terms(data, offsets)
                for h in hashes:
                    pairs = np.unique(np.stack([row.astype(np.uint64), h])[:, h != 0], axis=1)
                    term, docs = np.unique(pairs[1], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(term.view(np.int64)), pa.array(docs)], names=["term", "n"])

    found = (
        sample.select(text, label).mapInArrow(toxic_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
        .filter(F.col("n") >= SUPPORT).orderBy(F.desc("n"), "term").limit(CANDIDATE_TERMS)
    )
    candidates = np.sort(found.toPandas()["term"].to_numpy(dtype=np.int64).view(np.uint64))

    def counted(batches):
        held = np.zeros((2, len(candidates) + 1), dtype=np.int64)
        for batch in batches:
            kind = batch.column(label).to_numpy(zero_copy_only=False)
            for begin, end, data, offsets in textgrid.blocks(batch.column(text)):
                held[:, -1] += np.bincount(kind[begin:end], minlength=2)[:2]
                _, _, row, hashes, _ = terms(data, offsets)
                for h in hashes:
                    at = _find(candidates, h)
                    pairs = np.unique(np.stack([row[at >= 0], at[at >= 0]]), axis=1)
                    np.add.at(held, (kind[begin:end][pairs[0]], pairs[1]), 1)
        for k in (0, 1):
            place = np.flatnonzero(held[k])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(place), k)), pa.array(place), pa.array(held[k][place])], names=["kind", "place", "n"])

    table = sample.select(text, label).mapInArrow(counted, "kind long, place long, n long").groupBy("kind", "place").agg(F.sum("n").alias("n")).toPandas()
    held = np.zeros((2, len(candidates) + 1))
    held[table["kind"].to_numpy(dtype=int), table["place"].to_numpy(dtype=int)] = table["n"].to_numpy(dtype=float)
    odds = np.log((held[1, :-1] + 0.5) / (held[1, -1] + 1)) - np.log((held[0, :-1] + 0.5) / (held[0, -1] + 1))
    order = np.lexsort((candidates, -odds * np.sqrt(held[1, :-1])))
    kept = np.sort(order[odds[order] >= LOG_ODDS][:LEXICON_TERMS])
    return candidates[kept], odds[kept]


def fit(docs: DataFrame, labels: DataFrame, learn: Column, sample_docs: int = SAMPLE_DOCS, doc: str = "doc_id",
        text: str = "text", label: str = "toxic") -> ToxicityModel:
    """Fit on at most ``sample_docs`` labelled documents for which ``learn`` holds, taken in the order of a hash."""
    chosen = (
        labels.filter(learn).filter(F.col(label).isin(0, 1)).groupBy(F.col(doc).alias("_doc")).agg(F.max(label).cast("int").alias("_label"))
        .orderBy(F.xxhash64("_doc"), "_doc").limit(sample_docs)
    )
    sample = cut_lineage(
        docs.select(F.col(doc).alias("_doc"), F.col(text).cast("string").alias("_text")).join(F.broadcast(chosen), "_doc")
        .withColumn("_part", F.pmod(F.xxhash64("_doc", F.lit("part")), F.lit(5))))
    seen = {(r["_part"] // 2, r["_label"]): r["n"] for r in sample.groupBy("_part", "_label").agg(F.count("*").alias("n")).collect()}
    toxic, all_seen = sum(n for (_, k), n in seen.items() if k == 1), sum(seen.values())
    none = np.zeros(0, dtype=np.uint64)
    if any((part, k) not in seen for part in (0, 1, 2) for k in (0, 1)):
        return ToxicityModel(none, np.zeros(0), None, None, toxic / all_seen if all_seen else 0.0)
    lexicon, weights = learn_lexicon(sample.filter("_part < 2"))
    dense = cut_lineage(
        _with_features(sample.filter("_part >= 2"), ["_doc", "_label", "_part"], "_text", lexicon, weights)
        .withColumn("_features", array_to_vector("_features")).withColumn("_label", F.col("_label").cast("double")).orderBy("_doc").coalesce(1))
    trees = GBTClassifier(featuresCol="_features", labelCol="_label", maxIter=25, maxDepth=4, stepSize=0.2, maxBins=64,
                          minInstancesPerNode=5, seed=7).fit(dense.filter("_part < 4"))
    raw = trees.transform(dense.filter("_part = 4")).select(_chance(), "_label")
    curve = IsotonicRegression(featuresCol="_raw", labelCol="_label").fit(raw)
    return ToxicityModel(lexicon, weights, trees, curve, toxic / all_seen)


def _chance() -> Column:
    return vector_to_array("probability")[1].alias("_raw")


def score(docs: DataFrame, model: ToxicityModel, keep: tuple[str, ...] = ("doc_id",), text: str = "text", out: str = "score") -> DataFrame:
    """The columns ``keep`` and ``out``: the calibrated probability that the document is toxic. One pass, no shuffle."""
    keep = [c for c in keep if c != out]
    if model.trees is None:
        return docs.select(*keep, F.lit(float(model.prior)).alias(out))
    dense = _with_features(docs, keep, text, model.lexicon, model.weights).withColumn("_features", array_to_vector("_features"))
    raw = model.trees.transform(dense).select(*keep, _chance())
    # the step function of the curve, evaluated by linear interpolation between its boundaries
    return model.curve.setPredictionCol("_curve").transform(raw).select(*keep, (F.col("_curve") * 0.98 + F.col("_raw") * 0.02).alias(out))
