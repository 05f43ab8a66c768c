"""Stages of the corpus pipeline: (spark, docs, sf_dir) -> DataFrame, each one operator whose decisions take effect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelcohort.llm import decontaminate, jaccard_join, line_crf, piece_sampling, surrogates
from voxelcohort.llm.textgrid import need, table

SURROGATE_KEY = "corpus tables"


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier, fitted on the labelled ones among them, scores as good."""
    labels = need(table(spark, sf_dir, "labels"), doc_id="long", quality="int")
    model = line_crf.fit(docs, labels, F.crc32(F.col("doc_id").cast("string")) % 3 != 1)
    scored = line_crf.score(docs, model, out="_quality")
    return scored.filter(F.col("_quality") >= line_crf.THRESHOLD).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates."""
    return jaccard_join.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.without_leaks(docs, need(table(spark, sf_dir, "benchmark"), item_id="long", text="string"))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by surrogates; ``n_chars`` follows the new text."""
    replaced = surrogates.replace(docs, SURROGATE_KEY, counted=None)
    return replaced.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else replaced


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, pieces): a sampled segmentation of every text, seeded by the document's id."""
    return piece_sampling.encode(docs, piece_sampling.load_vocabulary(), F.col("doc_id"), keep=("doc_id", "lang", "source"))
