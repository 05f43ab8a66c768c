"""Named queries over the synthetic corpus tables, one per operator, with SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelcohort.llm import code_index, decontaminate, jaccard_join, language_id, line_crf, main_text, phrases, piece_sampling, repeats, spelling, surrogates, toxicity, url_catalog
from voxelcohort.llm.stages import SURROGATE_KEY
from voxelcohort.llm.textgrid import need, table


def _remainder(modulus: int):
    return F.crc32(F.col("doc_id").cast("string")) % modulus


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    labels = need(table(spark, sf_dir, "labels"), doc_id="long", quality="int")
    model = line_crf.fit(docs, labels, _remainder(3) != 1)
    return line_crf.score(docs, model, drop=("text",)).select(
        "doc_id", (_remainder(3) == 1).alias("held_out"), "score",
        (F.col("score") >= line_crf.THRESHOLD).cast("int").alias("predicted"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    labels = need(table(spark, sf_dir, "labels"), doc_id="long", toxic="int")
    model = toxicity.fit(docs, labels, _remainder(4) != 2)
    return toxicity.score(docs, model).select(
        "doc_id", (_remainder(4) == 2).alias("held_out"), "score",
        (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = need(table(spark, sf_dir, "pages"), page_id="long", url="string", html="string")
    return main_text.main_text(pages, main_text.fit(pages))


def op8_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    return code_index.nearest(vectors, F.col("id") % 50 == 0)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest_repeats(need(table(spark, sf_dir, "documents"), doc_id="long", text="string"))


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    return decontaminate.leaks(docs, need(table(spark, sf_dir, "benchmark"), item_id="long", text="string"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(need(table(spark, sf_dir, "documents"), doc_id="long", text="string"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    return piece_sampling.encode_digest(docs, piece_sampling.load_vocabulary(), F.col("doc_id"))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    return surrogates.replace(docs, SURROGATE_KEY)


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(table(spark, sf_dir, "documents"), doc_id="long", text="string")
    return spelling.variants(spelling.word_counts(docs, every=97))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(need(table(spark, sf_dir, "documents"), lang="string", text="string"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = need(table(spark, sf_dir, "documents"), doc_id="long", text="string", lang="string")
    model = language_id.fit(docs, _remainder(4) != 2)
    return language_id.predict(docs.select("doc_id", "text"), model).select("doc_id", (_remainder(4) == 2).alias("held_out"), "lang_pred", "score")


QUERIES = {
    "op1_quality_classifier": op1_quality_classifier,
    "op2_ngram_jaccard_join": op2_ngram_jaccard_join,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_url_filters": url_catalog.op4_url_filters,
    "op5_pii": op5_pii,
    "op6_toxicity": op6_toxicity,
    "op7_html_extraction": op7_html_extraction,
    "op8_nearest_neighbours": op8_nearest_neighbours,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_benchmark_decontamination": op10_benchmark_decontamination,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_language_id": op13_language_id,
}
ORACLES: dict[str, str] = {
    "op4_url_filters": url_catalog.OP4_SQL,
    "op10_benchmark_decontamination": decontaminate.OP10_SQL,
    "op11_spelling_variants": spelling.OP11_SQL,
    "op12_phrase_collocations": phrases.OP12_SQL,
}
