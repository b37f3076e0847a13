"""The registered queries of this subpackage: thin digests over its operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline import tables
from plumbline.session import attach

from . import bpe, hnsw, jaccard, language, packing, quality, substring, suffix, tokenfiles, toxicity


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return attach(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _held_out() -> F.Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = toxicity.fit(docs, labels.where(~_held_out()))
    return toxicity.score(docs, model).select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.digest(_table(spark, sf_dir, "documents"))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.dedup(_table(spark, sf_dir, "documents"), folder=tables.fresh_path(spark, "op3-index")).drop("kept")


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = language.fit(docs.where(~_held_out()))
    return language.predict(docs, model, spans=False).select("doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "n_spans")


def op5_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(_table(spark, sf_dir, "documents")).drop("kept")


def op6_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest(_table(spark, sf_dir, "documents"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.clean(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(_table(spark, sf_dir, "documents"))


def op9_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return hnsw.nearest(vectors, vectors.where("vec_id % 20 = 0"), 20)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_toxicity": op1_toxicity,
    "op2_token_files": op2_token_files,
    "op3_substring": op3_substring,
    "op4_language": op4_language,
    "op5_suffix_array": op5_suffix_array,
    "op6_prefix_bpe": op6_prefix_bpe,
    "op7_quality": op7_quality,
    "op8_jaccard": op8_jaccard,
    "op9_hnsw": op9_hnsw,
    "op10_packing": op10_packing,
}
