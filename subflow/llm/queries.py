"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subflow.llm import (
    alignment,
    bestfit,
    bytecnn,
    decontamination,
    extraction,
    langid,
    minhash,
    mixing,
    negatives,
    packing,
    pii,
    quality,
    warc,
)
from subflow.llm.common import table

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER, PIECE_TOKENIZER = "byte_bpe_50k.json", "piece_bpe_32k.model"
END_ID = 1


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = minhash.Settings(words=3, percent=85)
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), settings)


def op2_language_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op3_warc_normaliser(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archived(table(spark, sf_dir, "pages"))


def op4_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(table(spark, sf_dir, "pages"))


def op5_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "source", "size", "source_size", "target", "taken")


def op6_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path(TOKENIZER)
    return packing.token_files(table(spark, sf_dir, "documents"), tokenizer, END_ID)


def op7_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(table(spark, sf_dir, "documents"))
    base = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return judged.select(*base, "base_failed", "kept", "distance")


def op8_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.personal_data(table(spark, sf_dir, "documents"))


def op9_qgram_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line per item found in a document; documents that hold none have no line."""
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_byte_network(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return bytecnn.score(docs, bytecnn.train(docs, table(spark, sf_dir, "labels")))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    seventh = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = negatives.whole_vectors(table(spark, sf_dir, "embeddings"), seventh)
    return negatives.mine(vectors, F.col("vec_id") % 100 == 0)


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokenizer = public_tokenizers.path(TOKENIZER)
    return bestfit.packed(table(spark, sf_dir, "documents"), tokenizer, END_ID)


def op13_cross_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = public_tokenizers.path(BYTE_TOKENIZER), public_tokenizers.path(PIECE_TOKENIZER)
    return alignment.cross_tokenizer(table(spark, sf_dir, "documents"), a, b)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_near_duplicates": op1_near_duplicates,
    "op2_language_fusion": op2_language_fusion,
    "op3_warc_normaliser": op3_warc_normaliser,
    "op4_main_text": op4_main_text,
    "op5_entropy_mix": op5_entropy_mix,
    "op6_packed_tokens": op6_packed_tokens,
    "op7_quality_outliers": op7_quality_outliers,
    "op8_contextual_pii": op8_contextual_pii,
    "op9_qgram_decontamination": op9_qgram_decontamination,
    "op10_byte_network": op10_byte_network,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_best_fit_packing": op12_best_fit_packing,
    "op13_cross_tokenizer": op13_cross_tokenizer,
}
