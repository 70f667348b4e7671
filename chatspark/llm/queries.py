"""Queries of the operators over the whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatspark.llm.alignment import cross_tokenizer_alignment
from chatspark.llm.binary_records import binary_output
from chatspark.llm.decontaminate import contaminated_words
from chatspark.llm.exact_dedup import exact_groups
from chatspark.llm.jaccard_join import jaccard_components
from chatspark.llm.language_id import document_evidence, document_model, identify, page_evidence
from chatspark.llm.oracle import ORACLE_SQL
from chatspark.llm.packing import pack
from chatspark.llm.secrets import scan_secrets
from chatspark.llm.spelling import spelling_groups
from chatspark.llm.substring_dedup import substring_dedup
from chatspark.llm.suffix_dedup import suffix_dedup
from chatspark.llm.vector_tree import vector_search
from chatspark.llm.wrapper import main_text


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(_table(spark, sf_dir, "documents"))


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), k=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op4_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(_table(spark, sf_dir, "pages"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated_words(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = document_evidence(docs).unionByName(page_evidence(_table(spark, sf_dir, "pages")))
    return identify(rows, document_model(docs))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(_table(spark, sf_dir, "documents"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op10_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return binary_output(_table(spark, sf_dir, "documents"), tokenizer_path()).select("doc_id", "start", "n_tokens", "ids_crc32")


def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_tokenizer_alignment(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op12_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_search(_table(spark, sf_dir, "embeddings"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_secret_scan, op3_ngram_jaccard_join, op4_html_extraction, op5_benchmark_decontamination, op6_language_id, op7_suffix_array_dedup,
        op8_substring_dedup, op9_exact_dedup, op10_binary_output, op11_cross_tokenizer_alignment, op12_nearest_neighbours, op13_spelling_variants,
    )
}
__all__ = ["ORACLE_SQL", "QUERIES", "tokenizer_path"]
