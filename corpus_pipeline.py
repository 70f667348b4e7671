"""The corpus pipeline: five stages over `documents`, each on all that its predecessor kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatspark.llm.decontaminate import clean_documents
from chatspark.llm.exact_dedup import exact_dedup
from chatspark.llm.jaccard_join import near_dedup
from chatspark.llm.language_id import accepted_documents
from chatspark.llm.packing import pack
from chatspark.llm.queries import tokenizer_path
from chatspark.llm.stage import shared_dir


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is identified stay."""
    return accepted_documents(docs)


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near copies (five-word shingles, similarity 0.8 and more) the smallest doc_id stays."""
    return near_dedup(docs, k=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a benchmark covers a twentieth of the words or more go."""
    return clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 2048 tokens."""
    return pack(docs, tokenizer_path())


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("decontamination", decontamination), ("packing", packing)]

#: Packing needs a tokenizer and a solver, which SQL can't express; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to `documents`, each written as Parquet and reread."""
    base = shared_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{i}_{name}")
        docs = spark.read.parquet(f"{base}/{i}_{name}")
    return docs
