"""The corpus pipeline: documents to packed training windows, in five stages.

Each stage takes what its predecessor kept.  All but the last return the columns of ``documents``.

1. language_id drops documents that the language models reject (no letters, or no learned language).
2. simhash keeps one document of each group of near duplicates, the one with the least id.
3. pii replaces personal data in the texts by its kind in brackets.
4. mixing repeats and draws documents until each source has its share of words.
5. packing cuts the documents' tokens into windows; it returns one row per piece.

Defined results: null or empty columns, ties, repeated rows and empty tables have the results that
the operators' own modules state; columns beyond those of ``documents`` are not carried past stage 2.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import language_id, mixing, packing, pii, simhash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs.select(*COLUMNS))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash.one_per_group(docs.select(*COLUMNS))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redacted(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", keep_languages),
    ("simhash", drop_near_copies),
    ("pii", redact_personal_data),
    ("mixing", mix_sources),
    ("packing", pack_windows),
]

#: Hashes, models and tokenizers are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
