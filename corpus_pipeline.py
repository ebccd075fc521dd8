"""Corpus pipeline over ``documents``: language, near duplicates, personal data, packing.

Each stage takes ``(spark, docs, sf_dir)`` with the columns of documents, works on all rows that it is given, and
returns these columns; the last returns token sequences.  The stages carry on with null ids or texts, repeated
rows and empty tables as their operators say.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from paceline.llm import langid, packing, pii, simhash
from paceline.llm._spark import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without documents in no learned language: those without a letter (or text), and those whose trigrams mostly are letters at random."""
    return langid.keep_identified(docs.select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each op3 group stays, that with the smallest id: 4-word shingles, fingerprints within 4 of 64 bits.

    By the angle of SimHash 4 bits are a Jaccard similarity near 0.96 (an estimate, not measured); most near copies from 0.8 to 0.95 stay.
    """
    return simhash.dedup_simhash(docs.select(*COLUMNS))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts gives way to its kind in brackets; n_chars follows."""
    return pii.mask_pii(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 ids: a row for each piece, with its ids.  Tasks pack what they read; ids are not shuffled."""
    return packing.pack_documents(docs.select(*COLUMNS), public_tokenizers.path("word_bpe_49k.json"), keep_ids=True, in_place=True)


STAGES = [
    ("language ID", languages),
    ("SimHash near-dedup", near_duplicates),
    ("PII", personal_data),
    ("best-fit packing", packed),
]

# Language mixtures, the field of personal data and token ids have no form in SQL; tests hold the stages
# against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialise(docs, f"pipeline-{k}")
    return docs
