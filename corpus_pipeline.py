"""A corpus from documents: language, near-duplicates, repeated passages, personal data, packed sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from riskweave.llm.common import materialise, table
from riskweave.llm.langid import with_language
from riskweave.llm.packing import pack
from riskweave.llm.pii import without_personal_data
from riskweave.llm.repeats import without_repeats
from riskweave.llm.simhash import keep_one


# What holds for each stage: an empty table gives no rows; columns that a stage does not know pass through, whatever their
# names, and all stages but the last return the columns of documents; a null text is a text without words.


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are in a language; those without a letter, null and empty texts among them, go. Repeated rows are judged
    alike. Where no row is labelled, nothing can be told and all go."""
    return with_language(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the smallest doc_id, of each near-duplicate class; of repeated rows one. Unlike texts of one
    id are classes of their own. Rows without an id cannot be ranked and stay."""
    return keep_one(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words of passages that an earlier one has, by doc_id and then by place in the table; rows
    without an id come last. n_chars follows the new text."""
    return without_repeats(docs)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with pseudonyms for personal data; equal values have equal ones. n_chars follows the new text."""
    return without_personal_data(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents as pieces of token sequences; repeated rows and rows without an id are documents of their own, and an
    empty or null text is one id."""
    return pack(docs)


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", simhash_near_dedup),
    ("substring_dedup", substring_dedup),
    ("pii", pii),
    ("best_fit_packing", best_fit_packing),
]

#: Tokenising and fingerprints are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; each stage's rows are written as Parquet and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
