"""Five stages from raw documents to packed batches. run() applies them to the documents of a folder of tables.

Each stage takes all rows its predecessor kept, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from clausemill.llm import decontam, langid, nearcopies, packing, secrets
from clausemill.llm.shared import discard, saved, scratch, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language with a posterior of a half, go."""
    return langid.accepted(docs, langid.train(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked at Jaccard similarity 0.8 on five-word shingles that with the smallest id stays."""
    return nearcopies.keep_one(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go."""
    return decontam.clean(docs, table(spark, sf_dir, "benchmark"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every secret is replaced by its kind in brackets; all documents stay."""
    return secrets.redact(docs)


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' tokens, with their ids, in length buckets and token-budget batches."""
    return packing.pack_tokens(docs)


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("secret_redaction", redact_secrets),
    ("packing", pack_batches),
]

#: SQL cannot express the first stage and the last.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's intermediates and its input are deleted once its result is written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        with scratch(spark) as s:
            last, docs = docs, saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
            s.keep(docs)
        discard(spark, last)
    return docs
