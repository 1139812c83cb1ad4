"""From raw documents to packed training sequences: five stages, each written before the next.

Every stage works on all rows that the stage before it kept: quality rules drop what they
reject, exact copies go, one document of each near-duplicate group stays, secrets are masked in
the texts, and what is left is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from leafmark.llm.common import staged, table
from leafmark.llm.exact_dedup import drop_copies
from leafmark.llm.jaccard import keep_one_of_each
from leafmark.llm.packing import pack_documents
from leafmark.llm.quality import drop_low_quality
from leafmark.llm.queries import tokenizer_file
from leafmark.llm.secret_scan import mask_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_low_quality(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_copies(docs)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs, width=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mask_secrets(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("exact_dedup", exact_dedup),
    ("jaccard_join", jaccard_join),
    ("secret_scan", secret_scan),
    ("packing", packing),
]

#: SQL cannot express the trained field, the components or the packing; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
