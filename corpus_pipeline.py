"""From raw documents to packed sequences: the operators of ``tillbook.llm`` in a row.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before
kept. All but the last return the columns of ``documents``; the last returns
the pieces of the remaining documents with their sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tillbook.llm import exact_dedup, near_copies, packing, pii, quality_rules
from tillbook.llm.batches import table
from tillbook.llm.tokens import tokenizer_path
from tillbook.session import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality rules by weak supervision; rejected documents go."""
    return quality_rules.keep_good(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Exact copies; one row of each group stays, also of rows that share a doc_id or have none."""
    return exact_dedup.deduplicate(docs, by_row=True)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Near copies, five-word-shingle similarity of 0.8 or more; one document of each group stays."""
    return near_copies.deduplicate(docs)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind; every document stays."""
    return pii.mask(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 2048 tokens."""
    return packing.packed(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality rules", keep_good),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("personal data", mask_personal_data),
    ("packing", pack),
]

# Estimation, BK-trees, context graphs and tokenizers have no SQL; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
