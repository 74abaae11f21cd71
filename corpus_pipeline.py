"""The corpus pipeline: documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all rows that the stage before
kept, and its decisions take effect. All but the last return the columns of
``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from gridloom.llm import jaccard_join, packing, secret_scan, substring_dedup, toxicity
from gridloom.llm.catalog import table, tokenizer_file
from gridloom.llm.shared import remove, written


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a lexicon learned from the training labels finds toxic go."""
    return toxicity.without_toxic(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def keep_one_of_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that 5-word shingles link at a similarity of 0.8, the smallest doc_id stays."""
    return jaccard_join.one_of_each(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the document of the smallest doc_id that has them."""
    return substring_dedup.without_repeats(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets give way to the names of their kinds."""
    return secret_scan.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents take their places in sequences of 4096 tokens."""
    return packing.pack_documents(docs, tokenizer_file(packing.TOKENIZER))


STAGES = [
    ("toxicity", reject_toxic),
    ("ngram_jaccard_join", keep_one_of_near_copies),
    ("substring_dedup", cut_repeated_passages),
    ("secret_scans", redact_secrets),
    ("best_fit_packing", pack),
]

#: Tokenizing, learning and links are beyond SQL; a test compares the rows with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; every one but the last is written and read again, and goes when the next is there."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
        if last is not None:
            remove(spark, last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
