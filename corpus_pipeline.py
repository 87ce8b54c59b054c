"""Corpus pipeline over ``documents``: reject toxic texts, drop exact copies, keep one
document of each near group, blank out secrets, pack tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from staylens.llm import stages
from staylens.llm.rows import read
from staylens.session import settle, tune

STAGES = [
    ("toxicity", stages.reject_toxic),
    ("exact_dedup", stages.drop_copies),
    ("simhash_dedup", stages.drop_near_copies),
    ("secret_scan", stages.blank_secrets),
    ("packing", stages.pack_tokens),
]

# Hashes, tokenizers and a learned model have no SQL; the stages are tested against
# brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order over all documents, each written and read again."""
    tune(spark)
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
