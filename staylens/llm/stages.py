"""The pipeline's stages: (spark, docs, sf_dir) -> DataFrame.

All but the last return the columns of ``docs`` in their order, extra ones included,
whatever their names.  Cases, the same in every stage: a NULL text counts as empty and its
row is kept unless a copy of it is; a NULL id sorts after all others; rows that repeat id
and text are copies of each other; ties go to the smallest id, then to the smallest text
hash; very long texts are read whole; an empty table gives an empty one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm import exact_dedup, packing, rows, secrets, simhash, toxicity
from staylens.session import tune

TOKENIZER = "word_bpe_49k.json"
END_ID = 1


def _ready(spark: SparkSession) -> None:
    tune(spark)
    rows.ship(spark)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; the model is learned from the labelled ones."""
    _ready(spark)
    return toxicity.rejected(docs, rows.read(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    _ready(spark)
    return exact_dedup.survivors(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with linked fingerprints the one with the smallest doc_id stays."""
    _ready(spark)
    return simhash.survivors(docs)


def blank_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; spans of secrets are replaced by a mark, n_chars follows."""
    _ready(spark)
    out = secrets.redact(docs)
    if "n_chars" in out.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.coalesce(size, F.col("n_chars")))
    return out


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths, with their ids."""
    _ready(spark)
    return packing.packed_table(docs, public_tokenizers.path(TOKENIZER), END_ID)
