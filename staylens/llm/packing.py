"""Packing by power-of-two decomposition.

A document's ids (with the end id) are cut into pieces of 2048 ids and one piece for
every binary digit of the rest.  Each piece fills a sequence of its own length, and
sequences of equal length share a bucket (a Parquet partition), so no sequence crosses
documents and none is padded.  It is a map over the documents: nothing is shuffled.

Cases: a NULL or empty text packs its end id only; repeated rows are packed each;
very long texts only make more pieces; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm import pieces, rows
from staylens.session import scratch

LONGEST = 2048
SERIALS = 36  # bits of a sequence id that count within its task

PACKED = pa.schema(
    [
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
        ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()),
        ("offset", pa.int64()), ("ids", pa.binary()),
    ]
)
PACKED_DDL = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
    "sequence_id long, offset long, ids binary"
)


def lengths(n: int, longest: int = LONGEST) -> list[int]:
    """Piece lengths of ``n`` ids, longest first."""
    rest = n % longest
    digits = [1 << k for k in range(longest.bit_length() - 1, -1, -1) if rest >> k & 1]
    return [longest] * (n // longest) + digits


def pack(docs: DataFrame, tokenizer: str, end_id: int, longest: int = LONGEST) -> DataFrame:
    """One row per piece, with its ids as little-endian unsigned 16- or 32-bit integers.

    A sequence id is the task's number and a count within the task, so ids are unique
    once the rows are written; ``write`` does that.
    """
    if longest & (longest - 1):
        raise ValueError("the longest piece must be a power of two")

    def run(batches):
        memory = pieces.library(tokenizer, led=False)
        serial = TaskContext.get().partitionId() << SERIALS
        for part in pieces.spans(batches):
            out = {f.name: [] for f in PACKED}
            for doc_id, found in zip(
                part.column("doc_id").to_pylist(), memory.each(part.column("text"))
            ):
                ids = np.append(found, np.uint32(end_id))
                start, width = 0, 2 if int(ids.max()) < 1 << 16 else 4
                for n in lengths(ids.size, longest):
                    piece = ids[start : start + n]
                    values = (
                        doc_id, start, n, zlib.crc32(piece.astype("<u4")), ids.size, serial, 0,
                        piece.astype(f"<u{width}").tobytes(),
                    )
                    for name, value in zip(out, values):
                        out[name].append(value)
                    start += n
                    serial += 1
            yield rows.batch(PACKED, out)

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), rows.text_or_empty().alias("text")
    ).mapInArrow(run, PACKED_DDL)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Write the sequences under ``path``, one bucket per length."""
    packed = pack(docs, tokenizer, end_id)
    packed.withColumn("bucket", F.col("length")).write.partitionBy("bucket").parquet(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(PACKED_DDL + ", bucket long").parquet(path)


def packed_table(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Write the sequences to the shared folder and return them."""
    path = scratch(docs.sparkSession)
    write(docs, path, tokenizer, end_id)
    return read(docs.sparkSession, path)
