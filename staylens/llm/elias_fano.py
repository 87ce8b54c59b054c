"""Token ids of documents in one array with Elias-Fano coded boundaries.

A block holds the ids of consecutive documents (by ascending id) and the ends of the
documents as an Elias-Fano sequence: the low bits of every end packed side by side, the
high bits in unary, and the position of every 64th one as a 32-bit select sample; offsets
are read through ``select``, which never unpacks the sequence.  With
n ends up to N that is about n * (2 + log2(N / n)) bits and 32 / 64 bits of samples.
Ids take 2 bytes where the vocabulary allows.  A small manifest holds the number of ids
before each block.

On disk both tables are Parquet: blocks (shard, block, n_docs, n_ids, width, doc_ids,
ids, low_bits, low, high, samples) and manifest (shard, block, first).

Cases: a NULL or empty text is a document of its end id only; NULL ids come first;
repeated rows are documents of their own, equal ids ordered by text; an empty table gives
empty files and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from staylens.llm import pieces, rows

SAMPLE = 64  # ones between two select samples
AT_ONCE = 1 << 12  # documents selected in step
BLOCK_IDS = 1 << 20  # a block is closed at so many ids, by whole documents


@dataclass(frozen=True)
class Sequence:
    """A non-decreasing sequence in Elias-Fano form."""

    n: int
    low_bits: int
    low: bytes
    high: bytes
    samples: bytes

    @staticmethod
    def of(values: np.ndarray) -> "Sequence":
        values = np.asarray(values, np.uint64)
        n = values.size
        top = int(values[-1]) if n else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        places = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
        high[ones] = 1
        return Sequence(
            n, bits,
            np.packbits(places.astype(np.uint8).ravel(), bitorder="little").tobytes(),
            np.packbits(high, bitorder="little").tobytes(),
            ones[::SAMPLE].astype("<u4").tobytes(),
        )

    def select(self, wanted: np.ndarray) -> np.ndarray:
        """The elements at the places ``wanted``, each from the sample before it.

        Words of 64 high bits are counted until the place is inside one, then its lower
        ones are cleared; all places go in step.  Nothing but the answers is unpacked.
        """
        wanted = np.asarray(wanted, np.int64)
        if not wanted.size:
            return np.zeros(0, np.int64)
        words = np.frombuffer(self.high + bytes(8 + -len(self.high) % 8), "<u8")
        at = np.frombuffer(self.samples, "<u4")[wanted // SAMPLE].astype(np.int64)
        left, place = wanted % SAMPLE, at >> 6
        word = words[place] >> (at & 63).astype(np.uint64) << (at & 63).astype(np.uint64)
        live = np.arange(wanted.size)
        while live.size:
            ones = np.bitwise_count(word[live]).astype(np.int64)
            live, ones = live[ones <= left[live]], ones[ones <= left[live]]
            left[live] -= ones
            place[live] += 1
            word[live] = words[place[live]]
        live = np.flatnonzero(left)
        while live.size:
            word[live] &= word[live] - np.uint64(1)
            left[live] -= 1
            live = live[left[live] > 0]
        lowest = word & (~word + np.uint64(1))
        one = place * 64 + np.bitwise_count(lowest - np.uint64(1)).astype(np.int64)
        return (one - wanted << self.low_bits) | self._low(wanted)

    def _low(self, wanted: np.ndarray) -> np.ndarray:
        """Low bits of the elements, out of the eight bytes that hold them."""
        if not self.low_bits:
            return np.zeros(wanted.size, np.int64)
        low = np.frombuffer(self.low + bytes(8), np.uint8)
        at = wanted * self.low_bits
        near = low[(at >> 3)[:, None] + np.arange(8)].copy().view("<u8").ravel()
        mask = np.uint64((1 << self.low_bits) - 1)
        return (near >> (at & 7).astype(np.uint64) & mask).astype(np.int64)

    def get(self, i: int) -> int:
        return int(self.select(np.array([i]))[0])


BLOCKS = pa.schema(
    [
        ("shard", pa.int32()), ("block", pa.int32()), ("n_docs", pa.int32()),
        ("n_ids", pa.int64()), ("width", pa.int32()), ("doc_ids", pa.list_(pa.int64())),
        ("ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()),
        ("high", pa.binary()), ("samples", pa.binary()),
    ]
)
BLOCKS_DDL = (
    "shard int, block int, n_docs int, n_ids long, width int, doc_ids array<long>, "
    "ids binary, low_bits int, low binary, high binary, samples binary"
)
DIGESTS = pa.schema(
    [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
     ("ids_crc32", pa.int64())]
)


def block_row(shard: int, block: int, doc_ids: list, parts: list[np.ndarray]) -> pa.RecordBatch:
    ids = np.concatenate(parts)
    width = 2 if not ids.size or int(ids.max()) < 1 << 16 else 4
    ends = Sequence.of(np.cumsum([p.size for p in parts]))
    return rows.batch(
        BLOCKS,
        {
            "shard": [shard], "block": [block], "n_docs": [len(parts)], "n_ids": [ids.size],
            "width": [width], "doc_ids": [doc_ids], "ids": [ids.astype(f"<u{width}").tobytes()],
            "low_bits": [ends.low_bits], "low": [ends.low], "high": [ends.high],
            "samples": [ends.samples],
        },
    )


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, block_ids: int = BLOCK_IDS):
    """Encode ``docs`` with the tokenizer file and write blocks and manifest under ``path``.

    Documents are dealt by ranges of doc_id, so a shard is a task's consecutive documents
    and blocks leave the task as soon as they are full.
    """

    def run(batches):
        memory = pieces.library(tokenizer, led=True)
        shard, block, held, doc_ids, parts = TaskContext.get().partitionId(), 0, 0, [], []
        for part in pieces.spans(batches):
            for doc_id, ids in zip(
                part.column("doc_id").to_pylist(), memory.each(part.column("text"))
            ):
                doc_ids.append(doc_id)
                parts.append(np.append(ids, np.uint32(end_id)))
                held += parts[-1].size
                if held >= block_ids:
                    yield block_row(shard, block, doc_ids, parts)
                    block, held, doc_ids, parts = block + 1, 0, [], []
        if parts:
            yield block_row(shard, block, doc_ids, parts)

    (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"), rows.text_or_empty().alias("text")
        )
        .repartitionByRange(rows.tasks(docs), "doc_id")
        .sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, BLOCKS_DDL)
        .write.parquet(f"{path}/blocks")
    )
    blocks = docs.sparkSession.read.parquet(f"{path}/blocks").select("shard", "block", "n_ids")
    # One row per shard, so at most as many as shuffle partitions.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard",
        (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"),
    )
    within = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block"))
    (
        blocks.withColumn("within", within - F.col("n_ids")).join(shards, "shard")
        .select("shard", "block", (F.col("before") + F.col("within")).alias("first"))
        .write.parquet(f"{path}/manifest")
    )


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                sequence = Sequence(
                    row["n_docs"], row["low_bits"], row["low"], row["high"], row["samples"]
                )
                ids = np.frombuffer(row["ids"], f"<u{row['width']}")
                for first in range(0, row["n_docs"], AT_ONCE):
                    last = min(first + AT_ONCE, row["n_docs"])
                    # A document starts where the one before it ends.
                    edges = sequence.select(np.arange(max(first - 1, 0), last))
                    edges = edges if first else np.concatenate([[0], edges])
                    starts, ends = edges[:-1], edges[1:]
                    yield rows.batch(
                        DIGESTS,
                        {
                            "doc_id": row["doc_ids"][first:last],
                            "start": (starts + row["first"]).tolist(),
                            "n_tokens": (ends - starts).tolist(),
                            "ids_crc32": [
                                zlib.crc32(ids[a:b].astype("<u4")) for a, b in zip(starts, ends)
                            ],
                        },
                    )

    blocks = spark.read.parquet(f"{path}/blocks")
    manifest = spark.read.parquet(f"{path}/manifest")
    return blocks.join(manifest, ["shard", "block"]).mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long"
    )


def document(spark: SparkSession, path: str, doc_id: int) -> np.ndarray | None:
    """Ids of one document, by select: its block is read, not its neighbours' ids."""
    row = (
        spark.read.parquet(f"{path}/blocks").where(F.array_contains("doc_ids", doc_id)).first()
    )
    if row is None:
        return None
    ends = Sequence(
        row["n_docs"], row["low_bits"], bytes(row["low"]), bytes(row["high"]), bytes(row["samples"])
    )
    i = row["doc_ids"].index(doc_id)
    a, b = (ends.get(i - 1) if i else 0), ends.get(i)
    return np.frombuffer(bytes(row["ids"]), f"<u{row['width']}")[a:b]
