"""Mixing sources to target weights by blocks.

The words of a source, its documents one after another, are cut into blocks of ``block``
words.  A source's target is turned into a number of slots: whole passes over its blocks
and the share of one more pass that comes nearest.  Every source's slots are dealt to the output
shards by a multinomial draw; given the totals of the mix, that is the law of multinomial
source counts per shard, and the totals hit their targets.  Slot k of a source takes block
pi(k mod blocks) of its own pseudorandom permutation of the block numbers, its place in
the shard comes from the shard's permutation, and words join the slots on
(source, block).

Permutations are Feistel networks walked until they fall inside the range: any task
computes any entry, and nothing is sorted or kept.

Cases: a NULL text has no words; a NULL source is a source of its own, after all others;
documents without words are never taken; repeated rows each fill their own words; an empty
table, or one without words, gives an empty mix; a source has as many slots as two passes
at most, so no document is taken more than twice over; NULL ids come last in their source;
extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm import rows
from staylens.session import settle

WORD = r"[^\x20\x09-\x0D]+"
BLOCK = 128  # words
SLOTS = 4096  # of a shard, on average
WEIGHTS = (3, 1, 2)
SHARE = 1.5  # of all words
MOST = 2  # times its size a source may be taken
SEED = 11
ROUNDS = 4
AT_ONCE = 1 << 16  # slots made at a time

DEALT = pa.schema([("number", pa.int64()), ("shard", pa.int64()), ("n", pa.int64()), ("first", pa.int64())])
SLOT = pa.schema(
    [("number", pa.int64()), ("block", pa.int64()), ("pass", pa.int64()), ("shard", pa.int64()), ("slot", pa.int64())]
)


class Permutation:
    """A pseudorandom permutation of 0 .. n-1."""

    def __init__(self, n: int, *key: int):
        self.n = n
        self.half = np.uint64(max(1, -(-max(n - 1, 1).bit_length() // 2)))
        self.mask = (np.uint64(1) << self.half) - np.uint64(1)
        self.keys = np.random.default_rng(key).integers(0, 1 << 63, ROUNDS).astype(np.uint64)

    def _mix(self, x: np.ndarray, key: np.uint64) -> np.ndarray:
        x = (x + key) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return (x ^ (x >> np.uint64(32))) & self.mask

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        left, right = x >> self.half, x & self.mask
        for key in self.keys[::-1] if back else self.keys:
            if back:
                left, right = right ^ self._mix(left, key), left
            else:
                left, right = right, left ^ self._mix(right, key)
        return (left << self.half) | right

    def _walk(self, x: np.ndarray, back: bool) -> np.ndarray:
        out = self._once(np.asarray(x).astype(np.uint64), back)
        outside = np.flatnonzero(out >= self.n)
        while outside.size:
            out[outside] = self._once(out[outside], back)
            outside = outside[out[outside] >= self.n]
        return out.astype(np.int64)

    def at(self, x: np.ndarray) -> np.ndarray:
        return self._walk(x, False)

    def place(self, y: np.ndarray) -> np.ndarray:
        """Where ``at`` gives y."""
        return self._walk(y, True)


def source_key(column: str = "source") -> Column:
    """Orders sources by code point, NULL last, and tells NULL from every text."""
    text = F.col(column).cast("string")
    return F.when(text.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), text))


def sized(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, key, size and a mark that orders rows of one id."""
    text = rows.text_or_empty()
    kept = [text.alias("text")] if with_text else []
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        source_key().alias("key"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        F.xxhash64(text).alias("mark"),
        *kept,
    )


def numbered(df: DataFrame, *order: Column) -> DataFrame:
    """Add ``number``, the 0-based rank by ``order``: ranges first, ranks within, no single task."""
    dealt = df.repartitionByRange(rows.tasks(df), *order).withColumn("part", F.spark_partition_id())
    dealt = settle(dealt)
    sizes = dealt.groupBy("part").agg(F.count("*").alias("n"))  # one row per partition
    before = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1
    return (
        dealt.withColumn("rank", rank).join(F.broadcast(before), "part")
        .withColumn("number", F.col("before") + F.col("rank"))
        .drop("part", "rank", "before")
    )


def targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST
) -> DataFrame:
    """number, key, source_size, target per source.

    A source's target is its weight times a common level, ``most`` times its size at most.
    The level rises while sources stop, one small aggregate a step.
    """
    by_source = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(
        F.array(*[F.lit(w).cast("long") for w in weights]),
        (F.col("number") % len(weights) + 1).cast("int"),
    )
    table = settle(numbered(by_source, F.col("key")).withColumn("weight", weight))
    cap = F.col("source_size") * most
    level = 0.0
    while True:
        stopped = F.col("weight") * F.lit(level) > cap
        row = table.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(stopped, cap).otherwise(0)).alias("full"),
            F.sum(F.when(stopped, 0).otherwise(F.col("weight"))).alias("open"),
        ).first()
        if not row["open"]:
            break
        raised = (share * row["all"] - row["full"]) / row["open"]
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("weight") * F.lit(level), cap.cast("double"))
    return settle(table.select("number", "key", "source_size", target.alias("target")))


def quota(size: int, target: float, block: int, order: Permutation) -> int:
    """Slots whose words come nearest to ``target``: the last block may be short."""
    blocks = order.n
    passes = int(target // size)
    rest = target - passes * size
    short = int(order.place(np.array([blocks - 1]))[0])
    lost = blocks * block - size

    def words(k: int) -> int:
        return k * block - (lost if k > short else 0)

    near = [k for k in range(int(rest // block) - 1, int(rest // block) + 4) if 0 <= k <= blocks]
    if passes >= MOST:
        return passes * blocks
    return passes * blocks + min(near, key=lambda k: (abs(words(k) - rest), k))


def deal(sources: DataFrame, shards: int, block: int, seed: int) -> DataFrame:
    """number, shard, n, first: every source's slots dealt to the shards."""

    def run(batches):
        for part in rows.slices(batches, 16):
            for number, key, size, target in zip(
                part["number"], part["key"], part["source_size"], part["target"]
            ):
                own = zlib.crc32(key.encode())
                blocks = -(-size // block)
                if not blocks:
                    continue
                n = quota(size, target, block, Permutation(blocks, seed, own, number))
                draw = np.random.default_rng([seed, own, number, 1])
                counts = draw.multinomial(n, np.full(shards, 1.0 / shards))
                at = np.flatnonzero(counts)
                counts = counts[at]
                yield rows.batch(
                    DEALT,
                    {
                        "number": np.full(at.size, number), "shard": at, "n": counts,
                        "first": np.cumsum(counts) - counts,
                    },
                )

    return sources.select("number", "key", "source_size", "target").mapInArrow(
        run, "number long, shard long, n long, first long"
    )


def slots(sources: DataFrame, block: int = BLOCK, per_shard: int = SLOTS, seed: int = SEED) -> DataFrame:
    """number, block, pass, shard, slot: the block in every slot of the mix."""
    total = sources.agg(F.sum("target")).first()[0] or 0.0
    shards = max(1, round(total / block / per_shard))
    dealt = settle(deal(sources, shards, block, seed))
    in_shard = Window.partitionBy("shard")  # one row per source
    before = F.sum("n").over(in_shard.orderBy("number")) - F.col("n")
    placed = (
        dealt.select("*", before.alias("before"), F.sum("n").over(in_shard).alias("held"))
        .join(sources.select("number", "key", "source_size"), "number")
        .repartition(rows.tasks(sources), "number", "shard")
    )

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                blocks = -(-row["source_size"] // block)
                inside = Permutation(blocks, seed, zlib.crc32(row["key"].encode()), row["number"])
                where = Permutation(row["held"], seed, row["shard"], 2)
                for start in range(0, row["n"], AT_ONCE):
                    j = np.arange(start, min(start + AT_ONCE, row["n"]))
                    k = row["first"] + j
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.full(j.size, row["number"])),
                            pa.array(inside.at(k % blocks)),
                            pa.array(k // blocks),
                            pa.array(np.full(j.size, row["shard"])),
                            pa.array(where.at(row["before"] + j)),
                        ],
                        schema=SLOT,
                    )

    # Spark takes the size of what goes in for that of the slots: they must not be broadcast.
    made = placed.mapInArrow(run, "number long, block long, pass long, shard long, slot long")
    return made.hint("shuffle_merge")


def pieces(sizes: DataFrame, sources: DataFrame, block: int = BLOCK) -> DataFrame:
    """The part of each document in each block: number, start, block, from_word, n_words.

    ``start`` is the place of the document's first word in its source.  Documents are
    dealt by ranges of (source, id), summed inside a range, and the ranges of a source
    are added up: a source with most of the rows meets in no task.
    """
    order = [F.col("key"), F.col("doc_id").asc_nulls_last(), F.col("mark")]
    dealt = settle(
        sizes.where("size > 0")
        .repartitionByRange(rows.tasks(sizes), *order)
        .withColumn("part", F.spark_partition_id())
    )
    inside = Window.partitionBy("part", "key").orderBy(*order[1:])
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = dealt.groupBy("part", "key").agg(F.sum("size").alias("n"))
    before = F.sum("n").over(Window.partitionBy("key").orderBy("part")) - F.col("n")
    heads = ranges.select("part", "key", before.alias("before"))
    placed = (
        dealt.withColumn("within", F.sum("size").over(inside) - F.col("size"))
        .join(settle(heads), ["part", "key"])
        .withColumn("start", F.col("before") + F.col("within"))
        .drop("before", "within", "part", "mark")
        .join(sources, "key")
    )
    first, last = F.col("start"), F.col("start") + F.col("size") - 1
    spread = placed.withColumn(
        "block",
        F.explode(F.sequence(F.floor(first / block).cast("long"), F.floor(last / block).cast("long"))),
    )
    begin = F.greatest(F.col("block") * block, first)
    end = F.least((F.col("block") + 1) * block - 1, last)
    return spread.withColumn("from_word", begin - first).withColumn("n_words", end - begin + 1)


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    block: int = BLOCK,
    per_shard: int = SLOTS,
    seed: int = SEED,
) -> DataFrame:
    """The mix: shard, slot, place, pass, source, doc_id, from_word, n_words, words.

    A slot's block holds parts of one document or of several; ``place`` orders them.
    """
    sizes = settle(sized(docs, True))
    sources = targets(sizes, weights, share)
    taken = pieces(sizes, sources, block).join(
        slots(sources, block, per_shard, seed), ["number", "block"]
    )
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    return taken.select(
        "shard", "slot", (F.col("start") + F.col("from_word")).alias("place"), "pass",
        F.when(F.col("key") != "1", F.substring("key", 2, 1 << 30)).alias("source"),
        "doc_id", "from_word", "n_words",
        F.slice(words, (F.col("from_word") + 1).cast("int"), F.col("n_words").cast("int")).alias("words"),
    )


def taken(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    block: int = BLOCK,
    per_shard: int = SLOTS,
    seed: int = SEED,
) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words the mix takes of every document."""
    sizes = settle(sized(docs))
    sources = targets(sizes, weights, share)
    who = ["number", "start", "doc_id", "size", "source_size", "target"]
    used = (
        pieces(sizes, sources, block)
        .join(slots(sources, block, per_shard, seed), ["number", "block"], "left")
        .groupBy(*who)
        .agg(F.sum(F.when(F.col("slot").isNotNull(), F.col("n_words")).otherwise(0)).alias("taken"))
    )
    nothing = sizes.where("size = 0").join(sources, "key").withColumn("taken", F.lit(0).cast("long"))
    out = ("doc_id", "size", "source_size", "target", "taken")
    return used.select(*out).unionByName(nothing.select(*out))
