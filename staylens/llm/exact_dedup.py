"""Exact deduplication with an extendible-hash index in shared files.

A document's key is the 64-bit hash of its normalised text.  The directory is
addressed by the leading bits of the key: buckets that hold more distinct keys
than their capacity are split, and the directory doubles whenever the bucket to
split already uses all its bits.  Rows are dealt by their bucket (a hot key in several
shares): owner tasks read a bucket's rows by key, chain texts that collide under one key
and compare their bytes; heads of the shares of one key are then compared the same way.

Bucket entries are Parquet files in the shared folder, by bucket and key: one entry per
distinct text.  The result is read from them, and ``lookup`` finds further texts there.

Cases: a NULL text counts as empty; a NULL id sorts after all others and is
kept only if its group has no other id; of rows that repeat id and text one is
kept; an empty table gives an empty result.  Extra columns are ignored by
``groups`` and carried by ``survivors``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm import rows
from staylens.session import settle

SPACES = r"[\x20\x09-\x0D]+"
CAPACITY = 256  # distinct keys in a bucket before it splits, or 1/BUCKETS of them all
BUCKETS = 1 << 14
ALONE = -1  # link of a text that no other row of its key has
MAX_DEPTH = 16  # keys are hashes, so their first 16 bits tell some 2^14 buckets apart


def normalised(column: str = "text") -> Column:
    return F.regexp_replace(rows.text_or_empty(column), SPACES, " ")


def directory(loads: np.ndarray, capacity: int = CAPACITY) -> list[tuple[int, int, int, int]]:
    """Directory slots (slot, bucket, local_depth, load) from the key counts of the
    2^MAX_DEPTH finest prefixes."""
    finest = int(loads.size).bit_length() - 1
    below = np.concatenate([[0], np.cumsum(loads)])

    def load(prefix: int, depth: int) -> int:
        width = 1 << (finest - depth)
        return int(below[(prefix + 1) * width] - below[prefix * width])

    depth = 0
    buckets = {(0, 0): load(0, 0)}  # (prefix, local depth) -> distinct keys
    full = [(0, 0)]
    while full:
        prefix, d = full.pop()
        if buckets[prefix, d] <= capacity or d == finest:
            continue
        depth = max(depth, d + 1)  # the directory doubles when the bucket uses all its bits
        del buckets[prefix, d]
        for half in (2 * prefix, 2 * prefix + 1):
            buckets[half, d + 1] = load(half, d + 1)
            full.append((half, d + 1))
    out = []
    for bucket, ((prefix, d), n) in enumerate(
        sorted(buckets.items(), key=lambda b: b[0][0] << (finest - b[0][1]))
    ):
        span = 1 << (depth - d)
        out += [(slot, bucket, d, n) for slot in range(prefix * span, (prefix + 1) * span)]
    return out


@dataclass(frozen=True)
class Index:
    """directory: slot, bucket, local_depth, load; entries: one row per distinct text
    (bucket, key, link, keep_id, raw, group_size, text_sha256), written by bucket; members:
    one row per input row."""

    depth: int
    directory: DataFrame
    entries: DataFrame
    members: DataFrame


LINKED = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("raw", pa.int64()),
        ("key", pa.int64()),
        ("bucket", pa.int32()),
        ("sha", pa.string()),
        ("link", pa.int64()),
        ("first", pa.bool_()),
        ("head", pa.binary()),
    ]
)
LINKED_DDL = (
    "doc_id long, raw long, key long, bucket int, sha string, link long, first boolean, head binary"
)


def own(batches):
    """Chain the texts of each (key, share); rows come sorted by key, share and id.

    ``link`` names a chain link uniquely over all tasks; a link's first row of a key in
    several shares carries the bytes, for the comparison with the other shares' heads.
    """
    names = TaskContext.get().partitionId() << 36
    at, chain = None, []
    for part in rows.slices(batches):
        out = {f.name: [] for f in LINKED}
        for i, body in enumerate(part["body"]):
            where, doc_id = (part["key"][i], part["salt"][i]), part["doc_id"][i]
            if where != at:
                at, chain = where, []
            head = None
            for link in chain:
                if link["body"] == body:
                    first = link["last"] != doc_id
                    break
            else:
                link, first = {"body": body, "name": names}, True
                names += 1
                chain.append(link)
                head = body if part["shares"][i] > 1 else None
            link["last"] = doc_id
            for name in ("doc_id", "raw", "key", "bucket", "sha"):
                out[name].append(part[name][i])
            out["link"].append(link["name"])
            out["first"].append(first)
            out["head"].append(head)
        yield rows.batch(LINKED, out)


def build(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY
) -> Index:
    """Index every row of ``docs`` and group equal texts."""
    spark = docs.sparkSession
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.xxhash64(rows.text_or_empty(text_col)).alias("raw"),
        normalised(text_col).alias("norm"),
    ).withColumn("key", F.xxhash64("norm"))
    keys = settle(base.select("doc_id", "raw", "key", F.sha2("norm", 256).alias("sha")))
    counts = settle(keys.groupBy("key").agg(F.count("*").alias("n")))

    prefix = F.shiftrightunsigned("key", 64 - MAX_DEPTH)
    loads = np.zeros(1 << MAX_DEPTH, np.int64)  # distinct keys
    for row in counts.groupBy(prefix.alias("p")).count().collect():  # at most 2^16
        loads[row["p"]] = row["count"]
    slots = directory(loads, max(capacity, -(-int(loads.sum()) // BUCKETS)))
    depth = len(slots).bit_length() - 1
    table = settle(
        spark.createDataFrame(slots, "slot long, bucket int, local_depth int, load long")
    )

    def place(df: DataFrame) -> DataFrame:
        slot = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
        return (
            df.withColumn("slot", slot)
            .join(F.broadcast(table.select("slot", "bucket")), "slot")
            .drop("slot")
        )

    hot, share = rows.shares(counts)
    hot = F.broadcast(hot.select("key", F.ceil(F.col("n") / share).cast("int").alias("cut")))
    salt = F.pmod(F.xxhash64("doc_id"), F.coalesce("cut", F.lit(1))).cast("int").alias("salt")
    shared = place(
        counts.where("n > 1")
        .withColumn("shares", F.ceil(F.col("n") / share).cast("int"))
        .withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)))
        .drop("n")
    )

    def salted(df: DataFrame) -> DataFrame:
        return df.join(hot, "key", "left").withColumn("salt", salt).drop("cut")

    candidates = (
        salted(base)
        .join(shared, ["key", "salt"])
        .select(
            "doc_id", "raw", "key", "salt", "shares", "bucket",
            F.sha2("norm", 256).alias("sha"), F.encode("norm", "UTF-8").alias("body"),
        )
        .repartition(rows.tasks(docs), "bucket", "salt")  # to the owners, however the join ran
        .sortWithinPartitions("bucket", "key", "salt", F.col("doc_id").asc_nulls_last())
    )
    linked = settle(candidates.mapInArrow(own, LINKED_DDL))

    # Heads of one key's shares: equal bytes are one chain link.
    roots = (
        linked.where(F.col("head").isNotNull())
        .groupBy("key", "head")
        .agg(F.min("link").alias("root"), F.collect_set("link").alias("links"))
        .select(F.explode("links").alias("link"), "root")
    )
    locals_ = linked.groupBy("key", "link").agg(
        F.min("doc_id").alias("least"),
        F.count("*").alias("n"),
        F.first("bucket").alias("bucket"),
        F.first("sha").alias("sha"),
    )
    links = locals_.join(roots, "link", "left").withColumn("root", F.coalesce("root", "link"))
    texts = links.groupBy("key", "root").agg(
        F.min("least").alias("keep_id"),
        F.sum("n").alias("group_size"),
        F.first("bucket").alias("bucket"),
        F.first("sha").alias("sha"),
    )
    single = place(
        salted(keys).join(shared.select("key", "salt"), ["key", "salt"], "left_anti")
    )
    none = F.lit(None).cast("long").alias("raw")
    entries = texts.select(
        "bucket", "key", F.col("root").alias("link"), "keep_id", none, "group_size",
        F.col("sha").alias("text_sha256"),
    ).unionByName(
        single.select(
            "bucket", "key", F.lit(ALONE).cast("long").alias("link"), F.col("doc_id").alias("keep_id"),
            "raw", F.lit(1).cast("long").alias("group_size"), F.col("sha").alias("text_sha256"),
        )
    )
    entries = settle(
        entries.repartition(rows.tasks(docs), "bucket").sortWithinPartitions("bucket", "key")
    )

    # Rows in chains find their text's entry; a text that is alone is its entry.
    chains = entries.where(F.col("link") != ALONE).select(
        "key", F.col("link").alias("root"), "keep_id", "group_size", "text_sha256"
    )
    by_link = settle(links.select("key", "link", "root").join(chains, ["key", "root"]))
    many = linked.select("doc_id", "raw", "key", "link", "first").join(by_link, ["key", "link"]).select(
        "doc_id", "raw", "keep_id", "group_size",
        (F.col("first") & F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )
    one = entries.where(F.col("link") == ALONE).select(
        F.col("keep_id").alias("doc_id"), "raw", "keep_id", "group_size",
        F.lit(True).alias("kept"), "text_sha256",
    )
    return Index(depth, table, entries, many.unionByName(one))


def lookup(index: Index, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, keep_id, group_size of further documents whose text the index holds."""
    norm = normalised(text_col)
    asked = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(norm).alias("key"),
        F.sha2(norm, 256).alias("text_sha256"),
    )
    bits = index.depth
    slot = F.shiftrightunsigned("key", 64 - bits) if bits else F.lit(0).cast("long")
    placed = asked.withColumn("slot", slot).join(
        F.broadcast(index.directory.select("slot", "bucket")), "slot"  # at most 2^16 rows
    )
    return placed.join(index.entries, ["bucket", "key", "text_sha256"]).select(
        "doc_id", "keep_id", "group_size"
    )


def groups(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    return build(docs, capacity=capacity).members.select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def survivors(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    members = settle(
        build(docs, capacity=capacity).members.where("group_size > 1")
        .select("doc_id", "raw", F.col("kept").alias("stays"))
    )
    return rows.without(docs, members)
