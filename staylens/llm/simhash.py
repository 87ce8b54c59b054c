"""SimHash near-duplicate detection with deletion-variant signatures.

A fingerprint has 64 bits; two texts link at 3 or fewer differing bits.  Cut into two
halves, a linked pair has a half that differs in at most one bit.  Each half is
indexed under its 32 variants with one bit deleted, so linked fingerprints meet
under an equal signature and are verified there.

Signatures are grouped by a sorted shuffle and read as a stream.  Within a group
only a spanning forest of the verified links is emitted, never all pairs.  A group
of more than BLOCK fingerprints is cut into blocks, and every two blocks are
compared in a task of their own.

Cases: a NULL or blank text has fingerprint zero and links like any other; a NULL
id never names a component unless all its ids are NULL; repeated rows share a
fingerprint; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm import rows
from staylens.llm.components import label_components
from staylens.session import settle

BITS = 64
HALF = 32
MAX_DIFFERENT = 3  # two halves: one differs by floor(3 / 2) = 1 bit at most
BLOCK = 4096  # fingerprints compared at once
SHINGLES_AT_ONCE = 1 << 16
SEED = 42

PRINTS = pa.schema([("doc_id", pa.int64()), ("raw", pa.int64()), ("fp", pa.int64())])
PAIRS = pa.schema(
    [("a", pa.int64()), ("b", pa.int64()), ("sig", pa.int64()), ("block", pa.int32()),
     ("fps", pa.binary())]
)
PAIRS_DDL = "a long, b long, sig long, block int, fps binary"


def fingerprint(text: bytes, words_per_shingle: int) -> int:
    """Majority bit vector of the shingle hashes, as an unsigned 64-bit integer.

    Only A-Z are lowered and words end at ASCII white space, which is what the two
    bytes methods do.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])  # end of each word and its blank
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    width = min(words_per_shingle, len(words))
    ends = (ends[width - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(ends), SHINGLES_AT_ONCE):
        hashes = np.array(
            [
                digest(joined[s:e], SEED)
                for s, e in zip(starts[i : i + SHINGLES_AT_ONCE], ends[i : i + SHINGLES_AT_ONCE])
            ],
            dtype=">u8",
        )
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int64)
    ones = counts * 2 > len(ends)
    return int.from_bytes(np.packbits(ones).tobytes(), "big")


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fingerprints(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """doc_id, raw (hash of the text), fp (the fingerprint's bits as a signed long)."""

    def run(batches):
        for part in rows.slices(batches):
            part["fp"] = [signed(fingerprint(t or b"", words_per_shingle)) for t in part["body"]]
            yield rows.batch(PRINTS, part)

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(rows.text_or_empty()).alias("raw"),
        F.encode(F.col("text").cast("string"), "UTF-8").alias("body"),
    ).mapInArrow(run, "doc_id long, raw long, fp long")


def signatures(fps: DataFrame) -> DataFrame:
    """sig, fp: 64 rows per fingerprint.  A signature packs the half (1 bit), the deleted
    position (5 bits) and the half's other 31 bits."""
    deleted = F.expr(
        "transform(sequence(0, 63), i -> "
        "  (cast(i as bigint) << 31) | ("
        "    ((h[i div 32] >> ((i % 32) + 1)) << (i % 32))"
        "    | (h[i div 32] & ((1L << (i % 32)) - 1))))"
    )
    halves = F.array(
        F.shiftrightunsigned("fp", HALF), F.col("fp").bitwiseAND(F.lit((1 << HALF) - 1))
    )
    return fps.withColumn("h", halves).select(F.explode(deleted).alias("sig"), "fp")


def forest(left: np.ndarray, right: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the links among ``left``, or between ``left`` and ``right``.

    Components grow by whole rows of the distance matrix: every fingerprint is
    compared with those not yet reached, and leaves them when reached.
    """
    if right is None:
        rest, edges = left, []
        while rest.size:
            reached, rest = [rest[0]], rest[1:]
            while reached and rest.size:
                at = reached.pop()
                near = np.bitwise_count(rest ^ at) <= MAX_DIFFERENT
                if near.any():
                    found = rest[near]
                    edges += [(at, x) for x in found]
                    reached += list(found)
                    rest = rest[~near]
        return edges
    sides = {0: left, 1: right}
    edges = []
    while sides[0].size:
        reached = [(0, sides[0][0])]
        sides[0] = sides[0][1:]
        while reached:
            side, at = reached.pop()
            rest = sides[1 - side]
            near = np.bitwise_count(rest ^ at) <= MAX_DIFFERENT
            if near.any():
                found = rest[near]
                edges += [(at, x) for x in found]
                reached += [(1 - side, x) for x in found]
                sides[1 - side] = rest[~near]
    return edges


def pairs_batch(edges, blocks=()) -> pa.RecordBatch:
    u8 = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
    n = len(blocks)
    return rows.batch(
        PAIRS,
        {
            "a": u8[:, 0].tolist() + [None] * n,
            "b": u8[:, 1].tolist() + [None] * n,
            "sig": [None] * len(u8) + [b[0] for b in blocks],
            "block": [None] * len(u8) + [b[1] for b in blocks],
            "fps": [None] * len(u8) + [b[2].astype("<u8").tobytes() for b in blocks],
        },
    )


def meet(batches):
    """Links within each run of one signature; rows come sorted by signature.

    A run is held up to BLOCK fingerprints at a time.  A longer run's blocks are emitted
    as well, to be compared with one another by ``across``.
    """
    sig, held, block = None, np.zeros(0, np.uint64), 0

    def close(edges, blocks, last):
        nonlocal held, block
        if held.size > 1:
            edges += forest(held)
        if block or not last:
            blocks.append((int(sig), block, held))
        held, block = np.zeros(0, np.uint64), 0 if last else block + 1

    for b in batches:
        sigs = b.column(0).to_numpy(zero_copy_only=False)
        fps = b.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        if not sigs.size:
            continue
        edges, blocks = [], []
        cuts = np.flatnonzero(np.diff(sigs)) + 1
        bounds = np.concatenate([[0], cuts, [sigs.size]])
        # Runs of one row are passed over, but the first and last may continue elsewhere.
        wide = np.flatnonzero(np.diff(bounds) > 1)
        for k in np.union1d(wide, [0, bounds.size - 2]).tolist():
            start, end = int(bounds[k]), int(bounds[k + 1])
            if sig is None or sigs[start] != sig:
                if sig is not None and held.size:
                    close(edges, blocks, True)
                sig, held, block = sigs[start], np.zeros(0, np.uint64), 0
            for i in range(start, end, BLOCK):
                piece = fps[i : min(i + BLOCK, end)]
                room = BLOCK - held.size
                held = np.concatenate([held, piece[:room]])
                if held.size == BLOCK:
                    close(edges, blocks, False)
                    held = piece[room:]
        yield pairs_batch(edges, blocks)
    edges, blocks = [], []
    if sig is not None and (held.size or block):
        close(edges, blocks, True)
    yield pairs_batch(edges, blocks)


def across(batches):
    """Links between two blocks of one signature."""
    for b in batches:
        for left, right in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            yield pairs_batch(forest(np.frombuffer(left, "<u8"), np.frombuffer(right, "<u8")))


def links(fps: DataFrame) -> DataFrame:
    """a, b: links between distinct fingerprints; every linked pair is connected by them."""
    n = rows.tasks(fps)
    dealt = signatures(fps).repartition(n, "sig").sortWithinPartitions("sig")
    met = settle(dealt.mapInArrow(meet, PAIRS_DDL))
    blocks = met.where(F.col("fps").isNotNull())
    one = blocks.select("sig", F.col("block").alias("i"), F.col("fps").alias("left"))
    two = blocks.select("sig", F.col("block").alias("j"), F.col("fps").alias("right"))
    between = (
        one.join(two, "sig").where("i < j").select("left", "right")
        .repartition(n).mapInArrow(across, PAIRS_DDL)
    )
    return met.where(F.col("a").isNotNull()).select("a", "b").unionByName(between.select("a", "b"))


def components(prints: DataFrame) -> DataFrame:
    """fp, root, component_id for every distinct fingerprint of ``prints`` (doc_id, fp);
    root is the component's least fingerprint."""
    least = settle(prints.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = label_components(links(least.select("fp")))
    rooted = least.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    smallest = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.select("fp", "root").join(smallest, "root").select("fp", "root", "component_id")


def near_groups(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """One row per document: doc_id, raw, root, fingerprint (16 hex digits), component_id."""
    prints = settle(fingerprints(docs, words_per_shingle))
    found = settle(components(prints))
    return prints.join(found, "fp").select(
        "doc_id",
        "raw",
        "root",
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        "component_id",
    )


def survivors(docs: DataFrame, words_per_shingle: int = 3) -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns: the one
    of smallest id, a NULL id last, and of one id the smallest text hash."""
    groups = settle(near_groups(docs, words_per_shingle).select("doc_id", "raw", "root"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "raw")
    many = groups.groupBy("root").agg(F.count("*").alias("n"), F.min(order).alias("k")).where("n > 1")
    members = groups.join(many, "root")
    stays = F.col("doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("raw") == F.col("k.raw"))
    gone = settle(members.select("doc_id", "raw", stays.alias("stays")))
    return rows.without(docs, gone)
