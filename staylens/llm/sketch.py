"""Threshold-scaled sketches: document fingerprints in DataFrame functions only.

A sketch keeps every shingle hash below a fixed fraction of the hash range, and the
least hash in any case, so a text with words never has an empty one.  Two sketches
merge by union and stay sketches of the joined texts; containment and likeness of texts
of very unequal length follow from intersection sizes.

Shingles are five lower-cased words; fewer words form one shingle.  Cases: a NULL text
counts as empty and has the empty fingerprint; two empty sketches are alike (1), an
empty and a non-empty one are not (0); repeated rows keep their own places in the order
(equal ids by text); NULL ids come last in descending order; a single document is its own
successor; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm import rows

WORDS = 5
FRACTION_BITS = 2  # hashes below 2^-2 of the range are kept
SPACES = r"[\x20\x09-\x0D]+"
LOWEST = -(1 << 63)


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(text), SPACES, -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingle_hashes(hashes: str, words: int = WORDS) -> Column:
    """Hashes of all shingles of a column of word hashes."""
    h = F.col(hashes)
    many = F.transform(
        F.sequence(F.lit(0), F.size(h) - words),
        lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(words)]),
    )
    return F.when(F.size(h) >= words, many).when(F.size(h) > 0, F.array(F.xxhash64(h))).otherwise(
        F.lit([]).cast("array<bigint>")
    )


def kept(shingles: str, bits: int = FRACTION_BITS) -> Column:
    """The sketch: sorted distinct hashes under the threshold, and the least one.

    The sign bit is flipped so that signed order is the order of the hash range.
    """
    ceiling = LOWEST + (1 << (64 - bits))
    low = F.filter(shingles, lambda x: x < F.lit(ceiling))
    least = F.array_compact(F.array(F.array_min(shingles)))
    return F.array_sort(F.array_union(low, least))


def sketched(df: DataFrame, text: str, name: str, bits: int = FRACTION_BITS) -> DataFrame:
    """Add the sketch of a text column; each step is a column, so nothing is computed
    again for every element."""
    words, shingles = f"__w_{name}", f"__s_{name}"
    return (
        df.withColumn(words, word_hashes(F.col(text)))
        .withColumn(shingles, shingle_hashes(words))
        .withColumn(name, kept(shingles, bits))
        .drop(words, shingles)
    )


def merged(a: Column, b: Column) -> Column:
    """Sketch of both texts together."""
    return F.array_sort(F.array_union(a, b))


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the shingle sets."""
    both = F.size(F.array_intersect(a, b))
    either = F.size(a) + F.size(b) - both
    return F.when(either == 0, 1.0).otherwise(both / either)


def containment(a: Column, b: Column) -> Column:
    """Estimated share of the shingles of ``a`` that are in ``b``."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a))


def written(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda x: F.lpad(F.hex(x), 16, "0")), "")


def with_next(docs: DataFrame, bits: int = FRACTION_BITS) -> DataFrame:
    """doc_id, text, a, next, c: each text and its sketch with those of the next document by
    descending id, the first after the last.

    Ids are cut into ranges; each range is a window of its own, and a guest row brings the
    first document of the following range along.  Texts are shuffled once.
    """
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), rows.text_or_empty().alias("text")
    ).withColumn("place", F.coalesce("doc_id", F.lit(LOWEST)))
    n = 2 * rows.tasks(docs)
    cuts = base.agg(
        F.percentile_approx("place", [i / n for i in range(1, n)], 100 * n).alias("c")
    ).first()["c"]
    cuts = sorted(set(cuts or []))
    bounds = F.lit(cuts).cast("array<bigint>")
    # Number of cuts below the id, by binary search.
    below = F.expr("0")
    if cuts:
        steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
        zero = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))

        def halve(a, _):
            mid = F.floor((a["low"] + a["high"]) / 2).cast("int")
            right = F.get(bounds, mid) < F.col("place")
            open_ = a["low"] < a["high"]
            return F.struct(
                F.when(open_ & right, mid + 1).otherwise(a["low"]).alias("low"),
                F.when(open_ & ~right, mid).otherwise(a["high"]).alias("high"),
            )

        below = F.aggregate(steps, zero, halve, lambda a: a["low"])
    base = base.withColumn("range", below)
    # The first document of each range, a row per range; descending order follows.
    firsts = sorted(
        ((r["range"], r["first"]) for r in base.groupBy("range").agg(F.max("place").alias("first")).collect()),
        reverse=True,
    )
    guests = docs.sparkSession.createDataFrame(
        [(first, firsts[i - 1][0]) for i, (_, first) in enumerate(firsts)],
        "place long, host int",
    )
    seated = (
        base.join(F.broadcast(guests), "place", "left")  # one row per range
        .withColumn("seat", F.explode(F.array_compact(F.array(
            F.struct(F.col("range").alias("range"), F.lit(False).alias("guest")),
            F.when(
                F.col("host").isNotNull(),
                F.struct(F.col("host").alias("range"), F.lit(True).alias("guest")),
            ),
        ))))
        .select("doc_id", "text", "place", "seat.range", "seat.guest")
        .repartition(rows.tasks(docs), "range")
    )
    order = Window.partitionBy("range").orderBy("guest", F.desc("place"), "text")
    following = F.lead(F.struct("text", "a")).over(order)
    return (
        sketched(seated, "text", "a", bits).withColumn("n", following).where("not guest")
        .select("doc_id", "text", "a", F.col("n.text").alias("next"), F.col("n.a").alias("c"))
    )


def edited(text: str = "text", next_: str = "next") -> Column:
    """The text with its last half replaced by the first code points of the next one."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(
        F.substring(F.col(text), F.lit(1), F.length(text) - half),
        F.substring(F.col(next_), F.lit(1), half),
    )


def fingerprints(docs: DataFrame, bits: int = FRACTION_BITS) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text, and how like they
    are to each other and to the next document's."""
    pairs = sketched(with_next(docs, bits).withColumn("edited", edited()), "edited", "b", bits)
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return pairs.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written(a).alias("fingerprint"),
        written(b).alias("edited_fingerprint"),
        likeness(a, b).alias("near_edited"),
        likeness(a, c).alias("near_next"),
        containment(a, b).alias("contained_in_edited"),
        containment(a, c).alias("contained_in_next"),
    )
