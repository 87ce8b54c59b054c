"""Deterministic splits, folds, samples and bootstrap replicates.

Rows are ordered by a portable hash of their id, so a result depends on ids and
seed only, never on partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.functions.hashing import HASH_SPAN, portable_hash
from staylens.functions.text import columns_of, quoted
from staylens.operators.ranking import hash_rank
from staylens.session import attach, settle

BUCKET_SHIFT = 16  # 2^16 hash buckets per stratum


def hash_slices(
    df: DataFrame,
    key: str,
    seed: int,
    cuts: Callable[[Column], Sequence[Column]],
    strata: Sequence[str] = (),
    name: str = "slice",
) -> DataFrame:
    """Cut each stratum, ordered by (hash, key), at given ranks.

    ``cuts(size)`` gives the ascending 0-based ranks at which slices 1, 2, ...
    start.  A histogram of hash buckets locates each cut, only the buckets that
    hold a cut are ranked, and the rows are then labelled by comparing their own
    hash with the cut: no shuffle or sort of the rows themselves, however large
    a single stratum is.  The cuts are found when the function is called.  A NULL
    stratum is an error.
    """
    strata = list(strata)
    if strata and not df.filter(F.greatest(*[F.col(c).isNull() for c in strata], F.lit(False))).isEmpty():
        raise ValueError(f"NULL in the strata {strata}")
    keyed = df.withColumn("_h", portable_hash(F.col(key), seed))
    keyed = keyed.withColumn("_b", F.shiftright("_h", BUCKET_SHIFT))
    slim = keyed.select(*strata, key, "_h", "_b")
    hist = slim.groupBy(*strata, "_b").agg(F.count(F.lit(1)).alias("_n"))
    running = Window.partitionBy(*strata).orderBy("_b")
    running = running.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edges = hist.select(
        *strata,
        "_b",
        "_n",
        (F.sum("_n").over(running) - F.col("_n")).alias("_before"),
        F.sum("_n").over(Window.partitionBy(*strata)).alias("_size"),
    )
    ranks = [F.greatest(c.cast("long"), F.lit(0).cast("long")) for c in cuts(F.col("_size"))]
    placed = edges.select("*", *[r.alias(f"_at{j}") for j, r in enumerate(ranks)])
    each = F.explode(
        F.array(*[
            F.struct(F.lit(j).alias("j"), F.col(f"_at{j}").alias("at")) for j in range(len(ranks))
        ])
    ).alias("_c")
    wanted = (
        placed.select(*strata, "_b", "_n", "_before", each)
        .select(*strata, "_b", "_n", F.col("_c.j").alias("_j"),
                (F.col("_c.at") - F.col("_before")).alias("_at"))
        .filter((F.col("_at") >= 0) & (F.col("_at") < F.col("_n")))
        .drop("_n")
    )
    wanted = settle(wanted)  # one row per stratum and cut
    in_bucket = Window.partitionBy(*strata, "_b").orderBy("_h", key)
    boundary = slim.join(wanted.select(*strata, "_b").distinct(), [*strata, "_b"], "left_semi")
    ranked = boundary.withColumn("_r", F.row_number().over(in_bucket) - 1)
    found = ranked.join(wanted, [*strata, "_b"]).filter(F.col("_r") == F.col("_at"))
    here = F.struct(F.col("_h").alias("h"), F.col(key).alias("k"))
    names = [f"_cut{j}" for j in range(len(ranks))]
    points = [F.max(F.when(F.col("_j") == j, here)).alias(n) for j, n in enumerate(names)]
    if strata:
        keyed = attach(keyed, found.groupBy(*strata).agg(*points), strata, "left")
        limits = [F.col(n) for n in names]
    else:
        row = settle(found.agg(*points)).select(F.struct(*names)).scalar()
        limits = [row[n] for n in names]
    label = F.lit(0)
    for limit in limits:
        label = label + F.coalesce((here >= limit).cast("int"), F.lit(0))
    return keyed.withColumn(name, label).select(*columns_of(df), name)


def stratified_split(
    df: DataFrame,
    key: str,
    label: str,
    fractions: Sequence[float] = (0.6, 0.2, 0.2),
    names: Sequence[str] = ("train", "val", "test"),
    seed: int = 42,
) -> DataFrame:
    """Add ``split``; every stratum is divided in the given proportions."""
    bounds = [sum(fractions[: i + 1]) for i in range(len(fractions) - 1)]

    def cuts(size: Column) -> list[Column]:
        return [F.floor(size * F.lit(round(b, 12)) + F.lit(0.5)) for b in bounds]

    cut = hash_slices(df, key, seed, cuts, [label], "_slice")
    split = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_slice") + 1)
    return cut.withColumn("split", split).drop("_slice")


def stratified_folds(
    df: DataFrame, key: str, label: str, k: int = 5, seed: int = 42
) -> DataFrame:
    """Add ``fold`` in 0..k-1; fold sizes per class differ by at most one."""

    def cuts(size: Column) -> list[Column]:
        return [F.floor((size * i + (k - 1)) / F.lit(k)) for i in range(1, k)]

    return hash_slices(df, key, seed, cuts, [label], "fold")


def sample_n(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Uniform sample of ``n`` rows (all rows when there are fewer)."""
    cut = hash_slices(df, key, seed, lambda size: [F.lit(n)], name="_slice")
    return cut.filter(F.col("_slice") == 0).drop("_slice")


def capped_classes(
    df: DataFrame, key: str, label: str, cap: int, pos_cap: int | None = None, seed: int = 42
) -> DataFrame:
    """At most ``cap`` rows: positives up to ``pos_cap``, negatives fill up.

    Positives also take the room that negatives leave, so a table within the cap
    stays whole and one row more changes nothing else.
    """
    sizes = df.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(label) == 1).alias("n_pos")
    )
    total, positives = sizes.select("n").scalar(), sizes.select("n_pos").scalar()
    budget = F.lit(cap).cast("long")
    first = positives if pos_cap is None else F.least(positives, F.lit(pos_cap).cast("long"))
    keep_pos = F.least(positives, F.greatest(first, budget - (total - positives)))
    room = F.greatest(budget - keep_pos, F.lit(0).cast("long"))

    def cuts(size: Column) -> list[Column]:
        return [F.least(size, F.when(F.col(label) == 1, keep_pos).otherwise(room))]

    cut = hash_slices(df, key, seed, cuts, [label], "_slice")
    return cut.filter(F.col("_slice") == 0).drop("_slice")


def downsample_majority(
    df: DataFrame, key: str, label: str, cap: int = 12_000, seed: int = 42
) -> DataFrame:
    """Keep every positive and as many negatives as fit under the cap."""
    return capped_classes(df, key, label, cap, None, seed)


def background_sample(
    df: DataFrame, key: str, label: str, cap: int = 4_000, seed: int = 42
) -> DataFrame:
    """Capped sample in which positives take at most half of the budget."""
    return capped_classes(df, key, label, cap, cap // 2, seed)


def split_by_counts(
    df: DataFrame,
    key: str,
    counts: Sequence[int],
    names: Sequence[str] = ("train", "val", "test"),
    seed: int = 2025,
) -> DataFrame:
    """Rebuild a split from its sizes: consecutive slices of the hashed order."""
    bounds = [sum(counts[: i + 1]) for i in range(len(counts))]
    cut = hash_slices(df, key, seed, lambda size: [F.lit(b) for b in bounds], name="_slice")
    split = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_slice") + 1)
    return cut.filter(F.col("_slice") < len(counts)).withColumn("split", split).drop("_slice")


REPLICATES = 8  # of a block: one sha256 gives so many 32-bit hashes


def poisson_limits(tail: float = 1e-10) -> list[str]:
    """Hashes, as eight hex digits, at which a Poisson(1) count steps up by one."""
    limits, mass, below, k = [], math.exp(-1.0), 0.0, 0
    while 1.0 - below > tail:
        below += mass
        limits.append(f"{min(int(below * HASH_SPAN), HASH_SPAN - 1):08x}")
        k += 1
        mass /= k
    return limits


def poisson_weights(digest: Column) -> list[Column]:
    """Poisson(1) weights of a row in the replicates of a block, from its hash there."""
    out = []
    for j in range(REPLICATES):
        h = F.substring(digest, 8 * j + 1, 8)
        weight = F.when(h < poisson_limits()[0], 0)
        for count, limit in enumerate(poisson_limits()[1:], 1):
            weight = weight.when(h < limit, count)
        out.append(weight.otherwise(len(poisson_limits())).cast("long"))
    return out


def weight_sql(digits: str) -> str:
    """The weight of eight hex digits in SQL."""
    steps = [f"WHEN {digits} < '{limit}' THEN {count}" for count, limit in enumerate(poisson_limits())]
    return f"CASE {' '.join(steps)} ELSE {len(steps)} END"


def with_blocks(df: DataFrame, key: str, n_rep: int, seed: int) -> DataFrame:
    """One row per block of replicates: ``block`` and the row's hash ``digest`` in it."""
    last = -(-n_rep // REPLICATES) - 1
    spread = df.select("*", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("block"))
    text = F.concat_ws(":", F.col(key).cast("string"), F.col("block").cast("string"), F.lit(str(seed)))
    return spread.withColumn("digest", F.sha2(text, 256))


def replicate_sums(
    df: DataFrame,
    key: str,
    n_rep: int,
    by: Sequence[str],
    measures: Mapping[str, Callable[[Column], Column]],
    seed: int = 42,
) -> DataFrame:
    """Sums over Poisson weights per ``by`` and block, ``<measure>_<j>`` for each replicate.

    A measure maps a row's weight to what is summed.  The weights of a block follow from
    the key alone, so equal rows are counted and the rows of a key held together: a key is
    hashed once a block for all its targets and scores.  The sums of a block are a vector
    that adds up on the map side, so what is shuffled is cells x replicates, not rows x
    replicates, wherever rows share a cell.
    """
    columns = [F.col(quoted(c)) for c in df.columns]
    rows = df.groupBy(*columns).agg(F.count(F.lit(1)).alias("_n"))
    # a row is small, but makes n_rep weights: by its size Spark would deal it to too few tasks
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    rows = rows.withColumn("_key", F.col(quoted(key))).repartition(tasks, "_key")
    held = rows.groupBy("_key").agg(
        F.collect_list(F.struct(*columns, "_n")).alias("_rows")
    )
    weighted = with_blocks(held, "_key", n_rep, seed)
    weights = [w.alias(f"_w{j}") for j, w in enumerate(poisson_weights(F.col("digest")))]
    weighted = weighted.select("block", "_rows", *weights)
    weighted = weighted.select("block", *[f"_w{j}" for j in range(REPLICATES)], F.explode("_rows").alias("_row"))
    weighted = weighted.select("block", *[f"_w{j}" for j in range(REPLICATES)], "_row.*")
    sums = [
        F.sum(value(F.col(f"_w{j}")) * F.col("_n")).alias(f"{name}_{j}")
        for name, value in measures.items()
        for j in range(REPLICATES)
    ]
    return weighted.groupBy(*by, "block").agg(*sums)


def replicate_rows(
    sums: DataFrame, n_rep: int, by: Sequence[str], measures: Sequence[str]
) -> DataFrame:
    """One row per (by, replicate) from the vectors of the blocks."""
    each = [
        F.struct(F.lit(j).alias("j"), *[F.col(f"{m}_{j}").alias(m) for m in measures])
        for j in range(REPLICATES)
    ]
    long = sums.select(*by, "block", F.explode(F.array(*each)).alias("r"))
    replicate = (F.col("block") * REPLICATES + F.col("r.j")).cast("int").alias("replicate")
    out = long.select(*by, replicate, *[F.col(f"r.{m}").alias(m) for m in measures])
    return out.filter(F.col("replicate") < n_rep)


def bootstrap(
    df: DataFrame,
    key: str,
    n_rep: int,
    seed: int = 42,
    method: str = "exact",
    groups: Sequence[str] = (),
) -> DataFrame:
    """Replicates as weights: one row per (replicate, drawn row) with ``weight``.

    ``exact`` draws as many rows as the group holds, with replacement.
    ``poisson`` gives each row an independent Poisson(1) weight; it needs no
    ranks and no join, which is what very large tables want.
    """
    reps = F.explode(F.sequence(F.lit(0), F.lit(n_rep - 1))).alias("replicate")
    if method == "poisson":
        blocks = with_blocks(df, key, n_rep, seed)
        each = [
            F.struct(F.lit(j).alias("j"), w.alias("weight"))
            for j, w in enumerate(poisson_weights(F.col("digest")))
        ]
        spread = blocks.select(*columns_of(df), "block", F.explode(F.array(*each)).alias("_r"))
        replicate = (F.col("block") * REPLICATES + F.col("_r.j")).cast("int").alias("replicate")
        weighted = spread.select(*columns_of(df), replicate, F.col("_r.weight").alias("weight"))
        return weighted.filter((F.col("weight") > 0) & (F.col("replicate") < n_rep))
    if method != "exact":
        raise ValueError(f"unknown method {method!r}")
    groups = list(groups)
    ranked = settle(hash_rank(df, key, seed, groups, "_rank"))
    slot = F.concat_ws(":", F.col("replicate").cast("string"), F.col("_rank").cast("string"))
    draws = (
        ranked.select(*groups, "_rank", "group_size", reps)
        .select(*groups, "replicate", F.pmod(portable_hash(slot, seed), "group_size").alias("_rank"))
        .groupBy(*groups, "replicate", "_rank")
        .agg(F.count(F.lit(1)).alias("weight"))
    )
    return ranked.join(draws, [*groups, "_rank"]).select(*columns_of(df), "replicate", "weight")
