"""Distributed ranks, prefix sums and exact quantiles.

A window without partition keys, or with one hot key, would pull the data into
one task.  Instead every value is read as ordered digits of 16 bits, from coarse to
fine: sums run inside the finest group, then over the groups of the next coarser
digit, and the offsets are joined back.  The digits are a pure function of the
value, so a recomputed task always sees the same groups, and no group can have
more than about 65,536 children however the values are distributed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.functions.hashing import portable_hash
from staylens.functions.text import columns_of
from staylens.session import settle

LARGEST = 1.7976931348623157e308
LEAST_EXPONENT = -1000
DIGIT = float(1 << 16)
DIGITS = ("_digit0", "_digit1", "_digit2")


def with_digits(df: DataFrame, value: str) -> DataFrame:
    """Add the ordered digits of a non-null double column.

    The first digit holds sign, exponent and four bits of the mantissa, the
    others sixteen bits each; the last sixteen are left to the order of the rows.
    Scaling by powers of two and taking off the integer part are exact.
    """
    size = F.least(F.abs(F.col(value)), F.lit(LARGEST))
    exponent = F.coalesce(F.floor(F.log2(size)), F.lit(LEAST_EXPONENT))
    exponent = F.greatest(exponent, F.lit(LEAST_EXPONENT))
    sign = F.signum(F.col(value))
    scaled = F.col("_size") * F.pow(F.lit(2.0), -F.col("_exponent").cast("double")) * 16.0
    rest = (F.col("_scaled") - F.floor("_scaled")) * DIGIT
    first = (F.col("_exponent") - LEAST_EXPONENT + 1) * 32 + F.floor("_scaled")
    return (
        df.withColumns({"_size": size, "_exponent": exponent, "_sign": sign})
        .withColumn("_scaled", scaled)
        .withColumn("_rest", rest)
        .withColumns({
            DIGITS[0]: (F.col("_sign") * first).cast("long"),
            DIGITS[1]: (F.col("_sign") * F.floor("_rest")).cast("long"),
            DIGITS[2]: (
                F.col("_sign") * F.floor((F.col("_rest") - F.floor("_rest")) * DIGIT)
            ).cast("long"),
        })
        .drop("_size", "_exponent", "_sign", "_scaled", "_rest")
    )


def running_totals(
    rows: DataFrame,
    keys: Sequence[str],
    levels: Sequence[str],
    order: Sequence[str],
    measures: Sequence[str],
) -> DataFrame:
    """Add ``cum_<m>`` (inclusive) and ``total_<m>`` per key in ascending order.

    ``levels`` go from coarse to fine and must be ordered like ``order``.
    """
    inside = Window.partitionBy(*keys, *levels).orderBy(*order)
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = [F.sum(m).over(inside).alias(f"cum_{m}") for m in measures]
    if not levels:
        whole = Window.partitionBy(*keys)
        return rows.select(
            "*", *sums, *[F.sum(m).over(whole).alias(f"total_{m}") for m in measures]
        )
    place = [*keys, *levels]
    groups = rows.groupBy(*place).agg(*[F.sum(m).alias(m) for m in measures])
    offsets = running_totals(groups, keys, levels[:-1], [levels[-1]], measures).select(
        *place,
        *[(F.col(f"cum_{m}") - F.col(m)).alias(f"before_{m}") for m in measures],
        *[F.col(f"total_{m}") for m in measures],
    )
    return (
        rows.select("*", *sums)
        .join(offsets, place)
        .select(
            *columns_of(rows),
            *[(F.col(f"cum_{m}") + F.col(f"before_{m}")).alias(f"cum_{m}") for m in measures],
            *[F.col(f"total_{m}") for m in measures],
        )
    )


def cumulative_values(
    counts: DataFrame, keys: Sequence[str], value: str, measures: Sequence[str]
) -> DataFrame:
    """Running totals of an already grouped (keys, value) table, by value.

    Rows and the groups of each digit are views of that table, so it is settled:
    the data behind it is read once.
    """
    placed = settle(with_digits(counts, value))
    return running_totals(placed, keys, DIGITS, [value], measures).drop(*DIGITS)


def exact_quantiles(
    df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Exact interpolated quantiles per key: (keys, ordinal, prob, value).

    Equal values are counted before anything is shuffled, then each value knows
    the ranks it covers; only the few rows that hold a wanted rank go on.
    """
    number = F.col(value).cast("double")
    counts = (
        df.filter(number.isNotNull() & ~F.isnan(number))
        .groupBy(*keys, number.alias("_v"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    cum = cumulative_values(counts, keys, "_v", ["_n"])
    first, last = F.col("cum__n") - F.col("_n"), F.col("cum__n") - 1
    wanted = []
    for ordinal, prob in enumerate(probs):
        position = F.lit(float(prob)) * (F.col("total__n") - 1)
        low = F.floor(position)
        wanted.append(
            F.struct(
                F.lit(ordinal).alias("ordinal"),
                F.lit(float(prob)).alias("prob"),
                low.alias("low"),
                F.ceil(position).alias("high"),
                (position - low).alias("part"),
            )
        )

    def covered(w: Column) -> Column:
        return w["low"].between(first, last) | w["high"].between(first, last)

    hits = cum.select(
        *keys,
        "_v",
        first.alias("first"),
        last.alias("last"),
        F.explode(F.filter(F.array(*wanted), covered)).alias("w"),
    ).select(*keys, "_v", "first", "last", "w.*")
    ends = hits.groupBy(*keys, "ordinal", "prob", "part").agg(
        F.max(F.when(F.col("low").between(F.col("first"), F.col("last")), F.col("_v"))).alias("a"),
        F.max(F.when(F.col("high").between(F.col("first"), F.col("last")), F.col("_v"))).alias("b"),
    )
    gap = F.col("b") - F.col("a")
    blend = F.when(F.col("part") < 0.5, F.col("a") + gap * F.col("part")).otherwise(
        F.col("b") - gap * (F.lit(1.0) - F.col("part"))
    )
    return ends.select(*keys, "ordinal", "prob", blend.alias("value"))


ORDINALS = 1 << 15  # rows a task numbers


def ordinals(df: DataFrame, order: Sequence[str], name: str = "ordinal") -> DataFrame:
    """Add the 0-based rank by ``order``, which should tell all rows apart.

    Rows are dealt by ranges of about ``ORDINALS`` rows, numbered inside, and the sizes of the
    ranges are added up: one row per range is all that meets in one place.
    """
    held = settle(df)
    parts = -(-held.count() // ORDINALS)
    if parts <= 1:  # one range is one task
        return held.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)
    dealt = held.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id())
    dealt = settle(dealt)
    sizes = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return (
        dealt.withColumn("_inside", inside)
        .join(before, "_part")
        .select(*columns_of(df), (F.col("_before") + F.col("_inside")).alias(name))
    )


def as_of(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    value: str,
    start: str,
    payload: Sequence[str],
) -> DataFrame:
    """``rows`` with the payload of the last table row whose ``start`` is at most ``value``.

    Both sides are dealt by ranges of (keys, value) and read in order; what precedes a
    range, the last table row of the ranges before it, is one row per range.  Rows should
    be distinct in (keys, value), so that no value is a range of its own.
    """
    keys = list(keys)
    both = rows.select(
        *keys, F.col(value).alias("_v"), F.lit(1).alias("_side"),
        *[F.lit(None).cast(table.schema[c].dataType).alias(c) for c in payload],
    ).unionByName(
        table.select(*keys, F.col(start).alias("_v"), F.lit(0).alias("_side"), *payload)
    )
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = settle(
        both.repartitionByRange(n, *keys, "_v", "_side").withColumn("_part", F.spark_partition_id())
    )
    held = F.when(F.col("_side") == 0, F.struct(*payload))
    inside = Window.partitionBy("_part", *keys).orderBy("_v", "_side")
    inside = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    near = dealt.withColumn("_near", F.last(held, ignorenulls=True).over(inside))
    lasts = dealt.groupBy("_part", *keys).agg(
        F.max_by(held, F.when(F.col("_side") == 0, F.col("_v"))).alias("_last")
    )
    earlier = Window.partitionBy(*keys).orderBy("_part") if keys else Window.orderBy("_part")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    lasts = lasts.select("_part", *keys, F.last("_last", ignorenulls=True).over(earlier).alias("_before"))
    joined = near.filter(F.col("_side") == 1).join(lasts, ["_part", *keys])
    found = F.coalesce("_near", "_before")
    return joined.select(*keys, F.col("_v").alias(value), *[found[c].alias(c) for c in payload])


def hash_rank(
    df: DataFrame, key: str, seed: int, groups: Sequence[str] = (), name: str = "rank"
) -> DataFrame:
    """Dense 0-based rank by (hash, key) inside each group, plus ``group_size``."""
    hashed = df.withColumn("_h", portable_hash(F.col(key), seed)).withColumn("_one", F.lit(1))
    placed = hashed.withColumn("_block", F.shiftright("_h", 22)).withColumn(
        "_cell", F.shiftright("_h", 12)
    )
    ranked = running_totals(placed, groups, ["_block", "_cell"], ["_h", key], ["_one"])
    return (
        ranked.withColumn(name, F.col("cum__one") - 1)
        .withColumn("group_size", F.col("total__one"))
        .drop("_h", "_one", "_block", "_cell", "cum__one", "total__one")
    )
