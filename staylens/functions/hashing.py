"""Hashes that give the same value on every engine and partitioning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HASH_SPAN = 1 << 32


def portable_hash(key: Column, seed: int | str | Column) -> Column:
    """32 bits of md5 over ``key:seed`` as a long in [0, 2^32)."""
    seed_text = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws(":", key.cast("string"), seed_text)
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


# Room for every id of 64 bits, and for every time a timestamp can hold.
ID_ROOM = 10**20
ID_SHIFT = 2**63
TIME_SHIFT = 10**17
NO_TIME = 99 * 10**16


def order_key(time_micros: Column, tie: Column) -> Column:
    """(time, integer tie) packed into one decimal with their order, missing times last.

    A decimal is a fixed-width aggregation buffer, so a minimum, or max_by over it, stays
    a hash aggregate where a struct key would force a sort of the input.  Negative ids
    and times before 1970 keep their place; a missing id is the smallest.
    """
    time = time_micros.cast("decimal(18,0)") + F.lit(TIME_SHIFT).cast("decimal(18,0)")
    time = F.coalesce(time.cast("decimal(18,0)"), F.lit(NO_TIME).cast("decimal(18,0)"))
    high = (time * F.lit(str(ID_ROOM)).cast("decimal(21,0)")).cast("decimal(38,0)")
    low = tie.cast("decimal(20,0)") + F.lit(str(ID_SHIFT)).cast("decimal(20,0)")
    return (high + F.coalesce(low.cast("decimal(20,0)"), F.lit(0))).cast("decimal(38,0)")


def sha1_of(values: Column) -> Column:
    """sha1 of an array of texts joined by commas; NULL for an empty array."""
    return F.when(F.size(values) > 0, F.sha1(F.array_join(values, ",").cast("binary")))
