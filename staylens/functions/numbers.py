"""Numeric coercion, grids and normalisation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text accepted as a number.  Narrower than Spark's own cast, which also takes
# type suffixes such as "1.5d".
NUMBER_TEXT = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_TEXT = r"^\s*[+-]?(inf|infinity)\s*$"


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def to_number(text: Column) -> Column:
    """Coerce text to double; anything that is not a plain number is NULL."""
    as_text = text.cast("string")
    infinite = F.when(F.trim(as_text).startswith("-"), F.lit(float("-inf"))).otherwise(
        F.lit(float("inf"))
    )
    return F.when(as_text.rlike(NUMBER_TEXT), F.trim(as_text).try_cast("double")).when(
        F.lower(as_text).rlike(INFINITY_TEXT), infinite
    )


def clip(value: Column, low: float, high: float) -> Column:
    """Clip to [low, high]; NULL stays NULL."""
    return F.when(value < low, F.lit(low)).when(value > high, F.lit(high)).otherwise(value)


def zscore(value: Column, mean: Column, std: Column, eps: float = 1e-12) -> Column:
    return (value - mean) / (std + F.lit(eps))


def guarded_ratio(top: Column, bottom: Column, eps: float = 1e-9) -> Column:
    """top / (bottom + eps): the epsilon form of a possibly empty ratio."""
    return top / (bottom + F.lit(eps))


def ratio_or_zero(top: Column, bottom: Column) -> Column:
    """top / bottom, 0 where bottom is 0."""
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def grid_step(low: float, high: float, points: int) -> float:
    return (high - low) / (points - 1)


def grid_value(index: Column, low: float, high: float, points: int) -> Column:
    """Point ``index`` of an evenly spaced grid; the step is computed first."""
    return F.lit(low) + index * F.lit(grid_step(low, high, points))


def grid_index(value: Column, low: float, high: float, points: int) -> Column:
    """Largest grid index whose point is <= value; -1 below the grid.

    The floored quotient can be off by one in the last bit, so it is corrected
    against the grid points themselves.
    """
    guess = F.floor((value - F.lit(low)) / F.lit(grid_step(low, high, points)))
    guess = F.greatest(F.lit(-1), F.least(guess, F.lit(points - 1))).cast("long")
    up = (guess < points - 1) & (grid_value(guess + 1, low, high, points) <= value)
    down = (guess >= 0) & (grid_value(guess, low, high, points) > value)
    return F.when(up, guess + 1).when(down, guess - 1).otherwise(guess)


def bool_to_int(flag: Column) -> Column:
    """Nullable boolean to 0/1."""
    return F.coalesce(flag, F.lit(False)).cast("int")


# A number is split into whole units of 2^-HIGH and the rest in units of 2^-LOW.
HIGH_BITS, LOW_BITS = 20, 62
ROOM_BITS = 62  # of the whole units, which are longs


def _spread(n: Column, xy: Column, x: Column, y: Column) -> Column:
    """n * sum(x * y) - sum(x) * sum(y), exact, or NULL beyond 38 digits."""
    return F.try_subtract(F.try_multiply(xy, n.cast("decimal(20,0)")), F.try_multiply(x, y))


def steady_moments(value: Column) -> tuple[Column, Column]:
    """Mean and sample deviation that no order of the rows changes, as aggregates.

    Doubles are sums of two whole numbers of units, and all sums of those and of their
    products are exact, so only the last steps round.  A group with a value of finer bits
    (as below 0.001), of 2^42 or more, or with sums beyond 38 digits has the engine's own
    mean and deviation, whose last bits follow the order.
    """
    high = F.rint(value * F.lit(2.0**HIGH_BITS))
    low = (value - high * F.lit(2.0**-HIGH_BITS)) * F.lit(2.0**LOW_BITS)
    fits = (F.abs(value) < F.lit(2.0 ** (ROOM_BITS - HIGH_BITS))) & (F.rint(low) == low)
    a, b = (F.when(fits, part.cast("long")).cast("decimal(19,0)") for part in (high, low))
    n, sum_a, sum_b = F.count(value), F.try_sum(a), F.try_sum(b)
    whole = F.count(a) == n
    aa = _spread(n, F.try_sum(a * a), sum_a, sum_a)
    ab = _spread(n, F.try_sum(a * b), sum_a, sum_b)
    bb = _spread(n, F.try_sum(b * b), sum_b, sum_b)
    # In units of 2^-LOW, where that has room: near values may cancel.
    step = LOW_BITS - HIGH_BITS
    fine = F.try_add(
        F.try_add(F.try_multiply(aa, _power(2 * step)), F.try_multiply(ab, _power(step + 1))), bb
    )
    coarse = (
        aa.cast("double") + ab.cast("double") * F.lit(2.0 ** (1 - step))
        + bb.cast("double") * F.lit(2.0 ** (-2 * step))
    )
    spread = F.coalesce(
        fine.cast("double") * F.lit(2.0 ** (-2 * LOW_BITS)), coarse * F.lit(2.0 ** (-2 * HIGH_BITS))
    )
    total = sum_a.cast("double") * F.lit(2.0**-HIGH_BITS) + sum_b.cast("double") * F.lit(2.0**-LOW_BITS)
    std = F.when(n > 1, F.sqrt(F.try_divide(spread, n.cast("double") * (n - 1))))
    return (
        F.coalesce(F.when(whole, F.try_divide(total, n)), F.avg(value)),
        F.coalesce(F.when(whole, std), F.stddev_samp(value)),
    )


def _power(bits: int) -> Column:
    return F.lit(str(2**bits)).cast("decimal(38,0)")
