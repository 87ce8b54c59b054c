"""Clock arithmetic on zone-free timestamps (session zone is UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3_600_000_000.0
MICROS_PER_DAY = 86_400_000_000


def plain(t: Column) -> Column:
    return t.cast("timestamp_ntz")


def to_time(text: Column) -> Column:
    """Coerce text to a timestamp; what cannot be read is NULL."""
    return text.cast("string").try_cast("timestamp_ntz")


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def floor_hour(t: Column) -> Column:
    return F.date_trunc("HOUR", t).cast("timestamp_ntz")


def hours_between(start: Column, end: Column) -> Column:
    """Elapsed hours, fractional."""
    return (micros(end) - micros(start)) / F.lit(MICROS_PER_HOUR)


def hour_boundaries(start: Column, end: Column) -> Column:
    """Clock-hour boundaries crossed from start to end (not elapsed hours)."""
    hour = F.lit(int(MICROS_PER_HOUR))
    return F.floor(micros(end) / hour) - F.floor(micros(start) / hour)


def plus_hours(t: Column, hours: int) -> Column:
    return t + F.make_dt_interval(F.lit(0), F.lit(int(hours)))


def plus_days(t: Column, days: int | Column) -> Column:
    days = days if isinstance(days, Column) else F.lit(int(days))
    return t + F.make_dt_interval(days.cast("int"))


def calendar(t: Column) -> dict[str, Column]:
    """Hour of day, weekend indicator (Saturday, Sunday) and month."""
    return {
        "admit_hour": F.hour(t),
        "admit_weekend": (F.weekday(t) >= 5).cast("int"),
        "admit_month": F.month(t),
    }


def age_years(
    birth: Column,
    at: Column,
    top_code: tuple[float, float] = (89.0, 90.0),
    default_age: float = 65.0,
    implausible_age: float | None = None,
) -> Column:
    """Age in years from whole elapsed days.

    Plausible means 0 to 150 years.  Plausible ages are clipped to 0-120 and
    top-coded; a missing date gives ``default_age``, an implausible one
    ``implausible_age`` (same value unless set).
    """
    limit = F.lit(int(150 * 365.25 * MICROS_PER_DAY))
    gap = micros(at) - micros(birth)
    odd = default_age if implausible_age is None else implausible_age
    whole_days = F.floor(gap / F.lit(MICROS_PER_DAY)).cast("double")
    years = F.least(F.greatest(whole_days / F.lit(365.25), F.lit(0.0)), F.lit(120.0))
    age = (
        F.when(gap.isNull(), F.lit(float(default_age)))
        .when((gap < 0) | (gap > limit), F.lit(float(odd)))
        .otherwise(years)
    )
    return F.when(age >= top_code[0], F.lit(float(top_code[1]))).otherwise(age)


# Left-closed age bands.
AGE_EDGES = [0, 1, 20, 30, 40, 50, 60, 70, 80, 200]
AGE_LABELS = [
    "0-1", "1-20", "20-30", "30-40", "40-50", "50-60", "60-70", "70-80", "80+",
]


def band(value: Column, edges: list[float], names: list[str]) -> Column:
    """Name of the left-closed interval that holds the value, else NULL."""
    if len(edges) != len(names) + 1:
        raise ValueError("one more edge than names is needed")
    out = None
    for low, high, name in zip(edges[:-1], edges[1:], names):
        inside = (value >= F.lit(low)) & (value < F.lit(high))
        out = F.when(inside, name) if out is None else out.when(inside, name)
    return out


def age_band(age: Column) -> Column:
    """Age band after clipping to 0-120."""
    clipped = F.when(age.isNotNull(), F.least(F.greatest(age, F.lit(0.0)), F.lit(120.0)))
    return band(clipped, AGE_EDGES, AGE_LABELS)
