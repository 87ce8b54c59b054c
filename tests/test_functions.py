import hashlib
import math

from pyspark.sql import functions as F

from staylens.functions import numbers, text, times
from staylens.functions.hashing import order_key, portable_hash, sha1_of


def column(df, expr):
    return [r[0] for r in df.select(expr).collect()]


def test_numbers_are_coerced_strictly(frame):
    raw = ["abc", "", "nan", "inf", "-inf", "1.5d", " 1.5 ", "1_000", "2e3", ".5", None, "-7"]
    df = frame([(v,) for v in raw], "v string")
    got = column(df, numbers.to_number(F.col("v")))
    assert got == [
        None, None, None, math.inf, -math.inf, None, 1.5, None, 2000.0, 0.5, None, -7.0,
    ]


def test_times_are_coerced(frame):
    df = frame([("2020-01-01 10:00:00",), ("soon",), (None,)], "v string")
    got = column(df, times.to_time(F.col("v")).isNull())
    assert got == [False, True, True]


def test_label_text(frame):
    df = frame([("  Heart Rate ",), (None,), ("12345",)], "v string")
    assert column(df, text.normal_label(F.col("v"))) == ["heart rate", "none", "12345"]
    assert column(df, text.digits_only(text.normal_label(F.col("v")))) == [False, False, True]


def test_bucket_order_and_patterns(frame):
    values = ["White - Russian", "BLACK/CAPE", "Caucasian", "Latina", "unknown", None]
    df = frame([(v,) for v in values], "v string")
    got = column(df, text.bucket(F.col("v"), text.ETHNICITY_RULES, text.ETHNICITY_OTHER))
    assert got == ["WHITE", "BLACK", "ASIAN", "HISPANIC", "OTHER", "OTHER"]
    assert column(df, text.matches_any(F.lower("v"), ["cape", "latin"])) == [
        False, True, False, True, False, False,
    ]


def test_names(frame):
    df = frame([("gender_M",), ("eth_two_parts",), ("hr__count",), ("hr__measured",)], "v string")
    assert column(df, text.group_value(F.col("v")))[:2] == ["M", "TWO_PARTS"]
    assert column(df, text.name_group(F.col("v"))) == [
        "baseline", "baseline", "missingness", "missingness",
    ]
    assert text.quoted("a`b") == "`a``b`"


def test_age_rules(frame):
    rows = [
        (None, "2100-01-01"), ("2101-01-01", "2100-01-01"), ("2011-01-01", "2100-01-02"),
        ("2011-02-10", "2100-01-02"), ("1948-01-01", "2100-01-02"), ("1800-01-01", "2100-01-02"),
        ("2000-01-01", "2100-01-02"), ("2099-01-01", None),
    ]
    df = frame(rows, "b ts, a ts")
    got = column(df, times.age_years(F.col("b"), F.col("a")))
    assert got[0] == 65 and got[1] == 65 and got[7] == 65  # missing or after admission
    assert got[2] == 90  # 89 years and above are top-coded
    assert 88 < got[3] < 89
    assert got[4] == 65 and got[5] == 65  # beyond 150 years
    assert got[6] == 90
    other = column(df, times.age_years(F.col("b"), F.col("a"), implausible_age=91.0))
    assert other[5] == 90 and other[0] == 65


def test_bands_are_left_closed(frame):
    df = frame([(v,) for v in (0.0, 1.0, 19.9, 20.0, 80.0, 300.0, -5.0, None)], "v double")
    assert column(df, times.age_band(F.col("v"))) == [
        "0-1", "1-20", "1-20", "20-30", "80+", "80+", "0-1", None,
    ]


def test_hours(frame):
    df = frame([("2020-01-01 10:59:00", "2020-01-01 11:01:00")], "a ts, b ts")
    assert column(df, times.hour_boundaries(F.col("a"), F.col("b"))) == [1]
    assert abs(column(df, times.hours_between(F.col("a"), F.col("b")))[0] - 2 / 60) < 1e-12


def test_calendar(frame):
    df = frame([("2024-01-06 23:10:00",), ("2024-01-08 00:00:00",)], "t ts")
    parts = times.calendar(F.col("t"))
    got = [tuple(r) for r in df.select(*parts.values()).collect()]
    assert got == [(23, 1, 1), (0, 0, 1)]


def test_grid_index_matches_the_points(frame):
    low, high, n = 0.01, 0.9, 300
    step = (high - low) / (n - 1)
    points = [low + i * step for i in range(n)]
    values = points + [math.nextafter(p, 0.0) for p in points] + [0.0, 1.0]
    df = frame([(v,) for v in values], "v double")
    got = column(df, numbers.grid_index(F.col("v"), low, high, n))
    want = [sum(p <= v for p in points) - 1 for v in values]
    assert got == want


def test_portable_hash(frame):
    df = frame([(5,), (123456789,)], "k bigint")
    want = [int(hashlib.md5(f"{k}:42".encode()).hexdigest()[:8], 16) for k in (5, 123456789)]
    assert column(df, portable_hash(F.col("k"), 42)) == want


def test_order_key_orders_like_the_pair(frame):
    pairs = [(t, i) for t in (0, 1, 10**16) for i in (0, 7, 9 * 10**18)]
    df = frame(pairs, "t bigint, i bigint")
    got = df.orderBy(order_key(F.col("t"), F.col("i"))).collect()
    assert [tuple(r) for r in got] == sorted(pairs)


def test_sha1_of_values(frame):
    df = frame([(["1", "2"],), ([],)], "v array<string>")
    assert column(df, sha1_of(F.col("v"))) == [hashlib.sha1(b"1,2").hexdigest(), None]


def test_clip_and_ratio(frame):
    df = frame([(-1.0,), (0.5,), (2.0,), (None,)], "v double")
    assert column(df, numbers.clip(F.col("v"), 0.0, 1.0)) == [0.0, 0.5, 1.0, None]
    assert column(df.limit(1), numbers.ratio_or_zero(F.lit(1), F.lit(0))) == [0.0]
