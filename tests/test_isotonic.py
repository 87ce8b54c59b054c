"""The mergeable isotonic fit against pooled adjacent violators, and the as-of join."""

import random

import pytest
from pyspark.sql import functions as F

from staylens.operators import isotonic, ranking


def pooled(data):
    """Blocks (low, high, value, n) of pooled adjacent violators over distinct scores."""
    blocks = []
    for s in sorted({p for p, _ in data}):
        ys = [y for p, y in data if p == s]
        blocks.append([s, s, sum(ys), len(ys)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, high, total, n = blocks.pop()
            blocks[-1][1] = high
            blocks[-1][2] += total
            blocks[-1][3] += n
    return [(lo, hi, total / n, n) for lo, hi, total, n in blocks]


def draws(kind, n, seed):
    rng = random.Random(seed)
    if kind == "rising":  # every score a step of its own
        return [(i / n, int(j < i)) for i in range(n) for j in range(n)]
    if kind == "falling":  # one step over all
        return [(i / 200, int(rng.random() < 1 - i / 200)) for i in range(200) for _ in range(5)]
    return [(rng.randrange(10 * n) / n, int(rng.random() < 0.4)) for _ in range(n)]


@pytest.mark.parametrize("kind,n", [("rising", 24), ("falling", 1), ("random", 400)])
@pytest.mark.parametrize("chunk", [4, 16, 256])
def test_steps_are_the_pooled_blocks(spark, monkeypatch, kind, n, chunk):
    monkeypatch.setattr(isotonic, "CHUNK", chunk)
    data = draws(kind, n, chunk)
    df = spark.createDataFrame(data, "p_raw double, y int").repartition(3 if chunk == 4 else 7)
    got = sorted(tuple(r)[1:] for r in isotonic.fit_steps(df).collect())
    wanted = pooled(data)
    assert [r[:2] + r[3:] for r in got] == [r[:2] + r[3:] for r in wanted]
    assert [r[2] for r in got] == pytest.approx([r[2] for r in wanted])


def test_steps_per_key_and_odd_rows(spark):
    a, b = draws("random", 150, 1), draws("random", 90, 2)
    rows = [("a", *r) for r in a] + [(None, *r) for r in b]
    rows += [("a", float("nan"), 1), ("a", None, 0), ("a", 0.5, None), ("none", None, 1)]
    df = spark.createDataFrame(rows, "target string, p_raw double, y int")
    got = {}
    for r in isotonic.fit_steps(df, keys=["target"]).collect():
        got.setdefault(r["target"], []).append((r["low"], r["high"]))
    assert sorted(got["a"]) == [r[:2] for r in pooled(a)] and "none" not in got
    empty = isotonic.fit_steps(df.filter("target = 'none'"))
    assert empty.count() == 0
    assert isotonic.apply_steps(df.filter("p_raw = 0.5"), empty, name="p").first()["p"] is None


def test_scores_between_steps_lie_on_a_line(spark):
    steps = spark.createDataFrame(
        [(0, 1.0, 2.0, 0.1, 4), (1, 4.0, 5.0, 0.5, 2)], "step long, low double, high double, value double, n long"
    )
    scores = [0.0, 1.0, 2.0, 3.0, 4.0, 4.5, 9.0, 9.0, float("nan"), None]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "id int, p_raw double")
    got = [r["p"] for r in isotonic.apply_steps(df, steps).orderBy("id").collect()]
    assert got[:8] == pytest.approx([0.1, 0.1, 0.1, 0.3, 0.5, 0.5, 0.5, 0.5]) and got[8:] == [None, None]


def test_as_of_join(spark):
    rng = random.Random(6)
    table = sorted({(k, rng.randrange(500)) for k in "ab" for _ in range(40)})
    rows = sorted({(k, rng.randrange(-5, 505)) for k in "abc" for _ in range(200)})
    left = spark.createDataFrame(rows, "k string, v int")
    right = spark.createDataFrame([(k, v, v * 2) for k, v in table], "k string, start int, w int")
    got = ranking.as_of(left, right, ["k"], "v", "start", ["w"]).collect()
    wanted = {
        (k, v): max((s * 2 for g, s in table if g == k and s <= v), default=None) for k, v in rows
    }
    assert {(r["k"], r["v"]): r["w"] for r in got} == wanted and len(got) == len(rows)
    plain = ranking.as_of(left.select("v").distinct(), right.select("start", "w"), [], "v", "start", ["w"])
    assert plain.filter(F.col("v") >= 500).select("w").distinct().count() == 1
