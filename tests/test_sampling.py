import hashlib
from collections import Counter

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from staylens.operators import sampling
from staylens.operators.ranking import hash_rank


def h(key, seed):
    return int(hashlib.md5(f"{key}:{seed}".encode()).hexdigest()[:8], 16)


@pytest.fixture
def rows(frame):
    return frame([(i, int(i % 7 == 0)) for i in range(500)], "id bigint, y int")


def by_hash(ids, seed):
    return sorted(ids, key=lambda i: (h(i, seed), i))


def test_slices_match_a_sorted_list(rows):
    got = sampling.hash_slices(rows, "id", 9, lambda n: [F.lit(0), F.lit(17), F.lit(400), n])
    want = {}
    for rank, i in enumerate(by_hash(range(500), 9)):
        want[i] = sum(c <= rank for c in (0, 17, 400, 500))
    assert {r["id"]: r["slice"] for r in got.collect()} == want


def test_split_is_stratified_and_partition_free(rows):
    split = sampling.stratified_split(rows, "id", "y")
    got = {r["id"]: r["split"] for r in split.collect()}
    assert set(got) == set(range(500))
    other = sampling.stratified_split(rows.repartition(7).orderBy(F.desc("id")), "id", "y")
    assert {r["id"]: r["split"] for r in other.collect()} == got
    positives = [i for i in range(500) if i % 7 == 0]
    n = len(positives)
    counts = Counter(got[i] for i in positives)
    cut1, cut2 = int(n * 0.6 + 0.5), int(n * 0.8 + 0.5)
    assert counts == {"train": cut1, "val": cut2 - cut1, "test": n - cut2}
    order = by_hash(positives, 42)
    assert all(got[i] == "train" for i in order[:cut1])


def test_split_with_text_strata(frame):
    df = frame([(i, "a" if i % 2 else "b") for i in range(40)], "id bigint, s string")
    split = sampling.stratified_split(df, "id", "s", (0.5, 0.5), ("l", "r"))
    counts = Counter((r["s"], r["split"]) for r in split.collect())
    assert set(counts.values()) == {10}


def test_folds(rows):
    folds = sampling.stratified_folds(rows, "id", "y", 5).collect()
    sizes = Counter((r["y"], r["fold"]) for r in folds)
    for y in (0, 1):
        per = [sizes[(y, f)] for f in range(5)]
        assert max(per) - min(per) <= 1


def test_samples(rows):
    got = {r["id"] for r in sampling.sample_n(rows, "id", 30, 3).collect()}
    assert got == set(by_hash(range(500), 3)[:30])
    assert sampling.sample_n(rows, "id", 9999).count() == 500
    assert sampling.sample_n(rows, "id", 0).count() == 0


def test_caps(rows):
    down = sampling.downsample_majority(rows, "id", "y", 100)
    counts = Counter(r["y"] for r in down.collect())
    assert counts == {1: 72, 0: 28}
    assert sampling.downsample_majority(rows, "id", "y", 500).count() == 500
    only = Counter(r["y"] for r in sampling.downsample_majority(rows, "id", "y", 50).collect())
    assert only == {1: 72}  # positives are never dropped here
    bg = Counter(r["y"] for r in sampling.background_sample(rows, "id", "y", 100).collect())
    assert bg == {1: 50, 0: 50}


def test_split_by_counts(rows):
    got = sampling.split_by_counts(rows, "id", (100, 50, 25)).collect()
    order = by_hash(range(500), 2025)
    assert {r["id"] for r in got if r["split"] == "test"} == set(order[150:175])
    assert len(got) == 175


def test_hash_rank(rows):
    got = {r["id"]: (r["rank"], r["group_size"]) for r in hash_rank(rows, "id", 5, ["y"]).collect()}
    for y in (0, 1):
        order = by_hash([i for i in range(500) if int(i % 7 == 0) == y], 5)
        assert all(got[i] == (r, len(order)) for r, i in enumerate(order))


def test_exact_bootstrap(frame):
    df = frame([(i, "t") for i in range(40)], "id bigint, target string")
    drawn = sampling.bootstrap(df, "id", 6, 42, "exact", ["target"]).collect()
    order = by_hash(range(40), 42)
    want = Counter()
    for b in range(6):
        for r in range(40):
            want[(b, order[h(f"{b}:{r}", 42) % 40])] += 1
    assert {(r["replicate"], r["id"]): r["weight"] for r in drawn} == dict(want)


def test_poisson_bootstrap(rows):
    drawn = sampling.bootstrap(rows, "id", 40, 1, "poisson")
    total = drawn.agg(F.sum("weight"), F.max("weight")).first()
    assert abs(total[0] / (500 * 40) - 1) < 0.03 and total[1] >= 4
    assert drawn.filter("weight = 0").count() == 0
    with pytest.raises(ValueError):
        sampling.bootstrap(rows, "id", 2, method="other")


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.integers(0, 10**9), min_size=1, max_size=30, unique=True), st.integers(0, 99))
def test_splits_partition_the_cohort(spark, ids, seed):
    df = spark.createDataFrame([(i, i % 2) for i in ids], "id bigint, y int")
    split = sampling.stratified_split(df, "id", "y", seed=seed).collect()
    assert sorted(r["id"] for r in split) == sorted(ids)
