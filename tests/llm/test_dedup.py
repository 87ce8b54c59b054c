"""Exact and near deduplication against brute force."""

import hashlib
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from staylens.llm import components, exact_dedup, rows, simhash

DOCS = "doc_id long, text string, lang string, key long, salt int, bucket int"


def docs(spark, pairs):
    return spark.createDataFrame([(i, t, "en", 7, 8, 9) for i, t in pairs], DOCS)


def brute_groups(pairs):
    by = {}
    for i, t in pairs:
        by.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    out = []
    for text, ids in by.items():
        keep = min((i for i in ids if i is not None), default=None)
        for k, i in enumerate(ids):
            kept = i == keep and ids.index(i) == k
            out.append((i, keep, len(ids), kept, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


CASES = [
    (3, "a b"), (1, "a\t\nb"), (2, "a  b "), (4, None), (5, ""), (None, "a b"), (None, "z"),
    (6, "é" * 5000), (7, "é" * 5000), (8, "x"), (8, "x"), (8, "y"), (9, " "),
]


@pytest.mark.parametrize("share", [1000, 2])
def test_groups_equal_brute_force(spark, monkeypatch, share):
    monkeypatch.setattr(rows, "HOT_FLOOR", share)
    pairs = CASES + [(100 + i, "hot  text") for i in range(40)] + [(200 + i, f"t{i}") for i in range(50)]
    got = exact_dedup.groups(docs(spark, pairs), capacity=4)
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_groups(pairs)


def test_index_entries_lie_by_bucket_and_answer(spark):
    """Entries are in the bucket that the directory names; the result and lookups read them."""
    pairs = CASES + [(100 + i, f"t{i % 120}") for i in range(200)]
    index = exact_dedup.build(docs(spark, pairs), capacity=8)
    slots = {r["slot"]: r["bucket"] for r in index.directory.collect()}
    assert len(slots) == 1 << index.depth and len(set(slots.values())) > 10
    entries = index.entries.withColumn("file", F.input_file_name()).collect()
    assert len(entries) == len({r[4] for r in brute_groups(pairs)})
    held, files = {}, {}
    for r in entries:
        assert slots[(r["key"] % 2**64) >> (64 - index.depth)] == r["bucket"]
        held.setdefault(r["bucket"], set()).add(r["key"])
        files.setdefault(r["bucket"], set()).add(r["file"])
    assert max(map(len, held.values())) <= 8 and all(len(f) == 1 for f in files.values())
    assert set(index.entries.inputFiles()) <= set(index.members.inputFiles())
    more = docs(spark, [(900, "t7"), (901, "a\t\t\tb"), (902, "nowhere"), (903, None)])
    got = {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in exact_dedup.lookup(index, more).collect()}
    size = {r[4]: (r[1], r[2]) for r in brute_groups(pairs)}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert got == {900: size[sha("t7")], 901: size[sha("a b")], 903: size[sha("")]}


def test_colliding_keys_are_told_apart_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    pairs = [(i, f"text {i % 3}") for i in range(12)]
    got = exact_dedup.groups(docs(spark, pairs))
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute_groups(pairs)


def test_survivors_keep_columns_and_one_row_of_each_group(spark):
    out = exact_dedup.survivors(docs(spark, CASES))
    assert out.columns == ["doc_id", "text", "lang", "key", "salt", "bucket"]
    kept = sorted((r[0] for r in brute_groups(CASES) if r[3]), key=str)
    assert sorted((r["doc_id"] for r in out.collect()), key=str) == kept


def test_empty_tables(spark):
    assert exact_dedup.groups(docs(spark, [])).count() == 0
    assert exact_dedup.survivors(docs(spark, [])).count() == 0
    assert simhash.near_groups(docs(spark, [])).count() == 0


def test_directory_splits_until_no_bucket_is_overfull():
    rng = np.random.default_rng(1)
    loads = np.zeros(1 << 10, np.int64)
    np.add.at(loads, rng.integers(0, 200, 3000), 1)
    slots = exact_dedup.directory(loads, 100)
    depth = len(slots).bit_length() - 1
    assert [s[0] for s in slots] == list(range(1 << depth))
    assert depth == max(s[2] for s in slots)
    load = {s[1]: s[3] for s in slots}
    assert sum(load.values()) == 3000 and max(load.values()) <= 100
    for bucket in load:
        own = [s for s in slots if s[1] == bucket]
        assert len(own) == 1 << (depth - own[0][2])


def brute_print(text, width):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text))
    parts = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@pytest.mark.parametrize("text", ["", " \t ", "One", "One TWO", "É a\x0bB c d e f", "x " * 300])
def test_fingerprint(text):
    for width in (3, 5):
        assert simhash.fingerprint(text.encode(), width) == brute_print(text.encode(), width)


def brute_components(fps):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    fps = list(fps)
    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


@pytest.mark.parametrize("block", [4096, 8])
def test_components_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(simhash, "BLOCK", block)
    rng = np.random.default_rng(7)
    centres = rng.integers(0, 1 << 63, 25, dtype=np.uint64)
    fps = set()
    for c in centres.tolist():
        for _ in range(25):
            flips = rng.integers(0, 64, rng.integers(0, 7)).tolist()
            fps.add(c ^ sum(1 << b for b in set(flips)))
    prints = spark.createDataFrame(
        [(i, simhash.signed(f)) for i, f in enumerate(sorted(fps))], "doc_id long, fp long"
    )
    got = {r["fp"] % (1 << 64): r["component_id"] for r in simhash.components(prints).collect()}
    roots = brute_components(sorted(fps))
    ids = {f: i for i, f in enumerate(sorted(fps))}
    least = {}
    for f, r in roots.items():
        least[r] = min(least.get(r, 1 << 60), ids[f])
    assert got == {f: least[r] for f, r in roots.items()}


def test_forest_joins_two_blocks():
    left = np.array([0, 1 << 40 | (1 << 50) - 1], np.uint64)
    right = np.array([7, 1 << 60], np.uint64)
    assert {tuple(map(int, e)) for e in simhash.forest(left, right)} == {(0, 7), (0, 1 << 60)}


def test_near_groups_cases(spark):
    words = " ".join(f"w{i}" for i in range(400))
    pairs = [(5, words), (2, words + " tail"), (9, None), (4, "  "), (None, words), (7, "other text here")]
    got = {(r["doc_id"], r["component_id"]) for r in simhash.near_groups(docs(spark, pairs)).collect()}
    assert got == {(5, 2), (2, 2), (None, 2), (9, 4), (4, 4), (7, 7)}


def test_components_of_a_long_chain(spark):
    edges = spark.range(300).selectExpr("id as a", "id + 1 as b")
    got = components.label_components(edges).collect()
    assert len(got) == 301 and {r["root"] for r in got} == {0}
