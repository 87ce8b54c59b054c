"""Source mix, divergence audit and Orchard clustering against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from staylens.llm import divergence, mixture, orchard

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, key string, number int, n long, part int"


def documents(n, seed=4):
    rng = random.Random(seed)
    stems = ["ab", "abc", "Abd", "zeta", "Éa", "éa", "漢字", "x" * 40, "longer", "longest", "go", "gone"]
    table = []
    for i in range(n):
        words = [rng.choice(stems) + rng.choice(["", "s", "ing", "1", "-"]) for _ in range(rng.randint(0, 60))]
        text = rng.choice([" ", "\n", "\t "]).join(words)
        source = rng.choice(["a", "a", "a", "b", "B", "漢", "é", "", None])
        table.append((i, text, rng.choice(["en", "de", None]), source))
    table += [(n, None, "en", "a"), (n + 1, "", "fr", "quiet"), (n + 2, "only once", "fr", "quiet two")]
    table += [(None, "no id " * 9, "en", None), (5000, "twice abc", "en", "b"), (5000, "twice abc", "en", "b")]
    table.append((n + 3, "ab abc gone " * 3000, "en", "a"))
    return table


def frame(spark, table):
    return spark.createDataFrame([(*row, "k", 1, 2, 3) for row in table], DOCS)


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 65_537])
def test_permutation_and_its_inverse(n):
    order = mixture.Permutation(n, 3, 1)
    image = order.at(np.arange(n))
    assert sorted(image.tolist()) == list(range(n))
    assert order.place(image).tolist() == list(range(n))


def brute_targets(sizes, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    fixed, rest = {}, 1.5 * sum(sizes.values())
    while True:
        free = [s for s in names if s not in fixed]
        level = rest / sum(weight[s] for s in free) if free else 0
        above = [s for s in free if weight[s] * level > 2 * sizes[s]]
        if not above:
            return {**fixed, **{s: weight[s] * level for s in free}}
        for s in above:
            fixed[s] = 2.0 * sizes[s]
            rest -= fixed[s]


def test_mix_meets_targets_and_reruns_agree(spark):
    table = documents(400)
    df = frame(spark, table)
    size = {i: len(WORD.findall(row[1] or "")) for i, row in enumerate(table)}
    of_source = defaultdict(int)
    for i, row in enumerate(table):
        of_source[row[3]] += size[i]
    wanted = brute_targets(of_source)
    out = mixture.taken(df, block=16, per_shard=64)
    found = sorted(map(tuple, out.collect()), key=str)
    assert found == sorted(map(tuple, mixture.taken(df.repartition(7), block=16, per_shard=64).collect()), key=str)
    source_of = {row[0]: row[3] for row in table}
    got, target = defaultdict(int), {}
    for doc_id, n, source_size, goal, words in found:
        assert words <= 2 * n and source_size == of_source[source_of[doc_id]]
        got[source_of[doc_id]] += words
        target[source_of[doc_id]] = goal
    assert sorted(r[1] for r in found) == sorted(size.values())
    for source in of_source:
        assert target[source] == pytest.approx(wanted[source])
        assert abs(got[source] - wanted[source]) <= 8 + 1e-6, source


def test_mix_holds_the_words(spark):
    table = documents(120, 9)
    df = frame(spark, table)
    texts = defaultdict(list)
    for row in table:
        texts[row[0]].append(WORD.findall(row[1] or ""))
    mixed = mixture.mix(df, block=16, per_shard=64).collect()
    taken, slots = Counter(), defaultdict(list)
    for row in mixed:
        span = slice(row["from_word"], row["from_word"] + row["n_words"])
        assert any(words[span] == row["words"] for words in texts[row["doc_id"]])
        taken[row["doc_id"]] += row["n_words"]
        slots[row["shard"], row["slot"]].append((row["place"], row["n_words"], row["source"]))
    counted = Counter()
    for row in mixture.taken(df, block=16, per_shard=64).collect():
        counted[row["doc_id"]] += row["taken"]
    assert +counted == taken
    shards = defaultdict(list)
    for (shard, slot), held in slots.items():
        held.sort()
        shards[shard].append(slot)
        assert len({s for *_, s in held}) == 1 and sum(n for _, n, _ in held) <= 16
        assert all(a + n == b for (a, n, _), (b, _, _) in zip(held, held[1:]))
    assert len(shards) > 1
    for held in shards.values():
        assert sorted(held) == list(range(len(held)))


def test_mix_of_nothing(spark):
    assert mixture.taken(frame(spark, [])).count() == 0
    assert [tuple(r) for r in mixture.taken(frame(spark, [(1, None, "en", None)])).collect()] == [(1, 0, 0, 0.0, 0)]


def test_slots_are_never_broadcast(spark):
    """Few rows make many slots, so their size is not known before they are made."""
    docs = frame(spark, [(i, "word " * 3000, "en", "ab"[i % 2]) for i in range(8)])
    for found in (mixture.taken(docs, block=2), mixture.mix(docs, block=2)):
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        joins = set(re.findall(r"(\w+Join) \[number#\d+L?, block#\d+L?\]", plan))
        assert joins == {"SortMergeJoin"}


def brute_audit(table, least, top):
    upper = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    docs, cells, groups = Counter(), defaultdict(Counter), set()
    for _, text, lang, source in table:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = term.findall((text or "").translate(upper))
        docs.update((lang, t) for t in set(found))
        cells[lang, source].update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = sorted(t for (lg, t), n in docs.items() if lg == lang and n >= least)
        own = sorted(s for lg, s in groups if lg == lang)
        total = Counter()
        for s in own:
            total.update(cells[lang, s])

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(cells[lang, s]) for s in own}, shares(total)
        for s in own:
            pair = [(sum((p[s][t] - p[o][t]) ** 2 // (p[s][t] + p[o][t]) for t in kept), o) for o in own if o != s]
            terms = [
                ((p[s][t] - q[t]) ** 2 // (p[s][t] + q[t]), t)
                for t in kept if cells[lang, s][t] and p[s][t] > q[t]
            ]
            for name, items, limit in (("pair", pair, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, name, o, v, i + 1) for i, (v, o) in enumerate(items[:limit])]
    return sorted(out)


@pytest.mark.parametrize("least,top", [(1, 3), (10, 10), (60, 2), (10_000, 5)])
def test_audit(spark, least, top):
    table = documents(300)
    got = divergence.audit(frame(spark, table), least, top)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == brute_audit(table, least, top)


def test_audit_of_nothing(spark):
    assert divergence.audit(frame(spark, [])).count() == 0


def test_refinement_discards_prefixes(spark, monkeypatch):
    """Extensions of a discarded prefix are never counted; a full bit table only costs work."""
    table = [(i, "common " + "rare" + "abcdefgh"[i % 8] * 9, "en", "a") for i in range(40)]
    bagged = divergence.slices(frame(spark, table))
    first = divergence.prefix_counts(bagged, 6)
    assert {(bytes(r[1]), r[2], r[3]) for r in first.collect() if r[3] >= 10} == {(b"common", True, 40)}
    table_ = divergence.bit_table(first.where("docs >= 10 and not complete"), "prefix")
    assert divergence.prefix_counts(bagged, 12, 6, table_).count() == 0
    everything = np.full(divergence.BITS >> 6, -1, np.int64)
    assert divergence.prefix_counts(bagged, 40, 6, everything).count() == 8
    monkeypatch.setattr(divergence, "bit_table", lambda kept, column: everything)
    monkeypatch.setattr(divergence, "TEXT_AT_ONCE", 300)
    few = documents(100)
    assert sorted(map(tuple, divergence.audit(frame(spark, few)).collect())) == brute_audit(few, 10, 10)


def test_terms_meet_once(spark, monkeypatch):
    """Slices give a row per term with its sources beside it, which are added and packed in one shuffle."""
    monkeypatch.setattr(divergence, "TEXT_AT_ONCE", 300)
    table = [(i, "both " * (i % 3 + 1) + "ab"[i % 2] * 3, "en", "st"[i % 2]) for i in range(40)]
    bagged = divergence.slices(frame(spark, table))
    kept = divergence.vocabulary(bagged).localCheckpoint()
    found = divergence.term_counts(bagged, kept)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2  # the slices' rows and the kept terms
    got = {bytes(r["term"]): (sorted(map(tuple, r["cells"])), r["lang_count"]) for r in found.collect()}
    both = [sum(i % 3 + 1 for i in range(k, 40, 2)) for k in (0, 1)]
    assert got == {
        b"both": ([("s", both[0]), ("t", both[1])], sum(both)),
        b"aaa": ([("s", 20)], 20),
        b"bbb": ([("t", 20)], 20),
    }


def test_slices_are_read_a_few_at_a_time(spark, monkeypatch):
    """Spark holds a row group whole: slices are one value each, and a few of them make a group."""
    monkeypatch.setattr(divergence, "TEXT_AT_ONCE", 50_000)
    monkeypatch.setitem(divergence.FEW_AT_ONCE, "parquet.block.size", "200000")
    settled, settle = [], divergence.settle
    monkeypatch.setattr(divergence, "settle", lambda *a: settled.append(settle(*a)) or settled[-1])
    rng = random.Random(2)
    words = ["".join(rng.choices("abcdefgh", k=12)) for _ in range(60_000)]
    table = [(i, " ".join(words[200 * i : 200 * i + 200]) + " common", "en", "st"[i % 2]) for i in range(300)]
    found = divergence.audit(frame(spark, table).coalesce(1)).collect()
    assert {r["item"] for r in found} <= {"s", "t", "common"}
    assert settled[0].columns == ["slice"] and settled[0].count() == 16
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in settled[0].inputFiles()]
    groups = [m.row_group(i) for m in files for i in range(m.num_row_groups)]
    assert len(groups) > 2 and max(g.total_byte_size for g in groups) < 300_000


def test_shares_beyond_a_long():
    import pyarrow as pa

    part = pa.RecordBatch.from_pydict(
        {"places": [[0, 1], [1]], "counts": [[10**13, 5], [10**15]]},
        schema=pa.schema([("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64()))]),
    )
    below = np.array([10**13 + 4, 10**15 + 9], object)
    p = [[1 + 10**9 * (c + 2) // b for c, b in zip(row, below)] for row in ((10**13, 5), (0, 10**15))]
    wanted = sum((x - y) ** 2 // (x + y) for x, y in p)
    assert divergence.pair_sums(part, below)[0, 1] == wanted


def brute_clusters(table, k, rounds):
    kept = [
        (i, [int(np.floor(64 * float(x))) for x in v])
        for i, v in table
        if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)
    ]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centers = [r[1] for r in sorted(kept, key=key)[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), j) for j, c in enumerate(centers)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for j in range(len(centers)):
            own = [v for (_, v), (_, c) in zip(kept, at) if c == j]
            if own:
                centers[j] = [sum(x) // len(own) for x in zip(*own)]
    at = assign()
    inertia = Counter()
    for d, c in at:
        inertia[c] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return sorted(
        ((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for (i, _), (d, c) in zip(kept, at)), key=str
    )


def clusters(spark, table, **how):
    df = spark.createDataFrame(
        [(i, v, 1, 0.5) for i, v in table], "vec_id long, embedding array<float>, cluster int, distance double"
    )
    return sorted(map(tuple, orchard.cluster(df, **how).drop("centroid").collect()), key=str)


def test_clusters(spark):
    rng = np.random.default_rng(1)
    table = [(i, rng.normal(i % 5, 1.0, 64).astype(np.float32).tolist()) for i in range(150)]
    table += [(900 + i, [0.5] * 64) for i in range(20)] + [(900, [0.5] * 64), (None, [0.25] * 64)]
    table += [(1, None), (2, [1.0] * 63), (3, [float("nan")] + [0.0] * 63), (4, [None] * 64), (5, [])]
    table += [(6, [float("inf")] * 64), (8, [float("-inf")] * 64)]
    assert clusters(spark, table) == brute_clusters(table, 16, 3)
    assert clusters(spark, table, k=1, rounds=1) == brute_clusters(table, 1, 1)


def test_clusters_with_few_vectors(spark):
    table = [(1, [1.0] * 64), (2, [1.0] * 64), (3, [-2.0] * 64)]
    assert clusters(spark, table) == brute_clusters(table, 16, 3)
    assert clusters(spark, []) == [] and clusters(spark, [(1, None)]) == []
    with pytest.raises(Exception, match="on the grid"):
        clusters(spark, [(1, [3e8] * 64)])


def test_orchard_visits_less_and_finds_the_nearest():
    rng = np.random.default_rng(8)
    centers = rng.integers(-40, 40, (60, 3))
    centers[7] = centers[3]  # equal centroids: the smaller number
    vectors = np.concatenate([rng.integers(-50, 50, (2000, 3)), centers])
    at, best, work = orchard.Orchard(centers).nearest(vectors.astype(np.int64))
    every = ((vectors[:, None, :] - centers) ** 2).sum(axis=2)
    assert at.tolist() == every.argmin(axis=1).tolist()
    assert best.tolist() == every.min(axis=1).tolist()
    assert work < 0.8 * every.size
