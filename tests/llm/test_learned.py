"""Language identification, toxicity and revisits."""

import itertools
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from staylens.llm import language, revisits, toxicity
from tests.llm.test_dedup import docs as plain_docs

DOCS = "doc_id long, text string, lang string, raw long, feature string"


def brute_bundle(text):
    letters = language.letters()
    slots = [0]
    for ch in text.lower():
        slot = int(language.alphabet()[ord(ch)])
        if slot or slots[-1]:
            slots.append(slot)
    if slots[-1]:
        slots.append(0)
    out = np.zeros(language.DIMENSIONS)
    for i in range(len(slots) - 2):
        out += np.prod([letters[k][slots[i + k]].astype(int) for k in range(3)], axis=0)
    return out


def test_bundles_equal_letter_by_letter_binding():
    texts = ["", "a", "Ab, c!", "éß 漢字 x", "the " * 50, None, "12 34"]
    got = language.bundles(texts)
    for text, vector in zip(texts, got):
        assert np.array_equal(vector, brute_bundle(text or "")), text


def language_docs(spark):
    rng = np.random.default_rng(4)
    parts = {"xx": ["an", "the", "ing", "on"], "yy": ["ción", "ado", "que", "es"]}
    table = []
    for i in range(200):
        lang = ["xx", "yy"][i % 2]
        text = " ".join("".join(rng.choice(parts[lang], 3)) for _ in range(20))
        table.append((i, text, lang if i % 10 else None, 1, "f"))
    table += [(900, None, "xx", 1, "f"), (901, "12 !", "xx", 1, "f"), (902, "", None, 1, "f"),
              (903, "the" * 20_000, "xx", 1, "f"), (None, "ción", "yy", 1, "f"), (5, "queque", "yy", 1, "f")]
    return table, spark.createDataFrame(table, DOCS)


def test_language_predictions(spark):
    table, df = language_docs(spark)
    got = language.identify(df).collect()
    assert len(got) == len(table)
    truth = {i: ["xx", "yy"][i % 2] for i in range(200)} | {903: "xx", None: "yy"}
    for r in got:
        key = b"" if r["doc_id"] is None else str(r["doc_id"]).encode()
        assert r["held_out"] == (zlib.crc32(key) % 5 == 0) and 0 <= r["score"] <= 1
        if r["doc_id"] in (900, 901, 902):
            assert r["lang_pred"] == "und" and r["score"] == 0
        elif r["doc_id"] != 5:
            assert r["lang_pred"] == truth[r["doc_id"]]


def test_language_without_rows_or_labels(spark):
    _, df = language_docs(spark)
    assert language.identify(df.limit(0)).count() == 0
    got = language.identify(df.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r["lang_pred"] for r in got.collect()} == {"und"}


@pytest.fixture(scope="module")
def chars():
    words = ["idiot", "stupid", "moron", "table", "chair", "letter", "noon", "pathetic"] * 5
    threes = {}
    for w in words:
        w = f"^^{w}$"
        for i in range(len(w) - 2):
            threes[w[i : i + 3]] = threes.get(w[i : i + 3], 0) + 1
    return toxicity.CharModel(threes)


def test_viterbi_finds_the_cheapest_path(chars):
    for word in ("1d10t", "m00n", "st*pid", "n.oon", "tab1e", "ch@iir"):
        best = None
        for path in itertools.product(*[toxicity.readings(word, i) for i in range(len(word))]):
            text = "".join(p[0] for p in path)
            cost, last = sum(p[1] for p in path), "^^"
            for letter in text + "$":
                cost += chars.cost(last, letter)
                last = last[1] + letter
            if best is None or cost < best[0] - 1e-9:
                best = (cost, text)
        assert toxicity.decode(word, chars) == best[1], word


def test_restored_words(chars):
    pairs = {"1d10t": "idiot", "stuuuupid!!": "stupid", "p@thet1c": "pathetic", "m.o.r.o.n": "moron",
             "letter": "letter", "noon,": "noon", "table***": "table", "": "", "123": "123"}
    assert {w: toxicity.restored(w, chars) for w in pairs} == pairs
    assert toxicity.spelled("a i d i o t b".split()) == ["aidiotb"] and toxicity.spelled(["a"] * 9) == []
    assert len(toxicity.restored("a0" * 3000, chars)) > 0


def toxic_docs(spark, n=1500):
    rng = np.random.default_rng(9)
    words = ["".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(300)]
    bad = ["idiot", "moron", "stupid"]
    table, labels = [], []
    for i in range(n):
        text = list(rng.choice(words, 40))
        if i % 4 == 0:
            word = bad[i // 4 % 3]
            text[7] = word if i % 8 else word.replace("o", "0").replace("u", "uuu")
        table.append((i, " ".join(text), "xx", 1, "f"))
        labels.append((i, int(i % 4 == 0), "f"))
    table += [(9000, None, None, 1, "f"), (9001, "", None, 1, "f"), (None, "you idiot", None, 1, "f"),
              (9002, "i d i o t", None, 1, "f"), (9003, "fine words only " * 9000, None, 1, "f"), (9003, "fine", None, 1, "f")]
    return table, spark.createDataFrame(table, DOCS), spark.createDataFrame(labels + [(9001, None, "f"), (None, 1, "f"), (0, 1, "f")], "doc_id long, toxic int, feature string")


def test_toxic_scores(spark):
    table, df, labels = toxic_docs(spark)
    got = {}
    for r in toxicity.toxic_scores(df, labels).collect():
        key = b"" if r["doc_id"] is None else str(r["doc_id"]).encode()
        assert r["held_out"] == (zlib.crc32(key) % 3 == 1)
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7)
        got.setdefault(r["doc_id"], []).append(r["predicted"])
    for i in range(1500):
        assert got[i] == [int(i % 4 == 0)], i
    assert got[9000] == got[9001] == [0] and got[None] == got[9002] == [1] and got[9003] == [0, 0]
    kept = toxicity.rejected(df, labels)
    assert kept.columns == df.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(i for i, p in got.items() for q in p if i is not None and not q)


def test_toxicity_without_labels_or_rows(spark):
    _, df, labels = toxic_docs(spark, 30)
    assert toxicity.toxic_scores(df.limit(0), labels).count() == 0
    assert {r["predicted"] for r in toxicity.toxic_scores(df, labels.limit(0)).collect()} == {0}


def test_beginnings_of_one_word_are_no_features():
    found = {"^lose": (50, 4.0), "=loser": (50, 4.0), "^vequ": (60, 4.0), "^vequa": (20, 3.0), "=vequa": (20, 3.0)}
    assert set(toxicity.branching(found)) == {"=loser", "^vequ", "=vequa"}


CAPTURES = "record_id long, kind string, url string, at long, etag string, last_modified string, headers map<string,string>, cell int"


def test_canonical_urls(spark):
    pairs = {
        "HTTPS://WWW.Site.org:443/a/?utm_source=x&b=2&a=1#top": "site.org/a?a=1&b=2",
        "http://m.site.org/index.html": "site.org", "site.org/A/": "site.org/A", None: None, "": "",
        "http://site.org?ref": "site.org",
    }
    df = spark.createDataFrame([(k,) for k in pairs], "u string")
    got = {r["u"]: r["c"] for r in df.select("u", revisits.canonical(df.u).alias("c")).collect()}
    assert got == pairs


def test_stray_times_do_not_gather_a_hot_url(spark):
    """A URL with all captures is spread over the cells though one time is far away."""
    log = spark.range(20_000).select((F.col("id") + 10**9).alias("at"))
    log = log.unionByName(spark.createDataFrame([(0,), (None,), (10**15,)], "at long"))
    cells = revisits.with_cells(log).groupBy("cell").count().agg(F.max("count"), F.count("*")).first()
    assert cells[0] < 20_000 / 200 and cells[1] > 500
    ordered = revisits.with_cells(log).where("at is not null").orderBy("at").select("cell").collect()
    assert [r[0] for r in ordered] == sorted(r[0] for r in ordered)


def test_revisits_equal_brute_force(spark):
    rng = np.random.default_rng(3)
    table = []
    for i in range(400):
        url = None if i % 50 == 3 else f"http://{'WWW.' if i % 3 else ''}h.org/{rng.integers(0, 4)}" if i % 4 else "http://hot.org"
        at = None if i % 60 == 7 else int(rng.integers(0, 50)) * 10**6
        etag = None if i % 5 == 0 else f"{'W/' if i % 2 else ''}{rng.integers(0, 2)}"
        headers = None if i % 9 == 0 else {"date": str(i), "x-own": str(i), "ETag": str(etag)}
        table.append((i, "revisit" if i % 3 else "response", url, at, etag, str(rng.integers(0, 2)), headers, 7))
    table.append(table[1])
    got = revisits.resolve(spark.createDataFrame(table, CAPTURES)).collect()
    wanted = []
    for r in table:
        if r[1] != "revisit":
            continue
        key = r[2] and r[2].lower().replace("http://", "").replace("www.", "")
        same = [
            f for f in table
            if f[1] == "response" and key and f[2] and f[2].lower().replace("http://", "").replace("www.", "") == key
            and f[3] is not None and r[3] is not None and f[3] < r[3]
        ]
        f = max(same, key=lambda f: (f[3], f[0]), default=None)
        tag = lambda t: t and t.removeprefix("W/")
        if f is None:
            status = "unresolved"
        elif r[4] and f[4] and tag(r[4]) == tag(f[4]):
            status = "etag"
        elif not r[4] and not f[4] and r[5] == f[5]:
            status = "last_modified"
        else:
            status = "mismatch"
        headers = None
        if status in ("etag", "last_modified"):
            headers = dict(f[6] or {}) | {k: v for k, v in (r[6] or {}).items() if k.lower() in revisits.PERMITTED}
        wanted.append((r[0], key, r[3], f and f[0], f and f[3], status, headers))
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)
    assert {w[5] for w in wanted} == {"unresolved", "etag", "last_modified", "mismatch"}


def test_no_captures(spark):
    assert revisits.resolve(spark.createDataFrame([], CAPTURES)).count() == 0
    assert plain_docs(spark, []).count() == 0


def test_rare_toxic_vocabulary_is_found(spark):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(300)]
    table, labels = [], []
    for i in range(900):
        rare = i % 70 == 0  # 13 documents
        toxic = rare or i % 20 == 7
        text = list(rng.choice(words, 40))
        if toxic:
            text[3:5] = ["zorkabe", "zorkudi"] if rare else ["idiot", "moron"]
        table.append((i, " ".join(text), "yy" if rare else "xx", 1, "f"))
        labels.append((i, int(toxic), "f"))
    met = [i for i in range(0, 900, 70) if zlib.crc32(str(i).encode()) % 3 != 1]
    assert 0 < len(met) < 10  # fewer than a fixed limit of ten documents
    df, marked = spark.createDataFrame(table, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int, feature string")
    got = {r["doc_id"]: r["predicted"] for r in toxicity.toxic_scores(df, marked).collect()}
    assert got == {i: t for i, t, _ in labels}


def test_weights_are_shrunken_and_have_both_signs():
    falling = [toxicity.weight(k, 0, 300, 2400)[1] for k in (40, 10, 5, 3, 1)]
    assert falling == sorted(falling, reverse=True) and 0 < falling[-1] < 0.01 and falling[0] > 4
    assert toxicity.weight(0, 600, 300, 2400)[1] < -3
    assert toxicity.counted([["^lose", "=loser"], ["^lose"]]) == {"^lose", "=loser", "^lose 2"}


def test_near_copies_of_a_text_count_once(spark):
    text = [f"w{i}" for i in range(60)]
    copies = [(" ".join(text[:i] + ["x"] + text[i:]), 1) for i in range(0, 60, 6)]
    other = [("entirely other words", 1), (" ".join(text), 0), ("", 0)]
    training = spark.createDataFrame(copies + other, "text string, toxic int")
    got = sorted((r["toxic"], len(r["text"].split())) for r in toxicity.without_copies(training).collect())
    assert got == [(0, 0), (0, 60), (1, 3), (1, 61)]


def test_character_model_counts_every_text(spark):
    """The trigrams of all texts, labelled or not, against a plain count."""
    texts = ["Hello wörld, a x1y 漢字 ŸÀ!", "", "...", "a", None, "hello again " * 500, "naïve ſtraße"] * 3
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    wanted = Counter()
    for text in texts:
        for word in toxicity.PLAIN.findall((text or "").lower()):
            word = "^^" + "".join(c if c in toxicity.TOLD else toxicity.OTHER for c in word) + "$"
            wanted.update(word[i : i + 3] for i in range(len(word) - 2))
    assert toxicity.character_model(docs).threes == dict(wanted)
    assert len(toxicity.SYMBOLS) <= 1 << toxicity.PLACE
    assert toxicity.character_model(docs.limit(0)).threes == {}
