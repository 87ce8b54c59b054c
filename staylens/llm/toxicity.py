"""Toxicity by noisy-channel deobfuscation.

Words written with look-alike signs, stretched letters or blanks between letters are
lattices of letters: a sign may stand for a letter or for nothing, a repeated letter for
one.  Viterbi decoding under a character trigram model picks the likeliest word.  The
restored words, their beginnings, and how many different words of a document share a
beginning carry log-odds weights learned from labelled documents.  Every weight is shrunken
by the probability that the feature tells the classes apart at all; none is cut off by a
number of documents.  Of features that begin alike the most certain one counts; a
document's score is the logistic of the sum.

Character model and weights are fitted on a sample of at most SAMPLE labelled rows (those
of smallest id hash); everything else covers all rows and whole texts.  Cases: a NULL or
empty text has the score of no evidence; words of any length are decoded; repeated rows
score alike, and equal texts and near copies of one label count once in training; several labels of one id count as
their maximum; without labels of both classes the score is the share of label 1; extra
columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm import rows
from staylens.llm.language import fold
from staylens.session import settle

SAMPLE = 20_000  # labelled rows the model is fitted on
THRESHOLD = 0.7
TELLING = 1e-5  # share of features expected to tell the classes apart
SENT = 0.01  # weights nearer to zero are not sent to the workers
MOST = 8  # words with one beginning that are told apart by number
BANDS, BAND = 10, 3  # near copies in the sample: equal minima of hashed shingles
SHINGLE = 3
PREFIXES = range(4, 9)
SHARE = 0.8  # of a beginning's documents that one longer feature may hold
REMEMBERED = 300_000  # words a worker remembers
SPACED = 4  # single signs in a row that may spell a word
STATES = 24  # lattice states kept at each place; real words need far fewer

# Letters that a sign may stand for.
SIGNS = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "li", "+": "t", "(": "c", "€": "e", "*": "aeiou",
}
# Costs of the channel, as negative log probabilities.
STANDS = 1.0
NOTHING = {True: 3.0, False: 12.0}  # a sign, a digit
STRETCH = {True: 0.5, False: 4.0}  # of a run of three and more, of a double letter
EDGES = ".,;:?\"'()[]{}<>«»“”…"
PLAIN = re.compile(r"[^\W\d_]+")
STRETCHED = re.compile(r"(.)\1\1")
# Letters the character model tells apart; all others are one more. Three places of 7 bits
# bound its table, whatever the corpus.
LETTERS = [chr(c) for c in range(0x180) if chr(c).isalpha() and chr(c) == chr(c).lower()]
OTHER = "\uffff"
SYMBOLS = "^" + "".join(LETTERS) + OTHER  # ^ is the edge of a word, written $ behind it
PLACE = 7
TOLD = frozenset([*SYMBOLS, "$"])


@lru_cache(maxsize=1)
def symbols() -> np.ndarray:
    """Place in ``SYMBOLS`` of every code point; 0 for whatever is no letter."""
    out = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = len(SYMBOLS) - 1
    for at, letter in enumerate(SYMBOLS[1:-1], 1):
        out[ord(letter)] = at
    return out


def trigram_codes(text: str) -> np.ndarray:
    """The trigrams of a text's words: two symbols and the one after them, 0 at the edges."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    here = np.concatenate([[0, 0], symbols()[points], [0]])
    one, two, three = here[:-2], here[1:-1], here[2:]
    one = np.where(two == 0, 0, one)  # a word begins: what lies before the blank is not its own
    inside = (three > 0) | (two > 0)
    return (one << 2 * PLACE | two << PLACE | three)[inside]


def trigram_text(code: int) -> str:
    one, two, three = (code >> k * PLACE & (1 << PLACE) - 1 for k in (2, 1, 0))
    return SYMBOLS[one] + SYMBOLS[two] + (SYMBOLS[three] if three else "$")


def character_model(docs: DataFrame) -> "CharModel":
    """Character trigrams of the words of all texts; no labels are read."""

    def count(batches):
        counts = np.zeros(1 << 3 * PLACE, np.int64)
        for part in rows.slices(batches, 64):
            for text in part["text"]:
                if text:
                    codes = trigram_codes(text)
                    met, n = np.unique(codes, return_counts=True)
                    counts[met] += n
        met = np.flatnonzero(counts)
        yield pa.RecordBatch.from_pydict({"code": pa.array(met), "n": pa.array(counts[met])})

    found = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "code long, n long")
    summed = found.groupBy("code").agg(F.sum("n").alias("n"))
    return CharModel({trigram_text(r["code"]): r["n"] for r in summed.collect()})  # at most 2^21


@dataclass
class CharModel:
    """Interpolated character trigrams of words."""

    threes: dict[str, int]
    twos: dict[str, int] = field(default_factory=dict)
    ones: dict[str, int] = field(default_factory=dict)
    known: dict[str, float] = field(default_factory=dict)

    def __post_init__(self):
        for t, n in self.threes.items():
            self.twos[t[:2]] = self.twos.get(t[:2], 0) + n
            self.ones[t[1]] = self.ones.get(t[1], 0) + n

    def cost(self, before: str, letter: str) -> float:
        """Negative log probability of a letter after two others."""
        key = before + letter
        found = self.known.get(key)
        if found is None:
            if len(self.known) > 1 << 17:
                self.known.clear()
            raw, key = key, "".join(c if c in TOLD else OTHER for c in key)
            before = key[:2]
            three = self.threes.get(key, 0) / max(1, self.twos.get(before, 0))
            two = self.twos.get(key[1:], 0) / max(1, self.ones.get(before[1], 0))
            found = self.known[raw] = -math.log(0.7 * three + 0.25 * two + 0.05 / 64)
        return found


def readings(word: str, at: int) -> list[tuple[str, float]]:
    """What the sign at a place may stand for, and the cost of each reading."""
    sign = word[at]
    out = [(sign, 0.0)] if sign.isalpha() else [(letter, STANDS) for letter in SIGNS.get(sign, "")]
    if not sign.isalpha():
        out.append(("", NOTHING[not sign.isdigit()]))
    elif at and word[at - 1] == sign:
        stretched = word[at - 2 : at] == sign * 2 or word[at + 1 : at + 2] == sign
        out.append(("", STRETCH[stretched]))
    return out


def decode(word: str, model: CharModel) -> str:
    """The likeliest letters behind a lower-case word, by Viterbi search."""
    states = {"^^": (0.0, None)}  # last two letters -> cost, link (letter, link before)
    for at in range(len(word)):
        now: dict[str, tuple[float, tuple | None]] = {}
        for reading, price in readings(word, at):
            for last, (cost, link) in states.items():
                if reading:
                    key, total = last[1] + reading, cost + price + model.cost(last, reading)
                    way = (reading, link)
                else:
                    key, total, way = last, cost + price, link
                if key not in now or total < now[key][0]:
                    now[key] = (total, way)
        states = now
        if len(states) > STATES:
            states = dict(sorted(now.items(), key=lambda s: s[1][0])[:STATES])
    _, link = min((c + model.cost(k, "$"), link) for k, (c, link) in states.items())
    out = []
    while link:
        letter, link = link
        out.append(letter)
    return "".join(reversed(out))


def suspicious(word: str) -> bool:
    """Whether a word has signs among letters or stretched letters."""
    if PLAIN.fullmatch(word):
        return STRETCHED.search(word) is not None
    return sum(map(str.isalpha, word)) >= 1 and any(c in SIGNS or not c.isalnum() for c in word)


def bare(word: str) -> str:
    """A word without marks around it and without a closing run of one sign."""
    word = word.strip(EDGES)
    stripped = word.rstrip("!$#%&*@-_=~|+")
    return stripped if len(word) - len(stripped) > 1 or word.endswith("!") else word


def restored(word: str, model: CharModel) -> str:
    word = bare(word)
    return decode(word, model) if suspicious(word) else word


def spelled(words: list[str]) -> list[str]:
    """Words spelled out with blanks: runs of single signs, joined."""
    ones = bytes(len(w) == 1 for w in words)
    if b"\1" * SPACED not in ones:
        return []
    return [
        "".join(words[m.start() : m.end()])
        for m in re.finditer(b"\1{%d,}" % SPACED, ones)
        if len(set(words[m.start() : m.end()])) > 2
    ]


def features(word: str) -> set[str]:
    """A word and its beginnings."""
    return {"=" + word, *("^" + word[:n] for n in PREFIXES if n <= len(word))}


def counted(of: Iterable[Iterable[str]]) -> set[str]:
    """The features of a document's words; with a number where several words share one."""
    counts = Counter(f for one in of for f in one)
    return set(counts) | {
        f"{f} {n}" for f, met in counts.items() if met > 1 for n in range(2, min(met, MOST) + 1)
    }


def joined_features(word: str) -> set[str]:
    """As ``features`` for letters without word borders: a word may begin anywhere."""
    top = PREFIXES[-1]
    return {"^" + word[i : i + n] for i in range(len(word)) for n in PREFIXES if i + n <= len(word)} | {
        "=" + word[i : i + n] for i in range(len(word)) for n in range(3, top + 4) if i + n <= len(word)
    }


@dataclass
class Model:
    chars: CharModel
    weights: dict[str, tuple[float, float]]  # certainty, weight
    prior: float
    known: dict[str, tuple[str, list[str]] | None] = field(default_factory=dict)

    def evidence(self, word: str) -> tuple[str, list[str]] | None:
        """The restored word and those of its features that have a weight, if any."""
        if word in self.known:
            return self.known[word]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        found = restored(word, self.chars)
        held = [f for f in features(found) if f in self.weights]
        self.known[word] = (found, held) if held else None
        return self.known[word]

    def largest(self, of: set[str]) -> list[str]:
        held = [(self.weights[f], f) for f in of if f in self.weights]
        return [max(held)[1]] if held else []

    def score(self, text: str | None) -> float:
        words = (text or "").lower().split()
        held = dict(filter(None, map(self.evidence, set(words))))
        met = counted(held.values())
        for run in spelled(words):
            met.update(self.largest(joined_features(decode(run, self.chars))))
        roots: dict[str, tuple[float, float]] = {}
        for feature in met:
            found = self.weights.get(feature)
            root = feature[1:].split(" ")[0][: PREFIXES[0]]
            if found and (root not in roots or found > roots[root]):
                roots[root] = found
        total = self.prior + math.fsum(w for _, w in roots.values())
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def beta(a: float, b: float) -> float:
    """Logarithm of the beta function."""
    return math.lgamma(a) + math.lgamma(b) - math.lgamma(a + b)


def weight(k1: int, k0: int, n1: int, n0: int) -> tuple[float, float]:
    """Log Bayes factor of a feature having different rates in the two classes against one
    rate, and its log odds ratio times the probability that the rates differ."""
    apart = beta(k1 + 0.5, n1 - k1 + 0.5) + beta(k0 + 0.5, n0 - k0 + 0.5)
    alike = beta(0.5, 0.5) + beta(k1 + k0 + 0.5, n1 + n0 - k1 - k0 + 0.5)
    certain = apart - alike
    doubt = math.exp(min(700.0, math.log((1 - TELLING) / TELLING) - certain))
    odds = math.log((k1 + 0.5) / (n1 + 1)) - math.log((k0 + 0.5) / (n0 + 1))
    return certain, odds / (1 + doubt)


def marks(text: str) -> list[int]:
    """Keys that near copies are likely to share: minima of hashed shingles, in bands."""
    words = text.lower().split()
    shingles = {" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))}
    hashes = np.array([xxhash.xxh64_intdigest(x) for x in shingles], np.uint64)
    least = []
    for k in range(BANDS * BAND):
        least.append(int((hashes * np.uint64(xxhash.xxh64_intdigest(str(k)) | 1)).min()))
    return [
        xxhash.xxh64_intdigest(str(least[i : i + BAND]), i) >> 1 for i in range(0, len(least), BAND)
    ]


def without_copies(training: DataFrame) -> DataFrame:
    """text, toxic with one row of each group of near copies of one label.

    Copies of one document are one observation of its words.  The sample is bounded, and
    so are the keys that are joined here.
    """

    def run(batches):
        for part in rows.slices(batches):
            yield pa.RecordBatch.from_pydict({
                "raw": pa.array(part["raw"], pa.int64()),
                "toxic": pa.array(part["toxic"], pa.int32()),
                "marks": pa.array(list(map(marks, part["text"])), pa.list_(pa.int64())),
            })

    raw = F.xxhash64("text").alias("raw")
    met = training.select("text", F.col("toxic").cast("int").alias("toxic"), raw)
    parent: dict = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    keyed = met.mapInArrow(run, "raw long, toxic int, marks array<long>").orderBy("raw").collect()
    for r in keyed:
        for mark in r["marks"]:
            parent[find((r["toxic"], mark))] = find((r["toxic"], r["marks"][0]))
    held, gone = set(), []
    for r in keyed:
        group = find((r["toxic"], r["marks"][0]))
        if group in held:
            gone.append((r["raw"],))
        held.add(group)
    dropped = F.broadcast(training.sparkSession.createDataFrame(gone, "raw long"))
    kept = training.withColumn("raw", F.xxhash64("text")).join(dropped, "raw", "left_anti")
    return settle(kept.select("text", "toxic"))


def sample(docs: DataFrame, labels: DataFrame, usable: Column, size: int = SAMPLE) -> DataFrame:
    """text, toxic of at most ``size`` labelled rows, equal texts once."""
    marked = (
        labels.where("doc_id is not null and toxic is not null")
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))
        .where(usable)
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(size)
    )
    return (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .where("text is not null").join(F.broadcast(marked), "doc_id")  # at most ``size`` rows
        .groupBy("text").agg(F.max("toxic").alias("toxic"))
    )


WEIGHTED = pa.schema(
    [("feature", pa.string()), ("k1", pa.int64()), ("certain", pa.float64()), ("w", pa.float64())]
)


def fit(docs: DataFrame, labels: DataFrame, usable: Column, size: int = SAMPLE) -> Model:
    """Character model of all texts, and weights and prior from the labelled sample.

    All three are small: an alphabet and the size of the sample bound them.
    """
    training = without_copies(settle(sample(docs, labels, usable, size)))

    chars = character_model(docs)

    def met(batches):
        seen: dict[str, tuple[str, set[str]]] = {}
        for part in rows.slices(batches):
            out = {"feature": [], "toxic": []}
            for text, toxic in zip(part["text"], part["toxic"]):
                own: dict[str, set[str]] = {}
                for word in set(text.lower().split()):
                    if word not in seen:
                        if len(seen) > REMEMBERED // 16:  # each holds a set
                            seen.clear()
                        found = restored(word, chars)
                        seen[word] = found, features(found)
                    own[seen[word][0]] = seen[word][1]
                of = counted(own.values())
                out["feature"] += of
                out["toxic"] += [toxic] * len(of)
            yield pa.RecordBatch.from_pydict(
                {"feature": pa.array(out["feature"], pa.string()), "toxic": pa.array(out["toxic"], pa.int32())}
            )

    sizes = {r["toxic"]: r["count"] for r in training.groupBy("toxic").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    weights = {}
    if n1 and n0:

        def weighted(batches):
            known: dict[tuple[int, int], tuple[float, float]] = {}
            for part in rows.slices(batches, 1 << 16):
                out = {"feature": [], "k1": [], "certain": [], "w": []}
                for feature, k1, k0 in zip(part["feature"], part["k1"], part["k0"]):
                    if (k1, k0) not in known:
                        known[k1, k0] = weight(k1, k0, n1, n0)
                    certain, w = known[k1, k0]
                    if abs(w) > SENT:
                        for name, value in zip(out, (feature, k1, certain, w)):
                            out[name].append(value)
                yield rows.batch(WEIGHTED, out)

        found = (
            training.select("text", F.col("toxic").cast("int").alias("toxic"))
            .mapInArrow(met, "feature string, toxic int")
            .groupBy("feature").agg(
                F.sum(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("k1"),
                F.sum(F.when(F.col("toxic") == 1, 0).otherwise(1)).alias("k0"),
            )
            .mapInArrow(weighted, "feature string, k1 long, certain double, w double")
        ).collect()
        plain = branching({r["feature"]: (r["k1"], r["w"]) for r in found if " " not in r["feature"]})
        weights = {
            r["feature"]: (r["certain"], r["w"]) for r in found if r["feature"].split(" ")[0] in plain
        }
    return Model(chars, weights, math.log((n1 + 0.5) / (n0 + 0.5)))


def branching(found: dict[str, tuple[int, float]]) -> dict[str, float]:
    """Weights of features, without beginnings that owe their documents to one longer
    feature: those would only spread its weight to unrelated words."""
    longer: dict[str, int] = {}
    for feature, (documents, _) in found.items():
        word = feature[1:]
        for n in range(1, len(word) + (feature[0] == "=")):
            longer[word[:n]] = max(documents, longer.get(word[:n], 0))
    return {
        f: w for f, (documents, w) in found.items()
        if f[0] == "=" or longer.get(f[1:], 0) < SHARE * documents
    }


SCORED = pa.schema(
    [("doc_id", pa.int64()), ("raw", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())]
)


def score(docs: DataFrame, model: Model, held_out: Column) -> DataFrame:
    """doc_id, raw (hash of the text), held_out, score, predicted for every row."""

    def run(batches):
        for part in rows.slices(batches):
            part["score"] = [model.score(t) for t in part["text"]]
            yield rows.batch(SCORED, part)

    return (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64(rows.text_or_empty()).alias("raw"),
            held_out.alias("held_out"),
            F.col("text").cast("string").alias("text"),
        )
        .mapInArrow(run, "doc_id long, raw long, held_out boolean, score double")
        .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
    )


def toxic_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn from folds 0 and 2 of 3 and score every row; fold 1 is held out."""
    model = fit(docs, labels, fold(3) != 1)
    return score(docs, model, fold(3) == 1)


def rejected(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, with all their columns.

    Rows are scored as they are and pass or go: nothing is joined or shuffled.
    """
    model = fit(docs, labels, fold(3) != 1)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, rows.SLICE):
                part = batch.slice(start, rows.SLICE)
                texts = part.column(at).cast(pa.string()).to_pylist()
                yield part.filter(pa.array([model.score(t) < THRESHOLD for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
