"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1.  A letter n-gram is bound by multiplying
its letters' vectors, each rotated by its place; a text is the bundle (sum) of its
n-grams, and a language's prototype the bundle of its training texts.  The prediction is
the prototype of largest cosine.  A bundle is linear in the n-gram counts, so training
tasks count n-grams first and bind each once.

Prototypes are one vector per lang value, so they are collected: lang is a label with
few values.  Cases: a NULL text or one without letters is ``und`` with score 0; very long
texts are bundled whole; ties go to the first language in order; without training rows
every text is ``und``; repeated rows each count; extra columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.llm import rows

DIMENSIONS = 512
GRAM = 3
SLOTS = 2048  # letters share a vector beyond so many code points
SEED = 20
UNKNOWN = "und"
BUNDLE_GRAMS = 4096  # bound at once


@lru_cache(maxsize=1)
def alphabet() -> np.ndarray:
    """Slot of every code point; 0 for whatever is no letter."""
    slots = np.zeros(0x110000, np.int64)
    for c in range(0x110000):
        if chr(c).isalpha():
            slots[c] = 1 + c % (SLOTS - 1)
    return slots


@lru_cache(maxsize=1)
def letters() -> list[np.ndarray]:
    """Letter vectors, rotated for each place in an n-gram."""
    rng = np.random.default_rng(SEED)
    plain = rng.integers(0, 2, (SLOTS, DIMENSIONS), dtype=np.int8) * 2 - 1
    return [np.roll(plain, GRAM - 1 - k, axis=1) for k in range(GRAM)]


def grams(text: str | None) -> np.ndarray:
    """N-gram codes of the lower-cased letters; other runs count as one blank."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), "<u4")
    slots = np.concatenate([[0], alphabet()[points], [0]])
    slots = slots[np.concatenate([[True], (slots[1:] != 0) | (slots[:-1] != 0)])]
    if slots.size < GRAM:
        return np.zeros(0, np.int64)
    codes = np.zeros(slots.size - GRAM + 1, np.int64)
    for k in range(GRAM):
        codes = codes * SLOTS + slots[k : slots.size - GRAM + 1 + k]
    return codes


def bound(codes: np.ndarray) -> np.ndarray:
    """Vectors of n-grams."""
    out = np.ones((codes.size, DIMENSIONS), np.int8)
    for k, table in enumerate(letters()):
        out *= table[codes // SLOTS ** (GRAM - 1 - k) % SLOTS]
    return out


def bundles(texts: list[str | None]) -> np.ndarray:
    """One bundle per text."""
    found = [grams(t) for t in texts]
    of = np.repeat(np.arange(len(texts)), [f.size for f in found])
    distinct, place = np.unique(np.concatenate([*found, np.zeros(0, np.int64)]), return_inverse=True)
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for start in range(0, distinct.size, BUNDLE_GRAMS):
        part = distinct[start : start + BUNDLE_GRAMS]
        own = (place >= start) & (place < start + part.size)
        cells = of[own] * part.size + place[own] - start
        counts = np.bincount(cells, minlength=len(texts) * part.size)
        out += counts.reshape(len(texts), -1).astype(np.float32) @ bound(part).astype(np.float32)
    return out


def prototypes(training: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages in order and their prototypes, from all rows (text, lang)."""

    def run(batches):
        held: dict[str, dict[int, int]] = {}
        for part in rows.slices(batches):
            by: dict[str, list] = {}
            for text, lang in zip(part["text"], part["lang"]):
                by.setdefault(lang, []).append(grams(text))
            for lang, found in by.items():
                counts = held.setdefault(lang, {})
                for code, n in zip(*map(np.ndarray.tolist, np.unique(np.concatenate(found), return_counts=True))):
                    counts[code] = counts.get(code, 0) + n
        out = {"lang": [], "at": [], "value": []}
        for lang, counts in held.items():
            codes = np.array(list(counts), np.int64)
            n = np.array(list(counts.values()), np.int64)
            total = np.zeros(DIMENSIONS, np.int64)
            for start in range(0, codes.size, BUNDLE_GRAMS):
                part = slice(start, start + BUNDLE_GRAMS)
                total += (bound(codes[part]) * n[part, None]).sum(axis=0)
            out["lang"] += [lang] * DIMENSIONS
            out["at"] += range(DIMENSIONS)
            out["value"] += total.tolist()
        yield pa.RecordBatch.from_pydict(
            {"lang": pa.array(out["lang"], pa.string()), "at": pa.array(out["at"], pa.int32()),
             "value": pa.array(out["value"], pa.int64())}
        )

    sums = (
        training.select(F.col("text").cast("string"), F.col("lang").cast("string"))
        .where("text is not null and lang is not null")
        .mapInArrow(run, "lang string, at int, value long")
        .groupBy("lang", "at").agg(F.sum("value").alias("value"))
        .collect()
    )
    langs = sorted({r["lang"] for r in sums})
    table = np.zeros((len(langs), DIMENSIONS))
    for r in sums:
        table[langs.index(r["lang"]), r["at"]] = r["value"]
    known = np.linalg.norm(table, axis=1) > 0
    return [lang for lang, k in zip(langs, known) if k], table[known]


PREDICTED = pa.schema(
    [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())]
)


def predict(docs: DataFrame, langs: list[str], table: np.ndarray, held_out: Column) -> DataFrame:
    """doc_id, held_out, lang_pred, score (the cosine, not below 0)."""
    table = (table / np.linalg.norm(table, axis=1, keepdims=True)).astype(np.float32) if langs else table

    def run(batches):
        for part in rows.slices(batches):
            vectors = bundles(part["text"])
            norms = np.linalg.norm(vectors, axis=1)
            part["lang_pred"], part["score"] = [UNKNOWN] * norms.size, [0.0] * norms.size
            if langs:
                cosines = vectors @ table.T / np.maximum(norms, 1e-9)[:, None]
                best = cosines.argmax(axis=1)
                for i in np.flatnonzero(norms > 0).tolist():
                    part["lang_pred"][i] = langs[best[i]]
                    part["score"][i] = float(np.clip(cosines[i, best[i]], 0, 1))
            yield rows.batch(PREDICTED, part)

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"),
        F.col("text").cast("string").alias("text"),
    ).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def fold(of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a NULL id counts as an empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % of


def identify(docs: DataFrame) -> DataFrame:
    """Learn from fold 1-4 of 5 and predict every row; fold 0 is held out."""
    held_out = fold(5) == 0
    langs, table = prototypes(docs.where(~held_out))
    return predict(docs, langs, table, held_out)
