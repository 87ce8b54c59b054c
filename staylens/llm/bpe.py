"""Byte-level BPE: exact linear-time encoding by backtracking, decoding by offset table.

An Aho-Corasick automaton over the vocabulary gives the longest token at every
position.  The encoder takes the longest token that may follow the one before it, falls
back to that token's own token prefixes, and steps back when none fits; a position that
led nowhere is never tried again, so the work is linear.  Two tokens may follow each
other if merging their bytes by rank leaves the border between them alone, which the
pair-compatibility table answers from the merge tree of either token.

Cases: a NULL or empty text has no tokens; a special token's text is one token; repeated
rows are encoded alike; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from staylens.llm import pieces, rows

# Fixed value: the word pattern of the byte-level vocabulary.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BREAK = "Ā"  # stands in no token: tokens are written as one character per byte
PAIRS = 1 << 19  # remembered answers of the compatibility table


def byte_letters() -> dict[str, int]:
    """The letters by which vocabulary files write bytes: printable Latin-1 stands for
    itself, the other bytes take letters from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 255 and b != 173]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Bpe:
    """Vocabulary, merges and special tokens of a tokenizer file.

    Inside, tokens are numbered by rank: the 256 bytes first, then the merges in order.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        letters = byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        number = {letter: b for letter, b in letters.items()}
        names = sorted(letters, key=letters.get)
        left, right, self.merged = list(range(256)), list(range(256)), {}
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            if a + b in number:
                raise ValueError(f"two merges give {a + b!r}")
            number[a + b] = 256 + rank
            names.append(a + b)
            left.append(number[a])
            right.append(number[b])
            self.merged[number[a], number[b]] = 256 + rank
        self.left, self.right = left, right
        raw = [bytes(map(letters.__getitem__, n)) for n in names]
        self.length = [len(r) for r in raw]
        self.ids = np.array([vocab[n] for n in names], np.uint32)
        self.answers: dict[tuple[int, int], bool] = {}

        whole = [True] * len(raw)
        for t in range(256, len(raw)):
            a, b = left[t], right[t]
            whole[t] = whole[a] and whole[b] and self._border_stays(a, b, t)
        usable = {r: t for t, r in enumerate(raw) if whole[t]}
        self.shorter = [-1] * len(raw)
        for r, t in usable.items():
            for n in range(len(r) - 1, 0, -1):
                if r[:n] in usable:
                    self.shorter[t] = usable[r[:n]]
                    break
        self.automaton = ahocorasick.Automaton()
        for r, t in usable.items():
            self.automaton.add_word(r.decode("latin-1"), t)
        self.automaton.make_automaton()

        # Offset table by id, special tokens included.
        text = {i: s.encode() for s, i in self.special.items()}
        text |= {int(i): r for i, r in zip(self.ids, raw)}
        table = [text.get(i, b"") for i in range(max(text) + 1)]
        self.blob = np.frombuffer(b"".join(table), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in table])])
        self.words = regex.compile(WORDS)
        self.specials = (
            regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
            if self.special else None
        )

    def _border_stays(self, a: int, b: int, limit: int = 1 << 31) -> bool:
        """Whether no merge of rank below ``limit`` joins bytes across the border of a and b,
        walking both merge trees from the last merge down."""
        while True:
            joined = self.merged.get((a, b))
            if joined is not None and joined < limit:
                return False
            if a > b:
                limit, a = a, self.right[a]
                if a == limit:
                    limit, b = b + 1, self.left[b]
                    if b + 1 == limit:
                        return True
            else:
                limit, b = b + 1, self.left[b]
                if b + 1 == limit:
                    limit, a = a, self.right[a]
                    if a == limit:
                        return True

    def follows(self, a: int, b: int) -> bool:
        """The pair-compatibility table, filled as pairs come up."""
        answer = self.answers.get((a, b))
        if answer is None:
            if len(self.answers) >= PAIRS:
                self.answers.clear()
            answer = self.answers[a, b] = self._border_stays(a, b)
        return answer

    def _word(self, longest: list[int], at: int, end: int) -> list[int]:
        """Tokens of the bytes from ``at`` to ``end``."""
        length, shorter, follows = self.length, self.shorter, self.follows
        tokens, dead, token = [], set(), longest[at]
        while at < end:
            reach = at + length[token]
            if reach not in dead and (not tokens or follows(tokens[-1], token)):
                tokens.append(token)
                at, token = reach, longest[reach]
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                dead.add(at)
                token = tokens.pop()
                at -= length[token]
        return tokens

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of words that are merged on their own; one automaton pass."""
        latin = [w.encode("utf-8").decode("latin-1") for w in words]
        text = BREAK.join(latin)
        longest, length = [0] * (len(text) + 1), self.length
        for last, token in self.automaton.iter(text):
            longest[last - length[token] + 1] = token  # a later end is a longer token
        out, counts, at = [], [], 0
        for word in latin:
            tokens = self._word(longest, at, at + len(word))
            out += tokens
            counts.append(len(tokens))
            at += len(word) + 1
        return self.ids[np.array(out, np.int64)], np.array(counts, np.int64)

    def encode_pieces(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and counts of pieces: special tokens are taken out, the rest is cut into words."""
        words, words_of, marks = [], [], []
        for part in parts:
            before = len(words)
            if self.specials and self.specials.search(part):
                for i, span in enumerate(self.specials.split(part)):
                    if i % 2:
                        marks.append((len(words), self.special[span]))
                        words.append("")
                    else:
                        words += self.words.findall(span)
            else:
                words += self.words.findall(part)
            words_of.append(len(words) - before)
        ids, counts = self.encode_words(words)
        if marks:
            at = np.array([m[0] for m in marks])
            ids = np.insert(ids, np.concatenate([[0], np.cumsum(counts)])[at], [m[1] for m in marks])
            counts[at] = 1
        ends = np.concatenate([[0], np.cumsum(counts)])[np.cumsum(words_of, dtype=np.int64)]
        return ids.astype(np.uint32), np.diff(ends, prepend=0)

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        starts = self.offsets[ids]
        sizes = self.offsets[ids.astype(np.int64) + 1] - starts
        return pieces.gather(self.blob, starts, sizes).tobytes().decode("utf-8", "replace")


@lru_cache(maxsize=2)
def model(path: str) -> tuple[Bpe, pieces.Memory]:
    """The tables of a tokenizer file, once per worker."""
    bpe = Bpe(path)
    return bpe, pieces.Memory(bpe.encode_pieces, led=True)


ENCODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) of every whole text."""

    def run(batches):
        memory = model(path)[1]
        for part in pieces.spans(batches):
            ids = [i.tobytes() for i in memory.each(part.column("text"))]
            yield rows.batch(ENCODED, {"doc_id": part.column("doc_id"), "ids": ids})

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), rows.text_or_empty().alias("text")
    ).mapInArrow(run, "doc_id long, ids binary")


DECODED = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary()), ("text", pa.string())])


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, ids, text for rows of ``encode``."""

    def run(batches):
        bpe = model(path)[0]
        for part in rows.slices(batches):
            part["text"] = [bpe.decode(np.frombuffer(i or b"", "<u4")) for i in part["ids"]]
            yield rows.batch(DECODED, part)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, text string")


DIGESTS = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("n_tokens", pa.int64()),
        ("ids_sha256", pa.string()),
        ("decoded_sha256", pa.string()),
    ]
)


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode and decode in one pass."""

    def run(batches):
        bpe, memory = model(path)
        for part in pieces.spans(batches):
            out = {"doc_id": part.column("doc_id"), "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
            for ids in memory.each(part.column("text")):
                out["n_tokens"].append(ids.size)
                out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                text = bpe.decode(ids).encode()
                out["decoded_sha256"].append(hashlib.sha256(text).hexdigest())
            yield rows.batch(DIGESTS, out)

    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), rows.text_or_empty().alias("text")
    ).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
