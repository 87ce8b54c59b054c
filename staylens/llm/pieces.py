"""Texts cut into pieces that tokenise independently, with a bounded memory of pieces.

Corpora repeat their words, so a batch of texts is cut at blanks, equal pieces are
merged, and only pieces a worker does not remember are tokenised.  All of it but the
tokenising itself works on whole Arrow and numpy arrays.
"""

from __future__ import annotations

import os
import re
import sys
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array

REMEMBERED = 32 << 20  # bytes a memory may take
LONGEST = 64  # bytes of a piece worth remembering
BYTES_AT_ONCE = 3 << 20  # of text

# Marks that are tokens of their own after a letter, and where nothing is normalised all
# ASCII marks but those of added tokens (<|name|>, [NAME]).
MARKS = ".,"
MARKS_LED = "!\"#$%&'()*+,-./:;=?@\\^_`{}~"
WHITE = r"[\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# White space before a blank, which some tokenizers see as one run.
RUN = WHITE + " "
# A newline that is in a run of white space or at an edge of its piece.
NOT_ALONE = rf"{WHITE}\n|\n{WHITE}|\A\n|\n\z"
BLANK_AFTER_WORD = re.compile(r"(?<=\S) ")

Encode = Callable[[list[str]], tuple[np.ndarray, np.ndarray]]  # ids of all, counts of each


def gather(source: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``source`` that begin at ``starts``, one after another."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if ends.size else 0
    return source[np.arange(total) + np.repeat(starts - (ends - sizes), sizes)]


def spans(
    batches: Iterable[pa.RecordBatch], text: str = "text", size: int = BYTES_AT_ONCE
) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut to a bounded number of bytes of text; one row at least."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(sizes, dtype=np.int64) // size
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)


def closed(words: pa.Array, marks: str) -> tuple[pa.Array, pa.Array]:
    """Words without the marks that close them after a letter, and those marks."""
    core = pc.ascii_rtrim(words, characters=marks)
    less = pc.not_equal(pc.binary_length(core), pc.binary_length(words))
    some = np.flatnonzero(less.to_numpy(zero_copy_only=False))
    letter = pc.match_substring_regex(core.take(pa.array(some)), r"\p{L}\z")
    cut = np.zeros(len(words), bool)
    cut[some[letter.to_numpy(zero_copy_only=False)]] = True
    cut = pa.array(cut)
    tail = pc.replace_substring_regex(words.filter(cut), r"(?s)\A.*\p{L}", "")
    return pc.if_else(cut, core, words), pc.replace_with_mask(pa.repeat("", len(words)), cut, tail)


@lru_cache(maxsize=1)
def unsettled() -> str:
    """Pattern of a last letter that a normaliser turns into letter and mark: a full stop
    after it shares a token with the mark, so it must not be cut off."""
    found = [
        f"\\x{{{c:X}}}"
        for c in range(sys.maxunicode + 1)
        if chr(c).isalpha() and not unicodedata.normalize("NFC", chr(c)).lower()[-1].isalpha()
    ]
    return f"[{''.join(found)}]$"


class Generation:
    """Pieces and their ids under sorted hashes of the pieces; equal bytes decide a hit."""

    def __init__(self):
        self.hashes = np.zeros(0, np.uint64)  # sorted
        self.at = np.zeros(0, np.int32)  # the piece of each hash
        self.words = pa.array([], pa.string())
        self.ends = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.uint32)

    @property
    def bytes(self) -> int:
        return sum(x.nbytes for x in (self.hashes, self.at, self.words, self.ends, self.ids))

    def find(self, words: pa.Array, hashes: np.ndarray) -> np.ndarray:
        """The place of each word, -1 where it is not known."""
        place = np.full(len(words), -1, np.int64)
        if self.hashes.size:
            slot = np.minimum(np.searchsorted(self.hashes, hashes), self.hashes.size - 1)
            hit = np.flatnonzero(self.hashes[slot] == hashes)
            found = self.at[slot[hit]]
            same = pc.equal(self.words.take(pa.array(found)), words.take(pa.array(hit)))
            same = same.to_numpy(zero_copy_only=False)
            place[hit[same]] = found[same]
        return place

    def add(self, words: pa.Array, hashes: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> None:
        order = np.argsort(hashes, kind="stable")
        slots = np.searchsorted(self.hashes, hashes[order])
        self.at = np.insert(self.at, slots, (len(self.words) + order).astype(np.int32))
        self.hashes = np.insert(self.hashes, slots, hashes[order])
        self.words = pa.concat_arrays([self.words, words])
        self.ends = np.concatenate([self.ends, self.ends[-1] + np.cumsum(sizes)])
        self.ids = np.concatenate([self.ids, ids])


class Memory:
    """Tokenises texts by pieces and remembers the pieces' ids.

    ``led``: a piece keeps the blank before it, and blanks within runs of white space do
    not cut.  Otherwise pieces hold no blank and ASCII case is ignored, for tokenizers
    that drop both.  ``size`` bounds its bytes: pieces go to the young of two generations,
    and when that has used its half the old one is forgotten.
    """

    def __init__(self, encode: Encode, led: bool, size: int = REMEMBERED):
        self.encode, self.led, self.size = encode, led, size
        self.forget()

    def forget(self) -> None:
        self.young, self.old = Generation(), Generation()

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and the number of ids of each."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        keys, at, pieces_of = self._cut(texts)
        flat, starts, sizes = self._table(keys)
        ids = gather(flat, starts[at], sizes[at])
        ends = np.concatenate([[0], np.cumsum(sizes[at])])[np.cumsum(pieces_of)]
        return ids, np.diff(ends, prepend=0)

    def each(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """Ids of each text."""
        ids, counts = self.ids(texts)
        return iter(np.split(ids, np.cumsum(counts)[:-1]) if counts.size else [])

    def _cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Distinct pieces, the piece at every place, and the pieces of each text."""
        lists = pc.split_pattern(texts, " ")
        pieces_of = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        raw = coded.dictionary
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        if not self.led:
            return raw, at, pieces_of
        # Pieces other than a text's first carry the blank that was cut away.
        first = np.zeros(at.size, bool)
        first[np.concatenate([[0], np.cumsum(pieces_of)[:-1]])] = True
        keys = [pc.binary_join_element_wise("", raw, " "), raw]
        at = np.where(first, at + len(raw), at)
        runs = np.flatnonzero(
            pc.match_substring_regex(texts, RUN).to_numpy(zero_copy_only=False)
        )
        if runs.size:
            at = np.split(at, np.cumsum(pieces_of)[:-1])
            for i in runs.tolist():
                head, *rest = BLANK_AFTER_WORD.split(texts[i].as_py())
                own = [head, *[" " + p for p in rest]]
                at[i] = np.arange(len(own)) + sum(map(len, keys))
                keys.append(pa.array(own, pa.string()))
                pieces_of[i] = len(own)
            at = np.concatenate(at)
        keys = pa.concat_arrays(keys)
        met = np.zeros(len(keys), bool)
        met[at] = True
        coded = keys.filter(pa.array(met)).dictionary_encode()
        place = np.zeros(len(keys), np.int64)
        place[met] = coded.indices.to_numpy(zero_copy_only=False)
        return coded.dictionary, place[at], pieces_of

    def _table(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct pieces: flat ids, starts and sizes."""
        lines, line_of, lines_of = self._lines(keys)
        core, tail = closed(lines, MARKS_LED if self.led else MARKS)
        if not self.led:  # with a blank kept, nothing is normalised
            whole = pc.match_substring_regex(core, unsettled())
            core, tail = pc.if_else(whole, lines, core), pc.if_else(whole, "", tail)
            core = pc.if_else(pc.string_is_ascii(core), pc.ascii_lower(core), core)
        coded = pa.concat_arrays([core, tail, pa.array(["\n", ""])]).dictionary_encode()
        flat, starts, sizes = self._look_up(coded.dictionary)
        at = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        last = np.zeros(line_of.size, bool)  # lines that end their piece
        last[np.cumsum(lines_of) - 1] = True
        words = np.stack(
            [at[line_of], at[len(lines) + line_of], np.where(last, at[-1], at[-2])], axis=1
        ).ravel()
        joined = gather(flat, starts[words], sizes[words])
        ends = np.cumsum(sizes[words])[3 * np.cumsum(lines_of) - 1]
        sizes = np.diff(ends, prepend=0)
        return joined, ends - sizes, sizes

    def _lines(self, keys: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """Lines of pieces, the line at every place, and the lines of each piece.

        A newline between two other signs than white space is a token of its own where
        white space is kept; pieces with other newlines stay whole.
        """
        places = np.arange(len(keys))
        if not self.led:
            return keys, places, np.ones(len(keys), np.int64)
        cut = pc.match_substring(keys, "\n").to_numpy(zero_copy_only=False)
        some = places[cut]
        alone = pc.invert(pc.match_substring_regex(keys.take(pa.array(some)), NOT_ALONE))
        some = some[alone.to_numpy(zero_copy_only=False)]
        lists = pc.split_pattern(keys.take(pa.array(some)), "\n")
        lines_of = np.ones(len(keys), np.int64)
        lines_of[some] = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        starts = places.copy()
        starts[some] = len(keys) + np.cumsum(lines_of[some]) - lines_of[some]
        split = np.zeros(len(keys), bool)
        split[some] = True
        lines = pa.concat_arrays([pc.if_else(pa.array(split), "", keys), lists.flatten()])
        return lines, gather(np.arange(len(lines)), starts, lines_of), lines_of

    def _look_up(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        hashes = hash_array(words.to_numpy(zero_copy_only=False), categorize=False)
        starts, sizes = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        missing, flats, base = np.ones(len(words), bool), [], 0
        for kept in (self.young, self.old):
            here = np.flatnonzero(missing)
            place = kept.find(words.take(pa.array(here)), hashes[here])
            here, place = here[place >= 0], place[place >= 0]
            starts[here] = base + kept.ends[place]
            sizes[here] = kept.ends[place + 1] - kept.ends[place]
            missing[here] = False
            flats.append(kept.ids)
            base += kept.ids.size
            if kept is self.young:
                fresh = missing.copy()
        new = np.flatnonzero(missing)
        ids, counts = self.encode(words.take(pa.array(new)).to_pylist())
        starts[new] = base + np.cumsum(counts) - counts
        sizes[new] = counts
        flat = np.concatenate([*flats, ids])
        # What only the old generation knew moves to the young one and outlives its turn.
        short = pc.less_equal(pc.binary_length(words), LONGEST).to_numpy(zero_copy_only=False)
        keep = np.flatnonzero(short & fresh)
        self.young.add(
            words.take(pa.array(keep)), hashes[keep],
            gather(flat, starts[keep], sizes[keep]), sizes[keep],
        )
        if self.young.bytes > self.size // 2:
            self.young, self.old = Generation(), self.young
            if self.old.bytes > self.size:  # one slice of texts held more than the budget
                self.old = Generation()
        return flat, starts, sizes


def edged(piece: str) -> bool:
    """Whether white space beside the piece, but for a blank of its own, leaves it as it is."""
    return not (piece[-1:] or " ").isspace() and not piece[piece[0] == " "].isspace()


@lru_cache(maxsize=1)
def library(path: str, led: bool) -> Memory:
    """A tokenizer of the tokenizers library behind a memory, once per worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    suffix = getattr(tokenizer.model, "end_of_word_suffix", None)
    vocab = tokenizer.get_vocab()
    last = np.zeros(max(vocab.values()) + 1, bool)  # tokens that end a word
    widths = np.zeros(last.size, np.int64)  # bytes of tokens, where a sign stands for a byte
    for token, number in vocab.items():
        last[number] = bool(suffix) and token.endswith(suffix)
        widths[number] = len(token)
    for number, added in tokenizer.get_added_tokens_decoder().items():
        widths[number] = len(added.content.encode())

    def encode_each(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        one = tokenizer.encode(parts, is_pretokenized=True, add_special_tokens=False)
        counts = np.bincount(np.array(one.word_ids, np.int64), minlength=len(parts))
        return np.array(one.ids, np.uint32), counts

    def encode_text(text: str) -> np.ndarray:
        one = tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.array(one.ids, np.uint32)

    def by_suffix(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Words of letters in one text: tokens that end a word tell them apart."""
        ids = encode_text(" ".join(words))
        ends = np.flatnonzero(last[ids]) + 1
        if ends.size != len(words) or (ends.size and ends[-1] != ids.size):
            return None  # a letter became letter and mark
        counts = np.diff(ends, prepend=0)
        return ids, ends - counts, counts

    def by_bytes(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Words in one text, each after its blank or a newline: tokens are as long as their
        bytes, which tells where a word begins and ends."""
        ids = encode_text("".join([w if w[0] == " " else "\n" + w for w in words]))
        edges = np.concatenate([[0], np.cumsum(widths[ids])])
        sizes = np.fromiter((len(w.encode()) for w in words), np.int64, len(words))
        newline = np.fromiter((w[0] != " " for w in words), bool, len(words))
        ends = np.cumsum(sizes + newline)
        if edges[-1] != (ends[-1] if ends.size else 0):
            return None  # tokens are no bytes here
        starts, stops = np.searchsorted(edges, ends - sizes), np.searchsorted(edges, ends)
        if (edges[starts] != ends - sizes).any() or (edges[stops] != ends).any():
            return None
        return ids, starts, stops - starts

    def encode(parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain pieces go as one text, which keeps no offsets, the others one by one."""
        if not parts:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not led and not suffix:
            return encode_each(parts)
        is_plain, together = (edged, by_bytes) if led else (str.isalpha, by_suffix)
        plain = np.fromiter(map(is_plain, parts), bool, len(parts))
        found = together([part for part, alone in zip(parts, plain) if alone])
        if found is None:
            return encode_each(parts)
        starts, counts = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64)
        ids, starts[plain], counts[plain] = found
        other = [part for part, alone in zip(parts, plain) if not alone]
        if other:
            more, counts[~plain] = encode_each(other)
            starts[~plain] = ids.size + np.cumsum(counts[~plain]) - counts[~plain]
            ids = np.concatenate([ids, more])
        return gather(ids, starts, counts), counts

    return Memory(encode, led)
