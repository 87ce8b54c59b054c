"""Encoding, its file format and packing against the tokenizers library."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from staylens.llm import bpe, elias_fano, packing, pieces

BYTE = public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEÉéñß ,.'!\n\t  0123456789-=_\x1c\x85\xa0 　漢字😀́"


def texts(n):
    rng = random.Random(3)
    out = ["", " ", "a", " a", "  a", "a ", "a  ", "a \n b", "a\x1c b", "x<|endoftext|> y", "don't,."]
    out += ["".join(rng.choices(LETTERS, k=rng.randint(1, 50))) for _ in range(n)]
    out += ["".join(rng.choices("etaoinshrdlu", k=rng.randint(5, 90))) for _ in range(n)]
    return [*out, "aaaa" * 500, "-" * 777, "the " * 3000, "<|endoftext|>" * 3]


@pytest.mark.parametrize("size", [1_500_000, 50])
def test_own_encoder_is_exact(size):
    library = Tokenizer.from_file(BYTE)
    tables = bpe.Bpe(BYTE)
    memory = pieces.Memory(tables.encode_pieces, True, size)
    all_texts = texts(1500)
    for start in range(0, len(all_texts), 400):
        part = all_texts[start : start + 400]
        for text, ids in zip(part, memory.each(pa.array(part))):
            wanted = library.encode(text, add_special_tokens=False).ids
            assert ids.tolist() == wanted, text
            assert tables.decode(ids) == library.decode(wanted, skip_special_tokens=False)
    assert tables.decode(np.array([255, 50256, 0])) == library.decode([255, 50256, 0], skip_special_tokens=False)


@pytest.mark.parametrize("path,led", [(BYTE, True), (WORD, False)])
def test_remembered_pieces_give_the_library_s_ids(path, led):
    library = Tokenizer.from_file(path)
    some = [*texts(800), "İSTANBUL Σίσυφος ΣΑΣ", "é ́x", "<|startoftext|>Hi<|endoftext|>"]
    for text, ids in zip(some, pieces.library(path, led).each(pa.array(some))):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text


def test_lines_and_closing_marks_are_pieces_of_their_own():
    """Words beside a line's end or marks are met again as the words they are."""
    asked = []

    def encode(parts):
        asked.extend(parts)
        return np.arange(len(parts), dtype=np.uint32), np.ones(len(parts), np.int64)

    memory = pieces.Memory(encode, True)
    memory.ids(pa.array(["a big.\nBig dog!? (a) x<|name|>\na\n\nb", "a\n", "\na", " dog. a\r\nb a\n\x85b"]))
    assert sorted(asked) == sorted(
        ["", "a", " big", ".", "\n", "Big", " dog", "!?", " (a", ")", " x<|name|>\na\n\nb", "a\n", "\na"]
        + [" a\r\nb", " a\n\x85b"]
    )


def test_plain_pieces_go_to_the_library_as_one_text(monkeypatch):
    """Only pieces at whose edges white space would join are handed over with their offsets."""
    alone, together = [], []

    class Spy:
        from_file = staticmethod(lambda path: Spy(path))

        def __init__(self, path):
            self.own = Tokenizer.from_file(path)

        def __getattr__(self, name):
            return getattr(self.own, name)

        def encode(self, parts, **options):
            alone.extend(parts)
            return self.own.encode(parts, **options)

        def encode_batch_fast(self, parts, **options):
            together.extend(parts)
            return self.own.encode_batch_fast(parts, **options)

    monkeypatch.setattr("tokenizers.Tokenizer", Spy)
    library = Tokenizer.from_file(BYTE)
    memory = pieces.library.__wrapped__(BYTE, True)
    some = ["Ein Wort, été\n漢字 x<|endoftext|>! 12 it's\n(so)", "b  c", "d ", "\te", "", "\x1c f"]
    for text, ids in zip(some, memory.each(pa.array(some))):
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids, text
    assert len(together) == 1 and " Wort" in together[0] and "\n漢字" in together[0]
    assert set(alone) == {"", " ", "  c", "\n", "\te", "\x1c f"}


def test_letters_beside_lines_and_marks():
    """Each letter before and after a line's end and before marks, against the library."""
    library = Tokenizer.from_file(BYTE)
    memory = pieces.library(BYTE, led=True)
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    for start in range(0, len(letters), 20_000):
        part = [f"x{c}! {c}\n{c} {c}'\n{c}?, a" for c in letters[start : start + 20_000]]
        wanted = library.encode_batch(part, add_special_tokens=False)
        for text, ids, own in zip(part, memory.each(pa.array(part)), wanted):
            assert ids.tolist() == own.ids, repr(text)


def docs(spark):
    some = [*texts(60), None]
    table = [(i, t, 1, b"x", "low") for i, t in zip(random.Random(5).sample(range(1000), len(some)), some)]
    table += [(7777, "twice", 1, b"x", "low")] * 2 + [(None, "no id", 1, b"x", "low")]
    return table, spark.createDataFrame(table, "doc_id long, text string, block int, ids binary, low string")


def test_round_trip_digests(spark):
    library = Tokenizer.from_file(BYTE)
    table, df = docs(spark)
    wanted = []
    for i, t, *_ in table:
        ids = library.encode(t or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        wanted.append((i, len(ids), hashlib.sha256(raw).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(map(tuple, bpe.round_trip(df, BYTE).collect()), key=str) == sorted(wanted, key=str)
    back = bpe.decode(bpe.encode(df, BYTE), BYTE).select("doc_id", "text").collect()
    assert sorted(map(tuple, back), key=str) == sorted(((r[0], r[1] or "") for r in table), key=str)


def test_elias_fano_sequences():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 63, 64, 65, 1000):
        for top in (0, 1, 40, 10**6):
            values = np.sort(rng.integers(0, top + 1, n))
            coded = elias_fano.Sequence.of(values)
            assert coded.select(np.arange(n)).tolist() == values.tolist()
            some = rng.integers(0, n, 30) if n else np.zeros(0, np.int64)
            assert coded.select(some).tolist() == values[some].tolist()
            assert [coded.get(i) for i in range(n)] == values.tolist()
    values = np.cumsum(rng.integers(1, 2000, 10_000))
    coded = elias_fano.Sequence.of(values)
    bits = 8 * (len(coded.low) + len(coded.high) + len(coded.samples))
    assert bits < 10_000 * (2.6 + np.log2(values[-1] / 10_000))


def test_select_needs_its_samples():
    """Offsets come from the samples: with one moved, the places behind it are wrong."""
    values = np.cumsum(np.random.default_rng(4).integers(1, 90, 500))
    coded = elias_fano.Sequence.of(values)
    moved = np.frombuffer(coded.samples, "<u4").copy()
    moved[3] += 64
    broken = elias_fano.Sequence(coded.n, coded.low_bits, coded.low, coded.high, moved.tobytes())
    got = broken.select(np.arange(500))
    assert (got[:192] == values[:192]).all() and (got[192:256] != values[192:256]).any()
    wide = np.array([0, 2**40, 2**40, 2**41 + 5])
    assert elias_fano.Sequence.of(wide).select(np.arange(4)).tolist() == wide.tolist()


@pytest.mark.parametrize("block_ids", [elias_fano.BLOCK_IDS, 500])
def test_files_give_every_document_back(spark, tmp_path, block_ids, monkeypatch):
    monkeypatch.setattr(elias_fano, "AT_ONCE", 7)
    library = Tokenizer.from_file(BYTE)
    table, df = docs(spark)
    path = str(tmp_path / "out")
    elias_fano.write(df, path, BYTE, 2, block_ids)
    at, wanted = 0, []
    for i, t, *_ in sorted(table, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 2]
        wanted.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    got = elias_fano.digests(spark, path).collect()
    assert sorted(map(tuple, got), key=str) == sorted(wanted, key=str)
    i, t = table[20][:2]
    assert elias_fano.document(spark, path, i).tolist() == [*library.encode(t, add_special_tokens=False).ids, 2]
    assert elias_fano.document(spark, path, 10**9) is None


def test_packing(spark):
    library = Tokenizer.from_file(WORD)
    table, df = docs(spark)
    got = packing.packed_table(df, WORD, 1).collect()
    assert len({r["sequence_id"] for r in got}) == len(got)
    by = {}
    for r in got:
        assert r["length"] == r["bucket"] <= 2048 and r["length"] & (r["length"] - 1) == 0
        assert r["offset"] == 0 and len(r["ids"]) == 2 * r["length"]
        by.setdefault(r["doc_id"], []).append(r)
    assert len(by) == len({r[0] for r in table})
    for i, t, *_ in table:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        parts = sorted(by[i], key=lambda r: r["start"])[:: 2 if i == 7777 else 1]
        assert np.concatenate([np.frombuffer(r["ids"], "<u2") for r in parts]).tolist() == ids
        for r in parts:
            piece = np.array(ids[r["start"] : r["start"] + r["length"]], "<u4")
            assert r["ids_crc32"] == zlib.crc32(piece.tobytes()) and r["doc_tokens"] == len(ids)


def test_empty_tables(spark, tmp_path):
    df = docs(spark)[1].limit(0)
    assert bpe.round_trip(df, BYTE).count() == 0
    assert packing.packed_table(df, WORD, 1).count() == 0
    elias_fano.write(df, str(tmp_path / "none"), BYTE, 2)
    assert elias_fano.digests(spark, str(tmp_path / "none")).count() == 0


def test_lengths():
    for n in (1, 2047, 2048, 5000):
        assert sum(packing.lengths(n)) == n and packing.lengths(n) == sorted(packing.lengths(n))[::-1]


def test_every_letter_before_closing_marks():
    """Marks after letters that change when normalised share a token with them."""
    library = Tokenizer.from_file(WORD)
    memory = pieces.library(WORD, led=False)
    letters = [chr(c) for c in range(0x110000) if chr(c).isalpha()]
    some = [c + mark for c in letters for mark in (".", ",")]
    some += [f"a{c}., b" for c in letters if c.lower()[-1:].isalpha() is False or ord(c) > 0xFB00]
    some += ["é.", "e\u0301.", "i̇,", "n\u0303,."]
    for start in range(0, len(some), 20_000):
        part = some[start : start + 20_000]
        wanted = library.encode_batch(part, add_special_tokens=False)
        for text, ids, own in zip(part, memory.each(pa.array(part)), wanted):
            assert ids.tolist() == own.ids, repr(text)


def test_memory_stays_in_its_budget():
    size = 1 << 20
    memory = pieces.Memory(lambda parts: (np.arange(len(parts), dtype=np.uint32), np.ones(len(parts), np.int64)), False, size)
    rng = random.Random(1)
    for _ in range(30):
        part = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(4000)]
        memory.ids(pa.array([" ".join(part)]))
        assert memory.young.bytes <= size // 2 and memory.old.bytes <= size
