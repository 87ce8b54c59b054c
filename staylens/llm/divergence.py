"""Source divergence audit with iceberg prefix refinement of the vocabulary.

Documents become bags of terms.  The vocabulary of a language is found level by level: the
distinct documents of every term prefix of a few bytes are counted, prefixes in fewer than
``least`` documents are discarded with all their extensions, and only extensions of those
that stay are counted at the next, longer level.  A term that ends within a level is
complete and its count final; refinement ends when no unfinished prefix stays.

Tasks learn which prefixes stay from a bit table of fixed size (``BITS``).  A collision in
it lets a prefix through that was discarded; every count that decides is exact, so that
costs work, never a result.  The same table thins the counting of the kept terms, which an
exact join then cleans.

Compared are shares p in thousand millionths, smoothed, with f = (p-q)^2 / (p+q): each source of a
language with every other source over all kept terms (part ``pair``), and each term of a
source with the whole language (part ``term``).

Cases: NULL text, lang and source count as empty; a text without terms makes its group
appear with counts of zero; a language without kept terms has pair values of 0 and no term
rows; repeated rows are documents of their own; ties go by the item's bytes; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pandas.util import hash_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm import pieces, rows
from staylens.session import settle

BREAKS = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"  # ASCII that is no letter
LEAST = 10  # documents of a kept term
TOP = 10  # terms reported per source
FIRST = 4  # bytes of the first level; each further one doubles
TEXT_AT_ONCE = 8 << 20  # bytes of text in a slice
BITS = 1 << 23
UNIT = 1_000_000_000
CELLS = 1 << 20  # terms x sources held dense at once

SLICES = pa.schema(
    [
        ("langs", pa.list_(pa.string())), ("sources", pa.list_(pa.string())),
        ("words", pa.list_(pa.binary())), ("pair_lang", pa.list_(pa.int32())),
        ("pair_word", pa.list_(pa.int32())), ("doc_source", pa.list_(pa.int32())),
        ("doc_terms", pa.list_(pa.int32())), ("pair", pa.list_(pa.int32())),
        ("count", pa.list_(pa.int32())),
    ]
)
PACKED = pa.schema([("slice", pa.binary())])
# Spark reads a row group at once, and would take a whole file for one.
FEW_AT_ONCE = {
    "parquet.block.size": str(8 << 20),
    "parquet.block.size.row.check.min": "1",
    "parquet.page.size.row.check.min": "1",
    "parquet.enable.dictionary": "false",
    "compression": "uncompressed",
}
PREFIXES = pa.schema(
    [("lang", pa.string()), ("prefix", pa.binary()), ("complete", pa.bool_()), ("docs", pa.int64())]
)
CELL = pa.struct([("source", pa.string()), ("count", pa.int64())])
COUNTS = pa.schema([("lang", pa.string()), ("term", pa.binary()), ("cells", pa.list_(CELL))])
WORDS_OF_BITS = pa.schema([("slot", pa.int64()), ("bits", pa.int64())])
GAPS = pa.schema(
    [("lang", pa.string()), ("a", pa.int32()), ("b", pa.int32()), ("value", pa.int64())]
)


def bag(texts: pa.Array, lang: np.ndarray) -> tuple:
    """The distinct terms of each text: words in byte order, the (lang, word) pairs that
    occur, the terms of each text, and pair and occurrences of each term.

    Pairs are in order of (lang, word), so the terms of a text are in byte order.
    """
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), BREAKS)
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
    coded = lists.flatten().dictionary_encode()
    words = coded.dictionary.cast(pa.binary())
    order = pc.sort_indices(words).to_numpy()
    words = words.take(pa.array(order))
    place = np.empty(len(words), np.int64)
    place[order] = np.arange(len(words))
    codes = place[coded.indices.to_numpy(zero_copy_only=False)]
    row = np.repeat(np.arange(len(texts)), sizes)
    if len(words) and not words[0].as_py():  # the cuts leave empty words at the ends
        row, codes = row[codes > 0], codes[codes > 0]
    width = max(len(words), 1)
    met, counts = np.unique(row * width + codes, return_counts=True)
    row, codes = np.divmod(met, width)
    pairs, pair = np.unique(lang[row] * width + codes, return_inverse=True)
    pair_lang, pair_word = np.divmod(pairs, width)
    return words, pair_lang, pair_word, np.bincount(row, minlength=len(texts)), pair, counts


def slices(docs: DataFrame) -> DataFrame:
    """Documents as bags of terms, some megabytes of text to a row.

    A slice codes its languages, sources, words and (lang, word) pairs once; documents are
    runs of pair numbers, stored as steps.  To Spark it is one compressed value: a slice has
    millions of numbers, which Spark would hold one by one for all slices of a file.
    """

    def run(batches):
        how = pa.ipc.IpcWriteOptions(compression="zstd")
        for part in pieces.spans(batches, size=TEXT_AT_ONCE):
            langs = part.column("lang").dictionary_encode()
            sources = part.column("source").dictionary_encode()
            lang = langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            words, pair_lang, pair_word, terms, pair, count = bag(part.column("text"), lang)
            columns = [
                langs.dictionary, sources.dictionary, words, pair_lang, pair_word,
                sources.indices, terms, np.diff(pair, prepend=0), count,
            ]
            made = pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(
                        pa.array([0, len(c)], pa.int32()),
                        c if isinstance(c, pa.Array) else pa.array(c.astype(np.int32)),
                    )
                    for c in columns
                ],
                schema=SLICES,
            )
            with pa.BufferOutputStream() as out:
                with pa.ipc.new_stream(out, SLICES, options=how) as stream:
                    stream.write_batch(made)
                packed = out.getvalue().to_pybytes()
            yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary())], schema=PACKED)

    return docs.select(
        rows.text_or_empty("lang").alias("lang"),
        rows.text_or_empty("source").alias("source"),
        rows.text_or_empty().alias("text"),
    ).mapInArrow(run, "slice binary")


class Slice:
    """One row of ``slices`` as arrays."""

    def __init__(self, packed: bytes):
        batch = pa.ipc.open_stream(packed).read_next_batch()

        def column(name: str) -> pa.Array:
            return batch.column(name)[0].values

        def numbers(name: str) -> np.ndarray:
            return column(name).to_numpy(zero_copy_only=False)

        self.langs, self.sources, self.words = column("langs"), column("sources"), column("words")
        self.pair_lang, self.pair_word = numbers("pair_lang"), numbers("pair_word")
        self.doc_source, self.count = numbers("doc_source"), numbers("count")
        self.pair = np.cumsum(numbers("pair"), dtype=np.int32)
        self.row = np.repeat(np.arange(self.doc_source.size, dtype=np.int32), numbers("doc_terms"))

    def alive(self, table: np.ndarray, prefixes: pa.Array) -> np.ndarray:
        """Whether the table may hold each pair's language and prefix."""
        at = slots(hashes(self.langs)[self.pair_lang], hashes(prefixes)[self.pair_word])
        return holds(table, at)


def each_slice(batches):
    for batch in batches:
        for packed in batch.column("slice"):
            found = Slice(packed.as_py())
            if found.pair.size:
                yield found


def slots(langs: np.ndarray, prefixes: np.ndarray) -> np.ndarray:
    """Places in the bit table of (hash of lang, hash of prefix)."""
    mixed = (langs * np.uint64(0x9E3779B97F4A7C15)) ^ prefixes
    return (mixed % np.uint64(BITS)).astype(np.int64)


def hashes(values: pa.Array) -> np.ndarray:
    return hash_array(values.to_numpy(zero_copy_only=False).astype(object), categorize=False)


def bit_table(kept: DataFrame, column: str) -> np.ndarray:
    """The bits of all (lang, column) rows: BITS / 8 bytes, however many rows."""

    def run(batches):
        for batch in batches:
            at = slots(hashes(batch.column("lang")), hashes(batch.column(column)))
            word, bit = at >> 6, np.uint64(1) << (at & 63).astype(np.uint64)
            order = np.argsort(word, kind="stable")
            first = np.flatnonzero(np.diff(word[order], prepend=-1))
            joined = np.bitwise_or.reduceat(bit[order], first) if first.size else bit[:0]
            yield rows.batch(
                WORDS_OF_BITS,
                {"slot": word[order][first], "bits": joined.astype(np.uint64).view(np.int64)},
            )

    table = np.zeros(BITS >> 6, np.int64)
    found = kept.select("lang", column).mapInArrow(run, "slot long, bits long")
    for row in found.groupBy("slot").agg(F.bit_or("bits").alias("bits")).collect():
        table[row["slot"]] = row["bits"]
    return table


def holds(table: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (table[at >> 6] >> (at & 63)) & 1 == 1


def prefix_counts(
    sliced: DataFrame, reach: int, before: int = 0, table: np.ndarray | None = None
) -> DataFrame:
    """Distinct documents per (lang, prefix of ``reach`` bytes, complete).

    With ``table`` only terms longer than ``before`` whose prefix of that length it holds.
    """

    def run(batches):
        for part in each_slice(batches):
            words = part.words
            size = pc.binary_length(words).to_numpy(zero_copy_only=False)
            live = size[part.pair_word] > before
            if table is not None:
                live &= part.alive(table, pc.binary_slice(words, 0, before))
            # Words are in byte order, so those of one prefix are neighbours.
            cut = pc.binary_slice(words, 0, reach)
            ends = pc.binary_length(words).to_numpy(zero_copy_only=False) <= reach
            new = np.ones(len(words), bool)
            same = pc.equal(cut.slice(1), cut.slice(0, max(len(cut) - 1, 0)))
            new[1:] = ~same.to_numpy(zero_copy_only=False) | ends[1:] | ends[:-1]
            prefix = np.cumsum(new) - 1
            width = int(prefix[-1]) + 1
            ids, keys = pd.factorize(part.pair_lang.astype(np.int64) * width + prefix[part.pair_word])
            ids = np.where(live, ids, -1)[part.pair]
            row, ids = part.row[ids >= 0], ids[ids >= 0]
            first = np.ones(ids.size, bool)
            first[1:] = (ids[1:] != ids[:-1]) | (row[1:] != row[:-1])
            docs = np.bincount(ids[first], minlength=len(keys))
            met = np.flatnonzero(docs)
            lang, at = np.divmod(keys[met], width)
            word = np.flatnonzero(new)[at]
            yield pa.RecordBatch.from_arrays(
                [
                    part.langs.take(pa.array(lang)),
                    cut.take(pa.array(word)),
                    pa.array(ends[word]),
                    pa.array(docs[met]),
                ],
                schema=PREFIXES,
            )

    counted = sliced.mapInArrow(
        run, "lang string, prefix binary, complete boolean, docs long"
    )
    return counted.groupBy("lang", "prefix", "complete").agg(F.sum("docs").alias("docs"))


def vocabulary(sliced: DataFrame, least: int = LEAST, first: int = FIRST) -> DataFrame:
    """(lang, term, docs) of the terms in at least ``least`` documents of their language."""
    complete, table, before, reach = [], None, 0, first
    while True:
        kept = settle(
            prefix_counts(sliced, reach, before, table).where(F.col("docs") >= F.lit(least))
        )
        complete.append(kept.where("complete").select("lang", F.col("prefix").alias("term"), "docs"))
        longer = kept.where("not complete")
        if longer.isEmpty():
            break
        table, before, reach = bit_table(longer, "prefix"), reach, 2 * reach
    out = complete[0]
    for more in complete[1:]:
        out = out.unionByName(more)
    return out


def term_counts(sliced: DataFrame, kept: DataFrame) -> DataFrame:
    """(lang, term, cells, lang_count) of the kept terms: a cell is a source and the count there.

    A slice gives one row per term, with its sources beside it.  Terms meet once, by
    (lang, term): there rows are cleaned, added and packed without another shuffle.
    """
    table = bit_table(kept, "term")

    def run(batches):
        for part in each_slice(batches):
            live = part.alive(table, part.words)[part.pair]
            width = len(part.sources)
            source = part.doc_source[part.row[live]]
            keys = part.pair[live].astype(np.int64) * width + source
            order = np.argsort(keys)
            keys = keys[order]
            new = np.flatnonzero(np.diff(keys, prepend=-1))
            total = part.count[live].astype(np.int64)[order]
            total = np.add.reduceat(total, new) if new.size else total
            pair, source = np.divmod(keys[new], width)
            first = np.flatnonzero(np.diff(pair, prepend=-1))
            cells = pa.StructArray.from_arrays(
                [part.sources.take(pa.array(source)), pa.array(total)], fields=list(CELL)
            )
            yield pa.RecordBatch.from_arrays(
                [
                    part.langs.take(pa.array(part.pair_lang[pair[first]])),
                    part.words.take(pa.array(part.pair_word[pair[first]])),
                    pa.ListArray.from_arrays(pa.array(np.append(first, pair.size), pa.int32()), cells),
                ],
                schema=COUNTS,
            )

    found = sliced.mapInArrow(
        run, "lang string, term binary, cells array<struct<source: string, count: long>>"
    )
    # Kept terms of one partition fit a hash table, so neither side is sorted.
    cells = found.join(kept.select("lang", "term").hint("shuffle_hash"), ["lang", "term"])
    summed = (
        cells.select("lang", "term", F.inline("cells"))
        .groupBy("lang", "term", "source").agg(F.sum("count").alias("count"))
    )
    return summed.groupBy("lang", "term").agg(
        F.collect_list(F.struct("source", "count")).alias("cells"),
        F.sum("count").alias("lang_count"),
    )


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(UNIT * (count + 2) / (n + 2 v)), exact at any count."""
    top = F.lit(UNIT).cast("decimal(10,0)") * (count + 2).cast("decimal(20,0)")
    whole = F.call_function("div", top, (n + 2 * v).cast("decimal(20,0)"))
    return whole.cast("long") + 1


def gaps(packed: DataFrame) -> DataFrame:
    """Sums of f over the terms, per lang and pair of sources a < b.

    Rows hold one term: the sources it occurs in, its counts there, and the names and N of
    all sources of the language.  A task adds the pairs of a batch before it gives them out.
    """

    def run(batches):
        for batch in batches:
            langs = batch.column("lang").dictionary_encode()
            code = langs.indices.to_numpy(zero_copy_only=False)
            for i, lang in enumerate(langs.dictionary.to_pylist()):
                part = placed(batch.take(pa.array(np.flatnonzero(code == i))))
                n = np.array(part.column("totals")[0].as_py(), object)
                v = part.column("v")[0].as_py()
                step = max(1, CELLS // len(n))
                sums = np.zeros((len(n), len(n)), np.int64)
                for start in range(0, part.num_rows, step):
                    sums += pair_sums(part.slice(start, step), n + 2 * v)
                a, b = np.triu_indices(len(n), 1)
                yield rows.batch(
                    GAPS,
                    {"lang": [lang] * a.size, "a": a, "b": b, "value": sums[a, b]},
                )

    found = packed.mapInArrow(run, "lang string, a int, b int, value long")
    return found.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def placed(part: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of one language, with the places of their sources in the order of names."""
    sizes = pc.list_value_length(part.column("sources")).to_numpy(zero_copy_only=False)
    at = pc.index_in(part.column("sources").flatten(), value_set=part.column("names")[0].values)
    ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
    return part.append_column("places", pa.ListArray.from_arrays(pa.array(ends), at))


def pair_sums(part: pa.RecordBatch, below: np.ndarray) -> np.ndarray:
    """f of every pair of sources a < b, summed over the terms of ``part``."""
    sizes = pc.list_value_length(part.column("places")).to_numpy(zero_copy_only=False)
    at = part.column("places").flatten().to_numpy(zero_copy_only=False)
    counts = part.column("counts").flatten().to_numpy(zero_copy_only=False)
    dense = np.zeros((part.num_rows, below.size), np.int64)
    dense[np.repeat(np.arange(part.num_rows), sizes), at] = counts
    if dense.max(initial=0) < 2**62 // UNIT:
        p = 1 + UNIT * (dense + 2) // below.astype(np.int64)
    else:  # Python's integers
        p = (1 + UNIT * (dense.astype(object) + 2) // below).astype(np.int64)
    sums = np.zeros((below.size, below.size), np.int64)
    for a in range(below.size - 1):
        gap, both = p[:, a + 1 :] - p[:, a : a + 1], p[:, a + 1 :] + p[:, a : a + 1]
        sums[a, a + 1 :] = (gap * gap // both).sum(axis=0)
    return sums


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank of every group."""
    sliced = settle(slices(docs), FEW_AT_ONCE)
    kept = settle(vocabulary(sliced, least))
    packed = settle(term_counts(sliced, kept))
    counts = packed.select("lang", "term", "lang_count", F.inline("cells"))

    in_group = counts.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = (
        docs.select(
            rows.text_or_empty("lang").alias("lang"), rows.text_or_empty("source").alias("source")
        ).distinct()
        .join(in_group, ["lang", "source"], "left")
        .select("lang", "source", F.coalesce("n", F.lit(0).cast("long")).alias("n"), place.alias("at"))
    )
    groups = settle(groups)
    sizes = kept.groupBy("lang").agg(F.count("*").alias("v"))
    langs = settle(
        groups.groupBy("lang")
        .agg(
            F.sum("n").alias("lang_n"),
            F.array_sort(F.collect_list(F.struct("at", "n", "source"))).alias("all"),
        )
        .join(sizes, "lang")
        .select(
            "lang", "lang_n", "v", F.col("all.n").alias("totals"), F.col("all.source").alias("names")
        )
    )

    # Sources against each other.
    cells = packed.join(langs.select("lang", "names", "totals", "v"), "lang").select(
        "lang", "cells.source", "cells.count", "names", "totals", "v"
    ).toDF("lang", "sources", "counts", "names", "totals", "v")
    halves = settle(gaps(cells))
    both = halves.unionByName(
        halves.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value")
    )
    others = groups.select("lang", F.col("source").alias("item"), F.col("at").alias("b"))
    pairs = (
        groups.select("lang", "source", F.col("at").alias("a")).join(others, "lang")
        .where("a != b")
        .join(both, ["lang", "a", "b"], "left")
        .select("lang", "source", "item", F.coalesce("value", F.lit(0).cast("long")).alias("value"))
    )

    # Terms against the language.
    terms = (
        counts.withColumnRenamed("term", "item")
        .join(groups.drop("at"), ["lang", "source"])
        .join(langs.drop("totals", "names"), "lang")
        .withColumn("p", share(F.col("count"), F.col("n"), F.col("v")))
        .withColumn("q", share(F.col("lang_count"), F.col("lang_n"), F.col("v")))
        .where("p > q")
        .withColumn("gap", F.col("p") - F.col("q"))
        .withColumn("value", F.expr("(gap * gap) div (p + q)"))
    )
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = F.row_number().over(order).alias("rank")

    def part(df: DataFrame, name: str) -> DataFrame:
        text = F.col("item").cast("string").alias("item")
        return df.select("lang", "source", "item", "value", ranked).select(
            "lang", "source", F.lit(name).alias("part"), text, "value", "rank"
        )

    found = part(terms, "term").where(F.col("rank") <= top)
    return part(pairs, "pair").unionByName(found)
