"""Secret scans with multipart credential linking, in DataFrame functions only.

Three base kinds are reported wherever they stand: assignments, access identifiers and
long hexadecimal runs.  Weaker candidates (other identifiers, short assigned values,
unlabelled mixed strings, endpoints) count only next to their complement: an identifier
needs a secret within reach, a secret an identifier, an endpoint both.  Reach is a scope
of code points around a part; the interval join buckets the scopes into cells and is a
semi join, so no pairs are made.

Cases: a NULL text counts as empty and has no spans; a document's spans depend on its
text alone, so repeated rows get the same result each; ties in start are ordered by kind;
an empty table gives an empty result; extra columns are ignored by ``scan`` and carried
by ``redact``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from staylens.llm import rows
from staylens.session import settle

REACH = 200  # code points around a part in which its complement counts
MARK = "[SECRET]"

# kind, role, pattern, group whose length counts, least length; in order of report.
VALUE = r"""["']?\x20*[:=]\x20*["']?"""
KEYS = r"(password|passwd|secret|token|api_?key)"
BASE = (
    ("assign", "secret", rf"(?i){KEYS}{VALUE}([A-Za-z0-9+/_.=-]+)", 2, 12),
    ("access", "identifier", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", "secret", r"[0-9a-f]{16,}", 0, 16),
)
WEAK = (
    (
        "weak_identifier", "identifier",
        r"\b(?:(?:AGPA|AIDA|AIPA|ANPA|ANVA|AROA|ASIA|AKIA)[A-Z0-9]{8,}"
        rf"|(?i:client_?id|access_?key_?id|account|username|login){VALUE}[A-Za-z0-9@._-]+)",
        0, 6,
    ),
    ("weak_assign", "secret", rf"(?i){KEYS}{VALUE}([A-Za-z0-9+/_.=-]{{6,}})", 2, 6),
    (
        "weak_string", "secret",
        r"(?<![A-Za-z0-9+/=_.-])(?=[A-Za-z0-9+/]{32})(?=[^0-9]{0,40}[0-9])(?=[^A-Z]{0,40}[A-Z])"
        r"(?=[^a-z]{0,40}[a-z])[A-Za-z0-9+/]+",
        0, 32,
    ),
    ("endpoint", "endpoint", r"https?://[A-Za-z0-9._-]+(?::[0-9]+)?(?:/[A-Za-z0-9._/-]*)?", 0, 10),
)
KINDS = (*BASE, *WEAK)
NUMBER = {kind[0]: n for n, kind in enumerate(KINDS)}


def _matches(text: Column, pattern: str, group: int) -> Column:
    """gap before, length and counted length of the leftmost non-overlapping matches.

    The text splits into the gaps around the matches, whose lengths give the positions.
    """
    p = F.lit(pattern)
    found = F.arrays_zip(
        F.transform(F.split(text, pattern, -1), F.length).alias("gap"),
        F.transform(F.regexp_extract_all(text, p, F.lit(0)), F.length).alias("size"),
        F.transform(F.regexp_extract_all(text, p, F.lit(group)), F.length).alias("counted"),
    )
    return F.when(text.rlike(pattern), found)


def _candidates(hits: DataFrame) -> DataFrame:
    """doc_id, raw, no, start, end: spans of every kind that are long enough."""
    order = Window.partitionBy("doc_id", "raw", "no").orderBy("at")
    least = F.element_at(F.lit([kind[4] for kind in KINDS]), F.col("no") + 1)
    return (
        hits.select("doc_id", "raw", F.posexplode(F.array(*[k[0] for k in KINDS])).alias("no", "found"))
        .select("doc_id", "raw", "no", F.posexplode("found").alias("at", "m"))
        .where("m.size is not null")
        .select(
            "doc_id", "raw", "no", "m.size", "m.counted",
            F.sum(F.col("m.gap") + F.col("m.size")).over(order).alias("end"),
        )
        .where(F.col("counted") >= least)
        .select("doc_id", "raw", "no", (F.col("end") - F.col("size")).alias("start"), "end")
    )


def _near(some: DataFrame, parts: DataFrame, reach: int) -> DataFrame:
    """Rows of ``some`` that start within reach of a part of the same text."""
    scopes = parts.select(
        F.col("doc_id").alias("__id"), F.col("raw").alias("__raw"),
        (F.col("start") - reach).alias("low"), (F.col("end") + reach).alias("high"),
    ).withColumn("cell", F.explode(F.expr(f"sequence(low div {reach} - 1, high div {reach})")))
    return some.withColumn("at", F.floor(F.col("start") / reach)).join(
        scopes,
        F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("raw") == F.col("__raw"))
        & (F.col("at") == F.col("cell")) & F.col("start").between(F.col("low"), F.col("high")),
        "left_semi",
    ).drop("at")


def _role(role: str) -> Column:
    return F.col("no").isin([n for n, kind in enumerate(KINDS) if kind[1] == role])


def spans(hits: DataFrame, reach: int = REACH) -> DataFrame:
    """doc_id, raw, no, start, end: base spans and linked weak ones."""
    found = settle(_candidates(hits.dropDuplicates(["doc_id", "raw"])))
    secrets, identifiers = found.where(_role("secret")), found.where(_role("identifier"))
    weak = F.col("no") >= len(BASE)
    linked = (
        _near(identifiers.where(weak), secrets, reach)
        .unionByName(_near(secrets.where(weak), identifiers, reach))
        .unionByName(_near(_near(found.where(_role("endpoint")), secrets, reach), identifiers, reach))
    )
    # A weak span adds nothing where a base span has the same bounds.
    base = found.where(~weak)
    same = ["doc_id", "raw", "start", "end"]
    new = linked.alias("l").join(
        base.alias("b"),
        F.expr(" and ".join(f"l.{c} <=> b.{c}" for c in same)),
        "left_anti",
    )
    return base.unionByName(new)


def _text(spans_: Column) -> Column:
    names = F.lit([kind[0] for kind in KINDS])
    return F.array_join(
        F.transform(
            spans_,
            lambda s: F.concat_ws(":", F.element_at(names, s["no"] + 1), s["start"], s["end"]),
        ),
        ",",
    )


def scan(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """One row per document: doc_id, raw, n_assign, n_access, n_hex, base_sha256, spans and
    the spans as an array ``found`` (start, no, end)."""
    text = rows.text_or_empty()
    hits = settle(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.xxhash64(text).alias("raw"),
            *[_matches(text, k[2], k[3]).alias(k[0]) for k in KINDS],
        ).select("*", F.coalesce(*[k[0] for k in KINDS]).isNotNull().alias("hit"))
    )
    by_text = (
        spans(hits.where("hit"), reach).groupBy("doc_id", "raw")
        .agg(F.sort_array(F.collect_list(F.struct("start", "no", "end"))).alias("found"))
        .select(F.col("doc_id").alias("__id"), F.col("raw").alias("__raw"), "found")
    )
    none = F.lit([]).cast("array<struct<start: bigint, no: int, end: bigint>>")
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("raw") == F.col("__raw"))
    rows_ = (
        hits.where("hit").select("doc_id", "raw").join(by_text, same, "left")
        .select("doc_id", "raw", F.coalesce("found", none).alias("found"))
        .unionByName(hits.where("not hit").select("doc_id", "raw", none.alias("found")))
    )
    base = F.filter("found", lambda s: s["no"] < len(BASE))

    def count(n: int, name: str) -> Column:
        return F.size(F.filter("found", lambda s: s["no"] == n)).cast("long").alias(f"n_{name}")

    counts = [count(n, kind[0]) for n, kind in enumerate(BASE)]
    return rows_.select(
        "doc_id", "raw", *counts,
        F.sha2(_text(base), 256).alias("base_sha256"), _text(F.col("found")).alias("spans"), "found",
    )


def redact(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """``docs`` with every span of its texts replaced by a mark; other rows as they are."""
    key, raw, hash_, spans_ = rows.fresh(docs.columns, "member", "raw", "hash", "found")
    found = settle(scan(docs, reach).where("spans <> ''").select("doc_id", "raw", "found").distinct())
    found = found.toDF(key, raw, spans_)
    named = docs.withColumn(hash_, F.xxhash64(rows.text_or_empty()))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(key)) & (F.col(hash_) == F.col(raw))
    written = F.expr(
        f"""aggregate({spans_}, named_struct('at', 0L, 'out', ''),
          (a, s) -> if(s.start >= a.at,
            named_struct('at', s.end, 'out',
              concat(a.out, substring(text, cast(a.at + 1 as int), cast(s.start - a.at as int)), '{MARK}')),
            named_struct('at', greatest(a.at, s.end), 'out', a.out)),
          a -> concat(a.out, substring(text, cast(a.at + 1 as int))))"""
    )
    return (
        named.join(found, same, "left")
        .withColumn("text", F.when(F.col(spans_).isNull(), F.col("text")).otherwise(written))
        .select(*docs.columns)
    )
