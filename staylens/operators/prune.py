"""Feature profiles, pruning, schema comparison and quality guards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions.hashing import portable_hash
from staylens.functions.numbers import zscore
from staylens.functions.text import quoted
from staylens.operators.features import measured_members
from staylens.operators.ranking import exact_quantiles, ordinals
from staylens.session import settle

HASH_SEED = 42


def entity_count(entities: DataFrame, entity: str = "entity_id") -> Column:
    """Number of entities as a scalar subquery (no driver round trip)."""
    return entities.agg(F.count_distinct(entity)).scalar()


def dense_moments(long: DataFrame, members: DataFrame | None = None) -> DataFrame:
    """n, mean, population variance, low and high per feature, implied zeros included.

    Only ``measured`` features imply zeros: one for each member of the modality
    without a row.  They enter by closed forms over the share of stored rows, so
    no cell is made for them; ``zeros`` says how many there are.
    """
    stored = long.groupBy("feature", "modality", "stat").agg(
        F.count("value").alias("stored"),
        F.avg("value").alias("avg"),
        F.var_pop("value").alias("spread"),
        F.min("value").alias("least"),
        F.max("value").alias("most"),
    )
    sizes = measured_members(long, members).groupBy("modality").agg(
        F.count_distinct("entity_id").alias("m")
    )
    implied = F.coalesce(F.col("stat") == "measured", F.lit(False))
    zeros = F.when(implied, F.coalesce(F.col("m"), F.col("stored")) - F.col("stored"))
    filled = stored.join(sizes, "modality", "left").withColumn(
        "zeros", F.coalesce(zeros, F.lit(0).cast("long"))
    )
    n = F.col("stored") + F.col("zeros")
    share = F.col("stored") / n
    some = F.col("zeros") > 0
    return filled.select(
        "feature",
        "modality",
        "stat",
        n.alias("n"),
        "zeros",
        (share * F.col("avg")).alias("mean"),
        (share * F.col("spread") + share * (1 - share) * F.col("avg") * F.col("avg")).alias("var"),
        F.when(some, F.least("least", F.lit(0.0))).otherwise(F.col("least")).alias("low"),
        F.when(some, F.greatest("most", F.lit(0.0))).otherwise(F.col("most")).alias("high"),
    )


def feature_profile(
    long: DataFrame, n_entities: Column | int, members: DataFrame | None = None
) -> DataFrame:
    """Support, mean-imputed population variance, min and max per feature.

    Imputed cells sit on the mean, so they add nothing to the squared sum and
    the variance over all entities is var_pop * support / N.
    """
    total = n_entities if isinstance(n_entities, Column) else F.lit(n_entities)
    return dense_moments(long, members).select(
        "feature",
        "modality",
        "stat",
        F.col("n").alias("support"),
        (F.col("var") * F.col("n") / total.cast("double")).alias("variance"),
        F.col("low").alias("min_value"),
        F.col("high").alias("max_value"),
        (F.col("low") < F.col("high")).alias("is_variable"),
    )


def kept_features(
    profile: DataFrame, min_support: int = 1, top_k: int | None = None
) -> DataFrame:
    """Schema of the features that survive: (ordinal, feature, support, variance, score).

    Constant features go first, then those below the support, then only the
    ``top_k`` by 0.7 z(variance) + 0.3 z(support) stay.  Bounds below one mean
    support 1 and no cap.  The profile has one row per feature, so its moments
    are scalar subqueries and its order a bounded sort.
    """
    min_support = max(1, min_support)
    if top_k is not None and top_k < 1:
        top_k = None
    kept = profile.filter(F.col("is_variable") & (F.col("support") >= min_support))
    # one subquery for all four moments, so the profile is computed once for it
    moments = kept.agg(
        F.struct(
            F.avg("variance").alias("vm"),
            F.coalesce(F.stddev_samp("variance"), F.lit(0.0)).alias("vs"),
            F.avg("support").alias("sm"),
            F.coalesce(F.stddev_samp("support"), F.lit(0.0)).alias("ss"),
        )
    ).scalar()
    vm, vs, sm, ss = (moments[c] for c in ("vm", "vs", "sm", "ss"))
    score = F.lit(0.7) * zscore(F.col("variance"), vm, vs) + F.lit(0.3) * zscore(
        F.col("support").cast("double"), sm, ss
    )
    scored = kept.select("feature", "support", "variance", score.alias("score"))
    if top_k is not None:
        scored = scored.orderBy(F.col("score").desc(), "feature").limit(top_k)
    return ordinals(scored, ["feature"]).select("ordinal", "feature", "support", "variance", "score")


def prune(
    long: DataFrame,
    n_entities: Column | int,
    min_support: int = 1,
    top_k: int | None = None,
    members: DataFrame | None = None,
) -> DataFrame:
    """feature_long reduced to the kept features.

    Keep the members of the unpruned frame next to the result: its own rows no
    longer tell where ``measured`` zeros are implied.
    """
    schema = kept_features(feature_profile(long, n_entities, members), min_support, top_k)
    names = schema.select("feature")
    # top_k names at most; without a cap the size is left to the optimizer
    names = F.broadcast(names) if top_k is not None and top_k >= 1 else names
    return long.join(names, "feature", "left_semi")


def prune_report(profile: DataFrame, min_support: int = 1) -> DataFrame:
    """Counts of features dropped as constant and dropped for low support."""
    variable = F.col("is_variable")
    enough = F.col("support") >= max(1, min_support)
    return profile.agg(
        F.count(F.lit(1)).alias("original"),
        F.count_if(~variable).alias("zero_variance_dropped"),
        F.count_if(variable & ~enough).alias("low_support_dropped"),
        F.count_if(variable & enough).alias("eligible"),
    )


def top_variance(profile: DataFrame, k: int = 5) -> DataFrame:
    """Preview of the features with the highest variance."""
    return profile.orderBy(F.col("variance").desc(), "feature").limit(k)


def support_quantiles(
    profile: DataFrame,
    quantiles: Sequence[float] = (0.25, 0.5, 0.75),
    at_least: Sequence[int] = (1, 5, 10),
) -> DataFrame:
    """Distribution of supports and counts of features above thresholds.

    The quantiles are those of the counted distinct supports, exact and distributed.
    """
    support = F.col("support")
    found = exact_quantiles(profile, "support", quantiles)
    found = found.agg(F.array_sort(F.collect_list(F.struct("ordinal", "value"))).alias("cuts"))
    cut = settle(found.select(F.col("cuts.value").alias("cut"))).scalar()
    row = profile.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.avg(support).alias("mean_support"),
        F.stddev_samp(support).alias("std_support"),
        F.min(support).alias("min_support"),
        F.max(support).alias("max_support"),
        *[F.count_if(support >= t).alias(f"n_at_least_{t}") for t in at_least],
    )
    named = [F.get(cut, F.lit(i)).alias(f"q{round(q * 100)}") for i, q in enumerate(quantiles)]
    return row.select("*", *named)


def health_profile(
    long: DataFrame,
    n_entities: Column | int,
    digits: int = 6,
    members: DataFrame | None = None,
) -> DataFrame:
    """Per feature: min, max, std, distinct values, missing share, constant flag, hash.

    The hash is a sum of portable hashes of (entity, value rounded to ``digits``)
    over all stored values, so any change of any value shows and it combines on
    the map side.  Implied zeros count as values, but add nothing to the hash.
    """
    total = n_entities if isinstance(n_entities, Column) else F.lit(n_entities)
    shown = F.col("value").try_cast(f"decimal(38,{digits})").cast("string")
    cell = portable_hash(F.concat_ws(":", F.col("entity_id").cast("string"), shown), HASH_SEED)
    values = long.groupBy("feature", "value").agg(
        F.sum(cell.cast("decimal(20,0)")).alias("hash")
    )
    distinct = values.groupBy("feature").agg(
        F.count("value").alias("stored_unique"), F.sum("hash").cast("string").alias("values_hash")
    )
    n_unique = F.col("stored_unique") + (F.col("zeros") > 0).cast("long")
    return dense_moments(long, members).join(distinct, "feature").select(
        "feature",
        F.col("low").alias("min_value"),
        F.col("high").alias("max_value"),
        F.sqrt("var").alias("std_pop"),
        n_unique.alias("n_unique"),
        (F.lit(1.0) - F.col("n") / total.cast("double")).alias("missing_frac"),
        (n_unique <= 1).cast("int").alias("all_constant"),
        "values_hash",
    )


def variable_fraction(
    long: DataFrame,
    n_entities: Column | int,
    count_null: bool = False,
    members: DataFrame | None = None,
) -> DataFrame:
    """Features with more than one value, as count and share of all.

    With ``count_null`` a missing cell counts as one more value.
    """
    profile = feature_profile(long, n_entities, members)
    total = n_entities if isinstance(n_entities, Column) else F.lit(n_entities)
    varies = F.col("is_variable")
    if count_null:
        varies = varies | (F.col("support") < total)
    return profile.agg(
        F.count(F.lit(1)).alias("n_features"),
        F.count_if(varies).alias("n_variable"),
        F.avg(varies.cast("double")).alias("variable_fraction"),
    )


def wide_variable_fraction(wide: DataFrame, count_null: bool = True) -> DataFrame:
    """The same check on an aligned wide frame, in one aggregate pass."""
    names = [c for c in wide.columns if c != "entity_id"]
    flags = []
    for c in names:
        column = F.col(quoted(c))
        varies = F.coalesce(F.min(column) < F.max(column), F.lit(False))
        if count_null:
            mixed = (F.count(column) > 0) & (F.count(column) < F.count(F.lit(1)))
            varies = varies | mixed
        flags.append(varies)
    # One array, not a chained sum: thousands of columns would nest too deep to plan.
    return wide.agg(F.array(*flags).alias("varies")).select(
        F.lit(len(names)).alias("n_features"),
        F.size(F.filter("varies", lambda v: v)).alias("n_variable"),
    ).withColumn("variable_fraction", F.col("n_variable") / F.col("n_features"))


def schema_diff(a: DataFrame, b: DataFrame, on: str = "feature") -> DataFrame:
    """Shared, union and one-sided counts of two name lists, and their Jaccard index."""
    left = a.select(on).distinct().withColumn("in_a", F.lit(1))
    right = b.select(on).distinct().withColumn("in_b", F.lit(1))
    both = left.join(right, on, "full")
    ina, inb = F.col("in_a").isNotNull(), F.col("in_b").isNotNull()
    return both.agg(
        F.count_if(ina & inb).alias("n_shared"),
        F.count(F.lit(1)).alias("n_union"),
        F.count_if(ina & ~inb).alias("n_only_a"),
        F.count_if(inb & ~ina).alias("n_only_b"),
    ).withColumn("jaccard", F.try_divide(F.col("n_shared"), F.col("n_union")))


def id_parity(labels: DataFrame, features: DataFrame, on: str = "entity_id") -> DataFrame:
    """Entities missing on either side and the covered share of the labels."""
    diff = schema_diff(labels, features, on)
    n_labels = F.col("n_shared") + F.col("n_only_a")
    return diff.select(
        n_labels.alias("n_labels"),
        (F.col("n_shared") + F.col("n_only_b")).alias("n_features"),
        F.col("n_only_a").alias("missing_in_features"),
        F.col("n_only_b").alias("extra_in_features"),
        F.coalesce(F.try_divide(F.col("n_shared"), n_labels), F.lit(0.0)).alias("overlap_frac"),
    )


def variance_collapse(
    before: DataFrame,
    after: DataFrame,
    members: DataFrame | None = None,
    members_after: DataFrame | None = None,
) -> DataFrame:
    """Variance per feature before and after a row selection; collapsed where it died.

    Constancy is decided by min and max, which do not suffer from rounding.  A
    ``measured`` feature that lost all its rows is a column of zeros for the
    members that are left.
    """

    def spread(long: DataFrame, inside: DataFrame | None, tag: str) -> DataFrame:
        return dense_moments(long, inside).select(
            "feature",
            "modality",
            "stat",
            F.col("var").alias(f"var_{tag}"),
            (F.col("low") < F.col("high")).alias(f"varies_{tag}"),
        )

    left = measured_members(after, members_after).select("modality").distinct()
    left = left.select("modality", F.lit(0.0).alias("flat"))
    now = spread(after, members_after, "after").drop("modality", "stat")
    joined = spread(before, members, "before").join(now, "feature", "left")
    joined = joined.join(left, "modality", "left")
    flat = F.when(F.col("stat") == "measured", F.col("flat"))
    gone = F.col("varies_before") & ~F.coalesce(F.col("varies_after"), F.lit(False))
    return joined.select(
        "feature",
        "var_before",
        F.coalesce("var_after", flat).alias("var_after"),
        gone.cast("int").alias("collapsed"),
    )


# ---------------------------------------------------------------------------
# Guards.  Each runs one aggregate, fetches its single row and raises.


class QualityError(RuntimeError):
    """A data-quality rule was broken."""


def assert_variable_fraction(fraction: DataFrame, minimum: float, strict: bool = True) -> float:
    """Raise (or, not strict, only return) when too few features vary."""
    row = fraction.first()
    share = float(row["variable_fraction"] or 0.0) if row["n_features"] else 0.0
    if strict and (row["n_variable"] == 0 or share < minimum):
        raise QualityError(
            f"{row['n_variable']} of {row['n_features']} features vary, {minimum:.0%} needed"
        )
    return share


def assert_schema_not_shrunk(old: DataFrame, new: DataFrame, minimum: float = 0.9) -> None:
    """Refuse a schema with less than ``minimum`` of the previous columns."""
    row = schema_diff(old, new).first()
    before = row["n_shared"] + row["n_only_a"]
    after = row["n_shared"] + row["n_only_b"]
    if before and after < minimum * before:
        raise QualityError(f"schema shrank from {before} to {after} features")


def assert_same_order(saved: DataFrame, current: DataFrame) -> None:
    """Names and positions of two (feature, ordinal) schemas must agree."""
    theirs = current.select("feature", F.col("ordinal").alias("other"))
    odd = saved.join(theirs, "feature", "full").filter(~F.col("ordinal").eqNullSafe(F.col("other")))
    bad = odd.count()
    if bad:
        raise QualityError(f"{bad} features differ in name or position")


def assert_unique_ids(df: DataFrame, key: str = "entity_id") -> None:
    """Ids must be non-null, whole numbers, and unique."""
    as_long = F.col(key).cast("string").try_cast("bigint")
    row = (
        df.groupBy(as_long.alias("k"))
        .agg(F.count(F.lit(1)).alias("n"))
        .agg(
            F.sum(F.when(F.col("k").isNull(), F.col("n"))).alias("bad"),
            F.count_if(F.col("k").isNotNull() & (F.col("n") > 1)).alias("repeated"),
        )
        .first()
    )
    if row["bad"] or row["repeated"]:
        raise QualityError(f"{row['bad'] or 0} unusable and {row['repeated']} repeated ids")


def assert_parity(labels: DataFrame, features: DataFrame, allow_extra: bool = False) -> None:
    """Labels and features must hold the same entities."""
    row = id_parity(labels, features).first()
    if row["missing_in_features"] or (row["extra_in_features"] and not allow_extra):
        raise QualityError(
            f"{row['missing_in_features']} labelled entities have no features, "
            f"{row['extra_in_features']} have no label"
        )


def require_columns(df: DataFrame, columns: Sequence[str], what: str = "table") -> DataFrame:
    """Raise when a column is absent; names are compared as they are."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise QualityError(f"{what} lacks columns {missing}")
    return df
