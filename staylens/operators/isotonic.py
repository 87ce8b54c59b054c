"""Isotonic regression as a table of steps, fitted without a sequential pass.

The isotonic fit is the slope of the greatest convex minorant of the cumulative sums: with
distinct scores in order, the points (rows so far, positives so far).  Hulls merge: a point
inside the hull of some neighbouring points is no vertex of the whole hull.  So points are
cut into chunks of neighbours, each chunk keeps its own vertices, and the survivors are
cut anew, with borders moved, until a round over both sets of borders removes nothing.  Then every three
neighbours are convex, and so is the whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from staylens.functions.text import quoted
from staylens.operators.metrics import score_counts
from staylens.operators.ranking import as_of, cumulative_values, running_totals
from staylens.session import settle

CHUNK = 256  # neighbouring points compared with each other
SUPER = 1 << 12  # chunks of a group in the prefix sums


def _vertices(points: str) -> Column:
    """The vertices of the lower hull of an ordered array of (x, s, ...)."""
    every = F.col(points)

    def steepest_left(q: Column, i: Column) -> Column:
        left = F.slice(every, F.lit(1), i)
        return F.array_max(F.transform(left, lambda a: (q["s"] - a["s"]) / (q["x"] - a["x"])))

    def flattest_right(q: Column, i: Column) -> Column:
        right = F.slice(every, i + 2, F.size(every) - i - 1)
        return F.array_min(F.transform(right, lambda a: (a["s"] - q["s"]) / (a["x"] - q["x"])))

    def stays(q: Column, i: Column) -> Column:
        end = (i == 0) | (i == F.size(every) - 1)
        return F.when(end, True).otherwise(steepest_left(q, i) < flattest_right(q, i))

    return F.filter(every, stays)


def _round(points: DataFrame, keys: list[str], shift: int) -> tuple[DataFrame, int, bool]:
    """Points that survive one cut into chunks, how many went, and whether one chunk held all."""
    chunk = F.floor((F.col("at") + shift) / CHUNK).alias("chunk")
    hulls = (
        points.groupBy(*keys, chunk)
        .agg(F.array_sort(F.collect_list(F.struct("x", "s", "rank", "score"))).alias("points"))
        .select(*keys, "chunk", F.size("points").alias("held"), _vertices("points").alias("hull"))
    )
    hulls = settle(hulls.withColumn("one", F.size("hull").cast("long")))
    row = hulls.agg(
        F.sum(F.col("held") - F.col("one")).alias("gone"), F.max("chunk").alias("last")
    ).first()
    counts = hulls.select(*keys, "chunk", "one", F.floor(F.col("chunk") / SUPER).alias("group"))
    before = running_totals(counts, keys, ["group"], ["chunk"], ["one"]).select(
        *keys, "chunk", (F.col("cum_one") - F.col("one")).alias("before")
    )
    # Without keys there may be one chunk left, so the join keeps to its number.
    spread = hulls.join(before, [*keys, "chunk"]).select(
        *keys, "before", F.posexplode("hull").alias("i", "q")
    )
    left = spread.select(*keys, (F.col("before") + F.col("i")).alias("at"), "q.*")
    return settle(left), int(row["gone"] or 0), shift == 0 and row["last"] == 0


def fit_steps(
    valid: DataFrame, p: str = "p_raw", y: str = "y", keys: Sequence[str] = ()
) -> DataFrame:
    """(keys, step, low, high, value, n): the fit is ``value`` from score low to score high.

    Equal scores are one point.  Rows without an outcome or a score that is a number are
    left out; without rows there are no steps.
    """
    keys = list(keys)
    counts = score_counts(valid, y, p, keys).select(
        *keys, "score", (F.col("pos") + F.col("neg")).alias("x"), F.col("pos").alias("s"),
        F.lit(1).cast("long").alias("one"),
    )
    cum = settle(cumulative_values(counts, keys, "score", ["x", "s", "one"]))
    ranked = cum.select(
        *keys, F.col("cum_one").alias("at"), F.col("cum_x").cast("double").alias("x"),
        F.col("cum_s").cast("double").alias("s"), F.col("cum_one").alias("rank"), "score",
    )
    origin = cum.select(*keys).distinct() if keys else cum.limit(1).select()
    origin = origin.select(
        *keys, F.lit(0).cast("long").alias("at"), F.lit(0.0).alias("x"), F.lit(0.0).alias("s"),
        F.lit(0).cast("long").alias("rank"), F.lit(None).cast("double").alias("score"),
    )
    points, quiet, shift = origin.unionByName(ranked), 0, 0
    while quiet < 2:
        points, gone, whole = _round(points, keys, shift)
        if whole:
            break
        quiet = 0 if gone else quiet + 1
        shift = CHUNK // 2 - shift
    before = points.select(
        *keys, (F.col("at") + 1).alias("at"), F.col("x").alias("px"), F.col("s").alias("ps"),
        (F.col("rank") + 1).alias("first"),
    )
    lows = ranked.select(*keys, F.col("rank").alias("first"), F.col("score").alias("low"))
    return settle(
        points.join(before, [*keys, "at"]).join(lows, [*keys, "first"]).select(
            *keys, (F.col("at") - 1).alias("step"), "low", F.col("score").alias("high"),
            ((F.col("s") - F.col("ps")) / (F.col("x") - F.col("px"))).alias("value"),
            (F.col("x") - F.col("px")).cast("long").alias("n"),
        )
    )


def apply_steps(
    df: DataFrame, steps: DataFrame, p: str = "p_raw", name: str = "p", keys: Sequence[str] = ()
) -> DataFrame:
    """Add the calibrated score: constant outside the fitted range, a line between steps.

    Distinct scores meet the steps in an as-of join by ranges and go back to the rows by
    equality.  A score that is no number, or without steps for its keys, gives NULL.
    """
    keys = list(keys)
    following = steps.select(
        *keys, (F.col("step") - 1).alias("step"), F.col("low").alias("next_low"),
        F.col("value").alias("next_value"),
    )
    whole = steps.join(following, [*keys, "step"], "left")
    whole = whole.withColumn("from", F.when(F.col("step") == 0, float("-inf")).otherwise(F.col("low")))
    payload = ["high", "value", "next_low", "next_value"]
    score = F.col(quoted(p)).cast("double")
    scores = df.filter(score.isNotNull() & ~F.isnan(score))
    scores = scores.select(*keys, score.alias("_score")).distinct()
    met = as_of(scores, whole.select(*keys, "from", *payload), keys, "_score", "from", payload)
    part = (F.col("_score") - F.col("high")) / (F.col("next_low") - F.col("high"))
    line = F.col("value") + (F.col("next_value") - F.col("value")) * part
    inside = (F.col("_score") <= F.col("high")) | F.col("next_low").isNull()
    found = settle(met.select(*keys, "_score", F.when(inside, F.col("value")).otherwise(line).alias(name)))
    rows = df.withColumn("_score", score)
    return rows.join(found, [*keys, "_score"], "left").select(
        *[rows[quoted(c)] for c in df.columns], found[quoted(name)]
    )
