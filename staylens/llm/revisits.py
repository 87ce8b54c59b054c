"""Not-modified revisit records resolved to the response they stand for.

A revisit carries no body.  An as-of join by canonical URL finds the latest earlier full
response; its validators must agree (entity tags, or modification times where neither
side has a tag); then the headers that a not-modified answer may update replace the
response's.

The join is two windows over one union: captures of a URL are cut into time cells, the
last response of every cell is carried to the later cells, and within a cell the last
response before a revisit wins.  A URL with a great share of all captures is thereby
spread over up to CELLS tasks.

Cases: a NULL URL or time, or no earlier response, leaves a revisit ``unresolved``; of
responses at one time the largest record id is the latest; a response at the revisit's own
time is not earlier; NULL headers are none; repeated rows are each resolved; an empty table
gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 1024  # time cells a URL's captures are spread over

# Query parameters that do not change the page, and the headers that a
# not-modified answer may update.
TRACKING = r"^(utm_[^=]*|ref|fbclid|gclid|sessionid)(=|$)"
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "vary")


def canonical(url: Column) -> Column:
    """Host and path without scheme, default port, www. or m., fragment, tracking
    parameters, closing slash and case of the host; parameters in order."""
    bare = F.regexp_replace(url, r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    address = F.substring_index(bare, "?", 1)
    host = F.regexp_replace(
        F.lower(F.regexp_extract(address, r"^[^/]*", 0)), r"^(www\.|m\.)|:(80|443)$", ""
    )
    path = F.regexp_replace(F.regexp_extract(address, r"/.*$", 0), r"(/index\.html?)?/*$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.array_sort(
        F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    )
    return F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""))


def with_cells(events: DataFrame) -> DataFrame:
    """Add ``cell``: which of ``CELLS`` slices of about equally many captures a time is in.

    The slices are cut at quantiles, so stray times do not widen them; a URL with most of
    the captures has at most as many in a slice as all URLs have.
    """
    timed = events.withColumn("__at", F.col("at").cast("double"))  # keeps the order of times
    wanted = [i / CELLS for i in range(1, CELLS)]
    edges = sorted(set(timed.approxQuantile("__at", wanted, 1 / (4 * CELLS)))) or [0.0]
    cut = Bucketizer(
        splits=[-math.inf, *edges, math.inf], inputCol="__at", outputCol="cell", handleInvalid="keep"
    )
    return cut.transform(timed).withColumn("cell", F.col("cell").cast("int")).drop("__at")


def resolve(captures: DataFrame) -> DataFrame:
    """Resolve the revisits among ``captures`` (record_id long, kind 'response' or 'revisit',
    url, at long, etag, last_modified, headers map).

    Returns one row per revisit: record_id, canonical_url, at, response_id, response_at,
    status and headers.  ``status`` is etag, last_modified, mismatch or unresolved; headers
    are merged only where validators agree.
    """
    own = F.struct("record_id", "at", "etag", "last_modified", "headers")
    named = captures.select("record_id", "kind", "url", "at", "etag", "last_modified", "headers")
    events = with_cells(named).select(
        "record_id", canonical(F.col("url")).alias("key"), "at", "etag", "last_modified",
        F.coalesce("headers", F.lit(None).cast("map<string,string>"), F.create_map().cast("map<string,string>")).alias("headers"),
        (F.col("kind") == "response").alias("full"), "cell",
    )
    joinable = F.col("key").isNotNull() & F.col("at").isNotNull()
    dated = events.where(joinable)

    last = dated.where("full").groupBy("key", "cell").agg(
        F.max_by(own, F.struct("at", "record_id")).alias("last")
    )
    # At most CELLS rows a key; a cell with revisits only takes part to be reached.
    cells = dated.select("key", "cell").distinct().join(last, ["key", "cell"], "left")
    before = Window.partitionBy("key").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = cells.select(
        "key", "cell", F.last("last", ignorenulls=True).over(before).alias("carried")
    )
    within = (
        Window.partitionBy("key", "cell").orderBy("at", "full", "record_id")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    found = (
        dated.withColumn(
            "earlier", F.last(F.when(F.col("full"), own), ignorenulls=True).over(within)
        )
        .where("not full").join(carried, ["key", "cell"])
        .withColumn("response", F.coalesce("earlier", "carried"))
        .drop("earlier", "carried")
    )
    lost = events.where(~joinable & ~F.col("full")).withColumn(
        "response", F.lit(None).cast(found.schema["response"].dataType)
    )
    rows = found.unionByName(lost.select(*found.columns))

    def tag(c: str) -> Column:
        return F.regexp_replace(c, "^W/", "")

    no_tags = F.col("etag").isNull() & F.col("response.etag").isNull()
    status = (
        F.when(F.col("response").isNull(), "unresolved")
        .when(tag("etag") == tag("response.etag"), "etag")
        .when(no_tags & (F.col("last_modified") == F.col("response.last_modified")), "last_modified")
        .otherwise("mismatch")
    )
    update = F.map_filter("headers", lambda k, _: F.lower(k).isin(*PERMITTED))
    stays = F.map_filter("response.headers", lambda k, _: ~F.map_contains_key(update, k))
    return rows.withColumn("status", status).select(
        "record_id",
        F.col("key").alias("canonical_url"),
        "at",
        F.col("response.record_id").alias("response_id"),
        F.col("response.at").alias("response_at"),
        "status",
        F.when(F.col("status").isin("etag", "last_modified"), F.map_concat(stays, update)).alias("headers"),
    )


def captures(pages: DataFrame) -> DataFrame:
    """A crawl log over ``pages``: every page as a full response and one revisit of it under
    another spelling of its URL; some revisits come too early, some with a changed tag, some
    with times instead of tags."""
    page = F.col("page_id")
    size = F.length(F.coalesce("html", F.lit(""))).cast("string")
    timed = page % 5 == 2
    etag = F.when(~timed, F.md5(F.coalesce("html", F.lit(""))))
    modified = F.when(timed, page.cast("string"))
    response = pages.select(
        (2 * page).alias("record_id"), F.lit("response").alias("kind"), "url",
        (10 * page).alias("at"), etag.alias("etag"), modified.alias("last_modified"),
        F.create_map(
            F.lit("content-type"), F.lit("text/html"), F.lit("content-length"), size,
            F.lit("date"), (10 * page).cast("string"),
        ).alias("headers"),
    )
    revisit = pages.select(
        (2 * page + 1).alias("record_id"), F.lit("revisit").alias("kind"),
        F.concat("url", F.when(page % 2 == 0, "#seen").otherwise("")).alias("url"),
        (10 * page + F.when(page % 7 == 0, -4).otherwise(page % 1000)).alias("at"),
        F.when(page % 11 == 0, F.lit("changed")).otherwise(F.concat(F.lit("W/"), etag)).alias("etag"),
        modified.alias("last_modified"),
        F.create_map(
            F.lit("date"), (10 * page + 5).cast("string"), F.lit("content-length"), F.lit("0"),
            F.lit("expires"), F.lit("never"),
        ).alias("headers"),
    )
    return response.unionByName(revisit)
