"""How much of each route was fetched, and what went wrong."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.operators.dedup import first_wins, listing_key
from terrasift.spec import Route


def route_table(spark: SparkSession, routes: list[Route], max_pages: int) -> DataFrame:
    """route, route_ord, min_beds, max_beds, max_pages."""
    rows = [(r.name, i, float(r.filters.min_beds), float(r.filters.max_beds), r.max_pages or max_pages) for i, r in enumerate(routes)]
    return spark.createDataFrame(rows, "route string, route_ord int, min_beds double, max_beds double, max_pages int")


def page_override(routes: DataFrame, overrides: DataFrame) -> DataFrame:
    """Routes of each location, their pages clamped to the location's limit if it has one."""
    pages = F.least("max_pages", F.coalesce("pages", "max_pages"))
    return routes.join(F.broadcast(overrides), "location", "left").withColumn("max_pages", pages).drop("pages")


def coverage(pages: DataFrame, items: DataFrame) -> DataFrame:
    """Per route: pages fetched, last totals, distinct listings, and whether it is complete.

    ``pages`` has route, page, total_pages, total_results, n_items; ``items`` has route, page, ord and a listing's
    identity. A route is complete with its reported last page, an empty page, or, if no total is known, a page with
    nothing new.
    """
    key = F.coalesce(listing_key(), F.concat_ws(":", "route", "page", "ord"))
    first = items.select("route", "page", key.alias("key")).groupBy("route", "key").agg(F.min("page").alias("page"))
    new = first.groupBy("route", "page").agg(F.count(F.lit(1)).alias("new"))
    seen = pages.join(new, ["route", "page"], "left").withColumn("new", F.coalesce("new", F.lit(0)))
    known = F.coalesce(F.col("total_pages"), F.lit(0))
    done = ((known > 0) & (F.col("page") >= known)) | (F.col("n_items") == 0) | ((F.col("new") == 0) & (known <= 0))
    return seen.groupBy("route").agg(
        F.count_distinct("page").alias("pagesFetched"), F.max_by("total_pages", "page").alias("totalPages"),
        F.max_by("total_results", "page").alias("totalResults"), F.sum("new").alias("uniqueListings"), F.bool_or(done).alias("complete"),
    )


def discovered(items: DataFrame) -> DataFrame:
    """Listings of all routes and pages, each once: the first by route, page and place."""
    return first_wins(items, [], listing_key(), ["route_ord", "page", "ord"])


def issues(rows: DataFrame) -> DataFrame:
    """Per location: how many pages failed, and the first failure."""
    return rows.groupBy("location").agg(F.count(F.lit(1)).alias("issues"), F.min_by("error", F.struct("route_ord", "page")).alias("firstIssue"))


def plan_estimate(routes: DataFrame, page_delay: dt.timedelta, location_delay: dt.timedelta) -> DataFrame:
    """One row: requests (pages and one bootstrap a location) and seconds of pacing between them."""
    each = routes.groupBy("location").agg(F.sum("max_pages").alias("pages"))
    waits = F.sum(F.greatest(F.col("pages") - 1, F.lit(0))) * page_delay.total_seconds()
    between = F.greatest(F.count(F.lit(1)) - 1, F.lit(0)) * location_delay.total_seconds()
    return each.agg((F.sum("pages") + F.count(F.lit(1))).alias("requests"), (waits + between).alias("pacing_seconds"))
