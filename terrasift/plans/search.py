"""A whole search as one lazy plan."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.operators import enrich as E
from terrasift.operators import filters as W
from terrasift.operators.history import annotate_history
from terrasift.operators.normalize import page_properties, search_listings
from terrasift.operators.ranking import limit_per, sort_order
from terrasift.sources.records import rental_page, search_snapshot
from terrasift.spec import SearchSpec

#: What tells rows apart and orders them: place in the results, then place among a page's properties.
ROW = ["location", "group", "ord", "detail_ord"]


def snapshot_listings(documents: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(listings, documents) of saved search pages: columns source_id, document, and location if there is one."""
    parsed = documents.select("source_id", search_snapshot(F.col("document")).alias("search"))
    return search_listings(parsed, today)


def page_details(pages: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(details, errors) of saved pages: columns link, document."""
    parsed = pages.select("link", rental_page(F.col("document")).alias("page"))
    properties, told = page_properties(parsed, today, key="link", source_url=F.col("link"))
    errors = told.filter("drift IS NOT NULL").select("link", F.concat_ws(": ", "drift.path", "drift.detail").alias("error"))
    return properties, errors


class SearchPlan:
    """The stages of a search over listings, in their fixed order.

    ``listings`` has location, group, ord and a listing's fields. ``details`` and ``errors`` are what links lead to,
    ``previous`` earlier listings with ``order`` columns. ``today`` is a date.
    """

    def __init__(self, spec: SearchSpec, today: dt.date):
        self.spec, self.today = spec, F.lit(today)

    def basic(self, rows: DataFrame) -> DataFrame:
        spec = self.spec
        fits = W.discovered_filter(spec.filters) if spec.discovered else W.snapshot_filter(spec.filters)
        return rows.filter(fits)

    def ranges(self, rows: DataFrame, allow_unknown: bool) -> DataFrame:
        return rows.filter(W.bed_ranges(list(self.spec.routes), allow_unknown))

    def limited(self, rows: DataFrame) -> DataFrame:
        return limit_per(rows, ["location"], self.spec.sort_by, ROW[1:], self.spec.limit)

    def build(self, listings: DataFrame, details: DataFrame | None = None, errors: DataFrame | None = None, previous: DataFrame | None = None, order: list[str] = ()) -> DataFrame:
        """Basic filter, bed ranges; with details: prefilter or early limit, enrichment and both filters again; then
        boundary, advanced filter, recency backfill and filter, sort, limit, history."""
        spec, options = self.spec, self.spec.details
        rows = listings.withColumn("detail_ord", F.lit(0))
        rows = self.ranges(self.basic(rows), allow_unknown=details is not None)
        rows = rows.filter(W.inside(F.col("location"), spec.boundary, allow_unknown=details is not None))
        if details is not None and options.needs_details:
            if options.needs_amenities:
                rows = rows.filter(W.known_violations(options, self.today))
            elif not options.verify_recency:
                rows = self.limited(rows).drop("rank")
            rows = E.enrich(rows.drop("detail_ord"), details, errors)
            rows = self.ranges(self.basic(rows), allow_unknown=False)
            rows = rows.filter(W.inside(F.col("location"), spec.boundary, allow_unknown=False))
        rows = W.advanced(rows, options, self.today)
        if details is not None and options.verify_recency:
            rows = E.backfill_recency(rows, details, ROW)
        rows = rows.filter(W.recent(options))
        rows = self.limited(rows)
        if previous is not None:
            rows = annotate_history(rows, previous, list(order))
        return rows

    def ordered(self, rows: DataFrame) -> DataFrame:
        return rows.orderBy("location", *sort_order(self.spec.sort_by, ROW[1:]))
