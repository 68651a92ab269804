"""When listings were last listed and updated, from their histories' events as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions.dates import is_listing, is_reset


def recency_of(events: DataFrame, keys: list[str], order: list[str], today: Column) -> DataFrame:
    """``keys``, listed, updated, days: what ``dates.recency`` folds out of a group's ordered events.

    ``events`` has a date and an event's text beside ``keys`` and ``order`` (after the date). A group's last life counts:
    it begins with the last listing behind the last reset, and ends with its last event. Each of the three is a maximum of
    places, so tasks pre-aggregate: a group's events are never put together, in an array, a window or a task. Events
    without a date are left out; a group whose last life has ended, or never began, has nulls.
    """
    at = F.struct("date", *order)
    reset = F.coalesce(is_reset(F.col("event")), F.lit(False))
    listing = F.coalesce(is_listing(F.col("event")), F.lit(False)) & ~reset
    ends = events.filter("date IS NOT NULL").groupBy(*keys).agg(F.max(F.when(reset, at)).alias("reset"), F.max(F.when(listing, at)).alias("begun"), F.max(F.when(~reset, at)).alias("last"))
    alive = F.col("begun").isNotNull() & (F.col("reset").isNull() | (F.col("begun") > F.col("reset")))
    listed, days = F.when(alive, F.col("begun.date")), F.datediff(today, F.col("begun.date"))
    return ends.select(*keys, listed.alias("listed"), F.when(alive, F.col("last.date")).alias("updated"), F.when(alive & (days >= 0), days.cast("long")).alias("days"))
