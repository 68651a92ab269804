"""Dates in listing texts; ``today`` is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrasift.functions.tagged import as_long, as_string
from terrasift.functions.text import canonical_text, contains_any, let, trim_ws

_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:\d{2})$"


def parse_date(c: Column) -> Column:
    """The calendar date as written in one of the accepted layouts, or null."""
    plain = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(c, "yyyy-MM-dd"))
    zoned = F.when(c.rlike(_RFC3339), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))
    timed = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$"), F.try_to_date(F.substring(c, 1, 10), "yyyy-MM-dd"))
    short = F.when(c.rlike(r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"), F.try_to_date(c, "MMM d, yyyy"))
    long = F.when(c.rlike(r"^[A-Z][a-z]+ \d{1,2}, \d{4}$"), F.try_to_date(c, "MMMM d, yyyy"))
    return F.coalesce(plain, zoned, timed, short, long)


def parse_history_date(tag: Column) -> Column:
    """As ``parse_date``, but without the layout that has a time behind a space."""
    text = as_string(tag)
    return F.when(~text.contains(":") | text.rlike(_RFC3339), parse_date(text))


def unix_date(value: Column) -> Column:
    """Seconds, or milliseconds beyond 1e11, as a UTC date; empty for 0 and less."""
    seconds = F.when(value > 100_000_000_000, F.floor(value / 1000)).otherwise(value)
    return F.when(value > 0, F.date_format(F.date_from_unix_date(F.floor(seconds / 86400).cast("int")), "yyyy-MM-dd")).when(value <= 0, "")


def normalized_availability(value: Column) -> Column:
    """A date if the value is one, unix time or text; other text as it is; else empty."""
    return let(value, _availability)


def _availability(tag: Column) -> Column:
    text = trim_ws(tag["text"])
    number = F.when(text.rlike("^[+-]?[0-9]+$"), text.try_cast("long"))
    named = F.coalesce(unix_date(number), F.date_format(parse_date(text), "yyyy-MM-dd"), text)
    return F.coalesce(F.when(tag["kind"] == "string", named).when(tag["kind"] == "number", unix_date(as_long(tag))), F.lit(""))


def availability_date(c: Column, today: Column) -> Column:
    """The date from which a listing can be had: today for words like "now", else a date in the text, else null."""
    text = F.lower(trim_ws(c))
    return F.when(text.isin("available now", "now", "immediately", "immediate"), today).otherwise(parse_date(trim_ws(c)))


def is_reset(event: Column) -> Column:
    """Whether a history event ends a listing's life."""
    return contains_any(event, "listing removed", "removed listing", "off market", "sold", "pending sale")


def is_listing(event: Column) -> Column:
    """Whether a history event begins a listing's life."""
    return contains_any(event, "listed for rent", "listed for rental", "rental listing")


def history_events(history: Column) -> Column:
    """Rental events of a price history (array of maps of tagged scalars), oldest first; equal dates keep their order."""
    tag = lambda item, key: F.try_element_at(item, F.lit(key))

    def event(item: Column, ord_: Column) -> Column:
        return F.struct(
            parse_history_date(tag(item, "date")).alias("date"),
            ord_.alias("ord"),
            canonical_text(as_string(tag(item, "event"))).alias("event"),
            F.coalesce(tag(item, "postingIsRental")["text"].isin("true", "1", "t", "T", "TRUE", "True"), F.lit(False)).alias("rental"),
        )

    dated = F.filter(F.transform(history, event), lambda e: e["date"].isNotNull())
    return F.array_sort(F.filter(dated, lambda e: e["rental"] | e["event"].contains("rent") | is_reset(e["event"])))


def recency(events: Column, today: Column) -> Column:
    """struct<listed, updated, days> by one fold over ordered events.

    A reset clears both dates, "listed for rent" sets both, later events move ``updated``. ``days`` is null for dates to
    come; all three are null if nothing is listed at the end.
    """
    none = F.lit(None).cast("date")
    start = F.struct(none.alias("listed"), none.alias("updated"))

    def step(state: Column, e: Column) -> Column:
        listing = is_listing(e["event"])
        moved = F.when(state["listed"].isNotNull() & (e["date"] > state["updated"]), e["date"]).otherwise(state["updated"])
        both = lambda a, b: F.struct(a.alias("listed"), b.alias("updated"))
        return F.when(is_reset(e["event"]), both(none, none)).when(listing, both(e["date"], e["date"])).otherwise(both(state["listed"], moved))

    def finish(state: Column) -> Column:
        days = F.datediff(today, state["listed"])
        return F.struct(state["listed"].alias("listed"), state["updated"].alias("updated"), F.when(days >= 0, days.cast("long")).alias("days"))

    return F.aggregate(events, start, step, finish)
