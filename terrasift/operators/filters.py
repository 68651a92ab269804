"""Filters on listings; unknown values fail, pass, or put a listing on the watchlist, as each rule says."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions import classify as C
from terrasift.functions import text as X
from terrasift.functions.dates import availability_date
from terrasift.spec import Boundary, DetailFilters, Route, SearchFilters


def every(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def holds(test: Column) -> Column:
    """Unknown is false."""
    return F.coalesce(test, F.lit(False))


def unless_known(test: Column) -> Column:
    """Unknown is true."""
    return F.coalesce(test, F.lit(True))


def basic(filters: SearchFilters, allow_unknown_home_type: bool) -> Column:
    """Price, beds, baths and home type. A building's unknown price passes, and its beds and baths aren't looked at."""
    building = holds(F.col("isBuilding"))
    tests = []
    if filters.min_price:
        tests.append(F.coalesce(F.col("price") >= filters.min_price, building))
    if filters.max_price:
        tests.append(F.coalesce(F.col("price") <= filters.max_price, building))
    if filters.min_beds:
        tests.append(building | holds(F.col("bedrooms") >= filters.min_beds))
    if filters.max_beds:
        tests.append(building | holds(F.col("bedrooms") <= filters.max_beds))
    if filters.min_baths:
        tests.append(building | holds(F.col("bathrooms") >= filters.min_baths))
    if filters.home_types:
        blank = holds(X.trim_ws(F.col("homeType")) == "") if allow_unknown_home_type else F.lit(False)
        tests.append(blank | C.home_type_matches(F.col("homeType"), list(filters.home_types)))
    return every(tests)


def snapshot_filter(filters: SearchFilters) -> Column:
    return basic(filters, allow_unknown_home_type=False)


def discovered_filter(filters: SearchFilters) -> Column:
    return basic(filters, allow_unknown_home_type=True)


def bed_ranges(routes: list[Route], allow_unknown: bool) -> Column:
    """Whether a route's range fits; buildings always pass, and unknown bedrooms may."""
    if not routes:
        return F.lit(True)
    beds = F.col("bedrooms")

    def fits(route: Route) -> Column:
        low, high = route.filters.min_beds, route.filters.max_beds
        if not low and not high:
            return F.lit(True)
        return holds(beds.isNotNull() & ((beds >= low) if low else F.lit(True)) & ((beds <= high) if high else F.lit(True)))

    unknown = beds.isNull() if allow_unknown else F.lit(False)
    return holds(F.col("isBuilding")) | unknown | X.any_of([fits(r) for r in routes])


def in_state(state: Column) -> Column:
    return F.upper(X.trim_ws(F.col("address.state"))) == F.upper(state)


def inside(query: Column, boundary: Boundary, allow_unknown: bool) -> Column:
    """Whether a listing lies where ``query`` and the boundary say; ``allow_unknown`` passes blank cities, states and codes."""
    if not boundary.strict and not boundary.allowed_cities:
        return F.lit(True)
    city, state, code = X.normalize_city(F.col("address.city")), X.trim_ws(F.col("address.state")), X.trim_ws(F.col("address.postalCode"))
    open_ = lambda c: (c == "") if allow_unknown else F.lit(False)
    tests = []
    if boundary.allowed_cities:
        tests.append(open_(city) | city.isin(*sorted(boundary.allowed_cities)))
    asked = X.state_qualifier(query)
    tests.append((asked == "") | open_(state) | (F.upper(state) == asked))
    if boundary.strict:
        zip_, own = X.postal_code(query), X.query_city(query)
        told = F.lower(X.trim_ws(query))
        by_alias = [(told == q) & city.isin(*cities) for q, cities in boundary.city_aliases.items()]
        aliased = X.any_of([told == q for q in boundary.city_aliases])
        fits = F.when((own == "") & ~aliased, True).otherwise(open_(city) | ((own != "") & (city == own)) | X.any_of(by_alias))
        tests.append(F.when(zip_.isNotNull(), open_(code) | (code == zip_)).otherwise(fits))
    return holds(every(tests))


def known_violations(options: DetailFilters, today: Column) -> Column:
    """Passes what isn't known to fail: before details are looked up. Buildings stand for units, so they pass."""
    tests = []
    if options.min_sqft:
        tests.append(F.col("livingArea") >= options.min_sqft)
    if options.max_days >= 0 and not options.verify_recency:
        tests.append(F.col("daysListed") <= options.max_days)
    if options.out_of_window_availability == "exclude":
        date = availability_date(F.col("availability"), today)
        tests += [date >= F.lit(options.available_from)] if options.available_from else []
        tests += [date <= F.lit(options.available_by)] if options.available_by else []
    if options.max_total_cost:
        tests.append(F.col("totalMonthlyCost") <= options.max_total_cost)
    if options.require_for_rent:
        tests.append((X.trim_ws(F.col("status")) == "") | C.is_for_rent(F.col("status")))
    tests += [~F.col(name) for on, name in _exclusions(options) if on]
    return holds(F.col("isBuilding")) | every([unless_known(t) for t in tests])


def _exclusions(options: DetailFilters) -> list[tuple[bool, str]]:
    return [
        (options.exclude_shared, "sharedHousing"), (options.exclude_student, "studentHousing"),
        (options.exclude_income_restricted, "incomeRestricted"),
    ]


def told(name: str) -> Column:
    """A choice in lower case; unknown if there is none."""
    return F.coalesce(F.nullif(F.lower(X.trim_ws(F.col(name))), F.lit("")), F.lit(C.UNKNOWN))


def parking_matches(wanted: str) -> Column:
    wider = {"available": ["available", "garage", "private-garage"], "garage": ["garage", "private-garage"]}
    return F.lit(True) if wanted == "any" else told("parking").isin(*wider.get(wanted, [wanted]))


def pets_match(wanted: str) -> Column:
    policy = told("petPolicy")
    lenient = policy.isin("allowed", "restricted")
    said = F.lower(F.array_join(F.coalesce("allowedPets", F.array().cast("array<string>")), " "))
    rules = {
        "any": F.lit(True), "allowed": lenient, "none": policy == "not-allowed", "unknown": policy == C.UNKNOWN,
        "dogs": lenient & X.contains_any(said, "dog", "pets allowed", "all pets"),
        "cats": lenient & X.contains_any(said, "cat", "pets allowed", "all pets"),
    }
    return rules[wanted]


def garage_only() -> Column:
    """Two bedrooms, and a private garage as the only flex space."""
    flex = F.transform(F.coalesce("flexSpaces", F.array().cast("array<string>")), lambda x: F.lower(X.trim_ws(x)))
    return holds(F.col("bedrooms") == 2) & F.array_contains(flex, "private-garage") & ~F.arrays_overlap(flex, F.array(*map(F.lit, C.FLEX_SPACES)))


def advanced(rows: DataFrame, options: DetailFilters, today: Column) -> DataFrame:
    """Keeps listings that match or may match; the latter are on the watchlist, with reasons in the order of the rules.

    Without an advanced option rows pass as they are.
    """
    if not options.is_advanced:
        return rows
    keep: list[Column] = [~holds(F.col(name)) for on, name in _exclusions(options) if on]
    watch: list[tuple[Column, str]] = []
    if options.min_sqft:
        keep.append(holds(F.col("livingArea") >= options.min_sqft))
    if options.available_from or options.available_by:
        date = availability_date(F.col("availability"), today)
        early = date < F.lit(options.available_from) if options.available_from else F.lit(False)
        late = date > F.lit(options.available_by) if options.available_by else F.lit(False)
        for policy, test, reason in (
            (options.unknown_availability, date.isNull(), "availability needs verification"),
            (options.out_of_window_availability, holds(early | late), "availability is outside the target window"),
        ):
            if policy == "watchlist":
                watch.append((test, reason))
            else:
                keep.append(~test)
    if options.max_total_cost:
        keep.append(unless_known(F.col("totalMonthlyCost") <= options.max_total_cost))
        watch.append((F.col("totalMonthlyCost").isNull(), "total monthly cost needs verification"))
    if options.require_for_rent:
        blank = F.coalesce(X.trim_ws(F.col("status")), F.lit("")) == ""
        keep.append(blank | C.is_for_rent(F.col("status")))
        watch.append((blank, "current rental status needs verification"))
    if options.laundry != "any":
        same, unknown = told("laundry") == options.laundry, told("laundry") == C.UNKNOWN
        if options.unknown_laundry == "watchlist":
            keep.append(same | unknown)
            watch.append((unknown & ~same, "laundry details are unknown"))
        else:
            keep.append(same)
    keep += [parking_matches(options.parking), pets_match(options.pets)]
    if options.flex:
        keep.append(X.has_any_value(F.col("flexSpaces"), list(options.flex)))
    watch.append((garage_only(), "private garage flex requires exclusive-use and inclusion verification"))
    reasons = F.array_compact(F.array(*(F.when(test, F.lit(reason)) for test, reason in watch)))
    marked = rows.filter(every(keep)).withColumn("matchReasons", reasons)
    return marked.withColumn("matchStatus", F.when(F.size("matchReasons") > 0, "watchlist").otherwise("match"))


def recent(options: DetailFilters) -> Column:
    return F.lit(True) if options.max_days < 0 else holds(F.col("daysListed") <= options.max_days)


def has_identity() -> Column:
    return X.any_of([F.coalesce(X.trim_ws(F.col(c)), F.lit("")) != "" for c in ("id", "url", "address.full")])
