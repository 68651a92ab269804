"""What is searched for: options, validated as they are made."""

from __future__ import annotations

import datetime as dt
import math
import re
from dataclasses import dataclass, field, replace

from terrasift.functions.classify import FLEX_SPACES, HOME_TYPES

# Choices of the options, and bounds.
SORTS = ["recommended", "price-asc", "price-desc", "newest", "beds-desc", "sqft-desc"]
LAUNDRY = ["any", "in-unit", "hookups", "shared", "none", "unknown"]
PARKING = ["any", "available", "garage", "private-garage", "none", "unknown"]
PETS = ["any", "allowed", "dogs", "cats", "none", "unknown"]
POLICY = ["", "exclude", "watchlist"]
FLEX = [*FLEX_SPACES, "private-garage"]
MAX_LOCATIONS, MAX_ROUTES, MAX_PAGES = 64, 16, 20


class OptionError(ValueError):
    """An option that can't be."""


def need(test: bool, message: str) -> None:
    if not test:
        raise OptionError(message)


def choice(value: str, choices: list[str], name: str) -> str:
    value = value.strip().lower()
    need(value in choices, f"unknown {name} value {value!r} (want one of {', '.join(c for c in choices if c)})")
    return value


def parse_list(values: list[str], name: str, normalize=str.strip, most: int | None = None) -> list[str]:
    """Comma-separated values: none may be empty, the first of equal ones stays."""
    found = [normalize(part) for value in values for part in value.split(",")]
    need(all(found), f"{name} must not be empty")
    found = list(dict.fromkeys(found))
    need(most is None or len(found) <= most, f"{name}: at most {most}")
    return found


def parse_sort(value: str) -> str:
    return choice(value or "recommended", SORTS, "sort-by")


def parse_date(value: str) -> dt.date | None:
    if not value.strip():
        return None
    need(bool(re.fullmatch(r"\d{4}-\d{2}-\d{2}", value.strip())), f"invalid date {value!r} (want YYYY-MM-DD)")
    try:
        return dt.date.fromisoformat(value.strip())
    except ValueError:
        raise OptionError(f"invalid date {value!r}") from None


def parse_locations(values: list[str]) -> list[str]:
    return parse_list(values, "location", most=MAX_LOCATIONS)


def parse_flex(values: list[str]) -> list[str]:
    found = parse_list(values, "flex", lambda x: x.strip().lower()) if values else []
    return [choice(x, FLEX, "flex") for x in found]


def parse_home_types(values: list[str]) -> list[str]:
    found = parse_list(values, "home-type", lambda x: x.strip().lower()) if values else []
    return [choice(x, list(HOME_TYPES), "home-type") for x in found]


def parse_keywords(values: list[str]) -> list[str]:
    """Keyword routes: at most 256 bytes, no control characters, unique without regard to case."""
    found: dict[str, str] = {}
    for value in (v.strip() for v in values):
        need(bool(value), "keyword must not be empty")
        need(len(value.encode()) <= 256, "keyword exceeds 256 bytes")
        need(value.isprintable(), "keyword contains a control character")
        found.setdefault(value.lower(), value)
    return list(found.values())


def city_name(value: str) -> str:
    return " ".join(re.sub(r"[\W_]+", " ", value).lower().split())


def parse_cities(values: list[str]) -> set[str]:
    return set(parse_list(values, "allowed city", city_name)) if values else set()


def parse_city_aliases(values: list[str]) -> dict[str, list[str]]:
    found: dict[str, list[str]] = {}
    for value in values:
        query, _, city = value.rpartition("=")
        query, city = query.strip().lower(), city_name(city)
        need(bool(query and city), f"invalid city alias {value!r} (want QUERY=CITY)")
        if city not in found.setdefault(query, []):
            found[query].append(city)
    return found


def parse_page_overrides(values: list[str], most: int) -> dict[str, int]:
    found: dict[str, int] = {}
    for value in values:
        location, _, pages = value.rpartition("=")
        location = location.strip()
        need(bool(location) and pages.strip().isdigit(), f"invalid page override {value!r} (want LOCATION=PAGES)")
        need(1 <= int(pages) <= most, f"pages must be between 1 and {most}")
        need(location not in found, f"duplicate page override for {location!r}")
        found[location] = int(pages)
    return found


@dataclass(frozen=True)
class SearchFilters:
    """Bounds of the basic filter; 0 means none."""

    min_price: int = 0
    max_price: int = 0
    min_beds: float = 0
    max_beds: float = 0
    min_baths: float = 0
    home_types: tuple[str, ...] = ()
    sort: str = ""
    keywords: str = ""
    in_unit_laundry: bool = False
    entire_place_only: bool = False
    page: int = 0

    def __post_init__(self) -> None:
        for name in ("min_price", "max_price", "min_beds", "max_beds", "min_baths", "page"):
            value = getattr(self, name)
            need(math.isfinite(value) and value >= 0, f"{name} must be finite and not negative")
        need(not (self.max_price and self.min_price > self.max_price), "minimum price must not exceed maximum price")
        need(not (self.max_beds and self.min_beds > self.max_beds), "minimum beds must not exceed maximum beds")
        need(len(set(self.home_types)) == len(self.home_types), "home types must not repeat")
        need(all(t in HOME_TYPES for t in self.home_types), "unknown home type")
        need(self.keywords.isprintable(), "keywords contain a control character")


@dataclass(frozen=True)
class DetailFilters:
    """Bounds of the advanced filter."""

    enrich: bool = False
    verify_recency: bool = False
    min_sqft: int = 0
    max_days: int = -1
    available_from: dt.date | None = None
    available_by: dt.date | None = None
    unknown_availability: str = "exclude"
    out_of_window_availability: str = "exclude"
    max_total_cost: int = 0
    require_for_rent: bool = False
    exclude_shared: bool = False
    exclude_student: bool = False
    exclude_income_restricted: bool = False
    laundry: str = "any"
    parking: str = "any"
    pets: str = "any"
    flex: tuple[str, ...] = ()
    unknown_laundry: str = "exclude"

    def __post_init__(self) -> None:
        need(self.min_sqft >= 0, "min-sqft must not be negative")
        need(self.max_days >= -1, "max-days must be -1 or non-negative")
        need(not (self.available_from and self.available_by and self.available_from > self.available_by), "available-from must not be after available-by")
        need(self.max_total_cost >= 0, "max-total-cost must not be negative")
        for name, choices in (("laundry", LAUNDRY), ("parking", PARKING), ("pets", PETS), ("unknown_availability", POLICY), ("out_of_window_availability", POLICY), ("unknown_laundry", POLICY[1:])):
            need(getattr(self, name) in choices, f"unknown {name} value {getattr(self, name)!r}")
        need(not (self.unknown_laundry == "watchlist" and self.laundry == "any"), "unknown-laundry=watchlist requires a laundry filter")
        need(all(x in FLEX for x in self.flex), "unknown flex value")

    @property
    def needs_amenities(self) -> bool:
        return bool(
            self.max_total_cost or self.laundry != "any" or self.parking != "any" or self.pets != "any" or self.flex
            or self.require_for_rent or self.exclude_shared or self.exclude_student or self.exclude_income_restricted
        )

    @property
    def needs_details(self) -> bool:
        return self.enrich or self.verify_recency or self.needs_amenities

    @property
    def is_advanced(self) -> bool:
        return bool(self.min_sqft or self.max_days >= 0 or self.available_from or self.available_by or self.needs_amenities)


@dataclass(frozen=True)
class Boundary:
    """Where listings may lie."""

    strict: bool = False
    allowed_cities: frozenset[str] = frozenset()
    city_aliases: dict[str, list[str]] = field(default_factory=dict)


@dataclass(frozen=True)
class Route:
    """One way to page through a location's results."""

    name: str
    filters: SearchFilters = SearchFilters()
    max_pages: int = 0


@dataclass(frozen=True)
class BedRange:
    label: str
    low: float = 0
    high: float = 0


def number(value: float) -> str:
    return f"{value:g}"


def bed_label(low: float, high: float) -> str:
    if low and high:
        return number(low) if low == high else f"{number(low)}to{number(high)}"
    return f"{number(low)}plus" if low else f"upto{number(high)}" if high else "any"


def parse_bed_range(value: str) -> BedRange:
    """``2``, ``3+`` or ``2-4``."""
    found = re.fullmatch(r"(\d+(?:\.\d+)?)(\+|-(\d+(?:\.\d+)?))?", value.strip())
    need(bool(found), f"invalid range {value!r}")
    low = float(found[1])
    high = 0.0 if found[2] == "+" else float(found[3]) if found[3] else low
    need(low > 0 and (found[2] == "+" or high >= low), f"invalid range {value!r}")
    return BedRange(bed_label(low, high), low, high)


def parse_bed_ranges(values: list[str], low: float = 0, high: float = 0) -> list[BedRange]:
    if not values:
        return [BedRange(bed_label(low, high), low, high)]
    return list({r.label: r for r in reversed([parse_bed_range(v) for v in parse_list(values, "bed-range")])}.values())[::-1]


def parse_server_sorts(values: list[str], fallback: str = "") -> list[tuple[str, int]]:
    """``sort`` or ``sort:pages``; repeated ones once."""
    found: dict[tuple[str, int], None] = {}
    for value in parse_list(values, "server-sort") if values else [fallback]:
        name, _, pages = value.partition(":")
        need(not pages or (pages.isdigit() and 1 <= int(pages) <= MAX_PAGES), f"invalid page limit in {value!r}")
        need(bool(re.fullmatch(r"[A-Za-z0-9_-]*", name)), f"invalid sort {name!r}")
        found[name, int(pages or 0)] = None
    return list(found)


def route_matrix(
    base: SearchFilters, bed_ranges: list[str], sorts: list[str], home_types: list[str], max_pages: int = 1, *,
    in_unit_laundry: bool = False, for_rent: bool = False, supplemental: bool = False, supplemental_pages: int = 1, keywords: list[str] = (),
) -> list[Route]:
    """Bed ranges times sorts, then supplemental routes without the laundry filter, then one for each keyword."""
    need(1 <= max_pages <= MAX_PAGES, f"max-pages must be between 1 and {MAX_PAGES}")
    need(1 <= supplemental_pages <= max_pages, f"supplemental-pages must be between 1 and max-pages {max_pages}")
    types = tuple(parse_home_types(list(home_types)))
    common = replace(base, page=0, home_types=types, entire_place_only=for_rent)
    beds = parse_bed_ranges(list(bed_ranges), base.min_beds, base.max_beds)
    routes = []
    for r in beds:
        for name, pages in parse_server_sorts(list(sorts), base.sort):
            need(pages <= max_pages, f"server-sort {name!r} page limit {pages} exceeds max-pages {max_pages}")
            filters = replace(common, min_beds=r.low, max_beds=r.high, sort=name, in_unit_laundry=in_unit_laundry)
            routes.append(Route(f"beds-{r.label}-sort-{name or 'default'}", filters, pages))
    plain = replace(common, sort="days", keywords="", in_unit_laundry=False)
    if supplemental:
        routes += [Route(f"beds-{r.label}-supplemental-unindexed-laundry", replace(plain, min_beds=r.low, max_beds=r.high), supplemental_pages) for r in beds]
    routes += [Route(f"exact-2-keyword-{i}", replace(plain, min_beds=2, max_beds=2, keywords=k), supplemental_pages) for i, k in enumerate(parse_keywords(list(keywords)), 1)]
    need(len(routes) <= MAX_ROUTES, f"route matrix exceeds {MAX_ROUTES} combinations")
    need(len({r.name for r in routes}) == len(routes), "route names must not repeat")
    return routes


@dataclass(frozen=True)
class SearchSpec:
    """A whole search."""

    filters: SearchFilters = SearchFilters()
    details: DetailFilters = DetailFilters()
    boundary: Boundary = Boundary()
    routes: tuple[Route, ...] = ()
    sort_by: str = "recommended"
    limit: int = 0
    discovered: bool = False

    def __post_init__(self) -> None:
        need(self.limit >= 0, "limit must not be negative")
        parse_sort(self.sort_by)
