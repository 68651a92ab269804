"""Options and small documents."""

import datetime as dt
import json
import os

import pytest

from terrasift import spec as S
from terrasift.sources.profile import DocumentCache, cache_key, load_profile


def test_bed_ranges_and_labels():
    assert [(r.label, r.low, r.high) for r in S.parse_bed_ranges(["2,3+", "2-4", "2"])] == [("2", 2, 2), ("3plus", 3, 0), ("2to4", 2, 4)]
    assert [S.bed_label(*x) for x in ((0, 0), (0, 4), (2, 2), (3, 0), (2, 4))] == ["any", "upto4", "2", "3plus", "2to4"]
    for bad in ("0", "4-2", "x", "-", "2-", "+", "2+3"):
        with pytest.raises(S.OptionError):
            S.parse_bed_range(bad)


def test_route_matrix():
    routes = S.route_matrix(S.SearchFilters(), ["2", "3+"], ["days", "mostrecentchange:2"], ["condo"], 3, supplemental=True, keywords=["Den", "den", "office"])
    assert [r.name for r in routes] == [
        "beds-2-sort-days", "beds-2-sort-mostrecentchange", "beds-3plus-sort-days", "beds-3plus-sort-mostrecentchange",
        "beds-2-supplemental-unindexed-laundry", "beds-3plus-supplemental-unindexed-laundry", "exact-2-keyword-1", "exact-2-keyword-2",
    ]
    with pytest.raises(S.OptionError):
        S.route_matrix(S.SearchFilters(), [str(i) for i in range(1, 10)], ["a", "b"], [], 1)
    with pytest.raises(S.OptionError):
        S.route_matrix(S.SearchFilters(), [], ["days:4"], [], 3)


@pytest.mark.parametrize(
    "make",
    [
        lambda: S.SearchFilters(min_price=5, max_price=4), lambda: S.SearchFilters(min_beds=float("nan")), lambda: S.SearchFilters(home_types=("condo", "condo")),
        lambda: S.DetailFilters(laundry="x"), lambda: S.DetailFilters(unknown_laundry="watchlist"), lambda: S.DetailFilters(max_days=-2),
        lambda: S.DetailFilters(available_from=dt.date(2026, 2, 1), available_by=dt.date(2026, 1, 1)), lambda: S.SearchSpec(limit=-1), lambda: S.parse_sort("cheap"),
        lambda: S.parse_locations(["a,,b"]), lambda: S.parse_city_aliases(["a="]), lambda: S.parse_page_overrides(["a=1", "a=2"], 3), lambda: S.parse_date("2026-13-01"), lambda: S.parse_flex(["attic"]),
    ],
)
def test_refused(make):
    with pytest.raises(S.OptionError):
        make()


def test_lists():
    assert S.parse_locations(["a, b", "a"]) == ["a", "b"]
    assert S.parse_cities(["St. Paul,st paul"]) == {"st paul"}
    assert S.parse_city_aliases(["Eastside WA=Bellevue", "eastside wa=bellevue"]) == {"eastside wa": ["bellevue"]}
    assert S.parse_page_overrides(["a=2"], 3) == {"a": 2}
    assert S.parse_date("") is None and S.parse_date("2026-01-02") == dt.date(2026, 1, 2)


PROFILE = {"version": 1, "endpoint": "https://h/p", "method": "PUT", "referer": "https://h/r", "searchQueryState": {"filterState": {"price": {"max": 9}}}, "wants": {"cat1": ["listResults"]}}


def test_profile():
    p = load_profile(json.dumps(PROFILE)).with_filters(S.SearchFilters(min_price=3, home_types=("condo",), page=2, sort="days"))
    own = p.search_query_state["filterState"]
    assert own["price"] == {"min": 3, "max": 9} and own["isCondo"] == {"value": True} and own["isApartment"] == {"value": False}
    assert p.search_query_state["pagination"] == {"currentPage": 2}
    for bad in (PROFILE | {"more": 1}, PROFILE | {"version": 2}, PROFILE | {"wants": {"cat1": ["x"]}}, PROFILE | {"searchQueryState": 1}):
        with pytest.raises(S.OptionError):
            load_profile(json.dumps(bad))
    with pytest.raises(S.OptionError):
        load_profile(json.dumps(PROFILE)).with_filters(S.SearchFilters(min_price=10))


def test_cache(tmp_path):
    cache = DocumentCache(str(tmp_path / "c"), ttl=60)
    cache.save("k", {"a": 1}, now=1000)
    assert cache.load("k", now=1030) == {"a": 1} and cache.load("k", now=1061) is None and cache.load("k", now=600) is None and cache.load("other", now=1000) is None
    os.chmod(cache.path("k"), 0o644)
    assert cache.load("k", now=1030) is None
    assert cache_key(a=1, b=[2]) == cache_key(b=[2], a=1) != cache_key(a=2, b=[2])
