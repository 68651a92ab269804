"""Search profiles and caches: small documents that the driver reads."""

from __future__ import annotations

import copy
import hashlib
import json
import os
import tempfile
import time
from dataclasses import dataclass, replace
from pathlib import Path

from terrasift.spec import OptionError, SearchFilters, need

FIELDS = {"version", "endpoint", "method", "referer", "searchQueryState", "wants"}


@dataclass(frozen=True)
class SearchProfile:
    """A search request that can be asked again with other filters."""

    version: int
    endpoint: str
    method: str
    referer: str
    search_query_state: dict
    wants: dict[str, list[str]]

    def __post_init__(self) -> None:
        need(self.version == 1, f"unsupported profile version {self.version}")
        need(self.method == "PUT", "method must be PUT")
        need(self.endpoint.startswith("https://") and "?" not in self.endpoint and "#" not in self.endpoint, "endpoint must be https, without query and fragment")
        need(self.referer.startswith("https://") and "#" not in self.referer, "referer must be https, without fragment")
        for name, group in self.wants.items():
            need(isinstance(group, list) and bool(group) and all(isinstance(x, str) and x.strip() for x in group), f"wants.{name} must list names")
        need("listResults" in self.wants.get("cat1", []), "wants.cat1 must contain listResults")

    def with_filters(self, filters: SearchFilters) -> SearchProfile:
        """The profile with bounds, types, words and page set in its query."""
        state = copy.deepcopy(self.search_query_state)
        own = child(state, "filterState")
        for name, low, high in (("price", filters.min_price, filters.max_price), ("beds", filters.min_beds, filters.max_beds), ("baths", filters.min_baths, 0)):
            if low or high:
                own[name] = {**child(own, name), **({"min": low} if low else {}), **({"max": high} if high else {})}
        if filters.home_types:
            chosen = set(filters.home_types)
            for flag, on in (("isApartment", "apartment" in chosen), ("isCondo", "condo" in chosen), ("isTownhouse", "townhouse" in chosen), ("isSingleFamily", "single-family" in chosen), ("isApartmentOrCondo", bool(chosen & {"apartment", "condo"}))):
                own[flag] = {"value": on}
        for name, value in (("keywords", filters.keywords), ("sortSelection", filters.sort)):
            if value:
                own[name] = {"value": value}
        for name, on in (("onlyRentalInUnitLaundry", filters.in_unit_laundry), ("isEntirePlaceForRent", filters.entire_place_only)):
            if on:
                own[name] = {"value": True}
        for name in ("price", "beds", "baths"):
            bounds = own.get(name) or {}
            need(not (bounds.get("min") and bounds.get("max") and bounds["min"] > bounds["max"]), f"{name}: minimum exceeds maximum")
        if filters.page:
            child(state, "pagination")["currentPage"] = filters.page
        return replace(self, search_query_state=state)


def child(parent: dict, key: str) -> dict:
    """The object under a key, made if it is missing."""
    if parent.get(key) is None:
        parent[key] = {}
    need(isinstance(parent[key], dict), f"{key} must be an object")
    return parent[key]


def load_profile(text: str) -> SearchProfile:
    """Strict: unknown fields and anything behind the document are errors."""
    try:
        value = json.loads(text)
    except ValueError as error:
        raise OptionError(f"invalid profile: {error}") from None
    need(isinstance(value, dict) and set(value) <= FIELDS, "profile has unknown fields")
    need(isinstance(value.get("searchQueryState"), dict), "searchQueryState must be an object")
    need(isinstance(value.get("wants"), dict), "wants must be an object")
    return SearchProfile(value.get("version", 0), value.get("endpoint", ""), value.get("method", ""), value.get("referer", ""), value["searchQueryState"], value["wants"])


def cache_key(**parts: object) -> str:
    """Stands for what is asked, not for how: canonical JSON, hashed."""
    return hashlib.sha256(json.dumps(parts, sort_keys=True, default=str).encode()).hexdigest()


class DocumentCache:
    """Small results by key, in owner-only files that are replaced as a whole."""

    VERSION, AHEAD = 1, 300

    def __init__(self, folder: str, ttl: float):
        self.folder, self.ttl = Path(folder), ttl

    def path(self, key: str) -> Path:
        return self.folder / f"{hashlib.sha256(key.encode()).hexdigest()}.json"

    def load(self, key: str, now: float | None = None) -> object | None:
        now, path = time.time() if now is None else now, self.path(key)
        try:
            if path.stat().st_mode & 0o077:
                return None
            held = json.loads(path.read_text())
        except (OSError, ValueError):
            return None
        if not isinstance(held, dict) or set(held) != {"version", "storedAt", "key", "value"} or (held["version"], held["key"]) != (self.VERSION, key):
            return None
        return held["value"] if -self.AHEAD <= now - held["storedAt"] <= self.ttl else None

    def save(self, key: str, value: object, now: float | None = None) -> None:
        self.folder.mkdir(mode=0o700, parents=True, exist_ok=True)
        held = {"version": self.VERSION, "storedAt": time.time() if now is None else now, "key": key, "value": value}
        write_private(self.path(key), json.dumps(held))


def write_private(path: Path, text: str) -> None:
    """Written beside its place, synced, and moved there; for the owner alone."""
    handle, name = tempfile.mkstemp(dir=path.parent)
    try:
        with os.fdopen(handle, "w") as out:
            out.write(text)
            out.flush()
            os.fsync(out.fileno())
        os.chmod(name, 0o600)
        os.replace(name, path)
    except BaseException:
        os.unlink(name)
        raise
