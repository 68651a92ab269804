"""The parse boundary: documents to records, in Arrow batches.

A record is what a JSON object holds, flattened: ``scalars`` by dotted path (objects and arrays with their kind), arrays of
objects as ``lists`` of such scalars, and the strings in arrays as ``strings``. Everything behind it is column expressions.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from terrasift.functions.tagged import TAGGED

RECORD = f"struct<scalars: map<string, {TAGGED}>, lists: map<string, array<map<string, {TAGGED}>>>, strings: map<string, array<string>>>"

# The script that holds a page's state, and where documents keep what is read from them.
SCRIPT_ID = "__NEXT_DATA__"
RESULTS = [["cat1", "searchResults"], ["searchPageState", "cat1", "searchResults"], ["data", "cat1", "searchResults"]]
STATE = ["props", "pageProps", "searchPageState"]
CACHE = ["props", "pageProps", "componentProps", "gdpClientCache"]
BUILDING = ["props", "pageProps", "componentProps", "initialReduxState", "gdp", "building"]
PAGE_IDS = [
    ["props", "pageProps", "componentProps", "zpid"], ["props", "pageProps", "componentProps", "property", "zpid"],
    ["props", "pageProps", "zpid"], ["props", "pageProps", "query", "zpid"], ["query", "zpid"],
]
#: Keys below which all strings are gathered, and parts of the keys of objects that are looked into.
DEEP = ["rooms", "interiorFeatures", "otherInteriorFeatures", "amenityDetails", "unitFeatures", "commonUnitAmenities"]
TELLING = ["room", "feature", "description", "type", "name"]
#: Bytes of a document at most.
LIMIT = 8 << 20


class Drift(Exception):
    """A document whose shape isn't the one expected: where, and what."""

    def __init__(self, path: str, detail: str):
        super().__init__(f"{path}: {detail}")
        self.path, self.detail = path, detail


class Number(str):
    """A number as written."""


def decode(text: str) -> object:
    """One JSON value, numbers as written; of repeated keys the last counts."""

    def refuse(name: str) -> object:
        raise ValueError(f"{name} is no JSON value")

    return json.loads(text, parse_int=Number, parse_float=Number, parse_constant=refuse)


def look(value: object, path: list[str]) -> tuple[object, bool]:
    for key in path:
        if not isinstance(value, dict) or key not in value:
            return None, False
        value = value[key]
    return value, True


def find(value: object, wanted: str, path: str = "") -> tuple[object, str] | None:
    """The first value under ``wanted``: objects by sorted keys, each before what is below it."""
    if isinstance(value, dict):
        if wanted in value:
            return value[wanted], f"{path}.{wanted}".lstrip(".")
        items = [(f"{path}.{key}".lstrip("."), value[key]) for key in sorted(value)]
    elif isinstance(value, list):
        items = [(f"{path}[{i}]", x) for i, x in enumerate(value)]
    else:
        return None
    return next((hit for at, x in items if (hit := find(x, wanted, at))), None)


_TAG = re.compile(r"<!--.*?-->|<((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_NAME = re.compile(r"\s*([A-Za-z0-9_:-]+)")
_ATTRIBUTE = re.compile(r"([A-Za-z0-9_:-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?")
_END = re.compile(r"</script", re.I)


def script_text(document: str, script_id: str = SCRIPT_ID) -> str | None:
    """The body of the script element with an id; comments and other scripts' bodies are passed over whole."""
    at = 0
    while tag := _TAG.search(document, at):
        at = tag.end()
        inner = tag[1]
        name = _NAME.match(inner) if inner else None
        if not name or name[1].lower() != "script":
            continue
        end = _END.search(document, at)
        if not end:
            return None
        found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(inner, name.end())}
        if found.get("id") == script_id:
            return document[at : end.start()].strip()
        close = document.find(">", end.end())
        if close < 0:
            return None
        at = close + 1
    return None


def tagged(value: object) -> dict:
    if value is None:
        return {"kind": "null", "text": None}
    if isinstance(value, bool):
        return {"kind": "bool", "text": "true" if value else "false"}
    if isinstance(value, Number):
        return {"kind": "number", "text": str(value)}
    if isinstance(value, str):
        return {"kind": "string", "text": value}
    empty = "{}" if isinstance(value, dict) else "[]"
    return {"kind": "object" if isinstance(value, dict) else "array", "text": "" if value else empty}


def gather(value: object) -> list[str]:
    """All strings below a value, in objects those under telling keys, by sorted keys."""
    if isinstance(value, str) and not isinstance(value, Number):
        return [value] if value.strip() else []
    if isinstance(value, list):
        return [s for x in value for s in gather(x)]
    if isinstance(value, dict):
        return [s for key in sorted(value) if any(t in key.lower() for t in TELLING) for s in gather(value[key])]
    return []


def flatten(value: dict) -> dict:
    scalars: dict[str, dict] = {}
    lists: dict[str, list] = {}
    strings: dict[str, list[str]] = {}

    def walk(item: dict, path: str, nested: bool) -> None:
        for key, x in item.items():
            at = f"{path}{key}"
            scalars[at] = tagged(x)
            if key in DEEP:
                strings[at] = gather(x)
            elif isinstance(x, str) and not isinstance(x, Number):
                strings[at] = [x] if x.strip() else []
            elif isinstance(x, list):
                strings[at] = [s for s in x if isinstance(s, str) and not isinstance(s, Number) and s.strip()]
                if nested:
                    lists[at] = [flatten(e)["scalars"] for e in x if isinstance(e, dict)]
            if isinstance(x, dict):
                walk(x, f"{at}.", nested)

    walk(value, "", True)
    return {"scalars": scalars, "lists": lists, "strings": strings}


def is_html(text: str) -> bool:
    return text.lstrip().startswith("<")


def page_state(document: str) -> dict:
    """The search state of a saved page or of raw JSON."""
    text = document.removeprefix("﻿").strip()
    if not text:
        raise Drift("input", "snapshot is empty")
    if is_html(text):
        text = script_text(text) or ""
        if not text:
            raise Drift(f"script#{SCRIPT_ID}", "required data script is missing")
    root = object_of(text, SCRIPT_ID)
    for depth, key in enumerate(STATE):
        path = ".".join(STATE[: depth + 1])
        if key not in root:
            raise Drift(path, "required object is missing")
        root = root[key]
        if not isinstance(root, dict):
            raise Drift(path, "value must be an object")
    return root


def object_of(text: str, path: str) -> dict:
    try:
        value = decode(text)
    except ValueError as error:
        raise Drift(path, f"invalid JSON: {error}") from None
    if not isinstance(value, dict):
        raise Drift(path, "top-level value must be an object")
    return value


def result_arrays(root: dict) -> Iterator[tuple[str, list]]:
    """The list of results, and the map's if there is one."""
    paths = [([*base, "listResults"], look(root, [*base, "listResults"])) for base in RESULTS]
    hit = next(((".".join(path), value) for path, (value, there) in paths if there), None)
    if hit is None:
        deep = find(root, "listResults")
        if deep is None:
            raise Drift("listResults", "required listing array is missing")
        hit = deep[1], deep[0]
    if not isinstance(hit[1], list):
        raise Drift(hit[0], "listing results must be an array")
    yield hit
    for base in RESULTS:
        value, there = look(root, [*base, "mapResults"])
        if there:
            if value is not None and not isinstance(value, list):
                raise Drift(".".join([*base, "mapResults"]), "map results must be an array")
            yield ".".join([*base, "mapResults"]), value or []
            return


def search_rows(root: dict) -> dict:
    """Listings of a search response by group and order, and what it says about itself."""
    rows = []
    for group, (path, items) in enumerate(result_arrays(root)):
        for ord_, item in enumerate(items):
            if not isinstance(item, dict):
                raise Drift(f"{path}[{ord_}]", "listing must be an object")
            rows.append({"group": group, "ord": ord_, "path": f"{path}[{ord_}]", "record": flatten(item)})
    state = next((root[k] for k in ("searchQueryState", "queryState") if isinstance(root.get(k), dict)), root)

    def first(*paths: str) -> dict | None:
        return next((tagged(v) for p in paths for v, there in [look(root, p.split("."))] if there), None)

    both = lambda path: (f"cat1.{path}", f"searchPageState.cat1.{path}")
    total = first(*both("searchList.totalResultCount"), *both("searchResults.totalResultCount"))
    if total is None and (deep := find(root, "totalResultCount")):
        total = tagged(deep[0])
    page, _ = look(state, ["pagination", "currentPage"])
    return {
        "listings": rows,
        "metadata": {
            "currentPage": tagged(page), "resultsPerPage": first(*both("searchList.resultsPerPage")),
            "totalPages": first(*both("searchList.totalPages")), "totalResults": total,
            "resultsHash": first(*both("searchResults.resultsHash")), "relaxedResults": first(*both("searchResults.relaxedResults")),
        },
    }


def page_root(document: str, limit: int) -> dict:
    text = script_text(document.removeprefix("﻿"))
    if text is None:
        raise Drift(f"script#{SCRIPT_ID}", "required data script is missing")
    return object_of(text, f"script#{SCRIPT_ID}")


def decoded_cache(value: object) -> object:
    """JSON in a string in JSON, two passes at most."""
    for _ in range(2):
        if not isinstance(value, str):
            return value
        value = decode(value)
    if isinstance(value, str):
        raise ValueError("cache remains a JSON string after two decode passes")
    return value


def candidates(value: object, path: str = "") -> Iterator[dict]:
    """Every object under a key ``property``, with its path."""
    if isinstance(value, dict):
        if isinstance(value.get("property"), dict):
            yield {"path": f"{path}.property".lstrip("."), "record": flatten(value["property"]), "raw": json.dumps(value["property"])}
        for key in sorted(value):
            yield from candidates(value[key], f"{path}.{key}".lstrip("."))
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield from candidates(x, f"{path}[{i}]")


def rental_rows(root: dict) -> dict:
    """A community's floor plans and units, or candidates for the one property of a page."""
    building, there = look(root, BUILDING)
    if there:
        if not isinstance(building, dict):
            raise Drift(".".join(BUILDING), "building must be an object")
        rentals = []
        plans = building.get("floorPlans")
        for i, plan in enumerate(plans if isinstance(plans, list) else []):
            if isinstance(plan, dict):
                units = plan.get("units")
                rentals += [rental(f"floorPlans[{i}].units[{k}]", i, k, plan, u) for k, u in enumerate(units if isinstance(units, list) else []) if isinstance(u, dict)]
                rentals.append(rental(f"floorPlans[{i}]", i, 1 << 30, plan, None))
        units = building.get("ungroupedUnits")
        rentals += [rental(f"ungroupedUnits[{k}]", 1 << 30, k, None, u) for k, u in enumerate(units if isinstance(units, list) else []) if isinstance(u, dict)]
        return {"kind": "community", "building": flatten(building), "rentals": rentals, "candidates": [], "ids": []}
    cache, there = look(root, CACHE)
    if not there:
        deep = find(root, CACHE[-1])
        if deep is None:
            raise Drift(CACHE[-1], "required property cache is missing")
        cache = deep[0]
    try:
        cache = decoded_cache(cache)
    except ValueError as error:
        raise Drift(CACHE[-1], f"invalid JSON: {error}") from None
    ids = [{"path": ".".join(p), "id": tagged(v)} for p in PAGE_IDS for v, there in [look(root, p)] if there and v is not None]
    return {"kind": "property", "building": None, "rentals": [], "candidates": list(candidates(cache)), "ids": ids}


def rental(path: str, plan: int, unit: int, plan_value: dict | None, unit_value: dict | None) -> dict:
    value = {k: v for k, v in (plan_value or {}).items() if k != "units" and not (unit_value is not None and k == "zpid")}
    value |= {k: v for k, v in (unit_value or {}).items() if v is not None}
    return {
        "path": path, "plan": plan, "unit": unit, "planRecord": None if plan_value is None else flatten({k: v for k, v in plan_value.items() if k != "units"}),
        "unitRecord": None if unit_value is None else flatten(unit_value), "merged": flatten(value), "raw": json.dumps(value),
    }


DRIFT = "struct<path: string, detail: string>"
SEARCH = f"struct<drift: {DRIFT}, listings: array<struct<group: int, ord: int, path: string, record: {RECORD}>>, metadata: struct<currentPage: {TAGGED}, resultsPerPage: {TAGGED}, totalPages: {TAGGED}, totalResults: {TAGGED}, resultsHash: {TAGGED}, relaxedResults: {TAGGED}>>"
RENTAL = f"struct<drift: {DRIFT}, kind: string, building: {RECORD}, rentals: array<struct<path: string, plan: int, unit: int, planRecord: {RECORD}, unitRecord: {RECORD}, merged: {RECORD}, raw: string>>, candidates: array<struct<path: string, record: {RECORD}, raw: string>>, ids: array<struct<path: string, id: {TAGGED}>>>"


def guarded(parse: Callable[[str], dict], empty: dict, limit: int) -> Callable[[pd.Series], pd.DataFrame]:
    """A document's rows, or where it drifts; a null document drifts as well."""

    def one(document: str | None) -> dict:
        try:
            if document is None:
                raise Drift("input", "document is missing")
            if len(document.encode("utf-8", "surrogatepass")) > limit:
                raise Drift("input", f"document exceeds {limit} bytes")
            return {"drift": None} | parse(document)
        except Drift as drift:
            return {"drift": {"path": drift.path, "detail": drift.detail}} | empty

    return lambda documents: pd.DataFrame([one(d) for d in documents], columns=["drift", *empty])


def search_response(document: Column, limit: int = LIMIT) -> Column:
    """``SEARCH`` of a search response in JSON."""
    parse = guarded(lambda d: search_rows(object_of(d, "response")), {"listings": [], "metadata": None}, limit)

    @F.pandas_udf(SEARCH)
    def parsed(documents: pd.Series) -> pd.DataFrame:
        return parse(documents)

    return parsed(document)


def search_snapshot(document: Column, limit: int = LIMIT) -> Column:
    """``SEARCH`` of a saved search page, HTML or its JSON."""
    parse = guarded(lambda d: search_rows(page_state(d)), {"listings": [], "metadata": None}, limit)

    @F.pandas_udf(SEARCH)
    def parsed(documents: pd.Series) -> pd.DataFrame:
        return parse(documents)

    return parsed(document)


def rental_page(document: Column, limit: int = LIMIT) -> Column:
    """``RENTAL`` of a saved property or community page."""
    empty = {"kind": None, "building": None, "rentals": [], "candidates": [], "ids": []}
    parse = guarded(lambda d: rental_rows(page_root(d, limit)), empty, limit)

    @F.pandas_udf(RENTAL)
    def parsed(documents: pd.Series) -> pd.DataFrame:
        return parse(documents)

    return parsed(document)


def embedded_script(document: Column, script_id: str = SCRIPT_ID) -> Column:
    """The text of a page's data script, or null."""

    @F.pandas_udf("string")
    def extracted(documents: pd.Series) -> pd.Series:
        return documents.map(lambda d: None if d is None else script_text(d, script_id))

    return extracted(document)


# Marks of pages that ask for proof of a human, and what they are called.
CHALLENGES = {
    "px-captcha": "PerimeterX CAPTCHA page",
    "press & hold": "press-and-hold challenge page",
    "verify you are human": "human verification page",
    "access to this page has been denied": "access-denied challenge page",
    "cf-chl-": "browser challenge page",
    "challenge-platform": "browser challenge page",
    "robot check": "robot-check challenge page",
    "captcha": "CAPTCHA page",
}


def challenge(document: Column, has_script: Column) -> Column:
    """Why a saved page is a challenge instead of content; null if it isn't. A page with its data script never is."""
    text = F.lower(document)
    marks = F.coalesce(*(F.when(text.contains(mark), F.lit(reason)) for mark, reason in CHALLENGES.items()))
    return F.when(~has_script & looks_like_html(document), marks)


def looks_like_html(document: Column) -> Column:
    return F.regexp_replace(document, "^﻿", "").rlike(r"^\s*<")


def response_challenge(kind: str, status: Column, content_type: Column, body: Column) -> Column:
    """Why a recorded response of ``kind`` "json" or "html" is a challenge; null if it isn't."""
    text = F.lower(body)
    media = F.lower(F.trim(F.regexp_extract(content_type, "^([^;]*)", 1)))
    page = media.isin("text/html", "application/xhtml+xml") | text.rlike("^﻿?\\s*<(?:!doctype html|html|head|body)")
    data = text.contains(SCRIPT_ID.lower())
    json_shaped = text.rlike("^﻿?\\s*[{\\[]")
    marks = F.coalesce(*(F.when(text.contains(mark), F.lit(reason)) for mark, reason in CHALLENGES.items()))
    if kind == "json":
        shaped = (status >= 400) | page | ~json_shaped
        return F.when(shaped & marks.isNotNull(), marks).when(page, F.lit("HTML returned by JSON endpoint"))
    sound = (status >= 200) & (status < 300) & page & data
    shaped = (status >= 400) | (page & ~data)
    return F.when(sound, None).when(shaped & marks.isNotNull(), marks).when((status == 403) & page, F.lit("forbidden HTML response"))
