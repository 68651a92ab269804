"""Schemas of the relations."""

from __future__ import annotations

ADDRESS = "struct<street: string, city: string, state: string, postalCode: string, full: string>"
COORDINATES = "struct<latitude: double, longitude: double>"

#: A property-listing row. Empty text means absent; null numbers mean unknown.
LISTING_FIELDS = {
    "id": "string", "url": "string", "address": ADDRESS, "priceText": "string", "price": "bigint",
    "requiredMonthlyFees": "bigint", "totalMonthlyCost": "bigint", "priceIncludesRequiredFees": "boolean",
    "bedrooms": "double", "bathrooms": "double", "livingArea": "bigint", "homeType": "string", "status": "string",
    "isBuilding": "boolean", "sharedHousing": "boolean", "studentHousing": "boolean", "incomeRestricted": "boolean",
    "imageUrl": "string", "coordinates": COORDINATES, "daysListed": "bigint", "listedDate": "string",
    "updatedDate": "string", "availability": "string", "yearBuilt": "bigint", "description": "string",
    "laundry": "string", "laundryFeatures": "array<string>", "parking": "string", "parkingFeatures": "array<string>",
    "petPolicy": "string", "allowedPets": "array<string>", "flexSpaces": "array<string>", "detailStatus": "string",
    "detailError": "string", "matchStatus": "string", "matchReasons": "array<string>", "historyStatus": "string",
    "historyChanges": "array<string>", "verificationNotes": "array<string>",
}
PROPERTY_FIELDS = {k: v for k, v in LISTING_FIELDS.items() if k not in ("priceText", "isBuilding", "detailStatus", "detailError", "matchStatus", "matchReasons", "historyStatus", "historyChanges")} | {"lotSize": "double", "raw": "string"}


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"`{name}` {kind}" for name, kind in fields.items())


LISTING_SCHEMA = ddl(LISTING_FIELDS)
PROPERTY_SCHEMA = ddl(PROPERTY_FIELDS)

_PAIR = "struct<name: string, value: string, comment: string>"
_COOKIE = "struct<name: string, value: string, path: string, domain: string, expires: string, httpOnly: boolean, secure: boolean, sameSite: string, comment: string>"
_PARAM = "struct<name: string, value: string, fileName: string, contentType: string, comment: string>"
_POST = f"struct<mimeType: string, params: array<{_PARAM}>, text: string, comment: string>"
_CONTENT = "struct<size: bigint, compression: bigint, mimeType: string, text: string, encoding: string, comment: string>"
_REQUEST = f"struct<method: string, url: string, httpVersion: string, headers: array<{_PAIR}>, queryString: array<{_PAIR}>, cookies: array<{_COOKIE}>, headersSize: bigint, bodySize: bigint, postData: {_POST}, comment: string>"
_RESPONSE = f"struct<status: int, statusText: string, httpVersion: string, headers: array<{_PAIR}>, cookies: array<{_COOKIE}>, content: {_CONTENT}, redirectURL: string, headersSize: bigint, bodySize: bigint, comment: string>"
_TIMINGS = "struct<blocked: double, dns: double, connect: double, send: double, wait: double, receive: double, ssl: double, comment: string>"
ENTRY = f"struct<pageref: string, startedDateTime: string, time: double, request: {_REQUEST}, response: {_RESPONSE}, cache: string, timings: {_TIMINGS}, serverIPAddress: string, connection: string, comment: string, _resourceType: string, _initiator: string>"
_CREATOR = "struct<name: string, version: string, comment: string>"
_PAGE = "struct<startedDateTime: string, id: string, title: string, pageTimings: struct<onContentLoad: double, onLoad: double, comment: string>, comment: string>"
ARCHIVE = f"struct<log: struct<version: string, creator: {_CREATOR}, browser: {_CREATOR}, pages: array<{_PAGE}>, entries: array<{ENTRY}>, comment: string>>"

#: Recorded browser events, flattened: one row an event.
EVENT_SCHEMA = (
    "seq bigint, event_type string, request_id string, ts_mono double, ts_wall double, url string, method string, type string, "
    "status int, has_extra_info boolean, redirect_status int, redirect_has_extra_info boolean, headers map<string, string>, "
    "encoded_length bigint, protocol string, error string, mime_type string"
)
