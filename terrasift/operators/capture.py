"""Recorded requests as whole archive entries: headers, query, cookies, bodies, sizes and phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.sources.archive import query_items
from terrasift.streaming.chains import entry_columns, has_no_body, header_rows, needs_base64

PAGE = "page_1"
_DAY = 86_400_000_000
_PAIRS = "array<struct<name: string, value: string, comment: string>>"
_NAME = r"^[!#$%&'*+\-.^_`|~0-9A-Za-z]+$"
_VALUE = r'^[\x20-\x7E&&[^";\\]]*$'


def iso_time(seconds: Column) -> Column:
    """A time in UTC whatever the session's zone, with as many digits of a second as it needs."""
    us = F.round(seconds * 1e6).cast("bigint")
    days = F.floor(us / _DAY).cast("bigint")
    rest = us - days * _DAY
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    part = lambda unit, most: two(F.floor(rest / unit).cast("bigint") % most)
    fraction = F.regexp_replace(F.concat(F.lit("."), F.lpad((rest % 1_000_000).cast("string"), 6, "0")), r"\.?0+$", "")
    date = F.date_add(F.lit("1970-01-01").cast("date"), days.cast("int")).cast("string")
    return F.concat(date, F.lit("T"), part(3_600_000_000, 24), F.lit(":"), part(60_000_000, 60), F.lit(":"), part(1_000_000, 60), fraction, F.lit("Z"))


def values_of(headers: Column, name: str) -> Column:
    """All values of a header, whatever its case."""
    return F.transform(F.filter(headers, lambda h: F.lower(h["name"]) == name.lower()), lambda h: h["value"])


def first_of(headers: Column, name: str) -> Column:
    return F.coalesce(F.get(values_of(headers, name), F.lit(0)), F.lit(""))


def _named(parts: Column) -> Column:
    """name, value around the first ``=`` of each part, and whether there is one; the value without quotes around it.

    Each is worked out once here: what follows asks for it many times.
    """

    def pair(text: Column) -> Column:
        name = F.substring_index(text, "=", 1)
        # behind the end there is nothing
        return F.struct(F.trim(name).alias("name"), F.trim(F.substring(text, F.length(name) + 2, F.length(text))).alias("value"), text.contains("=").alias("told"))

    bare = lambda p: F.when(p["value"].startswith('"'), F.regexp_replace(p["value"], '^"(.*)"$', "$1")).otherwise(p["value"])
    return F.transform(F.transform(parts, pair), lambda p: F.struct(p["name"].alias("name"), F.lower(p["name"]).alias("key"), bare(p).alias("value"), p["told"].alias("told")))


def _sound(pair: Column) -> Column:
    return pair["name"].rlike(_NAME) & pair["value"].rlike(_VALUE)


def request_cookies(headers: Column) -> Column:
    """Name and value of each cookie that was sent; malformed ones are left out."""
    parts = F.flatten(F.transform(values_of(headers, "Cookie"), lambda v: F.split(v, ";")))
    cookie = lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value"), *(F.lit(None).cast(k).alias(n) for n, k in _REST))
    return F.transform(F.filter(_named(parts), _sound), cookie)


_REST = [("path", "string"), ("domain", "string"), ("expires", "string"), ("httpOnly", "boolean"), ("secure", "boolean"), ("sameSite", "string"), ("comment", "string")]
_MODES = {"lax": "Lax", "strict": "Strict", "none": "None"}


_TOLD = ["path", "domain", "expires", "httponly", "secure", "samesite"]
_DATE = r"^\d{2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec) \d{4} \d{2}:\d{2}:\d{2} (?:GMT|UTC)$"


def response_cookies(headers: Column) -> Column:
    """Each cookie that was set, with its attributes; malformed ones are left out."""

    def parsed(parts: Column) -> Column:
        """The first part, and the others from the last one on."""
        return F.struct(F.get(parts, F.lit(0)).alias("head"), F.reverse(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))).alias("told"))

    def said(c: Column) -> Column:
        """Of each attribute the last one, or null."""
        # where a key stands is found without a test of each part for each key
        last = lambda key: F.get(c["told"]["value"], (F.array_position(c["told"]["key"], key) - 1).cast("int"))
        values = {key: last(key) for key in _TOLD}
        values["expires"] = F.regexp_replace(F.regexp_replace(values["expires"], "^[A-Za-z]+, ", ""), "-", " ")
        values["samesite"] = F.lower(values["samesite"])
        return F.struct(c["head"].alias("head"), *(value.alias(key) for key, value in values.items()))

    def cookie(c: Column) -> Column:
        moment = F.to_timestamp_ntz(F.when(c["expires"].rlike(_DATE), F.substring(c["expires"], 1, 20)), F.lit("dd MMM yyyy HH:mm:ss"))
        return F.struct(
            c["head"]["name"].alias("name"), c["head"]["value"].alias("value"), c["path"].alias("path"), c["domain"].alias("domain"), F.date_format(moment, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("expires"),
            c["httponly"].isNotNull().alias("httpOnly"), c["secure"].isNotNull().alias("secure"), F.coalesce(*(F.when(c["samesite"] == low, F.lit(text)) for low, text in _MODES.items())).alias("sameSite"), F.lit(None).cast("string").alias("comment"),
        )

    lines = F.transform(values_of(headers, "Set-Cookie"), lambda line: parsed(_named(F.split(line, ";"))))
    sound = F.filter(lines, lambda c: c["head"]["told"] & _sound(c["head"]))
    return F.transform(F.transform(sound, said), cookie)


def told_pairs(pairs: Column) -> Column:
    return F.coalesce(F.transform(pairs, lambda p: F.struct(p["name"].alias("name"), p["value"].alias("value"), F.lit(None).cast("string").alias("comment"))), F.array().cast(_PAIRS))


def capture_entries(rows: DataFrame, source: Column, cutoff: float | None = None) -> DataFrame:
    """source_id, entry_index, entry (as ENTRY) of hops made with ``whole``; ``entry_index`` is the place of the first event.

    Headers as sent outweigh those that the request or the response first told. A request body is text; a response
    body is kept as text if it is, else as base64, and not at all where the protocol has none.
    """
    c = entry_columns(cutoff)
    none = lambda kind="string": F.lit(None).cast(kind)
    rows = rows.filter("hop >= 0").select(
        source.alias("source_id"), F.col("seq").alias("entry_index"), "*",
        told_pairs(header_rows(F.coalesce("request_headers", "told_request_headers", F.create_map().cast("map<string, string>")))).alias("_sent"),
        told_pairs(header_rows(F.coalesce("response_headers", "told_response_headers", F.create_map().cast("map<string, string>")))).alias("_got"),
    )
    rows = rows.withColumn("_type", first_of(F.col("_got"), "Content-Type"))
    sent, got, posted = F.col("_sent"), F.col("_got"), F.col("post_data")
    version = c["httpVersion"]
    post = F.when(posted.isNotNull(), F.struct(first_of(sent, "Content-Type").alias("mimeType"), none("array<struct<name: string, value: string, fileName: string, contentType: string, comment: string>>").alias("params"), posted.alias("text"), none().alias("comment")))
    request = F.struct(
        F.col("method"), F.col("url"), version.alias("httpVersion"), sent.alias("headers"), told_pairs(query_items(F.col("url"))).alias("queryString"), request_cookies(sent).alias("cookies"),
        F.lit(-1).cast("bigint").alias("headersSize"), F.coalesce(F.octet_length(posted).cast("bigint"), F.lit(0).cast("bigint")).alias("bodySize"), post.alias("postData"), none().alias("comment"),
    )
    media = F.coalesce(F.nullif(F.col("_type"), F.lit("")), "mime_type", F.lit(""))
    body = F.when(~F.coalesce(has_no_body(F.col("method"), F.col("status")), F.lit(False)), F.col("body"))
    coded = needs_base64(media, body)
    content = F.struct(
        F.coalesce(F.octet_length(body).cast("bigint"), c["contentSize"].cast("bigint")).alias("size"), none("bigint").alias("compression"), media.alias("mimeType"),
        F.when(coded, F.base64(body)).otherwise(body.cast("string")).alias("text"), F.when(coded & body.isNotNull(), "base64").alias("encoding"), none().alias("comment"),
    )
    response = F.struct(
        F.coalesce("status", F.lit(0)).alias("status"), F.coalesce("status_text", F.lit("")).alias("statusText"), version.alias("httpVersion"), got.alias("headers"), response_cookies(got).alias("cookies"), content.alias("content"),
        first_of(got, "Location").alias("redirectURL"), F.lit(-1).cast("bigint").alias("headersSize"), c["bodySize"].cast("bigint").alias("bodySize"), none().alias("comment"),
    )
    timings = F.struct(*(none("double").alias(n) for n in ("blocked", "dns", "connect")), F.lit(0.0).alias("send"), c["wait"].alias("wait"), c["receive"].alias("receive"), none("double").alias("ssl"), none().alias("comment"))
    entry = F.struct(
        F.lit(PAGE).alias("pageref"), iso_time(F.col("started_wall")).alias("startedDateTime"), c["time"].alias("time"), request.alias("request"), response.alias("response"), F.lit("{}").alias("cache"), timings.alias("timings"),
        none().alias("serverIPAddress"), none().alias("connection"), F.nullif(c["comment"], F.lit("")).alias("comment"), c["resourceType"].alias("_resourceType"), none().alias("_initiator"),
    )
    return rows.select("source_id", "entry_index", entry.alias("entry"))
