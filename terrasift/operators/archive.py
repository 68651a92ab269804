"""Ranking and redaction of archive entries."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from json.encoder import encode_basestring
from urllib.parse import quote, quote_plus, unquote, unquote_plus, urlsplit, urlunsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions import redact as R
from terrasift.functions.text import contains_any, trim_ws
from terrasift.sources.records import Number, decode

# The site's hosts, its search endpoint, marks of telemetry, kinds and extensions of static files.
SITE_HOST = "zillow.com"
ENDPOINT = "/async-create-search-page-state"
TELEMETRY = [
    "analytics", "telemetry", "doubleclick", "google-analytics", "newrelic", "segment", "mixpanel", "scorecardresearch",
    "/beacon", "/collect", "/event", "/events", "/logging", "/metrics", "/pixel", "/track",
]
STATIC_KINDS = ["document", "font", "image", "media", "script", "stylesheet"]
STATIC_ENDINGS = ["avif", "css", "gif", "ico", "jpeg", "jpg", "js", "map", "mp4", "png", "svg", "webp", "woff", "woff2"]


#: Links and names that are remembered with what came of them, and how long such a text may be: many repeat.
HELD, SHORT = 2048, 500
_NO_KEY = dict.fromkeys(i for i in range(128) if not chr(i).isalnum())
_JWT, _LINK, _BROKEN, _BETWEEN = re.compile(R.JWT), re.compile(r"\s*(?:https?://|/)", re.I), re.compile(r"%(?![0-9A-Fa-f]{2})"), re.compile("([&;])")
_SHORTEST = min(map(len, R.MARKS))
#: Links without user or anything that would have to be put right: origin, path and query.
_PLAIN = re.compile(r"(https?://[A-Za-z0-9.:-]+)(/[!\"$->@-~]*)?(?:\?([!\"$-~]*))?(?:#[!-~]*)?")


def plain_key(name: str) -> str:
    if name.isascii():
        return (name if name.isalnum() else name.translate(_NO_KEY)).lower()
    return "".join(c.lower() for c in name if c.isalpha() or c.isdigit())


def in_path(text: str) -> str:
    return quote(text, safe="$&+=:@")


class Redactor:
    """Redaction of nested values, links and queries; the counterpart of the column tests for what nests."""

    def __init__(self, token: str = R.REDACTED, more: list[str] = ()):
        if re.search(r"[/;\x00-\x1f\x7f-\x9f]", token):
            raise ValueError("redaction must not contain '/', ';' or control characters")
        self.token = token
        self.names = {*R.SENSITIVE, *map(plain_key, more)}
        self.endings = tuple(R.ENDINGS)
        self.escaped = {escape: escape(token) for escape in (in_path, quote_plus)}

    def sensitive(self, name: str) -> bool:
        return self.known_key(name) if len(name) <= SHORT else self.new_key(name)

    @lru_cache(HELD)  # noqa: B019
    def known_key(self, name: str) -> bool:
        return self.new_key(name)

    def new_key(self, name: str) -> bool:
        key = plain_key(name)
        return key in self.names or key.endswith(self.endings)

    def sensitive_in_link(self, name: str) -> bool:
        return self.sensitive(name) or plain_key(name) in R.IN_LINKS

    def credential(self, text: str) -> bool:
        if len(text) < _SHORTEST or text.isdigit():  # neither a mark nor a token looks like this
            return False
        low = text.strip().lower()
        for mark in R.MARKS:
            if mark in low:
                return True
        return "." in text and bool(_JWT.match(text.strip()))

    def value(self, value: object) -> object:
        if isinstance(value, dict):
            return {k: self.token if self.sensitive(k) else self.value(v) for k, v in value.items()}
        if isinstance(value, list):
            return [self.value(v) for v in value]
        if not isinstance(value, str) or isinstance(value, Number) or value.isdigit():
            return value
        if value.strip()[:1] in ("{", "["):
            try:
                return dumps(self.value(decode(value)))
            except ValueError:
                return self.token
        if _LINK.match(value):
            try:
                return self.link(value)
            except ValueError:
                return self.token
        return self.token if self.credential(value) else value

    def link(self, link: str) -> str:
        """Without user and fragment; secrets in path and query are replaced. A malformed query is dropped."""
        return self.known_link(link) if len(link) <= SHORT else self.new_link(link)

    @lru_cache(HELD)  # noqa: B019
    def known_link(self, link: str) -> str:
        return self.new_link(link)

    def new_link(self, link: str) -> str:
        if not link.strip():
            return link
        if plain := _PLAIN.fullmatch(link):
            origin, path, query = plain.groups("")
            return f"{origin}{self.path(path)}{'?' if (query := self.sound_query(query)) else ''}{query}"
        parts = urlsplit(link)
        if parts.scheme and not parts.netloc and not parts.path.startswith("/"):
            raise ValueError("opaque link")
        host = parts.netloc.rpartition("@")[2]
        return urlunsplit((parts.scheme, host, self.path(parts.path), self.sound_query(parts.query), ""))

    def sound_query(self, query: str) -> str:
        try:
            return self.query(query)
        except ValueError:
            return ""

    def name_kind(self, name: str) -> str | None:
        """What is wrong with the name of a value in a link."""
        if name.isdigit():
            return None
        return self.known_name(name) if len(name) <= SHORT else self.new_name(name)

    @lru_cache(HELD)  # noqa: B019
    def known_name(self, name: str) -> str | None:
        return self.new_name(name)

    def new_name(self, name: str) -> str | None:
        return "sensitive" if self.sensitive_in_link(name) else "credential" if self.credential(name) else None

    def pair(self, key: str, value: str | None, unescape, escape) -> str | None:
        """A redacted ``key=value``, or None if it may stay."""
        if (kind := self.name_kind(unescape(key))) == "sensitive":
            return f"{key}={self.escaped[escape]}"
        if kind:
            return self.escaped[escape] if value is None else f"{self.escaped[escape]}={self.escaped[escape]}"
        if value is not None:
            clean = self.value(plain := unescape(value))
            if clean != plain:
                return f"{key}={escape(str(clean))}"
        return None

    def path(self, path: str) -> str:
        out, secret = [], False
        token = self.escaped[in_path]
        for segment in path.split("/"):
            if not secret and segment.isdigit():
                out.append(segment)
                continue
            base, *matrix = segment.split(";") if ";" in segment else (segment,)
            key, equals, value = base.partition("=")
            name = checked(base)
            if secret and base:
                base, secret = token, False
            elif equals:
                base, secret = self.pair(key, value, checked, in_path) or base, False
            else:
                kind = self.name_kind(name)
                base, secret = token if kind == "credential" else base, kind is not None
            if matrix:
                cells = [x.partition("=") for x in matrix]
                base = ";".join([base, *(self.pair(k, v if e else None, checked, in_path) or f"{k}{e}{v}" for k, e, v in cells)])
            out.append(base)
        return "/".join(out)

    def query(self, query: str) -> str:
        """Items stay between their separators, ``&`` or ``;``."""

        def item(text: str) -> str:
            key, equals, value = text.partition("=")
            return self.pair(key, value if equals else None, plus_checked, quote_plus) or text

        return "".join(x if x in "&;" else item(x) for x in _BETWEEN.split(query) if x)

    def body(self, text: str) -> str:
        """The two parts of a search request that are kept, redacted."""
        value = decode(text)
        if not isinstance(value, dict) or not all(isinstance(value.get(k), dict) for k in ("searchQueryState", "wants")):
            raise ValueError("search body needs searchQueryState and wants objects")
        return dumps(self.value({k: value[k] for k in ("searchQueryState", "wants")}))

    def leaks(self, value: object) -> bool:
        """Whether a redacted value still holds a secret."""
        if isinstance(value, dict):
            return any(v != self.token if self.sensitive(k) else self.leaks(v) for k, v in value.items())
        if isinstance(value, list):
            return any(map(self.leaks, value))
        return isinstance(value, str) and not isinstance(value, Number) and value != self.token and self.value(value) != value


def checked(text: str, plus: bool = False) -> str:
    """Percent-decoded; a malformed escape is an error."""
    if "%" not in text:
        return text.replace("+", " ") if plus else text
    if _BROKEN.search(text):
        raise ValueError("malformed escape")
    return (unquote_plus if plus else unquote)(text)


def plus_checked(text: str) -> str:
    return checked(text, plus=True)


def dumps(value: object) -> str:
    """Compact JSON with sorted keys and numbers as written."""
    if isinstance(value, Number):
        return str(value)
    if isinstance(value, dict):
        return "{" + ",".join(f"{encode_basestring(k)}:{dumps(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(dumps, value)) + "]"
    return encode_basestring(value) if isinstance(value, str) else json.dumps(value)


def redactor(kind: str, redact: Redactor):
    """A column function: "link", "query", "body" or "value" (JSON text); errors give null."""

    run = getattr(redact, kind, None)

    def one(text: str | None) -> str | None:
        if text is None:
            return None
        try:
            return dumps(redact.value(decode(text))) if kind == "value" else run(text)
        except ValueError:
            return None

    @F.arrow_udf("string")
    def clean(texts: pa.Array) -> pa.Array:
        return pa.array(map(one, texts.to_pylist()), pa.string())

    return clean


def header(headers: Column, *names: str) -> Column:
    """The first header of a name, whatever its case; else empty."""
    found = F.filter(headers, lambda h: F.lower(h["name"]).isin(*(n.lower() for n in names)))
    return F.coalesce(F.get(found, F.lit(0))["value"], F.lit(""))


def host_of(link: Column) -> Column:
    return F.lower(F.regexp_extract(link, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def path_of(link: Column) -> Column:
    path = F.regexp_extract(link, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def is_first_party(host: Column) -> Column:
    name = F.regexp_replace(F.lower(host), r"\.$", "")
    return (name == SITE_HOST) | name.endswith(f".{SITE_HOST}")


def is_telemetry(host: Column, path: Column) -> Column:
    return contains_any(F.lower(F.concat_ws(" ", host, path)), *TELEMETRY)


def is_static(kind: Column, path: Column) -> Column:
    return kind.isin(*STATIC_KINDS) | F.lower(path).rlike(rf"\.(?:{'|'.join(STATIC_ENDINGS)})$")


def media_types(entry: Column) -> tuple[Column, Column]:
    asked = F.coalesce(F.nullif(entry["request"]["postData"]["mimeType"], F.lit("")), header(entry["request"]["headers"], "Content-Type"))
    given = F.coalesce(F.nullif(entry["response"]["content"]["mimeType"], F.lit("")), header(entry["response"]["headers"], "Content-Type"))
    return asked, given


def score_rules(method: Column, host: Column, path: Column, kind: Column, asked: Column, given: Column, status: Column, sound: Column) -> list[tuple[Column, int, str]]:
    """(test, points, reason) in order; points of all that hold are added up."""
    first = is_first_party(host)
    endpoint = F.when(path == "/", path).otherwise(F.regexp_replace(path, "/$", "")) == ENDPOINT
    return [
        (~sound, -30, "malformed URL"),
        (sound & first, 40, "first-party host"),
        (sound & ~first, -60, "other host"),
        (sound & first & endpoint, 140, "search-state endpoint"),
        (sound & is_telemetry(host, path), -120, "analytics/telemetry"),
        (sound & is_static(kind, path), -90, "static asset"),
        (kind.isin("fetch", "xhr", "xmlhttprequest"), 35, "fetch/XHR"),
        (kind.isin("beacon", "ping"), -80, "beacon/ping"),
        (R.is_json_media(given), 30, "JSON response"),
        (R.is_json_media(asked), 15, "JSON request"),
        (method == "PUT", 12, "PUT"),
        (method == "GET", 4, "GET"),
        ((status >= 200) & (status < 300), 5, "successful response"),
        (status >= 400, -25, "error response"),
    ]


def add_up(rules: list[tuple[Column, int, str]]) -> tuple[Column, Column]:
    """(score, reasons) of rules."""
    on = [F.coalesce(test, F.lit(False)) for test, _, _ in rules]
    score = sum((F.when(t, points).otherwise(0) for t, (_, points, _) in zip(on, rules, strict=True)), F.lit(0))
    reasons = F.array_compact(F.array(*(F.when(t, F.lit(f"{points:+d} {reason}")) for t, (_, points, reason) in zip(on, rules, strict=True))))
    return score, reasons


def rank_candidates(entries: DataFrame, redact: Redactor | None = None) -> DataFrame:
    """Entries by how likely they are the search request: highest score first, then in their order."""
    e = F.col("entry")
    clean = redactor("link", redact or Redactor())
    rows = entries.withColumn("url", F.coalesce(clean(e["request"]["url"]), F.lit("")))
    asked, given = media_types(e)
    sound = F.col("url") != ""
    host, path = F.when(sound, host_of(F.col("url"))).otherwise(""), F.when(sound, path_of(F.col("url"))).otherwise("")
    method, kind = F.upper(e["request"]["method"]), F.lower(F.coalesce(e["_resourceType"], F.lit("")))
    score, reasons = add_up(score_rules(method, host, path, kind, asked, given, e["response"]["status"], sound))
    columns = {"score": score, "method": method, "url": F.col("url"), "host": host, "path": path, "resourceType": kind, "requestMimeType": asked, "responseMimeType": given, "reasons": reasons}
    ranked = rows.select("source_id", "entry_index", *(c.alias(n) for n, c in columns.items()))
    return ranked.orderBy("source_id", F.desc("score"), "entry_index")


def candidate_table(candidates: DataFrame) -> DataFrame:
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    cells = {"ENTRY": "entry_index", "SCORE": "score", "METHOD": "method", "TYPE": "resourceType", "HOST": "host", "PATH": "path"}
    return candidates.select(*(text(c).alias(n) for n, c in cells.items()), F.array_join("reasons", "; ").alias("REASONS"))


def is_endpoint(link: Column) -> Column:
    return link.rlike(rf"^https://(?:www\.)?{re.escape(SITE_HOST)}{re.escape(ENDPOINT)}$")


def is_referer(link: Column) -> Column:
    return link.rlike(rf"^https://(?:www\.)?{re.escape(SITE_HOST)}(?:[/?][^#]*)?$")


def is_search_entry(e: Column) -> Column:
    said = F.coalesce(e["request"]["postData"]["text"], F.lit(""))
    return (e["request"]["method"] == "PUT") & is_endpoint(e["request"]["url"]) & is_referer(header(e["request"]["headers"], "Referer", "Referrer")) & (trim_ws(said) != "")


def derive_templates(entries: DataFrame, redact: Redactor | None = None) -> DataFrame:
    """The best valid search request of each archive as a minimal, redacted document; null where it isn't usable.

    A template needs the list of results among what it asks for, and only non-empty lists of names.
    """
    redact = redact or Redactor()
    ranked = rank_candidates(entries, redact).select("source_id", "entry_index", "score")
    valid = entries.filter(is_search_entry(F.col("entry"))).join(ranked, ["source_id", "entry_index"])
    best = valid.groupBy("source_id").agg(F.max_by("entry", F.struct("score", -F.col("entry_index"))).alias("e"), F.max_by("entry_index", F.struct("score", -F.col("entry_index"))).alias("entry_index"))
    body = redactor("body", redact)(F.col("e.request.postData.text"))
    rows = best.select("source_id", "entry_index", F.col("e.request.url").alias("endpoint"), F.lit("PUT").alias("method"), redactor("link", redact)(header(F.col("e.request.headers"), "Referer", "Referrer")).alias("referer"), body.alias("body"))
    wants = F.from_json(F.get_json_object("body", "$.wants"), "map<string, array<string>>")
    rows = rows.withColumn("searchQueryState", F.get_json_object("body", "$.searchQueryState")).withColumn("wants", wants)
    full = F.forall(F.map_values("wants"), lambda v: (F.size(v) > 0) & F.forall(v, lambda x: trim_ws(x) != ""))
    listed = F.array_contains(F.try_element_at("wants", F.lit("cat1")), "listResults")
    return rows.filter(F.coalesce(full & listed, F.lit(False))).select("source_id", "entry_index", F.lit(1).alias("version"), "endpoint", "method", "referer", "searchQueryState", "wants")


def _is_named(head: Column, names: list[str]) -> Column:
    """Whether a header has one of a few names, whatever its case and the white space around it."""
    # only a name that holds one of them is trimmed
    return F.lower(head["name"]).isin(*names) | (contains_any(F.lower(head["name"]), *names) & F.lower(trim_ws(head["name"])).isin(*names))


def sanitize(entries: DataFrame, redact: Redactor | None = None, keep_bodies: bool = False) -> DataFrame:
    """Entries without cookies, comments, initiators and other headers, with secrets in links, names and bodies replaced.

    Of bodies only the search request's stays, redacted. A link that can't be read fails the job.
    """
    redact = redact or Redactor()
    link, body = redactor("link", redact), redactor("body", redact)
    token = F.lit(redact.token)
    own = [plain_key(x) for x in redact.names if x not in R.SENSITIVE]
    rows = entries.withColumn("_url", link("entry.request.url")).withColumn("_to", link("entry.response.redirectURL"))
    rows = rows.withColumn("_search", (F.col("entry.request.method") == "PUT") & is_endpoint(F.col("entry.request.url")))
    rows = rows.withColumn("_body", body(F.when(F.col("_search"), F.col("entry.request.postData.text"))))
    for side, names in (("request", R.REQUEST_HEADERS), ("response", R.RESPONSE_HEADERS)):
        # whether one of these few names is forbidden, sensitive or a link's is the same for all headers
        names = [n for n in names if plain_key(n) not in R.FORBIDDEN and not redact.sensitive(n)]
        links = [n for n in names if plain_key(n) in R.LINK_HEADERS]
        rows = rows.withColumn(f"_{side}", F.filter(f"entry.{side}.headers", lambda h: _is_named(h, names)))  # noqa: B023
        linked = F.transform(f"_{side}", lambda h: F.when(_is_named(h, links), h["value"]))  # noqa: B023
        rows = rows.withColumn(f"_{side}_links", clean_links(redact)(linked))
        rows = rows.withColumn(f"_{side}", F.zip_with(f"_{side}", f"_{side}_links", lambda h, v: h.withField("value", F.coalesce(v, h["value"])).withField("comment", F.lit(None).cast("string"))))
    e = F.col("entry")
    escaped = lambda c: (c.contains("%") | c.contains("+")) & R.is_credential(F.coalesce(F.try_url_decode(c), c))
    items = F.transform("entry.request.queryString", lambda i: F.struct(
        F.when(R.is_credential(i["name"]), token).otherwise(i["name"]).alias("name"),
        F.when(R.is_sensitive_link_key(i["name"], own) | R.is_credential(i["value"]) | escaped(i["value"]), token).otherwise(i["value"]).alias("value"),
        F.lit(None).cast("string").alias("comment"),
    ))
    params = F.transform("entry.request.postData.params", lambda p: p.withField("name", F.when(R.is_credential(p["name"]), token).otherwise(p["name"])).withField("value", F.when(p["value"] != "", token).otherwise(p["value"])).withField("fileName", F.when(p["fileName"] != "", token).otherwise(p["fileName"])).withField("comment", F.lit(None).cast("string")))
    none = F.lit(None).cast("string")
    bare = F.when(e["request"]["postData"].isNotNull(), e["request"]["postData"].withField("params", params).withField("comment", none).withField("text", F.coalesce("_body", F.lit(""))))
    unread = F.raise_error(F.lit("a link can't be sanitized")).cast("string")
    sure = lambda new, old: F.when(F.col(new).isNull() & old.isNotNull(), unread).otherwise(F.col(new))
    request = e["request"].withField("url", sure("_url", e["request"]["url"])).withField("headers", F.col("_request")).withField("queryString", items).withField("cookies", F.slice(e["request"]["cookies"], 1, 0)).withField("postData", bare).withField("comment", none)
    content = e["response"]["content"].withField("comment", none)
    if not keep_bodies:
        content = content.withField("text", none).withField("encoding", none)
    response = e["response"].withField("redirectURL", sure("_to", e["response"]["redirectURL"])).withField("headers", F.col("_response")).withField("cookies", F.slice(e["response"]["cookies"], 1, 0)).withField("content", content).withField("comment", none)
    clean = e.withField("request", request).withField("response", response).withField("cache", F.lit("{}"))
    clean = clean.withField("timings", F.when(e["timings"].isNotNull(), e["timings"].withField("comment", none)))
    for name in ("pageref", "comment", "serverIPAddress", "connection", "_initiator"):
        clean = clean.withField(name, none)
    return rows.select(*entries.drop("entry").columns, clean.alias("entry"))


def clean_links(redact: Redactor):
    @F.arrow_udf("array<string>")
    def clean(lists: pa.Array) -> pa.Array:
        return pa.array((None if xs is None else [None if x is None else redact.link(x) for x in xs] for xs in lists.to_pylist()), pa.list_(pa.string()))

    return clean


def leak_names(e: Column, redact: Redactor | None = None, keep_bodies: bool = False) -> Column:
    """What a sanitized entry still holds, by name; empty if it is clean."""
    redact = redact or Redactor()
    own = [plain_key(x) for x in redact.names if x not in R.SENSITIVE]
    link = redactor("link", redact)
    heads = F.concat(e["request"]["headers"], e["response"]["headers"])

    def one(text: str | None) -> bool:
        try:
            return bool(text) and redact.leaks(decode(text))
        except ValueError:
            return True

    @F.arrow_udf("boolean")
    def body_leaks(texts: pa.Array) -> pa.Array:
        return pa.array(map(one, texts.to_pylist()), pa.bool_())

    changed = lambda c: (F.coalesce(c, F.lit("")) != "") & ~c.eqNullSafe(link(c))
    tests = [
        ("free text", F.coalesce(e["pageref"], e["comment"], e["serverIPAddress"], e["connection"], e["_initiator"], e["request"]["comment"], e["response"]["comment"]).isNotNull()),
        ("cache", e["cache"] != "{}"),
        ("cookies", (F.size(e["request"]["cookies"]) > 0) | (F.size(e["response"]["cookies"]) > 0)),
        ("link", changed(e["request"]["url"]) | changed(e["response"]["redirectURL"])),
        ("query", F.exists(e["request"]["queryString"], lambda i: (R.is_sensitive_link_key(i["name"], own) | R.is_credential(i["value"])) & (i["value"] != redact.token))),
        ("header", F.exists(heads, lambda h: R.is_forbidden_header(h["name"]) | R.is_sensitive_key(h["name"], own))),
        ("parameter", F.exists(e["request"]["postData"]["params"], lambda p: ~F.coalesce(p["value"], F.lit("")).isin("", redact.token))),
        ("request body", body_leaks(e["request"]["postData"]["text"])),
        ("response body", F.lit(not keep_bodies) & (F.coalesce(e["response"]["content"]["text"], F.lit("")) != "")),
    ]
    return F.array_compact(F.array(*(F.when(F.coalesce(t, F.lit(False)), F.lit(n)) for n, t in tests)))


def leaks(entries: DataFrame, redact: Redactor | None = None, keep_bodies: bool = False) -> DataFrame:
    """source_id, entry_index, leak: what a sanitized archive still holds; empty if it is clean."""
    return entries.select("source_id", "entry_index", F.explode(leak_names(F.col("entry"), redact, keep_bodies)).alias("leak"))


def verified(entries: DataFrame, redact: Redactor | None = None, keep_bodies: bool = False) -> DataFrame:
    """The entries, if they hold no secret; else an error. One small job looks first."""
    first = leaks(entries, redact, keep_bodies).first()
    if first is not None:
        raise ValueError(f"entry {first.entry_index} of {first.source_id} leaks: {first.leak}")
    return entries
