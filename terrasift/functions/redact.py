"""What tells secrets: names and shapes of values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from terrasift.functions.text import any_of, contains_any, let, trim_ws

# Names of sensitive keys, normalized.
SENSITIVE = [
    "auth", "authentication", "authorization", "proxyauthorization", "bearer", "jwt", "sas", "mfa", "otp", "pin", "cookie",
    "setcookie", "password", "passwd", "pwd", "secret", "clientsecret", "apisecret", "privatekey", "accesskey", "secretkey",
    "signingkey", "signature", "sig", "passphrase", "apikey", "token", "accesstoken", "refreshtoken", "idtoken", "authtoken",
    "bearertoken", "csrf", "xsrf", "csrftoken", "xcsrftoken", "xsrftoken", "session", "sessionid", "sessiontoken", "deviceid",
    "clientid", "zuid", "credential", "credentials", "email", "emailaddress", "phone", "phonenumber", "accountid", "userid",
]
# Ends of sensitive names.
ENDINGS = [
    "apikey", "accesskey", "privatekey", "secretkey", "signingkey", "password", "passphrase", "secret", "signature", "token",
    "credential", "authorization", "auth", "sessionid", "session", "accountid", "userid", "clientid", "zuid", "sig", "jwt",
    "sas", "bearer", "mfa", "otp", "pin", "email", "phone",
]
# Names that are sensitive in links only.
IN_LINKS = [
    "code", "authcode", "authorizationcode", "oauthcode", "oauth2code", "oauthauthorizationcode", "oauth2authorizationcode",
    "oauthconsumerkey", "oauthnonce", "oauthstate", "oauthtoken", "oauthtokensecret", "oauthverifier", "codeverifier",
    "subscriptionkey", "ocpapimsubscriptionkey", "key", "state", "sessionstate", "nonce", "samlresponse", "samlrequest",
    "relaystate", "samlart", "samlartifact", "ticket", "casticket", "loginticket", "proxyticket", "serviceticket",
]
# Headers that never stay, and those that may.
FORBIDDEN = [
    "cookie", "setcookie", "auth", "authentication", "authorization", "proxyauthorization", "bearer", "jwt", "sas", "mfa",
    "otp", "pin", "xapikey", "xcsrftoken", "xxsrftoken",
]
REQUEST_HEADERS = ["accept", "content-type", "origin", "referer", "referrer"]
RESPONSE_HEADERS = ["content-type", "location", "content-location"]
LINK_HEADERS = ["referer", "referrer", "origin", "location", "contentlocation"]
# Marks of credentials in text.
MARKS = [
    "authorization:", "proxy-authorization:", "bearer ", "basic ", "cookie:", "set-cookie:", "access_token", "refresh_token",
    "id_token", "api_key", "apikey", "sessionid", "jsessionid", "csrf", "xsrf",
]
#: Every mark, in lower case, and every token of JWT's form has one of these: a cheap test that most texts fail.
HINTS, FOLDED_HINTS = [":", " ", "_", "."], ["apikey", "sessionid", "srf"]
REDACTED = "[REDACTED]"
JWT = r"^[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}$"


def normalize_key(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{Nd}]+", ""))


def _is_key(c: Column, names: list[str]) -> Column:
    return let(normalize_key(c), lambda name: name.isin(*names) | any_of([name.endswith(end) for end in ENDINGS]))


def is_sensitive_key(c: Column, more: list[str] = ()) -> Column:
    return _is_key(c, [*SENSITIVE, *more])


def is_sensitive_link_key(c: Column, more: list[str] = ()) -> Column:
    return _is_key(c, [*SENSITIVE, *more, *IN_LINKS])


def is_forbidden_header(c: Column) -> Column:
    return (c.contains(":") & trim_ws(c).startswith(":")) | normalize_key(c).isin(*FORBIDDEN)


def looks_like_jwt(c: Column) -> Column:
    return trim_ws(c).rlike(JWT)


def is_credential(c: Column) -> Column:
    may = contains_any(c, *HINTS) | let(F.lower(c), lambda low: contains_any(low, *FOLDED_HINTS))
    return F.when(may, let(trim_ws(c), lambda text: contains_any(F.lower(text), *MARKS) | text.rlike(JWT))).when(c.isNotNull(), False)


def is_json_media(c: Column) -> Column:
    media = F.lower(F.trim(F.regexp_extract(c, "^([^;]*)", 1)))
    return media.isin("application/json", "text/json") | media.endswith("+json")


def looks_like_link(c: Column) -> Column:
    return F.lower(trim_ws(c)).rlike("^(?:https?://|/)")


def looks_like_json(c: Column) -> Column:
    return trim_ws(c).rlike(r"^[{\[]")
