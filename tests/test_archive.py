"""Ranking, redaction and derivation of recorded requests."""

import json

import pytest
from pyspark.sql import functions as F

from terrasift.functions import redact as R
from terrasift.operators import archive as A
from terrasift.sources.archive import entries, parse_archives, query_items, ready_to_save

BODY = {"searchQueryState": {"a": 1.50, "token": "s3cret"}, "wants": {"cat1": ["listResults"]}, "other": 1}


def entry(url, method="GET", kind="fetch", status=200, mime="application/json", body=None, headers=(), **more):
    post = {} if body is None else {"postData": {"mimeType": "application/json", "text": json.dumps(body), "params": []}}
    request = {"method": method, "url": url, "httpVersion": "h2", "headers": [{"name": n, "value": v} for n, v in headers], "queryString": [{"name": "api_key", "value": "x"}, {"name": "q", "value": "y"}], "cookies": [{"name": "c", "value": "v"}], "headersSize": -1, "bodySize": 0} | post
    response = {"status": status, "statusText": "", "httpVersion": "h2", "headers": [{"name": "Set-Cookie", "value": "s"}, {"name": "Content-Type", "value": mime}], "cookies": [], "content": {"size": 1, "mimeType": mime, "text": "body"}, "redirectURL": "", "headersSize": -1, "bodySize": 1}
    return {"startedDateTime": "2026-01-01T00:00:00Z", "time": 1.5, "request": request, "response": response, "cache": {}, "timings": {"send": 0, "wait": 1, "receive": 0.5}, "_resourceType": kind, "comment": "x"} | more


@pytest.fixture(scope="module")
def archive(spark):
    rows = [
        entry("https://cdn.example.org/app.js", kind="script", mime="text/javascript"),
        entry("https://www.zillow.com/collect?access_token=1", kind="ping", status=500),
        entry("https://www.zillow.com/async-create-search-page-state", "PUT", body=BODY, headers=[("Referer", "https://www.zillow.com/x?code=1"), ("Authorization", "Bearer q"), ("Accept", "*/*")]),
        entry("https://user:pw@www.zillow.com/session/abc/x;sid=1?jwt=aaaaaaaa.bbbbbbbb.cccccccc&u=https%3A%2F%2Fh%2F%3Ftoken%3D1#frag"),
    ]
    doc = {"log": {"version": "1.2", "creator": {"name": "n", "version": "1"}, "entries": rows, "vendor": 1}}
    return entries(parse_archives(spark.createDataFrame([("h", json.dumps(doc))], "source_id string, document string")))


def test_version(spark):
    bad = spark.createDataFrame([("h", '{"log":{"version":"1.1","entries":[]}}')], "source_id string, document string")
    with pytest.raises(Exception, match="unsupported version"):
        parse_archives(bad).collect()


def test_rank(archive):
    rows = A.rank_candidates(archive).collect()
    assert [(r.entry_index, r.score) for r in rows] == [(2, 277), (3, 114), (0, -141), (1, -151)]
    assert rows[0].reasons == ["+40 first-party host", "+140 search-state endpoint", "+35 fetch/XHR", "+30 JSON response", "+15 JSON request", "+12 PUT", "+5 successful response"]
    assert A.candidate_table(A.rank_candidates(archive)).columns == ["ENTRY", "SCORE", "METHOD", "TYPE", "HOST", "PATH", "REASONS"]


def test_sanitize(archive):
    assert A.leaks(archive).count() > 0
    clean = A.verified(A.sanitize(archive))
    assert A.leaks(clean).count() == 0
    again = A.sanitize(clean)
    assert sorted(map(str, clean.collect())) == sorted(map(str, again.collect()))
    text = json.dumps([r.asDict(True) for r in clean.collect()])
    for secret in ("s3cret", "Bearer", "user:pw", "aaaaaaaa", "Set-Cookie", "/abc/", "#frag", '"body"'):
        assert secret not in text, secret
    put = clean.filter("entry_index = 2").first().entry
    assert json.loads(put.request.postData.text) == {"searchQueryState": {"a": 1.5, "token": "[REDACTED]"}, "wants": {"cat1": ["listResults"]}}
    assert [h.name for h in put.request.headers] == ["Referer", "Accept"] and put.request.headers[0].value == "https://www.zillow.com/x?code=%5BREDACTED%5D"
    assert [(q.name, q.value) for q in put.request.queryString] == [("[REDACTED]", "[REDACTED]"), ("q", "y")]


def test_links():
    r = A.Redactor()
    cases = {
        "https://u:p@h/a?b=1#f": "https://h/a?b=1", "/token/xyz/ok": "/token/%5BREDACTED%5D/ok", "/a;token=1;b=2": "/a;token=%5BREDACTED%5D;b=2",
        "//h/p?x=1;key=2&y": "//h/p?x=1;key=%5BREDACTED%5D&y", "https://h/?q=%zz": "https://h/", "https://h/?j=%7B%22pin%22%3A1%7D": "https://h/?j=%7B%22pin%22%3A%22%5BREDACTED%5D%22%7D",
    }
    for link, clean in cases.items():
        assert r.link(link) == clean and r.link(clean) == clean
    assert r.value({"a": ['{"password":"x","n":1e3}', "plain", "{broken"], "Email": 5}) == {"a": ['{"n":1e3,"password":"[REDACTED]"}', "plain", "[REDACTED]"], "Email": "[REDACTED]"}
    with pytest.raises(ValueError):
        A.Redactor("a/b")
    assert A.Redactor(more=["My Field"]).sensitive("my-field")


def test_links_as_they_are_split():
    """Links that need no putting right take a shorter way to the same text, and what repeats is remembered."""
    r = A.Redactor()
    rests = ["", "/", "/a/12/b", "/token/12/b", "/token//b", "/12/token", "/a;pin=1;x=2/c", "?", "?a=1&token=2;b", "/p?q=a%20b+c&key=", "/p?a=%zz#f", "/p#f?x=1", "/apikey-1?csrf", "/x=/y", "/p?u=https%3A%2F%2Fh%2F%3Fpin%3D1"]
    for rest in rests:
        # a user keeps the link from the shorter way
        assert r.link(f"https://h.org:1{rest}") == r.link(f"https://u@h.org:1{rest}") == r.new_link(f"https://h.org:1{rest}"), rest
    assert list(map(A.plain_key, ["aB-c_1", "É-Σ", "ab1"])) == ["abc1", "éσ", "ab1"]
    before = A.Redactor.known_link.cache_info().hits
    assert {r.link("https://h.org/homes/?page=1") for _ in range(50)} == {"https://h.org/homes/?page=1"}
    assert A.Redactor.known_link.cache_info().hits >= before + 49
    assert A.Redactor(more=["q"]).link("https://h.org/?q=1") == "https://h.org/?q=%5BREDACTED%5D" and r.link("https://h.org/?q=1") == "https://h.org/?q=1"


def test_cheap_tests_come_first(spark):
    """No mark or token gets past the hints, and columns tell secrets as the redactor does."""
    assert all(any(hint in mark for hint in R.HINTS + R.FOLDED_HINTS) for mark in R.MARKS)
    r, texts = A.Redactor(), [*R.MARKS, *(f" x{m.upper()}y\u00a0" for m in R.MARKS), "bearer ", "basic", "aaaaaaaa.bbbbbbbb.cccccccc", "a.b", "12", "", "t1", "token", "My-Token ", "content-type", "key", " :path", "x:y", "Set-Cookie"]
    c = F.col("c")
    rows = spark.createDataFrame([(t,) for t in [*texts, None]], "c string").select("c", R.is_credential(c), R.is_sensitive_key(c), R.is_sensitive_link_key(c), R.is_forbidden_header(c)).collect()
    assert [tuple(row)[1:4] for row in rows[:-1]] == [(r.credential(t), r.sensitive(t), r.sensitive_in_link(t)) for t in texts]
    assert {row.c for row in rows if row[4]} == {"authorization:", "proxy-authorization:", "bearer ", "cookie:", "set-cookie:", " :path", "Set-Cookie"} and tuple(rows[-1]) == (None,) * 5
    names = spark.createDataFrame([(n,) for n in ["Accept", "\u00a0accept ", "x-accept", "Content-Type", "", None]], "name string").select(A._is_named(F.struct("name"), ["accept", "content-type"]))
    assert [row[0] for row in names.collect()] == [True, True, False, True, False, None]


def test_derive(archive):
    row = A.derive_templates(archive).first()
    assert (row.entry_index, row.method, row.referer) == (2, "PUT", "https://www.zillow.com/x?code=%5BREDACTED%5D")
    assert row.wants == {"cat1": ["listResults"]} and "s3cret" not in row.searchQueryState


def test_query_items_and_save(spark, archive):
    df = spark.createDataFrame([("https://h/p?a=1&b=c%20d&e&bad=%zz#x",)], "u string").select(query_items(F.col("u")).alias("q"))
    assert [tuple(i) for i in df.first().q] == [("a", "1"), ("b", "c d"), ("e", ""), ("bad", "%zz")]
    saved = archive.select(ready_to_save(F.col("entry")).alias("entry")).first().entry
    assert saved.cache == "{}" and saved.request.cookies[0].name == "c"


def test_leaks_beside_what_is_left(spark, archive):
    """What an entry still holds can be told in the pass that cleans it, by the same names."""
    rows = archive
    told = rows.select("source_id", "entry_index", F.explode(A.leak_names(F.col("entry"))).alias("leak"))
    known = sorted(map(tuple, A.leaks(rows).collect()))
    assert known and sorted(map(tuple, told.collect())) == known
    assert sorted({tuple(r.n) for r in A.sanitize(rows).select(A.leak_names(F.col("entry")).alias("n")).collect()}) == [()]
