"""Archives written and read: documents committed whole, ranges of any size, whole entries."""

import json
import os
import random
import stat
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from terrasift import archive_queries as Q
from terrasift.operators.capture import capture_entries, iso_time, request_cookies, response_cookies
from terrasift.schemas import ENTRY, EVENT_SCHEMA
from terrasift.sources import archive_files as S
from terrasift.sources.archive import entries, parse_archives, read_archives
from terrasift.streaming.chains import hops, needs_base64


def made(rng, depth=0):
    """A JSON value with brackets, quotes, backslashes and the names of keys that matter."""
    kind = rng.random()
    if depth > 3 or kind < 0.3:
        return rng.choice(["a", "\\", '"', "{[", "}]", '"entries":[{', 'é\\"', "x" * rng.randint(0, 40), 1, None, True, "\\\\"])
    if kind < 0.6:
        return [made(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    return {rng.choice(["log", "entries", "version", "k", '"', "\\"]): made(rng, depth + 1) for _ in range(rng.randint(0, 4))}


def document(rng):
    """(text, its entries): keys in any order, compact or indented, with decoys under other keys."""
    wanted = [{"i": i, "x": made(rng)} for i in range(rng.randint(0, 6))]
    parts = [("version", "1.2"), ("pages", [made(rng) for _ in range(2)]), ("entries", wanted), ("creator", made(rng)), ("z", {"entries": [{"bad": 1}]})]
    rng.shuffle(parts)
    doc = {"m": {"entries": [{"no": 1}], "version": "9"}, "log": dict(parts), "o": made(rng)}
    if rng.random() < 0.5:
        doc = dict(reversed(doc.items()))
    return json.dumps(doc, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1, 4]), separators=rng.choice([None, (",", ":"), (" , ", " : ")])), wanted


class Batch:
    """What the planning step looks at."""

    def __init__(self, path, ranges):
        self.columns = {"path": [path], "ranges": [ranges]}

    def column(self, name):
        return type("Column", (), {"to_pylist": lambda _: self.columns[name]})()


def by_ranges(path, size):
    length = os.path.getsize(path)
    with S.Bytes(str(path), length) as file:
        ranges = [{"start": at, "ways": [S.scanned(file, at, size, state) for state in (S.OUTSIDE, S.INSIDE, S.ESCAPED)]} for at in range(0, length, size)]
        plan = next(S._planned([Batch(str(path), ranges)])).to_pylist()
        return [x for r in plan for x in S.entries_from(file, r["start"], size, r["state"], r["depth"], r["logged"], r["inside"])]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 16, 64, 1000])
def test_ranges(tmp_path, size):
    """Ranges that cut keys, escapes and brackets give the entries of the whole."""
    rng = random.Random(size)
    for i in range(40 if size < 4 else 150):
        text, wanted = document(rng)
        path = tmp_path / f"{i}.har"
        path.write_text(text, encoding="utf-8")
        found = by_ranges(path, size)
        assert [json.loads(x) for _, x in found] == wanted
        assert all(text.encode()[at : at + len(x)] == x for at, x in found)


@pytest.mark.parametrize("size", [1, 5, 16, 64, 1000])
def test_ranges_are_counted_by_the_first_pass(tmp_path, size):
    """The plan tells how many entries begin in each range, as a pass over them would count them."""
    rng = random.Random(100 + size)
    for i in range(20 if size < 4 else 100):
        path = tmp_path / f"{i}.har"
        path.write_text(text := document(rng)[0], encoding="utf-8")
        with S.Bytes(str(path), length := os.path.getsize(path)) as file:
            ranges = [{"start": at, "ways": [S.scanned(file, at, size, state) for state in (S.OUTSIDE, S.INSIDE, S.ESCAPED)]} for at in range(0, length, size)]
            for r in next(S._planned([Batch(str(path), ranges)])).to_pylist():
                known = S.entries_from(file, r["start"], size, r["state"], r["depth"], r["logged"], r["inside"], whole=False)
                assert r["n"] == sum(1 for _ in known), (text, r)


def made_entries(spark, n, sources=2):
    """Entries of several sources, with what JSON has to escape."""
    rows = spark.range(n).select(F.concat(F.lit("s/"), (F.col("id") % sources).cast("string")).alias("source_id"), F.col("id").alias("entry_index"), F.concat(F.lit('{"startedDateTime":"x","time":1.5,"request":{"method":"GET","url":"https://h/'), F.col("id").cast("string"), F.lit('"},"response":{"status":200,"content":{"size":1,"text":"{[\\\\\\" \\u00e9 ]}"}},"_initiator":{"a":[1,"}"]}}')).alias("text"))
    return rows.select("source_id", "entry_index", F.from_json("text", ENTRY).alias("entry"))


def test_round_trip(spark, tmp_path):
    """Written entries, read whole and in ranges; every document is a task's of its own."""
    rows, path = made_entries(spark, 95), str(tmp_path / "out")
    S.save_archives(rows, path, each=20)
    names = sorted(os.listdir(path))
    assert names == [f"s%2F{s}-0000000{n}.har" for s in range(2) for n in range(5)]
    assert all(stat.S_IMODE(os.stat(f"{path}/{n}").st_mode) == 0o600 for n in names)
    whole = json.loads(Path(path, names[0]).read_text())
    assert whole["log"]["version"] == "1.2" and whole["log"]["entries"][0]["cache"] == {} and whole["log"]["entries"][0]["_initiator"] == {"a": [1, "}"]}
    assert all(k in whole["log"]["entries"][0]["request"] for k in ("headers", "queryString", "cookies")) and whole["log"]["entries"][0]["timings"]["send"] == 0
    known = entries(read_archives(spark, path)).selectExpr("regexp_extract(source_id, '[^/]+$', 0) AS d", "entry_index AS i", "to_json(entry) AS e")
    split = S.indexed(S.split_entries(spark, f"{path}/*.har", size=700)).selectExpr("regexp_extract(source_id, '[^/]+$', 0) AS d", "entry_index AS i", "to_json(entry) AS e")
    rows_of = lambda df: sorted(map(tuple, df.collect()))
    # names come back with their escapes undone from one of the two
    assert [(i, e) for _, i, e in rows_of(split)] == [(i, e) for _, i, e in rows_of(known)] and split.count() == 95
    assert S.split_entries(spark, f"{path}/*.har", size=700).select("source_id", "range").distinct().count() > 10


def test_numbers_without_a_second_read(spark, tmp_path, monkeypatch):
    """Ranges are counted first: entries get their places without a join, in ranges shorter than an entry as well."""
    path = str(tmp_path / "out")
    S.save_archives(made_entries(spark, 95), path, each=20)
    place = lambda df: sorted(map(tuple, df.selectExpr("source_id", "entry_index", "to_json(entry)").collect()))
    known = place(S.indexed(S.split_entries(spark, f"{path}/*.har", size=700)))
    for size in (60, 700, 1 << 20):
        rows = S.numbered_entries(spark, f"{path}/*.har", size)
        assert place(rows) == known
        plan = rows._jdf.queryExecution().optimizedPlan().toString()
        assert "Join" not in plan and plan.count("MapInArrow") == 1


def test_entries_are_cleaned_as_they_are_read(spark, monkeypatch):
    """What needs documents once doesn't keep their entries as a table, and a folder is listed without a job of many tasks."""
    rows, asked = made_entries(spark, 30), []
    monkeypatch.setattr(Q, "recorded_entries", lambda *_: rows)
    read = Q.numbered_entries
    monkeypatch.setattr(Q, "numbered_entries", lambda spark, path, size: asked.append(path) or read(spark, path, size))
    found = Q.archive_sanitized(spark, "")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Join" not in plan and not any("*" in path for path in asked)
    assert found.count() == 30 and {r.leaks for r in found.collect()} == {0}


def test_little_is_read_behind_a_range(tmp_path):
    """Of what follows a range only its last entry's rest is read; for counting nothing."""
    body = ",".join('{"a":"' + "x" * 300 + '"}' for _ in range(4000))
    (tmp_path / "a").write_text(text := '{"log":{"version":"1.2","entries":[' + body + "]}}")
    sizes = []
    with S.Bytes(str(tmp_path / "a"), len(text)) as file:
        get = file.get
        file.get = lambda start, end: sizes.append(end - start) or get(start, end)
        found = [x for x, _ in S.entries_from(file, 0, 500_000, S.OUTSIDE, 0, False, False)]
        assert sum(sizes) < 520_000
        sizes.clear()
        assert found == [x for x, _ in S.entries_from(file, 0, 500_000, S.OUTSIDE, 0, False, False, whole=False)] and sum(sizes) < 502_000


def test_ranges_are_dealt(spark, tmp_path):
    """One large document is read by many tasks."""
    S.save_archives(made_entries(spark, 400, sources=1), str(tmp_path / "one"))
    rows = S.split_entries(spark, str(tmp_path / "one"), size=2000)
    assert rows.select(F.spark_partition_id()).distinct().count() > 1 and rows.select("range").distinct().count() > 20
    assert sorted(r.url for r in rows.select("entry.request.url").collect()) == sorted(f"https://h/{i}" for i in range(400))


def test_nothing_shows_of_a_failed_write(spark, tmp_path):
    rows = made_entries(spark, 60)
    failing = rows.withColumn("entry", F.when(F.col("entry_index") == 59, F.raise_error(F.lit("stop")).cast(ENTRY)).otherwise(F.col("entry")))
    with pytest.raises(Exception, match="stop"):
        S.save_archives(failing, str(tmp_path / "out"), each=10)
    left = [p for p in tmp_path.rglob("*") if p.is_file()]
    assert left == []


def test_documents_there(spark, tmp_path):
    path = str(tmp_path / "out")
    S.save_archives(made_entries(spark, 4), path)
    with pytest.raises(Exception, match="there already"):
        S.save_archives(made_entries(spark, 4), path)
    S.save_archives(made_entries(spark, 3, sources=1), path, mode="overwrite")
    assert os.listdir(path) == ["s%2F0-00000000.har"]
    assert S.split_entries(spark, path).count() == 3
    with pytest.raises(Exception, match="document, head and entry"):
        spark.range(1).write.format("http_archive").mode("append").save(path)


@pytest.mark.parametrize(("text", "match"), [('{"log":{"entries":[]}}', "version is required"), ('{"log":{"version":"1.1","entries":[]}}', "unsupported version 1.1"), ('{"log":{"version":"1.\\u0032","entries":[]}}', "version is required")])
def test_versions(spark, tmp_path, text, match):
    (tmp_path / "a.har").write_text(text)
    with pytest.raises(Exception, match=match):
        S.split_entries(spark, str(tmp_path), size=5).collect()


def test_empty(spark, tmp_path):
    (tmp_path / "a.har").write_text('{"log":{"version":"1.2","entries":[]}}')
    (tmp_path / "b.har").write_text("")
    assert S.indexed(S.split_entries(spark, str(tmp_path), size=5)).count() == 0
    S.save_archives(made_entries(spark, 0), str(tmp_path / "none"))


NAMES = [c.split()[0] for c in EVENT_SCHEMA.replace("map<string, string>", "map").split(", ")]
WHOLE = f"{EVENT_SCHEMA}, status_text string, post_data string, body binary"


def event(seq, kind, request="r", t=None, **more):
    base = dict.fromkeys([*NAMES, "status_text", "post_data", "body"]) | {"seq": seq, "event_type": kind, "request_id": request, "ts_mono": t, "ts_wall": t}
    return tuple((base | more)[n] for n in [*NAMES, "status_text", "post_data", "body"])


def captured(spark, rows):
    return [r.entry for r in capture_entries(hops(spark.createDataFrame(rows, WHOLE), whole=True), F.lit("s")).orderBy("entry_index").collect()]


def test_whole_entries(spark):
    rows = [
        event(1, "requestWillBeSent", t=1.5, url="https://h/p?a=1&b=x%20y&a=", method="POST", headers={"A": "told"}, post_data="q=é"),
        event(2, "requestWillBeSentExtraInfo", headers={"Content-Type": "application/x-www-form-urlencoded", "cookie": 'a="1"; b b=2; c'}),
        event(3, "responseReceived", t=2.0, status=200, status_text="OK", has_extra_info=True, protocol="h2", headers={"content-type": "told"}),
        event(4, "responseReceivedExtraInfo", headers={"Content-Type": "text/html; charset=x", "Set-Cookie": "s=fresh; Path=/; Secure; HttpOnly; SameSite=Lax\nbad", "Location": "/n", "content-length": "7"}, status=203),
        event(5, "responseBody", body=bytearray("<é>".encode())),
        event(6, "loadingFinished", t=3.0, encoded_length=4),
        event(7, "requestWillBeSent", "plain", t=4.0, url="https://h/i", method="GET", headers={"B": "2\n3", "a": "1"}),
        event(8, "responseReceived", "plain", t=4.5, status=204, has_extra_info=False, headers={"X": "y"}),
        event(9, "responseBody", "plain", body=bytearray(b"\xff")),
        event(10, "requestWillBeSent", "image", t=5.0, url="https://h/j", method="GET"),
        event(11, "responseReceived", "image", t=5.25, status=200, has_extra_info=False, mime_type="image/png"),
        event(12, "responseBody", "image", body=bytearray(b"\xff\x00")),
    ]
    first, plain, image = captured(spark, rows)
    assert [(h.name, h.value) for h in first.request.headers] == [("Content-Type", "application/x-www-form-urlencoded"), ("cookie", 'a="1"; b b=2; c')]
    assert [(c.name, c.value) for c in first.request.cookies] == [("a", "1"), ("c", "")]
    assert [(q.name, q.value) for q in first.request.queryString] == [("a", "1"), ("b", "x y"), ("a", "")]
    assert (first.request.postData.text, first.request.postData.mimeType, first.request.bodySize) == ("q=é", "application/x-www-form-urlencoded", 4)
    assert (first.response.status, first.response.statusText, first.response.redirectURL) == (203, "OK", "/n")
    assert [(c.name, c.value, c.path, c.secure, c.httpOnly, c.sameSite) for c in first.response.cookies] == [("s", "fresh", "/", True, True, "Lax")]
    assert (first.response.content.text, first.response.content.encoding, first.response.content.size) == ("<é>", None, 4)
    assert (first.startedDateTime, first.time, first.timings.wait, first.timings.receive, first.comment) == ("1970-01-01T00:00:01.5Z", 1500.0, 500.0, 1000.0, None)
    assert [(h.name, h.value) for h in plain.request.headers] == [("a", "1"), ("B", "2"), ("B", "3")] and plain.request.postData is None
    assert plain.response.content.text is None and plain.response.content.size == 0 and [h.name for h in plain.response.headers] == ["X"]
    assert (image.response.content.text, image.response.content.encoding, image.response.content.size, image.response.content.mimeType) == ("/wA=", "base64", 2, "image/png")


def test_entries_survive_documents(spark, tmp_path):
    rows = [event(1, "requestWillBeSent", t=1.5, url="https://h/p?a=1", method="GET", headers={"A": 'q"\\'}), event(2, "responseReceived", t=2.0, status=200, has_extra_info=False), event(3, "loadingFinished", t=3.0)]
    found = capture_entries(hops(spark.createDataFrame(rows, WHOLE), whole=True), F.lit("s"))
    S.save_archives(found, str(tmp_path))
    text = next(tmp_path.glob("*.har")).read_text()
    assert entries(parse_archives(spark.createDataFrame([("s", text)], "source_id string, document string"))).first().entry.request.headers[0].value == 'q"\\'


def test_cookies(spark):
    pairs = "array<struct<name: string, value: string>>"
    rows = [[("Set-Cookie", 'a="x y"; Expires=Wed, 21 Oct 2026 07:28:00 GMT; DOMAIN=h; domain=i; samesite=None')], [("set-cookie", "b=1; expires=Wed, 21-Oct-2026 07:28:00 GMT")], [("Set-Cookie", "c=1; expires=tomorrow; SameSite=odd")], [("Set-Cookie", "n o=1"), ("Set-Cookie", "only"), ("Set-Cookie", 'v="'), ("Cookie", "x=1; ; y=\\; z=1=2")]]
    df = spark.createDataFrame([(r,) for r in rows], f"h {pairs}").select(response_cookies(F.col("h")).alias("r"), request_cookies(F.col("h")).alias("q")).collect()
    assert [[(c.name, c.value, c.expires, c.domain, c.sameSite) for c in x.r] for x in df] == [[("a", "x y", "2026-10-21T07:28:00Z", "i", "None")], [("b", "1", "2026-10-21T07:28:00Z", None, None)], [("c", "1", None, None, None)], []]
    assert [(c.name, c.value) for c in df[3].q] == [("x", "1"), ("z", "1=2")]


def test_entries_are_not_cast_whole(spark):
    """Entries have the fields of ENTRY as they are put together: no second copy of each is made for the sake of its type."""
    found = capture_entries(hops(spark.createDataFrame([], WHOLE), whole=True), F.lit("s"))
    assert found.select("entry").schema.simpleString() == f"struct<entry:{spark.createDataFrame([], f'e {ENTRY}').schema['e'].dataType.simpleString()}>"
    assert "cast(struct(pageref" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_times_and_bodies(spark):
    times = spark.createDataFrame([(0.0,), (1767225600.25,), (-0.5,), (1e9 + 1e-6,)], "t double").select(iso_time(F.col("t"))).collect()
    assert [t[0] for t in times] == ["1970-01-01T00:00:00Z", "2026-01-01T00:00:00.25Z", "1969-12-31T23:59:59.5Z", "2001-09-09T01:46:40.000001Z"]
    kinds = [("text/html", b"a"), ("", b"a"), ("image/png", b"a"), ("image/svg+xml; x", b"a"), ("text/html", b"\xff"), ("application/ld+json", b"{}")]
    df = spark.createDataFrame([(m, bytearray(b)) for m, b in kinds], "m string, b binary").select(needs_base64(F.col("m"), F.col("b")))
    assert [r[0] for r in df.collect()] == [False, False, True, False, True, False]


def test_small_ranges_share_tasks(spark, tmp_path):
    """Passes over many small ranges take as many tasks as their bytes ask for, not one for each range."""
    path = str(tmp_path / "out")
    S.save_archives(made_entries(spark, 95), path, each=20)
    found = S.split_entries(spark, f"{path}/*.har", 40)
    assert found.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
    assert found.count() == 95
