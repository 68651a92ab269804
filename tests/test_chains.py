"""Requests put together from events, in batch and as a stream."""

import random

import pytest
from pyspark.sql import functions as F

from terrasift.schemas import EVENT_SCHEMA
from terrasift.streaming import chains as S

NAMES = [c.split()[0] for c in EVENT_SCHEMA.replace("map<string, string>", "map").split(", ")]


def event(seq, kind, request="r", t=None, **more):
    base = dict.fromkeys(NAMES) | {"seq": seq, "event_type": kind, "request_id": request, "ts_mono": t}
    return tuple((base | more)[n] for n in NAMES)


REDIRECT = [
    event(1, "requestWillBeSent", t=1.0, url="https://h/1", method="GET", type="Document"),
    event(2, "requestWillBeSentExtraInfo", headers={"A": "1"}),
    event(3, "requestWillBeSent", t=2.0, url="https://h/2", method="GET", redirect_status=302, redirect_has_extra_info=True),
    event(4, "responseReceivedExtraInfo", headers={"Location": "https://h/2"}, status=302),
    event(5, "requestWillBeSent", t=2.0, url="https://h/dup", method="GET"),
    event(6, "responseReceived", t=3.0, status=200, has_extra_info=True, protocol="h2", mime_type="text/html"),
    event(7, "responseReceivedExtraInfo", headers={"Content-Type": "text/html", "Content-Length": "12"}, status=200),
    event(8, "loadingFinished", t=4.0, encoded_length=99),
    event(9, "requestWillBeSentExtraInfo", headers={"A": "2"}),
    event(10, "requestWillBeSentExtraInfo", request="orphan", headers={}),
]


def test_redirect(spark):
    events = spark.createDataFrame(REDIRECT, EVENT_SCHEMA)
    rows = S.hops(events)
    got = [(r.url, r.status, r.request_headers, r.incomplete) for r in rows.filter("hop >= 0").orderBy("hop").collect()]
    assert got == [("https://h/1", 302, {"A": "1"}, False), ("https://h/2", 200, {"A": "2"}, False)]
    entries = S.archive_entries(rows).collect()
    assert [(e.time, e.httpVersion, e.contentSize, e.redirectURL, e.comment) for e in entries] == [(1000.0, "", 0, "https://h/2", ""), (2000.0, "HTTP/2", 12, "", "")]
    assert S.orphan_count(rows).first()[0] == 1 and S.drain_needed(rows).first()[0]
    assert S.page_timings(events.unionByName(spark.createDataFrame([event(20, "loadEventFired", None, 3.5)], EVENT_SCHEMA))).first().onLoad == 2500.0


def test_head_of_line(spark):
    rows = [event(1, "requestWillBeSent", t=1.0, url="https://h/1"), event(2, "responseReceivedExtraInfo", headers={"x": "1"}, status=200)]
    hop = S.hops(spark.createDataFrame(rows, EVENT_SCHEMA)).first()
    assert hop.response_headers is None and hop.incomplete
    failed = [*rows, event(3, "loadingFailed", t=2.0, error=" net ")]
    hop = S.hops(spark.createDataFrame(failed, EVENT_SCHEMA)).first()
    assert hop.response_headers == {"x": "1"} and hop.error == "net"


def test_cutoff(spark):
    rows = [*REDIRECT[:7], event(11, "requestServedFromCache"), *REDIRECT[7:9], event(12, "requestWillBeSent", "late", 9.0, url="https://h/late")]
    hops = S.hops(spark.createDataFrame(rows, EVENT_SCHEMA), cutoff=3.5).orderBy("hop").collect()
    assert [(h.url, h.finished, h.from_cache) for h in hops] == [("https://h/1", 2.0, False), ("https://h/2", None, False)]
    assert hops[1].request_headers == {"A": "2"}


KINDS = ["requestWillBeSent"] * 3 + ["requestWillBeSentExtraInfo", "responseReceivedExtraInfo"] * 3 + ["responseReceived", "dataReceived", "requestServedFromCache", "loadingFinished", "loadingFailed", "other"]


def logs(n):
    """Random logs; a hop's expectation is said once, by its response or the redirect behind it."""
    rng = random.Random(3)
    for request in range(n):
        answered, rows = True, []
        for seq in range(rng.randint(1, 14)):
            kind = rng.choice(KINDS)
            more = {"headers": rng.choice([None, {"n": str(seq)}])} if kind.endswith("ExtraInfo") else {}
            if kind == "requestWillBeSent":
                more = {"url": rng.choice(["https://h/a", "http://h/b", "data:x"]), "type": rng.choice([None, "", "Fetch"])}
                if rng.random() < 0.7:
                    more |= {"redirect_status": 302, "redirect_has_extra_info": rng.choice([True, False, None])}
                answered = False
            if kind == "responseReceived":
                if answered:
                    continue
                answered, more = True, {"status": rng.choice([None, 200]), "has_extra_info": True, "type": "Document", "protocol": "h2"}
            if kind == "responseReceivedExtraInfo":
                more["status"] = rng.choice([None, 0, 204])
            if kind in ("dataReceived", "loadingFinished"):
                more = {"encoded_length": rng.choice([None, 0, 7])}
            if kind == "loadingFailed":
                more = {"error": rng.choice([None, " net "])}
            rows.append(event(seq, kind, f"r{request}", float(seq) if kind not in ("requestServedFromCache", "other") else None, **more))
        yield rows


@pytest.mark.parametrize("cutoff", [None, 6.0])
def test_windows_and_state_machine_agree(spark, cutoff):
    rows, wanted = [], []
    for log in logs(400):
        events = [dict(zip(NAMES, e, strict=True)) for e in log]
        last = None
        for e in events:  # what a redirect says of a hop that has a response or failure must be what that has said
            if e["event_type"] in ("responseReceived", "loadingFailed"):
                last = True
            elif e["event_type"] == "requestWillBeSent" and e["redirect_status"] and e["url"].startswith("http"):
                e["redirect_has_extra_info"] = last or e["redirect_has_extra_info"]
                last = None
        chain = S.Chain(cutoff=cutoff)
        for e in events:
            chain.apply(e)
        wanted += list(S.frame(chain.rows(events[0]["request_id"])).itertuples(index=False, name=None)) if events else []
        rows += [tuple(e[n] for n in NAMES) for e in events]
    got = [tuple(r) for r in S.hops(spark.createDataFrame(rows, EVENT_SCHEMA), cutoff).collect()]
    plain = lambda rows: sorted(repr(tuple(float(x) if isinstance(x, int) and not isinstance(x, bool) else x for x in r)) for r in rows)
    assert plain(got) == plain(wanted)


def test_limit(monkeypatch):
    monkeypatch.setattr(S, "MAX_PENDING", 2)
    chain = S.Chain()
    with pytest.raises(S.StateLimit):
        for i in range(3):
            chain.apply(dict(zip(NAMES, event(i, "responseReceivedExtraInfo", headers={}), strict=True)))


def test_positional_match(spark):
    hops = spark.createDataFrame([("r", 0, True, True), ("r", 1, True, False), ("r", 2, True, True), ("s", 0, False, False), ("s", 1, True, True)], "request_id string, hop int, known boolean, expected boolean")
    extra = spark.createDataFrame([("r", 5, "a"), ("r", 7, "b"), ("s", 1, "c")], "request_id string, seq int, h string")
    assert sorted(tuple(r) for r in S.positional_match(hops, extra).select("request_id", "hop", "h").collect()) == [("r", 0, "a"), ("r", 2, "b")]


def test_stream(spark, tmp_path):
    for i, part in enumerate((REDIRECT[:4], REDIRECT[4:])):
        spark.createDataFrame(part, EVENT_SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in/*"))

    def keep(batch, n):
        batch.withColumn("batch", F.lit(n)).write.mode("append").parquet(str(tmp_path / "out"))

    S.stream_hops(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination(120)
    last = S.latest(spark.read.parquet(str(tmp_path / "out")), "batch")
    batch = S.hops(spark.createDataFrame(REDIRECT, EVENT_SCHEMA))
    assert sorted(map(str, last.select(batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_bits(spark):
    df = spark.createDataFrame([("h2",), ("h3-29",), ("http/1.1",), ("x",)], "p string")
    assert [r[0] for r in df.select(S.http_version(F.col("p"))).collect()] == ["HTTP/2", "HTTP/3", "HTTP/1.1", "x"]
    heads = spark.createDataFrame([({"b": "1\n2", "A": "x"},)], "h map<string, string>")
    assert [tuple(x) for x in heads.select(S.header_rows(F.col("h"))).first()[0]] == [("A", "x"), ("b", "1"), ("b", "2")]


def test_a_longer_log_takes_more_tasks(spark, monkeypatch):
    """A task's events are bounded, whatever their bytes; a short log isn't dealt out."""
    from terrasift.schemas import EVENT_SCHEMA
    from terrasift.streaming import chains

    names = [part.split(":")[0].split()[0] for part in EVENT_SCHEMA.replace("map<string, string>", "map").split(", ")]
    row = lambda i: tuple({"seq": i, "event_type": "requestWillBeSent", "request_id": str(i), "ts_mono": 1.0, "url": f"https://h/{i}"}.get(n) for n in names)
    log = spark.createDataFrame([row(i) for i in range(60)], EVENT_SCHEMA)
    dealt = lambda: chains.hops(log)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression" not in dealt()
    monkeypatch.setattr(chains, "TASK_EVENTS", 20)
    assert "RepartitionByExpression [request_id" in dealt() and chains.hops(log).count() == 60
