"""Browser events to requests: a recorded log by windows, a stream by a keyed state machine.

A request id has a chain of hops, one for each redirect. Supplements (headers as sent) arrive apart from the events they
belong to and in any order; the nth one goes to the nth hop that expects one, and waits while an earlier hop's
expectation isn't known. A stream's state is bounded by key: ``MAX_HOPS`` hops and ``MAX_PENDING`` waiting supplements;
more fail.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterable, Iterator
from dataclasses import asdict, dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from terrasift.functions.text import let

MAX_HOPS, MAX_PENDING = 10_000, 10_000
#: Events of a recorded log that one task sorts, about: more go over more tasks.
TASK_EVENTS = 250_000
#: Supplements without a request that a key holds after the cutoff.
MAX_ORPHANS = 32

HOP = (
    "request_id string, hop int, seq bigint, url string, method string, type string, started double, started_wall double, status int, response_at double, "
    "finished double, last double, encoded_length bigint, body_length bigint, decoded_length bigint, protocol string, mime_type string, error string, from_cache boolean, "
    "finished_loading boolean, request_headers map<string, string>, response_headers map<string, string>, incomplete boolean, orphans int"
)


class StateLimit(RuntimeError):
    """A key has outgrown its state."""


@dataclass
class Hop:
    seq: int
    url: str
    method: str | None
    type: str | None
    started: float
    started_wall: float | None
    status: int | None = None
    response_at: float | None = None
    finished: float | None = None
    last: float | None = None
    encoded_length: int = 0
    body_length: int = 0
    decoded_length: int = 0
    protocol: str | None = None
    mime_type: str | None = None
    error: str | None = None
    from_cache: bool = False
    finished_loading: bool = False
    failed: bool = False
    known: bool = False
    expected: bool = False
    request_extra: dict | None = None
    response_extra: dict | None = None


def present(value: object) -> bool:
    return value is not None and value == value


@dataclass
class Chain:
    """The state of one request id."""

    hops: list[Hop] = field(default_factory=list)
    request_pending: list[dict] = field(default_factory=list)
    response_pending: list[dict] = field(default_factory=list)
    cutoff: float | None = None

    @classmethod
    def load(cls, text: str) -> Chain:
        held = json.loads(text)
        return cls(**{**held, "hops": [Hop(**hop) for hop in held["hops"]]})

    def dump(self) -> str:
        return json.dumps(asdict(self))

    def apply(self, e: dict) -> None:
        kind = e["event_type"]
        supplement = kind.endswith("ExtraInfo")
        if self.cutoff is not None and not supplement:
            # events behind the cutoff, and the ones that carry no time, change nothing any more
            if not present(e["ts_mono"]) or e["ts_mono"] > self.cutoff:
                return
        getattr(self, f"on_{kind}", lambda e: None)(e)

    def on_requestWillBeSent(self, e: dict) -> None:  # noqa: N802
        redirect = present(e["redirect_status"])
        if not str(e["url"]).lower().startswith(("http://", "https://")) or (self.hops and not redirect):
            return  # a repeated base event
        if redirect and self.hops:
            last = self.hops[-1]
            if last.status is None:
                last.status = int(e["redirect_status"])
            last.finished = e["ts_mono"] if last.finished is None else last.finished
            last.finished_loading = True
            self.expect(last, bool(present(e["redirect_has_extra_info"]) and e["redirect_has_extra_info"]))
        if len(self.hops) >= MAX_HOPS:
            raise StateLimit(f"more than {MAX_HOPS} hops of a request")
        wall = e["ts_wall"] if present(e["ts_wall"]) else None
        self.hops.append(Hop(int(e["seq"]), e["url"], e["method"], e["type"], e["ts_mono"], wall, last=e["ts_mono"]))
        self.reconcile()

    def pend(self, queue: list[dict], e: dict) -> None:
        limit = MAX_PENDING if self.hops or self.cutoff is None else MAX_ORPHANS
        if len(queue) >= limit:
            if self.cutoff is not None and not self.hops:
                return
            raise StateLimit(f"more than {MAX_PENDING} supplements wait for a request")
        queue.append({"headers": dict(e["headers"] or {}) if e["headers"] is not None else {}, "status": int(e["status"]) if present(e["status"]) else None})
        if self.hops and self.hops[-1].failed and not self.hops[-1].known:
            self.expect(self.hops[-1], True)
        self.reconcile()

    def on_requestWillBeSentExtraInfo(self, e: dict) -> None:  # noqa: N802
        self.pend(self.request_pending, e)

    def on_responseReceivedExtraInfo(self, e: dict) -> None:  # noqa: N802
        self.pend(self.response_pending, e)

    def on_responseReceived(self, e: dict) -> None:  # noqa: N802
        if self.hops:
            hop = self.hops[-1]
            hop.status, hop.response_at = int(e["status"]) if present(e["status"]) else None, e["ts_mono"]
            hop.protocol, hop.mime_type, hop.type = e["protocol"], e["mime_type"], hop.type or e["type"]
            self.saw(hop, e)
            self.expect(hop, bool(present(e["has_extra_info"]) and e["has_extra_info"]))

    def on_dataReceived(self, e: dict) -> None:  # noqa: N802
        if self.hops:
            self.saw(self.hops[-1], e)
            if present(e["encoded_length"]) and e["encoded_length"] > 0:
                self.hops[-1].body_length += int(e["encoded_length"])

    def on_requestServedFromCache(self, e: dict) -> None:  # noqa: N802
        if self.hops:
            self.hops[-1].from_cache = True

    def on_loadingFinished(self, e: dict) -> None:  # noqa: N802
        if self.hops:
            hop = self.hops[-1]
            hop.finished, hop.finished_loading = e["ts_mono"], True
            hop.encoded_length = int(e["encoded_length"]) if present(e["encoded_length"]) else 0
            self.saw(hop, e)

    def on_loadingFailed(self, e: dict) -> None:  # noqa: N802
        if self.hops:
            hop = self.hops[-1]
            hop.finished, hop.failed, hop.error = e["ts_mono"], True, (e["error"] or "").strip()
            self.saw(hop, e)
            if not hop.known and (self.request_pending or self.response_pending):
                self.expect(hop, True)

    def saw(self, hop: Hop, e: dict) -> None:
        if present(e["ts_mono"]):
            hop.last = max(hop.last or e["ts_mono"], e["ts_mono"])

    def expect(self, hop: Hop, expected: bool) -> None:
        hop.known, hop.expected = True, expected
        self.reconcile()

    def reconcile(self) -> None:
        """Hands waiting supplements to hops in order; the first hop that isn't known blocks those behind it."""
        for name, queue in (("request_extra", self.request_pending), ("response_extra", self.response_pending)):
            for hop in self.hops:
                if not hop.known or (hop.expected and getattr(hop, name) is None and not queue):
                    break
                if hop.expected and getattr(hop, name) is None:
                    setattr(hop, name, queue.pop(0))

    def rows(self, request_id: str) -> Iterator[dict]:
        orphans = 0 if self.hops else len(self.request_pending) + len(self.response_pending)
        if not self.hops and orphans:
            yield {"request_id": request_id, "hop": -1, "orphans": orphans, "incomplete": True}
        for i, hop in enumerate(self.hops):
            row = asdict(hop)
            sent, got = row.pop("request_extra"), row.pop("response_extra")
            known, expected = row.pop("known"), row.pop("expected")
            row.pop("failed")
            if got and got["status"]:
                row["status"] = got["status"]
            yield row | {
                "request_id": request_id, "hop": i, "orphans": 0, "request_headers": (sent or {}).get("headers"), "response_headers": (got or {}).get("headers"),
                "incomplete": not known or (expected and (sent is None or got is None)),
            }


HOP_COLUMNS = [part.split()[0] for part in HOP.replace("map<string, string>", "map").split(", ")]


def frame(rows: Iterable[dict]) -> pd.DataFrame:
    return pd.DataFrame(list(rows), columns=HOP_COLUMNS).astype(object).where(lambda f: f.notna(), None)


#: What hops have beside HOP if whole entries are made of them, and columns of events that may be missing.
WHOLE = "told_request_headers map<string, string>, told_response_headers map<string, string>, status_text string, post_data string, body binary"
OPTIONAL = {"status_text": "string", "post_data": "string", "body": "binary"}


def hops(events: DataFrame, cutoff: float | None = None, whole: bool = False) -> DataFrame:
    """Hops of a recorded log, each request id by itself in the order of ``seq``.

    One shuffle by request id: running counts give each event its hop and each supplement its number, an aggregation
    makes rows of both, and a second one puts the nth supplement to the nth hop that expects one. What a hop expects is
    what was last said of it; all hops but a request's last are known, as a redirect has closed them. Supplements of
    requests without a hop are counted as orphans. More than MAX_HOPS hops of a request fail.

    The events are counted first, so that a longer log takes more tasks, not larger ones.

    With ``whole`` also what is needed for entries with headers and bodies: the columns of WHOLE. A request may have
    ``post_data``, a response ``status_text``, and an event "responseBody" the ``body`` of the hop it follows.
    """
    # a task holds its events while it sorts them; partitions put together by their bytes would grow with the log
    if (total := events.count()) > TASK_EVENTS:
        events = events.repartition(math.ceil(total / TASK_EVENTS), "request_id")
    for name, kind_of in OPTIONAL.items() if whole else ():
        events = events if name in events.columns else events.withColumn(name, F.lit(None).cast(kind_of))
    kind, seq, at = F.col("event_type"), F.col("seq"), F.col("ts_mono")
    is_ = lambda *names: kind.isin(*names)
    asked, answered = is_("requestWillBeSentExtraInfo"), is_("responseReceivedExtraInfo")
    supplement = asked | answered
    live = ~kind.endswith("ExtraInfo") & (F.lit(True) if cutoff is None else F.coalesce(at <= cutoff, F.lit(False)))
    order = Window.partitionBy("request_id").orderBy("seq")
    count = lambda test: F.sum(F.when(test, 1).otherwise(0)).over(order)
    base = live & is_("requestWillBeSent") & F.coalesce(F.lower("url").rlike("^https?://"), F.lit(False))
    rows = events.withColumn("opens", base & (F.col("redirect_status").isNotNull() | (count(base) == 1)))
    rows = rows.withColumns({"hop": count(F.col("opens")) - 1, "n_asked": count(asked), "n_answered": count(answered)})
    rows = rows.withColumn("n", F.when(asked, F.col("n_asked")).when(answered, F.col("n_answered")).otherwise(F.col("hop")))

    headers = F.coalesce("headers", F.create_map().cast("map<string, string>"))
    only = lambda test, *columns: F.first(F.when(test, F.struct(*columns)), ignorenulls=True)
    final = lambda test, value: F.max_by(value, F.when(test, seq))
    got, failed, opens = is_("responseReceived"), is_("loadingFailed"), F.col("opens")
    moves = opens | is_("responseReceived", "dataReceived", "loadingFinished", "loadingFailed")
    data = is_("dataReceived") & (F.col("encoded_length") > 0)
    rows = rows.filter(supplement | (live & (F.col("hop") >= 0))).groupBy("request_id", supplement.alias("extra"), "n").agg(
        only(opens, "seq", "url", "method", "type", "ts_mono", "ts_wall", "redirect_status", "redirect_has_extra_info", *(["headers", "post_data"] if whole else [])).alias("opened"),
        final(got, F.struct("status", "ts_mono", "protocol", "mime_type", "has_extra_info", *(["headers", "status_text"] if whole else []))).alias("response"),
        *([final(is_("responseBody"), F.col("body")).alias("body")] if whole else []),
        F.min_by("type", F.when(got & (F.col("type") != ""), seq)).alias("told_type"),
        final(is_("loadingFinished", "loadingFailed"), at).alias("done"), F.bool_or(is_("loadingFinished")).alias("finished_loading"),
        final(is_("loadingFinished"), F.col("encoded_length")).alias("encoded_length"),
        final(failed, F.trim(F.coalesce("error", F.lit("")))).alias("error"), F.min(F.when(failed, F.struct("seq", "n_asked", "n_answered"))).alias("failed"),
        F.max(F.when(moves, at)).alias("last"), F.sum(F.when(data, F.col("encoded_length")).otherwise(0)).alias("body_length"),
        F.bool_or(is_("requestServedFromCache")).alias("from_cache"),
        only(asked, headers.alias("headers")).alias("sent"), only(answered, headers.alias("headers"), "status").alias("received"),
    )

    every, chain = Window.partitionBy("request_id"), Window.partitionBy("request_id").orderBy("extra", "n")
    rows = rows.withColumn("next", F.when(~F.col("extra"), F.lead("opened").over(chain)))
    closed, said = F.col("next").isNotNull(), F.col("response").isNotNull()
    told = F.coalesce(F.col("next.redirect_has_extra_info"), F.lit(False))
    rows = rows.withColumns({
        "before": F.coalesce(F.sum(F.when(closed & told, 1).otherwise(0)).over(chain.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "asked": F.count("sent").over(every), "answered": F.count("received").over(every), "hops": F.coalesce(F.max(F.when(~F.col("extra"), F.col("n"))).over(every), F.lit(-1)) + 1,
    })
    # a failed request without a response expects supplements if one waits for it then, or comes later
    waits = (F.col("failed.n_asked") > F.col("before")) | (F.col("failed.n_answered") > F.col("before"))
    waits = F.coalesce(waits | (F.col("asked") > F.col("failed.n_asked")) | (F.col("answered") > F.col("failed.n_answered")), F.lit(False))
    expects = F.when(closed, told).when(said, F.coalesce(F.col("response.has_extra_info"), F.lit(False))).otherwise(waits)
    rows = rows.withColumn("expected", ~F.col("extra") & expects).withColumn("known", closed | said | waits)
    place = F.sum(F.col("expected").cast("int")).over(chain)
    rows = rows.withColumn("place", F.when(F.col("extra"), F.col("n")).when(F.col("expected"), place).otherwise(-1 - F.col("n")))

    full = F.when(~F.col("extra"), F.struct("n", "opened", "response", "told_type", "done", "finished_loading", "encoded_length", "error", "last", "body_length", "from_cache", "next", "expected", "known", *(["body"] if whole else [])))
    rows = rows.groupBy("request_id", "place").agg(
        F.first(full, ignorenulls=True).alias("h"), F.first("sent", ignorenulls=True).alias("sent"), F.first("received", ignorenulls=True).alias("received"),
        F.first("hops").alias("hops"), (F.first("asked") + F.first("answered")).alias("orphans"),
    )
    rows = rows.filter(F.col("h").isNotNull() | ((F.col("hops") == 0) & (F.col("place") == 1)))
    there, opened = F.col("h").isNotNull(), lambda name: F.col(f"h.opened.{name}")
    number = F.when(F.col("h.n") >= MAX_HOPS, F.raise_error(F.lit(f"more than {MAX_HOPS} hops of a request")).cast("int")).when(there, F.col("h.n")).otherwise(-1)
    own = lambda c: F.when(F.col("h.expected"), c)
    missing = ~F.col("h.known") | (F.col("h.expected") & (F.col("sent").isNull() | F.col("received").isNull()))
    status = F.coalesce(own(F.when(F.col("received.status") != 0, F.col("received.status"))), "h.response.status", "h.next.redirect_status")
    values = {
        "hop": number, "seq": opened("seq"), "url": opened("url"), "method": opened("method"), "type": F.when(opened("type") != "", opened("type")).otherwise(F.coalesce("h.told_type", opened("type"))),
        "started": opened("ts_mono"), "started_wall": opened("ts_wall"), "status": status, "response_at": F.col("h.response.ts_mono"),
        "finished": F.coalesce("h.done", "h.next.ts_mono"), "last": F.col("h.last"), "encoded_length": F.when(there, F.coalesce("h.encoded_length", F.lit(0))),
        "body_length": F.col("h.body_length"), "decoded_length": F.when(there, F.lit(0)), "protocol": F.col("h.response.protocol"), "mime_type": F.col("h.response.mime_type"), "error": F.col("h.error"),
        "from_cache": F.col("h.from_cache"), "finished_loading": F.col("h.finished_loading") | F.col("h.next").isNotNull(),
        "request_headers": own(F.col("sent.headers")), "response_headers": own(F.col("received.headers")), "incomplete": F.when(there, missing).otherwise(True), "orphans": F.when(there, 0).otherwise(F.col("orphans")),
    }
    names, kinds = HOP_COLUMNS[1:], dict(part.split(" ", 1) for part in re.split(r", (?=[a-z_]+ )", f"{HOP}, {WHOLE}"))
    if whole:
        values |= {"told_request_headers": opened("headers"), "told_response_headers": F.col("h.response.headers"), "status_text": F.col("h.response.status_text"), "post_data": opened("post_data"), "body": F.col("h.body")}
        names = [*names, *list(kinds)[-5:]]
    return rows.select("request_id", *(values[name].cast(kinds[name]).alias(name) for name in names))


def stream_hops(events: DataFrame, cutoff: float | None = None) -> DataFrame:
    """Hops of a stream, in update mode: a batch gives the hops of the request ids that it touched, as they are now."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        chain = Chain.load(state.get[0]) if state.exists else Chain(cutoff=cutoff)
        for event in pd.concat(list(batches)).sort_values("seq").to_dict("records"):
            chain.apply(event)
        state.update((chain.dump(),))
        yield frame(chain.rows(key[0]))

    return events.groupBy("request_id").applyInPandasWithState(run, HOP, "chain string", "update", GroupStateTimeout.NoTimeout)


def latest(updates: DataFrame, batch: str) -> DataFrame:
    """Of the rows that update mode has written, the last of each hop by ``batch``."""
    last = Window.partitionBy("request_id", "hop").orderBy(F.desc(batch))
    return updates.withColumn("_n", F.row_number().over(last)).filter("_n = 1").drop("_n", batch)


def positional_match(expecting: DataFrame, supplements: DataFrame) -> DataFrame:
    """The batch form of the matching alone: nth supplement to nth expecting hop of a request id.

    ``expecting`` has request_id, hop, known, expected; hops behind one that isn't known take none.
    """
    order = Window.partitionBy("request_id").orderBy("hop")
    open_ = expecting.withColumn("blocked", F.max(F.when(F.col("known"), 0).otherwise(1)).over(order)).filter("blocked = 0 AND expected")
    left = open_.withColumn("n", F.row_number().over(order)).select("request_id", "hop", "n")
    right = supplements.withColumn("n", F.row_number().over(Window.partitionBy("request_id").orderBy("seq")))
    return left.join(right, ["request_id", "n"], "left").drop("n")


def http_version(c: Column) -> Column:
    low = F.lower(F.trim(c))
    return F.when(low == "h2", "HTTP/2").when(low.isin("h3", "quic") | low.startswith("h3-"), "HTTP/3").when(low.isin("http/1.0", "http/1.1"), F.upper(low)).otherwise(F.coalesce(c, F.lit("")))


def has_no_body(method: Column, status: Column) -> Column:
    return (F.upper(method) == "HEAD") | ((status >= 100) & (status < 200)) | status.isin(204, 205, 304)


def duration(start: Column, end: Column) -> Column:
    """Milliseconds between two times in seconds, not below zero."""
    return F.greatest(F.lit(0.0), (end - start) * 1000)


def header(headers: Column, name: str) -> Column:
    found = F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower())
    return F.element_at(F.split(F.get(F.array_sort(found), F.lit(0))["value"], "\n"), 1)


def header_rows(headers: Column) -> Column:
    """name, value by name without regard to case; values that hold several lines become several rows."""
    order = F.array_sort(F.map_entries(headers), lambda a, b: F.when(F.lower(a["key"]) < F.lower(b["key"]), -1).when(F.lower(a["key"]) > F.lower(b["key"]), 1).otherwise(0))
    return F.flatten(F.transform(order, lambda e: F.transform(F.split(e["value"], "\n"), lambda v: F.struct(e["key"].alias("name"), v.alias("value")))))


def content_length(headers: Column) -> Column:
    return let(header(headers, "content-length").try_cast("long"), lambda value: F.when(value >= 0, value))


def needs_base64(media: Column, body: Column) -> Column:
    """Whether a body is kept as base64: it isn't valid text, or has a type that isn't text's."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(media, F.lit("")), ";", 1)))
    return ~F.is_valid_utf8(body) | ((kind != "") & ~kind.rlike("^text/|json|xml|javascript|ecmascript|x-www-form-urlencoded|svg"))


def entry_columns(cutoff: float | None = None) -> dict[str, Column]:
    """An entry's times, sizes, phases and remarks by name, over the columns of hops."""
    cut = F.lit(cutoff).cast("double")
    start = F.col("started")
    end = F.coalesce("finished", F.when(cut >= start, cut), "last", "response_at", start)
    end = F.greatest(end, start)
    none = has_no_body(F.col("method"), F.col("status"))
    told = F.when(F.col("finished_loading"), content_length(F.col("response_headers")))
    body = F.coalesce(F.when(F.col("body_length") > 0, F.col("body_length")), told, F.lit(-1))
    size = F.coalesce(F.when(F.col("decoded_length") > 0, F.col("decoded_length")), told, F.when(F.col("body_length") > 0, F.col("body_length")), F.lit(0))
    total = duration(start, end)
    wait = F.least(total, duration(start, F.coalesce("response_at", end)))
    receive = F.when(F.col("response_at").isNotNull(), duration(F.col("response_at"), end)).otherwise(0.0)
    remarks = F.concat_ws(
        " ",
        F.when(F.col("from_cache"), F.lit("Served from browser cache.")),
        F.when(F.col("error") != "", F.concat(F.lit("Loading failure: "), "error")).when(~F.col("finished_loading"), F.lit("Request was still in flight at the capture cutoff; timing and sizes are incomplete.")),
        F.when(F.col("incomplete"), F.lit("Supplemental request/response metadata did not arrive before the capture cutoff.")),
    )
    return {
        "httpVersion": http_version(F.col("protocol")), "resourceType": F.coalesce("type", F.lit("")),
        "time": total, "blocked": F.greatest(F.lit(0.0), total - wait - receive), "wait": wait, "receive": receive,
        "bodySize": F.when(none, 0).when(F.col("from_cache"), 0).otherwise(body), "contentSize": F.when(none, 0).otherwise(size),
        "mimeType": F.coalesce(header(F.col("response_headers"), "content-type"), "mime_type", F.lit("")),
        "redirectURL": F.coalesce(header(F.col("response_headers"), "location"), F.lit("")),
        "incomplete": F.coalesce("incomplete", F.lit(False)), "comment": remarks,
    }


def archive_entries(rows: DataFrame, cutoff: float | None = None) -> DataFrame:
    """Entries of an archive in the order of the hops' first events: times, sizes, phases and remarks."""
    told = [c.alias(name) for name, c in entry_columns(cutoff).items()]
    return rows.filter("hop >= 0").select("seq", "request_id", "hop", "method", "url", "status", *told).orderBy("seq")


def page_timings(events: DataFrame) -> DataFrame:
    """onContentLoad, onLoad in milliseconds since the first document request."""
    at = lambda kind: F.max(F.when(F.col("event_type") == kind, F.col("ts_mono")))
    first = F.min_by("ts_mono", F.when((F.col("event_type") == "requestWillBeSent") & (F.lower("type") == "document"), F.col("seq")))
    times = events.agg(first.alias("start"), at("domContentEventFired").alias("dom"), at("loadEventFired").alias("load"))
    return times.select(duration(F.col("start"), F.col("dom")).alias("onContentLoad"), duration(F.col("start"), F.col("load")).alias("onLoad"))


def orphan_count(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.sum("orphans"), F.lit(0)).alias("orphans"))


def drain_needed(rows: DataFrame) -> DataFrame:
    return rows.agg(F.coalesce(F.bool_or(F.coalesce("incomplete", F.lit(False)) | (F.col("orphans") > 0)), F.lit(False)).alias("drain_needed"))
