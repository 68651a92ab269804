"""Queries over archives: events are recorded as a browser's, put together, written as documents, read back in ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrasift.operators import archive as A
from terrasift.operators.capture import capture_entries
from terrasift.registry import query, table
from terrasift.sources.archive_files import archive_head, numbered_entries, save_archives
from terrasift.sources.scratch import shared_dir, staged
from terrasift.streaming.chains import hops

#: Event ids of a document, and bytes of a range: small, so that the test tables make many of both.
EACH, RANGE = 1000, 100_000
HOST = f"https://www.{A.SITE_HOST}"
#: What is asked of the search; some requests miss the list of results, or name nothing.
WANTS = ['{"cat1":["listResults","mapResults"]}', '{"cat1":["mapResults"]}', '{"cat1":["listResults"],"cat2":[]}']


def recorded_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six browser events for each row of ``events``; one request in four has no supplements, one in five a binary body."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("user_id").alias("user"), F.col("event_type").alias("kind"), F.unix_micros(F.to_timestamp("ts")).cast("double").alias("us"))
    key, text = F.col("id"), F.col("id").cast("string")
    search, plain = F.col("kind") == "purchase", key % 4 == 3
    url = F.when(search, f"{HOST}{A.ENDPOINT}").when(F.col("kind") == "error", F.concat(F.lit("https://stats.example.org/collect/"), text, F.lit("?access_token="), text))
    url = url.when(F.col("kind") == "signup", F.concat(F.lit(f"{HOST}/static/app-"), text, F.lit(".js"))).otherwise(F.concat(F.lit(f"{HOST}/homes/"), text, F.lit("?q=a%20b&page="), (key % 9).cast("string"), F.lit("&token=t"), text))
    media = F.when(search, "application/json").when(F.col("kind") == "signup", "text/javascript").otherwise("image/png")
    said = F.concat(F.lit('{"searchQueryState":{"page":'), text, F.lit(',"token":"s'), text, F.lit('"},"wants":'), F.element_at(F.array(*map(F.lit, WANTS)), (key % 3 + 1).cast("int")), F.lit(',"other":1}'))
    asked = F.create_map(F.lit("Accept"), F.lit("*/*"), F.lit("Referer"), F.lit(f"{HOST}/homes/?page=1"))
    sent = F.map_concat(asked, F.create_map(F.lit("Cookie"), F.concat(F.lit("sid="), F.col("user").cast("string"), F.lit('; theme="dark"; bad name=1'))))
    answered = F.create_map(F.lit("content-type"), media)
    got = F.map_concat(answered, F.create_map(F.lit("Set-Cookie"), F.concat(F.lit("a="), text, F.lit("; Path=/; HttpOnly; Expires=Wed, 21 Oct 2026 07:28:00 GMT\nb=2; SameSite=lax; secure\nnone"))))
    status = (200 + 100 * (key % 3)).cast("int")
    body = F.when(key % 5 == 0, F.unhex(F.lit("FF00FE"))).when(search, F.concat(F.lit('{"n":'), text, F.lit(',"s":"\\"]}"}')).cast("binary"))
    names = ["requestWillBeSent", "requestWillBeSentExtraInfo", "responseReceivedExtraInfo", "responseReceived", "responseBody", "loadingFinished"]
    rows = e.withColumn("k", F.explode(F.array(*map(F.lit, range(6))))).filter(~(plain & F.col("k").isin(1, 2)))
    at = lambda k, c: F.when(F.col("k") == k, c)
    time = F.col("us") / 1e6 + F.when(F.col("k") == 3, 0.25).when(F.col("k") == 5, 0.75).otherwise(0.0)
    return rows.select(
        (key * 6 + F.col("k")).alias("seq"), F.element_at(F.array(*map(F.lit, names)), F.col("k") + 1).alias("event_type"), text.alias("request_id"), time.alias("ts_mono"), time.alias("ts_wall"),
        at(0, url).alias("url"), at(0, F.when(search, "PUT").otherwise("GET")).alias("method"), at(0, F.when(search, "Fetch").when(F.col("kind") == "signup", "Script").otherwise("Image")).alias("type"),
        F.when(F.col("k").isin(2, 3), status).alias("status"), at(3, ~plain).alias("has_extra_info"), F.lit(None).cast("int").alias("redirect_status"), F.lit(None).cast("boolean").alias("redirect_has_extra_info"),
        F.when(F.col("k") == 0, asked).when(F.col("k") == 1, sent).when(F.col("k") == 2, got).when(F.col("k") == 3, answered).alias("headers"), at(5, key % 1000).alias("encoded_length"), at(3, F.lit("h2")).alias("protocol"),
        F.lit(None).cast("string").alias("error"), at(3, media).alias("mime_type"), at(3, F.lit("Said")).alias("status_text"), at(0, F.when(search, said)).alias("post_data"), at(4, body).alias("body"), F.concat(F.lit("day/"), (key % 3).cast("string")).alias("source"),
    )


def recorded_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, entry_index, entry: by the name of what was recorded."""
    found = hops(recorded_log(spark, sf_dir), whole=True)
    return capture_entries(found, F.concat(F.lit("day/"), (F.col("request_id").cast("bigint") % 3).cast("string")))


def written_archives(spark: SparkSession, sf_dir: str, again: bool = True) -> DataFrame:
    """source_id, entry_index, entry of documents written from the recorded ones, as read back in ranges.

    What reads them ``again`` gets them as a table, so that the documents are read once.
    """
    path = f"{shared_dir(spark)}/archives"
    save_archives(recorded_entries(spark, sf_dir), path, archive_head("recorder", "1", comment=F.concat(F.lit('of "'), "source_id", F.lit('"'))), each=6 * EACH)
    # a folder is listed at once, a pattern path by path
    rows = numbered_entries(spark, path, RANGE)
    return staged(rows) if again else rows


_E = f"""
SELECT event_id AS id, user_id AS u, event_type AS kind, event_type = 'purchase' AS search, event_id % 4 = 3 AS plain, 200 + 100 * (event_id % 3) AS status,
  CASE event_type WHEN 'purchase' THEN '{HOST}{A.ENDPOINT}' WHEN 'error' THEN 'https://stats.example.org/collect/' || event_id || '?access_token=' || event_id
    WHEN 'signup' THEN '{HOST}/static/app-' || event_id || '.js' ELSE '{HOST}/homes/' || event_id || '?q=a%20b&page=' || (event_id % 9) || '&token=t' || event_id END AS url,
  CASE event_type WHEN 'purchase' THEN 'application/json' WHEN 'signup' THEN 'text/javascript' ELSE 'image/png' END AS media,
  'day%2F' || (event_id % 3) || '-' || lpad(CAST(event_id // {EACH} AS VARCHAR), 8, '0') || '.har' AS document, ts,
  '{{"searchQueryState":{{"page":' || event_id || ',"token":"s' || event_id || '"}},"wants":' || (['{"','".join(WANTS)}'])[CAST(event_id % 3 + 1 AS INT)] || ',"other":1}}' AS said
FROM events
"""


@query(f"""
WITH e AS ({_E})
SELECT document, row_number() OVER (PARTITION BY document ORDER BY id) - 1 AS place, url, CASE WHEN search THEN 'PUT' ELSE 'GET' END AS method, CAST(status AS INT) AS status, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS started,
  CASE WHEN plain THEN 'Accept,Referer' ELSE 'Accept,Cookie,Referer' END AS sent, CASE WHEN plain THEN '' ELSE 'sid=' || u || ',theme=dark' END AS cookies,
  CASE WHEN plain THEN '' ELSE 'a=' || id || ' /  2026-10-21T07:28:00Z true false,b=2  lax  false true' END AS set_cookies,
  CASE kind WHEN 'error' THEN 'access_token=' || id WHEN 'purchase' THEN '' WHEN 'signup' THEN '' ELSE 'q=a b,page=' || (id % 9) || ',token=t' || id END AS query,
  CASE WHEN search THEN said END AS post, CAST(CASE WHEN search THEN length(said) ELSE 0 END AS BIGINT) AS post_size, media,
  CASE WHEN id % 5 = 0 THEN '/wD+' WHEN search THEN '{{"n":' || id || ',"s":"\\"]}}"}}' END AS body, CASE WHEN id % 5 = 0 THEN 'base64' END AS encoding, CAST(750 AS DOUBLE) AS time, CAST(250 AS DOUBLE) AS wait, CAST(500 AS DOUBLE) AS receive FROM e
""")
def archive_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole entries, written and read again: headers as sent, cookies, query, both bodies, phases."""
    rows = written_archives(spark, sf_dir)
    e, names = F.col("entry"), lambda c, text: F.array_join(F.transform(c, text), ",")
    plain = lambda x: F.concat_ws("=", x["name"], x["value"])
    none = lambda c: F.coalesce(c, F.lit(""))
    full = lambda c: F.concat(plain(c), F.lit(" "), none(c["path"]), F.lit(" "), F.lower(none(c["sameSite"])), F.lit(" "), none(c["expires"]), F.lit(" "), c["httpOnly"].cast("string"), F.lit(" "), c["secure"].cast("string"))
    ask, got = e["request"], e["response"]
    return rows.select(
        F.element_at(F.split("source_id", "/"), -1).alias("document"), F.col("entry_index").cast("bigint").alias("place"), ask["url"].alias("url"), ask["method"].alias("method"), got["status"].alias("status"),
        F.substring(e["startedDateTime"], 1, 19).alias("started"), names(ask["headers"], lambda h: h["name"]).alias("sent"), names(ask["cookies"], plain).alias("cookies"), names(got["cookies"], full).alias("set_cookies"),
        names(ask["queryString"], plain).alias("query"), ask["postData"]["text"].alias("post"), ask["bodySize"].alias("post_size"), got["content"]["mimeType"].alias("media"), got["content"]["text"].alias("body"),
        got["content"]["encoding"].alias("encoding"), F.round(e["time"], 3).alias("time"), F.round(e["timings"]["wait"], 3).alias("wait"), F.round(e["timings"]["receive"], 3).alias("receive"),
    )


_SCORE = """40 * CASE WHEN kind = 'error' THEN 0 ELSE 1 END - CASE WHEN kind = 'error' THEN 60 + 120 ELSE 0 END + CASE WHEN search THEN 140 + 35 + 30 ELSE 0 END
  - CASE WHEN NOT search THEN 90 ELSE 0 END + CASE WHEN search THEN 12 ELSE 4 END + CASE WHEN status < 300 THEN 5 WHEN status >= 400 THEN -25 ELSE 0 END"""


@query(f"""
WITH e AS ({_E}), s AS (SELECT *, {_SCORE} AS score FROM e)
SELECT document, CAST(score AS INT) AS score, CASE WHEN search THEN 'PUT' ELSE 'GET' END AS method,
  CASE kind WHEN 'error' THEN 'https://stats.example.org/collect/' || id || '?access_token=%5BREDACTED%5D' WHEN 'purchase' THEN url WHEN 'signup' THEN url ELSE regexp_replace(url, 'token=.*', 'token=%5BREDACTED%5D') END AS url,
  CASE WHEN kind = 'error' THEN 'stats.example.org' ELSE 'www.{A.SITE_HOST}' END AS host, row_number() OVER (PARTITION BY document ORDER BY score DESC, id) AS rank FROM s
""")
def archive_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each document by how likely they are the search request."""
    ranked = A.rank_candidates(written_archives(spark, sf_dir))
    rank = F.row_number().over(Window.partitionBy("source_id").orderBy(F.desc("score"), "entry_index"))
    return ranked.select(F.element_at(F.split("source_id", "/"), -1).alias("document"), F.col("score").cast("int").alias("score"), "method", "url", "host", rank.cast("bigint").alias("rank"))


@query(f"""
WITH e AS ({_E})
SELECT document, row_number() OVER (PARTITION BY document ORDER BY id) - 1 AS place, 'Accept,Referer' AS sent, 'content-type' AS got, CAST(0 AS BIGINT) AS cookies,
  CASE kind WHEN 'error' THEN '[REDACTED]' WHEN 'purchase' THEN '' WHEN 'signup' THEN '' ELSE 'a b,' || (id % 9) || ',[REDACTED]' END AS query,
  CASE WHEN search THEN '{{"searchQueryState":{{"page":' || id || ',"token":"[REDACTED]"}},"wants":' || (['{"','".join(WANTS)}'])[CAST(id % 3 + 1 AS INT)] || '}}' END AS post, CAST(NULL AS VARCHAR) AS body, CAST(0 AS BIGINT) AS leaks FROM e
""")
def archive_sanitized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of each entry once secrets are gone, and that nothing leaks."""
    # leaks are looked for in the pass that cleans, and that in the one that reads: entries are neither kept, nor cleaned twice, nor joined
    e, names = F.col("entry"), lambda c, name: F.array_join(F.transform(c, lambda x: x[name]), ",")
    rows = A.sanitize(written_archives(spark, sf_dir, again=False)).withColumn("leaks", F.size(A.leak_names(e)))
    return rows.select(
        F.element_at(F.split("source_id", "/"), -1).alias("document"), F.col("entry_index").cast("bigint").alias("place"), names(e["request"]["headers"], "name").alias("sent"), names(e["response"]["headers"], "name").alias("got"),
        (F.size(e["request"]["cookies"]) + F.size(e["response"]["cookies"])).cast("bigint").alias("cookies"), names(e["request"]["queryString"], "value").alias("query"), e["request"]["postData"]["text"].alias("post"),
        e["response"]["content"]["text"].alias("body"), F.col("leaks").cast("bigint").alias("leaks"),
    )


@query(f"""
WITH e AS ({_E}), s AS (SELECT *, {_SCORE} AS score, row_number() OVER (PARTITION BY document ORDER BY id) - 1 AS place FROM e),
b AS (SELECT *, row_number() OVER (PARTITION BY document ORDER BY score DESC, id) AS n FROM s WHERE search)
SELECT document, place, '{HOST}/homes/?page=1' AS referer, '{{"page":' || id || ',"token":"[REDACTED]"}}' AS state, 'listResults,mapResults' AS wants FROM b WHERE n = 1 AND id % 3 = 0
""")
def archive_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best search request of each document as a template, where it asks for results and for nothing unnamed."""
    found = A.derive_templates(written_archives(spark, sf_dir))
    return found.select(
        F.element_at(F.split("source_id", "/"), -1).alias("document"), F.col("entry_index").cast("bigint").alias("place"), "referer", F.col("searchQueryState").alias("state"), F.array_join(F.col("wants")["cat1"], ",").alias("wants"),
    )
