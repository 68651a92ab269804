"""Queries whose operators write as they run: ordered text, tables of what was seen, captures cut off."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.operators.dedup import listing_key
from terrasift.operators.output import read_ordered, write_ordered
from terrasift.operators.render import comma, money
from terrasift.operators.seen import first_wins_again
from terrasift.registry import query, table
from terrasift.sources.scratch import shared_dir
from terrasift.streaming.chains import archive_entries, hops


def priced_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey")
    return o.select(
        F.col("o_orderpriority").alias("area"), key.alias("ord"), key.cast("string").alias("ID"), money(F.when(key % 5 != 0, F.floor("o_totalprice").cast("long")), "").alias("PRICE"),
        comma(key * 37).alias("SQFT"), F.when(key % 3 == 0, F.col("o_orderstatus")).alias("STATUS"),
    )


_ROWS = """SELECT o_orderpriority AS area, o_orderkey AS ord, CAST(o_orderkey AS VARCHAR) AS id, CASE WHEN o_orderkey % 5 <> 0 THEN '$' || format('{:,}', CAST(floor(o_totalprice) AS BIGINT)) ELSE '' END AS price,
  format('{:,}', CAST(o_orderkey AS BIGINT) * 37) AS sqft, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus END AS status FROM orders"""


@query(f"""
WITH r AS ({_ROWS}), w AS (SELECT greatest(2, max(length(id))) AS a, greatest(5, max(length(price))) AS b, greatest(4, max(length(sqft))) AS c, greatest(6, max(length(coalesce(status, '')))) AS d FROM r)
SELECT CAST(row_number() OVER (ORDER BY area, ord) AS BIGINT) AS n, rtrim(rpad(id, CAST(a + 2 AS INT), ' ') || rpad(price, CAST(b + 2 AS INT), ' ') || rpad(sqft, CAST(c + 2 AS INT), ' ') || rpad(coalesce(status, ''), CAST(d + 2 AS INT), ' ')) AS line FROM r, w
UNION ALL SELECT 0, rtrim(rpad('ID', CAST(a + 2 AS INT), ' ') || rpad('PRICE', CAST(b + 2 AS INT), ' ') || rpad('SQFT', CAST(c + 2 AS INT), ' ') || 'STATUS') FROM w
""")
def output_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aligned table, written in parts and read back line by line."""
    write_ordered(priced_orders(spark, sf_dir), path := f"{shared_dir(spark)}/table", ["area", "ord"])
    return read_ordered(spark, path)


@query(f"""
WITH r AS ({_ROWS}), n AS (SELECT *, row_number() OVER (ORDER BY area, ord) AS n FROM r)
SELECT CAST(n AS BIGINT) AS n, CASE WHEN n = 1 THEN '' ELSE ',' END || '{{"ID":"' || id || '","PRICE":"' || price || '","SQFT":"' || sqft || '"' || CASE WHEN status IS NULL THEN '' ELSE ',"STATUS":"' || status || '"' END || '}}' AS line FROM n
UNION ALL SELECT 0, '[' UNION ALL SELECT count(*) + 1, ']' FROM r
""")
def output_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same rows as one JSON document."""
    write_ordered(priced_orders(spark, sf_dir), path := f"{shared_dir(spark)}/document", ["area", "ord"], "document")
    return read_ordered(spark, path)


@query(f"""
WITH r AS ({_ROWS}) SELECT 'ID' AS name, count(*) AS n_rows, count(*) AS filled, max(length(id)) AS longest FROM r UNION ALL SELECT 'PRICE', count(*), count(nullif(price, '')), max(length(price)) FROM r
UNION ALL SELECT 'SQFT', count(*), count(*), max(length(sqft)) FROM r UNION ALL SELECT 'STATUS', count(*), count(status), max(length(status)) FROM r
""")
def output_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the pass that wrote the rows has seen of them."""
    facts = write_ordered(priced_orders(spark, sf_dir), f"{shared_dir(spark)}/lines", ["area", "ord"], "lines")
    return spark.createDataFrame([(c, facts.rows, facts.filled[c], facts.longest[c]) for c in facts.filled], "name string, n_rows bigint, filled bigint, longest bigint")


@query("""
WITH all_ AS (SELECT event_id AS ord, CASE WHEN event_id % 10 <> 0 THEN user_id * 7 + event_id % 50 END AS k, event_id % 3 AS run FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY run, ord) AS n FROM all_)
SELECT CAST(run AS INT) AS run, ord FROM n WHERE k IS NULL OR n = 1
""")
def first_wins_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over thirds of the events, one after another; the last is done twice, as after a failure."""
    e = table(spark, sf_dir, "events")
    key = F.when(F.col("event_id") % 10 != 0, F.col("user_id") * 7 + F.col("event_id") % 50)
    rows = e.select(F.col("event_id").alias("ord"), F.coalesce(key.cast("string"), F.lit("")).alias("id"), F.lit("").alias("url"), F.struct(F.lit("").alias("full")).alias("address"), (F.col("event_id") % 3).cast("int").alias("run"))
    state = f"seen_{uuid.uuid4().hex}"
    kept = [first_wins_again(rows.filter(F.col("run") == run), str(run), state, listing_key(), ["ord"]) for run in (0, 1, 2, 2)]
    spark.sql(f"DROP TABLE {state}")
    return kept[0].unionByName(kept[1]).unionByName(kept[3]).select("run", "ord")


#: When the capture ends, in seconds of its clock.
CUTOFF = 5.0


@query("""
WITH e AS (SELECT event_id AS id, CAST(event_id % 10 AS DOUBLE) AS s, event_id % 10 + event_id % 4 AS r, event_id % 10 + event_id % 4 + event_id % 3 AS f, event_id % 5 <> 0 AS sent, event_id % 7 <> 0 AS got FROM events),
c AS (SELECT *, r <= 5 AS answered, f <= 5 AS finished, greatest(least(CASE WHEN f <= 5 THEN f ELSE 5 END, 5), s) AS e FROM e)
SELECT id, CASE WHEN s > 5 THEN -1 ELSE 0 END AS hop, CASE WHEN s > 5 THEN CAST(sent AS INT) + CAST(got AS INT) ELSE 0 END AS orphans,
  CASE WHEN s <= 5 THEN (e - s) * 1000 END AS time, CASE WHEN s <= 5 THEN (CASE WHEN answered THEN r ELSE e END - s) * 1000 END AS wait, CASE WHEN s <= 5 THEN CASE WHEN answered THEN (e - r) * 1000 ELSE 0 END END AS receive,
  CASE WHEN s <= 5 THEN CASE WHEN answered AND got THEN 203 WHEN answered THEN 200 END END AS status, CASE WHEN s <= 5 THEN NOT answered OR NOT sent OR NOT got ELSE true END AS incomplete,
  s > 5 OR NOT answered OR NOT sent OR NOT got AS drains
FROM c WHERE s <= 5 OR sent OR got
""")
def capture_cutoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capture cut off in the midst of requests: supplements still count, later events don't, later requests leave orphans."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"))
    id_ = F.col("id")
    start, response = (id_ % 10).cast("double"), (id_ % 10 + id_ % 4).cast("double")
    kinds = [
        ("requestWillBeSent", F.lit(True), start), ("responseReceived", F.lit(True), response), ("loadingFinished", F.lit(True), response + id_ % 3),
        ("responseReceivedExtraInfo", id_ % 7 != 0, F.lit(None).cast("double")), ("requestWillBeSentExtraInfo", id_ % 5 != 0, F.lit(None).cast("double")),
    ]
    event = F.array_compact(F.array(*(F.when(there, F.struct(F.lit(i).alias("k"), F.lit(name).alias("kind"), at.alias("at"))) for i, (name, there, at) in enumerate(kinds))))
    rows = e.select("id", F.inline(event))
    is_ = lambda k: F.col("k") == k
    text = lambda k, value: F.when(is_(k), F.lit(value))
    log = rows.select(
        (id_ * 5 + F.col("k")).alias("seq"), F.col("kind").alias("event_type"), id_.cast("string").alias("request_id"), F.col("at").alias("ts_mono"), F.col("at").alias("ts_wall"), F.when(is_(0), F.concat(F.lit("https://h/"), id_.cast("string"))).alias("url"),
        text(0, "GET").alias("method"), text(0, "Fetch").alias("type"), F.when(is_(1), 200).when(is_(3), 203).alias("status"), F.when(is_(1), True).alias("has_extra_info"), F.lit(None).cast("int").alias("redirect_status"),
        F.lit(None).cast("boolean").alias("redirect_has_extra_info"), F.when(F.col("k") >= 3, F.create_map(F.lit("A"), F.lit("b"))).alias("headers"), F.when(is_(2), F.lit(9).cast("bigint")).alias("encoded_length"),
        text(1, "h2").alias("protocol"), F.lit(None).cast("string").alias("error"), text(1, "text/html").alias("mime_type"),
    )
    found = hops(log, CUTOFF)
    entries = archive_entries(found, CUTOFF).select("request_id", "time", "wait", "receive")
    drains = F.coalesce(F.col("incomplete"), F.lit(False)) | (F.col("orphans") > 0)
    return found.join(entries, "request_id", "left").select(F.col("request_id").cast("bigint").alias("id"), "hop", "orphans", "time", "wait", "receive", "status", "incomplete", drains.alias("drains"))
