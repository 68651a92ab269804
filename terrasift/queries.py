"""Queries over the test tables, one for each group of operators, with the SQL that gives the same rows.

The tables hold no listings, so their columns stand in for a listing's: the operators are the same column expressions.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terrasift.functions import classify as C
from terrasift.functions import redact as R
from terrasift.functions import tagged as T
from terrasift.functions import text as X
from terrasift.operators import archive as A
from terrasift.operators import filters as W
from terrasift.operators.coverage import coverage as route_coverage
from terrasift.operators.dedup import first_wins, last_wins, listing_key
from terrasift.operators.history import annotate_history, money_change
from terrasift.operators.normalize import identifier_in_url
from terrasift.operators.ranking import limit_per
from terrasift.operators.recency import recency_of
from terrasift.operators.render import comma, money, number
from terrasift.registry import ORACLES, QUERIES, query, table
from terrasift.sources.archive import query_items
from terrasift.sources.records import embedded_script
from terrasift.spec import Boundary, DetailFilters, Route, SearchFilters
from terrasift.streaming.chains import archive_entries, hops

def part_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as listings: unknown prices, bedrooms and types among them."""
    p = table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").cast("string").alias("id"), F.col("p_partkey").alias("ord"),
        F.when(F.col("p_partkey") % 7 != 0, F.round("p_retailprice").cast("long")).alias("price"),
        F.when(F.col("p_partkey") % 5 != 0, (F.col("p_size") % 6).cast("double")).alias("bedrooms"),
        F.when(F.col("p_partkey") % 11 != 0, (F.col("p_size") % 4).cast("double")).alias("bathrooms"),
        F.when(F.col("p_partkey") % 3 != 0, F.col("p_size").cast("long") * 40).alias("livingArea"),
        (F.col("p_partkey") % 13).alias("daysListed"), (F.col("p_partkey") % 9 == 0).alias("isBuilding"),
        F.element_at(F.array(F.lit("APARTMENT"), F.lit("CONDO_COOP"), F.lit("house"), F.lit(""), F.lit("TOWNHOME")), (F.col("p_partkey") % 5 + 1).cast("int")).alias("homeType"),
    )


PARTS = """
SELECT CAST(p_partkey AS VARCHAR) AS id, p_partkey AS ord,
       CASE WHEN p_partkey % 7 <> 0 THEN CAST(round(p_retailprice) AS BIGINT) END AS price,
       CASE WHEN p_partkey % 5 <> 0 THEN CAST(p_size % 6 AS DOUBLE) END AS bedrooms,
       CASE WHEN p_partkey % 11 <> 0 THEN CAST(p_size % 4 AS DOUBLE) END AS bathrooms,
       CASE WHEN p_partkey % 3 <> 0 THEN CAST(p_size AS BIGINT) * 40 END AS "livingArea",
       p_partkey % 13 AS "daysListed", p_partkey % 9 = 0 AS "isBuilding",
       (['APARTMENT', 'CONDO_COOP', 'house', '', 'TOWNHOME'])[CAST(p_partkey % 5 + 1 AS INT)] AS "homeType"
FROM part
"""


@query(f"""
WITH p AS ({PARTS}), r AS (SELECT "homeType" AS location, id, price, row_number() OVER (PARTITION BY "homeType" ORDER BY price ASC NULLS LAST, ord) AS rank FROM p)
SELECT location, id, price, rank FROM r WHERE rank <= 5
""")
def topk_per_group_unknown_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cheapest five of each type, unknown prices last."""
    rows = part_listings(spark, sf_dir).withColumn("location", F.col("homeType"))
    return limit_per(rows, ["location"], "price-asc", ["ord"], 5).select("location", "id", "price", F.col("rank").cast("long").alias("rank"))


@query(f"""
WITH p AS ({PARTS}) SELECT id, price, "isBuilding",
  CASE WHEN "homeType" = '' THEN 'discovered' ELSE 'both' END AS passes
FROM p WHERE (price >= 1000 OR (price IS NULL AND "isBuilding")) AND (price <= 1600 OR (price IS NULL AND "isBuilding"))
  AND ("isBuilding" OR bedrooms >= 1) AND ("isBuilding" OR bedrooms <= 4) AND ("isBuilding" OR bathrooms >= 1)
  AND (upper("homeType") IN ('APARTMENT', 'CONDO', 'CONDOMINIUM', 'CONDO_COOP', 'COOP') OR "homeType" = '')
""")
def basic_filter_unknown_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    filters = SearchFilters(min_price=1000, max_price=1600, min_beds=1, max_beds=4, min_baths=1, home_types=("apartment", "condo"))
    rows = part_listings(spark, sf_dir).filter(W.discovered_filter(filters))
    return rows.select("id", "price", "isBuilding", F.when(W.snapshot_filter(filters), "both").otherwise("discovered").alias("passes"))


@query(f"""
WITH p AS ({PARTS}) SELECT id, bedrooms, bedrooms IS NULL AND NOT "isBuilding" AS preliminary FROM p
WHERE "isBuilding" OR bedrooms IS NULL OR bedrooms = 2 OR bedrooms >= 4
""")
def bed_range_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = [Route("2", SearchFilters(min_beds=2, max_beds=2)), Route("4plus", SearchFilters(min_beds=4))]
    rows = part_listings(spark, sf_dir).filter(W.bed_ranges(routes, allow_unknown=True))
    return rows.select("id", "bedrooms", (~W.bed_ranges(routes, allow_unknown=False)).alias("preliminary"))


@query("""
WITH all_ AS (SELECT 0 AS g, event_id AS ord, CASE WHEN event_id % 10 <> 0 THEN user_id * 7 + event_id % 50 END AS k, event_type FROM events
  UNION ALL SELECT 1, event_id, CASE WHEN event_id % 10 <> 0 THEN user_id * 7 + event_id % 50 END, event_type FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY g, ord) AS n FROM all_)
SELECT g, ord, event_type FROM n WHERE k IS NULL OR n = 1
""")
def first_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two groups in order; the first of each key stays, and all rows without one."""
    e = table(spark, sf_dir, "events")
    key = F.when(F.col("event_id") % 10 != 0, F.col("user_id") * 7 + F.col("event_id") % 50)
    rows = e.select(F.col("event_id").alias("ord"), F.coalesce(key.cast("string"), F.lit("")).alias("id"), F.lit("").alias("url"), F.struct(F.lit("").alias("full")).alias("address"), "event_type")
    both = rows.withColumn("g", F.lit(0)).unionByName(rows.withColumn("g", F.lit(1)))
    return first_wins(both, [], listing_key(), ["g", "ord"]).select("g", "ord", "event_type")


@query("SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL")
def last_wins_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value")
    return last_wins(rows, ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id", "value")


@query("""
SELECT c_custkey AS id, lower(n_name) AS city, r_name AS state FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE n_nationkey IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 3 = 0)
""")
def location_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers whose nation is one of the allowed cities."""
    n = table(spark, sf_dir, "nation").withColumnRenamed("n_regionkey", "r_regionkey").join(table(spark, sf_dir, "region"), "r_regionkey")
    rows = table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 nations
    rows = rows.select(F.col("c_custkey").alias("id"), F.struct(F.col("n_name").alias("city"), F.col("r_name").alias("state"), F.lit("").alias("postalCode")).alias("address"))
    names = [r.n_name for r in n.filter("n_nationkey % 3 = 0").select("n_name").collect()]
    allowed = Boundary(allowed_cities=frozenset(" ".join(x.lower().replace("_", " ").split()) for x in names))
    return rows.filter(W.inside(F.lit("anywhere"), allowed, allow_unknown=False)).select("id", F.lower("address.city").alias("city"), "address.state")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN price IS NULL THEN NULL WHEN inc THEN price WHEN fees >= 0 THEN price + fees END AS total FROM (
  SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 6 <> 0 THEN CAST(floor(l_extendedprice) AS BIGINT) END AS price,
  CASE WHEN l_linenumber % 4 <> 0 THEN CAST(l_quantity AS BIGINT) - 3 END AS fees, CASE WHEN l_linenumber % 5 <> 0 THEN l_returnflag = 'A' END AS inc FROM lineitem)
""")
def total_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_linenumber")
    price = F.when(n % 6 != 0, F.floor("l_extendedprice").cast("long"))
    fees, included = F.when(n % 4 != 0, F.col("l_quantity").cast("long") - 3), F.when(n % 5 != 0, F.col("l_returnflag") == "A")
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", T.total_cost(price, fees, included).alias("total"))


@query("""
WITH o AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 <> 0 THEN CAST(o_totalprice AS BIGINT) END AS total,
  CASE o_orderstatus WHEN 'F' THEN 'FOR_RENT' WHEN 'O' THEN '' ELSE 'SOLD' END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS free, (['in-unit', 'unknown', 'shared'])[CAST(o_orderkey % 3 + 1 AS INT)] AS laundry FROM orders),
k AS (SELECT * FROM o WHERE (total IS NULL OR total <= 200000) AND status <> 'SOLD' AND laundry <> 'shared')
SELECT id, CASE WHEN why = '' THEN 'match' ELSE 'watchlist' END AS status, why AS reasons FROM (SELECT id, concat_ws(';',
  CASE WHEN free IS NULL THEN 'availability needs verification' END,
  CASE WHEN free < DATE '1995-01-01' THEN 'availability is outside the target window' END,
  CASE WHEN total IS NULL THEN 'total monthly cost needs verification' END,
  CASE WHEN status = '' THEN 'current rental status needs verification' END,
  CASE WHEN laundry = 'unknown' THEN 'laundry details are unknown' END) AS why FROM k)
""")
def watchlist_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    rows = o.select(
        key.alias("id"), F.when(key % 4 != 0, F.round("o_totalprice").cast("long")).alias("totalMonthlyCost"),
        F.when(F.col("o_orderstatus") == "F", "FOR_RENT").when(F.col("o_orderstatus") == "O", "").otherwise("SOLD").alias("status"),
        F.when(key % 3 == 0, "").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("availability"),
        F.element_at(F.array(*map(F.lit, ("in-unit", "unknown", "shared"))), (key % 3 + 1).cast("int")).alias("laundry"),
        F.lit("").alias("parking"), F.lit("").alias("petPolicy"), F.array().cast("array<string>").alias("allowedPets"), F.array().cast("array<string>").alias("flexSpaces"), F.lit(1.0).alias("bedrooms"),
    )
    options = DetailFilters(available_from=dt.date(1995, 1, 1), unknown_availability="watchlist", out_of_window_availability="watchlist", max_total_cost=200000, require_for_rent=True, laundry="in-unit", unknown_laundry="watchlist")
    kept = W.advanced(rows, options, F.lit(dt.date(2026, 7, 21)))
    return kept.select("id", F.col("matchStatus").alias("status"), F.array_join("matchReasons", ";").alias("reasons"))


@query("""
WITH prev AS (SELECT o_orderkey AS id, o_orderkey * 3 AS url, CAST(floor(o_totalprice) AS BIGINT) AS price, o_orderpriority AS laundry FROM orders WHERE o_orderkey % 3 <> 0),
now_ AS (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS id, o_orderkey * 3 AS url, o_orderkey AS ord,
  CASE WHEN o_orderkey % 4 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) + CAST(o_orderkey % 2 AS BIGINT) END AS price, o_orderpriority AS laundry FROM orders),
j AS (SELECT n.*, p.id IS NOT NULL AS found, p.price AS old FROM now_ n LEFT JOIN prev p ON p.url = n.url)
SELECT ord, CASE WHEN NOT found THEN 'new-to-digest' WHEN price IS NULL OR price <> old THEN 'previously-surfaced-changed' ELSE 'previously-surfaced-still-active' END AS status,
  CASE WHEN NOT found THEN '' WHEN price IS NULL THEN 'price became unknown' WHEN price > old THEN 'price increased' ELSE '' END AS changes FROM j
""")
def history_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders against an earlier state of some: matched by id, else by link."""
    o, key = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    price = F.floor("o_totalprice").cast("long")
    none = {c: F.lit(None).cast("bigint").alias(c) for c in ("totalMonthlyCost", "requiredMonthlyFees")} | {c: F.lit(None).cast("double").alias(c) for c in ("bedrooms", "bathrooms")}
    same = [F.struct(F.lit("").alias("full")).alias("address"), F.lit("").alias("availability"), F.lit("").alias("status"), F.col("o_orderpriority").alias("laundry"), F.array().cast("array<string>").alias("flexSpaces"), *none.values()]
    url = F.concat(F.lit("u"), (key * 3).cast("string")).alias("url")
    now = o.select(key.alias("ord"), F.when(key % 5 != 0, key.cast("string")).otherwise("").alias("id"), url, F.when(key % 4 != 0, price + key % 2).alias("price"), *same)
    before = o.filter(key % 3 != 0).select(key.alias("ord"), key.cast("string").alias("id"), url, price.alias("price"), *same)
    return annotate_history(now, before, ["ord"]).select("ord", F.col("historyStatus").alias("status"), F.array_join("historyChanges", ";").alias("changes"))


@query("""
WITH e AS (SELECT user_id, CAST(ts AS DATE) AS d, event_id, event_type, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER u AS resets FROM events WINDOW u AS (PARTITION BY user_id ORDER BY CAST(ts AS DATE), event_id)),
last AS (SELECT *, max(resets) OVER (PARTITION BY user_id) AS final FROM e), live AS (SELECT * FROM last WHERE resets = final AND event_type <> 'error'),
l AS (SELECT user_id, arg_max(d, (d, event_id)) AS listed, max((d, event_id)) AS at FROM live WHERE event_type = 'signup' GROUP BY user_id)
SELECT l.user_id, strftime(listed, '%Y-%m-%d') AS listed, strftime(max(live.d), '%Y-%m-%d') AS updated, CAST(DATE '2030-01-01' - listed AS BIGINT) AS days
FROM l JOIN live ON live.user_id = l.user_id AND (live.d, live.event_id) >= l.at GROUP BY l.user_id, listed
""")
def recency_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signup lists, error resets, other events move the date: the last life of each user's ordered events."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "listed for rent").when(F.col("event_type") == "error", "listing removed").otherwise("rent change")
    rows = e.select("user_id", F.to_date("ts").alias("date"), "event_id", kind.alias("event"))
    found = recency_of(rows, ["user_id"], ["event_id"], F.lit(dt.date(2030, 1, 1))).filter("listed IS NOT NULL")
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    return found.select("user_id", text("listed"), text("updated"), "days")


@query(r"""SELECT doc_id, md5(c) AS text_md5, CAST(length(c) AS BIGINT) AS n, (' ' || c || ' ') LIKE '% office %' AS has_office FROM
(SELECT doc_id, trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')) AS c FROM documents)""")
def canonical_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", X.canonical_text(F.col("text")).alias("c"))
    return d.select("doc_id", F.md5("c").alias("text_md5"), F.length("c").cast("long").alias("n"), X.contains_word(F.col("c"), "office").alias("has_office"))


def _any(text: str, *terms: str) -> str:
    return "(" + " OR ".join(f"contains({text}, '{t}')" for t in terms) + ")"


_C = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
_FLEX = ", ".join(
    f"""CASE WHEN {_any("s", *C.FLEX_LISTED[name]) if name in C.FLEX_LISTED else f"(' ' || s || ' ') LIKE '% {name} %'"} OR regexp_matches(said, '\\b(?:{"|".join(C.FLEX_DESCRIBED[name])})\\b') THEN '{name}' END"""
    for name in C.FLEX_SPACES
)
_GARAGE = f"NOT {_any('c', *C.NO_PARKING)} AND {_any('c', *C.PRIVATE_GARAGE)} AND NOT {_any('c', *C.SHARED_GARAGE)}"
_CLASSIFIED = f"""
WITH t AS (SELECT id, f, d, {_C.format("f")} AS s, {_C.format("f || ' | ' || d")} AS c, {_C.format("d")} AS said FROM (
  SELECT doc_id AS id, ([@F])[CAST(doc_id % 12 + 1 AS INT)] AS f, ([@D])[CAST(doc_id % 7 + 1 AS INT)] || ' ' || text AS d FROM documents))
SELECT id, CASE WHEN {_any("s", *C.HOOKUPS_LISTED)} OR {_any("c", *C.HOOKUPS)} THEN 'hookups' WHEN {_any("c", *C.SHARED_LAUNDRY)} THEN 'shared'
  WHEN {_any("c", *C.NO_LAUNDRY)} THEN 'none' WHEN {_any("c", *C.IN_UNIT)} OR contains(s, 'in unit') THEN 'in-unit'
  WHEN contains(s, 'washer') AND contains(s, 'dryer') THEN 'in-unit' ELSE 'unknown' END AS laundry,
CASE WHEN {_any("c", *C.NO_PARKING)} THEN 'none' WHEN {_any("c", *C.PRIVATE_GARAGE)} AND NOT {_any("c", *C.SHARED_GARAGE)} THEN 'private-garage'
  WHEN contains(s, 'garage') OR {_any("c", *C.GARAGE)} THEN 'garage' WHEN {_any("s", *C.PARKING_LISTED)} THEN 'available' ELSE 'unknown' END AS parking,
CASE WHEN s = '' THEN 'unknown' WHEN {_any("s", *C.NO_PETS)} THEN 'not-allowed' WHEN {_any("s", *C.PET_LIMITS)} THEN 'restricted'
  WHEN {_any("s", *C.ALL_PETS, *C.SOME_PETS)} AND ({_any("s", *C.FEW_PETS)} OR ({_any("s", *C.SOME_PETS)} AND NOT {_any("s", *C.ALL_PETS)})) THEN 'restricted'
  WHEN {_any("s", *C.ALL_PETS)} THEN 'allowed' ELSE 'unknown' END AS pets,
concat_ws(',', {_FLEX}, CASE WHEN {_GARAGE} THEN 'private-garage' END) AS flex,
regexp_matches(said, '\\b(?:{"|".join(C.SHARED_HOUSING)})\\b') AS shared_housing, regexp_matches(said, '\\b(?:{"|".join(C.STUDENT_HOUSING)})\\b') AS student_housing FROM t
"""
_FEATURES = ["Washer", "Washer | Dryer", "In Unit", "Washer dryer hookups", "Shared Laundry", "Garage - Attached", "Carport", "Cats, dogs OK", "No pets", "Pets allowed", "Cats only, pets allowed", ""]
_SAID = ["Private office space upstairs", "used as an office", "No laundry. No parking", "coin-operated laundry, shared garage", "room for rent", "attached garage and loft", "quiet"]


@query(_CLASSIFIED.replace("@F", ", ".join(f"'{x}'" for x in _FEATURES)).replace("@D", ", ".join(f"'{x}'" for x in _SAID)))
def keyword_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Laundry, parking, pets, flexible spaces and housing of texts made of feature phrases and whole documents."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("doc_id") % n + 1).cast("int"))
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.array(pick(_FEATURES, 12)).alias("f"), F.concat(pick(_SAID, 7), F.lit(" "), "text").alias("d"))
    nothing = F.lit(None).cast(T.TAGGED)
    shared, student = C.housing_kind(lambda path: nothing, F.array().cast(f"array<map<string, {T.TAGGED}>>"), F.col("d"), F.lit(""))
    parking = C.classify_parking(F.col("f"), F.col("d"))
    return d.select(
        "id", C.classify_laundry(F.col("f"), F.col("d")).alias("laundry"), parking.alias("parking"), C.classify_pets(F.col("f")).alias("pets"),
        F.array_join(C.classify_flex(F.col("d"), F.col("f"), parking), ",").alias("flex"), shared.alias("shared_housing"), student.alias("student_housing"),
    )


_KEYS = "(" + ", ".join(f"'{k}'" for k in R.SENSITIVE) + ")"


@query(f"""
WITH k AS (SELECT doc_id, unnest(regexp_extract_all(text, '([A-Za-z_-]+) = ', 1)) AS name FROM documents), n AS (SELECT doc_id, name, regexp_replace(lower(name), '[^\\p{{L}}\\p{{Nd}}]+', '', 'g') AS k FROM k)
SELECT doc_id, name, k IN {_KEYS} OR regexp_matches(k, '(?:{"|".join(R.ENDINGS)})$') AS sensitive FROM n
""")
def credential_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names before `` = `` in texts, and which of them are sensitive."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.regexp_extract_all("text", F.lit("([A-Za-z_-]+) = "), 1)).alias("name"))
    return d.select("doc_id", "name", R.is_sensitive_key(F.col("name")).alias("sensitive"))


@query(f"SELECT doc_id, {_any('lower(text)', *R.MARKS)} OR regexp_matches(trim(text), '{R.JWT}') AS credential FROM documents")
def credential_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", R.is_credential(F.col("text")).alias("credential"))


@query("""
SELECT p_partkey AS id, CASE CAST(p_partkey % 6 AS INT) WHEN 0 THEN CAST(floor(p_retailprice) AS BIGINT) WHEN 1 THEN p_size * 1500 WHEN 2 THEN NULL WHEN 3 THEN NULL WHEN 4 THEN p_size * 1000000 ELSE p_size + 1 END AS amount FROM part
""")
def money_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts as people write them: grouped, with suffixes, two in one, negative, halves rounded away from zero."""
    n, size = F.col("p_partkey") % 6, F.col("p_size").cast("string")
    whole = F.format_number(F.floor("p_retailprice"), 0)
    text = F.when(n == 0, F.concat(F.lit("$"), whole, F.lit("/mo"))).when(n == 1, F.concat((F.col("p_size") * 1.5).cast("string"), F.lit("k+")))
    text = text.when(n == 2, F.concat(size, F.lit(" - "), whole)).when(n == 3, F.concat(F.lit("-$"), size)).when(n == 4, F.concat(F.lit("$"), size, F.lit("M"))).otherwise(F.concat(size, F.lit(".5")))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), T.parse_money(text).alias("amount"))


@query("""
SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS DOUBLE) / 4 AS quarter,
  CASE WHEN CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 = 0 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) // 4 END AS whole,
  CASE json_extract_string(props, '$.k') WHEN '1' THEN true WHEN '0' THEN false END AS flag FROM events
""")
def json_scalar_coerce(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number in an event's properties as integer, fraction, whole quarter, and boolean text."""
    text = F.get_json_object("props", "$.k")
    tag = lambda kind, c: F.struct(F.lit(kind).alias("kind"), c.alias("text"))
    quarter = (text.cast("decimal(20,0)") / 4).cast("decimal(20,2)").cast("string")
    return table(spark, sf_dir, "events").select("event_id", T.as_long(tag("number", text)).alias("k"), T.as_double(tag("string", quarter)).alias("quarter"), T.as_long(tag("number", quarter)).alias("whole"), T.as_bool(tag("string", text)).alias("flag"))


@query("""
SELECT page_id, CAST(length(html) - length(replace(lower(html), '<script', '')) AS BIGINT) // 7 + page_id % 2 AS scripts, regexp_matches(html, '^\\s*<') AS is_html,
  CASE WHEN page_id % 4 = 1 THEN '{"n":' || page_id || ',"s":"<b>"}' END AS data FROM pages
""")
def script_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' script elements; half of them have one more, and half of those hold application data."""
    p, key = table(spark, sf_dir, "pages"), F.col("page_id")
    name = F.when(key % 4 == 1, "__NEXT_DATA__").otherwise("other")
    data = F.concat(F.lit("<script type=x data-a='>' ID=\""), name, F.lit('"> {"n":'), key.cast("string"), F.lit(',"s":"<b>"} </script>'))
    html = F.when(key % 2 == 1, F.concat("html", data)).otherwise(F.col("html"))
    scripts = F.size(F.split(F.lower(html), "<script")) - 1
    return p.select("page_id", scripts.cast("long").alias("scripts"), html.rlike(r"^\s*<").alias("is_html"), embedded_script(html).alias("data"))


@query("""
WITH e AS (SELECT event_id, user_id, event_type, CASE event_type WHEN 'purchase' THEN 'fetch' WHEN 'error' THEN 'ping' ELSE 'image' END AS kind, CAST(200 + 100 * (event_id % 4) AS INT) AS status FROM events)
SELECT event_id, CAST(40 + CASE WHEN kind = 'image' THEN -90 WHEN kind = 'fetch' THEN 35 ELSE -80 END + CASE WHEN kind = 'fetch' THEN 30 ELSE 0 END
  + CASE WHEN event_id % 2 = 0 THEN 12 ELSE 4 END + CASE WHEN status < 300 THEN 5 WHEN status >= 400 THEN -25 ELSE 0 END AS INT) AS score,
  row_number() OVER (ORDER BY 40 + CASE WHEN kind = 'image' THEN -90 WHEN kind = 'fetch' THEN 35 ELSE -80 END + CASE WHEN kind = 'fetch' THEN 30 ELSE 0 END
  + CASE WHEN event_id % 2 = 0 THEN 12 ELSE 4 END + CASE WHEN status < 300 THEN 5 WHEN status >= 400 THEN -25 ELSE 0 END DESC, event_id) <= 50 AS top FROM e QUALIFY top
""")
def additive_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as requests, scored by rules; the 50 best."""
    kind = F.when(F.col("event_type") == "purchase", "fetch").when(F.col("event_type") == "error", "ping").otherwise("image")
    given = F.when(kind == "fetch", "application/json").otherwise("text/plain")
    method = F.when(F.col("event_id") % 2 == 0, "PUT").otherwise("GET")
    rules = A.score_rules(method, F.lit(f"www.{A.SITE_HOST}"), F.lit("/x"), kind, F.lit(""), given, (200 + 100 * (F.col("event_id") % 4)).cast("int"), F.lit(True))
    score, _ = A.add_up(rules)
    rows = table(spark, sf_dir, "events").select("event_id", score.cast("int").alias("score"))
    return rows.orderBy(F.desc("score"), "event_id").limit(50).withColumn("top", F.lit(True))


@query("""
WITH i AS (SELECT event_type AS route, CAST(dayofmonth(ts) AS BIGINT) AS page, user_id FROM events), p AS (SELECT route, page, count(*) AS n FROM i GROUP BY ALL)
SELECT route, (SELECT count(DISTINCT page) FROM p WHERE p.route = r.route) AS "pagesFetched", CAST(31 AS BIGINT) AS "totalPages", (SELECT arg_max(n, page) FROM p WHERE p.route = r.route) AS "totalResults",
  count(DISTINCT user_id) AS "uniqueListings", max(page) >= 31 AS complete FROM i r GROUP BY route
""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as routes, days as pages, users as listings."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("route"), F.dayofmonth("ts").cast("long").alias("page"), F.col("event_id").alias("ord"), F.col("user_id").cast("string").alias("id"), F.lit("").alias("url"), F.struct(F.lit("").alias("full")).alias("address"))
    pages = e.groupBy("route", "page").agg(F.count(F.lit(1)).alias("n_items")).withColumn("total_pages", F.lit(31).cast("long")).withColumn("total_results", F.col("n_items"))
    return route_coverage(pages, e)


@query("""
SELECT conv_id, len(list_intersect(list_distinct(list(lower(role))), ['system', 'tool'])) > 0 AS special, array_to_string(list_sort(list_distinct(list(lower(role)))), ',') AS roles FROM conversations GROUP BY conv_id
""")
def any_of_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.collect_set("role").alias("roles"))
    return c.select("conv_id", X.has_any_value(F.col("roles"), ["system", "Tool "]).alias("special"), F.array_join(X.text_set(F.col("roles")), ",").alias("roles"))


@query(r"""
SELECT page_id, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
  CASE WHEN p = '' THEN '/' ELSE p END AS path, CASE WHEN page_id % 3 <> 0 THEN CAST(page_id + 1 AS VARCHAR) END AS id, CAST(2 + page_id % 4 AS INT) AS items, 'b ' || page_id AS second,
  'k=' || array_to_string(list_transform(range(page_id % 4), lambda x: CAST(x AS VARCHAR)), ',k=') AS rest FROM (SELECT *, regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)', 1) AS p FROM pages)
""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts and paths of pages; identifiers and query items of links made from them, as many as the page says."""
    key = F.col("page_id")
    more = F.when(key % 4 > 0, F.array_join(F.transform(F.sequence(F.lit(0), (key % 4 - 1).cast("int")), lambda x: F.concat(F.lit("&k="), x.cast("string"))), "")).otherwise("")
    name = F.when(key % 3 != 0, F.concat(F.lit("/x/00"), (key + 1).cast("string"), F.lit("_zpid/"))).otherwise("/x/none/")
    link = F.concat(F.regexp_replace("url", "[?#].*$", ""), name, F.lit("?bad=%zz&q=b%20"), key.cast("string"), more, F.lit("#q=1"))
    items = query_items(link)
    rest = F.array_join(F.transform(F.filter(items, lambda i: i["name"] == "k"), lambda i: i["value"]), ",k=")
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", A.host_of(F.col("url")).alias("host"), A.path_of(F.col("url")).alias("path"), identifier_in_url(link).alias("id"), F.size(items).alias("items"), F.get(items, F.lit(1))["value"].alias("second"), F.concat(F.lit("k="), rest).alias("rest"))


@query("""
SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN 'price' WHEN c_custkey % 3 = 1 THEN '' ELSE '' END || CASE WHEN c_custkey % 3 = 0 THEN ' confirmed' WHEN c_custkey % 3 = 1 THEN '' ELSE 'price decreased' END AS change,
  '$' || format('{:,}', CAST(floor(abs(c_acctbal)) AS BIGINT)) AS price, format('{:,}', CAST(c_custkey AS BIGINT) * 1000) AS big, CAST(c_nationkey AS VARCHAR) || CASE WHEN c_custkey % 2 = 0 THEN '' ELSE '.5' END AS beds FROM customer
""")
def money_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    amount = F.floor(F.abs("c_acctbal")).cast("long")
    before = F.when(key % 3 == 0, None).when(key % 3 == 1, amount).otherwise(amount + 5)
    beds = F.col("c_nationkey") + F.when(key % 2 == 0, 0.0).otherwise(0.5)
    return table(spark, sf_dir, "customer").select(key.alias("id"), F.coalesce(money_change("price", before, amount), F.lit("")).alias("change"), money(amount).alias("price"), comma(key * 1000).alias("big"), number(beds).alias("beds"))


@query("""
WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS request_id, CAST(floor(value) AS BIGINT) AS bytes, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events),
h AS (SELECT request_id, n // 5 AS hop, min(event_id) AS seq, count(*) AS k FROM e GROUP BY ALL),
l AS (SELECT *, lead(hop) OVER (PARTITION BY request_id ORDER BY hop) IS NULL AS open FROM h)
SELECT seq, request_id, CAST(hop AS INT) AS hop, 'GET' AS method, 'https://host/' || seq AS url, CASE WHEN k >= 3 AND (k >= 4 OR NOT open) THEN 200 WHEN NOT open THEN 302 END AS status,
  CASE WHEN k >= 4 THEN 'HTTP/2' ELSE '' END AS "httpVersion", 'Fetch' AS "resourceType", CAST(CASE WHEN k >= 5 THEN 10 ELSE -1 END AS BIGINT) AS "bodySize", CAST(CASE WHEN k >= 5 THEN 10 ELSE 0 END AS BIGINT) AS "contentSize",
  '' AS "mimeType", '' AS "redirectURL", k < 4 AND open AS incomplete,
  concat_ws(' ', CASE WHEN k < 5 THEN 'Request was still in flight at the capture cutoff; timing and sizes are incomplete.' END,
    CASE WHEN k < 4 THEN 'Supplemental request/response metadata did not arrive before the capture cutoff.' END) AS comment FROM l
""")
def stream_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events replayed as a browser's: each user's requests in a chain of redirects, with late supplements."""
    e = table(spark, sf_dir, "events")
    order = Window.partitionBy("user_id").orderBy("event_id")
    n = F.row_number().over(order)
    kinds = F.array(*map(F.lit, ("requestWillBeSent", "requestWillBeSentExtraInfo", "responseReceivedExtraInfo", "responseReceived", "loadingFinished")))
    kind = F.element_at(kinds, ((n - 1) % 5 + 1).cast("int"))
    rows = e.select(
        F.col("event_id").alias("seq"), kind.alias("event_type"), F.col("user_id").cast("string").alias("request_id"), F.unix_micros(F.to_timestamp("ts")).cast("double").alias("us"), n.alias("n"), "value"
    )
    text, whole = F.lit(None).cast("string"), F.lit(None).cast("int")
    sent, got = F.col("event_type") == "requestWillBeSent", F.col("event_type") == "responseReceived"
    events = rows.select(
        "seq", "event_type", "request_id", (F.col("us") / 1e6).alias("ts_mono"), (F.col("us") / 1e6).alias("ts_wall"),
        F.when(sent, F.concat(F.lit("https://host/"), "seq")).alias("url"), F.when(sent, F.lit("GET")).alias("method"), F.when(sent, F.lit("Fetch")).alias("type"),
        F.when(got | (F.col("event_type") == "responseReceivedExtraInfo"), 200).alias("status"), F.when(got, True).alias("has_extra_info"),
        F.when(sent & (F.col("n") > 1), 302).otherwise(whole).alias("redirect_status"), F.when(sent & (F.col("n") > 1), True).alias("redirect_has_extra_info"),
        F.create_map(F.lit("Content-Length"), F.lit("10")).alias("headers"), F.floor("value").cast("long").alias("encoded_length"), F.when(got, F.lit("h2")).alias("protocol"), text.alias("error"), text.alias("mime_type"),
    )
    return archive_entries(hops(events)).drop("time", "blocked", "wait", "receive")


from terrasift import archive_queries, document_queries, run_queries, search_queries, tree_queries  # noqa: E402  they register themselves

__all__ = ["ORACLES", "QUERIES", "archive_queries", "document_queries", "run_queries", "search_queries", "tree_queries"]
