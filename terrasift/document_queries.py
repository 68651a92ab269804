"""Queries over saved pages: documents made from the test tables go through parsing, normalization, choice and enrichment."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.operators.enrich import enrich
from terrasift.operators.normalize import SITE
from terrasift.plans.search import page_details, snapshot_listings
from terrasift.registry import query, table

TODAY = dt.date(2026, 7, 21)
#: Parts of a document, and of a task that makes documents of them.
EACH, TASK_PARTS = 50, 5_000


def json_of(**fields: Column) -> Column:
    """An object; null fields are left out."""
    return F.to_json(F.struct(*(c.alias(name) for name, c in fields.items())))


def json_list(rows: Column) -> Column:
    """An array of what (order, json) rows hold, in their order; null rows are left out."""
    kept = F.filter(F.sort_array(F.collect_list(rows)), lambda r: r["json"].isNotNull())
    return F.concat(F.lit("["), F.array_join(F.transform(kept, lambda r: r["json"]), ","), F.lit("]"))


def in_order(*order: Column, json: Column) -> Column:
    return F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order)), json.alias("json"))


def page_of(json: Column) -> Column:
    """A page with a decoy in a comment and an attribute that holds a bracket."""
    return F.concat(F.lit("<html><!-- <script id='__NEXT_DATA__'>{}</script> --><script nonce=\"a>b\" id='__NEXT_DATA__'>"), json, F.lit("</script></html>"))


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, dealt by document while they are narrow, over as many tasks as there is parsing to do."""
    p = table(spark, sf_dir, "part")
    key = F.col("p_partkey") + 1  # 0 identifies nothing
    rows = p.select(key.alias("k"), F.floor(key / EACH).cast("long").alias("doc"), F.col("p_size").cast("long").alias("s"), F.floor("p_retailprice").cast("long").alias("amount"))
    return rows.repartition(p.count() // TASK_PARTS + 1, "doc")


def search_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_id, document: search results of parts, half of them as pages; one document in seven has a faulty listing."""
    k, s, amount = F.col("k"), F.col("s"), F.col("amount")
    name, when = k.cast("string"), F.when
    listed = json_of(
        zpid=name, detailUrl=F.concat(F.lit("/homedetails/"), name, F.lit("_zpid/")), unformattedPrice=when(k % 3 != 0, amount),
        price=when((k % 3 == 0) & (k % 11 != 0), F.concat(F.lit("$"), F.format_number(amount, 0), F.lit("/mo"))),
        beds=when(k % 2 == 0, (s % 6).cast("string")), bedrooms=when(k % 2 == 1, s % 6), baths=s % 4, area=s * 40, homeType=when(k % 5 != 0, "CONDO").otherwise(""),
        isBuilding=k % 9 == 0, units=when(k % 9 == 0, F.array(F.struct((s % 4).cast("string").alias("beds")), F.struct((k % 7).cast("string").alias("beds")))),
        address=F.struct(F.concat(name, F.lit(" Main St")).alias("streetAddress"), F.lit("Springfield").alias("city"), F.lit("WA").alias("state"), (s + 98100).alias("zipcode")),
        totalRequiredMonthlyMinFee=when(k % 4 == 1, 50), listPriceIncludesRequiredMonthlyFees=when(k % 4 == 1, k % 8 == 1), daysOnZillow=k % 13,
        roomForRent=k % 13 == 0, description=when(k % 17 == 0, "Income limits apply."), availabilityDate=F.concat(F.lit("2026-09-"), F.lpad((s % 28 + 1).cast("string"), 2, "0")),
    )
    mapped = when(k % 10 == 7, json_of(zpid=k + 1_000_000_000, unformattedPrice=s)).when(k % 4 == 0, json_of(zpid=name, unformattedPrice=F.lit(1)))
    docs = parts(spark, sf_dir).groupBy("doc").agg(json_list(in_order(k, json=listed)).alias("listed"), json_list(in_order(k, json=mapped)).alias("mapped"), F.count(F.lit(1)).alias("n"))
    fault = F.when(F.col("doc") % 7 == 6, F.regexp_replace("listed", r"\]$", ',{"zpid":"5","beds":"many"}]')).otherwise(F.col("listed"))
    state = F.concat(
        F.lit('{"props":{"pageProps":{"searchPageState":{"queryState":{"pagination":{"currentPage":'), F.col("doc").cast("string"), F.lit('}},"cat1":{"searchResults":{"listResults":'), fault,
        F.lit(',"mapResults":'), F.col("mapped"), F.lit(',"relaxedResults":true},"searchList":{"resultsPerPage":41,"totalPages":"2","totalResultCount":'), F.col("n").cast("string"), F.lit("}}}}}}"),
    )
    return docs.select(F.col("doc").cast("string").alias("source_id"), F.when(F.col("doc") % 2 == 1, page_of(state)).otherwise(state).alias("document"))


_P = f"SELECT p_partkey + 1 AS k, (p_partkey + 1) // {EACH} AS doc, CAST(p_size AS BIGINT) AS s, CAST(floor(p_retailprice) AS BIGINT) AS amount FROM part"
_LISTED = f"""
WITH p AS ({_P}), ok AS (SELECT *, CASE WHEN k % 3 <> 0 OR k % 11 <> 0 THEN amount END AS price FROM p WHERE doc % 7 <> 6)
SELECT doc, CAST(k AS VARCHAR) AS id, '{SITE}/homedetails/' || k || '_zpid/' AS url, price, CASE WHEN k % 8 = 1 THEN price WHEN k % 4 = 1 THEN price + 50 END AS total,
  CAST(CASE WHEN k % 9 = 0 THEN greatest(s % 4, k % 7) ELSE s % 6 END AS DOUBLE) AS bedrooms, CAST(s % 4 AS DOUBLE) AS bathrooms, s * 40 AS area,
  k || ' Main St, Springfield WA ' || (s + 98100) AS address, CASE WHEN k % 5 <> 0 THEN 'CONDO' WHEN k % 9 = 0 THEN 'APARTMENT' ELSE '' END AS home_type, k % 9 = 0 AS building,
  k % 13 = 0 AS shared, k % 17 = 0 AS restricted, k % 13 AS days, '2026-09-' || lpad(CAST(s % 28 + 1 AS VARCHAR), 2, '0') AS availability FROM ok
UNION ALL SELECT doc, CAST(k + 1000000000 AS VARCHAR), '{SITE}/homedetails/' || (k + 1000000000) || '_zpid/', s, NULL, NULL, NULL, NULL, '', '', false, false, false, NULL, '' FROM ok WHERE k % 10 = 7
"""


@query(_LISTED)
def search_page_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of saved search pages: the list's before the map's, each once, none of a document that drifts."""
    rows, _ = snapshot_listings(search_pages(spark, sf_dir), F.lit(TODAY))
    return rows.select(
        F.col("source_id").cast("long").alias("doc"), "id", "url", "price", F.col("totalMonthlyCost").alias("total"), "bedrooms", "bathrooms", F.col("livingArea").alias("area"),
        F.col("address.full").alias("address"), F.col("homeType").alias("home_type"), F.col("isBuilding").alias("building"), F.col("sharedHousing").alias("shared"),
        F.col("incomeRestricted").alias("restricted"), F.col("daysListed").alias("days"), "availability",
    )


@query(f"""
WITH p AS ({_P}) SELECT doc, doc % 7 = 6 AS drifts, CASE WHEN doc % 7 = 6 THEN 'cat1.searchResults.listResults[' || count(*) || ']: beds must be numeric' ELSE '' END AS drift,
  CAST(doc AS INT) AS page, CAST(CASE WHEN doc % 7 = 6 THEN 0 ELSE count(*) + sum(CASE WHEN k % 10 = 7 THEN 1 ELSE 0 END) END AS BIGINT) AS returned, CAST(41 AS INT) AS per_page, CAST(2 AS INT) AS pages, CAST(count(*) AS INT) AS total, true AS relaxed FROM p GROUP BY doc
""")
def search_page_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What search pages say about themselves, or where they drift."""
    _, told = snapshot_listings(search_pages(spark, sf_dir), F.lit(TODAY))
    return told.select(
        F.col("source_id").cast("long").alias("doc"), F.col("drift").isNotNull().alias("drifts"), F.concat_ws(": ", "drift.path", "drift.detail").alias("drift"), F.col("currentPage").alias("page"),
        F.col("returned").cast("long").alias("returned"), F.col("resultsPerPage").alias("per_page"), F.col("totalPages").alias("pages"), F.col("totalResults").alias("total"), F.col("relaxedResults").alias("relaxed"),
    )


@query(f"""
WITH p AS ({_P}), u AS (SELECT *, k % 5 AS plan, CASE WHEN k % 3 <> 0 THEN amount ELSE 1000 + 100 * (k % 5) END AS price FROM p),
r AS (SELECT doc, CAST(k AS VARCHAR) AS id, price, CASE WHEN k % 2 = 0 THEN price + 75 END AS total, CAST(CASE WHEN k % 4 = 0 THEN s % 3 ELSE plan END AS DOUBLE) AS bedrooms,
  CASE WHEN plan = 0 THEN 'in-unit' WHEN doc % 2 = 0 THEN 'shared' ELSE 'unknown' END AS laundry, '2026-10-01' AS availability, doc || ' Oak Ave #' || k || ', Salem OR 97301' AS address, CASE WHEN k % 2 = 0 THEN 0 ELSE 1 END AS notes FROM u
  UNION ALL SELECT DISTINCT doc, CAST(900000000 + doc AS VARCHAR), CAST(900 AS BIGINT), CAST(NULL AS BIGINT), CAST(1 AS DOUBLE), CASE WHEN doc % 2 = 0 THEN 'shared' ELSE 'unknown' END, '', doc || ' Oak Ave, Salem OR 97301', 2 FROM u)
SELECT doc, id, '{SITE}/homedetails/' || id || '_zpid/' AS url, price, total, bedrooms, laundry, availability, address, CAST(notes AS INT) AS notes FROM r
""")
def community_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of community pages, each once with its plan's values where it has none, and plans without units."""
    k, s, plan = F.col("k"), F.col("s"), F.col("plan")
    name, when = k.cast("string"), F.when
    unit = json_of(
        zpid=name, unitNumber=name, baseRent=when(k % 3 != 0, F.col("amount")), beds=when(k % 4 == 0, s % 3), totalRequiredMonthlyMinFee=when(k % 2 == 0, 75),
        listPriceIncludesRequiredMonthlyFees=when(k % 2 == 0, False), availableFrom=F.lit("2026-10-01"),
    )
    rows = parts(spark, sf_dir).withColumn("plan", k % 5)
    again = rows.withColumns({"unit": json_of(zpid=name, baseRent=F.lit(1)), "n": F.lit(1)}).filter(k % 6 == 0)
    plans = rows.withColumns({"unit": unit, "n": F.lit(0)}).unionByName(again).groupBy("doc", "plan").agg(json_list(in_order(k, F.col("n"), json=F.col("unit"))).alias("units"))
    head = json_of(beds=plan, minBaseRent=plan * 100 + 1000, amenityDetails=when(plan == 0, F.array(F.lit("In unit washer"))))
    whole = F.concat(F.regexp_replace(head, r"\}$", ',"units":'), "units", F.lit("}"))
    docs = plans.groupBy("doc").agg(json_list(in_order(plan, json=whole)).alias("plans"))
    doc = F.col("doc")
    bare = json_of(zpid=(doc + 900_000_000).cast("string"), minPrice=F.lit("$900"), beds=F.lit(1))
    building = json_of(
        streetAddress=F.concat(doc.cast("string"), F.lit(" Oak Ave")), city=F.lit("Salem"), state=F.lit("OR"), zipcode=F.lit("97301"), buildingAttributes=F.struct((doc % 2 == 0).alias("hasSharedLaundry"))
    )
    building = F.concat(F.regexp_replace(building, r"\}$", ',"floorPlans":'), F.regexp_replace("plans", r"\]$", ","), bare, F.lit("]}"))
    state = F.concat(F.lit('{"props":{"pageProps":{"componentProps":{"initialReduxState":{"gdp":{"building":'), building, F.lit("}}}}}}"))
    found, _ = page_details(docs.select(doc.cast("string").alias("link"), page_of(state).alias("document")), F.lit(TODAY))
    return found.select(
        F.col("link").cast("long").alias("doc"), "id", "url", "price", F.col("totalMonthlyCost").alias("total"), "bedrooms", "laundry", "availability",
        F.col("address.full").alias("address"), F.size("verificationNotes").alias("notes"),
    )


def property_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """link, document: a page for each supplier, some with other properties beside it, no identifier, or no data."""
    k = F.col("s_suppkey")
    when, text = F.when, k.cast("string")
    event = lambda date, name: F.struct(F.lit(date).alias("date"), name.alias("event"), F.lit(True).alias("postingIsRental"))
    facts = F.struct(
        when(k % 2 == 0, F.array(F.lit("Attached Garage"))).alias("parkingFeatures"), when(k % 3 == 0, F.array(F.lit("In Unit"))).alias("laundryFeatures"),
        when(k % 4 == 0, F.array(F.struct(F.lit("Office").alias("roomType")))).alias("rooms"), (k % 100 + 1900).alias("yearBuilt"),
    )
    own = json_of(
        zpid=k, url=F.concat(F.lit("/homedetails/"), text, F.lit("_zpid/")), streetAddress=F.concat(text, F.lit(" Elm Rd")), city=F.lit("Boise"), state=F.lit("ID"), zipcode=F.lit("83701"),
        price=F.concat(F.lit("$"), F.format_number(F.floor(F.abs("s_acctbal")), 0)), bedrooms=k % 5, resoFacts=facts,
        priceHistory=F.array(event("2026-07-10", F.lit("Listed for rent")), event("2026-07-18", when(k % 5 == 0, "Listing removed").otherwise("Price change"))),
    )
    other = json_of(zpid=k + 1_000_000, url=F.lit("/x"), price=F.lit(1), bedrooms=F.lit(1), bathrooms=F.lit(2), livingArea=F.lit(3), yearBuilt=F.lit(1999), homeType=F.lit("CONDO"), description=F.lit("rich"))
    cache = F.concat(F.lit('{"a":{"property":'), own, when(k % 7 != 0, F.concat(F.lit('},"b":[{"property":'), other, F.lit("}]}"))).otherwise("}}"))
    told = when(k % 2 == 1, F.concat(F.lit('"'), F.replace(F.replace(cache, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(cache)
    named = when(k % 6 != 1, F.concat(F.lit(',"zpid":"'), text, F.lit('"'))).otherwise("")
    state = F.concat(F.lit('{"props":{"pageProps":{"componentProps":{"gdpClientCache":'), told, F.lit("}"), named, F.lit("}}}"))
    link = F.concat(F.lit(f"{SITE}/homedetails/"), text, F.lit("_zpid/"))
    return table(spark, sf_dir, "supplier").select(link.alias("link"), when(k % 9 == 0, "<html><body>gone</body></html>").otherwise(page_of(state)).alias("document"))


_CHOSEN = f"""
SELECT '{SITE}/homedetails/' || k || '_zpid/' AS link, found, CASE WHEN found THEN CAST(k AS VARCHAR) END AS id, CASE WHEN found THEN amount END AS price, CASE WHEN found THEN CAST(k % 5 AS DOUBLE) END AS bedrooms,
  CASE WHEN found THEN CASE WHEN k % 2 = 0 THEN 'private-garage' ELSE 'unknown' END END AS parking, CASE WHEN found THEN CASE WHEN k % 3 = 0 THEN 'in-unit' ELSE 'unknown' END END AS laundry,
  CASE WHEN found THEN concat_ws(',', CASE WHEN k % 4 = 0 THEN 'office' END, CASE WHEN k % 2 = 0 THEN 'private-garage' END) END AS flex, CASE WHEN found THEN 1900 + k % 100 END AS year,
  CASE WHEN found AND k % 5 <> 0 THEN CAST(11 AS BIGINT) END AS days, CASE WHEN found THEN CASE WHEN k % 5 <> 0 THEN '2026-07-10' ELSE '' END END AS listed,
  CASE WHEN found THEN '' WHEN k % 9 = 0 THEN 'script#__NEXT_DATA__: required data script is missing' ELSE 'property: multiple distinct property candidates are ambiguous: ' || array_to_string(list_sort(['id:' || k, 'id:' || (k + 1000000)]), ', ') END AS error
FROM (SELECT s_suppkey AS k, CAST(floor(abs(s_acctbal)) AS BIGINT) AS amount, s_suppkey % 9 <> 0 AND (s_suppkey % 6 <> 1 OR s_suppkey % 7 = 0) AS found FROM supplier)
"""


@query(_CHOSEN)
def property_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The property that a page is about, or why there is none."""
    found, errors = page_details(property_pages(spark, sf_dir), F.lit(TODAY))
    rows = found.select(
        "link", F.lit(True).alias("found"), "id", "price", "bedrooms", "parking", "laundry", F.array_join("flexSpaces", ",").alias("flex"), F.col("yearBuilt").alias("year"),
        F.col("daysListed").alias("days"), F.col("listedDate").alias("listed"), F.lit("").alias("error"),
    )
    return rows.unionByName(errors.withColumn("found", F.lit(False)), allowMissingColumns=True)


@query(f"""
WITH l AS ({_LISTED}), d AS ({_CHOSEN})
SELECT l.id, coalesce(d.price, l.price) AS price, coalesce(d.bedrooms, l.bedrooms) AS bedrooms, coalesce(d.laundry, 'unknown') AS laundry, coalesce(d.flex, '') AS flex, d.year, coalesce(d.days, l.days) AS days,
  CASE WHEN coalesce(d.found, false) THEN 'enriched' ELSE 'unavailable' END AS status, CASE WHEN d.found THEN '' ELSE coalesce(d.error, 'property details were not fetched') END AS error
FROM l LEFT JOIN d ON d.link = l.url
""")
def listing_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings of search pages with what the pages behind their links tell."""
    listings, _ = snapshot_listings(search_pages(spark, sf_dir), F.lit(TODAY))
    details, errors = page_details(property_pages(spark, sf_dir), F.lit(TODAY))
    rows = enrich(listings, details, errors)
    return rows.select(
        "id", "price", "bedrooms", "laundry", F.array_join("flexSpaces", ",").alias("flex"), F.col("yearBuilt").alias("year"), F.col("daysListed").alias("days"),
        F.col("detailStatus").alias("status"), F.col("detailError").alias("error"),
    )
