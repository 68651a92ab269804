"""Queries over whole searches and over enrichment, on listings made of orders and pages made of their lines."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.operators.enrich import backfill_recency, enrich
from terrasift.plans.search import ROW, SearchPlan
from terrasift.registry import query, table
from terrasift.schemas import LISTING_FIELDS, PROPERTY_FIELDS
from terrasift.spec import Boundary, DetailFilters, SearchFilters, SearchSpec

TODAY = dt.date(2026, 7, 21)
SPEC = SearchSpec(
    filters=SearchFilters(max_price=200_000, min_beds=1), details=DetailFilters(laundry="in-unit", unknown_laundry="watchlist", exclude_shared=True, max_days=30),
    boundary=Boundary(allowed_cities=frozenset({"springfield"})), sort_by="price-asc", limit=5,
)


def filled(rows: DataFrame, fields: dict[str, str], given: dict[str, Column], *others: str) -> DataFrame:
    """All of ``fields``: what is given, else nothing: empty text, empty lists, nulls."""

    def empty(kind: str) -> Column:
        return F.lit("") if kind == "string" else F.array().cast(kind) if kind.startswith("array") else F.lit(None).cast(kind)

    return rows.select(*others, *((given[name] if name in given else empty(kind)).cast(kind).alias(name) for name, kind in fields.items()))


def place(full: Column, city: Column) -> Column:
    return F.struct(F.lit("").alias("street"), city.alias("city"), F.lit("").alias("state"), F.lit("").alias("postalCode"), full.alias("full"))


def order_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").withColumns({"location": F.col("o_orderpriority"), "group": F.lit(0), "ord": k})
    given = {
        "id": k.cast("string"), "url": F.when(k % 7 != 0, F.concat(F.lit("https://h/"), k.cast("string"))).otherwise(" "), "price": F.when(k % 5 != 0, F.floor("o_totalprice")), "bedrooms": (k % 6).cast("double"),
        "isBuilding": k % 9 == 0, "sharedHousing": k % 13 == 0, "daysListed": F.when(k % 4 != 1, k % 40), "address": place(F.lit(""), F.element_at(F.array(*map(F.lit, ("Springfield", "Shelby", ""))), (k % 3 + 1).cast("int"))),
        "status": F.lit("FOR_RENT"), "laundry": F.lit("unknown"),
    }
    return filled(rows, LISTING_FIELDS, given, "location", "group", "ord")


def line_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every ninth page is a community of all its lines, another has its first line as its property; some have none."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").filter((F.col("l_returnflag") != "N") & ((k % 9 == 0) | (n == 1)))
    rows = lines.withColumns({"link": F.concat(F.lit("https://h/"), k.cast("string")), "kind": F.when(k % 9 == 0, "community").otherwise("property"), "ord": n - 1})
    given = {
        "id": F.concat_ws("-", k.cast("string"), n.cast("string")), "price": F.when(F.col("l_quantity") >= 10, F.floor("l_extendedprice")), "bedrooms": F.when(k % 9 == 0, n.cast("double")),
        "daysListed": F.when(k % 9 == 0, n * 3), "laundry": F.element_at(F.array(*map(F.lit, ("in-unit", "shared", "unknown"))), (n % 3 + 1).cast("int")), "sharedHousing": F.lit(False),
        "address": place(F.when(k % 9 == 0, "1 Unit St").otherwise(""), F.lit("Springfield")),
    }
    return filled(rows, PROPERTY_FIELDS, given, "link", "kind", "ord")


def search(spark: SparkSession, sf_dir: str) -> DataFrame:
    listings = order_listings(spark, sf_dir)
    before = listings.filter(F.col("ord") % 2 == 0).withColumn("price", F.col("price") + 1)
    return SearchPlan(SPEC, TODAY).build(listings, line_details(spark, sf_dir), previous=before, order=["ord"])


_LINES = """SELECT l_orderkey AS k, l_linenumber AS n, CASE WHEN l_quantity >= 10 THEN CAST(floor(l_extendedprice) AS BIGINT) END AS price,
  (['in-unit', 'shared', 'unknown'])[CAST(l_linenumber % 3 + 1 AS INT)] AS laundry FROM lineitem WHERE l_returnflag <> 'N' AND (l_orderkey % 9 = 0 OR l_linenumber = 1)"""
_ORDERS = """SELECT o_orderkey AS k, o_orderpriority AS location, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(floor(o_totalprice) AS BIGINT) END AS price, CAST(o_orderkey % 6 AS DOUBLE) AS beds,
  o_orderkey % 9 = 0 AS building, o_orderkey % 13 = 0 AS shared, CASE WHEN o_orderkey % 4 <> 1 THEN o_orderkey % 40 END AS days, o_orderkey % 3 AS city FROM orders"""


@query(f"""
WITH l AS ({_ORDERS}), d AS ({_LINES}),
b AS (SELECT * FROM l WHERE (price <= 200000 OR (price IS NULL AND building)) AND (building OR beds >= 1) AND city <> 1 AND (building OR ((days <= 30 OR days IS NULL) AND NOT shared))),
e AS (SELECT b.k, location, d.k IS NOT NULL AS found, d.k IS NOT NULL AND building AS child, coalesce(d.n, 1) AS n, coalesce(d.price, b.price) AS price, CASE WHEN d.k IS NOT NULL AND building THEN d.n ELSE beds END AS beds,
  building AND d.k IS NULL AS building, CASE WHEN d.k IS NULL THEN shared ELSE false END AS shared, CASE WHEN d.k IS NOT NULL AND building THEN d.n * 3 ELSE days END AS days, city, coalesce(d.laundry, 'unknown') AS laundry
  FROM b LEFT JOIN d ON d.k = b.k AND b.k % 7 <> 0),
f AS (SELECT * FROM e WHERE (price <= 200000 OR (price IS NULL AND building)) AND (building OR beds >= 1) AND (child OR city = 0) AND NOT shared AND laundry <> 'shared' AND days <= 30),
r AS (SELECT *, row_number() OVER (PARTITION BY location ORDER BY price ASC NULLS LAST, k, n) AS rank FROM f)
SELECT location, CAST(rank AS BIGINT) AS rank, CASE WHEN child THEN k || '-' || n ELSE CAST(k AS VARCHAR) END AS id, price, CAST(beds AS DOUBLE) AS beds, days, CASE WHEN found THEN 'enriched' ELSE 'unavailable' END AS details,
  CASE WHEN laundry = 'unknown' THEN 'laundry details are unknown' ELSE '' END AS reasons, k % 2 <> 0 OR (child AND k % 7 = 0) AS is_new FROM r WHERE rank <= 5
""")
def search_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole search: both filters around the details, the watchlist, recency, the cheapest five of each location, history."""
    return search(spark, sf_dir).select(
        "location", F.col("rank").cast("bigint").alias("rank"), "id", "price", F.col("bedrooms").alias("beds"), F.col("daysListed").alias("days"), F.col("detailStatus").alias("details"),
        F.array_join("matchReasons", ";").alias("reasons"), (F.col("historyStatus") == "new-to-digest").alias("is_new"),
    )


@query(f"""
WITH l AS ({_ORDERS}), d AS ({_LINES})
SELECT l.k AS parent, coalesce(d.n, 1) - 1 AS child, CASE WHEN d.k IS NOT NULL AND building THEN d.k || '-' || d.n ELSE CAST(l.k AS VARCHAR) END AS id, coalesce(d.price, l.price) AS price,
  CASE WHEN d.k IS NOT NULL AND building THEN d.n ELSE beds END AS beds, CASE WHEN d.k IS NOT NULL AND building THEN d.n * 3 ELSE days END AS days, coalesce(d.laundry, 'unknown') AS laundry, building AND d.k IS NULL AS building,
  CASE WHEN d.k IS NOT NULL AND building THEN '1 Unit St' ELSE '' END AS address, CASE WHEN d.k IS NOT NULL THEN '' WHEN l.k % 7 = 0 THEN 'listing has no property URL' ELSE 'property details were not fetched' END AS error
FROM l LEFT JOIN d ON d.k = l.k AND l.k % 7 <> 0
""")
def child_expansion_override(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Communities' children and single properties merged into listings; what is known overrides, the rest is kept."""
    rows = enrich(order_listings(spark, sf_dir), line_details(spark, sf_dir))
    return rows.select(
        F.col("ord").alias("parent"), F.col("detail_ord").cast("bigint").alias("child"), "id", "price", F.col("bedrooms").alias("beds"), F.col("daysListed").alias("days"), "laundry", F.col("isBuilding").alias("building"),
        F.col("address.full").alias("address"), F.col("detailError").alias("error"),
    )


@query(f"""
WITH l AS ({_ORDERS}), d AS (SELECT * FROM ({_LINES}) WHERE k % 9 = 0), one AS (SELECT k FROM d GROUP BY k HAVING count(*) = 1)
SELECT l.k, CASE WHEN days IS NOT NULL OR l.k % 7 = 0 THEN days WHEN l.k % 9 = 0 AND l.k IN (SELECT k FROM one) THEN (SELECT min(n) FROM d WHERE d.k = l.k) * 3 END AS days FROM l
""")
def recency_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of listings without any, from their page's only property."""
    rows = order_listings(spark, sf_dir).withColumn("detail_ord", F.lit(0))
    details = line_details(spark, sf_dir).filter("kind = 'community'")
    return backfill_recency(rows, details, ROW).select(F.col("ord").alias("k"), F.col("daysListed").alias("days"))
