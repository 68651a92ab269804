"""Details joined to listings: one property, or a community's children, for each link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions.text import null_if_empty, trim_ws

# Taken from the details even when these are null, and only when they are known.
ALWAYS = [
    "yearBuilt", "description", "laundry", "laundryFeatures", "parking", "parkingFeatures", "petPolicy", "allowedPets",
    "flexSpaces", "requiredMonthlyFees", "totalMonthlyCost", "priceIncludesRequiredFees", "verificationNotes",
    "sharedHousing", "studentHousing", "incomeRestricted",
]
IF_KNOWN = ["price", "bedrooms", "bathrooms", "livingArea", "daysListed"]
IF_TOLD = ["listedDate", "updatedDate", "availability", "homeType", "status"]
RECENCY = ["daysListed", "listedDate", "updatedDate"]


def enrich(listings: DataFrame, details: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Left join on the trimmed link, one row for each property found; ``detail_ord`` is its place.

    ``details`` has link, kind ("community" or "property"), ord and a property's fields; ``errors`` has link and error. A
    listing without a link, without details or with an error stays, marked unavailable. The first property of a
    property page is merged into the listing; all others, and a community's, replace its identity.
    """
    fields = [c for c in details.columns if c not in ("link", "kind", "ord")]
    found = details.select("link", "kind", F.col("ord").alias("detail_ord"), F.struct(*fields).alias("d"))
    found = found.withColumn("_error", F.lit(None).cast("string"))
    if errors is not None:
        # one table of what is known by link, so that listings are shuffled once; an error outweighs details
        told = errors.filter("link IS NOT NULL").groupBy("link").agg(F.min("error").alias("_error"))
        rest = found.drop("_error").join(told.select("link"), "link", "left_anti").withColumn("_error", F.lit(None).cast("string"))
        found = rest.unionByName(told, allowMissingColumns=True)
    every = listings.withColumn("link", null_if_empty(trim_ws(F.col("url"))))
    # listings without a link stay where they are: as one key of the join they would meet in one task
    linked = every.filter("link IS NOT NULL").join(found, "link", "left")
    rows = linked.unionByName(every.filter("link IS NULL"), allowMissingColumns=True)
    there = F.col("d").isNotNull() & F.col("_error").isNull()
    child = there & ((F.col("kind") == "community") | (F.col("detail_ord") > 0))
    d = lambda name: F.col(f"d.{name}")
    told = lambda name: F.coalesce(trim_ws(d(name)), F.lit("")) != ""
    new: dict[str, Column] = {}
    for name in ALWAYS:
        new[name] = F.when(there, d(name)).otherwise(F.col(name))
    for name in IF_KNOWN:
        old = F.when(child, None).otherwise(F.col(name)) if name in RECENCY else F.col(name)
        new[name] = F.when(there, F.coalesce(d(name), old)).otherwise(F.col(name))
    for name in IF_TOLD:
        old = F.when(child, F.lit("")).otherwise(F.col(name)) if name in RECENCY else F.col(name)
        new[name] = F.when(there & told(name), d(name)).otherwise(F.when(there, old).otherwise(F.col(name)))
    new["id"] = F.when(child, d("id")).otherwise(F.col("id"))
    new["url"] = F.when(child & (d("url") != ""), d("url")).otherwise(F.col("url"))
    new["address"] = F.when(child & (d("address.full") != ""), d("address")).otherwise(F.col("address"))
    new["isBuilding"] = F.when(child, False).otherwise(F.col("isBuilding"))
    why = F.coalesce(F.when(F.col("link").isNull(), F.lit("listing has no property URL")), "_error", F.lit("property details were not fetched"))
    new["detailStatus"] = F.when(there, "enriched").otherwise("unavailable")
    new["detailError"] = F.when(there, "").otherwise(why)
    for name in ("laundry", "parking", "petPolicy"):
        new[name] = F.when(there, d(name)).otherwise(F.lit("unknown"))
    return rows.withColumns(new).withColumn("detail_ord", F.coalesce("detail_ord", F.lit(0))).drop("link", "kind", "d", "_error")


def backfill_recency(listings: DataFrame, details: DataFrame, row: list[str]) -> DataFrame:
    """Fills days and dates of listings without days from the page's property of the same id or link, or its only one.

    ``row`` names the columns that tell listings apart. Listings with days keep away from the join.
    """
    open_ = listings.filter("daysListed IS NULL AND trim(url) != ''")
    others = listings.filter("NOT (daysListed IS NULL AND trim(url) != '') OR url IS NULL")
    alone = F.count(F.lit(1)).over(Window.partitionBy("link")) == 1
    found = details.select("link", F.col("ord").alias("d_ord"), F.col("id").alias("d_id"), F.col("url").alias("d_url"), *(F.col(c).alias(f"d_{c}") for c in RECENCY)).withColumn("alone", alone)
    fits = ((F.col("id") != "") & (F.col("id") == F.col("d_id"))) | ((F.col("url") != "") & (F.col("url") == F.col("d_url"))) | F.col("alone")
    keys = open_.select(*row, "id", "url", trim_ws(F.col("url")).alias("link")).join(found, "link").filter(fits)
    first = keys.groupBy(*row).agg(F.min_by(F.struct(*(f"d_{c}" for c in RECENCY)), "d_ord").alias("d"))
    filled = open_.join(first, row, "left").withColumn("daysListed", F.col("d.d_daysListed"))
    for name in RECENCY[1:]:
        filled = filled.withColumn(name, F.coalesce(null_if_empty(F.col(f"d.d_{name}")), F.col(name)))
    return others.unionByName(filled.drop("d"))
