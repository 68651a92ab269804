"""Rows as text, for tables and lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terrasift.functions.text import any_of, null_if_empty, trim_ws
from terrasift.operators.normalize import join_address

GROUPS = ["details", "cost", "match", "history", "verification"]


def comma(c: Column) -> Column:
    """An integer with commas between thousands; empty if unknown."""
    return F.coalesce(F.format_number(c, 0), F.lit(""))


def money(c: Column, fallback: Column | str = "") -> Column:
    return F.coalesce(F.concat(F.lit("$"), F.format_number(c, 0)), F.lit(fallback) if isinstance(fallback, str) else fallback)


def plain(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def number(c: Column) -> Column:
    """The shortest decimal: no point for whole numbers."""
    whole = F.when(c == F.floor(c), c.cast("decimal(38,0)").cast("string")).otherwise(c.cast("decimal(38,12)").cast("string"))
    return F.coalesce(F.when(whole.contains("."), F.regexp_replace(whole, r"\.?0+$", "")).otherwise(whole), F.lit(""))


def address_text(a: Column) -> Column:
    full = null_if_empty(trim_ws(a["full"]))
    return F.when(full.isNotNull(), a["full"]).otherwise(join_address(a["street"], a["city"], a["state"], a["postalCode"]))


def column_groups(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Which optional groups of columns have a value in any row: one row, or one for each of ``by``."""
    told = lambda *names: any_of([F.coalesce(F.col(n), F.lit("")) != "" for n in names])
    filled = lambda name: F.coalesce(F.size(name), F.lit(0)) > 0
    return rows.groupBy(*(by or [])).agg(
        F.coalesce(F.bool_or(told("detailStatus", "laundry", "parking", "petPolicy") | filled("flexSpaces") | F.col("yearBuilt").isNotNull()), F.lit(False)).alias("details"),
        F.coalesce(F.bool_or(F.col("requiredMonthlyFees").isNotNull() | F.col("totalMonthlyCost").isNotNull() | F.col("priceIncludesRequiredFees").isNotNull()), F.lit(False)).alias("cost"),
        F.coalesce(F.bool_or(told("matchStatus")), F.lit(False)).alias("match"),
        F.coalesce(F.bool_or(told("historyStatus") | filled("historyChanges")), F.lit(False)).alias("history"),
        F.coalesce(F.bool_or(filled("verificationNotes")), F.lit(False)).alias("verification"),
    )


def union_groups(groups: DataFrame) -> DataFrame:
    return groups.agg(*(F.bool_or(g).alias(g) for g in GROUPS))


def table(rows: DataFrame, groups: dict[str, bool] | None = None, before: list[str] = ()) -> DataFrame:
    """All columns as text under their headers; ``before`` names columns that come first as they are."""
    if groups is None:
        groups = column_groups(rows).first().asDict()
    join = lambda name, by=",": F.array_join(name, by)
    cells = [("ID", F.col("id")), ("PRICE", money(F.col("price"), F.col("priceText")))]
    if groups["cost"]:
        cells += [("FEES", money(F.col("requiredMonthlyFees"))), ("TOTAL", money(F.col("totalMonthlyCost")))]
    cells += [("BEDS", number(F.col("bedrooms"))), ("BATHS", number(F.col("bathrooms"))), ("SQFT", comma(F.col("livingArea"))), ("DAYS", comma(F.col("daysListed"))), ("AVAILABLE", F.col("availability"))]
    if groups["details"]:
        cells += [("YEAR", plain(F.col("yearBuilt"))), ("LAUNDRY", F.col("laundry")), ("PARKING", F.col("parking")), ("PETS", F.col("petPolicy")), ("FLEX", join("flexSpaces"))]
    if groups["match"]:
        cells += [("MATCH", F.col("matchStatus"))]
    if groups["history"]:
        cells += [("HISTORY", F.col("historyStatus")), ("CHANGES", join("historyChanges"))]
    if groups["verification"]:
        cells += [("VERIFY", join("verificationNotes"))]
    cells += [("ADDRESS", address_text(F.col("address"))), ("URL", F.col("url"))]
    return rows.select(*before, *(F.coalesce(c, F.lit("")).alias(name) for name, c in cells))


def location_table(rows: DataFrame, errors: DataFrame) -> DataFrame:
    """Rows of several locations under AREA; a location that failed in part has an error row as well as its listings."""
    listed = table(rows.withColumnRenamed("location", "AREA"), before=["AREA"])
    failed = errors.filter("error != ''").select(F.col("location").alias("AREA"), F.col("error").alias("ERROR"))
    both = listed.unionByName(failed, allowMissingColumns=True)
    return both.select("AREA", "ERROR", *(c for c in both.columns if c not in ("AREA", "ERROR"))).na.fill("")


def location_lines(rows: DataFrame, errors: DataFrame, order: list[str]) -> DataFrame:
    """One JSON value a line: each listing with its location in order, then the location's error."""
    listed = rows.select("location", F.lit(0).alias("last"), F.struct(*order).alias("ord"), F.to_json(F.struct("location", F.struct(*rows.drop("location", *order).columns).alias("listing"))).alias("line"))
    failed = errors.filter("error != ''").select("location", F.lit(1).alias("last"), F.lit(None).alias("ord"), F.to_json(F.struct("location", "error")).alias("line"))
    return listed.unionByName(failed.withColumn("ord", F.lit(None).cast(listed.schema["ord"].dataType))).orderBy("location", "last", "ord").select("line")


PROPERTY_ROWS = [
    ("ID", lambda: F.col("id")), ("Address", lambda: address_text(F.col("address"))), ("Base rent", lambda: money(F.col("price"))),
    ("Required monthly fees", lambda: money(F.col("requiredMonthlyFees"))), ("Total monthly cost", lambda: money(F.col("totalMonthlyCost"))),
    ("Beds", lambda: number(F.col("bedrooms"))), ("Baths", lambda: number(F.col("bathrooms"))), ("Living area", lambda: comma(F.col("livingArea"))),
    ("Year built", lambda: plain(F.col("yearBuilt"))), ("Available", lambda: F.col("availability")), ("Days listed", lambda: comma(F.col("daysListed"))),
    ("Listed date", lambda: F.col("listedDate")), ("Updated date", lambda: F.col("updatedDate")), ("Laundry", lambda: F.col("laundry")),
    ("Laundry features", lambda: F.array_join("laundryFeatures", ", ")), ("Parking", lambda: F.col("parking")), ("Parking features", lambda: F.array_join("parkingFeatures", ", ")),
    ("Pet policy", lambda: F.col("petPolicy")), ("Allowed pets", lambda: F.array_join("allowedPets", ", ")), ("Flex spaces", lambda: F.array_join("flexSpaces", ", ")),
    ("Verification", lambda: F.array_join("verificationNotes", "; ")), ("Home type", lambda: F.col("homeType")), ("Status", lambda: F.col("status")), ("URL", lambda: F.col("url")),
]


def property_table(rows: DataFrame, keys: list[str]) -> DataFrame:
    """24 rows of field and value for each property."""
    pairs = F.array(*(F.struct(F.lit(i).alias("n"), F.lit(name).alias("FIELD"), F.coalesce(c(), F.lit("")).alias("VALUE")) for i, (name, c) in enumerate(PROPERTY_ROWS)))
    return rows.select(*keys, F.inline(pairs))


def checked(rows: DataFrame) -> DataFrame:
    """Fails on a cell with control characters, before anything is written."""
    texts = [c for c, kind in rows.dtypes if kind == "string"]
    bad = any_of([F.coalesce(F.col(c).rlike(r"\p{Cc}"), F.lit(False)) for c in texts])
    guard = F.when(bad, F.raise_error(F.lit("table cell contains a control character"))).otherwise(F.col(texts[0]))
    return rows.withColumn(texts[0], guard) if texts else rows


def aligned(rows: DataFrame, pad: int = 2) -> str:
    """A table as text, padded by two spaces. For results a person reads: the rows are collected."""
    cells = [rows.columns, *([str(v) for v in row] for row in rows.collect())]
    widths = [max(len(line[i]) for line in cells) for i in range(len(rows.columns))]
    return "".join("".join(v.ljust(w + pad) for v, w in zip(line, widths, strict=True)).rstrip() + "\n" for line in cells)
