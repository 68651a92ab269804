"""Listings of earlier searches, in any of the shapes they were printed in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terrasift.operators.filters import has_identity
from terrasift.schemas import LISTING_FIELDS

#: Bytes of a file at most.
LIMIT = 64 << 20
_LISTING = "struct<" + ", ".join(f"{name}: {kind}" for name, kind in LISTING_FIELDS.items()) + ">"
_MANY = f"array<{_LISTING}>"


def read_previous(spark: SparkSession, path: str) -> DataFrame:
    """``parse_previous`` of files; one of more than LIMIT bytes fails, its contents unread."""
    files = spark.read.format("binaryFile").load(path)
    large = [row.path for row in files.filter(F.col("length") > LIMIT).select("path").limit(1).collect()]
    if large:
        raise ValueError(f"previous results exceed {LIMIT} bytes: {large[0]}")
    return parse_previous(files.select(F.col("path").alias("source_id"), F.decode("content", "UTF-8").alias("document")))


def parse_previous(documents: DataFrame) -> DataFrame:
    """source_id, ord and a listing's fields.

    A document is an array of listings, one result with listings, results of several locations, or one JSON value a
    line: a listing, or a listing or error with its location. Errors are skipped; a line that is neither fails.
    """
    text = F.trim("document")
    whole = F.from_json(F.when(text.startswith("["), text), _MANY)
    single = F.from_json(F.when(text.startswith("{"), text), f"struct<listings: {_MANY}, results: array<struct<listings: {_MANY}>>>")
    many = F.flatten(F.transform(single["results"], lambda r: F.coalesce(r["listings"], F.array().cast(_MANY))))
    full = lambda c: F.when(F.size(c) > 0, c)
    rows = documents.select("source_id", "document", F.coalesce(full(whole), full(single["listings"]), full(many)).alias("found"))
    known = rows.filter("found IS NOT NULL").select("source_id", F.posexplode("found").alias("ord", "l"))
    lines = rows.filter("found IS NULL").select("source_id", F.posexplode(F.split("document", r"\r?\n")).alias("ord", "line")).filter("trim(line) != ''")
    wrapped = lines.withColumn("w", F.from_json("line", f"struct<location: string, listing: {_LISTING}, error: string>")).withColumn("bare", F.from_json("line", _LISTING))
    wrapped = wrapped.withColumn("l", F.coalesce("w.listing", F.when(F.coalesce(F.trim("w.error"), F.lit("")) == "", F.col("bare"))))
    bad = F.col("l").isNull() & (F.coalesce(F.trim("w.error"), F.lit("")) == "")
    wrapped = wrapped.withColumn("l", F.when(bad, F.raise_error(F.concat(F.lit("decode previous results line "), (F.col("ord") + 1).cast("string"))).cast(_LISTING)).otherwise(F.col("l")))
    read = known.unionByName(wrapped.filter("l IS NOT NULL").select("source_id", "ord", "l"))
    return read.select("source_id", "ord", "l.*").filter(has_identity())
