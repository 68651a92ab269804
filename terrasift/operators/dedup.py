"""Deduplication that keeps the first row, by keys and explicit order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrasift.functions.text import null_if_empty, trim_ws

#: Copies of a key that are ranked together; a hot key's rows are ranked in that many groups first.
SALTS = 16


def listing_key(get: Callable[[str], Column] = F.col) -> Column:
    """What a listing is known by: id, else link, else address in lower case; null for none of them."""
    known = lambda name, c: F.concat(F.lit(f"{name}:"), null_if_empty(trim_ws(c)))
    return F.coalesce(known("id", get("id")), known("url", get("url")), known("address", F.lower(get("address")["full"])))


def first_wins(rows: DataFrame, groups: list[str], key: Column, order: list[str | Column], salts: int = SALTS) -> DataFrame:
    """Of the rows of a group with the same key, the first by ``order`` stays; rows without a key all stay.

    Keyless rows are spread by their order instead of meeting under one null. Rows of a key meet in ``salts`` groups
    first, of which one row each goes on: a key that a large share of all rows has isn't gathered in one task.
    """
    place = F.struct(*order)
    own = F.coalesce(key, F.concat(F.lit("\0"), F.to_json(F.struct(place.alias("o")))))
    rows = rows.withColumn("_key", own).withColumn("_salt", F.pmod(F.xxhash64(place), F.lit(salts)))
    for keys in ([*groups, "_key", "_salt"], [*groups, "_key"]):
        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1")
    return rows.drop("_key", "_salt", "_n")


def last_wins(rows: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Of rows with the same keys the last by ``order``, by aggregation."""
    value = F.struct(*(c for c in rows.columns if c not in keys))
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def distinct_urls(rows: DataFrame, url: str = "url") -> DataFrame:
    """Each link to look up once; blank ones are left out."""
    return rows.select(trim_ws(F.col(url)).alias(url)).filter(F.col(url) != "").distinct()
